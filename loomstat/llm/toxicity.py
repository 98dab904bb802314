"""Toxicity scores from two class-conditional Kneser-Ney models.

The unit is the word: a run of letters, as bytes, lower-case for A-Z and Latin-1, with a start and
an end. Each class has counts of ``order`` consecutive bytes; both back off to one shared model of
continuation counts, so a rare expression is judged by shared counts and only what a class has
really seen moves it. A word's score is the toxic less the ordinary log-likelihood, divided by its
length. A text's features are its three highest word scores and its mean; a logistic curve, fitted
on a fold the counts have not seen, turns them into a score between 0 and 1.

All counts come from Spark aggregations over all labelled documents that may be learned from.
Models up to ``BROADCAST_ROWS`` entries are broadcast and read in every task; larger ones are
joined with the distinct words, whose scores are then joined with the documents.

Defined cases: a null or empty text has no words and all features 0, and gets the score of such
texts; documents without a label or with a null one teach nothing; with several labels for a key
the larger counts; without labels of both classes every score is 0. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .text import LOWER, slices, words

LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
BROADCAST_ROWS = 8_000_000
FOLDS = (0, 1, 3)               # fold 2 is never learned from
FEATURES = ["first", "second", "third", "mean"]


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def lowered(data: np.ndarray) -> np.ndarray:
    data = LOWER[data]
    if len(data) > 1:       # the two-byte capitals of Latin-1
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)) + 1
        data[capital] += 0x20
    return data


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int):
    """(gram, word number) for every byte of every word and for its end; the bytes of a gram are
    packed into 64 bits, zeros standing before the word, so at most 7 fit beside the end."""
    size = ends - starts
    room = size + order
    base = np.cumsum(room) - room
    padded = np.zeros(int(room.sum()), np.uint64)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    padded[np.repeat(base + order - 1, size) + step] = data[np.repeat(starts, size) + step]
    padded[base + room - 1] = 32
    count = size + 1
    at = np.repeat(base + order - 1, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros(len(at), np.uint64)
    for j in range(order):
        out = (out << np.uint64(8)) + padded[at - order + 1 + j]
    return out.view(np.int64), np.repeat(np.arange(len(size)), count)


def gram_counts(df: DataFrame, text: str, toxic: str, order: int) -> DataFrame:
    """(gram, toxic, ordinary): occurrences in texts of either class, merged in each batch first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in slices(batch.column(0)):
                data = lowered(data)
                starts, ends, owner = words(data, offsets, LETTERS)
                found, word = grams(data, starts, ends, order)
                mine = marks[first:last][owner[word]] == 1
                held[1].append(found[mine])
                held[0].append(found[~mine])
            gram, at = np.unique(np.concatenate(held[0] + held[1]), return_inverse=True)
            split = sum(map(len, held[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), pa.array(np.bincount(at[split:], minlength=len(gram))),
                 pa.array(np.bincount(at[:split], minlength=len(gram)))], ["gram", "toxic", "ordinary"])

    return (df.select(text, F.col(toxic).cast("int")).mapInArrow(run, "gram bigint, toxic bigint, ordinary bigint")
            .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))


def fit_ratios(counts: DataFrame, order: int, discount: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """((gram, ratio), (context, ratio)): log P_toxic - log P_ordinary of seen grams, and of any
    other byte after a seen context, where the shared model cancels out."""
    def suffix(n: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << (8 * n)) - 1))

    # shared continuation probabilities, from the last byte alone up to order - 1 bytes
    shared = None
    for n in range(1, order):
        below = counts.select(suffix(n + 1).alias("gram")).distinct() if n + 1 < order else counts.select("gram")
        level = below.groupBy(suffix(n).alias("tail")).agg(F.count("*").alias("c"))
        if shared is None:
            total = level.agg(F.sum("c").alias("total"))
            shared = level.join(F.broadcast(total)).select(
                "tail", ((F.col("c") + 0.5) / (F.col("total") + 128.0)).alias("p"))
            continue
        level = level.withColumn("context", F.shiftright("tail", 8)).withColumn(
            "rest", F.col("tail").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1)))
        sums = level.groupBy("context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        shared = (level.join(sums, "context").join(shared.select(F.col("tail").alias("rest"), "p"), "rest")
                  .select("tail", ((F.greatest(F.col("c") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("p"))
                                   / F.col("total")).alias("p")))
    contexts = (counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(
        *[F.sum(c).alias(f"n_{c}") for c in ("toxic", "ordinary")],
        *[F.sum((F.col(c) > 0).cast("long")).alias(f"k_{c}") for c in ("toxic", "ordinary")]))

    def weight(c: str) -> Column:       # of the shared model after a context
        return F.when(F.col(f"n_{c}") > 0, discount * F.col(f"k_{c}") / F.col(f"n_{c}")).otherwise(1.0)

    def probability(c: str) -> Column:
        own = F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - discount, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(0.0)
        return own + weight(c) * F.col("p")

    seen = (counts.withColumn("context", F.shiftright("gram", 8)).withColumn("tail", suffix(order - 1))
            .join(contexts, "context").join(shared, "tail")
            .select("gram", (F.log(probability("toxic")) - F.log(probability("ordinary"))).alias("ratio")))
    other = contexts.select("context", (F.log(weight("toxic")) - F.log(weight("ordinary"))).alias("ratio"))
    return cut_lineage(seen), cut_lineage(other)


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked)), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    return np.where(hit, values[at], 0.0), hit


def pooled(score: np.ndarray, size: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The features of n texts: their three highest word scores and the mean over their bytes."""
    out = np.zeros((n, 4))
    order = np.lexsort((-score, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner, np.arange(n))[owner[order]] if len(order) else order
    for r in range(3):
        at = order[rank == r]
        out[owner[at], r] = score[at]
    total = np.bincount(owner, weights=size, minlength=n)
    out[:, 3] = np.bincount(owner, weights=score * size, minlength=n) / np.maximum(total, 1)
    return out


def features(df: DataFrame, text: str, seen: DataFrame, other: DataFrame, order: int,
             broadcast_rows: int | None = None) -> DataFrame:
    """The columns of ``df`` but its text, and FEATURES."""
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if seen.count() + other.count() > limit:
        return _features_by_join(df, text, seen, other, order)
    model = {}
    for name, rows, key in (("seen", seen, "gram"), ("other", other, "context")):
        held = rows.orderBy(key).toPandas()
        model[name] = held[key].to_numpy(np.int64), held["ratio"].to_numpy(np.float64)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(len(kept))):
                data = lowered(data)
                starts, ends, owner = words(data, offsets, LETTERS)
                found, word = grams(data, starts, ends, order)
                ratio, hit = _lookup(*shared.value["seen"], found)
                rest = ~hit
                ratio[rest] = _lookup(*shared.value["other"], found[rest] >> 8)[0]
                size = ends - starts + 1
                score = np.bincount(word, weights=ratio, minlength=len(size)) / size
                table = pooled(score, size, owner, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, last - first) for i in range(len(kept))),
                     *(pa.array(table[:, i]) for i in range(4))], [*kept, *FEATURES])

    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType([df.schema[c] for c in kept] + [StructField(c, DoubleType()) for c in FEATURES])
    return df.select(*kept, text).mapInArrow(run, schema)


def _features_by_join(df: DataFrame, text: str, seen: DataFrame, other: DataFrame, order: int) -> DataFrame:
    """The same where the model is too large to be broadcast: each distinct word meets it once."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in slices(batch.column(1)):
                data = lowered(data)
                starts, ends, owner = words(data, offsets, LETTERS)
                raw = data.tobytes()
                found = {}
                for i, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist()):
                    found[i, raw[a:b]] = found.get((i, raw[a:b]), 0) + 1
                rows = batch.column(0).slice(first, len(offsets) - 1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[[i for i, _ in found]] if found else [], pa.int64()), pa.array([w for _, w in found], pa.binary()),
                     pa.array(list(found.values()), pa.int64())], ["row", "word", "times"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in slices(batch.column(0)):
                found, word = grams(data, offsets[:-1], offsets[1:], order)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(word + first)), pa.array(found)], ["word", "gram"])

    rows = cut_lineage(df.withColumn("row", F.monotonically_increasing_id()))
    held = cut_lineage(rows.select("row", text).mapInArrow(split, "row bigint, word binary, times bigint"))
    spelled = held.select("word").distinct().mapInArrow(spell, "word binary, gram bigint")
    scored = (spelled.join(seen, "gram", "left")
              .join(other.select("context", F.col("ratio").alias("back")), F.shiftright("gram", 8) == F.col("context"), "left")
              .groupBy("word").agg(F.avg(F.coalesce("ratio", "back", F.lit(0.0))).alias("score"), F.count("*").alias("size")))
    each = held.join(scored, "word")
    sums = each.groupBy("row").agg((F.sum(F.col("score") * F.col("size") * F.col("times"))
                                    / F.sum(F.col("size") * F.col("times"))).alias("mean"))
    top = (each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("times").cast("int"), F.lit(3)))))
           .withColumn("at", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"))))
           .filter("at <= 3").groupBy("row").agg(*[F.max(F.when(F.col("at") == i + 1, F.col("score"))).alias(c)
                                                   for i, c in enumerate(FEATURES[:3])]))
    return (rows.drop(text).join(sums, "row", "left").join(top, "row", "left")
            .select(*[c for c in df.columns if c != text], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES]))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and constant of a ridge logistic curve, by Newton steps on scaled features."""
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), slope)
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ middle)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
             order: int = 5, threshold: float = 0.3, curve_rows: int = 20_000,
             broadcast_rows: int | None = None) -> DataFrame:
    """One row per document: key, held_out, FEATURES, score, predicted. Learns from labelled documents
    whose fold is not 2: the curve from at most ``curve_rows`` of the folds, those with the smallest key
    hashes, each fold judged by the counts of the other two; then scores come from the counts of all.

    Fold 3 judged by 0 and 1 makes the curve as long as both sides have both classes; otherwise all folds
    are judged, so that any fold with a class of its own serves. If no fold can be judged by others with both
    classes, the score is that of the plain log-likelihood ratio; without both classes anywhere it is 0."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marks = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key)) != 2))
             .groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label")))
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    taught = docs.join(marks, "key")
    counts = {f: cut_lineage(gram_counts(taught.filter(fold(F.col("key")) == f), "text", "label", order)) for f in FOLDS}
    held = {f: c.agg(F.sum("toxic"), F.sum("ordinary")).first() for f, c in counts.items()}
    has = {f: [bool(n) for n in h] for f, h in held.items()}

    def both(folds) -> bool:
        return all(any(has[f][c] for f in folds) for c in (0, 1))

    def merged(folds) -> DataFrame:
        rows = [counts[f] for f in folds]
        whole = reduce(DataFrame.unionByName, rows)
        return whole.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))

    def judged(f: int) -> pd.DataFrame:
        model = fit_ratios(cut_lineage(merged([g for g in FOLDS if g != f])), order)
        rows = features(taught.filter(fold(F.col("key")) == f), "text", *model, order, broadcast_rows)
        return rows.orderBy(F.xxhash64("key"), *FEATURES).limit(curve_rows).select("label", *FEATURES).toPandas()

    weights, constant = np.zeros(4), -30.0
    if both(FOLDS):
        last = FOLDS[-1]
        chosen = [last] if both([last]) and both(FOLDS[:-1]) else [f for f in FOLDS if any(has[f]) and both([g for g in FOLDS if g != f])]
        rows = pd.concat([judged(f) for f in chosen]) if chosen else pd.DataFrame({"label": []})
        if rows["label"].nunique() == 2:
            weights, constant = fit_curve(rows[FEATURES].to_numpy(), rows["label"].to_numpy())
        else:
            weights, constant = np.array([float(c == "mean") for c in FEATURES]), 0.0
        scored = features(docs, "text", *fit_ratios(cut_lineage(merged(FOLDS)), order), order, broadcast_rows)
    else:
        scored = docs.drop("text").withColumns({c: F.lit(0.0) for c in FEATURES})
    total = F.lit(constant)
    for c, w in zip(FEATURES, weights):
        total = total + float(w) * F.col(c)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) if weights.any() else F.lit(0.0)
    return (scored.withColumn("score", score)
            .select(F.col("key").alias(key), F.coalesce(fold(F.col("key")) == 2, F.lit(True)).alias("held_out"), *FEATURES,
                    "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
