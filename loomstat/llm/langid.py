"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte n-grams (lower-case, runs of non-letters as one space), as square roots of
their shares, so every text has length 1 whatever its size. Families are learned: languages whose
mean profiles are most alike are merged until about the square root of their number remain. A
linear support vector machine per family tells it from the rest; within a family one machine for
each pair of languages votes, and margins break ties.

The machines are fitted on at most ``sample_rows`` different texts, an even number per language (20 at
least, or all it has), chosen by a hash of the text; that bounds what reaches the driver. Copies count
once and texts without a letter take no place. Predictions read every text whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no labelled
text everything is; one known language is predicted for all other texts. Null labels and null keys
teach nothing. Repeated rows are predicted alike. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .text import mix, slices
from .toxicity import LETTERS, fold, lowered

UNKNOWN = "und"
DIMENSIONS = 1 << 13
ORDERS = (1, 2, 3)
TEXTS = 128                     # feature rows held at once


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text; a text without letters has a zero row."""
    n = len(offsets) - 1
    data = lowered(data)
    letter = LETTERS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    keep = letter.copy()                             # letters, and the first of each run of others
    if len(data):
        keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    body = np.where(letter, data, 32)[keep].astype(np.uint64)
    owner = owner[keep]
    out = np.zeros(n * DIMENSIONS)
    for order in ORDERS:
        m = len(body) - order + 1
        if m <= 0:
            continue
        gram = np.full(m, order, np.uint64)
        for j in range(order):
            gram = (gram << np.uint64(8)) + body[j:m + j]
        inside = owner[:m] == owner[order - 1:]
        bucket = (mix(gram[inside]) >> np.uint64(64 - 13)).astype(np.int64)
        out += np.bincount(owner[:m][inside] * DIMENSIONS + bucket, minlength=len(out))
    out = out.reshape(n, DIMENSIONS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    owner = np.repeat(np.arange(len(out)), np.diff(offsets))
    out[owner[LETTERS[lowered(data)] & (data < 128)]] = True
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        text = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
        out[i] = any(c.isalpha() for c in text)
    return out


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights (the last is the constant) of a linear support vector machine for labels -1 and 1, by
    coordinate steps in the dual."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    square = (x * x).sum(1)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * float(x[i] @ w) - 1 + alpha[i] / (2 * cost)
            new = max(0.0, alpha[i] - slope / (float(square[i]) + 1 / (2 * cost)))
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def families_of(x: np.ndarray, y: np.ndarray, langs: list[str]) -> list[list[int]]:
    """Groups of languages, merged by the likeness of their mean profiles."""
    means = np.array([x[y == i].mean(0) for i in range(len(langs))], np.float64)
    means -= means.mean(0)                                     # what all languages share says nothing
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    alike = means @ means.T
    groups = [[i] for i in range(len(langs))]
    while len(groups) > max(1, round(len(langs) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2),
                   key=lambda p: np.mean([alike[i, j] for i in groups[p[0]] for j in groups[p[1]]]))
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups)


class Model:
    """Machines per family and per pair of languages of a family."""

    def __init__(self, x: np.ndarray, y: np.ndarray, langs: list[str]):
        self.langs = langs
        self.families = families_of(x, y, langs) if langs else []
        member = np.zeros(len(langs), np.int64)
        for f, group in enumerate(self.families):
            member[group] = f
        self.top = np.array([machine(x, np.where(member[y] == f, 1.0, -1.0)) for f in range(len(self.families))]) \
            if len(self.families) > 1 else None
        self.pairs = []
        for group in self.families:
            fitted = []
            for a, b in combinations(group, 2):
                own = (y == a) | (y == b)
                fitted.append((a, b, machine(x[own], np.where(y[own] == a, 1.0, -1.0))))
            self.pairs.append(fitted)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score between 0 and 1) of each row."""
        n = len(x)
        family, score = np.zeros(n, np.int64), np.ones(n)
        if self.top is not None:
            margin = x @ self.top[:, :-1].T + self.top[:, -1]
            family = margin.argmax(1)
            score *= 1 / (1 + np.exp(-4 * margin.max(1)))
        out = np.zeros(n, np.int64)
        for f, fitted in enumerate(self.pairs):
            own = np.flatnonzero(family == f)
            out[own] = self.families[f][0]
            if not fitted or not len(own):
                continue
            votes = np.zeros((len(own), len(self.langs)))
            least = np.full((len(own), len(self.langs)), np.inf)
            for a, b, w in fitted:
                margin = x[own] @ w[:-1] + w[-1]
                votes[:, a] += (margin >= 0) + 1e-6 * np.tanh(margin)
                votes[:, b] += (margin < 0) - 1e-6 * np.tanh(margin)
                least[:, a] = np.minimum(least[:, a], margin)
                least[:, b] = np.minimum(least[:, b], -margin)
            votes[:, [i for i in range(len(self.langs)) if i not in self.families[f]]] = -1
            out[own] = votes.argmax(1)
            score[own] *= 1 / (1 + np.exp(-4 * least[np.arange(len(own)), out[own]]))
        return out, score


def _by_rows(data: np.ndarray, offsets: np.ndarray):
    """Runs of at most TEXTS texts."""
    for a in range(0, len(offsets) - 1, TEXTS):
        b = min(a + TEXTS, len(offsets) - 1)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def training_texts(df: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 2_000) -> DataFrame | None:
    """(lang, text): different texts with a letter, as many of each language as it has or as its share of
    ``sample_rows``; None without any."""
    known = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")) \
        .filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    different = cut_lineage(known.select("lang", "h").distinct().withColumn("at", F.pmod("h", F.lit(1 << 30))))
    counts = {r.lang: r["count"] for r in different.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(20, sample_rows // len(counts))
    # a hash threshold per language thins the texts before any are ranked; it is widened where too few pass
    share = {k: min(1.0, (2 * each + 50) / c) for k, c in counts.items()}
    while True:
        limit = F.create_map(*[F.lit(v) for k, x in share.items() for v in (k, int(x * (1 << 30)))])
        thinned = different.filter(F.col("at") <= limit[F.col("lang")])
        passed = {r.lang: r["count"] for r in thinned.groupBy("lang").count().collect()}
        short = [k for k, c in counts.items() if passed.get(k, 0) < min(each, c)]
        if not short:
            break
        share |= {k: min(1.0, 4 * share[k]) for k in short}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "h"))
    chosen = thinned.withColumn("no", rank).filter(F.col("no") <= each).select("lang", "h")
    return known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(df: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 2_000) -> Model:
    """Learn from (text, lang); rows with a null in either, or without a letter, teach nothing."""
    chosen = training_texts(df, text, lang, sample_rows)
    if chosen is None:
        return Model(np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                for a, b, part, at in _by_rows(data, offsets):
                    x = profiles(part, at)
                    some = x.any(1)
                    rows = [np.flatnonzero(r).astype(np.int32) for r in x[some]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first + a, b - a).filter(pa.array(some)),
                         pa.array(rows, pa.list_(pa.int32())),
                         pa.array([r[i] for r, i in zip(x[some], rows)], pa.list_(pa.float32()))], ["lang", "at", "value"])

    rows = chosen.mapInArrow(run, "lang string, at array<int>, value array<float>").toArrow()
    x, y = np.zeros((rows.num_rows, DIMENSIONS), np.float32), np.zeros(rows.num_rows, np.int64)
    number = {name: i for i, name in enumerate(sorted(set(rows["lang"].to_pylist())))}
    for i, (name, at, value) in enumerate(zip(rows["lang"].to_pylist(), rows["at"].to_pylist(), rows["value"].to_pylist())):
        x[i, at], y[i] = value, number[name]
    order = np.lexsort((x @ np.arange(DIMENSIONS, dtype=np.float32), y))      # the same order on every run
    return Model(x[order], y[order], list(number))


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns of ``df`` and the predicted language and its score; columns of these names are replaced."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (out, score)]
    at_text = kept.index(text)
    schema = StructType([df.schema[c] for c in kept] + [StructField(out, StringType()), StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(at_text)):
                for a, b, part, at in _by_rows(data, offsets):
                    held = has_letter(part, at) & bool(model.langs)
                    lang, sure = np.full(b - a, len(model.langs)), np.zeros(b - a)
                    if held.any():
                        lang[held], sure[held] = model.predict(profiles(part, at)[held])
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(first + a, b - a) for c in batch.columns), pa.array(names[lang], pa.string()),
                         pa.array(sure)], [*kept, out, score])

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             sample_rows: int = 2_000) -> DataFrame:
    """(key, held_out, lang_pred, score): learned from rows whose fold is not 2, predicted for all."""
    model = fit(df.filter(F.col(key).isNotNull() & (fold(F.col(key)) != 2)), text, lang, sample_rows)
    found = predict(df.select(F.col(key).alias("key"), F.col(text).alias("text")), model)
    return found.select(F.col("key").alias(key), F.coalesce(fold(F.col("key")) == 2, F.lit(True)).alias("held_out"),
                        "lang_pred", "score")
