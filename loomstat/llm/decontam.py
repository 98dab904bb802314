"""Benchmark decontamination by a positional inverted index.

A first pass counts the terms of the benchmark vocabulary in all training texts. A second stores
the positions at which they stand in each document that has the two rarest terms of some phrase.
A phrase starts from its rarest term: that term's
postings, shifted by its offset, propose starts; the lists of its other terms, in order of rarity
and shifted by their offsets, are intersected with them. With ``slack`` 0 a match is an exact
phrase, otherwise a proximity match: every term stands within ``slack`` words of its place.

A phrase is a window of consecutive item words, or the whole of an item with fewer. Null and
wordless texts have no words, so neither match nor are matched. Documents are told apart by row,
so null or repeated keys give rows of their own; repeated items each count by their id. Columns
other than key and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .text import ALNUM, LOWER, lists, slices, span_hashes, words

# up to this many terms (8 bytes each) are broadcast to select postings while reading; with more
# the index holds the postings of all terms of all documents
BROADCAST_TERMS = 4_000_000
# phrases (some 300 bytes each) up to this many are broadcast to the proposed starts
BROADCAST_PHRASES = 200_000


def item_windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(item, phrase, terms): every window of ``size`` words, or all words of a shorter item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                data = LOWER[data]
                starts, ends, owner = words(data, offsets, ALNUM)
                terms = span_hashes(data, starts, ends).view(np.int64)
                rows, out = [], []
                for i in range(last - first):
                    own = terms[owner == i]
                    for at in range(max(1, len(own) - size + 1) if len(own) else 0):
                        rows.append(first + i)
                        out.append(own[at:at + size].tolist())
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(out, pa.list_(pa.int64()))], ["item", "terms"])

    schema = f"item {items.schema[key].dataType.simpleString()}, terms array<bigint>"
    return (items.select(key, text).mapInArrow(run, schema)
            .withColumn("phrase", F.xxhash64(F.col("terms"), F.size("terms"))))


def _terms(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None):
    """(term, text number, position, words per text) of the known terms, or of all."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets, ALNUM)
    term = span_hashes(data, starts, ends).view(np.int64)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    place = np.arange(len(term)) - np.repeat(np.cumsum(counts) - counts, counts)
    if known is not None:
        held = np.zeros(len(term), bool)
        if len(known):
            held = known[np.minimum(np.searchsorted(known, term), len(known) - 1)] == term
        term, owner, place = term[held], owner[held], place[held]
    return term, owner, place, counts


def _small_enough(spark: SparkSession, df: DataFrame):
    """The rows as numpy columns, broadcast; None if there are more than BROADCAST_TERMS."""
    rows = df.limit(BROADCAST_TERMS + 1).toPandas()
    if len(rows) > BROADCAST_TERMS:
        return None
    return spark.sparkContext.broadcast({c: rows[c].to_numpy(np.int64) for c in rows})


def term_counts(docs: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(term, df): how often each vocabulary term stands in the documents, over all of them."""
    shared = _small_enough(docs.sparkSession, vocabulary.select("term").distinct().orderBy("term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value["term"] if shared else None
        for batch in batches:
            found = [_terms(data, offsets, known)[0] for _, _, data, offsets in slices(batch.column(0))]
            term, count = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(count)], ["term", "df"])

    return docs.select(text).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def by_rarity(phrases: DataFrame, frequency: DataFrame) -> DataFrame:
    """(phrase, length, rest): the terms of each phrase with their offsets, rarest first. A phrase
    with a term that no document has cannot match and is left out."""
    return cut_lineage(
        phrases.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("off", "term"))
        .join(frequency, "term").groupBy("phrase", "length")
        .agg(F.array_sort(F.collect_list(F.struct("df", "off", "term"))).alias("rest"))
        .filter(F.size("rest") == F.col("length")))


def positional_index(docs: DataFrame, key: str, text: str, ordered: DataFrame) -> DataFrame:
    """(row, key, n_words, postings): the positions of the phrases' terms in each document, as a table
    in the shared folder. A document that lacks the rarest two terms of every phrase can match none
    and gets no postings, which needs the phrases' terms in every task; if they are too many to be
    broadcast, all postings of all documents are stored."""
    spark = docs.sparkSession
    terms = _small_enough(spark, ordered.select(F.explode("rest.term").alias("term")).distinct().orderBy("term"))
    pairs = _small_enough(spark, ordered.select(
        F.col("rest")[0]["term"].alias("x"), F.expr("rest[least(1, length - 1)].term").alias("y")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, x, y = None, None, None
        if terms and pairs:
            known = terms.value["term"]
            x, y = (np.searchsorted(known, pairs.value[c]) for c in "xy")
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                n = last - first
                term, owner, place, counts = _terms(data, offsets, known)
                order = np.lexsort((term, owner))               # stable: positions stay ascending
                term, owner, place = term[order], owner[order], place[order]
                if known is not None:
                    number = np.searchsorted(known, term)
                    bounds = np.searchsorted(owner, np.arange(n + 1))
                    promising = np.zeros(n, bool)
                    has = np.zeros(len(known), bool)
                    for i in np.flatnonzero(np.diff(bounds)):
                        own = number[bounds[i]:bounds[i + 1]]
                        has[own] = True
                        promising[i] = (has[x] & has[y]).any()
                        has[own] = False
                    keep = promising[owner]
                    term, owner, place = term[keep], owner[keep], place[keep]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(new)
                sizes = np.diff(np.append(heads, len(term)))
                entry = pa.StructArray.from_arrays([pa.array(term[heads], pa.int64()), lists(place, sizes, pa.int32())],
                                                   ["term", "places"])
                bounds = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(owner[heads], minlength=n), out=bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds), entry)], ["key", "n_words", "postings"])

    schema = (f"key {docs.schema[key].dataType.simpleString()}, n_words bigint, "
              "postings array<struct<term:bigint,places:array<int>>>")
    return cut_lineage(docs.select(key, text).mapInArrow(run, schema)
                       .withColumn("row", F.monotonically_increasing_id()))


def phrase_matches(index: DataFrame, ordered: DataFrame, slack: int = 0) -> DataFrame:
    """(row, phrase, start, length): where the phrases of ``by_rarity`` stand in the documents."""
    held = index.filter(F.size("postings") > 0)
    anchors = ordered.select("phrase", F.col("rest")[0]["term"].alias("term"), F.col("rest")[0]["off"].alias("off"))
    starts = (held.select("row", F.explode("postings").alias("p")).select("row", "p.term", "p.places")
              .join(anchors, "term")
              .select("row", "phrase", F.explode(F.transform("places", lambda p: p - F.col("off"))).alias("start"))
              .filter(F.col("start") >= 0).distinct())

    # proposed starts meet the postings of their document; few documents have any
    proposed = starts.groupBy("row").agg(F.collect_list(F.struct("phrase", "start")).alias("proposed"))
    lookup = held.select("row", F.map_from_entries(F.expr("transform(postings, p -> struct(p.term, p.places))"))
                          .alias("places"))
    at_place = ("array_contains(places[x.term], start + x.off)" if not slack else
                f"exists(places[x.term], p -> abs(p - start - x.off) <= {int(slack)})")
    return (proposed.join(lookup, "row")
            .select("row", F.explode("proposed").alias("s"), "places")
            .select("row", "s.phrase", "s.start", "places")
            .join(F.broadcast(ordered) if ordered.count() <= BROADCAST_PHRASES else ordered, "phrase")
            .filter(F.expr(f"forall(rest, x -> coalesce({at_place}, false))"))
            .select("row", "phrase", "start", "length"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", size: int = 10, slack: int = 0) -> DataFrame:
    """One row per document: key, n_words, n_hit (words inside a match), items (sorted distinct keys,
    as text, of the items with a match), spans (start, length of the matches)."""
    windows = cut_lineage(item_windows(items, item_key, item_text, size))
    phrases = windows.select("phrase", "terms").dropDuplicates(["phrase"])
    ordered = by_rarity(phrases, term_counts(docs, text, phrases.select(F.explode("terms").alias("term"))))
    index = positional_index(docs, key, text, ordered)
    found = cut_lineage(phrase_matches(index, ordered, slack))

    upto = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    hits = (found.select("row", "start", "length", (F.col("start") + F.col("length")).alias("stop")).distinct()
            .withColumn("before", F.coalesce(F.max("stop").over(upto), F.lit(0)))
            .groupBy("row").agg(
                F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).alias("n_hit"),
                F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans")))
    named = (found.select("row", "phrase").distinct().join(windows.select("phrase", "item").distinct(), "phrase")
             .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")))
    return (index.select("row", F.col("key").alias(key), "n_words")
            .join(hits.join(named, "row"), "row", "left")
            .select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans"))
