"""Jaccard self-join of documents on word n-grams: size-aware, light and heavy sets.

Elements of every set stand in one order, rare ones first. Two sets that reach the similarity share
at least c elements among the first n - ceil(t n) + c of each. Light (small) sets enumerate all
subsets of c = 2 such elements and meet in equal subsets. Heavy sets put single elements (c = 1)
into inverted lists, and every set that can reach a heavy one scans them. The size at which sets
become heavy is where the counted cost of both ways, subsets enumerated against list entries
scanned, is least. Candidates are verified on whole sets, so the result is exact.

Rarity is a count over all documents in a fixed number of buckets of the element's hash. A bucket
can only overstate a count, which costs time and never a link, as any common order is exact.

Defined cases: null texts and texts without words have the empty set and link with nothing; texts
with fewer words than n have one element; equal sets are one node and link; a null key links to
nothing of its own but belongs to the component of documents equal to it; texts that share a key
are one node. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, discard
from .linking import link, members_of_shared_keys, within_broadcast
from .text import LOWER, NOT_SPACE, distinct_by_owner, lists, mix, shingles, slices, span_hashes, words

SKETCH_BITS = 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """(hashes, counts per text): the distinct k-word shingles of each text, ascending."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets, NOT_SPACE)
    hashes, owner = shingles(span_hashes(data, starts, ends), owner, len(offsets) - 1, k)
    return distinct_by_owner(hashes, owner, len(offsets) - 1)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def bucket_counts(df: DataFrame, text: str, k: int) -> np.ndarray:
    """How many sets hold an element of each bucket; one value for each of 2^SKETCH_BITS buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                total += np.bincount(bucket_of(shingle_sets(data, offsets, k)[0]), minlength=len(total))
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            part = some[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], ["bucket", "count"])

    rows = (df.select(text).mapInArrow(run, "bucket int, count bigint")
            .groupBy("bucket").agg(F.sum("count").alias("count")).toPandas())
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["count"].to_numpy()
    return out


def ordered_sets(df: DataFrame, key: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(key, n, d1, d2, head, scan) of each document: the size of its set, a 128-bit digest of it, its
    first n - ceil(t n) + 2 elements in order of rarity, and the list entries these would scan."""
    counts = bucket_counts(df, text, k)
    shared = df.sparkSession.sparkContext.broadcast(counts)
    noise = int(counts.sum() >> SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                hashes, n = shingle_sets(data, offsets, k)
                owner = np.repeat(np.arange(last - first), n)
                begin = np.cumsum(n) - n
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)))])
                        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                d1, d2 = ((s[begin + n] - s[begin]).view(np.int64) for s in sums)
                held = rarity[bucket_of(hashes)]
                order = np.lexsort((hashes, held, owner))
                want = np.minimum(n, n - -(-num * n // den) + 2)
                rank = np.arange(len(hashes)) - np.repeat(begin, n)
                chosen = order[rank < np.repeat(want, n)]
                scan = np.bincount(owner[chosen], weights=np.maximum(held[chosen] - noise, 1), minlength=last - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2),
                     lists(hashes[chosen].view(np.int64), want, pa.int64()), pa.array(scan.astype(np.int64))],
                    ["key", "n", "d1", "d2", "head", "scan"])

    schema = f"key {df.schema[key].dataType.simpleString()}, n bigint, d1 bigint, d2 bigint, head array<bigint>, scan bigint"
    return cut_lineage(df.select(key, text).mapInArrow(run, schema))


def boundary(sets: DataFrame, num: int, den: int) -> int:
    """The largest size of light sets: enumerating pairs of first elements up to it and scanning
    lists beyond it costs least. Sizes are counted in steps of a tenth, so few rows come back."""
    step = F.floor(F.log("n") / F.log(F.lit(1.1)))
    q = F.least("n", F.col("n") - F.ceil(F.lit(num) * F.col("n") / den) + 2)
    rows = (sets.groupBy(step.alias("step"))
            .agg(F.max("n").alias("n"), F.sum(q * (q - 1) / 2).alias("pairs"), F.sum(F.col("scan") + q).alias("scan"))
            .orderBy("n").collect())
    best, chosen = None, 1
    for x in [1, *(r.n for r in rows)]:
        cost = sum(r.pairs for r in rows if r.n <= x) + sum(r.scan for r in rows if den * r.n >= num * x)
        if best is None or cost < best:
            best, chosen = cost, x
    return chosen


def postings(sets: DataFrame, light: int, num: int, den: int) -> DataFrame:
    """(key, node, n, place of the last element): subsets of two elements from light sets, single ones from sets that
    are heavy or can reach a heavy one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                node, n, head = (batch.column(i).slice(at, 2048) for i in range(3))
                node, n = np.array(node, np.int64), np.array(n, np.int64)
                size = np.array(head.value_lengths(), np.int64)
                items = np.array(head.flatten(), np.int64).view(np.uint64)
                begin = np.cumsum(size) - size
                keys, owners, places = [], [], []
                for q in np.unique(size[(n > 1) & (n <= light)]):
                    own = np.flatnonzero((size == q) & (n > 1) & (n <= light))
                    i, j = np.triu_indices(q, 1)
                    table = items[begin[own][:, None] + np.arange(q)]
                    keys.append(mix(mix(table[:, i] + np.uint64(1)) + table[:, j]).ravel())
                    owners.append(np.repeat(own, len(i)))
                    places.append(np.tile(j, len(own)))
                single = np.flatnonzero(den * n >= num * light + (light == 1))
                count = np.maximum(size[single] - (n[single] > 1), 0)
                owner = np.repeat(single, count)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                keys.append(mix(items[begin[owner] + place] + np.uint64(2)))
                owners.append(owner)
                places.append(place)
                owner = np.concatenate(owners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(node[owner]), pa.array(n[owner]),
                     pa.array(np.concatenate(places), pa.int64())], ["key", "node", "n", "place"])

    return sets.select("node", "n", "head").mapInArrow(run, "key bigint, node bigint, n bigint, place bigint")


def whole_sets(df: DataFrame, key: str, text: str, k: int, nodes: DataFrame) -> DataFrame:
    """(node, items): the shingle sets of the texts whose key is among the nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                hashes, n = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first),
                                                  lists(hashes.view(np.int64), n, pa.int64())], ["node", "items"])

    asked = df.select(F.col(key).cast("long").alias("node"), text).join(within_broadcast(nodes), "node", "left_semi")
    return asked.mapInArrow(run, "node bigint, items array<bigint>")


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4,
                      num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key reachable by links of
    Jaccard similarity num/den or more, its own included), set_id (equal sets share it)."""
    sets = ordered_sets(df.select(key, text), key, text, k, num, den)
    nodes = cut_lineage(sets.filter("n > 0 and key is not null").groupBy("d1", "d2")
                        .agg(F.min(F.col("key").cast("long")).alias("node"), F.first("n").alias("n"),
                             F.first("head").alias("head"), F.first("scan").alias("scan")))
    rows = cut_lineage(sets.select("key", "n", "d1", "d2"))
    discard(sets)
    light = boundary(nodes, num, den)
    members = members_of_shared_keys(lambda: postings(nodes, light, num, den))
    linked = link(members, lambda some: whole_sets(df, key, text, k, some), num, den,
                  single_from=-(-num * light // den) if light > 1 else 1)
    named = nodes.select("d1", "d2", "node").join(linked, "node", "left") \
        .select("d1", "d2", F.coalesce("component", "node").alias("component_id"))
    discard(members)
    return (rows.join(named, ["d1", "d2"], "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                    F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("key").cast("long")).alias("component_id"),
                    F.struct("d1", "d2").alias("set_id")))
