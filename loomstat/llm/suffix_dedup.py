"""Removal of bytes covered by strings of a minimum length that start in more than one place.

Which strings repeat is read off a Burrows-Wheeler transform: breadth-first backward extension of
intervals, shortest first, finds the common prefixes of neighbouring suffixes by increasing value,
and stops at the minimum length. What is then still open has a common prefix of that length.

To spread the work, every string of the minimum length is given to one anchor in it: the GRAM bytes
whose hash is the least (leftmost of equals), which equal strings share at the same place. Strings
with the same anchor in a row make one stretch of text. Stretches whose anchor stands only once in
all texts hold no repeat and go no further. Equal stretches count as one with a multiplicity, and
all stretches of an anchor, which may repeat each other, meet in one transform, unless each of them
stands twice or more, so that all its strings repeat. An anchor with more
than HOT different stretches (a passage with that many different neighbours) does not: its strings
are counted by their hashes, spread over all tasks, which decides the same question.

Defined cases: null text is empty; texts shorter than the minimum keep all bytes; matches never
cross texts; repeated rows are copies of each other. A row is known by a hash of key and text, so
null and repeated keys are no matter. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, discard
from .linking import BROADCAST_IDS
from .text import mix, powers, prefix_hashes, slices

GRAM = 64
HOT = 4096
CHUNK = 1 << 21
PLACE = np.uint64(0xFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    rows = -(-len(x) // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[:len(x)] = x
    grid = padded.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:len(x) - width + 1], left[width - 1:len(x)])


def stretches(data: np.ndarray, offsets: np.ndarray, size: int):
    """(anchor, digest, text number, start, count): runs of strings of ``size`` bytes that share an anchor;
    start is that of the first of count strings, in its text."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none, none
    sums, down = prefix_hashes(data), powers(len(data) + 1)[1]
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[:len(sums) - GRAM])
    least = sliding_min((gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64), size - GRAM + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    whole = np.arange(len(least)) + size <= offsets[owner + 1]
    begin = np.flatnonzero(whole)
    place = (least[begin] & PLACE).astype(np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(begin)))
    start = begin[head]
    digest = mix((sums[start + count + size - 1] - sums[start]) * down[start] + count.astype(np.uint64))
    return (gram[place[head]].view(np.int64), digest.view(np.int64), owner[start], start - offsets[owner[start]], count)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of the text in order of their first ``depth`` values (below 512), by doubling."""
    codes = text.astype(np.int64)
    key = np.zeros(len(codes), np.int64)
    for j in range(7):
        key = (key << 9) | np.roll(codes, -j)
    done = 7
    while True:
        order = np.argsort(key)
        key = key[order]
        step = np.zeros(len(order), np.int64)
        step[1:] = key[1:] != key[:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(step)
        if done >= depth or rank[order[-1]] == len(order) - 1:
            return order
        key = rank * len(order) + np.roll(rank, -done)
        done *= 2


def repeat_classes(text: np.ndarray, size: int) -> np.ndarray:
    """For every position the class of the string of ``size`` values (cyclic) that starts there."""
    n = len(text)
    order = suffix_order(text, size)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    front, bwt = text[order].astype(np.int64), text[order - 1].astype(np.int64)
    back = rank[order - 1]                              # where a suffix goes when extended to the left
    common = np.full(n + 1, -1, np.int32)               # of a suffix and the one before it, once known
    common[0] = common[n] = 0
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for length in range(size):
        width = high - low + 1
        one = width == 1
        new_low, new_high = [back[low[one]]], [back[low[one]]]
        low, width = low[~one], width[~one]
        if len(low):
            first = np.cumsum(width) - width
            at = np.arange(int(width.sum())) + np.repeat(low - first, width)
            chars, target = bwt[at], back[at]
            same = np.minimum.reduceat(chars, first) == np.maximum.reduceat(chars, first)
            new_low.append(np.minimum.reduceat(target, first)[same])
            new_high.append(np.maximum.reduceat(target, first)[same])
            mixed = np.repeat(~same, width)
            if mixed.any():                             # one new interval for each value in front
                owner, target = np.repeat(np.arange(len(low)), width)[mixed], target[mixed]
                if len(target) > n // 16:               # in order of target by its place, else by sorting
                    held = np.full(n, -1, np.int64)
                    held[target] = owner
                    target = np.flatnonzero(held >= 0)
                    group = held[target] * 512 + front[target]
                else:
                    target = np.sort(target * len(low) + owner)
                    target, group = target // len(low), target % len(low)
                    group = group * 512 + front[target]
                heads = np.flatnonzero(np.diff(group, prepend=-1))
                new_low.append(target[heads])
                new_high.append(target[np.append(heads[1:], len(target)) - 1])
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        open_ = common[high + 1] < 0
        low, high = low[open_], high[open_]
        common[high + 1] = length
        if not len(low):
            break
    return np.cumsum(common[:n] >= 0)[rank]


def repeated_starts(bodies: list[bytes], copies: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
    """For each stretch (given with its multiplicity) the runs [from, to) of starts of strings that
    start elsewhere too, in this stretch or another."""
    lengths = np.array([len(b) for b in bodies])
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.uint16) + 1
    base = np.cumsum(lengths + 1) - lengths - 1
    text[base + lengths] = 0
    classes = repeat_classes(text, size)
    count = lengths - size + 1
    owner = np.repeat(np.arange(len(bodies)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    found = classes[base[owner] + place]
    again = np.bincount(found, weights=copies[owner])[found] >= 2
    return runs(again, np.cumsum(count) - count, count)


def runs(flags: np.ndarray, begin: np.ndarray, count: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs of set flags within each part of the flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    inner = np.zeros(len(edge), bool)
    inner[begin] = True
    first = np.flatnonzero((edge > 0) | (inner & np.append(flags, False)))
    first = first[first < len(flags)]
    stop = np.flatnonzero((edge < 0) | (inner & np.concatenate([[False], flags])))
    if len(flags) and flags[-1] and (not len(stop) or stop[-1] != len(flags)):
        stop = np.append(stop, len(flags))
    part = np.searchsorted(begin, first, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in begin]
    for p, a, b in zip(part.tolist(), first.tolist(), stop.tolist()):
        out[p].append((a - int(begin[p]), b - int(begin[p])))
    return out


def all_stretches(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, digest, doc, start, count) of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                anchor, digest, owner, start, count = stretches(data, offsets, size)
                doc = np.asarray(batch.column(0).slice(first, last - first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(digest), pa.array(doc[owner]), pa.array(start), pa.array(count)],
                    ["anchor", "digest", "doc", "start", "count"])

    return docs.select("doc", "text").mapInArrow(
        run, "anchor bigint, digest bigint, doc bigint, start bigint, count bigint")


def bounded(table: DataFrame, lists_: str) -> DataFrame:
    """To be broadcast by a join if its lists have at most ``BROADCAST_IDS`` entries in all."""
    entries = table.agg(F.sum(F.size(lists_))).first()[0] or 0
    return F.broadcast(table) if entries <= BROADCAST_IDS else table


def bodies(docs: DataFrame, kinds: DataFrame, size: int) -> DataFrame:
    """(anchor, digest, copies, body): the bytes of each different stretch (anchor, digest, copies, and where one of
    them stands: doc, start, count)."""
    asked = kinds.groupBy("doc").agg(F.collect_list(F.struct("start", "count", "anchor", "digest", "copies")).alias("asked"))
    asked = cut_lineage(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "copies"]
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column(0)[i].as_py() or "").encode("utf-8", "surrogatepass")
                rows = batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[c] for r in rows], pa.int64()) for c in names),
                     pa.array([raw[r["start"]:r["start"] + r["count"] + size - 1] for r in rows], pa.binary())], [*names, "body"])

    # repeated rows give their stretches again; readers take each once
    return docs.join(bounded(asked, "asked"), "doc").select("text", "asked").mapInArrow(run, "anchor bigint, digest bigint, copies bigint, body binary")


def transformed(found: DataFrame, size: int, chunk: int | None = None) -> DataFrame:
    """(anchor, digest, runs): the transform over whole anchors, several in each."""
    limit = chunk or CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, last = [], 0, None

        def flush():
            runs_ = repeated_starts([h[3] for h in held], np.array([h[2] for h in held]), size)
            return pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
                 pa.array([[{"from": a, "to": b} for a, b in r] for r in runs_], kind)], ["anchor", "digest", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and row[:2] == held[-1][:2]:
                    continue
                if total >= limit and row[0] != last:
                    yield flush()
                    held, total = [], 0
                held.append(row)
                total += len(row[3])
                last = row[0]
        if held:
            yield flush()

    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    return (found.select("anchor", "digest", "copies", "body").repartition("anchor").sortWithinPartitions("anchor", "digest")
            .mapInArrow(run, "anchor bigint, digest bigint, runs array<struct<from:bigint,to:bigint>>"))


def counted(found: DataFrame, size: int) -> DataFrame:
    """(anchor, digest, runs) of hot anchors: their strings are counted one by one, by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = np.frombuffer(row[3], np.uint8)
                sums, down = prefix_hashes(data), powers(len(data) + 1)[1]
                value = mix((sums[size:] - sums[:-size]) * down[:len(data) - size + 1]).view(np.int64)
                same = [pa.array(np.full(len(value), x)) for x in row[:3]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(value), pa.array(np.arange(len(value)))],
                                                 ["anchor", "digest", "copies", "string", "place"])

    each = cut_lineage(found.select("anchor", "digest", "copies", "body").mapInArrow(
        run, "anchor bigint, digest bigint, copies bigint, string bigint, place bigint"))
    again = each.groupBy("anchor", "string").agg(F.sum("copies").alias("total")).filter("total > 1")
    places = each.join(again, ["anchor", "string"]).groupBy("anchor", "digest").agg(F.array_sort(F.collect_list("place")).alias("p"))
    return places.select("anchor", "digest", F.transform("p", lambda x: F.struct(x.alias("from"), (x + 1).alias("to"))).alias("runs"))


def repeated_spans(docs: DataFrame, size: int = 400, hot: int | None = None) -> DataFrame:
    """(doc, spans): what strings of ``size`` bytes that start elsewhere too cover in texts (doc, text), as
    ascending spans that do not touch."""
    found = all_stretches(docs, size)
    shared = found.groupBy("anchor").agg(F.count("*").alias("held")).filter("held > 1").select("anchor")
    placed = cut_lineage(found.join(shared, "anchor"))
    # columns of fixed width are kept in a hash map; all rows of a kind have the same bytes, so any of them will do
    kinds = cut_lineage(placed.groupBy("anchor", "digest").agg(
        F.first("doc").alias("doc"), F.first("start").alias("start"), F.first("count").alias("count"), F.count("*").alias("copies")))
    # strings of a stretch that stands twice repeat; an anchor of which each stretch does has nothing left to decide
    open_ = cut_lineage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least"))
                        .filter("least = 1").select("anchor", "kinds"))
    many = cut_lineage(open_.filter(F.col("kinds") > (hot or HOT)).select("anchor"))
    held = cut_lineage(bodies(docs, kinds.join(open_, "anchor", "left_semi"), size))
    starts = kinds.join(open_, "anchor", "left_anti").select(
        "anchor", "digest", F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("count").alias("to"))).alias("runs"))
    starts = starts.unionByName(transformed(held.join(many, "anchor", "left_anti"), size))
    if many.limit(1).count():
        starts = starts.unionByName(counted(held.join(many, "anchor").dropDuplicates(["anchor", "digest"]), size))
    starts = cut_lineage(starts.filter(F.size("runs") > 0))
    discard(kinds, held, open_)
    spans = (placed.join(starts, ["anchor", "digest"])
             .select("doc", "start", F.explode("runs").alias("r"))
             .select("doc", (F.col("start") + F.col("r.from")).alias("from"), (F.col("start") + F.col("r.to") + (size - 1)).alias("to")))
    out = cut_lineage(joined(spans).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans")))
    discard(placed, starts, many)
    return out


def joined(spans: DataFrame) -> DataFrame:
    """Spans (doc, from, to) that overlap or touch made one."""
    in_order = Window.partitionBy("doc").orderBy("from", "to")
    before = F.max("to").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return (spans.withColumn("opens", F.when(F.col("from") <= before, 0).otherwise(1)).withColumn("island", island)
            .groupBy("doc", "island").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("island"))


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 400) -> DataFrame:
    """One row per document: key, n_bytes, spans (removed runs, as structs of from and to, joined where they
    touch), n_removed, kept (the remaining bytes)."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("doc", F.xxhash64("key", "text"))
    found = repeated_spans(docs.select("doc", "text"), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                merged, kept, sizes, gone = [], [], [], []
                for body, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = (body or "").encode("utf-8", "surrogatepass")
                    bounds = [0, *(x for s in spans or [] for x in (s["from"], s["to"])), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
                    merged.append(spans or [])
                    sizes.append(len(raw))
                    gone.append(len(raw) - len(kept[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(merged, kind), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "n_removed", "kept"])

    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    schema = (f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, "
              "n_removed bigint, kept binary")
    return docs.join(bounded(found, "spans"), "doc", "left").select("key", "text", "spans").mapInArrow(run, schema)
