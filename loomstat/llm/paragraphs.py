"""Substring dedup: repeated paragraphs found by MinHash banding.

A paragraph is a line of five words or more. A line of more than ``LONG`` words is also cut into pieces
where the text itself decides, before the word pair whose hash is the least among those of ``REACH``
words on either side. So a passage that is pasted into other text falls into the same pieces there, all
but those at its ends. Between two cuts stand more than ``REACH`` words; a shorter piece at an end of
the line is joined to its neighbour, which is a piece by itself too. Lines and pieces are treated alike.

Each paragraph has the set of its 5-word shingles. ``tune`` chooses the fewest hashes, as bands of
rows, that reach the wanted recall at the similarity; paragraphs that agree in a band are compared by
exact Jaccard similarity, and components of the links are classes. Lines are decided first: of the lines
of a class the one that ends first, by (key, position), stays and the later ones are removed. Then
the lines that are left and their pieces are: of a class the paragraph that ends first stays, and those
that begin where it ends or later are removed, but for paragraphs in which what stays of another class
would go with them. So what stays of a class is never removed through another, no passage leaves the
corpus as a whole, and a line and its own pieces never remove each other.

Equal paragraphs are one node, so copies are never paired; lists of a key are compared as in
``linking``. Defined cases: null texts have no paragraphs and stay null; lines of fewer than
five words always stay; rows with a null key are left as they are; rows that share a key and a text
have the same positions, and stay or go together. Columns other than key and text pass through;
columns named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage, discard, free_shuffles
from .linking import BROADCAST_IDS, link, within_broadcast
from .text import LOWER, NOT_SPACE, distinct_by_owner, lists, mix, powers, shingles, slices, span_hashes, words

REACH = 6
LONG = 2 * REACH
SHINGLE = 5


def tune(similarity: float, recall: float = 0.995, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the fewest hashes that meet the recall at the similarity; of equally many the
    one with more rows, whose candidates are fewer."""
    fit = [(b * r, -r, b, r) for r in range(1, most + 1) for b in range(1, most // r + 1)
           if 1 - (1 - similarity ** r) ** b >= recall]
    return min(fit)[2:]


class Paragraphs:
    """The paragraphs of a slice of texts: ``node`` (a hash of the words), ``owner`` (text number), ``start``
    and ``stop`` (bytes of the text), and the runs of ``shingles`` from ``low`` to before ``high``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, owner = words(data, offsets, NOT_SPACE)
        line = np.concatenate([[0], np.cumsum(data == 10)])[starts] + owner    # differs where text or line differs
        size = np.diff(np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(starts)))
        at = np.flatnonzero(np.repeat(size >= SHINGLE, size))       # the words of lines that can be removed
        size = size[size >= SHINGLE]
        hashes = span_hashes(LOWER[data], starts, ends)[at]
        line = np.repeat(np.arange(len(size)), size)
        self._words = hashes, line, len(size)
        first, last = self._spans(hashes, line, size)
        self.low = first - (SHINGLE - 1) * line[first]
        self.high = last - (SHINGLE - 1) * (line[first] + 1)
        up, down = powers(len(at) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:len(at)])])
        self.node = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)).view(np.int64)
        self.owner = owner[at][first]
        whole = np.cumsum(size)
        self.is_line = (first == (whole - size)[line[first]]) & (last == whole[line[first]])
        self.head = starts[at][(whole - size)[line[first]]] - offsets[self.owner]      # where its line begins
        self.start = starts[at][first] - offsets[self.owner]
        after = at[last - 1] + 1                                    # the next word, if it is of the same text
        inside = np.append(owner, -1)[after] == self.owner
        self.stop = np.where(inside, np.append(starts, 0)[after], offsets[self.owner + 1]) - offsets[self.owner]

    @cached_property
    def shingles(self) -> np.ndarray:
        return shingles(*self._words, SHINGLE)[0]

    @cached_property
    def _again(self) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, place) of each shingle that its paragraph has before, too."""
        order = np.argsort(self.shingles, kind="stable")
        again = self.shingles[order][1:] == self.shingles[order][:-1]
        before, at = order[:-1][again], order[1:][again]
        by_place = np.argsort(at)
        before, at = before[by_place], at[by_place]
        a, z = np.searchsorted(at, self.low), np.searchsorted(at, self.high)
        part = np.repeat(np.arange(len(a)), z - a)
        place = np.arange(len(part)) + (a - np.cumsum(z - a) + (z - a))[part]
        inside = before[place] >= self.low[part]
        return part[inside], at[place[inside]]

    def sizes(self) -> np.ndarray:
        """How many different shingles each paragraph has."""
        return self.high - self.low - np.bincount(self._again[0], minlength=len(self.low))

    def parities(self) -> np.ndarray:
        """For each paragraph 64 bits, which tell the buckets that hold an odd number of its different shingles."""
        if not len(self.low):
            return np.zeros(0, np.int64)
        bits = np.append(np.uint64(1) << (self.shingles >> np.uint64(58)), np.uint64(0))
        odd = np.bitwise_xor.reduceat(bits, np.column_stack([self.low, self.high]).ravel())[::2]
        part, place = self._again
        np.bitwise_xor.at(odd, part, bits[place])
        return odd.view(np.int64)

    @staticmethod
    def _spans(hashes: np.ndarray, line: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, word after the last) of each different paragraph, by place."""
        n = len(hashes)
        end = np.cumsum(size)
        begin = end - size
        if not n:
            return begin, end
        value = mix(hashes + mix(np.append(hashes[1:], np.uint64(0))))
        value[end - 1] = ~np.uint64(0)                              # the pair would leave the line
        cut = np.repeat(size > LONG, size)
        cut[end - 1] = cut[begin] = False
        for d in range(1, REACH + 1):
            same = line[d:] == line[:-d]
            cut[d:] &= ~same | (value[d:] < value[:-d])
            cut[:-d] &= ~same | (value[:-d] <= value[d:])
        cut[begin] = True
        head = np.flatnonzero(cut)
        tail = np.append(head[1:], n)
        short = tail - head < SHINGLE                               # only at the ends of a line that has other pieces
        front, back = np.flatnonzero(short & np.isin(head, begin)), np.flatnonzero(short & np.isin(tail, end))
        first = np.concatenate([begin, head[~short], head[front], head[back - 1]])
        last = np.concatenate([end, tail[~short], tail[front + 1], tail[back]])
        different = np.unique(first * (n + 1) + last)
        return different // (n + 1), different % (n + 1)


def _postings(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node, n, odd): a key for each band of each paragraph that differs from others of its slice, its
    different shingles being n, their parities odd."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                p = Paragraphs(data, offsets)
                keep = np.sort(np.unique(p.node, return_index=True)[1])     # by place, or reduceat would also run
                node = p.node[keep]                                         # from each paragraph to any later one
                bounds = np.column_stack([p.low[keep], p.high[keep]]).ravel()
                out = []
                for b in range(bands if len(node) else 0):
                    key = np.full(len(node), b + 1, np.uint64)
                    for r in range(rows):
                        # the shingles are scrambled already; an odd factor orders them anew by all their bits
                        factor = mix(np.array([b * rows + r + 77], np.uint64))[0] | np.uint64(1)
                        value = np.append(p.shingles * factor, ~np.uint64(0))
                        key = mix(key + np.minimum.reduceat(value, bounds)[::2])
                    out.append(key)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)),
                                                      pa.array(np.tile(node, bands)),
                                                      pa.array(np.tile(p.sizes()[keep], bands)),
                                                      pa.array(np.tile(p.parities()[keep], bands))], ["key", "node", "n", "odd"])

    return docs.select("text").mapInArrow(run, "key bigint, node bigint, n bigint, odd bigint")


def _members(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, n, odd, place) for keys that at least two nodes hold, but for keys of two nodes whose sizes rule
    a link out (a line and a piece of it). Postings are shuffled once: keys are counted, and their members
    read, where they lie."""
    dealt = postings.repartition("key")
    # with all columns of the postings, so that both sides of the join are one shuffle
    held = (dealt.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.min("n").alias("low"),
                                     F.max("n").alias("high"), F.count("*").alias("rows"), F.bit_or("odd").alias("odd"))
            .filter(f"x < y and odd is not null and (rows > 2 or {den} * low >= {num} * high)").select("key"))
    of_key = Window.partitionBy("key")
    return cut_lineage(
        dealt.join(held.hint("shuffle_hash"), "key").dropDuplicates(["key", "node"])
        .select("key", "node", "n", "odd", F.lit(0).cast("long").alias("place"), F.count("*").over(of_key).alias("holders"),
                F.min("n").over(of_key).alias("low"), F.max("n").over(of_key).alias("high"))
        .filter(f"holders > 2 or {den} * low >= {num} * high").drop("holders", "low", "high"))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items): the shingles of the paragraphs asked for. Few ids are broadcast; beyond, each is asked
    of one document that has it, so that no other sets are shuffled."""
    few = nodes.count() <= BROADCAST_IDS
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(nodes.toArrow()["node"].to_numpy())) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(0)):
                asked = shared.value if few else np.unique(np.array(batch.column(1).slice(first, last - first).flatten(), np.int64))
                if not len(asked):
                    continue
                p = Paragraphs(data, offsets)
                node, keep = np.unique(p.node, return_index=True)
                mine = asked[np.minimum(np.searchsorted(asked, node), len(asked) - 1)] == node
                node, keep = node[mine], keep[mine]
                low, count = p.low[keep], (p.high - p.low)[keep]
                part = np.repeat(np.arange(len(node)), count)
                place = np.arange(len(part)) + (low - np.cumsum(count) + count)[part]
                hashes, counts = distinct_by_owner(p.shingles[place], part, len(node))
                yield pa.RecordBatch.from_arrays([pa.array(node), lists(hashes.view(np.int64), counts, pa.int64())],
                                                 ["node", "items"])

    if few:
        read = docs.select("text")
    else:
        holder = _placed(docs).select("node", "doc").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc").alias("doc"))
        read = docs.join(holder.groupBy("doc").agg(F.collect_list("node").alias("asked")), "doc").select("text", "asked")
    return read.mapInArrow(run, "node bigint, items array<bigint>").dropDuplicates(["node"])


def _placed(docs: DataFrame) -> DataFrame:
    """(node, doc, start, stop, head, is_line) of every paragraph that can be removed; head is where its line begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                p = Paragraphs(data, offsets)
                doc = np.asarray(batch.column(0).slice(first, last - first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.node), pa.array(doc[p.owner], pa.int64()), pa.array(p.start, pa.int64()),
                     pa.array(p.stop, pa.int64()), pa.array(p.head, pa.int64()), pa.array(p.is_line)],
                    ["node", "doc", "start", "stop", "head", "is_line"])

    return docs.select("doc", "text").mapInArrow(run, "node bigint, doc bigint, start bigint, stop bigint, head bigint, is_line boolean")


def repeated_paragraphs(docs: DataFrame, num: int = 4, den: int = 5, recall: float = 0.995) -> DataFrame:
    """(doc, spans): for each document (doc, text) the paragraphs to remove, as structs of start and stop
    in bytes and of, the key of the document whose paragraph stays."""
    bands, rows = tune(num / den, recall)
    members = _members(_postings(docs, bands, rows), num, den)
    free_shuffles(docs.sparkSession)
    classes = link(members, lambda nodes: _sets(docs, nodes), num, den)
    discard(members)
    free_shuffles(docs.sparkSession)
    # paragraphs alone in their class stay: they neither repeat anything nor are repeated
    all_placed = cut_lineage(_placed(docs))
    placed = cut_lineage(_in_shared_classes(all_placed, classes))
    discard(all_placed)
    free_shuffles(docs.sparkSession)
    lines = _later(placed.filter("is_line"))
    left = placed.join(lines.select("doc", "head"), ["doc", "head"], "left_anti")
    gone = cut_lineage(_later(left))
    stays = cut_lineage(_first(left).select("first.*").distinct())
    # pieces of a line overlap where they begin or end at one place; a line overlaps all of its own
    inside = gone.join(stays.filter("not is_line").select("doc", "head"), ["doc", "head"], "left_semi").filter("is_line")
    around = gone.join(stays.filter("is_line").select("doc", "head"), ["doc", "head"], "left_semi")
    begins, ends = (gone.join(stays.select("doc", c), ["doc", c], "left_semi") for c in ("start", "stop"))
    place = ["doc", "start", "stop"]
    spared = inside.select(place).unionByName(around.select(place)).unionByName(begins.select(place)).unionByName(ends.select(place)).distinct()
    removed = lines.select(*place, "of").unionByName(gone.join(spared, place, "left_anti").select(*place, "of"))
    out = cut_lineage(removed.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "of"))).alias("spans")))
    discard(placed, gone, stays)
    return out


def _in_shared_classes(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """``placed`` with its class, without paragraphs that are alone in theirs."""
    named = placed.join(within_broadcast(classes), "node", "left") \
        .select(F.coalesce("component", "node").alias("class"), "doc", "start", "stop", "head", "is_line")
    place = F.struct("doc", "start", "stop")            # the same for repeated rows
    held = named.groupBy("class").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("class")
    return named.join(held, "class", "left_semi")


def _first(placed: DataFrame) -> DataFrame:
    """(class, first): the paragraph of each class of several that ends first."""
    place = F.struct("doc", "stop", "start", "head", "is_line")
    return (placed.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last"))
            .filter("first <> last").drop("last"))


def _later(placed: DataFrame) -> DataFrame:
    """``placed`` without what stays of each class and what overlaps it, with ``of``, the key of the
    document in which it stays."""
    return (placed.join(_first(placed), "class").filter("struct(doc, start) >= struct(first.doc, first.stop)")
            .select("doc", "start", "stop", "head", "is_line", F.col("first.doc").alias("of")))


def without_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` (with a column spans) with these bytes cut out of its texts, and n_bytes, n_removed."""
    kept = [c for c in df.columns if c not in ("spans", "n_bytes", "n_removed")]
    schema = StructType([df.schema[c] for c in kept] + [StructField(c, LongType()) for c in ("n_bytes", "n_removed")])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts, size, gone = [], [], []
                for body, spans in zip(part.column(at).to_pylist(), part.column(len(kept)).to_pylist()):
                    raw = (body or "").encode("utf-8", "surrogatepass")
                    rest, done = [], 0
                    for s in spans or []:
                        rest.append(raw[done:s["start"]])
                        done = max(done, s["stop"])
                    rest.append(raw[done:])
                    left = b"".join(rest)
                    texts.append(None if body is None else left.decode("utf-8", "replace"))
                    size.append(len(raw))
                    gone.append(len(raw) - len(left))
                columns = [part.column(j) for j in range(len(kept))]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(gone, pa.int64())],
                                                 [*kept, "n_bytes", "n_removed"])

    return df.select(*[f"`{c}`" for c in kept], "spans").mapInArrow(run, schema)


def dedup_paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text", num: int = 4, den: int = 5,
                     recall: float = 0.995) -> DataFrame:
    """The columns of ``df`` with repeated paragraphs cut out of its text, then n_bytes, n_removed (bytes) and
    repeats (keys of the documents whose paragraphs the removed ones repeat)."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")) \
        .filter("doc is not null and text is not null")
    gone = repeated_paragraphs(docs, num, den, recall)
    kept = [c for c in df.columns if c not in ("n_bytes", "n_removed", "repeats", "spans")]
    joined = (df.select(*[f"`{c}`" for c in kept]).alias("t")
              .join(gone.select("doc", "spans").alias("g"), F.col(f"t.`{key}`").cast("long") == F.col("g.doc"), "left")
              .select(*[F.col(f"t.`{c}`") for c in kept], F.array_sort(F.array_distinct("g.spans.of")).alias("repeats"), "g.spans"))
    return without_spans(joined, text).select(
        *[f"`{c}`" for c in kept], "n_bytes", "n_removed", F.coalesce("repeats", F.array().cast("array<bigint>")).alias("repeats"))
