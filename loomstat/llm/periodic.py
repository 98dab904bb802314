"""Runs of words that repeat with a period, by block convolution.

A run is a maximal stretch of words in which words ``period`` apart are equal, at least twice as
long as its smallest period and at least ``least`` words. Periods are searched in dyadic ranges
[Q, 2Q). A run of such a period holds an aligned block of about Q / 2 words together with its copy one
period later, so for every block the places in the window that follows where it occurs again are
wanted: the sum of squared differences of word numbers there is zero. Sums for all places of a window
are one correlation, computed by a number-theoretic transform, exact modulo a prime; whole batches of
blocks are transformed at once. Each place gives a distance, which is extended in both directions as
far as words agree; residues of zero that are no matches fall out there, as extension compares words.

Two exact filters stand before the transform: a block of which some word does not occur again at a
distance in the range has no copy there, and a block that lies with its whole window in a known run
of a period not longer than the block only repeats that run.

Null and empty texts have no words and no runs. Documents are independent of each other: null keys,
copies and ties need no care. Texts may be of any length up to 2^26 words; the work is n log^2 n. Columns of the input named
like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .text import NOT_SPACE, mix, powers, slices, words

PRIME, ROOT = 2013265921, 31        # 15 * 2^27 + 1 and a generator: products fit 64 bits
AT_ONCE = 1 << 20                   # elements transformed at once


# ---- the transform --------------------------------------------------------------------

_twiddles: dict[tuple[int, bool], list[np.ndarray]] = {}


def _levels(n: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the roots of unity for each level of a transform of length n."""
    found = _twiddles.get((n, inverse))
    if found is None:
        found, half = [], n // 2
        while half:
            root = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
            step = pow(root, -1, PRIME) if inverse else root
            table = np.ones(half, np.uint64)
            done = 1
            while done < half:                          # doubles the part that is filled
                more = min(done, half - done)
                table[done:done + more] = table[:more] * np.uint64(pow(step, done, PRIME)) % np.uint64(PRIME)
                done += more
            found.append(table)
            half //= 2
        _twiddles[(n, inverse)] = found
    return found


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    p = np.uint64(PRIME)
    a = rows
    count, n = a.shape
    for table in _levels(n, False):
        half = len(table)
        a = a.reshape(count, -1, 2, half)
        low, high = a[:, :, 0], a[:, :, 1]
        a = np.stack([(low + high) % p, (low + p - high) * table % p], axis=2)
    return a.reshape(count, n)


def transform_back(rows: np.ndarray) -> np.ndarray:
    """The inverse: from bit-reversed order to the natural one."""
    p = np.uint64(PRIME)
    a = rows
    count, n = a.shape
    for table in reversed(_levels(n, True)):
        half = len(table)
        a = a.reshape(count, -1, 2, half)
        low, high = a[:, :, 0], a[:, :, 1] * table % p
        a = np.stack([(low + high) % p, (low + p - high) % p], axis=2)
    return a.reshape(count, n) * np.uint64(pow(n, -1, PRIME)) % p


def zero_mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(block, place) where the squared differences between a block and the window's stretch that
    begins at the place add up to zero modulo the prime. Values are below the prime."""
    count, size = blocks.shape
    places = windows.shape[1] - size + 1
    n = 1 << (windows.shape[1] - 1).bit_length()
    p = np.uint64(PRIME)
    a, b = np.zeros((count, n), np.uint64), np.zeros((count, n), np.uint64)
    a[:, :windows.shape[1]] = windows
    b[:, 0] = blocks[:, 0]                              # the block turned round
    b[:, n - size + 1:] = blocks[:, :0:-1]
    product = transform_back(transform(a) * transform(b) % p)[:, :places]
    squares = np.zeros((count, windows.shape[1] + 1), np.uint64)
    np.cumsum(windows.astype(np.uint64) ** np.uint64(2) % p, axis=1, out=squares[:, 1:])
    own = (blocks.astype(np.uint64) ** np.uint64(2) % p).sum(axis=1)
    total = squares[:, size:size + places] - squares[:, :places] + own[:, None]
    return np.argwhere(total % p == 2 * product % p)


# ---- runs in many documents at once ---------------------------------------------------

class Words:
    """The words of several documents, one after another, as numbers. No comparison crosses two."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        n = len(ids)
        self.ids, self.doc, self.begins, self.ends, self.n = ids, doc, begins, ends, n
        value = mix(ids.astype(np.uint64) + np.uint64(1))
        up, self.down = powers(n + 1)
        self.up = up
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * up[:n], out=self.sums[1:])
        self.first_of, self.end_of = (begins[doc], ends[doc]) if n else (doc, doc)
        # occurrences of each word, in order; the last one in the same document
        order = np.argsort(ids, kind="stable")
        self.places = ids[order].astype(np.int64) * (n + 1) + order
        last = np.ones(n, bool)
        if n:
            last[:-1] = (ids[order][1:] != ids[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        ends_at = np.flatnonzero(last)
        self.last_of = np.empty(n, np.int64)
        self.last_of[order] = order[np.repeat(ends_at, np.diff(ends_at, prepend=-1))]

    def again(self, at: np.ndarray, least: int, most: int) -> np.ndarray:
        """Whether the word at each place occurs again at a distance in [least, most)."""
        base = self.ids[at].astype(np.int64) * (self.n + 1) + at
        found = np.searchsorted(self.places, base + least)
        out = np.zeros(len(at), bool)
        ok = found < len(self.places)
        out[ok] = self.places[found[ok]] < np.minimum(base[ok] + most, (self.ids[at[ok]].astype(np.int64) + 1) * (self.n + 1))
        return out

    def agree(self, i: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of a size at i and q places later have the same hash."""
        a = self.sums[i + size] - self.sums[i]
        b = self.sums[i + q + size] - self.sums[i + q]
        return a * self.up[q] == b

    def extend(self, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) of the stretch around i in which words q apart are equal, by bisection."""
        low, high = np.zeros(len(i), np.int64), self.end_of[i] - i - q
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.agree(i, q, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        back, high = np.zeros(len(i), np.int64), i - self.first_of[i]
        while (back < high).any():
            middle = (back + high + 1) // 2
            same = self.agree(i - middle, q, middle)
            back, high = np.where(same, middle, back), np.where(same, high, middle - 1)
        return i - back, i + low + q

    def checked(self, s: int, e: int, q: int) -> tuple[int, int]:
        """The same stretch by comparing words; hashes only led there."""
        ids, doc = self.ids, self.doc
        differ = np.flatnonzero(ids[s:e - q] != ids[s + q:e])
        if len(differ):
            s, e = s, s + int(differ[0]) + q
        while s > self.begins[doc[s]] and ids[s - 1] == ids[s - 1 + q]:
            s -= 1
        while e < self.ends[doc[s]] and ids[e] == ids[e - q]:
            e += 1
        return s, e


def _scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least period, bound, block): a run holds an aligned block and its copy a period later."""
    yield 1, 4, 4           # runs of these have 12 words at least: 12 - q - 4 + 1 >= 4
    q = 4
    while 2 * q <= longest:
        yield q, 2 * q, q // 2
        q *= 2


def find(w: Words, least: int = 12) -> np.ndarray:
    """(start, end, period) of every run, places counted over all documents, ordered by start."""
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    cover_end, cover_period = np.zeros(w.n, np.int64), np.ones(w.n, np.int64)
    if not w.n:
        return np.zeros((0, 3), np.int64)
    longest = int((w.ends - w.begins).max())
    value = w.ids.astype(np.int64) % PRIME
    for q_low, q_high, size in _scales(longest):
        size = min(size, max(1, (least - 3) // 2)) if q_low == 1 else size
        block = np.arange(0, w.n - size + 1, size)
        block = block[(w.doc[block] == w.doc[block + size - 1]) & (block + q_low + size <= w.end_of[block])]
        far = np.zeros(w.n + 1, np.int64)
        np.cumsum(w.last_of - np.arange(w.n) >= q_low, out=far[1:])
        block = block[far[block + size] - far[block] == size]
        # the rest of a window that lies in a run of a short period is that run again
        whole = np.minimum(block + q_high - 1 + size, w.end_of[block])
        block = block[(cover_end[block] < whole) | (cover_period[block] > size)]
        for at in sorted(range(size), key=lambda o: (o % 4, o))[:16]:
            if not len(block):
                break
            block = block[w.again(block + at, q_low, q_high)]
        if not len(block):
            continue
        width = q_high - q_low + size - 1
        step = max(1, AT_ONCE // (1 << (width - 1).bit_length()))
        hits = []
        for at in range(0, len(block), step):
            part = block[at:at + step]
            inside = part[:, None] + q_low + np.arange(width)[None, :]
            windows = np.where(inside < w.end_of[part][:, None], value[np.minimum(inside, w.n - 1)], PRIME - 1)
            pairs = zero_mismatch(value[part[:, None] + np.arange(size)[None, :]], windows)
            i, q = part[pairs[:, 0]], pairs[:, 1] + q_low
            ok = i + q + size <= w.end_of[i]
            i, q = i[ok], q[ok]
            new = (cover_end[i] < i + q + size) | (q % cover_period[i] != 0)
            i, q = i[new], q[new]
            same = w.agree(i, q, np.full(len(i), size))
            hits.append(np.column_stack([i[same], q[same]]))
        seeds = np.concatenate(hits)
        if not len(seeds):
            continue
        s, e = w.extend(seeds[:, 0], seeds[:, 1])
        runs = np.column_stack([s, e, seeds[:, 1]])
        runs = np.unique(runs[e - s >= np.maximum(least, 2 * seeds[:, 1])], axis=0)
        fresh = []
        for s, e, q in runs[np.lexsort((runs[:, 0], runs[:, 2]))].tolist():
            s, e = w.checked(s, e, q)
            if e - s >= max(least, 2 * q) and (s, e) not in known:         # else a run of a divisor of q
                known.add((s, e))
                fresh.append((s, e, q))
        found += fresh
        for s, e, q in fresh:
            later = cover_end[s:e] < e
            cover_period[s:e][later] = q
            cover_end[s:e][later] = e
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words, and only those, get the same number."""
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    body = data[np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])]
    array = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    return np.asarray(array.dictionary_encode().indices).astype(np.int64)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n_docs: int) -> pa.Array:
    """The words of each document joined by one space."""
    size = ends - starts + 1
    lengths = np.bincount(doc, size, n_docs).astype(np.int64)
    bounds = np.cumsum(size) - size
    at = np.repeat(starts - bounds, size) + np.arange(int(size.sum()))
    body = data[np.minimum(at, len(data) - 1)] if len(data) else data
    space = bounds + size - 1
    body[space] = 32
    keep = np.ones(len(body), bool)
    last = np.flatnonzero(np.diff(doc, append=-1))
    keep[space[last]] = False                                               # none after a document's last word
    offsets = np.concatenate([[0], np.cumsum(lengths - (lengths > 0))]).astype(np.int64)
    made = pa.Array.from_buffers(pa.large_binary(), n_docs, [None, pa.py_buffer(offsets), pa.py_buffer(body[keep])])
    return made.cast(pa.binary()).cast(pa.string(), safe=False)


def find_runs(df: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """The columns of ``df`` with the text collapsed: words that repeat what stands one period before
    in some run are dropped and the rest joined by one space; then runs (array of start, length, period
    in words, by start, then period) and longest (that of greatest length, ties to the smallest start,
    then period; null without runs)."""
    if least < 11:
        raise ValueError("runs of fewer than 11 words are not searched for")
    kept = [c for c in df.columns if c not in (text, "runs", "longest")]
    names = {c: f"kept{i}" for i, c in enumerate(kept)}
    run = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])
    schema = StructType([StructField(names[c], df.schema[c].dataType) for c in kept]
                        + [StructField("text", StringType()), StructField("runs", ArrayType(run, False)), StructField("longest", run)])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(len(kept))):
                n_docs = last - first
                starts, ends, doc = words(data, offsets, NOT_SPACE)
                counts = np.bincount(doc, minlength=n_docs)
                stop = np.cumsum(counts)
                runs = find(Words(_numbers(data, starts, ends), doc, stop - counts, stop), least)
                owner = doc[runs[:, 0]]
                copies = np.zeros(len(doc) + 1, np.int64)
                np.add.at(copies, runs[:, 0] + runs[:, 2], 1)
                np.add.at(copies, runs[:, 1], -1)
                stay = np.cumsum(copies[:-1]) == 0
                start, length, period = runs[:, 0] - (stop - counts)[owner], runs[:, 1] - runs[:, 0], runs[:, 2]
                listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)],
                                                    fields=[pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
                per = np.bincount(owner, minlength=n_docs)
                bounds = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                order = np.lexsort((period, start, -length, owner))
                best = pa.array(order[np.minimum(bounds[:-1], max(0, len(order) - 1))] if len(order) else np.zeros(n_docs, np.int64),
                                mask=per == 0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, n_docs) for i in range(len(kept))),
                     _joined(data, starts[stay], ends[stay], doc[stay], n_docs),
                     pa.ListArray.from_arrays(pa.array(bounds), listed), listed.take(best)], schema.names)

    found = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text}`").alias("text")).mapInArrow(go, schema)
    return found.select(*[F.col("text").alias(c) if c == text else F.col(names[c]).alias(c)
                          for c in df.columns if c not in ("runs", "longest")], "runs", "longest")


def with_periodic_tails(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts in which one document in ten, chosen by the CRC-32 of its key in decimal, ends with its
    own words repeated with some period: cases to search for. Texts without words and rows without a key stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    w = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda s: s != "")
    n = F.size("__w").cast("long")
    g = F.floor(h / 10).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    place = F.sequence(F.lit(0).cast("long"), n - 1)
    tail = F.array_join(F.transform(place, lambda i: F.get("__w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")
    chosen = h % 10 == 0
    return df.withColumn("__w", F.when(chosen, w)).withColumn(
        text, F.when(chosen & (F.size("__w") > 0), tail).otherwise(F.col(text))).drop("__w")
