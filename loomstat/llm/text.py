"""Texts of Arrow batches as numpy arrays: bounded slices, word spans, 64-bit span hashes.

A slice holds whole texts and about ``SLICE`` bytes; only a text longer than that makes a larger
one. A null counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
_MUL = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# words of the shingle operators: everything but white space
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
# words of decontamination: digits, letters, bytes above ASCII (after lower-casing)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        up = np.full(size, _MUL, np.uint64)
        down = np.full(size, pow(_MUL, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        grown = (np.cumprod(up), np.cumprod(down))
        if n > SLICE + 1:
            return grown                       # for one very long text only
        _powers = grown
    return _powers


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers of the base: the hash of any span is a difference."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_hashes(data)
    down = powers(len(data) + 1)[1]
    return mix((sums[ends] - sums[starts]) * down[starts])


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, width = pa.large_binary(), np.int64
    else:
        kind, width = pa.binary(), np.int32
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, width)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts; offsets start at 0."""
    limit = limit or SLICE
    data, offsets = binary(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(starts, ends, text number) of all runs of word bytes; none crosses two texts."""
    m = is_word[data]
    first, last = m.copy(), m.copy()
    if len(m):
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = m[heads]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[tails] = m[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets[1:], starts, "right")


def shingles(word_hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int):
    """(hash, text number) of every run of k words; a text of 1 to k-1 words gives one hash of
    all its words."""
    out = np.zeros(max(0, len(doc) - k + 1), np.uint64)
    if len(out):
        for j in range(k):
            out += mix(word_hashes[j:len(doc) - k + 1 + j] + np.uint64(j + 1))
        whole = doc[:len(out)] == doc[k - 1:]
        out, owner = mix(out[whole]), doc[:len(whole)][whole]
    else:
        owner = doc[:0]
    counts = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] += mix(word_hashes[begin[short][has] + j] + np.uint64(j + 1))
        extra = mix(extra + counts[short].astype(np.uint64))
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
    return out, owner


def distinct_by_owner(values: np.ndarray, owner: np.ndarray, n: int):
    """(values, counts per owner): each owner's distinct values, ascending, owners in order."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.bincount(owner, minlength=n)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
