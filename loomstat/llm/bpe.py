"""Byte-level BPE encoding and decoding.

Text is cut into pieces without a regular expression. Every code point has a class; a class is
a function on the ten states of a small automaton; composing functions is associative, so the
states of all positions come from one blocked scan over composed functions. Piece boundaries
follow from neighbouring states. Pieces are merged pair by pair, lowest rank first, through a
cache. The byte offset of every token's end is kept, and decoding lays bytes out by it.

Null text is the empty text, which has no tokens. Texts may have any length: slices hold whole
texts, and pieces of any length merge in n log n. Copies and ties need no care: rows are
independent. A column of the input named like an output column is replaced by it.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .text import SLICE, lists, slices

# states
START, LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, QUOTE_RV, QUOTE_L, CLOSED = range(10)
# classes of code points: letters that take part in 's 't 'm 'd 're 've 'll are told apart
(C_SPACE, C_WHITE, C_LETTER, C_STMD, C_RV, C_L, C_E, C_NUMBER, C_QUOTE, C_OTHER) = range(10)
# fixed values: code points with the White_Space property, but for the space
WHITE_SPACE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LONGEST_CACHED = 64


def _next(state: int, cls: int) -> int:
    if cls == C_SPACE:
        return SPACE
    if cls == C_WHITE:
        return WHITE
    if cls == C_NUMBER:
        return NUMBER
    if cls == C_OTHER:
        return OTHER
    if cls == C_QUOTE:      # a contraction can only begin where a piece begins
        return OTHER if state in (OTHER, SPACE, QUOTE) else QUOTE
    if state == QUOTE:
        return {C_STMD: CLOSED, C_RV: QUOTE_RV, C_L: QUOTE_L}.get(cls, LETTER)
    if (state, cls) in ((QUOTE_RV, C_E), (QUOTE_L, C_L)):
        return CLOSED
    return LETTER


# what a position's state and the one before it say about a boundary between them
NO, YES, UNLESS_CLOSED_NEXT, LAST_WHITE = range(4)


def _boundary(before: int, state: int) -> int:
    if state in (SPACE, WHITE):
        return LAST_WHITE if before in (SPACE, WHITE) else YES
    if before == SPACE:
        return NO
    if state == NUMBER:
        return NO if before == NUMBER else YES
    if state in (OTHER, QUOTE):
        return NO if before in (OTHER, QUOTE) else YES
    if state == CLOSED or before in (LETTER, QUOTE_RV, QUOTE_L):
        return NO
    if before == QUOTE and state in (QUOTE_RV, QUOTE_L):
        return UNLESS_CLOSED_NEXT
    return YES


class Automaton:
    """All compositions of the class functions: a finite monoid with its product table."""

    def __init__(self):
        steps = [tuple(_next(s, c) for s in range(10)) for c in range(10)]
        steps += [(f[START],) * 10 for f in steps]          # the first code point of a text
        found = {tuple(range(10)): 0}
        todo = list(found)
        while todo:
            f = todo.pop()
            for g in steps:
                h = tuple(g[s] for s in f)
                if h not in found:
                    found[h] = len(found)
                    todo.append(h)
        functions = list(found)
        self.step = np.array([found[f] for f in steps], np.uint16)
        self.apply = np.array(functions, np.uint8)
        self.size = len(functions)
        self.product = np.array([[found[tuple(g[s] for s in f)] for g in functions] for f in functions],
                                np.uint16).ravel()
        self.boundary = np.array([[_boundary(p, s) for s in range(10)] for p in range(10)], np.uint8)

    def prefixes(self, f: np.ndarray, block: int = 64) -> np.ndarray:
        """Composition of f[0..i] for every i: columns of blocks first, then whole blocks."""
        n = len(f)
        if n <= block:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.product[int(out[i - 1]) * self.size + int(f[i])]
            return out
        rows = -(-n // block)
        grid = np.zeros(rows * block, np.uint16)
        grid[:n] = f
        grid = grid.reshape(rows, block).T.copy()
        for j in range(1, block):
            grid[j] = self.product[grid[j - 1].astype(np.int32) * self.size + grid[j]]
        before = np.zeros(rows, np.int32)
        before[1:] = self.prefixes(grid[-1], block)[:-1]
        return self.product[before[None, :] * self.size + grid].T.ravel()[:n]

    def starts(self, classes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Positions at which pieces begin; heads are the first positions of texts."""
        f = self.step[classes]
        f[heads] = self.step[classes[heads] + 10]
        state = self.apply[self.prefixes(f), START]
        head = np.zeros(len(state) + 1, bool)
        head[heads] = True
        head[-1] = True
        kind = np.empty(len(state), np.uint8)
        kind[0] = YES
        kind[1:] = self.boundary[state[:-1], state[1:]]
        following = np.full(len(state), START, np.uint8)
        following[:-1] = np.where(head[1:-1], START, state[1:])
        white = (following == SPACE) | (following == WHITE) | (following == START)
        return np.flatnonzero(head[:-1] | (kind == YES)
                              | ((kind == UNLESS_CLOSED_NEXT) & (following != CLOSED))
                              | ((kind == LAST_WHITE) & ~white))


def code_point_classes() -> np.ndarray:
    """The class of every code point; letters and numbers as tiktoken's tables have them, which may
    belong to another Unicode version than Python's. This only builds the table, on the driver."""
    import tiktoken
    single = {bytes([i]): i for i in range(256)}
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, C_OTHER, np.uint8)
    for kind, cls in (("L", C_LETTER), ("N", C_NUMBER)):
        probe = tiktoken.Encoding(kind, pat_str=rf"\p{{{kind}}}", mergeable_ranks=single, special_tokens={})
        members = bytes(probe.encode_ordinary(points)).decode()
        out[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = cls
    out[WHITE_SPACE] = C_WHITE
    out[32] = C_SPACE
    out[ord("'")] = C_QUOTE
    for letters, cls in (("stmd", C_STMD), ("rv", C_RV), ("l", C_L), ("e", C_E)):
        out[[ord(x) for x in letters]] = cls
    return out


class Pairs:
    """(left id, right id) -> id of the joined token, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        self.count = max(ranks.values(), default=0) + 1
        for token, joined in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.count + right)
                    values.append(joined)
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, self.count, np.int64)
        todo, held = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = todo[free]                # of several keys at one slot the last stays
            done = self.keys[at] == todo
            self.values[at[done]] = held[done]
            todo, held, at = todo[~done], held[~done], (at[~done] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ids; ``count`` where the two do not join."""
        keys = left * self.count + right
        at = self._slot(keys)
        out = self.values[at]
        seen = self.keys[at]
        other = np.flatnonzero((seen != keys) & (seen != -1))
        out[seen != keys] = self.count
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            seen = self.keys[at[other]]
            out[other[seen == keys[other]]] = self.values[at[other[seen == keys[other]]]]
            other = other[(seen != keys[other]) & (seen != -1)]
        return out


class Encoder:
    """Pieces to ids by the given ranks. One per Python worker and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray, cached: int):
        self.ranks, self.classes, self.limit = ranks, classes, cached
        self.cache: dict[bytes, bytes] = {}         # ids as 32-bit numbers: a third of what tuples hold
        self.automaton, self.pairs = Automaton(), Pairs(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Join the neighbours of lowest rank (leftmost first) until no pair has a rank."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return (ranks[piece],)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))       # of the part that begins at i
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle < 0 or middle >= n or end[middle] != stop:
                continue                                                   # one of its parts has changed
            end[i], end[middle] = stop, -1
            if stop < n:
                left[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := left[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(ids)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The same for many short pieces at once, ids as 32-bit numbers: each round joins the best pair of every piece."""
        out = [b""] * len(pieces)
        name = np.arange(len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        none = self.pairs.count
        begin = np.cumsum(size) - size
        joined = np.full(len(ids), none)
        inner = np.ones(len(ids), bool)
        inner[begin + size - 1] = False
        at = np.flatnonzero(inner)
        joined[at] = self.pairs.get(ids[at], ids[at + 1])
        while len(name):
            best = np.minimum.reduceat((joined << 7) + (np.arange(len(ids)) - np.repeat(begin, size)), begin)
            ended = (best >> 7) == none
            if ended.any():
                raw = ids.astype(np.int32).tobytes()
                for i, a, n in zip(name[ended].tolist(), (4 * begin[ended]).tolist(), (4 * size[ended]).tolist()):
                    out[i] = raw[a:a + n]
                stay = np.repeat(~ended, size)
                ids, joined = ids[stay], joined[stay]
                name, size, best = name[~ended], size[~ended], best[~ended]
                begin = np.cumsum(size) - size
                if not len(name):
                    break
            at = begin + (best & 127)
            ids[at] = best >> 7
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, joined = ids[keep], joined[keep]
            at = at - np.arange(len(at))                    # one token went from each piece before it
            size = size - 1
            begin = np.cumsum(size) - size
            joined[at] = none
            right = at[at < begin + size - 1]
            joined[right] = self.pairs.get(ids[right], ids[right + 1])
            left = at[at > begin] - 1
            joined[left] = self.pairs.get(ids[left], ids[left + 1])
        return out

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which pieces begin."""
        if not len(data):
            return np.zeros(0, np.int64)
        text = data.tobytes().decode("utf-8", "surrogateescape")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1                 # a byte that is not UTF-8
        at = np.cumsum(width, dtype=np.int64) - width
        heads = np.searchsorted(at, np.unique(offsets[:-1][offsets[:-1] < offsets[1:]]))
        return at[self.automaton.starts(self.classes[points], heads)]

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, end offset of each token within its text, tokens per text)."""
        raw, cache = data.tobytes(), self.cache
        starts = self.pieces(data, offsets)
        bounds = [*starts.tolist(), len(raw)]
        pieces = list(map(raw.__getitem__, map(slice, bounds, bounds[1:])))
        merged = list(map(cache.get, pieces))
        if None in merged:
            new = {p for p, ids in zip(pieces, merged) if ids is None}
            short = [p for p in new if len(p) <= LONGEST_CACHED]
            if len(cache) + len(short) > self.limit:
                cache.clear()
                merged = [None] * len(pieces)
                new = set(pieces)
                short = [p for p in new if len(p) <= LONGEST_CACHED]
            cache.update(zip(short, self.merge_many(short)))
            long = {p: np.array(self.merge(p), np.int32).tobytes() for p in new if len(p) > LONGEST_CACHED}
            merged = [cache.get(p) or long[p] if ids is None else ids for p, ids in zip(pieces, merged)]
        counts = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        ids = np.frombuffer(b"".join(merged), np.int32)
        owner = np.searchsorted(offsets[1:], starts, "right")
        per_text = np.zeros(len(offsets) - 1, np.int64)
        np.add.at(per_text, owner, counts)
        ends = np.cumsum(self.sizes[ids], dtype=np.int64) - np.repeat(offsets[:-1], per_text)
        return ids, ends.astype(np.int32), per_text


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


_workers: dict[str, tuple[Encoder, Decoder | None]] = {}      # of this Python process, by call of encode()


def _keep(df: DataFrame, drop: set[str]) -> list[str]:
    return [c for c in df.columns if c not in drop]


class Decoder:
    """Ids to bytes by a table of all tokens, laid out by the end offset of each token."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = sorted((i, token) for token, i in ranks.items())
        self.sizes = np.zeros(by_id[-1][0] + 1, np.int64)
        self.sizes[[i for i, _ in by_id]] = [len(x) for _, x in by_id]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(x for _, x in by_id), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray, ends: np.ndarray | None = None) -> pa.BinaryArray:
        """One value per text; without end offsets the lengths of the tokens say where each goes."""
        size, last = self.sizes[ids], np.cumsum(counts)
        if ends is not None:
            totals = np.where(counts > 0, ends[np.maximum(last, 1) - 1] if len(ends) else 0, 0)
        else:
            sums = np.concatenate([[0], np.cumsum(size)])
            totals = sums[last] - sums[last - counts]
            ends = sums[1:] - np.repeat(sums[last - counts], counts)
        base = np.cumsum(totals) - totals
        # byte j of token t goes to its text's base + its end - its size + j
        target = np.repeat(np.repeat(base, counts) + ends - size - (np.cumsum(size) - size), size)
        source = np.repeat(self.begins[ids] - (np.cumsum(size) - size), size)
        step = np.arange(len(source))
        body = np.empty(int(totals.sum()), np.uint8)
        body[target + step] = self.table[source + step]
        bounds = np.concatenate([[0], np.cumsum(totals)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(totals), [None, pa.py_buffer(bounds), pa.py_buffer(body)])


def encode(df: DataFrame, ranks: dict[bytes, int], text: str = "text", cached: int = 300_000, decoded: str | None = None) -> DataFrame:
    """The columns of ``df`` but its text, then ids (array<int>) and offsets (array<int>: the byte
    at which each token ends). The vocabulary, whose size does not depend on the data, is broadcast;
    each worker caches the ids of at most ``cached`` short pieces. With ``decoded`` a column of that
    name has the bytes that the ids decode to: a round trip that needs one worker instead of two."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, code_point_classes()))
    out = ["ids", "offsets", *([decoded] if decoded else [])]
    kept = _keep(df, {text, *out})
    schema = StructType([df.schema[c] for c in kept]
                        + [StructField(c, ArrayType(IntegerType(), False)) for c in ("ids", "offsets")]
                        + ([StructField(decoded, BinaryType())] if decoded else []))

    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _workers.get(tag)
        if known is None:
            _workers.clear()                # a worker process outlives the call that it worked for
            pa.default_memory_pool().release_unused()
            ranks, classes = shared.value
            known = _workers.setdefault(tag, (Encoder(ranks, classes, cached), Decoder(ranks) if decoded else None))
        worker, back = known
        for batch in batches:
            # a round trip holds 24 bytes for each of the text, so it takes smaller slices
            for first, last, data, offsets in slices(batch.column(len(kept)), SLICE // 16 if decoded else None):
                ids, ends, counts = worker.encode(data, offsets)
                columns = [lists(ids, counts, pa.int32()), lists(ends, counts, pa.int32())]
                if decoded:
                    columns.append(back.decode(ids, counts, ends))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, last - first) for i in range(len(kept))), *columns],
                                                 [*kept, *out])

    return df.select(*[f"`{c}`" for c in kept], f"`{text}`").mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], out: str = "decoded") -> DataFrame:
    """The columns of ``df`` and the bytes that its ids stand for; null ids give null. Where offsets
    are given they say where each token's bytes go; otherwise the lengths of the tokens do."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kept = _keep(df, {out})
    schema = StructType([df.schema[c] for c in kept] + [StructField(out, BinaryType())])
    ids_at, ends_at = kept.index("ids"), kept.index("offsets") if "offsets" in kept else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column(ids_at)
                counts = np.array(column.value_lengths().fill_null(0), np.int64)
                ends = np.array(batch.column(ends_at).flatten(), np.int64) if ends_at is not None else None
                decoded = back.decode(np.array(column.flatten(), np.int64), counts, ends)
                if column.null_count:
                    decoded = pa.compute.if_else(column.is_valid(), decoded, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*kept, out])

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)
