"""Token counts of a word-level BPE without token ids.

Pre-tokens are cut from every text and counted per document. Every different pre-token of the
corpus is split into pieces once, only to learn how many there are. The two tables are joined and
the products summed. The vocabulary of pre-tokens grows with the corpus, so only its most frequent
part, at most ``head`` entries of bounded width, is broadcast; the pre-tokens outside it are rare,
and what documents have of those takes an ordinary join.

A null text is the empty text and has no tokens. Texts of any length are read in stretches that end
before white space, which no pre-token crosses. Bytes that are no UTF-8 count as U+FFFD. Rows are
told apart by their place, not by a key: null keys and repeated rows each keep their own result. An
empty table stays empty. Columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage
from .bpe import Pairs
from .text import SLICE, slices

HEAD = 500_000          # entries of the vocabulary that are broadcast, each a key of at most 64 bytes
LONG_KEY = 32           # bytes; longer pre-tokens go by their SHA-256
STRETCH = 1 << 20       # characters of a long text read at once
CUT = SLICE // 2        # bytes cut at once; arrays over them take some 40 times as much
HELD = 200_000          # different pre-tokens that a task holds before it passes them on
BATCHED = 64            # bytes; longer pre-tokens are merged one by one
SPACE, LETTER, NUMBER, OTHER = range(4)

# fixed values: the parts that a tokenizer file must have to be read here
NORMALIZER = ["NFC", "Replace", "Lowercase"]
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPLIT = CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _ranges(points: Iterable[int]) -> str:
    """The inside of a character class."""
    out, points = [], sorted(points)
    at = 0
    while at < len(points):
        stop = at
        while stop + 1 < len(points) and points[stop + 1] == points[stop] + 1:
            stop += 1
        out.append(f"\\U{points[at]:08x}" + (f"-\\U{points[stop]:08x}" if stop > at else ""))
        at = stop + 1
    return "".join(out)


@dataclass
class CodePoints:
    """What is known of every code point: its class, its lower case, and whether a text with it must be
    read by the patterns, because composition may change it or its lower case is not one code point."""

    kind: np.ndarray            # uint8: SPACE, LETTER, NUMBER, OTHER
    lower: np.ndarray           # uint32
    slow: np.ndarray            # bool


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], dict[str, str], CodePoints]:
    """Patterns by the characters of a text, the code points whose lower case is not Python's, and the
    same as arrays, as the tokenizers library classes code points. Driver only."""
    from tokenizers import Regex, normalizers, pre_tokenizers
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)

    def members(kind: str) -> list[int]:
        found = pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(points)
        return sorted(ord(x) for x, _ in found)

    low, nfc = normalizers.Lowercase(), normalizers.NFC()
    second = {ord(d[-1]) for c in points if (d := unicodedata.normalize("NFD", c)) != c}
    jamo = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    moving = [ord(c) for c in points if unicodedata.combining(c) or ord(c) in second or ord(c) in jamo
              or unicodedata.category(c) == "Cn" or nfc.normalize_str(c) != c]
    lowered = {c: x for c in points if (x := low.normalize_str(c)) != c.lower()}
    lowered["Σ"] = low.normalize_str("Σ")                   # Python's depends on the letters around it
    kinds = [members(x) for x in (r"\p{L}", r"\p{N}", r"\s")]
    patterns = {"moving": f"[{_ranges(moving)}]", "lowered": f"[{_ranges(map(ord, lowered))}]",
                "beyond": "[\U00010000-\U0010ffff]"}
    for name, limit in (("ascii", 0x80), ("plane", 0x10000), ("all", 0x110000)):
        letters, numbers, spaces = ([c for c in x if c < limit] for x in kinds)
        patterns[name] = (f"{CONTRACTIONS}|[{_ranges(letters)}]+|[{_ranges(numbers)}]"
                          f"|[^{_ranges([*letters, *numbers, *spaces])}]+")
    kind, slow = np.full(0x110000, OTHER, np.uint8), np.zeros(0x110000, bool)
    for name, points_of in zip((LETTER, NUMBER, SPACE), kinds):
        kind[points_of] = name
    slow[moving] = True
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in points:
        x = lowered.get(c, c.lower())
        if len(x) != 1:
            slow[ord(c)] = True
        else:
            lower[ord(c)] = ord(x)
    # lower case may be of another class, and is what the classes are about
    return patterns, lowered, CodePoints(kind[lower], lower, slow)


@dataclass
class Splitter:
    """Texts to pre-tokens, with the character classes of the tokenizers library. The patterns are
    compiled in each worker."""

    patterns: dict[str, str]
    lowered: dict[str, str]
    points: CodePoints
    compiled: dict[str, re.Pattern] = field(default_factory=dict, repr=False)

    @classmethod
    def with_special(cls, special: list[str]) -> Splitter:
        patterns, lowered, points = _tables()
        longest_first = sorted(special, key=len, reverse=True)
        return cls(patterns | ({"special": "|".join(map(re.escape, longest_first))} if special else {}), lowered, points)

    def __getstate__(self):
        return self.__dict__ | {"compiled": {}}

    def pattern(self, name: str) -> re.Pattern:
        found = self.compiled.get(name)
        if found is None:
            found = self.compiled.setdefault(name, re.compile(self.patterns[name]))
        return found

    def lower(self, text: str) -> str:
        odd = self.pattern("lowered")
        if not odd.search(text):
            return text.lower()
        out, at = [], 0
        for m in odd.finditer(text):
            out += [text[at:m.start()].lower(), self.lowered[m[0]]]
            at = m.end()
        return "".join([*out, text[at:].lower()])

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a stretch without special strings. White space runs are not joined first:
        no pre-token has white space, so that changes none."""
        if text.isascii():
            return self.pattern("ascii").findall(text.lower())
        if self.pattern("moving").search(text):
            from tokenizers import normalizers
            text = normalizers.NFC().normalize_str(text)
        text = self.lower(text)
        return self.pattern("all" if self.pattern("beyond").search(text) else "plane").findall(text)

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH:
            stop = re.compile(r"[ \n\t]").search(text, at + STRETCH)
            if not stop:
                break
            yield text[at:stop.start()]
            at = stop.start()
        yield text[at:] if at else text

    def count(self, text: str, into: Counter) -> int:
        """Add the pre-tokens of a text; the number of special strings in it is returned."""
        parts = self.pattern("special").split(text) if "special" in self.patterns else [text]
        for part in parts:
            for stretch in self.stretches(part):
                into.update(self.split(stretch))
        return len(parts) - 1


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their first bytes) of UTF-8; what is not UTF-8 comes out as a code point beyond all."""
    text = data.tobytes().decode("utf-8", "surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    return points, np.cumsum(width, dtype=np.int64) - width


def cut(splitter: Splitter, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pre-tokens of all texts one after another, the text of each, texts that must be read by the
    patterns instead). Whole arrays at once: a pre-token begins where the class of code points changes,
    at every number, and after a contraction, which only an apostrophe that stands alone can begin."""
    n = len(offsets) - 1
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    if len(data) == 0 or data.max() < 0x80:
        points, at = data, None
    else:
        points, at = _points(data)
        heads = np.searchsorted(at, heads)
    begins = np.searchsorted(at, offsets) if at is not None else offsets
    table = splitter.points
    late = np.zeros(n, bool)
    strange = table.slow[points] | ((points >= 0xD800) & (points <= 0xDFFF)) if at is not None else np.zeros(0, bool)
    if strange.any():
        late[np.searchsorted(begins[1:], np.flatnonzero(strange), "right")] = True
    raw = data.tobytes()
    if "special" in splitter.patterns and b"<|" in raw:
        for i in range(n):
            late[i] |= raw.find(b"<|", offsets[i], offsets[i + 1]) >= 0
    low, kind = table.lower[points], table.kind[points]
    if late.any():
        kind = np.where(np.repeat(late, np.diff(begins)), np.uint8(SPACE), kind)
    word = kind != SPACE
    start = word.copy()
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    start[heads] = word[heads]
    size = len(kind)
    head = np.zeros(size + 4, bool)
    head[heads] = True
    head[size:] = True
    # an apostrophe between something else and a letter of the same text
    quote = np.flatnonzero(start & (low == 39))
    quote = quote[(quote + 1 < size) & ~head[quote + 1]]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        first, second = low[quote + 1], np.where(head[quote + 2], 0, low[np.minimum(quote + 2, size - 1)])
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        for at_quote, length in ((quote[one], 2), (quote[two], 3)):
            start[at_quote + 1] = False
            rest = at_quote + length
            rest = rest[~head[rest]]
            start[rest[kind[rest] == LETTER]] = True
    bound = np.append(np.flatnonzero(start | ~word | head[:size]), size)
    starts = np.flatnonzero(start)
    ends = bound[np.searchsorted(bound, starts, "right")]
    owner = np.searchsorted(begins[1:], starts, "right")
    if at is None:
        body = low.astype(np.uint8)
        place = None
    else:
        safe = np.where(word, low, 32)
        body = np.frombuffer(safe.tobytes().decode("utf-32-le").encode(), np.uint8)
        wide = 1 + (safe > 0x7F).astype(np.int8) + (safe > 0x7FF) + (safe > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
        starts, ends = place[starts], place[ends]
    lengths = ends - starts
    covered = np.zeros(len(body) + 1, np.int8)
    covered[starts] += 1
    covered[ends] -= 1
    inside = np.cumsum(covered[:-1], dtype=np.int8) > 0
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    made = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(body[inside])])
    return made, owner, np.flatnonzero(late)


class MergePairs(Pairs):
    """Pairs of symbols to the rank of their merge."""

    def __init__(self, pairs: list[tuple[int, int]], symbols: int):
        self.count = symbols
        keys = np.array([a * symbols + b for a, b in pairs], np.int64)
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, symbols, np.int64)
        todo, held = keys, np.arange(len(keys))
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = todo[free]
            done = self.keys[at] == todo
            self.values[at[done]] = held[done]
            todo, held, at = todo[~done], held[~done], (at[~done] + 1) & self.mask


@dataclass
class PieceCounter:
    """How many pieces the merges leave of a pre-token."""

    first: list[int]                # symbol of each byte inside a word
    last: list[int]                 # and of each byte that ends one
    merges: list[tuple[int, int]]   # pairs of symbols, by rank
    made: list[int]                 # symbol that each merge makes
    symbols: int

    @cached_property
    def pairs(self) -> MergePairs:
        return MergePairs(self.merges, self.symbols)

    @cached_property
    def table(self) -> dict[tuple[int, int], int]:
        return {pair: rank for rank, pair in enumerate(self.merges)}

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """For every non-empty pre-token of at most BATCHED bytes: each round makes the merge of
        lowest rank, leftmost first, in every one of them."""
        out = np.zeros(len(pieces), np.int64)
        if not pieces:
            return out
        name, size = np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.array(self.first, np.int64)[data]
        begin = np.cumsum(size) - size
        ids[begin + size - 1] = np.array(self.last, np.int64)[data[begin + size - 1]]
        made, none = np.array(self.made, np.int64), self.symbols
        rank = np.full(len(ids), none)
        inner = np.ones(len(ids), bool)
        inner[begin + size - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.pairs.get(ids[at], ids[at + 1])
        while len(name):
            best = np.minimum.reduceat((rank << 7) + (np.arange(len(ids)) - np.repeat(begin, size)), begin)
            ended = (best >> 7) == none
            if ended.any():
                out[name[ended]] = size[ended]
                stay = np.repeat(~ended, size)
                ids, rank = ids[stay], rank[stay]
                name, size, best = name[~ended], size[~ended], best[~ended]
                begin = np.cumsum(size) - size
                if not len(name):
                    break
            at = begin + (best & 127)
            ids[at] = made[best >> 7]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            at = at - np.arange(len(at))                    # one symbol went from each before it
            size = size - 1
            begin = np.cumsum(size) - size
            rank[at] = none
            right = at[at < begin + size - 1]
            rank[right] = self.pairs.get(ids[right], ids[right + 1])
            left = at[at > begin] - 1
            rank[left] = self.pairs.get(ids[left], ids[left + 1])
        return out

    def count_long(self, piece: bytes) -> int:
        """The same for one pre-token of any length, in n log n."""
        import heapq
        n = len(piece)
        ids = [self.first[b] for b in piece[:-1]] + [self.last[piece[-1]]]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := self.table.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i, j = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and self.table.get((ids[i], ids[j])) == r):
                continue                                    # one of its symbols has changed
            ids[i], alive[j], left = self.made[r], False, left - 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := self.table.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i, after[i]))
            if (p := before[i]) >= 0 and (x := self.table.get((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, (x, p, i))
        return left


def read_tokenizer(path: str) -> tuple[Splitter, PieceCounter]:
    """The parts of a tokenizer file with word-end BPE over bytes; ValueError for other kinds."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    model, special = known["model"], known["added_tokens"]
    steps = [x["type"] for x in (known["normalizer"] or {}).get("normalizers", [])]
    cuts = (known["pre_tokenizer"] or {}).get("pretokenizers", [])
    if (model["type"] != "BPE" or steps != NORMALIZER or [x["type"] for x in cuts] != ["Split", "ByteLevel"]
            or cuts[0]["pattern"] != {"Regex": SPLIT} or not cuts[0]["invert"] or cuts[1]["add_prefix_space"]
            or model["continuing_subword_prefix"] or model["unk_token"] or any(x["normalized"] for x in special)):
        raise ValueError("only lower-casing BPE with word ends over bytes is read")
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    # bytes that print stand for themselves, the others for characters from 256 on, in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    signs = [chr(b) if b in set(shown) else chr(next(others)) for b in range(256)]
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    return (Splitter.with_special([x["content"] for x in special]),
            PieceCounter([vocab[s] for s in signs], [vocab[s + end] for s in signs],
                         [(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges],
                         max([*vocab.values(), len(merges)]) + 1))


def key_of(piece: str) -> str:
    """A pre-token, or a name for a long one that is longer than any short one."""
    return piece if len(piece) <= LONG_KEY // 4 or len(raw := piece.encode()) <= LONG_KEY \
        else hashlib.sha256(raw).hexdigest()


def _keys(pieces: list[str]) -> pa.Array:
    return pa.array(map(key_of, pieces), pa.string())


def _counted(splitter: Splitter, raw: bytes) -> tuple[Counter, int]:
    seen: Counter = Counter()
    return seen, splitter.count(raw.decode("utf-8", "replace"), seen)


class Tally:
    """Pre-tokens with their numbers, from many slices; equal ones are merged before they are passed on."""

    def __init__(self):
        self.names, self.times, self.size = [], [], 0

    def add(self, names: pa.Array, times: np.ndarray) -> None:
        if len(names):
            self.names.append(names)
            self.times.append(times)
            self.size += len(names)

    def merge(self) -> None:
        named = pa.concat_arrays(self.names).dictionary_encode()
        total = np.zeros(len(named.dictionary), np.int64)
        np.add.at(total, np.asarray(named.indices), np.concatenate(self.times))
        self.names, self.times, self.size = [named.dictionary], [total], len(total)

    def full(self) -> Iterator[pa.RecordBatch]:
        """What is held, if that is more than a task may hold."""
        if self.size > 2 * HELD:
            self.merge()
            if self.size > HELD:
                yield from self.all()

    def all(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.merge()
            names = self.names[0].to_pylist()
            yield pa.RecordBatch.from_arrays([_keys(names), pa.array(names, pa.string()), pa.array(self.times[0])], ["key", "piece", "times"])
        self.names, self.times, self.size = [], [], 0


def vocabulary(docs: DataFrame, splitter: Splitter, counter: PieceCounter, text: str) -> DataFrame:
    """(key, times, pieces): every different pre-token with the number of its pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), CUT):
                pieces, _, late = cut(splitter, data, offsets)
                named = pieces.dictionary_encode()
                held.add(named.dictionary, np.bincount(np.asarray(named.indices), minlength=len(named.dictionary)))
                seen: Counter = Counter()
                for i in late.tolist():
                    splitter.count(data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"), seen)
                    if len(seen) > HELD:
                        held.add(pa.array(list(seen), pa.large_string()), np.fromiter(seen.values(), np.int64, len(seen)))
                        seen.clear()
                        yield from held.full()
                held.add(pa.array(list(seen), pa.large_string()), np.fromiter(seen.values(), np.int64, len(seen)))
                yield from held.full()
        yield from held.all()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.encode() for x in batch.column(1).to_pylist()]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            out = np.zeros(len(raw), np.int64)
            short = np.flatnonzero(size <= BATCHED)
            out[short] = counter.counts([raw[i] for i in short])
            for i in np.flatnonzero(size > BATCHED):
                out[i] = counter.count_long(raw[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["key", "times", "pieces"])

    # a key names one pre-token, so grouping by both is grouping by the key
    found = docs.select(f"`{text}`").mapInArrow(gather, "key string, piece string, times long")
    return found.groupBy("key", "piece").agg(F.sum("times").alias("times")).select("key", "piece", "times") \
        .mapInArrow(measure, "key string, times long, pieces long")


def frequencies(docs: DataFrame, splitter: Splitter) -> DataFrame:
    """The columns of ``docs`` (row, others, text last), then (n_bytes, special, key, times): a row per
    document and different pre-token. All but row, key and times are null except on its first row; a
    document without pre-tokens has one row with a null key."""
    names = docs.columns[1:-1]
    schema = docs.drop("text").schema
    for c, kind in (("n_bytes", "long"), ("special", "long"), ("key", "string"), ("times", "long")):
        schema = schema.add(c, kind)

    def rows(batch: pa.RecordBatch, owner: np.ndarray, size: np.ndarray, special: np.ndarray, lengths: np.ndarray,
             keys: pa.Array, times: np.ndarray) -> pa.RecordBatch:
        """Rows of the documents ``owner``, ``lengths`` of them each; none means one with a null key."""
        several = np.maximum(lengths, 1)
        begin = np.cumsum(several) - several
        later = np.ones(int(several.sum()), bool)
        later[begin] = False
        at = np.repeat(np.arange(len(owner)), several)
        if (lengths == 0).any():
            empty = np.zeros(len(at), bool)
            empty[begin[lengths == 0]] = True
            place = np.cumsum(~empty) - 1
            keys = keys.take(pa.array(np.maximum(place, 0), mask=empty)) if len(keys) else pa.nulls(len(at), pa.string())
            times = np.where(empty, 0, times[np.maximum(place, 0)]) if len(times) else np.zeros(len(at), np.int64)
        first, once = pa.array(owner[at], mask=later), pa.array(at, mask=later)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner[at])), *[batch.column(1 + i).take(first) for i in range(len(names))],
             pa.array(size, pa.int64()).take(once), pa.array(special, pa.int64()).take(once), keys, pa.array(times, pa.int64())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(batch.num_columns - 1), CUT):
                n, size = last - first, np.diff(offsets)
                pieces, owner, late = cut(splitter, data, offsets)
                named = pieces.dictionary_encode()
                words = len(named.dictionary)
                pairs, times = np.unique(owner * max(words, 1) + np.asarray(named.indices), return_counts=True)
                keys = _keys(named.dictionary.to_pylist()).take(pa.array(pairs % max(words, 1)))
                quick = np.ones(n, bool)
                quick[late] = False
                lengths = np.bincount(pairs // max(words, 1), minlength=n)[quick]
                if len(lengths):
                    yield rows(batch, first + np.flatnonzero(quick), size[quick], np.zeros(len(lengths), np.int64), lengths, keys, times)
                for i in late.tolist():
                    seen, special = _counted(splitter, data[offsets[i]:offsets[i + 1]].tobytes())
                    yield rows(batch, np.array([first + i]), size[[i]], np.array([special]), np.array([len(seen)]),
                               _keys(list(seen)), np.fromiter(seen.values(), np.int64, len(seen)))

    return docs.mapInArrow(run, schema)


def split_vocabulary(words: DataFrame, head: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent entries, at most ``head`` of them, and the others if there are any."""
    level = F.floor(F.log2("times"))
    sizes = {r.level: r.n for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) <= head:
        return words, None
    least, held = max(sizes) + 1, 0
    while least - 1 in range(max(sizes) + 1) and held + sizes.get(least - 1, 0) <= head:
        least -= 1
        held += sizes.get(least, 0)
    return words.filter(level >= least), words.filter(level < least)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048, head: int = HEAD) -> DataFrame:
    """The columns of ``df`` but its text, then n_bytes (of the text in UTF-8), n_tokens, and whether
    those are more than ``limit``."""
    splitter, counter = read_tokenizer(path)
    words = cut_lineage(vocabulary(df, splitter, counter, text))
    often, seldom = split_vocabulary(words, head)
    kept = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    names = {c: f"kept{i}" for i, c in enumerate(kept)}
    docs = df.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
                     F.col(f"`{text}`").alias("text"))
    # the row numbers of a task go through one shuffle with its rows, so they need not agree between attempts
    found = frequencies(docs, splitter).join(F.broadcast(often.select("key", "pieces")), "key", "left")
    # one value per row, so any aggregate takes it; fixed-width ones stay in the hash map
    once = [F.max(c).alias(c) if isinstance(docs.schema[c].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))
            else F.first(c, True).alias(c) for c in names.values()] + [F.max(c).alias(c) for c in ("n_bytes", "special")]
    total = F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0)).alias("tokens")
    if seldom is None:
        summed = found.groupBy("row").agg(*once, total)
    else:
        rare = F.collect_list(F.when(F.col("pieces").isNull() & F.col("key").isNotNull(), F.struct("key", "times"))).alias("rare")
        part = cut_lineage(found.groupBy("row").agg(*once, total, rare))
        more = (part.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.times")
                .join(seldom.select("key", "pieces"), "key")
                .groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more")))
        summed = part.join(more, "row", "left").withColumn("tokens", F.col("tokens") + F.coalesce("more", F.lit(0)))
    n = F.col("tokens") + F.col("special")
    return summed.select(*[F.col(x).alias(c) for c, x in names.items()], "n_bytes", n.alias("n_tokens"),
                         (n > limit).alias("over_limit"))
