"""Token counts, centroid clustering and periodic runs: against the library, plain integers and brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from loomstat.llm import centroids, periodic, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
# names that the operators use inside themselves
CLASH = "row string, key string, n_tokens string, kept0 string, pieces int, times int, runs int, special string, `a.b` int"
CLASH_VALUES = ("r", "k", "n", "z", 1, 2, 3, "s", 4)
ODD = ["a", "B", "é", "é", "Σ", "ς", "İ", "ß", " ", "\n", " ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|endof",
       "1", "٢", "漢", "😀", "!", "..", "Ᲊ", "가", "가", "̧́", "\u0000", "x" * 70, "ǅ", "𝐀", "\U00010d50", "ﬁ"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH_VALUES) for i, t in rows], f"doc_id long, text string, {CLASH}")


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.choice([1, 3, 10, 60]))) for _ in range(n)]


@pytest.mark.parametrize("head", [token_counts.HEAD, 40])
def test_token_counts_equal_the_library(spark, head):
    from tokenizers import Tokenizer
    known = Tokenizer.from_file(WORDS)
    rows = [*enumerate(odd_texts(800)), (7, "one two"), (7, "one two"), (None, "one two"), (900, None), (901, ""), (902, LONG),
            (903, "z" * 30_000), (904, " ".join(["tie"] * 2048)), (905, " ".join(["tie"] * 2049)), (906, LONG)]
    got = token_counts.count_tokens(docs(spark, rows), WORDS, head=head)
    assert got.columns == ["doc_id", "row", "key", "kept0", "pieces", "times", "runs", "special", "a.b", "n_bytes", "n_tokens", "over_limit"]
    want = collections.Counter()
    for (i, t), e in zip(rows, known.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        want[(i, len((t or "").encode()), len(e.ids), len(e.ids) > 2048)] += 1
    found = got.collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want
    assert all(r.row == "r" and r["a.b"] == 4 and r.special == "s" for r in found)


def test_token_counts_of_an_empty_table_and_other_files(spark):
    assert token_counts.count_tokens(docs(spark, []), WORDS).count() == 0
    with pytest.raises(ValueError):
        token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_long_texts_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 50)
    splitter, _ = token_counts.read_tokenizer(WORDS)
    for text in [LONG[:5000], "y" * 400, *odd_texts(50, 3)]:
        parts = list(splitter.stretches(text))
        assert "".join(parts) == text
        assert [x for p in parts for x in splitter.split(p)] == splitter.split(text)


def plain_clustering(vectors, k, rounds):
    """Centroids recomputed from scratch with Python integers."""
    start = sorted(vectors, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(x) for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in vectors:
            groups[nearest(x)[1]].append(x)
        centres = [[sum(v) // len(groups[j]) for v in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centres)]
    return [(i, *nearest(x)[::-1]) for i, x in vectors], centres


def test_centroids_equal_plain_integers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * rng.choice([1, 40, 5000], size=(300, 1))
    x[100:180] = x[100]                                             # copies, so ties and centroids that stay empty
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    rows += [(5, rows[5][1], "c"), (None, [0.5] * 6, "c"), (900, None, "c"), (901, [1.0] * 5, "c"), (902, [None] + [1.0] * 5, "c"),
             (903, [float("nan")] + [1.0] * 5, "c"), (904, [float("inf")] * 6, "c"), (905, [1e30] * 6, "c")]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>, cluster string")
    got = centroids.cluster(table, "vec_id", "v", size=6, k=9, rounds=4, scale=256, seed="2:").collect()
    kept = [(i, [int(np.floor(256 * e)) for e in v]) for i, v, _ in rows[:302]]
    want, centres = plain_clustering(kept, 9, 4)
    assert collections.Counter((r.vec_id, r.cluster, r.distance) for r in got) == collections.Counter(want)
    for r in got:
        assert r.centroid == centres[r.cluster]
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest()
        assert r.inertia == sum(w[2] for w in want) and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)


def test_centroids_of_few_and_no_vectors(spark):
    table = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0])], "vec_id long, v array<double>")
    got = centroids.cluster(table, "vec_id", "v", size=2, k=9, rounds=2)
    assert got.count() == 2 and {r.distance for r in got.collect()} == {0}
    none = centroids.cluster(table.limit(0), "vec_id", "v", size=2, k=9, rounds=2)
    assert none.count() == 0 and none.columns == got.columns


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, k = rng.choice([0, 5, 13, 40, 150, 600]), rng.choice([1, 2, 3, 20])
    w = [f"v{rng.randrange(k)}" for _ in range(n)]
    if n > 30 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.choice([3, 4, 7, 10])
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_equal_brute_force(spark):
    rng = random.Random(11)
    lists = [random_words(rng) for _ in range(150)]
    rows = [*enumerate(rng.choice([" ", "\n", "  \t"]).join(w) for w in lists)]
    rows += [(900, None), (901, "  "), (None, "a b " * 9), (902, "a b " * 9), (902, "a b " * 9), (903, LONG), (904, "é x " * 40)]
    lists = [(t or "").split(" ") if i is None or (i or 0) >= 900 else lists[i] for i, t in rows]
    lists = [[x for x in w if x.strip(" \t\n")] for w in lists]
    got = collections.defaultdict(list)
    for r in periodic.find_runs(docs(spark, rows).drop("runs")).collect():
        got[(r.doc_id, r.text)].append(r)
        assert r.row == "r" and r["a.b"] == 4
    for (i, _), w in zip(rows, lists):
        if i == 903:                        # brute force would take minutes: the words repeat after 977 * 31
            want = [(0, 60_000, 977 * 31)] if 60_000 >= 2 * 977 * 31 else []
        else:
            want = plain_runs(w)
        gone = {j for s, n, q in want for j in range(s + q, s + n)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone)
        r = got[(i, text)].pop()
        assert [tuple(x) for x in r.runs] == want
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (tuple(r.longest) if r.longest else None) == best
    assert not any(got.values())
    assert periodic.find_runs(docs(spark, [])).count() == 0


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 3, size=(40, 4))
    windows = rng.integers(0, 3, size=(40, 19))
    got = {tuple(x) for x in periodic.zero_mismatch(blocks, windows).tolist()}
    assert got == {(i, j) for i in range(40) for j in range(16) if (blocks[i] == windows[i, j:j + 4]).all()}
    rows = rng.integers(0, periodic.PRIME, size=(3, 64)).astype(np.uint64)
    assert (periodic.transform_back(periodic.transform(rows)) == rows).all()


def test_periodic_tails(spark):
    import zlib
    rows = [(i, " ".join(f"u{j}" for j in range(i % 60))) for i in range(200)] + [(None, "a b"), (200, None), (201, " \n")]
    got = {r.doc_id: r.text for r in periodic.with_periodic_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[j] if j < a else w[a + (j - a) % p] for j in range(n))
        assert got[i] == t


def test_cutting_whole_arrays_equals_the_patterns():
    splitter, _ = token_counts.read_tokenizer(WORDS)
    rng = random.Random(5)
    alphabet = ["'", "'", "s", "t", "re", "ve", "ll", "l", "d", "m", "A", "É", "ß", " ", "\n", " ", "1", "٢", "!", "-", "“", "”", "漢",
                "😀", "<|endoftext|>", "<|", "Σ", "İ", "é", "x" * 40]
    for _ in range(40):
        texts = ["".join(rng.choice(alphabet[:rng.choice([14, 19, len(alphabet)])]) for _ in range(rng.choice([0, 1, 2, 5, 40])))
                 for _ in range(30)]
        raw = [t.encode() for t in texts]
        pieces, owner, late = token_counts.cut(splitter, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        got = collections.defaultdict(list)
        for piece, i in zip(pieces.to_pylist(), owner.tolist()):
            got[i].append(piece)
        for i, t in enumerate(texts):
            if i in late:
                assert i not in got
            else:
                assert "<|" not in t and got[i] == splitter.split(t)


def test_vocabulary_is_cut_in_small_slices_and_merged(spark, monkeypatch):
    splitter, counter = token_counts.read_tokenizer(WORDS)
    rows = [(i, f"common w{i % 50} é{i} <|endoftext|> x{i}") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = collections.Counter()
    for _, t in rows:
        splitter.count(t, want)
    monkeypatch.setattr(token_counts, "CUT", 200)
    monkeypatch.setattr(token_counts, "HELD", 60)
    sizes = []
    whole = token_counts.cut

    def watched(of, data, offsets):
        sizes.append(len(data))
        return whole(of, data, offsets)

    monkeypatch.setattr(token_counts, "cut", watched)

    class Rows:                                         # runs what a task runs, in this process
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.out = list(run(iter(table.select("text").toArrow().to_batches())))
            return table.selectExpr("text as key", "text as piece", "doc_id as times")

    held = Rows()
    token_counts.vocabulary(held, splitter, counter, "text")
    assert max(sizes) <= 200
    got = collections.Counter()
    for batch in held.out:
        assert len(set(batch.column(1).to_pylist())) == batch.num_rows
        got.update(dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
    assert got == want
    assert sum(b.num_rows for b in held.out) < 2 * len(want)
