"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomstat.llm import (ann, bpe, decontam, langid, line_dedup, ngram_join, paragraphs, suffix_dedup, toxicity,
                          warc)

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
# names that the operators use inside themselves
CLASH = "key string, node int, n string, row string, text_ string, ids string, spans int, n_removed string, words int, no int, doc int"
CLASH_VALUES = ("k", 1, "n", "r", "t", "i", 2, "x", 3, 4, 5)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH_VALUES) for i, t in rows], f"doc_id long, text string, {CLASH}")


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven eight nine ten eleven twelve"),
        (5, "One two three four five six seven eight nine ten eleven twelve"), (5, "One two three four five six seven eight nine ten eleven twelve"),
        (None, "one two three four five six seven eight nine ten eleven twelve"), (7, LONG), (8, LONG), (9, "é ß 漢字 'll 123"), (10, "word")]


def test_bpe_round_trip(spark):
    import tiktoken
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    table = docs(spark, ROWS)
    got = bpe.decode(bpe.encode(table, RANKS), RANKS).collect()
    once = bpe.encode(table, RANKS, decoded="decoded").collect()
    assert collections.Counter(map(str, once)) == collections.Counter(map(str, got))
    assert len(got) == len(ROWS)
    want = collections.Counter((i, tuple(known.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n == "n" and (not r.offsets or r.offsets[-1] == len(r.decoded)) for r in got)
    assert bpe.decode(bpe.encode(table.limit(0), RANKS), RANKS).count() == 0


def test_bpe_without_offsets_and_null_ids(spark):
    table = spark.createDataFrame([(1, [64, 272]), (2, []), (3, None)], "id long, ids array<int>")
    got = {r.id: r.decoded for r in bpe.decode(table, RANKS).collect()}
    assert bytes(got[1]) == b"".join(t for i in (64, 272) for t, k in RANKS.items() if k == i)
    assert bytes(got[2]) == b"" and got[3] is None


def test_bpe_against_tiktoken_on_odd_texts():
    import random
    import tiktoken
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    coder = bpe.Encoder(RANKS, bpe.code_point_classes(), 50)            # the cache overflows often
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice(" \t\n  '''sstmdrvlleeabXÉß漢٢12,.!?$😀́") for _ in range(rng.choice([0, 1, 2, 9, 150])))
                 for _ in range(20)] + ["a" * 5000 + " " * 300]
        raw = [t.encode() for t in texts]
        ids, _, counts = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [known.encode_ordinary(t) for t in texts]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[200:300] = x[200]                                                    # a group of copies, so ties
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    rows += [(900, None, "c"), (901, [0.0] * 8, "c"), (902, [1.0] * 7 + [None], "c"), (903, [float("nan")] + [1.0] * 7, "c"),
             (904, [float("inf")] * 8, "c"), (905, [1.0] * 5, "c"), (20, [float(v) for v in x[20]], "c"), (None, [1.0] * 8, "c")]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>, rank string")
    got = collections.defaultdict(list)
    for r in ann.search(table, "vec_id", "v", lambda i: i % 20 == 0, index_rows=100, query_rows=8).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        score = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(table.limit(0), "vec_id", "v", lambda i: i % 20 == 0).count() == 0
    few = ann.search(table.filter("vec_id < 3"), "vec_id", "v", lambda i: i == 0, k=20).collect()
    assert sorted((r.rank, r.query_id) for r in few) == [(1, 0), (2, 0)]


def test_neighbours_when_the_footrule_decides(spark):
    """A fifth of each block is ranked, so what the index puts first decides what is found."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 12))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(table, "vec_id", "v", lambda i: i % 50 == 0, least=20, index_rows=1000, query_rows=40).collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 3000, 50):
        score = (x * x[q]).sum(1)
        hits += len({i for i in np.lexsort((np.arange(3000), -score))[:21] if i != q} & set(got[q]))
    assert all(len(found) == 20 for found in got.values()) and 0.9 * 20 * 60 <= hits


def test_footrule(spark):
    """The files of a block give the footrule of whole permutations, less the same for every row."""
    rng = np.random.default_rng(1)
    perm = np.array([rng.permutation(30)[:7] for _ in range(50)], np.int32)
    query = rng.permutation(30)[:7]
    rank = lambda p, i: list(p).index(i) if i in p else 7
    want = [sum(abs(rank(p, i) - rank(query, i)) for i in range(30)) for p in perm]
    assert (ann.Block(perm, 30).footrule(query) + 2 * sum(range(1, 8))).tolist() == want


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = ["table", "garden", "river", "window", "paper", "music", "winter"]
    rows, marks = [(1000, None), (1001, ""), (None, "zorgle zorgle"), (1002, "zorglepaper " * 20_000)], []
    for i in range(240):
        words = list(rng.choice(plain, 30))
        if i % 4 == 0:
            words[::10] = [f"zorgle{rng.choice(plain)}"] * 3
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    marks += [(5, None), (None, 1), (3, 0), (3, 0)]
    table, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(240))
    assert got[1000].predicted == got[1001].predicted == 0 and got[None].predicted == got[1002].predicted == 1
    joined = {r.doc_id: r.score for r in toxicity.toxicity(table, labels, broadcast_rows=0).collect()}
    assert all(abs(joined[i] - got[i].score) < 1e-9 for i in got)
    assert toxicity.toxicity(table.limit(0), labels).count() == 0
    none = toxicity.toxicity(table, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r.score == 0 and r.predicted == 0 for r in none)


@pytest.mark.parametrize("folds", [(0, 1), (1, 3), (0, 3), (0, 1, 3)])
def test_toxicity_with_a_fold_of_one_class(spark, folds):
    """Toxic documents stand in some folds only; the curve then comes from those that others can judge."""
    import zlib
    plain = ["table", "garden", "river", "window", "paper", "music", "winter"]
    rng = np.random.default_rng(4)
    rows, marks, want = [], [], {}
    for i in range(400):
        toxic = int(i % 3 == 0 and zlib.crc32(str(i).encode()) % 4 in (*folds, 2))
        words = list(rng.choice(plain, 30))
        if toxic:
            words[::10] = [f"zorgle{rng.choice(plain)}"] * 3
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
        want[i] = toxic
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    assert {i: r.predicted for i, r in got.items()} == want
    assert min(got[i].score for i in want if want[i]) > max(got[i].score for i in want if not want[i])


def test_lines(spark):
    rows = [(1, "a b c d e\nx y\n\n"), (2, "A b c d e\nnew line here\nx y"), (2, "A b c d e\nnew line here\nx y"), (None, "x y"), (3, None),
            (4, ""), (5, "e d c b a\n  \nonly here"), (6, "a b c d q\na b c d e f\n" + LONG), (7, LONG + " end")]
    table = docs(spark, rows)
    got = collections.Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(table).collect())
    assert got == collections.Counter([
        (1, "a b c d e\nx y\n\n", 4, 0), (2, "new line here", 3, 2), (2, "new line here", 3, 2), (None, "x y", 1, 0), (3, None, 0, 0),
        (4, "", 1, 0), (5, "  \nonly here", 3, 1), (6, "a b c d q\n" + LONG, 3, 1), (7, "", 1, 1)])
    assert line_dedup.dedup_lines(table).columns == [c for c in table.columns if c != "n_removed"] + ["n_lines", "n_removed"]
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0


def test_lines_that_share_only_rare_words_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join([f"rare{i // 4}a", f"rare{i // 4}b", *(f"w{x}" for x in rng.choice(60, 28, replace=False))])) for i in range(60)]
    rows += [(100 + i, t.replace("a w", "a other w") if i % 2 else t.rsplit(" ", 1)[0]) for i, t in rows[:20]]
    rows += [(200, "a b c d e"), (201, "a b c d e f"), (202, "a b c d g f"), (203, "x"), (204, "x y")]
    sets = [set(t.split()) for _, t in rows]
    want = {rows[j][0] for j in range(len(rows)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    compared, real = [], line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda docs_, pairs, num, den: compared.append(pairs.count()) or real(docs_, pairs, num, den))
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_removed}
    assert got == want and len(want) > 20
    assert sum(compared) < 2 * len(want)


def test_shuffles_of_finished_steps_are_freed(spark, monkeypatch):
    def left():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))

    seen, real = [], line_dedup.free_shuffles
    monkeypatch.setattr(line_dedup, "free_shuffles", lambda session: seen.append(left()) or real(session))
    table = spark.createDataFrame([(i, f"a b c d e {i % 7}\nf g h i j {i}") for i in range(50)], "doc_id long, text string")
    line_dedup.dedup_lines(table).collect()
    assert len(seen) == 3 and min(seen) > 0
    for _ in range(50):
        real(spark)
        if left() < max(seen):
            break
        time.sleep(0.1)
    assert left() < max(seen)


def test_archives(spark, tmp_path):
    big = "<p>" + "same text " * 200 + "</p>"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "http://d", ""), (5, "u", "small"), (6, "u", "small"),
            (None, "n", big), (7, "x y", "é" * 100_000), (2, "http://b", big)]
    rows += [(i, "f", f"<html>page {i} of many</html>" * 50) for i in range(20, 60)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    place = str(tmp_path / "out")
    written = warc.write_archives(warc.with_revisits(table, "page_id", "html"), place, archive_bytes=30_000).collect()
    assert sum(r.records for r in written) == len(rows)
    got = warc.read_archives(spark, place).collect()
    want = collections.Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        response = 2 if body == big.encode() else None
        kind = "revisit" if response is not None and i != response else "response"
        want[i, len(body), hashlib.sha1(body).hexdigest(), kind, response if kind == "revisit" else None] += 1
    assert collections.Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload is None or hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    head = next((tmp_path / "out").glob("*.warc.zst")).read_bytes()
    assert int.from_bytes(head[:4], "little") == warc.MAGIC
    nothing = str(tmp_path / "none")
    assert not [r for r in warc.write_archives(warc.with_revisits(table.limit(0), "page_id", "html"), nothing).collect() if r.records]


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.setdefault(i, set()).update(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1)) if w)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join(spark):
    rng = np.random.default_rng(4)
    rows = [r for r in ROWS if r[0] is not None]
    for group in range(6):
        base = [f"g{group}w{j}" for j in range(int(rng.choice([3, 6, 12, 40, 120])))]
        for copy in range(25):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(10**6)}"
            rows.append((100 + 30 * group + copy, " ".join(words)))
    want = brute_components(rows, 4, 85, 100)
    table = docs(spark, [*rows, (None, LONG)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(table).collect()}
    assert got.pop(None)[1] == 7                # no key of its own, but equal to documents that have one
    assert got == want
    assert ngram_join.similar_documents(table.limit(0)).count() == 0


def test_light_and_heavy_postings_agree(spark):
    """Whatever the boundary, both ways give the same components."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        words = [f"t{j}" for j in range(int(rng.integers(5, 30)))]
        for _ in range(int(rng.integers(0, 2))):
            words[int(rng.integers(len(words)))] = f"y{rng.integers(50)}"
        rows.append((i, " ".join(words)))
    want = brute_components(rows, 4, 85, 100)
    table = docs(spark, rows)
    saved = ngram_join.boundary
    try:
        for light in (1, 8, 17, 1000):
            ngram_join.boundary = lambda *_: light
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(table).collect()} == want
    finally:
        ngram_join.boundary = saved


def test_languages(spark):
    rng = np.random.default_rng(6)
    sounds = {"aa": ["ta", "ka", "pa"], "ab": ["ta", "ka", "po"], "ba": ["schr", "ung", "ich"], "bb": ["schr", "ung", "oom"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(40)), lang) for i, lang in
            ((i, list(sounds)[i % 4]) for i in range(200))]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "aa"), (None, rows[0][1], "bb"), (903, rows[1][1] * 200, None), (904, "é", None)]
    table = spark.createDataFrame([(*r, "x", 0.5) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.identify(table).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].lang_pred == "aa" and got[903].lang_pred == "ab" and got[904].lang_pred in sounds
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(table.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    one = langid.identify(table.filter("lang = 'aa' or lang is null")).collect()
    assert {r.lang_pred for r in one} == {"aa", "und"}


def test_languages_of_few_texts_and_many_copies(spark):
    rng = np.random.default_rng(7)
    sounds = {"aa": "taka", "ab": "popo", "ba": "schrung", "bb": "oomij"}
    made = lambda lang: " ".join("".join(rng.choice(list(sounds[lang]), 5)) for _ in range(30))
    texts = {"aa": [made("aa") for _ in range(3)], "ab": [made("ab")], "ba": [made("ba") for _ in range(150)], "bb": [made("bb") for _ in range(30)]}
    copies = {"aa": 400, "ab": 1200, "ba": 8, "bb": 1}
    rows = [(t, lang) for lang, some in texts.items() for t in some for _ in range(copies[lang])]
    rows += [(f"{i} !", "bb") for i in range(3000)]                 # without a letter
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = collections.defaultdict(list)
    for r in langid.training_texts(table, sample_rows=80).collect():
        got[r.lang].append(r.text)
    assert all(len(v) == len(set(v)) and set(v) <= set(texts[k]) for k, v in got.items())
    assert {k: len(v) for k, v in got.items()} == {"aa": 3, "ab": 1, "ba": 20, "bb": 20}
    model = langid.fit(table, sample_rows=80)
    assert model.langs == sorted(texts)
    ask = spark.createDataFrame([(some[0], lang) for lang, some in texts.items()], "text string, lang string")
    assert all(r.lang == r.lang_pred for r in langid.predict(ask, model).collect())


def test_paragraphs(spark):
    rng = np.random.default_rng(9)
    fresh = lambda n: " ".join(f"v{rng.integers(10**9)}" for _ in range(n))
    shared = fresh(80)
    rows = [(1, fresh(40) + " " + shared + " " + fresh(40)), (2, fresh(30) + " " + shared + " " + fresh(30)), (3, None), (4, ""),
            (5, "a b c"), (6, "a b c"), (None, shared), (7, shared), (7, shared), (8, LONG), (9, fresh(200))]
    got = collections.defaultdict(list)
    for r in paragraphs.dedup_paragraphs(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert got[1][0].n_removed == 0 and got[9][0].n_removed == 0 and got[5][0].n_removed == got[6][0].n_removed == 0
    assert got[3][0].text is None and got[None][0].n_removed == 0
    assert got[2][0].n_removed > 0.4 * len(shared) and 1 in got[2][0].repeats
    assert len(got[7]) == 2 and all(r.n_removed > 0.4 * len(shared) for r in got[7])
    assert paragraphs.dedup_paragraphs(docs(spark, rows).limit(0)).count() == 0
    bands, size = paragraphs.tune(0.8)
    assert 1 - (1 - 0.8 ** size) ** bands >= 0.995


def brute_paragraphs(rows):
    """Texts left when every pair of paragraphs is compared: lines of five words or more, and the pieces of long ones."""
    spans = []
    for i, t in rows:
        p = paragraphs.Paragraphs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        found = {(int(a), int(z)): (int(h), bool(x)) for a, z, h, x in zip(p.start, p.stop, p.head, p.is_line)}
        at = 0
        for line in t.split("\n"):
            if len(line.split()) >= 5:                  # each such line is there as a whole
                assert any(t[a:z].strip().startswith(line.strip()) and a == at + len(line) - len(line.lstrip()) for a, z in found)
                assert found[next((a, z) for a, z in found if found[a, z] == (at + len(line) - len(line.lstrip()), True))]
            if 5 <= len(line.split()) <= paragraphs.LONG:
                assert len([a for a, z in found if at <= a < at + len(line)]) == 1
            at += len(line) + 1
        spans += [(i, a, z, *found[a, z], t[a:z].lower().split("\n")[0].split()) for a, z in sorted(found)]
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for *_, w in spans]
    label = list(range(len(spans)))
    for a in range(len(spans)):
        for b in range(a):
            if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    first = lambda units: {x: min((s[0], s[2], s[1]) for s, y in units if y == x) for _, x in units}
    later = lambda units, f: [(s, x) for s, x in units if (s[0], s[1]) >= f[x][:2]]
    units = list(zip(spans, label))
    lines = [u for u in units if u[0][4]]
    gone = later(lines, first(lines))
    cut = {(s[0], s[3]) for s, _ in gone}
    units = [u for u in units if (u[0][0], u[0][3]) not in cut]
    stays = first(units)
    held = collections.Counter(x for _, x in units)
    stays = {x: f for x, f in stays.items() if held[x] > 1}
    for s, x in later([u for u in units if u[1] in stays], stays):
        if not any(i == s[0] and a < s[2] and s[1] < z for i, z, a in stays.values()):
            gone.append((s, x))
    bytes_ = collections.defaultdict(set)
    for s, _ in gone:
        bytes_[s[0]].update(range(s[1], s[2]))
    return {i: "".join(c for k, c in enumerate(t) if k not in bytes_[i]) for i, t in rows}


def test_paragraphs_lose_no_text(spark):
    """A near copy that goes is no place where a passage of another class stays."""
    rng = np.random.default_rng(3)
    fresh = lambda n: " ".join(f"v{rng.integers(10**9)}" for _ in range(n))
    a, p, q, x, y = fresh(200), fresh(20), fresh(20), fresh(40), fresh(40)
    rows = [(1, f"{a} {q}"), (2, f"{a} {p}"), (3, f"{x} {p} {y}"), (4, p)]
    got = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(docs(spark, rows)).collect()}
    # the ends of P are cut otherwise inside other text, so some of its words stay twice
    assert got[1] == rows[0][1] and got[2] == "" and p in got[3] and len(got[4]) < 0.5 * len(p)
    assert paragraphs.dedup_paragraphs(docs(spark, rows).withColumn("repeats", F.lit("clash"))).count() == 4
    # long lines that share pieces: whatever goes, each word of the input stays somewhere
    for seed in range(3):
        rng = np.random.default_rng(seed)
        parts = [fresh(int(n)) for n in rng.integers(14, 60, 8)]
        rows = [(i, "\n".join(" ".join(parts[j] for j in rng.choice(8, int(rng.integers(1, 5)), replace=False)) for _ in range(2))) for i in range(12)]
        left = " ".join(r.text for r in paragraphs.dedup_paragraphs(docs(spark, rows)).collect()).split()
        lost = set(" ".join(t for _, t in rows).split()) - set(left)
        assert len(lost) <= 0.02 * len(set(" ".join(parts).split())), (seed, len(lost))


def test_paragraphs_that_share_one_shingle_only_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shared = "one two three four five"
    rows = [(i, " ".join([shared, *(f"w{x}" for x in rng.choice(500, 6, replace=False))])) for i in range(60)]
    rows += [(100 + i, t + " more") for i, t in rows[:10]]
    compared, real = [], paragraphs._sets
    monkeypatch.setattr(paragraphs, "_sets", lambda docs_, nodes: compared.append(nodes.count()) or real(docs_, nodes))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in paragraphs.dedup_paragraphs(table).collect() if r.n_removed}
    assert got == set(range(100, 110))
    assert max(compared) < 40
    # and the same where no more ids are broadcast than one
    monkeypatch.setattr(paragraphs, "BROADCAST_IDS", 1)
    assert {r.doc_id for r in paragraphs.dedup_paragraphs(table).collect() if r.n_removed} == got


def test_paragraph_sizes_and_parities_count_different_shingles():
    text = ("a b c d e a b c d e a b c d e\n" + "x y z u v w q r s t k l m n o p a b c d e f g\n" * 2).encode()
    p = paragraphs.Paragraphs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for low, high, n, odd in zip(p.low, p.high, p.sizes(), p.parities().view(np.uint64)):
        own = {int(x) for x in p.shingles[low:high]}
        want = 0
        for x in own:
            want ^= 1 << (x >> 58)
        assert (int(n), int(odd)) == (len(own), want)


def test_postings_are_shuffled_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(paragraphs, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "doc long, text string")
        paragraphs._members(paragraphs._postings(table, 4, 1), 4, 5)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plans[0].count("MapInArrow") == 1 and plans[0].count("ReusedExchange") == 1


def test_paragraphs_against_all_pairs(spark):
    rng = np.random.default_rng(12)
    fresh = lambda n: " ".join(f"v{rng.integers(10**9)}" for _ in range(n))
    common = [fresh(n) for n in (3, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 12, 13, 15, 20, 25, 40, 70, 100)]
    rows = []
    for i in range(24):
        lines = [fresh(int(rng.integers(3, 30))) for _ in range(3)]
        for c in rng.choice(len(common), 6):
            words = common[c].split()
            if len(words) >= 40 and rng.random() < 0.5:
                words[int(rng.integers(len(words)))] = fresh(1)          # a near copy
            if len(words) >= 40 and rng.random() < 0.3:
                words = fresh(8).split() + words + fresh(9).split()      # a passage in other text
            lines.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        rows.append((i, "\n".join(rng.permutation(lines))))
    rows.append((90, common[17] + " " + common[17]))                     # repeats itself
    want = brute_paragraphs(rows)
    got = {r.doc_id: r.text for r in paragraphs.dedup_paragraphs(docs(spark, rows)).collect()}
    assert got == want
    first = set()
    for i, _ in rows:                                   # of the short common lines only the first copies are left
        for c in common[2:12]:
            assert not (c.lower() in got[i].lower() and c in first)
            first |= {c} if c.lower() in got[i].lower() else set()


def brute_windows(docs_, items, size=10):
    import re
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    found = collections.defaultdict(lambda: (set(), set()))
    windows = [(i, w[j:j + size]) for i, t in items for w in [cut(t)] if w for j in range(max(1, len(w) - size + 1))]
    out = []
    for d, t in docs_:
        w = cut(t)
        hit, named = set(), set()
        for i, q in windows:
            for a in range(len(w) - len(q) + 1):
                if w[a:a + len(q)] == q:
                    hit.update(range(a, a + len(q)))
                    named.add(str(i))
        out.append((d, len(w), len(hit), tuple(sorted(named))))
    return collections.Counter(out)


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(14))
    items = [(1, item), (2, "short one"), (3, None), (4, "..."), (5, item), (10, "again again again")]
    rows = [(1, "x " + item + " y"), (2, item.upper()), (3, " ".join(item.split()[:9])), (4, None), (5, ""), (None, "a short, one."),
            (6, "short one short one"), (6, "short two"), (7, "again " * 6), (8, LONG + " " + item + " " + LONG), (9, item.replace("q5", "z"))]
    table = docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(table, bench).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute_windows(rows, items)
    assert decontam.contamination(table.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in decontam.contamination(table, bench.limit(0)).collect())
    near = decontam.contamination(spark.createDataFrame([(1, item.replace("q5", "and q5"))], "doc_id long, text string"), bench, slack=1)
    assert near.first().n_hit >= 10                     # a proximity match
    saved = decontam.BROADCAST_TERMS
    try:
        decontam.BROADCAST_TERMS = 0                    # the vocabulary is too large to be broadcast
        whole = decontam.contamination(table, bench).collect()
    finally:
        decontam.BROADCAST_TERMS = saved
    assert collections.Counter(map(str, whole)) == collections.Counter(map(str, got))


def brute_bytes(rows, size):
    starts = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        starts.update(b[j:j + size] for j in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if starts[b[j:j + size]] > 1:
                gone[j:j + size] = b"\1" * size
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])),
                    bytes(x for x, g in zip(b, gone) if not g)))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [None, 1])
def test_repeated_bytes(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(1)
    fresh = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared = fresh(600)
    rows = [(1, fresh(300) + shared + fresh(200)), (2, shared + fresh(500)), (3, None), (4, ""), (5, "a" * 399), (6, "ab" * 500), (7, "é" * 250),
            (None, fresh(100) + shared[:450]), (8, fresh(2000)), (8, fresh(2000)), (9, shared[200:599]), (10, fresh(900)), (11, shared[50:460] + shared[:410])]
    rows += [(12, rows[-2][1]), (12, rows[-2][1])]
    got = suffix_dedup.cut_repeats(docs(spark, rows).repartition(3), size=400).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_bytes(rows, 400)
    assert suffix_dedup.cut_repeats(docs(spark, rows).limit(0)).count() == 0


def test_repeats_settled_by_copies_and_joined_spans(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fresh = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    twice, shared = fresh(3000), fresh(900)
    asked, real = [], suffix_dedup.bodies
    monkeypatch.setattr(suffix_dedup, "bodies", lambda docs_, kinds, size: asked.append(kinds.count()) or real(docs_, kinds, size))
    for rows, open_ in (([(1, twice), (2, twice), (3, twice)], False),
                        ([(1, twice), (2, twice), (3, fresh(50) + shared + fresh(50)), (4, shared + fresh(900) + shared)], True)):
        table = spark.createDataFrame(rows, "doc long, text string")
        found = {r.doc: [tuple(x) for x in r.spans] for r in suffix_dedup.repeated_spans(table.repartition(2)).collect()}
        for i, _, gone, runs, _ in brute_bytes(rows, 400):
            spans = found[i]
            assert len(spans) == runs and sum(b - a for a, b in spans) == gone
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        assert (asked[-1] > 0) == open_


def test_transform_against_counting():
    rng = np.random.default_rng(0)
    for _ in range(40):
        size = int(rng.integers(2, 9))
        bodies = [bytes(rng.integers(97, 100, int(rng.integers(size, 40))).astype(np.uint8)) for _ in range(int(rng.integers(1, 12)))]
        copies = rng.integers(1, 3, len(bodies))
        total = collections.Counter()
        for b, c in zip(bodies, copies):
            for i in range(len(b) - size + 1):
                total[b[i:i + size]] += int(c)
        for b, found in zip(bodies, suffix_dedup.repeated_starts(bodies, copies, size)):
            assert sorted(i for a, z in found for i in range(a, z)) == [i for i in range(len(b) - size + 1) if total[b[i:i + size]] > 1]


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = {"en": ["the", "with", "house", "garden"], "de": ["und", "schön", "garten", "haus"]}
    item = " ".join(f"exam{i}" for i in range(12))
    rows = [(i, " ".join(rng.choice(words[lang], 12)) + f" only{i} here{i}\nline {i} of its own{i}", lang, "s", 1)
            for i, lang in ((i, "en" if i % 2 else "de") for i in range(60))]
    base = rows[1][1]
    rows += [(100, base, "en", "s", 1), (101, None, "en", "s", 1), (102, "123 !", "en", "s", 1), (103, "we the house with " + item, "en", "s", 1),
             (None, "the house with garden and nothing else in it at all", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    place = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, place).collect()}
    assert not {100, 101, 102, 103} & set(got)          # a copy, no text, no letter, a benchmark item
    assert {None, *range(60)} <= set(got)
    assert all(r.n_tokens == len(r.ids) for r in got.values())
    by_id = {v: k for k, v in RANKS.items()}
    assert all(b"".join(by_id[i] for i in r.ids).decode() == r.text for r in got.values())
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, place).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame(rows, schema), place).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_joins_texts_not_keys(spark):
    rng = np.random.default_rng(8)
    fresh = lambda: " ".join(f"v{rng.integers(10**9)}" for _ in range(20))
    a, b, c, d = (fresh() for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, d), (None, c), (None, a + " end"), (4, b)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.join_ngrams(spark, table, "").collect())
    assert got == sorted([(1, a), (2, b), (3, c), (3, d)])
