"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line's set is its distinct words (A-Z lower-cased, cut at white space). A line is removed if an
earlier line, by (key, line number), has the same set or a Jaccard similarity of num/den or more;
the earlier line need not itself stay. Everything is decided on the input.

Lines with equal sets are settled by their digests. The others order their words by rarity, and
post the first n - ceil(t n) + 1: similar lines share one of them. Candidates pass the length
filter (sizes), the positional filter (words left after the shared one), a bitmap filter (64
parities a line, which differ for words not shared only) and the prefix filter (how many posted
words they share), then the sets themselves are compared. Each line first meets the earliest line
of its lists, which settles groups of near copies; only lines that this leaves meet all earlier
lines of their lists.

Rarity is a count over all lines in a fixed number of buckets of the word's hash: a row of
``BUCKETS`` numbers whatever the input. Any common order is exact, so a bucket shared by two words
costs time only. Removed line numbers are joined with the documents by broadcast while they belong
to at most ``BROADCAST_DOCS`` documents, and by a shuffle beyond.

Defined cases: null text stays null, and has no lines; lines without words stay; lines of rows with
a null key neither go nor remove others; rows that share a key are compared line number by line
number, and the same line number of the same key is not earlier than itself. Columns other than key
and text pass through; columns named like outputs are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, discard, free_shuffles

BUCKETS = 1 << 16
BROADCAST_DOCS = 1_000_000
SPACES = "\t\x0b\x0c\r"
BREAK = "\n"


def plain_words(line: Column) -> Column:
    """The distinct words of a line, as text."""
    lowered = F.translate(line, string.ascii_uppercase + SPACES, string.ascii_lowercase + " " * len(SPACES))
    return F.array_distinct(F.array_remove(F.split(lowered, " ", -1), ""))


def hashed_lines(docs: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(doc, no, words, n): every line that has words, as the distinct hashes of its words."""
    lines = docs.filter("doc is not null")
    if gone is not None:
        lines = lines.join(light(gone), "doc", "left")
    lines = lines.select("doc", *(["nos"] if gone is not None else []), F.posexplode(F.split("text", BREAK, -1)).alias("no", "line"))
    if gone is not None:
        lines = lines.filter(~F.coalesce(F.array_contains("nos", F.col("no")), F.lit(False)))
    lowered = F.translate("line", string.ascii_uppercase + SPACES, string.ascii_lowercase + " " * len(SPACES))
    words = F.array_distinct(F.transform(F.array_remove(F.split(lowered, " ", -1), ""), lambda w: F.xxhash64(w)))
    return lines.select("doc", "no", words.alias("words")).withColumn("n", F.size("words")).filter("n > 0")


def light(table: DataFrame) -> DataFrame:
    """To be broadcast by a join if it has at most ``BROADCAST_DOCS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_DOCS else table


def by_document(lines: DataFrame) -> DataFrame:
    """(doc, nos) as a table."""
    return cut_lineage(lines.groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("nos")))


def equal_sets(docs: DataFrame) -> DataFrame:
    """(doc, nos) of the lines whose set an earlier line has. Digests are counted with map-side
    merging, and only those held twice are joined back."""
    digest = cut_lineage(hashed_lines(docs).withColumn("words", F.sort_array("words")).select(
        "doc", "no", F.xxhash64("words").alias("d1"), F.xxhash64(F.reverse("words"), "n").alias("d2")))
    firsts = (digest.groupBy("d1", "d2").agg(F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("copies"))
              .filter("copies > 1").drop("copies"))
    gone = by_document(digest.join(firsts, ["d1", "d2"]).filter(F.struct("doc", "no") > F.col("first")))
    discard(digest)
    return gone


def rarity(lines: DataFrame) -> bytes:
    """For each bucket a step, 0 to 127, on a logarithmic scale of how many lines have its words."""
    counts = (lines.select(F.explode(F.transform("words", lambda w: F.pmod(w, F.lit(BUCKETS)))).alias("id"))
              .groupBy("id").agg(F.count("*").alias("c"))
              .select("id", F.least(F.lit(127), F.floor(F.log2(F.col("c") + 1) * 4)).cast("int").alias("step")))
    out = bytearray(BUCKETS)
    for r in counts.collect():
        out[r.id] = r.step
    return bytes(out)


def prefixes(lines: DataFrame, steps: bytes, num: int, den: int) -> DataFrame:
    """(key, doc, no, n, place, odd): the first n - ceil(t n) + 1 words of each line, rare words first. The bits of
    odd tell which of 64 buckets hold an odd number of the line's words."""
    table = F.lit(bytearray(steps))

    def rank(w: Column) -> Column:
        step = F.ascii(F.substring(table, (F.pmod(w, F.lit(BUCKETS)) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.shiftleft(step.cast("long"), 56).bitwiseOR(w.bitwiseAND(F.lit((1 << 56) - 1)))

    first = F.slice(F.sort_array(F.transform("words", rank)), F.lit(1),
                    F.expr(f"cast(n - ceil({num} * n / {den}) + 1 as int)"))
    odd = F.aggregate("words", F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(w, 58).cast("int"))))
    # below the generator, so once a line and not once a word
    return lines.withColumn("odd", odd).select("doc", "no", "n", "odd", F.posexplode(first).alias("place", "word")) \
        .select(F.hash("word").alias("key"), "doc", "no", "n", "place", "odd")


def fits(num: int, den: int) -> Column:
    """Length, positional and bitmap filter for a pair of postings a and b: the first two words that similar
    lines share leave room in both for the rest of the overlap, and each bucket that is odd in one line only
    has a word that the other lacks."""
    need = f"ceil({num} * (a.n + b.n) / {num + den})"
    return F.expr(f"{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) and "
                  f"least(a.n - a.place, b.n - b.place) + 1 >= {need} and bit_count(a.odd ^ b.odd) <= a.n + b.n - 2 * {need}")


def similar(docs: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of lines whose sets reach the similarity; lines are read from the documents."""
    pairs = cut_lineage(pairs.select("a", "b"))
    asked = by_document(pairs.select(F.explode(F.array("a", "b")).alias("x")).select("x.doc", "x.no").distinct())
    read = (docs.join(light(asked), "doc").select("doc", F.explode("nos").alias("no"), F.split("text", BREAK, -1).alias("lines"))
            .filter(F.col("no") < F.size("lines"))
            .select(F.struct("doc", "no").alias("line"), plain_words(F.col("lines")[F.col("no")]).alias("words")))
    common = F.size(F.array_intersect("x", "y"))
    return cut_lineage(
        pairs.join(read.select(F.col("line").alias("a"), F.col("words").alias("x")), "a")
        .join(read.select(F.col("line").alias("b"), F.col("words").alias("y")), "b")
        .filter(den * common >= num * (F.size("x") + F.size("y") - common)).select("a", "b"))


def similar_lines(docs: DataFrame, gone: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, no) of lines, other than those gone, that are similar to an earlier line."""
    lines = hashed_lines(docs, gone)
    steps = rarity(lines)
    postings = prefixes(lines, steps, num, den)
    at = F.struct("doc", "no", "n", "place", "odd")
    # postings are made and shuffled once: a list and its earliest line come from the same sorted rows
    of_list = Window.partitionBy("key")
    members = cut_lineage(postings.withColumn("held", F.count("*").over(of_list)).withColumn("low", F.min(at).over(of_list))
                          .filter("held > 1").drop("held"))
    free_shuffles(docs.sparkSession)

    met = (members.select(F.col("low").alias("a"), at.alias("b"))
           .filter((F.struct("a.doc", "a.no") < F.struct("b.doc", "b.no")) & fits(num, den))
           .groupBy(F.struct("a.doc", "a.no").alias("a"), F.struct("b.doc", "b.no").alias("b")).agg(F.count("*").alias("shared"))
           .withColumn("best", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "a"))).filter("best = 1"))
    first = cut_lineage(similar(docs, met, num, den).select("b.doc", "b.no").distinct())
    free_shuffles(docs.sparkSession)

    open_ = members.join(first, ["doc", "no"], "left_anti").select("key", *("doc no n place odd".split()))
    a, b = members.select("key", "doc", "no", "n", "place", "odd").alias("a"), open_.alias("b")
    rest = (a.join(b, F.expr("a.key = b.key and (a.doc < b.doc or (a.doc = b.doc and a.no < b.no))") & fits(num, den))
            .groupBy(F.struct("a.doc", "a.no").alias("x"), F.struct("b.doc", "b.no").alias("y"), F.col("a.n").alias("nx"),
                     F.col("b.n").alias("ny")).agg(F.count("*").alias("shared"))
            # of two similar lines the one whose prefix ends first shares this many of its posted words
            .filter(F.expr(f"shared >= least(2, ceil({num} * (nx + ny) / {num + den}) - ceil({num} * greatest(nx, ny) / {den}) + 1)"))
            .select(F.col("x").alias("a"), F.col("y").alias("b")))
    second = similar(docs, rest, num, den).select("b.doc", "b.no").distinct()
    out = cut_lineage(first.unionByName(second))
    discard(members, first)
    free_shuffles(docs.sparkSession)
    return out


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(doc, nos): the numbers, from 0, of the lines to remove from each document (doc, text)."""
    gone = equal_sets(docs)
    more = similar_lines(docs, gone, num, den)
    return by_document(gone.select("doc", F.explode("nos").alias("no")).unionByName(more))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """The columns of ``df``, its text without the removed lines, then n_lines and n_removed."""
    gone = removed_lines(df.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")), num, den)
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    lines = F.split(F.col(f"t.`{text}`"), BREAK, -1)
    stay = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("g.nos", i)), BREAK)
    joined = df.select(*[f"`{c}`" for c in kept]).alias("t").join(light(gone).alias("g"), F.col(f"t.`{key}`") == F.col("g.doc"), "left")
    return joined.select(
        *[F.when(F.col("g.nos").isNull(), F.col(f"t.`{c}`")).otherwise(stay).alias(c) if c == text else F.col(f"t.`{c}`")
          for c in kept],
        F.when(F.col(f"t.`{text}`").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("g.nos").isNull(), 0).otherwise(F.size("g.nos")).cast("long").alias("n_removed"))
