"""The registered queries of the corpus operators, with their DuckDB twins where SQL has one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from . import (ann, bpe, centroids, decontam, langid, line_dedup, ngram_join, paragraphs, periodic, suffix_dedup,
               token_counts, toxicity, warc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(documents(spark, sf_dir), ranks, decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 20 == 0, k=20)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = warc.with_revisits(table(spark, sf_dir, "pages"), "page_id", "html")
    warc.write_archives(rows, folder).agg(F.sum("records")).collect()
    return warc.read_archives(spark, folder).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_documents(documents(spark, sf_dir), k=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.dedup_paragraphs(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
                        (F.col("n_removed") > 0).alias("repeated"), "repeats")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.cut_repeats(documents(spark, sf_dir), size=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", size=64, k=40,
                              rounds=5, scale=256, seed="2:")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(periodic.with_periodic_tails(documents(spark, sf_dir)))
    best = F.col("longest")
    each = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
        best.period.alias("period"), F.floor(1000 * best.length / best.period).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(each, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP4 = rf"""
with line as (
    select doc_id, no, line, list_distinct(regexp_extract_all(translate(line, {AZ}), '[^\x20\x09-\x0D]+')) as w
    from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no
          from documents) t),
word as (select doc_id, no, len(w) as n, unnest(w) as s from line),
gone as (
    select b.doc_id, b.no
    from word a join word b on a.s = b.s and (a.doc_id, a.no) < (b.doc_id, b.no)
    where 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
    group by a.doc_id, a.no, b.doc_id, b.no, a.n, b.n
    having 5 * count(*) >= 4 * (a.n + b.n - count(*))),
kept as (
    select doc_id, count(*) as n_lines, count(*) filter (g.no is not null) as n_removed,
           sha256(coalesce(string_agg(line, chr(10) order by no) filter (g.no is null), '')) as kept_sha256
    from line left join (select distinct doc_id, no from gone) g using (doc_id, no) group by doc_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, kept_sha256
from documents left join kept using (doc_id)"""

OP5 = """
with page as (select page_id, coalesce(html, '') as body from pages),
named as (select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes, sha1(body) as payload_digest
          from page),
kept as (select payload_digest, max(page_id) as response from named where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest,
       case when response is null or response = page_id then 'response' else 'revisit' end as record_type,
       case when response <> page_id then response end as refers_to
from named left join kept using (payload_digest)"""

OP6 = rf"""
with recursive doc as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') as w
    from documents),
sh as (
    select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from doc where len(w) > 0) t),
size as (select doc_id, count(*) as n from sh group by doc_id),
pair as (select a.doc_id as u, b.doc_id as v, count(*) as c from sh a join sh b using (s)
         where a.doc_id < b.doc_id group by 1, 2),
link as (select u, v from pair join size x on u = x.doc_id join size y on v = y.doc_id
         where 100 * c >= 85 * (x.n + y.n - c)),
way as (select u, v from link union all select v, u from link),
reach as (
    select doc_id, doc_id as r from doc
    union
    select reach.doc_id, way.v from reach join way on reach.r = way.u)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from doc left join size using (doc_id) join (select doc_id, min(r) as component_id from reach group by doc_id) c using (doc_id)"""

OP9 = rf"""
with doc as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
item as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark),
win as (
    select distinct item_id, least(len(w), 10) as size,
           array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as phrase
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0) t),
occ as (
    select doc_id, start, size, array_to_string(w[start : start + size - 1], ' ') as phrase
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as start
          from doc, (select distinct size from win) s where len(w) >= size) t),
hit as (select distinct doc_id, start, size, item_id from occ join win using (phrase, size)),
covered as (
    select doc_id, count(distinct place) as n_hit
    from (select doc_id, unnest(range(start, start + size)) as place from hit) t group by doc_id),
named as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct doc_id, cast(item_id as varchar) as item from hit) t group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join covered using (doc_id) left join named using (doc_id)"""



def _assign(n: int) -> str:
    return f"""
a{n} as (
    select x.vec_id, x.v, arg_min(c.no, (d, c.no)) as cluster, min(d) as distance
    from (select x.vec_id, x.v, c.no, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
          from x cross join c{n} c) p join x using (vec_id) join (select no from c{n}) c using (no)
    group by 1, 2)"""


def _move(n: int) -> str:
    # integer division that rounds down
    return f"""
m{n} as (
    select cluster as no, i, sum(e)::bigint as s, count(*) as n
    from (select cluster, unnest(v) as e, generate_subscripts(v, 1) as i from a{n}) t group by 1, 2),
c{n + 1} as (
    select no, coalesce(w.v, c.v) as v
    from c{n} c left join (select no, list((s - ((s % n) + n) % n) // n order by i) as v from m{n} group by no) w using (no))"""


OP12 = f"""
with x as (
    select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as v
    from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: isfinite(e::double))) = 64),
c0 as (
    select row_number() over (order by sha256('2:' || vec_id)) - 1 as no, v
    from x order by sha256('2:' || vec_id) limit 40),
{",".join(_assign(i) + "," + _move(i) for i in range(5))},{_assign(5)}
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
       (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c5.v, ',')) as centroid_sha256
from a5 join c5 on cluster = no"""

OP13 = rf"""
with doc as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
           xor(4294967295, list_reduce(
               list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda s: ord(s)::bigint)),
               lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                          lambda y, u: xor(y >> 1, 3988292384 * (y & 1))))) as h
    from documents),
tail as (
    select doc_id, w, h, len(w) as n, case when len(w) > 0 then (h // 10) % len(w) end as a from doc),
word as (
    select doc_id, i, case when h % 10 = 0 and i >= a then w[1 + a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8))] else w[1 + i] end as s
    from (select *, unnest(range(n)) as i from tail) t),
same as (select a.doc_id, b.i - a.i as q, a.i from word a join word b on a.doc_id = b.doc_id and a.s = b.s and a.i < b.i),
stretch as (
    select doc_id, q, min(i) as start, count(*) + q as length
    from (select *, i - row_number() over (partition by doc_id, q order by i) as island from same) t
    group by doc_id, q, island),
run as (
    select doc_id, start, length, min(q) as period from stretch where length >= greatest(12, 2 * q)
    group by doc_id, start, length),
listed as (
    select doc_id, count(*) as n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as runs_sha256
    from run group by doc_id),
best as (select * from (select *, row_number() over (partition by doc_id order by length desc, start, period) as rk from run) t where rk = 1),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
kept as (
    select doc_id, sha256(string_agg(s, ' ' order by i)) as collapsed_sha256
    from word anti join gone using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
       coalesce(runs_sha256, sha256('')) as runs_sha256, coalesce(collapsed_sha256, sha256('')) as collapsed_sha256
from doc left join listed using (doc_id) left join best using (doc_id) left join kept using (doc_id)"""

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_permutation_index, op3_toxicity, op4_line_dedup, op5_warc, op6_ngram_join, op7_language_id, op8_paragraph_minhash, op9_decontamination, op10_suffix_dedup,
                                  op11_token_counts, op12_centroids, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op4_line_dedup": OP4, "op5_warc": OP5, "op6_ngram_join": OP6, "op9_decontamination": OP9, "op12_centroids": OP12,
                          "op13_periodic_runs": OP13}
