"""Documents to training tokens: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns they came
with; the last returns tokens. The columns doc_id, text, lang, source and n_chars are needed; others pass
through unchanged, whatever their names, up to the last stage. Null keys and repeated rows are documents
like others. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomstat.llm import bpe, decontam, langid, line_dedup, ngram_join
from loomstat.llm.linking import within_broadcast
from loomstat.llm.toxicity import fold
from loomstat.session import cut_lineage

BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold about ``BATCH_BYTES`` instead of 10,000 rows whatever their
    length: the operators take texts in slices of 2 MB at most, so larger batches only take memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; those without text or letters go. The model learns from the
    labelled documents of the folds that op7 learns from. Without any label nothing can be judged, and
    all documents with a letter would be unknown, so then all stay."""
    small_batches(spark)
    labelled = docs.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    model = langid.fit(labelled)
    if not model.langs:
        return docs
    found = langid.predict(docs, model, out="__lang", score="__score")
    return found.filter(F.col("__lang") != langid.UNKNOWN).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; those left with no word go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")))
    kept = found.filter((F.col("n_removed") == 0) | (F.length(F.regexp_replace("text", r"\s+", "")) > 0))
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("others.n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else length.alias(c) if c == "n_chars"
                         else F.col("others").getField(c).alias(c) for c in docs.columns])


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, that
    with the smallest key, a null key last. Each different pair of key and text is a document."""
    name = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    found = ngram_join.similar_documents(docs.select(name.alias("name"), "text"), key="name", k=5, num=80, den=100)
    named = docs.select(name.alias("name"), "doc_id").join(found.select("name", "component_id").distinct(), "name")
    first = cut_lineage(named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name")).alias("first"))
                        .select(F.col("first.name").alias("name")))
    kept = docs.select(name.alias("name"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) \
        .join(within_broadcast(first), "name", "left_semi").dropDuplicates(["name"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    name = F.xxhash64("doc_id", "text")
    found = decontam.contamination(docs.select(name.alias("name"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="name")
    bad = cut_lineage(found.filter("n_hit > 0").select(F.col("name").alias("bad")).distinct())
    whole = docs.select(name.alias("bad"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(within_broadcast(bad), "bad", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Per document its key, language and source, the ids and byte offsets of its tokens, and the text
    that the ids decode to."""
    small_batches(spark)
    if ranks_path is None:
        import public_tokenizers
        ranks_path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(ranks_path)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets",
                        F.col("decoded").cast("string").alias("text"))


STAGES = [("language ID", identify_language), ("line dedup", dedup_lines), ("n-gram Jaccard join", join_ngrams),
          ("benchmark decontamination", decontaminate), ("byte-level BPE", encode_tokens)]

# SQL can express neither the language model nor the tokenizer; tests/llm compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
