"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. In every block of the index the vectors
stand in inverted files, one per pivot, with the rank that the pivot has for them. A query adds up
over the files of its own pivots how far ranks differ (the footrule; a pivot missing on one side
counts as rank ``depth``), keeps the share of the block with the least footrule, and ranks those by
the exact inner product in double precision.

Every vector is indexed. Only the pivots come from a sample: the ``pivots`` distinct vectors with
the smallest hashes. Inner products become angles by one more coordinate, which fills every indexed
vector up to the largest length. Queries meet the index in blocks of both.

Equal vectors are one entry with their smallest ids, as many as a result can show, merged in each
batch before they move, so a vector that a third of all rows hold costs one entry. Rows whose
vector is null, zero, of another size than most, or has null or non-finite components take no part;
rows repeated with the same id count once; an empty table gives no rows. Ties go to the smaller id.
Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a list column as doubles; nulls become NaN."""
    values = column.flatten().cast(pa.float64())
    return np.asarray(values.fill_null(float("nan")).to_numpy(zero_copy_only=False)), \
        np.asarray(column.value_lengths().fill_null(0))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): rows that take part, the vector as the bytes of its doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = _flat(batch.column(1))
            values = values + 0.0                                   # -0.0 is 0.0
            ids, vectors, at = [], [], 0
            for key_, size in zip(batch.column(0).to_pylist(), sizes):
                own = values[at:at + size]
                at += size
                if key_ is not None and size and np.isfinite(own).all() and own.any():
                    ids.append(key_)
                    vectors.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["id", "vec"])

    rows = df.select(F.col(key).cast("long"), vector).mapInArrow(run, "id bigint, vec binary")
    sizes = rows.groupBy(F.octet_length("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.filter(F.octet_length("vec") == (sizes[0]["size"] if sizes else 0))


def distinct_vectors(rows: DataFrame, shown: int) -> DataFrame:
    """(rep, vec, ids): each vector once, with its ``shown`` smallest ids; rep is the smallest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, set[int]] = {}
            for id_, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(vec, set()).add(id_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array([sorted(x)[:shown] for x in held.values()],
                                                             pa.list_(pa.int64()))], ["vec", "ids"])

    return (rows.mapInArrow(run, "vec binary, ids array<bigint>").groupBy("vec")
            .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, shown).alias("ids"))
            .select(F.col("ids")[0].alias("rep"), "vec", "ids"))


def matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def permutations(y: np.ndarray, points: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each vector, nearest first, ties to the smaller pivot."""
    score = -(y @ points.T)
    # at least the depth nearest, ties of the last one included, then in order
    edge = np.partition(score, depth - 1, axis=1)[:, depth - 1:depth]
    score[score > edge] = np.inf
    return np.argsort(score, axis=1, kind="stable")[:, :depth].astype(np.int32)


class Block:
    """The inverted files of one block of the index: per pivot its rows and the rank it has for them."""

    def __init__(self, perm: np.ndarray, pivots: int):
        self.n, self.depth = perm.shape
        order = np.argsort(perm.ravel(), kind="stable")
        self.row, self.rank = (order // self.depth).astype(np.intp), (order % self.depth).astype(np.int32)
        self.bounds = np.searchsorted(perm.ravel()[order], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Sum over both sides' pivots of the difference in rank, less what two vectors without a shared
        pivot have, for every row of the block. Only the files of the query's own pivots are read."""
        files = [slice(self.bounds[p], self.bounds[p + 1]) for p in query]
        rows = np.concatenate([self.row[f] for f in files])
        # both missing sides counted first; a shared pivot replaces its two parts by the difference
        saved = np.concatenate([np.abs(self.rank[f] - mine) + self.rank[f] + (mine - 2 * self.depth)
                                for mine, f in enumerate(files)])
        return np.bincount(rows, weights=saved, minlength=self.n)


def indexed(entries: DataFrame, shared, depth: int) -> DataFrame:
    """The entries with ``perm``, the numbers of their nearest pivots as bytes: found once for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, longest = shared.value
        for batch in batches:
            perm = pa.array([], pa.binary())
            if batch.num_rows:
                x = matrix(batch.column("vec").to_pylist())
                rest = np.sqrt(np.maximum(0.0, longest ** 2 - (x * x).sum(1)))
                perm = pa.array([p.tobytes() for p in permutations(np.column_stack([x, rest]), points, depth)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, perm], [*batch.schema.names, "perm"])

    return entries.select("rep", "vec", "ids").mapInArrow(run, "rep bigint, vec binary, ids array<bigint>, perm binary")


def search(df: DataFrame, key: str, vector: str, is_query, k: int = 20, pivots: int = 256, depth: int = 48,
           share: float = 0.2, least: int = 300, index_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row for which the
    condition ``is_query`` on id holds. ``share`` of each block, and ``least`` rows at least, are ranked exactly."""
    spark = df.sparkSession
    rows = cut_lineage(usable(df, key, vector))
    entries = cut_lineage(distinct_vectors(rows, k + 1))
    sample = entries.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(pivots).collect()
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total = entries.count()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1)).max())])], ["length"])

    longest = entries.select("vec").mapInArrow(lengths, "length double").agg(F.max("length")).first()[0]
    points = matrix([bytes(r.vec) for r in sample])
    rest = np.sqrt(np.maximum(0.0, longest ** 2 - (points * points).sum(1)))
    shared = spark.sparkContext.broadcast((np.column_stack([points, rest]), longest))
    depth = min(depth, len(sample))
    index = cut_lineage(indexed(entries, shared, depth))
    blocks = -(-total // index_rows)

    asked = rows.filter(is_query(F.col("id"))).distinct()
    named = cut_lineage(asked.join(entries.select("vec", "rep"), "vec").select("id", "rep", "vec"))
    queries = named.select("rep", "vec").distinct()
    parts = max(1, -(-queries.count() // query_rows))
    part_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = (index.withColumn("block", part_of("rep", blocks))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    right = (queries.withColumn("part", part_of("rep", parts))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def compare(index: pa.Table, asking: pa.Table) -> pa.Table:
        out_q, out_row, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if index.num_rows and asking.num_rows:
            points, _ = shared.value
            x, y = matrix(index["vec"].to_pylist()), matrix(asking["vec"].to_pylist())
            rep = np.asarray(index["rep"])
            files = Block(np.frombuffer(b"".join(index["perm"].to_pylist()), np.int32).reshape(len(x), -1), len(points))
            keep = min(len(x), max(least, int(share * len(x))) + 1)
            # queries are not filled up
            near = permutations(np.column_stack([y, np.zeros(len(y))]), points, depth)
            for q, perm, vec in zip(asking["rep"].to_pylist(), near, y):
                chosen = np.argpartition(files.footrule(perm), keep - 1)[:keep] if keep < len(x) else np.arange(len(x))
                score = (x[chosen] * vec).sum(1)
                if k + 1 < len(chosen):                             # the best, ties of the last one included
                    high = score >= -np.partition(-score, k)[k]
                    chosen, score = chosen[high], score[high]
                best = np.lexsort((rep[chosen], -score))[:k + 1]
                out_q.append(np.full(len(best), q))
                out_row.append(chosen[best])
                out_s.append(score[best])
        row = np.concatenate(out_row)
        names = index["ids"].combine_chunks().take(pa.array(row)) if len(row) else pa.array([], pa.list_(pa.int64()))
        size = np.asarray(names.value_lengths(), np.int64)
        return pa.table({"rep": pa.array(np.repeat(np.concatenate(out_q), size), pa.int64()), "vec_id": names.flatten(),
                         "score": pa.array(np.repeat(np.concatenate(out_s), size), pa.float64())})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        compare, "rep bigint, vec_id bigint, score double")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    # k + 1, as one of them may be the query itself
    kept = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    own = Window.partitionBy("query_id").orderBy("at")
    return (named.select(F.col("id").alias("query_id"), "rep").join(kept, "rep")
            .filter(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
