"""Exact quantiles with bounded memory.

``percentile`` keeps every distinct value of a column in one buffer, which is fine up to a few million
values in all and hopeless beyond. Larger tables are searched digit by digit: the bits of a double, with
the sign turned, order like its value, so counting how many values have each leading digit tells the
digit of a wanted rank, and the next scan looks only at values that begin with the digits found. All
columns and ranks take part in the same scans: there are ``64 / BITS`` of them whatever the table holds.
A task passes on counts, never values, and equal values need no care.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .columns import CHUNK, aggregate_row, as_double, chunks, long_form

IN_MEMORY_VALUES = 2_000_000
LONG_VALUES = 50_000_000
BITS = 11
HELD = 1 << 23          # counts that a task holds before it passes them on


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    in_memory: int = IN_MEMORY_VALUES) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles of each column; ``None`` for a column without values."""
    cols = list(cols)
    if not cols:
        return {}
    counts = {c: m["n"] for c, m in aggregate_row(df, cols, {"n": F.count}).items()}
    out: dict[str, list[float] | None] = {c: None for c in cols}
    some = [c for c in cols if counts[c]]
    if not some:
        return out
    array = F.array(*[F.lit(float(p)) for p in probs])
    if max(counts.values()) <= in_memory and sum(counts.values()) <= min(LONG_VALUES, in_memory * CHUNK):
        if len(some) > CHUNK:
            found = long_form(df.select(*[as_double(c).alias(c) for c in some]), some) \
                .groupBy("pos").agg(F.percentile("value", array).alias("p")).collect()
            out.update({some[r.pos]: list(r.p) for r in found})
        else:
            row = df.agg(*[F.percentile(as_double(c), array).alias(f"p{i}") for i, c in enumerate(some)]).first()
            out.update({c: list(row[f"p{i}"]) for i, c in enumerate(some)})
        return out
    ranks = {c: [(counts[c] - 1) * p for p in probs] for c in some}
    wanted = sorted({(i, r) for i, c in enumerate(some) for at in ranks[c] for r in (math.floor(at), math.ceil(at))})
    found = _order_statistics(df, some, wanted)
    for i, c in enumerate(some):
        low = [(found[i, math.floor(at)], found[i, math.ceil(at)], at - math.floor(at)) for at in ranks[c]]
        out[c] = [x + (y - x) * part for x, y, part in low]
    return out


def ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    bits = np.ascontiguousarray(values, dtype=np.float64).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def from_ordered(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _order_statistics(df: DataFrame, cols: list[str], wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """{(column, rank): value}, ranks from 0."""
    values = df.select(*[as_double(c).alias(f"v{i}") for i, c in enumerate(cols)])
    prefix = {w: 0 for w in wanted}             # the digits found so far
    below = {w: 0 for w in wanted}              # how many values begin with smaller ones
    shift = 64
    while shift:
        bits = min(BITS, shift)
        shift -= bits
        nodes = sorted({(c, prefix[c, r]) for c, r in wanted})
        counted = values.mapInArrow(_digits(nodes, shift, bits), "node int, digit int, n long") \
            .groupBy("node", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        number = {node: i for i, node in enumerate(nodes)}
        asked = df.sparkSession.createDataFrame([(number[c, prefix[c, r]], c, r, r - below[c, r]) for c, r in wanted],
                                                "node int, col int, rank long, inside long")
        # of the digits of a node, the one in which the rank falls: one row per rank comes back
        hit = (counted.withColumn("upto", upto).join(F.broadcast(asked), "node")
               .filter("upto > inside and upto - n <= inside").select("col", "rank", "digit", (F.col("upto") - F.col("n")).alias("before")))
        for r in hit.collect():
            w = (r.col, r["rank"])
            prefix[w] = prefix[w] << bits | r.digit
            below[w] += r.before
    return {w: from_ordered(prefix[w]) for w in wanted}


def _digits(nodes: list[tuple[int, int]], shift: int, bits: int):
    """Counts of the next digit among the values of each node, a column and the digits before."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def passed() -> pa.RecordBatch:
            at = [(i, np.flatnonzero(n)) for i, n in held.items()]
            digit = np.concatenate([d for _, d in at]) if at else np.zeros(0, np.int64)
            node = np.repeat([i for i, _ in at], [len(d) for _, d in at]) if at else digit
            n = np.concatenate([held[i][d] for i, d in at]) if at else digit
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(digit, pa.int32()), pa.array(n, pa.int64())],
                                              ["node", "digit", "n"])

        for batch in batches:
            last, keys = -1, None
            for i, (c, known) in enumerate(nodes):
                if c != last:
                    column = batch.column(c)
                    keys, last = ordered(column.drop_null().to_numpy(zero_copy_only=False)) >> np.uint64(shift), c
                own = keys if shift + bits == 64 else keys[keys >> np.uint64(bits) == np.uint64(known)]
                n = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size)
                held[i] = held[i] + n if i in held else n
                if len(held) * size > HELD:
                    yield passed()
        yield passed()

    return run


def grouped_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float],
                      groups: Sequence, in_memory: int = IN_MEMORY_VALUES) -> dict:
    """{group: quantiles} for a bounded list of groups.

    Each group becomes one masked column, so a group that holds most of the rows costs the
    same bounded passes as any other and is never gathered in one task.
    """
    out = {}
    for part in chunks(list(groups), 50):
        masked = df.select(*[
            F.when(F.col(group) == F.lit(g), as_double(value)).alias(f"g{i}")
            for i, g in enumerate(part)])
        found = exact_quantiles(masked, masked.columns, probs, in_memory)
        out.update({g: found[f"g{i}"] for i, g in enumerate(part)})
    return out
