import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import columns, quantiles, ranking
from loomstat.operators import clean


@pytest.mark.parametrize("kind", ["spread", "two values", "half equal", "constant"])
def test_narrowing_gives_the_exact_quantile(spark, kind):
    rng = np.random.default_rng(1)
    x = {"spread": rng.lognormal(size=5000), "two values": np.repeat([0.0, 1.0], 2500),
         "half equal": np.concatenate([np.full(2500, 3.0), rng.normal(3, 1, 2500)]),
         "constant": np.full(500, 7.0)}[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "v double").unionByName(
        spark.createDataFrame([(None,)] * 5, "v double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, ["v"], probs, in_memory=10)["v"]
    assert np.allclose(got, np.quantile(x, probs))
    assert np.allclose(quantiles.exact_quantiles(df, ["v"], probs)["v"], np.quantile(x, probs))


def test_doubles_keep_their_order_as_numbers():
    x = np.array([-np.inf, -1e300, -1.5, -1e-300, 0.0, 5e-324, 2.0, 1e300, np.inf])
    keys = quantiles.ordered(x)
    assert (np.diff(keys.astype(object)) > 0).all() and [quantiles.from_ordered(int(k)) for k in keys] == x.tolist()


def test_quantiles_take_the_same_scans_for_any_number_of_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 500)) * rng.choice([1e-3, 1, 1e9], size=500)
    wide = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").select(
        *[F.col("v")[j].alias(f"c{j}") for j in range(500)])

    def jobs(df, cols):
        spark.sparkContext.setJobGroup("quantiles", "quantiles")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles"))
        found = quantiles.exact_quantiles(df, cols, [0.25, 0.5, 0.9], in_memory=10)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles")) - before

    few, some = jobs(wide.select("c0", "c1"), ["c0", "c1"])
    many, all_ = jobs(wide, wide.columns)
    assert all_ <= some + 2
    for j in range(500):
        assert np.allclose(many[f"c{j}"], np.quantile(x[:, j], [0.25, 0.5, 0.9]))
    assert few["c1"] == many["c1"]


def test_quantiles_of_a_column_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert quantiles.exact_quantiles(df, ["a", "b"], [0.5]) == {"a": None, "b": [1.0]}


def test_grouped_quantiles_when_one_group_holds_most_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(0, float(v)) for v in rng.normal(size=900)] + [(1, float(v)) for v in rng.normal(size=50)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = quantiles.grouped_quantiles(df, "g", "v", [0.25, 0.5], [0, 1], in_memory=20)
    for g in (0, 1):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.25, 0.5]))


def test_ranks_over_many_ranges_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(400, 5.0), rng.integers(0, 50, 800).astype(float)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, v double")
    ranked, total = ranking.value_counts_ranked(df, "v", rows_per_range=100)
    assert total == len(x)
    got = {r.v: (r.cnt, r.below) for r in ranked.collect()}
    assert got == {v: (int((x == v).sum()), int((x < v).sum())) for v in set(x)}
    joined = ranking.attach_by_value(df, ranked, "v", total, rows_per_range=100)
    assert joined.count() == len(x)
    assert all(r.below == (x < r.v).sum() for r in joined.collect())


def test_roles(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a", True)], "i int, d double, s string, b boolean").withColumns(
        {"t": F.current_timestamp(), "n": F.lit("2024-01-01").cast("timestamp_ntz")})
    assert columns.numeric_columns(df) == ["i", "d"]
    assert columns.text_columns(df) == ["s"]
    assert columns.datetime_columns(df) == ["t", "n"]
    assert columns.categorical_columns(df) == ["s", "b", "t", "n"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, None)], "a double, b double")
    assert columns.nan_to_null(df).collect() == [(None, 1.0), (2.0, None)]


def test_row_ids_are_dense(spark):
    df = spark.range(1000).repartition(7)
    got = sorted(r.row_id for r in clean.assign_row_id(df).collect())
    assert got == list(range(1000))


def test_unique_names():
    assert clean.unique_names(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]


def test_number_forms(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "inf", "1d", "0x10", "", "abc", "1,000", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(clean.number_or_null(F.col("s"))).collect()]
    assert got == [1.0, 2.5, -300.0, 0.5, float("inf")] + [None] * 6


def test_inference_needs_more_than_80_percent(spark):
    rows = [(str(i) if i < 8 else "x", str(i) if i < 9 else "x", "2024-01-02" if i else None)
            for i in range(10)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    out, found = clean.infer_numeric(df)
    assert found == ["b"] and dict(out.dtypes)["a"] == "string"
    out, found = clean.infer_datetime(out)
    assert found == ["c"] and dict(out.dtypes)["c"] == "timestamp_ntz"


def test_report_numbers_round_by_their_binary_value(spark):
    from loomstat.functions.text import text
    df = spark.createDataFrame([(9.95, 1234567, 2.675), (0.25, 5, None)], "a double, n long, b double")
    got = [r[0] for r in df.select(text("%.1f%% of %,d, %.2f", "a", "n", "b")).collect()]
    assert got == [f"{9.95:.1f}% of 1,234,567, {2.675:.2f}", f"{0.25:.1f}% of 5, null"]


def test_dates_are_read_as_by_trying_every_form(spark):
    texts = ["2024-01-02", "3/4/2024", "3/4/2024 5:06", "3/4/2024 5:06:07", "2024/3/4", "2024/3/4 5:06:07", "Jan 5, 2024", "January 5, 2024",
             "5 Jan 2024", "5 January 2024", "05-Jan-2024", " 5 Jan 2024 ", "Brand#12", "a, b", "5 of 7", "x/y", "-", "", None, "Jan 5 2024"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    text = F.trim("t")
    every = F.coalesce(text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in clean.DATE_FORMS])
    rows = df.select("i", clean.timestamp_or_null(F.col("t")).alias("got"), every.alias("want")).orderBy("i").collect()
    assert all(r.got == r.want for r in rows) and sum(r.got is not None for r in rows) == 12
