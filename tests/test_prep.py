import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import prep, profile, views
from loomstat.plans.preprocess import AdaptivePreprocessor, summary_row


def test_empty_and_null_tables(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert profile.profile_missing(df).first() == (0, 0, 0.0)
    assert profile.duplicate_rows(df).first()[0] == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "a double, b string")
    assert profile.profile_missing(nulls).first() == (6, 6, 100.0)
    assert profile.duplicate_rows(nulls).first()[0] == 2


def test_population_skewness(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert round(profile.profile_skewness(df).first().skewness, 4) == 1.0182


def test_cap_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,), (100.0,)], "x double")
    got = [r.x for r in prep.iqr_cap(df, ["x"], {"x": (0.0, 10.0)}).collect()]
    assert got == [None, 1.0, 10.0]


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    for fn in (prep.scale_standard, prep.scale_robust, prep.scale_minmax):
        assert [r.x for r in fn(df, ["x"]).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("rows_per_range", [10, 100_000])
def test_forward_fill_across_ranges_with_a_hot_key(spark, rows_per_range):
    rng = np.random.default_rng(0)
    rows = [(i, 0 if i % 3 else i % 7, i // 2, float(i) if rng.random() < 0.1 else None)
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long, t long, v double")
    got = {r.id: r.v for r in prep.forward_fill(df, "v", "t", "id", "k", rows_per_range).collect()}
    last = {}
    for i, k, _t, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert got[i] == last[k]


def test_dedupe_keeps_the_first_key(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1.0)], "id long, s string, x double")
    assert sorted(r.id for r in prep.dedupe_rows(df, "id").collect()) == [1, 3]


def test_one_hot_refuses_too_many(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError):
        prep.one_hot(df, ["s"])


def frame(spark, n, gaps=True, columns=3):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, columns)) * 10
    x[0, 0] = 1e6
    rows = [(i, *[None if gaps and (i + j) % 11 == 0 else float(x[i, j]) for j in range(columns)],
             "red" if i % 2 else "blue") for i in range(n)]
    cols = ", ".join(f"x{j} double" for j in range(columns))
    return spark.createDataFrame(rows, f"id long, {cols}, colour string"), x


def test_small_tables_keep_outliers_and_use_robust_scaling(spark):
    df, _x = frame(spark, 50)
    model = AdaptivePreprocessor("id").fit(df)
    assert model.bounds == {} and model.scaler == "robust" and model.imputer == "median"
    assert model.fitted_table.columns == ["id", "x0", "x1", "x2", "colour_red"]


def test_knn_above_100_rows_and_3_columns(spark):
    df, _x = frame(spark, 150, columns=4)
    model = AdaptivePreprocessor("id").fit(df)
    assert model.imputer == "knn"
    assert model.fitted_table.filter("x0 is null or x1 is null").count() == 0
    assert model.summary["missing_values_handled"] == sum(
        1 for i in range(150) for j in range(4) if (i + j) % 11 == 0)
    new = df.withColumn("id", F.col("id") + 1000).limit(20)
    assert model.transform(new).filter("x0 is null").count() == 0


def test_fitted_plan_reapplies_unchanged(spark):
    df, _x = frame(spark, 1500, gaps=False)
    model = AdaptivePreprocessor("id").fit(df)
    assert model.scaler == "standard" and "x0" in model.bounds
    a = {r.id: r for r in model.fitted_table.collect()}
    b = {r.id: r for r in model.transform(df.limit(10)).collect()}
    assert all(a[i] == b[i] for i in b)


def test_low_variance_and_high_missing_columns_leave(spark):
    df, _x = frame(spark, 200, gaps=False, columns=11)
    df = df.withColumn("flat", F.lit(1.0)).withColumn(
        "sparse", F.when(F.col("id") % 2 == 0, F.col("x1")))
    model = AdaptivePreprocessor("id").fit(df)
    assert "flat" not in model.fitted_table.columns and "sparse" not in model.fitted_table.columns
    assert model.low_variance == ["flat"] and list(model.dropped) == ["sparse"]


@pytest.mark.parametrize("options", [
    {"imputer": "drop", "outliers": "remove", "scaler": "minmax"},
    {"imputer": "mode", "outliers": "zscore", "scaler": "none"},
    {"imputer": "median", "outliers": "none", "scaler": "standard"}])
def test_chosen_options(spark, options):
    df, _x = frame(spark, 120)
    model = AdaptivePreprocessor("id", **options).fit(df)
    rows = model.fitted_table.count()
    assert summary_row(model, spark).first().rows_processed == rows
    if options["imputer"] == "drop":
        assert rows < 120 and model.summary["duplicates_removed"] == 0
    with pytest.raises(ValueError):
        AdaptivePreprocessor("id", scaler="other")


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    got = {(r.x, r.y): r.correlation for r in views.correlation_matrix(df).collect()}
    assert got["a", "c"] is None and got["c", "c"] is None and got["a", "a"] == 1.0
    assert abs(got["a", "b"] - np.corrcoef([1, 2, 3], [2, 4.5, 6])[0, 1]) < 1e-12


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert [(r.bin, r["count"]) for r in views.histogram(df, "x").collect()] == [(0, 4)]


def test_boxes_with_large_and_small_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(size=400)] + [("b", float(v)) for v in rng.normal(size=30)]
    df = spark.createDataFrame(rows + [("a", 99.0), (None, 1.0)], "g string, v double")
    few = sorted(views.box_stats(df, "v", "g", large=50).collect())
    assert few == sorted(views.box_stats(df, "v", "g").collect())
    assert [r["count"] for r in few] == [401, 30] and few[0].whisker_high < 99.0
    one = views.box_stats(df, "v").first()
    assert one["count"] == 432 and one.median == np.median([v for _g, v in rows] + [99.0, 1.0])


def test_input_size(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    got = profile.input_bytes(spark.read.parquet(str(tmp_path / "t"))).first()
    assert got.files == 3 and got.bytes == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))


def test_wide_tables_take_the_long_path_with_equal_results(spark, monkeypatch):
    from loomstat.functions import columns, quantiles
    from loomstat.operators import prep as prep_module
    from loomstat.plans import preprocess
    df, _x = frame(spark, 130, columns=6)
    df = df.unionByName(df.limit(9).withColumn("id", F.col("id") + 1000)).withColumn("n", F.lit(None).cast("double"))
    data = df.drop("id")

    def everything():
        model = AdaptivePreprocessor("id", imputer="median").fit(df)
        return (sorted(map(str, model.fitted_table.collect())), model.steps,
                profile.data_summary(data).collect(), profile.duplicate_rows(data).collect(),
                sorted(profile.null_fraction_by_column(data).collect()),
                sorted(map(str, profile.constant_columns(data).collect())),
                sorted(prep.outlier_counts(df, ["x0", "x1", "x2", "x3"]).collect()),
                prep.dedupe_rows(df, "id").count())

    narrow = everything()
    for m in (columns, quantiles, prep_module, preprocess):
        monkeypatch.setattr(m, "CHUNK", 3)
    assert everything() == narrow


def test_repeated_rows_are_found_by_fingerprint_and_compared_in_full(spark):
    from loomstat.operators import profile
    rows = [(1, None, 0.0, "x"), (None, 1, 0.0, "x"), (1, None, -0.0, "x"), (2, 2, float("nan"), None), (2, 2, float("nan"), None), (3, 3, 1.0, "y")]
    df = spark.createDataFrame(rows, "a int, b int, c double, d string")
    found = profile.repeated_rows(df)
    assert sorted(r["__copies"] for r in found.collect()) == [2, 2]
    assert profile.duplicate_rows(df).first()[0] == 2
    wide = df.select(*[F.col(c).alias(f"{c}{j}") for j in range(60) for c in df.columns])
    assert profile.duplicate_rows(wide).first()[0] == 2
    assert profile.duplicate_rows(df.limit(0)).first()[0] == 0
    plan = wide.select(*profile._fingerprints(wide)).groupBy("__f1", "__f2").count()._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchange and "a0" not in exchange[0]


def test_same_fingerprint_is_not_enough(spark, monkeypatch):
    from loomstat.operators import profile
    monkeypatch.setattr(profile, "_fingerprints", lambda df: [F.lit(1).alias("__f1"), F.lit(2).alias("__f2")])
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (2,)], "a int")
    assert profile.duplicate_rows(df).first()[0] == 2
