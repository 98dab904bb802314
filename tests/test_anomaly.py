import numpy as np
import pytest

from loomstat.operators import anomaly, forest, views


def test_planted_rows_score_lowest(points):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(600, 4)), np.full((6, 4), 12.0) * [1, -1, 1, -1]])
    df = points(x)
    got = anomaly.detect_anomalies(df, "id", contamination=0.05).collect()
    by = {r.id: r for r in got}
    assert len(by) == 606
    lowest = sorted(by, key=lambda i: by[i].anomaly_score)[:6]
    assert set(lowest) == set(range(600, 606))
    assert abs(sum(r.is_anomaly for r in got) / 606 - 0.05) < 0.01
    assert all(r.is_anomaly == (r.anomaly_score < 0) for r in got)
    ranks = sorted(r.anomaly_percentile for r in got)
    assert 0 < ranks[0] and ranks[-1] == pytest.approx(100.0)
    again = {r.id: r.anomaly_score for r in
             anomaly.detect_anomalies(df.repartition(1), "id", contamination=0.05).collect()}
    assert all(again[i] == by[i].anomaly_score for i in by)


def test_pool_of_a_larger_table(points):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(2000, 2)), [[30.0, 30.0]]])
    df = points(x)
    f = forest.fit_forest(df, "id", trees=20, sample=64)
    assert len(f.trees) == 20 and f.sample == 64
    scores = {r.id: r.raw_score for r in f.score(df, "id").collect()}
    # the far row may be in no sample, but then it ends in the outermost leaves
    assert sum(s < scores[2000] for s in scores.values()) <= 20
    assert all(-1 <= s < 0 for s in scores.values())


def test_tree_separates_and_respects_depth():
    x = np.arange(16, dtype=float)[:, None]
    nodes = forest.grow(x, np.random.default_rng(0))
    depth = forest.path_lengths(x, nodes)
    assert depth.min() >= 1 and len(nodes) <= 31
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert forest.path_lengths(x, forest.grow(np.ones((8, 1)), np.random.default_rng(0))).std() == 0


def test_contamination_rule(spark):
    few = spark.range(50).selectExpr("id", "double(id) as x")
    assert anomaly.auto_contamination(few, ["x"]) == 0.1
    even = spark.range(200).selectExpr("id", "double(id) as x")
    assert anomaly.auto_contamination(even, ["x"]) == 0.01
    wild = spark.range(200).selectExpr("id", "double(if(id % 2 = 0, id % 5, id * 1000)) as x")
    assert 0.01 <= anomaly.auto_contamination(wild, ["x"]) <= 0.2


@pytest.mark.parametrize("rows_per_range", [20, 100_000])
def test_percentile_rank_counts_ties_by_mean_rank(spark, rows_per_range):
    x = np.concatenate([np.full(60, 1.0), np.arange(40).astype(float)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, s double")
    got = anomaly.percentile_of_score(df, "s", "p", rows_per_range).collect()
    for r in got:
        left, right = (x < r.s).sum(), (x <= r.s).sum()
        assert r.p == pytest.approx((left + right + 1) * 50.0 / len(x))


def test_top_and_heatmap(spark):
    feats = spark.createDataFrame([(i, float(i), "t") for i in range(20)], "id int, x double, s string")
    scores = spark.createDataFrame([(i, float(i) - 3.0, i < 3) for i in range(20)],
                                   "id int, anomaly_score double, is_anomaly boolean")
    assert [r.id for r in anomaly.top_anomalies(feats, scores, "id").collect()] == list(range(10))
    cells = views.anomaly_heatmap(feats, scores, "id").collect()
    assert sorted((r.id, r.feature, r.value) for r in cells) == [(i, "x", float(i)) for i in range(3)]
