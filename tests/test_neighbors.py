import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import anomaly, neighbors, umap


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(5 * c, 1, size=(n // 3, d)) for c in range(3)])


@pytest.mark.parametrize("block", [15, 5_000])
@pytest.mark.parametrize("d", [2, 12])
def test_graph_equals_brute_force(points, block, d):
    x = clustered(150, d, 1)
    x[100:130] = x[100]                         # a crowd of equal rows
    got = neighbors.knn_graph(points(x), "id", "features", 4, block).collect()
    want = brute.knn(x, 4)
    found = {}
    for r in sorted(got, key=lambda r: (r.src, r["rank"])):
        found.setdefault(r.src, []).append(r.dst)
    dist = brute.nan_distances(x)
    for i in range(len(x)):
        assert len(found[i]) == 4
        assert np.allclose(dist[i, found[i]], dist[i, want[i]])
        if len(set(np.round(dist[i], 12))) == len(x):
            assert found[i] == want[i]


@pytest.mark.parametrize("block", [20, 5_000])
def test_imputation_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x = clustered(180, 5, 3)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[7] = np.nan                               # shares no coordinate with anyone
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    cols = [f"x{j}" for j in range(5)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    got = neighbors.impute_knn(df, "id", cols, 5, rows_per_block=block).orderBy("id").collect()
    assert np.allclose(np.array([[r[c] for c in cols] for r in got]), brute.knn_impute(x, 5))


def test_box_bound_never_exceeds_a_distance():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4))
    x[rng.random(x.shape) < 0.3] = np.nan
    lo, hi = np.nanmin(x[:100], axis=0), np.nanmax(x[:100], axis=0)
    bound = neighbors.box_bound(x[100:], lo, hi, np.isnan(x[:100]).any(axis=0))
    closest = np.nanmin(neighbors.distances(x[100:], x[:100]), axis=1)
    ok = ~np.isnan(closest)
    assert (bound[ok] <= closest[ok]).all()


def test_k_distance_counts_the_row_itself(points):
    x = np.arange(10, dtype=float)[:, None] * [1.0, 0.0]
    got = {r.id: r.distance for r in neighbors.k_distance(points(x), "id", "features", 5).collect()}
    assert got[0] == 4.0 and got[5] == 2.0


def test_graph_size_rule():
    assert neighbors.graph_neighbors(1000) == 15 and neighbors.graph_neighbors(40) == 4
    with pytest.raises(ValueError):
        neighbors.graph_neighbors(15)


def test_lof_marks_the_far_row(points):
    x = np.vstack([clustered(60, 2, 5), [[50.0, -50.0]]])
    got = {r.id: r.lof for r in anomaly.local_outlier_factor(points(x), "id", k=5).collect()}
    assert max(got, key=got.get) == 60 and got[60] > 5


def test_memberships_sum_to_log2_k(points):
    graph = neighbors.knn_graph(points(clustered(90, 3, 6)), "id", "features", 8)
    sums = umap.memberships(graph).groupBy("src").agg(F.sum("w").alias("s"), F.max("w").alias("m"))
    for r in sums.collect():
        assert abs(r.s - 3.0) < 1e-3 and abs(r.m - 1.0) < 1e-9


def trustworthiness(x, y, k):
    """1 for a layout whose nearest rows are all near in the input (Venna and Kaski 2001)."""
    n = len(x)
    dx, dy = brute.nan_distances(x), brute.nan_distances(y)
    rank = np.argsort(np.argsort(dx + np.where(np.eye(n) > 0, -1, 0), axis=1), axis=1)
    near = np.argsort(dy + np.where(np.eye(n) > 0, np.inf, 0), axis=1)[:, :k]
    excess = np.maximum(rank[np.arange(n)[:, None], near] - k, 0).sum()
    return 1 - 2 * excess / (n * k * (2 * n - 3 * k - 1))


@pytest.mark.parametrize("block", [45, 4_000])
def test_embedding_is_trustworthy(points, block):
    x = clustered(150, 6, 7)
    x[140:150] = x[140]                         # equal rows share a position
    df = points(x).select(F.concat(F.lit("k"), "id").alias("id"), "features")
    got = {int(r.id[1:]): [r.UMAP1, r.UMAP2] for r in umap.umap_embed(df, "id", epochs=200, rows_per_block=block).collect()}
    y = np.array([got[i] for i in range(150)])
    assert np.isfinite(y).all() and (y[140:] == y[140]).all()
    assert trustworthiness(x, y, 8) > 0.9


def test_spectral_start(points):
    """Orthonormal vectors, orthogonal to the trivial one, close to those of the whole matrix."""
    x = clustered(90, 4, 3) * 0.5
    n = len(x)
    edges = umap.fuzzy_union(umap.memberships(neighbors.knn_graph(points(x), "id", "features", 10)))
    w = np.zeros((n, n))
    for r in edges.collect():
        w[r.a, r.b] = w[r.b, r.a] = r.w
    degree = w.sum(axis=1)
    graph = w / np.sqrt(np.outer(degree, degree))
    found, values = umap.spectral_start(edges, points(x[:, :2]).withColumnRenamed("features", "pos"), 2, rounds=12)
    v = np.array([r.pos for r in found.orderBy("id").collect()])
    assert np.allclose(v.T @ v, np.eye(2), atol=1e-6) and np.allclose(np.sqrt(degree) @ v, 0, atol=1e-5)
    assert values == pytest.approx(np.linalg.eigvalsh(graph)[::-1][1:3], abs=2e-2)
    assert np.linalg.norm(graph @ v - v * values, axis=0).max() < 0.1


def test_edges_act_by_their_weight():
    """Over all epochs an edge of rate r acts r times as often as one of rate 1, evenly."""
    for rate in (1.0, 0.5, 0.13):
        acts = [np.floor((t + 1) * rate) > np.floor(t * rate) for t in range(200)]
        assert sum(acts) == int(200 * rate) and max(np.diff(np.flatnonzero(acts))) <= np.ceil(1 / rate)
    rng = np.random.default_rng(0)
    pos = np.array([[0.0, 0.0], [8.0, 0.0]])
    edges = dict(src=np.array([0, 1]), inside=np.array([1, 0]), fixed=np.zeros((2, 2)), pool=np.zeros((0, 2)), others=0.0)
    strong = umap.descend(pos, rate=np.ones(2), epochs=range(60), total=60, rng=rng, **edges)
    weak = umap.descend(pos, rate=np.full(2, 0.05), epochs=range(60), total=60, rng=rng, **edges)
    assert np.linalg.norm(strong[0] - strong[1]) < np.linalg.norm(weak[0] - weak[1]) < 8.5


def test_fitted_imputation_uses_only_the_donors(spark):
    """New rows never answer, however near they are, and a row's result does not depend on its batch."""
    fit = spark.createDataFrame([(i, float(i), 50.0 + i % 3) for i in range(20)], "id long, x double, y double")
    new = [(3, 10.0, None), (4, 10.1, 9999.0), (5, 10.2, 9999.0)]
    whole = {r.id: r.y for r in neighbors.impute_knn(spark.createDataFrame(new, "id long, x double, y double"), "id", ["x", "y"],
                                                      donors=fit).collect()}
    alone = neighbors.impute_knn(spark.createDataFrame(new[:1], "id long, x double, y double"), "id", ["x", "y"], donors=fit).first().y
    nearest = sorted(range(20), key=lambda i: (abs(i - 10.0), i))[:5]
    assert whole[3] == alone == pytest.approx(np.mean([50.0 + i % 3 for i in nearest]))
    assert whole[4] == 9999.0
    blocks = neighbors.impute_knn(spark.createDataFrame(new, "id long, x double, y double"), "id", ["x", "y"], donors=fit, rows_per_block=4)
    assert {r.id: r.y for r in blocks.collect()} == pytest.approx(whole)


def test_string_keys(spark):
    rows = [(f"s{i:02d}", [float(i), float(i % 3)]) for i in range(30)]
    named = spark.createDataFrame(rows, "sid string, features array<double>")
    plain = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "sid long, features array<double>")
    want = {(f"s{r.src:02d}", f"s{r.dst:02d}", r.dist) for r in neighbors.knn_graph(plain, "sid", "features", 3).collect()}
    assert {(r.src, r.dst, r.dist) for r in neighbors.knn_graph(named, "sid", "features", 3).collect()} == want
    gaps = named.selectExpr("sid", "case when sid < 's05' then null else features[0] end as a", "features[1] as b")
    filled = neighbors.impute_knn(gaps, "sid", ["a", "b"]).collect()
    assert {r.sid for r in filled} == {s for s, _ in rows} and all(r.a is not None for r in filled)


def test_search_writes_no_row_per_row_and_block(points, monkeypatch):
    # boxes of directions without structure all overlap, so every row needs every block
    from loomstat.operators import blocks
    from loomstat.session import made_tables
    x = np.random.default_rng(3).normal(size=(900, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(neighbors, "discard", lambda *tables: None)
    monkeypatch.setattr(blocks, "FOUND", 500)
    with made_tables([]) as made:
        got = neighbors.knn_graph(points(x), "id", "features", 4, rows_per_block=20).collect()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    found = np.zeros((900, 4))
    for r in got:
        found[r.src, r["rank"] - 1] = r.dist
    assert np.allclose(found, want, atol=1e-12) and len(got) == 3600
    assert max(t.count() for t in made) <= 900 * 8
