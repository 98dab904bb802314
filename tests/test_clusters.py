import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import balls, dbscan, evaluate, graph, kmeans, pca, ward


def blobs(sizes, d=2, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(4 * c, spread, size=(n, d)) for c, n in enumerate(sizes)])


# ---- components and DBSCAN ------------------------------------------------------------

def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(30, j) for j in range(31, 60)] + [(70, 71), (5, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 30 for i in range(30, 60)}, 70: 70, 71: 70}


@pytest.mark.parametrize("kind", ["crowded", "sparse", "3d", "copies", "touching"])
@pytest.mark.parametrize("direct", [10, 10_000])
def test_dbscan_equals_brute_force(points, kind, direct):
    rng = np.random.default_rng(3)
    if kind == "crowded":
        x, eps = np.concatenate([rng.normal(0, 0.05, (120, 2)), rng.normal(1, 0.05, (80, 2)),
                                 rng.uniform(-1, 2, (30, 2))]), 0.35
    elif kind == "sparse":
        x, eps = rng.uniform(0, 10, (200, 2)), 0.7
    elif kind == "3d":
        x, eps = np.concatenate([rng.normal(0, 0.4, (80, 3)), rng.uniform(-2, 3, (60, 3))]), 0.5
    elif kind == "copies":
        x, eps = np.concatenate([np.zeros((60, 2)), np.full((60, 2), 0.5), np.full((4, 2), 9.0)]), 0.6
    else:
        # two crowded cells whose closest rows are just beyond, and two just within eps
        left, right = rng.uniform(0, 0.3, (50, 2)), rng.uniform(0, 0.3, (50, 2)) + [1.35, 0]
        x, eps = np.concatenate([left, right, left + [0, 5], right + [-0.2, 5]]), 1.0
    want, core = brute.dbscan(x, eps, 5)
    got = dbscan.dbscan(points(x), "id", eps, direct_pairs=direct).orderBy("id").collect()
    assert [r.cluster for r in got] == want.tolist()
    assert [r.is_core for r in got] == core.tolist()


@pytest.mark.parametrize("kind, block", [("clustered", 30), ("sparse", 2_000), ("copies", 12), ("chain", 60)])
def test_dbscan_on_balls_equals_brute_force(points, kind, block):
    rng = np.random.default_rng(8)
    if kind == "clustered":
        x, eps = np.concatenate([rng.normal(4 * c, 0.4, (40, 8)) for c in range(3)] + [rng.uniform(-3, 11, (25, 8))]), 1.4
    elif kind == "sparse":
        x, eps = rng.uniform(0, 3, (150, 6)), 0.9
    elif kind == "copies":
        x, eps = np.concatenate([np.zeros((70, 6)), np.full((3, 6), 0.4), np.full((4, 6), 9.0), rng.normal(20, 0.1, (20, 6))]), 1.0
    else:                                       # each row touches only the next ones
        x, eps = np.linspace(0, 60, 150)[:, None] * np.ones(5) / np.sqrt(5), 1.0
    want, core = brute.dbscan(x, eps, 5)
    table = points(x).select("id", F.col("features").alias("x"))
    got = balls.dbscan_balls(table, eps, 5, rows_per_block=block).orderBy("id").collect()
    assert [r.cluster for r in got] == want.tolist()
    assert [r.is_core for r in got] == core.tolist()


def test_dbscan_takes_any_dimension(points):
    x = np.concatenate([np.random.default_rng(2).normal(6 * c, 0.3, (20, 9)) for c in range(2)])
    got = dbscan.dbscan(points(x, start=5), "id", 2.0).orderBy("id").collect()
    assert [r.cluster for r in got] == [0] * 20 + [1] * 20 and got[0].id == 5
    with pytest.raises(ValueError):
        dbscan.dbscan(points(np.zeros((6, 2))), "id", 0.0)


@pytest.mark.parametrize("seed", range(4))
def test_knee_of_all_rows(spark, seed):
    """On more rows than CURVE_POINTS, over several ranges, as on the whole array."""
    rng = np.random.default_rng(seed)
    y = np.sort(np.concatenate([rng.gamma(2, 0.01, 14_000), rng.gamma(3, 0.4, 900), np.full(2_000, 0.013)]))
    value, count = np.unique(y, return_counts=True)
    below = np.cumsum(count) - count
    curve = spark.createDataFrame([(float(v), int(c), int(b)) for v, c, b in zip(value, count, below)], "distance double, cnt long, below long")
    want = float(y[dbscan.knee(np.arange(len(y), dtype=float), y)])
    assert dbscan.knee_value(curve) == want
    assert dbscan.knee_value(curve, rows_per_range=1_000) == want
    assert dbscan.knee_value(curve.limit(0)) is None and dbscan.knee_value(curve.limit(1)) is None


def test_knee_eps_takes_every_row(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = np.sort(np.concatenate([rng.gamma(2, 0.01, 11_000), rng.gamma(3, 0.4, 700)]))
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, distance double")
    monkeypatch.setattr(dbscan, "k_distance", lambda *_: table)
    assert dbscan.knee_eps(table, "id") == float(y[dbscan.knee(np.arange(len(y), dtype=float), y)])


def test_knee_of_a_bent_curve():
    x = np.arange(100, dtype=float)
    y = np.concatenate([np.linspace(0, 1, 80), np.linspace(1.5, 30, 20)])
    assert 75 <= dbscan.knee(x, y) <= 85
    assert dbscan.knee(x, np.ones(100)) is None


def test_curve_sampling(spark):
    values = np.sort(np.concatenate([np.full(30, 1.0), np.arange(70) + 2.0]))
    runs = [(float(v), int((values == v).sum()), int((values < v).sum())) for v in sorted(set(values))]
    curve = spark.createDataFrame(runs, "distance double, cnt long, below long")
    assert dbscan.sampled_curve(curve, 100, 1000).tolist() == values.tolist()
    few = dbscan.sampled_curve(curve, 100, 12)
    assert few.tolist() == [values[int(np.floor(i * 9 + 0.5))] for i in range(12)]


# ---- k-means --------------------------------------------------------------------------

def test_kmeans_finds_blobs_and_is_a_fixed_point(points):
    x = blobs([40, 60, 300])
    df = points(x)
    fit = kmeans.fit_kmeans(df, 3)
    labels = {r.id: r.cluster for r in fit.labels(df, "id").collect()}
    assert sorted(np.bincount(list(labels.values()))) == [40, 60, 300]
    for i, c in labels.items():
        assert c == ((fit.centers - x[i]) ** 2).sum(axis=1).argmin()
    for c in range(3):
        own = x[[i for i in labels if labels[i] == c]]
        assert np.allclose(own.mean(axis=0), fit.centers[c])
    assert abs(fit.inertia - sum(((x[i] - fit.centers[c]) ** 2).sum() for i, c in labels.items())) < 1e-6


def test_sweep_and_automatic_k(points):
    df = points(blobs([50, 50, 50]))
    fits = kmeans.sweep(df, [1, 2, 3, 4])
    costs = [fits[k].inertia for k in (1, 2, 3, 4)]
    assert costs == sorted(costs, reverse=True)
    got = kmeans.optimal_k(df, "id", largest=5).first()
    assert got.silhouette_k == 3 and 2 <= got.optimal_k <= 5


def test_small_tables_and_clamping(points):
    assert kmeans.optimal_k(points(np.zeros((5, 2))), "id").first().optimal_k == 2
    assert kmeans.clamp_k(40, 1000) == 15 and kmeans.clamp_k(1, 1000) == 2 and kmeans.clamp_k(9, 8) == 4
    assert kmeans.combine_k(4, 7, 10) == 5
    with pytest.raises(ValueError):
        kmeans.clamp_k(2, 3)


def test_copies_do_not_crowd_out_the_start(points):
    """6,000 copies of one point beside four blobs: one centre in each blob."""
    x = blobs([1500] * 4)
    df = points(np.concatenate([x, np.repeat(x[:1], 6000, axis=0)]))
    fit = kmeans.fit_kmeans(df, 4)
    means = np.array([x[i:i + 1500].mean(axis=0) for i in range(0, 6000, 1500)])
    means[0] = (means[0] * 1500 + x[0] * 6000) / 7500
    assert np.allclose(fit.centers, means[np.lexsort(means.T[::-1])], atol=1e-6)


# ---- Ward -----------------------------------------------------------------------------

@pytest.mark.parametrize("d, block", [(2, 1_000), (7, 20)])
def test_ward_equals_brute_force(points, block, d):
    x = np.random.default_rng(8).normal(size=(40, d))
    x[30:35] = x[30]                            # equal rows
    df = points(x)
    tree = ward.fit_ward(df, "id", rows_per_block=block)
    heights = sorted(r.height for r in tree.merges.collect())
    assert tree.count == 36 and len(heights) == 35
    # every merge adds half its squared height to the sum of squares
    assert sum(h * h for h in heights) / 2 == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    for k in (6,):
        got = {r.id: r.cluster for r in tree.labels(df, "id", clusters=k).collect()}
        assert brute.partition(got) == brute.ward(x, k) and set(got.values()) == set(range(k))
    assert tree.clusters_below(heights[-2]) == 3
    cut = {r.id: r.cluster for r in tree.labels(df, "id", height=heights[-2]).collect()}
    assert brute.partition(cut) == brute.ward(x, 3)


def test_ward_merges_locally_only_what_is_sure(points, monkeypatch):
    """Far blobs come apart into blocks that end on their own; overlapping ones need searches across blocks."""
    calls = []
    real = ward._merge_mutual
    monkeypatch.setattr(ward, "_merge_mutual", lambda *a: calls.append(1) or real(*a))
    far = np.concatenate([np.random.default_rng(c).normal(100 * c, 1, size=(20, 3)) for c in range(3)])
    tree = ward.fit_ward(points(far), "id", rows_per_block=25)
    got = {r.id: r.cluster for r in tree.labels(points(far), "id", clusters=3).collect()}
    assert sorted(np.bincount(list(got.values()))) == [20, 20, 20] and not calls
    near = np.random.default_rng(1).normal(size=(60, 12))
    tree = ward.fit_ward(points(near), "id", rows_per_block=15)
    got = {r.id: r.cluster for r in tree.labels(points(near), "id", clusters=5).collect()}
    assert brute.partition(got) == brute.ward(near, 5) and calls


def test_ward_over_micro_clusters(points):
    x = blobs([80, 80, 80])
    df = points(x)
    tree = ward.fit_ward(df, "id", micro=20)
    assert tree.count == 20 and tree.leaves.agg(F.sum("w")).first()[0] == 240
    got = {r.id: r.cluster for r in tree.labels(df, "id", clusters=3).collect()}
    assert sorted(np.bincount(list(got.values()))) == [80, 80, 80]


def test_ward_of_one_row(points):
    tree = ward.fit_ward(points(np.zeros((3, 2))), "id")
    assert tree.count == 1 and tree.merges.count() == 0
    assert [r.cluster for r in tree.labels(points(np.zeros((3, 2))), "id", clusters=1).collect()] == [0, 0, 0]


# ---- evaluation -----------------------------------------------------------------------

@pytest.mark.parametrize("tile", [13, 5000])
def test_silhouette_equals_brute_force(spark, tile):
    x = blobs([30, 60, 1], spread=1.5)
    label = np.array([0] * 30 + [1] * 60 + [2])
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, label))],
                               "id long, features array<double>, cluster int")
    got = {r.id: r.silhouette for r in
           evaluate.silhouette_samples(df, "id", rows_per_tile=tile).collect()}
    assert np.allclose([got[i] for i in range(91)], brute.silhouette(x, label))


def test_silhouettes_of_several_labelings_share_a_pass(spark, monkeypatch):
    x = np.concatenate([blobs([30, 40, 20], spread=1.5), np.full((5, 2), 3.0)])
    rng = np.random.default_rng(1)
    labels = np.column_stack([rng.integers(0, k, len(x)) for k in (1, 2, 5)])
    labels[::7, 1] = -1
    df = spark.createDataFrame([(f"k{i}", r.tolist(), [int(v) for v in c]) for i, (r, c) in enumerate(zip(x, labels))],
                               "id string, features array<double>, labels array<int>")
    got = {r.labeling: r.silhouette for r in evaluate.silhouettes(df, "id", "labels", rows_per_tile=13).collect()}
    some = labels[:, 1] >= 0
    assert got[0] == 0.0
    assert got[1] == pytest.approx(brute.silhouette(x[some], labels[some, 1]).mean())
    assert got[2] == pytest.approx(brute.silhouette(x, labels[:, 2]).mean())
    passes = []
    real = evaluate._tile_sums
    monkeypatch.setattr(evaluate, "_tile_sums", lambda *a: passes.append(1) or real(*a))
    fits = kmeans.sweep(df.select("id", "features"), [2, 3, 4])
    found = {r.k: r.silhouette for r in kmeans.silhouette_sweep(df, "id", fits).collect()}
    assert len(passes) == 1
    for k in found:
        own = ((x[:, None] - fits[k].centers[None]) ** 2).sum(-1).argmin(axis=1)
        assert found[k] == pytest.approx(brute.silhouette(x, own).mean())


def test_silhouette_estimate_holds_the_score(spark):
    x = blobs([300, 200, 100], spread=1.4)
    label = np.repeat([0, 1, 2], [300, 200, 100])
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, label))], "id long, features array<double>, cluster int")
    exact = brute.silhouette(x, label).mean()
    part = evaluate.silhouette_estimate(df, "id", sample=150).first()
    assert part.measured == 150 and part.low <= exact <= part.high and part.high - part.low < 0.2
    whole = evaluate.silhouette_estimate(df.unionByName(df.selectExpr("id + 1000 as id", "features", "-1 as cluster")), "id").first()
    assert whole.measured == 600 and whole.silhouette_score == pytest.approx(exact)
    assert evaluate.silhouette_estimate(df.limit(0), "id").count() == 0


def test_summarised_silhouette_is_close(spark):
    x = blobs([150, 150], spread=1.2)
    label = np.array([0] * 150 + [1] * 150)
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, label))],
                               "id long, features array<double>, cluster int")
    got = {r.id: r.silhouette for r in
           evaluate.silhouette_samples(df, "id", method="cells", cells=100).collect()}
    assert np.abs(np.array([got[i] for i in range(300)]) - brute.silhouette(x, label)).max() < 0.05


def test_noise_counts_in_the_percentage_only(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, [9.0, 9.0], 1),
                                (3, [5.0, 5.0], -1)], "id long, features array<double>, cluster int")
    got = {r.cluster: r for r in evaluate.cluster_stats(df).collect()}
    assert set(got) == {0, 1}
    assert got[0].percentage == 50.0 and got[0].spread == 0.5 and got[1].spread == 0.0
    one = evaluate.silhouette_samples(df.filter("cluster = 0"), "id")
    assert evaluate.silhouette_score(one).first()[0] == 0.0


# ---- PCA ------------------------------------------------------------------------------

def test_pca_against_numpy(points, spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)) + 10
    model = pca.fit_pca(points(x), k=5)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(model.ratios, values[::-1] / values.sum())
    got = np.array([list(r)[1:] for r in
                    model.transform(points(x), "id").orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ vectors[:, ::-1]))
    assert np.allclose(got @ model.components + x.mean(0), x)         # full rank: nothing is lost
    off = np.cov(got.T) - np.diag(np.diag(np.cov(got.T)))
    assert np.abs(off).max() < 1e-8
    assert (model.components[np.arange(5), np.abs(model.components).argmax(1)] > 0).all()
    top = pca.top_features(model, list("abcde"), spark, 2).collect()
    assert len(top) == 10


def test_automatic_components():
    assert pca.choose_k(np.array([0.5, 0.3, 0.16, 0.04])) == (3, True)
    assert pca.choose_k(np.array([0.99, 0.01])) == (2, True)
    assert pca.choose_k(np.full(50, 0.01)) == (50, False)


def test_pca_needs_two_features(spark, points):
    with pytest.raises(ValueError):
        pca.fit_pca(points(np.zeros((5, 1))))
    from loomstat.functions.columns import feature_matrix
    with pytest.raises(ValueError):
        feature_matrix(spark.range(3).withColumn("x", F.lit(1.0)), "id")


def test_silhouettes_write_a_row_once_per_part(spark, points):
    # 70 tiles of rows, but no row goes to more than the parts that a sweep has
    x = np.random.default_rng(4).normal(size=(280, 3))
    df = points(x).withColumn("cluster", (F.col("id") % 3).cast("int"))
    rows = df.select("id", F.col("features").alias("vec"), F.array("cluster").alias("labels"))
    sums = evaluate._tile_sums(rows, 280, 4)
    got = sums.collect()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert len(got) == 280 * 3 and sums.rdd.getNumPartitions() <= 24
    for r in got:
        assert r.own == r.id % 3 and abs(r.total - d[r.id, r.cluster::3].sum()) < 1e-9 and r.n == len(range(r.cluster, 280, 3))


def test_ward_writes_no_row_per_cluster_and_block(points, monkeypatch):
    # boxes of directions without structure all overlap, so every cluster needs every block
    from loomstat.operators import blocks
    from loomstat.session import made_tables
    x = np.random.default_rng(6).normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for module in (ward, blocks):
        monkeypatch.setattr(module, "discard", lambda *tables: None)
    rows = [(i, [float(v) for v in r], 1.0) for i, r in enumerate(x)]
    table = points(x).sparkSession.createDataFrame(rows, "eid long, vec array<double>, w double")
    with made_tables([]) as made:
        tree = blocks.build(table, 6, 300)
        merged = ward._merge_mutual(tree, 1.0, 6)[1].collect()
    assert max(t.count() for t in made) <= 300
    cost = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(cost, np.inf)
    near = cost.argmin(axis=1)
    assert {(r.a, r.b) for r in merged} == {(i, int(near[i])) for i in range(300) if near[near[i]] == i and i < near[i]}
    assert all(abs(r.height - np.sqrt(cost[r.a, r.b])) < 1e-9 for r in merged)


@pytest.mark.parametrize("listed", [131_072, 0])
def test_ward_searches_only_for_clusters_without_a_list(points, monkeypatch, listed):
    # directions without structure: boxes are of no use, and rounds go on until one task can end the tree
    asked = []
    real = ward._search_all
    monkeypatch.setattr(ward, "_search_all", lambda t, n, p: asked.append((t.filter("others is null").count(), n)) or real(t, n, p))
    monkeypatch.setattr(ward, "ENDED", 60)
    monkeypatch.setattr(ward, "LISTED", listed)
    x = np.random.default_rng(12).normal(size=(120, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = ward.fit_ward(points(x), "id", rows_per_block=40)
    got = {(r.a, r.b): (r.height, r.size) for r in tree.merges.collect()}
    done, _ = ward.local_merges(np.arange(120), x.copy(), np.ones(120), lambda c, w: np.inf)
    assert set(got) == {d[:2] for d in done} and len(asked) > 1
    assert all(abs(got[d[:2]][0] - d[2]) < 1e-9 and got[d[:2]][1] == d[3] for d in done)
    assert asked[0] == (120, 120) and any(a < n for a, n in asked[1:])


def test_ward_lists_match_only_what_is_sure():
    # on a line 0 1 2.1 3.3: 0 and 1 merge; 2 lost its first partner, and 3 is cheaper than what 0 and 1 became
    x = np.array([0.0, 1.0, 2.1, 3.3])
    cost = (x[:, None] - x[None, :]) ** 2
    who, other = np.array([0, 1, 2, 2, 3]), np.array([1, 0, 1, 3, 2])
    mate, at, _ = ward.matches(np.arange(4), np.ones(4), who, other, cost[who, other], np.array([1.0, 1.0, 2.0, 1.44]))
    assert mate == [1, 0, 3, 2] and at[:2] == [1.0, 1.0] and at[2] == pytest.approx(1.44)
    # without 3 on its list, 2 waits
    mate, _, beta = ward.matches(np.arange(4), np.ones(4), who[:3], other[:3], cost[who, other][:3], np.array([1.0, 1.0, 1.21, 1.0]))
    assert mate == [1, 0, -1, -1]


@pytest.mark.parametrize("d", [1, 2])
def test_silhouettes_in_the_plane_equal_brute_force_without_all_pairs(spark, monkeypatch, d):
    from loomstat.operators import far
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (900, d)), rng.normal(6, 0.02, (700, d)), rng.normal(0, 300, (30, d)), np.full((300, d), 2.5)])
    labels = np.column_stack([rng.integers(0, 3, len(x)), (x[:, 0] > 3).astype(int)])
    labels[::11, 0] = -1
    labels[1, 1] = 7                            # alone in its cluster
    df = spark.createDataFrame([(f"k{i}", r.tolist(), [int(v) for v in c]) for i, (r, c) in enumerate(zip(x, labels))],
                               "id string, features array<double>, labels array<int>")
    monkeypatch.setattr(far, "FEWEST", 100)
    monkeypatch.setattr(far, "LEAF", 40)
    monkeypatch.setattr(evaluate, "_tile_sums", lambda *a: pytest.fail("all pairs"))
    got = {r.labeling: r.silhouette for r in evaluate.silhouettes(df, "id", "labels").collect()}
    some = labels[:, 0] >= 0
    assert got[0] == pytest.approx(brute.silhouette(x[some], labels[some, 0]).mean(), abs=1e-9)
    assert got[1] == pytest.approx(brute.silhouette(x, labels[:, 1]).mean(), abs=1e-9)
    one = df.select(F.expr("cast(substring(id, 2) as long)").alias("id"), "features", F.col("labels")[1].alias("cluster"))
    rows = {r.id: r.silhouette for r in evaluate.silhouette_samples(one, "id").collect()}
    assert np.allclose([rows[i] for i in range(len(x))], brute.silhouette(x, labels[:, 1]), atol=1e-12)
    # few boxes meet through points, most through their nodes
    tree = far.Tree(x, 1.0, 40)
    leaf = tree.place(x)
    own = np.unique(leaf)
    tree.bound(own, np.array([x[leaf == k].min(axis=0) for k in own]), np.array([x[leaf == k].max(axis=0) for k in own]))
    many, near = tree.meetings(own)
    assert len(many) and len(near) < len(own) ** 2 / 2
