"""PCA, the neighbour graph and the neighbour embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.functions.columns import feature_matrix
from loomstat.operators import neighbors, pca, umap
from loomstat.sources import synthetic

from .base import rounded, table, vectors


def _part(spark, d):
    return feature_matrix(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"),
                          "p_partkey")


def pca_2d(spark, d):
    f = _part(spark, d)
    return rounded(pca.fit_pca(f, k=2).transform(f, "p_partkey"), "PC1", "PC2")


def pca_auto_k(spark, d):
    model = pca.fit_pca(_part(spark, d), k=2)
    ratios = pca.explained_variance(model, spark).select(
        F.substring("component", 3, 9).cast("int").alias("component"), "ratio")
    return pca.auto_k(ratios)


def pca_embed(spark, d):
    e = vectors(spark, d)
    found = pca.fit_pca(e, k="auto").transform(e, "vec_id")
    parts = [c for c in found.columns if c.startswith("PC")]
    return rounded(found.select("vec_id", *parts), *parts)


def pca_explained_variance(spark, d):
    return rounded(pca.explained_variance(pca.fit_pca(vectors(spark, d), k=50), spark),
                   "ratio", "cumulative")


def pca_explained_variance_2d(spark, d):
    return rounded(pca.explained_variance(pca.fit_pca(_part(spark, d), k=2), spark),
                   "ratio", "cumulative")


def pca_top_features(spark, d):
    model = pca.fit_pca(vectors(spark, d), k=3)
    return rounded(pca.top_features(model, [f"x{j}" for j in range(64)], spark, 5), "loading")


def knn_graph(spark, d):
    # small blocks, so that the search over several of them is what runs on small tables too
    return rounded(neighbors.knn_graph(vectors(spark, d), "vec_id", "features", 5, rows_per_block=200), "dist")


def fuzzy_union(spark, d):
    graph = neighbors.knn_graph(vectors(spark, d), "vec_id", "features", 5)
    return rounded(umap.fuzzy_union(graph.select("src", "dst", F.exp(-F.col("dist")).alias("w"))), "w")


def neighbor_weights(spark, d):
    graph = neighbors.knn_graph(vectors(spark, d), "vec_id", "features", 15)
    return rounded(umap.memberships(graph), "w")


def umap_embed(spark, d):
    return rounded(umap.umap_embed(vectors(spark, d), "vec_id"), "UMAP1", "UMAP2")


def synth_expression(spark, d):
    """Mean expression per cluster and gene of one synthetic profile per customer."""
    profiles = synthetic.expression_table(table(spark, d, "customer"), "c_custkey",
                                          F.col("c_custkey") % 4, genes=40, markers=8)
    long = profiles.select("Cluster", F.posexplode("genes").alias("gene", "value"))
    return rounded(long.groupBy("Cluster", "gene").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")), "mean", "sd")


QUERIES = {f.__name__: f for f in (
    pca_2d, pca_auto_k, pca_embed, pca_explained_variance, pca_explained_variance_2d,
    pca_top_features, knn_graph, fuzzy_union, neighbor_weights, umap_embed, synth_expression)}

# closed-form eigenvalues and first eigenvector of a 2 x 2 covariance matrix
_EIGEN = """s as (select avg(p_size) as mx, avg(p_retailprice) as my, var_pop(p_size) as a,
      var_pop(p_retailprice) as c, covar_pop(p_size, p_retailprice) as b from part),
    l as (select *, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) as l1,
      (a + c) / 2 - sqrt(power((a - c) / 2, 2) + b * b) as l2 from s),
    v as (select *, b / sqrt(b * b + power(l1 - a, 2)) as ux, (l1 - a) / sqrt(b * b + power(l1 - a, 2)) as uy
      from l),
    w as (select *, case when abs(ux) > abs(uy) then sign(ux) else sign(uy) end as s1,
      case when abs(uy) > abs(ux) then sign(-uy) else sign(ux) end as s2 from v)"""

KNN = """knn as (select * from (
      select a.vec_id as src, b.vec_id as dst, list_distance(a.v, b.v) as dist,
             row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id)::integer as rank
      from (select vec_id, cast(embedding as double[]) as v from embeddings) a,
           (select vec_id, cast(embedding as double[]) as v from embeddings) b
      where a.vec_id <> b.vec_id) t where rank <= 5)"""

ORACLE = {
    "knn_graph": f"with {KNN} select src, dst, rank, round(dist, 6) as dist from knn",
    "fuzzy_union": f"""with {KNN}, e as (select least(src, dst) as a, greatest(src, dst) as b,
          case when src < dst then exp(-dist) end as u, case when src > dst then exp(-dist) end as v from knn),
        m as (select a, b, coalesce(max(u), 0) as u, coalesce(max(v), 0) as v from e group by 1, 2)
        select a, b, round(u + v - u * v, 6) as w from m""",
    "pca_2d": f"""with {_EIGEN} select p_partkey,
        round(s1 * (ux * (p_size - mx) + uy * (p_retailprice - my)), 6) as "PC1",
        round(s2 * (-uy * (p_size - mx) + ux * (p_retailprice - my)), 6) as "PC2" from part, w""",
    "pca_auto_k": f"""with {_EIGEN}, r as (select 1 as component, l1 / (l1 + l2) as total from l
          union all select 2, (l1 + l2) / (l1 + l2) from l)
        select greatest(2, coalesce(min(case when total >= 0.95 - 1e-12 then component end), 2))::integer as k,
        bool_or(total >= 0.95 - 1e-12) as reached from r""",
    "pca_explained_variance_2d": f"""with {_EIGEN}
        select 'PC1' as component, round(l1 / (l1 + l2), 6) as ratio, round(l1 / (l1 + l2), 6) as cumulative
        from l union all
        select 'PC2', round(l2 / (l1 + l2), 6), round(1.0::double, 6) from l""",
}
