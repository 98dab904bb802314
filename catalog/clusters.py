"""Clustering and cluster evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import dbscan as grid, evaluate, kmeans, neighbors, pca, views, ward

from .base import rounded, table, vectors


def _labelled(spark, d):
    return vectors(spark, d).withColumnRenamed("label", "cluster")


def _noisy(spark, d):
    return _labelled(spark, d).withColumn(
        "cluster", F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("cluster")))


def _plane(spark, d):
    """PCA of the embeddings as (vec_id, features)."""
    e = vectors(spark, d)
    return pca.fit_pca(e, k=2).transform(e, "vec_id").select(
        "vec_id", F.array("PC1", "PC2").alias("features"))


def silhouette_samples(spark, d):
    return rounded(evaluate.silhouette_samples(_labelled(spark, d), "vec_id"), "silhouette")


def silhouette_score(spark, d):
    s = evaluate.silhouette_samples(_noisy(spark, d), "vec_id", exclude_noise=True)
    return rounded(evaluate.silhouette_score(s), "silhouette_score")


def silhouettes(spark, d):
    """Three labelings of the same vectors in one pass over their distances."""
    e = vectors(spark, d).withColumn("labels", F.array(
        F.col("label"), (F.col("vec_id") % 3).cast("int"), F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("label"))))
    return rounded(evaluate.silhouettes(e, "vec_id", "labels"), "silhouette")


def silhouette_estimate(spark, d):
    return rounded(evaluate.silhouette_estimate(_noisy(spark, d), "vec_id"), "silhouette_score", "low", "high")


def silhouette_box(spark, d):
    s = evaluate.silhouette_samples(_labelled(spark, d), "vec_id")
    return rounded(views.box_stats(s, "silhouette", "cluster"),
                   "q1", "median", "q3", "whisker_low", "whisker_high")


def cluster_stats(spark, d):
    s = evaluate.cluster_stats(_noisy(spark, d))
    return rounded(s, "percentage", "spread").withColumn(
        "centroid", F.concat_ws(",", F.transform("centroid", lambda v: F.format_string("%.4f", v))))


def cluster_balance(spark, d):
    return rounded(evaluate.cluster_balance(evaluate.cluster_stats(_noisy(spark, d))), "balance")


def cluster_stats_table(spark, d):
    return evaluate.cluster_stats_table(evaluate.cluster_stats(_labelled(spark, d)))


def cluster_label_table(spark, d):
    return evaluate.label_table({"given": _labelled(spark, d), "noisy": _noisy(spark, d)}, "vec_id")


def clustering_summary(spark, d):
    points = _noisy(spark, d)
    score = evaluate.silhouette_score(
        evaluate.silhouette_samples(points, "vec_id", exclude_noise=True))
    out = evaluate.clustering_summary(evaluate.cluster_stats(points), points, score, "given")
    return rounded(out, "silhouette_score").withColumn(
        "cluster_sizes", F.concat_ws(",", F.col("cluster_sizes").cast("array<string>")))


def cluster_feature_trends(spark, d):
    e = table(spark, d, "embeddings")
    cols = [f"x{j}" for j in range(64)]
    wide = e.select("vec_id", *[F.col("embedding")[j].cast("double").alias(c)
                                for j, c in enumerate(cols)])
    return rounded(evaluate.feature_trends(wide, _labelled(spark, d), "vec_id", cols, 3),
                   "mean", "shift")


def labels_on_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    emb = e.select("vec_id", *[F.col("embedding")[j].cast("double").alias(f"x{j + 1}") for j in range(3)])
    return rounded(views.projection(emb, _noisy(spark, d), "vec_id", 3), "x1", "x2", "x3")


def nearest_center(spark, d):
    points = _labelled(spark, d)
    centers = {r.cluster: list(r.centroid) for r in evaluate.cluster_stats(points).collect()}
    return rounded(kmeans.nearest_center(points, "vec_id", centers), "distance")


def inertia_given_labels(spark, d):
    return rounded(kmeans.inertia_given_labels(_labelled(spark, d)), "inertia")


def elbow_k(spark, d):
    curve = table(spark, d, "customer").groupBy(
        (F.col("c_nationkey") % 10 + 1).alias("k")).agg(F.sum("c_acctbal").alias("inertia"))
    return kmeans.elbow_k(curve)


def kmeans_labels(spark, d):
    points = _plane(spark, d)
    return kmeans.fit_kmeans(points, 4).labels(points, "vec_id")


def inertia_curve(spark, d):
    fits = kmeans.sweep(_plane(spark, d), list(range(1, 11)))
    return rounded(kmeans.inertia_table(fits, spark), "inertia")


def silhouette_sweep(spark, d):
    points = _plane(spark, d)
    fits = kmeans.sweep(points, list(range(2, kmeans.MAX_SWEEP + 1)))
    return rounded(kmeans.silhouette_sweep(points, "vec_id", fits), "silhouette")


def optimal_k(spark, d):
    return kmeans.optimal_k(_plane(spark, d), "vec_id")


def k_distance(spark, d):
    kdist = neighbors.k_distance(vectors(spark, d), "vec_id", "features")
    return rounded(neighbors.k_distance_curve(kdist), "distance")


def knee_eps(spark, d):
    eps = grid.knee_eps(_plane(spark, d), "vec_id")
    return spark.createDataFrame([(round(eps, 6),)], "eps double")


def dbscan(spark, d):
    return grid.dbscan(vectors(spark, d, dims=2), "vec_id", 0.02)


def dbscan_vectors(spark, d):
    """Over all coordinates of the embeddings."""
    return grid.dbscan(vectors(spark, d), "vec_id", 0.6)


def dbscan_auto(spark, d):
    points = _plane(spark, d)
    return grid.dbscan(points, "vec_id", grid.knee_eps(points, "vec_id"))


def hierarchical(spark, d):
    points = vectors(spark, d)
    return ward.fit_ward(points, "vec_id").labels(points, "vec_id", clusters=4)


def hierarchical_cut(spark, d):
    points = vectors(spark, d)
    return ward.fit_ward(points, "vec_id").labels(points, "vec_id", height=2.0)


def hierarchical_merges(spark, d):
    # small blocks, so that merges across several of them are what runs on small tables too
    return rounded(ward.fit_ward(vectors(spark, d), "vec_id", rows_per_block=300).merges, "height").withColumn("size", F.col("size").cast("long"))


QUERIES = {f.__name__: f for f in (
    k_distance, knee_eps, dbscan, dbscan_vectors, dbscan_auto, hierarchical, hierarchical_cut, hierarchical_merges,
    silhouette_samples, silhouette_score, silhouettes, silhouette_estimate, silhouette_box, cluster_stats, cluster_balance,
    cluster_stats_table, cluster_label_table, clustering_summary, cluster_feature_trends,
    labels_on_embeddings, nearest_center, inertia_given_labels, elbow_k, inertia_curve, silhouette_sweep, optimal_k)}
QUERIES["kmeans"] = kmeans_labels

LABELLED = "select vec_id, cast(embedding as double[]) as v, label as cluster from embeddings"
NOISY = """select vec_id, cast(embedding as double[]) as v,
    case when vec_id % 9 = 0 then -1 else label end as cluster from embeddings"""


def samples_sql(source):
    return f"""sil as (
      with p as ({source}),
      m as (select a.vec_id, a.cluster, b.cluster as other, sum(list_distance(a.v, b.v)) as total,
              count(*) as n from p a, p b group by 1, 2, 3),
      ab as (select vec_id, cluster,
              max(case when cluster = other and n > 1 then total / (n - 1) end) as a,
              min(case when cluster <> other then total / n end) as b from m group by 1, 2)
      select vec_id, cluster, case when a is null then 0.0::double
             else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end as silhouette from ab)"""


def stats_sql(source, where=""):
    return f"""long as (select cluster, generate_subscripts(v, 1) as j, unnest(v) as x from ({source}) p),
      dims as (select cluster, j, avg(x) as m, stddev_pop(x) as s from long group by 1, 2),
      sizes as (select cluster, count(*) as size, count(*) * 100.0::double / (select count(*) from ({source}) q)
                as percentage from ({source}) p group by 1),
      stats as (select cluster, size, percentage, list(m order by j) as centroid, avg(s) as spread
                from dims join sizes using (cluster) where cluster <> -1 group by 1, 2, 3)"""


def dbscan_sql(points, eps):
    return f"""with recursive
        p as ({points}),
        near as (select a.id as a, b.id as b from p a, p b where list_distance(a.v, b.v) <= {eps}),
        core as (select a as id from near group by a having count(*) >= 5),
        edge as (select a, b from near where a in (select id from core) and b in (select id from core)),
        reach(id, root) as (select id, id from core union
          select e.b, r.root from reach r join edge e on e.a = r.id),
        comp as (select id, min(root) as root from reach group by id),
        num as (select id, dense_rank() over (order by root) - 1 as cluster from comp),
        border as (select n.a as id, min(num.cluster) as cluster from near n join num on num.id = n.b
          where n.a not in (select id from core) group by n.a)
        select p.id as vec_id, coalesce(num.cluster, border.cluster, -1)::integer as cluster,
          num.id is not null as is_core
        from p left join num on num.id = p.id left join border on border.id = p.id"""


# every step merges the two clusters of the least cost; the clusters of a step are the rows of that step
WARD = """c(step, id, v, w, a, b, height) as (
      select 0, vec_id, embedding::double[], 1.0::double, null::bigint, null::bigint, null::double from embeddings
      union all
      (with m as (select min({'cost': 2 * x.w * y.w / (x.w + y.w) * list_distance(x.v, y.v) ** 2, 'a': x.id, 'b': y.id}) as p
            from c x, c y where x.id < y.id),
         g as (select x.step + 1 as step, x.id, list_transform(list_zip(x.v, y.v), lambda z: (z[1] * x.w + z[2] * y.w) / (x.w + y.w)) as v,
            x.w + y.w as w, x.id as a, y.id as b, sqrt(m.p.cost) as height from m, c x, c y where x.id = m.p.a and y.id = m.p.b)
       select * from g union all select c.step + 1, c.id, c.v, c.w, null, null, null from c, g where c.id <> g.a and c.id <> g.b))"""


def ward_labels(made):
    return f"""with recursive {WARD},
        made as (select a, b from c where a is not null and {made}),
        way as (select a as u, b as v from made union all select b, a from made),
        reach(id, root) as (select vec_id, vec_id from embeddings union select r.id, way.v from reach r join way on way.u = r.root),
        comp as (select id, min(root) as root from reach group by id),
        num as (select root, row_number() over (order by min(embedding::double[])) - 1 as cluster
                from comp join embeddings on vec_id = id group by root)
        select id as vec_id, cluster::integer as cluster from comp join num using (root)"""


_VALID = f"select * from ({NOISY}) z where cluster <> -1"
_X = [f"x{j}" for j in range(64)]

ORACLE = {
    "hierarchical": ward_labels("step <= (select count(*) from embeddings) - 4"),
    "hierarchical_cut": ward_labels("height < 2.0"),
    "hierarchical_merges": f"""with recursive {WARD} select a, b, round(height, 6) as height, w::bigint as size
        from c where a is not null""",
    "k_distance": """with g as (select a.vec_id, list_distance(a.v, b.v) as dist,
          row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as rn
          from (select vec_id, cast(embedding as double[]) as v from embeddings) a,
               (select vec_id, cast(embedding as double[]) as v from embeddings) b
          where a.vec_id <> b.vec_id),
        k as (select vec_id, max(dist) as distance from g where rn <= 4 group by 1)
        select round(distance, 6) as distance, count(*) as cnt,
        (sum(count(*)) over (order by distance) - count(*))::bigint as below
        from k group by k.distance""",
    "dbscan": dbscan_sql("select vec_id as id, embedding[1:2]::double[] as v from embeddings", 0.02),
    "dbscan_vectors": dbscan_sql("select vec_id as id, embedding::double[] as v from embeddings", 0.6),
    "silhouette_samples": f"""with {samples_sql(LABELLED)} select vec_id, cluster,
        round(silhouette, 6) as silhouette from sil""",
    "silhouette_score": f"""with {samples_sql(_VALID)}
        select round(avg(silhouette), 6) as silhouette_score from sil""",
    "silhouettes": " union all ".join(f"""select {i}::integer as labeling, round(s, 6) as silhouette from (
        with {samples_sql(source)} select avg(silhouette) as s from sil) t{i}""" for i, source in enumerate((
            LABELLED, LABELLED.replace("label as cluster", "vec_id % 3 as cluster"), _VALID))),
    # the sample has all rows of small tables
    "silhouette_estimate": f"""with {samples_sql(_VALID)},
        m as (select avg(silhouette) as s, 1.96 * stddev_samp(silhouette) / sqrt(count(*)) as e, count(*) as n from sil)
        select round(s, 6) as silhouette_score, round(s - e, 6) as low, round(s + e, 6) as high, n as measured from m""",
    "silhouette_box": f"""with {samples_sql(LABELLED)},
        b as (select cluster, quantile_cont(silhouette, 0.25) as q1, quantile_cont(silhouette, 0.5)
              as median, quantile_cont(silhouette, 0.75) as q3 from sil group by 1)
        select cluster, count(*) as count, round(q1, 6) as q1, round(median, 6) as median,
        round(q3, 6) as q3,
        round(min(case when silhouette >= q1 - 1.5 * (q3 - q1) then silhouette end), 6) as whisker_low,
        round(max(case when silhouette <= q3 + 1.5 * (q3 - q1) then silhouette end), 6) as whisker_high
        from sil join b using (cluster) group by cluster, q1, median, q3""",
    "cluster_stats": f"""with {stats_sql(NOISY)} select cluster, size, round(percentage, 6) as percentage,
        array_to_string(list_transform(centroid, lambda x: printf('%.4f', x)), ',') as centroid,
        round(spread, 6) as spread from stats""",
    "cluster_balance": f"""with {stats_sql(NOISY)} select max(size) as largest, min(size) as smallest,
        round(min(size)::double / max(size), 6) as balance, min(size)::double / max(size) < 0.2 as imbalanced,
        min(size)::double / max(size) < 0.3 as reported from stats""",
    "cluster_stats_table": f"""with {stats_sql(LABELLED)} select concat('Cluster ', cluster) as "Cluster",
        size as "Size", printf('%.1f%%', percentage) as "Percentage", printf('%.3f', spread) as "Spread"
        from stats""",
    "cluster_label_table": f"""select a.vec_id, a.cluster as given_cluster, b.cluster as noisy_cluster
        from ({LABELLED}) a join ({NOISY}) b using (vec_id)""",
    "clustering_summary": f"""with {samples_sql(_VALID)}, {stats_sql(NOISY)}
        select 'given' as method, (select count(*)::integer from stats) as n_clusters,
        (select round(avg(silhouette), 6) from sil) as silhouette_score,
        (select count(*) from embeddings) as labels_assigned,
        (select array_to_string(list(size order by cluster), ',') from stats) as cluster_sizes""",
    "cluster_feature_trends": "with w as (select vec_id, label as cluster, " + ", ".join(
        f"embedding[{j + 1}]::double as {c}" for j, c in enumerate(_X)) + " from embeddings), l as ("
        + " union all ".join(f"""select cluster, '{c}' as feature, avg({c}) as mean,
            (avg({c}) - (select avg({c}) from w)) / (select stddev_pop({c}) from w) as shift
            from w group by cluster""" for c in _X)
        + """), r as (select *, row_number() over (partition by cluster
            order by round(abs(shift), 9) desc, feature) as rank from l)
        select cluster, feature, round(mean, 6) as mean, round(shift, 6) as shift, rank
        from r where rank <= 3""",
    "labels_on_embeddings": f"""select e.vec_id, round(embedding[1]::double, 6) as x1,
        round(embedding[2]::double, 6) as x2, round(embedding[3]::double, 6) as x3,
        l.cluster::varchar as cluster from embeddings e join ({NOISY}) l on l.vec_id = e.vec_id""",
    "nearest_center": f"""with {stats_sql(LABELLED)}, r as (
        select vec_id, s.cluster, list_distance(v, centroid) as distance,
        row_number() over (partition by vec_id order by list_distance(v, centroid), s.cluster) as rn
        from ({LABELLED}) p, stats s)
        select vec_id, cluster, round(distance, 6) as distance from r where rn = 1""",
    "inertia_given_labels": f"""with {stats_sql(LABELLED)} select
        round(sum(power(list_distance(v, centroid), 2)), 6) as inertia
        from ({LABELLED}) p join stats using (cluster)""",
    "elbow_k": """with c as (select c_nationkey % 10 + 1 as k, sum(c_acctbal) as inertia from customer
        group by 1),
        b as (select k, abs(lead(inertia) over (order by k) - 2 * inertia + lag(inertia) over (order by k))
              as bend from c)
        select k::integer as elbow_k from b where bend is not null order by bend desc, k limit 1""",
}
