import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import insights
from loomstat.plans.analysis import Analysis


def test_a_whole_run(spark, tmp_path):
    run = Analysis(spark)
    run.load_sample(160, 12)
    run.preprocess()
    assert run.workspace.tables["processed_data"].count() == 160
    run.reduce("PCA", 3)
    for method in ("kmeans", "dbscan", "hierarchical"):
        run.cluster(method, clusters=4, eps=1.0)
    run.anomalies(0.1)
    assert run.top_anomalies().count() == 10
    labels = run.workspace.tables["clustering_results"]
    assert labels.columns == ["row_id", "kmeans_cluster", "dbscan_cluster", "hierarchical_cluster"]
    assert labels.count() == 160
    # the four planted clusters are found
    truth = run.workspace.tables["raw_data"].select("row_id", "Cluster").join(labels, "row_id")
    assert truth.groupBy("Cluster").agg(F.count_distinct("kmeans_cluster").alias("n")) \
        .agg(F.max("n")).first()[0] == 1
    titles = [r.title for r in run.report().orderBy("seq").collect()]
    assert titles[0] == "Dataset Overview" and "KMEANS Clustering Results" in titles
    assert titles[-1] == "Next Steps"
    assert run.executive_summary().count() == 3
    out = run.export(str(tmp_path), "csv", embeddings=True)
    assert set(out) == {"processed_data", "clustering_results", "anomaly_scores", "PCA_embeddings",
                        "analysis_insights"}
    assert spark.read.option("header", True).csv(out["anomaly_scores"]).count() == 160
    assert set(run.export(str(tmp_path / "b"), "json", data=False, clusters=False, anomalies=False)) \
        == {"analysis_insights"}
    log = spark.read.option("header", True).csv(run.export_log(str(tmp_path)))
    assert log.filter("status = 'completed'").count() == 7
    assert run.workspace.status().first().data_loaded
    assert {r.severity for r in run.workspace.insights().collect()} <= {"info", "warning", "error", "success"}
    run.clear()
    assert run.workspace.tables == {} and run.workspace.log().count() == 0


def test_a_run_from_a_file_with_chosen_parameters(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("name;a;b;c\n" + "\n".join(
        f"n{i};{i % 7};{'' if i % 9 == 0 else i * 1.5};{(i * i) % 13}" for i in range(120)))
    run = Analysis(spark)
    run.load(str(path))
    assert run.attempts[-1] == "Success with delimiter ';'"
    run.preprocess()
    run.reduce("PCA", "auto")
    run.cluster("kmeans")
    run.anomalies("auto")
    kinds = {r.type for r in run.workspace.insights().collect()}
    assert {"dataset_overview", "data_types", "missing_values", "preprocessing_summary",
            "clustering_result", "anomaly_result"} <= kinds


def test_failures_are_logged(spark):
    run = Analysis(spark)
    with pytest.raises(ValueError):
        run.preprocess()
    assert [r.status for r in run.workspace.log().collect()] == ["started", "failed"]
    with pytest.raises(ValueError):
        run.cluster("other")
    with pytest.raises(ValueError):
        run.workspace.add_insight("x", "y", "loud")


def test_rules_without_findings(spark):
    text = spark.createDataFrame([("a",), ("b",)], "s string")
    got = [r.message for r in insights.quality_insights(text).collect()]
    assert got == [insights.NO_NUMERIC]
    none = spark.createDataFrame([(10, 0, 0.0, 0.1)], "total_samples long, anomalies_detected long, "
                                 "anomaly_percentage double, contamination_used double")
    assert [r.message for r in insights.anomaly_insights(none).collect()] == [insights.NO_ANOMALIES]
    many = spark.createDataFrame([(10, 3, 30.0, 0.1)], none.schema)
    assert [r.severity for r in insights.anomaly_insights(many).collect()] == ["warning", "warning"]
    one = spark.createDataFrame([("dbscan", 1, 0.0, 10, [10])], "method string, n_clusters int, "
                                "silhouette_score double, labels_assigned long, cluster_sizes array<long>")
    assert [r.message for r in insights.clustering_insights(one).collect()] == [insights.ONE_CLUSTER]
    assert insights.comprehensive_report(clusterings={"dbscan": one}).count() == 1


@pytest.mark.parametrize("method", ["kmeans", "dbscan", "hierarchical"])
def test_a_run_with_string_keys_and_nan(spark, method):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [(f"S{i:03d}", *(float(v) for v in rng.normal(4 * (i % 3), 0.4, 2))) for i in range(90)]
    rows[5] = ("S005", float("nan"), rows[5][2])
    run = Analysis(spark, key="sid")
    run.use(spark.createDataFrame(rows, "sid string, x double, y double"))
    assert run.workspace.tables["raw_data"].filter("x is null").count() == 1
    run.preprocess()
    run.reduce("PCA", 2)
    run.cluster(method, clusters=3, eps=0.8)
    labels = run.workspace.tables["clustering_results"]
    assert {r.sid for r in labels.select("sid").collect()} == {r[0] for r in rows}
    run.anomalies(0.1)
    assert run.top_anomalies().count() > 0


def test_sessions_append_to_one_log_and_clear_deletes_tables(spark, tmp_path):
    import os
    from loomstat.plans.workspace import Workspace
    from loomstat.session import cut_lineage, made_tables
    folder = str(tmp_path / "log")
    for session in ("one", "two"):
        ws = Workspace(spark, folder, session)
        ws.log_step("load", "started", "Starting")
        ws.log_step("load", "completed", "Done", 0.5)
    ws.clear()
    rows = ws.history().orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.status) for r in rows] == [("one", 1, "started"), ("one", 2, "completed"), ("two", 1, "started"), ("two", 2, "completed")]
    assert rows[1].execution_time == 0.5 and ws.log().count() == 0
    with pytest.raises(ValueError):
        Workspace(spark).history()
    with made_tables(ws.made):
        table = cut_lineage(spark.range(5).toDF("a"))
    other = cut_lineage(spark.range(3).toDF("a"))
    place = table.cut_path.removeprefix("file:")
    assert os.path.isdir(place)
    ws.clear()
    assert not os.path.exists(place) and other.count() == 3


def test_a_run_leaves_no_tables_after_clear(spark, tmp_path):
    import os
    rng = np.random.default_rng(1)
    path = tmp_path / "in.csv"
    path.write_text("a,b,c\n" + "\n".join(",".join(f"{v:.3f}" for v in r) for r in rng.normal(size=(30, 3))))
    run = Analysis(spark)
    run.load(str(path))
    summary = run.summaries["data"].first()
    assert summary.files == 1 and summary.bytes == path.stat().st_size and summary.load_attempts == run.attempts
    run.preprocess()
    made = [t.cut_path.removeprefix("file:") for t in run.workspace.made]
    assert made and any(os.path.exists(p) for p in made)
    run.clear()
    assert not any(os.path.exists(p) for p in made)
