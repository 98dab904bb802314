import json

import pandas as pd
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from loomstat.sources import readers, synthetic, writers

ROWS = [("a", 1, 1.5, "x"), ("b", 2, 2.5, "y"), ("c", 3, 3.5, "z")]


@pytest.mark.parametrize("name, expected", [
    ("a.csv", "csv"), ("A.TSV", "tsv"), ("x.parquet", "parquet"), ("x.json", "json"), ("noext", "txt"),
    ("x.log", "txt"), ("dir/x.feather", "feather"), ("x.y.txt", "txt")])
def test_format_by_extension(name, expected):
    assert readers.detect_format(name) == expected


@pytest.mark.parametrize("name, sep", [("comma.csv", ","), ("tab.tsv", "\t"), ("semi.csv", ";"),
                                       ("pipe.txt", "|"), ("space.txt", " "), ("noext", ",")])
def test_delimiters(spark, tmp_path, name, sep):
    path = tmp_path / name
    path.write_text("\n".join(sep.join(map(str, r)) for r in [("n", "i", "f", "t"), *ROWS]) + "\n")
    got = readers.load_table(spark, str(path))
    assert got.df.columns == ["n", "i", "f", "t"]
    assert sorted(tuple(r) for r in got.df.collect()) == ROWS
    assert got.attempts[-1] == f"Success with delimiter '{sep}'"


def test_one_column_stays_one_column(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("n\n1\n2\n")
    assert [r.n for r in readers.load_table(spark, str(path)).df.collect()] == [1, 2]


@pytest.mark.parametrize("encoding", ["latin1", "utf-16", "utf-8"])
def test_encodings(spark, tmp_path, encoding):
    path = tmp_path / "enc.csv"
    path.write_bytes("größe,wert\nklein,1\nübel,2\n".encode(encoding))
    got = readers.load_table(spark, str(path))
    assert got.df.columns == ["größe", "wert"]
    assert sorted((r[0], r[1]) for r in got.df.collect()) == [("klein", 1), ("übel", 2)]


def test_repeated_header_names(spark, tmp_path):
    path = tmp_path / "dup.csv"
    path.write_text("a,a,b\n1,2,3\n")
    got = readers.load_table(spark, str(path)).df
    assert got.columns == ["a", "a_1", "b"] and got.first() == (1, 2, 3)


def test_rows_with_surplus_fields_go_to_quarantine(spark, tmp_path):
    path = tmp_path / "bad.csv"
    lines = ["a,b"] + [f"{i},{i}" for i in range(300)] + ["1,2,3", "7"]
    path.write_text("\n".join(lines) + "\n")
    got = readers.load_table(spark, str(path))
    assert got.df.count() == 301 and got.quarantine.count() == 1
    assert got.df.filter("b is null").count() == 1


def test_raw_text(spark, tmp_path):
    path = tmp_path / "ragged.log"
    path.write_text("\n".join(f"  w{i} " + "x " * (i % 4) + "\n" for i in range(150)))
    df = readers.read_raw_text(spark, str(path))
    assert df.columns == ["0", "1", "2", "3"] and df.count() == 150
    assert readers.read_raw_text(spark, str(path), max_lines=100).count() == 50


def test_json_forms(spark, tmp_path):
    records = [{"a": i, "n": {"x": i * 2, "l": [1, 2]}} for i in range(3)]
    (tmp_path / "records.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    (tmp_path / "object.json").write_text(json.dumps({"a": 1, "n": {"x": 2}}, indent=1))
    for name in ("records.json", "lines.json"):
        df = readers.load_table(spark, str(tmp_path / name)).df
        assert sorted(df.columns) == ["a", "n.l", "n.x"]
        assert sorted((r["a"], r["n.x"]) for r in df.collect()) == [(0, 0), (1, 2), (2, 4)]
    one = readers.load_table(spark, str(tmp_path / "object.json")).df
    assert one.columns == ["a", "n.x"] and one.first() == (1, 2)


def test_broken_json_lines_go_to_quarantine(spark, tmp_path):
    path = tmp_path / "broken.json"
    path.write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    got = readers.load_table(spark, str(path))
    assert sorted(r.a for r in got.df.collect()) == [1, 3]
    assert [r["__corrupt"] for r in got.quarantine.collect()] == ['{"a": 2']


def test_feather_folder(spark, tmp_path):
    folder = tmp_path / "many.feather"
    folder.mkdir()
    for k in range(3):
        feather.write_feather(pd.DataFrame({
            "i": [k, k + 10], "s": ["p", "q"], "t": pd.to_datetime(["2024-01-01", "2024-01-02"]),
            "b": [True, False]}), folder / f"{k}.feather")
    df = readers.load_table(spark, str(folder)).df
    assert df.count() == 6 and dict(df.dtypes)["t"] == "timestamp_ntz"


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.load_table(spark, "x", "xlsx")


def test_export_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>").withColumn(
        "t", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    for fmt in ("csv", "json", "parquet"):
        out = writers.export_tables({"x": df}, str(tmp_path / fmt), fmt)
        back = getattr(spark.read.option("header", True), fmt)(out["x"])
        assert back.count() == 1
        if fmt != "parquet":
            assert back.first().t.startswith("2024-01-02T03:04:05")
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path / "z"), "xlsx")


def test_synthetic_table(spark):
    df = synthetic.sample_expression(spark, 400, 300).cache()
    assert df.count() == 400 and df.select(F.size("genes")).distinct().first()[0] == 300
    stats = {r.Cluster: r for r in df.select("Cluster", F.explode("genes").alias("v"))
             .groupBy("Cluster").agg(F.count("*").alias("n"), F.percentile("v", 0.25).alias("q")).collect()}
    assert [stats[f"Cluster_{i}"].n for i in range(4)] == [100 * 300] * 4
    assert stats["Cluster_3"].q > stats["Cluster_0"].q + 6
    shares = df.agg(F.avg((F.col("Condition") == "Healthy").cast("int")), F.avg("Event"),
                    F.avg("Survival_Time")).first()
    assert abs(shares[0] - 0.7) < 0.1 and abs(shares[1] - 0.2) < 0.1 and abs(shares[2] - 730) < 150
    assert synthetic.widen(df, 300).columns[:2] == ["Sample_ID", "Gene_00000"]
    assert df.orderBy("Sample_ID").first() == \
        synthetic.sample_expression(spark, 400, 300).repartition(3).orderBy("Sample_ID").first()


def test_quoted_text_survives(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('id,text,n\n1,"x ""y"", z",10\n2,"line one\nline two",20\n3,plain,30\n')
    got = readers.load_table(spark, str(path))
    assert sorted((r.id, r.text, r.n) for r in got.df.collect()) == [
        (1, 'x "y", z', 10), (2, "line one\nline two", 20), (3, "plain", 30)]
    assert got.quarantine.count() == 0


def test_delimiter_is_judged_by_all_lines(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a;b,c\n" + "1;2,3\n" * 300 + "1;2,3,4\n")
    got = readers.load_table(spark, str(path))
    assert got.df.columns == ["a", "b,c"] and got.df.count() == 301 and got.quarantine.count() == 0


def test_names_that_differ_in_case(spark, tmp_path):
    path = tmp_path / "case.csv"
    path.write_text("a,A,b,a_1\n1,2,3,4\n")
    got = readers.load_table(spark, str(path)).df
    assert got.columns == ["a", "A_2", "b", "a_1"] and tuple(got.first()) == (1, 2, 3, 4)
