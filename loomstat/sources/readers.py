"""Table readers: format, delimiter and encoding detection, JSON flattening, quarantine.

Detection counts over all lines in Spark; only the first line reaches the driver. Every reader reports what it tried.
"""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import nan_to_null, q
from ..operators.clean import unique_names

# Readable extensions and the delimiters in the order they are tried.
EXTENSIONS = ("csv", "tsv", "txt", "parquet", "json", "feather")
DELIMITERS = (",", "\t", ";", "|", " ")
# a delimiter may leave this share of the lines with surplus fields, if none leaves fewer
SURPLUS_SHARE = 0.01


@dataclass
class Loaded:
    df: DataFrame
    file_type: str
    attempts: list[str] = field(default_factory=list)
    quarantine: DataFrame | None = None


def detect_format(path: str) -> str:
    """Lower-case extension, or txt when there is none or it is not known."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[-1] if "." in name else "txt"
    return ext if ext in EXTENSIONS else "txt"


def load_table(spark: SparkSession, path: str, fmt: str | None = None,
               sampling_ratio: float = 1.0) -> Loaded:
    """Read any supported file or folder of files; NaN becomes NULL."""
    fmt = fmt or detect_format(path)
    if fmt in ("csv", "tsv", "txt"):
        got = read_delimited(spark, path, fmt, sampling_ratio)
    elif fmt == "parquet":
        got = Loaded(spark.read.parquet(path), fmt, ["Success reading Parquet file"])
    elif fmt == "json":
        got = read_json(spark, path)
    elif fmt == "feather":
        got = Loaded(read_feather(spark, path), fmt, ["Success reading Feather file"])
    else:
        raise ValueError(f"unsupported format: {fmt}")
    got.df = nan_to_null(got.df)
    return got


# ---- delimited text -------------------------------------------------------------------

def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-16 by its byte order mark, UTF-8 if every line is valid, else ISO-8859-1.

    Spark knows no other single-byte Western name; latin1 and cp1252 text is read as
    ISO-8859-1.
    """
    lines = spark.read.text(path)
    head = lines.select(F.col("value").cast("binary").alias("b")).head()
    if head is not None and bytes(head.b[:2]) in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    valid = lines.agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    return "UTF-8" if valid is not False else "ISO-8859-1"


def header_of(first: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(first), delimiter=sep))


def surplus_shares(lines: DataFrame, first: str) -> tuple[dict[str, float], bool]:
    """({delimiter: share of the lines with more fields than the first}, whether a line break stands
    inside quotes). One pass over all lines; text in quotes does not count."""
    bare = F.regexp_replace("value", '"(?:[^"]|"")*"', "")
    wider = [F.avg((F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))
                    >= len(header_of(first, sep))).cast("int")) for sep in DELIMITERS]
    row = lines.filter(F.trim("value") != "").agg(*wider, F.max(F.contains(bare, F.lit('"')))).first()
    return dict(zip(DELIMITERS, row[:-1])), bool(row[-1])


def choose_delimiter(first: str | None, surplus: dict[str, float]) -> tuple[str | None, list[str], list[str]]:
    """(delimiter, header, attempts): the first delimiter that gives more than one column and no line
    with more fields than the header; failing that, the first with at most SURPLUS_SHARE such lines,
    which go to quarantine; failing that, the last that gives one column."""
    if not first:
        return None, [], ["Failed: no lines"]
    attempts: list[str] = []
    headers = {sep: header_of(first, sep) for sep in DELIMITERS}
    for most in (0.0, SURPLUS_SHARE):
        for sep, header in headers.items():
            if len(header) > 1 and surplus[sep] <= most:
                attempts.append(f"Success with delimiter '{sep}'")
                return sep, header, attempts
            if surplus[sep] > most:
                attempts.append(f"Failed with delimiter '{sep}': {surplus[sep]:.2%} of the lines have more than {len(header)} fields")
    single = [sep for sep, header in headers.items() if surplus[sep] == 0]
    return (single[-1], headers[single[-1]], attempts) if single else (None, [], attempts)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(value): the lines of the files as text."""
    if encoding == "UTF-16":
        return spark.read.csv(path, sep="\u0001", quote="", encoding=encoding, multiLine=True, schema="value string")
    return spark.read.text(path).select(F.decode(F.col("value").cast("binary"), encoding).alias("value"))


def read_delimited(spark: SparkSession, path: str, fmt: str = "csv",
                   sampling_ratio: float = 1.0) -> Loaded:
    """Delimited text with a header. Quoted fields may hold delimiters, doubled quotes and line breaks;
    files with such breaks, like UTF-16 ones, cannot be split and are read by one task each."""
    encoding = detect_encoding(spark, path)
    lines = _lines(spark, path, encoding)
    first = lines.filter(F.trim("value") != "").head()
    first, surplus, broken = first and first.value, {}, False
    if first:
        surplus, broken = surplus_shares(lines, first)
        if broken:          # lines are not records here, so parsed records are counted
            surplus = {sep: _surplus_records(spark, path, encoding, sep, len(header_of(first, sep))) for sep in DELIMITERS}
    sep, header, attempts = choose_delimiter(first, surplus)
    if encoding != "UTF-8":
        attempts.append(f"Success with encoding {encoding}")
    if sep is None:
        attempts.append("Success reading as raw text")
        return Loaded(read_raw_text(spark, path), fmt, attempts)
    options = dict(sep=sep, header=True, encoding=encoding, multiLine=broken or encoding == "UTF-16",
                   mode="PERMISSIVE", nanValue="NaN", quote='"', escape='"')
    inferred = spark.read.csv(path, inferSchema=True, samplingRatio=sampling_ratio, **options).schema
    names = unique_names([h.strip() or f"Unnamed: {i}" for i, h in enumerate(header)])
    # one column more than the header catches rows with surplus fields; short rows get nulls
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, inferred)]
                          + [T.StructField("__surplus", T.StringType())])
    raw = spark.read.csv(path, schema=schema, **options)
    good = raw.filter(F.col("__surplus").isNull()).drop("__surplus")
    return Loaded(good, fmt, attempts, raw.filter(F.col("__surplus").isNotNull()))


def _surplus_records(spark: SparkSession, path: str, encoding: str, sep: str, fields: int) -> float:
    """The share of records with more fields than that."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(fields + 1)])
    rows = spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"')
    return rows.agg(F.avg(F.col(f"c{fields}").isNotNull().cast("int"))).first()[0] or 0.0


def read_raw_text(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Whitespace-split non-blank lines as positional columns "0", "1", ..."""
    lines = spark.read.text(path)
    if max_lines is not None:
        lines = lines.limit(max_lines)
    words = lines.filter(F.trim("value") != "").select(
        F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("w"))
    width = words.agg(F.max(F.size("w"))).first()[0] or 0
    return words.select(*[F.get("w", F.lit(i)).alias(str(i)) for i in range(width)])


# ---- JSON -----------------------------------------------------------------------------

def flatten(df: DataFrame) -> DataFrame:
    """Struct fields become columns with dotted names; arrays stay."""
    def leaves(dtype: T.DataType, column, name: str):
        if isinstance(dtype, T.StructType):
            for f in dtype:
                yield from leaves(f.dataType, column.getField(f.name), f"{name}.{f.name}")
        else:
            yield column.alias(name)

    return df.select(*[x for f in df.schema for x in leaves(f.dataType, q(f.name), f.name)])


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str, normalize: bool = True) -> Loaded:
    """JSON Lines, an array of objects, or one object; broken records go to quarantine."""
    head = [r.value for r in spark.read.text(path).filter(F.trim("value") != "").limit(2).collect()]
    by_line = bool(head) and head[0].lstrip().startswith("{") and _is_json(head[0])
    bad = "__corrupt"
    raw = spark.read.json(path, multiLine=not by_line, mode="PERMISSIVE",
                          columnNameOfCorruptRecord=bad)
    quarantine = None
    if bad in raw.columns:
        quarantine = raw.filter(F.col(bad).isNotNull())
        raw = raw.filter(F.col(bad).isNull()).drop(bad)
    attempts = ["Success reading JSON file"]
    if normalize and any(isinstance(f.dataType, T.StructType) for f in raw.schema):
        raw = flatten(raw)
        attempts.append("Success normalizing JSON")
    return Loaded(raw, "json", attempts, quarantine)


# ---- Feather --------------------------------------------------------------------------

def _spark_arrow(schema):
    """The Arrow schema Spark can take: microsecond timestamps, categories as their values."""
    import pyarrow as pa

    def kind(t):
        if pa.types.is_timestamp(t):
            return pa.timestamp("us", t.tz)
        if pa.types.is_dictionary(t):
            return kind(t.value_type)
        return pa.float32() if pa.types.is_float16(t) else t

    return pa.schema([pa.field(f.name, kind(f.type)) for f in schema])


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather files, one task per group of files; the format cannot be split further."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")

    def tables(batches):
        import pyarrow.feather as feather
        for batch in batches:
            for content in batch.column("content"):
                table = feather.read_table(pa.BufferReader(content.as_py()))
                yield table.cast(_spark_arrow(table.schema))

    def names(batches):
        for table in tables(batches):
            yield pa.RecordBatch.from_pydict({"schema": [table.schema.serialize().to_pybytes()]})

    def rows(batches):
        for table in tables(batches):
            yield from table.to_batches()

    first = files.limit(1).mapInArrow(names, "schema binary").first()
    if first is None:
        raise ValueError(f"no files at {path}")
    arrow = pa.ipc.read_schema(pa.BufferReader(bytes(first.schema)))
    return files.mapInArrow(rows, from_arrow_schema(arrow, prefer_timestamp_ntz=True))
