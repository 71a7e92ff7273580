"""Reading tables from files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telvane.operators.vocab import KDD_COLUMNS
from telvane.schema import FEATURES, UNIFIED_SCHEMA
from telvane.session import settle

#: The bytes 0x80 to 0x9F: control characters in ISO-8859-1, and what Windows-1252 makes of them.
CONTROLS = bytes(range(0x80, 0xA0)).decode("latin-1")
EXTRA = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
BROADCAST_FILES = 100_000
MIN_DELIMITED_ROWS = 11
MIN_ROWS = 100


def read_unified(spark: SparkSession, path: str) -> DataFrame:
    """The unified table, with its declared schema."""
    return spark.read.schema(UNIFIED_SCHEMA).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read by suffix: parquet, csv/txt with header, json (one document), jsonl (one per line).

    Pass a schema for text formats; without one Spark has to scan the data to guess types.
    """
    suffix = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix == "parquet":
        return reader.parquet(path)
    if suffix in ("csv", "txt"):
        return reader.csv(path, header=True, inferSchema=schema is None)
    if suffix == "json":
        return reader.json(path, multiLine=True)
    if suffix == "jsonl":
        return reader.json(path)
    raise ValueError(f"unsupported file type: {path}")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True, min_rows: int = MIN_DELIMITED_ROWS) -> DataFrame:
    """Tolerant text read of files in several encodings: lines with too many fields are skipped, bad values become null.

    The files are read once, a character for each byte (which delimiters survive), and written out; whether all bytes
    of a file are valid UTF-8 then decides how its fields are decoded. Other files are Windows-1252 if they use its
    extra characters, else ISO-8859-1. Fewer than ``min_rows`` rows are an error.
    """
    names = [f"`{f.name}`" for f in schema.fields]
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("__rest", T.StringType())])
    raw = spark.read.schema(text).csv(path, sep=sep, header=header, encoding="ISO-8859-1", mode="PERMISSIVE")
    rows = settle(raw.filter(F.col("__rest").isNull()).drop("__rest").withColumn("__file", F.input_file_name()), "delimited")
    whole = F.concat_ws("", *names)
    files = settle(rows.groupBy("__file").agg(
        F.min(F.is_valid_utf8(F.encode(whole, "ISO-8859-1").cast("string"))).alias("__utf8"), F.max(whole.rlike(f"[{CONTROLS}]")).alias("__extra"), F.count(F.lit(1)).alias("__n")
    ), "files")
    size = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("__n"), F.lit(0)).alias("rows")).first()
    if size["rows"] < min_rows:
        raise ValueError(f"no readable table: {path}")
    files = files.drop("__n")
    tagged = rows.join(F.broadcast(files) if size["files"] <= BROADCAST_FILES else files, "__file")

    def decoded(name: str) -> Column:
        value = F.col(name)
        return (
            F.when(F.col("__utf8"), F.encode(value, "ISO-8859-1").cast("string"))
            .when(F.col("__extra"), F.translate(value, CONTROLS, EXTRA))
            .otherwise(value)
        )

    return tagged.select(*[decoded(n).try_cast(f.dataType).alias(f.name) for n, f in zip(names, schema.fields)])


def read_telemetry(spark: SparkSession, path: str, sep: str = ";", partitions: int | None = None) -> DataFrame:
    """Process telemetry CSV (plain or gz) with ``time`` and ``attack``; signals as doubles.

    A file whose header differs from the first one's is an error, not a swap of
    columns. A gz file is read by one task, so its rows are spread before further work.
    """
    names = spark.read.csv(path, sep=sep, header=True, inferSchema=False).columns
    if "time" not in names or "attack" not in names:
        raise ValueError(f"{path} has no time/attack columns")
    kinds = {"time": T.StringType(), "attack": T.IntegerType()}
    schema = T.StructType([T.StructField(n, kinds.get(n, T.IntegerType() if n.startswith("attack") else T.DoubleType())) for n in names])
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=False).withColumn("source_file", F.input_file_name())
    packed = any(f.endswith(".gz") for f in df.inputFiles())
    return df.repartition(partitions or spark.sparkContext.defaultParallelism) if packed or partitions else df


def read_connection_records(spark: SparkSession, path: str) -> DataFrame:
    """Headerless connection records with their positional names."""
    text = {"protocol_type", "service", "flag", "attack_type"}
    schema = T.StructType([T.StructField(c, T.StringType() if c in text else T.DoubleType()) for c in KDD_COLUMNS])
    return spark.read.schema(schema).csv(path, header=False)


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in [*FEATURES, "label", "attack_cat"] if c not in df.columns]


def is_valid(df: DataFrame, min_rows: int = MIN_ROWS) -> bool:
    """Required columns and at least ``min_rows`` rows; reads no more rows than needed."""
    return not missing_columns(df) and df.limit(min_rows).count() >= min_rows


def validation_report(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    missing = missing_columns(df)
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    ok = F.lit(not missing) & (F.col("n_rows") >= min_rows)
    return counted.select("n_rows", F.lit(len(missing)).alias("n_missing_columns"), ok.alias("is_valid"))


def load_first_valid(candidates: list[tuple[str, Callable[[], DataFrame]]], min_rows: int = MIN_ROWS) -> tuple[str, DataFrame]:
    """The first named source that can be read and passes the gate."""
    for name, load in candidates:
        try:
            df = load()
            if is_valid(df, min_rows):
                return name, df
        except (AnalysisException, ValueError):
            continue
    raise ValueError("no source is valid")
