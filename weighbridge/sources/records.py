"""Record files: line-delimited JSON (plain or gzip), Parquet, frozen splits and prediction feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weighbridge.functions.text import canonical_json, digest, parse_state


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; only a newline ends a record and blank lines are skipped.

    Gzip files are read whole by one task each, so a few large ones should be repartitioned right after reading.
    """
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decode_records(df: DataFrame, json_cols: tuple[str, ...] = ("state", "question", "soft_label", "meta")) -> DataFrame:
    """JSON-encoded text columns to VARIANT, parsed once, plus the two identity hashes."""
    pair = F.concat(F.lit("["), canonical_json(F.col("state")), F.lit(","), canonical_json(F.col("question")), F.lit("]"))
    out = df.withColumns({"state_sha256": digest(F.col("state")), "input_sha256": F.sha2(pair, 256)})
    return out.withColumns({c: parse_state(F.col(c)) for c in json_cols if c in df.columns})


def write_split(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Write JSON lines; fails if the split exists."""
    writer = df.write.mode("errorifexists").option("ignoreNullFields", "false")
    (writer.option("compression", compression) if compression else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated with a header; fails if the file exists."""
    df.write.mode("errorifexists").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What write_csv wrote; a header that names other columns is an error."""
    return spark.read.option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").schema(schema).csv(path)


def prediction_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json") -> DataFrame:
    """Predictions as they are appended: a streaming frame over files dropped into a folder."""
    reader = spark.readStream.schema(schema)
    if fmt == "json":
        reader = reader.option("lineSep", "\n")
    return reader.format(fmt).load(path)
