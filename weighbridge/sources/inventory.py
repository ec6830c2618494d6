"""Files and tables against their manifests, and the keys of earlier splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.functions.text import digest

RANGE = 64 << 20  # bytes of a file that one row stands for
CHUNK = 4 << 20  # bytes in memory at once while a longer piece is hashed

# File names that mark an earlier split as training data.
TRAIN_FILES = ("train.jsonl", "train-prompts.jsonl", "tokenized.jsonl")


def _open(path: str):
    """Paths come from Spark's listing, unescaped."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(inner)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for path, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length")), strict=True):
            sha, at = hashlib.sha256(), start
            with _open(path) as file:
                while at < start + length:
                    block = file.read_at(min(CHUNK, start + length - at), at)
                    if not len(block):
                        raise OSError(f"{path} ends at {at}, expected {start + length}: it changed while it was read")
                    sha.update(block)
                    at += len(block)
            made.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "bytes", "start")), pa.array(made, pa.string())], names=["name", "bytes", "start", "sha256"])


def file_ranges(spark: SparkSession, directory: str, pattern: str = "*", range_bytes: int | None = RANGE) -> DataFrame:
    """name, bytes, start and sha256 of every range of range_bytes of every file below a directory; None makes one range of a file.

    Spark's listing passes over empty files, so they have no row. Files of one range no longer than RANGE come through Spark's reader, from any store it reads. Longer ones are
    opened at the range by the task that hashes it, in pieces of CHUNK, from stores that Arrow opens (local, HDFS, S3, GCS, Azure).
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
    name = F.element_at(F.split("path", F.lit("/" + directory.split(":", 1)[-1].strip("/") + "/"), 2), -1).alias("name")
    alone = F.col("length") <= min(RANGE, range_bytes or RANGE)
    whole = every.filter(alone).select(name, F.col("length").alias("bytes"), F.lit(0).cast("bigint").alias("start"), F.sha2("content", 256).alias("sha256"))
    # Listing does not read contents; ranges are dealt out by themselves, so that one long file keeps all tasks busy.
    long = every.filter(~alone).select("path", name, F.col("length").alias("bytes"))
    step = F.lit(range_bytes).cast("bigint") if range_bytes else F.col("bytes")
    pieces = long.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, step)).alias("start")).withColumn("length", F.least(F.col("bytes") - F.col("start"), step))
    dealt = pieces.repartition("path", "start")
    return whole.unionByName(dealt.mapInArrow(_hash_pieces, "name string, bytes bigint, start bigint, sha256 string"))


def file_inventory(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """name, bytes and sha256 of every file below a directory, as a manifest has them.

    SHA-256 is sequential: a long file is streamed through one task, in constant memory. `range_inventory` hashes a file's ranges in parallel.
    """
    return file_ranges(spark, directory, pattern, None).select("name", "bytes", "sha256")


def range_inventory(spark: SparkSession, directory: str, pattern: str = "*", range_bytes: int = RANGE) -> DataFrame:
    """name, bytes, ranges and range_sha256 of every file: the hash over the hex hashes of its ranges, in their order."""
    of_file = file_ranges(spark, directory, pattern, range_bytes).groupBy("name", "bytes").agg(
        F.count(F.lit(1)).alias("ranges"), F.array_sort(F.collect_list(F.struct("start", "sha256"))).alias("_r"))
    # 90 bytes a range: some MB for a file of a few TB.
    return of_file.select("name", "bytes", "ranges", F.sha2(F.array_join(F.transform("_r", lambda r: r["sha256"]), "").cast("binary"), 256).alias("range_sha256"))


def content_fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint: row count and the sum of 32-bit row hashes, per group."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("decimal(20,0)")).alias("checksum"))


def inventory_compare(actual: DataFrame, manifest: DataFrame, name: str, size: str, checksum: str) -> DataFrame:
    """name and status: ok, extra, missing, size differs, checksum differs, or not hashed where the actual side has no checksum."""
    a = actual.select(name, F.col(size).alias("_as"), F.col(checksum).alias("_ac"), F.lit(True).alias("_a"))
    m = manifest.select(name, F.col(size).alias("_ms"), F.col(checksum).alias("_mc"), F.lit(True).alias("_m"))
    status = (
        F.when(F.col("_m").isNull(), "extra").when(F.col("_a").isNull(), "missing").when(F.col("_as") != F.col("_ms"), "size differs")
        .when(F.col("_ac").isNull() & F.col("_mc").isNotNull(), "not hashed").when(~F.col("_ac").eqNullSafe(F.col("_mc")), "checksum differs").otherwise("ok")
    )
    return a.join(m, name, "full").select(name, status.alias("status"))


def inventory_verify(spark: SparkSession, directory: str, manifest: DataFrame, pattern: str = "*") -> DataFrame:
    """Files on disk against a manifest (name, bytes, sha256). Empty files of the manifest are `not listed`, as Spark lists none."""
    empty = F.coalesce(F.col("bytes") == 0, F.lit(False))
    compared = inventory_compare(file_inventory(spark, directory, pattern), manifest.filter(~empty), "name", "bytes", "sha256")
    return compared.unionByName(manifest.filter(empty).select("name", F.lit("not listed").alias("status")))


PRIOR_SCHEMA = "id string, record_id string, state_sha256 string, state string"


def prior_keys(spark: SparkSession, roots: Sequence[str], train_names: Sequence[str] = TRAIN_FILES) -> DataFrame:
    """Keys of every earlier split below the roots: kind, file, id, state_sha256, one key per row.

    Folders named raw are skipped. A row gives its id, its record_id, and its state hash, computed where the row
    has only the state.
    """
    files = spark.read.schema(PRIOR_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(list(roots))
    path = F.col("_metadata.file_path")
    rows = files.filter(~path.contains("/raw/")).withColumn("file", F.regexp_extract(path, r"([^/]+\.jsonl)(?:/[^/]*)?$", 1))
    state = F.coalesce("state_sha256", F.when(F.col("state").isNotNull(), digest(F.col("state"))))
    keys = rows.select(
        F.when(F.col("file").isin(*train_names), "train").otherwise("eval").alias("kind"), "file",
        F.explode(F.array(
            F.struct(F.col("id").alias("id"), state.alias("state_sha256")), F.struct(F.col("record_id").alias("id"), F.lit(None).cast("string").alias("state_sha256")),
        )).alias("k"),
    ).select("kind", "file", "k.id", "k.state_sha256")
    return keys.filter(F.col("id").isNotNull() | F.col("state_sha256").isNotNull()).distinct()
