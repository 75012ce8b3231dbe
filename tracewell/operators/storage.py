"""Content-addressed storage, sinks and costs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import DEFAULTS


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share; a temporary one where none is set and all is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a round of a loop plans no earlier one again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 8192), F.lit("\x00"))


def store(contents: DataFrame, by: list[str], order: str, most: int = DEFAULTS.keep_blob_chars) -> DataFrame:
    """One row per distinct content (of each session): hash, references, first user, size and the text cut to ``most`` characters.

    Contents with a NUL among the first characters count as binary and are left out.
    """
    rows = contents.where(F.col("content").isNotNull() & ~is_binary(F.col("content")))
    rows = rows.select(*by, content_hash(F.col("content")).alias("hash"), F.col(order).alias("_at"), F.octet_length("content").alias("size_bytes"), F.substring("content", 1, most).alias("text"))
    return rows.groupBy(*by, "hash").agg(F.count(F.lit(1)).alias("references"), F.min("_at").alias("first"), F.max("size_bytes").alias("size_bytes"), F.min("text").alias("text"))


def stats(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count(F.lit(1)).alias("blobs"), F.sum(F.col("size_bytes").cast("long")).alias("bytes"), F.sum(F.col("references") - 1).alias("saved"))


def manifest_blobs(manifests: DataFrame, media: DataFrame) -> DataFrame:
    """Blobs that manifests list, with their texts; snapshots and blank texts are left out."""
    rows = manifests.select("trajectory_id", F.explode("entries").alias("hash", "e")).where((F.col("e.type") == "blob") & ~F.contains(F.col("e.original_path"), F.lit("fs_snapshot")))
    texts = media.select("trajectory_id", F.regexp_extract("path", r"([^/]+)\.blob$", 1).alias("hash"), "text")
    return rows.join(texts, ["trajectory_id", "hash"]).where(F.trim("text") != "").select("trajectory_id", "hash", "e.original_path", "e.size_bytes", "text")


def costs(prompts: DataFrame, by: str, text: str) -> DataFrame:
    """Calls and tokens, four characters each."""
    return prompts.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.floor(F.length(text) / 4)).alias("tokens"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, tie: str | None = None) -> DataFrame:
    """The latest row of each key; of rows of one version the greatest in ``tie``, else a new one before an old one."""
    old, new = old.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))
    w = W.partitionBy(*keys).orderBy(F.desc(version), *([F.desc(tie)] if tie else []), F.desc("_new"))
    return old.unionByName(new).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "_new")


#: Folders that a sink deals profiles to: a folder for each would make as many files as there are profiles.
BUCKETS = 64


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def append_events(events: DataFrame, path: str) -> None:
    """Events in folders of many profiles, by ``bucket``; each append adds a few files to each, by size."""
    events.withColumn("bucket", bucket("profile_id")).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def pack(files: DataFrame, path: str) -> None:
    """Small files (path, value), a row for each, as Parquet: sorted by path, so that a reader of few skips most."""
    files.select("path", "value").sortWithinPartitions("path").write.parquet(path)


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Summaries, questions and agreement reports."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, by: list[str]) -> None:
    """Prompts and session logs: one text column besides the keys that name the folders, few of many rows each (see ``bucket``)."""
    df.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").text(path)
