"""Tick archives: gzip JSON-lines parts laid out by market, date and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.columns import ratio_or_zero
from barloom.sources.payloads import parse_tick_snapshot

ENTRY = "fetch_ts timestamp, payload_body string"
LAYOUT = ("market", "trading_date", "run_id")


def write_tick_archive(entries: DataFrame, path: str) -> None:
    """entries (market, trading_date, run_id, fetch_ts, payload_body) -> gz parts.

    No repartition by date: a hot date keeps the parallelism of its input.
    """
    lines = entries.select(*LAYOUT, F.to_json(F.struct("fetch_ts", "payload_body")).alias("value"))
    (lines.write.mode("append").partitionBy(*LAYOUT).option("compression", "gzip").text(path))


def read_tick_archive(spark: SparkSession, path: str) -> DataFrame:
    """(market, trading_date, run_id, object_key, fetch_ts, payload_body)."""
    lines = (spark.read.schema("value string, market string, trading_date date, run_id string")
             .text(path))
    rows = lines.where(F.trim("value") != "").select(
        *LAYOUT, F.input_file_name().alias("object_key"),
        F.from_json("value", ENTRY).alias("e"))
    return rows.select(*LAYOUT, "object_key", "e.fetch_ts", "e.payload_body")


def archive_observations(spark: SparkSession, path: str) -> DataFrame:
    """Decoded observations with the object they came from."""
    entries = read_tick_archive(spark, path).select(
        "object_key", F.col("market").alias("declared_market"),
        F.col("trading_date").alias("declared_date"), "run_id", "fetch_ts", "payload_body")
    return parse_tick_snapshot(entries)


def archive_part_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per object: bytes, max(0, 1 - c/u), sha256, records, first and last time."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.gz").load(path)
             .select(_key("path").alias("_k"), F.col("length").alias("compressed_bytes"),
                     F.sha2("content", 256).alias("checksum")))
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        _key(F.input_file_name()).alias("_k"),
        (F.octet_length("value") + 1).alias("_b"))
    sizes = lines.groupBy("_k").agg(F.sum("_b").alias("uncompressed_bytes"))
    seen = archive_observations(spark, path).groupBy(_key("object_key").alias("_k")).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min("observation_ts").alias("first_observation_ts"),
        F.max("observation_ts").alias("last_observation_ts"))
    saved = F.lit(1.0) - ratio_or_zero("compressed_bytes", "uncompressed_bytes")
    return (files.join(sizes, "_k", "left").join(seen, "_k", "left")
            .withColumn("compression_ratio", F.when(
                F.col("uncompressed_bytes") > 0, F.greatest(F.lit(0.0), saved))
                .otherwise(F.lit(0.0)))
            .withColumn("record_count", F.coalesce("record_count", F.lit(0)))
            .withColumnRenamed("_k", "object_key"))


def _key(path):
    """Object key without the scheme, so that every source names it alike."""
    c = F.col(path) if isinstance(path, str) else path
    return F.url_decode(F.regexp_replace(c, "^file:/+", "/"))


def validate_archive_import(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good observations, (object_key, issue) of the rejected objects).

    An object must hold observations of its declared market and date only.
    """
    g = observations.groupBy("object_key").agg(
        F.min(F.col("market") == F.col("declared_market")).alias("_m"),
        F.min(F.col("trading_date") == F.col("declared_date")).alias("_d"))
    issue = F.when(~F.col("_m"), "market mismatch").when(~F.col("_d"), "date mismatch")
    bad = g.select("object_key", issue.alias("issue")).where("issue IS NOT NULL")
    return observations.join(bad, "object_key", "left_anti"), bad


def replace_tick_partition(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored observations with every archive reference of ``incoming`` replaced.

    Incoming rows are unique per (reference, symbol, time).
    """
    touched = incoming.select("archive_object_reference").distinct()
    kept = stored.join(touched, "archive_object_reference", "left_anti")
    return kept.unionByName(incoming.select(stored.columns))


def write_tick_partition(incoming: DataFrame, path: str) -> None:
    """The same on files: only the touched reference partitions are rewritten."""
    (incoming.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("archive_object_reference").parquet(path))
