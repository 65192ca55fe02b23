"""Structured Streaming jobs over the batch expressions.

Checkpoints and sinks live in a shared folder the caller names. A sink has the rows of
each micro-batch in a folder of its own, named by the stream's id and the batch's
number, and a manifest: a batch counts once the manifest names it, and what the manifest
names is never overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.quality import keep_latest
from barloom.sources.archive import ENTRY, LAYOUT
from barloom.sources.payloads import snapshot_observations

TICK_KEY = ("archive_object_reference", "symbol", "observation_ts")
MINUTE_KEY = ("market", "symbol", "bar_ts")


def landed_lines(spark: SparkSession, path: str, *, files_per_batch: int | None = None
                 ) -> DataFrame:
    """Stream of (value, market, trading_date, run_id): lines of archive files as they land."""
    reader = spark.readStream.schema(
        "value string, market string, trading_date date, run_id string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).where(F.trim("value") != "")
    assert set(LAYOUT) <= set(lines.columns)
    return lines


def line_ticks(lines: DataFrame) -> DataFrame:
    """Observations of archive lines, each line of a reference decoded once.

    Copies of a line go before they are decoded, which costs more than to exchange
    them; the exchange also deals the lines of a gzip part, which can't be split, over tasks.
    """
    entries = lines.dropDuplicates([*LAYOUT, "value"]).select(
        F.concat_ws("/", F.col("market"), F.col("trading_date").cast("string"), F.col("run_id"))
        .alias("archive_object_reference"), F.from_json("value", ENTRY).alias("e"))
    return entries.select("archive_object_reference", F.inline(
        snapshot_observations("e.payload_body", "e.fetch_ts")))


# Bytes of a row group. A reading task sorts the rows of its groups by key, and a group is not cut.
GROUP_BYTES = 8 << 20
MANIFEST = "stream string, batch long, published_at timestamp, replaced boolean"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream for good."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def _entries(spark: SparkSession, sink: str) -> DataFrame:
    """The manifest; no rows before the first publication."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{sink}/batches")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def published(spark: SparkSession, sink: str) -> DataFrame:
    """(stream, batch, published_at) of the batches that count: published, and not replaced by a merged one."""
    live = _entries(spark, sink).groupBy("stream", "batch").agg(F.min("published_at").alias("published_at"), F.max("replaced").alias("_gone"))
    return live.where("NOT _gone").drop("_gone")


def _publish(spark: SparkSession, sink: str, rows: Sequence[tuple]) -> None:
    """Adds to the manifest in one file, so all of ``rows`` count or none."""
    spark.createDataFrame(list(rows), MANIFEST).coalesce(1).write.mode("append").parquet(f"{sink}/batches")


def _keep_batch(batch: DataFrame, number: int, sink: str, checkpoint: str, keys: Sequence[str]) -> None:
    """Stores a micro-batch under its stream's id and then publishes it.

    A batch that failed before it was published is written anew; a published one is left as it
    is, so what is repeated keeps its place in the order.
    """
    spark = batch.sparkSession
    stream = stream_id(spark, checkpoint)
    if not _entries(spark, sink).where((F.col("stream") == stream) & (F.col("batch") == number)).isEmpty():
        return
    rows = batch.dropDuplicates(list(keys)) if keys else batch
    rows.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{sink}/data/stream={stream}/batch={number}")
    _publish(spark, sink, [(stream, number, datetime.now(timezone.utc), False)])


def _stored(spark: SparkSession, sink: str, batches: DataFrame) -> DataFrame:
    rows = spark.read.option("basePath", f"{sink}/data").parquet(f"{sink}/data")
    return rows.withColumn("stream", F.col("stream").cast("string")).withColumn("batch", F.col("batch").cast("long")).join(batches, ["stream", "batch"])


def stream_tick_landing(spark: SparkSession, path: str, *, sink: str, checkpoint: str,
                        files_per_batch: int | None = None) -> StreamingQuery:
    """Lands observations, whatever their dates; ``landed`` reads them without copies.

    There is no state and no watermark: archives of old dates are landed as they come.
    Any number of streams may land in one sink, and a lost checkpoint lands all again
    beside what is there.
    """
    lines = landed_lines(spark, path, files_per_batch=files_per_batch)
    return (lines.writeStream.foreachBatch(lambda batch, i: _keep_batch(line_ticks(batch), i, sink, checkpoint, TICK_KEY))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def landed(spark: SparkSession, sink: str, keys: Sequence[str] = TICK_KEY, order: Sequence[str] = (),
           columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of all published batches, of each key the last one by publication and then ``order``.

    With ``columns``, keys and these alone: what is selected from a kept row is no hint for the reader.
    """
    rows = _stored(spark, sink, published(spark, sink))
    if columns is not None:
        rows = rows.select(*dict.fromkeys([*keys, *columns, "published_at", "stream", "batch", *order]))
    return keep_latest(rows, keys=keys, order=["published_at", "stream", "batch", *order]).drop("stream", "batch", "published_at")


def compact(spark: SparkSession, sink: str, keys: Sequence[str] = TICK_KEY, order: Sequence[str] = ()) -> None:
    """Merges all published batches into one, sorted by key, and publishes it in their place.

    The merged batch stands where the latest of those it replaces stood, so batches that are
    published meanwhile stay later. Readers see the old batches or the merged one;
    the old files stay for readers under way.
    """
    batches = published(spark, sink).collect()
    if len(batches) < 2:
        return
    told = [(b.stream, b.batch) for b in batches]
    merged = keep_latest(_stored(spark, sink, spark.createDataFrame(batches, "stream string, batch long, published_at timestamp")),
                         keys=keys, order=["published_at", "stream", "batch", *order]).drop("stream", "batch", "published_at")
    name = f"merged-{uuid.uuid4().hex}"
    merged.repartition(*keys).sortWithinPartitions(*keys).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{sink}/data/stream={name}/batch=0")
    latest = max(b.published_at for b in batches)
    _publish(spark, sink, [(name, 0, latest, False), *[(stream, batch, latest, True) for stream, batch in told]])


def stream_minute_upsert(source: DataFrame, *, table: str, checkpoint: str) -> StreamingQuery:
    """Streams minute bars (with ``seq``, their arrival order) into the table.

    Batches are kept side by side and merged when read, so nothing that is stored is
    overwritten and a lost driver costs the batch under way only.
    """
    return (source.writeStream.foreachBatch(lambda batch, i: _keep_batch(batch, i, table, checkpoint, ()))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def minute_table(spark: SparkSession, table: str) -> DataFrame:
    """The merged minute bars: per key the last write."""
    return landed(spark, table, MINUTE_KEY, ("seq",))
