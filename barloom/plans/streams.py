"""Queries: streaming jobs run to completion over landed files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.plans.catalog import query
from barloom.plans.ingest import tick_entries
from barloom.sources.archive import write_tick_archive
from barloom.sources.shared import cut_lineage, shared_dir
from barloom.sources.tables import table
from barloom.streaming import ticks


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_tick_landing", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol,
    CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS trading_date,
    CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us(date_trunc('second', ts)) // 1000 END AS millis
  FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""")
def _(spark, d):
    base = _folder(spark, "tick-stream")
    entries = cut_lineage(tick_entries(spark, d))  # written three times
    late = F.dayofmonth("trading_date") > 10
    # the later dates land first and every entry twice, at once or in both landings
    for part in (entries.where(late), entries.unionByName(entries.where(~late))):
        write_tick_archive(part, f"{base}/in")
        ticks.stream_tick_landing(spark, f"{base}/in", sink=f"{base}/out",
                                  checkpoint=f"{base}/checkpoint").awaitTermination()
    # a stream whose checkpoint is lost lands all once more
    ticks.stream_tick_landing(spark, f"{base}/in", sink=f"{base}/out", checkpoint=f"{base}/checkpoint-2").awaitTermination()
    rows = ticks.landed(spark, f"{base}/out", columns=["trading_date"])
    return present(rows.select("symbol", "trading_date",
                               F.unix_millis("observation_ts").alias("millis")))


@query("stream_minute_upsert", """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS symbol,
    round(value + CASE WHEN event_id % 3 = 0 THEN 5 ELSE 0 END, 6) AS close
  FROM events""")
def _(spark, d):
    base = _folder(spark, "minute-stream")
    e = table(spark, d, "events")
    rows = e.select(
        F.to_date("ts").alias("trading_date"), F.lit("TW").alias("market"),
        F.col("user_id").cast("string").alias("symbol"), F.to_timestamp("ts").alias("bar_ts"),
        F.col("value").alias("close"), F.col("event_id").alias("seq"))
    # two sources, each with batches of its own from 0 on; the second corrects and adds
    first = rows.where("seq % 3 <> 0 OR seq % 2 = 0")
    second = rows.where("seq % 3 = 0").withColumn("close", F.col("close") + 5)
    for i, part in enumerate((first, second)):
        part.coalesce(1).write.parquet(f"{base}/in-{i}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in-{i}")
        ticks.stream_minute_upsert(stream, table=f"{base}/table", checkpoint=f"{base}/checkpoint-{i}").awaitTermination()
    return present(ticks.minute_table(spark, f"{base}/table").select("seq", "symbol", "close"))
