"""Streams that lose no stored row."""

import datetime as dt
import json
from pathlib import Path

from pyarrow import parquet as pq
from pyspark.sql import functions as F

from barloom.sources.archive import write_tick_archive
from barloom.streaming import ticks

SCHEMA = "market string, symbol string, bar_ts timestamp, close double, seq long"


def _deliver(spark, folder, name, rows, checkpoint=None):
    T = dt.datetime(2024, 1, 2, 9)
    spark.createDataFrame([("TW", s, T, c, q) for s, c, q in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in-{name}")
    _run(spark, folder, name, checkpoint)


def _run(spark, folder, name, checkpoint=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-{name}")
    ticks.stream_minute_upsert(stream, table=f"{folder}/table", checkpoint=f"{folder}/{checkpoint or name}").awaitTermination()


def _closes(spark, folder):
    return {r.symbol: r.close for r in ticks.minute_table(spark, f"{folder}/table").collect()}


def test_sources_and_lost_checkpoints_lose_nothing(spark, tmp_path):
    folder = str(tmp_path)
    _deliver(spark, folder, "a", [("x", 1.0, 1), ("y", 1.0, 2)])
    _deliver(spark, folder, "b", [("z", 3.0, 1), ("y", 3.0, 1)])
    assert _closes(spark, folder) == {"x": 1.0, "y": 3.0, "z": 3.0}
    _deliver(spark, folder, "a", [("x", 4.0, 1)])
    assert _closes(spark, folder) == {"x": 4.0, "y": 3.0, "z": 3.0}
    # a new checkpoint delivers all of b again: the last write wins, nothing is lost
    _run(spark, folder, "b", "b-again")
    assert _closes(spark, folder) == {"x": 4.0, "y": 3.0, "z": 3.0}
    assert ticks.published(spark, f"{folder}/table").count() == 4


def test_only_published_batches_count_and_once(spark, tmp_path):
    folder = str(tmp_path)
    _deliver(spark, folder, "a", [("x", 1.0, 1)])
    sink, name = f"{folder}/table", ticks.stream_id(spark, f"{folder}/a")
    stray = spark.createDataFrame([("TW", "w", dt.datetime(2024, 1, 2, 9), 9.0, 9)], SCHEMA)
    stray.write.parquet(f"{sink}/data/stream={name}/batch=7")  # a driver was lost before it published
    assert _closes(spark, folder) == {"x": 1.0}
    # a published batch that is repeated changes nothing, an unpublished one is written anew
    ticks._keep_batch(stray, 0, sink, f"{folder}/a", ())
    assert _closes(spark, folder) == {"x": 1.0}
    ticks._keep_batch(stray, 7, sink, f"{folder}/a", ())
    assert _closes(spark, folder) == {"x": 1.0, "w": 9.0}


def test_compaction_keeps_the_last_writes(spark, tmp_path):
    folder = str(tmp_path)
    for i, rows in enumerate(([("x", 1.0, 1), ("y", 1.0, 2)], [("x", 2.0, 1)], [("z", 3.0, 5), ("z", 4.0, 6)])):
        _deliver(spark, folder, "ab"[i % 2], rows)
    before = _closes(spark, folder)
    ticks.compact(spark, f"{folder}/table", ticks.MINUTE_KEY, ("seq",))
    assert _closes(spark, folder) == before == {"x": 2.0, "y": 1.0, "z": 4.0}
    assert ticks.published(spark, f"{folder}/table").count() == 1
    ticks.compact(spark, f"{folder}/table", ticks.MINUTE_KEY, ("seq",))  # nothing to merge
    _deliver(spark, folder, "b", [("y", 7.0, 1)])
    assert _closes(spark, folder) == {"x": 2.0, "y": 7.0, "z": 4.0}


def test_a_large_batch_is_stored_in_groups_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ticks, "stream_id", lambda *_: "s")
    rows = spark.range(0, 2_000_000, 1, 1).select(F.xxhash64("id").alias("a"), F.xxhash64("id", "id").alias("b"))
    ticks._keep_batch(rows, 0, str(tmp_path), "none", ())
    (file,) = Path(tmp_path, "data").rglob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 2_000_000
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) <= 1.2 * ticks.GROUP_BYTES


def test_copies_of_a_line_are_decoded_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    quotes = [{"c": c, "d": "20240102", "t": f"09:00:0{i}", "z": "1.5", "v": "3", "b": "1_2_"} for i, c in enumerate("xyz")]
    entry = (dt.date(2024, 1, 2), dt.datetime(2024, 1, 2), json.dumps({"msgArray": quotes}))
    rows = [("TW", entry[0], run, *entry[1:]) for run in ("r0", "r0", "r1")]
    write_tick_archive(spark.createDataFrame(rows, "market string, trading_date date, run_id string, fetch_ts timestamp, payload_body string")
                       .coalesce(1), f"{folder}/in")
    decoded, keep = [], ticks._keep_batch

    def counted(batch, *rest):
        decoded.append(batch.count())
        keep(batch, *rest)

    monkeypatch.setattr(ticks, "_keep_batch", counted)
    for checkpoint in ("a", "b"):  # the second is a lost checkpoint
        ticks.stream_tick_landing(spark, f"{folder}/in", sink=f"{folder}/out", checkpoint=f"{folder}/{checkpoint}").awaitTermination()
    assert decoded == [6, 6]
    whole = ticks.landed(spark, f"{folder}/out")
    assert sorted((r.archive_object_reference[-2:], r.symbol, r.last_price, r.best_bid_prices) for r in whole.collect()) == [
        (run, c, 1.5, [1.0, 2.0]) for run in ("r0", "r1") for c in "xyz"]
    part = ticks.landed(spark, f"{folder}/out", columns=["last_price"])
    assert part.columns == [*ticks.TICK_KEY, "last_price"]
    assert sorted(part.collect()) == sorted(whole.select(part.columns).collect())
