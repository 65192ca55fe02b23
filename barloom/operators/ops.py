"""Operational KPIs, tick archive KPIs, gates and order tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.asof import asof_last
from barloom.functions.columns import count_true, hours_between, ratio
from barloom.operators.quality import MAX_ATTEMPTS
from barloom.operators.universe import active_window_in_month

# Windows, limits and vocabularies.
KPI_TRADING_DAYS = 20
KPI_CALENDAR_DAYS = 90
FIRST_ATTEMPT_PASS = 99.0
RETRY_PASS = 99.5
SYMBOL_PASS = 0.95
DELTA_PASS = 1
REPLAY_HOURS = 4.0
EVENT_HOURS = 24.0
EVENT_SAMPLE = 5
RECOVERABLE_CLASSES = ("official_exchange", "official_issuer")
COMPRESSION_PASS = 50.0
RESTORE_MINUTES = 30.0
BENCHMARK_BYTES = 5 * 1024 ** 3
NOTIONAL_LIMIT = 1_000_000.0
ZONES = {"TW": "Asia/Taipei", "US": "America/New_York"}
CONCENTRATION_METRICS = ("weight_concentration", "max_position_weight", "top_5_weight_share",
                         "top_10_weight_share")
LEDGER_EVENTS = ("submitted", "acknowledged", "filled", "position_readback")
GATE_FIELDS = ("tradability_state", "investability_screening_active", "capacity_screening_active",
               "missing_feature_policy_state", "corporate_event_state", "full_universe_count",
               "execution_universe_count", "execution_universe_ratio",
               "liquidity_bucket_schema_version", "stale_mark_days_with_open_positions",
               "stale_risk_share")


def _kpi(df: DataFrame, keys: Sequence[str], rows: Mapping[str, tuple]) -> DataFrame:
    """(keys, kpi, value, status) from name -> (value, status) columns."""
    return df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("kpi"), v.cast("double").alias("value"), s.alias("status"))
        for n, (v, s) in rows.items()])))


def _pass(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")


def latest_days(calendar: DataFrame, n: int) -> DataFrame:
    """The last ``n`` dates per market, as one short array per market."""
    rank = F.row_number().over(Window.partitionBy("market").orderBy(F.col("date").desc()))
    return (calendar.withColumn("_r", rank).where(F.col("_r") <= n)
            .groupBy("market").agg(F.sort_array(F.collect_list("date")).alias("days")))


def kpi_ingest_success(watchlists: DataFrame, runs: DataFrame, attempts: DataFrame,
                       calendar: DataFrame) -> DataFrame:
    """First-attempt and any-attempt success over watchlist x last 20 days.

    ``watchlists``: (watchlist_id, market, created_date); ``runs``: (run_id,
    watchlist_id, date); ``attempts``: (run_id, attempt_number, status).
    """
    days = latest_days(calendar, KPI_TRADING_DAYS)
    slots = watchlists.join(days, "market").select(
        "market", "watchlist_id", "created_date", F.explode("days").alias("date")).where(
        F.col("created_date") <= F.col("date"))
    won = F.col("status") == "succeeded"
    tries = attempts.groupBy("run_id").agg(
        F.min_by(won, F.col("attempt_number")).alias("_first"), F.max(won).alias("_any"))
    j = (slots.join(runs.select("watchlist_id", "date", "run_id"), ["watchlist_id", "date"], "left")
         .join(tries, "run_id", "left"))
    g = j.groupBy("market").agg(
        F.count(F.lit(1)).alias("slots"), count_true(F.col("_first")).alias("_f"),
        count_true(F.col("_any")).alias("_a"))
    first, any_ = ratio("_f", "slots") * 100, ratio("_a", "slots") * 100
    return _kpi(g, ["market", "slots"], {
        "first_attempt_success": (first, _pass(first >= FIRST_ATTEMPT_PASS)),
        "retry_adjusted_success": (any_, _pass(any_ >= RETRY_PASS))})


def kpi_symbol_completeness(watchlists: DataFrame, calendar: DataFrame, lifecycle: DataFrame,
                            bars: DataFrame, *, reference) -> DataFrame:
    """Per market: share of symbols with 95 % of their expected days this month.

    The month is that of the market's latest date up to ``reference``; expected
    days lie in the symbol's active window. A market none of whose symbols has expected
    days has 0 symbols, no value and fails.
    """
    ref = F.lit(reference).cast("date")
    month = calendar.where(F.col("date") <= ref).groupBy("market").agg(F.max("date").alias("_last"))
    month = month.select("market", F.col("_last").alias("month_end"),
                         F.trunc("_last", "month").alias("month_start"))
    names = watchlists.select("market", "symbol").distinct().join(month, "market")
    window = active_window_in_month(names, lifecycle)
    window = window.where("active_start IS NOT NULL").join(
        names.select("market", "symbol", "month_start", "month_end"), ["market", "symbol"])
    days = (calendar.join(month, "market")
            .where((F.col("date") >= F.col("month_start"))
                   & (F.col("date") <= F.last_day("month_start")))
            .groupBy("market").agg(F.collect_list("date").alias("_days")))
    expected = window.join(days, "market").withColumn("_want", F.size(F.filter(
        "_days", lambda x: x.between(F.col("active_start"), F.col("active_end")))))
    have = bars.select("market", "symbol", "date").join(
        expected.select("market", "symbol", "active_start", "active_end"), ["market", "symbol"])
    have = have.where(F.col("date").between(F.col("active_start"), F.col("active_end"))).groupBy(
        "market", "symbol").agg(F.countDistinct("date").alias("_have"))
    j = expected.where("_want > 0").join(have, ["market", "symbol"], "left").select(
        "market", "symbol", ratio(F.coalesce("_have", F.lit(0)), F.col("_want")).alias("share"))
    pct = _percentiles(j, keys=["market"], value="share", quantiles={"p50": 0.5, "p05": 0.05})
    g = j.groupBy("market").agg(count_true(F.col("share") >= SYMBOL_PASS).alias("passing"))
    none = F.lit(0).cast("bigint")
    out = watchlists.select("market").distinct().join(g.join(pct, "market"), "market", "left").withColumn(
        "passing_ratio", ratio("passing", "n"))
    return out.select(
        "market", F.coalesce("n", none).alias("symbols"), F.coalesce("passing", none).alias("passing"), "p50", "p05",
        (F.col("passing_ratio") * 100).alias("value"),
        _pass(F.col("passing_ratio") >= SYMBOL_PASS).alias("status"))


def _percentiles(rows: DataFrame, *, keys: Sequence[str], value: str,
                 quantiles: Mapping[str, float]) -> DataFrame:
    """(keys, n, one column per quantile) of values that are few per key: one per symbol,
    replay or day, so an aggregation buffer can hold them."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile(value, p).alias(q) for q, p in quantiles.items()])


def completed_day_delta(rows: DataFrame, calendar: DataFrame, *, day: str, name: str) -> DataFrame:
    """Adds the number of market dates after ``day`` (NULL day gives NULL).

    The rows' distinct days, few however many rows share one, look up their calendar
    position; rows take it by an equi join. ``calendar`` has idx.
    """
    sizes = calendar.groupBy("market").agg(F.count(F.lit(1)).alias("_n"))
    cols = rows.columns
    days = rows.where(F.col(day).isNotNull()).select("market", day).distinct()
    found = asof_last(days, calendar.select("market", F.col("date").alias("_d"), F.col("idx").alias("_idx")),
                      keys=["market"], left_at=day, right_at="_d", values=["_idx"])
    return rows.join(found, ["market", day], "left").join(sizes, "market", "left").select(*cols, F.when(
        F.col(day).isNotNull(),
        F.coalesce("_n", F.lit(0)) - F.coalesce(F.col("_idx") + 1, F.lit(0))).alias(name))


def kpi_recovery_delta(drills: DataFrame, *, reference) -> DataFrame:
    """Greatest completed-day delta of the last 90 days; at most 1 passes."""
    recent = drills.where(F.to_date("created_at") >= F.date_sub(F.lit(reference).cast("date"),
                                                                KPI_CALENDAR_DAYS - 1))
    g = recent.groupBy("market").agg(
        F.max("completed_trading_day_delta").alias("_max"),
        F.count("completed_trading_day_delta").alias("samples"),
        count_true(F.col("completed_trading_day_delta") <= DELTA_PASS).alias("within"))
    return g.select("market", "samples", "within", F.col("_max").cast("double").alias("value"),
                    _pass(F.col("_max") <= DELTA_PASS).alias("status"))


def kpi_replay_latency(replays: DataFrame, drills: DataFrame, *, reference) -> DataFrame:
    """p95 hours of benchmarked replays and drills of the last 90 days."""
    floor = F.date_sub(F.lit(reference).cast("date"), KPI_CALENDAR_DAYS - 1)

    def hours(df: DataFrame) -> DataFrame:
        return df.where(F.col("benchmark_profile_id").isNotNull() & F.col("completed_at").isNotNull()
                        & (F.to_date("created_at") >= floor)).select(
            "market", hours_between("completed_at", "started_at").alias("hours"))

    p = _percentiles(hours(replays).unionByName(hours(drills)), keys=["market"],
                          value="hours", quantiles={"value": 0.95})
    return p.select("market", F.col("n").alias("samples"), "value",
                    _pass(F.col("value") < REPLAY_HOURS).alias("status"))


def kpi_event_recovery(events: DataFrame, *, reference) -> DataFrame:
    """(market, kpi, value, status): worst recovery hours and the sample size."""
    floor = F.date_sub(F.lit(reference).cast("date"), KPI_CALENDAR_DAYS - 1)
    rows = events.where((F.to_date("created_at") >= floor)
                        & F.col("timestamp_source_class").isin(*RECOVERABLE_CLASSES)
                        & F.col("publication_ts").isNotNull())
    h = F.greatest(F.lit(0.0), hours_between("created_at", "publication_ts"))
    g = rows.groupBy("market").agg(F.count(F.lit(1)).alias("_n"), F.max(h).alias("_worst"))
    few = F.col("_n") < EVENT_SAMPLE
    return _kpi(g, ["market"], {
        "event_recovery": (F.col("_worst"), F.when(few, "insufficient_sample").otherwise(
            _pass(F.col("_worst") <= EVENT_HOURS))),
        "event_sample": (F.col("_n"), F.when(few, "insufficient_sample").otherwise("pass"))})


def _monthly_slots(start: Column, end: Column, day: Column) -> Column:
    """Slot dates between two dates: the day of month, clamped to its length."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    slots = F.transform(months, lambda m: F.date_add(
        m, (F.least(day, F.dayofmonth(F.last_day(m))) - 1).cast("int")))
    return F.when(start <= end, F.filter(slots, lambda s: s.between(start, end)))


def kpi_schedule_coverage(schedules: DataFrame, drills: DataFrame, *, reference) -> DataFrame:
    """Covered share of the monthly slots due in the last 90 days.

    ``schedules``: (schedule_id, day_of_month, created_date); ``drills``:
    (schedule_id, scheduled_for_date). One total row.
    """
    ref = F.lit(reference).cast("date")
    start = F.greatest(F.date_sub(ref, KPI_CALENDAR_DAYS - 1), F.col("created_date"))
    due = schedules.select("schedule_id", F.explode(
        _monthly_slots(start, ref, F.col("day_of_month"))).alias("scheduled_for_date")).distinct()
    done = drills.select("schedule_id", "scheduled_for_date").distinct().withColumn("_c", F.lit(True))
    g = due.join(done, ["schedule_id", "scheduled_for_date"], "left").agg(
        F.count(F.lit(1)).alias("due"), F.count("_c").alias("covered"))
    return g.select("due", "covered", (ratio("covered", "due") * 100).alias("value"),
                    _pass((F.col("due") >= 1) & (F.col("due") == F.col("covered"))).alias("status"))


def ops_gate(kpis: DataFrame, required: Sequence[str], *, keys: Sequence[str] = ("market",)
             ) -> DataFrame:
    """(keys, overall_status): required KPIs pass, and event recovery passes or
    lacks a sample like its sample KPI."""
    def is_(name: str, status: str) -> Column:
        return F.max((F.col("kpi") == name) & (F.col("status") == status))

    ok = F.lit(True)
    for name in required:
        ok = ok & is_(name, "pass")
    event = is_("event_recovery", "pass") | (is_("event_recovery", "insufficient_sample")
                                             & is_("event_sample", "insufficient_sample"))
    return kpis.groupBy(*keys).agg(_pass(ok & event).alias("overall_status"))


def recovery_drill_result(slots: DataFrame, bars: DataFrame, failures: DataFrame,
                          calendar: DataFrame) -> DataFrame:
    """(drill_id, market, status, latest_replayable_day, delta, reason).

    ``slots``: (drill_id, market, raw_payload_id); ``bars`` and ``failures`` are
    what replaying the payloads gave.
    """
    days = bars.groupBy("raw_payload_id").agg(F.max("date").alias("latest_replayable_day"))
    why = failures.groupBy("raw_payload_id").agg(F.min("issue").alias("reason"))
    j = slots.join(days, "raw_payload_id", "left").join(why, "raw_payload_id", "left")
    j = j.withColumn("latest_replayable_day", F.when(F.col("reason").isNull(),
                                                     F.col("latest_replayable_day")))
    j = completed_day_delta(j, calendar, day="latest_replayable_day",
                            name="completed_trading_day_delta")
    return j.withColumn("status", F.when(F.col("reason").isNull(), "succeeded").otherwise("failed"))


def ingest_attempt_rollup(attempts: DataFrame, *, keys: Sequence[str] = ("watchlist_id", "date")
                          ) -> DataFrame:
    """Per slot: attempts, last status and error, first and last time, final."""
    n = F.col("attempt_number")
    g = attempts.groupBy(*keys).agg(
        F.max(n).alias("attempt_count"), F.max_by("status", n).alias("status"),
        F.max_by("error_message", n).alias("last_error_message"),
        F.min_by("started_at", n).alias("first_attempt_at"),
        F.max_by("completed_at", n).alias("last_attempt_at"))
    return g.withColumn("is_final", (F.col("status") == "succeeded")
                        | (F.col("attempt_count") >= MAX_ATTEMPTS))


def orphan_run_references(orders: DataFrame, runs: DataFrame) -> DataFrame:
    return orders.where("run_id IS NOT NULL").join(runs.select("run_id"), "run_id", "left_anti")


def due_schedule_slots(schedules: DataFrame, done: DataFrame, *, now) -> DataFrame:
    """(schedule_id, slot): slots due by each schedule's local date, less the
    succeeded ones. ``schedules``: (schedule_id, day_of_month, timezone, created_at)."""
    at = F.lit(now).cast("timestamp")
    today = F.to_date(F.from_utc_timestamp(at, F.col("timezone")))
    start = F.coalesce(F.to_date(F.from_utc_timestamp("created_at", F.col("timezone"))), today)
    slots = schedules.select("schedule_id", F.explode(
        _monthly_slots(start, today, F.col("day_of_month"))).alias("slot"))
    finished = done.where("status = 'succeeded'").select(
        "schedule_id", F.col("scheduled_for_date").alias("slot"))
    return slots.join(finished, ["schedule_id", "slot"], "left_anti")


def due_ingestions(watchlists: DataFrame, runs: DataFrame, *, now) -> DataFrame:
    """(watchlist_id, market, date): active watchlists without a success or the
    last allowed attempt on their market's local date."""
    at = F.lit(now).cast("timestamp")
    zone = F.lit("UTC")
    for market, name in ZONES.items():
        zone = F.when(F.col("market") == market, name).otherwise(zone)
    slots = watchlists.where("is_active").select(
        "watchlist_id", "market", F.to_date(F.from_utc_timestamp(at, zone)).alias("date"))
    closed = runs.where((F.col("status") == "succeeded") | (F.col("attempt_count") >= MAX_ATTEMPTS))
    return slots.join(closed.select("watchlist_id", "date"), ["watchlist_id", "date"], "left_anti")


def symbol_readiness(symbols: DataFrame, bars: DataFrame, fetches: DataFrame, calendar: DataFrame,
                     *, start, end) -> DataFrame:
    """Latest date, stale market days, covered against weekday days, status.

    ``symbols``: (market, symbol); ``fetches``: successful (market, symbol,
    fetch_ts).
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    wanted = F.size(F.filter(F.sequence(lo, hi), lambda x: F.weekday(x) < 5))
    per = bars.groupBy("market", "symbol", "date").agg(F.count(F.lit(1)).alias("_c")).groupBy(
        "market", "symbol").agg(F.max("date").alias("latest_date"),
                                count_true(F.col("date").between(lo, hi)).alias("_cov"))
    raw = fetches.groupBy("market", "symbol").agg(F.max("fetch_ts").alias("latest_fetch_ts"))
    j = symbols.join(per, ["market", "symbol"], "left").join(raw, ["market", "symbol"], "left")
    j = completed_day_delta(j, calendar, day="latest_date", name="_stale")
    stale = F.coalesce("_stale", F.lit(0)).cast("bigint")
    covered = F.coalesce("_cov", F.lit(0)).cast("bigint")
    j = (j.withColumn("stale_days", stale).withColumn("requested_days", wanted.cast("bigint"))
         .withColumn("covered_days", covered)
         .withColumn("missing_days", F.greatest(F.col("requested_days") - F.col("covered_days"),
                                                F.lit(0))))
    gone = F.col("latest_date").isNull()
    reasons = F.array_compact(F.array(
        F.when(gone, "no_rows"),
        F.when(F.col("requested_days") == 0, "no_days_requested")
        .when(F.col("covered_days") == 0, "range_not_covered")
        .when(F.col("missing_days") > 0, "range_incomplete"),
        F.when(F.col("stale_days") > 0, "stale")))
    status = (F.when(gone | ((F.col("requested_days") > 0) & (F.col("covered_days") == 0)), "missing")
              .when(F.size("reasons") > 0, "warning").otherwise("ready"))
    return j.withColumn("reasons", reasons).withColumn("status", status).drop("_stale", "_cov")


# ---- tick archives -----------------------------------------------------------

def tick_window_join(runs: DataFrame, objects: DataFrame, restores: DataFrame, *,
                     window: int = KPI_TRADING_DAYS, market: str = "TW",
                     status: str = "succeeded") -> tuple[DataFrame, DataFrame]:
    """(objects, restores) of the succeeded runs on the market's last dates.

    ``runs``: (run_id, market, trading_date, status, completed_at, created_at).
    """
    good = runs.where((F.col("market") == market) & (F.col("status") == status))
    dates = good.select("trading_date").distinct().orderBy(F.col("trading_date").desc()).limit(window)
    kept = good.join(dates, "trading_date", "left_semi").select(
        "run_id", "trading_date", F.col("completed_at").alias("run_completed_at"),
        F.col("created_at").alias("run_created_at"))
    objs = objects.join(kept, "run_id")
    rest = restores.where(F.col("benchmark_profile_id").isNotNull()
                          & (F.col("restore_status") == status)).join(
        objs.select(F.col("object_id").alias("archive_object_id"), "trading_date",
                    "compressed_bytes"), "archive_object_id")
    return objs, rest


def tick_latest_run_objects(objects: DataFrame) -> DataFrame:
    """Objects of each date's latest run; a NULL run id keeps the whole date."""
    key = F.struct(F.coalesce("run_completed_at", "run_created_at", "created_at",
                              F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("t"),
                   F.col("run_id"), F.coalesce("object_id", F.lit(0)).alias("o"))
    best = objects.groupBy("trading_date").agg(
        F.max(F.col("run_id").isNull()).alias("_all"), F.max_by("run_id", key).alias("_run"))
    j = objects.where("trading_date IS NOT NULL").join(best, "trading_date")
    return j.where(F.col("_all") | (F.col("run_id") == F.col("_run"))).drop("_all", "_run")


def tick_restore_windows(latest: DataFrame, restores: DataFrame, *,
                         max_bytes: float = BENCHMARK_BYTES) -> DataFrame:
    """Full-day restores per (date, profile): bytes, wall-clock seconds, GB/min."""
    totals = latest.groupBy("trading_date").agg(F.sum("compressed_bytes").alias("required")).where(
        (F.col("required") > 0) & (F.col("required") <= max_bytes))
    known = latest.select(F.col("object_id").alias("archive_object_id"))
    usable = (restores.join(known, "archive_object_id", "left_semi")
              .join(totals, "trading_date"))
    keys = ["trading_date", "benchmark_profile_id", "archive_object_id"]
    first = usable.groupBy(*keys).agg(
        F.max_by(F.struct("compressed_bytes", "restore_started_at", "restore_completed_at",
                          "required"), F.struct("created_at", "restore_id")).alias("r"))
    g = first.groupBy("trading_date", "benchmark_profile_id").agg(
        F.sum("r.compressed_bytes").alias("compressed_bytes"), F.max("r.required").alias("required"),
        F.count(F.lit(1)).alias("objects"),
        F.min("r.restore_started_at").alias("_s"), F.max("r.restore_completed_at").alias("_e"))
    g = g.where(F.col("compressed_bytes") + 1e-6 >= F.col("required"))
    secs = hours_between("_e", "_s") * 3600.0
    g = g.withColumn("elapsed_seconds", F.when(secs > 0, secs))
    gb = F.col("compressed_bytes") / float(1024 ** 3)
    return g.withColumn("gb_per_minute", F.when(
        F.col("compressed_bytes") > 0, ratio(gb, F.col("elapsed_seconds") / 60.0))).drop("_s", "_e")


def tick_kpis(objects: DataFrame, windows: DataFrame) -> DataFrame:
    """(kpi, value, status) of compression, p95 minutes and p50 GB per minute."""
    sizes = objects.agg(F.sum("compressed_bytes").alias("_c"), F.sum("uncompressed_bytes").alias("_u"))
    saved = F.when(F.col("_u") > 0, F.greatest(F.lit(0.0), 1 - F.col("_c") / F.col("_u")) * 100)
    compression = _kpi(sizes, [], {"compression": (saved, _pass(saved >= COMPRESSION_PASS))})

    values = windows.select(F.inline(F.array(
        F.struct(F.lit("restore_minutes_p95").alias("kpi"), (F.col("elapsed_seconds") / 60.0).alias("v")),
        F.struct(F.lit("throughput_p50").alias("kpi"), F.col("gb_per_minute").alias("v")))))
    pct = _percentiles(values, keys=["kpi"], value="v", quantiles={"p50": 0.5, "p95": 0.95})
    slow = F.col("kpi") == "restore_minutes_p95"
    value = F.when(slow, F.col("p95")).otherwise(F.col("p50"))
    return compression.unionByName(pct.select(
        "kpi", value.alias("value"),
        _pass(F.when(slow, F.col("p95") < RESTORE_MINUTES).otherwise(F.col("p50").isNotNull()))
        .alias("status")))


def tick_archive_gate(runs: DataFrame, objects: DataFrame, restores: DataFrame,
                      observations: DataFrame, *, retention: str, layout: str,
                      keys: Sequence[str] = ("market",)) -> DataFrame:
    """(keys, artifact, status): checks on the newest succeeded object per key.

    ``observations``: (archive_object_reference).
    """
    keys = list(keys)
    good = runs.where("status = 'succeeded'").select("run_id", *keys)
    rest = [c for c in objects.columns if c not in ("run_id", *keys)]
    latest = objects.join(good, "run_id").groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "object_id")).alias("o"))
    newest = restores.join(latest.select(F.col("o.object_id").alias("archive_object_id")),
                           "archive_object_id", "left_semi")
    newest = newest.groupBy("archive_object_id").agg(F.max_by(
        F.struct("restore_status", "elapsed_seconds", "gb_per_minute"),
        F.struct("created_at", "restore_id")).alias("r"))
    seen = observations.groupBy("archive_object_reference").agg(F.count(F.lit(1)).alias("n"))
    j = (latest.withColumn("archive_object_id", F.col("o.object_id"))
         .withColumn("archive_object_reference",
                     F.concat(F.lit("tick_archive_object:"), F.col("o.object_id")))
         .join(newest, "archive_object_id", "left")
         .join(seen, "archive_object_reference", "left"))
    restored = F.coalesce(F.col("r.restore_status") == "succeeded", F.lit(False))
    checks = {
        "raw_tick_archive": F.col("o.path_exists"),
        "normalized_replay_path": restored & (F.coalesce("n", F.lit(0)) > 0),
        "archive_metadata": F.col("archive_object_id").isNotNull(),
        "retention_policy": (F.col("o.retention_class") == retention)
        & (F.col("o.archive_layout_version") == layout),
        "restore_telemetry": restored & F.col("r.elapsed_seconds").isNotNull()
        & F.col("r.gb_per_minute").isNotNull()}
    return j.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("artifact"), _pass(c).alias("status")) for n, c in checks.items()])))


# ---- phase gates ---------------------------------------------------------------

def _latest_rows(rows: DataFrame, n: int, keys: Sequence[str], tie: str) -> DataFrame:
    """Newest ``n`` rows per key; the limit applies before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col(tie).desc())
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def _share(df: DataFrame, keys: Sequence[str], name: str, good: Column, *, enough: int = 1,
           want: str = "all") -> DataFrame:
    """(keys, metric, value, status) from a share; ``want`` is all or none."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), count_true(good).alias("_k"))
    ok = (F.col("_k") == F.col("_n")) if want == "all" else (F.col("_k") == 0)
    return g.select(*keys, F.lit(name).alias("metric"), ratio("_k", "_n").alias("value"),
                    F.when(F.col("_n") < enough, "insufficient_sample")
                    .otherwise(_pass(ok)).alias("status"))


def gate_run_completeness(runs: DataFrame, *, contract: str, keys: Sequence[str] = ("market",),
                          fields: Sequence[str] = GATE_FIELDS) -> DataFrame:
    """Share of the last 20 succeeded runs with every required field."""
    recent = _latest_rows(runs.where((F.col("status") == "succeeded") & (
        F.col("tradability_contract_version") == contract)), 20, keys, "run_id")
    full = F.lit(True)
    for f in fields:
        full = full & F.col(f).isNotNull()
    return _share(recent, keys, "required_fields", full, enough=20)


def gate_factor_lineage(entries: DataFrame, audits: DataFrame, *, keys: Sequence[str] = ("market",)
                        ) -> DataFrame:
    """(keys, metric, value, status): entry metadata, leakage, timing counts.

    ``entries``: scoring-eligible flag and metadata of the active catalog;
    ``audits``: (created_at, audit_id, sample_size, exact_count, fallback_count,
    undocumented_count).
    """
    keys = list(keys)
    full = F.lit(True)
    for c in ("formula_definition", "lineage", "timing_semantics", "missing_value_policy"):
        full = full & (F.coalesce(F.col(c), F.lit("")) != "")
    meta = _share(entries.where("scoring_eligible"), keys, "entry_metadata", full)
    last = _latest_rows(audits, 1, keys, "audit_id")
    leak = F.when(F.col("sample_size") > 0, ratio("undocumented_count", "sample_size"))
    counted = (F.col("exact_count") + F.col("fallback_count") + F.col("undocumented_count")
               == F.col("sample_size")) & (F.col("sample_size") > 0)
    return (meta.unionByName(last.select(
        *keys, F.lit("leakage").alias("metric"), leak.alias("value"),
        F.when(leak.isNull(), "insufficient_sample").otherwise(_pass(leak == 0)).alias("status")))
        .unionByName(last.select(
            *keys, F.lit("timing_mapping").alias("metric"), F.lit(None).cast("double").alias("value"),
            _pass(counted).alias("status"))))


def gate_peer_alignment(runs: DataFrame, *, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Aligned and reported shares of the last 50 peer-enabled runs; metrics are JSON."""
    recent = _latest_rows(runs.where(
        (F.col("status") == "succeeded") & F.col("cluster_snapshot_version").isNotNull()
        & F.col("peer_policy_version").isNotNull()), 50, keys, "run_id")

    def have(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    aligned = (have("price_basis_version") & have("threshold_policy_version")
               & have("comparison_eligibility"))

    def metric(name: str) -> Column:
        return F.get_json_object("metrics_json", f"$.{name}").isNotNull()

    concentrated = F.lit(False)
    for name in CONCENTRATION_METRICS:
        concentrated = concentrated | metric(name)
    return _share(recent, keys, "aligned", aligned).unionByName(
        _share(recent, keys, "reported", metric("turnover") & concentrated))


def order_history_completeness(orders: DataFrame, events: DataFrame, *, route: str,
                               keys: Sequence[str] = ("market",)) -> DataFrame:
    """Orders with submitted, acknowledged and filled or rejected; readback
    events that carry telemetry. Flags are map-side maxima, not event lists."""
    keys = list(keys)
    mine = orders.where(F.col("route") == route).select("order_id", *keys)

    def saw(kind: str) -> Column:
        return F.max(F.col("event_type") == kind)

    flags = events.groupBy("order_id").agg(
        (saw("submitted") & saw("acknowledged") & (saw("filled") | saw("rejected"))).alias("_ok"))
    j = mine.join(flags, "order_id", "left")
    history = _share(j, keys, "order_history", F.coalesce("_ok", F.lit(False)))
    back = events.where("event_type = 'position_readback'").join(mine, "order_id")
    told = ~F.coalesce(F.col("detail_json"), F.lit("")).isin("", "{}")
    return history.unionByName(_share(back, keys, "readback_telemetry", told))


def order_control_ratios(orders: DataFrame, events: DataFrame, checks: DataFrame, *, route: str,
                         keys: Sequence[str] = ("market",), window: int = 20) -> DataFrame:
    """Confirmed, risk-checked, unconfirmed and fully logged shares of the last orders."""
    keys = list(keys)
    last = _latest_rows(orders.where(F.col("route") == route), window, keys, "order_id")
    last = last.select("order_id", *keys, "status", "manual_confirmation")
    mine = last.select("order_id")

    def saw(kind: str) -> Column:
        return F.max(F.col("event_type") == kind)

    ledger = F.lit(True)
    for kind in LEDGER_EVENTS:
        ledger = ledger & saw(kind)
    logged = events.join(mine, "order_id", "left_semi").groupBy("order_id").agg(
        saw("rejected").alias("_rej"), ledger.alias("_led"))
    checked = checks.join(mine, "order_id", "left_semi").select("order_id").distinct().withColumn(
        "_chk", F.lit(True))
    j = last.join(logged, "order_id", "left").join(checked, "order_id", "left")
    full = F.coalesce(F.when(F.col("status") == "rejected", F.col("_rej")).otherwise(F.col("_led")),
                      F.lit(False))
    confirmed = F.coalesce("manual_confirmation", F.lit(False))
    return (_share(j, keys, "confirmed", confirmed)
            .unionByName(_share(j, keys, "risk_checked", F.col("_chk").isNotNull()))
            .unionByName(_share(j, keys, "unconfirmed", ~confirmed, want="none"))
            .unionByName(_share(j, keys, "logged", full)))


def adaptive_isolation(runs: DataFrame, exclusions: DataFrame, *, keys: Sequence[str] = ("market",)
                       ) -> DataFrame:
    """Opt-in, contamination and rollout shares of the last 50 adaptive runs."""
    recent = _latest_rows(runs.where(F.col("adaptive_mode").isNotNull()
                                     & (F.col("adaptive_mode") != "off")), 50, keys, "run_id")

    def have(*columns: str) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & (F.coalesce(F.col(c), F.lit("")) != "")
        return out

    j = recent.join(exclusions.select("run_id").distinct().withColumn("_x", F.lit(True)),
                    "run_id", "left")
    e = F.col("comparison_eligibility")
    dirty = F.col("_x").isNull() & (
        (e.isNotNull() & (e != "unresolved_event_quarantine"))
        | F.coalesce(F.col("tradability_state") == "execution_ready", F.lit(False)))
    return (_share(j, keys, "opt_in", have("adaptive_profile_id", "reward_definition_version",
                                           "state_definition_version", "rollout_control_version"))
            .unionByName(_share(j, keys, "contamination", dirty, want="none"))
            .unionByName(_share(j, keys, "rollout", have("rollout_control_version",
                                                         "adaptive_contract_version"))))


# ---- order tables ----------------------------------------------------------------

def control_asof(rows: DataFrame, switches: DataFrame, *, at: str = "created_at") -> DataFrame:
    """``rows`` with ``halted``: the latest switch event that applies is enabled.

    A row with a market sees global events and its market's, one without sees
    all. The OR is split into three lookups and the latest hit wins.
    ``switches``: (switch_id, scope_type, market, is_enabled, created_at).
    """
    s = switches.select("switch_id", "scope_type", F.col("market").alias("_m"), "is_enabled",
                        F.col("created_at").alias("_sat"))
    hit = F.struct(F.col("_sat").alias("t"), F.col("switch_id").alias("i"),
                   F.col("is_enabled").alias("on"))
    s = s.withColumn("_hit", hit)
    every = s.select(F.lit(0).alias("_k"), "_sat", "switch_id", "_hit")
    world = s.where("scope_type = 'global'").select(F.lit(0).alias("_k"), "_sat", "switch_id",
                                                    F.col("_hit").alias("_ghit"))
    local = s.where("scope_type = 'market'").select(F.col("_m").alias("market"), "_sat", "switch_id",
                                                    F.col("_hit").alias("_lhit"))
    r = rows.withColumn("_k", F.lit(0))
    day = {"slice_by": lambda c: F.date_trunc("hour", c)}
    r = asof_last(r, every, keys=["_k"], left_at=at, right_at="_sat", values=["_hit"],
                  right_tie=["switch_id"], **day)
    r = asof_last(r, world, keys=["_k"], left_at=at, right_at="_sat", values=["_ghit"],
                  right_tie=["switch_id"], **day)
    r = asof_last(r, local, keys=["market"], left_at=at, right_at="_sat", values=["_lhit"],
                  right_tie=["switch_id"], **day)
    best = F.when(F.col("market").isNull(), F.col("_hit")).otherwise(F.greatest("_ghit", "_lhit"))
    return r.withColumn("halted", F.coalesce(best["on"], F.lit(False))).select(
        *rows.columns, "halted")


def order_screening(orders: DataFrame, switches: DataFrame) -> DataFrame:
    """``orders`` with failure_code and status: switch, confirmation, then risk."""
    o = control_asof(orders, switches)
    risky = ~F.coalesce((F.col("quantity") > 0) & (F.col("requested_price") * F.col("quantity")
                                                   <= NOTIONAL_LIMIT), F.lit(False))
    code = (F.when(F.col("halted"), "kill_switch_active")
            .when(~F.coalesce("manual_confirmed", F.lit(False)), "manual_confirmation_missing")
            .when(risky, "risk_check_failed"))
    return o.withColumn("failure_code", code).withColumn("status", F.when(
        code.isNull(), "accepted_for_stub_dispatch").otherwise("rejected"))


def order_ledger(orders: DataFrame, **children: DataFrame) -> DataFrame:
    """Orders with each child table as an array ordered by its own columns.

    Children are keyed by order_id; an order's own children are few by nature.
    """
    out = orders
    for name, child in children.items():
        rest = [c for c in child.columns if c != "order_id"]
        packed = child.groupBy("order_id").agg(
            F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(packed, "order_id", "left")
    return out


def latest_signal_per_symbol(signals: DataFrame, *, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """(keys, symbol, position, score, quantity): the last row in list order."""
    g = signals.groupBy(*keys, "symbol").agg(
        F.max_by(F.struct("position", "score"), F.col("ordinal")).alias("s"))
    return g.select(*keys, "symbol", "s.position", "s.score",
                    (F.greatest("s.position", F.lit(0.0)) * 100.0).alias("quantity"))
