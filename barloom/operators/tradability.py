"""Liquidity, readiness and daily execution universe on a dense market panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import count_true, ratio_or_zero
from barloom.functions.panel import panel
from barloom.operators.universe import (event_clear, identity_asof, identity_intervals,
                                        lifecycle_marks)
from barloom.sources.shared import cut_lineage

# Screening policy.
HISTORY_DAYS = 120
RECENT_WINDOW = 20
RECENT_THRESHOLD = 0.95
CAPACITY_RATIO = 0.005
BUCKET_KEYS = ("lt_10m", "10m_to_50m", "50m_to_200m", "ge_200m")
BUCKET_LIMITS = (10_000_000.0, 50_000_000.0, 200_000_000.0)
ACTIVE_DAYS = 20
BASELINE_DAYS = 60
MIN_BASELINE_DAYS = 40
DRIFT_FLOOR = 0.01
RATIO_DRIFT_LIMIT = 0.10
BUCKET_SHARE_FLOOR = 0.05
STALE_DRIFT_LIMIT = 0.20
STALE_SHARE_LIMIT = 0.05
CORE = ("open", "high", "low", "close", "volume")


def readiness_panel(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(market, symbol, date, idx, history, completeness, adv20) on every market date.

    history counts complete rows so far; completeness is their share of the last
    20 market dates; adv20 the mean traded value over rows present in them.
    """
    cells = panel(bars.select("market", "symbol").distinct(), calendar)
    filled = cells.join(bars.select("market", "symbol", "date", *CORE),
                        ["market", "symbol", "date"], "left")
    whole = F.lit(True)
    for c in CORE:
        whole = whole & F.col(c).isNotNull()
    order = Window.partitionBy("market", "symbol").orderBy("idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    recent = order.rowsBetween(-(RECENT_WINDOW - 1), 0)
    done = filled.withColumn("_done", whole.cast("int"))
    traded = F.col("close") * F.col("volume")
    return done.select(
        "market", "symbol", "date", "idx",
        F.sum("_done").over(upto).alias("history"),
        (F.sum("_done").over(recent)
         / F.least(F.col("idx") + 1, F.lit(RECENT_WINDOW))).alias("completeness"),
        F.coalesce(F.avg(traded).over(recent), F.lit(0.0)).alias("adv20"))


def history_ready(frame: DataFrame) -> DataFrame:
    return frame.withColumn("history_ready", F.col("history") >= HISTORY_DAYS)


def recent_completeness(frame: DataFrame) -> DataFrame:
    return frame.withColumn("recent_complete", F.col("completeness") >= RECENT_THRESHOLD)


def liquidity_bucket(adv: str | Column, limits: Sequence[float] = BUCKET_LIMITS) -> Column:
    a = F.col(adv) if isinstance(adv, str) else adv
    out = F.when(a < limits[0], BUCKET_KEYS[0])
    for limit, key in zip(limits[1:], BUCKET_KEYS[1:]):
        out = out.when(a < limit, key)
    return out.otherwise(BUCKET_KEYS[-1])


def capacity_pass(adv: str | Column, aum: str | Column, top_n: str | Column) -> Column:
    """No AUM passes; else AUM / top_n must fit in 0.5 % of a positive ADV20."""
    a, m, n = (F.col(c) if isinstance(c, str) else c for c in (adv, aum, top_n))
    fits = (a > 0) & (m / n <= a * CAPACITY_RATIO)
    return F.when(m.isNull() | (n <= 0), F.lit(True)).otherwise(fits)


def tradable_cells(runs: DataFrame, bars: DataFrame, calendar: DataFrame, events: DataFrame,
                   lifecycle: DataFrame, *, limits: Sequence[float] = BUCKET_LIMITS) -> DataFrame:
    """Every screen per (run_id, symbol, date).

    ``runs``: (run_id, market, symbol, aum, top_n). Identity and event state are
    resolved once per (symbol, date) for all runs; bars are those of the
    resolved symbol. The identity intervals, the small outcome of a recursion
    that two branches read, are checkpointed, and so are the lifecycle's marks, which
    both look at several times.
    """
    lifecycle = cut_lineage(lifecycle_marks(lifecycle))
    names = runs.select("market", "symbol").distinct()
    asks = panel(names, calendar)
    known = identity_asof(asks, cut_lineage(identity_intervals(names, lifecycle)))
    known = event_clear(known, events, lifecycle)
    ready = readiness_panel(bars, calendar).select(
        "market", F.col("symbol").alias("resolved_symbol"), "date", "history", "completeness",
        "adv20")
    zero = F.lit(0.0)
    cells = known.join(ready, ["market", "resolved_symbol", "date"], "left").select(
        "market", "symbol", "date", "resolved_symbol", "lifecycle_active", "clear",
        (F.coalesce("history", F.lit(0)) >= HISTORY_DAYS).alias("history_ready"),
        (F.coalesce("completeness", zero) >= RECENT_THRESHOLD).alias("recent_complete"),
        F.coalesce("adv20", zero).alias("adv20"))
    out = cells.join(runs, ["market", "symbol"]).withColumn(
        "bucket", liquidity_bucket("adv20", limits)).withColumn(
        "capacity_pass", capacity_pass("adv20", "aum", "top_n"))
    return out.withColumn("eligible", F.col("lifecycle_active") & F.col("history_ready")
                          & F.col("recent_complete") & F.col("clear") & F.col("capacity_pass"))


def execution_universe_daily(cells: DataFrame) -> DataFrame:
    """(run_id, market, date, full, execution, ratio, missing_core_gap, clear,
    buckets): one row per run and date; all four buckets are always present."""
    counts = []
    for key in BUCKET_KEYS:
        hit = F.col("bucket") == key
        counts += [count_true(hit).alias(f"_f_{key}"),
                   count_true(hit & F.col("eligible")).alias(f"_e_{key}")]
    g = cells.groupBy("run_id", "market", "date").agg(
        F.count(F.lit(1)).alias("full_universe_count"),
        count_true(F.col("eligible")).alias("execution_universe_count"),
        F.max(~F.col("history_ready") | ~F.col("recent_complete")).alias("has_missing_core_gap"),
        F.min(F.col("clear")).alias("corporate_event_clear"), *counts)
    buckets = F.array(*[F.struct(
        F.lit(k).alias("bucket_key"), F.col(f"_f_{k}").alias("full_count"),
        F.col(f"_e_{k}").alias("execution_count"),
        ratio_or_zero(F.col(f"_f_{k}"), F.col("full_universe_count")).alias("full_ratio"),
        ratio_or_zero(F.col(f"_e_{k}"), F.col(f"_f_{k}")).alias("coverage_ratio"))
        for k in BUCKET_KEYS])
    return g.select(
        "run_id", "market", "date", "full_universe_count", "execution_universe_count",
        ratio_or_zero("execution_universe_count", "full_universe_count")
        .alias("execution_universe_ratio"),
        "has_missing_core_gap", "corporate_event_clear", buckets.alias("bucket_coverages"))


def stale_dates(weights: DataFrame, volumes: DataFrame) -> DataFrame:
    """(run_id, date, stale): any held symbol without a positive volume."""
    held = weights.join(volumes.select("symbol", "date", "volume"), ["symbol", "date"], "left")
    bad = (F.col("weight") > 0) & ~F.coalesce(F.col("volume") > 0, F.lit(False))
    return held.groupBy("run_id", "date").agg(F.max(F.coalesce(bad, F.lit(False))).alias("stale"))


def stale_mark_days(weights: DataFrame, volumes: DataFrame) -> DataFrame:
    """(run_id, stale_days, stale_share)."""
    return stale_dates(weights, volumes).groupBy("run_id").agg(
        count_true(F.col("stale")).alias("stale_days"),
        F.avg(F.col("stale").cast("double")).alias("stale_share"))


def tradability_state(daily: DataFrame, stale: DataFrame, routes: DataFrame) -> DataFrame:
    """(run_id, tradability_state, missing_feature_policy_state,
    corporate_event_state), judged on the latest date of each run.

    ``routes``: (run_id, execution_route).
    """
    last = daily.groupBy("run_id").agg(F.max_by(F.struct(
        "corporate_event_clear", "execution_universe_count", "has_missing_core_gap"),
        F.col("date")).alias("l"))
    j = last.join(stale, "run_id", "left").join(routes, "run_id", "left")
    ready = (F.col("l.execution_universe_count") > 0) & (
        F.coalesce("execution_route", F.lit("research_only")) != "research_only")
    return j.select(
        "run_id",
        F.when(~F.col("l.corporate_event_clear"), "unresolved_corporate_event")
        .when(F.col("stale_days") > 0, "stale_risk").when(ready, "execution_ready")
        .otherwise("research_only").alias("tradability_state"),
        F.when(F.col("l.has_missing_core_gap"), "core_data_gaps_filtered")
        .otherwise("native_missing_supported").alias("missing_feature_policy_state"),
        F.when(F.col("l.corporate_event_clear"), "clear")
        .otherwise("unresolved_corporate_event").alias("corporate_event_state"))


def microstructure_observations(daily: DataFrame, stale: DataFrame, *, profile: str) -> DataFrame:
    """Daily monitoring rows of a profile, one per (run, market, date)."""
    return daily.join(stale, ["run_id", "date"], "left").select(
        F.lit(profile).alias("monitor_profile_id"), "run_id", "market",
        F.col("date").alias("trading_date"), "full_universe_count", "execution_universe_count",
        "execution_universe_ratio",
        F.coalesce("stale", F.lit(False)).alias("stale_mark_with_open_positions"),
        "bucket_coverages")


def _drift(active: Column, baseline: Column) -> Column:
    return F.abs(active - baseline) / F.greatest(baseline, F.lit(DRIFT_FLOOR))


def micro_kpi_drift(observations: DataFrame, *, keys: Sequence[str] = ("market",)) -> DataFrame:
    """(keys, metric, value, drift, status): last 20 against the 60 before.

    Only the last 80 observations per key pass the row-number limit, which Spark
    applies before the shuffle.
    """
    keys = list(keys)
    latest = Window.partitionBy(*keys).orderBy(F.col("trading_date").desc())
    obs = (observations.withColumn("_rk", F.row_number().over(latest))
           .where(F.col("_rk") <= ACTIVE_DAYS + BASELINE_DAYS)
           .withColumn("_on", F.col("_rk") <= ACTIVE_DAYS))
    on, off = F.col("_on"), ~F.col("_on")
    stale = F.col("stale_mark_with_open_positions").cast("double")

    def mean(c: Column, side: Column) -> Column:
        return F.avg(F.when(side, c))

    totals = obs.groupBy(*keys).agg(
        count_true(on).alias("_na"), count_true(off).alias("_nb"),
        mean(F.col("execution_universe_ratio"), on).alias("_ra"),
        mean(F.col("execution_universe_ratio"), off).alias("_rb"),
        mean(stale, on).alias("_sa"), mean(stale, off).alias("_sb"))
    per_bucket = obs.select(*keys, "_on", F.inline("bucket_coverages")).groupBy(
        *keys, "bucket_key").agg(
        mean(F.col("full_ratio"), off).alias("_share"),
        mean(F.col("coverage_ratio"), on).alias("_ca"),
        mean(F.col("coverage_ratio"), off).alias("_cb"))
    needed = per_bucket.where(F.col("_share") >= BUCKET_SHARE_FLOOR)
    worst = needed.groupBy(*keys).agg(F.max(_drift(
        F.coalesce("_ca", F.lit(0.0)), F.col("_cb"))).alias("_worst"))
    j = totals.join(worst, keys, "left")
    enough = (F.col("_na") >= ACTIVE_DAYS) & (F.col("_nb") >= MIN_BASELINE_DAYS)
    rd, sd = _drift(F.col("_ra"), F.col("_rb")), _drift(F.col("_sa"), F.col("_sb"))

    def metric(name: str, value: Column, drift: Column, status: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.when(enough, value).alias("value"),
                        F.when(enough, drift).alias("drift"),
                        F.when(enough, status).otherwise("insufficient_sample").alias("status"))

    rows = F.array(
        metric("execution_ratio", F.col("_ra"), rd,
               F.when(rd <= RATIO_DRIFT_LIMIT, "pass").otherwise("fail")),
        metric("bucket_coverage", F.coalesce("_worst", F.lit(0.0)),
               F.coalesce("_worst", F.lit(0.0)),
               F.when(F.col("_worst").isNull(), "insufficient_sample")
               .when(F.col("_worst") <= RATIO_DRIFT_LIMIT, "pass").otherwise("fail")),
        metric("stale_share", F.col("_sa"), sd,
               F.when((F.col("_sa") <= STALE_SHARE_LIMIT) & (sd <= STALE_DRIFT_LIMIT), "pass")
               .otherwise("fail")))
    return j.select(*keys, F.inline(rows))
