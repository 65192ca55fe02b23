"""External signals, company factors and peer overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import count_true, hours_between, local_instant

# Factor ids and the market's clock times.
LISTING_AGE = "company_listing_age_days_v1"
EVENT_COUNT = "important_event_count_30d_v1"
TRANSITION_COUNT = "lifecycle_transition_count_365d_v1"
FACTORS = (LISTING_AGE, EVENT_COUNT, TRANSITION_COUNT)
OPEN_TIME = "09:00"
CLOSE_TIME = "13:30"
EVENT_DAYS = 30
TRANSITION_DAYS = 365


def external_signal_union(profiles: DataFrame, lifecycle: DataFrame, events: DataFrame, *,
                          start, end, market: str = "TW") -> DataFrame:
    """One signal table of the three sources whose effective date is in range.

    Events are available at their publication, the others at the market open of
    their date.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")

    def part(df: DataFrame, kind: str, day: str, at: Column, mode: Column) -> DataFrame:
        return df.where((F.col("market") == market) & F.col(day).between(lo, hi)).select(
            F.lit(kind).alias("source_record_type"), "symbol", "market",
            F.col(day).alias("effective_date"), at.alias("available_at"),
            mode.alias("availability_mode"))

    def opening(day: str) -> Column:
        return local_instant(day, OPEN_TIME)

    fallback = F.lit("fallback")
    exact = F.when(F.col("publication_ts").isNotNull(), "exact").otherwise("unresolved")
    return (part(profiles, "company_profile", "listing_date", opening("listing_date"), fallback)
            .unionByName(part(lifecycle, "lifecycle_record", "effective_date",
                              opening("effective_date"), fallback))
            .unionByName(part(events, "important_event", "effective_date",
                              F.col("publication_ts"), exact)))


def _value(cells: DataFrame, factor: str, value: Column, at: Column, mode: Column) -> DataFrame:
    return cells.select("symbol", "date", F.lit(factor).alias("factor_id"),
                        value.cast("double").alias("value"), at.alias("source_available_at"),
                        mode.alias("availability_mode"))


def factor_listing_age(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """Days since listing, NULL when the listing date is unknown."""
    j = cells.select("symbol", "date").join(
        profiles.select("symbol", "listing_date"), "symbol", "left")
    known = F.col("listing_date").isNotNull()
    return _value(j, LISTING_AGE, F.datediff("date", "listing_date"),
                  F.when(known, local_instant("listing_date", OPEN_TIME)),
                  F.when(known, "fallback").otherwise("unresolved"))


def trailing_counts(cells: DataFrame, marks: DataFrame, *, days: int) -> DataFrame:
    """(symbol, date, n, last): marks in [date - days, date] and the latest one.

    ``marks`` is (symbol, day, ts). Marks are summed per day before the shuffle,
    then a RANGE window over the union of days and cells counts them: no range
    join, and a partition is bounded by the calendar.
    """
    daily = marks.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("_n"),
                                               F.max("ts").alias("_ts"))
    both = (cells.select("symbol", F.col("date").alias("day"), F.lit(True).alias("_cell"))
            .unionByName(daily, allowMissingColumns=True))
    both = both.withColumn("_d", F.unix_date("day"))
    span = Window.partitionBy("symbol").orderBy("_d").rangeBetween(-days, 0)
    counted = both.select("symbol", F.col("day").alias("date"), "_cell",
                          F.coalesce(F.sum("_n").over(span), F.lit(0)).alias("n"),
                          F.max("_ts").over(span).alias("last"))
    return counted.where("_cell").drop("_cell")


def factor_event_count_30d(cells: DataFrame, events: DataFrame) -> DataFrame:
    marks = events.where("publication_ts IS NOT NULL").select(
        "symbol", F.to_date("publication_ts").alias("day"), F.col("publication_ts").alias("ts"))
    c = trailing_counts(cells, marks, days=EVENT_DAYS)
    return _value(c, EVENT_COUNT, F.col("n"), F.col("last"),
                  F.when(F.col("last").isNotNull(), "exact").otherwise("fallback"))


def factor_transition_count_365d(cells: DataFrame, lifecycle: DataFrame) -> DataFrame:
    marks = lifecycle.select("symbol", F.col("effective_date").alias("day"),
                             F.col("effective_date").alias("ts"))
    c = trailing_counts(cells, marks, days=TRANSITION_DAYS)
    at = local_instant(F.coalesce("last", F.col("date")), OPEN_TIME)
    return _value(c, TRANSITION_COUNT, F.col("n"), at, F.lit("fallback"))


def factor_panel(cells: DataFrame, profiles: DataFrame, events: DataFrame,
                 lifecycle: DataFrame, *, factors: Sequence[str] = FACTORS) -> DataFrame:
    """Long (symbol, date, factor_id, value, ..., factor_available_ts)."""
    unknown = set(factors) - set(FACTORS)
    if unknown:
        raise ValueError(f"unsupported factors {sorted(unknown)}")
    build = {LISTING_AGE: lambda: factor_listing_age(cells, profiles),
             EVENT_COUNT: lambda: factor_event_count_30d(cells, events),
             TRANSITION_COUNT: lambda: factor_transition_count_365d(cells, lifecycle)}
    out = None
    for f in factors:
        out = build[f]() if out is None else out.unionByName(build[f]())
    return out.withColumn("factor_available_ts", local_instant("date", CLOSE_TIME))


def factor_wide(panel: DataFrame, factors: Sequence[str] = FACTORS) -> DataFrame:
    """(symbol, date, one column per factor)."""
    return panel.groupBy("symbol", "date").pivot("factor_id", list(factors)).agg(F.max("value"))


def factor_catalog_check(entries: DataFrame, requested: DataFrame) -> DataFrame:
    """(catalog_id, factor_id, issue) of bad entries and undeclared requests.

    ``entries``: (catalog_id, factor_id, scoring_eligible, lineage,
    timing_semantics, missing_value_policy); ``requested``: (catalog_id, factor_id).
    """
    blank = F.lit(False)
    for c in ("lineage", "timing_semantics", "missing_value_policy"):
        blank = blank | (F.coalesce(F.col(c), F.lit("")) == "")
    issue = F.when(F.col("scoring_eligible") & ~F.col("factor_id").isin(*FACTORS),
                   "unsupported scoring factor").when(
        F.col("scoring_eligible") & blank, "incomplete scoring entry")
    bad = entries.select("catalog_id", "factor_id", issue.alias("issue")).where("issue IS NOT NULL")
    absent = requested.join(entries.select("catalog_id", "factor_id"),
                            ["catalog_id", "factor_id"], "left_anti")
    return bad.unionByName(absent.select(
        "catalog_id", "factor_id", F.lit("undeclared factor").alias("issue")).distinct())


def factor_usability(panel: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, factor_id, coverage_ratio, latency_hours, status)."""
    have = F.col("value").isNotNull()
    latency = F.when(have & F.col("source_available_at").isNotNull(),
                     hours_between("factor_available_ts", "source_available_at"))
    return panel.groupBy(*keys, "date", "factor_id").agg(
        F.avg(have.cast("double")).alias("coverage_ratio"),
        F.max(latency).alias("latency_hours"),
        F.when(F.max(have), "usable").otherwise("insufficient_sample").alias("status"))


def cluster_frame(bars: DataFrame, active: DataFrame, events: DataFrame) -> DataFrame:
    """(market, date, symbol, close, volume, event_count_30d) of active symbols.

    ``active``: (market, symbol, date, active). Events count once effective and while
    their publication is at most 30 days old. Dates with fewer than two symbols
    give no rows.
    """
    cells = bars.join(active.where("active").select("market", "symbol", "date"), ["market", "symbol", "date"])
    # An event counts on dates in [effective, publication + 30].
    spans = events.where("effective_date IS NOT NULL").select(
        "market", "symbol", F.col("effective_date").alias("_from"),
        F.date_add(F.to_date("publication_ts"), EVENT_DAYS + 1).alias("_to")).where("_to > _from")
    steps = spans.select("market", "symbol", F.explode(F.array(
        F.struct(F.col("_from").alias("date"), F.lit(1).alias("step")),
        F.struct(F.col("_to").alias("date"), F.lit(-1).alias("step")))).alias("s")
    ).groupBy("market", "symbol", F.col("s.date").alias("date")).agg(F.sum("s.step").alias("_step"))
    both = cells.select("market", "symbol", "date", F.struct(*bars.columns).alias("_b")).unionByName(
        steps, allowMissingColumns=True)
    upto = Window.partitionBy("market", "symbol").orderBy("date").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("_n", F.coalesce(F.sum("_step").over(upto), F.lit(0)))
    rows = counted.where(F.col("_b").isNotNull()).select(
        "_b.*", F.col("_n").cast("double").alias("event_count_30d"))
    many = rows.groupBy("market", "date").agg(F.count(F.lit(1)).alias("_k")).where("_k >= 2")
    return rows.join(many.drop("_k"), ["market", "date"], "left_semi").select(
        "market", "date", "symbol", F.col("close").cast("double").alias("close"),
        F.col("volume").cast("double").alias("volume"), "event_count_30d")


def peer_overlay(memberships: DataFrame, *, limit: int, keys: Sequence[str] = ("snapshot_id",)
                 ) -> DataFrame:
    """(keys, cluster, symbol, peer_count, peers, warning): nearest other members.

    A symbol's peers are the first ``limit`` members by distance other than
    itself, so they lie within the first limit + 1. Only those few rows per
    cluster are gathered; no pairs are formed.
    """
    group = [*keys, "cluster"]
    near = Window.partitionBy(*group).orderBy("_d", "symbol")
    ranked = memberships.withColumn("_d", F.coalesce("distance", F.lit(0.0)))
    heads = (ranked.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= limit + 1)
             .groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_r", "symbol"))).alias("_h")))
    j = memberships.join(heads, group)
    others = F.slice(F.filter(F.transform("_h", lambda h: h["symbol"]),
                              lambda s: s != F.col("symbol")), 1, limit)
    return j.select(*group, "symbol", others.alias("peers")).select(
        *group, "symbol", F.size("peers").cast("bigint").alias("peer_count"), "peers",
        (F.size("peers") == 0).alias("warning"))


def peer_feature_timeline(overlays: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(symbol, date, peer_symbol_count, peer_feature_value); on one date the
    later snapshot id wins. ``snapshots``: (snapshot_id, date)."""
    j = overlays.join(snapshots.select("snapshot_id", "date"), "snapshot_id")
    n = F.col("peer_count").cast("double")
    return j.groupBy("symbol", "date").agg(
        F.max_by(n, F.col("snapshot_id")).alias("peer_symbol_count"),
        F.max_by(n, F.col("snapshot_id")).alias("peer_feature_value"))


def audit_summary(sample: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    return sample.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        count_true(F.col("reason") == "fallback_first").alias("fallback_sample_size"),
        count_true(F.col("availability_mode") == "unresolved").alias("undocumented_count"))
