"""Validation, deduplication and merges.

"Keep the last row per key" is an aggregate (max_by over a struct) rather than a
row-number window: copies of a hot key are reduced in each map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import count_true

# Columns and policy.
PRICES = ("open", "high", "low", "close")
PROFILE_FIELDS = ("market", "exchange", "board", "company_name", "isin_code",
                  "industry_category", "listing_date", "trading_status", "source_name",
                  "raw_payload_id", "archive_object_reference", "notes")
COMPLETENESS_FIELDS = ("company_name", "isin_code", "industry_category", "listing_date",
                       "trading_status", "notes")
GAP_DAYS = 7
SEGMENT_DAYS = 7
COVERAGE_FLOOR = 0.95
MAX_ATTEMPTS = 3


def keep_latest(rows: DataFrame, *, keys: Sequence[str], order: Sequence[str | Column],
                copies: str | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key (nulls least), and optionally its copies.

    The order is a struct even for one column: max_by passes over null orders, and a
    key that has no other would lose its values.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    key = F.struct(*order)
    counted = [F.count(F.lit(1)).alias(copies)] if copies else []
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), key).alias("_r"), *counted)
    return kept.select(*keys, *[F.col("_r")[c].alias(c) for c in rest],
                       *([copies] if copies else []))


def _validated(rows: DataFrame, keys: Sequence[str], required: Sequence[str], order
               ) -> DataFrame:
    last = keep_latest(rows, keys=keys, order=order, copies="_copies")
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    for c in PRICES:
        missing = missing | F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False))
    bad = F.col("volume") < 0
    for c in PRICES:
        bad = bad | (F.col(c) <= 0)
    return last.withColumn("_state", F.when(missing, "null").when(bad, "invalid").otherwise("ok"))


def _report(staged: DataFrame, group: Sequence[str]) -> DataFrame:
    return staged.groupBy(*group).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates_removed"),
        count_true(F.col("_state") == "null").alias("null_rows_removed"),
        count_true(F.col("_state") == "invalid").alias("invalid_rows_removed"),
        count_true(F.col("_state") == "ok").alias("output_rows"))


def validate_daily_bars(rows: DataFrame, *, order: Sequence[str], report_by: Sequence[str] = ()
                        ) -> tuple[DataFrame, DataFrame]:
    """(clean bars, report): last per (date, symbol), then nulls, then bad values.

    A missing required column gives no rows. ``order`` is the arrival order.
    """
    required = ("date", "symbol", *PRICES, "volume")
    if any(c not in rows.columns for c in required):
        return rows.limit(0), rows.groupBy(*report_by).agg(
            F.count(F.lit(1)).alias("input_rows"),
            *[F.lit(0).cast("bigint").alias(c) for c in (
                "duplicates_removed", "null_rows_removed", "invalid_rows_removed",
                "output_rows")])
    staged = _validated(rows, ["date", "symbol"], required, order)
    return (staged.where("_state = 'ok'").drop("_state", "_copies"),
            _report(staged, report_by))


def validate_minute_bars(rows: DataFrame, *, order: Sequence[str], report_by: Sequence[str] = ()
                         ) -> tuple[DataFrame, DataFrame]:
    """The same per (market, symbol, bar_ts); an unreadable time drops the row."""
    required = ("trading_date", "bar_ts", "symbol", "market", *PRICES, "volume")
    staged = _validated(rows, ["market", "symbol", "bar_ts"], required, order)
    return (staged.where("_state = 'ok'").drop("_state", "_copies"),
            _report(staged, report_by))


def bar_gap_warnings(bars: DataFrame, *, keys: Sequence[str] = ("market",)) -> DataFrame:
    """(keys, gap_warnings): steps of more than 7 days between present dates.

    Keyed by market this runs over all symbols' dates together; add ``symbol``
    for the per-symbol count.
    """
    dates = bars.select(*keys, "date").distinct()
    prev = F.lag("date").over(Window.partitionBy(*keys).orderBy("date"))
    steps = dates.withColumn("_gap", F.datediff("date", prev))
    return steps.groupBy(*keys).agg(count_true(F.col("_gap") > GAP_DAYS).alias("gap_warnings"))


def upsert_daily_by_source_rank(stored: DataFrame, incoming: DataFrame,
                                official: Sequence[str]) -> DataFrame:
    """One row per (date, symbol): official beats non-official, then incoming wins."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rank = F.coalesce(F.col("source").isin(*official), F.lit(False)).cast("int")
    return keep_latest(both, keys=["date", "symbol"], order=[rank, F.col("_new")]).drop("_new")


def count_official_overrides(stored: DataFrame, incoming: DataFrame, official: Sequence[str]
                             ) -> DataFrame:
    """(official_overrides): incoming official rows over stored non-official ones."""
    def is_official(c: Column) -> Column:
        return F.coalesce(c.isin(*official), F.lit(False))

    s = stored.select("date", "symbol", F.col("source").alias("_stored"))
    j = incoming.where(is_official(F.col("source"))).join(s, ["date", "symbol"])
    return j.agg(count_true(~is_official(F.col("_stored"))).alias("official_overrides"))


def upsert_minute_bars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last write wins per (market, symbol, bar_ts)."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return keep_latest(both, keys=["market", "symbol", "bar_ts"], order=["_new"]).drop("_new")


def upsert_by_key(stored: DataFrame, incoming: DataFrame, *, keys: Sequence[str],
                  order: Sequence[str] = ()) -> DataFrame:
    """Idempotent merge by natural key; incoming wins, its last row by ``order``."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, keys=keys, order=["_new", *order]).drop("_new")


def upsert_lifecycle(stored, incoming, *, order=()):
    return upsert_by_key(stored, incoming, order=order,
                         keys=["symbol", "market", "event_type", "effective_date"])


def upsert_events(stored, incoming, *, order=()):
    return upsert_by_key(stored, incoming, order=order,
                         keys=["symbol", "market", "event_type", "publication_ts"])


def batch_ingest_summary(states: DataFrame, bars: DataFrame, universe: DataFrame) -> DataFrame:
    """(trading_date, status, filtered_rows, missing_symbol_count, error_count).

    ``states``: (trading_date, exchange, state) with ok, no_data or error;
    ``bars``: validated rows with exchange; ``universe``: (exchange, symbol).
    """
    sizes = universe.groupBy("exchange").agg(F.count(F.lit(1)).alias("_size"))
    inside = bars.join(universe, ["exchange", "symbol"], "left_semi")
    got = inside.groupBy(F.col("date").alias("trading_date"), "exchange", "symbol").agg(
        F.count(F.lit(1)).alias("_r")).groupBy("trading_date", "exchange").agg(
        F.sum("_r").alias("_rows"), F.count(F.lit(1)).alias("_symbols"))
    j = (states.join(sizes, "exchange", "left")
         .join(got, ["trading_date", "exchange"], "left"))
    ok = F.col("state") == "ok"
    size = F.coalesce("_size", F.lit(0))
    g = j.groupBy("trading_date").agg(
        count_true(ok).alias("_ok"), count_true(F.col("state") == "no_data").alias("_none"),
        count_true(F.col("state") == "error").alias("_err"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(ok, F.coalesce("_rows", F.lit(0))).otherwise(0)).alias("filtered_rows"),
        F.sum(F.when(ok, size - F.coalesce("_symbols", F.lit(0))).otherwise(size)).alias("_miss"))
    closed = F.col("_none") == F.col("_n")
    errors = F.when(closed, F.lit(0)).otherwise(F.col("_none") + F.col("_err"))
    return g.select(
        "trading_date",
        F.when(errors > 0, F.when(F.col("_ok") > 0, "partial").otherwise("failed"))
        .when(closed, "skipped_non_trading_day").otherwise("succeeded").alias("status"),
        F.col("filtered_rows").cast("bigint").alias("filtered_rows"),
        F.when(closed, F.lit(0)).otherwise(F.col("_miss")).cast("bigint")
        .alias("missing_symbol_count"), errors.cast("bigint").alias("error_count"))


def backfill_range_summary(ranges: DataFrame, batches: DataFrame) -> DataFrame:
    """Per range (range_id, start_date, end_date): weekday outcomes.

    A weekday without a batch row, or with errors, is failed.
    """
    days = ranges.select("range_id", F.explode(F.sequence("start_date", "end_date"))
                         .alias("trading_date")).where(F.weekday("trading_date") < 5)
    j = days.join(batches.select("trading_date", "status", "error_count"), "trading_date", "left")
    clean = F.coalesce(F.col("error_count") == 0, F.lit(False))
    good = clean & (F.col("status") == "succeeded")
    skipped = clean & (F.col("status") == "skipped_non_trading_day")
    return j.groupBy("range_id").agg(
        F.count(F.lit(1)).alias("attempted"), count_true(good).alias("succeeded"),
        count_true(skipped).alias("skipped"),
        count_true(~(good | skipped)).alias("failed"))


def dedupe_company_profiles(profiles: DataFrame, *, arrival: str, slice_rows: int = 100_000
                            ) -> tuple[DataFrame, DataFrame]:
    """(kept profiles, report): most complete per (exchange, symbol).

    Ties go to the greater canonical JSON, characters beyond ASCII escaped. Conflicts and overwrites compare each
    copy with the best one that arrived before it: a running maximum per slice
    of arrivals, plus the maximum of earlier slices.
    """
    keys = ["exchange", "symbol"]
    payload = [c for c in profiles.columns if c != arrival]
    score = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
                 for c in COMPLETENESS_FIELDS), F.lit(0))
    ranked = profiles.withColumn("_k", F.struct(
        score.alias("score"), F.to_json(F.struct(*sorted(payload)), {
            "ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}).alias("json")))
    kept = keep_latest(ranked, keys=keys, order=["_k"]).drop("_k", arrival)
    s = ranked.select(*keys, arrival, "_k", F.floor(F.col(arrival) / slice_rows).alias("_s"))
    best = s.groupBy(*keys, "_s").agg(F.max("_k").alias("_m"))
    carry = best.select(*keys, "_s", F.max("_m").over(
        Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_c"))
    local = s.withColumn("_l", F.max("_k").over(
        Window.partitionBy(*keys, "_s").orderBy(arrival)
        .rowsBetween(Window.unboundedPreceding, -1)))
    before = F.greatest("_l", "_c")
    judged = local.join(carry, [*keys, "_s"]).select(
        before.isNotNull().alias("_dup"), (F.col("_k") != before).alias("_conf"),
        (F.col("_k") > before).alias("_over"))
    report = judged.agg(count_true(F.col("_dup")).alias("duplicate_symbol_count"),
                        count_true(F.col("_conf")).alias("conflict_count"),
                        count_true(F.col("_over")).alias("overwritten_count"))
    return kept, report


def upsert_company_profiles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merged profiles with write_action: created, updated, noop, or kept."""
    fields = [f for f in PROFILE_FIELDS if f in incoming.columns and f not in ("exchange", "symbol")]
    keys = ["symbol", "exchange"]
    j = stored.select(*keys, F.lit(True).alias("_s"), F.struct(*fields).alias("_old")).join(
        incoming.select(*keys, F.lit(True).alias("_i"), F.struct(*fields).alias("_new")),
        keys, "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & F.col("_old")[f].eqNullSafe(F.col("_new")[f])
    action = (F.when(F.col("_i").isNull(), "kept").when(F.col("_s").isNull(), "created")
              .when(same, "noop").otherwise("updated"))
    row = F.when(F.col("_i").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return j.select(*keys, *[row[f].alias(f) for f in fields], action.alias("write_action"))


def reconcile_inactive_profiles(stored: DataFrame, feed: DataFrame, feeds: DataFrame
                                ) -> tuple[DataFrame, DataFrame]:
    """(profiles with the absent ones inactive, per-exchange decision).

    ``feed``: (exchange, symbol) active in the feed; ``feeds``: (exchange,
    records, errors). An empty feed, any error, or a feed covering under 95 % of
    the known actives changes nothing.
    """
    known = stored.where("trading_status = 'active'").select("exchange", "symbol")
    seen = feed.select("exchange", "symbol").distinct().withColumn("_seen", F.lit(True))
    cover = known.join(seen, ["exchange", "symbol"], "left").groupBy("exchange").agg(
        F.count(F.lit(1)).alias("known"), F.count("_seen").alias("covered"))
    d = feeds.join(cover, "exchange", "left").fillna(0, ["known", "covered"])
    reason = (F.when(F.col("records") == 0, "empty feed").when(F.col("errors") > 0, "feed errors")
              .when((F.col("known") > 0) & (F.col("covered") < F.col("known") * COVERAGE_FLOOR),
                    "low coverage"))
    d = d.select("exchange", "known", "covered", reason.alias("skipped_reason"))
    act = d.where("skipped_reason IS NULL").select("exchange", F.lit(True).alias("_act"))
    j = stored.join(act, "exchange", "left").join(seen, ["exchange", "symbol"], "left")
    gone = (F.col("trading_status") == "active") & F.col("_act").isNotNull() & F.col("_seen").isNull()
    out = j.withColumn("trading_status", F.when(gone, "inactive").otherwise(F.col("trading_status")))
    return out.select(*stored.columns), d


def minute_gap_segments(trading_days: DataFrame, minute_days: DataFrame, *, window_start,
                        window_end) -> DataFrame:
    """(market, symbol, segment, seg_start, seg_end): missing days in greedy
    segments of at most 7 days, clipped to the window (end exclusive).

    A segment starts at the first day not covered by the one before, so the
    choice is a fold over the sorted missing days of a symbol (one month).
    """
    lo, hi = F.lit(window_start).cast("date"), F.lit(window_end).cast("date")
    missing = (trading_days.select("market", "symbol", "date")
               .where(F.col("date").between(lo, hi)).distinct()
               .join(minute_days.select("market", "symbol", "date"),
                     ["market", "symbol", "date"], "left_anti"))
    days = missing.groupBy("market", "symbol").agg(
        F.sort_array(F.collect_list("date")).alias("_days"))

    def step(acc: Column, day: Column) -> Column:
        covered = F.coalesce(day <= F.date_add(F.element_at(F.when(F.size(acc) > 0, acc), -1),
                                               SEGMENT_DAYS - 1), F.lit(False))
        return F.when(covered, acc).otherwise(F.array_append(acc, day))

    starts = F.aggregate("_days", F.array().cast("array<date>"), step)
    s = days.select("market", "symbol", F.posexplode(starts).alias("segment", "seg_start"))
    return s.withColumn("seg_end", F.least(F.date_add("seg_start", SEGMENT_DAYS),
                                           F.date_add(hi, 1)))


def minute_supplement_status(symbols: DataFrame, segments: DataFrame) -> DataFrame:
    """Per symbol: skipped with a reason, succeeded, partial_failure or failed.

    ``symbols``: (market, symbol, override, trading_days); ``segments``:
    (market, symbol, outcome) with succeeded, empty or failed. An empty segment
    counts as success.
    """
    g = segments.groupBy("market", "symbol").agg(
        F.count(F.lit(1)).alias("segments"),
        count_true(F.col("outcome") == "failed").alias("failed"))
    j = symbols.join(g, ["market", "symbol"], "left").fillna(0, ["segments", "failed"])
    reason = (F.when(F.upper("market") != "TW", "market_not_supported")
              .when(F.col("override"), "historical_date_override_not_supported")
              .when(F.col("trading_days") == 0, "no_recent_trading_days"))
    return j.select(
        "market", "symbol",
        F.when(reason.isNotNull(), "skipped")
        .when(F.col("failed") == 0, "succeeded")
        .when(F.col("failed") < F.col("segments"), "partial_failure")
        .otherwise("failed").alias("status"), reason.alias("skipped_reason"),
        F.when(reason.isNull(), F.col("segments")).otherwise(0).cast("bigint").alias("segments"))


def apply_price_adjustment(bars: DataFrame, factor: str | None) -> DataFrame:
    """open/high/low/close_adj = price x factor; unchanged without a factor column."""
    if factor is None or factor not in bars.columns:
        return bars
    f = F.col(factor).cast("string").try_cast("double")
    return bars.withColumns({f"{c}_adj": F.col(c) * f for c in PRICES})
