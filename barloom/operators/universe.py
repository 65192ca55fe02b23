"""Eligibility: official no-data dates, active universes, symbol identity.

The four notions of "active" are separate on purpose: they differ in the initial
state, in the events they look at and in how ticker changes count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.asof import asof_last, interval_counts
from barloom.functions.columns import finite, local_instant
from barloom.sources.shared import cut_lineage

# Event vocabularies.
ACTIVE_EVENTS = ("listing", "re_listing")
TERMINAL_EVENTS = ("delisting",)
STATE_EVENTS = ACTIVE_EVENTS + TERMINAL_EVENTS
BLOCKING_EVENTS = ("merger", "tender_offer")
NEUTRAL_EVENTS = ("stock_split", "reverse_split", "cash_dividend", "stock_dividend",
                  "capital_reduction")
RESEARCH_EXCHANGES = ("TWSE", "TPEX")
NO_DATA_MARKERS = ("沒有符合條件", "查無資料")

_FOREVER = "9999-12-31"
_DAWN = "0001-01-01"


#: What names a listing: markets may share symbols.
LISTED = ["market", "symbol"]

def declares_no_data(body: str | Column) -> Column:
    """True on a no-data text, or stat ok with every table empty and counted 0."""
    b = F.col(body) if isinstance(body, str) else body
    p = F.from_json(b, "stat string, message string, msg string, "
                       "tables array<struct<data string, totalCount string>>")
    detail = F.lower(F.concat_ws(" ", p["stat"], p["message"], p["msg"]))
    told = detail.rlike(r"\bno data\b")
    for marker in NO_DATA_MARKERS:
        told = told | detail.contains(marker)
    tables = F.filter(p["tables"], lambda t: t.isNotNull())
    empty = F.forall(tables, lambda t: F.coalesce(
        (F.regexp_replace(t["data"], r"\s", "") == "[]")
        & (t["totalCount"].try_cast("double") == 0.0), F.lit(False)))
    ok = F.lower(F.trim(F.coalesce(p["stat"], F.lit("")))) == "ok"
    return F.coalesce(told | (ok & (F.size(tables) > 0) & empty), F.lit(False))


def audit_date(context: str | Column) -> Column:
    """The ``date=`` token of a context text, in either of its two formats."""
    c = F.col(context) if isinstance(context, str) else context
    token = F.regexp_extract(F.coalesce(c, F.lit("")),
                             r"(?:^|;)date=(\d{8}|\d{4}/\d{2}/\d{2})(?:;|$)", 1)
    return F.coalesce(F.to_date(F.try_to_timestamp(token, F.lit("yyyyMMdd"))),
                      F.to_date(F.try_to_timestamp(token, F.lit("yyyy/MM/dd"))))


def official_no_data_dates(audits: DataFrame, *, sources: Sequence[str], start, end
                           ) -> DataFrame:
    """(date) where the latest audit of every source succeeded and has no data.

    The latest audit per (date, source) is chosen from the metadata alone, and
    only the bodies of the winners are read.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    day = audit_date("context")
    meta = (audits.where(F.col("source_name").isin(*sources)
                         & (F.col("fetch_ts") >= local_instant(first, "00:00")))
            .select("id", "source_name", "fetch_status", "fetch_ts", day.alias("date"))
            .where(F.col("date").between(first, last)))
    latest = (meta.groupBy("date", "source_name")
              .agg(F.max_by(F.struct("id", "fetch_status"), F.struct("fetch_ts", "id")).alias("m"))
              .select("date", "m.id", "m.fetch_status").where("fetch_status = 'success'"))
    bodies = audits.select("id", "payload_body").join(latest.select("id"), "id", "left_semi")
    empty = bodies.where(declares_no_data("payload_body")).select("id")
    return (latest.join(empty, "id", "left_semi").groupBy("date")
            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(sources))
            .select("date"))


def exclude_unofficial_on_no_data(bars: DataFrame, no_data: DataFrame,
                                  official: Sequence[str]) -> DataFrame:
    """Drops non-official rows on those dates (a calendar-sized set of dates)."""
    marked = bars.join(no_data.withColumn("_nd", F.lit(True)), "date", "left")
    keep = F.col("_nd").isNull() | F.coalesce(F.col("source").isin(*official), F.lit(False))
    return marked.where(keep).select(*bars.columns)


def eligible_bars(bars: DataFrame, no_data: DataFrame, official: Sequence[str]) -> DataFrame:
    """Bars that pass the no-data rule with every price finite and positive."""
    ok = F.lit(True)
    for c in ("open", "high", "low", "close"):
        ok = ok & F.coalesce(finite(c) > 0, F.lit(False))
    return exclude_unofficial_on_no_data(bars, no_data, official).where(ok)


def active_universe(profiles: DataFrame) -> DataFrame:
    sym = F.upper(F.trim("symbol"))
    return profiles.where((F.col("trading_status") == "active")
                          & (F.upper("market") == "TW")
                          & F.upper("exchange").isin(*RESEARCH_EXCHANGES)
                          & (F.trim("symbol") != "")).select(sym.alias("symbol")).distinct()


def archive_symbols_asof(profiles: DataFrame, lifecycle: DataFrame, bars: DataFrame, *, as_of
                         ) -> DataFrame:
    """(market, symbol): active profiles listed by then, plus symbols whose
    latest lifecycle event lists them; a market with neither uses its bars."""
    day = F.lit(as_of).cast("date")
    listed = profiles.where((F.col("trading_status") == "active")
                            & F.col("exchange").isin(*RESEARCH_EXCHANGES)
                            & (F.col("listing_date").isNull() | (F.col("listing_date") <= day))
                            ).select("market", "symbol")
    latest = (lifecycle.where(F.col("effective_date") <= day).groupBy("market", "symbol")
              .agg(F.max_by("event_type", F.struct("effective_date", "id")).alias("_t"))
              .where(F.col("_t").isin(*ACTIVE_EVENTS)).select("market", "symbol"))
    curated = listed.unionByName(latest).distinct()
    fallback = (bars.where(F.col("date") <= day).select("market", "symbol").distinct()
                .join(curated.select("market").distinct(), "market", "left_anti"))
    return curated.unionByName(fallback)


def active_asof_fold(asks: DataFrame, profiles: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """(market, symbol, date, active): folded from inactive; no events means active.

    Listing turns on, delisting off, a ticker change counts as an event but
    changes nothing. Before the listing date a symbol is inactive.
    """
    marks = lifecycle.select(
        *LISTED, "effective_date", "id",
        F.when(F.col("event_type").isin(*STATE_EVENTS),
               F.col("event_type").isin(*ACTIVE_EVENTS)).alias("_on"))
    any_event = asof_last(asks.select(*LISTED, "date"), marks.withColumn("_any", F.lit(True)),
                          keys=LISTED, left_at="date", right_at="effective_date",
                          values=["_any"])
    state = asof_last(any_event, marks.where("_on IS NOT NULL"), keys=LISTED,
                      left_at="date", right_at="effective_date", values=["_on"],
                      right_tie=["id"])
    joined = state.join(profiles.select(*LISTED, "listing_date"), LISTED, "left")
    early = F.coalesce(F.col("date") < F.col("listing_date"), F.lit(False))
    return joined.select(*LISTED, "date", (
        ~early & (F.col("_any").isNull() | F.coalesce(F.col("_on"), F.lit(False)))
    ).alias("active"))


def active_window_in_month(symbols: DataFrame, lifecycle: DataFrame, *, month_start=None,
                           month_end=None) -> DataFrame:
    """(market, symbol, active_start, active_end); both NULL when never active.

    Active unless the last state event before the month was a delisting. The
    month is given, or two columns of ``symbols``.
    """
    if month_start is not None:
        symbols = (symbols.withColumn("month_start", F.lit(month_start).cast("date"))
                   .withColumn("month_end", F.lit(month_end).cast("date")))
    first, last = F.col("month_start"), F.col("month_end")
    when, kind = F.col("effective_date"), F.col("event_type")
    own = symbols.select(*LISTED, "month_start", "month_end")
    ours = lifecycle.where(kind.isin(*STATE_EVENTS)).select(
        *LISTED, "effective_date", "event_type", "id").join(own, LISTED).where(when <= last)
    facts = ours.groupBy(*LISTED).agg(
        F.max_by("event_type", F.when(when < first, F.struct("effective_date", "id"))).alias("_prior"),
        F.min(F.when((when >= first) & kind.isin(*ACTIVE_EVENTS), when)).alias("_relist"))
    starts = own.join(facts, LISTED, "left").withColumn(
        "active_start", F.when(F.coalesce(F.col("_prior") == "delisting", F.lit(False)),
                               F.col("_relist")).otherwise(first))
    ends = ours.where((when >= first) & (kind == "delisting")).select(*LISTED, when.alias("_end"))
    g = (starts.join(ends, LISTED, "left").groupBy(*LISTED).agg(
        F.first("active_start").alias("active_start"), F.first("month_end").alias("_last"),
        F.min(F.when(F.col("_end") >= F.col("active_start"), F.col("_end"))).alias("_end")))
    end = F.coalesce(F.date_sub("_end", 1), F.col("_last"))
    ok = F.col("active_start").isNotNull() & (end >= F.col("active_start"))
    return g.select(*LISTED, F.when(ok, F.col("active_start")).alias("active_start"),
                    F.when(ok, end).alias("active_end"))


def lifecycle_marks(lifecycle: DataFrame) -> DataFrame:
    """Lifecycle rows that differ in more than their id, each with its last id.

    Identity and event state look at the last id only. An id is one long, so rows are
    combined in a hash table before they are exchanged.
    """
    return lifecycle.groupBy(*LISTED, "event_type", "effective_date", "reference_symbol").agg(
        F.max("id").alias("id"))


def _identity_states(symbols: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """(market, symbol, s_from, s_to, kind, successor): which event is in force when."""
    latest = lifecycle.groupBy(*LISTED, "effective_date").agg(
        F.max_by(F.struct("event_type", "reference_symbol"), F.col("id")).alias("e"))
    nxt = F.lead("effective_date").over(Window.partitionBy(*LISTED).orderBy("effective_date"))
    events = latest.select(
        *LISTED, F.col("effective_date").alias("s_from"),
        F.coalesce(nxt, F.lit(_FOREVER).cast("date")).alias("s_to"),
        F.col("e.event_type").alias("kind"),
        F.when(F.trim("e.reference_symbol") != "", F.trim("e.reference_symbol")).alias("successor"))
    names = (symbols.select(*LISTED).unionByName(lifecycle.select(*LISTED))
             .unionByName(lifecycle.where(F.trim("reference_symbol") != "")
                          .select("market", F.trim("reference_symbol").alias("symbol"))).distinct())
    firsts = lifecycle.groupBy(*LISTED).agg(F.min("effective_date").alias("_f"))
    before = names.join(firsts, LISTED, "left").select(
        *LISTED, F.lit(_DAWN).cast("date").alias("s_from"),
        F.coalesce("_f", F.lit(_FOREVER).cast("date")).alias("s_to"),
        F.lit("none").alias("kind"), F.lit(None).cast("string").alias("successor"))
    return before.unionByName(events)


def identity_intervals(symbols: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """(market, symbol, valid_from, valid_to, resolved_symbol, symbol_path,
    lifecycle_active, unresolved): the identity of a symbol between changes.

    Ticker changes, always within a market, are followed by a recursive query over validity intervals, so
    the work grows with lifecycle changes and not with symbols x dates. A cycle
    or a missing successor is unresolved. Chains deeper than the recursion limit
    of the session fail the query; none is cut short. Every step of the recursion reads
    the states, so they are checkpointed: the lifecycle is not reduced again at each.
    """
    spark = symbols.sparkSession
    states = cut_lineage(_identity_states(symbols, lifecycle))
    roots = symbols.select(*LISTED).distinct()
    text = """
      WITH RECURSIVE walk(market, symbol, current, v_from, v_to, path, kind, successor) AS (
        SELECT r.market, r.symbol, r.symbol, s.s_from, s.s_to, array(r.symbol), s.kind, s.successor
        FROM {roots} r JOIN {states} s ON s.market = r.market AND s.symbol = r.symbol
        UNION ALL
        SELECT w.market, w.symbol, w.successor, greatest(w.v_from, s.s_from), least(w.v_to, s.s_to),
               array_append(w.path, w.successor), s.kind, s.successor
        FROM walk w JOIN {states} s
          ON s.market = w.market AND s.symbol = w.successor AND s.s_from < w.v_to AND s.s_to > w.v_from
        WHERE w.kind = 'ticker_change' AND w.successor IS NOT NULL
          AND NOT array_contains(w.path, w.successor))
      SELECT * FROM walk"""
    walk = spark.sql(text, roots=roots, states=states)
    change = F.col("kind") == "ticker_change"
    cycle = change & F.col("successor").isNotNull() & F.array_contains(
        F.col("path"), F.col("successor"))
    lost = change & F.col("successor").isNull()
    final = walk.where(~change | cycle | lost)
    return final.select(
        *LISTED, F.col("v_from").alias("valid_from"), F.col("v_to").alias("valid_to"),
        F.when(cycle, F.col("successor")).otherwise(F.col("current")).alias("resolved_symbol"),
        F.when(cycle, F.array_append("path", F.col("successor"))).otherwise(F.col("path"))
        .alias("symbol_path"),
        (~change & (F.col("kind") != "delisting")).alias("lifecycle_active"),
        change.alias("unresolved"))


IDENTITY = ("resolved_symbol", "symbol_path", "lifecycle_active", "unresolved")


def identity_asof(asks: DataFrame, intervals: DataFrame) -> DataFrame:
    """``asks`` (market, symbol, date, ...) with the identity in force on the date."""
    return asof_last(asks, intervals, keys=LISTED, left_at="date", right_at="valid_from",
                     values=IDENTITY)


def blocking_intervals(events: DataFrame, lifecycle: DataFrame, end: str | Column | None = None
                       ) -> DataFrame:
    """(market, symbol, b_from, b_to): as-of dates on which an event blocks its symbol.

    Events published after ``end`` (a date, or a date column of the events) are not known.
    Events of a symbol that fall on one day and are of one kind block alike and give one
    interval. The first confirming lifecycle date at or after each of them comes from a
    running minimum over the union of both, latest day first: a frame that begins at its
    partition's first row is carried on from row to row, one that runs to the last row
    would be summed up anew for each.
    """
    if end is not None:
        until = F.lit(end).cast("date") if isinstance(end, str) else end
        events = events.where(F.to_date("publication_ts") <= until)
    day = F.coalesce(F.col("effective_date"), F.to_date("publication_ts"))
    ev = events.select(*LISTED, day.alias("at"), F.col("event_type").alias("ev")).distinct()
    tc = lifecycle.where("event_type = 'ticker_change'").groupBy(*LISTED, "effective_date").agg(
        F.max_by("reference_symbol", F.col("id")).alias("_ref"))
    life = lifecycle.groupBy(*LISTED, F.col("effective_date").alias("at")).agg(
        F.max(F.col("event_type").isin(*TERMINAL_EVENTS)).alias("is_del"),
        F.max(F.col("event_type").isin(*STATE_EVENTS)).alias("is_state"),
        F.max(F.col("event_type") == "ticker_change").alias("is_tc"))
    onward = Window.partitionBy(*LISTED).orderBy(F.col("at").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    both = ev.unionByName(life, allowMissingColumns=True)
    at = F.col("at")

    def first(flag: str) -> Column:
        return F.min(F.when(F.col(flag), at)).over(onward)

    ahead = both.select(*LISTED, "at", "ev", first("is_del").alias("_del"),
                        first("is_state").alias("_state"), first("is_tc").alias("_tc"))
    until = (F.when(F.col("ev") == "delisting", F.col("_del"))
             .when(F.col("ev") == "listing_status_change", F.col("_state"))
             .when(F.col("ev") == "ticker_change", F.col("_tc")))
    direct = ahead.where(F.col("ev").isNotNull() & ~F.col("ev").isin(*NEUTRAL_EVENTS)).select(
        *LISTED, at.alias("b_from"), until.alias("b_to"))
    # A confirmed ticker change blocks again while the latest one names no successor.
    asked = ev.where("ev = 'ticker_change'").groupBy(*LISTED).agg(F.min("at").alias("_since"))
    nxt = F.lead("effective_date").over(Window.partitionBy(*LISTED).orderBy("effective_date"))
    blank = (tc.withColumn("b_to", nxt)
             .where(F.coalesce(F.trim("_ref"), F.lit("")) == "")
             .join(asked, LISTED).where(F.col("_since") <= F.col("effective_date"))
             .select(*LISTED, F.col("effective_date").alias("b_from"), "b_to"))
    return direct.unionByName(blank)


def event_clear(identities: DataFrame, events: DataFrame, lifecycle: DataFrame,
                end: str | Column | None = None) -> DataFrame:
    """``identities`` (market, symbol, date, symbol_path, unresolved, ...) with ``clear``.

    ``end`` is the last publication date that counts, as of a run's end. Every symbol on the identity path must be free of blocking events.
    """
    opened = interval_counts(blocking_intervals(events, lifecycle, end), keys=LISTED,
                             start="b_from", end="b_to").withColumnRenamed("symbol", "_s")
    path = identities.select(*LISTED, "date", F.explode(F.array_distinct("symbol_path"))
                             .alias("_s")).distinct()
    state = asof_last(path, opened, keys=["market", "_s"], left_at="date", right_at="at",
                      values=["open"])
    blocked = state.groupBy(*LISTED, "date").agg(
        (F.max(F.coalesce("open", F.lit(0))) > 0).alias("_blocked"))
    return (identities.join(blocked, [*LISTED, "date"], "left")
            .withColumn("clear", ~F.col("unresolved")
                        & ~F.coalesce(F.col("_blocked"), F.lit(False)))
            .drop("_blocked"))

