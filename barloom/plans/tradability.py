"""Queries: universe, identity, corporate events and tradability."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.functions.panel import panel
from barloom.operators import (observations as ob, portfolio as pf, tradability as tr, universe as un)
from barloom.operators.splits import trading_calendar
from barloom.plans.catalog import query
from barloom.plans.inputs import (TYPE_REQ, brand_bars, sql, type_bars, type_requests,
                                  type_universe, universe_of)
from barloom.sources.shared import cut_lineage, shared_dir
from barloom.sources.tables import (company_profiles, corporate_events, lifecycle_events, one_market, table)

OFFICIAL = ("exchange_daily",)
AUDIT_SOURCES = ("exchange_daily", "otc_daily")
LIMITS = (6000.0, 10000.0, 15000.0)

BUNI = {"uni": "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS position "
               "FROM (SELECT DISTINCT p_brand AS symbol FROM part)"}
TUNI = {"uni": TYPE_REQ["tuni"]}


def life_sql(slots):
    return f"""SELECT o_orderkey AS id, u.symbol, 'TW' AS market,
      CASE o_orderstatus WHEN 'O' THEN 'listing' WHEN 'F' THEN 'delisting' ELSE 'ticker_change' END AS event_type,
      CAST(o_orderdate AS DATE) AS effective_date,
      CASE WHEN o_orderstatus NOT IN ('O', 'F') AND o_orderkey % 5 <> 0 THEN v.symbol END AS reference_symbol
    FROM orders JOIN uni u ON u.position = o_custkey % {slots} JOIN uni v ON v.position = (o_custkey + 1) % {slots}"""


def corp_sql(slots):
    return f"""SELECT o_orderkey AS id, symbol, 'TW' AS market,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1998-01-01' THEN 'merger' ELSE 'cash_dividend' END WHEN '2' THEN 'delisting'
        WHEN '3' THEN 'cash_dividend' WHEN '4' THEN 'ticker_change' ELSE 'listing_status_change' END AS event_type,
      o_orderdate AS publication_ts,
      CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderdate AS DATE) + 2 END AS effective_date
    FROM orders JOIN uni ON position = o_custkey % {slots}"""


PROFILES_SQL = """SELECT symbol, 'TW' AS market, CASE WHEN n_regionkey % 2 = 0 THEN 'TWSE' ELSE 'TPEX' END AS exchange,
    CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'inactive' END AS trading_status,
    CASE WHEN s_suppkey % 4 <> 0 THEN DATE '1995-01-01' + CAST(s_suppkey * 60 AS INTEGER) END AS listing_date
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN uni ON s_suppkey = position"""

AUDITS_SQL = """SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'exchange_daily' ELSE 'otc_daily' END AS source_name,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'failed' ELSE 'success' END AS fetch_status,
    CASE WHEN o_orderkey % 2 = 0 THEN 'date=' || strftime(o_orderdate, '%Y%m%d')
      ELSE 'market=TW;date=' || strftime(o_orderdate, '%Y/%m/%d') || ';x' END AS context,
    o_orderdate + INTERVAL 10 HOUR AS fetch_ts, CAST(o_orderdate AS DATE) AS date,
    o_orderkey % 5 IN (0, 1) AS no_data FROM orders"""


def audits(spark, d):
    k = F.col("o_orderkey")
    day = F.to_timestamp("o_orderdate")
    body = (F.when(k % 5 == 0, '{"stat": "No data for this day"}')
            .when(k % 5 == 1, '{"stat": "OK", "tables": [{"data": [], "totalCount": 0}, {"data": [], "totalCount": "0"}]}')
            .when(k % 5 == 2, '{"stat": "OK", "tables": [{"data": [["1"]], "totalCount": 1}]}')
            .when(k % 5 == 3, '{"stat": "OK", "tables": [{"data": []}]}')
            .otherwise('{"stat": "OK", "tables": [{"data": [], "totalCount": true}]}'))
    return table(spark, d, "orders").select(
        k.alias("id"),
        F.when(F.col("o_custkey") % 2 == 0, "exchange_daily").otherwise("otc_daily").alias("source_name"),
        F.when((F.col("o_orderstatus") == "F") & (k % 3 == 0), "failed").otherwise("success")
        .alias("fetch_status"),
        F.when(k % 2 == 0, F.concat(F.lit("date="), F.date_format(day, "yyyyMMdd")))
        .otherwise(F.concat(F.lit("market=TW;date="), F.date_format(day, "yyyy/MM/dd"), F.lit(";x")))
        .alias("context"),
        (day + F.expr("INTERVAL 10 HOURS")).alias("fetch_ts"), body.alias("payload_body"))


_ND = {"aud": AUDITS_SQL,
       "nd": """SELECT date FROM (SELECT date, source_name, arg_max(CASE WHEN fetch_status = 'success' AND no_data THEN 1 ELSE 0 END,
           id) AS hit FROM aud WHERE fetch_ts >= TIMESTAMP '1995-12-31 16:00:00'
           AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1, 2)
         GROUP BY 1 HAVING sum(hit) = 2"""}


def no_data(spark, d):
    return un.official_no_data_dates(audits(spark, d), sources=AUDIT_SOURCES,
                                     start="1996-01-01", end="2000-12-31")


@query("detect_declared_no_data", sql("", "SELECT id, no_data FROM aud", aud=AUDITS_SQL))
def _(spark, d):
    return audits(spark, d).select("id", un.declares_no_data("payload_body").alias("no_data"))


@query("extract_audit_date", sql("", "SELECT id, CAST(date AS VARCHAR) AS date FROM aud", aud=AUDITS_SQL))
def _(spark, d):
    return present(audits(spark, d).select("id", un.audit_date("context").alias("date")))


@query("official_no_data_dates", sql("", "SELECT CAST(date AS VARCHAR) AS date FROM nd", **_ND))
def _(spark, d):
    return present(no_data(spark, d))


@query("exclude_unofficial_on_no_data", sql("bars", """SELECT symbol, CAST(date AS VARCHAR) AS date, source FROM bars
    WHERE source = 'exchange_daily' OR date NOT IN (SELECT date FROM nd)""", **_ND))
def _(spark, d):
    bars = brand_bars(spark, d).select("symbol", "date", "source")
    return present(un.exclude_unofficial_on_no_data(bars, no_data(spark, d), OFFICIAL))


def dirty_prices(bars):
    """Some prices negated or NaN, to be screened out."""
    v = F.col("volume") % 17
    return bars.withColumn("open", F.when(v == 0, -F.col("open")).otherwise(F.col("open"))) \
        .withColumn("close", F.when(v == 1, F.lit(float("nan"))).otherwise(F.col("close")))


@query("eligible_bars", sql("bars", """SELECT symbol, CAST(date AS VARCHAR) AS date, round(close, 6) AS close FROM bars
    WHERE (source = 'exchange_daily' OR date NOT IN (SELECT date FROM nd)) AND volume % 17 > 1""", **_ND))
def _(spark, d):
    bars = dirty_prices(brand_bars(spark, d))
    out = un.eligible_bars(bars, no_data(spark, d), OFFICIAL)
    return present(out.select("symbol", "date", "close"))


@query("active_universe", """SELECT DISTINCT 'S' || s_suppkey AS symbol FROM supplier
  JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 AND n_regionkey % 3 < 2""")
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"),
                                         F.col("s_nationkey") == F.col("n_nationkey"))
    r = F.col("n_regionkey") % 3
    profiles = s.select(
        F.concat(F.lit(" s"), "s_suppkey", F.lit(" ")).alias("symbol"), F.lit("tw").alias("market"),
        F.when(r == 0, "twse").when(r == 1, "TPEX").otherwise("ESB").alias("exchange"),
        F.when(F.col("s_acctbal") > 0, "active").otherwise("inactive").alias("trading_status"))
    return un.active_universe(profiles)


def brand_life(spark, d):
    return lifecycle_events(spark, d, universe_of(spark, d), 25)


def type_life(spark, d):
    return lifecycle_events(spark, d, type_universe(spark, d), 6)


def type_events(spark, d):
    return corporate_events(spark, d, type_universe(spark, d), 6)


@query("archive_symbols_asof", sql("bars", """SELECT DISTINCT market, symbol FROM (
    SELECT market, symbol FROM prof WHERE trading_status = 'active' AND exchange IN ('TWSE', 'TPEX')
      AND (listing_date IS NULL OR listing_date <= DATE '1997-06-30')
    UNION ALL SELECT market, symbol FROM (SELECT market, symbol, arg_max(event_type, row(effective_date, id)) AS t
      FROM life WHERE effective_date <= DATE '1997-06-30' GROUP BY 1, 2) WHERE t = 'listing'
    UNION ALL SELECT CASE WHEN symbol < 'Brand#2' THEN 'TW' ELSE 'US' END, symbol FROM bars
      WHERE date <= DATE '1997-06-30' AND symbol >= 'Brand#2')""",
    **BUNI, life=life_sql(25), prof=PROFILES_SQL))
def _(spark, d):
    bars = brand_bars(spark, d).withColumn(
        "market", F.when(F.col("symbol") < "Brand#2", "TW").otherwise("US"))
    return un.archive_symbols_asof(company_profiles(spark, d, universe_of(spark, d)),
                                   brand_life(spark, d), bars, as_of="1997-06-30")


@query("active_asof_fold", sql("bars", """SELECT symbol, CAST(date AS VARCHAR) AS date,
    NOT coalesce(date < listing_date, false) AND (n = 0 OR coalesce(last, '') = 'listing') AS active
    FROM (SELECT b.symbol, b.date, any_value(p.listing_date) AS listing_date, count(l.id) AS n,
        arg_max(l.event_type, row(l.effective_date, l.id)) FILTER (l.event_type <> 'ticker_change') AS last
      FROM bars b LEFT JOIN prof p USING (symbol)
      LEFT JOIN life l ON l.symbol = b.symbol AND l.effective_date <= b.date GROUP BY 1, 2)""",
    **BUNI, life=life_sql(25), prof=PROFILES_SQL))
def _(spark, d):
    return present(un.active_asof_fold(
        brand_bars(spark, d).withColumn("market", one_market("symbol")), company_profiles(spark, d, universe_of(spark, d)),
        brand_life(spark, d)).drop("market"))


@query("active_window_in_month", sql("", """SELECT symbol,
    CASE WHEN coalesce(e, DATE '1999-03-31') >= s THEN CAST(s AS VARCHAR) END AS active_start,
    CASE WHEN coalesce(e, DATE '1999-03-31') >= s THEN CAST(coalesce(e, DATE '1999-03-31') AS VARCHAR) END AS active_end
  FROM (SELECT symbol, any_value(s) AS s, min(effective_date) FILTER (event_type = 'delisting'
      AND effective_date BETWEEN s AND DATE '1999-03-31') - 1 AS e
    FROM (SELECT symbol, CASE WHEN prior = 'delisting' THEN relist ELSE DATE '1999-03-01' END AS s FROM (
      SELECT u.symbol, arg_max(event_type, row(effective_date, id)) FILTER (effective_date < DATE '1999-03-01'
          AND event_type <> 'ticker_change') AS prior,
        min(effective_date) FILTER (effective_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31'
          AND event_type = 'listing') AS relist FROM uni u LEFT JOIN life USING (symbol) GROUP BY 1))
    LEFT JOIN life USING (symbol) GROUP BY 1)""", **BUNI, life=life_sql(25)))
def _(spark, d):
    return present(un.active_window_in_month(
        universe_of(spark, d).withColumn("market", one_market("symbol")), brand_life(spark, d), month_start="1999-03-01",
        month_end="1999-03-31").drop("market"))


# Identity on every market date of the part types, by a walk per date.
_IDENT = {
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM tbars)",
    "life": life_sql(6),
    "st": """SELECT u.symbol, c.date, arg_max(event_type, row(effective_date, id)) AS kind,
        arg_max(coalesce(reference_symbol, ''), row(effective_date, id)) AS succ
      FROM uni u CROSS JOIN cal c LEFT JOIN life l ON l.symbol = u.symbol AND l.effective_date <= c.date
      GROUP BY 1, 2""",
    "ident": """SELECT symbol, date, last AS resolved_symbol, path, kind, NOT (kind = 'ticker_change')
        AND coalesce(kind, '') <> 'delisting' OR kind IS NULL AS lifecycle_active,
        coalesce(kind = 'ticker_change', false) AS unresolved FROM (
      SELECT symbol, date, CASE WHEN kind = 'ticker_change' AND succ <> '' THEN succ ELSE cur END AS last,
        CASE WHEN kind = 'ticker_change' AND succ <> '' THEN list_append(path, succ) ELSE path END AS path, kind
      FROM walk WHERE kind IS NULL OR kind <> 'ticker_change' OR succ = '' OR list_contains(path, succ))""",
}
_WALK = """WITH RECURSIVE tbars AS ({tbars}), uni AS ({uni}), cal AS ({cal}), life AS ({life}), st AS ({st}),
  walk(symbol, date, cur, path, kind, succ) AS (
    SELECT symbol, date, symbol, [symbol], kind, succ FROM st
    UNION ALL
    SELECT w.symbol, w.date, w.succ, list_append(w.path, w.succ), s.kind, s.succ
    FROM walk w JOIN st s ON s.symbol = w.succ AND s.date = w.date
    WHERE w.kind = 'ticker_change' AND w.succ <> '' AND NOT list_contains(w.path, w.succ)),
  ident AS ({ident})"""


def ident_sql(body, **extra):
    from barloom.plans.inputs import FRAGMENTS
    text = _WALK.format(tbars=FRAGMENTS["tbars"], **TUNI, **_IDENT)
    return text + "".join(f",\n{n} AS ({q})" for n, q in extra.items()) + "\n" + body


def type_panel(spark, d):
    bars = type_bars(spark, d).withColumn("market", one_market("symbol"))
    return bars, trading_calendar(bars)


def type_identities(spark, d):
    bars, cal = type_panel(spark, d)
    names = type_universe(spark, d).select(one_market("symbol").alias("market"), "symbol")
    return un.identity_asof(panel(names, cal),
                            cut_lineage(un.identity_intervals(names, type_life(spark, d))))


@query("identity_asof", ident_sql("""SELECT symbol, CAST(date AS VARCHAR) AS date, resolved_symbol,
    array_to_string(path, ',') AS symbol_path, lifecycle_active, unresolved FROM ident"""))
def _(spark, d):
    out = type_identities(spark, d)
    return present(out.select("symbol", "date", "resolved_symbol", "symbol_path",
                              "lifecycle_active", "unresolved"))


_CLEAR = {
    "corp": corp_sql(6),
    "ev": "SELECT symbol, event_type, coalesce(effective_date, CAST(publication_ts AS DATE)) AS e FROM corp",
    # The latest notice of a kind is the last one to be settled, so it alone decides.
    "said": """SELECT s.symbol, s.date, count(*) FILTER (event_type = 'merger') AS mergers,
        max(e) FILTER (event_type = 'delisting') AS dl, max(e) FILTER (event_type = 'listing_status_change') AS ls,
        max(e) FILTER (event_type = 'ticker_change') AS tc
      FROM st s JOIN ev ON ev.symbol = s.symbol AND ev.e <= s.date GROUP BY 1, 2""",
    "done": """SELECT s.symbol, s.date, max(effective_date) FILTER (event_type = 'delisting') AS dl,
        max(effective_date) FILTER (event_type IN ('listing', 'delisting')) AS ls, max(effective_date) FILTER (event_type = 'ticker_change') AS tc,
        arg_max(coalesce(reference_symbol, ''), row(effective_date, id)) FILTER (event_type = 'ticker_change') AS ref
      FROM st s JOIN life l ON l.symbol = s.symbol AND l.effective_date <= s.date GROUP BY 1, 2""",
    "blk": """SELECT s.symbol, s.date FROM said s LEFT JOIN done d USING (symbol, date)
      WHERE mergers > 0 OR s.dl > coalesce(d.dl, DATE '0001-01-01') OR s.ls > coalesce(d.ls, DATE '0001-01-01')
        OR (s.tc IS NOT NULL AND (s.tc > coalesce(d.tc, DATE '0001-01-01') OR coalesce(d.ref, '') = ''))""",
    "clr": """SELECT symbol, date, NOT unresolved AND bad = 0 AS clear FROM (
      SELECT i.symbol, i.date, any_value(i.unresolved) AS unresolved, count(b.symbol) AS bad
      FROM (SELECT symbol, date, unresolved, unnest(path) AS p FROM ident) i
      LEFT JOIN blk b ON b.symbol = i.p AND b.date = i.date GROUP BY 1, 2)""",
}


EVENTS_END = "1995-06-30"


@query("event_clear", ident_sql("SELECT symbol, CAST(date AS VARCHAR) AS date, clear FROM clr", **(_CLEAR | {
    "ev": f"{_CLEAR['ev']} WHERE CAST(publication_ts AS DATE) <= DATE '{EVENTS_END}'"})))
def _(spark, d):
    out = un.event_clear(type_identities(spark, d), type_events(spark, d), type_life(spark, d), EVENTS_END)
    return present(out.select("symbol", "date", "clear"))


_READY = {
    "rp": """SELECT symbol, date, idx, sum(c) OVER (PARTITION BY symbol ORDER BY idx) AS history,
        sum(c) OVER w / least(idx + 1, 20)::DOUBLE AS completeness,
        coalesce(avg(close * volume) OVER w, 0) AS adv20
      FROM (SELECT u.symbol, cal.date, idx, close, volume, CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END AS c
        FROM uni u CROSS JOIN cal LEFT JOIN tbars USING (symbol, date))
      WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING)"""}


def ready_sql(body):
    return sql("tbars", body, **TUNI, cal=_IDENT["cal"], **_READY)


@query("history_ready", ready_sql("""SELECT symbol, CAST(date AS VARCHAR) AS date,
    CAST(history AS BIGINT) AS history, history >= 120 AS history_ready FROM rp"""))
def _(spark, d):
    out = tr.history_ready(tr.readiness_panel(*type_panel(spark, d)))
    return present(out.select("symbol", "date", "history", "history_ready"))


@query("recent_completeness", ready_sql("""SELECT symbol, CAST(date AS VARCHAR) AS date,
    round(completeness, 6) AS completeness, completeness >= 0.95 AS recent_complete FROM rp"""))
def _(spark, d):
    out = tr.recent_completeness(tr.readiness_panel(*type_panel(spark, d)))
    return present(out.select("symbol", "date", "completeness", "recent_complete"))


@query("adv20", ready_sql("SELECT symbol, CAST(date AS VARCHAR) AS date, round(adv20, 4) AS adv20 FROM rp"))
def _(spark, d):
    out = tr.readiness_panel(*type_panel(spark, d))
    return present(out.select("symbol", "date", "adv20"), digits=4)


_BUCKET = ("CASE WHEN adv20 < 6000 THEN 'lt_10m' WHEN adv20 < 10000 THEN '10m_to_50m' "
           "WHEN adv20 < 15000 THEN '50m_to_200m' ELSE 'ge_200m' END")


@query("liquidity_bucket", ready_sql(
    f"SELECT symbol, CAST(date AS VARCHAR) AS date, {_BUCKET} AS bucket FROM rp"))
def _(spark, d):
    out = tr.readiness_panel(*type_panel(spark, d))
    return present(out.select("symbol", "date", tr.liquidity_bucket("adv20", LIMITS).alias("bucket")))


@query("capacity_pass", ready_sql("""SELECT symbol, CAST(date AS VARCHAR) AS date,
    CASE WHEN idx % 7 = 0 THEN true ELSE adv20 > 0 AND 250e0 / 5 <= adv20 * 0.005e0 END AS capacity_pass FROM rp"""))
def _(spark, d):
    out = tr.readiness_panel(*type_panel(spark, d))
    aum = F.when(F.col("idx") % 7 != 0, F.lit(250.0))
    return present(out.select("symbol", "date",
                              tr.capacity_pass("adv20", aum, F.lit(5)).alias("capacity_pass")))


_CELLS = {
    **_CLEAR, **_READY, "treq": TYPE_REQ["treq"].replace("tuni", "uni"),
    "cells": f"""SELECT run_id, i.symbol, i.date, {_BUCKET} AS bucket,
        lifecycle_active AND history >= 120 AND completeness >= 0.95 AND clear
          AND (aum IS NULL OR (adv20 > 0 AND aum / 3 <= adv20 * 0.005e0)) AS eligible,
        history < 120 OR completeness < 0.95 AS gap, clear
      FROM ident i JOIN clr USING (symbol, date)
      JOIN rp ON rp.symbol = i.resolved_symbol AND rp.date = i.date
      JOIN (SELECT *, CASE WHEN run_id >= 'run-3' THEN 120e0 END AS aum FROM treq) t ON t.symbol = i.symbol""",
    "daily": """SELECT run_id, date, count(*) AS full_n, count(*) FILTER (eligible) AS exec_n,
        count(*) FILTER (eligible) / count(*)::DOUBLE AS ratio, bool_or(gap) AS gap, bool_and(clear) AS clear
      FROM cells GROUP BY 1, 2"""}


def stored_type_bars(spark, d):
    """The type bars, which panels, weights and volumes read: lines are reduced to them once."""
    return cut_lineage(type_bars(spark, d))


def daily_universe(spark, d, bars=None):
    bars = (bars or stored_type_bars(spark, d)).withColumn("market", one_market("symbol"))
    cal = trading_calendar(bars)
    runs = type_requests(spark, d).select(
        "run_id", one_market("symbol").alias("market"), "symbol",
        F.when(F.col("run_id") >= "run-3", F.lit(120.0)).alias("aum"), F.lit(3).alias("top_n"))
    cells = tr.tradable_cells(runs, bars, cal, type_events(spark, d), type_life(spark, d),
                              limits=LIMITS)
    return tr.execution_universe_daily(cells)


@query("execution_universe_daily", ident_sql("""SELECT run_id, CAST(date AS VARCHAR) AS date,
    full_n AS full_universe_count, exec_n AS execution_universe_count, round(ratio, 6) AS execution_universe_ratio,
    gap AS has_missing_core_gap, clear AS corporate_event_clear FROM daily""", **_CELLS))
def _(spark, d):
    return present(daily_universe(spark, d).drop("market", "bucket_coverages"))


_KEYS = "(VALUES ('lt_10m'), ('10m_to_50m'), ('50m_to_200m'), ('ge_200m')) AS k(bucket_key)"
_COV = """SELECT r.run_id, r.date, bucket_key, count(c.symbol) AS full_count,
    count(*) FILTER (eligible) AS execution_count, count(c.symbol) / any_value(full_n)::DOUBLE AS full_ratio,
    coalesce(count(*) FILTER (eligible) / nullif(count(c.symbol), 0)::DOUBLE, 0) AS coverage_ratio
  FROM daily r CROSS JOIN """ + _KEYS + """ LEFT JOIN cells c ON c.run_id = r.run_id AND c.date = r.date
    AND c.bucket = bucket_key GROUP BY 1, 2, 3"""


@query("execution_universe_buckets", ident_sql("""SELECT run_id, CAST(date AS VARCHAR) AS date, bucket_key, full_count,
    execution_count, round(full_ratio, 6) AS full_ratio, round(coverage_ratio, 6) AS coverage_ratio FROM cov""",
    **_CELLS, cov=_COV))
def _(spark, d):
    return present(daily_universe(spark, d).select("run_id", "date", F.inline("bucket_coverages")))


def thin_volumes(bars):
    """Volume missing or zero on some bars, so that stale marks occur."""
    v = F.col("volume")
    return bars.select("symbol", "date", F.when(v % 23 == 0, F.lit(None)).when(v % 23 == 1, 0)
                       .otherwise(v).alias("volume"))


_STALE = {
    "z1": """SELECT symbol, date, volume, close > lag(close) OVER (PARTITION BY symbol ORDER BY date) AS up FROM tbars""",
    "tw": """SELECT run_id, symbol, date, volume, CASE WHEN up THEN 1e0 / greatest(sum(CASE WHEN up THEN 1 ELSE 0 END)
      OVER (PARTITION BY run_id, date), 1) ELSE 0e0 END AS weight FROM z1 JOIN treq USING (symbol)""",
    "sd": """SELECT run_id, date, bool_or(weight > 0 AND volume % 23 < 2) AS stale FROM tw GROUP BY 1, 2"""}


def type_weights(spark, d, bars):
    """Equal weight on the types that rose that day."""
    from pyspark.sql import Window
    up = F.col("close") > F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    scores = bars.withColumn("score", F.when(up, 1.0).otherwise(0.0)).select("symbol", "date", "score")
    runs = type_requests(spark, d)
    return pf.topn_weights(scores.join(runs, "symbol"), threshold=0.5, top_n=100, keys=["run_id"])


@query("stale_mark_days", sql("tbars", """SELECT run_id, count(*) FILTER (stale) AS stale_days,
    round(count(*) FILTER (stale) / count(*)::DOUBLE, 6) AS stale_share FROM sd GROUP BY 1""", **TYPE_REQ, **_STALE))
def _(spark, d):
    bars = stored_type_bars(spark, d)
    return present(tr.stale_mark_days(type_weights(spark, d, bars), thin_volumes(bars)))


_STATE = {**_CELLS, **{k: v for k, v in _STALE.items()},
          "sdr": "SELECT run_id, count(*) FILTER (stale AND run_id < 'run-2') AS stale_days FROM sd GROUP BY 1"}


@query("tradability_state", ident_sql("""SELECT run_id,
    CASE WHEN NOT clear THEN 'unresolved_corporate_event' WHEN stale_days > 0 THEN 'stale_risk'
      WHEN exec_n > 0 AND run_id <> 'run-2' THEN 'execution_ready' ELSE 'research_only' END AS tradability_state,
    CASE WHEN gap THEN 'core_data_gaps_filtered' ELSE 'native_missing_supported' END AS missing_feature_policy_state,
    CASE WHEN clear THEN 'clear' ELSE 'unresolved_corporate_event' END AS corporate_event_state
  FROM (SELECT run_id, arg_max(clear, date) AS clear, arg_max(exec_n, date) AS exec_n, arg_max(gap, date) AS gap
    FROM daily GROUP BY 1) JOIN sdr USING (run_id)""", **_STATE))
def _(spark, d):
    bars = stored_type_bars(spark, d)
    stale = tr.stale_mark_days(type_weights(spark, d, bars), thin_volumes(bars)).withColumn(
        "stale_days", F.when(F.col("run_id") < "run-2", F.col("stale_days")).otherwise(0))
    routes = type_requests(spark, d).select("run_id").distinct().withColumn(
        "execution_route", F.when(F.col("run_id") != "run-2", "simulation").otherwise("research_only"))
    return present(tr.tradability_state(daily_universe(spark, d, bars), stale, routes))


def observations(spark, d):
    bars = stored_type_bars(spark, d)
    stale = tr.stale_dates(type_weights(spark, d, bars), thin_volumes(bars))
    return tr.microstructure_observations(daily_universe(spark, d, bars), stale, profile="monitor_v1")


@query("microstructure_observations", ident_sql("""SELECT 'monitor_v1' AS monitor_profile_id, run_id, 'TW' AS market,
    CAST(date AS VARCHAR) AS trading_date, full_n AS full_universe_count, exec_n AS execution_universe_count,
    round(ratio, 6) AS execution_universe_ratio, coalesce(stale, false) AS stale_mark_with_open_positions
    FROM daily LEFT JOIN sd USING (run_id, date)""", **_STATE))
def _(spark, d):
    return present(observations(spark, d).drop("bucket_coverages"))


@query("micro_kpi_drift", ident_sql("""SELECT run_id, metric, round(value, 6) AS value, round(drift, 6) AS drift, status FROM (
    SELECT run_id, 'execution_ratio' AS metric, ra AS value, abs(ra - rb) / greatest(rb, 0.01) AS drift,
      CASE WHEN abs(ra - rb) / greatest(rb, 0.01) <= 0.1 THEN 'pass' ELSE 'fail' END AS status FROM tot
    UNION ALL SELECT run_id, 'stale_share', sa, abs(sa - sb) / greatest(sb, 0.01),
      CASE WHEN sa <= 0.05 AND abs(sa - sb) / greatest(sb, 0.01) <= 0.2 THEN 'pass' ELSE 'fail' END FROM tot
    UNION ALL SELECT run_id, 'bucket_coverage', coalesce(w, 0), coalesce(w, 0),
      CASE WHEN w IS NULL THEN 'insufficient_sample' WHEN w <= 0.1 THEN 'pass' ELSE 'fail' END
      FROM tot LEFT JOIN worst USING (run_id))""", **_STATE, cov=_COV,
    rk="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY date DESC) AS rk FROM daily LEFT JOIN sd USING (run_id, date)",
    tot="""SELECT run_id, avg(ratio) FILTER (rk <= 20) AS ra, avg(ratio) FILTER (rk > 20) AS rb,
        avg(CASE WHEN stale THEN 1e0 ELSE 0e0 END) FILTER (rk <= 20) AS sa,
        avg(CASE WHEN stale THEN 1e0 ELSE 0e0 END) FILTER (rk > 20) AS sb FROM rk WHERE rk <= 80 GROUP BY 1""",
    worst="""SELECT run_id, max(abs(ca - cb) / greatest(cb, 0.01)) AS w FROM (
        SELECT run_id, bucket_key, avg(full_ratio) FILTER (rk > 20) AS share, avg(coverage_ratio) FILTER (rk <= 20) AS ca,
          avg(coverage_ratio) FILTER (rk > 20) AS cb FROM cov JOIN rk USING (run_id, date) WHERE rk <= 80 GROUP BY 1, 2)
      WHERE share >= 0.05 GROUP BY 1"""))
def _(spark, d):
    return present(tr.micro_kpi_drift(observations(spark, d), keys=["run_id"]))


# A run per customer observes the dates of its orders; every 11th also looks at a second
# market. All runs are stored, then the odd ones once more as later runs.
_WATCH = {
    "cu": """SELECT c_custkey AS k, 'm' || (c_nationkey + 25 * (c_custkey % 16)) AS profile,
        CASE WHEN c_custkey % 3 = 0 THEN 'US' ELSE 'TW' END AS market FROM customer WHERE c_custkey % 13 <> 0""",
    "ow": """SELECT o_custkey AS k, CASE WHEN o_custkey % 11 = 0 AND o_orderkey % 2 = 0 THEN 'HK'
        WHEN o_custkey % 3 = 0 THEN 'US' ELSE 'TW' END AS market, CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq FROM orders""",
    "sc": """SELECT profile, market, arg_max(k, (CASE WHEN k % 2 = 1 THEN 1000000000000 ELSE 0 END) + k) AS k
      FROM (SELECT DISTINCT cu.k, profile, coalesce(ow.market, cu.market) AS market FROM cu LEFT JOIN ow USING (k)) GROUP BY 1, 2""",
}


@query("microstructure_store", sql("", """SELECT profile AS monitor_profile_id, market, CAST(date AS VARCHAR) AS trading_date,
    k AS run_id, max(seq) AS full_universe_count FROM sc JOIN ow USING (k, market) GROUP BY ALL""", **_WATCH))
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("run_id")
    runs = c.select(
        F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_custkey") % 13 != 0, F.concat(F.lit("m"), F.col("c_nationkey") + 25 * (F.col("c_custkey") % 16)))
        .alias("monitor_profile_id"),
        F.when(F.col("c_custkey") % 3 == 0, "US").otherwise("TW").alias("market"), F.col("c_custkey").alias("seq"))
    rows = o.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("full_universe_count"),
        F.to_date("o_orderdate").alias("trading_date")).withColumn(
        "market", F.when((k % 11 == 0) & (F.col("full_universe_count") % 2 == 0), "HK")
        .when(k % 3 == 0, "US").otherwise("TW"))
    folder = f"{shared_dir(spark)}/observations-{uuid.uuid4().hex}"
    ob.store_observations(folder, runs, rows, order="full_universe_count")
    odd = k % 2 == 1
    ob.store_observations(folder, runs.where(odd), rows.where(odd), order="full_universe_count")
    return present(ob.stored_observations(spark, folder))
