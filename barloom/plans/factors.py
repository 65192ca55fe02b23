"""Queries: external signals, factors, clusters' frames and peers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.operators import factors as fa, splits as sp, universe as un
from barloom.plans.catalog import query
from barloom.plans.inputs import brand_bars, sql, universe_of
from barloom.plans.tradability import BUNI, PROFILES_SQL, brand_life, corp_sql, life_sql
from barloom.sources.tables import company_profiles, corporate_events, one_market, table

_SRC = {**BUNI, "life": life_sql(25), "corp": corp_sql(25), "prof": PROFILES_SQL}
_Z = "CAST(date AS VARCHAR) AS date"


def profiles(spark, d):
    return company_profiles(spark, d, universe_of(spark, d))


def brand_events(spark, d):
    return corporate_events(spark, d, universe_of(spark, d), 25)


_UNION = """SELECT 'company_profile' AS source_record_type, symbol, listing_date AS effective_date,
    listing_date + INTERVAL 1 HOUR AS available_at, 'fallback' AS availability_mode FROM prof
  UNION ALL SELECT 'lifecycle_record', symbol, effective_date, effective_date + INTERVAL 1 HOUR, 'fallback' FROM life
  UNION ALL SELECT 'important_event', symbol, effective_date, publication_ts, 'exact' FROM corp"""


@query("external_signal_union", sql("", """SELECT source_record_type, symbol, CAST(effective_date AS VARCHAR) AS effective_date,
    strftime(available_at, '%Y-%m-%d %H:%M:%S') AS available_at, availability_mode FROM u
    WHERE effective_date BETWEEN DATE '1995-06-01' AND DATE '1999-06-01'""", **_SRC, u=_UNION))
def _(spark, d):
    out = fa.external_signal_union(profiles(spark, d), brand_life(spark, d), brand_events(spark, d),
                                   start="1995-06-01", end="1999-06-01")
    return present(out.drop("market"))


def cells(spark, d):
    return brand_bars(spark, d).select("symbol", "date")


_AGE = """SELECT symbol, date, 'company_listing_age_days_v1' AS factor_id, (date - listing_date) * 1e0 AS value,
    listing_date + INTERVAL 1 HOUR AS ts_at FROM bars LEFT JOIN prof USING (symbol)"""
_CNT = """SELECT b.symbol, b.date, 'important_event_count_30d_v1' AS factor_id, count(c.id) * 1e0 AS value,
    max(publication_ts) AS ts_at FROM bars b LEFT JOIN corp c ON c.symbol = b.symbol
    AND CAST(publication_ts AS DATE) BETWEEN b.date - 30 AND b.date GROUP BY 1, 2"""
_TRN = """SELECT b.symbol, b.date, 'lifecycle_transition_count_365d_v1' AS factor_id, count(c.id) * 1e0 AS value,
    coalesce(max(effective_date), b.date) + INTERVAL 1 HOUR AS ts_at FROM bars b LEFT JOIN life c ON c.symbol = b.symbol
    AND effective_date BETWEEN b.date - 365 AND b.date GROUP BY 1, 2"""
_FOUT = f"SELECT symbol, {_Z}, value, strftime(ts_at, '%Y-%m-%d %H:%M:%S') AS source_available_at FROM f"


def _slim(df):
    return present(df.select("symbol", "date", "value", "source_available_at"))


@query("factor_listing_age", sql("bars", _FOUT, **_SRC, f=_AGE))
def _(spark, d):
    return _slim(fa.factor_listing_age(cells(spark, d), profiles(spark, d)))


@query("factor_event_count_30d", sql("bars", _FOUT, **_SRC, f=_CNT))
def _(spark, d):
    return _slim(fa.factor_event_count_30d(cells(spark, d), brand_events(spark, d)))


@query("factor_transition_count_365d", sql("bars", _FOUT, **_SRC, f=_TRN))
def _(spark, d):
    return _slim(fa.factor_transition_count_365d(cells(spark, d), brand_life(spark, d)))


def panel(spark, d):
    return fa.factor_panel(cells(spark, d), profiles(spark, d), brand_events(spark, d),
                           brand_life(spark, d))


_ALL = {**_SRC, "f1": _AGE, "f2": _CNT, "f3": _TRN,
        "f": "SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3"}


@query("factor_panel", sql("bars", f"""SELECT symbol, {_Z}, factor_id, value,
    strftime(ts_at, '%Y-%m-%d %H:%M:%S') AS source_available_at,
    strftime(date + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS factor_available_ts,
    CASE WHEN factor_id LIKE 'company%' AND ts_at IS NULL THEN 'unresolved'
      WHEN factor_id LIKE 'important%' AND ts_at IS NOT NULL THEN 'exact' ELSE 'fallback' END AS availability_mode FROM f""", **_ALL))
def _(spark, d):
    return present(panel(spark, d))


@query("factor_panel_wide", sql("bars", f"""SELECT symbol, {_Z}, max(value) FILTER (factor_id LIKE 'company%') AS age,
    max(value) FILTER (factor_id LIKE 'important%') AS events, max(value) FILTER (factor_id LIKE 'lifecycle%') AS transitions
    FROM f GROUP BY symbol, date""", **_ALL))
def _(spark, d):
    wide = fa.factor_wide(panel(spark, d))
    return present(wide.select("symbol", "date", F.col(fa.LISTING_AGE).alias("age"),
                               F.col(fa.EVENT_COUNT).alias("events"),
                               F.col(fa.TRANSITION_COUNT).alias("transitions")))


@query("factor_usability", sql("bars", f"""SELECT {_Z}, factor_id, round(count(value) / count(*)::DOUBLE, 6) AS coverage_ratio,
    round(max(epoch_us(date + INTERVAL 330 MINUTE) - epoch_us(ts_at)) FILTER (value IS NOT NULL) / 3600e6, 6) AS latency_hours,
    CASE WHEN count(value) > 0 THEN 'usable' ELSE 'insufficient_sample' END AS status FROM f GROUP BY date, factor_id""", **_ALL))
def _(spark, d):
    return present(fa.factor_usability(panel(spark, d)))


@query("factor_catalog_check", """SELECT catalog_id, factor_id, issue FROM (
    SELECT c_custkey AS catalog_id, fid AS factor_id, CASE WHEN c_nationkey % 2 = 0 AND fid = 'other_v1' THEN 'unsupported scoring factor'
      WHEN c_nationkey % 2 = 0 AND c_custkey % 4 = 0 THEN 'incomplete scoring entry' END AS issue
    FROM customer, (SELECT unnest(['company_listing_age_days_v1', 'important_event_count_30d_v1', 'lifecycle_transition_count_365d_v1', 'other_v1']) AS fid)
    WHERE (c_custkey + length(fid)) % 3 <> 0) WHERE issue IS NOT NULL
  UNION ALL SELECT c_custkey, 'important_event_count_30d_v1', 'undeclared factor' FROM customer
    WHERE c_custkey % 5 = 0 AND (c_custkey + length('important_event_count_30d_v1')) % 3 = 0""")
def _(spark, d):
    c = table(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    entries = c.select(k.alias("catalog_id"), F.explode(F.array(
        *[F.lit(f) for f in (*fa.FACTORS, "other_v1")])).alias("factor_id"),
        (n % 2 == 0).alias("scoring_eligible"), F.when(k % 4 != 0, "l").otherwise("").alias("lineage"),
        F.lit("t").alias("timing_semantics"), F.lit("m").alias("missing_value_policy")
    ).where((F.col("catalog_id") + F.length("factor_id")) % 3 != 0)
    requested = c.where(k % 5 == 0).select(k.alias("catalog_id"), F.lit(fa.EVENT_COUNT).alias("factor_id"))
    return fa.factor_catalog_check(entries, requested)


_ACT = """SELECT symbol, date, NOT coalesce(date < listing_date, false) AND (n = 0 OR coalesce(last, '') = 'listing') AS active
    FROM (SELECT b.symbol, b.date, any_value(p.listing_date) AS listing_date, count(l.id) AS n,
        arg_max(l.event_type, row(l.effective_date, l.id)) FILTER (l.event_type <> 'ticker_change') AS last
      FROM bars b LEFT JOIN prof p USING (symbol)
      LEFT JOIN life l ON l.symbol = b.symbol AND l.effective_date <= b.date GROUP BY 1, 2)"""
FRAME_SQL = {
    "act": _ACT,
    "fr": """SELECT b.date, b.symbol, any_value(b.close) AS close, any_value(b.volume) * 1e0 AS volume, count(c.id) * 1e0 AS event_count_30d
      FROM bars b JOIN act a ON a.symbol = b.symbol AND a.date = b.date AND a.active
      LEFT JOIN corp c ON c.symbol = b.symbol AND c.effective_date <= b.date AND CAST(publication_ts AS DATE) >= b.date - 30
      GROUP BY 1, 2"""}


def cluster_rows(spark, d):
    bars = brand_bars(spark, d).withColumn("market", one_market("symbol")).select(
        "market", "date", "symbol", "close", "volume")
    active = un.active_asof_fold(bars, profiles(spark, d), brand_life(spark, d))
    return fa.cluster_frame(bars, active, brand_events(spark, d))


@query("cluster_frame", sql("bars", f"""SELECT {_Z}, symbol, round(close, 6) AS close, volume, event_count_30d
    FROM fr WHERE date IN (SELECT date FROM fr GROUP BY 1 HAVING count(*) >= 2)""", **_SRC, **FRAME_SQL))
def _(spark, d):
    return present(cluster_rows(spark, d).drop("market"))


def memberships(spark, d):
    """Supplier accounts as cluster members: snapshot by nation, cluster by key."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_nationkey").alias("snapshot_id"), (F.col("s_suppkey") % 2).alias("cluster"),
                    F.col("s_suppkey").alias("symbol"), F.abs("s_acctbal").alias("distance"))


_PEERS = """SELECT snapshot_id, cluster, symbol, list(p ORDER BY pd, p)[1:3] AS peers FROM (
    SELECT a.s_nationkey AS snapshot_id, a.s_suppkey % 2 AS cluster, a.s_suppkey AS symbol, b.s_suppkey AS p, abs(b.s_acctbal) AS pd
    FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey % 2 = b.s_suppkey % 2
      AND a.s_suppkey <> b.s_suppkey) GROUP BY 1, 2, 3"""


@query("peer_overlay", sql("", """SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id, cluster, symbol,
    CAST(len(list_filter(peers, lambda x: x IS NOT NULL)) AS BIGINT) AS peer_count,
    array_to_string(list_filter(peers, lambda x: x IS NOT NULL), ',') AS peers,
    len(list_filter(peers, lambda x: x IS NOT NULL)) = 0 AS warning FROM pe""", pe=_PEERS))
def _(spark, d):
    return present(fa.peer_overlay(memberships(spark, d), limit=3))


@query("peer_feature_timeline", """SELECT sym AS symbol, d AS date, arg_max(n, snap) AS peer_symbol_count, arg_max(n, snap) AS peer_feature_value FROM (
    SELECT s_suppkey % 40 AS sym, CAST(DATE '2000-01-01' + CAST(s_nationkey % 5 AS INTEGER) AS VARCHAR) AS d, s_nationkey AS snap,
      max(least(c - 1, 5)) * 1e0 AS n FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(spark, d):
    m = memberships(spark, d).withColumn("cluster", F.lit(0))
    over = fa.peer_overlay(m, limit=5).withColumn("symbol", F.col("symbol") % 40)
    snaps = table(spark, d, "nation").select(F.col("n_nationkey").alias("snapshot_id"), F.date_add(
        F.lit("2000-01-01").cast("date"), F.col("n_nationkey") % 5).alias("date"))
    return present(fa.peer_feature_timeline(over, snaps))


def audit_signals(spark, d):
    out = brand_events(spark, d).select(
        "id", F.lit("fam").alias("source_family"), (F.col("id") % 3).cast("string").alias("market"),
        F.to_date("publication_ts").alias("effective_date"),
        F.when(F.col("id") % 4 == 0, "fallback").otherwise("exact").alias("availability_mode"))
    return out


_AUD = {"au": """SELECT id, CAST(id % 3 AS VARCHAR) AS market, CAST(publication_ts AS DATE) AS day, id % 4 = 0 AS fb FROM corp""",
        "a1": """SELECT *, count(*) OVER (PARTITION BY market) AS n, fb AND row_number() OVER (PARTITION BY market, fb ORDER BY day, id) <= 20 AS early FROM au""",
        "a2": """SELECT *, row_number() OVER (PARTITION BY market ORDER BY early DESC, day, id) AS rk,
          least(n, greatest(50, CAST(ceil(n * 0.05e0) AS BIGINT))) AS target FROM a1"""}


@query("audit_sample", sql("", """SELECT market, id, CASE WHEN early THEN 'fallback_first' ELSE 'fill' END AS reason
    FROM a2 WHERE rk <= target""", **_SRC, **_AUD))
def _(spark, d):
    return sp.audit_sample(audit_signals(spark, d)).select("market", "id", "reason")
