"""Queries: windowed features, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.operators import features as ft, splits as sp
from barloom.plans.catalog import query
from barloom.plans.inputs import (SCORES, TYPE_REQ, brand_bars, scored_bars, sql, type_bars,
                                  type_requests)
from barloom.sources.tables import one_market, table

_S = "PARTITION BY symbol ORDER BY date"
_OUT = "SELECT symbol, CAST(date AS VARCHAR) AS date, round(value, 6) AS value FROM v"


def _rows(w):
    return f"({_S} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _value(expr):
    return sql("bars", _OUT, v=f"SELECT symbol, date, {expr} AS value FROM bars")


@query("feature_ma", _value(
    f"CASE WHEN count(*) OVER {_rows(20)} = 20 THEN avg(close) OVER {_rows(20)} END"))
def _(spark, d):
    return present(ft.feature_ma(brand_bars(spark, d), window=20))


@query("feature_ema", sql("bars", _OUT, n=f"""SELECT symbol, date, close,
      row_number() OVER ({_S}) - 1 AS i FROM bars""",
    v="""SELECT a.symbol, a.date, CASE WHEN any_value(a.i) >= 4 THEN
      sum(b.close * pow(2e0/3e0, a.i - b.i) * CASE WHEN b.i = 0 THEN 1e0 ELSE 1e0/3e0 END) END AS value
    FROM n a JOIN n b ON a.symbol = b.symbol AND b.i <= a.i AND b.i >= a.i - 110 GROUP BY 1, 2"""))
def _(spark, d):
    return present(ft.feature_ema(brand_bars(spark, d), window=5))


@query("feature_rsi", sql("bars", _OUT,
    s=f"SELECT symbol, date, close - lag(close) OVER ({_S}) AS d FROM bars",
    u=f"""SELECT symbol, date, count(d) OVER {_rows(14)} AS n,
      avg(greatest(d, 0)) OVER {_rows(14)} AS up, avg(greatest(-d, 0)) OVER {_rows(14)} AS dn FROM s""",
    v="""SELECT symbol, date, CASE WHEN n < 14 OR (up = 0 AND dn = 0) THEN NULL WHEN dn = 0 THEN 100e0
      ELSE 100e0 - 100e0 / (1 + up / dn) END AS value FROM u"""))
def _(spark, d):
    return present(ft.feature_rsi(brand_bars(spark, d), window=14))


@query("feature_roc", _value(f"close / lag(close, 10) OVER ({_S}) - 1"))
def _(spark, d):
    return present(ft.feature_roc(brand_bars(spark, d), window=10))


@query("feature_volatility", sql("bars", _OUT,
    s=f"SELECT symbol, date, close / lag(close) OVER ({_S}) - 1 AS r FROM bars",
    v=f"""SELECT symbol, date, CASE WHEN count(r) OVER {_rows(20)} = 20
      THEN stddev_samp(r) OVER {_rows(20)} * sqrt(252e0) END AS value FROM s"""))
def _(spark, d):
    return present(ft.feature_volatility(brand_bars(spark, d), window=20))


@query("feature_zscore", sql("bars zs",
    "SELECT symbol, CAST(date AS VARCHAR) AS date, round(z0, 6) AS value FROM zs"))
def _(spark, d):
    return present(ft.feature_zscore(brand_bars(spark, d), window=20))


SPECS = (ft.Feature("ma", 5, shift=1), ft.Feature("ma", 20, "open", 1), ft.Feature("roc", 10, shift=1),
         ft.Feature("zscore", 20, shift=2), ft.Feature("volatility", 10, "high", 1))

_FEATURES = {
    "s1": f"SELECT *, high / lag(high) OVER ({_S}) - 1 AS r FROM bars",
    "s2": f"""SELECT *, CASE WHEN count(*) OVER {_rows(5)} = 5 THEN avg(close) OVER {_rows(5)} END AS a,
      CASE WHEN count(*) OVER {_rows(20)} = 20 THEN avg(open) OVER {_rows(20)} END AS b,
      close / lag(close, 10) OVER ({_S}) - 1 AS c,
      CASE WHEN count(*) OVER {_rows(20)} = 20 THEN (close - avg(close) OVER {_rows(20)})
        / nullif(stddev_samp(close) OVER {_rows(20)}, 0) END AS z,
      CASE WHEN count(r) OVER {_rows(10)} = 10 THEN stddev_samp(r) OVER {_rows(10)} * sqrt(252e0) END AS v
      FROM s1""",
    "fs": f"""SELECT symbol, date, open, close, lag(a) OVER ({_S}) AS ma_5, lag(b) OVER ({_S}) AS ma_20_open,
      lag(c) OVER ({_S}) AS roc_10, lag(z, 2) OVER ({_S}) AS zscore_20,
      lag(v) OVER ({_S}) AS volatility_10_high FROM s2""",
}
_FCOLS = ("ma_5", "ma_20_open", "roc_10", "zscore_20", "volatility_10_high")
_FOUT = ", ".join(f"round({c}, 6) AS {c}" for c in _FCOLS)


def feature_frame(spark, d):
    wide = ft.feature_set(brand_bars(spark, d), SPECS, keep=("open", "close"))
    return wide.select("symbol", "date", "open", "close",
                       *[F.col(c.upper() if "_" not in c[-5:] else c).alias(c.lower())
                         for c in [s.column for s in SPECS]])


@query("feature_set", sql("bars", f"SELECT symbol, CAST(date AS VARCHAR) AS date, {_FOUT} FROM fs",
                          **_FEATURES))
def _(spark, d):
    return present(feature_frame(spark, d).select("symbol", "date", *_FCOLS))


@query("feature_shift", sql("bars",
    f"""SELECT symbol, CAST(date AS VARCHAR) AS date, round(lag(close, 1) OVER ({_S}), 6) AS close,
      lag(volume, 3) OVER ({_S}) * 1e0 AS volume FROM bars"""))
def _(spark, d):
    bars = brand_bars(spark, d).select("symbol", "date", "close",
                                       F.col("volume").cast("double").alias("volume"))
    return present(ft.feature_shift(bars, {"close": 1, "volume": 3}))


_REG_SQL = []
for _n, _w in ft.DEFAULT_WINDOWS.items():
    for _src in ft.SOURCES:
        # bars with a full window; a price never repeats a whole window here
        _need = {"ma": _w, "ema": _w, "rsi": _w + 1, "roc": _w + 1, "volatility": _w + 1,
                 "zscore": _w}[_n]
        _REG_SQL.append(f"SELECT '{_n}' AS name, '{_src}' AS source, "
                        f"CAST({_w} AS BIGINT) AS default_window, "
                        f"CAST(sum(CASE WHEN i >= {_need} THEN 1 ELSE 0 END) AS BIGINT) AS n_values FROM n")


@query("feature_registry", sql("bars", " UNION ALL ".join(_REG_SQL),
                               n=f"SELECT row_number() OVER ({_S}) AS i FROM bars"))
def _(spark, d):
    return ft.feature_registry_coverage(brand_bars(spark, d), ft.feature_registry(spark))


def _label_sql(num, den, ahead):
    return sql("bars", f"""SELECT symbol, CAST(date AS VARCHAR) AS date,
      round(lead({num}, {ahead}) OVER ({_S}) / {den} - 1, 6) AS target FROM bars""")


for _t, (_num, _den, _h) in {"open_to_open": ("open", "open", 1),
                             "close_to_close": ("close", "close", 3),
                             "open_to_close": ("close", "open", 2)}.items():
    def _label(spark, d, t=_t, h=_h):
        out = ft.forward_return_label(brand_bars(spark, d), target=t, horizon=h)
        return present(out.select("symbol", "date", "target"))
    query("forward_return_label" + ("" if _t == "open_to_open" else f"_{_t}"),
          _label_sql(_num, _den, ft.label_lookahead(_t, _h)))(_label)


_TRAIN = {**_FEATURES,
          "tf": f"""SELECT * FROM (SELECT *, lead(open) OVER ({_S}) / open - 1 AS target FROM fs)
            WHERE target IS NOT NULL AND """ + " AND ".join(f"{c} IS NOT NULL" for c in _FCOLS)}


def labelled_frame(spark, d):
    return ft.training_frame(ft.forward_return_label(feature_frame(spark, d)), _FCOLS)


@query("training_frame", sql("bars", f"""SELECT symbol, CAST(date AS VARCHAR) AS date, {_FOUT},
    round(target, 6) AS target FROM tf""", **_TRAIN))
def _(spark, d):
    return present(labelled_frame(spark, d).select("symbol", "date", *_FCOLS, "target"))


def peer_snapshots(spark, d):
    """A value per (brand, date) from orders."""
    o = table(spark, d, "orders")
    return o.groupBy(F.concat(F.lit("Brand#"), F.col("o_custkey") % 25 + 1).alias("symbol"),
                     F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("peer_count"))


_PEER_SNAP = """SELECT 'Brand#' || (o_custkey % 25 + 1) AS symbol, CAST(o_orderdate AS DATE) AS date,
  CAST(count(*) AS DOUBLE) AS peer_count FROM orders GROUP BY 1, 2"""


@query("attach_peer_features", sql("bars", f"""SELECT symbol, CAST(date AS VARCHAR) AS date,
    coalesce(last_value(peer_count IGNORE NULLS) OVER ({_S}), 0) AS peer_count
    FROM bars LEFT JOIN snap USING (symbol, date)""", snap=_PEER_SNAP))
def _(spark, d):
    return present(ft.attach_peer_features(
        brand_bars(spark, d).select("symbol", "date"), peer_snapshots(spark, d), ["peer_count"]))


@query("attach_peer_features_asof", sql("bars", """SELECT b.symbol, CAST(b.date AS VARCHAR) AS date,
    coalesce(s.peer_count, 0) AS peer_count
    FROM bars b ASOF LEFT JOIN snap s ON b.symbol = s.symbol AND s.date <= b.date""", snap=_PEER_SNAP))
def _(spark, d):
    return present(ft.attach_peer_features(
        brand_bars(spark, d).select("symbol", "date"), peer_snapshots(spark, d), ["peer_count"],
        as_of=True))


@query("ffill_panel", sql("bars cal", """SELECT symbol, CAST(date AS VARCHAR) AS date,
    round(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), 6) AS close
    FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN cal LEFT JOIN bars USING (symbol, date)"""))
def _(spark, d):
    from barloom.functions.panel import panel
    bars = brand_bars(spark, d).withColumn("market", one_market("symbol"))
    cal = sp.trading_calendar(bars)
    cells = panel(bars.select("market", "symbol").distinct(), cal).select("symbol", "date")
    return present(ft.ffill_panel(cells, bars, ["close"]))


@query("trading_calendar", sql("bars cal",
    "SELECT 'TW' AS market, CAST(date AS VARCHAR) AS date, idx FROM cal"))
def _(spark, d):
    return present(sp.trading_calendar(brand_bars(spark, d).withColumn("market", one_market("symbol"))))


@query("holdout_split", sql("bars", """SELECT symbol, CAST(date AS VARCHAR) AS date,
    CASE WHEN s - 3 <= 0 OR s >= n THEN NULL WHEN i < s - 3 THEN 'train'
         WHEN i < s THEN 'purged' ELSE 'test' END AS role
    FROM (SELECT *, CAST(floor(n * (1 - 0.2e0)) AS BIGINT) AS s FROM p)""",
    p="""SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
      count(*) OVER (PARTITION BY symbol) AS n FROM bars"""))
def _(spark, d):
    bars = brand_bars(spark, d).select("symbol", "date")
    return present(sp.holdout_split(bars, test_size=0.2, purge=3))


def _folds_sql(method, splits, purge):
    start = "f * t" if method == "rolling_window" else "0"
    return sql("bars cal", f"""SELECT 'TW' AS market, CAST(f AS BIGINT) AS fold,
      CAST(date AS VARCHAR) AS date,
      CASE WHEN idx < n - t * {splits} + f * t - {purge} THEN 'train' ELSE 'test' END AS role
    FROM cal CROSS JOIN (SELECT count(*) AS n, CAST(floor(count(*) * 0.1e0) AS BIGINT) AS t FROM cal)
      CROSS JOIN range({splits}) AS r(f)
    WHERE (idx >= {start} AND idx < n - t * {splits} + f * t - {purge})
       OR (idx >= n - t * {splits} + f * t AND idx < n - t * {splits} + (f + 1) * t)""")


for _m, _k in (("holdout", 1), ("walk_forward", 4), ("expanding_window", 3), ("rolling_window", 4)):
    def _fold(spark, d, m=_m, k=_k):
        cal = sp.trading_calendar(brand_bars(spark, d).withColumn("market", one_market("symbol")))
        return present(sp.fold_assignment(cal, method=m, splits=k, test_size=0.1, purge=2))
    query("fold_assignment" + ("" if _m == "walk_forward" else f"_{_m}"),
          _folds_sql(_m, _k, 2))(_fold)


@query("common_dates", sql("tbars", """SELECT run_id, CAST(date AS VARCHAR) AS date
    FROM tbars JOIN treq USING (symbol) JOIN (SELECT run_id, count(*) AS need FROM treq GROUP BY 1)
    USING (run_id) GROUP BY run_id, date HAVING count(*) = any_value(need)""", **TYPE_REQ))
def _(spark, d):
    return present(sp.common_dates(type_bars(spark, d), type_requests(spark, d)))


@query("calibration_split", sql(SCORES, """SELECT symbol, CAST(date AS VARCHAR) AS date,
    CASE WHEN reason IS NULL THEN part END AS part, reason
  FROM (SELECT *, CASE WHEN st - 2 < 20 THEN 'insufficient_rows'
      WHEN least(sum(CASE WHEN part='base' AND up=1 THEN 1 ELSE 0 END) OVER g,
                 sum(CASE WHEN part='base' AND up=0 THEN 1 ELSE 0 END) OVER g) < 5 THEN 'base_class_support'
      WHEN least(sum(CASE WHEN part='calibration' AND up=1 THEN 1 ELSE 0 END) OVER g,
                 sum(CASE WHEN part='calibration' AND up=0 THEN 1 ELSE 0 END) OVER g) < 5
        THEN 'calibration_class_support' END AS reason
    FROM c2 WINDOW g AS (PARTITION BY symbol))""",
    c0="""SELECT symbol, date, close, CASE WHEN close > open THEN 1 ELSE 0 END AS up,
      row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
      count(*) OVER (PARTITION BY symbol) AS n FROM scored WHERE score IS NOT NULL""",
    c1="SELECT *, n - greatest(20, CAST(floor(n * 0.2e0) AS BIGINT)) AS st FROM c0",
    c2="""SELECT *, CASE WHEN i < st - 2 THEN 'base' WHEN i < st THEN 'purged'
      ELSE 'calibration' END AS part FROM c1"""))
def _(spark, d):
    frame = scored_bars(spark, d).where("score IS NOT NULL").select(
        "symbol", "date", (F.col("close") > F.col("open")).cast("int").alias("up"))
    return present(sp.calibration_split(frame, label="up", keys=["symbol"], purge=2).drop("up"))


@query("bounded_diagnostic_sample", sql(SCORES, """SELECT symbol, CAST(date AS VARCHAR) AS date,
    round(score, 6) AS score FROM scored WHERE score IS NOT NULL
    ORDER BY date DESC, symbol DESC LIMIT 200""".replace("CAST(date AS VARCHAR) AS date",
                                                         "CAST(scored.date AS VARCHAR) AS date")
    .replace("ORDER BY date", "ORDER BY scored.date")))
def _(spark, d):
    points = scored_bars(spark, d).where("score IS NOT NULL").select("symbol", "date", "score")
    return present(sp.bounded_diagnostic_sample(points))
