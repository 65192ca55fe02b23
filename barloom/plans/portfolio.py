"""Queries: selection, weights, returns and portfolio metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.functions.panel import panel
from barloom.operators import portfolio as pf
from barloom.operators.splits import trading_calendar
from barloom.plans.catalog import query
from barloom.plans.inputs import (EQUITY_SQL, RUN_SCORES, WEIGHTS, brand_bars, run_requests, run_scores,
                                  run_weights, sql)
from barloom.sources.tables import one_market, table

OHLC = ("open", "high", "low", "close")
_KEY = "run_id, CAST(date AS VARCHAR) AS date, symbol"
_GRID = WEIGHTS + " grid px"
_EQ = _GRID + " pret eq"


@query("topn_weights", sql(WEIGHTS, f"SELECT {_KEY}, round(weight, 6) AS weight FROM w"))
def _(spark, d):
    return present(run_weights(spark, d))


@query("hold_weights", sql(RUN_SCORES, f"""SELECT {_KEY}, round(CASE WHEN kept THEN 1e0 /
      sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, date) ELSE 0 END, 6) AS weight
    FROM (SELECT run_id, date, symbol, h.kept IS NOT NULL AS kept FROM rscored
      FULL JOIN (SELECT run_id, date, symbol, true AS kept FROM (SELECT DISTINCT run_id, date FROM rscored)
        JOIN buy USING (run_id) WHERE date >= first) h USING (run_id, date, symbol))""",
    buy="""SELECT run_id, symbol, min(date) AS first FROM (SELECT *, row_number() OVER (PARTITION BY run_id, date
              ORDER BY ok DESC, score DESC NULLS LAST, position) AS rk
            FROM (SELECT *, coalesce(score >= 1.5e0, false) AS ok FROM rscored))
      WHERE ok AND rk <= 2 GROUP BY 1, 2"""))
def _(spark, d):
    return present(pf.hold_weights(run_scores(spark, d), threshold=1.5, top_n=2))


@query("market_cost_defaults", """SELECT c_custkey, market,
    CASE WHEN upper(market) = 'US' THEN 0.0005e0 ELSE 0.002e0 END AS fees,
    CASE WHEN upper(market) = 'US' THEN 0.0005e0 ELSE 0.001e0 END AS slippage
  FROM (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'TW' WHEN 1 THEN 'us' WHEN 2 THEN 'JP' END AS market
        FROM customer)""")
def _(spark, d):
    m = F.col("c_nationkey") % 4
    runs = table(spark, d, "customer").select(
        "c_custkey", F.when(m == 0, "TW").when(m == 1, "us").when(m == 2, "JP").alias("market"))
    return present(pf.market_cost_defaults(runs))


@query("resolve_strategy", """SELECT c_custkey, issue,
    CASE WHEN issue IS NULL THEN round(coalesce(threshold, 0.01e0), 6) END AS eff_threshold,
    CASE WHEN issue IS NULL THEN coalesce(top_n, 10) * 1e0 END AS eff_top_n,
    CASE WHEN threshold IS NULL THEN 'spec_default' ELSE 'request_override' END AS threshold_source,
    CASE WHEN top_n IS NULL THEN 'spec_default' ELSE 'request_override' END AS top_n_source
  FROM (SELECT *, CASE WHEN runtime_mode NOT IN ('vnext_spec_mode', 'runtime_compatibility_mode') THEN 'unsupported_mode'
      WHEN bundle <> 'research_spec_v1' THEN 'unsupported_bundle'
      WHEN runtime_mode = 'runtime_compatibility_mode' AND threshold IS NULL THEN 'threshold_required'
      WHEN runtime_mode = 'runtime_compatibility_mode' AND top_n IS NULL THEN 'top_n_required'
      WHEN runtime_mode = 'vnext_spec_mode' AND (threshold IS NULL OR top_n IS NULL) AND bundle IS NULL
        THEN 'bundle_required' END AS issue
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'other'
            WHEN c_custkey % 2 = 0 THEN 'vnext_spec_mode' ELSE 'runtime_compatibility_mode' END AS runtime_mode,
          CASE c_custkey % 3 WHEN 0 THEN 'research_spec_v1' WHEN 1 THEN NULL
            ELSE CASE WHEN c_custkey % 5 = 0 THEN 'spec_v0' ELSE 'research_spec_v1' END END AS bundle,
          CASE WHEN c_nationkey % 3 <> 0 THEN c_acctbal / 99733e0 END AS threshold,
          CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END AS top_n FROM customer))""")
def _(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    runs = table(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 11 == 0, "other").when(k % 2 == 0, "vnext_spec_mode")
        .otherwise("runtime_compatibility_mode").alias("runtime_mode"),
        F.when(k % 3 == 0, "research_spec_v1")
        .when((k % 3 == 2) & (k % 5 == 0), "spec_v0")
        .when(k % 3 == 2, "research_spec_v1").alias("default_bundle_version"),
        F.when(n % 3 != 0, F.col("c_acctbal") / 99733.0).alias("threshold"),
        F.when(n % 4 != 0, n).alias("top_n"))
    out = pf.resolve_strategy(runs).withColumn("eff_top_n", F.col("eff_top_n").cast("double"))
    return present(out.select("c_custkey", "issue", "eff_threshold", "eff_top_n",
                              "threshold_source", "top_n_source"))


def _panel(spark, d):
    """The brand panel of a run: every requested symbol on every date."""
    bars = brand_bars(spark, d).withColumn("market", one_market("symbol"))
    symbols = run_requests(spark, d).select("run_id", "symbol", one_market("symbol").alias("market"))
    cells = panel(symbols, trading_calendar(bars)).select("run_id", "symbol", "date")
    return cells.join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left")


_PANEL = {"pn": """SELECT run_id, symbol, date, close FROM (SELECT run_id, symbol FROM req)
  CROSS JOIN cal LEFT JOIN bars USING (symbol, date)"""}
_SER = "PARTITION BY run_id, symbol ORDER BY date"


@query("baseline_buy_hold", sql("bars uni req cal", f"""SELECT {_KEY},
    round(1e0 / count(*) OVER (PARTITION BY run_id, date), 6) AS weight FROM pn""", **_PANEL))
def _(spark, d):
    return present(pf.baseline_buy_hold(_panel(spark, d)))


@query("baseline_momentum", sql("bars uni req cal", f"""SELECT {_KEY},
    round(s * 1e0 / greatest(sum(s) OVER (PARTITION BY run_id, date), 1), 6) AS weight FROM m3""",
    **_PANEL, m1=f"SELECT *, last_value(close IGNORE NULLS) OVER ({_SER}) AS c FROM pn",
    m2=f"SELECT *, c / lag(c) OVER ({_SER}) - 1 AS r FROM m1",
    m3=f"SELECT *, CASE WHEN lag(r) OVER ({_SER}) > 0 THEN 1 ELSE 0 END AS s FROM m2"))
def _(spark, d):
    return present(pf.baseline_momentum(_panel(spark, d)))


@query("baseline_ma_cross", sql("bars uni req cal", f"""SELECT {_KEY},
    round(s * 1e0 / greatest(coalesce(sum(s) OVER (PARTITION BY run_id, date), 0), 1), 6) AS weight FROM m3""",
    **_PANEL, m1=f"""SELECT *, CASE WHEN count(close) OVER a = 2 THEN avg(close) OVER a END AS f,
      CASE WHEN count(close) OVER b = 6 THEN avg(close) OVER b END AS g FROM pn
      WINDOW a AS ({_SER} ROWS 1 PRECEDING), b AS ({_SER} ROWS 5 PRECEDING)""",
    m2="SELECT *, CASE WHEN f - g > 1e-12 * abs(g) THEN 1 ELSE 0 END AS x FROM m1",
    m3=f"SELECT *, lag(x) OVER ({_SER}) AS s FROM m2"))
def _(spark, d):
    return present(pf.baseline_ma_cross(_panel(spark, d), short=2, long=6))


_EXEC = """SELECT run_id, date, symbol, weight, weight - held AS delta, open, high, low, close,
  CASE WHEN weight > held THEN greatest(open, {buy}) WHEN weight < held THEN least(open, high)
       ELSE open END AS price FROM px"""


@query("execution_price", sql(_GRID, f"""SELECT {_KEY}, round(weight, 6) AS weight,
    round(delta, 6) AS delta, round(price, 6) AS price FROM e WHERE delta <> 0""",
    e=_EXEC.format(buy="low")))
def _(spark, d):
    out = pf.execution_price(run_weights(spark, d, OHLC), market="TW")
    return present(out.where("delta <> 0").select(
        "run_id", "date", "symbol", "weight", "delta", "price"))


@query("execution_price_checks", sql(_GRID, """SELECT run_id,
    max(open < low OR open > high) AS ohlc_out_of_range,
    CAST(sum(CASE WHEN delta > 0 AND price < close THEN 1 ELSE 0 END) AS BIGINT) AS buys_below_close
    FROM e WHERE open IS NOT NULL GROUP BY 1""", e=_EXEC.format(buy="low")))
def _(spark, d):
    # prices of the TW matching model checked against the US rule
    executed = pf.execution_price(run_weights(spark, d, OHLC), market="TW")
    return present(pf.execution_price_checks(executed, market="US"))


@query("turnover", sql(_GRID, """SELECT run_id, round(avg(t) / 2, 6) AS turnover FROM (
    SELECT run_id, date, sum(CASE WHEN idx > 0 THEN abs(weight - held) ELSE 0 END) AS t
    FROM px GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, d):
    return present(pf.turnover(run_weights(spark, d)))


@query("max_position_weight", sql(WEIGHTS,
    "SELECT run_id, round(max(abs(weight)), 6) AS max_position_weight FROM w GROUP BY 1"))
def _(spark, d):
    return present(pf.max_position_weight(run_weights(spark, d)))


def run_returns(spark, d):
    return pf.portfolio_returns(run_weights(spark, d, ("open",)), return_target="open_to_open",
                                fees=0.002, slippage=0.001)


@query("portfolio_returns", sql(_GRID + " pret", """SELECT run_id, CAST(date AS VARCHAR) AS date,
    round(gross, 6) + 0 AS gross, round(cost, 6) AS cost, round(ret, 6) + 0 AS ret FROM pret"""))
def _(spark, d):
    return present(run_returns(spark, d))


@query("equity_curve", sql(_GRID + " pret", """SELECT run_id, CAST(date AS VARCHAR) AS date,
    round(equity, 6) AS equity FROM eq2""", lost="""SELECT run_id, date, ret FROM pret UNION ALL
      SELECT 'lost', date, CASE WHEN month(date) = 6 AND day(date) % 9 = 8 THEN -1 ELSE ret END FROM pret WHERE run_id = 'run-0'""",
    eq2=EQUITY_SQL.format("lost")))
def _(spark, d):
    # besides, the first run with days on which everything is lost
    returns = run_returns(spark, d).select("run_id", "date", "ret")
    gone = (F.month("date") == 6) & (F.dayofmonth("date") % 9 == 8)
    lost = returns.where("run_id = 'run-0'").select(
        F.lit("lost").alias("run_id"), "date", F.when(gone, F.lit(-1.0)).otherwise(F.col("ret")).alias("ret"))
    return present(pf.equity_curve(returns.unionByName(lost)))


METRICS_SQL = {
    "st": """SELECT *, equity / lag(equity) OVER (PARTITION BY run_id ORDER BY date) - 1 AS r,
      equity / max(equity) OVER (PARTITION BY run_id ORDER BY date) - 1 AS dd FROM eq""",
    "met": """SELECT run_id, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return,
      coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252e0), 0) AS sharpe,
      min(dd) AS max_drawdown FROM st GROUP BY 1"""}
_MET = """round(total_return, 6) AS total_return, round(sharpe, 6) AS sharpe,
    round(max_drawdown, 6) AS max_drawdown"""


def run_metrics(spark, d):
    return pf.portfolio_metrics(pf.equity_curve(run_returns(spark, d)))


@query("portfolio_metrics", sql(_EQ, f"SELECT run_id, {_MET} FROM met", **METRICS_SQL))
def _(spark, d):
    return present(run_metrics(spark, d))


@query("metrics_finite_gate", sql("", """SELECT c_custkey, n_orders IS NOT NULL AND mean_total IS NOT NULL
      AND spread IS NOT NULL AS finite_metrics
    FROM (SELECT c_custkey, count(o_orderkey) AS n_orders, avg(o_totalprice) AS mean_total,
      stddev_samp(o_totalprice) AS spread FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)"""))
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey")
    m = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("n_orders"), F.avg("o_totalprice").alias("mean_total"),
        F.stddev_samp("o_totalprice").alias("spread"))
    return present(pf.metrics_finite_gate(m, ["n_orders", "mean_total", "spread"])
                   .select("c_custkey", "finite_metrics"))


@query("signal_rows", sql(WEIGHTS, f"""SELECT {_KEY}, round(score, 6) AS score,
    round(weight, 6) AS position, 'holdout_evaluation' AS signal_kind, round(p, 6) AS up_probability,
    CASE WHEN p >= 0.5 THEN 'up' WHEN p IS NOT NULL THEN 'down' END AS predicted_direction
    FROM w JOIN rscored USING (run_id, date, symbol)
    JOIN (SELECT run_id, max(date) AS last FROM w GROUP BY 1) USING (run_id)
    WHERE weight > 0 OR (date = last AND score IS NOT NULL)"""))
def _(spark, d):
    return present(pf.signal_rows(run_scores(spark, d), run_weights(spark, d), probabilities="p"))


@query("round_trip_net_return", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(CASE WHEN pos > 0 THEN pos * ((1 + r) * (1 - 0.001e0) / (1 + 0.001e0) * (1 - 0.002e0) * (1 - 0.002e0) - 1)
      ELSE 0 END, 6) AS net FROM (SELECT *, l_tax - 0.04e0 AS r, l_discount - 0.02e0 AS pos FROM lineitem)""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_tax") - 0.04).alias("r"), (F.col("l_discount") - 0.02).alias("pos"))
    net = pf.round_trip_net_return("r", "pos", fees=0.002, slippage=0.001)
    return present(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                net.alias("net")))


# Each region's run asks for all baselines but one, and for one that does not exist.
_ASKED = """SELECT 'run-' || r_regionkey AS run_id, unnest(list_filter(['buy_and_hold', 'naive_momentum', 'ma_crossover', 'none_such'],
    lambda b: (r_regionkey + length(b)) % 4 <> 1)) AS baseline FROM region"""
_BASE = {
    "asked": _ASKED,
    "fp": """SELECT run_id, date, symbol, last_value(b.open IGNORE NULLS) OVER s AS open, last_value(b.close IGNORE NULLS) OVER s AS close
      FROM (SELECT DISTINCT run_id, date FROM rscored) JOIN req USING (run_id) LEFT JOIN bars b USING (symbol, date)
      WINDOW s AS (PARTITION BY run_id, symbol ORDER BY date)""",
    "fs": """SELECT *, CASE WHEN count(close) OVER a = 5 THEN avg(close) OVER a END AS f5,
        CASE WHEN count(close) OVER b = 20 THEN avg(close) OVER b END AS f20, close / lag(close) OVER s - 1 AS r
      FROM fp WINDOW s AS (PARTITION BY run_id, symbol ORDER BY date),
        a AS (PARTITION BY run_id, symbol ORDER BY date ROWS 4 PRECEDING), b AS (PARTITION BY run_id, symbol ORDER BY date ROWS 19 PRECEDING)""",
    "fl": """SELECT *, CASE WHEN lag(r) OVER s > 0 THEN 1 ELSE 0 END AS up,
        CASE WHEN lag(date) OVER s IS NULL THEN NULL WHEN lag(f5 - f20 > 1e-12 * abs(f20)) OVER s THEN 1 ELSE 0 END AS above
      FROM fs WINDOW s AS (PARTITION BY run_id, symbol ORDER BY date)""",
    "wl": """SELECT run_id || '/' || baseline AS run_id, symbol, date, open, coalesce(CASE baseline WHEN 'buy_and_hold' THEN 1e0 / n
        WHEN 'naive_momentum' THEN up * 1e0 / greatest(ups, 1) ELSE above * 1e0 / greatest(coalesce(aboves, 0), 1) END, 0) AS weight
      FROM (SELECT *, count(*) OVER x AS n, sum(up) OVER x AS ups, sum(above) OVER x AS aboves FROM fl WINDOW x AS (PARTITION BY run_id, date))
      JOIN asked USING (run_id) WHERE baseline <> 'none_such'""",
    "bl": """SELECT *, coalesce(lag(weight) OVER s, 0e0) AS held, open / lag(open) OVER s - 1 AS move FROM wl
      WINDOW s AS (PARTITION BY run_id, symbol ORDER BY date)""",
    "bret": """SELECT run_id, date, sum(coalesce(held * move, 0)) - sum(abs(weight - held)) * 0.003e0 AS ret FROM bl GROUP BY 1, 2""",
    "beq": EQUITY_SQL.format("bret"),
    "bst": METRICS_SQL["st"].replace("FROM eq", "FROM beq"), "bmet": METRICS_SQL["met"].replace("FROM st", "FROM bst"),
}


def run_panel(spark, d):
    """Every requested symbol on each date its run has scores, with its prices if any."""
    dates = run_scores(spark, d).select("run_id", "date").distinct()
    cells = dates.join(run_requests(spark, d).select("run_id", "symbol"), "run_id")
    return cells.join(brand_bars(spark, d).select("symbol", "date", "open", "close"), ["symbol", "date"], "left")


def run_baselines(spark, d):
    names = F.array(*[F.lit(b) for b in (*pf.BASELINES, "none_such")])
    asked = table(spark, d, "region").select(F.concat(F.lit("run-"), "r_regionkey").alias("run_id"), F.explode(
        F.filter(names, lambda b: (F.col("r_regionkey") + F.length(b)) % 4 != 1)).alias("baseline"))
    return pf.baseline_metrics(run_panel(spark, d), asked, return_target="open_to_open", fees=0.002, slippage=0.001)


@query("baseline_metrics", sql(RUN_SCORES, f"""SELECT a.run_id, a.baseline, {_MET}, m.run_id IS NOT NULL AS evaluated
    FROM asked a LEFT JOIN bmet m ON m.run_id = a.run_id || '/' || a.baseline""", **_BASE))
def _(spark, d):
    return present(run_baselines(spark, d))


@query("baseline_comparison", sql(_EQ, """SELECT run_id, round(total_return, 6) AS total_return, best_baseline,
    round(best_return, 6) AS best_return, round(total_return - best_return, 6) + 0 AS delta,
    CASE WHEN best_return IS NULL THEN 'unavailable' WHEN total_return - best_return >= 0 THEN 'ahead' ELSE 'behind' END AS verdict
    FROM met LEFT JOIN (SELECT split_part(run_id, '/', 1) AS run_id, arg_max(split_part(run_id, '/', 2), total_return) AS best_baseline,
      max(total_return) AS best_return FROM bmet GROUP BY 1) USING (run_id)""", **METRICS_SQL, **_BASE))
def _(spark, d):
    judged = run_baselines(spark, d).where("evaluated")
    return present(pf.baseline_delta(run_metrics(spark, d), judged))


@query("baseline_delta", sql("", """SELECT run_id, round(total_return, 6) AS total_return, best_baseline,
    round(best_return, 6) AS best_return, round(total_return - best_return, 6) + 0 AS delta,
    CASE WHEN best_return IS NULL THEN 'unavailable' WHEN total_return - best_return >= 0 THEN 'ahead'
      ELSE 'behind' END AS verdict
    FROM runs LEFT JOIN (SELECT run_id, arg_max(baseline, ret) AS best_baseline, max(ret) AS best_return
      FROM base GROUP BY 1) USING (run_id)""",
    runs="SELECT c_custkey AS run_id, c_acctbal / 9973e0 AS total_return FROM customer",
    base="""SELECT o_custkey AS run_id, o_orderpriority AS baseline, sum(o_totalprice) / 1999993e0 AS ret
      FROM orders GROUP BY 1, 2"""))
def _(spark, d):
    runs = table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"), (F.col("c_acctbal") / 9973.0).alias("total_return"))
    base = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("baseline")).agg(
        (F.sum("o_totalprice") / 1999993.0).alias("total_return"))
    return present(pf.baseline_delta(runs, base))
