"""Queries: frozen signals, cohort metrics and opinions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.operators import prospective as pr
from barloom.operators.portfolio import topn_weights
from barloom.operators.splits import trading_calendar
from barloom.plans.catalog import query
from barloom.plans.inputs import SCORES, brand_bars, scored_bars, sql
from barloom.sources.shared import cut_lineage
from barloom.sources.tables import one_market, table

OFFICIAL = ("exchange_daily",)
_Z = "CAST(date AS VARCHAR) AS date"

# One frozen run per market date: the date's scored brands, top-5 positions.
_FROZEN = {
    "fz": """SELECT 'run-' || CAST(date AS VARCHAR) AS run_id, CASE WHEN idx % 2 = 0 THEN 'one' ELSE 'two' END AS cohort_id,
        date AS basis_date, symbol, 0.01e0 * score AS score, CASE WHEN (volume + idx) % 97 = 0 THEN 2 ELSE p END AS up_probability,
        CASE WHEN score >= 0.25e0 AND rk <= 5 THEN 1e0 / sum(CASE WHEN score >= 0.25e0 AND rk <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY date) ELSE 0 END AS position
      FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score >= 0.25e0 DESC, score DESC, position) AS rk
        FROM scored JOIN cal USING (date) WHERE score IS NOT NULL)""",
    "nx": """SELECT upper(symbol) AS sym, date, source, open, symbol,
        row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars""",
    "oc0": """SELECT f.*, (SELECT min(n.i) FROM nx n WHERE n.symbol = f.symbol AND n.date > f.basis_date) AS i1,
        (SELECT max(n.source) FROM nx n WHERE n.symbol = f.symbol AND n.date = f.basis_date) AS src0 FROM fz f""",
    "oc": """SELECT o.*, CASE WHEN b.date IS NULL THEN 'not_ready'
          WHEN NOT coalesce(src0 = 'exchange_daily' AND a.source = 'exchange_daily' AND b.source = 'exchange_daily', false) THEN 'not_ready'
          WHEN up_probability > 1 THEN 'invalid_signal' ELSE 'resolved' END AS status,
        CASE WHEN b.date IS NOT NULL AND NOT coalesce(src0 = 'exchange_daily' AND a.source = 'exchange_daily' AND b.source = 'exchange_daily', false)
          THEN 'official_outcomes_unavailable' END AS reason, a.date AS d1, b.date AS d2, b.open / a.open - 1 AS r
      FROM oc0 o LEFT JOIN nx a ON a.symbol = o.symbol AND a.i = i1 LEFT JOIN nx b ON b.symbol = o.symbol AND b.i = i1 + 1""",
    "res": """SELECT *, CASE WHEN r > 0 THEN 1 ELSE 0 END AS up, position * r AS gross,
        CASE WHEN position > 0 THEN position * ((1 + r) * (1 - 0.001e0) / (1 + 0.001e0) * (1 - 0.002e0) * (1 - 0.002e0) - 1) ELSE 0 END AS net
      FROM oc WHERE status = 'resolved'""",
}
_PRE = SCORES + " cal"


def frozen_signals(spark, d):
    scored = scored_bars(spark, d).where("score IS NOT NULL")
    cal = trading_calendar(brand_bars(spark, d).withColumn("market", one_market("symbol"))).drop("market")
    s = scored.join(cal, "date").withColumn("run_id", F.concat(F.lit("run-"), F.col("date").cast("string")))
    w = topn_weights(s, threshold=0.25, top_n=5).withColumnRenamed("weight", "weight_")
    j = s.join(w.select("run_id", "date", "symbol", F.col("weight_").alias("w")), ["run_id", "date", "symbol"])
    return j.select(
        "run_id", F.when(F.col("idx") % 2 == 0, "one").otherwise("two").alias("cohort_id"),
        F.col("date").alias("basis_date"), "symbol", (F.col("score") * 0.01).alias("score"),
        F.when((F.col("volume") + F.col("idx")) % 97 == 0, 2.0).otherwise(F.col("p")).alias("up_probability"),
        F.col("w").alias("position"), "idx")


def outcomes(spark, d):
    return pr.signal_outcome(frozen_signals(spark, d), brand_bars(spark, d), OFFICIAL)


@query("signal_outcome", sql(_PRE, """SELECT run_id, symbol, status, reason,
    CASE WHEN status = 'resolved' THEN CAST(d1 AS VARCHAR) END AS entry_date,
    CASE WHEN status = 'resolved' THEN CAST(d2 AS VARCHAR) END AS exit_date,
    CASE WHEN status = 'resolved' THEN round(r, 6) END AS actual_return,
    CASE WHEN status = 'resolved' THEN round(position * r, 6) + 0 END AS gross_return FROM oc""", **_FROZEN))
def _(spark, d):
    return present(outcomes(spark, d).select("run_id", "symbol", "status", "reason", "entry_date",
                                             "exit_date", "actual_return", "gross_return"))


@query("cohort_metrics", sql(_PRE, """SELECT cohort_id, count(*) AS resolved_signals, count(DISTINCT basis_date) AS completed_days,
    round(sqrt(avg((r - score) * (r - score))), 6) AS rmse, round(avg(abs(r - score)), 6) AS mae,
    round(avg(CASE WHEN (up_probability >= 0.5) = (up = 1) THEN 1e0 ELSE 0e0 END), 6) AS direction_accuracy,
    round(avg((up_probability - up) * (up_probability - up)), 6) AS brier,
    round(avg(CASE WHEN position > 0 THEN 1e0 ELSE 0e0 END), 6) AS active_share, round(corr(r, score), 6) AS linear_ic,
    round(corr(rr, rs), 6) AS rank_ic FROM (SELECT *, rank() OVER (PARTITION BY cohort_id ORDER BY r) AS rr,
      rank() OVER (PARTITION BY cohort_id ORDER BY score) AS rs FROM res) GROUP BY 1""", **_FROZEN))
def _(spark, d):
    # several statistics read the resolved outcomes: look them up once
    resolved = cut_lineage(outcomes(spark, d).where("status = 'resolved'").select(
        "cohort_id", "basis_date", "actual_return", "score", "direction_hit", "brier", "position"))
    return present(pr.cohort_metrics(resolved))


@query("compound_daily_returns", sql(_PRE, """SELECT cohort_id, round(exp(sum(ln(1 + g))) - 1, 6) AS gross,
    round(exp(sum(ln(1 + m))) - 1, 6) AS benchmark
  FROM (SELECT cohort_id, basis_date, sum(gross) AS g, avg(r) AS m FROM res GROUP BY 1, 2) GROUP BY 1""", **_FROZEN))
def _(spark, d):
    done = outcomes(spark, d).where("status = 'resolved'")
    gross = pr.compound_daily_returns(done, value="gross_return", weighted=True, name="gross")
    bench = pr.compound_daily_returns(done, value="actual_return", weighted=False, name="benchmark")
    return present(gross.join(bench, "cohort_id"))


def cohort_runs(spark, d):
    """Run rows of the frozen signals; cohort two mixes cost pairs."""
    g = frozen_signals(spark, d).groupBy("run_id", "cohort_id", "basis_date").agg(F.max("idx").alias("idx"))
    mixed = (F.col("cohort_id") == "two") & (F.col("idx") % 3 == 0)
    return g.select("run_id", "cohort_id", "basis_date", F.when(mixed, 0.001).otherwise(0.002).alias("fees"),
                    F.lit(0.001).alias("slippage"), F.array().cast("array<string>").alias("issues"))


# A run waits while any of its signals does; only runs resolved as a whole count.
@query("cost_consistency", sql(_PRE, """SELECT cohort_id, CASE WHEN cohort_id = 'one' THEN 0.002e0 END AS fees,
    CASE WHEN cohort_id = 'one' THEN 0.001e0 END AS slippage,
    CASE WHEN cohort_id = 'one' THEN round(exp(sum(ln(1 + n)) FILTER (ok)) - 1, 6) END AS net_return
  FROM (SELECT cohort_id, basis_date, sum(n0) AS n, bool_and(st = 'resolved') AS ok FROM (SELECT o.cohort_id, o.basis_date, o.run_id,
      o.status AS st, CASE WHEN position > 0 THEN position * ((1 + r) * (1 - 0.001e0) / (1 + 0.001e0) * (1 - 0.002e0) * (1 - 0.002e0) - 1) ELSE 0 END AS n0
    FROM oc o WHERE position > 0) GROUP BY 1, 2) GROUP BY 1""", **_FROZEN))
def _(spark, d):
    runs = cohort_runs(spark, d)
    held = outcomes(spark, d).where("position > 0")
    return present(pr.cost_consistency(pr.run_states(runs, pr.net_outcomes(held, runs))))


def strict_runs(spark, d):
    """One run per customer with mostly the frozen recipe, varied by its key.

    A sixth of them belong to the one-symbol cohort, half of these with the right symbol.
    """
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    recipe = {n: v for group in pr.STRICT_RECIPE.values() for n, v in group.items()}
    # leaves out the fields that are null by default, and has one of its own
    brief = json.dumps({"note": 1, **{n: v for n, v in recipe["extended"].items() if v is not None}})
    alone = F.when(k % 12 == 7, F.array(F.lit(pr.SINGLE_SYMBOL)))

    def text(name, every, other):
        return F.when(k % every == 0, other).otherwise(json.dumps(recipe[name])).alias(name)

    basis = F.date_add(F.lit("1996-01-01").cast("date"), (k % 700).cast("int"))
    names = F.transform(F.sequence(F.lit(10), F.lit(49)), lambda i: F.concat(F.lit("S"), i))
    asked = (F.when(k % 23 == 0, F.slice(names, 1, 30)).when(k % 29 == 0, F.reverse(names))
             .when(k % 31 == 0, F.array(F.lit("zz"))).otherwise(F.slice(names, 1, 39)))
    return c.select(
        k.alias("run_id"), F.when(k % 2 == 0, "all").when(k % 6 == 1, "solo").otherwise("one").alias("cohort_id"),
        text("features", 37, "[]"), text("model", 41, "no json"), text("direction_model", 43, '{"type": "extra_trees"}'),
        text("strategy", 47, None), text("baselines", 53, '["buy_and_hold", "momentum"]'), F.when(k % 59 == 0, "{}").when(k % 61 == 0, brief).otherwise(json.dumps(recipe["extended"])).alias("extended"),
        F.when(k % 7 == 0, "failed").otherwise("succeeded").alias("status"),
        F.when(k % 11 == 0, None).otherwise("strict_v1").alias("mode"), basis.alias("basis_date"),
        F.when(k % 13 != 0, F.to_timestamp(basis) + F.expr("INTERVAL 6 HOURS")
               + F.when(k % 17 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY")))
        .alias("signal_frozen_at"),
        F.date_sub(basis, 1096).alias("range_start"),
        F.when(k % 19 == 0, F.date_add(basis, 1)).otherwise(basis).alias("range_end"),
        F.lit("TW").alias("market"), F.when(k % 5 == 0, "close_to_close").otherwise("open_to_open")
        .alias("return_target"), F.lit(1).alias("horizon_days"),
        F.when(k % 9 == 0, "simulation").otherwise("research_only").alias("execution_route"),
        F.lit("vnext_spec_mode").alias("runtime_mode"), F.lit("research_spec_v1").alias("default_bundle_version"),
        F.lit("walk_forward").alias("validation_method"), F.lit(3).alias("validation_splits"),
        F.lit(0.2).alias("validation_test_size"),
        F.when(k % 8 == 0, 0.1).otherwise(0.002).alias("fees"), F.lit(0.001).alias("slippage"),
        F.coalesce(alone, asked).alias("symbols"), F.coalesce(alone, names).alias("universe"))


_STRICT = """SELECT k AS run_id, cohort, basis, array_to_string(list_filter([
    CASE WHEN k % 7 = 0 THEN 'run_not_succeeded' END,
    CASE WHEN k % 11 = 0 THEN 'missing_strict_evidence' END,
    CASE WHEN s AND k % 13 = 0 THEN 'invalid_signal_frozen_at' END,
    CASE WHEN s AND k % 13 <> 0 AND k % 17 = 0 THEN 'signal_frozen_at_not_on_basis_date' END,
    CASE WHEN s AND k % 5 = 0 THEN 'strict_target_mismatch' END,
    CASE WHEN s AND k % 9 = 0 THEN 'strict_execution_route_mismatch' END,
    CASE WHEN s AND k % 37 = 0 THEN 'strict_feature_recipe_mismatch' END,
    CASE WHEN s AND (k % 41 = 0 OR k % 43 = 0) THEN 'strict_model_recipe_mismatch' END,
    CASE WHEN s AND (k % 8 = 0 OR k % 53 = 0) THEN 'strict_cost_or_baseline_recipe_mismatch' END,
    CASE WHEN s AND k % 47 = 0 THEN 'strict_strategy_recipe_mismatch' END,
    CASE WHEN s AND k % 59 = 0 THEN 'strict_extended_recipe_mismatch' END,
    CASE WHEN s AND k % 19 = 0 THEN 'strict_date_range_recipe_mismatch' END,
    CASE WHEN s AND inv THEN 'invalid_universe_snapshot' END,
    CASE WHEN s AND k % 12 = 1 AND NOT inv THEN 'strict_2330_universe_mismatch' END,
    CASE WHEN s AND k % 2 = 0 AND (k % 23 = 0 OR (k % 29 <> 0 AND k % 31 = 0)) THEN 'strict_execution_coverage_mismatch' END
  ], lambda x: x IS NOT NULL), ',') AS issues
  FROM (SELECT c_custkey AS k, c_custkey % 11 <> 0 AS s,
    c_custkey % 12 <> 7 AND c_custkey % 23 <> 0 AND (c_custkey % 29 = 0 OR c_custkey % 31 = 0) AS inv,
    CASE WHEN c_custkey % 2 = 0 THEN 'all' WHEN c_custkey % 6 = 1 THEN 'solo' ELSE 'one' END AS cohort,
    DATE '1996-01-01' + CAST(c_custkey % 700 AS INTEGER) AS basis FROM customer)"""


def strict_checked(spark, d):
    return pr.strict_run_issues(strict_runs(spark, d), cohorts=("all", "one", "solo"), cohort=F.col("cohort_id"),
                                all_active="all", single="solo")


@query("strict_run_issues", sql("", "SELECT run_id, issues FROM si", si=_STRICT))
def _(spark, d):
    return present(strict_checked(spark, d).select("run_id", "issues"))


@query("duplicate_basis_issue", sql("", """SELECT run_id, issues = '' AND n > 1 AS from_valid,
    coalesce(n, 0) > 1 AS duplicated FROM si LEFT JOIN (SELECT cohort, basis, count(*) AS n FROM si WHERE issues = '' GROUP BY 1, 2)
    USING (cohort, basis)""".replace("issues = '' AND n > 1 AS", "issues = '' AND coalesce(n, 0) > 1 AS"), si=_STRICT))
def _(spark, d):
    out = pr.duplicate_basis_issue(strict_checked(spark, d))
    dup = F.array_contains("issues", "duplicate_basis_date")
    return out.select("run_id", (dup & (F.size("issues") == 1)).alias("from_valid"), dup.alias("duplicated"))


def order_signals(spark, d):
    """Orders as signal rows of a run per customer, listed by order key."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("run_id"), k.alias("ordinal"),
        F.when(k % 37 == 0, "").otherwise(F.concat(F.lit("T"), k % 6)).alias("symbol"),
        F.when(k % 41 != 0, F.date_add(F.lit("2001-01-01").cast("date"), (k % 2).cast("int"))).alias("date"),
        ((k % 1000) / 500.0 - 1).alias("score"),
        F.when(k % 43 == 0, 1.5).otherwise((k % 100) / 100.0).alias("up_probability"),
        F.when(k % 3 == 0, 0.5).otherwise(0.0).alias("position"),
        F.when(k % 2 == 0, "up").otherwise("down").alias("predicted_direction"),
        F.when(k % 10 == 9, "holdout").otherwise("forward_opinion").alias("signal_kind"))


def declared_symbols(spark, d):
    """T0..T4 per customer: T5 is never declared."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.explode(
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("T"), i))).alias("symbol"))
    return c


_SIG = {
    "sg": """SELECT o_custkey AS run_id, o_orderkey AS k, CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE 'T' || (o_orderkey % 6) END AS symbol,
        CASE WHEN o_orderkey % 41 <> 0 THEN DATE '2001-01-01' + CAST(o_orderkey % 2 AS INTEGER) END AS date,
        (o_orderkey % 1000) / 500e0 - 1 AS score, CASE WHEN o_orderkey % 43 = 0 THEN 1.5e0 ELSE (o_orderkey % 100) / 100e0 END AS up_probability,
        CASE WHEN o_orderkey % 3 = 0 THEN 0.5e0 ELSE 0e0 END AS position FROM orders WHERE o_orderkey % 10 <> 9""",
    "us": "SELECT * FROM sg WHERE symbol NOT IN ('', 'T5') AND date IS NOT NULL",
    "fi": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, symbol ORDER BY date DESC, k) AS rn,
        count(*) OVER (PARTITION BY run_id, symbol, date) AS n FROM us) WHERE rn = 1""",
    "la": "SELECT *, up_probability <= 1 AND date = max(date) OVER (PARTITION BY run_id) AS valid FROM fi",
    "sm": """SELECT c_custkey AS run_id, coalesce(have, 0) AS have, coalesce(rows_, 0) - coalesce(have, 0) + coalesce(bad, 0) + coalesce(broken, 0) AS invalid,
        coalesce(dates, 0) AS dates, coalesce(un, '') AS un FROM customer
      LEFT JOIN (SELECT run_id, count(*) AS have, sum(n) AS rows_, count(DISTINCT date) AS dates, count(*) FILTER (NOT valid) AS bad FROM la GROUP BY 1) g ON g.run_id = c_custkey
      LEFT JOIN (SELECT run_id, count(*) FILTER (symbol IN ('', 'T5') OR date IS NULL) AS broken,
        max(CASE WHEN symbol = 'T5' THEN 'T5' END) AS un FROM sg GROUP BY 1) b ON b.run_id = c_custkey""",
}


def snapshot(spark, d):
    return pr.latest_signal_snapshot(order_signals(spark, d), declared_symbols(spark, d))


@query("latest_signal_snapshot", sql("", """SELECT run_id, CAST(have AS BIGINT) AS latest_count, CAST(invalid AS BIGINT) AS invalid_row_count,
    un AS unexpected_symbols, have = 5 AND dates = 1 AND invalid = 0 AS snapshot_complete FROM sm""", **_SIG))
def _(spark, d):
    _latest, summary = snapshot(spark, d)
    return present(summary)


@query("latest_signal_rows", sql("", """SELECT run_id, symbol, CAST(date AS VARCHAR) AS date, k AS ordinal, valid FROM la""", **_SIG))
def _(spark, d):
    latest, _summary = snapshot(spark, d)
    return present(latest.select("run_id", "symbol", "date", "ordinal", "valid"))


@query("forward_signal_issues", sql("", """SELECT c_custkey AS run_id, CASE WHEN a.n IS NULL OR a.n <> 6 OR a.u <> 6 OR a.lo <> DATE '2001-01-01' OR a.hi <> DATE '2001-01-01' OR a.nd > 0
      THEN 'incomplete_forward_signals' WHEN NOT a.sane THEN 'invalid_forward_signal' END AS issue
    FROM customer LEFT JOIN (SELECT run_id, count(*) AS n, count(DISTINCT symbol) AS u, min(date) AS lo, max(date) AS hi,
      count(*) FILTER (date IS NULL) AS nd, bool_and(up_probability <= 1) AS sane FROM dsg GROUP BY 1) a ON a.run_id = c_custkey""",
    dsg="""SELECT DISTINCT o_custkey AS run_id, 'T' || (o_orderkey % 6) AS symbol, o_orderkey AS k, CASE WHEN o_custkey % 7 = 0 THEN DATE '2001-01-02' ELSE DATE '2001-01-01' END AS date,
      CASE WHEN o_orderkey % 43 = 0 THEN 1.5e0 ELSE 0.5e0 END AS up_probability FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 6 ORDER BY o_orderkey) = 1"""))
def _(spark, d):
    o = table(spark, d, "orders")
    firsts = o.groupBy(F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 6).alias("s")).agg(
        F.min("o_orderkey").alias("k"))
    signals = firsts.select(
        "run_id", F.concat(F.lit("t"), "s").alias("symbol"),
        F.when(F.col("run_id") % 7 == 0, F.lit("2001-01-02")).otherwise("2001-01-01").cast("date").alias("date"),
        F.lit(0.1).alias("score"), F.lit(0.0).alias("position"),
        F.when(F.col("k") % 43 == 0, 1.5).otherwise(0.5).alias("up_probability"),
        F.lit("forward_opinion").alias("signal_kind"))
    runs = table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"), F.lit("2001-01-01").cast("date").alias("basis_date"),
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("T"), i)).alias("symbols"))
    return pr.forward_signal_issues(runs, signals)


@query("cohort_preflight", """SELECT cohort_id, full_universe_count, execution_universe_count,
    round(execution_universe_count / full_universe_count::DOUBLE, 6) AS coverage,
    CASE WHEN execution_universe_count / full_universe_count::DOUBLE >= 0.95 THEN 'ready' ELSE 'no-opinion' END AS status
  FROM (SELECT c_mktsegment || (c_nationkey % 2) AS cohort_id, count(*) AS full_universe_count,
    count(*) FILTER (c_custkey % 40 <> 0 AND NOT (c_nationkey % 2 = 1 AND (c_custkey % 30 = 1 OR c_custkey % 50 = 2 OR c_custkey % 60 = 3))) AS execution_universe_count
    FROM customer GROUP BY 1)""")
def _(spark, d):
    c = table(spark, d, "customer")
    k, odd = F.col("c_custkey"), F.col("c_nationkey") % 2 == 1
    universe = c.select(F.concat("c_mktsegment", F.col("c_nationkey") % 2).alias("cohort_id"), k.alias("symbol"))
    day = F.lit("2001-01-01").cast("date")
    flags = c.where(k % 40 != 0).select(
        k.alias("symbol"), F.when(odd & (k % 30 == 1), F.date_sub(day, 1)).otherwise(day).alias("latest_date"),
        day.alias("basis_date"), (~(odd & (k % 50 == 2))).alias("calibration_ok"),
        (~(odd & (k % 60 == 3))).alias("signal_ok"))
    _rows, summary = pr.cohort_preflight(universe, flags)
    return present(summary)


def policies(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("run_id"), F.when(k % 13 != 0, F.lit(0.1)).alias("threshold"), F.lit(0.5).alias("confirm"),
                    F.when(k % 17 != 0, (k % 4).cast("int")).alias("top_n"),
                    F.when(k % 6 == 0, 1).otherwise(0).alias("limitation_count"))


@query("opinion_buckets", sql("", """SELECT run_id, symbol, CASE WHEN position > 0 AND up_probability >= 0.5 THEN 'buy'
      WHEN score < 0.1 AND up_probability < 0.5 THEN 'avoid' ELSE 'watch' END AS bucket,
    CASE WHEN (position > 0 AND up_probability >= 0.5) OR (score < 0.1) = (up_probability < 0.5) THEN 'confirmed' ELSE 'conflict' END AS confirmation_state
    FROM la WHERE valid AND run_id % 6 <> 0 AND run_id % 13 <> 0""", **_SIG))
def _(spark, d):
    latest, _summary = snapshot(spark, d)
    return pr.opinion_buckets(latest, policies(spark, d))


@query("parameter_sensitivity", sql("", """SELECT run_id, count(*) FILTER (b) AS base, CASE WHEN count(s1) > 0 THEN count(*) FILTER (s1) END AS strict_threshold,
    CASE WHEN count(s2) > 0 THEN count(*) FILTER (s2) END AS loose_threshold, CASE WHEN count(s3) > 0 THEN count(*) FILTER (s3) END AS top_n_minus_1,
    CASE WHEN count(s4) > 0 THEN count(*) FILTER (s4) END AS top_n_plus_1,
    CASE WHEN count(s1) + count(s4) > 0 THEN count(*) FILTER (b AND coalesce(s1, true) AND coalesce(s2, true) AND coalesce(s3, true) AND coalesce(s4, true)) ELSE 0 END AS stable,
    count(*) FILTER (s1 <> b OR s2 <> b OR s3 <> b OR s4 <> b) AS changed FROM (
      SELECT *, position > 0 AS b, CASE WHEN t > 0 THEN score >= t * 1.25e0 END AS s1, CASE WHEN t > 0 THEN score >= t * 0.75e0 END AS s2,
        CASE WHEN n > 1 THEN rk <= n - 1 END AS s3, CASE WHEN n >= 1 THEN rk <= n + 1 END AS s4 FROM (
        SELECT * EXCLUDE (n), CASE WHEN run_id % 13 <> 0 THEN 0.1e0 END AS t, CASE WHEN run_id % 17 <> 0 THEN run_id % 4 END AS n,
          row_number() OVER (PARTITION BY run_id ORDER BY score DESC, symbol) AS rk FROM la
        WHERE up_probability <= 1)) GROUP BY 1""", **_SIG))
def _(spark, d):
    latest, _summary = snapshot(spark, d)
    return pr.parameter_sensitivity(latest, policies(spark, d))


def noted_runs(spark, d):
    """Customers as runs with warnings and caveats."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    warn = F.when(k % 3 == 0, F.array(F.lit("late data"), F.concat(F.lit("[t"), k % 6, F.lit("] thin volume"))))
    cav = F.struct(F.when(k % 4 == 1, "VERSION_MISSING").otherwise("WINDOW").alias("code"),
                   F.when(k % 4 == 2, "blocker").otherwise("note").alias("severity"))
    return c.select(
        k.alias("run_id"), F.coalesce(warn, F.array().cast("array<string>")).alias("warnings"),
        F.when(k % 4 != 0, F.array(cav, cav)).otherwise(F.slice(F.array(cav), 1, 0)).alias("caveats"),
        F.when(k % 5 == 0, "failed").otherwise("succeeded").alias("status"),
        F.when(k % 7 == 0, "partial").otherwise("complete").alias("artifact_completeness"),
        F.when(k % 8 == 0, 2).otherwise(0).alias("stale_days"), F.when(k % 9 == 0, 0.1).alias("stale_share"))


@query("warning_attribution", """SELECT c_custkey AS run_id, symbol,
    CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN symbol = 'T' || (c_custkey % 6) THEN 'warning' ELSE 'unscoped_warning' END
      WHEN c_custkey % 4 <> 0 THEN 'caveat' ELSE 'checked_no_warning' END AS family,
    CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN symbol = 'T' || (c_custkey % 6) THEN '[t' || (c_custkey % 6) || '] thin volume' END
      WHEN c_custkey % 4 = 1 THEN 'VERSION_MISSING: note' WHEN c_custkey % 4 = 2 THEN 'WINDOW: blocker' WHEN c_custkey % 4 = 3 THEN 'WINDOW: note' END AS text
  FROM customer, (SELECT unnest(['T0', 'T1', 'T2', 'T3', 'T4']) AS symbol)""")
def _(spark, d):
    return pr.warning_attribution(declared_symbols(spark, d), noted_runs(spark, d))


@query("invalidation_reason", """SELECT c_custkey AS run_id, CASE WHEN c_custkey % 8 = 0 OR c_custkey % 9 = 0 THEN 'stale_freshness'
    WHEN c_custkey % 4 <> 0 THEN 'comparison_caveats' ELSE 'newer_run_or_market_data' END AS family FROM customer""")
def _(spark, d):
    return noted_runs(spark, d).select("run_id", pr.invalidation_reason().alias("family"))


@query("blocker_count", """SELECT c_custkey AS run_id, CASE WHEN c_custkey % 4 = 0 THEN 0
    WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 4 IN (1, 2) THEN 2 ELSE 0 END AS blockers FROM customer""")
def _(spark, d):
    return present(noted_runs(spark, d).select("run_id", pr.blocker_count().alias("blockers")))


_FLAGS = {"request": 2, "strategy": 3, "diagnostics": 5, "signals": 7, "metrics": 11, "threshold_policy": 13,
          "price_basis": 17, "boundary": 19, "validation": 23, "validation_metrics": 23, "baselines": 29,
          "snapshot_complete": 6, "config_sources": 10, "fallback_audit": 15}
_COUNTS = {"latest": 4, "rows": 3, "limitations": 2, "caveats": 5, "warnings": 3, "blockers": 4,
           "traceable": 3, "risky": 6, "invalidated": 3}


@query("review_checks", sql("", """SELECT k AS run_id, c.check, c.category, c.status FROM (SELECT k, unnest([
    {'check': 'strategy_lifecycle', 'category': 'method', 'status': CASE WHEN request AND strategy AND diagnostics AND signals AND metrics AND (rows_ > 0 OR limitations > 0) THEN 'pass' ELSE 'fail' END},
    {'check': 'signal_to_position', 'category': 'method', 'status': CASE WHEN latest = 0 THEN 'fail' WHEN snapshot_complete THEN 'pass' ELSE 'warning' END},
    {'check': 'backtest_report_discipline', 'category': 'method', 'status': CASE WHEN NOT metrics THEN 'fail' WHEN threshold_policy AND price_basis AND boundary AND caveats = 0 THEN 'pass' ELSE 'warning' END},
    {'check': 'robustness', 'category': 'method', 'status': CASE WHEN validation_metrics AND baselines AND blockers = 0 THEN 'pass' WHEN validation OR caveats > 0 OR warnings > 0 OR NOT baselines THEN 'warning' ELSE 'not_evaluated' END},
    {'check': 'parameter_sensitivity', 'category': 'method', 'status': CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'warning' END},
    {'check': 'evidence_traceability', 'category': 'self_review', 'status': CASE WHEN (rows_ > 0 AND traceable = rows_) OR k % 3 <> 0 THEN 'pass' ELSE 'fail' END},
    {'check': 'risk_present', 'category': 'self_review', 'status': CASE WHEN (rows_ > 0 AND risky = rows_) OR limitations > 0 THEN 'pass' ELSE 'fail' END},
    {'check': 'invalidation_present', 'category': 'self_review', 'status': CASE WHEN (rows_ > 0 AND invalidated = rows_) OR limitations > 0 THEN 'pass' ELSE 'fail' END},
    {'check': 'manual_adoption_boundary', 'category': 'self_review', 'status': CASE WHEN boundary THEN 'pass' ELSE 'fail' END},
    {'check': 'insufficient_evidence_gate', 'category': 'self_review', 'status': CASE WHEN limitations = 0 OR k % 3 <> 0 THEN 'pass' ELSE 'fail' END},
    {'check': 'source_artifact_audit', 'category': 'source_provider_audit', 'status': CASE WHEN config_sources OR fallback_audit THEN 'warning' ELSE 'not_evaluated' END},
    {'check': 'text_evidence_summary', 'category': 'evidence_summary', 'status': CASE WHEN caveats + warnings > 0 THEN 'warning' ELSE 'not_evaluated' END}
  ]) AS c FROM fl)""", fl="SELECT c_custkey AS k, " + ", ".join(
      [f"c_custkey % {m} <> 0 AS {n}" for n, m in _FLAGS.items()]
      + [f"c_custkey % {m} AS {n if n != 'rows' else 'rows_'}" for n, m in _COUNTS.items()]) + " FROM customer"))
def _(spark, d):
    k = F.col("c_custkey")
    runs = table(spark, d, "customer").select(
        k.alias("run_id"), *[(k % m != 0).alias(n) for n, m in _FLAGS.items()],
        *[(k % m).alias(n) for n, m in _COUNTS.items()],
        F.when(k % 3 == 0, "viable").otherwise("no-opinion").alias("state"),
        F.when(k % 2 == 0, "pass").otherwise("warning").alias("sensitivity"))
    return pr.review_checks(runs)


# In German texts a phrase begins at the end of each text and ends at the start of the next.
@query("forbidden_phrase_scan", """SELECT source, lang, NOT regexp_matches(regexp_replace(regexp_replace(lower(
      string_agg(CASE WHEN lang = 'de' THEN 'Order ' ELSE '' END || text
        || CASE WHEN doc_id % 50 = 0 AND lang = 'en' THEN ' Live--Order' WHEN lang = 'de' THEN ' place' ELSE '' END, ' ' ORDER BY doc_id)),
      '[-_/]+', ' ', 'g'), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g'),
    'broker routing|execution ready|live order|automatic rebalance|portfolio control|account control|personalized investment advice|personalized advice|place order|order routing|execution route')
    AS boundary_present FROM documents GROUP BY 1, 2""")
def _(spark, d):
    docs = table(spark, d, "documents")
    german = F.col("lang") == "de"
    before = F.when(german, "Order ").otherwise("")
    after = (F.when((F.col("doc_id") % 50 == 0) & (F.col("lang") == "en"), " Live--Order")
             .when(german, " place").otherwise(""))
    return pr.forbidden_phrase_scan(
        docs.select("doc_id", "source", "lang", F.concat(before, "text", after).alias("text")),
        keys=["source", "lang"], order="doc_id")
