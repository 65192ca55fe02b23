"""Queries: scores from a fitted line, diagnostics and validation summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.operators import diagnostics as dg, portfolio as pf, splits as sp
from barloom.operators.features import Feature, feature_set, forward_return_label, training_frame
from barloom.plans.catalog import query
from barloom.plans.inputs import (RUN_SCORES, TYPE_REQ, run_requests, scored_bars, sql,
                                  type_bars, type_requests)
from barloom.plans.portfolio import METRICS_SQL

_BASE = "bars uni zs scored req"
_POINTS = {
    "lab": """SELECT *, lead(open) OVER (PARTITION BY symbol ORDER BY date) / open - 1 AS target FROM scored""",
    "fr": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
      count(*) OVER (PARTITION BY symbol) AS n FROM lab WHERE score IS NOT NULL AND target IS NOT NULL""",
    "ro": """SELECT *, CASE WHEN i < CAST(floor(n * (1 - 0.2e0)) AS BIGINT) - 1 THEN 'train'
      WHEN i >= CAST(floor(n * (1 - 0.2e0)) AS BIGINT) THEN 'test' END AS role FROM fr""",
    "ols": """SELECT symbol, regr_slope(target, score) AS b, regr_intercept(target, score) AS a
      FROM ro WHERE role = 'train' GROUP BY 1""",
    "pts": """SELECT run_id, symbol, date, target AS actual, a + b * score AS predicted,
      CASE WHEN target > 0 THEN 1 ELSE 0 END AS up, round(p, 2) AS p2
      FROM ro JOIN ols USING (symbol) JOIN req USING (symbol) WHERE role = 'test'"""}


def holdout_points(spark, d):
    """(symbol, date, actual, predicted, up, p2) on the test rows."""
    frame = training_frame(forward_return_label(scored_bars(spark, d)), ["score"])
    frame = sp.holdout_split(frame, test_size=0.2, purge=1)
    out = dg.fit_scores_ols(frame, feature="score", target="target", keys=["symbol"])
    out = dg.direction_label(out)
    return out.select("symbol", "date", F.col("target").alias("actual"), "predicted", "up",
                      F.round("p", 2).alias("p2"))


def run_points(spark, d):
    return holdout_points(spark, d).join(run_requests(spark, d).select("run_id", "symbol"),
                                         "symbol")


def direction_points(spark, d):
    return run_points(spark, d).select("run_id", F.col("up").alias("actual"),
                                       F.col("p2").alias("probability"))


@query("fit_scores_ols", sql(_BASE, """SELECT symbol, CAST(date AS VARCHAR) AS date,
    round(a + b * score, 6) AS predicted FROM ro JOIN ols USING (symbol) WHERE role = 'test'""",
    **{k: v for k, v in _POINTS.items() if k != "pts"}))
def _(spark, d):
    return present(holdout_points(spark, d).select("symbol", "date", "predicted"))


@query("direction_label", sql("bars", """SELECT symbol, CAST(date AS VARCHAR) AS date,
    CAST(CASE WHEN target > 0.001e0 THEN 1 WHEN target <= 0.001e0 THEN 0 END AS BIGINT) AS up FROM (
    SELECT symbol, date, lead(open) OVER (PARTITION BY symbol ORDER BY date) / open - 1 AS target FROM bars)
    WHERE target IS NOT NULL"""))
def _(spark, d):
    from barloom.plans.inputs import brand_bars
    frame = forward_return_label(brand_bars(spark, d)).where("target IS NOT NULL")
    return present(dg.direction_label(frame, threshold=0.001).select("symbol", "date", "up"))


@query("regression_diagnostics", sql(_BASE, """SELECT run_id, count(*) AS n,
    round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
    round(avg(abs(actual - predicted)), 6) AS mae FROM pts GROUP BY 1""", **_POINTS))
def _(spark, d):
    return present(dg.regression_diagnostics(run_points(spark, d)))


@query("linear_ic", sql(_BASE, """SELECT run_id, round(corr(actual, predicted), 6) AS linear_ic
    FROM pts GROUP BY 1""", **_POINTS))
def _(spark, d):
    return present(dg.linear_ic(run_points(spark, d)))


# predictions and outcomes rounded so that ties occur
@query("rank_ic", sql(_BASE, """SELECT run_id, round(corr(ra, rp), 6) AS rank_ic FROM (
    SELECT run_id, rank() OVER (PARTITION BY run_id ORDER BY a) +
        (count(*) OVER (PARTITION BY run_id, a) - 1) / 2e0 AS ra,
      rank() OVER (PARTITION BY run_id ORDER BY p2) +
        (count(*) OVER (PARTITION BY run_id, p2) - 1) / 2e0 AS rp
    FROM (SELECT run_id, p2, round(actual, 3) AS a FROM pts)) GROUP BY 1""", **_POINTS))
def _(spark, d):
    pts = run_points(spark, d).select("run_id", F.round("actual", 3).alias("actual"),
                                      F.col("p2").alias("predicted"))
    return present(dg.rank_ic(pts))


@query("confusion_and_pr", sql(_BASE, """SELECT run_id, n, tn, fp, fn, tp,
    round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
    round((tp + fn) / n::DOUBLE, 6) AS prevalence FROM (
      SELECT run_id, count(*) AS n, count(*) FILTER (up = 0 AND p2 < 0.6) AS tn,
        count(*) FILTER (up = 0 AND p2 >= 0.6) AS fp, count(*) FILTER (up = 1 AND p2 < 0.6) AS fn,
        count(*) FILTER (up = 1 AND p2 >= 0.6) AS tp FROM pts GROUP BY 1)""", **_POINTS))
def _(spark, d):
    return present(dg.confusion_and_pr(direction_points(spark, d), threshold=0.6))


_STEPS = """SELECT run_id, p2, sum(up) AS pos, sum(1 - up) AS neg FROM pts GROUP BY 1, 2"""


@query("roc_auc", sql(_BASE, """SELECT run_id, round(sum(pos * (nb + neg / 2e0)) / (sum(pos) * sum(neg)), 6) AS roc_auc
    FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY run_id ORDER BY p2
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM st) GROUP BY 1""",
    **_POINTS, st=_STEPS))
def _(spark, d):
    return present(dg.roc_auc(direction_points(spark, d)))


@query("pr_auc", sql(_BASE, """SELECT run_id, round(sum(pos / allp * (tp / called)), 6) AS pr_auc FROM (
    SELECT run_id, pos::DOUBLE AS pos, (sum(pos) OVER (PARTITION BY run_id))::DOUBLE AS allp,
      (sum(pos) OVER w)::DOUBLE AS tp, (sum(pos + neg) OVER w)::DOUBLE AS called FROM st
      WINDOW w AS (PARTITION BY run_id ORDER BY p2 DESC)) GROUP BY 1""", **_POINTS, st=_STEPS))
def _(spark, d):
    return present(dg.pr_auc(direction_points(spark, d)))


@query("brier", sql(_BASE, """SELECT run_id, round(avg((p2 - up) * (p2 - up)), 6) AS brier
    FROM pts GROUP BY 1""", **_POINTS))
def _(spark, d):
    return present(dg.brier(direction_points(spark, d)))


_OUTPUTS = """SELECT symbol, CASE WHEN min(date) > DATE '1995-02-10' THEN 'Insufficient rows' END AS reason,
  count(*) FILTER (date >= DATE '2001-01-01') AS n FROM scored WHERE score IS NOT NULL GROUP BY 1"""


@query("diagnostics_completeness", sql(_BASE, """SELECT run_id,
    CASE WHEN told IS NULL THEN 'evaluated' ELSE 'not_evaluated' END AS evaluation_status,
    told AS status_reason FROM (SELECT run_id,
      string_agg(symbol || ': ' || reason, '; ' ORDER BY symbol) AS told
      FROM req LEFT JOIN outs USING (symbol) GROUP BY 1)""", outs=_OUTPUTS))
def _(spark, d):
    s = scored_bars(spark, d).where("score IS NOT NULL")
    outs = s.groupBy("symbol").agg(
        F.min("date").alias("first"), F.count(F.lit(1)).alias("rows")).withColumn(
        "reason", F.when(F.col("first") > F.lit("1995-02-10").cast("date"), "Insufficient rows"))
    req = run_requests(spark, d).select("run_id", "symbol")
    return present(dg.diagnostics_completeness(req, req.join(outs, "symbol")))


@query("holdout_confirmation", sql(RUN_SCORES, """SELECT run_id, symbol,
    CAST(date AS VARCHAR) AS date, CASE WHEN bad IS NULL THEN round(pr, 6) END AS probability, warning
  FROM prb LEFT JOIN (SELECT run_id, true AS bad, 'no probability of a rise for ' ||
      string_agg(symbol, ', ' ORDER BY symbol) || ': the run takes no positions' AS warning
    FROM (SELECT run_id, symbol FROM prb GROUP BY 1, 2 HAVING count(pr) = 0) GROUP BY 1) USING (run_id)""",
    prb="""SELECT run_id, symbol, date, CASE WHEN symbol = 'Brand#7' AND run_id IN ('run-1', 'run-2')
      THEN NULL ELSE p END AS pr FROM rscored"""))
def _(spark, d):
    from barloom.plans.inputs import run_scores
    hidden = (F.col("symbol") == "Brand#7") & F.col("run_id").isin("run-1", "run-2")
    scores = run_scores(spark, d).select(
        "run_id", "symbol", "date", F.when(~hidden, F.col("p")).alias("probability"))
    gated, warnings = dg.holdout_confirmation(
        run_requests(spark, d).select("run_id", "symbol"), scores)
    return present(gated.join(warnings, "run_id", "left"))


_VAL = {
    **TYPE_REQ,
    "z1": """SELECT *, CASE WHEN count(close) OVER w = 10
        THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS z0
      FROM tbars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "z2": """SELECT *, lag(z0) OVER (PARTITION BY symbol ORDER BY date) AS z,
      lead(open) OVER (PARTITION BY symbol ORDER BY date) / open - 1 AS target FROM z1""",
    "z3": "SELECT * FROM z2 WHERE z IS NOT NULL AND target IS NOT NULL",
    "cd": """SELECT run_id, date, row_number() OVER (PARTITION BY run_id ORDER BY date) - 1 AS idx,
        count(*) OVER (PARTITION BY run_id) AS n
      FROM (SELECT run_id, date FROM z3 JOIN treq USING (symbol)
        JOIN (SELECT run_id, count(*) AS need FROM treq GROUP BY 1) USING (run_id)
        GROUP BY run_id, date HAVING count(*) = any_value(need))""",
    "fo": """SELECT run_id, date, f AS fold, CASE WHEN idx < n - 3 * t + f * t - 1 THEN 'train' ELSE 'test' END AS role
      FROM (SELECT *, CAST(floor(n * 0.2e0) AS BIGINT) AS t FROM cd) CROSS JOIN range(3) AS r(f)
      WHERE idx < n - 3 * t + f * t - 1 OR (idx >= n - 3 * t + f * t AND idx < n - 3 * t + (f + 1) * t)""",
    "ff": "SELECT * FROM fo JOIN treq USING (run_id) JOIN z3 USING (symbol, date)",
    "ft": """SELECT run_id, fold, symbol, regr_slope(target, z) AS b, regr_intercept(target, z) AS a
      FROM ff WHERE role = 'train' GROUP BY 1, 2, 3""",
    "sc": """SELECT run_id || '/' || fold AS run_id, date, symbol, position, open, a + b * z AS score
      FROM ff JOIN ft USING (run_id, fold, symbol) WHERE role = 'test'""",
    "ok": """SELECT *, score >= 0 AS ok, row_number() OVER (PARTITION BY run_id, date
      ORDER BY score >= 0 DESC, score DESC, position) AS rk FROM sc""",
    "vw": """SELECT run_id, date, symbol, open, CASE WHEN ok AND rk <= 2 THEN 1e0 /
        sum(CASE WHEN ok AND rk <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, date) ELSE 0e0 END AS weight
      FROM ok""",
    "vp": """SELECT *, coalesce(lag(weight) OVER s, 0) AS held, open / lag(open) OVER s - 1 AS mv
      FROM vw WINDOW s AS (PARTITION BY run_id, symbol ORDER BY date)""",
    "pret": """SELECT run_id, date, sum(coalesce(held * mv, 0)) - 0.003e0 * sum(abs(weight - held)) AS ret
      FROM vp GROUP BY 1, 2""",
    "eq": """SELECT run_id, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY run_id ORDER BY date)) AS equity FROM pret""",
    **METRICS_SQL,
}


@query("validation_summary", sql("tbars", """SELECT run_id,
    CASE WHEN nf = 3 THEN 'evaluated' ELSE 'not_evaluated' END AS evaluation_status,
    CASE WHEN nf = 3 THEN NULL ELSE 'a fold has no dates that all symbols share' END AS status_reason,
    CASE WHEN nf = 3 THEN round(total_return, 6) END AS total_return,
    CASE WHEN nf = 3 THEN round(sharpe, 6) END AS sharpe,
    CASE WHEN nf = 3 THEN round(max_drawdown, 6) END AS max_drawdown
  FROM (SELECT DISTINCT run_id FROM treq) LEFT JOIN (
    SELECT split_part(run_id, '/', 1) AS run_id, count(*) AS nf, avg(total_return) AS total_return,
      avg(sharpe) AS sharpe, avg(max_drawdown) AS max_drawdown FROM met GROUP BY 1) USING (run_id)""", **_VAL))
def _(spark, d):
    """Walk-forward check of each run: common dates, folds, a line per (run,
    symbol, fold), top-2 weights, returns after costs, averaged metrics."""
    z = Feature("zscore", 10, shift=1)
    bars = type_bars(spark, d)
    frame = feature_set(bars, [z], keep=("open",)).withColumnRenamed(z.column, "z")
    frame = training_frame(forward_return_label(frame), ["z"])
    req = type_requests(spark, d)
    calendar = sp.trading_calendar(sp.common_dates(frame, req), keys=["run_id"])
    folds = sp.fold_assignment(calendar, method="walk_forward", splits=3, test_size=0.2,
                               purge=1, keys=["run_id"])
    rows = folds.join(req, "run_id").join(frame, ["symbol", "date"])
    scored = dg.fit_scores_ols(rows, feature="z", target="target",
                               keys=["run_id", "fold", "symbol"])
    keys = ["run_id", "fold"]
    weights = pf.topn_weights(scored.withColumn("score", F.col("predicted")), threshold=0.0,
                              top_n=2, keys=keys, keep=["open"])
    returns = pf.portfolio_returns(weights, return_target="open_to_open", fees=0.002,
                                   slippage=0.001, keys=keys)
    metrics = pf.portfolio_metrics(pf.equity_curve(returns, keys=keys), keys=keys)
    plan = (req.select("run_id").distinct()
            .withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                     F.lit(2).cast("bigint"))))
            .withColumn("issue", F.lit(None).cast("string")))
    return present(dg.validation_summary(plan, metrics,
                                         ["total_return", "sharpe", "max_drawdown"]))
