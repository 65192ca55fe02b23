"""Queries that fit models. Fitted forests have no SQL form; single splits, gates, keys and reasons do."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.operators import group_models as gm, models as ml, runs as rn, splits as sp
from barloom.operators.clusters import cluster_snapshots, snapshots_sql
from barloom.operators.diagnostics import direction_label
from barloom.operators.features import Feature, feature_set, forward_return_label, training_frame
from barloom.plans.catalog import query
from barloom.plans.factors import FRAME_SQL, _SRC, cluster_rows
from barloom.plans.features import _TRAIN, feature_frame
from barloom.plans.inputs import TYPE_REQ, run_requests, sql, type_bars, type_requests, universe_of

FEATURES = ["ma_5", "ma_20_open", "roc_10", "zscore_20", "volatility_10_high"]


def _frame(spark, d):
    frame = forward_return_label(feature_frame(spark, d))
    return training_frame(frame, FEATURES).join(universe_of(spark, d), "symbol")


def _held_out(spark, d):
    return sp.holdout_split(_frame(spark, d), test_size=0.2, purge=1)


@query("fit_scores_trees")
def _(spark, d):
    return present(gm.fit_scores(_held_out(spark, d), FEATURES).select("symbol", "date", "target", "predicted"))


@query("fit_scores_trees_boosted")
def _(spark, d):
    return present(gm.fit_scores(_held_out(spark, d), FEATURES, family="boosted").select("symbol", "date", "target", "predicted"))


@query("fit_scores_trees_checks", sql("bars", """SELECT symbol, CAST(date AS VARCHAR) AS date, round(target, 6) AS target,
    true AS within_training_range FROM (SELECT *, CAST(floor(n * (1 - 0.2e0)) AS BIGINT) AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM tf))
    WHERE s - 1 > 0 AND s < n AND i >= s""", **_TRAIN))
def _(spark, d):
    # a forest's prediction is a mean of training targets of its symbol
    frame = _held_out(spark, d)
    train = frame.where("role = 'train'").groupBy("symbol").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    scored = gm.fit_scores(frame, FEATURES).join(train, "symbol", "left")
    return present(scored.select("symbol", "date", "target", F.coalesce(
        F.col("predicted").between(F.col("lo") - 1e-12, F.col("hi") + 1e-12), F.lit(False)).alias("within_training_range")))


@query("fit_scores_trees_pooled")
def _(spark, d):
    scored, _model = ml.fit_scores_trees(_held_out(spark, d), FEATURES, position="position")
    return present(scored.select("symbol", "date", "target", "predicted"))


# one tree of depth 2 a symbol, every split found again: cuts at the ranks ceil(k n / 16)
_SPLIT = """SELECT symbol, node, f, cut, n, mean FROM (SELECT *, row_number() OVER (PARTITION BY symbol, node ORDER BY gain DESC, f, cut) AS best FROM (
    SELECT symbol, node, f, cut, any_value(tn) AS n, any_value(ts) / any_value(tn) AS mean,
      sum(y) FILTER (x <= cut) * sum(y) FILTER (x <= cut) / count(*) FILTER (x <= cut)
      + sum(y) FILTER (x > cut) * sum(y) FILTER (x > cut) / count(*) FILTER (x > cut) AS gain
    FROM (SELECT *, count(*) OVER g AS tn, sum(y) OVER g AS ts FROM {} WINDOW g AS (PARTITION BY symbol, node, f)) JOIN cuts USING (symbol, f)
    GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (x <= cut) > 0 AND count(*) FILTER (x > cut) > 0)) WHERE best = 1"""


@query("tree_splits", sql("bars", """SELECT symbol, CAST(node AS BIGINT) AS node, CASE f WHEN 0 THEN 'roc_10' ELSE 'zscore_20' END AS feature,
    round(cut, 6) AS threshold, n AS rows, round(mean, 6) AS mean FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""", **_TRAIN,
    tr="""SELECT symbol, date, target AS y, roc_10, zscore_20 FROM (SELECT *, CAST(floor(n * (1 - 0.2e0)) AS BIGINT) AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM tf))
      WHERE s - 1 > 0 AND s < n AND i < s - 1""",
    lng="SELECT symbol, date, y, 0 AS f, roc_10 AS x FROM tr UNION ALL SELECT symbol, date, y, 1, zscore_20 FROM tr",
    cuts="""SELECT DISTINCT symbol, f, x AS cut FROM (SELECT *, row_number() OVER (PARTITION BY symbol, f ORDER BY x) AS r,
        count(*) OVER (PARTITION BY symbol, f) AS n, max(x) OVER (PARTITION BY symbol, f) AS top FROM lng)
      JOIN range(1, 16) AS k(k) ON r = (k * n + 15) // 16 WHERE x < top""",
    r0="SELECT *, 0 AS node FROM lng", one=_SPLIT.format("r0"),
    side="SELECT l.symbol, l.date, CASE WHEN x <= cut THEN 1 ELSE 2 END AS node FROM lng l JOIN one USING (symbol, f)",
    r1="SELECT l.*, node FROM lng l JOIN side USING (symbol, date)", two=_SPLIT.format("r1")))
def _(spark, d):
    return present(gm.tree_splits(_held_out(spark, d), ["roc_10", "zscore_20"], depth=2, bins=16))


@query("feature_importance")
def _(spark, d):
    return present(gm.mean_importance(gm.group_importance(_held_out(spark, d), FEATURES)))


@query("feature_importance_checks", sql("bars", """SELECT symbol, CAST(5 AS BIGINT) AS features, 1e0 AS total, true AS within_bounds
  FROM tf GROUP BY 1 HAVING CAST(floor(count(*) * (1 - 0.2e0)) AS BIGINT) - 1 > 0""", **_TRAIN))
def _(spark, d):
    shares = gm.group_importance(_held_out(spark, d), FEATURES)
    return shares.groupBy("symbol").agg(F.countDistinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
                                        F.min(F.col("importance").between(0, 1)).alias("within_bounds"))


def _directions(spark, d, **how):
    frame = direction_label(_held_out(spark, d), threshold=how.pop("threshold", 0.0))
    return gm.fit_directions(frame, FEATURES, purge=1, **how)


@query("fit_direction_calibrated")
def _(spark, d):
    return present(_directions(spark, d).select("symbol", "date", "up", "probability"))


@query("fit_direction_boosted")
def _(spark, d):
    return present(_directions(spark, d, family="boosted").select("symbol", "date", "up", "probability"))


# few moves exceed the threshold, so some symbols lack support
@query("fit_direction_checks", sql("bars", """SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(target > 0.09e0 AS BIGINT) AS up, reason,
      reason IS NULL AS calibrated FROM held JOIN why USING (symbol) WHERE s - 1 > 0 AND s < n AND i >= s""", **_TRAIN,
    held="""SELECT *, CAST(floor(n * (1 - 0.2e0)) AS BIGINT) AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM tf)""",
    why="""SELECT symbol, CASE WHEN any_value(st) - 1 < 20 THEN 'insufficient_rows'
        WHEN least(count(*) FILTER (i < st - 1 AND target > 0.09e0), count(*) FILTER (i < st - 1 AND target <= 0.09e0)) < 5 THEN 'base_class_support'
        WHEN least(count(*) FILTER (i >= st AND target > 0.09e0), count(*) FILTER (i >= st AND target <= 0.09e0)) < 5 THEN 'calibration_class_support' END AS reason
      FROM (SELECT *, m - greatest(20, CAST(floor(m * 0.2e0) AS BIGINT)) AS st FROM (SELECT *, s - 1 AS m FROM held WHERE i < s - 1)) GROUP BY 1"""))
def _(spark, d):
    rows = _directions(spark, d, threshold=0.09)
    return present(rows.select("symbol", "date", "up", "reason", F.coalesce(F.col("probability").between(0, 1), F.lit(False)).alias("calibrated")))


@query("fit_direction_pooled")
def _(spark, d):
    frame = direction_label(_held_out(spark, d))
    train = sp.calibration_split(frame.where("role = 'train'"), label="up", keys=["symbol"], purge=1)
    parts = train.where("part IN ('base', 'calibration')").drop("reason").unionByName(
        frame.where("role = 'test'").withColumn("part", F.lit("score")))
    out = ml.fit_direction_calibrated(parts, FEATURES, position="position")
    return present(out.select("symbol", "date", "up", "probability"))


@query("forward_gate", sql("bars uni req", """SELECT run_id, CASE WHEN count(DISTINCT latest) = 1 THEN CAST(max(latest) AS VARCHAR) END AS as_of,
    CASE WHEN count(DISTINCT latest) <> 1 THEN 'no common latest date' END AS issue
  FROM req JOIN (SELECT symbol, max(date) AS latest FROM bars GROUP BY 1) USING (symbol) GROUP BY 1"""))
def _(spark, d):
    frame = feature_frame(spark, d)
    req = run_requests(spark, d).select("run_id", "symbol")
    return present(ml.forward_gate(frame, req, target="open_to_open", horizon=1))


@query("forward_scores")
def _(spark, d):
    frame = feature_frame(spark, d).dropna(subset=FEATURES)
    # a run per brand and one over all brands; the latter mostly lacks a common date
    brands = universe_of(spark, d).select("symbol")
    req = brands.select(F.col("symbol").alias("run_id"), "symbol").unionByName(
        brands.select(F.lit("all").alias("run_id"), "symbol"))
    scores, _gate = ml.forward_scores(_frame(spark, d), frame, req, FEATURES)
    return present(scores)


def opinion_requests(spark, d):
    """A run for each brand and for every fourth brand, one whose basis date is no bar's, one with a strange symbol."""
    brands = universe_of(spark, d)
    basis = F.lit(None).cast("date")
    own = brands.select("symbol", "symbol", "position", basis)
    quarter = brands.select(F.concat(F.lit("mod-"), F.col("position") % 4), "symbol", "position", basis)
    late = brands.where("position = 0").select(F.lit("late"), "symbol", "position", F.lit("1990-01-01").cast("date"))
    strange = brands.where("position < 2").select(F.lit("strange"), F.when(F.col("position") == 0, F.col("symbol")).otherwise("?"), "position", basis)
    every = own
    for more in (quarter, late, strange):
        every = every.union(more)
    return every.toDF("run_id", "symbol", "position", "basis_date")


def _opinions(spark, d):
    frame = feature_frame(spark, d).dropna(subset=FEATURES)
    return rn.forward_opinions(_frame(spark, d), frame, opinion_requests(spark, d), FEATURES, top_n=3)


_OPINIONS = {**_TRAIN, "ft": "SELECT * FROM fs WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES),
             "latest": "SELECT symbol, max(date) AS latest FROM ft GROUP BY 1",
             "oreq": """SELECT symbol AS run_id, symbol, NULL::DATE AS basis FROM uni UNION ALL SELECT 'mod-' || (position % 4), symbol, NULL FROM uni
               UNION ALL SELECT 'late', symbol, DATE '1990-01-01' FROM uni WHERE position = 0
               UNION ALL SELECT 'strange', CASE WHEN position = 0 THEN symbol ELSE '?' END, NULL FROM uni WHERE position < 2""",
             "sup": """SELECT symbol, CASE WHEN any_value(n - t) - 1 < 20 THEN 'insufficient_rows'
                 WHEN least(count(*) FILTER (i < n - t - 1 AND target > 0), count(*) FILTER (i < n - t - 1 AND target <= 0)) < 5 THEN 'base_class_support'
                 WHEN least(count(*) FILTER (i >= n - t AND target > 0), count(*) FILTER (i >= n - t AND target <= 0)) < 5 THEN 'calibration_class_support' END AS reason
               FROM (SELECT *, greatest(20, CAST(floor(n * 0.2e0) AS BIGINT)) AS t FROM (SELECT symbol, target,
                 row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM tf)) GROUP BY 1""",
             "gate": """SELECT run_id, CASE WHEN issue IS NULL THEN latest END AS as_of, issue FROM (SELECT run_id, max(latest) AS latest,
                 CASE WHEN count(*) FILTER (latest IS NULL) > 0 THEN 'symbols do not match the universe'
                   WHEN count(DISTINCT latest) <> 1 THEN 'no common latest date'
                   WHEN min(basis) <> max(latest) THEN 'basis date is not the latest feature date'
                   WHEN count(reason) > 0 THEN min('[' || symbol || '] direction is not calibrated: ' || reason ORDER BY symbol) FILTER (reason IS NOT NULL)
                 END AS issue
               FROM oreq LEFT JOIN latest USING (symbol) LEFT JOIN sup USING (symbol) GROUP BY 1)"""}


@query("forward_opinion_gate", sql("bars uni", "SELECT run_id, CAST(as_of AS VARCHAR) AS as_of, issue FROM gate", **_OPINIONS))
def _(spark, d):
    return present(_opinions(spark, d)[1])


@query("forward_opinions")
def _(spark, d):
    return present(_opinions(spark, d)[0])


@query("forward_opinion_checks", sql("bars uni", """SELECT run_id, symbol, CAST(as_of AS VARCHAR) AS date, 'forward_opinion' AS signal_kind,
    true AS sound FROM oreq JOIN gate USING (run_id) WHERE issue IS NULL""", **_OPINIONS))
def _(spark, d):
    # positions only where score and probability allow them, equal over at most three symbols
    rows = _opinions(spark, d)[0]
    many = rows.groupBy("run_id", "date").agg(F.sum(F.when(F.col("position") > 0, 1).otherwise(0)).alias("n"))
    p, held = F.col("up_probability"), F.col("position") > 0
    sound = (p.between(0, 1) & (F.col("predicted_direction") == F.when(p >= 0.5, "up").otherwise("down")) & (F.col("n") <= 3)
             & F.when(held, (F.col("score") >= 0) & (p >= 0.5) & (F.abs(F.col("position") * F.col("n") - 1) < 1e-9)).otherwise(F.col("position") == 0))
    return present(rows.join(many, ["run_id", "date"]).select("run_id", "symbol", "date", "signal_kind", F.coalesce(sound, F.lit(False)).alias("sound")))


VALIDATED = ["zscore_10", "roc_5"]


def validation_requests(spark, d):
    """The runs over part types, and one that asks for a symbol nobody has."""
    runs = type_requests(spark, d)
    strange = runs.where("run_id = 'run-0'").select(F.lit("strange").alias("run_id"), "symbol", "position")
    return runs.unionByName(strange).unionByName(strange.limit(1).withColumn("symbol", F.lit("?")))


def _validated(spark, d, **how):
    specs = [Feature("zscore", 10, shift=1), Feature("roc", 5, shift=1)]
    frame = feature_set(type_bars(spark, d), specs, keep=("open",))
    frame = training_frame(forward_return_label(frame.withColumnsRenamed({s.column: n for s, n in zip(specs, VALIDATED, strict=True)})), VALIDATED)
    return rn.validate_runs(frame, validation_requests(spark, d), VALIDATED, top_n=2, fees=0.002, slippage=0.001, **how)


_ROWS = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_FOLDS = {**TYPE_REQ,
          "v0": f"""SELECT *, CASE WHEN count(close) OVER {_ROWS} = 10 THEN (close - avg(close) OVER {_ROWS})
            / nullif(stddev_samp(close) OVER {_ROWS}, 0) END AS z0, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r0 FROM tbars""",
          "v1": """SELECT symbol, date, lag(z0) OVER w AS z, lag(r0) OVER w AS r, lead(open) OVER w / open - 1 AS target FROM v0
            WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
          "v2": "SELECT * FROM v1 WHERE z IS NOT NULL AND r IS NOT NULL AND target IS NOT NULL",
          "cd": """SELECT run_id, date, row_number() OVER (PARTITION BY run_id ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY run_id) AS n
            FROM (SELECT run_id, date FROM v2 JOIN treq USING (symbol) JOIN (SELECT run_id, count(*) AS need FROM treq GROUP BY 1) USING (run_id)
            GROUP BY run_id, date HAVING count(*) = any_value(need))""",
          "fo": """SELECT run_id, f AS fold, symbol, target, idx, n - 3 * t + f * t - 1 AS m FROM (SELECT *, CAST(floor(n * 0.2e0) AS BIGINT) AS t FROM cd)
            CROSS JOIN range(3) AS r(f) JOIN treq USING (run_id) JOIN v2 USING (symbol, date) WHERE idx < n - 3 * t + f * t - 1""",
          "sup": """SELECT run_id, fold, symbol, CASE WHEN any_value(m - c) - 1 < 20 THEN 'insufficient_rows'
              WHEN least(count(*) FILTER (idx < m - c - 1 AND target > {0}), count(*) FILTER (idx < m - c - 1 AND target <= {0})) < 5 THEN 'base_class_support'
              WHEN least(count(*) FILTER (idx >= m - c AND target > {0}), count(*) FILTER (idx >= m - c AND target <= {0})) < 5 THEN 'calibration_class_support' END AS reason
            FROM (SELECT *, greatest(20, CAST(floor(m * 0.2e0) AS BIGINT)) AS c FROM fo) GROUP BY 1, 2, 3""",
          "why": """SELECT run_id, issue AS status_reason FROM (SELECT run_id, fold, min('[' || symbol || '] direction is not calibrated: ' || reason ORDER BY symbol)
              FILTER (reason IS NOT NULL) AS issue FROM sup GROUP BY 1, 2) WHERE issue IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY fold) = 1"""}
_STATUS = """SELECT run_id, CASE WHEN reason IS NULL THEN 'evaluated' ELSE 'not_evaluated' END AS evaluation_status, reason AS status_reason,
    reason IS NULL AS has_metrics FROM (
      SELECT run_id, CASE WHEN n IS NULL THEN 'no dates in common' WHEN floor(n * 0.2e0) <= 0 THEN 'test_size too small'
        WHEN n - 3 * floor(n * 0.2e0) - 1 <= 0 THEN 'no training data after purge' ELSE status_reason END AS reason
      FROM (SELECT DISTINCT run_id FROM treq) LEFT JOIN (SELECT run_id, any_value(n) AS n FROM cd GROUP BY 1) USING (run_id) LEFT JOIN why USING (run_id)
      UNION ALL SELECT 'strange', 'symbols do not match the universe')"""


def _status_sql(positive):
    return sql("tbars", _STATUS, **{**_FOLDS, "sup": _FOLDS["sup"].format(positive)})


def _status(summary):
    has = F.col("total_return").isNotNull() & F.col("sharpe").isNotNull() & F.col("max_drawdown").between(-1, 0)
    return present(summary.select("run_id", "evaluation_status", "status_reason", has.alias("has_metrics")))


@query("validation_runs", _status_sql("0e0"))
def _(spark, d):
    return _status(_validated(spark, d)[0])


# moves above the threshold are rare, so folds lack support and their runs have no metrics
@query("validation_runs_unsupported", _status_sql("0.05e0"))
def _(spark, d):
    return _status(_validated(spark, d, positive=0.05)[0])


@query("validation_metrics")
def _(spark, d):
    return present(_validated(spark, d)[0])


CLUSTERED = ["close", "volume", "event_count_30d"]


@query("cluster_snapshot", sql("bars", """SELECT 'TW' AS market, CAST(date AS VARCHAR) AS date, symbol, cluster, round(distance, 6) AS distance
    FROM snap""", **_SRC, **FRAME_SQL, wide="SELECT * FROM fr WHERE date IN (SELECT date FROM fr GROUP BY 1 HAVING count(*) >= 2)",
    **snapshots_sql("wide", CLUSTERED, clusters=3)))
def _(spark, d):
    return present(cluster_snapshots(cluster_rows(spark, d), CLUSTERED, clusters=3))


@query("cluster_snapshot_pooled")
def _(spark, d):
    rows = cluster_rows(spark, d)
    one = rows.join(rows.agg(F.max("date").alias("date")), "date", "left_semi")
    return present(ml.cluster_snapshot(one, CLUSTERED, clusters=3))
