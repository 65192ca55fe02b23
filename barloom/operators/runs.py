"""Whole research runs over the estimators: forward opinions and validation over folds.

Both fit one model for each symbol (and fold) of all runs in one plan, take weights
confirmed by the direction model, and fail closed: a run with any issue gives a reason and
no rows or metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import count_true, finite
from barloom.operators import group_models as gm, portfolio as pf, splits as sp
from barloom.operators.diagnostics import direction_label, validation_summary
from barloom.operators.features import label_lookahead
from barloom.operators.models import forward_gate
from barloom.sources.shared import cut_lineage

METRICS = ("total_return", "sharpe", "max_drawdown")


def _bad_output() -> Column:
    p = finite("probability")
    return finite("predicted").isNull() | p.isNull() | (p < 0) | (p > 1)


def _first_issue(rows: DataFrame, keys: Sequence[str], issue: Column) -> DataFrame:
    """(keys, issue): of the symbols with one, that of the first position."""
    return rows.withColumn("_issue", issue).where("_issue IS NOT NULL").groupBy(*keys).agg(
        F.min_by(F.concat(F.lit("["), "symbol", F.lit("] "), "_issue"), "position").alias("issue"))


def estimates(rows: DataFrame, features: Sequence[str], *, keys: Sequence[str], purge: int, threshold: float = 0.0, family: str = "bagged",
              direction_family: str | None = None, trees: int = gm.TREES, depth: int = gm.DEPTH) -> DataFrame:
    """Test rows of ``rows`` (role, target) with ``predicted``, ``probability`` and ``reason`` from
    the regressor and the calibrated direction of each key."""
    scored = gm.fit_scores(rows, features, keys=keys, family=family, trees=trees, depth=depth)
    labelled = direction_label(rows, threshold=threshold)
    told = gm.fit_directions(labelled, features, keys=keys, family=direction_family or family, trees=trees, depth=depth, purge=purge)
    return scored.join(told.select(*keys, "date", "probability", "reason"), [*keys, "date"])


def forward_opinions(labelled: DataFrame, prediction: DataFrame, requested: DataFrame, features: Sequence[str], *, target: str = "open_to_open",
                     horizon: int = 1, threshold: float | Column = 0.0, top_n: int | Column = 10, positive: float = 0.0,
                     confirmation: float = 0.5, family: str = "bagged", direction_family: str | None = None,
                     trees: int = gm.TREES, depth: int = gm.DEPTH) -> tuple[DataFrame, DataFrame]:
    """((run_id, date, symbol, score, position, signal_kind, up_probability, predicted_direction), gate).

    ``labelled`` has the training rows of all symbols with ``target``, ``prediction`` the feature
    rows up to the latest date; ``requested`` is (run_id, symbol, position) with an optional
    basis_date and columns that ``threshold`` and ``top_n`` may name. Each symbol is
    refitted on all its labelled rows and scored on its run's common latest date. ``gate``
    is (run_id, as_of, issue); a run has rows only without an issue: one latest date for
    every requested symbol, equal to its basis date if it has one, a target that looks
    ahead, a calibrated direction for every symbol, and finite outputs with a probability
    from 0 to 1.
    """
    requested = requested if "basis_date" in requested.columns else requested.withColumn("basis_date", F.lit(None).cast("date"))
    purge = label_lookahead(target, horizon)
    gate = forward_gate(prediction, requested.select("run_id", "symbol"), target=target, horizon=horizon)
    basis = requested.groupBy("run_id").agg(F.min("basis_date").alias("_low"), F.max("basis_date").alias("_high"))
    late = (F.col("_low") != F.col("as_of")) | (F.col("_high") != F.col("as_of"))
    gate = gate.join(basis, "run_id").select("run_id", "as_of", F.when(F.col("issue").isNotNull(), F.col("issue"))
                                             .when(late, "basis date is not the latest feature date").alias("issue"))
    gate = cut_lineage(gate)
    asked = requested.join(gate.where("issue IS NULL").select("run_id", F.col("as_of").alias("date")), "run_id")
    wanted = asked.select("symbol", "date").distinct()
    columns = ["symbol", "date", *features]
    train = labelled.join(wanted.select("symbol").distinct(), "symbol", "left_semi").select(*columns, "target", F.lit("train").alias("role"))
    test = prediction.join(wanted, ["symbol", "date"], "left_semi").select(
        *columns, F.lit(None).cast("double").alias("target"), F.lit("test").alias("role"))
    told = cut_lineage(estimates(train.unionByName(test), features, keys=["symbol"], purge=purge, threshold=positive, family=family,
                                 direction_family=direction_family, trees=trees, depth=depth).select("symbol", "date", "predicted", "probability", "reason"))
    rows = asked.join(told, ["symbol", "date"], "left")
    why = (F.when(F.col("reason").isNotNull(), F.concat(F.lit("direction is not calibrated: "), "reason"))
           .when(_bad_output(), "model output is not finite or no probability"))
    failed = _first_issue(rows, ["run_id"], why)
    gate = gate.join(failed.withColumnRenamed("issue", "_model"), "run_id", "left").select(
        "run_id", F.when(F.coalesce("issue", "_model").isNull(), F.col("as_of")).alias("as_of"), F.coalesce("issue", "_model").alias("issue"))
    good = rows.join(failed, "run_id", "left_anti").withColumn("score", F.col("predicted"))
    weights = pf.topn_weights(good, threshold=threshold, top_n=top_n, probabilities="probability", p_min=confirmation)
    return pf.signal_rows(good, weights, probabilities="probability", kind="forward_opinion", threshold=confirmation), gate


def fold_plan(frame: DataFrame, requested: DataFrame, *, method: str, splits: int, test_size: float, purge: int) -> tuple[DataFrame, DataFrame]:
    """((run_id, fold, issue), (run_id, fold, date, role)) on the dates all symbols of a run share.

    A run whose symbols are not all there, repeat a date, share no date or leave a fold
    too small has that issue and no dates.
    """
    have = frame.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("_c")).groupBy("symbol").agg(F.max("_c").alias("_copies"))
    universe = requested.select("run_id", "symbol").join(have, "symbol", "left").groupBy("run_id").agg(
        count_true(F.col("_copies").isNull()).alias("_absent"), count_true(F.col("_copies") > 1).alias("_twice"))
    calendar = sp.trading_calendar(sp.common_dates(frame, requested), keys=["run_id"])
    sizes = requested.select("run_id").distinct().join(calendar.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")), "run_id", "left").fillna({"n": 0})
    ranges = sp.fold_ranges(sizes, method=method, splits=splits, test_size=test_size, purge=purge)
    plan = ranges.join(universe, "run_id").select("run_id", "fold", F.when(F.col("_absent") > 0, "symbols do not match the universe")
                                                  .when(F.col("_twice") > 0, "a symbol repeats a date")
                                                  .when(F.col("n") == 0, "no dates in common").otherwise(F.col("issue")).alias("issue"))
    folds = sp.fold_assignment(calendar, method=method, splits=splits, test_size=test_size, purge=purge, keys=["run_id"])
    return plan, folds


def validate_runs(frame: DataFrame, requested: DataFrame, features: Sequence[str], *, method: str = "walk_forward", splits: int = 3,
                  test_size: float = 0.2, target: str = "open_to_open", horizon: int = 1, threshold: float | Column = 0.0,
                  top_n: int | Column = 10, positive: float = 0.0, confirmation: float = 0.5, fees: float = 0.0, slippage: float = 0.0,
                  family: str = "bagged", direction_family: str | None = None, trees: int = gm.TREES, depth: int = gm.DEPTH
                  ) -> tuple[DataFrame, DataFrame]:
    """(run_id, evaluation_status, status_reason, mean metrics) and the folds' (run_id, fold, date, symbol,
    position, target, prices, predicted, probability, reason).

    ``frame`` has symbol, date, the features, target and the price of ``target``; ``requested`` is
    (run_id, symbol, position) and what ``threshold`` and ``top_n`` name. Every run, fold and
    symbol is fitted and calibrated in one plan; a fold that can't be, or whose outputs or
    metrics are not finite, leaves its run not evaluated with the first reason by fold.
    """
    purge = label_lookahead(target, horizon)
    basis = "open" if target == "open_to_open" else "close"
    plan, folds = fold_plan(frame, requested, method=method, splits=splits, test_size=test_size, purge=purge)
    rows = folds.join(requested, "run_id").join(frame, ["symbol", "date"])
    keys = ["run_id", "fold", "symbol"]
    told = cut_lineage(estimates(rows, features, keys=keys, purge=purge, threshold=positive, family=family, direction_family=direction_family,
                                 trees=trees, depth=depth))
    why = (F.when(F.col("reason").isNotNull(), F.concat(F.lit("direction is not calibrated: "), "reason"))
           .when(_bad_output(), "model output is not finite or no probability")
           .when(finite(basis).isNull(), "price is missing"))
    failed = _first_issue(told, ["run_id", "fold"], why)
    plan = plan.join(failed.withColumnRenamed("issue", "_model"), ["run_id", "fold"], "left").select(
        "run_id", "fold", F.coalesce("issue", "_model").alias("issue"))
    pair = ["run_id", "fold"]
    weights = pf.topn_weights(told.withColumn("score", F.col("predicted")), threshold=threshold, top_n=top_n, probabilities="probability",
                              p_min=confirmation, keys=pair, keep=[basis])
    returns = pf.portfolio_returns(weights, return_target=target, fees=fees, slippage=slippage, keys=pair)
    metrics = pf.portfolio_metrics(pf.equity_curve(returns, keys=pair), keys=pair)
    return validation_summary(plan, metrics, METRICS), told
