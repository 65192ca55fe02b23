"""Model diagnostics as grouped aggregates over (run_id, actual, predicted).

Rank statistics use bucketed running totals, so one run's predictions never sit
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import count_true, finite, ratio, ratio_or_zero
from barloom.functions.prefix import running_totals
from barloom.sources.shared import cut_lineage

RUN = ("run_id",)


def _pairs(points: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    return points.select(*keys, finite(a).alias(a), finite(b).alias(b)).dropna(subset=[a, b])


def regression_diagnostics(points: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, n, rmse, mae) over rows with both values."""
    e = F.col("actual") - F.col("predicted")
    return _pairs(points, "actual", "predicted", keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"))


def residuals(points: DataFrame) -> DataFrame:
    both = finite("actual").isNotNull() & finite("predicted").isNotNull()
    return points.where(both).withColumn("residual", F.col("actual") - F.col("predicted"))


def linear_ic(points: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    return _pairs(points, "actual", "predicted", keys).groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 1, finite(F.corr("actual", "predicted"))).alias("linear_ic"))


def rank_ic(points: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    """Spearman correlation, tied values sharing their average rank.

    Equal (actual, predicted) pairs collapse first. Both sides are ranked in one pass, as
    two groups of a run; their mean is (n+1)/2, so the correlation needs plain sums only.
    """
    keys = list(keys)
    pairs = _pairs(points, "actual", "predicted", keys)
    weighted = cut_lineage(pairs.groupBy(*keys, "actual", "predicted").agg(
        F.count(F.lit(1)).alias("_n")))
    sides = weighted.select(*keys, "_n", F.inline(F.array(*[
        F.struct(F.lit(side).alias("_side"), F.col(c).cast("double").alias("_v"))
        for side, c in enumerate(("actual", "predicted"))])))
    totals = running_totals(sides, keys=[*keys, "_side"], order="_v", sums={"n": F.sum("_n")})
    # twice the distance of a tie's mean position from the middle of all positions
    off = (2 * F.col("n_before") + F.col("n") - F.col("n_all")) / F.lit(2.0)
    places = totals.select(*keys, "_side", "_v", off.alias("_off"))

    def of(side: int, value: str, name: str) -> DataFrame:
        return places.where(F.col("_side") == side).select(
            *keys, F.col("_v").alias(value), F.col("_off").alias(name))

    j = weighted.join(of(0, "actual", "_x"), [*keys, "actual"]).join(
        of(1, "predicted", "_y"), [*keys, "predicted"])
    x, y, n = F.col("_x"), F.col("_y"), F.col("_n")
    return j.groupBy(*keys).agg(F.when(F.sum(n) > 1, finite(ratio(
        F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y)))))
        .alias("rank_ic"))


def confusion_and_pr(points: DataFrame, *, threshold: float | Column = 0.5,
                     keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, n, tn, fp, fn, tp, precision, recall, prevalence)."""
    y, hat = F.col("actual") == 1, F.col("probability") >= threshold
    c = _pairs(points, "actual", "probability", keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), count_true(~y & ~hat).alias("tn"),
        count_true(~y & hat).alias("fp"), count_true(y & ~hat).alias("fn"),
        count_true(y & hat).alias("tp"))
    return (c.withColumn("precision", ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")))
            .withColumn("recall", ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn")))
            .withColumn("prevalence", ratio_or_zero(F.col("tp") + F.col("fn"), F.col("n"))))


def _score_steps(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    y = F.col("actual")
    return running_totals(
        _pairs(points, "actual", "probability", keys), keys=keys, order="probability",
        sums={"pos": F.sum(F.when(y == 1, 1).otherwise(0)),
              "neg": F.sum(F.when(y == 1, 0).otherwise(1))})


def roc_auc(points: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    """Area under ROC, ties counted half; NULL unless both classes occur."""
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    return _score_steps(points, keys).groupBy(*keys).agg(
        ratio(area, F.max("pos_all") * F.max("neg_all").cast("double")).alias("roc_auc"))


def pr_auc(points: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    """Average precision in step form; NULL unless both classes occur."""
    hits = F.col("pos_all") - F.col("pos_before")
    called = hits + F.col("neg_all") - F.col("neg_before")
    step = ratio(F.col("pos"), F.col("pos_all")) * ratio(hits, called)
    return _score_steps(points, keys).groupBy(*keys).agg(
        F.when((F.max("pos_all") > 0) & (F.max("neg_all") > 0), F.sum(step)).alias("pr_auc"))


def brier(points: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    miss = F.col("probability") - F.col("actual")
    return _pairs(points, "actual", "probability", keys).groupBy(*keys).agg(
        F.avg(miss * miss).alias("brier"))


def diagnostics_completeness(requested: DataFrame, outputs: DataFrame) -> DataFrame:
    """(run_id, evaluation_status, status_reason).

    ``requested``: (run_id, symbol); ``outputs``: (run_id, symbol, rows, reason),
    one row per evaluated symbol, ``reason`` set when its model was unavailable.
    """
    joined = requested.join(outputs, ["run_id", "symbol"], "left")
    told = F.when(F.col("reason").isNotNull(), F.struct(
        "symbol", F.concat_ws(": ", F.col("symbol"), F.col("reason")).alias("text")))
    g = joined.groupBy("run_id").agg(
        F.concat_ws("; ", F.sort_array(F.collect_list(told))["text"]).alias("_told"),
        count_true(F.col("rows").isNull() & F.col("reason").isNull()).alias("_absent"),
        count_true(F.col("rows") == 0).alias("_empty"))
    reason = (F.when(F.col("_told") != "", F.col("_told"))
              .when(F.col("_absent") > 0,
                    "some requested symbols have no direction result")
              .when(F.col("_empty") > 0, "a symbol has no holdout row to judge"))
    return g.select("run_id", F.when(reason.isNull(), "evaluated").otherwise("not_evaluated")
                    .alias("evaluation_status"), reason.alias("status_reason"))


def holdout_confirmation(requested: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All probabilities of a run become NULL when any symbol has none.

    Returns (scores with the gated ``probability``, one warning row per such run).
    """
    have = scores.groupBy("run_id", "symbol").agg(F.count("probability").alias("_n"))
    missing = (requested.join(have, ["run_id", "symbol"], "left")
               .where(F.coalesce("_n", F.lit(0)) == 0)
               .groupBy("run_id").agg(F.sort_array(F.collect_set("symbol")).alias("_symbols")))
    warnings = missing.select("run_id", F.concat(
        F.lit("no probability of a rise for "), F.array_join("_symbols", ", "),
        F.lit(": the run takes no positions")).alias("warning"))
    gated = scores.join(missing, "run_id", "left").withColumn(
        "probability", F.when(F.col("_symbols").isNull(), F.col("probability"))).drop("_symbols")
    return gated, warnings


def fit_scores_ols(frame: DataFrame, *, feature: str, target: str, keys: Sequence[str]
                   ) -> DataFrame:
    """Test rows of ``frame`` (role train/test) with ``predicted`` from a line
    fitted on the train rows of the same keys.

    The fit is a window aggregate on the keys: train and test rows are read once
    and nothing is joined. A group is one symbol of one fold.
    """
    group = Window.partitionBy(*keys)
    train = F.col("role") == "train"
    y, x = F.when(train, F.col(target)), F.when(train, F.col(feature))
    fitted = frame.select("*", F.regr_slope(y, x).over(group).alias("_b"),
                          F.regr_intercept(y, x).over(group).alias("_a"))
    return (fitted.where("role = 'test' AND _b IS NOT NULL")
            .withColumn("predicted", F.col("_a") + F.col("_b") * F.col(feature))
            .drop("_a", "_b"))


def direction_label(frame: DataFrame, *, target: str = "target", threshold: float = 0.0,
                    name: str = "up") -> DataFrame:
    return frame.withColumn(name, (F.col(target) > threshold).cast("int"))


def validation_summary(plan: DataFrame, fold_metrics: DataFrame, metrics: Sequence[str]
                       ) -> DataFrame:
    """(run_id, evaluation_status, status_reason, mean of each metric).

    ``plan``: (run_id, fold, issue), every fold a run should have, ``issue``
    naming what already failed. Any failing fold makes the run not_evaluated,
    with the first reason by fold.
    """
    ok = F.lit(True)
    for m in metrics:
        ok = ok & finite(m).isNotNull()
    j = plan.join(fold_metrics.withColumn("_have", F.lit(True)), ["run_id", "fold"], "left")
    why = (F.when(F.col("issue").isNotNull(), F.col("issue"))
           .when(F.col("_have").isNull(), "a fold has no dates that all symbols share")
           .when(~ok, "a metric of a fold is absent or not finite"))
    g = j.withColumn("_why", why).groupBy("run_id").agg(
        F.min(F.when(F.col("_why").isNotNull(), F.struct("fold", "_why"))).alias("_first"),
        *[F.avg(m).alias(m) for m in metrics])
    failed = F.col("_first").isNotNull()
    return g.select(
        "run_id", F.when(failed, "not_evaluated").otherwise("evaluated").alias("evaluation_status"),
        F.col("_first._why").alias("status_reason"),
        *[F.when(~failed, F.col(m)).alias(m) for m in metrics])
