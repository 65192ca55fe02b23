"""Leakage-safe splits over dates, and bounded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import count_true

METHODS = ("holdout", "walk_forward", "expanding_window", "rolling_window")

# Calibration and audit sampling policy.
CALIBRATION_MIN_ROWS = 20
CALIBRATION_SHARE = 0.2
CALIBRATION_MIN_CLASS = 5
AUDIT_MIN_ROWS = 50
AUDIT_SHARE = 0.05
AUDIT_FALLBACK_ROWS = 20
DIAGNOSTIC_POINTS = 200


def trading_calendar(bars: DataFrame, *, keys: Sequence[str] = ("market",), start=None, end=None,
                     descending: bool = False, limit: int | None = None) -> DataFrame:
    """(keys, date, idx): distinct dates with their 0-based position."""
    dates = bars.select(*keys, "date")
    if start is not None:
        dates = dates.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        dates = dates.where(F.col("date") <= F.lit(end).cast("date"))
    ordering = F.col("date").desc() if descending else F.col("date").asc()
    order = Window.partitionBy(*keys).orderBy(ordering)
    out = dates.distinct().withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))
    return out if limit is None else out.where(F.col("idx") < limit)


def holdout_split(frame: DataFrame, *, test_size: float = 0.2, purge: int = 0,
                  keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The frame with ``role``: train, purged or test, by position per key.

    A key with too few rows gets NULL roles.
    """
    if not 0 < test_size < 1 or purge < 0:
        raise ValueError("test_size must be in (0, 1) and purge >= 0")
    group = Window.partitionBy(*keys)
    pos = F.row_number().over(group.orderBy("date")) - 1
    n = F.count(F.lit(1)).over(group)
    split = F.floor(n * F.lit(1 - test_size))
    valid = (split - purge > 0) & (split < n)
    role = (F.when(~valid, F.lit(None).cast("string"))
            .when(pos < split - purge, "train")
            .when(pos < split, "purged")
            .otherwise("test"))
    return frame.withColumn("role", role)


def fold_ranges(sizes: DataFrame, *, method: str, splits: int, test_size: float,
                purge: int = 0) -> DataFrame:
    """From (keys..., n): (keys..., fold, train_start, train_end, test_start,
    test_end, issue). Ends are exclusive; ``issue`` names what is too small."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if not 0 < test_size < 1 or splits < 1 or purge < 0:
        raise ValueError("bad split parameters")
    n = F.col("n").cast("bigint")
    test_len = F.floor(n * F.lit(test_size))
    folds = 1 if method == "holdout" else splits
    i = F.col("fold")
    spare = n - test_len * folds
    test_start = spare + i * test_len
    train_start = i * test_len if method == "rolling_window" else F.lit(0).cast("bigint")
    train_end = test_start - purge
    ranged = (sizes.withColumn("fold", F.explode(F.sequence(
                  F.lit(0).cast("bigint"), F.lit(folds - 1).cast("bigint"))))
              .withColumn("train_start", train_start.cast("bigint"))
              .withColumn("train_end", train_end.cast("bigint"))
              .withColumn("test_start", test_start.cast("bigint"))
              .withColumn("test_end", (test_start + test_len).cast("bigint")))
    issue = (F.when(n <= 0, "no data")
             .when(test_len <= 0, "test_size too small")
             .when(n <= test_len * folds, "not enough data for splits")
             .when(F.col("train_end") <= F.col("train_start"), "no training data after purge"))
    return ranged.withColumn("issue", issue)


def fold_assignment(calendar: DataFrame, *, method: str, splits: int, test_size: float,
                    purge: int = 0, keys: Sequence[str] = ("market",)) -> DataFrame:
    """(keys, fold, date, role) for an indexed calendar (see trading_calendar).

    One row of ranges per (keys, fold) meets the calendar; a group with any
    issue yields no rows.
    """
    keys = list(keys)
    sizes = calendar.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ranges = fold_ranges(sizes, method=method, splits=splits, test_size=test_size, purge=purge)
    packed = ranges.groupBy(*keys).agg(
        F.collect_list(F.struct("fold", "train_start", "train_end", "test_start", "test_end"))
        .alias("_folds"), F.count("issue").alias("_issues")).where("_issues = 0")
    rows = calendar.join(packed, keys).select(*keys, "date", "idx", F.explode("_folds").alias("f"))
    idx = F.col("idx")
    role = (F.when((idx >= F.col("f.train_start")) & (idx < F.col("f.train_end")), "train")
            .when((idx >= F.col("f.test_start")) & (idx < F.col("f.test_end")), "test"))
    return rows.select(*keys, F.col("f.fold").alias("fold"), "date",
                       role.alias("role")).where(F.col("role").isNotNull())


def common_dates(bars: DataFrame, requested: DataFrame) -> DataFrame:
    """(run_id, date) present for every requested (run_id, symbol).

    Runs with a repeated (symbol, date) are not evaluated and yield no rows.
    """
    wanted = requested.select("run_id", "symbol").distinct()
    per_run = wanted.groupBy("run_id").agg(F.count(F.lit(1)).alias("_need"))
    counts = (bars.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("_copies"))
              .join(wanted, "symbol")
              .groupBy("run_id", "date")
              .agg(F.count(F.lit(1)).alias("_have"), F.max("_copies").alias("_copies")))
    repeated = counts.where("_copies > 1").select("run_id").distinct()
    return (counts.join(per_run, "run_id").where("_have = _need")
            .join(repeated, "run_id", "left_anti")
            .select("run_id", "date"))


def calibration_split(frame: DataFrame, *, label: str, keys: Sequence[str],
                      purge: int = 0) -> DataFrame:
    """The frame with ``part`` (base, purged, calibration) and ``reason``.

    The chronological tail calibrates. ``reason`` is set, and part is NULL, when
    either part is too small or lacks one of the classes.
    """
    group = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(group)
    tail = F.greatest(F.lit(CALIBRATION_MIN_ROWS), F.floor(n * F.lit(CALIBRATION_SHARE)))
    numbered = frame.select(
        "*", (F.row_number().over(group.orderBy("date")) - 1).alias("_i"),
        (n - tail).alias("_start"))
    base_end = F.col("_start") - purge
    part = (F.when(F.col("_i") < base_end, "base")
            .when(F.col("_i") < F.col("_start"), "purged").otherwise("calibration"))
    parted = numbered.withColumn("part", part)

    def least_class(which: str) -> Column:
        hit = F.col("part") == which
        pos = F.sum(F.when(hit & (F.col(label) == 1), 1).otherwise(0)).over(group)
        neg = F.sum(F.when(hit & (F.col(label) == 0), 1).otherwise(0)).over(group)
        return F.least(pos, neg)

    reason = (F.when(base_end < CALIBRATION_MIN_ROWS, "insufficient_rows")
              .when(least_class("base") < CALIBRATION_MIN_CLASS, "base_class_support")
              .when(least_class("calibration") < CALIBRATION_MIN_CLASS,
                    "calibration_class_support"))
    return (parted.withColumn("reason", reason)
            .withColumn("part", F.when(F.col("reason").isNull(), F.col("part")))
            .drop("_i", "_start"))


def audit_sample(signals: DataFrame, *, keys: Sequence[str] = ("source_family", "market")
                 ) -> DataFrame:
    """max(50, 5 %) rows per key: up to 20 fallback rows first, then by date.

    ``reason`` is fallback_first or fill. Ranks are limited before the shuffle,
    so a hot key sends at most its target from each task.
    """
    keys = list(keys)
    sizes = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        count_true(F.col("availability_mode") == "fallback").alias("_fallback"))
    target = F.least(F.col("_n"), F.greatest(F.lit(AUDIT_MIN_ROWS),
                                             F.ceil(F.col("_n") * F.lit(AUDIT_SHARE))))
    sizes = sizes.select(*keys, target.alias("_target"),
                         F.least(F.lit(AUDIT_FALLBACK_ROWS), "_fallback", target).alias("_first"))
    fallback = (signals.where(F.col("availability_mode") == "fallback")
                .withColumn("_rk", F.row_number().over(
                    Window.partitionBy(*keys).orderBy("effective_date", "id")))
                .where(F.col("_rk") <= AUDIT_FALLBACK_ROWS)
                .select(*keys, "id"))
    marked = signals.join(fallback.withColumn("_early", F.lit(True)), [*keys, "id"], "left")
    # The chosen fallback rows sort first, so one running position serves both caps.
    ranked = _ranked_within(marked, keys)
    return (ranked.join(sizes, keys).where(F.col("_rk") <= F.col("_target"))
            .withColumn("reason", F.when(F.col("_early").isNotNull(), "fallback_first")
                        .otherwise("fill"))
            .drop("_rk", "_target", "_first", "_early"))


def _ranked_within(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1-based rank by (chosen first, date, id), numbered month by month."""
    bucket = F.when(F.col("_early").isNotNull(), F.lit(-1)).otherwise(
        F.months_between(F.trunc("effective_date", "month"), F.lit("1900-01-01").cast("date"))
        .cast("int"))
    sliced = marked.withColumn("_slice", bucket)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_slice",
                           F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_s"))
    local = sliced.withColumn("_loc", F.row_number().over(
        Window.partitionBy(*keys, "_slice").orderBy("effective_date", "id")))
    return (local.join(starts, [*keys, "_slice"])
            .withColumn("_rk", F.col("_s") + F.col("_loc")).drop("_slice", "_s", "_loc"))


def bounded_diagnostic_sample(points: DataFrame, *, limit: int = DIAGNOSTIC_POINTS,
                              order: Sequence[str] = ("date", "symbol")) -> DataFrame:
    """The last ``limit`` points by date (top-k per task, then merged)."""
    return points.orderBy(*[F.col(c).desc() for c in order]).limit(limit)
