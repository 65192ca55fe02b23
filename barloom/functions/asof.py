"""Point-in-time lookups as a carry-forward over one sorted union.

A row of ``left`` takes the values of the last ``right`` row of its key at or
before its own instant. No pairs are formed. Keys are cut into time slices:
each (key, slice) is its own task and one row per slice carries the last known
values on, so a key with a third of all rows is still spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_last(left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_at: str,
              right_at: str, values: Sequence[str], right_tie: Sequence[str] = (),
              slice_by=None, strict: bool = False) -> DataFrame:
    """``left`` plus ``values`` from the latest ``right`` row (NULL when none).

    ``right_tie`` orders right rows with equal times; ``strict`` takes only rows
    before the left time; ``slice_by`` maps the time column to a slice that
    never decreases with it (default: the month).
    """
    keys, tie = list(keys), [f"_t{i}" for i in range(len(right_tie))]
    slice_by = slice_by or (lambda c: F.trunc(c.cast("date"), "month"))
    r = right.select(
        *keys, F.col(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"),
        *[F.col(c).alias(t) for c, t in zip(right_tie, tie)],
        F.struct(*values).alias("_v"))
    carried = [c for c in left.columns if c not in keys]
    q = left.select(*keys, F.col(left_at).alias("_at"),
                    F.lit(0 if strict else 1).alias("_side"), F.struct(*carried).alias("_q"))
    both = r.unionByName(q, allowMissingColumns=True).withColumn("_slice", slice_by(F.col("_at")))
    order = ["_at", "_side", *tie]
    local = both.withColumn("_lv", F.last("_v", ignorenulls=True).over(
        Window.partitionBy(*keys, "_slice").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)))
    ends = both.groupBy(*keys, "_slice").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    ends = ends.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)).alias("_in"))
    found = local.where(F.col("_q").isNotNull()).join(ends, [*keys, "_slice"], "left")
    v = F.coalesce(F.col("_lv"), F.col("_in"))
    return found.select(*keys, "_q.*", *[v[c].alias(c) for c in values])


def interval_counts(intervals: DataFrame, *, keys: Sequence[str], start: str, end: str
                    ) -> DataFrame:
    """(keys, at, open): number of [start, end) intervals open from ``at`` on.

    A NULL end never closes. One row per change, from sums of +1 and -1.
    """
    keys = list(keys)
    steps = intervals.where(F.col(end).isNull() | (F.col(end) > F.col(start))).select(
        *keys, F.explode(F.array_compact(F.array(
            F.struct(F.col(start).alias("at"), F.lit(1).alias("step")),
            F.when(F.col(end).isNotNull(),
                   F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))))).alias("s"))
    changes = steps.groupBy(*keys, F.col("s.at").alias("at")).agg(F.sum("s.step").alias("_n"))
    running: Column = F.sum("_n").over(Window.partitionBy(*keys).orderBy("at").rowsBetween(
        Window.unboundedPreceding, 0))
    return changes.select(*keys, "at", running.alias("open"))
