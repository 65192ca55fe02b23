"""Ordered running totals that do not put a whole group in one task.

``Window.partitionBy(run)`` over every prediction of a run sends that run to a
single task. Here each group is first collapsed to distinct ordering values
(map-side combined), then cut into ranges of about ``bucket_rows`` values at
sketched quantiles. A window runs per (group, range); one short row per range carries
the total of the ranges before it. Results are exact: the cuts only decide where work
is placed. A sketch depends on the order in which its parts arrive, so the cuts are
stored before their two readers use them: a task that runs again places its rows as
before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.sources.shared import cut_lineage

BUCKET_ROWS = 1 << 16
MOST_BUCKETS = 1024
SALTS = 16


def _cut_points(order: str, n: Column, buckets: int, bucket_rows: int) -> Column:
    """At most ``buckets`` - 1 quantiles of a group, so many that ``bucket_rows`` values lie between."""
    grid = F.percentile_approx(F.col(order), [i / buckets for i in range(1, buckets)], 10 * buckets)
    wanted = F.least(F.lit(buckets), F.ceil(n / F.lit(bucket_rows))).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1))), lambda i: F.get(
        grid, F.floor(i * F.lit(buckets) / wanted).cast("int") - 1))
    return F.when(wanted > 1, F.array_distinct(chosen)).otherwise(F.slice(grid, 1, 0))


def running_totals(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    buckets: int = MOST_BUCKETS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Per distinct ``order`` value: each sum, and its total over smaller values.

    Output: keys, order, and for each name ``s``: ``s``, ``s_before``, ``s_all``.
    Rows with a NULL key or order are left out. The collapsed rows and the cuts are
    stored, so ``df`` is computed once. Values find their group's cuts by (key, salt):
    a group with most of the values is read by ``SALTS`` tasks where the cuts are too
    many to broadcast.
    """
    keys = list(keys)
    names = list(sums)
    known = df.dropna(subset=[*keys, order])
    steps = cut_lineage(known.groupBy(*keys, order).agg(*[sums[s].alias(s) for s in names]))
    cuts = cut_lineage(steps.groupBy(*keys).agg(
        _cut_points(order, F.count(F.lit(1)), buckets, bucket_rows).alias("_cuts"),
        *[F.sum(s).alias(f"{s}_all") for s in names]))
    salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = steps.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int")).join(
        salted, [*keys, "_salt"]).select(
        *keys, order, *names, *[f"{s}_all" for s in names],
        F.size(F.filter("_cuts", lambda c: c < F.col(order))).alias("_bucket"))
    per_bucket = placed.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(s) for s in names])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}_off") for s in names])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = placed.select(
        *keys, "_bucket", order, *names, *[f"{s}_all" for s in names],
        *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_{s}_loc") for s in names])
    return local.join(offsets, [*keys, "_bucket"]).select(
        *keys, order, *names,
        *[(F.col(f"_{s}_loc") + F.col(f"_{s}_off")).alias(f"{s}_before") for s in names],
        *[f"{s}_all" for s in names])


def positions(df: DataFrame, *, keys: Sequence[str], order: Sequence[str],
              slice_by: Column, name: str = "pos") -> DataFrame:
    """0-based position per key, computed slice by slice.

    ``slice_by`` must be non-decreasing in the ordering (e.g. the month of the
    date). A key with very many rows is then numbered by many tasks.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_by)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    local = sliced.withColumn("_loc", F.row_number().over(
        Window.partitionBy(*keys, "_slice").orderBy(*order)))
    return (local.join(starts, [*keys, "_slice"])
            .withColumn(name, (F.col("_start") + F.col("_loc") - 1).cast("bigint"))
            .drop("_slice", "_loc", "_start"))


def chunked(df: DataFrame, *, keys: Sequence[str], pos: str, chunk_rows: int,
            before: int = 0, after: int = 0) -> DataFrame:
    """Cut each series into chunks, repeating the context rows a window needs.

    Adds ``_chunk`` and ``_own`` (false for context copies). Windows over
    (keys, _chunk) then see ``before`` earlier and ``after`` later rows.
    """
    if before > chunk_rows or after > chunk_rows:
        raise ValueError("context must not exceed chunk_rows")
    home = F.floor(F.col(pos) / chunk_rows)
    offset = F.col(pos) % chunk_rows
    targets = F.array_compact(F.array(
        home,
        F.when(offset >= chunk_rows - before, home + 1),
        F.when((offset < after) & (home > 0), home - 1)))
    return (df.withColumn("_home", home)
            .withColumn("_chunk", F.explode(targets))
            .withColumn("_own", F.col("_chunk") == F.col("_home"))
            .drop("_home"))


def exact_percentiles(df: DataFrame, *, keys: Sequence[str], value: str,
                      quantiles: Mapping[str, float]) -> DataFrame:
    """(keys, n, one column per quantile), linear between order statistics.

    Uses running totals over distinct values, so no aggregation buffer holds
    every value of a group.
    """
    totals = running_totals(df.where(F.col(value).isNotNull()), keys=keys, order=value,
                            sums={"n": F.count(F.lit(1))})
    v, lo_edge, hi_edge = F.col(value), F.col("n_before"), F.col("n_before") + F.col("n")
    out = [F.max("n_all").cast("bigint").alias("n")]
    for name, p in quantiles.items():
        at = (F.col("n_all") - 1) * F.lit(float(p))

        def pick(i: Column) -> Column:
            return F.max(F.when((i >= lo_edge) & (i < hi_edge), v))

        low, high = pick(F.floor(at)), pick(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return totals.groupBy(*keys).agg(*out)
