"""Clusters of all cross-sections at once.

A cross-section is one (market, date). All of them are standardised, seeded and clustered
by window aggregates over that one key, so every date of every market is one plan with
one shuffle and no model is fitted on the driver. The window of a key holds the symbols of
a universe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ROUNDS = 10
DIGITS = 9
GROUP = ("market", "date")


def _square(z: Sequence[str], centre: str) -> Column:
    """Rounded, so that ties of symmetric points do not hang on the order of a sum."""
    return F.round(sum(((F.col(c) - F.col(centre)[i]) * (F.col(c) - F.col(centre)[i]) for i, c in enumerate(z)), F.lit(0.0)), DIGITS)


def standardised(frame: DataFrame, columns: Sequence[str], keys: Sequence[str] = GROUP) -> DataFrame:
    """The frame with _z0, _z1, ...: each column less its mean over its population deviation, 0
    where it is constant or missing."""
    group = Window.partitionBy(*keys)
    z = [F.try_divide(F.col(c) - F.avg(c).over(group), F.when(F.stddev_pop(c).over(group) != 0, F.stddev_pop(c).over(group))) for c in columns]
    return frame.withColumns({f"_z{i}": F.coalesce(v, F.lit(0.0)) for i, v in enumerate(z)})


def cluster_snapshots(frame: DataFrame, columns: Sequence[str], *, clusters: int, rounds: int = ROUNDS) -> DataFrame:
    """(market, date, symbol, cluster, distance) for every cross-section of ``frame``.

    The first seed is the symbol farthest from the mean, each next one that farthest from the
    seeds so far, ties by symbol; symbols that equal a seed add none, so there are no more
    clusters than distinct points. Then ``rounds`` times each symbol goes to its nearest
    centre (ties to the earlier one) and each centre to the mean of its symbols. Every
    symbol is at last with its nearest centre and ``distance`` away from it.
    """
    if clusters < 1 or rounds < 0:
        raise ValueError("clusters must be at least 1 and rounds not negative")
    group = Window.partitionBy(*GROUP)
    z = [f"_z{i}" for i in range(len(columns))]
    centres = [f"_c{j}" for j in range(clusters)]
    df = standardised(frame.select(*GROUP, "symbol", *columns), columns).select(*GROUP, "symbol", *z)
    far = F.round(sum((F.col(c) * F.col(c) for c in z), F.lit(0.0)), DIGITS)
    for j, c in enumerate(centres):
        # the least of (-distance, symbol) is the farthest, the first by name of those
        first = F.min(F.struct((-F.col("_far")).alias("d"), F.col("symbol"), F.array(*z).alias("z"))).over(group)
        df = df.withColumn("_far", far).withColumn("_first", first)
        seed = F.col("_first.z") if j == 0 else F.when(F.col("_first.d") < 0, F.col("_first.z"))
        df = df.withColumn(c, seed).drop("_first")
        far = F.least(F.col("_far"), _square(z, c)) if j else _square(z, c)
    df = df.drop("_far")

    def assigned(df: DataFrame) -> DataFrame:
        squares = F.array(*[_square(z, c) for c in centres])
        return df.withColumn("_d", squares).withColumn("cluster", F.array_position("_d", F.array_min("_d")) - 1)

    for _ in range(rounds):
        df = assigned(df)
        means = {c: F.array(*[F.avg(F.when(F.col("cluster") == j, F.col(v))).over(group) for v in z]) for j, c in enumerate(centres)}
        df = df.select(*GROUP, "symbol", *z, *[F.col(c).alias(f"{c}_old") for c in centres], *[m.alias(c) for c, m in means.items()])
        df = df.select(*GROUP, "symbol", *z, *[F.when(F.col(c)[0].isNotNull(), F.col(c)).otherwise(F.col(f"{c}_old")).alias(c) for c in centres])
    return assigned(df).select(*GROUP, "symbol", "cluster", F.sqrt(F.array_min("_d")).alias("distance"))


def snapshots_sql(source: str, columns: Sequence[str], *, clusters: int, rounds: int = ROUNDS) -> dict[str, str]:
    """The same as SQL fragments over ``source`` (date, symbol, columns); the last one is ``snap``."""
    z = [f"z{i}" for i in range(len(columns))]
    w = "OVER (PARTITION BY date)"
    std = ", ".join(f"coalesce(({c} - avg({c}) {w}) / nullif(stddev_pop({c}) {w}, 0), 0) AS {v}" for c, v in zip(columns, z, strict=True))
    out = {"k0": f"SELECT date, symbol, {std} FROM {source}"}

    def square(j: int) -> str:
        return "round(" + " + ".join(f"({v} - c{j}_{i}) * ({v} - c{j}_{i})" for i, v in enumerate(z)) + f", {DIGITS})"

    far = "round(" + " + ".join(f"{v} * {v}" for v in z) + f", {DIGITS})"
    for j in range(clusters):
        pick = ", ".join(f"first_value({v}) OVER (PARTITION BY date ORDER BY far DESC, symbol) AS p{i}" for i, v in enumerate(z))
        out[f"s{j}"] = f"SELECT *, {pick}, max(far) {w} AS top FROM (SELECT *, {far} AS far FROM k{j})"
        seed = ", ".join((f"p{i}" if j == 0 else f"CASE WHEN top > 0 THEN p{i} END") + f" AS c{j}_{i}" for i in range(len(z)))
        out[f"k{j + 1}"] = f"SELECT * EXCLUDE (far, top, {', '.join(f'p{i}' for i in range(len(z)))}), {seed}{', far AS f' + str(j)} FROM s{j}"
        # least() leaves out the missing ones
        far = f"least({', '.join(square(i) for i in range(j + 1))})"
    kept = ", ".join(f"c{j}_{i}" for j in range(clusters) for i in range(len(z)))
    out["r0"] = f"SELECT date, symbol, {', '.join(z)}, {kept} FROM k{clusters}"
    squares = ", ".join(square(j) for j in range(clusters))
    nearest = f"SELECT *, list_position([{squares}], least({squares})) - 1 AS cluster, least({squares}) AS d FROM {{}}"
    for r in range(rounds):
        move = ", ".join(f"coalesce(avg({v}) FILTER (cluster = {j}) {w}, c{j}_{i}) AS c{j}_{i}" for j in range(clusters) for i, v in enumerate(z))
        out[f"r{r + 1}"] = f"SELECT date, symbol, {', '.join(z)}, {move} FROM ({nearest.format(f'r{r}')})"
    out["snap"] = f"SELECT date, symbol, CAST(cluster AS BIGINT) AS cluster, sqrt(d) AS distance FROM ({nearest.format(f'r{rounds}')})"
    return out
