"""Stored monitoring observations: versions per (profile, market), replaced whole.

A run that is stored owns the (profile, market) pairs it observed: its dates replace what
is stored and other dates go. A run with a profile and no observations at all clears its
own market. Rows of a version are written first and count once the list of versions
names them, so a reader sees a pair before or after a replacement, never between.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SCOPE = ("monitor_profile_id", "market")
VERSIONS = "monitor_profile_id string, market string, version string, stored_at timestamp, turn long"


def owned_scopes(runs: DataFrame, observations: DataFrame) -> DataFrame:
    """(monitor_profile_id, market, run_id): the last run that stores each pair.

    ``runs``: (run_id, monitor_profile_id, market, seq) in the order ``seq`` of storing, equal
    ones by run_id; ``observations``: (run_id, market, trading_date, ...). A run without
    a profile stores nothing, one without observations and market neither.
    """
    seen = observations.where("market IS NOT NULL").select(
        "run_id", F.col("market").alias("_market")).distinct()
    mine = runs.where("monitor_profile_id IS NOT NULL").join(seen, "run_id", "left")
    return mine.select("monitor_profile_id", F.coalesce("_market", "market").alias("market"),
                       F.struct("seq", "run_id").alias("_by")).where("market IS NOT NULL").groupBy(
        *SCOPE).agg(F.max("_by").alias("_by")).select(*SCOPE, F.col("_by.run_id").alias("run_id"))


def owned_rows(scopes: DataFrame, observations: DataFrame, order: str) -> DataFrame:
    """The rows of the runs that own their pair, one per date: the last by ``order``."""
    rows = observations.drop("monitor_profile_id").join(scopes, ["run_id", "market"])
    last = Window.partitionBy(*SCOPE, "trading_date").orderBy(F.col(order).desc_nulls_last())
    return rows.withColumn("_rk", F.row_number().over(last)).where("_rk = 1").drop("_rk")


def replace_observations(stored: DataFrame, runs: DataFrame, observations: DataFrame, *,
                         order: str) -> DataFrame:
    """``stored`` after ``runs``: pairs they own hold their rows only, others stay."""
    scopes = owned_scopes(runs, observations)
    fresh = owned_rows(scopes, observations, order)
    return stored.join(scopes, list(SCOPE), "left_anti").unionByName(fresh.select(*stored.columns))


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(VERSIONS).parquet(f"{folder}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def store_observations(folder: str, runs: DataFrame, observations: DataFrame, *, order: str) -> str:
    """Stores the rows of ``runs`` under ``folder`` and returns the version's name.

    Stored again, the same runs leave the same rows. What failed before its version was named
    leaves files that no reader looks at. Calls on one folder take turns.
    """
    spark = runs.sparkSession
    version = uuid.uuid4().hex
    scopes = owned_scopes(runs, observations)
    rows = owned_rows(scopes, observations, order)
    rows.write.parquet(f"{folder}/data/version={version}")
    turn = (_versions(spark, folder).agg(F.max("turn")).first()[0] or 0) + 1
    named = scopes.select(*SCOPE, F.lit(version).alias("version"),
                          F.current_timestamp().alias("stored_at"), F.lit(turn).cast("long").alias("turn"))
    named.coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return version


def stored_observations(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that count: of each (profile, market) those of its latest version."""
    latest = _versions(spark, folder).groupBy(*SCOPE).agg(F.max_by("version", "turn").alias("version"))
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    rows = rows.withColumn("version", F.col("version").cast("string"))
    return rows.join(latest, [*SCOPE, "version"]).drop("version")


def unnamed_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, kept): the folders of rows, and whether some pair still reads them.

    What is not kept may be deleted once no reader is under way.
    """
    latest = _versions(spark, folder).groupBy(*SCOPE).agg(F.max_by("version", "turn").alias("version"))
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    held = rows.select(F.col("version").cast("string").alias("version")).distinct()
    read = latest.select("version", F.lit(True).alias("_kept")).distinct()
    return held.join(read, "version", "left").select(
        "version", F.coalesce("_kept", F.lit(False)).alias("kept"))
