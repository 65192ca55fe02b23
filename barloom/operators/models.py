"""Tree scores, calibrated directions, forward signals and clusters on Spark ML.

Models are pooled over symbols (with the symbol's position as a feature) instead
of fitted one symbol at a time, so training is one distributed job per fold.
Fitting is eager; everything before and after it is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import count_true, finite
from barloom.operators.features import label_lookahead

# Estimator defaults.
TREES = 200
SEED = 42
FAMILIES = ("boosted", "bagged")


def _vectors(frame: DataFrame, features: Sequence[str], position: str | None) -> DataFrame:
    inputs = [*features, position] if position else list(features)
    ready = frame.select(*frame.columns, *[F.col(c).cast("double").alias(f"_x_{c}") for c in inputs])
    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in inputs], outputCol="_features")
    return assembler.transform(ready).drop(*[f"_x_{c}" for c in inputs])


def _regressor(family: str, target: str, trees: int, depth: int):
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    common = dict(featuresCol="_features", labelCol=target, predictionCol="predicted",
                  maxDepth=depth, seed=SEED)
    if family == "boosted":
        return GBTRegressor(maxIter=trees, **common)
    return RandomForestRegressor(numTrees=trees, **common)


def _fit(estimator, rows: DataFrame):
    """Fits on rows kept on disk meanwhile: an estimator passes over its input
    several times, and the windows behind it should run once. Lost blocks are
    recomputed from lineage."""
    kept = rows.persist(StorageLevel.DISK_ONLY)
    try:
        return estimator.fit(kept)
    finally:
        kept.unpersist()


def fit_scores_trees(frame: DataFrame, features: Sequence[str], *, target: str = "target",
                     family: str = "bagged", trees: int = TREES, depth: int = 5,
                     position: str | None = None):
    """(test rows with ``predicted``, fitted model); ``frame`` has role."""
    v = _vectors(frame, features, position)
    model = _fit(_regressor(family, target, trees, depth), v.where("role = 'train'"))
    return model.transform(v.where("role = 'test'")).drop("_features"), model


def feature_importance(models: Sequence[object], features: Sequence[str], spark) -> DataFrame:
    """(feature, importance): mean over models, descending."""
    rows = [(f, float(m.featureImportances[i])) for m in models for i, f in enumerate(features)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.where(~F.isnan("importance")).groupBy("feature").agg(
        F.avg("importance").alias("importance")).orderBy(F.col("importance").desc(), "feature")


def fit_direction_calibrated(frame: DataFrame, features: Sequence[str], *, label: str = "up",
                             trees: int = TREES, depth: int = 5, position: str | None = None
                             ) -> DataFrame:
    """Rows to score with ``probability`` of going up.

    ``frame`` has part (base, calibration, score; see calibration_split). Trees
    are fitted on base rows and a sigmoid on the calibration tail's raw score.
    """
    v = _vectors(frame, features, position).persist(StorageLevel.DISK_ONLY)
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol=label, probabilityCol="_p", predictionCol="_hat",
        rawPredictionCol="_raw", numTrees=trees, maxDepth=depth, seed=SEED)
    model = forest.fit(v.where("part = 'base'"))
    scored = model.transform(v.where("part IN ('calibration', 'score')")).withColumn(
        "_s", vector_to_array("_p")[1]).drop("_p", "_hat", "_raw", "_features")
    one = VectorAssembler(inputCols=["_s"], outputCol="_sv").transform(scored)
    sigmoid = LogisticRegression(featuresCol="_sv", labelCol=label, probabilityCol="_cp",
                                 predictionCol="_ch", rawPredictionCol="_cr")
    curve = _fit(sigmoid, one.where("part = 'calibration'"))
    out = curve.transform(one.where("part = 'score'"))
    return out.withColumn("probability", vector_to_array("_cp")[1]).drop(
        "_s", "_sv", "_cp", "_ch", "_cr")


def forward_gate(frame: DataFrame, requested: DataFrame, *, target: str, horizon: int
                 ) -> DataFrame:
    """(run_id, as_of, issue): a run has one common latest feature date, for
    every requested symbol, and a target that looks ahead."""
    latest = frame.groupBy("symbol").agg(F.max("date").alias("_d"))
    g = requested.join(latest, "symbol", "left").groupBy("run_id").agg(
        F.countDistinct("_d").alias("_dates"), F.max("_d").alias("as_of"),
        count_true(F.col("_d").isNull()).alias("_missing"))
    issue = (F.when(F.lit(label_lookahead(target, horizon) == 0), "no unlabelled forward row")
             .when(F.col("_missing") > 0, "symbols do not match the universe")
             .when(F.col("_dates") != 1, "no common latest date"))
    return g.select("run_id", F.when(issue.isNull(), F.col("as_of")).alias("as_of"),
                    issue.alias("issue"))


def forward_scores(labelled: DataFrame, prediction: DataFrame, requested: DataFrame,
                   features: Sequence[str], *, target: str = "open_to_open", horizon: int = 1,
                   family: str = "bagged", trees: int = TREES, depth: int = 5,
                   position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((run_id, symbol, date, score), gate): refit on every labelled row and
    score each run's common latest date. A run with a non-finite score, or any
    gate issue, gives no rows."""
    gate = forward_gate(prediction, requested, target=target, horizon=horizon)
    model = _fit(_regressor(family, "target", trees, depth),
                 _vectors(labelled, features, position))
    asks = requested.join(gate.where("issue IS NULL"), "run_id").select(
        "run_id", "symbol", F.col("as_of").alias("date"))
    rows = prediction.join(asks, ["symbol", "date"])
    scored = model.transform(_vectors(rows, features, position)).select(
        "run_id", "symbol", "date", finite("predicted").alias("score"))
    bad = scored.groupBy("run_id").agg(F.max(F.col("score").isNull()).alias("_b")).where("_b")
    return scored.join(bad.select("run_id"), "run_id", "left_anti"), gate


def cluster_snapshot(frame: DataFrame, columns: Sequence[str], *, clusters: int) -> DataFrame:
    """(market, date, symbol, cluster, distance) for one snapshot date.

    Columns are standardised with the population deviation (0 when constant);
    k-means runs with at most one cluster per symbol.
    """
    stats = frame.groupBy("market", "date").agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = frame.join(stats, ["market", "date"]).select(
        "market", "date", "symbol", *[
            F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"),
                                    F.when(F.col(f"_s_{c}") != 0, F.col(f"_s_{c}"))), F.lit(0.0))
            .alias(f"_z_{c}") for c in columns])
    names = [f"_z_{c}" for c in columns]
    v = VectorAssembler(inputCols=names, outputCol="_features").transform(z).persist(
        StorageLevel.DISK_ONLY)
    k = max(1, min(clusters, v.count()))
    if k == 1:
        centers = [[0.0] * len(names)]
        labelled = v.withColumn("cluster", F.lit(0))
    else:
        model = KMeans(featuresCol="_features", predictionCol="cluster", k=k, seed=SEED).fit(v)
        centers = [[float(x) for x in c] for c in model.clusterCenters()]
        labelled = model.transform(v)
    table: Column = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centers])
    center = F.element_at(table, F.col("cluster") + 1)
    square = sum((F.pow(F.col(n) - center[i], F.lit(2.0)) for i, n in enumerate(names)), F.lit(0.0))
    return labelled.select("market", "date", "symbol", F.col("cluster").cast("bigint").alias("cluster"),
                           F.sqrt(square).alias("distance"))

