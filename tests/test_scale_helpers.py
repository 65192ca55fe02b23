"""Skew-safe helpers against plain computation, with one hot key."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.asof import asof_last, interval_counts
from barloom.functions.prefix import exact_percentiles, positions, running_totals
from barloom.operators.diagnostics import pr_auc, rank_ic, roc_auc
from barloom.operators.features import Feature, feature_set


@pytest.fixture(scope="module")
def hot():
    """Two thirds of the rows in one group, with many ties."""
    rng = np.random.default_rng(3)
    g = np.where(rng.random(3000) < 0.67, "hot", rng.choice(list("abc"), 3000))
    return pd.DataFrame({"g": g, "v": np.round(rng.normal(size=3000), 2),
                         "w": rng.integers(1, 5, 3000).astype("int64"),
                         "y": rng.integers(0, 2, 3000).astype("int64"),
                         "z": rng.normal(size=3000)})


def test_running_totals(spark, hot):
    out = running_totals(spark.createDataFrame(hot), keys=["g"], order="v",
                         sums={"w": F.sum("w")}, buckets=8, bucket_rows=9).toPandas()
    want = hot.groupby(["g", "v"]).w.sum().reset_index()
    want["before"] = want.groupby("g").w.cumsum() - want.w
    j = out.merge(want, on=["g", "v"])
    assert len(j) == len(want) == len(out)
    assert (j.w_before == j.before).all() and (j.w_x == j.w_y).all()
    assert (j.w_all == j.groupby("g").w_y.transform("sum")).all()


def test_exact_percentiles(spark, hot):
    out = exact_percentiles(spark.createDataFrame(hot), keys=["g"], value="v",
                            quantiles={"p50": .5, "p95": .95, "p0": 0.0, "p1": 1.0}).toPandas()
    for r in out.itertuples():
        v = hot[hot.g == r.g].v
        assert np.allclose([r.p50, r.p95, r.p0, r.p1], np.quantile(v, [.5, .95, 0, 1]))


def test_rank_statistics(spark, hot):
    df = spark.createDataFrame(hot)
    ic = rank_ic(df.select(F.col("g").alias("run_id"), F.col("v").alias("actual"),
                           F.round("z", 1).alias("predicted"))).toPandas().set_index("run_id").rank_ic
    pts = df.select(F.col("g").alias("run_id"), F.col("y").alias("actual"),
                    F.round(1 / (1 + F.exp("z")), 2).alias("probability"))
    auc = roc_auc(pts).toPandas().set_index("run_id").roc_auc
    ap = pr_auc(pts).toPandas().set_index("run_id").pr_auc
    local = pts.toPandas()
    rounded = df.select("g", "v", F.round("z", 1).alias("z")).toPandas()
    for g, part in rounded.groupby("g"):
        assert ic[g] == pytest.approx(np.corrcoef(part.v.rank(), part.z.rank())[0, 1])
    for g, part in local.groupby("run_id"):
        pos, neg = part[part.actual == 1].probability.values, part[part.actual == 0].probability.values
        wins = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
        assert auc[g] == pytest.approx(wins)
        total, area = len(pos), 0.0
        for t in sorted(set(part.probability), reverse=True):
            called = part[part.probability >= t]
            area += (part[part.probability == t].actual.sum() / total) * called.actual.mean()
        assert ap[g] == pytest.approx(area)


def test_positions_match_row_number(spark):
    days = pd.date_range("2020-01-01", periods=400).date
    df = spark.createDataFrame(pd.DataFrame({"k": "hot", "date": days}))
    out = positions(df, keys=["k"], order=["date"], slice_by=F.trunc("date", "month")).toPandas()
    assert out.sort_values("date").pos.tolist() == list(range(400))


def test_asof_last_matches_merge_asof(spark):
    rng = random.Random(1)
    days = pd.date_range("2020-01-01", periods=300)
    left = pd.DataFrame([{"k": rng.choice(["hot", "hot", "b"]), "at": rng.choice(days), "i": i}
                         for i in range(400)])
    right = pd.DataFrame([{"k": rng.choice(["hot", "hot", "b", "c"]), "rt": rng.choice(days), "v": float(i)}
                          for i in range(60)]).drop_duplicates(["k", "rt"])
    for strict in (False, True):
        out = asof_last(spark.createDataFrame(left), spark.createDataFrame(right), keys=["k"],
                        left_at="at", right_at="rt", values=["v"], strict=strict).toPandas()
        want = pd.merge_asof(left.sort_values("at"), right.sort_values("rt"), left_on="at",
                             right_on="rt", by="k", allow_exact_matches=not strict)
        j = out.merge(want, on="i", suffixes=("", "_w"))
        assert len(j) == 400
        assert ((j.v == j.v_w) | (j.v.isna() & j.v_w.isna())).all()


def test_interval_counts(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, None), ("a", 4, 4), ("b", 2, 3)],
                               "k string, s int, e int")
    rows = {(r.k, r.at): r.open for r in interval_counts(df, keys=["k"], start="s", end="e").collect()}
    assert rows == {("a", 1): 1, ("a", 3): 2, ("a", 5): 1, ("b", 2): 1, ("b", 3): 0}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("hot", 900), ("cold", 40)):
        price = 100 + np.cumsum(rng.normal(size=n))
        for d, p in zip(pd.date_range("2018-01-01", periods=n).date, price):
            rows.append((s, d, float(p), float(p + 1), float(p - 1), float(p + .3), int(rng.integers(1, 99))))
    pdf = pd.DataFrame(rows, columns=["symbol", "date", "open", "high", "low", "close", "volume"])
    return pdf, spark.createDataFrame(pdf)


def test_ema_is_exact_over_many_blocks(series, monkeypatch):
    from barloom.operators import features as ft
    monkeypatch.setattr(ft, "_ema_block", lambda span: 60 * span)
    pdf, df = series
    out = ft.feature_ema(df, window=3).toPandas().sort_values(["symbol", "date"])
    for s, part in pdf.groupby("symbol"):
        want = part.close.ewm(span=3, adjust=False, min_periods=3).mean().to_numpy()
        assert np.allclose(out[out.symbol == s].value.to_numpy(), want, rtol=1e-14, equal_nan=True)


def test_chunked_features_equal_whole_series(series):
    _pdf, df = series
    specs = [Feature("ma", 20, shift=2), Feature("ema", 5), Feature("rsi", 14), Feature("roc", 10),
             Feature("volatility", 20), Feature("zscore", 20, "open", 1)]
    whole = feature_set(df, specs).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    cut = feature_set(df, specs, chunk_rows=130).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    assert len(whole) == len(cut) == 940
    for f in specs:
        assert np.allclose(whole[f.column], cut[f.column], rtol=1e-9, equal_nan=True), f
