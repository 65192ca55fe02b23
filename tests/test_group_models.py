"""One model for each group, and the runs built on them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import group_models as gm, runs

FEATURES = ["f", "g"]
DAY = dt.date(2024, 1, 1)


def plain_tree(x, y, cuts, depth, node=0, out=None):
    """{node: (feature, cut, rows, mean)} by trying every cut."""
    out = {} if out is None else out
    best = None
    for f in range(x.shape[1]):
        for c in cuts[f]:
            left = x[:, f] <= c
            if left.any() and not left.all():
                gain = sum(((y[m] - y.mean()) ** 2).sum() - ((y[m] - y[m].mean()) ** 2).sum() for m in (left, ~left))
                if best is None or gain > best[0] + 1e-12:
                    best = gain, f, c
    if depth == 0 or best is None or best[0] <= 1e-9:
        return out
    _, f, c = best
    out[node] = (f, c, len(y), y.mean())
    left = x[:, f] <= c
    plain_tree(x[left], y[left], cuts, depth - 1, 2 * node + 1, out)
    plain_tree(x[~left], y[~left], cuts, depth - 1, 2 * node + 2, out)
    return out


def made(spark, groups=3, n=120, seed=0, tests=20):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(groups):
        for i in range(n):
            f, g = rng.normal(), float(rng.integers(0, 5))
            rows.append((f"s{s}", DAY + dt.timedelta(i), f, g, (f > 0.3) * (s + 1) + 0.2 * g + rng.normal(scale=0.1), "train" if i < n - tests else "test", "x"))
    return rows, spark.createDataFrame(rows, "symbol string, date date, f double, g double, target double, role string, predicted_by string")


def test_one_tree_equals_plain_splits(spark):
    rows, df = made(spark)
    got = {(r.symbol, r.node): (r.feature, r.threshold, r.rows, r["mean"]) for r in gm.tree_splits(df, FEATURES, depth=3, bins=16).collect()}
    want = {}
    for s in ("s0", "s1", "s2"):
        part = [r for r in rows if r[0] == s and r[5] == "train"]
        x, y = np.array([r[2:4] for r in part]), np.array([r[4] for r in part])
        ordered = np.sort(x, axis=0)
        cuts = [sorted({ordered[-(-k * len(x) // 16) - 1, f] for k in range(1, 16)} - {ordered[-1, f]}) for f in range(2)]
        want |= {(s, n): (FEATURES[f], c, k, m) for n, (f, c, k, m) in plain_tree(x, y, cuts, 3).items()}
    assert got.keys() == want.keys() and len(got) > 15
    for k in got:
        assert got[k][:3] == want[k][:3] and got[k][3] == pytest.approx(want[k][3])


@pytest.mark.parametrize("family", gm.FAMILIES)
def test_models_learn_and_do_not_depend_on_partitions(spark, family):
    _, df = made(spark)
    fit = lambda d: {(r.symbol, r.date): r.predicted for r in gm.fit_scores(d, FEATURES, family=family, trees=40).collect()}
    got = fit(df)
    assert got == fit(df.repartition(7).sortWithinPartitions(F.desc("date"))) and len(got) == 60
    truth = {(r.symbol, r.date): r.target for r in df.collect()}
    miss = np.mean([(got[k] - truth[k]) ** 2 for k in got])
    assert miss < 0.3 * np.var([truth[k] for k in got])
    assert got.keys() == {k for k in truth if k[1] >= DAY + dt.timedelta(100)}
    shares = gm.group_importance(df, FEATURES, family=family, trees=20).collect()
    assert len(shares) == 6 and all(r.importance >= 0 for r in shares)
    assert [r.feature for r in gm.mean_importance(gm.group_importance(df, FEATURES, family=family, trees=20)).collect()][0] == "f"


def test_sigmoid_is_the_best_of_its_loss():
    rng = np.random.default_rng(5)
    f = rng.random(300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(6 * f - 2)))).astype(float)
    a, b = gm.sigmoid(f, y)
    n1, n0 = y.sum(), 300 - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    v = np.zeros(2)  # plain descent in (a, b)
    for _ in range(200000):
        p = 1 / (1 + np.exp(v[0] * f + v[1]))
        v -= 0.02 * np.array([((t - p) * f).sum(), (t - p).sum()])
    assert (a, b) == pytest.approx(tuple(v), abs=1e-6)
    a, b = gm.sigmoid(np.array([0.0] * 20 + [1.0] * 20), np.array([0.0] * 20 + [1.0] * 20))
    assert np.isfinite([a, b]).all() and 1 / (1 + np.exp(a + b)) == pytest.approx(21 / 22, abs=1e-6)


@pytest.mark.parametrize("family", gm.FAMILIES)
def test_directions_are_calibrated_or_say_why(spark, family):
    _, df = made(spark, groups=2, n=200)
    few = df.where("symbol = 's0'").limit(30).withColumn("symbol", F.lit("few"))
    one = df.where("symbol = 's1'").withColumn("symbol", F.lit("one")).withColumn("target", F.lit(-1.0))
    only = df.where("symbol = 's1' AND role = 'test'").withColumn("symbol", F.lit("only"))
    frame = df.unionByName(few).unionByName(one).unionByName(only).withColumn("up", (F.col("target") > 0.8).cast("int"))
    rows = gm.fit_directions(frame, FEATURES, family=family, trees=30, purge=1).collect()
    by = lambda s: [r for r in rows if r.symbol == s]
    assert {r.reason for r in by("s0") + by("s1")} == {None} and {r.reason for r in by("one")} == {"base_class_support"}
    assert {r.reason for r in by("only")} == {"insufficient_rows"} and {r.probability for r in by("one") + by("only")} == {None}
    good = by("s0") + by("s1")
    assert len(good) == 40 and all(0 <= r.probability <= 1 for r in good) and np.mean([(r.probability > 0.5) == r.up for r in good]) > 0.8


def test_missing_values_take_no_part(spark):
    rows, _ = made(spark, groups=1, n=60)
    bad = [("s0", DAY + dt.timedelta(i), *v, r, "x") for i, v, r in [(200, (None, 1.0, 9e9), "train"), (201, (1.0, float("nan"), 9e9), "train"),
                                                                     (202, (1.0, 1.0, None), "train"), (203, (None, 1.0, 1.0), "test")]]
    schema = "symbol string, date date, f double, g double, target double, role string, predicted_by string"
    clean = {r.date: r.predicted for r in gm.fit_scores(spark.createDataFrame(rows, schema), FEATURES, trees=5).collect()}
    got = {r.date: r.predicted for r in gm.fit_scores(spark.createDataFrame(rows + bad, schema), FEATURES, trees=5).collect()}
    assert got.pop(DAY + dt.timedelta(203)) is None and got == clean
    lone = spark.createDataFrame([("z", DAY, 1.0, 1.0, 1.0, "test", "x")], schema)
    assert [r.predicted for r in gm.fit_scores(lone, FEATURES).collect()] == [None]
    assert gm.fit_scores(lone.limit(0), FEATURES).count() == 0


def opinion_tables(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(4):
        for i in range(160):
            f = rng.normal()
            rows.append((f"s{s}", DAY + dt.timedelta(i), f, rng.normal(), 100 + i * 1.0, (f > 0) * 0.02 - 0.01 + s * 0.001 if i < 159 else None))
    rows += [("late", DAY + dt.timedelta(i), 0.0, 0.0, 1.0, 0.01 if i % 2 else -0.01) for i in range(150)]
    rows += [("flat", DAY + dt.timedelta(i), 0.0, 0.0, 1.0, -0.01 if i < 159 else None) for i in range(160)]
    frame = spark.createDataFrame(rows, "symbol string, date date, f double, g double, open double, target double")
    asks = [("two", "s0", 0), ("two", "s1", 1), ("all", "s0", 0), ("all", "s1", 1), ("all", "s2", 2), ("all", "s3", 3), ("mixed", "s0", 0), ("mixed", "late", 1),
            ("flat", "flat", 0), ("flat", "s2", 1), ("gone", "s0", 0), ("gone", "?", 1), ("dated", "s0", 0), ("undated", "s0", 0)]
    last = DAY + dt.timedelta(159)
    basis = {"dated": last, "undated": last - dt.timedelta(1)}
    return frame, spark.createDataFrame([(*a, basis.get(a[0])) for a in asks], "run_id string, symbol string, position long, basis_date date"), last


def test_forward_opinions_fail_closed(spark):
    frame, asks, last = opinion_tables(spark)
    rows, gate = runs.forward_opinions(frame.where("target IS NOT NULL"), frame, asks, FEATURES, top_n=2, trees=15)
    issues = {r.run_id: (r.as_of, r.issue) for r in gate.collect()}
    assert {k for k, v in issues.items() if v == (last, None)} == {"two", "all", "dated"}
    assert {k: v[1] for k, v in issues.items() if v[0] is None} == {
        "mixed": "no common latest date", "gone": "symbols do not match the universe", "undated": "basis date is not the latest feature date",
        "flat": "[flat] direction is not calibrated: base_class_support"}
    got = rows.collect()
    assert {(r.run_id, r.symbol) for r in got} == {("two", "s0"), ("two", "s1"), ("dated", "s0"), *{("all", f"s{i}") for i in range(4)}}
    shared = {r.symbol: (r.score, r.up_probability) for r in got if r.run_id == "all"}
    for r in got:
        assert r.date == last and r.signal_kind == "forward_opinion" and shared[r.symbol] == (r.score, r.up_probability)
        assert r.predicted_direction == ("up" if r.up_probability >= 0.5 else "down")
        assert r.position == 0 or (r.score >= 0 and r.up_probability >= 0.5)
    for run in ("two", "all"):
        held = [r.position for r in got if r.run_id == run and r.position > 0]
        assert len(held) <= 2 and (not held or sum(held) == pytest.approx(1))
    none, gate = runs.forward_opinions(frame, frame, asks, FEATURES, target="open_to_close", trees=5)
    assert none.count() == 0 and {r.issue for r in gate.collect()} == {"no unlabelled forward row"}


def test_validation_names_what_is_lacking(spark):
    frame, asks, _ = opinion_tables(spark)
    frame = frame.where("target IS NOT NULL")
    twice = frame.where("symbol = 's3'").limit(1)
    asks = asks.drop("basis_date").where("run_id IN ('two', 'flat', 'gone', 'mixed')")
    summary, told = runs.validate_runs(frame, asks, FEATURES, top_n=1, splits=2, fees=0.001, trees=10)
    got = {r.run_id: r for r in summary.collect()}
    assert got["two"].evaluation_status == got["mixed"].evaluation_status == "evaluated" and np.isfinite(got["two"].total_return)
    assert got["flat"].status_reason == "[flat] direction is not calibrated: base_class_support" and got["flat"].sharpe is None
    assert got["gone"].status_reason == "symbols do not match the universe"
    roles = told.groupBy("run_id", "fold").agg(F.countDistinct("symbol").alias("s"), F.countDistinct("date").alias("d")).collect()
    assert {(r.run_id, r.s) for r in roles} == {("two", 2), ("mixed", 2), ("flat", 2)} and len(roles) == 6
    again = runs.validate_runs(frame.unionByName(twice), spark.createDataFrame([("r", "s3", 0)], asks.schema), FEATURES, trees=2)[0].collect()
    assert [r.status_reason for r in again] == ["a symbol repeats a date"]
    small = runs.validate_runs(frame.limit(3), spark.createDataFrame([("r", "s0", 0)], asks.schema), FEATURES, trees=2)[0].collect()
    assert [(r.evaluation_status, r.status_reason) for r in small] == [("not_evaluated", "test_size too small")]
