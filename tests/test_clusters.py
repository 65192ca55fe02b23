"""Clusters of cross-sections against a plain version."""

import datetime as dt

import numpy as np

from barloom.operators.clusters import cluster_snapshots


def plain(rows, k, rounds):
    """{symbol: (cluster, distance)} of [(symbol, values)] for one cross-section."""
    rows = sorted(rows)
    x = np.array([[np.nan if v is None else v for v in r[1]] for r in rows], float)
    sd = np.nanstd(x, axis=0)
    z = np.where(np.isnan(x) | (sd == 0), 0, (x - np.nanmean(x, axis=0)) / np.where(sd == 0, 1, sd))
    seeds = []
    far = (z ** 2).sum(axis=1).round(9)
    for _ in range(k):
        i = int(far.argmax())
        if seeds and far[i] <= 0:
            break
        seeds.append(z[i])
        far = np.min([((z - s) ** 2).sum(axis=1).round(9) for s in seeds], axis=0)
    centres = np.array(seeds)
    for step in range(rounds + 1):
        d = ((z[:, None] - centres[None]) ** 2).sum(axis=2).round(9)
        at = d.argmin(axis=1)
        if step < rounds:
            centres = np.array([z[at == j].mean(axis=0) if (at == j).any() else centres[j] for j in range(len(centres))])
    return {r[0]: (int(c), float(np.sqrt(v))) for r, c, v in zip(rows, at, d.min(axis=1), strict=True)}


def test_all_cross_sections_at_once(spark):
    rng = np.random.default_rng(0)
    rows = []
    for market in ("TW", "US"):
        for day in range(12):
            n = [1, 2, 3, 9][day % 4]
            rows += [(market, dt.date(2024, 1, 1 + day), f"s{i}", float(rng.integers(0, 4)), None if rng.random() < 0.1 else float(rng.normal()), 5.0, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "market string, date date, symbol string, a double, b double, flat double, cluster string")
    got = {(r.market, r.date, r.symbol): (r.cluster, round(r.distance, 6)) for r in cluster_snapshots(df.repartition(5), ["a", "b", "flat"], clusters=3, rounds=4).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = plain([(r[2], r[3:6]) for r in rows if r[:2] == key], 3, 4)
        want |= {(*key, s): (c, round(d, 6)) for s, (c, d) in own.items()}
    assert got == want and len({c for c, _ in got.values()}) == 3


def test_no_rows_and_equal_symbols(spark):
    schema = "market string, date date, symbol string, a double"
    same = spark.createDataFrame([("TW", dt.date(2024, 1, 1), f"s{i}", 2.0) for i in range(4)], schema)
    assert {(r.cluster, r.distance) for r in cluster_snapshots(same, ["a"], clusters=2).collect()} == {(0, 0.0)}
    assert cluster_snapshots(same.limit(0), ["a"], clusters=2).count() == 0
