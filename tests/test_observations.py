"""Stored monitoring observations, and phrases over the joined texts of a run."""

import datetime as dt
import json
import random
import re

from barloom.operators import observations as ob, prospective as pr

DAY = dt.date(2024, 1, 1)
RUNS = "run_id string, monitor_profile_id string, market string, seq long"
SEEN = "run_id string, market string, trading_date date, n long, ord long"


def stored(spark, folder):
    return sorted((r.monitor_profile_id, r.market, r.trading_date.day, r.run_id, r.n)
                  for r in ob.stored_observations(spark, folder).collect())


def at(n):
    return DAY + dt.timedelta(days=n - 1)


def test_replay_leaves_the_same_rows_and_other_dates_go(spark, tmp_path):
    folder = str(tmp_path / "obs")
    first = spark.createDataFrame([("a", "p", "TW", 1), ("b", "q", "TW", 1), ("z", None, "TW", 9)], RUNS)
    seen = spark.createDataFrame([
        ("a", "TW", at(1), 1, 0), ("a", "TW", at(2), 2, 1), ("a", "TW", at(2), 3, 2), ("a", "US", at(1), 4, 3),
        ("b", "TW", at(1), 5, 0), ("z", "TW", at(1), 6, 0), ("b", None, at(1), 7, 0)], SEEN)
    ob.store_observations(folder, first, seen, order="ord")
    want = [("p", "TW", 1, "a", 1), ("p", "TW", 2, "a", 3), ("p", "US", 1, "a", 4), ("q", "TW", 1, "b", 5)]
    assert stored(spark, folder) == want
    ob.store_observations(folder, first, seen, order="ord")
    assert stored(spark, folder) == want
    later = spark.createDataFrame([("c", "p", "TW", 2), ("d", "q", "TW", 2)], RUNS)
    ob.store_observations(folder, later, spark.createDataFrame([("c", "TW", at(3), 8, 0)], SEEN), order="ord")
    # c took over p in TW, left US alone; d saw nothing and cleared its market
    assert stored(spark, folder) == [("p", "TW", 3, "c", 8), ("p", "US", 1, "a", 4)]
    kept = sorted(r.kept for r in ob.unnamed_versions(spark, folder).collect())
    assert kept == [False, True, True]


def test_rows_without_a_named_version_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "obs")
    runs = spark.createDataFrame([("a", "p", "TW", 1)], RUNS)
    ob.store_observations(folder, runs, spark.createDataFrame([("a", "TW", at(1), 1, 0)], SEEN), order="ord")
    before = stored(spark, folder)
    ob.stored_observations(spark, folder).write.parquet(f"{folder}/data/version=halfway")
    assert stored(spark, folder) == before


def plain_store(state, runs, seen):
    for run, profile, market, _seq in sorted(runs, key=lambda r: (r[3], r[0])):
        if profile is None:
            continue
        mine = {}
        for r, m, day, n, order in sorted(seen, key=lambda o: o[4]):
            if r == run:
                mine.setdefault(m, {})[day] = (run, n)
        for m in mine or {market: {}}:
            state[profile, m] = mine.get(m, {})
    return state


def test_replacement_equals_runs_stored_one_by_one(spark):
    rng = random.Random(3)
    state, table = {}, spark.createDataFrame([], "monitor_profile_id string, " + SEEN)
    for turn in range(3):
        runs = [(f"r{turn}-{i}", rng.choice(["p", "q", None]), rng.choice(["TW", "US"]), i // 2) for i in range(8)]
        seen = [(f"r{turn}-{rng.randrange(12)}", rng.choice(["TW", "US"]), at(rng.randrange(1, 4)), i, i)
                for i in range(20)]
        table = ob.replace_observations(table, spark.createDataFrame(runs, RUNS),
                                        spark.createDataFrame(seen, SEEN), order="ord")
        plain_store(state, runs, seen)
        got = sorted((r.monitor_profile_id, r.market, r.trading_date, r.run_id, r.n) for r in table.collect())
        assert got == sorted((p, m, d, *v) for (p, m), days in state.items() for d, v in days.items())
        table = spark.createDataFrame(table.collect(), table.schema)


def plain_boundary(texts):
    joined = re.sub("[-_/]+", " ", " ".join(t for t in texts if t is not None).lower())
    joined = " ".join(joined.split())
    return not any(phrase in joined for phrase in pr.FORBIDDEN_PHRASES)


def test_phrases_over_joined_texts(spark):
    rng = random.Random(5)
    words = ["Personalized", "investment", "ADVICE", "live", "order-", "_routing", "place", "x", " ", "",
             " ", "long " * 12, "execution", "/route", None]
    runs = {i: [rng.choice(words) for _ in range(rng.randrange(1, 9))] for i in range(300)}
    runs[300] = ["personalized", "investment", "advice"]
    runs[301] = ["personalized", " ", "", "-", "investment", None, "advice"]
    runs[302] = ["y" * 90 + " automatic", "rebalance " + "y" * 90]
    rows = [(i, 7 * at - 20, t) for i, ts in runs.items() for at, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "run_id long, ordinal long, text string").repartition(5)
    want = {i: plain_boundary(ts) for i, ts in runs.items()}
    assert {False, True} == set(want.values())
    for size in (1, 15, 4096):
        got = pr.forbidden_phrase_scan(df, order="ordinal", slice_rows=size).collect()
        assert {r.run_id: r.boundary_present for r in got} == want
    alone = {r.run_id: r.boundary_present for r in pr.forbidden_phrase_scan(df).collect()}
    assert alone == {i: all(plain_boundary([t]) for t in ts) for i, ts in runs.items()}


def test_extended_fields_are_held_one_by_one(spark):
    full = pr.STRICT_RECIPE["strict_extended_recipe_mismatch"]["extended"]
    some = {n: v for n, v in full.items() if v is not None}
    texts = [json.dumps(full), json.dumps(some), json.dumps({**some, "other": 3}), json.dumps({**full, "adaptive_mode": "on"}),
             json.dumps({**some, "portfolio_aum": 5}), "{}", "[]", "no json", None,
             json.dumps({n: v for n, v in some.items() if n != "scoring_factor_ids"})]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, extended string")
    got = df.select("i", pr._differs({"extended": full}).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [False] * 3 + [True] * 7
