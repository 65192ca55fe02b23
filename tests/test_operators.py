"""Small literal cases and properties of the operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import (diagnostics as dg, factors as fa, ops, portfolio as pf,
                               prospective as pr, quality as ql, splits as sp, tradability as tr,
                               universe as un)
from barloom.sources import payloads as pl


def day(text):
    return dt.date.fromisoformat(text)


def days(n, start="2024-01-01"):
    return [d.date() for d in pd.date_range(start, periods=n)]


def test_fold_ranges(spark):
    sizes = spark.createDataFrame([("TW", 100)], "market string, n long")

    def ranges(method, purge=0, splits=2):
        rows = sp.fold_ranges(sizes, method=method, splits=splits, test_size=0.2, purge=purge)
        return [(r.train_start, r.train_end, r.test_start, r.test_end, r.issue)
                for r in rows.orderBy("fold").collect()]

    assert ranges("walk_forward") == [(0, 60, 60, 80, None), (0, 80, 80, 100, None)]
    assert ranges("expanding_window", purge=3) == [(0, 57, 60, 80, None), (0, 77, 80, 100, None)]
    assert ranges("rolling_window") == [(0, 60, 60, 80, None), (20, 80, 80, 100, None)]
    assert ranges("holdout") == [(0, 80, 80, 100, None)]
    assert {r[4] for r in ranges("walk_forward", splits=5)} == {"not enough data for splits"}


def test_folds_keep_the_purge_gap(spark):
    bars = spark.createDataFrame([("TW", d) for d in days(200)], "market string, date date")
    cal = sp.trading_calendar(bars)
    out = sp.fold_assignment(cal, method="rolling_window", splits=4, test_size=0.1, purge=5)
    pdf = out.join(cal, ["market", "date"]).toPandas()
    for _, f in pdf.groupby("fold"):
        assert f[f.role == "test"].idx.min() - f[f.role == "train"].idx.max() == 6


def test_topn_skips_bad_scores_and_probabilities(spark):
    rows = [("r", day("2024-01-01"), s, i, v, p) for i, (s, v, p) in enumerate([
        ("A", .02, .4), ("B", .01, .8), ("C", float("inf"), .9), ("D", .05, float("inf"))])]
    scores = spark.createDataFrame(rows, "run_id string, date date, symbol string, position int, score double, p double")
    w = pf.topn_weights(scores, threshold=0.0, top_n=3, probabilities="p").toPandas()
    assert dict(zip(w.symbol, w.weight)) == {"A": 0.0, "B": 1.0, "C": 0.0, "D": 0.0}


@pytest.fixture(scope="module")
def panel():
    """60 dates x 8 symbols, some cells absent, one NaN and one Inf score."""
    rng = np.random.default_rng(0)
    scores = pd.DataFrame(rng.normal(size=(60, 8)), index=days(60), columns=list("hgfedcba"))
    scores.iloc[3, 2], scores.iloc[5, 1] = np.nan, np.inf
    present = pd.DataFrame(rng.random((60, 8)) < .8, index=scores.index, columns=scores.columns)
    prices = pd.DataFrame(100 + np.cumsum(rng.normal(size=(60, 8)), axis=0), index=scores.index, columns=scores.columns)
    return scores, present, prices


def long(spark, frame, present, name):
    rows = [("r", d, s, i, float(frame.at[d, s])) for d in frame.index
            for i, s in enumerate(frame.columns) if present.at[d, s]]
    return spark.createDataFrame(rows, f"run_id string, date date, symbol string, position int, {name} double")


def loop_weights(scores, present, threshold, top_n, sells):
    out = pd.DataFrame(0.0, index=scores.index, columns=scores.columns)
    held = set()
    for d in scores.index:
        row = scores.loc[d][present.loc[d]]
        row = row[np.isfinite(row)]
        pick = row[row >= threshold].nlargest(top_n).index.tolist()
        held |= set(pick)
        own = pick if sells else sorted(held)
        if own:
            out.loc[d, own] = 1 / len(own)
    return out


@pytest.mark.parametrize("sells", [True, False])
def test_weights_match_a_date_loop(spark, panel, sells):
    scores, present, _ = panel
    build = pf.topn_weights if sells else pf.hold_weights
    w = build(long(spark, scores, present, "score"), threshold=.3, top_n=3).toPandas()
    want = loop_weights(scores, present, .3, 3, sells)
    got = w.pivot(index="date", columns="symbol", values="weight").reindex(columns=want.columns).fillna(0.0)
    assert np.allclose(got.values, want.values)
    assert set(np.round(w.groupby("date").weight.sum(), 12)) <= {0.0, 1.0}


def test_sparse_weights_act_as_the_full_grid(spark, panel):
    scores, present, prices = panel
    w = pf.topn_weights(long(spark, scores, present, "score"), threshold=.3, top_n=3)
    dense = loop_weights(scores, present, .3, 3, True)
    px = long(spark, prices, present, "open").select("symbol", "date", "open")
    turnover = pf.turnover(w).first().turnover
    assert turnover == pytest.approx(dense.diff().abs().sum(axis=1).mean() / 2)
    filled = prices.where(present).ffill()
    want = (dense.shift(1) * filled.pct_change(fill_method=None)).fillna(0.0).sum(axis=1)
    cost = .003 * dense.diff().fillna(dense).abs().sum(axis=1)
    got = pf.portfolio_returns(w, px, return_target="open_to_open", fees=.002, slippage=.001)
    got = got.toPandas().set_index("date").sort_index()
    assert np.allclose(got.gross, want) and np.allclose(got.cost, cost)
    curve = pf.equity_curve(got_df(spark, got)).toPandas().sort_values("date").equity
    m = pf.portfolio_metrics(pf.equity_curve(got_df(spark, got))).first()
    r = curve.pct_change().dropna()
    assert m.total_return == pytest.approx(curve.iloc[-1] / curve.iloc[0] - 1)
    assert m.sharpe == pytest.approx(r.mean() / r.std() * 252 ** .5)
    assert m.max_drawdown == pytest.approx((curve / curve.cummax() - 1).min())


def got_df(spark, got):
    return spark.createDataFrame(got.reset_index()[["date", "ret"]].assign(run_id="r"))


def test_signals_list_flat_symbols_on_the_last_date(spark):
    d1, d2 = days(2)
    scores = spark.createDataFrame([("r", d1, "A", .1), ("r", d1, "B", .2), ("r", d2, "A", .3), ("r", d2, "B", .1), ("r", d2, "C", -.1)],
                                   "run_id string, date date, symbol string, score double")
    weights = spark.createDataFrame([("r", d1, "A", 1.0), ("r", d1, "B", 0.0), ("r", d2, "A", 1.0), ("r", d2, "B", 0.0), ("r", d2, "C", 0.0)],
                                    "run_id string, date date, symbol string, weight double")
    rows = pf.signal_rows(scores, weights).orderBy("date", "symbol").collect()
    assert [(r.date, r.symbol, r.position) for r in rows] == [(d1, "A", 1.0), (d2, "A", 1.0), (d2, "B", 0.0), (d2, "C", 0.0)]


def test_ma_cross_first_date_is_null(spark):
    rows = [("r", d, s, 100.0 + (i if s == "A" else -i)) for i, d in enumerate(days(8)) for s in "AB"]
    p = spark.createDataFrame(rows, "run_id string, date date, symbol string, close double")
    w = pf.baseline_ma_cross(p, short=2, long=3).toPandas().pivot(index="date", columns="symbol", values="weight")
    assert w.iloc[0].isna().all() and (w.iloc[1:3] == 0).all().all()
    assert (w.A.iloc[3:] == 1).all() and (w.B.iloc[3:] == 0).all()


def test_dirty_bars(spark):
    d = "2024-01-0"
    rows = [(day(d + "2"), "A", 1.0, 2.0, 1.0, 2.0, 5, 1), (day(d + "2"), "A", 1.5, 2.0, 1.0, 2.0, 5, 2),
            (day(d + "3"), "A", None, 2.0, 1.0, 2.0, 5, 3), (day(d + "4"), "A", -1.0, 2.0, 1.0, 2.0, 5, 4)]
    df = spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume long, seq int")
    clean, report = ql.validate_daily_bars(df, order=["seq"])
    assert [r.open for r in clean.collect()] == [1.5]
    assert report.first().asDict() == {"input_rows": 4, "duplicates_removed": 1, "null_rows_removed": 1,
                                       "invalid_rows_removed": 1, "output_rows": 1}


def test_official_rows_are_never_overwritten(spark):
    schema = "date date, symbol string, source string, close double"
    d = day("2024-01-02")
    stored = spark.createDataFrame([(d, "A", "official", 1.0), (d, "B", "vendor", 1.0), (d, "C", None, 1.0)], schema)
    fresh = spark.createDataFrame([(d, "A", "vendor", 2.0), (d, "B", "vendor", 2.0), (d, "C", "official", 2.0)], schema)
    out = ql.upsert_daily_by_source_rank(stored, fresh, ["official"])
    assert {r.symbol: r.close for r in out.collect()} == {"A": 1.0, "B": 2.0, "C": 2.0}


def test_audit_sample_of_sixty(spark):
    rows = [(i, "f", "TW", days(60)[i], "fallback" if i % 3 == 2 or i > 50 else "exact") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, source_family string, market string, effective_date date, availability_mode string")
    sample = sp.audit_sample(df)
    s = fa.audit_summary(sample, keys=["market"]).first()
    assert (s.sample_size, s.fallback_sample_size) == (50, 20)


def test_point_in_time_universe(spark):
    life = spark.createDataFrame([
        (1, "1111", "TW", "listing", day("2020-01-01"), None), (2, "1111", "TW", "delisting", day("2024-06-01"), None),
        (3, "9999", "TW", "listing", day("2020-01-01"), None), (4, "9999", "TW", "delisting", day("2023-06-01"), None)],
        "id long, symbol string, market string, event_type string, effective_date date, reference_symbol string")
    profiles = spark.createDataFrame([("TW", "2330", day("1994-09-05")), ("TW", "8888", day("2025-01-01"))], "market string, symbol string, listing_date date")
    asks = spark.createDataFrame([("TW", s, day("2024-01-02")) for s in ("1111", "2330", "8888", "9999")], "market string, symbol string, date date")
    out = un.active_asof_fold(asks, profiles, life).where("active").orderBy("symbol")
    assert [r.symbol for r in out.collect()] == ["1111", "2330"]


LIFE = "id long, symbol string, market string, event_type string, effective_date date, reference_symbol string"


def test_identity_follows_changes_and_flags_cycles(spark):
    life = spark.createDataFrame([
        (1, "A", "TW", "ticker_change", day("2024-01-10"), "B"), (2, "B", "TW", "ticker_change", day("2024-01-20"), "C"),
        (3, "C", "TW", "ticker_change", day("2024-01-30"), "A"), (4, "D", "TW", "ticker_change", day("2024-01-05"), " "),
        (5, "E", "TW", "delisting", day("2024-01-15"), None)], LIFE)
    names = spark.createDataFrame([("TW", s) for s in "ADEZ"], "market string, symbol string")
    asks = spark.createDataFrame([("TW", s, day(f"2024-01-{d}")) for s in "ADEZ" for d in ("01", "12", "25", "31")], "market string, symbol string, date date")
    rows = un.identity_asof(asks, un.identity_intervals(names, life)).collect()
    got = {(r.symbol, r.date.day): (r.resolved_symbol, r.lifecycle_active, r.unresolved, "".join(r.symbol_path)) for r in rows}
    assert got["A", 1] == ("A", True, False, "A") and got["A", 12] == ("B", True, False, "AB")
    assert got["A", 25] == ("C", True, False, "ABC") and got["A", 31] == ("A", False, True, "ABCA")
    assert got["D", 12] == ("D", False, True, "D") and got["E", 25] == ("E", False, False, "E")
    assert got["Z", 31] == ("Z", True, False, "Z") and len(rows) == 16


def test_merger_on_the_last_date_blocks(spark):
    ds = days(150)
    bars = spark.createDataFrame([("TW", s, d, 100.0, 101.0, 99.0, 100.0, 1_000_000) for s in ("1111", "2222") for d in ds],
                                 "market string, symbol string, date date, open double, high double, low double, close double, volume long")
    events = spark.createDataFrame([(1, "1111", "TW", "merger", dt.datetime(2024, 1, 1), ds[-1])],
                                   "id long, symbol string, market string, event_type string, publication_ts timestamp, effective_date date")
    life = spark.createDataFrame([], LIFE)
    runs = spark.createDataFrame([("r", "TW", s, None, 5) for s in ("1111", "2222")],
                                 "run_id string, market string, symbol string, aum double, top_n int")
    daily = tr.execution_universe_daily(tr.tradable_cells(runs, bars, sp.trading_calendar(bars), events, life))
    rows = {r.date: r for r in daily.collect()}
    last, before = rows[ds[-1]], rows[ds[-2]]
    assert (last.execution_universe_count, last.full_universe_count, last.corporate_event_clear) == (1, 2, False)
    assert before.execution_universe_count == 2 and before.corporate_event_clear
    assert [b.full_count for b in last.bucket_coverages] == [0, 0, 2, 0]
    assert rows[ds[100]].execution_universe_count == 0  # under 120 days of history
    stale = spark.createDataFrame([("r", 0)], "run_id string, stale_days long")
    routes = spark.createDataFrame([("r", "simulation")], "run_id string, execution_route string")
    assert tr.tradability_state(daily, stale, routes).first().tradability_state == "unresolved_corporate_event"


def test_steady_observations_pass(spark):
    cov = [("lt_10m", 10, 10, 1.0, 1.0)]
    obs = spark.createDataFrame([("TW", d, 1.0, False, cov) for d in days(80)],
                                "market string, trading_date date, execution_universe_ratio double, stale_mark_with_open_positions boolean, "
                                "bucket_coverages array<struct<bucket_key string, full_count long, execution_count long, full_ratio double, coverage_ratio double>>")
    assert {r.status for r in tr.micro_kpi_drift(obs).collect()} == {"pass"}
    assert {r.status for r in tr.micro_kpi_drift(obs.limit(50)).collect()} == {"insufficient_sample"}


def test_direction_diagnostics(spark):
    pts = spark.createDataFrame([("r", 0, .2), ("r", 1, .8)], "run_id string, actual int, probability double")
    c = dg.confusion_and_pr(pts).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (1, 0, 0, 1)
    assert dg.roc_auc(pts).first().roc_auc == 1.0
    assert dg.brier(pts).first().brier == pytest.approx(.04)
    one = pts.where("actual = 1")
    assert dg.roc_auc(one).first().roc_auc is None and dg.pr_auc(one).first().pr_auc is None


def test_frozen_signal_outcome(spark):
    ds = days(3)
    bars = spark.createDataFrame([("2330", d, o, "official") for d, o in zip(ds, (99.0, 100.0, 110.0))],
                                 "symbol string, date date, open double, source string")
    s = spark.createDataFrame([("r", "2330", ds[0], .05, .8, 1.0), ("q", "2330", ds[1], .05, .8, 1.0),
                               ("p", "2330", ds[0], .05, 1.2, 1.0), ("n", "2330", day("2023-12-30"), .05, .8, 1.0)],
                              "run_id string, symbol string, basis_date date, score double, up_probability double, position double")
    rows = {r.run_id: r for r in pr.signal_outcome(s, bars, ["official"]).collect()}
    assert rows["r"].actual_return == pytest.approx(.1) and rows["r"].brier == pytest.approx(.04)
    assert rows["q"].status == "not_ready" and rows["p"].status == "invalid_signal"
    assert (rows["n"].status, rows["n"].reason) == ("not_ready", "official_outcomes_unavailable")
    done = pr.signal_outcome(s, bars, ["official"]).where("status = 'resolved'").withColumn("cohort_id", F.lit("c"))
    assert pr.cohort_metrics(done).first().rmse == pytest.approx(.05)


def test_payloads(spark):
    month = spark.createDataFrame([(1, "2330", '{"stat":"OK","fields":["日期","成交股數","開盤價","最高價","最低價","收盤價"],"data":[["113/01/02","1,000","10","11","9","10.5"]]}'),
                                   (2, "2330", '{"stat":"no"}'), (3, "2330", "not json")], "id long, symbol string, payload_body string")
    bars, failed = pl.parse_symbol_month_payload(month)
    r = bars.first()
    assert (r.date, r.volume, r.open, r.archive_object_reference) == (day("2024-01-02"), 1000, 10.0, "raw_ingest_audit:1")
    assert {f.raw_payload_id for f in failed.collect()} == {2, 3}
    daily = spark.createDataFrame([(1, day("2024-01-02"), '{"stat":"OK","tables":[{"fields":["x"],"data":[["1"]]},{"fields":["Security Code","Trade Volume (Shares)","Open","High","Low","Close"],"data":[["2330","1,000","--","11","9","10"]]}]}')],
                                  "id long, trading_date date, payload_body string")
    r = pl.parse_market_daily_payload(daily)[0].first()
    assert (r.symbol, r.volume, r.open) == ("2330", 1000, 0.0)
    minute = spark.createDataFrame([(1, "2330", "TW", '{"data":[{"Datetime":"2024-01-02T09:00:00+08:00","Open":1,"High":1,"Low":1,"Close":1,"Volume":null},{"Datetime":"2024-01-02T09:01:00","Open":1,"High":1,"Low":1,"Close":1,"Volume":2}]}')],
                                   "id long, symbol string, market string, payload_body string")
    rows = pl.parse_minute_payload(minute).orderBy("bar_ts").collect()
    assert [(r.trading_date, r.bar_ts.hour, r.bar_ts.minute, r.volume) for r in rows] == [
        (day("2024-01-02"), 1, 0, 0), (day("2024-01-02"), 1, 1, 2)]
    tick = spark.createDataFrame([('{"msgArray":[{"c":"2330","d":"20240102","tlong":"1704157200000","z":"1845.0","tv":"3","v":"9","a":"1845.0000_1850.0000_","f":"1_x_","b":"-_","g":""},{"c":"","d":"20240102"}]}', dt.datetime(2024, 1, 2))],
                                 "payload_body string, fetch_ts timestamp")
    rows = pl.parse_tick_snapshot(tick).collect()
    assert len(rows) == 1 and rows[0].best_ask_prices == [1845.0, 1850.0]
    assert rows[0].best_ask_sizes == [1] and rows[0].best_bid_prices == []


def test_tick_compression_passes(spark):
    objects = spark.createDataFrame([(100, 300)], "compressed_bytes long, uncompressed_bytes long")
    none = spark.createDataFrame([], "elapsed_seconds double, gb_per_minute double")
    r = ops.tick_kpis(objects, none).collect()
    assert [(x.kpi, x.status) for x in r] == [("compression", "pass")]
    assert r[0].value == pytest.approx(200 / 3)


def test_peer_overlay_matches_pairs(spark):
    rows = [("s", "c0", n, float(i)) for i, n in enumerate("abcdef")] + [("s", "c1", "z", 0.0)]
    out = fa.peer_overlay(spark.createDataFrame(rows, "snapshot_id string, cluster string, symbol string, distance double"), limit=2)
    got = {r.symbol: (r.peers, r.warning) for r in out.collect()}
    assert got["a"] == (["b", "c"], False) and got["b"] == (["a", "c"], False) and got["f"] == (["a", "b"], False)
    assert got["z"] == ([], True)


def test_a_total_loss_stays_lost(spark):
    rows = [("r", i, x) for i, x in enumerate([0.0, -1.0, 0.1, -1.5])] + [("s", 0, 0.5), ("s", 1, None)]
    curve = pf.equity_curve(spark.createDataFrame(rows, "run_id string, date int, ret double"))
    got = {(r.run_id, r.date): r.equity for r in curve.collect()}
    assert [got["r", i] for i in range(4)] == [1.0, 0.0, 0.0, 0.0] and got["s", 1] == pytest.approx(1.5)


def test_null_arrival_order_keeps_the_row(spark):
    from barloom.operators.quality import keep_latest
    rows = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("b", 5, 3)], "k string, o int, v int")
    assert {r.k: r.v for r in keep_latest(rows, keys=["k"], order=["o"]).collect()} == {"a": 1, "b": 3}


def test_ema_seeds_at_the_first_value_and_ages_over_gaps(spark):
    import pandas as pd
    from barloom.operators import features as ft
    x = [None, 2.0, 3.0, 4.0, None, None, 5.0, 6.0] + [float(i % 7) if i % 5 else None for i in range(900)]
    dates = pd.date_range("2000-01-01", periods=len(x))
    rows = [("a", d.date(), v) for d, v in zip(dates, x)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    want = pd.Series(x, dtype=float).ewm(span=3, adjust=False, min_periods=3).mean()
    got = ft.feature_ema(bars, window=3).toPandas().sort_values("date")
    got = got[[c for c in got.columns if c not in ("symbol", "date", "close")][-1]].astype(float)
    assert np.allclose(got.values, want.values, equal_nan=True)


def test_profile_ties_compare_escaped_text(spark):
    from barloom.operators.quality import COMPLETENESS_FIELDS, dedupe_company_profiles
    names = ["z", "\u00e9", "\u53f0"]
    rows = [tuple([n if c == "company_name" else "x" for c in COMPLETENESS_FIELDS] + ["E", "1", i]) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COMPLETENESS_FIELDS) + ", exchange string, symbol string, seq int")
    kept, _ = dedupe_company_profiles(df, arrival="seq")
    want = max(names, key=lambda n: n.encode("ascii", "backslashreplace"))
    assert kept.first().company_name == want


def test_events_published_after_the_end_do_not_block(spark):
    from barloom.operators import universe as un
    events = spark.sql("SELECT 'TW' market, 'A' symbol, 'merger' event_type, timestamp'2024-06-01' publication_ts, date'2024-01-01' effective_date")
    life = spark.sql("SELECT 1 id, 'TW' market, 'B' symbol, 'listing' event_type, date'2020-01-01' effective_date, cast(null as string) reference_symbol")
    asks = spark.sql("SELECT 'TW' market, 'A' symbol, date'2024-02-01' date, array('A') symbol_path, false unresolved")
    assert un.event_clear(asks, events, life, "2024-03-01").first().clear
    assert not un.event_clear(asks, events, life, "2024-06-01").first().clear
    assert not un.event_clear(asks, events, life).first().clear


def test_markets_that_share_symbols_stay_apart(spark):
    life = spark.createDataFrame([
        (1, "A", "US", "delisting", day("2024-01-10"), None), (2, "B", "US", "ticker_change", day("2024-01-05"), "A"),
        (3, "B", "TW", "listing", day("2024-01-20"), None)], LIFE)
    pairs = [(m, s) for m in ("TW", "US") for s in "AB"]
    names = spark.createDataFrame(pairs, "market string, symbol string")
    asks = spark.createDataFrame([(m, s, day("2024-01-25")) for m, s in pairs], "market string, symbol string, date date")
    window = {(r.market, r.symbol): (r.active_start, r.active_end) for r in
              un.active_window_in_month(names, life, month_start="2024-02-01", month_end="2024-02-29").collect()}
    month = (day("2024-02-01"), day("2024-02-29"))
    assert window == {("TW", "A"): month, ("TW", "B"): month, ("US", "A"): (None, None), ("US", "B"): month}
    known = un.identity_asof(asks, un.identity_intervals(names, life))
    got = {(r.market, r.symbol): ("".join(r.symbol_path), r.lifecycle_active) for r in known.collect()}
    assert got == {("TW", "A"): ("A", True), ("TW", "B"): ("B", True), ("US", "A"): ("A", False), ("US", "B"): ("BA", False)}
    events = spark.createDataFrame([(1, "A", "US", "merger", dt.datetime(2024, 1, 1), day("2024-01-01"))],
                                   "id long, symbol string, market string, event_type string, publication_ts timestamp, effective_date date")
    clear = {(r.market, r.symbol): r.clear for r in un.event_clear(known, events, life).collect()}
    assert clear == {("TW", "A"): True, ("TW", "B"): True, ("US", "A"): False, ("US", "B"): False}
    profiles = spark.createDataFrame([("US", "B", day("2025-01-01"))], "market string, symbol string, listing_date date")
    active = {(r.market, r.symbol): r.active for r in un.active_asof_fold(asks, profiles, life).collect()}
    assert active == {("TW", "A"): True, ("TW", "B"): True, ("US", "A"): False, ("US", "B"): False}
    bars = asks.withColumn("close", F.lit(1.0)).withColumn("volume", F.lit(1.0))
    on = bars.select("market", "symbol", "date", F.lit(True).alias("active"))
    counts = {(r.market, r.symbol): r.event_count_30d for r in fa.cluster_frame(bars, on, events).collect()}
    assert counts == {("TW", "A"): 0.0, ("TW", "B"): 0.0, ("US", "A"): 1.0, ("US", "B"): 0.0}
    kpi = ops.kpi_symbol_completeness(names, sp.trading_calendar(bars), life, bars, reference="2024-01-31").collect()
    assert {(r.market, r.symbols, r.passing) for r in kpi} == {("TW", 2, 2), ("US", 1, 1)}


def test_many_events_of_a_day_block_once(spark):
    text = "market string, symbol string, event_type string, publication_ts timestamp, effective_date date"
    kinds = ("delisting", "listing_status_change", "ticker_change", "cash_dividend")
    rows = [("TW", "A", k, dt.datetime(2024, 1, 1), d) for k in kinds for d in days(30)]
    events = spark.createDataFrame(rows, text).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("_copy")
    life = spark.createDataFrame([(1, "A", "TW", "listing", day("2024-01-10"), None), (2, "A", "TW", "delisting", day("2024-01-20"), None),
                                  (3, "A", "TW", "ticker_change", day("2024-01-25"), "B")], LIFE)
    got = un.blocking_intervals(events, life).collect()
    ends = {"delisting": ("20",), "listing_status_change": ("10", "20"), "ticker_change": ("25",)}
    want = [(d, min((e for e in (day(f"2024-01-{x}") for x in ends[k]) if e >= d), default=None)) for k in ends for d in days(30)]
    assert sorted((r.b_from, str(r.b_to)) for r in got) == sorted((d, str(e)) for d, e in want)
