"""Frozen signals judged by later bars, cohort metrics and run opinions.

Signals are rows keyed by run; a run's configuration is typed columns, with its
symbol lists as arrays (bounded by the listed universe).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.asof import asof_last
from barloom.functions.columns import (MARKET_ZONE, count_true, finite, local_date,
                                       ratio_or_zero)
from barloom.operators.diagnostics import rank_ic
from barloom.operators.portfolio import round_trip_net_return

FORWARD = "forward_opinion"
STRICT = "strict_v1"

# The frozen recipe of a strict run, policy and phrases.
_TREES = {"n_estimators": 200, "random_state": 42, "n_jobs": -1}
STRICT_RECIPE = {
    "strict_target_mismatch": {"market": "TW", "return_target": "open_to_open", "horizon_days": 1},
    "strict_execution_route_mismatch": {"execution_route": "research_only"},
    "strict_runtime_recipe_mismatch": {"runtime_mode": "vnext_spec_mode",
                                       "default_bundle_version": "research_spec_v1"},
    "strict_feature_recipe_mismatch": {"features": [
        {"name": "ma", "window": 5, "source": "close", "shift": 1},
        {"name": "rsi", "window": 14, "source": "close", "shift": 1}]},
    "strict_model_recipe_mismatch": {
        "model": {"type": "extra_trees", "params": _TREES},
        "direction_model": {
            "type": "extra_trees", "params": _TREES, "positive_return_threshold": 0.0,
            "confirmation_probability_threshold": 0.5,
            "calibration_policy_version": "chronological_tail_20pct_min20_class5_v1",
            "confirmation_policy_version": "regression_threshold_direction_probability_v1"}},
    "strict_validation_recipe_mismatch": {"validation_method": "walk_forward",
                                          "validation_splits": 3, "validation_test_size": 0.2},
    "strict_cost_or_baseline_recipe_mismatch": {"fees": 0.002, "slippage": 0.001,
                                                "baselines": ["buy_and_hold"]},
    "strict_strategy_recipe_mismatch": {"strategy": {
        "type": "research_v1", "threshold": None, "top_n": None, "allow_proactive_sells": True}},
    "strict_extended_recipe_mismatch": {"extended": {
        "portfolio_aum": None, "monitor_profile_id": None, "factor_catalog_version": None,
        "scoring_factor_ids": [], "external_signal_policy_version": None,
        "cluster_snapshot_version": None, "peer_policy_version": None,
        "simulation_profile_id": None, "live_control_profile_id": None,
        "manual_confirmed": False, "adaptive_mode": "off", "adaptive_profile_id": None,
        "reward_definition_version": None, "state_definition_version": None,
        "rollout_control_version": None}},
}
BY_FIELD = ("extended",)
SINGLE_SYMBOL = "2330"
RANGE_DAYS = 1096
MIN_COVERAGE = 0.95
STRICTER, LOOSER = 1.25, 0.75
FORBIDDEN_PHRASES = (
    "broker routing", "execution ready", "live order", "automatic rebalance",
    "automatic rebalancing", "portfolio control", "account control",
    "personalized investment advice", "personalized advice", "place order", "order routing",
    "execution route")

BLANKS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def signal_outcome(signals: DataFrame, bars: DataFrame, official: Sequence[str]) -> DataFrame:
    """``signals`` with status and, when resolved, the realised outcome.

    Entry and exit are the opens of the first two bars after the basis date.
    Each bar knows the next two bars of its symbol, so a signal needs one as-of
    lookup and no join over later bars. Columns in: run_id, symbol, basis_date,
    score, up_probability, position.
    """
    order = Window.partitionBy("symbol").orderBy("date")
    here = F.struct("date", "open", F.col("source").isin(*official).alias("official"))
    chain = bars.select(
        F.upper("symbol").alias("_sym"), "date", here.alias("here"),
        F.lead(here, 1).over(order).alias("n1"), F.lead(here, 2).over(order).alias("n2"))
    firsts = bars.groupBy(F.upper("symbol").alias("_sym")).agg(
        F.min("date").alias("_first"))
    # A row before the first bar gives that bar and its successor as the later bars.
    lead_in = chain.join(firsts, (F.col("date") == F.col("_first"))
                         & (chain["_sym"] == firsts["_sym"])).select(
        chain["_sym"], F.lit("0001-01-01").cast("date").alias("date"),
        F.lit(None).cast(chain.schema["here"].dataType).alias("here"),
        F.col("here").alias("n1"), F.col("n1").alias("n2"))
    s = signals.withColumn("_sym", F.upper("symbol"))
    j = asof_last(s, chain.unionByName(lead_in), keys=["_sym"], left_at="basis_date",
                  right_at="date", values=["here", "n1", "n2"])
    on_basis = F.coalesce(F.col("here.date") == F.col("basis_date"), F.lit(False))
    bars_ok = on_basis & F.col("here.official") & F.col("n1.official") & F.col("n2.official")
    score, p, w = finite("score"), finite("up_probability"), finite("position")
    sane = (score.isNotNull() & F.coalesce(p.between(0.0, 1.0), F.lit(False))
            & F.coalesce(w >= 0, F.lit(False)))
    status = (F.when(F.col("n2").isNull(), "not_ready")
              .when(~F.coalesce(bars_ok, F.lit(False)), "not_ready")
              .when(~sane, "invalid_signal").otherwise("resolved"))
    reason = F.when(F.col("n2").isNotNull() & ~F.coalesce(bars_ok, F.lit(False)),
                    "official_outcomes_unavailable")
    j = j.withColumn("status", status).withColumn("reason", reason)
    good = F.col("status") == "resolved"
    ret = F.when(good, F.col("n2.open") / F.col("n1.open") - 1.0)
    j = (j.withColumn("entry_date", F.when(good, F.col("n1.date")))
         .withColumn("exit_date", F.when(good, F.col("n2.date")))
         .withColumn("actual_return", ret)
         .withColumn("actual_direction", (F.col("actual_return") > 0).cast("int")))
    miss = F.col("up_probability") - F.col("actual_direction")
    return (j.withColumn("brier", F.when(good, miss * miss))
            .withColumn("direction_hit", F.when(good, (
                (F.col("up_probability") >= 0.5) == (F.col("actual_direction") == 1)).cast("int")))
            .withColumn("gross_return", F.when(good, F.col("position") * F.col("actual_return")))
            .drop("_sym", "here", "n1", "n2"))


def _differs(expected: Mapping[str, object]) -> Column:
    """Whether a column is another value; lists and mappings are columns of JSON text,
    where the order of keys does not count and numbers do as they are written. In a
    mapping of BY_FIELD each field is held against its own value: an absent one is null,
    fields beside the expected ones do not count. A text that is the expected one letter
    for letter is not parsed; another is parsed once, as the argument of a lambda."""
    out = F.lit(False)
    for name, value in expected.items():
        if name in BY_FIELD:
            def other(given: Column) -> Column:
                off = F.coalesce(~F.schema_of_variant(given).startswith("OBJECT"), F.lit(True))
                for field, default in value.items():
                    text = F.coalesce(F.to_json(F.try_variant_get(given, f"$.{field}", "variant")),
                                      F.lit("null"))
                    off = off | (text != F.to_json(F.parse_json(F.lit(json.dumps(default)))))
                return off

            out = out | F.when(F.col(name) == json.dumps(value), False).otherwise(
                F.exists(F.array(F.try_parse_json(F.col(name))), other))
        elif isinstance(value, (dict, list)):
            given = F.to_json(F.try_parse_json(F.col(name)))
            out = out | F.when(F.col(name) == json.dumps(value), False).otherwise(
                ~given.eqNullSafe(F.to_json(F.parse_json(F.lit(json.dumps(value))))))
        else:
            out = out | ~F.col(name).eqNullSafe(F.lit(value))
    return out


def strict_run_issues(runs: DataFrame, *, cohorts: Sequence[str], cohort: str | Column,
                      all_active: str, single: str | None = None,
                      recipe: Mapping[str, Mapping[str, object]] = STRICT_RECIPE) -> DataFrame:
    """``runs`` with ``issues``: the rules a frozen run breaks.

    Needs status, mode, cohort_id, basis_date, signal_frozen_at, range_start,
    range_end, symbols, universe (arrays) and the columns of the recipe. A run of the
    cohort ``single`` has SINGLE_SYMBOL alone as its symbols and its universe.
    """
    c = F.lit(cohort) if isinstance(cohort, str) else cohort
    strict = F.coalesce((F.col("mode") == STRICT) & (F.col("cohort_id") == c), F.lit(False))
    basis = F.col("basis_date")
    frozen_day = local_date("signal_frozen_at", MARKET_ZONE)

    def clean(name: str) -> Column:
        return F.filter(F.transform(name, lambda s: F.upper(F.trim(s))), lambda s: s != "")

    shape = (F.col("symbols").isNull() | F.col("universe").isNull()
             | ~F.coalesce(F.col("cohort_id").isin(*cohorts), F.lit(False)))
    alone = F.array(F.lit(SINGLE_SYMBOL))
    ranged = (F.col("range_start").eqNullSafe(F.date_sub(basis, RANGE_DAYS))
              & F.col("range_end").eqNullSafe(basis))
    detailed = strict & basis.isNotNull()

    def found(tidy: Column) -> Column:
        symbols, known = tidy["symbols"], tidy["known"]
        untidy = ((F.col("symbols") != symbols) | (F.col("universe") != known)
                  | (F.sort_array(F.array_distinct(symbols)) != symbols)
                  | (F.sort_array(F.array_distinct(known)) != known)
                  | (F.size(F.array_except(symbols, known)) > 0))
        covered = F.size(F.array_intersect(symbols, known))
        crowded = (F.col("cohort_id").eqNullSafe(F.lit(single)) & F.lit(single is not None)
                   & ((symbols != alone) | (known != alone)))
        broken = shape | F.coalesce(untidy, F.lit(True))
        thin = ((F.col("cohort_id") == all_active)
                & ((F.size(known) == 0) | (F.size(symbols) == 0)
                   | (F.size(F.array_except(symbols, known)) > 0)
                   | (ratio_or_zero(covered, F.size(F.array_distinct(known))) < MIN_COVERAGE)))
        return F.array_compact(F.array(
            F.when(~F.coalesce(F.col("status") == "succeeded", F.lit(False)), "run_not_succeeded"),
            F.when(~strict, "missing_strict_evidence"),
            F.when(strict & basis.isNull(), "invalid_basis_date"),
            F.when(strict & F.col("signal_frozen_at").isNull(), "invalid_signal_frozen_at"),
            F.when(detailed & (frozen_day != basis), "signal_frozen_at_not_on_basis_date"),
            *[F.when(detailed & ~shape & _differs(e), name) for name, e in recipe.items()],
            F.when(detailed & ~shape & ~ranged, "strict_date_range_recipe_mismatch"),
            F.when(detailed & broken, "invalid_universe_snapshot"),
            F.when(detailed & ~broken & crowded, "strict_2330_universe_mismatch"),
            F.when(detailed & F.coalesce(thin, F.lit(False)), "strict_execution_coverage_mismatch")))

    # the cleaned lists are a lambda's argument, so that each is made once a run
    tidy = F.array(F.struct(clean("symbols").alias("symbols"), clean("universe").alias("known")))
    return runs.withColumn("issues", F.get(F.transform(tidy, found), F.lit(0)))


def forward_signal_issues(runs: DataFrame, signals: DataFrame) -> DataFrame:
    """(run_id, issue): the forward signals must be the requested symbols, once
    each, on the basis date, with usable values. ``issue`` NULL when fine."""
    asked = runs.select("run_id", "basis_date", F.explode_outer("symbols").alias("_a")).select(
        "run_id", "basis_date", F.upper("_a").alias("sym"))
    given = signals.where(F.col("signal_kind") == FORWARD).groupBy(
        "run_id", F.upper("symbol").alias("sym")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("date").alias("_lo"), F.max("date").alias("_hi"),
        count_true(F.col("date").isNull()).alias("_nodate"),
        F.min(finite("score").isNotNull()
              & F.coalesce(finite("up_probability").between(0.0, 1.0), F.lit(False))
              & F.coalesce(finite("position") >= 0, F.lit(False))).alias("_sane"))
    per = asked.groupBy("run_id", "sym").agg(F.count(F.lit(1)).alias("_asked"))
    basis = runs.select("run_id", "basis_date")
    j = per.where("sym IS NOT NULL").join(given, ["run_id", "sym"], "full_outer").join(basis, "run_id")
    off = (F.col("_asked").isNull() | F.col("_n").isNull() | (F.col("_n") != F.col("_asked"))
           | (F.col("_nodate") > 0) | (F.col("_lo") != F.col("basis_date"))
           | (F.col("_hi") != F.col("basis_date")))
    g = j.groupBy("run_id").agg(
        F.max(F.coalesce(off, F.lit(True))).alias("_off"), F.min("_sane").alias("_ok"))
    out = basis.join(g, "run_id", "left")
    bad = F.col("basis_date").isNull() | F.coalesce("_off", F.lit(False))
    return out.select("run_id", F.when(bad, "incomplete_forward_signals")
                      .when(~F.col("_ok"), "invalid_forward_signal").alias("issue"))


def duplicate_basis_issue(runs: DataFrame) -> DataFrame:
    """Adds duplicate_basis_date to every run whose cohort and basis date have
    more than one valid run. Counts are joined back, not windowed."""
    valid = runs.where((F.size("issues") == 0) & F.col("basis_date").isNotNull())
    many = valid.groupBy("cohort_id", "basis_date").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    j = runs.join(many, ["cohort_id", "basis_date"], "left")
    return j.withColumn("issues", F.when(F.col("_n").isNotNull(), F.array_append(
        "issues", F.lit("duplicate_basis_date"))).otherwise(F.col("issues"))).drop("_n").select(
        *runs.columns)


def run_states(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(run_id, cohort_id, basis_date, status, gross, net_complete, net)."""
    g = outcomes.groupBy("run_id").agg(
        F.max(F.col("status") == "invalid_signal").alias("_bad"),
        F.max(F.col("status") == "not_ready").alias("_wait"),
        F.sum("gross_return").alias("_gross"), F.sum("net_return").alias("_net"),
        F.max((F.col("status") == "resolved") & F.col("net_return").isNull()).alias("_hole"))
    j = runs.join(g, "run_id", "left")
    yes = F.lit(True)
    status = (F.when((F.size("issues") > 0) | F.col("basis_date").isNull()
                     | F.col("_bad").eqNullSafe(yes), "invalid")
              .when(F.col("_wait").eqNullSafe(yes), "not_ready").otherwise("resolved"))
    done = F.col("status") == "resolved"
    return j.select("run_id", "cohort_id", "basis_date", "fees", "slippage", "issues",
                    status.alias("status"), "_gross", "_net", "_hole").select(
        "run_id", "cohort_id", "basis_date", "fees", "slippage", "status",
        F.when(done, F.coalesce("_gross", F.lit(0.0))).alias("gross"),
        F.when(done & ~F.coalesce(F.col("_hole"), F.lit(False)),
               F.coalesce("_net", F.lit(0.0))).alias("net"),
        (F.size("issues") == 0).alias("valid"))


def net_outcomes(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds net_return after the run's own costs (NULL without both costs)."""
    j = outcomes.join(runs.select("run_id", "fees", "slippage"), "run_id")
    net = round_trip_net_return("actual_return", "position", fees=F.col("fees"),
                                slippage=F.col("slippage"))
    both = F.col("fees").isNotNull() & F.col("slippage").isNotNull()
    return j.withColumn("net_return", F.when((F.col("status") == "resolved") & both, net)).drop(
        "fees", "slippage")


def cohort_metrics(resolved: DataFrame) -> DataFrame:
    """Per cohort_id over resolved outcomes of resolved runs."""
    e = F.col("actual_return") - F.col("score")
    base = resolved.groupBy("cohort_id").agg(
        F.count(F.lit(1)).alias("resolved_signals"),
        F.countDistinct("basis_date").alias("completed_days"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.col("direction_hit").cast("double")).alias("direction_accuracy"),
        F.avg("brier").alias("brier"),
        F.avg((F.col("position") > 0).cast("double")).alias("active_share"),
        F.when(F.count(F.lit(1)) > 1, finite(F.corr("actual_return", "score"))).alias("linear_ic"))
    pairs = resolved.select("cohort_id", F.col("actual_return").alias("actual"),
                            F.col("score").alias("predicted"))
    return base.join(rank_ic(pairs, keys=["cohort_id"]), "cohort_id", "left")


def compound_daily_returns(points: DataFrame, *, value: str, weighted: bool,
                           keys: Sequence[str] = ("cohort_id",), name: str = "compounded"
                           ) -> DataFrame:
    """Sum (or mean) per basis date, then compounded over the dates."""
    daily = F.sum(value) if weighted else F.avg(value)
    return (points.groupBy(*keys, "basis_date").agg(daily.alias("_r")).groupBy(*keys)
            .agg((F.product(F.col("_r") + 1.0) - 1.0).alias(name)))


def cost_consistency(states: DataFrame) -> DataFrame:
    """(cohort_id, fees, slippage, net_return): the net result exists only when
    valid runs share one cost pair and every resolved run has a net value."""
    pair = F.struct("fees", "slippage")
    priced = F.col("valid") & F.col("fees").isNotNull() & F.col("slippage").isNotNull()
    done = F.col("status") == "resolved"
    g = states.groupBy("cohort_id").agg(
        F.countDistinct(F.when(priced, pair)).alias("_pairs"),
        F.min(F.when(priced, pair)).alias("_pair"), count_true(done).alias("_done"),
        count_true(done & F.col("net").isNotNull()).alias("_net"))
    comp = compound_daily_returns(states.where(done & F.col("net").isNotNull()), value="net",
                                  weighted=True)
    one = F.col("_pairs") == 1
    return g.join(comp, "cohort_id", "left").select(
        "cohort_id", F.when(one, F.col("_pair.fees")).alias("fees"),
        F.when(one, F.col("_pair.slippage")).alias("slippage"),
        F.when(one & (F.col("_done") == F.col("_net")), F.col("compounded")).alias("net_return"))


def cohort_preflight(universe: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cohort_id, symbol, reason), per-cohort coverage and status).

    ``universe``: (cohort_id, symbol); ``flags``: (symbol, latest_date,
    basis_date, calibration_ok, signal_ok), one row per modelled symbol.
    """
    j = universe.join(flags, "symbol", "left")
    reason = (F.when(F.col("latest_date").isNull(), "model_preflight_failed")
              .when(F.col("latest_date") != F.col("basis_date"), "basis_date_not_latest_feature_date")
              .when(~F.col("calibration_ok"), "direction_calibration_unavailable")
              .when(~F.col("signal_ok"), "forward_signal_unavailable"))
    rows = j.select("cohort_id", "symbol", reason.alias("reason"))
    g = rows.groupBy("cohort_id").agg(
        F.count(F.lit(1)).alias("full_universe_count"),
        count_true(F.col("reason").isNull()).alias("execution_universe_count"))
    cover = ratio_or_zero("execution_universe_count", "full_universe_count")
    return rows, g.withColumn("coverage", cover).withColumn(
        "status", F.when(F.col("coverage") >= MIN_COVERAGE, "ready").otherwise("no-opinion"))


def _valid_row() -> Column:
    return (finite("score").isNotNull() & finite("position").isNotNull()
            & F.coalesce(finite("up_probability").between(0.0, 1.0), F.lit(False))
            & F.coalesce(F.col("predicted_direction").isin("up", "down"), F.lit(False)))


def latest_signal_snapshot(signals: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(latest rows, per-run summary) of the forward signals.

    ``signals`` has ordinal, the list position; ``declared`` is (run_id,
    symbol). Rows collapse per (run, symbol, date) first, then per (run, symbol).
    """
    fwd = signals.where(F.col("signal_kind") == FORWARD)
    want = declared.select("run_id", "symbol").distinct().withColumn("_in", F.lit(True))
    named = F.coalesce(F.col("symbol"), F.lit("")) != ""
    j = fwd.join(want, ["run_id", "symbol"], "left")
    usable = named & F.col("_in").isNotNull() & F.col("date").isNotNull()
    broken = j.groupBy("run_id").agg(
        count_true(~usable).alias("_broken"),
        F.sort_array(F.collect_set(F.when(named & F.col("_in").isNull(), F.col("symbol"))))
        .alias("unexpected"))
    rest = [c for c in fwd.columns if c not in ("run_id", "symbol", "date")]
    per_day = j.where(usable).groupBy("run_id", "symbol", "date").agg(
        F.min_by(F.struct(*rest), F.col("ordinal")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    picked = per_day.groupBy("run_id", "symbol").agg(
        F.max(F.struct("date", "_n")).alias("_m"), F.max_by("_r", "date").alias("_r"))
    latest = picked.select("run_id", "symbol", F.col("_m.date").alias("date"),
                           F.col("_m._n").alias("_n"), "_r.*").withColumn("_ok", _valid_row())
    top = latest.groupBy("run_id").agg(F.max("date").alias("_top"))
    marked = latest.join(top, "run_id").withColumn(
        "valid", F.col("_ok") & (F.col("date") == F.col("_top")))
    g = marked.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_have"), F.sum("_n").alias("_rows"),
        F.countDistinct("date").alias("_dates"),
        count_true(~F.col("valid")).alias("_bad"))
    n = declared.select("run_id", "symbol").distinct().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_want"))
    s = n.join(g, "run_id", "full_outer").join(broken, "run_id", "full_outer").fillna(
        0, ["_want", "_have", "_rows", "_dates", "_bad", "_broken"])
    invalid = F.col("_broken") + (F.col("_rows") - F.col("_have")) + F.col("_bad")
    complete = ((F.col("_want") > 0) & (F.col("_have") == F.col("_want"))
                & (F.col("_dates") == 1) & (invalid == 0))
    summary = s.select(
        "run_id", F.col("_have").cast("bigint").alias("latest_count"),
        invalid.cast("bigint").alias("invalid_row_count"),
        F.coalesce("unexpected", F.array().cast("array<string>")).alias("unexpected_symbols"),
        complete.alias("snapshot_complete"))
    return marked.drop("_ok", "_n", "_top"), summary


def opinion_buckets(latest: DataFrame, policy: DataFrame) -> DataFrame:
    """(run_id, symbol, bucket, confirmation_state) of runs without limitations.

    ``policy``: (run_id, threshold, confirm, limitation_count).
    """
    j = latest.where("valid").join(policy.where("limitation_count = 0"), "run_id").where(
        F.col("threshold").isNotNull() & F.col("confirm").isNotNull())
    low_score = F.col("score") < F.col("threshold")
    low_p = F.col("up_probability") < F.col("confirm")
    bucket = (F.when((F.col("position") > 0) & ~low_p, "buy")
              .when(low_score & low_p, "avoid").otherwise("watch"))
    return j.select("run_id", "symbol", bucket.alias("bucket"), F.when(
        (bucket == "buy") | (low_score == low_p), "confirmed").otherwise("conflict")
        .alias("confirmation_state"))


def parameter_sensitivity(latest: DataFrame, policy: DataFrame) -> DataFrame:
    """Per run: candidate counts of four scenarios, stable and changed counts.

    Membership is a flag per row, so the set algebra is a pair of conditional
    counts. ``policy``: (run_id, threshold, top_n).
    """
    rows = latest.where(_valid_row()).join(policy.select("run_id", "threshold", "top_n"), "run_id")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("score").desc(), "symbol"))
    t, n = F.col("threshold"), F.col("top_n")
    r = rows.withColumn("_rank", rank).withColumn("base", F.col("position") > 0)
    scenes = {"strict_threshold": F.when(t > 0, F.col("score") >= t * STRICTER),
              "loose_threshold": F.when(t > 0, F.col("score") >= t * LOOSER),
              "top_n_minus_1": F.when(n > 1, F.col("_rank") <= n - 1),
              "top_n_plus_1": F.when(n >= 1, F.col("_rank") <= n + 1)}
    r = r.withColumns(scenes)
    stable, changed, any_scene = F.col("base"), F.lit(False), F.lit(False)
    for s in scenes:
        stable = stable & F.coalesce(F.col(s), F.lit(True))
        changed = changed | F.coalesce(F.col(s) != F.col("base"), F.lit(False))
        any_scene = any_scene | F.col(s).isNotNull()
    return r.groupBy("run_id").agg(
        count_true(F.col("base")).alias("base"),
        *[F.when(F.count(s) > 0, count_true(F.col(s))).alias(s) for s in scenes],
        F.when(F.max(any_scene), count_true(stable)).otherwise(0).cast("bigint").alias("stable"),
        F.when(F.max(any_scene), count_true(changed)).otherwise(0).cast("bigint").alias("changed"))


def warning_attribution(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, symbol, family, text): the first warning naming the symbol as a
    whole token, else unscoped, caveat or none. ``runs``: (run_id, warnings,
    caveats array of code, severity)."""
    j = rows.select("run_id", "symbol").join(runs.select("run_id", "warnings", "caveats"), "run_id")
    quoted = F.regexp_replace(F.col("symbol"), r"([^A-Za-z0-9_])", r"\\$1")
    token = F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))
    hit = F.try_element_at(F.filter("warnings", lambda w: F.rlike(w, token)), F.lit(1))
    warned = F.coalesce(F.size("warnings"), F.lit(0)) > 0
    first = F.try_element_at("caveats", F.lit(1))
    family = (F.when(warned & hit.isNotNull(), "warning").when(warned, "unscoped_warning")
              .when(first.isNotNull(), "caveat").otherwise("checked_no_warning"))
    text = (F.when(warned, hit).otherwise(F.concat_ws(
        ": ", F.coalesce(first["code"], F.when(first.isNotNull(), "COMPARISON_CAVEAT")),
        F.coalesce(first["severity"], F.when(first.isNotNull(), "blocker")))))
    return j.select("run_id", "symbol", family.alias("family"),
                    F.when(text != "", text).alias("text"))


def invalidation_reason(stale_days: str = "stale_days", stale_share: str = "stale_share",
                        caveats: str = "caveats") -> Column:
    stale = ((F.coalesce(F.col(stale_days), F.lit(0)) != 0)
             | (F.coalesce(F.col(stale_share), F.lit(0.0)) != 0))
    return (F.when(stale, "stale_freshness")
            .when(F.coalesce(F.size(caveats), F.lit(0)) > 0, "comparison_caveats")
            .otherwise("newer_run_or_market_data"))


def blocker_count(status: str = "status", completeness: str = "artifact_completeness",
                  caveats: str = "caveats") -> Column:
    usable = F.coalesce((F.col(status) == "succeeded") & (F.col(completeness) == "complete"),
                        F.lit(False))
    blocking = F.filter(caveats, lambda c: F.coalesce(
        (c["severity"] == "blocker") | c["code"].endswith("_MISSING")
        | c["code"].endswith("_ONLY"), F.lit(False)))
    return F.when(usable, F.size(blocking)).otherwise(F.size(caveats)).cast("bigint")


def review_checks(runs: DataFrame) -> DataFrame:
    """(run_id, check, category, status): twelve checks per run from typed flags.

    Booleans: request, strategy, diagnostics, signals, metrics, threshold_policy,
    price_basis, boundary, validation, validation_metrics, baselines,
    snapshot_complete, config_sources, fallback_audit. Counts: latest, rows,
    limitations, caveats, warnings, blockers, traceable, risky, invalidated.
    Texts: state, sensitivity.
    """
    b = F.col
    some_rows, limited = b("rows") > 0, b("limitations") > 0

    def full(c: str) -> Column:
        return some_rows & (b(c) == b("rows"))

    def passed(ok: Column, otherwise: str = "fail") -> Column:
        return F.when(ok, "pass").otherwise(otherwise)

    lifecycle = (b("request") & b("strategy") & b("diagnostics") & b("signals") & b("metrics")
                 & (some_rows | limited))
    texts = b("warnings") + b("caveats")
    checks = [
        ("strategy_lifecycle", "method", passed(lifecycle)),
        ("signal_to_position", "method", F.when(b("latest") == 0, "fail")
         .when(b("snapshot_complete"), "pass").otherwise("warning")),
        ("backtest_report_discipline", "method", F.when(~b("metrics"), "fail")
         .when(b("threshold_policy") & b("price_basis") & b("boundary") & (b("caveats") == 0), "pass")
         .otherwise("warning")),
        ("robustness", "method",
         F.when(b("validation_metrics") & b("baselines") & (b("blockers") == 0), "pass")
         .when(b("validation") | (texts > 0) | ~b("baselines"), "warning")
         .otherwise("not_evaluated")),
        ("parameter_sensitivity", "method", b("sensitivity")),
        ("evidence_traceability", "self_review", passed(full("traceable") | (b("state") != "viable"))),
        ("risk_present", "self_review", passed(full("risky") | limited)),
        ("invalidation_present", "self_review", passed(full("invalidated") | limited)),
        ("manual_adoption_boundary", "self_review", passed(b("boundary"))),
        ("insufficient_evidence_gate", "self_review",
         passed(~limited | b("state").isin("no-opinion", "do-not-adopt"))),
        ("source_artifact_audit", "source_provider_audit",
         F.when(b("config_sources") | b("fallback_audit"), "warning").otherwise("not_evaluated")),
        ("text_evidence_summary", "evidence_summary",
         F.when(texts > 0, "warning").otherwise("not_evaluated")),
    ]
    return runs.select("run_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), F.lit(c).alias("category"), s.alias("status"))
        for n, c, s in checks])))


def _holds_phrase(text: Column) -> Column:
    hit = F.lit(False)
    for phrase in FORBIDDEN_PHRASES:
        hit = hit | text.contains(phrase)
    return F.coalesce(hit, F.lit(False))


def forbidden_phrase_scan(texts: DataFrame, *, keys: Sequence[str] = ("run_id",),
                          order: str | None = None, slice_rows: int = 4096) -> DataFrame:
    """(keys, boundary_present): no text holds a forbidden phrase, nor do the texts of a
    key joined by a space in ``order``, a column of unique integers.

    Separators and runs of space count as one space, case does not matter; NULL and blank
    texts only add space. Without ``order`` texts are judged one by one. A phrase of w words
    lies on at most w texts, so of a text only its two ends are looked at by its neighbours,
    which are found within slices of ``slice_rows`` numbers and then among the slices' first
    and last texts: a key with very many texts stays spread over tasks.
    """
    keys = list(keys)
    spaced = F.regexp_replace(F.regexp_replace(F.lower("text"), "[-_/]+", " "), BLANKS, " ")
    plain = texts.select(*keys, *([F.col(order).alias("_at")] if order else []),
                         F.trim(spaced).alias("_t"))
    inside = plain.select(*keys, _holds_phrase(F.col("_t")).alias("_hit"))
    if order:
        size = max(map(len, FORBIDDEN_PHRASES))
        reach = max(len(phrase.split()) for phrase in FORBIDDEN_PHRASES) - 1
        ends = plain.where("_t <> ''").select(
            *keys, "_at", F.floor(F.col("_at") / slice_rows).alias("_slice"),
            F.right("_t", F.lit(size)).alias("_tail"),
            F.struct(F.left("_t", F.lit(size)).alias("head"),
                     (F.length("_t") <= size).alias("whole")).alias("_head"))
        near = Window.partitionBy(*keys, "_slice").orderBy("_at")
        far = Window.partitionBy(*keys).orderBy("_at")

        def following(w: Window) -> list[Column]:
            return [F.lead("_head", i).over(w).alias(f"_n{i}") for i in range(1, reach + 1)]

        def across(rows: DataFrame) -> DataFrame:
            text, go_on = F.col("_tail"), F.lit(True)
            for i in range(1, reach + 1):
                text = F.concat_ws(" ", text, F.when(go_on, F.col(f"_n{i}.head")))
                go_on = go_on & F.coalesce(F.col(f"_n{i}.whole"), F.lit(False))
            return rows.select(*keys, _holds_phrase(text).alias("_hit"))

        local = ends.select("*", *following(near),
                            F.lag("_at", reach).over(near).isNull().alias("_early"))
        late = F.col(f"_n{reach}").isNull()
        edges = local.where(F.col("_early") | late).select(
            *keys, "_at", "_tail", "_head", late.alias("_late"))
        outer = edges.select("*", *following(far)).where("_late")
        inside = inside.unionByName(across(local.where(~late))).unionByName(across(outer))
    return inside.groupBy(*keys).agg((~F.max("_hit")).alias("boundary_present"))
