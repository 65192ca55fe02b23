"""Scores to weights, weights to returns and metrics.

Frames are long: (run keys, date, symbol, value). Cross-sections are windows per
(run, date), bounded by the size of the universe; time series are windows per
(run, symbol) or per run over one row per date, bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import count_true, finite, ratio

RUN = ("run_id",)

# Costs per market, and the default strategy bundle.
MARKET_COSTS = {"TW": (0.002, 0.001), "US": (0.0005, 0.0005)}
DEFAULT_THRESHOLD = 0.01
DEFAULT_TOP_N = 10
DEFAULT_BUNDLE = "research_spec_v1"
TRADING_DAYS = 252

TIE = 1e-12


def _eligible(threshold, probabilities: str | None, p_min) -> Column:
    score = finite("score")
    ok = score.isNotNull() & (score >= threshold)
    if probabilities:
        p = finite(probabilities)
        ok = ok & F.coalesce(p.between(p_min, 1.0), F.lit(False))
    return ok


def _selection(scores: DataFrame, *, threshold, top_n, probabilities, p_min,
               keys: Sequence[str]) -> DataFrame:
    """scores with ``_pick``: among the top N eligible of its date."""
    marked = scores.withColumn("_ok", _eligible(threshold, probabilities, p_min))
    best = Window.partitionBy(*keys, "date").orderBy(
        F.col("_ok").desc(), F.col("score").desc(), F.col("position"))
    return marked.withColumn("_pick", F.col("_ok") & (F.row_number().over(best) <= top_n))


def topn_weights(scores: DataFrame, *, threshold: float | Column, top_n: int | Column,
                 probabilities: str | None = None, p_min: float | Column = 0.5,
                 keys: Sequence[str] = RUN, keep: Sequence[str] = ()) -> DataFrame:
    """(keys, date, symbol, keep..., weight): equal weight on the top N, 0 elsewhere.

    ``scores`` has (keys, date, symbol, position, score). Ties go to the lower
    position. Threshold and N may be columns, so many runs go in one plan.
    """
    picked = _selection(scores, threshold=threshold, top_n=top_n,
                        probabilities=probabilities, p_min=p_min, keys=keys)
    n = F.sum(F.col("_pick").cast("int")).over(Window.partitionBy(*keys, "date"))
    return picked.select(*keys, "date", "symbol", *keep, F.when(
        F.col("_pick"), F.lit(1.0) / n).otherwise(F.lit(0.0)).alias("weight"))


def hold_weights(scores: DataFrame, *, threshold: float, top_n: int,
                 probabilities: str | None = None, p_min: float = 0.5,
                 keys: Sequence[str] = RUN) -> DataFrame:
    """Never-sell weights: everything selected so far, equally, on every date of the run.

    A held symbol has a row also on dates without one of its own, as it is not sold.
    """
    picked = _selection(scores, threshold=threshold, top_n=top_n,
                        probabilities=probabilities, p_min=p_min, keys=keys)
    keys = list(keys)
    first = picked.where("_pick").groupBy(*keys, "symbol").agg(F.min("date").alias("_first"))
    dates = picked.select(*keys, "date").distinct()
    since = dates.join(first, keys).where(F.col("date") >= F.col("_first")).select(
        *keys, "date", "symbol", F.lit(True).alias("_in"))
    held = picked.select(*keys, "date", "symbol").join(since, [*keys, "date", "symbol"], "full").select(
        *keys, "date", "symbol", F.coalesce("_in", F.lit(False)).alias("_held"))
    n = F.sum(F.col("_held").cast("int")).over(Window.partitionBy(*keys, "date"))
    return held.select(*keys, "date", "symbol", F.when(
        F.col("_held"), F.lit(1.0) / n).otherwise(F.lit(0.0)).alias("weight"))


def market_cost_defaults(runs: DataFrame, market: str = "market") -> DataFrame:
    """Adds fees and slippage of the market; an unknown market gets TW's."""
    name = F.upper(F.coalesce(F.col(market), F.lit("")))

    def pick(i: int) -> Column:
        return F.when(name == "US", F.lit(MARKET_COSTS["US"][i])).otherwise(
            F.lit(MARKET_COSTS["TW"][i]))

    return runs.withColumn("fees", pick(0)).withColumn("slippage", pick(1))


def resolve_strategy(runs: DataFrame) -> DataFrame:
    """Effective threshold and top_n with where each came from.

    Needs runtime_mode, default_bundle_version, threshold, top_n; adds
    eff_threshold, eff_top_n, threshold_source, top_n_source, issue.
    """
    spec = F.col("runtime_mode") == "vnext_spec_mode"
    compat = F.col("runtime_mode") == "runtime_compatibility_mode"
    known = F.col("default_bundle_version") == DEFAULT_BUNDLE
    missing = F.col("threshold").isNull() | F.col("top_n").isNull()
    issue = (F.when(~(spec | compat) | F.col("runtime_mode").isNull(), "unsupported_mode")
             .when(F.col("default_bundle_version").isNotNull() & ~known, "unsupported_bundle")
             .when(compat & F.col("threshold").isNull(), "threshold_required")
             .when(compat & F.col("top_n").isNull(), "top_n_required")
             .when(spec & missing & F.col("default_bundle_version").isNull(), "bundle_required"))

    def source(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), "request_override").otherwise("spec_default")

    return (runs.withColumn("issue", issue)
            .withColumn("eff_threshold", F.when(F.col("issue").isNull(), F.coalesce(
                F.col("threshold"), F.lit(DEFAULT_THRESHOLD))))
            .withColumn("eff_top_n", F.when(F.col("issue").isNull(), F.coalesce(
                F.col("top_n").cast("bigint"), F.lit(DEFAULT_TOP_N).cast("bigint"))))
            .withColumn("threshold_source", source("threshold"))
            .withColumn("top_n_source", source("top_n")))


def _equal_among(cells: DataFrame, signal: str, keys: Sequence[str]) -> DataFrame:
    n = F.sum(F.coalesce(F.col(signal).cast("int"), F.lit(0))).over(
        Window.partitionBy(*keys, "date"))
    return cells.select(*keys, "date", "symbol", F.when(
        F.col(signal).isNotNull(),
        F.col(signal).cast("double") / F.greatest(n, F.lit(1))).alias("weight"))


def baseline_buy_hold(cells: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    """1/n on every symbol of the panel, every date."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "date"))
    return cells.select(*keys, "date", "symbol", (F.lit(1.0) / n).alias("weight"))


def baseline_momentum(panel: DataFrame, *, lookback: int = 1, keys: Sequence[str] = RUN
                      ) -> DataFrame:
    """Equal weight on symbols whose previous-row return was positive.

    A missing price counts as the last known one in the return, as the padded
    percent change does.
    """
    order = Window.partitionBy(*keys, "symbol").orderBy("date")
    padded = F.last("close", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    p = panel.select(*keys, "date", "symbol", padded.alias("_c"))
    ret = ratio(F.col("_c"), F.lag("_c", lookback).over(order)) - 1.0
    p = p.withColumn("_r", ret)
    signal = F.coalesce(F.lag("_r").over(order) > 0, F.lit(False))
    return _equal_among(p.withColumn("_s", signal), "_s", keys)


def baseline_ma_cross(panel: DataFrame, *, short: int = 5, long: int = 20,
                      keys: Sequence[str] = RUN) -> DataFrame:
    """Equal weight where SMA(short) > SMA(long) on the previous row.

    The first date has a NULL weight (no order); warm-up dates after it are 0. Averages
    within TIE of each other are equal: on a flat price only rounding tells them apart.
    """
    order = Window.partitionBy(*keys, "symbol").orderBy("date")

    def sma(w: int) -> Column:
        frame = order.rowsBetween(-(w - 1), 0)
        return F.when(F.count("close").over(frame) == w, F.avg("close").over(frame))

    p = panel.select(*keys, "date", "symbol",
                     F.coalesce(sma(short) - sma(long) > TIE * F.abs(sma(long)), F.lit(False)).alias("_x"))
    return _equal_among(p.withColumn("_s", F.lag("_x").over(order)), "_s", keys)


def weight_changes(weights: DataFrame, *, keys: Sequence[str] = RUN,
                   prices: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """(keys, symbol, date, idx, weight, held, delta, columns..., prev_columns...).

    A (run, date) without a row for a symbol means weight 0, so the frame may
    leave zero rows out: the drop to zero on the next run date is added here
    instead of building the full date x symbol grid. ``held`` is the weight of
    the previous run date; on the first run date ``delta`` is the weight itself.
    Price columns are the last known on run dates, ``prev_`` the ones before;
    without ``prices`` they are read from the weights frame itself.
    """
    keys, columns = list(keys), list(columns)
    order = Window.partitionBy(*keys).orderBy("date")
    dates = weights.select(*keys, "date").distinct().select(
        *keys, "date", (F.row_number().over(order) - 1).cast("bigint").alias("idx"),
        F.lead("date").over(order).alias("_next_date"))
    series = Window.partitionBy(*keys, "symbol").orderBy("idx")
    carried = columns if prices is None else []
    w = weights.select(*keys, "date", "symbol", "weight", *carried)
    if columns and prices is not None:
        w = w.join(prices.select("symbol", "date", *columns), ["symbol", "date"], "left")
    w = w.join(dates, [*keys, "date"])
    adjacent = F.coalesce(F.lag("idx").over(series) == F.col("idx") - 1, F.lit(False))
    leaves = (F.coalesce(F.lead("idx").over(series) != F.col("idx") + 1, F.lit(True))
              & F.col("_next_date").isNotNull() & (F.coalesce("weight", F.lit(0.0)) != 0))
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    w = w.select(
        *keys, "symbol", "date", "idx", "_next_date",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.when(adjacent, F.coalesce(F.lag("weight").over(series), F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("held"),
        leaves.alias("_leaves"),
        *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns])
    w = w.select("*", *[F.lag(c).over(series).alias(f"prev_{c}") for c in columns])
    own = F.struct("date", "idx", "weight", "held", *columns,
                   *[f"prev_{c}" for c in columns])
    closing = F.struct(F.col("_next_date").alias("date"), (F.col("idx") + 1).alias("idx"),
                       F.lit(0.0).alias("weight"), F.col("weight").alias("held"), *columns,
                       *[F.col(c).alias(f"prev_{c}") for c in columns])
    rows = w.select(*keys, "symbol", F.explode(F.array_compact(F.array(
        own, F.when(F.col("_leaves"), closing)))).alias("r"))
    return rows.select(*keys, "symbol", "r.*").withColumn(
        "delta", F.col("weight") - F.col("held"))


def execution_price(weights: DataFrame, prices: DataFrame | None = None, *, market: str,
                    keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, date, symbol, weight, delta, open, high, low, close, price).

    Cells without a bar use the symbol's last known prices.
    """
    ohlc = ["open", "high", "low", "close"]
    moved = weight_changes(weights, keys=keys, prices=prices, columns=ohlc)
    worst_buy = F.greatest("open", "close" if market.upper() == "US" else "low")
    price = (F.when(F.col("delta") > 0, worst_buy)
             .when(F.col("delta") < 0, F.least("open", "high"))
             .otherwise(F.col("open")))
    return moved.select(*keys, "date", "symbol", "weight", "delta", *ohlc, price.alias("price"))


def execution_price_checks(executed: DataFrame, *, market: str, keys: Sequence[str] = RUN
                           ) -> DataFrame:
    """Per run: open outside [low, high], and US buys below the close."""
    us = F.lit(market.upper() == "US")
    return executed.groupBy(*keys).agg(
        F.coalesce(F.max((F.col("open") < F.col("low")) | (F.col("open") > F.col("high"))),
                   F.lit(False)).alias("ohlc_out_of_range"),
        count_true(us & (F.col("delta") > 0) & (F.col("price") < F.col("close")))
        .alias("buys_below_close"))


def turnover(weights: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    """Half the mean over dates of the summed absolute changes; first date 0."""
    moved = weight_changes(weights, keys=keys)
    return moved.groupBy(*keys).agg(
        (F.sum(F.when(F.col("idx") > 0, F.abs("delta")).otherwise(F.lit(0.0)))
         / (F.max("idx") + 1) / 2.0).alias("turnover"))


def max_position_weight(weights: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    return weights.groupBy(*keys).agg(
        F.coalesce(F.max(F.abs("weight")), F.lit(0.0)).alias("max_position_weight"))


def portfolio_returns(weights: DataFrame, prices: DataFrame | None = None, *, return_target: str,
                      fees: float = 0.0, slippage: float = 0.0, keys: Sequence[str] = RUN
                      ) -> DataFrame:
    """(keys, date, gross, cost, ret): yesterday's weights on today's price move.

    Closed form in place of an order-by-order simulator: a position earns the
    move between consecutive run dates (none on a date without a bar), and cost
    is (fees + slippage) times the day's absolute weight change.
    """
    keys = list(keys)
    basis = "open" if return_target == "open_to_open" else "close"
    moved = weight_changes(weights, keys=keys, prices=prices, columns=[basis])
    move = ratio(F.col(basis), F.col(f"prev_{basis}")) - 1.0
    legs = moved.select(
        *keys, "date", F.coalesce(F.col("held") * move, F.lit(0.0)).alias("_g"),
        F.abs("delta").alias("_d"))
    return legs.groupBy(*keys, "date").agg(
        F.sum("_g").alias("gross"),
        (F.sum("_d") * F.lit(fees + slippage)).alias("cost")
    ).withColumn("ret", F.col("gross") - F.col("cost"))


def equity_curve(returns: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, date, equity): compounded value, 0 from the first return of -1 or less on."""
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.when(F.col("ret") > -1, F.log1p("ret"))
    lost = F.coalesce(F.max(F.col("ret") <= -1).over(upto), F.lit(False))
    return returns.select(*keys, "date", F.when(lost, F.lit(0.0)).otherwise(
        F.exp(F.sum(growth).over(upto))).alias("equity"))


def portfolio_metrics(curve: DataFrame, *, keys: Sequence[str] = RUN) -> DataFrame:
    """total_return from the first point, annualised sharpe, max_drawdown."""
    order = Window.partitionBy(*keys).orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = curve.select(
        *keys, "date", "equity",
        (ratio(F.col("equity"), F.lag("equity").over(order)) - 1.0).alias("_r"),
        (ratio(F.col("equity"), F.max("equity").over(upto)) - 1.0).alias("_dd"))
    sd = F.stddev_samp("_r")
    return steps.groupBy(*keys).agg(
        (ratio(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1.0)
        .alias("total_return"),
        F.coalesce(ratio(F.avg("_r"), F.when(sd != 0, sd)) * math.sqrt(TRADING_DAYS),
                   F.lit(0.0)).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"))


def metrics_finite_gate(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``finite_metrics``: every named metric present and finite."""
    ok = F.lit(bool(columns))
    for c in columns:
        ok = ok & finite(c).isNotNull()
    return metrics.withColumn("finite_metrics", ok)


def signal_rows(scores: DataFrame, weights: DataFrame, *, probabilities: str | None = None,
                kind: str = "holdout_evaluation", threshold: float = 0.5,
                keys: Sequence[str] = RUN) -> DataFrame:
    """Positive weights, plus every scored symbol of the last date at position 0."""
    extra = [probabilities] if probabilities else []
    joined = weights.join(scores.select(*keys, "date", "symbol", "score", *extra),
                          [*keys, "date", "symbol"], "left")
    last = joined.join(weights.groupBy(*keys).agg(F.max("date").alias("_last")), list(keys))
    score = F.when(~F.isnan("score"), F.col("score"))
    rows = last.where((F.col("weight") > 0) | (
        (F.col("date") == F.col("_last")) & score.isNotNull()))
    p = F.when(~F.isnan(probabilities), F.col(probabilities)) if probabilities \
        else F.lit(None).cast("double")
    return rows.select(
        *keys, "date", "symbol", score.alias("score"),
        F.coalesce("weight", F.lit(0.0)).alias("position"),
        F.lit(kind).alias("signal_kind"), p.alias("up_probability"),
        F.when(p >= threshold, "up").when(p.isNotNull(), "down").alias("predicted_direction"))


def round_trip_net_return(actual: str | Column, position: str | Column, *,
                          fees: float | Column, slippage: float | Column) -> Column:
    """position * [(1+r)(1-s)/(1+s)(1-f)^2 - 1]; a non-positive position gives 0."""
    r = F.col(actual) if isinstance(actual, str) else actual
    w = F.col(position) if isinstance(position, str) else position
    f = F.lit(fees) if not isinstance(fees, Column) else fees
    s = F.lit(slippage) if not isinstance(slippage, Column) else slippage
    kept = (1.0 - s) / (1.0 + s) * (1.0 - f) * (1.0 - f)
    return F.when(w > 0, w * ((1.0 + r) * kept - 1.0)).otherwise(F.lit(0.0))


# The names that runs give their baselines.
BASELINES = {"buy_and_hold": baseline_buy_hold, "naive_momentum": baseline_momentum,
             "ma_crossover": baseline_ma_cross}
METRICS = ("total_return", "sharpe", "max_drawdown")


def baseline_metrics(panel: DataFrame, requests: DataFrame, *, return_target: str, fees: float = 0.0,
                     slippage: float = 0.0, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, baseline, total_return, sharpe, max_drawdown, evaluated): baselines judged as runs are.

    ``panel``: (keys, symbol, date, open, close), every symbol of a run on each of its dates,
    NULL prices where there is no bar; ``requests``: (keys, baseline). Weights come from the
    last known closes, then go through the returns, the equity curve and the metrics of the
    runs themselves, all runs and baselines in one plan. A request whose name is not in BASELINES,
    whose run has no panel or whose metrics are not finite is a row that is not ``evaluated``.
    """
    keys = list(keys)
    basis = "open" if return_target == "open_to_open" else "close"
    upto = Window.partitionBy(*keys, "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = panel.select(*keys, "symbol", "date", *[
        F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("open", "close")])
    asked = requests.select(*keys, "baseline").distinct()
    weights = None
    for name, build in BASELINES.items():
        runs = asked.where(F.col("baseline") == name).drop("baseline")
        mine = build(filled.join(runs, keys, "left_semi"), keys=keys).withColumn("baseline", F.lit(name))
        weights = mine if weights is None else weights.unionByName(mine)
    priced = weights.join(filled.select(*keys, "symbol", "date", basis), [*keys, "symbol", "date"])
    both = [*keys, "baseline"]
    returns = portfolio_returns(priced, return_target=return_target, fees=fees, slippage=slippage, keys=both)
    metrics = metrics_finite_gate(
        portfolio_metrics(equity_curve(returns, keys=both), keys=both), METRICS)
    return asked.join(metrics, both, "left").select(
        *both, *METRICS, F.coalesce("finite_metrics", F.lit(False)).alias("evaluated"))


def baseline_delta(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """(run_id, total_return, best_baseline, best_return, delta, verdict).

    ``runs``: (run_id, total_return); ``baselines``: (run_id, baseline, total_return).
    """
    best = baselines.where(finite("total_return").isNotNull()).groupBy("run_id").agg(
        F.max(F.struct(F.col("total_return").alias("best_return"),
                       F.col("baseline").alias("best_baseline"))).alias("b")
    ).select("run_id", "b.best_baseline", "b.best_return")
    delta = F.col("total_return") - F.col("best_return")
    return runs.select("run_id", "total_return").join(best, "run_id", "left").withColumn(
        "delta", delta).withColumn("verdict", F.when(delta.isNull(), "unavailable")
                                   .when(delta >= 0, "ahead").otherwise("behind"))
