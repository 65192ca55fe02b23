"""Windowed bar features and forward-return labels.

Input bars hold one row per (symbol, date), so a symbol's partition is bounded
by the length of the trading calendar. Series that are much longer (minute
bars) can be cut into overlapping chunks with ``chunk_rows``: the hot series is
then computed by many tasks and the result is the same.

All features of one call share a single shuffle and sort on the series key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions.columns import change, finite, ratio
from barloom.functions.prefix import chunked, positions

# Feature names with their default windows, and price sources.
DEFAULT_WINDOWS = {"ma": 5, "ema": 5, "rsi": 14, "roc": 10, "volatility": 20, "zscore": 20}
SOURCES = ("open", "high", "low", "close", "volume")
LABEL_TARGETS = ("open_to_open", "close_to_close", "open_to_close")
TRADING_DAYS = 252


@dataclass(frozen=True, order=True)
class Feature:
    name: str
    window: int
    source: str = "close"
    shift: int = 0

    def __post_init__(self):
        if self.name not in DEFAULT_WINDOWS:
            raise ValueError(f"unknown feature {self.name!r}")
        if self.source not in SOURCES:
            raise ValueError(f"unknown source {self.source!r}")
        if self.window < 1 or self.shift < 0:
            raise ValueError("window must be >= 1 and shift >= 0")

    @property
    def column(self) -> str:
        tail = "" if self.source == "close" else f"_{self.source}"
        return f"{self.name.upper()}_{self.window}{tail}"


def _decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _ema_lookback(span: int) -> int:
    """Rows after which the weight of older values is below 1e-18."""
    q = _decay(span)
    return 1 if q <= 0 else math.ceil(math.log(1e-18) / math.log(q))


def _ema_block(span: int) -> int:
    """Rows after which q**-n would come near the double range."""
    q = _decay(span)
    return 1 if q <= 0 else max(1, int(550 / -math.log(q)))


def feature_lookback(features: Iterable[Feature]) -> int:
    """Earlier rows needed so that the last row of a chunk is exact."""
    need = 1
    for f in features:
        own = {"ema": max(_ema_lookback(f.window), f.window)}.get(f.name, f.window + 1)
        need = max(need, own + f.shift)
    return need


def _ema_columns(df: DataFrame, specs: Sequence[Feature], series: Sequence[str],
                 first: Mapping[str, Column]) -> DataFrame:
    """Recursive EMA as running sums of weighted observations.

    The first observation is the seed. After g rows the older mean weighs q**g against
    1 - q of the new observation, so rows without one only age it. The product of the
    older means' shares is kept as a running logarithm; sums restart in blocks of 550
    of it, and one block earlier is all that still has weight.
    """
    order = Window.partitionBy(*series).orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    for f in specs:
        q = _decay(f.window)
        x = F.col(f.source).cast("double")
        if q <= 0:
            df = df.withColumn(f"_{f.column}", F.last(x, ignorenulls=True).over(upto))
            continue
        aged = F.pow(F.lit(q), F.col("_i") - F.col("_o"))
        share = F.when(F.col("_o").isNotNull(), aged / (aged + (1.0 - q)))
        term = F.when(first[f.source], x).when(F.col("_o").isNull(), x * (1.0 - q)).otherwise(
            x * (1.0 - q) / (aged + (1.0 - q)))
        in_block = Window.partitionBy(*series, "_b").orderBy("date").rowsBetween(
            Window.unboundedPreceding, 0)
        df = (df.withColumn("_o", F.last(F.when(x.isNotNull(), F.col("_i")), ignorenulls=True).over(before))
              .withColumn("_l", F.coalesce(F.sum(F.when(x.isNotNull(), F.ln(share))).over(upto), F.lit(0.0)))
              .withColumn("_b", F.floor(F.col("_l") / -550.0)))
        inside = F.col("_l") + F.col("_b") * 550.0
        df = (df.withColumn("_e", F.sum(term * F.exp(-inside)).over(in_block) * F.exp(inside))
              .withColumn("_n", F.lead("_b").over(order))
              .withColumn("_p", F.last(F.when(F.col("_n") != F.col("_b"), F.struct("_e", "_l")),
                                       ignorenulls=True).over(before))
              .withColumn(f"_{f.column}", F.coalesce(F.col("_e"), F.when(F.col("_p").isNotNull(), F.lit(0.0)))
                          + F.coalesce(F.col("_p._e") * F.exp(F.col("_l") - F.col("_p._l")), F.lit(0.0)))
              .drop("_o", "_l", "_b", "_e", "_n", "_p"))
    return df


def feature_set(bars: DataFrame, features: Sequence[Feature], *,
                keys: Sequence[str] = ("symbol",), keep: Sequence[str] = (),
                chunk_rows: int | None = None) -> DataFrame:
    """(keys, date, keep..., one column per feature); shifted features are lagged."""
    specs = sorted(set(features))
    by_column: dict[str, Feature] = {}
    for f in specs:
        if by_column.setdefault(f.column, f).shift != f.shift:
            raise ValueError(f"{f.column} requested with two shifts")
    keys = list(keys)
    sources = sorted({f.source for f in specs})
    kept = [c for c in dict.fromkeys([*keep, *sources]) if c not in keys and c != "date"]
    df = bars.select(*keys, "date", *kept)
    series, own = keys, None
    seeds = {}
    if chunk_rows:
        for n, s in enumerate(sorted({f.source for f in specs if f.name == "ema"})):
            start = df.where(F.col(s).isNotNull()).groupBy(*keys).agg(F.min("date").alias(f"_s{n}"))
            df, seeds[s] = df.join(start, keys, "left"), F.col("date") == F.col(f"_s{n}")
        context = feature_lookback(specs)
        df = positions(df, keys=keys, order=["date"], slice_by=F.trunc("date", "month"),
                       name="_pos")
        df = chunked(df, keys=keys, pos="_pos", chunk_rows=max(chunk_rows, context),
                     before=context)
        series, own = [*keys, "_chunk"], F.col("_own")
    order = Window.partitionBy(*series).orderBy("date")

    def tail(n: int):
        return order.rowsBetween(-(n - 1), 0)

    needs_step = sorted({f.source for f in specs if f.name in ("rsi", "volatility")})
    emas = [f for f in specs if f.name == "ema"]
    steps: list[Column] = []
    for s in needs_step:
        prev = F.lag(F.col(s).cast("double")).over(order)
        steps += [(F.col(s).cast("double") - prev).alias(f"_d_{s}"),
                  change(F.col(s), prev).alias(f"_r_{s}")]
    if emas:
        steps.append((F.row_number().over(order) - 1).alias("_i"))
    if steps:
        df = df.select("*", *steps)
    if emas:
        first = seeds if chunk_rows else {f.source: F.col("_o").isNull() for f in emas}
        df = _ema_columns(df, emas, series, first)

    def value(f: Feature) -> Column:
        x, w = F.col(f.source).cast("double"), f.window
        full = F.count(x).over(tail(w)) == w
        if f.name == "ma":
            return F.when(full, F.avg(x).over(tail(w)))
        if f.name == "ema":
            seen = F.count(x).over(order.rowsBetween(Window.unboundedPreceding, 0)) >= w
            return F.when(seen, F.col(f"_{f.column}"))
        if f.name == "roc":
            return change(x, F.lag(x, w).over(order))
        if f.name == "zscore":
            mean, sd = F.avg(x).over(tail(w)), F.stddev_samp(x).over(tail(w))
            return F.when(full, ratio(x - mean, F.when(sd != 0, sd)))
        if f.name == "volatility":
            r = F.col(f"_r_{f.source}")
            return F.when(F.count(r).over(tail(w)) == w,
                          F.stddev_samp(r).over(tail(w)) * math.sqrt(TRADING_DAYS))
        d = F.col(f"_d_{f.source}")
        up = F.avg(F.greatest(d, F.lit(0.0))).over(tail(w))
        down = F.avg(F.greatest(-d, F.lit(0.0))).over(tail(w))
        rsi = (F.when((down == 0) & (up == 0), F.lit(None).cast("double"))
               .when(down == 0, F.lit(100.0))
               .otherwise(100.0 - 100.0 / (1.0 + F.try_divide(up, down))))
        return F.when(F.count(d).over(tail(w)) == w, rsi)

    plain = [c for c in kept]
    carried = [*series, "date", *plain] + (["_own"] if chunk_rows else [])
    df = df.select(*carried, *[value(f).alias(f.column) for f in specs])
    if any(f.shift for f in specs):
        df = df.select(*carried, *[
            (F.lag(f.column, f.shift).over(order) if f.shift else F.col(f.column))
            .alias(f.column) for f in specs])
    if own is not None:
        df = df.where(own)
    return df.select(*keys, "date", *[c for c in plain if c in keep],
                     *[f.column for f in specs])


def _single(bars, name, window, source, **kw) -> DataFrame:
    f = Feature(name, window, source)
    return feature_set(bars, [f], **kw).withColumnRenamed(f.column, "value")


def feature_ma(bars, *, window, source="close", **kw):
    """Simple mean over ``window`` rows."""
    return _single(bars, "ma", window, source, **kw)


def feature_ema(bars, *, window, source="close", **kw):
    """Recursive mean, alpha 2/(window+1), seeded with the first value."""
    return _single(bars, "ema", window, source, **kw)


def feature_rsi(bars, *, window, source="close", **kw):
    """100 - 100/(1 + mean rise / mean fall) over ``window`` differences."""
    return _single(bars, "rsi", window, source, **kw)


def feature_roc(bars, *, window, source="close", **kw):
    return _single(bars, "roc", window, source, **kw)


def feature_volatility(bars, *, window, source="close", **kw):
    """Sample deviation of one-row returns, annualised."""
    return _single(bars, "volatility", window, source, **kw)


def feature_zscore(bars, *, window, source="close", **kw):
    return _single(bars, "zscore", window, source, **kw)


def feature_shift(frame: DataFrame, shifts: dict[str, int], *,
                  keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Lag each named column by its own number of rows (at least one)."""
    if any(n < 1 for n in shifts.values()):
        raise ValueError("shift must be >= 1")
    order = Window.partitionBy(*keys).orderBy("date")
    return frame.select(*[
        F.lag(c, shifts[c]).over(order).alias(c) if c in shifts else F.col(c)
        for c in frame.columns])


def feature_registry(spark: SparkSession) -> DataFrame:
    """(name, default_window, source): every definition with every source."""
    rows = [(n, w, s) for n, w in DEFAULT_WINDOWS.items() for s in SOURCES]
    return spark.createDataFrame(rows, "name string, default_window bigint, source string")


def feature_registry_coverage(bars: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with the number of bars each definition yields a value for."""
    specs = [Feature(n, w, s) for n, w in DEFAULT_WINDOWS.items() for s in SOURCES]
    wide = feature_set(bars, specs)
    counted = wide.agg(*[F.count(f.column).alias(f.column) for f in specs])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("name"), F.lit(f.source).alias("source"),
                 F.col(f.column).alias("n_values")) for f in specs])).alias("p")
    return registry.join(F.broadcast(counted.select(pairs).select("p.*")), ["name", "source"])


def label_lookahead(target: str, horizon: int) -> int:
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    if target not in LABEL_TARGETS:
        raise ValueError(f"unknown target {target!r}")
    return horizon - 1 if target == "open_to_close" else horizon


def forward_return_label(bars: DataFrame, *, target: str = "open_to_open", horizon: int = 1,
                         keys: Sequence[str] = ("symbol",), name: str = "target") -> DataFrame:
    """The frame with the return from ``date`` to the row ``horizon`` ahead."""
    ahead = label_lookahead(target, horizon)
    start, end = {"open_to_open": ("open", "open"), "close_to_close": ("close", "close"),
                  "open_to_close": ("open", "close")}[target]
    order = Window.partitionBy(*keys).orderBy("date")
    exit_price = F.lead(end, ahead).over(order) if ahead else F.col(end)
    return bars.withColumn(name, change(exit_price, F.col(start)))


def training_frame(frame: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    """Rows with every feature and the target present and finite."""
    cols = [*features, target]
    if not features:
        raise ValueError("no features")
    return frame.select(*[finite(c).alias(c) if c in cols else F.col(c)
                          for c in frame.columns]).dropna(subset=cols)


def attach_peer_features(frame: DataFrame, snapshots: DataFrame, features: Sequence[str], *,
                         as_of: bool = False) -> DataFrame:
    """Carry peer snapshot values forward on the frame's own dates; none yet is 0.

    A snapshot on a date without a row is lost, as the exact-date match comes
    before the fill. ``as_of=True`` keeps such snapshots.
    """
    snaps = snapshots.select("symbol", "date", *features)
    if as_of:
        both = (frame.withColumn("_own", F.lit(True))
                .unionByName(snaps.withColumn("_own", F.lit(False)), allowMissingColumns=True))
    else:
        both = frame.withColumn("_own", F.lit(True)).join(snaps, ["symbol", "date"], "left")
    order = [F.col("date"), F.col("_own")]
    upto = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select(*frame.columns, "_own", *[
        F.coalesce(F.last(c, ignorenulls=True).over(upto).cast("double"), F.lit(0.0))
        .alias(f"peer_{c}") for c in features])
    return filled.where("_own").drop("_own").select(
        *frame.columns, *[F.col(f"peer_{c}").alias(c) for c in features])


def ffill_panel(cells: DataFrame, prices: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Prices on the (date, symbol) cells given, last known value carried forward.

    Prices on dates outside the cells are not used.
    """
    joined = cells.join(prices.select("symbol", "date", *columns), ["symbol", "date"], "left")
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*cells.columns, *[
        F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns])
