"""One model for each group: trees, boosted trees and calibrated directions.

A group is one symbol of one fold, so its rows are at most a trading calendar. Spark
deals the groups out and each is fitted where its rows are; thousands of models are one
plan with one shuffle, and results do not depend on how rows were dealt, as a
group's rows are ordered and its random draws seeded by its key.

Features are cut at quantiles once for each group. A level of all trees of a group grows at
once from histograms of (tree, node, feature, bin); a split is the cut with the largest
gain s_l^2 / (h_l + p) + s_r^2 / (h_r + p) - s^2 / (h + p), s being summed residuals, h
summed weights and p a penalty (0 for bagged trees, where the gain is the drop in
squared error). One long table is better served by the pooled estimators of ``models``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.operators.splits import calibration_split

# Estimator defaults.
TREES = 200
SEED = 42
RATE = 0.3
PENALTY = 1.0
FAMILIES = ("bagged", "boosted")

DEPTH = 5
BINS = 32
CELLS = 1 << 22


# ---- trees -------------------------------------------------------------------------------

def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature the distinct values at ranks ceil(k n / bins), below the largest one."""
    at = -(-np.arange(1, bins) * len(x) // bins) - 1
    ordered = np.sort(x, axis=0)
    return [np.unique(c[c < ordered[-1, f]]) for f, c in enumerate(ordered[np.maximum(at, 0)].T)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin b of a value: it is at most cut b and above cut b - 1."""
    return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)


class Trees:
    """Complete binary trees grown together: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, b: np.ndarray, n_cuts: np.ndarray, h: np.ndarray, s: np.ndarray, depth: int, penalty: float):
        (n, width), count = b.shape, h.shape[1]
        bins = int(n_cuts.max(initial=0)) + 1
        inner = (1 << depth) - 1
        self.depth = depth
        self.feature, self.cut = np.full((count, inner), -1), np.full((count, inner), bins)
        self.gain, self.weight = np.zeros((count, inner)), np.zeros((count, 2 * inner + 1))
        self.value = np.zeros((count, 2 * inner + 1))
        tree, node = np.arange(count)[None], np.zeros((n, count), np.int64)
        usable = np.arange(bins)[None] < n_cuts[:, None]
        for level in range(depth + 1):
            first, nodes = (1 << level) - 1, 1 << level
            place = tree * nodes + node - first
            total = [np.bincount(place.ravel(), weights=v.ravel(), minlength=count * nodes).reshape(count, nodes) for v in (h, s)]
            here = slice(first, first + nodes)
            self.weight[:, here] = total[0]
            above = self.value[:, (np.arange(first, first + nodes) - 1) // 2] if level else np.zeros((count, 1))
            self.value[:, here] = np.divide(total[1], total[0] + penalty, out=above.copy(), where=total[0] > 0)
            if level == depth:
                return
            best = np.full((count, nodes, width), -np.inf)
            cut = np.zeros((count, nodes, width), np.int64)
            for f in range(width):
                at = (place * bins + b[:, f:f + 1]).ravel()
                left = [np.bincount(at, weights=v.ravel(), minlength=count * nodes * bins).reshape(count, nodes, bins).cumsum(axis=2) for v in (h, s)]
                right = [t[:, :, None] - v for t, v in zip(total, left, strict=True)]
                fits = (left[0] > 0) & (right[0] > 1e-9) & usable[f]
                score = np.full(fits.shape, -np.inf)
                for part in (left, right):
                    part[1][fits] = part[1][fits] ** 2 / (part[0][fits] + penalty)
                score[fits] = left[1][fits] + right[1][fits]
                cut[:, :, f] = score.argmax(axis=2)
                best[:, :, f] = score.max(axis=2)
            f = best.argmax(axis=2)
            chosen = np.take_along_axis(best, f[:, :, None], axis=2)[:, :, 0]
            whole = np.divide(total[1] ** 2, total[0] + penalty, out=np.zeros_like(total[0]), where=total[0] > 0)
            split = np.isfinite(chosen) & (chosen - whole > 1e-12 * (1 + whole))
            self.feature[:, here] = np.where(split, f, -1)
            self.cut[:, here] = np.where(split, np.take_along_axis(cut, f[:, :, None], axis=2)[:, :, 0], bins)
            self.gain[:, here] = np.where(split, chosen - whole, 0.0)
            node = self._down(b, node)

    def _down(self, b: np.ndarray, node: np.ndarray) -> np.ndarray:
        tree = np.arange(len(self.feature))[None]
        return 2 * node + 1 + (b[np.arange(len(b))[:, None], self.feature[tree, node]] > self.cut[tree, node])

    def predict(self, b: np.ndarray) -> np.ndarray:
        """(rows, trees)"""
        node = np.zeros((len(b), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = self._down(b, node)
        return self.value[np.arange(len(self.feature))[None], node]

    def importance(self, width: int) -> np.ndarray:
        """Each feature's share of the gain, the mean over trees that have any."""
        gain = np.stack([np.where(self.feature == f, self.gain, 0).sum(axis=1) for f in range(width)], axis=1)
        some = gain.sum(axis=1) > 0
        return (gain[some] / gain[some].sum(axis=1, keepdims=True)).mean(axis=0) if some.any() else np.zeros(width)


class Model:
    """A fitted family on raw features: ``raw`` is a value, or the log odds of a boosted direction."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, family: str, trees: int, depth: int, bins: int, seed: int,
                 direction: bool = False, bootstrap: bool = True):
        self.family, self.direction, self.width = family, direction, x.shape[1]
        self.cuts = cuts_of(x, bins)
        b, n_cuts, n = binned(x, self.cuts), np.array([len(c) for c in self.cuts]), len(x)
        self.parts: list[Trees] = []
        if family == "bagged":
            rng = np.random.default_rng(seed)
            step = max(1, CELLS // n)
            for lo in range(0, trees, step):
                k = min(step, trees - lo)
                draws = rng.integers(0, n, (k, n)) + (np.arange(k) * n)[:, None] if bootstrap else np.arange(k * n)
                h = np.bincount(draws.ravel(), minlength=k * n).reshape(k, n).T.astype(float)
                self.parts.append(Trees(b, n_cuts, h, h * y[:, None], depth, 0.0))
            return
        mean = float(y.mean())
        self.base = float(np.log(mean / (1 - mean))) if direction else mean
        now = np.full(n, self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-now)) if direction else now
            h = p * (1 - p) if direction else np.ones(n)
            tree = Trees(b, n_cuts, h[:, None], (y - p)[:, None], depth, PENALTY)
            self.parts.append(tree)
            now = now + RATE * tree.predict(b)[:, 0]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        if self.family == "bagged":
            sums = sum(t.predict(b).sum(axis=1) for t in self.parts)
            return sums / sum(len(t.feature) for t in self.parts)
        return self.base + RATE * sum(t.predict(b)[:, 0] for t in self.parts)

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return raw if self.family == "bagged" else 1 / (1 + np.exp(-raw))

    def importance(self) -> np.ndarray:
        shares = np.array([t.importance(self.width) * len(t.feature) for t in self.parts]).sum(axis=0)
        return shares / shares.sum() if shares.sum() > 0 else shares


def sigmoid(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a f + b)) with the least log loss against smoothed labels.

    Labels are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), so separable scores stay finite;
    Newton steps are halved until the loss falls.
    """
    n1 = float(y.sum())
    n0 = len(y) - n1
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([f, np.ones(len(f))], axis=1)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, -z) + (1 - t) * z).sum())

    v = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ v)))
        slope = x.T @ (p - t)
        if np.abs(slope).max() < 1e-10 * len(f):
            break
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-12 * np.eye(2), slope)
        size, now = 1.0, loss(v)
        while size > 1e-10 and loss(v - size * step) > now:
            size /= 2
        v = v - size * step
    return float(-v[0]), float(-v[1])


# ---- groups ------------------------------------------------------------------------------

def _matrix(table: pa.Table, features: Sequence[str]) -> np.ndarray:
    return np.stack([table[f].cast(pa.float64()).to_numpy() for f in features], axis=1) if table.num_rows else np.zeros((0, len(features)))


def _seed(table: pa.Table, keys: Sequence[str]) -> int:
    return SEED + zlib.crc32("\0".join(str(table[k][0].as_py()) for k in keys).encode())


def _full(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(axis=1)


def _checked(family: str, trees: int, depth: int) -> None:
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    if trees < 1 or depth < 1:
        raise ValueError("trees and depth must be at least 1")


def _by_group(frame: DataFrame, keys: Sequence[str], order: str, run: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    return frame.groupBy(*keys).applyInArrow(lambda table: run(table.sort_by(order)), schema)


def _with(columns: Sequence[str], rows: pa.Table, name: str, values: np.ndarray) -> pa.Table:
    return rows.append_column(name, pa.array(values, pa.float64(), from_pandas=True)).select([*columns, name])


def fit_scores(frame: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("symbol",), target: str = "target",
               family: str = "bagged", trees: int = TREES, depth: int = DEPTH, bins: int = BINS, order: str = "date") -> DataFrame:
    """Test rows of ``frame`` (role train or test) with ``predicted`` by the model of their group.

    Train rows with a missing or non-finite feature or target are left out; a test row with
    one, or of a group without train rows, has no prediction.
    """
    _checked(family, trees, depth)
    columns = frame.columns

    def run(table: pa.Table) -> pa.Table:
        role = np.array(table["role"].to_pylist(), object)
        x, y = _matrix(table, features), table[target].cast(pa.float64()).to_numpy()
        train, test = (role == "train") & _full(x) & np.isfinite(y), np.flatnonzero(role == "test")
        out = np.full(len(test), np.nan)
        some = _full(x[test])
        if train.any() and some.any():
            model = Model(x[train], y[train], family=family, trees=trees, depth=depth, bins=bins, seed=_seed(table, keys))
            out[some] = model.raw(x[test][some])
        return _with(columns, table.take(test), "predicted", out)

    return _by_group(frame, keys, order, run, T.StructType([*frame.schema.fields, T.StructField("predicted", T.DoubleType())]))


def group_importance(frame: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("symbol",), target: str = "target",
                     family: str = "bagged", trees: int = TREES, depth: int = DEPTH, bins: int = BINS, order: str = "date") -> DataFrame:
    """(keys, feature, importance): shares of the gain in the group's model of its train rows."""
    _checked(family, trees, depth)
    keys = list(keys)

    def run(table: pa.Table) -> pa.Table:
        x, y = _matrix(table, features), table[target].cast(pa.float64()).to_numpy()
        train = (np.array(table["role"].to_pylist(), object) == "train") & _full(x) & np.isfinite(y)
        n = len(features) if train.any() else 0
        share = Model(x[train], y[train], family=family, trees=trees, depth=depth, bins=bins, seed=_seed(table, keys)).importance() if n else np.zeros(0)
        key = table.select(keys).take([0] * n)
        return key.append_column("feature", pa.array(list(features)[:n], pa.string())).append_column("importance", pa.array(share, pa.float64()))

    fields = [f for f in frame.select(*keys).schema.fields]
    return _by_group(frame, keys, order, run, T.StructType([*fields, T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())]))


def mean_importance(shares: DataFrame) -> DataFrame:
    """(feature, importance): the mean over groups, largest first."""
    return (shares.where(~F.isnan("importance")).groupBy("feature").agg(F.avg("importance").alias("importance"))
            .orderBy(F.col("importance").desc(), "feature"))


def tree_splits(frame: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("symbol",), target: str = "target",
                depth: int = 2, bins: int = BINS, order: str = "date") -> DataFrame:
    """(keys, node, feature, threshold, rows, mean): the inner nodes of one tree of each group,
    grown on all its train rows; rows with the feature at most the threshold go to node 2n + 1."""
    _checked("bagged", 1, depth)
    keys = list(keys)

    def run(table: pa.Table) -> pa.Table:
        x, y = _matrix(table, features), table[target].cast(pa.float64()).to_numpy()
        train = (np.array(table["role"].to_pylist(), object) == "train") & _full(x) & np.isfinite(y)
        rows: list = []
        if train.any():
            m = Model(x[train], y[train], family="bagged", trees=1, depth=depth, bins=bins, seed=0, bootstrap=False)
            t = m.parts[0]
            rows = [(i, features[f], float(m.cuts[f][t.cut[0, i]]), int(t.weight[0, i]), float(t.value[0, i])) for i, f in enumerate(t.feature[0]) if f >= 0]
        out = table.select(keys).take([0] * len(rows))
        for name, kind, column in zip(("node", "feature", "threshold", "rows", "mean"), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64()),
                                      zip(*rows, strict=True) if rows else [[]] * 5, strict=True):
            out = out.append_column(name, pa.array(list(column), kind))
        return out

    fields = [T.StructField(n, t()) for n, t in (("node", T.LongType), ("feature", T.StringType), ("threshold", T.DoubleType), ("rows", T.LongType), ("mean", T.DoubleType))]
    return _by_group(frame, keys, order, run, T.StructType([*frame.select(*keys).schema.fields, *fields]))


def fit_directions(frame: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("symbol",), label: str = "up",
                   family: str = "bagged", trees: int = TREES, depth: int = DEPTH, bins: int = BINS, purge: int = 0,
                   order: str = "date") -> DataFrame:
    """Test rows of ``frame`` (role train or test) with ``probability`` of going up and ``reason``.

    The base part of a group's train rows fits the trees, its chronological tail the sigmoid
    over their raw probability; ``reason`` names what a group lacks for that, and then no
    row of it has a probability.
    """
    _checked(family, trees, depth)
    keys = list(keys)
    train = calibration_split(frame.where("role = 'train'"), label=label, keys=keys, purge=purge)
    reasons = train.groupBy(*keys).agg(F.max("reason").alias("_why"))
    test = frame.where("role = 'test'").withColumn("part", F.lit("score")).withColumn("reason", F.lit(None).cast("string"))
    ready, columns = train.unionByName(test), frame.columns

    def run(table: pa.Table) -> pa.Table:
        part = np.array(table["part"].to_pylist(), object)
        x, y = _matrix(table, features), table[label].cast(pa.float64()).to_numpy()
        full = _full(x)
        base, tail, score = (part == "base") & full & np.isfinite(y), (part == "calibration") & full & np.isfinite(y), np.flatnonzero(part == "score")
        out = np.full(len(score), np.nan)
        some = full[score]
        if len(np.unique(y[base])) == 2 and len(np.unique(y[tail])) == 2 and some.any():
            model = Model(x[base], y[base], family=family, trees=trees, depth=depth, bins=bins, seed=_seed(table, keys), direction=True)
            a, b = sigmoid(model.probability(x[tail]), y[tail])
            out[some] = 1 / (1 + np.exp(a * model.probability(x[score][some]) + b))
        return _with(columns, table.take(score), "probability", out)

    scored = _by_group(ready, keys, order, run, T.StructType([*frame.schema.fields, T.StructField("probability", T.DoubleType())]))
    why = F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("_any").isNull(), "insufficient_rows")
    return (scored.join(reasons.withColumn("_any", F.lit(True)), keys, "left")
            .withColumn("reason", why).drop("_why", "_any").select(*frame.columns, "probability", "reason"))
