"""Document quality by regularised quadratic discriminant analysis.

Each text becomes FEATURES: statistics of its bytes, words and lines, transformed so
that ordinary prose is close to normal. Per label the mean and covariance of all
training rows are summed in Spark (a few hundred numbers reach the driver, whatever the
input). Each covariance is shrunk towards the pooled one and that towards its diagonal,
and its Cholesky factor is kept. A score is the logistic of the difference of the
Mahalanobis log densities plus the log odds of the labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

bf.lean_memory()  # in every worker that runs these tasks

FEATURES = ("words", "word_bytes", "word_bytes_spread", "capitals", "symbols", "marks", "bare_words", "repeats",
            "distinct", "digits", "stops", "line_words", "repeated_lines", "top_word")
THRESHOLD = 0.7
CHUNK_BYTES = 1 << 20
TO_POOLED = 0.1
TO_DIAGONAL = 0.02
FLOOR = 1e-2

_CODE = np.arange(256)
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_LETTER = _UPPER | ((_CODE >= 97) & (_CODE <= 122)) | (_CODE >= 128)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_STOP = np.isin(_CODE, np.frombuffer(b".,", np.uint8))
_MARK = np.isin(_CODE, np.frombuffer(b"!?", np.uint8))
_SYMBOL = (_CODE > 32) & (_CODE < 127) & ~_LETTER & ~_DIGIT & ~_STOP & ~_MARK & ~np.isin(_CODE, np.frombuffer(b"-'\"()", np.uint8))


def _per(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return (total[off[1:]] - total[off[:-1]]).astype(np.float64)


def _runs(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each owner, and the count of its commonest."""
    o = np.lexsort((keys, owner))
    at = bf.groups(owner[o], keys[o])
    who = owner[o][at[:-1]]
    most = np.zeros(n)
    np.maximum.at(most, who, np.diff(at))
    return np.bincount(who, minlength=n).astype(np.float64), most


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros of everything counted."""
    n = len(off) - 1
    starts, ends, at = bf.word_bounds(data, off)
    words = np.diff(at).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(at))
    size = (ends - starts).astype(np.float64)
    some = np.maximum(words, 1)
    mean = np.bincount(owner, size, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, size * size, n) / some - mean ** 2, 0))
    letters = _per(_LETTER[data], off)
    hashes = bf.range_hashes(bf.LOWER[data], starts, ends)
    has_letter = np.append(0, np.cumsum(_LETTER[data]))
    bare = (has_letter[ends] == has_letter[starts]).astype(np.float64)
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) if len(hashes) else np.zeros(0, bool)
    distinct, most = _runs(hashes, owner, n)
    breaks = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    first = first[first < len(data)]
    last = np.append(first[1:], len(data))
    line_owner = np.searchsorted(off, first, side="right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(np.float64)
    own_lines, _ = _runs(bf.range_hashes(data, first, last), line_owner, n)
    share = lambda x, of: np.log(x / np.maximum(of, 1) + 1e-2)
    return np.stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), share(_per(_UPPER[data], off), letters), share(_per(_SYMBOL[data], off), words),
        share(_per(_MARK[data], off), words), share(np.bincount(owner, bare, n), words), share(np.bincount(owner, same, n), words),
        np.log((distinct + 1) / (words + 1)) + 0.15 * np.log1p(words), share(_per(_DIGIT[data], off), np.diff(off)),
        share(_per(_STOP[data], off), words), np.log1p(words / np.maximum(lines, 1)), share(lines - own_lines, lines), share(most, words)], axis=1)


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in bf.text_chunks(batches, limit=CHUNK_BYTES):
        x = features(data, off).reshape(-1)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(
            pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * len(FEATURES)), pa.array(x))], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): FEATURES of each row, in order."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), bf.whole_text()).mapInArrow(_measure, "doc_id long, x array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x, y = _matrix(batch.column("x")), batch.column("quality").to_numpy(zero_copy_only=False)
        for label in (0, 1):
            z = x[y == label]
            total[label] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)])
    yield pa.RecordBatch.from_pydict({"m": pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))})


def in_fold(fold: int = 2, folds: int = 4):
    """Whether a document is held out: crc32 of doc_id as text (none: empty) leaves ``fold``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


class Discriminant:
    """Means, Cholesky factors and log odds; without both labels the share of label 1."""

    def __init__(self, sums: np.ndarray):
        d = len(FEATURES)
        sums = sums.reshape(2, 1 + d + d * d)
        count = sums[:, 0]
        self.flat = None
        if count.min() < 2:
            self.flat = float((count[1] + 1) / (count.sum() + 2))
            return
        self.mean = sums[:, 1:1 + d] / count[:, None]
        own = sums[:, 1 + d:].reshape(2, d, d) / count[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = (own * count[:, None, None]).sum(axis=0) / count.sum()
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
        shrunk = (1 - TO_POOLED) * own + TO_POOLED * pooled + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        self.inverse = np.linalg.inv(factor)
        self.half_log_det = np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(axis=1)
        self.odds = float(np.log(count[1] / count[0]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        density = [-0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) - self.half_log_det[k] for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -500, 500)))


def fit(x: DataFrame, labels: DataFrame) -> Discriminant:
    """Learns from rows of ``x`` outside the held-out fold that have a label (0 or 1).

    Labels that are null, another number, or contradict each other for a doc_id count not.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality IN (0, 1)")
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
             .where("quality = _most").select("doc_id", "quality"))
    rows = x.where(~in_fold()).join(known, "doc_id").select("x", "quality").mapInArrow(_moments, "m array<double>")
    d = len(FEATURES)
    sums = rows.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for r in sums:
        total[r.i] = r.v
    return Discriminant(total)


def _apply(model: Discriminant):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_matrix(batch.column("x"))))], ["doc_id", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= THRESHOLD).

    Only the text is scored; ``docs`` needs doc_id and text, ``labels`` doc_id and quality,
    other columns are ignored. Null and empty texts have the statistics of no words.
    Repeated rows are each scored. Rows without doc_id are scored, in no fold's training.
    An empty table gives no rows; without two rows of either label all scores are equal.
    """
    x = stored(measured(docs), "text-statistics")
    model = fit(x, labels)
    return x.mapInArrow(_apply(model), "doc_id long, score double").select(
        "doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _decide(model: Discriminant):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a null text has no bytes in a batch; small chunks, as whole rows are held beside them
        for rows, data, off in bf.text_chunks(batches, limit=CHUNK_BYTES):
            yield rows.filter(pa.array(model.scores(features(data, off)) >= THRESHOLD))
    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores THRESHOLD or more, all columns."""
    model = fit(measured(docs), labels)
    return docs.mapInArrow(_decide(model), docs.schema)
