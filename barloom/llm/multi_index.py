"""Nearest neighbours by an inverted multi-index.

Each half of the vectors has its own codebook; a row is filed under the pair of its
nearest centroids. A query walks the pairs in the order of the summed distances of its
halves, with a heap over the two sorted lists, and all entries of the cells it passes are
ranked by true distance. It does so twice: first through cells that hold FIRST of all rows
(FEWEST at least), which gives a distance that its neighbours cannot exceed, then on
until, by the triangle inequality and the radii of the cells, none can be nearer than
that, and through SHARE of all rows at most. Cells that are too far by their own radii
are passed over. Groups of near rows need a small part of the cells; vectors
without structure need all that SHARE allows.

Vectors are taken less the sample's mean wherever squares are expanded, so that a common
offset costs no digits, and the margin of what may be among the nearest follows the norms.

Equal rows of one id are made one before anything is counted or filed, as copies would
fill cells and ranks in place of other rows.

Codebooks are fitted on a hash sample of SAMPLE rows at most; every row is indexed.
Cells and query blocks go to buckets; a cell of more than CELL_ROWS rows is split over
several. A bucket keeps each query's nearest, and these meet in the query's own bucket,
so no pair of query and row is ever a row of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

SAMPLE = 20000
ROWS_A_CELL = 16
MOST_CENTROIDS = 256
FIRST = 0.02
FEWEST = 256
SHARE = 0.7
CELL_ROWS = 8192
ROUNDS = 12
NEAREST = 10
QUERY_EVERY = 100
CELLS = "bucket int, block binary"


def codebook(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids by Lloyd's rounds from distinct sampled points; deterministic."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        a = nearest(points, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, points)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return squares(x, c).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float, reach: float = np.inf) -> list[int]:
    """Cells i * len(second) + j in the order of first[i] + second[j], until they hold ``enough``
    rows or the sum passes ``reach``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, got = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and got < enough:
        total, i, j = heapq.heappop(heap)
        if total > reach:
            break
        cell = int(a[i]) * len(b) + int(b[j])
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(first[a[x]] + second[b[y]]), x, y))
    return out


def further_cells(first: np.ndarray, second: np.ndarray, counts: np.ndarray, radii: np.ndarray, passed: list[int], far: float,
                  enough: float) -> list[int]:
    """Cells beyond ``passed`` that may hold a row within ``far``; ``radii`` (cells, 2) bound the
    distance of a cell's rows from its centroids."""
    widest = float(np.sqrt((radii ** 2).sum(axis=1)).max(initial=0))
    seen = set(passed)
    some = np.array([c for c in walk(first, second, counts, enough, (far + widest) ** 2 * (1 + 1e-9)) if c not in seen], np.int64)
    if not len(some):
        return []
    i, j = some // len(second), some % len(second)
    least = np.maximum(np.sqrt(first[i]) - radii[some, 0], 0) ** 2 + np.maximum(np.sqrt(second[j]) - radii[some, 1], 0) ** 2
    return some[least <= far * far * (1 + 1e-9)].tolist()


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)


def _halves(v: np.ndarray, books) -> list[tuple[np.ndarray, np.ndarray]]:
    v, h = v - books[2], v.shape[1] // 2
    return [(v[:, :h], books[0]), (v[:, h:], books[1])]


def _cells(v: np.ndarray, books) -> np.ndarray:
    i, j = (nearest(x, c) for x, c in _halves(v, books))
    return i * len(books[1]) + j


def _count(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch)
                cell = _cells(v, shared)
                order = np.argsort(cell, kind="stable")
                at = bf.groups(cell[order])
                far = []
                for (x, book), which in zip(_halves(v, shared), (cell // len(shared[1]), cell % len(shared[1])), strict=True):
                    d = np.sqrt(((x - book[which]) ** 2).sum(axis=1))[order]
                    far.append(np.maximum.reduceat(d, at[:-1]))
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell[order][at[:-1]]), "n": pa.array(np.diff(at)), "r0": pa.array(far[0]), "r1": pa.array(far[1])})
    return run


def _splits(counts: np.ndarray) -> np.ndarray:
    return -(-counts // CELL_ROWS)


def _bucket(cell: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    return bf.spread(bf.mix((cell.astype(np.uint64) << np.uint64(24)) + part.astype(np.uint64)), buckets)


def _file(books, counts: np.ndarray, buckets: int):
    """Rows to the buckets of their cells."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _vectors(batch), bf.longs(batch, "vec_id")
            cell = _cells(v, books)
            part = (bf.mix(ids.view(np.uint64).copy()) % np.maximum(_splits(counts)[cell], 1).astype(np.uint64)).astype(np.int64)
            o, at = bf.by_bucket(_bucket(cell, part, buckets), buckets)
            yield _blocks([(b, bf.pack(ids[x], cell[x], part[x], v[x].reshape(-1))) for b in np.flatnonzero(np.diff(at)) for x in (o[at[b]:at[b + 1]],)])
    return run


def _blocks(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary())})


def _ask(books, counts: np.ndarray, radii: np.ndarray, begin: float, enough: float, buckets: int):
    """Queries to the buckets of all cells they walk, each bucket once; those with a column
    ``far`` go on from where they stopped."""
    splits = _splits(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part_ = batch.slice(lo, 1024)
                v, ids = _vectors(part_), bf.longs(part_, "vec_id")
                first, second = (squares(x, c) for x, c in _halves(v, books))
                cells = [walk(f, s, counts, begin) for f, s in zip(first, second, strict=True)]
                if "far" in batch.schema.names:
                    far = part_.column("far").to_pylist()
                    cells = [further_cells(f, s, counts, radii, c, d, enough) for f, s, c, d in zip(first, second, cells, far, strict=True)]
                cells = [np.asarray(c, np.int64) for c in cells]
                query = np.repeat(np.arange(len(ids)), [int(splits[c].sum()) for c in cells])
                cell = np.concatenate(cells) if cells else np.zeros(0, np.int64)
                cell = np.repeat(cell, splits[cell])
                new = np.append(True, (cell[1:] != cell[:-1]) | (query[1:] != query[:-1])) if len(cell) else np.zeros(0, bool)
                start = np.maximum.accumulate(np.where(new, np.arange(len(cell)), 0)) if len(cell) else np.zeros(0, np.int64)
                piece = np.arange(len(cell)) - start
                o, at = bf.by_bucket(_bucket(cell, piece, buckets), buckets)
                out = []
                for b in np.flatnonzero(np.diff(at)):
                    x = o[at[b]:at[b + 1]]
                    who, place = np.unique(query[x], return_inverse=True)
                    out.append((b, bf.pack(ids[who], v[who].reshape(-1), place.astype(np.int64), cell[x], piece[x])))
                yield _blocks(out)
    return run


def _keep_nearest(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of each query's NEAREST by score then id."""
    o = np.lexsort((ids, score, query))
    at = bf.groups(query[o])
    rank = np.arange(len(o)) - np.repeat(at[:-1], np.diff(at))
    return o[rank < NEAREST]


def _rank(buckets: int, centre: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_blocks([])])
        ids, cell, part, flat = bf.unpack_all(left["block"])
        v = flat.reshape(len(ids), -1)
        u = v - centre
        size, rounding = (u * u).sum(axis=1), 8 * np.finfo(float).eps * (v.shape[1] + 8)
        key = (cell << 24) + part
        o = np.argsort(key, kind="stable")
        at = bf.groups(key[o])
        where = dict(zip(key[o][at[:-1]].tolist(), range(len(at) - 1), strict=True))
        best: list = []
        for value in right["block"]:
            q_ids, q_flat, place, q_cell, q_piece = bf.unpack(value.as_buffer().to_pybytes())
            q = q_flat.reshape(len(q_ids), -1)
            want = (q_cell << 24) + q_piece
            w = np.argsort(want, kind="stable")
            g = bf.groups(want[w])
            held: list = []
            for s, e in zip(g[:-1].tolist(), g[1:].tolist(), strict=True):
                k = where.get(int(want[w[s]]))
                if k is None:
                    continue
                rows, who = o[at[k]:at[k + 1]], place[w[s:e]]
                near = squares(q[who] - centre, u[rows])
                margin = rounding * (((q[who] - centre) ** 2).sum(axis=1)[:, None] + size[rows].max())
                near[q_ids[who][:, None] == ids[rows][None]] = np.inf
                # all that may be among the nearest, rounding allowed for; then exactly
                bound = np.partition(near, NEAREST - 1, axis=1)[:, NEAREST - 1:NEAREST] if len(rows) > NEAREST else np.full((len(who), 1), np.inf)
                x, y = np.nonzero((near <= bound + 2 * margin) & np.isfinite(near))
                if len(x):
                    score = np.sqrt(((q[who[x]] - v[rows[y]]) ** 2).sum(axis=1))
                    keep = _keep_nearest(who[x], ids[rows[y]], score)
                    held.append((who[x][keep], ids[rows[y]][keep], score[keep]))
            if held:
                who, found, score = (np.concatenate(c) for c in zip(*held, strict=True))
                keep = _keep_nearest(who, found, score)
                best.append((q_ids[who[keep]], found[keep], score[keep]))
        if not best:
            return pa.Table.from_batches([_blocks([])])
        query, found, score = (np.concatenate(c) for c in zip(*best, strict=True))
        o, at = bf.by_bucket(bf.spread(bf.mix(query.view(np.uint64).copy()), buckets), buckets)
        return pa.Table.from_batches([_blocks([(b, bf.pack(query[x], found[x], score[x])) for b in np.flatnonzero(np.diff(at)) for x in (o[at[b]:at[b + 1]],)])])
    return run


def _merge(table: pa.Table) -> pa.Table:
    query, found, score = bf.unpack_all(table["block"])
    keep = _keep_nearest(query, found, score)
    query, found, score = query[keep], found[keep], score[keep]
    at = bf.groups(query)
    rank = np.arange(len(query)) - np.repeat(at[:-1], np.diff(at)) + 1
    return pa.table({"query_id": query, "rank": rank.astype(np.int32), "vec_id": found, "score": score})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows that take part: those with an id and a vector without null or
    non-finite components, not all zero, of the commonest length."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(v) == (length.n if length else 0))


def neighbours(vectors: DataFrame) -> DataFrame:
    """Per query (vec_id divisible by QUERY_EVERY) its NEAREST found: query_id, rank, vec_id, score.

    ``vectors`` needs vec_id and embedding; other columns are ignored. Rows that are not
    ``usable`` take no part. Equal
    distances go to the smaller vec_id; rows that share a query's vec_id are the query's
    own; equal rows of one vec_id count once, different rows each. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = stored(rows.distinct(), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    points = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1).astype(np.float64)
    k = max(2, min(MOST_CENTROIDS, int((n / ROWS_A_CELL) ** 0.5)))
    h = points.shape[1] // 2
    centre = points.mean(axis=0)
    points = points - centre
    books = [codebook(points[:, :h], k, 1), codebook(points[:, h:], k, 2), centre]
    cells = (rows.mapInArrow(_count(books), "cell long, n long, r0 double, r1 double").groupBy("cell")
             .agg(F.sum("n").alias("n"), F.max("r0").alias("r0"), F.max("r1").alias("r1")).toArrow())
    counts, radii = np.zeros(len(books[0]) * len(books[1]), np.int64), np.zeros((len(books[0]) * len(books[1]), 2))
    at = cells["cell"].to_numpy()
    counts[at], radii[at, 0], radii[at, 1] = (cells[c].to_numpy() for c in ("n", "r0", "r1"))
    buckets = bf.bucket_count(spark, 1)
    ask = _ask(books, counts, radii, max(FEWEST, FIRST * n), max(FEWEST, SHARE * n), buckets)
    queries = rows.where(F.col("vec_id") % QUERY_EVERY == 0).dropDuplicates(["vec_id"])

    def search(queries: DataFrame) -> DataFrame:
        filed = rows.mapInArrow(_file(books, counts, buckets), CELLS)
        return (filed.groupBy("bucket").cogroup(queries.mapInArrow(ask, CELLS).groupBy("bucket")).applyInArrow(_rank(buckets, centre), CELLS)
                .groupBy("bucket").applyInArrow(_merge, "query_id long, rank int, vec_id long, score double"))

    begun = stored(search(queries), "nearest")
    # a query with fewer than NEAREST so far has no distance to go by
    known = begun.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == NEAREST, F.max("score")).alias("far"))
    on = queries.join(known, "vec_id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (begun.unionByName(search(on)).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEAREST)
            .select("query_id", "rank", "vec_id", "score"))
