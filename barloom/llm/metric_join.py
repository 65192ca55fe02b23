"""All vectors within a cosine of each other: an exact metric range join over pivot cells.

Unit vectors of cosine c lie sqrt(2 - 2c) apart, so links are pairs within a radius r.
Every vector is at home in the cell of its nearest pivot. A cell must see each vector
within r of one of its own; by the triangle inequality that needs d(y, q) - d(y, p) <= 2r
for a vector y at home with p and a pivot q, and in Euclidean space, more sharply, that y
is within r of the plane half way between p and q. Such vectors are copied to the cell
of q, which then finds all links of its own vectors without any other cell.

Equal vectors are one class with a weight before anything is compared. Cells with many
rows are cut: HOME of their own against PARTNERS of those they see is one group, so the
memory of a task is bounded, a dense cell spreads over tasks and links are counted and
joined inside them, never written out as pairs. How much is copied depends on the data:
groups far apart meet nothing; vectors without structure in many dimensions are within
r of most planes, and then each cell sees nearly all rows, as no exact bound can rule
them out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barloom.llm import buffers as bf
from barloom.llm.jaccard_join import components
from barloom.llm.multi_index import codebook, squares, usable
from barloom.llm.stored import stored

LEAST_COSINE = 0.9
SAMPLE = 20000
ROWS_A_CELL = 4096
MOST_PIVOTS = 4096
HOME = 8192
PARTNERS = 32768
BLOCK = 256
STEP = 2048
SLACK = 1e-6

_GROUP = ["cell", "own", "other"]


def _units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
    return v, unit(v)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps tiny and huge ones exact."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def seen_by(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row, rows x cells: whether the cell must see the row)."""
    far = squares(x, pivots)
    home = far.argmin(axis=1)
    apart = np.sqrt(squares(pivots, pivots))[home]
    over = far - far[np.arange(len(x)), home][:, None]
    return home, over <= 2 * (radius + SLACK) * apart + SLACK


def _count(pivots: np.ndarray, radius: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, all_ = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                home, sees = seen_by(_units(batch.slice(lo, STEP))[1], pivots, radius)
                own += np.bincount(home, minlength=len(pivots))
                all_ += sees.sum(axis=0)
        used = np.flatnonzero(all_)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(used), "own": pa.array(own[used]), "seen": pa.array(all_[used])})
    return run


def _part(ids: np.ndarray, parts: int, salt: int) -> np.ndarray:
    if parts == 1:
        return np.zeros(len(ids), np.int64)
    return (bf.mix(ids.astype(np.uint64) + np.uint64(salt)) % np.uint64(parts)).astype(np.int64)


def _deal(pivots: np.ndarray, radius: float, own_parts: np.ndarray, other_parts: np.ndarray, kind):
    """Packed rows to the groups of the cells that own or see them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                rows = batch.slice(lo, STEP)
                v, x = _units(rows)
                ids, weight = bf.longs(rows, "id"), bf.longs(rows, "n")
                home, sees = seen_by(x, pivots, radius)
                v = v.astype(kind)
                for cell in np.flatnonzero(sees.any(axis=0)):
                    for is_own, at, parts, others in ((True, np.flatnonzero(home == cell), own_parts[cell], other_parts[cell]),
                                                      (False, np.flatnonzero(sees[:, cell]), other_parts[cell], own_parts[cell])):
                        part = _part(ids[at], int(parts), 1 if is_own else 2)
                        for p in np.unique(part):
                            k = at[part == p]
                            block = bf.pack(ids[k], weight[k], v[k].reshape(-1))
                            side = np.arange(int(others), dtype=np.int32)
                            same = np.full(len(side), p, np.int32)
                            yield pa.RecordBatch.from_pydict({
                                "cell": pa.array(np.full(len(side), cell, np.int32)), "own": pa.array(same if is_own else side),
                                "other": pa.array(side if is_own else same), "is_own": pa.array(np.full(len(side), is_own)),
                                "block": pa.array([block] * len(side), pa.binary())})
    return run


def _join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts linked nodes under the least node of their component."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def link_group(own: tuple, others: tuple, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each own row, all ids of the group, the least id each is joined to within it).

    Rows are (ids, weights, vectors). Single precision decides where its error cannot
    matter; pairs nearer to ``least`` than that are taken again in double precision.
    """
    ids, _, v = own
    ids2, weight2, v2 = others
    x, y = unit(v), unit(v2)
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    margin = np.float32((v.shape[1] + 8) * 2.4e-7)
    nodes = np.unique(np.concatenate([ids, ids2]))
    at, at2 = np.searchsorted(nodes, ids), np.searchsorted(nodes, ids2)
    parent = np.arange(len(nodes))
    links = np.zeros(len(ids), np.int64)
    for lo in range(0, len(ids), BLOCK):
        s = x32[lo:lo + BLOCK] @ y32.T
        linked = s >= np.float32(least) + margin
        i, j = np.nonzero(np.abs(s - np.float32(least)) <= margin)
        if len(i):
            linked[i, j] = (x[lo + i] * y[j]).sum(axis=1) >= least
        i, j = np.nonzero(linked)
        other = at[lo + i] != at2[j]
        i, j = i[other], j[other]
        if len(i):
            np.add.at(links, lo + i, weight2[j])
            _join_up(parent, at[lo + i], at2[j])
    return links, nodes, nodes[parent]


def _unpacked(blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, weight, flat = bf.unpack_all(blocks)
    return ids, weight, flat.reshape(len(ids), -1).astype(np.float64)


def _links(least: float):
    """kind 0: links of an own row in this group; kind 1: a row and one that it is joined to."""
    def run(table: pa.Table) -> pa.Table:
        own, others = (table.filter(pc.equal(table["is_own"], pa.scalar(x)))["block"] for x in (True, False))
        if not len(own) or not len(others):
            return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        own = _unpacked(own)
        links, nodes, roots = link_group(own, _unpacked(others), least)
        some, joined = np.flatnonzero(links), np.flatnonzero(nodes != roots)
        return pa.table({"kind": np.repeat(np.array([0, 1], np.int32), [len(some), len(joined)]),
                         "a": np.concatenate([own[0][some], nodes[joined]]), "b": np.concatenate([links[some], roots[joined]])})
    return run


def one_vector_per_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding), of rows that repeat an id the least vector; rows without id all stay."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    keyed = rows.where("vec_id IS NOT NULL")
    repeated = keyed.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if repeated.isEmpty():
        return rows
    least = keyed.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return keyed.join(repeated, "vec_id", "left_anti").unionByName(least).unionByName(rows.where("vec_id IS NULL"))


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Per vector: vec_id, n_links (others within ``least``), component_id, kept.

    ``vectors`` needs vec_id and embedding; other columns are ignored. component_id is
    the least vec_id reachable by links, kept whether that is the vector's own. Vectors
    that are null, empty, all zero, hold null or non-finite components or are not of
    the commonest length link with nothing. Of rows that repeat a vec_id the least vector
    counts, once; rows without vec_id come back with no links and no component. An empty
    table gives no rows.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must be above 0 and at most 1")
    spark = vectors.sparkSession
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    every = one_vector_per_id(vectors)
    rows = usable(every)
    classes = stored(rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    n = classes.count()
    if not n:
        found = spark.createDataFrame([], "kind int, a long, b long")
    else:
        sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().combine_chunks()
        x = unit(sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sample.num_rows, -1))
        radius = float(np.sqrt(2 - 2 * least))
        pivots = codebook(x, max(1, min(MOST_PIVOTS, -(-n // ROWS_A_CELL))), 3)
        sizes = (classes.select("v").mapInArrow(_count(pivots, radius), "cell long, own long, seen long")
                 .groupBy("cell").agg(F.sum("own").alias("own"), F.sum("seen").alias("seen")).toArrow())
        own, seen = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
        own[sizes["cell"].to_numpy()], seen[sizes["cell"].to_numpy()] = sizes["own"].to_numpy(), sizes["seen"].to_numpy()
        dealt = classes.mapInArrow(_deal(pivots, radius, -(-own // HOME), -(-seen // PARTNERS), kind),
                                   "cell int, own int, other int, is_own boolean, block binary")
        found = stored(dealt.groupBy(_GROUP).applyInArrow(_links(least), "kind int, a long, b long"), "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b")) if n else spark.createDataFrame([], "id long, root long")
    told = (classes.join(counts, "id", "left").join(roots, "id", "left")
            .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
            .where("n_links > 0"))
    # only vectors with links meet their class again; a class of many copies is the split side of the join
    linked = rows.join(told.hint("merge"), "v").select("vec_id", "n_links", F.col("root").alias("component_id"))
    return (every.select("vec_id").join(linked.hint("merge"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL GROUP BY 1),
u AS (SELECT * FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT y, root FROM r JOIN e ON x = id WHERE root < y),
n AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(root)::BIGINT AS component_id, vec_id = min(root) AS kept
FROM v JOIN r ON r.id = vec_id LEFT JOIN n ON n.x = vec_id GROUP BY vec_id
"""
