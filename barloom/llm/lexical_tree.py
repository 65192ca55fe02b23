"""Ranked lexical search over document FP-trees.

Documents are restricted to the terms of the items. Their term vectors, in the order of
falling document frequency, share the paths of a trie; a node with few documents is a
leaf, and small siblings share one. A node knows the greatest tf of each term and the
least m below it, which bound every score there, as a score rises with tf and falls with m.
Each item walks the trie depth first, the most promising child first, and leaves out
what can't reach its ten best so far; leaves are scored exactly.

One pass counts what the weights need and writes the restricted vectors, packed; the
second builds a trie from every TREE_DOCS of them within a task, carries each item's best
on to its next trie, and sends ten rows an item and task at most to the last ranking. Items
are taken in blocks of bounded text, so only a block's terms are ever broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

BEST = 10
BLOCK_BYTES = 1 << 17
TREE_DOCS = 1 << 15
LEAF = 256
SHARED = 24
IS_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_EXACT = float(1 << 53)

FOUND = "item_id long, doc_id long, score long"


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, A-Z in lower case, and terms before each text."""
    starts, ends, at = bf.word_bounds(data, off, IS_TERM)
    return bf.range_hashes(bf.LOWER[data], starts, ends), at


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by; 0 where it is missing."""
    return (1000000000 * tf) // np.maximum(1000 * tf + 8 * m, 1)


# ---- restricted vectors ------------------------------------------------------------------

def _restrict(vocabulary: np.ndarray):
    """kind 0: packed vectors of a chunk; kind 1: (term, its documents), -1 all documents, -2 all terms."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        df, n_docs, n_terms = np.zeros(size, np.int64), 0, 0
        for rows, data, off in bf.text_chunks(batches):
            hashes, at = term_hashes(data, off)
            n = np.diff(at)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            owner = np.repeat(np.arange(len(n)), n)
            place = np.searchsorted(vocabulary, hashes)
            known = vocabulary[np.minimum(place, size - 1)] == hashes
            key, tf = np.unique(owner[known] * size + place[known], return_counts=True)
            doc, term = key // size, key % size
            df += np.bincount(term, minlength=size)
            some, first = np.unique(doc, return_index=True)
            if len(some):
                block = bf.pack(bf.longs(rows, "doc_id")[some], n[some], np.diff(np.append(first, len(doc))), term.astype(np.uint32), tf.astype(np.uint32))
                yield pa.RecordBatch.from_pydict({"kind": pa.array([0], pa.int32()), "a": pa.array([0], pa.int64()), "b": pa.array([len(some)], pa.int64()),
                                                  "block": pa.array([block], pa.binary())})
        used = np.flatnonzero(df)
        a, b = np.concatenate([used, [-1, -2]]), np.concatenate([df[used], [n_docs, n_terms]])
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(a), np.int32)), "a": pa.array(a), "b": pa.array(b),
                                          "block": pa.array([None] * len(a), pa.binary())})
    return run


# ---- the tree ----------------------------------------------------------------------------

class Tree:
    """A trie over documents (ids, m) with postings (doc, term, tf), terms numbered by falling frequency.

    Nodes are ranges of the documents in the order of their term vectors: ``children`` of
    an inner node, none of a leaf. ``most`` holds the greatest tf of each term below
    a node, ``least`` the least m.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        size = len(weight)
        begin = np.cumsum(counts) - counts
        path = np.full((len(ids), SHARED), size, np.int64)
        for k in range(min(SHARED, int(counts.max(initial=0)))):
            has = counts > k
            path[has, k] = term[begin[has] + k]
        order = np.lexsort(path.T[::-1])
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.m, self.path, self.weight = ids[order], m[order], path[order], weight
        self.lo, self.hi, self.children = [], [], []
        self._grow(0, len(ids), 0)
        leaves = [i for i, c in enumerate(self.children) if not c]
        leaves.sort(key=lambda i: self.lo[i])
        self.leaf_of = {node: i for i, node in enumerate(leaves)}
        starts = np.array([self.lo[i] for i in leaves])
        doc = place[np.repeat(np.arange(len(ids)), counts)]
        leaf = np.searchsorted(starts, doc, side="right") - 1
        by = np.lexsort((doc, term, leaf))
        self.doc, term, tf, key = doc[by], term[by], tf[by], leaf[by] * size + term[by]
        self.value = weight[term] * gain(tf, self.m[self.doc])
        edges = bf.groups(key)
        # postings of a term in a leaf: from first[leaf, term] to last[leaf, term]
        self.first, self.last = np.zeros(len(leaves) * size, np.int32), np.zeros(len(leaves) * size, np.int32)
        self.first[key[edges[:-1]]], self.last[key[edges[:-1]]] = edges[:-1], edges[1:]
        self.first, self.last = self.first.reshape(-1, size), self.last.reshape(-1, size)
        self.most, self.least = np.zeros((len(self.lo), size), np.int64), np.zeros(len(self.lo), np.int64)
        flat = np.zeros(len(leaves) * size, np.int64)
        flat[key[edges[:-1]]] = np.maximum.reduceat(tf, edges[:-1]) if len(tf) else 0
        self.most[leaves] = flat.reshape(-1, size)
        for node in range(len(self.lo) - 1, -1, -1):  # children come after their parents
            self.least[node] = self.m[self.lo[node]:self.hi[node]].min(initial=np.iinfo(np.int64).max)
            if self.children[node]:
                self.most[node] = self.most[self.children[node]].max(axis=0)

    def _grow(self, lo: int, hi: int, depth: int) -> int:
        node = len(self.lo)
        self.lo.append(lo)
        self.hi.append(hi)
        self.children.append([])
        while hi - lo > LEAF and depth < SHARED and self.path[lo, depth] == self.path[hi - 1, depth]:
            depth += 1  # one child only
        if hi - lo <= LEAF or depth == SHARED:
            return node
        edges = lo + bf.groups(self.path[lo:hi, depth])
        start, children = lo, []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > LEAF:  # small siblings before it share a leaf
                if a > start:
                    children.append((start, a, SHARED))
                children.append((a, b, depth + 1))
                start = b
            elif b - start > LEAF:
                if a > start:
                    children.append((start, a, SHARED))
                start = a
        if hi > start:
            children.append((start, hi, SHARED))
        self.children[node] = [self._grow(*c) for c in children]
        return node

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """What no document below each node can exceed."""
        return gain(self.most[:, terms], self.least[:, None]) @ self.weight[terms]

    def score(self, node: int, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of documents in a leaf that hold any of the terms, their scores)."""
        leaf, lo = self.leaf_of[node], self.lo[node]
        first, n = self.first[leaf, terms], self.last[leaf, terms] - self.first[leaf, terms]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        doc, value = self.doc[at] - lo, self.value[at]
        if float(self.weight[terms].sum()) * 1e6 < _EXACT:
            total = np.bincount(doc, weights=value, minlength=self.hi[node] - lo).astype(np.int64)
        else:
            total = np.zeros(self.hi[node] - lo, np.int64)
            np.add.at(total, doc, value)
        some = np.flatnonzero(total)
        return some + lo, total[some]

    def search(self, terms: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The BEST of ``best`` (scores, ids) and the documents of this tree."""
        scores, ids = best
        bound = self.bounds(terms)
        ahead = [0]
        while ahead:
            node = ahead.pop()
            # an equal score may win by its smaller id
            if bound[node] == 0 or len(scores) == BEST and bound[node] < scores[-1]:
                continue
            if self.children[node]:
                ahead += sorted(self.children[node], key=lambda c: bound[c])
                continue
            at, found = self.score(node, terms)
            if len(scores) == BEST:
                may = found >= scores[-1]
                at, found = at[may], found[may]
            if len(at):
                scores, ids = np.concatenate([scores, found]), np.concatenate([ids, self.ids[at]])
                o = np.lexsort((ids, -scores))[:BEST]
                scores, ids = scores[o], ids[o]
        return scores, ids


def _search(items: list[tuple[int, np.ndarray]], order: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
    """Each item's best of a task. ``order`` renumbers terms by falling frequency, as ``weight`` and items are."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]

        def take(blocks: list) -> None:
            ids, n, counts, term, tf = (np.concatenate(x) for x in zip(*blocks, strict=True))
            term, tf, owner = order[term.astype(np.int64)], tf.astype(np.int64), np.repeat(np.arange(len(ids)), counts)
            by = np.lexsort((term, owner))
            tree = Tree(ids, 100 - 90 + (90 * n.astype(np.int64) * n_docs) // n_terms, counts, term[by], tf[by], weight)
            for i, (_, terms) in enumerate(items):
                best[i] = tree.search(terms, best[i])

        held, docs = [], 0
        for batch in batches:
            for value in batch.column("block"):
                held.append(bf.unpack(value.as_buffer().to_pybytes()))
                docs += len(held[-1][0])
                if docs >= TREE_DOCS:
                    take(held)
                    held, docs = [], 0
        if held:
            take(held)
        n = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(np.repeat(np.array([i for i, _ in items], np.int64), n)),
                                          "doc_id": pa.array(np.concatenate([d for _, d in best])), "score": pa.array(np.concatenate([s for s, _ in best]))})
    return run


def _item_terms(rows: list) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """([(item, its terms' hashes)], all hashes in order)."""
    out = []
    for r in rows:
        data = np.frombuffer(r.text.encode(), np.uint8)
        out.append((r.item_id, np.unique(term_hashes(data, np.array([0, len(data)]))[0])))
    return out, np.unique(np.concatenate([h for _, h in out]))


def _block_search(docs: DataFrame, rows: list) -> DataFrame | None:
    items, vocabulary = _item_terms(rows)
    if not len(vocabulary):
        return None
    spark = docs.sparkSession
    vectors = stored(docs.mapInArrow(_restrict(vocabulary), "kind int, a long, b long, block binary"), "term-vectors")
    counted = dict(vectors.where("kind = 1").groupBy("a").agg(F.sum("b")).toArrow().to_pandas().itertuples(index=False, name=None))
    n_docs, n_terms = counted.pop(-1, 0), counted.pop(-2, 0)
    if not counted:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    df[list(counted)] = list(counted.values())
    falling = np.argsort(-df, kind="stable")
    order = np.empty(len(df), np.int64)
    order[falling] = np.arange(len(df))
    asked = [(i, np.sort(order[np.searchsorted(vocabulary, h)])) for i, h in items if len(h)]
    shared = spark.sparkContext.broadcast((asked, order, weights(n_docs, df[falling])))
    return vectors.where("kind = 0").select("block").mapInArrow(lambda b: _search(*shared.value, n_docs, n_terms)(b), FOUND)


def best_documents(documents: DataFrame, benchmark: DataFrame, best: int = BEST) -> DataFrame:
    """Each item's ten best documents: item_id, rank, doc_id, score, best first, ties by doc_id.

    ``documents`` needs doc_id and text, ``benchmark`` item_id and text; other columns are
    ignored. Texts that are null, empty or without a letter, digit or character beyond
    ASCII have no term: such documents are not counted and such items find nothing.
    Of rows that repeat an id the one with the smallest text counts, once; rows without id
    take no part. Items with fewer than ten documents of a score above 0 return those.
    Terms are told apart by 64-bit hashes. Empty tables give no rows.
    """
    if not 0 < best <= BEST:
        raise ValueError(f"best must be from 1 to {BEST}")
    spark = documents.sparkSession
    docs, items = (bf.one_per_id(df.select(F.col(key).cast("long").alias(key), "text"), key, "text").where(F.col(key).isNotNull()).select(key, bf.whole_text())
                   for df, key in ((documents, "doc_id"), (benchmark, "item_id")))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    found = []
    for i in range(blocks):  # each block's items against all documents
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).orderBy("item_id").collect()
        part = _block_search(docs, rows) if rows else None
        if part is not None:
            found.append(part)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return every.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS l FROM t WHERE len(w) > 0),
m AS (SELECT doc_id, 10 + (90 * len(w)::BIGINT * nd) // l AS m FROM t, s WHERE len(w) > 0),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY 1),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r
WHERE score > 0 QUALIFY rank <= 10
"""
