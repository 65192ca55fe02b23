"""Benchmark decontamination by greedy string tiling.

A document leaks a benchmark item when tiles, runs of at least LEAST words that both
have in the same order, cover COVER of the item's words, in whatever order the tiles
stand. Running Karp-Rabin matching marks the longest unmarked match again and again.

Only words inside shared runs of LEAST words can be in a tile. A bit set of fixed size
over the items' runs tells which documents have any; of these only the words in such
runs, never texts, are joined with the items through the runs themselves. A pair needs
COVER * n / LEAST of the item's runs, repeats counted, to reach its threshold. An item
below LEAST words is one run of all its words, and leaks where these stand in a row.
Equal texts count as one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

bf.lean_memory()  # in every worker that runs these tasks

LEAST = 5
COVER = 0.6
FILTER_BITS = 26
FIRST_LENGTH = 20
_MOD = (1 << 61) - 1
_BASE = 911382323


# ---- tiling ------------------------------------------------------------------------------

class _Side:
    """A token sequence, which tokens are marked, and hashes of its windows."""

    def __init__(self, tokens: list[int]):
        self.tokens, self.marked = tokens, bytearray(len(tokens))

    def windows(self, length: int) -> Iterator[tuple[int, int]]:
        """(start, rolling hash) of windows without a marked token."""
        lead = pow(_BASE, length, _MOD)
        h = free = 0
        for i, t in enumerate(self.tokens):
            if self.marked[i]:
                h = free = 0
                continue
            h = (h * _BASE + t) % _MOD
            free += 1
            if free > length:
                h = (h - self.tokens[i - length] * lead) % _MOD
            if free >= length:
                yield i - length + 1, h


def _longest(item: _Side, doc: _Side, length: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Matches of ``length`` or more (their size, places); stops early at one over twice that."""
    where: dict[int, list[int]] = {}
    for at, h in doc.windows(length):
        where.setdefault(h, []).append(at)
    found, most = [], 0
    for p, h in item.windows(length):
        for d in where.get(h, ()):
            k = 0
            while (p + k < len(item.tokens) and d + k < len(doc.tokens) and item.tokens[p + k] == doc.tokens[d + k]
                   and not item.marked[p + k] and not doc.marked[d + k]):
                k += 1
            if k >= length:
                found.append((k, p, d))
                most = max(most, k)
                if k > 2 * length:
                    return k, []
    return most, found


def greedy_tiles(item_tokens: list[int], doc_tokens: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the document, length), longest first."""
    item, doc = _Side(item_tokens), _Side(doc_tokens)
    tiles, length = [], max(least, min(FIRST_LENGTH, len(item_tokens)))
    while True:
        most, found = _longest(item, doc, length)
        if most > 2 * length:
            length = most
            continue
        found.sort(key=lambda m: (-m[0], m[1], m[2]))
        for k, p, d in found:
            # a match that a longer one has taken part of comes again at a shorter length
            if not any(item.marked[p:p + k]) and not any(doc.marked[d:d + k]):
                item.marked[p:p + k] = doc.marked[d:d + k] = b"\1" * k
                tiles.append((p, d, k))
        if found and most > length:
            again = _longest(item, doc, length)[0]
            if again >= length:
                continue
        if length > 2 * least:
            length //= 2
        elif length > least:
            length = least
        elif not found or _longest(item, doc, length)[0] < length:
            return tiles


# ---- candidates --------------------------------------------------------------------------

def _runs(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and the first word of each run of ``width`` words."""
    runs, owner = bf.shingles(hashes, at, width)
    full = (np.diff(at) >= width)[owner]
    n = np.bincount(owner, minlength=len(at) - 1)
    first = at[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return runs[full], first[full]


def _lists(values: np.ndarray, at: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in bf.text_chunks(batches):
        hashes, at = bf.words(data, off)
        size, parts = np.diff(at), []
        for width in range(1, LEAST + 1):
            runs, first = _runs(hashes, at, width)
            n = size[np.searchsorted(at, first, side="right") - 1]
            mine = n == width if width < LEAST else n >= LEAST
            parts.append((runs[mine], first[mine]))
        runs, first = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.argsort(first, kind="stable")
        runs, first = runs[o], first[o]
        yield pa.RecordBatch.from_arrays([
            rows.column("item"), rows.column("item_id"), _lists(hashes.view(np.int64), at, pa.int64()),
            _lists(runs.view(np.int64), np.searchsorted(first, at), pa.int64())], ["item", "item_id", "words", "runs"])


def _place(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in batches:
        runs = np.unique(_place(batch.column("runs").flatten().to_numpy(zero_copy_only=False).view(np.uint64)))
        np.bitwise_or.at(bits, runs >> 3, (1 << (runs & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_pydict({"at": pa.array(np.flatnonzero(bits)), "bits": pa.array(bits[bits > 0].astype(np.int32))})


def _hits(marked, widths: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        np.bitwise_or.at(bits, marked.value[0], marked.value[1])
        for rows, data, off in bf.text_chunks(batches):
            hashes, at = bf.words(data, off)
            # the words inside hit runs, in place
            cover, parts = np.zeros(len(hashes) + 1, np.int64), []
            for width in widths:
                runs, first = _runs(hashes, at, width)
                p = _place(runs)
                hit = (bits[p >> 3] >> (p & 7)) & 1 > 0
                runs, first = runs[hit], first[hit]
                np.add.at(cover, first, 1)
                np.add.at(cover, first + width, -1)
                parts.append((runs, first))
            runs, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(runs):
                continue
            o = np.argsort(first, kind="stable")
            runs, first = runs[o], first[o]
            inside = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            n_runs, n_words = np.searchsorted(first, at), np.searchsorted(inside, at)
            some = pa.array(np.diff(n_runs) > 0)
            owner = np.searchsorted(at, inside, side="right") - 1
            yield pa.RecordBatch.from_arrays([
                rows.column("key"), rows.column("doc_id"), _lists(runs.view(np.int64), n_runs, pa.int64()),
                _lists((inside - at[owner]).astype(np.int64), n_words, pa.int64()),
                _lists(hashes[inside].view(np.int64), n_words, pa.int64())], ["key", "doc_id", "runs", "places", "words"]).filter(some)
    return run


def _tile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        covered, count = [], []
        for item, words, places in zip(*(batch.column(c).to_pylist() for c in ("item_words", "words", "places")), strict=True):
            doc, last = [], None
            for w, p in zip(words, places, strict=True):
                if last is not None and p != last + 1:
                    doc.append(-1)  # words apart are no run; no hash is -1 below
                doc.append(w & _MOD)
                last = p
            tiles = greedy_tiles([w & _MOD for w in item], doc, min(LEAST, len(item)))
            covered.append(sum(t[2] for t in tiles))
            count.append(len(tiles))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item"), pa.array(covered, pa.int64()), pa.array(count, pa.int64())],
                                         ["key", "item", "n_covered", "n_tiles"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hit documents, leaks): key and doc_id of documents with any shared run; key, item_id,
    n_words, n_covered, n_tiles of each pair above the threshold."""
    spark = docs.sparkSession
    items = (benchmark.select(F.xxhash64(bf.whole_text()).alias("item"), F.col("item_id").cast("long").alias("item_id"), bf.whole_text())
             .groupBy("item").agg(F.min("item_id").alias("item_id"), F.first("text").alias("text")))
    items = stored(items.mapInArrow(_items, "item long, item_id long, words array<long>, runs array<long>"), "items")
    filter_ = items.select("runs").coalesce(16).mapInArrow(_mark, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    marked = spark.sparkContext.broadcast((filter_["at"].to_numpy(), filter_["bits"].to_numpy().astype(np.uint8)))
    rows = docs.select(F.xxhash64(bf.whole_text()).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), bf.whole_text())
    short = items.select(F.size("words").alias("n")).where(f"n > 0 AND n < {LEAST}").distinct().collect()
    hits = stored(rows.mapInArrow(_hits(marked, sorted({LEAST, *(r.n for r in short)})), "key long, doc_id long, runs array<long>, places array<long>, words array<long>"), "hits")
    marked.unpersist()
    texts = hits.groupBy("key").agg(*[F.first(c).alias(c) for c in ("runs", "places", "words")])
    size = items.select("item", "item_id", F.size("words").cast("long").alias("n_words"))
    shared = (texts.select("key", F.explode(F.array_distinct("runs")).alias("run"))
              .join(items.select("item", F.explode("runs").alias("run")).groupBy("item", "run").agg(F.count("*").alias("n")), "run")
              .groupBy("key", "item").agg(F.sum("n").alias("n_shared"))
              .join(size, "item").where(F.col("n_shared") * LEAST >= F.col("n_words") * COVER).select("key", "item", "item_id", "n_words"))
    pairs = (shared.join(texts.select("key", "places", "words"), "key")
             .join(items.select("item", F.col("words").alias("item_words")), "item"))
    tiled = pairs.select("key", "item", "places", "words", "item_words").mapInArrow(_tile, "key long, item long, n_covered long, n_tiles long")
    found = tiled.join(size, "item").where(F.col("n_covered") >= F.col("n_words") * COVER)
    return hits.select("key", "doc_id"), found.select("key", "item_id", "n_words", "n_covered", "n_tiles")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks only: doc_id, item_id, n_words, n_covered, coverage, n_tiles.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are
    ignored. Null and empty texts leak nothing and are leaked by nothing; an item below
    LEAST words leaks where all its words stand in a row. Items of equal text count once, under their smallest item_id. Each row of
    ``docs`` with such a text has its rows in the result, rows without doc_id too, under
    a null one. Empty tables give no rows.
    """
    hits, found = leaks(docs, benchmark)
    return hits.join(found, "key").select("doc_id", "item_id", "n_words", "n_covered", (F.col("n_covered") / F.col("n_words")).alias("coverage"), "n_tiles")


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text leaks no item."""
    _, found = leaks(docs, benchmark)
    keys = found.select(F.col("key").alias("__llm_key")).distinct()
    return docs.withColumn("__llm_key", F.xxhash64(bf.whole_text())).join(keys, "__llm_key", "left_anti").select(docs.columns)
