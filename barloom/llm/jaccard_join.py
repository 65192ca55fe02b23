"""Near-duplicate groups by an exact Jaccard join on word shingles (grouped prefix join).

A document is the set of its distinct five-word shingles. Two documents whose sets have
100 * common >= 75 * union share a shingle among the first ``n - ceil(0.75 n) + 1`` of
either set under any fixed order of shingles, so only these prefixes are exchanged.

1. Documents with equal prefixes and set sizes collapse into one group.
2. Groups that share a prefix shingle are candidates. Filters on group pairs: set size, the
   shorter prefixes that the two sizes allow, and what the common prefix shingles and the
   positions of the last one still allow.
3. Surviving groups expand to their distinct sets. Pairs whose parity sketches, which come with
   the prefixes, differ in more bits than the sets may in shingles go. Only of what is left are
   whole sets made, and compared while they are in different components: first one partner
   each, then the rest.

The order puts shingles of many documents last, so a passage that documents have from
elsewhere is hardly ever in a prefix. Any order gives the same links. Lists of more than
LIST groups (large families of near copies) are not paired within: all compare with the
first member, and what is still apart meets its list, or all lists that hang together
where that is less, block by block in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

bf.lean_memory()  # in every worker that runs these tasks

WIDTH = 5
SIMILAR = 75
MOST_HEAVY = 1 << 20
LOCAL_BYTES = 16 << 20
LOCAL_COUNT = 2
HEAVY_COUNT = 8
LIST = 64
BLOCK = 512
FILTER_BITS = 26
BAND = math.log(100 / SIMILAR) * 1.000001
_BITS = np.uint64(52)
_LOW = np.uint64((1 << 52) - 1)
_HEAVY = np.uint64(1 << 52)

FOUND = "kind int, a long, b long, c long, d long, e long, f long, sketch binary"


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (52 bits) of a chunk's texts, ascending within each, and where each text's begin."""
    hashes, at = bf.words(data, off)
    keys, owner = bf.shingles(hashes, at, WIDTH)
    keys = np.sort((owner.astype(np.uint64) << _BITS) | (keys >> np.uint64(12)))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys & _LOW, np.searchsorted(keys >> _BITS, np.arange(len(off), dtype=np.uint64))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))
    return total[at[1:]] - total[at[:-1]]


def set_prints(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each whole set."""
    return (_sums(bf.mix(keys + np.uint64(0x51ED270B1)), at), _sums(bf.mix(keys ^ np.uint64(0x7F4A7C159E3779B9)), at))


def _sketches(keys: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Parity sketches of sets: one bit per residue, set when an odd number of shingles has it.

    Bits in which two sketches differ are at most the shingles in which the sets differ.
    """
    out = []
    for i in range(len(at) - 1):
        k = keys[at[i]:at[i + 1]]
        bits = 1 << max(6, (4 * len(k)).bit_length())
        odd = np.bincount((k & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)))
    return out


def _local_counts(buckets: int):
    """Shingles met in LOCAL_COUNT or more distinct sets of one stretch of a task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0

        def flush():
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            keys = keys[1:][keys[1:] == keys[:-1]]  # all but the first of each shingle; few
            g = bf.groups(keys)
            count = np.diff(g) + 1
            often = count >= LOCAL_COUNT
            keys, count = keys[g[:-1][often]], count[often].astype(np.uint32)
            o, at = bf.by_bucket(bf.spread(keys, buckets), buckets)
            used = np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "block": pa.array(
                [bf.pack(keys[o[at[k]:at[k + 1]]], count[o[at[k]:at[k + 1]]]) for k in used], pa.binary())})

        for _, data, off in bf.text_chunks(batches):
            keys, at = shingle_sets(data, off)
            keep = np.zeros(len(off) - 1, bool)
            for i, p in enumerate(set_prints(keys, at)[0].tolist()):
                if p not in seen:
                    seen.add(p)
                    keep[i] = True
            held.append(keys[np.repeat(keep, np.diff(at))])
            size += len(data)
            if size >= LOCAL_BYTES:
                yield flush()
                held, seen, size = [], set(), 0
        if held:
            yield flush()
    return run


def _total_counts(least: float):
    def run(table: pa.Table) -> pa.Table:
        keys, count = bf.unpack_all(table["block"])
        o = np.argsort(keys)
        at = bf.groups(keys[o])
        total = np.append(0, np.cumsum(count[o], dtype=np.int64))
        total = total[at[1:]] - total[at[:-1]]
        often = total >= least
        return pa.table({"key": keys[o][at[:-1]][often].view(np.int64), "n": total[often]})
    return run


def heavy_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles to order last, ascending, and their places among themselves, rarer first.

    They are those whose lists would be long, by an estimate from counts within tasks; the
    MOST_HEAVY commonest at most, a bound on what is broadcast and no change to the result.
    """
    buckets = bf.bucket_count(docs.sparkSession, 1)
    rows = (docs.mapInArrow(_local_counts(buckets), "bucket int, block binary").groupBy("bucket")
            .applyInArrow(_total_counts(HEAVY_COUNT), "key long, n long").orderBy(F.desc("n"), "key").limit(MOST_HEAVY).toArrow())
    if not rows.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys, n = rows["key"].to_numpy().astype(np.uint64), rows["n"].to_numpy()
    place = np.empty(len(keys), np.uint64)
    place[np.lexsort((keys, n))] = np.arange(len(keys), dtype=np.uint64)
    o = np.argsort(keys)
    return keys[o], place[o]


def _post(heavy, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = heavy.value
        for rows, data, off in bf.text_chunks(batches):
            ids = bf.longs(rows, "doc_id")
            keys, at = shingle_sets(data, off)
            n = np.diff(at)
            owner = np.repeat(np.arange(len(n)), n)
            fa, fb = set_prints(keys, at)
            sketches = _sketches(keys, at)
            if len(last):
                place = np.minimum(np.searchsorted(last, keys), len(last) - 1)
                keys = np.where(last[place] == keys, rank[place] | _HEAVY, keys)
                order = np.lexsort((keys, owner)) if (keys & _HEAVY).any() else slice(None)
                keys = keys[order]
            prefix = n - -(-SIMILAR * n // 100) + (n > 0)
            position = np.arange(len(keys)) - at[:-1][owner]
            inside = position < prefix[owner]
            keys, owner, position = keys[inside], owner[inside], position[inside]
            tag = _sums(bf.mix(keys + np.uint64(0x1234567)), np.append(0, np.cumsum(prefix))) >> np.uint64(32)
            group = (n.astype(np.uint64) << np.uint64(32)) | tag
            # one document of each group of this chunk posts for all
            first = np.zeros(len(n), bool)
            first[np.unique(group, return_index=True)[1]] = True
            first &= n > 0
            post = first[owner]
            keys, owner, position = keys[post], owner[post], position[post]
            bucket = bf.spread(keys, buckets)
            o, b = bf.by_bucket(bucket, buckets)
            keys, position, own = keys[o], position[o].astype(np.uint32), owner[o]
            tags, sizes = tag.astype(np.uint32)[own], n[own].astype(np.uint32)
            home = np.arange(len(n)) % buckets
            o2, b2 = bf.by_bucket(home, buckets)
            facts = [a[o2] for a in (ids, n, fa.view(np.int64), fb.view(np.int64), group.view(np.int64))]
            facts.append(np.array([len(x) for x in sketches], np.int32)[o2])
            ends = np.append(0, np.cumsum(facts[-1], dtype=np.int64))[b2]
            flat = np.concatenate([sketches[i] for i in o2])
            used = np.flatnonzero((np.diff(b) > 0) | (np.diff(b2) > 0))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(used, pa.int32()),
                "block": pa.array([bf.pack(*[a[b[k]:b[k + 1]] for a in (keys, tags, sizes, position)],
                                           *[a[b2[k]:b2[k + 1]] for a in facts], flat[ends[k]:ends[k + 1]]) for k in used], pa.binary())})
    return run


def _rows(kind: int, *columns: np.ndarray, sketch: pa.Array | None = None) -> pa.Table:
    n = len(columns[0])
    cols = [np.full(n, kind, np.int32), *[np.asarray(c).astype(np.int64, copy=False) for c in columns]]
    cols += [np.zeros(n, np.int64)] * (7 - len(cols))
    return pa.table(dict(zip(("kind", *"abcdef"), cols, strict=True)) | {"sketch": pa.nulls(n, pa.binary()) if sketch is None else sketch})


def _pairs_of(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within short runs."""
    left, right = [], []
    for gap in range(1, int(sizes.max()) if len(sizes) else 0):
        s, z = starts[sizes > gap], sizes[sizes > gap] - gap
        first = np.repeat(s - np.cumsum(z) + z, z) + np.arange(z.sum())
        left.append(first)
        right.append(first + gap)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _candidates(table: pa.Table) -> pa.Table:
    keys, tags, sizes, position, ids, n, fa, fb, group, length, flat = bf.unpack_all(table["block"])
    ends = np.append(0, np.cumsum(length)).astype(np.int32)
    out = [_rows(0, ids, n, fa, fb, group, sketch=pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)]))]
    g = (sizes.astype(np.uint64) << np.uint64(32)) | tags
    o = np.argsort(keys)
    several = np.repeat(np.diff(at := bf.groups(keys[o])) > 1, np.diff(at))
    o = o[several]
    o = o[np.lexsort((g[o], keys[o]))]
    same = np.zeros(len(o), bool)
    same[1:] = (keys[o][1:] == keys[o][:-1]) & (g[o][1:] == g[o][:-1])
    o = o[~same]
    keys, g, position = keys[o], g[o], position[o].astype(np.int64)
    at = bf.groups(keys)
    z = np.diff(at)
    short = z <= LIST
    left, right = _pairs_of(z[short], at[:-1][short])
    nl, nr = (g[left] >> np.uint64(32)).astype(np.int64), (g[right] >> np.uint64(32)).astype(np.int64)
    fits = 100 * nl >= SIMILAR * nr  # sorted by size within a list
    # sets that have to share ``least`` shingles meet among the first n - least + 1 of either
    least = -(-SIMILAR * (nl + nr) // (100 + SIMILAR))
    fits &= (position[left] <= nl - least) & (position[right] <= nr - least)
    left, right = left[fits], right[fits]
    p = np.lexsort((keys[left], g[right], g[left]))
    left, right = left[p], right[p]
    ends = bf.groups(g[left], g[right])
    last = ends[1:] - 1
    out.append(_rows(1, g[left][last].view(np.int64), g[right][last].view(np.int64), np.diff(ends),
                     keys[left][last].view(np.int64), position[left][last], position[right][last]))
    lists = {}
    for s, e in zip(at[:-1][~short].tolist(), at[1:][~short].tolist(), strict=True):
        members = g[s:e]
        lists[int(bf.mix(members + np.arange(len(members), dtype=np.uint64)).sum().view(np.int64))] = members
    if lists:
        out.append(_rows(2, np.repeat(np.array(list(lists), np.int64), [len(m) for m in lists.values()]),
                         np.concatenate(list(lists.values())).view(np.int64)))
    return pa.concat_tables(out)


def _size(group: str) -> Column:
    return F.shiftright(group, 32)


def _may_link(a: Column, b: Column, common: Column) -> Column:
    """Whether ``common`` shared shingles suffice for sets of sizes a and b."""
    return F.lit(100 + SIMILAR) * common >= F.lit(SIMILAR) * (a + b)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as 40-bit planes, which is plenty between two sets, and their parity sketches."""
    for rows, data, off in bf.text_chunks(batches):
        keys, at = shingle_sets(data, off)
        planes = [(keys[at[i]:at[i + 1]] >> np.uint64(12)).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes() for i in range(len(off) - 1)]
        yield pa.RecordBatch.from_pydict({"id": rows.column("doc_id"), "n": pa.array(np.diff(at)), "shingles": pa.array(planes, pa.binary()),
                                          "sketch": pa.array([x.tobytes() for x in _sketches(keys, at)], pa.binary())})


def _place(ids: np.ndarray) -> np.ndarray:
    return (bf.mix(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in batches:
        p = _place(bf.longs(batch, "doc_id"))
        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_pydict({"at": pa.array(np.flatnonzero(bits)), "bits": pa.array(bits[bits > 0].astype(np.int32))})


def _marked(marked):
    """Rows whose doc_id may be one of those marked."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        np.bitwise_or.at(bits, marked.value[0], marked.value[1])
        for batch in batches:
            p = _place(bf.longs(batch, "doc_id"))
            yield batch.filter(pa.array((bits[p >> 3] >> (p & 7)) & 1 > 0))
    return run


def _values(planes) -> np.ndarray:
    out = np.zeros((len(planes) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(planes, np.uint8).reshape(5, -1).T
    return out.view(np.uint64).reshape(-1)


def _differ_little(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a link."""
    for batch in batches:
        keep = []
        for x, y, n, m in zip(*(batch.column(c) for c in ("x", "y")), *(batch.column(c).to_pylist() for c in ("nx", "ny")), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            small = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(v.reshape(-1, small), axis=0) for v in (x, y))
            least = -(-SIMILAR * (n + m) // (100 + SIMILAR))
            keep.append(int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * least)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = _values(x.as_buffer()), _values(y.as_buffer())
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            linked.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(id, root): smallest id reachable from each id of ``links`` (a, b).

    Each round every id takes the least root among its neighbours' and then the root of
    that root, until nothing changes; rounds grow with the logarithm of the longest chain.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    before = None
    while True:
        roots = stored(roots, "roots")
        sum_ = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if sum_ is None or sum_ == before:
            return roots
        before = sum_
        near = (both.join(roots.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
                .agg(F.min("root").alias("near")))
        step = roots.join(near, "id").select("id", F.least("root", "near").alias("root"))
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("up"))
        roots = step.join(up, "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root"))


class _Links:
    """What has been compared so far, and the component of each set."""

    def __init__(self, texts: DataFrame, sets: DataFrame):
        self.texts, self.sets, self.links, self.tried, self.roots = texts, sets, None, None, None

    def root(self, df: DataFrame, column: str, name: str) -> DataFrame:
        if self.roots is None:
            return df.withColumn(name, F.col(column))
        found = self.roots.select(F.col("id").alias(column), F.col("root").alias("_root"))
        return df.join(found, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs not compared yet whose components differ."""
        pairs = self.root(self.root(pairs, "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
        return pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti")

    def beside(self, pairs: DataFrame, column: str) -> DataFrame:
        x = self.sets.select(F.col("id").alias("a"), F.col("n").alias("nx"), F.col(column).alias("x"))
        y = self.sets.select(F.col("id").alias("b"), F.col("n").alias("ny"), F.col(column).alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "x", "y")

    def keep_only(self, ids: DataFrame) -> None:
        """Makes the whole sets that later comparisons may ask for; most candidates are gone by now.

        A bit set of fixed size keeps nearly all other texts from the shuffle.
        """
        ids = stored(ids.toDF("doc_id").distinct(), "kept-ids")
        bits = ids.coalesce(16).mapInArrow(_mark, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        marked = ids.sparkSession.sparkContext.broadcast((bits["at"].to_numpy(), bits["bits"].to_numpy().astype(np.uint8)))
        # a sort-merge join at every size: the ids grow with the texts
        texts = self.texts.mapInArrow(_marked(marked), self.texts.schema).join(ids.hint("merge"), "doc_id", "left_semi")
        self.sets = stored(texts.mapInArrow(_sets, "id long, n long, shingles binary, sketch binary"), "shingle-sets")
        marked.unpersist()

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that may link by their sketches; written, as several steps read them."""
        return stored(self.beside(pairs.select("a", "b").distinct(), "sketch").mapInArrow(_differ_little, "a long, b long"), "pairs")

    def compare(self, pairs: DataFrame) -> None:
        """Compares possible pairs in full and joins the components of those linked."""
        if pairs.isEmpty():
            return
        linked = stored(self.beside(pairs, "shingles").mapInArrow(_compare, "a long, b long"), "linked")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        self.links = linked if self.links is None else self.links.union(linked)
        if not linked.isEmpty():
            self.roots = components(self.links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links).

    ``docs`` needs doc_id and text; other columns are ignored. Null, empty and blank
    texts have no shingles and are linked with nothing, not even with each other. Texts
    below five words are one shingle. Of rows that repeat a doc_id the one with the
    smallest text counts, once; rows without doc_id keep a null component and link
    nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = bf.one_per_id(docs.select("doc_id", "text"), "doc_id", "text")
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), bf.whole_text())
    heavy = spark.sparkContext.broadcast(heavy_shingles(keyed))
    buckets = bf.bucket_count(spark, 1)
    found = stored(keyed.mapInArrow(_post(heavy, buckets), "bucket int, block binary")
                   .groupBy("bucket").applyInArrow(_candidates, FOUND), "prefixes")
    heavy.unpersist()

    facts = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "c", "d", F.col("e").alias("g"))
    sets = facts.where("n > 0").groupBy("n", "c", "d").agg(F.min("doc_id").alias("id"), F.min("g").alias("g"))
    members = stored(sets.select("id", "g"), "distinct-sets")

    left = F.col("c") + F.least(_size("a") - F.col("e") - 1, _size("b") - F.col("f") - 1)
    group_pairs = (found.where("kind = 1").groupBy("a", "b")
                   .agg(F.sum("c").alias("c"), F.max_by(F.struct("e", "f"), "d").alias("at"))
                   .select("a", "b", "c", "at.e", "at.f").where(_may_link(_size("a"), _size("b"), left)).select("a", "b"))
    x, y = members.select(F.col("id").alias("x"), F.col("g").alias("a")), members.select(F.col("id").alias("y"), F.col("g").alias("b"))
    pairs = group_pairs.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    lists = (found.where("kind = 2").select(F.col("a").alias("list"), F.col("b").alias("g")).distinct()
             .join(members, "g").select("list", "id", _size("g").alias("n")))
    # sets of one group are candidates among themselves
    own = members.groupBy("g").count().where("count > 1").select("g")
    lists = lists.union(members.join(own, "g").select(F.col("g").alias("list"), "id", _size("g").alias("n")))

    pairs, lists = stored(pairs.distinct(), "candidates"), stored(lists, "lists")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(lists.select("id")).distinct()
    sketches = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "sketch")
    links = _Links(keyed, stored(sketches.join(wanted.hint("merge"), "doc_id", "left_semi").withColumnRenamed("doc_id", "id"), "sketches"))
    _walk(links, pairs, lists)

    classes = facts.join(sets.drop("g"), ["n", "c", "d"], "left").select("doc_id", "n", "id")
    result = links.root(classes, "id", "root").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    without = docs.where(F.col("doc_id").isNull()).select(bf.whole_text()).mapInArrow(_count, "n_shingles long")
    return result.unionByName(without.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles",
                                             F.lit(None).cast("long").alias("component_id")))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, off in bf.text_chunks(batches):
        yield pa.RecordBatch.from_pydict({"n_shingles": pa.array(np.diff(shingle_sets(data, off)[1]))})


def _walk(links: _Links, pairs: DataFrame, lists: DataFrame) -> None:
    """Compares one partner of each set and the leader of each list, then what is still apart."""
    pairs = links.possible(pairs)
    leader = lists.groupBy("list").agg(F.min("id").alias("a"), F.min_by("n", "id").alias("na"))
    led = stored(lists.join(leader, "list").where("id <> a").select("list", "a", "na", "id", "n"), "led")
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    star = links.possible(led.where(_alike("n", "na")).select("a", F.col("id").alias("b")))
    links.keep_only(pairs.select("a").union(pairs.select("b")).union(led.select("a")).union(led.select("id")))
    links.compare(stored(one.union(star).distinct(), "round"))
    rest = pairs
    if not led.isEmpty():
        family = components(led.select("a", F.col("id").alias("b")))
        rest = rest.union(_families(links, _units(links, lists, family.select("id", F.col("root").alias("family")))))
    links.compare(stored(links.apart(rest).distinct(), "round"))


def _cost(members: DataFrame, key: str) -> DataFrame:
    """Per ``key`` whose members (id, root) are of several components, the pairs that block against block meets."""
    return (members.groupBy(key, "root").agg(F.count("*").alias("k")).groupBy(key).agg(F.sum("k").alias("m"), F.max("k").alias("k"))
            .where("m > k").select(key, (F.col("m").cast("double") * (F.col("m") - F.col("k"))).alias("cost")))


def _units(links: _Links, lists: DataFrame, family: DataFrame) -> DataFrame:
    """(id, family): what to search for pairs, a family at once or list by list, whichever has fewer to meet.

    A family is chained by lists, most of whose members need not meet those of another list; but
    near copies are in many lists together. What is in one component already is left out.
    """
    members = stored(links.root(lists.select("list", "id").join(family, "id"), "id", "root"), "members")
    by_list = _cost(members, "list")
    of_list = members.select("list", "family").distinct().join(by_list, "list")
    whole = _cost(members.select("id", "family", "root").distinct(), "family")
    split = of_list.groupBy("family").agg(F.sum("cost").alias("apart")).join(whole, "family").where("apart < cost").select("family")
    small = of_list.join(split, "family", "left_semi").select("list")
    return stored(members.join(small, "list", "left_semi").select("id", F.col("list").alias("family"))
                  .union(members.join(whole.join(split, "family", "left_anti"), "family", "left_semi").select("id", "family").distinct()), "units")


def _families(links: _Links, family: DataFrame) -> DataFrame:
    """Pairs that may link among sets of one unit of ``_units``, found block against block.

    Sets outside a family's main component meet all sets of the family, BLOCK by BLOCK,
    inside a task; only pairs whose sketches allow a link come out.
    """
    band = F.floor(F.ln("n") / BAND).cast("int")
    members = links.root(family, "id", "root")
    main = members.groupBy("family", "root").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("root", "k").alias("main"))
    members = stored(members.join(main, "family").join(links.sets.select("id", "n", "sketch"), "id")
                     .select("family", band.alias("band"), (F.col("root") != F.col("main")).alias("apart"), "id", "root", "n", "sketch"), "families")
    sizes = members.groupBy("family", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    packed, group = "family long, band int, block int, packed binary", ["family", "band", "block"]
    every = placed.groupBy(group).applyInArrow(_pack_members, packed)
    some = placed.where("apart").groupBy(group).applyInArrow(_pack_members, packed)
    # sets that may link are of one band of sizes or of neighbouring ones
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    some = (some.select("family", near, F.col("packed").alias("few")).join(sizes, ["family", "band"])
            .select("family", "band", "few", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    return stored(every.join(some, group).select("few", "packed").mapInArrow(_blocks_alike, "a long, b long").distinct(), "pairs")


def _pack_members(table: pa.Table) -> pa.Table:
    sketch = table["sketch"].combine_chunks()
    sizes = np.diff(np.frombuffer(sketch.buffers()[1], np.int32, count=len(sketch) + 1, offset=4 * sketch.offset)).astype(np.int32)
    value = bf.pack(*[table[c].to_numpy() for c in ("id", "root", "n")], sizes, np.frombuffer(b"".join(sketch.to_pylist()), np.uint8))
    return pa.table({**{c: table[c][:1] for c in ("family", "band", "block")}, "packed": pa.array([value], pa.binary())})


def _sketch_classes(value: bytes) -> list[tuple[np.ndarray, ...]]:
    """(ids, roots, sizes, sketches) by length of sketch."""
    ids, roots, n, sizes, flat = bf.unpack(value)
    begin = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        x = np.flatnonzero(sizes == size)
        out.append((ids[x], roots[x], n[x].astype(np.int64), flat[begin[x][:, None] + np.arange(size)].view(np.uint64)))
    return out


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def _blocks_alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for few, every in zip(batch.column("few").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            others = _sketch_classes(every)
            for ids, roots, n, own in _sketch_classes(few):
                for ids2, roots2, n2, theirs in others:
                    words = min(own.shape[1], theirs.shape[1])
                    if max(own.shape[1], theirs.shape[1]) > 2 * words:
                        continue  # sizes too far apart
                    x, y = _folded(own, words), _folded(theirs, words)
                    for i in range(len(ids)):
                        both = n[i] + n2
                        fits = (100 * np.minimum(n[i], n2) >= SIMILAR * np.maximum(n[i], n2)) & (roots2 != roots[i])
                        fits = np.flatnonzero(fits)
                        differ = np.bitwise_count(y[fits] ^ x[i]).sum(axis=1, dtype=np.int64)
                        ok = fits[differ <= both[fits] - 2 * -(-SIMILAR * both[fits] // (100 + SIMILAR))]
                        out_a.append(np.minimum(ids[i], ids2[ok]))
                        out_b.append(np.maximum(ids[i], ids2[ok]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(out_a)), "b": pa.array(np.concatenate(out_b))})


def _alike(a: str, b: str) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(SIMILAR) * F.greatest(a, b)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
link AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT y, root FROM r JOIN link ON x = id WHERE root < y)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY ALL
"""
