"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is coded bit by bit. For each of ORDERS a predictor looks up how often this bit
was 0 and 1 after the same last bytes (hashed into a table of fixed size) and gives the
logit of that; the logits are added with weights chosen by a gate, the bits of the byte
so far and the longest context known, and the sum is refined by an adaptive map from
(order-1 bits, probability) to the observed frequency. A text ends with a byte that
UTF-8 never has, so probabilities of texts sum to one.

All counts cover every training text: byte strings of SPAN bytes and words are counted
per task, exchanged and summed. A predictor sees only the last SPAN - 1 bytes, so
tables, weights and the map are learned from distinct strings with their counts,
each leaving itself out, and a chunk to score looks up each distinct string once.
Weights are learned online, string block by string block, each task on its own blocks,
and averaged between rounds.

Beside the model's score stands the unigram base. Counts of the at most 1 / COMMON
words with that share of all tokens go to every task; all other words go to the counts'
partitions, packed, and their sums back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

SPAN = 6
END = 255
ORDERS = (1, 2, 3, 4, 5)
SLOT_BITS = (16, 19, 20, 21, 21)
LOCAL_BYTES = 12 << 20
SCORE_BYTES = 4 << 20
COMMON = 1e-6
ROUNDS = 3
RATE = 0.02
BATCH = 512
TRAINERS = 64
LEVELS = 33
PRIOR = 0.4
_GRAM = np.uint64((1 << 48) - 1)
_ODD = bf._table(31, 8) | np.uint64(1)
END_TOKEN = np.uint64(0x0EAD)

BLOCKS = "bucket int, kind int, n long, v long, block binary"


# ---- strings -----------------------------------------------------------------------------

def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last SPAN bytes up to each byte of each text and its end, and where texts begin.

    Before a text stand zeros; the oldest byte is the highest.
    """
    n = np.diff(off)
    begin = off[:-1] + SPAN * np.arange(len(n))
    padded = np.zeros(len(data) + SPAN * len(n), np.uint8)
    inside = np.ones(len(padded), bool)
    for j in range(SPAN - 1):
        inside[begin + j] = False
    inside[begin + SPAN - 1 + n] = False
    padded[inside] = data
    padded[begin + SPAN - 1 + n] = END
    size = len(padded) - SPAN + 1
    out = np.zeros(size, np.uint64)
    for j in range(SPAN):
        out <<= np.uint64(8)
        out |= padded[j:j + size]
    # windows that reach into the next text
    keep = np.ones(len(padded), bool)
    for j in range(SPAN - 1):
        keep[begin + n + 1 + j] = False
    return out[keep[:size]], np.concatenate([[0], np.cumsum(n + 1)])


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often (or with which weight) each occurs."""
    if weights is None:
        keys = np.sort(keys)
        at = bf.groups(keys)
        return keys[at[:-1]], np.diff(at)
    o = np.argsort(keys)
    at = bf.groups(keys[o])
    total = np.append(0, np.cumsum(weights[o]))
    return keys[o][at[:-1]], total[at[1:]] - total[at[:-1]]


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and words before each text; END_TOKEN is no word's hash."""
    keys, at = bf.words(data, off)
    return np.where(keys == END_TOKEN, ~keys, keys), at


def _blocks(out: list, kind: int, keys: np.ndarray, counts: np.ndarray, where: np.ndarray, buckets: int) -> None:
    o, at = bf.by_bucket(where, buckets)
    counts = counts.astype(np.uint32) if len(counts) and counts.max() < 1 << 32 else counts
    for b in np.flatnonzero(np.diff(at)):
        x = o[at[b]:at[b + 1]]
        out.append((b, kind, 0, 0, bf.pack(keys[x], counts[x])))


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
        ["bucket", "kind", "n", "v", "block"])


def _gather(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_t, size = [], [], 0

        def flush():
            out: list = []
            for kind, held in ((0, held_g), (1, held_t)):
                keys = np.concatenate([k for k, _ in held])
                keys, n = counted(keys, np.concatenate([c for _, c in held]))
                # strings with the same last two context bytes meet in one place
                where = bf.spread(bf.mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)), buckets) if kind == 0 else bf.spread(keys, buckets)
                _blocks(out, kind, keys, n, where, buckets)
                held.clear()
            return _batch(out)

        for rows, data, off in bf.text_chunks(batches):
            held_g.append(counted(grams(data, off)[0]))
            words, _ = tokens(data, off)
            held_t.append(counted(np.append(words, np.full(rows.num_rows, END_TOKEN))))
            size += len(data)
            if size >= LOCAL_BYTES:
                yield flush()
                size = 0
        if held_g:
            yield flush()
    return run


def _add_up(table: pa.Table) -> pa.Table:
    bucket, out = table["bucket"][0].as_py(), []
    kinds = table["kind"].to_numpy()
    for kind in (0, 1):
        if (kinds == kind).any():
            keys, n = counted(*bf.unpack_all(table["block"].filter(pa.array(kinds == kind))))
            out.append((bucket, kind, int(n.sum()), len(keys), bf.pack(keys, n)))
    return pa.Table.from_batches([_batch(out)])


# ---- predictors --------------------------------------------------------------------------

def nodes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 8 bits of the last byte: the bits before each (with a leading one) and the bit."""
    last = (gram & np.uint64(255)).astype(np.int64)
    shift = np.arange(8)
    return (last[:, None] | 256) >> (8 - shift), (last[:, None] >> (7 - shift)) & 1


def slots(gram: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """Table places of the predictor ``k`` for each string and bit."""
    order = ORDERS[k]
    context = (gram >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    if SLOT_BITS[k] == 8 * order + 8:
        return (context.astype(np.int64)[:, None] << 8) | node
    base = bf.mix(context * _ODD[k] + np.uint64(order))
    return (((base[:, None] + node.astype(np.uint64) * _ODD[7]) * _ODD[6]) >> np.uint64(64 - SLOT_BITS[k])).astype(np.int64)


def _bit_counts(places: int):
    """Counts of zeros and ones by table place, from strings."""
    def run(table: pa.Table) -> pa.Table:
        gram, n = bf.unpack_all(table["block"])
        out: list = []
        for k in range(len(ORDERS)):
            parts = []
            for at in range(0, len(gram), 1 << 18):
                g, c = gram[at:at + (1 << 18)], n[at:at + (1 << 18)].astype(np.int64)
                node, bit = nodes(g)
                key = (slots(g, node, k) * 2 + bit).reshape(-1).astype(np.uint64)
                parts.append(counted(key, np.repeat(c, 8)))
            if parts:
                key, c = counted(*[np.concatenate(x) for x in zip(*parts, strict=True)])
                where = ((key >> np.uint64(1)) * np.uint64(places) >> np.uint64(SLOT_BITS[k])).astype(np.int64)
                _blocks(out, k, key, c, where, places)
        return pa.Table.from_batches([_batch(out)])
    return run


def _sum_bits(table: pa.Table) -> pa.Table:
    out: list = []
    kinds = table["kind"].to_numpy()
    for k in np.unique(kinds):
        key, n = counted(*bf.unpack_all(table["block"].filter(pa.array(kinds == k))))
        slot = key >> np.uint64(1)
        at = bf.groups(slot)
        pair = np.zeros((len(at) - 1, 2), np.int64)
        pair[np.repeat(np.arange(len(at) - 1), np.diff(at)), (key & np.uint64(1)).astype(np.int64)] = n
        # both counts of a slot shrink alike to fit 16 bits
        over = np.maximum(1, -(-pair.max(axis=1) // 65535)) if len(pair) else np.ones(0, np.int64)
        small = (pair + over[:, None] // 2) // over[:, None]
        out.append((0, int(k), 0, 0, bf.pack(slot[at[:-1]].astype(np.uint32), small[:, 0].astype(np.uint16), small[:, 1].astype(np.uint16))))
    return pa.Table.from_batches([_batch(out)])


_LOG = np.log(np.arange(65536) + PRIOR).astype(np.float32)


class Tables(list):
    """The predictors' counts; they travel compressed, as most places of a small corpus are empty."""

    def __reduce__(self):
        return _tables, ([zstandard.compress(t.T.tobytes(), 1) for t in self],)


def _tables(parts: list[bytes]) -> Tables:
    return Tables(np.frombuffer(zstandard.decompress(p), np.uint16).reshape(2, -1).T.copy() for p in parts)


class Model:
    """Tables of bit counts, mixing weights and the refining map."""

    def __init__(self, tables: Tables, weights: np.ndarray | None = None, refining: np.ndarray | None = None):
        self.tables, self.map = tables, refining
        self.weights = np.full((256 * (len(ORDERS) + 1), len(ORDERS)), 0.35, np.float32) if weights is None else weights

    def logits(self, gram: np.ndarray, leave_out: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (predictor, string * 8 bits), gate and bit."""
        node, bit = nodes(gram)
        node, bit = node.reshape(-1), bit.reshape(-1)
        x = np.empty((len(ORDERS), len(node)), np.float32)
        known = np.zeros(len(node), np.int64)
        for k in range(len(ORDERS)):
            pair = self.tables[k][slots(gram, node.reshape(-1, 8), k).reshape(-1)]
            zero, one = pair[:, 0], pair[:, 1]
            if leave_out:
                one = one - ((bit == 1) & (one > 0))
                zero = zero - ((bit == 0) & (zero > 0))
            x[k] = _LOG[one] - _LOG[zero]
            known += (zero > 0) | (one > 0)
        return x, node * (len(ORDERS) + 1) + known, bit

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights[gate].T).sum(axis=0), -11, 11)

    def level(self, gram: np.ndarray, gate: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the map (lower of two neighbours) and how far to the upper."""
        at = (z + 11) * ((LEVELS - 1) / 22)
        low = np.minimum(at.astype(np.int64), LEVELS - 2)
        return gate * LEVELS + low, at - low

    def refined(self, gram: np.ndarray, gate: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Probability of a one."""
        p = 1 / (1 + np.exp(-z))
        if self.map is not None:
            low, part = self.level(gram, gate, z)
            p = (p + self.map[low] * (1 - part) + self.map[low + 1] * part) / 2
        return np.clip(p, 2 ** -16, 1 - 2 ** -16)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each string."""
        out = np.empty(len(gram))
        for at in range(0, len(gram), 1 << 15):
            g = gram[at:at + (1 << 15)]
            x, gate, bit = self.logits(g)
            p = self.refined(g, gate, self.mixed(x, gate))
            out[at:at + len(g)] = -np.log2(np.where(bit == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)
        return out


def _learn(tables, weights: np.ndarray):
    """One online pass over a task's strings: (gate weights times mass, mass) in one block."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mass, any_ = None, None, False
        for batch in batches:
            for value in batch.column("block"):
                if m is None:
                    m = Model(tables.value, weights.copy())
                    mass = np.zeros(len(m.weights))
                gram, n = bf.unpack(value.as_buffer().to_pybytes())
                order = np.random.default_rng(7).permutation(len(gram))
                for at in range(0, len(gram), 1 << 14):
                    take = order[at:at + (1 << 14)]
                    x, gate, bit = m.logits(gram[take], True)
                    c = np.repeat(n[take].astype(np.float64), 8)
                    for s in range(0, len(gate), BATCH * 8):
                        e = slice(s, s + BATCH * 8)
                        err = (bit[e] - 1 / (1 + np.exp(-m.mixed(x[:, e], gate[e])))) * c[e]
                        per = np.bincount(gate[e], c[e], len(m.weights))
                        scale = RATE / np.maximum(per, 1e-9)
                        for k in range(len(ORDERS)):
                            m.weights[:, k] += (np.bincount(gate[e], err * x[k, e], len(m.weights)) * scale).astype(np.float32)
                        mass += per
                any_ = True
        if any_:
            yield _batch([(0, 0, 0, 0, bf.pack((m.weights * mass[:, None]).reshape(-1).astype(np.float64), mass))])
    return run


def _observe(tables, weights: np.ndarray):
    """Counts of bits and ones at each place of the refining map."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column("block"):
                m = Model(tables.value, weights)
                gram, n = bf.unpack(value.as_buffer().to_pybytes())
                if total is None:
                    total = np.zeros((2, len(m.weights) * LEVELS))
                for at in range(0, len(gram), 1 << 15):
                    g = gram[at:at + (1 << 15)]
                    x, gate, bit = m.logits(g, True)
                    low, part = m.level(g, gate, m.mixed(x, gate))
                    c = np.repeat(n[at:at + (1 << 15)].astype(np.float64), 8)
                    for place, share in ((low, 1 - part), (low + 1, part)):
                        total[0] += np.bincount(place, c * share, total.shape[1])
                        total[1] += np.bincount(place, c * share * bit, total.shape[1])
        if total is not None:
            used = np.flatnonzero(total[0])
            yield _batch([(0, 0, 0, 0, bf.pack(used.astype(np.uint32), total[0][used], total[1][used]))])
    return run


def train(strings: DataFrame) -> tuple[object, np.ndarray, np.ndarray]:
    """(broadcast tables, weights, refining map) from blocks of distinct strings with counts.

    The driver receives tables of fixed size, and per round one set of weights from each task.
    """
    spark = strings.sparkSession
    buckets = bf.bucket_count(spark, 1)
    tables = Tables(np.zeros((1 << b, 2), np.uint16) for b in SLOT_BITS)
    rows = (strings.groupBy("bucket").applyInArrow(_bit_counts(buckets), BLOCKS)
            .groupBy("bucket").applyInArrow(_sum_bits, BLOCKS).select("kind", "block"))
    for row in rows.toLocalIterator():
        slot, zero, one = bf.unpack(bytes(row.block))
        tables[row.kind][slot, 0], tables[row.kind][slot, 1] = zero, one
    model = Model(tables)
    sent = spark.sparkContext.broadcast(tables)
    few = strings.coalesce(TRAINERS)
    for _ in range(ROUNDS):
        top, below = 0.0, 0.0
        for row in few.mapInArrow(_learn(sent, model.weights), BLOCKS).select("block").collect():
            w, mass = bf.unpack(bytes(row.block))
            top, below = top + w.reshape(model.weights.shape), below + mass
        if np.any(below):
            model.weights = np.where(below[:, None] > 0, top / np.maximum(below, 1e-9)[:, None], model.weights).astype(np.float32)
    seen, ones = np.zeros(len(model.weights) * LEVELS), np.zeros(len(model.weights) * LEVELS)
    for row in few.mapInArrow(_observe(sent, model.weights), BLOCKS).select("block").collect():
        at, n, n1 = bf.unpack(bytes(row.block))
        seen[at] += n
        ones[at] += n1
    start = 1 / (1 + np.exp(-np.tile(np.linspace(-11, 11, LEVELS), len(model.weights))))
    return sent, model.weights, (ones + 16 * start) / (seen + 16)


# ---- scoring -----------------------------------------------------------------------------

def _score(tables, weights: np.ndarray, refining: np.ndarray, common, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (top, counts) = Model(tables.value, weights, refining), common.value
        logs = np.log10(counts + 0.1)
        table_bits = 22
        # large chunks, as each distinct string of one is coded once
        for rows, data, off in bf.text_chunks(batches, limit=SCORE_BYTES):
            ids = bf.longs(rows, "doc_id")
            gram, at = grams(data, off)
            distinct = counted(gram)[0]
            bits = m.bits(distinct)
            # one probe per byte; strings that share a place are looked up by search
            place = lambda g: ((g * _ODD[5]) >> np.uint64(64 - table_bits)).astype(np.int64)
            owner, length = np.zeros(1 << table_bits, np.int32), np.empty(len(gram), np.float32)
            owner[place(distinct)] = np.arange(len(distinct))
            for s in range(0, len(gram), 1 << 19):
                g = gram[s:s + (1 << 19)]
                index = owner[place(g)]
                missed = np.flatnonzero(distinct[index] != g)
                index[missed] = np.searchsorted(distinct, g[missed])
                length[s:s + len(g)] = bits[index]
            score = -np.add.reduceat(length, at[:-1], dtype=np.float64) * np.log10(2)
            del gram, owner, length

            words, w = tokens(data, off)
            owner_doc = np.repeat(np.arange(rows.num_rows), np.diff(w))
            words = np.append(words, np.full(rows.num_rows, END_TOKEN))
            owner_doc = np.append(owner_doc, np.arange(rows.num_rows))
            hit = np.minimum(np.searchsorted(top, words), max(len(top) - 1, 0))
            is_top = top[hit] == words if len(top) else np.zeros(len(words), bool)
            base = np.bincount(owner_doc[is_top], logs[hit[is_top]], rows.num_rows)
            known = np.bincount(owner_doc[is_top], minlength=rows.num_rows)
            out: list = []
            o, b = bf.by_bucket(ids % buckets, buckets)
            facts = (ids, np.diff(w) + 1, known, base, score, np.diff(off))
            rare, rare_doc = words[~is_top], ids[owner_doc[~is_top]]
            order = np.lexsort((rare_doc, rare))
            rare, rare_doc = rare[order], rare_doc[order]
            g = bf.groups(rare, rare_doc)
            rare, rare_doc, times = rare[g[:-1]], rare_doc[g[:-1]], np.diff(g).astype(np.uint32)
            o2, b2 = bf.by_bucket(bf.spread(rare, buckets), buckets)
            for k in np.flatnonzero((np.diff(b) > 0) | (np.diff(b2) > 0)):
                x, y = o[b[k]:b[k + 1]], o2[b2[k]:b2[k + 1]]
                out.append((k, 0, 0, 0, bf.pack(*[f[x] for f in facts], rare[y], rare_doc[y], times[y])))
            yield _batch(out)
    return run


def _look_up(buckets: int):
    """Rare words meet their counts; sums leave for their documents' buckets."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_batch([])])
        *facts, rare, doc, times = bf.unpack_all(left["block"])
        keys, counts = bf.unpack_all(right["block"]) if right.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        hit = np.minimum(np.searchsorted(keys, rare), max(len(keys) - 1, 0))
        there = keys[hit] == rare if len(keys) else np.zeros(len(rare), bool)
        c = np.where(there, counts[hit], 0) if len(keys) else np.zeros(len(rare), np.int64)
        o = np.argsort(doc)
        at = bf.groups(doc[o])
        known = np.append(0, np.cumsum((times * there)[o]))
        base = np.append(0, np.cumsum((times * np.log10(c + 0.1))[o]))
        d, known, base = doc[o][at[:-1]], known[at[1:]] - known[at[:-1]], base[at[1:]] - base[at[:-1]]
        ids, n, k0, b0, score, size = facts
        z = np.zeros(len(d))
        everything = [np.append(ids, d), np.append(n, z.astype(np.int64)), np.append(k0, known).astype(np.int64),
                      np.append(b0, base), np.append(score, z), np.append(size, z.astype(np.int64))]
        out: list = []
        o, at = bf.by_bucket(everything[0] % buckets, buckets)
        for b in np.flatnonzero(np.diff(at)):
            x = o[at[b]:at[b + 1]]
            out.append((b, 0, 0, 0, bf.pack(*[a[x] for a in everything])))
        return pa.Table.from_batches([_batch(out)])
    return run


def _sum_up(table: pa.Table) -> pa.Table:
    ids, n, known, base, score, size = bf.unpack_all(table["block"])
    o = np.argsort(ids, kind="stable")
    at = bf.groups(ids[o])
    s = lambda a: np.add.reduceat(a[o], at[:-1])
    return pa.table({"doc_id": ids[o][at[:-1]], "n_tokens": s(n), "n_known": s(known), "base": s(base), "score": s(score), "n_bytes": s(size)})


def _common_words(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("block"):
                keys, n = bf.unpack(value.as_buffer().to_pybytes())
                often = n >= least
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[often].view(np.int64)), "n": pa.array(n[often].astype(np.int64))})
    return run


def score_texts(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte.

    Documents whose crc32(doc_id as text) is no multiple of ``folds`` are learned from;
    all are scored. ``docs`` needs doc_id and text; other columns are ignored. A null
    text is empty: its score is that of ending at once, its bits per byte are null. Of
    rows that repeat a doc_id the one with the smallest text counts, once. Rows without
    doc_id are held out, each text scored once. An empty table gives no rows; with
    nothing to learn from the base score is 0 and the model predicts each bit evenly.
    """
    spark = docs.sparkSession
    docs = bf.one_per_id(docs.select("doc_id", "text"), "doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), bf.whole_text())
    buckets = bf.bucket_count(spark, 1)
    learned = (keyed.where(crc % folds != 0).mapInArrow(_gather(buckets), BLOCKS).groupBy("bucket").applyInArrow(_add_up, BLOCKS))
    counts = stored(learned, "counts")
    strings, vocabulary = counts.where("kind = 0"), counts.where("kind = 1")
    total = vocabulary.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = total.n or 0, total.v or 0
    top = vocabulary.mapInArrow(_common_words(max(1.0, COMMON * n)), "key long, n long").toArrow()
    keys = top["key"].to_numpy().view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    common = spark.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order]))
    model = train(strings)

    def scored(rows: DataFrame) -> DataFrame:
        return (rows.mapInArrow(_score(*model, common, buckets), BLOCKS).groupBy("bucket")
                .cogroup(vocabulary.groupBy("bucket")).applyInArrow(_look_up(buckets), BLOCKS)
                .groupBy("bucket").applyInArrow(
                    _sum_up, "doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long"))

    out = scored(keyed)
    loose = docs.where(F.col("doc_id").isNull()).select(F.xxhash64(bf.whole_text()).alias("doc_id"), bf.whole_text())
    if not loose.isEmpty():
        out = out.unionByName(scored(loose.dropDuplicates(["doc_id"])).withColumn("doc_id", F.lit(None).cast("long")))
    norm = float(np.log10(n + 0.1 * (v + 1)))
    return out.select(
        "doc_id", (crc % folds == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score", "n_bytes",
        F.when(F.col("n_bytes") > 0, F.col("score") / F.lit(-float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"))
