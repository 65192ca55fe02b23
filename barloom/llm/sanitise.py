"""Personal data and the terms that give it away.

Base spans are e-mail addresses, IP numbers, card and phone numbers. The method adds
terms: a corpus-wide count tells how strongly a word near a protected value reveals
that value. With D documents, n(v) of them holding value v, n(t) holding term t and
n(v, t) holding t within WINDOW words of v, the information t discloses about v is
    PMI(v; t) = log2(n(v, t) * D / (n(v) * n(t)))
out of IC(v) = log2(D / n(v)). From RISK of IC(v) on a term is generalised (to its shape:
number, name or word), from all of it on it is removed, where v and t were seen together
in at least SUPPORT documents, as rarer company is no evidence. Such a term goes wherever
it stands, in documents without the value too, as it tells of the value there as well;
of several values' verdicts on a term the strictest counts.

Three passes over the texts: values with their neighbours (few rows), the document counts
of all words, summed per stretch of a task before the exchange, and the places of terms:
a bit set of fixed size tells which words may be one, and only these are joined with them.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

bf.lean_memory()  # in every worker that runs these tasks

KINDS = ("email", "ip", "card", "phone")
TERMS = ("term_general", "term_removed")
WINDOW = 8
SUPPORT = 3
RISK = 0.85
LOCAL_BYTES = 16 << 20
FILTER_BITS = 26

# The patterns of the base spans. An address is found from its @.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = regex.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

FOUND = ("rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<s:int,k:int,e:int>>, "
         "hits array<struct<t:long,s:int,e:int>>")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each base span, by start then kind; positions are code points."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _key(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _value(text: str, span: tuple[int, int, int]) -> int:
    s, k, e = span
    value = text[s:e].lower()
    return _key(f"{k}:{value}" if k < 2 else f"{k}:{re.sub('[^0-9]', '', value)}")


def _trim(text: str, s: int, e: int) -> tuple[int, int]:
    """A word without the ASCII marks around it."""
    while s < e and text[s] < "\x80" and not text[s].isalnum():
        s += 1
    while e > s and text[e - 1] < "\x80" and not text[e - 1].isalnum():
        e -= 1
    return s, e


def _free(spans: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch of the text has no part in any of the sorted spans."""
    starts, reach = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or reach[k - 1] <= a
    return free


def neighbours(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(value, term, start, end) of the words within WINDOW words of each value, other than values themselves."""
    starts, ends, free, near = array("q"), array("q"), _free(spans), []
    for m in WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    for span in spans:
        v, (s, _, e) = _value(text, span), span
        i, j = bisect_left(starts, s), bisect_right(ends, e)
        before = [(starts[x], min(ends[x], s)) for x in range(max(0, i - WINDOW), i)]
        after = [(max(starts[x], e), ends[x]) for x in range(j, min(j + WINDOW, len(ends)))]
        for a, b in before + after:
            a, b = _trim(text, a, b)
            if b > a and free(a, b):
                near.append((v, a, b))
    terms = _terms([text[a:b] for _, a, b in near])
    return [(v, t, a, b) for (v, a, b), t in zip(near, terms, strict=True)]


def _terms(words: list[str]) -> list[int]:
    words = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    return bf.range_hashes(bf.LOWER[data], np.append(0, ends)[:-1], ends).view(np.int64).tolist()


_MAYBE = np.zeros(256, bool)
_MAYBE[[ord(c) for c in "@0123456789"]] = True


def _spans_of(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """(text, base spans) of each text of a chunk; texts that cannot have any are not looked at."""
    some = np.append(0, np.cumsum(_MAYBE[data]))
    some = some[off[1:]] > some[off[:-1]]
    texts = rows.column("text")
    for i, maybe in enumerate(some.tolist()):
        text = texts[i].as_py() if maybe else ""
        yield text, base_spans(text)


def _find_near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("v", pa.int64()), ("t", pa.int64())]))
    for rows, data, off in bf.text_chunks(batches):
        near = [[{"v": v, "t": t} for v, t in {x[:2] for x in neighbours(text, spans)}] if spans else [] for text, spans in _spans_of(rows, data, off)]
        yield pa.RecordBatch.from_arrays([rows.column("rid"), pa.array(near, kind)], ["rid", "near"])


_EDGE = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def text_terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, start and end (bytes) of each word of a chunk, without ASCII marks around it."""
    starts, ends, at = bf.word_bounds(data, off)
    solid = np.flatnonzero(_EDGE[data])
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    keep = first <= last
    owner = np.repeat(np.arange(len(off) - 1), np.diff(at))[keep]
    starts, ends = solid[first[keep]], solid[last[keep]] + 1
    return bf.range_hashes(bf.LOWER[data], starts, ends), owner, starts, ends


def document_terms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashes of the distinct words of each text of a chunk, without ASCII marks around them."""
    keys, owner, _, _ = text_terms(data, off)
    o = np.lexsort((keys, owner))
    return keys[o][bf.groups(owner[o], keys[o])[:-1]]


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each term in the bit set."""
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in batches:
        for p in _bits(bf.longs(batch, "t").view(np.uint64)):
            np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_pydict({"at": pa.array(np.flatnonzero(bits)), "bits": pa.array(bits[bits > 0].astype(np.int32))})


def _structs(parts: list[np.ndarray], kind: pa.ListType) -> pa.ListArray:
    """One list of structs for each array of rows."""
    flat = np.concatenate(parts)
    fields = [pa.array(np.ascontiguousarray(flat[:, i]), f.type, safe=False) for i, f in enumerate(kind.value_type)]
    at = np.cumsum([0, *[len(x) for x in parts]])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)), type=kind)


def _find(marked):
    """Base spans, and the places of words that may be risky terms."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS],
                        ("base", pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))),
                        ("hits", pa.list_(pa.struct([("t", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        np.bitwise_or.at(bits, marked.value[0], marked.value[1])

        def maybe(keys: np.ndarray) -> np.ndarray:
            p, q = _bits(keys)
            return (bits[p >> 3] >> (p & 7)) & (bits[q >> 3] >> (q & 7)) & 1 > 0

        for rows, data, off in bf.text_chunks(batches):
            keys, owner, starts, ends = text_terms(data, off)
            hit = maybe(keys)
            keys, owner, starts, ends = keys[hit].view(np.int64), owner[hit], starts[hit], ends[hit]
            # places are code points
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            starts, ends = (points[x] - points[off[owner]] for x in (starts, ends))
            at = np.searchsorted(owner, np.arange(len(off)))
            base, hits = [], []  # per text: rows of (s, k, e) and of (t, s, e)
            for i, (text, spans) in enumerate(_spans_of(rows, data, off)):
                found = np.stack([x[at[i]:at[i + 1]] for x in (keys, starts, ends)], axis=1)
                if spans:
                    # words cut by values are terms too
                    free, near = _free(spans), neighbours(text, spans)
                    likely = maybe(np.array([x[1] for x in near], np.int64).view(np.uint64)).tolist()
                    some = {tuple(x) for x in found.tolist() if free(x[1], x[2])} | {x[1:] for x, y in zip(near, likely, strict=True) if y}
                    found = np.array(sorted(some), np.int64).reshape(-1, 3)
                base.append(np.array(spans, np.int32).reshape(-1, 3))
                hits.append(found)
            counts = [[int((b[:, 1] == k).sum()) for b in base] for k in range(4)]
            yield pa.RecordBatch.from_arrays([rows.column("rid"), rows.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                                              _structs(base, schema.field("base").type), _structs(hits, schema.field("hits").type)], schema=schema)
    return run


def _count_terms(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            keys = np.sort(np.concatenate(held))
            at = bf.groups(keys)
            keys, n = keys[at[:-1]], np.diff(at).astype(np.uint32)
            o, b = bf.by_bucket(bf.spread(keys, buckets), buckets)
            used = np.flatnonzero(np.diff(b))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "block": pa.array(
                [bf.pack(keys[o[b[k]:b[k + 1]]], n[o[b[k]:b[k + 1]]]) for k in used], pa.binary())})

        for _, data, off in bf.text_chunks(batches):
            held.append(document_terms(data, off))
            size += len(data)
            if size >= LOCAL_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    return run


def _bucket_of(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("t").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_pydict({"t": batch.column("t"), "bucket": pa.array(bf.spread(keys, buckets).astype(np.int32))})
    return run


def _take_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return pa.table({"t": pa.array([], pa.int64()), "nt": pa.array([], pa.int64())})
    wanted = left["t"].to_numpy().view(np.uint64)
    keys, n = bf.unpack_all(right["block"]) if right.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    o = np.argsort(keys)
    total = np.append(0, np.cumsum(n[o], dtype=np.int64))
    keys = keys[o]
    n = total[np.searchsorted(keys, wanted, side="right")] - total[np.searchsorted(keys, wanted)]
    return pa.table({"t": left["t"].combine_chunks(), "nt": pa.array(n)})


def find(docs: DataFrame) -> DataFrame:
    """Per row: rid, doc_id, counts, base spans, and ``terms``: the places of disclosing words."""
    spark = docs.sparkSession
    buckets = bf.bucket_count(spark, 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bf.whole_text())
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    company = stored(numbered.select("rid", "text").mapInArrow(_find_near, "rid long, near array<struct<v:long,t:long>>"), "near")
    near = company.select("rid", F.explode("near").alias("x")).select("rid", "x.*")
    # a row's pairs are distinct already
    pairs = near.groupBy("v", "t").agg(F.count("*").alias("nvt")).where(f"nvt >= {SUPPORT}")
    values = near.select("rid", "v").distinct().groupBy("v").agg(F.count("*").alias("nv"))
    pairs = stored(pairs.join(values, "v"), "company")
    terms = pairs.select("t").distinct().mapInArrow(_bucket_of(buckets), "t long, bucket int")
    counts = rows.select("text").mapInArrow(_count_terms(buckets), "bucket int, block binary")
    known = terms.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_take_counts, "t long, nt long")
    total = F.lit(float(max(1, company.count())))
    pmi = F.log2(F.col("nvt") * total / (F.col("nv") * F.greatest("nt", "nvt")))
    ic = F.log2(total / F.col("nv"))
    risky = (pairs.join(known, "t").withColumn("pmi", pmi).withColumn("ic", ic)
             .where((F.col("ic") > 0) & (F.col("pmi") >= RISK * F.col("ic")))
             .groupBy("t").agg(F.max(F.when(F.col("pmi") >= F.col("ic"), 5).otherwise(4)).alias("k")))
    risky = stored(risky, "terms")
    filter_ = risky.select("t").coalesce(16).mapInArrow(_mark, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    marked = spark.sparkContext.broadcast((filter_["at"].to_numpy(), filter_["bits"].to_numpy().astype(np.uint8)))
    found = stored(numbered.mapInArrow(_find(marked), FOUND), "values")
    marked.unpersist()
    spans = (found.select("rid", F.explode("hits").alias("x")).select("rid", "x.*").join(risky, "t").groupBy("rid")
             .agg(F.collect_list(F.struct("s", "k", "e")).alias("terms")))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return found.drop("hits").join(spans, "rid", "left").withColumn("terms", F.coalesce("terms", none))


def _written(spans: str):
    kinds = F.array([F.lit(k) for k in (*KINDS, *TERMS)])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x.k), x.s.cast("string"), x.e.cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts have
    no spans. Rows stand for themselves: repeated rows and rows without doc_id each get
    their own result and count as documents of their own. Equal words or values of
    several documents tie as one. An empty table gives no rows.
    """
    return find(docs).select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_written("base"), 256).alias("base_sha256"),
        _written(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans replaced; of overlapping ones the earlier or longer counts first."""
    out, at = [], 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2])):
        if e <= at:
            continue
        s = max(s, at)
        out.append(text[at:s])
        if k < 4:
            out.append(f"[{KINDS[k]}]")
        elif k == 4:
            word = text[s:e]
            out.append("[number]" if any(c.isdigit() for c in word) else "[name]" if word[:1].isupper() else "[word]")
        at = e
    out.append(text[at:])
    return "".join(out)


def _replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, spans = batch.schema.get_field_index("text"), batch.column("__llm_spans")
        texts = [t if not p else clean(t, [(x["s"], x["k"], x["e"]) for x in p])
                 for t, p in zip(batch.column("text").to_pylist(), spans.to_pylist(), strict=True)]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).drop_columns(["__llm_spans"])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with base values replaced by their kind, disclosing terms
    generalised or removed. Rows are matched by doc_id: where a doc_id is repeated or
    missing, a row takes the spans found in a row of the same text."""
    key = F.xxhash64(bf.whole_text())
    rows = docs.select("doc_id", "text")
    found = find(rows.select("doc_id", "text").withColumn("doc_id", key)).where("size(base) + size(terms) > 0")
    spans = found.groupBy(F.col("doc_id").alias("__llm_key")).agg(F.max(F.concat("base", "terms")).alias("__llm_spans"))
    joined = docs.withColumn("__llm_key", key).join(spans.hint("merge"), "__llm_key", "left").drop("__llm_key")
    return joined.mapInArrow(_replace, docs.schema)
