"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes when a string of ``length`` bytes that covers it also starts earlier in
the corpus (smaller doc_id, or earlier in the same document). LPF[i] is the length of
the longest string at i that also starts at an earlier position. Of all earlier positions
the previous and the next one of smaller position in suffix order share most with i, so
LPF[i] is the greater of two common prefixes (counted up to ``length``), and a window
goes where it is ``length``.

One suffix array of a corpus fits no task, so it is built in parts that cannot miss a
match. Every window of ``length`` bytes is filed under the least hash of its inner
``INNER``-byte strings, a key that depends on the window's bytes alone: equal windows
share a key. Neighbouring windows with one key form a piece. Pieces that are equal as
a whole need no sorting between them (the first is the dictionary entry, later ones are
its copies); where a key has several different pieces, or a piece repeats its key inside,
the suffixes of the entries are sorted and LPF is read off. A key of more than ``HOT``
different pieces (a phrase in very many surroundings) is filed again under a second key,
the least of other hashes of the same inner strings, and copies within a chunk go there
and then, so no task gets all texts that hold one phrase.

Shuffles: keys of pieces (about 22 bytes per 35 bytes of text, copies within a chunk
combined before), the text of documents that need sorting, and their pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barloom.llm import buffers as bf
from barloom.llm.stored import stored

LENGTH = 100
INNER = 32
LONGEST_PIECE = 128
HOT = 4096
BLOCK = 64
_OTHER = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = bf._table(21, 16) | np.uint64(1)

FOUND = "doc_id long, detail boolean, start long, size long, code long, hot boolean"
SPANS = "doc_id long, start long, size long"
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def inner_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the INNER bytes at each position."""
    n = len(data) - INNER + 1
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data),), "<u8", padded, 0, (1,)).astype(np.uint64)
    h = eight[:n] * _WEIGHTS[0]
    for j in range(1, INNER // 8):
        h += eight[8 * j:8 * j + n] * _WEIGHTS[j]
    h ^= h >> np.uint64(29)
    h *= _WEIGHTS[9]
    h ^= h >> np.uint64(32)
    return h


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` entries."""
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:len(h) - (width - step)], h[width - step:]) if width > step else h


def piece_codes(h: np.ndarray, edges: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """What stands for all bytes of the pieces at ``edges``, from the hashes ``h`` of inner strings."""
    size = windows + LENGTH - 1
    code = size.astype(np.uint64) * _WEIGHTS[10] + h[edges + size - INNER] * _WEIGHTS[11]
    for j in range((LONGEST_PIECE + LENGTH - 1) // INNER):
        at = np.flatnonzero(size >= (j + 1) * INNER)
        code[at] += h[edges[at] + j * INNER] * (_WEIGHTS[j] ^ np.uint64(0x5555555555555554))
    return bf.mix(code)


def cut_pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, key, code, whether its key may be met twice inside) of
    each piece; code stands for all its bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    h = inner_hashes(data)
    key = least_of(h, LENGTH - INNER + 1)
    valid = np.zeros(len(key) + 1, np.int64)
    lengths = np.diff(off)
    long = np.flatnonzero(lengths >= LENGTH)
    first, last = off[long], off[long + 1] - LENGTH
    np.add.at(valid, first, 1)
    np.add.at(valid, last + 1, -1)
    inside = np.cumsum(valid)[:-1] > 0
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new[first] = True
    edges = np.flatnonzero(new & inside)
    text = np.searchsorted(off, edges, side="right") - 1
    ends = np.append(edges[1:], 0)
    same = np.append(text[1:] == text[:-1], False)
    windows = np.where(same, ends, off[text + 1] - LENGTH + 1) - edges
    parts = -(-windows // LONGEST_PIECE)
    if len(parts) and parts.max() > 1:
        again = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        edges = np.repeat(edges, parts) + again * LONGEST_PIECE
        windows = np.minimum(np.repeat(windows, parts) - again * LONGEST_PIECE, LONGEST_PIECE)
        text = np.repeat(text, parts)
    code = piece_codes(h, edges, windows)
    # positions that are the least of a window; the same value at two of them in a row
    width = LENGTH - INNER + 1
    around = np.concatenate([np.zeros(width - 1, np.uint64), key, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(h == ~least_of(~around, width))
    again = (h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) < LONGEST_PIECE + width)
    twice = np.isin(key[edges], np.unique(h[chosen[:-1][again]])) if again.any() else np.zeros(len(edges), bool)
    return text, edges - off[text], windows, key[edges], code, twice


def _cut(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in bf.text_chunks(batches):
            ids = bf.longs(rows, "doc_id")
            text, start, windows, key, code, twice = cut_pieces(data, off)
            if not len(text):
                continue
            doc = ids[text]
            order = np.lexsort((start, doc, code, key))
            key, code, doc, start, windows, twice = (a[order] for a in (key, code, doc, start, windows, twice))
            copy = np.zeros(len(key), bool)
            copy[1:] = (key[1:] == key[:-1]) & (code[1:] == code[:-1])
            first = ~copy
            bucket = bf.spread(key[first], buckets)
            o, at = bf.by_bucket(bucket, buckets)
            kept = [a[first][o] for a in (key, code, doc, start.astype(np.int32), (windows - 1 + 128 * twice).astype(np.uint8))]
            gone_doc, gone_at, gone_size = merged(doc[copy], start[copy], windows[copy] + LENGTH - 1)
            o2, at2 = bf.by_bucket(bf.spread(bf.mix(gone_doc.view(np.uint64)), buckets), buckets)
            gone = [gone_doc[o2], gone_at[o2].astype(np.int32), gone_size[o2].astype(np.int32)]
            used = np.flatnonzero((np.diff(at) > 0) | (np.diff(at2) > 0))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(used, pa.int32()),
                "block": pa.array([bf.pack(*[a[at[b]:at[b + 1]] for a in kept], *[a[at2[b]:at2[b + 1]] for a in gone]) for b in used], pa.binary())})
    return run


def merged(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a document joined."""
    if not len(doc):
        return doc, start, size
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], (start + size)[o]
    # ends so far, kept apart by document
    rank = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * far)
    new = np.append(True, (start + rank * far)[1:] > reach[:-1])
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (reach - rank * far)[last] - start[at]


def _match(hot_pieces: int):
    """Of each key met twice or more: later copies of an equal piece go, differing first pieces need sorting."""
    def run(table: pa.Table) -> pa.Table:
        key, code, doc, start, windows, gone_doc, gone_at, gone_size = bf.unpack_all(table["block"])
        twice, windows = windows >= 128, (windows & 127).astype(np.int64) + 1
        o = np.argsort(key)
        at = bf.groups(key[o])
        several = np.repeat(np.diff(at) > 1, np.diff(at))
        o = o[several | twice[o]]
        o = o[np.lexsort((start[o], doc[o], code[o], key[o]))]
        key, code, doc, start, windows, twice = (a[o] for a in (key, code, doc, start, windows, twice))
        copy = np.zeros(len(key), bool)
        copy[1:] = (key[1:] == key[:-1]) & (code[1:] == code[:-1])
        firsts = np.flatnonzero(~copy)
        at = bf.groups(key[firsts])
        several = np.repeat(np.diff(at), np.diff(at))
        sorts = (several > 1) | twice[firsts]
        differ, hot = firsts[sorts], several[sorts] > hot_pieces
        cd, cs, cz = merged(np.append(doc[copy], gone_doc), np.append(start[copy], gone_at).astype(np.int64),
                            np.append(windows[copy] + LENGTH - 1, gone_size))
        n, m = len(cd), len(differ)
        return pa.table({"doc_id": np.append(cd, doc[differ]), "detail": np.append(np.zeros(n, bool), np.ones(m, bool)),
                         "start": np.append(cs, start[differ]), "size": np.append(cz, windows[differ]),
                         "code": np.append(np.zeros(n, np.int64), key[differ].view(np.int64)),
                         "hot": np.append(np.zeros(n, bool), hot)})
    return run


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Lengths of a list column (nulls are empty) and its flat fields."""
    col = batch.column(name)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    flat = col.flatten()
    return sizes, {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def cut_again(h: np.ndarray, begin: np.ndarray, windows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, windows before it in the piece, windows, key) of the parts of pieces whose windows
    share a second key too; equal windows of one key share both."""
    second = least_of(bf.mix(h ^ _OTHER), LENGTH - INNER + 1)
    piece = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    k = second[begin[piece] + within]
    at = bf.groups(piece, k)
    first = at[:-1]
    return piece[first], within[first], np.diff(at), bf.mix(key[piece[first]] ^ bf.mix(k[first]))


def _fetch(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in bf.text_chunks(batches):
            sizes, f = _lists(rows, "pieces")
            text = np.repeat(np.arange(len(sizes)), sizes)
            doc, start, windows = bf.longs(rows, "doc_id")[text], f["start"], f["size"]
            key, hot = f["code"].view(np.uint64), f["hot"].astype(bool)
            gone = [np.zeros(0, np.int64)] * 3
            if hot.any():
                h, x = inner_hashes(data), np.flatnonzero(hot)
                piece, before, parts, again = cut_again(h, (off[text] + start)[x], windows[x], key[x])
                d, t, b = doc[x][piece], start[x][piece] + before, text[x][piece]
                code = piece_codes(h, off[b] + t, parts)
                o = np.lexsort((t, d, code, again))
                copy = np.zeros(len(o), bool)
                copy[1:] = (again[o][1:] == again[o][:-1]) & (code[o][1:] == code[o][:-1])
                gone = merged(d[o[copy]], t[o[copy]], parts[o[copy]] + LENGTH - 1)
                first = o[~copy]
                doc, start, windows, key, text = (np.append(a[~hot], c[first]) for a, c in (
                    (doc, d), (start, t), (windows, parts), (key, again), (text, b)))
            begin, size = off[text] + start, windows + LENGTH - 1
            o, at = bf.by_bucket(bf.spread(key, buckets), buckets)
            o2, at2 = bf.by_bucket(bf.spread(bf.mix(gone[0].view(np.uint64)), buckets), buckets)
            blocks, used = [], np.flatnonzero((np.diff(at) > 0) | (np.diff(at2) > 0))
            for b in used:
                x, y = o[at[b]:at[b + 1]], o2[at2[b]:at2[b + 1]]
                s = size[x]
                from_ = np.repeat(begin[x] - np.cumsum(s) + s, s) + np.arange(s.sum())
                blocks.append(bf.pack(doc[x], start[x].astype(np.int32), s.astype(np.int32), data[from_],
                                      gone[0][y], gone[1][y].astype(np.int32), gone[2][y].astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "block": pa.array(blocks, pa.binary())})
    return run


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes at each position in byte order, equal strings alike.

    Prefix doubling: 8 bytes by value, then 16, 32, ... from pairs of ranks.
    """
    padded = np.append(data, np.zeros(length + 8, np.uint8))
    rank = np.ndarray((len(data),), ">u8", padded, 0, (1,)).astype(np.uint64)
    have = 8
    rank = _dense(rank)
    while have < length:
        step = min(have, length - have)
        after = np.append(rank[step:] + np.uint64(1), np.zeros(min(step, len(rank)), np.uint64))[:len(rank)]
        rank = _dense((rank << np.uint64(32)) | after)
        have += step
    return rank


def _dense(values: np.ndarray) -> np.ndarray:
    o = np.argsort(values)
    s = values[o]
    r = np.zeros(len(values), np.uint64)
    r[o] = np.cumsum(np.append(False, s[1:] != s[:-1])).astype(np.uint64)
    return r


def nearest_smaller(p: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each value, -1 where there is none.

    Values nearby one by one; further off, blocks are passed over by their least values, in
    steps of powers of two.
    """
    out = np.full(len(p), -1)
    todo = np.arange(len(p))
    for d in range(1, BLOCK):
        todo = todo[todo >= d]
        hit = p[todo - d] < p[todo]
        out[todo[hit]] = todo[hit] - d
        todo = todo[~hit]
        if not len(todo):
            return out
    least = [np.minimum.reduceat(p, np.arange(0, len(p), BLOCK))]
    while 2 << len(least) - 1 <= len(least[0]):
        half, last = 1 << len(least) - 1, least[-1]
        wide = last.copy()
        wide[half:] = np.minimum(last[half:], last[:-half])
        least.append(wide)
    block = todo // BLOCK - 1
    for k in reversed(range(len(least))):
        over = np.flatnonzero(block + 1 >= 1 << k)
        over = over[least[k][block[over]] >= p[todo[over]]]
        block[over] -= 1 << k
    todo, block = todo[block >= 0], block[block >= 0]
    for d in range(1, BLOCK + 1):
        at = (block + 1) * BLOCK - d
        hit = p[at] < p[todo]
        out[todo[hit]] = at[hit]
        todo, block = todo[~hit], block[~hit]
    return out


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Leading bytes that the strings at ``a`` and ``b`` share, up to ``length``, eight at a time."""
    padded = np.append(data, np.zeros(length + 8, np.uint8))
    eight = np.ndarray((len(data) + length,), "<u8", padded, 0, (1,))
    out, live = np.full(len(a), length), np.arange(len(a))
    for j in range(0, length, 8):
        x = eight[a[live] + j] ^ eight[b[live] + j]
        other = np.flatnonzero(x)
        low = x[other] & (~x[other] + np.uint64(1))
        out[live[other]] = np.minimum(length, j + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        live = np.delete(live, other)
    return out


def previous_factors(data: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """LPF of the strings of ``length`` bytes at the places ``at`` of ``data``, up to ``length``.

    (doc, start) are their positions in the corpus; one that is met twice is one. In suffix
    order, equal strings by position, each looks at the nearest entry of smaller position
    on either side.
    """
    lpf = np.zeros(len(at), np.int64)
    if not len(at):
        return lpf
    by_place = np.lexsort((start, doc))
    new = np.append(False, (np.diff(doc[by_place]) != 0) | (np.diff(start[by_place]) != 0))
    place = np.empty(len(at), np.int64)
    place[by_place] = np.cumsum(new)
    o = np.lexsort((place, suffix_ranks(data, length)[at]))
    p, x = place[o], at[o]
    found = np.zeros(len(o), np.int64)
    before = nearest_smaller(p)
    i = np.flatnonzero(before >= 0)
    found[i] = common_prefix(data, x[i], x[before[i]], length)
    after = len(p) - 1 - nearest_smaller(p[::-1])[::-1]
    i = np.flatnonzero((after < len(p)) & (found < length))
    found[i] = np.maximum(found[i], common_prefix(data, x[i], x[after[i]], length))
    lpf[o] = found
    return lpf


def _sort_suffixes(table: pa.Table) -> pa.Table:
    doc, start, size, data, *spans = bf.unpack_all(table["block"])
    windows = size - LENGTH + 1
    piece = np.repeat(np.arange(len(size)), windows)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.cumsum(size) - size)[piece] + within
    d, s = doc[piece], start[piece] + within
    gone = previous_factors(data, at, d, s, LENGTH) >= LENGTH
    d, s, z = merged(np.append(d[gone], spans[0]), np.append(s[gone], spans[1]).astype(np.int64),
                     np.append(np.full(int(gone.sum()), LENGTH, np.int64), spans[2]))
    return pa.table({"doc_id": d, "start": s, "size": z})


def _cut_out(keep_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in bf.text_chunks(batches):
            sizes, f = _lists(rows, "spans")
            raw = data.tobytes()
            at, removed, runs, shas, texts = 0, [], [], [], []
            for i in range(len(sizes)):
                lo, hi = int(off[i]), int(off[i + 1])
                parts, done, count, gone = [], lo, 0, 0
                if sizes[i]:
                    z = np.zeros(sizes[i], np.int64)
                    _, s, n = merged(z, f["start"][at:at + sizes[i]], f["size"][at:at + sizes[i]])
                    for a, b in zip((s + lo).tolist(), n.tolist(), strict=True):
                        parts.append(raw[done:a])
                        done, count, gone = a + b, count + 1, gone + b
                parts.append(raw[done:hi])
                at += sizes[i]
                kept = b"".join(parts)
                removed.append(gone)
                runs.append(count)
                shas.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode("utf-8", "ignore"))
            cols = {"doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
            if keep_text:
                cols["kept"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(cols)
    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, size) of removable byte ranges; ranges of a document may overlap."""
    buckets = bf.bucket_count(docs.sparkSession)
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), bf.whole_text())
    found = stored(
        docs.where(F.octet_length("text") >= LENGTH).mapInArrow(_cut(buckets), "bucket int, block binary")
        .groupBy("bucket").applyInArrow(_match(HOT), FOUND), "repeated-pieces")
    pieces = (found.where("detail").groupBy("doc_id")
              .agg(F.collect_list(F.struct("start", "size", "code", "hot")).alias("pieces")))
    sorted_ = (docs.join(pieces, "doc_id").mapInArrow(_fetch(buckets), "bucket int, block binary")
               .groupBy("bucket").applyInArrow(_sort_suffixes, SPANS))
    return found.where("NOT detail").select("doc_id", "start", "size").unionByName(sorted_)


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the
    remaining text, without characters cut in half, if ``keep_text``).

    ``docs`` needs doc_id and text; other columns are ignored. A null text is empty; an
    empty or short text keeps all its bytes (none to keep: the hash of nothing). Of rows
    that repeat a doc_id the one with the smallest text counts, once; rows without
    doc_id are returned whole and matched with nothing. An empty table gives no rows.
    """
    docs = bf.one_per_id(docs.select("doc_id", "text"), "doc_id", "text")
    spans = (repeated_spans(docs).groupBy("doc_id")
             .agg(F.collect_list(F.struct("start", "size")).alias("spans")))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bf.whole_text()).join(spans, "doc_id", "left")
    kept = ", kept string" if keep_text else ""
    return joined.mapInArrow(_cut_out(keep_text), f"doc_id long, {RESULT}{kept}")


SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(hx) // 2 - 99)) AS i,
  unnest(list_transform(range(0, len(hx) // 2 - 99), lambda k: md5_number(substr(hx, 2 * k + 1, 200)))) AS h FROM t),
dup AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
isl AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM dup)),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM isl GROUP BY doc_id, island),
gap AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs, max(b) AS last,
          string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gap JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(hx) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN hx ELSE head || substr(hx, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""
