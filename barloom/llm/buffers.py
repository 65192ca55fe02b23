"""Text columns as byte arrays inside Arrow tasks, and packed blocks between tasks.

A task walks its rows in chunks of bounded size (one longer text makes a chunk of
its own) and works on all of a chunk's bytes with numpy. What goes through a
shuffle is packed: one row per (chunk, bucket) with arrays inside, so that millions
of small records cost Spark a few thousand rows.
"""

from __future__ import annotations

import ctypes
import functools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHUNK_BYTES = 3 << 19
CHUNK_ROWS = 4096
SPACES = b" \t\n\x0b\x0c\r"


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES,
                rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, offsets): at most ``limit`` bytes and ``rows`` rows, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        buffers = col.buffers()
        off = np.frombuffer(buffers[1], np.int32, count=len(col) + 1, offset=4 * col.offset).astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), at + rows, len(col))
            yield batch.slice(at, to - at), data[off[at]:off[to]], off[at:to + 1] - off[at]
            at = to


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


# ---- words -------------------------------------------------------------------------------

def _table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2 ** 64, n, dtype=np.uint64)


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower()
IS_WORD = np.array([i not in SPACES for i in range(256)])
_BYTE_CODES = _table(11, 256)
_BASE = 0x9E3779B97F4A7C15 | 1


#: Bytes that words are hashed from at once; a longer text goes in parts.
HASHED_BYTES = 1 << 18


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        a = np.full(n, base, np.uint64)
        a[0] = 1
        return np.cumprod(a, dtype=np.uint64)
    return powers(_BASE), powers(pow(_BASE, -1, 2 ** 64))


@functools.lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(HASHED_BYTES)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse; only a table of fixed size is kept."""
    return _kept_powers() if n <= HASHED_BYTES else _made_powers(n)


def lean_memory() -> None:
    """Gives freed arrays of a worker back to the system, where its libraries allow that.

    Workers live on between tasks and stages; without this each keeps its largest working
    set for good.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass  # another allocator


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit keys stirred, so that any part of them is uniform."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (no white space unless ``is_word`` says otherwise, within a
    text), and words before each text."""
    word = is_word[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > HASHED_BYTES:
        first, last = int(starts.min()), int(ends.max())
        if last - first > HASHED_BYTES and len(starts) > 1:
            half = len(starts) // 2
            return np.concatenate([range_hashes(data, starts[:half], ends[:half]), range_hashes(data, starts[half:], ends[half:])])
        data, starts, ends = data[first:last], starts - first, ends - first
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a chunk, and words before each text."""
    starts, ends, at = word_bounds(data, off)
    return range_hashes(LOWER[data], starts, ends), at


_STEPS = _table(12, 64) | np.uint64(1)


def shingles(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text (a shorter text: one run of all
    its words; none: nothing) and the text each belongs to."""
    counts = np.diff(at)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), n)
    first = at[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    have = np.minimum(counts, width)[owner]
    out = have.astype(np.uint64) * _STEPS[width]
    whole = bool(len(have)) and int(have.min()) == width
    for j in range(width):
        if whole:
            out += hashes[first + j] * _STEPS[j]
        else:
            inside = np.flatnonzero(have > j)
            out[inside] += hashes[first[inside] + j] * _STEPS[j]
    return mix(out), owner


# ---- packed blocks -----------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one value; bytes of wide integers are laid out plane by plane, as their
    high bytes repeat and shrink when the shuffle compresses them."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<3sq", a.dtype.str[1:].encode().ljust(3), len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes())
    return b"".join(parts)


def unpack(value: bytes) -> list[np.ndarray]:
    count, at, out = value[0], 1, []
    for _ in range(count):
        kind, n = struct.unpack_from("<3sq", value, at)
        at += struct.calcsize("<3sq")
        dtype = np.dtype(kind.decode().strip())
        raw = np.frombuffer(value, np.uint8, n * dtype.itemsize, at)
        at += n * dtype.itemsize
        if dtype.itemsize > 1:
            raw = np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).reshape(-1)
        out.append(raw.view(dtype) if n else np.zeros(0, dtype))
    return out


def unpack_all(column: pa.ChunkedArray | pa.Array, which: int | None = None) -> list[np.ndarray]:
    """The arrays of all blocks of a column, joined one by one."""
    blocks = [unpack(v.as_buffer().to_pybytes()) for v in column if v.is_valid]
    return [np.concatenate(x) for x in zip(*blocks, strict=True)] if blocks else []


def by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins in it."""
    small = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(small, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key."""
    high = (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)
    return ((high * np.uint64(buckets)) >> np.uint64(31)).astype(np.int64)


def bucket_count(spark: SparkSession, per_partition: int = 4) -> int:
    """Buckets of a packed exchange: a few per shuffle partition, so they grow with the cluster's setting."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, with the end appended."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


# ---- tables ------------------------------------------------------------------------------

def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def one_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with one row per key; rows without a key all stay.

    Of rows that repeat a key the one with the smallest ``order`` value counts. Only
    the key column is read to find out whether any is repeated.
    """
    keyed = df.where(F.col(key).isNotNull())
    repeated = keyed.groupBy(key).count().where("count > 1").select(key)
    if repeated.isEmpty():
        return df
    least = (keyed.join(repeated, key, "left_semi").groupBy(F.col(key).alias("_key"))
             .agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.coalesce(F.col(order), F.lit(""))).alias("_row")).select("_row.*"))
    return (keyed.join(repeated, key, "left_anti").select(df.columns)
            .unionByName(least).unionByName(df.where(F.col(key).isNull())))
