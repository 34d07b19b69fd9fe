"""What the corpus operators share: scratch tables, row packing for Arrow, word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator here: a run of anything but ASCII white space. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Output batches of the Arrow functions are closed at about this many bytes.
BATCH_BYTES = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Only a local session may lack the setting; then the path lies in a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/textloom-scratch"
    return f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"


#: With this setting a query's exchanges are deleted when it ends; otherwise they stay until the driver collects garbage.
DELETE_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _exchanges_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries in this scope delete their exchanges at their end: what reads their tables needs none of them."""
    before = spark.conf.get(DELETE_EXCHANGES, None)
    spark.conf.set(DELETE_EXCHANGES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DELETE_EXCHANGES) if before is None else spark.conf.set(DELETE_EXCHANGES, before)


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _exchanges_deleted(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1][id(out)] = path, out
    return out


def _delete(spark: SparkSession, name: str) -> None:
    if "/textloom-" not in name:
        raise ValueError(f"not a scratch table: {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SCOPES: list[dict[int, tuple[str, DataFrame]]] = []


class Scratch:
    """A scope that deletes the tables stored in it when it ends, but for those handed to keep().

    What a kept table's rows come from may go, as a stored table is written whole; a plan that is still lazy at the end
    of the scope must read kept tables only. Kept tables belong to the scope around this one, if there is one.
    Queries that run in the scope delete their exchanges when they end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept, self.exchanges = spark, set(), _exchanges_deleted(spark)

    def __enter__(self) -> Scratch:
        _SCOPES.append({})
        self.exchanges.__enter__()
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df must be what stored() returned."""
        self.kept.add(id(df))
        return df

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scope, which must be the innermost, before its end."""
        path, _ = _SCOPES[-1].pop(id(df))
        _delete(self.spark, path)

    def __exit__(self, *failure) -> None:
        self.exchanges.__exit__(None, None, None)
        for key, (path, df) in _SCOPES.pop().items():
            if key in self.kept and failure[0] is None:
                if _SCOPES:
                    _SCOPES[-1][key] = path, df
            else:
                _delete(self.spark, path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers), on uint64 arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_SHINGLE = odd_constants(64, 0x5EED)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """uint64 hashes of all runs of `width` words; one hash of the whole if there are fewer words; none without words."""
    if not len(h):
        return h
    n = min(width, len(h))
    total = h[: len(h) - n + 1] * _SHINGLE[0]
    for k in range(1, n):
        total = total + h[k : len(h) - n + 1 + k] * _SHINGLE[k]
    return mix64(total + np.uint64(n))


def all_shingles(h: np.ndarray, begins: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of many stretches of one array of word hashes, where those of each begin and the last end).

    The same values as shingle_hashes() gives for each stretch.
    """
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    places = np.append(0, np.cumsum(counts))
    if not places[-1]:
        return np.zeros(0, np.uint64), places
    at = np.arange(places[-1]) + np.repeat(begins - places[:-1], counts)
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        total += h[k : len(h) - width + 1 + k] * _SHINGLE[k]
    mixed = np.append(mix64(total + np.uint64(width)), np.uint64(0))
    out = mixed[np.minimum(at, len(mixed) - 1)]
    for k in np.flatnonzero((sizes > 0) & (sizes < width)).tolist():
        out[places[k]] = shingle_hashes(h[begins[k] : begins[k] + sizes[k]], width)[0]
    return out, places


#: Bytes that belong to words.
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts one after another, where each begins and the last ends); null counts as empty."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the runs of member bytes; a run ends where its text does."""
    n = len(member)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    inside = offsets[(offsets > 0) & (offsets < n)]
    before[inside] = False
    after[inside - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


class ByteHash:
    """64-bit hashes of stretches of bytes: a polynomial over a random value for each byte, finished by mix64()."""

    PORTION, LONGEST = 1 << 18, 1 << 16

    def __init__(self, seed: int, lower: bool):
        self.table = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
        if lower:
            self.table[65:91] = self.table[97:123]
        base = int(self.table[0] ^ self.table[255]) & ~7 | 5  # of the greatest multiplicative order
        powers, inverse, over, under = [], [], 1, 1
        back = pow(base, -1, 1 << 64)
        for _ in range(self.PORTION + self.LONGEST + 1):
            powers.append(over)
            inverse.append(under)
            over, under = over * base & 0xFFFFFFFFFFFFFFFF, under * back & 0xFFFFFFFFFFFFFFFF
        self.powers, self.inverse = np.array(powers, np.uint64), np.array(inverse, np.uint64)

    def __call__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """uint64 hash of each stretch; these are not empty and don't overlap."""
        out = np.empty(len(begins), np.uint64)
        k = 0
        while k < len(begins):
            low = int(begins[k])
            stop = int(np.searchsorted(begins, low + self.PORTION))
            long_ = np.flatnonzero(ends[k:stop] - begins[k:stop] > self.LONGEST)
            if len(long_) and long_[0] == 0:  # hashed in parts of its own
                high = int(ends[k])
                value = np.uint64(high - low)
                for at in range(low, high, self.LONGEST):
                    part = self.table[data[at : min(high, at + self.LONGEST)]]
                    value = mix64(np.array([(part * self.powers[: len(part)]).sum(dtype=np.uint64) ^ value]))[0]
                out[k] = value
                k += 1
                continue
            if len(long_):
                stop = k + int(long_[0])
            places = np.empty(2 * (stop - k), np.int64)
            places[0::2], places[1::2] = begins[k:stop] - low, ends[k:stop] - low
            size = int(places[-1])
            values = np.zeros(size + 1, np.uint64)
            values[:size] = self.table[data[low : low + size]]
            values[:size] *= self.powers[:size]
            out[k:stop] = np.add.reduceat(values, places)[::2] * self.inverse[places[0::2]]
            k = stop
        return mix64(out + (ends - begins).astype(np.uint64))


_HASH: list[ByteHash] = []


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words of all texts with A-Z lower-cased, where each text's words begin and the last end, where
    each word begins in bytes, the bytes)."""
    if not _HASH:
        _HASH.append(ByteHash(97, lower=True))
    data, offsets = text_bytes(texts)
    begins, ends = runs(_INK[data], offsets)
    return _HASH[0](data, begins, ends), np.searchsorted(begins, offsets), begins, data


def slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(begin, count) of stretches of rows of about `size` bytes, of one row at least."""
    _, offsets = text_bytes(texts)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + size, "right")) - 1)
        yield k, min(stop, len(texts)) - k
        k = stop


def distinct_counts(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many different values each stretch values[places[k] : places[k + 1]] has."""
    sizes = np.diff(places)
    if not len(values):
        return sizes
    owned = np.sort(mix64(values ^ mix64(np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes))))
    again = owned[1:][owned[1:] == owned[:-1]]
    if not len(again):
        return sizes
    marked = np.isin(mix64(values ^ mix64(np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes))), again)
    out = sizes.copy()
    for k in np.unique(np.repeat(np.arange(len(sizes)), sizes)[marked]).tolist():
        out[k] = len(np.unique(values[places[k] : places[k + 1]]))
    return out


def sequence_keys(hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of many stretches of word hashes, as two columns of signed longs; stretches are not empty."""
    at = np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    place = (at - np.repeat(begins, sizes) + 1).astype(np.uint64)
    h, n, starts = hashes[at], sizes.astype(np.uint64), np.cumsum(sizes) - sizes
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.add.reduceat(mix64(h + mix64(place)), starts)
    two = np.add.reduceat(mix64(h * np.uint64(0x9E3779B97F4A7C15) + mix64(place + np.uint64(1 << 40))), starts)
    return mix64(one + n).view(np.int64), mix64(two + n).view(np.int64)


def long_lists(matrix: np.ndarray, present: np.ndarray | None = None) -> pa.ListArray:
    """A list<int64> column from the rows of a matrix; null where not present (present rows are the matrix's)."""
    width = matrix.shape[1]
    if present is None:
        present = np.ones(len(matrix), bool)
    offsets = np.append(0, np.cumsum(present * width)).astype(np.int32)
    valid = pa.array(present).buffers()[1] if len(present) else None
    flat = pa.array(np.ascontiguousarray(matrix).view(np.int64).ravel())
    return pa.Array.from_buffers(pa.list_(pa.int64()), len(present), [valid, pa.py_buffer(offsets)], children=[flat])


def ragged_longs(values: np.ndarray, places: np.ndarray) -> pa.ListArray:
    """A list<int64> column of the stretches of an array."""
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(values.view(np.int64)))


def forget(made: dict) -> None:
    """Drop what a Python worker keeps in `made` and hand its memory back: later stages are run by the same workers."""
    if not made:
        return
    made.clear()
    gc.unfreeze()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: A key is hot from this share of all rows on; so there are at most this many, and their rows may be broadcast.
HOT_KEYS = 1024


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows joined with a table that has one row for each key and in `count` the number of rows with that key.

    Both are written tables. Keys with more than 1 / HOT_KEYS of the rows counted meet their rows by a broadcast of at
    most HOT_KEYS rows, so none of them fills a task; the others are exchanged. `count` is dropped.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) > total / HOT_KEYS).drop(count)
    if not total or hot.limit(1).count() == 0:
        return rows.join(table.drop(count), on)
    cold = table.where(F.col(count) <= total / HOT_KEYS).drop(count)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rest.unionByName(rows.join(F.broadcast(hot), on))


#: Bits of a filter for each key, and at most; one row for 64 bits is broadcast.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 26


class KeyFilter:
    """Tells most rows that have no match in a table before they are exchanged for a join with it.

    The table is a written one. Each key sets one of the bits of a bitmap, which is broadcast; a row whose bit isn't
    set has no match. Of the rows without a match about one in 16 passes, more if there are over MOST_FILTER_BITS / 16
    keys: the join must follow.
    """

    def __init__(self, table: DataFrame, on: list[str]):
        bits = min(MOST_FILTER_BITS, 1 << max(6, (FILTER_BITS * table.count() - 1).bit_length()))
        place = f"pmod(xxhash64({', '.join(on)}), {bits})"
        self.word, self.mask = F.expr(f"{place} div 64"), F.expr(f"shiftleft(1L, cast({place} % 64 as int))")
        self.words = stored(table.select(self.word.alias("filter_word"), self.mask.alias("mask")).groupBy("filter_word").agg(F.bit_or("mask").alias("filter_mask")))

    def _join(self, rows: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(self.words), (F.col("filter_word") == self.word) & (F.col("filter_mask").bitwiseAND(self.mask) != 0), how)

    def some(self, rows: DataFrame) -> DataFrame:
        """All rows that have a match, and a few others."""
        return self._join(rows, "left_semi")

    def others(self, rows: DataFrame) -> DataFrame:
        """The rows that some() leaves out."""
        return self._join(rows, "left_anti")
