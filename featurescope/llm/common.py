"""Small helpers that several operators of this package share."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch: bounds what a Python worker holds when texts are very long.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (the path may be in a store that Python cannot open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: whole texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def md5_number(c: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 that any engine can derive: the first 8 hex digits of md5 of the value as text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def lowest_hashes(rows: DataFrame, key: str, n: int, row_id: str = "doc_id") -> DataFrame:
    """The ``n`` rows of each value of ``key`` with the lowest ``md5_number`` of ``row_id``, ties to the smaller id.

    A cut on the hash, from the value's count, leaves few more than ``n`` before rows of one value meet in one task.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per value
    cuts = [(r[key], min(1 << 32, int((1.3 * n + 50) / r.n * (1 << 32)) + 1)) for r in counts]
    cuts = rows.sparkSession.createDataFrame(cuts, T.StructType([rows.schema[key], T.StructField("_cut", T.LongType())]))
    few = rows.withColumn("_h", md5_number(row_id)).join(F.broadcast(cuts), key).where("_h < _cut")
    by = Window.partitionBy(key).orderBy("_h", row_id)
    return few.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).select(*rows.columns)


def within_bytes(sizes: list[tuple], bound: int) -> set:
    """The keys of (key, bytes), taken in order, whose running total stays within ``bound``; what would exceed it is passed over."""
    out, held = set(), 0
    for key, n in sizes:
        if held + n <= bound:
            out.add(key)
            held += n
    return out


_HOLDER: list[dict] = []


def sole(cache: dict) -> dict:
    """Let ``cache`` be the only word table that this worker process keeps: one worker serves many operators in turn."""
    if not _HOLDER or _HOLDER[0] is not cache:
        for other in _HOLDER:
            other.clear()
        _HOLDER[:] = [cache]
    return cache


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a bound; a word's hash never depends on what is remembered."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.bound:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_HASHES: list[WordHashes] = []


def word_hashes() -> WordHashes:
    """The worker process's own table."""
    if not _HASHES:
        _HASHES.append(WordHashes())
    return sole(_HASHES[0])


def lower_words(blob: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased (``bytes`` methods treat exactly those)."""
    return blob.lower().split()


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MUL
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` words, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, width):
        h = h * _MUL + words[j : j + n]
        h ^= h >> np.uint64(31)
    return mix(h)


# ---------------------------------------------------------------- files in the shared store


def local_path(uri: str) -> str | None:
    """The plain path behind a ``file:`` URI or a bare path, else None."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def put_file(uri: str, data: bytes | list[bytes]) -> None:
    """Write a whole file so that readers see all of it or nothing (a retried task overwrites the same bytes)."""
    parts = [data] if isinstance(data, bytes) else data
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.part"
        with open(part, "wb") as f:
            for x in parts:
                f.write(x)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{os.urandom(8).hex()}.part"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as f:
        for x in parts:
            f.write(x)
    store.move(part, path)


class RangeReader:
    """Reads byte ranges of a file: memory-mapped when it is local, ranged requests otherwise."""

    def __init__(self, uri: str):
        path = local_path(uri)
        if path is not None:
            self.size = os.path.getsize(path)
            self._map = np.memmap(path, dtype=np.uint8, mode="r") if self.size else np.empty(0, np.uint8)
            self._file = None
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            self._file = store.open_input_file(path)
            self.size = self._file.size()

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise ValueError(f"range {start}+{length} lies outside a file of {self.size} bytes")
        if self._file is None:
            return self._map[start : start + length].tobytes()
        self._file.seek(start)
        return self._file.read(length)


class StreamWriter:
    """Appends to a file under a private name; ``close`` moves it to its final name."""

    def __init__(self, uri: str):
        self.path = local_path(uri)
        if self.path is not None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self._part = f"{self.path}.{os.getpid()}.{os.urandom(4).hex()}.part"
            self._file = open(self._part, "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            self._store, self._to = fs.FileSystem.from_uri(uri)
            self._part = f"{self._to}.{os.urandom(8).hex()}.part"
            self._store.create_dir(os.path.dirname(self._to), recursive=True)
            self._file = self._store.open_output_stream(self._part)
        self.written = 0

    def write(self, data: bytes) -> None:
        self._file.write(data)
        self.written += len(data)

    def close(self) -> None:
        self._file.close()
        if self.path is not None:
            os.replace(self._part, self.path)
        else:
            self._store.move(self._part, self._to)


def one_batch(schema: pa.Schema, columns: list) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
