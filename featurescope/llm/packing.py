"""Operator 6: harmonic packing of token sequences.

A sequence of ``capacity`` (4096) ids is divided into reciprocal-capacity
classes: class ``k`` holds pieces of at most ``capacity // k`` ids, and every bin
of class ``k`` takes exactly ``k`` of them.  Documents are cut so that pieces
nearly fill their class: full sequences first (class 1), then the largest class
size that fits, until what is left fits a class with less than 1/128 unused, or
is so short that its class follows from its own length.

Each worker bucket fills the bins of its classes by itself: the row number
of a piece within (class, bucket) fixes its bin, and every complete bin is final.
A piece of class 1 is a whole sequence as it is made.  Buckets are dealt in turn
by the encoding task, so no document, id or length can be hot; the pieces are
written once, so that a lost executor changes nothing.  Pieces of incomplete bins
move up a tree of buckets, 16 to 1, where the same rule is applied again.  What
remains at the root is bounded by the classes alone (fewer than ``k`` pieces of
class ``k``) and is packed first-fit decreasing.

``sequence_id`` is unique, not dense: level, class, bucket and bin in one number
(for class 1: task and place).

Defined cases: a null or empty text is the end id alone; rows with the same (or
a null) ``doc_id`` are packed each for itself; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featurescope.runtime import materialise, shuffle_partitions

from .common import small_batches, table, utf8
from .tokens import END_ID, encoder

CAPACITY = 4096
LARGEST_CLASS = 64
SLACK = 128
FAN_IN = 16

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, serial long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of ``n`` ids, in order."""
    out, at = [], 0
    while n - at >= capacity:
        out.append((at, capacity, 1))
        at += capacity
    while rest := n - at:
        k = capacity // rest  # the smallest class size that holds all of the rest
        size = capacity // k
        if k > LARGEST_CLASS or size - rest <= size // SLACK:
            out.append((at, rest, k))
            break
        if k == LARGEST_CLASS:
            size = LARGEST_CLASS - 1  # below the classes by size; what is left is shorter still
            size = min(size, rest)
            out.append((at, size, capacity // size))
        else:
            size = capacity // (k + 1)
            out.append((at, size, k + 1))
        at += size
    return out


def pieces(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and cut them; one row per piece, with its ids (``ids``, little-endian uint32) if asked.

    ``serial`` is the task's number in 26 bits and the piece's place in the task in 33.
    """
    small_batches(docs.sparkSession)
    schema = _PIECES + (", ids binary" if with_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        serial = TaskContext.get().partitionId() << 33
        known: dict[int, list[tuple[int, int, int]]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            flat, off = enc.encode(utf8(b.column(1)), end_id)
            flat = flat.astype("<u4")
            row, start, length, crc, total, kind, ids = [], [], [], [], [], [], []
            for i in range(b.num_rows):
                n = int(off[i + 1] - off[i])
                parts = known.get(n)
                if parts is None:
                    parts = known[n] = cut(n, capacity)
                    if len(known) > 100_000:
                        known = {}
                for at, size, k in parts:
                    raw = flat[off[i] + at : off[i] + at + size].tobytes()
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw))
                    total.append(n)
                    kind.append(k)
                    if with_ids:
                        ids.append(raw)
            cols = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(kind, pa.int32()), pa.array(np.arange(serial, serial + len(row)), pa.int64())]
            serial += len(row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "serial"]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def _first_fit(capacity: int, level: int):
    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        free, seq, off = np.empty(len(group), np.int64), np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        used = 0
        for i, n in enumerate(group["length"].to_numpy()):
            fits = np.flatnonzero(free[:used] >= n)
            j = int(fits[0]) if len(fits) else used
            if j == used:
                free[j] = capacity
                used += 1
            seq[i], off[i] = j, capacity - free[j]
            free[j] -= n
        return group.assign(sequence_id=(level << 59) + seq, offset=off)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return place


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """Pack ``docs``; one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    n_buckets = buckets or shuffle_partitions(spark)
    every = materialise(pieces(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity), "pieces")
    whole = every.where("class = 1").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft(F.lit(15).cast("long"), 59) + F.col("serial")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # in turn within a task; tasks begin at different buckets
    turn = F.col("serial").bitwiseAND((1 << 33) - 1) + F.xxhash64(F.shiftright("serial", 33)) % (1 << 20)
    rest = every.where("class > 1").withColumn("bucket", F.pmod(turn, F.lit(n_buckets).cast("long")))
    done, level = [whole], 0
    while True:
        by = Window.partitionBy("class", "bucket").orderBy("serial")
        bins = Window.partitionBy("class", "bucket", "bin").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        filled = rest.withColumn("n", F.row_number().over(by) - 1).withColumn("bin", F.floor(F.col("n") / F.col("class")).cast("long"))
        filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(bins), F.lit(0)))
        own = Window.partitionBy("class", "bucket", "bin")
        filled = materialise(filled.withColumn("full", F.count(F.lit(1)).over(own) == F.col("class")), f"packed-{level}")
        # 4 bits of level, 13 of class, 18 of bucket, 28 of bin
        number = F.shiftleft(F.lit(level).cast("long"), 59) + F.shiftleft(F.col("class").cast("long"), 46) + F.shiftleft(F.col("bucket"), 28) + F.col("bin")
        done.append(filled.where("full").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset"))
        rest = filled.where("not full").drop("n", "bin", "offset", "full")
        if n_buckets == 1:
            break
        n_buckets = -(-n_buckets // FAN_IN)
        rest = rest.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        level += 1
    # fewer than k pieces of each class k are left
    last = rest.drop("class", "bucket", "serial").groupBy(F.lit(0).alias("all")).applyInPandas(_first_fit(capacity, level + 1), _PLACED)
    out = last
    for x in done:
        out = out.unionByName(x)
    return out


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
