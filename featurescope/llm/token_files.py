"""Operator 9: flat unsigned token files with 64-bit document offsets.

Layout below one folder, one group of files per range of ``doc_id``:

* ``shard-NNNNNN.bin``: the ids of all its documents, little-endian ``uint16`` (``uint32`` if the
  vocabulary has more than 65,536 entries), nothing between documents.
* ``shard-NNNNNN.idx``: ``n + 1`` little-endian ``uint64`` offsets in ids, from 0, within the shard.
* ``shard-NNNNNN.doc``: ``n`` little-endian ``int64`` document ids, then ``n`` bytes that are 1 where the id is not null.

Texts are dealt by ranges of ``doc_id`` (the only shuffle), sorted within each
range, encoded and appended.  A shard holds about ``SHARD_BYTES`` of text.  Rows of
one ``doc_id`` can part between ranges, at hashes of their texts and, for equal
rows, at the partitions they came from, so that no id has to fit in one shard.  The
number of ids in each shard makes the manifest; a prefix sum over it gives each
shard's base, and base + offset is a document's place among all ids.  Reading maps
the files into memory, or reads ranges of them where the store is not local.

Defined cases: null or empty text holds the end id only; null ``doc_id`` sorts
first; rows with the same ``doc_id`` stand side by side in the order of a hash of
their text; an empty table gives no shard with documents and no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescope.runtime import materialise, shared_path, shuffle_partitions

from .common import RangeReader, StreamWriter, small_batches, table, utf8
from .tokens import END_ID, encoder

SHARD_BYTES = 256 << 20

_MANIFEST = "shard int, n_docs long, n_ids long, width int"
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder``; returns the manifest: shard, n_docs, n_ids, width, base."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shards or max(shuffle_partitions(spark), -(-size // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        name = f"{folder}/shard-{shard:06d}"
        out = StreamWriter(f"{name}.bin")
        ids, known, offsets, total = [], [], [np.zeros(1, np.int64)], 0
        for b in batches:
            if not b.num_rows:
                continue
            flat, off = enc.encode(utf8(b.column(1)), end_id)
            out.write(flat.tobytes())
            offsets.append(off[1:] + total)
            total += len(flat)
            ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            known.append(b.column(0).is_valid().to_numpy(zero_copy_only=False))
        out.close()
        idx, doc = StreamWriter(f"{name}.idx"), StreamWriter(f"{name}.doc")
        idx.write(np.concatenate(offsets).astype("<u8").tobytes())
        idx.close()
        for x in ids:
            doc.write(x.astype("<i8").tobytes())
        for x in known:
            doc.write(x.astype("u1").tobytes())
        doc.close()
        n_docs = sum(map(len, ids))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64()), pa.array([enc.dtype.itemsize], pa.int32())], names=["shard", "n_docs", "n_ids", "width"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text")).withColumn("_p", F.spark_partition_id())
    order = (F.col("doc_id").asc_nulls_first(), "_h", "_p")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = materialise(rows.mapInArrow(write, _MANIFEST), "token-manifest").orderBy("shard").collect()  # one row per shard
    base, out = 0, []
    for m in manifest:
        out.append((m.shard, m.n_docs, m.n_ids, m.width, base))
        base += m.n_ids
    return spark.createDataFrame(out, _MANIFEST + ", base long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    n = manifest.count()  # rows of a local table

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                name = f"{folder}/shard-{m['shard']:06d}"
                if not m["n_docs"]:
                    continue
                idx, doc, ids = (RangeReader(f"{name}.{x}") for x in ("idx", "doc", "bin"))
                off = np.frombuffer(idx.read(0, idx.size), "<u8").astype(np.int64)
                if len(off) != m["n_docs"] + 1 or off[-1] != m["n_ids"] or ids.size != m["n_ids"] * m["width"]:
                    raise ValueError(f"{name}: the files do not match the manifest")
                docs = np.frombuffer(doc.read(0, 8 * m["n_docs"]), "<i8")
                known = np.frombuffer(doc.read(8 * m["n_docs"], m["n_docs"]), "u1").astype(bool)
                crc = np.empty(m["n_docs"], np.int64)
                for i in range(m["n_docs"]):
                    part = np.frombuffer(ids.read(int(off[i]) * m["width"], int(off[i + 1] - off[i]) * m["width"]), f"<u{m['width']}")
                    crc[i] = zlib.crc32(part.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=~known), pa.array(off[:-1] + m["base"]), pa.array(np.diff(off)), pa.array(crc)], schema=_ROWS)

    return manifest.repartition(max(1, n), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, folder), folder)
