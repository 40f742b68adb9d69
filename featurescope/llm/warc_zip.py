"""Operator 4: WARC records in ZIP packages, read in place.

Each package is a ZIP file with two *stored* (uncompressed) members:
``archive/data.warc.gz``, one gzip member per WARC record, and
``indexes/index.cdxj``, one line per record with its offset and length in that
member.  ``read_packages`` finds the end-of-central-directory record (and the
ZIP64 one), parses the central directory, locates both members and range-reads
one record after the other; nothing is extracted to disk.

A record whose payload (of at least ``least_bytes`` bytes) equals that of a page
with a larger ``page_id`` is a ``revisit`` of the largest one: it holds the HTTP
header only.  Digests are computed in the first pass, combined per payload
before the shuffle, and joined back as small rows; payloads are moved once, by
``page_id``.  Packages hold about ``target`` bytes; a longer record has one of its
own.  File names hold the partition and the task attempt, so an attempt that runs
again or beside another never touches the other's files; the manifest names only
those of the attempt whose result Spark took.

Defined cases: null html is an empty payload; a null ``page_id`` is always a
response; rows with the same ``page_id`` and payload are each a response if no
larger ``page_id`` has that payload; null url is written without target; an
empty table gives no package and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescope.runtime import materialise, shared_path, shuffle_partitions

from .common import RangeReader, put_file, small_batches, table, utf8

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
TARGET = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# ---------------------------------------------------------------- ZIP


def _header64(values: list[int], force: bool) -> tuple[list[int], bytes]:
    """32-bit fields, and the ZIP64 extra field with those that do not fit."""
    big = [v for v in values if force or v >= 0xFFFFFFFF]
    extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
    return [0xFFFFFFFF if force or v >= 0xFFFFFFFF else v for v in values], extra


def zip_package(members: list[tuple[str, list[bytes]]], *, zip64: bool = False) -> list[bytes]:
    """The parts of a ZIP file with stored members; ZIP64 records where they are needed or ``zip64`` asks for them."""
    out, central, at = [], [], 0
    for name, parts in members:
        raw, size, crc = name.encode(), sum(map(len, parts)), 0
        for p in parts:
            crc = zlib.crc32(p, crc)
        (packed, plain), extra = _header64([size, size], zip64)
        head = struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0x800, 0, 0, 0x21, crc, packed, plain, len(raw), len(extra)) + raw + extra
        (plain, packed, offset), extra = _header64([size, size, at], zip64)
        central.append(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0x800, 0, 0, 0x21, crc, packed, plain, len(raw), len(extra), 0, 0, 0, 0, offset) + raw + extra)
        out += [head, *parts]
        at += len(head) + size
    directory = b"".join(central)
    end = b""
    if zip64 or at >= 0xFFFFFFFF or len(members) >= 0xFFFF:
        end = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(directory), at)
        end += struct.pack("<4sLQL", b"PK\6\7", 0, at + len(directory), 1)
    n, offset = (0xFFFF, 0xFFFFFFFF) if end else (len(members), at)
    return [*out, directory, end, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, len(directory), offset, 0)]


def zip_members(file: RangeReader) -> dict[str, tuple[int, int]]:
    """Where each stored member's bytes start, and how many there are."""
    tail_at = max(0, file.size - 22 - 0xFFFF)
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)  # these bytes can also stand in a comment
    if at < 0:
        raise ValueError("no end-of-central-directory record")
    n, size, offset = struct.unpack_from("<H2L", tail, at + 10)
    if n == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator_at = tail_at + at - 20
        if locator_at < 0:
            raise ValueError("no ZIP64 locator")
        mark, _, end_at, _ = struct.unpack("<4sLQL", file.read(locator_at, 20))
        if mark != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        mark, _, _, _, _, _, _, n, size, offset = struct.unpack("<4sQ2H2L4Q", file.read(end_at, 56))
        if mark != b"PK\6\6":
            raise ValueError("no ZIP64 end-of-central-directory record")
    directory, p, out = file.read(offset, size), 0, {}
    for _ in range(n):
        mark, _, _, flags, method, _, _, _, packed, plain, len_name, len_extra, len_note, _, _, _, head = struct.unpack_from("<4s6H3L5H2L", directory, p)
        if mark != b"PK\1\2":
            raise ValueError("damaged central directory")
        name = directory[p + 46 : p + 46 + len_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[p + 46 + len_name : p + 46 + len_name + len_extra]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                head = next(wide) if head == 0xFFFFFFFF else head
            extra = extra[4 + length :]
        if method == 0 and not flags & 1:
            mark, len_name2, len_extra2 = struct.unpack("<4s22x2H", file.read(head, 30))
            if mark != b"PK\3\4" or packed != plain:
                raise ValueError(f"damaged local header of {name}")
            out[name] = (head + 30 + len_name2 + len_extra2, plain)
        p += 46 + len_name + len_extra + len_note
    return out


# ---------------------------------------------------------------- WARC


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "null" else int(x)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, type and payload of one record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    out = {"page_id": _from_urn(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": int(inner["content-length"]), "payload": payload, "refers_to": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = _from_urn(fields["warc-refers-to"])
    elif len(payload) != out["payload_bytes"] or digest(payload) != out["payload_digest"]:
        raise ValueError(f"page {out['page_id']}: the payload does not match its digest")
    return out


# ---------------------------------------------------------------- packages


def decided(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``refers_to`` (null: the record is a response)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    small = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "sha").where("page_id is not null")
    groups = small.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    revisits = small.join(groups, "sha").where("page_id < refers_to").distinct()
    return rows.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")


def write_packages(pages: DataFrame, folder: str, *, least_bytes: int = 0, target: int = TARGET, zip64: bool = False) -> DataFrame:
    """Write all of ``pages`` (page_id, url, html) below ``folder``; returns the manifest: package, n_records, n_bytes."""
    small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get(), 0
        records: list[bytes] = []
        index: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal records, index, size, done
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{done:05d}.wacz"
            parts = zip_package([(DATA, records), (INDEX, index)], zip64=zip64)
            put_file(f"{folder}/{name}", parts)
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64()), pa.array([sum(map(len, parts))], pa.int64())], names=["package", "n_records", "n_bytes"])
            records, index, size, done = [], [], 0, done + 1
            return out

        for b in batches:
            for page_id, url, html, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), strict=True):
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = pack.compress(warc_record(page_id, url, html, to)) + pack.flush()
                if records and size + len(raw) > target:
                    yield flush()
                index.append(json.dumps({"page_id": page_id, "offset": size, "length": len(raw)}).encode() + b"\n")
                records.append(raw)
                size += len(raw)
        if records:
            yield flush()

    return materialise(decided(pages, least_bytes=least_bytes).mapInArrow(write, "package string, n_records long, n_bytes long"), "warc-manifest")


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_packages(manifest: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """One row per record of the packages named in ``manifest`` (package)."""
    small_batches(manifest.sparkSession)
    schema = _ROW.append(pa.field("url", pa.string())).append(pa.field("payload", pa.binary())) if with_payload else _ROW

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                file = RangeReader(f"{folder}/{name}")
                members = zip_members(file)
                (data, n_data), (index, n_index) = members[DATA], members[INDEX]
                rows = []
                for line in file.read(index, n_index).splitlines():
                    entry = json.loads(line)
                    if entry["offset"] + entry["length"] > n_data:
                        raise ValueError(f"{name}: the index points outside its archive")
                    rows.append(parse_record(zlib.decompress(file.read(data + entry["offset"], entry["length"]), 31)))
                    if not with_payload:
                        del rows[-1]["payload"]
                    if len(rows) >= 1000 or with_payload and len(rows) >= 100:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if with_payload else "")
    return manifest.select("package").repartition(shuffle_partitions(manifest.sparkSession)).mapInArrow(read, ddl)


def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    return read_packages(write_packages(table(spark, sf_dir, "pages"), folder), folder)


_GROUP = "('0x' || substr(h, 5 * i + 1, 5))::bigint"
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLE_SQL = f"""
with p as (select page_id::bigint page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
m as (select *, max(page_id) over (partition by html) top from p)
select page_id, octet_length(encode(html))::bigint payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: {" || ".join(f"substr({_ABC}, (({_GROUP} >> {s}) & 31)::int + 1, 1)" for s in (15, 10, 5, 0))}), '') payload_digest,
  case when page_id < top then 'revisit' else 'response' end record_type,
  case when page_id < top then top end refers_to
from m
"""
