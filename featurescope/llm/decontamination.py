"""Operator 1: benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` words may occur with up to ``k = floor(RATE * m)`` word
edits.  Cut into ``k + 1`` pieces, at least one piece then stands unchanged in the
document, so exact piece hits (hashes of word runs, looked up in a bit table and
then in a sorted array) propose all places, and Myers' bit-parallel algorithm,
one machine word per item whatever its length, finds the least number of edits
around each.  Words are compared without case of A-Z and without marks at their
ends.

Documents are scanned in place, with no shuffle.  The items go to all workers in
blocks of about ``BLOCK_WORDS`` words, ``PASS_BLOCKS`` of them in one scan of the
documents (some 100 MB in a worker); a larger benchmark takes several scans.

Defined cases: null or empty texts match nothing, on both sides; items of fewer
than ``LEAST_WORDS`` words match only documents that consist of just these words;
repeated items and documents are reported each; of several places of one item
the one with the fewest edits is reported, ties to the first; an empty table on
either side gives no rows (and drops no document); further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, small_batches, sole, table, utf8

RATE = 0.2
LEAST_WORDS = 5
BLOCK_WORDS = 400_000
PASS_BLOCKS = 8
_BITS = 1 << 20
_MARKS = b".,;:!?\"'()[]{}*"
_MUL = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Raw word -> hash of its core; 0 for a word of marks only."""

    def __missing__(self, word: bytes) -> int:
        core = word.lower().strip(_MARKS)
        h = (xxhash.xxh3_64_intdigest(core) or 1) if core else 0
        if len(self) >= 300_000:
            self.clear()
        self[word] = h
        return h


_WORDS = _Words()


def core_words(blob: bytes) -> np.ndarray:
    """Hashes of a text's words."""
    w = blob.split()
    sole(_WORDS)
    h = np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w))
    return h[h != 0]


def run_hashes(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of all runs of that length), for 1 to ``longest``."""
    h = words
    for n in range(1, longest + 1):
        if n > 1:
            if len(words) < n:
                return
            h = h[:-1] * _MUL + words[n - 1 :]
            h = h ^ (h >> np.uint64(31))
        yield n, mix(h)


def myers(pattern: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least edits of the pattern within ``text`` (free start and end), and the first end where they occur (exclusive)."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Items:
    """One block of test items, with the tables that find their pieces."""

    ids: list[int | None]
    words: list[np.ndarray]
    rate: float = RATE
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length: bits, hashes, item, offset
    short: dict[bytes, list[int]] = field(default_factory=dict)
    _peq: dict = field(default_factory=dict)

    def budget(self, m: int) -> int:
        return int(self.rate * m)

    def build(self) -> Items:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            m = len(w)
            if 0 < m < LEAST_WORDS:
                self.short.setdefault(w.tobytes(), []).append(i)
            if m < LEAST_WORDS:
                continue
            cuts = np.linspace(0, m, self.budget(m) + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                h = next(x for n, x in run_hashes(w[a:b], b - a) if n == b - a)
                rows.setdefault(int(b - a), []).append((int(h[0]), i, int(a)))
        for n, r in rows.items():
            r.sort()
            h = np.array([x[0] for x in r], np.uint64)
            bits = np.zeros(_BITS, bool)
            bits[(h & np.uint64(_BITS - 1)).astype(np.int64)] = True
            self.tables[n] = (bits, h, np.array([x[1] for x in r]), np.array([x[2] for x in r]))
        return self

    def matches(self, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the best place of every item that occurs; places count the document's words."""
        out = [(i, 0, 0, len(doc)) for i in self.short.get(doc.tobytes(), ())] if 0 < len(doc) < LEAST_WORDS else []
        places: dict[int, list[tuple[int, int]]] = {}
        if self.tables and len(doc):
            for n, h in run_hashes(doc, max(self.tables)):
                if n not in self.tables:
                    continue
                bits, hashes, item, offset = self.tables[n]
                at = np.flatnonzero(bits[(h & np.uint64(_BITS - 1)).astype(np.int64)])
                if not len(at):
                    continue
                lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
                for t, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    for r in range(a, b):
                        i = int(item[r])
                        k, m = self.budget(len(self.words[i])), len(self.words[i])
                        begin = t - int(offset[r])
                        places.setdefault(i, []).append((max(0, begin - k), min(len(doc), begin + m + k)))
        for i, spans in places.items():
            found = self._verify(i, doc, spans)
            if found:
                out.append(found)
        return out

    def _verify(self, i: int, doc: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        words = self.words[i].tolist()
        m, k = len(words), self.budget(len(words))
        if i not in self._peq:
            self._peq[i] = _masks(words), _masks(words[::-1])
        ahead, back = self._peq[i]
        best = None
        spans.sort()
        merged = [spans[0]]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        for a, b in merged:
            text = doc[a:b].tolist()
            edits, end = myers(ahead, m, text)
            if edits <= k and (best is None or edits < best[1]):
                _, length = myers(back, m, text[:end][::-1])
                best = (i, edits, a + end - length, a + end)
                if not edits:
                    break
        return best


def item_blocks(benchmark: DataFrame, *, rate: float = RATE, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of a bounded number of words (an item never parts)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-2 * total // block_words)) if total > block_words else 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        got = sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))  # at most about block_words words
        yield Items([r.item_id for r in got], [core_words(r.text.encode()) for r in got], rate).build()


def _passes(spark: SparkSession, benchmark: DataFrame, rate: float, block_words: int) -> Iterator[list]:
    """Broadcast blocks, as many as one scan takes."""
    held: list = []
    for items in item_blocks(benchmark, rate=rate, block_words=block_words):
        held.append(spark.sparkContext.broadcast(items))
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


_HITS = "doc_id long, item_id long, edits int, item_words int, start_word long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for every document (doc_id, text) and item of ``benchmark`` (item_id, text) that occurs in it."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], _HITS)
    for blocks in _passes(spark, benchmark, rate, block_words):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for r, t in enumerate(utf8(b.column(1))):
                    words = core_words(t)
                    found += [(r, own.value.ids[x[0]], x[1], len(own.value.words[x[0]]), *x[2:]) for own in blocks for x in own.value.matches(words)]
                row, item, edits, size, start, end = zip(*found, strict=True) if found else ([],) * 6
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(size, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "edits", "item_words", "start_word", "end_word"])

        out = out.unionByName(rows.mapInArrow(run, _HITS))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the documents in which an item occurs; all columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    schema = T.StructType(list(docs.schema.fields))
    for blocks in _passes(spark, benchmark, rate, block_words):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = (core_words(t) for t in utf8(b.column(at)))
                yield b.filter(pa.array([not any(own.value.matches(w) for own in blocks) for w in words], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op1_pigeonhole_myers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
