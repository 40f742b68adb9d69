"""Operator 10: convolutional text classifier for toxicity, trained in numpy.

A word (A-Z lower-cased, marks at its ends dropped) and its first ``START``
characters each hash to one of ``BUCKETS`` embeddings, whose sum stands for the
word, so that unseen forms of a known stem are recognised; filters of width 1, 2
and 3 slide over the whole text; each filter's largest value goes into a logistic
layer.  Because a filter is linear before its maximum, the product of embeddings
and filters is tabulated once per worker, and scoring a word is a few look-ups.

Training takes a bounded sample of labelled rows (``per_class`` of each class by
hash, ``SAMPLE_BYTES`` in all; whole texts), splits a fifth of it off for calibration, fits by mini-batch
Adagrad (one filter starts as the words' log odds in the sample, drawn to 0 for rare words), then scales scores so that the threshold with the best F1 on the
calibration rows lies at 0.3.  Thresholds by language are calibrated on the same
rows, drawn towards 0.3 where these are few; they serve decisions (``is_toxic``)
and are no input of a score.  Only buckets seen in ``MIN_DOCS`` sampled documents
have an embedding; all others are zero and take no room.

Defined cases: null or empty text is scored like a text without known words; a
null ``doc_id`` is never held out and never learned from; several labels of one
document count as their maximum, of several texts of one document one is learned from; null labels are left out; without rows of both
classes every score is the share of toxic rows seen (0 if none), at most 0.29
unless all are toxic; further columns are ignored.
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

from .common import lowest_hashes, small_batches, sole, table, utf8, within_bytes

BUCKETS = 1 << 24
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
START = 4
MIN_DOCS = 3
SHRINK = 5.0
START_SCALE = 0.5
THRESHOLD = 0.3
PRIOR = 100
PER_CLASS = 2500
SAMPLE_BYTES = 48 << 20
_MARKS = b".,;:!?\"'()[]{}*"


def word_buckets(word: bytes) -> tuple[int, int]:
    """The buckets of a word and of its start; 0 for a word of marks only."""
    core = word.lower().strip(_MARKS)
    if not core:
        return 0, 0
    start = core.decode("utf-8", "replace")[:START].encode()
    return 1 + xxhash.xxh3_64_intdigest(core) % (BUCKETS - 1), 1 + xxhash.xxh3_64_intdigest(start, seed=1) % (BUCKETS - 1)


class Words(dict):
    """Raw word -> its two buckets in one number; with ``rows``, the embedding rows of these buckets, 0 where there is none."""

    def __init__(self, rows: dict[int, int] | None = None):
        super().__init__()
        self.rows = rows

    def __missing__(self, word: bytes) -> int:
        a, b = word_buckets(word)
        if self.rows is not None:
            a, b = self.rows.get(a, 0), self.rows.get(b, 0)
        if len(self) >= 300_000:
            self.clear()
        self[word] = a << 32 | b
        return a << 32 | b

    def of(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The two numbers of each word of all texts, each text followed by padding (0); and where each text starts."""
        sole(self)
        pad = [b""] * max(WIDTHS)
        words: list[bytes] = []
        start = np.empty(len(blobs), np.int64)
        for i, x in enumerate(blobs):
            start[i] = len(words)
            words += x.split()
            words += pad
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.stack([(both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32)]), start


_RAW = Words()


@dataclass
class ToxicityModel:
    known: np.ndarray | None = None  # buckets that have an embedding, ascending
    embedding: np.ndarray | None = None  # (known + 1) x DIM; row 0 is zero
    filters: list[np.ndarray] = field(default_factory=list)  # per width: width x DIM x FILTERS
    bias: list[np.ndarray] = field(default_factory=list)
    weight: np.ndarray | None = None
    intercept: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    constant: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    _tables: list[np.ndarray] | None = None
    _words: Words | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "_words": None}

    def pooled(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Texts x (widths * FILTERS): the largest value of each filter over a text, at least 0."""
        if self._tables is None:  # column blocks of all widths that use a word at distance j
            self._tables = [np.concatenate([np.einsum("vd,df->vf", self.embedding, w[j]) for w in self.filters if len(w) > j], axis=1).astype(np.float32) for j in range(max(WIDTHS))]
        n = x.shape[1]
        out = np.take(self._tables[0], x[0], axis=0)
        out += np.take(self._tables[0], x[1], axis=0)
        for j in range(1, max(WIDTHS)):
            cols = self._tables[j].shape[1]
            for half in x:
                out[: n - j, -cols:] += np.take(self._tables[j], half[j:], axis=0)
        # windows that start at a word or the first padding; later ones would reach into the next text
        ends = np.append(start[1:], n) - (max(WIDTHS) - 1)
        top = np.maximum.reduceat(out, np.stack([start, ends], 1).ravel(), axis=0)[::2] + np.concatenate(self.bias)
        return np.maximum(top, 0)

    def logit(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.pooled(x, start) @ self.weight + self.intercept

    def score(self, blobs: list[bytes]) -> np.ndarray:
        if self.embedding is None:
            return np.full(len(blobs), self.constant)
        if self._words is None:
            self._words = Words({int(h): i + 1 for i, h in enumerate(self.known)})
        x, start = self._words.of(blobs)
        z = self.scale * self.logit(x, start).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _best_threshold(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The cut with the largest weighted F1, in the middle of the gap below its last accepted value."""
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    f1 = 2 * np.cumsum(w * y) / (np.cumsum(w) + (w * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # a cut cannot part equal values
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def _log_odds(texts: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Log odds of label 1 for each embedding row, from the documents it occurs in; drawn to 0 where these are few."""
    n = np.zeros((2, size))
    for x, label in zip(texts, y.tolist(), strict=True):
        n[label, np.unique(x)] += 1
    rate = (n + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1)
    return (np.log(rate[1] / rate[0]) * n.sum(0) / (n.sum(0) + SHRINK)).astype(np.float32)


def train(texts: list[np.ndarray], y: np.ndarray, lang: list[str | None], *, share: float, epochs: int = 14, seed: int = 7) -> ToxicityModel:
    """Fit on the padded buckets of whole texts (``Words.of``); ``share`` is the share of label 1 among all labelled rows."""
    if len(set(y.tolist())) < 2:
        seen = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(constant=seen)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(order) // 5]
    fit = order[len(order) // 5 :]
    if len(set(y[fit].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held = fit = order
    seen, docs = np.unique(np.concatenate([np.unique(texts[i]) for i in fit]), return_counts=True)
    known = seen[(docs >= MIN_DOCS) & (seen > 0)]
    texts = [np.where(known[p] == t, p + 1, 0).astype(np.int32) if len(known) else np.zeros_like(t) for t in texts for p in (np.minimum(np.searchsorted(known, t), max(0, len(known) - 1)),)]
    E = rng.normal(0, 0.1, (len(known) + 1, DIM)).astype(np.float32)
    E[:, 0] = START_SCALE * _log_odds([texts[i] for i in fit], y[fit], len(known) + 1)
    E[0] = 0
    W = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    v = rng.normal(0, 0.5, FILTERS * len(WIDTHS)).astype(np.float32)
    W[0][0, :, 0], v[0] = 0, 1  # one filter starts as the word's own log odds
    W[0][0, 0, 0] = 1
    c = -1.0
    gE, gW, gb, gv, gc = np.full_like(E, 1e-4), [np.full_like(x, 1e-4) for x in W], [np.full_like(x, 1e-4) for x in b], np.full_like(v, 1e-4), 1e-4
    rate, size = 0.1, 32
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // size)):
            n = np.array([texts[i].shape[1] for i in at])
            x = np.concatenate([texts[i] for i in at], axis=1)
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            e = E[x[0]] + E[x[1]]
            where, pooled = [], []
            for k, w in enumerate(WIDTHS):
                out = e @ W[k][0]
                for j in range(1, w):
                    out[: len(e) - j] += e[j:] @ W[k][j]
                pos = np.array([s + out[s : s + m - max(WIDTHS) + 1].argmax(0) for s, m in zip(start, n, strict=True)])  # texts x FILTERS
                where.append(pos)
                pooled.append(np.take_along_axis(out, pos, 0) + b[k])
            h = np.maximum(np.concatenate(pooled, 1), 0)
            p = 1 / (1 + np.exp(-np.clip(h @ v + c, -30, 30)))
            d = ((p - y[at]) / len(at)).astype(np.float32)
            dv, dc = h.T @ d + 1e-5 * v, float(d.sum())
            dh = np.outer(d, v) * (h > 0)
            for k, w in enumerate(WIDTHS):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                dW = np.empty_like(W[k])
                for j in range(w):
                    rows = x[:, np.minimum(where[k] + j, len(e) - 1)]  # 2 x texts x FILTERS
                    dW[j] = np.einsum("tfd,tf->df", E[rows[0]] + E[rows[1]], g)
                    touched, inv = np.unique(rows.ravel(), return_inverse=True)
                    dE = np.zeros((len(touched), DIM), np.float32)
                    np.add.at(dE, inv, np.concatenate([(g[:, :, None] * W[k][j].T[None]).reshape(-1, DIM)] * 2))
                    dE[touched == 0] = 0
                    gE[touched] += dE * dE
                    E[touched] -= rate * dE / np.sqrt(gE[touched])
                gW[k] += dW * dW
                W[k] -= rate * dW / np.sqrt(gW[k])
                db = g.sum(0)
                gb[k] += db * db
                b[k] -= rate * db / np.sqrt(gb[k])
            gv += dv * dv
            v -= rate * dv / np.sqrt(gv)
            gc += dc * dc
            c -= rate * dc / np.sqrt(gc)
    model = ToxicityModel(known, E, W, b, v, c)
    z = np.concatenate([model.logit(texts[i], np.zeros(1, np.int64)) for i in held]).astype(np.float64)
    # the sample is balanced; weights bring back the classes' shares
    part = y[held].mean()
    weight = np.where(y[held] == 1, share / part, (1 - share) / (1 - part))
    cut = _best_threshold(z, y[held], weight)
    model.scale = 1.0
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - model.scale * cut)
    for one in {x for x in lang if x is not None}:  # by language where it has rows of both classes
        own = np.array([lang[i] == one for i in held])
        if own.sum() >= 20 and len(set(y[held][own].tolist())) == 2:
            n = int(y[held][own].sum())  # few rows: close to the threshold for all
            own_z = (n * (model.scale * _best_threshold(z[own], y[held][own], weight[own]) + model.shift) + PRIOR * np.log(THRESHOLD / (1 - THRESHOLD))) / (n + PRIOR)
            model.thresholds[one] = float(1 / (1 + np.exp(-np.clip(own_z, -40, 40))))
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES, seed: int = 7) -> ToxicityModel:
    """Train on the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.where("y in (0, 1)")
    sample = lowest_hashes(known, "y", per_class)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, start = _RAW.of(utf8(b.column(3)))
                parts = [p.tobytes() for p in np.split(x, start[1:], axis=1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(parts, pa.large_binary() if sum(map(len, parts)) > 1 << 30 else pa.binary())], names=["doc_id", "y", "lang", "x"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.xxhash64("text").alias("h")).join(F.broadcast(sample), "doc_id")  # at most 2 * per_class documents
    sizes = picked.groupBy("doc_id", "y").agg(F.min(F.struct("h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))).alias("t")).collect()
    sizes.sort(key=lambda r: (r.t.h, r.doc_id))
    keep = [k for c in (0, 1) for k in sorted(within_bytes([((r.doc_id, r.t.h), r.t.n) for r in sizes if r.y == c], sample_bytes // 2))]
    chosen = picked.join(F.broadcast(docs.sparkSession.createDataFrame(keep, "doc_id long, h long")), ["doc_id", "h"]).groupBy("doc_id", "y").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
    got = chosen.mapInArrow(rows, "doc_id long, y int, lang string, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    y = np.array([r.y for r in got], np.int64)
    n = counts.get(0, 0) + counts.get(1, 0)
    return train([np.frombuffer(r.x, np.int32).reshape(2, -1) for r in got], y, [r.lang for r in got], share=counts.get(1, 0) / max(1, n), seed=seed)


_LOADED: dict[int, ToxicityModel] = {}


def score(docs: DataFrame, model: ToxicityModel, *, column: str = "score") -> DataFrame:
    """``docs`` with a score for each whole text; all other columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    docs = docs.drop(column)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = m.score(utf8(b.column(at))) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, column])

    return docs.mapInArrow(run, schema)


def is_toxic(model: ToxicityModel, score_column: str = "score", lang_column: str = "lang"):
    """Decision by the language's calibrated threshold (0.3 for languages without one)."""
    bound = F.lit(THRESHOLD)
    for one, t in sorted(model.thresholds.items()):
        bound = F.when(F.col(lang_column) == one, F.lit(t)).otherwise(bound)
    return F.col(score_column) >= bound


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
