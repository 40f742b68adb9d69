"""Operator 2: n-gram Jaccard join by vertical partitioning.

A document's set holds its distinct word shingles.  One global order of all
shingles (by estimated document frequency, rare first, then by hash) is cut into
``FRAGMENTS`` fragments.  For every candidate pair each fragment's overlap is
counted by itself, wherever the two segments meet, and the partial counts are
summed per pair; a pair links when ``100 * intersection >= 80 * union``.

Frequencies come from a count table of ``BINS`` hash bins over all documents
(fixed size, summed over tasks in two steps).  Any order gives the same links;
the order only decides how many candidates arise.

Candidates.  In the global order a pair that links shares a shingle within both
prefixes of ``n - ceil(0.8 n) + 1`` shingles, and at the first such place
``1 + min(rest, rest) >= ceil(4 (n + m) / 9)`` holds; pairs that fail this (or the
length filter) at every shared shingle cannot link.  A
pair whose prefixes' own overlap, the first partial count, leaves too little is
dropped before its segments move.  Documents with equal sets
are one class first, and only its smallest ``doc_id`` takes part.  A shingle's
documents then meet in two steps, because a group of many near copies must not be
expanded into all its pairs: first each is compared with the one of them that has
the fewest rarer shingles; of the groups that these links form, only documents
of *different* groups are compared with each other, all of them.  Links left out
join documents that are connected already, so the components are exact.
``links`` leaves none out: it returns every link between different sets, and the
members of each set with their number of links.

Hot keys: equal sets are combined before the shuffle; what is known of a hot
shingle (its first document, its components) is aggregated before the shuffle and
joined back, where AQE splits the shingle's rows; a hot first document's partners
are dealt over several cells, its segments copied to each.

Defined cases: null or empty text has the empty set and links with nothing; fewer
words than a shingle form one shingle; repeated rows are equal sets; rows with
null ``doc_id`` link with nothing and have a null component; rows of one
``doc_id`` are one document, with the links of each of its texts; an empty table
gives no rows; further columns are ignored.  ``keep_one`` judges rows, whatever
their ``doc_id``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featurescope.operators.components import connected_components
from featurescope.runtime import discard, materialise

from .common import lower_words, small_batches, table, utf8, window_hashes, word_hashes

WIDTH = 5
BINS = 1 << 20
SLICES = 64
FRAGMENTS = 4
CELL = 1500
HOT_SHARE, HOT_SAMPLE, MOST_HOT = 0.001, 20_000, 100_000
_SHIFT = np.uint64(64 - 20)
#: A table of ids has 8 bits for each, from 2^20 to 2^28 (32 MB) in all; more ids than the largest holds are joined instead.
_LEAST_BITS, _MOST_BITS = 1 << 20, 1 << 28


def shingles(blob: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    w = word_hashes().of(lower_words(blob))
    if not len(w):
        return w
    if len(w) < width:
        return window_hashes(w, len(w)) ^ np.uint64(len(w))
    return np.unique(window_hashes(w, width))


class Order:
    """The global order: frequency level of each bin, and the cuts between fragments."""

    def __init__(self, counts: np.ndarray, fragments: int = FRAGMENTS):
        self.level = np.minimum(255, np.floor(4 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)
        weight = np.bincount(self.level.astype(np.int64), counts.astype(np.float64), 256)
        total, cum, cuts = max(1.0, weight.sum()), np.cumsum(weight), []
        for i in range(1, fragments):
            want = total * i / fragments
            at = min(255, int(np.searchsorted(cum, want)))
            part = 1 - (cum[at] - want) / max(1.0, weight[at])
            cuts.append((at << 56) + int(min(max(part, 0.0), 0.999) * (1 << 56)))
        self.cuts = np.array(cuts, np.uint64)

    def sorted(self, h: np.ndarray) -> np.ndarray:
        """Shingle numbers in global order: 8 bits of level, 56 of hash."""
        return np.sort(self.level[(h >> _SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8))

    def segments(self, s: np.ndarray) -> list[np.ndarray]:
        return np.split(s, np.searchsorted(s, self.cuts))


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def least_overlap(n, m):
    """Columns: the smallest intersection with which sets of ``n`` and ``m`` link."""
    return F.floor((4 * (n + m) + 8) / 9)


# ---------------------------------------------------------------- passes over the texts


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Rows of kind 0: doc_id, n, digest of each document; of kind 1: slices of the task's shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size, any_ = np.zeros(BINS, np.uint32), [], 0, False
        task = TaskContext.get().partitionId()
        for b in batches:
            n, digest = [], []
            for t in utf8(b.column(1)):
                h = shingles(t, width)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                if len(h):
                    held.append((h >> _SHIFT).astype(np.int64))
                    size += len(h)
                if size > BINS:
                    counts += np.bincount(np.concatenate(held), minlength=BINS).astype(np.uint32)
                    held, size, any_ = [], 0, True
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], names=["kind", "doc_id", "n", "data"])
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BINS).astype(np.uint32)
            any_ = True
        if any_:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array([1] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int64()), pa.array([task % 32] * SLICES, pa.int64()), pa.array(parts, pa.binary())], names=["kind", "doc_id", "n", "data"])

    return docs.mapInArrow(run, "kind int, doc_id long, n long, data binary")


def _sum_slices(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BINS // SLICES, np.uint64)
    for x in group["data"]:
        total += np.frombuffer(zlib.decompress(x), np.uint32)
    data = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
    return pd.DataFrame({"slot": group["slot"].iloc[:1], "data": [data]})


def _order(scan: DataFrame) -> Order:
    parts = scan.where("kind = 1").select(F.col("doc_id").alias("slot"), F.col("n").alias("part"), "data")
    some = parts.groupBy("slot", "part").applyInPandas(_sum_slices, "slot long, data binary")
    rows = some.groupBy("slot").applyInPandas(_sum_slices, "slot long, data binary").collect()  # SLICES rows
    counts = np.zeros(BINS, np.uint32)
    for r in rows:
        at = r.slot * (BINS // SLICES)
        counts[at : at + BINS // SLICES] = np.frombuffer(zlib.decompress(bytes(r.data)), np.uint32)
    return Order(counts)


def _id_table(ids: DataFrame) -> tuple[int, object] | None:
    """(bits, broadcast table): hash bits of the longs of the only column, false positives possible; None if there are too many."""
    (c,) = ids.columns
    n = ids.count()
    if 4 * n > _MOST_BITS:
        return None
    size = min(_MOST_BITS, max(_LEAST_BITS, 1 << (8 * n).bit_length()))
    at = F.pmod(F.xxhash64(c), F.lit(size))
    bits = ids.select(F.floor(at / 32768).cast("long").alias("bucket"), F.pmod(at, F.lit(32768)).alias("bit"))
    rows = bits.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("map")).collect()  # size / 32768 rows of 4 KB
    seen = np.zeros(size // 8, np.uint8)
    for r in rows:
        seen[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(bytes(r.map), np.uint8)
    return size, ids.sparkSession.sparkContext.broadcast(seen)


def _marked(seen: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (seen[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _with_hash(docs: DataFrame, size: int) -> DataFrame:
    return docs.where("doc_id is not null").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(size)))


def _prefixes(docs: DataFrame, shared, width: int, copies) -> DataFrame:
    """rep, n, prefix, doubtful of all documents; without ``doubtful`` a document is no copy of a smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            doubt = np.ones(b.num_rows, bool) if copies is None else _marked(copies[1].value, b.column(2).to_numpy())
            row, n, parts = [], [], []
            for i, t in enumerate(utf8(b.column(1))):
                s = order.sorted(shingles(t, width))
                if len(s):
                    row.append(i)
                    n.append(len(s))
                    parts.append(s[: prefix_length(len(s))].astype(np.int64))
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(doubt[np.array(row, np.int64)], pa.bool_())], names=["rep", "n", "prefix", "doubtful"])

    return _with_hash(docs, _LEAST_BITS if copies is None else copies[0]).mapInArrow(run, "rep long, n long, prefix array<long>, doubtful boolean")


def _segments(docs: DataFrame, wanted: DataFrame, shared, width: int) -> DataFrame:
    """rep, frag, seg of the wanted documents (``rep``, distinct), perhaps of a few others too."""
    packed = _id_table(wanted)
    if packed is None:  # so many that texts move to their ids
        docs = docs.join(wanted.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            if packed is not None:
                b = b.filter(pa.array(_marked(packed[1].value, b.column(2).to_numpy())))
            row, frag, seg = [], [], []
            for i, t in enumerate(utf8(b.column(1))):
                for f, x in enumerate(order.segments(order.sorted(shingles(t, width)))):
                    if len(x):
                        row.append(i)
                        frag.append(f)
                        seg.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(frag, pa.int32()), pa.array(seg, pa.binary())], names=["rep", "frag", "seg"])

    return _with_hash(docs, _LEAST_BITS if packed is None else packed[0]).mapInArrow(run, "rep long, frag int, seg binary")


# ---------------------------------------------------------------- partial overlaps


def _overlaps(cell: pa.Table) -> pa.Table:
    """a, b, overlap for one cell of one fragment: segments of first documents (role 0) and of their partners (role 1)."""
    rep, role, a, seg = (cell.column(c).to_pylist() for c in ("rep", "role", "a", "seg"))
    own_of = {r: np.frombuffer(x, np.uint64) for r, o, x in zip(rep, role, seg, strict=True) if o == 0}
    many: dict[int, dict[int, np.ndarray]] = {}
    for r, o, first, x in zip(rep, role, a, seg, strict=True):
        if o == 1 and first in own_of:
            many.setdefault(first, {})[r] = np.frombuffer(x, np.uint64)  # repeated rows count once
    out_a, out_b, out_n = [], [], []
    for first, partners in many.items():
        own, flat = own_of[first], np.concatenate(list(partners.values()))
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        size = [len(x) for x in partners.values()]
        out_a += [first] * len(size)
        out_b += partners
        out_n += np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *size[:-1]])).tolist()
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "overlap": pa.array(out_n, pa.int64())})


def _verified(pairs: DataFrame, docs: DataFrame, shared, width: int, name: str) -> DataFrame:
    """The pairs (a, na, b, nb) that link, as src and dst."""
    pairs = materialise(pairs, f"{name}-pairs")
    total = pairs.count()
    if not total:
        return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    wanted = materialise(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct(), f"{name}-wanted")
    cells = max(1, -(-total // CELL))
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("a", "part"), F.lit(cells)).alias("cell"))
    need = dealt.select(F.col("a").alias("rep"), F.lit(0).alias("role"), "a", "cell").distinct().unionByName(dealt.select(F.col("b").alias("rep"), F.lit(1).alias("role"), "a", "cell"))
    need = materialise(need, f"{name}-need")
    # each segment moves to its document's needs, then to the cells
    met = _segments(docs, wanted, shared, width).join(need.hint("merge"), "rep").select("frag", "cell", "rep", "role", "a", "seg")
    partial = met.groupBy("frag", "cell").applyInArrow(_overlaps, "a long, b long, overlap long")
    summed = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    links = pairs.join(summed, ["a", "b"]).where("9 * overlap >= 4 * (na + nb)")
    links = materialise(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), f"{name}-links")
    discard(pairs, wanted, need)
    return links


def _first_overlaps(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs that their prefixes' overlap still allows to link.

    A common shingle that is not in both prefixes comes after the prefix that ends first, so the overlap is at most
    that of the prefixes plus what its document has beyond.
    """
    side = lambda x: prefixes.select(F.col("rep").alias(x), F.col("tokens").alias(f"t{x}"), F.col("last").alias(f"l{x}"))
    beyond = F.when(F.col("la") <= F.col("lb"), _rest("na")).otherwise(_rest("nb"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect("ta", "tb")) + beyond >= least_overlap(F.col("na"), F.col("nb"))).select("a", "na", "b", "nb")


def _rest(n: str):
    """Column: shingles beyond a prefix (``n - prefix_length(n)``)."""
    return F.ceil(4 * F.col(n) / 5) - 1


def _may_link(n, at, m, bt):
    """Length and position filter at a shared shingle."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (F.least(n - at, m - bt) >= least_overlap(n, m))


@dataclass
class _Prepared:
    """What both joins start from."""

    docs: DataFrame
    shared: object  # the broadcast order
    own: DataFrame  # doc_id, n, digest of every row
    classes: DataFrame  # digest, rep
    tokens: DataFrame  # token, pos, n, rep, last, first: prefix shingles that several representatives share
    prefixes: DataFrame  # rep, tokens, last


def _prepared(docs: DataFrame, width: int) -> _Prepared:
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = materialise(_scan(docs, width), "jaccard-scan")
    shared = spark.sparkContext.broadcast(_order(scan))  # BINS levels, whatever the input
    own = scan.where("kind = 0").select("doc_id", "n", F.col("data").alias("digest"))
    known = own.where("digest is not null and doc_id is not null")
    classes = materialise(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "jaccard-classes")

    # only documents that may be copies of a smaller one (or share the hash bit of one) have to be looked up among the classes
    copies = _id_table(known.join(classes.withColumnRenamed("rep", "least"), "digest").where("doc_id <> least").select("doc_id"))
    every = materialise(_prefixes(docs, shared, width, copies), "jaccard-every")
    prefixes = every.where("not doubtful").unionByName(every.where("doubtful").join(classes.select("rep").hint("merge"), "rep", "left_semi")).drop("doubtful")
    tokens = prefixes.select("rep", "n", F.element_at("prefix", -1).alias("last"), F.posexplode("prefix").alias("pos", "token")).select("token", F.col("pos").cast("long").alias("pos"), "n", "rep", "last")
    tokens = tokens.where(F.col("n") - F.col("pos") >= F.ceil(0.8 * F.col("n") - 1e-9))
    hot = materialise(_hot_tokens(every), "jaccard-hot")
    tokens = materialise(_shared_tokens(tokens, hot), "jaccard-tokens")
    discard(every, hot)
    lists = materialise(tokens.groupBy("rep").agg(F.collect_list("token").alias("tokens"), F.first("last").alias("last")), "jaccard-prefixes")  # at most a prefix each
    return _Prepared(docs, shared, own, classes, tokens, lists)


def _hot_tokens(every: DataFrame) -> DataFrame:
    """token: those in the prefixes of about ``HOT_SHARE`` of all documents or more, by a sample of documents; at most ``MOST_HOT``.

    Both ways of ``_shared_tokens`` are exact, so a wrong guess costs time only.
    """
    part = min(1.0, HOT_SAMPLE / max(1, every.count()))
    drawn = every.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select(F.explode("prefix").alias("token"))
    n = drawn.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_SHARE * HOT_SAMPLE)
    return n.orderBy(F.desc("n"), "token").limit(MOST_HOT).select("token")


def _shared_tokens(tokens: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of tokens that several representatives hold, with ``first``: of these the one with the fewest rarer shingles.

    A token's rows meet in one task, by one shuffle; a hot token's are aggregated before theirs and joined back, which AQE splits.
    """
    first = F.min(F.struct("pos", "n", "rep"))
    by = Window.partitionBy("token")
    cold = tokens.join(F.broadcast(hot), "token", "left_anti").withColumn("many", F.count(F.lit(1)).over(by)).withColumn("first", first.over(by)).where("many > 1").drop("many")
    warm = tokens.join(F.broadcast(hot), "token", "left_semi")
    heads = warm.groupBy("token").agg(F.count(F.lit(1)).alias("many"), first.alias("first")).where("many > 1").drop("many")
    return cold.unionByName(warm.join(heads, "token"))


def _met(x: DataFrame, y: DataFrame, more=None) -> DataFrame:
    """The pairs (a, na, b, nb), each once, that meet at some shingle and may link."""
    x, y = x.alias("x"), y.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep")) & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    return x.join(y, on if more is None else on & more).select(F.col("x.rep").alias("a"), F.col("x.n").alias("na"), F.col("y.rep").alias("b"), F.col("y.n").alias("nb")).distinct()


def components(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    p = _prepared(docs, width)
    near = p.tokens.where("rep <> first.rep").where(_may_link(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos")))
    stars = near.select(F.col("first.rep").alias("a"), F.col("first.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb")).distinct()
    stars = materialise(stars, "jaccard-stars")
    links = [_verified(_first_overlaps(stars, p.prefixes), p.docs, p.shared, width, "jaccard-stars")]
    groups = connected_components(links[0])

    # documents of one shingle that are in different groups
    labelled = p.tokens.drop("first", "last").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = materialise(labelled, "jaccard-labelled")
    several = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    mixed = materialise(labelled.join(several, "token", "left_semi"), "jaccard-mixed")
    cross = _met(mixed, mixed, F.col("x.component") != F.col("y.component")).join(stars.select("a", "b").union(stars.select("b", "a")), ["a", "b"], "left_anti")
    links.append(_verified(_first_overlaps(cross, p.prefixes), p.docs, p.shared, width, "jaccard-cross"))

    # a repeated doc_id with several texts is one document
    ids = p.own.where("doc_id is not null").join(p.classes, "digest").select("doc_id", "rep").distinct()
    texts = ids.groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("dst")).where("src < dst")
    links.append(ids.join(texts, "doc_id").select("src", F.col("rep").alias("dst")))

    final = connected_components(reduce(DataFrame.unionByName, links))
    member = p.classes.join(final, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = p.own.join(member, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def links(docs: DataFrame, *, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every link between representatives of different sets (src < dst), and doc_id, n_shingles, rep, n_links of every row.

    ``rep`` is the smallest ``doc_id`` with the same set (null for an empty set or a null ``doc_id``); ``n_links``
    counts the other documents that a document links with, copies included.
    """
    p = _prepared(docs, width)
    pairs = _verified(_first_overlaps(_met(p.tokens, p.tokens), p.prefixes), p.docs, p.shared, width, "jaccard-links")
    known = p.own.where("digest is not null and doc_id is not null")
    sizes = known.groupBy("digest").agg(F.count_distinct("doc_id").alias("size")).join(p.classes, "digest").select("rep", "size")
    sizes = materialise(sizes, "jaccard-sizes")
    both = pairs.select(F.col("src").alias("rep"), F.col("dst").alias("other")).union(pairs.select(F.col("dst").alias("rep"), F.col("src").alias("other")))
    more = both.join(sizes.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("more"))
    counts = sizes.join(more, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    members = p.own.join(p.classes.join(counts, "rep"), "digest", "left")
    some = F.col("doc_id").isNotNull()
    return pairs, members.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("rep")).alias("rep"), F.when(some, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def keep_one(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each component: one of the smallest ``doc_id``; rows with empty sets all stay.

    Rows are judged, not ids: where ``doc_id`` is not unique or null, rows get numbers of their own first.
    """
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("doc_id").cast("long")).alias("ids")).first()
    if counts.n == counts.ids:
        gone = components(docs, width=width).where("doc_id <> component_id").select("doc_id")
        return docs.join(gone.withColumnRenamed("doc_id", "jaccard_gone_"), F.col("doc_id").cast("long") == F.col("jaccard_gone_"), "left_anti")
    rows = materialise(docs.withColumn("jaccard_row_", F.monotonically_increasing_id()), "jaccard-rows")
    found = components(rows.select(F.col("jaccard_row_").alias("doc_id"), "text"), width=width).select(F.col("doc_id").alias("jaccard_row_"), "component_id", F.col("n_shingles").alias("size_"))
    found = found.where("size_ > 0").join(rows.select("jaccard_row_", F.col("doc_id").cast("long").alias("id_")), "jaccard_row_")
    found = materialise(found, "jaccard-found")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id_").isNull().alias("none"), "id_", "jaccard_row_")).alias("best"))
    gone = found.join(best, "component_id").where("jaccard_row_ <> best.jaccard_row_").select("jaccard_row_")
    return rows.join(gone, "jaccard_row_", "left_anti").select(*docs.columns)


def op2_fragment_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


# Sets of equal shingles are one class; classes that share a shingle are counted; links close up to the smallest doc_id.
ORACLE_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < {WIDTH} then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i : i + {WIDTH - 1}], ' ')) end)) s from w),
c as (select s, min(doc_id) rep, len(s) n from s where len(s) > 0 group by s),
t as (select rep, n, unnest(s) x from c),
p as (select a.rep a, b.rep b from t a join t b on a.x = b.x and a.rep < b.rep where 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) group by a.rep, b.rep having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
d as (select distinct s.doc_id, c.rep from s join c on c.s = s.s),
l as (select a, b from p union select x.rep, y.rep from d x join d y on x.doc_id = y.doc_id and x.rep < y.rep),
e as (select a u, b v from l union all select b, a from l),
r as (select rep u, rep v from c union select r.u, e.v from r join e on e.u = r.v),
m as (select u, min(v) component_id from r group by u)
select s.doc_id, len(s.s)::bigint n_shingles, coalesce(m.component_id, s.doc_id) component_id from s left join c on c.s = s.s left join m on m.u = c.rep
"""
