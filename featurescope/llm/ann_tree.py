"""Operator 8: nearest neighbours by a hierarchical k-means tree.

Nearness is the inner product, so vectors get one more coordinate,
``sqrt(largest norm^2 - norm^2)``, in which the largest inner product is the
smallest distance.  A tree of k-means splits is fitted on a bounded sample
(``SAMPLE`` vectors by hash, equal ones once) and sent to all workers; it has
about ``2 * n^(1/3)`` leaves.  Every vector goes down the tree to one leaf.
A query walks the tree best bin first: a priority queue holds the nodes seen,
nearest centre on top.

How many leaves a query visits is calibrated: the exact neighbours of
``CALIBRATION`` queries (blocked products with all rows) tell which leaves had to
be visited, and visits widen until the mean recall there is ``RECALL``.  As many
queries again check that number: ``info`` gets the recall they had.  A query goes
on beyond that number until its leaves hold ``k + 1`` members.

Neighbouring leaves share a cell of at most ``CELL_BYTES`` of members (a larger
leaf is dealt over several); there are ``CELLS`` of them until the rows fill
those.  A member moves once to its cell for every ``QUERY_BYTES`` of the queries
that visit this cell, a query once to each cell that it visits, with the list of
its leaves there; each cell returns its nearest per query.  Of equal vectors only
the ``k + 1`` smallest ids of a leaf can ever be returned, so only those are kept
(the ranking's group limit does that before the shuffle).

Defined cases: vectors that are null, zero or hold null or non-finite components
take no part, nor do rows with null ``vec_id`` or a length other than the most
frequent one (ties to the smaller); repeated rows count once; with fewer than
``k`` candidates all are returned; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featurescope.runtime import materialise

from .common import small_batches, table

K = 20
SAMPLE = 20_000
CALIBRATION = 160
RECALL = 0.97
BRANCH = 6
CELLS = 16
CELL_BYTES = 32 << 20
QUERY_BYTES = 16 << 20


@dataclass
class Tree:
    """``children[i]``: the children of node i (empty: a leaf); ``centres[i]``: its centre; ``leaf[i]``: its number among leaves."""

    children: list[list[int]]
    centres: np.ndarray
    leaf: np.ndarray
    radius2: float  # largest squared norm

    @property
    def n_leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def lifted(self, X: np.ndarray) -> np.ndarray:
        return np.concatenate([X, np.sqrt(np.maximum(self.radius2 - (X**2).sum(1), 0))[:, None]], 1)

    def assign(self, X: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        Z, node = self.lifted(X), np.zeros(len(X), np.int64)
        live = np.arange(len(X))
        while len(live):
            for n in np.unique(node[live]):
                own = live[node[live] == n]
                kids = self.children[n]
                if kids:
                    C = self.centres[kids]
                    d = (C**2).sum(1) - 2 * np.einsum("id,jd->ij", Z[own], C)
                    node[own] = np.asarray(kids)[d.argmin(1)]
            live = live[[bool(self.children[n]) for n in node[live]]]
        return self.leaf[node]

    def visits(self, x: np.ndarray, n: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``n`` leaves of a best-bin-first walk; more, if these hold fewer than ``least`` members (``sizes`` by leaf)."""
        z = np.append(x, 0.0)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < n or sizes is not None and held < least):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(int(self.leaf[node]))
                held += 0 if sizes is None else int(sizes[out[-1]])
                continue
            d = ((self.centres[kids] - z) ** 2).sum(1)
            for c, v in zip(kids, d.tolist(), strict=True):
                heapq.heappush(queue, (v, c))
        return out


def _kmeans(X: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    C = X[rng.choice(len(X), k, replace=False)]
    for _ in range(rounds):
        at = ((C**2).sum(1) - 2 * X @ C.T).argmin(1)
        n = np.bincount(at, minlength=k)
        S = np.zeros_like(C)
        np.add.at(S, at, X)
        C = np.where(n[:, None] > 0, S / np.maximum(n, 1)[:, None], C)
    return C, ((C**2).sum(1) - 2 * X @ C.T).argmin(1)


def fit_tree(X: np.ndarray, leaves: int, radius2: float, *, branch: int = BRANCH, seed: int = 5) -> Tree:
    """Split the largest leaf by k-means until there are ``leaves`` of them."""
    rng = np.random.default_rng(seed)
    tree = Tree([[]], np.zeros((1, X.shape[1] + 1)), np.zeros(1, np.int64), radius2)
    Z = tree.lifted(np.unique(X, axis=0)) if len(X) else np.empty((0, X.shape[1] + 1))
    centres, children, rows = [Z.mean(0) if len(Z) else np.zeros(X.shape[1] + 1)], [[]], {0: np.arange(len(Z))}
    queue = [(-len(Z), 0)]
    while queue and len(queue) < leaves:
        size, n = heapq.heappop(queue)
        own = rows[n]
        k = min(branch, len(own), leaves - len(queue))
        if -size < 8 or k < 2:
            heapq.heappush(queue, (0, n))  # too small to split; all others are smaller
            break
        C, at = _kmeans(Z[own], k, rng)
        groups = [(c, own[at == j]) for j, c in enumerate(C) if (at == j).any()]
        if len(groups) < 2:
            heapq.heappush(queue, (0, n))
            continue
        del rows[n]
        for c, g in groups:
            children.append([])
            centres.append(c)
            children[n].append(len(children) - 1)
            rows[len(children) - 1] = g
            heapq.heappush(queue, (-len(g), len(children) - 1))
    leaf = np.full(len(children), -1)
    ends = [i for i, c in enumerate(children) if not c]
    leaf[ends] = np.arange(len(ends))
    return Tree(children, np.array(centres), leaf, radius2)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _best(q_ids: np.ndarray, Q: np.ndarray, ids: np.ndarray, X: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, member row, score) of each query's ``k`` best members, itself excepted; ties to the smaller id.

    A product of matrices finds them up to rounding; the scores are then summed row by row, so equal vectors get equal scores.
    """
    S = Q @ X.T
    S[q_ids[:, None] == ids[None]] = -np.inf
    least = min(k, len(ids))
    bound = np.partition(S, len(ids) - least, axis=1)[:, len(ids) - least]
    scale = 1e-9 * (1 + np.abs(bound))
    qi, xi = np.nonzero((S >= np.where(np.isfinite(bound), bound - scale, -np.finfo(float).max)[:, None]))
    score = np.concatenate([(Q[qi[i : i + 65536]] * X[xi[i : i + 65536]]).sum(1) for i in range(0, len(qi), 65536)]) if len(qi) else np.empty(0)
    order = np.lexsort((ids[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    first = np.searchsorted(qi, np.arange(len(Q)))
    keep = np.arange(len(qi)) - first[qi] < k
    return qi[keep], xi[keep], score[keep]


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, x (doubles) of the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where("vec_id is not null and x is not null and size(x) > 0").where("forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(x, v -> v <> 0)")
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("x") == (sizes[0].n if sizes else 0))


def _topk(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(rows: DataFrame, *, every: int = 20, k: int = K, recall: float = RECALL, sample: int = SAMPLE, leaves: int | None = None, info: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for queries with ``vec_id % every = 0`` against all rows (vec_id, embedding)."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = valid(rows)
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    n, radius2 = rows.agg(F.count(F.lit(1)), F.max(norm2)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    part = min(1.0, sample / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("x")
    X = np.array([r.x for r in drawn.collect()], np.float64)  # about ``sample`` vectors
    if not len(X):
        X = np.array([rows.first().x], np.float64)
    dim = X.shape[1]
    tree = fit_tree(X, leaves or max(1, round(2 * n ** (1 / 3))) if n >= 200 else 1, radius2 * (1 + 1e-12))
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            M = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(M), pa.int32()), b.column(0), pa.array([r.tobytes() for r in M], pa.binary())], names=["leaf", "vec_id", "x"])

    placed = materialise(rows.select("vec_id", "x").mapInArrow(assign, "leaf int, vec_id long, x binary"), "ann-leaves")
    same = Window.partitionBy("leaf", "x").orderBy("vec_id")
    members = placed.distinct().withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r")
    members = materialise(members, "ann-members")
    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "x").distinct()

    # calibration: exact neighbours of a few queries, and how far the walk must go for them
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(2 * CALIBRATION).collect()
    q_ids = np.array([r.query_id for r in some], np.int64)
    Q = np.frombuffer(b"".join(bytes(r.x) for r in some), "<f8").reshape(-1, dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(q_ids):
                ids = b.column(1).to_numpy()
                qi, xi, s = _best(q_ids, Q, ids, _matrix(b.column(2), dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(ids[xi]), pa.array(s), b.column(0).take(pa.array(xi))], names=["query_id", "vec_id", "score", "leaf"])

    truth = _topk(members.mapInArrow(exact, "query_id long, vec_id long, score double, leaf int"), k).select("query_id", "leaf").collect()
    sizes = np.zeros(tree.n_leaves, np.int64)
    for r in members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per leaf
        sizes[r.leaf] = r.n
    walk = {int(q): {leaf: i for i, leaf in enumerate(tree.visits(x, tree.n_leaves))} for q, x in zip(q_ids, Q, strict=True)}
    fit = set(q_ids[:CALIBRATION].tolist())
    depth = np.sort([walk[r.query_id][r.leaf] + 1 for r in truth if r.query_id in fit])
    visits = int(depth[max(0, int(np.ceil(recall * len(depth))) - 1)]) if len(depth) else tree.n_leaves
    if info is not None:
        apart = [walk[r.query_id][r.leaf] < visits for r in truth if r.query_id not in fit]
        info |= {"leaves": tree.n_leaves, "visits": visits, "rows": n, "recall_apart": float(np.mean(apart)) if apart else None}
    first, parts = _cells(sizes, max(1, CELL_BYTES // (8 * dim)), -(-int(sizes.sum()) // CELLS))
    plan = spark.sparkContext.broadcast((sizes, first, parts))  # three numbers per leaf

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, parts = plan.value
        for b in batches:
            row, cell, leaves = [], [], []
            for i, x in enumerate(_matrix(b.column(1), dim)):
                at: dict[int, list[int]] = {}
                for leaf in shared.value.visits(x, visits, held, k + 1):
                    for c in range(first[leaf], first[leaf] + parts[leaf]):
                        at.setdefault(int(c), []).append(leaf)
                row += [i] * len(at)
                cell += at
                leaves += at.values()
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), b.column(0).take(row), b.column(1).take(row), pa.array(leaves, pa.list_(pa.int32()))], names=["cell", "query_id", "x", "leaves"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = plan.value
        for b in batches:
            leaf = b.column(0).to_numpy()
            spread = b.column(1).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            cell = first[leaf] + (spread % parts[leaf].astype(np.uint64)).astype(np.int64) if len(leaf) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *b.columns], names=["cell", "leaf", "vec_id", "x"])

    asked = materialise(queries.mapInArrow(walks, "cell long, query_id long, x binary, leaves array<int>"), "ann-asked")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / max(1, QUERY_BYTES // (8 * dim))).cast("int").alias("blocks"))
    left = asked.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    right = members.select("leaf", "vec_id", "x").mapInArrow(deal, "cell long, leaf int, vec_id long, x binary").join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def meet(asked: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asked.num_rows and own.num_rows:
            q, Q = asked.column("query_id").to_numpy(), _matrix(asked.column("x"), dim)
            ids, M, leaf = own.column("vec_id").to_numpy(), _matrix(own.column("x"), dim), own.column("leaf").to_numpy()
            lists = asked.column("leaves").combine_chunks()
            who, which = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            for x in np.unique(which):
                m, own_q = np.flatnonzero(leaf == x), who[which == x]
                step = max(1, (4 << 20) // max(1, len(m)))
                for a in range(0, len(own_q) if len(m) else 0, step):
                    some = own_q[a : a + step]
                    qi, xi, s = _best(q[some], Q[some], ids[m], M[m], k)
                    out.append((q[some][qi], ids[m][xi], s))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = left.select("cell", "block", "query_id", "x", "leaves").groupBy("cell", "block").cogroup(right.select("cell", "block", "leaf", "vec_id", "x").groupBy("cell", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    return _topk(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cells(sizes: np.ndarray, most: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each leaf: leaves in order share cells of about ``wanted`` members, at most ``most``; a larger leaf has cells of its own."""
    room = max(1, min(most, wanted))
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    cell, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if n > room:
            cell += held > 0
            first[i], parts[i] = cell, -(-n // room)
            cell, held = cell + int(parts[i]), 0
            continue
        if held and held + n > room:
            cell, held = cell + 1, 0
        first[i], held = cell, held + n
    return first, parts


def op8_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
