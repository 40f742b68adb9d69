"""Exact nearest neighbours and what they say about labels.

``neighbors`` cuts the rows into blocks and compares every query block with every
member block in a cell of bounded size (a matrix product proposes, differences
decide), so no task grows with the input and nothing is broadcast.  Blocks are as
large as ``BLOCK_BYTES`` allows, because each row moves once for every block; below
that size there are a few blocks, to keep all cores busy.  Rows of equal features
are compared once.  The work is quadratic in what differs; the budgets cap the
rows, as the diagnosis needs only a sample.
Distances are Euclidean on the features as they are; ties go to the smaller
``row_id``; a row is never its own neighbour, by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurescope.functions.arrays import hamming, jaccard, label_entropy, ones, total
from featurescope.runtime import materialise

from .cohort import USABLE_VARIANCE

BLOCK_BYTES = 16 << 20
LEAST_BLOCKS, LEAST_ROWS = 4, 512
#: Rows for each point from which on points meet instead of rows; bytes of points that are broadcast.
COPIES, BROADCAST_BYTES = 2, 8 << 20


def default_k(n: int) -> int:
    """Neighbours for ``n`` rows: the root of n, from 3 to 15, below n."""
    return min(n - 1, min(15, max(3, int(n**0.5))))


def nearest(Q: np.ndarray, M: np.ndarray, qi: np.ndarray, mi: np.ndarray, k: int, qg: np.ndarray | None = None, mg: np.ndarray | None = None, *, itself: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour's id, distance) of the ``k`` nearest members of each query, nearest first, ties by id.

    Left out are members of the query's id (unless ``itself``) and, with ``qg`` and ``mg``, those of its group.
    """
    m2, order_m = (M**2).sum(1), np.argsort(mi, kind="stable")
    M, mi, m2 = M[order_m], mi[order_m], m2[order_m]
    mg = None if mg is None else mg[order_m]
    step, out = max(1, (4 << 20) // len(mi)), []
    for a in range(0, len(qi), step):
        P, own = Q[a : a + step], qi[a : a + step]
        p2 = (P**2).sum(1)
        d2 = (-2 * P) @ M.T  # squared distance, less what the query adds to all
        d2 += m2
        if not itself:
            left, right = np.searchsorted(mi, own), np.searchsorted(mi, own, "right")
            for i in np.flatnonzero(left < right):
                d2[i, left[i] : right[i]] = np.inf
        if mg is not None:
            d2[qg[a : a + step][:, None] == mg[None]] = np.inf
        least = min(k, len(mi))
        bound = np.partition(d2, least - 1, axis=1)[:, least - 1]
        slack = 1e-9 * (1 + p2 + m2.max())
        at, to = np.nonzero(d2 <= np.minimum(bound + slack, np.finfo(float).max)[:, None])
        dist = np.sqrt(np.concatenate([((P[at[i : i + 65536]] - M[to[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(at), 65536)])) if len(at) else np.empty(0)
        order = np.lexsort((to, dist, at))  # members ascend by id
        at, to, dist = at[order], to[order], dist[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((own[at[keep]], mi[to[keep]], dist[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cell(k: int, other_group: bool, itself: bool):
    def run(q: pa.Table, m: pa.Table) -> pa.Table:
        if not q.num_rows or not m.num_rows:
            return pa.table({"row_id": pa.array([], pa.int64()), "neighbor_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        mat = lambda t: np.asarray(t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1)
        ids = lambda t, c: t.column(c).to_numpy()
        groups = (ids(q, "g"), ids(m, "g")) if other_group else ()
        return pa.table(list(nearest(mat(q), mat(m), ids(q, "row_id"), ids(m, "row_id"), k, *groups, itself=itself)), names=["row_id", "neighbor_id", "distance"])

    return run


def nearest_rows(rows: DataFrame, n: int, width: int, k: int, *, other_group: bool = False, itself: bool = False, block: int | None = None) -> DataFrame:
    """row_id, neighbor_id, distance, rank (see ``neighbors``) for rows of row_id, features, g and a: only rows of the same ``a``, ``n`` each, meet."""
    most = block or max(256, BLOCK_BYTES // (8 * max(1, width or 1)))
    blocks = max(1, -(-n // most), 0 if block else min(LEAST_BLOCKS, -(-n // LEAST_ROWS)))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = rows.select(*(F.col(c).alias(c) for c in ("row_id", "features", "g", "a")), F.col("b").alias("qb"), every.alias("mb"))
    m = rows.select(*(F.col(c).alias(c) for c in ("row_id", "features", "g", "a")), F.col("b").alias("mb"), every.alias("qb"))
    found = q.groupBy("a", "qb", "mb").cogroup(m.groupBy("a", "qb", "mb")).applyInArrow(_cell(k, other_group, itself), "row_id long, neighbor_id long, distance double")
    by = Window.partitionBy("row_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def neighbors(df: DataFrame, k: int, *, other: Column | None = None, carry: Column | None = None, block: int | None = None) -> DataFrame:
    """row_id, neighbor_id, distance, rank of the ``k`` nearest rows; with ``other``, only rows where that (long) value differs.

    ``row_id`` must be a long.  Rows without any admissible neighbour do not occur.
    With ``carry``, an array of numbers, also its value at both ends: own and near.
    Where at most one row in ``COPIES`` has features of its own, only points meet (see ``_by_points``).
    """
    rows = df.select(F.col("row_id").cast("long").alias("row_id"), "features", (F.lit(0).cast("long") if other is None else other.cast("long")).alias("g"), *([] if carry is None else [carry.alias("own")]))
    kinds = F.approx_count_distinct(F.xxhash64("features", "g"))
    carried = F.lit(-1) if carry is None else F.max(F.size("own"))
    n, width, whole, kinds, carried = rows.agg(F.count(F.lit(1)), F.max(F.size("features")), F.count(F.when(F.col("features").isNotNull(), F.col("g"))), kinds, carried).first()
    if n == whole and kinds * COPIES <= n:
        return _by_points(rows, kinds, width, k, other is not None, block, carried)
    edges = nearest_rows(rows.select("row_id", "features", "g", F.lit(0).alias("a")), n, width, k, other_group=other is not None, block=block)
    return edges if carry is None else at_both_ends(edges, rows.select("row_id", "own"))


def at_both_ends(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``edges`` with the value (row_id, value) of the row and of its neighbour: own, near."""
    key, value = values.columns
    e = edges.join(values.select(F.col(key).alias("row_id"), F.col(value).alias("own")), "row_id")
    return e.join(values.select(F.col(key).alias("neighbor_id"), F.col(value).alias("near")), "neighbor_id")


def _by_points(rows: DataFrame, kinds: int, width: int, k: int, cross: bool, block: int | None, carried: int | None = -1) -> DataFrame:
    """``neighbors`` of about ``kinds`` points: the rows of equal features (and group, if ``cross``).

    The k nearest rows lie in the k points that come first by distance and smallest
    id, as each point before a row's own has a row before it, and are among the
    first k ids of these.  Without ``cross`` k is one more, as the row itself
    is among them.  What rows carry goes with these ids, so edges are not joined.
    """
    most, has = k if cross else k + 1, "own" in rows.columns
    first = F.row_number().over(Window.partitionBy(F.xxhash64("features", "g"), "features", "g").orderBy("row_id"))  # cut within each task, before the shuffle; most rows sort by a number, not by an array
    member = F.when(F.col("row_id").isNotNull(), F.struct(F.col("row_id").alias("id"), *([F.col("own").alias("near")] if has else [])))
    few = rows.withColumn("r", first).where(F.col("r") <= most).groupBy("features", "g").agg(F.sort_array(F.collect_list(member)).alias("ids"))  # at most k + 1
    points = materialise(few.withColumn("p", F.col("ids")[0]["id"]), "points")
    met = nearest_rows(points.select(F.col("p").alias("row_id"), "features", "g", F.lit(0).alias("a")), kinds, width, most, other_group=cross, itself=not cross, block=block)
    members = met.select(F.col("row_id").alias("p"), F.col("neighbor_id").alias("q"), "distance").join(points.select(F.col("p").alias("q"), "ids"), "q")
    each = F.transform("ids", lambda i: F.struct(F.col("distance"), i["id"].alias("id"), *([i["near"].alias("near")] if has else [])))
    near = members.select("p", each.alias("each")).groupBy("p").agg(F.slice(F.sort_array(F.flatten(F.collect_list("each"))), 1, most).alias("nearest"))  # k + 1 lists of k + 1 at most
    near = points.select("features", "g", "p").join(near, "p").select("features", "g", "nearest", F.col("nearest.id").alias("ids"))
    if kinds * (8 * width + (56 + (24 + 8 * max(0, carried or 0) if has else 0)) * most) <= BROADCAST_BYTES:
        near, rows = F.broadcast(near), rows.repartition("row_id")  # a small table's rows may stand in one task; edges then lie by row_id
    itself = F.array_position("ids", F.col("row_id"))  # 0 if it is not there
    found = rows.join(near, ["features", "g"]).select("row_id", itself.cast("int").alias("itself"), *(["own"] if has else []), F.posexplode("nearest").alias("at", "x"))
    rank = F.col("at") + F.when((F.col("itself") > 0) & (F.col("itself") <= F.col("at")), 0).otherwise(1)
    found = found.where(F.col("at") + 1 != F.col("itself")).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("row_id", F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"), "rank", *(["own", F.col("x.near").alias("near")] if has else []))


def group_code(df: DataFrame, column: str = "group_id") -> DataFrame:
    """``df`` with the group as a long ``g`` (a 64-bit hash for other types)."""
    whole = dict(df.dtypes)[column] in ("bigint", "int", "smallint", "tinyint")
    return df.withColumn("g", F.col(column).cast("long") if whole else F.xxhash64(column))


# ---------------------------------------------------------------- single label


def single_rows(edges: DataFrame, labels: DataFrame, n_classes: int) -> DataFrame:
    """Per row: entropy (0 to 1), ambiguity, same-class share, nearest enemy among the neighbours.  ``labels``: row_id, label."""
    e = edges.join(labels.select("row_id", F.col("label").alias("own")), "row_id")
    e = e.join(labels.select(F.col("row_id").alias("neighbor_id"), F.col("label").alias("near")), "neighbor_id")
    c = e.groupBy("row_id", "near").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("near") == F.col("own")).cast("long")).alias("same"), F.min(F.when(F.col("near") != F.col("own"), F.col("distance"))).alias("enemy"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("row_id"))
    c = c.withColumn("p", p)
    scale = max(float(np.log(max(2, n_classes))), 1e-9)
    return c.groupBy("row_id").agg(
        (-F.sum(F.col("p") * F.log("p")) / F.lit(scale)).alias("entropy"),
        (1 - F.max("p")).alias("ambiguity"),
        (F.sum("same") / F.sum("n")).alias("same_share"),
        F.min("enemy").alias("enemy_distance"),
    )


def single_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("entropy").alias("mean_local_entropy"),
        F.avg((F.col("entropy") >= 0.5).cast("double")).alias("high_entropy_fraction"),
        F.avg("same_share").alias("same_class_neighbor_fraction"),
        (1 - F.avg("same_share")).alias("cross_class_neighbor_fraction"),
        F.avg("enemy_distance").alias("nearest_enemy_distance"),
        F.avg("ambiguity").alias("mean_local_ambiguity"),
    )


# ---------------------------------------------------------------- multilabel


def multilabel_rows(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: mean Jaccard and Hamming to its neighbours, their label entropy and cardinality spread; counts for pair means."""
    e = edges.join(labels.select("row_id", F.col("labels").alias("own")), "row_id").join(labels.select(F.col("row_id").alias("neighbor_id"), F.col("labels").alias("near")), "neighbor_id")
    own, near = F.col("own"), F.col("near")
    e = e.withColumn("j", jaccard(own, near)).withColumn("h", hamming(own, near)).withColumn("c", ones(near).cast("double"))
    e = e.withColumn("void", ((ones(own) + ones(near)) == 0).cast("long"))
    rates = e.select("row_id", F.posexplode("near").alias("i", "v")).groupBy("row_id", "i").agg(F.avg(F.col("v").cast("double")).alias("r")).groupBy("row_id").agg(F.collect_list("r").alias("rates"))  # one entry per label
    rows = e.groupBy("row_id").agg(F.avg("j").alias("jaccard"), F.avg("h").alias("hamming"), F.stddev_pop("c").alias("cardinality_std"), F.count(F.lit(1)).alias("pairs"), F.sum("j").alias("jaccard_sum"), F.sum("h").alias("hamming_sum"), F.sum((F.col("j") < 0.25).cast("long")).alias("low"), F.sum("void").alias("void"))
    return rows.join(rates.select("row_id", label_entropy(F.col("rates")).alias("entropy")), "row_id")


def multilabel_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.sum("jaccard_sum") / F.sum("pairs")).alias("mean_neighbor_jaccard"),
        (F.sum("hamming_sum") / F.sum("pairs")).alias("mean_neighbor_hamming"),
        (F.sum("low") / F.sum("pairs")).alias("low_jaccard_fraction"),
        F.avg("entropy").alias("mean_label_entropy"),
        F.avg((F.col("entropy") >= 0.5).cast("double")).alias("high_entropy_fraction"),
        F.avg("cardinality_std").alias("cardinality_local_std"),
        (F.sum("void") / F.sum("pairs")).alias("all_zero_pair_fraction"),
    )


# ---------------------------------------------------------------- regression


def standardised(df: DataFrame) -> Column:
    """``targets`` of ``df`` less their mean over their population deviation (1 where constant); two numbers per target are collected."""
    y = df.select(F.posexplode("targets").alias("i", "y"))
    d = F.stddev_pop("y")
    s = sorted(y.groupBy("i").agg(F.avg("y"), F.when(d > USABLE_VARIANCE, d).otherwise(1.0)).collect())
    mean, by = (F.lit([r[at] for r in s]).cast("array<double>") for at in (1, 2))
    return F.when(F.size("targets") > 0, F.transform("targets", lambda y, i: (y - F.get(mean, i)) / F.get(by, i)))


def standardised_targets(df: DataFrame) -> DataFrame:
    """row_id, z: the ``standardised`` targets of rows that have any."""
    return df.select("row_id", standardised(df).alias("z")).where(F.col("z").isNotNull())


def regression_rows(edges: DataFrame, z: DataFrame | None = None) -> DataFrame:
    """row_id, target_distance: mean distance of standardised targets (row_id, z) to the neighbours'; without ``z``, ``edges`` carry them."""
    e = edges.where(F.col("own").isNotNull() & F.col("near").isNotNull()) if z is None else at_both_ends(edges, z)
    d = F.sqrt(total(F.zip_with("own", "near", lambda a, b: (a - b) * (a - b))))
    return e.groupBy("row_id").agg(F.avg(d).alias("target_distance"))


def regression_summary(rows: DataFrame, z: DataFrame) -> DataFrame:
    scale = z.agg(F.greatest(F.sqrt(F.avg(total(F.transform("z", lambda a: a * a)))), F.lit(1e-12)).alias("scale"))
    r = rows.crossJoin(F.broadcast(scale)).withColumn("norm", F.col("target_distance") / F.col("scale"))  # one row of scale
    return r.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("target_distance").alias("mean_target_distance"),
        F.avg("norm").alias("mean_normalized_distance"),
        (1 / (1 + F.avg("norm"))).alias("smoothness"),
        F.avg((F.col("norm") >= 1).cast("double")).alias("discontinuity_fraction"),
    )
