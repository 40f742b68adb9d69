"""Neighbour graphs over boundary rows: how far they fall apart, and how labels sit on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurescope.functions.arrays import hamming, jaccard, ones
from featurescope.runtime import materialise

from .components import connected_components
from .neighbors import nearest, nearest_rows, neighbors

GRAPH_K = 10
#: Rows up to which a resample of the bootstrap is one task.
ONE_TASK_ROWS = 5000
DRAWS_AT_ONCE = 1 << 20


def knn_graph(df: DataFrame, *, other: Column | None = None, k: int = GRAPH_K) -> DataFrame:
    """src < dst: pairs of which one is among the other's ``k`` nearest."""
    n = df.count()
    e = neighbors(df, max(1, min(n - 1, k)), other=other)
    return e.select(F.least("row_id", "neighbor_id").alias("src"), F.greatest("row_id", "neighbor_id").alias("dst")).distinct()


def mutual_graph(df: DataFrame, k: int) -> DataFrame:
    """src < dst: pairs that are among each other's ``k`` nearest."""
    e = materialise(neighbors(df, k).select("row_id", "neighbor_id"), "mutual")
    back = e.select(F.col("row_id").alias("neighbor_id"), F.col("neighbor_id").alias("row_id"))
    return e.intersect(back.select("row_id", "neighbor_id")).where("row_id < neighbor_id").select(F.col("row_id").alias("src"), F.col("neighbor_id").alias("dst"))


def graph_components(df: DataFrame, edges: DataFrame) -> DataFrame:
    """row_id, component of every row (its own id where it has no edge)."""
    c = connected_components(edges)
    return df.select("row_id").join(c.select(F.col("node").alias("row_id"), "component"), "row_id", "left").select("row_id", F.coalesce("component", "row_id").alias("component"))


def fragmentation(components: DataFrame) -> DataFrame:
    """One row: component_count, largest_fraction, size_entropy, small_components (3 rows or fewer), fragmentation."""
    return _of_sizes(components.groupBy("component").agg(F.count(F.lit(1)).alias("n")))


def _of_sizes(sizes: DataFrame, *by: str) -> DataFrame:
    """``fragmentation`` of components of ``n`` nodes, for each ``by``."""
    n = F.col("n").cast("double")
    s = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("component_count"), F.sum("n").alias("n_rows"), F.max("n").alias("most"), F.sum(n * F.log(n)).alias("nlogn"), F.sum((F.col("n") <= 3).cast("long")).alias("small_components"))
    # -sum p ln p = ln N - sum n ln n / N
    entropy = (F.log("n_rows") - F.col("nlogn") / F.col("n_rows")) / F.greatest(F.log(F.greatest(F.lit(2), F.col("component_count"))), F.lit(1e-9))
    out = s.select(*by, "component_count", "n_rows", (F.col("most") / F.col("n_rows")).alias("largest_fraction"), F.greatest(F.lit(0.0), entropy).alias("size_entropy"), "small_components")
    scaled = F.least(F.lit(1.0), F.col("component_count") / F.greatest(F.lit(3.0), F.col("n_rows") / 20))
    mean = (1 - F.col("largest_fraction") + scaled + F.col("size_entropy")) / 3
    return out.withColumn("fragmentation", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))


def cross_class_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: share of edges between classes."""
    e = edges.join(labels.select(F.col("row_id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("row_id").alias("dst"), F.col("label").alias("b")), "dst")
    return e.agg(F.coalesce(F.avg((F.col("a") != F.col("b")).cast("double")), F.lit(0.0)).alias("cross_class_edge_fraction"))


def multilabel_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean Jaccard and Hamming over edges, share of edges with Jaccard below 0.25."""
    e = edges.join(labels.select(F.col("row_id").alias("src"), F.col("labels").alias("a")), "src").join(labels.select(F.col("row_id").alias("dst"), F.col("labels").alias("b")), "dst")
    j = jaccard(F.col("a"), F.col("b"))
    return e.agg(F.coalesce(F.avg(j), F.lit(1.0)).alias("mean_edge_jaccard"), F.coalesce(F.avg(hamming(F.col("a"), F.col("b"))), F.lit(0.0)).alias("mean_edge_hamming"), F.coalesce(F.avg((j < 0.25).cast("double")), F.lit(0.0)).alias("low_overlap_edge_fraction"))


def multilabel_components(components: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean over components of distinct label sets per row, and of the variance of the cardinality."""
    c = components.join(labels, "row_id").withColumn("key", F.concat_ws("", F.transform("labels", lambda v: v.cast("string"))))
    g = c.groupBy("component").agg((F.count_distinct("key") / F.count(F.lit(1))).alias("d"), F.var_pop(ones(F.col("labels")).cast("double")).alias("v"))
    return g.agg(F.avg("d").alias("component_label_diversity"), F.avg("v").alias("component_cardinality_variance"))


def capped_components(df: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``graph_components``, for a cohort that a budget caps: all its edges meet in one task, with no rounds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf[["src", "dst"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        return pd.DataFrame({"row_id": ids, "component": ids[_roots(at[:, 0], at[:, 1], len(ids))]})

    c = edges.groupBy(F.lit(0).alias("one")).applyInPandas(run, "row_id long, component long")
    return df.select("row_id").join(c, "row_id", "left").select("row_id", F.coalesce("component", "row_id").alias("component"))


def _roots(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The smallest number in each number's component."""
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64)


def _score(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> float:
    sizes = np.bincount(_roots(src, dst, len(weight)), weights=weight)
    p = sizes[sizes > 0] / weight.sum()
    entropy = -(p * np.log(p)).sum() / max(np.log(max(2, len(p))), 1e-9)
    return float(np.clip(np.mean([1 - p.max(), min(1.0, len(p) / max(3, weight.sum() / 20)), entropy]), 0, 1))


def fragmentation_bootstrap(df: DataFrame, repeats: int, seed: int = 0, *, grouped: bool = False, k: int = GRAPH_K) -> DataFrame:
    """b, fragmentation of ``repeats`` resamples (rows, or whole groups); each draw is a node, linked with its ``k`` nearest.

    Draws with equal vectors form a point.  A node's neighbours are the others of
    its point, then the nearest points, until there are ``k`` (of points at one
    distance that with the smallest row_id first), so only points are compared and
    a component has all draws of its points.  Up to ``ONE_TASK_ROWS`` rows each
    resample is one task; of more, the points of all resamples are compared in
    the cells of ``neighbors``.
    """
    if grouped:
        df = df.where("group_id is not null")
    n = df.count()
    return _one_task_bootstrap(df, repeats, seed, grouped, k) if n <= ONE_TASK_ROWS else _wide_bootstrap(df, n, repeats, seed, grouped, k)


def _one_task_bootstrap(df: DataFrame, repeats: int, seed: int, grouped: bool, k: int) -> DataFrame:
    cols = ["row_id", "features"] + (["group_id"] if grouped else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["b"].iloc[0])
        rng = np.random.default_rng([seed, b])
        pdf = pdf.sort_values("row_id")
        if grouped:
            parts = {g: x for g, x in pdf.groupby("group_id").indices.items()}
            at = np.concatenate([parts[g] for g in rng.choice(sorted(parts, key=str), len(parts))])
        else:
            at = rng.integers(0, len(pdf), len(pdf))
        at, drawn = np.unique(at, return_counts=True)
        X, first, own = np.unique(np.stack(pdf["features"].to_numpy())[at] + 0.0, axis=0, return_index=True, return_inverse=True)  # 0 and -0 are equal
        weight = np.bincount(own.ravel(), weights=drawn)
        order = np.argsort(first)  # points ascend by their smallest row_id
        X, weight = X[order], weight[order]
        ids = np.arange(len(X))
        src, dst, _ = nearest(X, X, ids, ids, k)
        before = np.cumsum(weight[dst]) - weight[dst]
        before -= before[np.searchsorted(src, src)]
        keep = weight[src] - 1 + before < k
        return pd.DataFrame({"b": [b], "fragmentation": [_score(src[keep], dst[keep], weight)]})

    copies = df.select(*cols).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))  # repeats is at most 10
    return copies.groupBy("b").applyInPandas(run, "b int, fragmentation double")


def _positions(df: DataFrame, key: Column) -> DataFrame:
    """``df`` with ``at``: its rows numbered from 0 by ``key``."""
    low = (1 << 33) - 1  # monotonically_increasing_id has the partition above these bits
    sort = df.withColumn("_k", key).repartitionByRange("_k").sortWithinPartitions("_k").drop("_k")
    sort = materialise(sort.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33)), "positions")
    before, seen = [], 0
    for part, n in sorted(sort.groupBy("_part").count().collect()):  # one row per partition
        before.append((part, seen))
        seen += n
    before = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return sort.join(F.broadcast(before), "_part").withColumn("at", F.col("_before") + F.col("_m").bitwiseAND(F.lit(low))).drop("_part", "_before", "_m")


def _draws(units: DataFrame, n: int, repeats: int, seed: int) -> DataFrame:
    """``units`` (with ``at`` below ``n``) drawn in each resample: b, w (how often); every task goes through the same stream of draws."""

    def run(batches):
        own = list(batches)
        if not own:
            return
        own = pa.Table.from_batches(own)
        at = own.column("at").to_numpy()
        if not len(at):
            return
        low, high = int(at.min()), int(at.max())
        for b in range(repeats):
            rng, count = np.random.default_rng([seed, b]), np.zeros(high - low + 1, np.int64)
            for s in range(0, n, DRAWS_AT_ONCE):
                x = rng.integers(0, n, min(DRAWS_AT_ONCE, n - s))
                count += np.bincount(x[(x >= low) & (x <= high)] - low, minlength=len(count))
            w = count[at - low]
            got = own.filter(pa.array(w > 0)).append_column("b", pa.array(np.full((w > 0).sum(), b, np.int32))).append_column("w", pa.array(w[w > 0]))
            yield from got.to_batches(max_chunksize=10_000)

    return units.mapInArrow(run, units.select("*").schema.add("b", "integer").add("w", "long"))


def _wide_bootstrap(df: DataFrame, n: int, repeats: int, seed: int, grouped: bool, k: int) -> DataFrame:
    at = _positions(df.select("row_id", "features", *(["group_id"] if grouped else [])), F.col("row_id"))
    if grouped:
        groups = _positions(df.select("group_id").distinct(), F.col("group_id").cast("string"))
        drawn = _draws(groups, groups.count(), repeats, seed).drop("at")
        rows = at.join(drawn, "group_id")
    else:
        rows = at.join(_draws(at.select("row_id", "at"), n, repeats, seed).drop("at"), "row_id")
    points = rows.groupBy("b", "features").agg(F.sum("w").alias("w"), (F.col("b") * F.lit(n) + F.min("at")).alias("node"))
    points = materialise(points.select("b", "node", "features", "w"), "bootstrap-points")
    most = points.groupBy("b").count().agg(F.max("count")).first()[0]
    width = points.agg(F.max(F.size("features"))).first()[0]
    near = nearest_rows(points.select(F.col("node").alias("row_id"), "features", F.lit(0).alias("g"), F.col("b").alias("a")), most, width, k)
    weight = lambda c, w: points.select(F.col("node").alias(c), F.col("w").alias(w))
    near = near.join(weight("neighbor_id", "_near"), "neighbor_id").join(weight("row_id", "_own"), "row_id")
    before = F.coalesce(F.sum("_near").over(Window.partitionBy("row_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    links = near.withColumn("_before", before).where(F.col("_own") - 1 + F.col("_before") < k)
    c = connected_components(links, "row_id", "neighbor_id")
    parts = points.join(c, "node", "left").groupBy("b", F.coalesce("component", "node").alias("component")).agg(F.sum("w").alias("n"))
    return _of_sizes(parts, "b").select("b", "fragmentation")
