"""Dataset audits of the three target modes: hash aggregations over all rows, uncapped."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurescope.functions.arrays import ones

from .cohort import USABLE_VARIANCE, class_counts, label_support


def class_audit(df: DataFrame) -> DataFrame:
    """label, n, proportion."""
    c = class_counts(df)
    return c.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per class


def single_audit(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_features, n_classes, imbalance, constant_feature_fraction, dense_mb."""
    c = class_counts(df).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), (F.max("n") / F.greatest(F.min("n"), F.lit(1))).alias("imbalance"))
    f = df.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    f = f.agg(F.count(F.lit(1)).alias("n_features"), F.avg((F.col("lo") == F.col("hi")).cast("double")).alias("constant_feature_fraction"))
    return c.crossJoin(f).withColumn("dense_mb", F.col("n_rows") * F.col("n_features") * 8 / F.lit(float(1 << 20)))  # two one-row tables


def sparsity(df: DataFrame) -> DataFrame:
    """One row: share of zero entries."""
    zero = F.aggregate("features", F.lit(0), lambda s, x: s + (x == 0).cast("int"))
    return df.agg((F.sum(zero) / F.sum(F.size("features"))).alias("sparsity"))


def multilabel_audit(df: DataFrame, rare: float = 0.05) -> DataFrame:
    """One row: sizes, usable, rare and constant labels, cardinality, density, all-zero share, counts of the labels."""
    c = ones(F.col("labels"))
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("labels")).alias("n_labels"), F.avg(c).alias("cardinality_mean"), F.stddev_pop(c).alias("cardinality_std"), F.avg((c == 0).cast("double")).alias("all_zero_fraction"))
    n = F.col("positives") + F.col("negatives")
    labels = label_support(df).agg(
        F.sum(F.col("usable").cast("long")).alias("usable_labels"),
        F.sum((F.col("positives") <= F.greatest(F.lit(5), F.floor(n * rare))).cast("long")).alias("rare_labels"),
        F.sum(((F.col("positives") == 0) | (F.col("negatives") == 0)).cast("long")).alias("constant_labels"),
        F.min("positives").alias("min_positives"),
        F.expr("percentile(positives, 0.5)").alias("median_positives"),
        F.max("positives").alias("max_positives"),
    )
    return rows.crossJoin(labels).withColumn("density", F.col("cardinality_mean") / F.col("n_labels"))


def top_labels(df: DataFrame, k: int = 10) -> DataFrame:
    """label_idx, positives of the most frequent labels that occur."""
    return label_support(df).where("positives > 0").orderBy(F.desc("positives"), "label_idx").limit(k).select("label_idx", "positives")


def regression_audit(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_targets, usable targets, smallest, median and largest variance, scale ratio of usable targets."""
    t = df.select(F.posexplode("targets").alias("target_idx", "y")).groupBy("target_idx").agg(F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("v"))
    ok = F.col("v") > USABLE_VARIANCE
    return t.agg(
        F.max("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_targets"),
        F.sum(ok.cast("long")).alias("usable_targets"),
        F.min("v").alias("min_variance"),
        F.expr("percentile(v, 0.5)").alias("median_variance"),
        F.max("v").alias("max_variance"),
        (F.max(F.when(ok, F.sqrt("v"))) / F.min(F.when(ok, F.sqrt("v")))).alias("scale_ratio"),
    )


def target_correlations(df: DataFrame) -> DataFrame:
    """i, j, corr for pairs of targets, from sums over all rows."""
    y = df.select(F.posexplode("targets").alias("i", "a"), "targets").select("i", "a", F.posexplode("targets").alias("j", "b")).where("i < j")
    return y.groupBy("i", "j").agg(F.corr("a", "b").alias("corr"))


def target_rank(correlations: dict[tuple[int, int], float], n: int) -> tuple[float, float]:
    """(effective rank, mean absolute correlation) of ``n`` targets: exp of the entropy of the correlation matrix's spectrum."""
    M = np.eye(n)
    for (i, j), c in correlations.items():
        M[i, j] = M[j, i] = c if np.isfinite(c) else 0.0
    p = np.clip(np.linalg.eigvalsh(M), 0, None)
    p = p[p > 0] / p.sum()
    return float(np.exp(-(p * np.log(p)).sum())), float(np.mean(np.abs(list(correlations.values())))) if correlations else 0.0
