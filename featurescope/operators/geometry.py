"""Shape of the feature cloud: scales, spectrum, concentration of distances."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescope.functions.arrays import distance

COMPONENTS = 10
PAIR_ROWS = 250


def feature_scales(df: DataFrame) -> DataFrame:
    """feature_idx, mean, std (population)."""
    return df.select(F.posexplode("features").alias("feature_idx", "x")).groupBy("feature_idx").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def scale_range(df: DataFrame) -> DataFrame:
    """One row: largest over smallest positive deviation (1 if all features are constant, or there is one)."""
    s = feature_scales(df).agg(F.max("std").alias("hi"), F.min(F.when(F.col("std") > 0, F.col("std"))).alias("lo"), F.count(F.lit(1)).alias("d"))
    return s.select(F.when((F.col("d") == 1) | (F.col("hi") <= 1e-6), F.lit(1.0)).otherwise(F.col("hi") / F.greatest("lo", F.lit(1e-9))).alias("scale_range"))


def spectrum(df: DataFrame, components: int = COMPONENTS) -> np.ndarray:
    """Shares of variance of the leading principal components, from a d x d covariance that is summed over partitions."""
    from pyspark.ml.feature import PCA

    d = df.select(F.size("features")).first()[0]
    n = df.count()
    k = min(components, d, max(1, n - 1))
    rows = df.select(array_to_vector("features").alias("v"))
    if d == 1:
        return np.ones(1)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    assert isinstance(model.pc, DenseMatrix)
    p = np.asarray(model.explainedVariance.toArray(), float)
    return np.where(np.isfinite(p) & (p > 0), p, 0.0)


def spectrum_summary(p: np.ndarray) -> dict:
    """effective_rank, intrinsic_dimension, degenerate; shares are scaled to sum 1 first."""
    total = float(p.sum())
    if total <= 1e-12:
        return {"effective_rank": 0.0, "intrinsic_dimension": 0.0, "degenerate": True}
    p = p / total
    return {"effective_rank": float(np.exp(-(p * np.log(np.clip(p, 1e-12, None))).sum())), "intrinsic_dimension": float((p > 1 / max(1, len(p))).sum()), "degenerate": False}


def concentration(df: DataFrame, rows: int = PAIR_ROWS) -> DataFrame:
    """One row: (largest - smallest) / mean distance between the first ``rows`` rows by id."""
    some = df.orderBy("row_id").limit(rows).select("row_id", "features")
    a, b = some.select(F.col("row_id").alias("i"), F.col("features").alias("a")), some.select(F.col("row_id").alias("j"), F.col("features").alias("b"))
    d = a.join(F.broadcast(b), F.col("i") < F.col("j")).select(distance(F.col("a"), F.col("b")).alias("d"))  # at most rows^2 / 2 pairs
    return d.agg(F.coalesce((F.max("d") - F.min("d")) / F.greatest(F.avg("d"), F.lit(1e-9)), F.lit(0.0)).alias("concentration"))


def geometry(df: DataFrame) -> dict:
    """All of it for a capped cohort."""
    n, d = df.count(), df.select(F.size("features")).first()[0]
    constant = feature_scales(df).agg(F.max("std")).first()[0] <= 1e-6
    out = spectrum_summary(np.zeros(1) if constant else spectrum(df))
    return out | {"scale_range": scale_range(df).first()[0], "concentration": concentration(df).first()[0], "high_dimensional": d > max(100, n // 2), "sample_to_feature_ratio": n / max(1, d)}
