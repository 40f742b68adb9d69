"""Cohorts from tables: the canonical columns (row_id, features, label / labels / targets, group_id) as projections.

Only the columns that a cohort needs are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cohort(df: DataFrame, *, row_id, features, label=None, labels=None, targets=None, group_id=None) -> DataFrame:
    """Project ``df`` to a cohort; each argument is a column or its name, ``features``, ``labels`` and ``targets`` may be lists of them."""

    def col(x) -> Column:
        return F.col(x) if isinstance(x, str) else x

    def array(x, kind: str) -> Column:
        return (F.array(*(col(c).cast(kind) for c in x)) if isinstance(x, (list, tuple)) else col(x)).cast(f"array<{kind}>")

    out = [col(row_id).alias("row_id"), array(features, "double").alias("features")]
    if label is not None:
        out.append(col(label).alias("label"))
    if labels is not None:
        out.append(array(labels, "int").alias("labels"))
    if targets is not None:
        out.append(array(targets, "double").alias("targets"))
    if group_id is not None:
        out.append(col(group_id).alias("group_id"))
    return df.select(*out)


def from_pandas(spark: SparkSession, X: pd.DataFrame, y, *, groups=None) -> DataFrame:
    """A cohort from an in-memory matrix and target: a series is a label, a frame of 0/1 columns is labels."""
    rows = pd.DataFrame({"row_id": range(len(X)), "features": X.astype(float).to_numpy().tolist()})
    if isinstance(y, pd.DataFrame):
        rows["labels"] = y.astype(int).to_numpy().tolist()
    else:
        rows["label"] = pd.Series(y).to_numpy().tolist()
    if groups is not None:
        rows["group_id"] = pd.Series(groups).to_numpy().tolist()
    return spark.createDataFrame(rows)


def from_long(df: DataFrame, n_features: int, *, row_id: str = "row_id", index: str = "feature_idx", value: str = "value") -> DataFrame:
    """row_id, features from the sparse form (row, feature, value); absent entries are 0."""
    m = df.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct(index, value))).alias("m"))
    return m.select(F.col(row_id).alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("features"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(_read(spark, sf_dir, "embeddings"), row_id="vec_id", features="embedding", label="label", group_id=F.col("vec_id") % 20)


def multilabel_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") / 1000.0).alias("size"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"))
    return cohort(_read(spark, sf_dir, "labels").join(d, "doc_id"), row_id="doc_id", features=["size", "spaces"], labels=["quality", "toxic"], group_id="source")


def regression_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.array("l_extendedprice", "l_quantity").alias("targets"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(_read(spark, sf_dir, "part"), row_id="p_partkey", features=["p_size", F.col("p_partkey") % 97], targets=["p_retailprice"], group_id=F.col("p_partkey") % 10)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("group_id"))
