"""Boundary rows: quantile thresholds over neighbourhood rows, joined with disagreeing predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescope.functions.arrays import jaccard


def single_boundary(rows: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """row_id and ``candidate`` of rows (entropy, ambiguity); ``predictions`` (row_id, linear, local), if all rows have them, adds disagreement."""
    cut = rows.agg(F.greatest(F.lit(0.25), F.expr("percentile(entropy, 0.75)")).alias("e"), F.greatest(F.lit(0.33), F.expr("percentile(ambiguity, 0.75)")).alias("a"))
    r = rows.crossJoin(F.broadcast(cut))  # one row of thresholds
    hit = ((F.col("entropy") > 0) & (F.col("entropy") >= F.col("e"))) | ((F.col("ambiguity") > 0) & (F.col("ambiguity") >= F.col("a")))
    if predictions is not None:
        r = r.join(predictions, "row_id", "left")
        whole = predictions.join(rows, "row_id", "left_semi").count() == rows.count()
        if whole:
            hit = hit | (F.col("linear") != F.col("local"))
    return r.select("row_id", F.coalesce(hit, F.lit(False)).alias("candidate"))


# Names of the triggers.
TRIGGERS = ("low_neighbor_jaccard", "high_neighbor_hamming", "high_local_label_entropy", "high_cardinality_variance", "linear_vs_local_prediction_disagreement")


def multilabel_boundary(rows: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """row_id, triggers (names), n_triggers, candidate (1 or more), strong (2 or more); ``predictions``: row_id, linear, local (0/1 arrays)."""
    r = rows
    if predictions is not None:
        r = r.join(predictions.select("row_id", jaccard(F.col("linear"), F.col("local")).alias("agreement")), "row_id", "left")
        whole = r.where("agreement is null").limit(1).count() == 0
        r = r if whole else r.withColumn("agreement", F.lit(None).cast("double"))
    else:
        r = r.withColumn("agreement", F.lit(None).cast("double"))
    cut = r.agg(
        F.least(F.lit(0.5), F.expr("percentile(jaccard, 0.25)")).alias("tj"),
        F.greatest(F.lit(0.1), F.expr("percentile(hamming, 0.75)")).alias("th"),
        F.greatest(F.lit(0.25), F.expr("percentile(entropy, 0.75)")).alias("te"),
        F.greatest(F.lit(0.5), F.expr("percentile(cardinality_std, 0.75)")).alias("tc"),
        F.least(F.lit(0.5), F.expr("percentile(agreement, 0.25)")).alias("ta"),
    )
    r = r.crossJoin(F.broadcast(cut))  # one row of thresholds
    c = F.col
    hits = (
        (c("jaccard") < 1) & (c("jaccard") <= c("tj")),
        (c("hamming") > 0) & (c("hamming") >= c("th")),
        (c("entropy") > 0) & (c("entropy") >= c("te")),
        (c("cardinality_std") > 0) & (c("cardinality_std") >= c("tc")),
        (c("agreement") < 1) & (c("agreement") <= c("ta")),
    )
    names = F.array_compact(F.array(*(F.when(h, F.lit(n)) for n, h in zip(TRIGGERS, hits, strict=True))))
    r = r.withColumn("triggers", names)
    return r.select("row_id", "triggers", F.size("triggers").alias("n_triggers"), (F.size("triggers") >= 1).alias("candidate"), (F.size("triggers") >= 2).alias("strong"))


def candidate_labels(boundary: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """label_idx, n: most frequent labels of the candidates."""
    rows = labels.join(boundary.where("candidate"), "row_id", "left_semi").select(F.posexplode("labels").alias("label_idx", "v")).where("v = 1")
    return rows.groupBy("label_idx").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label_idx").limit(k)
