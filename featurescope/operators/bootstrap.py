"""Paired bootstrap of probe scores.

Every resample is a set of row weights; all probes share them.  Draws come from
md5 of ``seed:resample:stratum:slot``, so they are the same everywhere.  Classes
are resampled within themselves; with groups, whole groups are drawn.  Resamples
are rows of a DataFrame, not driver loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurescope.runtime import discard, materialise

from .cohort import ranked
from .scoring import METRICS, scores

LEAST = 50


def _uniform(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def weights(df: DataFrame, repeats: int, seed: int = 0, *, strata: str | None = None, grouped: bool = False) -> DataFrame:
    """b, row_id, w: multiplicities of rows in ``repeats`` resamples.  ``strata``: resample within its values."""
    if grouped:
        units = ranked(df.select("group_id").distinct().withColumn("s", F.lit("all")), ["s"], seed, keys=("group_id",))
    else:
        units = ranked(df.select("row_id", (F.col(strata).cast("string") if strata else F.lit("all")).alias("s")), ["s"], seed)
    n = units.groupBy("s").agg(F.count(F.lit(1)).alias("n"))  # one row per stratum
    slots = units.select("s", F.col("rank").alias("slot")).join(F.broadcast(n), "s").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    picks = slots.select("b", "s", (F.floor(_uniform(F.lit(seed), F.col("b"), F.col("s"), F.col("slot")) * F.col("n")) + 1).cast("long").alias("rank")).groupBy("b", "s", "rank").agg(F.count(F.lit(1)).alias("w"))
    got = picks.join(units, ["s", "rank"])
    if grouped:
        return got.select("b", "group_id", "w").join(df.select("group_id", "row_id"), "group_id").select("b", "row_id", "w")
    return got.select("b", "row_id", "w")


def resampled_scores(predictions: DataFrame, w: DataFrame, mode: str) -> DataFrame:
    """b, probe, metric, score."""
    s = scores(w.join(predictions, "row_id"), mode, "b", "probe", weight="w")
    names = METRICS[mode]
    return s.select("b", "probe", F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in names)), F.array(*(F.col(m) for m in names)))).alias("metric", "score"))


def complete(cache: DataFrame, n_probes: int, n_metrics: int) -> DataFrame:
    """The resamples in which every probe has a finite score for every metric (a drawn set can lose a class)."""
    ok = cache.groupBy("b").agg(F.bool_and(F.col("score").isNotNull() & ~F.isnan("score")).alias("ok"), F.count(F.lit(1)).alias("n")).where(F.col("ok") & (F.col("n") == n_probes * n_metrics))
    return cache.join(ok.select("b"), "b", "left_semi")


def paired_deltas(cache: DataFrame, points: DataFrame) -> DataFrame:
    """first, second, metric: point_delta, mean_delta, paired_standard_error, lower_95, upper_95, resamples; ``points``: probe, metric, score."""
    x, y = cache.select("b", "metric", F.col("probe").alias("first"), F.col("score").alias("s1")), cache.select("b", "metric", F.col("probe").alias("second"), F.col("score").alias("s2"))
    d = x.join(y, ["b", "metric"]).where("first < second").withColumn("d", F.col("s1") - F.col("s2"))  # a few probes per resample
    g = d.groupBy("first", "second", "metric").agg(F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("paired_standard_error"), F.expr("percentile(d, 0.025)").alias("lower_95"), F.expr("percentile(d, 0.975)").alias("upper_95"), F.count(F.lit(1)).alias("resamples"))
    p1, p2 = points.select(F.col("probe").alias("first"), "metric", F.col("score").alias("a")), points.select(F.col("probe").alias("second"), "metric", F.col("score").alias("c"))
    return g.join(p1, ["first", "metric"]).join(p2, ["second", "metric"]).withColumn("point_delta", F.col("a") - F.col("c")).select("first", "second", "metric", "point_delta", "mean_delta", "paired_standard_error", "lower_95", "upper_95", "resamples")


def compared(df: DataFrame, predictions: DataFrame, mode: str, repeats: int, seed: int = 0, *, grouped: bool = False) -> list[dict] | None:
    """Paired comparisons of all probes, or None if fewer than max(50, repeats / 2) resamples can be scored."""
    strata = None
    if mode == "singlelabel" and not grouped:
        df, strata = df.withColumn("_s", F.col("y")[0].cast("int")), "_s"
    w = weights(df, repeats, seed, strata=strata, grouped=grouped)
    n = predictions.select("probe").distinct().count()
    cache = materialise(complete(resampled_scores(predictions, w, mode), n, len(METRICS[mode])), "resamples")
    if cache.select("b").distinct().count() < max(LEAST, repeats // 2):
        return None
    s = scores(predictions, mode, "probe")
    names = METRICS[mode]
    points = s.select("probe", F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in names)), F.array(*(F.col(m) for m in names)))).alias("metric", "score"))
    out = [r.asDict() for r in paired_deltas(cache, points).collect()]  # pairs of probes x metrics
    discard(cache)
    return out


def lookup(pairs: list[dict] | None, first: str | None, second: str | None, metric: str) -> dict | None:
    """The comparison of ``first`` with ``second``, turned round if need be."""
    for r in pairs or ():
        if r["metric"] == metric and (r["first"], r["second"]) == (first, second):
            return r
        if r["metric"] == metric and (r["second"], r["first"]) == (first, second):
            return r | {"first": first, "second": second, "point_delta": -r["point_delta"], "mean_delta": -r["mean_delta"], "lower_95": -r["upper_95"], "upper_95": -r["lower_95"]}
    return None
