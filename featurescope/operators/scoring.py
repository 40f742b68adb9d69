"""Scores of predictions, as aggregations over (row_id, probe, y, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurescope.functions.arrays import both, jaccard, ones

METRICS = {"singlelabel": ("balanced_accuracy",), "multilabel": ("micro_f1", "macro_f1", "sample_jaccard"), "regression": ("r2_variance_weighted", "r2_uniform_average")}
USABLE = 1e-12


def confusion(p: DataFrame, *by: str, weight: Column | None = None) -> DataFrame:
    """by, y, p, n."""
    w = F.lit(1) if weight is None else weight
    return p.groupBy(*by, F.col("y")[0].cast("int").alias("y"), F.col("prediction")[0].cast("int").alias("p")).agg(F.sum(w).alias("n"))


def single_scores(c: DataFrame, *by: str) -> DataFrame:
    """by, balanced_accuracy, accuracy, macro_f1 from ``confusion``."""
    c = c.withColumn("hit", F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
    t = c.groupBy(*by, F.col("y").alias("c")).agg(F.sum("n").alias("support"), F.sum("hit").alias("tp"))
    q = c.groupBy(*by, F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    j = t.join(q, [*by, "c"], "full").na.fill(0, ["support", "tp", "predicted"])
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return j.groupBy(*by).agg(F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("balanced_accuracy"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def recalls(c: DataFrame, *by: str) -> DataFrame:
    return c.groupBy(*by, "y").agg(F.sum("n").alias("support"), (F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))


def confused_pairs(c: DataFrame, *by: str, k: int = 3) -> DataFrame:
    """The ``k`` most frequent confusions."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "y", "p")
    return c.where("y <> p").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_counts(p: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """by, label_idx, tp, fp, fn, tn."""
    w = F.col(weight) if weight else F.lit(1.0)
    r = p.select(*by, w.alias("w"), F.posexplode(F.arrays_zip("y", "prediction")).alias("label_idx", "z")).select(*by, "w", "label_idx", F.col("z.y").alias("y"), F.col("z.prediction").alias("q"))
    one = lambda a, b: F.sum(F.when((F.col("y") == a) & (F.col("q") == b), F.col("w")).otherwise(0.0))
    return r.groupBy(*by, "label_idx").agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(0, 0).alias("tn"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def label_scores(counts: DataFrame) -> DataFrame:
    """Per label: precision, recall, f1, balanced accuracy, prevalence, positives, n."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.select(*[c for c in counts.columns if c not in ("tp", "fp", "fn", "tn")], div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"), ((div(tp, tp + fn) + div(tn, tn + fp)) / 2).alias("balanced_accuracy"), ((tp + fn) / (tp + fp + fn + tn)).alias("prevalence"), (tp + fn).alias("positives"), (tp + fp + fn + tn).alias("n"))


def label_summary(labels: DataFrame, *by: str, rare: float = 0.05) -> DataFrame:
    """by, mean, median and tenth percentile of the labels' f1 (``label_scores`` with ``positives`` and ``n``), and the mean of rare labels (null without any)."""
    few = F.col("positives") <= F.greatest(F.lit(5), F.floor(F.col("n") * rare))
    return labels.groupBy(*by).agg(
        F.avg("f1").alias("per_label_f1_mean"),
        F.expr("percentile(f1, 0.5)").alias("per_label_f1_median"),
        F.expr("percentile(f1, 0.1)").alias("per_label_f1_p10"),
        F.avg(F.when(few, F.col("f1"))).alias("rare_label_f1_mean"),
        F.avg(F.when((F.col("positives") > 0) & (F.col("positives") < F.col("n")), F.col("balanced_accuracy"))).alias("label_balanced_accuracy_macro"),
    )


def multilabel_scores(p: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """by, micro_f1, macro_f1, sample_jaccard (empty 1), sample_f1 (empty 0), hamming_loss, subset_accuracy."""
    c = label_counts(p, *by, weight=weight).groupBy(*by).agg(_f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), (F.sum(F.col("fp") + F.col("fn")) / F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("hamming_loss"))
    w = F.col(weight) if weight else F.lit(1.0)
    y, q = F.transform("y", lambda v: v.cast("int")), F.transform("prediction", lambda v: v.cast("int"))
    size = ones(y) + ones(q)
    mean = lambda x, n: (F.sum(x * w) / F.sum(w)).alias(n)
    r = p.groupBy(*by).agg(mean(jaccard(y, q), "sample_jaccard"), mean(F.when(size > 0, 2 * both(y, q) / size).otherwise(0.0), "sample_f1"), mean((y == q).cast("double"), "subset_accuracy"))
    return c.join(r, list(by))


def target_scores(p: DataFrame, *by: str) -> DataFrame:
    """by, target_idx, variance, r2, nrmse of each target; r2 and nrmse are null for constant targets and single rows."""
    r = p.select(*by, F.posexplode(F.arrays_zip("y", "prediction")).alias("target_idx", "z")).select(*by, "target_idx", F.col("z.y").alias("y"), F.col("z.prediction").alias("q"))
    t = r.groupBy(*by, "target_idx").agg(F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("variance"), F.avg((F.col("y") - F.col("q")) ** 2).alias("mse"))
    ok = (F.col("variance") > USABLE) & (F.col("n") >= 2)
    return t.select(*by, "target_idx", "variance", F.when(ok, 1 - F.col("mse") / F.col("variance")).alias("r2"), F.when(ok, F.sqrt(F.col("mse") / F.col("variance"))).alias("nrmse"))


def regression_scores(p: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """by, r2_variance_weighted, r2_uniform_average over usable targets, mean nrmse; weighted moments are centred on the cohort's means, for which ``p`` is read once more."""
    r = p.select(*by, *([weight] if weight else []), F.posexplode(F.arrays_zip("y", "prediction")).alias("i", "z")).select(*by, *([weight] if weight else []), "i", F.col("z.y").alias("y"), F.col("z.prediction").alias("q"))
    error = (F.col("y") - F.col("q")) ** 2
    if weight is None:
        t = r.groupBy(*by, "i").agg(F.count(F.lit(1)).alias("n"), F.sum(error).alias("sse"), (F.var_pop("y") * F.count("y")).alias("sst"))
    else:
        w = F.col(weight)
        m = p.select(F.posexplode("y").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))  # one row per target
        r = r.join(F.broadcast(m), "i").withColumn("c", F.col("y") - F.col("m"))
        t = r.groupBy(*by, "i").agg(F.sum(w).alias("n"), F.sum(w * error).alias("sse"), (F.sum(w * F.col("c") ** 2) - F.sum(w * F.col("c")) ** 2 / F.sum(w)).alias("sst"))
    t = t.where((F.col("sst") / F.col("n") > USABLE) & (F.col("n") >= 2))
    return t.groupBy(*by).agg((1 - F.sum("sse") / F.sum("sst")).alias("r2_variance_weighted"), F.avg(1 - F.col("sse") / F.col("sst")).alias("r2_uniform_average"), F.avg(F.sqrt(F.col("sse") / F.col("sst"))).alias("nrmse"))


def scores(p: DataFrame, mode: str, *by: str, weight: str | None = None) -> DataFrame:
    if mode == "singlelabel":
        return single_scores(confusion(p, *by, weight=F.col(weight) if weight else None), *by)
    return (multilabel_scores if mode == "multilabel" else regression_scores)(p, *by, weight=weight)
