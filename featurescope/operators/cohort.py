"""Validation, label codes, groups, draws, folds: everything that decides which rows take part where.

A cohort is a DataFrame with ``row_id`` (unique), ``features`` (array of doubles)
and one of ``label`` (any atomic type), ``labels`` (array of 0/1) or ``targets``
(array of doubles); ``group_id`` is optional.

Every draw orders rows by md5 of ``seed:row_id``, so that it is the same on any
cluster.  Ranks within a class are taken in two steps (rank within class and
first byte of the hash, plus the count before it), so that no class needs one
task.
"""

from __future__ import annotations

import hashlib
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurescope.functions.arrays import finite

USABLE_VARIANCE = 1e-12
#: Groups that are dealt one by one on the driver; more are dealt by rank, where they are.
DRIVER_GROUPS = 20_000
ATTEMPTS = 32

# ---------------------------------------------------------------- validation


def feature_check(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_bad (null or non-finite), shortest and longest array, duplicate and null row ids."""
    bad = F.col("features").isNull() | ~F.coalesce(finite(F.col("features")), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n_bad"),
        F.min(F.size("features")).alias("min_size"),
        F.max(F.size("features")).alias("max_size"),
        F.count_distinct("row_id").alias("n_row_ids"),
    )


def check_features(df: DataFrame) -> tuple[int, int]:
    """(rows, features); raises ValueError if the features cannot be used."""
    r = feature_check(df).first()
    if not r.n_rows:
        raise ValueError("the input has no rows")
    if r.n_bad:
        raise ValueError(f"{r.n_bad} rows have null, NaN or infinite features")
    if r.min_size < 1 or r.min_size != r.max_size:
        raise ValueError(f"features must have one length of at least 1; found {r.min_size} to {r.max_size}")
    if r.n_row_ids != r.n_rows:
        raise ValueError("row_id must be unique and not null")
    return r.n_rows, r.max_size


def label_codes(df: DataFrame) -> DataFrame:
    """label, code: the distinct labels in sorted order, numbered from 0."""
    return df.select("label").distinct().withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))  # one row per class


def encoded(df: DataFrame) -> DataFrame:
    """``df`` with ``code``."""
    return df.join(label_codes(df), "label")


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def group_support(df: DataFrame) -> DataFrame:
    """label, n_rows, n_groups, evaluable: seen in at least two groups."""
    g = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_id").alias("n_groups"))
    return g.withColumn("evaluable", F.col("n_groups") >= 2)


def evaluable_rows(df: DataFrame) -> DataFrame:
    return df.join(group_support(df).where("evaluable").select("label"), "label", "left_semi")


def group_summary(df: DataFrame) -> DataFrame:
    """One row: n_groups, min_size, median_size, max_size."""
    sizes = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min_size"), F.expr("percentile(n, 0.5)").alias("median_size"), F.max("n").alias("max_size"))


def label_support(df: DataFrame) -> DataFrame:
    """Multilabel: per label position the rows and groups on either side, and whether it is usable."""
    rows = df.select("*" if "group_id" in df.columns else F.expr("*"), F.posexplode("labels").alias("label_idx", "v"))
    out = [F.sum("v").cast("long").alias("positives"), (F.count(F.lit(1)) - F.sum("v")).cast("long").alias("negatives")]
    if "group_id" in df.columns:
        out += [F.count_distinct(F.when(F.col("v") == 1, F.col("group_id"))).alias("positive_groups"), F.count_distinct(F.when(F.col("v") == 0, F.col("group_id"))).alias("negative_groups")]
    g = rows.groupBy("label_idx").agg(*out)
    ok = (F.col("positives") >= 2) & (F.col("negatives") >= 2)
    if "group_id" in df.columns:
        ok = ok & (F.col("positive_groups") >= 2) & (F.col("negative_groups") >= 2)
    return g.withColumn("usable", ok)


def target_support(df: DataFrame) -> DataFrame:
    """Regression: per target the population variance, and whether it is usable."""
    g = df.select(F.posexplode("targets").alias("target_idx", "y")).groupBy("target_idx").agg(F.var_pop("y").alias("variance"), F.avg("y").alias("mean"))
    return g.withColumn("usable", F.col("variance") > USABLE_VARIANCE)


def is_multilabel(df: DataFrame, *, allow_single: bool = False) -> bool:
    """Whether ``labels`` is an array column of one length (2 or more, unless ``allow_single``) of 0 and 1 only."""
    if "labels" not in df.columns:
        return False
    r = df.agg(F.min(F.size("labels")).alias("lo"), F.max(F.size("labels")).alias("hi"), F.bool_and(F.forall("labels", lambda v: v.isin(0, 1))).alias("ok")).first()
    return bool(r.ok and r.lo == r.hi and r.lo >= (1 if allow_single else 2))


# ---------------------------------------------------------------- draws


def draw(seed: int, *columns: str) -> Column:
    """The hash that orders rows for a draw."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def ranked(df: DataFrame, by: list[str], seed: int, *, name: str = "rank", keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``df`` with each row's 1-based rank by ``draw`` within ``by``, without one task per class."""
    rows = df.withColumn("_h", draw(seed, *keys)).withColumn("_b", F.substring("_h", 1, 2))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # 256 rows per class at most
    rows = rows.join(counts, [*by, "_b"])
    within = Window.partitionBy(*by, "_b").orderBy("_h", *keys)
    return rows.withColumn(name, F.row_number().over(within) + F.col("_before")).drop("_h", "_b", "_before")


def uniform_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by draw (all, if fewer)."""
    return df.withColumn("_h", draw(seed, "row_id")).orderBy("_h", "row_id").limit(n).drop("_h")


def quotas(counts: dict, n: int, least: int = 2) -> dict | None:
    """Rows to take from each class for ``n`` in all: proportional, at least ``least`` each; None if that is impossible.

    What is missing goes to the classes with most unused rows, what is too much is taken from the largest quotas.
    """
    total = sum(counts.values())
    if n >= total:
        return dict(counts)
    if n < sum(min(c, least) for c in counts.values()):
        return None
    keys = sorted(counts, key=str)
    take = {k: min(counts[k], max(least, int(n * (counts[k] / total)))) for k in keys}
    while (over := sum(take.values()) - n) > 0:
        for k in sorted(keys, key=lambda k: -take[k]):
            if over and take[k] > least:
                take[k] -= 1
                over -= 1
    while (lack := n - sum(take.values())) > 0:
        for k in sorted(keys, key=lambda k: take[k] - counts[k]):
            if lack and take[k] < counts[k]:
                take[k] += 1
                lack -= 1
    return take


def stratified_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame | None:
    """``n`` rows with the classes' shares kept; None if a class would lose its two rows."""
    counts = {r.label: r.n for r in class_counts(df).collect()}  # one row per class
    take = quotas(counts, n)
    if take is None:
        return None
    if sum(take.values()) == sum(counts.values()):
        return df
    quota = df.sparkSession.createDataFrame([(k, v) for k, v in take.items()], df.select("label").schema.add("_quota", "long"))
    return ranked(df, ["label"], seed, name="_rank").join(F.broadcast(quota), "label").where("_rank <= _quota").select(*df.columns)


def choose_groups(sizes: dict, states: dict, need: int, n: int, seed: int = 0) -> set | None:
    """Whole groups with as many rows as possible, at most ``n``, that together show each state in ``need`` groups (or in all it has).

    ``states`` maps a group to the states it shows.  Groups are added by how many
    still-needed states they show per row, then the room left is filled by an exact
    subset-sum over the sizes of the other groups; 16 orders are tried.  None if
    no try covers every state.
    """
    groups = sorted(sizes, key=str)
    seen: dict = {}
    for g in groups:
        for s in states.get(g, ()):
            seen[s] = seen.get(s, 0) + 1
    goal = {s: min(need, c) for s, c in seen.items()}
    best: tuple[int, set] | None = None
    rng = np.random.default_rng(seed)
    for attempt in range(16):
        weight = {g: 1.0 if not attempt else float(rng.uniform(0.5, 1.5)) for g in groups}
        left, room, chosen = dict(goal), n, set()
        while any(left.values()):
            fit = [(sum(1 / seen[s] for s in states.get(g, ()) if left[s]) * weight[g] / sizes[g], g) for g in groups if g not in chosen and sizes[g] <= room]
            fit = [x for x in fit if x[0] > 0]
            if not fit:
                break
            g = max(fit, key=lambda x: x[0])[1]
            chosen.add(g)
            room -= sizes[g]
            for s in states.get(g, ()):
                left[s] = max(0, left[s] - 1)
        if any(left.values()):
            continue
        # bit t of a step: the groups up to here can fill t rows
        rest, mask = [g for g in groups if g not in chosen], (1 << (room + 1)) - 1
        steps = [1]
        for g in rest:
            steps.append((steps[-1] | steps[-1] << sizes[g]) & mask)
        t = steps[-1].bit_length() - 1
        for g, before in zip(reversed(rest), reversed(steps[:-1]), strict=True):
            if not before >> t & 1:
                chosen.add(g)
                t -= sizes[g]
        rows = sum(sizes[g] for g in chosen)
        if best is None or rows > best[0]:
            best = rows, chosen
    return best[1] if best else None


def label_side(labels: str = "labels") -> Column:
    """Rows of ``label:value``, one for each label."""
    return F.explode(F.transform(labels, lambda v, i: F.concat(i.cast("string"), F.lit(":"), v.cast("string"))))


def _few_groups(groups: DataFrame, seed: int) -> DataFrame:
    """Of more groups than the driver takes (group_id, n, states): those of the lowest draws, and 64 of each state."""
    some = uniform_sample(groups.withColumn("row_id", F.col("group_id")), DRIVER_GROUPS // 2, seed).select("group_id")
    each = ranked(groups.select("group_id", F.explode("states").alias("state")), ["state"], seed, keys=("group_id",)).where("rank <= 64").select("group_id")
    return groups.join(some.union(each).distinct(), "group_id", "left_semi")


def group_sample(df: DataFrame, n: int, seed: int = 0, *, state: Column | str | None = "label") -> DataFrame | None:
    """Whole groups, at most ``n`` rows; each value of ``state`` (a column, or rows of ``label_side``; if given) keeps two groups.

    The choice is made on the driver, among all groups or (see ``_few_groups``) about ``DRIVER_GROUPS`` of them.
    """
    if isinstance(state, str) and df.groupBy("group_id").count().agg(F.max("count")).first()[0] == 1:
        return stratified_sample(df, n, seed)
    groups = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    if state is not None:
        each = df.select("group_id", (F.col(state) if isinstance(state, str) else state).alias("state")).groupBy("group_id").agg(F.collect_set("state").alias("states"))  # a group's states
        groups = groups.join(each, "group_id")
    else:
        groups = groups.withColumn("states", F.array(F.lit("all")))
    table = (_few_groups(groups, seed) if groups.count() > DRIVER_GROUPS else groups).collect()
    chosen = choose_groups({r.group_id: r.n for r in table}, {r.group_id: set(r.states) if state is not None else set() for r in table}, 2 if state is not None else 0, n, seed)
    if not chosen or len(chosen) < 2:
        return None
    keep = df.sparkSession.createDataFrame([(g,) for g in sorted(chosen, key=str)], df.select("group_id").schema)
    return df.join(keep, "group_id", "left_semi").select(*df.columns)


def multilabel_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by draw in which each side of each label keeps two rows where it has them.

    The first two rows by draw of every (label, value) are taken first, rarest first; the rest fills up by draw.
    """
    if df.count() <= n:
        return df
    states = df.select("row_id", F.posexplode("labels").alias("label_idx", "v"))
    must = ranked(states, ["label_idx", "v"], seed).where("rank <= 2").groupBy("row_id").agg(F.min("rank").alias("_first"))
    rows = df.join(must, "row_id", "left").withColumn("_h", draw(seed, "row_id"))
    return rows.orderBy(F.col("_first").asc_nulls_last(), "_h", "row_id").limit(n).select(*df.columns)


# ---------------------------------------------------------------- folds


def fold_count(least: int, most: int) -> int:
    """Folds that the smallest class allows: up to 5, 3 or 2; 0 if none."""
    return min(most, 5) if least >= 5 else min(most, 3) if least >= 3 else 2 if least >= 2 else 0


def stratified_folds(df: DataFrame, k: int, seed: int = 0, *, by: str = "label") -> DataFrame:
    """``df`` with ``fold``: the rows of each class dealt in turn."""
    return ranked(df, [by], seed, name="_rank").withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def row_folds(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: all rows dealt in turn."""
    return ranked(df.withColumn("_all", F.lit(0)), ["_all"], seed, name="_rank").withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_all")


def deal_groups(table: dict, k: int, seed: int = 0, *, jitter: bool = False) -> dict:
    """group -> fold from {group: {state: rows}}: largest spread first (``jitter``: up to a half more or less), to the fold where the states' shares stay most even."""
    states = sorted({s for row in table.values() for s in row}, key=str)
    M = {g: np.array([row.get(s, 0) for s in states], float) for g, row in table.items()}
    size = np.maximum(sum(M.values()), 1) if M else np.ones(len(states))
    tie = {g: hashlib.md5(f"{seed}:{g}".encode()).hexdigest() for g in M}
    folds = np.zeros((k, len(states)))
    out = {}
    weight = {g: 0.5 + int(tie[g][:8], 16) / (1 << 32) if jitter else 1.0 for g in M}
    for g in sorted(M, key=lambda g: (-float(M[g].std()) * weight[g], -float(M[g].sum()), tie[g])):
        cost = []
        for f in range(k):
            folds[f] += M[g]
            cost.append((float((folds / size).std(axis=0).mean()), float(folds[f].sum()), f))
            folds[f] -= M[g]
        f = min(cost)[2]
        folds[f] += M[g]
        out[g] = f
    return out


def _planned(df: DataFrame, plan: dict) -> DataFrame:
    """``df`` with the fold that ``plan`` gives each group (at most ``DRIVER_GROUPS`` of them)."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(list(plan.items()), df.select("group_id").schema.add("fold", "integer"))), "group_id")


def _both_sides(folded: DataFrame, state: Column, k: int) -> bool:
    """Whether each of ``k`` folds has rows, and each state occurs in it and outside of it."""
    n = folded.select("fold", state.alias("state")).groupBy("fold", "state").count().groupBy("state").agg(F.count(F.lit(1)).alias("folds"))  # folds x states
    r = n.agg(F.min("folds").alias("least"), F.max("folds").alias("most")).first()
    return k >= 2 and r.least == r.most == k


def group_folds(df: DataFrame, k: int, seed: int = 0, *, state: Column | None = None) -> DataFrame | None:
    """``df`` with ``fold``, groups undivided and each class (or ``state``) in every fold and outside of it; tries ``k`` down to 2, None if none will do.

    Up to ``DRIVER_GROUPS`` groups are dealt one by one for even shares; more are dealt in turn within their most frequent class.
    """
    own = F.col("label").cast("string") if state is None else state
    counts = df.select("group_id", own.alias("state")).groupBy("group_id", "state").agg(F.count(F.lit(1)).alias("n"))
    n_groups = df.select("group_id").distinct().count()
    if n_groups > DRIVER_GROUPS:
        main = counts.groupBy("group_id").agg(F.max_by("state", F.struct("n", "state")).alias("main"))
        for folds in range(k, 1, -1):
            plan = ranked(main, ["main"], seed, name="_rank", keys=("group_id",)).select("group_id", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int").alias("fold"))
            out = df.join(plan, "group_id")
            if _both_sides(out, own, folds):
                return out
        return None
    table: dict = {}
    for r in counts.collect():  # groups x classes
        table.setdefault(r.group_id, {})[r.state] = r.n
    states = {x for row in table.values() for x in row}
    for folds in range(min(k, n_groups), 1, -1):
        for attempt in range(ATTEMPTS):
            out = deal_groups(table, folds, seed + attempt, jitter=attempt > 0)
            if all({out[g] for g in table if x in table[g]} == set(range(folds)) for x in states):
                return _planned(df, out)
    return None


def size_folds(df: DataFrame, k: int, seed: int = 0) -> DataFrame | None:
    """``df`` with ``fold``: groups, largest first, to the fold with fewest rows (regression); very many are dealt in turn within powers of 2 of their size."""
    sizes = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    n_groups = sizes.count()
    k = min(k, n_groups)
    if k < 2:
        return None
    if n_groups > DRIVER_GROUPS:
        plan = ranked(sizes.withColumn("_size", F.floor(F.log2("n"))), ["_size"], seed, name="_rank", keys=("group_id",))
        return df.join(plan.select("group_id", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("fold")), "group_id")
    load, out = [0] * k, {}
    for n, _, g in sorted(((r.n, str(r.group_id), r.group_id) for r in sizes.collect()), key=lambda x: (-x[0], x[1])):
        f = load.index(min(load))
        load[f] += n
        out[g] = f
    return _planned(df, out)


def group_holdout(df: DataFrame, seed: int, share: float = 0.25) -> DataFrame | None:
    """``df`` with ``held``: a quarter of the groups (at least one, not all), by draw; None with fewer than two groups."""
    groups = df.select("group_id").distinct().withColumn("_all", F.lit(0))
    n = groups.count()
    if n < 2:
        return None
    most = min(n - 1, int(np.ceil(share * n)))
    plan = ranked(groups, ["_all"], seed, name="_rank", keys=("group_id",)).select("group_id", (F.col("_rank") <= most).alias("held"))
    return df.join(plan, "group_id")


def holdout_is_valid(df: DataFrame, state: Column) -> bool:
    """Whether every state occurs among the ``held`` rows and among the others."""
    sides = df.select("held", state.alias("state")).distinct().groupBy("state").count().agg(F.min("count").alias("least")).first()
    return sides.least == 2


def deal_labels(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: rows in the order of their rarest and second rarest label sides, dealt in turn from one end to the other.

    A label side is (label, value).  Folds differ by one row at most, in all and within each rarest side.
    """
    sides = df.select(F.posexplode("labels").alias("i", "v")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    order = {(r.i, r.v): at for at, r in enumerate(sorted(sides.collect(), key=lambda r: (r.n, r.i, r.v)))}  # two rows per label
    width = 1 + max((i for i, _ in order), default=0)
    codes = F.lit([order.get((i, v), len(order)) for i in range(width) for v in (0, 1)])
    own = F.array_sort(F.transform("labels", lambda v, i: F.element_at(codes, (2 * i + v + 1).cast("int"))))
    rows = df.withColumn("_own", own)
    rows = rows.withColumn("_first", F.col("_own")[0]).withColumn("_second", F.when(F.size("_own") > 1, F.col("_own")[1]).otherwise(0) if width <= 128 else F.lit(0)).drop("_own")
    counts = rows.groupBy("_first", "_second").agg(F.count(F.lit(1)).alias("_n")).collect()  # pairs of sides
    before, at = [], 0
    for r in sorted(counts, key=lambda r: (r["_first"], r["_second"])):
        before.append((r["_first"], r["_second"], at))
        at += r["_n"]
    before = df.sparkSession.createDataFrame(before, "_first int, _second int, _before long")
    rows = ranked(rows, ["_first", "_second"], seed, name="_rank").join(F.broadcast(before), ["_first", "_second"])
    return rows.withColumn("fold", F.pmod(F.col("_before") + F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_first", "_second", "_before", "_rank")


def multilabel_folds(df: DataFrame, k: int, seed: int = 0) -> DataFrame | None:
    """``df`` with ``fold`` (see ``deal_labels``), each side of each label in every fold and outside of it.

    ``ATTEMPTS`` draws are tried for ``k`` folds, then for fewer; None if none will do.
    """
    least = df.select(F.posexplode("labels").alias("i", "v")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    sides = least.groupBy("i").agg(F.count(F.lit(1)).alias("sides"), F.min("n").alias("n")).agg(F.min("sides").alias("sides"), F.min("n").alias("n")).first()
    if sides.sides != 2:
        return None
    for folds in range(min(k, sides.n), 1, -1):
        for attempt in range(ATTEMPTS):
            out = deal_labels(df, folds, seed + attempt)
            if _both_sides(out, label_side(), folds):
                return out
    return None


def regression_fold_count(n: int, most: int) -> int:
    return min(most, 5) if n >= 10 else 2 if n >= 4 else 0


def train_sizes(folded: DataFrame) -> DataFrame:
    """One row: n_rows and min, median, mean, max of the training sizes over folds."""
    g = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("n_rows"))
    t = g.crossJoin(F.broadcast(total)).select("n_rows", (F.col("n_rows") - F.col("n")).alias("train"))  # one row per fold
    return t.groupBy("n_rows").agg(F.min("train").alias("min_train"), F.expr("percentile(train, 0.5)").alias("median_train"), F.avg("train").alias("mean_train"), F.max("train").alias("max_train"))


def plan_id(folded: DataFrame, method: str) -> str:
    """16 hex digits that name a plan: order-free sums over hashes of (row, fold)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("row_id").cast("string"), F.col("fold").cast("string"))), 1, 15), 16, 10).cast("decimal(38,0)")
    r = folded.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"), F.max("fold").alias("k")).first()
    return hashlib.sha256(f"{method}:{r.n}:{r.k}:{r.h}".encode()).hexdigest()[:16]
