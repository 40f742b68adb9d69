"""The diagnosis from end to end, for the three target modes.

``diagnose`` validates and audits all rows, draws a capped cohort, and measures
it: geometry, probes out of fold, neighbourhoods, boundary, graph, topology.
Only aggregates reach the driver; the cohort and its edges stay DataFrames in the
shared store.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescope.config import MLP_BUDGETS, Config
from featurescope.functions.arrays import finite
from featurescope.operators import audit as A
from featurescope.operators import boundary as B
from featurescope.operators import cohort as K
from featurescope.operators import geometry as G
from featurescope.operators import graph as H
from featurescope.operators import mlp as M
from featurescope.operators import neighbors as N
from featurescope.operators import probes as P
from featurescope.operators import scoring as S
from featurescope.operators import topology as T
from featurescope.operators.bootstrap import compared
from featurescope.runtime import discard, materialise

from .decision import Decision, decide
from .recipes import probe_recipe
from .report import Report, render


class Context:
    """What a run records besides its metrics."""

    def __init__(self):
        self.skips: list[dict] = []
        self.warnings: list[str] = []
        self.errors: list[str] = []
        self.events: list[dict] = []

    def skip(self, name: str, reason: str, *, severity: str | None = None, status: str = "skipped") -> None:
        self.skips.append({"name": name, "reason": reason, "severity": severity, "status": status})

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)


def _first(df: DataFrame) -> dict:
    r = df.first()
    return r.asDict() if r else {}


class Profiler:
    """``fit`` a cohort (row_id, features, and label, labels or targets; group_id optional); then ``report`` and ``recommendation``.

    The report holds no rows.  ``tables`` has what stands behind it as DataFrames: ``predictions`` (out of fold),
    ``folds``, ``neighbors`` (local measures of each row) and ``boundary``, as far as a run got.
    """

    def __init__(self, config: Config | None = None, **settings):
        self.config = config or Config(**settings)
        self._report: Report | None = None
        self.tables: dict[str, DataFrame] = {}

    def mode_of(self, df: DataFrame) -> str:
        mode = self.config.target_mode
        if mode != "auto":
            need = {"singlelabel": "label", "multilabel": "labels", "regression": "targets"}[mode]
            if need not in df.columns:
                raise ValueError(f"{mode} needs the column {need}")
            return mode
        if "labels" in df.columns and K.is_multilabel(df):
            return "multilabel"
        if "label" in df.columns:
            return "singlelabel"
        raise ValueError("regression must be asked for by target_mode; otherwise label, or labels with two or more positions, is needed")

    def fit(self, df: DataFrame, *, names: list[str] | None = None) -> Profiler:
        """``names`` are those of the labels or targets; ``label_0``, ``target_0`` and so on without them."""
        began, ctx = time.time(), Context()
        mode = self.mode_of(df)
        if mode == "multilabel" and self.config.multilabel_stratification == "iterative":
            raise ValueError("iterative stratification needs an optional library that this engine does not use; take auto or heuristic")
        if self.config.mlp_probes and self.config.mlp_device in ("cuda", "mps"):
            ctx.warn(f"{self.config.mlp_device} was asked for, but networks run on the executors' CPUs")
        if self.config.n_jobs is not None:
            ctx.warn("n_jobs has no effect: Spark's executors set how much runs at once")
        grouped = "group_id" in df.columns
        target = {"singlelabel": "label", "multilabel": "labels", "regression": "targets"}[mode]
        df = df.select("row_id", F.col("features").cast("array<double>").alias("features"), target, *(["group_id"] if grouped else []))
        n, d = K.check_features(df)
        if df.where(F.col(target).isNull()).limit(1).count():
            raise ValueError("targets must not be null")
        if grouped:
            lacks = F.col("group_id").isNull()
            if dict(df.dtypes)["group_id"] in ("double", "float"):
                lacks = lacks | F.isnan("group_id")
            if df.where(lacks).limit(1).count():
                raise ValueError("group_id must not be null or NaN")
        self._names, self.tables = list(names or ()), {}
        metrics, summary, usable = self._audit(df, mode, grouped, n, ctx)
        metrics["audit"]["sparsity"] = A.sparsity(df).first()[0]
        sampling: dict = {}
        grouping = _first(K.group_summary(df)) if grouped else {}
        decision = self._measure(usable, mode, grouped, n, d, metrics, sampling, ctx)
        frontier = decision.evidence["plausible_family_set"]
        text = render(mode, decision.recommendation, decision.confidence, decision.scores, decision.path, frontier)
        metrics["recommendation_evidence" if mode == "singlelabel" else f"{mode}_recommendation_evidence"] = decision.evidence | {"quality_flags": decision.flags}
        metrics["quality_context"] = {"skipped_diagnostics": ctx.skips, "errors": ctx.errors}
        self._report = Report(
            decision.recommendation, text, decision.confidence, metrics, decision.scores, _INTERPRETATIONS[mode], decision.path, ctx.warnings, ctx.errors, ctx.skips,
            {"features": "as given for distances; standardised within training folds for probes", "distance": "euclidean"}, sampling, ctx.events, summary, grouping, {"seconds": time.time() - began}, self.config.to_dict(),
        )
        return self

    def report(self) -> Report:
        if self._report is None:
            raise RuntimeError("fit comes first")
        return self._report

    def recommendation(self) -> str:
        return self.report().recommendation_text

    # ------------------------------------------------------------ stages

    def _audit(self, df: DataFrame, mode: str, grouped: bool, n: int, ctx: Context) -> tuple[dict, dict, DataFrame]:
        if mode == "singlelabel":
            classes = A.class_audit(df).collect()  # one row per class
            if len(classes) < 2:
                raise ValueError("at least two classes are needed")
            audit = _first(A.single_audit(df)) | {"proportions": {str(r.label): r.proportion for r in classes}, "class_counts": {str(r.label): r.n for r in classes}}
            numeric = dict(df.dtypes)["label"] not in ("string", "boolean")
            if numeric and len(classes) >= 20 and len(classes) / n >= 0.2:
                ctx.warn("the numeric label has many values; regression may be meant")
            if grouped:
                lost = [r.label for r in K.group_support(df).where("not evaluable").collect()]
                if lost:
                    left = len(classes) - len(lost)
                    ctx.skip("group_unsupported_classes", f"{len(lost)} classes occur in one group only", severity="blocking" if left < 2 else "caution")
                    df = K.evaluable_rows(df)
            return {"audit": audit}, {"classes": audit["class_counts"]}, df
        if mode == "multilabel":
            if not K.is_multilabel(df, allow_single=True):
                raise ValueError("labels must be arrays of 0 and 1 of one length")
            audit = _first(A.multilabel_audit(df))
            if audit["n_labels"] == 1:
                ctx.warn("one label only; single-label mode may be meant")
            support = K.label_support(df).collect()  # one row per label
            keep = sorted(r.label_idx for r in support if r.usable)
            self._name_all("label", len(support))
            audit["usable_labels"] = len(keep)
            if len(keep) < len(support):
                ctx.skip("unusable_labels", f"{len(support) - len(keep)} labels lack support on one side", severity="caution")
            top = [r.asDict() | {"label": self._names[r.label_idx]} for r in A.top_labels(df).collect()]
            summary = {"labels": [r.asDict() | {"label": self._names[r.label_idx]} for r in sorted(support, key=lambda r: r.label_idx)]}
            if keep and len(keep) < len(support):
                df = df.withColumn("labels", F.array(*(F.col("labels")[i] for i in keep)))
                self._names = [self._names[i] for i in keep]
            return {"audit": audit | {"top_labels": top}}, summary, df
        if n < 3:
            raise ValueError("regression needs three rows")
        if df.where(~F.coalesce(finite(F.col("targets").cast("array<double>")), F.lit(False))).limit(1).count():
            raise ValueError("targets must be finite")
        df = df.withColumn("targets", F.col("targets").cast("array<double>"))
        support = K.target_support(df).collect()  # one row per target
        keep = sorted(r.target_idx for r in support if r.usable)
        audit = _first(A.regression_audit(df))
        pairs = {(r.i, r.j): r.corr for r in A.target_correlations(df).collect()} if len(support) > 1 else {}
        audit["target_effective_rank"], audit["mean_abs_correlation"] = A.target_rank(pairs, len(support))
        if len(keep) < len(support):
            ctx.skip("constant_targets", f"{len(support) - len(keep)} targets are constant", severity="caution" if keep else "blocking")
        self._name_all("target", len(support))
        summary = {"targets": [r.asDict() | {"target": self._names[r.target_idx]} for r in sorted(support, key=lambda r: r.target_idx)]}
        if keep and len(keep) < len(support):
            df = df.withColumn("targets", F.array(*(F.col("targets")[i] for i in keep)))
            self._names = [self._names[i] for i in keep]
        return {"audit": audit}, summary, df

    def _name_all(self, kind: str, n: int) -> None:
        if self._names and len(self._names) != n:
            raise ValueError(f"{len(self._names)} names were given for {n} {kind}s")
        self._names = self._names or [f"{kind}_{i}" for i in range(n)]

    def _capped(self, df: DataFrame, mode: str, grouped: bool, n: int, cap: int) -> DataFrame | None:
        if n <= cap:
            return df
        seed = self.config.seed
        if grouped:
            return K.group_sample(df, cap, seed, state={"singlelabel": "label", "multilabel": K.label_side(), "regression": None}[mode])
        if mode == "singlelabel":
            return K.stratified_sample(df, cap, seed)
        return K.multilabel_sample(df, cap, seed) if mode == "multilabel" else K.uniform_sample(df, cap, seed)

    def _dense_cap(self, d: int, ctx: Context, what: str, n: int) -> int | None:
        """Rows that fit in ``max_dense_mb``; None if the policy skips, ValueError if it fails."""
        c = self.config
        fits = int(c.max_dense_mb * (1 << 20) / (8 * max(1, d)))
        if n <= fits:
            return n
        if c.densify_policy == "fail":
            raise ValueError(f"{what}: {n} x {d} doubles are more than {c.max_dense_mb} MB")
        if c.densify_policy == "skip" or fits < c.min_dense_samples:
            ctx.skip(what, f"{n} x {d} doubles are more than {c.max_dense_mb} MB", severity="caution")
            ctx.events.append({"reason": what, "action": "skipped"})
            return None
        ctx.events.append({"reason": what, "action": "sampled", "rows": fits})
        if c.warn_on_densify:
            ctx.warn(f"{what} ran on {fits} of {n} rows for memory")
        return fits

    def _folded(self, df: DataFrame, mode: str, grouped: bool, n: int) -> tuple[DataFrame | None, str]:
        most, seed = self.config.limits["folds"], self.config.seed
        if grouped:
            if mode == "regression":
                return K.size_folds(df, most, seed), "group_folds"
            return K.group_folds(df, most, seed, state=None if mode == "singlelabel" else K.label_side()), "group_folds"
        if mode == "regression":
            k = K.regression_fold_count(n, most)
            return (K.row_folds(df, k, seed), "row_folds") if k else (None, "none")
        if mode == "singlelabel":
            k = K.fold_count(df.groupBy("label").count().agg(F.min("count")).first()[0], most)
            return (K.stratified_folds(df, k, seed), "stratified_folds") if k else (None, "none")
        k = K.fold_count(K.label_support(df.drop("group_id")).agg(F.min(F.least("positives", "negatives"))).first()[0], most)
        return (K.multilabel_folds(df, k, seed), "multilabel_folds") if k else (None, "none")

    def _probes(self, df: DataFrame, mode: str, grouped: bool, d: int, metrics: dict, sampling: dict, ctx: Context) -> tuple[dict, list[dict] | None, DataFrame | None, int]:
        c, n = self.config, df.count()
        cap = self._dense_cap(d, ctx, "probes", min(n, c.cap("probe_rows")))
        if cap and mode == "multilabel":
            cap = self._dense_cap(len(self._names), ctx, "multilabel_target", cap)
        used = self._capped(df, mode, grouped, n, cap) if cap else None
        if used is None:
            ctx.skip("probes", "no sample keeps every class", severity="blocking")
            return {}, None, None, 0
        used = self._coded(used, mode)
        used = materialise(used, "probe-cohort")
        m = used.count()
        sampling["probes"] = {"rows": m, "of": n}
        folded, method = self._folded(used, mode, grouped, m)
        if folded is None:
            metrics["evaluation"] = "resubstitution_low_reliability"
            ctx.skip("cross_validation", "too few rows or groups in some class", severity="blocking" if mode != "regression" or grouped else "caution")
            return {}, None, None, m
        folded = materialise(folded, "folds")
        settings = P.ProbeSettings(mode, max(1, N.default_k(m)), c.seed, c.max_dense_mb)
        names = [p for p in P.PROBES if p != "kernel_approx" or c.limits["kernel"]]
        if P.quadratic_variant(m, d, c.max_dense_mb)[0] == "skipped":
            names.remove("smooth_poly")
            ctx.skip("smooth_poly", "the quadratic expansion does not fit in memory", severity="caution")
        pred = materialise(P.out_of_fold(folded, settings, names), "predictions")
        self.tables |= {"folds": folded.select("row_id", "fold"), "predictions": pred}
        scored = {r.probe: r.asDict() for r in S.scores(pred, mode, "probe").collect()}
        if mode == "singlelabel":
            conf = materialise(S.confusion(pred, "probe"), "confusion")
            counts = {str(r.y): r.support for r in S.recalls(conf.where("probe = 'dummy'")).collect()}
            for r in S.recalls(conf, "probe").orderBy("probe", "y").collect():
                scored[r.probe].setdefault("per_class_recall", []).append(r.recall)
            for r in S.confused_pairs(conf, "probe").collect():
                scored[r.probe].setdefault("confused_pairs", []).append([r.y, r.p, r.n])
            for p in scored.values():
                p["class_counts"] = counts
            discard(conf)
        if mode == "multilabel":
            labels = S.label_scores(S.label_counts(pred, "probe"))
            for r in S.label_summary(labels, "probe").collect():
                scored[r.probe]["per_label_summary"] = r.asDict()
            for r in labels.orderBy("probe", "label_idx").collect():  # one row per probe and label
                scored[r.probe].setdefault("per_label_metrics", []).append(r.asDict() | {"label": self._names[r.label_idx]})
            for x in scored.values():
                x["per_label_summary"].pop("probe")
                ordered = sorted(x["per_label_metrics"], key=lambda r: (r["f1"], r["label_idx"]))
                x["per_label_summary"] |= {"worst_labels": [r["label"] for r in ordered[:5]], "best_labels": [r["label"] for r in ordered[::-1][:5]]}
        if mode == "regression":
            for r in S.target_scores(pred, "probe").orderBy("probe", "target_idx").collect():  # one row per probe and target
                scored.get(r.probe, {}).setdefault("per_target_metrics", []).append(r.asDict() | {"target": self._names[r.target_idx]})
        if c.limits["repeats"]:
            self._stability(used, mode, grouped, settings, names, scored)
        train = _first(K.train_sizes(folded))
        for p in scored:
            scored[p]["probe_recipe"] = probe_recipe(p, mode, d, settings).to_dict()
            scored[p]["training_policy"] = P.training_policy(p, settings, int(train["median_train"]), d, c.random_state)
        metrics["probe_evaluation"] = {"method": method, "plan_id": K.plan_id(folded, method), "train_sizes": train}
        pairs = compared(folded, pred, mode, c.limits["resamples"], c.seed, grouped=grouped)
        metrics["paired_probe_comparisons"] = {"status": "available" if pairs is not None else "unavailable", "pairs": pairs}
        metrics["probes"] = scored
        own = S.METRICS[mode]
        metrics["baseline"] = {m: max(((v[m], k) for k, v in scored.items() if (k != "dummy" or mode == "singlelabel") and v.get(m) is not None), default=None) for m in own}
        return scored, pairs, pred, m

    def _held_out(self, used: DataFrame, mode: str, grouped: bool, seed: int) -> DataFrame | None:
        """``used`` with a quarter of the rows (or groups) ``held``, by draw; None if a class or label side would be missing on either side."""
        state = {"singlelabel": F.col("y")[0].cast("string"), "multilabel": K.label_side("y"), "regression": None}[mode]
        if grouped:
            one = K.group_holdout(used, seed)
        elif mode == "multilabel":
            one = K.deal_labels(used, 4, seed).withColumn("held", F.col("fold") == 0).drop("fold")
        else:
            by = F.lit("all") if state is None else state
            one = K.stratified_folds(used.withColumn("_by", by), 4, seed, by="_by").withColumn("held", F.col("fold") == 0).drop("fold", "_by")
        return one if one is None or state is None or K.holdout_is_valid(one, state) else None

    def _stability(self, used: DataFrame, mode: str, grouped: bool, settings, names: list[str], scored: dict) -> None:
        """Mean and spread of each score over repeated quarters held out, each fitted once: all repeats and probes are one job."""
        repeats, parts, kept = self.config.limits["repeats"], None, 0
        for attempt in range(4 * repeats):
            one = self._held_out(used, mode, grouped, self.config.seed + 1000 + attempt)
            if one is None:
                continue
            one = one.select("row_id", "features", "y", F.when(F.col("held"), kept).otherwise(-1).cast("int").alias("fold"))
            own = P.out_of_fold(one, settings, names, only=[kept])
            parts = own if parts is None else parts.unionByName(own)
            kept += 1
            if kept == repeats:
                break
        for x in scored.values():
            x["stability_repeats"] = kept
        if parts is None:
            return
        rows = materialise(S.scores(parts, mode, "probe", "fold"), "stability")
        for m in S.METRICS[mode]:
            for x in rows.groupBy("probe").agg(F.stddev_pop(m).alias("s"), F.avg(m).alias("m")).collect():
                scored[x.probe] |= {f"stability_{m}_std": x.s, f"stability_{m}_mean": x.m}

    def _coded(self, df: DataFrame, mode: str) -> DataFrame:
        if mode == "singlelabel":
            return K.encoded(df).withColumn("y", F.array(F.col("code").cast("double"))).drop("code")
        return df.withColumn("y", F.col("labels" if mode == "multilabel" else "targets").cast("array<double>"))

    def _predictions(self, pred: DataFrame | None, mode: str) -> DataFrame | None:
        if pred is None:
            return None
        wide = pred.where("probe in ('linear', 'knn')").groupBy("row_id").agg(F.max(F.when(F.col("probe") == "linear", F.struct("prediction"))).alias("a"), F.max(F.when(F.col("probe") == "knn", F.struct("prediction"))).alias("b"))
        if mode == "multilabel":
            whole = lambda c: F.transform(F.col(c), lambda v: v.cast("int"))
            return wide.select("row_id", whole("a.prediction").alias("linear"), whole("b.prediction").alias("local"))
        return wide.select("row_id", F.col("a.prediction")[0].alias("linear"), F.col("b.prediction")[0].alias("local"))

    def _measure(self, df: DataFrame, mode: str, grouped: bool, n: int, d: int, metrics: dict, sampling: dict, ctx: Context) -> Decision:
        c = self.config
        rows = df.count()
        used = self._capped(df, mode, grouped, rows, c.cap("neighbor_rows")) if rows else None
        if used is None:
            ctx.skip("neighborhood", "no sample keeps every class", severity="caution")
        else:
            used = materialise(N.group_code(used) if grouped else used, "neighbor-cohort")
            sampling["neighbors"] = {"rows": used.count(), "of": rows}
            if mode != "multilabel":
                metrics["geometry"] = G.geometry(used)
                if metrics["geometry"]["degenerate"]:
                    ctx.warn("all features are constant")
        probes, pairs, pred, m = self._probes(df, mode, grouped, d, metrics, sampling, ctx) if rows else ({}, None, None, 0)
        if used is not None:
            self._local(used, mode, grouped, rows, pred, metrics, sampling, ctx)
        if c.mlp_probes and probes:
            self._mlp(df, mode, grouped, d, probes, metrics, ctx)
        return decide(mode, probes, pairs, metrics, n=m, skips=ctx.skips, warnings=ctx.warnings)

    def _local(self, used: DataFrame, mode: str, grouped: bool, rows: int, pred: DataFrame | None, metrics: dict, sampling: dict, ctx: Context) -> None:
        c, n = self.config, used.count()
        k = N.default_k(n)
        if k < 1:
            ctx.skip("neighborhood", "one row has no neighbours", severity="caution")
            return
        other = F.col("g") if grouped else None
        edges = materialise(N.neighbors(used, k, other=other), "neighbor-edges")
        if mode == "regression":
            z = N.standardised_targets(used)
            per = materialise(N.regression_rows(edges, z), "neighbor-rows")
            metrics["neighborhood"] = _first(N.regression_summary(per, z))
            self.tables["neighbors"] = per
            metrics["graph"] = {"status": "not_applicable"}
            metrics["boundary"] = {"status": "not_applicable"}
            ctx.skip("boundary", "continuous targets have no class boundary", status="not_applicable")
            self._regression_topology(used, per, pred, metrics, ctx)
            return
        if mode == "singlelabel":
            classes = used.select("label").distinct().count()
            per = materialise(N.single_rows(edges, used, classes), "neighbor-rows")
            metrics["neighborhood"] = _first(N.single_summary(per))
            if grouped:
                plain = N.single_rows(N.neighbors(used, k), used, classes)
                metrics["neighborhood_row_level"] = _first(N.single_summary(plain))
            hit = B.single_boundary(per, self._predictions(pred, mode))
        else:
            per = materialise(N.multilabel_rows(edges, used), "neighbor-rows")
            metrics["neighborhood"] = _first(N.multilabel_summary(per))
            hit = B.multilabel_boundary(per, self._predictions(pred, mode))
        hit = materialise(hit, "boundary")
        self.tables |= {"neighbors": per, "boundary": hit}
        cloud = used.join(hit.where("candidate").select("row_id"), "row_id", "left_semi")
        size = cloud.count()
        metrics["boundary"] = {"size": size, "candidate_fraction": size / max(1, rows)}
        if mode == "multilabel":
            metrics["boundary"] |= {"trigger_counts": {r.t: r.n for r in hit.select(F.explode("triggers").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}, "top_labels": [r.asDict() for r in B.candidate_labels(hit, used).collect()]}
        if size < 3:
            metrics["graph"] = {"component_count": 0, "largest_fraction": 1.0 if size else 0.0, "fragmentation": 0.0, "warning": "too few boundary rows for a graph"}
            metrics["topology"] = {"skipped": "too few boundary rows"}
            if mode == "multilabel":
                self._label_topology(used, hit, metrics, ctx)
            return
        cap = c.cap("boundary_rows")
        if size > cap:
            cloud = K.uniform_sample(cloud, cap, c.seed) if mode == "multilabel" else (K.stratified_sample(cloud, cap, c.seed) or K.uniform_sample(cloud, cap, c.seed))
            sampling["boundary"] = {"rows": cap, "of": size}
        cloud = materialise(cloud, "boundary-cloud")
        links = materialise(H.knn_graph(cloud, other=other), "boundary-edges")
        comp = materialise(H.capped_components(cloud, links), "boundary-components")
        graph = _first(H.fragmentation(comp))
        if mode == "singlelabel":
            graph |= _first(H.cross_class_edges(links, cloud))
            if c.limits["repeats"]:
                boot = [r.fragmentation for r in H.fragmentation_bootstrap(cloud, c.limits["repeats"], c.seed, grouped=grouped).collect()]
                graph |= {"bootstrap_mean": sum(boot) / len(boot), "bootstrap_std": (sum((x - sum(boot) / len(boot)) ** 2 for x in boot) / len(boot)) ** 0.5}
        else:
            graph |= _first(H.multilabel_edges(links, cloud)) | _first(H.multilabel_components(comp, cloud))
        metrics["graph"] = graph
        if mode == "multilabel":
            self._label_topology(used, hit, metrics, ctx)
        else:
            self._topology(cloud, metrics, ctx)

    def _cloud(self, rows: DataFrame) -> np.ndarray:
        """The features of at most the budget's and topology's number of rows, by draw."""
        cap = min(self.config.cap("boundary_rows"), T.MOST_ROWS)
        return np.array([r.features for r in K.uniform_sample(rows, cap, self.config.seed).select("features").collect()])

    def _no_topology(self, why: str, ctx: Context) -> None:
        asked = self.config.topology == "persistent"
        ctx.skip("topology", why, severity="caution" if asked else None, status="skipped" if asked else "informational")

    def _topology(self, cloud: DataFrame, metrics: dict, ctx: Context) -> None:
        c = self.config
        why = T.gate(c.topology, c.budget, metrics["boundary"]["size"], (metrics.get("geometry") or {}).get("concentration", 1.0))
        if why:
            metrics["topology"] = {"skipped": why}
            self._no_topology(why, ctx)
            return
        metrics["topology"] = T.persistence_summary(self._cloud(cloud))

    def _label_topology(self, used: DataFrame, hit: DataFrame, metrics: dict, ctx: Context) -> None:
        """The boundary's cloud, and the positives' of the labels that are most frequent there."""
        why = T.off(self.config.topology, self.config.budget)
        if why:
            metrics["topology"] = {"skipped": why}
            self._no_topology(why, ctx)
            return
        near = used.join(hit.where("candidate").select("row_id"), "row_id", "left_semi")
        counts = lambda df: {r.i: r.n for r in df.select(F.posexplode("labels").alias("i", "v")).groupBy("i").agg(F.sum("v").cast("long").alias("n")).collect()}
        chosen, skipped = T.choose_labels(counts(used), counts(near))
        objects, size = {}, metrics["boundary"]["size"]
        objects["boundary"] = T.persistence_summary(self._cloud(near)) if size >= T.LEAST_ROWS else {"skipped": f"{size} boundary rows are fewer than {T.LEAST_ROWS}"}
        if size < T.LEAST_ROWS:
            self._no_topology(objects["boundary"]["skipped"], ctx)
        labels = [T.persistence_summary(self._cloud(used.where(F.col("labels")[i] == 1))) | {"label_idx": i, "label": self._names[i]} for i in chosen]
        strength = [x["strength"] for x in (objects["boundary"], *labels) if "strength" in x]
        metrics["topology"] = objects | {"labels": labels, "skipped_labels": [x | {"label": self._names[x["label_idx"]]} for x in skipped], "strength": max(strength, default=0.0)}
        if not strength:
            metrics["topology"]["skipped"] = "no cloud is large enough"

    def _regression_topology(self, used: DataFrame, per: DataFrame, pred: DataFrame | None, metrics: dict, ctx: Context) -> None:
        c = self.config
        if c.topology == "off" or c.topology == "auto" and c.budget == "fast":
            metrics["topology"] = {"skipped": "topology is off"}
            return
        objects = {}
        sets = {"discontinuity": T.hard_subset(per, "target_distance").select("row_id")}
        if pred is not None:
            sets["residual"] = T.hard_subset(T.residual_size(used, pred.where("probe = 'linear'")), "residual").select("row_id")
        for name, ids in sets.items():
            cloud = K.uniform_sample(used.join(ids, "row_id", "left_semi"), min(c.cap("boundary_rows"), T.MOST_ROWS), c.seed)
            cloud = materialise(cloud, "hard-rows")
            size = cloud.count()
            if size < T.LEAST_ROWS:
                objects[name] = {"skipped": f"{size} rows"}
                continue
            own = T.mutual_summary(cloud)
            if c.topology != "graph":
                own["persistent"] = T.persistence_summary(self._cloud(cloud))
            objects[name] = own | {"strength": max(own["fragmentation"], own.get("persistent", {}).get("strength", 0.0))}
        metrics["topology"] = {"objects": objects, "strength": max((o["strength"] for o in objects.values() if "strength" in o), default=None)}

    def _mlp(self, df: DataFrame, mode: str, grouped: bool, d: int, probes: dict, metrics: dict, ctx: Context) -> None:
        c, limits = self.config, MLP_BUDGETS[self.config.budget]
        why = M.not_triggered(mode, probes, c.mlp_trigger_skill_threshold)
        metrics["mlp_trigger"] = {"ran": why is None, "reason": why}
        if why:
            return
        rows = df.count()
        used = self._capped(df, mode, grouped, rows, min(limits["rows"], c.cap("probe_rows")))
        if used is None:
            ctx.skip("mlp", "no sample keeps every class", severity="caution")
            return
        used = materialise(self._coded(used, mode), "mlp-cohort")
        folded, _ = self._folded(used, mode, grouped, used.count())
        if folded is None:
            ctx.skip("mlp", "too few rows to hold any back", severity="caution")
            return
        folded = materialise(folded.where(F.col("fold") >= 0), "mlp-folds")
        settings = P.ProbeSettings(mode, max(1, N.default_k(used.count())), c.seed, c.max_dense_mb)
        result = M.override(folded, settings, limits, parameters=c.mlp_max_parameters or limits["parameters"], least=c.mlp_min_improvement, grouped=grouped)
        metrics["mlp_probes"], metrics["mlp_override"] = result["probes"], result
        for text in result.get("warnings", ()):
            ctx.warn(text)
        if result.get("failed"):
            ctx.skip("mlp_probes", f"no predictions for every row: {', '.join(result['failed'])}", severity="caution")


_SHARED = {"reliability": "Share of checks that passed."}
_INTERPRETATIONS = {
    "singlelabel": _SHARED | {"signal": "How much of the gap between class shares and perfection the best probe closes.", "overlap": "How mixed neighbourhoods are.", "linearity": "The linear probe's score relative to the best.", "nonlinearity": "How much of the linear probe's gap a curved probe closes.", "fragmentation": "How far boundary rows fall into pieces."},
    "multilabel": _SHARED | {"signal": "Gain over label prevalence, by metric.", "coherence": "Mean Jaccard similarity of neighbours' labels."},
    "regression": _SHARED | {"signal": "Gain over the target mean, by metric.", "smoothness": "How little targets change between neighbours."},
}


def diagnose(df: DataFrame, *, row_id: str = "row_id", features: str = "features", target: str | list[str] = "label", groups: str | None = None, names: list[str] | None = None, return_report: bool = False, **settings):
    """Diagnose ``df``; the recommendation as text, or the whole report.

    ``features`` is an array of numbers or a vector column, sparse or dense.  ``target`` names the label column (any atomic type), an array of 0/1 labels, or
    (with ``target_mode='regression'``) a number or an array of numbers.  A list of
    columns stands for an array of them, and their names for ``names``.
    """
    if dict(df.dtypes)[features] == "vector":  # sparse or dense
        df = df.withColumn(features, vector_to_array(F.col(features)))
    regression = settings.get("target_mode", "auto") == "regression"
    if isinstance(target, list):
        col, name, names = F.array(*(F.col(c).cast("double" if regression else "int") for c in target)), "targets" if regression else "labels", names or target
    else:
        array = dict(df.dtypes)[target].startswith("array")
        if regression:
            col, name, names = F.col(target) if array else F.array(F.col(target).cast("double")), "targets", names or (None if array else [target])
        else:
            col, name = F.col(target), "labels" if array else "label"
    out = df.select(F.col(row_id).alias("row_id"), F.col(features).alias("features"), col.alias(name), *([F.col(groups).alias("group_id")] if groups else []))
    p = Profiler(**settings).fit(out, names=names)
    return p.report() if return_report else p.recommendation()
