"""From small tables of evidence to a recommendation.

One engine serves the three target modes; ``RULES`` holds what differs.  A *view*
is the state of one probe family on one metric: its best probe's score and error.
Comparisons prefer the paired bootstrap and fall back to the errors' root sum of
squares.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import hypot, sqrt

from featurescope import config as C
from featurescope.operators.bootstrap import lookup

# Thresholds and families.
Z, SIGNAL, IMPROVEMENT = 1.96, 0.05, 0.01
FAMILIES = ("linear", "smooth_nonlinear", "local_kernel")
PROBES = {"dummy": ("dummy",), "linear": ("linear",), "smooth_nonlinear": ("smooth_poly",), "local_kernel": ("knn", "kernel_approx")}
LABELS = {"linear": C.LINEAR, "smooth_nonlinear": C.SMOOTH, "local_kernel": C.LOCAL}
CHECKS = ("missing_dummy_probe", "missing_linear_probe", "missing_predictive_probe", "resubstitution_evaluation", "weak_signal_evidence", "borderline_family_difference", "geometry_diagnostics_unavailable")


@dataclass(frozen=True)
class Rules:
    metrics: tuple[str, ...]
    need: int  # metrics on which an advantage must hold


RULES = {
    "singlelabel": Rules(("balanced_accuracy",), 1),
    "multilabel": Rules(("micro_f1", "macro_f1", "sample_jaccard"), 2),
    "regression": Rules(("r2_variance_weighted", "r2_uniform_average"), 1),
}


@dataclass(frozen=True)
class View:
    family: str
    probe: str | None = None
    score: float | None = None
    error: float | None = None


def clip(x: float | None) -> float | None:
    return None if x is None else min(1.0, max(0.0, float(x)))


def metric_error(mode: str, probe: dict, metric: str, n: int) -> float:
    """Uncertainty of one score without pairs."""
    score, spread = probe.get(metric), probe.get(f"stability_{metric}_std")
    if mode == "singlelabel":
        support = list((probe.get("class_counts") or {}).values())
        recall = probe.get("per_class_recall")
        if not recall or len(recall) != len(support):
            recall = [score] * len(support)
        own = sqrt(max(0.0, sum(r * (1 - r) / max(1, c) for r, c in zip(recall, support, strict=True)))) / len(support) if support else 0.0
        return own if spread is None else max(own, float(spread))
    if spread is not None:
        return float(spread)
    if score is None:
        return 1.0
    return sqrt(max(0.0, score * (1 - score)) / max(1, n)) if mode == "multilabel" else max(0.05, 1 / sqrt(max(1, n)))


class Evidence:
    """Views of all families, and the comparisons between them."""

    def __init__(self, mode: str, probes: dict[str, dict], pairs: list[dict] | None, n: int):
        self.mode, self.rules, self.pairs = mode, RULES[mode], pairs
        self.views: dict[str, dict[str, View]] = {}
        for family, names in PROBES.items():
            self.views[family] = {}
            for metric in self.rules.metrics:
                known = [(probes[p][metric], p) for p in names if probes.get(p, {}).get(metric) is not None]
                if known:
                    score, p = max(known, key=lambda x: x[0])
                    self.views[family][metric] = View(family, p, float(score), metric_error(mode, probes[p], metric, n))
                else:
                    self.views[family][metric] = View(family)

    def has(self, family: str) -> bool:
        return any(v.score is not None for v in self.views[family].values())

    def best(self, metric: str) -> View | None:
        """The family with the highest score; the simpler of equals."""
        known = [self.views[f][metric] for f in FAMILIES if self.views[f][metric].score is not None]
        return max(known, key=lambda v: (v.score, -FAMILIES.index(v.family))) if known else None

    def pair(self, a: View, b: View, metric: str) -> dict | None:
        return lookup(self.pairs, a.probe, b.probe, metric)

    def clearly_better(self, a: View, b: View, metric: str, *, margin: float = IMPROVEMENT) -> bool:
        """``a`` beats ``b`` beyond uncertainty and by the margin (which without pairs holds for single labels only)."""
        if a.score is None or b.score is None:
            return False
        p = self.pair(a, b, metric)
        if p is not None:
            return p["point_delta"] > margin and p["lower_95"] > 0
        gap, error = a.score - b.score, Z * hypot(a.error or 0.0, b.error or 0.0)
        return gap > (max(error, margin) if self.mode == "singlelabel" else error)

    def within_one_error(self, a: View, best: View, metric: str) -> bool:
        """``a`` is at most one standard error below ``best``."""
        if a.score is None or best.score is None:
            return False
        p = self.pair(best, a, metric)
        if p is not None:
            return p["point_delta"] <= max(p["paired_standard_error"] or 0.0, IMPROVEMENT)
        error = hypot(a.error or 0.0, best.error or 0.0)
        return best.score - a.score <= (max(error, IMPROVEMENT) if self.mode == "singlelabel" else error)

    def clear_metrics(self, a: str, b: str) -> list[str]:
        return [m for m in self.rules.metrics if self.clearly_better(self.views[a][m], self.views[b][m], m)]

    def signal_metrics(self) -> list[str]:
        margin = SIGNAL if self.mode == "singlelabel" else IMPROVEMENT
        return [m for m in self.rules.metrics if (b := self.best(m)) is not None and self.clearly_better(b, self.views["dummy"][m], m, margin=margin)]

    @property
    def signal(self) -> bool:
        return len(self.signal_metrics()) >= self.rules.need

    def candidate(self) -> str | None:
        """The simplest family that nothing more complex clearly beats."""
        best = {m: self.best(m) for m in self.rules.metrics}
        if self.mode == "singlelabel":
            (m,) = self.rules.metrics
            if best[m] is None:
                return None
            if self.within_one_error(self.views["linear"][m], best[m], m):
                return "linear"
            if not self.has("smooth_nonlinear"):
                return "local_kernel" if self.has("local_kernel") else best[m].family
            return "local_kernel" if self.has("local_kernel") and self.clear_metrics("local_kernel", "smooth_nonlinear") else "smooth_nonlinear"
        known = [m for m in self.rules.metrics if best[m] is not None]
        within = sum(self.within_one_error(self.views["linear"][m], best[m], m) for m in known)
        worse = sum(self.clearly_better(best[m], self.views["linear"][m], m) for m in known)
        smooth, local = len(self.clear_metrics("smooth_nonlinear", "linear")), len(self.clear_metrics("local_kernel", "smooth_nonlinear"))
        if within >= self.rules.need and not worse:
            return "linear"
        if local >= self.rules.need:
            return "local_kernel"
        return "smooth_nonlinear" if smooth >= self.rules.need else None

    def dominates(self, a: str, b: str) -> bool:
        won = len(self.clear_metrics(a, b))
        if self.mode == "regression":  # better somewhere, worse nowhere
            return won >= 1 and not self.clear_metrics(b, a)
        return won >= self.rules.need

    def method(self, families: list[str]) -> str | None:
        """How the families were compared: by pairs, by marginal errors, or both (``mixed``); None if nothing was."""
        seen = set()
        for m in self.rules.metrics:
            known = [v for f in families if (v := self.views[f][m]).score is not None]
            seen |= {"paired" if self.pair(a, b, m) is not None else "marginal" for i, a in enumerate(known) for b in known[i + 1 :]}
        return "mixed" if len(seen) > 1 else next(iter(seen), None)

    def plausible(self, minimum: str | None, *, blocking: bool) -> dict:
        """Families, from the minimum upwards, that no other of them clearly beats; an assessment of each."""
        able = FAMILIES[FAMILIES.index(minimum) if minimum else 0 :]

        def answer(status: str, reason: str | None, beaten: dict) -> dict:
            own = {f: {"available": self.has(f), "eligible": status == "available" and f in able, "plausible": f in beaten and (f == minimum or not beaten[f]), "dominated_by": beaten.get(f, []), "worse_on": {o: self.clear_metrics(o, f) for o in beaten.get(f, [])}} for f in FAMILIES}
            return {"status": status, "minimum": minimum if status != "not_applicable" else None, "plausible": [f for f in FAMILIES if own[f]["plausible"]], "dominated_by": beaten, "decision_method": self.method(list(able)) if beaten else None, "reason": reason, "assessments": own}

        if blocking or not self.signal:
            return answer("not_applicable", "the evidence is blocked" if blocking else "no probe clearly beats the dummy", {})
        missing = [f for f in able if not self.has(f)]
        if missing:
            return answer("unavailable", "no score", {}) | {"missing": missing}
        return answer("available", None, {f: [o for o in able if o != f and self.dominates(o, f)] for f in able})


def overlap_ratio(proportions: list[float], cross_share: float | None) -> float | None:
    """Observed over expected share of neighbours from other classes, if labels were shuffled."""
    expected = 1 - sum(p * p for p in proportions)
    return cross_share / expected if proportions and expected > 0 and cross_share is not None else None


def fragmented(graph: dict, n_classes: int, proportions: list[float]) -> bool:
    """More components than classes, the largest smaller than the largest class."""
    return bool(graph and proportions and graph.get("component_count", 0) > max(1, n_classes) and graph.get("largest_fraction", 1.0) < max(proportions))


@dataclass
class Decision:
    recommendation: str
    confidence: str
    path: list[str]
    flags: list[dict]
    scores: dict
    evidence: dict = field(default_factory=dict)


def quality_flags(mode: str, e: Evidence, metrics: dict, skips: list[dict], warnings: list[str]) -> list[dict]:
    flags = []

    def add(name: str, severity: str, message: str) -> None:
        if all(f["name"] != name for f in flags):
            flags.append({"name": name, "severity": severity, "message": message})

    audit = metrics.get("audit", {})
    if mode == "multilabel" and not audit.get("usable_labels"):
        add("no_usable_labels", "blocking", "no label has two rows on either side")
    if mode == "regression" and not audit.get("usable_targets"):
        add("no_usable_targets", "blocking", "all targets are constant")
    for family in ("dummy", "linear"):
        if not e.has(family):
            add(f"missing_{family}_probe", "blocking", f"the {family} probe has no score")
    if not any(e.has(f) for f in FAMILIES):
        add("missing_predictive_probe" if mode == "singlelabel" else "all_primary_metrics_unavailable", "blocking", "no predictive probe has a score")
    if mode == "singlelabel" and metrics.get("evaluation") == "resubstitution_low_reliability":
        add("resubstitution_evaluation", "blocking", "too few rows to hold any back")
    counted = [s for s in skips if s.get("status") not in ("informational", "not_applicable")]
    if counted:
        add("skipped_diagnostics_present", "caution", f"{len(counted)} diagnostics were skipped")
    if warnings:
        add("warnings_present", "caution", f"{len(warnings)} warnings were recorded")
    if mode == "singlelabel":
        if metrics.get("geometry", {}).get("concentration") is None:
            add("geometry_diagnostics_unavailable", "info", "distance concentration is unknown")
        (m,) = e.rules.metrics
        best, dummy = e.best(m), e.views["dummy"][m]
        if best is not None and dummy.score is not None and not e.signal:
            add("weak_signal_evidence", "caution", "the best probe does not clearly beat the class shares")
        local, smooth = e.views["local_kernel"][m], e.views["smooth_nonlinear"][m]
        if None not in (local.score, smooth.score) and local.score > smooth.score and not e.clearly_better(local, smooth, m):
            add("borderline_family_difference", "caution", "local probes lead the smooth one, but not clearly")
    if metrics.get("topology", {}).get("skipped"):
        add("topology_diagnostics_unavailable", "info", metrics["topology"]["skipped"])
    if metrics.get("graph", {}).get("warning"):
        add("boundary_graph_limited", "info", metrics["graph"]["warning"])
    for s in skips:
        if s.get("severity") in ("blocking", "caution"):
            add(s["name"], s["severity"], s["reason"])
    return flags


def decide(mode: str, probes: dict, pairs: list[dict] | None, metrics: dict, *, n: int, skips: list[dict] = (), warnings: list[str] = ()) -> Decision:
    """The recommendation, its confidence, the steps that led there, and scores from 0 to 1."""
    e = Evidence(mode, probes, pairs, n)
    flags = quality_flags(mode, e, metrics, list(skips), list(warnings))
    blocking, caution = (any(f["severity"] == s for f in flags) for s in ("blocking", "caution"))
    near, graph, audit = metrics.get("neighborhood", {}), metrics.get("graph", {}), metrics.get("audit", {})
    shares = list((audit.get("proportions") or {}).values())
    ratio = overlap_ratio(shares, near.get("cross_class_neighbor_fraction"))
    chosen = e.candidate() if e.signal and not (blocking and mode != "singlelabel") else None
    path = []
    if blocking:
        label = C.INSUFFICIENT
        path.append("Blocked: " + ", ".join(f["name"] for f in flags if f["severity"] == "blocking") + ".")
    elif not e.signal:
        weak = {
            "singlelabel": ratio is not None and ratio >= 1,
            "multilabel": near.get("mean_neighbor_jaccard", 1.0) is not None and near.get("mean_neighbor_jaccard", 1.0) < 0.2,
            "regression": near.get("smoothness") is not None and near["smoothness"] < 0.35,
        }[mode]
        label = C.BOTTLENECK if weak else C.INCONCLUSIVE
        path.append(f"No probe clearly beats the dummy on {e.rules.need} of {len(e.rules.metrics)} metrics.")
    else:
        label = LABELS.get(chosen, C.INCONCLUSIVE)
        path.append(f"Clear signal on {', '.join(e.signal_metrics())}; simplest family that holds its own: {chosen}.")
        if chosen == "local_kernel":
            split = {
                "singlelabel": bool(e.clear_metrics("local_kernel", "smooth_nonlinear")) and fragmented(graph, audit.get("n_classes", 1), shares),
                "multilabel": (graph.get("fragmentation") or 0) >= 0.5 and metrics.get("boundary", {}).get("size", 0) >= 10,
                "regression": (near.get("discontinuity_fraction") or 0) >= 0.35,
            }[mode]
            if split:
                label = C.PARTITIONED
                path.append("The boundary is in pieces: capacity or partitioning beyond local models.")
    mlp = metrics.get("mlp_override") or {}
    if mlp.get("override"):
        label = C.MLP
        path.insert(0, "The optional network clearly beats every simpler probe.")
    if flags:
        path.append("Flags: " + ", ".join(f["name"] for f in flags) + ".")
    path.append("Compared by paired bootstrap." if pairs is not None else "Compared by marginal errors; pairs were unavailable.")
    if label == C.INSUFFICIENT:
        confidence = "low"
    elif mode == "singlelabel":
        confidence = ("low" if caution else "medium") if label == C.INCONCLUSIVE else "low" if blocking else "medium" if caution else "high"
    else:
        confidence = "medium" if caution else "high"
    frontier = e.plausible(chosen, blocking=blocking)
    return Decision(label, confidence, path, flags, summary_scores(mode, e, metrics, flags, ratio), {"signal_metrics": e.signal_metrics(), "recommended_family": chosen, "candidate_family": e.candidate(), "plausible_family_set": frontier, "overlap_ratio": ratio, "views": {f: {m: vars(v) for m, v in x.items()} for f, x in e.views.items()}})


def summary_scores(mode: str, e: Evidence, metrics: dict, flags: list[dict], ratio: float | None) -> dict:
    near, graph = metrics.get("neighborhood", {}), metrics.get("graph", {})
    topology = clip(metrics.get("topology", {}).get("strength"))
    out: dict[str, float | None] = {}
    if mode == "singlelabel":
        (m,) = e.rules.metrics
        v = {f: e.views[f][m].score for f in e.views}
        best = e.best(m).score if e.best(m) else None
        curved = max((v[f] for f in ("smooth_nonlinear", "local_kernel") if v[f] is not None), default=None)
        parts = [near.get(k, 0.0) or 0.0 for k in ("mean_local_entropy", "high_entropy_fraction", "cross_class_neighbor_fraction")]
        passed = sum(c not in {f["name"] for f in flags} for c in CHECKS) / len(CHECKS)
        return {
            "signal_score": None if None in (best, v["dummy"]) else clip((best - v["dummy"]) / max(1e-9, 1 - v["dummy"])),
            "overlap_score": clip(sum(parts) / 3),
            "linearity_score": None if None in (best, v["linear"]) else clip(v["linear"] / max(best, 1e-9)),
            "nonlinearity_score": None if None in (curved, v["linear"]) else clip((curved - v["linear"]) / max(1e-9, 1 - v["linear"])),
            "fragmentation_score": clip(graph.get("fragmentation") or 0.0),
            "topology_score": topology,
            "reliability_score": passed,
        }
    for m in e.rules.metrics:
        best, dummy, linear = e.best(m), e.views["dummy"][m].score, e.views["linear"][m].score
        out[f"signal_{m}"] = None if best is None or dummy is None else max(0.0, best.score - dummy)
        if mode == "multilabel":
            out[f"linearity_{m}"] = None if best is None or linear is None else clip(linear / max(best.score, 1e-9))
    if mode == "multilabel":
        out |= {"neighborhood_coherence_score": near.get("mean_neighbor_jaccard"), "fragmentation_score": graph.get("fragmentation")}
    else:
        best, linear = e.best("r2_variance_weighted"), e.views["linear"]["r2_variance_weighted"].score
        out |= {"linearity_score": None if best is None or linear is None or best.score <= 0 else clip(linear / max(best.score, 1e-9)), "target_smoothness_score": near.get("smoothness"), "high_discontinuity_fraction": near.get("discontinuity_fraction")}
    raised = [f["severity"] != "blocking" for f in flags]
    return out | {"topology_score": topology, "reliability_score": sum(raised) / len(raised) if raised else 1.0}
