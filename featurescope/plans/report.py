"""The result of a diagnosis: a dataclass of small values, as text, dict or JSON."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from featurescope import config as C

# Long entries that the terse form leaves out, of those that the diagnosis makes.
LONG = frozenset({"per_label_metrics", "per_target_metrics", "fold_assignments", "predictions"})

HEADLINES = {
    C.LINEAR: "A linear model should do.",
    C.SMOOTH: "A smooth nonlinear model should help.",
    C.LOCAL: "A kernel or local model should help.",
    C.PARTITIONED: "A partitioning or high-capacity model should help.",
    C.MLP: "The feed-forward network was clearly the best probe.",
    C.BOTTLENECK: "The features or the target hold too little signal.",
    C.INSUFFICIENT: "There is too little reliable evidence.",
    C.INCONCLUSIVE: "The evidence does not settle on one family.",
}
NEXT = {
    C.LINEAR: "Start with a regularised linear model and check its calibration.",
    C.SMOOTH: "Try splines, quadratic terms or gradient boosting of low depth.",
    C.LOCAL: "Try kernels, nearest neighbours or deeper trees.",
    C.PARTITIONED: "Try tree ensembles, mixtures or networks, with held-out checks.",
    C.MLP: "Tune a small network from the selected architecture.",
    C.BOTTLENECK: "Look for better features, cleaner labels or a different target before better models.",
    C.INSUFFICIENT: "Collect more rows of the rare classes, or more groups.",
    C.INCONCLUSIVE: "Repeat with a larger budget, or compare two families directly.",
}


def plain(x: Any, *, terse: bool = False) -> Any:
    """A JSON-safe copy: numpy to Python, dataclasses to dicts, non-finite numbers to None."""
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        x = {f.name: getattr(x, f.name) for f in dataclasses.fields(x)}
    if isinstance(x, dict):
        return {str(k): plain(v, terse=terse) for k, v in x.items() if not (terse and k in LONG)}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [plain(v, terse=terse) for v in (sorted(x, key=str) if isinstance(x, (set, frozenset)) else x)]
    if isinstance(x, np.ndarray):
        return plain(x.tolist(), terse=terse)
    if isinstance(x, np.generic):
        x = x.item()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


@dataclass
class Report:
    recommendation: str
    recommendation_text: str
    confidence: str
    metrics: dict
    scores: dict
    interpretations: dict = field(default_factory=dict)
    decision_path: list = field(default_factory=list)
    warnings: list = field(default_factory=list)
    errors: list = field(default_factory=list)
    skipped_diagnostics: list = field(default_factory=list)
    preprocessing: dict = field(default_factory=dict)
    sampling: dict = field(default_factory=dict)
    densification_events: list = field(default_factory=list)
    class_summary: dict = field(default_factory=dict)
    grouping: dict = field(default_factory=dict)
    runtime: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)

    def to_dict(self, *, terse: bool = False) -> dict:
        return plain(self, terse=terse)

    def to_json(self, *, indent: int | None = 2, terse: bool = False) -> str:
        return json.dumps(self.to_dict(terse=terse), indent=indent, sort_keys=True, allow_nan=False)


def render(mode: str, recommendation: str, confidence: str, scores: dict, path: list[str], frontier: dict) -> str:
    """The recommendation in words."""
    lines = [HEADLINES[recommendation], f"Confidence: {confidence}. Target: {mode}.", "", "Scores:"]
    lines += [f"  {k}: {'unavailable' if v is None else f'{v:.3f}'}" for k, v in scores.items()]
    if frontier.get("plausible"):
        lines += ["", "Families not clearly beaten: " + ", ".join(frontier["plausible"]) + "."]
    return "\n".join([*lines, "", "Why:", *(f"  - {p}" for p in path), "", f"Next: {NEXT[recommendation]}"])
