"""Optional network probes: when they run, which shapes, how they are trained and when they override.

Networks are small and the cohort is capped (at most 10,000 rows), so each
(shape, fold) trains in numpy inside one group of a single Spark job.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescope.runtime import materialise

from .bootstrap import compared, lookup
from .probes import PREDICTIONS, PROBES, ProbeSettings, balanced, out_of_fold, quadratic_variant, scaler
from .scoring import METRICS, scores

NEED = {"singlelabel": 1, "multilabel": 2, "regression": 2}
WIDE, LONG_RUN = 1000, 5000


def skill(lower: float | None, dummy_upper: float | None) -> float | None:
    """Share of the gap above the dummy that is surely closed."""
    if lower is None or dummy_upper is None or dummy_upper >= 1:
        return None
    return min(1.0, max(0.0, (lower - dummy_upper) / (1 - dummy_upper)))


def not_triggered(mode: str, probes: dict, threshold: float) -> str | None:
    """Why the networks need not run (simple probes are good enough); None if they should."""
    strong, known = [], 0
    for m in METRICS[mode]:
        dummy = probes.get("dummy", {}).get(m)
        rest = [v[m] - (v.get(f"stability_{m}_std") or 0.0) for k, v in probes.items() if k != "dummy" and v.get(m) is not None]
        if dummy is None or not rest:
            continue
        known += 1
        upper = dummy + (probes["dummy"].get(f"stability_{m}_std") or 0.0)
        s = skill(max(rest), upper)
        if s is not None and s >= threshold:
            strong.append(m)
    if not known:
        return "no probe has a score"
    enough = {"singlelabel": 1, "multilabel": 2, "regression": 2}[mode]
    return f"simple probes already reach the skill threshold on {', '.join(strong)}" if len(strong) >= min(enough, known) else None


def parameters(d: int, o: int, hidden: tuple[int, ...]) -> int:
    sizes = (d, *hidden, o)
    return sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))


def two_layer_width(d: int, o: int, budget: int) -> int:
    """Width w of two equal layers with about ``budget`` parameters: w^2 + (d + o + 2) w + o = budget."""
    b = d + o + 2
    return max(1, int((-b + (b * b - 4 * (o - budget)) ** 0.5) / 2))


def shapes(d: int, o: int, most: int) -> list[tuple[str, tuple[int, ...]]]:
    """A compact and a wide single layer, and two layers matched to each in parameters."""
    compact = min(256, max(16, 1 << int(np.ceil(np.log2(max(1.0, (d * o) ** 0.5))))))
    wide = min(512, 4 * compact)
    out = []
    for name, w in (("compact", compact), ("wide", wide)):
        out.append((f"mlp_{name}", (w,)))
        w2 = two_layer_width(d, o, parameters(d, o, (w,)))
        out.append((f"mlp_{name}_deep", (w2, w2)))
    return [(n, h) for n, h in out if parameters(d, o, h) <= most]


def validation_rows(Y: np.ndarray, mode: str, rng: np.random.Generator, groups: np.ndarray | None = None, *, share: float = 0.2, attempts: int = 32) -> np.ndarray:
    """Rows to stop early on: about a fifth, whole groups if there are any, with every class (or side of every label) here and among the rest; none if that fails."""
    n, none = len(Y), np.empty(0, np.int64)
    if n < 8:
        return none
    sides = np.arange(int(Y[:, 0].max()) + 1)[None] == Y[:, :1] if mode == "singlelabel" else np.concatenate([Y == 1, Y == 0], 1) if mode == "multilabel" else np.ones((n, 1), bool)
    sides = sides[:, sides.any(0)]
    units = np.unique(groups) if groups is not None else None
    if units is not None and len(units) < 2:
        units = None
    for _ in range(attempts):
        if units is not None:
            held = np.flatnonzero(np.isin(groups, rng.permutation(units)[: max(1, round(share * len(units)))]))
        elif mode == "singlelabel":  # a fifth of each class
            order = rng.permutation(n)
            held = np.concatenate([own[: max(1, round(share * len(own)))] for c in np.unique(Y[:, 0]) for own in (order[Y[order, 0] == c],)])
        else:
            held = rng.permutation(n)[: max(1, int(share * n))]
        rest = np.setdiff1d(np.arange(n), held)
        if len(rest) and sides[held].any(0).all() and sides[rest].any(0).all():
            return np.sort(held)
    return none


class Network:
    """ReLU layers trained by AdamW with warm-up, cosine decay, clipped gradients and early stopping."""

    def __init__(self, hidden: tuple[int, ...], mode: str, *, epochs: int, patience: int, seed: int, batch: int = 256):
        self.hidden, self.mode, self.epochs, self.patience, self.seed, self.batch = hidden, mode, epochs, patience, seed, batch

    def _forward(self, X: np.ndarray) -> list[np.ndarray]:
        out = [X]
        for i, (W, b) in enumerate(self.layers):
            z = out[-1] @ W + b
            out.append(np.maximum(z, 0) if i < len(self.layers) - 1 else z)
        return out

    def _loss(self, z: np.ndarray, T: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        n = len(z)
        if self.mode == "singlelabel":
            z = z - z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            return float(-(w * np.log(np.maximum((p * T).sum(1), 1e-12))).mean()), (p - T) * w[:, None] / n
        if self.mode == "multilabel":
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            c = np.where(T == 1, self.positive, 1.0)
            return float((c * (np.logaddexp(0, z) - T * z)).mean()), c * (p - T) / T.size
        return float(((z - T) ** 2).mean()), 2 * (z - T) / T.size

    def fit(self, X: np.ndarray, Y: np.ndarray, groups: np.ndarray | None = None) -> Network:
        rng = np.random.default_rng(self.seed)
        self.m, self.s = scaler(X)
        A = (X - self.m) / self.s
        w = np.ones(len(A))
        if self.mode == "singlelabel":
            y = Y[:, 0].astype(int)
            T, w = np.eye(int(y.max()) + 1)[y], balanced(y, int(y.max()) + 1)
        elif self.mode == "multilabel":
            T, p = Y, Y.mean(0)
            self.positive = np.clip((1 - p) / np.maximum(p, 1e-9), 0.1, 10)
        else:
            self.ym, self.ys = scaler(Y)
            T = (Y - self.ym) / self.ys
        held = validation_rows(Y, self.mode, rng, groups)
        own, cut = np.setdiff1d(np.arange(len(A)), held), len(held)
        sizes = (A.shape[1], *self.hidden, T.shape[1])
        self.layers = [[rng.normal(0, np.sqrt((2 if i < len(sizes) - 2 else 1) / a), (a, b)), np.zeros(b)] for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True))]
        M, V, t = [[np.zeros_like(x) for x in y] for y in self.layers], [[np.zeros_like(x) for x in y] for y in self.layers], 0
        best, kept, waited = np.inf, None, 0
        for epoch in range(self.epochs):
            rate = 1e-3 * ((epoch + 1) / 5 if epoch < 5 else 0.5 * (1 + np.cos(np.pi * (epoch - 5) / max(1, self.epochs - 5))))
            for at in np.array_split(rng.permutation(own), max(1, len(own) // self.batch)):
                acts = self._forward(A[at])
                _, g = self._loss(acts[-1], T[at], w[at])
                grads = []
                for i in range(len(self.layers) - 1, -1, -1):
                    grads.append((acts[i].T @ g, g.sum(0)))
                    g = (g @ self.layers[i][0].T) * (acts[i] > 0)
                grads.reverse()
                norm = np.sqrt(sum((x**2).sum() for y in grads for x in y))
                t += 1
                for i, pair in enumerate(grads):
                    for j, x in enumerate(pair):
                        x = x * min(1.0, 5 / max(norm, 1e-12))
                        M[i][j] = 0.9 * M[i][j] + 0.1 * x
                        V[i][j] = 0.95 * V[i][j] + 0.05 * x * x
                        step = M[i][j] / (1 - 0.9**t) / (np.sqrt(V[i][j] / (1 - 0.95**t)) + 1e-8)
                        self.layers[i][j] = self.layers[i][j] * (1 - rate * 1e-4 * (j == 0)) - rate * step
            if cut:
                v, _ = self._loss(self._forward(A[held])[-1], T[held], w[held])
                if v < best - 1e-6:
                    best, kept, waited = v, [[x.copy() for x in y] for y in self.layers], 0
                else:
                    waited += 1
                    if waited >= self.patience:
                        break
        if kept is not None:
            self.layers = kept
        return self

    def predict(self, X: np.ndarray) -> np.ndarray:
        z = self._forward((X - self.m) / self.s)[-1]
        if self.mode == "singlelabel":
            return z.argmax(1)[:, None].astype(float)
        return (z > 0).astype(float) if self.mode == "multilabel" else z * self.ys + self.ym


def network_predictions(df: DataFrame, mode: str, own: list[tuple[str, tuple[int, ...]]], limits: dict, seed: int) -> DataFrame:
    """Out-of-fold predictions of every shape, as ``probes.out_of_fold`` gives them.

    A fit that fails or is not finite gives no predictions for its fold, so that its shape is incomplete and the others go on.
    """
    grouped = "group_id" in df.columns
    folds = [r.fold for r in df.select("fold").distinct().orderBy("fold").collect()]
    by_name = dict(own)

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        probe, held = key
        pdf = pdf.sort_values("row_id")
        X, Y = np.stack(pdf["features"].to_numpy()).astype(float), np.stack(pdf["y"].to_numpy()).astype(float)
        fold, ids = pdf["own_fold"].to_numpy(), pdf["row_id"].to_numpy()
        out = fold == held
        groups = np.unique(pdf["group_id"].astype(str).to_numpy(), return_inverse=True)[1] if grouped else None
        try:
            net = Network(by_name[probe], mode, epochs=limits["epochs"], patience=limits["patience"], seed=seed).fit(X[~out], Y[~out], None if groups is None else groups[~out])
            got = net.predict(X[out])
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            got = np.full((int(out.sum()), 1), np.nan)
        if not np.isfinite(got).all():
            out, got = np.zeros(len(out), bool), got[:0]
        return pd.DataFrame({"row_id": ids[out], "fold": fold[out].astype(np.int32), "probe": probe, "y": pd.Series(list(Y[out]), dtype=object), "prediction": pd.Series(list(got), dtype=object)})

    plan = F.explode(F.array(*(F.struct(F.lit(p).alias("probe"), F.lit(f).alias("held")) for p in by_name for f in folds)))
    rows = df.select("row_id", "features", "y", *(["group_id"] if grouped else []), F.col("fold").alias("own_fold"), plan.alias("cell")).select("*", "cell.probe", "cell.held").drop("cell")
    return rows.groupBy("probe", "held").applyInPandas(run, PREDICTIONS)


def runtime_warnings(d: int, own: list[tuple[str, tuple[int, ...]]], o: int, most: int, epochs: int, folds: int) -> list[str]:
    """What may make the networks slow."""
    out = []
    if d >= WIDE:
        out.append(f"networks on {d} features may be slow even on a capped cohort")
    if any(parameters(d, o, h) >= most / 2 for _, h in own):
        out.append("a network uses at least half of the allowed parameters")
    if epochs * folds * len(own) >= LONG_RUN:
        out.append(f"up to {epochs * folds * len(own)} epochs of training in all")
    return out


def override(folded: DataFrame, settings: ProbeSettings, limits: dict, *, parameters: int, least: float, grouped: bool = False) -> dict:
    """Scores of all shapes and of the simple probes on the same folds, and whether the best shape overrides.

    It does if on enough metrics it beats the dummy, and the strongest simple probe by at least ``least``, both with a paired interval above 0.
    """
    mode = settings.mode
    first = folded.first()
    d, o = len(first.features), len(first.y)
    if mode == "singlelabel":
        o = int(folded.agg(F.max(F.col("y")[0])).first()[0]) + 1
    own = shapes(d, o, parameters)
    if not own:
        return {"override": False, "reason": "every shape has too many parameters", "probes": {}}
    n = folded.count()
    simple = [p for p in PROBES if p != "smooth_poly" or quadratic_variant(n, d, settings.max_dense_mb)[0] != "skipped"]
    pred = materialise(network_predictions(folded, mode, own, limits, settings.seed).unionByName(out_of_fold(folded, settings, simple)), "network-predictions")
    whole = {r.probe for r in pred.groupBy("probe").count().where(F.col("count") == n).collect()}  # probes
    broken = [x for x, _ in own if x not in whole]
    own = [(x, h) for x, h in own if x in whole]
    lost = [p for p in PROBES if p not in whole]
    if not own or "dummy" in lost or len(lost) == len(PROBES):
        return {"override": False, "reason": "no shape has predictions for every row" if not own else f"comparators are missing: {', '.join(lost)}", "probes": {}, "failed": broken, "missing_comparators": lost}
    pred = pred.where(F.col("probe").isin(sorted(whole)))
    table = {r.probe: r.asDict() for r in scores(pred, mode, "probe").collect()}
    names = METRICS[mode]
    mean = lambda p: float(np.mean([table[p][m] if table[p][m] is not None else -np.inf for m in names]))
    best = max((n for n, _ in own), key=lambda n: (mean(n), -[x for x, _ in own].index(n)))
    some = pred.where(F.col("probe").isin([best, *PROBES]))
    pairs = compared(folded, some, mode, limits["resamples"], settings.seed, grouped=grouped)
    won = []
    for m in names:
        rest = [(table[p][m], p) for p in PROBES if p != "dummy" and p in table and table[p][m] is not None]
        if not rest or pairs is None:
            continue
        a, b = lookup(pairs, best, "dummy", m), lookup(pairs, best, max(rest)[1], m)
        if a and b and a["point_delta"] > 0 and a["lower_95"] > 0 and b["point_delta"] >= least and b["lower_95"] > 0:
            won.append(m)
    skills = {m: skill(table[best][m], table["dummy"][m]) for m in names}
    warned = runtime_warnings(d, own, o, parameters, limits["epochs"], folded.select("fold").distinct().count())
    return {"override": len(won) >= NEED[mode], "best": best, "skill": skills, "warnings": warned, "minimum_improvement": least, "required_metrics": NEED[mode], "hidden": list(dict(own)[best]), "won_metrics": won, "probes": table, "failed": broken, "missing_comparators": lost, "reason": None if len(won) >= NEED[mode] else f"clear on {len(won)} of {NEED[mode]} metrics needed"}
