"""Versioned descriptions of probes, and their way back to runnable ones.

A recipe is JSON: what the probe is, on what shape of data it ran, and how.  Its
id is the SHA-256 of the canonical JSON without id and creator.  Only the probes
named in ``ALLOWED`` can be rebuilt; nothing in a recipe is ever executed.
"""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import asdict, dataclass
from importlib.metadata import PackageNotFoundError, version

import numpy as np

from featurescope.operators.mlp import Network
from featurescope.operators.probes import PROBES, ProbeSettings, fit_predict

SCHEMA, VERSION = "featurescope.probe", 1
ALLOWED = (*PROBES, "mlp")
FAMILY = {"dummy": "dummy", "linear": "linear", "smooth_poly": "smooth_nonlinear", "knn": "local_kernel", "kernel_approx": "local_kernel", "mlp": "feedforward_mlp"}


def runtime_versions() -> dict:
    out = {}
    for name in ("pyspark", "numpy"):
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            out[name] = None
    return out


def _safe(x, path: str = "recipe"):
    if isinstance(x, dict):
        if not all(isinstance(k, str) for k in x):
            raise TypeError(f"{path}: keys must be strings")
        return {k: _safe(v, f"{path}.{k}") for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_safe(v, f"{path}[{i}]") for i, v in enumerate(x)]
    if isinstance(x, np.generic):
        x = x.item()
    if x is None or isinstance(x, (bool, int, str)) or isinstance(x, float) and np.isfinite(x):
        return x
    raise TypeError(f"{path}: {type(x).__name__} cannot be stored")


def recipe_id(payload: dict) -> str:
    own = {k: v for k, v in payload.items() if k not in ("recipe_id", "created_with")}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


@dataclass(frozen=True)
class Recipe:
    probe: str
    family: str
    target_mode: str
    input_contract: dict
    settings: dict
    created_with: dict
    schema: str = SCHEMA
    version: int = VERSION

    def to_dict(self) -> dict:
        out = _safe(asdict(self))
        return out | {"recipe_id": recipe_id(out)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @staticmethod
    def from_dict(payload: dict) -> Recipe:
        payload = _safe(payload)
        missing = {"schema", "version", "probe", "family", "target_mode", "input_contract", "settings", "recipe_id"} - set(payload)
        if missing:
            raise ValueError(f"the recipe lacks {', '.join(sorted(missing))}")
        if payload["schema"] != SCHEMA or payload["version"] != VERSION:
            raise ValueError(f"unknown schema {payload['schema']!r} version {payload['version']!r}")
        if payload["probe"] not in ALLOWED:
            raise ValueError(f"unknown probe {payload['probe']!r}")
        if payload["recipe_id"] != recipe_id(payload):
            raise ValueError("the recipe does not match its id")
        return Recipe(*(payload.get(k, {}) for k in ("probe", "family", "target_mode", "input_contract", "settings", "created_with")))


def probe_recipe(probe: str, mode: str, n_features: int, s: ProbeSettings) -> Recipe:
    return Recipe(probe, FAMILY[probe], mode, {"representation": "dense", "n_features": n_features}, {"k": s.k, "seed": s.seed, "max_dense_mb": s.max_dense_mb}, runtime_versions())


class Estimator:
    """An unfitted probe: ``fit`` keeps the training rows, ``predict`` follows the probe's rule."""

    def __init__(self, recipe: Recipe):
        self.recipe = recipe

    def fit(self, X, Y) -> Estimator:
        self.X, self.Y = np.asarray(X, float), np.asarray(Y, float).reshape(len(X), -1)
        if self.X.shape[1] != self.recipe.input_contract["n_features"]:
            raise ValueError("the number of features differs from the recipe's")
        if self.recipe.probe == "mlp":
            self.net = Network(tuple(self.recipe.settings["hidden"]), self.recipe.target_mode, epochs=self.recipe.settings["epochs"], patience=self.recipe.settings["patience"], seed=self.recipe.settings["seed"]).fit(self.X, self.Y)
        return self

    def predict(self, X) -> np.ndarray:
        X = np.asarray(X, float)
        if self.recipe.probe == "mlp":
            return self.net.predict(X)
        s = ProbeSettings(self.recipe.target_mode, self.recipe.settings["k"], self.recipe.settings["seed"], self.recipe.settings["max_dense_mb"])
        return fit_predict(self.recipe.probe, self.X, self.Y, np.arange(len(self.X)), X, s)


def encode_estimator(estimator: Estimator) -> dict:
    """A JSON-safe description of a probe, fitted or not (what it learned is left out); TypeError for anything else."""
    if type(estimator) is not Estimator:
        raise TypeError(f"{type(estimator).__name__} is no probe of this engine")
    r = estimator.recipe
    return {"kind": "estimator", "key": r.probe, "params": _safe({"target_mode": r.target_mode, **r.input_contract, **r.settings}), "recipe": r.to_dict()}


def decode_estimator(spec: dict) -> Estimator:
    """The unfitted probe that ``encode_estimator`` described; its parts must agree."""
    if not isinstance(spec, dict) or spec.get("kind") != "estimator" or spec.get("key") not in ALLOWED:
        raise ValueError("no description of a known probe")
    out = Estimator(Recipe.from_dict(spec["recipe"]))
    if encode_estimator(out) != {**spec}:
        raise ValueError("the description contradicts its recipe")
    return out


def make_estimator(recipe: Recipe | dict | str, *, version_policy: str = "warn") -> Estimator:
    """The unfitted probe of a recipe; other library versions than its own warn, raise (``error``) or pass (``ignore``)."""
    if version_policy not in ("warn", "error", "ignore"):
        raise ValueError(f"unknown version policy {version_policy!r}")
    if isinstance(recipe, str):
        recipe = json.loads(recipe)
    if isinstance(recipe, dict):
        recipe = Recipe.from_dict(recipe)
    other = {k: v for k, v in (recipe.created_with or {}).items() if v is not None and runtime_versions().get(k) != v}
    if other and version_policy != "ignore":
        text = f"made with other versions: {other}"
        if version_policy == "error":
            raise RuntimeError(text)
        warnings.warn(text, stacklevel=2)
    return Estimator(recipe)
