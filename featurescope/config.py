"""Settings of a diagnosis and the limits of each budget."""

from __future__ import annotations

from dataclasses import asdict, dataclass

# Recommendation labels.
LINEAR = "linear_likely_sufficient"
SMOOTH = "smooth_nonlinear_recommended"
LOCAL = "kernel_or_local_recommended"
PARTITIONED = "high_capacity_or_partitioning_recommended"
MLP = "feedforward_mlp_recommended"
BOTTLENECK = "feature_or_target_bottleneck_likely"
INSUFFICIENT = "insufficient_data_or_unreliable_geometry"
INCONCLUSIVE = "inconclusive"

# Row caps, folds and resamples of each budget.
BUDGETS = {
    "fast": {"probe_rows": 5000, "neighbor_rows": 5000, "boundary_rows": 2000, "folds": 3, "repeats": 0, "resamples": 200, "kernel": False, "persistent": False},
    "standard": {"probe_rows": 20000, "neighbor_rows": 10000, "boundary_rows": 3000, "folds": 5, "repeats": 3, "resamples": 500, "kernel": True, "persistent": "auto"},
    "extended": {"probe_rows": 50000, "neighbor_rows": 20000, "boundary_rows": 5000, "folds": 5, "repeats": 10, "resamples": 1000, "kernel": True, "persistent": "auto"},
}
# Limits of the optional network probes.
MLP_BUDGETS = {
    "fast": {"rows": 2000, "folds": 3, "resamples": 200, "epochs": 64, "patience": 8, "parameters": 250_000},
    "standard": {"rows": 5000, "folds": 3, "resamples": 500, "epochs": 128, "patience": 16, "parameters": 1_000_000},
    "extended": {"rows": 10000, "folds": 5, "resamples": 1000, "epochs": 256, "patience": 24, "parameters": 5_000_000},
}

_CHOICES = {
    "budget": tuple(BUDGETS),
    "topology": ("off", "auto", "graph", "persistent"),
    "densify_policy": ("fail", "warn_and_sample", "skip"),
    "target_mode": ("auto", "singlelabel", "multilabel", "regression"),
    "multilabel_stratification": ("auto", "iterative", "heuristic"),
    "mlp_device": ("cpu", "auto", "cuda", "mps"),
}


def _whole(x, least: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


@dataclass(frozen=True)
class Config:
    """All settings; wrong ones raise ValueError."""

    budget: str = "standard"
    topology: str = "auto"
    densify_policy: str = "warn_and_sample"
    max_dense_mb: int = 512
    max_samples: int | None = None
    min_dense_samples: int = 200
    random_state: int | None = None
    warn_on_densify: bool = True
    n_jobs: int | None = None
    target_mode: str = "auto"
    multilabel_stratification: str = "auto"
    mlp_probes: bool = False
    mlp_device: str = "cpu"
    mlp_trigger_skill_threshold: float = 0.75
    mlp_min_improvement: float = 0.02
    mlp_max_parameters: int | None = None

    def __post_init__(self):
        for name, allowed in _CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {getattr(self, name)!r}")
        for name in ("max_dense_mb", "min_dense_samples", "max_samples", "mlp_max_parameters"):
            x = getattr(self, name)
            if not _whole(x, 1) and not (x is None and name in ("max_samples", "mlp_max_parameters")):
                raise ValueError(f"{name} must be a positive integer")
        if self.random_state is not None and not (_whole(self.random_state, 0) and self.random_state < 1 << 32):
            raise ValueError("random_state must be an integer from 0 to 2**32 - 1, or None")
        if self.n_jobs is not None and (not isinstance(self.n_jobs, int) or isinstance(self.n_jobs, bool) or self.n_jobs == 0):
            raise ValueError("n_jobs must be an integer other than 0, or None")
        for name in ("mlp_trigger_skill_threshold", "mlp_min_improvement"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")

    @property
    def seed(self) -> int:
        return self.random_state or 0

    @property
    def limits(self) -> dict:
        return BUDGETS[self.budget]

    def cap(self, what: str) -> int:
        rows = self.limits[what]
        return rows if self.max_samples is None else min(rows, self.max_samples)

    def to_dict(self) -> dict:
        return asdict(self)
