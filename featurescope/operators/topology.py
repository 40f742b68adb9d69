"""Supporting topology of boundary rows: mutual graphs, and persistence of dimensions 0 and 1.

Dimension 0 comes from the minimum spanning tree.  Dimension 1 is the persistent
cohomology of the Rips filtration, reduced column by column; only edges that are
in no triangle of shorter edges, and not in the spanning tree, need a column.  It
takes the first ``LOOP_ROWS`` rows of the drawn cloud.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import fragmentation, graph_components, mutual_graph
from .neighbors import default_k

LEAST_ROWS, MOST_ROWS, LEAST_CONCENTRATION = 30, 2000, 0.05
LOOP_ROWS = 250
MOST_LABELS, MOST_SKIPPED = 5, 50


def hard_subset(df: DataFrame, value: str) -> DataFrame:
    """Rows whose finite ``value`` reaches its upper quartile; none if that is 0."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    cut = ok.agg(F.expr(f"percentile({value}, 0.75)").alias("_cut"))
    return ok.crossJoin(F.broadcast(cut)).where((F.col("_cut") > 1e-12) & (F.col(value) >= F.col("_cut"))).drop("_cut")  # one row of threshold


def residual_size(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """row_id, residual: length of (target - prediction) / population deviation."""
    y = targets.select("row_id", F.posexplode("targets").alias("i", "y")).join(predictions.select("row_id", F.posexplode("prediction").alias("i", "p")), ["row_id", "i"])
    s = y.groupBy("i").agg(F.stddev_pop("y").alias("s"))  # one row per target
    r = y.join(F.broadcast(s), "i").withColumn("r", (F.col("y") - F.col("p")) / F.when(F.col("s") > 1e-12, F.col("s")).otherwise(1.0))
    return r.groupBy("row_id").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("residual"))


def mutual_summary(df: DataFrame) -> dict:
    """Components of the mutual neighbour graph with k of 3 to 10."""
    n = df.count()
    k = min(n - 1, min(10, default_k(n)))
    e = mutual_graph(df, k)
    f = fragmentation(graph_components(df, e)).first()
    return f.asDict() | {"edges": e.count(), "k": k}


def persistence0(X: np.ndarray) -> np.ndarray:
    """Finite lifetimes of connected components: the edges of a minimum spanning tree, ascending."""
    n = len(X)
    if n < 2:
        return np.empty(0)
    best, seen, out, at = np.full(n, np.inf), np.zeros(n, bool), [], 0
    for _ in range(n - 1):
        seen[at] = True
        best = np.minimum(best, np.sqrt(((X - X[at]) ** 2).sum(1)))
        best[seen] = np.inf
        at = int(best.argmin())
        out.append(best[at])
    return np.sort(np.array(out))


def scale_of(X: np.ndarray) -> float:
    """Mean positive range of the coordinates."""
    r = X.max(0) - X.min(0)
    return float(r[r > 0].mean()) if (r > 0).any() else 0.0


def persistence1(X: np.ndarray) -> np.ndarray:
    """(birth, death) of the loops of a Rips filtration that live for some time, by birth.

    Edges are ordered by length, then ends; a triangle by its last edge, then the vertex opposite to it.
    """
    n = len(X)
    if n < 4:
        return np.empty((0, 2))
    D = np.sqrt(np.maximum(((X[:, None] - X[None]) ** 2).sum(2), 0)) if n * n * X.shape[1] < 1 << 26 else np.sqrt(np.maximum((X**2).sum(1)[:, None] + (X**2).sum(1)[None] - 2 * X @ X.T, 0))
    I, J = np.triu_indices(n, 1)
    order = np.lexsort((J, I, D[I, J]))
    I, J = I[order], J[order]
    length = D[I, J]
    rank = np.full((n, n), -1, np.int64)
    rank[I, J] = rank[J, I] = np.arange(len(I))
    near = int(np.searchsorted(length, D.max(1).min(), "right"))  # beyond the enclosing radius nothing changes
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def first(e: int) -> int:
        """The triangle that e closes, if it is the longest edge of any; -1 if not."""
        both = np.maximum(rank[I[e]], rank[J[e]])
        both[[I[e], J[e]]] = len(I)
        k = np.flatnonzero(both < e)
        return int(e * n + k[0]) if len(k) else -1

    def column(e: int) -> np.ndarray:
        """All triangles on e, ascending."""
        i, j = int(I[e]), int(J[e])
        k = np.setdiff1d(np.arange(n), (i, j))
        a, b = rank[i, k], rank[j, k]
        last = np.maximum(np.maximum(a, b), e)
        t = last * n + np.where(last == e, k, np.where(last == a, j, i))
        return np.sort(t[last < near])

    columns = []
    for e in range(near):
        a, b = root(int(I[e])), root(int(J[e]))
        if a != b:
            parent[max(a, b)] = min(a, b)
        elif first(e) < 0:
            columns.append(e)
    taken: dict[int, np.ndarray] = {}
    out = []
    for e in reversed(columns):
        c = column(e)
        while len(c):
            t = int(c[0])
            if t in taken:
                c = np.setxor1d(c, taken[t], assume_unique=True)
            elif first(t // n) == t:  # paired with its own longest edge
                c = np.setxor1d(c, column(t // n), assume_unique=True)
            else:
                break
        if len(c):
            taken[int(c[0])] = c
            born, dead = length[e], length[int(c[0]) // n]
            if dead > born:
                out.append((born, dead))
    return np.array(sorted(out)).reshape(-1, 2)


def _entropy(life: np.ndarray) -> float:
    p = life[life > 0] / life.sum() if life.sum() > 0 else np.empty(0)
    return float(-(p * np.log(p)).sum())


def persistence_summary(X: np.ndarray) -> dict:
    """Counts, totals and entropies of both dimensions, and the strength: the longest loop's life over the cloud's scale, from 0.08 to 0.33."""
    life = persistence0(X)
    loops = persistence1(X[:LOOP_ROWS])
    loop = loops[:, 1] - loops[:, 0]
    scale = scale_of(X)
    longest = float(loop.max()) if len(loop) else 0.0
    relative = longest / max(scale, 1e-12) if scale > 0 else 0.0
    return {
        "h0_count": int((life > np.median(life)).sum()) if len(life) else 0,
        "h0_total": float(life.sum()),
        "h0_entropy": _entropy(life),
        "h1_count": int((loop > np.median(loop)).sum()) if len(loop) else 0,
        "h1_total": float(loop.sum()),
        "h1_longest": longest,
        "h1_relative": relative,
        "h1_rows": min(len(X), LOOP_ROWS),
        "persistence_entropy": _entropy(loop),
        "scale": scale,
        "strength": float(np.clip((relative - 0.08) / 0.25, 0.0, 1.0)),
    }


def choose_labels(positives: dict[int, int], at_boundary: dict[int, int]) -> tuple[list[int], list[dict]]:
    """(labels whose clouds are measured, the others with the reason): of those with ``LEAST_ROWS`` positives, the most frequent at the boundary."""
    able = [i for i, n in positives.items() if n >= LEAST_ROWS]
    chosen = sorted(able, key=lambda i: (-at_boundary.get(i, 0), -positives[i], i))[:MOST_LABELS]
    skipped = [{"label_idx": i, "positives": n, "reason": f"fewer than {LEAST_ROWS} positives" if n < LEAST_ROWS else f"beyond {MOST_LABELS} labels"} for i, n in sorted(positives.items()) if i not in chosen]
    return chosen, skipped[:MOST_SKIPPED]


def off(mode: str, budget: str) -> str | None:
    """Why the settings leave topology out; None if they do not."""
    if mode in ("off", "graph"):
        return f"topology is set to {mode}"
    return "the fast budget leaves topology out" if mode == "auto" and budget == "fast" else None


def gate(mode: str, budget: str, n_candidates: int, concentration: float | None) -> str | None:
    """Why topology does not run for single labels; None if it does."""
    if why := off(mode, budget):
        return why
    if n_candidates < LEAST_ROWS:
        return f"{n_candidates} boundary rows are fewer than {LEAST_ROWS}"
    if n_candidates > MOST_ROWS:
        return f"{n_candidates} boundary rows are more than {MOST_ROWS}"
    if concentration is None or concentration < LEAST_CONCENTRATION:
        return "distances are too concentrated"
    return None
