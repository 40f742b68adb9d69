import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurescope import config as C
from featurescope.operators import audit, bootstrap, boundary, cohort, geometry, graph, mlp, neighbors, probes, scoring, topology
from featurescope.operators.components import connected_components
from featurescope.plans import decision, recipes, report
from featurescope.plans.profiler import Profiler, diagnose
from featurescope.sources.tables import cohort as project
from featurescope.sources.tables import from_long, from_pandas


def frame(spark, X, y, name="label", kind="int", groups=None):
    rows = [(i, [float(v) for v in x], (y[i].tolist() if hasattr(y[i], "tolist") else y[i]), *([groups[i]] if groups is not None else [])) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, f"row_id long, features array<double>, {name} {kind}" + (", group_id int" if groups is not None else "")).repartition(3)


def blobs(n=260, d=6, seed=0, std=0.9):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    X = np.zeros((n, d))
    X[:, :2] = rng.normal(0, std, (n, 2)) + np.where(y[:, None] == 1, 2.5, -2.5)
    return X, y


def curve(n=360, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.uniform(-2.5, 2.5, (n, 2))
    return X, (X[:, 1] - 0.65 * X[:, 0] ** 2 + 0.08 * X[:, 0] + 0.08 * rng.normal(size=n) > 0).astype(int)


def spirals(n=360, d=8, seed=0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0.3, 4 * np.pi, n // 2))
    arm = np.c_[t * np.cos(t), t * np.sin(t)]
    X = np.zeros((n, d))
    X[:, :2] = np.concatenate([arm, -arm]) + rng.normal(0, 0.2, (n, 2))
    return X, np.repeat([0, 1], n // 2)


def permuted(n=260, seed=0):
    X, y = blobs(n, 10, seed)
    return X, np.random.default_rng(seed).permutation(y)


# ---------------------------------------------------------------- end to end


@pytest.mark.parametrize(
    ("make", "budget", "allowed"),
    [
        (blobs, "fast", {C.LINEAR}),
        (curve, "fast", {C.SMOOTH}),
        (spirals, "standard", {C.LOCAL, C.PARTITIONED}),
        (permuted, "fast", {C.BOTTLENECK, C.INCONCLUSIVE}),
    ],
)
def test_single_label_archetypes(spark, make, budget, allowed):
    X, y = make()
    r = diagnose(frame(spark, X, y), return_report=True, budget=budget, random_state=0)
    assert r.recommendation in allowed
    assert json.loads(r.to_json())["recommendation"] == r.recommendation
    assert set(r.metrics) >= {"audit", "geometry", "probes", "probe_evaluation", "paired_probe_comparisons", "baseline", "neighborhood", "boundary", "graph", "topology", "recommendation_evidence"}
    assert all(v is None or 0 <= v <= 1 for v in r.scores.values())
    assert r.recommendation_text.startswith(report.HEADLINES[r.recommendation])


def test_multilabel_and_groups(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(160, 5))
    Y = np.c_[X[:, 0] > 0, X[:, 1] + X[:, 2] > 0, X[:, 3] - X[:, 4] > 0, np.zeros(160)].astype(int)
    r = diagnose(frame(spark, X, Y, "labels", "array<int>", [int(i % 16) for i in range(160)]), target="labels", groups="group_id", return_report=True, budget="fast", random_state=0)
    assert r.recommendation == C.LINEAR
    assert r.metrics["audit"]["usable_labels"] == 3 and r.grouping["n_groups"] == 16
    assert [s["name"] for s in r.skipped_diagnostics if s["severity"]] == ["unusable_labels"] and r.confidence == "medium"


def test_regression(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(160, 5))
    y = np.c_[2 * X[:, 0] - 0.5 * X[:, 1] + 0.05 * rng.normal(size=160), X[:, 0] ** 2]
    one = diagnose(frame(spark, X, y[:, 0], "y", "double"), target="y", target_mode="regression", return_report=True, budget="fast", random_state=0)
    assert one.recommendation == C.LINEAR and one.scores["signal_r2_variance_weighted"] > 0.9
    two = diagnose(frame(spark, X, y, "y", "array<double>"), target="y", target_mode="regression", return_report=True, budget="fast", random_state=0)
    assert two.metrics["audit"]["n_targets"] == 2 and two.recommendation in (C.SMOOTH, C.INCONCLUSIVE, C.LINEAR)
    constant = diagnose(frame(spark, X, np.ones(160), "y", "double"), target="y", target_mode="regression", return_report=True, budget="fast")
    assert constant.recommendation == C.INSUFFICIENT and constant.confidence == "low"


def test_network_override_runs(spark):
    X, y = spirals(240, 2)
    r = diagnose(frame(spark, X, y), return_report=True, budget="fast", random_state=0, mlp_probes=True, mlp_trigger_skill_threshold=1.0)
    assert r.metrics["mlp_trigger"]["ran"] and "override" in r.metrics["mlp_override"]


def test_small_and_unsupported(spark):
    tiny = diagnose(frame(spark, [[0.0], [1.0], [2.0]], [0, 1, 1]), return_report=True, budget="fast")
    assert tiny.recommendation == C.INSUFFICIENT
    X, y = blobs(60, 2)
    label = [int(v) for v in y]
    label[0] = 7
    groups = [int(i % 6) for i in range(60)]
    r = diagnose(frame(spark, X, label, groups=groups), groups="group_id", return_report=True, budget="fast")
    assert any(s["name"] == "group_unsupported_classes" for s in r.skipped_diagnostics)
    flat = diagnose(frame(spark, np.ones((30, 1)), [i % 2 for i in range(30)]), return_report=True, budget="fast")
    assert flat.metrics["geometry"]["degenerate"] and flat.metrics["geometry"]["effective_rank"] == 0.0


@pytest.mark.parametrize(
    ("rows", "text"),
    [
        ([(0, [1.0], 0), (1, [math.nan], 1)], "null, NaN or infinite"),
        ([(0, [1.0], 0), (1, None, 1)], "null, NaN or infinite"),
        ([(0, [1.0], 0), (1, [1.0, 2.0], 1)], "one length"),
        ([(0, [1.0], 0), (0, [2.0], 1)], "unique"),
        ([(0, [1.0], 0), (1, [2.0], None)], "must not be null"),
        ([(0, [1.0], 0), (1, [2.0], 0)], "two classes"),
        ([], "no rows"),
    ],
)
def test_bad_input(spark, rows, text):
    with pytest.raises(ValueError, match=text):
        diagnose(spark.createDataFrame(rows, "row_id long, features array<double>, label int"))


def test_profiler_needs_fit_and_mode(spark):
    with pytest.raises(RuntimeError):
        Profiler().report()
    with pytest.raises(ValueError):
        Profiler(target_mode="regression").fit(frame(spark, [[1.0]], [1]))


@pytest.mark.parametrize("bad", [{"budget": "huge"}, {"topology": "x"}, {"max_dense_mb": 0}, {"max_samples": -1}, {"max_samples": True}, {"random_state": -1}, {"random_state": 2**32}, {"n_jobs": 0}, {"mlp_trigger_skill_threshold": 1.5}, {"target_mode": "x"}, {"mlp_device": "tpu"}, {"densify_policy": "no"}])
def test_config(bad):
    with pytest.raises(ValueError):
        C.Config(**bad)
    assert C.Config(max_samples=100).cap("probe_rows") == 100


# ---------------------------------------------------------------- cohort


def test_quotas():
    assert cohort.quotas({"a": 10, "b": 90}, 20) == {"a": 2, "b": 18}
    assert cohort.quotas({"a": 2, "b": 2, "c": 2}, 5) is None
    assert sum(cohort.quotas({"a": 3, "b": 500, "c": 497}, 100).values()) == 100
    assert cohort.quotas({"a": 1, "b": 5}, 9) == {"a": 1, "b": 5}


def test_whole_groups_fill_the_cap():
    assert cohort.choose_groups({"x": 6, "y": 5, "z": 4}, {}, 0, 10) == {"x", "z"}
    chosen = cohort.choose_groups({g: 3 for g in range(8)}, {g: {"rare"} if g < 2 else {"common"} for g in range(8)}, 2, 15)
    assert {0, 1} <= chosen and len(chosen) == 5
    assert cohort.choose_groups({"x": 6, "y": 6}, {"x": {1}, "y": {2}}, 1, 10) is None


def test_ranks_equal_one_window(spark):
    df = spark.range(3000).selectExpr("id as row_id", "cast(id % 3 = 0 as int) as label")
    import hashlib

    got = {r.row_id: r["rank"] for r in cohort.ranked(df, ["label"], 5).collect()}
    for label in (0, 1):
        ids = [i for i in range(3000) if (i % 3 == 0) == label]
        assert [got[i] for i in sorted(ids, key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())] == list(range(1, len(ids) + 1))


def test_group_folds_are_disjoint(spark):
    df = spark.range(200).selectExpr("id as row_id", "cast(id % 2 as int) as label", "cast(id / 10 as int) as group_id")
    f = cohort.group_folds(df, 5, 1)
    rows = f.collect()
    assert len(rows) == 200 and len({r.fold for r in rows}) == 5
    by = {}
    for r in rows:
        assert by.setdefault(r.group_id, r.fold) == r.fold
    lone = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "row_id long, label int, group_id int")
    assert cohort.group_folds(lone, 5) is None
    assert cohort.plan_id(f, "m") == cohort.plan_id(f.repartition(7), "m") != cohort.plan_id(f, "other")
    s = cohort.size_folds(df, 3).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in s) == [60, 70, 70]


def test_multilabel_sample_keeps_rare_sides(spark):
    rows = [(i, [int(i < 100), int(i < 3), 0]) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, labels array<int>")
    got = cohort.multilabel_sample(df, 20).collect()
    assert len(got) == 20 and sum(r.labels[1] for r in got) >= 2 and sum(1 - r.labels[0] for r in got) >= 2
    assert cohort.is_multilabel(df) and not cohort.is_multilabel(df.withColumn("labels", F.array(F.lit(2), F.lit(0))))


def test_fold_counts():
    assert [cohort.fold_count(n, 5) for n in (1, 2, 3, 4, 5, 50)] == [0, 2, 3, 3, 5, 5]
    assert [cohort.regression_fold_count(n, 5) for n in (3, 4, 9, 10)] == [0, 2, 2, 5]


# ---------------------------------------------------------------- operators


def test_neighbors_are_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.integers(0, 4, (300, 3)).astype(float)  # many ties
    df = frame(spark, X, [int(i % 7) for i in range(300)])
    for other, block in ((None, 64), (F.col("label"), 100)):
        got = {}
        for r in neighbors.neighbors(df, 5, other=other, block=block).collect():
            got.setdefault(r.row_id, []).append((r["rank"], r.neighbor_id))
        for i in range(300):
            d = np.sqrt(((X - X[i]) ** 2).sum(1))
            ok = [j for j in range(300) if (j % 7 != i % 7 if other is not None else j != i)]
            assert [j for _, j in sorted(got[i])] == sorted(ok, key=lambda j: (d[j], j))[:5]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_logistic_and_ridge_are_optimal():
    rng = np.random.default_rng(5)
    X = rng.normal(size=(200, 4))
    y = (X[:, 0] + rng.normal(size=200) > 0).astype(int)
    W = probes.fit_logistic(X, y, 2)
    w, b = W[:-1, 1], W[-1, 1]
    weight = probes.balanced(y, 2)
    r = weight * (1 / (1 + np.exp(-(X @ w + b))) - y)
    assert np.abs(X.T @ r + w).max() < 1e-3 and abs(r.sum()) < 1e-3
    y3 = rng.integers(0, 3, 200)
    assert probes.fit_logistic(X, y3, 3).shape == (5, 3)
    Y = rng.normal(size=(200, 2))
    A, B = X - X.mean(0), Y - Y.mean(0)
    assert np.allclose(probes.fit_ridge(X, Y)[:-1], np.linalg.solve(A.T @ A + np.eye(4), A.T @ B))
    assert np.allclose(probes.fit_ridge(X[:3], Y[:3])[:-1], np.linalg.solve((X[:3] - X[:3].mean(0)).T @ (X[:3] - X[:3].mean(0)) + np.eye(4), (X[:3] - X[:3].mean(0)).T @ (Y[:3] - Y[:3].mean(0))))


def test_expansions():
    X = np.random.default_rng(6).normal(size=(50, 5))
    assert probes.quadratic(X).shape[1] == probes.quadratic_width(5) == 20
    S = probes.count_sketch(X, 2048, 0)
    assert np.corrcoef((S @ S.T).ravel(), ((1 + X @ X.T) ** 2).ravel())[0, 1] > 0.95
    R = np.concatenate([probes.random_features(X, s) for s in range(40)], 1) / np.sqrt(40)
    d2 = ((X[:, None] - X[None]) ** 2).sum(2)
    assert np.abs(R @ R.T - np.exp(-d2 / 5)).max() < 0.15
    assert probes.quadratic_variant(1000, 20, 1) == ("low_rank", 128) and probes.quadratic_variant(1000, 20, 512)[0] == "full"
    assert probes.quadratic_variant(10**7, 20, 1) == ("skipped", None)


def test_scores_are_brute_force(spark):
    rng = np.random.default_rng(7)
    Y, Q = rng.integers(0, 2, (80, 3)).astype(float), rng.integers(0, 2, (80, 3)).astype(float)
    Y[:5], Q[:5] = 0, 0
    p = spark.createDataFrame([(i, "m", y.tolist(), q.tolist()) for i, (y, q) in enumerate(zip(Y, Q, strict=True))], "row_id long, probe string, y array<double>, prediction array<double>")
    r = scoring.multilabel_scores(p, "probe").first()
    tp, fp, fn = (Y * Q).sum(0), ((1 - Y) * Q).sum(0), (Y * (1 - Q)).sum(0)
    union, inter = np.maximum(Y, Q).sum(1), (Y * Q).sum(1)
    assert r.micro_f1 == pytest.approx(2 * tp.sum() / (2 * tp + fp + fn).sum())
    assert r.macro_f1 == pytest.approx(np.mean(2 * tp / (2 * tp + fp + fn)))
    assert r.sample_jaccard == pytest.approx(np.mean(np.where(union == 0, 1, inter / np.maximum(union, 1))))
    assert r.hamming_loss == pytest.approx(np.mean(Y != Q)) and r.subset_accuracy == pytest.approx(np.mean((Y == Q).all(1)))
    T, P = rng.normal(size=(60, 2)) * [1, 10], rng.normal(size=(60, 2))
    p = spark.createDataFrame([(i, "r", y.tolist() + [1.0], q.tolist() + [1.0]) for i, (y, q) in enumerate(zip(T, P, strict=True))], "row_id long, probe string, y array<double>, prediction array<double>")
    r = scoring.regression_scores(p, "probe").first()
    sse, sst = ((T - P) ** 2).sum(0), ((T - T.mean(0)) ** 2).sum(0)
    assert r.r2_variance_weighted == pytest.approx(1 - sse.sum() / sst.sum()) and r.r2_uniform_average == pytest.approx(np.mean(1 - sse / sst))


def test_bootstrap(spark):
    df = spark.range(120).selectExpr("id as row_id", "cast(id % 3 as int) as label", "cast(id / 6 as int) as group_id")
    w = bootstrap.weights(df, 30, 1, strata="label").join(df, "row_id").groupBy("b", "label").agg(F.sum("w").alias("n")).collect()
    assert len(w) == 90 and all(r.n == 40 for r in w)
    g = bootstrap.weights(df, 10, 1, grouped=True).join(df, "row_id").groupBy("b", "group_id").agg(F.count_distinct("w").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.k == 1 and r.n == 6 for r in g)
    pair = {"first": "a", "second": "b", "metric": "m", "point_delta": 0.1, "mean_delta": 0.1, "paired_standard_error": 0.02, "lower_95": 0.05, "upper_95": 0.2}
    assert bootstrap.lookup([pair], "b", "a", "m") == pair | {"first": "b", "second": "a", "point_delta": -0.1, "mean_delta": -0.1, "lower_95": -0.2, "upper_95": -0.05}
    assert bootstrap.lookup([pair], "a", "c", "m") is None


def test_multilabel_triggers(spark):
    rows = [(0, 1.0, 0.0, 0.0, 0.0), (1, 0.1, 0.6, 0.9, 1.2), (2, 1.0, 0.0, 0.0, 0.0), (3, 0.9, 0.05, 0.4, 0.0)]
    b = boundary.multilabel_boundary(spark.createDataFrame(rows, "row_id long, jaccard double, hamming double, entropy double, cardinality_std double")).collect()
    got = {r.row_id: r for r in b}
    assert [i for i in got if got[i].candidate] == [1] or {i for i in got if got[i].candidate} == {1, 3}
    assert got[1].strong and got[1].triggers[0] == "low_neighbor_jaccard" and not got[0].candidate


def test_geometry_and_topology(spark):
    X = np.random.default_rng(8).normal(size=(120, 4)) * [5, 1, 1, 1]
    df = frame(spark, X, [0] * 120)
    own = np.sort(np.linalg.eigvalsh(np.cov(X.T)))[::-1]
    assert np.allclose(geometry.spectrum(df), own / own.sum())
    assert geometry.spectrum_summary(np.array([0.5, 0.5]))["effective_rank"] == pytest.approx(2)
    life = topology.persistence0(np.array([[0.0], [1.0], [3.0], [10.0]]))
    assert life.tolist() == [1, 2, 7]
    assert topology.gate("auto", "fast", 100, 1.0) and topology.gate("auto", "standard", 100, 1.0) is None and topology.gate("auto", "standard", 10, 1.0)
    two = np.concatenate([np.linspace(0, 1, 12)[:, None], np.linspace(10, 11, 12)[:, None]])
    d = frame(spark, two, [0] * 24)
    e = graph.knn_graph(d, k=3)
    f = graph.fragmentation(graph.graph_components(d, e)).first()
    assert sorted(graph.graph_components(d, e).collect()) == sorted(graph.capped_components(d, e).collect())
    assert f.component_count == 2 and f.largest_fraction == 0.5 and f.size_entropy == pytest.approx(1)


def test_decision_tables():
    def run(scores, pairs=None, **m):
        p = {k: {"balanced_accuracy": v, "class_counts": {"0": 500, "1": 500}, "per_class_recall": [v, v]} for k, v in scores.items()}
        return decision.decide("singlelabel", p, pairs, {"audit": {"n_classes": 2, "proportions": {"0": 0.5, "1": 0.5}}, "geometry": {"concentration": 1.0}, **m}, n=1000)

    full = {"dummy": 0.5, "linear": 0.9, "smooth_poly": 0.905, "knn": 0.9}
    assert run(full).recommendation == C.LINEAR and run(full).confidence == "high"
    assert run(full | {"smooth_poly": 0.99}).recommendation == C.SMOOTH
    assert run(full | {"linear": 0.6, "smooth_poly": 0.7, "knn": 0.95}).recommendation == C.LOCAL
    split = run(full | {"linear": 0.6, "smooth_poly": 0.7, "knn": 0.95}, graph={"component_count": 5, "largest_fraction": 0.3})
    assert split.recommendation == C.PARTITIONED
    assert run({k: 0.5 for k in full}, neighborhood={"cross_class_neighbor_fraction": 0.51}).recommendation == C.BOTTLENECK
    assert run({k: 0.5 for k in full}, neighborhood={"cross_class_neighbor_fraction": 0.2}).recommendation == C.INCONCLUSIVE
    assert run({"linear": 0.9}).recommendation == C.INSUFFICIENT
    assert run(full, mlp_override={"override": True}).recommendation == C.MLP
    pair = {"first": "knn", "second": "smooth_poly", "metric": "balanced_accuracy", "point_delta": 0.005, "mean_delta": 0.005, "paired_standard_error": 0.001, "lower_95": 0.001, "upper_95": 0.01}
    e = decision.Evidence("singlelabel", {k: {"balanced_accuracy": v} for k, v in full.items()}, [pair], 100)
    assert not e.clear_metrics("local_kernel", "smooth_nonlinear")  # below the least improvement
    m = {k: {"micro_f1": a, "macro_f1": b, "sample_jaccard": c} for k, (a, b, c) in {"dummy": (0.1, 0.1, 0.1), "linear": (0.5, 0.5, 0.5), "smooth_poly": (0.8, 0.8, 0.5), "knn": (0.8, 0.8, 0.5)}.items()}
    assert decision.decide("multilabel", m, None, {"audit": {"usable_labels": 3}}, n=500).recommendation == C.SMOOTH
    r = {k: {"r2_variance_weighted": v, "r2_uniform_average": v} for k, v in {"dummy": -0.01, "linear": 0.2, "smooth_poly": 0.3, "knn": 0.9}.items()}
    assert decision.decide("regression", r, None, {"audit": {"usable_targets": 1}, "neighborhood": {"discontinuity_fraction": 0.5}}, n=500).recommendation == C.PARTITIONED


def test_recipes():
    s = probes.ProbeSettings("singlelabel", 5, 1)
    r = recipes.probe_recipe("linear", "singlelabel", 2, s)
    X, y = blobs(80, 2)
    est = recipes.make_estimator(r.to_json()).fit(X, y)
    assert (est.predict(X)[:, 0] == y).mean() > 0.95
    bad = r.to_dict() | {"probe": "knn"}
    for broken in (bad, {k: v for k, v in r.to_dict().items() if k != "schema"}, r.to_dict() | {"version": 9}):
        with pytest.raises(ValueError):
            recipes.make_estimator(broken)
    other = recipes.Recipe("knn", "local_kernel", "singlelabel", {"n_features": 2}, {"k": 5, "seed": 1, "max_dense_mb": 512}, {"numpy": "0.1"})
    with pytest.raises(RuntimeError):
        recipes.make_estimator(other, version_policy="error")
    with pytest.warns(UserWarning):
        recipes.make_estimator(other)
    with pytest.raises(ValueError):
        recipes.make_estimator(r).fit(X[:, :1], y)


def test_network_shapes():
    for name, h in mlp.shapes(10, 3, 10**6):
        assert mlp.parameters(10, 3, h) <= 10**6 and name.startswith("mlp_")
    assert mlp.shapes(10, 3, 100) == []
    X, y = curve(600)
    net = mlp.Network((64, 64), "singlelabel", epochs=200, patience=50, seed=0).fit(X, y[:, None].astype(float))
    assert (net.predict(X)[:, 0] == y).mean() > 0.9
    assert mlp.skill(0.9, 0.5) == pytest.approx(0.8) and mlp.skill(None, 0.5) is None


def test_sources(spark):
    import pandas as pd

    p = from_pandas(spark, pd.DataFrame({"a": [1, 2], "b": [3, 4]}), pd.Series(["x", "y"]))
    assert p.columns == ["row_id", "features", "label"] and p.first().features == [1.0, 3.0]
    wide = spark.createDataFrame([(1, 2, 3, 0)], "id long, a int, b int, t int")
    assert project(wide, row_id="id", features=["a", "b"], label="t").first().features == [2.0, 3.0]
    long = spark.createDataFrame([(1, 0, 5.0), (1, 2, 6.0)], "row_id long, feature_idx int, value double")
    assert from_long(long, 4).first().features == [5.0, 0.0, 6.0, 0.0]


def test_report_is_json_safe():
    out = report.plain({"a": np.float64("nan"), "b": np.arange(2), "predictions": [1], "c": {1: float("inf")}}, terse=True)
    assert out == {"a": None, "b": [0, 1], "c": {"1": None}}


def test_target_rank():
    assert audit.target_rank({(0, 1): 0.0}, 2) == (pytest.approx(2.0), 0.0)
    assert audit.target_rank({(0, 1): 1.0}, 2)[0] == pytest.approx(1.0)


def test_registered_queries_run_whole(spark, monkeypatch):
    """The queries without SQL hand their operators all features, and the operators' own limits."""
    import featurescope.plans.profiler as profiler
    from featurescope.operators import cohort, probes, topology
    from featurescope.plans import registry

    d = "/root/testdata/sf0.001"
    seen = {}

    def diagnose(df, **settings):
        seen["diagnose"] = df, settings
        raise InterruptedError

    def out_of_fold(df, s, names):
        seen["probe"] = df
        raise InterruptedError

    monkeypatch.setattr(profiler, "diagnose", diagnose)
    monkeypatch.setattr(probes, "out_of_fold", out_of_fold)
    for name in ("diagnose_report", "probe_quadratic"):
        with pytest.raises(InterruptedError):
            registry.QUERIES[name](spark, d)
    df, settings = seen["diagnose"]
    width = lambda x: {len(r.features) for r in x.select("features").collect()}
    assert width(df) == width(seen["probe"]) == {64}
    assert not {"budget", "topology", "max_samples"} & set(settings)

    draw, caps = cohort.uniform_sample, []
    monkeypatch.setattr(cohort, "uniform_sample", lambda e, n, seed: caps.append(n) or draw(e, n, seed))
    assert registry.QUERIES["topology_h0"](spark, d).first().h0_count > 0
    assert caps == [topology.MOST_ROWS]
