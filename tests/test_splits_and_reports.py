import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurescope.operators import cohort, mlp, scoring, topology
from featurescope.plans.profiler import Profiler, diagnose


def labelled(spark, Y, groups=None, d=3, seed=0):
    X = np.random.default_rng(seed).normal(size=(len(Y), d))
    rows = [(i, X[i].tolist(), [int(v) for v in Y[i]], *([int(groups[i])] if groups is not None else [])) for i in range(len(Y))]
    return spark.createDataFrame(rows, "row_id long, features array<double>, labels array<int>" + (", group_id long" if groups is not None else "")).repartition(3)


# ---------------------------------------------------------------- multilabel splits


@pytest.mark.parametrize("width", [1, 2, 8, 20])
def test_multilabel_folds_are_even_and_hold_both_sides(spark, width):
    Y = (np.random.default_rng(width).random((300, width)) < 0.5).astype(int)
    got = cohort.multilabel_folds(labelled(spark, Y), 5, 1).select("row_id", "fold").toPandas()
    assert len(got) == 300 and got.groupby("fold").size().between(54, 66).all() and got.fold.nunique() == 5
    for f in range(5):
        held = got[got.fold == f].row_id.to_numpy()
        rest = np.setdiff1d(np.arange(300), held)
        for side in (Y[held], Y[rest]):
            assert (side.sum(0) > 0).all() and (side.sum(0) < len(side)).all()


def test_rare_labels_are_dealt_first(spark):
    Y = np.zeros((200, 4), int)
    for j, n in enumerate((100, 80, 30, 10)):
        Y[:n, j] = 1
    got = cohort.multilabel_folds(labelled(spark, Y), 5, 3).select("row_id", "fold").toPandas().sort_values("row_id")
    for j in range(4):
        n = [Y[got.fold.to_numpy() == f, j].sum() for f in range(5)]
        assert max(n) - min(n) <= 2 and min(n) >= 1


def test_impossible_multilabel_splits_are_refused(spark):
    Y = np.zeros((40, 2), int)
    Y[:20, 0] = 1
    Y[0, 1] = 1  # one positive cannot be on both sides
    assert cohort.multilabel_folds(labelled(spark, Y), 5) is None
    Y[:, 1] = 0
    assert cohort.multilabel_folds(labelled(spark, Y), 5) is None


def test_many_random_labels_are_no_signal(spark):
    Y = (np.random.default_rng(1).random((200, 20)) < 0.5).astype(int)
    r = diagnose(labelled(spark, Y), target="labels", return_report=True, budget="fast", random_state=0)
    assert r.recommendation not in ("linear_likely_sufficient", "smooth_nonlinear_recommended")
    assert r.metrics["probe_evaluation"]["train_sizes"]["min_train"] >= 130


def test_grouped_multilabel_cap_keeps_label_sides(spark):
    rng = np.random.default_rng(2)
    groups = np.repeat(np.arange(60), 5)
    Y = np.stack([(groups % 2), (groups < 2).astype(int), rng.integers(0, 2, 300)], 1)
    got = cohort.group_sample(labelled(spark, Y, groups), 60, 1, state=cohort.label_side())
    rows = got.collect()
    assert len(rows) == 60 and {0, 1} <= {r.group_id for r in rows}
    for j, v in itertools.product(range(3), (0, 1)):
        assert len({r.group_id for r in rows if r.labels[j] == v}) >= 2


# ---------------------------------------------------------------- groups


def test_holdouts_of_groups_differ(spark):
    groups = np.repeat(np.arange(24), np.arange(1, 25))
    df = labelled(spark, np.ones((len(groups), 1)), groups)
    held = []
    for seed in range(5):
        got = cohort.group_holdout(df, seed).select("group_id", "held").distinct().collect()
        assert len(got) == 24 and sum(r.held for r in got) == 6
        held.append(frozenset(r.group_id for r in got if r.held))
    assert len(set(held)) == 5
    assert cohort.group_holdout(df.where("group_id = 3"), 0) is None


def test_grouped_stability_varies(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(240, 3))
    y = (X[:, 0] + rng.normal(size=240) > 0).astype(int)
    rows = [(i, X[i].tolist(), int(y[i]), int(i % 30) ** 2 % 17) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label int, group_id int")
    r = diagnose(df, groups="group_id", return_report=True, budget="standard", topology="off", random_state=0)
    linear = r.metrics["probes"]["linear"]
    assert linear["stability_repeats"] == 3 and linear["stability_balanced_accuracy_std"] > 0
    assert 0.5 < linear["stability_balanced_accuracy_mean"] < 1


def test_folds_of_very_many_groups(spark, monkeypatch):
    monkeypatch.setattr(cohort, "DRIVER_GROUPS", 10)
    df = spark.range(3000).selectExpr("id as row_id", "cast(id % 2 as int) as label", "cast(id / 7 as long) as group_id")
    for out in (cohort.group_folds(df, 5, 1), cohort.size_folds(df, 5, 1)):
        rows = out.collect()
        by = {}
        assert len(rows) == 3000 and all(by.setdefault(r.group_id, r.fold) == r.fold for r in rows)
        n = np.bincount([r.fold for r in rows])
        assert len(n) == 5 and n.max() < 1.2 * n.min()
    got = cohort.group_sample(df, 100, 1)
    sizes = got.groupBy("group_id").count().collect()
    assert 90 <= sum(r["count"] for r in sizes) <= 100 and all(r["count"] == 7 or r.group_id == 3000 // 7 for r in sizes)


def test_choose_groups_fills_as_much_as_can_be():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = {g: int(n) for g, n in enumerate(rng.integers(1, 20, 9))}
        cap = int(rng.integers(5, 60))
        best = max(sum(c) for k in range(10) for c in itertools.combinations(sizes.values(), k) if sum(c) <= cap)
        assert sum(sizes[g] for g in cohort.choose_groups(sizes, {}, 0, cap) or ()) == best


def test_group_folds_hold_every_class(spark):
    df = spark.range(120).selectExpr("id as row_id", "cast(id % 12 = 0 as int) as label", "cast(id / 4 as long) as group_id")
    rows = cohort.group_folds(df, 5, 0).collect()
    k = {r.fold for r in rows}
    assert all({r.label for r in rows if r.fold == f} == {0, 1} for f in k) and len(k) >= 2


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_groups_are_refused(spark, bad):
    rows = [(i, [float(i)], i % 2, float(i % 3)) for i in range(12)] + [(99, [1.0], 1, bad)]
    with pytest.raises(ValueError, match="group_id"):
        diagnose(spark.createDataFrame(rows, "row_id long, features array<double>, label int, g double"), groups="g", budget="fast")


# ---------------------------------------------------------------- reports


def test_per_label_and_per_target_numbers(spark):
    rng = np.random.default_rng(6)
    Y, Q = (rng.random((200, 6)) < [0.5, 0.4, 0.3, 0.2, 0.04, 0.02]).astype(float), (rng.random((200, 6)) < 0.3).astype(float)
    p = spark.createDataFrame([(i, "m", y.tolist(), q.tolist()) for i, (y, q) in enumerate(zip(Y, Q, strict=True))], "row_id long, probe string, y array<double>, prediction array<double>")
    got = scoring.label_summary(scoring.label_scores(scoring.label_counts(p, "probe")), "probe").first()
    f1 = 2 * (Y * Q).sum(0) / np.maximum(Y.sum(0) + Q.sum(0), 1)
    rare = Y.sum(0) <= 10
    assert got.per_label_f1_mean == pytest.approx(f1.mean()) and got.per_label_f1_median == pytest.approx(np.median(f1))
    assert got.per_label_f1_p10 == pytest.approx(np.percentile(f1, 10)) and got.rare_label_f1_mean == pytest.approx(f1[rare].mean())
    T = rng.normal(size=(50, 2)) * [1, 9]
    P = T + rng.normal(size=(50, 2))
    T = np.c_[T, np.ones(50)]
    p = spark.createDataFrame([(i, t.tolist(), [*q.tolist(), 2.0]) for i, (t, q) in enumerate(zip(T, P, strict=True))], "row_id long, y array<double>, prediction array<double>")
    got = sorted(scoring.target_scores(p).collect())
    for j in range(2):
        assert got[j].r2 == pytest.approx(1 - ((T[:, j] - P[:, j]) ** 2).sum() / ((T[:, j] - T[:, j].mean()) ** 2).sum())
    assert got[2].r2 is None and got[2].nrmse is None and got[2].variance == 0


def test_names_in_reports(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(120, 4))
    Y = (X[:, :3] > 0).astype(int)
    rows = [(i, X[i].tolist(), *Y[i].tolist(), 0, *X[i, :2].tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, red int, green int, blue int, void int, u double, v double")
    r = diagnose(df, target=["red", "green", "blue", "void"], return_report=True, budget="fast", random_state=0)
    assert [x["label"] for x in r.class_summary["labels"]] == ["red", "green", "blue", "void"]
    assert [x["label"] for x in r.metrics["probes"]["linear"]["per_label_metrics"]] == ["red", "green", "blue"]
    assert set(r.metrics["probes"]["linear"]["per_label_summary"]["best_labels"]) == {"red", "green", "blue"}
    assert "per_label_metrics" not in r.to_dict(terse=True)["metrics"]["probes"]["linear"]
    t = diagnose(df, target=["u", "v"], target_mode="regression", return_report=True, budget="fast", random_state=0)
    assert [x["target"] for x in t.metrics["probes"]["linear"]["per_target_metrics"]] == ["u", "v"] and t.metrics["probes"]["linear"]["per_target_metrics"][0]["r2"] > 0.99
    with pytest.raises(ValueError, match="names"):
        diagnose(df, target=["u", "v"], names=["x"], target_mode="regression", budget="fast")


def test_vectors_tables_and_policies(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(11)
    X = rng.normal(size=(120, 6)) * (rng.random((120, 6)) < 0.4)
    y = (X.sum(1) > 0).astype(int)
    sparse = spark.createDataFrame([(i, Vectors.sparse(6, {j: float(v) for j, v in enumerate(x) if v}), int(k)) for i, (x, k) in enumerate(zip(X, y, strict=True))], ["row_id", "features", "label"])
    dense = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(X, y, strict=True))], "row_id long, features array<double>, label int")
    a, b = (diagnose(d, return_report=True, budget="fast", random_state=0) for d in (sparse, dense))
    assert a.scores == b.scores and a.metrics["audit"]["sparsity"] == pytest.approx((X == 0).mean())
    policy = a.metrics["probes"]["smooth_poly"]["training_policy"]
    assert policy["variant"] == "full" and policy["width"] == policy["full_expansion_features"] == 27 and policy["evaluation_deterministic"]
    assert a.metrics["probes"]["knn"]["training_policy"]["neighbors_used"] == 10
    p = Profiler(budget="fast", random_state=0).fit(dense)
    assert p.tables["folds"].count() == 120 and p.tables["predictions"].groupBy("probe").count().where("count = 120").count() == 4
    assert p.tables["neighbors"].count() == p.tables["boundary"].count() == 120
    frontier = p.report().metrics["recommendation_evidence"]["plausible_family_set"]
    assert set(frontier["assessments"]) == {"linear", "smooth_nonlinear", "local_kernel"} and frontier["decision_method"] in (None, "paired")


def test_estimators_and_their_descriptions():
    from featurescope.operators.probes import ProbeSettings
    from featurescope.plans import recipes

    e = recipes.make_estimator(recipes.probe_recipe("knn", "singlelabel", 2, ProbeSettings("singlelabel", 3, 1)))
    spec = recipes.encode_estimator(e)
    assert spec["key"] == "knn" and spec["params"]["k"] == 3 and recipes.decode_estimator(spec).recipe == e.recipe
    with pytest.raises(TypeError):
        recipes.encode_estimator("knn")
    for broken in ({}, spec | {"key": "tree"}, spec | {"params": {}}):
        with pytest.raises(ValueError):
            recipes.decode_estimator(broken)


def test_settings_that_cannot_be_met(spark):
    Y = (np.random.default_rng(1).random((40, 2)) < 0.5).astype(int)
    with pytest.raises(ValueError, match="iterative"):
        Profiler(multilabel_stratification="iterative").fit(labelled(spark, Y))


# ---------------------------------------------------------------- networks


@pytest.mark.parametrize("mode", ["singlelabel", "multilabel", "regression"])
def test_validation_rows_keep_classes_and_groups(mode):
    rng = np.random.default_rng(8)
    Y = {"singlelabel": (np.arange(60) % 15 == 0).astype(float)[:, None], "multilabel": (rng.random((60, 3)) < 0.3).astype(float), "regression": rng.normal(size=(60, 1))}[mode]
    groups = np.arange(60) // 3
    for g in (None, groups):
        for seed in range(5):
            held = mlp.validation_rows(Y, mode, np.random.default_rng(seed), g)
            assert 6 <= len(held) <= 20
            rest = np.setdiff1d(np.arange(60), held)
            if g is not None:
                assert not set(g[held]) & set(g[rest])
            if mode != "regression":
                assert all(set(Y[s][:, j]) == set(Y[:, j]) for s in (held, rest) for j in range(Y.shape[1]))
    assert len(mlp.validation_rows(Y[:7], mode, rng)) == 0
    assert len(mlp.validation_rows(np.r_[np.ones((1, 1)), np.zeros((30, 1))], "multilabel", rng)) == 0


def test_a_network_that_fails_is_left_out(spark, monkeypatch):
    from featurescope.operators import probes

    monkeypatch.setattr(mlp, "shapes", lambda d, o, most: [("mlp_good", (8,)), ("mlp_bad", (0,))])  # no layer can be drawn for a width of 0
    X = np.random.default_rng(9).normal(size=(90, 2))
    rows = [(i, X[i].tolist(), [float(X[i, 0] > 0)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, y array<double>, fold int")
    got = mlp.override(df, probes.ProbeSettings("singlelabel", 5, 0), {"epochs": 5, "patience": 3, "resamples": 60}, parameters=10**6, least=0.02)
    assert got["failed"] == ["mlp_bad"] and got["best"] == "mlp_good" and got["missing_comparators"] == []


# ---------------------------------------------------------------- topology


def brute_loops(X):
    """Persistence of dimension 1 by reducing the boundaries of all triangles."""
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    E = sorted((D[i, j], i, j) for i, j in itertools.combinations(range(n), 2))
    rank = {(i, j): r for r, (_, i, j) in enumerate(E)}
    low, out = {}, []
    for m, own in sorted((max(x), x) for i, j, k in itertools.combinations(range(n), 3) for x in ([rank[i, j], rank[i, k], rank[j, k]],)):
        c = set(own)
        while c and max(c) in low:
            c ^= low[max(c)]
        if c:
            low[max(c)] = c
            if E[m][0] > E[max(c)][0]:
                out.append((E[max(c)][0], E[m][0]))
    return np.array(sorted(out)).reshape(-1, 2)


def test_loops_are_brute_force():
    rng = np.random.default_rng(0)
    for t in range(25):
        X = rng.normal(size=(rng.integers(4, 22), rng.integers(1, 5)))
        if t % 4 == 0:
            X = np.round(X * 2)  # ties and equal points
        got, want = topology.persistence1(X), brute_loops(X)
        assert got.shape == want.shape and np.allclose(got, want)


def test_a_circle_has_one_long_loop():
    a = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    s = topology.persistence_summary(np.c_[np.cos(a), np.sin(a)])
    assert s["strength"] == 1.0 and 1.5 < s["h1_longest"] < 2
    assert topology.persistence_summary(np.linspace(0, 1, 50)[:, None])["h1_longest"] == 0


def test_label_choice():
    chosen, skipped = topology.choose_labels({0: 10, 1: 40, 2: 50, 3: 60, 4: 70, 5: 80, 6: 90}, {1: 9, 6: 8})
    assert chosen == [1, 6, 5, 4, 3] and [x["label_idx"] for x in skipped] == [0, 2]


def test_multilabel_topology(spark):
    a = np.random.default_rng(3).uniform(0, 2 * np.pi, 240)
    X = np.c_[np.cos(a), np.sin(a)]
    Y = np.stack([(X[:, 0] > 0), (np.arange(240) % 2), (np.arange(240) < 8)], 1).astype(int)
    rows = [(i, X[i].tolist(), Y[i].tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, labels array<int>")
    r = diagnose(df, target="labels", return_report=True, budget="standard", random_state=0)
    t = r.metrics["topology"]
    assert {x["label_idx"] for x in t["labels"]} == {0, 1} and t["skipped_labels"][0]["label"] == "label_2"
    assert t["strength"] == 1.0 and r.scores["topology_score"] == 1.0
