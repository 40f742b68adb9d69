"""Every registered query of the diagnostics gives the rows of its SQL, and every query runs."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurescope.operators import graph, neighbors, scoring
from featurescope.plans import registry

DATA = os.environ.get("FEATURESCOPE_TESTDATA", "/root/testdata/sf0.001")
SLOW = {"diagnose_report", "probe_quadratic"}  # run by test_diagnosis


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "labels", "documents", "part", "lineitem", "orders"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(x: pd.DataFrame) -> list:
    def plain(v):
        return None if not isinstance(v, list) and pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)

    return sorted((tuple(plain(v) for v in r) for r in x[sorted(x.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in registry.ORACLE_SQL:
        want = con.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 for r, q in zip(a, b, strict=True) for x, y in zip(r, q, strict=True))


@pytest.fixture(scope="module")
def embedded(tmp_path_factory):
    """A folder whose embeddings have the given ids, vectors and labels."""

    def put(ids, vectors, labels):
        d = tmp_path_factory.mktemp("embedded")
        pd.DataFrame({"vec_id": ids, "embedding": vectors, "label": labels}).to_parquet(f"{d}/embeddings.parquet")
        return str(d)

    return put


def test_whole_groups_larger_than_the_cap_give_no_rows(spark, embedded):
    for each, n in ((400, 0), (130, 260), (13, 260)):  # rows of each of 20 groups, rows that fit into 260
        ids = list(range(20 * each))
        got = registry.QUERIES["whole_group_sample"](spark, embedded(ids, [[float(i), 1.0] for i in ids], [i // 20 % 3 for i in ids]))
        assert got.columns == ["row_id", "group_id", "label"]
        rows = got.groupBy("group_id").count().collect()
        assert sum(r["count"] for r in rows) == n and {r["count"] for r in rows} <= {each}


@pytest.mark.parametrize("grouped", [False, True])
def test_wide_bootstrap_equals_one_task(spark, monkeypatch, grouped):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(size=(400, 3)), np.repeat(rng.normal(size=(6, 3)), 30, axis=0), rng.integers(0, 4, (120, 3)) + 9.0, 50 + rng.normal(size=(20, 3))])
    ids = rng.permutation(len(X)) * 7 - 900
    df = spark.createDataFrame([(int(i), int(i) % 90, [float(v) for v in x]) for i, x in zip(ids, X, strict=True)], "row_id long, group_id long, features array<double>").repartition(7)
    want = {r.b: r.fragmentation for r in graph.fragmentation_bootstrap(df, 3, 2, grouped=grouped).collect()}
    monkeypatch.setattr(graph, "ONE_TASK_ROWS", 100)
    monkeypatch.setattr(graph, "DRAWS_AT_ONCE", 64)
    got = {r.b: r.fragmentation for r in graph.fragmentation_bootstrap(df, 3, 2, grouped=grouped).collect()}
    assert got.keys() == want.keys() == {0, 1, 2} and len(set(want.values())) == 3
    assert all(abs(got[b] - want[b]) < 1e-9 for b in got)


def test_bootstrap_links_every_draw_with_its_nearest(spark):
    """Held against all pairs of draws; without equal distances, other than between draws of one row, there is one such graph."""
    rng = np.random.default_rng(8)
    X = np.vstack([c + rng.normal(size=(60, 2)) for c in (0, 40, 90)])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "row_id long, features array<double>")
    got = {r.b: r.fragmentation for r in graph.fragmentation_bootstrap(df, 3, 5, k=4).collect()}
    for b in range(3):
        at = np.random.default_rng([5, b]).integers(0, len(X), len(X))
        d = np.sqrt(((X[at][:, None] - X[at][None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :4]
        root = graph._roots(np.repeat(np.arange(len(at)), 4), near.ravel(), len(at))
        p = np.unique(root, return_counts=True)[1] / len(at)
        want = np.mean([1 - p.max(), min(1, len(p) / max(3, len(at) / 20)), -(p * np.log(p)).sum() / np.log(max(2, len(p)))])
        assert len(p) > 2 and abs(got[b] - want) < 1e-9


@pytest.mark.parametrize("cross", [False, True])
@pytest.mark.parametrize("broadcast", [0, 8 << 20])
def test_neighbours_of_many_copies(spark, monkeypatch, cross, broadcast):
    """Few distinct vectors, single rows among them, ties within and between points: as all pairs of rows, without comparing these."""
    rng = np.random.default_rng(3)
    X = np.vstack([rng.integers(0, 4, (700, 2)).astype(float), np.full((60, 2), 9.0), [[-0.0, 5.0], [0.0, 5.0], [100.0, 100.0]]])
    ids = rng.permutation(len(X)) * 3 - 500
    g = rng.integers(0, 3, len(X))
    df = spark.createDataFrame([(int(i), int(c), [float(v) for v in x]) for i, c, x in zip(ids, g, X, strict=True)], "row_id long, c long, features array<double>").repartition(5)
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", broadcast)
    met = []
    inner = neighbors.nearest_rows
    monkeypatch.setattr(neighbors, "nearest_rows", lambda rows, *a, **b: inner(met.append(rows.count()) or rows, *a, **b))
    got = neighbors.neighbors(df, 5, other=F.col("c") if cross else None)
    assert got.columns == ["row_id", "neighbor_id", "distance", "rank"]
    got = sorted((r.row_id, r["rank"], r.neighbor_id, r.distance) for r in got.collect())
    want = []
    for i, c, x in zip(ids, g, X, strict=True):
        d = np.sqrt(((X - x) ** 2).sum(1))
        ok = [(v, j) for v, j, h in zip(d, ids, g, strict=True) if j != i and not (cross and h == c)]
        want += [(int(i), at + 1, int(j), float(v)) for at, (v, j) in enumerate(sorted(ok)[:5])]
    assert got == sorted(want)
    assert met and met[0] < 120


PART_QUERIES = ["hard_subset", "neighborhood_regression", "score_per_target", "score_regression"]


@pytest.mark.parametrize("name", PART_QUERIES)
def test_parts_of_few_vectors(spark, monkeypatch, tmp_path, name):
    """2000 parts of 194 vectors: the rows of the SQL, from at most so many rows that meet."""
    rng = np.random.default_rng(6)
    keys = rng.permutation(2000)
    pd.DataFrame({"p_partkey": keys, "p_size": (1 + rng.integers(0, 2, 2000)).astype("int32"), "p_retailprice": np.round(rng.uniform(900, 2000, 2000), 2)}).to_parquet(f"{tmp_path}/part.parquet")
    met = []
    inner = neighbors.nearest_rows
    monkeypatch.setattr(neighbors, "nearest_rows", lambda rows, *a, **b: inner(met.append(rows.count()) or rows, *a, **b))
    a = rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas())
    c = duckdb.connect()
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    b = rows(c.execute(registry.ORACLE_SQL[name]).df())
    assert len(a) == len(b) and met == [194]
    assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 for r, q in zip(a, b, strict=True) for x, y in zip(r, q, strict=True))


@pytest.mark.parametrize("kinds", [9, 400])
@pytest.mark.parametrize("cross", [False, True])
@pytest.mark.parametrize("broadcast", [0, 8 << 20])
def test_neighbours_carry_values(spark, monkeypatch, kinds, cross, broadcast):
    """Points and single rows: each edge has the value of both its ends, nulls and null entries among them."""
    rng = np.random.default_rng(5)
    ids = [int(i) for i in rng.permutation(400) * 3 - 500]
    v = {i: None if i % 11 == 0 else [float(i), None] if i % 7 == 0 else [float(i), 0.5] for i in ids}
    df = spark.createDataFrame([(i, i // 3 % 4, [float(at % kinds), 1.0], v[i]) for at, i in enumerate(ids)], "row_id long, c long, features array<double>, v array<double>").repartition(5)
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", broadcast)
    other = F.col("c") if cross else None
    plain = {tuple(r) for r in neighbors.neighbors(df, 4, other=other).collect()}
    got = neighbors.neighbors(df, 4, other=other, carry=F.col("v")).select("row_id", "neighbor_id", "distance", "rank", "own", "near").collect()
    assert len(plain) == len(got) == 1600 and {tuple(r)[:4] for r in got} == plain
    assert all(r.own == v[r.row_id] and r.near == v[r.neighbor_id] for r in got)


CARRIED = ["neighborhood_regression", "score_per_target", "score_regression"]


@pytest.mark.parametrize("name", CARRIED)
def test_edges_of_parts_are_not_joined(spark, tmp_path, name):
    """Targets come with the edges, which nothing deals out by the neighbour."""
    rng = np.random.default_rng(7)
    pd.DataFrame({"p_partkey": range(1500), "p_size": (1 + rng.integers(0, 2, 1500)).astype("int32"), "p_retailprice": np.round(rng.uniform(900, 2000, 1500), 2)}).to_parquet(f"{tmp_path}/part.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Generate" in plan and "hashpartitioning(neighbor_id" not in plan


def test_standardised_targets(spark):
    """Constant, missing and ragged targets: as numpy; rows without targets have no row."""
    y = {1: [1.0, 5.0, None], 2: [2.0, 5.0, 3.0], 4: [9.0, 5.0], 5: [], 6: None}
    df = spark.createDataFrame(list(y.items()), "row_id long, targets array<double>")
    got = {r.row_id: r.z for r in neighbors.standardised_targets(df).collect()}
    s = np.std([1, 2, 9])
    want = {1: [-3 / s, 0.0, None], 2: [-2 / s, 0.0, 0.0], 4: [5 / s, 0.0]}
    assert got.keys() == want.keys()
    assert all(len(got[i]) == len(want[i]) and all(a is b is None or abs(a - b) < 1e-9 for a, b in zip(got[i], want[i], strict=True)) for i in want)


def test_regression_scores_without_weights(spark):
    """As with weights of one, and as numpy, on values far from zero with a constant target; the predictions are read once."""
    rng = np.random.default_rng(9)
    y = np.stack([1e6 + rng.normal(size=300), rng.normal(size=300), np.full(300, 4.0)], 1)
    q = y + rng.normal(size=y.shape) / 2
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", 1.0, [float(v) for v in y[i]], [float(v) for v in q[i]]) for i in range(300)], "row_id long, probe string, w double, y array<double>, prediction array<double>")
    got = scoring.regression_scores(df, "probe")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    ones = {r.probe: r for r in scoring.regression_scores(df, "probe", weight="w").collect()}
    for r in got.collect():
        of = [i for i in range(300) if (i % 3 > 0) == (r.probe == "a")]
        sse, sst = ((y[of] - q[of]) ** 2).sum(0)[:2], ((y[of] - y[of].mean(0)) ** 2).sum(0)[:2]
        want = 1 - sse.sum() / sst.sum(), np.mean(1 - sse / sst), np.mean(np.sqrt(sse / sst))
        assert np.allclose(r[1:], want, rtol=1e-6) and np.allclose(r[1:], ones[r.probe][1:], rtol=1e-6)
