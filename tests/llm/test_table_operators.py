import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from featurescope.llm import ann_tree, decontamination, jaccard, pii, toxicity, url_filter, warc_zip
from featurescope.llm.common import RangeReader, local_path, put_file
from featurescope.runtime import materialise, shared_path

# ---------------------------------------------------------------- Jaccard


def shingle_set(t, width=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    ids = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = defaultdict(list)
    for k, (_, s) in enumerate(ids):
        for x in s:
            inverse[x].append(k)
    for k, (i, s) in enumerate(ids):
        for j, o in Counter(j for x in s for j in inverse[x] if j > k).items():
            if 100 * o >= 80 * (len(s) + len(ids[j][1]) - o):
                p, q = find(i), find(ids[j][0])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def check_components(df, rows):
    got = df.collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    size = defaultdict(set)
    for i, t in rows:
        size[i].add(len(shingle_set(t)))
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.n_shingles in size[r.doc_id]


def test_jaccard(docs, texts):
    check_components(jaccard.components(docs), [(r[0], r[1]) for r in texts])


def test_jaccard_near_copies_at_all_distances(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((9, 40, 150)))]
        for _ in range(25):
            w = base[:]
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            if rng.random() < 0.2:
                w = w[: int(len(w) * rng.uniform(0.7, 1))]
            rows.append((len(rows), " ".join(w)))
    for _ in range(150):  # a passage that unlike documents share
        rows.append((len(rows), " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(2, 30))), *vocabulary[:60]])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_components(jaccard.components(df), rows)


def brute_keep_one(rows):
    """One row of each component of rows, of the smallest doc_id; rows with empty sets all stay."""
    comp = brute_components([(i, r[1]) for i, r in enumerate(rows)])
    best = {}
    for i, r in enumerate(rows):
        if shingle_set(r[1]):
            best[comp[i]] = min(best.get(comp[i], (True, 0, i)) if comp[i] in best else (r[0] is None, r[0] or 0, i), (r[0] is None, r[0] or 0, i))
    keep = {i for *_, i in best.values()}
    return [r for i, r in enumerate(rows) if i in keep or not shingle_set(r[1])]


def test_keep_one_judges_rows(spark):
    same, other = "one text of more than five words stands here", "a second text that is like nothing else at all"
    rows = [(1, same), (5, same), (5, other), (7, "seven words that repeat in two rows"), (7, "seven words that repeat in two rows"), (None, same), (None, "null id with a copy of its own text"), (None, "null id with a copy of its own text"), (9, ""), (9, None)]
    got = jaccard.keep_one(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id int, text string, jaccard_row_ long, gone_ long").repartition(3))
    assert got.columns == ["doc_id", "text", "jaccard_row_", "gone_"]
    same_rows([r[:2] for r in got.collect()], brute_keep_one(rows))


def test_jaccard_links_are_all_links(spark, docs, texts):
    sets = {}
    for r in texts:
        if r[0] is not None and shingle_set(r[1]):
            sets.setdefault(shingle_set(r[1]), set()).add(r[0])
    reps = sorted((min(v), s) for s, v in sets.items())
    want = {(a, b) for k, (a, s) in enumerate(reps) for b, t in reps[k + 1 :] if 100 * len(s & t) >= 80 * len(s | t)}
    pairs, members = jaccard.links(docs)
    assert {(r.src, r.dst) for r in pairs.collect()} == want
    near = defaultdict(set)
    for a, b in want:
        near[a].add(b)
        near[b].add(a)
    own = {min(v): len(v) for v in sets.values()}
    got = members.collect()
    assert len(got) == len(texts)
    for r in got:
        if r.rep is None:
            assert r.n_links == 0
        else:
            assert r.n_links == own[r.rep] - 1 + sum(own[x] for x in near[r.rep])


def test_jaccard_with_one_hot_shingle_and_joined_ids(spark, monkeypatch):
    """A shingle that most documents share, and more ids than a table of bits holds."""
    monkeypatch.setattr(jaccard, "_MOST_BITS", 64)
    rng = random.Random(6)
    rows = [(i, "hot words in every short text " + " ".join(f"v{rng.randint(0, 3000)}" for _ in range(rng.choice((0, 0, 1, 3, 20))))) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(0, 400, 7)]
    check_components(jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), rows)


def test_jaccard_of_empty(empty):
    assert jaccard.components(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0


def test_prefix_and_least_overlap(spark):
    for n in range(1, 300):
        assert jaccard.prefix_length(n) == n - math.ceil(0.8 * n - 1e-9) + 1
    rows = spark.range(1, 60).selectExpr("id as n").crossJoin(spark.range(1, 60).selectExpr("id as m"))
    from pyspark.sql import functions as F

    for r in rows.select("n", "m", jaccard.least_overlap(F.col("n"), F.col("m")).alias("o")).collect():
        assert r.o == next(o for o in range(200) if 100 * o >= 80 * (r.n + r.m - o))


# ---------------------------------------------------------------- URLs


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        host = rng.choice(["a.example.com", "www.example.com", "Shop.COM", "x.example.net", "y.net", "z.org", "q.example.org", "deep.www.example.com"])
        lang = rng.choice(["en", "de", "fr", "es"])
        rows.append([i, f"http{rng.choice(['', 's'])}://{host}/{lang}/{rng.choice(['spam', 'news'])}-{rng.randint(1, 99)}{rng.choice(['', '?q=1', '#top', '/'])}", f"<p>{i % 40}</p>" * (i % 7)])
    rows += [[300, None, None], [301, "", ""], [302, "no scheme/com", "x"], [303, "http://com", "x"], [304, "http://com/", "x"], [305, "http://EXAMPLE.com/en/ü?x", "ß"], [306, "://", "y"], [307, "http://notexample.com/en/", "y"], [308, "http://host.org/" + "a" * 50_000, "z" * 300_000]]
    rows += [[None, "http://z.org/en/1", "dup"], [None, None, "dup"], [309, "http://z.org/en/1", "dup"], [309, "http://z.org/en/1", "dup"], [310, "http://z.org/en/1", "dup"]]
    extra = "host string, path string, score double, gram string, action string, refers_to long, sha binary"
    return spark.createDataFrame([tuple(r + [None] * 7) for r in rows], f"page_id long, url string, html string, {extra}").repartition(3).cache()


def duck(pages, sql):
    con = duckdb.connect()
    con.register("pages_df", pages.select("page_id", "url", "html").toArrow())
    con.execute("create view pages as select * from pages_df")
    return con.execute(sql).fetchall()


def same_rows(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((tuple(r) for r in want), key=key)


def test_url_verdicts_are_the_sql(pages):
    got = url_filter.judge(pages).where("page_id is not null").select("page_id", "host", "path", "rule", "verdict").distinct().collect()
    same_rows(got, {r for r in duck(pages.where("page_id is not null").dropDuplicates(["page_id"]), url_filter.ORACLE_SQL)})
    by = {r.page_id: r for r in got}
    assert by[303].rule is None and by[304].rule == "com/" and by[305].rule == "example.com/en/" and by[305].host == "example.com"
    assert by[300].host == "" and by[302].host == "" and by[307].rule == "com/"
    assert url_filter.judge(pages).count() == pages.count()


def test_url_rules_longest_wins(pages):
    rows = url_filter.with_rules(url_filter.parsed(pages.select("page_id", "url"))).where("host = 'deep.www.example.com' and path like '/en/%'").collect()
    assert rows and all(r.rule == "www.example.com/en/" and r.action == "allow" for r in rows)


def test_url_model_separates(spark):
    rng = random.Random(8)
    rows = [(i, f"http://s{i}.{'com' if i % 2 else 'net'}/{'fr' if i % 2 == 0 else 'en'}/{'casino-win' if i % 2 == 0 else 'science-paper'}{rng.randint(1, 9)}") for i in range(400)]
    rows += [(1000, "http://a.org/casino-win5"), (1001, "http://a.org/science-paper5")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000] == "block" and got[1001] == "allow"


def test_url_plan_is_native(pages):
    plan = url_filter.judge(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_empty(pages):
    assert url_filter.judge(pages.where("false")).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("page_id in (300, 301)")).collect()} == {"allow"}


# ---------------------------------------------------------------- WARC


@pytest.mark.parametrize(("zip64", "target"), [(False, 1 << 25), (True, 2000)])
def test_warc_round_trip(spark, pages, zip64, target):
    folder = shared_path(spark, "w")
    manifest = warc_zip.write_packages(pages, folder, zip64=zip64, target=target)
    rows = warc_zip.read_packages(manifest, folder, with_payload=True).collect()
    source = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    top = {}
    for i, p in source:
        if i is not None:
            top[p] = max(top.get(p, i), i)
    want = []
    for i, p in source:
        revisit = i is not None and i < top[p]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top[p] if revisit else None))
    same_rows([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], want)
    assert Counter(bytes(r.payload) for r in rows if r.record_type == "response") == Counter(p for (i, p), w in zip(source, want, strict=True) if w[3] == "response")


def test_warc_is_the_sql(spark, pages):
    own = pages.where("page_id is not null").dropDuplicates(["page_id"])
    folder = shared_path(spark, "w")
    same_rows(warc_zip.read_packages(warc_zip.write_packages(own, folder), folder).collect(), duck(own, warc_zip.ORACLE_SQL))


def test_warc_least_bytes(spark, pages):
    folder = shared_path(spark, "w")
    rows = warc_zip.read_packages(warc_zip.write_packages(pages, folder, least_bytes=4), folder).collect()
    assert all(r.payload_bytes >= 4 for r in rows if r.record_type == "revisit")


def test_warc_empty(spark, pages):
    folder = shared_path(spark, "w")
    assert warc_zip.read_packages(warc_zip.write_packages(pages.where("false"), folder), folder).count() == 0


def test_zip_is_a_zip(spark, tmp_path):
    import zipfile

    for zip64 in (False, True):
        uri = f"file://{tmp_path}/p{zip64}.zip"
        put_file(uri, warc_zip.zip_package([("a/b", [b"hello ", b"world"]), ("c", [b""])], zip64=zip64))
        with zipfile.ZipFile(local_path(uri)) as z:
            assert z.testzip() is None and z.read("a/b") == b"hello world"
        f = RangeReader(uri)
        at, n = warc_zip.zip_members(f)["a/b"]
        assert f.read(at, n) == b"hello world"
        with zipfile.ZipFile(f"{tmp_path}/q.zip", "w") as z:  # written by another tool, with a comment
            z.writestr("x", b"stored")
            z.writestr("y", b"packed" * 100, compress_type=zipfile.ZIP_DEFLATED)
            z.comment = b"PK\5\6 in a comment"
        members = warc_zip.zip_members(RangeReader(f"file://{tmp_path}/q.zip"))
        assert list(members) == ["x"]
    put_file(f"file://{tmp_path}/bad", b"not a zip at all, but long enough to hold a record")
    with pytest.raises(ValueError, match="end-of-central-directory"):
        warc_zip.zip_members(RangeReader(f"file://{tmp_path}/bad"))


# ---------------------------------------------------------------- nearest neighbours


def brute_nearest(rows, k=20, every=20):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ok = sorted(ok)
    X, ids = np.array([v for _, v in ok], float), np.array([i for i, _ in ok])
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        x = X[np.flatnonzero(ids == q)[0]]
        s = (X * x).sum(1)
        s[ids == q] = -np.inf
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k] if np.isfinite(s[j])]
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).astype(np.float32).astype(float).tolist()) for i in range(n)]
    for i in range(0, n, 3):  # a hot vector
        rows[i] = (i, rows[0][1])
    rows += [(n, None), (n + 1, [0.0] * 8), (n + 2, [None] * 8), (n + 3, [math.nan] * 8), (n + 4, [math.inf] * 8), (n + 5, [1.0] * 7), (None, [1.0] * 8), rows[5], rows[5]]
    return rows


def test_nearest(spark):
    rows = vectors(1200)
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "vec_id long, embedding array<float>, leaf int, x double, rank string").repartition(4)
    info = {}
    got = ann_tree.search(df, info=info).toPandas()
    want = brute_nearest(rows)
    assert set(got.query_id) == set(want) and info["leaves"] > 4
    hit = 0
    for q, best in want.items():
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and len(set(own.vec_id)) == 20 and q not in set(own.vec_id)
        assert [(-s, i) for i, s in zip(own.vec_id, own.score, strict=True)] == sorted((-s, i) for i, s in zip(own.vec_id, own.score, strict=True))
        hit += len(set(own.vec_id) & {i for i, _ in best})
    assert hit / sum(map(len, want.values())) >= 0.9


def test_outliers_find_k_in_small_leaves(spark):
    """Queries far from all others, whose first leaves hold next to nothing."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(8)[i % 5] + rng.normal(size=8) * 0.01).tolist()) for i in range(1, 900)]
    rows = [(i, v) for i, v in rows if i % 20] + [(20 * j, (30 * (j + 1) * np.eye(8)[j % 8] * (-1) ** j).tolist()) for j in range(12)]
    got = ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).groupBy("query_id").count().collect()
    assert len(got) == 12 and all(r["count"] == 20 for r in got)


def test_cells_hold_every_leaf():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(0, rng.integers(2, 60), rng.integers(1, 40))
        first, parts = ann_tree._cells(sizes, int(rng.integers(1, 50)), int(rng.integers(1, 80)))
        assert (parts >= 1).all() and (np.diff(first) >= 0).all()
        for i in np.flatnonzero(parts > 1):  # a leaf that is dealt over several cells shares none
            mine = set(range(first[i], first[i] + parts[i]))
            assert all(i == j or not (mine & set(range(first[j], first[j] + parts[j]))) or not sizes[j] for j in range(len(sizes)))


def test_nearest_in_tiny_cells(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "CELL_BYTES", 8 * 8 * 16)
    monkeypatch.setattr(ann_tree, "QUERY_BYTES", 8 * 8 * 4)
    rows = vectors(600, seed=2)
    info = {}
    got = ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=1.0, info=info).collect()
    want = brute_nearest(rows)
    own = defaultdict(set)
    for r in got:
        own[r.query_id].add(r.vec_id)
    assert sum(len(own[q] & {i for i, _ in best}) for q, best in want.items()) / sum(map(len, want.values())) >= 0.95


def test_nearest_few(spark):
    rows = vectors(30)
    got = ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute_nearest(rows)
    for q, best in want.items():
        own = [r for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert [r.vec_id for r in own] == [i for i, _ in best] and [r.score for r in own] == pytest.approx([s for _, s in best])
    one = spark.createDataFrame([(0, [1.0] * 8)], "vec_id long, embedding array<float>")
    assert ann_tree.search(one).count() == 0 and ann_tree.search(one.where("false")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, docs, labels, texts, tmp_path):
    bench = spark.createDataFrame([(0, " ".join(texts[64][1].split()[:6])), (1, None)], "item_id long, text string")
    d = f"file://{tmp_path}"
    source = docs.select("doc_id", "text", "lang", "source", "n_chars")
    source.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    kept = [now]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], d), f"test-{name}"))
    rows = [[tuple(r) for r in k.collect()] for k in kept[:-1]]
    assert all(k.columns == now.columns for k in kept[:-1])
    model = toxicity.learn(now, labels)
    good = [tuple(r) for r in toxicity.score(now, model).where(~toxicity.is_toxic(model)).select(*now.columns).collect()]
    same_rows(rows[1], good)
    same_rows(rows[2], brute_keep_one(rows[1]))
    items = next(decontamination.item_blocks(bench))
    same_rows(rows[3], [r for r in rows[2] if not items.matches(decontamination.core_words((r[1] or "").encode()))])
    assert len(rows[3]) < len(rows[2]) < len(rows[1]) < len(rows[0])
    m = pii.learn(kept[3])
    want = []
    for r in rows[3]:
        t = pii.redacted(r[1], pii.spans(r[1], m)[1])
        want.append((r[0], t, r[2], r[3], len(t or "")))
    same_rows(rows[4], want)
    last = kept[5].toPandas()
    assert last.groupby("sequence_id").length.sum().max() <= 4096 and last.length.sum() > 0
    assert corpus_pipeline.run(spark, d).count() == len(last)


def test_pipeline_of_empty(spark, empty, labels, tmp_path):
    d = f"file://{tmp_path}"
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    labels.where("false").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
