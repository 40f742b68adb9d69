"""Every registered query of the package, run as the driver runs it, over tables with the awkward rows of conftest."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from featurescope.llm import ann_tree, decontamination, packing, pii, registry, token_files, toxicity
from featurescope.llm.tokens import END_ID, encoder
from featurescope.runtime import shared_path

COLUMNS = {
    "op1_pigeonhole_myers": ["doc_id", "item_id", "edits", "item_words", "start_word", "end_word"],
    "op2_fragment_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op3_url_lm_ratio": ["page_id", "host", "path", "rule", "verdict"],
    "op4_zip_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op5_rank_order_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_harmonic_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7_pii_boosted": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
    "op8_kmeans_tree": ["query_id", "rank", "vec_id", "score"],
    "op9_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_toxicity_cnn": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.fixture(scope="module")
def tables(spark, docs, labels, texts, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    n = 60
    rng = np.random.default_rng(7)
    # SQL joins by doc_id, so ids are unique and known there
    docs.select("doc_id", "text", "lang", "source").where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, " ".join(texts[64][1].split()[:9])), (1, None), (2, "one two")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(i, f"http{'s' * (i % 2)}://{('a.com', 'b.net', 'example.com', 'q.org')[i % 4]}/{('en', 'fr')[i % 3 % 2]}/p{i % 9}", f"<p>{i % 11}</p>") for i in range(n)] + [(n, None, None), (n + 1, "", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, rng.normal(size=6).tolist(), i % 3) for i in range(150)] + [(150, None, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: q(spark, f"file://{tables}").toPandas() for name, q in registry.QUERIES.items()}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(results, name):
    assert set(registry.QUERIES) == set(COLUMNS)
    assert list(results[name].columns) == COLUMNS[name] and len(results[name])


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_is_its_sql(tables, results, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    got = results[name]
    assert sorted(got.columns) == sorted(want.columns)
    def plain(x):
        rows = x[sorted(got.columns)].astype(object).itertuples(index=False)
        return sorted(tuple("" if pd.isna(v) else str(int(v)) if not isinstance(v, str) and float(v).is_integer() else str(v) for v in r) for r in rows)

    assert plain(got) == plain(want)


def test_held_out_rows(results):
    for name, of, one in (("op5_rank_order_langid", 3, 1), ("op10_toxicity_cnn", 4, 2)):
        for r in results[name].itertuples():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == one)
            assert 0 <= r.score <= 1
    assert (results["op10_toxicity_cnn"].predicted == (results["op10_toxicity_cnn"].score >= 0.3)).all()


def test_language_of_held_out_rows(results, texts):
    lang = {r[0]: r[2] for r in texts if r[0] is not None and r[0] < 90}
    rows = [r for r in results["op5_rank_order_langid"].itertuples() if r.held_out and r.doc_id in lang]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) >= 0.95


def test_tokens(spark, tables, results):
    want, at = {}, 0
    enc = encoder(None)
    packed = results["op6_harmonic_packing"]
    files = results["op9_token_files"].set_index("doc_id")
    for r in sorted(spark.read.parquet(f"file://{tables}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*enc.tok.encode(r.text or "", add_special_tokens=False).ids, END_ID], "<u4")
        want[r.doc_id] = ids
        f = files.loc[r.doc_id]
        assert (f.start, f.n_tokens, f.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for i, own in packed.groupby("doc_id"):
        own, ids, end = own.sort_values("start"), want[i], 0
        for p in own.itertuples():
            assert p.start == end and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            end += p.length
        assert end == len(ids)
    for _, own in packed.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 4096


def test_packing_of_one_hot_row(spark):
    """A third of all rows are one row: it is dealt to all buckets, and its bins fill."""
    rows = [(-7, "the same short text")] * 600 + [(i, "word " * (i % 900)) for i in range(1200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), buckets=20).toPandas()
    assert len(got.drop_duplicates(["sequence_id", "offset"])) == len(got)
    seq = got.groupby("sequence_id").length.sum()
    assert seq.max() <= 4096 and got.length.sum() / (4096 * len(seq)) > 0.95
    assert (got.doc_id == -7).sum() == 600


def test_shards_of_one_hot_id(spark):
    rows = [(7, "hot")] * 900 + [(7, f"t{i}") for i in range(900)] + [(i, "x") for i in range(90)]
    folder = shared_path(spark, "hot-tokens")
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), folder, shards=8)
    assert max(r.n_docs for r in manifest.collect()) < 700
    got = token_files.read_token_files(manifest, folder).toPandas().sort_values("start")
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all() and got.doc_id.is_monotonic_increasing and len(got) == len(rows)


def test_toxicity_on_held_out_rows(spark, docs, labels, texts):
    model = toxicity.learn(docs, labels)
    bad = {r[0]: "scumbag" in (r[1] or "") for r in texts if r[0] is not None}
    rows = [r for r in toxicity.score(docs.select("doc_id", "text"), model).collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    caught = sum(r.score >= 0.3 for r in rows if bad[r.doc_id])
    wrong = sum(r.score >= 0.3 for r in rows if not bad[r.doc_id])
    assert caught == sum(bad[r.doc_id] for r in rows) and wrong <= len(rows) // 20


def test_toxicity_sample_is_bounded(spark, docs, labels):
    small = toxicity.learn(docs, labels, sample_bytes=4000)
    assert small.embedding is None or len(small.known) < len(toxicity.learn(docs, labels).known)
    twice = toxicity.learn(docs.unionByName(docs).repartition(7), labels)  # repeated rows change nothing
    assert np.array_equal(twice.known, toxicity.learn(docs, labels).known)


def test_modules_state_their_methods():
    assert all(m.__doc__ and "Defined cases" in m.__doc__ for m in (ann_tree, decontamination, packing, pii, token_files, toxicity))
