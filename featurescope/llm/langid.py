"""Operator 5: language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 3, with word borders) by
rank.  A document's profile over its whole text is compared with each language's:
every n-gram of the document adds the distance between its two ranks, or the
largest distance where the language's profile lacks it.  The language with the
smallest sum wins, ties to the smaller name.

Language profiles come from a bounded sample: at most ``PER_LANG`` documents of
each language, by hash, whole texts.  N-grams are exact 63-bit keys (three code
points of 21 bits), so no alphabet is assumed.

Defined cases: null text, or one without a letter, is ``und`` with score 0; so is
all when nothing can be learned; null ``doc_id`` is neither held out nor learned
from; further columns are ignored.  The score is 1 minus the winner's sum over
the runner-up's (over the largest possible sum, if one language is known).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featurescope.runtime import materialise

from .common import lowest_hashes, small_batches, table

PROFILE = 400
DOCUMENT = 300
PER_LANG = 1500


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """Keys of all letter n-grams of a text, in no order, with repeats."""
    if not text:
        return np.empty(0, np.uint64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c = np.where(_letters()[c.astype(np.int64)], c, np.uint64(32))
    c = c[(c != 32) | np.concatenate([[True], c[:-1] != 32])]
    if len(c) < 3:
        return np.empty(0, np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    return np.concatenate([c[c != 32], two, three[c[1:-1] != 32]])


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, ties to the smaller key; ``keys`` ascend."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    def __init__(self, lists: dict[str, np.ndarray]):
        self.names = sorted(lists)
        self.lists = [lists[n] for n in self.names]
        self.sorted = [np.sort(x) for x in self.lists]
        self.rank = [np.argsort(x, kind="stable") for x in self.lists]

    def judge(self, text: str | None) -> tuple[str, float]:
        keys = ngrams(text)
        if not len(keys) or not self.names:
            return "und", 0.0
        mine = ranked(*np.unique(keys, return_counts=True), DOCUMENT)
        place = np.arange(len(mine))
        sums = []
        for own, rank in zip(self.sorted, self.rank, strict=True):
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            sums.append(int(np.where(own[at] == mine, np.abs(rank[at] - place), PROFILE).sum()))
        best = int(np.argmin(sums))
        second = min((s for i, s in enumerate(sums) if i != best), default=PROFILE * len(mine))
        return self.names[best], float(min(1.0, max(0.0, 1 - sums[best] / second))) if second else 0.0


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, *, per_lang: int = PER_LANG, size: int = PROFILE) -> Profiles:
    """Profiles of every non-null ``lang`` among the documents that are not held out."""
    small_batches(docs.sparkSession)
    known = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out()).select("doc_id", "lang")
    picked = materialise(lowest_hashes(known, "lang", per_lang).select("doc_id").distinct(), "langid-sample")
    rows = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    # per_lang ids of each language: sent to all while few, joined by a shuffle beyond that
    rows = rows.join(F.broadcast(picked) if picked.count() <= 200_000 else picked, "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(ngrams(text))
            for lang, x in by_lang.items():
                keys, n = np.unique(np.concatenate(x), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "gram", "r").collect():  # size rows of each language
        lists.setdefault(r.lang, []).append((r.r, r.gram))
    return Profiles({k: np.array([g for _, g in sorted(v)], np.int64).astype(np.uint64) for k, v in lists.items()})


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE keys of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


# crc32 byte by byte; letters as code points; ranks of n-grams in languages and documents; out-of-place sums.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)), 4294967295)"
ORACLE_SQL = f"""
with d as (select row_number() over () rid, doc_id::bigint doc_id, lang, text from documents),
h as (select *, coalesce({_CRC} % 3 = 1, false) held_out from d),
k as (select doc_id, row_number() over (partition by lang order by ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint, doc_id) r from h where doc_id is not null and text is not null and lang is not null and not held_out),
w as (select *, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) words, lang is not null and text is not null and doc_id in (select doc_id from k where r <= {PER_LANG}) learned from h),
c as (select rid, lang, learned, list_transform(string_split(' ' || words || ' ', ''), lambda x: unicode(x)::bigint) c from w where words <> ''),
i as (select rid, lang, learned, unnest(c) a, unnest(list_concat(c[2:], [null])) b, unnest(list_concat(c[3:], [null, null])) e from c),
g as (select rid, lang, learned, a gram from i where a <> 32 union all select rid, lang, learned, (a << 21) | b from i where b is not null union all select rid, lang, learned, (((a << 21) | b) << 21) | e from i where e is not null and b <> 32),
n as (select rid, lang, learned, gram, count(*) n from g group by all),
p as (select * from (select rid, gram, row_number() over (partition by rid order by n desc, gram) - 1 place from n) where place < {DOCUMENT}),
l as (select * from (select lang, gram, row_number() over (partition by lang order by sum(n) desc, gram) - 1 rank from n where learned group by lang, gram) where rank < {PROFILE}),
names as (select distinct lang from l),
s as (select p.rid, names.lang, sum(coalesce(abs(l.rank - p.place), {PROFILE}))::bigint s from p cross join names left join l on l.lang = names.lang and l.gram = p.gram group by all),
o as (select *, row_number() over (partition by rid order by s, lang) r, lead(s) over (partition by rid order by s, lang) next from s),
z as (select rid, lang, s, coalesce(next, {PROFILE} * (select count(*) from p where p.rid = o.rid)) runner from o where r = 1)
select h.doc_id, h.held_out, coalesce(z.lang, 'und') lang_pred, case when z.lang is null or runner = 0 then 0.0::double else least(1.0, greatest(0.0, 1 - s::double / runner)) end score from h left join z using (rid)
"""
