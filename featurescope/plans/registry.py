"""The registered queries of the diagnostics, each with the SQL that gives the same rows.

Queries run the library's operators on the shared tables; numbers are rounded to
six digits because sums depend on their order.  Queries without SQL (fitted
models, driver-side group dealing) are covered by tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescope.operators import audit as A
from featurescope.operators import bootstrap as R
from featurescope.operators import boundary as B
from featurescope.operators import cohort as K
from featurescope.operators import geometry as G
from featurescope.operators import graph as H
from featurescope.operators import neighbors as N
from featurescope.operators import probes as P
from featurescope.operators import scoring as S
from featurescope.operators import topology as T
from featurescope.runtime import materialise
from featurescope.sources.tables import embeddings, multilabel_documents, orders, parts, regression_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- common SQL

EMB = "e as (select vec_id row_id, embedding::double[] f, label, vec_id % 20 g from embeddings)"
ML = "e as (select d.doc_id row_id, [d.n_chars / 1000.0, (length(d.text) - length(replace(d.text, ' ', '')))::double]::double[] f, [l.quality, l.toxic] labels, d.source g from labels l join documents d using (doc_id))"
PART = "e as (select p_partkey row_id, [p_size::double, (p_partkey % 97)::double]::double[] f, p_retailprice::double y, p_partkey % 10 g from part)"


def NN(k: str, where: str = "a.row_id <> b.row_id") -> str:
    return f"nn as (select * from (select *, row_number() over (partition by row_id order by distance, neighbor_id) as rank from (select a.row_id, b.row_id neighbor_id, list_distance(a.f, b.f) distance from e a join e b on {where})) where rank <= {k})"


KN = "(select least(count(*) - 1, least(15, greatest(3, floor(sqrt(count(*)))::bigint))) from e)"
SINGLE = "c as (select n.row_id, b.label near, count(*) n, sum((b.label = a.label)::int) same, min(case when b.label <> a.label then distance end) enemy from nn n join e a on a.row_id = n.row_id join e b on b.row_id = n.neighbor_id group by all), r as (select row_id, -sum(p * ln(p)) / ln(greatest(2, (select count(distinct label) from e))) entropy, 1 - max(p) ambiguity, sum(same) / sum(n) same_share, min(enemy) enemy_distance from (select *, n / sum(n) over (partition by row_id) p from c) group by row_id)"
SINGLE_SUM = "select count(*) n_rows, round(avg(entropy), 6) mean_local_entropy, round(avg((entropy >= 0.5)::int), 6) high_entropy_fraction, round(avg(same_share), 6) same_class_neighbor_fraction, round(1 - avg(same_share), 6) cross_class_neighbor_fraction, round(avg(enemy_distance), 6) nearest_enemy_distance, round(avg(ambiguity), 6) mean_local_ambiguity from r"
JAC = "case when list_sum(list_transform(list_zip({a}, {b}), lambda z: greatest(z[1], z[2]))) = 0 then 1.0 else list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / list_sum(list_transform(list_zip({a}, {b}), lambda z: greatest(z[1], z[2])))::double end"
HAM = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] <> z[2])::int)) / len({a})::double"
MULTI = f"p as (select n.row_id, a.labels la, b.labels lb, {JAC.format(a='a.labels', b='b.labels')} j, {HAM.format(a='a.labels', b='b.labels')} h, list_sum(b.labels)::double c from nn n join e a on a.row_id = n.row_id join e b on b.row_id = n.neighbor_id), q as (select row_id, avg(case when v <= 0 or v >= 1 then 0.0 else -(v * log2(v) + (1 - v) * log2(1 - v)) end) entropy from (select row_id, i, avg(lb[i])::double v from p, unnest(range(1, 3)) t(i) group by row_id, i) group by row_id), r as (select row_id, avg(j) jaccard, avg(h) hamming, stddev_pop(c) cardinality_std, count(*) pairs, sum(j) sj, sum(h) sh, sum((j < 0.25)::int) low, sum((list_sum(la) + list_sum(lb) = 0)::int) void, any_value(entropy) entropy from p join q using (row_id) group by row_id)"


def hash_order(seed: int, col: str = "row_id") -> str:
    return f"md5('{seed}:' || {col})"


LABELS2 = "e as (select doc_id row_id, quality, toxic from labels join documents using (doc_id))"


# ---------------------------------------------------------------- validation, audits, groups


@query("select count(*) n_rows, 0::bigint n_bad, min(len(embedding))::int min_size, max(len(embedding))::int max_size, count(distinct vec_id) n_row_ids from embeddings")
def validate_features(spark, d):
    return K.feature_check(embeddings(spark, d))


@query("select label, (dense_rank() over (order by label) - 1)::int code, count(*) n from embeddings group by label")
def encode_labels(spark, d):
    return K.encoded(embeddings(spark, d)).groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"))


@query("select label, count(*) n, round(count(*) / sum(count(*)) over (), 6) proportion from embeddings group by label")
def class_audit(spark, d):
    return rounded(A.class_audit(embeddings(spark, d)))


@query(f"with {EMB}, c as (select count(*) n from e group by label), x as (select i, min(f[i]) lo, max(f[i]) hi from e, unnest(range(1, 65)) t(i) group by i) select sum(n)::bigint n_rows, count(*) n_classes, round(max(n) / greatest(min(n), 1), 6) imbalance, any_value(d) n_features, any_value(k) constant_feature_fraction, round(sum(n) * any_value(d) * 8 / 1048576.0, 6) dense_mb from c, (select count(*) d, round(avg((lo = hi)::int), 6) k from x)")
def audit_singlelabel(spark, d):
    return rounded(A.single_audit(embeddings(spark, d)))


@query("with e as (select quality, toxic, quality + toxic c from labels join documents using (doc_id)), n as (select count(*)::double n from e), p as (select sum(quality) p from e union all select sum(toxic) from e), s as (select p, n - p q, n from p, n) select (select n from n)::bigint n_rows, 2 n_labels, round(avg(c), 6) cardinality_mean, round(stddev_pop(c), 6) cardinality_std, round(avg((c = 0)::int), 6) all_zero_fraction, (select sum((p >= 2 and q >= 2)::int) from s)::bigint usable_labels, (select sum((p <= greatest(5, floor(n * 0.05)))::int) from s)::bigint rare_labels, (select sum((p = 0 or q = 0)::int) from s)::bigint constant_labels, (select min(p) from s)::bigint min_positives, (select quantile_cont(p::double, 0.5) from s) median_positives, (select max(p) from s)::bigint max_positives, round(avg(c) / 2, 6) density from e")
def audit_multilabel(spark, d):
    return rounded(A.multilabel_audit(multilabel_documents(spark, d).drop("group_id")))


@query("select * from (select 0 label_idx, sum(quality)::bigint positives from labels join documents using (doc_id) union all select 1, sum(toxic)::bigint from labels join documents using (doc_id)) where positives > 0")
def top_labels(spark, d):
    return A.top_labels(multilabel_documents(spark, d).drop("group_id"))


@query("with v as (select count(*) n, var_pop(l_extendedprice) v from lineitem union all select count(*), var_pop(l_quantity) from lineitem) select max(n) n_rows, count(*) n_targets, sum((v > 1e-12)::int)::bigint usable_targets, round(min(v), 3) min_variance, round(quantile_cont(v, 0.5), 3) median_variance, round(max(v), 3) max_variance, round(max(sqrt(v)) / min(sqrt(v)), 6) scale_ratio from v")
def audit_regression(spark, d):
    r = A.regression_audit(regression_lines(spark, d))
    return r.select(*(F.round(c, 3 if c.endswith("variance") else 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


@query("select 0 i, 1 j, round(corr(l_extendedprice, l_quantity), 6) corr from lineitem")
def target_correlations(spark, d):
    return rounded(A.target_correlations(regression_lines(spark, d)))


@query("select label, count(*) n_rows, count(distinct vec_id % 20) n_groups, count(distinct vec_id % 20) >= 2 evaluable from embeddings group by label")
def group_support(spark, d):
    return K.group_support(embeddings(spark, d))


@query("with g as (select count(*) n from labels join documents using (doc_id) group by source) select count(*) n_groups, min(n) min_size, quantile_cont(n::double, 0.5) median_size, max(n) max_size from g")
def group_summary(spark, d):
    return K.group_summary(multilabel_documents(spark, d))


@query("with x as (select source g, 0 i, quality v from labels join documents using (doc_id) union all select source, 1, toxic from labels join documents using (doc_id)), s as (select i label_idx, sum(v)::bigint positives, (count(*) - sum(v))::bigint negatives, count(distinct case when v = 1 then g end) positive_groups, count(distinct case when v = 0 then g end) negative_groups from x group by i) select *, positives >= 2 and negatives >= 2 and positive_groups >= 2 and negative_groups >= 2 usable from s")
def label_support(spark, d):
    return K.label_support(multilabel_documents(spark, d))


@query("select 0 target_idx, round(var_pop(l_extendedprice), 3) variance, round(avg(l_extendedprice), 6) mean, var_pop(l_extendedprice) > 1e-12 usable from lineitem union all select 1, round(var_pop(l_quantity), 3), round(avg(l_quantity), 6), var_pop(l_quantity) > 1e-12 from lineitem")
def target_support(spark, d):
    r = K.target_support(regression_lines(spark, d))
    return r.select("target_idx", F.round("variance", 3).alias("variance"), F.round("mean", 6).alias("mean"), "usable")


# ---------------------------------------------------------------- draws and folds


@query(f"select o_orderkey row_id from orders order by {hash_order(7, 'o_orderkey')}, o_orderkey limit 200")
def uniform_sample(spark, d):
    return K.uniform_sample(orders(spark, d), 200, 7).select("row_id")


@query(f"with c as (select o_orderpriority label, count(*) n from orders group by 1), b as (select *, least(n, greatest(2, floor(300 * (n / sum(n) over ()))))::bigint q from c), l as (select *, 300 - sum(q) over () lack, row_number() over (order by n - q desc, label) r from b), t as (select label, q + (r <= lack)::int q from l) select row_id, label from (select o_orderkey row_id, o_orderpriority label, row_number() over (partition by o_orderpriority order by {hash_order(7, 'o_orderkey')}, o_orderkey) k from orders) join t using (label) where k <= q")
def stratified_sample(spark, d):
    return K.stratified_sample(orders(spark, d), 300, 7).select("row_id", "label")


@query()
def whole_group_sample(spark, d):
    e = embeddings(spark, d)
    got = K.group_sample(e, 260, 7)
    return (e.where(F.lit(False)) if got is None else got).select("row_id", "group_id", "label")  # no rows, where no whole groups that keep every class fit


@query(f"with {LABELS2}, s as (select row_id, 0 i, quality v from e union all select row_id, 1, toxic from e), r as (select row_id, row_number() over (partition by i, v order by {hash_order(7, 'row_id')}, row_id) k from s), m as (select row_id, min(k) first from r where k <= 2 group by row_id) select e.* from e left join m using (row_id) order by first nulls last, {hash_order(7, 'row_id')}, row_id limit 100")
def multilabel_sample(spark, d):
    return K.multilabel_sample(multilabel_documents(spark, d), 100, 7).select("row_id", F.col("labels")[0].alias("quality"), F.col("labels")[1].alias("toxic"))


@query(f"select vec_id row_id, ((row_number() over (partition by label order by {hash_order(42, 'vec_id')}, vec_id) - 1) % 5)::int fold from embeddings")
def fold_plan_stratified(spark, d):
    return K.stratified_folds(embeddings(spark, d), 5, 42).select("row_id", "fold")


@query(f"select o_orderkey row_id, ((row_number() over (order by {hash_order(42, 'o_orderkey')}, o_orderkey) - 1) % 5)::int fold from orders")
def fold_plan_regression(spark, d):
    return K.row_folds(orders(spark, d), 5, 42).select("row_id", "fold")


@query(f"with {LABELS2}, s as (select i, v, count(*) n from (select 0 i, quality v from e union all select 1, toxic from e) group by all), o as (select i, v, row_number() over (order by n, i, v) k from s), r as (select row_id, least(a.k, b.k) x, greatest(a.k, b.k) y from e join o a on a.i = 0 and a.v = quality join o b on b.i = 1 and b.v = toxic) select row_id, ((row_number() over (order by x, y, {hash_order(42, 'row_id')}, row_id) - 1) % 3)::int fold from r")
def fold_plan_multilabel(spark, d):
    return K.multilabel_folds(multilabel_documents(spark, d), 3, 42).select("row_id", "fold")


@query(f"with g as (select distinct vec_id % 20 group_id from embeddings), r as (select group_id, row_number() over (order by {hash_order(5, 'group_id')}, group_id) k, count(*) over () n from g) select vec_id row_id, k <= least(n - 1, ceil(0.25 * n)) held from embeddings join r on group_id = vec_id % 20")
def group_holdout(spark, d):
    return K.group_holdout(embeddings(spark, d), 5).select("row_id", "held")


@query()
def fold_plan_grouped(spark, d):
    return K.group_folds(embeddings(spark, d), 5, 42).select("row_id", "group_id", "fold")


@query("with f as (select (row_number() over (partition by label order by md5('42:' || vec_id), vec_id) - 1) % 5 fold from embeddings), n as (select (select count(*) from f) - count(*) t from f group by fold) select (select count(*) from f) n_rows, min(t) min_train, quantile_cont(t::double, 0.5) median_train, round(avg(t), 6) mean_train, max(t) max_train from n")
def train_size_summary(spark, d):
    return rounded(K.train_sizes(K.stratified_folds(embeddings(spark, d), 5, 42)))


# ---------------------------------------------------------------- geometry


@query(f"with {EMB}, s as (select stddev_pop(f[i]) s from e, unnest(range(1, 65)) t(i) group by i) select round(max(s) / greatest(min(case when s > 0 then s end), 1e-9), 6) scale_range from s")
def geometry_scale_range(spark, d):
    return rounded(G.scale_range(embeddings(spark, d)))


@query(f"with {EMB}, s as (select * from e order by row_id limit 250), p as (select list_distance(a.f, b.f) d from s a join s b on a.row_id < b.row_id) select round((max(d) - min(d)) / greatest(avg(d), 1e-9), 6) concentration from p")
def geometry_distance_concentration(spark, d):
    return rounded(G.concentration(embeddings(spark, d)))


@query()
def geometry_pca(spark, d):
    p = G.spectrum(embeddings(spark, d))
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(p)], "component int, variance_share double")


# ---------------------------------------------------------------- neighbourhoods


@query(f"with {EMB}, {NN(KN)} select row_id, neighbor_id, rank::int rank, round(distance, 6) distance from nn")
def knn_edges(spark, d):
    e = embeddings(spark, d)
    return rounded(N.neighbors(e, N.default_k(e.count())).select("row_id", "neighbor_id", "rank", "distance"))


@query(f"with {EMB}, {NN(KN, 'a.g <> b.g')} select row_id, neighbor_id, rank::int rank, round(distance, 6) distance from nn")
def knn_edges_cross_group(spark, d):
    e = embeddings(spark, d)
    return rounded(N.neighbors(e, N.default_k(e.count()), other=F.col("group_id")).select("row_id", "neighbor_id", "rank", "distance"))


def _single(spark, d, cross: bool = False):
    e = embeddings(spark, d)
    edges = N.neighbors(e, N.default_k(e.count()), other=F.col("group_id") if cross else None)
    return N.single_rows(edges, e, e.select("label").distinct().count())


@query(f"with {EMB}, {NN(KN)}, {SINGLE} {SINGLE_SUM}")
def neighborhood_summary(spark, d):
    return rounded(N.single_summary(_single(spark, d)))


@query(f"with {EMB}, {NN(KN, 'a.g <> b.g')}, {SINGLE} {SINGLE_SUM}")
def neighborhood_cross_group(spark, d):
    return rounded(N.single_summary(_single(spark, d, cross=True)))


def _multi(spark, d):
    e = multilabel_documents(spark, d)
    return N.multilabel_rows(N.neighbors(e, N.default_k(e.count())), e)


@query(f"with {ML}, {NN(KN)}, {MULTI} select count(*) n_rows, round(sum(sj) / sum(pairs), 6) mean_neighbor_jaccard, round(sum(sh) / sum(pairs), 6) mean_neighbor_hamming, round(sum(low) / sum(pairs), 6) low_jaccard_fraction, round(avg(entropy), 6) mean_label_entropy, round(avg((entropy >= 0.5)::int), 6) high_entropy_fraction, round(avg(cardinality_std), 6) cardinality_local_std, round(sum(void) / sum(pairs), 6) all_zero_pair_fraction from r")
def neighborhood_multilabel(spark, d):
    return rounded(N.multilabel_summary(_multi(spark, d)))


TARGETS = "s as (select avg(y) m, stddev_pop(y) s from e), z as (select row_id, (y - m) / case when s > 1e-12 then s else 1 end z from e, s), t as (select n.row_id, avg(abs(a.z - b.z)) target_distance from nn n join z a on a.row_id = n.row_id join z b on b.row_id = n.neighbor_id group by n.row_id)"


@query(f"with {PART}, {NN(KN)}, {TARGETS}, w as (select greatest(sqrt(avg(z * z)), 1e-12) s from z) select count(*) n_rows, round(avg(target_distance), 6) mean_target_distance, round(avg(target_distance / s), 6) mean_normalized_distance, round(1 / (1 + avg(target_distance / s)), 6) smoothness, round(avg((target_distance / s >= 1)::int), 6) discontinuity_fraction from t, (select s from w)")
def neighborhood_regression(spark, d):
    e = parts(spark, d)
    z = N.standardised(e)
    edges = N.neighbors(e, N.default_k(e.count()), carry=z)
    return rounded(N.regression_summary(N.regression_rows(edges), e.select("row_id", z.alias("z"))))


# ---------------------------------------------------------------- boundary, graph, topology


@query(f"with {EMB}, {NN(KN)}, {SINGLE}, t as (select greatest(0.25, quantile_cont(entropy, 0.75)) te, greatest(0.33, quantile_cont(ambiguity, 0.75)) ta from r) select row_id, round(entropy, 9) > 0 and round(entropy, 9) >= round(te, 9) or round(ambiguity, 9) > 0 and round(ambiguity, 9) >= round(ta, 9) candidate from r, t")
def boundary_candidates(spark, d):
    r = _single(spark, d)
    return B.single_boundary(r.withColumn("entropy", F.round("entropy", 9)).withColumn("ambiguity", F.round("ambiguity", 9)))


@query(f"with {ML}, {NN(KN)}, {MULTI}, x as (select row_id, round(jaccard, 9) jaccard, round(hamming, 9) hamming, round(entropy, 9) entropy, round(cardinality_std, 9) cs from r), t as (select least(0.5, quantile_cont(jaccard, 0.25)) tj, greatest(0.1, quantile_cont(hamming, 0.75)) th, greatest(0.25, quantile_cont(entropy, 0.75)) te, greatest(0.5, quantile_cont(cs, 0.75)) tc from x), h as (select row_id, (jaccard < 1 and jaccard <= tj)::int + (hamming > 0 and hamming >= th)::int + (entropy > 0 and entropy >= te)::int + (cs > 0 and cs >= tc)::int n from x, t) select row_id, n n_triggers, n >= 1 candidate, n >= 2 strong from h")
def boundary_multilabel_triggers(spark, d):
    r = _multi(spark, d)
    for c in ("jaccard", "hamming", "entropy", "cardinality_std"):
        r = r.withColumn(c, F.round(c, 9))
    return B.multilabel_boundary(r).select("row_id", "n_triggers", "candidate", "strong")


GRAPH = "g as (select distinct least(row_id, neighbor_id) src, greatest(row_id, neighbor_id) dst from nn)"
REACH = "recursive w as (select row_id node, row_id reached from e union select w.node, case when g.src = w.reached then g.dst else g.src end from w join g on g.src = w.reached or g.dst = w.reached), comp as (select node row_id, min(reached) component from w group by node)"


@query(f"with {EMB}, {NN('10')}, {GRAPH} select * from g")
def graph_edges(spark, d):
    return H.knn_graph(embeddings(spark, d))


def _islands(spark, d):
    """Edges between nearest neighbours only: many components."""
    e = embeddings(spark, d)
    edges = materialise(H.knn_graph(e, k=1), "islands")
    return e, edges, H.graph_components(e, edges)


ISLANDS = f"with recursive {EMB}, {NN('1')}, {GRAPH}, {REACH.removeprefix('recursive ')}"


@query(f"{ISLANDS} select * from comp")
def graph_components(spark, d):
    return _islands(spark, d)[2]


@query(f"{ISLANDS}, s as (select count(*) n, count(*) / sum(count(*)) over () p from comp group by component), q as (select count(*) c, sum(n)::double n, max(p) l, -sum(p * ln(p)) / greatest(ln(greatest(2, count(*))), 1e-9) h, sum((n <= 3)::int)::bigint small from s) select c component_count, n::bigint n_rows, round(l, 6) largest_fraction, round(h, 6) size_entropy, small small_components, round(least(1, greatest(0, (1 - l + least(1, c / greatest(3, n / 20)) + h) / 3)), 6) fragmentation from q")
def graph_fragmentation(spark, d):
    return rounded(H.fragmentation(_islands(spark, d)[2]))


@query(f"with {EMB}, {NN('10')}, {GRAPH} select round(avg((a.label <> b.label)::int), 6) cross_class_edge_fraction from g join e a on a.row_id = src join e b on b.row_id = dst")
def graph_cross_class(spark, d):
    e = embeddings(spark, d)
    return rounded(H.cross_class_edges(H.knn_graph(e), e))


@query(f"with {ML}, {NN('10')}, {GRAPH}, j as (select {JAC.format(a='a.labels', b='b.labels')} j, {HAM.format(a='a.labels', b='b.labels')} h from g join e a on a.row_id = src join e b on b.row_id = dst) select round(avg(j), 6) mean_edge_jaccard, round(avg(h), 6) mean_edge_hamming, round(avg((j < 0.25)::int), 6) low_overlap_edge_fraction from j")
def graph_multilabel_edges(spark, d):
    e = multilabel_documents(spark, d)
    return rounded(H.multilabel_edges(H.knn_graph(e), e))


@query(f"with recursive {ML}, {NN('1')}, {GRAPH}, {REACH.removeprefix('recursive ')}, q as (select count(distinct labels) / count(*) d, var_pop(list_sum(labels)) v from comp join e using (row_id) group by component) select round(avg(d), 6) component_label_diversity, round(avg(v), 6) component_cardinality_variance from q")
def graph_multilabel_components(spark, d):
    e = multilabel_documents(spark, d)
    edges = materialise(H.knn_graph(e, k=1), "islands")
    return rounded(H.multilabel_components(H.graph_components(e, edges), e))


@query()
def graph_bootstrap(spark, d):
    return rounded(H.fragmentation_bootstrap(embeddings(spark, d), 3, 1))


@query(f"with {EMB}, {NN('10')} select a.row_id src, a.neighbor_id dst from nn a join nn b on a.row_id = b.neighbor_id and a.neighbor_id = b.row_id where a.row_id < a.neighbor_id")
def topology_mutual_graph(spark, d):
    return H.mutual_graph(embeddings(spark, d), 10)


@query(f"with {PART}, {NN(KN)}, {TARGETS}, q as (select row_id, round(target_distance, 9) target_distance from t), c as (select quantile_cont(target_distance, 0.75) c from q) select row_id from q, c where c > 1e-12 and target_distance >= c")
def hard_subset(spark, d):
    e = parts(spark, d)
    r = materialise(N.regression_rows(N.neighbors(e, N.default_k(e.count())), N.standardised_targets(e)), "target-distances")  # read twice
    return T.hard_subset(r.withColumn("target_distance", F.round("target_distance", 9)), "target_distance").select("row_id")


@query("with s as (select avg(p_retailprice) m, stddev_pop(p_retailprice) s from part) select p_partkey row_id, round(abs(p_retailprice - m) / s, 6) residual from part, s")
def residual_size(spark, d):
    e = parts(spark, d)
    mean = e.agg(F.array(F.avg(F.col("targets")[0])).alias("prediction"))
    return rounded(T.residual_size(e, e.select("row_id").crossJoin(F.broadcast(mean))))  # one row of means


def _cloud(spark, d):
    import numpy as np

    return np.array([r.features for r in K.uniform_sample(embeddings(spark, d), T.MOST_ROWS, 1).collect()])  # the operator's own cap


PRIM = "recursive e as (select row_number() over (order by vec_id) - 1 i, embedding::double[] f from (select * from embeddings order by md5('1:' || vec_id), vec_id limit 2000)), d as (select a.i, list(list_distance(a.f, b.f) order by b.i) dist from e a, e b group by a.i), p as (select 0::bigint step, 0::bigint here, (select list(case when i > 0 then 1e308 end order by i) from e) best, null::double life union all select step + 1, k - 1, list_transform(near, lambda x, j: case when j <> k then x end), near[k] from (select step, near, case when m is not null then list_position(near, m) end k from (select step, near, list_min(near) m from (select step, list_transform(list_zip(best, dist), lambda z: case when z[1] is not null then least(z[1], z[2]) end) near from p join d on d.i = p.here))) where k is not null), l as (select life from p where life is not null)"


@query(f"with {PRIM}, t as (select sum(life) t, median(life) m from l), r as (select max(f[c]) - min(f[c]) r from e, unnest(range(1, 65)) u(c) group by c) select count(case when life > m then 1 end)::int h0_count, round(any_value(t), 6) h0_total, round(-sum(case when life > 0 then life / t * ln(life / t) else 0 end), 6) h0_entropy, round((select avg(r) from r where r > 0), 6) as scale from l, t")
def topology_h0(spark, d):
    s = T.persistence_summary(_cloud(spark, d))
    return spark.createDataFrame([(s["h0_count"], round(s["h0_total"], 6), round(s["h0_entropy"], 6), round(s["scale"], 6))], "h0_count int, h0_total double, h0_entropy double, scale double")


@query()
def topology_h1(spark, d):
    s = T.persistence_summary(_cloud(spark, d))
    return spark.createDataFrame([(s["h1_count"], s["h1_rows"], *(round(s[c], 6) for c in ("h1_total", "h1_longest", "h1_relative", "persistence_entropy", "strength")))], "h1_count int, h1_rows int, h1_total double, h1_longest double, h1_relative double, persistence_entropy double, strength double")


# ---------------------------------------------------------------- probes and scores


def _folded(spark, d):
    return materialise(K.encoded(K.stratified_folds(embeddings(spark, d), 5, 42)).withColumn("y", F.array(F.col("code").cast("double"))), "folded")


def _probe(spark, d, *names):
    f = _folded(spark, d)
    return P.out_of_fold(f, P.ProbeSettings("singlelabel", N.default_k(f.count()), 1), names)


FOLDED = "e as (select vec_id row_id, embedding::double[] f, dense_rank() over (order by label) - 1 y, (row_number() over (partition by label order by md5('42:' || vec_id), vec_id) - 1) % 5 fold from embeddings)"


@query(f"with {FOLDED}, h as (select distinct fold from e), c as (select h.fold, y, count(*) n from h join e on e.fold <> h.fold group by all), m as (select fold, y p from (select *, row_number() over (partition by fold order by n desc, y) r from c) where r = 1) select e.row_id, e.fold::int fold, 'dummy' probe, y::int y, p::int prediction from e join m using (fold)")
def probe_dummy(spark, d):
    return _flat(_probe(spark, d, "dummy"))


def _flat(p: DataFrame) -> DataFrame:
    return p.select("row_id", "fold", "probe", F.col("y")[0].cast("int").alias("y"), F.col("prediction")[0].cast("int").alias("prediction"))


@query(f"with {FOLDED}, h as (select distinct fold from e), s as (select h.fold, i, avg(f[i]) m, stddev_pop(f[i]) s from h join e on e.fold <> h.fold, unnest(range(1, 65)) t(i) group by h.fold, i), v as (select fold, list(m order by i) m, list(case when s > 0 then s else 1 end order by i) s from s group by fold), x as (select e.row_id, e.fold own, e.y, v.fold held, list_transform(list_zip(f, m, s), lambda z: (z[1] - z[2]) / z[3]) z from e, v), nn as (select a.row_id, a.own fold, a.y, b.y near, row_number() over (partition by a.row_id order by list_distance(a.z, b.z), b.row_id) r from x a join x b on a.held = a.own and b.held = a.held and b.own <> a.own), k as (select row_id, fold, y, near, count(*) n from nn where r <= {KN} group by all), w as (select *, row_number() over (partition by row_id order by n desc, near) r from k) select row_id, fold::int fold, 'knn' probe, y::int y, near::int prediction from w where r = 1")
def probe_knn(spark, d):
    return _flat(_probe(spark, d, "knn"))


@query()
def probe_linear(spark, d):
    return _flat(_probe(spark, d, "linear"))


@query()
def probe_quadratic(spark, d):
    f = materialise(K.encoded(K.stratified_folds(embeddings(spark, d), 3, 42)).withColumn("y", F.array(F.col("code").cast("double"))), "folded")
    return _flat(P.out_of_fold(f, P.ProbeSettings("singlelabel", 15, 1), ("smooth_poly",)))


@query()
def probe_rbf(spark, d):
    f = materialise(K.encoded(K.stratified_folds(embeddings(spark, d), 3, 42)).withColumn("y", F.array(F.col("code").cast("double"))), "folded")
    return _flat(P.out_of_fold(f, P.ProbeSettings("singlelabel", 15, 1), ("kernel_approx",)))


RIDGE = "o as (select *, (row_number() over (order by md5('42:' || row_id), row_id) - 1) % 5 fold from e), h as (select distinct fold held from o), t as (select held, f[1] a, f[2] b, y from h join o on fold <> held), m as (select held, avg(a) ma, coalesce(nullif(stddev_pop(a), 0), 1) sa, avg(b) mb, coalesce(nullif(stddev_pop(b), 0), 1) sb, avg(y) my from t group by held), z as (select held, (a - ma) / sa a, (b - mb) / sb b, y - my y from t join m using (held)), n as (select held, sum(a * a) + 1 aa, sum(a * b) ab, sum(b * b) + 1 bb, sum(a * y) ay, sum(b * y) yb from z group by held), w as (select held, (ay * bb - yb * ab) / (aa * bb - ab * ab) wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) wb from n)"


@query(f"with {PART}, {RIDGE} select row_id, fold::int fold, round(y, 4) y, round(my + (f[1] - ma) / sa * wa + (f[2] - mb) / sb * wb, 4) prediction from o join m on m.held = fold join w on w.held = fold")
def probe_ridge(spark, d):
    f = materialise(K.row_folds(parts(spark, d), 5, 42).withColumn("y", F.col("targets")), "folded")
    p = P.out_of_fold(f, P.ProbeSettings("regression", 15, 1), ("linear",))
    return p.select("row_id", "fold", F.round(F.col("y")[0], 4).alias("y"), F.round(F.col("prediction")[0], 4).alias("prediction"))


def _copied(df: DataFrame, column: str) -> DataFrame:
    """Predictions that copy the nearest row's value."""
    value = F.array(F.col(column)) if column == "label" else F.col(column)
    e = N.neighbors(df, 1, carry=value.cast("array<double>"))
    return e.select("row_id", F.lit("copy").alias("probe"), F.col("own").alias("y"), F.col("near").alias("prediction"))


PAIR = "p as (select n.row_id, a.{c} y, b.{c} q from nn n join e a on a.row_id = n.row_id join e b on b.row_id = n.neighbor_id)"


@query(f"with {EMB}, {NN('1')}, {PAIR.format(c='label')}, t as (select y c, count(*) s, sum((y = q)::int) tp from p group by y), u as (select q c, count(*) n from p group by q), j as (select coalesce(s, 0) s, coalesce(tp, 0) tp, coalesce(n, 0) n from t full join u using (c)) select 'copy' probe, round(avg(case when s > 0 then tp / s end), 6) balanced_accuracy, round(sum(tp) / sum(s), 6) accuracy, round(avg(case when s + n > 0 then 2 * tp / (s + n) else 0 end), 6) macro_f1 from j")
def score_singlelabel(spark, d):
    return rounded(S.single_scores(S.confusion(_copied(embeddings(spark, d), "label"), "probe"), "probe"))


@query(f"with {EMB}, {NN('1')}, {PAIR.format(c='label')} select 'copy' probe, y, q p, count(*) n, row_number() over (order by count(*) desc, y, q)::int as rank from p where y <> q group by y, q qualify row_number() over (order by count(*) desc, y, q) <= 3")
def score_confused_pairs(spark, d):
    c = S.confusion(_copied(embeddings(spark, d), "label"), "probe")
    return S.confused_pairs(c, "probe").select("probe", "y", "p", F.col("n").cast("long").alias("n"), "rank")


LABEL_COUNTS = "l as (select i label_idx, sum((y[i + 1] = 1 and q[i + 1] = 1)::int)::double tp, sum((y[i + 1] = 0 and q[i + 1] = 1)::int)::double fp, sum((y[i + 1] = 1 and q[i + 1] = 0)::int)::double fn, sum((y[i + 1] = 0 and q[i + 1] = 0)::int)::double tn from p, unnest(range(0, 2)) t(i) group by i)"


@query(f"with {ML}, {NN('1')}, {PAIR.format(c='labels')}, {LABEL_COUNTS}, m as (select 2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) mi, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) ma, sum(fp + fn) / sum(tp + fp + fn + tn) h from l) select 'copy' probe, round(any_value(mi), 6) micro_f1, round(any_value(ma), 6) macro_f1, round(any_value(h), 6) hamming_loss, round(avg({JAC.format(a='y', b='q')}), 6) sample_jaccard, round(avg(coalesce(2 * list_sum(list_transform(list_zip(y, q), lambda z: z[1] * z[2])) / nullif((list_sum(y) + list_sum(q))::double, 0), 0)), 6) sample_f1, round(avg((y = q)::int), 6) subset_accuracy from p, m")
def score_multilabel(spark, d):
    return rounded(S.multilabel_scores(_copied(multilabel_documents(spark, d), "labels"), "probe"))


@query(f"with {ML}, {NN('1')}, {PAIR.format(c='labels')}, {LABEL_COUNTS} select label_idx::int label_idx, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) balanced_accuracy, round((tp + fn) / (tp + fp + fn + tn), 6) prevalence, tp + fn positives, tp + fp + fn + tn n from l")
def score_per_label(spark, d):
    return rounded(S.label_scores(S.label_counts(_copied(multilabel_documents(spark, d), "labels"))))


@query(f"with {ML}, {NN('1')}, {PAIR.format(c='labels')}, {LABEL_COUNTS}, f as (select coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) f1, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 bal, tp + fn pos, tp + fp + fn + tn n from l) select round(avg(f1), 6) per_label_f1_mean, round(quantile_cont(f1, 0.5), 6) per_label_f1_median, round(quantile_cont(f1, 0.1), 6) per_label_f1_p10, round(avg(case when pos <= greatest(5, floor(n * 0.05)) then f1 end), 6) rare_label_f1_mean, round(avg(case when pos > 0 and pos < n then bal end), 6) label_balanced_accuracy_macro from f")
def score_label_summary(spark, d):
    return rounded(S.label_summary(S.label_scores(S.label_counts(_copied(multilabel_documents(spark, d), "labels")))))


@query(f"with {PART}, {NN('1')}, {PAIR.format(c='y')} select 0 target_idx, round(var_pop(y), 2) variance, round(1 - avg((y - q) ** 2) / var_pop(y), 6) r2, round(sqrt(avg((y - q) ** 2) / var_pop(y)), 6) nrmse from p")
def score_per_target(spark, d):
    r = S.target_scores(_copied(parts(spark, d), "targets"))
    return r.select("target_idx", F.round("variance", 2).alias("variance"), F.round("r2", 6).alias("r2"), F.round("nrmse", 6).alias("nrmse"))


@query(f"with {PART}, {NN('1')}, {PAIR.format(c='y')}, s as (select sum((y - q) ** 2) sse, sum((y - (select avg(y) from e)) ** 2) sst from p) select 'copy' probe, round(1 - sse / sst, 6) r2_variance_weighted, round(1 - sse / sst, 6) r2_uniform_average, round(sqrt(sse / sst), 6) nrmse from s")
def score_regression(spark, d):
    return rounded(S.regression_scores(_copied(parts(spark, d), "targets"), "probe"))


# ---------------------------------------------------------------- bootstrap, decision

DRAWS = "u as (select vec_id row_id, label::varchar s, row_number() over (partition by label order by md5('3:' || vec_id), vec_id) as rank, count(*) over (partition by label) n from embeddings), k as (select b, s, floor(('0x' || substr(md5('3:' || b || ':' || s || ':' || rank), 1, 8))::bigint / 4294967296.0 * n)::bigint + 1 as rank from u, unnest(range(0, 20)) t(b)), w as (select b, row_id, count(*) w from k join u using (s, rank) group by all)"


@query(f"with {DRAWS} select b::int b, row_id, w from w")
def bootstrap_weights(spark, d):
    return R.weights(embeddings(spark, d), 20, 3, strata="label")


def _two(spark, d):
    """Predictions of two rules: copy the nearest row, or always class 0."""
    p = _copied(embeddings(spark, d), "label")
    return materialise(p.unionByName(p.withColumn("probe", F.lit("zero")).withColumn("prediction", F.array(F.lit(0.0)))), "two-rules")


@query(f"with {EMB}, {NN('1')}, {PAIR.format(c='label')}, {DRAWS}, a as (select row_id, 'copy' probe, y, q from p union all select row_id, 'zero', y, 0 from p), r as (select b, probe, y, sum(w * (y = q)::int) / sum(w) r from w join a using (row_id) group by all), s as (select b, probe, avg(r) s from r group by all), pt as (select probe, avg(r) s from (select probe, y, avg((y = q)::int) r from a group by all) group by probe), d as (select x.b, x.s - y.s d from s x join s y using (b) where x.probe = 'copy' and y.probe = 'zero') select 'copy' \"first\", 'zero' \"second\", 'balanced_accuracy' metric, round((select s from pt where probe = 'copy') - (select s from pt where probe = 'zero'), 6) point_delta, round(avg(d), 6) mean_delta, round(stddev_samp(d), 6) paired_standard_error, round(quantile_cont(d, 0.025), 6) lower_95, round(quantile_cont(d, 0.975), 6) upper_95, count(*) resamples from d")
def bootstrap_paired_deltas(spark, d):
    p = _two(spark, d)
    cache = R.complete(R.resampled_scores(p, R.weights(embeddings(spark, d), 20, 3, strata="label"), "singlelabel"), 2, 1)
    points = S.single_scores(S.confusion(p, "probe"), "probe").select("probe", F.lit("balanced_accuracy").alias("metric"), F.col("balanced_accuracy").alias("score"))
    return rounded(R.paired_deltas(cache, points))


@query()
def diagnose_report(spark, d):
    from .profiler import diagnose

    r = diagnose(embeddings(spark, d), return_report=True, random_state=0)
    return spark.createDataFrame([(r.recommendation, r.confidence, r.to_json(terse=True))], "recommendation string, confidence string, report string")
