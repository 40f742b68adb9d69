"""Operator 3: URL filter by rules and a character language-model ratio (DataFrame functions only).

Rules ``(host, path prefix, action)`` fit a host, all its subdomains and every
path that starts with theirs; the longest fitting rule decides.  All other URLs
are judged by two smoothed variable-order Markov models over the characters of
host, path and query, one of the URLs that rules allow and one of those they
block: Witten-Bell smoothing mixes each context of ``ORDER`` characters with all
shorter ones down to the uniform distribution.  The score of a URL is the mean,
over its characters, of the log ratio of both models.

A share of the rule-judged URLs (``HELD_BACK``, by hash) is not counted but
calibrates the threshold: the cut, between steps of 0.01, with the best balanced
accuracy.

One pass counts n-grams (combined before the shuffle); the models are built over
the distinct n-grams bottom-up, so a context is stored once for both; scoring is
one join by n-gram, whose skew AQE splits.  The characters of a URL carry its
16-byte digest, not the URL, so a long one costs no more than its length.

Defined cases: a null URL, or one without ``://``, has empty host and path and
is scored as an empty string; if no URL is allowed or none is blocked the
threshold is 0 and the models are uniform where they saw nothing; scores at the
threshold are allowed; rows that repeat are judged each; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featurescope.runtime import materialise

from .common import table

ORDER = 3
SYMBOLS = 256.0
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
HELD_BACK = "substring(md5(coalesce(url, '')), 1, 1) in ('0', '1', '2')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path, the characters that the models read (``chars``) and their digest (``url_key``)."""
    at = F.coalesce(F.locate("://", F.col("url")), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    out = pages.withColumn("_rest", rest)
    raw = F.regexp_extract("_rest", "^[^/?#]*", 0)
    out = out.withColumn("host", _lower(raw))
    out = out.withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(host) + 1)"), "^[^?#]*", 0))
    return out.withColumn("chars", _lower(F.regexp_extract("_rest", "^[^#]*", 0))).withColumn("url_key", F.unhex(F.md5("chars"))).drop("_rest")


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` (host and path of the longest fitting rule, or null) and ``action``."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, act in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later branches are tried first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return pages.withColumn("rule", rule).withColumn("action", action)


def grams(order: int = ORDER) -> Column:
    """All (order + 1)-grams of ``chars`` between start and end marks, one per character."""
    padded = F.concat(F.lit("\x02" * order), F.col("chars"), F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length("chars") + 1), lambda i: padded.substr(i, F.lit(order + 1)))


def model(judged: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, llr: the log ratio of the accepted to the rejected model, for every n-gram of ``judged`` (chars, action, counted)."""
    one = judged.select(F.explode(grams(order)).alias("gram"), (F.col("counted") & (F.col("action") == "allow")).cast("long").alias("a"), (F.col("counted") & (F.col("action") == "block")).cast("long").alias("b"))
    total = materialise(one.groupBy("gram").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")), "url-grams")
    below = None
    for j in range(order + 1):
        size = j + 1
        own = total.select(F.expr(f"right(gram, {size})").alias("gram"), "a", "b")
        if j < order:
            own = own.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        own = own.withColumn("ctx", F.expr(f"left(gram, {j})"))
        ctx = own.groupBy("ctx").agg(*(f(x) for x in "ab" for f in (lambda x: F.sum(x).alias(f"n{x}"), lambda x: F.sum((F.col(x) > 0).cast("long")).alias(f"t{x}"))))
        own = own.join(ctx, "ctx")
        if below is None:
            own = own.withColumn("pa", F.lit(1 / SYMBOLS)).withColumn("pb", F.lit(1 / SYMBOLS))
        else:
            own = own.withColumn("shorter", F.expr(f"right(gram, {j})")).join(below, "shorter")
        for x in "ab":  # Witten-Bell
            n, t = F.col(f"n{x}"), F.col(f"t{x}")
            own = own.withColumn(f"p{x}", F.when(n > 0, (F.col(x) + t * F.col(f"p{x}")) / (n + t)).otherwise(F.col(f"p{x}")))
        below = own.select(F.col("gram").alias("shorter"), "pa", "pb")
    return below.select(F.col("shorter").alias("gram"), (F.log("pa") - F.log("pb")).alias("llr"))


def scored(rows: DataFrame, ratios: DataFrame, key: list[str], order: int = ORDER) -> DataFrame:
    """``key`` columns and the mean log ratio of each row's characters."""
    each = rows.select(*key, F.explode(grams(order)).alias("gram")).join(ratios, "gram")
    return each.groupBy(*key).agg(F.avg("llr").alias("score"))


def calibrated(held: DataFrame) -> float:
    """The cut (score, action) with the best balanced accuracy; 0 unless both actions occur."""
    steps = held.groupBy(F.floor(F.col("score") * 100).cast("long").alias("step")).agg(F.sum((F.col("action") == "allow").cast("long")).alias("a"), F.sum((F.col("action") == "block").cast("long")).alias("b"))
    steps = steps.withColumn("step", F.greatest(F.least("step", F.lit(2000)), F.lit(-2000))).groupBy("step").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))  # at most 4001 rows
    all_, up = Window.partitionBy(), Window.orderBy(F.desc("step"))
    # the cut lies in the middle between the step and the next lower one that has URLs
    rate = steps.select("step", F.coalesce((F.col("step") + F.lead("step").over(up) + 1) / 2, F.col("step").cast("double")).alias("cut"), (F.sum("a").over(up) / F.sum("a").over(all_) + 1 - F.sum("b").over(up) / F.sum("b").over(all_)).alias("acc"))
    best = rate.where("acc is not null").orderBy(F.desc(F.round("acc", 9)), F.abs("step"), "step").limit(1).collect()
    return best[0].cut / 100 if best else 0.0


def judge(pages: DataFrame, *, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) for every row of ``pages`` (page_id, url)."""
    # one score per distinct string that the models read: copies and hot URLs are scored once
    all_ = with_rules(parsed(pages.select("page_id", "url")), rules)
    ruled = all_.where("action is not null").select("chars", "url_key", "action", F.expr(HELD_BACK).alias("held"))
    free = all_.where("action is null")
    judged = ruled.select("chars", "action", (~F.col("held")).alias("counted")).unionByName(free.select("chars", F.lit(None).cast("string").alias("action"), F.lit(False).alias("counted")))
    ratios = materialise(model(judged, order), "url-model")
    known = ruled.where("held").select("url_key", "action").distinct()
    wanted = ruled.where("held").select("url_key", "chars").union(free.select("url_key", "chars")).groupBy("url_key").agg(F.min("chars").alias("chars"))
    scores = materialise(scored(wanted, ratios, ["url_key"], order), "url-scores")
    held = known.join(scores, "url_key")
    cut = calibrated(held)
    seen = all_.where("action is not null").select("page_id", "host", "path", "rule", F.col("action").alias("verdict"), F.lit(None).cast("double").alias("score"))
    rest = free.join(scores, "url_key", "left").select("page_id", "host", "path", "rule", F.when(F.coalesce("score", F.lit(0.0)) >= cut, "allow").otherwise("block").alias("verdict"), "score")
    return seen.unionByName(rest)


def op3_url_lm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    levels = []
    for j in range(ORDER + 1):
        prior = f"1 / {SYMBOLS}" if j == 0 else None
        pa, pb = (prior, prior) if prior else ("s.pa", "s.pb")
        join = "" if j == 0 else f" join p{j - 1} s on s.gram = right(o.gram, {j})"
        levels.append(
            f"o{j} as (select right(gram, {j + 1}) gram, left(right(gram, {j + 1}), {j}) ctx, sum(a) a, sum(b) b from t group by all), "
            f"c{j} as (select ctx, sum(a) na, sum(b) nb, sum((a > 0)::int) ta, sum((b > 0)::int) tb from o{j} group by ctx), "
            f"p{j} as (select o.gram, case when na > 0 then (a + ta * {pa}) / (na + ta) else {pa} end pa, case when nb > 0 then (b + tb * {pb}) / (nb + tb) else {pb} end pb from o{j} o join c{j} c on o.ctx = c.ctx{join})"
        )
    rule = "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) + " end"
    action = "case rule " + " ".join(f"when '{h}{p}' then '{a}'" for h, p, a in RULES) + " end"
    pad = f"repeat(chr(2), {ORDER})"
    return f"""
with u as (select page_id, url, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end rest from pages),
h as (select page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') host from u),
q as (select page_id, url, host, regexp_extract(substring(rest, length(host) + 1), '^[^?#]*') path, translate(regexp_extract(rest, '^[^#]*'), '{_UPPER}', '{_LOWER}') chars from h),
r as (select *, {rule} as rule from q),
j as (select *, {action} as action, {HELD_BACK} as held from r),
e as (select *, unnest(range(1, length(chars) + 2)) i from j),
g as (select *, substring({pad} || chars || chr(3), i, {ORDER + 1}) gram from e),
t as (select gram, sum((not held and coalesce(action, '') = 'allow')::int) a, sum((not held and coalesce(action, '') = 'block')::int) b from g where action is null or not held or held group by gram),
{", ".join(levels)},
s as (select page_id, any_value(action) action, any_value(held) held, avg(ln(pa) - ln(pb)) score from g join p{ORDER} using (gram) group by page_id),
k as (select least(greatest(floor(score * 100), -2000), 2000) step, sum((action = 'allow')::int) a, sum((action = 'block')::int) b from (select distinct chars, j.action, s.score from j join s using (page_id) where j.held and j.action is not null) group by 1),
w as (select step, coalesce((step + lead(step) over (order by step desc) + 1) / 2, step) mid, sum(a) over (order by step desc) / (select sum(a) from k) + 1 - sum(b) over (order by step desc) / (select sum(b) from k) acc from k),
c as (select coalesce((select mid / 100 from w where acc is not null and not isnan(acc) order by round(acc, 9) desc, abs(step), step limit 1), 0.0) cut)
select page_id, host, path, rule, coalesce(action, case when (select score from s where s.page_id = j.page_id) >= (select cut from c) then 'allow' else 'block' end) verdict from j
"""


ORACLE_SQL = _oracle()
