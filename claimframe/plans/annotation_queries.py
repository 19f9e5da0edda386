"""Queries over the annotation store: verdicts, agreement, rungs and contradictions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import lexicon as L
from ..functions import text as T
from ..operators import claims, joins, reports, rules
from .session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """The last verdict of each annotator on an image's text: verdicts in one spelling, keys in canonical form."""
    a = load(spark, d, "annotations").where("annotator IS NOT NULL AND image_id IS NOT NULL AND text_vi IS NOT NULL")
    a = a.select("label_id", "annotator", "image_id", "prop_type", "split", F.lower("text_vi").alias("claim"), T.verdict_name(F.col("verdict")).alias("verdict"), "reject_reason", "added_utc").where("verdict IS NOT NULL")
    last = F.struct("added_utc", "label_id")
    return a.groupBy("annotator", "image_id", "claim").agg(F.max_by("verdict", last).alias("verdict"), F.min("label_id").alias("label_id"), F.min("prop_type").alias("prop_type"))


_V = "nullif(nullif(nullif(upper(trim(string_split(trim(verdict, ' '), '.')[-1], ' ')), ''), 'NONE'), 'NULL')"
_CLAIMS = f"""WITH a AS (SELECT label_id, annotator, image_id, prop_type, lower(text_vi) AS claim, {_V} AS verdict, added_utc FROM annotations WHERE annotator IS NOT NULL AND image_id IS NOT NULL AND text_vi IS NOT NULL),
claims AS (SELECT annotator, image_id, claim, arg_max(verdict, epoch_us(added_utc)::HUGEINT * 100000000000 + label_id) AS verdict, min(label_id) AS label_id, min(prop_type) AS prop_type FROM a WHERE verdict IS NOT NULL GROUP BY annotator, image_id, claim)
"""


@query(f"SELECT {_V} AS verdict_name, count(*) AS n FROM annotations GROUP BY 1")
def verdict_histogram(spark, d):
    return load(spark, d, "annotations").groupBy(T.verdict_name(F.col("verdict")).alias("verdict_name")).agg(F.count("*").alias("n"))


@query(_CLAIMS + "SELECT annotator, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (verdict = 'REJECTED') AS rejected FROM claims GROUP BY annotator")
def verdict_by_annotator(spark, d):
    g = _claims(spark, d).groupBy("annotator").agg(*[F.count_if(F.col("verdict") == v.upper()).alias(v) for v in ("supported", "uncertain", "rejected")])
    return g


@query(_CLAIMS + "SELECT image_id, count(*) AS n FROM claims WHERE verdict = 'SUPPORTED' GROUP BY image_id HAVING count(*) >= 3")
def min_supported_gate(spark, d):
    return _claims(spark, d).where("verdict = 'SUPPORTED'").groupBy("image_id").agg(F.count("*").alias("n")).where("n >= 3")


@query(
    _CLAIMS
    + """, i AS (SELECT image_id, count(*) FILTER (verdict = 'SUPPORTED') AS n FROM claims GROUP BY image_id)
SELECT round(avg(n), 6) AS mean, (list(n ORDER BY n))[CAST(count(*) // 2 AS BIGINT) + 1] AS upper_median, count(*) FILTER (n = 0) AS zero, count(*) AS images FROM i"""
)
def supported_per_image(spark, d):
    i = _claims(spark, d).groupBy("image_id").agg(F.count_if(F.col("verdict") == "SUPPORTED").alias("n"))
    # the upper median from the histogram of counts, which is short however many images there are
    h = i.groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy("n")
    c = h.withColumns({"hi": F.sum("k").over(w), "all": F.sum("k").over(Window.partitionBy())})
    at = F.floor(F.col("all") / 2) + 1
    return c.agg(F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 6).alias("mean"), F.min(F.when(F.col("hi") >= at, F.col("n"))).alias("upper_median"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("k"))), F.lit(0)).alias("zero"), F.sum("k").alias("images"))


def _label_pairs(spark, d):
    c = _claims(spark, d)
    b = c.select(F.col("annotator").alias("annotator_b"), "image_id", "claim", F.col("verdict").alias("verdict_b"))
    j = c.select(F.col("annotator").alias("annotator_a"), "image_id", "claim", F.col("verdict").alias("verdict_a"), "prop_type").join(b, ["image_id", "claim"])
    return j.where("annotator_a < annotator_b")


_PAIRS = _CLAIMS + ", pairs AS (SELECT a.annotator AS annotator_a, b.annotator AS annotator_b, a.verdict AS verdict_a, b.verdict AS verdict_b, a.prop_type FROM claims a JOIN claims b ON a.image_id = b.image_id AND a.claim = b.claim AND a.annotator < b.annotator)\n"


def _kappa_sql(by: str, least: int) -> str:
    part, join = (f"{by}, " if by else ""), (f"USING ({by})" if by else "ON true")
    return (
        _PAIRS
        + f""", t AS (SELECT {part}count(*) AS n_pairs, count(*) FILTER (verdict_a = verdict_b) AS n_agree FROM pairs {"GROUP BY " + by if by else ""}),
m AS (SELECT {part}sum(na * nb) AS chance FROM (SELECT {part}verdict_a AS v, count(*) AS na FROM pairs GROUP BY {part}verdict_a) JOIN (SELECT {part}verdict_b AS v, count(*) AS nb FROM pairs GROUP BY {part}verdict_b) USING ({part}v) {"GROUP BY " + by if by else ""})
SELECT {part}n_pairs, round(n_agree * 1.0 / n_pairs, 6) AS agreement, round(CASE WHEN coalesce(chance, 0) * 1.0 / (n_pairs * n_pairs) < 1 THEN (n_agree * 1.0 / n_pairs - coalesce(chance, 0) * 1.0 / (n_pairs * n_pairs)) / (1 - coalesce(chance, 0) * 1.0 / (n_pairs * n_pairs)) END, 6) AS kappa FROM t LEFT JOIN m {join} WHERE n_pairs >= {least}"""
    )


@query(_kappa_sql("", 1))
def kappa(spark, d):
    return reports.kappa(_label_pairs(spark, d), "verdict_a", "verdict_b", [])


@query(_kappa_sql("prop_type", 10))
def kappa_by_type(spark, d):
    return reports.kappa(_label_pairs(spark, d), "verdict_a", "verdict_b", ["prop_type"], 10)


@query(_kappa_sql("annotator_a, annotator_b", 10))
def kappa_by_pair(spark, d):
    return reports.kappa(_label_pairs(spark, d), "verdict_a", "verdict_b", ["annotator_a", "annotator_b"], 10)


_MACHINE = _CLAIMS + ", machine AS (SELECT * FROM claims WHERE annotator = 'gv04'), human AS (SELECT image_id, claim, arg_max(verdict, label_id) AS verdict FROM claims WHERE annotator <> 'gv04' GROUP BY image_id, claim)\n"


def _machine_human(spark, d):
    c = _claims(spark, d)
    m = c.where("annotator = 'gv04'").select("image_id", "claim", F.col("verdict").alias("machine"))
    h = c.where("annotator <> 'gv04'").groupBy("image_id", "claim").agg(F.max_by("verdict", "label_id").alias("human"))
    return m, h


@query(_MACHINE + "SELECT m.verdict AS machine, count(*) FILTER (h.verdict = 'SUPPORTED') AS supported, count(*) FILTER (h.verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (h.verdict = 'REJECTED') AS rejected FROM machine m JOIN human h USING (image_id, claim) GROUP BY 1")
def confusion_pivot(spark, d):
    """The busiest annotator, in the role of the machine, against the others' last verdicts."""
    m, h = _machine_human(spark, d)
    p = m.join(h, ["image_id", "claim"]).groupBy("machine").pivot("human", list(L.VERDICT_RANK)).agg(F.count(F.lit(1)))
    return p.select("machine", *[F.coalesce(v, F.lit(0)).alias(v.lower()) for v in ("SUPPORTED", "UNCERTAIN", "REJECTED")])


@query(_MACHINE + "SELECT count(*) AS shared, round(count(*) FILTER (m.verdict = h.verdict) * 1.0 / count(*), 6) AS agreement, round(count(*) FILTER (m.verdict = 'SUPPORTED' AND h.verdict = 'REJECTED') * 1.0 / nullif(count(*) FILTER (m.verdict = 'SUPPORTED'), 0), 6) AS dangerous_rate FROM machine m JOIN human h USING (image_id, claim)")
def machine_vs_human(spark, d):
    m, h = _machine_human(spark, d)
    g = m.join(h, ["image_id", "claim"]).agg(F.count("*").alias("shared"), F.count_if(F.col("machine") == F.col("human")).alias("same"), F.count_if((F.col("machine") == "SUPPORTED") & (F.col("human") == "REJECTED")).alias("danger"), F.count_if(F.col("machine") == "SUPPORTED").alias("s"))
    return g.select("shared", reports.rate(F.col("same"), F.col("shared")).alias("agreement"), reports.rate(F.col("danger"), F.col("s")).alias("dangerous_rate"))


@query(_MACHINE + "SELECT count(*) FILTER (m.claim IS NOT NULL AND h.claim IS NOT NULL) AS shared, count(*) FILTER (h.claim IS NULL) AS only_a, count(*) FILTER (m.claim IS NULL) AS only_b FROM (SELECT DISTINCT image_id, claim FROM machine) m FULL OUTER JOIN human h ON m.image_id = h.image_id AND m.claim = h.claim")
def full_outer_accounting(spark, d):
    m, h = _machine_human(spark, d)
    return joins.accounting(m, h, ["image_id", "claim"])


@query(f"SELECT coalesce(reject_reason, 'none') AS reason, prop_type, count(*) AS n FROM annotations WHERE {_V} = 'REJECTED' GROUP BY 1, 2")
def reject_reasons(spark, d):
    a = load(spark, d, "annotations").where(T.verdict_name(F.col("verdict")) == "REJECTED")
    return a.groupBy(F.coalesce("reject_reason", F.lit("none")).alias("reason"), "prop_type").agg(F.count("*").alias("n"))


_CLAUSE = rf"(?:{'|'.join(L.CLAUSE_QUANTIFIERS)})\s+(?:\S+\s+){{1,6}}?(?:{'|'.join(L.CLAUSE_ASPECTS)})\s"


@query(
    rf"""WITH t AS (SELECT label_id, image_id, text_vi AS t, lower(regexp_replace(text_vi, '^\s+|\s+$', '', 'g')) AS key, string_split(trim(regexp_replace(lower(text_vi), '\s+', ' ', 'g'), ' '), ' ') AS w FROM annotations WHERE image_id IS NOT NULL AND text_vi IS NOT NULL),
f AS (SELECT label_id, image_id, key, CASE WHEN len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0 THEN 'dup_word' WHEN regexp_matches(t, '(?:^|\s){_CLAUSE}') AND NOT regexp_matches(t, '^{_CLAUSE}') THEN 'pred_clause' END AS fate FROM t),
k AS (SELECT CASE WHEN fate IS NOT NULL THEN fate WHEN key <> '' AND row_number() OVER (PARTITION BY image_id, key, fate IS NULL ORDER BY label_id) > 1 THEN 'dup_text' ELSE 'kept' END AS fate FROM f)
SELECT fate, count(*) AS n FROM k GROUP BY fate"""
)
def hygiene_filter(spark, d):
    """What hygiene does to the claims of each image: kept, or dropped by one of its three rules."""
    t = load(spark, d, "annotations").where("image_id IS NOT NULL AND text_vi IS NOT NULL").select("label_id", "image_id", "text_vi", F.lit(None).cast("string").alias("predicate"))
    return claims.hygiene(t, "image_id", "label_id", "text_vi", "predicate").groupBy("fate").agg(F.count("*").alias("n"))


@query(
    _CLAIMS
    + """, p AS (SELECT image_id, claim, arg_max(verdict, label_id) AS verdict FROM claims GROUP BY image_id, claim),
r AS (SELECT image_id, count(*) FILTER (verdict = 'SUPPORTED') AS a, count(*) FILTER (verdict IN ('SUPPORTED', 'UNCERTAIN')) AS b, count(*) AS c FROM p GROUP BY image_id)
SELECT kind, count(*) AS pairs FROM (SELECT unnest(list_filter([CASE WHEN a > 0 AND b > a THEN 'A>B:uncertain_asserted' END, CASE WHEN a > 0 AND c > b THEN 'A>C:rejected_included' END, CASE WHEN b > 0 AND c > b THEN 'B>C:rejected_included' END, CASE WHEN a = 0 THEN 'unavailable' END], lambda x: x IS NOT NULL)) AS kind FROM r) GROUP BY kind"""
)
def rung_pairs(spark, d):
    """Rungs of an image's claims (supported; with uncertain; all) and the preference pairs that they allow."""
    p = _claims(spark, d).groupBy("image_id", "claim").agg(F.max_by("verdict", "label_id").alias("verdict"))
    r = p.groupBy("image_id").agg(F.count_if(F.col("verdict") == "SUPPORTED").alias("a"), F.count_if(F.col("verdict").isin("SUPPORTED", "UNCERTAIN")).alias("b"), F.count("*").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    kinds = F.array_compact(F.array(F.when((a > 0) & (b > a), "A>B:uncertain_asserted"), F.when((a > 0) & (c > b), "A>C:rejected_included"), F.when((b > 0) & (c > b), "B>C:rejected_included"), F.when(a == 0, "unavailable")))
    return r.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("pairs"))


_COUNT = r"^(\d+) (\S+ \S+)"


def _counts(spark, d):
    c = _claims(spark, d).where("prop_type = 'counting'")
    return c.select("label_id", "image_id", F.regexp_extract("claim", _COUNT, 1).alias("n"), F.regexp_extract("claim", _COUNT, 2).alias("what")).where("n <> ''").withColumn("n", F.col("n").cast("int"))


_COUNT_SQL = _CLAIMS + ", k AS (SELECT label_id, image_id, CAST(regexp_extract(claim, '^(\\d+) (\\S+ \\S+)', 1) AS INTEGER) AS n, regexp_extract(claim, '^(\\d+) (\\S+ \\S+)', 2) AS what FROM claims WHERE prop_type = 'counting' AND regexp_matches(claim, '^\\d+ \\S+ \\S+'))\n"


@query(_COUNT_SQL + "SELECT a.label_id AS id_a, b.label_id AS id_b FROM k a JOIN k b ON a.image_id = b.image_id AND a.what = b.what AND a.label_id < b.label_id AND abs(a.n - b.n) > 0")
def count_contradictions(spark, d):
    """Claims that give one image's same things in different numbers."""
    k = _counts(spark, d)
    a, b = k.alias("a"), k.alias("b")
    j = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.what") == F.col("b.what")))
    return j.where("a.label_id < b.label_id AND a.n <> b.n").select(F.col("a.label_id").alias("id_a"), F.col("b.label_id").alias("id_b"))


@query(
    _CLAIMS
    + """, c AS (SELECT label_id, image_id, regexp_extract(claim, '^(.*) màu (.*)$', 1) AS what, regexp_extract(claim, '^(.*) màu (.*)$', 2) AS colour FROM claims WHERE prop_type = 'attribute' AND regexp_matches(claim, '^.* màu .*$'))
SELECT a.label_id AS id_a, b.label_id AS id_b FROM c a JOIN c b ON a.image_id = b.image_id AND a.what = b.what AND a.label_id < b.label_id AND a.colour <> b.colour"""
)
def attribute_contradictions(spark, d):
    """Claims that give one thing of an image different colours."""
    rx = "^(.*) màu (.*)$"
    c = _claims(spark, d).where(F.col("claim").rlike(rx) & (F.col("prop_type") == "attribute")).select("label_id", "image_id", F.regexp_extract("claim", rx, 1).alias("what"), F.regexp_extract("claim", rx, 2).alias("colour"))
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.what") == F.col("b.what")))
    return j.where("a.label_id < b.label_id AND a.colour <> b.colour").select(F.col("a.label_id").alias("id_a"), F.col("b.label_id").alias("id_b"))


@query(
    _CLAIMS
    + """, c AS (SELECT image_id, claim, prop_type, arg_max(verdict, label_id) AS verdict FROM claims GROUP BY image_id, claim, prop_type),
w AS (SELECT image_id, CASE WHEN prop_type IN ('entity', 'scene') THEN 0.5 WHEN prop_type = 'attribute' THEN 1.0 ELSE 1.5 END AS w, verdict FROM c)
SELECT image_id, round(sum(CASE WHEN verdict = 'SUPPORTED' THEN w ELSE 0 END) / sum(w), 6) AS precision FROM w GROUP BY image_id"""
)
def weighted_precision(spark, d):
    """Type-weighted share of an image's claims that are supported."""
    c = _claims(spark, d).groupBy("image_id", "claim", "prop_type").agg(F.max_by("verdict", "label_id").alias("verdict"))
    w = rules.type_weight(F.col("prop_type"))
    return c.groupBy("image_id").agg(F.round(F.sum(F.when(F.col("verdict") == "SUPPORTED", w).otherwise(0.0)) / F.sum(w), 6).alias("precision"))


@query(
    _CLAIMS
    + """, t AS (SELECT image_id, prop_type, count(*) AS n FROM claims GROUP BY image_id, prop_type), s AS (SELECT image_id, n * 1.0 / sum(n) OVER (PARTITION BY image_id) AS p FROM t)
SELECT image_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy_bits FROM s GROUP BY image_id"""
)
def type_entropy_bits(spark, d):
    t = _claims(spark, d).groupBy("image_id", "prop_type").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.collect_list(F.col("n").cast("double")).alias("ns"))
    return t.select("image_id", F.round(rules.entropy_bits(F.col("ns")) + 0.0, 6).alias("entropy_bits"))


@query(
    f"""WITH k AS (SELECT label_id, claim, prop_type, lower(claim) AS low FROM (SELECT label_id, lower(text_vi) AS claim, prop_type FROM annotations WHERE text_vi IS NOT NULL))
SELECT prop_type, CASE WHEN {" OR ".join(f"contains(low, '{m}')" for m in L.NON_VISUAL_MARKERS)} THEN 'SPECULATION' WHEN prop_type IN ('entity', 'attribute') AND ({" OR ".join(f"contains(low, '{g}')" for g in L.GENDERED_NOUNS)}) THEN 'INFERENCE' ELSE 'OBSERVATION' END AS tag, count(*) AS n FROM k GROUP BY 1, 2"""
)
def epistemic_tags(spark, d):
    a = load(spark, d, "annotations").where("text_vi IS NOT NULL")
    tag = T.epistemic(F.col("text_vi"), F.coalesce(F.col("prop_type").isin("entity", "attribute"), F.lit(False)))["tag"]
    return a.groupBy("prop_type", tag.alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT label_id, regexp_extract(lower(text_vi), '(bên trái|bên phải|phía trước|phía sau|bên cạnh|đối diện)', 1) AS relation FROM annotations WHERE prop_type IN ('relation', 'spatial_relation') AND regexp_matches(lower(text_vi), '(bên trái|bên phải|phía trước|phía sau|bên cạnh|đối diện)')")
def spatial_relations(spark, d):
    rx = "(bên trái|bên phải|phía trước|phía sau|bên cạnh|đối diện)"
    a = load(spark, d, "annotations").where(F.col("prop_type").isin("relation", "spatial_relation") & F.lower("text_vi").rlike(rx))
    return a.select("label_id", F.regexp_extract(F.lower("text_vi"), rx, 1).alias("relation"))


@query(
    _CLAIMS
    + """, c AS (SELECT image_id, prop_type, claim, arg_max(verdict, label_id) AS verdict, min(label_id) AS pos FROM claims GROUP BY image_id, prop_type, claim)
SELECT a.pos AS id_a, b.pos AS id_b FROM c a JOIN c b ON a.image_id = b.image_id AND a.prop_type = b.prop_type AND a.pos <> b.pos AND starts_with(a.claim, b.claim || ' ')"""
)
def entailment_pairs(spark, d):
    """Claims of one image and type that say what another says and more behind it."""
    c = _distinct_claims(spark, d)
    # a claim's word prefixes are its candidates, so the join is on equality and no group is squared
    w = F.split("claim", " ")
    pre = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.array_join(F.slice(w, 1, i), " "))
    a = c.where(F.size(w) > 1).select("image_id", "prop_type", F.col("pos").alias("id_a"), F.explode(F.array_distinct(pre)).alias("claim"))
    return a.join(c.select("image_id", "prop_type", "claim", F.col("pos").alias("id_b")), ["image_id", "prop_type", "claim"]).where("id_a <> id_b").select("id_a", "id_b")


def _distinct_claims(spark, d):
    return _claims(spark, d).groupBy("image_id", "prop_type", "claim").agg(F.min("label_id").alias("pos"))


@query(SQL["entailment_pairs"].rsplit("SELECT a.pos", 1)[0] + "SELECT pos FROM c ANTI JOIN (SELECT b.pos AS pos FROM c a JOIN c b ON a.image_id = b.image_id AND a.prop_type = b.prop_type AND a.pos <> b.pos AND starts_with(a.claim, b.claim || ' ')) e USING (pos)")
def maximal_ids(spark, d):
    """Claims that no other entails."""
    return _distinct_claims(spark, d).select("pos").join(entailment_pairs(spark, d).select(F.col("id_b").alias("pos")), "pos", "left_anti")


@query("SELECT split, prop_type, count(*) AS n, grouping(split) + grouping(prop_type) AS level FROM annotations GROUP BY ROLLUP (split, prop_type)")
def type_rollup(spark, d):
    """Overall and per type in one pass."""
    return load(spark, d, "annotations").rollup("split", "prop_type").agg(F.count("*").alias("n"), (F.grouping("split").cast("long") + F.grouping("prop_type")).alias("level"))


_COLOURS = _CLAIMS + ", c AS (SELECT annotator, image_id, regexp_extract(claim, '^(.*) màu (.*)$', 1) AS what, regexp_extract(claim, '^(.*) màu (.*)$', 2) AS colour FROM claims WHERE prop_type = 'attribute' AND regexp_matches(claim, '^.* màu .*$'))\n"


def _xanh(c: str) -> str:
    core = f"regexp_replace({c}, ' (đậm|nhạt|sẫm|tươi|sáng|tối)$', '')"
    known = ", ".join(f"'{x}'" for x in L.COLORS)
    blue, green = (", ".join(f"'{x}'" for x in xs) for xs in (L.XANH_BLUE, L.XANH_GREEN))
    return f"CASE WHEN {core} IN ({blue}) THEN 'x:blue' WHEN {core} IN ({green}) THEN 'x:green' WHEN {core} = 'xanh' THEN 'x:?' WHEN {core} IN ({known}) THEN {core} END"


@query(
    _COLOURS
    + f""", r AS (SELECT {_xanh('a.colour')} AS p, {_xanh('b.colour')} AS g FROM c a JOIN c b ON a.image_id = b.image_id AND a.what = b.what AND a.annotator < b.annotator)
SELECT CASE WHEN p IS NULL OR g IS NULL THEN 'not_comparable' WHEN p = g THEN 'correct' WHEN starts_with(p, 'x:') AND starts_with(g, 'x:') THEN CASE WHEN p = 'x:?' THEN 'xanh_underspec' WHEN g = 'x:?' THEN 'xanh_overspec' ELSE 'xanh_confusion' END ELSE 'other_color_error' END AS outcome, count(*) AS n FROM r GROUP BY 1"""
)
def color_error_rates(spark, d):
    """How two annotators' colours of one thing differ."""
    rx = "^(.*) màu (.*)$"
    c = _claims(spark, d).where(F.col("claim").rlike(rx) & (F.col("prop_type") == "attribute")).select("annotator", "image_id", F.regexp_extract("claim", rx, 1).alias("what"), F.regexp_extract("claim", rx, 2).alias("colour"))
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.what") == F.col("b.what"))).where("a.annotator < b.annotator")
    return j.groupBy(T.color_error(F.col("a.colour"), F.col("b.colour")).alias("outcome")).agg(F.count("*").alias("n"))


_MARKED = lambda xs: "|".join(" ".join(f"<{w}>" for w in x.split(" ")) for x in xs)


@query(
    # words in angles, so that a match begins and ends with a word
    rf"""WITH m AS (SELECT label_id, text_vi, regexp_replace(translate(text_vi, '<>', chr(1) || chr(2)), '([\p{{L}}\p{{N}}_]+)', '<\1>', 'g') AS s FROM annotations WHERE text_vi IS NOT NULL),
u AS (SELECT label_id, text_vi, regexp_replace(regexp_replace(regexp_replace(s, '(?:{_MARKED(L.PRONOUNS)})\s+<ấy>', ' ', 'g'), '(?:{_MARKED(sorted(L.UNCAP_GENDERED, key=len, reverse=True))})', '<người>', 'g'), '<người>(?:\s+<người>)+', '<người>', 'g') AS s FROM m),
v AS (SELECT label_id, text_vi, regexp_replace(regexp_replace(translate(replace(replace(s, '<', ''), '>', ''), chr(1) || chr(2), '<>'), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS v FROM u)
SELECT label_id, v AS neutral FROM v WHERE v <> text_vi"""
)
def neutralised_claims(spark, d):
    """Claims that neutralisation changes, and their neutral form."""
    a = load(spark, d, "annotations").where("text_vi IS NOT NULL")
    return a.select("label_id", "text_vi", T.neutralise(F.col("text_vi")).alias("neutral")).where("neutral <> text_vi").select("label_id", "neutral")


@query()
def template_captions(spark, d):
    """All claims of an image as one template caption with the offsets of each; the last are dropped to fit the operator's budget.

    The fold is tested against brute force. Distinct claims of an image are few by nature.
    """
    c = load(spark, d, "annotations").where("image_id IS NOT NULL AND text_vi IS NOT NULL").groupBy("image_id", "prop_type", F.lower("text_vi").alias("t")).agg(F.min("label_id").alias("pos"))
    g = c.groupBy("image_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("x"))
    g = g.select("image_id", "n", claims.realise(F.transform("x", lambda y: y["t"])).alias("c"))
    return g.select("image_id", "n", F.col("c.text").alias("caption"), F.col("c.spans").alias("spans"))
