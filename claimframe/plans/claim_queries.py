"""Queries over nested claim records built from the annotation store: an image's distinct claims as propositions, each with its SQL.

A claim's slots are read off its text by type: a colour behind "màu", a number with classifier and noun, a relation
between two nouns, an action behind "đang"; the rest is its subject. An image's distinct claims are few by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as Ty

from .. import lexicon as L, schema
from ..functions import text as T
from ..operators import claims, rules
from .annotation_queries import _CLAIMS, _claims, _xanh
from .caption_queries import _SYN
from .session import load

QUERIES, SQL = {}, {}
#: The annotator who plays the machine.
MACHINE = "gv04"
_RELATIONS = sorted((r for r in L.SPATIAL_RELATIONS if " " in r), key=len, reverse=True)
_COLOUR, _COUNT, _ACTION = r"^(.+?) màu (.+)$", r"^(\d{1,9}) (\S+) (.+)$", r"^(.+?) đang (.+)$"
_SPATIAL = rf"^(.+?) (?:ở )?({'|'.join(_RELATIONS)}) (.+)$"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _build(ddl: str, given: dict[str, Column]) -> Column:
    """A struct of a schema from some of its fields; the others are null."""
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in Ty.StructType.fromDDL(ddl[len("struct<") : -1])])


def proposition(text: Column, kind: Column, pid: Column, verdict: Column, adversarial: Column) -> Column:
    """A claim of the record schema from its text and type."""
    part = lambda rx, k: F.nullif(F.regexp_extract(text, rx, k), F.lit(""))
    attribute, count, spatial, action = kind == "attribute", kind == "counting", kind.isin("relation", "spatial_relation", "interaction"), kind == "action"
    colour, number, relation, verb = (F.when(on, part(rx, 2)) for on, rx in ((attribute, _COLOUR), (count, _COUNT), (spatial, _SPATIAL), (action, _ACTION)))
    subject = F.coalesce(F.when(attribute, part(_COLOUR, 1)), F.when(spatial, part(_SPATIAL, 1)), F.when(action, part(_ACTION, 1)), text)
    return _build(
        schema.PROPOSITION,
        {
            "id": pid,
            "type": F.when(relation.isNotNull(), "spatial_relation").otherwise(kind),
            "text_vi": text,
            "subject": _build(schema.ARGUMENT, {"text_vi": subject}),
            "predicate": F.when(verb.isNotNull(), F.struct(verb.alias("lemma_vi"), F.lit(None).cast("string").alias("polarity"), F.lit(None).cast("string").alias("aspect"))),
            "object": F.when(relation.isNotNull(), _build(schema.ARGUMENT, {"text_vi": part(_SPATIAL, 3)})),
            "attributes": F.when(colour.isNotNull(), F.array(F.struct(F.lit("màu_sắc").alias("kind"), colour.alias("value_vi")))),
            "spatial_relation": F.when(relation.isNotNull(), F.struct(relation.alias("relation_vi"), F.lit(None).cast("string").alias("frame_of_reference"))),
            "count": F.when(number.isNotNull(), _build("struct<value:int,classifier:string,entity_category_vi:string,exact:boolean,tolerance:int>", {"value": part(_COUNT, 1).cast("int"), "classifier": number, "entity_category_vi": part(_COUNT, 3)})),
            "adversarial": adversarial,
            "verification": _build(schema.VERIFICATION, {"status": verdict}),
        },
    )


def records(spark: SparkSession, d: str, side: str | None = None) -> DataFrame:
    """(image_id, propositions): the distinct claims of each image in the order of their first label, of all annotators, the machine or the others.

    A claim's verdict is the last that any of them gave; no claim is adversarial.
    """
    c = _claims(spark, d)
    if side:
        c = c.where((F.col("annotator") == MACHINE) if side == "machine" else (F.col("annotator") != MACHINE))
    g = c.groupBy("image_id", "claim").agg(F.max_by("verdict", "label_id").alias("verdict"), F.min("label_id").alias("label_id"), F.min("prop_type").alias("prop_type"))
    p = proposition(F.col("claim"), F.col("prop_type"), F.concat(F.lit("P"), F.col("label_id")), F.col("verdict"), F.lit(False))
    rows = g.select("image_id", F.struct("label_id", p.alias("p")).alias("x")).groupBy("image_id").agg(F.collect_list("x").alias("xs"))
    order = F.array_sort("xs", lambda a, b: F.when(a["label_id"] < b["label_id"], -1).when(a["label_id"] > b["label_id"], 1).otherwise(0))
    return rows.select("image_id", F.transform(order, lambda x: x["p"]).alias("propositions"))


def _slots(where: str = "true") -> str:
    """The records' claims in SQL, one row each, with their slots."""
    return (
        _CLAIMS
        + rf""", g AS (SELECT image_id, claim, arg_max(verdict, label_id) AS verdict, min(label_id) AS pos, min(prop_type) AS t FROM claims WHERE {where} GROUP BY image_id, claim),
p AS (SELECT image_id, pos, claim, verdict, CASE WHEN t IN ('relation', 'spatial_relation', 'interaction') AND regexp_matches(claim, '{_SPATIAL}') THEN 'spatial_relation' ELSE t END AS type,
CASE WHEN t = 'attribute' AND regexp_matches(claim, '{_COLOUR}') THEN regexp_extract(claim, '{_COLOUR}', 1) WHEN t IN ('relation', 'spatial_relation', 'interaction') AND regexp_matches(claim, '{_SPATIAL}') THEN regexp_extract(claim, '{_SPATIAL}', 1) WHEN t = 'action' AND regexp_matches(claim, '{_ACTION}') THEN regexp_extract(claim, '{_ACTION}', 1) ELSE claim END AS subject,
CASE WHEN t = 'attribute' AND regexp_matches(claim, '{_COLOUR}') THEN regexp_extract(claim, '{_COLOUR}', 2) END AS colour,
CASE WHEN t = 'action' AND regexp_matches(claim, '{_ACTION}') THEN regexp_extract(claim, '{_ACTION}', 2) END AS verb,
CASE WHEN t IN ('relation', 'spatial_relation', 'interaction') AND regexp_matches(claim, '{_SPATIAL}') THEN regexp_extract(claim, '{_SPATIAL}', 2) END AS rel,
CASE WHEN t IN ('relation', 'spatial_relation', 'interaction') AND regexp_matches(claim, '{_SPATIAL}') THEN regexp_extract(claim, '{_SPATIAL}', 3) END AS object,
CASE WHEN t = 'counting' AND regexp_matches(claim, '{_COUNT}') THEN CAST(regexp_extract(claim, '{_COUNT}', 1) AS INTEGER) END AS n,
CASE WHEN t = 'counting' AND regexp_matches(claim, '{_COUNT}') THEN regexp_extract(claim, '{_COUNT}', 2) || ' ' || regexp_extract(claim, '{_COUNT}', 3) END AS things FROM g)
"""
    )


@query(
    _slots()
    + """SELECT image_id, pos, CASE type WHEN 'entity' THEN 'Trong ảnh có ' || subject || ' không' WHEN 'attribute' THEN 'Trong ảnh, ' || subject || ' có màu ' || colour || ' không' WHEN 'action' THEN 'Trong ảnh, ' || subject || ' có đang ' || verb || ' không' WHEN 'spatial_relation' THEN 'Trong ảnh, ' || subject || ' có ở ' || rel || ' ' || object || ' không' WHEN 'counting' THEN 'Trong ảnh có đúng ' || n || ' ' || things || ' không' END AS question,
CASE type WHEN 'entity' THEN 'Có đúng là trong ảnh KHÔNG có ' || subject || ' không' WHEN 'attribute' THEN 'Có đúng là ' || subject || ' KHÔNG có màu ' || colour || ' không' WHEN 'action' THEN 'Có đúng là ' || subject || ' KHÔNG ' || verb || ' không' WHEN 'spatial_relation' THEN 'Có đúng là ' || subject || ' KHÔNG ở ' || rel || ' ' || object || ' không' WHEN 'counting' THEN 'Có đúng là trong ảnh KHÔNG có ' || n || ' ' || things || ' không' END AS negation FROM p"""
)
def claim_questions(spark, d):
    """The probe and the negated probe of every claim; null where a slot that the type needs is missing."""
    r = records(spark, d).select("image_id", F.explode("propositions").alias("p"))
    return r.select("image_id", F.substring("p.id", 2, 20).cast("long").alias("pos"), claims.questions(F.col("p")).alias("q")).select("image_id", "pos", F.col("q.claim").alias("question"), F.col("q.negation").alias("negation"))


@query(_slots() + "SELECT image_id, count(*) AS claims, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (verdict = 'REJECTED') AS rejected, count(*) FILTER (verdict = 'REJECTED') AS false_gold FROM p GROUP BY image_id")
def claim_partition(spark, d):
    """An image's claims by verdict, and those that are false as gold."""
    ps = F.col("propositions")
    n = lambda f: F.size(F.filter(ps, f)).cast("long")
    is_ = lambda v: lambda p: T.verdict_name(p["verification"]["status"]) == v
    return records(spark, d).select("image_id", F.size(ps).cast("long").alias("claims"), *[n(is_(v)).alias(v.lower()) for v in ("SUPPORTED", "UNCERTAIN", "REJECTED")], n(lambda p: claims.false_gold(p).isNotNull()).alias("false_gold"))


@query(
    _slots()
    + """, r AS (SELECT image_id, pos, claim, unnest(CASE verdict WHEN 'SUPPORTED' THEN ['A', 'B', 'C'] WHEN 'UNCERTAIN' THEN ['B', 'C'] ELSE ['C'] END) AS rung FROM p)
SELECT image_id, rung, count(*) AS claims, string_agg(claim, ' | ' ORDER BY pos) AS texts FROM r GROUP BY image_id, rung"""
)
def claim_rungs(spark, d):
    """The texts of each image on the rungs of supervision."""
    return claims.rungs(records(spark, d)).select("image_id", "rung", F.size("texts").cast("long").alias("claims"), F.array_join("texts", " | ").alias("texts"))


def _canon(x: str) -> str:
    base = f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'), ' ')"
    bare = f"array_to_string(list_filter(string_split({base}, ' '), lambda w: w NOT IN ({', '.join(repr(a) for a in L.ASPECT_MARKERS)})), ' ')"
    unmarked = f"regexp_replace({bare}, '^(?:{'|'.join(sorted(L.NUMBER_MARKERS, key=len, reverse=True))}) ', '')"
    noun = f"regexp_replace({unmarked}, '^(?:{'|'.join(L.CLASSIFIERS)}) (.)', '\\1')"
    return f"coalesce({_SYN}[{base}], {_SYN}[{bare}], {_SYN}[{unmarked}], trim(coalesce({_SYN}[{noun}], {noun}), ' '))"


_KEY = f"concat_ws('|', type, {_canon('subject')}, coalesce({_canon('verb')}, ''), coalesce({_canon('object')}, ''), CASE type WHEN 'attribute' THEN {_xanh('colour')} WHEN 'counting' THEN CAST(n AS VARCHAR) WHEN 'spatial_relation' THEN coalesce(rel, '') ELSE '' END)"
_FULL = f"CASE type WHEN 'attribute' THEN {_xanh('colour')} IS NOT NULL WHEN 'counting' THEN n IS NOT NULL ELSE true END"


@query(
    _slots("annotator = 'gv04'")
    + ", pk AS (SELECT image_id, type, "
    + _KEY
    + " AS key, "
    + _FULL
    + " AS ok, pos FROM p), pr AS (SELECT *, row_number() OVER (PARTITION BY image_id, key, ok ORDER BY pos) AS k FROM pk),\n"
    + _slots("annotator <> 'gv04'").split("\n", 2)[2].replace(", g AS", "g2 AS", 1).replace("p AS (", "p2 AS (", 1).replace("FROM g)", "FROM g2)")
    + ", gk AS (SELECT image_id, type, verdict = 'REJECTED' AS wrong, "
    + _KEY
    + " AS key, "
    + _FULL
    + """ AS ok, pos FROM p2), gr AS (SELECT *, row_number() OVER (PARTITION BY image_id, key, ok ORDER BY wrong, pos) AS k FROM gk),
tp AS (SELECT pr.type, count(*) FILTER (NOT wrong) AS tp FROM pr JOIN gr USING (image_id, key, k) WHERE pr.ok AND gr.ok GROUP BY pr.type),
n AS (SELECT type, sum(a) AS n, sum(b) AS gold FROM (SELECT type, 1 AS a, 0 AS b FROM pr UNION ALL SELECT type, 0, CAST(NOT wrong AS INT) FROM gr) GROUP BY type),
t AS (SELECT type, coalesce(tp, 0) AS tp, n, gold FROM n LEFT JOIN tp USING (type)), u AS (SELECT type, tp, n, gold FROM t UNION ALL SELECT NULL, sum(tp), sum(n), sum(gold) FROM t)
SELECT type, CAST(tp AS BIGINT) AS tp, CAST(n - tp AS BIGINT) AS fp, CAST(gold - tp AS BIGINT) AS fn, round(tp * 1.0 / nullif(n, 0), 6) AS precision, round(tp * 1.0 / nullif(gold, 0), 6) AS recall FROM u"""
)
def claim_prf(spark, d):
    """The machine's claims aligned one to one with the others', by type and over all; claims without a type and the sum over all have a null type."""
    r = claims.prf(records(spark, d, "machine"), records(spark, d, "human"), exact=True)
    return r.select("type", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_KIND = "CASE " + " ".join(f"WHEN contains(claim, '{m}') THEN '{k}'" for m, k in L.NON_VISUAL_MARKERS.items()) + " END"


@query(
    _CLAIMS
    + f""", i AS (SELECT image_id, claim, {_KIND} AS kind, count(*) AS n, count(*) FILTER (verdict = 'SUPPORTED') * 1.0 / count(*) AS s, count(*) FILTER (verdict = 'REJECTED') * 1.0 / count(*) AS c, least(count(*) / 3.0, 1.0) AS e FROM claims GROUP BY image_id, claim),
b AS (SELECT CASE WHEN kind IN ({", ".join(repr(x) for x in L.SPECULATIVE)}) THEN 'hard_constraint' WHEN e < {L.E_MIN} THEN 'gate' WHEN c >= {L.C_HI} THEN 'contradiction' WHEN s >= {L.S_HI} AND c <= {L.C_LO} THEN 'support' WHEN s <= {L.S_LO} THEN 'no_support' ELSE 'unclear' END AS branch FROM i)
SELECT branch, CASE WHEN branch IN ('hard_constraint', 'contradiction', 'no_support') THEN 'REJECTED' WHEN branch = 'support' THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS verdict, count(*) AS n FROM b GROUP BY 1, 2"""
)
def claim_decisions(spark, d):
    """Claims decided by the annotators' shares as scores: support, contradiction, and evidence that grows with their number; claims of what cannot be seen are constrained."""
    i = _claims(spark, d).groupBy("image_id", "claim").agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "SUPPORTED").cast("double")).alias("s"), F.avg((F.col("verdict") == "REJECTED").cast("double")).alias("c"))
    kind = T.epistemic(F.col("claim"), F.lit(False))["kind"]
    hard = rules.hard_constraint(kind, kind.isNotNull()).isNotNull()
    v = i.select(rules.decide(F.col("s"), F.col("c"), F.least(F.col("n") / 3.0, F.lit(1.0)), hard).alias("v"))
    return v.groupBy("v.branch", "v.verdict").agg(F.count("*").alias("n"))
