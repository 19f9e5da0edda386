"""Operators on nested claim records: questions, geometry, matching, evidence gates, caption claims, factuality, supervision.

A claim is a struct of the record schema; every function takes and gives columns, so a record stays one row and its
claims an array, and pairs of claims are formed only where a metric needs them, by equi-joins on image and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as L
from ..functions import text as T
from . import rules

# Calibration of the geometric test.
MARGIN, NEAR, INSIDE, OUTSIDE = 0.03, 0.25, 0.80, 0.20


def _slot(p: Column, side: str) -> Column:
    return F.nullif(F.coalesce(p[side]["text_vi"], p[side]["head_noun_vi"]), F.lit(""))


def questions(p: Column) -> Column:
    """struct<claim, negation> in Vietnamese by type; null where a slot that the type needs is missing."""
    s, o = F.coalesce(_slot(p, "subject"), F.lit("")), _slot(p, "object")
    verb = F.nullif(F.trim(F.regexp_replace(F.coalesce(p["predicate"]["lemma_vi"], F.lit("")), f"(?:^| )(?:{'|'.join(L.ASPECT_MARKERS)})(?= |$)", "")), F.lit(""))
    first = F.try_element_at(p["attributes"], F.lit(1))
    value = F.nullif(first["value_vi"], F.lit(""))
    hue = F.when((first["kind"] == "màu_sắc") & ~F.lower(value).startswith("màu"), F.concat(F.lit("màu "), value)).otherwise(value)
    side = F.nullif(F.replace(relation(p["spatial_relation"]["relation_vi"]), F.lit("_"), F.lit(" ")), F.lit(""))
    n = p["count"]
    things = F.when(n["value"].isNotNull(), F.concat_ws(" ", n["value"].cast("string"), F.nullif(n["classifier"], F.lit("")), F.nullif(n["entity_category_vi"], F.lit(""))))

    def pair(a: str, b: str, *slots: Column) -> Column:
        ok = slots[0].isNotNull()
        for x in slots[1:]:
            ok &= x.isNotNull()
        return F.when(ok, F.struct(F.format_string(a, *slots).alias("claim"), F.format_string(b, *slots).alias("negation")))

    kind, of_colour = p["type"], first["kind"] == "màu_sắc"
    return (
        F.when(kind == "entity", pair("Trong ảnh có %s không", "Có đúng là trong ảnh KHÔNG có %s không", s))
        .when((kind == "attribute") & of_colour, pair("Trong ảnh, %s có %s không", "Có đúng là %s KHÔNG có %s không", s, hue))
        .when(kind == "attribute", pair("Trong ảnh, %s có %s không", "Có đúng là %s KHÔNG %s không", s, value))
        .when(kind == "action", pair("Trong ảnh, %s có đang %s không", "Có đúng là %s KHÔNG %s không", s, verb))
        .when(kind.isin("relation", "interaction"), pair("Trong ảnh, %s có %s %s không", "Có đúng là %s KHÔNG %s %s không", s, verb, o))
        .when(kind == "spatial_relation", pair("Trong ảnh, %s có ở %s %s không", "Có đúng là %s KHÔNG ở %s %s không", s, side, o))
        .when(kind == "counting", pair("Trong ảnh có đúng %s không", "Có đúng là trong ảnh KHÔNG có %s không", things))
    )


def relation(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", "_")


def geometry(rel: Column, s: Column, o: Column, width: Column, height: Column) -> Column:
    """Whether boxes bear out a relation; null where two-dimensional boxes cannot tell.

    Boxes are arrays x, y, w, h in pixels; null or malformed ones tell nothing, and so do differences inside the
    margin, partial overlaps, and relations of depth.
    """
    box = lambda b: [F.try_element_at(b, F.lit(k)) for k in (1, 2, 3, 4)]
    (sx, sy, sw, sh), (ox, oy, ow, oh) = box(s), box(o)
    well = (F.size(s) == 4) & (F.size(o) == 4)
    cx, cy = (sx + sw / 2) - (ox + ow / 2), (sy + sh / 2) - (oy + oh / 2)
    spanx = F.coalesce(F.nullif(width, F.lit(0.0)), F.greatest(sw, ow, F.abs(cx), F.lit(1.0)))
    spany = F.coalesce(F.nullif(height, F.lit(0.0)), F.greatest(sh, oh, F.abs(cy), F.lit(1.0)))
    dx, dy, far = cx / spanx, cy / spany, F.hypot(cx, cy) / F.hypot(spanx, spany)
    lap = F.greatest(F.least(sx + sw, ox + ow) - F.greatest(sx, ox), F.lit(0.0)) * F.greatest(F.least(sy + sh, oy + oh) - F.greatest(sy, oy), F.lit(0.0))
    area = sw * sh
    held = F.when(area > 0, lap / area).otherwise(0.0)
    r = relation(rel)
    beyond = lambda d, low: F.when(F.abs(d) >= MARGIN, (d < 0) if low else (d > 0))
    near = F.when(far <= NEAR - MARGIN, True).when(far >= NEAR + MARGIN, False)
    return F.when(
        well,
        F.when(r == "bên_trái", beyond(dx, True))
        .when(r == "bên_phải", beyond(dx, False))
        .when(r == "trên", beyond(dy, True))
        .when(r == "trên_đầu", F.when(F.abs(dy) >= MARGIN, sy + sh <= oy))
        .when(r == "dưới", beyond(dy, False))
        .when(r == "trong", F.when((held >= INSIDE) & (area < ow * oh), True).when(held <= OUTSIDE, False))
        .when(r == "ngoài", F.when(lap == 0, True).when(held >= INSIDE, False))
        .when(r.isin("gần", "bên_cạnh"), near)
        .when(r == "xa", ~near),
    )


def _related(a: Column, b: Column) -> Column:
    """Equal nouns, or one a kind of the other."""
    up = T.literal_map({n: "|".join(["", *L.ancestors(n)[1:], ""]) for n in L.HYPERNYMS})
    under = lambda x, y: F.coalesce(up[x].contains(F.concat(F.lit("|"), y, F.lit("|"))), F.lit(False))
    return (a == b) | under(a, b) | under(b, a)


def matches(p: Column, g: Column, exact: bool = False) -> Column:
    """Whether two claims say the same: type, subject, predicate, object and what the type adds.

    At the exact tier nouns must be equal in canonical form, else one may be a kind of the other. Null slots equal
    only null slots.
    """
    noun = lambda c, side: T.canonical(F.coalesce(F.nullif(c[side]["head_noun_vi"], F.lit("")), c[side]["text_vi"]))

    def slot(side):
        a, b = noun(p, side), noun(g, side)
        same_id = F.coalesce(p[side]["entity_id"] == g[side]["entity_id"], F.lit(False))
        return F.when(a.isNull() | b.isNull(), same_id | (a.isNull() & b.isNull())).otherwise(same_id | ((a == b) if exact else _related(a, b)))

    verb = lambda c: F.coalesce(T.canonical(c["predicate"]["lemma_vi"]), F.lit(""))
    attrs = lambda c: F.coalesce(c["attributes"], F.array())
    attribute = F.exists(attrs(p), lambda x: F.exists(attrs(g), lambda y: (x["kind"] == y["kind"]) & F.when(x["kind"] == "màu_sắc", T.color_error(x["value_vi"], y["value_vi"]) == "correct").otherwise(T.canonical(x["value_vi"]) == T.canonical(y["value_vi"]))))
    count = F.coalesce(F.abs(p["count"]["value"] - g["count"]["value"]) <= F.coalesce(g["count"]["tolerance"], F.lit(0)), F.lit(False))
    spatial = p["spatial_relation"]["relation_vi"].eqNullSafe(g["spatial_relation"]["relation_vi"])
    payload = F.when(p["type"] == "attribute", attribute).when(p["type"] == "counting", count).when(p["type"] == "spatial_relation", spatial).otherwise(True)
    return F.coalesce((p["type"] == g["type"]) & slot("subject") & (verb(p) == verb(g)) & slot("object") & payload, F.lit(False))


def id_order(pid: Column) -> Column:
    """Sort key of claim ids: P2 before P10, others last."""
    n = F.nullif(F.regexp_extract(pid, r"^P(\d{1,18})$", 1), F.lit("")).cast("long")
    return F.struct(F.coalesce(n, F.lit(2**31)).alias("n"), pid.alias("id"))


def unanimous(p: Column) -> Column:
    """A first affirming and a first refuting probe, grounding enough, and every sample with the head that fits."""
    probes = F.coalesce(p["evidence"]["probes"], F.array())
    first = lambda pol: F.try_element_at(F.filter(probes, lambda q: q["polarity"] == pol), F.lit(1))
    heads = {"affirms": "^(?:có|đúng|yes)", "refutes": "^(?:không|sai|no)"}

    def all_say(pol):
        q = first(pol)
        said = F.when(F.size(q["samples"]) > 0, q["samples"]).otherwise(F.array(q["answer"]))
        return q.isNotNull() & F.forall(said, lambda s: F.coalesce(F.lower(F.trim(s)).rlike(heads[pol]), F.lit(False)))

    return F.coalesce((p["evidence"]["visual_grounding"]["grounding_score"] >= L.UNCAP_GROUNDING) & all_say("affirms") & all_say("refutes"), F.lit(False))


def may_uncap(p: Column) -> Column:
    """The four criteria: uncertain, made uncertain by a gendered noun, no inference needed, evidence unanimous."""
    inference = F.coalesce(p["evidence"]["external_knowledge"]["inference_type"], F.lit("none"))
    kinds = p["type"].isin("entity", "attribute", "action", "counting")
    return F.coalesce(kinds & (T.verdict_name(p["verification"]["status"]) == "UNCERTAIN") & (T.neutralise(p["text_vi"]) != p["text_vi"]) & (inference == "none") & unanimous(p), F.lit(False))


def uncap(records: DataFrame) -> DataFrame:
    """Records whose eligible claims are neutral in text and supported; ``n_uncapped`` counts them. Other claims stay as they are."""
    one = lambda p: F.when(may_uncap(p), p.withField("text_vi", T.neutralise(p["text_vi"])).withField("verification.status", F.lit("SUPPORTED"))).otherwise(p)
    n = F.size(F.filter(F.coalesce("propositions", F.array()), may_uncap))
    return records.withColumns({"n_uncapped": n, "propositions": F.transform("propositions", one)})


def caption_claims(records: DataFrame) -> DataFrame:
    """(image_id, pos, prop, ungrounded): the claims that a caption makes.

    Hedges and spans marked as no facts make none; ids are resolved against the record and count once, in the order
    of first use; factual text with no claim behind it comes as a claim of its own that nothing can match. Records
    without spans have no rows.
    """
    c = F.col("caption")
    hedged = F.transform(F.coalesce(c["hedged_spans"], F.array()), lambda t: F.trim(t))
    factual = F.filter(F.coalesce(c["spans"], F.array()), lambda s: ~F.coalesce(s["span_role"] == "hedge", F.lit(False)) & ~F.array_contains(hedged, F.trim(s["text"])) & F.coalesce(s["is_factual"], F.lit(True)))
    r = records.where(F.size(c["spans"]) > 0).select("image_id", "propositions", "caption", factual.alias("factual"), hedged.alias("hedged"))
    ids = F.array_distinct(F.flatten(F.transform("factual", lambda s: F.coalesce(s["proposition_ids"], F.array()))))
    found = F.filter(F.transform(ids, lambda i: F.try_element_at(F.filter("propositions", lambda p: p["id"] == i), F.lit(1))), lambda p: p.isNotNull())
    a = r.select("image_id", F.posexplode(found).alias("pos", "prop")).withColumn("ungrounded", F.lit(None).cast("string"))
    told = F.transform("factual", lambda s: F.trim(s["text"]))
    loose = F.filter(F.array_distinct(F.transform(F.coalesce(c["ungrounded_spans"], F.array()), lambda t: F.trim(t))), lambda t: (t != "") & ~F.array_contains(F.col("hedged"), t) & ~F.array_contains(told, t))
    b = r.select("image_id", F.posexplode(loose).alias("pos", "ungrounded")).select("image_id", (F.col("pos") + 1_000_000).alias("pos"), F.lit(None).cast(a.schema["prop"].dataType).alias("prop"), "ungrounded")
    return a.unionByName(b)


def _props(records: DataFrame, verdicts: tuple[str, ...] | None = None) -> DataFrame:
    d = records.select("image_id", F.posexplode("propositions").alias("pos", "prop"))
    return d if verdicts is None else d.where(T.verdict_name(F.col("prop.verification.status")).isin(*verdicts))


def factuality(predicted: DataFrame, gold: DataFrame, exact: bool = False) -> DataFrame:
    """(image_id, claims, hits, refs, covered, precision, coverage, f) of captions against supported gold claims.

    Weights are by type. Images of which some gold claim has no verdict are skipped, precision is null without
    claims, and the harmonic mean is 0 without coverage. Claims meet references of their image and type only.
    """
    unread = gold.where(F.exists("propositions", lambda p: T.verdict_name(p["verification"]["status"]).isNull())).select("image_id")
    c = caption_claims(predicted).join(unread, "image_id", "left_anti").withColumn("w", F.when(F.col("prop").isNull(), 1.0).otherwise(rules.type_weight(F.col("prop.type"))))
    g = _props(gold, ("SUPPORTED",)).join(unread, "image_id", "left_anti").select("image_id", F.col("pos").alias("gpos"), F.col("prop").alias("g"), rules.type_weight(F.col("prop.type")).alias("gw"))
    j = c.where("prop IS NOT NULL").join(g, ["image_id"]).where(F.col("prop.type") == F.col("g.type")).where(matches(F.col("prop"), F.col("g"), exact))
    hit = j.select("image_id", "pos", "w").distinct().groupBy("image_id").agg(F.sum("w").alias("hits"))
    cov = j.select("image_id", "gpos", "gw").distinct().groupBy("image_id").agg(F.sum("gw").alias("covered"))
    all_ = c.groupBy("image_id").agg(F.sum("w").alias("claims")).join(g.groupBy("image_id").agg(F.sum("gw").alias("refs")), "image_id", "full_outer").join(hit, "image_id", "left").join(cov, "image_id", "left")
    d = all_.select("image_id", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("claims", "hits", "refs", "covered")])
    p, r = F.try_divide("hits", F.nullif("claims", F.lit(0.0))), F.try_divide("covered", F.nullif("refs", F.lit(0.0)))
    return d.withColumns({"precision": p, "coverage": r}).withColumn("f", rules.harmonic(F.col("precision"), F.col("coverage")))


def false_gold(p: Column) -> Column:
    """Why a gold claim is false by construction: adversarial first, else rejected; null if it isn't."""
    return F.when(F.coalesce(p["adversarial"], F.lit(False)), "adversarial").when(T.verdict_name(p["verification"]["status"]) == "REJECTED", "rejected")


def prf(predicted: DataFrame, gold: DataFrame, exact: bool = False) -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1), and over all types with a null type.

    Claims are aligned one to one within image and type, true gold before false, first free gold wins; a claim
    aligned with false gold is wrong. Every image's claims of one type are aligned in one array expression, so the
    join never squares more than one record.
    """
    g = _props(gold).select("image_id", F.col("prop.type").alias("type"), F.struct(false_gold(F.col("prop")).isNotNull().alias("false"), "pos", "prop").alias("g"))
    g = g.groupBy("image_id", "type").agg(F.array_sort(F.collect_list(F.struct("g.false", "g.pos"))).alias("order"), F.map_from_entries(F.collect_list(F.struct("g.pos", "g.prop"))).alias("gold"))
    p = _props(predicted).groupBy("image_id", F.col("prop.type").alias("type")).agg(F.collect_list(F.struct("pos", "prop")).alias("preds"))
    j = p.join(g, ["image_id", "type"], "full_outer")
    order = F.coalesce("order", F.array().cast("array<struct<false:boolean,pos:int>>"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("tp"))

    def step(acc, x):
        free = F.filter(order, lambda o: ~F.array_contains(acc["used"], o["pos"]) & matches(x["prop"], F.element_at("gold", o["pos"]), exact))
        hit = F.try_element_at(free, F.lit(1))
        return F.when(hit.isNull(), acc).otherwise(F.struct(F.concat(acc["used"], F.array(hit["pos"])).alias("used"), (acc["tp"] + F.when(hit["false"], 0).otherwise(1)).alias("tp")))

    # predictions in their order
    preds = F.coalesce(F.array_sort("preds", lambda a, b: a["pos"] - b["pos"]), F.array().cast(p.schema["preds"].dataType))
    tp = F.aggregate(preds, start, step)["tp"]
    true = F.size(F.filter(order, lambda o: ~o["false"]))
    d = j.select("type", tp.alias("tp"), F.greatest(F.size("preds"), F.lit(0)).alias("n"), true.alias("gold"))
    t = d.rollup("type").agg(*[F.sum(x).alias(x) for x in ("tp", "n", "gold")])
    pr, rc = F.try_divide(F.col("tp"), F.nullif("n", F.lit(0))), F.try_divide(F.col("tp"), F.nullif("gold", F.lit(0)))
    return t.select("type", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"), pr.alias("precision"), rc.alias("recall"), F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).alias("f1"))


def hygiene(df: DataFrame, group: str, order: str, text: str, predicate: str) -> DataFrame:
    """``df`` with ``fate``: "dup_word" (a word twice in a row), "pred_clause" (a predicate that holds a clause or more than twelve
    words, or a text with a clause behind its beginning), "dup_text" (the text stands earlier in its group among those that
    passed so far; empty ones never count as such) or "kept". Null texts and predicates are empty; a null group is a group.
    """
    t, p = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(predicate), F.lit(""))
    words = F.regexp_count(p, F.lit(r"\S+"))
    bad = F.when(T.adjacent_duplicate(t), "dup_word").when(T.embedded_clause(F.concat(F.lit(" "), p)) | T.embedded_clause(t, True) | (words > L.LONGEST_PREDICATE), "pred_clause")
    d = df.withColumns({"fate": bad, "_key": F.lower(F.regexp_replace(t, r"^\s+|\s+$", ""))})
    nth = F.row_number().over(Window.partitionBy(group, "_key", F.col("fate").isNull()).orderBy(order))
    again = F.col("fate").isNull() & (F.col("_key") != "") & (nth > 1)
    return d.withColumn("_again", again).withColumn("fate", F.coalesce("fate", F.when(F.col("_again"), "dup_text"), F.lit("kept"))).drop("_key", "_again")


def rungs(records: DataFrame) -> DataFrame:
    """(image_id, rung, texts): supported claims; with the uncertain ones; all. Duplicates by text count once, first wins."""
    d = _props(records).select("image_id", "pos", T.verdict_name(F.col("prop.verification.status")).alias("v"), F.col("prop.text_vi").alias("t"), F.lower(F.trim("prop.text_vi")).alias("key"))
    first = d.where(F.col("v").isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy("image_id", "key").orderBy("pos"))).where((F.col("r") == 1) | (F.col("key") == ""))
    levels = F.when(F.col("v") == "SUPPORTED", F.array(*map(F.lit, "ABC"))).when(F.col("v") == "UNCERTAIN", F.array(F.lit("B"), F.lit("C"))).otherwise(F.array(F.lit("C")))
    g = first.select("image_id", F.explode(levels).alias("rung"), "pos", "t").groupBy("image_id", "rung").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("x"))
    return g.select("image_id", "rung", F.transform("x", lambda y: y["t"]).alias("texts"))


def realise(texts: Column, budget: int = 320) -> Column:
    """struct<text, spans>: claims as one template caption with the exact offsets of each; the last are dropped to fit the budget."""
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<text:string,char_start:int,char_end:int>>").alias("spans"), F.lit(False).alias("full"))

    def step(acc, t):
        begin = F.length(acc["text"]) + F.when(acc["text"] == "", 0).otherwise(2)
        text = F.concat(acc["text"], F.when(acc["text"] == "", "").otherwise(", "), t)
        spans = F.concat(acc["spans"], F.array(F.struct(t.alias("text"), begin.alias("char_start"), (begin + F.length(t)).alias("char_end"))))
        # nothing follows a claim that was dropped
        full = acc["full"] | (F.length(text) > budget)
        return F.struct(F.when(full, acc["text"]).otherwise(text).alias("text"), F.when(full, acc["spans"]).otherwise(spans).alias("spans"), full.alias("full"))

    return F.aggregate(texts, start, step, lambda x: F.struct(x["text"].alias("text"), x["spans"].alias("spans")))
