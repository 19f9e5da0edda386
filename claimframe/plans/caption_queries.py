"""Queries over captions, images and the published summaries, each with its SQL.

Captions of the gold-caption system serve as references of their image, all others as predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import lexicon as L
from ..functions import text as T
from ..operators import joins, reports
from .session import load

REFERENCE = "goldcap_sft"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _values(xs) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in xs)


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _map(d: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


def _split(spark, d):
    c = load(spark, d, "captions").select("caption_id", "image_id", "system_name", "gen_mode", "caption")
    return c.where(F.col("system_name") != REFERENCE), c.where(F.col("system_name") == REFERENCE)


def _scored(spark, d):
    preds, refs = _split(spark, d)
    return reports.chair_mentions(preds, reports.gold_objects(refs, "image_id", "caption"), "image_id", "caption")


# -- the same steps in SQL: tokens set apart by two blanks, so that neighbouring matches share none
_NOUNS = "|".join(n.replace(" ", "  ") for n in L.OBJECT_NOUNS)
_ANC = "MAP {" + ", ".join(f"'{n}': {_list(L.ancestors(n)[1:])}" for n in L.OBJECT_NOUNS if n in L.HYPERNYMS) + "}"
_SYN = _map(L.SYNONYMS)
_CLASSES = "|".join(L.CLASSIFIERS)
_MARKS = "|".join(sorted(L.NUMBER_MARKERS, key=len, reverse=True))


def _objects(text: str) -> str:
    joined = f"' ' || array_to_string(regexp_extract_all(regexp_replace(lower({text}), '{'|'.join(L.COLOUR_PHRASES)}', ' ', 'g'), '\\p{{L}}+'), '  ') || ' '"
    found = f"list_transform(regexp_extract_all({joined}, ' ({_NOUNS}) ', 1), lambda x: [replace(x, '  ', ' ')])"
    fold = f"list_reduce({found}, lambda a, x: CASE WHEN len(a) > 0 AND coalesce(list_contains({_ANC}[x[1]], a[-1]), false) THEN list_concat(a[:len(a)-1], x) ELSE list_concat(a, x) END)"
    return f"CASE WHEN len({found}) = 0 THEN CAST([] AS VARCHAR[]) ELSE {fold} END"


def _canonical(x: str) -> str:
    # nouns of the vocabulary have neither markers nor double blanks in front of a synonym
    bare = f"regexp_replace({x}, '^(?:{_MARKS}) ', '')"
    return f"coalesce({_SYN}[{x}], {_SYN}[{bare}], {_SYN}[regexp_replace({bare}, '^(?:{_CLASSES}) (.)', '\\1')], regexp_replace({bare}, '^(?:{_CLASSES}) (.)', '\\1'))"


_SCORED = f"""
WITH raw AS (SELECT caption_id, image_id, system_name, gen_mode, {_objects('caption')} AS objs FROM captions WHERE caption IS NOT NULL),
refn AS (SELECT DISTINCT image_id, {_canonical('noun')} AS noun FROM (SELECT image_id, unnest(objs) AS noun FROM raw WHERE system_name = '{REFERENCE}' AND image_id IS NOT NULL)),
goldn AS (SELECT DISTINCT image_id, noun FROM (SELECT image_id, noun FROM refn UNION ALL SELECT image_id, unnest({_ANC.replace("MAP {", "MAP {", 1)}[noun]) FROM refn)),
gold AS (SELECT image_id, list(noun) AS gold FROM goldn GROUP BY image_id),
ment AS (SELECT p.caption_id, p.image_id, p.system_name, p.gen_mode, list_distinct(p.objs) AS mentioned, g.gold FROM raw p JOIN gold g USING (image_id) WHERE p.system_name <> '{REFERENCE}'),
scored AS (SELECT *, list_filter(mentioned, lambda n: NOT list_contains(gold, {_canonical('n')})) AS halluc FROM ment)
"""
_CHAIR = """count(*) AS n_captions, CAST(sum(len(mentioned)) AS BIGINT) AS n_mentions, CAST(sum(len(halluc)) AS BIGINT) AS n_hallucinated,
CAST(sum(CASE WHEN len(halluc) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_captions_hallucinated,
round(sum(len(halluc)) * 1.0 / nullif(sum(len(mentioned)), 0), 6) AS chair_i,
round(sum(CASE WHEN len(halluc) > 0 THEN 1 ELSE 0 END) * 1.0 / nullif(count(*), 0), 6) AS chair_s,
round(sum(len(mentioned)) * 1.0 / nullif(count(*), 0), 6) AS mentions_per_caption"""


@query(_SCORED + f"SELECT {_CHAIR} FROM scored")
def chair_micro(spark: SparkSession, d: str) -> DataFrame:
    return reports.chair(_scored(spark, d))


@query(_SCORED + f"SELECT system_name, gen_mode, {_CHAIR} FROM scored GROUP BY system_name, gen_mode")
def chair_by_system(spark, d):
    return reports.chair(_scored(spark, d), ["system_name", "gen_mode"])


@query(_SCORED + "SELECT noun, count(*) AS n FROM (SELECT unnest(halluc) AS noun FROM scored) GROUP BY noun ORDER BY n DESC, noun LIMIT 20")
def chair_top_halluc(spark, d):
    return reports.top_values(_scored(spark, d).select(F.explode("halluc").alias("noun")), "noun", 20)


@query(_SCORED + "SELECT caption_id, CAST(len(mentioned) AS INTEGER) AS n_mentions, CAST(len(halluc) AS INTEGER) AS n_hallucinated FROM scored")
def chair_per_caption(spark, d):
    return _scored(spark, d).select("caption_id", F.size("mentioned").alias("n_mentions"), F.size("halluc").alias("n_hallucinated"))


@query(
    _SCORED
    + f""", rawgold AS (SELECT image_id, list(DISTINCT noun) AS g FROM (SELECT image_id, unnest(objs) AS noun FROM raw WHERE system_name = '{REFERENCE}' AND image_id IS NOT NULL) GROUP BY image_id),
hit AS (SELECT system_name, len(list_intersect(mentioned, g)) AS h, len(mentioned) AS m, len(g) AS gs FROM scored JOIN rawgold USING (image_id)),
agg AS (SELECT system_name, CAST(sum(h) AS BIGINT) AS tp, CAST(sum(m) AS BIGINT) AS mentions, avg(CAST(h AS DOUBLE) / nullif(gs, 0)) AS r FROM hit GROUP BY system_name)
SELECT system_name, tp, mentions, round(CAST(tp AS DOUBLE) / nullif(mentions, 0), 6) AS precision, round(r, 6) AS recall,
round(CASE WHEN CAST(tp AS DOUBLE) / nullif(mentions, 0) + r > 0 THEN 2 * (CAST(tp AS DOUBLE) / nullif(mentions, 0)) * r / (CAST(tp AS DOUBLE) / nullif(mentions, 0) + r) END, 6) AS f1 FROM agg"""
)
def object_prf(spark, d):
    _, refs = _split(spark, d)
    raw = refs.where("image_id IS NOT NULL AND caption IS NOT NULL").select("image_id", F.explode(F.array_distinct(T.object_mentions(F.col("caption")))).alias("noun")).groupBy("image_id").agg(F.collect_set("noun").alias("gold_raw"))
    return reports.object_prf(_scored(spark, d), raw, "image_id", ["system_name"])


def _has(text: str, terms) -> str:
    pad = f"(' ' || regexp_replace(trim(lower({text})), '\\s+', ' ', 'g') || ' ')"
    return "(" + " OR ".join(f"contains({pad}, ' {t} ')" for t in terms) + ")"


@query(
    f"""WITH r AS (SELECT image_id, bool_or({_has('caption', L.REPORT_MALE)}) AS rm, bool_or({_has('caption', L.REPORT_FEMALE)}) AS rf FROM captions WHERE system_name = '{REFERENCE}' AND caption IS NOT NULL AND image_id IS NOT NULL GROUP BY image_id),
p AS (SELECT system_name, {_has('caption', [*L.REPORT_MALE, *L.REPORT_FEMALE, *L.REPORT_NEUTRAL])} AS person, {_has('caption', L.REPORT_MALE)} AS m, {_has('caption', L.REPORT_FEMALE)} AS f, rm, rf FROM captions JOIN r USING (image_id) WHERE system_name <> '{REFERENCE}' AND caption IS NOT NULL),
a AS (SELECT system_name, count(*) AS n_captions, count(*) FILTER (person) AS n_with_person, count(*) FILTER (m OR f) AS n_gendered, count(*) FILTER (person AND NOT (m OR f)) AS n_neutral,
count(*) FILTER ((m OR f) AND NOT rm AND NOT rf) AS n_invented, count(*) FILTER ((m OR f) AND (rm OR rf) AND NOT ((m AND rm) OR (f AND rf))) AS n_contradicted FROM p GROUP BY system_name)
SELECT *, round((n_invented + n_contradicted) * 1.0 / nullif(n_gendered, 0), 6) AS invention_rate FROM a"""
)
def gender_invention(spark, d):
    preds, refs = _split(spark, d)
    return reports.gender_report(preds, refs, "image_id", "caption", ["system_name"])


@query(
    _SCORED
    + """, s AS (SELECT * FROM scored), a AS (SELECT c.system_name, c.gen_mode, count(*) AS n, count(*) FILTER (regexp_matches(c.caption, '[\\x{4e00}-\\x{9fff}]')) AS cjk, CAST(coalesce(sum(len(s.halluc)), 0) AS BIGINT) AS h, CAST(coalesce(sum(len(s.mentioned)), 0) AS BIGINT) AS m
FROM captions c LEFT JOIN s USING (caption_id) WHERE c.caption IS NOT NULL AND c.system_name <> 'goldcap_sft' GROUP BY c.system_name, c.gen_mode)
SELECT system_name, gen_mode, n AS n_captions, h AS n_hallucinated_mentions, round(h * 1.0 / n, 3) AS halluc_per_caption, round(m * 1.0 / n, 2) AS mentions_per_caption, round(h * 1.0 / nullif(m, 0), 3) AS chair_i, cjk AS cjk_captions, round(cjk * 100.0 / n, 1) AS cjk_pct FROM a"""
)
def abs_halluc_summary_of_captions(spark, d):
    """The summary's figures with all predictions as the denominator."""
    s = _scored(spark, d).select("caption_id", F.size("halluc").alias("h"), F.size("mentioned").alias("m"))
    preds, _ = _split(spark, d)
    j = preds.where("caption IS NOT NULL").join(s, "caption_id", "left")
    g = j.groupBy("system_name", "gen_mode").agg(F.count("*").alias("n_captions"), F.coalesce(F.sum("h"), F.lit(0)).alias("n_hallucinated_mentions"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.count_if(T.has_cjk(F.col("caption"))).alias("cjk_captions"))
    n, h, m = F.col("n_captions"), F.col("n_hallucinated_mentions"), F.col("m")
    return g.select("system_name", "gen_mode", n, h, reports.rate(h, n, 3).alias("halluc_per_caption"), reports.rate(m, n, 2).alias("mentions_per_caption"), reports.rate(h, m, 3).alias("chair_i"), "cjk_captions", F.round(F.col("cjk_captions") * 100.0 / n, 1).alias("cjk_pct"))


@query("SELECT split_part(system_mode, '-', 1) AS system_name, split_part(system_mode, '-', 2) AS gen_mode, s.n_captions, s.cjk_pct, l.max_new_tokens, l.p90_s FROM abs_halluc_summary s JOIN latency_modes l ON l.system_name = split_part(system_mode, '-', 1) AND l.gen_mode = split_part(system_mode, '-', 2)")
def summary_with_latency(spark, d):
    s = load(spark, d, "abs_halluc_summary").withColumns({"system_name": F.split_part("system_mode", F.lit("-"), F.lit(1)), "gen_mode": F.split_part("system_mode", F.lit("-"), F.lit(2))})
    return s.join(load(spark, d, "latency_modes"), ["system_name", "gen_mode"]).select("system_name", "gen_mode", "n_captions", "cjk_pct", "max_new_tokens", "p90_s")


_TAILS = "|".join(t.replace(" ", "\\s+") for t in L.XANH_TAILS)
_XANH = f"""SELECT trim(regexp_replace(p, '\\s+', ' ', 'g')) AS phrase FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower(caption), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])(xanh(?:\\s+(?:{_TAILS}))*)', 1)) AS p FROM captions WHERE caption IS NOT NULL)"""
_BUCKET = f"""CASE WHEN regexp_replace(phrase, ' (đậm|nhạt|sẫm|tươi|sáng|tối)$', '') IN ('{"','".join(L.XANH_BLUE + L.XANH_GREEN)}') THEN 'resolved' WHEN regexp_replace(phrase, ' (đậm|nhạt|sẫm|tươi|sáng|tối)$', '') = 'xanh' THEN CASE WHEN phrase <> 'xanh' THEN 'degree_only' ELSE 'bare' END ELSE 'unknown' END"""


def _phrases(spark, d):
    c = load(spark, d, "captions").where("caption IS NOT NULL").select(F.explode(T.xanh_phrases(F.col("caption"))).alias("phrase"))
    return c.select("phrase", T.xanh_bucket(F.col("phrase")).alias("bucket"))


@query(f"SELECT bucket, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM (SELECT {_BUCKET} AS bucket FROM ({_XANH})) GROUP BY bucket")
def ambiguity_buckets(spark, d):
    g = _phrases(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"SELECT phrase, count(*) AS n FROM ({_XANH}) GROUP BY phrase ORDER BY n DESC, phrase LIMIT 12")
def ambiguity_top_phrases(spark, d):
    return reports.top_values(_phrases(spark, d), "phrase", 12)


_VI = "CASE WHEN regexp_matches(lower(text), '[ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]') THEN 'accented' ELSE 'plain' END"


@query(
    f"""SELECT {_VI} AS kind, count(*) AS texts, count(*) FILTER ({" OR ".join(f"contains(lower(text), '{g}')" for g in L.GENDERED_NOUNS)}) AS vi_gendered_substring,
count(*) FILTER (regexp_matches(lower(text), '(^|[^a-z])({"|".join(L.EN_GENDERED)})([^a-z]|$)')) AS en_gendered, count(*) FILTER (regexp_matches(lower(text), '(^|[^a-z])({"|".join(L.EN_NEUTRAL)})([^a-z]|$)')) AS en_neutral,
CAST(sum(len(regexp_extract_all(lower(text), 'xanh'))) AS BIGINT) AS xanh FROM documents WHERE text IS NOT NULL GROUP BY 1"""
)
def lang_compare(spark, d):
    """Corpus statistics; the Vietnamese gender test is by substring, as published."""
    t = F.lower("text")
    word = lambda xs: t.rlike(f"(^|[^a-z])({'|'.join(xs)})([^a-z]|$)")
    sub = None
    for g in L.GENDERED_NOUNS:
        sub = t.contains(g) if sub is None else sub | t.contains(g)
    dd = load(spark, d, "documents").where("text IS NOT NULL")
    return dd.groupBy(F.when(T.looks_vietnamese(F.col("text")), "accented").otherwise("plain").alias("kind")).agg(
        F.count("*").alias("texts"), F.count_if(sub).alias("vi_gendered_substring"), F.count_if(word(L.EN_GENDERED)).alias("en_gendered"), F.count_if(word(L.EN_NEUTRAL)).alias("en_neutral"), F.sum(F.regexp_count(t, F.lit("xanh"))).cast("long").alias("xanh")
    )


_WORDS = "SELECT unnest(regexp_extract_all(lower(caption), '\\p{L}+')) AS word FROM captions WHERE caption IS NOT NULL"


def _vocab(spark, d, system=None):
    c = load(spark, d, "captions").where("caption IS NOT NULL")
    if system is not None:
        c = c.where((F.col("system_name") == REFERENCE) if system else (F.col("system_name") != REFERENCE))
    return c.select(F.explode(T.words(F.col("caption"))).alias("word"))


@query(f"SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) + 3 AS INTEGER) AS id FROM (SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word HAVING count(*) >= 5) ORDER BY n DESC, word LIMIT 1000")
def vocab_topn(spark, d):
    """Vocabulary of words seen five times, four ids kept for specials; a report of the first thousand."""
    top = _vocab(spark, d).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5").orderBy(F.desc("n"), "word").limit(1000)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) + 3).cast("int"))


@query(
    f"""WITH v AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(caption), '\\p{{L}}+')) AS word FROM captions WHERE caption IS NOT NULL AND system_name = '{REFERENCE}')),
t AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(caption), '\\p{{L}}+')) AS word FROM captions WHERE caption IS NOT NULL AND system_name <> '{REFERENCE}') GROUP BY word)
SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (v.word IS NULL), 0) AS BIGINT) AS unknown, round(coalesce(sum(n) FILTER (v.word IS NULL), 0) * 1.0 / sum(n), 6) AS unk_rate FROM t LEFT JOIN v ON t.word = v.word"""
)
def vocab_unk_coverage(spark, d):
    known = _vocab(spark, d, True).distinct().withColumn("known", F.lit(True))
    t = _vocab(spark, d, False).groupBy("word").agg(F.count("*").alias("n")).join(known, "word", "left")
    g = t.agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
    return g.withColumn("unk_rate", reports.rate(F.col("unknown"), F.col("tokens")))


@query("SELECT system_name, count(*) FILTER (regexp_matches(caption, '[\\x{4e00}-\\x{9fff}]')) AS cjk, count(*) AS n, round(100.0 * count(*) FILTER (regexp_matches(caption, '[\\x{4e00}-\\x{9fff}]')) / count(*), 3) AS pct FROM captions WHERE caption IS NOT NULL GROUP BY system_name")
def cjk_leak(spark, d):
    c = load(spark, d, "captions").where("caption IS NOT NULL")
    return c.groupBy("system_name").agg(F.count_if(T.has_cjk(F.col("caption"))).alias("cjk"), F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("cjk") / F.col("n"), 3))


CLASS_TERMS = {"boat": ["chiếc ghe", "mái chèo"], "bicycle": ["xe đạp"], "dog": ["con chó"], "cat": ["con mèo"], "book": ["chồng sách"], "umbrella": ["cầm ô", "che ô"], "chair": ["ghế nhựa"], "clay jar": ["bình gốm", "ấm trà"]}


@query(
    "WITH t(class, phrase) AS (VALUES "
    + ", ".join(f"('{k}', '{p}')" for k, v in CLASS_TERMS.items() for p in v)
    + "), c AS (SELECT caption_id, system_name, ' ' || regexp_replace(lower(caption), '[^\\p{L}]', ' ', 'g') || ' ' AS s FROM captions WHERE caption IS NOT NULL) SELECT system_name, class, count(DISTINCT caption_id) AS captions FROM c JOIN t ON contains(s, ' ' || phrase || ' ') GROUP BY system_name, class"
)
def class_match(spark, d):
    """Captions per class of a phrase list; a phrase counts between non-letters, nested phrases all count."""
    s = F.concat(F.lit(" "), F.regexp_replace(F.lower("caption"), r"[^\p{L}]", " "), F.lit(" "))
    hit = lambda ps: sum((s.contains(f" {p} ").cast("int") for p in ps), F.lit(0)) > 0
    classes = F.array_compact(F.array(*[F.when(hit(v), k) for k, v in CLASS_TERMS.items()]))
    return load(spark, d, "captions").where("caption IS NOT NULL").select("system_name", F.explode(classes).alias("class")).groupBy("system_name", "class").agg(F.count("*").alias("captions"))


@query(
    """WITH m AS (SELECT greatest(max(counting), 1) mc, greatest(max(colour), 1) mo, greatest(max(gendered), 1) mg, greatest(max(entity_richness), 1) me FROM images)
SELECT image_id, round(coalesce(counting, 0) * 1.0 / mc + coalesce(colour, 0) * 1.0 / mo + coalesce(gendered, 0) * 1.0 / mg + coalesce(entity_richness, 0) * 1.0 / me + 0.5 * coalesce(xanh, 0) / mo, 4) AS challenge FROM images, m ORDER BY challenge DESC, image_id LIMIT 50"""
)
def challenge_topk(spark, d):
    """Images by their signals, each against its maximum, and half a point of xanh against the colour maximum."""
    i = load(spark, d, "images")
    most = i.agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"most_{c}") for c in ("counting", "colour", "gendered", "entity_richness")])
    one = F.lit(1).alias("_one")
    i = i.select("*", one).join(F.broadcast(most.select("*", one)), "_one")  # one row
    part = lambda c, by: F.coalesce(F.col(c), F.lit(0)) / F.col(f"most_{by}")
    score = part("counting", "counting") + part("colour", "colour") + part("gendered", "gendered") + part("entity_richness", "entity_richness") + 0.5 * part("xanh", "colour")
    return i.select("image_id", F.round(score, 4).alias("challenge")).orderBy(F.desc("challenge"), "image_id").limit(50)


_FAB = "|".join(x.replace(" ", "  ") for x in L.CHALLENGE_GENDERED)


def _gendered_sql(text: str) -> str:
    """Gendered nouns of a text; words between single blanks become words between two, so that neighbours share none."""
    return f"list_distinct(regexp_extract_all(regexp_replace(' ' || lower({text}) || ' ', '[^\\p{{L}}\\p{{N}}_]', '\\0\\0', 'g'), '[^\\p{{L}}\\p{{N}}_]({_FAB})[^\\p{{L}}\\p{{N}}_]', 1))"


@query(
    f"""WITH raw AS (SELECT caption_id, image_id, system_name, {_objects("caption")} AS objs, {_gendered_sql("caption")} AS gens FROM captions WHERE caption IS NOT NULL AND image_id IS NOT NULL),
gold AS (SELECT image_id, list_distinct(flatten(list(objs))) AS gold, list_distinct(flatten(list(gens))) AS gold_gens FROM raw WHERE system_name = '{REFERENCE}' GROUP BY image_id),
x AS (SELECT system_name, len(objs) AS m, len(list_filter(objs, lambda o: NOT list_contains(gold, o))) AS h, len(list_filter(gens, lambda o: NOT list_contains(gold_gens, o))) > 0 AS fab, counting, colour, xanh, gendered FROM raw JOIN gold USING (image_id) JOIN images USING (image_id) WHERE system_name <> '{REFERENCE}'),
g AS (SELECT *, unnest(list_filter(['all', CASE WHEN counting > 0 THEN 'counting' END, CASE WHEN colour > 0 THEN 'colour' END, CASE WHEN xanh > 0 THEN 'xanh' END, CASE WHEN gendered > 0 THEN 'gender' END], lambda x: x IS NOT NULL)) AS grp FROM x)
SELECT grp, system_name, count(*) AS n, CAST(sum(m) AS BIGINT) AS mentions, round(sum(h) * 1.0 / nullif(sum(m), 0), 6) AS chair_i, round(100.0 * count(*) FILTER (fab) / count(*), 3) AS gender_fab_pct FROM g GROUP BY grp, system_name"""
)
def challenge_groups(spark, d):
    """Per group of images: raw object mentions, the share of them that no reference has, and captions with a gendered noun that none has."""
    preds, refs = _split(spark, d)
    has = lambda x: x.where("caption IS NOT NULL AND image_id IS NOT NULL").select("image_id", "system_name", T.object_mentions(F.col("caption")).alias("objs"), T.whole_terms(F.col("caption"), L.CHALLENGE_GENDERED).alias("gens"))
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    gold = has(refs).groupBy("image_id").agg(union("objs").alias("gold"), union("gens").alias("gold_gens"))
    i = load(spark, d, "images").select("image_id", F.array_compact(F.array(F.lit("all"), *[F.when(F.col(c) > 0, n) for c, n in (("counting", "counting"), ("colour", "colour"), ("xanh", "xanh"), ("gendered", "gender"))])).alias("grps"))
    s = has(preds).join(gold, "image_id").join(i, "image_id")
    s = s.select("system_name", F.size("objs").alias("m"), F.size(F.filter("objs", lambda o: ~F.array_contains("gold", o))).alias("h"), (F.size(F.array_except("gens", "gold_gens")) > 0).alias("fab"), F.explode("grps").alias("grp"))
    g = s.groupBy("grp", "system_name").agg(F.count("*").alias("n"), F.sum("m").cast("long").alias("mentions"), F.sum("h").cast("long").alias("h"), F.count_if("fab").alias("f"))
    return g.select("grp", "system_name", "n", "mentions", reports.rate(F.col("h"), F.col("mentions")).alias("chair_i"), F.round(100.0 * F.col("f") / F.col("n"), 3).alias("gender_fab_pct"))


@query(
    f"""WITH t AS (SELECT trim(regexp_replace(lower(response), '\\s+', ' ', 'g'), ' ') AS s FROM sft_pairs WHERE response IS NOT NULL), w AS (SELECT s, string_split(s, ' ') AS w FROM t)
SELECT CASE WHEN {" OR ".join(f"contains(s, '{m}')" for m in L.UNSURE)} THEN 'uncertain' WHEN trim(w[1], '.,!?:;') IN ({", ".join(f"'{x}'" for x in L.NO)}) THEN 'no' WHEN trim(w[1], '.,!?:;') IN ({", ".join(f"'{x}'" for x in L.YES)}) THEN 'yes' WHEN list_has_any(w, {_list(L.NO)}) THEN 'no' WHEN list_has_any(w, {_list(L.YES)}) THEN 'yes' ELSE 'uncertain' END AS polarity, count(*) AS n FROM w GROUP BY 1"""
)
def answer_polarity(spark, d):
    """The polarity of responses, read as answers to a probe."""
    p = load(spark, d, "sft_pairs").where("response IS NOT NULL")
    return p.groupBy(T.yes_no(F.col("response")).alias("polarity")).agg(F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT caption_id, string_split(trim(regexp_replace(lower(caption), '\\s+', ' ', 'g')), ' ') AS w FROM captions WHERE caption IS NOT NULL)
SELECT caption_id FROM w WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0"""
)
def dup_adjacent_words(spark, d):
    return load(spark, d, "captions").where("caption IS NOT NULL").where(T.adjacent_duplicate(F.col("caption"))).select("caption_id")


@query("SELECT image_id, lower(trim(caption, ' ')) AS key, min(caption_id) AS caption_id, count(*) AS copies FROM captions WHERE caption IS NOT NULL AND trim(caption, ' ') <> '' AND image_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def dedup_first_wins(spark, d):
    c = load(spark, d, "captions").where("caption IS NOT NULL AND trim(caption) <> '' AND image_id IS NOT NULL")
    return c.groupBy("image_id", F.lower(F.trim("caption")).alias("key")).agg(F.min("caption_id").alias("caption_id"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT image_id, system_name, arg_min(caption, caption_id) AS caption FROM captions WHERE caption IS NOT NULL AND image_id IS NOT NULL GROUP BY image_id, system_name")
def first_per_key(spark, d):
    c = load(spark, d, "captions").where("caption IS NOT NULL AND image_id IS NOT NULL")
    return joins.first_per_key(c, ["image_id", "system_name"], F.col("caption_id"), "caption")


@query("SELECT image_id, system_name, arg_max(caption, shard * 1000000000000 + caption_id) AS caption FROM captions WHERE caption IS NOT NULL AND image_id IS NOT NULL GROUP BY image_id, system_name")
def shards_last_wins(spark, d):
    c = load(spark, d, "captions").where("caption IS NOT NULL AND image_id IS NOT NULL")
    return joins.last_per_key(c, ["image_id", "system_name"], F.struct("shard", "caption_id"), "caption")


@query(
    """WITH s AS (SELECT image_id, system_name, arg_min(caption, caption_id) FILTER (gen_mode = 'short') AS short, arg_min(caption, caption_id) FILTER (gen_mode = 'detailed') AS detailed FROM captions WHERE caption IS NOT NULL AND image_id IS NOT NULL GROUP BY image_id, system_name)
SELECT image_id, system_name, coalesce(nullif(short, ''), detailed) AS rendered FROM s"""
)
def render_short_or_detailed(spark, d):
    c = load(spark, d, "captions").where("caption IS NOT NULL AND image_id IS NOT NULL")
    of = lambda m: F.min_by(F.when(F.col("gen_mode") == m, F.col("caption")), F.when(F.col("gen_mode") == m, F.col("caption_id")))
    g = c.groupBy("image_id", "system_name").agg(of("short").alias("s"), of("detailed").alias("l"))
    return g.select("image_id", "system_name", F.coalesce(F.nullif("s", F.lit("")), "l").alias("rendered"))


@query("SELECT count(*) AS missing FROM (SELECT DISTINCT image_id FROM captions WHERE image_id IS NOT NULL) c ANTI JOIN images i ON c.image_id = i.image_id")
def antijoin_missing(spark, d):
    return load(spark, d, "captions").where("image_id IS NOT NULL").select("image_id").distinct().join(load(spark, d, "images"), "image_id", "left_anti").agg(F.count("*").alias("missing"))


@query("SELECT caption_id, image_id FROM captions WHERE image_id IN (SELECT image_id FROM images WHERE split = 'test' AND difficulty IS NOT NULL)")
def semijoin_manifest(spark, d):
    m = load(spark, d, "images").where("split = 'test' AND difficulty IS NOT NULL").select("image_id")
    return load(spark, d, "captions").join(m, "image_id", "left_semi").select("caption_id", "image_id")


@query(
    """SELECT CASE WHEN s <= 1 THEN 'easy' WHEN s <= 3 THEN 'medium' ELSE 'hard' END AS band, count(*) AS images FROM (SELECT coalesce((counting > 0)::INT, 0) + coalesce((colour > 1)::INT, 0) + coalesce((xanh > 0)::INT, 0) + coalesce((gendered > 0)::INT, 0) + coalesce((entity_richness > 5)::INT, 0) AS s FROM images) GROUP BY 1"""
)
def difficulty_bands(spark, d):
    on = lambda c, v: F.coalesce((F.col(c) > v).cast("int"), F.lit(0))
    s = on("counting", 0) + on("colour", 1) + on("xanh", 0) + on("gendered", 0) + on("entity_richness", 5)
    return load(spark, d, "images").groupBy(F.when(s <= 1, "easy").when(s <= 3, "medium").otherwise("hard").alias("band")).agg(F.count("*").alias("images"))


@query(
    f"""WITH t AS (SELECT caption_id, system_name, image_id, regexp_extract_all(lower(caption), '\\p{{L}}+') AS w FROM captions WHERE caption IS NOT NULL AND image_id IS NOT NULL),
r AS (SELECT row_number() OVER () AS rid, image_id, w FROM (SELECT DISTINCT image_id, w FROM t WHERE system_name = '{REFERENCE}')),
c AS (SELECT * FROM t WHERE system_name <> '{REFERENCE}' AND image_id IN (SELECT image_id FROM r)),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
cg AS (SELECT caption_id, system_name, image_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM c, ns),
rg AS (SELECT rid, image_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM r, ns),
ck AS (SELECT caption_id, system_name, image_id, n, g, count(*) AS k FROM cg GROUP BY ALL),
rk AS (SELECT image_id, n, g, max(k) AS k FROM (SELECT rid, image_id, n, g, count(*) AS k FROM rg GROUP BY ALL) GROUP BY ALL),
m AS (SELECT system_name, n, sum(least(ck.k, coalesce(rk.k, 0))) AS matched FROM ck LEFT JOIN rk USING (image_id, n, g) GROUP BY system_name, n),
s AS (SELECT system_name, n, sum(greatest(len(w) - n + 1, 0)) AS total FROM c, ns GROUP BY system_name, n)
SELECT system_name, n, CAST(coalesce(matched, 0) AS BIGINT) AS matched, CAST(total AS BIGINT) AS total, round(coalesce(matched, 0) * 1.0 / nullif(total, 0), 6) AS precision FROM s LEFT JOIN m USING (system_name, n)"""
)
def ngram_bleu_counts(spark, d):
    """Clipped matches against all references of an image."""
    preds, refs = (x.where("caption IS NOT NULL AND image_id IS NOT NULL").withColumn("tokens", T.words(F.col("caption"))) for x in _split(spark, d))
    return reports.ngram_matches_of_many(preds, refs, "image_id", "tokens", ["system_name"])


@query(
    f"""WITH c AS (SELECT caption_id, {_canonical('noun')} AS noun FROM (SELECT caption_id, unnest({_objects('caption')}) AS noun FROM captions WHERE caption IS NOT NULL)) SELECT noun, count(*) AS n, count(DISTINCT caption_id) AS captions FROM c GROUP BY noun"""
)
def canonical_objects(spark, d):
    c = load(spark, d, "captions").where("caption IS NOT NULL").select("caption_id", F.explode(T.object_mentions(F.col("caption"))).alias("noun"))
    return c.withColumn("noun", T.canonical(F.col("noun"))).groupBy("noun").agg(F.count("*").alias("n"), F.countDistinct("caption_id").alias("captions"))


@query(
    """SELECT config, count(*) AS captions, count(DISTINCT c.image_id) AS images, any_value(fits) AS fits, any_value(max_allocated_gb) AS max_allocated_gb, round(avg(length(caption)), 4) AS mean_chars FROM captions c JOIN vram_runs v USING (config) WHERE caption IS NOT NULL GROUP BY config"""
)
def vram_runs_with_captions(spark, d):
    c = load(spark, d, "captions").where("caption IS NOT NULL").groupBy("config").agg(F.count("*").alias("captions"), F.countDistinct("image_id").alias("images"), F.round(F.avg(F.length("caption")), 4).alias("mean_chars"))
    return c.join(load(spark, d, "vram_runs").select("config", "fits", "max_allocated_gb"), "config").select("config", "captions", "images", "fits", "max_allocated_gb", "mean_chars")


@query(
    """WITH v AS (SELECT system_name, gen_mode, list(gen_seconds ORDER BY gen_seconds) AS s FROM captions WHERE gen_seconds IS NOT NULL GROUP BY system_name, gen_mode),
q AS (SELECT *, len(s) AS n, 0.9 * (len(s) + 1) AS a, CAST(least(greatest(floor(0.9 * (len(s) + 1)), 1), greatest(len(s) - 1, 1)) AS BIGINT) AS j FROM v)
SELECT system_name, gen_mode, n, round(list_avg(s), 6) AS mean_s, round(list_median(s), 6) AS median_s, round(s[j] + (a - j) * (s[least(j + 1, n)] - s[j]), 6) AS p90_s, s[1] AS min_s, s[n] AS max_s FROM q"""
)
def latency_quantiles(spark, d):
    """Latency per mode with the exclusive 90th percentile.

    The exact p90 needs two order statistics; they come from a rank over each mode's times, computed where a global
    sort by mode and time puts them, so that no mode is gathered in one row.
    """
    c = load(spark, d, "captions").where("gen_seconds IS NOT NULL").select("system_name", "gen_mode", "gen_seconds")
    g = c.groupBy("system_name", "gen_mode").agg(F.count("*").alias("n"), F.avg("gen_seconds").alias("mean_s"), F.percentile("gen_seconds", F.lit(0.5)).alias("median_s"), F.min("gen_seconds").alias("min_s"), F.max("gen_seconds").alias("max_s"))
    # position p (n + 1) of the exclusive method, as a fraction of the linear method's n - 1 steps
    counts = c.groupBy("system_name", "gen_mode", "gen_seconds").agg(F.count("*").alias("k"))
    w = Window.partitionBy("system_name", "gen_mode").orderBy("gen_seconds")
    cum = counts.withColumn("hi", F.sum("k").over(w)).withColumn("lo", F.col("hi") - F.col("k") + 1)
    at = F.lit(0.9) * (F.col("n") + 1)
    j = cum.join(g.select("system_name", "gen_mode", at.alias("at"), "n"), ["system_name", "gen_mode"])
    base = F.least(F.greatest(F.floor("at"), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
    nxt = F.least(base + 1, F.col("n"))
    pick = lambda p: F.max(F.when((F.col("lo") <= p) & (p <= F.col("hi")), F.col("gen_seconds")))
    q = j.groupBy("system_name", "gen_mode").agg(pick(base).alias("a"), pick(nxt).alias("b"), F.first(F.col("at") - base).alias("f"))
    return g.join(q, ["system_name", "gen_mode"]).select("system_name", "gen_mode", "n", F.round("mean_s", 6).alias("mean_s"), F.round("median_s", 6).alias("median_s"), F.round(F.col("a") + F.col("f") * (F.col("b") - F.col("a")), 6).alias("p90_s"), "min_s", "max_s")


@query(
    """WITH c AS (SELECT caption_id, lower(caption) AS t FROM captions WHERE caption IS NOT NULL) SELECT coalesce("""
    + ", ".join(f"CASE WHEN contains(t, '{m}') THEN '{k}' END" for m, k in L.NON_VISUAL_MARKERS.items())
    + """, 'none') AS kind, count(*) AS captions FROM c GROUP BY 1"""
)
def epistemic_kinds(spark, d):
    c = load(spark, d, "captions").where("caption IS NOT NULL")
    return c.groupBy(F.coalesce(T.epistemic(F.col("caption"), F.lit(True))["kind"], F.lit("none")).alias("kind")).agg(F.count("*").alias("captions"))


@query("SELECT substr(sha256(prompt), 1, 16) AS prompt_hash, caption_variant, count(*) AS pairs, count(*) FILTER (response IS NULL OR trim(response, ' ') = '') AS empty FROM sft_pairs WHERE prompt IS NOT NULL GROUP BY 1, 2")
def sft_prompt_groups(spark, d):
    p = load(spark, d, "sft_pairs").where("prompt IS NOT NULL")
    return p.groupBy(T.prompt_hash(F.col("prompt")).alias("prompt_hash"), "caption_variant").agg(F.count("*").alias("pairs"), F.count_if(F.col("response").isNull() | (F.trim("response") == "")).alias("empty"))


@query(
    """WITH m AS (SELECT image_id, caption_variant, arg_min(response, pair_id) AS r FROM sft_pairs WHERE response IS NOT NULL AND trim(response, ' ') <> '' GROUP BY image_id, caption_variant)
SELECT a.image_id, a.r AS chosen, b.r AS rejected FROM m a JOIN m b ON a.image_id = b.image_id AND a.caption_variant = 'detailed' AND b.caption_variant = 'short' WHERE a.r <> b.r"""
)
def preference_pairs(spark, d):
    """Detailed responses chosen over short ones of the same image, both there and different."""
    p = load(spark, d, "sft_pairs").where("response IS NOT NULL AND trim(response) <> ''")
    m = joins.first_per_key(p, ["image_id", "caption_variant"], F.col("pair_id"), "response")
    a, b = (m.where(F.col("caption_variant") == v).select("image_id", F.col("response").alias(n)) for v, n in (("detailed", "chosen"), ("short", "rejected")))
    return a.join(b, "image_id").where("chosen <> rejected")
