"""Queries of the rule engine, pair operators and samples over the star-schema tables, each with its SQL.

Roles: a line item is a claim with scores (discount, tax and quantity scaled to [0, 1]), its order a record, an
event a recorded probe, a part a selection candidate, the region - nation - customer chain the category lattice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import lexicon as L
from ..operators import folds, joins, reports, rules, similarity
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
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    s, c, e = F.col("l_quantity") / 50.0, F.col("l_discount") * 8, F.col("l_tax") * 12.5
    return li.withColumns({"s": F.when(F.col("l_linenumber") % 7 != 0, s), "c": c, "e": F.when(F.col("l_linenumber") % 5 != 0, e)})


_CL = "WITH cl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity / 50.0 END AS s, l_discount * 8 AS c, CASE WHEN l_linenumber % 5 <> 0 THEN l_tax * 12.5 END AS e FROM lineitem)\n"
_BRANCH = "CASE WHEN e IS NULL OR e < 0.35 THEN 'gate' WHEN c >= 0.60 THEN 'contradiction' WHEN s IS NULL THEN 'no_support_signal' WHEN s >= 0.70 AND c <= 0.20 THEN 'support' WHEN s <= 0.35 THEN 'no_support' ELSE 'unclear' END"
_TO = "CASE branch WHEN 'contradiction' THEN 'REJECTED' WHEN 'no_support' THEN 'REJECTED' WHEN 'support' THEN 'SUPPORTED' ELSE 'UNCERTAIN' END"
_DEC = _CL + f", de AS (SELECT *, {_BRANCH} AS branch FROM cl), dv AS (SELECT *, {_TO} AS verdict FROM de)\n"


def _decided(spark, d):
    return _claims(spark, d).withColumn("d", rules.decide(F.col("s"), F.col("c"), F.col("e"))).withColumns({"verdict": F.col("d.verdict"), "branch": F.col("d.branch")}).drop("d")


@query(_DEC + "SELECT verdict, branch, count(*) AS n FROM dv GROUP BY verdict, branch")
def verdict_decide(spark, d):
    return _decided(spark, d).groupBy("verdict", "branch").agg(F.count("*").alias("n"))


_CONFIGS = (("full", True, True, "UNCERTAIN"), ("no_evidence", False, True, "UNCERTAIN"), ("no_contradiction", True, False, "UNCERTAIN"), ("binary_supported", True, True, "SUPPORTED"), ("binary_rejected", True, True, "REJECTED"))


def _ablation_sql() -> str:
    parts = []
    for k, (name, ev, co, un) in enumerate(_CONFIGS):
        b = _BRANCH.replace("e IS NULL OR e < 0.35", "e IS NULL OR e < 0.35" if ev else "false").replace("c >= 0.60", "c >= 0.60" if co else "false").replace("c <= 0.20", "c <= 0.20" if co else "true")
        parts.append(f"SELECT {k} AS ord, '{name}' AS config, CASE WHEN verdict = 'UNCERTAIN' THEN '{un}' ELSE verdict END AS verdict FROM (SELECT {_TO} AS verdict FROM (SELECT {b} AS branch FROM cl))")
    return _CL + ", v AS (" + " UNION ALL ".join(parts) + "), g AS (SELECT ord, config, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (verdict = 'REJECTED') AS rejected, round(100.0 * count(*) FILTER (verdict = 'SUPPORTED') / count(*), 6) AS pct FROM v GROUP BY ord, config) SELECT config, supported, uncertain, rejected, pct, round(pct - first_value(pct) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS delta FROM g"


@query(_ablation_sql())
def verdict_ablation(spark, d):
    """The verdicts under ablated rules in one scan: every claim is decided under all configurations at once."""
    c = _claims(spark, d)
    s, co, e = F.col("s"), F.col("c"), F.col("e")
    one = lambda ev, con, un: rules.binary(rules.decide(s, co if con else F.lit(0.0), e if ev else F.lit(1.0))["verdict"], un)
    v = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("config"), one(ev, con, un).alias("verdict")) for k, (n, ev, con, un) in enumerate(_CONFIGS)])).alias("x")).select("x.*")
    g = v.groupBy("ord", "config").agg(*[F.count_if(F.col("verdict") == x.upper()).alias(x) for x in ("supported", "uncertain", "rejected")], F.count("*").alias("n"))
    g = g.select("ord", "config", "supported", "uncertain", "rejected", F.round(100.0 * F.col("supported") / F.col("n"), 6).alias("pct"))
    return reports.deltas(g, "ord", "pct").drop("ord")


@query(_CL + "SELECT l_orderkey, l_linenumber, round((coalesce(s * 0.6, 0) + coalesce(e * 0.2, 0) + c * 0.2) / (CASE WHEN s IS NOT NULL THEN 0.6 ELSE 0 END + CASE WHEN e IS NOT NULL THEN 0.2 ELSE 0 END + 0.2), 6) AS support FROM cl")
def scores_combine_null(spark, d):
    return _claims(spark, d).select("l_orderkey", "l_linenumber", F.round(rules.support_score(F.col("s"), F.col("e"), F.col("c")), 6).alias("support"))


@query(_CL + "SELECT l_orderkey, l_linenumber, round(least(coalesce(s, 9), coalesce(greatest(e, c), c)), 6) AS evidence FROM cl")
def evidence_limits(spark, d):
    return _claims(spark, d).select("l_orderkey", "l_linenumber", F.round(rules.evidence([F.col("s")], [F.col("e"), F.col("c")]), 6).alias("evidence"))


@query(_DEC + "SELECT CASE WHEN verdict = 'REJECTED' THEN 'REJECTED' WHEN l_quantity > 5 AND l_returnflag = 'N' OR l_linestatus = 'F' THEN 'UNCERTAIN' ELSE verdict END AS capped, verdict, count(*) AS n FROM dv GROUP BY 1, 2")
def ceiling_min_rank(spark, d):
    """Ceilings lower a verdict: exact counts beyond the limit, and inferred claims, may at most be uncertain."""
    v = _decided(spark, d)
    cap = lambda c: F.when(c, "UNCERTAIN")
    capped = rules.cap(F.col("verdict"), [cap((F.col("l_quantity") > L.EXACT_COUNT_LIMIT) & (F.col("l_returnflag") == "N")), cap(F.col("l_linestatus") == "F")])
    return v.groupBy(capped.alias("capped"), "verdict").agg(F.count("*").alias("n"))


@query(
    _DEC
    + """, ord AS (SELECT l_orderkey, bool_or(l_linenumber = 1 AND verdict = 'REJECTED') AS parent FROM dv GROUP BY l_orderkey)
SELECT CASE WHEN parent AND l_linenumber > 1 THEN CASE WHEN verdict = 'REJECTED' THEN 'PRIMARY' ELSE 'INHERITED' END WHEN verdict = 'REJECTED' THEN 'PRIMARY' ELSE 'NONE' END AS kind, count(*) AS n FROM dv JOIN ord USING (l_orderkey) GROUP BY 1"""
)
def cascade_inherit(spark, d):
    """A rejected first claim of a record rejects the others: how many rejections are their own and how many inherited."""
    v = _decided(spark, d).select("l_orderkey", "l_linenumber", "verdict")
    p = v.groupBy("l_orderkey").agg(F.bool_or((F.col("l_linenumber") == 1) & (F.col("verdict") == "REJECTED")).alias("parent"))
    kind = F.when(F.col("verdict") == "REJECTED", "PRIMARY").when(F.col("parent") & (F.col("l_linenumber") > 1), "INHERITED").otherwise("NONE")
    return v.join(p, "l_orderkey").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linenumber < b.l_linenumber AND a.l_linestatus <> b.l_linestatus")
def contradiction_edges(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    a, b = li.alias("a"), li.alias("b")
    j = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_returnflag") == F.col("b.l_returnflag")))
    return j.where("a.l_linenumber < b.l_linenumber AND a.l_linestatus <> b.l_linestatus").select(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"))


@query(
    """WITH RECURSIVE e AS (SELECT a.l_orderkey AS g, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linenumber <> b.l_linenumber AND a.l_linestatus <> b.l_linestatus),
r AS (SELECT DISTINCT g, x, x AS y FROM e UNION SELECT r.g, r.x, e.y FROM r JOIN e ON r.g = e.g AND r.y = e.x),
c AS (SELECT g, x, min(y) AS component FROM r GROUP BY g, x), k AS (SELECT g, component, count(*) AS nodes FROM c GROUP BY g, component)
SELECT nodes, count(*) AS components FROM k GROUP BY nodes"""
)
def contradiction_components(spark, d):
    """Sizes of the connected components of contradicting claims."""
    c = joins.components(contradiction_edges(spark, d), "line_a", "line_b", "l_orderkey")
    return c.groupBy("l_orderkey", "component").agg(F.count("*").alias("nodes")).groupBy("nodes").agg(F.count("*").alias("components"))


def _lattice(spark, d):
    n = load(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = load(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return n.unionByName(c)


@query("WITH e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer) SELECT child, parent AS ancestor, 1 AS steps FROM e UNION ALL SELECT a.child, b.parent, 2 FROM e a JOIN e b ON a.parent = b.child")
def hypernym_closure(spark, d):
    return joins.closure(_lattice(spark, d), 3)


@query(
    """SELECT r_name, count(*) AS compatible FROM (SELECT n_regionkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey) x JOIN (SELECT n_regionkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) y USING (n_regionkey) JOIN region ON r_regionkey = n_regionkey GROUP BY r_name"""
)
def category_compat(spark, d):
    """Pairs of entities under one root: counted from both sides' totals, never formed."""
    n = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    side = lambda t, k: load(spark, d, t).join(n, F.col(k) == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias(t))
    j = side("customer", "c_nationkey").join(side("supplier", "s_nationkey"), "n_regionkey").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("r_name", (F.col("customer") * F.col("supplier")).alias("compatible"))


@query(
    """WITH p AS (SELECT l_orderkey, l_returnflag AS k, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS r FROM lineitem WHERE l_linestatus = 'O'),
g AS (SELECT l_orderkey, l_returnflag AS k, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS r FROM lineitem WHERE l_linestatus = 'F')
SELECT p.l_orderkey, CAST(p.pos AS BIGINT) AS pred_pos, CAST(g.pos AS BIGINT) AS gold_pos FROM p JOIN g ON p.l_orderkey = g.l_orderkey AND p.k = g.k AND p.r = g.r"""
)
def align_exact(spark, d):
    """Greedy one-to-one alignment of open claims (predicted) with finished ones (gold) of the same flag."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("long").alias("pos"), "l_linestatus")
    return folds.align(li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'"), "l_orderkey", "l_returnflag", "pos")


@query("SELECT a.l_orderkey, a.l_linenumber AS claim, min(b.l_linenumber) AS first_gold FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag WHERE a.l_linestatus = 'O' AND b.l_linestatus = 'F' GROUP BY a.l_orderkey, a.l_linenumber")
def match_any_first(spark, d):
    """Each claim's first matching gold; gold is reduced to its first line per key before the join."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_linestatus")
    g = li.where("l_linestatus = 'F'").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("first_gold"))
    return li.where("l_linestatus = 'O'").join(g, ["l_orderkey", "l_returnflag"]).groupBy("l_orderkey", F.col("l_linenumber").alias("claim")).agg(F.min("first_gold").alias("first_gold"))


@query(
    """WITH h AS (SELECT l_orderkey, l_returnflag, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey, sum(o) AS claims, sum(CASE WHEN f > 0 THEN o ELSE 0 END) AS hits, sum(f) AS refs, sum(CASE WHEN o > 0 THEN f ELSE 0 END) AS covered FROM h GROUP BY 1)
SELECT CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(refs) AS BIGINT) AS refs, CAST(sum(covered) AS BIGINT) AS covered, round(sum(hits) * 1.0 / sum(claims), 6) AS micro_precision, round(sum(covered) * 1.0 / sum(refs), 6) AS micro_coverage, round(avg(hits * 1.0 / nullif(claims, 0)), 6) AS macro_precision, round(avg(covered * 1.0 / nullif(refs, 0)), 6) AS macro_coverage FROM r"""
)
def existence_matrix_pgf(spark, d):
    """Grounded factuality: which claims meet any reference and which references any claim, from counts per key."""
    li = load(spark, d, "lineitem")
    o, f = F.col("o"), F.col("f")
    h = li.groupBy("l_orderkey", "l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    r = h.groupBy("l_orderkey").agg(F.sum(o).alias("claims"), F.sum(F.when(f > 0, o).otherwise(0)).alias("hits"), F.sum(f).alias("refs"), F.sum(F.when(o > 0, f).otherwise(0)).alias("covered"))
    part = lambda a, b: F.round(F.avg(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0)))), 6)
    return r.agg(*[F.sum(c).alias(c) for c in ("claims", "hits", "refs", "covered")], part("hits", "claims").alias("macro_precision"), part("covered", "refs").alias("macro_coverage")).withColumns({"micro_precision": reports.rate(F.col("hits"), F.col("claims")), "micro_coverage": reports.rate(F.col("covered"), F.col("refs"))})


@query(
    _DEC
    + """, g AS (SELECT l_returnflag AS gold, verdict AS pred, count(*) AS n FROM dv GROUP BY 1, 2), p AS (SELECT pred, sum(n) AS pn FROM g GROUP BY 1), q AS (SELECT gold, sum(n) AS gn FROM g GROUP BY 1),
m AS (SELECT * FROM (VALUES ('A', 'SUPPORTED'), ('N', 'UNCERTAIN'), ('R', 'REJECTED')) t(gold, pred))
SELECT m.pred AS verdict, round(n * 1.0 / pn, 6) AS precision, round(n * 1.0 / gn, 6) AS recall, round(2.0 * n / (pn + gn), 6) AS f1 FROM m JOIN g USING (gold, pred) JOIN p ON p.pred = m.pred JOIN q ON q.gold = m.gold"""
)
def verification_quality(spark, d):
    """Precision, recall and F1 per verdict against gold labels in the role of return flags."""
    v = _decided(spark, d).select(F.when(F.col("l_returnflag") == "A", "SUPPORTED").when(F.col("l_returnflag") == "N", "UNCERTAIN").otherwise("REJECTED").alias("gold"), F.col("verdict").alias("pred"))
    n = v.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    c = n.select("gold", "pred", "n", F.sum("n").over(Window.partitionBy("pred")).alias("pn"), F.sum("n").over(Window.partitionBy("gold")).alias("gn")).where("gold = pred")
    return c.select(F.col("pred").alias("verdict"), reports.rate(F.col("n"), F.col("pn")).alias("precision"), reports.rate(F.col("n"), F.col("gn")).alias("recall"), F.round(2.0 * F.col("n") / (F.col("pn") + F.col("gn")), 6).alias("f1"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) / nullif(sum(l_extendedprice), 0), 6) AS coverage FROM lineitem GROUP BY l_orderkey")
def salience_coverage(spark, d):
    li = load(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.round(F.try_divide(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).otherwise(0.0)), F.nullif(F.sum("l_extendedprice"), F.lit(0.0))), 6).alias("coverage"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 + 1 AS w, l_linenumber + 0.0 AS h FROM lineitem),
p AS (SELECT a.l_orderkey, a.n AS a, c.n AS b, greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0) AS i, a.w * a.h + c.w * c.h AS s FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.n < c.n)
SELECT l_orderkey, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.5"""
)
def geometry_iou(spark, d):
    """Boxes of one record that overlap by half."""
    b = load(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 1).alias("w"), (F.col("l_linenumber") + F.lit(0.0)).alias("h"))
    p, q = b.alias("p"), b.alias("q")
    box = lambda t: [F.col(f"{t}.{c}") for c in ("x", "y", "w", "h")]
    j = p.join(q, (F.col("p.l_orderkey") == F.col("q.l_orderkey")) & (F.col("p.n") < F.col("q.n")))
    return j.select(F.col("p.l_orderkey").alias("l_orderkey"), F.col("p.n").alias("a"), F.col("q.n").alias("b"), rules.iou(box("p"), box("q")).alias("iou")).where("iou >= 0.5").withColumn("iou", F.round("iou", 6))


@query("SELECT p_type, p_partkey, round(p_retailprice / 2100.0 * (1 - p_size / 60.0), 6) AS fu FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice / 2100.0 * (1 - p_size / 60.0) DESC, p_partkey) <= 5")
def topk_per_group(spark, d):
    fu = F.col("p_retailprice") / 2100.0 * (1 - F.col("p_size") / 60.0)
    return joins.quota_sample(load(spark, d, "part").withColumn("fu", fu), "p_type", [F.desc("fu"), F.col("p_partkey")], 5).select("p_type", "p_partkey", F.round("fu", 6).alias("fu"))


@query()
def greedy_select(spark, d):
    """Budgeted selection of each order's claims; the fold is tested against brute force."""
    v = _decided(spark, d)
    c = v.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("pos"), "verdict", rules.factuality(F.col("s"), F.least(F.col("c"), F.lit(1.0)), F.col("verdict")).alias("factuality"), (F.lit(1.0) + F.col("l_quantity") / 50.0).alias("information"),
        F.col("l_returnflag").alias("type"), F.col("l_suppkey").cast("string").alias("entity"), F.lit(1.0).alias("salience"), F.col("l_partkey").cast("string").alias("text"), F.col("l_returnflag").alias("conflict_key"), F.col("l_linestatus").alias("conflict_value"),
    ).where("verdict <> 'REJECTED'")
    return folds.select_claims(c, "l_orderkey", "long")


@query(
    """WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2, 3)
SELECT user_id, day, arg_max(event_type, n * 1000000000000 - first) AS mode, round(max(n) * 1.0 / sum(n), 6) AS confidence FROM g GROUP BY user_id, day"""
)
def self_consistency_mode(spark, d):
    """The answer given most often by a user on a day and its share; ties fall to the answer seen first."""
    g = load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return g.groupBy("user_id", "day").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("mode"), F.round(F.max("n") / F.sum("n"), 6).alias("confidence"))


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS s, count(*) AS k FROM c GROUP BY 1)
SELECT user_id, round(CASE WHEN s >= 2 THEN CASE WHEN k > 1 THEN 1 + sum(n * 1.0 / s * ln(n * 1.0 / s)) / ln(least(k, s)) ELSE 1.0 END END, 6) AS stability FROM c JOIN t USING (user_id) GROUP BY user_id, s, k"""
)
def answer_stability(spark, d):
    kinds = ["view", "signup", "error", "click", "purchase"]
    p = load(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    return p.select("user_id", F.round(rules.stability([F.col(k) for k in kinds]), 6).alias("stability"))


def _log(spark, d):
    """The recorded answer of each (user, event type): the last one wins."""
    e = load(spark, d, "events")
    return joins.last_per_key(e, ["user_id", "event_type"], F.struct("ts", "event_id"), "value")


@query(
    """WITH q AS (SELECT c_custkey AS user_id, t.event_type FROM customer, (VALUES ('view'), ('click'), ('purchase')) t(event_type)),
l AS (SELECT user_id, event_type, arg_max(value, epoch_us(ts)::HUGEINT * 1000000000000 + event_id) AS value FROM events GROUP BY 1, 2)
SELECT q.user_id, q.event_type, CASE WHEN l.user_id IS NULL THEN 'inconclusive' WHEN value >= 50 THEN 'yes' ELSE 'no' END AS answer FROM q LEFT JOIN l USING (user_id, event_type)"""
)
def replay_join(spark, d):
    """Questions answered from the probe log; what it lacks is inconclusive."""
    q = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(*map(F.lit, ("view", "click", "purchase")))).alias("event_type"))
    j = q.join(_log(spark, d).withColumn("hit", F.lit(True)), ["user_id", "event_type"], "left")
    return j.select("user_id", "event_type", F.when(F.col("hit").isNull(), "inconclusive").when(F.col("value") >= 50, "yes").otherwise("no").alias("answer"))


@query(
    """WITH f AS (SELECT user_id, event_type, arg_min(value, epoch_us(ts)::HUGEINT * 1000000000000 + event_id) AS a, arg_max(value, epoch_us(ts)::HUGEINT * 1000000000000 + event_id) AS b FROM events GROUP BY 1, 2),
v AS (SELECT CASE WHEN a >= 50 THEN 'yes' ELSE 'no' END AS before, CASE WHEN b >= 50 THEN 'yes' ELSE 'no' END AS after FROM f)
SELECT before, after, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY before, after"""
)
def replay_fidelity(spark, d):
    """Shifts between first and replayed answers; their diagonal is the fidelity."""
    o = F.struct("ts", "event_id")
    g = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("value", o).alias("a"), F.max_by("value", o).alias("b"))
    yes = lambda c: F.when(F.col(c) >= 50, "yes").otherwise("no")
    n = g.groupBy(yes("a").alias("before"), yes("b").alias("after")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_ROUNDS = 1000


@query()
def bootstrap_ci(spark, d):
    """Percentile interval of a ratio of sums over resampled ids; the draws are tested by their mean and variance."""
    s = load(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").alias("num"), F.col("l_tax").alias("den"))
    r = reports.bootstrap_sums(s, "l_orderkey", ["num", "den"], _ROUNDS).select(F.try_divide("num", F.nullif("den", F.lit(0.0))).alias("v"))
    return r.agg(F.round(F.percentile("v", F.lit(0.025)), 5).alias("lo"), F.round(F.percentile("v", F.lit(0.975)), 5).alias("hi"), F.count("*").alias("rounds"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY (doc_id + 42) * 2654435761 % 4294967296, doc_id) <= 10")
def stratified_quota(spark, d):
    doc = load(spark, d, "documents").select("doc_id", "source")
    return joins.quota_sample(doc, "source", [joins.pseudo_random(F.col("doc_id")), F.col("doc_id")], 10).select("doc_id", "source")


@query("SELECT shard, count(*) AS n FROM (SELECT doc_id % 8 AS shard FROM documents) GROUP BY shard")
def modulo_shard(spark, d):
    return load(spark, d, "documents").groupBy((F.col("doc_id") % 8).alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def case_limit(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority", "o_custkey", "o_orderkey", "o_totalprice")
    return joins.quota_sample(o, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderpriority", "o_custkey", "o_orderkey")


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.from_json("props", "k int")["k"]
    return load(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    """SELECT CAST(count(*) AS BIGINT) AS eligible, round(avg(value), 6) AS mean FROM events WHERE event_type IN ('view', 'click') AND value / 100.0 >= 0.9 AND CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL"""
)
def uncap_eligible(spark, d):
    """The gate of the offline update: claim types, grounding and evidence all there."""
    e = load(spark, d, "events").where(F.col("event_type").isin("view", "click") & (F.col("value") / 100.0 >= L.UNCAP_GROUNDING) & F.from_json("props", "k int")["k"].isNotNull())
    return e.agg(F.count("*").alias("eligible"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    e = load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1")
def window_sliding(spark, d):
    e = load(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "n")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def window_session(spark, d):
    e = load(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@query(
    """WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len FROM embeddings)
SELECT q.vec_id AS query, b.vec_id AS vec_id FROM n q JOIN n b ON q.vec_id <> b.vec_id AND q.vec_id % 100 = 0 WHERE list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (q.len * b.len) >= 0.2"""
)
def redundancy_above_rho(spark, d):
    """Cosine similarity of a stated query set (ids divisible by 100) against all vectors."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return similarity.above(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 0.2).select(F.col("query").alias("query"), F.col("id").alias("vec_id"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS x, l_discount * 500 AS y, 6.0 AS s FROM lineitem),
p AS (SELECT (a.x - c.x) / 50.0 AS dx, (a.y - c.y) / 50.0 AS dy FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.n < c.n),
r AS (SELECT unnest(['bên_trái', 'trên', 'phía_trước']) AS rel, dx, dy FROM p)
SELECT rel, CASE rel WHEN 'bên_trái' THEN CASE WHEN abs(dx) >= 0.03 THEN CASE WHEN dx < 0 THEN 'yes' ELSE 'no' END ELSE 'undecided' END WHEN 'trên' THEN CASE WHEN abs(dy) >= 0.03 THEN CASE WHEN dy < 0 THEN 'yes' ELSE 'no' END ELSE 'undecided' END ELSE 'undecided' END AS outcome, count(*) AS n FROM r GROUP BY 1, 2"""
)
def geometry_relations(spark, d):
    """What boxes say of three relations between the claims of a record."""
    from ..operators.claims import geometry

    b = load(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.array(F.col("l_quantity"), F.col("l_discount") * 500, F.lit(6.0), F.lit(6.0)).alias("box"))
    p, q = b.alias("p"), b.alias("q")
    j = p.join(q, F.col("p.l_orderkey") == F.col("q.l_orderkey")).where("p.n < q.n")
    j = j.select(F.col("p.box").alias("s"), F.col("q.box").alias("o"), F.explode(F.array(*map(F.lit, ("bên_trái", "trên", "phía_trước")))).alias("rel"))
    g = geometry(F.col("rel"), F.col("s"), F.col("o"), F.lit(50.0), F.lit(50.0))
    return j.groupBy("rel", F.when(g.isNull(), "undecided").when(g, "yes").otherwise("no").alias("outcome")).agg(F.count("*").alias("n"))
