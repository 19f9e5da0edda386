"""Aggregation reports. Rates with an empty denominator are null, never 0."""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as L
from ..functions import text as T


def rate(n: Column, d: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(n.cast("double"), F.nullif(d, F.lit(0))), digits)


def gold_objects(refs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gold): canonical objects of all reference captions of a key with their hypernyms.

    References are reduced to distinct objects before the shuffle completes, so a key with very many references
    costs no more than its distinct nouns. Null keys and texts are left out.
    """
    ancestors = T.literal_map({n: "|".join(L.ancestors(n)) for n in L.HYPERNYMS})
    d = refs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.explode(F.array_distinct(T.object_mentions(F.col(text)))).alias("noun"))
    d = d.select(key, T.canonical(F.col("noun")).alias("noun")).distinct()
    d = d.select(key, F.explode(F.split(F.coalesce(ancestors[F.col("noun")], F.col("noun")), r"\|")).alias("noun"))
    return d.groupBy(key).agg(F.collect_set("noun").alias("gold"))


def chair_mentions(preds: DataFrame, gold: DataFrame, key: str, text: str) -> DataFrame:
    """Predictions with a gold set: ``mentioned`` (distinct objects) and ``halluc`` (those not in gold).

    Predictions without references are not scored. Gold holds the hypernyms, so a vaguer noun passes and a more
    specific one does not.
    """
    d = preds.where(F.col(text).isNotNull()).join(gold, key)
    d = d.withColumn("mentioned", F.array_distinct(T.object_mentions(F.col(text))))
    return d.withColumn("halluc", F.filter("mentioned", lambda n: ~F.array_contains(F.col("gold"), T.canonical(n))))


def chair(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    g = scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n_captions"),
        F.sum(F.size("mentioned")).cast("long").alias("n_mentions"),
        F.sum(F.size("halluc")).cast("long").alias("n_hallucinated"),
        F.count_if(F.size("halluc") > 0).alias("n_captions_hallucinated"),
    )
    return g.select(*(by or []), "n_captions", "n_mentions", "n_hallucinated", "n_captions_hallucinated", rate(F.col("n_hallucinated"), F.col("n_mentions")).alias("chair_i"), rate(F.col("n_captions_hallucinated"), F.col("n_captions")).alias("chair_s"), rate(F.col("n_mentions"), F.col("n_captions")).alias("mentions_per_caption"))


def top_values(exploded: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values with their counts; ties in alphabetical order."""
    return exploded.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def object_prf(scored: DataFrame, raw_gold: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Precision over all mentions, recall averaged over keys with gold, and their F1, on raw nouns."""
    d = scored.select(*by, key, "mentioned").join(raw_gold, key)
    hit = F.size(F.array_intersect("mentioned", "gold_raw"))
    g = d.groupBy(*by).agg(F.sum(hit).cast("long").alias("tp"), F.sum(F.size("mentioned")).cast("long").alias("mentions"), F.avg(F.try_divide(hit.cast("double"), F.nullif(F.size("gold_raw"), F.lit(0)))).alias("r"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.nullif(F.col("mentions"), F.lit(0))), F.col("r")
    return g.select(*by, "tp", "mentions", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)), 6).alias("f1"))


def gender_report(preds: DataFrame, refs: DataFrame, key: str, text: str, by: list[str]) -> DataFrame:
    """Captions that commit to a gender which no reference has, or to the other one."""
    r = refs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, T.contains_word(F.col(text), L.REPORT_MALE).alias("m"), T.contains_word(F.col(text), L.REPORT_FEMALE).alias("f"))
    r = r.groupBy(key).agg(F.bool_or("m").alias("ref_m"), F.bool_or("f").alias("ref_f"))
    d = preds.where(F.col(text).isNotNull()).join(r, key)
    d = d.select(*by, T.mentions_person(F.col(text)).alias("person"), T.contains_word(F.col(text), L.REPORT_MALE).alias("m"), T.contains_word(F.col(text), L.REPORT_FEMALE).alias("f"), "ref_m", "ref_f")
    gendered = F.col("m") | F.col("f")
    neutral_refs = ~F.col("ref_m") & ~F.col("ref_f")
    overlap = (F.col("m") & F.col("ref_m")) | (F.col("f") & F.col("ref_f"))
    g = d.groupBy(*by).agg(
        F.count("*").alias("n_captions"),
        F.count_if("person").alias("n_with_person"),
        F.count_if(gendered).alias("n_gendered"),
        F.count_if(F.col("person") & ~gendered).alias("n_neutral"),
        F.count_if(gendered & neutral_refs).alias("n_invented"),
        F.count_if(gendered & ~neutral_refs & ~overlap).alias("n_contradicted"),
    )
    return g.withColumn("invention_rate", rate(F.col("n_invented") + F.col("n_contradicted"), F.col("n_gendered")))


def kappa(pairs: DataFrame, a: str, b: str, by: list[str], least: int = 1) -> DataFrame:
    """Cohen's kappa of two label columns per group of at least ``least`` pairs; null when chance agreement is 1.

    Pairs with a null label are not counted. Counts come from one aggregation over label pairs.
    """
    if not by:
        return kappa(pairs.withColumn("_all", F.lit(0)), a, b, ["_all"], least).drop("_all")
    n = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("n"))
    ma = n.groupBy(*by, F.col(a).alias("label")).agg(F.sum("n").alias("na"))
    mb = n.groupBy(*by, F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("chance"))
    t = n.groupBy(*by).agg(F.sum("n").alias("n_pairs"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("n_agree"))
    j = t.join(chance, by, "left").where(F.col("n_pairs") >= least)
    po, pe = F.col("n_agree") / F.col("n_pairs"), F.coalesce("chance", F.lit(0.0)) / (F.col("n_pairs") * F.col("n_pairs"))
    return j.select(*by, "n_pairs", F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def exclusive_quantile(values: Column, p: float) -> Column:
    """Quantile of a sorted array by the exclusive method: position p (n + 1), carried on beyond the last two values; the only value of one."""
    n = F.size(values)
    at = F.lit(p) * (n + 1)
    lo = F.least(F.greatest(F.floor(at).cast("int"), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    a, b = F.try_element_at(values, lo), F.try_element_at(values, F.least(lo + 1, n))
    return a + (at - lo) * (b - a)


def deltas(df: DataFrame, order: str, value: str) -> DataFrame:
    """Difference of each row's value from the first row's; for small report tables."""
    return df.withColumn("delta", F.round(F.col(value) - F.first_value(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 6))


#: Steps of the mixing generator (SplitMix64), and draws below 2^32 from which an id is taken once, twice and so on: Poisson with mean 1.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_TIMES = np.array([int(sum(exp(-1) / factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)], np.uint32)
#: Cells of the matrix of ids and rounds that is held at a time.
_CELLS = 4_000_000


def bootstrap_weights(keys: np.ndarray, rounds: int) -> np.ndarray:
    """(keys, rounds): how often each key is drawn in each round; a function of key and round alone, so any task draws the same."""
    with np.errstate(over="ignore"):
        # the round is mixed before it meets the key, so that no two pairs of key and round share a sequence
        x = keys[:, None] ^ _mixed(np.arange(1, rounds + 1, dtype=np.uint64) * _STEP)[None, :]
        high = (_mixed(x) >> np.uint64(32)).astype(np.uint32)
    times = np.zeros(high.shape, np.uint8)
    for t in _TIMES:
        times += high >= t
    return times


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def bootstrap_sums(stats: DataFrame, id_col: str, values: list[str], rounds: int, buckets: int | None = None) -> DataFrame:
    """Sums of resampled values per round: (round, values, rows), by a Poisson bootstrap over ids.

    Each id is drawn independently as often as a Poisson variable with mean 1 says, which is what drawing with
    replacement comes to where ids are many; ratios and means don't depend on how many were drawn in all. The draw
    follows from a mixed hash of id and round, so it can be repeated anywhere, rows are never replicated, and a task
    hands on one row per round. With ``buckets`` ids fall into so many buckets by hash, which are drawn instead.
    Rows without an id are one id; null values count as 0. No rows give no rounds.
    """
    unit = F.xxhash64(id_col) if buckets is None else F.xxhash64(F.pmod(F.xxhash64(id_col), F.lit(buckets)))
    b = stats.groupBy(unit.alias("unit")).agg(*[F.coalesce(F.sum(v).cast("double"), F.lit(0.0)).alias(v) for v in values], F.count("*").cast("double").alias("rows"))
    schema = pa.schema([("round", pa.int64()), *[(v, pa.float64()) for v in [*values, "rows"]]])

    def run(batches):
        total = None
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            held = np.stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)], axis=1)
            for at in range(0, len(keys), max(1, _CELLS // rounds)):
                part = slice(at, at + max(1, _CELLS // rounds))
                sums = bootstrap_weights(keys[part], rounds).T.astype(np.float64) @ held[part]
                total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), *[pa.array(c) for c in total.T]], schema=schema)

    drawn = b.mapInArrow(run, "round long, " + ", ".join(f"`{v}` double" for v in [*values, "rows"]))
    return drawn.groupBy("round").agg(*[F.sum(v).alias(v) for v in values], F.sum("rows").cast("long").alias("rows"))


def _ngram_rows(df: DataFrame, keep: list[str], tokens: str, most: int) -> DataFrame:
    """(keep, n, gram): the n-grams of each row, n = 1 .. most."""
    of_size = lambda n: F.transform(T.ngrams(F.col(tokens), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    grams = F.flatten(F.array(*[of_size(n) for n in range(1, most + 1)]))
    return df.select(*keep, F.explode(grams).alias("_x")).select(*keep, "_x.n", "_x.gram")


def ngram_matches_of_many(cands: DataFrame, refs: DataFrame, key: str, tokens: str, by: list[str], most: int = 4) -> DataFrame:
    """Clipped n-gram matches and totals, the counts of BLEU, with any number of references per key: an n-gram is clipped at
    its largest count in one of them.

    Candidates of keys without a reference are not counted. Candidates with equal tokens are counted once with their
    number, and both sides are combined before they are shuffled, by key and n-gram, so a key with very many texts
    costs its distinct n-grams.
    """
    refs = refs.select(key, tokens).distinct().withColumn("_row", F.xxhash64(tokens))
    alike = cands.select(*by, key, tokens).join(refs.select(key).distinct(), key, "left_semi").groupBy(*by, key, tokens).agg(F.count("*").alias("_rows")).withColumn("_row", F.xxhash64(tokens))
    count = lambda d, keep: _ngram_rows(d, keep, tokens, most).groupBy(*keep, "n", "gram").agg(F.count("*").alias("_k"))
    most_in_one = count(refs, [key, "_row"]).groupBy(key, "n", "gram").agg(F.max("_k").alias("_r"))
    own = count(alike, [*by, key, "_row", "_rows"])
    j = own.join(most_in_one, [key, "n", "gram"], "left")
    m = j.select(*by, "n", (F.col("_rows") * F.least("_k", F.coalesce("_r", F.lit(0)))).alias("matched"), F.lit(0).cast("long").alias("total"))
    sizes = F.array(*[F.struct(F.lit(n).alias("n"), (F.greatest(F.size(tokens) - n + 1, F.lit(0)) * F.col("_rows")).alias("total")) for n in range(1, most + 1)])
    t = alike.select(*by, F.explode(sizes).alias("x")).select(*by, "x.n", F.lit(0).cast("long").alias("matched"), "x.total")
    d = m.unionByName(t).groupBy(*by, "n").agg(F.sum("matched").cast("long").alias("matched"), F.sum("total").cast("long").alias("total"))
    return d.select(*by, "n", "matched", "total", rate(F.col("matched"), F.col("total")).alias("precision"))
