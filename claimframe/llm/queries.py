"""Queries of the training-data operators over the project's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import canon, consensus, langid, leakage, packing, pairs, pii, repetition, truncation
from .common import load


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, row_id, origin, lang, text) of captions and documents."""
    c = load(spark, d, "captions").select(F.lit("captions").alias("src_table"), F.col("caption_id").alias("row_id"), F.col("system_name").alias("origin"), "lang", F.col("caption").alias("text"))
    t = load(spark, d, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), F.col("source").alias("origin"), "lang", "text")
    return c.unionByName(t)


def _language_model(spark: SparkSession, d: str) -> langid.Profiles:
    return langid.fit(load(spark, d, "documents"), "text", "lang")


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    return langid.text_languages(t, "row_id", "text", "lang", _language_model(spark, d), F.col("src_table"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    return langid.text_segments(t, "row_id", "text", _language_model(spark, d), F.col("src_table"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.label_errors(p1_languages(spark, d))


def _origins(spark: SparkSession, d: str) -> DataFrame:
    """Captions with whether they reached their mode's token limit, and documents."""
    limits = load(spark, d, "latency_modes").groupBy("system_name", "gen_mode").agg(F.max("max_new_tokens").alias("most"))
    c = load(spark, d, "captions").join(limits, ["system_name", "gen_mode"], "left")
    c = c.select(F.lit("captions").alias("src_table"), F.col("caption_id").alias("row_id"), F.col("system_name").alias("origin"), (F.col("new_tokens") >= F.col("most")).alias("limit_hit"), F.col("caption").alias("text"))
    t = load(spark, d, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), F.col("source").alias("origin"), F.lit(None).cast("boolean").alias("limit_hit"), "text")
    return c.unionByName(t)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_origins(spark, d)).where("cut").select("src_table", "row_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    t = _origins(spark, d)
    return truncation.truncation_rates(t, truncation.truncated(t))


def _pair_defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(load(spark, d, "sft_pairs"), "pair_id", "prompt", "response", "system_name", _language_model(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pair_defects(spark, d).where("defect IS NOT NULL").select("pair_id", "defect")


def p3_defects(spark: SparkSession, d: str) -> DataFrame:
    return _pair_defects(spark, d).select("pair_id", F.explode("defects").alias("defect"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a = canon.same_reading_pairs(load(spark, d, "annotations"), "label_id", "text_vi", ["image_id"])
    c = canon.same_reading_pairs(load(spark, d, "captions"), "caption_id", "caption", ["image_id", "shard"])
    return a.select(F.lit("annotations").alias("src_table"), "id_a", "id_b").unionByName(c.select(F.lit("captions").alias("src_table"), "id_a", "id_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    a = canon.same_reading_counts(load(spark, d, "annotations"), "label_id", "text_vi", ["image_id"])
    c = canon.same_reading_counts(load(spark, d, "captions"), "caption_id", "caption", ["image_id", "shard"])
    return a.withColumn("src_table", F.lit("annotations")).unionByName(c.withColumn("src_table", F.lit("captions"))).select("src_table", "id", "forms", "rows")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    a = canon.unified_forms(load(spark, d, "annotations"), "label_id", "text_vi").withColumn("src_table", F.lit("annotations"))
    c = canon.unified_forms(load(spark, d, "captions"), "caption_id", "caption").withColumn("src_table", F.lit("captions"))
    return a.unionByName(c).select("src_table", "row_id", "unified", "changed")


def _consensus(spark: SparkSession, d: str):
    return consensus.consensus(load(spark, d, "annotations"), "label_id", "annotator", "image_id", "text_vi", "verdict", "added_utc")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0].where("annotators >= 3 AND verdicts >= 2").select("label_id", "verdict")


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0]


def p5_annotators(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[1]


def _repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(_texts(spark, d).withColumnRenamed("origin", "host"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that fail the rule "repetitive", out of the texts with their own and their hosts' rules side by side."""
    return _repetition(spark, d).where("repetitive AND shrunk_rate IS NOT NULL").select("src_table", "row_id").distinct()


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return _repetition(spark, d)


def p6_hosts(spark: SparkSession, d: str) -> DataFrame:
    return repetition.host_rates(repetition.measure(_texts(spark, d).withColumnRenamed("origin", "host")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    kinds = load(spark, d, "containers").select("container_id", F.col("capacity_tokens").alias("capacity"))
    return packing.pack(packing.token_sizes(load(spark, d, "documents"), "doc_id", "n_tokens", "text"), kinds)


def p7_use_of_space(spark: SparkSession, d: str) -> DataFrame:
    return packing.use_of_space(p7_containers(spark, d))


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    return packing.token_sizes(load(spark, d, "documents"), "doc_id", "n_tokens", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("kind <> 're-parameterised'").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked item with the documents that hold it."""
    found = _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))
    return load(spark, d, "eval_items").join(found, "item_id").select("item_id", "test_set", "documents")


def _personal(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_information(load(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("doc_id", "kind", "found_text").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(load(spark, d, "documents"), "doc_id", "text", _personal(spark, d))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_sizes": "SELECT doc_id AS item_id, CAST(coalesce(n_tokens, octet_length(encode(text)) + 1) AS BIGINT) AS size FROM documents",
    }
