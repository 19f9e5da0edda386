"""Readers and writers: record folders, caption files, predictions, shards, annotator stores, term lists, JSONL."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .. import schema
from ..operators.joins import pseudo_random


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable): one JSON document per file; files with a leading ``_`` are reports and skipped by Spark.

    Documents that do not parse, wholly or in part, are given by file instead of failing the scan. (Spark reads the mark of
    a corrupt document only together with another column.)
    """
    s = T.StructType([*schema.record_schema().fields, T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(s).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    df = df.withColumn("_file", F.input_file_name())
    return schema.unify_dialects(df.where("_corrupt IS NULL")).drop("_corrupt"), df.where("_corrupt IS NOT NULL AND coalesce(length(image_id), 0) >= 0").select("_file")


def propositions(records: DataFrame) -> DataFrame:
    """(image_id, pos, prop): claims in their order."""
    return records.select("image_id", F.posexplode("propositions").alias("pos", "prop"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, pos, caption, segmented) of caption files that hold a list, or a document with annotations or captions."""
    item = "struct<image_id:string,id:string,caption:string,segment_caption:string>"
    doc = spark.read.text(path, wholetext=True).select(F.col("value"))
    listed = F.from_json("value", f"array<{item}>")
    nested = F.from_json("value", f"struct<annotations:array<{item}>,captions:array<{item}>>")
    items = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(nested["annotations"], nested["captions"]))
    d = doc.select(F.posexplode(items).alias("pos", "c"))
    return d.select(F.coalesce("c.image_id", "c.id").alias("image_id"), "pos", "c.caption", F.col("c.segment_caption").alias("segmented")).where("trim(caption) <> ''")


def references(captions: DataFrame) -> DataFrame:
    """(image_id, references): captions of an image in file order."""
    g = captions.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pos", "caption"))).alias("c"))
    return g.select("image_id", F.transform("c", lambda x: x["caption"]).alias("references"))


def caption_pairs(captions: DataFrame) -> DataFrame:
    """(raw, segmented) where both are there."""
    return captions.where("caption IS NOT NULL AND segmented IS NOT NULL").select(F.col("caption").alias("raw"), "segmented")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, captions): a map of id to caption or list of captions, at the top or under ``predictions``."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    whole = F.to_json(F.coalesce(F.try_variant_get("v", "$.predictions", "variant"), F.col("v")))
    d = doc.select(F.explode(F.from_json(whole, "map<string,string>")).alias("image_id", "raw"))
    return d.select("image_id", F.when(F.ltrim("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array("raw")).alias("captions"))


def read_shards(spark: SparkSession, glob: str, key: str = "cocoid", value: str = "caption") -> DataFrame:
    """(key, value) of JSONL shards; the last line of the last shard wins."""
    d = spark.read.schema(f"{key} string, {value} string").json(glob).select(key, value, F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_n"))
    return d.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct("_f", "_n")).alias(value))


def read_annotators(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(annotator, image_id, prop_type, text_vi, verdict, reject_reason): one JSON store per annotator, named by its file."""
    item = "struct<type:string,text_vi:string,verdict:string,reject_reason:string>"
    d = spark.read.schema(f"images map<string,struct<propositions:array<{item}>>>").option("multiLine", True).json(path)
    d = d.withColumn("annotator", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    if d.select("annotator").distinct().limit(least).count() < least:
        raise ValueError(f"fewer than {least} annotators under {path}")
    d = d.select("annotator", F.explode("images").alias("image_id", "i")).select("annotator", "image_id", F.explode("i.propositions").alias("p"))
    return d.select("annotator", "image_id", F.col("p.type").alias("prop_type"), "p.text_vi", "p.verdict", "p.reject_reason")


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(surface, class): one class a line, its synonyms behind it, with plurals in s and es; the last class of a surface wins."""
    d = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.transform(F.split(F.lower("value"), ","), lambda x: F.trim(x)).alias("w"))
    d = d.where(F.size("w") > 0).select("line", F.element_at("w", 1).alias("class"), F.explode("w").alias("s")).where("s <> ''")
    d = d.select("line", "class", F.explode(F.array(F.col("s"), F.concat("s", F.lit("s")), F.concat("s", F.lit("es")))).alias("surface"))
    return d.groupBy("surface").agg(F.max_by("class", "line").alias("class"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(class, phrase) of a map of class to phrases; keys with a leading ``_`` are notes. Longest phrases first."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("class", "raw"))
    d = d.where(~F.col("class").startswith("_")).select("class", F.explode(F.from_json("raw", "array<string>")).alias("phrase"))
    return d.orderBy(F.desc(F.length("phrase")), "phrase")


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines under a schema; blank lines, lines that do not parse and lines without any of the fields are no rows, a missing path is an error."""
    names = [f.name for f in T.StructType.fromDDL(ddl).fields]
    return spark.read.schema(ddl).json(path).dropna("all", subset=names)


def write_shuffled_jsonl(df: DataFrame, id_col: str, path: str, seed: int = 42) -> None:
    """JSON lines in a seeded order: a range partitioning by a hash of the id, sorted within partitions."""
    order = pseudo_random(F.col(id_col), seed)
    df.withColumn("_o", order).repartitionByRange("_o", id_col).sortWithinPartitions("_o", id_col).drop("_o").write.mode("overwrite").json(path)


def append_missing(df: DataFrame, key: str, path: str, ddl: str) -> int:
    """Append rows whose key the JSONL store lacks; returns how many were new. A store that isn't there yet is empty."""
    spark = df.sparkSession
    from pyspark.errors import AnalysisException

    try:
        seen = spark.read.schema(ddl).json(path).select(key)
        new = df.join(seen, key, "left_anti")
    except AnalysisException:
        new = df
    new = new.dropDuplicates([key])
    n = new.count()
    new.write.mode("append").json(path)
    return n


def write_cases(df: DataFrame, category: str, order: str, most: int, path: str) -> None:
    """At most ``most`` cases of each category, one folder per category."""
    r = F.row_number().over(Window.partitionBy(category).orderBy(order))
    df.withColumn("_r", r).where(F.col("_r") <= most).drop("_r").write.mode("overwrite").partitionBy(category).json(path)


def load_config(base: dict[str, Any], overrides: list[str]) -> dict[str, Any]:
    """A nested configuration with dotted ``key=value`` overrides; unknown keys are errors, values keep the old type."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in base.items()}
    for o in overrides:
        path, _, raw = o.partition("=")
        *parents, last = path.split(".")
        node = out
        for p in parents:
            node = node[p]
        if last not in node:
            raise KeyError(path)
        old = node[last]
        node[last] = raw.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(raw) if old is not None else raw
    return out


def fingerprint(config: dict) -> str:
    return hashlib.sha256(repr(sorted(config.items())).encode()).hexdigest()[:16]
