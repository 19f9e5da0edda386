"""Joins, closures and pair operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_per_key(df: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    """The value of the last row per key, found by aggregation with partial results, not by sorting groups."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_per_key(df: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def accounting(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys both sides share and each has alone; null keys equal nothing."""
    j = a.select(*keys).distinct().withColumn("_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("_b", F.lit(True)), keys, "full_outer")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(child, ancestor, steps): transitive closure of a shallow forest (child, parent), by joining it to itself.

    Ancestors more than ``depth`` steps up are not reached, so that cycles end.
    """
    level = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    out, step = level, level
    for _ in range(depth - 1):
        step = step.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor"), (F.col("steps") + 1).alias("steps"))
        out = out.unionByName(step)
    return out.groupBy("child", "ancestor").agg(F.min("steps").alias("steps"))


def components(edges: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """(group, node, component): connected components inside groups by label propagation with pointer jumping.

    Labels fall to the least node id reached; each round is a join and an aggregation, and the rounds end when no label
    falls any more, which pointer jumping brings about in few of them. Lineage is cut by checkpoints every round.
    """
    from ..plans.session import stable

    e = edges.select(F.col(group).alias("g"), F.col(a).alias("x"), F.col(b).alias("y"))
    e = stable(e.unionByName(e.select("g", F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    lab = stable(e.groupBy("g", "x").agg(F.least(F.min("y"), F.first("x")).alias("c")))
    while True:
        near = e.join(lab.select("g", F.col("x").alias("y"), "c"), ["g", "y"]).groupBy("g", "x").agg(F.min("c").alias("n"))
        new = lab.join(near, ["g", "x"]).select("g", "x", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved"))
        jump = new.select("g", F.col("x").alias("c"), F.col("c").alias("cc"))
        new = stable(new.join(jump, ["g", "c"], "left").select("g", "x", F.least("c", F.coalesce("cc", "c")).alias("c"), "moved"))
        lab = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return lab.select(F.col("g").alias(group), F.col("x").alias("node"), F.col("c").alias("component"))


def quota_sample(df: DataFrame, stratum: str, order: list[Column], quota: int) -> DataFrame:
    """At most ``quota`` rows of each stratum, by an order; null is a stratum."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= quota).drop("_r")


def pseudo_random(id_col: Column, seed: int = 42) -> Column:
    """A repeatable order over ids that any engine can compute."""
    return F.pmod((id_col + seed) * F.lit(2654435761), F.lit(4294967296))
