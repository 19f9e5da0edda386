"""Cosine similarity of a stated query set against all vectors, as products of matrices in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Most bytes of query vectors that a task holds at a time.
GROUP_BYTES = 8 << 20

_PACKED = "ids array<long>, size int, numbers array<double>"


def _packed(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """One row per Arrow batch and vector size: the ids and all unit vectors behind one another. Vectors of length 0 or with nulls are like none."""

    def run(batches):
        for b in batches:
            v = b.column(1)
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            begin = np.cumsum(sizes) - sizes
            ids = b.column(0).to_numpy()
            for size in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == size)
                x = flat[begin[own][:, None] + np.arange(size)]
                length = np.sqrt((x * x).sum(axis=1))
                ok = np.isfinite(length) & (length > 0)
                x = x[ok] / length[ok][:, None]
                yield pa.RecordBatch.from_arrays([pa.array([ids[own][ok].tolist()], pa.list_(pa.int64())), pa.array([size], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))], names=["ids", "size", "numbers"])

    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return d.mapInArrow(run, _PACKED)


def above(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, least: float) -> DataFrame:
    """(query, id, similarity) of every query and every other vector of its size whose cosine is at least ``least``.

    Both sides are packed into matrices. The queries fall into groups of at most about ``GROUP_BYTES`` bytes, and every
    packed batch of vectors meets each group once: with one group by a broadcast, else by a shuffle on the group, so
    that no task holds more than a batch and a group. Null ids and vectors have no rows; ids given twice count twice.
    """
    rows = queries.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).agg(F.count("*").alias("n"), F.sum(F.size(vector)).alias("k")).first()
    groups = max(1, -(-(rows["k"] or 0) * 8 // GROUP_BYTES))
    group = F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int")
    q = None
    if groups == 1:
        q = F.broadcast(_packed(queries.coalesce(1), id_col, vector).withColumn("g", F.lit(0)))
    else:
        parts = queries.withColumn("g", group).repartition(groups, "g")
        # a partition may hold several groups; the group of a packed row is that of all its ids
        q = _packed(parts, id_col, vector).select(F.explode(F.transform(F.arrays_zip("ids", F.sequence(F.lit(0), F.size("ids") - 1).alias("at")), lambda x: F.struct(F.pmod(F.xxhash64(x["ids"]), F.lit(groups)).cast("int").alias("g"), x["ids"].alias("id"), F.slice("numbers", x["at"] * F.col("size") + 1, F.col("size")).alias("v")))).alias("x"), "size")
        q = q.groupBy("x.g", "size").agg(F.collect_list("x.id").alias("ids"), F.flatten(F.collect_list("x.v")).alias("numbers"))
    v = _packed(vectors, id_col, vector).select("ids", "size", "numbers", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    j = v.join(q.select("g", "size", F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers")), ["g", "size"])

    def run(batches):
        for b in batches:
            for ids, size, numbers, q_ids, q_numbers in zip(*(b.column(c) for c in ("ids", "size", "numbers", "q_ids", "q_numbers"))):
                size = size.as_py()
                x, y = (np.asarray(c.values).reshape(-1, size) for c in (numbers, q_numbers))
                a, qa = np.asarray(ids.values), np.asarray(q_ids.values)
                s = y @ x.T
                i, k = np.nonzero(s >= least)
                other = qa[i] != a[k]
                i, k = i[other], k[other]
                yield pa.RecordBatch.from_arrays([pa.array(qa[i]), pa.array(a[k]), pa.array(s[i, k])], names=["query", "id", "similarity"])

    return j.mapInArrow(run, "query long, id long, similarity double")
