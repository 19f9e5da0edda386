"""Plumbing shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.session import stable

#: Most characters handed to a batch function at once, so that long texts cannot fill a worker's memory.
BATCH_CHARS = 1_500_000
#: Largest table, in bytes of its columns, that may be sent to every executor.
BROADCAST_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into pieces of at most ``limit`` bytes; a single larger row stays whole."""
    if batch.num_rows == 0:
        return
    each = max(1, batch.nbytes // batch.num_rows)
    step = max(1, limit * 2 // each)
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType | str, setup: Callable | None = None) -> DataFrame:
    """Apply ``fn`` (columns in, columns out, as lists) to Arrow batches of ``df``.

    ``setup`` runs once per partition; its value is passed to ``fn`` as a second argument.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches):
        state = setup() if setup else None
        for whole in batches:
            for part in slices(whole):
                cols = {f.name: part.column(i).to_pylist() for i, f in enumerate(part.schema)}
                out = fn(cols, state) if setup else fn(cols)
                yield pa.RecordBatch.from_arrays([a if isinstance(a := out[f.name], pa.Array) else pa.array(a, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key with more than this share of a side's rows is joined by broadcast; there are fewer than its inverse of them.
HOT_SHARE = 1 / 500


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` (any number of rows a key) with ``small`` (one row a key) on ``keys``, how "inner" or "left".

    Keys that hold more than ``HOT_SHARE`` of the rows of ``big`` are counted first; their rows of ``small``, fewer
    than 1 / HOT_SHARE whatever the tables' size, go to every task, so that no task gets all rows of a hot key. The
    others are shuffled. Null keys match nothing.
    """
    n = big.count()
    if n < 100_000:  # one task's worth: any plan will do
        return big.join(small, keys, how)
    hot = big.groupBy(*keys).count().where(F.col("count") > n * HOT_SHARE).select(*keys)
    hot = stable(hot)
    if hot.isEmpty():
        return big.join(small, keys, how)
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    b = big.join(mark, keys, "left")
    extra = F.broadcast(small.join(F.broadcast(hot), keys, "left_semi"))
    h = b.where("_hot").drop("_hot").join(extra, keys, how)
    return h.unionByName(b.where("_hot IS NULL").drop("_hot").join(small.join(F.broadcast(hot), keys, "left_anti"), keys, how))


class Hashes(dict):
    """64-bit hashes of strings, alike in every process; kept for the words seen so far."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Lexer:
    """Turns texts into arrays of token numbers.

    A text is split at blanks first; what a chunk between blanks holds is worked out once and remembered, so that
    only new chunks are taken apart in Python. ``split`` gives the tokens of a chunk, ``code`` the number of a token;
    numbers below 8 are reserved for callers' marks. Chunks without tokens vanish.
    """

    LIMIT = 400_000
    NONE, MANY = 0, 1

    def __init__(self, split: Callable[[str], list[str]], code: Callable[[str], int]):
        self.split, self.code = split, code
        outer = self

        class Memory(dict):
            def __missing__(self, chunk):
                tokens = outer.split(chunk)
                if len(tokens) == 1:
                    n = outer.code(tokens[0])
                else:
                    n = outer.MANY if tokens else outer.NONE
                    if tokens and len(chunk) < 40:
                        outer.parts[chunk] = list(map(outer.code, tokens))
                if len(chunk) < 40:
                    self[chunk] = n
                return n

        self.memory = Memory()
        self.parts: dict[str, list[int]] = {}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all tokens, tokens of each text)."""
        if len(self.memory) > self.LIMIT:
            self.memory.clear()
            self.parts.clear()
        chunks: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            c = t.split()
            sizes[i] = len(c)
            chunks += c
        a = np.fromiter(map(self.memory.__getitem__, chunks), np.uint64, len(chunks))
        n = np.ones(len(a), np.int64)
        n[a == self.NONE] = 0
        parts = []
        for k in np.flatnonzero(a == self.MANY).tolist():
            own = self.parts.get(chunks[k]) or list(map(self.code, self.split(chunks[k])))
            n[k] = len(own)
            parts += own
        is_part = np.repeat(a == self.MANY, n)
        out = np.repeat(a, n)
        out[is_part] = np.array(parts, np.uint64)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))]
        return out, np.diff(ends)


MULT = np.uint64(0x9E3779B97F4A7C15)


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive ids (positions 0 .. len-n)."""
    return all_windows(ids, (n,))[n]


def all_windows(ids: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """``windows`` of several sizes, each made from the smaller ones."""
    out = {}
    with np.errstate(over="ignore"):
        h = np.zeros(len(ids), np.uint64)
        for k in range(max(sizes)):
            h = h[: max(0, len(ids) - k)] * MULT
            h += ids[k : k + len(h)]
            h ^= h >> np.uint64(29)
            if k + 1 in sizes:
                out[k + 1] = h
    return out


def blank(col) -> F.Column:
    """Null, or nothing but white space and invisible characters."""
    return F.coalesce(F.regexp_replace(col, r"[\s\p{Z}\p{Cf}\x{FEFF}\x{115F}\x{1160}\x{3164}\x{2800}]+", "") == "", F.lit(True))

