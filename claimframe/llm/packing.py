"""Problem 7: filling containers of fixed capacity with texts.

Method: bounded-space online packing. Each partition keeps a fixed number of
open windows; a text goes to the fullest window that still has room for it
(best fit); if none has, the fullest window is closed and emitted and a new one
opened. What is still open when the partition ends is merged: the open windows'
pieces, fewer with every round since fixed groups of partitions share a task,
are packed again until one task holds them.

A text larger than the capacity is cut into full pieces and one remainder; no
other text is split.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stable

#: Windows open at a time in one partition and capacity.
OPEN = 64
#: Partitions whose open windows are merged in one task.
FAN_IN = 16

_SCHEMA = pa.schema([("container_id", pa.int32()), ("item_id", pa.int64()), ("piece", pa.int32()), ("size", pa.int64()), ("window", pa.string()), ("filled", pa.int64()), ("closed", pa.bool_())])
_DDL = "container_id int, item_id long, piece int, size long, window string, filled long, closed boolean"


class Packer:
    """Best-fit packing with at most ``limit`` open windows of one capacity."""

    def __init__(self, capacity: int, limit: int, name: str):
        self.capacity, self.limit, self.name, self.made = capacity, limit, name, 0
        self.open: list[tuple[int, int]] = []  # (filled, number), sorted
        self.held: dict[int, list[tuple[int, int, int]]] = {}

    def put(self, entry: tuple[int, int, int]) -> tuple[str, int, list] | None:
        """Place (item, piece, size); returns a window that had to be closed for it."""
        size, out = entry[2], None
        k = bisect_left(self.open, (self.capacity - size + 1, -1)) - 1
        if k >= 0:
            filled, number = self.open.pop(k)
        else:
            if len(self.open) >= self.limit:
                out = self._close(len(self.open) - 1)
            filled, number, self.made = 0, self.made, self.made + 1
            self.held[number] = []
        self.held[number].append(entry)
        insort(self.open, (filled + size, number))
        if filled + size == self.capacity and out is None:
            return self._close(len(self.open) - 1)
        return out

    def _close(self, k: int) -> tuple[str, int, list]:
        filled, number = self.open.pop(k)
        return f"{self.name}-{number}", filled, self.held.pop(number)

    def rest(self):
        while self.open:
            yield self._close(len(self.open) - 1)


def pieces(size: int, capacity: int) -> list[int]:
    """Sizes of the pieces of an item: itself if it fits, else full pieces and the remainder."""
    if size <= capacity:
        return [size]
    full, rest = divmod(size, capacity)
    return [capacity] * full + ([rest] if rest else [])


def _packed(rows, capacities: dict[int, int], limit: int, name: str, final: bool):
    """Batches of closed and open windows for rows of (container, item, piece, size)."""
    packers = {c: Packer(cap, limit, f"{c}-{name}") for c, cap in capacities.items()}
    out: list[tuple] = []

    def emit(c, window, closed):
        key, filled, entries = window
        out.extend((c, i, p, s, key, filled, closed) for i, p, s in entries)

    for c, *entry in rows:
        if (w := packers[c].put(tuple(entry))) is not None:
            emit(c, w, True)
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
            out.clear()
    for c, p in packers.items():
        for w in p.rest():
            emit(c, w, final)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)


def pack(items: DataFrame, containers: DataFrame, limit: int = OPEN) -> DataFrame:
    """Pack ``items`` (item_id long, size long) into containers of each kind of ``containers`` (container_id, capacity).

    Returns (container_id, item_id, piece, size, window, filled, unused): one row per piece and kind of container,
    ``window`` naming the container it lies in. Items with null or non-positive size lie in no container and have no
    row; rows repeated under one id are packed each on its own. Kinds with null or non-positive capacity are left out.
    Kinds are few (a parameter table), so they are read to the driver.
    """
    from pyspark import TaskContext

    kinds = containers.select(F.col("container_id").cast("int"), F.col("capacity").cast("long")).where("capacity > 0 AND container_id IS NOT NULL").distinct().limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of container")
    capacities = {r[0]: r[1] for r in kinds}
    d = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("size").cast("long").alias("size")).where("item_id IS NOT NULL AND size > 0")

    def first(batches):
        name = f"a{TaskContext.get().partitionId()}"

        def rows():
            for b in batches:
                for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for c, cap in capacities.items():
                        for p, x in enumerate(pieces(s, cap)):
                            yield c, i, p, x

        yield from _packed(rows(), capacities, limit, name, False)

    def again(level: int, final: bool):
        def run(batches):
            name = f"{chr(97 + level)}{TaskContext.get().partitionId()}"

            def rows():
                for b in batches:
                    yield from zip(*(b.column(k).to_pylist() for k in range(4)))

            yield from _packed(rows(), capacities, limit, name, final)

        return run

    packed = stable(d.mapInArrow(first, _DDL))
    done, open_ = packed.where("closed"), packed.where("NOT closed")
    groups, level = max(1, packed.rdd.getNumPartitions() // FAN_IN), 1
    while True:
        last = groups == 1
        merged = stable(open_.repartition(groups, F.abs(F.hash("window")) % groups).sortWithinPartitions(F.desc("size"), "item_id", "piece").mapInArrow(again(level, last), _DDL))
        done = done.unionByName(merged.where("closed"))
        if last:
            break
        open_, groups, level = merged.where("NOT closed"), max(1, groups // FAN_IN), level + 1
    caps = F.create_map(*[x for c, cap in capacities.items() for x in (F.lit(c), F.lit(cap))]) if capacities else F.create_map(F.lit(0), F.lit(0).cast("long"))
    return done.select("container_id", "item_id", "piece", "size", "window", "filled", (caps[F.col("container_id")] - F.col("filled")).alias("unused"))


def token_sizes(df: DataFrame, id_col: str, size_col: str, text_col: str) -> DataFrame:
    """(item_id, size): the recorded size, or where it is null the size under the byte-level vocabulary: bytes and one end token.

    Null texts without a recorded size keep a null size.
    """
    return df.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(size_col), F.octet_length(text_col) + 1).cast("long").alias("size"))


def use_of_space(packed: DataFrame) -> DataFrame:
    """(container_id, windows, pieces, tokens, unused, fill): how full the containers of each kind are."""
    w = packed.groupBy("container_id", "window").agg(F.count("*").alias("pieces"), F.max("filled").alias("filled"), F.max("unused").alias("unused"))
    g = w.groupBy("container_id").agg(F.count("*").alias("windows"), F.sum("pieces").alias("pieces"), F.sum("filled").alias("tokens"), F.sum("unused").alias("unused"))
    return g.withColumn("fill", F.try_divide(F.col("tokens"), F.col("tokens") + F.col("unused")))
