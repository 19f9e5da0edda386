"""Order-dependent operators that run per group in Arrow batches: alignment and budgeted selection."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import lexicon as L


def align(predicted: DataFrame, gold: DataFrame, group: str, key: str, pos: str) -> DataFrame:
    """(group, pred_pos, gold_pos): greedy one-to-one alignment on equal keys, the first free gold wins.

    With equality as the match, the k-th prediction of a key meets the k-th gold of that key, so the fold is two
    numberings and an equi-join. Null keys match nothing.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(group, key).orderBy(pos)
    number = lambda d, name: d.where(F.col(key).isNotNull()).select(group, key, F.col(pos).alias(name), F.row_number().over(w).alias("_k"))
    return number(predicted, "pred_pos").join(number(gold, "gold_pos"), [group, key, "_k"]).select(group, "pred_pos", "gold_pos")


class Selection:
    """The objective over sets of one group's claims: information, coverage, variety of types, less redundancy.

    Information is factuality times informativeness (0 for unscored claims), coverage the share of all entities'
    salience that is mentioned (0 without any salience), variety the entropy of types in bits, and redundancy the number
    of pairs with one text.
    """

    def __init__(self, rows: list[dict], cfg: dict):
        self.rows, self.cfg = rows, cfg
        self.salience: dict = {}
        for r in rows:
            if r["entity"] is not None:
                self.salience[r["entity"]] = max(self.salience.get(r["entity"], 0.0), r["salience"] or 0.0)
        self.mass = sum(self.salience.values())
        self.open = [i for i, r in enumerate(rows) if r["verdict"] in ("SUPPORTED", "UNCERTAIN")]

    def information(self, i: int) -> float:
        r = self.rows[i]
        return (r["factuality"] or 0.0) * (r["information"] or 0.0)

    def hedge(self, i: int) -> bool:
        return self.rows[i]["verdict"] == "UNCERTAIN"

    def covered(self, ids: list[int]) -> float | None:
        return sum(self.salience.get(e, 0.0) for e in {self.rows[i]["entity"] for i in ids}) / self.mass if self.mass > 0 else None

    def value(self, ids: list[int]) -> float:
        c, n = self.cfg, len(ids)
        kinds, texts = Counter(self.rows[i]["type"] for i in ids), Counter(self.rows[i]["text"] for i in ids)
        variety = -sum(k / n * log2(k / n) for k in kinds.values())
        same = sum(k * (k - 1) // 2 for t, k in texts.items() if t is not None)
        return c["alpha"] * sum(map(self.information, ids)) + c["beta"] * (self.covered(ids) or 0.0) + c["gamma"] * variety - c["delta"] * same

    def clash(self, i: int, j: int) -> bool:
        a, b = self.rows[i], self.rows[j]
        return a["conflict_key"] is not None and a["conflict_key"] == b["conflict_key"] and a["conflict_value"] != b["conflict_value"]

    def fits(self, ids: list[int]) -> bool:
        return sum(map(self.hedge, ids)) <= self.cfg["hedge_quota"] and not any(self.clash(i, j) for i, j in combinations(ids, 2))

    def greedy(self) -> list[int]:
        """Claims of the largest gain one after the other; ties fall to the better proven, the more informative, the earlier."""
        chosen: list[int] = []
        while len(chosen) < self.cfg["budget"]:
            now = self.value(chosen)
            gains = [(self.value([*chosen, i]) - now, i) for i in self.open if i not in chosen and self.fits([*chosen, i])]
            gains = [(round(g, 12), round(self.rows[i]["factuality"] or 0.0, 12), round(self.rows[i]["information"] or 0.0, 12), -i) for g, i in gains if g > 1e-12]
            if not gains:
                break
            chosen.append(-max(gains)[3])
        return chosen

    def repaired(self, chosen: list[int]) -> list[int]:
        """With too little coverage, the most salient entity that can be is brought in: for nothing while the budget lasts, else for the claim whose loss costs least."""
        for _ in range(self.cfg["coverage_repairs"]):
            before = self.covered(chosen)
            if before is None or before >= self.cfg["coverage_threshold"]:
                break
            swap = next(self.swaps(chosen, before), None)
            if swap is None:
                break
            chosen = sorted(swap)
        return chosen

    def swaps(self, chosen: list[int], before: float):
        named = {self.rows[i]["entity"] for i in chosen}
        full = len(chosen) >= self.cfg["budget"]
        whole = self.value(chosen)
        loss = {v: round(whole - self.value([i for i in chosen if i != v]), 12) for v in chosen}
        victims = sorted(chosen, key=lambda v: (loss[v], v)) if full else [None]
        for e in sorted((e for e, s in self.salience.items() if s > 0 and e not in named), key=lambda e: (-self.salience[e], str(e))):
            pool = [i for i in self.open if self.rows[i]["entity"] == e and i not in chosen]
            for i in sorted(pool, key=lambda i: (-round(self.information(i), 12), -round(self.rows[i]["factuality"] or 0.0, 12), i)):
                for v in victims:
                    after = [*(x for x in chosen if x != v), i]
                    if self.fits(after) and (self.covered(after) or 0.0) > before + 1e-12:
                        yield after


def greedy_order(rows: list[dict], cfg: dict = L.SELECT) -> list[int]:
    """Positions of the claims that budgeted selection chooses, in the order of their positions.

    Only supported and uncertain claims are eligible, uncertain ones up to a quota, and no two that contradict each other.
    """
    s = Selection(rows, cfg)
    return sorted(s.repaired(s.greedy()))


_SELECT_COLS = ("pos", "verdict", "factuality", "information", "type", "entity", "salience", "text", "conflict_key", "conflict_value")


def select_claims(claims: DataFrame, group: str, group_type: str = "string") -> DataFrame:
    """(group, pos, rank): at most a budget of claims per group. Groups are single records, so they are small by nature.

    Claims are shuffled once by group and sorted within partitions; a task then folds over runs of equal groups in
    Arrow batches, so that a group costs no call of its own. A null group is a group.
    """
    schema = T.StructType.fromDDL(f"{group} {group_type}, pos long, rank int")
    arrow = to_arrow_schema(schema)

    def run(batches):
        held: list[dict] = []
        out: list[tuple] = []

        def fold():
            out.extend((held[i][group], held[i]["pos"], r + 1) for r, i in enumerate(greedy_order(held)))

        def flush():
            cols = list(zip(*out)) if out else [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for row in b.to_pylist():
                if held and held[0][group] != row[group]:
                    fold()
                    held = []
                held.append(row)
            yield flush()
        if held:
            fold()
        yield flush()

    return claims.select(group, *_SELECT_COLS).repartition(group).sortWithinPartitions(group, "pos").mapInArrow(run, schema)
