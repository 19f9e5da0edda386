import random
from collections import defaultdict

import pytest

from claimframe.llm import packing as P

KINDS = "container_id int, capacity long"


def check(packed, items, kinds):
    """Everything lies in exactly one window of each kind, whole unless larger than it, and no window overflows."""
    rows = packed.collect()
    for c, cap in kinds:
        own = [r for r in rows if r["container_id"] == c]
        size = defaultdict(int)
        for r in own:
            size[r["window"]] += r["size"]
        assert all(v <= cap for v in size.values())
        assert all(r["filled"] == size[r["window"]] and r["unused"] == cap - r["filled"] for r in own)
        total = defaultdict(list)
        for r in own:
            total[r["item_id"]].append(r["size"])
        want = defaultdict(list)
        for i, s in items:
            if s and s > 0:
                want[i] += P.pieces(s, cap)
        assert {k: sorted(v) for k, v in total.items()} == {k: sorted(v) for k, v in want.items()}
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_whole_and_full(spark, parts):
    rng = random.Random(9)
    items = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 400), 100, 250])) for i in range(600)] + [(1, 30), (1, 30), (900, None), (901, 0), (902, -5)]
    kinds = [(1, 100), (2, 250)]
    d = spark.createDataFrame([x + ("clash",) for x in items], "item_id long, size long, window string").repartition(parts)
    rows = check(P.pack(d, spark.createDataFrame(kinds, KINDS)), items, kinds)
    u = P.use_of_space(spark.createDataFrame(rows)).collect()
    assert all(x["fill"] > 0.9 for x in u)


def test_edges(spark):
    none = spark.createDataFrame([], "item_id long, size long")
    k = spark.createDataFrame([(1, 10), (2, None), (3, 0)], KINDS)
    assert P.pack(none, k).count() == 0
    one = spark.createDataFrame([(1, 25)], "item_id long, size long")
    assert sorted(r["size"] for r in P.pack(one, k).collect()) == [5, 10, 10]
    assert P.pack(one, k.where("false")).count() == 0


def test_bounded_space():
    p = P.Packer(10, 3, "x")
    for i in range(50):
        p.put((i, 0, 6))
        assert len(p.open) <= 3


def test_sizes(spark, rows):
    d = spark.createDataFrame([(1, 5, "abc"), (2, None, "chó"), (3, None, None)], "id long, n long, t string")
    assert rows(P.token_sizes(d, "id", "n", "t")) == [(1, 5), (2, 5), (3, None)]
