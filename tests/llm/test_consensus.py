import random

import pytest

from claimframe.llm import consensus as C

DDL = "label_id long, who string, img string, text string, verdict string, at long, item string"


def labels(seed, items=400):
    rng = random.Random(seed)
    skill = {f"a{k}": 0.9 for k in range(5)} | {"bad": 0.05, "coin": 1 / 3}
    truth, out = [rng.choice(C.VERDICTS) for _ in range(items)], []
    for i, t in enumerate(truth):
        for who in rng.sample(sorted(skill), 4):
            out.append((f"i{i}", who, t if rng.random() < skill[who] else rng.choice([v for v in C.VERDICTS if v != t])))
    return truth, out


def test_better_than_majority_and_finds_the_bad(spark):
    truth, lab = labels(4)
    b, r = C.pass_messages(spark.createDataFrame(lab, "item string, annotator string, verdict string"))
    got = {x["item"]: x["verdict"] for x in b.collect()}
    acc = sum(got[f"i{i}"] == t for i, t in enumerate(truth)) / len(truth)
    votes: dict = {}
    for i, _, v in lab:
        votes.setdefault(i, []).append(v)
    majority = sum(max(C.VERDICTS, key=votes[f"i{i}"].count) == t for i, t in enumerate(truth)) / len(truth)
    rel = {x["annotator"]: x["reliability"] for x in r.collect()}
    assert acc > majority and acc > 0.9
    assert rel["bad"] < rel["coin"] < min(rel[f"a{k}"] for k in range(5))


def test_both_ways_agree(spark, monkeypatch):
    _, lab = labels(5, 60)
    d = spark.createDataFrame(lab, "item string, annotator string, verdict string")
    monkeypatch.setattr(C, "TOLERANCE", 1e-4)
    def rounded(x):
        return {r[0]: tuple(round(v, 3) if isinstance(v, float) else v for v in r[1:]) for r in x.collect()}

    b, r = map(rounded, C.pass_messages(d))
    b2, r2 = map(rounded, C._pass_messages_by_join(d, C.VERDICTS))
    assert b.keys() == b2.keys() and r.keys() == r2.keys()
    for x, y in ((b, b2), (r, r2)):
        for k in x:
            assert all(abs(u - v) < 0.01 if isinstance(u, float) else u == v for u, v in zip(x[k], y[k]))


def test_converged_or_an_error(spark, monkeypatch):
    _, lab = labels(6, 40)
    d = spark.createDataFrame(lab, "item string, annotator string, verdict string")
    monkeypatch.setattr(C, "GIVE_UP", 2)
    with pytest.raises(RuntimeError):
        C.pass_messages(d)


def test_last_label_item_and_spellings(spark):
    d = spark.createDataFrame(
        [
            (5, "x", "m", "có chó", "Verdict.SUPPORTED", 1, "clash"), (9, "x", "m", "có  сhó", "rejected", 2, "clash"), (3, None, "m", "có chó", "SUPPORTED", 9, "clash"), (4, "y", "m", "có chó", "none", 9, "clash"),
            (6, "y", "m", "có chó", " Rejected ", 3, "clash"), (7, "z", "m", "có chó", "SUPPORTED", None, "clash"), (8, "z", None, "có chó", "SUPPORTED", 1, "clash"), (10, "w", "m", None, "SUPPORTED", 1, "clash"), (11, "w", "m", "", "SUPPORTED", 1, "clash"),
        ],
        DDL,
    )
    last = {r["annotator"]: r["verdict"] for r in C.last_labels(C.items_of(d, "label_id", "who", "img", "text", "verdict", "at")).collect()}
    assert last == {"x": "REJECTED", "y": "REJECTED", "z": "SUPPORTED"}
    items, _ = C.consensus(d, "label_id", "who", "img", "text", "verdict", "at")
    r = items.collect()
    assert len(r) == 1 and r[0]["label_id"] == 3 and r[0]["verdict"] == "REJECTED" and r[0]["annotators"] == 3 and r[0]["verdicts"] == 2 and abs(r[0]["agreement"] - 1 / 3) < 1e-9


def test_empty_and_single(spark):
    none = spark.createDataFrame([], DDL)
    items, who = C.consensus(none, "label_id", "who", "img", "text", "verdict", "at")
    assert items.count() == 0 and who.count() == 0
    one = spark.createDataFrame([(1, "x", "m", "t", "SUPPORTED", 1, "c")], DDL)
    items, who = C.consensus(one, "label_id", "who", "img", "text", "verdict", "at")
    assert items.first()["agreement"] is None and who.count() == 1
