import random

import numpy as np

from claimframe.llm import repetition as R


def brute(text):
    """Share of words in second or later copies of runs, word by word; a word weighs 12, an ideograph 5, a run 60."""
    from claimframe.llm.canon import unify

    w = R.words(unify(text))
    weight = [5 if "㐀" <= x <= "鿿" and len(x) == 1 else 12 for x in w]
    seen, mark = set(), [0] * len(w)
    for i in range(len(w)):
        j, s = i, 0
        while j < len(w) and s < 60:
            s += weight[j]
            j += 1
        if s < 60:
            break
        run = tuple(w[i:j])
        if run in seen:
            mark[i:j] = [1] * (j - i)
        seen.add(run)
    return sum(a * b for a, b in zip(mark, weight)) / sum(weight) if w else 0.0


def test_matches_brute_force():
    rng = random.Random(7)
    texts = ["", " ", "a b c d e", "a b c d e a b c d e", "On voit le, " * 8, "diều " * 30, "Seen 1. Seen 2. " * 6, "竹桥上几位舞者正在拉网。" * 3, "x" * 50_000]
    texts += [" ".join(rng.choice(["con", "chó", "mèo,", "Mèo", "红色", "9", "10"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    share, n = R.repeated_shares(texts, R.lexer())
    assert np.allclose(share, [brute(t) for t in texts])
    assert n.tolist()[:3] == [0, 0, 5]


def test_operator(spark, rows):
    d = spark.createDataFrame(
        [("c", 1, "h", "a b c d e " * 5, 0.1), ("c", 2, "h", "một hai ba", 0.1), ("c", 3, None, None, 0.1), ("c", 4, None, "", 0.1), ("c", 2, "h", "một hai ba", 0.1)] + [("c", 10 + i, "g", "bốn năm sáu", 0.1) for i in range(40)],
        "src_table string, row_id long, host string, text string, repeated_share double",
    )
    r = R.repetition(d)
    got = {(x["row_id"]): (x["repetitive"], "repetitive" in x["bad_rules"]) for x in r.collect()}
    assert got[1] == (True, True) and got[2] == (False, True) and got[10] == (False, False) and 3 not in got and got[4][0] is False
    assert r.count() == 44
    h = {x["host"]: x["shrunk_rate"] for x in R.host_rates(R.measure(d)).where("rule = 'repetitive'").collect()}
    assert 0 < h["g"] < h["h"] < 1  # drawn towards the corpus
    assert R.repetition(d.where("false")).count() == 0


def test_rules(spark):
    texts = ["Có mưa. Có mưa. Có mưa.", "một dòng\nmột dòng\nmột dòng", "a b c d e " * 5, "a b c d e f g h i j k l a b c d e", "không có gì lặp", ""]
    d = spark.createDataFrame([("c", i, "h", t) for i, t in enumerate(texts)], "src_table string, row_id long, host string, text string")
    got = {r["row_id"]: r["failed"] for r in R.measure(d).collect()}
    assert got == {0: ["runs", "sentences"] if "runs" in got[0] else ["sentences"], 1: got[1], 2: ["runs", "repetitive"], 3: ["runs"], 4: [], 5: []}
    assert {"sentences", "lines"} <= set(got[1])
    rates = R.host_rates(R.measure(d)).collect()
    assert {r["rule"] for r in rates} == set(R.RULES) and {r["rule"]: r["failures"] for r in rates}["sentences"] == 2
