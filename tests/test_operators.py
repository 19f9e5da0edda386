import random

from pyspark.sql import functions as F

from claimframe.operators import folds, joins, reports


def test_components_match_brute_force(spark, rows):
    rng = random.Random(5)
    edges = [(g, rng.randrange(12), rng.randrange(12)) for g in range(6) for _ in range(8)]
    edges = [(g, a, b) for g, a, b in edges if a != b]
    got = {(r["g"], r["node"]): r["component"] for r in joins.components(spark.createDataFrame(edges, "g int, a int, b int"), "a", "b", "g").collect()}
    want = {(g, x): x for g, *ab in edges for x in ab}
    for _ in range(20):
        for g, a, b in edges:
            want[g, a] = want[g, b] = min(want[g, a], want[g, b])
    assert got == want


def test_components_of_nothing(spark):
    assert joins.components(spark.createDataFrame([], "g int, a int, b int"), "a", "b", "g").count() == 0


def test_closure_and_accounting(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "child string, parent string")
    assert ("a", "d", 3) in rows(joins.closure(e, 4))
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(joins.accounting(a, b, ["k"])) == [(1, 1, 1)]


def _fold(pred, gold):
    """Greedy alignment as it is told: each prediction takes the first free gold that equals it."""
    free, out = list(range(len(gold))), []
    for i, p in enumerate(pred):
        for j in free:
            if p is not None and gold[j] == p:
                out.append((i, j))
                free.remove(j)
                break
    return sorted(out)


def test_align_equals_the_fold(spark):
    rng = random.Random(2)
    groups = {g: ([rng.choice("abc") for _ in range(7)] + [None], [rng.choice("abcd") for _ in range(6)]) for g in range(15)}
    side = lambda k: spark.createDataFrame([(g, x, i) for g, v in groups.items() for i, x in enumerate(v[k])], "g int, k string, pos int")
    got: dict[int, list] = {}
    for r in folds.align(side(0), side(1), "g", "k", "pos").collect():
        got.setdefault(r["g"], []).append((r["pred_pos"], r["gold_pos"]))
    assert {g: sorted(got.get(g, [])) for g in groups} == {g: _fold(*v) for g, v in groups.items()}


def _claim(**k):
    return {"verdict": "SUPPORTED", "factuality": 0.9, "information": 1.0, "type": "a", "entity": "e", "salience": 0.0, "text": "t", "conflict_key": None, "conflict_value": None} | k


def test_selection():
    rows = [_claim(entity="1", text="1"), _claim(entity="1", text="1"), _claim(entity="2", text="2", type="b", salience=1.0), _claim(verdict="UNCERTAIN", factuality=0.2, text="3"), _claim(verdict="UNCERTAIN", factuality=0.1, text="4"), _claim(factuality=None, text="5"), _claim(verdict="REJECTED", text="6"), _claim(verdict=None, text="7")]
    assert folds.greedy_order(rows) == [0, 1, 2, 3]  # one hedge only; unscored claims add nothing, rejected and unverified ones never enter
    clash = [_claim(text="x", conflict_key="k", conflict_value="1"), _claim(text="y", conflict_key="k", conflict_value="2")]
    assert folds.greedy_order(clash) == [0]
    assert folds.greedy_order([]) == []


def test_coverage_repair():
    few = folds.L.SELECT | {"budget": 2}
    rows = [_claim(entity="1", text="1", salience=0.1), _claim(entity="1", text="2", salience=0.1), _claim(entity="2", text="3", salience=0.9, factuality=None)]
    assert folds.greedy_order(rows, few | {"beta": 0.0}) == [1, 2]  # the first claim is lost at least cost
    assert folds.greedy_order(rows, few | {"beta": 0.0, "coverage_repairs": 0}) == [0, 1]


def test_greedy_matches_brute_force():
    import itertools
    import math
    import random

    rng = random.Random(5)

    def value(rows, ids):
        cfg, mass = folds.L.SELECT, {r["entity"]: r["salience"] for r in rows}
        own = [rows[i] for i in ids]
        types = [r["type"] for r in own]
        div = -sum(types.count(t) / len(types) * math.log2(types.count(t) / len(types)) for t in set(types)) if types else 0
        cov = sum(mass[e] for e in {r["entity"] for r in own}) / sum(mass.values()) if sum(mass.values()) else 0
        red = sum(a["text"] == b["text"] for a, b in itertools.combinations(own, 2))
        return cfg["alpha"] * sum((r["factuality"] or 0) * r["information"] for r in own) + cfg["beta"] * cov + cfg["gamma"] * div - cfg["delta"] * red

    for _ in range(60):
        sal = {str(e): rng.choice([0.0, 0.2, 0.7]) for e in range(3)}
        rows = []
        for _ in range(rng.randrange(8)):
            e = rng.choice("012")
            rows.append(_claim(verdict=rng.choice(["SUPPORTED", "SUPPORTED", "UNCERTAIN"]), factuality=rng.choice([None, 0.1, 0.5, 0.9]), information=rng.choice([0.3, 1.0]), type=rng.choice("abc"), entity=e, salience=sal[e], text=rng.choice("wxyz")))
        chosen = []
        while len(chosen) < folds.L.SELECT["budget"]:
            best = None
            for i, r in enumerate(rows):
                if i in chosen or (r["verdict"] == "UNCERTAIN" and sum(rows[j]["verdict"] == "UNCERTAIN" for j in chosen) >= 1):
                    continue
                g = value(rows, [*chosen, i]) - value(rows, chosen)
                k = (round(g, 9), round(r["factuality"] or 0, 9), r["information"], -i)
                if g > 1e-9 and (best is None or k > best):
                    best = k
            if best is None:
                break
            chosen.append(-best[3])
        assert folds.greedy_order(rows, folds.L.SELECT | {"coverage_repairs": 0}) == sorted(chosen)


def test_select_claims(spark, rows):
    cols = "g string, pos long, verdict string, factuality double, information double, type string, entity string, salience double, text string, conflict_key string, conflict_value string"
    d = spark.createDataFrame([("x", i, "SUPPORTED", 0.5 + i / 10, 1.0, "a", "e", 0.0, str(i), None, None) for i in range(7)] + [("y", 0, None, None, None, None, None, None, None, None, None)], cols)
    assert rows(folds.select_claims(d, "g"), "pos", "rank") == [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    assert folds.select_claims(d.where("false"), "g").count() == 0


def test_hygiene(spark, rows):
    from claimframe.operators import claims

    d = spark.createDataFrame(
        [("x", 1, "con chó chó nằm", None), ("x", 2, "Con mèo ", None), ("x", 3, "con mèo", None), ("x", 4, "", None), ("x", 5, None, None), ("x", 6, "bàn cạnh một người phụ nữ đang đi bộ", None), ("x", 7, "một người đang đi bộ", None), ("x", 8, "ghế", "a b c d e f g h i j k l m"), ("x", 9, "cửa", "nhìn hai người đang ngồi yên"), (None, 10, "con mèo", None)],
        "img string, pos int, t string, p string",
    )
    got = {r["pos"]: r["fate"] for r in claims.hygiene(d, "img", "pos", "t", "p").collect()}
    assert got == {1: "dup_word", 2: "kept", 3: "dup_text", 4: "kept", 5: "kept", 6: "pred_clause", 7: "kept", 8: "pred_clause", 9: "pred_clause", 10: "kept"}
    assert claims.hygiene(d.where("false"), "img", "pos", "t", "p").count() == 0


def test_chair(spark, rows):
    refs = spark.createDataFrame([("i", "một người phụ nữ và con chó"), ("i", None), (None, "xe đạp"), ("j", "")], "image_id string, caption string")
    preds = spark.createDataFrame([("i", "người và con mèo", "s"), ("i", "phụ nữ", "s"), ("i", None, "s"), ("j", "xe đạp", "s"), ("k", "xe đạp", "s")], "image_id string, caption string, gold string").drop("gold")
    s = reports.chair_mentions(preds, reports.gold_objects(refs, "image_id", "caption"), "image_id", "caption")
    assert rows(reports.chair(s), "n_captions", "n_mentions", "n_hallucinated", "chair_i", "chair_s") == [(2, 3, 1, 0.333333, 0.5)]
    assert rows(reports.chair(s.where("false")), "n_captions", "chair_i") == [(0, None)]


def test_kappa(spark, rows):
    p = spark.createDataFrame([("a", "a")] * 4 + [("b", "b")] * 4 + [("a", "b")] * 2 + [(None, "a")], "x string, y string")
    assert rows(reports.kappa(p, "x", "y", []), "n_pairs", "agreement") == [(10, 0.8)]
    one = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert rows(reports.kappa(one, "x", "y", []), "kappa") == [(None,)]  # a single label leaves nothing to agree on by more than chance


def test_exclusive_quantile(spark):
    import statistics

    v = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.0]
    q = spark.range(1).select(reports.exclusive_quantile(F.array(*map(F.lit, sorted(v))), 0.9)).first()[0]
    assert abs(q - statistics.quantiles(v, n=10)[-1]) < 1e-9


def test_bootstrap_repeats(spark, rows):
    s = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("v"))
    a = rows(reports.bootstrap_sums(s, "id", ["v"], 20, 8))
    assert a == rows(reports.bootstrap_sums(s.repartition(5), "id", ["v"], 20, 8)) and len(a) == 20


def test_bootstrap_varies_like_a_plain_one(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.gamma(2.0, size=600), rng.gamma(3.0, size=600)
    d = spark.createDataFrame([(64 * i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "id long, a double, b double")
    got = np.array([r["a"] / r["b"] for r in reports.bootstrap_sums(d, "id", ["a", "b"], 1000).collect()])
    at = rng.integers(0, 600, (1000, 600))
    plain = a[at].sum(1) / b[at].sum(1)
    assert len(set(got)) == 1000 and abs(got.mean() - a.sum() / b.sum()) < 0.2 * plain.std()
    assert 0.85 < got.std() / plain.std() < 1.15
    # neither rounds nor ids go together
    w = reports.bootstrap_weights(np.arange(400, dtype=np.uint64), 400).astype(float)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert np.abs(np.corrcoef(w) - np.eye(400)).max() < 0.3 and np.abs(np.corrcoef(w.T) - np.eye(400)).max() < 0.3


def test_ngram_matches_against_all_references(spark, rows):
    from collections import Counter

    cands = [("s", "i", "a a b c"), ("s", "i", "a a b c"), ("t", "i", "d d d"), ("t", "j", "b c"), ("t", "k", "a"), (None, "j", "c b"), ("u", "i", "")]
    refs = [("i", "a b"), ("i", "a a"), ("i", "a a"), ("i", "b c d"), ("j", "b c e"), ("m", "a")]
    c = spark.createDataFrame([(s, k, t.split()) for s, k, t in cands], "g string, k string, t array<string>")
    r = spark.createDataFrame([(k, t.split()) for k, t in refs], "k string, t array<string>")
    want = {(s, n): [0, 0] for s in ("s", "t", None, "u") for n in (1, 2)}
    grams = lambda t, n: Counter(zip(*(t.split()[i:] for i in range(n))))
    for s, k, t in cands:
        own = [x for q, x in refs if q == k]
        for n in (1, 2) if own else ():
            for g, m in grams(t, n).items():
                want[s, n][0] += min(m, max(grams(x, n)[g] for x in own))
                want[s, n][1] += m
    got = {(x["g"], x["n"]): [x["matched"], x["total"]] for x in reports.ngram_matches_of_many(c, r, "k", "t", ["g"], 2).collect()}
    assert got == want and got["s", 1] == [8, 8]


def test_quota_and_order_of_nulls(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "s string, i int")
    assert joins.quota_sample(d, "s", [F.col("i")], 1).count() == 2


def test_similarity_matches_brute_force(spark, monkeypatch):
    import random

    from claimframe.operators import similarity

    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([4, 4, 6]))]) for i in range(120)] + [(500, [0.0] * 4), (501, None), (None, [1.0] * 4), (502, [])]
    d = spark.createDataFrame([r + ("clash",) for r in data], "id long, v array<float>, query string").repartition(3)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    real = [r for r in data[:120]]
    want = {(a, b) for a, u in real if a % 5 == 0 for b, w in real if a != b and len(u) == len(w) and cos(u, w) >= 0.3}
    for size in (8 << 20, 200):
        monkeypatch.setattr(similarity, "GROUP_BYTES", size)
        got = [(r["query"], r["id"]) for r in similarity.above(d.where("id % 5 = 0"), d, "id", "v", 0.3).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert similarity.above(d.where("false"), d, "id", "v", 0.3).count() == 0
