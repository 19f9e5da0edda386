import random

from claimframe.llm import leakage as K
from claimframe.llm.canon import unify


def brute(doc, item):
    """Fourteen consecutive words of the item, or all of it with at most one word in eight replaced."""
    d, a = K.words(unify(doc)), K.words(unify(item))
    n = len(a)
    if not n:
        return False
    if any(d[i : i + 14] == a[j : j + 14] for i in range(len(d) - 13) for j in range(n - 13)):
        return True
    return any(sum(x != y for x, y in zip(d[i : i + n], a)) <= n // 8 for i in range(len(d) - n + 1))


WORDS = "an ba ca da em ga ha ki la mo no pa 12 7 km cm Ron Lan".split()


def corpus(rng, sizes, n):
    word = lambda: rng.choice(WORDS)
    items = [(i, " ".join(word() for _ in range(k))) for i, k in enumerate(sizes)]
    docs = []
    for k in range(n):
        item = rng.choice(items)[1].split()
        kind = rng.randrange(4)
        if kind == 0:
            own = list(item)
        elif kind == 1:
            a = rng.randrange(max(1, len(item) - 12))
            own = item[a : a + rng.randrange(11, 18)]
        else:  # about as many words replaced as are allowed, anywhere
            own = list(item)
            for x in rng.sample(range(len(own)), min(len(own), len(own) // 8 + rng.randrange(2))):
                own[x] = "zz"
        text = " ".join([*(word() for _ in range(rng.randrange(9))), *own, *(word() for _ in range(rng.randrange(9)))])
        docs.append((k, text.upper().replace(" ", ", ") if rng.random() < 0.3 else text, "clash"))
    return items, docs


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in K.leaks(d, "doc_id", "text", e, "item_id", "text").collect())


def test_matches_brute_force(spark, monkeypatch):
    items, docs = corpus(random.Random(11), list(range(1, 61)) + [8, 16, 24, 33], 900)
    items += [(90, None), (91, ""), (92, "...")]
    docs += [(9000, None, "clash"), (9001, "", "clash")]
    rows = found(spark, docs, items)
    got = {r[:2] for r in rows if r[2] != "re-parameterised"}
    want = {(k, i) for k, t, _ in docs for i, x in items if t and x and brute(t, x)}
    assert got == want and len(want) > 400
    # the order of documents, and so their batches' borders, change nothing
    assert found(spark, docs[::-1], items) == rows
    monkeypatch.setattr(K, "BLOCK", 10)
    assert found(spark, docs, items) == rows


def test_fresh_names_are_slots(spark):
    item = "hôm qua Lan mua 12 quả cam rồi cho Ron một nửa, hỏi Ron còn mấy quả cam"
    docs = [(1, item.replace("Lan", "Mai").replace("Ron", "Bill").replace("12", "40"), "c"), (2, item.replace("cho Ron", "cho Bill").replace("Lan", "Mai").replace("12", "40"), "c")]
    assert [r[:3] for r in found(spark, docs, [(7, item)])] == [(1, 7, "re-parameterised")]


def test_slots_and_kinds(spark):
    item = "xe số 12 dài 30 km đi qua 12 cầu nhỏ ở làng xa"
    docs = [(1, item), (2, item.replace("12", "99").replace("30", "77")), (3, item.replace("12", "99", 1)), (4, item.replace("làng", "phố"))]
    d = spark.createDataFrame(docs, "d long, t string")
    e = spark.createDataFrame([(7, item)], "i long, t string")
    got = {r["doc_id"]: r["kind"] for r in K.leaks(d, "d", "t", e, "i", "t").collect()}
    assert got == {1: "verbatim", 2: "re-parameterised", 3: "altered", 4: "altered"}


def test_replaced_number_before_a_unit(spark):
    short, long = "một hai ba bốn 12 km năm sáu bảy tám", "12 km " + " ".join(f"w{i}" for i in range(13)) + " " + " ".join(f"v{i}" for i in range(20))
    docs = [(1, short.replace("12", "vài")), (2, "xx km " + " ".join(f"w{i}" for i in range(13)) + " hết"), (3, short.replace("12", "vài").replace("tám", "chín"))]
    d = spark.createDataFrame(docs, "d long, t string")
    e = spark.createDataFrame([(7, short), (8, long)], "i long, t string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in K.leaks(d, "d", "t", e, "i", "t").collect()}
    assert got == {(1, 7, "altered"), (2, 8, "passage")}


def test_blocks_and_edges(spark, monkeypatch):
    words = [f"w{i}" for i in range(20)]
    d = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words))], "d long, t string")
    e = spark.createDataFrame([(i, " ".join(words[: 14 + i])) for i in range(5)], "i long, t string")
    whole = K.leaks(d, "d", "t", e, "i", "t").count()
    monkeypatch.setattr(K, "BLOCK", 2)
    assert K.leaks(d, "d", "t", e, "i", "t").count() == whole == 10
    assert K.leaks(d.where("false"), "d", "t", e, "i", "t").count() == 0
    monkeypatch.setattr(K, "BLOCK", 20_000)
    assert K.leaks(d.where("false"), "d", "t", e, "i", "t").count() == 0
    assert K.leaks(d, "d", "t", e.where("false"), "i", "t").count() == 0
