import pytest
from pyspark.sql import functions as F

from claimframe import lexicon as L
from claimframe.functions import text as T
from claimframe.operators import rules


@pytest.fixture(scope="module")
def value(spark):
    def f(expr, *args):
        d = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
        return d.select(expr(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()["x"]

    return f


@pytest.mark.parametrize(
    "text, want",
    [
        ("một người đàn ông đứng cạnh chiếc xe máy màu đỏ", ["đàn ông", "xe máy"]),
        ("một người đang đi bộ", ["người"]),
        ("có hai con chó và một cái bàn", ["chó", "bàn"]),
        ("chiếc áo màu xanh lá cây", ["áo"]),
        ("", []),
        (None, None),
        ("xe xe xe đạp", ["xe", "xe", "xe đạp"]),
    ],
)
def test_object_mentions(value, text, want):
    assert value(T.object_mentions, text) == want


@pytest.mark.parametrize("text, want", [("đang đạp xe", "đạp xe"), ("một chiếc xe đạp", "xe đạp"), ("xe hơi", "ô tô"), ("Người  phụ nữ", "phụ nữ"), ("một", "một"), (None, None)])
def test_canonical(value, text, want):
    assert value(T.canonical, text) == want


@pytest.mark.parametrize(
    "p, g, want",
    [
        ("xanh dương", "xanh lá", "xanh_confusion"),
        ("xanh", "xanh lá", "xanh_underspec"),
        ("xanh lam", "xanh", "xanh_overspec"),
        ("xanh", "xanh", "correct"),
        ("đỏ đậm", "đỏ", "correct"),
        ("đỏ", "đen", "other_color_error"),
        ("đỏ", "xanh", "other_color_error"),
        ("áo đỏ", "đỏ", "not_comparable"),
    ],
)
def test_color_error(value, p, g, want):
    assert value(T.color_error, p, g) == want


def test_xanh_phrases(value):
    assert value(T.xanh_phrases, "áo xanh, mũ xanh da  trời và xanh đậm, thanhxanh") == ["xanh", "xanh da trời", "xanh đậm"]
    assert [value(T.xanh_bucket, x) for x in ("xanh", "xanh đậm", "xanh rêu", "xanh ngọc")] == ["bare", "degree_only", "resolved", "unknown"]


@pytest.mark.parametrize("status, want", [("Verdict.SUPPORTED", "SUPPORTED"), (" rejected ", "REJECTED"), ("none", None), ("", None), (None, None), ("Uncertain", "UNCERTAIN")])
def test_verdict_name(value, status, want):
    assert value(T.verdict_name, status) == want


@pytest.mark.parametrize("a, want", [("Có, đúng vậy", "yes"), ("Không thấy", "no"), ("không rõ lắm", "uncertain"), ("Well, no", "no"), ("", "uncertain"), (None, None), ("có lẽ vậy", "uncertain"), ("không xác định được", "uncertain"), ("sai", "no"), ("Phải.", "yes"), ("có một con chó, không phải mèo", "yes"), ("một con chó, không phải mèo", "no")])
def test_yes_no(value, a, want):
    assert value(T.yes_no, a) == want


def test_small_functions(value):
    assert value(T.adjacent_duplicate, "con chó Chó nằm") and not value(T.adjacent_duplicate, "một người một bàn")
    assert value(T.question_key, "  Có  mấy người? ") == "có mấy người"
    assert len(value(T.prompt_hash, "x")) == 16
    assert value(T.genders, "một người phụ nữ và một đàn ông") == ["nam", "nu"]
    assert value(T.neutralise, "hai người đàn ông đi bộ") == "hai người đi bộ"
    assert value(T.neutralise, "cô ấy đội nón") == "đội nón" and value(T.neutralise, "cậu con trai, bà và cô  gái") == "người, người và người gái"
    assert value(lambda c: T.embedded_clause(c, True), "một người đang đi") is False and value(lambda c: T.embedded_clause(c, True), "cạnh một người phụ nữ đang đi") is True
    assert value(lambda c: T.whole_terms(c, L.CHALLENGE_GENDERED), "Cô gái, cô và anh ấy; cô") == ["cô gái", "cô", "anh"]
    assert value(lambda c: T.ngrams(F.split(c, " "), 2), "a b c") == ["a b", "b c"] and value(lambda c: T.ngrams(F.split(c, " "), 2), "a") == []
    assert value(lambda c: T.epistemic(c, F.lit(True)), "cái bàn")["tag"] == "INFERENCE"  # by substring, as published
    assert value(lambda c: T.epistemic(c, F.lit(True)), "đi chợ vui")["kind"] == "purpose"


def test_hypernyms_end():
    assert L.ancestors("bé trai") == ["bé trai", "đàn ông", "người"] and L.ancestors("cửa") == ["cửa"]


def _decide(spark, s, c, e, hard=False, parent=None):
    d = spark.createDataFrame([(s, c, e, hard, parent)], "s double, c double, e double, h boolean, p string")
    return tuple(d.select(rules.decide(F.col("s"), F.col("c"), F.col("e"), F.col("h"), F.col("p")).alias("x")).first()["x"])


def test_decide_order(spark):
    assert _decide(spark, 0.9, 0.0, 0.9) == ("SUPPORTED", "support")
    assert _decide(spark, 0.9, 0.9, 0.9, True, "REJECTED") == ("REJECTED", "hard_constraint")
    assert _decide(spark, 0.9, 0.0, 0.9, False, "REJECTED") == ("REJECTED", "cascade")
    assert _decide(spark, 0.1, 0.9, 0.1) == ("UNCERTAIN", "gate")
    assert _decide(spark, None, 0.6, 0.9) == ("REJECTED", "contradiction")
    assert _decide(spark, None, 0.1, 0.9) == ("UNCERTAIN", "no_support_signal")
    assert _decide(spark, 0.35, 0.3, 0.9) == ("REJECTED", "no_support")
    assert _decide(spark, 0.7, 0.21, 0.9) == ("UNCERTAIN", "unclear")


def test_scores(spark):
    d = spark.createDataFrame([(0.8, None, 0.4)], "v double, m double, g double")
    v, m, g = (F.col(c) for c in "vmg")
    r = d.select(rules.support_score(v, m, g).alias("s"), rules.support_score(m, m, m).alias("n"), rules.evidence([v], [g, m]).alias("e"), rules.cap(F.lit("SUPPORTED"), [F.lit("UNCERTAIN"), F.lit(None)]).alias("c"), rules.cap(F.lit(None), [F.lit("REJECTED")]).alias("cn")).first()
    assert abs(r["s"] - (0.8 * 0.6 + 0.4 * 0.2) / 0.8) < 1e-12 and r["n"] is None and r["e"] == 0.4 and r["c"] == "UNCERTAIN" and r["cn"] is None


def test_stability_and_entropy(spark):
    d = spark.createDataFrame([(2, 2, 0), (4, 0, 0), (1, 0, 0)], "a int, b int, c int")
    s = [r[0] for r in d.select(rules.stability([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert abs(s[0]) < 1e-12 and s[1:] == [1.0, None]
    assert spark.range(1).select(rules.entropy_bits(F.array(*[F.lit(2.0)] * 4))).first()[0] == 2.0


def test_iou(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    r = spark.range(1).select(rules.iou(box(0, 0, 2, 2), box(1, 0, 2, 2)).alias("a"), rules.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("b"), rules.iou(box(0, 0, 0, 0), box(0, 0, 0, 0), 0.0).alias("c")).first()
    assert abs(r["a"] - 1 / 3) < 1e-12 and r["b"] is None and r["c"] == 0.0
