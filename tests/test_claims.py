import json

import pytest
from pyspark.sql import functions as F

from claimframe import schema
from claimframe.operators import claims as C


def prop(**k):
    base = {"id": "P1", "type": "entity", "text_vi": "có chó", "subject": {"entity_id": None, "text_vi": "một con chó", "head_noun_vi": "chó"}, "verification": {"status": "SUPPORTED"}}
    return base | k


@pytest.fixture(scope="module")
def records(spark):
    def f(*docs):
        d = spark.createDataFrame([(json.dumps(x, ensure_ascii=False),) for x in docs], "j string")
        return d.select(F.from_json("j", schema.record_schema()).alias("r")).select("r.*")

    return f


def first(records, p, expr, *more):
    d = records({"image_id": "1", "propositions": [p, *more]})
    return d.select(expr(*[F.element_at("propositions", k + 1) for k in range(1 + len(more))]).alias("x")).first()["x"]


def test_questions(records):
    q = first(records, prop(), C.questions)
    assert tuple(q) == ("Trong ảnh có một con chó không", "Có đúng là trong ảnh KHÔNG có một con chó không")
    colour = prop(type="attribute", attributes=[{"kind": "màu_sắc", "value_vi": "đen"}])
    assert first(records, colour, C.questions)["claim"] == "Trong ảnh, một con chó có màu đen không"
    assert first(records, prop(type="action", predicate={"lemma_vi": "đang chạy"}), C.questions)["negation"] == "Có đúng là một con chó KHÔNG chạy không"
    assert first(records, prop(type="action"), C.questions) is None
    assert first(records, prop(type="relation", predicate={"lemma_vi": "cắn"}), C.questions) is None
    n = prop(type="counting", count={"value": 2, "classifier": "con", "entity_category_vi": "chó"})
    assert first(records, n, C.questions)["claim"] == "Trong ảnh có đúng 2 con chó không"


@pytest.mark.parametrize(
    "rel, a, b, want",
    [
        ("bên trái", (0, 0, 10, 10), (50, 0, 10, 10), True), ("bên_phải", (0, 0, 10, 10), (50, 0, 10, 10), False), ("phía trước", (0, 0, 10, 10), (50, 0, 10, 10), None),
        ("bên trái", (0, 0, 10, 10), (1, 0, 10, 10), None), ("trên", (0, 0, 10, 10), (0, 50, 10, 10), True), ("trong", (10, 10, 5, 5), (0, 0, 50, 50), True),
        ("trong", (0, 0, 5, 5), (50, 50, 5, 5), False), ("ngoài", (0, 0, 5, 5), (50, 50, 5, 5), True), ("gần", (0, 0, 5, 5), (5, 0, 5, 5), True), ("xa", (0, 0, 5, 5), (90, 90, 5, 5), True),
        ("gần", (0, 0, 10), (5, 0, 5, 5), None), ("trên", None, (0, 0, 1, 1), None),
    ],
)
def test_geometry(spark, rel, a, b, want):
    box = lambda v: F.lit(None).cast("array<double>") if v is None else F.array(*[F.lit(float(x)) for x in v])
    assert spark.range(1).select(C.geometry(F.lit(rel), box(a), box(b), F.lit(100.0), F.lit(100.0))).first()[0] is want


def test_matches(records):
    man, person = (prop(subject={"text_vi": t, "head_noun_vi": t}) for t in ("người đàn ông", "người"))
    woman = prop(subject={"text_vi": "phụ nữ", "head_noun_vi": "phụ nữ"})
    assert first(records, man, C.matches, person) and not first(records, man, C.matches, woman)
    assert not first(records, man, lambda p, g: C.matches(p, g, True), person)
    red = prop(type="attribute", attributes=[{"kind": "màu_sắc", "value_vi": "đỏ"}])
    assert first(records, red, C.matches, red)
    unread = prop(type="attribute", attributes=[{"kind": "màu_sắc", "value_vi": "áo đỏ"}])
    assert not first(records, unread, C.matches, unread)  # a whole value that is no colour matches nothing
    two, three = (prop(type="counting", count={"value": n, "tolerance": t}) for n, t in ((2, 0), (3, 1)))
    assert first(records, two, C.matches, three) and not first(records, three, C.matches, two)
    assert not first(records, prop(type="scene"), C.matches, prop())


def uncertain(**k):
    probes = [{"polarity": "affirms", "samples": ["Có.", "có"]}, {"polarity": "refutes", "samples": ["Không"]}]
    return prop(text_vi="một người đàn ông đi bộ", verification={"status": "UNCERTAIN"}, evidence={"probes": probes, "visual_grounding": {"grounding_score": 0.95}, "external_knowledge": {"inference_type": None}}) | k


def test_uncap(records, rows):
    e = uncertain()["evidence"]
    bad = [
        uncertain(verification={"status": "REJECTED"}), uncertain(text_vi="một người đi bộ"), uncertain(type="relation"), uncertain(evidence=e | {"external_knowledge": {"inference_type": "purpose"}}),
        uncertain(evidence=e | {"visual_grounding": {"grounding_score": 0.8}}), uncertain(evidence=e | {"probes": e["probes"][:1]}), uncertain(evidence=e | {"probes": [e["probes"][0], {"polarity": "refutes", "samples": ["Có"]}]}), uncertain(evidence=None),
    ]
    out = C.uncap(records({"image_id": "1", "propositions": [uncertain(), *bad]}, {"image_id": "2"})).orderBy("image_id").collect()
    p = out[0]["propositions"]
    assert out[0]["n_uncapped"] == 1 and p[0]["text_vi"] == "một người đi bộ" and p[0]["verification"]["status"] == "SUPPORTED"
    assert [x["verification"]["status"] for x in p[1:]] == [b["verification"]["status"] for b in bad] and out[1]["n_uncapped"] == 0


def captioned():
    spans = [
        {"text": "một con chó", "proposition_ids": ["P1", "P9"], "is_factual": True}, {"text": "chạy", "proposition_ids": ["P1", "P2"]}, {"text": "có lẽ", "span_role": "hedge", "proposition_ids": ["P3"]},
        {"text": "nối", "is_factual": False, "proposition_ids": ["P3"]}, {"text": "ngờ", "proposition_ids": ["P3"]},
    ]
    ps = [prop(), prop(id="P2", type="action", predicate={"lemma_vi": "chạy"}), prop(id="P3", type="scene")]
    return {"image_id": "1", "propositions": ps, "caption": {"spans": spans, "hedged_spans": ["ngờ"], "ungrounded_spans": ["một con mèo", "một con mèo", "chạy", "ngờ", " "]}}


def test_caption_claims(records, rows):
    got = rows(C.caption_claims(records(captioned(), {"image_id": "2", "propositions": []})), "image_id", "pos", "prop.id", "ungrounded")
    assert got == [("1", 0, "P1", None), ("1", 1, "P2", None), ("1", 1_000_000, None, "một con mèo")]


def test_factuality(records, rows):
    gold = {"image_id": "1", "propositions": [prop(), prop(id="P5", type="scene"), prop(id="P6", verification={"status": "REJECTED"})]}
    got = C.factuality(records(captioned()), records(gold)).collect()[0]
    # claims: entity .5, action 1.5, ungrounded 1.0; the entity is borne out; of entity and scene the entity is covered
    assert (got["claims"], got["hits"], got["refs"], got["covered"]) == (3.0, 0.5, 1.0, 0.5)
    unread = {"image_id": "1", "propositions": [prop(), prop(id="P7", verification={"status": None})]}
    assert C.factuality(records(captioned()), records(unread)).count() == 0


def test_prf(records, rows):
    pred = {"image_id": "1", "propositions": [prop(), prop(id="P2"), prop(id="P3", type="scene")]}
    gold = {"image_id": "1", "propositions": [prop(adversarial=True), prop(id="P2"), prop(id="P3", type="action", predicate={"lemma_vi": "chạy"})]}
    got = {r["type"]: (r["tp"], r["fp"], r["fn"]) for r in C.prf(records(pred), records(gold)).collect()}
    # true gold goes first; the second entity meets the adversarial one and is wrong
    assert got["entity"] == (1, 1, 0) and got["action"] == (0, 0, 1) and got["scene"] == (0, 1, 0) and got[None] == (1, 2, 1)


def test_rungs_and_realisation(records, spark, rows):
    ps = [prop(text_vi="a"), prop(text_vi="A "), prop(text_vi="b", verification={"status": "UNCERTAIN"}), prop(text_vi="c", verification={"status": "REJECTED"}), prop(text_vi="d", verification={"status": None})]
    got = dict((r, t) for _, r, t in rows(C.rungs(records({"image_id": "1", "propositions": ps}))))
    assert got == {"A": ["a"], "B": ["a", "b"], "C": ["a", "b", "c"]}
    x = spark.range(1).select(C.realise(F.array(F.lit("một con chó"), F.lit("hai người")), 320).alias("x")).first()["x"]
    assert all(x["text"][s["char_start"] : s["char_end"]] == s["text"] for s in x["spans"]) and len(x["spans"]) == 2
    assert len(spark.range(1).select(C.realise(F.array(F.lit("abc"), F.lit("defg")), 5).alias("x")).first()["x"]["spans"]) == 1


def test_template_captions_realise_every_claim(spark, tmp_path):
    from claimframe.plans.annotation_queries import template_captions

    many = [f"Vật số {i} trên bàn" for i in range(14)]
    rows = [(100 + i, "a", "entity", t) for i, t in enumerate(many)] + [(1, "b", "entity", "x" * 300), (2, "b", "scene", "y" * 30), (3, "b", "scene", "z"), (4, "c", "scene", "Một"), (5, "c", "scene", "hai"), (6, "c", "count", "ba"), (7, "c", "scene", "MỘT"), (8, None, "scene", "t"), (9, "d", "scene", None)]
    spark.createDataFrame(rows, "label_id long, image_id string, prop_type string, text_vi string").repartition(3).write.parquet(str(tmp_path / "annotations.parquet"))
    got = {r["image_id"]: r for r in template_captions(spark, str(tmp_path)).collect()}
    for k, texts in {"a": [t.lower() for t in many], "b": ["x" * 300, "y" * 30, "z"], "c": ["một", "hai", "ba"]}.items():
        kept = list(texts)
        while len(", ".join(kept)) > 320:
            kept.pop()
        assert got[k]["caption"] == ", ".join(kept) and [x["text"] for x in got[k]["spans"]] == kept and got[k]["n"] == len(texts)
        assert all(got[k]["caption"][x["char_start"] : x["char_end"]] == x["text"] for x in got[k]["spans"])
    assert set(got) == {"a", "b", "c"} and len(got["a"]["spans"]) == 14


def test_id_order(spark):
    d = spark.createDataFrame([("P10",), ("P2",), ("x",), ("P1",)], "i string")
    assert [r[0] for r in d.orderBy(C.id_order(F.col("i"))).collect()] == ["P1", "P2", "P10", "x"]
