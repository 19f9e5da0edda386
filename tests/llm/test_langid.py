import random
import unicodedata

import numpy as np
import pytest

from claimframe.llm import langid as L

SEEDS = {
    "vi": "người đàn ông đang đi bộ trên đường phố đông đúc vào buổi chiều|cô gái mặc áo dài màu trắng đứng trước cổng trường học|những chiếc thuyền nhỏ đang trôi trên dòng sông rộng lớn|hai đứa trẻ đang chơi bóng trong công viên gần nhà",
    "en": "a man is walking along the crowded street in the late afternoon|the girl wearing a white dress stands in front of the school gate|small boats are drifting on the wide river this morning|two children are playing with a ball in the park near home",
    "fr": "un homme marche le long de la rue bondée en fin de journée|la fille vêtue d'une robe blanche se tient devant la porte|de petits bateaux dérivent sur la large rivière ce matin|deux enfants jouent au ballon dans le parc près de la maison",
    "id": "seorang pria sedang berjalan di sepanjang jalan yang ramai pada sore hari|gadis yang memakai baju putih berdiri di depan gerbang sekolah|perahu kecil sedang hanyut di sungai yang lebar pagi ini|dua anak sedang bermain bola di taman dekat rumah",
    "zh": "一个男人下午走在拥挤的街道上|穿着白色裙子的女孩站在学校门口|小船今天早上在宽阔的河上漂流|两个孩子在家附近的公园里玩球",
}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = []
    for lang, s in SEEDS.items():
        for _ in range(60):
            rows.append((". ".join(rng.sample(s.split("|"), 2)) + ".", rng.choice([lang, lang, lang, lang.upper(), None]) if rng.random() > 0.07 else "vi"))
    rows += [(None, "vi"), ("", "en")]
    return L.fit(spark.createDataFrame(rows, "t string, lang string"), "t", "lang")


def test_profiles_of_all_languages(model):
    assert {n.split("/")[0] for n in model.names} == set(L.LANGS)


def test_single_languages(model):
    for lang, s in SEEDS.items():
        for t in s.split("|"):
            assert [x[0] for x in L.languages([t], model)[0]] == [lang]
    assert L.languages(["nguoi dan ong dang di bo tren duong pho vao buoi chieu"], model)[0][0][0] == "vi"


def test_mixed_and_stray(model):
    vi, en = SEEDS["vi"].split("|")[0], SEEDS["en"].split("|")[0]
    assert {x[0] for x in L.languages([f"{vi}. {en}."], model)[0]} == {"vi", "en"}
    assert [x[0] for x in L.languages([f"{vi} 一些 {vi}."], model)[0]] == ["vi"]
    assert [x[0] for x in L.languages([f"Captions 12\n{vi}."], model)[0]] == ["vi"]
    assert {x[0] for x in L.languages([f"{vi}. 一个男人下午走在街道上。"], model)[0]} == {"vi", "zh"}


def test_distance_by_hand():
    a, b = L.codes(["abab"])
    g, _ = L.grams(a, b)
    p = L.assemble({"x": [(int(k), 1 / (i + 1)) for i, k in enumerate(dict.fromkeys(g.tolist()))], "y": [(1, 1.0)]})
    d = p.distances(a, b, 1)[0]
    # ranks of the segment: by count, ties by the profiles' order, so the segment's own profile is close and the other far
    x = p.names.index("x")
    assert d[x] < L.PROFILE / 4 and d[1 - x] == L.PROFILE


def test_labels(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("vi-VN",), ("English",), ("zh_hans",), ("und",), (" ",), (None,), ("de",)], "l string")
    assert [r[0] for r in d.select(L.label_language(F.col("l"))).collect()] == ["vi", "en", "zh", None, None, None, "de"]


def test_edges(spark, rows, model):
    vi = SEEDS["vi"].split("|")[0]
    d = spark.createDataFrame([(1, None, "vi"), (2, "  ", "vi"), (3, "123 !!", "vi"), (4, vi, None), (4, vi, None), (5, (vi + ". ") * 3000, "en")], "id long, label string, lang string")
    got = rows(L.label_errors(L.text_languages(d, "id", "label", "lang", model)), "row_id", "lang")
    assert got == [(4, "vi"), (5, "vi")]
    none = d.where("false")
    assert L.text_languages(none, "id", "label", "lang", model).count() == 0
    empty = L.fit(none, "label", "lang")
    assert L.text_languages(d, "id", "label", "lang", empty).count() == 0
    assert L.languages([], model) == []
    assert np.isfinite(L.segments([vi, ""], model).conf).all()


def test_segments_have_places_in_the_text_as_it_stands(spark, model):
    vi, en = (SEEDS[x].split("|") for x in ("vi", "en"))
    odd = unicodedata.normalize("NFD", vi[0])
    texts = [f"{odd}. {vi[1]}. {en[0]}.\n12\n{en[1]}", vi[0], None, " ", "12 34", f"{en[0]}. {vi[0]}. {en[1]}."]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i long, t string, lang string")
    got: dict = {}
    for r in sorted(L.text_segments(d, "i", "t", model).collect(), key=lambda r: (r["row_id"], r["segment"])):
        assert 0 <= r["confidence"] <= 1
        got.setdefault(r["row_id"], []).append((r["lang"], texts[r["row_id"]][r["begin"] : r["stop"]]))
    assert got == {0: [("vi", f"{odd}. {vi[1]}"), ("en", f"{en[0]}.\n12\n{en[1]}")], 1: [("vi", vi[0])], 5: [("en", en[0]), ("vi", vi[0]), ("en", en[1])]}
    assert L.text_segments(d.where("false"), "i", "t", model).count() == 0


def test_many_equal_ngrams_keep_their_order(model):
    c, seg = L.codes(["đường " * 500 + SEEDS["vi"].split("|")[0]])
    assert np.isfinite(model.distances(c, seg, 1)).all()
