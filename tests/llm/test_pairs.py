import pytest

from claimframe.llm import pairs as P


@pytest.mark.parametrize("r", [None, "", " ​", "<p></p>", "N/A", "...", "[]", "</s>", "null", "``````", "[no response]"])
def test_empty(r):
    assert P.is_empty(r)


@pytest.mark.parametrize("r", ["Có.", "3", "Không ai cả.", "红色"])
def test_not_empty(r):
    assert not P.is_empty(r)


@pytest.mark.parametrize("p, r", [("Hãy tả tấm hình.", "hãy tả tấm hình"), ("Hãy tả tấm hình.", "Hãy tả tấm hình. Hãy tả tấm hình."), ("Hãy tả tấm hình này.", "Câu hỏi: Hãy tả tấm hình này."), ("Hãy tả tấm hình này.", "Hãy tả hình này"), ("[INST] Describe it now", "describe it now!")])
def test_copy(p, r):
    assert P.is_copy(p, r)


@pytest.mark.parametrize("p, r", [("Hãy tả tấm hình.", "Tấm hình có chó."), ("Có chó không?", "Có."), (None, "x y"), ("x y", None), ("Con mèo nằm ở đâu?", "Con mèo nằm ở trên ghế gỗ cũ.")])
def test_no_copy(p, r):
    assert not P.is_copy(p, r)


@pytest.mark.parametrize("r", ["Xin lỗi, tôi không thể xem hình ảnh.", "I'm afraid I can't help with that.", "As an AI language model, I describe.", "Je suis désolé, je ne peux pas.", "Maaf, saya tidak bisa membantu.", "抱歉，我无法查看图片。", "Yêu cầu này nằm ngoài những gì tôi có thể làm."])
def test_refusals(r):
    assert P.is_refusal(r)


@pytest.mark.parametrize("r", ['Biển treo ghi "xin lỗi, hết trà".', "Không thể nói chắc vì cái thang che khuất.", 'A sign reads "sorry, I cannot open".', "Không ai cả.", None])
def test_no_refusals(r):
    assert not P.is_refusal(r)


def test_asked_and_unclosed():
    assert P.asked_language("Hãy tả bằng tiếng Anh") == "en" and P.asked_language("Describe it") is None and P.asked_language("English to French") is None
    assert P.unclosed("a (b") and not P.unclosed("a (b)") and P.unclosed("```x") and not P.unclosed(None)


def test_defects(spark, rows):
    from test_langid import SEEDS

    from claimframe.llm import langid as L

    train = [(t, lang) for lang, s in SEEDS.items() for t in s.split("|") * 20]
    model = L.fit(spark.createDataFrame(train, "t string, lang string"), "t", "lang")
    vi, en = SEEDS["vi"].split("|"), SEEDS["en"].split("|")
    data = [(i, vi[0], f"{vi[1]}. {vi[2]}.") for i in range(20)] + [(20, vi[0], None), (21, vi[0], vi[0].upper()), (22, vi[0], f"{vi[1]}. {en[1]}."), (23, vi[0], f"{vi[1]} 红色."), (24, "Answer in English: " + vi[0], f"{en[1]}."), (25, vi[0], f"{vi[1]}. {vi[2][:30]}"), (26, None, vi[1] + "."), (20, vi[0], None)]
    d = spark.createDataFrame([x + ("s", "clash") for x in data], "id long, q string, response string, origin string, defect string")
    got = {r["pair_id"]: r["defect"] for r in P.defects(d, "id", "q", "response", "origin", model).collect()}
    assert [got[k] for k in range(20, 27)] == ["empty", "copy", "other_language", "other_language", None, "truncated", None] and got[0] is None
    assert P.defects(d.where("false"), "id", "q", "response", "origin", model).count() == 0
