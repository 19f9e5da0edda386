import json

import pytest

from claimframe.sources import records as R


def write(p, x):
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False), encoding="utf-8")


def test_records(spark, tmp_path, rows):
    write(tmp_path / "r/1.json", {"image_id": "1", "propositions": [{"id": "P1", "type": "entity", "text_vi": "có chó", "verification": {"status": "SUPPORTED"}}], "selected_ids": ["P1"]})
    write(tmp_path / "r/2.json", {"image": {"image_id": "2"}, "selection": {"selected_ids": ["P3"], "uncertain_admitted_ids": []}, "propositions": []})
    write(tmp_path / "r/3.json", "{broken")
    write(tmp_path / "r/_report.json", {"image_id": "no"})
    good, bad = R.read_records(spark, str(tmp_path / "r"))
    assert rows(good, "image_id", "selected_ids") == [("1", ["P1"]), ("2", ["P3"])]
    assert bad.count() == 1
    assert rows(R.propositions(good), "image_id", "pos", "prop.verification.status") == [("1", 0, "SUPPORTED")]


def test_captions_of_either_shape(spark, tmp_path, rows):
    items = [{"image_id": "a", "caption": "x", "segment_caption": "x_y"}, {"image_id": "a", "caption": " "}, {"id": "b", "caption": "z"}]
    for name, doc in (("list.json", items), ("doc.json", {"annotations": items, "images": []})):
        write(tmp_path / name, doc)
        c = R.read_captions(spark, str(tmp_path / name))
        assert rows(c, "image_id", "caption") == [("a", "x"), ("b", "z")]
        assert rows(R.references(c)) == [("a", ["x"]), ("b", ["z"])]
        assert rows(R.caption_pairs(c)) == [("x", "x_y")]


def test_predictions(spark, tmp_path, rows):
    write(tmp_path / "p.json", {"predictions": {"1": "một", "2": ["hai", "ba"]}})
    write(tmp_path / "q.json", {"1": "một"})
    assert rows(R.read_predictions(spark, str(tmp_path / "p.json"))) == [("1", ["một"]), ("2", ["hai", "ba"])]
    assert rows(R.read_predictions(spark, str(tmp_path / "q.json"))) == [("1", ["một"])]


def test_shards_last_wins(spark, tmp_path, rows):
    write(tmp_path / "s/a.jsonl", '{"cocoid": "1", "caption": "old"}\n\n{"cocoid": "2", "caption": "two"}\n')
    write(tmp_path / "s/b.jsonl", '{"cocoid": "1", "caption": "mid"}\n{"cocoid": "1", "caption": "new"}\n')
    assert rows(R.read_shards(spark, str(tmp_path / "s/*.jsonl"))) == [("1", "new"), ("2", "two")]


def test_annotators(spark, tmp_path):
    doc = {"images": {"7": {"propositions": [{"type": "entity", "text_vi": "có mèo", "verdict": "SUPPORTED"}]}}}
    write(tmp_path / "a/gv1.json", doc)
    with pytest.raises(ValueError):
        R.read_annotators(spark, str(tmp_path / "a"))
    write(tmp_path / "a/gv2.json", doc)
    assert {r["annotator"] for r in R.read_annotators(spark, str(tmp_path / "a")).collect()} == {"gv1", "gv2"}


def test_terms(spark, tmp_path, rows):
    write(tmp_path / "s.txt", "dog, puppy\ncat, puppy\n")
    d = dict(rows(R.read_synonyms(spark, str(tmp_path / "s.txt"))))
    assert d["puppy"] == "cat" and d["dogs"] == "dog" and d["cates"] == "cat"
    write(tmp_path / "t.json", {"_note": "x", "dog": ["chó", "con chó"]})
    assert [tuple(r) for r in R.read_terms(spark, str(tmp_path / "t.json")).collect()] == [("dog", "con chó"), ("dog", "chó")]


def test_sinks(spark, tmp_path, rows):
    d = spark.range(20).selectExpr("id", "concat('t', id) AS t")
    R.write_shuffled_jsonl(d, "id", str(tmp_path / "o"))
    back = R.read_jsonl(spark, str(tmp_path / "o"), "id long, t string")
    assert rows(back) == rows(d)
    store = str(tmp_path / "store")
    assert R.append_missing(d.where("id < 5"), "id", store, "id long, t string") == 5
    assert R.append_missing(d, "id", store, "id long, t string") == 15
    assert R.append_missing(d, "id", store, "id long, t string") == 0
    R.write_cases(d.selectExpr("id", "t", "id % 2 AS c"), "c", "id", 3, str(tmp_path / "cases"))
    assert spark.read.json(str(tmp_path / "cases")).count() == 6


def test_config():
    c = R.load_config({"a": {"b": 1, "c": True}}, ["a.b=3", "a.c=false"])
    assert c == {"a": {"b": 3, "c": False}}
    with pytest.raises(KeyError):
        R.load_config({"a": {"b": 1}}, ["a.x=3"])
