import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from claimframe.llm import canon


@pytest.mark.parametrize(
    "a, b",
    [
        ("сhó", "chó"), ("ｃｏｎ　ｃｈó", "con chó"), (unicodedata.normalize("NFD", "người đường"), "người đường"), ("con chó", "con chó"),
        ("con​ chó﻿", "con chó"), ("co­n", "con"), ("Ðồi", "Đồi"), ("Νhắс", "Nhắc"), ("a  b\n", "a b"), ("ﬁ", "fi"),
    ],
)
def test_reads_the_same(a, b):
    assert canon.reading(a) == canon.reading(b)


@pytest.mark.parametrize("a, b", [("chó", "cho"), ("Chó", "chó"), ("chó.", "chó"), ("“a”", '"a"'), ("a-b", "a b")])
def test_reads_otherwise(a, b):
    assert canon.reading(a) != canon.reading(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_fast_path_and_fixed_point(t):
    slow = unicodedata.normalize("NFC", canon.skeleton(t))
    assert " ".join(slow.split()) == canon.reading(t) == canon.reading(canon.unify(t))
    assert canon.unify(canon.unify(t)) == canon.unify(t)


@pytest.mark.parametrize("t", ["Россия рост", "γεια", "x² và ½", "Эта со", "Ελλάδα"])
def test_genuine_scripts_stay(t):
    assert canon.unify(t) == t


def test_look_alikes_in_other_words_go():
    assert canon.unify("аnh со đẹp") == "anh co đẹp" and canon.reading("x²") != canon.reading("x2")


def test_classes(spark, rows):
    d = spark.createDataFrame([(5, "x", "con chó"), (3, "x", "сon chó"), (3, "x", "сon chó"), (9, "x", "con chó"), (1, "y", "con chó"), (2, "x", "con mèo"), (4, None, "con chó"), (6, "x", None)], "id long, img string, t string")
    assert rows(canon.same_reading_counts(d, "id", "t", ["img"])) == [(3, 2, 3)]
    assert rows(canon.same_reading_pairs(d, "id", "t", ["img"])) == [(3, 5), (3, 9)]
    assert canon.same_reading_counts(d.where("false"), "id", "t", ["img"]).count() == 0


def test_pairs_match_brute_force(spark, rows):
    rng = random.Random(3)
    base = ["con chó", "сon chó", "con  chó", "con chó", "con mèo", "ｃｏｎ mèo", "", " ", None, "​"]
    data = [(i, rng.choice(["x", "y", None]), rng.choice(base), "clash") for i in range(120)] + [(7, "x", "con chó", "clash")] * 2
    d = spark.createDataFrame(data, "id long, img string, t string, row_id string")
    want = set()
    for (i, g, t, _), (j, h, u, _) in itertools.combinations(set(data), 2):
        if g == h and g is not None and t and u and t != u and canon.reading(t) == canon.reading(u) != "" and i != j:
            want.add((min(i, j), max(i, j)))
    assert rows(canon.same_reading_pairs(d, "id", "t", ["img"])) == sorted(want, key=repr)


def test_edges(spark, rows):
    none = spark.createDataFrame([], "id long, img string, t string")
    assert canon.same_reading_pairs(none, "id", "t", ["img"]).count() == 0
    d = spark.createDataFrame([(1, None), (2, ""), (3, "сhó " * 20000)], "id long, unified string")
    got = rows(canon.unified_forms(d, "id", "unified"))
    assert [g[0] for g in got] == [2, 3] and got[0][1:] == ("", False) and got[1][2] is True
