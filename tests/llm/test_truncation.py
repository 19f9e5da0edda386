from claimframe.llm import truncation as T

FULL = ["con chó lớn nằm ngủ trên chiếc ghế gỗ.", "người bán hàng đang rót trà trong phòng tranh.", "hai em nhỏ thả diều trên bãi cát vàng.", "chiếc ghe cũ đặt cạnh cây cầu tre."]


def frame(spark, extra):
    rows = [("c", 1000 + i, "s", False, " ".join(FULL)) for i in range(12)] + [("c", k, "s", hit, t) for k, (t, hit) in enumerate(extra)]
    return spark.createDataFrame([r + ("x",) for r in rows], "src_table string, row_id long, origin string, limit_hit boolean, text string, key string")


def test_cuts(spark):
    d = frame(
        spark,
        [
            ("con chó lớn nằm ngủ trên chiếc", False),  # 0 inside a sentence
            ("người bán hàng đang rót tr", False),  # 1 inside a word
            ("hai em nhỏ thả diều trên bãi cát vàng", False),  # 2 complete but for its sign
            ("chiếc ghe cũ đặt cạnh cây cầu tre.", True),  # 3 a cut at a sentence's end
            ("chiếc ghe cũ đặt c�", False),  # 4 inside a character
            (None, True),
            ("  ", True),
            ("chiếc ghe cũ (bản nháp)", False),  # 7 closed
            ("chiếc ghe cũ,", False),  # 8
        ],
    )
    got = {r["row_id"]: r["cut"] for r in T.truncated(d).collect() if r["row_id"] < 100}
    assert got[0] and got[1] and got[4] and not got[2] and 3 not in got and 5 not in got and 6 not in got and 7 not in got


def test_cut_inside_the_first_word(spark):
    d = frame(spark, [("chiếc ghe cũ đặt cạnh cây cầu tre. Ngư", False), ("chiếc ghe cũ đặt cạnh cây cầu tre.\n* ha", False), ("chiếc ghe cũ đặt cạnh cây cầu tre. Xyzzy", False), ("ngườ", False)])
    got = {r["row_id"]: (r["cut"], r["reason"]) for r in T.truncated(d).collect() if r["row_id"] < 100}
    assert got == {0: (True, "inside a word"), 1: (True, "inside a word"), 2: (False, None), 3: (True, "inside a word")}


def test_width(spark):
    d = frame(spark, [(f"con chó lớn số {i} nằm ngủ trên chiếc ghế gỗ cạnh tường vôi trắng xoá"[:40], False) for i in range(9)])
    assert all(r["cut"] and r["at_limit"] for r in T.truncated(d).collect() if r["row_id"] < 100)


def test_rates_and_edges(spark, rows):
    d = frame(spark, [("con chó lớn nằm ngủ trên chiếc", False)])
    r = rows(T.truncation_rates(d, T.truncated(d)), "origin", "texts", "cut_texts")
    assert r == [("s", 13, 1)]
    none = d.where("false")
    assert T.truncated(none).count() == 0 and T.truncation_rates(none, T.truncated(none)).count() == 0
    long = frame(spark, [(" ".join(FULL * 4000) + " con chó lớn nằm ngủ trên", None)] * 2)
    assert [r["cut"] for r in T.truncated(long).collect() if r["row_id"] < 100] == [True, True]


def test_context_keeps_short_answers(spark):
    names = ["người bán hàng", "em nhỏ", "cô giáo", "thợ may"]
    rows = [("p", k, "s", None, f"{n} {a}", "ai đang") for k, (n, a) in enumerate((n, a) for n in ("một", "hai", "ba") for a in names)]
    rows += [("p", 100 + k, "s", None, f"một {a} đang đi chợ về nhà.", "hãy tả") for k, a in enumerate(names)] * 8
    d = spark.createDataFrame(rows, "src_table string, row_id long, origin string, limit_hit boolean, text string, head string")
    plain = {r["row_id"] for r in T.truncated(d).where("cut").collect()}
    assert plain and not {r["row_id"] for r in T.truncated(d, "head").where("cut").collect()}
