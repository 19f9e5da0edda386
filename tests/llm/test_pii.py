import unicodedata

import pytest

from claimframe.llm import pii as P


def kinds(text):
    return {(k, text[b:e]) for _, k, sign, b, e, *_ in P.candidates(text) if sign > 0}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Thư gửi về anh.ba+x@foto.example.net nhé", ("email", "anh.ba+x@foto.example.net")),
        ("(ha [at] lab [dot] test).", ("email", "ha [at] lab [dot] test")),
        ("Gọi (+84) 126-779-4123 ngay", ("phone", "(+84) 126-779-4123")),
        ("Call (212) 555-0194.", ("phone", "(212) 555-0194")),
        ("Zalo 01234081274.", ("phone", "01234081274")),
        ("SSN 666-89-1512.", ("id_number", "666-89-1512")),
        ("CCCD 098 242 520 863.", ("id_number", "098 242 520 863")),
        ("Điểm hẹn: 421/3 phố Sông Ngâu, Hà Sương.", ("address", "421/3 phố Sông Ngâu, Hà Sương")),
        ("Taken at Flat 9, 229 Fennmoor Rd, Harrowfen.", ("address", "Flat 9, 229 Fennmoor Rd, Harrowfen")),
        ("Envoyer au 336 avenue des Trois Puits, Valbrune.", ("address", "336 avenue des Trois Puits, Valbrune")),
        ("Kirim ke Jl. Jati Miring No. 131, Banyu Asri.", ("address", "Jl. Jati Miring No. 131, Banyu Asri")),
        ("Ghi chú của chị Lưu Lam Đăng bị thiếu.", ("person", "Lưu Lam Đăng")),
        ("The notes of Ms Ottoline Marsh lack a page.", ("person", "Ottoline Marsh")),
    ],
)
def test_seeds(text, want):
    assert want in kinds(text)


@pytest.mark.parametrize("text", ["Tệp 000000674102.jpg bị mờ.", "cỡ 1920x1080 điểm", "Mẻ chạy ngày 15/04/2031 cho 526 câu.", "Mã lô RS-819-8 đã khóa.", "Giá là 1.742.000 đồng", "Nhắc @nhomghinhan xem lại.", "Version 10.2.33.14 was used.", "Tiệm ảnh Đồi Sim mở cả ngày."])
def test_no_seeds(text):
    assert not kinds(text)


def test_offsets_in_odd_characters():
    t = "Gọi c​hị " + unicodedata.normalize("NFD", "Lưu Lam Đăng") + " hoặc аnh＠lab.test hay ba@lab.test nhé"
    v, at = P.view(t)
    assert len(at) == len(v) + 1 and at[-1] == len(t)
    got = {t[b:e] for _, _, _, b, e, *_ in P.candidates(t)}
    assert unicodedata.normalize("NFD", "Lưu Lam Đăng") in got and "ba@lab.test" in got


def corpus():
    given, family = "Anselm Corwin Maribel Solveig Yvaine Osric".split(), "Marsh Brook Fenn Okon".split()
    names = [f"{g} {f}" for g in given for f in family]
    rows = [f"The notes of Ms {n} lack a page." for n in names] + [f"Photographed by {n}." for n in names] + [f"According to {n}, it was noon." for n in names]
    rows += ["Saltmarsh Fair opens early."] * 9 + ["The Harrow Gallery lent the frame."] * 9 + [f"The card carries number {400000000 + k}." for k in range(5)] + [f"SSN 666-{10 + k}-1234." for k in range(9)] + [f"The card carries number 666-{30 + k}-1234." for k in range(9)]
    return names, list(enumerate(rows))


def test_bootstrapping_reaches_what_no_seed_names(spark):
    names, rows = corpus()
    rows += [(900, None), (901, ""), (None, "Gọi 01234081274."), (0, rows[0][1])]
    d = spark.createDataFrame([r + ("clash",) for r in rows], "doc_id long, text string, kind string")
    found = {(r["kind"], r["found_text"]) for r in P.personal_information(d, "doc_id", "text").collect()}
    assert {("person", n) for n in names} <= found
    assert ("id_number", "400000003") in found  # known by its context only
    assert not any("Saltmarsh" in t or "Harrow" in t or "According" in t for _, t in found)


def test_copies_change_nothing_and_a_wrong_title_spreads_not(spark):
    names, rows = corpus()
    rows = [t for _, t in rows] + ["Tiệm ảnh Đồi Sim mở cả ngày."] * 30 + ["Tiem cua anh Doi Sim mo ca ngay, nhé."] + [f"Version 3.6.13.{500 + k} was used." for k in range(9)]
    once, often = (
        {(r["kind"], r["found_text"]) for r in P.personal_information(spark.createDataFrame(list(enumerate(rows * n)), "i long, t string"), "i", "t").collect()} for n in (1, 10)
    )
    assert once == often and not any("Sim" in t or t.startswith("3.6") for _, t in once)


def test_longest_name_stays_whole(spark):
    family, given = "Lưu Ninh Chử Bách".split(), "Khuê Vân Hạ Mộc".split()
    names = [f"{a} {b} {c}" for a in family for b in given for c in given if b != c]
    rows = [f"Ghi chú của chị {n} bị thiếu." for n in names[:40]] + [f"Chú thích cũ: {n} và em gái." for n in names] + ["Ghi chú của anh Bách Khuê Vân bị thiếu.", "Chú thích cũ: Ninh Bách Khuê Vân và em gái."]
    found = {r["found_text"] for r in P.personal_information(spark.createDataFrame(list(enumerate(rows)), "i long, t string"), "i", "t").collect()}
    assert set(names) <= found and "Ninh Bách Khuê Vân" in found


def test_redaction_and_edges(spark, rows):
    d = spark.createDataFrame([(1, "Gọi 01234081274 hoặc a@b.example ngay."), (2, None), (3, "không có gì")], "i long, t string")
    f = P.personal_information(d, "i", "t")
    assert rows(P.redact(d, "i", "t", f)) == [(1, "Gọi <PHONE> hoặc <EMAIL> ngay."), (2, None), (3, "không có gì")]
    none = d.where("false")
    assert P.personal_information(none, "i", "t").count() == 0 and P.redact(none, "i", "t", f).count() == 0
    long = spark.createDataFrame([(1, "x " * 200_000 + "Gọi 01234081274.")], "i long, t string")
    assert P.personal_information(long, "i", "t").count() == 1
