"""Problem 4: one form for texts that look alike.

The skeleton of a text is made by decomposing it (canonically, and full-width,
font and presentation forms to their plain letters), replacing every character by
the prototype of its look-alike class, dropping what cannot be seen, and
decomposing again. Texts read the same exactly if their skeletons are equal once
runs of blanks are one space. Signs that read differently, such as superscripts
and fractions, stay what they are.

The skeleton is the key. ``unify`` gives the form that is stored in place of the
original: look-alike letters become Latin only in words that are otherwise Latin,
or that can be read as Latin in a text without words of their own script, so that
genuine Greek and Cyrillic words stay whole.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .common import stable

# Prototype, then letters of other scripts that look like it.
LOOKALIKES = """
A ΑАᎪ
B ΒВᏴ
C СϹᏟ
D Ꭰ
E ΕЕᎬ
F Ϝ
G ԌᏀ
H ΗНᎻ
I ΙІӀ
J ЈᎫͿ
K ΚКᏦ
L Ꮮ
M ΜМᎷ
N Ν
O ΟОՕ
P ΡРᏢ
Q Ԛ
S ЅᏚՏ
T ΤТᎢ
V ѴᏙ
W ԜᎳ
X ΧХ
Y ΥҮ
Z ΖᏃ
a аɑα
c сϲ
d ԁ
e еҽ
g ɡց
h һհ
i іɩι
j јϳ
k κ
l ӏ
n ոռ
o оοօ
p рρ
q ԛգ
r г
s ѕ
u սυ
v ѵν
w ԝա
x хχ
y уүγ
z ᴢ
Đ ÐƉ
đ ƌ
"""
LOOKALIKE = {ord(c): line[0] for line in LOOKALIKES.split("\n") if line for c in line[2:]}

#: Tags of decompositions that change a character's looks, not its reading.
_FORMS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<small>", "<vertical>", "<isolated>", "<initial>", "<medial>", "<final>")
_PLAINLY = {cp: unicodedata.normalize("NFKD", chr(cp)) for cp in (*range(0xA0, 0x10000), *range(0x1D400, 0x1D800)) if unicodedata.decomposition(chr(cp)).startswith(_FORMS)}
_FORM = re.compile("[" + "".join(map(re.escape, map(chr, _PLAINLY))) + "]")
_LOOKALIKE = re.compile("[" + "".join(map(chr, LOOKALIKE)) + "]")
#: Characters that show nothing: format controls, joiners, fillers, variation selectors.
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
_BLANKS = re.compile("[\u0009\u000b\u000c\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u2800\u3000]")
#: Composed letters, ideographs and common signs: each its own prototype and already composed.
PLAIN_CLASS = "\n\r\x20-\x7e\u00ab\u00bb\u00c0-\u00cf\u00d1-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u01a0\u01a1\u01af\u01b0\u1ea0-\u1ef9\u2013\u2014\u2018-\u201d\u2022\u3001\u3002\u3008-\u3011\u4e00-\u9fff\ufffd"
_PLAIN = re.compile(f"[{PLAIN_CLASS}]*")


def _decomposed(text: str) -> str:
    s = unicodedata.normalize("NFD", _BLANKS.sub(" ", _UNSEEN.sub("", text)))
    return unicodedata.normalize("NFD", s.translate(_PLAINLY)) if _FORM.search(s) else s


def _prototypes(s: str) -> str:
    return unicodedata.normalize("NFD", _LOOKALIKE.sub(lambda m: LOOKALIKE[ord(m[0])], s)) if _LOOKALIKE.search(s) else s


def skeleton(text: str) -> str:
    """Decomposed look-alike skeleton; line breaks stay, other blanks become spaces."""
    return _prototypes(_decomposed(text))


_LETTERS = re.compile("[^\\W\\d_]+(?:[\u0300-\u036f]+[^\\W\\d_]*)*")
_LATIN, _OTHER = re.compile("[A-Za-z\u00aa-\u024f\u1e00-\u1eff]"), re.compile("[\u0370-\u03ff\u0400-\u052f\u0531-\u058f\u13a0-\u13ff]")


def unify(text: str) -> str:
    """The one stored form of texts that read alike; equal to its argument for plain texts, and applied twice the same as once."""
    if _PLAIN.fullmatch(text):
        return text
    s = _decomposed(text)
    if _LOOKALIKE.search(s):
        # words with a letter of another script that no Latin letter looks like show that the text uses that script
        own = any((x := _OTHER.search(_LOOKALIKE.sub("", w))) for w in _LETTERS.findall(s))

        def word(m):
            w = m[0]
            if not _LOOKALIKE.search(w):
                return w
            genuine = not _LATIN.search(w) and (own or _OTHER.search(_LOOKALIKE.sub("", w)))
            return w if genuine else _prototypes(w)

        s = _LETTERS.sub(word, s)
    return unicodedata.normalize("NFC", s)


def reading(text: str | None) -> str | None:
    """What a text reads as: its recomposed skeleton with runs of blanks as one space and none at the ends; None stays None."""
    if text is None:
        return None
    return " ".join((text if _PLAIN.fullmatch(text) else unicodedata.normalize("NFC", skeleton(text))).split())


@arrow_udf(T.StringType())
def reading_udf(col: pa.Array) -> pa.Array:
    return pa.array([reading(x) for x in col.to_pylist()], pa.string())


@arrow_udf(T.StringType())
def unify_udf(col: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unify(x) for x in col.to_pylist()], pa.string())


def unified_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, unified, changed): the one form of every text that is not null.

    Null texts have no row; empty and blank ones have the empty form. Repeated rows give repeated rows.
    """
    d = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    return d.withColumn("unified", F.trim(F.regexp_replace(unify_udf("_text"), r"\s+", " "))).select("row_id", "unified", (F.col("unified") != F.col("_text")).alias("changed"))


def same_reading_classes(df: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """Rows of groups (``group_cols``) whose texts read the same though the strings differ.

    Returns the group columns, ``class_key`` (128-bit hash of the reading as two longs), ``form`` (hash of the
    string) and ``row_id``. Null and blank texts and rows with a null group column belong to no class. The
    classes are found by one aggregation on hashes with map-side combining, so a hot group costs no more than
    its distinct strings.
    """
    cols = [F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)]
    d = df.select(*cols, F.col(id_col).alias("row_id"), F.col(text_col).alias("_text"))
    for i in range(len(cols)):
        d = d.where(F.col(f"g{i}").isNotNull())
    d = d.where(F.col("_text").isNotNull()).withColumn("_r", reading_udf("_text")).where(F.col("_r") != "")
    d = d.select(*[f"g{i}" for i in range(len(cols))], "row_id", F.xxhash64("_r").alias("k1"), F.xxhash64("_r", F.lit(1)).alias("k2"), F.xxhash64("_text", F.lit(2)).alias("form"))
    key = [*(f"g{i}" for i in range(len(cols))), "k1", "k2"]
    mixed = d.groupBy(*key).agg(F.min("form").alias("_lo"), F.max("form").alias("_hi")).where("_lo <> _hi").select(*key)
    return d.join(mixed, key, "left_semi")


def same_reading_counts(df: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """(id, forms, rows): per class its smallest id, its different strings and its rows; rows repeated under one id count once."""
    key = [*(f"g{i}" for i in range(len(group_cols))), "k1", "k2"]
    c = same_reading_classes(df, id_col, text_col, group_cols).groupBy(*key, "form", "row_id").agg(F.lit(1).alias("_"))
    forms = c.groupBy(*key, "form").agg(F.count("*").alias("rows"), F.min("row_id").alias("id"))
    return forms.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("forms"), F.sum("rows").alias("rows")).select("id", "forms", "rows")


def same_reading_pairs(df: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of one group that read the same but are different strings.

    The different strings of a class are paired first, and each pair of strings is then opened into its rows, so that
    rows of equal strings never meet. Rows repeated under one id count once.
    """
    key = [*(f"g{i}" for i in range(len(group_cols))), "k1", "k2"]
    c = stable(same_reading_classes(df, id_col, text_col, group_cols).distinct())
    forms = c.select(*key, "form").distinct()
    two = forms.withColumnRenamed("form", "form_a").join(forms.withColumnRenamed("form", "form_b"), key).where("form_a < form_b")
    side = lambda x: c.select(*key, F.col("form").alias(f"form_{x}"), F.col("row_id").alias(f"row_{x}"))
    j = two.join(side("a"), [*key, "form_a"]).join(side("b"), [*key, "form_b"]).where("row_a <> row_b")
    return j.select(F.least("row_a", "row_b").alias("id_a"), F.greatest("row_a", "row_b").alias("id_b")).distinct()
