"""Scalar functions over Vietnamese captions, all of them expressions that stay in the JVM.

Every function maps null to null; words are runs of letters in lower case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import lexicon as L


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def words(text: Column) -> Column:
    """Letter runs in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"))


def without_colour_phrases(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "|".join(L.COLOUR_PHRASES), " ")


def _found(joined: Column, terms: list[str]) -> Column:
    """Terms (words joined by single spaces) in ``joined``, leftmost and in the given order of preference."""
    return F.regexp_extract_all(joined, F.lit("(?<![^ ])(" + "|".join(terms) + ")(?![^ ])"))


def object_mentions(text: Column) -> Column:
    """Object head nouns in order: longest match wins, and a noun directly behind one of its hypernyms replaces it."""
    joined = F.array_join(words(without_colour_phrases(text)), " ")
    kinds = literal_map({n: "|".join(["", *L.ancestors(n)[1:], ""]) for n in L.OBJECT_NOUNS if n in L.HYPERNYMS})
    return F.aggregate(
        _found(joined, L.OBJECT_NOUNS),
        F.array().cast("array<string>"),
        lambda acc, n: F.when((F.size(acc) > 0) & F.coalesce(kinds[n], F.lit("")).contains(F.concat(F.lit("|"), F.try_element_at(acc, F.lit(-1)), F.lit("|"))), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(n))).otherwise(F.concat(acc, F.array(n))),
    )


def canonical(text: Column) -> Column:
    """One form for a noun phrase: synonyms, no aspect markers, no leading number marker or classifier."""
    syn = literal_map(L.SYNONYMS)
    known = lambda x: F.coalesce(syn[x], x)
    base = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    bare = F.array_join(F.filter(F.split(base, " "), lambda w: ~w.isin(*L.ASPECT_MARKERS)), " ")
    markers = "|".join(sorted(L.NUMBER_MARKERS, key=len, reverse=True))
    unmarked = F.regexp_replace(bare, f"^(?:{markers}) ", "")
    noun = F.regexp_replace(unmarked, f"^(?:{'|'.join(L.CLASSIFIERS)}) (?=.)", "")
    return F.when(syn[base].isNotNull(), syn[base]).when(syn[bare].isNotNull(), syn[bare]).when(syn[unmarked].isNotNull(), syn[unmarked]).otherwise(F.trim(known(noun)))


def contains_word(text: Column, terms: list[str]) -> Column:
    """Whether any term stands in the text between blanks."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), F.lit(" "))
    return reduce(lambda a, b: a | b, (padded.contains(f" {t} ") for t in terms))


def whole_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """The distinct terms that stand in a text between signs that are no letters or digits; earlier terms are tried first."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(terms)})(?![\p{{L}}\p{{N}}_])"), 1))


def genders(text: Column) -> Column:
    """The genders to which a caption commits: any of nam, nu."""
    return F.array_compact(F.array(F.when(contains_word(text, L.REPORT_MALE), "nam"), F.when(contains_word(text, L.REPORT_FEMALE), "nu")))


def mentions_person(text: Column) -> Column:
    return contains_word(text, [*L.REPORT_MALE, *L.REPORT_FEMALE, *L.REPORT_NEUTRAL])


def parse_color(text: Column) -> Column:
    """struct<canonical, is_xanh, xanh_value, modifier> of a colour expression."""
    raw = F.trim(F.lower(text))
    modifier = F.nullif(F.regexp_extract(raw, rf"(?:^|\s)({'|'.join(L.COLOR_MODIFIERS)})$", 1), F.lit(""))
    core = F.when(modifier.isNotNull(), F.trim(F.regexp_replace(raw, r"(?:^|\s+)\S+$", ""))).otherwise(F.regexp_replace(raw, r"\s+", " "))
    blue, green = core.isin(*L.XANH_BLUE), core.isin(*L.XANH_GREEN)
    return F.struct(
        F.when(blue, "xanh dương").when(green, "xanh lá").when(core.isin(*L.COLORS), core).alias("canonical"),
        (blue | green | (core == "xanh")).alias("is_xanh"),
        F.when(blue, "xanh_dương").when(green, "xanh_lá").when(core == "xanh", "xanh_không_xác_định").alias("xanh_value"),
        modifier.alias("modifier"),
    )


def color_code(text: Column) -> Column:
    """One key per colour: the colour itself, or x:blue, x:green and x:? for the readings of xanh; null if unread."""
    keys = {c: c for c in L.COLORS} | dict.fromkeys(L.XANH_BLUE, "x:blue") | dict.fromkeys(L.XANH_GREEN, "x:green") | {"xanh": "x:?"}
    return literal_map(keys)[F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), rf"(?:^| )(?:{'|'.join(L.COLOR_MODIFIERS)})$", "")]


def color_error(predicted: Column, gold: Column) -> Column:
    """How a predicted colour differs from gold, one of six outcomes."""

    def outcome(x):
        p, g = x["p"], x["g"]
        both = p.startswith("x:") & g.startswith("x:")
        return (
            F.when(p.isNull() | g.isNull(), "not_comparable")
            .when(p == g, "correct")
            .when(both & (p == "x:?"), "xanh_underspec")
            .when(both & (g == "x:?"), "xanh_overspec")
            .when(both, "xanh_confusion")
            .otherwise("other_color_error")
        )

    # bound in a lambda, so that each side is read once
    return F.element_at(F.transform(F.array(F.struct(color_code(predicted).alias("p"), color_code(gold).alias("g"))), outcome), 1)


def xanh_phrases(text: Column) -> Column:
    """`xanh` phrases read whole."""
    tail = "|".join(t.replace(" ", r"\s+") for t in L.XANH_TAILS)
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(xanh(?:\s+(?:{tail}))*)"), 1), lambda p: F.regexp_replace(p, r"\s+", " "))


def xanh_bucket(phrase: Column) -> Column:
    c = parse_color(phrase)
    return F.when(c["xanh_value"].isin("xanh_dương", "xanh_lá"), "resolved").when(c["xanh_value"].isNotNull(), F.when(c["modifier"].isNotNull(), "degree_only").otherwise("bare")).otherwise("unknown")


def spatial_terms(text: Column) -> Column:
    return _found(F.array_join(words(text), " "), sorted(L.SPATIAL_RELATIONS, key=lambda t: (-t.count(" "), t)))


def adjacent_duplicate(text: Column) -> Column:
    """Whether a word stands twice in a row, without regard to case."""
    return F.lower(text).rlike(r"(?:^|\s)(\S+)\s+\1(?=\s|$)")


def verdict_name(status: Column) -> Column:
    """A verdict in its one spelling; null for null, blank and "none"."""
    v = F.upper(F.trim(F.substring_index(F.trim(status), ".", -1)))
    return F.when(~v.isin("", "NONE", "NULL"), v)


def yes_no(answer: Column) -> Column:
    """yes, no or uncertain: marks of doubt first, then the first word, then any word, "no" before "yes"; null for null."""
    t = F.trim(F.regexp_replace(F.lower(answer), r"\s+", " "))
    w = F.split(t, " ")
    first = F.regexp_replace(F.element_at(w, 1), r"^[.,!?:;]+|[.,!?:;]+$", "")
    has = lambda xs: F.arrays_overlap(w, F.array(*map(F.lit, xs)))
    unsure = reduce(lambda a, b: a | b, (t.contains(m) for m in L.UNSURE))
    return F.when(t.isNull(), None).when(unsure, "uncertain").when(first.isin(*L.NO), "no").when(first.isin(*L.YES), "yes").when(has(L.NO), "no").when(has(L.YES), "yes").otherwise("uncertain")


def question_key(question: Column) -> Column:
    return F.lower(F.regexp_replace(F.rtrim(F.trim(question), F.lit("?. ")), r"\s+", " "))


def epistemic(text: Column, identity: Column) -> Column:
    """struct<tag, kind>: the first non-visual marker makes a speculation, a gendered noun in an identity claim an inference."""
    low = F.lower(text)
    kind = F.coalesce(*[F.when(low.contains(m), k) for m, k in L.NON_VISUAL_MARKERS.items()])
    gendered = reduce(lambda a, b: a | b, (low.contains(g) for g in L.GENDERED_NOUNS))
    return F.struct(F.when(kind.isNotNull(), "SPECULATION").when(identity & gendered, "INFERENCE").otherwise("OBSERVATION").alias("tag"), kind.alias("kind"))


def neutralise(text: Column) -> Column:
    """Pronouns of a gendered word and "ấy" dropped, gendered person nouns replaced by the neutral one, which stands once."""
    b, e = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    t = F.regexp_replace(text, rf"{b}(?:{'|'.join(L.PRONOUNS)})\s+ấy{e}", " ")
    t = F.regexp_replace(t, f"{b}(?:{'|'.join(sorted(L.UNCAP_GENDERED, key=len, reverse=True))}){e}", "người")
    t = F.regexp_replace(t, rf"{b}người(?:\s+người)+{e}", "người")
    return F.regexp_replace(F.regexp_replace(t, r"\s{2,}", " "), r"^\s+|\s+$", "")


def embedded_clause(text: Column, within: bool = False) -> Column:
    """Whether a text holds a clause of its own: a quantifier, one to six words and an aspect marker; with ``within`` not at its beginning."""
    clause = rf"(?:{'|'.join(L.CLAUSE_QUANTIFIERS)})\s+(?:\S+\s+){{1,6}}?(?:{'|'.join(L.CLAUSE_ASPECTS)})\s"
    found = text.rlike(rf"(?:^|\s){clause}")
    return found & ~text.rlike(f"^{clause}") if within else found


def prompt_hash(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 16)


def looks_vietnamese(text: Column) -> Column:
    return F.lower(text).rlike("[ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]")


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams joined by single spaces; empty where there are fewer tokens."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))
