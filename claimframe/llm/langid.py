"""Problem 1: the language of texts and of the segments of mixed texts.

Method: rank-order n-gram profiles. Each language's most frequent character
n-grams (n = 2, 3) are ranked on a bounded sample of labelled rows; a segment's
own n-grams are ranked by frequency and compared to each profile by the
out-of-place distance: the sum over the segment's n-grams of the difference of
ranks, or a full penalty where the profile lacks the n-gram. N-grams that no profile
has would add the same penalty to every language; they are left out of ranks and
distance. The language with the least distance wins; the confidence is the
relative margin to the second.

Segments are sentences. All segments of a batch are ranked at once in NumPy.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .canon import unify
from .common import map_columns, stable
from .pii import view

LANGS = ("vi", "en", "zh", "fr", "id")
#: n-grams kept of a language's profile.
PROFILE = 300
#: Rank of an n-gram that a profile lacks: farther from any rank than the penalty.
MISSING = 20_000
#: Labelled rows of a language used to fit its profile: a bound, whatever the table's size.
SAMPLE = 1500

# Spellings of language labels (lower case, region and script removed).
LABELS = {
    "vi": "vi", "vie": "vi", "vn": "vi", "vietnamese": "vi", "tiếng việt": "vi",
    "en": "en", "eng": "en", "english": "en",
    "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "中文": "zh",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr",
    "id": "id", "ind": "id", "in": "id", "indonesian": "id", "bahasa indonesia": "id",
}
#: Labels that mean "unknown".
UNKNOWN = ("", "und", "unknown", "unk", "n/a", "na", "none", "null", "nil", "-", "--", "?", "??", "xx", "mul", "mis", "zxx", "other", "undefined")


def label_language(col: F.Column) -> F.Column:
    """The language a label names; null for null, blank and placeholder labels, the label itself if it names another language."""
    low = F.trim(F.lower(col))
    base = F.regexp_replace(low, r"^([a-z]{2,3})[-_].*$", "$1")
    m = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.when(low.isNull() | low.isin(*UNKNOWN), None).otherwise(F.coalesce(m[low], m[base], low))


_HAN = 0x3400
_CLASS = None


def _classes() -> np.ndarray:
    """Code point -> code used in n-grams: letters stay, ideographs are one letter, the rest is a space; 10 ends a segment."""
    global _CLASS
    if _CLASS is None:
        t = np.full(0x10000, 32, np.uint16)
        for cp in [*range(0x41, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x530)]:
            if unicodedata.category(chr(cp))[0] in "LM":
                t[cp] = cp
        t[0x3041:0x30FF] = 0x3042
        t[0xAC00:0xD7A4] = 0xAC00
        t[0x3400:0x4DC0] = _HAN
        t[0x4E00:0xA000] = _HAN
        t[10] = 10
        t[0x27] = 0x27
        _CLASS = t
    return _CLASS


def codes(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each position, segment of each position) with one space before and after each segment and no two spaces in a row."""
    if not segments:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    text = "\n".join(segments).lower()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _classes()[np.minimum(cp, 0xFFFF)]
    end = np.nonzero(c == 10)[0]
    if len(end) != len(segments) - 1:
        raise ValueError("a segment holds a line break")
    seg = np.zeros(len(c) + 1, np.int32)
    seg[end + 1] = 1
    seg = np.cumsum(seg[: len(c)], dtype=np.int32)
    c = np.where(c == 10, 32, c)
    keep = np.ones(len(c), bool)
    if len(c):
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep].astype(np.uint64), seg[keep]


def grams(c: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all 2- and 3-grams and their segments; n-grams across segments touch only the space between them."""
    pad = np.concatenate(([32], c, [32, 32])).astype(np.uint64)
    n = len(c)
    bi = (pad[:n] << np.uint64(16)) | c
    tri = (bi << np.uint64(16)) | pad[2 : n + 2]
    return np.concatenate((bi | np.uint64(1 << 48), tri | np.uint64(1 << 49))), np.concatenate((seg, seg))


@dataclass
class Profiles:
    """Profiles of several languages side by side: their n-grams, and the rank of each in every profile."""

    names: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    mult: int = 0
    table: np.ndarray | None = None

    BITS = 20

    def index(self) -> None:
        """A table from hashed key to n-gram without collisions among the profiles' n-grams."""
        rng = np.random.default_rng(1)
        while True:
            mult = int(rng.integers(1, 1 << 62)) * 2 + 1
            with np.errstate(over="ignore"):
                h = (self.keys * np.uint64(mult)) >> np.uint64(64 - self.BITS)
            if len(np.unique(h)) == len(h):
                break
        self.mult = mult
        self.table = np.zeros(1 << self.BITS, np.int16)
        self.table[h] = np.arange(len(self.keys))

    #: Segments ranked together; their counts are held as one dense matrix.
    ROWS = 512

    def distances(self, c: np.ndarray, seg: np.ndarray, rows: int) -> np.ndarray:
        """Out-of-place distance of each segment (rows) to each profile (columns), per n-gram of the segment."""
        V, out = len(self.keys), np.zeros((rows, len(self.names)), np.float32)
        if self.table is None:
            self.index()
        edge = np.searchsorted(seg, np.arange(0, rows + self.ROWS, self.ROWS))
        for k in range(len(edge) - 1):
            lo, hi, base = edge[k], edge[k + 1], k * self.ROWS
            if lo == hi:
                continue
            with np.errstate(over="ignore"):
                g, s = grams(c[lo:hi], seg[lo:hi] - base)
                i = self.table[(g * np.uint64(self.mult)) >> np.uint64(64 - self.BITS)]
            known = self.keys[i] == g
            counts = np.bincount(s[known] * np.int32(V) + i[known])
            cell = np.flatnonzero(counts.astype(bool))
            if not len(cell):
                continue
            row, col = np.divmod(cell.astype(np.int32), np.int32(V))
            # by segment and falling count; n-grams of equal count stay in the order of their place among the profiles
            n = counts[cell]
            bits = max(6, int(n.max()).bit_length())
            order = np.argsort(((row.astype(np.int64) << bits) | ((1 << bits) - 1 - n)).astype(np.uint16 if bits == 6 else np.uint64), kind="stable")
            col, sizes = col[order], np.bincount(row)
            at = np.cumsum(sizes) - sizes
            rank = np.minimum(np.arange(len(row)) - at[row], PROFILE).astype(np.int16)
            d = np.minimum(np.abs(self.ranks[col] - rank[:, None]), np.int16(PROFILE))
            there = np.flatnonzero(sizes)
            out[base + there] = np.add.reduceat(d, at[there], axis=0, dtype=np.int32) / sizes[there, None]
        return out

    def classify(self, c: np.ndarray, seg: np.ndarray, rows: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, index of the language of each segment or -1, confidence in [0, 1])."""
        lang = [n.split("/")[0] for n in self.names]
        uniq = list(dict.fromkeys(lang))
        if not rows or not uniq:
            return uniq, np.full(rows, -1), np.zeros(rows)
        d = self.distances(c, seg, rows)
        by = np.stack([d[:, [j for j, x in enumerate(lang) if x == u]].min(axis=1) for u in uniq], axis=1)
        best = by.argmin(axis=1)
        first = by[np.arange(rows), best]
        by[np.arange(rows), best] = np.inf
        second = by.min(axis=1) if len(uniq) > 1 else np.full(rows, float(PROFILE))
        ok = second > 0
        return uniq, np.where(ok, best, -1), np.where(ok, (second - first) / np.maximum(second, 1e-9), 0.0)


def count_grams(texts: list[str]) -> Counter:
    """n-gram keys of texts with their counts."""
    segs = [x for t in texts if t for x in t.split("\n") if x.strip()]
    if not segs:
        return Counter()
    g, _ = grams(*codes(segs))
    k, n = np.unique(g, return_counts=True)
    return Counter(dict(zip(k.tolist(), n.tolist())))


_MARKS = re.compile("[\u0300-\u036f]")


def without_accents(text: str) -> str:
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", text))).replace("đ", "d").replace("Đ", "D")


def profile(counts: Counter) -> list[tuple[int, float]]:
    total = sum(counts.values())
    return [(k, n / total) for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]]


def count_by_label(texts: list[str], labels: list[str], model: Profiles | None = None) -> dict[str, Counter]:
    """n-gram counts of labelled texts by label; with a model, only of the segments that it finds in the label's language."""
    by: dict[str, list[str]] = {}
    for t, lang in zip(texts, labels):
        by.setdefault(lang, []).append(unify(t))
    out = {}
    for lang, ts in by.items():
        segs = [x for t in ts for x in sentences(t)]
        if model is not None and segs:
            names, best, _ = model.classify(*codes(segs), len(segs))
            segs = [x for x, b in zip(segs, best) if b >= 0 and names[b] == lang]
        out[lang] = count_grams(segs)
        if lang == "vi":
            out["vi/plain"] = count_grams([without_accents(x) for x in segs])
    return out


def fit(df: DataFrame, text_col: str, label_col: str, langs: tuple[str, ...] = LANGS, sample: int = SAMPLE) -> Profiles:
    """Profiles of ``langs`` from at most about ``sample`` labelled rows of each.

    A row is taken if the hash of its text falls under the share ``sample / rows with that label``, so the sample
    is the same however the table is partitioned, and its size does not grow with the table. Vietnamese has a
    second profile from the same rows with accents removed. A language without labelled rows has no profile.
    The profiles are fitted twice: the second time without the segments that the first profiles find in another
    language than their label, so that wrong labels leave no trace.
    """
    d = df.select(F.col(text_col).alias("text"), label_language(F.col(label_col)).alias("lang"))
    d = d.where(F.col("lang").isin(*langs) & F.col("text").isNotNull() & (F.length("text") > 20))
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return assemble({})
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    rows = stable(d.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000))
    model = None
    w = Window.partitionBy("lang")
    for _ in range(2):

        def count(cols, model=model):
            by = count_by_label(cols["text"], cols["lang"], model)
            return {
                "lang": [k for k, c in by.items() for _ in c],
                "key": [x for c in by.values() for x in c],
                "n": [x for c in by.values() for x in c.values()],
            }

        counted = map_columns(rows, count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
        top = counted.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "key")), "share": F.col("n") / F.sum("n").over(w)}).where(F.col("r") <= PROFILE)
        found: dict[str, list[tuple[int, float]]] = {}
        for r in sorted(top.collect(), key=lambda r: (r["lang"], r["r"])):  # at most PROFILE rows of each of six profiles
            found.setdefault(r["lang"], []).append((r["key"], r["share"]))
        model = assemble(found)
    return model


def assemble(found: dict[str, list[tuple[int, float]]]) -> Profiles:
    """Profiles from ranked lists of n-gram keys with their share of the language's n-grams.

    An n-gram whose share is under a third of its share in another language came in with wrongly labelled rows
    and is left out.
    """
    names = sorted(found)
    place: dict[int, int] = {}
    most: dict[int, float] = {}
    for keys in found.values():
        for k, share in keys:
            most[k] = max(most.get(k, 0.0), share)
    kept = {n: [k for k, share in found[n] if share >= most[k] / 3] for n in names}
    for keys in kept.values():
        for r, k in enumerate(keys):
            place[k] = min(place.get(k, PROFILE), r)
    keys = sorted(place, key=lambda k: (place[k], k))
    at = {k: i for i, k in enumerate(keys)}
    ranks = np.full((len(keys), len(names)), MISSING, np.int16)
    for j, name in enumerate(names):
        for r, k in enumerate(kept[name]):
            ranks[at[k], j] = r
    p = Profiles(names, np.array(keys, np.uint64), ranks)
    if len(keys):
        p.index()
    return p


# ---- segments --------------------------------------------------------------

#: Ends of sentences: stop signs before a blank, line breaks, ideographic stops, list signs between sentences.
_CUT = re.compile(r"[.!?;。！？；\n/|*+•#]+(?:[\"'»)\]]*\s+|(?<=[。！？；\n])|$)")
#: Least size of a segment that counts as a whole sentence: words, and letters; ideographs.
MIN_WORDS, MIN_LETTERS, MIN_HAN = 4, 18, 6
#: Letters (an ideograph counts five) that a text must hold in another language than its first.
MIN_OTHER = 30
_MAIL = re.compile(r"\S*@\S+")
#: Least confidence with which a sentence may differ from the rest of its text.
SURE = 0.2


def sentences(text: str) -> list[str]:
    return [x for x in _CUT.split(text) if x]


@dataclass
class Segments:
    """The segments of a batch of texts, measured."""

    texts: list[str]
    owner: np.ndarray
    words: np.ndarray
    letters: np.ndarray
    han: np.ndarray
    names: list[str]
    lang: np.ndarray
    conf: np.ndarray

    @property
    def whole(self) -> np.ndarray:
        """Long enough to be a sentence rather than a head, name or stray words."""
        return (self.han >= MIN_HAN) | ((self.words >= MIN_WORDS) & (self.letters >= MIN_LETTERS))


def segments(texts: list[str], model: Profiles) -> Segments:
    segs: list[str] = []
    sizes = []
    for t in texts:
        own = sentences(_MAIL.sub(lambda m: " " * len(m[0]), unify(t)) if "@" in t else unify(t)) or [" "]
        sizes.append(len(own))
        segs += own
    c, seg = codes(segs)
    n = len(segs)
    space = c == 32
    begins = np.ones(len(c), bool)
    begins[1:] = space[:-1] | (seg[1:] != seg[:-1])
    count = lambda mask: np.bincount(seg[mask], minlength=n)
    han = count(c == _HAN)
    return Segments(segs, np.repeat(np.arange(len(texts)), sizes), count(begins & ~space), count(~space) - han, han, *model.classify(c, seg, n))


def languages(texts: list[str], model: Profiles, measured: Segments | None = None) -> list[list[tuple[str, float, int]]]:
    """Of each text its languages as (language, confidence, letters), largest first.

    Another language than the text's first counts only with a whole and sure sentence and ``MIN_OTHER`` letters. A text without a
    whole sentence is judged by all its segments together.
    """
    s = segments(texts, model) if measured is None else measured
    n, L = len(texts), len(s.names)
    out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
    if not L:
        return out
    whole, known = s.whole, s.lang >= 0
    none = np.bincount(s.owner[whole & known], minlength=n) == 0
    use = known & (whole | none[s.owner])
    o, lang, conf = s.owner[use], s.lang[use], s.conf[use]
    size = (s.letters + 4 * s.han)[use] + 1
    cell = o * L + lang
    sum_ = lambda v: np.bincount(cell, v, minlength=n * L).reshape(n, L)
    total, weight = sum_(size), sum_(size * conf)
    sure = sum_((conf >= SURE).astype(float)) > 0
    main = (weight + total * 1e-3).argmax(axis=1)
    there = total > 0
    for i in np.flatnonzero(there.any(axis=1)).tolist():
        m = main[i]
        res = [(s.names[j], float(weight[i, j] / total[i, j]), int(total[i, j])) for j in np.flatnonzero(there[i]).tolist() if j == m or (sure[i, j] and total[i, j] >= MIN_OTHER and not none[i])]
        out[i] = sorted(res, key=lambda r: (r[0] != s.names[m], -r[2]))
    return out


def text_languages(df: DataFrame, id_col: str, text_col: str, label_col: str, model: Profiles, src: F.Column | None = None) -> DataFrame:
    """(src_table, row_id, label, lang, confidence, mixed): one row per language of each text that is not blank.

    Null and blank texts and texts without any letter of a profile have no row. ``label`` is the language that the
    row's label names, null if it names none. Rows repeated under one id are treated each on its own.
    """
    d = df.select((F.lit("") if src is None else src).alias("src_table"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"), label_language(F.col(label_col)).alias("label"))

    def run(cols):
        out: dict[str, list] = {k: [] for k in ("src_table", "row_id", "label", "lang", "confidence", "mixed")}
        keep = [i for i, t in enumerate(cols["text"]) if t and t.strip()]
        for i, langs in zip(keep, languages([cols["text"][i] for i in keep], model)):
            for name, conf, _ in langs:
                for k, v in (("src_table", cols["src_table"][i]), ("row_id", cols["row_id"][i]), ("label", cols["label"][i]), ("lang", name), ("confidence", conf), ("mixed", len(langs) > 1)):
                    out[k].append(v)
        return out

    return map_columns(d.where("text is not null"), run, "src_table string, row_id long, label string, lang string, confidence double, mixed boolean")


def segment_spans(text: str, s: Segments, mine: np.ndarray, spans: list[tuple[int, int]], langs: list[str]) -> list[tuple[int, int, str, float]]:
    """(begin, end, language, confidence) of the segments of one text: neighbouring sentences of one of its languages.

    ``mine`` are the text's sentences in ``s``, ``spans`` their places, ``langs`` its languages, the first the main one. A
    sentence that is no whole one, or in none of these languages, belongs to the one before it, at the beginning to
    the next. A segment's confidence is its sentences', weighted by letters.
    """
    out: list[list] = []
    lead = None
    for i, (b, e) in zip(mine.tolist(), spans):
        name = s.names[s.lang[i]] if s.lang[i] >= 0 and s.whole[i] and s.names[s.lang[i]] in langs else None
        weight = float(s.letters[i] + 4 * s.han[i]) + 1e-9 if name else 0.0
        if name is None and not out:
            lead = b if lead is None else lead
        elif name is None or (out and out[-1][2] == name):
            x = out[-1]
            x[1], x[3], x[4] = e, x[3] + weight * float(s.conf[i]), x[4] + weight
        else:
            out.append([b if lead is None else lead, e, name, weight * float(s.conf[i]), weight])
            lead = None
    if not out and langs:
        return [(spans[0][0], spans[-1][1], langs[0], -1.0)]
    return [(b, e, name, c / w) for b, e, name, c, w in out]


def text_segments(df: DataFrame, id_col: str, text_col: str, model: Profiles, src: F.Column | None = None) -> DataFrame:
    """(src_table, row_id, segment, begin, stop, lang, confidence): the segments of every text that ``text_languages`` gives a language.

    Segments are numbered from 0; begin and stop are offsets in the text as it stands. A text without a whole sentence
    is one segment with the text's confidence.
    """
    d = df.select((F.lit("") if src is None else src).alias("src_table"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))

    def run(cols):
        out: dict[str, list] = {k: [] for k in ("src_table", "row_id", "segment", "begin", "stop", "lang", "confidence")}
        keep = [i for i, t in enumerate(cols["text"]) if t and t.strip()]
        texts = [cols["text"][i] for i in keep]
        s = segments(texts, model)
        found = languages(texts, model, s)
        edge = np.searchsorted(s.owner, np.arange(len(texts) + 1))
        for k, i in enumerate(keep):
            if not found[k]:
                continue
            flat, at = view(texts[k])
            spans, pos = [], 0
            for m in [*_CUT.finditer(flat), None]:
                stop = m.start() if m else len(flat)
                if stop > pos:
                    spans.append((pos, stop))
                pos = m.end() if m else pos
            place = (lambda x: x) if at is None else lambda x, at=at: at[x]
            mine = np.arange(edge[k], edge[k + 1])
            if len(mine) != len(spans):  # a blank text of signs only
                spans = [(0, len(flat))] * len(mine)
            for n, (b, e, name, conf) in enumerate(segment_spans(texts[k], s, mine, spans, [x[0] for x in found[k]])):
                row = (cols["src_table"][i], cols["row_id"][i], n, place(b), place(e), name, found[k][0][1] if conf < 0 else conf)
                for c, v in zip(out, row):
                    out[c].append(v)
        return out

    return map_columns(d.where("text is not null"), run, "src_table string, row_id long, segment int, begin int, stop int, lang string, confidence double")


def label_errors(found: DataFrame) -> DataFrame:
    """Of ``text_languages``: every language of mixed texts, and the language of texts whose label is missing or names another."""
    return found.where("mixed OR label IS NULL OR label <> lang").select("src_table", "row_id", "lang").distinct()
