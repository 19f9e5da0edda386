"""Problem 9: personal information inside free text.

Method: bootstrapped contextual extraction. Each document is searched once for
candidates: strings with the shape of a name, a number, an address or an e-mail
address, with the words to their left and right. Some candidates are seeds:
a title before a name; a number of a fitting form with a cue word beside it or an
international prefix; a house number with a street word; parts of e-mail
addresses are seeds for parts of names. Others are counter-examples: place names,
numbers behind words such as "version".

Equal strings are one instance. Instances and lexical patterns (words to the
left, words to the right, a name's word, a number's format) form a graph that
Spark scores in rounds: a pattern's confidence is the share of its distinct
positive instances among those that are decided, an instance is accepted when its
patterns together say so, and what is accepted teaches new patterns. Accepted
instances stay accepted, so the rounds end by themselves when none is added.
Because instances are distinct and confidences are rates, copies of documents
change nothing.

Offsets refer to the text as it stands; matching runs on a view of it with
look-alike characters unified, of which each character knows its place in the
original. Contexts and parts of instances are compared without accents and case.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, functions as F

from .canon import _PLAIN, PLAIN_CLASS, skeleton
from .common import map_columns, skew_join, stable

#: Score from which an instance is accepted.
TAKEN = 0.5
#: Confidence of a pattern about which nothing is known, and its weight in instances.
PRIOR, PRIOR_WEIGHT = 0.25, 1.0
#: Weight of an undecided instance of a pattern that has decided ones, against 1 for a decided one.
UNDECIDED = 0.1
#: Share of an instance's occurrences that must be certain by form for it to be a seed.
SEEDED = 0.1
#: Confidence that the first word of a sentence needs, as a part of names elsewhere, to belong to a name.
FIRST_WORD = 0.5
KINDS = ("email", "phone", "id_number", "address", "person")

_LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x1EA0, 0x1EFA))]
_ACCENTS = {ord(c): unicodedata.normalize("NFD", c)[0] for c in _LETTERS if len(unicodedata.normalize("NFD", c)) > 1} | {ord("đ"): "d", ord("Đ"): "D"}
_UP = "".join(c for c in _LETTERS if c.isupper())


def bare(text: str) -> str:
    """Lower case without accents."""
    return text.translate(_ACCENTS).lower()


#: Runs of characters that stay as they are, and single ones with what is put onto them.
_ONTO = "\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff"
_CLUSTER = re.compile(f"(?P<plain>[{PLAIN_CLASS}]+(?![{_ONTO}]))|[^{_ONTO}][{_ONTO}]*|.", re.S)


def view(text: str) -> tuple[str, list[int] | None]:
    """(text without look-alikes, begin of each of its characters in ``text`` and at last the end); None if places are the same."""
    if _PLAIN.fullmatch(text):
        return text, None
    out, at = [], []
    for m in _CLUSTER.finditer(text):
        if m.lastgroup:
            out.append(m[0])
            at.extend(range(m.start(), m.end()))
        else:
            u = unicodedata.normalize("NFC", skeleton(m[0]))
            out.append(u)
            at.extend([m.start()] * len(u))
    at.append(len(text))
    return "".join(out), at


# Titles before names; those of the second line may have a full stop behind them.
TITLES = frozenset("anh chị ông bà cô chú bác thầy pak bapak ibu bu tuan nyonya monsieur madame miss mister".split())
SHORT_TITLES = frozenset("mr mrs ms dr prof m mme mlle sdr bpk".split())
#: Titles that are no other word without accents; taken in texts that have none at all.
BARE_TITLES = SHORT_TITLES | frozenset("pak bapak ibu tuan nyonya monsieur madame miss mister".split())
# Street words, district words, with and without accents.
STREET_EN = "Street|St|Road|Rd|Lane|Ln|Close|Court|Ct|Avenue|Ave|Drive|Dr|Way|Row|Place|Terrace|Gardens|Square|Crescent|Boulevard|Blvd"
STREET_FR = "rue|avenue|impasse|chemin|all[eé]e|place|quai|boulevard|cours|route|passage|square"
STREET_VI = "đường|duong|phố|pho|đại lộ|dai lo|quốc lộ|quoc lo|tỉnh lộ|tinh lo"
LANE_VI = "hẻm|hem|ngõ|ngo|ngách|ngach|kiệt|kiet"
STREET_ID = "Jl|Jalan|Jln|Gg|Gang"
DISTRICT = "P|Q|TP|TX|TT|H|phường|phuong|quận|quan|thành phố|thanh pho|thị xã|thi xa|thị trấn|thi tran|xã|xa|huyện|huyen|tỉnh|tinh|Kel|Kec|Kota|Kab"

# Words beside a phone number, beside an identity number, and right before numbers that are neither, without accents.
PHONE_CUES = "goi|zalo|dt|sdt|dien thoai|so may|lien lac|hotline|tel|telp|telepon|telephone|phone|call|text|mobile|cell|whatsapp|appeler|appelez|joindre|hubungi|hp|wa|dien dan"
ID_CUES = "cccd|cmnd|cmt|can cuoc|dinh danh|chung minh|giay to|ho chieu|passport|ssn|social security|identity|identite|id card|id number|national id|nik|ktp|nir"
OTHER_CUES = "version|versi|phien ban|lo|batch|lot|file|tep|berkas|fichier|price|harga|prix|order|invoice|ngay|date|size|co anh|pixels"
# Words that begin or end the name of a place or shop.
PLACE_FIRST = "chợ|cầu|bến|đồi|phố|đường|tiệm|quán|sông|núi|chùa|đền|làng|xóm|bãi|cảng|ga|cho|cau|ben|pho|tiem|quan|rue|place|pont|marché|café|jalan|pasar|toko|warung|jembatan|pantai"
PLACE_LAST = "gallery|lane|fair|street|road|market|bridge|park|square|avenue|court|close|shop|store|café|hotel|station|museum|studio|school|hall|harbour|river|hill|valley|gardens|drive"

_CAP = rf"[{_UP}][\w'’-]*"
_CAPS = rf"{_CAP}(?: {_CAP}){{0,4}}"
_PLACES = rf"(?:, ?(?:(?i:{DISTRICT})\.? ?)?{_CAPS}(?:-le-{_CAP})?)*"
_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?"
    r"(?:@|＠|\s?[\[({<]\s?(?i:at|@|a|arobase|a còng|a cong)\s?[\])}>]\s?|\s(?i:at|arobase|a còng|a cong)\s(?=[\w-]+\s(?i:dot|point|chấm|cham|titik)\s))"
    r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]\s?(?i:dot|point|chấm|cham|titik|\.)\s?[\])}>]\s?|\s(?i:dot|point|chấm|cham|titik)\s)[A-Za-z0-9-]+)+"
)
_ADDRESS = [
    ("vi", re.compile(rf"\d+[A-Za-z]?(?:/\d+[A-Za-z]?)*,? (?:(?i:{LANE_VI}) \d+(?:/\d+)*,? )?(?P<strong>(?i:{STREET_VI}) )?{_CAPS}{_PLACES}")),
    ("en", re.compile(rf"\d+[A-Za-z]?,? (?:{_CAP} ){{1,3}}?(?P<strong>(?i:{STREET_EN})\b)(?:\.(?=,))?(?:, {_CAPS})*")),
    ("fr", re.compile(rf"\d+(?: ?(?:bis|ter))?,? (?P<strong>(?i:{STREET_FR}) )(?:(?i:de la|de l'|de|du|des|le|la|les|d'|l') ?)*{_CAPS}(?:, (?:\d{{5}} )?{_CAP}(?:-\w+)*)*")),
    ("id", re.compile(rf"(?P<strong>(?i:{STREET_ID})\.? ){_CAPS}(?:,? (?i:no|nomor)\.?)? ?\d+[A-Za-z]?(?:, ?(?:RT|RW)[\d /.]+)*{_PLACES}")),
]
_FLAT = re.compile(r"(?i:flat|apt|unit|suite)\.? \d+[A-Za-z]?, $")
_DIGITS = re.compile(r"\d+")
_AT = re.compile(r"[\[({<]\s?(?i:at|a|arobase|a còng|a cong)\s?[\])}>]")
_DOTS = tuple(f" {w} " for w in "dot point chấm cham titik DOT".split())
_STREET = re.compile(rf"[JGjg](?:l|alan|ln|g|ang)\b")
_NUMBER = re.compile(r"(?:\(?\+|\(\d{1,4}\)|\d)[\d \t().-]{5,22}\d(?![\w@]|[./,-]\w|\s?(?:x|×)\s?\d)")
_NAME = re.compile(rf"(?<![\w@/.-])(?:[{_UP}][\w'’-]*)(?: (?:[A-Z]\.|[{_UP}][\w'’-]+)){{1,5}}")
_MONEY = re.compile(r"\s*(?:đồng|dong|vnd|đ\b|d\b|usd|eur|euros?|rp|\$|€)", re.I)
_WORD = re.compile(r"[\w'’]+|[^\w\s]")
_BEFORE = re.compile(r"([^\W\d_]+)(\.? )$")
_NEAR_BEFORE = re.compile(r"([^\W\d_]+)[^\w\n]{0,3}$")
_AFTER = re.compile(r"[^\w\n]{1,3}([^\W\d_]+)")
_CUES = re.compile(rf"\b(?:(?P<phone>{PHONE_CUES})|(?P<id_number>{ID_CUES}))\b")
_OTHER_CUE = re.compile(rf"\b(?:{OTHER_CUES})\W*(?:so|no|nr|number|nomor)?\W*$")
_PLACE = re.compile(rf"(?i:(?:the )?(?:{PLACE_FIRST}) .*|.* (?:{PLACE_LAST}))$")
_STOPPED = re.compile(r"[.!?;:。！？]\s")
_START = re.compile(r"(?:^|[.!?;:。！？\n*+•|/(\"“«-]\s*|\d[.)]\s*)$")


def number_kinds(raw: str) -> tuple[list[str], str | None, str]:
    """(kinds that a string of digits and signs may be, kind if an international prefix makes it certain, format)."""
    digits = re.sub(r"\D", "", raw)
    n, form = len(digits), re.sub(r"\d", "9", raw)
    groups = [len(g) for g in re.findall(r"\d+", raw)]
    if not 7 <= n <= 18 or re.fullmatch(r"(?:19|20)\d\d[-. ]\d\d[-. ]\d\d", raw) or re.fullmatch(r"\d{1,2}[-.]\d{1,2}[-.](?:19|20)\d\d", raw):
        return [], None, form
    if re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", raw) and n < 10:
        return [], None, form
    if raw.count("(") != raw.count(")"):
        return [], None, form
    if raw.startswith(("+", "(+")):
        return (["phone"], "phone", form) if n <= 15 else ([], None, form)
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", raw):
        return ["id_number"], None, form
    if "(" in raw or re.fullmatch(r"\d{3}([-. ])\d{3}\1\d{4}", raw):
        return ["phone"], None, form
    if n > 15 or (n == 13 and len(groups) > 1):
        return ["id_number"], None, form
    return ["phone", "id_number"], None, form


def cue(flat: str, begin: int, end: int) -> str | None:
    """The kind that the words beside a number name: the nearest cue before it on its line, behind any other number, else one
    right behind it; "other" where a word such as "version" stands right before it; None without a cue."""
    left = re.split(r"\d{3,}", bare(flat[max(0, begin - 60) : begin].rpartition("\n")[2]))[-1]
    if _OTHER_CUE.search(left):
        return "other"
    own = _STOPPED.split(left)
    # "Tel. 01": the stop behind a cue ends no sentence
    near = own[-1] if own[-1].strip(" (") or len(own) < 2 else own[-2][-12:]
    for m in reversed(list(_CUES.finditer(near))):
        return m.lastgroup
    m = _CUES.search(_STOPPED.split(bare(flat[end : end + 30].partition("\n")[0]))[0])
    return m.lastgroup if m else None


def _context(flat: str, begin: int, end: int, sentence: bool = False) -> tuple[str, str]:
    """The two words to the left on the line and to the right in the sentence; with ``sentence`` none from the sentence before."""
    before = flat[max(0, begin - 40) : begin].rpartition("\n")[2]
    if sentence:
        before = re.split(r"(?<=[^\W\d_]{3})[.!?;。！？]\s|^[^\w]+|[*#+|/]\s", before)[-1]
    left = _WORD.findall(bare(before))
    right = _WORD.findall(re.split(r"[.!?;。！？](?:\s|$)", bare(flat[end : end + 40].partition("\n")[0]))[0])
    return " ".join(left[-2:]) or "^", " ".join(right[:2]) or "$"


def candidates(text: str) -> list[tuple]:
    """(shape, kind, sign, begin, end, left, right, parts) of all candidates of a text; offsets in the text itself.

    ``sign`` is 1 for what is certain by form and words beside it, -1 for counter-examples, else 0. Person candidates at
    the start of a sentence come twice, with and without their first word; ``parts`` of the longer one begin with a
    mark, so that a mere sentence start teaches nothing about names. Names of places in addresses are counter-examples
    of shape "place".
    """
    flat, at = view(text)
    place = (lambda b, e: (b, e)) if at is None else lambda b, e: (at[b], at[e])
    out, taken = [], []

    def free(b, e):
        return all(e <= x or b >= y for x, y in taken)

    for m in _EMAIL.finditer(flat) if "@" in flat or _AT.search(flat) or any(w in flat for w in _DOTS) else ():
        local = re.split(r"[@\[({<＠]| at ", m[0], maxsplit=1)[0].partition("+")[0]
        out.append(("email", "email", 1, *place(*m.span()), "", "", [p for p in re.split(r"[._\d-]+", local.lower().strip()) if len(p) > 2]))
        taken.append(m.span())
    digits = [m.start() for m in _DIGITS.finditer(flat)]
    digits = [b for b in digits if not b or not (flat[b - 1].isalnum() or flat[b - 1] in "_/.,-@#")]
    streets = [m.start() for m in _STREET.finditer(flat) if not m.start() or not flat[m.start() - 1].isalnum()] if digits else []
    for lang, rx in _ADDRESS:
        for b in streets if lang == "id" else digits:
            if (m := rx.match(flat, b)) is None or not free(b, e := m.end()):
                continue
            if lang == "en" and (f := _FLAT.search(flat, max(0, b - 24), b)):
                b = f.start()
            strong = bool(m["strong"]) or ", P. " in m[0] or ", phường " in m[0].lower()
            left, right = _context(flat, b, e)
            out.append(("address", "address", int(strong), *place(b, e), left, right, [lang]))
            if strong:
                taken.append((b, e))
                for x in _NAME.finditer(flat, b, e):
                    out.append(("place", "person", -1, *place(*x.span()), "", "", [bare(w) for w in x[0].split(" ")]))
    last = 0
    for b in digits:
        while b and flat[b - 1] in "(+":
            b -= 1
        if b < last or (b and (flat[b - 1].isalnum() or flat[b - 1] in "@/.,#-+")) or (m := _NUMBER.match(flat, b)) is None:
            continue
        last = e = m.end()
        if not free(b, e) or _MONEY.match(flat, e):
            continue
        if m[0][0] == "(" and ")" not in m[0]:
            b += 1
        kinds, sure, form = number_kinds(flat[b:e])
        left, right = _context(flat, b, e)
        named = cue(flat, b, e)
        for k in kinds:
            out.append(("number", k, 1 if k in (sure, named) else -1 if named == "other" else 0, *place(b, e), left, right, [form]))
    for m in _NAME.finditer(flat):
        b, e = m.span()
        if taken and not free(b, e):
            continue
        ws = m[0].split(" ")
        # a title that is another word without accents needs a line with accents
        titles = BARE_TITLES if flat[flat.rfind("\n", 0, b) + 1 : b].isascii() and m[0].isascii() else TITLES | SHORT_TITLES
        before, after = _BEFORE.search(flat, max(0, b - 24), b), _AFTER.match(flat, e)
        if m[0].isupper():
            near = [x[1] for x in (_NEAR_BEFORE.search(flat, max(0, b - 24), b), after) if x]
            if any(w.isupper() and len(w) > 1 for w in near):
                continue
        starts = bool(_START.search(flat[max(0, b - 6) : b]))

        def add(skip, seed, mark, own=ws, b=b, e=e):
            nb = b + sum(len(w) + 1 for w in own[:skip])
            parts = [bare(w) for w in own[skip:] if w[-1] != "."]
            if mark:
                parts[0] = "^" + parts[0]
            sign = 1 if seed else -1 if _PLACE.match(" ".join(own[skip:])) else 0
            out.append(("name", "person", sign, *place(nb, e), *_context(flat, nb, e, True), parts))

        title = before and (before[1].lower() in (SHORT_TITLES if before[2][0] == "." else titles)) and not (before[1].isupper() and len(before[1]) > 1) and (before[1].lower() != "m" or before[2][0] == ".")
        if len(ws) <= 5 and len(ws[0]) > 1:
            add(0, bool(title), starts)
        if len(ws) > 2 and len(ws[1]) > 2:
            if ws[0].lower().rstrip(".") in titles and not ws[0].isupper():
                add(1, True, False)
            elif starts:
                add(1, False, False)
    return out


_DDL = "doc_id long, shape string, kind string, sign int, begin int, stop int, found_text string, left string, right string, parts array<string>"


def find_candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(cols):
        names = ("doc_id", "shape", "kind", "sign", "begin", "stop", "found_text", "left", "right", "parts")
        rows = []
        for i, t in zip(cols["doc_id"], cols["text"]):
            for shape, kind, sign, b, e, left, right, parts in candidates(t):
                rows.append((i, shape, kind, sign, b, e, t[b:e], left, right, parts))
        return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    return map_columns(d, run, _DDL)


def _instance(c: DataFrame) -> F.Column:
    """Key of an instance: a name's words, else the string itself."""
    return F.when(F.col("shape").isin("name", "place"), F.concat_ws(" ", "parts")).otherwise(F.concat(F.lit("#"), "found_text"))


def accept(cands: DataFrame) -> DataFrame:
    """(kind, inst, score) of all accepted instances of ``find_candidates``.

    Nodes are left contexts, right contexts and parts, each per kind. An instance is positive at first if at least the
    share ``SEEDED`` of its occurrences is certain, a counter-example if one occurrence is and it isn't positive, or if it
    is accepted as another kind. A node's confidence is (positives + prior) / (positives + counter-examples + a tenth of
    the undecided + prior weight) over its distinct instances; a node without decided instances has the prior's
    confidence, for what is unknown says nothing. An instance's log-odds are the sum of its best left and best right
    context's and the mean of its parts' (twice that for names); contexts of signs only and of one instance are none,
    which counts as unknown for names and as nothing for the rest. An instance whose first word begins a
    sentence also needs that word as a part of names from elsewhere. Rounds go on until no instance is added; each adds
    at least one, so they end. Rows of one hot node or instance are never gathered: sums combine before the shuffle,
    and joins send the few nodes with much of all edges to every task.
    """
    c = cands.withColumn("inst", _instance(cands))
    seen = c.groupBy("kind", "inst").agg(F.count("*").alias("n"), F.count_if(F.col("sign") > 0).alias("yes"), F.count_if(F.col("sign") < 0).alias("no"))
    # the pieces of e-mail addresses teach about names
    mail = c.where("shape = 'email'").select(F.lit("person").alias("kind"), "inst").distinct()
    pos = F.col("yes") >= SEEDED * F.col("n")
    first = seen.select("kind", "inst", pos.alias("pos"), (~pos & (F.col("no") > 0)).alias("neg")).unionByName(mail.withColumns({"pos": F.lit(True), "neg": F.lit(False)}))
    words = lambda x: F.col(x).rlike(r"\w")
    plain = F.transform("parts", lambda p: F.struct(F.concat(F.lit("T "), F.ltrim(p, F.lit("^"))).alias("node"), p.startswith("^").alias("bound")))
    around = F.filter(F.array(*[F.when(words(x), F.struct(F.concat(F.lit(s), F.col(x)).alias("node"), F.lit(False).alias("bound"))) for s, x in (("L ", "left"), ("R ", "right"))]), lambda x: x.isNotNull())
    e = c.select(F.when(F.col("shape") == "email", "person").otherwise(F.col("kind")).alias("kind"), "inst", F.explode(F.concat(plain, around)).alias("x")).select("kind", "inst", "x.node", "x.bound").distinct()
    # a context with one instance teaches nothing
    degree = e.where(~F.col("bound")).groupBy("kind", "node").agg(F.count("*").alias("degree"))
    e = stable(skew_join(e, degree, ["kind", "node"], "left").where("degree > 1 OR node LIKE 'T %'").drop("degree"))
    state = stable(first.withColumn("score", F.when(F.col("pos"), 1.0)))
    ln = lambda x: F.log(x / (1 - x))
    unknown = float(PRIOR)
    while True:
        j = skew_join(e, state, ["kind", "inst"])
        decided = F.sum(F.col("pos").cast("double")), F.sum(F.col("neg").cast("double"))
        conf = j.where(~F.col("bound")).groupBy("kind", "node").agg(decided[0].alias("p"), decided[1].alias("q"), F.count("*").alias("n")).where("p + q > 0")
        value = (F.col("p") + PRIOR * PRIOR_WEIGHT) / (F.col("p") + F.col("q") + UNDECIDED * (F.col("n") - F.col("p") - F.col("q")) + PRIOR_WEIGHT)
        conf = conf.select("kind", "node", F.least(value, F.lit(0.98)).alias("conf"))
        open_ = j.where("NOT pos AND NOT neg").select("kind", "inst", "node", "bound")
        s = skew_join(open_, conf, ["kind", "node"], "left").withColumn("conf", F.coalesce("conf", F.lit(unknown)))
        best = lambda side: F.coalesce(F.max(F.when(F.col("node").startswith(side), F.col("conf"))), F.when(F.col("kind") == "person", unknown).otherwise(0.5))
        s = s.groupBy("kind", "inst").agg(best("L ").alias("l"), best("R ").alias("r"), F.avg(F.when(F.col("node").startswith("T "), ln(F.col("conf")))).alias("own"), F.min(F.when(F.col("bound"), F.col("conf"))).alias("start"))
        odds = ln(F.col("l")) + ln(F.col("r")) + F.when(F.col("kind") == "person", 2).otherwise(1) * F.coalesce("own", ln(F.lit(unknown)))
        s = s.select("kind", "inst", (1 / (1 + F.exp(-odds))).alias("score"), "start").where((F.col("score") >= TAKEN) & (F.coalesce("start", F.lit(1.0)) >= FIRST_WORD))
        # of several kinds the most likely is accepted
        top = s.groupBy("inst").agg(F.max(F.struct("score", "kind")).alias("b")).select("inst", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        new = stable(top)
        if new.isEmpty():
            break
        taken = new.select("inst", F.lit(True).alias("taken"))
        state = state.join(new.withColumnRenamed("score", "fresh"), ["kind", "inst"], "left").join(taken, "inst", "left")
        score = F.coalesce("score", "fresh")
        other = F.col("taken").isNotNull() & score.isNull()
        state = stable(state.select("kind", "inst", score.isNotNull().alias("pos"), (score.isNull() & (F.col("neg") | other)).alias("neg"), score.alias("score")))
    return state.where("pos").select("kind", "inst", "score")


def personal_information(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, kind, found_text, begin, stop, score): what stands in each text, none of it overlapping with better.

    Of overlapping candidates seeds stay first, then the longer, then the one with the higher score, then the
    earlier kind in alphabetical order. Null texts and null ids have no row. Rows repeated under one id give the same findings.
    """
    c = stable(find_candidates(df, id_col, text_col))
    known = accept(c)
    s = c.where("shape <> 'place'").withColumn("inst", _instance(c))
    own = F.when(F.col("sign") > 0, 1.0).otherwise(F.least("score", F.lit(0.99)))
    s = skew_join(s, known, ["kind", "inst"]).withColumn("score", own).select("doc_id", "kind", "found_text", "begin", "stop", "score").distinct()
    per = s.groupBy("doc_id").agg(F.collect_list(F.struct("score", (F.col("stop") - F.col("begin")).alias("size"), "kind", "begin", "stop", "found_text")).alias("all"))

    def best(cols):
        out: dict[str, list] = {k: [] for k in ("doc_id", "kind", "found_text", "begin", "stop", "score")}
        for i, found in zip(cols["doc_id"], cols["all"]):
            kept: list[dict] = []
            for x in sorted(found, key=lambda x: (x["score"] < 0.999, -x["size"], -round(x["score"], 6), x["kind"], x["begin"])):
                if all(x["stop"] <= y["begin"] or x["begin"] >= y["stop"] for y in kept):
                    kept.append(x)
            for x in kept:
                for k in out:
                    out[k].append(i if k == "doc_id" else x[k])
        return out

    return map_columns(per, best, "doc_id long, kind string, found_text string, begin int, stop int, score double")


def redact(df: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """(doc_id, text): every text with its findings replaced by ``<KIND>``; the rest is unchanged, null texts stay null."""
    per = found.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "stop", "kind")).alias("all"))
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(per, "doc_id", "left")

    def run(cols):
        out = []
        for t, found in zip(cols["text"], cols["all"]):
            if t is not None and found:
                for x in sorted(found, key=lambda x: -x["begin"]):
                    t = t[: x["begin"]] + f"<{x['kind'].upper()}>" + t[x["stop"] :]
            out.append(t)
        return {"doc_id": cols["doc_id"], "text": out}

    return map_columns(d, run, "doc_id long, text string")
