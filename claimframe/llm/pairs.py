"""Problem 3: broken prompt and response pairs.

Method: ordered rules. Each rule looks for one defect of the response given its
prompt, and every rule that fires is reported: emptiness, a copied prompt, a
refusal in any of the languages, a script or language other than the one asked
for, unclosed delimiters, an abrupt ending. The first in that order is the pair's
defect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from .canon import unify
from .common import map_columns
from .langid import SURE, Profiles, segments
from .truncation import truncated

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")

_WORD = re.compile("[㐀-䶿一-鿿]|[^\\W_㐀-䶿一-鿿]+")
_TAG = re.compile(r"</?[a-z][^<>]{0,60}/?>|<\|[^|]{1,30}\|>|\[/?(?:INST|SYS|EOS|BOS|PAD)\]|<<?/?SYS>>?|</?s>|^#{1,6}\s|```\w*", re.I)
_HEAD = re.compile(r"^\s*(?:(?:human|user|assistant|system|prompt|question|instruction|người dùng|câu hỏi|hỏi|đáp|trả lời|q|a)\s*:\s*)+", re.I)
#: Responses that stand for none, without case and punctuation.
PLACEHOLDERS = frozenset("n a|na|none|null|nil|nan|todo|tbd|empty|no response|no answer|no caption|no output|not available|undefined|blank|chưa có|trống|không có|không có câu trả lời|vide|néant|kosong|tidak ada|无|空|response|answer|caption|placeholder|x|xx|xxx|lorem ipsum|eos|bos|pad|unk|image|p|br".split("|"))
# Refusals in the five languages, on text in lower case without quotations.
REFUSALS = re.compile(
    r"\b(?:tôi|mình|chúng tôi)\b[^.!?]{0,40}\b(?:không thể|chưa thể|không được phép|không có khả năng|xin phép không|xin từ chối|từ chối|không xem được|không nhìn thấy hình)\b"
    r"|\byêu cầu (?:này|đó)\b[^.!?]{0,40}\b(?:ngoài|không thể|từ chối)\b|\bmô hình ngôn ngữ\b|\b(?:toi|minh) (?:khong the|chua the|khong duoc phep|khong co kha nang|xin phep khong)\b|\bmo hinh ngon ngu\b"
    r"|\b(?:i|we)\b[^.!?]{0,40}\b(?:can ?not|can['’]?t|could not|couldn['’]?t|unable|not able|not allowed|not permitted|won['’]?t|will not|must decline|have to decline|decline|do not have the ability|am not in a position|would rather not|prefer not|refuse)\b"
    r"|\bas an? (?:ai|artificial|language model|assistant)\b|\b(?:request|question|that)\b[^.!?]{0,40}\b(?:cannot|can['’]?t|not allowed|beyond|outside)\b[^.!?]{0,40}\b(?:i|me|my|fulfil|fulfill|answer|help)\b|\bis something i\b|\b(?:beyond|outside) (?:what i can|my)\b"
    r"|\bje\b[^.!?]{0,30}\b(?:ne peux|ne suis|n['’]ai pas|refuse|dois refuser)\b|\bmodèle de langage\b|\bdésolée?\b[^.!?]{0,60}\bje\b"
    r"|\bsaya\b[^.!?]{0,30}\b(?:tidak (?:bisa|dapat|boleh|mampu)|belum bisa|menolak)\b|\bmodel bahasa\b"
    r"|(?:我|本人)[^。！？]{0,15}(?:无法|不能|不可以|没有能力|拒绝)|语言模型|抱歉[^。！？]{0,20}(?:无法|不能)"
)
_QUOTED = re.compile(r"[\"“«‹„][^\"”»›“]{0,200}[\"”»›“]")
# Names of the languages in the languages, as prompts use them.
ASKED = (
    ("vi", re.compile(r"\bvietnamese\b|tiếng việt|tieng viet|\bvietnamien\b|越南语|越南文|bahasa vietnam", re.I)),
    ("en", re.compile(r"\benglish\b|tiếng anh|tieng anh|\banglais\b|英语|英文|bahasa inggris", re.I)),
    ("zh", re.compile(r"\bchinese\b|tiếng trung|tiếng hoa|tieng trung|\bchinois\b|中文|汉语|bahasa (?:mandarin|cina|tionghoa)", re.I)),
    ("fr", re.compile(r"\bfrench\b|tiếng pháp|tieng phap|\bfrançais\b|法语|法文|bahasa prancis", re.I)),
    ("id", re.compile(r"\bindonesian\b|tiếng indonesia|\bindonésien\b|印尼语|印度尼西亚语|bahasa indonesia", re.I)),
)
_DELIMITERS = (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”"), ("«", "»"), ("（", "）"))
_HAN = re.compile("[㐀-䶿一-鿿]")


def cleaned(text: str | None) -> str:
    """Unified text without markup and template remains; "" for null."""
    return "" if text is None else _HEAD.sub("", _TAG.sub(" ", unify(text))).strip()


def is_empty(response: str | None) -> bool:
    t = cleaned(response)
    w = _WORD.findall(t.lower())
    return not w or " ".join(w) in PLACEHOLDERS or bool(re.fullmatch(r"[\[(<{][^\])>}]{0,30}[\])>}]", t))


def _near(a: list[str], b: list[str]) -> bool:
    """a is b or b less one word."""
    if a == b:
        return True
    if len(a) != len(b) - 1 or len(b) < 3:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def is_copy(prompt: str | None, response: str | None, lead: int = 6) -> bool:
    """Whether the response is nothing but the prompt: once or twice, behind a lead-in of a few words, one word dropped at most."""
    p, r = (_WORD.findall(cleaned(x).lower()) for x in (prompt, response))
    n, m = len(p), len(r)
    if n < 2 or not n - 1 <= m <= 2 * n + lead:
        return False
    for k in range(0, min(lead, m) + 1):
        rest = r[k:]
        if abs(len(rest) - n) <= 1 and _near(rest, p):
            return True
        for h in (n - 1, n, len(rest) // 2):
            if 0 < h < len(rest) and _near(rest[:h], p) and _near(rest[h:], p):
                return True
    return False


def is_refusal(response: str | None) -> bool:
    return bool(REFUSALS.search(_QUOTED.sub(" ", cleaned(response).lower())))


def unclosed(response: str | None) -> bool:
    """An opening delimiter, or a code fence, without its closing one."""
    if not response:
        return False
    t = unify(response)
    return any(t.count(a) > t.count(b) for a, b in _DELIMITERS) or t.count("```") % 2 == 1


def asked_language(prompt: str) -> str | None:
    """The language a prompt asks for by name, None if it names none or several."""
    found = [lang for lang, rx in ASKED if rx.search(prompt)]
    return found[0] if len(found) == 1 else None


def _rules(cols, model: Profiles):
    out: dict[str, list] = {"pair_id": cols["pair_id"], "empty": [], "copy": [], "refusal": [], "other_language": [], "unclosed": [], "words": []}
    prompts, responses = [cleaned(x) for x in cols["prompt"]], [cleaned(x) for x in cols["response"]]
    ps = segments([p.replace("\n", " ") for p in prompts], model)
    main: list[str | None] = [None] * len(prompts)
    best = [0.0] * len(prompts)
    for o, k, c, n in zip(ps.owner, ps.lang, ps.conf, ps.letters + ps.han):
        if k >= 0 and n * c > best[o]:
            main[o], best[o] = ps.names[k], float(n * c)
    asked = [asked_language(p) or m for p, m in zip(prompts, main)]
    rs = segments([_QUOTED.sub(" ", r) for r in responses], model)
    other = [False] * len(prompts)
    for o, k, c, whole in zip(rs.owner, rs.lang, rs.conf, rs.whole):
        if whole and k >= 0 and c >= SURE and asked[o] is not None and rs.names[k] != asked[o]:
            other[o] = True
    for i, (p, r) in enumerate(zip(cols["prompt"], cols["response"])):
        han = bool(_HAN.search(responses[i]))
        out["empty"].append(is_empty(r))
        out["copy"].append(is_copy(p, r))
        out["refusal"].append(is_refusal(r))
        out["other_language"].append(other[i] or (han and asked[i] not in (None, "zh")))
        out["unclosed"].append(unclosed(r))
        out["words"].append(len(_WORD.findall(responses[i])))
    return out


def defects(df: DataFrame, id_col: str, prompt_col: str, response_col: str, origin_col: str, model: Profiles) -> DataFrame:
    """(pair_id, defects array, defect): every defect a pair shows, in the order of ``DEFECTS``, and the first of them.

    Pairs without a defect have an empty array and a null defect. A null response is empty; with a null prompt no
    response is a copy or in another language. Pairs repeated under one id are judged each on its own and give equal
    rows once.
    """
    d = df.select(F.col(id_col).cast("long").alias("pair_id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response"), F.col(origin_col).alias("origin"))
    ruled = map_columns(d.select("pair_id", "prompt", "response"), lambda cols: _rules(cols, model), "pair_id long, empty boolean, copy boolean, refusal boolean, other_language boolean, unclosed boolean, words int")
    # answers to prompts that begin with one word end alike
    head = F.regexp_extract(F.lower(F.regexp_replace(F.coalesce("prompt", F.lit("")), r"<[^>]*>|\[[^\]]*\]", " ")), r"\p{L}+", 0)
    t = d.select(F.lit("pairs").alias("src_table"), F.col("pair_id").alias("row_id"), "origin", F.lit(None).cast("boolean").alias("limit_hit"), F.col("response").alias("text"), head.alias("head"))
    cut = truncated(t, "head").select(F.col("row_id").alias("pair_id"), "cut", "reason").groupBy("pair_id").agg(F.max("cut").alias("cut"), F.max("reason").alias("reason"))
    j = ruled.join(cut, "pair_id", "left")
    short = (F.col("words") <= 3) & ~F.coalesce(F.col("reason").isin("inside a word", "inside a character"), F.lit(False))
    j = j.withColumn("truncated", F.col("unclosed") | (F.coalesce("cut", F.lit(False)) & ~short))
    fired = F.filter(F.array(*[F.when(F.col(x), F.lit(x)) for x in DEFECTS]), lambda x: x.isNotNull())
    # an empty response shows nothing else
    fired = F.when(F.col("empty"), F.array(F.lit("empty"))).otherwise(fired)
    return j.select("pair_id", fired.alias("defects")).withColumn("defect", F.try_element_at("defects", F.lit(1))).distinct()
