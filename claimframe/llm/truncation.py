"""Problem 2: texts cut off inside a word or sentence.

Method: self-join by prefix. The value looked up is a text that ends open, as a
whole and as its last, open sentence. Prefixes of all lengths of all texts and
sentences of the corpus are hashed, and those whose hash some open value has are
joined to it: where copies go on behind the value and none stops there, it is a
strict prefix of longer copies and was cut inside a sentence. Values without a
longer copy of that length are looked up by shorter and shorter ends: windows of
their last 5, 3, 2 and 1 words (ideographs each a word), which smooth one
another. A last word that hardly ever follows its predecessor, while words that it
is a strict prefix of do, was cut inside the word. Ends that often end sentences
elsewhere mark a complete text that merely lacks its final sign. Lengths at which
many open texts of one origin stop (a field's width), and generation limits where
known, raise the odds of a cut. All conditions are shares, so that a corpus of any
size is judged alike.

Only what some open value asks for is counted and shuffled: the asked hashes are
put into a bitmap of bounded size which every task holds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .canon import unify
from .common import MULT, Hashes, Lexer, all_windows, slices, stable, windows

#: Window sizes, longest first.
WINDOWS = (5, 3, 2, 1)
#: Window sizes that stand for the open sentence from its beginning, and for the whole text.
SENTENCE, TEXT = 90, 91
#: The open sentence less its last word, and its last word behind that.
PARENT, BEHIND = 92, 93
#: The word before the last one, with the last one's first letter.
BEFORE = 94
#: A last word was cut if it follows its predecessor at most so often, against the longer words that do; more where the
#: length is suspicious.
RARE, RARE_AT_LIMIT = 0.02, 0.1
#: Most bits of the bitmap of asked hashes, and bits for each hash below that.
MOST_BITS, BITS_EACH = 27, 5
#: Weight, in copies, of the next smaller window's share of stops.
PRIOR = 4
#: A window that stops at least this often among its copies may be the end of a sentence; higher where the length is suspicious.
STOPS, STOPS_AT_LIMIT = 0.04, 0.6
#: A length is a field's width if this share of its origin's open texts, and at least so many, have it.
WIDTH_SHARE, WIDTH_LEAST = 0.08, 6
#: Tokens gathered before they are counted together.
FLUSH = 400_000

_TOKEN = re.compile("[^\\W\\d_㐀-䶿一-鿿]+|\\d+|[㐀-䶿一-鿿]|[.!?;…。！？¶]+|[,:，、：]")
_DIGITS = re.compile(r"\d+")
_STOPS = frozenset(".!?;…。！？\n¶")
#: Signs that may follow a stop, and closing signs whose opening sign must stand before them.
_TRAIL = " \t\r\n\"'*_-"
_PAIRS = {")": "(", "]": "[", "»": "«", "”": "“", "’": "‘", "}": "{", "】": "【", "』": "『", "」": "「", "）": "（", "》": "《"}


def tokens(text: str) -> list[str]:
    """Words in lower case, ideographs, stops and commas; the value of numbers doesn't matter."""
    return _TOKEN.findall(_DIGITS.sub("0", text.lower()))


def lines(text: str) -> str:
    """The unified text with line breaks as stops of their own."""
    return unify(text).replace("\n", " ¶ ")


def open_end(text: str | None) -> str | None:
    """``text`` without trailing blanks if it ends open: without a stop and not behind a closing sign; else None."""
    if text is None:
        return None
    t = unify(text).rstrip(_TRAIL)
    if not t or t[-1] in _STOPS or t[-1] == ".":
        return None
    if t[-1] in _PAIRS and _PAIRS[t[-1]] in t:
        return None
    return t


_STOP_ID, _END_ID = np.uint64(2), np.uint64(3)
#: Stands for the predecessor of a sentence's first word; no token.
_START = "^"


def lexer(names: dict[int, str] | None = None) -> Lexer:
    """Token numbers; all stops have one number. ``names`` collects the words behind the numbers."""
    hashes = Hashes()

    def code(w: str) -> int:
        if w[0] in _STOPS:
            return int(_STOP_ID)
        # bits 4 to 15 tell the first letter
        n = hashes[w] & ~0xFFFF | (ord(w[0]) & 0xFFF) << 4 | 8
        if names is not None:
            names[n] = w
        return n

    return Lexer(tokens, code)


#: Texts of at most so many tokens whose open end counts as a stop for other texts of their context: short answers
#: seldom have a final sign, and cuts seldom fall on the same place twice.
BRIEF = 10
#: Added to the size of windows that are counted per context.
IN_CONTEXT = 10


def _key(h: np.ndarray, n: int, context: np.ndarray | int = 0) -> np.ndarray:
    return h ^ np.uint64(n * 0x51ED27) ^ context


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def prefix_hashes(ids: np.ndarray, *starts: np.ndarray) -> list[np.ndarray]:
    """Hashes of ids[start[i] .. i] for every position i, for each of ``starts``: a polynomial in an odd base, shifted to its start."""
    out = []
    with np.errstate(over="ignore"):
        n = len(ids)
        power, back = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        power[:1] = back[:1] = 1
        np.cumprod(power, out=power)
        np.cumprod(back, out=back)
        power *= ids
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(power, out=total[1:])
        for start in starts:
            h = total[1:] - total[start]
            h *= back[start]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            out.append(h ^ (h >> np.uint64(32)))
    return out


def _before(word: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of a word and the first letter of the next."""
    with np.errstate(over="ignore"):
        return _key(word * MULT + (last & np.uint64(0xFFF0)), BEFORE) * MULT


def _starts(place: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of every position, the one behind the last stop before it."""
    return np.concatenate(([0], np.maximum.accumulate(np.where(stop, place + 1, 0))[:-1]))[: len(place)]


class Asked:
    """A bitmap of the keys that open ends ask for; says of keys whether they may be among them."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - bits), words

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        i = keys.view(np.uint64) >> self.shift
        return (self.words[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) != 0


def ask(ends: DataFrame) -> Asked:
    """The bitmap of all keys of ``ends``. It has at most 2 ** MOST_BITS bits, and no more words are collected."""
    keys = ends.select(F.explode("keys").alias("k")).select("k.key").distinct()
    n = keys.count()
    bits = min(MOST_BITS, max(16, n.bit_length() + BITS_EACH))
    at = F.shiftrightunsigned("key", 64 - bits)
    w = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {64 - bits}) & 63 AS INT))").alias("b"))
    rows = w.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return Asked(bits, words)


def _count(ids: np.ndarray, asked: Asked, context: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window key, copies that stop there, copies that go on) of the asked windows and prefixes of ``ids``; with contexts also of windows in each."""
    mark = ids <= _END_ID
    broken = np.concatenate(([0], np.cumsum(mark)))
    after = np.append(ids[1:], _END_ID)
    keys, stops = [], []

    def add(code, ok, stop):
        ok = np.flatnonzero(ok)
        ok = ok[asked(code[ok])]
        keys.append(code[ok])
        stops.append(stop[ok])

    if context is not None:
        end = np.flatnonzero(ids == _END_ID)
        brief = np.repeat(np.diff(np.concatenate(([-1], end))) <= BRIEF + 1, np.diff(np.concatenate(([-1], end))))
    for n, h in all_windows(ids, WINDOWS).items():
        last = np.arange(n - 1, len(ids))
        within = broken[last + 1] == broken[last + 1 - n]
        inner = within & (after[last] != _END_ID)
        add(_key(h, n), inner, after[last] == _STOP_ID)
        if context is not None:
            add(_key(h, n + IN_CONTEXT, context[last]), inner | (within & brief[last]), after[last] <= _END_ID)
    place = np.arange(len(ids))
    starts = _starts(place, mark), _starts(place, ids == _END_ID)
    for n, start, h in zip((SENTENCE, TEXT), starts, prefix_hashes(ids, *starts)):
        add(_key(h, n), ~mark & (after != _END_ID) & (place > start), after == _STOP_ID)
    k, inv = np.unique(np.concatenate(keys), return_inverse=True)
    s = np.bincount(inv, np.concatenate(stops), minlength=len(k)).astype(np.int64)
    return k, s, np.bincount(inv, minlength=len(k)) - s


def window_counts(df: DataFrame, text_col: str, asked: Asked, context_col: str | None = None) -> DataFrame:
    """(key, stops, goes_on, prefix_of) over all texts: how often each asked window or prefix is followed by a stop or by a word.

    ``prefix_of`` counts, for pairs of a word and the beginning of its successor, the longer successors. Counts are
    combined within tasks before the shuffle.
    """
    schema = pa.schema([("key", pa.int64()), ("stops", pa.int64()), ("goes_on", pa.int64()), ("prefix_of", pa.int64())])
    sent = df.sparkSession.sparkContext.broadcast(asked)

    def emit(held, contexts, names):
        asked = sent.value
        ids = np.concatenate(held)
        k, s, o = _count(ids, asked, np.concatenate(contexts) if context_col else None)
        zero = np.zeros(len(k), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.view(np.int64), s, o, zero)], schema=schema)
        hashes = Hashes()
        # pairs of words whose first word some open end has before its last; the first words of sentences follow a mark
        ok = np.flatnonzero((ids[:-1] > _END_ID) & (ids[1:] > _END_ID) & asked(_before(ids[:-1], ids[1:])))
        _, at, n = np.unique(windows(ids, 2)[ok], return_index=True, return_counts=True)
        begins = [(f"{names[a]}\1", names[b], c) for a, b, c in zip(ids[ok[at]].tolist(), ids[ok[at] + 1].tolist(), n.tolist())]
        first = ids[(np.concatenate(([_END_ID], ids[:-1])) <= _END_ID) & (ids > _END_ID)]
        begins += [(f"{_START}\1", names[b], c) for b, c in zip(*(x.tolist() for x in np.unique(first, return_counts=True)))]
        # words behind the beginnings of sentences that some open end has before its last word
        place = np.arange(len(ids))
        parent = _key(prefix_hashes(ids, _starts(place, ids <= _END_ID))[0], PARENT)[:-1]
        ok = np.flatnonzero((ids[:-1] > _END_ID) & (ids[1:] > _END_ID) & asked(parent))
        with np.errstate(over="ignore"):
            _, at, n = np.unique(parent[ok] * MULT + ids[ok + 1], return_index=True, return_counts=True)
        begins += [(f"{a}\1", names[b], c) for a, b, c in zip(parent[ok[at]].tolist(), ids[ok[at] + 1].tolist(), n.tolist())]
        parts = hashes.array([f"{a}{b[:m]}\2" for a, b, _ in begins for m in range(1, len(b))])
        times = np.repeat([c for _, _, c in begins], [len(b) - 1 for _, b, _ in begins]).astype(np.int64)
        ok = asked(parts)
        k, inv = np.unique(parts[ok], return_inverse=True)
        n = np.bincount(inv, times[ok], minlength=len(k)).astype(np.int64)
        zero = np.zeros(len(k), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.view(np.int64), zero, zero, n)], schema=schema)

    def run(batches):
        names: dict[int, str] = {}
        lex, held, contexts, size = lexer(names), [], [], 0
        for whole in batches:
            for part in slices(whole):
                ids, sizes = lex.ids([lines(t) for t in part.column(0).to_pylist()])
                held.append(np.insert(ids, np.cumsum(sizes), _END_ID))
                if context_col:
                    contexts.append(np.repeat(part.column(1).to_numpy(zero_copy_only=False).view(np.uint64), sizes + 1))
                size += len(held[-1])
                if size > FLUSH:
                    yield from emit(held, contexts, names)
                    names = {}
                    lex, held, contexts, size = lexer(names), [], [], 0
        if size:
            yield from emit(held, contexts, names)

    d = df.select(F.col(text_col).alias("text"), *([F.xxhash64(context_col).alias("context")] if context_col else [])).where(F.col("text").isNotNull())
    counts = d.mapInArrow(run, "key long, stops long, goes_on long, prefix_of long")
    return counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("stops", "goes_on", "prefix_of")])


def _tail_keys(texts: list[str], lex: Lexer, names: dict[int, str], hashes: Hashes, contexts: list[int | None]) -> tuple[list[list[dict]], np.ndarray]:
    """(what each text's end is looked up by as {n, key}, tokens of each text).

    Size 0 is the last word as a prefix, -1 a sentence's first and only one.
    """
    ids, sizes = lex.ids([lines(t) for t in texts])
    flat = np.insert(ids, np.cumsum(sizes), _END_ID)
    end, place = np.cumsum(sizes + 1) - 2, np.arange(len(flat))
    starts = _starts(place, flat <= _END_ID), _starts(place, flat == _END_ID)
    size = np.where((sizes > 0) & (flat[end] > _END_ID), end - starts[0][end] + 1, 0)
    prefix = dict(zip((SENTENCE, TEXT), prefix_hashes(flat, *starts)))
    out: list[list[dict]] = [[] for _ in texts]

    def add(n, code, at):
        for i, k in zip(at.tolist(), code.view(np.int64).tolist()):
            out[i].append({"n": n, "key": k})

    some = np.flatnonzero(size > 1)
    add(SENTENCE, _key(prefix[SENTENCE][end[some]], SENTENCE), some)
    parent = _key(prefix[SENTENCE][end[some] - 1], PARENT)
    add(PARENT, parent, some)
    add(BEFORE, _before(flat[end[some] - 1], flat[end[some]]), some)
    whole = np.flatnonzero((size > 0) & (sizes > 1))
    add(TEXT, _key(prefix[TEXT][end[whole]], TEXT), whole)
    for n, h in all_windows(flat, WINDOWS).items():
        at = np.flatnonzero(size >= n)
        h = h[end[at] - n + 1] if len(at) else np.empty(0, np.uint64)
        add(n, _key(h, n), at)
        if any(c is not None for c in contexts):
            add(n + IN_CONTEXT, _key(h, n + IN_CONTEXT, np.array([contexts[i] for i in at.tolist()], np.int64).view(np.uint64)), at)
    for i, p in zip(some.tolist(), parent.tolist()):
        before, last = names[int(flat[end[i] - 1])], names[int(flat[end[i]])]
        out[i] += [{"n": BEHIND, "key": hashes[f"{p}\1{last}\2"]}, {"n": 0, "key": hashes[f"{before}\1{last}\2"]}]
    for i in np.flatnonzero(size == 1).tolist():
        out[i].append({"n": -1, "key": hashes[f"{_START}\1{names[int(flat[end[i]])]}\2"]})
    return out, sizes


def open_ends(df: DataFrame, context_col: str | None = None) -> DataFrame:
    """Rows of (src_table, row_id, origin, limit_hit, text) that end open, with their windows, length and damage.

    ``damaged`` is set where the text ends in a replacement character, the trace of a cut inside a character.
    """
    schema = pa.schema([("src_table", pa.string()), ("row_id", pa.int64()), ("origin", pa.string()), ("limit_hit", pa.bool_()), ("chars", pa.int64()), ("bytes", pa.int64()), ("damaged", pa.bool_()), ("tokens", pa.int32()), ("keys", pa.list_(pa.struct([("n", pa.int32()), ("key", pa.int64())])))])

    def run(batches):
        hashes, names = Hashes(), {}
        lex = lexer(names)
        for whole in batches:
            for part in slices(whole):
                if len(names) > Lexer.LIMIT:
                    names = {}
                    lex = lexer(names)
                src, rid, origin, hit, text, context = (part.column(i).to_pylist() for i in range(6))
                ends = [(i, t) for i, t in enumerate(map(open_end, text)) if t is not None]
                keys, sizes = _tail_keys([t for _, t in ends], lex, names, hashes, [context[i] for i, _ in ends])
                rows = [(src[i], rid[i], origin[i], hit[i], len(text[i]), len(text[i].encode("utf-8", "surrogatepass")), t.endswith("�"), n, k) for (i, t), k, n in zip(ends, keys, sizes.tolist())]
                cols = list(zip(*rows)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    ddl = "src_table string, row_id long, origin string, limit_hit boolean, chars long, bytes long, damaged boolean, tokens int, keys array<struct<n:int,key:long>>"
    context = F.xxhash64(context_col) if context_col else F.lit(None).cast("long")
    return df.select("src_table", "row_id", "origin", "limit_hit", "text", context.alias("context")).where("text is not null").mapInArrow(run, ddl)


def truncated(df: DataFrame, context_col: str | None = None) -> DataFrame:
    """Judge every open end of ``df`` (src_table, row_id, origin, limit_hit, text).

    Returns (src_table, row_id, origin, cut, reason) for each row that ends open. Null and blank texts and texts
    with a final sign are not returned. ``origin`` is what widths and rates are counted by; ``limit_hit`` (nullable)
    says that the writer reached its limit. Windows are counted over all texts, and where a context column is given (texts that answer alike), per context
    too. Repeated rows are judged alike. ``copies`` tells that longer copies of the text or its last sentence go on.
    """
    ends = stable(open_ends(df, context_col))
    counts = window_counts(df.dropDuplicates(["text", context_col]) if context_col else df, "text", ask(ends), context_col)
    sizes_of = [*sorted(WINDOWS), SENTENCE, TEXT] + ([n + IN_CONTEXT for n in sorted(WINDOWS)] if context_col else [])
    wide = None
    for m in ("chars", "bytes"):
        w = ends.groupBy("src_table", "origin", F.col(m).alias("size")).agg(F.count("*").alias("n"))
        # a size's share among the open ends of its origin
        tot = w.groupBy("src_table", "origin").agg(F.sum("n").alias("total"))
        w = w.join(tot, ["src_table", "origin"]).where((F.col("n") >= WIDTH_LEAST) & (F.col("n") >= WIDTH_SHARE * F.col("total"))).select("src_table", "origin", F.lit(m).alias("measure"), "size")
        wide = w if wide is None else wide.unionByName(w)
    sizes = ends.select("src_table", "row_id", "origin", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("measure", "size"))
    at_width = sizes.join(wide, ["src_table", "origin", "measure", "size"]).select("src_table", "row_id", F.lit(True).alias("at_width")).distinct()
    asked = ends.select("src_table", "row_id", F.explode("keys").alias("k")).select("src_table", "row_id", "k.n", "k.key")
    seen = asked.join(counts, "key")
    of = lambda n, c: F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    ev = seen.groupBy("src_table", "row_id").agg(*[of(n, c).alias(f"{c}_{n}") for n in sizes_of for c in ("stops", "goes_on")], of(0, "prefix_of").alias("longer"), of(-1, "prefix_of").alias("longer_first"), of(BEHIND, "prefix_of").alias("longer_copy"))
    j = ends.drop("keys").join(ev, ["src_table", "row_id"], "left").join(at_width, ["src_table", "row_id"], "left")
    # the share of copies that stop, each window's smoothed by the next smaller one's
    steps, copies = [], {}
    for n in sizes_of:
        stops, all_ = F.coalesce(F.col(f"stops_{n}"), F.lit(0)), F.coalesce(F.col(f"stops_{n}") + F.col(f"goes_on_{n}"), F.lit(0))
        if IN_CONTEXT < n < SENTENCE:  # but for the text itself
            own = (F.col("tokens") <= BRIEF).cast("int")
            stops, all_ = F.greatest(stops - own, F.lit(0)), F.greatest(all_ - own, F.lit(0))
        copies[n] = all_
        steps.append(F.struct(stops.cast("double").alias("stops"), all_.cast("double").alias("all")))
    share = F.aggregate(F.array(*steps), F.lit(None).cast("double"), lambda acc, x: F.when(x["all"] > 0, (x["stops"] + PRIOR * F.coalesce(acc, x["stops"] / x["all"])) / (x["all"] + PRIOR)).otherwise(acc))
    on = lambda n: F.coalesce(F.col(f"goes_on_{n}"), F.lit(0))
    j = j.withColumns({"share": share, "known": copies[2], "alone": copies[1], "copies": (on(SENTENCE) > 0) | (on(TEXT) > 0), **{c: F.coalesce(c, F.lit(0)) for c in ("longer", "longer_first", "longer_copy")}})
    limit = F.coalesce(F.col("limit_hit"), F.lit(False)) | F.coalesce(F.col("at_width"), F.lit(False))
    rare = F.when(limit, RARE_AT_LIMIT).otherwise(RARE)
    # a sentence's only word has no predecessor; it must be rare as a word
    part_word = ((F.col("longer") > 0) & (F.col("known") <= rare * F.col("longer"))) | ((F.col("longer_first") > 0) & (F.col("alone") <= rare * F.col("longer_first")))
    reason = (
        F.when(F.col("damaged"), "inside a character")
        .when(((F.col("share") < STOPS) & F.col("copies")) | (part_word & (F.col("longer_copy") > 0)), "prefix of a longer copy")
        .when(part_word, "inside a word")
        .when((F.col("share").isNull() | (F.col("known") == 0)) & limit, "at a limit")
        .when(F.col("share") < STOPS, "inside a sentence")
        .when(limit & (F.col("share") < STOPS_AT_LIMIT), "at a limit")
    )
    return j.select("src_table", "row_id", "origin", reason.isNotNull().alias("cut"), reason.alias("reason"), F.col("share").alias("stop_share"), limit.alias("at_limit"), (F.col("copies") | (F.col("longer_copy") > 0)).alias("copies"))


def truncation_rates(texts: DataFrame, judged: DataFrame) -> DataFrame:
    """(src_table, origin, texts, cut_texts, rate): how often each origin's texts are cut; rate null without texts."""
    n = texts.where("text is not null").groupBy("src_table", "origin").agg(F.count("*").alias("texts"))
    c = judged.where("cut").groupBy("src_table", "origin").agg(F.count("*").alias("cut_texts"))
    key = [n["src_table"].eqNullSafe(c["src_table"]), n["origin"].eqNullSafe(c["origin"])]
    return n.join(c, key[0] & key[1], "left").select(n["src_table"], n["origin"], "texts", F.coalesce("cut_texts", F.lit(0)).alias("cut_texts"), F.try_divide(F.coalesce("cut_texts", F.lit(0)), "texts").alias("rate"))
