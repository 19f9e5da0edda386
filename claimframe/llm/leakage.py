"""Problem 8: evaluation texts inside a training corpus.

Method: template canonicalisation. Items and documents are brought into one
template form: unified characters, lower case, numbers, units and names replaced
by typed placeholders. Windows of the items' templates are hashed and joined to
the windows of every document; windows that hit on one alignment (document,
item, offset) are gathered, and the alignments with enough hits are verified
word by word. Slots are then checked for consistency: a slot that differs counts
as a replaced word, and an item whose slots all differ by a consistent
substitution is reported as re-parameterised.

The number of windows an alignment must share follows from what is asked: an
item of n words with r replaced keeps at least n - W + 1 - W r windows of W words,
and fourteen consecutive words hold 15 - W. A word's placeholder depends on the
word alone, so a replaced word spoils no window that it isn't in, and no alignment
that qualifies is missed. Names are placeholders in a second set of windows: a word
is a name if its own text writes it with a capital inside a sentence, so names that
no item has are slots too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .canon import unify
from .common import BROADCAST_BYTES, MULT, Hashes, Lexer, map_columns, slices, windows

#: (words of a window, fewest and most words of the items it is used for): in short items a replaced word can hit every
#: longer window.
WIDTHS = ((5, 10, 1 << 40), (3, 3, 9), (2, 2, 2), (1, 1, 1))
#: Consecutive words that make a leak; one replaced word in so many is allowed in a whole item.
PASSAGE, ONE_IN = 14, 8
#: Most items whose windows are held in memory by every task; more of them are joined through a shuffle.
BLOCK = 20_000

_WORD = re.compile("[^\\W_㐀-䶿一-鿿]+(?:[-'’‐‑][^\\W_㐀-䶿一-鿿]+)*|[㐀-䶿一-鿿]")
_INNER = re.compile("[-'’‐‑]")
_CAPITAL = re.compile(r"(?<=[^\W\d_] )([A-ZÀ-ÞĐ][^\W\d_]+)")
# Units that become a placeholder.
UNITS = frozenset("mm cm dm m km inch inches ft g kg mg l ml s sec min h px dpi kb mb gb tb % vnd usd eur đồng".split())


def words(text: str) -> list[str]:
    """Lower-case words, a compound with a hyphen or apostrophe being one word without the sign; single ideographs."""
    return [_INNER.sub("", w) for w in _WORD.findall(text.lower())]


def name_words(text: str) -> set[str]:
    """Words with a capital inside a sentence, in lower case."""
    return {_INNER.sub("", w.lower()) for w in _CAPITAL.findall(text)}


#: The low bits of a token's number tell its class.
_PLAIN, _NUMBER, _UNIT, _NAME = 0, 1, 2, 3
_CLASS = np.uint64(3)


def _lexer() -> Lexer:
    hashes = Hashes()

    def code(w: str) -> int:
        return (hashes[w] | 8) & ~3 | (_NUMBER if w[0].isdigit() else _UNIT if w in UNITS else _PLAIN)

    return Lexer(words, code)


def template(ids: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
    """Token numbers with numbers and units, and the tokens marked in ``names``, replaced by the placeholder of their type."""
    c = ids & _CLASS
    out = np.where((c == _NUMBER) | (c == _UNIT), c + np.uint64(4), ids)
    return out if names is None else np.where(names, np.uint64(_NAME + 4), out)


class Texts:
    """A batch of texts as token numbers: ``flat`` with ``sizes`` tokens each, and which tokens are names."""

    def __init__(self, texts: list[str], lexer: Lexer):
        own = [unify(t) for t in texts]
        self.flat, self.sizes = lexer.ids(own)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        said = [name_words(t) for t in own]
        who = np.repeat(np.arange(len(texts)), [len(x) for x in said])
        with np.errstate(over="ignore"):
            mark = lambda owner, ids: owner.astype(np.uint64) * MULT ^ ids
            known = mark(who, np.fromiter((lexer.code(w) for x in said for w in x), np.uint64, len(who)))
            self.names = np.isin(mark(self.owner, self.flat), known)

    def windows(self, width: int, names: bool) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position) of the windows within one text; with ``names`` those that hold a name, names being placeholders."""
        h = windows(template(self.flat, self.names if names else None), width)
        if not len(h):
            return h, np.empty(0, np.int64)
        ok = self.owner[: len(h)] == self.owner[width - 1 :]
        if names:
            total = np.concatenate(([0], np.cumsum(self.names)))
            ok &= total[width:] > total[:-width]
        p = np.flatnonzero(ok)
        return h[p] ^ np.uint64(width * 2 + names), p


def _needs(sizes: np.ndarray, width: int, names: bool) -> np.ndarray:
    """Windows that an alignment with an item must share."""
    if names:  # slots are alike in both; a sentence's first word may hide a name
        return np.maximum(1, (sizes - width + 1) // 4)
    return np.maximum(1, np.minimum(PASSAGE + 1 - width, sizes - width + 1 - width * (sizes // ONE_IN)))


def item_windows(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item, place in the item, windows needed) of all windows by which items are looked up."""
    parts = []
    for width, least, most in WIDTHS:
        for names in (False, True):
            h, p = t.windows(width, names)
            i = t.owner[p]
            ok = (t.sizes[i] >= least) & (t.sizes[i] <= most)
            parts.append((h[ok], i[ok], (p - t.begins[i])[ok], _needs(t.sizes[i[ok]], width, names)))
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def text_windows(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of all windows of texts that items may share."""
    parts = [t.windows(width, names) for width, _, _ in WIDTHS for names in (False, True)]
    return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])


class Items:
    """A block of evaluation items, indexed by the windows of their templates."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.lexer = _lexer()
        t = Texts([r[1] for r in rows], self.lexer)
        self.sizes = t.sizes
        self.coded = np.split(t.flat, np.cumsum(t.sizes)[:-1])
        self.names = np.split(t.names, np.cumsum(t.sizes)[:-1])
        h, item, at, need = item_windows(t)
        order = np.argsort(h, kind="stable")
        self.keys, self.item, self.at, self.need = h[order], item[order], at[order], need[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        used = {w for w, least, most in WIDTHS if ((t.sizes >= least) & (t.sizes <= most)).any()}
        self.kinds = [(w, names) for w, _, _ in WIDTHS if w in used for names in (False, True) if not names or t.names.any()]

    def alignments(self, t: Texts) -> list[tuple[int, int, int]]:
        """(document, item, offset) with enough shared windows, for a batch of documents."""
        found: set[tuple[int, int, int]] = set()
        for kind in self.kinds:
            h, p = t.windows(*kind)
            near = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
            h, p = h[near], p[near]
            lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
            n = hi - lo
            p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            if not len(p):
                continue
            k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pos, item = np.repeat(p, n), self.item[k]
            doc = t.owner[pos]
            cell = np.stack((doc, item, pos - t.begins[doc] - self.at[k]), axis=1)
            order = np.lexsort((cell[:, 2], item, doc))
            cell, need = cell[order], self.need[k][order]
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]).any(axis=1)
            begins = np.flatnonzero(new)
            count = np.diff(np.append(begins, len(cell)))
            found.update(tuple(x) for x in cell[begins][count >= need[begins]].tolist())
        return sorted(found)

    def verify(self, doc: np.ndarray, item: int, offset: int) -> tuple[str, int, int] | None:
        """(kind, longest run, replaced words) of an alignment that is a leak, else None."""
        a, size = self.coded[item], int(self.sizes[item])
        lo, hi = max(0, -offset), min(size, len(doc) - offset)
        if hi <= lo:
            return None
        same = a[lo:hi] == doc[lo + offset : hi + offset]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        run = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
        replaced = size - int(same.sum())
        whole = hi - lo == size and replaced <= size // ONE_IN
        if whole:
            return ("verbatim" if not replaced else "altered"), run, replaced
        if run >= PASSAGE:
            return "passage", run, replaced
        # slot consistency: everything but slots alike, and each slot value stands for one value throughout
        if hi - lo == size:
            slots = template(a, self.names[item]) < 8
            if slots[~same].all():
                to: dict[int, set[int]] = {}
                for i in np.flatnonzero(slots).tolist():
                    to.setdefault(int(a[i]), set()).add(int(doc[i + offset]))
                if all(len(v) == 1 for v in to.values()):
                    return "re-parameterised", run, replaced
        return None


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("longest_run", pa.int32()), ("replaced", pa.int32()), ("offset", pa.int32())])


_DDL = "doc_id long, item_id long, kind string, longest_run int, replaced int, offset int"


def leaks(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, kind, longest_run, replaced, offset): every alignment of an item with a document that is a leak.

    Null texts and texts without words on either side leak nothing. Up to ``BLOCK`` items of together
    ``BROADCAST_BYTES`` bytes are sent to every task and looked up in one pass over all documents without a shuffle;
    beyond that the windows of both sides are joined. The result is the same. Rows repeated under one id give
    repeated alignments.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    e = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where("item_text IS NOT NULL")
    size = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("bytes")).first()
    if size["n"] > BLOCK or size["bytes"] > BROADCAST_BYTES:
        return _leaks_by_shuffle(d, e)
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in e.collect()])  # bounded as checked

    def run(batches):
        index = Items(sent.value)
        for whole in batches:
            for part in slices(whole):
                ids = part.column(0).to_pylist()
                t = Texts(part.column(1).to_pylist(), index.lexer)
                found = []
                for k, item, offset in index.alignments(t):
                    if (v := index.verify(t.flat[t.begins[k] : t.begins[k] + t.sizes[k]], item, offset)) is not None:
                        found.append((ids[k], index.ids[item], *v, offset))
                cols = list(zip(*found)) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    return d.mapInArrow(run, _DDL)


def _leaks_by_shuffle(d: DataFrame, e: DataFrame) -> DataFrame:
    """``leaks`` for any number of items: a hash join of windows, one row per alignment counted, texts joined to verify."""
    d = d.withColumn("row", F.xxhash64("doc_id", "text"))

    def of_items(cols):
        t = Texts(cols["item_text"], _lexer())
        h, i, at, need = item_windows(t)
        return {"key": pa.array(h.view(np.int64)), "item_id": pa.array(np.array(cols["item_id"], np.int64)[i]), "at": pa.array(at), "need": pa.array(need)}

    def of_texts(cols):
        t = Texts(cols["text"], _lexer())
        h, p = text_windows(t)
        i = t.owner[p]
        return {"key": pa.array(h.view(np.int64)), "row": pa.array(np.array(cols["row"], np.int64)[i]), "pos": pa.array(p - t.begins[i])}

    iw = map_columns(e, of_items, "key long, item_id long, at long, need long")
    dw = map_columns(d.select("row", "text").distinct(), of_texts, "key long, row long, pos long")
    hits = dw.join(iw, "key").groupBy("row", "item_id", (F.col("pos") - F.col("at")).alias("offset")).agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need")
    j = hits.select("row", "item_id", "offset").join(d, "row").join(e, "item_id")

    def judge(cols):
        out = []
        memory: dict[str, Items] = {}
        for doc, text, item, item_text, offset in zip(cols["doc_id"], cols["text"], cols["item_id"], cols["item_text"], cols["offset"]):
            if len(memory) > 1000:
                memory.clear()
            x = memory.get(item_text) or memory.setdefault(item_text, Items([(item, item_text)]))
            if (v := x.verify(Texts([text], x.lexer).flat, 0, offset)) is not None:
                out.append((doc, item, *v, offset))
        return dict(zip(_SCHEMA.names, map(list, zip(*out)))) if out else {n: [] for n in _SCHEMA.names}

    return map_columns(j.select("doc_id", "text", "item_id", "item_text", "offset"), judge, _DDL)
