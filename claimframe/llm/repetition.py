"""Problem 6: repetition inside a single document.

Every text gets the share of its words that lie in second or later copies of a
run of words standing earlier in the same text, the shares of its sentences and
lines that are copies, and with them the rules that it fails. Method: host-level
rules. The failures of each rule are aggregated by host (a document's source, a
caption's system), each host's failure rate is shrunk towards the corpus with a
beta prior fitted to all hosts by moments, and the host's verdicts are joined back
to its documents. A document's own verdict rests on its own share alone, since a
host's history cannot make copies in a text appear or vanish; the host verdicts
tell which sources to re-crawl or drop.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .canon import unify
from .common import MULT, Hashes, Lexer, skew_join, slices, stable

#: Run length in words, and in ideographs: the two weigh 12 and 5, so that five words or twelve ideographs make a run.
RUN_WORDS, RUN_HAN = 5, 12
#: Share of repeated words from which a text counts as repetitive, and the lesser share of the first rule.
REPETITIVE, NOTABLE = 0.4, 0.2
#: Share of a text's sentences, and of its lines, by characters, that are copies of earlier ones.
SENTENCES, LINES = 0.3, 0.3
RULES = ("runs", "repetitive", "sentences", "lines")
#: Shrunk failure rate above which a host is bad, as a multiple of the corpus rate.
BAD_HOST = 2.0

_TOKEN = re.compile("[^\\W_㐀-䶿一-鿿]+|[㐀-䶿一-鿿]")
_DIGITS = re.compile(r"\d+")
_STOP = re.compile(r"[.!?;。！？；\n]+")


def copied_share(parts: list[str]) -> float:
    """Share, by characters, of the parts that equal an earlier one but for blanks around them; 0 without any."""
    own = [p for x in parts if (p := x.strip())]
    once = set(own)
    return 1 - sum(map(len, once)) / sum(map(len, own)) if len(once) < len(own) else 0.0


def words(text: str) -> list[str]:
    """Lower-case words and single ideographs; numbers lose their value."""
    return _TOKEN.findall(_DIGITS.sub("0", text.lower()))


def _code(hashes: Hashes):
    """Hash of a token, odd for ideographs."""
    return lambda w: (hashes[w] | 8) & ~1 | ("㐀" <= w <= "鿿" and len(w) == 1)


def lexer() -> Lexer:
    return Lexer(words, _code(Hashes()))


def repeated_shares(texts: list[str], lex: Lexer) -> tuple[np.ndarray, np.ndarray]:
    """(share of repeated words, words) of each text; 0 where a text has no word. A word weighs 12, an ideograph 5."""
    ids, sizes = lex.ids([unify(t) for t in texts])
    n = len(ids)
    if not n:
        return np.zeros(len(texts)), sizes
    weight = np.where(ids & np.uint64(1), RUN_WORDS, RUN_HAN)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    total = np.concatenate(([0], np.cumsum(weight)))
    # the run that begins at each word: the fewest words that weigh enough
    stop = np.searchsorted(total, total[:-1] + RUN_WORDS * RUN_HAN)
    begin = np.flatnonzero(stop <= ends[owner])
    stop = stop[begin]
    length = stop - begin
    with np.errstate(over="ignore"):
        key = owner[begin].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(RUN_WORDS):
            key = key * MULT + ids[begin + k]
            key ^= key >> np.uint64(29)
        for k in range(RUN_WORDS, RUN_HAN):
            live = np.flatnonzero(length > k)
            key[live] = key[live] * MULT + ids[begin[live] + k]
            key[live] ^= key[live] >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    mark = np.zeros(n + 1, np.int64)
    mark += np.bincount(begin[again], minlength=n + 1) - np.bincount(stop[again], minlength=n + 1)
    covered = np.cumsum(mark[:-1]) > 0
    rep = np.bincount(owner, np.where(covered, weight, 0), minlength=len(texts))
    every = np.bincount(owner, weight, minlength=len(texts))
    return np.divide(rep, every, out=np.zeros(len(texts)), where=every > 0), sizes


_SCHEMA = pa.schema([("src_table", pa.string()), ("row_id", pa.int64()), ("host", pa.string()), ("words", pa.int64()), ("repeated_share", pa.float64()), ("sentence_share", pa.float64()), ("line_share", pa.float64())])


def measure(df: DataFrame) -> DataFrame:
    """(src_table, row_id, host, words, repeated_share, sentence_share, line_share, failed) of (src_table, row_id, host, text).

    ``failed`` has the names of the failed rules in the order of ``RULES``. Null texts have no row, blank ones fail none.
    """

    def run(batches):
        lex = lexer()
        for whole in batches:
            for part in slices(whole):
                texts = part.column(3).to_pylist()
                share, n = repeated_shares(texts, lex)
                low = [t.lower() for t in texts]
                again = [copied_share(_STOP.split(t)) for t in low], [copied_share(t.split("\n")) if "\n" in t else 0.0 for t in low]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n), pa.array(share), *(pa.array(x, pa.float64()) for x in again)], schema=_SCHEMA)

    d = df.select("src_table", F.col("row_id").cast("long").alias("row_id"), "host", "text").where("text IS NOT NULL")
    m = d.mapInArrow(run, "src_table string, row_id long, host string, words long, repeated_share double, sentence_share double, line_share double")
    least = (("repeated_share", NOTABLE), ("repeated_share", REPETITIVE), ("sentence_share", SENTENCES), ("line_share", LINES))
    return m.withColumn("failed", F.array_compact(F.array(*[F.when(F.col(c) >= x, F.lit(r)) for r, (c, x) in zip(RULES, least)])))


def host_rates(measured: DataFrame) -> DataFrame:
    """Failures by host and rule, shrunk with an empirical beta prior.

    The prior's mean is the corpus rate and its strength follows, by moments, from how far the hosts' rates spread
    beyond what chance explains; with one host, or no spread, the prior is as strong as the average host is large.
    Returns (src_table, host, rule, texts, failures, shrunk_rate, corpus_rate, bad_host). A null host is a host of its own.
    """
    h = measured.groupBy("src_table", "host").agg(F.count("*").alias("texts"), *[F.count_if(F.array_contains("failed", r)).alias(r) for r in RULES])
    h = h.unpivot(["src_table", "host", "texts"], list(RULES), "rule", "failures")
    t = h.groupBy("src_table", "rule").agg(
        (F.sum("failures") / F.sum("texts")).alias("corpus_rate"),
        F.avg("texts").alias("_size"),
        F.coalesce(F.var_samp(F.col("failures") / F.col("texts")), F.lit(0.0)).alias("_var"),
        F.avg(F.lit(1.0) / F.col("texts")).alias("_inv"),
    )
    chance = F.col("corpus_rate") * (1 - F.col("corpus_rate"))
    spread = F.greatest(F.col("_var") - chance * F.col("_inv"), F.lit(0.0))
    strength = F.when(spread > 0, F.greatest(chance / spread - 1, F.lit(1.0))).otherwise(F.col("_size"))
    r = h.join(t.select("src_table", "rule", "corpus_rate", strength.alias("strength")), ["src_table", "rule"])
    shrunk = (F.col("failures") + F.col("corpus_rate") * F.col("strength")) / (F.col("texts") + F.col("strength"))
    return r.select("src_table", "host", "rule", "texts", "failures", shrunk.alias("shrunk_rate"), "corpus_rate", (shrunk > BAD_HOST * F.col("corpus_rate")).alias("bad_host"))


def repetition(df: DataFrame) -> DataFrame:
    """(src_table, row_id, host, words, repeated_share, failed, repetitive, shrunk_rate, bad_rules) for every text that is not null.

    ``df`` has src_table, row_id, host (nullable) and text. ``shrunk_rate`` is the host's rate of the rule "repetitive",
    ``bad_rules`` the rules by which the host is bad. Blank texts have share 0. Repeated rows each get a row.
    """
    m = stable(measure(df))
    hosts = host_rates(m).groupBy("src_table", "host").agg(F.max(F.when(F.col("rule") == "repetitive", F.col("shrunk_rate"))).alias("shrunk_rate"), F.array_sort(F.collect_list(F.when(F.col("bad_host"), F.col("rule")))).alias("bad_rules"))
    # a null host meets itself; a hot host's one row goes to all tasks
    name = lambda d: d.withColumn("_host", F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("")))
    j = skew_join(name(m), name(hosts).drop("host"), ["src_table", "_host"])
    return j.select("src_table", "row_id", "host", "words", "repeated_share", "failed", F.array_contains("failed", "repetitive").alias("repetitive"), "shrunk_rate", "bad_rules")
