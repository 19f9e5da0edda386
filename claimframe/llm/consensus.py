"""Problem 5: consensus from several annotators' labels.

Method: bipartite message passing, one class against the rest. Items and
annotators are the two sides of a graph whose edges are labels. For each class,
an item sends along an edge the log-odds that it has the class rather than
another, from all its other labels; an annotator sends what his label says about
the class against the rest, the log-likelihood ratio of that label from all his
other items. The messages are iterated to convergence. An annotator who misleads
gets ratios under one, so his labels count for the opposite. The consensus is
the class with the highest belief; reliability is an annotator's expected share
of right labels.

Items with the same labels by the same annotators have the same messages, so the
rounds run over distinct label patterns with their number of items. A round is one
pass over the patterns in Arrow batches: messages in NumPy, then the annotators'
totals, summed within tasks before they are shuffled. The totals of every round,
one small table of at most ``MOST_ANNOTATORS`` rows, are all that the next round
needs; messages are worked out anew from the last stored state. An item's pattern
has at most one label per annotator, so its size is bounded likewise. Beyond that
bound the same messages are computed as joins and windows over the edges.

The totals move in the end along one slow direction; every few rounds they are
extrapolated along it, which leaves the fixed point as it is. Rounds end when no
annotator's expected accuracy moves by ``TOLERANCE``; should that not happen in
``GIVE_UP`` rounds, an error is raised rather than an unfinished result returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .canon import reading_udf
from .common import skew_join, stable

VERDICTS = ("SUPPORTED", "UNCERTAIN", "REJECTED")
#: The change of any annotator's expected accuracy below which the messages have converged, and the rounds in which they must.
TOLERANCE, GIVE_UP = 1e-5, 1000
#: Rounds between two extrapolations, most that the slow direction's factor is taken for, and rounds between stored states.
PATIENCE, STEEPEST, STORE = 4, 0.9, 6
#: Pseudo-labels with which each annotator starts out somewhat better than chance.
PRIOR_HITS, PRIOR_ALL = 3.0, 4.0
#: Least likelihood of a label, and most log-odds of an item.
FLOOR, CLIP = 0.003, 30.0
#: Patterns worth a task of their own: a round takes them some hundredths of a second.
TASK_PATTERNS = 25_000
#: Annotators up to which their totals are held by the driver and every task.
MOST_ANNOTATORS = 10_000


def verdict_name(col: F.Column) -> F.Column:
    """The verdict in its one spelling, null for null, blank, "none" and unknown spellings."""
    v = F.upper(F.trim(F.element_at(F.split(col, r"\."), -1)))
    return F.when(v.isin(*VERDICTS), v)


def items_of(df: DataFrame, id_col: str, annotator: str, image: str, text: str, verdict: str, time: str) -> DataFrame:
    """(item, label_id, annotator, verdict, time) of all rows with an image and a text; ``item`` is the pair's 128-bit hash as text.

    Rows without image or text belong to no item. Annotator and verdict may be null.
    """
    d = df.select(F.col(id_col).cast("long").alias("label_id"), F.nullif(F.trim(F.col(annotator)), F.lit("")).alias("annotator"), F.col(image).alias("_image"), F.col(text).alias("_text"), verdict_name(F.col(verdict)).alias("verdict"), F.col(time).alias("time"))
    d = d.where("_image IS NOT NULL AND _text IS NOT NULL").withColumn("_r", reading_udf("_text")).where(F.col("_r") != "")
    item = F.md5(F.concat_ws("\u0001", F.col("_image"), F.col("_r")))
    return d.select(item.alias("item"), "label_id", "annotator", "verdict", "time")


def last_labels(items: DataFrame) -> DataFrame:
    """(item, annotator, verdict): each annotator's last label; rows without annotator or verdict don't count.

    Last is by time, null times first, then by label id.
    """
    d = items.where("annotator IS NOT NULL AND verdict IS NOT NULL")
    order = F.struct(F.col("time").isNotNull(), F.col("time"), F.col("label_id"))
    return d.groupBy("item", "annotator").agg(F.max_by("verdict", order).alias("verdict"))


class Edges:
    """Label patterns of a batch: annotator and label of each edge, owner of each edge, items of each pattern."""

    def __init__(self, annotators: pa.ListArray, labels: pa.ListArray, weight: np.ndarray, classes: int):
        self.sizes = np.diff(annotators.offsets.to_numpy())
        self.a = annotators.flatten().to_numpy(zero_copy_only=False)
        self.v = labels.flatten().to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.n, self.classes = self.sizes[self.owner], classes
        self.cell = self.a.astype(np.int64) * classes + self.v
        self.w = weight[self.owner].astype(float)
        self.hit = self.v == np.arange(classes)[:, None]
        miss = (PRIOR_ALL - PRIOR_HITS) / (classes - 1)
        self.here, self.there = np.where(self.hit, PRIOR_HITS, miss), np.where(self.hit, PRIOR_ALL - PRIOR_HITS, PRIOR_HITS / (classes - 1))

    def per_pattern(self, x: np.ndarray) -> np.ndarray:
        """Sums of a row per class over the edges of each pattern."""
        return np.stack([np.bincount(self.owner, r, len(self.sizes)) for r in x])

    def first(self) -> np.ndarray:
        """An item's first message, a row per class: the share of its other labels that have the class."""
        return (self.per_pattern(self.hit)[:, self.owner] - self.hit + 1 / self.classes) / self.n

    def totals(self, p: np.ndarray, most: int) -> np.ndarray:
        """Of every annotator, per class and label, the sum of the messages of the items that bear the label."""
        C = self.classes
        return np.stack([np.bincount(self.cell, r * self.w, most * C).reshape(most, C) for r in p], axis=1)

    def step(self, p: np.ndarray, totals: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next messages of items to annotators, log-odds of each pattern's classes), a row per class. An edge's own message is left out."""
        whole, all_ = totals.sum(axis=2), labels.sum(axis=1)
        rest, out = labels[:, None, :] - totals, all_[:, None] - whole
        w = np.empty_like(p)
        for c, own in enumerate(p):
            with_ = np.maximum((totals[:, c].ravel()[self.cell] - own + self.here[c]) / (whole[:, c][self.a] - own + PRIOR_ALL), FLOOR)
            against = 1 - own
            without = np.maximum((rest[:, c].ravel()[self.cell] - against + self.there[c]) / (out[:, c][self.a] - against + PRIOR_ALL), FLOOR)
            w[c] = np.log(with_ / without)
        odds = self.per_pattern(w) + np.array([_logit(x) for x in whole.sum(axis=0) / max(all_.sum(), 1e-9)])[:, None]
        soft = odds[:, self.owner] - w
        np.clip(soft, -CLIP, CLIP, out=soft)
        np.exp(soft, out=soft)
        soft /= 1 + soft
        soft /= soft.sum(axis=0)
        return soft, odds


def _edges(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[pa.RecordBatch, Edges]]:
    for b in batches:
        if b.num_rows:
            weight = b.column("weight").to_numpy() if "weight" in b.schema.names else np.ones(b.num_rows)
            yield b, Edges(b.column("a"), b.column("v"), weight, classes)


def _state(b: pa.RecordBatch, e: Edges) -> np.ndarray:
    p = b.column("p").flatten().to_numpy(zero_copy_only=False) if "p" in b.schema.names else np.empty(0)
    return np.ascontiguousarray(p.reshape(-1, e.classes).T) if len(p) else e.first()


def _replay(e: Edges, p: np.ndarray, history: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    odds = None
    for t in history:
        p, odds = e.step(p, t, labels)
    return p, odds


def converge(patterns: DataFrame, annotators: int, classes: int) -> tuple[list[np.ndarray], np.ndarray, DataFrame, int]:
    """(totals of all rounds, labels of each annotator by class, stored messages, rounds they stand for).

    ``patterns`` has a, v (arrays of annotator numbers and labels) and weight; stored messages are a column p.
    """
    spark = patterns.sparkSession
    cells = classes * classes
    history: list[np.ndarray] = []
    stored = 0
    labels = np.zeros((annotators, classes))
    for r in patterns.select("weight", F.explode(F.arrays_zip("a", "v")).alias("x")).groupBy("x.a", "x.v").agg(F.sum("weight").alias("n")).collect():  # one row per annotator and label
        labels[r["a"], r["v"]] = r["n"]
    size = np.maximum(labels.sum(axis=1), 1)
    before = delta = accuracy = None
    since, patience, leapt = 0, PATIENCE, np.inf
    for _ in range(GIVE_UP):
        sent = spark.sparkContext.broadcast((history[stored:], labels))

        def run(batches, sent=sent):
            recent, labels = sent.value
            total = np.zeros((annotators, classes, classes))
            for b, e in _edges(batches, classes):
                total += e.totals(_replay(e, _state(b, e), recent, labels)[0], annotators)
            i = np.flatnonzero(total.any(axis=(1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), *(pa.array(total.reshape(annotators, cells)[i, k]) for k in range(cells))], names=["a", *(f"t{k}" for k in range(cells))])

        parts = patterns.mapInArrow(run, "a int, " + ", ".join(f"t{k} double" for k in range(cells)))
        t = np.zeros((annotators, cells))
        for r in parts.groupBy("a").agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(cells)]).collect():  # one row per annotator
            t[r["a"]] = r[1:]
        t = t.reshape(annotators, classes, classes)
        now = np.trace(t, axis1=1, axis2=2) / size
        change = None if accuracy is None else float(np.abs(now - accuracy).max(initial=0.0))
        accuracy = now
        step = None if before is None else (t - before) / size[:, None, None]
        before, since, used = t, since + 1, t
        if change is not None and change < TOLERANCE:
            history.append(t)
            return history, labels, patterns, stored
        if since > patience and delta is not None:
            a, b = float((step * delta).sum()), float((delta * delta).sum())
            if b > 0 and 0.3 < a / b < 1 and a > 0.95 * np.sqrt(b * float((step * step).sum())):
                f = min(a / b, STEEPEST)
                used = np.clip(t + step * size[:, None, None] * f / (1 - f), 0, labels[:, None, :])
                # an extrapolation that did not help makes the next one wait twice as long
                patience = patience * 2 if change > leapt / 2 else patience
                since, leapt = 0, change
        delta = step
        history.append(used)
        if len(history) - stored >= STORE:
            sent = spark.sparkContext.broadcast((history[stored:], labels))

            def keep(batches, sent=sent):
                recent, labels = sent.value
                for b, e in _edges(batches, classes):
                    p = _replay(e, _state(b, e), recent, labels)[0]
                    offsets = pa.array(np.concatenate(([0], np.cumsum(e.sizes))) * classes, pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column("a"), b.column("v"), b.column("weight"), pa.ListArray.from_arrays(offsets, pa.array(p.T.ravel()))], names=["a", "v", "weight", "p"])

            patterns = stable(patterns.mapInArrow(keep, "a array<int>, v array<int>, weight long, p array<double>"))
            stored = len(history)
    raise RuntimeError(f"messages have not converged in {GIVE_UP} rounds; last change {change}")


def pass_messages(labels: DataFrame, classes: tuple[str, ...] = VERDICTS) -> tuple[DataFrame, DataFrame]:
    """(beliefs, reliability) of ``labels`` (item, annotator, verdict; one row per edge).

    beliefs: (item, verdict, score, annotators, verdicts, agreement), score the belief of the consensus verdict in
    [0, 1] after normalising over classes, agreement the share of label pairs of the item that agree (null for one
    label). Ties fall to the class with more labels on the item, then to the earlier class. reliability: (annotator,
    labels, reliability), over items with several labels if there are any. Empty labels give empty results.
    """
    labels = stable(labels.select("item", "annotator", "verdict"))
    who = labels.groupBy("annotator").count().select("annotator")
    if who.limit(MOST_ANNOTATORS + 1).count() > MOST_ANNOTATORS:
        return _pass_messages_by_join(labels, classes)
    names = sorted(r[0] for r in who.collect())  # bounded as checked
    n, C = len(names), len(classes)
    spark = labels.sparkSession
    number = spark.createDataFrame(list(enumerate(names)), "a int, annotator string")
    votes = F.array(*[F.lit(c) for c in classes])
    edges = labels.join(F.broadcast(number), "annotator").select("item", "a", (F.array_position(votes, F.col("verdict")) - 1).cast("int").alias("v"))
    items = edges.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("a", "v"))).alias("x")).select("item", F.col("x.a").alias("a"), F.col("x.v").alias("v"))
    items = stable(items)
    patterns = stable(items.groupBy("a", "v").agg(F.count("*").alias("weight")))
    patterns = patterns.coalesce(max(1, -(-patterns.count() // TASK_PATTERNS)))
    history, counts, last, stored = converge(patterns, n, C)
    sent = spark.sparkContext.broadcast((history, counts))

    def judge(batches):
        history, counts = sent.value
        for b, e in _edges(batches, C):
            odds = _replay(e, e.first(), history, counts)[1]
            belief = 1 / (1 + np.exp(-np.clip(odds, -CLIP, CLIP)))
            have = e.per_pattern(e.hit).astype(np.int64)
            best = np.lexsort((np.broadcast_to(-np.arange(C)[:, None], have.shape), have, np.round(belief, 9)), axis=0)[-1]
            pairs, most = (have * (have - 1)).sum(axis=0), e.sizes * (e.sizes - 1)
            agree = np.divide(pairs, most, out=np.full(len(most), np.nan), where=most > 0)
            score = belief[best, np.arange(len(best))] / belief.sum(axis=0)
            out = [b.column("item"), pa.array(np.array(classes)[best]), pa.array(score), pa.array(e.sizes.astype(np.int64)), pa.array((have > 0).sum(axis=0).astype(np.int32)), pa.array(agree, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(out, names=["item", "verdict", "score", "annotators", "verdicts", "agreement"])

    beliefs = items.mapInArrow(judge, "item string, verdict string, score double, annotators long, verdicts int, agreement double")

    def rate(batches):
        history, counts = sent.value
        for b, e in _edges(batches, C):
            odds = _replay(e, _state(b, e), history[stored:], counts)[1]
            belief = 1 / (1 + np.exp(-np.clip(odds, -CLIP, CLIP)))
            right = (belief / belief.sum(axis=0))[e.v, e.owner]
            some = e.w * (e.n > 1)
            i = np.unique(e.a)
            sums = [np.bincount(e.a, x, n)[i] for x in (e.w, right * e.w, some, right * some)]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), *map(pa.array, sums)], names=["a", "n", "r", "sn", "sr"])

    rates = last.mapInArrow(rate, "a int, n double, r double, sn double, sr double").groupBy("a").agg(*[F.sum(x).alias(x) for x in ("n", "r", "sn", "sr")])
    reliability = rates.join(F.broadcast(number), "a").select("annotator", F.col("n").cast("long").alias("labels"), F.coalesce(F.try_divide("sr", "sn"), F.try_divide("r", "n")).alias("reliability"))
    return beliefs, reliability


def _pass_messages_by_join(labels: DataFrame, classes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``pass_messages`` for any number of annotators: edges partitioned by item, annotators' totals joined to them."""
    C = range(len(classes))
    votes = F.array(*[F.lit(c) for c in classes])
    by_item, item_size = Window.partitionBy("item"), F.count("*")
    e = labels.select("item", "annotator", (F.array_position(votes, F.col("verdict")) - 1).cast("int").alias("v"))
    e = e.repartition("item").withColumn("n", item_size.over(by_item))
    # first message of an item: the share of its other labels that have the class
    for c in C:
        hit = (F.col("v") == c).cast("double")
        e = e.withColumn(f"p{c}", (F.sum(hit).over(by_item) - hit + 1.0 / len(classes)) / F.col("n"))
    e = stable(e)
    if e.isEmpty():
        return e.select("item", F.lit("").alias("verdict"), F.lit(0.0).alias("score"), F.col("n").alias("annotators"), F.lit(0).alias("verdicts"), F.lit(0.0).alias("agreement")), e.select("annotator", F.lit(0).cast("long").alias("labels"), F.lit(0.0).alias("reliability"))

    before = None
    for _ in range(GIVE_UP):
        sums = []
        for c in C:
            p = F.col(f"p{c}")
            by_label = lambda x: F.array(*[F.sum(F.when(F.col("v") == v, x).otherwise(0.0)) for v in C])
            sums += [F.sum(p).alias(f"s{c}"), by_label(p).alias(f"sh{c}"), F.sum(1 - p).alias(f"r{c}"), by_label(1 - p).alias(f"rh{c}")]
        own = sum((F.when(F.col("v") == c, F.col(f"p{c}")).otherwise(0.0) for c in C), F.lit(0.0))
        total = stable(e.groupBy("annotator").agg(F.count("*").alias("labels"), F.sum(own).alias("right"), *sums))
        seen = total if before is None else total.join(before, "annotator", "left")
        change = F.lit(None).cast("double") if before is None else F.max(F.abs(F.col("right") / F.col("labels") - F.col("b")))
        prior = seen.agg(F.count("*").alias("annotators"), change.alias("change"), *[(F.sum(f"s{c}") / F.sum(F.col(f"s{c}") + F.col(f"r{c}"))).alias(f"q{c}") for c in C]).first()
        before = total.select("annotator", (F.col("right") / F.col("labels")).alias("b"))
        small = total.drop("labels", "right")
        j = skew_join(e, small, ["annotator"])
        cols = []
        for c in C:
            p, of_label = F.col(f"p{c}"), lambda x: F.element_at(F.col(x), F.col("v") + 1)
            # the annotator's message leaves out what he got along this edge; at first his label rather tells its own class
            here, there = F.when(F.col("v") == c, PRIOR_HITS).otherwise((PRIOR_ALL - PRIOR_HITS) / (len(classes) - 1)), F.when(F.col("v") == c, PRIOR_ALL - PRIOR_HITS).otherwise(PRIOR_HITS / (len(classes) - 1))
            with_class = (of_label(f"sh{c}") - p + here) / (F.col(f"s{c}") - p + PRIOR_ALL)
            without = (of_label(f"rh{c}") - (1 - p) + there) / (F.col(f"r{c}") - (1 - p) + PRIOR_ALL)
            cols.append(F.log(F.greatest(with_class, F.lit(FLOOR)) / F.greatest(without, F.lit(FLOOR))).alias(f"w{c}"))
        j = j.select("item", "annotator", "v", "n", *cols)
        j = j.repartition("item")
        x = [F.sum(f"w{c}").over(by_item) + float(_logit(prior[f"q{c}"])) for c in C]
        j = j.withColumns({f"x{c}": x[c] for c in C})
        # the item's message to an annotator leaves out his own label; classes are normalised against each other
        soft = [F.exp(F.least(F.greatest(F.col(f"x{c}") - F.col(f"w{c}"), F.lit(-30.0)), F.lit(30.0))) for c in C]
        odds = [s / (1 + s) for s in soft]
        z = sum(odds[1:], odds[0])
        e = stable(j.withColumns({f"p{c}": odds[c] / z for c in C}).drop(*[f"w{c}" for c in C]))
        if prior["change"] is not None and prior["change"] < TOLERANCE:
            break
    else:
        raise RuntimeError(f"messages have not converged in {GIVE_UP} rounds")

    g = e.groupBy("item").agg(F.first("n").alias("annotators"), *[F.first(f"x{c}").alias(f"x{c}") for c in C], *[F.count_if(F.col("v") == c).alias(f"k{c}") for c in C])
    b = [1 / (1 + F.exp(-F.least(F.greatest(F.col(f"x{c}"), F.lit(-30.0)), F.lit(30.0)))) for c in C]
    g = g.withColumn("best", F.array_max(F.array(*[F.struct(F.round(b[c], 9).alias("b"), F.col(f"k{c}").alias("k"), F.lit(-c).alias("c")) for c in C])))
    pairs = sum((F.col(f"k{c}") * (F.col(f"k{c}") - 1) for c in C), F.lit(0))
    beliefs = g.select(
        "item",
        F.element_at(votes, 1 - F.col("best.c")).alias("verdict"),
        (F.col("best.b") / sum(b[1:], b[0])).alias("score"),
        F.col("annotators"),
        sum(((F.col(f"k{c}") > 0).cast("int") for c in C), F.lit(0)).alias("verdicts"),
        F.try_divide(pairs, F.col("annotators") * (F.col("annotators") - 1)).alias("agreement"),
    )
    all_ = [1 / (1 + F.exp(-F.least(F.greatest(F.col(f"x{c}"), F.lit(-30.0)), F.lit(30.0)))) for c in C]
    right = sum((F.when(F.col("v") == c, all_[c]).otherwise(0.0) for c in C), F.lit(0.0)) / sum(all_[1:], all_[0])
    reliability = e.groupBy("annotator").agg(F.count("*").alias("labels"), F.coalesce(F.avg(F.when(F.col("n") > 1, right)), F.avg(right)).alias("reliability"))
    return beliefs, reliability


def _logit(q: float | None) -> float:
    from math import log

    q = min(max(q or 0.5, 0.02), 0.98)
    return log(q / (1 - q))


def consensus(df: DataFrame, id_col: str, annotator: str, image: str, text: str, verdict: str, time: str) -> tuple[DataFrame, DataFrame]:
    """(items, annotators): consensus per item with the item's smallest label id over all its rows, and reliability per annotator."""
    items = stable(items_of(df, id_col, annotator, image, text, verdict, time))
    beliefs, reliability = pass_messages(last_labels(items))
    first = items.groupBy("item").agg(F.min("label_id").alias("label_id"))
    return beliefs.join(first, "item").select("label_id", "verdict", "score", "annotators", "verdicts", "agreement"), reliability
