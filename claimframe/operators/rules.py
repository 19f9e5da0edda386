"""Verdict rules as column expressions: scores in, verdict and branch out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import lexicon as L


def visual_support(answer: Column, confidence: Column) -> Column:
    """0.5 +- 0.5 confidence by a yes or a no, null if the probe decided nothing."""
    return F.when(answer == "yes", 0.5 + 0.5 * confidence).when(answer == "no", 0.5 - 0.5 * confidence)


def semantic_consistency(supporting: Column, contradicting: Column) -> Column:
    return (1.0 + supporting) / (2.0 + supporting + contradicting)


def negation_contradiction(claim: Column, negation: Column, confidence: Column) -> Column:
    """0.5 when both a claim and its negation are affirmed, the confidence when only the negation is, else 0."""
    return F.when((claim == "yes") & (negation == "yes"), 0.5).when((negation == "yes"), confidence).otherwise(0.0)


def support_score(v: Column, m: Column, g: Column) -> Column:
    """Weighted mean of the scores there are; the weights of missing ones go to the others; null without any."""
    parts = ((v, L.W_V), (m, L.W_M), (g, L.W_G))
    num = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    den = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    return F.try_divide(num, F.nullif(den, F.lit(0.0)))


def evidence(prerequisites: list[Column], channels: list[Column]) -> Column:
    """The least prerequisite or the best channel, whichever is smaller; null if nothing was measured."""
    best = F.array_max(F.array_compact(F.array(*channels)))
    return F.array_min(F.array_compact(F.array(*prerequisites, best)))


def decide(s: Column, c: Column, e: Column, constraint: Column | None = None, cascade: Column | None = None) -> Column:
    """struct<verdict, branch>, the branches tried in order.

    A hard constraint rejects a claim whatever its scores, and so does a rejected parent; too little evidence, strong
    contradiction, no support signal, support, too little support and doubt follow.
    """
    hard = F.coalesce(constraint, F.lit(False)) if constraint is not None else F.lit(False)
    parent = cascade if cascade is not None else F.lit(None).cast("string")
    steps = [
        (hard, "REJECTED", "hard_constraint"),
        (parent == "REJECTED", "REJECTED", "cascade"),
        (e.isNull() | (e < L.E_MIN), "UNCERTAIN", "gate"),
        (c >= L.C_HI, "REJECTED", "contradiction"),
        (s.isNull(), "UNCERTAIN", "no_support_signal"),
        ((s >= L.S_HI) & (c <= L.C_LO), "SUPPORTED", "support"),
        (s <= L.S_LO, "REJECTED", "no_support"),
    ]
    out = None
    for when, verdict, branch in steps:
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(branch).alias("branch"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit("UNCERTAIN").alias("verdict"), F.lit("unclear").alias("branch")))


def hard_constraint(inference_type: Column, requires_inference: Column) -> Column:
    """The kind of inference that no image can bear out, null if a claim needs none."""
    return F.when(F.coalesce(requires_inference, F.lit(False)) & inference_type.isin(*L.SPECULATIVE), inference_type)


def rank(verdict: Column) -> Column:
    return F.when(verdict == "REJECTED", 0).when(verdict == "UNCERTAIN", 1).when(verdict == "SUPPORTED", 2)


def cap(verdict: Column, ceilings: list[Column]) -> Column:
    """The lowest of a verdict and its ceilings; ceilings never raise; a null verdict stays null."""
    low = F.array_min(F.array_compact(F.array(rank(verdict), *[rank(c) for c in ceilings])))
    return F.when(verdict.isNotNull(), F.element_at(F.array(*map(F.lit, L.VERDICT_RANK)), low + 1))


def binary(verdict: Column, uncertain_as: str) -> Column:
    return F.when(verdict == "UNCERTAIN", uncertain_as).otherwise(verdict)


def stability(counts: list[Column]) -> Column:
    """One minus the entropy of answers over its largest value; null for fewer than two answers, 1 for one kind of answer."""
    n = sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0)).cast("double")
    kinds = sum(((F.coalesce(c, F.lit(0)) > 0).cast("int") for c in counts), F.lit(0))
    h = sum((F.when(c > 0, -(c / n) * F.ln(c / n)).otherwise(0.0) for c in counts), F.lit(0.0))
    return F.when(n >= 2, F.when(kinds > 1, 1 - h / F.ln(F.least(kinds.cast("double"), n))).otherwise(1.0))


def entropy_bits(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + F.when((x > 0) & (n > 0), -(x / n) * F.log2(x / n)).otherwise(0.0))


def iou(a: list[Column], b: list[Column], empty: float | None = None) -> Column:
    """Intersection over union of boxes (x, y, w, h); ``empty`` where the union is empty."""
    over = lambda x, w, y, v: F.greatest(F.least(x + w, y + v) - F.greatest(x, y), F.lit(0.0))
    inter = over(a[0], a[2], b[0], b[2]) * over(a[1], a[3], b[1], b[3])
    union = a[2] * a[3] + b[2] * b[3] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(empty).cast("double"))


def factuality(s: Column, c: Column, verdict: Column) -> Column:
    return s * (1 - c) * F.when(verdict == "UNCERTAIN", L.SELECT["lambda_u"]).otherwise(1.0)


def type_weight(kind: Column) -> Column:
    out = None
    for k, w in L.TYPE_WEIGHTS.items():
        out = F.when(kind == k, w) if out is None else out.when(kind == k, w)
    return out.otherwise(L.OTHER_TYPE_WEIGHT)


def harmonic(precision: Column, coverage: Column) -> Column:
    """Null where precision is undefined, 0 where coverage is 0."""
    return F.when(precision.isNull(), None).when(coverage.isNull() | (coverage == 0), 0.0).when(precision + coverage == 0, 0.0).otherwise(2 * precision * coverage / (precision + coverage))
