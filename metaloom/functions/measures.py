"""Column expressions for scores, sets, agreement and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or(a: Column, b: Column, other: float | None = 0.0) -> Column:
    """a / b, or ``other`` where b is 0."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if other is None else F.coalesce(r, F.lit(float(other)))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"p": ratio_or(tp, tp + fp), "r": ratio_or(tp, tp + fn), "f1": ratio_or(2 * tp, 2 * tp + fp + fn)}


def prf_counts(score: Column, predicted: Column, golden: Column, least: float = 0.5) -> dict[str, Column]:
    """Aggregates: a value scored ``least`` or more is a true positive; a wrong one is a false positive and a false negative; a value without a golden one counts as nothing."""
    right = golden & predicted & (score >= least)
    return {"tp": F.count_if(right), "fp": F.count_if(golden & predicted & ~right), "fn": F.count_if(golden & ~right)}


def kappa_parts(a: Column, b: Column) -> dict[str, Column]:
    """Aggregates of two booleans' agreement: n, both, neither, a_only, b_only."""
    return {"n": F.count(F.lit(1)), "both": F.count_if(a & b), "neither": F.count_if(~a & ~b), "a_only": F.count_if(a & ~b), "b_only": F.count_if(~a & b)}


def kappa(n: Column, both: Column, neither: Column, a_only: Column, b_only: Column) -> Column:
    """Cohen's kappa of a two-by-two table; null where chance agreement is complete or there is nothing."""
    po = ratio_or(both + neither, n, None)
    pa, pb = ratio_or(both + a_only, n, None), ratio_or(both + b_only, n, None)
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.try_divide(po - pe, 1 - pe)


def positive_agreement(both: Column, a_only: Column, b_only: Column) -> Column:
    return F.try_divide(2.0 * both, (2 * both + a_only + b_only).cast("double"))


def set_status(a: Column, b: Column) -> Column:
    """How set b stands to set a: both_empty, newly, lost, same, additional, fewer or changed."""
    na, nb = F.size(a), F.size(b)
    more, less = F.size(F.array_except(b, a)), F.size(F.array_except(a, b))
    return (
        F.when((na == 0) & (nb == 0), "both_empty").when(na == 0, "newly").when(nb == 0, "lost").when((more == 0) & (less == 0), "same")
        .when(less == 0, "additional").when(more == 0, "fewer").otherwise("changed")
    )


def set_jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def match_kind(predicted: Column, golden: Column) -> Column:
    """MATCH, PARTIAL or MISMATCH of two sets."""
    shared = F.size(F.array_intersect(predicted, golden))
    return F.when((shared == F.size(golden)) & (shared == F.size(predicted)), "MATCH").when(shared > 0, "PARTIAL").otherwise("MISMATCH")


def overlaps(a: Column, b: Column) -> Column:
    """Whether two sets share a value; an empty side agrees with anything."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def partly_contained(a: Column, b: Column) -> Column:
    """Whether a value of one set is within a value of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, kept within 0 and 1; null for a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), length))))


#: The score of a match so many edges away.
HOP_SCORES = {1: 0.90, 2: 0.87, 3: 0.83, 4: 0.80}


def hop_score(hops: Column) -> Column:
    out = F.lit(None).cast("double")
    for h, s in HOP_SCORES.items():
        out = F.when(hops == h, s).otherwise(out)
    return F.when(hops == 0, 0.90).otherwise(out)


def tier(exact: Column, lin: Column, hops: Column) -> Column:
    """exact; near from Lin .70 or within 2 edges; distant from .35 or within 4; else wrong."""
    return F.when(exact, "exact").when((lin >= 0.70) | (hops <= 2), "near").when((lin >= 0.35) | (hops <= 4), "distant").otherwise("wrong")


def outcome(score: Column, predicted: Column) -> Column:
    return F.when(~predicted, "missing").when(score >= 0.5, "accepted").otherwise("wrong")


def evidence_note(current: Column, value: Column, source: str, sets_agree: Column) -> Column:
    """What a source adds to an evidence string: its name where it agrees or fills, its name with a minus where it differs, nothing where it is silent."""
    return F.when(value.isNull(), None).when(current.isNull() | sets_agree, F.lit(source)).otherwise(F.lit(f"-{source}"))


def lin(ic_a: Column, ic_b: Column, ic_common: Column) -> Column:
    """2 IC(common) / (IC(a) + IC(b)); 0 without a common ancestor."""
    return F.coalesce(F.try_divide(2.0 * ic_common, ic_a + ic_b), F.lit(0.0))


def jiang_conrath(ic_a: Column, ic_b: Column, ic_common: Column) -> Column:
    """Half the distance, kept within 0 and 1; null without a common ancestor."""
    return F.when(ic_common.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ic_a + ic_b - 2 * ic_common) / 2)))
