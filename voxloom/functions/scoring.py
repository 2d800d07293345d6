"""Similarity scores, their scales, and quality bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; null for a zero vector, nulls or different lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def unit_scale(cos: Column) -> Column:
    return (cos + 1) / 2


def probability(cos: Column, temperature: float = 0.1) -> Column:
    return 1 / (1 + F.exp(-cos / temperature))


def readable(cos: Column, scale: str = "0to1", temperature: float = 0.1) -> Column:
    """A cosine on the named scale: '0to1' or 'prob'."""
    if scale == "0to1":
        return unit_scale(cos)
    if scale == "prob":
        return probability(cos, temperature)
    raise ValueError(f"unknown scale {scale!r}: '0to1' or 'prob'")


def unit_from_probability(p: Column, temperature: float = 0.1) -> Column:
    """The unit scale that a probability stands for; 0 and 1 give the ends."""
    inner = (temperature * F.log(p / (1 - p)) + 1) / 2
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(F.least(F.greatest(inner, F.lit(0.0)), F.lit(1.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def masked_mean(scores: Column, mask: Column, logistic: bool = True) -> Column:
    """Mean of (the sigmoid of) the scores where the mask is 1; null if none is."""
    kept = F.filter(F.arrays_zip(scores.alias("s"), mask.alias("m")), lambda x: x["m"] == 1)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + (sigmoid(x["s"].cast("double")) if logistic else x["s"].cast("double")))
    return F.when(F.size(kept) > 0, total / F.size(kept))


def quality(unit: Column, alignment: Column) -> Column:
    """Mean of similarity and alignment, the similarity alone without one."""
    return F.coalesce((unit + alignment) / 2, unit)


def band(score: Column, high: float = 0.8, low: float = 0.5, inclusive_high: bool = False) -> Column:
    """'high', 'medium' or 'low'; a score of exactly ``high`` is high only if inclusive. Null and NaN have none."""
    top = score >= high if inclusive_high else score > high
    return F.when(score.isNull() | F.isnan(score), F.lit(None)).when(top, "high").when(score >= low, "medium").otherwise("low")


def outlier(score: Column, low: float = 0.3, high: float = 0.95) -> Column:
    return F.when(score.isNull() | F.isnan(score), F.lit(None)).when(score < low, "low").when(score > high, "high")


# What each band means to a reader.
BAND_ADVICE = {
    "high": "keep: text and audio fit",
    "medium": "review: text and audio may fit",
    "low": "drop: text and audio don't fit",
}


def advice(b: Column) -> Column:
    pairs = [x for k, v in BAND_ADVICE.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), b)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def mean_absolute_error(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length; null otherwise."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(a))


# The differences below which two computations count as alike, and their names.
LIKENESS = ((0.001, "excellent"), (0.01, "good"), (0.05, "acceptable"))


def likeness(difference: Column, limits: Sequence[tuple[float, str]] = LIKENESS) -> Column:
    """The first name whose limit the absolute difference is below, 'check' beyond all; null for null and NaN."""
    size = F.abs(difference)
    out = F.when(size.isNull() | F.isnan(size), F.lit(None))
    for limit, name in limits:
        out = out.when(size < limit, name)
    return out.otherwise("check")


def weighted_pool(vectors: Column, weights: Column, least: float = 1e-9) -> Column:
    """Sum of weight * vector over the tokens, divided by the sum of weights (at least ``least``)."""
    total = F.greatest(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(least))
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w.cast("double")))
    start = F.transform(F.element_at(vectors, 1), lambda x: x.cast("double") * 0)
    return F.when(
        F.size(vectors) > 0,
        F.transform(F.aggregate(scaled, start, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)), lambda x: x / total),
    )


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors where the mask is 1; zeros if none is."""
    return weighted_pool(vectors, mask)


def softmax(logits: Column) -> Column:
    """Weights that sum to 1; shifted by the largest logit, so nothing overflows."""
    top = F.array_max(logits).cast("double")
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def attentive_pool(vectors: Column, logits: Column) -> Column:
    """The vectors' sum under softmax weights."""
    return weighted_pool(vectors, softmax(logits))
