"""Word-count histograms: targets, comparison, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_key, word_count
from .spread import even_join, within_goal


def histogram(df: DataFrame, value: Column, name: str = "wc", count: str = "n") -> DataFrame:
    """Rows of each value; nulls are left out."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias(count))


def scaled_target(hist: DataFrame, scale: float, count: str = "n", out: str = "target") -> DataFrame:
    return hist.withColumn(out, F.ceil(F.col(count) * F.lit(scale)).cast("bigint"))


def compare(target: DataFrame, generated: DataFrame, key: str = "wc", want: str = "target", got: str = "generated") -> DataFrame:
    """Buckets of either side with target, generated, pct of the target (0 without one) and difference."""
    both = target.select(key, want).join(generated.select(key, got), key, "full_outer")
    t, g = F.coalesce(F.col(want), F.lit(0)), F.coalesce(F.col(got), F.lit(0))
    return both.select(
        key,
        t.alias(want),
        g.alias(got),
        F.when(t > 0, g / t * 100).otherwise(F.lit(0.0)).alias("pct"),
        (t - g).alias("difference"),
    )


def bhattacharyya(left: DataFrame, right: DataFrame, key: str = "wc", count: str = "n") -> DataFrame:
    """One row: sum of sqrt(p * q) over all keys, 0 if either side is empty.

    Keys on one side add nothing, so an inner join of the two histograms is enough.
    """
    lt, rt = (df.agg(F.sum(count)).first()[0] or 0 for df in (left, right))
    both = left.select(key, F.col(count).alias("_l")).join(right.select(key, F.col(count).alias("_r")), key)
    scale = (float(lt) * float(rt)) ** 0.5
    roots = F.sum(F.sqrt(F.col("_l").cast("double") * F.col("_r")))
    return both.agg(F.coalesce(roots / scale if scale else F.lit(0.0), F.lit(0.0)).alias("coefficient"))


def reject_reason(sentence: Column, target: Column) -> Column:
    """Why a candidate alone is refused: 'format_error', 'wrong_word_count' or null."""
    return F.when(sentence.isNull() | (norm_key(sentence) == ""), "format_error").when(
        word_count(sentence) != target, "wrong_word_count"
    )


def validate(candidates: DataFrame, sentence: str, target: str, arrival: str) -> DataFrame:
    """``candidates`` with ``reason``: null for the first arrival of each normalised sentence that is valid alone.

    Of valid candidates with one key all but the first are 'duplicate'; the first is found by a
    partial aggregate and joined back in slices, so a sentence repeated very often makes no large group.
    Rows of one arrival and key count as one arrival.
    """
    checked = candidates.withColumn("reason", reject_reason(F.col(sentence), F.col(target))).withColumn(
        "_key", F.when(F.col("reason").isNull(), F.unhex(F.md5(norm_key(F.col(sentence)))))
    )
    firsts = checked.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min(arrival).alias("_first"))
    return (
        even_join(checked, firsts, "_key", "left", candidates.count())
        .withColumn("reason", F.coalesce("reason", F.when(F.col(arrival) > F.col("_first"), "duplicate")))
        .drop("_key", "_first")
    )


def within_quota(accepted: DataFrame, bucket: str, arrival: str, quotas: DataFrame, quota: str = "quota") -> DataFrame:
    """The first ``quota`` arrivals of each bucket; buckets without quota take none."""
    goals = quotas.where(F.col(bucket).isNotNull()).select(bucket, F.col(quota).cast("bigint").alias("goal"))
    return within_goal(accepted, [bucket], [arrival], goals)
