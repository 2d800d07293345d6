"""Statistics of scores: summaries, bands, bins, correlations, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import once
from ..functions.scoring import band, nan_to_null
from .spread import quantiles


def describe(df: DataFrame, value: Column, by: Sequence[str] = (), sample: bool = True) -> DataFrame:
    """count, mean, median, std (of a sample or the population), min, max, p25, p75; null and NaN are left out.

    Quantiles are exact and come from range-sorted values, the rest from one partial aggregate.
    """
    v = F.col("_v")
    rows = df.select(*by, nan_to_null(value.cast("double")).alias("_v"))
    stats = rows.groupBy(*by).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        (F.stddev_samp(v) if sample else F.stddev_pop(v)).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    out = with_quantiles(stats, rows, by, "_v", {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return out.select(*by, "count", "mean", "median", "std", "min", "max", "p25", "p75")


def with_quantiles(stats: DataFrame, rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``stats`` (a row a group) with exact quantiles of ``rows``; groups without values get nulls."""
    q = quantiles(rows, by, value, shares)
    if not by:
        one = q.first()  # one row of numbers
        return stats.withColumns({n: F.lit(one[n] if one else None).cast("double") for n in shares})
    match = None
    for k in by:
        test = stats[k].eqNullSafe(q[k])
        match = test if match is None else match & test
    return stats.join(q, match, "left").select(*[stats[c] for c in stats.columns], *[q[n] for n in shares])


def band_distribution(df: DataFrame, score: Column, inclusive_high: bool = False) -> DataFrame:
    """Rows and per cent of the valid rows in each of the three bands, empty ones too."""
    b = df.select(band(score, inclusive_high=inclusive_high).alias("band"))
    counts = [F.count_if(F.col("band") == name).alias(name) for name in ("high", "medium", "low")]
    one = b.agg(F.count("band").alias("_n"), *counts)
    return one.select("_n", F.expr("stack(3, 'high', high, 'medium', medium, 'low', low) AS (band, rows)")).select(
        "band", "rows", F.when(F.col("_n") > 0, F.col("rows") / F.col("_n") * 100).otherwise(F.lit(0.0)).alias("pct")
    )


def filter_statistics(df: DataFrame, score: Column, threshold: float = 0.8) -> DataFrame:
    """What filtering by ``score >= threshold`` keeps, with the scores' statistics and bands; the median is exact and range-sorted."""
    rows = df.select(once(score.cast("double")).alias("_s")).select(nan_to_null(F.col("_s")).alias("s"))
    s = F.col("s")
    kept = F.count_if(s >= threshold)
    b = band(s, inclusive_high=True)
    stats = rows.agg(
        F.count("*").alias("total_samples"),
        kept.alias("filtered_samples"),
        F.when(F.count("*") > 0, kept / F.count("*") * 100).otherwise(F.lit(0.0)).alias("filtered_percentage"),
        F.lit(threshold).alias("threshold"),
        F.avg(s).alias("mean"),
        F.stddev_pop(s).alias("std"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
        F.count_if(b == "high").alias("high_quality"),
        F.count_if(b == "medium").alias("medium_quality"),
        F.count_if(b == "low").alias("low_quality"),
    )
    return with_quantiles(stats, rows, (), "s", {"median": 0.5})


def correlations(df: DataFrame, pairs: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(pair, r) of Pearson correlations over rows where both are there; null for a constant column."""
    numbers = []
    for i, (_, a, b) in enumerate(pairs):
        x, y = nan_to_null(a.cast("double")), nan_to_null(b.cast("double"))
        both = x.isNotNull() & y.isNotNull()
        numbers += [F.when(both, x).alias(f"_x{i}"), F.when(both, y).alias(f"_y{i}")]
    rows = df.select(*numbers)
    # from the covariance, as corr itself divides by zero on a constant column
    one = rows.agg(
        *[
            F.try_divide(F.covar_pop(f"_x{i}", f"_y{i}"), F.stddev_pop(f"_x{i}") * F.stddev_pop(f"_y{i}")).alias(f"_r{i}")
            for i in range(len(pairs))
        ]
    )
    names = ", ".join(f"'{n}', _r{i}" for i, (n, _, _) in enumerate(pairs))
    return one.selectExpr(f"stack({len(pairs)}, {names}) AS (pair, r)")


def _range(df: DataFrame, value: Column, others: Sequence[Column]) -> DataFrame:
    """The values with the least and largest of all beside them (two numbers from the driver)."""
    rows = df.select(nan_to_null(value.cast("double")).alias("_x"), *others).where(F.col("_x").isNotNull())
    lo, hi = rows.agg(F.min("_x"), F.max("_x")).first()
    return rows.withColumns({"_lo": F.lit(lo).cast("double"), "_hi": F.lit(hi).cast("double")})


def cut_bins(df: DataFrame, value: Column, bins: int, measured: Column) -> DataFrame:
    """Equal-width right-closed bins (the least value in the first), empty ones too: rows, mean and sample std of ``measured``."""
    rows = _range(df, value, [measured.cast("double").alias("_y")])
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when((F.col("_x") == F.col("_lo")) | (width == 0), 0).otherwise(
        F.least(F.greatest(F.ceil((F.col("_x") - F.col("_lo")) / width) - 1, F.lit(0)), F.lit(bins - 1))
    )
    counted = rows.groupBy(at.cast("int").alias("bin")).agg(
        F.count("*").alias("rows"), F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("std")
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("rows", F.lit(0)).alias("rows"), "mean", "std")


def histogram_bins(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width left-closed bins, the last one closed at both ends, empty ones too."""
    rows = _range(df, value, [])
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width == 0, bins // 2).otherwise(F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1)))
    counted = rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("rows"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("rows", F.lit(0)).alias("rows"))


def weighted_mean(df: DataFrame, by: Sequence[str], value: Column, weight: Column) -> DataFrame:
    """sum(value * weight) / sum(weight) over rows with both; null for no weight."""
    both = value.isNotNull() & weight.isNotNull()
    v, w = F.when(both, value * weight), F.when(both, weight)
    return df.groupBy(*by).agg(F.when(F.sum(w) != 0, F.sum(v) / F.sum(w)).alias("weighted_mean"))


def evaluation_bundle(df: DataFrame, positive: Column, negative: Column, pos_align: Column, neg_align: Column) -> DataFrame:
    """Similarity statistics of clean and corrupted texts and their gaps; zeros for no rows."""

    def zero(c: Column, name: str) -> Column:
        return F.coalesce(c, F.lit(0.0)).alias(name)

    rows = df.select(positive.alias("p"), negative.alias("n"), pos_align.alias("pa"), neg_align.alias("na"))
    stats = rows.agg(
        zero(F.avg("p"), "avg_similarity"),
        zero(F.stddev_pop("p"), "std_similarity"),
        zero(F.avg("p"), "clean_similarity"),
        zero(F.avg("n"), "corrupt_similarity"),
        zero(F.avg("p") - F.avg("n"), "similarity_gap"),
        zero(F.avg("pa"), "avg_pos_alignment"),
        zero(F.avg("na"), "avg_neg_alignment"),
        zero(F.avg("pa") - F.avg("na"), "alignment_gap"),
    )
    full = with_quantiles(stats, rows, (), "p", {"median_similarity": 0.5})
    return full.withColumn("median_similarity", F.coalesce("median_similarity", F.lit(0.0)))


def long_report(one_row: DataFrame, section: str) -> DataFrame:
    """A one-row result as (section, metric, value)."""
    parts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in one_row.columns)
    return one_row.selectExpr(f"'{section}' AS section", f"stack({len(one_row.columns)}, {parts}) AS (metric, value)")


def subset_health(counts: DataFrame) -> DataFrame:
    """``counts`` (subset, total, filtered, blank_texts) with ``issues``: the rules that each subset breaks, '' for none."""
    rules = [
        F.when(F.col("total") == 0, "empty"),
        F.when(F.col("filtered") < F.col("total") * 0.5, "filtered below half of total"),
        F.when(F.col("blank_texts") > 0, "blank texts"),
    ]
    return counts.withColumn("issues", F.concat_ws("; ", *rules))
