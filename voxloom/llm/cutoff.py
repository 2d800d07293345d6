"""Score cutoffs that keep a wanted fraction of each source's records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import source_key
from ..operators.spread import boundary_rows, broadcast_if_small, range_sorted, small


@dataclass
class Cutoffs:
    """``report``: one row a source with a target; ``kept``: the records at or above the cutoff."""

    report: DataFrame
    kept: DataFrame


def latest(rows: DataFrame, id_col: str, at: str, values: Sequence[Column]) -> DataFrame:
    """The values of each id's row with the latest ``at`` (null is earliest).

    Rows of one id with the same time are ranked by their values, so the choice
    doesn't depend on their order. One partial aggregate, no sort of whole groups on one task.
    """
    packed = F.struct(F.col(at), *values)
    return rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(packed).alias("_r")).select("_id", "_r.*")


def cutoff_for_fraction(
    scores: DataFrame,
    targets: DataFrame,
    id_col: str = "sample_index",
    score: str = "similarity",
    at: str = "scored_at",
    source: Sequence[str] = ("model", "voice"),
    fraction: str = "keep_fraction",
    low: float = 0.0,
    high: float = 1.0,
) -> Cutoffs:
    """Keep ceil(fraction * n) of each source's n valid records, and all ties at the cutoff.

    Only an id's latest row counts, valid or not; valid is a score in [low, high],
    neither null nor NaN. Sources are compared without case and outer blanks; a source
    with several targets takes the largest, a null or NaN fraction is no target, and
    fractions are clamped to [0, 1]. Fraction 0 keeps nothing, and its cutoff is null, as is
    that of a source without valid records. Null source values form no source. Rows
    with a null id are left out. Empty tables give empty results.

    Rows are range-sorted by source and score, counted per partition and source,
    the partition with the k-th row is located by prefix sums, and the row is read there.
    """
    names = [f"_s{i}" for i in range(len(source))]
    f = F.col(fraction).cast("double")
    goals = (
        targets.where(f.isNotNull() & ~F.isnan(f))
        .groupBy(*[source_key(F.col(c)).alias(n) for c, n in zip(source, names)])
        .agg(F.max(F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0)).cast("decimal(19,9)")).alias("_f"))
        .dropna(subset=names)
    )
    few = small(goals)
    wanted = F.broadcast(goals) if few else goals
    s = F.col(score).cast("double")
    valid = s.isNotNull() & ~F.isnan(s) & s.between(low, high)
    rows = latest(
        scores, id_col, at, [F.when(valid, s).alias("_score"), *[source_key(F.col(c)).alias(n) for c, n in zip(source, names)]]
    ).where(F.col("_score").isNotNull())
    order = [F.col("_score").desc(), F.col("_id")]
    ranged = range_sorted(rows.join(wanted.select(*names), names, "left_semi").select(*names, "_score", "_id"), names, order)
    counted = (
        goals.join(ranged.groupBy(*names).agg(F.count("*").alias("_n")), names, "left")
        .withColumn("_n", F.coalesce("_n", F.lit(0)))
        .withColumn("goal", F.ceil(F.col("_f") * F.col("_n")).cast("bigint"))
    )
    cut_rows = boundary_rows(ranged, names, order, counted, few=few).select(*names, F.col("_score").alias("_cut"))
    kept = ranged.join(F.broadcast(cut_rows) if few else broadcast_if_small(cut_rows), names).where(F.col("_score") >= F.col("_cut"))
    out = [F.col(n).alias(c) for c, n in zip(source, names)]
    report = (
        counted.join(cut_rows, names, "left")
        .join(kept.groupBy(*names).agg(F.count("*").alias("_kept")), names, "left")
        .select(
            *out,
            F.col("_f").cast("double").alias(fraction),
            F.col("_n").alias("valid"),
            F.col("_cut").alias("cutoff"),
            F.coalesce("_kept", F.lit(0)).alias("kept"),
        )
    )
    return Cutoffs(report, kept.select(F.col("_id").alias(id_col), *out, F.col("_score").alias(score)))
