"""A bound on the records of each contributor, keeping those of best quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import filled_key
from ..operators.spread import boundary_rows, range_sorted, small
from ..storage import cut

#: Quality values below this are bins of their own; above it each octave has EXACT / 2 bins.
EXACT = 64


def vote_balance(up: str = "up_votes", down: str = "down_votes") -> Column:
    """up - down, where null or negative votes count as 0."""

    def votes(c: str) -> Column:
        return F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint")

    return votes(up) - votes(down)


def quality_bin(q: Column) -> Column:
    """A bin that never falls as ``q`` (integer) grows; exact up to EXACT, then logarithmic."""
    size = F.abs(q).cast("double")
    octave = F.log2(F.greatest(size, F.lit(1.0)) / EXACT)
    far = (F.lit(float(EXACT)) + F.floor(octave * (EXACT // 2))).cast("bigint")
    level = F.when(size < EXACT, size.cast("bigint")).otherwise(far)
    return F.when(q < 0, -level).otherwise(level)


def drop_beyond_cap(
    rows: DataFrame,
    contributor: str,
    quality: Column,
    id_col: str,
    share: float | None = 0.01,
    most: int | None = None,
) -> DataFrame:
    """The rows (id, contributor, quality, cap) that a contributor's cap drops.

    The cap is floor(share * rows with a contributor), at least 1, or ``most``, or the smaller of both.
    Rows rank by quality, best first, then by smaller id. Contributors are compared
    without case and outer blanks; null or blank ones are neither dropped nor counted.
    Null quality ranks last; rows with a null id are left out. Rows that repeat the id and quality
    of the cap's last row are kept with it.

    Per-contributor quality histograms give the bin in which the cap is reached:
    rows below it are dropped, rows above it kept, and only those in it are ranked, through
    range partitions and prefix sums, so that no contributor needs a single task.
    """
    base = rows.select(
        F.col(id_col).alias("_id"), filled_key(F.col(contributor)).alias("_who"), quality.cast("bigint").alias("_q")
    ).where(F.col("_id").isNotNull() & F.col("_who").isNotNull())
    base = base.withColumn("_q", F.coalesce("_q", F.lit(-(2**62)).cast("bigint"))).withColumn("_bin", quality_bin(F.col("_q")))
    histograms = cut(base.groupBy("_who", "_bin").agg(F.count("*").alias("_n")), "histograms")
    total = histograms.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    caps = ([max(1, int(total * round(share * 10**9) // 10**9))] if share is not None else []) + ([most] if most is not None else [])
    cap = min(caps)
    above = Window.partitionBy("_who").orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # fewer than total / cap contributors have more than cap rows
    over = (
        histograms.withColumn("_upto", F.sum("_n").over(above))
        .where((F.col("_upto") > cap) & (F.col("_upto") - F.col("_n") <= cap))
        .groupBy("_who")
        .agg(F.max_by("_bin", "_bin").alias("_edge"), F.max_by(cap - (F.col("_upto") - F.col("_n")), "_bin").alias("goal"))
    )
    few = total < 10_000 * cap or small(over)
    edges = F.broadcast(over) if few else over
    touched = base.join(edges, "_who").where(F.col("_bin") <= F.col("_edge"))
    order = [F.col("_q").desc(), F.col("_id")]
    ranged = range_sorted(touched.where(F.col("_bin") == F.col("_edge")).select("_who", "_q", "_id", "goal"), ["_who"], order)
    goals = over.select("_who", "goal")
    last = boundary_rows(ranged.drop("goal"), ["_who"], order, goals, few=few).select(
        "_who", F.col("_q").alias("_lq"), F.col("_id").alias("_lid")
    )
    border = (
        ranged.join(F.broadcast(last) if few else last, "_who", "left")
        .where(
            F.col("_lq").isNull()
            | (F.col("_q") < F.col("_lq"))
            | ((F.col("_q") == F.col("_lq")) & (F.col("_id") > F.col("_lid")))
        )
        .select("_id", "_who", "_q")
    )
    dropped = touched.where(F.col("_bin") < F.col("_edge")).select("_id", "_who", "_q").unionByName(border)
    return dropped.select(
        F.col("_id").alias(id_col), F.col("_who").alias(contributor), F.col("_q").alias("quality"), F.lit(cap).cast("bigint").alias("cap")
    )
