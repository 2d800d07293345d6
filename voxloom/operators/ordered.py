"""Running, rolling and positional operators over an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import seeded
from .spread import range_sorted


def global_position(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """``df`` with each row's position (from 0) in a total order, without sorting on one task.

    Rows are range-partitioned by the order and counted by partition; the sum of the partitions
    before is added to the row number inside. The order should end in a unique column.
    """
    ranged = range_sorted(df, [], order)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(out, F.col("_ahead") + inside - 1).drop("_part", "_ahead")


def running_best(df: DataFrame, order: str, loss: str, gap: str, by: Sequence[str] = ()) -> DataFrame:
    """Flags of strict improvements: of the loss from infinity, of the gap from 0. Null never improves.

    For metric series, a row an epoch; several runs are told apart by ``by``.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    better_loss = F.col(loss) < F.coalesce(F.min(loss).over(w), F.lit(float("inf")))
    better_gap = F.col(gap) > F.greatest(F.coalesce(F.max(gap).over(w), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("best_loss", F.coalesce(better_loss, F.lit(False))).withColumn("best_gap", F.coalesce(better_gap, F.lit(False)))


def rolling_rate(df: DataFrame, at: str, order: Sequence[Column], last: int = 100, chunk: int = 50_000) -> DataFrame:
    """``df`` with calls_per_minute over the last ``last`` rows in order; 0 for one row or no time between.

    The order is global, the work isn't: rows are cut into chunks of positions, each chunk also gets the
    ``last`` - 1 rows before it, and windows stay inside a chunk.
    """
    placed = global_position(df, order, "_pos")
    own = F.floor(F.col("_pos") / chunk)
    late = F.col("_pos") % chunk >= chunk - (last - 1)
    copies = placed.withColumn("_chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(-(last - 1), 0)
    n = F.count("*").over(w)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    seconds = (micros - F.min(micros).over(w)) / 1e6
    rated = copies.withColumn("calls_per_minute", F.when((n >= 2) & (seconds > 0), n / seconds * 60).otherwise(F.lit(0.0)))
    return rated.where(F.col("_chunk") == own).drop("_pos", "_chunk")


def counters(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums in a global order; null adds nothing.

    Range partitions are summed first; each row adds the sums of the partitions before its own.
    """
    adds = {f"_a_{n}": F.coalesce(c.cast("bigint"), F.lit(0)) for n, c in sums.items()}
    ranged = range_sorted(df.withColumns(adds), [], order)
    totals = ranged.groupBy("_part").agg(*[F.sum(a).alias(a) for a in adds])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *[F.coalesce(F.sum(a).over(ahead), F.lit(0)).alias(f"_b{a}") for a in adds])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {n: F.col(f"_b_a_{n}") + F.sum(f"_a_{n}").over(inside) for n in sums}
    return ranged.join(F.broadcast(before), "_part").withColumns(out).select(*df.columns, *sums)


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left at the rate so far; null if nothing is done yet, nothing is left, or no time passed."""
    return F.when((done > 0) & (done < total) & (elapsed > 0), (total - done) / (done / elapsed))


def exact_split(df: DataFrame, id_col: str, seed: int = 42, share: float = 0.1) -> DataFrame:
    """``df`` with ``split``: floor(n * share) rows each of test and validation, the rest train, in seeded order (test last)."""
    shuffled = global_position(df.withColumn("_h", seeded(F.col(id_col), seed=seed)), [F.col("_h"), F.col(id_col)], "_pos")
    n = df.count()
    part = int(n * share)
    split = F.when(F.col("_pos") >= n - part, "test").when(F.col("_pos") >= n - 2 * part, "validation").otherwise("train")
    return shuffled.withColumn("split", split).drop("_h", "_pos")


def round_robin(position: Column, names: Sequence[str], batch: int = 100) -> Column:
    """names[i % len], starting again in every batch."""
    listed = F.array(*[F.lit(n) for n in names])
    return F.element_at(listed, ((position % batch) % len(names) + 1).cast("int"))


def batch_of(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("bigint")


def every(df: DataFrame, position: Column, n: int) -> DataFrame:
    """The rows whose running count is a multiple of n (a progress log)."""
    return df.where((position + 1) % n == 0)


def ranked(df: DataFrame, score: str, id_col: str, out: str = "rank") -> DataFrame:
    """``df`` with each row's rank (from 1) by the score, highest first, null and NaN last, ties by id."""
    s = F.when(~F.isnan(score), F.col(score))
    return global_position(df, [s.desc_nulls_last(), F.col(id_col)], out).withColumn(out, F.col(out) + 1)


def shuffled_order(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """``df`` in seeded order: the same in every run and any partitioning."""
    return df.withColumn("_h", seeded(F.col(id_col), seed=seed)).orderBy("_h", id_col).drop("_h")
