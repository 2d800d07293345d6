"""Joins and selections that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut

#: Rows up to which a table counts as small enough for every executor.
BROADCAST_ROWS = 100_000
#: A key is hot when it holds more than one row in so many.
HOT_PARTS = 1_000
#: Below so many rows no key is hot.
HOT_LEAST = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if small(df, rows) else df


def hot_limit(total: int) -> int:
    return max(HOT_LEAST, total // HOT_PARTS)


def spread_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    size: str,
    total: int,
    salt: Column,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` with ``table`` without one task per hot key.

    ``size`` is the table's column with the number of ``rows`` each key has, and
    ``total`` their sum at most. Keys above ``hot_limit(total)`` are cut into
    slices by ``salt``; as sizes add up to ``total`` there are at most HOT_PARTS
    such keys, so their list is safe to broadcast. ``size`` is dropped.
    """
    limit = hot_limit(total)
    if total <= limit:
        return rows.join(table.drop(size), list(keys), how)
    hot = F.broadcast(
        table.where(F.col(size) > limit).select(*keys, F.ceil(F.col(size) / limit).cast("int").alias("_slices")).distinct()
    )
    left = rows.join(hot, list(keys), "left").withColumn(
        "_slice", F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt), F.col("_slices"))).cast("int")
    )
    right = table.withColumn(
        "_slice",
        F.explode(F.sequence(F.lit(0), F.when(F.col(size) > limit, F.ceil(F.col(size) / limit).cast("int") - 1).otherwise(0))),
    ).drop(size)
    return left.drop("_slices").join(right, [*keys, "_slice"], how).drop("_slice")


def even_join(rows: DataFrame, table: DataFrame, key: str, how: str, total: int | None = None) -> DataFrame:
    """Join ``rows`` with ``table`` on ``key``, in slices where a key has very many ``rows``.

    For keys that ``table`` has once. ``how`` is inner, left, left_semi or left_anti. The keys of ``rows`` are counted by partial
    aggregates; at most HOT_PARTS can be hot, and only their list is broadcast. Rows with a null key match nothing and
    are spread too. Rows that are alike in all columns share a slice. ``total`` is the number of ``rows`` at most, where it
    is cheaper to know than by computing the keys.
    """
    total = rows.count() if total is None else total
    limit = hot_limit(total)
    if total <= limit:
        return rows.join(table, key, how)
    hot = cut(
        rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)  # a null among them matches nothing
        .select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_slices")),
        "hot",
    )
    salt = F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t and "variant" not in t])
    slices = F.when(F.col(key).isNull(), HOT_PARTS).otherwise(F.coalesce("_slices", F.lit(1)))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_slice", F.pmod(salt, slices).cast("int")).drop("_slices")
    right = table.join(F.broadcast(hot), key, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    ).drop("_slices")
    return left.join(right, [key, "_slice"], how).drop("_slice")


def range_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` in range partitions of (keys, order), written, with the partition as ``_part``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id())
    return cut(ranged, "ranged")


def boundary_rows(
    ranged: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    goals: DataFrame,
    weight: str | None = None,
    few: bool | None = None,
) -> DataFrame:
    """Of each key the row at which the running weight, in ``order``, reaches its goal.

    ``ranged`` comes from :func:`range_sorted` with the same keys and order;
    ``goals`` has the keys and ``goal`` (rows, or the sum of ``weight``); a key may have several. Counts
    per (partition, key) locate the partition by prefix sums; only that
    partition's rows are ranked. A key whose total is below its goal, or whose
    goal is not positive, has no row. Adds ``_before``, the weight of the rows ahead.
    ``few`` says that the goals are known to be few; else their number is checked.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    cells = ranged.groupBy(*keys, "_part").agg(F.sum(w).alias("_w"))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        cells.withColumn("_upto", F.sum("_w").over(upto))
        .join(goals.select(*keys, "goal"), keys)
        .where((F.col("goal") > 0) & (F.col("_upto") >= F.col("goal")) & (F.col("_upto") - F.col("_w") < F.col("goal")))
        .select(*keys, "_part", "goal", (F.col("_upto") - F.col("_w")).alias("_ahead"))
    )
    inside = Window.partitionBy(*keys, "_part", "goal").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(F.broadcast(placed.distinct()) if few or (few is None and small(goals)) else placed.distinct(), [*keys, "_part"])
        .withColumn("_run", F.col("_ahead") + F.sum(w).over(inside))
        .where((F.col("_run") >= F.col("goal")) & (F.col("_run") - w < F.col("goal")))
        .withColumn("_before", F.col("_run") - w)
        .drop("_part", "_ahead", "_run")
    )


def within_goal(df: DataFrame, keys: Sequence[str], order: Sequence[str], goals: DataFrame, few: bool | None = None) -> DataFrame:
    """The first ``goal`` rows of each key in ascending ``order`` (columns, the last one unique); keys without goal have none.

    As :func:`boundary_rows`, so a key that holds much of the data needs no single task.
    """
    keys = list(keys)
    few = small(goals) if few is None else few
    ranged = range_sorted(df, keys, [F.col(c) for c in order])
    last = boundary_rows(ranged.select(*keys, *order, "_part"), keys, [F.col(c) for c in order], goals, few=few).select(*keys, F.struct(*order).alias("_last"))
    wanted = goals.where(F.col("goal") > 0).select(*keys).join(last, keys, "left")
    return (
        ranged.join(F.broadcast(wanted) if few else wanted, keys)
        .where(F.col("_last").isNull() | (F.struct(*order) <= F.col("_last")))
        .select(*df.columns)
    )


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours) of each group, a column for each share; null values are left out.

    Equal values are counted first, as a partial aggregate, so a value that half of the rows share is one row.
    The counted values are range-sorted and only those at the wanted ranks are read, so no task holds a group's values.
    """
    rows = df.select(*by, F.col(value).alias("_q")).where(F.col("_q").isNotNull())
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    safe = [F.struct(*[F.col(k) for k in keys]).alias("_g")]  # a struct is never null, whatever its fields
    counted = rows.select(*safe, "_q").groupBy("_g", "_q").agg(F.count("*").alias("_times"))
    ranged = range_sorted(counted, ["_g"], [F.col("_q")])
    sizes = cut(ranged.groupBy("_g").agg(F.sum("_times").alias("_n")), "sizes")
    places = F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("_n") - 1) * F.lit(s)).alias("at")) for n, s in shares.items()])
    wanted = sizes.select("_g", F.explode(places).alias("p")).select(
        "_g", "p.name", (F.col("p.at") - F.floor("p.at")).alias("part"), (F.floor("p.at") + 1).cast("bigint").alias("lo"), (F.ceil("p.at") + 1).cast("bigint").alias("hi")
    )
    goals = wanted.select("_g", F.explode(F.array("lo", "hi")).alias("goal")).distinct()
    found = cut(boundary_rows(ranged, ["_g"], [F.col("_q")], goals, "_times").select("_g", "goal", "_q").distinct(), "ranks")
    low, high = found.select("_g", F.col("goal").alias("lo"), F.col("_q").alias("_l")), found.select("_g", F.col("goal").alias("hi"), F.col("_q").alias("_h"))
    made = wanted.join(low, ["_g", "lo"]).join(high, ["_g", "hi"]).withColumn("q", F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("part"))
    out = made.groupBy("_g").agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in shares])
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in by], *shares)
