"""Writing tables, bands, statistics and result files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_splits(df: DataFrame, path: str, by: Sequence[str] = ("split",), mode: str = "overwrite") -> None:
    """Parquet in one folder a split (or subset and split)."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def replace_splits(df: DataFrame, path: str, by: Sequence[str] = ("split",)) -> None:
    """Overwrite only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_bands(df: DataFrame, path: str, band: str = "band") -> None:
    """JSON lines in one folder a band, in one pass; rows without a band are left out."""
    df.where(F.col(band).isNotNull()).write.mode("overwrite").partitionBy(band).json(path)


def save_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_scores(df: DataFrame, path: str, id_col: str, score: str) -> None:
    """Raw scores as (id, score), in files of ranges of the id."""
    df.select(id_col, score).repartitionByRange(id_col).sortWithinPartitions(id_col).write.mode("overwrite").parquet(path)


def save_record_array(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small result as one file with a JSON array of records, in order."""
    one = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def save_small_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small result as one sorted CSV file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def nested_json(one_row: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """A one-row result as one JSON document with a struct for each group of columns."""
    return one_row.select(F.to_json(F.struct(*[F.struct(*cols).alias(name) for name, cols in groups.items()])).alias("json"))


def publish(items: dict[str, Callable[[], None]]) -> list[tuple[str, bool, str]]:
    """Run named writes; a failing one doesn't stop the rest. (name, ok, error) of each."""
    out = []
    for name, write in items.items():
        try:
            write()
            out.append((name, True, ""))
        except Exception as e:  # noqa: BLE001
            out.append((name, False, f"{type(e).__name__}: {e}"[:300]))
    return out


def card(summary: DataFrame, title: str, columns: Sequence[str]) -> DataFrame:
    """A text card: a title, and a line 'column: value' for each column, of every row."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return summary.select(F.concat_ws("\n", F.lit(f"# {title}"), *lines).alias("card"))
