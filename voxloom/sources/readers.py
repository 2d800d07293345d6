"""Reading tables, splits, listings, JSON and logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import within_goal


def load_table(spark: SparkSession, path: str, subset: str | None = None, split: str | None = None, id_col: str = "sample_index") -> DataFrame:
    """A Parquet table; a subset or split is a partition filter, ``split`` may be a slice such as 'test[:10]'.

    A slice keeps the split's first rows in the order of ``id_col``, which is unique: rows have no order of their own.
    """
    df = spark.read.parquet(path)
    if subset is not None:
        df = df.where(F.col("subset") == subset)
    if split is not None:
        name, bound = split_slice(split)
        df = df.where(F.col("split") == name)
        if bound is not None:
            df = first_rows(df, id_col, bound)
    return df


def first_rows(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """The first ``most`` rows in the order of ``id_col``, which is unique; all if there are fewer, none for 0."""
    every = df.withColumn("_every", F.lit(0))
    goal = df.sparkSession.range(1).select(F.lit(0).alias("_every"), F.lit(most).cast("bigint").alias("goal"))
    return within_goal(every, ["_every"], [id_col], goal, few=True).drop("_every")


def split_slice(spec: str) -> tuple[str, int | None]:
    """'test' or 'test[:10]' as (name, bound)."""
    m = re.fullmatch(r"(\w+)(?:\[:(\d+)\])?", spec)
    if not m:
        raise ValueError(f"not a split: {spec!r}")
    return m[1], int(m[2]) if m[2] else None


def first_readable(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first path that is a readable Parquet table; the last error if none is."""
    error: Exception = ValueError("no path given")
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            error = e
    raise error


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file with a JSON array of records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_record_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def sentences_of_response(response: Column) -> Column:
    """A response's JSON array of strings; null if malformed."""
    return F.from_json(response, "array<string>")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.mp3") -> DataFrame:
    """(filename, file_size, modified) of files; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select(
        F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")
    )


def setting(values: DataFrame, key: str, default) -> Column:
    """A setting of a key column, or its default where the column is missing or null."""
    return F.coalesce(F.col(key), F.lit(default)) if key in values.columns else F.lit(default)
