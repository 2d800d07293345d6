"""Registration of queries with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.keys import source_key

#: Thresholds, temperature and seed of the queries; their SQL has the defaults.
SETTINGS = Settings.load()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def real(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of unified that are real speech."""
    return table(spark, folder, "unified").where(source_key(F.col("voice")) == "common_voice")


def synthetic(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of unified that are synthesised; a null voice is neither."""
    return table(spark, folder, "unified").where(source_key(F.col("voice")) != "common_voice")


#: The same selections in SQL.
REAL = "(SELECT * FROM unified WHERE lower(trim(voice)) = 'common_voice')"
SYNTHETIC = "(SELECT * FROM unified WHERE lower(trim(voice)) <> 'common_voice')"
#: White space in DuckDB's regular expressions.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_key(c: str) -> str:
    return f"lower(regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g'))"


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{SPACE}+'), lambda w: w <> '')"


def sql_hash(*parts: str, seed: int = 42) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('#', {', '.join(parts)}, '{seed}')), 1, 8)) AS BIGINT)"
