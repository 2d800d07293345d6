"""The unified record schema and projections onto it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 16 columns of a unified record in order, with type and default.
UNIFIED = (
    ("audio", "string", ""),
    ("text", "string", ""),
    ("voice", "string", ""),
    ("model", "string", ""),
    ("text_length", "bigint", 0),
    ("file_size_bytes", "bigint", 0),
    ("estimated_duration", "double", 0.0),
    ("generation_status", "string", ""),
    ("client_id", "string", ""),
    ("up_votes", "bigint", 0),
    ("down_votes", "bigint", 0),
    ("age", "string", ""),
    ("gender", "string", ""),
    ("accent", "string", ""),
    ("locale", "string", "nl"),
    ("dataset_source", "string", ""),
)
# Names under which a transcript is looked for, first match wins.
REFERENCE_TEXT = ("sentence", "text", "transcription", "transcript")
SYNTHETIC_TEXT = ("translation", "sentence", "text", "transcription")


def unified_struct() -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{n} {t}" for n, t, _ in UNIFIED))


def conform(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Project onto the unified schema: fixed order, missing columns get defaults, others go.

    Nulls already there stay null. ``keep`` names further columns to carry in front.
    """
    return df.select(
        *keep,
        *[(F.col(n) if n in df.columns else F.lit(d)).cast(t).alias(n) for n, t, d in UNIFIED if n not in keep],
    )


def ensure_column(df: DataFrame, name: str, default, kind: str = "string") -> DataFrame:
    """``df`` with ``name``: as it is if there, else the default."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate that ``df`` has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {', '.join(candidates)} in {', '.join(df.columns)}")


def rename_if_present(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df


def keep_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """The required columns and those optional ones that exist; a missing required one raises."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*required, *[c for c in optional if c in df.columns and c not in required])


def tag(df: DataFrame, column: str, value) -> DataFrame:
    """A constant column, such as the source of all rows."""
    return df.withColumn(column, F.lit(value))


def schema_gaps(left: Sequence[str], right: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names missing on the right, and extra there."""
    return sorted(set(left) - set(right)), sorted(set(right) - set(left))
