"""Scoring of (audio, text) batches with any scorer, and filtering by the score."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import advice, band

#: A scorer takes a batch and gives one row for each row: similarity, alignment (NaN for none).
Scorer = Callable[[pd.DataFrame], pd.DataFrame]
SCORED = ("similarity", "alignment_score", "status")


def _scores(batch: pd.DataFrame, scorer: Scorer) -> np.ndarray:
    got = scorer(batch)
    if len(got) != len(batch):
        raise ValueError("a scorer must give one row for each row")
    return got[["similarity", "alignment_score"]].to_numpy(np.float64)


def score_batches(df: DataFrame, scorer: Scorer, inputs: list[str], carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` without its inputs (or only the columns of ``carry``), with similarity, alignment_score and status, batch by batch.

    Other columns pass through as they are; of the name of a score they are replaced. Scores are matched by row, never
    by position of what could be scored. A batch that raises is scored row by row; a row
    that raises has null scores and status 'failed'. Rows with an input that is null or an empty array or text
    have status 'no_input' and never reach the scorer. NaN scores become null.
    """
    kept = [c for c in (df.columns if carry is None else carry) if c not in SCORED and (carry is not None or c not in inputs)]
    there = None
    for c in inputs:
        kind = df.schema[c].dataType
        filled = F.col(c).isNotNull()
        if isinstance(kind, T.ArrayType):
            filled = filled & (F.size(c) > 0)
        elif isinstance(kind, T.StringType | T.BinaryType):
            filled = filled & (F.length(c) > 0)
        there = filled if there is None else there & filled
    given = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)], there.alias("_there"), *[F.col(c).alias(f"_i{i}") for i, c in enumerate(inputs)])
    wide = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.flatnonzero(batch.column(wide).to_numpy(zero_copy_only=False))
            out = np.full((batch.num_rows, 2), np.nan)
            status = np.full(batch.num_rows, "no_input", object)
            if len(good):
                some = batch.take(pa.array(good))
                rows = pa.table({c: some.column(wide + 1 + i) for i, c in enumerate(inputs)}).to_pandas()
                try:
                    out[good] = _scores(rows, scorer)
                    status[good] = "scored"
                except Exception:  # noqa: BLE001
                    for i, at in enumerate(good):
                        try:
                            out[at] = _scores(rows.iloc[[i]].reset_index(drop=True), scorer)[0]
                            status[at] = "scored"
                        except Exception:  # noqa: BLE001
                            status[at] = "failed"
            made = [pa.array(x, pa.float64(), from_pandas=True) for x in (out[:, 0], out[:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:wide], *made, pa.array(status, pa.string())], names=[*batch.schema.names[:wide], *SCORED])

    fields = [T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
    scored = given.mapInArrow(run, T.StructType([*fields, *[T.StructField(c, t) for c, t in zip(SCORED, (T.DoubleType(), T.DoubleType(), T.StringType()), strict=True)]]))
    return scored.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *SCORED)


def only_scored(df: DataFrame) -> DataFrame:
    """Rows of :func:`score_batches` that have a score."""
    return df.where((F.col("status") == "scored") & F.col("similarity").isNotNull())


def filter_by_score(df: DataFrame, score: Column, threshold: float = 0.8) -> DataFrame:
    """Rows with ``score >= threshold``; null and NaN never pass."""
    return df.where((score >= threshold) & ~F.isnan(score))


def verify(df: DataFrame, score: Column, threshold: float = 0.8) -> DataFrame:
    """``df`` with is_high_quality, quality_level and recommendation."""
    level = band(score, inclusive_high=True)
    return df.withColumns(
        {
            "is_high_quality": F.coalesce((score >= threshold) & ~F.isnan(score), F.lit(False)),
            "quality_level": level,
            "recommendation": advice(level),
        }
    )


def pool_groups(tokens: DataFrame, by: Sequence[str], vector: str, mask: Column) -> DataFrame:
    """(by, dim, mean_pooled): the mean of each group's vectors where the mask holds, zeros if it holds nowhere.

    A partial aggregate by dimension: groups have any number of vectors.
    """
    kept = F.coalesce(mask.cast("int"), F.lit(0))
    long = tokens.select(*by, kept.alias("_kept"), F.posexplode(vector).alias("dim", "_x"))
    total = F.coalesce(F.sum(F.when(F.col("_kept") == 1, F.col("_x").cast("double"))), F.lit(0.0))
    return long.groupBy(*by, "dim").agg((total / F.greatest(F.sum("_kept").cast("double"), F.lit(1e-9))).alias("mean_pooled"))
