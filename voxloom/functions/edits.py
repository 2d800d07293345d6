"""Word edit distance, vectorised over pairs of equal shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Table cells that one numpy step holds at most.
CELLS = 1_000_000


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs, m = b.shape
    along = np.arange(m + 1)
    row = np.broadcast_to(along, (pairs, m + 1)).copy()
    for i in range(a.shape[1]):
        best = np.empty_like(row)
        best[:, 0] = i + 1
        np.minimum(row[:, :-1] + (b != a[:, i : i + 1]), row[:, 1:] + 1, out=best[:, 1:])
        row = np.minimum.accumulate(best - along, axis=1) + along
    return row[:, -1]


def distances(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Insertions, deletions and replacements of words between each pair; equal ends are cut off first."""
    out = np.zeros(len(left), np.int64)
    shapes: dict[tuple[int, int], list[tuple[int, list[str], list[str]]]] = {}
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        k, most = 0, min(len(x), len(y))
        while k < most and x[k] == y[k]:
            k += 1
        e = 0
        while e < most - k and x[-1 - e] == y[-1 - e]:
            e += 1
        x, y = x[k : len(x) - e], y[k : len(y) - e]
        if not x or not y:
            out[i] = len(x) + len(y)
        else:
            shapes.setdefault((len(x), len(y)), []).append((i, x, y))
    for (_, m), group in shapes.items():
        step = max(1, CELLS // (m + 1))
        for k in range(0, len(group), step):
            part = group[k : k + step]
            number: dict[str, int] = {}
            a = np.array([[number.setdefault(w, len(number)) for w in x] for _, x, _ in part])
            b = np.array([[number.setdefault(w, len(number)) for w in y] for _, _, y in part])
            out[[i for i, _, _ in part]] = _distance(a, b)
    return out


def with_word_edits(df: DataFrame, reference: str, hypothesis: str, out: str = "edits") -> DataFrame:
    """``df`` with the word edit distance of two word-array columns; null if either is null."""
    r, h = df.columns.index(reference), df.columns.index(hypothesis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(r).to_pylist(), batch.column(h).to_pylist()
            valid = [i for i, (x, y) in enumerate(zip(left, right, strict=True)) if x is not None and y is not None]
            got: list[int | None] = [None] * len(left)
            for i, d in zip(valid, distances([left[i] for i in valid], [right[i] for i in valid]).tolist(), strict=True):
                got[i] = d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def word_edits_expr(reference: Column, hypothesis: Column) -> Column:
    """The same distance from built-in functions alone, for where Python can't run.

    Rows of the table are arrays that grow by copying, so the work is cubic in the words: for sentences, not for long texts.
    """
    first = F.transform(F.sequence(F.lit(0), F.size(hypothesis)), lambda x: x.cast("int"))

    def next_row(row: Column, word: Column) -> Column:
        start = F.array(F.element_at(row, 1) + 1)
        steps = F.transform(hypothesis, lambda h, j: F.struct(h.alias("h"), j.alias("j")))
        return F.aggregate(
            steps,
            start,
            lambda acc, s: F.concat(
                acc,
                F.array(
                    F.least(
                        F.element_at(acc, -1) + 1,
                        F.element_at(row, s["j"] + 2) + 1,
                        F.element_at(row, s["j"] + 1) + F.when(s["h"] == word, 0).otherwise(1),
                    )
                ),
            ),
        )

    return F.element_at(F.aggregate(reference, first, next_row), -1)
