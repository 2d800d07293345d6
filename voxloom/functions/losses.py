"""Contrastive and alignment losses on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels that tokens of a clean and of a corrupted text are given.
CLEAN_LABEL, CORRUPT_LABEL = 0.9, 0.1


def infonce(positive: Column, negative: Column, temperature: float = 0.1) -> Column:
    """Cross entropy of choosing the positive of two scores, without overflow."""
    gap = (negative - positive) / temperature
    return F.greatest(gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))


def alignment_label(corrupted: Column, correctness: Column) -> Column:
    """The soft label of a text's tokens: fixed for a clean one, its correctness (or a fixed one without it) for a corrupted one."""
    return F.when(~corrupted, CLEAN_LABEL).otherwise(F.coalesce(correctness, F.lit(CORRUPT_LABEL)))


def bce_with_logits(x: Column, label: Column) -> Column:
    """Binary cross entropy of a logit against a soft label."""
    return F.greatest(x, F.lit(0.0)) - x * label + F.log1p(F.exp(-F.abs(x)))


def uncertainty_weight(log_variance: Column) -> Column:
    return F.exp(-log_variance)
