"""Waveforms as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mono(channels: Column) -> Column:
    """The mean of the channels, sample by sample; of one channel itself, null of none."""
    start = F.transform(F.try_element_at(channels, F.lit(1)), lambda x: x.cast("double") * 0)
    total = F.aggregate(channels, start, lambda s, c: F.zip_with(s, c, lambda x, y: x + y))
    return F.when(F.size(channels) > 0, F.transform(total, lambda x: x / F.size(channels)))


def to_int16(wave: Column) -> Column:
    """Samples in [-1, 1] as 16-bit integers; louder ones are clipped."""
    return F.transform(wave, lambda x: (F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int"))


def duration(wave: Column, rate: Column) -> Column:
    """Seconds; null without a positive rate."""
    return F.when((rate > 0) & wave.isNotNull(), F.size(wave) / rate)


def rough_duration(text: Column) -> Column:
    """A tenth of a second a character."""
    return F.length(text) * 0.1
