"""Epoch metrics from training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A time at the head of a line, with milliseconds after a comma.
STAMP = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3})"
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
# The names that lines of a finished epoch give their numbers.
EPOCH_FIELDS = {
    "train_loss": r"Train Loss",
    "val_loss": r"Val Loss",
    "clean_sim": r"Clean Sim",
    "corrupt_sim": r"Corrupt Sim",
    "gap": r"Gap",
    "seconds": r"Time",
}


def log_time(line: Column) -> Column:
    """The line's time, null without one."""
    return F.try_to_timestamp(F.regexp_extract(line, STAMP, 1), F.lit("yyyy-MM-dd HH:mm:ss,SSS"))


def number_after(line: Column, name: str) -> Column:
    """The number after ``name`` and a colon or equals sign, null without one (also in cut-off lines)."""
    return F.regexp_extract(line, rf"(?i)\b{name}\s*[:=]\s*({NUMBER})", 1).try_cast("double")


def epoch_metrics(lines: DataFrame, value: str = "value", fields: dict[str, str] | None = None) -> DataFrame:
    """(epoch, metric columns) of the lines that name an epoch, ``Epoch 3/30`` or ``Epoch 3:``, and a metric.

    Lines that are cut off, warnings and other events give no row; of several lines of one epoch
    each metric's last value by line time counts.
    """
    named = fields or EPOCH_FIELDS
    line = F.col(value)
    parsed = lines.select(
        F.regexp_extract(line, r"(?i)\bepoch\s+(\d+)", 1).try_cast("int").alias("epoch"),
        log_time(line).alias("at"),
        *[number_after(line, pattern).alias(name) for name, pattern in named.items()],
    ).where(F.col("epoch").isNotNull() & F.coalesce(*named).isNotNull())
    return parsed.groupBy("epoch").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.coalesce("at", F.timestamp_seconds(F.lit(0))))).alias(n) for n in named]
    )


def best_epochs(metrics: DataFrame) -> DataFrame:
    """One row: the epoch of the least validation loss and of the largest gap, ties to the earlier epoch."""
    return metrics.agg(
        F.min(F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch"))).getField("epoch").alias("best_loss_epoch"),
        F.min(F.when(F.col("gap").isNotNull(), F.struct((-F.col("gap")).alias("g"), F.col("epoch")))).getField("epoch").alias("best_gap_epoch"),
        F.max("gap").alias("max_gap"),
        F.sum("seconds").alias("total_seconds"),
    )
