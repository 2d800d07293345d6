"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import norm_key
from ..operators.spread import within_goal
from ..storage import exists


def call_rates(calls: DataFrame, at: str = "ts", window: str = "1 hour", late: str | None = "2 days") -> DataFrame:
    """Calls, successes and tokens by event-time window; rows later than ``late`` are dropped with their window closed.

    Works on a stream or a batch alike (a batch has no watermark). A stream that has its
    watermark already takes ``late=None``.
    """
    timed = calls
    if late is not None:
        timed = calls.withColumn(at, F.col(at).cast("timestamp"))
        timed = timed.withWatermark(at, late) if calls.isStreaming else timed
    return (
        timed.groupBy(F.window(at, window).alias("w"))
        .agg(
            F.count("*").alias("calls"),
            F.count_if("ok").alias("ok_calls"),
            F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        )
        .select(F.col("w.start").alias("window_start"), "calls", "ok_calls", "input_tokens")
    )


def first_seen(rows: DataFrame, key: Column, at: str = "ts", within: str = "10 days") -> DataFrame:
    """The first row of each key; on a stream the keys are forgotten ``within`` after their time.

    For keys that repeat at any distance in time see :func:`keep_first_seen`.
    """
    keyed = rows.withColumn("_key", key)
    if rows.isStreaming:
        return keyed.withWatermark(at, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return keyed.dropDuplicates(["_key"]).drop("_key")


def unique_sentences(rows: DataFrame, sentence: str, at: str = "ts", within: str = "10 days") -> DataFrame:
    """The first occurrence of each normalised sentence."""
    return first_seen(rows, norm_key(F.col(sentence)), at, within)


def _so_far(spark: SparkSession, folder: str, number: int, schema) -> DataFrame:
    """What micro-batches before ``number`` wrote."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(with_batch).parquet(folder).where(F.col("batch") < number).drop("batch")


def _each_batch(stream: DataFrame, folder: str, checkpoint: str, chosen: Callable[[DataFrame, int], DataFrame], trigger: dict | None) -> StreamingQuery:
    """Write ``chosen`` of each micro-batch to its own folder; a repeated micro-batch replaces its own rows only."""

    def write(batch: DataFrame, number: int) -> None:
        chosen(batch, number).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_first_seen(
    stream: DataFrame, key: Column, order: Sequence[str], folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the first row of each key to ``folder``, the first by ``order`` within a micro-batch; rows with a null key are left out.

    The keys seen are a table of 16-byte digests beside the rows, not memory, so they are never forgotten. A micro-batch
    is pre-aggregated by key before the anti join, so a key of very many rows is one row there.
    """

    def firsts(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        keyed = batch.withColumn("_key", F.unhex(F.md5(key))).where(F.col("_key").isNotNull())
        one = keyed.groupBy("_key").agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_row"))
        seen = _so_far(spark, folder, number, keyed.schema).select("_key")
        return one.join(seen, "_key", "left_anti").select("_row.*", "_key")

    return _each_batch(stream, folder, checkpoint, firsts, trigger)


def accept_up_to(
    stream: DataFrame, bucket: str, order: Sequence[str], quota: int | dict, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the first rows of each bucket, up to its quota (one number, or one for each bucket), to ``folder``.

    Rows count in order of arrival, within a micro-batch by ``order`` (ascending, the last column unique). What a bucket
    has already is counted from the folder, so there is no state in memory; a micro-batch is range-sorted, so a
    bucket that holds much of it needs no single task. Rows with a null bucket, or one without quota, are left out.
    """

    def take(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        if isinstance(quota, dict):
            kind = batch.schema[bucket].dataType.simpleString()
            quotas = spark.createDataFrame([(b, int(n)) for b, n in quota.items()], f"`{bucket}` {kind}, _quota bigint")
        else:
            quotas = batch.select(bucket).where(F.col(bucket).isNotNull()).distinct().withColumn("_quota", F.lit(int(quota)).cast("bigint"))
        had = _so_far(spark, folder, number, batch.schema).groupBy(bucket).agg(F.count("*").alias("_had"))
        goals = quotas.join(had, bucket, "left").select(bucket, (F.col("_quota") - F.coalesce("_had", F.lit(0))).alias("goal"))
        return within_goal(batch, [bucket], order, goals)

    return _each_batch(stream, folder, checkpoint, take, trigger)


def dashboard(stream: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Hand each micro-batch to ``show`` at most once in ``every``."""
    return stream.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def save_progress(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append results as they come; after a failure the checkpoint goes on where it stood."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
