"""Queries that go through files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import band
from ..functions.text import norm_key
from ..operators import report
from ..sources import readers, trainlog, writers
from ..storage import place
from ..streaming import online
from .registry import query, sql_key, table
from .running import epochs


@query("""SELECT band, count(*) AS rows, count(DISTINCT sample_index) AS samples FROM (SELECT sample_index, CASE WHEN isnan(similarity) THEN NULL WHEN similarity > 0.8 THEN 'high'
WHEN similarity >= 0.5 THEN 'medium' WHEN similarity < 0.5 THEN 'low' END AS band FROM scores) WHERE band IS NOT NULL GROUP BY 1""")
def bands_round_trip(spark, folder):
    """Band files written in one pass and read again."""
    path = place(spark, "bands")
    s = table(spark, folder, "scores").select("sample_index", "text", band(F.col("similarity")).alias("band"))
    writers.save_bands(s, path)
    back = readers.read_record_lines(spark, path, "sample_index bigint, text string, band string")
    return back.groupBy("band").agg(F.count("*").alias("rows"), F.count_distinct("sample_index").alias("samples"))


@query("SELECT split, count(*) AS rows, CAST(sum(sample_index) AS BIGINT) AS ids FROM unified WHERE split IN ('validation', 'test') GROUP BY 1")
def splits_round_trip(spark, folder):
    """Split folders written, and single splits read by partition."""
    path = place(spark, "splits")
    u = table(spark, folder, "unified").where(F.col("split").isNotNull()).select("sample_index", "text", "split")
    writers.save_splits(u, path)
    two = readers.load_table(spark, path, split="validation").unionByName(readers.load_table(spark, path, split="test"))
    return two.groupBy("split").agg(F.count("*").alias("rows"), F.sum("sample_index").alias("ids"))


@query("SELECT sample_index, split FROM unified WHERE split = 'test' ORDER BY sample_index LIMIT 100")
def split_slice(spark, folder):
    """The first 100 rows of a split by their position in it."""
    return readers.load_table(spark, f"{folder}/unified.parquet", split="test[:100]").select("sample_index", "split")


@query("SELECT filename, file_size FROM audio_files")
def csv_round_trip(spark, folder):
    path = place(spark, "csv")
    writers.save_csv(table(spark, folder, "audio_files"), path)
    return readers.read_csv(spark, path, "filename string, file_size bigint")


@query("""WITH e AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch, round(avg(value) FILTER (event_type = 'error'), 4) AS val_loss,
round(round(avg(value) FILTER (event_type = 'view'), 6) - round(avg(value) FILTER (event_type = 'click'), 6), 4) AS gap FROM events GROUP BY 1)
SELECT epoch, val_loss, gap FROM e WHERE epoch IS NOT NULL""")
def train_log_metrics(spark, folder):
    """Days of events as the lines of a training log, with cut-off lines between, parsed again."""
    e = epochs(spark, folder)
    line = F.format_string(
        "2025-01-01 00:00:00,000 - INFO - Epoch %d/99 - Val Loss: %.4f, Gap: %.4f", "epoch", F.round("loss", 4), F.round(F.col("clean") - F.col("corrupt"), 4)
    )
    lines = e.select(F.explode(F.array(line, F.lit("20"), F.lit("O - Optimizer step"), F.lit("WARNING: Epoch"))).alias("value"))
    return trainlog.epoch_metrics(lines, fields={"val_loss": "Val Loss", "gap": "Gap"})


@query("""SELECT 'similarity' AS section, metric, round(value, 6) AS value FROM (
SELECT count(s) AS count, avg(s) AS mean, max(s) AS max FROM (SELECT CASE WHEN NOT isnan(similarity) THEN similarity END AS s FROM scores))
UNPIVOT (value FOR metric IN (count, mean, max))""".replace("count(s)", "CAST(count(s) AS DOUBLE)"))
def text_report(spark, folder):
    one = report.describe(table(spark, folder, "scores"), F.col("similarity")).select("count", "mean", "max")
    return report.long_report(one, "similarity").withColumn("value", F.round("value", 6))


_FIRST = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY received_at) AS rn FROM api_calls) WHERE rn = 1)"


@query(f"""SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS day, count(*) AS calls, count(*) FILTER (ok) AS ok_calls, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens FROM {_FIRST} GROUP BY 1""")
def stream_call_rates(spark, folder):
    """A stream over the calls' files: deduplicated within four days, windowed by event time, run until all is read."""
    source = table(spark, folder, "api_calls")
    at = F.col("ts").cast("timestamp")
    calls = spark.readStream.schema(source.schema).parquet(_as_folder(spark, source, "calls")).withColumn("ts", at)
    once = calls.withWatermark("ts", "4 days").dropDuplicatesWithinWatermark(["call_id"])
    out = _last_of(online.call_rates(once, window="1 day", late=None), "window_start", spark)
    return out.select(F.unix_seconds("window_start").alias("day"), "calls", "ok_calls", "input_tokens")


def _as_folder(spark, df, label: str) -> str:
    path = place(spark, label)
    df.write.parquet(path)
    return path


def _last_of(stream, key: str, spark):
    """Run a stream of updates over what is there; the last row of each key. Windows beyond the watermark leave the state."""
    to = place(spark, "updates")

    def save(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/out/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{to}/out")
    rest = [c for c in stream.columns if c != key]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


def _spoken(spark, folder, *columns):
    source = table(spark, folder, "synthetic_audio").select("audio_id", *columns)
    return spark.readStream.schema(source.schema).parquet(_as_folder(spark, source, "spoken"))


@query(f"""SELECT min(audio_id) AS audio_id, {sql_key('text')} AS sentence FROM synthetic_audio WHERE text IS NOT NULL GROUP BY 2""")
def stream_first_seen(spark, folder):
    """The first occurrence of each sentence on a stream, at any distance in time."""
    to = place(spark, "first")
    online.keep_first_seen(_spoken(spark, folder, "text"), norm_key(F.col("text")), ["audio_id"], f"{to}/out", f"{to}/state").awaitTermination()
    return spark.read.schema("audio_id bigint, text string").parquet(f"{to}/out").select("audio_id", norm_key(F.col("text")).alias("sentence"))


@query("""SELECT audio_id, voice FROM (SELECT audio_id, voice, row_number() OVER (PARTITION BY voice ORDER BY audio_id) AS rn FROM synthetic_audio WHERE voice IS NOT NULL) WHERE rn <= 20""")
def stream_quota(spark, folder):
    """The first 20 rows a voice of a stream."""
    to = place(spark, "quota")
    online.accept_up_to(_spoken(spark, folder, "voice"), "voice", ["audio_id"], 20, f"{to}/out", f"{to}/state").awaitTermination()
    return spark.read.schema("audio_id bigint, voice string").parquet(f"{to}/out").select("audio_id", "voice")


@query("SELECT generation_status, count(*) AS rows FROM synthetic_audio GROUP BY 1")
def stream_saved(spark, folder):
    """Results appended to a folder as they come."""
    to = place(spark, "progress")
    online.save_progress(_spoken(spark, folder, "generation_status"), f"{to}/out", f"{to}/state").awaitTermination()
    return spark.read.schema("audio_id bigint, generation_status string").parquet(f"{to}/out").groupBy("generation_status").agg(F.count("*").alias("rows"))


@query("SELECT count(*) AS shown FROM synthetic_audio")
def stream_dashboard(spark, folder):
    """The rows that a throttled dashboard was handed in all."""
    to, shown = place(spark, "dashboard"), []
    q = online.dashboard(_spoken(spark, folder, "voice"), lambda batch, n: shown.append(batch.count()), f"{to}/state", "1 second")
    q.processAllAvailable()
    q.stop()
    return spark.range(1).select(F.lit(sum(shown)).cast("bigint").alias("shown"))
