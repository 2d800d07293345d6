"""Queries over an order: running bests, rates, positions, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import seeded
from ..operators import ordered as od
from ..operators import report
from .curation import VOICES
from .registry import query, sql_hash, table

#: A day of events as an epoch: its loss and the similarities of clean and corrupted pairs.
_EPOCHS = """(SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch, round(avg(value) FILTER (event_type = 'error'), 6) AS loss,
round(avg(value) FILTER (event_type = 'view'), 6) AS clean, round(avg(value) FILTER (event_type = 'click'), 6) AS corrupt FROM events GROUP BY 1)"""


def epochs(spark, folder):
    def mean(kind):
        return F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6)

    e = table(spark, folder, "events").groupBy(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"))
    return e.agg(mean("error").alias("loss"), mean("view").alias("clean"), mean("click").alias("corrupt"))


@query(f"SELECT epoch, loss, clean, corrupt, round(clean - corrupt, 6) AS gap FROM {_EPOCHS}")
def epoch_gaps(spark, folder):
    return epochs(spark, folder).withColumn("gap", F.round(F.col("clean") - F.col("corrupt"), 6))


@query(f"""WITH e AS (SELECT epoch, loss, round(clean - corrupt, 6) AS gap FROM {_EPOCHS}),
w AS (SELECT *, min(loss) OVER p AS best, max(gap) OVER p AS top FROM e WINDOW p AS (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT epoch, loss, gap, coalesce(best IS NULL AND loss IS NOT NULL OR loss < best, false) AS best_loss, coalesce(gap > greatest(coalesce(top, 0), 0), false) AS best_gap FROM w""")
def running_best(spark, folder):
    return od.running_best(epoch_gaps(spark, folder).select("epoch", "loss", "gap"), "epoch", "loss", "gap")


@query(f"""WITH e AS (SELECT epoch, loss, round(clean - corrupt, 6) AS gap FROM {_EPOCHS})
SELECT arg_min(epoch, loss) AS best_loss_epoch, arg_max(epoch, gap) AS best_gap_epoch, max(gap) AS max_gap FROM e""")
def best_epoch(spark, folder):
    e = epoch_gaps(spark, folder)
    return e.agg(F.min_by("epoch", "loss").alias("best_loss_epoch"), F.max_by("epoch", "gap").alias("best_gap_epoch"), F.max("gap").alias("max_gap"))


@query("""SELECT event_type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) AS weighted_mean FROM events WHERE value IS NOT NULL GROUP BY 1""")
def weighted_epoch_mean(spark, folder):
    w = F.col("event_id") % 7 + 1
    return report.weighted_mean(table(spark, folder, "events"), ["event_type"], F.col("value"), w).withColumn("weighted_mean", F.round("weighted_mean", 6))


def calls(spark, folder):
    """Each call once, as first received."""
    rest = ["ts", "ok", "is_retry", "rate_limited", "input_tokens", "output_tokens"]
    first = table(spark, folder, "api_calls").groupBy("call_id").agg(F.min(F.struct("received_at", *rest)).alias("r"))
    return first.select("call_id", *[f"r.{c}" for c in rest])


_CALLS = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY received_at) AS rn FROM api_calls) WHERE rn = 1)"


@query(f"""WITH c AS (SELECT call_id, ts, count(*) OVER w AS n, epoch_us(ts) - min(epoch_us(ts)) OVER w AS span FROM {_CALLS} WHERE ok
WINDOW w AS (ORDER BY ts, call_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT call_id, CASE WHEN n >= 2 AND span > 0 THEN round(n / (span / 1e6) * 60, 6) ELSE 0.0 END AS calls_per_minute FROM c""")
def rolling_call_rate(spark, folder):
    good = calls(spark, folder).where("ok").select("call_id", "ts")
    return od.rolling_rate(good, "ts", [F.col("ts"), F.col("call_id")]).select("call_id", F.round("calls_per_minute", 6).alias("calls_per_minute"))


_RUN = f"""(SELECT call_id, ts, CAST(sum(CAST(ok AS INT)) OVER w AS BIGINT) AS succeeded, CAST(sum(CAST(NOT ok AS INT)) OVER w AS BIGINT) AS failed, CAST(sum(CAST(is_retry AS INT)) OVER w AS BIGINT) AS retries,
CAST(sum(coalesce(input_tokens, 0)) OVER w AS BIGINT) AS tokens_in, CAST(sum(coalesce(output_tokens, 0)) OVER w AS BIGINT) AS tokens_out FROM {_CALLS} WINDOW w AS (ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING))"""


@query(f"SELECT call_id, succeeded, failed, retries, tokens_in, tokens_out FROM {_RUN}")
def cumulative_tracker(spark, folder):
    sums = {
        "succeeded": F.col("ok").cast("int"), "failed": (~F.col("ok")).cast("int"), "retries": F.col("is_retry").cast("int"),
        "tokens_in": F.col("input_tokens"), "tokens_out": F.col("output_tokens"),
    }
    return od.counters(calls(spark, folder), [F.col("ts"), F.col("call_id")], sums).select("call_id", *sums)


@query(f"""WITH r AS (SELECT *, (SELECT count(*) FILTER (ok) FROM {_CALLS}) AS total, (SELECT min(epoch_us(ts)) FROM {_CALLS}) AS begun FROM {_RUN})
SELECT call_id, succeeded, CASE WHEN succeeded > 0 AND succeeded < total AND epoch_us(ts) > begun
THEN round((total - succeeded) / (succeeded / ((epoch_us(ts) - begun) / 1e6)), 3) END AS eta_seconds FROM r""")
def eta_seconds(spark, folder):
    """The time left after each call, at the rate of successes so far."""
    c = calls(spark, folder)
    total, begun = c.agg(F.count_if("ok"), F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    ran = od.counters(c.select("call_id", "ts", "ok"), [F.col("ts"), F.col("call_id")], {"succeeded": F.col("ok").cast("int")})
    spent = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(begun)) / 1e6
    left = od.remaining_seconds(F.col("succeeded"), F.lit(total), spent)
    return ran.select("call_id", "succeeded", F.round(left, 3).alias("eta_seconds"))


@query(f"""SELECT count(*) AS calls, count(*) FILTER (ok) AS ok_calls, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (ok) / count(*) * 100, 6) ELSE 0.0 END AS success_rate,
count(*) FILTER (rate_limited) AS rate_limited FROM {_CALLS}""")
def success_rate(spark, folder):
    n, good = F.count("*"), F.count_if("ok")
    return calls(spark, folder).agg(
        n.alias("calls"), good.alias("ok_calls"), F.when(n > 0, F.round(good / n * 100, 6)).otherwise(F.lit(0.0)).alias("success_rate"), F.count_if("rate_limited").alias("rate_limited")
    )


_POS = f"(SELECT doc_id, row_number() OVER (ORDER BY {sql_hash('doc_id')}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)"


@query(f"""SELECT doc_id, CASE WHEN pos >= n - CAST(floor(n * 0.1) AS BIGINT) THEN 'test' WHEN pos >= n - 2 * CAST(floor(n * 0.1) AS BIGINT) THEN 'validation' ELSE 'train' END AS split FROM {_POS}""")
def exact_split(spark, folder):
    return od.exact_split(table(spark, folder, "documents").select("doc_id"), "doc_id")


@query(f"SELECT doc_id, pos AS position FROM {_POS}")
def shuffled_positions(spark, folder):
    d = table(spark, folder, "documents").select("doc_id").withColumn("_h", seeded(F.col("doc_id")))
    return od.global_position(d, [F.col("_h"), F.col("doc_id")]).drop("_h")


_ROW = "(SELECT audio_id, row_number() OVER (ORDER BY audio_id) - 1 AS pos FROM synthetic_audio)"
_VOICE_LIST = "[" + ", ".join(f"'{v}'" for v in VOICES) + "]"


@query(f"SELECT audio_id, ({_VOICE_LIST})[(pos % 100) % 9 + 1] AS voice FROM {_ROW}")
def round_robin_voice(spark, folder):
    p = od.global_position(table(spark, folder, "synthetic_audio").select("audio_id"), [F.col("audio_id")])
    return p.select("audio_id", od.round_robin(F.col("position"), VOICES).alias("voice"))


@query(f"SELECT pos // 150 AS batch_id, count(*) AS rows, min(audio_id) AS first_id FROM {_ROW} GROUP BY 1")
def micro_batches(spark, folder):
    p = od.global_position(table(spark, folder, "synthetic_audio").select("audio_id"), [F.col("audio_id")])
    return p.groupBy(od.batch_of(F.col("position"), 150).alias("batch_id")).agg(F.count("*").alias("rows"), F.min("audio_id").alias("first_id"))


@query(f"SELECT audio_id, pos + 1 AS done FROM {_ROW} WHERE (pos + 1) % 50 = 0")
def progress_log(spark, folder):
    p = od.global_position(table(spark, folder, "synthetic_audio").select("audio_id"), [F.col("audio_id")])
    return od.every(p, F.col("position"), 50).select("audio_id", (F.col("position") + 1).alias("done"))


@query(f"""SELECT call_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, round((epoch_us(received_at) - epoch_us(ts)) / 1e6, 6) AS latency,
CASE WHEN received_at >= ts THEN printf('%d:%02d:%02d', CAST(floor((epoch_us(received_at) - epoch_us(ts)) / 1e6) AS BIGINT) // 3600, CAST(floor((epoch_us(received_at) - epoch_us(ts)) / 1e6) AS BIGINT) % 3600 // 60,
CAST(floor((epoch_us(received_at) - epoch_us(ts)) / 1e6) AS BIGINT) % 60) END AS shown, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM {_CALLS})) / 1e6 / 3600, 6) AS hours_in FROM {_CALLS}""")
def call_times(spark, folder):
    """Stamps, latencies and hours since the first call."""
    c = calls(spark, folder)
    got = table(spark, folder, "api_calls").groupBy("call_id").agg(F.min("received_at").alias("received_at"))
    begun = c.agg(F.min(times.micros(F.col("ts")))).first()[0]
    late = times.seconds_between(F.col("ts"), F.col("received_at"))
    return c.join(got, "call_id").select(
        "call_id",
        times.stamp(F.col("ts")).alias("stamp"),
        F.round(late, 6).alias("latency"),
        times.display(late).alias("shown"),
        F.round(times.hours((times.micros(F.col("ts")) - F.lit(begun)) / 1e6), 6).alias("hours_in"),
    )
