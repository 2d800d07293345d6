"""Queries on transcript text, names and serialised fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.readers import sentences_of_response
from .registry import query, sql_key, sql_words, table


@query("""
WITH q AS (SELECT audio_id, CASE WHEN generation_status = 'cached' THEN '"' || text || '"' ELSE text END AS t FROM synthetic_audio),
s AS (SELECT audio_id, CASE WHEN starts_with(t, '"') AND ends_with(t, '"') AND length(t) >= 2 THEN substr(t, 2, length(t) - 2) ELSE t END AS t FROM q)
SELECT audio_id, CASE WHEN t = '' OR right(t, 1) IN ('.', '?', '!') THEN t ELSE t || '.' END AS normalized FROM s""")
def transcript_normalize(spark, folder):
    t = F.when(F.col("generation_status") == "cached", F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.col("text"))
    return table(spark, folder, "synthetic_audio").select("audio_id", tx.normalize_transcript(t).alias("normalized"))


@query(f"SELECT {sql_key('text')} AS norm_key, count(*) AS copies FROM unified WHERE text IS NOT NULL GROUP BY 1")
def norm_key_dedupe(spark, folder):
    return table(spark, folder, "unified").where(F.col("text").isNotNull()).groupBy(tx.norm_key(F.col("text")).alias("norm_key")).agg(F.count("*").alias("copies"))


@query(f"SELECT CAST(count(DISTINCT {sql_key('text')}) AS BIGINT) AS distinct_sentences FROM unified")
def distinct_sentences(spark, folder):
    return table(spark, folder, "unified").agg(F.count_distinct(tx.norm_key(F.col("text"))).alias("distinct_sentences"))


@query(f"SELECT sample_index, CAST(len({sql_words('text')}) AS INTEGER) AS wc, CAST(length(text) AS INTEGER) AS chars FROM unified")
def word_count(spark, folder):
    return table(spark, folder, "unified").select("sample_index", tx.word_count(F.col("text")).alias("wc"), F.length("text").alias("chars"))


@query("""SELECT audio_id, 'audio_' || substr(md5(text || '_' || voice || '_' || model), 1, 12) || '_' || voice || '.mp3' AS filename
FROM synthetic_audio""")
def audio_filename(spark, folder):
    name = tx.audio_filename(F.col("text"), F.col("voice"), F.col("model"))
    return table(spark, folder, "synthetic_audio").select("audio_id", name.alias("filename"))


@query("""
SELECT filename, CASE WHEN len(p) >= 3 THEN p[2] END AS content_hash, CASE WHEN len(p) >= 3 THEN split_part(p[3], '.', 1) END AS voice
FROM (SELECT filename, string_split(filename, '_') AS p FROM audio_files)""")
def filename_parse(spark, folder):
    name = F.col("filename")
    return table(spark, folder, "audio_files").select(
        "filename", tx.filename_hash(name).alias("content_hash"), tx.filename_voice(name).alias("voice")
    )


@query("""SELECT sample_index, regexp_extract(audio, '([^/]*)$', 1) AS base,
lower(regexp_extract(regexp_extract(audio, '([^/]*)$', 1), '(\\.[^.]+)$', 1)) AS ext FROM unified""")
def basename_extension(spark, folder):
    a = F.col("audio")
    return table(spark, folder, "unified").select("sample_index", tx.basename(a).alias("base"), tx.extension(a).alias("ext"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def text_preview(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1")
def props_json(spark, folder):
    k = F.from_json("props", "k bigint").getField("k")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"))


@query("""
WITH j AS (SELECT record_id, CASE WHEN json_valid(text) THEN text END AS t FROM raw_records)
SELECT record_id, json_extract_string(t, '$.voice') AS voice, json_extract_string(t, '$.locale') AS locale,
CAST(json_extract_string(t, '$.up_votes') AS BIGINT) AS up_votes FROM j""")
def json_records(spark, folder):
    parsed = F.from_json("text", "voice string, locale string, up_votes bigint")
    return table(spark, folder, "raw_records").select("record_id", parsed.alias("j")).select("record_id", "j.*")


@query("""SELECT item_id, CAST(len(w) AS INTEGER) AS sentences, w[1] AS first_sentence FROM (
SELECT item_id, from_json(to_json(string_split(text, '. ')), '["VARCHAR"]') AS w FROM eval_items)""")
def response_sentences(spark, folder):
    response = F.to_json(F.split("text", r"\. "))
    got = table(spark, folder, "eval_items").select("item_id", sentences_of_response(response).alias("w"))
    return got.select("item_id", F.size("w").alias("sentences"), F.try_element_at("w", F.lit(1)).alias("first_sentence"))


@query("""SELECT generation_status, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) * 0.1 / 3600, 6) AS rough_hours,
round(sum(estimated_duration) / 3600, 6) AS hours FROM synthetic_audio GROUP BY 1""")
def corpus_totals(spark, folder):
    chars = F.sum(F.length("text"))
    return table(spark, folder, "synthetic_audio").groupBy("generation_status").agg(
        chars.alias("chars"), F.round(chars * 0.1 / 3600, 6).alias("rough_hours"), F.round(F.sum("estimated_duration") / 3600, 6).alias("hours")
    )


@query(f"SELECT w AS token, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS w FROM unified) GROUP BY 1")
def token_frequency(spark, folder):
    return table(spark, folder, "unified").select(F.explode(tx.word_array(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""SELECT w AS token, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS w FROM unified)
GROUP BY 1 ORDER BY n DESC, token LIMIT 10""")
def ban_list_topk(spark, folder):
    return token_frequency(spark, folder).orderBy(F.desc("n"), "token").limit(10)


@query(f"""WITH top AS (SELECT w AS token, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS w FROM unified)
GROUP BY 1 ORDER BY n DESC, token LIMIT 10)
SELECT 'Avoid: ' || string_agg(token, ', ' ORDER BY n DESC, token) AS prompt FROM top""")
def ban_list_prompt(spark, folder):
    top = ban_list_topk(spark, folder).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "token"))).alias("top"))
    return top.select(F.concat(F.lit("Avoid: "), F.array_join(F.transform("top", lambda x: x["token"]), ", ")).alias("prompt"))
