"""Queries on schemas, files of records, carried columns, waveforms and token arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import arrays, audio, losses
from ..functions import scoring as sc
from ..functions import text as tx
from ..functions.keys import once
from ..operators import histogram as hg
from ..operators import joins, ordered, subsets
from ..operators.scorer import only_scored, score_batches
from ..schema import REFERENCE_TEXT, UNIFIED, ensure_column, keep_columns, rename_if_present, resolve_column, schema_gaps, tag
from ..sources import readers, writers
from ..sources.audio import decode_audio, encode_wav
from ..storage import place
from .curation import _ALL, _HREAL, _HSYN, _banded, _histograms, _three
from .registry import REAL, query, real, sql_words, synthetic, table
from .scores import COS, PAIRS, cosine_scorer, pairs

# --- reading and writing


@query("SELECT lower(trim(model)) AS subset, count(*) AS rows FROM unified WHERE lower(trim(model)) = 'synth-1' AND split = 'train' GROUP BY 1")
def named_subset(spark, folder):
    """One named subset and split of several saved together, read by partition."""
    path = place(spark, "subsets")
    u = table(spark, folder, "unified").where(F.col("split").isNotNull()).select("sample_index", "split", F.lower(F.trim("model")).alias("subset"))
    writers.save_splits(u, path, ("subset", "split"))
    return readers.load_table(spark, path, "synth-1", "train").groupBy("subset").agg(F.count("*").alias("rows"))


@query("SELECT split, count(*) AS rows FROM unified GROUP BY 1")
def fallback_source(spark, folder):
    """The first of several places that can be read."""
    u = readers.first_readable(spark, [f"{folder}/unified_of_another_version.parquet", f"{folder}/unified.parquet"])
    return u.groupBy("split").agg(F.count("*").alias("rows"))


@query("SELECT sample_index, text, voice FROM unified ORDER BY sample_index LIMIT 500")
def max_samples(spark, folder):
    """The first 500 rows."""
    return readers.first_rows(table(spark, folder, "unified"), "sample_index", 500).select("sample_index", "text", "voice")


@query("SELECT item_id, dataset, split, text FROM eval_items")
def record_array_round_trip(spark, folder):
    """A file with a JSON array of records."""
    path = place(spark, "records")
    writers.save_record_array(table(spark, folder, "eval_items"), path, ["item_id"])
    return readers.read_records(spark, path, "item_id bigint, dataset string, split string, text string")


@query("SELECT audio_id, text, voice, estimated_duration FROM synthetic_audio")
def record_lines_round_trip(spark, folder):
    """Records as JSON lines, UTF-8 as it is."""
    path = place(spark, "lines")
    writers.save_records(table(spark, folder, "synthetic_audio").select("audio_id", "text", "voice", "estimated_duration"), path)
    return readers.read_record_lines(spark, path, "audio_id bigint, text string, voice string, estimated_duration double")


@query("SELECT count(DISTINCT source) AS files, count(DISTINCT source) AS filled FROM mix_targets")
def listed_files(spark, folder):
    """A directory listing with sizes: one file a source, none of them empty; contents aren't read."""
    path = place(spark, "listed")
    table(spark, folder, "mix_targets").repartition("source").write.partitionBy("source").csv(path)
    listed = readers.list_files(spark, path, "*.csv").where(F.col("filename").endswith(".csv"))
    return listed.agg(F.count("*").alias("files"), F.count_if(F.col("file_size") > 0).alias("filled"))


@query("""SELECT wc, coalesce(r.n, 0) AS cv_train, coalesce(s.n, 0) AS synthetic FROM %s r FULL JOIN %s s USING (wc)""" % (_HREAL, _HSYN))
def histogram_csv(spark, folder):
    """Two histograms over the union of their keys as one sorted CSV file."""
    r, s = _histograms(spark, folder)
    path = place(spark, "histogram")
    both = hg.compare(r.withColumnRenamed("n", "cv_train"), s.withColumnRenamed("n", "synthetic"), want="cv_train", got="synthetic")
    writers.save_small_csv(both.select("wc", "cv_train", "synthetic"), path, ["wc"])
    return readers.read_csv(spark, path, "wc int, cv_train bigint, synthetic bigint")


@query("""SELECT '{"' || 'counts":{"rows":' || count(*) || ',"texts":' || count(text) || '},"votes":{"up":' || sum(up_votes) || ',"down":' || sum(down_votes) || '}}' AS json FROM unified""")
def nested_statistics(spark, folder):
    """Statistics as one nested JSON document."""
    one = table(spark, folder, "unified").agg(F.count("*").alias("rows"), F.count("text").alias("texts"), F.sum("up_votes").alias("up"), F.sum("down_votes").alias("down"))
    return writers.nested_json(one, {"counts": ["rows", "texts"], "votes": ["up", "down"]})


@query(f"""SELECT '# Subset' || chr(10) || 'subset: ' || subset || chr(10) || 'split: ' || split || chr(10) || 'rows: ' || count(*) AS card FROM ({_ALL}) GROUP BY subset, split""")
def subset_cards(spark, folder):
    counted = _three(spark, folder).groupBy("subset", "split").agg(F.count("*").alias("rows"))
    return writers.card(counted, "Subset", ["subset", "split", "rows"])


@query("SELECT * FROM (VALUES ('scores', true, 0), ('no rows', true, 0), ('broken', false, 1)) v(name, ok, failed)")
def publish_status(spark, folder):
    """Writes of which one fails; the rest go on."""
    s = table(spark, folder, "scores")
    path = place(spark, "published")

    def broken() -> None:
        raise OSError("full")

    done = writers.publish(
        {
            "scores": lambda: writers.save_records(s.select("sample_index", "model"), f"{path}/a"),
            "broken": broken,
            "no rows": lambda: writers.save_csv(s.where(F.lit(False)).select("model"), f"{path}/c"),
        }
    )
    return spark.createDataFrame([(n, ok, int(bool(e))) for n, ok, e in done], "name string, ok boolean, failed int")


@query("SELECT sample_index, split, text, CASE WHEN split = 'test' THEN 'new' ELSE 'old' END AS version FROM unified WHERE split IS NOT NULL")
def replaced_splits(spark, folder):
    """A saved table of which one split is written again; the others stay."""
    path = place(spark, "replaced")
    u = table(spark, folder, "unified").where(F.col("split").isNotNull()).select("sample_index", "split", "text")
    writers.save_splits(tag(u, "version", "old"), path)
    writers.replace_splits(tag(u.where("split = 'test'"), "version", "new"), path)
    return readers.load_table(spark, path).select("sample_index", "split", "text", "version")


@query("SELECT sample_index, scored_at, similarity FROM scores WHERE NOT isnan(similarity)")
def raw_scores(spark, folder):
    """Scores alone, saved and read again."""
    path = place(spark, "scores")
    s = table(spark, folder, "scores").where(F.col("similarity").isNotNull() & ~F.isnan("similarity")).select(F.struct("sample_index", "scored_at").alias("row"), "similarity")
    writers.save_scores(s, path, "row", "similarity")
    return spark.read.parquet(path).select("row.sample_index", "row.scored_at", "similarity")


@query("SELECT audio_id, coalesce(voice, 'any') AS voice, CAST(0.1 AS DOUBLE) AS temperature FROM synthetic_audio")
def setting_defaults(spark, folder):
    """Settings with defaults for null values and for a missing column."""
    a = table(spark, folder, "synthetic_audio")
    return a.select("audio_id", readers.setting(a, "voice", "any").alias("voice"), readers.setting(a, "temperature", 0.1).alias("temperature"))


# --- schemas


@query(f"""SELECT sample_index, text, client_id, 'common_voice' AS voice, 'common_voice_17' AS model, 'common_voice' AS dataset_source FROM {REAL}""")
def standard_real(spark, folder):
    """Real speech as delivered (transcripts under another name, extra columns) on the unified names."""
    raw = real(spark, folder).select("sample_index", "client_id", F.col("text").alias("translation"), F.lit("x").alias("segment"), F.lit("y").alias("path"))
    named = subsets.standardize_real(rename_if_present(raw, "translation", "sentence"))
    return keep_columns(named, ["sample_index", "text", "client_id"], ["voice", "model", "dataset_source", "segment"])


@query("SELECT doc_id, text AS transcript, 'unknown' AS accent FROM documents")
def resolved_text(spark, folder):
    """The transcript under the first name there is, and a field that must be there."""
    d = table(spark, folder, "documents")
    found = resolve_column(d, REFERENCE_TEXT)
    return ensure_column(d, "accent", "unknown").select("doc_id", F.col(found).alias("transcript"), "accent")


@query(f"""SELECT n AS name, CASE WHEN n IN (SELECT column_name FROM (DESCRIBE synthetic_audio)) THEN 'both' ELSE 'missing' END AS side FROM (SELECT unnest([{', '.join(f"'{n}'" for n, _, _ in UNIFIED)}]) AS n)
UNION ALL SELECT column_name, 'extra' FROM (DESCRIBE synthetic_audio) WHERE column_name NOT IN ({', '.join(f"'{n}'" for n, _, _ in UNIFIED)})""")
def schema_difference(spark, folder):
    """The unified columns against those of a table."""
    names = [n for n, _, _ in UNIFIED]
    have = table(spark, folder, "synthetic_audio").columns
    missing, extra = schema_gaps(names, have)
    rows = [(n, "missing") for n in missing] + [(n, "extra") for n in extra] + [(n, "both") for n in names if n in have]
    return spark.createDataFrame(rows, "name string, side string")


@query(f"""SELECT subset, split, count(*) AS num_samples, substr(coalesce(min_by(coalesce(text, '~null~'), sample_index), ''), 1, 100) || '...' AS sample_text, 16 + 1 AS columns, 4 * 3 AS checks_passed
FROM ({_ALL}) GROUP BY 1, 2""")
def built_subsets(spark, folder):
    """Three subsets built, checked, saved and summarised; four checks of each pass."""
    names = ("cv_only", "fully_synthetic", "high_quality_cv")
    made, checks = subsets.build_all(names, synthetic(spark, folder), real(spark, folder), _banded(spark, folder), place(spark, "built"))
    passed = sum(ok for _, _, ok, _ in checks)
    return made.select("subset", "split", "num_samples", "sample_text", F.size(F.split("features", ",")).alias("columns"), F.lit(passed).alias("checks_passed"))


# --- scoring and order


@query(f"SELECT vec_id, label, other_label, round((cos + 1) / 2, 6) AS similarity, 'scored' AS status FROM {PAIRS}")
def scored_records(spark, folder):
    """Scores beside all other columns of the records."""
    s = score_batches(pairs(spark, folder), cosine_scorer, ["embedding", "other"])
    return s.select("vec_id", "label", "other_label", F.round("similarity", 6).alias("similarity"), "status")


@query(f"""SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN NULL ELSE round((cos + 1) / 2, 6) END AS similarity,
CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 'no_input' ELSE 'scored' END AS status FROM {PAIRS}""")
def guarded_scores(spark, folder):
    """Null and empty waveforms never reach the scorer."""
    given = F.when(F.col("vec_id") % 7 != 0, F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 0)).otherwise(F.col("embedding")))
    s = score_batches(pairs(spark, folder).withColumn("embedding", given), cosine_scorer, ["embedding", "other"], carry=["vec_id"])
    return s.select("vec_id", F.round("similarity", 6).alias("similarity"), "status")


@query(f"SELECT vec_id, round((cos + 1) / 2, 6) AS similarity FROM {PAIRS} WHERE vec_id % 7 <> 0")
def scored_only(spark, folder):
    given = F.when(F.col("vec_id") % 7 != 0, F.col("embedding"))
    s = score_batches(pairs(spark, folder).withColumn("embedding", given), cosine_scorer, ["embedding", "other"], carry=["vec_id"])
    return only_scored(s).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT sample_index, scored_at, row_number() OVER (ORDER BY CASE WHEN NOT isnan(similarity) THEN similarity END DESC NULLS LAST, sample_index, scored_at) AS rank
FROM (SELECT DISTINCT sample_index, scored_at, similarity FROM scores)""")
def similarity_ranking(spark, folder):
    """Scored rows from the best down."""
    s = table(spark, folder, "scores").select("sample_index", "scored_at", "similarity").distinct()
    r = ordered.ranked(s.withColumn("row", F.struct("sample_index", "scored_at")), "similarity", "row")
    return r.select("sample_index", "scored_at", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT sample_index, row_number() OVER (ORDER BY sample_index) - 1 AS position FROM (SELECT sample_index FROM unified WHERE split = 'test' UNION ALL SELECT sample_index FROM unified WHERE split = 'validation')")
def concatenated_order(spark, folder):
    """Two splits after one another, brought into the order of their index."""
    u = table(spark, folder, "unified").select("sample_index", "split")
    both = u.where("split = 'test'").union(u.where("split = 'validation'"))
    return ordered.global_position(both, [F.col("sample_index")]).select("sample_index", "position")


@query("""WITH l AS (SELECT sample_index, row_number() OVER (ORDER BY scored_at, sample_index, similarity) - 1 AS at FROM scores WHERE similarity > 0.8 AND NOT isnan(similarity))
SELECT l.at, u.sample_index, u.text FROM l JOIN unified u USING (sample_index)""")
def select_listed(spark, folder):
    """Records in the order of a list of indices, repeated ones repeatedly."""
    s = table(spark, folder, "scores").where((F.col("similarity") > 0.8) & ~F.isnan("similarity"))
    u = table(spark, folder, "unified").select("sample_index", "text")
    return joins.select_in_order(u, s, "sample_index", ["scored_at", "sample_index", "similarity"]).select("at", "sample_index", "text")


@query("""SELECT call_id, rate_limited OR call_id % 5 = 0 AS limited FROM (SELECT call_id, any_value(rate_limited) AS rate_limited FROM api_calls GROUP BY 1)""")
def rate_limit_messages(spark, folder):
    """Which messages speak of a rate limit, in either spelling."""
    c = table(spark, folder, "api_calls").groupBy("call_id").agg(F.first("rate_limited").alias("r"))
    message = F.when(F.col("r"), "429: Rate Limit reached").when(F.col("call_id") % 5 == 0, "error=RATE_LIMIT_EXCEEDED").otherwise("timeout, limit 30 s")
    return c.select("call_id", tx.mentions_rate_limit(message).alias("limited"))


# --- vectors, tokens, waveforms


@query(f"""SELECT vec_id, round(abs({COS} - {COS.replace('a.', 'q.').replace('b.', 'r.')}), 9) AS difference,
CASE WHEN abs({COS} - {COS.replace('a.', 'q.').replace('b.', 'r.')}) < 0.001 THEN 'excellent' ELSE 'check' END AS verdict
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings q USING (vec_id) JOIN embeddings r ON r.vec_id = b.vec_id""".replace("SELECT vec_id", "SELECT a.vec_id").replace("q USING (vec_id)", "q ON q.vec_id = a.vec_id"))
def embedding_comparison(spark, folder):
    """Cosines of two computations of the same vectors, one of them scaled, with a verdict."""
    other = F.transform("embedding", lambda x: x.cast("double") * 3)
    p = pairs(spark, folder).select("vec_id", once(sc.cosine(F.col("embedding"), F.col("other")) - sc.cosine(other, F.col("other"))).alias("d"))
    return p.select("vec_id", F.abs(F.round("d", 9)).alias("difference"), sc.likeness(F.col("d")).alias("verdict"))


_TOKEN = "(SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)"


@query(f"""SELECT label, round(exp(-0.5) * avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS loss FROM (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 0.9 WHEN vec_id % 3 = 0 THEN 0.1 ELSE (vec_id % 10) / 10 END AS y FROM {_TOKEN}) GROUP BY 1""")
def weighted_alignment_loss(spark, folder):
    """Token losses of clean and corrupted texts under the uncertainty weight."""
    e = table(spark, folder, "embeddings")
    label = losses.alignment_label(F.col("vec_id") % 2 != 0, F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 10 / 10))
    t = e.select("label", label.alias("y"), F.explode("embedding").alias("x"))
    loss = losses.uncertainty_weight(F.lit(0.5)) * F.avg(losses.bce_with_logits(F.col("x").cast("double"), F.col("y")))
    return t.groupBy("label").agg(F.round(loss, 6).alias("loss"))


def _tokens_of_eight(spark, folder):
    """Each vector as eight token vectors of eight numbers."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    return table(spark, folder, "embeddings").select("vec_id", rows.alias("tokens"))


@query(f"""SELECT vec_id, CAST(i % 8 AS INTEGER) AS dim, round(sum(x) FILTER (i // 8 < 1 + vec_id % 8) / (1 + vec_id % 8), 6) AS mean_pooled,
round(sum(x * (i // 8 + 1)) / 36, 6) AS weighted FROM {_TOKEN} GROUP BY vec_id, i % 8""")
def pooled_tokens(spark, folder):
    """Token vectors of each row pooled by mask and by weights."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < 1 + F.col("vec_id") % 8, 1).otherwise(0))
    weights = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: i.cast("double"))
    p = _tokens_of_eight(spark, folder).select("vec_id", F.arrays_zip(sc.mean_pool(F.col("tokens"), mask).alias("m"), sc.weighted_pool(F.col("tokens"), weights).alias("w")).alias("z"))
    return p.select("vec_id", F.posexplode("z").alias("dim", "z")).select("vec_id", "dim", F.round("z.m", 6).alias("mean_pooled"), F.round("z.w", 6).alias("weighted"))


@query("""SELECT vec_id, CAST(sum(CASE WHEN i < 60 AND i % 3 <> 0 THEN x ELSE 0 END) AS DOUBLE) AS total, 80 AS width FROM
(SELECT vec_id, round(CAST(unnest(embedding) AS DOUBLE) * 1000) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1""")
def padded_masked(spark, folder):
    """Vectors filled up to 80 numbers; the mask keeps two of three among the first 60."""
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000))
    e = table(spark, folder, "embeddings").select("vec_id", arrays.pad_to(whole, 80, 0.0).alias("v"))
    kept = arrays.masked(F.col("v"), F.transform("v", lambda x, i: F.when((i < 60) & (i % 3 != 0), 1.0).otherwise(0.0)))
    return e.select("vec_id", F.aggregate(kept, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(kept).alias("width"))


@query(f"SELECT sample_index, w AS token, i AS at FROM (SELECT sample_index, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT sample_index, {sql_words('text')} AS w FROM unified)) WHERE i % 2 = 1")
def plain_tokens(spark, folder):
    """Tokens between markers with their scores; markers and masked tokens go."""
    w = tx.word_array(F.col("text"))
    u = table(spark, folder, "unified").select("sample_index", F.concat(F.array(F.lit("<s>")), w, F.array(F.lit("</s>"))).alias("t"))
    place_of = F.transform("t", lambda x, i: i.cast("bigint"))
    mask = F.transform("t", lambda x, i: F.when(i % 2 == 1, 1).otherwise(0))
    kept = u.select("sample_index", F.explode(arrays.clean_tokens(F.col("t"), place_of, mask)).alias("k"))
    return kept.select("sample_index", F.col("k.token").alias("token"), F.col("k.score").alias("at"))


@query("""SELECT vec_id, 16000 AS sampling_rate, CAST(len(embedding) AS INTEGER) AS samples, round(len(embedding) / 16000, 6) AS seconds,
round(list_sum(list_transform(embedding, lambda x: trunc(least(greatest(CAST(x AS DOUBLE), -1), 1) * 32767) / 32768)), 4) AS total FROM embeddings""")
def waveform_round_trip(spark, folder):
    """Vectors as audio files of 16-bit samples, decoded again."""

    def encode(batches):
        for b in batches:
            yield pd.DataFrame({"filename": b["vec_id"].astype(str), "content": [encode_wav(np.asarray(x), 16_000) for x in b["embedding"]]})

    files = table(spark, folder, "embeddings").select("vec_id", "embedding").mapInPandas(encode, "filename string, content binary")
    total = F.aggregate("array", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return decode_audio(files).select(
        F.col("filename").cast("bigint").alias("vec_id"), "sampling_rate", F.size("array").alias("samples"),
        F.round(audio.duration(F.col("array"), F.col("sampling_rate")), 6).alias("seconds"), F.round(total, 4).alias("total"),
    )


@query("""SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: trunc(least(greatest((CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE)) / 2, -1), 1) * 32767))) AS BIGINT) AS total
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def mono_samples(spark, folder):
    """Two channels as one, as 16-bit integers."""
    mixed = audio.to_int16(audio.mono(F.array("embedding", "other")))
    return pairs(spark, folder).select("vec_id", F.aggregate(mixed, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("""SELECT subset, '{' || string_agg('"' || split || '":' || n, ',' ORDER BY split) || '}' AS sizes FROM (SELECT subset, split, count(*) AS n FROM (%s) GROUP BY 1, 2) GROUP BY 1""" % _ALL)
def result_map(spark, folder):
    """Each subset's sizes as one map with sorted keys."""
    n = _three(spark, folder).groupBy("subset", "split").agg(F.count("*").alias("n")).groupBy("subset")
    return n.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n"))))).alias("sizes"))  # a row a split
