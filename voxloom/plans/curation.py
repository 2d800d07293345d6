"""Queries that validate, count, join and assemble records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.keys import source_key
from ..functions.scoring import band
from ..operators import histogram as hg
from ..operators import joins, report, subsets
from ..operators.ordered import batch_of
from ..schema import UNIFIED, conform
from .registry import REAL, SYNTHETIC, query, real, sql_key, sql_words, synthetic, table

# The voices of the synthesiser in their order of preference.
VOICES = ("amber", "cobalt", "dune", "fjord", "heron", "larch", "mistral", "quartz", "sable")
TARGET = 14

_WC = f"CAST(len({sql_words('text')}) AS INTEGER)"
_CHECKED = f"""(WITH c AS (SELECT sample_index, text, {sql_key('text')} AS k, CASE WHEN text IS NULL OR {sql_key('text')} = '' THEN 'format_error'
 WHEN len({sql_words('text')}) <> {TARGET} THEN 'wrong_word_count' END AS r FROM {SYNTHETIC}),
f AS (SELECT k, min(sample_index) AS first FROM c WHERE r IS NULL GROUP BY 1)
SELECT sample_index, text, coalesce(r, CASE WHEN sample_index > first THEN 'duplicate' END) AS reason FROM c LEFT JOIN f USING (k))"""


def _validated(spark, folder):
    return hg.validate(synthetic(spark, folder).withColumn("target_wc", F.lit(TARGET)), "text", "target_wc", "sample_index")


@query(f"SELECT sample_index, reason FROM {_CHECKED}")
def candidate_validation(spark, folder):
    return _validated(spark, folder).select("sample_index", "reason")


@query(f"""SELECT sample_index // 100 AS batch, count(*) FILTER (reason = 'format_error') AS format_errors, count(*) FILTER (reason = 'wrong_word_count') AS wrong_word_counts,
count(*) FILTER (reason = 'duplicate') AS duplicates, count(*) FILTER (reason IS NULL) AS accepted,
array_to_string(list_slice(list(substr(text, 1, 20) ORDER BY sample_index) FILTER (reason = 'wrong_word_count'), 1, 3), ' | ') AS examples FROM {_CHECKED} GROUP BY 1""")
def error_report(spark, folder):
    """Per batch of 100 arrivals the refusals by reason, with three examples."""
    v = _validated(spark, folder).withColumn("batch", batch_of(F.col("sample_index"), 100))
    wrong = F.when(F.col("reason") == "wrong_word_count", F.struct(F.col("sample_index").alias("i"), F.substring("text", 1, 20).alias("t")))
    counted = v.groupBy("batch").agg(
        F.count_if(F.col("reason") == "format_error").alias("format_errors"),
        F.count_if(F.col("reason") == "wrong_word_count").alias("wrong_word_counts"),
        F.count_if(F.col("reason") == "duplicate").alias("duplicates"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.slice(F.array_sort(F.collect_list(wrong)), 1, 3).alias("e"),  # a batch is 100 rows
    )
    shown = F.when(F.size("e") > 0, F.array_join(F.transform("e", lambda x: x["t"]), " | "))
    return counted.select("*", shown.alias("examples")).drop("e")


@query(f"""SELECT batch, nullif(concat_ws('; ', CASE WHEN f > 0 THEN f || ' malformed' END, CASE WHEN w > 0 THEN w || ' of wrong length' END, CASE WHEN d > 0 THEN d || ' repeated' END), '') AS note
FROM (SELECT sample_index // 100 AS batch, count(*) FILTER (reason = 'format_error') AS f, count(*) FILTER (reason = 'wrong_word_count') AS w, count(*) FILTER (reason = 'duplicate') AS d FROM {_CHECKED} GROUP BY 1)""")
def correction_notes(spark, folder):
    v = error_report(spark, folder)
    parts = [("malformed", F.col("format_errors")), ("of wrong length", F.col("wrong_word_counts")), ("repeated", F.col("duplicates"))]
    note = tx.correction_note(parts)
    return v.select("batch", F.when(note != "", note).alias("note"))


@query(f"""WITH a AS (SELECT sample_index, {_WC} AS wc FROM {SYNTHETIC} WHERE text IS NOT NULL),
d AS (SELECT s.sample_index, {_WC.replace('text', 's.text')} AS wc, {sql_key('s.text')} AS k FROM {SYNTHETIC} s WHERE s.text IS NOT NULL),
u AS (SELECT min(sample_index) AS sample_index, wc FROM d GROUP BY k, wc),
q AS (SELECT wc, CAST(ceil(count(*) * 0.05) AS BIGINT) AS quota FROM (SELECT {_WC} AS wc FROM {REAL} WHERE text IS NOT NULL) GROUP BY 1)
SELECT sample_index, wc FROM (SELECT u.*, q.quota, row_number() OVER (PARTITION BY u.wc ORDER BY u.sample_index) AS rn FROM u JOIN q USING (wc)) WHERE rn <= quota""")
def quota_select(spark, folder):
    """First occurrences of synthetic sentences, up to a twentieth of the real word-count histogram."""
    s = synthetic(spark, folder).where(F.col("text").isNotNull())
    keyed = s.select("sample_index", tx.word_count(F.col("text")).alias("wc"), tx.norm_key(F.col("text")).alias("k"))
    unique = keyed.groupBy("k", "wc").agg(F.min("sample_index").alias("sample_index"))
    quotas = hg.scaled_target(hg.histogram(real(spark, folder), tx.word_count(F.col("text"))), 0.05, out="quota")
    return hg.within_quota(unique, "wc", "sample_index", quotas).select("sample_index", "wc")


_HREAL = f"(SELECT {_WC} AS wc, count(*) AS n FROM {REAL} WHERE text IS NOT NULL GROUP BY 1)"
_HSYN = f"(SELECT {_WC} AS wc, count(*) AS n FROM {SYNTHETIC} WHERE text IS NOT NULL GROUP BY 1)"


def _histograms(spark, folder):
    wc = tx.word_count(F.col("text"))
    return hg.histogram(real(spark, folder), wc), hg.histogram(synthetic(spark, folder), wc)


@query(f"SELECT wc, n, CAST(ceil(n * 1.5) AS BIGINT) AS target FROM {_HREAL}")
def wc_histogram(spark, folder):
    return hg.scaled_target(_histograms(spark, folder)[0], 1.5)


@query(f"""SELECT wc, coalesce(r.n, 0) AS target, coalesce(s.n, 0) AS generated, CASE WHEN r.n > 0 THEN round(coalesce(s.n, 0) / r.n * 100, 6) ELSE 0.0 END AS pct,
coalesce(r.n, 0) - coalesce(s.n, 0) AS difference FROM {_HREAL} r FULL JOIN {_HSYN} s USING (wc)""")
def histogram_compare(spark, folder):
    r, s = _histograms(spark, folder)
    return hg.compare(r.withColumnRenamed("n", "target"), s.withColumnRenamed("n", "generated")).withColumn("pct", F.round("pct", 6))


@query(f"""SELECT round(coalesce(sum(sqrt(r.n * s.n)), 0) / sqrt((SELECT sum(n) FROM {_HREAL}) * (SELECT sum(n) FROM {_HSYN})), 6) AS coefficient
FROM {_HREAL} r JOIN {_HSYN} s USING (wc)""")
def bhattacharyya(spark, folder):
    return hg.bhattacharyya(*_histograms(spark, folder)).withColumn("coefficient", F.round("coefficient", 6))


@query(f"""SELECT wc, coalesce(r.n, 0) AS target, CASE WHEN r.n > 0 THEN round(coalesce(s.n, 0) / r.n * 100, 6) ELSE 0.0 END AS pct,
CASE WHEN coalesce(s.n, 0) >= r.n THEN 'done' WHEN s.n > 0 THEN 'running' ELSE 'waiting' END AS status,
repeat('#', CAST(floor(least(coalesce(s.n, 0) / r.n, 1) * 40) AS INTEGER)) || repeat('-', 40 - CAST(floor(least(coalesce(s.n, 0) / r.n, 1) * 40) AS INTEGER)) AS bar
FROM {_HREAL} r LEFT JOIN {_HSYN} s USING (wc) ORDER BY target DESC, wc LIMIT 10""")
def top_buckets(spark, folder):
    r, s = _histograms(spark, folder)
    c = hg.compare(r.withColumnRenamed("n", "target"), s.withColumnRenamed("n", "generated")).orderBy(F.desc("target"), "wc").limit(10)
    status = F.when(F.col("generated") >= F.col("target"), "done").when(F.col("generated") > 0, "running").otherwise("waiting")
    return c.select("wc", "target", F.round("pct", 6).alias("pct"), status.alias("status"), tx.progress_bar(F.col("generated") / F.col("target")).alias("bar"))


@query("SELECT lower(trim(dataset_source)) AS source, count(*) AS n FROM unified GROUP BY 1")
def source_counts(spark, folder):
    return table(spark, folder, "unified").groupBy(source_key(F.col("dataset_source")).alias("source")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN len(p) >= 3 THEN split_part(p[3], '.', 1) END AS voice, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes
FROM (SELECT file_size, string_split(filename, '_') AS p FROM audio_files) GROUP BY 1""")
def voice_counts(spark, folder):
    return joins.file_inventory(table(spark, folder, "audio_files")).groupBy("voice").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


_RKEYS = f"(SELECT DISTINCT {sql_key('text')} AS k FROM {REAL} WHERE text <> '')"


@query(f"SELECT sample_index FROM {SYNTHETIC} WHERE text <> '' AND {sql_key('text')} IN (SELECT k FROM {_RKEYS})")
def text_match_semi(spark, folder):
    return joins.match_text(synthetic(spark, folder), real(spark, folder), "text").select("sample_index")


@query(f"SELECT sample_index FROM {SYNTHETIC} WHERE text IS NULL OR text = '' OR {sql_key('text')} NOT IN (SELECT k FROM {_RKEYS})")
def text_match_anti(spark, folder):
    return joins.match_text(synthetic(spark, folder), real(spark, folder), "text", keep="unmatched").select("sample_index")


@query(f"""WITH f AS (SELECT text, coalesce(text <> '' AND {sql_key('text')} IN (SELECT k FROM {_RKEYS}), false) AS hit FROM {SYNTHETIC})
SELECT count(*) AS rows, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS excluded, round(count(*) FILTER (hit) / count(*) * 100, 6) AS rate,
count(DISTINCT CASE WHEN hit THEN text END) AS distinct_matched FROM f""")
def match_stats(spark, folder):
    return joins.match_statistics(synthetic(spark, folder), real(spark, folder), "text").withColumn("rate", F.round("rate", 6))


@query(f"""SELECT text, count(*) AS n FROM {SYNTHETIC} WHERE text <> '' AND {sql_key('text')} IN (SELECT k FROM {_RKEYS}) GROUP BY 1 ORDER BY n DESC, text LIMIT 10""")
def top_matched(spark, folder):
    m = joins.match_text(synthetic(spark, folder), real(spark, folder), "text")
    return m.groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(10)


@query("""WITH l AS (SELECT text, arg_max(audio, audio_id) AS a, max_by(coalesce(audio, '-'), audio_id) AS a0, max_by(generation_status, audio_id) AS s FROM synthetic_audio WHERE text IS NOT NULL GROUP BY 1)
SELECT u.sample_index, CASE WHEN l.a0 = '-' THEN NULL ELSE l.a0 END AS audio, CASE WHEN l.text IS NULL THEN 'failed' ELSE l.s END AS generation_status FROM unified u LEFT JOIN l ON l.text = u.text""")
def attach_audio(spark, folder):
    """The last synthesis of each text; 'failed' where there is none."""
    a = table(spark, folder, "synthetic_audio").select("text", "audio_id", "audio", "generation_status")
    u = table(spark, folder, "unified").select("sample_index", "text")
    return joins.attach_last(u, a, "text", "audio_id", ["audio", "generation_status"], {"generation_status": "failed"}).drop("text")


_VALUES = ", ".join(f"({i}, '{v}')" for i, v in enumerate(VOICES))


@query(f"""WITH n AS (SELECT s.audio_id, v.i, v.v AS voice, 'audio_' || substr(md5(s.text || '_' || v.v || '_' || s.model), 1, 12) || '_' || v.v || '.mp3' AS filename
 FROM synthetic_audio s, (VALUES {_VALUES}) v(i, v)),
f AS (SELECT filename, max(file_size) AS file_size FROM audio_files GROUP BY 1),
m AS (SELECT n.audio_id, n.voice, n.filename, f.file_size, row_number() OVER (PARTITION BY audio_id ORDER BY i) AS rn FROM n JOIN f USING (filename))
SELECT s.audio_id, m.filename, m.voice, m.file_size FROM synthetic_audio s LEFT JOIN m ON m.audio_id = s.audio_id AND m.rn = 1""")
def locate_audio(spark, folder):
    return joins.locate_audio(table(spark, folder, "synthetic_audio"), table(spark, folder, "audio_files"), VOICES, "audio_id", "text", "model")


_EXPECTED = "'audio_' || substr(md5(text || '_' || voice || '_' || model), 1, 12) || '_' || voice || '.mp3'"


@query(f"SELECT filename, file_size FROM audio_files WHERE filename NOT IN (SELECT {_EXPECTED} FROM synthetic_audio WHERE {_EXPECTED} IS NOT NULL)")
def orphan_files(spark, folder):
    return joins.orphans(table(spark, folder, "audio_files"), table(spark, folder, "synthetic_audio"), "text", "voice", "model")


_INTEGRITY = f"""(SELECT s.audio_id, {_EXPECTED} AS expected, s.audio AS stored, CASE WHEN audio IS NULL OR audio = '' THEN 'no_audio'
WHEN {_EXPECTED} IS NULL OR {_EXPECTED} <> audio THEN 'mismatch' WHEN f.filename IS NULL THEN 'not_found' ELSE 'correct' END AS verdict
FROM synthetic_audio s LEFT JOIN (SELECT DISTINCT filename FROM audio_files) f ON f.filename = s.audio)"""


@query(f"SELECT * FROM {_INTEGRITY}")
def integrity_report(spark, folder):
    return joins.integrity(table(spark, folder, "synthetic_audio"), table(spark, folder, "audio_files"), "audio_id", "text", "voice", "model", "audio")


@query(f"SELECT verdict, count(*) AS rows FROM {_INTEGRITY} GROUP BY 1")
def integrity_summary(spark, folder):
    return integrity_report(spark, folder).groupBy("verdict").agg(F.count("*").alias("rows"))


@query("SELECT sample_index, text, voice FROM unified WHERE sample_index IN (SELECT sample_index FROM scores WHERE similarity > 0.8 AND NOT isnan(similarity))")
def select_by_index(spark, folder):
    s = table(spark, folder, "scores").where((F.col("similarity") > 0.8) & ~F.isnan("similarity"))
    return joins.select_by_index(table(spark, folder, "unified"), s, "sample_index").select("sample_index", "text", "voice")


@query(f"SELECT count(*) AS rows, count(*) FILTER (sample_index NOT IN (SELECT sample_index FROM scores)) AS unscored FROM {SYNTHETIC}")
def unscored_rows(spark, folder):
    s = synthetic(spark, folder)
    scored = table(spark, folder, "scores").select("sample_index", F.lit(1).alias("hit")).distinct()
    return s.join(scored, "sample_index", "left").agg(F.count("*").alias("rows"), F.count_if(F.col("hit").isNull()).alias("unscored"))


_DEFAULTS = ", ".join(
    {"voice": "voice", "text": "text", "model": "model", "generation_status": "generation_status"}.get(n, f"CAST('{d}' AS {t.replace('string', 'VARCHAR')}) AS {n}")
    for n, t, d in UNIFIED
)


@query(f"SELECT audio_id, {_DEFAULTS} FROM synthetic_audio")
def conform_defaults(spark, folder):
    """A partial relation on the unified schema: missing columns get defaults, nulls stay."""
    return conform(table(spark, folder, "synthetic_audio").select("audio_id", "text", "voice", "model", "generation_status"), ("audio_id",))


def _banded(spark, folder):
    latest = table(spark, folder, "scores").groupBy("sample_index").agg(F.max_by("similarity", "scored_at").alias("s"))
    return synthetic(spark, folder).join(latest.select("sample_index", band(F.col("s")).alias("band")), "sample_index")


_COLS = ", ".join(n for n, _, _ in UNIFIED)
_BANDED = f"""(SELECT u.*, CASE WHEN s > 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' WHEN s < 0.5 THEN 'low' END AS band FROM {SYNTHETIC} u
JOIN (SELECT sample_index, CASE WHEN isnan(s) THEN NULL ELSE s END AS s FROM (SELECT sample_index, max_by(coalesce(similarity, 'nan'), scored_at) AS s FROM scores GROUP BY 1)) USING (sample_index))"""
_TRAIN = {
    "syn": f"SELECT sample_index, {_COLS}, 'train' AS split FROM {SYNTHETIC}",
    "good": f"SELECT sample_index, {_COLS}, 'train' AS split FROM {_BANDED} WHERE band IN ('high', 'medium')",
    "best": f"SELECT sample_index, {_COLS}, 'train' AS split FROM {_BANDED} WHERE band = 'high'",
    "real": f"SELECT sample_index, {_COLS}, 'train' AS split FROM {REAL} WHERE split = 'train'",
    "held": f"SELECT sample_index, {_COLS}, split FROM {REAL} WHERE split IN ('validation', 'test')",
}


def _subset_sql(name: str, *parts: str) -> str:
    return f"SELECT *, '{name}' AS subset FROM ({' UNION ALL '.join(_TRAIN[p] for p in (*parts, 'held'))})"


def _subset(name, spark, folder):
    return subsets.build_subset(name, synthetic(spark, folder), real(spark, folder), _banded(spark, folder))


@query(_subset_sql("fully_synthetic", "syn"))
def subset_fully_synthetic(spark, folder):
    return _subset("fully_synthetic", spark, folder)


@query(_subset_sql("mixed_cv_synthetic", "good", "real"))
def subset_mixed_cv_synthetic(spark, folder):
    return _subset("mixed_cv_synthetic", spark, folder)


@query(_subset_sql("cv_only", "real"))
def subset_cv_only(spark, folder):
    return _subset("cv_only", spark, folder)


@query(_subset_sql("high_quality_cv", "best", "real"))
def subset_high_quality_cv(spark, folder):
    return _subset("high_quality_cv", spark, folder)


@query(_subset_sql("cv_fully_synthetic", "real", "syn"))
def subset_cv_fully_synthetic(spark, folder):
    return _subset("cv_fully_synthetic", spark, folder)


@query(_subset_sql("mixed_cv_synthetic_all", "syn", "real"))
def subset_mixed_cv_synthetic_all(spark, folder):
    return _subset("mixed_cv_synthetic_all", spark, folder)


@query(f"""SELECT sample_index, audio, text AS sentence, 'synthetic_matched' AS source, 'train' AS split FROM {SYNTHETIC} WHERE text <> '' AND {sql_key('text')} IN (SELECT k FROM {_RKEYS})
UNION ALL SELECT sample_index, audio, text, 'common_voice', split FROM {REAL} WHERE split IN ('train', 'validation', 'test')""")
def subset_text_matched(spark, folder):
    return subsets.text_matched(synthetic(spark, folder), real(spark, folder))


_TAGGED = ", ".join("'{0}' AS dataset_source" if n == "dataset_source" else n for n, _, _ in UNIFIED)


@query(f"""SELECT sample_index, {_TAGGED.format('synthetic')}, 'train' AS split FROM {SYNTHETIC}
UNION ALL SELECT sample_index, {_TAGGED.format('common_voice')}, split FROM {REAL} WHERE split IN ('validation', 'test')""")
def subset_default_mixed(spark, folder):
    return subsets.default_mixed(synthetic(spark, folder), real(spark, folder))


_ALL = " UNION ALL ".join(
    f"SELECT '{n}' AS subset, split, text, sample_index FROM ({_subset_sql(n, *p)})"
    for n, p in (("cv_only", ("real",)), ("fully_synthetic", ("syn",)), ("high_quality_cv", ("best", "real")))
)


def _three(spark, folder):
    names = ("cv_only", "fully_synthetic", "high_quality_cv")
    out = None
    for n in names:
        part = _subset(n, spark, folder)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT subset, split, count(*) AS rows FROM ({_ALL}) GROUP BY ROLLUP (subset, split)")
def subset_counts(spark, folder):
    return subsets.subset_counts(_three(spark, folder).select("subset", "split"))


@query(f"""SELECT subset, split, count(*) AS num_samples, substr(coalesce(min_by(coalesce(text, '~null~'), sample_index), ''), 1, 100) || '...' AS sample_text FROM ({_ALL}) GROUP BY 1, 2""")
def subset_summary(spark, folder):
    return subsets.summary(_three(spark, folder)).drop("features")


@query(f"""WITH c AS (SELECT subset, count(*) AS total, count(*) FILTER (split = 'train') AS filtered, count(*) FILTER (text IS NULL OR {sql_key('text')} = '') AS blank_texts FROM ({_ALL}) GROUP BY 1)
SELECT *, concat_ws('; ', CASE WHEN total = 0 THEN 'empty' END, CASE WHEN filtered < total * 0.5 THEN 'filtered below half of total' END, CASE WHEN blank_texts > 0 THEN 'blank texts' END) AS issues FROM c""")
def subset_health(spark, folder):
    blank = F.col("text").isNull() | (tx.norm_key(F.col("text")) == "")
    c = _three(spark, folder).groupBy("subset").agg(
        F.count("*").alias("total"), F.count_if(F.col("split") == "train").alias("filtered"), F.count_if(blank).alias("blank_texts")
    )
    return report.subset_health(c)


@query(f"""SELECT s.audio_id, {_EXPECTED} AS filename, CASE WHEN {_EXPECTED} IS NULL THEN 'no_name' WHEN f.filename IS NULL THEN 'to_generate' ELSE 'cached' END AS status
FROM synthetic_audio s LEFT JOIN (SELECT DISTINCT filename FROM audio_files WHERE file_size > 0) f ON f.filename = {_EXPECTED}""")
def generation_plan(spark, folder):
    """What is there already under the name of its content, and what is still to be made."""
    return joins.generation_plan(table(spark, folder, "synthetic_audio"), table(spark, folder, "audio_files"), "audio_id", "text", "voice", "model")


@query(f"""SELECT subset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM ({_ALL}) GROUP BY 1""")
def subset_sizes(spark, folder):
    """Planned sizes of the subsets, a column a split."""
    wide = _three(spark, folder).groupBy("subset").pivot("split", ["train", "validation", "test"]).agg(F.count(F.lit(1)))
    sizes = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("train", "validation", "test")]
    return wide.select("subset", *sizes).withColumn("total", F.col("train") + F.col("validation") + F.col("test"))


@query(f"""SELECT sample_index, text FROM unified WHERE text IS NOT NULL AND sample_index IN (SELECT sample_index FROM {SYNTHETIC})
EXCEPT ALL SELECT sample_index, text FROM {_BANDED} WHERE band = 'high'""")
def not_high_quality(spark, folder):
    """Set difference of the synthetic rows and those of high quality."""
    s = synthetic(spark, folder).where(F.col("text").isNotNull()).select("sample_index", "text")
    return s.exceptAll(_banded(spark, folder).where(F.col("band") == "high").select("sample_index", "text"))


@query(f"SELECT {sql_key('text')} AS norm_key FROM {SYNTHETIC} WHERE text <> '' INTERSECT SELECT {sql_key('text')} FROM {REAL} WHERE text <> ''")
def shared_keys(spark, folder):
    """Keys that synthetic and real texts have in common."""
    def keys(df):
        return df.where(F.col("text") != "").select(tx.norm_key(F.col("text")).alias("norm_key"))

    return keys(synthetic(spark, folder)).intersect(keys(real(spark, folder)))
