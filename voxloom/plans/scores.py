"""Queries on similarity scores and embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import losses
from ..functions import scoring as sc
from ..functions.keys import once
from ..operators import report
from ..operators.scorer import filter_by_score, pool_groups, score_batches, verify
from .registry import SETTINGS, query, table


def pairs(spark, folder):
    """Adjacent embeddings: a text vector and the audio vector scored with it."""
    e = table(spark, folder, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    return e.join(b, "vec_id")


def negatives(spark, folder):
    """Each pair with a third vector, two ids on, as the corrupted text's."""
    c = table(spark, folder, "embeddings").select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("third"))
    return pairs(spark, folder).join(c, "vec_id")


def prob():
    return sc.readable(sc.cosine(F.col("embedding"), F.col("other")), "prob", SETTINGS.temperature)


COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"
PAIRS = f"(SELECT a.vec_id, a.label, b.label AS other_label, {COS} AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"""
WITH p AS (SELECT 1 / (1 + exp(-cos / 0.1)) AS s FROM {PAIRS})
SELECT count(*) AS total_samples, count(*) FILTER (s >= 0.8) AS filtered_samples, round(count(*) FILTER (s >= 0.8) / count(*) * 100, 6) AS filtered_percentage,
CAST(0.8 AS DOUBLE) AS threshold, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max,
count(*) FILTER (s >= 0.8) AS high_quality, count(*) FILTER (s >= 0.5 AND s < 0.8) AS medium_quality, count(*) FILTER (s < 0.5) AS low_quality FROM p""")
def quality_filter_stats(spark, folder):
    """The flagship: score pairs, filter and summarise in one pass."""
    stats = report.filter_statistics(pairs(spark, folder), prob(), SETTINGS.threshold)
    return stats.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in stats.dtypes])


@query(f"SELECT vec_id, round(1 / (1 + exp(-cos / 0.1)), 6) AS score FROM {PAIRS} WHERE 1 / (1 + exp(-cos / 0.1)) >= 0.8")
def threshold_filter(spark, folder):
    return filter_by_score(pairs(spark, folder).select("vec_id", once(prob()).alias("score")), F.col("score")).withColumn("score", F.round("score", 6))


@query(f"""SELECT vec_id, round(cos, 6) AS cos, round((cos + 1) / 2, 6) AS unit, round(1 / (1 + exp(-cos / 0.1)), 6) AS prob,
round(least(greatest((0.1 * ln((1 / (1 + exp(-cos / 0.1))) / (1 - 1 / (1 + exp(-cos / 0.1)))) + 1) / 2, 0), 1), 6) AS back FROM {PAIRS}""")
def score_scales(spark, folder):
    p = pairs(spark, folder).select("vec_id", once(sc.cosine(F.col("embedding"), F.col("other"))).alias("c"))
    q = sc.readable(F.col("c"), "prob")
    return p.select(
        "vec_id", F.round("c", 6).alias("cos"), F.round(sc.readable(F.col("c")), 6).alias("unit"), F.round(q, 6).alias("prob"),
        F.round(sc.unit_from_probability(q), 6).alias("back"),
    )


@query("""
WITH t AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT vec_id, round(avg(1 / (1 + exp(-CAST(x AS DOUBLE)))) FILTER (i < 8 + vec_id % 56), 6) AS alignment,
round(avg(CAST(x AS DOUBLE)) FILTER (i < 8 + vec_id % 56), 6) AS raw_alignment FROM t GROUP BY vec_id""")
def masked_alignment_mean(spark, folder):
    """Token scores of ragged length: the mask keeps the first 8 to 63 of each vector."""
    e = table(spark, folder, "embeddings")
    mask = F.transform("embedding", lambda x, i: F.when(i < 8 + F.col("vec_id") % 56, 1).otherwise(0))
    return e.select(
        "vec_id",
        F.round(sc.masked_mean(F.col("embedding"), mask), 6).alias("alignment"),
        F.round(sc.masked_mean(F.col("embedding"), mask, logistic=False), 6).alias("raw_alignment"),
    )


_VALID = "CASE WHEN NOT isnan(similarity) THEN similarity END"


@query(f"""SELECT sample_index, scored_at, coalesce(({_VALID} + alignment_score) / 2, {_VALID}) AS quality FROM scores""")
def quality_score(spark, folder):
    s = sc.nan_to_null(F.col("similarity"))
    return table(spark, folder, "scores").select("sample_index", "scored_at", sc.quality(s, F.col("alignment_score")).alias("quality"))


def _band_sql(top: str) -> str:
    return f"""WITH s AS (SELECT {_VALID} AS s FROM scores), b AS (SELECT CASE WHEN s {top} 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' WHEN s < 0.5 THEN 'low' END AS band FROM s),
n AS (SELECT band, count(*) AS rows FROM b WHERE band IS NOT NULL GROUP BY 1)
SELECT v.band, coalesce(n.rows, 0) AS rows, round(coalesce(n.rows, 0) / (SELECT sum(rows) FROM n) * 100, 6) AS pct
FROM (VALUES ('high'), ('medium'), ('low')) v(band) LEFT JOIN n USING (band)"""


@query(_band_sql(">"))
def band_strict(spark, folder):
    return report.band_distribution(table(spark, folder, "scores"), F.col("similarity")).withColumn("pct", F.round("pct", 6))


@query(_band_sql(">="))
def band_inclusive(spark, folder):
    return report.band_distribution(table(spark, folder, "scores"), F.col("similarity"), True).withColumn("pct", F.round("pct", 6))


@query("""SELECT sample_index, scored_at, similarity, CASE WHEN similarity < 0.3 THEN 'low' ELSE 'high' END AS outlier FROM scores
WHERE NOT isnan(similarity) AND (similarity < 0.3 OR similarity > 0.95)""")
def outliers(spark, folder):
    o = table(spark, folder, "scores").select("sample_index", "scored_at", "similarity", sc.outlier(F.col("similarity")).alias("outlier"))
    return o.where(F.col("outlier").isNotNull())


@query("""SELECT sample_index, similarity, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview FROM (
SELECT DISTINCT sample_index, similarity, text FROM scores WHERE similarity < 0.3) ORDER BY similarity, sample_index LIMIT 5""")
def lowest_similarity(spark, folder):
    from ..functions.text import preview

    low = table(spark, folder, "scores").where(F.col("similarity") < 0.3).select("sample_index", "similarity", "text").distinct()
    return low.orderBy("similarity", "sample_index").limit(5).select("sample_index", "similarity", preview(F.col("text"), 50).alias("preview"))


@query(f"""SELECT sample_index, scored_at, coalesce({_VALID} >= 0.8, false) AS is_high_quality,
CASE WHEN {_VALID} >= 0.8 THEN 'high' WHEN {_VALID} >= 0.5 THEN 'medium' WHEN {_VALID} < 0.5 THEN 'low' END AS quality_level,
CASE WHEN {_VALID} >= 0.8 THEN 'keep: text and audio fit' WHEN {_VALID} >= 0.5 THEN 'review: text and audio may fit' WHEN {_VALID} < 0.5 THEN 'drop: text and audio don''t fit' END AS recommendation
FROM scores""")
def verify_quality(spark, folder):
    v = verify(table(spark, folder, "scores"), F.col("similarity"))
    return v.select("sample_index", "scored_at", "is_high_quality", "quality_level", "recommendation")


@query("""SELECT lower(trim(model)) AS model, count(*) FILTER (s >= 0.8) AS high, round(count(*) FILTER (s >= 0.8) / count(s) * 100, 6) AS share, round(avg(s), 6) AS average
FROM (SELECT model, CASE WHEN NOT isnan(similarity) THEN similarity END AS s FROM scores) GROUP BY 1""")
def high_quality_share(spark, folder):
    from ..functions.keys import source_key

    s = table(spark, folder, "scores").select(source_key(F.col("model")).alias("model"), sc.nan_to_null(F.col("similarity")).alias("s"))
    high = F.count_if(F.col("s") >= 0.8)
    return s.groupBy("model").agg(
        high.alias("high"), F.when(F.count("s") > 0, F.round(high / F.count("s") * 100, 6)).alias("share"), F.round(F.avg("s"), 6).alias("average")
    )


def _describe_sql(std: str) -> str:
    return f"""SELECT lower(trim(model)) AS model, count(s) AS count, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round({std}(s), 6) AS std,
min(s) AS min, max(s) AS max, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.75), 6) AS p75
FROM (SELECT model, CASE WHEN NOT isnan(similarity) THEN similarity END AS s FROM scores) GROUP BY 1"""


def _described(spark, folder, sample):
    from ..functions.keys import source_key

    s = table(spark, folder, "scores").withColumn("model", source_key(F.col("model")))
    d = report.describe(s, F.col("similarity"), ("model",), sample)
    return d.select([F.round(c, 6).alias(c) if c in ("mean", "median", "std", "p25", "p75") else F.col(c) for c in d.columns])


@query(_describe_sql("stddev_samp"))
def describe_sample_std(spark, folder):
    return _described(spark, folder, True)


@query(_describe_sql("stddev_pop"))
def describe_pop_std(spark, folder):
    return _described(spark, folder, False)


@query("""WITH s AS (SELECT CASE WHEN NOT isnan(similarity) THEN similarity END AS s, audio_duration AS d, alignment_score AS a, length(text) AS l FROM scores)
SELECT 'duration' AS pair, round(corr(s, d), 6) AS r FROM s UNION ALL SELECT 'alignment', round(corr(s, a), 6) FROM s
UNION ALL SELECT 'text_length', round(corr(s, l), 6) FROM s""")
def correlations(spark, folder):
    s = F.col("similarity")
    c = report.correlations(
        table(spark, folder, "scores"),
        [("duration", s, F.col("audio_duration")), ("alignment", s, F.col("alignment_score")), ("text_length", s, F.length("text"))],
    )
    return c.withColumn("r", F.round("r", 6))


@query("""WITH r AS (SELECT CAST(length(text) AS DOUBLE) AS x, CASE WHEN NOT isnan(similarity) AND similarity <= 1 AND similarity >= 0 THEN similarity END AS y FROM scores WHERE text IS NOT NULL),
m AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
b AS (SELECT CAST(CASE WHEN x = lo THEN 0 ELSE least(greatest(ceil((x - lo) / ((hi - lo) / 5)) - 1, 0), 4) END AS INTEGER) AS bin, y FROM r, m)
SELECT v.bin, count(b.bin) AS rows, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std
FROM (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS bin) v LEFT JOIN b USING (bin) GROUP BY 1""")
def length_bins(spark, folder):
    s = F.col("similarity")
    y = F.when(~F.isnan(s) & s.between(0, 1), s)
    return report.cut_bins(table(spark, folder, "scores"), F.length("text"), 5, y).select(
        "bin", "rows", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


@query("""WITH r AS (SELECT similarity AS x FROM scores WHERE NOT isnan(similarity) AND similarity BETWEEN 0 AND 1), m AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
b AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin FROM r, m)
SELECT v.bin, count(b.bin) AS rows FROM (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin) v LEFT JOIN b USING (bin) GROUP BY 1""")
def score_histogram(spark, folder):
    s = table(spark, folder, "scores").where(F.col("similarity").between(0, 1))
    return report.histogram_bins(s, F.col("similarity"), 50)


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(a.embedding), 6) AS mae
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_mae(spark, folder):
    return pairs(spark, folder).select("vec_id", F.round(sc.mean_absolute_error(F.col("embedding"), F.col("other")), 6).alias("mae"))


_TRIPLES = f"""(SELECT a.vec_id, a.label, {COS} AS pos, {COS.replace('b.', 'c.')} AS neg FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2)"""


def _scored_triples(spark, folder):
    n = negatives(spark, folder)
    both = F.struct(sc.cosine(F.col("embedding"), F.col("other")).alias("pos"), sc.cosine(F.col("embedding"), F.col("third")).alias("neg"))
    return n.select("vec_id", "label", once(both).alias("c")).select("vec_id", "label", "c.pos", "c.neg")


@query(f"SELECT label, round(avg(ln(1 + exp((neg - pos) / 0.1))), 6) AS loss FROM {_TRIPLES} GROUP BY 1")
def infonce_loss(spark, folder):
    return _scored_triples(spark, folder).groupBy("label").agg(F.round(F.avg(losses.infonce(F.col("pos"), F.col("neg"))), 6).alias("loss"))


@query("""WITH t AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, round(avg(greatest(x, 0) - x * 0.9 + ln(1 + exp(-abs(x)))), 6) AS clean_bce, round(avg(greatest(x, 0) - x * 0.1 + ln(1 + exp(-abs(x)))), 6) AS corrupt_bce FROM t GROUP BY 1""")
def align_bce_loss(spark, folder):
    """Means over tokens, not over rows."""
    t = table(spark, folder, "embeddings").select("label", F.explode("embedding").alias("x"))
    x = F.col("x").cast("double")
    return t.groupBy("label").agg(
        F.round(F.avg(losses.bce_with_logits(x, F.lit(losses.CLEAN_LABEL))), 6).alias("clean_bce"),
        F.round(F.avg(losses.bce_with_logits(x, F.lit(losses.CORRUPT_LABEL))), 6).alias("corrupt_bce"),
    )


@query(f"""SELECT round(avg(pos), 6) AS avg_similarity, round(median(pos), 6) AS median_similarity, round(stddev_pop(pos), 6) AS std_similarity, round(avg(pos), 6) AS clean_similarity,
round(avg(neg), 6) AS corrupt_similarity, round(avg(pos) - avg(neg), 6) AS similarity_gap, round(avg((pos + 1) / 2), 6) AS avg_pos_alignment,
round(avg((neg + 1) / 2), 6) AS avg_neg_alignment, round(avg((pos + 1) / 2) - avg((neg + 1) / 2), 6) AS alignment_gap FROM {_TRIPLES}""")
def eval_bundle(spark, folder):
    p, n = F.col("pos"), F.col("neg")
    e = report.evaluation_bundle(_scored_triples(spark, folder), p, n, sc.unit_scale(p), sc.unit_scale(n))
    return e.select([F.round(c, 6).alias(c) for c in e.columns])


def cosine_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A scorer on precomputed embeddings: what a model's forward pass would be plugged in for."""
    import numpy as np

    a = np.stack(batch["embedding"].to_numpy()).astype("float64")
    b = np.stack(batch["other"].to_numpy()).astype("float64")
    cos = (a * b).sum(axis=1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    return pd.DataFrame({"similarity": (cos + 1) / 2, "alignment_score": np.nan})


@query(f"SELECT vec_id, round((cos + 1) / 2, 6) AS similarity, 'scored' AS status FROM {PAIRS}")
def batch_scores(spark, folder):
    s = score_batches(pairs(spark, folder), cosine_scorer, ["embedding", "other"], carry=["vec_id"])
    return s.select("vec_id", F.round("similarity", 6).alias("similarity"), "status")


@query("""SELECT label, i AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean_pooled
FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2""")
def pooled_vectors(spark, folder):
    """All vectors of each label as tokens of a text, mean-pooled, dimension by dimension."""
    pooled = pool_groups(table(spark, folder, "embeddings"), ["label"], "embedding", F.lit(True))
    return pooled.withColumn("mean_pooled", F.round("mean_pooled", 6))


@query("""WITH t AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT label, i AS dim, round(coalesce(sum(CAST(x AS DOUBLE)) FILTER (vec_id % 4 <> 3), 0) / greatest(count(*) FILTER (vec_id % 4 <> 3), 1e-9), 6) AS mean_pooled FROM t GROUP BY 1, 2""")
def pooled_labels(spark, folder):
    """All vectors of each label as tokens of a text, every fourth one masked out, mean-pooled."""
    e = table(spark, folder, "embeddings")
    return pool_groups(e, ["label"], "embedding", F.col("vec_id") % 4 != 3).withColumn("mean_pooled", F.round("mean_pooled", 6))


@query("""WITH t AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), w AS (SELECT vec_id, x, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS a FROM t)
SELECT vec_id, round(sum(a * x), 6) AS attended, round(max(a), 6) AS top_weight FROM w GROUP BY 1""")
def attentive_scores(spark, folder):
    """Token scores under their own softmax weights."""
    weights = sc.softmax(F.col("embedding"))
    return table(spark, folder, "embeddings").select(
        "vec_id", F.round(sc.dot(weights, F.col("embedding")), 6).alias("attended"), F.round(F.array_max(weights), 6).alias("top_weight")
    )


@query("""SELECT vec_id, position, score FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS position, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings)
WHERE position < 8 + vec_id % 56""")
def token_scores(spark, folder):
    """Long form of the unmasked token scores."""
    e = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("position", "s"))
    return e.where(F.col("position") < 8 + F.col("vec_id") % 56).select("vec_id", "position", F.col("s").cast("double").alias("score"))
