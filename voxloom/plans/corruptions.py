"""Queries on corrupted transcripts and word error rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.edits import with_word_edits, word_edits_expr
from ..functions.text import normalize_transcript, word_array
from ..operators.corrupt import FILLERS, STRATEGIES, with_corruption
from .registry import query, sql_hash, sql_words, table

_FILL = "[" + ", ".join(f"'{x}'" for x in FILLERS) + "]"


def _draw(what: str, below: str) -> str:
    return f"({sql_hash('sample_index', repr(what))} % greatest({below}, 1))"


_BASE = f"""(SELECT sample_index, text, w, n, ({_FILL})[{_draw('word', str(len(FILLERS)))} + 1] AS word, {_draw('at', 'n')} AS k, {_draw('at', 'n + 1')} AS p,
{_draw('half', '2')} AS half, {_draw('begin', 'n - 1')} AS b, {_draw('strategy', str(len(STRATEGIES)))} AS s FROM (SELECT sample_index, text, {sql_words('text')} AS w, len({sql_words('text')}) AS n FROM unified))"""


def _corrupt_sql(strategy: str, words: str, correct: str) -> str:
    return f"""SELECT sample_index, CASE WHEN text IS NULL THEN NULL WHEN n <= 1 THEN 'append' ELSE '{strategy}' END AS strategy,
array_to_string(CASE WHEN text IS NULL THEN NULL WHEN n <= 1 THEN w || [word] ELSE {words} END, ' ') AS corrupted,
round(CAST(CASE WHEN text IS NULL THEN NULL WHEN n <= 1 THEN 0.5 ELSE {correct} END AS DOUBLE), 6) AS correctness FROM {_BASE}"""


def _corrupted(spark, folder, strategy):
    c = with_corruption(table(spark, folder, "unified").select("sample_index", "text"), "text", "sample_index", strategy)
    return c.select("sample_index", "strategy", "corrupted", F.round("correctness", 6).alias("correctness"))


@query(_corrupt_sql("replace", "w[1:k] || [word] || w[k + 2:]", "(n - 1) / n"))
def corrupt_replace(spark, folder):
    return _corrupted(spark, folder, "replace")


@query(_corrupt_sql("drop", "w[1:k] || w[k + 2:]", "k / n"))
def corrupt_drop(spark, folder):
    return _corrupted(spark, folder, "drop")


@query(_corrupt_sql("insert", "w[1:p] || [word] || w[p + 1:]", "p / (n + 1)"))
def corrupt_insert(spark, folder):
    return _corrupted(spark, folder, "insert")


@query(_corrupt_sql("half", "CASE WHEN half = 0 THEN w[1:n // 2] ELSE w[n // 2 + 1:] END", "0.5"))
def corrupt_half(spark, folder):
    return _corrupted(spark, folder, "half")


_LEN = f"2 + {sql_hash('sample_index', repr('length'))} % greatest(n - b - 1, 1)"
_KEY = sql_hash("sample_index", "'order'", "i")


@query(f"""WITH base AS (SELECT *, {_LEN} AS l FROM {_BASE}),
seg AS (SELECT sample_index, unnest(w[b + 1:b + l]) AS x, unnest(range(0, len(w[b + 1:b + l]))) AS i FROM base WHERE n > 2),
mixed AS (SELECT sample_index, list(x ORDER BY {_KEY}, i) AS m FROM seg GROUP BY 1),
made AS (SELECT base.*, CASE WHEN n > 2 THEN w[1:b] || m || w[b + l + 1:] ELSE w END AS v FROM base LEFT JOIN mixed USING (sample_index))
SELECT sample_index, CASE WHEN text IS NULL THEN NULL WHEN n <= 1 THEN 'append' ELSE 'shuffle' END AS strategy,
array_to_string(CASE WHEN text IS NULL THEN NULL WHEN n <= 1 THEN w || [word] ELSE v END, ' ') AS corrupted,
round(CASE WHEN text IS NULL THEN NULL WHEN n <= 1 THEN 0.5 WHEN n = 2 THEN 1.0
ELSE len(list_filter(range(1, n + 1), lambda j: w[j] = v[j])) / n END, 6) AS correctness FROM made""")
def corrupt_shuffle(spark, folder):
    return _corrupted(spark, folder, "shuffle")


@query(f"""SELECT CASE WHEN text IS NULL THEN NULL WHEN n <= 1 THEN 'append' ELSE (['{"', '".join(STRATEGIES)}'])[s + 1] END AS strategy, count(*) AS rows FROM {_BASE} GROUP BY 1""")
def corrupt_mixed(spark, folder):
    """Every text corrupted by a drawn strategy: how often each is drawn."""
    return _corrupted(spark, folder, None).groupBy("strategy").agg(F.count("*").alias("rows"))


def _asr_pairs(spark, folder):
    """References and hypotheses: each utterance against the one before it (an equi-join on the id)."""
    u = table(spark, folder, "unified").select("sample_index", "text", "locale")
    h = u.select((F.col("sample_index") + 1).alias("sample_index"), F.col("text").alias("said"))
    return u.join(h, "sample_index").select("sample_index", "locale", word_array(normalize_transcript(F.col("text"))).alias("ref"), word_array(F.col("said")).alias("hyp"))


_NORM = "CASE WHEN u.text = '' OR right(u.text, 1) IN ('.', '?', '!') THEN u.text ELSE u.text || '.' END"
_STRIPPED = """CASE WHEN starts_with(text, '"') AND ends_with(text, '"') AND length(text) >= 2 THEN substr(text, 2, length(text) - 2) ELSE text END"""
_EDITS = f"""(WITH u AS (SELECT sample_index, locale, {_STRIPPED} AS text FROM unified),
p AS (SELECT u.sample_index, u.locale, list_transform({sql_words(_NORM)}, lambda x: CAST(hash(x) % 4611686018427387904 AS BIGINT)) AS r,
list_transform({sql_words('h.text')}, lambda x: CAST(hash(x) % 4611686018427387904 AS BIGINT)) AS h FROM u JOIN unified h ON h.sample_index = u.sample_index - 1)
SELECT sample_index, locale, len(r) AS words, CASE WHEN r IS NULL OR h IS NULL THEN NULL WHEN len(r) = 0 THEN len(h) WHEN len(h) = 0 THEN len(r) ELSE
list_reduce(list_transform(r, lambda x: [x]), lambda row, x: list_reduce(list_transform(range(1, len(h) + 1), lambda j: [j]),
lambda acc, j: list_append(acc, least(acc[-1] + 1, row[j[1] + 1] + 1, row[j[1]] + CASE WHEN h[j[1]] = x[1] THEN 0 ELSE 1 END)), [row[1] + 1]), range(0, len(h) + 1))[-1] END AS edits FROM p)"""


@query(f"SELECT CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(words) AS BIGINT) AS words, round(sum(edits) / sum(words), 6) AS wer FROM {_EDITS} WHERE edits IS NOT NULL")
def wer_corpus(spark, folder):
    """Edits over reference words, both summed over the corpus."""
    e = with_word_edits(_asr_pairs(spark, folder), "ref", "hyp").where("edits IS NOT NULL")
    return e.agg(F.sum("edits").alias("edits"), F.sum(F.size("ref")).alias("words"), F.round(F.sum("edits") / F.sum(F.size("ref")), 6).alias("wer"))


@query(f"SELECT locale, count(*) AS rows, CAST(sum(edits) AS BIGINT) AS edits, CASE WHEN sum(words) > 0 THEN round(sum(edits) / sum(words), 6) END AS wer FROM {_EDITS} WHERE edits IS NOT NULL GROUP BY 1")
def wer_by_locale(spark, folder):
    e = with_word_edits(_asr_pairs(spark, folder), "ref", "hyp").where("edits IS NOT NULL")
    words = F.sum(F.size("ref"))
    return e.groupBy("locale").agg(F.count("*").alias("rows"), F.sum("edits").alias("edits"), F.when(words > 0, F.round(F.sum("edits") / words, 6)).alias("wer"))


@query(f"SELECT CAST(sum(edits) AS BIGINT) AS edits FROM {_EDITS} WHERE edits IS NOT NULL")
def wer_without_python(spark, folder):
    """The same edits from built-in functions."""
    e = _asr_pairs(spark, folder).select(word_edits_expr(F.col("ref"), F.col("hyp")).cast("bigint").alias("edits"))
    return e.agg(F.sum("edits").alias("edits"))


@query(f"""SELECT locale, round(sum(edits) FILTER (split = 'train') / sum(words) FILTER (split = 'train'), 6) AS train, round(sum(edits) FILTER (split = 'validation') / sum(words) FILTER (split = 'validation'), 6) AS validation,
round(sum(edits) FILTER (split = 'test') / sum(words) FILTER (split = 'test'), 6) AS test FROM {_EDITS} JOIN (SELECT sample_index, split FROM unified) USING (sample_index) WHERE edits IS NOT NULL GROUP BY 1""")
def wer_summary(spark, folder):
    """Error rates of several systems (locales) on several sets (splits), a column a set."""
    e = with_word_edits(_asr_pairs(spark, folder), "ref", "hyp").where("edits IS NOT NULL")
    s = table(spark, folder, "unified").select("sample_index", "split")
    rate = F.try_divide(F.sum("edits"), F.sum(F.size("ref")))
    wide = e.join(s, "sample_index").groupBy("locale").pivot("split", ["train", "validation", "test"]).agg(rate)
    return wide.select("locale", *[F.round(c, 6).alias(c) for c in ("train", "validation", "test")])
