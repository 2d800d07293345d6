"""Joins of texts, audio records and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import audio_filename, filename_hash, filename_voice, norm_key
from .ordered import global_position
from .spread import even_join


def _filled(text: str) -> Column:
    """Neither null nor empty (blank texts are filled, with the key '')."""
    return F.col(text).isNotNull() & (F.col(text) != "")


def _digest(text: str) -> Column:
    """16 bytes for the normalised text. Never null, so that no join adds a filter that would compute it again."""
    return F.coalesce(F.unhex(F.md5(norm_key(F.col(text)))), F.lit(b""))


def _keys(df: DataFrame, text: str) -> DataFrame:
    return df.where(_filled(text)).select(_digest(text).alias("_key")).distinct()


def match_text(left: DataFrame, right: DataFrame, text: str, other: str | None = None, keep: str = "matched") -> DataFrame:
    """Rows of ``left`` whose normalised text is (or, keep='unmatched', isn't) among those of ``right``.

    Null and empty texts match nothing. Texts are compared by digests of their keys; a text of very many rows is joined in slices.
    """
    total = left.count()
    if keep == "matched":
        keyed = left.where(_filled(text)).withColumn("_key", _digest(text))
        return even_join(keyed, _keys(right, other or text), "_key", "left_semi", total).drop("_key")
    keyed = left.withColumn("_key", F.when(_filled(text), _digest(text)))
    return even_join(keyed, _keys(right, other or text), "_key", "left_anti", total).drop("_key")


def match_statistics(left: DataFrame, right: DataFrame, text: str, other: str | None = None) -> DataFrame:
    """One row: rows, matched, excluded, rate in per cent (0 for no rows), distinct matched texts as written."""
    # rows of one text are counted before the join, so a text of very many rows is one row there
    counted = left.groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("_n")).withColumn("_key", F.when(_filled("_text"), _digest("_text")))
    flagged = counted.join(_keys(right, other or text).withColumn("_hit", F.lit(True)), "_key", "left")
    hit = F.col("_hit").isNotNull()
    rows, matched = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0))
    return flagged.agg(
        rows.alias("rows"),
        matched.alias("matched"),
        (rows - matched).alias("excluded"),
        F.when(rows > 0, matched / rows * 100).otherwise(F.lit(0.0)).alias("rate"),
        F.count_if(hit).alias("distinct_matched"),
    )


def attach_last(left: DataFrame, right: DataFrame, key: str, order: str, values: Sequence[str], missing: dict | None = None) -> DataFrame:
    """Left join with the last row (by ``order``) of each key on the right; defaults where there is none.

    The last row is a partial aggregate, so repeated keys multiply nothing; a key of very many rows on the left is
    joined in slices. Null keys never match.
    """
    last = right.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.struct(F.col(order), *[F.col(v) for v in values])).alias("_last")
    )
    joined = even_join(left.drop(*values), last, key, "left", left.count())
    out = [
        F.when(F.col("_last").isNull(), F.lit((missing or {}).get(v))).otherwise(F.col(f"_last.{v}")).alias(v) for v in values
    ]
    return joined.select(*[c for c in left.columns if c not in values], *out)


def locate_audio(texts: DataFrame, files: DataFrame, voices: Sequence[str], id_col: str, text: str, model: str) -> DataFrame:
    """Each row's audio file: of the files named after its text, model and a voice, that of the first voice in order.

    (id, filename, voice, file_size); nulls where no file is. The voices are a short parameter list
    exploded on the row, the lookup is one equi-join, and the choice a partial aggregate.
    """
    order = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(v).alias("voice")) for i, v in enumerate(voices)])
    named = texts.select(F.col(id_col), F.col(text).alias("_t"), F.col(model).alias("_m"), F.explode(order).alias("_v")).select(
        id_col, "_v.rank", "_v.voice", audio_filename(F.col("_t"), F.col("_v.voice"), F.col("_m")).alias("filename")
    )
    listing = files.groupBy("filename").agg(F.max("file_size").alias("file_size"))
    found = named.join(listing, "filename").groupBy(id_col).agg(F.min(F.struct("rank", "filename", "voice", "file_size")).alias("_f"))
    return texts.select(id_col).join(found, id_col, "left").select(id_col, "_f.filename", "_f.voice", "_f.file_size")


def file_inventory(files: DataFrame) -> DataFrame:
    """Files with the hash and voice their names carry; both null for names of fewer than three parts."""
    name = F.col("filename")
    return files.withColumn("content_hash", filename_hash(name)).withColumn("voice", filename_voice(name))


def orphans(files: DataFrame, texts: DataFrame, text: str, voice: str, model: str) -> DataFrame:
    """Files that no row's text, voice and model name: an anti join on the computed name."""
    expected = texts.select(audio_filename(F.col(text), F.col(voice), F.col(model)).alias("filename")).distinct()
    return files.join(expected, "filename", "left_anti")


def integrity(texts: DataFrame, files: DataFrame, id_col: str, text: str, voice: str, model: str, audio: str) -> DataFrame:
    """A verdict for each row: 'no_audio', 'mismatch', 'not_found' or 'correct', with the expected and stored name."""
    stored = F.substring_index(F.col(audio), "/", -1)
    rows = texts.select(id_col, audio_filename(F.col(text), F.col(voice), F.col(model)).alias("expected"), stored.alias("stored"))
    listing = files.select(F.col("filename").alias("stored")).distinct().withColumn("_there", F.lit(True))
    return rows.join(listing, "stored", "left").select(
        id_col, "expected", "stored", verdict(F.col("expected"), F.col("stored"), F.col("_there")).alias("verdict")
    )


def verdict(expected: Column, stored: Column, there: Column) -> Column:
    return (
        F.when(stored.isNull() | (stored == ""), "no_audio")
        .when(expected.isNull() | (expected != stored), "mismatch")
        .when(there.isNull(), "not_found")
        .otherwise("correct")
    )


def select_by_index(rows: DataFrame, indices: DataFrame, id_col: str, repeats: bool = False) -> DataFrame:
    """Rows whose id is among the indices; with ``repeats`` once for each time it is."""
    wanted = indices.select(id_col)
    return rows.join(wanted, id_col) if repeats else rows.join(wanted.distinct(), id_col, "left_semi")


def select_in_order(rows: DataFrame, indices: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """Rows with their place ``at`` (from 0) in the list of indices sorted by ``order``: repeated ids come out repeatedly, missing ones leave gaps."""
    listed = global_position(indices.select(id_col, *[c for c in order if c != id_col]), [F.col(c) for c in order], "at")
    return rows.join(listed.select(id_col, "at"), id_col)


def generation_plan(texts: DataFrame, files: DataFrame, id_col: str, text: str, voice: str, model: str) -> DataFrame:
    """(id, filename, status): 'cached' if the file named after the content is there, 'to_generate' if not, 'no_name' without a name."""
    rows = texts.select(id_col, audio_filename(F.col(text), F.col(voice), F.col(model)).alias("filename"))
    listing = files.where(F.col("file_size") > 0).select("filename").distinct().withColumn("_there", F.lit(True))
    status = F.when(F.col("filename").isNull(), "no_name").when(F.col("_there").isNull(), "to_generate").otherwise("cached")
    return rows.join(listing, "filename", "left").select(id_col, "filename", status.alias("status"))
