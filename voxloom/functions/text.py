"""Transcript text: keys, words, normalisation, file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as Python splits on it.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` takes off spaces only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def norm_key(c: Column) -> Column:
    """The key under which transcripts are compared: lower case, stripped."""
    return F.lower(strip(c))


def word_array(c: Column) -> Column:
    """Words between white space; none for a blank text, null for null."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words; null for null (``size`` alone would depend on a setting)."""
    return F.when(c.isNotNull(), F.size(word_array(c)))


def strip_quotes(c: Column) -> Column:
    """Without a pair of double quotes around the whole text; a lone quote stays."""
    quoted = c.startswith('"') & c.endswith('"') & (F.length(c) >= 2)
    return F.when(quoted, c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)


def end_sentence(c: Column) -> Column:
    """With a full stop unless it ends in one, or in ? or !; empty stays empty."""
    closed = (c == "") | F.right(c, F.lit(1)).isin(".", "?", "!")
    return F.when(closed, c).otherwise(F.concat(c, F.lit(".")))


def normalize_transcript(c: Column) -> Column:
    """Quotes off, then a final mark; idempotent unless quotes are nested."""
    return end_sentence(strip_quotes(c))


def preview(c: Column, most: int = 100) -> Column:
    """The first ``most`` characters, with dots if there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def audio_filename(text: Column, voice: Column, model: Column) -> Column:
    """audio_{first 12 of md5(text_voice_model)}_{voice}.mp3; null if any part is."""
    digest = F.md5(F.concat(text, F.lit("_"), voice, F.lit("_"), model))
    return F.concat(F.lit("audio_"), F.substring(digest, 1, 12), F.lit("_"), voice, F.lit(".mp3"))


def filename_hash(name: Column) -> Column:
    """The second of three or more parts between underscores, else null."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 3, F.element_at(parts, 2))


def filename_voice(name: Column) -> Column:
    """The third part, up to its first dot, else null."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 3, F.substring_index(F.element_at(parts, 3), ".", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension with its dot, in lower case; '' without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def mentions_rate_limit(message: Column) -> Column:
    low = F.lower(message)
    return low.contains("rate limit") | low.contains("rate_limit")


def progress_bar(done: Column, width: int = 40) -> Column:
    """A bar of # and - for a share in [0, 1]."""
    full = F.floor(F.least(F.greatest(done, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def correction_note(reasons: Sequence[tuple[str, Column]]) -> Column:
    """'n label' for every count above 0, joined by '; '."""
    return F.concat_ws("; ", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {label}"))) for label, n in reasons])


def seeded(*parts: Column, seed: int | str = 42) -> Column:
    """A number in [0, 2**32) from md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *[p.cast("string") for p in parts], F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
