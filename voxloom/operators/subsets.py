"""Named training subsets from synthetic and real records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import conform, schema_gaps
from ..sources.writers import publish, save_splits
from .joins import match_text

# The constants that real rows carry.
REAL_VOICE, REAL_MODEL, REAL_SOURCE = "common_voice", "common_voice_17", "common_voice"
# Columns of real speech that aren't kept.
REAL_DROPPED = ("segment", "variant", "path")


def standardize_real(df: DataFrame) -> DataFrame:
    """Real speech as unified records: columns dropped and renamed, constants set, defaults filled."""
    named = df.drop(*REAL_DROPPED)
    if "sentence" in named.columns and "text" not in named.columns:
        named = named.withColumnRenamed("sentence", "text")
    return named.withColumns(
        {"voice": F.lit(REAL_VOICE), "model": F.lit(REAL_MODEL), "dataset_source": F.lit(REAL_SOURCE)}
    )


def _parts(synthetic: DataFrame, real: DataFrame, banded: DataFrame) -> dict[str, Callable[[], list[DataFrame]]]:
    good, best = banded.where(F.col("band").isin("high", "medium")), banded.where(F.col("band") == "high")
    return {
        "fully_synthetic": lambda: [synthetic],
        "mixed_cv_synthetic": lambda: [good, real],
        "cv_only": lambda: [real],
        "high_quality_cv": lambda: [best, real],
        "cv_fully_synthetic": lambda: [real, synthetic],
        "mixed_cv_synthetic_all": lambda: [synthetic, real],
    }


SUBSETS = ("fully_synthetic", "mixed_cv_synthetic", "cv_only", "high_quality_cv", "cv_fully_synthetic", "mixed_cv_synthetic_all")


def build_subset(name: str, synthetic: DataFrame, real: DataFrame, banded: DataFrame, id_col: str = "sample_index") -> DataFrame:
    """A subset as unified records with ``id_col``, ``subset`` and ``split``.

    ``real`` has ``split``; ``banded`` is synthetic with ``band``. Training rows are the union of the subset's
    parts (duplicates stay), validation and test are always the real ones.
    """
    pieces = _parts(synthetic, real.where(F.col("split") == "train"), banded)[name]()
    train = None
    for piece in pieces:
        rows = conform(piece, (id_col,)).withColumn("split", F.lit("train"))
        train = rows if train is None else train.unionByName(rows)
    held = conform(real.where(F.col("split").isin("validation", "test")), (id_col, "split"))
    return train.unionByName(held).withColumn("subset", F.lit(name))


def text_matched(synthetic: DataFrame, real: DataFrame, id_col: str = "sample_index") -> DataFrame:
    """(id, audio, sentence, source, split): synthetic rows whose text real speech has, with real training rows; real rows held out."""
    matched = match_text(synthetic, real, "text")

    def rows(df: DataFrame, source: str, split) -> DataFrame:
        return df.select(id_col, "audio", F.col("text").alias("sentence"), F.lit(source).alias("source"), split.alias("split"))

    held = real.where(F.col("split").isin("validation", "test"))
    return (
        rows(matched, "synthetic_matched", F.lit("train"))
        .unionByName(rows(real.where(F.col("split") == "train"), "common_voice", F.lit("train")))
        .unionByName(rows(held, "common_voice", F.col("split")))
    )


def default_mixed(synthetic: DataFrame, real: DataFrame, id_col: str = "sample_index") -> DataFrame:
    """Synthetic rows for training and real ones held out, tagged with their source."""
    train = conform(synthetic.withColumn("dataset_source", F.lit("synthetic")), (id_col,)).withColumn("split", F.lit("train"))
    held = conform(real.where(F.col("split").isin("validation", "test")).withColumn("dataset_source", F.lit(REAL_SOURCE)), (id_col, "split"))
    return train.unionByName(held)


def subset_counts(df: DataFrame) -> DataFrame:
    """Rows by subset and split, with totals (null split, null subset)."""
    return df.rollup("subset", "split").agg(F.count("*").alias("rows"))


def consistency(subsets: dict[str, DataFrame]) -> list[tuple[str, str, bool, str]]:
    """(subset, check, ok, detail) of each subset's columns and types against the first one's."""
    names = list(subsets)
    base, out = subsets[names[0]], []
    for name in names:
        missing, extra = schema_gaps(base.columns, subsets[name].columns)
        out.append((name, "columns", not missing and not extra, f"missing {missing}, extra {extra}"))
        types = dict(base.dtypes)
        wrong = [f"{c}: {t}, not {types[c]}" for c, t in subsets[name].dtypes if c in types and types[c] != t]
        out.append((name, "types", not wrong, "; ".join(wrong)))
    return out


def build_all(
    names: Sequence[str], synthetic: DataFrame, real: DataFrame, banded: DataFrame, path: str, id_col: str = "sample_index"
) -> tuple[DataFrame, list[tuple[str, str, bool, str]]]:
    """Build the named subsets, check them against each other, save those that can be and summarise them.

    Saved as ``path``/subset=.../split=.... Gives the summary of what was saved and (subset, check, ok, detail): columns,
    types, whether the write worked, and whether held-out splits have the same rows as those of the first one. A
    subset that fails doesn't stop the rest.
    """
    spark = synthetic.sparkSession
    built = {n: build_subset(n, synthetic, real, banded, id_col) for n in names}
    checks = consistency(built)

    def writing(df: DataFrame, n: str) -> Callable[[], None]:
        return lambda: save_splits(df.drop("subset"), f"{path}/subset={n}")

    written = publish({n: writing(df, n) for n, df in built.items()})
    checks += [(n, "saved", ok, error) for n, ok, error in written]
    good = [n for n, ok, _ in written if ok]
    if not good:
        return summary(built[names[0]].limit(0), id_col), checks
    columns = built[good[0]].drop("subset", "split").schema.fields
    parts = [T.StructField(c, T.StringType()) for c in ("subset", "split")]
    saved = spark.read.schema(T.StructType([*columns, *parts])).parquet(path).where(F.col("subset").isin(good))
    held = saved.where(F.col("split").isin("validation", "test")).groupBy("subset").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(id_col, "split")).alias("x"))
    marks = {r["subset"]: (r["n"], r["x"]) for r in held.collect()}  # a row a subset
    first = marks.get(good[0], (0, None))
    checks += [(n, "held out", marks.get(n, (0, None)) == first, f"{marks.get(n, (0, None))[0]} rows") for n in good]
    return summary(saved, id_col), checks


def summary(df: DataFrame, id_col: str = "sample_index") -> DataFrame:
    """Of each subset and split: rows, columns, and the first text, cut to 100 characters with dots.

    A column ``audio`` that is a struct with a sampling rate adds the first row's.
    """
    first = F.min(F.struct(F.col(id_col).alias("i"), F.col("text").alias("t"))).getField("t")
    rate = []
    if "audio" in df.columns and isinstance(kind := df.schema["audio"].dataType, T.StructType) and "sampling_rate" in kind.names:
        rate = [F.min(F.struct(F.col(id_col).alias("i"), F.col("audio.sampling_rate").alias("r"))).getField("r").alias("sampling_rate")]
    return df.groupBy("subset", "split").agg(
        F.count("*").alias("num_samples"), *rate, F.concat(F.substring(first, 1, 100), F.lit("...")).alias("sample_text")
    ).withColumn("features", F.lit(",".join(c for c in df.columns if c not in ("subset", "split"))))
