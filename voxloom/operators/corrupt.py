"""Corrupted transcripts with a known correctness, drawn by hash instead of a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.keys import once
from ..functions.text import seeded, word_array

#: Common Dutch words that fill or replace (a parameter for other languages).
FILLERS = (
    "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit naar door over ze ik hij"
).split()
STRATEGIES = ("replace", "shuffle", "drop", "insert", "half")


def with_corruption(
    df: DataFrame, text: str, id_col: str, strategy: str | None = None, fillers=tuple(FILLERS), seed: int = 42
) -> DataFrame:
    """``df`` with columns strategy, corrupted, correctness; every text is corrupted.

    replace: one word becomes a filler, (n-1)/n even if it is the same word. shuffle: a segment of
    two or more words is put in another order, correctness is the share of words still in
    place; two words stay as they are, 1.0. drop word k: k/n. insert before k: k/(n+1). half: the
    first or last half (the larger one last), 0.5. A text of at most one word gets a filler
    appended, 0.5 (strategy 'append'). Null gives null. ``strategy`` fixes the
    choice; else it is drawn evenly by the hash of the id and seed, as are positions and fillers.

    Words, then draws, then the shuffled words are computed once a row, each behind a generator.
    """
    row = F.col(id_col)

    def draw(what: str, below: Column) -> Column:
        return F.pmod(seeded(row, F.lit(what), seed=seed), F.greatest(below, F.lit(1))).cast("int")

    w, n = F.col("_w"), F.size("_w")
    split = df.withColumn("_w", once(word_array(F.col(text))))
    chosen = F.lit(strategy) if strategy else F.element_at(
        F.array(*[F.lit(s) for s in STRATEGIES]), draw("strategy", F.lit(len(STRATEGIES))) + 1
    )
    begin = draw("begin", n - 1)
    draws = F.struct(
        F.when(F.col(text).isNull(), F.lit(None)).when(n <= 1, "append").otherwise(chosen).alias("strategy"),
        F.element_at(F.array(*[F.lit(x) for x in fillers]), draw("word", F.lit(len(fillers))) + 1).alias("word"),
        draw("at", n).alias("at"),
        draw("at", n + 1).alias("put"),
        draw("half", F.lit(2)).alias("half"),
        begin.alias("begin"),
        F.least(F.lit(2) + draw("length", n - begin - 1), n - begin).alias("length"),
    )
    drawn = split.withColumn("_d", once(draws))
    name, word, at, put = (F.col(f"_d.{c}") for c in ("strategy", "word", "at", "put"))
    segment = F.slice(w, F.col("_d.begin") + 1, F.col("_d.length"))
    keyed = F.transform(segment, lambda x, i: F.struct(seeded(row, F.lit("order"), i, seed=seed).alias("k"), i.alias("i"), x.alias("x")))
    shuffled = F.concat(
        arrays.head(w, F.col("_d.begin")),
        F.transform(F.array_sort(keyed), lambda s: s["x"]),
        arrays.tail(w, F.col("_d.begin") + F.col("_d.length")),
    )
    half = F.floor(n / 2).cast("int")
    words = (
        F.when(name == "append", F.concat(w, F.array(word)))
        .when(name == "replace", arrays.replace_at(w, at, word))
        .when(name == "shuffle", F.when(n <= 2, w).otherwise(shuffled))
        .when(name == "drop", arrays.remove_at(w, at))
        .when(name == "insert", arrays.insert_at(w, put, word))
        .when((name == "half") & (F.col("_d.half") == 0), arrays.head(w, half))
        .when(name == "half", arrays.tail(w, half))
    )
    made = drawn.withColumn("_v", once(words))
    size = n.cast("double")
    correct = (
        F.when(name.isin("append", "half"), F.lit(0.5))
        .when(name == "replace", (size - 1) / size)
        .when(name == "shuffle", arrays.share_in_place(w, F.col("_v")))
        .when(name == "drop", at / size)
        .when(name == "insert", put / (size + 1))
    )
    return made.select(
        *df.columns, name.alias("strategy"), F.array_join("_v", " ").alias("corrupted"), correct.cast("double").alias("correctness")
    )
