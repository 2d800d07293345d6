"""Word arrays: slices, edits at a position, comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(w: Column, n: Column) -> Column:
    """The first n elements."""
    return F.slice(w, F.lit(1), n)


def tail(w: Column, n: Column) -> Column:
    """All but the first n elements."""
    return F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0)))


def replace_at(w: Column, k: Column, word: Column) -> Column:
    """With element k (from 0) replaced."""
    return F.transform(w, lambda x, i: F.when(i == k, word).otherwise(x))


def remove_at(w: Column, k: Column) -> Column:
    return F.filter(w, lambda x, i: i != k)


def insert_at(w: Column, k: Column, word: Column) -> Column:
    """With ``word`` before element k; k = size appends."""
    return F.concat(head(w, k), F.array(word), tail(w, k))


def share_in_place(a: Column, b: Column) -> Column:
    """Share of positions at which two arrays of one size agree; null for empty ones."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(F.size(a) > 0, same / F.size(a))


def clean_tokens(tokens: Column, scores: Column, mask: Column, special=("<s>", "</s>", "<pad>")) -> Column:
    """Structs (token, score) of unmasked tokens that aren't special."""
    zipped = F.arrays_zip(tokens.alias("token"), scores.alias("score"), mask.alias("mask"))
    kept = F.filter(zipped, lambda x: (x["mask"] == 1) & ~x["token"].isin(*special))
    return F.transform(kept, lambda x: F.struct(x["token"].alias("token"), x["score"].alias("score")))


def pad_to(a: Column, n: int, fill=0) -> Column:
    """The first n elements, filled up to n."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), n)), 1, n)


def masked(a: Column, mask: Column) -> Column:
    """Element by element the product with a mask."""
    return F.zip_with(a, mask, lambda x, m: x * m)
