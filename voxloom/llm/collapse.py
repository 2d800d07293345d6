"""Records that are the same but for white space, case, punctuation or field order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import letters_digits, once
from ..operators.spread import hot_limit, spread_join
from ..storage import cut, discard


def text_fields(text: str) -> Column:
    """A record whose only field is ``text``; none for null and without any letter or digit."""
    value = letters_digits(F.coalesce(F.col(text), F.lit("")))
    return F.filter(F.array(F.struct(F.lit("text").alias("name"), value.alias("value"))), lambda x: x["value"] != "")


def record_fields(text: str) -> Column:
    """Fields of a serialised record: a JSON object, or lines ``name: value``.

    The value is what follows the first colon; a line without one is a field without
    value. Names are compared in lower case without outer blanks, values by letters and
    digits. A JSON null is a field without value, which differs from no field. What
    can't be read as JSON is read as lines; a null text has no fields.
    """
    raw = F.col(text)
    parsed = F.map_entries(F.from_json(raw, "map<string,string>"))
    lines = F.transform(
        F.filter(F.split(raw, r"\r\n|\r|\n"), lambda x: F.trim(x) != ""),
        lambda x: F.struct(
            F.substring_index(x, ":", 1).alias("key"),
            F.when(F.instr(x, ":") > 0, x.substr(F.instr(x, ":") + 1, F.length(x))).otherwise("").alias("value"),
        ),
    )
    fields = F.when(F.ltrim(raw).startswith("{") & parsed.isNotNull(), parsed).otherwise(lines)
    return F.transform(
        F.coalesce(fields, F.array().cast("array<struct<key:string,value:string>>")),
        lambda x: F.struct(
            F.lower(F.regexp_replace(x["key"], r"(?U)^\s+|\s+$", "")).alias("name"),
            letters_digits(F.coalesce(x["value"], F.lit(""))).alias("value"),
        ),
    )


def _hash_sum(fields: Column, seed: str, shift: int) -> Column:
    """The sum over the fields of 31 bits of each (name, value) pair's hash."""
    return F.aggregate(
        fields,
        F.lit(0).cast("bigint"),
        lambda acc, x: acc
        + F.shiftrightunsigned(F.xxhash64(F.lit(seed), x["name"], x["value"]), shift).bitwiseAND(F.lit(0x7FFFFFFF)),
    )


def _fingerprint(fields: Column) -> list[Column]:
    """Two numbers from sums over the multiset of fields: any order gives the same."""
    return [
        # not nullable, so that a join needs no filter that would compute it again
        F.coalesce(F.shiftleft(_hash_sum(fields, seed, 0), 31).bitwiseXOR(_hash_sum(fields, seed, 32)), F.lit(0)).alias(name)
        for seed, name in (("a", "_f1"), ("b", "_f2"))
    ]


def _counted(fields: Column) -> Column:
    """Distinct (name, value, times); as sets these are equal if the multisets are."""
    distinct = F.array_distinct(fields)
    return F.when(
        F.size(distinct) == F.size(fields), F.transform(fields, lambda x: F.struct(x["name"], x["value"], F.lit(1).alias("times")))
    ).otherwise(
        F.transform(
            distinct, lambda x: F.struct(x["name"], x["value"], F.size(F.filter(fields, lambda y: y == x)).alias("times"))
        )
    )


def collapse_copies(rows: DataFrame, id_col: str, fields: Column) -> DataFrame:
    """Every record that has copies, as (keep_id, copy_id); keep_id is the smallest id of its group.

    ``fields`` gives array<struct<name, value>>; records without fields or id are left out. Field
    pairs are hashed, hashes combined by commutative sums, records grouped by this
    fingerprint, and each copy's fields compared with those of the kept record as
    multisets, without sorting. Records whose fields differ in spite of equal
    fingerprints are grouped again by the fields themselves. Groups are counted by
    partial aggregates, and large groups are joined in slices. An id that occurs
    several times counts as one record (of its rows, all that match are its copies once).
    """
    base = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), once(fields).alias("_fields"))
    base = base.where(F.size("_fields") > 0)
    printed = base.select("_id", "_fields", *_fingerprint(F.col("_fields")))
    key = ["_f1", "_f2"]
    groups = cut(
        printed.groupBy(*key)
        .agg(F.min("_id").alias("keep_id"), F.max("_id").alias("_last"), F.count("*").alias("_size"))
        .where(F.col("keep_id") != F.col("_last"))
        .drop("_last"),
        "groups",
    )
    total = groups.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    members = cut(spread_join(printed, groups, key, "_size", total, F.col("_id")), "members")
    kept = members.where(F.col("_id") == F.col("keep_id")).groupBy(*key, "keep_id").agg(F.first("_fields").alias("_kept"))
    kept = kept.join(groups.select(*key, "_size"), key) if total > hot_limit(total) else kept.withColumn("_size", F.lit(0))
    mine, other = _counted(F.col("_fields")), _counted(F.col("_kept"))
    same = (F.size(mine) == F.size(other)) & (F.size(F.array_except(mine, other)) == 0)
    verified = cut(
        spread_join(members.where(F.col("_id") != F.col("keep_id")), kept, [*key, "keep_id"], "_size", total, F.col("_id"))
        .withColumn("_same", same)
        .select(*key, "keep_id", "_id", "_same", F.when(~F.col("_same"), F.col("_fields")).alias("_fields")),
        "verified",
    )
    discard(members, groups)
    found = verified.where("_same").select("keep_id", F.col("_id").alias("copy_id"))
    if verified.where(~F.col("_same")).limit(1).count():
        rest = verified.where(~F.col("_same")).select("_id", *key, F.to_json(F.array_sort(_counted(F.col("_fields")))).alias("_exact"))
        firsts = rest.groupBy(*key, "_exact").agg(F.min("_id").alias("keep_id"))
        found = found.unionByName(
            rest.join(firsts, [*key, "_exact"]).where(F.col("_id") != F.col("keep_id")).select("keep_id", F.col("_id").alias("copy_id"))
        )
    return found.distinct()


def collapsed(rows: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """(keep_id, copies) of every record but the copies in ``found``; 1 where there are none."""
    ids = rows.select(F.col(id_col).alias("keep_id"))
    left = ids.join(found.select(F.col("copy_id").alias("keep_id")), "keep_id", "left_anti")
    return left.join(copy_counts(found), "keep_id", "left").select("keep_id", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))


def copy_counts(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Copies of each kept record, itself included."""
    return found.groupBy(*by, "keep_id").agg((F.count("*") + 1).alias("copies"))
