"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import source_key
from ..storage import cut
from . import capping, collapse, cutoff, language, leaks, lookalike, mixing, overlap, splits

Query = Callable[[SparkSession, str], DataFrame]

#: What binds records of unified: a contributor, or a voice that is one.
ENTITIES = (("client_id", ()), ("voice", ("common_voice",)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cutoffs(spark: SparkSession, folder: str) -> cutoff.Cutoffs:
    return cutoff.cutoff_for_fraction(table(spark, folder, "scores"), table(spark, folder, "cutoff_targets"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoffs(spark, folder).kept.select("sample_index")


def p1_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoffs(spark, folder).report


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    texts = collapse.collapse_copies(table(spark, folder, "unified"), "sample_index", collapse.text_fields("text"))
    records = collapse.collapse_copies(table(spark, folder, "raw_records"), "record_id", collapse.record_fields("text"))
    return texts.select(F.lit("unified").alias("table_name"), "*").unionByName(
        records.select(F.lit("raw_records").alias("table_name"), "*")
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder)


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return collapse.copy_counts(_copies(spark, folder), ("table_name",))


def p2_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables with each record once and its number of copies."""
    found = cut(_copies(spark, folder), "copies")
    tables = [
        collapse.collapsed(table(spark, folder, name), id_col, found.where(F.col("table_name") == name)).select(F.lit(name).alias("table_name"), "*")
        for name, id_col in (("unified", "sample_index"), ("raw_records", "record_id"))
    ]
    return tables[0].unionByName(tables[1])


def _beyond_cap(spark: SparkSession, folder: str) -> DataFrame:
    return capping.drop_beyond_cap(table(spark, folder, "unified"), "client_id", capping.vote_balance(), "sample_index")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _beyond_cap(spark, folder).select("sample_index")


def p3_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each contributor loses."""
    return _beyond_cap(spark, folder).groupBy("client_id", "cap").agg(F.count("*").alias("dropped"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.shared_splits(table(spark, folder, "unified"), ENTITIES).select(
        F.col("a").alias("client_a"), F.col("b").alias("client_b")
    )


def p4_assigned(spark: SparkSession, folder: str) -> DataFrame:
    return splits.grouped_split(
        table(spark, folder, "unified"), "sample_index", ENTITIES, table(spark, folder, "split_targets")
    )


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_shares(p4_assigned(spark, folder), table(spark, folder, "split_targets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, folder, "synthetic_audio"), "audio_id", "text")


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.with_form(table(spark, folder, "synthetic_audio").select("audio_id", "text"), "text")


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of each row that looks like another, and how many rows it looks like."""
    found = lookalike.SameLook(table(spark, folder, "synthetic_audio"), "audio_id", "text").classes()
    return found.select(F.col("id").alias("audio_id"), "class_id", "links")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, folder, "eval_items"), table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder).select("item_id", "doc_id").distinct()


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder)


def p7_removals(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of documents to remove, over all items."""
    return leaks.removal_spans(_spans(spark, folder))


def _overlaps(spark: SparkSession, folder: str) -> overlap.Overlaps:
    return overlap.Overlaps(table(spark, folder, "unified"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).pairs().select("id_a", "id_b")


def p6_links(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps between classes of equal word sequences, each named by its smallest id."""
    links = _overlaps(spark, folder).links
    return links.select(F.col("_cid_e").alias("class_held_out"), F.col("_cid_t").alias("class_train"), "edits")


def p6_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each row with its class, and for evaluation rows the number of training classes it overlaps."""
    return _overlaps(spark, folder).counted().select(F.col("_id").alias("sample_index"), F.col("_cid").alias("class_id"), "split", "links")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation rows that stand in training, exactly or almost, by split and source."""
    unified = table(spark, folder, "unified").select(
        F.col("sample_index").alias("_id"), source_key(F.coalesce("dataset_source", F.lit(""))).alias("dataset_source")
    )
    touched = _overlaps(spark, folder).touched().join(unified, "_id")
    return touched.groupBy("split", "dataset_source").agg(
        F.count_if("exact").alias("exact_rows"), F.count_if("near").alias("near_rows"), F.count("*").alias("overlapping_rows")
    )


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).selection


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_stretches(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(p9_segments(spark, folder)).select("doc_id", "seg_no", "lang")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found,
        p1_cutoffs,
        p2_found,
        p2_counts,
        p2_collapsed,
        p3_found,
        p3_dropped,
        p4_found,
        p4_assigned,
        p4_shares,
        p5_found,
        p5_forms,
        p5_classes,
        p6_found,
        p6_links,
        p6_members,
        p6_report,
        p7_found,
        p7_spans,
        p7_removals,
        p8_selection,
        p8_shares,
        p9_found,
        p9_segments,
    )
}
