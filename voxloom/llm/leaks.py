"""Evaluation passages that stand in training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .fmindex import FMIndex
from .words import WORD, words

#: Evaluation words that one block of phrases takes at most (a longer item is one block).
BLOCK_WORDS = 200_000
#: Blocks searched in one pass over the corpus: they bound what a worker holds. More items take further passes.
PASS_BLOCKS = 5
#: Words of training text that one index holds at most (a longer document is one index).
SHARD_WORDS = 1 << 19


class Phrases:
    """All phrases of ``width`` consecutive words of some items, as numbers; ``number`` goes on through the blocks of a pass."""

    def __init__(self, items: list[tuple], width: int, number: dict[str, int]) -> None:
        had = len(number)
        owners: dict[tuple, list[int]] = {}
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            seen = [number.setdefault(w, len(number) + 1) for w in words(text or "")]
            for at in range(len(seen) - width + 1):
                of = owners.setdefault(tuple(seen[at : at + width]), [])
                if not of or of[-1] != k:
                    of.append(k)
        self.new = list(number)[had:]
        self.patterns = np.array(list(owners), np.int32).reshape(-1, width)
        self.counts = np.array([len(x) for x in owners.values()], np.int64)
        self.owners = np.array([k for x in owners.values() for k in x], np.int32)


def _candidate_runs(numbers: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of runs without an unknown word that are long enough for a phrase, parted by 0; and where each stood.

    Runs end at document starts; what is left out can't hold a phrase.
    """
    known = numbers > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    at_start = starts[starts < len(numbers)]
    opens[at_start] |= known[at_start]
    begin = np.flatnonzero(opens)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run_of = np.cumsum(opens) - 1
    length = np.bincount(run_of[known], minlength=len(begin))
    long = length >= width
    keep = np.flatnonzero(known & long[np.maximum(run_of, 0)])
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(run_of[keep])) + 1
    return np.insert(numbers[keep], cuts, 0), np.insert(keep, cuts, -1)


def _hits(texts: list[str | None], blocks: list[Phrases], number: dict[str, int], width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, block, item, first word, last word + 1) of merged stretches, shard by shard."""
    get = number.get
    parts: list[list[int]] = []
    docs: list[int] = []
    held = 0

    def flush() -> Iterator[tuple[int, int, int, int, int]]:
        lengths = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.fromiter((x for p in parts for x in p), np.int64, int(starts[-1]))
        seq, origin = _candidate_runs(flat, starts[:-1], width)
        if not len(seq):
            return
        index = FMIndex(seq, len(number) + 1)
        for which, block in enumerate(blocks):
            lo, hi = index.search(block.patterns)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            counts = (hi - lo)[some]
            where = origin[index.locate(_ranges(lo[some], counts))]
            pattern = np.repeat(some, counts)
            of = block.counts[pattern]
            item = block.owners[_ranges((np.cumsum(block.counts) - block.counts)[pattern], of)]
            doc = np.searchsorted(starts, where, side="right") - 1
            at, doc = np.repeat(where - starts[doc], of), np.repeat(doc, of)
            order = np.lexsort((at, item, doc))
            at, doc, item = at[order], doc[order], item[order]
            opens = np.ones(len(at), bool)
            opens[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + width)
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(at)) - 1
            for d, k, x, y in zip(doc[first].tolist(), item[first].tolist(), at[first].tolist(), (at[last] + width).tolist(), strict=True):
                yield docs[d], which, k, x, y

    for row, text in enumerate(texts):
        if text is None:
            continue
        seen = [get(w, 0) for w in words(text)]
        if len(seen) < width:
            continue
        if parts and held + len(seen) > SHARD_WORDS:
            yield from flush()
            parts, docs, held = [], [], 0
        parts.append(seen)
        docs.append(row)
        held += len(seen)
    if parts:
        yield from flush()


def _ranges(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(start, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_WORDS words (or one item), read in order of id."""
    block, held = [], 0
    for row in items.select(item_id, text).where(F.col(text).isNotNull()).orderBy(item_id).toLocalIterator():
        n = len(words(row[1]))
        if block and held + n > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += n
    if block:
        yield block


def _passes(items: DataFrame, item_id: str, text: str) -> Iterator[list[list[tuple]]]:
    held: list[list[tuple]] = []
    for block in _blocks(items, item_id, text):
        held.append(block)
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


def leaked_spans(
    items: DataFrame,
    documents: DataFrame,
    item_id: str = "item_id",
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 8,
) -> DataFrame:
    """Stretches of documents that repeat ``width`` or more consecutive words of an item.

    Gives (item id, doc id, start, end, words): character offsets of the merged removal span
    in the document's text, and its words. Null and shorter texts share nothing.

    Each Arrow batch of documents is a shard with an FM-index of its words; all phrases of the items
    are searched backwards through wavelet-matrix ranks, located by sampled suffix
    positions and merged. Words that no item has end a stretch, so only runs of
    known words that could hold a phrase are indexed. Items are a query set in blocks of bounded size; PASS_BLOCKS of
    them are searched in one pass over the corpus, in one index.
    """
    id_type = documents.schema[doc_id].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    schema = f"_item {item_type}, _doc {id_type}, start int, end int, words int"
    item_arrow = to_arrow_type(items.schema[item_id].dataType)
    docs = documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    spark, out = documents.sparkSession, None
    for blocks in _passes(items, item_id, text):
        number: dict[str, int] = {}
        shared = [spark.sparkContext.broadcast(Phrases(b, width, number)) for b in blocks]

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = [b.value for b in shared]
            number = {w: i for i, w in enumerate((w for b in held for w in b.new), 1)}
            for batch in batches:
                texts, ids = batch.column(1).to_pylist(), batch.column(0)
                rows, cols = [], ([], [], [], [])
                places: dict[int, list[tuple[int, int]]] = {}
                for row, block, item, first, last in _hits(texts, held, number, width):
                    if row not in places:
                        places[row] = _offsets(texts[row])
                    rows.append(row)
                    found = (held[block].ids[item], places[row][first][0], places[row][last - 1][1], last - first)
                    for c, x in zip(cols, found, strict=True):
                        c.append(x)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], item_arrow), ids.take(pa.array(rows)), *(pa.array(c, pa.int32()) for c in cols[1:])],
                        names=["_item", "_doc", "start", "end", "words"],
                    )

        part = docs.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("_item").alias(item_id), F.col("_doc").alias(doc_id), "start", "end", "words")


def removal_spans(spans: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """(doc id, start, end, items): the stretches to remove from each document, spans of all items merged where they touch or overlap.

    ``items`` is the number of items with a span in the stretch. A document's spans are sorted in one task.
    """
    order = Window.partitionBy(doc_id).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    numbered = spans.withColumn("_opens", opens).withColumn("_no", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(doc_id, "_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct(item_id).alias("items")).drop("_no")


def _offsets(text: str) -> list[tuple[int, int]]:
    """Where each word stands; lower case can lengthen a text, so positions are traced back through it."""
    lowered = text.lower()
    if len(lowered) == len(text):
        return [m.span() for m in WORD.finditer(lowered)]
    back = [i for i, ch in enumerate(text) for _ in ch.lower()]
    back += [len(text)] * (len(lowered) + 1 - len(back))
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer(lowered)]
