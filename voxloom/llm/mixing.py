"""Mixtures in which each source has a target share of the tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.keys import source_key
from ..operators.spread import boundary_rows, range_sorted
from ..storage import cut
from .labels import language_of_label

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The most sources a mixture can name; their leaves are planned on the driver.
MOST_SOURCES = 10_000


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    """The byte-level BPE of the contents of a file of ranks."""
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def tokenizer_of(path: str) -> tuple[bytes, str]:
    """A file of ranks and the pattern that parts text for it, as the driver finds them."""
    import public_tokenizers

    return Path(path).read_bytes(), public_tokenizers.PATTERN


def with_tokens(rows: DataFrame, text: str, out: str = "tokens", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``rows`` without ``text`` but with its number of tokens; null counts as 0.

    The driver reads the file of ranks (a megabyte or so) and ships it, so executors need no copy.
    """
    at = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if i != at]
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer_of(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(*shared.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(sizes, pa.int64())], names=[*(batch.schema.names[i] for i in kept), out]
            )

    return rows.mapInArrow(count, T.StructType([*(rows.schema.fields[i] for i in kept), T.StructField(out, T.LongType())]))


def domain_of_source(source: Column) -> Column:
    """The part of a source's name before its first underscore."""
    return F.substring_index(source, "_", 1)


class Tree:
    """A node with a wanted size, a capacity, and children; leaves carry their (domain, language, source)."""

    def __init__(self, name: tuple = (), capacity: int = 0, wanted: float = 0.0) -> None:
        self.name, self.own, self.wanted = name, capacity, wanted
        self.children: list[Tree] = []
        self.given = 0.0

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children) if self.children else self.own

    def weight(self) -> float:
        return sum(c.weight() for c in self.children) if self.children else self.wanted

    def room(self) -> float:
        return sum(c.room() for c in self.children) if self.children else self.own - self.given

    def fill(self, size: float) -> float:
        """Hand ``size`` down in proportion to the weights; give back what no leaf below can take.

        What a child can't take goes to its siblings with room, in proportion to their weights;
        only what they can't take either goes back to the parent.
        """
        if not self.children:
            took = min(size, self.own - self.given)
            self.given += took
            return size - took
        left = size
        while left > 1e-6:
            open_ = [c for c in self.children if c.room() > 1e-6 and c.weight() > 0]
            total = sum(c.weight() for c in open_)
            if not open_:
                break
            back = 0.0
            for c in open_:
                back += c.fill(left * c.weight() / total)
            if back >= left:
                break
            left = back
        return left

    def leaves(self) -> Iterator[Tree]:
        if not self.children:
            yield self
        for c in self.children:
            yield from c.leaves()


def plan(leaves: list[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[str, str, str], int]:
    """Token budgets of leaves (domain, language, source, available tokens) for ``total`` tokens.

    A source's share is split over its languages by what they hold. Shortages go to
    siblings (sources of the same domain and language), then to other languages of the domain, then to other domains.
    """
    held: dict[str, int] = {}
    for _, _, source, size in leaves:
        held[source] = held.get(source, 0) + size
    root, nodes = Tree(), {}
    shares = sum(s for s, _ in targets.values())
    for domain, language, source, size in sorted(leaves):
        share, repeats = targets[source]
        if size <= 0 or share <= 0 or repeats <= 0:
            continue
        top = nodes.setdefault((domain,), Tree((domain,)))
        mid = nodes.setdefault((domain, language), Tree((domain, language)))
        if top not in root.children:
            root.children.append(top)
        if mid not in top.children:
            top.children.append(mid)
        mid.children.append(Tree((domain, language, source), size * repeats, share / shares * total * size / held[source]))
    if root.children:
        # every leaf first gets its own part, then shortages move
        short = {}
        for leaf in list(root.leaves()):
            short[leaf.name] = leaf.fill(leaf.wanted)
        spare = total - sum(x.wanted for x in root.leaves())
        for domain in root.children:
            above = 0.0
            for language in domain.children:
                above += language.fill(sum(short[x.name] for x in language.leaves()))
            spare += domain.fill(above)
        root.fill(spare)
    return {x.name: round(x.given) for x in root.leaves()} if root.children else {}


class Mixture:
    """``report``: a row for each target source; ``selection``: (doc, epoch, source, tokens, taken).

    Sources are compared without case and outer blanks. The total is ``total`` tokens, or
    what the target sources hold once. Each source gets its share of the total, at most max_repeats times its tokens;
    shortages (also of absent sources) move to siblings before ancestors' other children. A
    leaf takes whole epochs and then a prefix, in seeded order, of one more; of the last document only the
    tokens that are left are taken, so shares are exact. Null and empty texts have no tokens;
    duplicate targets of a source add their shares and take the largest max_repeats.
    """

    def __init__(
        self,
        documents: DataFrame,
        targets: DataFrame,
        id_col: str = "doc_id",
        text: str = "text",
        source: str = "source",
        label: str = "lang",
        total: int | None = None,
        seed: int = 42,
        tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}",
    ) -> None:
        spark = documents.sparkSession
        given = (
            targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
            .where(F.col("source").isNotNull() & (F.col("target_share") > 0))
            .groupBy("source")
            .agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).cast("int").alias("max_repeats"))
        )
        wanted = given.limit(MOST_SOURCES + 1).collect()
        if len(wanted) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        goals = {r["source"]: (r["target_share"], r["max_repeats"]) for r in wanted}
        chosen = documents.select(
            F.col(id_col).alias("_doc"), source_key(F.col(source)).alias("source"), F.coalesce(language_of_label(F.col(label)), F.lit("und")).alias("language"), F.col(text).alias("_text")
        ).where(F.col("_doc").isNotNull() & F.col("source").isin(*goals)) if goals else documents.limit(0).select(
            F.col(id_col).alias("_doc"), F.lit("").alias("source"), F.lit("").alias("language"), F.col(text).alias("_text")
        )
        sized = cut(with_tokens(chosen, "_text", path=tokenizer).where("tokens > 0").withColumn("domain", domain_of_source(F.col("source"))), "tokens")
        leaf = ["domain", "language", "source"]
        held = [tuple(r) for r in sized.groupBy(*leaf).agg(F.sum("tokens")).collect()]
        size = sum(h[3] for h in held) if total is None else total
        budgets = plan(held, goals, size)
        rows = [(*h[:3], h[3], b := budgets.get(tuple(h[:3]), 0), b // h[3], b % h[3]) for h in held]
        planned = spark.createDataFrame(rows, "domain string, language string, source string, available bigint, budget bigint, full bigint, goal bigint")
        joined = sized.join(F.broadcast(planned.select(*leaf, "full", "goal")), leaf)
        whole = joined.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1))).select(
            *leaf, "_doc", "epoch", "tokens", F.col("tokens").alias("taken")
        )
        partial = joined.where("goal > 0").withColumn("_order", F.xxhash64(F.lit(seed), F.col("full"), F.col("_doc")))
        order = [F.col("_order"), F.col("_doc")]
        ranged = range_sorted(partial, leaf, order)
        last = boundary_rows(ranged.select(*leaf, "_order", "_doc", "tokens", "_part"), leaf, order, planned, "tokens", few=True).select(
            *leaf, F.col("_order").alias("_lo"), F.col("_doc").alias("_ld"), "_before"
        )
        before = (F.col("_order") < F.col("_lo")) | ((F.col("_order") == F.col("_lo")) & (F.col("_doc") < F.col("_ld")))
        prefix = (
            ranged.join(F.broadcast(last), leaf)
            .where(before | ((F.col("_order") == F.col("_lo")) & (F.col("_doc") == F.col("_ld"))))
            .select(*leaf, "_doc", F.col("full").alias("epoch"), "tokens", F.when(before, F.col("tokens")).otherwise(F.col("goal") - F.col("_before")).alias("taken"))
        )
        picked = whole.unionByName(prefix)
        self.selection = picked.select(F.col("_doc").alias(id_col), "source", "language", "epoch", "tokens", "taken")
        taken = picked.groupBy("source").agg(F.sum("taken").alias("taken"), (F.max("epoch") + 1).alias("epochs"))
        have = planned.groupBy("source").agg(F.sum("available").alias("available"))
        targets_now = spark.createDataFrame([(s, a, b) for s, (a, b) in goals.items()], "source string, target_share double, max_repeats int")
        everything = F.sum(F.coalesce("taken", F.lit(0))).over(Window.partitionBy())  # a row a target source
        self.report = (
            targets_now.join(have, "source", "left")
            .join(taken, "source", "left")
            .withColumn("_all", everything)
            .select(
                "source", "target_share", "max_repeats",
                F.coalesce("available", F.lit(0)).alias("available_tokens"),
                F.coalesce("taken", F.lit(0)).alias("taken_tokens"),
                F.coalesce("epochs", F.lit(0)).alias("epochs"),
                F.when(F.col("_all") > 0, F.coalesce("taken", F.lit(0)) / F.col("_all")).alias("actual_share"),
            )
        )
