"""Splits that keep records sharing any entity together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import filled_key
from ..operators.spread import spread_join
from ..storage import cut, discard

#: The number of entity types that can be told apart by one character.
TYPES = "abcdefghijklmnopqrstuvwxyz"


def entity_nodes(entities: Sequence[tuple[str, Sequence[str]]]) -> list[Column]:
    """Node names 'a:...', 'b:...' of (column, values that bind nothing); null where blank or unbinding."""
    nodes = []
    for kind, (column, ignored) in zip(TYPES, entities, strict=False):
        key = filled_key(F.col(column))
        bound = F.when(~key.isin(*ignored), key) if ignored else key
        nodes.append(F.concat(F.lit(f"{kind}:"), bound))
    return nodes


def _star(edges: DataFrame, small: bool, count: int) -> DataFrame:
    """One large-star (or small-star) step over ``count`` edges (lo, hi) with lo < hi; the edges read are deleted."""
    smaller = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    near = smaller if small else smaller.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    # each node's smallest neighbour or itself, over all neighbours or (small) the smaller ones
    least = cut(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_size")), "minima")
    joined = spread_join(near, least, ["u"], "_size", count if small else 2 * count, F.col("v"))
    if small:
        linked = joined.select("m", F.col("v").alias("n")).unionByName(least.select("m", F.col("u").alias("n")))
    else:
        linked = joined.where(F.col("v") > F.col("u")).select("m", F.col("v").alias("n"))
    made = cut(linked.where(F.col("m") < F.col("n")).select(F.col("m").alias("lo"), F.col("n").alias("hi")).distinct(), "edges")
    discard(least, edges)
    return made


def _state(edges: DataFrame) -> tuple:
    """The number of edges and a sum that tells one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) as (node, component), the component being its smallest node.

    Alternates large-star and small-star until the edges no longer change; each
    step's edges are a written table. Self-loops and null ends are ignored; nodes
    without an edge don't come out. The step's joins cut hot nodes into slices.
    """
    now = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .distinct(),
        "edges",
    )
    state = _state(now)
    for _ in range(rounds):
        wide = _star(now, False, state[0])
        now = _star(wide, True, wide.count())
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError(f"components didn't converge in {rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def entity_components(rows: DataFrame, entities: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Components of the entities that rows bind together; entities alone in their rows are left out."""
    nodes = entity_nodes(entities)
    pairs = [
        rows.select(a.alias("a"), b.alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
        for i, a in enumerate(nodes)
        for b in nodes[i + 1 :]
    ]
    edges = pairs[0]
    for p in pairs[1:]:
        edges = edges.unionByName(p)
    return components(edges)


def shared_splits(rows: DataFrame, entities: Sequence[tuple[str, Sequence[str]]], first: int = 0) -> DataFrame:
    """Entities of one type that must share a split, as (a, b): a is the group's smallest, one row for each other b."""
    kind = TYPES[first]
    linked = entity_components(rows, entities).where(F.col("node").startswith(f"{kind}:"))
    if first == 0:  # names of the first type sort before all others, so the component is one of them
        named = linked.withColumn("a", F.col("component"))
    else:
        firsts = linked.groupBy("component").agg(F.min("node").alias("a"))
        named = linked.join(firsts, "component")
    return named.where(F.col("node") != F.col("a")).select(F.expr("substr(a, 3)").alias("a"), F.expr("substr(node, 3)").alias("b"))


def grouped_split(
    rows: DataFrame,
    id_col: str,
    entities: Sequence[tuple[str, Sequence[str]]],
    shares: DataFrame,
    seed: int = 42,
) -> DataFrame:
    """A split for every row (id, component, split): rows that share an entity, directly or not, get one split.

    ``shares`` has ``split`` and ``share``; shares are scaled to sum to 1, null or
    non-positive ones count as 0, and no share at all gives null splits. The hash of the
    component (of the id for rows without entity) chooses the range of a split, so a
    component's size moves the shares reached; ``split_shares`` reports them.
    """
    nodes = entity_nodes(entities)
    comps = entity_components(rows, entities)
    named = rows.select(
        F.col(id_col).alias("_id"), F.coalesce(*nodes, F.concat(F.lit("~:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("node")
    )
    used = named.groupBy("node").agg(F.count("*").alias("_size"))
    table = cut(used.join(comps, "node"), "components")
    total = table.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    placed = spread_join(named, table, ["node"], "_size", total, F.col("_id"), "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    point = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), "component")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return placed.select(F.col("_id").alias(id_col), "component", _range_of(point, shares).alias("split"))


def _range_of(point: Column, shares: DataFrame) -> Column:
    """The split whose range of [0, 1) holds the point; ``shares`` are a few parameters, at most 1000."""
    given = shares.where(F.col("share") > 0).groupBy("split").agg(F.sum("share").alias("share")).orderBy("split").limit(1001).collect()
    if len(given) > 1000:
        raise ValueError("more than 1000 splits")
    total, upto, choice = sum(r["share"] for r in given), 0.0, None
    for r in given:
        upto += r["share"] / total
        last = r is given[-1]
        test = F.lit(True) if last else point < upto
        choice = F.when(test, r["split"]) if choice is None else choice.when(test, r["split"])
    return choice if choice is not None else F.lit(None).cast("string")


def split_shares(assigned: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows, components and share of each split, next to the share wanted."""
    got = assigned.groupBy("split", "component").agg(F.count("*").alias("_n")).groupBy("split").agg(
        F.sum("_n").alias("rows"), F.count("*").alias("components")
    )
    whole = Window.partitionBy()
    return got.join(shares.select("split", "share"), "split", "left").select(
        "split",
        F.col("share").alias("target_share"),
        "rows",
        "components",
        (F.col("rows") / F.sum("rows").over(whole)).alias("actual_share"),
    )
