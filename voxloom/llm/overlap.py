"""Texts of evaluation splits that also stand, exactly or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import distances
from ..functions.keys import once, word_line
from ..operators.spread import hot_limit, spread_join
from ..storage import cut

#: Buckets of the word-frequency sketch: its size, and that of what is broadcast, is fixed.
SKETCH = 1 << 20
#: Bits of the map of evaluation shingles, eight a shingle between these bounds (64 MB at most), and bytes of one of its blocks.
LEAST_BITS, MOST_BITS, MAP_BLOCK = 1 << 20, 1 << 29, 1 << 14
#: Evaluation texts with one key above which its texts are joined in slices.
HOT_KEY = 1_000
#: A shingle expected in at most so many texts is rare enough to be a key.
RARE = 0.3
#: (least words, most words, most words of a shingle) of the length classes. They overlap by the
#: ratio that lengths of a pair can have, so a pair always shares a class.
CLASSES = ((4, 64, 4), (52, 256, 2), (205, 1 << 60, 1))


class Shingles:
    """Keys of a text: combinations of its rarest words such that every pair within the bound shares one.

    Words of a text are ordered by frequency, rarest first. Texts of n and m words within
    max(n, m) / 5 edits align all but n / 5 words of the one and m / 5 of the other, so the rarest
    aligned word is among the first n / 5 + 1 of both, the next among the first
    n / 5 + 2, and so on. A key is the chain of the first aligned words, as long as the expected
    number of texts with it is above RARE (or the class's longest chain). Whether a chain is
    long enough depends on its words alone, so both texts cut the same chain at the same word.
    """

    def __init__(self, counts: np.ndarray, texts: int) -> None:
        self.share = (counts.astype(np.float64) / max(1, texts)).clip(1e-12, 1.0)
        self.texts = float(max(1, texts))

    def of(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arrays text, key, words, place (of the first word, -1 if it occurs more than once)."""
        counts = np.diff(offsets)
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)
        share = self.share[hashes.view(np.uint64) & np.uint64(SKETCH - 1)]
        order = np.lexsort((hashes, share, owner))
        h, sh, pl = hashes[order], share[order], place[order]
        same_next = np.zeros(len(h), bool)
        same_next[:-1] = (h[1:] == h[:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = same_next.copy()
        twice[1:] |= same_next[:-1]
        pl = np.where(twice, -1, pl)
        out: list[tuple[np.ndarray, ...]] = []
        for least, most, longest in CLASSES:
            chosen = np.flatnonzero((counts >= least) & (counts <= most))
            if not len(chosen):
                continue
            slack = counts[chosen] // 5
            for u in np.unique(slack):
                texts = chosen[slack == u]
                out += self._chains(texts, counts[texts], offsets[:-1][texts], h, sh, pl, int(u), longest)
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        text, key, words, where = (np.concatenate(x) for x in zip(*out, strict=True))
        # one text can have a key twice: once is enough, without place then
        order = np.lexsort((where, key, text))
        text, key, words, where = text[order], key[order], words[order], where[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
        return text[first], key[first], words[first], where[first]

    def _chains(self, texts, counts, start, h, sh, pl, u: int, longest: int) -> list[tuple[np.ndarray, ...]]:
        """Level by level, the chains of all these texts that are still too frequent grow by one word."""
        out = []
        width = u + longest
        ranks = np.arange(width)
        inside = ranks[None, :] < counts[:, None]
        at = np.minimum(start[:, None] + ranks[None, :], len(h) - 1)
        H, S, P = h[at].view(np.uint64), sh[at], pl[at]
        seed = np.uint64(0x9E3779B97F4A7C15 + longest)
        row, rank = np.nonzero(inside[:, : u + 1])
        key = _mix(H[row, rank] ^ seed)
        share, where = S[row, rank], P[row, rank]
        for level in range(1, longest + 1):
            done = (share * self.texts <= RARE) if level < longest else np.ones(len(row), bool)
            if done.any():
                out.append((texts[row[done]], key[done].view(np.int64), counts[row[done]], where[done]))
            go = np.flatnonzero(~done)
            if not len(go):
                break
            row, rank, key, share, where = row[go], rank[go], key[go], share[go], where[go]
            grow = np.minimum(u + level, counts[row] - 1) - rank  # later ranks up to u + level
            total = int(grow.sum())
            src = np.repeat(np.arange(len(row)), grow)
            nxt = rank[src] + 1 + np.arange(total) - np.repeat(np.cumsum(grow) - grow, grow)
            key = _mix(key[src] * np.uint64(3) ^ H[row[src], nxt])
            share = share[src] * S[row[src], nxt]
            row, rank, where = row[src], nxt, where[src]
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _encoded(line: Column) -> Column:
    """One character for each word: words that differ may share one, so distances never grow."""
    chars = F.transform(
        F.split(line, " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xD000)) + 0x100), 4, "0")
    )
    return F.decode(F.unhex(F.array_join(chars, "")), "UTF-16BE")


def _hashes() -> Column:
    return F.transform(F.split("_line", " "), lambda w: F.xxhash64(w))


def _sketch(classes: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have a word of each bucket (at least 1), and the number of texts."""
    rows = (
        classes.select(F.explode(F.array_distinct(_hashes())).alias("w"))
        .groupBy(F.col("w").bitwiseAND(F.lit(SKETCH - 1)).cast("int").alias("bucket"))
        .agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n"))
    )
    counts = np.ones(SKETCH, np.int32)
    held = rows.toArrow()
    counts[held.column("bucket").to_numpy()] = held.column("n").to_numpy()
    return counts, classes.count()


def _keys(classes: DataFrame, shingles, bits=None) -> DataFrame:
    """(_cid, key, at, marks) of classes (_cid, _line); with ``bits`` only keys in that map.

    ``at`` holds the number of words and the place of the key, ``marks`` a bit for each of 64 groups of words, set if an odd
    number of the text's words are in the group: an edit changes two of them at most.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        maker = Shingles(*shingles.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            hashes = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
            offsets -= offsets[0]
            text, key, n, place = maker.of(hashes, offsets)
            if known is not None:
                bit = key.view(np.uint64) % np.uint64(8 * len(known))
                hit = (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                text, key, n, place = text[hit], key[hit], n[hit], place[hit]
            marks = np.bitwise_xor.reduceat(np.uint64(1) << (hashes.view(np.uint64) >> np.uint64(58)), offsets[:-1]).view(np.int64)  # no text is without words
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array(key), pa.array((n.astype(np.int64) << 32) | (place & 0xFFFFFFFF)), pa.array(marks[text])],
                names=["_cid", "key", "at", "marks"],
            )

    id_type = classes.schema["_cid"].dataType.simpleString()
    return classes.select("_cid", _hashes().alias("_words")).mapInArrow(make, f"_cid {id_type}, key bigint, at bigint, marks bigint")


def _key_map(index: DataFrame) -> bytes:
    """A bit map of the keys. Bits are brought together by block before they are merged, so no task holds or sends the whole map."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * index.count()).bit_length()))
    bit = F.pmod(F.col("key"), F.lit(size))  # the low bits, as of an unsigned number
    placed = index.select((bit / (8 * MAP_BLOCK)).cast("int").alias("block"), (bit % (8 * MAP_BLOCK)).cast("int").alias("bit"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            block, bit = block[order], bit[order]
            for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
                if len(part):
                    bits = blocks.setdefault(int(block[part[0]]), np.zeros(MAP_BLOCK, np.uint8))
                    np.bitwise_or.at(bits, bit[part] >> 3, (1 << (bit[part] & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(list(blocks), pa.int32()), "bits": pa.array([x.tobytes() for x in blocks.values()], pa.binary())}
        )

    whole = np.zeros(size // 8, np.uint8)
    for row in placed.repartition("block").mapInArrow(merge, "block int, bits binary").toLocalIterator():
        whole[row["block"] * MAP_BLOCK : (row["block"] + 1) * MAP_BLOCK] = np.frombuffer(row["bits"], np.uint8)
    return whole.tobytes()


def _met(index: DataFrame, probe: DataFrame, share: float) -> DataFrame:
    """Entries of both sides with one key, as e and t.

    A key of more than HOT_KEY evaluation texts is cut into a grid: each side into slices by text, as many as its own entries need (those
    of the training side by ``share``, its texts for one evaluation text), and sent to all slices of the other.
    """
    counted = index.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_KEY)
    hot = cut(counted.select("key", F.ceil(F.col("_n") / HOT_KEY).cast("int").alias("_e"), F.ceil(F.col("_n") * share / HOT_KEY).cast("int").alias("_t")), "hot")
    if not hot.limit(1).count():
        return index.alias("e").join(probe.alias("t"), F.col("e.key") == F.col("t.key"))

    def sliced(side: DataFrame, own: str, other: str) -> DataFrame:
        known = side.join(F.broadcast(hot), "key", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_e", "_t")})  # at most one key in HOT_KEY entries
        mine = F.pmod(F.xxhash64("_cid"), F.col(own)).cast("int").alias(f"{own}_at")
        return known.select(*side.columns, mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"))

    e, t = sliced(index, "_e", "_t").alias("e"), sliced(probe, "_t", "_e").alias("t")
    return e.join(t, (F.col("e.key") == F.col("t.key")) & (F.col("e._e_at") == F.col("t._e_at")) & (F.col("e._t_at") == F.col("t._t_at")))


def _verified(pairs: DataFrame) -> DataFrame:
    """Of pairs with both word lines the exact distance, where within the bound."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = [x.split(" ") for x in batch.column("_line_e").to_pylist()]
            b = [x.split(" ") for x in batch.column("_line_t").to_pylist()]
            got = distances(a, b).astype(np.int32)
            longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int32)
            keep = pa.array(got * 5 <= longer)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_cid_e").filter(keep), batch.column("_cid_t").filter(keep), pa.array(got).filter(keep)],
                names=["_cid_e", "_cid_t", "edits"],
            )

    kind = pairs.schema["_cid_e"].dataType.simpleString()
    return pairs.select("_cid_e", "_cid_t", "_line_e", "_line_t").mapInArrow(check, f"_cid_e {kind}, _cid_t {kind}, edits int")


class Overlaps:
    """All overlaps between a training split and evaluation splits, by word edit distance of at most a fifth.

    ``members``: (_id, _cid, split): rows with their class of equal word sequences, the class named by its
    smallest id. ``links``: (_cid_e, _cid_t, edits) between classes with evaluation and with training
    rows, a class with both linked to itself by 0 edits.

    Rows with a null split, null id, or no word never count. Evaluation shingles are indexed, training texts probe
    them (a bit map of the index drops what can't match before the shuffle), length and place
    filters and a character-coded distance thin the candidates, and the exact distance decides. Nothing is capped.
    """

    def __init__(
        self,
        rows: DataFrame,
        id_col: str = "sample_index",
        text: str = "text",
        split: str = "split",
        train: str = "train",
        evaluation: tuple[str, ...] = ("validation", "test"),
    ) -> None:
        base = rows.where(F.col(split).isin(train, *evaluation) & F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("_id"), F.col(split).alias("split"), once(word_line(F.col(text))).alias("_line")
        )
        digest = F.coalesce(F.unhex(F.md5("_line")), F.lit(b""))  # not nullable: a join needs no filter on it
        printed = base.where(F.col("_line") != "").withColumn("_print", digest)
        is_train = F.col("split") == train
        self.classes = cut(
            printed.groupBy("_print").agg(
                F.min("_id").alias("_cid"),
                F.first("_line").alias("_line"),
                F.max(is_train).alias("_t"),
                F.max(~is_train).alias("_e"),
                F.count("*").alias("_size"),
            ),
            "classes",
        )
        self.total = self.classes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
        named = self.classes.select("_print", "_cid", "_size")
        placed = spread_join(printed.select("_id", "split", "_print"), named, ["_print"], "_size", self.total, F.col("_id"))
        self.members = cut(placed.select("_id", "_cid", "split"), "members")
        self.train = train
        self.links = self._links(self.classes)

    def _links(self, classes: DataFrame) -> DataFrame:
        spark = classes.sparkSession
        longer = classes.where(F.size(F.split("_line", " ")) >= CLASSES[0][0])
        shared = spark.sparkContext.broadcast(_sketch(longer))
        index = cut(_keys(longer.where("_e"), shared), "index")
        bits = spark.sparkContext.broadcast(_key_map(index))
        probe = _keys(longer.where("_t"), shared, bits)
        held, trained = classes.agg(F.count_if("_e"), F.count_if("_t")).first()
        words = {x: F.shiftright(f"{x}.at", 32) for x in "et"}
        place = {x: F.shiftright(F.shiftleft(f"{x}.at", 32), 32) for x in "et"}
        most = F.greatest(words["e"], words["t"])
        candidates = (
            _met(index, probe, trained / max(1, held))
            .where(
                (F.col("e._cid") != F.col("t._cid"))
                & (F.abs(words["e"] - words["t"]) * 5 <= most)
                & (F.bit_count(F.col("e.marks").bitwiseXOR(F.col("t.marks"))) * 5 <= most * 2)
                & ((place["e"] < 0) | (place["t"] < 0) | (F.abs(place["e"] - place["t"]) * 5 <= most))
            )
            .select(F.col("e._cid").alias("_cid_e"), F.col("t._cid").alias("_cid_t"), most.alias("_most"))
            .distinct()
        )
        self.candidates = candidates
        left = classes.where("_e").select(F.col("_cid").alias("_cid_e"), F.col("_line").alias("_line_e"))
        right = classes.where("_t").select(F.col("_cid").alias("_cid_t"), F.col("_line").alias("_line_t"))
        near = (
            candidates.join(left, "_cid_e")
            .join(right, "_cid_t")
            .where(F.levenshtein(_encoded(F.col("_line_e")), _encoded(F.col("_line_t"))) * 5 <= F.col("_most"))
        )
        same = classes.where(F.col("_e") & F.col("_t")).select(
            F.col("_cid").alias("_cid_e"), F.col("_cid").alias("_cid_t"), F.lit(0).alias("edits")
        )
        return _verified(near).unionByName(same)

    def _expanded(self, links: DataFrame, cid: str, members: DataFrame, out: str) -> DataFrame:
        """``links`` with the rows of one side; classes of very many rows are joined in slices."""
        rows = members.select(F.col("_cid").alias(cid), F.col("_id").alias(out))
        if self.total > hot_limit(self.total):
            sized = links.join(self.classes.select(F.col("_cid").alias(cid), "_size"), cid)
            return spread_join(rows, sized, [cid], "_size", self.total, F.col(out))
        return links.join(rows, cid)

    def pairs(self) -> DataFrame:
        """(id_a, id_b, edits) of rows, id_a < id_b."""
        held = self._expanded(self.links, "_cid_e", self.members.where(F.col("split") != self.train), "_a")
        both = self._expanded(held, "_cid_t", self.members.where(F.col("split") == self.train), "_b")
        return (
            both.where(F.col("_a") != F.col("_b"))
            .select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"), "edits")
            .distinct()
        )

    def touched(self) -> DataFrame:
        """(_id, split, exact, near, links): evaluation rows that stand in training, with the number of training classes."""
        per_class = self.links.groupBy(F.col("_cid_e").alias("_cid")).agg(
            F.max(F.col("edits") == 0).alias("exact"), F.max(F.col("edits") > 0).alias("near"), F.count("*").alias("links")
        )
        return self.members.where(F.col("split") != self.train).join(per_class, "_cid").select("_id", "split", "exact", "near", "links")

    def counted(self) -> DataFrame:
        """(_id, _cid, split, links): every row with its class, evaluation rows with the number of training classes linked (else 0)."""
        per_class = self.links.groupBy(F.col("_cid_e").alias("_cid")).agg(F.count("*").alias("_links"))
        sized = per_class.join(self.classes.select("_cid", "_size"), "_cid")
        held = spread_join(self.members, sized, ["_cid"], "_size", self.total, F.col("_id"), "left")
        links = F.when(F.col("split") != self.train, F.coalesce("_links", F.lit(0))).otherwise(0).cast("bigint")
        return held.select("_id", "_cid", "split", links.alias("links"))
