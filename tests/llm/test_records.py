"""Cutoffs, copies, caps, splits: against brute force and on edge rows."""

import json
import math
import random
from collections import defaultdict
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from voxloom.llm import capping, collapse, cutoff, splits
from voxloom.operators import spread


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(params=[10_000, 5], ids=["plain", "hot"])
def hot(request, monkeypatch):
    """The second time every key above five rows is cut into slices."""
    monkeypatch.setattr(spread, "HOT_LEAST", request.param)


SCORES = "sample_index bigint, similarity double, voice string, model string, scored_at timestamp, valid string, goal int"


def test_cutoffs(spark, hot):
    rng, at = random.Random(1), datetime(2025, 1, 1)
    data = []
    for i in range(400):
        s = rng.choice([None, math.nan, 7.0, 0.5, 0.5, rng.random(), rng.random()])
        voice = rng.choice(["a", " A", "b", None]) if i > 130 else "a"
        for k in range(rng.choice([1, 1, 2])):
            data.append((i, s if k == 0 else rng.random(), voice, "M ", at + timedelta(hours=k), "x", 1))
        data.append(data[-1])
    targets = [("m", "A", 0.25), ("m", "b", 0.333333333), ("m", "c", 0.5), ("m", None, 0.5), ("m", "d", None)]
    rng.shuffle(data)
    got = cutoff.cutoff_for_fraction(spark.createDataFrame(data, SCORES), spark.createDataFrame(targets, "model string, voice string, keep_fraction double"))
    last = {}
    for r in data:
        if r[0] not in last or r[4] > last[r[0]][4]:
            last[r[0]] = r
    expected, cuts = set(), {}
    for v, f in (("a", "0.25"), ("b", "0.333333333")):
        valid = sorted((r[1], r[0]) for r in last.values() if r[2] and r[2].strip().lower() == v and r[1] is not None and 0 <= r[1] <= 1)
        k = math.ceil(Fraction(f) * len(valid))
        cuts[v] = (len(valid), valid[-k][0], sum(s >= valid[-k][0] for s, _ in valid))
        expected |= {i for s, i in valid if s >= valid[-k][0]}
    assert {r["sample_index"] for r in got.kept.collect()} == expected and got.kept.count() == len(expected)
    report = {r["voice"]: (r["valid"], r["cutoff"], r["kept"]) for r in got.report.collect()}
    assert report == {**cuts, "c": (0, None, 0)}


def test_cutoffs_of_nothing(spark):
    none = spark.createDataFrame([], SCORES)
    targets = spark.createDataFrame([("m", "a", 0.5)], "model string, voice string, keep_fraction double")
    got = cutoff.cutoff_for_fraction(none, targets)
    assert got.kept.count() == 0 and rows(got.report) == [("m", "a", 0.5, 0, None, 0)]
    one = spark.createDataFrame([(1, 0.5, "a", "m", None, "x", 1), (None, 0.9, "a", "m", None, "x", 1)], SCORES)
    assert [r[0] for r in cutoff.cutoff_for_fraction(one, targets).kept.select("sample_index").collect()] == [1]
    zero = targets.withColumn("keep_fraction", F.lit(0.0))
    assert cutoff.cutoff_for_fraction(one, zero).kept.count() == 0
    over = targets.withColumn("keep_fraction", F.lit(3.0))
    assert cutoff.cutoff_for_fraction(one, over).kept.count() == 1


def test_text_copies(spark, hot):
    data = [(5, "Ab c"), (3, "a-B  C!"), (9, "abd"), (1, None), (2, "?!"), (4, ""), (7, "STRASSE 1"), (6, "stra\u00dfe 1"), (8, "\u00c0B"), (10, "ab")]
    data += [(100 + i, "same " + "text" * (i % 2 + 1)) for i in range(40)]
    df = spark.createDataFrame([(i, t, i) for i, t in data], "id int, text string, value int")
    got = set(rows(collapse.collapse_copies(df, "id", collapse.text_fields("text"))))
    expected = {(3, 5), (6, 7)} | {(100, 100 + i) for i in range(2, 40, 2)} | {(101, 100 + i) for i in range(3, 40, 2)}
    assert got == expected
    counts = dict(rows(collapse.copy_counts(collapse.collapse_copies(df, "id", collapse.text_fields("text")))))
    assert counts == {3: 2, 6: 2, 100: 20, 101: 20}


def test_collapsed(spark):
    df = spark.createDataFrame([(5, "Ab c"), (3, "a-B  C!"), (9, "abd"), (1, None), (2, "?!"), (4, "?!"), (8, "abc")], "id int, text string")
    found = collapse.collapse_copies(df, "id", collapse.text_fields("text"))
    assert dict(rows(collapse.collapsed(df, "id", found))) == {3: 3, 9: 1, 1: 1, 2: 1, 4: 1}
    assert dict(rows(collapse.collapsed(df, "id", found.limit(0)))) == dict.fromkeys((5, 3, 9, 1, 2, 4, 8), 1)


def test_record_copies(spark):
    base = {"text": "Een zin.", "voice": "amber", "up_votes": 3, "model": None}
    texts = [
        json.dumps(base),
        json.dumps(dict(reversed(base.items())), indent=2),
        "voice: AMBER\r\n  text: een,zin\n\nUp_Votes: 3\nmodel:",
        json.dumps({k: v for k, v in base.items() if k != "model"}),  # a field less
        json.dumps(base | {"up_votes": 30}),
        json.dumps({"text": "amber", "voice": "Een zin.", "up_votes": 3, "model": None}),  # values swapped
        '{"text": broken',
        '{"text": broken',
        None,
        "",
        "a: x: y\na: x: y\nb: 1",  # a repeated field
        "b: 1\na: x y",
        "b: 1\na: xy\na: X Y",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = rows(collapse.collapse_copies(df, "id", collapse.record_fields("text")))
    assert got == [(0, 1), (0, 2), (10, 12), (6, 7)]
    assert rows(collapse.collapse_copies(df.limit(0), "id", collapse.record_fields("text"))) == []


def test_colliding_fingerprints(spark, monkeypatch):
    """Equal fingerprints of different fields are told apart."""
    monkeypatch.setattr(collapse, "_fingerprint", lambda f: [F.lit(1).alias("_f1"), F.lit(2).alias("_f2")])
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "B"), (4, "a!"), (5, "c"), (6, "b.")], "id int, text string")
    assert rows(collapse.collapse_copies(df, "id", collapse.text_fields("text"))) == [(1, 4), (2, 3), (2, 6)]


@pytest.mark.parametrize("share,most", [(0.05, None), (None, 7), (0.01, 3)])
def test_caps(spark, share, most):
    rng, data = random.Random(2), []
    for i in range(600):
        who = rng.choice(["x", "X ", " x", "y", "z", None, "", "  "]) if i % 3 else "x"
        data.append((i, who, rng.choice([None, -2, 0, 1, 5, 100, 10**6]), rng.choice([None, -1, 0, 3]), i, 0))
    df = spark.createDataFrame(data, "id int, who string, up_votes bigint, down_votes bigint, quality int, cap int")
    got = capping.drop_beyond_cap(df, "who", capping.vote_balance(), "id", share, most)
    groups = defaultdict(list)
    for i, who, u, d, *_ in data:
        if who and who.strip():
            groups[who.strip().lower()].append((-(max(u or 0, 0) - max(d or 0, 0)), i))
    caps = ([max(1, int(Fraction(str(share)) * sum(map(len, groups.values()))))] if share else []) + ([most] if most else [])
    expected = {i for g in groups.values() for _, i in sorted(g)[min(caps):]}
    found = [r["id"] for r in got.collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert capping.drop_beyond_cap(df.limit(0), "who", capping.vote_balance(), "id", share, most).count() == 0


def test_bins_never_fall(spark):
    values = sorted({s * v for s in (-1, 1) for k in range(62) for v in (2**k - 1, 2**k, 2**k + 1, 3 * 2 ** max(0, k - 2))})
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", capping.quality_bin(F.col("v")).alias("b")).orderBy("v")
    bins = [r["b"] for r in df.collect()]
    assert bins == sorted(bins)


ENTITIES = (("client_id", ()), ("voice", ("common_voice",)))


def components_of(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(root):
        groups[find(x)].add(x)
    return groups.values()


def test_components(spark, hot):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(80):02}", f"n{rng.randrange(80):02}") for _ in range(45)]
    pairs += [(f"p{i:03}", f"p{i + 1:03}") for i in range(24)] + [("hub", f"h{i}") for i in range(60)]
    df = spark.createDataFrame([*pairs, ("self", "self"), (None, "q")], "a string, b string")
    got = dict(splits.components(df).collect())
    expected = {x: min(g) for g in components_of([p for p in pairs if p[0] != p[1]]) for x in g}
    assert got == expected and splits.components(df).count() == len(expected)
    assert splits.components(df.limit(0)).count() == 0


def test_splits(spark, hot):
    data = [("A", "v1"), (" a ", "v2"), ("b", "V2"), ("c", "v2 "), ("d", "Common_Voice"), ("e", "common_voice"), ("f", None), (None, "v1"), ("", "v9"), (None, None), ("g", "v7"), ("b", "v3"), ("h", "v3")]
    df = spark.createDataFrame([(i, c, v, "old", "x") for i, (c, v) in enumerate(data)], "sample_index int, client_id string, voice string, split string, component string")
    assert rows(splits.shared_splits(df, ENTITIES)) == [("a", "b"), ("a", "c"), ("a", "h")]
    assert rows(splits.shared_splits(df, ENTITIES, 1)) == [("v1", "v2"), ("v1", "v3")]
    shares = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1), ("none", None)], "split string, share double")
    many = df.unionByName(spark.range(4000).select((F.col("id") + 100).cast("int").alias("sample_index"), F.concat(F.lit("k"), "id").alias("client_id"), F.lit(None).cast("string").alias("voice"), F.lit("o").alias("split"), F.lit("").alias("component")))
    got = splits.grouped_split(many, "sample_index", ENTITIES, shares)
    by = {r["sample_index"]: (r["component"], r["split"]) for r in got.collect()}
    assert len(by) == got.count() == many.count()
    assert len({by[i] for i in (0, 1, 2, 3, 7, 11, 12)}) == 1 and by[4][0] != by[5][0]
    reached = {r["split"]: r["actual_share"] for r in splits.split_shares(got, shares).collect()}
    assert reached["train"] == pytest.approx(0.8, abs=0.03) and reached["test"] == pytest.approx(0.1, abs=0.03)
    nothing = splits.grouped_split(df, "sample_index", ENTITIES, shares.limit(0))
    assert {r["split"] for r in nothing.collect()} == {None}
    assert splits.grouped_split(df.limit(0), "sample_index", ENTITIES, shares).count() == 0
