import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import corrupt, histogram, joins, ordered, report, scorer, spread, subsets
from voxloom import storage
from voxloom.functions import losses, scoring
from voxloom.storage import cut, shared_dir


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    back = cut(df, "t")
    assert back.schema == df.schema and rows(back) == rows(df)
    assert "Scan parquet" in back._jdf.queryExecution().executedPlan().toString()
    assert rows(cut(df.limit(0), "t")) == []


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT_LEAST", 10)
    left = spark.range(200).select(F.when(F.col("id") < 150, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    table = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = spread.spread_join(left, table, ["k"], "n", 200, F.col("id"))
    assert got.columns == ["k", "id", "first"]
    assert rows(got) == rows(left.join(table.drop("n"), "k"))
    gone = spread.spread_join(left, table.where("k <> 'hot'"), ["k"], "n", 200, F.col("id"), "left")
    assert gone.count() == 200 and gone.where("first IS NULL").count() == 150


@pytest.mark.parametrize("few", [None, True, False])
def test_boundary_rows(spark, few):
    df = spark.createDataFrame([("a", i % 3, i) for i in range(30)] + [("b", 0, 100)], "k string, s int, id int")
    order = [F.col("s").desc(), F.col("id")]
    ranged = spread.range_sorted(df, ["k"], order)
    goals = spark.createDataFrame([("a", 12), ("b", 1), ("c", 1), ("b", 0)], "k string, goal bigint")
    got = spread.boundary_rows(ranged, ["k"], order, goals, few=few).select("k", "s", "id", "_before")
    assert rows(got) == [("a", 1, 4, 11), ("b", 0, 100, 0)]
    weights = spark.createDataFrame([("a", 25)], "k string, goal bigint")
    heavy = spread.range_sorted(df.withColumn("w", F.lit(10)), ["k"], order)
    assert rows(spread.boundary_rows(heavy, ["k"], order, weights, "w").select("id", "_before")) == [(8, 20)]


def test_corruption(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, "", "een", "a b", "a b c d e"] * 20)], "id int, text string, strategy_of string")
    for s in (*corrupt.STRATEGIES, None):
        for r in corrupt.with_corruption(df, "text", "id", s).collect():
            if r["text"] is None:
                assert r["corrupted"] is None
            elif len(r["text"].split()) <= 1:
                assert r["strategy"] == "append" and r["correctness"] == 0.5
            else:
                assert 0 <= r["correctness"] <= 1
            if s == "shuffle" and r["text"] == "a b":
                assert r["corrupted"] == "a b" and r["correctness"] == 1.0


def test_validation(spark):
    c = spark.createDataFrame([(1, "a b", 2), (2, "A b ", 2), (3, "a", 2), (4, None, 2), (5, " ", 2), (6, "c d", 2)], "arrival int, s string, wc int")
    got = {r["arrival"]: r["reason"] for r in histogram.validate(c, "s", "wc", "arrival").collect()}
    assert got == {1: None, 2: "duplicate", 3: "wrong_word_count", 4: "format_error", 5: "format_error", 6: None}
    quotas = spark.createDataFrame([(2, 1)], "wc int, quota int")
    assert rows(histogram.within_quota(c, "wc", "arrival", quotas).select("arrival")) == [(1,)]


def test_histograms(spark):
    a = spark.createDataFrame([(1, 4), (2, 0)], "wc int, target bigint")
    b = spark.createDataFrame([(1, 1), (3, 2)], "wc int, generated bigint")
    assert rows(histogram.compare(a, b)) == [(1, 4, 1, 25.0, 3), (2, 0, 0, 0.0, 0), (3, 0, 2, 0.0, -2)]
    n = spark.createDataFrame([(1, 4), (2, 4)], "wc int, n bigint")
    assert histogram.bhattacharyya(n, n).first()[0] == pytest.approx(1.0)
    assert histogram.bhattacharyya(n, n.limit(0)).first()[0] == 0.0


def test_text_matching(spark):
    left = spark.createDataFrame([(1, " Dag "), (2, None), (3, ""), (4, "  "), (5, "x")], "id int, text string")
    right = spark.createDataFrame([("dag",), ("dag",), (None,), (" ",)], "text string")
    assert rows(joins.match_text(left, right, "text").select("id")) == [(1,), (4,)]
    assert rows(joins.match_text(left, right, "text", keep="unmatched").select("id")) == [(2,), (3,), (5,)]
    s = joins.match_statistics(left, right, "text").first()
    assert (s["rows"], s["matched"], s["rate"]) == (5, 2, 40.0)
    assert joins.match_statistics(left.limit(0), right, "text").first()["rate"] == 0.0


def test_audio_joins(spark):
    t = spark.createDataFrame([(1, "a", "v", "m", "d/x.mp3"), (2, "a", "w", "m", None), (3, None, "v", "m", "y.mp3")], "id int, text string, voice string, model string, audio string")
    names = [r[0] for r in t.select(joins.audio_filename(F.lit("a"), F.lit("w"), F.lit("m"))).limit(1).collect()]
    files = spark.createDataFrame([(names[0], 5), (names[0], 7), ("x.mp3", 1)], "filename string, file_size bigint")
    assert rows(joins.locate_audio(t, files, ("v", "w"), "id", "text", "model").select("id", "voice", "file_size")) == [(1, "w", 7), (2, "w", 7), (3, None, None)]
    assert rows(joins.orphans(files, t, "text", "voice", "model").select("filename")) == [("x.mp3",)]
    verdicts = {r["id"]: r["verdict"] for r in joins.integrity(t, files, "id", "text", "voice", "model", "audio").collect()}
    assert verdicts == {1: "mismatch", 2: "no_audio", 3: "mismatch"}
    last = joins.attach_last(t.select("id", "text"), spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "text string, n int, s string"), "text", "n", ["s"], {"s": "failed"})
    assert rows(last.select("id", "s")) == [(1, "new"), (2, "new"), (3, "failed")]
    again = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    assert joins.select_by_index(t, again, "id").count() == 1 and joins.select_by_index(t, again, "id", repeats=True).count() == 2


def test_reports(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,), (None,), (math.nan,)], "s double")
    d = report.describe(df, F.col("s")).first()
    assert (d["count"], d["median"], d["p25"]) == (3, 0.5, pytest.approx(0.3))
    assert rows(report.band_distribution(df, F.col("s")).select("band", "rows")) == [("high", 1), ("low", 1), ("medium", 1)]
    assert rows(report.band_distribution(df.limit(0), F.col("s")).select("pct")) == [(0.0,)] * 3
    f = report.filter_statistics(df, F.col("s")).first()
    assert (f["total_samples"], f["filtered_samples"]) == (5, 1)
    one = df.limit(1).union(df.limit(1))
    assert rows(report.cut_bins(one, F.col("s"), 3, F.col("s")).select("bin", "rows")) == [(0, 2), (1, 0), (2, 0)]
    ten = spark.createDataFrame([(float(i),) for i in range(11)], "s double")
    assert rows(report.cut_bins(ten, F.col("s"), 5, F.col("s")).select("rows")) == [(2,), (2,), (2,), (2,), (3,)]
    assert rows(report.histogram_bins(ten, F.col("s"), 5)) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]
    assert report.correlations(one, [("x", F.col("s"), F.col("s"))]).first()["r"] is None
    empty = report.evaluation_bundle(ten.limit(0), *[F.col("s")] * 4).first()
    assert set(empty) == {0.0}
    gap = 0.7276524305 - 0.3437666893
    pair = spark.createDataFrame([(0.7276524305, 0.3437666893, 0.2191058099, 0.1098731831)], "p double, n double, a double, b double")
    e = report.evaluation_bundle(pair, *[F.col(c) for c in "pnab"]).first()
    assert e["similarity_gap"] == pytest.approx(gap) and e["alignment_gap"] == pytest.approx(0.1092326269, abs=1e-9)


def test_ordered(spark):
    df = spark.range(100, numPartitions=7).select((F.col("id") * 37 % 101).alias("v"))
    placed = ordered.global_position(df, [F.col("v")])
    assert [r["position"] for r in placed.orderBy("v").collect()] == list(range(100))
    timed = spark.range(20).select("id", F.timestamp_seconds(F.col("id") * 3).alias("ts"))
    whole = rows(ordered.rolling_rate(timed, "ts", [F.col("id")], 5, 1000))
    assert rows(ordered.rolling_rate(timed, "ts", [F.col("id")], 5, 7)) == whole
    assert whole[0][2] == 0.0 and dict((r[0], r[2]) for r in whole)[4] == pytest.approx(5 / 12 * 60)
    summed = ordered.counters(timed, [F.col("id")], {"n": F.when(F.col("id") > 0, F.col("id"))})
    assert {r["id"]: r["n"] for r in summed.collect()} == {i: i * (i + 1) // 2 for i in range(20)}
    split = ordered.exact_split(spark.range(205), "id").groupBy("split").count()
    assert rows(split) == [("test", 20), ("train", 165), ("validation", 20)]
    assert rows(ordered.exact_split(spark.range(1), "id").select("split")) == [("train",)]
    best = ordered.running_best(spark.createDataFrame([(1, 2.0, -1.0), (2, 1.0, 0.5), (3, None, 0.5)], "e int, l double, g double"), "e", "l", "g")
    assert rows(best.select("e", "best_loss", "best_gap")) == [(1, True, False), (2, True, True), (3, False, False)]
    assert ordered.shuffled_order(spark.range(9), "id").collect() == ordered.shuffled_order(spark.range(9).repartition(3), "id").collect()


def test_scorer(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, 0), (3, "bad", 0), (4, "abc", 0)], "sample_index int, text string, status int")

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["text"] == "bad").any():
            raise ValueError
        return pd.DataFrame({"similarity": batch["text"].str.len() / 10, "alignment_score": float("nan")})

    got = {r["sample_index"]: (r["similarity"], r["status"]) for r in scorer.score_batches(df.coalesce(1), score, ["text"]).collect()}
    assert got == {1: (0.1, "scored"), 2: (None, "no_input"), 3: (None, "failed"), 4: (0.3, "scored")}


def test_subsets(spark):
    real = spark.createDataFrame([(1, "x", "train"), (2, "y", "test")], "sample_index int, sentence string, split string")
    real = subsets.standardize_real(real.withColumn("segment", F.lit("s")))
    assert real.columns == ["sample_index", "text", "split", "voice", "model", "dataset_source"]
    syn = spark.createDataFrame([(3, "x", "amber", "high"), (4, "z", "dune", None)], "sample_index int, text string, voice string, band string")
    built = {n: subsets.build_subset(n, syn, real, syn) for n in subsets.SUBSETS}
    sizes = {n: d.count() for n, d in built.items()}
    assert sizes == {"fully_synthetic": 3, "mixed_cv_synthetic": 3, "cv_only": 2, "high_quality_cv": 3, "cv_fully_synthetic": 4, "mixed_cv_synthetic_all": 4}
    assert all(ok for _, _, ok, _ in subsets.consistency(built))
    assert not all(ok for _, _, ok, _ in subsets.consistency({"a": real, "b": syn}))
    matched = subsets.text_matched(syn.withColumn("audio", F.lit("a")), real.withColumn("audio", F.lit("b")))
    assert rows(matched.groupBy("source").count()) == [("common_voice", 2), ("synthetic_matched", 1)]


def test_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 3, 2)] + [(None, 7.0), (None, 9.0), ("b", None)], "k string, v double")
    got = spread.quantiles(df, ["k"], "v", {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q1": 1.0})
    assert rows(got) == [("a", 1.0, 1.75, 2.5, 5.0), (None, 7.0, 7.5, 8.0, 9.0)]
    assert rows(spread.quantiles(df, [], "v", {"m": 0.5})) == [(4.0,)]
    assert rows(spread.quantiles(df.limit(0), [], "v", {"m": 0.5})) == []
    same = spark.createDataFrame([("h", 1.0)] * 50 + [("h", 2.0)] * 50, "k string, v double")
    assert rows(spread.quantiles(same, ["k"], "v", {"m": 0.5})) == [("h", 1.5)]


def test_within_goal(spark):
    df = spark.createDataFrame([("a", i, "x") for i in range(20)] + [("b", 1, "y"), ("c", 2, "z")], "k string, n int, goal string")
    goals = spark.createDataFrame([("a", 3), ("b", 5), ("c", 0)], "k string, goal bigint")
    assert rows(spread.within_goal(df, ["k"], ["n"], goals)) == [("a", 0, "x"), ("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y")]


def test_pool_groups(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [5.0, 1.0], 1), ("a", [90.0, 90.0], 0), ("b", [7.0, 7.0], 0), ("b", [7.0, 7.0], None)], "k string, v array<float>, m int")
    assert rows(scorer.pool_groups(df, ["k"], "v", F.col("m") == 1)) == [("a", 0, 3.0), ("a", 1, 3.0), ("b", 0, 0.0), ("b", 1, 0.0)]


def test_quantiles_of_equal_values(spark, monkeypatch):
    """Nine of ten values are equal: no partition of the sorted rows holds them all."""
    df = spark.range(2000).select(F.lit("k").alias("k"), F.when(F.col("id") % 10 > 0, 1.0).otherwise(F.col("id") / 2000).alias("v"))
    sizes = []
    real = spread.range_sorted

    def counted(rows, keys, order):
        out = real(rows, keys, order)
        sizes.append(out.groupBy("_part").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(spread, "range_sorted", counted)
    got = spread.quantiles(df, ["k"], "v", {"q1": 0.05, "m": 0.5}).first()
    assert sizes[0] <= 200 < 1800  # at most the distinct values
    values = sorted(1.0 if i % 10 else i / 2000 for i in range(2000))
    at = 0.05 * 1999
    assert got["m"] == 1.0 and got["q1"] == pytest.approx(values[int(at)] + (values[int(at) + 1] - values[int(at)]) * (at % 1))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_even_join(spark, monkeypatch, how):
    """One key and the null key with most of the rows."""
    monkeypatch.setattr(spread, "HOT_LEAST", 10)
    key = F.when(F.col("id") < 150, "hot").when(F.col("id") < 220, None).otherwise(F.col("id").cast("string"))
    left = spark.range(260).select("id", key.alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("extra"))
    right = spark.createDataFrame([("hot", 1), ("230", 2), ("none", 3)], "k string, n int")
    got = spread.even_join(left, right, "k", how).drop("extra")
    assert rows(got) == rows(left.drop("extra").join(right, "k", how))
    assert rows(spread.even_join(left.limit(0), right, "k", how)) == []


def test_released_tables(spark):
    one, two = cut(spark.range(3), "t"), cut(spark.range(4), "t")
    storage.discard(one)
    assert not storage.exists(spark, one._cut_at) and two.count() == 4
    storage.release(spark)
    assert not storage.exists(spark, two._cut_at)
    assert cut(spark.range(5), "t").count() == 5


def test_lists_and_ranks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, t string")
    listed = spark.createDataFrame([(2, 0), (9, 1), (1, 2), (2, 3)], "id bigint, o int")
    assert rows(joins.select_in_order(df, listed, "id", ["o"]).select("at", "t")) == [(0, "b"), (2, "a"), (3, "b")]
    s = spark.createDataFrame([(1, 0.5), (2, None), (3, math.nan), (4, 0.9), (5, 0.5)], "id bigint, s double")
    assert rows(ordered.ranked(s, "s", "id").select("rank", "id")) == [(1, 4), (2, 1), (3, 5), (4, 2), (5, 3)]


def test_carried_columns(spark):
    df = spark.createDataFrame([(1, "a", None, {"k": 1}, 5), (2, "", 7, None, 6)], "id int, text string, n bigint, m map<string,int>, similarity int")
    got = scorer.score_batches(df, lambda b: pd.DataFrame({"similarity": b["text"].str.len() * 1.0, "alignment_score": float("nan")}), ["text"])
    assert got.columns == ["id", "n", "m", "similarity", "alignment_score", "status"]
    assert rows(got) == [(1, None, {"k": 1}, 1.0, None, "scored"), (2, 7, None, None, None, "no_input")]
    assert rows(scorer.only_scored(got).select("id")) == [(1,)]
    assert scorer.score_batches(df.limit(0), lambda b: b, ["text"]).count() == 0


def test_scales_and_verdicts(spark):
    with pytest.raises(ValueError):
        scoring.readable(F.lit(0.1), "percent")
    shown = spark.range(1).select(scoring.readable(F.lit(0.0)), scoring.readable(F.lit(0.0), "prob"), losses.uncertainty_weight(F.lit(0.0))).first()
    assert tuple(shown) == (0.5, 0.5, 1.0)
    v = spark.createDataFrame([(x,) for x in (0.0, -0.0005, 0.005, 0.04, 0.05, None, math.nan)], "d double")
    assert [r[0] for r in v.select(scoring.likeness(F.col("d"))).collect()] == ["excellent", "excellent", "good", "acceptable", "check", None, None]
    labels = spark.createDataFrame([(False, 0.3), (True, 0.3), (True, None)], "c boolean, s double")
    assert [r[0] for r in labels.select(losses.alignment_label(F.col("c"), F.col("s"))).collect()] == [0.9, 0.3, 0.1]


def test_building_all(spark, tmp_path):
    real = spark.createDataFrame([(1, "x", "train"), (2, "y", "test")], "sample_index bigint, text string, split string")
    syn = spark.createDataFrame([(3, "z", "high")], "sample_index bigint, text string, band string")
    made, checks = subsets.build_all(("cv_only", "fully_synthetic"), syn, real, syn, str(tmp_path / "s"))
    assert rows(made.select("subset", "split", "num_samples", "sample_text")) == [
        ("cv_only", "test", 1, "y..."), ("cv_only", "train", 1, "x..."), ("fully_synthetic", "test", 1, "y..."), ("fully_synthetic", "train", 1, "z...")
    ]
    assert len(checks) == 8 and all(ok for _, _, ok, _ in checks)
    sounds = spark.createDataFrame([("s", "train", 2, (16000,), "t"), ("s", "train", 1, (8000,), "u")], "subset string, split string, sample_index int, audio struct<sampling_rate:int>, text string")
    assert subsets.summary(sounds).first()["sampling_rate"] == 8000


def test_shuffled_segments(spark):
    """Segments of two words and more are drawn, also at the very end."""
    df = spark.createDataFrame([(i, "a b c") for i in range(400)], "id int, text string")
    got = {r["corrupted"] for r in corrupt.with_corruption(df, "text", "id", "shuffle").collect()}
    assert {"a b c", "b a c", "a c b"} < got and all(sorted(x.split()) == ["a", "b", "c"] for x in got)
