import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom import schema
from voxloom.functions import arrays, edits, scoring, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def by_row(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("i").select(*columns).collect()]


def test_keys_and_words(spark):
    df = texts(spark, None, "", "  ", "Één　twee\xa0DRIE ", "\t a  b\n")
    t = F.col("t")
    assert by_row(df, text.norm_key(t)) == [None, "", "", "één　twee\xa0drie", "a  b"]
    assert by_row(df, text.word_count(t)) == [None, 0, 0, 3, 2]


def test_normalize(spark):
    df = texts(spark, None, "", '"', '""', '"Dag"', "Dag.", "Wat?", '"Ja!"')
    once = text.normalize_transcript(F.col("t"))
    assert by_row(df, once) == [None, "", '".', "", "Dag.", "Dag.", "Wat?", "Ja!"]
    again = df.withColumn("t", once)
    assert by_row(again, text.normalize_transcript(F.col("t"))) == by_row(df, once)


def test_names(spark):
    df = texts(spark, None, "audio_abc_amber.mp3", "x_y", "a_b_c_d.wav", "dir/Clip.MP3", "noext")
    n = F.col("t")
    assert by_row(df, text.filename_voice(n)) == [None, "amber", None, "c", None, None]
    assert by_row(df, text.extension(n)) == [None, ".mp3", "", ".wav", ".mp3", ""]
    assert one(spark, text.audio_filename(F.lit("a"), F.lit(None).cast("string"), F.lit("m"))) == (None,)


def test_rate_limit_and_bar(spark):
    assert one(spark, text.mentions_rate_limit(F.lit("Error: RATE_LIMIT hit")), text.mentions_rate_limit(F.lit("ok"))) == (True, False)
    assert one(spark, text.progress_bar(F.lit(0.5), 4), text.progress_bar(F.lit(7.0), 4)) == ("##--", "####")


def test_scales(spark):
    c = F.lit(0.3)
    unit, back = one(spark, scoring.unit_scale(c), scoring.unit_from_probability(scoring.probability(c)))
    assert unit == pytest.approx(0.65) and back == pytest.approx(0.65)
    assert one(spark, scoring.unit_from_probability(F.lit(0.0)), scoring.unit_from_probability(F.lit(1.0))) == (0.0, 1.0)


def test_bands(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.8, 0.5, 0.49, 0.81, None, math.nan])], "i int, s double")
    assert by_row(df, scoring.band(F.col("s"))) == ["medium", "medium", "low", "high", None, None]
    assert by_row(df, scoring.band(F.col("s"), inclusive_high=True))[0] == "high"
    assert by_row(df, scoring.advice(scoring.band(F.col("s"))))[4] is None


def test_vectors(spark):
    a, z = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, scoring.cosine(a, a), scoring.cosine(a, z)) == (1.0, None)
    ones, none = F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(0))
    assert one(spark, scoring.masked_mean(a, ones, False), scoring.masked_mean(a, none)) == (1.0, None)
    vectors = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    assert one(spark, scoring.weighted_pool(vectors, F.array(F.lit(1.0), F.lit(3.0))))[0] == [2.5, 3.5]
    assert one(spark, scoring.mean_absolute_error(a, z)) == (0.5,)


def test_arrays(spark):
    w = F.array(*[F.lit(x) for x in "abc"])
    k = F.lit(1)
    got = one(spark, arrays.replace_at(w, k, F.lit("x")), arrays.remove_at(w, k), arrays.insert_at(w, F.lit(3), F.lit("x")), arrays.tail(w, F.lit(3)))
    assert got == (["a", "x", "c"], ["a", "c"], ["a", "b", "c", "x"], [])
    tokens = arrays.clean_tokens(F.array(F.lit("<s>"), F.lit("a"), F.lit("b")), F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    assert one(spark, F.transform(tokens, lambda x: x["token"])) == (["a"],)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


WORDS = st.lists(st.sampled_from("abcd"), max_size=9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=6))
def test_word_edits(pairs):
    got = edits.distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [plain_edits(a, b) for a, b in pairs]


def test_word_edit_columns(spark):
    df = spark.createDataFrame([(1, list("abc"), list("axc"), 0), (2, [], list("ab"), 0), (3, None, ["a"], 0), (4, list("ab"), [], 0)], "i int, r array<string>, h array<string>, edits_of int")
    got = {r["i"]: r["edits"] for r in edits.with_word_edits(df, "r", "h").collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 2}
    alike = df.where("i <> 3").select("i", edits.word_edits_expr(F.col("r"), F.col("h")).alias("e"))
    assert {r["i"]: r["e"] for r in alike.collect()} == {1: 1, 2: 2, 4: 2}


def test_schema(spark):
    df = spark.createDataFrame([("a", None, 5)], "text string, voice string, other int")
    got = schema.conform(df)
    assert got.columns == [n for n, _, _ in schema.UNIFIED] == schema.unified_struct().names
    row = got.first()
    assert (row["voice"], row["model"], row["locale"], row["up_votes"]) == (None, "", "nl", 0)
    assert schema.conform(got).collect() == got.collect()
    assert schema.resolve_column(df, ("sentence", "text")) == "text"
    with pytest.raises(ValueError):
        schema.resolve_column(df, ("x",))
    with pytest.raises(ValueError):
        schema.keep_columns(df, ["nope"])
    assert schema.keep_columns(df, ["text"], ["voice", "nope"]).columns == ["text", "voice"]
    assert schema.ensure_column(df, "audio", "").first()["audio"] == ""
    assert schema.rename_if_present(df, "other", "more").columns[-1] == "more"
    assert schema.tag(df, "source", "x").first()["source"] == "x"
    assert schema.schema_gaps("ab", "bc") == (["a"], ["c"])


def test_times_and_audio(spark):
    from voxloom.config import Settings
    from voxloom.functions import audio, times

    shown = one(spark, times.display(F.lit(3725.9)), times.display(F.lit(-1.0)), times.display(F.lit(None).cast("double")), times.display(F.lit(100_000)))
    assert shown == ("1:02:05", None, None, "27:46:40")
    two = F.array(F.array(F.lit(1.0), F.lit(-1.0)), F.array(F.lit(0.0), F.lit(-1.0)))
    assert one(spark, audio.mono(two), audio.to_int16(F.array(F.lit(1.5), F.lit(-1.0)))) == ([0.5, -1.0], [32767, -32767])
    assert one(spark, audio.duration(F.array(F.lit(0.0), F.lit(0.0)), F.lit(4)), audio.duration(F.array(F.lit(0.0)), F.lit(0))) == (0.5, None)
    assert one(spark, arrays.pad_to(F.array(F.lit(1)), 3), arrays.masked(F.array(F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(0)))) == ([1, 0, 0], [2, 0])
    assert one(spark, scoring.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == ([0.5, 0.5],)
    s = Settings.load({"VOXLOOM_THRESHOLD": "0.7", "VOXLOOM_SEED": "7"}, seed=None, batch_size=3)
    assert (s.threshold, s.seed, s.batch_size) == (0.7, 7, 3)
