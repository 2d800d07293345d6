import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from voxloom.sources import readers, trainlog, writers
from voxloom.streaming import online


def test_split_slice():
    assert readers.split_slice("test") == ("test", None) and readers.split_slice("test[:10]") == ("test", 10)
    with pytest.raises(ValueError):
        readers.split_slice("test[3:4]")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test"), (30, "c", "test")], "sample_index int, text string, split string")
    writers.save_splits(df, str(tmp_path / "t"))
    first = readers.load_table(spark, str(tmp_path / "t"), split="test[:1]")
    assert [r["text"] for r in first.collect()] == ["b"]
    got = readers.load_table(spark, str(tmp_path / "t"), split="test")
    assert sorted(r["text"] for r in got.collect()) == ["b", "c"]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()
    writers.replace_splits(df.where("split = 'test' AND sample_index = 2"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert readers.first_readable(spark, [str(tmp_path / "no"), str(tmp_path / "t")]).count() == 2
    with pytest.raises(AnalysisException):
        readers.first_readable(spark, [str(tmp_path / "no")])


def test_json_and_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": null}]')
    assert readers.read_records(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "x.mp3").write_bytes(b"12345")
    (tmp_path / "y.txt").write_bytes(b"1")
    listed = readers.list_files(spark, str(tmp_path))
    assert [(r["filename"], r["file_size"]) for r in listed.collect()] == [("x.mp3", 5)]
    df = spark.createDataFrame([('["a","b"]',), ("[",), (None,)], "t string").select(readers.sentences_of_response(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == [["a", "b"], None, None]
    small = spark.createDataFrame([(2, 1), (1, 5)], "wc int, n int")
    writers.save_small_csv(small, str(tmp_path / "h"), ["wc"])
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "h"), "wc int, n int").collect()] == [(1, 5), (2, 1)]
    assert writers.nested_json(small.limit(1), {"g": ["wc"]}).first()[0] == '{"g":{"wc":2}}'
    assert writers.card(small.limit(1), "T", ["wc"]).first()[0] == "# T\nwc: 2"

    def fail():
        raise OSError("full")

    assert [x[:2] for x in writers.publish({"a": fail, "b": lambda: None})] == [("a", False), ("b", True)]
    assert small.select(readers.setting(small, "none", 3)).first()[0] == 3


LOG = [
    "2025-07-01 10:00:00,123 - INFO - Epoch 1/3 - Train Loss: 0.9, Val Loss: 0.8, Clean Sim: 0.6, Corrupt Sim: 0.5, Gap: 0.1, Time: 12.5s",
    "2025-07-01 10:00:01,123 - INFO - New best gap",
    "20",
    "O - Optimizer step",
    "2025-07-01 10:01:00,000 - INFO - Epoch 2/3 - Train Loss: 0.7, Val Loss: 0.5, Gap: 0.3, Time: 10s",
    "2025-07-01 10:02:00,000 - WARNING - Epoch",
    "2025-07-01 10:03:00,000 - INFO - Epoch 3/3 - Train Loss: 0.6, Val Loss: 0.5, Gap:",
]


def test_training_log(spark):
    m = trainlog.epoch_metrics(spark.createDataFrame([(x,) for x in LOG], "value string"))
    got = {r["epoch"]: (r["val_loss"], r["gap"], r["seconds"]) for r in m.collect()}
    assert got == {1: (0.8, 0.1, 12.5), 2: (0.5, 0.3, 10.0), 3: (0.5, None, None)}
    b = trainlog.best_epochs(m).first()
    assert (b["best_loss_epoch"], b["best_gap_epoch"], b["total_seconds"]) == (2, 2, 22.5)
    none = trainlog.epoch_metrics(spark.createDataFrame([], "value string"))
    assert trainlog.best_epochs(none).first()["best_loss_epoch"] is None


def test_batch_forms_of_streams(spark):
    df = spark.createDataFrame([("A ", 1), ("a", 2), (None, 3)], "s string, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert online.unique_sentences(df, "s").count() == 2
    calls = df.withColumns({"ok": F.lit(True), "input_tokens": F.lit(None).cast("bigint")})
    r = online.call_rates(calls).first()
    assert (r["calls"], r["ok_calls"], r["input_tokens"]) == (3, 3, 0)


def test_audio_files(spark, tmp_path):
    import wave

    from voxloom.sources.audio import load_audio

    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(b"\x00\x40\x00\x00" * 8)
    (tmp_path / "b.wav").write_bytes(b"no audio")
    got = {r["filename"]: r for r in load_audio(spark, str(tmp_path)).collect()}
    assert len(got["a.wav"]["array"]) == 16 and got["a.wav"]["array"][0] == 0.25 and got["a.wav"]["sampling_rate"] == 16_000
    assert got["b.wav"]["array"] is None and got["b.wav"]["error"]


def test_slices(spark, tmp_path):
    df = spark.createDataFrame([(i, "test" if i % 3 else "train") for i in range(500, 560)], "sample_index bigint, split string")
    df.repartition(4).write.parquet(str(tmp_path / "t"))

    def ids(spec):
        return sorted(r["sample_index"] for r in readers.load_table(spark, str(tmp_path / "t"), split=spec).collect())

    assert ids("test[:10]") == [i for i in range(500, 560) if i % 3][:10]
    assert ids("test") == ids("test[:900]") == [i for i in range(500, 560) if i % 3]
    assert ids("test[:0]") == [] and readers.first_rows(df.limit(0), "sample_index", 3).count() == 0


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_quota_of_a_stream(spark, tmp_path):
    """A bucket with most rows, over several micro-batches: the first rows in order of arrival."""
    for k in range(3):
        rows = [("hot" if i % 5 else None if i % 2 else "cold", 100 * k + i) for i in range(60)]
        spark.createDataFrame(rows, "bucket string, n bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    online.accept_up_to(_stream(spark, tmp_path / "in", "bucket string, n bigint"), "bucket", ["n"], {"hot": 70, "cold": 4}, out, state).awaitTermination()
    got = spark.read.parquet(out).groupBy("bucket").agg(F.count("*").alias("c"))
    assert sorted(tuple(r) for r in got.collect()) == [("cold", 4), ("hot", 70)]
    hot = sorted(r["batch"] for r in spark.read.parquet(out).where("bucket = 'hot'").collect())
    assert hot == [0] * 48 + [1] * 22
    again = online.accept_up_to(_stream(spark, tmp_path / "in", "bucket string, n bigint"), "bucket", ["n"], {"hot": 70, "cold": 4}, out, state)
    again.awaitTermination()
    assert spark.read.parquet(out).count() == 74


def test_first_seen_on_a_stream(spark, tmp_path):
    for k, words in enumerate((["A", "b", "a ", None], ["B ", "c"], ["a", "d", "d"])):
        rows = [(10 * k + i, w) for i, w in enumerate(words)]
        spark.createDataFrame(rows, "i bigint, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = online.keep_first_seen(_stream(spark, tmp_path / "in", "i bigint, s string"), F.lower(F.trim("s")), ["i"], str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = sorted(r["s"].strip().lower() for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["a", "b", "c", "d"]
    assert spark.read.parquet(str(tmp_path / "out")).where("batch = 0").count() >= 1


def test_dashboard_and_progress(spark, tmp_path):
    spark.range(30).write.parquet(str(tmp_path / "in"))
    seen = []
    q = online.dashboard(_stream(spark, tmp_path / "in", "id bigint"), lambda batch, n: seen.append(batch.count()), str(tmp_path / "a"), "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 30
    for _ in range(2):  # a second run goes on where the first stood
        online.save_progress(_stream(spark, tmp_path / "in", "id bigint"), str(tmp_path / "out"), str(tmp_path / "b")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    spark.range(30, 40).write.mode("append").parquet(str(tmp_path / "in"))
    online.save_progress(_stream(spark, tmp_path / "in", "id bigint"), str(tmp_path / "out"), str(tmp_path / "b")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
