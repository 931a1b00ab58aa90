from pyspark.sql import functions as F

from loomtide.streaming import ingest


def test_updates_are_saved_once_and_read_by_time(spark, tmp_path):
    line = '{"id":"%s","time":%d,"values":{"t":{"value":"%s","type":"INT"}}}'
    place = {k: str(tmp_path / k) for k in ("in", "out", "checkpoint")}
    seen = []

    def add(*rows):
        spark.createDataFrame([(line % r,) for r in rows], "value string").coalesce(1).write.mode("append").text(place["in"])
        messages = spark.readStream.text(place["in"])
        ingest.upsert_stream(messages, place["out"], place["checkpoint"], lambda batch, n: seen.append((n, batch.count()))).awaitTermination()

    add(("a", 5, "new"), ("b", 1, "only"))
    add(("a", 3, "late"))
    stored = spark.read.parquet(place["out"])
    assert stored.count() == 3 and seen == [(0, 2), (1, 1)]
    assert sorted((r["id"], r["time"], r["value"]) for r in ingest.latest(stored).collect()) == [("a", 5, "new"), ("b", 1, "only")]


def test_windows_count_values_and_keep_nulls_out(spark):
    rows = [("2024-01-01 00:00:10", 1.0), ("2024-01-01 00:00:50", None), ("2024-01-01 00:01:00", 4.0)]
    events = spark.createDataFrame(rows, "at string, x double").withColumn("at", F.to_timestamp("at"))
    out = ingest.windowed_profile(events, "at", "x", "1 minute", "1 minute").orderBy("window").collect()
    assert [(r["n"], r["total"]) for r in out] == [(1, 1.0), (1, 4.0)]
