"""What queries over all pairs put on disk: shuffles in proportion to the table, and files that are compact."""

import pytest
from pyspark.sql import functions as F

from loomtide.functions import distances
from loomtide.operators import spatial


def _sides(spark, n, every):
    value = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1_000_003)) / 5_000_000.0
    p = spark.range(n).select("id", F.array(*(value(i) for i in range(8))).alias("key"))
    return p, p.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("key").alias("q"))


def _shuffled(spark, df):
    """Bytes that a run writes to shuffles."""
    sc = spark._jsc.sc()

    def stages():
        found = sc.statusStore().stageList(None, False, False, spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Double.TYPE, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    df.write.format("noop").mode("overwrite").save()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sum(n for key, n in stages().items() if key not in before)


def test_points_are_shuffled_once_whatever_the_number_of_query_blocks(spark, monkeypatch):
    p, q = _sides(spark, 4000, 10)
    monkeypatch.setattr(spatial, "POINT_VALUES", 8 * 500)
    run = lambda: spatial.all_distances(p, q, distances.euclidean, 6)
    few = _shuffled(spark, run())
    monkeypatch.setattr(spatial, "QUERY_VALUES", 8 * 10)
    assert run().count() == 4000 * 400
    assert 0 < few and _shuffled(spark, run()) < 2 * few


@pytest.mark.parametrize(("f", "digits"), [(distances.euclidean, 6), (distances.pearson, 5)])
def test_files_of_all_pairs_are_compact(spark, tmp_path, f, digits):
    p, q = _sides(spark, 10_000, 50)
    spatial.all_distances(p, q, f, digits).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("query_id", "point_id").distinct().count() == 10_000 * 200
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < 7 * out.count()


def test_pairs_of_chunks_keep_their_distances(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ARRANGED", 900)
    monkeypatch.setattr(spatial, "SENT", 64)
    monkeypatch.setattr(spatial, "POINT_VALUES", 8 * 60)
    p, q = _sides(spark, 300, 7)
    odd = spark.createDataFrame([(900, [float("inf")] + [0.0] * 7), (901, [float("nan")] * 8), (902, [None] + [0.5] * 7), (903, [1e200] * 8), (904, [0.1] * 8)], "id long, key array<double>")
    p, q = p.unionByName(odd), q.unionByName(odd.select(F.col("id").alias("query_id"), F.col("key").alias("q")))
    got = spatial.all_distances(p, q, distances.euclidean, 6)
    want = p.crossJoin(q).select("query_id", F.col("id").alias("point_id"), F.round(distances.euclidean(F.col("key"), F.col("q")), 6).alias("distance"))
    bits = lambda df: sorted((a, b, repr(c)) for a, b, c in (tuple(r) for r in df.collect()))
    assert bits(got) == bits(want)
