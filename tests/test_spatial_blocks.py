import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtide.functions import distances
from loomtide.operators import spatial


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(300)]
    rows += [(300, [0.0] * 6), (301, [float("nan")] + [0.5] * 5), (302, rows[7][1]), (303, [1.0] * 6), (304, [1.0, 2.0]), (305, None), (306, [1.0, None] + [0.0] * 4), (307, [])]
    p = spark.createDataFrame(rows, "id long, key array<double>").cache()
    q = p.where("id % 20 = 0 or id >= 301").select(F.col("id").alias("query_id"), F.col("key").alias("q")).cache()
    return p, q


def _plain(p, q, f):
    both = p.join(q, F.size("key") == F.size("q"))
    return both.select("query_id", F.col("id").alias("point_id"), f(F.col("key"), F.col("q")).alias("distance"))


def _bits(rows):
    return sorted((a, b, repr(c)) for a, b, c in (tuple(r) for r in rows))


@pytest.mark.parametrize("f", [distances.euclidean, distances.cosine])
def test_blocks_have_the_bits_of_the_expressions(spark, sides, monkeypatch, f):
    monkeypatch.setattr(spatial, "POINT_VALUES", 240)
    monkeypatch.setattr(spatial, "QUERY_VALUES", 30)
    p, q = sides
    got = spatial.around(p, q, distance=f)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert _bits(got.select("query_id", "point_id", "distance").collect()) == _bits(_plain(p, q, f).collect())
    assert _bits(spatial.all_distances(p, q, f, 6).collect()) == _bits(_plain(p, q, f).withColumn("distance", F.round("distance", 6)).collect())


def test_pearson_blocks(spark, sides):
    p, q = (d.where(F.size(c) == 6) for d, c in zip(sides, ("key", "q"), strict=True))
    got = spatial.all_distances(p, q, distances.pearson, 6)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert _bits(got.collect()) == _bits(_plain(p, q, distances.pearson).withColumn("distance", F.round("distance", 6)).collect())


@pytest.mark.parametrize(("k", "radius"), [(4, -1.0), (3, 2.5), (-1, 2.0)])
def test_nearest_of_many_blocks(spark, sides, monkeypatch, k, radius):
    monkeypatch.setattr(spatial, "POINT_VALUES", 120)
    p, q = sides
    got = spatial.around(p, q, k=k, radius=radius)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    monkeypatch.setattr(distances, "BLOCKWISE", {})
    want = spatial.around(p, q, k=k, radius=radius)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[c] for c in got.columns)) for r in want.collect())


def test_dense_cells_are_blocks(spark, sides, monkeypatch):
    monkeypatch.setattr(spatial, "DENSE", 20)
    monkeypatch.setattr(spatial, "POINT_VALUES", 120)
    p, q = (d.where(F.size(c) > 0) for d, c in zip(sides, ("key", "q"), strict=True))
    got = spatial.radius_by_grid(p, q, 1.5)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    want = _plain(p, q, distances.euclidean).where("distance < 1.5")
    assert _bits(got.collect()) == _bits(want.collect()) and got.count() > 100


def test_rounding_is_that_of_the_engine(spark):
    x = [0.0000005, 1.0000015, 2.5, -0.0000005, -1e-9, 1.2345675, 0.1234565, 4503599627.3704975, 1e300, 123456789.1234565, float("nan"), float("inf")]
    x += [float(v) for v in np.round(np.random.default_rng(1).random(500), 7)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    with np.errstate(invalid="ignore"):
        got = spatial._half_up(np.array(x), 6)
    assert [repr(float(v)) for v in got] == [repr(v) for v in want]
