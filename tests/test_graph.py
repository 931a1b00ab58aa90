import pytest
from pyspark.sql import functions as F

from loomtide.functions import math as M
from loomtide.functions.types import BEGINNING_OF_TIME, END_OF_TIME
from loomtide.operators import mutate, profile, resolve, series, spatial, traverse
from loomtide.operators.graph import TemporalGraph
from loomtide.sources import tabular


@pytest.fixture(scope="module")
def line(spark):
    v = spark.createDataFrame([(1, 0, 0, "MyName"), (1, 0, 1, "MyName@t1")], "id long, world long, time long, name string")
    return TemporalGraph.of(v).fork(1, 0)


def names(g, world, time):
    ask = g.spark.createDataFrame([(1, world, time)], "id long, world long, time long")
    return [r["name"] for r in g.lookup(ask).collect()]


def test_fork_reads_through_until_written(spark, line):
    assert names(line, 1, 2) == ["MyName@t1"]
    child = spark.createDataFrame([(1, 1, 2, "MyName@t1@w1")], "id long, world long, time long, name string")
    g = line.write(child)
    assert names(g, 1, 2) == ["MyName@t1@w1"]
    assert names(g, 1, 1) == ["MyName@t1"]
    assert names(g, 0, 2) == ["MyName@t1"]
    times = lambda w, a, b: sorted((r["time"] for r in g.timepoints(w, a, b).collect()), reverse=True)
    assert times(0, BEGINNING_OF_TIME, END_OF_TIME) == [1, 0]
    assert times(0, 1, END_OF_TIME) == [1]
    assert times(1, BEGINNING_OF_TIME, END_OF_TIME) == [2, 1, 0]


def test_unchanged_write_makes_no_version(spark, line):
    same = spark.createDataFrame([(1, 0, 5, "MyName@t1")], "id long, world long, time long, value string")
    assert line.set_attribute("name", same).versions.count() == 2
    assert line.set_attribute("name", same, force=True).versions.count() == 3
    assert line.set_attribute("name", same.withColumn("value", F.lit("new"))).versions.count() == 3


def test_end_and_drop(spark, line):
    ended = line.end(spark.createDataFrame([(1, 0, 3)], "id long, world long, end_time long"))
    assert names(ended, 0, 3) == ["MyName@t1"] and names(ended, 0, 4) == []
    assert line.drop_nodes(spark.createDataFrame([(1,)], "id long")).versions.count() == 0


def test_save_and_load(spark, line, tmp_path):
    line.save(str(tmp_path))
    assert names(TemporalGraph.load(spark, str(tmp_path)), 1, 9) == ["MyName@t1"]


def test_time_sensitivity(spark):
    w = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (1, 15, "c")], "id long, time long, v string")
    assert {(r["time"], r["v"]) for r in mutate.time_sensitivity(w, 10).collect()} == {(0, "b"), (10, "c")}
    assert [r["time"] for r in mutate.time_sensitivity(w.where("time = 15"), 10, 2).collect()] == [12]


def test_timeline_limit_and_sparse(spark):
    v = spark.range(0, 21).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("time"))
    assert sorted(r["time"] for r in resolve.timeline(v, BEGINNING_OF_TIME, END_OF_TIME, 5).collect()) == [0, 1, 2, 3, 4]
    assert [r["time"] for r in resolve.timeline(v, 5, BEGINNING_OF_TIME, 1).collect()] == [5]
    assert resolve.timeline_sparse(v, 0, 20, 5).count() == 5
    with pytest.raises(ValueError):
        resolve.timeline_sparse(v, 0, 20, 0)


def test_as_of_rows_crosses_buckets(spark):
    v = spark.createDataFrame([(1, 5, "a"), (1, 25, "b")], "id long, time long, s string")
    r = spark.createDataFrame([(0, 1, 4), (1, 1, 5), (2, 1, 24), (3, 1, 99), (4, 2, 9)], "pos long, id long, time long")
    got = {x["pos"]: x["s"] for x in resolve.as_of_rows(r, v, width=10).collect()}
    assert got == {1: "a", 2: "a", 3: "b"}


def test_expressions(spark):
    row = spark.range(1).select(
        M.divide(F.lit(10.0), 0).alias("inf"), M.divide(F.lit(0.0), 0).alias("nan"), M.remainder(F.lit(-7), 3).alias("rem"), M.round_half_up(F.lit(-2.5), 0).alias("r"),
        M.log(F.lit(0.0)).alias("l"), M.month(F.lit(0)).alias("m"), M.day_of_week(F.lit(0)).alias("w"), M.array_remove_first(F.array(F.lit(1), F.lit(2), F.lit(1)), 1).alias("a"),
    ).first()
    assert row["inf"] == float("inf") and row["nan"] != row["nan"] and row["rem"] == -1 and row["r"] == -2
    assert row["l"] == float("-inf") and row["m"] == 0 and row["w"] == 4 and row["a"] == [2, 1]


def test_traversal(spark):
    e = spark.createDataFrame([(1, "child", 0, 2), (1, "child", 1, 3), (2, "child", 0, 4), (3, "child", 0, 5), (3, "child", 1, 6), (6, "child", 0, 7), (6, "child", 1, 8)], "src long, rel string, pos long, dst long")
    reach = {(r["dst"], r["hops"]) for r in traverse.closure(e).where("src = 1").collect()}
    assert reach == {(2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 3), (8, 3)}
    n = spark.createDataFrame([(1, "n1\n"), (2, "n1"), (3, None)], "id long, name string")
    assert [r["id"] for r in traverse.with_regex(n, "name", "n.").collect()] == [2]
    assert sorted(r["id"] for r in traverse.without_regex(n, "name", "n.").collect()) == [1, 3]


def test_spatial_and_series(spark):
    p = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, key array<double>")
    q = spark.createDataFrame([(0, [2.2, 0.0])], "query_id long, q array<double>")
    assert [r["point_id"] for r in spatial.around(p, q, k=3).orderBy("rank").collect()] == [2, 3, 1]
    assert {r["point_id"] for r in spatial.radius_by_grid(p, q, 1.5).collect()} == {1, 2, 3}
    s = spark.range(0, 60).select(F.lit(1).cast("long").alias("id"), (5000 + 10 * F.col("id")).alias("time"), F.lit(4.0).alias("v"))
    assert series.compress(s, "v", 0.5).count() == 1
    curve = s.withColumn("v", F.pow((F.col("time") - 5000) / 100.0, F.lit(2)))
    seg = series.compress(curve, "v", 0.1)
    back = series.read_polynomial(seg, curve.select("id", "time")).join(curve, ["id", "time"])
    assert back.count() == 60 and back.where(F.abs(F.col("value") - F.col("v")) > 0.1001).count() == 0


def test_p_value_and_updates(spark):
    assert abs(profile.p_value(0.5, 10) - 0.1411) < 1e-3 and profile.p_value(1.0, 5) == 0
    m = spark.createDataFrame([('{"id":"a","time":3,"values":{"t":{"value":"1","type":"INT"}}}',), ("{}",), ("bad",), (None,)], "value string")
    assert [tuple(r) for r in tabular.parse_updates(m).collect()] == [("a", 3, "t", "1", "INT")]


def test_compress_tries_every_degree_at_every_length(spark):
    import numpy as np

    from loomtide.operators import series

    v = 100 * np.polynomial.chebyshev.chebval(np.linspace(-1, 1, 200), [0] * 6 + [1])
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "id long, time long, value double")
    got = series.compress(df, "value", precision=1.0, max_degree=6).collect()
    assert [(r["start"], r["stop"], r["degree"]) for r in got] == [(0, 199, 6)]


def test_writes_of_a_batch_see_each_other(spark):
    v = spark.createDataFrame([(1, 0, 0, "a", 5), (1, 0, 10, "c", 6), (2, 0, 3, "x", 7)], "id long, world long, time long, name string, n long")
    kinds = "id long, world long, time long, value string"
    g = TemporalGraph.of(v).fork(1, 0)
    batch = [(1, 0, 1, "b"), (1, 0, 2, "a"), (1, 0, 12, "c"), (1, 0, 13, "d"), (3, 0, 1, "new"), (1, 1, 11, "w")]
    got = {(r["id"], r["world"], r["time"], r["name"], r["n"]) for r in g.set_attribute("name", spark.createDataFrame(batch, kinds)).versions.collect()}
    assert got == {tuple(r) for r in v.collect()} | {(1, 0, 1, "b", 5), (1, 0, 2, "a", 5), (1, 0, 13, "d", 6), (3, 0, 1, "new", None), (1, 1, 11, "w", 6)}
    gone = g.remove_attribute("name", spark.createDataFrame([(1, 0, 4)], "id long, world long, time long"))
    ask = spark.createDataFrame([(1, 0, 5), (1, 0, 11)], "id long, world long, time long")
    assert {(r["time"], r["name"]) for r in gone.lookup(ask).collect()} == {(5, None), (11, "c")}


def test_ends_hold_for_every_read_and_edges_go_with_nodes(spark, line):
    ended = line.end(spark.createDataFrame([(1, 0, 0)], "id long, world long, end_time long"))
    assert ended.at(9).count() == 0 and ended.at(0).count() == 1 and ended.at(9, 1).count() == 0
    assert [r["time"] for r in ended.timepoints(0, BEGINNING_OF_TIME, END_OF_TIME).collect()] == [0]
    edges = spark.createDataFrame([(1, "r", 0, 2), (2, "r", 0, 1), (2, "r", 1, 3)], "src long, rel string, pos long, dst long")
    left = TemporalGraph(line.versions, line.worlds, edges).drop_nodes(spark.createDataFrame([(1,)], "id long")).edges
    assert [tuple(r) for r in left.collect()] == [(2, "r", 1, 3)]


def test_lookup_all_keeps_places_and_what_if_ranks(spark, line):
    asked = spark.createDataFrame([(0, 1, 0, 5), (1, 9, 0, 5), (2, 1, 0, -1), (3, 1, 0, 5)], "pos long, id long, world long, time long")
    assert [r["name"] for r in line.lookup_all(asked).orderBy("pos").collect()] == ["MyName@t1", None, None, "MyName@t1"]

    def change(g, world):
        return g.write(spark.createDataFrame([(1, world, 7, "x" * world)], "id long, world long, time long, name string"))

    ranked = line.what_if(3, change, lambda g, w: g.at(9, w).agg(F.sum(F.length("name")).alias("score"))).orderBy("rank").collect()
    assert [(r["world"], r["score"]) for r in ranked] == [(4, 4.0), (3, 3.0), (2, 2.0)]
    assert line.described(line.at(5)).first()["text"] == '{"world":0,"id":1,"name":"MyName@t1"}'


def test_indexes(spark):
    from loomtide.operators.index import Indexes

    n = spark.createDataFrame([(1, "a", 0), (2, None, 0), (1, "b", 5)], "id long, k string, time long")
    held = Indexes.empty(spark).declare("g", "k").declare("t", "k", kind="timed").update("g", n).update("t", n)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(held.read("g")) == [1, 2] and ids(held.read("g", "b")) == [1] and ids(held.read("g", "a")) == [] and ids(held.read("g", None)) == [2]
    assert ids(held.read("t", "a", time=3)) == [1] and ids(held.read("t", "b", time=3)) == []
    assert ids(held.unindex("g", n.where("id = 1 and time = 5")).read("g")) == [2] and ids(held.read("none")) == []
    with pytest.raises(ValueError):
        held.read("g", "a", "b")


def test_expressions_from_text(spark):
    from loomtide.functions.expression import compiled

    cases = {"1 + 2 * 3 ^ 2 ^ 0": 7.0, "2 ^ 3 ^ 2": 512.0, "-(4 - 6) * 2": 4.0, "7 % 4 - 1": 2.0, "10 - 3 - 2": 5.0, "1 < 2 && 2 >= 2 || FALSE": 1.0, "IF(x > 1, MAX(x, 9), 0)": 9.0, "ROUND(PI * 100, 0) / 100": 3.14, "1 / 0 > 5": 1.0, "LOG(0 - 1) < 5": 0.0, "NOT(0 / 0 = 0 / 0)": 1.0, "1 < 2 < 3": 0.0, ".5e1": 5.0, "DAY(TIME)": 1.0}
    row = spark.createDataFrame([(2, 0)], "x long, time long").select(*(compiled(t).alias(f"c{i}") for i, t in enumerate(cases))).first()
    assert list(row) == list(cases.values())
    assert 0 <= spark.range(1).select(compiled("RAND()").alias("r")).first()["r"] < 1
    for bad in ("1 +", "(1", "1 2", "NONE(1)", "* 2", "a ? b"):
        with pytest.raises(ValueError):
            compiled(bad)


def test_relations(spark):
    e = spark.createDataFrame([(1, "r", 0, 5), (1, "r", 1, 6), (1, "r", 2, 5), (1, "q", 0, 5)], "src long, rel string, pos long, dst long")
    left = mutate.remove_from_relation(e, spark.createDataFrame([(1, 5)], "src long, dst long"), "r")
    assert sorted(tuple(r) for r in left.collect()) == [(1, "q", 0, 5), (1, "r", 0, 6), (1, "r", 1, 5)]
    kept = mutate.traverse_or_keep(spark.createDataFrame([(1,), (7,)], "id long"), e, "r")
    assert sorted((r["src"], r["pos"], r["id"]) for r in kept.collect()) == [(1, 0, 5), (1, 1, 6), (1, 2, 5), (7, 0, 7)]


def test_matrices(spark):
    import numpy as np

    from loomtide.functions import matrix as X

    a, b = np.array([[2.0, 1.0], [1.0, 3.0]]), np.array([[1.0, 0.0], [4.0, -2.0]])
    row = lambda m: (m.shape[0], m.shape[1], m.ravel(order="F").tolist())
    df = spark.createDataFrame([(row(a), row(b)), (None, row(b))], f"a {X.MATRIX}, b {X.MATRIX}")
    m, n = F.col("a"), F.col("b")
    made = {"mul": X.multiply(m, n, transpose_a=True, alpha=2.0), "t": X.transpose(n), "add": X.add(m, n), "sub": X.subtract(m, n), "had": X.hadamard(m, n), "inv": X.invert(m), "pinv": X.pseudo_inverse(n), "solve": X.solve(m, n), "sv": X.singular_values(m), "scale": X.scale(m, 3), "crop": X.crop(m, 1, 2), "wide": X.expand(m, 3, 2), "cat": X.append_column(m, n), "soft": X.softmax(n), "qr": X.qr_factor(m)}
    rows = df.select(*(c.alias(k) for k, c in made.items()), X.distance(m, n).alias("d"), X.cell(m, 1, 0).alias("c"), X.filled(2, 3, "gaussian").alias("f")).collect()
    full = next(r for r in rows if r["t"] is not None and r["add"] is not None)
    got = {k: np.array(full[k]["data"]).reshape((full[k]["rows"], full[k]["cols"]), order="F") for k in made}
    want = {"mul": 2 * a.T @ b, "t": b.T, "add": a + b, "sub": a - b, "had": a * b, "inv": np.linalg.inv(a), "pinv": np.linalg.pinv(b), "solve": np.linalg.solve(a, b), "sv": np.linalg.svd(a, compute_uv=False)[:, None], "scale": 3 * a, "crop": a[:1], "wide": np.vstack([a, [0, 0]]), "cat": np.hstack([a, b]), "soft": np.exp(b) / np.exp(b).sum(0)}
    assert all(np.allclose(got[k], w) for k, w in want.items()) and np.allclose(got["qr"].T @ got["qr"], a.T @ a)
    assert full["d"] == 5.0 and full["c"] == 1.0 and len(full["f"]["data"]) == 6


def test_fits_lags_and_mixtures(spark):
    rows = [(1, float(t), 2.0 * t * t - 3 * t + 1) for t in range(20)] + [(2, 5.0, 7.0)]
    df = spark.createDataFrame(rows, "id long, t double, v double")
    fits = series.polynomial_fit(df, "t", "v", 3)
    at = spark.createDataFrame([(1, 30.0), (2, 99.0)], "id long, t double")
    got = {r["id"]: r["fitted"] for r in series.extrapolate(fits, at, "t").collect()}
    assert got[1] == pytest.approx(1711.0, rel=1e-6) and got[2] == pytest.approx(7.0)
    assert fits.where("id = 1").first()["rmse"] < 1e-4
    lags = {(r["id"], r["lag"]): (r["n"], round(r["r"], 6)) for r in series.autocorrelation_function(df.withColumnRenamed("t", "time"), "v", 2).collect()}
    assert lags[1, 0] == (20, 1.0) and lags[1, 1][0] == 19 and lags[2, 0] == (1, 0.0)
    wave = spark.createDataFrame([(1, t, float([3, 1, 0, 1][t % 4])) for t in range(41)], "id long, time long, v double")
    assert series.best_period(series.periodicity(wave, "v", 3, 6)).first()["period"] == 4
    points = spark.createDataFrame([(0.5, 1.0), (0.7, 3.0), (1.5, 5.0)], "x double, y double")
    cells = {(r["level"], tuple(r["cell"])): r for r in profile.cell_mixture(points, ["x", "y"], [0.0, 0.0], [2.0, 8.0], 2).collect()}
    assert cells[0, (0, 0)]["n"] == 3 and cells[1, (0, 0)]["mean"] == pytest.approx([0.6, 2.0]) and cells[1, (0, 0)]["cov"] == pytest.approx([0.02, 0.2, 2.0])
    done = profile.finished(profile.sums(points, "y"))
    draws = [r["value"] for r in profile.drawn(done, 400).collect()]
    assert abs(sum(draws) / 400 - 3) < 0.4 and draws == [r["value"] for r in profile.drawn(done, 400).collect()]
    hits = spark.createDataFrame([([0.1, 5.0], 1.0), ([0.2, 9.0], 0.5), ([1.2, 5.0], 2.0)], "key array<double>, distance double")
    assert {(tuple(r["cell"]), r["n"], r["nearest"], round(r["share"], 3)) for r in spatial.regrouped(hits, [1.0, -1.0]).collect()} == {((0, 0), 2, 0.5, 0.667), ((1, 0), 1, 2.0, 0.333)}
