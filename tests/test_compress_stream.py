import numpy as np
from pyspark.sql import functions as F

from loomtide.operators import series


def _greedy(t, v, precision, max_degree):
    """The segmentation one window at a time."""
    out, lo, n = [], 0, len(t)
    fits = lambda hi: series._least_degree(t[lo:hi], v[lo:hi], precision, max_degree)
    while lo < n:
        good, step = lo + 1, 2
        while good < n and fits(min(lo + step, n)) >= 0:
            good, step = min(lo + step, n), step * 2
        bad = min(lo + step, n + 1)
        while bad - good > 1:
            mid = (good + bad) // 2
            good, bad = (mid, bad) if fits(mid) >= 0 else (good, mid)
        degree = fits(good)
        scale = max(t[good - 1] - t[lo], 1.0)
        w = series.fit_polynomial((t[lo:good] - t[lo]) / scale, v[lo:good], degree)
        out.append((int(t[lo]), int(t[good - 1]), scale, degree, w.tolist()))
        lo = good
    return out


def test_streamed_series_have_the_segments_of_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(series, "SERIES_ROWS", 50)
    rng = np.random.default_rng(3)
    kept, rows = {}, []
    for i, n in [(None, 40), (1, 1), (2, 2), *((k, 30) for k in range(3, 30)), (30, 900), (31, 260)]:
        t = np.sort(rng.integers(0, 10**12, n)).astype(float)
        v = np.round(rng.exponential(40, n), 2) if i != 31 else np.full(n, 7.0)
        if i == 5:
            t[3:9] = t[3]
            v[3:9] = v[3]
        if i == 6:
            v[:2] = [10.0, 20.0]
        kept[i] = _greedy(t, v, 5.0, 6)
        rows += [(i, int(a), float(b)) for a, b in zip(t, v, strict=True)]
    rows += [(1, None, 3.0), (2, 5, None)]
    got = series.compress(spark.createDataFrame(rows, "id long, time long, value double").repartition(7), "value", 5.0, 6)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    found = {}
    for r in got.orderBy("id", "start", F.desc("stop")).collect():
        found.setdefault(r["id"], []).append((r["start"], r["stop"], r["scale"], r["degree"], r["weights"]))
    assert found == kept


def test_windows_fitted_together_have_the_degrees_of_single_ones():
    rng = np.random.default_rng(4)
    t, v = np.sort(rng.random(4000)) * 1e9, np.round(rng.normal(0, 6, 4000), 1)
    lo = rng.integers(0, 3900, 600)
    hi = lo + rng.integers(1, 60, 600)
    want = [series._least_degree(t[a:b], v[a:b], 9.0, 9) for a, b in zip(lo, hi, strict=True)]
    assert series._least_degrees(t, v, lo, hi, 9.0, 9).tolist() == want
