"""Time series: differences, autocorrelation, periods, polynomial fits and compression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def difference(df: DataFrame, x: str, order: int = 1, by: str = "id", time: str = "time") -> DataFrame:
    """The value's difference to the one before, ``order`` times over; the first rows fall away."""
    w = Window.partitionBy(by).orderBy(time)
    out = df.withColumn("d", F.col(x))
    for _ in range(order):
        out = out.withColumn("d", F.col("d") - F.lag("d").over(w))
    return out.where(F.col("d").isNotNull())


def autocorrelation(df: DataFrame, x: str, lag: int, by: str = "id", time: str = "time") -> DataFrame:
    """Correlation of each series with itself ``lag`` steps before; 0 without variance."""
    w = Window.partitionBy(by).orderBy(time)
    pairs = df.withColumn("_y", F.lag(x, lag).over(w)).where("_y is not null")
    n, a, b = F.count("*"), F.sum(x), F.sum("_y")
    cov = F.sum(F.col(x) * F.col("_y")) - a * b / n
    va, vb = F.sum(F.col(x) * F.col(x)) - a * a / n, F.sum(F.col("_y") * F.col("_y")) - b * b / n
    return pairs.groupBy(by).agg(n.alias("n"), F.coalesce(F.try_divide(cov, F.sqrt(va * vb)), F.lit(0.0)).alias("r"))


def periodicity(df: DataFrame, x: str, low: int, high: int, by: str = "id", time: str = "time") -> DataFrame:
    """(id, period, score) of each candidate: mean correlation of each whole chunk with the folded sum of all values."""
    w = Window.partitionBy(by).orderBy(time)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).select(by, "_i", F.col(x).alias("_v"))
    each = rows.withColumn("period", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("_p", F.col("_i") % F.col("period")).withColumn("_c", F.floor(F.col("_i") / F.col("period")))
    size = each.groupBy(by, "period", "_c").agg(F.count("*").alias("_n"))
    whole = each.join(size.where("_n = period").drop("_n"), [by, "period", "_c"])
    fold = each.groupBy(by, "period", "_p").agg(F.sum("_v").alias("_f"))
    both = whole.join(fold, [by, "period", "_p"])
    n, a, b = F.count("*"), F.sum("_v"), F.sum("_f")
    r = F.try_divide(F.sum(F.col("_v") * F.col("_f")) - a * b / n, F.sqrt((F.sum(F.col("_v") * F.col("_v")) - a * a / n) * (F.sum(F.col("_f") * F.col("_f")) - b * b / n)))
    return both.groupBy(by, "period", "_c").agg(r.alias("_r")).groupBy(by, "period").agg(F.avg(F.coalesce("_r", F.lit(0.0))).alias("score"))


def best_period(scores: DataFrame, by: str = "id") -> DataFrame:
    """(id, period, score) of the best candidate of ``periodicity``, the shortest of equal ones."""
    return scores.groupBy(by).agg(F.max_by(F.struct("period", "score"), F.struct("score", -F.col("period"))).alias("s")).select(by, "s.period", "s.score")


def autocorrelation_function(df: DataFrame, x: str, lags: int, by: str = "id", time: str = "time") -> DataFrame:
    """(id, lag, n, r) for lags from 0 to below ``lags``, from one sort of the series."""
    w = Window.partitionBy(by).orderBy(time)
    held = df.select(by, F.col(x).alias("_x"), F.array(*(F.lag(x, k).over(w) for k in range(lags))).alias("_l"))
    pairs = held.select(by, "_x", F.posexplode("_l").alias("lag", "_y")).where("_x is not null and _y is not null")
    n, a, b = F.count("*"), F.sum("_x"), F.sum("_y")
    cov = F.sum(F.col("_x") * F.col("_y")) - a * b / n
    va, vb = F.sum(F.col("_x") * F.col("_x")) - a * a / n, F.sum(F.col("_y") * F.col("_y")) - b * b / n
    return pairs.groupBy(by, "lag").agg(n.alias("n"), F.coalesce(F.try_divide(cov, F.sqrt(va * vb)), F.lit(0.0)).alias("r"))


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int, by: str = "id") -> DataFrame:
    """(id, low, span, n, weights, rmse): least squares of a degree in u = (x - low) / span, from sums of powers.

    The sums are partial on every task, so a long series is no single group; each series' small system is then solved.
    Rows without x or y take no part; a series of few points has the degree that its points allow.
    """
    rows = df.select(by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    ends = rows.groupBy(by).agg(F.min("_x").alias("low"), (F.max("_x") - F.min("_x")).alias("_w")).withColumn("span", F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0)).drop("_w")
    u = rows.join(ends, by).withColumn("_u", (F.col("_x") - F.col("low")) / F.col("span") * 2 - 1)
    sums = u.groupBy(by, "low", "span").agg(F.count("*").alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"), F.array(*(F.sum(F.pow("_u", F.lit(k))) for k in range(2 * degree + 1))).alias("_s"), F.array(*(F.sum(F.pow("_u", F.lit(k)) * F.col("_y")) for k in range(degree + 1))).alias("_t"))

    @F.arrow_udf("struct<weights: array<double>, rmse: double>")
    def solved(n: pa.Array, yy: pa.Array, s: pa.Array, t: pa.Array) -> pa.Array:
        out = []
        for count, square, powers, moments in zip(n.to_pylist(), yy.to_pylist(), s.to_pylist(), t.to_pylist(), strict=True):
            k = min(degree, count - 1) + 1
            gram = np.array([[powers[i + j] for j in range(k)] for i in range(k)])
            w = np.linalg.lstsq(gram, np.array(moments[:k]), rcond=None)[0]
            error = square - 2 * w @ np.array(moments[:k]) + w @ gram @ w
            out.append({"weights": w.tolist(), "rmse": float(np.sqrt(max(0.0, error) / count))})
        return pa.array(out, pa.struct([("weights", pa.list_(pa.float64())), ("rmse", pa.float64())]))

    return sums.withColumn("_f", solved("n", "_yy", "_s", "_t")).select(by, "low", "span", "n", "_f.weights", "_f.rmse")


def extrapolate(fits: DataFrame, at: DataFrame, x: str, by: str = "id") -> DataFrame:
    """The rows of ``at`` (id, x) with the fitted value, also outside of the points."""
    u = (F.col(x) - F.col("low")) / F.col("span") * 2 - 1
    value = F.aggregate(F.reverse("weights"), F.lit(0.0), lambda s, w: s * u + w)
    return at.join(fits, by).withColumn("fitted", value).select(*at.columns, "fitted")


def linear_fit(df: DataFrame, x: str, y: str, by: str = "id") -> DataFrame:
    """Least squares of degree 1 from sums."""
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def fit_polynomial(t: np.ndarray, v: np.ndarray, degree: int) -> np.ndarray:
    """Weights of t^0, t^1, ... by least squares."""
    return np.linalg.lstsq(np.vander(t, degree + 1, increasing=True), v, rcond=None)[0]


#: Rows that a task segments together, numbers of windows fitted at once, and the fewest windows worth fitting together.
SERIES_ROWS, WINDOW_NUMBERS, TOGETHER = 1 << 18, 1 << 17, 8
#: A column less independent than this of lower powers, and errors this close to the precision, are left to least squares.
INDEPENDENT, CLOSE = 1e-5, 1e-6


def _least_degree(t: np.ndarray, v: np.ndarray, precision: float, max_degree: int) -> int:
    """The least degree whose least squares keep every error within the precision; -1 if none does."""
    u = (t - t[0]) / max(t[-1] - t[0], 1.0)
    for degree in range(min(max_degree, len(t) - 1) + 1):
        w = fit_polynomial(u, v, degree)
        if np.abs(np.vander(u, degree + 1, increasing=True) @ w - v).max() <= precision:
            return degree
    return -1


def _least_degrees(t: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, precision: float, max_degree: int) -> np.ndarray:
    """``_least_degree`` of many windows [lo, hi) together, by residuals against orthogonal polynomials; doubtful ones by least squares."""
    out = np.full(len(lo), -2)
    size = hi - lo
    order = np.argsort(size, kind="stable") if len(lo) >= TOGETHER else np.zeros(0, np.int64)
    at = 0
    while at < len(order):
        n = max(1, WINDOW_NUMBERS // int(size[order[at]]))
        # Windows of one call differ in length by half at most.
        some = order[at : at + n]
        some = some[size[some] <= size[some[0]] * 1.5]
        at += len(some)
        width = np.arange(size[some].max())
        held = width < size[some, None]
        place = np.minimum(lo[some, None] + width, hi[some, None] - 1)
        u = (t[place] - t[lo[some], None]) / np.maximum(t[hi[some] - 1] - t[lo[some]], 1.0)[:, None]
        r = np.where(held, v[place], 0.0)
        close = CLOSE * np.maximum(1.0, np.abs(r).max(axis=1))
        power, basis = held.astype(float), []
        for degree in range(min(max_degree, int(size[some].max()) - 1) + 1):
            column, whole = power, np.sqrt((power * power).sum(axis=1))
            for q in (*basis, *basis):
                column = column - (q * column).sum(axis=1, keepdims=True) * q
            left = np.sqrt((column * column).sum(axis=1))
            sure = left > INDEPENDENT * whole
            q = column / np.where(sure, left, 1.0)[:, None]
            r = r - (q * r).sum(axis=1, keepdims=True) * q
            error = np.abs(r).max(axis=1)
            fits, fails = sure & (error <= precision - close), sure & (error > precision + close)
            out[some[fits]] = degree
            out[some[fails & (degree >= np.minimum(max_degree, size[some] - 1))]] = -1
            # What neither fits nor fails for sure stays at -2.
            on = fails & (degree < np.minimum(max_degree, size[some] - 1))
            if not on.any():
                break
            if not on.all():
                some, held, u, r, close, power, q = (x[on] for x in (some, held, u, r, close, power, q))
                basis = [b[on] for b in basis]
            basis.append(q)
            power = power * u
    for i in np.flatnonzero(out == -2):
        out[i] = _least_degree(t[lo[i] : hi[i]], v[lo[i] : hi[i]], precision, max_degree)
    return out


def _segments(t: np.ndarray, v: np.ndarray, starts: np.ndarray, stops: np.ndarray, ended: bool, precision: float, max_degree: int) -> tuple[list, int]:
    """Segments (lo, hi, degree) of the series [start, stop), one window of each series at a time; and where the last one is still
    open, if it has not ``ended``."""
    lo, stop, series = starts.copy(), stops, np.arange(len(starts))
    good, step, bad, degree = lo + 1, np.full(len(lo), 2), np.full(len(lo), -1), np.zeros(len(lo), np.int64)
    out, rest = [], len(t)
    active = np.ones(len(lo), bool)
    while True:
        grown = active & (bad < 0) & (good >= stop)
        if not ended and active[-1] and bad[-1] < 0 and lo[-1] + step[-1] > stop[-1]:
            rest, active[-1], grown[-1] = int(lo[-1]), False, False
        bad[grown] = good[grown] + 1
        done = active & (bad >= 0) & (bad - good <= 1)
        if done.any():
            out += zip(series[done].tolist(), lo[done].tolist(), good[done].tolist(), degree[done].tolist(), strict=True)
            lo[done] = good[done]
            good[done], step[done], bad[done], degree[done] = lo[done] + 1, 2, -1, 0
            active &= lo < stop
            continue
        if not active.any():
            return sorted(out), rest
        i = np.flatnonzero(active)
        growing = bad[i] < 0
        hi = np.where(growing, np.minimum(lo[i] + step[i], stop[i]), (good[i] + bad[i]) // 2)
        found = _least_degrees(t, v, lo[i], hi, precision, max_degree)
        fits = found >= 0
        bad[i] = np.where(fits, bad[i], hi)
        good[i] = np.where(fits, hi, good[i])
        degree[i] = np.where(fits, found, degree[i])
        step[i] = np.where(fits & growing, step[i] * 2, step[i])


def compress(df: DataFrame, x: str, precision: float = 1.0, max_degree: int = 20, by: str = "id", time: str = "time") -> DataFrame:
    """Piecewise polynomials of each series: (id, start, stop, scale, degree, weights).

    A segment takes points while some degree up to the largest keeps every error within the
    precision, and else a new one starts. A segment's ends grow and shrink by
    doubling and halving, so a series of n points takes n log n work. Rows are shuffled by series and sorted; a task reads them as a
    stream, fits windows of many series together and holds of the last one only the points of its open segment. Rows without a time
    or value take no part; values that are not finite are an error.
    """
    kind = dict(df.dtypes)[by]
    ddl = f"{by} {kind}, start long, stop long, scale double, degree int, weights array<double>"

    def cut_up(rows: pa.Table, ended: bool) -> tuple[pa.RecordBatch, pa.Table]:
        keys = rows[by].combine_chunks()
        t, v = (rows[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float) for c in (time, x))
        if not np.isfinite(v).all():
            raise ValueError(f"{x} holds values that are not finite")
        code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(code, prepend=-1) != 0)
        found, rest = _segments(t, v, starts, np.append(starts[1:], len(t)), ended, precision, max_degree)
        scales, weights = [], []
        for _, lo, hi, degree in found:
            scale = max(t[hi - 1] - t[lo], 1.0)
            scales.append(scale)
            weights.append(fit_polynomial((t[lo:hi] - t[lo]) / scale, v[lo:hi], degree))
        lo, hi, degrees = (np.array([f[i] for f in found], np.int64) for i in (1, 2, 3))
        offsets = np.cumsum([0, *map(len, weights)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*weights, np.zeros(0)])))
        cols = [keys.take(pa.array(lo)), pa.array(t[lo].astype(np.int64)), pa.array(t[hi - 1].astype(np.int64)), pa.array(scales, pa.float64()), pa.array(degrees.astype(np.int32)), lists]
        return pa.RecordBatch.from_arrays(cols, [by, "start", "stop", "scale", "degree", "weights"]), rows.slice(rest)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        # An open segment that fills the buffer doubles it, so no row is read again for each batch.
        most = SERIES_ROWS
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= most:
                out, rest = cut_up(pa.concat_tables(held), False)
                held, n = [rest], rest.num_rows
                most = max(SERIES_ROWS, 2 * n)
                yield out
        if n:
            yield cut_up(pa.concat_tables(held), True)[0]

    rows = df.select(by, time, x).where(F.col(time).isNotNull() & F.col(x).isNotNull())
    return rows.repartition(by).sortWithinPartitions(by, time).mapInArrow(stream, ddl)


def read_polynomial(segments: DataFrame, at: DataFrame, by: str = "id", time: str = "time") -> DataFrame:
    """The compressed value at (id, time) points inside segments."""
    out = at.join(segments, by).where(F.col(time).between(F.col("start"), F.col("stop")))
    u = (F.col(time) - F.col("start")) / F.col("scale")
    powers = F.transform("weights", lambda w, i: w * F.pow(u, i))
    return out.select(by, time, F.aggregate(powers, F.lit(0.0), lambda s, p: s + p).alias("value"))


def outliers(df: DataFrame, x: str, last: int, by: str = "id", time: str = "time") -> DataFrame:
    """Values outside 1.5 interquartile ranges of the ``last`` values up to each."""
    w = Window.partitionBy(by).orderBy(time).rowsBetween(-last + 1, 0)
    q = lambda p: F.percentile(x, p).over(w)
    out = df.withColumn("_a", q(0.25)).withColumn("_b", q(0.75))
    spread = 1.5 * (F.col("_b") - F.col("_a"))
    return out.withColumn("outlier", F.isnan(x) | (F.col(x) < F.col("_a") - spread) | (F.col(x) > F.col("_b") + spread)).drop("_a", "_b")
