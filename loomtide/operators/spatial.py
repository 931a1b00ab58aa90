"""Nearest neighbours, radius and box queries, and profiles over grid cells; all exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import distances

#: Blocks of points and of queries that are held against each other, where a distance is an expression alone.
BLOCKS = 16
#: Numbers in a packed block of points and of queries.
POINT_VALUES, QUERY_VALUES = 1 << 19, 1 << 16
#: Points and queries whose distances are computed together.
COLUMNS, ROWS = 2048, 16
#: Pairs that are arranged by distance together, and rows that are given on at once.
ARRANGED, SENT = 1 << 23, 1 << 18
#: A grid cell of more points than this is packed into blocks.
DENSE = 256
#: Columns of measured pairs.
FOUND = ["query_id", "point_id", "distance"]


def keep_last(points: DataFrame, order: str = "seq") -> DataFrame:
    """Points whose key was inserted again keep the last value."""
    rest = [c for c in points.columns if c != "key"]
    return points.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("s")).select("key", *(F.col(f"s.{c}").alias(c) for c in rest))


def _packed(rows: DataFrame, sizes: DataFrame, keys: list[str], own: str, other: str, values: int, name: str) -> DataFrame:
    """Rows (*keys, own, other, ids, vectors, holes) of about ``values`` numbers each, of the groups in ``sizes``.

    ``rows`` has the keys, the vector length ``_d`` among them, ``id`` and ``v``. ``own`` numbers the side's blocks, which ``sizes``
    counts; ``other`` is the count of the other side's. Ids are in order; holes mark vectors with null components.
    """
    dealt = rows.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64("id", "v"), F.col(own)).cast("int"))
    group = [*keys, own, other]

    def block(key: tuple[pa.Scalar, ...], ids: list[pa.Array], vectors: list[pa.ListArray]) -> pa.RecordBatch:
        d = key[keys.index("_d")].as_py()
        held, lists = pa.chunked_array(ids).combine_chunks(), pa.chunked_array(vectors).combine_chunks()
        order = pc.sort_indices(held, null_placement="at_start")
        flat = lists.flatten()
        hole = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(held), d).any(axis=1)
        data = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), d)[order.to_numpy()]
        # Numbers that were floats before take four bytes.
        with np.errstate(all="ignore"):
            small = data.astype(np.float32)
        if np.array_equal(small.astype(np.float64).view(np.int64), data.view(np.int64)):
            data = small
        taken = held.take(order)
        offsets = pa.array([0, len(taken)], pa.int32())
        cols = [pa.array([k.as_py()], k.type) for k in key]
        cols += [pa.ListArray.from_arrays(offsets, taken), pa.array([data.T.tobytes()], pa.binary()), pa.array([hole[order.to_numpy()].tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, [*group, f"{name}_ids", f"{name}_vectors", f"{name}_holes"])

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 2 * max(1, values // max(1, key[keys.index("_d")].as_py()))
        ids, vectors, n = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                if n and n + part.num_rows > most:
                    yield block(key, ids, vectors)
                    ids, vectors, n = [], [], 0
                ids.append(part.column(part.schema.get_field_index("id")))
                vectors.append(part.column(part.schema.get_field_index("v")))
                n += part.num_rows
        if n:
            yield block(key, ids, vectors)

    kinds = dict(dealt.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in group)
    return dealt.select(*group, "id", "v").groupBy(*group).applyInArrow(pack, f"{ddl}, {name}_ids array<{kinds['id']}>, {name}_vectors binary, {name}_holes binary")


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded as F.round does it: half up on the shortest decimals of each number."""
    size = np.abs(x)
    scaled = size * 10.0**digits
    whole = np.floor(scaled)
    part = scaled - whole
    out = np.copysign((whole + (part >= 0.5)) / 10.0**digits, x) + 0.0
    # Products close to a half, or too large to be exact, are decided on the decimals.
    for i in np.flatnonzero(np.isfinite(x) & ((np.abs(part - 0.5) < 1e-9 + 1e-15 * scaled) | (scaled >= 1e12))):
        value = Decimal(repr(float(x[i])))
        out[i] = float(value.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400))) + 0.0
    return np.where(np.isfinite(x), out, x)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[pa.Array, np.ndarray, np.ndarray], ...]]:
    """Ids, vectors (one a column) and holes of the points and of the queries of each pair of blocks."""
    for batch in batches:
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        for i in range(batch.num_rows):
            d, sides = col("_d")[i].as_py(), []
            for c in "pq":
                ids, raw = col(f"{c}_ids")[i].values, col(f"{c}_vectors")[i].as_buffer()
                vectors = np.frombuffer(raw, np.float32 if raw.size == 4 * d * len(ids) else np.float64).astype(np.float64, copy=False)
                sides.append((ids, vectors.reshape(d, len(ids)), np.frombuffer(col(f"{c}_holes")[i].as_buffer(), bool)))
            yield tuple(sides)


def _distances(measure: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, hole: np.ndarray, y: np.ndarray, q_hole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of some queries, a row each, to a block of points, and where they are null."""
    y = np.ascontiguousarray(y)
    with np.errstate(all="ignore"):
        dist = np.concatenate([measure(x[:, a : a + COLUMNS], y) for a in range(0, x.shape[1], COLUMNS)], axis=1)
    empty = hole | q_hole[:, None]
    if measure in distances.WITH_NULLS:
        dist[empty] = distances.WITH_NULLS[measure]
        empty[:] = False
    return dist, empty


def _measured(batches: Iterator[pa.RecordBatch], measure: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, radius: float) -> Iterator[pa.RecordBatch]:
    """(query_id, point_id, distance) of each pair of blocks: of each query the k first, or all, below the radius."""
    for (pid, x, hole), (qid, y, q_hole) in _sides(batches):
        for lo in range(0, len(qid), ROWS):
            dist, empty = _distances(measure, x, hole, y[:, lo : lo + ROWS], q_hole[lo : lo + ROWS])
            out = ([], [], [])
            for j in range(len(dist)):
                at = np.flatnonzero((dist[j] < radius) & ~empty[j]) if radius > 0 else None
                if k > 0:
                    # Nulls come first and NaN last, as in an ORDER BY; equal distances stay in the order of ids.
                    by = np.where(empty[j], -np.inf, dist[j])
                    at = np.arange(len(by)) if at is None else at
                    if len(at) > k:
                        last = np.partition(by[at], k - 1)[k - 1]
                        at = at if np.isnan(last) else at[by[at] <= last]
                    at = at[np.argsort(by[at], kind="stable")[:k]]
                n = len(pid) if at is None else len(at)
                if not n:
                    continue
                out[0].append(pa.repeat(qid[lo + j], n))
                out[1].append(pid if at is None else pid.take(pa.array(at)))
                value, null = (dist[j], empty[j]) if at is None else (dist[j][at], empty[j][at])
                out[2].append(pa.array(value, mask=null) if null.any() else pa.array(value))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out], FOUND)


def _ascending(values: np.ndarray) -> np.ndarray:
    """Positions by ascending value, numbers that aren't finite at the ends; values less than a 2^37th of their range apart may mix."""
    finite = np.isfinite(values)
    if not finite.any():
        return np.arange(len(values))
    low, high = values.min(where=finite, initial=np.inf), values.max(where=finite, initial=-np.inf)
    # Value and position make up one integer: sorting those takes a sixth of the time that sorting positions by value does.
    bits = len(values).bit_length()
    by = np.nan_to_num(values, nan=high, posinf=high, neginf=low)
    by *= 0.5
    by -= low * 0.5
    by *= 2.0 ** (61 - bits) / max(high * 0.5 - low * 0.5, 1e-280)
    by = by.astype(np.int64)
    by <<= bits
    by |= np.arange(len(by))
    by.sort()
    by &= (1 << bits) - 1
    return by


def _all_measured(batches: Iterator[pa.RecordBatch], measure: Callable[[np.ndarray, np.ndarray], np.ndarray], digits: int) -> Iterator[pa.RecordBatch]:
    """(query_id, point_id, distance) of every pair of each pair of blocks, rounded.

    Rows come by distance, of which far fewer differ than there are pairs: written by columns they take less than half the disk.
    """
    for (pid, x, hole), (qid, y, q_hole) in _sides(batches):
        step = max(1, ARRANGED // len(pid))
        for lo in range(0, len(qid), step):
            most = min(len(qid), lo + step)
            dist, empty = np.empty((most - lo, len(pid))), np.zeros((most - lo, len(pid)), bool)
            for at in range(lo, most, ROWS):
                some = slice(at, min(at + ROWS, most))
                part, null = _distances(measure, x, hole, y[:, some], q_hole[some])
                with np.errstate(all="ignore"):
                    dist[at - lo : some.stop - lo] = _half_up(part.ravel(), digits).reshape(part.shape)
                empty[at - lo : some.stop - lo] = null
            dist, empty = dist.ravel(), empty.ravel() if empty.any() else None
            order = _ascending(dist)
            for at in range(0, len(order), SENT):
                pairs = order[at : at + SENT]
                q, p = np.divmod(pairs.astype(np.int32), np.int32(len(pid)))
                value = pa.array(dist[pairs]) if empty is None else pa.array(dist[pairs], mask=empty[pairs])
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(q + lo)), pid.take(pa.array(p)), value], FOUND)


def _by_blocks(points: DataFrame, queries: DataFrame, keys: list[str], measure: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int = -1, radius: float = -1.0, digits: int | None = None) -> DataFrame:
    """(query_id, point_id, distance) of points (*keys, id, v) and queries (*keys, id, v) of equal keys and lengths; with digits, of all pairs and rounded.

    Both sides are packed into blocks of a bounded size; each pair of blocks is one row, measured by numpy. Without keys, where every block
    meets every other, each block is shuffled once and read by many tasks (a nested product): dealing copies of it to all partners would
    write an amount that grows with the square of the rows. With keys, groups are apart, and copies of a group's blocks meet in an equi-join.
    """
    p, q = (df.withColumn("_d", F.size("v")).where("v is not null") for df in (points, queries))
    lone, keys = not keys, [*keys, "_d"]
    counted = lambda df, name, values: df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.greatest("_d", F.lit(1)) / values)).cast("int").alias(name))
    sizes = counted(p, "_b", POINT_VALUES).join(counted(q, "_c", QUERY_VALUES), keys)
    left, right = _packed(p, sizes, keys, "_b", "_c", POINT_VALUES, "p"), _packed(q, sizes, keys, "_c", "_b", QUERY_VALUES, "q")
    if lone:
        # A task has some blocks of points and some of queries, whose parts are few: parts of points are many already.
        parts = max(1, isqrt(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        left, right = left.drop("_c").repartition("_d", "_b"), right.drop("_b").repartitionById(parts, F.pmod(F.col("_d") + F.col("_c"), F.lit(parts)))
        pairs = left.hint("shuffle_replicate_nl").join(right, keys)
    else:
        # Each block is dealt once for every block of the other side.
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        pairs = left.withColumn("_c", every("_c")).join(right.withColumn("_b", every("_b")), [*keys, "_b", "_c"])
    ddl = f"query_id {dict(queries.dtypes)['id']}, point_id {dict(points.dtypes)['id']}, distance double"
    return pairs.mapInArrow(lambda batches: _measured(batches, measure, k, radius) if digits is None else _all_measured(batches, measure, digits), ddl)


def _vectors(points: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return points.select("id", F.col("key").cast("array<double>").alias("v")), queries.select(F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v"))


def all_distances(points: DataFrame, queries: DataFrame, distance: Callable[[Column, Column], Column], digits: int) -> DataFrame:
    """Every query's distance to every point of its length, rounded: query_id, point_id, distance. Its rows are as many as the pairs."""
    if distance in distances.BLOCKWISE:
        return _by_blocks(*_vectors(points, queries), [], distances.BLOCKWISE[distance], digits=digits)
    return around(points, queries, distance=distance).select("query_id", "point_id", F.round("distance", digits).alias("distance"))


def around(points: DataFrame, queries: DataFrame, k: int = -1, radius: float = -1.0, distance: Callable[[Column, Column], Column] = distances.euclidean) -> DataFrame:
    """Each query's points by distance: query_id, rank, point_id, distance.

    At most k of them (k <= 0: all) with distance below the radius (radius <= 0: all).
    ``queries`` (query_id, q) is a stated set held against all points. Distances that have a block form
    are measured on pairs of packed blocks, which keep k points of each query; others on single pairs, in ``BLOCKS`` blocks
    of points and queries by hash, each pair of blocks one group of an equi-join. Ties go to the smaller point_id.
    """
    if distance in distances.BLOCKWISE:
        found = _by_blocks(*_vectors(points, queries), [], distances.BLOCKWISE[distance], k, radius)
    else:
        every = F.explode(F.array(*(F.lit(i) for i in range(BLOCKS))))
        p = points.select(F.col("id").alias("point_id"), "key", F.size("key").alias("_d"), F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int").alias("_b"))
        q = queries.select("query_id", "q", F.size("q").alias("_d"), F.pmod(F.xxhash64("query_id"), F.lit(BLOCKS)).cast("int").alias("_c"))
        pairs = p.withColumn("_c", every).join(q.withColumn("_b", every), ["_d", "_b", "_c"])
        found = pairs.select("query_id", "point_id", distance(F.col("key"), F.col("q")).alias("distance"))
        if radius > 0:
            found = found.where(F.col("distance") < radius)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "point_id"))).select("query_id", "point_id", "distance", "rank")
    return ranked.where(F.col("rank") <= k) if k > 0 else ranked


def radius_by_grid(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """Pairs closer than a radius, for any number of queries: an equi-join on grid cells of that width.

    The grid covers the first two dimensions, so a query meets nine cells. Cells of more than ``DENSE`` points, as vectors of
    many dimensions fill them, are packed into blocks of a bounded size, so no cell is one task's.
    """
    cell = lambda c, i: F.floor(F.col(c)[i] / radius)
    p = points.select("id", F.col("key").cast("array<double>").alias("v"), cell("key", 0).alias("cx"), cell("key", 1).alias("cy"))
    near = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    q = queries.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select(F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v"), (cell("q", 0) + F.col("dx")).alias("cx"), (cell("q", 1) + F.col("dy")).alias("cy"))
    dense = p.groupBy("cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("cx", "cy")
    many = _by_blocks(p.join(dense, ["cx", "cy"]), q.join(dense, ["cx", "cy"]), ["cx", "cy"], distances.euclidean_block, radius=radius)
    few = p.join(dense, ["cx", "cy"], "left_anti").select(F.col("id").alias("point_id"), "v", "cx", "cy").join(q.select(F.col("id").alias("query_id"), F.col("v").alias("w"), "cx", "cy"), ["cx", "cy"])
    few = few.select("query_id", "point_id", distances.euclidean(F.col("v"), F.col("w")).alias("distance")).where(F.col("distance") < radius)
    return many.unionByName(few)


def area(points: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Points of a closed box with their distance from its centre."""
    inside = F.lit(True)
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        inside = inside & F.col("key")[i].between(a, b)
    centre = F.array(*(F.lit((a + b) / 2) for a, b in zip(low, high, strict=True)))
    return points.where(inside).select(F.col("id").alias("point_id"), distances.euclidean(F.col("key"), centre).alias("distance"))


def tree_profile(points: DataFrame, low: list[float], width: list[float], weight: str) -> DataFrame:
    """Summed weights of the grid cells; a width of 0 or less collapses its dimension."""
    cells = [F.floor((F.col("key")[i] - a) / w).cast("long") if w > 0 else F.lit(0).cast("long") for i, (a, w) in enumerate(zip(low, width, strict=True))]
    return points.groupBy(*(c.alias(f"cell{i}") for i, c in enumerate(cells))).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def regrouped(hits: DataFrame, resolutions: list[float]) -> DataFrame:
    """Hits (key, distance) on a coarser grid: cell, n, nearest; a resolution of 0 or less collapses its dimension. The largest cells come first by share."""
    cell = F.array(*(F.floor(F.col("key")[i] / r).cast("long") if r > 0 else F.lit(0).cast("long") for i, r in enumerate(resolutions)))
    cells = hits.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("distance").alias("nearest"))
    total = hits.agg(F.count("*").alias("_all"))
    return cells.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row
