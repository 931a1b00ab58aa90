"""Functions of matrix columns: struct<rows, cols, data>, data by columns, as Arrow UDFs over numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

MATRIX = "struct<rows: int, cols: int, data: array<double>>"


def matrix(rows, cols, data) -> Column:
    """A matrix Column from its size and its cells by columns."""
    n = [x if isinstance(x, Column) else F.lit(x) for x in (rows, cols)]
    return F.struct(n[0].cast("int").alias("rows"), n[1].cast("int").alias("cols"), data.cast("array<double>").alias("data"))


def _read(column: pa.Array) -> list[np.ndarray | None]:
    return [None if x is None or x["data"] is None else np.array(x["data"], float).reshape((x["rows"], x["cols"]), order="F") for x in column.to_pylist()]


def _written(found: list[np.ndarray | None]) -> pa.Array:
    cells = [None if m is None else {"rows": m.shape[0], "cols": m.shape[1], "data": m.ravel(order="F").tolist()} for m in found]
    return pa.array(cells, pa.struct([("rows", pa.int32()), ("cols", pa.int32()), ("data", pa.list_(pa.float64()))]))


def _applied(f: Callable[..., np.ndarray], *columns: Column) -> Column:
    """``f`` of matrices, row by row within an Arrow batch; null where a matrix is null, an error where sizes do not fit."""
    if len(columns) == 1:

        @F.arrow_udf(MATRIX)
        def one(a: pa.Array) -> pa.Array:
            return _written([None if m is None else np.atleast_2d(f(m)) for m in _read(a)])

        return one(columns[0])

    @F.arrow_udf(MATRIX)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return _written([None if m is None or n is None else np.atleast_2d(f(m, n)) for m, n in zip(_read(a), _read(b), strict=True)])

    return two(*columns)


def multiply(a: Column, b: Column, transpose_a: bool = False, transpose_b: bool = False, alpha: float = 1.0) -> Column:
    return _applied(lambda m, n: alpha * ((m.T if transpose_a else m) @ (n.T if transpose_b else n)), a, b)


def transpose(a: Column) -> Column:
    return _applied(lambda m: m.T, a)


def add(a: Column, b: Column) -> Column:
    return _applied(lambda m, n: _same(m, n) + n, a, b)


def subtract(a: Column, b: Column) -> Column:
    return _applied(lambda m, n: _same(m, n) - n, a, b)


def hadamard(a: Column, b: Column) -> Column:
    return _applied(lambda m, n: _same(m, n) * n, a, b)


def _same(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    if m.shape != n.shape:
        raise ValueError(f"sizes {m.shape} and {n.shape} differ")
    return m


def scale(a: Column, factor: float) -> Column:
    """Without a UDF: cells times a number."""
    return matrix(a["rows"], a["cols"], F.transform(a["data"], lambda x: x * float(factor)))


def invert(a: Column) -> Column:
    """The inverse, or NaNs where there is none."""
    return _applied(lambda m: np.linalg.inv(m) if np.linalg.matrix_rank(m) == m.shape[0] else np.full_like(m, np.nan), a)


def pseudo_inverse(a: Column) -> Column:
    return _applied(np.linalg.pinv, a)


def solve(a: Column, b: Column) -> Column:
    """X with a X = b: exact for square matrices of full rank, by least squares else."""
    return _applied(lambda m, n: np.linalg.solve(m, n) if m.shape[0] == m.shape[1] == np.linalg.matrix_rank(m) else np.linalg.lstsq(m, n, rcond=None)[0], a, b)


def singular_values(a: Column) -> Column:
    """The singular values as one column, the largest first."""
    return _applied(lambda m: np.linalg.svd(m, compute_uv=False)[:, None], a)


def qr_factor(a: Column) -> Column:
    """The upper factor of a QR decomposition, with a diagonal that is not negative."""
    return _applied(lambda m: (lambda r: r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None])(np.linalg.qr(m, mode="r")), a)


def softmax(a: Column) -> Column:
    """Each column of the matrix as shares that sum to 1."""
    return _applied(lambda m: np.exp(m - m.max(0)) / np.exp(m - m.max(0)).sum(0), a)


def crop(a: Column, rows: int, cols: int) -> Column:
    return _applied(lambda m: m[:rows, :cols], a)


def expand(a: Column, rows: int, cols: int) -> Column:
    """The matrix in the upper left corner of zeros."""
    return _applied(lambda m: np.pad(m, ((0, max(0, rows - m.shape[0])), (0, max(0, cols - m.shape[1])))), a)


def append_column(a: Column, b: Column) -> Column:
    return _applied(lambda m, n: np.concatenate([m, n], axis=1), a, b)


def distance(a: Column, b: Column) -> Column:
    """The largest difference of two cells; null for other sizes."""
    fits = (a["rows"] == b["rows"]) & (a["cols"] == b["cols"])
    return F.when(fits, F.aggregate(F.zip_with(a["data"], b["data"], lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, x: F.greatest(m, x)))


def cell(a: Column, row: int, col: int) -> Column:
    """One cell, null outside the matrix."""
    inside = (F.lit(row) < a["rows"]) & (F.lit(col) < a["cols"])
    return F.when(inside, F.get(a["data"], (F.lit(col) * a["rows"] + row).cast("int")))


def filled(rows: int, cols: int, kind: str = "uniform", seed: int = 1, key: Column | None = None) -> Column:
    """A random matrix a row, uniform (0 to 1) or gaussian: the same for the same seed and key, whatever the partitions."""
    at = F.lit(0) if key is None else key
    unit = lambda i, s: (F.pmod(F.xxhash64(F.lit(seed + s), at, i), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draw = {"uniform": lambda i: unit(i, 0), "gaussian": lambda i: F.sqrt(-2 * F.ln(unit(i, 0))) * F.cos(6.283185307179586 * unit(i, 1))}[kind]
    return matrix(rows, cols, F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), draw))
