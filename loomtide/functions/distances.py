"""Distances between arrays of doubles as Column expressions, and of whole blocks of vectors as numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6_371_000.0


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(x: Column, y: Column) -> Column:
    return _total(F.zip_with(x, y, lambda a, b: a * b))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def geo(x: Column, y: Column) -> Column:
    """Metres on a sphere between [latitude, longitude] in degrees."""
    lat1, lat2 = F.radians(x[0]), F.radians(y[0])
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(F.radians(y[1] - x[1]) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cosine(x: Column, y: Column) -> Column:
    """1 - similarity, similarity not below 0; 1 for a zero vector."""
    n = F.sqrt(dot(x, x) * dot(y, y))
    return 1 - F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot(x, y), n), F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """The correlation itself; 0 without variance."""
    n = F.size(x)
    sx, sy = _total(x), _total(y)
    cov = dot(x, y) - sx * sy / n
    spread = F.sqrt((dot(x, x) - sx * sx / n) * (dot(y, y) - sy * sy / n))
    return F.coalesce(F.try_divide(cov, spread), F.lit(0.0))


def gaussian(x: Column, y: Column, error: Column) -> Column:
    """The largest difference of a dimension in units of its allowed error."""
    return F.sqrt(F.array_max(F.zip_with(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), error, lambda d, e: d / e)))


# The same for blocks: ``x`` holds a vector a column, ``y`` too, and row j of the result holds y's vector j against all of x.
# Sums run over the dimensions in order, one by one, so every distance has the bits of its expression.


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((y.shape[1], x.shape[1]))
    term = np.empty_like(out)
    for a, b in zip(x, y, strict=True):
        np.multiply(b[:, None], a, out=term)
        out += term
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for a in x:
        out += a
    return out


def euclidean_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((y.shape[1], x.shape[1]))
    term = np.empty_like(out)
    for a, b in zip(x, y, strict=True):
        np.subtract(a, b[:, None], out=term)
        np.multiply(term, term, out=term)
        out += term
    return np.sqrt(out, out=out)


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, 0.0, a / b)


def cosine_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = np.sqrt(_sums(x * x) * _sums(y * y)[:, None])
    return 1 - np.maximum(0.0, _quotient(_dots(x, y), n))


def pearson_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n, sx, sy = len(x), _sums(x), _sums(y)[:, None]
    cov = _dots(x, y) - sx * sy / n
    spread = np.sqrt((_sums(x * x) - sx * sx / n) * (_sums(y * y)[:, None] - sy * sy / n))
    return _quotient(cov, spread)


#: Block forms of expressions.
BLOCKWISE = {euclidean: euclidean_block, cosine: cosine_block, pearson: pearson_block}
#: The distance where a vector holds a null component, if that is not null.
WITH_NULLS = {cosine_block: 1.0, pearson_block: 0.0}
