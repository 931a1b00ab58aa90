"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated at random and each coordinate kept as its sign, so a
code is d bits and two scalars: the inner product of the code with its vector,
which corrects the estimate, and the width of the error it leaves. The estimate of
a query's cosine is <code, rotated query> / <code, vector>; the exact value
lies within ``WIDTHS`` error widths of it nearly always. A vector is reranked on
its original components when its upper bound reaches the k-th largest lower bound.

The rotation is drawn from a seed and not fitted, so every row is indexed alike.
Codes are dealt into blocks by a hash of the id, queries likewise, and each pair of
a query block and a code block is one row; so neither side is ever broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import cut
from .vectors import QUERY_ROWS, block_pairs, blocks, clean, unpack

SEED, WIDTHS = 61_803, 2.5
#: Queries whose bounds a task holds at once.
QUERY_STEP = 256


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, correction and error scalar of unit vectors, one row each."""
    d = vectors.shape[1]
    turned = vectors @ rotation(d).T
    bits = turned > 0
    match = np.abs(turned).sum(1) / np.sqrt(d)
    error = np.sqrt(np.maximum(0, 1 - match**2)) / np.maximum(match, 1e-12) / np.sqrt(max(d - 1, 1))
    return np.packbits(bits, axis=1), match, error


def bounds(codes, match, error, queries) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines of each query (rows) with each code."""
    d = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    about = ((queries @ rotation(d).T).astype(np.float32) @ signs.T) / np.sqrt(d) / match
    return about - WIDTHS * error, about + WIDTHS * error


def _search(batches, k: int):
    for batch in batches:
        out = [[], [], []]
        for r in range(batch.num_rows):
            row = batch.slice(r, 1).to_pylist()[0]
            ids, queries = unpack(row["q_ids"], row["q_vectors"], row["d"])
            cid, c = unpack(row["c_ids"], row["c_vectors"], row["d"])
            codes = np.frombuffer(row["c_codes"], np.uint8).reshape(len(cid), -1)
            match, error = np.frombuffer(row["c_scalars"], np.float64).reshape(2, -1)
            length = np.sqrt((c * c).sum(1))
            for lo in range(0, len(ids), QUERY_STEP):
                qid, q = ids[lo : lo + QUERY_STEP], queries[lo : lo + QUERY_STEP]
                unit = q / np.linalg.norm(q, axis=1, keepdims=True)
                low, high = bounds(codes, match, error, unit)
                own = cid[None, :] == qid[:, None]
                low[own], high[own] = -np.inf, -np.inf
                m = min(k, len(cid))
                floor = np.partition(low, len(cid) - m, axis=1)[:, len(cid) - m]
                for i in range(len(qid)):
                    at = np.flatnonzero((high[i] >= floor[i]) & ~own[i])
                    score = (c[at] * q[i]).sum(1) / (length[at] * np.sqrt((q[i] * q[i]).sum()))
                    best = np.lexsort((cid[at], -score))[:k]
                    out[0].append(np.full(len(best), qid[i]))
                    out[1].append(cid[at][best])
                    out[2].append(score[best])
        cols = [np.concatenate([*o, np.zeros(0)]) for o in out]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2])], ["query_id", "vec_id", "score"])


def _codes(batches):
    for batch in batches:
        codes, scalars = [], []
        for row in batch.to_pylist():
            _, c = unpack(row["ids"], row["vectors"], row["d"])
            packed, match, error = encode(c / np.linalg.norm(c, axis=1, keepdims=True))
            codes.append(packed.tobytes())
            scalars.append(np.stack([match, error]).tobytes())
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(scalars, pa.binary())], [*names, "codes", "scalars"])


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Blocks of ids, vectors, packed codes and scalars of all usable vectors."""
    packed = blocks(clean(vectors, id_col, vector_col).where("norm2 > 0"))
    return packed.mapInArrow(_codes, f"{_ddl(packed)}, codes binary, scalars binary")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest by cosine: query_id, rank from 1, vec_id, score.

    The score is the exact cosine of the original components in double
    precision; ties go to the smaller vec_id and a query never finds its own id.
    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do null ids; vectors are only compared with those of the same length.
    Rows of ``vectors`` that repeat an id count once each. Queries of one id with other vectors are ranked together, equal
    ones count once. With fewer than k candidates all are
    returned; an empty side gives an empty result. Other columns are ignored.
    """
    held = cut(index(vectors, id_col, vector_col), "codes")
    asked = cut(blocks(clean(queries, id_col, vector_col).where("norm2 > 0").dropDuplicates(["id", "v"]), rows=QUERY_ROWS), "queries")
    pairs = block_pairs(held, asked)
    found = pairs.mapInArrow(lambda b: _search(b, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
