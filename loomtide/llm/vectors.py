"""Vectors as blocks of packed rows, and pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Vectors of a held block and of a block of queries. Each held block goes to every query block it may serve, so large
#: query blocks keep the shuffle small.
ROWS, QUERY_ROWS = 2048, 4096
#: Tasks that list the pairs of one vector length.
SALTS = 32


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles) and norm2 of the rows whose vector has only finite components."""
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def blocks(df: DataFrame, rows: int = ROWS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (d, *keys, block, ids, vectors) of about ``rows`` vectors each, dealt by a hash of id and vector.

    ``keys`` are further long columns to keep apart, with few distinct values.
    """
    per = df.withColumn("d", F.size("v").cast("long"))
    sizes = per.groupBy("d", *keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows)).alias("nb"))
    # One row for each length and key, so this side stays small whatever the number of vectors.
    dealt = per.join(sizes, ["d", *keys]).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("nb")).cast("long"))

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = [], []
        for b in batches:
            ids.append(b.column(b.schema.get_field_index("id")).to_numpy())
            data.append(b.column(b.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False))
        ids, data = np.concatenate(ids), np.concatenate(data).reshape(-1, key[0].as_py())
        order = np.argsort(ids, kind="stable")
        cols = [pa.array([k.as_py()], pa.int64()) for k in key]
        cols += [pa.array([ids[order].tobytes()], pa.binary()), pa.array([data[order].tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["d", *keys, "block", "ids", "vectors"])

    ddl = ", ".join(f"{c} long" for c in ("d", *keys, "block"))
    return dealt.select("d", *keys, "block", "id", "v").groupBy("d", *keys, "block").applyInArrow(pack, f"{ddl}, ids binary, vectors binary")


def unpack(ids: bytes, vectors: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, d)


def block_pairs(held: DataFrame, asked: DataFrame) -> DataFrame:
    """Every held block beside every asked block of the same vector length that may need it.

    The ids of blocks alone decide the pairs; each pair then fetches both packed
    rows by an equi-join, so a task holds one pair at a time. Where ``held`` has ``reach``, an upper bound of its norms,
    and ``asked`` has ``need``, a norm that anything worth finding has, pairs that cannot meet are never fetched.
    """
    keys = [c for c in held.columns if c in ("bucket", "block")]
    bounds = ["reach"] if "reach" in held.columns and "need" in asked.columns else []
    left = held.select("d", *keys, *bounds).distinct()
    right = asked.select("d", F.col("block").alias("q_block"), *(["need"] if bounds else [])).distinct()
    spread = F.array(*(F.lit(i) for i in range(SALTS)))
    left = left.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    ids = left.join(right.withColumn("salt", F.explode(spread)), ["d", "salt"])
    if bounds:
        ids = ids.where("reach >= need")
    ids = ids.select("d", *keys, "q_block").repartition(*keys, "q_block")
    h = held.drop("reach").select("d", *keys, *(F.col(c).alias(f"c_{c}") for c in held.columns if c not in ("d", "reach", *keys)))
    q = asked.drop("need").select("d", F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in asked.columns if c not in ("d", "block", "need")))
    return ids.join(h, ["d", *keys]).join(q, ["d", "q_block"]).repartition(*keys, "q_block")
