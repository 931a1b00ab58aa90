"""Exact top-k inner-product search over norm buckets.

Vectors are grouped by length: bucket b holds the norms from 2^(b/4) to below
2^((b+1)/4), and large buckets are cut into blocks. A first pass
scores every query against one block of the longest vectors, and its k-th score
there is a floor that the true k-th score cannot be under. A block whose bucket ends below
floor / |query| for every query of a query block is never sent there. In the second pass a
(query block, vector block) pair works from the local cosine threshold
floor / (|query| * longest vector of the block):

* above 1, nothing in the block can reach the floor and the query skips it;
* high, candidates are pruned by coordinate: on the query's heaviest coordinates,
  a vector of that cosine must lie in a narrow interval;
* otherwise candidates are pruned by length: norms below floor / |query| go.

What is left is verified by the integer product itself. Bounds are kept a hair
wide, so rounding never loses a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import cut
from .vectors import QUERY_ROWS, block_pairs, blocks, clean, unpack

#: From this local cosine threshold a block is pruned by coordinates.
COORDINATE_FROM = 0.6
FOCUS = 4
HAIR = 1e-9


def admitted(q: np.ndarray, c: np.ndarray, norms: np.ndarray, floor: float) -> np.ndarray:
    """Indices of the vectors of a block that may score ``floor`` or more."""
    length = np.sqrt(q @ q)
    if floor <= 0 or length == 0:
        return np.arange(len(c))
    need = floor / length * (1 - HAIR)
    threshold = need / max(norms.max(), HAIR)
    if threshold > 1:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(norms >= need)
    if threshold >= COORDINATE_FROM and len(at):
        unit = q / length
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            cosine = np.minimum(1.0, need / norms[at])
            wide = np.sqrt(max(0.0, 1 - unit[f] ** 2)) * np.sqrt(1 - cosine**2) + 1e-7
            x = c[at, f] / norms[at]
            # A vector in the cone around the query spans this interval on coordinate f.
            low = np.where(unit[f] <= -cosine, -1 - HAIR, unit[f] * cosine - wide)
            high = np.where(unit[f] >= cosine, 1 + HAIR, unit[f] * cosine + wide)
            at = at[(x >= low) & (x <= high)]
    return at


def products(c: np.ndarray, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-numbered vectors with a query; beyond a long they are an error."""
    if norms.max(initial=0.0) * np.sqrt(q @ q) < 2.0**52:
        return (c @ q).astype(np.int64)
    whole = [int(x) for x in q]
    out = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in c]
    if any(abs(x) >= 1 << 63 for x in out):
        raise ValueError("a product is beyond 64 bits")
    return np.array(out, np.int64)


def _scores(batches, k: int):
    for batch in batches:
        out = [[], [], []]
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            qid, q = unpack(row["q_ids"], row["q_vectors"], row["d"])
            cid, c = unpack(row["c_ids"], row["c_vectors"], row["d"])
            floors = np.frombuffer(row["q_floors"], np.float64) if row.get("q_floors") else np.full(len(qid), -np.inf)
            norms = np.sqrt((c * c).sum(1))
            for j in range(len(qid)):
                at = admitted(q[j], c, norms, floors[j]) if np.isfinite(floors[j]) else np.arange(len(c))
                at = at[cid[at] != qid[j]]
                score = products(c[at], q[j], norms[at])
                # Floors are rounded to doubles, so scores a hair below stay; the last ranking decides.
                reach = score >= floors[j] - abs(floors[j]) * HAIR
                at, score = at[reach], score[reach]
                best = np.lexsort((cid[at], -score))[:k]
                out[0].append(np.full(len(best), qid[j], np.int64))
                out[1].append(cid[at][best])
                out[2].append(score[best])
        cols = [np.concatenate([*o, np.zeros(0, np.int64)]) for o in out]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["query_id", "vec_id", "score"])


def _floors(batches, k: int):
    """Each query of a block with its floor: the k-th score of the seed block, or none; and the norm that the block's least demanding query needs."""
    for batch in batches:
        cols = batch.to_pydict()
        floors, needs = [], []
        for d, ids, vectors, seen in zip(cols["d"], cols["ids"], cols["vectors"], cols["seeds"], strict=True):
            known = {s["query_id"]: s["floor"] for s in seen or []}
            ids, q = unpack(ids, vectors, d)
            own = np.array([known.get(i, -np.inf) for i in ids.tolist()], np.float64)
            length = np.sqrt((q * q).sum(1))
            need = np.where((own > 0) & (length > 0), own / np.maximum(length, HAIR) * (1 - HAIR), -np.inf)
            floors.append(own.tobytes())
            needs.append(float(need.min()))
        at = [batch.schema.get_field_index(c) for c in ("d", "block", "ids", "vectors")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(floors, pa.binary()), pa.array(needs, pa.float64())], ["d", "block", "ids", "vectors", "floors", "need"])


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer products: query_id, rank from 1, vec_id, score.

    Components x become floor(scale * x). A query never finds its own id; ties go to
    the smaller vec_id; with fewer than k candidates all are returned. Vectors that
    are null, empty, or hold null or non-finite components take no part, nor do null
    ids, and vectors of different lengths are never compared. Rows of ``vectors`` that repeat an id count once each.
    Queries of one id with other vectors are ranked together, equal ones count once. An empty side gives an empty result; other columns are ignored. Products are exact; one that
    does not fit a long is an error.
    """
    def whole(df: DataFrame) -> DataFrame:
        v = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
        return clean(df, id_col, vector_col).select("id", v.alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))

    bucket = F.when(F.col("norm2") > 0, F.floor(F.log2("norm2") * 2)).otherwise(-1).cast("long")
    held = cut(blocks(whole(vectors).withColumn("bucket", bucket), keys=("bucket",)), "vectors")
    held = held.withColumn("reach", F.pow(F.lit(2.0), (F.col("bucket") + 1) / 4) * (1 + HAIR))
    asked = cut(blocks(whole(queries).dropDuplicates(["id", "v"]), rows=QUERY_ROWS // 4), "queries")

    longest = held.groupBy("d").agg(F.max(F.struct("bucket", -F.col("block"))).alias("x")).select("d", F.col("x.bucket").alias("bucket"), (-F.col("x.col2")).alias("block"))
    seeds = block_pairs(held.join(longest, ["d", "bucket", "block"], "left_semi"), asked)
    first = seeds.mapInArrow(lambda b: _scores(b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    member = asked.select("d", "block", F.explode(_ids("ids")).alias("query_id"))
    seen = member.join(floors, "query_id").groupBy("d", "block").agg(F.collect_list(F.struct("query_id", "floor")).alias("seeds"))
    armed = asked.join(seen, ["d", "block"], "left").mapInArrow(lambda b: _floors(b, k), "d long, block long, ids binary, vectors binary, floors binary, need double")
    found = block_pairs(held, cut(armed, "queries")).mapInArrow(lambda b: _scores(b, k), "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids(column: str):
    """The little-endian longs packed in a binary column."""
    at = F.sequence(F.lit(0), (F.length(column) / 8 - 1).cast("int"))
    return F.transform(at, lambda i: F.conv(F.hex(F.reverse(F.substring(F.col(column), i * 8 + 1, F.lit(8)))), 16, -10).cast("long"))
