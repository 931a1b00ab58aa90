"""Near-duplicate documents by SetSketch registers.

Every document's set of word shingles is summarised by ``REGISTERS`` registers:
register i holds floor(1 - log_b x_i), truncated to 16 bits, where x_i is the
smallest of the set's exponentially distributed values under the i-th hash.
Registers of a union are the registers' maxima, so sketches merge; equal
registers are the likelier the more alike two sets are. ``ROWS`` registers
make a band, and texts that share a band value are candidates. Candidates
are scored by the joint likelihood of (registers above, below, equal) given both
exact set sizes, and those that may reach the threshold are confirmed on
the full sets.

Documents with equal sets are one class from the start. Within a band value the
members are held against one hub, never against each other. Band values
whose members still lie in several components after that go on to a second hub,
and then to an exact pass over blocks of about ``BLOCK`` members a side. That pass
holds their full sets, looks at a pair only in the first band it shares, and
returns only links that join components, at most one less than the members. So
no component is lost to the hubs, and no pair is written before it is confirmed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import buffers as B
from .components import stars
from .storage import cut, small_batches

#: Four registers of 16 bits are one 64-bit word.
REGISTERS, ROWS = 128, 4
SKETCH_BASE, SKETCH_RATE = 1.001, 20.0
#: A side of a block has about this many members, and this many shingles unless one set has more.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Twice the log-likelihood a pair may lie below the threshold's and still be confirmed.
SLACK = 36.0
_rng = np.random.default_rng(7_117_031)
MULTIPLIERS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE_MULTIPLIERS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers_of(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; all zero for the empty set."""
    if not len(values):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(values), 2048):
        np.minimum(low, np.multiply.outer(values[i : i + 2048], MULTIPLIERS).min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) * 2.0**-64) / SKETCH_RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(SKETCH_BASE)), 0, 65535).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def _log_p(x: np.ndarray) -> np.ndarray:
    p = -np.log1p(-np.clip(x, 0, 1) * (SKETCH_BASE - 1) / SKETCH_BASE) / np.log(SKETCH_BASE)
    return np.clip(p, 1e-9, 1 - 1e-9)


def log_likelihood(above, below, equal, n_a, n_b, jaccard):
    """Joint log-likelihood of the register comparison at one similarity, all broadcast together."""
    u = n_a / (n_a + n_b)
    up, down = _log_p(u - (1 - u) * jaccard), _log_p((1 - u) - u * jaccard)
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-9, 1))


GRID = np.linspace(0, 1, 51)


def estimate(above, below, equal, n_a, n_b) -> np.ndarray:
    """Likeliest similarity on a grid, for arrays of pairs."""
    above, below, equal, n_a, n_b = (np.asarray(x, float)[:, None] for x in (above, below, equal, n_a, n_b))
    top = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    ll = np.where(top * 1.0001 >= GRID, log_likelihood(above, below, equal, n_a, n_b, np.minimum(GRID, top)), -np.inf)
    return GRID[np.argmax(ll, axis=1)]


def may_reach(above, below, equal, n_a, n_b, percent: int) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose likelihood does not rule it out."""
    t = percent / 100
    out = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    if out.any():
        a, b, e, x, y = (np.asarray(v, float)[out] for v in (above, below, equal, n_a, n_b))
        best = estimate(a, b, e, x, y)
        gap = log_likelihood(a, b, e, x, y, best) - log_likelihood(a, b, e, x, y, np.minimum(t, np.minimum(x, y) / np.maximum(x, y)))
        out[out] = (best >= t) | (2 * gap <= SLACK)
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order."""
    data, offsets = B.text_bytes(column)
    for i, j in B.pieces(offsets):
        part, off = B.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = B.word_spans(part, off)
        h = B.span_hashes(part, starts, ends)
        m = max(0, len(h) - width + 1)
        grams = np.zeros(m, np.uint64)
        for k in range(width if m else 0):
            grams += h[k : k + m] * SHINGLE_MULTIPLIERS[k]
        grams = B.mix(grams)
        for d in range(j - i):
            lo, hi = first[d], first[d + 1]
            if hi - lo >= width:
                yield B.distinct(grams[lo : hi - width + 1])
            elif hi > lo:
                short = (h[lo:hi] * SHINGLE_MULTIPLIERS[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                yield B.mix(np.array([short], np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            else:
                yield np.zeros(0, np.uint64)


def _sketches(batches, width: int):
    for batch in batches:
        sizes, digests, regs = [], [], []
        for s in shingle_sets(batch.column(1), width):
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            regs.append(registers_of(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "regs"])


def _sets(batches, width: int):
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), width))
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = np.concatenate([*sets, np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), B.signed(values))], ["rep", "shingles"])


#: Two representatives and the components that they are in so far.
_PAIR = ["a", "b", "comp_a", "comp_b"]


def _likely(batches, percent: int):
    for batch in batches:
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(B.text_bytes(col(c))[0].tobytes(), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
        ok = may_reach((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), col("n_a").to_numpy(), col("n_b").to_numpy(), percent)
        yield pa.RecordBatch.from_arrays([col(c).filter(pa.array(ok)) for c in _PAIR], _PAIR)


def _block_links(key, table: pa.Table, percent: int) -> pa.Table:
    """Confirmed links, as pairs of components, that join components between the two sides of one block pair.

    A pair whose registers agree in an earlier band is left to that band's bucket.
    """
    band, same = key[1].as_py(), key[2].as_py() == key[3].as_py()
    given, side = table["comp"].to_numpy(), table["side"].to_numpy()
    comp = given.copy()
    regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    earlier = regs.view(np.uint64)[:, :band]
    lists = table["shingles"].combine_chunks()
    at = lists.offsets.to_numpy()
    size = np.diff(at)
    values, dense = np.unique(lists.values.to_numpy(), return_inverse=True)
    own, links = np.zeros(len(values), bool), []
    right = np.flatnonzero(side == (0 if same else 1))
    for i in np.flatnonzero(side == 0):
        held = right[(comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
        held = held[held > i] if same else held
        held = held[~(earlier[held] == earlier[i]).any(axis=1)]
        above, below = (regs[i] > regs[held]).sum(1), (regs[i] < regs[held]).sum(1)
        held = held[may_reach(above, below, REGISTERS - above - below, np.full(len(held), size[i]), size[held], percent)]
        if not len(held):
            continue
        mine = dense[at[i] : at[i + 1]]
        own[mine] = True
        common = np.add.reduceat(own[np.concatenate([dense[at[j] : at[j + 1]] for j in held])], np.cumsum(size[held]) - size[held], dtype=np.int64)
        own[mine] = False
        linked = held[100 * common >= percent * (size[i] + size[held] - common)]
        joined, first = np.unique(comp[linked], return_index=True)
        links += [(given[i], given[j]) for j in linked[first]]
        if len(joined):
            comp[np.isin(comp, joined)] = comp[i]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table([pa.array(a), pa.array(b)], ["comp_a", "comp_b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are the runs of non-space bytes (ASCII space, tab to carriage return)
    of the text with A-Z lowered; a document's set holds its distinct
    ``width``-word shingles, or its whole word sequence if it is shorter. Links
    join documents with 100 * intersection >= percent * union. component_id is
    the smallest id reachable; kept marks the one document of each component.

    Null or empty texts have an empty set, n_shingles 0, and stay on their own.
    Rows with a null id are dropped; of rows that repeat an id, all are returned
    and a document linked through any of them shares the component. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    base = cut(texts.mapInArrow(partial(_sketches, width=width), "doc_id long, n_shingles long, digest binary, regs binary"), "sketches")
    reps = cut(base.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("regs").alias("regs")), "classes")

    step = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.expr("regs").substr(i * step + 1, F.lit(step))))
    banded = reps.select("rep", "n", F.posexplode(bands).alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    members = cut(banded.drop("n").join(buckets, "key"), "members")

    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    chosen = texts.join(ids, "doc_id").mapInArrow(partial(_sets, width=width), "rep long, shingles array<long>")
    # Of rows that repeat an id with another text, the class of each has its own digest but shares the id.
    sets = cut(chosen, "sets")
    sketch = cut(reps.join(ids.select(F.col("doc_id").alias("rep")), "rep", "left_semi").select("rep", "n", "regs"), "candidates")

    def side(name: str) -> DataFrame:
        return sketch.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("regs").alias(f"regs_{name}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        union = F.size("sa") + F.size("sb") - F.col("common")
        return cut(both.where(100 * F.col("common") >= percent * union).select("comp_a", "comp_b"), "links")

    def likely(pairs: DataFrame) -> DataFrame:
        rows = pairs.where("a <> b").distinct().join(side("b"), "b").join(side("a"), "a")
        return rows.mapInArrow(partial(_likely, percent=percent), ", ".join(f"{c} long" for c in _PAIR))

    def relabelled(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", column), column, "left").withColumn(column, F.coalesce("root", column)).drop("root")

    def with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
        """``rows`` with the one row of their bucket, met in parts of about BLOCK members, so that no task gets a whole large bucket."""
        parts = F.ceil(F.col("members") / BLOCK)
        state = state.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("members")
        return rows.withColumn("part", F.pmod(F.xxhash64("rep"), parts)).join(state, ["key", "part"]).drop("part")

    def still_open(placed: DataFrame) -> DataFrame:
        state = placed.groupBy("key").agg(F.max("members").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return cut(with_state(placed, state), "open")

    # Each pass links the components of the one before, and its roots are looked up in turn.
    first = members.select(F.col("hub").alias("a"), F.col("rep").alias("b"), F.col("hub").alias("comp_a"), F.col("rep").alias("comp_b"))
    passes = [stars(confirmed(likely(first)), "comp_a", "comp_b")]
    # A representative's buckets (a band each, so bounded) wait in its row while its component is looked up.
    nested = members.groupBy("rep").agg(F.collect_list(F.struct("band", "key", "hub", "members", "total")).alias("buckets")).withColumn("comp", F.col("rep"))
    placed = relabelled(nested, "comp", passes[-1]).select("rep", "comp", F.inline("buckets")).where("members > 2")
    todo = still_open(placed)
    if not todo.isEmpty():
        second = todo.where("comp = hi").groupBy("key").agg(F.max("members").alias("members"), F.min("rep").alias("a"))
        pairs = with_state(todo, second).where("comp <> hi").select("a", F.col("rep").alias("b"), F.col("hi").alias("comp_a"), F.col("comp").alias("comp_b"))
        passes.append(stars(confirmed(likely(pairs)), "comp_a", "comp_b"))
        todo = still_open(relabelled(todo.drop("lo", "hi"), "comp", passes[-1]))
    if not todo.isEmpty():
        blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
        dealt = todo.join(sketch.select("rep", "regs"), "rep").join(sets, "rep").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        dealt = dealt.select("key", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "comp", "regs", "shingles")

        def within(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return _block_links(key, table, percent)

        passes.append(stars(cut(dealt.groupBy("key", "band", "p", "q").applyInArrow(within, "comp_a long, comp_b long"), "links"), "comp_a", "comp_b"))

    label = reps.select("digest", F.col("rep").alias("component_id"))
    for roots in passes:
        label = relabelled(label, "component_id", roots)
    out = base.select("doc_id", "n_shingles", "digest").join(label, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
