"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's target is a number of words. Its documents are dealt into blocks by ranges of a
hash; a target of r times the source's size takes every block floor(r) times, and
once more the blocks, in hash order, whose documents make up the rest, the last of them up to the document where the rest
ends, with the one further document that comes nearest to what is still missing. So every source has an
exact quota of block draws, all of which are taken. A binary tree over the output shards splits the
quotas: at each node the left half's draws are multivariate hypergeometric given the node's
quotas, so any shard's composition is that of a uniform shuffle of all draws, and
every draw goes to exactly one shard. A shard finds its quotas by walking
from the root alone, with random numbers that depend on the node only; then it draws
disjoint ranges of a pseudorandom permutation of the source's draws and shuffles
locally. Nothing is sorted or gathered globally and reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_DOCS, SHARD_DRAWS = 64, 512
#: Digits of the document hash used to find where a source's rest ends.
DIGIT_BITS, DIGITS = 12, 5
MAX_SOURCES = 100_000


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Target words of sources (source, source_size): adds place, weight, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``most`` times its source's size and the excess
    is shared again by weight until none is above. Those that stop are the first
    ones by size over weight, so one running sum over the sources finds them.
    """
    # The sources' own table is a few rows, at most MAX_SOURCES, and has no finer key.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rows = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", F.element_at(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    everything = Window.partitionBy()
    full = rows.withColumn("before_size", F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    full = full.withColumn("before_weight", F.coalesce(F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    full = full.withColumn("total", F.sum("source_size").over(everything)).withColumn("total_weight", F.sum("weight").over(everything))
    full = full.withColumn("level", (F.col("total") - most * F.col("before_size")) / (F.col("total_weight") - F.col("before_weight")))
    full = full.withColumn("capped", most * F.col("source_size") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)["level"]
    return full.withColumn("target", F.when(F.col("capped"), most * F.col("source_size")).otherwise(F.least(level * F.col("weight"), most * F.col("source_size")))).select("source", "source_size", "place", "weight", "target")


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, by a Feistel network walked until it lands inside."""
    if n <= 1:
        return x.astype(np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([key, 5]).integers(0, 1 << 62, 4, dtype=np.uint64)

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while (bad := out >= n).any():
        out[bad] = once(out[bad])
    return out.astype(np.int64)


def shard_quotas(shard: int, shards: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per source, where the shard's draws start among the source's and how many they are."""
    low, high, start, have = 0, shards, np.zeros(len(quotas), np.int64), quotas.astype(np.int64)
    total = int(have.sum())
    while high - low > 1:
        middle = (low + high) // 2
        n = int(total * middle // shards - total * low // shards)
        left = _hypergeometric(np.random.default_rng([seed, low, high]), have, n)
        if shard < middle:
            high, have = middle, left
        else:
            low, start, have = middle, start + left, have - left
    return start, have


def _hypergeometric(rng, have: np.ndarray, n: int) -> np.ndarray:
    """Draw n of the given quotas, one source's marginal after the other."""
    out = np.zeros(len(have), np.int64)
    rest = int(have.sum())
    for i, h in enumerate(have):
        h = int(h)
        if n <= 0:
            break
        rest -= h
        if h:
            out[i] = (rng.hypergeometric(h, rest, n) if rest + h < 1_000_000_000 else _wide_hypergeometric(rng, h, rest, n)) if rest else n
        n -= int(out[i])
    return out


def _wide_hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """The same draw for populations beyond the sampler's range, by inverting the distribution function.

    Probabilities are products of their exact ratios from the mode on, over 12 standard deviations a side, outside
    of which less than 1e-30 lies.
    """
    size = good + bad
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (size + 2), low), high)
    spread = 12 * int(np.sqrt(n * (good / size) * (bad / size) * ((size - n) / max(size - 1, 1)))) + 50
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    ratios = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    steps = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(steps, rng.random() * steps[-1], "right"), len(k) - 1)])


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    return rows.withColumn("h", F.xxhash64(F.lit(41), F.col("doc_id"), F.col("size")))


def _digit(h, level: int):
    """The level-th group of bits of the hash from the top, as an integer from 0."""
    return F.shiftrightunsigned(h, 64 - DIGIT_BITS * (level + 1)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("long"))


def rest_marks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per place, the hash prefix (as ``mark``, unsigned digits) below which documents make up ``rest`` words.

    A radix search: each round sums sizes by the next digit of the hash among the documents
    still in question, at most 4096 sums a source, and steps into the digit where
    the running sum passes the rest. After the last round a source's mark is exact
    to a 60-bit prefix.
    """
    state = wanted.select("place", F.col("rest").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(DIGITS):
        within = rows.join(F.broadcast(state), "place")
        if level:
            within = within.where(F.shiftrightunsigned("h", 64 - DIGIT_BITS * level) == F.col("prefix"))
        sums = within.groupBy("place", _digit(F.col("h"), level).alias("digit")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("place").orderBy("digit")
        # The digit whose words first carry the sum past what is left; 4096 rows a source at most.
        runs = sums.withColumn("upto", F.sum("words").over(run)).join(F.broadcast(state), "place")
        hit = runs.where("upto > left").groupBy("place").agg(F.min(F.struct("digit", "upto", "words")).alias("x"))
        kept = state.join(hit, "place", "left")
        step = kept.select("place", F.coalesce(F.col("left") - F.col("x.upto") + F.col("x.words"), F.lit(0.0)).alias("left"), (F.col("prefix") * (1 << DIGIT_BITS) + F.coalesce("x.digit", F.lit((1 << DIGIT_BITS) - 1))).alias("prefix"))
        state = cut(step, "marks")
    return state.select("place", F.col("prefix").alias("mark"), "left")


def last_picks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Per place the one document past the mark whose size is nearest to the words still missing, if it helps."""
    past = rows.join(F.broadcast(marks), "place").where(~_below(F.col("h"), F.col("mark")) & (F.col("left") > 0))
    miss = F.abs(F.col("size") - F.col("left"))
    best = past.where(miss < F.col("left")).groupBy("place").agg(F.min(F.struct(miss.alias("miss"), "h", "doc_id")).alias("x"))
    return marks.join(best, "place", "left").select("place", "mark", F.col("x.h").alias("pick_h"), F.col("x.doc_id").alias("pick_id"))


def _below(h, mark):
    return F.shiftrightunsigned(h, 64 - DIGIT_BITS * DIGITS) < mark


def _block(top, blocks):
    """The block of a hash by its upper 32 bits, as ranges of equal width."""
    return F.shiftright(top * blocks, 32)


def _block_of(h: str, blocks: str):
    return _block(F.shiftrightunsigned(h, 32), F.col(blocks))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, shard_draws: int = SHARD_DRAWS) -> tuple[DataFrame, DataFrame]:
    """The mix and the sizes behind it.

    The first table has a row for each time a document is taken: doc_id, place (of
    its source), copy from 0, shard, turn; reading shards in order and a shard by
    (turn, doc_id) gives the mixed stream. The second has every document: doc_id, source, size, place,
    source_size, target.

    A null text has size 0; a null source is a source of its own, ordered last; null
    ids are kept and mixed. A repeated row is a document of its own, as are rows that
    share an id. A source without words has target 0 and is not taken. Other columns are
    ignored; an empty table gives empty results. A text of any length is one document. More than ``MAX_SOURCES`` sources are
    refused, as their totals go to every task.
    """
    spark = docs.sparkSession
    rows = cut(sized(docs, id_col, text_col, source_col), "sizes")
    sums = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    if sums.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = cut(targets(sums, weights, most), "targets")
    known = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])).select("doc_id", rows["source"], "size", "h", "place", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = sources.withColumn("whole", F.floor(ratio + 1e-12).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    marks = cut(last_picks(known, rest_marks(known.select("place", "h", "size"), wanted)), "marks")

    counts = known.groupBy("place").agg(F.count("*").alias("docs"))
    plan = wanted.join(marks, "place").join(counts, "place").withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS).cast("long"))
    # The rest takes the blocks of hashes below the mark, and the block of the one further document where that lies beyond.
    plan = plan.withColumn("started", F.when(F.col("mark") > 0, _block(F.shiftright(F.col("mark") - 1, 64 - DIGIT_BITS * DIGITS + 24), F.col("blocks")) + 1).otherwise(0))
    plan = plan.withColumn("apart", F.when(F.col("pick_h").isNotNull() & (_block_of("pick_h", "blocks") >= F.col("started")), _block_of("pick_h", "blocks")))
    plan = plan.select("place", "whole", "mark", "pick_h", "pick_id", "blocks", "started", "apart", F.col("source_size").alias("words")).orderBy("place")
    held = plan.collect()  # one row a source, MAX_SOURCES at most
    places, blocks, started = (np.array([r[c] for r in held], np.int64) for c in ("place", "blocks", "started"))
    apart = np.array([-1 if r["apart"] is None else r["apart"] for r in held], np.int64)
    wholes = np.array([r["whole"] for r in held], np.int64)
    quotas = np.array([r["blocks"] * r["whole"] + r["started"] + (r["apart"] is not None) if r["words"] else 0 for r in held], np.int64)
    shards = max(1, -(-int(quotas.sum()) // shard_draws))

    def draw(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                start, n = shard_quotas(shard, shards, quotas, seed)
                out = []
                for s in np.flatnonzero(n):
                    at = permuted(np.arange(start[s], start[s] + n[s]), int(quotas[s]), seed + int(places[s]))
                    copy, block = np.minimum(at // blocks[s], wholes[s]), at % blocks[s]
                    rest = at - wholes[s] * blocks[s]
                    block = np.where(rest < 0, block, np.where(rest < started[s], rest, apart[s]))
                    out.append(np.stack([np.full(len(at), places[s]), block, copy, np.full(len(at), shard)]))
                cols = np.concatenate([*out, np.zeros((4, 0), np.int64)], axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["place", "block", "copy", "shard"])

    draws = spark.range(0, shards, 1, max(1, min(shards, 2 * spark.sparkContext.defaultParallelism))).mapInArrow(draw, "place long, block long, copy long, shard long")
    small = plan.select("place", "whole", "mark", "pick_h", "pick_id", "blocks")
    dealt = known.join(F.broadcast(small), "place").withColumn("block", _block_of("h", "blocks"))
    picked = F.col("pick_h").isNotNull() & (F.col("h") == F.col("pick_h")) & F.col("doc_id").eqNullSafe(F.col("pick_id"))
    taken = dealt.join(draws, ["place", "block"]).where((F.col("copy") < F.col("whole")) | _below(F.col("h"), F.col("mark")) | picked)
    turn = F.xxhash64(F.lit(seed), "shard", "h", "copy")
    return taken.select("doc_id", "place", "copy", "shard", turn.alias("turn"), "h"), known


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (its size times the times it is taken)."""
    stream, known = mix(docs, **options)
    times = stream.groupBy("place", "doc_id", "h").agg(F.count("*").alias("times"))
    # Rows alike in id, size and source are drawn alike, so each has its share of their draws.
    alike = known.groupBy("place", "doc_id", "h").agg(F.count("*").alias("alike"))
    out = known.join(times.join(alike, times["place"].eqNullSafe(alike["place"]) & times["doc_id"].eqNullSafe(alike["doc_id"]) & (times["h"] == alike["h"])).select(times["place"], times["doc_id"], times["h"], (F.col("times") / F.col("alike")).cast("long").alias("times")).withColumnsRenamed({"place": "p", "doc_id": "i", "h": "x"}), (F.col("place") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("x")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
