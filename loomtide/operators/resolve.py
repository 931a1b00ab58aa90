"""Reading the graph at a time and in a world: as-of lookups and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DAY = 86_400_000_000
#: Worlds are broadcast as (world, ancestor, depth) rows up to this many.
MAX_ANCESTRY = 1_000_000


def _state(versions: DataFrame) -> list[str]:
    return [c for c in versions.columns if c not in ("id", "world", "time")]


def as_of_single(versions: DataFrame, time: int) -> DataFrame:
    """Each node's last state at or before one time: a filter and one aggregation."""
    kept = versions.where(F.col("time") <= time)
    best = kept.groupBy("id").agg(F.max_by(F.struct("time", *_state(versions)), "time").alias("s"))
    return best.select("id", F.col("s.time").alias("res_time"), *(F.col(f"s.{c}").alias(c) for c in _state(versions)))


def as_of_rows(requests: DataFrame, versions: DataFrame, keys: tuple[str, ...] = ("id",), width: int = DAY) -> DataFrame:
    """Each request's last state at or before its own time; requests without one are left out.

    Requests and versions are sorted together within (keys, time bucket), so one node's long
    history is many tasks. What a bucket starts with is carried in by a running value
    over the buckets' last states, at most one row a node and bucket.
    """
    state = [c for c in versions.columns if c not in (*keys, "time", "world")]
    bucket = F.floor(F.col("time") / width).cast("long").alias("bucket")
    v = versions.select(*keys, "time", bucket, F.struct(F.col("time").alias("res_time"), *state).alias("s"))
    r = requests.select(*keys, "time", bucket, F.struct(*(c for c in requests.columns if c not in (*keys, "time"))).alias("r")) if len(requests.columns) > len(keys) + 1 else requests.select(*keys, "time", bucket, F.struct(F.lit(0).alias("_")).alias("r"))
    last = v.groupBy(*keys, "bucket").agg(F.max_by("s", "time").alias("s"))
    asked = r.select(*keys, "bucket").distinct()
    marks = last.select(*keys, "bucket", "s", F.lit(False).alias("ask")).union(asked.select(*keys, "bucket", F.lit(None).cast(last.schema["s"].dataType), F.lit(True)))
    # At equal buckets the request's mark comes first, so it sees earlier buckets alone.
    over = Window.partitionBy(*keys).orderBy("bucket", F.when(F.col("ask"), 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = marks.withColumn("c", F.last("s", ignorenulls=True).over(over)).where("ask").select(*keys, "bucket", "c")
    null_r = F.lit(None).cast(r.schema["r"].dataType)
    null_s = F.lit(None).cast(v.schema["s"].dataType)
    rows = v.select(*keys, "bucket", "time", F.lit(0).alias("kind"), "s", null_r.alias("r")).union(r.select(*keys, "bucket", "time", F.lit(1), null_s, "r"))
    within = Window.partitionBy(*keys, "bucket").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("own", F.last("s", ignorenulls=True).over(within)).where("kind = 1")
    out = found.join(carried, [*keys, "bucket"], "left").withColumn("f", F.coalesce("own", "c")).where("f is not null")
    extra = [c for c in requests.columns if c not in (*keys, "time")]
    return out.select(*keys, "time", *(F.col(f"r.{c}").alias(c) for c in extra), F.col("f.res_time").alias("res_time"), *(F.col(f"f.{c}").alias(c) for c in state))


def ancestry(worlds: DataFrame, rounds: int = 64) -> DataFrame:
    """(world, ancestor, depth): every world with itself and all worlds it was forked from."""
    known = worlds.select("world", F.col("world").alias("ancestor"), F.lit(0).alias("depth"))
    step = worlds.where("parent is not null").select("world", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    parents = worlds.where("parent is not null").select(F.col("world").alias("ancestor"), "parent")
    for _ in range(rounds):
        if step.isEmpty():
            return known
        known = known.union(step)
        step = step.join(parents, "ancestor").select("world", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
    raise ValueError(f"worlds are forked deeper than {rounds}")


def small(df: DataFrame, most: int = MAX_ANCESTRY) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def as_of_worlds(requests: DataFrame, versions: DataFrame, worlds: DataFrame) -> DataFrame:
    """As-of reads of (id, world, time) requests with fall-through to parent worlds.

    A node is read in the nearest ancestor in which it had diverged by the requested
    time; the request keeps its own world and time, and res_world, res_time say what was read.
    """
    diverged = versions.groupBy("id", F.col("world").alias("ancestor")).agg(F.min("time").alias("since"))
    ask = requests.withColumn("_key", F.struct("id", "world", "time"))
    near = ask.select("_key", "id", "world", "time").distinct().join(small(ancestry(worlds)), "world").join(diverged, ["id", "ancestor"]).where("since <= time")
    placed = near.groupBy("_key").agg(F.min_by("ancestor", "depth").alias("res_world"))
    full = ask.join(placed, "_key").drop("_key")
    renamed = versions.withColumnRenamed("world", "res_world")
    return as_of_rows(full, renamed, ("id", "res_world"))


def visible(versions: DataFrame, worlds: DataFrame, world: int) -> DataFrame:
    """The versions that one world sees: its own, and its ancestors' from before each nearer world diverged."""
    line = small(ancestry(worlds).where(F.col("world") == world).select(F.col("ancestor").alias("world"), "depth"))
    own = versions.join(line, "world")
    since = own.groupBy("id", "depth").agg(F.min("time").alias("since"))
    # A node has a row for each world it was written in, at most the depth of the fork.
    nearer = Window.partitionBy("id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    until = since.withColumn("until", F.min("since").over(nearer)).select("id", "depth", "until")
    return own.join(until, ["id", "depth"]).where("until is null or time < until").drop("depth", "until")


def timepoints(versions: DataFrame, begin: int, end: int) -> DataFrame:
    """(id, time) of the states from ``begin`` to before ``end``."""
    return versions.where((F.col("time") >= begin) & (F.col("time") < end)).select("id", "time").distinct()


def count_timepoints(versions: DataFrame, begin: int, end: int) -> DataFrame:
    """Exact number of timepoints a node."""
    return timepoints(versions, begin, end).groupBy("id").agg(F.count("*").alias("n"))


def timeline(versions: DataFrame, start: int, stop: int, limit: int = -1) -> DataFrame:
    """Versions between two times, both inclusive, ascending or (start > stop) descending, with pos from 0.

    A limit keeps each node's first ``limit`` in that direction.
    """
    low, high = min(start, stop), max(start, stop)
    order = F.col("time").asc() if start <= stop else F.col("time").desc()
    out = versions.where(F.col("time").between(low, high)).withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy(order)) - 1)
    return out if limit < 0 else out.where(F.col("pos") < limit)


def timeline_sparse(versions: DataFrame, start: int, stop: int, limit: int) -> DataFrame:
    """At most ``limit`` versions a node, evenly skipped from the latest backwards."""
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    low, high = min(start, stop), max(start, stop)
    kept = versions.where(F.col("time").between(low, high))
    counts = kept.groupBy("id").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("id").orderBy(F.desc("time"))
    ranked = kept.join(counts, "id").withColumn("_r", F.row_number().over(w) - 1)
    step = F.floor(F.col("_n") / limit) + 1
    out = ranked.where((F.col("_r") % step == 0) & (F.floor(F.col("_r") / step) < limit))
    return out.withColumn("pos", F.floor(F.col("_r") / step).cast("int")).drop("_n", "_r")


def dephasing(versions: DataFrame, time: int) -> DataFrame:
    """How long before ``time`` each node's state there was written."""
    return versions.where(F.col("time") <= time).groupBy("id").agg(F.max("time").alias("res_time")).withColumn("dephasing", F.lit(time) - F.col("res_time"))
