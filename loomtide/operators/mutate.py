"""Writes: change detection, time sensitivity, ending, dropping, cloning, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Ids that one task numbers within a relation.
RANGE = 1 << 20

def change_detect(writes: DataFrame, attribute: str) -> DataFrame:
    """The writes that change the attribute against the one before; equal ones make no version."""
    before = F.lag(attribute).over(Window.partitionBy("id").orderBy("time"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("time")) == 1
    return writes.withColumn("_c", first | ~F.col(attribute).eqNullSafe(before)).where("_c").drop("_c")


def time_sensitivity(writes: DataFrame, delta: int, offset: int = 0) -> DataFrame:
    """Writes moved to the start of their slot of ``delta``; the last of a slot is its state.

    delta 0 leaves times alone; below 0 all writes of a node fall on its first one.
    """
    state = [c for c in writes.columns if c not in ("id", "time")]
    if delta == 0:
        return writes
    if delta < 0:
        slots = writes.groupBy("id").agg(F.min("time").alias("slot"), F.max_by(F.struct("time", *state), "time").alias("s"))
    else:
        slot = (F.col("time") - F.col("time") % delta + offset).alias("slot")
        slots = writes.groupBy("id", slot).agg(F.max_by(F.struct("time", *state), "time").alias("s"))
    return slots.select("id", F.col("slot").alias("time"), *(F.col(f"s.{c}").alias(c) for c in state))


def end_timelines(states: DataFrame, ends: DataFrame) -> DataFrame:
    """States read at ``time`` whose timeline has not ended before."""
    return states.join(ends, "id", "left").where("end_time is null or time <= end_time").drop("end_time")


def drop_nodes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def clone_nodes(states: DataFrame, offset: int) -> DataFrame:
    return states.withColumn("id", F.col("id") + offset)


def add_to_relation(sources: DataFrame, added: DataFrame, rel: str) -> DataFrame:
    """Added nodes (src, id) after their source's own: (src, rel, pos, dst); sources (id, size) carry their relation's size.

    Nodes of one source are numbered in order of their ids, in two steps: within ranges of ids, and by the
    counts of the ranges before, so a source that a third of the nodes go to is many tasks.
    """
    spread = added.select("src", F.col("id").alias("dst")).withColumn("_r", F.floor(F.col("dst") / RANGE))
    ends = spread.groupBy("src", "_r").agg(F.count("*").alias("_n"))
    # A row a source and range of ids.
    before = ends.withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy("src").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = spread.withColumn("_p", F.row_number().over(Window.partitionBy("src", "_r").orderBy("dst")) - 1).join(before.drop("_n"), ["src", "_r"])
    out = placed.join(sources.select(F.col("id").alias("src"), "size"), "src")
    return out.select("src", F.lit(rel).alias("rel"), (F.col("size") + F.col("_b") + F.col("_p")).cast("long").alias("pos"), "dst")


def remove_from_relation(edges: DataFrame, removed: DataFrame, rel: str) -> DataFrame:
    """``edges`` without the first occurrence, in order, of each pair (src, dst) in ``removed``; later ones move up."""
    gone = removed.select("src", "dst").groupBy("src", "dst").agg(F.count("*").alias("_gone"))
    mine = edges.where(F.col("rel") == rel)
    turn = F.row_number().over(Window.partitionBy("src", "dst").orderBy("pos"))
    left = mine.withColumn("_t", turn).join(gone, ["src", "dst"], "left").where("_gone is null or _t > _gone").drop("_t", "_gone")
    pos = (F.row_number().over(Window.partitionBy("src").orderBy("pos")) - 1).cast("long")
    return edges.where(F.col("rel") != rel).unionByName(left.withColumn("pos", pos).select(*edges.columns))


def traverse_or_keep(nodes: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    """(src, pos, id): the nodes a relation leads to, and each node without that relation itself."""
    out = edges.where(F.col("rel") == rel).select("src", "pos", F.col("dst").alias("id"))
    asked = nodes.select(F.col("id").alias("src"))
    return asked.join(out, "src", "left").select("src", F.coalesce("pos", F.lit(0).cast("long")).alias("pos"), F.coalesce("id", "src").alias("id"))


def opposite(edges: DataFrame, name: str) -> DataFrame:
    """The other direction of a relation, in order of the sources."""
    pos = F.row_number().over(Window.partitionBy("dst").orderBy("src", "pos")) - 1
    return edges.select(F.col("dst").alias("src"), F.lit(name).alias("rel"), pos.cast("long").alias("pos"), F.col("src").alias("dst"))
