"""Selecting, indexing and traversing nodes; pipeline steps over results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import cut_lineage


def with_regex(nodes: DataFrame, attribute: str, pattern: str) -> DataFrame:
    """Nodes whose attribute, as text, matches the pattern as a whole."""
    return nodes.where(F.col(attribute).cast("string").rlike(rf"\A(?:{pattern})\z"))


def without_regex(nodes: DataFrame, attribute: str, pattern: str) -> DataFrame:
    """The complement; a null attribute is kept."""
    return nodes.where(F.col(attribute).isNull() | ~F.col(attribute).cast("string").rlike(rf"\A(?:{pattern})\z"))


def attribute_names(nodes: DataFrame, type_name: str | None = None) -> DataFrame:
    """(id, attribute) of the non-null attributes, of one Spark type if given."""
    names = [n for n, t in nodes.dtypes if n not in ("id", "world", "time") and (type_name is None or t == type_name)]
    held = F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in names)) if names else F.array().cast("array<string>")
    return nodes.select("id", F.explode(F.filter(held, lambda x: x.isNotNull())).alias("attribute"))


def read_index(entries: DataFrame, states: DataFrame, **key) -> DataFrame:
    """Nodes of an index by an exact key, checked again on the states read; without a key all of them."""
    hits = entries
    for name, value in key.items():
        hits = hits.where(F.col(name).eqNullSafe(F.lit(value)))
    found = states.join(hits.select("id").distinct(), "id", "left_semi")
    for name, value in key.items():
        found = found.where(F.col(name).cast("string").eqNullSafe(F.lit(None if value is None else str(value))))
    return found


def update_index(entries: DataFrame, order: str) -> DataFrame:
    """One entry a node: the key it was last indexed by."""
    keys = [c for c in entries.columns if c != "id"]
    return entries.groupBy("id").agg(F.max_by(F.struct(*keys), order).alias("k")).select("id", *(F.col(f"k.{c}").alias(c) for c in keys))


def traverse(nodes: DataFrame, edges: DataFrame, rel: str, targets: DataFrame | None = None) -> DataFrame:
    """(src, pos, id) of the nodes a relation leads to, in order, repeats kept; those without a state drop out."""
    out = nodes.select(F.col("id").alias("src")).join(edges.where(F.col("rel") == rel).select("src", "pos", F.col("dst").alias("id")), "src")
    return out if targets is None else out.join(targets, "id")


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(src, dst, hops): everything reachable and the fewest hops to it, one join a round.

    Each round's pairs are written once and read from there. Both sides of a join are shuffled: broadcasts would
    send the driver a part of the table in every round.
    """
    step = cut_lineage(edges.select("src", "dst").distinct())
    onward = step.select(F.col("src").alias("dst"), F.col("dst").alias("next")).hint("merge")
    known = step.withColumn("hops", F.lit(1))
    front, hops = step, 1
    while not front.isEmpty():
        hops += 1
        if hops > rounds:
            raise ValueError(f"paths are longer than {rounds}")
        found = front.join(onward, "dst").select("src", F.col("next").alias("dst")).distinct()
        front = cut_lineage(found.join(known.select("src", "dst").hint("merge"), ["src", "dst"], "left_anti"))
        known = known.union(front.withColumn("hops", F.lit(hops)))
    return known


def derived(nodes: DataFrame, name: str, expression: Column) -> DataFrame:
    """An attribute computed from others when it is read."""
    return nodes.withColumn(name, expression)


def pipe(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every step on the same input, their results under a branch number; drop it to flatten."""
    parts = [step(df).withColumn("branch", F.lit(i)) for i, step in enumerate(steps)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numbered(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Rows with ``i``, their place from 0 within ``by``."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def loop(df: DataFrame, start: int, stop: int) -> DataFrame:
    """A row for each i from ``start`` to ``stop``, both inclusive; an empty range gives none."""
    if stop < start:
        return df.withColumn("i", F.lit(start)).limit(0)
    return df.withColumn("i", F.explode(F.sequence(F.lit(start), F.lit(stop))))


def while_do(df: DataFrame, condition: Callable[[DataFrame], bool], step: Callable[[DataFrame], DataFrame], every: int = 2) -> DataFrame:
    """Repeat a step while a condition over the data holds.

    Lineage is cut every few rounds: expressions that use a column twice would else double each round.
    """
    n = 0
    while condition(df):
        df, n = step(df), n + 1
        if n % every == 0:
            df = cut_lineage(df)
    return df
