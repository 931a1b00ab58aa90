"""The temporal, many-world graph as an immutable bundle of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import mutate, resolve

TABLES = ("versions", "worlds", "edges", "ends")


@dataclass(frozen=True)
class TemporalGraph:
    """versions: id, world, time and one column for each attribute; edges: src, rel, pos, dst.

    worlds: world, parent. ends: id, world, end_time of closed timelines. A write
    gives a new graph; nothing runs until a result is read.
    """

    versions: DataFrame
    worlds: DataFrame
    edges: DataFrame | None = None
    ends: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.versions.sparkSession

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.versions.columns if c not in ("id", "world", "time")]

    @staticmethod
    def of(versions: DataFrame, edges: DataFrame | None = None) -> TemporalGraph:
        """A graph of one world, 0."""
        worlds = versions.sparkSession.createDataFrame([(0, None)], "world long, parent long")
        own = versions if "world" in versions.columns else versions.withColumn("world", F.lit(0).cast("long"))
        return TemporalGraph(own, worlds, edges)

    def fork(self, world: int, parent: int = 0) -> TemporalGraph:
        """A child world; it reads through to its parent wherever it was not written."""
        return replace(self, worlds=self.worlds.union(self.spark.createDataFrame([(world, parent)], "world long, parent long")))

    def write(self, rows: DataFrame) -> TemporalGraph:
        """Whole states (id, world, time, attributes); of one place the last written counts."""
        keys = ["id", "world", "time"]
        kept = self.versions.join(rows.select(*keys).distinct(), keys, "left_anti")
        return replace(self, versions=kept.unionByName(rows, allowMissingColumns=True))

    def set_attribute(self, name: str, values: DataFrame, force: bool = False) -> TemporalGraph:
        """Set one attribute at (id, world, time, value), the writes of a node being applied in the order of their times.

        Each write carries the state before it on, be that an older version or another write of the batch, and
        lasts until the next version. Without ``force`` a write that changes nothing makes no version. Of writes at one
        time the one of the last ``seq`` counts, where there is such a column, else the greatest value.
        """
        kind = dict(self.versions.dtypes)[name]
        turn = [F.col("seq")] if "seq" in values.columns else []
        new = values.groupBy("id", "world", "time").agg(F.max_by(F.col("value").cast(kind), F.struct(*turn, F.col("value").cast("string"))).alias("_new"))
        rest = [a for a in self.attributes if a != name]
        # The state each write finds, read from the old versions alone; writes before it in the same stretch are folded in below.
        found = self.lookup(new.select("id", "world", "time"))
        before = found.select("id", "world", "time", F.struct("res_world", "res_time").alias("_stretch"), F.col(name).alias("_old"), *(F.col(a).alias(a) for a in rest))
        here = new.join(before, ["id", "world", "time"], "left")
        # Between two old versions only the batch's own writes change the attribute, so the one before decides.
        by_time = Window.partitionBy("id", "world", "_stretch").orderBy("time")
        told = here.withColumn("_first", F.row_number().over(by_time) == 1).withColumn("_before", F.lag("_new").over(by_time))
        changed = F.when(F.col("_first"), F.col("_stretch").isNull() | ~F.col("_old").eqNullSafe(F.col("_new"))).otherwise(~F.col("_before").eqNullSafe(F.col("_new")))
        if not force:
            told = told.where(changed)
        return self.write(told.withColumn(name, F.col("_new")).select(*self.versions.columns))

    def remove_attribute(self, name: str, at: DataFrame) -> TemporalGraph:
        return self.set_attribute(name, at.withColumn("value", F.lit(None)))

    def clone(self, at: DataFrame, offset: int) -> TemporalGraph:
        """New nodes, their ids raised by ``offset``, with the state of (id, world, time)."""
        return self.write(mutate.clone_nodes(self.lookup(at).drop("res_world", "res_time"), offset))

    def end(self, at: DataFrame) -> TemporalGraph:
        """Close timelines at (id, world, end_time): the node is read up to that time and not after it."""
        return replace(self, ends=at if self.ends is None else self.ends.unionByName(at))

    def drop_nodes(self, ids: DataFrame) -> TemporalGraph:
        """Nodes with all their versions, and the edges from and to them."""
        edges = self.edges
        if edges is not None:
            for side in ("src", "dst"):
                edges = mutate.drop_nodes(edges.withColumnRenamed(side, "id"), ids).withColumnRenamed("id", side)
            edges = edges.select(*self.edges.columns)
        return replace(self, versions=mutate.drop_nodes(self.versions, ids), edges=edges)

    def _closing(self) -> DataFrame:
        return self.ends.groupBy("id", F.col("world").alias("res_world")).agg(F.min("end_time").alias("end_time"))

    def lookup(self, requests: DataFrame) -> DataFrame:
        """The state of each (id, world, time), with res_world and res_time; misses are left out."""
        found = resolve.as_of_worlds(requests, self.versions, self.worlds)
        if self.ends is None:
            return found
        return found.join(self._closing(), ["id", "res_world"], "left").where("end_time is null or time <= end_time").drop("end_time")

    def lookup_all(self, requests: DataFrame) -> DataFrame:
        """Every request (pos, id, world, time) in its place, with nulls where nothing is found."""
        found = self.lookup(requests.select("id", "world", "time").distinct())
        return requests.join(found, ["id", "world", "time"], "left").select(*requests.columns, "res_world", "res_time", *self.attributes)

    def lookup_times(self, ids: DataFrame, world: int, start: int, stop: int, limit: int = -1) -> DataFrame:
        """The versions of some nodes between two times of a world, as ``resolve.timeline`` orders them."""
        seen = self._visible(world).join(ids.select("id").distinct(), "id", "left_semi")
        return resolve.timeline(seen, start, stop, limit)

    def _visible(self, world: int) -> DataFrame:
        seen = resolve.visible(self.versions, self.worlds, world)
        if self.ends is None:
            return seen
        closing = self._closing().withColumnRenamed("res_world", "world")
        return seen.join(closing, ["id", "world"], "left").where("end_time is null or time <= end_time").drop("end_time")

    def at(self, time: int, world: int = 0) -> DataFrame:
        """Every node's state at one time of one world; nodes whose timeline has ended before are left out."""
        seen = resolve.visible(self.versions, self.worlds, world)
        if self.ends is not None:
            closing = self._closing().withColumnRenamed("res_world", "world")
            seen = seen.join(closing, ["id", "world"], "left")
            best = resolve.as_of_single(seen, time)
            seen = best.where(F.col("end_time").isNull() | (F.lit(time) <= F.col("end_time"))).drop("end_time")
            return seen.withColumn("world", F.lit(world).cast("long"))
        return resolve.as_of_single(seen, time).withColumn("world", F.lit(world).cast("long"))

    def timepoints(self, world: int, begin: int, end: int) -> DataFrame:
        """(id, time) of the states of a world from ``begin`` to before ``end``, up to where timelines end."""
        return resolve.timepoints(self._visible(world), begin, end)

    def described(self, states: DataFrame) -> DataFrame:
        """States as JSON text: world, time and id, then the attributes that are not null."""
        shown = [c for c in ("world", "time", "id", *self.attributes) if c in states.columns]
        return states.select("id", F.to_json(F.struct(*shown)).alias("text"))

    def what_if(self, branches: int, change: Callable[[TemporalGraph, int], TemporalGraph], judge: Callable[[TemporalGraph, int], DataFrame], parent: int = 0, first_world: int | None = None) -> DataFrame:
        """Fork ``branches`` worlds, change each, and rank them: world, score, rank, the best score first.

        ``judge`` gives a one-row DataFrame with the column score for a changed graph and its world. Nothing of the
        parent changes; the branches are plans of one query, so Spark runs them side by side.
        """
        first = 1 + self.worlds.agg(F.max("world")).first()[0] if first_world is None else first_world
        scores = None
        for world in range(first, first + branches):
            one = judge(change(self.fork(world, parent), world), world).select(F.lit(world).cast("long").alias("world"), F.col("score").cast("double").alias("score"))
            scores = one if scores is None else scores.union(one)
        if scores is None:
            return self.spark.createDataFrame([], "world long, score double, rank int")
        return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "world")))

    def save(self, path: str) -> None:
        """One Parquet table each; versions sorted by node and time within their files."""
        self.versions.repartition("id").sortWithinPartitions("id", "world", "time").write.mode("overwrite").parquet(f"{path}/versions")
        for name in TABLES[1:]:
            if (df := getattr(self, name)) is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TemporalGraph:
        held = {}
        for name in TABLES:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                held[name] = spark.read.parquet(f"{path}/{name}")
        return TemporalGraph(**held)
