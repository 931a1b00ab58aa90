"""Index definitions and entries: global, timed and local to an owner."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

ENTRY = "index string, owner long, id long, key array<string>, time long, live boolean"


@dataclass(frozen=True)
class Indexes:
    """definitions: name, kind (global, timed or local), attributes. entries: index, owner, id, key, time, live.

    Entries are only ever added; which one counts is decided when they are read: the last of each node. A timed index is read
    at a time, the others as they stand now.
    """

    definitions: DataFrame
    entries: DataFrame

    @staticmethod
    def empty(spark) -> Indexes:
        return Indexes(spark.createDataFrame([], "name string, kind string, attributes array<string>"), spark.createDataFrame([], ENTRY))

    def declare(self, name: str, *attributes: str, kind: str = "global") -> Indexes:
        """An index over some attributes. Declaring it again keeps the first definition."""
        if kind not in ("global", "timed", "local"):
            raise ValueError(f"there is no index kind {kind}")
        if not attributes:
            raise ValueError("an index needs an attribute")
        row = self.definitions.sparkSession.createDataFrame([(name, kind, list(attributes))], self.definitions.schema)
        return replace(self, definitions=self.definitions.union(row.join(self.definitions.select("name"), "name", "left_anti").select(*self.definitions.columns)))

    def names(self) -> DataFrame:
        return self.definitions.select("name")

    def _definition(self, name: str):
        row = self.definitions.where(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"there is no index {name}")
        return row

    def update(self, name: str, states: DataFrame) -> Indexes:
        """Put nodes (id, the attributes, and where there are such columns time and owner) under the key they have now."""
        d = self._definition(name)
        return self._add(name, states, F.array(*(F.col(a).cast("string") for a in d["attributes"])), True)

    def unindex(self, name: str, nodes: DataFrame) -> Indexes:
        """Take nodes out of the index."""
        d = self._definition(name)
        return self._add(name, nodes, F.array(*(F.lit(None).cast("string") for _ in d["attributes"])), False)

    def _add(self, name: str, rows: DataFrame, key, live: bool) -> Indexes:
        owner = F.col("owner").cast("long") if "owner" in rows.columns else F.lit(None).cast("long")
        time = F.col("time").cast("long") if "time" in rows.columns else F.lit(0).cast("long")
        added = rows.select(F.lit(name).alias("index"), owner.alias("owner"), F.col("id").cast("long").alias("id"), key.alias("key"), time.alias("time"), F.lit(live).alias("live"))
        # Of two entries at one time the later call counts.
        turn = self.entries.withColumn("turn", F.lit(0)) if "turn" not in self.entries.columns else self.entries.withColumn("turn", F.col("turn") - 1)
        return replace(self, entries=turn.unionByName(added.withColumn("turn", F.lit(0))))

    def read(self, name: str, *values, time: int | None = None) -> DataFrame:
        """(owner, id) of the nodes whose key begins with ``values`` (all without values), a null meaning an absent attribute.

        An index that was not declared has no entries; more values than attributes are an error. ``time`` counts
        for a timed index only.
        """
        d = self.definitions.where(F.col("name") == name).first()
        if d is None:
            return self.entries.limit(0).select("owner", "id")
        if len(values) > len(d["attributes"]):
            raise ValueError(f"{name} has {len(d['attributes'])} attributes")
        rows = self.entries.where(F.col("index") == name)
        if d["kind"] == "timed" and time is not None:
            rows = rows.where(F.col("time") <= time)
        order = F.struct("time", *(["turn"] if "turn" in rows.columns else []))
        last = rows.groupBy("owner", "id").agg(F.max_by(F.struct("key", "live"), order).alias("s")).where("s.live")
        for i, v in enumerate(values):
            last = last.where(F.col("s.key")[i].eqNullSafe(F.lit(None if v is None else str(v)).cast("string")))
        return last.select("owner", "id")
