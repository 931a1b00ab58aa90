"""Graph tables from tabular data, text lines and JSON updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def micros(column: str):
    """A timestamp without zone as microseconds since the epoch, read as UTC (the session's zone)."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def versions(rows: DataFrame, node: str, time, attributes: dict[str, str], world: int = 0) -> DataFrame:
    """One version a row: id, world, time and the named attributes."""
    return rows.select(F.col(node).cast("long").alias("id"), F.lit(world).cast("long").alias("world"), time.alias("time"), *(F.col(c).alias(a) for a, c in attributes.items()))


def foreign_key_edges(rows: DataFrame, source: str, target: str, rel: str, order: list[str]) -> DataFrame:
    """A relation from a foreign key: (src, rel, pos, dst), numbered by ``order`` within a source."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy(source).orderBy(*order)) - 1
    return rows.select(F.col(source).cast("long").alias("src"), F.lit(rel).alias("rel"), pos.cast("long").alias("pos"), F.col(target).cast("long").alias("dst"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of text files."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths, sizes and times of the files under a folder, hidden ones left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("."))


def split_lines(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """(…, pos, part): the parts of each text; empty ones at its end fall away."""
    parts = F.split(F.col(column), pattern)
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)))
    return df.select("*", F.posexplode(F.slice(parts, F.lit(1), last)).alias("pos", "part"))


def parse_updates(messages: DataFrame, column: str = "value") -> DataFrame:
    """(id, time, attribute, value, type) of JSON updates; an update without id, time or values gives none."""
    schema = "id string, time bigint, values map<string, struct<value: string, type: string>>"
    m = messages.select(F.from_json(column, schema).alias("m")).where("m.id is not null and m.time is not null and m.values is not null")
    return m.select(F.col("m.id").alias("id"), F.col("m.time").alias("time"), F.explode("m.values").alias("attribute", "v")).select("id", "time", "attribute", F.col("v.value").alias("value"), F.col("v.type").alias("type"))
