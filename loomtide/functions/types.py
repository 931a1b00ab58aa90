"""Attribute types, special times and their casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BEGINNING_OF_TIME = -(2**53 - 2)
END_OF_TIME = 2**53 - 2

# Attribute type names and the Spark types that hold them.
SPARK_TYPE = {
    "BOOL": "boolean", "STRING": "string", "LONG": "bigint", "INT": "int", "DOUBLE": "double",
    "DOUBLE_ARRAY": "array<double>", "LONG_ARRAY": "array<bigint>", "INT_ARRAY": "array<int>", "STRING_ARRAY": "array<string>",
    "LONG_TO_LONG_MAP": "map<bigint,bigint>", "LONG_TO_LONG_ARRAY_MAP": "map<bigint,array<bigint>>", "STRING_TO_INT_MAP": "map<string,int>",
    "INT_TO_INT_MAP": "map<int,int>", "INT_TO_STRING_MAP": "map<int,string>", "RELATION": "array<bigint>",
    "DMATRIX": "struct<rows:int,cols:int,data:array<double>>", "LMATRIX": "struct<rows:int,cols:int,data:array<bigint>>", "IMATRIX": "struct<rows:int,cols:int,data:array<int>>",
    "TASK": "string", "NODE": "struct<world:bigint,time:bigint,id:bigint>",
}


def parse_value(text: Column, type_name: str) -> Column:
    """A value written as text, as its attribute type; what cannot be read is null."""
    kind = SPARK_TYPE[type_name]
    if type_name == "BOOL":
        return F.coalesce(F.lower(F.trim(text)).isin("true", "1"), F.lit(False))
    if kind.startswith("array"):
        inner = F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), r"\s*,\s*")
        return F.transform(inner, lambda x: x.try_cast(kind[6:-1]))
    if type_name in ("INT", "LONG"):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)
