"""The data model: triples (id, key, value) and property-graph rows."""

from __future__ import annotations

from pyspark.sql import types as T

#: Keys that describe an element and not a property of it; their values are stored as they are.
TYPE, FROM, TO = "@type", "@from", "@to"
RESERVED = (TYPE, FROM, TO)
NODE, EDGE = "node", "edge"

TRIPLE = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), True)])
PG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("type", T.StringType()),
    ]
)


def is_reserved(key: str) -> bool:
    if not key:
        raise ValueError("A property needs a key")
    return key in RESERVED
