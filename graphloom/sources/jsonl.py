"""Property-graph JSON lines, written and read."""

from __future__ import annotations

import io
import shutil
from collections.abc import Mapping
from pathlib import Path
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.codec import JSON, Codec, elements, json_text
from graphloom.model import EDGE
from graphloom.sources.storage import load


def _text(c: Column | str) -> Column:
    """JSON text of a string, null for null; the empty string stays one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "", F.lit('""')).otherwise(json_text(c, T.StringType()))


def lines(pg: DataFrame, codecs: Mapping[str, Codec] | None = None, codec: Codec = JSON) -> DataFrame:
    """(line): one JSON object per element. Property values are JSON text already and are put in as they are."""
    null = F.lit("null")

    def decoded(key: Column, values: Column) -> Column:
        out = F.transform(values, codec.decode)
        for k, own in (codecs or {}).items():
            out = F.when(key == k, F.transform(values, own.decode)).otherwise(out)
        return F.concat(F.lit("["), F.array_join(F.transform(out, lambda v: F.coalesce(v, null)), ","), F.lit("]"))

    entries = F.transform(F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))), lambda e: F.concat(_text(e["key"]), F.lit(":"), decoded(e["key"], e["value"])))
    properties = F.coalesce(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")), F.lit("{}"))
    labels = F.coalesce(F.concat(F.lit("["), F.array_join(F.transform("labels", _text), ","), F.lit("]")), null)
    has = [c if c in pg.columns else None for c in ("from", "to")]
    end = lambda c: F.coalesce(_text(c), null) if c else null
    ends = F.when(F.col("type") == EDGE, F.concat(F.lit(',"from":'), end(has[0]), F.lit(',"to":'), end(has[1]))).otherwise(F.lit(""))
    return pg.select(F.concat(F.lit('{"type":'), _text("type"), F.lit(',"id":'), _text("id"), F.lit(',"labels":'), labels, F.lit(',"properties":'), properties, ends, F.lit("}")).alias("line"))


def write(pg: DataFrame | str, path: str, spark: SparkSession | None = None, codecs: Mapping[str, Codec] | None = None, codec: Codec = JSON) -> None:
    """A folder of text files, written by the executors."""
    lines(load(pg, spark), codecs, codec).write.mode("overwrite").text(path)


def export(pg: DataFrame | str, out: str | Path | TextIO | None = None, spark: SparkSession | None = None, codecs: Mapping[str, Codec] | None = None, codec: Codec = JSON) -> str | None:
    """One file, an open file, or the text itself if there is neither. Partitions pass through the driver one by one; the
    text itself is held there, so it is for small graphs."""
    rows = lines(load(pg, spark), codecs, codec).toLocalIterator()
    if out is None:
        held = io.StringIO()
        held.writelines(f"{r.line}\n" for r in rows)
        return held.getvalue()
    if isinstance(out, (str, Path)):
        part = Path(f"{out}.part")
        with part.open("w", encoding="utf-8") as f:
            f.writelines(f"{r.line}\n" for r in rows)
        shutil.move(part, out)
    else:
        out.writelines(f"{r.line}\n" for r in rows)
    return None


_LINE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """Property-graph rows from lines; property values stay JSON text. A line that is no JSON fails the job."""
    e = texts.where(F.trim(column) != "").select(F.from_json(column, _LINE, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    return e.select("id", "labels", "from", "to", F.transform_values("properties", lambda _, v: elements(v)).alias("properties"), "type")


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The elements of a file or folder, of one type if given."""
    found = parse(spark.read.text(path))
    return found if kind is None else found.where(F.col("type") == kind)
