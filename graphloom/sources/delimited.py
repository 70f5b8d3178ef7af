"""Delimited files with a header to tables and triples."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.mapping import ElementMapping, Fused, fuse
from graphloom.sources.storage import save

#: The reader's options unless others are given.
DEFAULTS = {"header": True, "delimiter": "\t", "inferSchema": True, "comment": "#"}


def cast_columns(df: DataFrame, kinds: Mapping[str, str | T.DataType], lenient: bool = False) -> DataFrame:
    """df with the columns that kinds names cast; unknown names are passed over. Bad text fails, or is null if lenient."""
    cast = lambda c, t: F.col(c).try_cast(t) if lenient else F.col(c).cast(t)
    known = {c: cast(f"`{c}`", t) for c, t in kinds.items() if c in df.columns}
    return df.withColumns(known) if known else df


def _true(x) -> bool:
    return x is True or str(x).lower() == "true"


@dataclass(frozen=True)
class DelimitedSource:
    """How a file is read. ``kinds`` are column types; they hold where types are not inferred."""

    options: Mapping[str, object] = field(default_factory=dict)
    kinds: Mapping[str, str | T.DataType] = field(default_factory=dict)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        options = {**DEFAULTS, **self.options}
        if not _true(options["header"]):
            raise ValueError("A file without a header has no column names to map")
        df = spark.read.options(**options).csv(path)
        return df if _true(options["inferSchema"]) else cast_columns(df, self.kinds)


@dataclass(frozen=True)
class FileMapping:
    """A file to triples, saved if a path is given."""

    mapping: ElementMapping | Fused
    source: DelimitedSource = DelimitedSource()

    def triples(self, spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
        made = self.mapping.triples(self.source.read(spark, path))
        return save(made, out) if out else made


def file_mapping(id, *properties, options: Mapping | None = None, kinds: Mapping | None = None) -> FileMapping:
    """A file of one kind of element."""
    return FileMapping(fuse(ElementMapping(id, properties)), DelimitedSource(options or {}, kinds or {}))
