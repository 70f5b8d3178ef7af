"""Rows to triples: one generator over one scan, whatever the number of mappings."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import AutoEdgeId, Property, Value, value


@dataclass(frozen=True)
class ElementMapping:
    """An element's id and properties. Without an id it is an edge, named by its type and ends."""

    id: Value | str | AutoEdgeId | None
    properties: tuple[Property, ...] = ()
    name: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "properties", tuple(self.properties))
        if isinstance(self.id, AutoEdgeId) or self.id is None:
            (self.id or AutoEdgeId()).of(self.properties)

    def id_value(self) -> Value:
        if self.id is None or isinstance(self.id, AutoEdgeId):
            return (self.id or AutoEdgeId()).of(self.properties)
        return value(self.id)

    def columns(self) -> tuple[str, ...] | None:
        """Input columns that the mapping reads, if all its values know theirs."""
        used = [v.columns for v in (self.id_value(), *(p.value for p in self.properties))]
        return None if any(u is None for u in used) else tuple(dict.fromkeys(c for u in used for c in u))

    def with_properties(self, *more: Property) -> ElementMapping:
        return replace(self, properties=(*self.properties, *more))

    def triples(self, df: DataFrame, keys: Collection[str] | None = None) -> DataFrame:
        return fuse(self).triples(df, keys)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.triples(df)


@dataclass(frozen=True)
class Fused:
    """Several mappings over one input, and any triples-making functions beside them."""

    mappings: tuple[ElementMapping | Callable[[DataFrame], DataFrame], ...]
    name: str = ""

    def triples(self, df: DataFrame, keys: Collection[str] | None = None) -> DataFrame:
        """(id, key, value). With ``keys``, only these are made, so that other columns are not even read."""
        own = [m for m in self.mappings if isinstance(m, ElementMapping)]
        parts = [self._generated(df, own, keys)] if own else []
        for m in self.mappings:
            if not isinstance(m, ElementMapping):
                made = m(df).select("id", "key", "value")
                parts.append(made if keys is None else made.where(F.col("key").isin(*keys)))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    @staticmethod
    def _generated(df: DataFrame, mappings: list[ElementMapping], keys: Collection[str] | None) -> DataFrame:
        wanted = [(n, p) for n, m in enumerate(mappings) for p in m.properties if keys is None or p.key in keys]
        if not wanted:
            return df.select(F.lit("").alias("id"), F.lit("").alias("key"), F.lit("").alias("value")).where("false")
        ids = {n: m.id_value().resolve(df).cast("string").alias(f"i{n}") for n, m in enumerate(mappings) if any(n == k for k, _ in wanted)}
        stored = [p.stored(df).alias(f"v{k}") for k, (_, p) in enumerate(wanted)]
        made = [F.struct(F.col(f"i{n}").alias("id"), F.lit(p.key).alias("key"), F.col(f"v{k}").alias("value")) for k, (n, p) in enumerate(wanted)]
        return df.select(*ids.values(), *stored).select(F.inline(F.array(*made))).where("id <> '' AND value IS NOT NULL")

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.triples(df)


def fuse(*mappings: ElementMapping | Callable[[DataFrame], DataFrame]) -> Fused:
    """The union of all mappings' triples, in one pass over the input."""
    if not mappings:
        raise ValueError("Nothing to fuse")
    return Fused(mappings)
