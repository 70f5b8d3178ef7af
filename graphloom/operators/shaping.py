"""How a graph store is to see properties: one value or several, and the label that all nodes share."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Mode(StrEnum):
    """single: more than one value is an error. multiple: always a list. auto: as many as there are."""

    SINGLE = "single"
    MULTIPLE = "multiple"
    AUTO = "auto"


@dataclass(frozen=True)
class LoadConfig:
    """Settings of a load. Pauses are in seconds between ``min_pause`` and ``max_pause``; ``max_concurrency`` bounds the
    partitions that write at once, Spark's own parallelism if absent."""

    modes: Mapping[str, Mode] = field(default_factory=dict)
    default_mode: Mode = Mode.AUTO
    batch_size: int = 2500
    max_concurrency: int | None = None
    max_retries: int = 10
    min_pause: timedelta = timedelta(seconds=2)
    max_pause: timedelta = timedelta(minutes=2)
    common_label: str = "Node"

    @classmethod
    def of(cls, settings: Mapping | None) -> LoadConfig:
        """From a configuration's section; property settings may be a mode or a mapping with ``multi_value_mode``."""
        given = dict(settings or {})
        mode = lambda x: Mode(x.get("multi_value_mode", "auto") if isinstance(x, Mapping) else x)
        out = {}
        if "default_property_config" in given:
            out["default_mode"] = mode(given["default_property_config"])
        if "property_configs" in given:
            out["modes"] = {k: mode(v) for k, v in (given["property_configs"] or {}).items()}
        # the names of configuration files, and the short one of retries
        names = {"loader_batch_size": "batch_size", "loader_max_concurrency": "max_concurrency", "max_transaction_retries": "max_retries", "max_retries": "max_retries", "common_node_label": "common_label"}
        out |= {to: given[name] for name, to in names.items() if name in given}
        if "max_retry_pause" in given:
            pause = given["max_retry_pause"]
            try:
                out["max_pause"] = timedelta(**pause) if isinstance(pause, Mapping) else timedelta(seconds=float(pause))
            except (TypeError, ValueError) as error:
                raise ValueError(f"max_retry_pause is neither seconds nor parts of a duration: {pause!r}") from error
        if unknown := set(given) - {"default_property_config", "property_configs", "max_retry_pause", *names}:
            raise ValueError(f"Unknown settings: {', '.join(sorted(unknown))}")
        return cls(**out)

    def mode(self, key: str) -> Mode:
        return self.modes.get(key, self.default_mode)


def _mode_of(key: Column, config: LoadConfig) -> Column:
    out = F.lit(str(config.default_mode))
    for k, mode in config.modes.items():
        out = F.when(key == k, F.lit(str(mode))).otherwise(out)
    return out


def shaped(pg: DataFrame, config: LoadConfig) -> DataFrame:
    """pg with ``properties`` without nulls, repeats and empty lists, and ``single``: the keys to be written as one value."""
    real = lambda v: F.array_distinct(F.filter(v, lambda x: x.isNotNull() & (x != "null")))
    clean = F.map_filter(F.transform_values("properties", lambda _, v: real(v)), lambda _, v: F.size(v) > 0)
    one = lambda k, v: (_mode_of(k, config) != str(Mode.MULTIPLE)) & (F.size(v) == 1)
    return pg.withColumn("properties", F.coalesce(clean, F.create_map().cast("map<string,array<string>>"))).withColumn("single", F.map_keys(F.map_filter("properties", one)))


def violations(pg: DataFrame, config: LoadConfig) -> DataFrame:
    """(id, key, n): properties declared single that have several values."""
    each = shaped(pg, config).select("id", F.explode("properties").alias("key", "values"))
    return each.where((_mode_of(F.col("key"), config) == str(Mode.SINGLE)) & (F.size("values") > 1)).select("id", "key", F.size("values").alias("n"))


def with_common_label(node_rows: DataFrame, label: str) -> DataFrame:
    """Nodes with the label that all share."""
    if not label:
        raise ValueError("The common label is empty")
    return node_rows.withColumn("labels", F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.array(F.lit(label))))


def property_json(properties: Column, single: Column) -> Column:
    """JSON text of shaped properties: single ones as a value, the others as arrays."""
    entry = lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.when(F.array_contains(single, e["key"]), e["value"][0]).otherwise(F.concat(F.lit("["), F.array_join(e["value"], ","), F.lit("]"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(properties)), entry), ","), F.lit("}"))
