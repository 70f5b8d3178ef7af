"""Checkpoints as Parquet with a commit marker, their sizing, and unions of what is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default size of a written file.
FILE_BYTES = 256 << 20
MARKER = "_SUCCESS"


def marker_path(base: str | None) -> str | None:
    """Where Spark tells that a write under base has been committed. Nothing stays nothing."""
    return f"{base.rstrip('/')}/{MARKER}" if base else base


def base_path(marker: str | None) -> str | None:
    """The folder that a marker stands in; other paths as they are."""
    return marker[: -len(MARKER) - 1] if marker and marker.endswith(f"/{MARKER}") else marker


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def sampled_bytes(df: DataFrame, ratio: float = 0.1) -> int:
    """The size of df as JSON text, from a sample of its rows: their text is measured, which runs the plan once."""
    said = df.sample(ratio, seed=42).agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return int((said or 0) / ratio)


def partitions_for(size: int, target: int = FILE_BYTES) -> int:
    return max(1, size // target)


def save(df: DataFrame, path: str, target_bytes: int = FILE_BYTES, sample: float | None = None) -> DataFrame:
    """Write df over what path holds, in files of about target_bytes, and return what is written.

    The rows are rebalanced at run time from exact shuffle sizes; the plan is run once. With ``sample`` the number of
    files comes from the sampled size instead, and no setting of the session is touched, so that several saves may run at
    once; partitions are then merged without a shuffle where there are more of them.
    """
    spark = df.sparkSession
    if sample:
        n = partitions_for(sampled_bytes(df, sample), target_bytes)
        sized = df.coalesce(n) if n < df.rdd.getNumPartitions() else df.repartition(n)
        sized.write.mode("overwrite").parquet(base_path(path))
        return spark.read.parquet(base_path(path))
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(target_bytes))
    try:
        df.hint("rebalance").write.mode("overwrite").parquet(base_path(path))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.parquet(base_path(path))


def load(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame as it is; a path, or the marker in it, as Parquet."""
    if isinstance(source, DataFrame):
        return source
    if spark is None:
        raise ValueError("A path needs a session")
    return spark.read.parquet(base_path(str(source)))


def union_all(*sources: DataFrame | str, allow_missing: bool = False, spark: SparkSession | None = None) -> DataFrame:
    """All rows of DataFrames and stored ones, columns matched by name."""
    if not sources:
        raise ValueError("Nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), (load(s, spark) for s in sources))
