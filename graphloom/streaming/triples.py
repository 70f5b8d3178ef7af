"""Mapping a stream of rows to triples: the same stateless projection, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.mapping import ElementMapping, Fused


def stream_triples(rows: DataFrame, mapping: ElementMapping | Fused, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the triples of a streaming DataFrame to a Parquet folder; the checkpoint makes each batch count once."""
    if not rows.isStreaming:
        raise ValueError("Not a stream; map it and save it")
    out = mapping.triples(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start(path)
