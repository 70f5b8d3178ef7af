"""A bounded, repeatable sample of labelled documents to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import held_out, settle


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents of different texts, none of them held out.

    The ids come first by hash, so reruns agree; their number bounds what is broadcast. Repeated labels count as their
    largest, null ids and labels are left out, and of equal texts the smallest id stays.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    chosen = settle(known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).agg(F.min(F.struct("doc_id", "y", "text")).alias("r")).select("r.doc_id", "r.y", "r.text")
