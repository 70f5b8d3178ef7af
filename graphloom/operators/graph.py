"""Questions to property-graph rows: ends that exist, one-hop patterns, counts, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import EDGE, NODE


def nodes(pg: DataFrame) -> DataFrame:
    return pg.where(F.col("type") == NODE)


def edges(pg: DataFrame) -> DataFrame:
    return pg.where(F.col("type") == EDGE)


def valid_edges(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = node_rows.select(F.col("id").alias("node_id"))
    for end in ("from", "to"):
        edge_rows = edge_rows.join(ids, edge_rows[end] == ids["node_id"], "left_semi")
    return edge_rows


def dangling_edges(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """(id, end, missing): an entry for each end of an edge that is not a node, a missing end included."""
    ids = node_rows.select(F.col("id").alias("node_id")).distinct()
    ends = edge_rows.select("id", F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("from").alias("missing")), F.struct(F.lit("to").alias("end"), F.col("to").alias("missing")))).alias("e")).select("id", "e.*")
    return ends.join(ids, ends["missing"] == ids["node_id"], "left_anti")


def one_hop(pg: DataFrame, start: str, relation: str, end: str) -> DataFrame:
    """(from, edge, to): elements that match (:start)-[:relation]->(:end)."""
    has = lambda label: F.array_contains("labels", label)
    a = nodes(pg).where(has(start)).select(F.col("id").alias("from"))
    b = nodes(pg).where(has(end)).select(F.col("id").alias("to"))
    r = edges(pg).where(has(relation)).select(F.col("id").alias("edge"), "from", "to")
    return r.join(a, "from", "left_semi").join(b, "to", "left_semi").select("from", "edge", "to")


def label_counts(pg: DataFrame) -> DataFrame:
    """(type, label, n)."""
    return pg.select("type", F.explode_outer("labels").alias("label")).groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"))


def element(pg: DataFrame, element_id: str, kind: str | None = None) -> DataFrame:
    """The rows of one id, of one type if given."""
    found = pg.where(F.col("id") == element_id)
    return found if kind is None else found.where(F.col("type") == kind)


def histogram(df: DataFrame, of: Column, width: float) -> DataFrame:
    """(bin, n) in the order of bins, each named by its lower bound."""
    return df.groupBy(F.round(F.floor(of / F.lit(width)) * width, 10).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin")
