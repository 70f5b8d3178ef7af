"""Triples to property-graph rows, and what can be wrong with them."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.codec import json_text
from graphloom.functions.values import one_to_one
from graphloom.model import EDGE, FROM, NODE, RESERVED, TO, TYPE
from graphloom.operators.mapping import ElementMapping, Fused, fuse

#: Types whose values are smaller than their texts, and never equal where the texts differ.
_SENT_AS_THEY_ARE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def values_by_key(triples: DataFrame) -> DataFrame:
    """(id, key, values): the sorted set of values that an element has under each key."""
    return triples.groupBy("id", "key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def rollup(triples: DataFrame, strict: bool = False, keys: Collection[str] | None = None) -> DataFrame:
    """One row per element: id, labels, from, to, properties, type.

    One aggregation by id gathers the set of an element's (key, value) pairs, so there is one exchange and no join, and
    repeated triples are merged before it: an element that millions of rows repeat costs each task one row. The rest is
    array functions over the sorted set. Labels and values are sorted sets. Of several ends the least is taken, or with
    ``strict`` the job fails, as it does for an edge without an end or a type. An element with only a ``@to`` is a node.
    With ``keys`` only these go into the rows, before the exchange; elements without any of them are absent. Give the same
    keys to the mapping, and other columns are not even read.
    """
    if keys is not None:
        triples = triples.where(F.col("key").isin(*keys))
    gathered = triples.where("value IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("key", "value"))).alias("pairs"))
    own = gathered.select("id", F.filter("pairs", lambda p: p["key"].isin(*RESERVED)).alias("own"), F.filter("pairs", lambda p: ~p["key"].isin(*RESERVED)).alias("rest"))
    under = lambda pairs, key: F.transform(F.filter(pairs, lambda p: p["key"] == key), lambda p: p["value"])
    none = lambda key: F.when(F.size(under("own", key)) > 0, under("own", key))
    names = F.array_distinct(F.transform("rest", lambda p: p["key"]))
    return _checked(own.select("id", none(TYPE).alias("labels"), none(FROM).alias("froms"), none(TO).alias("tos"), F.map_from_arrays(names, F.transform(names, lambda k: under("rest", k))).alias("properties")), strict)


def rollup_rows(*parts: tuple[ElementMapping | Fused, DataFrame], strict: bool = False, keys: Collection[str] | None = None) -> DataFrame:
    """The roll-up of the triples that mappings make of their inputs, (mapping, input) each, without triples where it can be.

    Where an id is known to be one-to-one in its columns, and no other mapping can make it, rows are grouped by these
    columns instead of the id's text: the exchange carries them and a set for each property of other columns; constants,
    ends and the id itself are made behind it. All other mappings go through their triples, together. A mapping of a
    fusion that is grouped so scans the input by itself, for its own columns.
    """
    each = [(m, df) for made, df in parts for m in (made.mappings if isinstance(made, Fused) else (made,))]
    begins = [m.id_value().pieces[0] if isinstance(m, ElementMapping) and m.id_value().pieces else "" for m, _ in each]
    alone = [not any(a.startswith(b) or b.startswith(a) for k, b in enumerate(begins) if k != n) for n, a in enumerate(begins)]
    direct, rest = [], []
    for (m, df), own in zip(each, alone, strict=True):
        if own and isinstance(m, ElementMapping) and one_to_one(m.id_value(), df):
            if any(keys is None or p.key in keys for p in m.properties):
                direct.append(_grouped(m, df, strict, keys))
        else:
            rest.append((m, df))
    if rest or not direct:
        # mappings of one input stay one scan
        by_input = {}
        for m, df in rest or each:
            by_input.setdefault(id(df), (df, []))[1].append(m)
        direct.append(rollup(reduce(DataFrame.union, [fuse(*ms).triples(df, keys) for df, ms in by_input.values()]), strict, keys))
    return reduce(DataFrame.union, direct)


def _grouped(mapping: ElementMapping, df: DataFrame, strict: bool, keys: Collection[str] | None) -> DataFrame:
    own = tuple(dict.fromkeys(mapping.id_value().pieces[1::2]))
    wanted = [p for p in mapping.properties if keys is None or p.key in keys]
    mark = "v"
    while any(n.lower().startswith(mark) for n in own):
        mark += "_"
    sent, kinds = {}, {}
    for k, p in enumerate(wanted):
        if p.value.pieces is not None and set(p.value.pieces[1::2]) <= set(own):
            continue  # made of the group's columns
        c = p.value.resolve(df)
        kind = df.select(c.alias("c")).schema[0].dataType
        if p.codec is None and p.key not in RESERVED and isinstance(kind, _SENT_AS_THEY_ARE):
            sent[k], kinds[k] = c, kind
        else:
            sent[k] = p.stored(df)
    at = ["`" + n.replace("`", "``") + "`" for n in own]
    rows = df.select(*at, *[c.alias(f"{mark}{k}") for k, c in sent.items()])
    groups = rows.groupBy(*at).agg(*[F.collect_set(f"{mark}{k}").alias(f"{mark}{k}") for k in sent]) if sent else rows.distinct()
    by_key = {}
    for k, p in enumerate(wanted):
        if k in kinds:
            made = _texts(F.col(f"{mark}{k}"), kinds[k])
        else:
            made = F.col(f"{mark}{k}") if k in sent else F.array(p.stored(groups))
        by_key.setdefault(p.key, []).append(made)
    values = {key: F.array_sort(F.array_distinct(F.array_compact(F.concat(*sets)))) for key, sets in by_key.items()}
    names = sorted(set(values) - set(RESERVED), key=lambda k: k.encode())
    whole = groups.select(
        mapping.id_value().resolve(groups).cast("string").alias("id"),
        *[(F.when(F.size(values[key]) > 0, values[key]) if key in values else F.lit(None).cast("array<string>")).alias(name) for key, name in ((TYPE, "labels"), (FROM, "froms"), (TO, "tos"))],
        (F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[values[n] for n in names])), lambda _, v: F.size(v) > 0) if names else F.create_map().cast("map<string,array<string>>")).alias("properties"),
    )
    return _checked(whole.where((F.col("id") != "") & (F.col("labels").isNotNull() | F.col("froms").isNotNull() | F.col("tos").isNotNull() | (F.size("properties") > 0))), strict)


def _texts(values: Column, kind: T.DataType) -> Column:
    return F.transform(values, lambda v: json_text(v, kind))


def _checked(rows: DataFrame, strict: bool) -> DataFrame:
    """Rows with one end each of the sets ``froms`` and ``tos``, and their type."""
    begin, end = F.get("froms", F.lit(0)), F.get("tos", F.lit(0))
    if strict:
        fails = lambda c, bad, what: F.when(bad, F.raise_error(F.concat(F.lit(f"{what}: "), F.col("id"))).cast("string")).otherwise(c)
        begin = fails(begin, F.size("froms") > 1, "Several @from")
        end = fails(end, (F.size("tos") > 1) | (F.col("froms").isNotNull() & (F.col("tos").isNull() | F.col("labels").isNull())), "Several @to, or an edge without @to or @type")
    return rows.select("id", "labels", begin.alias("from"), end.alias("to"), "properties", F.when(F.col("froms").isNotNull(), EDGE).otherwise(NODE).alias("type"))


def problems(triples: DataFrame) -> DataFrame:
    """(id, problem): several ends, one end only, edges without a type."""
    ends = triples.where(F.col("key").isin(*RESERVED) & F.col("value").isNotNull()).distinct()
    n = lambda key: F.count(F.when(F.col("key") == key, 1))
    counted = ends.groupBy("id").agg(n(TYPE).alias("types"), n(FROM).alias("froms"), n(TO).alias("tos"))
    found = F.array_compact(
        F.array(
            F.when(F.col("froms") > 1, "several @from"),
            F.when(F.col("tos") > 1, "several @to"),
            F.when((F.col("froms") > 0) & (F.col("tos") == 0), "no @to"),
            F.when((F.col("tos") > 0) & (F.col("froms") == 0), "no @from"),
            F.when((F.col("froms") > 0) & (F.col("types") == 0), "no @type"),
        )
    )
    return counted.select("id", F.explode(found).alias("problem"))
