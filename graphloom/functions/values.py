"""Values and properties: immutable descriptions that become column expressions once the input is known."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.codec import JSON, Codec
from graphloom.model import FROM, TO, TYPE, is_reserved

ERROR, SKIP = "error", "skip"


def _named(df: DataFrame, name: str) -> Column:
    """The column of this very name, or null where the input has none."""
    return F.col("`" + name.replace("`", "``") + "`") if name in df.columns else F.lit(None).cast("string")


def _joined(*parts: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The pieces of values one after the other; the texts that meet become one."""
    if any(p is None for p in parts):
        return None
    out = parts[0]
    for p in parts[1:]:
        out = (*out[:-1], out[-1] + p[0], *p[1:])
    return out


@dataclass(frozen=True)
class Value:
    """Something computed from an input row. ``columns`` are the input columns it needs, if it knows them. ``pieces`` are
    texts and columns in turn (text, column, text, ..., text) where the value's text is just these, joined."""

    build: Callable[[DataFrame], Column]
    columns: tuple[str, ...] | None = None
    name: str | None = None
    pieces: tuple[str, ...] | None = None

    def resolve(self, df: DataFrame) -> Column:
        return self.build(df)

    def map(self, fn: Callable[[Column], Column]) -> Value:
        """The value after fn; calls apply in their order, serialisation comes last."""
        return replace(self, build=lambda df: fn(self.build(df)), pieces=None)

    def wrapped(self, prefix: str = "", postfix: str = "") -> Value:
        """prefix + text + postfix; null where the value is null or empty."""
        text = lambda c: c.cast("string")
        made = self.map(lambda c: F.when(text(c) != "", F.concat(F.lit(prefix), text(c), F.lit(postfix))))
        return replace(made, pieces=_joined((prefix,), self.pieces, (postfix,)))

    def as_property(self, key: str | None = None, codec: Codec | None = None) -> Property:
        return Property(key or self.name or "", self, codec)


def column(name: str) -> Value:
    return Value(lambda df: _named(df, name), (name,), name, ("", name, ""))


def constant(value) -> Value:
    return Value(lambda df: F.lit(value), (), pieces=(value,) if isinstance(value, str) else None)


def expression(fn: Callable[..., Column], *names: str) -> Value:
    """fn of the named columns, a Column each."""
    return Value(lambda df: fn(*[_named(df, n) for n in names]), names)


def python_function(fn: Callable, *names: str, returns: str = "string") -> Value:
    """Fallback for what no expression can say: fn of the named columns, in Arrow batches. Declared columns keep pruning."""
    return Value(lambda df: F.udf(fn, returns, useArrow=True)(*[_named(df, n) for n in names]), names)


def value(of: Value | str | Callable[..., Column], *names: str) -> Value:
    """A Value as it is, a column name, or a function of columns."""
    if isinstance(of, Value):
        return of
    if isinstance(of, str):
        return column(of)
    if callable(of):
        return expression(of, *names)
    raise ValueError(f"Neither a value, a column name nor a function: {of!r}")


@dataclass(frozen=True)
class Property:
    """A key and the value that each row gives it."""

    key: str
    value: Value
    codec: Codec | None = field(default=None)

    def __post_init__(self) -> None:
        is_reserved(self.key)

    def stored(self, df: DataFrame) -> Column:
        """The value's text in a triple: raw under a reserved key, else encoded. Null where there is no triple."""
        c = self.value.resolve(df)
        if is_reserved(self.key):
            return c.cast("string")
        kind = df.select(c.alias("c")).schema[0].dataType
        return (self.codec or JSON).encode(c, kind)


def prop(key: str, of: Value | str | Callable[..., Column] | None = None, *names: str) -> Property:
    return Property(key, value(key if of is None else of, *names))


@cache
def type_is(name: str) -> Property:
    return Property(TYPE, constant(name))


@cache
def data_source(name: str) -> Property:
    return Property("dataSources", constant(name))


def source(of: Value | str | Callable[..., Column], *names: str) -> Property:
    return Property(FROM, value(of, *names))


def target(of: Value | str | Callable[..., Column], *names: str) -> Property:
    return Property(TO, value(of, *names))


def accession(of_source: Value | str, of_accession: Value | str) -> Property:
    """``source:accession`` under ``accessions``; each part a value, a column or, after ``!``, a constant."""

    def part(x: Value | str) -> Value:
        if isinstance(x, str) and x.startswith("!"):
            return constant(x[1:])
        return value(x)

    s, a = part(of_source), part(of_accession)

    def build(df: DataFrame) -> Column:
        left, right = s.resolve(df).cast("string"), a.resolve(df).cast("string")
        return F.when((left != "") & (right != ""), F.concat(left, F.lit(":"), right))

    return Property("accessions", Value(build, _union(s, a)))


def _union(*values: Value) -> tuple[str, ...] | None:
    if any(v.columns is None for v in values):
        return None
    return tuple(dict.fromkeys(c for v in values for c in v.columns))


def edge_id(kind: Value | str, begin: Value | str, end: Value | str, prefix: str = "", on_missing: str = ERROR) -> Value:
    """``prefix type:from-to``. A missing part fails the job, or with ``skip`` gives no id and so no edge. A str kind is a constant."""
    t, f, e = constant(kind) if isinstance(kind, str) else kind, value(begin), value(end)

    def build(df: DataFrame) -> Column:
        parts = [v.resolve(df).cast("string") for v in (t, f, e)]
        whole = F.concat(F.lit(prefix), parts[0], F.lit(":"), parts[1], F.lit("-"), parts[2])
        there = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
        if on_missing == SKIP:
            return F.when(there, whole)
        return F.when(there, whole).otherwise(F.raise_error(F.lit("An edge needs a type and both ends")).cast("string"))

    return Value(build, _union(t, f, e), pieces=_joined((prefix,), t.pieces, (":",), f.pieces, ("-",), e.pieces))


def one_to_one(of: Value, df: DataFrame) -> bool:
    """Whether rows that differ in the value's columns surely differ in its text.

    So it is with whole numbers, each set off from the next by a text that no number can run into; the last column may
    be a string.
    """
    if of.pieces is None or not (names := of.pieces[1::2]) or any(df.columns.count(n) != 1 for n in names):
        return False
    kinds = [df.schema[n].dataType for n in names]
    whole = [isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in kinds]
    apart = all(t == "-" or t.strip("-0123456789") for t in of.pieces[2:-1:2])
    return apart and all(whole[:-1]) and (whole[-1] or kinds[-1].simpleString() == "string")


@dataclass(frozen=True)
class AutoEdgeId:
    """Asks for an edge id from the mapping's own type and ends."""

    prefix: str = ""
    on_missing: str = ERROR

    def of(self, properties: Iterable[Property]) -> Value:
        found: dict[str, Value] = {}
        for p in properties:
            found.setdefault(p.key, p.value)
        if missing := [k for k in (TYPE, FROM, TO) if k not in found]:
            raise ValueError(f"An automatic edge id needs {', '.join(missing)}")
        return edge_id(found[TYPE], found[FROM], found[TO], self.prefix, self.on_missing)
