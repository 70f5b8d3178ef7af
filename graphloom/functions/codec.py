"""JSON text of column values, as expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_text(value: Column, kind: T.DataType) -> Column:
    """The JSON text of one value; null for null, the empty string and NaN.

    Dates and timestamps are ISO strings, decimals are numbers; arrays, structs and maps are written as they are.
    """
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BooleanType)):
        return value.cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = value.cast("string")
        return F.when(~F.isnan(value), F.when(text.endswith("Infinity"), quoted(text)).otherwise(text))
    if isinstance(kind, T.DateType):
        return quoted(F.date_format(value, "yyyy-MM-dd"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return quoted(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    text = F.base64(value) if isinstance(kind, T.BinaryType) else F.nullif(value.cast("string"), F.lit(""))
    # a string needs the JSON writer only for what must be escaped
    in_array = F.to_json(F.array(text))
    escaped = F.substr(in_array, F.lit(2), F.length(in_array) - 2)
    return F.when(text.rlike(r"""["\\\x00-\x1f]"""), escaped).otherwise(quoted(text))


@dataclass(frozen=True)
class Codec:
    """How a key's values are stored in triples (encode) and written to JSON lines (decode gives JSON text)."""

    encode: Callable[[Column, T.DataType], Column] = json_text
    decode: Callable[[Column], Column] = lambda stored: stored


JSON = Codec()


def elements(array_text: Column) -> Column:
    """The JSON texts of the elements of a JSON array given as text."""
    scalars = F.regexp_extract_all(array_text, F.lit(r'"(?:[^"\\]|\\.)*"|[^\[\],\s"]+'), F.lit(0))
    bare = F.regexp_replace(array_text, r'"(?:[^"\\]|\\.)*"', "")
    nested = F.transform(F.from_json(array_text, "array<string>"), lambda e: F.when(e.rlike(r"^\s*[\[{]"), e).otherwise(json_text(e, T.StringType())))
    return F.when(bare.rlike(r"^\s*\[[^\[{]*$"), scalars).otherwise(nested)
