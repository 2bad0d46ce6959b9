"""Canonical JSON as a Column: keys in code-point order, no spaces, non-ASCII characters as they are.

The text is the same, byte for byte, as json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), so a
digest made on the executors equals one that a driver makes. Strings, whole numbers, truth values, dates, structs, maps
and arrays are written by expressions. A type that holds fractions or variants has Spark's JSON of the whole value put
into this form by a small function, since a fraction's shortest digits have no expression of their own.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "null"
#: Characters that JSON escapes by a letter.
NAMED = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
WRITTEN = (T.DateType, T.TimestampType, T.TimestampNTZType)


def text(value) -> str:
    """The canonical JSON of a Python value, on the driver."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value) -> str:
    return hashlib.sha256(text(value).encode()).hexdigest()


def quoted(value: Column) -> Column:
    """A string as a JSON string. Texts without control characters take two replacements."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(32):
        full = F.replace(full, F.lit(chr(code)), F.lit(NAMED.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(value.rlike("[\\x00-\\x1f]"), full).otherwise(plain), F.lit('"'))


def _expressible(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_expressible(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _expressible(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _expressible(kind.valueType)
    return isinstance(kind, (T.StringType, T.BooleanType, T.NullType, *WHOLE, *WRITTEN))


def _written(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        out = F.when(value.isNotNull(), joined({f.name: _written(value.getField(f.name), f.dataType) for f in kind}))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _written(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        # entries sort by key alone: a value may be of a type without an order
        keys = F.array_sort(F.map_keys(value))
        entry = lambda k: F.concat(quoted(k), F.lit(":"), _written(F.element_at(value, k), kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(keys, entry), ","), F.lit("}"))
    elif isinstance(kind, T.NullType):
        return F.lit(NULL)
    elif isinstance(kind, (T.BooleanType, *WHOLE)):
        out = value.cast("string")
    else:
        out = quoted(value.cast("string"))
    return F.coalesce(out, F.lit(NULL))


def of_text(value: Column) -> Column:
    """JSON text in canonical form; null where it is null or no JSON. Of repeated keys the last one counts."""

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else text(json.loads(v))
        except ValueError:
            return None

    return F.udf(one, "string", useArrow=True)(value)


def of(value: Column, kind: T.DataType) -> Column:
    """Any value in canonical form, given its type; a null value is the text null, and null fields are kept.

    A map's keys must be strings, as an object's are; other maps are a TypeError. NaN and infinities are written as the
    strings that Spark's JSON gives them, as JSON has no number for them.
    """
    if _expressible(kind):
        return _written(value, kind)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        if isinstance(kind, T.MapType) and not isinstance(kind.keyType, T.StringType):
            raise TypeError("an object's keys are strings")
        return F.coalesce(of_text(F.to_json(value, {"ignoreNullFields": "false"})), F.lit(NULL))
    inner = of_text(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))  # a bare fraction has no JSON of its own
    return F.regexp_extract(inner, r'^\{"v":(.*)\}$', 1)


def joined(named: dict[str, Column]) -> Column:
    """The object of values that are canonical already, by name."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(text(n) + ":"), named[n]) for n in sorted(named)]), F.lit("}"))
