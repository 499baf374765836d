"""Typed values of the expression language as Columns.

A ``Val`` is a Column with its JSON kind, known when the plan is built wherever the schema
says it; kind ``json`` is a VARIANT whose kind is read from its type tag at run time.
Undefined is SQL NULL; JSON null is the variant null, or a ``null`` literal.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: What a trimmed string must look like to count as a number.
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Val:
    col: Column
    kind: str  # undef null bool num str bin arr obj map json
    type: T.DataType | None = None  # the Spark type of arr, obj and map

    def element(self, col: Column) -> Val:
        return of_type(col, self.type.elementType)


def of_type(col: Column, kind: T.DataType) -> Val:
    """A value of a known Spark type."""
    if isinstance(kind, T.BooleanType):
        return Val(col, "bool")
    if isinstance(kind, NUMBERS):
        return Val(col, "num", kind)
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return Val(col, "str")
    if isinstance(kind, T.BinaryType):
        return Val(col, "bin")
    if isinstance(kind, T.ArrayType):
        return Val(col, "arr", kind)
    if isinstance(kind, T.StructType):
        return Val(col, "obj", kind)
    if isinstance(kind, T.MapType):
        return Val(col, "map", kind)
    if isinstance(kind, T.VariantType):
        return Val(col, "json")
    if isinstance(kind, T.NullType):
        return Val(col, "undef")
    return Val(col.cast("string"), "str")  # dates and times appear as text


def variant(value) -> Column:
    """A VARIANT literal of a JSON value."""
    return F.parse_json(F.lit(json.dumps(value)))


def literal(value) -> Val:
    """A JSON literal; arrays of one scalar kind are typed, other containers VARIANT."""
    if value is None:
        return Val(F.parse_json(F.lit("null")), "null")
    if isinstance(value, bool):
        return Val(F.lit(value), "bool")
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        return Val(F.lit(value).cast("long"), "num", T.LongType())
    if isinstance(value, (int, float)):
        return Val(F.lit(float(value)), "num", T.DoubleType())
    if isinstance(value, str):
        return Val(F.lit(value), "str")
    if isinstance(value, (bytes, bytearray)):
        return Val(F.lit(bytes(value)), "bin")
    if isinstance(value, list) and value:
        items = [literal(v) for v in value]
        kinds = {i.kind for i in items}
        if kinds == {"num"}:
            kind = T.LongType() if all(isinstance(i.type, T.LongType) for i in items) else T.DoubleType()
            return Val(F.array(*[i.col.cast(kind) for i in items]), "arr", T.ArrayType(kind))
        if kinds in ({"str"}, {"bool"}):
            return Val(F.array(*[i.col for i in items]), "arr", T.ArrayType(T.StringType() if kinds == {"str"} else T.BooleanType()))
    return Val(variant(value), "json")


def tag(v: Column) -> Column:
    """VOID, BOOLEAN, BIGINT, DECIMAL, DOUBLE, STRING, OBJECT or ARRAY of a VARIANT."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def is_tag(v: Column, *names: str) -> Column:
    if names == ("ARRAY",):  # a cast that fails at once, where the tag would read all of the value
        return F.try_variant_get(v, "$", "array<variant>").isNotNull()
    if names == ("OBJECT",):
        return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    return F.coalesce(tag(v).isin(*names), F.lit(False))


NUMBER_TAGS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def to_variant(v: Val) -> Column:
    if v.kind in ("json", "null"):
        return v.col
    if v.kind in ("obj", "map"):
        return F.to_variant_object(v.col)
    if v.kind == "arr" and isinstance(v.type.elementType, (T.StructType, T.MapType)):
        return F.to_variant_object(v.col)
    return v.col.cast("variant")


def _text_number(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_TEXT), F.expr("1D") * trimmed.try_cast("double")).otherwise(F.lit(0.0))


def num(v: Val) -> Column:
    """Number of any value: null and undefined 0, booleans 0/1, numeric text, else 0."""
    if v.kind == "num":
        return F.coalesce(v.col.cast("double"), F.lit(0.0))
    if v.kind == "bool":
        return F.coalesce(v.col.cast("double"), F.lit(0.0))
    if v.kind == "str":
        return F.coalesce(_text_number(v.col), F.lit(0.0))
    if v.kind == "json":
        t = tag(v.col)
        found = (
            F.when(t.isin(*NUMBER_TAGS), F.try_variant_get(v.col, "$", "double"))
            .when(t == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean").cast("double"))
            .when(t == "STRING", _text_number(F.try_variant_get(v.col, "$", "string")))
        )
        return F.coalesce(found, F.lit(0.0))
    return F.lit(0.0)


def finite(c: Column) -> Column:
    """NULL instead of values that JSON cannot hold."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def text(v: Val) -> Column:
    """String of any value: containers as JSON text, null and undefined as words."""
    if v.kind == "str":
        return F.coalesce(v.col, F.lit("undefined"))
    if v.kind == "null":
        return F.lit("null")
    if v.kind == "undef":
        return F.lit("undefined")
    if v.kind in ("num", "bool"):
        return F.coalesce(v.col.cast("string"), F.lit("undefined"))
    if v.kind == "json":
        own = F.when(is_tag(v.col, "STRING"), F.try_variant_get(v.col, "$", "string")).otherwise(F.to_json(v.col))
        return F.coalesce(own, F.lit("undefined"))
    if v.kind == "bin":
        return F.base64(v.col)
    return F.coalesce(F.to_json(to_variant(v)), F.lit("undefined"))


def truthy(v: Val) -> Column:
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind == "num":
        return F.coalesce((v.col != 0) & ~F.isnan(v.col.cast("double")), F.lit(False))
    if v.kind == "str":
        return F.coalesce(v.col != "", F.lit(False))
    if v.kind in ("null", "undef"):
        return F.lit(False)
    if v.kind == "json":
        t = tag(v.col)
        found = (
            F.when(t == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean"))
            .when(t.isin(*NUMBER_TAGS), F.try_variant_get(v.col, "$", "double") != 0)
            .when(t == "STRING", F.try_variant_get(v.col, "$", "string") != "")
            .otherwise(t.isin("OBJECT", "ARRAY"))
        )
        return F.coalesce(found, F.lit(False))
    return v.col.isNotNull()


def canonical(v: Val) -> Column:
    """Text that is equal for equal JSON values; numbers compare by value."""
    if v.kind == "num":
        return F.coalesce(F.concat(F.lit("n"), v.col.cast("double").cast("string")), F.lit("u"))
    if v.kind == "str":
        return F.coalesce(F.concat(F.lit("s"), v.col), F.lit("u"))
    if v.kind == "bool":
        return F.coalesce(F.concat(F.lit("b"), v.col.cast("string")), F.lit("u"))
    if v.kind == "null":
        return F.lit("z")
    if v.kind == "undef":
        return F.lit("u")
    if v.kind == "bin":
        return F.coalesce(F.concat(F.lit("x"), F.hex(v.col)), F.lit("u"))
    whole = v.col if v.kind == "json" else to_variant(v)
    t = tag(whole)
    found = (
        F.when(t == "VOID", F.lit("z"))
        .when(t.isin(*NUMBER_TAGS), F.concat(F.lit("n"), F.try_variant_get(whole, "$", "double").cast("string")))
        .when(t == "STRING", F.concat(F.lit("s"), F.try_variant_get(whole, "$", "string")))
        .when(t == "BOOLEAN", F.concat(F.lit("b"), F.try_variant_get(whole, "$", "string")))
        .otherwise(F.concat(F.lit("j"), F.to_json(whole)))
    )
    return F.coalesce(found, F.lit("u"))


def elements(v: Val) -> Val:
    """The value as an array: itself, or a VARIANT array's elements."""
    if v.kind == "arr":
        return v
    if v.kind == "json":
        return Val(F.try_variant_get(v.col, "$", "array<variant>"), "arr", T.ArrayType(T.VariantType()))
    raise ValueError(f"Operand is not an array: {v.kind}")


def members(v: Val) -> Val:
    """The value as a map from keys to values."""
    if v.kind == "map":
        return v
    if v.kind == "obj":
        whole = F.to_variant_object(v.col)
    elif v.kind == "json":
        whole = v.col
    else:
        raise ValueError(f"Operand is not an object: {v.kind}")
    return Val(F.try_variant_get(whole, "$", "map<string,variant>"), "map", T.MapType(T.StringType(), T.VariantType()))
