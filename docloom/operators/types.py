"""Schemas of JSON values: inference, validation as Columns, and other schema languages.

A schema is a dict with ``kind``: any con bool num str bin arr obj map ref or. Validators
compile to one Column over a VARIANT: the first error's code, or NULL for valid values.
A schema may bring a rule of its own: ``test``, a function of the VARIANT Column, or
``check``, a function of a Python value for ``first_error``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.arrow import arrow
from docloom.functions.values import NUMBER_TAGS, Val, canonical, elements, is_tag, literal, members

#: Error codes in the order of their numbers.
ERRORS = "STR NUM BOOL ARR TUP OBJ MAP KEY KEYS BIN OR REF ENUM CONST VALIDATION INT UINT STR_LEN ARR_LEN GT GTE LT LTE BIN_LEN".split()
#: What the errors say.
MESSAGES = {
    "STR": "Not a string.",
    "NUM": "Not a number.",
    "BOOL": "Not a boolean.",
    "ARR": "Not an array.",
    "TUP": "Not a tuple.",
    "OBJ": "Not an object.",
    "MAP": "Not a map.",
    "KEY": "Missing key.",
    "KEYS": "Too many or missing object keys.",
    "BIN": "Not a binary.",
    "OR": "None of types matched.",
    "REF": "Validation error in referenced type.",
    "ENUM": "Not an enum value.",
    "CONST": "Invalid constant.",
    "VALIDATION": "Custom validator failed.",
    "INT": "Not an integer.",
    "UINT": "Not an unsigned integer.",
    "STR_LEN": "Invalid string length.",
    "ARR_LEN": "Invalid array length.",
    "GT": "Value is too small.",
    "GTE": "Value is too small.",
    "LT": "Value is too large.",
    "LTE": "Value is too large.",
    "BIN_LEN": "Invalid binary length.",
}
RANGES = {"i8": (-(2**7), 2**7 - 1), "i16": (-(2**15), 2**15 - 1), "i32": (-(2**31), 2**31 - 1), "u8": (0, 2**8 - 1), "u16": (0, 2**16 - 1), "u32": (0, 2**32 - 1)}
SPARK = {"i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "i": T.LongType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "u": T.DecimalType(20, 0), "f32": T.FloatType(), "f64": T.DoubleType(), "f": T.DoubleType()}


class SchemaError(ValueError):
    """A schema that is not well formed."""


KINDS = "any con bool num str bin arr obj map ref or enum key fn fn$ alias module".split()


def message(code: str) -> str:
    return MESSAGES[code]


def check(schema: dict) -> None:
    """Raise for a schema that is not well formed."""
    kind = schema.get("kind")
    if kind not in KINDS:
        raise SchemaError(f"unknown kind {kind!r}")
    if kind == "num":
        if schema.get("format", "f64") not in SPARK:
            raise SchemaError("INVALID_FORMAT")
        if "gt" in schema and "gte" in schema or "lt" in schema and "lte" in schema:
            raise SchemaError("GT_GTE" if "gt" in schema and "gte" in schema else "LT_LTE")
        if schema.get("gt", schema.get("gte", -float("inf"))) > schema.get("lt", schema.get("lte", float("inf"))):
            raise SchemaError("GT_LT")
    if kind in ("str", "arr", "bin") and schema.get("min", 0) > schema.get("max", float("inf")):
        raise SchemaError("MIN_MAX")
    if kind == "arr" and not {"type", "head", "tail"} & schema.keys():
        raise SchemaError("EMPTY_ARR")
    if kind == "arr" and "tail" in schema and "type" not in schema:
        raise SchemaError("LONE_TAIL")
    if kind == "ref" and not schema.get("ref"):
        raise SchemaError("REF_TYPE")
    if kind in ("or", "enum") and not schema.get("types" if kind == "or" else "values"):
        raise SchemaError("TYPES_LENGTH")
    nested = [schema[k] for k in ("type", "req", "res") if k in schema]
    nested += [schema["value"]] if kind in ("map", "key", "alias") else []
    for part in [*schema.get("head", []), *schema.get("tail", []), *schema.get("types", []), *(f["value"] for f in schema.get("keys", [])), *nested]:
        check(part)


def from_value(value) -> dict:
    """Schema of one value: arrays of one kind are homogeneous, others tuples; null is constant."""
    if value is None:
        return {"kind": "con", "value": None}
    if isinstance(value, bool):
        return {"kind": "bool"}
    if isinstance(value, (int, float)):
        return {"kind": "num"}
    if isinstance(value, str):
        return {"kind": "str"}
    if isinstance(value, list):
        if not value:
            return {"kind": "arr", "type": {"kind": "any"}}
        own = [from_value(v) for v in value]
        return {"kind": "arr", "type": own[0]} if all(o["kind"] == own[0]["kind"] for o in own) else {"kind": "arr", "head": own}
    return {"kind": "obj", "keys": [{"key": k, "value": from_value(v)} for k, v in value.items()]}


def spark_type(schema: dict) -> T.DataType:
    """The Spark type that holds a schema's values."""
    kind = schema["kind"]
    if kind == "bool":
        return T.BooleanType()
    if kind == "num":
        return SPARK[schema.get("format", "f64")]
    if kind == "str":
        return T.StringType()
    if kind == "bin":
        return T.BinaryType()
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["value"]))
    if kind == "obj":
        return T.StructType([T.StructField(f["key"], spark_type(f["value"]), bool(f.get("optional"))) for f in schema.get("keys", [])])
    if kind == "arr" and "type" in schema and not schema.get("head") and not schema.get("tail"):
        return T.ArrayType(spark_type(schema["type"]))
    if kind == "arr" and "type" not in schema:
        return T.StructType([T.StructField(f"_{k}", spark_type(s)) for k, s in enumerate([*schema.get("head", []), *schema.get("tail", [])], 1)])
    return T.VariantType()


def _first(*checks: Column) -> Column:
    return F.coalesce(*checks)


def _fails(code: str, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(code))


def recursive(schema: dict, modules: dict[str, dict] | None, above: frozenset = frozenset()) -> bool:
    """Whether references lead back to a schema that is being read."""
    if schema["kind"] == "ref":
        name = schema["ref"]
        return name in above or recursive((modules or {})[name], modules, above | {name})
    nested = [*schema.get("head", []), *schema.get("tail", []), *schema.get("types", []), *(f["value"] for f in schema.get("keys", []))]
    nested += [schema["type"]] if "type" in schema else []
    nested += [schema["value"]] if schema["kind"] == "map" else []
    return any(recursive(s, modules, above) for s in nested)


def validator(v: Column, schema: dict, modules: dict[str, dict] | None = None) -> Column:
    """Code of the first error of a VARIANT under a schema; NULL if it is valid.

    Schemas that lead back to themselves have no finite expression; their values are checked
    in Arrow batches, to any depth.
    """
    if recursive(schema, modules):
        return faults(F.to_json(v), schema, modules)["code"]
    return _validator(v, schema, modules)


def faults(text: Column, schema: dict, modules: dict[str, dict] | None = None) -> Column:
    """The first error of JSON texts: code, message and the path to it as a JSON Pointer; NULL fields if valid."""

    @arrow("struct<code:string,message:string,path:string>")
    def run(own: pd.Series) -> pd.DataFrame:
        def one(raw):
            fault = None if raw is None else first_error(json.loads(raw), schema, modules)
            if fault is None:
                return (None, None, None)
            return fault[0], MESSAGES[fault[0]], "".join("/" + str(k).replace("~", "~0").replace("/", "~1") for k in fault[1])

        return pd.DataFrame([one(raw) for raw in own], columns=["code", "message", "path"])

    return run(text)


Fault = tuple[str, list]


def first_error(value, schema: dict, modules: dict[str, dict] | None = None, path: tuple = ()) -> Fault | None:
    """(code, path) of the first error of a JSON value under a schema; None if it is valid."""
    kind = schema["kind"]
    fault: Callable[[str], Fault] = lambda code: (code, list(path))
    inside = lambda v, s, *steps: first_error(v, s, modules, (*path, *steps))
    found: Fault | None = None
    if kind == "con":
        found = None if _alike(value, schema["value"]) else fault("CONST")
    elif kind == "enum":
        found = None if any(_alike(value, v) for v in schema["values"]) else fault("ENUM")
    elif kind == "bool":
        found = None if isinstance(value, bool) else fault("BOOL")
    elif kind == "num":
        code = _number_error(value, schema)
        found = fault(code) if code else None
    elif kind == "str":
        plain = isinstance(value, str) and (value.isascii() or not (schema.get("ascii") or schema.get("format") == "ascii"))
        found = (None if _fits(len(value), schema) else fault("STR_LEN")) if plain else fault("STR")
    elif kind == "bin":
        bytes_like = isinstance(value, list) and all(type(b) in (int, float) and 0 <= b <= 255 for b in value)
        found = (None if _fits(len(value), schema) else fault("BIN_LEN")) if bytes_like else fault("BIN")
    elif kind == "map":
        found = fault("MAP") if not isinstance(value, dict) else next((e for k, v in value.items() if (e := inside(v, schema["value"], k))), None)
    elif kind == "ref":
        found = fault("REF") if inside(value, (modules or {})[schema["ref"]]) else None
    elif kind == "or":
        found = fault("OR") if all(inside(value, s) for s in schema["types"]) else None
    elif kind == "arr":
        found = _array_error(value, schema, fault, inside)
    elif kind == "obj":
        found = _object_error(value, schema, fault, inside)
    if found is None and "check" in schema and not schema["check"](value):
        return fault("VALIDATION")
    return found


def _alike(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_alike, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_alike(v, b[k]) for k, v in a.items())
    return a == b


def _fits(size: int, schema: dict) -> bool:
    return schema.get("min", 0) <= size <= schema.get("max", float("inf"))


def _number_error(n, schema: dict) -> str | None:
    form = schema.get("format", "f64")
    if isinstance(n, bool) or not isinstance(n, (int, float)):
        return "NUM"
    whole = {"i": "INT", "u": "UINT"}.get(form[0])
    low, high = RANGES.get(form, (0 if form[0] == "u" else -float("inf"), float("inf")))
    if whole and (n != n // 1 or not low <= n <= high):
        return whole
    tests = (("gt", "GT", lambda x: n <= x), ("gte", "GTE", lambda x: n < x), ("lt", "LT", lambda x: n >= x), ("lte", "LTE", lambda x: n > x))
    return next((code for key, code, bad in tests if key in schema and bad(schema[key])), None)


def _array_error(value, schema: dict, fault: Callable, inside: Callable) -> Fault | None:
    if not isinstance(value, list):
        return fault("ARR")
    head, tail = schema.get("head", []), schema.get("tail", [])
    body = len(value) - len(head) - len(tail)
    if body < 0 or body and "type" not in schema:
        return fault("TUP")
    if any(inside(value[k], s, k) for k, s in enumerate(head)):
        return fault("TUP")
    if "type" in schema:
        if not _fits(body, schema):
            return fault("ARR_LEN")
        found = next((e for k in range(len(head), len(head) + body) if (e := inside(value[k], schema["type"], k))), None)
        if found:
            return found
    return fault("TUP") if any(inside(value[k - len(tail)], s, len(value) + k - len(tail)) for k, s in enumerate(tail)) else None


def _object_error(value, schema: dict, fault: Callable, inside: Callable) -> Fault | None:
    if not isinstance(value, dict):
        return fault("OBJ")
    fields = schema.get("keys", [])
    if not schema.get("unknown", schema.get("decodeUnknownKeys", False)) and value.keys() - {f["key"] for f in fields}:
        return fault("KEYS")
    for f in fields:
        if f["key"] not in value:
            if not f.get("optional"):
                return fault("KEY")
        elif found := inside(value[f["key"]], f["value"], f["key"]):
            return found
    return None


def _validator(v: Column, schema: dict, modules: dict[str, dict] | None) -> Column:
    kind = schema["kind"]
    build: dict[str, Callable[[], Column]] = {
        "any": lambda: F.lit(None).cast("string"),
        "con": lambda: _fails("CONST", canonical(Val(v, "json")) != canonical(literal(schema["value"]))),
        "enum": lambda: _fails("ENUM", ~F.greatest(F.lit(False), *[canonical(Val(v, "json")) == canonical(literal(x)) for x in schema["values"]])),
        "bool": lambda: _fails("BOOL", ~is_tag(v, "BOOLEAN")),
        "num": lambda: _number(v, schema),
        "str": lambda: _string(v, schema),
        "bin": lambda: _binary(v, schema),
        "arr": lambda: _array(v, schema, modules),
        "obj": lambda: _object(v, schema, modules),
        "map": lambda: _first(_fails("MAP", ~is_tag(v, "OBJECT")), F.get(_each(F.map_values(members(Val(v, "json")).col), schema["value"], modules), F.lit(0))),
        "ref": lambda: _fails("REF", validator(v, (modules or {})[schema["ref"]], modules).isNotNull()),
        "or": lambda: _fails("OR", ~F.greatest(F.lit(False), *[validator(v, s, modules).isNull() for s in schema["types"]])),
    }
    own = build[kind]()
    return _first(own, _fails("VALIDATION", ~schema["test"](v))) if "test" in schema else own


def _number(v: Column, schema: dict) -> Column:
    n = F.when(is_tag(v, *NUMBER_TAGS), F.try_variant_get(v, "$", "double"))
    form = schema.get("format", "f64")
    checks = [_fails("NUM", n.isNull())]
    if form[0] in "iu":
        checks.append(_fails("INT" if form[0] == "i" else "UINT", n != F.floor(n)))
        if form[0] == "u":
            checks.append(_fails("UINT", n < 0))
    if form in RANGES:
        low, high = RANGES[form]
        checks.append(_fails("INT" if form[0] == "i" else "UINT", ~n.between(float(low), float(high))))
    for key, code, bad in (("gt", "GT", lambda x: n <= x), ("gte", "GTE", lambda x: n < x), ("lt", "LT", lambda x: n >= x), ("lte", "LTE", lambda x: n > x)):
        if key in schema:
            checks.append(_fails(code, bad(float(schema[key]))))
    return _first(*checks)


def _string(v: Column, schema: dict) -> Column:
    s = F.when(is_tag(v, "STRING"), F.try_variant_get(v, "$", "string"))
    checks = [_fails("STR", s.isNull())]
    if schema.get("ascii") or schema.get("format") == "ascii":
        checks.append(_fails("STR", ~s.rlike(r"^[\x00-\x7F]*$")))
    return _first(*checks, *_length(F.char_length(s), schema, "STR_LEN"))


def _length(size: Column, schema: dict, code: str) -> list[Column]:
    tests = {"min": lambda n: size < n, "max": lambda n: size > n}
    return [_fails(code, test(schema[k])) for k, test in tests.items() if k in schema]


def _binary(v: Column, schema: dict) -> Column:
    items = elements(Val(v, "json")).col
    byte = F.forall(items, lambda x: is_tag(x, *NUMBER_TAGS) & F.coalesce(F.try_variant_get(x, "$", "double").between(0, 255), F.lit(False)))
    return _first(_fails("BIN", ~byte), *_length(F.size(items), schema, "BIN_LEN"))


def _each(items: Column, schema: dict, modules) -> Column:
    """The errors among items, in order."""
    return F.filter(F.transform(items, lambda x: validator(x, schema, modules)), lambda e: e.isNotNull())


def _array(v: Column, schema: dict, modules) -> Column:
    items = elements(Val(v, "json")).col
    head, tail = schema.get("head", []), schema.get("tail", [])
    fixed, size = len(head) + len(tail), F.size(items)
    checks = [_fails("ARR", items.isNull())]
    if fixed:
        checks.append(_fails("TUP", size < fixed if "type" in schema else size != fixed))
    checks += [F.when(validator(F.get(items, F.lit(k)), s, modules).isNotNull(), F.lit("TUP")) for k, s in enumerate(head)]
    if "type" in schema:
        body = F.slice(items, F.lit(len(head) + 1), F.greatest(size - fixed, F.lit(0)))
        checks += _length(F.size(body), schema, "ARR_LEN")
        checks.append(F.get(_each(body, schema["type"], modules), F.lit(0)))
    checks += [F.when(validator(F.get(items, size - len(tail) + k), s, modules).isNotNull(), F.lit("TUP")) for k, s in enumerate(tail)]
    return _first(*checks)


def _object(v: Column, schema: dict, modules) -> Column:
    own = members(Val(v, "json")).col
    fields = schema.get("keys", [])
    checks = [_fails("OBJ", own.isNull())]
    if not schema.get("unknown", False):
        names = F.array(*[F.lit(f["key"]) for f in fields]) if fields else F.array().cast("array<string>")
        checks.append(_fails("KEYS", F.size(F.array_except(F.map_keys(own), names)) > 0))
    for f in fields:
        there = F.coalesce(F.map_contains_key(own, F.lit(f["key"])), F.lit(False))
        fault = validator(F.try_element_at(own, F.lit(f["key"])), f["value"], modules)
        missing = F.lit(None).cast("string") if f.get("optional") else F.lit("KEY")
        checks.append(F.when(there, fault).otherwise(missing))
    return _first(*checks)


def discriminator(v: Column, schema: dict, modules: dict[str, dict] | None = None) -> Column:
    """Index of the first branch of an ``or`` schema that a VARIANT satisfies, or -1."""
    out = F.lit(-1)
    for k in range(len(schema["types"]) - 1, -1, -1):
        out = F.when(validator(v, schema["types"][k], modules).isNull(), F.lit(k)).otherwise(out)
    return out


def to_json_schema(schema: dict) -> dict:
    kind = schema["kind"]
    if kind == "con":
        return {"const": schema["value"]}
    if kind == "num":
        whole = schema.get("format", "f64")[0] in "iu"
        names = {"gt": "exclusiveMinimum", "gte": "minimum", "lt": "exclusiveMaximum", "lte": "maximum"}
        return {"type": "integer" if whole else "number", **{names[k]: schema[k] for k in names if k in schema}}
    if kind == "str":
        return {"type": "string", **{n: schema[k] for k, n in (("min", "minLength"), ("max", "maxLength")) if k in schema}}
    if kind == "arr":
        own: dict = {"type": "array"}
        if schema.get("head"):
            own["prefixItems"] = [to_json_schema(s) for s in schema["head"]]
        own["items"] = to_json_schema(schema["type"]) if "type" in schema else False
        return own | {n: schema[k] for k, n in (("min", "minItems"), ("max", "maxItems")) if k in schema}
    if kind == "obj":
        fields = schema.get("keys", [])
        required = [f["key"] for f in fields if not f.get("optional")]
        own = {"type": "object", "properties": {f["key"]: to_json_schema(f["value"]) for f in fields}}
        return own | ({"required": required} if required else {}) | ({} if schema.get("unknown") else {"additionalProperties": False})
    if kind == "map":
        return {"type": "object", "patternProperties": {".*": to_json_schema(schema["value"])}}
    return {"any": lambda: {}, "bool": lambda: {"type": "boolean"}, "bin": lambda: {"type": "binary"}, "ref": lambda: {"$ref": f"#/$defs/{schema['ref']}"}, "or": lambda: {"anyOf": [to_json_schema(s) for s in schema["types"]]}}[kind]()


def to_jtd(schema: dict) -> dict:
    """JSON Type Definition (RFC 8927) form."""
    kind = schema["kind"]
    if kind == "num":
        names = {"i8": "int8", "i16": "int16", "i32": "int32", "u8": "uint8", "u16": "uint16", "u32": "uint32", "f32": "float32"}
        return {"type": names.get(schema.get("format", "f64"), "float64")}
    if kind == "arr" and "type" in schema:
        return {"elements": to_jtd(schema["type"])}
    if kind == "map":
        return {"values": to_jtd(schema["value"])}
    if kind == "ref":
        return {"ref": schema["ref"]}
    if kind == "obj":
        must = {f["key"]: to_jtd(f["value"]) for f in schema.get("keys", []) if not f.get("optional")}
        may = {f["key"]: to_jtd(f["value"]) for f in schema.get("keys", []) if f.get("optional")}
        return ({"properties": must} if must or not may else {}) | ({"optionalProperties": may} if may else {}) | ({"additionalProperties": True} if schema.get("unknown") else {})
    return {"bool": {"type": "boolean"}, "str": {"type": "string"}}.get(kind, {})


def to_typescript(schema: dict) -> str:
    kind = schema["kind"]
    if kind == "con":
        import json

        return json.dumps(schema["value"])
    if kind == "arr":
        parts = [to_typescript(s) for s in schema.get("head", [])]
        if "type" in schema:
            inner = to_typescript(schema["type"])
            if not parts and not schema.get("tail"):
                return f"Array<{inner}>"
            parts.append(f"...{inner}[]")
        return "[" + ", ".join([*parts, *(to_typescript(s) for s in schema.get("tail", []))]) + "]"
    if kind == "obj":
        return "{ " + "; ".join(f"{f['key']}{'?' if f.get('optional') else ''}: {to_typescript(f['value'])}" for f in schema.get("keys", [])) + " }"
    if kind == "map":
        return f"Record<string, {to_typescript(schema['value'])}>"
    if kind == "or":
        return " | ".join(to_typescript(s) for s in schema["types"])
    return {"any": "unknown", "bool": "boolean", "num": "number", "str": "string", "bin": "Uint8Array", "ref": schema.get("ref", "")}[kind]
