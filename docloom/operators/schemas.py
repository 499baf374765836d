"""Schemas as data: builders, object algebra, modules, walks, values and encoders by type.

Schemas are the dicts of ``types``; this module makes, combines and uses them when a plan is
built. Functions of whole columns (``encode_typed``, ``random_value``) are Columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrow import arrow
from docloom.operators import types
from docloom.sources import codecs

Schema = dict


class SchemaBuilder:
    """Constructors of schemas."""

    def any(self, **options) -> Schema:
        return {"kind": "any", **options}

    def const(self, value, **options) -> Schema:
        return {"kind": "con", "value": value, **options}

    def nil(self) -> Schema:
        return self.const(None)

    undef = nil

    def bool(self, **options) -> Schema:
        return {"kind": "bool", **options}

    def num(self, **options) -> Schema:
        return {"kind": "num", **options}

    def str(self, **options) -> Schema:
        return {"kind": "str", **options}

    def bin(self, item: Schema | None = None, **options) -> Schema:
        return {"kind": "bin", "type": item or self.any(), **options}

    def arr(self, item: Schema | None = None, **options) -> Schema:
        return {"kind": "arr", "type": item or self.any(), **options}

    def tuple(self, *head: Schema, body: Schema | None = None, tail: list[Schema] | None = None) -> Schema:
        return {"kind": "arr", "head": list(head), **({"type": body} if body else {}), **({"tail": tail} if tail else {})}

    def key(self, name, value: Schema, **options) -> Schema:
        return {"kind": "key", "key": name, "value": value, **options}

    def key_opt(self, name, value: Schema, **options) -> Schema:
        return self.key(name, value, optional=True, **options)

    def obj(self, *keys: Schema, **options) -> Schema:
        return {"kind": "obj", "keys": list(keys), **options}

    def object(self, fields: dict, **options) -> Schema:
        """An object of required fields by name."""
        return self.obj(*(self.key(k, v) for k, v in fields.items()), **options)

    def map(self, value: Schema | None = None, key: Schema | None = None, **options) -> Schema:
        return {"kind": "map", "value": value or self.any(), **({"key": key} if key else {}), **options}

    def ref(self, name) -> Schema:
        return {"kind": "ref", "ref": name}

    def union(self, *options: Schema) -> Schema:
        return {"kind": "or", "types": list(options)}

    def enum(self, *values) -> Schema:
        """One of some constants; others are ENUM errors."""
        return {"kind": "enum", "values": list(values)}

    def maybe(self, own: Schema) -> Schema:
        return self.union(own, self.nil())

    def function(self, request: Schema | None = None, response: Schema | None = None) -> Schema:
        return {"kind": "fn", "req": request or self.any(), "res": response or self.any()}

    def function_streaming(self, request: Schema | None = None, response: Schema | None = None) -> Schema:
        return {**self.function(request, response), "kind": "fn$"}

    def alias(self, name, value: Schema) -> Schema:
        return {"kind": "alias", "key": name, "value": value}

    def module(self, *aliases: Schema) -> Schema:
        return {"kind": "module", "keys": list(aliases)}

    def from_value(self, value) -> Schema:
        return types.from_value(value)

    def import_schema(self, schema: Schema) -> Schema:
        """A schema of its own: checked, copied, and aliases replaced by what they name."""
        types.check(schema)
        return self.import_schema(schema["value"]) if schema["kind"] == "alias" else json.loads(json.dumps(schema))


S = SchemaBuilder()


def parts(schema: Schema) -> list[Schema]:
    """A schema's direct parts in order; keys of objects count by their values."""
    kind = schema["kind"]
    if kind == "arr":
        return [*schema.get("head", []), *([schema["type"]] if "type" in schema else []), *schema.get("tail", [])]
    if kind in ("obj", "module"):
        return [k["value"] for k in schema.get("keys", [])]
    if kind == "map":
        return [schema["value"], *([schema["key"]] if "key" in schema else [])]
    if kind == "or":
        return schema["types"]
    if kind in ("fn", "fn$"):
        return [schema["req"], schema["res"]]
    return [schema["value"]] if kind in ("key", "alias") else []


def walk(schema: Schema) -> Iterator[Schema]:
    """Every schema node before its parts."""
    yield schema
    for part in parts(schema):
        yield from walk(part)


# -- objects


def prop(schema: Schema, name: str, value: Schema) -> Schema:
    return {**schema, "keys": [*schema.get("keys", []), S.key(name, value)]}


def opt(schema: Schema, name: str, value: Schema) -> Schema:
    return {**schema, "keys": [*schema.get("keys", []), S.key_opt(name, value)]}


def extend(schema: Schema, other: Schema) -> Schema:
    return {**schema, "keys": [*schema.get("keys", []), *other.get("keys", [])]}


def omit(schema: Schema, name: str) -> Schema:
    return {**schema, "keys": [k for k in schema.get("keys", []) if k["key"] != name]}


def get_field(schema: Schema, name: str) -> Schema | None:
    return next((k for k in schema.get("keys", []) if k["key"] == name), None)


class Module:
    """Named schemas; the first of equal names stays. ``known`` is what validators take as modules."""

    def __init__(self, schema: Schema | None = None) -> None:
        self.known: dict[str, Schema] = {}
        if schema:
            self.import_module(schema)

    def alias(self, name: str, schema: Schema) -> Schema:
        return self.known.setdefault(name, schema)

    def has_alias(self, name: str) -> bool:
        return name in self.known

    def unalias(self, name: str) -> Schema:
        if name not in self.known:
            raise types.SchemaError(f"Alias not found: {name}")
        return self.known[name]

    def resolve(self, name: str) -> Schema:
        """What a name stands for, through names that stand for names."""
        seen, own = {name}, self.unalias(name)
        while own["kind"] == "ref":
            if own["ref"] in seen:
                raise types.SchemaError(f"{name} names itself")
            seen.add(own["ref"])
            own = self.unalias(own["ref"])
        return own

    def import_module(self, schema: Schema) -> None:
        """Register a module's aliases, objects with the fields of those they extend."""
        own = {k["key"]: k["value"] for k in schema["keys"]}

        def whole(value: Schema) -> Schema:
            if value["kind"] != "obj" or not value.get("extends"):
                return value
            fields: dict[str, Schema] = {}
            for parent in value["extends"]:
                if own.get(parent, {}).get("kind") == "obj":
                    fields |= {k["key"]: k for k in whole(own[parent])["keys"]}
            fields |= {k["key"]: k for k in value["keys"]}
            return {**{k: v for k, v in value.items() if k != "extends"}, "keys": list(fields.values())}

        for name, value in own.items():
            self.alias(name, whole(value))

    def import_types(self, named: dict[str, Schema]) -> None:
        for name, schema in named.items():
            self.alias(name, schema)

    def export_types(self) -> dict[str, Schema]:
        return dict(self.known)


def metaschema() -> Schema:
    """The module that describes schemas in their own language."""
    text, number, flag, anything = S.str(), S.num(), S.bool(), S.any()
    schema, some = S.ref("Schema"), S.arr(S.ref("Schema"))
    kinds = {
        "Any": {},
        "Con": {"value!": anything},
        "Bool": {},
        "Num": {"format": text, "gt": number, "gte": number, "lt": number, "lte": number},
        "Str": {"format": text, "ascii": flag, "min": number, "max": number},
        "Bin": {"type!": schema, "format": text, "min": number, "max": number},
        "Arr": {"type": schema, "head": some, "tail": some, "min": number, "max": number},
        "Key": {"key!": text, "value!": schema, "optional": flag},
        "Obj": {"keys!": S.arr(S.ref("KeySchema")), "extends": S.arr(text), "decodeUnknownKeys": flag, "encodeUnknownKeys": flag},
        "Map": {"key": schema, "value!": schema},
        "Ref": {"ref!": text},
        "Or": {"types!": some, "discriminator": anything},
        "Fn": {"req!": schema, "res!": schema},
        "FnRx": {"req!": schema, "res!": schema},
        "Alias": {"key!": text, "value!": schema, "pub": flag},
        "Module": {"keys!": S.arr(S.ref("AliasSchema"))},
    }
    names = {"FnRx": "fn$"}

    def fields(own: dict[str, Schema]) -> list[Schema]:
        return [S.key(k[:-1], v) if k.endswith("!") else S.key_opt(k, v) for k, v in own.items()]

    display = S.obj(*fields({"title": text, "intro": text, "description": text}))
    base = S.obj(*fields({"meta": S.map(), "default": anything, "examples": S.arr(S.ref("SchemaExample")), "deprecated": S.object({}, unknown=True), "metadata": S.map()}), extends=["Display"])
    own = [S.alias(f"{k}Schema", S.obj(S.key("kind", S.const(names.get(k, k.lower()))), *fields(v), extends=["SchemaBase"])) for k, v in kinds.items()]
    json_kinds = [f"{k}Schema" for k in kinds if k not in ("Key", "Fn", "FnRx", "Alias", "Module")]
    return S.module(
        S.alias("Display", display),
        S.alias("SchemaExample", S.obj(S.key("value", anything), extends=["Display"])),
        S.alias("SchemaBase", base),
        *own,
        S.alias("JsonSchema", S.union(*(S.ref(k) for k in json_kinds))),
        S.alias("Schema", S.union(S.ref("JsonSchema"), *(S.ref(f"{k}Schema") for k in kinds if f"{k}Schema" not in json_kinds))),
    )


# -- values of types


class Typed:
    """A value with its schema and, for references, the module that names them."""

    def __init__(self, schema: Schema, value, module: Module | None = None):
        self.schema, self.value, self.module = schema, value, module

    def fault(self) -> tuple[str, list] | None:
        return types.first_error(self.value, self.schema, self.module.known if self.module else None)

    def field(self, name: str) -> Typed:
        """A field of an object value."""
        own = get_field(self.schema, name)
        if own is None:
            raise KeyError(name)
        return Typed(own["value"], self.value.get(name), self.module)


class TypedFunction(Typed):
    """A callable with a function schema; calls check the request and the response."""

    def __call__(self, request):
        modules = self.module.known if self.module else None
        for own, value in ((self.schema["req"], request), (self.schema["res"], None)):
            if own is self.schema["res"]:
                value = self.value(request)
            fault = types.first_error(value, own, modules)
            if fault:
                raise ValueError(types.message(fault[0]))
        return value


def project(schema: Schema, value, modules: dict[str, Schema] | None = None):
    """The value as its type's encoder writes it: fields in the schema's order, unknown ones last or left out."""
    kind = schema["kind"]
    if kind == "ref":
        return project((modules or {})[schema["ref"]], value, modules)
    if kind == "obj":
        own = {f["key"]: project(f["value"], value[f["key"]], modules) for f in schema.get("keys", []) if f["key"] in value}
        return own | ({k: v for k, v in value.items() if k not in own} if schema.get("encodeUnknownKeys", schema.get("unknown")) else {})
    if kind == "map":
        return {k: project(schema["value"], v, modules) for k, v in value.items()}
    if kind == "arr":
        head, tail = schema.get("head", []), schema.get("tail", [])
        body = [schema.get("type", {"kind": "any"})] * (len(value) - len(head) - len(tail))
        return [project(s, v, modules) for s, v in zip([*head, *body, *tail], value, strict=True)]
    if kind == "or":
        own = next((s for s in schema["types"] if types.first_error(value, s, modules) is None), {"kind": "any"})
        return project(own, value, modules)
    return schema["value"] if kind == "con" else value


def encode_typed(text: Column, schema: Schema, codec: str = "json", modules: dict[str, Schema] | None = None) -> Column:
    """JSON texts encoded by their type, in one Arrow pass: ``json`` text, or ``cbor`` or ``msgpack`` bytes; NULL for values of another type."""
    write: Callable = {"json": lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False), "cbor": codecs.cbor_encode, "msgpack": codecs.msgpack_encode}[codec]

    @arrow("string" if codec == "json" else "binary")
    def run(own: pd.Series) -> pd.Series:
        def one(raw):
            value = None if raw is None else json.loads(raw)
            return None if raw is None or types.first_error(value, schema, modules) else write(project(schema, value, modules))

        return own.map(one)

    return run(text)


def capacity(schema: Schema, modules: dict[str, Schema] | None = None) -> int | None:
    """Upper bound of the encoded size of a type's values; None where they have none."""
    kind = schema["kind"]
    fixed = {"bool": 5, "num": 22}
    if kind in fixed:
        return fixed[kind]
    if kind in ("con", "enum"):
        from docloom.functions.json_utils import max_capacity

        return max(map(max_capacity, schema["values"] if kind == "enum" else [schema["value"]]))
    if kind == "str":
        return 5 + 5 * schema["max"] if "max" in schema else None
    if kind == "bin":
        return 41 + 2 * schema["max"] if "max" in schema else None
    if kind == "obj":
        own = [(len(f["key"]), capacity(f["value"], modules)) for f in schema.get("keys", [])]
        return None if schema.get("unknown") or any(n is None for _, n in own) else 5 + sum(2 + 5 + 5 * k + n for k, n in own)
    if kind == "arr":
        fixed_parts = [capacity(s, modules) for s in [*schema.get("head", []), *schema.get("tail", [])]]
        body = 0 if "type" not in schema else None if "max" not in schema else (n := capacity(schema["type"], modules)) and schema["max"] * (1 + n)
        return None if body is None or None in fixed_parts else 5 + body + sum(1 + n for n in fixed_parts)
    if kind == "or":
        own = [capacity(s, modules) for s in schema["types"]]
        return None if None in own else max(own)
    return None


def random_value(key: Column, schema: Schema, seed: int = 0, modules: dict[str, Schema] | None = None, depth: int = 4) -> Column:
    """JSON text of a value of a type, drawn from the row's key: the same in every run.

    References are followed to ``depth``; behind it a null stands.
    """

    @arrow("string")
    def run(keys: pd.Series) -> pd.Series:
        import random

        return keys.map(lambda k: json.dumps(draw(random.Random(f"{seed}:{k}"), schema, modules, depth), separators=(",", ":"), ensure_ascii=False))

    return run(key)


def draw(own, schema: Schema, modules: dict[str, Schema] | None = None, depth: int = 4):
    """A value of a type from a source of random numbers."""
    kind = schema["kind"]
    if kind == "con":
        return schema["value"]
    if kind == "enum":
        return own.choice(schema["values"])
    if kind == "bool":
        return own.random() < 0.5
    if kind == "num":
        form = schema.get("format", "f64")
        low, high = types.RANGES.get(form, (0 if form[0] == "u" else -500_000, 500_000))
        low = max([low, *([schema["gte"]] if "gte" in schema else []), *([schema["gt"]] if "gt" in schema else [])]) if "gt" in schema or "gte" in schema else low
        high = min(high, schema.get("lte", high), schema.get("lt", high)) if high >= low or "lt" in schema or "lte" in schema else low + 1_000_000
        if form[0] in "iu" or low == int(low) and high == int(high) and high - low >= 2:
            return own.randint(int(low) + ("gt" in schema), int(high) - ("lt" in schema))
        inside = own.uniform(0.01, 0.99) if "gt" in schema or "lt" in schema else own.random()
        return low + (high - low) * inside
    if kind in ("str", "bin", "arr", "map"):
        low = schema.get("min", 0)
        n = own.randint(low, max(low, schema.get("max", low + (16 if kind == "str" else 4))))
    if kind == "str":
        return "".join(chr(own.randint(32, 126)) for _ in range(n))
    if kind == "bin":
        return [own.randint(0, 255) for _ in range(n)]
    if kind == "arr":
        body = [schema["type"]] * n if "type" in schema else []
        return [draw(own, s, modules, depth) for s in [*schema.get("head", []), *body, *schema.get("tail", [])]]
    if kind == "map":
        return {f"k{k}": draw(own, schema["value"], modules, depth) for k in range(n)}
    if kind == "obj":
        return {f["key"]: draw(own, f["value"], modules, depth) for f in schema.get("keys", []) if not f.get("optional") or own.random() < 0.5}
    if kind == "or":
        return draw(own, own.choice(schema["types"]), modules, depth)
    if kind == "ref":
        return draw(own, (modules or {})[schema["ref"]], modules, depth - 1) if depth > 0 and schema["ref"] in (modules or {}) else None
    return own.choice([None, True, own.randint(0, 99), "any", [1, "a"], {"k": 1}])


def discriminator_expression(schemas: list[Schema]) -> object:
    """A JSON expression whose value is the index of the branch of a union that an input belongs to.

    Branches are told apart by a constant, else by their JSON type; two alike are an error.
    """

    def constant(own: Schema, path: str) -> tuple[str, object] | None:
        if own["kind"] == "con":
            return path, own["value"]
        if own["kind"] == "arr":
            inner = enumerate(own.get("head", []))
        else:
            inner = ((f["key"].replace("~", "~0").replace("/", "~1"), f["value"]) for f in own.get("keys", []) if not f.get("optional")) if own["kind"] == "obj" else ()
        return next((found for k, s in inner if (found := constant(s, f"{path}/{k}"))), None)

    def flat(own: Schema) -> list[Schema]:
        return [t for s in own["types"] for t in flat(s)] if own["kind"] == "or" else [own]

    names = {"bool": "boolean", "num": "number", "str": "string", "arr": "array", "obj": "object", "map": "object", "bin": "binary"}
    out: object = 0
    seen = set()
    for k, own in enumerate([t for s in schemas for t in flat(s)]):
        if not k:
            continue
        found = constant(own, "")
        mark = json.dumps(found if found else names.get(own["kind"], own["kind"]))
        if mark in seen:
            raise types.SchemaError(f"Duplicate discriminator: {mark}")
        seen.add(mark)
        if found:
            test = ["==", found[1], ["$", found[0], "" if found[1] is None else None]]
        elif own["kind"] in names:
            test = ["==", ["type", ["$", ""]], names[own["kind"]]]
        else:
            raise types.SchemaError(f"no discriminator for {own['kind']}")
        out = ["?", test, k, out]
    return out
