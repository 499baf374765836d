"""Array-encoded JSON expressions compiled to Columns.

An expression ``[operator, operand, ...]`` is compiled once, when the plan is built; what
reaches Spark is a Column tree, which Catalyst folds, prunes and generates code for. A
non-array is a literal, ``[x]`` the literal x and ``[]`` the empty array.

Strict mode raises where the language has an error; permissive mode, the default, yields
NULL, as undefined does at the JSON boundary.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import formats
from docloom.functions.pointer import parse_pointer
from docloom.functions.values import NUMBER_TAGS, NUMBERS, Val, canonical, elements, finite, is_tag, literal, members, num, of_type, tag, text, to_variant, truthy


class ExpressionError(ValueError):
    """An expression that cannot be compiled."""


@dataclass
class Context:
    """Variables in scope; the empty name is the row."""

    variables: dict[str, Val] = field(default_factory=dict)
    strict: bool = False
    operators: dict[str, Operator] = field(default_factory=dict)

    def bind(self, name: str, value: Val) -> Context:
        return Context({**self.variables, name: value}, self.strict, self.operators)

    def fail(self, message: str) -> Column:
        return F.raise_error(F.lit(message)) if self.strict else F.lit(None)


@dataclass(frozen=True)
class Operator:
    name: str
    aliases: tuple[str, ...]
    low: int
    high: int | None
    build: Callable[[list, Context], Val]
    raw: bool = False  # operands reach ``build`` uncompiled


REGISTRY: dict[str, Operator] = {}


def operator(name: str, low: int, high: int | None = None, *aliases: str, raw: bool = False):
    """Register a builder; ``high`` None is unbounded."""

    def add(build):
        own = Operator(name, aliases, low, high, build, raw)
        for key in (name, *aliases):
            REGISTRY[key] = own
        return build

    return add


def compile_value(expression, context: Context) -> Val:
    if not isinstance(expression, list):
        return literal(expression)
    if not expression:
        return Val(F.array().cast("array<variant>"), "arr", T.ArrayType(T.VariantType()))
    if len(expression) == 1:
        return literal(expression[0])
    name, *operands = expression
    own = (context.operators.get(name) or REGISTRY.get(name)) if isinstance(name, str) else None
    if own is None:
        raise ExpressionError(f"Unknown expression: {name!r}")
    if len(operands) < own.low or own.high is not None and len(operands) > own.high:
        need = f"{own.low}" if own.high == own.low else f"{own.low} to {own.high}" if own.high else f"at least {own.low}"
        raise ExpressionError(f"Operator {name!r} takes {need} operands, got {len(operands)}")
    return own.build(operands if own.raw else [compile_value(o, context) for o in operands], context)


def row_context(df: DataFrame, json_columns: tuple[str, ...] = (), strict: bool = False) -> Context:
    """The row as the environment; ``json_columns`` are JSON text to be parsed."""
    fields = [f for f in df.schema.fields]
    parsed = [F.try_parse_json(F.col(f.name)).alias(f.name) if f.name in json_columns else F.col(f.name) for f in fields]
    kind = T.StructType([T.StructField(f.name, T.VariantType() if f.name in json_columns else f.dataType) for f in fields])
    row = Row({f.name: of_type(c, k.dataType) for f, c, k in zip(fields, parsed, kind.fields, strict=True)}, kind)
    return Context({"": row}, strict)


class Row(Val):
    """The row itself: its fields are the columns, so that unused ones are pruned."""

    def __init__(self, fields: dict[str, Val], kind: T.StructType):
        super().__init__(F.struct(*[v.col.alias(k) for k, v in fields.items()]), "obj", kind)
        object.__setattr__(self, "fields", fields)


def compile_expression(expression, df: DataFrame, json_columns: tuple[str, ...] = (), strict: bool = False, operators: dict[str, Operator] | None = None) -> Column:
    """The expression over the rows of ``df`` as a Column."""
    context = row_context(df, json_columns, strict)
    context.operators = operators or {}
    return compile_value(expression, context).col


def compile_predicate(expression, df: DataFrame, json_columns: tuple[str, ...] = ()) -> Column:
    """Truthiness of the expression, for ``where``."""
    return truthy(compile_value(expression, row_context(df, json_columns)))


def _number(c: Column, kind: T.DataType | None = None) -> Val:
    return Val(c, "num", kind or T.DoubleType())


# -- arithmetic


def _fold(name: str, *aliases: str):
    def add(step):
        operator(name, 2, None, *aliases)(lambda o, ctx: _number(reduce(lambda a, b: step(a, b, ctx), [num(v) for v in o])))

    return add


_fold("+", "add")(lambda a, b, _: a + b)
_fold("-", "subtract")(lambda a, b, _: a - b)
_fold("*", "multiply")(lambda a, b, _: a * b)
_fold("/", "divide")(lambda a, b, ctx: F.when(b == 0, ctx.fail("DIVISION_BY_ZERO")).otherwise(F.coalesce(finite(a / F.when(b != 0, b)), F.lit(0.0))))
_fold("%", "mod")(lambda a, b, ctx: F.when(b == 0, ctx.fail("DIVISION_BY_ZERO")).otherwise(a % F.when(b != 0, b)))
operator("min", 2)(lambda o, _: _number(F.least(*[num(v) for v in o])))
operator("max", 2)(lambda o, _: _number(F.greatest(*[num(v) for v in o])))


def _away(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c) + 0.5).cast("double")


for _name, _step in {
    "round": _away,
    "ceil": lambda c: F.ceil(c).cast("double"),
    "floor": lambda c: F.floor(c).cast("double"),
    "trunc": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double"),
    "abs": F.abs,
    "sqrt": lambda c: finite(F.sqrt(c)),
    "exp": lambda c: finite(F.exp(c)),
    "ln": F.ln,
    "log10": F.log10,
}.items():
    operator(_name, 1, 1)(lambda o, _, step=_step: _number(step(num(o[0]))))
operator("log", 2, 2)(lambda o, _: _number(finite(F.ln(num(o[0])) / F.nullif(F.ln(num(o[1])), F.lit(0.0)))))
operator("**", 2, 2, "pow")(lambda o, _: _number(finite(F.pow(num(o[0]), num(o[1])))))

# -- comparison


def _is_number(v: Val) -> Column:
    if v.kind == "json":
        return is_tag(v.col, *NUMBER_TAGS)
    return F.lit(v.kind == "num")


def _compare(a: Val, b: Val, test: Callable[[Column, Column], Column]) -> Column:
    """By number if both are numbers, else by string."""
    if a.kind == b.kind == "num":
        return F.coalesce(test(a.col.cast("double"), b.col.cast("double")), F.lit(False))
    words = test(text(a), text(b))
    if "json" in (a.kind, b.kind) and {a.kind, b.kind} <= {"json", "num"}:
        return F.coalesce(F.when(_is_number(a) & _is_number(b), test(num(a), num(b))).otherwise(words), F.lit(False))
    return F.coalesce(words, F.lit(False))


def equal(a: Val, b: Val) -> Column:
    if a.kind == b.kind and a.kind in ("num", "str", "bool", "bin"):
        return a.col.eqNullSafe(b.col)
    return canonical(a) == canonical(b)


_bool = lambda c: Val(c, "bool")
operator("==", 2, 2, "eq")(lambda o, _: _bool(equal(*o)))
operator("!=", 2, 2, "ne")(lambda o, _: _bool(~equal(*o)))
_gt, _ge = (lambda a, b: a > b), (lambda a, b: a >= b)
_lt, _le = (lambda a, b: a < b), (lambda a, b: a <= b)
for _name, _alias, _test in ((">", "gt", _gt), (">=", "ge", _ge), ("<", "lt", _lt), ("<=", "le", _le)):
    operator(_name, 2, 2, _alias)(lambda o, _, test=_test: _bool(_compare(*o, test)))
operator("cmp", 2, 2)(lambda o, _: _number(F.when(_compare(*o, _gt), 1).when(_compare(*o, _lt), -1).otherwise(0), T.IntegerType()))
for _name, _aliases, _low, _high in (("=><=", ("between",), _ge, _le), ("><", (), _gt, _lt), ("=><", (), _ge, _lt), ("><=", (), _gt, _le)):
    operator(_name, 3, 3, *_aliases)(lambda o, _, low=_low, high=_high: _bool(_compare(o[0], o[1], low) & _compare(o[0], o[2], high)))

# -- logic


def _same(vals: list[Val]) -> list[Val]:
    """The values under one kind, VARIANT unless they share theirs."""
    kinds = {v.kind for v in vals if v.kind != "undef"}
    if len(kinds) <= 1 and not kinds & {"arr", "obj", "map"}:
        if kinds == {"num"}:
            long = all(isinstance(v.type, T.LongType) for v in vals if v.kind == "num")
            kind = T.LongType() if long else T.DoubleType()
            return [Val(v.col.cast(kind), "num", kind) for v in vals]
        return [Val(v.col, next(iter(kinds), "undef")) for v in vals]
    types = {v.type.simpleString() for v in vals if v.type is not None}
    if len(kinds) == 1 and len(types) == 1:
        return [Val(v.col, next(iter(kinds)), next(x.type for x in vals if x.type)) for v in vals]
    return [Val(to_variant(v), "json") for v in vals]


def _choose(o: list[Val], stops: Callable[[Val], Column]) -> Val:
    if all(v.kind == "bool" for v in o):
        step = (lambda a, b: a & b) if stops is _falsy else (lambda a, b: a | b)
        return _bool(reduce(step, [truthy(v) for v in o]))
    same = _same(o)
    out = same[-1].col
    for v, own in zip(reversed(o[:-1]), reversed(same[:-1]), strict=True):
        out = F.when(stops(v), own.col).otherwise(out)
    return Val(out, same[-1].kind, same[-1].type)


def _falsy(v: Val) -> Column:
    return ~truthy(v)


operator("&&", 2, None, "and")(lambda o, _: _choose(o, _falsy))
operator("||", 2, None, "or")(lambda o, _: _choose(o, truthy))
operator("!", 1, 1, "not")(lambda o, _: _bool(~truthy(o[0])))

# -- types

_STATIC = {"undef": "undefined", "null": "null", "bool": "boolean", "num": "number", "str": "string", "bin": "binary", "arr": "array", "obj": "object", "map": "object"}


def type_name(v: Val) -> Column:
    if v.kind != "json":
        return F.when(v.col.isNull() & F.lit(v.kind != "null"), "undefined").otherwise(_STATIC[v.kind])
    t = tag(v.col)
    found = F.when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t.isin(*NUMBER_TAGS), "number").when(t == "STRING", "string").when(t == "BINARY", "binary").when(t == "ARRAY", "array").when(t == "OBJECT", "object")
    return F.coalesce(found, F.lit("undefined"))


operator("type", 1, 1)(lambda o, _: Val(type_name(o[0]), "str"))
operator("bool", 1, 1)(lambda o, _: _bool(truthy(o[0])))
operator("num", 1, 1)(lambda o, _: _number(num(o[0])))
operator("str", 1, 1)(lambda o, _: Val(text(o[0]), "str"))
for _name, _kind in {"und?": "undefined", "nil?": "null", "bool?": "boolean", "num?": "number", "str?": "string", "bin?": "binary", "arr?": "array", "obj?": "object"}.items():
    operator(_name, 1, 1)(lambda o, _, kind=_kind: _bool(type_name(o[0]) == kind))


@operator("len", 1, 1)
def _len(o: list[Val], _: Context) -> Val:
    v = o[0]
    by = {
        "str": lambda: F.char_length(v.col),
        "bin": lambda: F.octet_length(v.col),
        "arr": lambda: F.size(v.col),
        "map": lambda: F.size(v.col),
        "obj": lambda: F.lit(len(v.type.fields)) if v.type else F.lit(0),
        "json": lambda: F.when(is_tag(v.col, "STRING"), F.char_length(F.try_variant_get(v.col, "$", "string")))
        .when(is_tag(v.col, "ARRAY"), F.size(elements(v).col))
        .when(is_tag(v.col, "OBJECT"), F.size(members(v).col)),
    }
    return _number(F.coalesce(by.get(v.kind, lambda: F.lit(0))(), F.lit(0)), T.IntegerType())


# -- containers


def _index(v: Val) -> Column:
    return num(v).cast("int")


@operator("[]", 2, 2, "member")
def _member(o: list[Val], ctx: Context) -> Val:
    v, key = o
    if v.kind == "str":
        i = _index(key)
        return Val(F.when((i >= 0) & (i < F.char_length(v.col)), F.substring(v.col, i + 1, F.lit(1))), "str")
    if v.kind == "arr":
        return v.element(F.get(v.col, _index(key)))
    if v.kind == "bin":
        return _byte(v, key)
    if v.kind == "obj" and isinstance(key, Val):
        m = members(v)
        return Val(F.try_element_at(m.col, text(key)), "json")
    if v.kind == "map":
        return of_type(F.try_element_at(v.col, text(key)), v.type.valueType)
    if v.kind == "json":
        found = F.when(is_tag(v.col, "ARRAY"), F.get(elements(v).col, _index(key))).when(is_tag(v.col, "OBJECT"), F.try_element_at(members(v).col, text(key)))
        return Val(found, "json")
    return Val(ctx.fail("NOT_CONTAINER"), "undef")


def _byte(v: Val, at: Val) -> Val:
    i = _index(at)
    inside = (i >= 0) & (i < F.octet_length(v.col))
    return _number(F.when(inside, F.conv(F.hex(F.substring(v.col, i + 1, F.lit(1))), 16, 10).cast("int")), T.IntegerType())


@operator("u8", 2, 2)
def _u8(o: list[Val], ctx: Context) -> Val:
    found = _byte(*o)
    return _number(F.coalesce(found.col, ctx.fail("OUT_OF_BOUNDS").cast("int")), T.IntegerType())


# -- strings

operator(".", 2, None, "cat")(lambda o, _: Val(F.concat(*[text(v) for v in o]), "str"))
operator("contains", 2, 2)(lambda o, _: _bool(F.contains(text(o[0]), text(o[1]))))
operator("starts", 2, 2)(lambda o, _: _bool(F.startswith(text(o[0]), text(o[1]))))
operator("ends", 2, 2)(lambda o, _: _bool(F.endswith(text(o[0]), text(o[1]))))


def _bounds(size: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Start and length of a slice whose negative bounds count from the end."""
    at = lambda c: F.greatest(F.least(F.when(c < 0, c + size).otherwise(c), size), F.lit(0))
    return at(start), F.greatest(at(end) - at(start), F.lit(0))


@operator("substr", 3, 3)
def _substr(o: list[Val], _: Context) -> Val:
    own = text(o[0])
    start, size = _bounds(F.char_length(own), _index(o[1]), _index(o[2]))
    return Val(F.substring(own, start + 1, size), "str")


@operator("matches", 2, 2, raw=True)
def _matches(o: list, ctx: Context) -> Val:
    pattern = o[1][0] if isinstance(o[1], list) and len(o[1]) == 1 else o[1]
    if not isinstance(pattern, str):
        raise ExpressionError("matches takes a literal pattern")
    return _bool(text(compile_value(o[0], ctx)).rlike(pattern))


def _only_text(v: Val, check: Callable[[Column], Column]) -> Column:
    if v.kind == "str":
        return F.coalesce(check(v.col), F.lit(False))
    if v.kind == "json":
        return F.coalesce(is_tag(v.col, "STRING") & check(F.try_variant_get(v.col, "$", "string")), F.lit(False))
    return F.lit(False)


for _name, _check in {"email?": formats.email, "hostname?": formats.hostname, "ip4?": formats.ip4, "ip6?": formats.ip6, "uuid?": formats.uuid, "uri?": formats.uri, "duration?": formats.duration, "date?": formats.date, "time?": formats.time, "dateTime?": formats.date_time}.items():
    operator(_name, 1, 1)(lambda o, _, check=_check: _bool(_only_text(o[0], check)))

# -- arrays


def _one_type(vals: list[Val]) -> list[Val]:
    """Arrays with one element type."""
    own = [elements(v) for v in vals]
    if len({v.type.elementType.simpleString() for v in own}) == 1:
        return own
    if all(isinstance(v.type.elementType, NUMBERS) for v in own):
        return [Val(v.col.cast("array<double>"), "arr", T.ArrayType(T.DoubleType())) for v in own]
    kind = T.ArrayType(T.VariantType())
    return [Val(F.transform(v.col, _element_variant(v)), "arr", kind) for v in own]


def _element_variant(v: Val) -> Callable[[Column], Column]:
    return lambda x: to_variant(v.element(x))


@operator("concat", 2, None, "++")
def _concat(o: list[Val], _: Context) -> Val:
    same = _one_type(o)
    return Val(F.concat(*[v.col for v in same]), "arr", same[0].type)


@operator("push", 2)
def _push(o: list[Val], _: Context) -> Val:
    items = [Val(F.array(v.col), "arr", T.ArrayType(v.type or {"str": T.StringType(), "bool": T.BooleanType()}.get(v.kind, T.VariantType()))) for v in o[1:]]
    same = _one_type([o[0], *items])
    return Val(F.concat(*[v.col for v in same]), "arr", same[0].type)


@operator("head", 2, 2)
def _head(o: list[Val], _: Context) -> Val:
    own, n = elements(o[0]), _index(o[1])
    size = F.size(own.col)
    start = F.when(n >= 0, 1).otherwise(F.greatest(size + n, F.lit(0)) + 1)
    return Val(F.slice(own.col, start, F.least(F.abs(n), size)), "arr", own.type)


@operator("sort", 1, 1)
def _sort(o: list[Val], _: Context) -> Val:
    own = elements(o[0])

    def by(x: Column, y: Column) -> Column:
        a, b = text(own.element(x)), text(own.element(y))
        return F.when(a < b, -1).when(a > b, 1).otherwise(0)

    return Val(F.array_sort(own.col, by), "arr", own.type)


@operator("reverse", 1, 1)
def _reverse(o: list[Val], _: Context) -> Val:
    own = elements(o[0])
    return Val(F.reverse(own.col), "arr", own.type)


@operator("in", 2, 2)
def _in(o: list[Val], _: Context) -> Val:
    own = elements(o[0])
    return _bool(F.exists(own.col, lambda x: equal(own.element(x), o[1])))


@operator("indexOf", 2, 2)
def _index_of(o: list[Val], _: Context) -> Val:
    own = elements(o[0])
    hits = F.transform(own.col, lambda x: equal(own.element(x), o[1]))
    return _number((F.array_position(hits, True) - 1).cast("int"), T.IntegerType())


@operator("slice", 3, 3)
def _slice(o: list[Val], _: Context) -> Val:
    own = elements(o[0])
    start, size = _bounds(F.size(own.col), _index(o[1]), _index(o[2]))
    return Val(F.slice(own.col, start + 1, size), "arr", own.type)


@operator("zip", 2, 2)
def _zip(o: list[Val], _: Context) -> Val:
    a, b = _one_type(o)
    n = F.least(F.size(a.col), F.size(b.col))
    return Val(F.zip_with(F.slice(a.col, F.lit(1), n), F.slice(b.col, F.lit(1), n), lambda x, y: F.array(x, y)), "arr", T.ArrayType(T.ArrayType(a.type.elementType)))


@operator("fromEntries", 1, 1)
def _from_entries(o: list[Val], _: Context) -> Val:
    own = elements(o[0])

    def entry(x: Column) -> Column:
        p = elements(own.element(x))
        return F.struct(text(p.element(F.get(p.col, F.lit(0)))).alias("k"), to_variant(p.element(F.get(p.col, F.lit(1)))).alias("v"))

    entries = F.transform(own.col, entry)
    # The last entry of a key wins.
    keys = F.transform(entries, lambda e: e["k"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"]))
    return Val(F.map_from_entries(last), "map", T.MapType(T.StringType(), T.VariantType()))


def _scope(name) -> str:
    name = name[0] if isinstance(name, list) and len(name) == 1 else name
    if not isinstance(name, str):
        raise ExpressionError("a variable name is a string")
    return name


@operator("filter", 3, 3, raw=True)
def _filter(o: list, ctx: Context) -> Val:
    own, name = elements(compile_value(o[0], ctx)), _scope(o[1])
    return Val(F.filter(own.col, lambda x: truthy(compile_value(o[2], ctx.bind(name, own.element(x))))), "arr", own.type)


@operator("map", 3, 3, raw=True)
def _map(o: list, ctx: Context) -> Val:
    own, name = elements(compile_value(o[0], ctx)), _scope(o[1])
    shape: list[Val] = []

    def body(x: Column) -> Column:
        shape.append(compile_value(o[2], ctx.bind(name, own.element(x))))
        return shape[-1].col

    col = F.transform(own.col, body)
    kind = {"str": T.StringType(), "bool": T.BooleanType(), "bin": T.BinaryType()}.get(shape[0].kind, shape[0].type or T.VariantType())
    return Val(col, "arr", T.ArrayType(kind))


@operator("reduce", 5, 5, raw=True)
def _reduce(o: list, ctx: Context) -> Val:
    """The accumulator keeps the kind of the initial value; numbers are doubles."""
    own, init = elements(compile_value(o[0], ctx)), compile_value(o[1], ctx)
    acc, name = _scope(o[2]), _scope(o[3])
    kind = {"num": "double", "str": "string", "bool": "boolean"}.get(init.kind, "variant")
    as_kind = {"num": num, "str": text, "bool": truthy}.get(init.kind, to_variant)

    def step(a: Column, x: Column) -> Column:
        held = Val(a, init.kind if kind != "variant" else "json", T.DoubleType() if init.kind == "num" else None)
        return as_kind(compile_value(o[4], ctx.bind(acc, held).bind(name, own.element(x)))).cast(kind)

    out = F.aggregate(own.col, as_kind(init).cast(kind), step)
    return Val(out, init.kind if kind != "variant" else "json", T.DoubleType() if init.kind == "num" else None)


# -- objects


@operator("keys", 1, 1)
def _keys(o: list[Val], _: Context) -> Val:
    if o[0].kind == "obj":
        return literal([f.name for f in o[0].type.fields])
    return Val(F.map_keys(members(o[0]).col), "arr", T.ArrayType(T.StringType()))


@operator("values", 1, 1)
def _values(o: list[Val], _: Context) -> Val:
    own = members(o[0])
    return Val(F.map_values(own.col), "arr", T.ArrayType(own.type.valueType))


@operator("entries", 1, 1)
def _entries(o: list[Val], _: Context) -> Val:
    own = members(o[0])
    pair = F.transform(F.map_entries(own.col), lambda e: F.array(e["key"].cast("variant"), to_variant(of_type(e["value"], own.type.valueType))))
    return Val(pair, "arr", T.ArrayType(T.ArrayType(T.VariantType())))


def _own_key(key) -> str:
    key = key[0] if isinstance(key, list) and len(key) == 1 else key
    if not isinstance(key, str):
        raise ExpressionError("a key is a string")
    if key == "__proto__":
        raise ExpressionError("PROTO_KEY")
    return key


def _variants(v: Val) -> Column:
    own = members(v)
    if isinstance(own.type.valueType, T.VariantType):
        return own.col
    return F.transform_values(own.col, lambda _, x: to_variant(of_type(x, own.type.valueType)))


@operator("o.set", 3, raw=True)
def _set(o: list, ctx: Context) -> Val:
    base = _variants(compile_value(o[0], ctx))
    new = {_own_key(k): compile_value(v, ctx) for k, v in zip(o[1::2], o[2::2], strict=True)}
    kept = F.map_filter(base, lambda k, _: ~k.isin(*new))
    added = F.map_from_arrays(F.array(*[F.lit(k) for k in new]), F.array(*[to_variant(v) for v in new.values()]))
    return Val(F.map_concat(kept, added), "map", T.MapType(T.StringType(), T.VariantType()))


@operator("o.del", 2, raw=True)
def _delete(o: list, ctx: Context) -> Val:
    own = members(compile_value(o[0], ctx))
    names = [_own_key(k) for k in o[1:]]
    return Val(F.map_filter(own.col, lambda k, _: ~k.isin(*names)), "map", own.type)


# -- branching and input


@operator("?", 3, 3, "if")
def _if(o: list[Val], _: Context) -> Val:
    yes, no = _same(o[1:])
    return Val(F.when(truthy(o[0]), yes.col).otherwise(no.col), yes.kind, yes.type)


operator("throw", 1, 1)(lambda o, _: Val(F.raise_error(text(o[0])).cast("string"), "str"))


def lookup(path: str, ctx: Context) -> Val | None:
    """Value of ``name/pointer`` or ``/pointer``; None for what the schema rules out."""
    name, slash, rest = path.partition("/")
    value = ctx.variables.get(name)
    if value is None:
        return None
    for step in parse_pointer(slash + rest):
        if isinstance(value, Row):
            value = value.fields.get(step)
        elif value.kind == "obj":
            kind = next((f.dataType for f in value.type.fields if f.name == step), None)
            value = None if kind is None else of_type(value.col.getField(step), kind)
        elif value.kind == "map":
            value = of_type(F.try_element_at(value.col, F.lit(step)), value.type.valueType)
        elif value.kind == "arr":
            value = value.element(F.get(value.col, F.lit(int(step)))) if step.isdigit() else None
        elif value.kind == "json":
            quoted = step.replace("\\", "\\\\").replace("'", "\\'")
            key = F.try_variant_get(value.col, f"$['{quoted}']", "variant")
            value = Val(F.coalesce(F.try_variant_get(value.col, f"$[{int(step)}]", "variant"), key) if step.isdigit() else key, "json")
        else:
            value = None
        if value is None:
            return None
    return value


@operator("$", 1, 2, "get", raw=True)
def _get(o: list, ctx: Context) -> Val:
    found = lookup(_scope(o[0]), ctx)
    if len(o) == 2:
        other = compile_value(o[1], ctx)
        if found is None:
            return other
        own, other = _same([found, other])
        return Val(F.coalesce(own.col, other.col), own.kind, own.type)
    if found is None:
        return Val(ctx.fail("NOT_FOUND"), "undef")
    return Val(F.coalesce(found.col, ctx.fail("NOT_FOUND")), found.kind, found.type) if ctx.strict else found


@operator("$?", 1, 1, "get?", raw=True)
def _defined(o: list, ctx: Context) -> Val:
    found = lookup(_scope(o[0]), ctx)
    return _bool(F.lit(False) if found is None else found.col.isNotNull())


# -- bits


def _int32(v: Val) -> Column:
    """The number's low 32 bits as a signed int."""
    low = F.pmod(F.when(num(v) < 0, F.ceil(num(v))).otherwise(F.floor(num(v))), F.lit(1 << 32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


for _name, _alias, _step in (("&", "bitAnd", lambda a, b: a.bitwiseAND(b)), ("|", "bitOr", lambda a, b: a.bitwiseOR(b)), ("^", "bitXor", lambda a, b: a.bitwiseXOR(b))):
    operator(_name, 2, None, _alias)(lambda o, _, step=_step: _number(reduce(step, [_int32(v) for v in o]), T.IntegerType()))
operator("~", 1, 1, "bitNot")(lambda o, _: _number(F.bitwise_not(_int32(o[0])), T.IntegerType()))


# -- patch


@operator("jp.add", 2, raw=True)
def _patch_add(o: list, ctx: Context) -> Val:
    """JSON Patch ``add`` at constant pointers, of the document as VARIANT."""
    from docloom.operators.patch import apply_patch_text

    doc = F.to_json(to_variant(compile_value(o[0], ctx)))
    ops = F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('{"op":"add","path":' + json.dumps(_scope(p)) + ',"value":'), F.to_json(to_variant(compile_value(v, ctx))), F.lit("}")) for p, v in zip(o[1::2], o[2::2], strict=True)]), F.lit("]"))
    return Val(F.try_parse_json(apply_patch_text(doc, ops)["doc"]), "json")
