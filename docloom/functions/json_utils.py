"""Utilities over JSON values: canonical text, sizes, hashes, walks, text helpers.

Python functions work on parsed values; those named ``*_column`` work on JSON text
Columns, natively where Spark can express them, else in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrow import arrow

# Seeds that the 32-bit hash mixes in for each kind of value.
START = 5381
NULL, TRUE, FALSE = 982452847, 982453247, 982454243
ARRAY, STRING, OBJECT, BINARY = 982452259, 982453601, 982454533, 982454837
MASK = 0xFFFFFFFF


def stringify(value) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stringify_column(text: Column) -> Column:
    """Canonical text through VARIANT, which sorts keys; NULL for invalid or duplicate keys."""
    return F.to_json(F.try_parse_json(text))


def deep_equal_column(a: Column, b: Column) -> Column:
    """Structural equality, free of key order; NULL where either is not JSON."""
    return stringify_column(a) == stringify_column(b)


def deep_equal(a, b) -> bool:
    """Structural equality of values that may hold bytes: kinds are told apart, numbers by value."""
    if isinstance(a, (bytes, bytearray)) or isinstance(b, (bytes, bytearray)):
        return isinstance(a, (bytes, bytearray)) and isinstance(b, (bytes, bytearray)) and bytes(a) == bytes(b)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(deep_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def pretty_one_line(value) -> str:
    """One line with spaces after commas and inside brackets."""
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {pretty_one_line(v)}" for k, v in value.items()) + " }" if value else "{}"
    if isinstance(value, list):
        return "[ " + ", ".join(map(pretty_one_line, value)) + " ]" if value else "[]"
    return json.dumps(value, ensure_ascii=False)


def _mix(numbers: Iterator[int]) -> int:
    state = START
    for n in numbers:
        state = (state * 33 + n) & MASK
    return state


def _string_marks(text: str) -> Iterator[int]:
    units = text.encode("utf-16-le", "surrogatepass")
    yield from (STRING, len(units) // 2)
    yield from (units[k] | units[k + 1] << 8 for k in range(len(units) - 2, -1, -2))


def _marks(value) -> Iterator[int]:
    """The numbers that a value feeds to the hash, in order."""
    if value is None or value is True or value is False:
        yield {None: NULL, True: TRUE, False: FALSE}[value]
    elif isinstance(value, (int, float)):
        yield max(-(1 << 31), min((1 << 31) - 1, int(value)))  # saturates at 32 bits
    elif isinstance(value, str):
        yield STRING
        yield from _string_marks(value)
    elif isinstance(value, list):
        yield ARRAY
        for v in value:
            yield from _marks(v)
    else:
        yield OBJECT
        for k in sorted(value):
            yield from _string_marks(k)
            yield from _marks(value[k])


def hash32(value) -> int:
    """32-bit hash of a JSON value."""
    return _mix(_marks(value))


def hash_str(text: str) -> int:
    return hash32(text)


def hash_bin(data: bytes) -> int:
    return _mix(iter([BINARY, len(data), *reversed(data)]))


@arrow("long")
def hash_column(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else hash32(json.loads(t))).astype("Int64")


def hash_str_column(text: Column) -> Column:
    """``hash32`` of a string Column's ASCII or BMP text, without Python: a 32-bit fold."""
    units = F.transform(F.reverse(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: F.ascii(c).cast("long"))
    start = _mix(iter([STRING, STRING]))
    first = (F.lit(start).cast("long") * 33 + F.char_length(text)).bitwiseAND(F.lit(MASK))
    return F.aggregate(units, first, lambda a, u: (a * 33 + u).bitwiseAND(F.lit(MASK)))


def struct_hash(value) -> str:
    """Printable hash of a structure: whole numbers in base 36, texts by their 32-bit hash, keys sorted."""
    if value is None or isinstance(value, bool):
        return {None: "N", True: "T", False: "F"}[value]
    if isinstance(value, (int, float)):
        return ("-" if value < 0 else "") + base36(int(abs(value)))
    if isinstance(value, str):
        return base36(hash32(value))
    if isinstance(value, (bytes, bytearray)):
        return base36(hash_bin(bytes(value)))
    if isinstance(value, list):
        return "[" + "".join(struct_hash(v) + ";" for v in value) + "]"
    return "{" + "".join(f"{base36(hash32(k))}:{struct_hash(value[k])}," for k in sorted(value)) + "}"


def base36(n: int) -> str:
    out = ""
    while True:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        if not n:
            return out


def size_fast(value) -> int:
    """Heuristic encoded size: scalars 1 or 9, text 4 and its bytes, 2 a container and a key."""
    if value is None or isinstance(value, bool):
        return 1
    if isinstance(value, (int, float)):
        return 9
    if isinstance(value, str):
        return 4 + len(value.encode())
    if isinstance(value, list):
        return 2 + sum(map(size_fast, value))
    return 2 + sum(2 + len(k.encode()) + size_fast(v) for k, v in value.items())


def json_size(value) -> int:
    return len(json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode())


def json_size_approx(value) -> int:
    """The compact text's bytes without the escapes of texts."""
    if isinstance(value, str):
        return len(value.encode()) + 2
    if isinstance(value, list):
        return 2 + sum(map(json_size_approx, value)) + max(0, len(value) - 1)
    if isinstance(value, dict):
        return 2 + sum(json_size_approx(k) + 1 + json_size_approx(v) for k, v in value.items()) + max(0, len(value) - 1)
    return json_size(value)


def utf8_size(text: Column) -> Column:
    """Bytes of a text in UTF-8."""
    return F.octet_length(text).cast("long")


def max_capacity(value) -> int:
    """Upper bound of the encoded size in any supported format."""
    if value is None or isinstance(value, bool):
        return 5
    if isinstance(value, (int, float)):
        return 22
    if isinstance(value, str):
        return 5 + 5 * len(value)
    if isinstance(value, list):
        return 5 + sum(1 + max_capacity(v) for v in value)
    return 5 + sum(2 + max_capacity(k) + max_capacity(v) for k, v in value.items())


@arrow("long")
def size_fast_column(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else size_fast(json.loads(t))).astype("Int64")


@arrow("struct<approx:bigint,fast:bigint,exact:bigint>")
def sizes_column(text: pd.Series) -> pd.DataFrame:
    """All three sizes from one parse of each row."""
    rows = [(None, None, None) if t is None else (json_size_approx(v := json.loads(t)), size_fast(v), json_size(v)) for t in text]
    return pd.DataFrame(rows, columns=["approx", "fast", "exact"]).astype("Int64")


def json_size_column(text: Column) -> Column:
    """Bytes of the canonical compact text."""
    return F.octet_length(stringify_column(text)).cast("long")


def walk(value) -> Iterator[tuple[tuple, object]]:
    """(path, value) of every node, before its children."""
    yield (), value
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        for path, own in walk(v):
            yield (k, *path), own


@arrow("array<struct<depth:int,pointer:string,kind:string>>")
def walk_column(text: pd.Series) -> pd.Series:
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}

    def one(t):
        if t is None:
            return None
        return [{"depth": len(p), "pointer": "".join("/" + str(s).replace("~", "~0").replace("/", "~1") for s in p), "kind": kinds[type(v)]} for p, v in walk(json.loads(t))]

    return text.map(one)


def obj_key_cmp(keys: list[str]) -> list[str]:
    """Keys by length, then by text."""
    return sorted(keys, key=lambda k: (len(k), k))


def word_wrap(text: str, width: int = 32) -> list[str]:
    """Lines of at most ``width``, broken at spaces where there is one."""
    out = []
    for line in text.split("\n"):
        rest = line
        while len(rest) > width:
            cut = rest.rfind(" ", 0, width + 1)
            cut = cut if cut > 0 else width
            out.append(rest[:cut].rstrip())
            rest = rest[cut:].lstrip()
        out.append(rest)
    return out


def escape_column(text: Column) -> Column:
    """JSON string escapes, without the quotes."""
    quoted = F.to_json(text.cast("variant"))
    return F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)


def as_string_column(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def is_letter(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}_]$")


def is_whitespace(c: Column) -> Column:
    return c.rlike(r"^\s$")


def is_punctuation(c: Column) -> Column:
    return c.rlike(r"^[^\p{L}\p{N}_\s]$")


def to_html(node) -> str:
    """HTML of a JsonML node ``[tag, {attributes}, ...children]``."""
    if not isinstance(node, list):
        return _text_html(str(node))
    tag, *rest = node
    attributes = rest.pop(0) if rest and (rest[0] is None or isinstance(rest[0], dict)) else {}
    inner = "".join(map(to_html, rest))
    if tag in ("", None):
        return inner
    own = "".join(f' {k}="{_text_html(str(v)).replace(chr(34), "&quot;")}"' for k, v in (attributes or {}).items())
    return f"<{tag}{own}>{inner}</{tag}>" if rest else f"<{tag}{own} />"


def _text_html(text: str) -> str:
    return re.sub("[&<>]", lambda m: {"&": "&amp;", "<": "&lt;", ">": "&gt;"}[m[0]], text)


def walk_markup(node) -> Iterator:
    """Every node of a JsonML tree before its children: [tag, attributes or null, children...] or text."""
    yield node
    for child in node[2:] if isinstance(node, list) else ():
        yield from walk_markup(child)


class Fuzzer:
    """Seeded random numbers, picks and shuffles; the seed's draws repeat in every process."""

    def __init__(self, seed: int | str = 0):
        import random

        self.seed, self.draws = seed, random.Random(str(seed))

    def random_int(self, low: int, high: int) -> int:
        """A whole number from ``low`` to ``high``, both included."""
        return self.draws.randint(low, high)

    def pick(self, items: list):
        return items[self.draws.randrange(len(items))]

    def repeat(self, times: int, make) -> list:
        return [make() for _ in range(times)]

    def shuffled(self, items: list) -> list:
        return self.draws.sample(items, len(items))
