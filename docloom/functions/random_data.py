"""Random JSON as Columns: token strings, templates, and documents grown by odds.

Every draw hashes the row's key with the place of the draw, so a task that runs again, on
any executor and in any partitioning, makes the same rows.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrow import arrow

# The multiplier and modulus of the minimal standard generator.
MULTIPLIER, MODULUS = 48_271, 2_147_483_647
ODDS = {"null": 1, "boolean": 2, "number": 10, "string": 8, "array": 2, "object": 2}


def lcg(seed: Column, nth: int = 1) -> Column:
    """The nth number in [0, 1) of the minimal standard generator; seed 0 counts as 1."""
    state = F.when(seed == 0, 1).otherwise(seed).cast("long")
    for _ in range(nth):
        state = state * MULTIPLIER % MODULUS
    return (state - 1) / F.lit(float(MODULUS - 1))


class Draws:
    """Uniform draws named by their place in a template, for the row's key columns."""

    def __init__(self, *keys: Column, place: str = ""):
        self.keys, self.place = keys, place

    def at(self, place, *more: Column) -> Draws:
        return Draws(*self.keys, *more, place=f"{self.place}/{place}")

    def uniform(self) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(*self.keys, F.lit(self.place)), 11)
        return bits / F.lit(float(1 << 53))

    def integer(self, low: int, high: int) -> Column:
        """A whole number from ``low`` to ``high``, both included, in either order."""
        low, high = min(low, high), max(low, high)
        return F.lit(low) + F.floor(self.uniform() * F.lit(float(high - low + 1))).cast("long")


Token = str | tuple


def random_string(token: Token, own: Draws) -> Column:
    """A string of a token: text, ("pick", ...), ("repeat", low, high, token), ("char", low, high[, n]) or ("list", ...)."""
    if isinstance(token, str):
        return F.lit(token)
    name, *args = token
    if name == "list":
        return F.concat(F.lit(""), *[random_string(t, own.at(k)) for k, t in enumerate(args)])
    if name == "pick":
        if not args:
            return F.lit("")
        choice = own.integer(0, len(args) - 1)
        return F.element_at(F.array(*[random_string(t, own.at(k)) for k, t in enumerate(args)]), (choice + 1).cast("int"))
    if name == "repeat":
        return _times(own.integer(args[0], args[1]), lambda k: random_string(args[2], own.at("r", k)))
    if name == "char":
        low, high = min(args[:2]), max(args[:2])

        def one(k: Column) -> Column:
            code = own.at("c", k).integer(low, high)
            # surrogates stand for no character; four bytes of UTF-32 make any other
            code = F.when(code.between(0xD800, 0xDFFF), 0xFFFD).otherwise(code)
            return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

        return _times(F.lit(args[2] if len(args) > 2 else 1), one)
    raise ValueError(f"unknown token {name}")


def _times(n: Column, item: Callable[[Column], Column]) -> Column:
    """Items joined; the sequence starts below and is cut, so that none gives the empty string."""
    return F.array_join(F.transform(F.slice(F.sequence(F.lit(0).cast("long"), n.cast("long")), 2, 1 << 30), item), "")


def _text(c: Column) -> Column:
    """JSON text of a string Column."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def template(t, own: Draws, depth: int = 4) -> Column:
    """JSON text of a template.

    ("lit", v), ("int", low, high), ("num",), ("float", low, high), ("str", token), ("bool",),
    ("nil",), ("bin", low, high, ...), ("arr", low, high, template), ("obj", {key: template},
    {optional key: (odds, template)}), ("map", token, low, high, template), ("or", ...), and
    ("recursive", f) whose f() is a template; recursion ends in null after ``depth`` levels.
    """
    name, *args = (t, *()) if isinstance(t, str) else t
    if name == "lit":
        return F.lit(json.dumps(args[0], separators=(",", ":"), ensure_ascii=False))
    if name == "nil":
        return F.lit("null")
    if name == "bool":
        return F.when(own.uniform() < 0.5, "true").otherwise("false")
    if name == "int":
        return own.integer(*args).cast("string")
    if name == "num":
        return own.integer(-(1 << 31), 1 << 31).cast("string")
    if name == "float":
        low, high = args or (0.0, 1.0)
        return F.format_string("%.6f", F.lit(float(low)) + own.uniform() * F.lit(float(high - low)))
    if name == "str":
        return _text(random_string(args[0] if args else ("repeat", 1, 16, ("char", 32, 126)), own))
    if name == "bin":
        return F.concat(F.lit("["), _listed(own.integer(*(args or (1, 16))), lambda k: own.at("b", k).integer(0, 255).cast("string")), F.lit("]"))
    if name == "arr":
        return F.concat(F.lit("["), _listed(own.integer(args[0], args[1]), lambda k: template(args[2], own.at("a", k), depth)), F.lit("]"))
    if name == "obj":
        fixed = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), template(v, own.at(k), depth)) for k, v in args[0].items()]
        for k, (odds, v) in (args[1] if len(args) > 1 else {}).items():
            fixed.append(F.when(own.at(k + "?").uniform() < odds, F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), template(v, own.at(k), depth))))
        return F.concat(F.lit("{"), F.concat_ws(",", *fixed), F.lit("}"))
    if name == "map":
        token, low, high, item = args
        entry = lambda k: F.struct(random_string(token, own.at("k", k)).alias("key"), template(item, own.at("v", k), depth).alias("value"))
        entries = F.transform(_numbers(own.integer(low, high)), entry)
        # of equal keys the first stays
        fresh = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, F.lit(1), k), lambda o: o["key"] == e["key"]))
        return F.concat(F.lit("{"), F.array_join(F.transform(fresh, lambda e: F.concat(_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    if name == "or":
        choice, out = own.at("|").integer(0, len(args) - 1), F.lit("null")
        for k, v in enumerate(args):
            out = F.when(choice == k, template(v, own.at(k), depth)).otherwise(out)
        return out
    if name == "recursive":
        return template(args[0](), own.at("~"), depth - 1) if depth > 0 else F.lit("null")
    raise ValueError(f"unknown template {name}")


def _numbers(n: Column) -> Column:
    return F.slice(F.sequence(F.lit(0).cast("long"), n.cast("long")), 2, 1 << 30)


def _listed(n: Column, item: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(_numbers(n), item), ",")


def random_json(key: Column, nodes: int = 32, odds: dict[str, int] | None = None, seed: int = 0) -> Column:
    """A document of about ``nodes`` nodes a row, each put into a container drawn at random."""
    odds = {**ODDS, **(odds or {})}

    dump = json.JSONEncoder(ensure_ascii=False).encode

    @arrow("string")
    def run(own: pd.Series) -> pd.Series:
        return own.map(lambda k: dump(_grow(random.Random(f"{seed}:{k}"), nodes, odds)))

    return run(key.cast("string"))


def _grow(own: random.Random, nodes: int, odds: dict[str, int]):
    kinds, weights = list(odds), list(accumulate(odds.values()))
    both = odds["array"] + odds["object"]
    root: list | dict = [] if both and own.random() * both < odds["array"] else {}
    containers, between = [root], own.randrange
    for _ in range(nodes):
        kind = own.choices(kinds, cum_weights=weights)[0]
        if kind == "number":
            value = own.choice([own.random() * 1e9, between(-128, 128), between(-(1 << 15), 1 << 15), own.getrandbits(53)])
        elif kind == "string":
            value = "".join([chr(between(32, 127)) for _ in range(between(1, 17))])
        elif kind == "boolean":
            value = own.random() < 0.5
        else:
            value = None if kind == "null" else [] if kind == "array" else {}
        holder = own.choice(containers)
        if isinstance(holder, list):
            holder.insert(between(len(holder) + 1), value)
        else:
            holder["".join(own.choices(_LETTERS, k=between(1, 9)))] = value
        if isinstance(value, (list, dict)):
            containers.append(value)
    return root


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WORD = ("repeat", 3, 9, ("char", 97, 122))
_HEX = ("pick", *"0123456789abcdef")

#: Templates of common documents.
EXAMPLES: dict[str, tuple] = {
    "user": ("obj", {"id": ("int", 1, 1 << 40), "name": ("str", ("list", ("char", 65, 90), _WORD)), "email": ("str", ("list", _WORD, "@", _WORD, ".example")), "active": ("bool",)}, {"age": (0.7, ("int", 18, 99))}),
    "order": ("obj", {"id": ("int", 1, 1 << 40), "items": ("arr", 1, 5, ("obj", {"sku": ("str", ("repeat", 8, 8, _HEX)), "quantity": ("int", 1, 9), "price": ("float", 1, 500)})), "state": ("str", ("pick", "open", "paid", "sent"))}),
    "log": ("obj", {"time": ("int", 1_600_000_000, 1_800_000_000), "level": ("str", ("pick", "debug", "info", "warn", "error")), "message": ("str", ("repeat", 3, 12, ("list", _WORD, " ")))}, {"trace": (0.2, ("str", ("repeat", 32, 32, _HEX)))}),
    "metric": ("obj", {"name": ("str", ("list", _WORD, ".", _WORD)), "value": ("float", 0, 1000), "tags": ("map", _WORD, 0, 4, ("str", _WORD))}),
    "sensor": ("obj", {"device": ("str", ("repeat", 12, 12, _HEX)), "readings": ("arr", 1, 8, ("float", -40, 85)), "battery": ("or", ("nil",), ("int", 0, 100))}),
    "address": ("obj", {"street": ("str", _WORD), "number": ("int", 1, 300), "city": ("str", _WORD), "code": ("str", ("repeat", 5, 5, ("char", 48, 57)))}),
    "event": ("obj", {"type": ("str", ("pick", "view", "click", "purchase")), "at": ("int", 1_600_000_000, 1_800_000_000), "props": ("map", _WORD, 1, 3, ("or", ("int", 0, 9), ("bool",), ("str", _WORD)))}),
}


def tree() -> tuple:
    """A nested template: a value and up to two trees."""
    return ("obj", {"value": ("int", 0, 99), "children": ("arr", 0, 2, ("recursive", tree))})


EXAMPLES["tree"] = tree()
