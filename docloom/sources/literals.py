"""Literal tables: a value's distinct keys and scalars once, and places in the table instead.

The table holds the integers first, sorted and as differences, then the other literals by
their text. Objects become objects whose keys are places.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column

from docloom.functions.arrow import arrow
from docloom.sources.codecs import CodecError


def _integer(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _literals(value):
    if isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from _literals(v)
    elif isinstance(value, list):
        for v in value:
            yield from _literals(v)
    elif not isinstance(value, bytes):
        yield value


def _key(v) -> tuple:
    """Literals of different kinds are never equal; zeros differ by their sign."""
    return (type(v).__name__, repr(v))


def _text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def table(value) -> list:
    found = {_key(v): v for v in _literals(value)}
    integers = sorted(v for v in found.values() if _integer(v))
    # the sort is stable, so literals of equal text stay in the order of the walk
    others = sorted((v for v in found.values() if not _integer(v)), key=_text)
    return [v - before for before, v in zip([0, *integers], integers)] + others


def expand(own: list) -> list:
    """The literals of a table: differences summed."""
    out, last = [], 0
    for v in own:
        last = last + v if _integer(v) else last
        out.append(last if _integer(v) else v)
    return out


def compress(value, own: list):
    places = {_key(v): k for k, v in enumerate(expand(own))}

    def one(v):
        if isinstance(v, dict):
            return dict(sorted(((str(one(k)), one(x)) for k, x in v.items()), key=lambda kv: int(kv[0])))
        if isinstance(v, list):
            return [one(x) for x in v]
        if _key(v) not in places:
            raise CodecError("VALUE_NOT_FOUND")
        return places[_key(v)]

    return one(value)


def decompress(body, own: list):
    literals = expand(own)

    def at(k: int):
        if not 0 <= k < len(literals):
            raise CodecError("unknown literal")
        return literals[k]

    def one(v):
        if isinstance(v, dict):
            return {at(int(k)): one(x) for k, x in v.items()}
        return [one(x) for x in v] if isinstance(v, list) else at(v)

    return one(body)


def compress_column(text: Column) -> Column:
    """JSON text as [table, body] in JSON text."""

    @arrow("string")
    def run(own: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            value = json.loads(t)
            made = table(value)
            return json.dumps([made, compress(value, made)], separators=(",", ":"), ensure_ascii=False)

        return own.map(one)

    return run(text)


def decompress_column(text: Column) -> Column:
    """The JSON text of [table, body]; broken input gives NULL."""

    @arrow("string")
    def run(own: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(decompress(*reversed(json.loads(t))), separators=(",", ":"), ensure_ascii=False)
            except (CodecError, ValueError, TypeError):
                return None

        return own.map(one)

    return run(text)
