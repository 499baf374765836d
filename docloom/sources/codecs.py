"""Binary and text codecs of JSON-like values, from their public specifications.

Values are Python's: None, bool, int, float, str, bytes, list, dict. ``encode_column`` and
``decode_column`` lift any registered codec to Columns between JSON text and BINARY.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrow import arrow

DATA_URI = "data:application/octet-stream;base64,"


class CodecError(ValueError):
    """Bytes that are not of the format."""


@dataclass(frozen=True)
class Tagged:
    """An extension value: a number and what it tags."""

    tag: int
    value: object


class Reader:
    """A cursor over bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise CodecError("unexpected end")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def unpack(self, kind: str):
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def line(self) -> bytes:
        end = self.data.find(b"\r\n", self.at)
        if end < 0:
            raise CodecError("unexpected end")
        return self.take(end + 2 - self.at)[:-2]


# -- CBOR (RFC 8949)


def _cbor_head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, kind, top in ((24, ">B", 1 << 8), (25, ">H", 1 << 16), (26, ">I", 1 << 32), (27, ">Q", 1 << 64)):
        if n < top:
            return bytes([major << 5 | code]) + struct.pack(kind, n)
    raise CodecError("integer too large")


def cbor_encode(value, stable: bool = False) -> bytes:
    """``stable`` sorts keys by length and bytes, as deterministic encoding asks."""
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _cbor_head(0, value) if value >= 0 else _cbor_head(1, -1 - value)
    if isinstance(value, float):
        if not math.isnan(value) and struct.unpack(">f", struct.pack(">f", value))[0] == value if abs(value) <= 3.4028234663852886e38 or math.isinf(value) else False:
            return b"\xfa" + struct.pack(">f", value)
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _cbor_head(3, len(raw)) + raw
    if isinstance(value, (bytes, bytearray)):
        return _cbor_head(2, len(value)) + bytes(value)
    if isinstance(value, list):
        return _cbor_head(4, len(value)) + b"".join(cbor_encode(v, stable) for v in value)
    if isinstance(value, Tagged):
        return _cbor_head(6, value.tag) + cbor_encode(value.value, stable)
    items = [(cbor_encode(k), cbor_encode(v, stable)) for k, v in value.items()]
    if stable:
        items.sort(key=lambda kv: (len(kv[0]), kv[0]))
    return _cbor_head(5, len(items)) + b"".join(k + v for k, v in items)


_BREAK = object()


def _cbor(r: Reader):
    first = r.byte()
    major, low = first >> 5, first & 31
    if major == 7:
        if low in (20, 21, 22, 23):
            return {20: False, 21: True}.get(low)
        if low in (25, 26, 27):
            return r.unpack({25: ">e", 26: ">f", 27: ">d"}[low])
        if low == 31:
            return _BREAK
        return Tagged(-1, r.byte() if low == 24 else low)
    if low == 31:
        if major in (2, 3):
            parts = []
            while (part := _cbor(r)) is not _BREAK:
                parts.append(part)
            return (b"" if major == 2 else "").join(parts)
        if major == 4:
            out = []
            while (v := _cbor(r)) is not _BREAK:
                out.append(v)
            return out
        if major == 5:
            own = {}
            while (k := _cbor(r)) is not _BREAK:
                own[k] = _cbor(r)
            return own
        raise CodecError("indefinite length")
    if low > 27:
        raise CodecError("reserved length")
    n = low if low < 24 else r.unpack({24: ">B", 25: ">H", 26: ">I", 27: ">Q"}[low])
    if major == 0:
        return n
    if major == 1:
        return -1 - n
    if major == 2:
        return r.take(n)
    if major == 3:
        return r.take(n).decode()
    if major == 4:
        return [_cbor(r) for _ in range(n)]
    if major == 5:
        return {_cbor(r): _cbor(r) for _ in range(n)}
    return Tagged(n, _cbor(r))


def cbor_decode(data: bytes):
    return _whole(_cbor, data)


def _whole(read: Callable, data: bytes):
    r = Reader(bytes(data))
    try:
        out = read(r)
    except (struct.error, UnicodeDecodeError, RecursionError) as e:
        raise CodecError(str(e)) from None
    if r.at != len(r.data) or out is _BREAK:
        raise CodecError("bytes left over")
    return out


def cbor_sequence(data: bytes) -> list:
    """All values of an RFC 8742 sequence."""
    r, out = Reader(bytes(data)), []
    while r.at < len(r.data):
        out.append(_cbor(r))
    return out


# -- MessagePack


def msgpack_encode(value, stable: bool = False) -> bytes:
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack("b", value) if value < 0 else bytes([value])
        for code, kind, low, top in ((0xCC, ">B", 0, 1 << 8), (0xD0, ">b", -(1 << 7), 0), (0xCD, ">H", 0, 1 << 16), (0xD1, ">h", -(1 << 15), 0), (0xCE, ">I", 0, 1 << 32), (0xD2, ">i", -(1 << 31), 0), (0xCF, ">Q", 0, 1 << 64), (0xD3, ">q", -(1 << 63), 0)):
            if low <= value < top:
                return bytes([code]) + struct.pack(kind, value)
        raise CodecError("integer too large")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _sized(len(raw), (0xA0, 32), ((0xD9, ">B"), (0xDA, ">H"), (0xDB, ">I"))) + raw
    if isinstance(value, (bytes, bytearray)):
        return _sized(len(value), None, ((0xC4, ">B"), (0xC5, ">H"), (0xC6, ">I"))) + bytes(value)
    if isinstance(value, list):
        return _sized(len(value), (0x90, 16), ((0xDC, ">H"), (0xDD, ">I"))) + b"".join(msgpack_encode(v, stable) for v in value)
    if isinstance(value, Tagged):
        n = len(value.value)
        fixed = {1: 0xD4, 2: 0xD5, 4: 0xD6, 8: 0xD7, 16: 0xD8}
        head = bytes([fixed[n]]) if n in fixed else _sized(n, None, ((0xC7, ">B"), (0xC8, ">H"), (0xC9, ">I")))
        return head + struct.pack("b", value.tag) + value.value
    items = sorted(value.items()) if stable else value.items()
    return _sized(len(value), (0x80, 16), ((0xDE, ">H"), (0xDF, ">I"))) + b"".join(msgpack_encode(k) + msgpack_encode(v, stable) for k, v in items)


def _sized(n: int, small: tuple[int, int] | None, forms: tuple) -> bytes:
    if small and n < small[1]:
        return bytes([small[0] | n])
    for code, kind in forms:
        if n < 1 << 8 * struct.calcsize(kind):
            return bytes([code]) + struct.pack(kind, n)
    raise CodecError("too long")


def _msgpack(r: Reader):
    b = r.byte()
    if b < 0x80:
        return b
    if b >= 0xE0:
        return b - 256
    if b < 0x90:
        return _msgpack_map(r, b & 15)
    if b < 0xA0:
        return [_msgpack(r) for _ in range(b & 15)]
    if b < 0xC0:
        return r.take(b & 31).decode()
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b]
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if b in numbers:
        return r.unpack(numbers[b])
    if b in (0xC4, 0xC5, 0xC6):
        return r.take(r.unpack({0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}[b]))
    if b in (0xD9, 0xDA, 0xDB):
        return r.take(r.unpack({0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}[b])).decode()
    if b in (0xDC, 0xDD):
        return [_msgpack(r) for _ in range(r.unpack(">H" if b == 0xDC else ">I"))]
    if b in (0xDE, 0xDF):
        return _msgpack_map(r, r.unpack(">H" if b == 0xDE else ">I"))
    if 0xD4 <= b <= 0xD8 or b in (0xC7, 0xC8, 0xC9):
        n = 1 << b - 0xD4 if b >= 0xD4 else r.unpack({0xC7: ">B", 0xC8: ">H", 0xC9: ">I"}[b])
        kind = r.unpack("b")
        return Tagged(kind, r.take(n))
    raise CodecError(f"unknown type {b:#x}")


def _msgpack_map(r: Reader, n: int) -> dict:
    return {_msgpack(r): _msgpack(r) for _ in range(n)}


def msgpack_decode(data: bytes):
    return _whole(_msgpack, data)


def msgpack_find(data: bytes, path: list):
    """The value at a path of keys and indexes, decoding only what lies before it."""
    r = Reader(bytes(data))
    for step in path:
        b = r.byte()
        if isinstance(step, str):
            n = b & 15 if 0x80 <= b < 0x90 else r.unpack(">H") if b == 0xDE else r.unpack(">I") if b == 0xDF else -1
            for _ in range(n):
                if _msgpack(r) == step:
                    break
                _msgpack(r)
            else:
                raise CodecError("NOT_FOUND")
        else:
            n = b & 15 if 0x90 <= b < 0xA0 else r.unpack(">H") if b == 0xDC else r.unpack(">I") if b == 0xDD else -1
            if not 0 <= step < n:
                raise CodecError("NOT_FOUND")
            for _ in range(step):
                _msgpack(r)
    return _msgpack(r)


# -- UBJSON


def ubjson_encode(value) -> bytes:
    if value is None or isinstance(value, bool):
        return {None: b"Z", True: b"T", False: b"F"}[value]
    if isinstance(value, int):
        for mark, kind, low, top in ((b"U", ">B", 0, 1 << 8), (b"i", ">b", -(1 << 7), 1 << 7), (b"I", ">h", -(1 << 15), 1 << 15), (b"l", ">i", -(1 << 31), 1 << 31), (b"L", ">q", -(1 << 63), 1 << 63)):
            if low <= value < top:
                return mark + struct.pack(kind, value)
        raise CodecError("integer too large")
    if isinstance(value, float):
        return b"D" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return b"S" + ubjson_encode(len(raw)) + raw
    if isinstance(value, (bytes, bytearray)):
        return b"[$U#" + ubjson_encode(len(value)) + bytes(value)
    if isinstance(value, list):
        return b"[" + b"".join(map(ubjson_encode, value)) + b"]"
    return b"{" + b"".join(ubjson_encode(k)[1:] + ubjson_encode(v) for k, v in value.items()) + b"}"


def _ubjson(r: Reader, mark: bytes = b""):
    mark = mark or r.take(1)
    numbers = {b"U": ">B", b"i": ">b", b"I": ">h", b"l": ">i", b"L": ">q", b"d": ">f", b"D": ">d"}
    if mark in numbers:
        return r.unpack(numbers[mark])
    if mark in (b"Z", b"T", b"F"):
        return {b"Z": None, b"T": True, b"F": False}[mark]
    if mark == b"S":
        return r.take(_ubjson(r)).decode()
    if mark == b"C":
        return r.take(1).decode()
    if mark == b"[":
        if r.data[r.at : r.at + 3] == b"$U#":
            r.take(3)
            return r.take(_ubjson(r))
        out = []
        while (own := r.take(1)) != b"]":
            out.append(_ubjson(r, own))
        return out
    if mark == b"{":
        out = {}
        while (own := r.take(1)) != b"}":
            key = r.take(_ubjson(r, own)).decode()
            out[key] = _ubjson(r)
        return out
    raise CodecError(f"unknown mark {mark!r}")


def ubjson_decode(data: bytes):
    return _whole(_ubjson, data)


# -- Bencode, with n, t and f for null and booleans


def bencode_encode(value) -> bytes:
    if value is None or isinstance(value, bool):
        return {None: b"n", True: b"t", False: b"f"}[value]
    if isinstance(value, (int, float)):
        return b"i%de" % round(value)
    if isinstance(value, (str, bytes)):
        raw = value.encode() if isinstance(value, str) else value
        return b"%d:" % len(raw) + raw
    if isinstance(value, list):
        return b"l" + b"".join(map(bencode_encode, value)) + b"e"
    return b"d" + b"".join(bencode_encode(k) + bencode_encode(value[k]) for k in sorted(value)) + b"e"


def _bencode(r: Reader, first: bytes = b""):
    first = first or r.take(1)
    if first in (b"n", b"t", b"f"):
        return {b"n": None, b"t": True, b"f": False}[first]
    if first == b"i":
        return int(_until(r, b"e"))
    if first == b"l":
        out = []
        while (c := r.take(1)) != b"e":
            out.append(_bencode(r, c))
        return out
    if first == b"d":
        out = {}
        while (c := r.take(1)) != b"e":
            key = _bencode(r, c).decode()
            out[key] = _bencode(r)
        return out
    if first.isdigit():
        return r.take(int(first + _until(r, b":")))
    raise CodecError(f"unknown mark {first!r}")


def _until(r: Reader, mark: bytes) -> bytes:
    out = b""
    while (c := r.take(1)) != mark:
        out += c
    return out


def bencode_decode(data: bytes):
    return _whole(_bencode, data)


# -- RESP3


def resp_encode(value) -> bytes:
    if value is None:
        return b"_\r\n"
    if isinstance(value, bool):
        return b"#t\r\n" if value else b"#f\r\n"
    if isinstance(value, int):
        return b":%d\r\n" % value if -(1 << 63) <= value < 1 << 63 else b"(%d\r\n" % value
    if isinstance(value, float):
        return b"," + ("inf" if value == math.inf else "-inf" if value == -math.inf else "nan" if value != value else repr(value)).encode() + b"\r\n"
    if isinstance(value, str):
        raw = value.encode()
        return b"+" + raw + b"\r\n" if len(raw) < 64 and b"\r" not in raw and b"\n" not in raw else b"=%d\r\ntxt:" % (len(raw) + 4) + raw + b"\r\n"
    if isinstance(value, (bytes, bytearray)):
        return b"$%d\r\n" % len(value) + bytes(value) + b"\r\n"
    if isinstance(value, list):
        return b"*%d\r\n" % len(value) + b"".join(map(resp_encode, value))
    return b"%%%d\r\n" % len(value) + b"".join(resp_encode(k) + resp_encode(v) for k, v in value.items())


def resp_command(*parts: str | bytes) -> bytes:
    """A client command: an array of bulk strings."""
    return b"*%d\r\n" % len(parts) + b"".join(resp_encode(p.encode() if isinstance(p, str) else p) for p in parts)


def _resp(r: Reader):
    mark, line = r.take(1), b""
    line = r.line()
    if mark == b"+":
        return line.decode()
    if mark == b"-":
        return {"error": line.decode()}
    if mark in (b":", b"("):
        return int(line)
    if mark == b",":
        return float(line)
    if mark == b"#":
        return line == b"t"
    if mark == b"_":
        return None
    n = int(line)
    if mark in (b"$", b"=", b"!"):
        if n < 0:
            return None
        raw = r.take(n)
        if r.take(2) != b"\r\n":
            raise CodecError("bulk string end")
        return raw if mark == b"$" else raw[4:].decode() if mark == b"=" else {"error": raw.decode()}
    if mark in (b"*", b"~", b">"):
        return None if n < 0 else [_resp(r) for _ in range(n)]
    if mark in (b"%", b"|"):
        return {_resp(r): _resp(r) for _ in range(n)}
    raise CodecError(f"unknown mark {mark!r}")


def resp_decode(data: bytes):
    return _whole(_resp, data)


def resp_stream(buffer: bytes) -> tuple[list, bytes]:
    """Whole values at the buffer's start, and what is left of it."""
    out, r = [], Reader(buffer)
    while r.at < len(buffer):
        mark = r.at
        try:
            out.append(_resp(r))
        except CodecError as e:
            if str(e) != "unexpected end":
                raise
            return out, buffer[mark:]
    return out, b""


# -- BSON and extended JSON


def bson_encode(value: dict) -> bytes:
    body = b"".join(_bson_item(k, v) for k, v in value.items()) + b"\0"
    return struct.pack("<i", len(body) + 4) + body


def _bson_item(key: str, v) -> bytes:
    name = key.encode() + b"\0"
    if v is None:
        return b"\x0a" + name
    if isinstance(v, bool):
        return b"\x08" + name + bytes([v])
    if isinstance(v, int):
        return b"\x10" + name + struct.pack("<i", v) if -(1 << 31) <= v < 1 << 31 else b"\x12" + name + struct.pack("<q", v)
    if isinstance(v, float):
        return b"\x01" + name + struct.pack("<d", v)
    if isinstance(v, str):
        raw = v.encode() + b"\0"
        return b"\x02" + name + struct.pack("<i", len(raw)) + raw
    if isinstance(v, (bytes, bytearray)):
        return b"\x05" + name + struct.pack("<iB", len(v), 0) + bytes(v)
    if isinstance(v, list):
        return b"\x04" + name + bson_encode({str(k): x for k, x in enumerate(v)})
    return b"\x03" + name + bson_encode(v)


def _bson(r: Reader) -> dict:
    end = r.at + r.unpack("<i")
    out = {}
    while (kind := r.byte()) != 0:
        key = _until(r, b"\0").decode()
        out[key] = _bson_value(r, kind)
    if r.at != end:
        raise CodecError("document length")
    return out


def _bson_value(r: Reader, kind: int):
    if kind in (0x01, 0x10, 0x12, 0x11):
        return r.unpack({0x01: "<d", 0x10: "<i", 0x12: "<q", 0x11: "<Q"}[kind])
    if kind in (0x02, 0x0D, 0x0E):
        return r.take(r.unpack("<i"))[:-1].decode()
    if kind == 0x03:
        return _bson(r)
    if kind == 0x04:
        return list(_bson(r).values())
    if kind == 0x05:
        n = r.unpack("<i")
        r.byte()
        return r.take(n)
    if kind == 0x07:
        return {"$oid": r.take(12).hex()}
    if kind == 0x08:
        return r.byte() == 1
    if kind == 0x09:
        return {"$date": r.unpack("<q")}
    if kind == 0x0A:
        return None
    if kind == 0x0B:
        return {"$regularExpression": {"pattern": _until(r, b"\0").decode(), "options": _until(r, b"\0").decode()}}
    if kind == 0xFF:
        return {"$minKey": 1}
    if kind == 0x7F:
        return {"$maxKey": 1}
    raise CodecError(f"unknown element type {kind:#x}")


def bson_decode(data: bytes) -> dict:
    return _whole(_bson, data)


def ejson(value, canonical: bool = False):
    """Extended JSON of a value; canonical form names every number's kind."""
    if isinstance(value, (bytes, bytearray)):
        return {"$binary": {"base64": base64.b64encode(value).decode(), "subType": "00"}}
    if isinstance(value, list):
        return [ejson(v, canonical) for v in value]
    if isinstance(value, dict):
        return {k: ejson(v, canonical) for k, v in value.items()}
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            return {"$numberDouble": "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"}
        return {"$numberDouble": repr(value)} if canonical else value
    return ({"$numberInt" if -(1 << 31) <= value < 1 << 31 else "$numberLong": str(value)}) if canonical else value


def from_ejson(value):
    if isinstance(value, list):
        return [from_ejson(v) for v in value]
    if not isinstance(value, dict):
        return value
    if set(value) == {"$binary"}:
        return base64.b64decode(value["$binary"]["base64"])
    if set(value) in ({"$numberInt"}, {"$numberLong"}):
        return int(next(iter(value.values())))
    if set(value) == {"$numberDouble"}:
        return float(value["$numberDouble"])
    return {k: from_ejson(v) for k, v in value.items()}


# -- XDR (RFC 4506) and Avro, by schema


def xdr_encode(schema: dict, v) -> bytes:
    kind = schema["type"]
    numbers = {"int": ">i", "unsigned_int": ">I", "hyper": ">q", "unsigned_hyper": ">Q", "float": ">f", "double": ">d", "enum": ">i"}
    if kind in numbers:
        return struct.pack(numbers[kind], schema["values"][v] if kind == "enum" else v)
    if kind == "boolean":
        return struct.pack(">i", bool(v))
    if kind == "void":
        return b""
    if kind in ("string", "varopaque", "opaque"):
        raw = v.encode() if isinstance(v, str) else bytes(v)
        return (b"" if kind == "opaque" else struct.pack(">I", len(raw))) + raw + b"\0" * (-len(raw) % 4)
    if kind in ("array", "vararray"):
        return (b"" if kind == "array" else struct.pack(">I", len(v))) + b"".join(xdr_encode(schema["elements"], x) for x in v)
    if kind == "optional":
        return struct.pack(">i", v is not None) + (b"" if v is None else xdr_encode(schema["element"], v))
    if kind == "struct":
        return b"".join(xdr_encode(s, v[name]) for s, name in schema["fields"])
    raise CodecError(f"unknown schema {kind}")


def xdr_decode(schema: dict, data: bytes):
    def read(s: dict):
        kind = s["type"]
        numbers = {"int": ">i", "unsigned_int": ">I", "hyper": ">q", "unsigned_hyper": ">Q", "float": ">f", "double": ">d"}
        if kind in numbers:
            return r.unpack(numbers[kind])
        if kind == "enum":
            n = r.unpack(">i")
            return next(k for k, x in s["values"].items() if x == n)
        if kind == "boolean":
            return r.unpack(">i") == 1
        if kind == "void":
            return None
        if kind in ("string", "varopaque", "opaque"):
            n = s["size"] if kind == "opaque" else r.unpack(">I")
            raw = r.take(n)
            r.take(-n % 4)
            return raw.decode() if kind == "string" else raw
        if kind in ("array", "vararray"):
            return [read(s["elements"]) for _ in range(s["size"] if kind == "array" else r.unpack(">I"))]
        if kind == "optional":
            return read(s["element"]) if r.unpack(">i") else None
        return {name: read(x) for x, name in s["fields"]}

    r = Reader(bytes(data))
    return read(schema)


def _zigzag(n: int) -> bytes:
    n = n << 1 if n >= 0 else (-n << 1) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def avro_encode(schema, v) -> bytes:
    """Binary Avro of a value by its schema: names, or dicts as in the specification."""
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, list):
        k = next(k for k, s in enumerate(kind) if avro_valid(s, v))
        return _zigzag(k) + avro_encode(kind[k], v)
    if kind == "null":
        return b""
    if kind == "boolean":
        return bytes([v])
    if kind in ("int", "long"):
        return _zigzag(v)
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", v)
    if kind in ("string", "bytes"):
        raw = v.encode() if kind == "string" else bytes(v)
        return _zigzag(len(raw)) + raw
    if kind == "fixed":
        return bytes(v)
    if kind == "enum":
        return _zigzag(schema["symbols"].index(v))
    if kind == "array":
        return (_zigzag(len(v)) + b"".join(avro_encode(schema["items"], x) for x in v) if v else b"") + b"\0"
    if kind == "map":
        return (_zigzag(len(v)) + b"".join(avro_encode("string", k) + avro_encode(schema["values"], x) for k, x in v.items()) if v else b"") + b"\0"
    return b"".join(avro_encode(f["type"] if not isinstance(f["type"], list) else {"type": f["type"]}, v[f["name"]]) for f in schema["fields"])


def avro_valid(schema, v) -> bool:
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, list):
        return any(avro_valid(s, v) for s in kind)
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    simple = {"null": v is None, "boolean": isinstance(v, bool), "int": number and isinstance(v, int) and -(1 << 31) <= v < 1 << 31, "long": number and isinstance(v, int) and -(1 << 63) <= v < 1 << 63, "float": number, "double": number, "string": isinstance(v, str), "bytes": isinstance(v, bytes)}
    if kind in simple:
        return simple[kind]
    if kind == "fixed":
        return isinstance(v, bytes) and len(v) == schema["size"]
    if kind == "enum":
        return v in schema["symbols"]
    if kind == "array":
        return isinstance(v, list) and all(avro_valid(schema["items"], x) for x in v)
    if kind == "map":
        return isinstance(v, dict) and all(avro_valid(schema["values"], x) for x in v.values())
    return isinstance(v, dict) and all(avro_valid(f["type"] if not isinstance(f["type"], list) else {"type": f["type"]}, v.get(f["name"])) for f in schema["fields"])


def avro_decode(schema, data: bytes):
    r = Reader(bytes(data))

    def long() -> int:
        shift = n = 0
        while True:
            b = r.byte()
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (n >> 1) ^ -(n & 1)

    def blocks(item: Callable) -> list:
        out = []
        while (n := long()) != 0:
            if n < 0:
                n = -n
                long()
            out += [item() for _ in range(n)]
        return out

    def read(s):
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, list):
            return read(kind[long()])
        if kind in ("float", "double"):
            return r.unpack("<f" if kind == "float" else "<d")
        if kind in ("string", "bytes"):
            raw = r.take(long())
            return raw.decode() if kind == "string" else raw
        if kind == "array":
            return blocks(lambda: read(s["items"]))
        if kind == "map":
            return dict(blocks(lambda: (read("string"), read(s["values"]))))
        if kind == "record":
            return {f["name"]: read(f["type"] if not isinstance(f["type"], list) else {"type": f["type"]}) for f in s["fields"]}
        if kind == "fixed":
            return r.take(s["size"])
        return {"null": lambda: None, "boolean": lambda: r.byte() == 1, "int": long, "long": long, "enum": lambda: s["symbols"][long()]}[kind]()

    return read(schema)


# -- framing


def record_marking_encode(record: bytes, fragment: int = 0x7FFFFFFF) -> bytes:
    """RPC record marking: a 31-bit length and a last-fragment bit before each fragment."""
    parts = [record[k : k + fragment] for k in range(0, len(record), fragment)] or [b""]
    return b"".join(struct.pack(">I", len(p) | (k == len(parts) - 1) << 31) + p for k, p in enumerate(parts))


def record_marking_stream(buffer: bytes) -> tuple[list[bytes], bytes]:
    """Whole records at the buffer's start, and what is left; empty records yield none."""
    out, at, start, record = [], 0, 0, b""
    while at + 4 <= len(buffer):
        head = struct.unpack(">I", buffer[at : at + 4])[0]
        size = head & 0x7FFFFFFF
        if at + 4 + size > len(buffer):
            break
        record += buffer[at + 4 : at + 4 + size]
        at += 4 + size
        if head >> 31:
            out += [record] if record else []
            start, record = at, b""
    return out, buffer[start:]


def websocket_encode(payload: bytes, opcode: int = 2, fin: bool = True, mask: bytes = b"") -> bytes:
    n = len(payload)
    size = bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n) if n < 1 << 16 else b"\x7f" + struct.pack(">Q", n)
    head = bytes([fin << 7 | opcode, size[0] | bool(mask) << 7]) + size[1:]
    return head + mask + (bytes(b ^ mask[k % 4] for k, b in enumerate(payload)) if mask else payload)


def websocket_stream(buffer: bytes) -> tuple[list[tuple[int, bool, bytes]], bytes]:
    """Whole frames (opcode, fin, payload) at the buffer's start, and what is left."""
    out, r = [], Reader(buffer)
    while r.at < len(buffer):
        mark = r.at
        try:
            a, b = r.byte(), r.byte()
            n = b & 127
            n = r.unpack(">H") if n == 126 else r.unpack(">Q") if n == 127 else n
            mask = r.take(4) if b >> 7 else b""
            payload = r.take(n)
        except CodecError:
            return out, buffer[mark:]
        out.append((a & 15, bool(a >> 7), bytes(x ^ mask[k % 4] for k, x in enumerate(payload)) if mask else payload))
    return out, b""


def mpint(n: int) -> bytes:
    """SSH multiple-precision integer: length and two's complement."""
    raw = b"" if n == 0 else n.to_bytes((n.bit_length() if n > 0 else (n + 1).bit_length()) // 8 + 1, "big", signed=True)
    return struct.pack(">I", len(raw)) + raw


def from_mpint(data: bytes) -> int:
    return int.from_bytes(data[4 : 4 + struct.unpack(">I", data[:4])[0]], "big", signed=True)


# -- text forms


def partial_json(text: str):
    """The value of a JSON text cut off anywhere: what was read so far."""
    for cut in range(len(text), 0, -1):
        head = text[:cut].rstrip().rstrip(",").rstrip()
        closing, quoted, escaped = [], False, False
        for c in head:
            if quoted:
                escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
            elif c == '"':
                quoted = True
            elif c in "[{":
                closing.append("]" if c == "[" else "}")
            elif c in "]}" and closing:
                closing.pop()
        for tail in (('"',) if quoted else ("",)):
            try:
                return json.loads(head + tail + "".join(reversed(closing)))
            except ValueError:
                continue
    raise CodecError("no JSON")


def wrap_binary(value):
    """Bytes inside a value as data URIs."""
    if isinstance(value, (bytes, bytearray)):
        return DATA_URI + base64.b64encode(value).decode()
    if isinstance(value, list):
        return [wrap_binary(v) for v in value]
    return {k: wrap_binary(v) for k, v in value.items()} if isinstance(value, dict) else value


def unwrap_binary(value):
    if isinstance(value, str) and value.startswith(DATA_URI):
        return base64.b64decode(value[len(DATA_URI) :])
    if isinstance(value, list):
        return [unwrap_binary(v) for v in value]
    return {k: unwrap_binary(v) for k, v in value.items()} if isinstance(value, dict) else value


def data_uri(c: Column) -> Column:
    """Data URI of a BINARY Column."""
    return F.concat(F.lit(DATA_URI), F.replace(F.base64(c), F.lit("\r\n"), F.lit("")))


def from_data_uri(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit(DATA_URI)), F.unbase64(F.substring(c, F.lit(len(DATA_URI) + 1), F.char_length(c))))


def base64_url(c: Column) -> Column:
    """URL alphabet without padding."""
    return F.rtrim(F.translate(F.replace(F.base64(c), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def from_base64_url(c: Column) -> Column:
    padded = F.concat(F.translate(c, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.char_length(c), F.lit(4))))
    return F.unbase64(padded)


#: Registered codecs of JSON values: (encode, decode).
CODECS: dict[str, tuple[Callable[[object], bytes], Callable[[bytes], object]]] = {
    "json": (lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False).encode(), lambda b: json.loads(b)),
    "cbor": (cbor_encode, cbor_decode),
    "cbor_stable": (lambda v: cbor_encode(v, True), cbor_decode),
    "msgpack": (msgpack_encode, msgpack_decode),
    "ubjson": (ubjson_encode, ubjson_decode),
    "bencode": (bencode_encode, bencode_decode),
    "resp": (resp_encode, resp_decode),
    "bson": (bson_encode, bson_decode),
}


def encode_column(text: Column, codec: str) -> Column:
    """JSON text encoded to BINARY; data URIs inside become bytes, NULL stays."""
    encode = CODECS[codec][0]

    @arrow("binary")
    def run(own: pd.Series) -> pd.Series:
        return _once_each(own, lambda t: encode(unwrap_binary(json.loads(t))))

    return run(text)


def decode_column(data: Column, codec: str) -> Column:
    """BINARY decoded to JSON text; bytes become data URIs, broken input NULL."""
    decode = CODECS[codec][1]
    dump = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode

    @arrow("string")
    def run(own: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return dump(wrap_binary(decode(bytes(raw))))
            except (CodecError, ValueError, TypeError, KeyError):
                return None

        return _once_each(own, one)

    return run(data)


def _once_each(own: pd.Series, one: Callable) -> pd.Series:
    """A function of every value, called once for each distinct one of the batch; NULL stays."""
    known: dict = {None: None}
    out = []
    for v in own:
        if v not in known:
            known[v] = one(v)
        out.append(known[v])
    return pd.Series(out, own.index, dtype=object)
