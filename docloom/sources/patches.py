"""Binary, compact and verbose forms of a replicated document's patches.

The readable form is that of ``docloom.operators.crdt``. The codecs are registered beside
those of plain values, so ``encode_column`` and ``decode_column`` take their names.
"""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import arrow
from docloom.operators.crdt import span, units
from docloom.sources.codecs import CODECS, CodecError, Reader, _cbor, _cbor_head, _whole, cbor_decode, cbor_encode

# Operation codes of the binary and compact forms.
CODES = {"new_con": 0, "new_val": 1, "new_obj": 2, "new_vec": 3, "new_str": 4, "new_bin": 5, "new_arr": 6, "ins_val": 9, "ins_obj": 10, "ins_vec": 11, "ins_str": 12, "ins_bin": 13, "ins_arr": 14, "upd_arr": 15, "del": 16, "nop": 17}
NAMES = {code: name for name, code in CODES.items()}
UNDEFINED = b"\xf7"
SERVER = 1


def vu57(n: int) -> bytes:
    """Seven bits a byte, low ones first; an eighth byte holds eight."""
    return _groups(n, 7)


def _groups(n: int, most: int) -> bytes:
    out = bytearray()
    while n > 127 and len(out) < most:
        out.append(n & 127 | 128)
        n >>= 7
    if n > 255 or n > 127 and len(out) < most:
        raise CodecError("integer too large")
    return bytes([*out, n])


def read_vu57(r: Reader, most: int = 7) -> int:
    n = shift = 0
    for k in range(most + 1):
        b = r.byte()
        if k == most or b < 128:
            return n | b << shift
        n |= (b & 127) << shift
        shift += 7
    raise CodecError("varint")


def b1vu56(flag: int, n: int) -> bytes:
    """A flag, six bits, and groups as above."""
    if n < 64:
        return bytes([flag << 7 | n])
    return bytes([flag << 7 | 64 | n & 63]) + _groups(n >> 6, 6)


def read_b1vu56(r: Reader) -> tuple[int, int]:
    b = r.byte()
    low = b & 63
    return b >> 7, low | read_vu57(r, 6) << 6 if b & 64 else low


def relative_id(session: int, back: int) -> bytes:
    """An id as a session's index and a distance, in a byte where both are small."""
    return bytes([session << 4 | back]) if session < 8 and back < 16 else b1vu56(1, session) + vu57(back)


def read_relative_id(r: Reader) -> tuple[int, int]:
    if r.data[r.at : r.at + 1] < b"\x80":
        b = r.byte()
        return b >> 4, b & 15
    return read_b1vu56(r)[1], read_vu57(r)


def _text(value: str) -> bytes:
    """CBOR text whose head has room for four bytes a unit."""
    raw, room = value.encode(), 4 * len(units(value))
    if room < 24:
        return bytes([96 | len(raw)]) + raw
    mark, width = (0x78, 1) if room < 1 << 8 else (0x79, 2) if room < 1 << 16 else (0x7A, 4)
    return bytes([mark]) + len(raw).to_bytes(width, "big") + raw


def _constant(value) -> bytes:
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, list):
        return _cbor_head(4, len(value)) + b"".join(map(_constant, value))
    if isinstance(value, dict):
        return _cbor_head(5, len(value)) + b"".join(_text(k) + _constant(v) for k, v in value.items())
    return cbor_encode(value)


# -- binary


def binary_encode(patch: dict) -> bytes:
    own, start = patch["id"]

    def at(pair) -> bytes:
        return b1vu56(0, pair[1]) if pair[0] == own else b1vu56(1, pair[1]) + vu57(pair[0])

    def head(name: str, n: int) -> bytes:
        return bytes([CODES[name] << 3 | n]) if n < 8 else bytes([CODES[name] << 3]) + vu57(n)

    def one(op: dict) -> bytes:
        name = op["op"]
        if name == "new_con":
            if "timestamp" in op:
                return b"\x01" + at(op["timestamp"])
            return b"\0" + (_constant(op["value"]) if "value" in op else UNDEFINED)
        if name.startswith("new_"):
            return bytes([CODES[name] << 3])
        if name == "nop":
            return head(name, op.get("len", 1))
        if name == "ins_val":
            return head(name, 0) + at(op["obj"]) + at(op["value"])
        if name == "upd_arr":
            return head(name, 0) + at(op["obj"]) + at(op["ref"]) + at(op["value"])
        if name == "del":
            return head(name, len(op["what"])) + at(op["obj"]) + b"".join(at(w) + vu57(w[2]) for w in op["what"])
        if name in ("ins_obj", "ins_vec"):
            return head(name, len(op["value"])) + at(op["obj"]) + b"".join((_text(k) if name == "ins_obj" else bytes([k])) + at(v) for k, v in op["value"])
        items = op["value"].encode() if name == "ins_str" else bytes(op["value"]) if name == "ins_bin" else op["values"]
        tail = items if name != "ins_arr" else b"".join(map(at, items))
        return head(name, len(items)) + at(op["obj"]) + at(op["after"]) + tail

    meta = b"\x81" + _constant(patch["meta"]) if "meta" in patch else UNDEFINED
    return vu57(own) + vu57(start) + meta + vu57(len(patch["ops"])) + b"".join(map(one, patch["ops"]))


def _patch(r: Reader) -> dict:
    own, start = read_vu57(r), read_vu57(r)
    patch: dict = {"id": [own, start], "ops": []}
    meta = _undefined_or(r)
    if meta:
        patch["meta"] = meta[0][0]

    def at() -> list[int]:
        other, time = read_b1vu56(r)
        return [read_vu57(r) if other else own, time]

    def one() -> dict:
        b = r.byte()
        name, n = NAMES.get(b >> 3), b & 7
        if name is None:
            raise CodecError("unknown operation")
        if name == "new_con":
            if n:
                return {"op": name, "timestamp": at()}
            value = _undefined_or(r)
            return {"op": name, "value": value[0]} if value else {"op": name}
        if name.startswith("new_"):
            return {"op": name}
        if name == "ins_val":
            return {"op": name, "obj": at(), "value": at()}
        if name == "upd_arr":
            return {"op": name, "obj": at(), "ref": at(), "value": at()}
        n = n or read_vu57(r)
        if name == "nop":
            return {"op": name, "len": n}
        op: dict = {"op": name, "obj": at()}
        if name == "del":
            op["what"] = [[*at(), read_vu57(r)] for _ in range(n)]
        elif name in ("ins_obj", "ins_vec"):
            op["value"] = [[_cbor(r) if name == "ins_obj" else r.byte(), at()] for _ in range(n)]
        else:
            op["after"] = at()
            if name == "ins_arr":
                op["values"] = [at() for _ in range(n)]
            else:
                raw = r.take(n)
                op["value"] = raw.decode() if name == "ins_str" else list(raw)
        return op

    patch["ops"] += [one() for _ in range(read_vu57(r))]
    return patch


def _undefined_or(r: Reader) -> tuple:
    """The next CBOR value in a tuple; an empty one for undefined."""
    if r.data[r.at : r.at + 1] == UNDEFINED:
        r.byte()
        return ()
    return (_cbor(r),)


def binary_decode(data: bytes) -> dict:
    return _whole(_patch, data)


# -- JSON forms


def compact_encode(patch: dict) -> list:
    own, start = patch["id"]

    def at(pair):
        return pair[1] if pair[0] == own else list(pair)

    def one(op: dict) -> list:
        name = op["op"]
        out: list = [CODES[name]]
        if name == "new_con":
            return out + ([at(op["timestamp"]), True] if "timestamp" in op else [op["value"]] if "value" in op else [])
        if name == "nop":
            return out + ([op["len"]] if op.get("len", 1) > 1 else [])
        out += [at(op[k]) for k in ("obj", "after", "ref") if k in op]
        if name == "del":
            out.append([w[1:] if w[0] == own else w for w in op["what"]])
        elif name in ("ins_val", "upd_arr"):
            out.append(at(op["value"]))
        elif name in ("ins_obj", "ins_vec"):
            out.append([[k, at(v)] for k, v in op["value"]])
        elif name == "ins_arr":
            out.append([at(v) for v in op["values"]])
        elif name in ("ins_str", "ins_bin"):
            out.append(op["value"] if name == "ins_str" else base64.b64encode(bytes(op["value"])).decode())
        return out

    first = start if own == SERVER else [own, start]
    return [[first, patch["meta"]] if "meta" in patch else [first], *map(one, patch["ops"])]


def compact_decode(form: list) -> dict:
    (first, *meta), *rows = form
    own, start = first if isinstance(first, list) else (SERVER, first)

    def at(x) -> list[int]:
        return list(x) if isinstance(x, list) else [own, x]

    def one(row: list) -> dict:
        name, args = NAMES[row[0]], row[1:]
        if name == "new_con":
            return {"op": name, "timestamp": at(args[0])} if len(args) > 1 else {"op": name, "value": args[0]} if args else {"op": name}
        if name.startswith("new_"):
            return {"op": name}
        if name == "nop":
            return {"op": name, "len": args[0] if args else 1}
        op: dict = {"op": name, "obj": at(args[0])}
        last = args[-1]
        if name == "del":
            return op | {"what": [w if len(w) == 3 else [own, *w] for w in last]}
        if name in ("ins_obj", "ins_vec"):
            return op | {"value": [[k, at(v)] for k, v in last]}
        if name == "ins_val":
            return op | {"value": at(last)}
        if name == "upd_arr":
            return op | {"ref": at(args[1]), "value": at(last)}
        op["after"] = at(args[1])
        if name == "ins_arr":
            return op | {"values": [at(v) for v in last]}
        return op | {"value": last if name == "ins_str" else list(base64.b64decode(last))}

    patch = {"id": [own, start], "ops": [one(r) for r in rows]}
    return patch | {"meta": meta[0]} if meta else patch


_IDS = ("obj", "after", "ref")


def verbose_encode(patch: dict) -> dict:
    """Ids of the server's session become bare times, references are flagged, bytes base64."""

    def at(pair):
        return pair[1] if pair[0] == SERVER else list(pair)

    def one(op: dict) -> dict:
        name = op["op"]
        out = {k: at(v) if k in _IDS else v for k, v in op.items()}
        if name == "new_con":
            return {"op": name, "timestamp": True, "value": at(op["timestamp"])} if "timestamp" in op else {"op": name, "value": op.get("value")}
        if name == "nop" and op.get("len", 1) == 1:
            return {"op": name}
        if name in ("ins_val", "upd_arr"):
            out["value"] = at(op["value"])
        elif name in ("ins_obj", "ins_vec"):
            out["value"] = [[k, at(v)] for k, v in op["value"]]
        elif name == "ins_arr":
            out["values"] = [at(v) for v in op["values"]]
        elif name == "ins_bin":
            out["value"] = base64.b64encode(bytes(op["value"])).decode()
        return out

    return {**patch, "ops": [one(op) for op in patch["ops"]]}


def verbose_decode(form: dict) -> dict:
    def at(x) -> list[int]:
        return list(x) if isinstance(x, list) else [SERVER, x]

    def one(op: dict) -> dict:
        name = op["op"]
        out = {k: at(v) if k in _IDS else v for k, v in op.items()}
        if name == "new_con" and op.get("timestamp"):
            return {"op": name, "timestamp": at(op["value"])}
        if name == "nop":
            return {"op": name, "len": op.get("len", 1)}
        if name in ("ins_val", "upd_arr"):
            out["value"] = at(op["value"])
        elif name in ("ins_obj", "ins_vec"):
            out["value"] = [[k, at(v)] for k, v in op["value"]]
        elif name == "ins_arr":
            out["values"] = [at(v) for v in op["values"]]
        elif name == "ins_bin":
            out["value"] = list(base64.b64decode(op["value"]))
        return out

    return {**form, "id": at(form["id"]), "ops": [one(op) for op in form["ops"]]}


def _json(value) -> bytes:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()


CODECS.update(
    {
        "patch_binary": (binary_encode, binary_decode),
        "patch_compact": (lambda p: _json(compact_encode(p)), lambda b: compact_decode(json.loads(b))),
        "patch_compact_binary": (lambda p: cbor_encode(compact_encode(p)), lambda b: compact_decode(cbor_decode(b))),
        "patch_verbose": (lambda p: _json(verbose_encode(p)), lambda b: verbose_decode(json.loads(b))),
    }
)


def operations(patch: Column) -> Column:
    """Operations of a patch (JSON text) with their ids and ticks; explode it for rows."""

    @arrow("array<struct<sid:long,time:long,span:long,op:string,body:string>>")
    def run(own: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            value, out = json.loads(text), []
            sid, time = value["id"]
            for op in value["ops"]:
                out.append({"sid": sid, "time": time, "span": span(op), "op": op["op"], "body": json.dumps(op, separators=(",", ":"), ensure_ascii=False)})
                time += span(op)
            return out

        return own.map(one)

    return run(patch)


def operation_rows(patches: DataFrame, patch: str) -> DataFrame:
    """One row an operation, in place of the patch; rows stay in their partitions."""
    found = patches.withColumn("_op", F.explode(operations(F.col(patch))))
    return found.select(*[c for c in patches.columns if c != patch], "_op.*")
