"""Binary Ion, SSH data types (RFC 4251) and ONC RPC messages (RFC 5531)."""

from __future__ import annotations

import struct

from docloom.sources.codecs import CODECS, CodecError, Reader, _whole, from_mpint

# -- Ion

# The version mark, system symbols, and kinds in the high half of a type byte.
ION_MARK = b"\xe0\x01\x00\xea"
SYSTEM_SYMBOLS = ["$ion", "$ion_1_0", "$ion_symbol_table", "name", "version", "imports", "symbols", "max_id", "$ion_shared_symbol_table"]
NULL, BOOL, UINT, NINT, FLOAT, STRING, BLOB, LIST, STRUCT, NOTE = 0, 1, 2, 3, 4, 8, 10, 11, 13, 14


def _varuint(n: int) -> bytes:
    """Seven bits a byte, high ones first; the last byte is marked."""
    out = [n & 127 | 128]
    while n := n >> 7:
        out.append(n & 127)
    return bytes(reversed(out))


def _read_varuint(r: Reader) -> int:
    n = 0
    while (b := r.byte()) < 128:
        n = n << 7 | b
    return n << 7 | b & 127


def _framed(kind: int, body: bytes) -> bytes:
    return bytes([kind << 4 | len(body)]) + body if len(body) < 14 else bytes([kind << 4 | 14]) + _varuint(len(body)) + body


def _names(value, found: dict[str, int]) -> dict[str, int]:
    """Symbol numbers of all keys, in the order of a walk."""
    if isinstance(value, dict):
        for k, v in value.items():
            found.setdefault(k, len(SYSTEM_SYMBOLS) + 1 + len(found))
            _names(v, found)
    elif isinstance(value, list):
        for v in value:
            _names(v, found)
    return found


def ion_encode(value) -> bytes:
    symbols = _names(value, {})

    def one(v) -> bytes:
        if v is None:
            return b"\x0f"
        if isinstance(v, bool):
            return bytes([BOOL << 4 | v])
        if isinstance(v, int):
            n = abs(v)
            return _framed(UINT if v >= 0 else NINT, n.to_bytes((n.bit_length() + 7) // 8, "big"))
        if isinstance(v, float):
            return _framed(FLOAT, struct.pack(">d", v))
        if isinstance(v, str):
            return _framed(STRING, v.encode())
        if isinstance(v, (bytes, bytearray)):
            return _framed(BLOB, bytes(v))
        if isinstance(v, list):
            return _framed(LIST, b"".join(map(one, v)))
        return _framed(STRUCT, b"".join(_varuint(symbols[k]) + one(x) for k, x in v.items()))

    table = b""
    if symbols:
        listed = _framed(LIST, b"".join(_framed(STRING, k.encode()) for k in symbols))
        note = _varuint(SYSTEM_SYMBOLS.index("$ion_symbol_table") + 1)
        own = _framed(STRUCT, _varuint(SYSTEM_SYMBOLS.index("symbols") + 1) + listed)
        table = _framed(NOTE, _varuint(len(note)) + note + own)
    return ION_MARK + table + one(value)


def _ion(r: Reader, symbols: list[str]):
    """One value; a symbol table extends the symbols and gives way to the next value."""
    first = r.byte()
    kind, low = first >> 4, first & 15
    if low == 15:
        return None
    if kind == BOOL:
        return bool(low)
    if kind == STRUCT and low == 1:  # ordered fields: the length follows
        low = 14
    body = Reader(r.take(_read_varuint(r) if low == 14 else low))
    if kind in (UINT, NINT):
        n = int.from_bytes(body.data, "big")
        return n if kind == UINT else -n
    if kind == FLOAT:
        return struct.unpack({0: "", 4: ">f", 8: ">d"}[low], body.data)[0] if low else 0.0
    if kind == STRING:
        return body.data.decode()
    if kind in (9, BLOB):  # clobs are bytes too
        return body.data
    if kind in (LIST, 12):
        out = []
        while body.at < len(body.data):
            out.append(_ion(body, symbols))
        return out
    if kind == STRUCT:
        own = {}
        while body.at < len(body.data):
            name = _symbol(symbols, _read_varuint(body))
            own[name] = _ion(body, symbols)
        return own
    if kind == 7:
        return _symbol(symbols, int.from_bytes(body.data, "big"))
    if kind == NOTE:
        notes = Reader(body.take(_read_varuint(body)))
        named = _symbol(symbols, _read_varuint(notes))
        value = _ion(body, symbols)
        if named == "$ion_symbol_table":
            symbols += value.get("symbols") or []
            return _ion(r, symbols)
        return value
    raise CodecError("Ion kind")


def _symbol(symbols: list[str], k: int) -> str:
    if not 0 < k <= len(symbols):
        raise CodecError("unknown symbol")
    return symbols[k - 1]


def ion_decode(data: bytes):
    if not data.startswith(ION_MARK):
        raise CodecError("no Ion version mark")
    return _whole(lambda r: _ion(r, list(SYSTEM_SYMBOLS)), data[len(ION_MARK) :])


# -- SSH


def ssh_string(value: str | bytes) -> bytes:
    raw = value.encode() if isinstance(value, str) else bytes(value)
    return struct.pack(">I", len(raw)) + raw


def ssh_encode(value) -> bytes:
    """Booleans, integers of 4 or 8 bytes, strings, and lists of names; nothing else."""
    if isinstance(value, bool):
        return bytes([value])
    if isinstance(value, int):
        return struct.pack(">I", value) if 0 <= value < 1 << 32 else struct.pack(">Q", value % (1 << 64))
    if isinstance(value, (str, bytes, bytearray)):
        return ssh_string(value)
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return ssh_string(bytes(c & 127 for c in ",".join(value).encode()))
    raise CodecError("no SSH type")


def ssh_decode(kinds: list[str], data: bytes) -> list:
    """Values of the named kinds: boolean, byte, uint32, uint64, string, binary, mpint, names."""

    def one(r: Reader, kind: str):
        if kind in ("boolean", "byte"):
            b = r.byte()
            return bool(b) if kind == "boolean" else b
        if kind in ("uint32", "uint64"):
            return r.unpack(">I" if kind == "uint32" else ">Q")
        raw = r.take(r.unpack(">I"))
        if kind == "names":
            return raw.decode("ascii").split(",") if raw else []
        return from_mpint(ssh_string(raw)) if kind == "mpint" else raw if kind == "binary" else raw.decode()

    return _whole(lambda r: [one(r, k) for k in kinds], data)


# -- ONC RPC

RPC_VERSION = 2
LARGEST_AUTH = 400


def _auth(own: dict | None) -> bytes:
    own = own or {"flavor": 0, "body": b""}
    body = own["body"]
    if len(body) > LARGEST_AUTH:
        raise CodecError("credential too long")
    return struct.pack(">II", own["flavor"], len(body)) + body + bytes(-len(body) % 4)


def _read_auth(r: Reader) -> dict:
    flavor, n = r.unpack(">I"), r.unpack(">I")
    if n > LARGEST_AUTH:
        raise CodecError("credential too long")
    body = r.take(n)
    r.take(-n % 4)
    return {"flavor": flavor, "body": body}


def rpc_encode(m: dict) -> bytes:
    """A call, accepted or denied reply, told apart by ``type``."""
    if m["type"] == "call":
        head = struct.pack(">6I", m["xid"], 0, RPC_VERSION, m["prog"], m["vers"], m["proc"])
        return head + _auth(m.get("cred")) + _auth(m.get("verf")) + m.get("params", b"")
    bounds = struct.pack(">II", *m["mismatch"]) if m.get("mismatch") else b""
    if m["type"] == "accepted":
        return struct.pack(">III", m["xid"], 1, 0) + _auth(m.get("verf")) + struct.pack(">I", m["stat"]) + bounds + m.get("results", b"")
    tail = bounds if m["stat"] == 0 else struct.pack(">I", m["auth_stat"]) if m.get("auth_stat") is not None else b""
    return struct.pack(">IIII", m["xid"], 1, 1, m["stat"]) + tail


def _rpc(r: Reader) -> dict:
    xid, reply = r.unpack(">I"), r.unpack(">I")
    if reply == 0:
        if r.unpack(">I") != RPC_VERSION:
            raise CodecError("RPC version")
        prog, vers, proc = (r.unpack(">I") for _ in range(3))
        return {"type": "call", "xid": xid, "prog": prog, "vers": vers, "proc": proc, "cred": _read_auth(r), "verf": _read_auth(r), "params": _rest(r)}
    if reply != 1:
        raise CodecError("RPC message type")
    denied = r.unpack(">I")
    if denied > 1:
        raise CodecError("RPC reply state")
    if not denied:
        verf, stat = _read_auth(r), r.unpack(">I")
        mismatch = [r.unpack(">I"), r.unpack(">I")] if stat == 2 else None
        return {"type": "accepted", "xid": xid, "verf": verf, "stat": stat, "mismatch": mismatch, "results": _rest(r)}
    stat = r.unpack(">I")
    own: dict = {"type": "denied", "xid": xid, "stat": stat}
    return own | ({"mismatch": [r.unpack(">I"), r.unpack(">I")]} if stat == 0 else {"auth_stat": r.unpack(">I")})


def _rest(r: Reader) -> bytes:
    return r.take(len(r.data) - r.at)


def rpc_decode(data: bytes) -> dict:
    return _whole(_rpc, data)


CODECS.update({"ion": (ion_encode, ion_decode), "rpc": (rpc_encode, rpc_decode)})
