"""Structural forms of whole replicated documents: binary, compact, compact binary, verbose.

A document is read into nested nodes first: (kind, id, content), ids as (time, session).
Content is () or ("value", v) or ("ref", id) of a constant, the child of a register, pairs
of an object, cells of a tuple, and runs (id, text, bytes, children or a deleted length) of
a sequence. What the root does not reach is not written.
"""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import arrow
from docloom.operators.crdt import ORIGIN, UNDEFINED, Model, Sequence, folded, from_units, spread, units
from docloom.operators.edit import history, pair, snapshot
from docloom.sources.codecs import CodecError, Reader, _cbor, _cbor_head, _whole, cbor_decode, cbor_encode
from docloom.sources.patches import SERVER, _constant, _text, _undefined_or, b1vu56, read_b1vu56, read_relative_id, read_vu57, relative_id, vu57

# Kinds by their number, the top three bits of a node's byte.
KINDS = ["con", "val", "obj", "vec", "str", "bin", "arr"]
SYSTEM = 0
MISSING = b"\0"

Node = tuple


def tree(model: Model, node: tuple[int, int] | None = None) -> Node | None:
    """Nested nodes from a node, or from the root."""
    node = model.slots[ORIGIN].get("value") if node is None else node
    if node is None:
        return None
    kind = model.kind[node]
    if kind == "con":
        own = model.con[node]
        return (kind, node, () if own is UNDEFINED else ("ref", own) if isinstance(own, tuple) else ("value", own))
    if kind == "val":
        child = model.slots[node].get("value")
        return (kind, node, child and tree(model, child))
    if kind == "obj":
        return (kind, node, [(k, tree(model, c)) for k, c in model.slots[node].items()])
    if kind == "vec":
        slots = model.slots[node]
        return (kind, node, [tree(model, slots[k]) if k in slots else None for k in range(max(slots, default=-1) + 1)])
    own, runs = model.seq[node], []
    last = None
    for i in own.order(node):
        dead = i in own.dead
        if last is not None and last == ((i[0] - 1, i[1]), dead):
            runs[-1][1].append(i)
        else:
            runs.append((dead, [i]))
        last = (i, dead)
    return (kind, node, [(ids[0], len(ids) if dead else _items(model, kind, own, ids)) for dead, ids in runs])


def _items(model: Model, kind: str, own: Sequence, ids: list):
    items = [own.items[i] for i in ids]
    return from_units(items) if kind == "str" else bytes(items) if kind == "bin" else [tree(model, c) for c in items]


def build(root: Node | None, clock: dict[int, int]) -> Model:
    model = Model()
    model.clock = dict(clock)

    def add(own: Node) -> tuple[int, int]:
        kind, at, content = own
        model.kind[at] = kind
        if kind == "con":
            model.con[at] = content[1] if content else UNDEFINED
        elif kind == "val":
            model.slots[at] = {"value": add(content)} if content else {}
        elif kind in ("obj", "vec"):
            pairs = content if kind == "obj" else enumerate(content)
            model.slots[at] = {k: add(c) for k, c in pairs if c is not None}
        else:
            model.seq[at] = _sequence(at, content, add, kind)
        return at

    if root is not None:
        model.slots[ORIGIN]["value"] = add(root)
    return model


def _sequence(root: tuple[int, int], runs: list, add, kind: str) -> Sequence:
    """A sequence of known order: an element hangs on the nearest older one before it.

    Siblings then stand newest first, as the order asks, and a later insert that passes over
    newer elements stops where it would have stopped with the true parents.
    """
    seq, path = Sequence(), [root]
    for (time, sid), items in runs:
        dead = isinstance(items, int)
        values = [ORIGIN if kind == "arr" else 0] * items if dead else units(items) if kind == "str" else list(items) if kind == "bin" else [add(c) for c in items]
        for k, value in enumerate(values):
            at = (time + k, sid)
            while len(path) > 1 and path[-1] > at:
                path.pop()
            seq.children.setdefault(path[-1], []).append(at)
            seq.items[at] = value
            if dead:
                seq.dead.add(at)
            path.append(at)
    return seq


class Clock:
    """Ids as a session's place in a table, filled as ids come, and a distance to its last tick."""

    def __init__(self, clock: dict[int, int], sid: int):
        self.clock, self.last = clock, max(clock.values(), default=0)
        self.table: dict[int, tuple[int, int]] = {sid: (1, self.last)}

    def relative(self, at: tuple[int, int]) -> tuple[int, int]:
        time, sid = at
        place, last = self.table.setdefault(sid, (len(self.table) + 1, self.clock.get(sid, self.last)))
        if time > last:
            raise CodecError("TIME_TRAVEL")
        return place, last - time

    def flat(self) -> list[int]:
        return [x for sid, (_, last) in self.table.items() for x in (sid, last)]


def _absolute(flat: list[int], place: int, back: int) -> tuple[int, int]:
    if not 0 < place <= len(flat) // 2:
        raise CodecError("unknown session")
    return (flat[2 * place - 1] - back, flat[2 * place - 2])


def _clock(flat: list[int]) -> dict[int, int]:
    return dict(zip(flat[::2], flat[1::2], strict=True))


def local_session(model: Model) -> int:
    """The session that ticked last."""
    return max(model.clock, key=lambda s: (model.clock[s], s), default=SERVER)


# -- verbose


def verbose_encode(model: Model, sid: int | None = None) -> dict:
    sid = local_session(model) if sid is None else sid
    now = max(model.clock.values(), default=0) + 1

    def at(i):
        return i[0] if i[1] == SERVER else pair(i)

    def one(own: Node | None) -> dict:
        if own is None:
            return {"type": "con", "id": [0, 0]}
        kind, i, content = own
        head = {"type": kind, "id": at(i)}
        if kind == "con":
            if not content:
                return head
            return head | ({"timestamp": True, "value": at(content[1])} if content[0] == "ref" else {"value": content[1]})
        if kind == "val":
            return head | {"value": one(content)}
        if kind == "obj":
            return head | {"map": {k: one(c) for k, c in content}}
        if kind == "vec":
            return head | {"map": [c and one(c) for c in content]}
        runs = []
        for run, items in content:
            value = items if kind == "str" else base64.b64encode(items).decode() if kind == "bin" and isinstance(items, bytes) else items
            runs.append({"id": at(run)} | ({"span": items} if isinstance(items, int) else {"value": [one(c) for c in items] if kind == "arr" else value}))
        return head | {"chunks": runs}

    root = tree(model)
    time = now if sid == SERVER else [[sid, now], *([s, t] for s, t in model.clock.items() if s != sid)]
    return {"time": time, "root": {"type": "val", "id": at(root[1]) if root else [0, 0], "value": one(root)}}


def verbose_decode(form: dict) -> Model:
    def at(x) -> tuple[int, int]:
        return (x[1], x[0]) if isinstance(x, list) else (x, SERVER)

    def one(own: dict | None) -> Node | None:
        if own is None or own["id"] == [0, 0]:
            return None
        kind, i = own["type"], at(own["id"])
        if kind == "con":
            return (kind, i, ("ref", at(own["value"])) if own.get("timestamp") else ("value", own["value"]) if "value" in own else ())
        if kind == "val":
            return (kind, i, one(own["value"]))
        if kind == "obj":
            return (kind, i, [(k, one(c)) for k, c in own["map"].items()])
        if kind == "vec":
            return (kind, i, [one(c) for c in own["map"]])
        read = {"str": str, "bin": base64.b64decode, "arr": lambda v: [one(c) for c in v]}[kind]
        return (kind, i, [(at(r["id"]), r["span"] if "span" in r else read(r["value"])) for r in own["chunks"]])

    time = form["time"]
    clock = {SERVER: time - 1} if isinstance(time, int) else {time[0][0]: time[0][1] - 1, **{s: t for s, t in time[1:]}}
    return build(one(form["root"]["value"]), clock)


# -- compact


def compact_encode(model: Model, sid: int | None = None) -> list:
    """[clock, root]; the server's clock is one number and its ids are distances."""
    sid = local_session(model) if sid is None else sid
    table, now = Clock(model.clock, sid), max(model.clock.values(), default=0) + 1

    def at(i):
        if i[1] == SYSTEM:
            return pair(i)
        if sid == SERVER:
            return now - i[0]
        place, back = table.relative(i)
        return [-place, back]

    def one(own: Node | None):
        if own is None:
            return 0
        kind, i, content = own
        head = [KINDS.index(kind), at(i)]
        if kind == "con":
            return head + ([0, 0] if not content else [0, at(content[1])] if content[0] == "ref" else [content[1]])
        if kind == "val":
            return [*head, content and one(content)]
        if kind == "obj":
            return [*head, {k: one(c) for k, c in sorted(content)}]
        if kind == "vec":
            return [*head, [one(c) for c in content]]
        return [*head, [[at(run), [one(c) for c in items] if kind == "arr" and not isinstance(items, int) else list(items) if isinstance(items, bytes) else items] for run, items in content]]

    root = one(tree(model))
    return [now if sid == SERVER else table.flat(), root]


def compact_decode(form: list) -> Model:
    clock, root = form

    def at(x) -> tuple[int, int]:
        if not isinstance(x, list):
            return (clock - x, SERVER)
        return _absolute(clock, -x[0], x[1]) if x[0] < 0 else (x[1], x[0])

    def one(own) -> Node | None:
        if not own:
            return None
        kind, i = KINDS[own[0]], at(own[1])
        if kind == "con":
            return (kind, i, ("value", own[2]) if len(own) == 3 else ("ref", at(own[3])) if own[3] else ())
        if kind == "val":
            return (kind, i, one(own[2]))
        if kind == "obj":
            return (kind, i, [(k, one(c)) for k, c in own[2].items()])
        if kind == "vec":
            return (kind, i, [one(c) for c in own[2]])
        return (kind, i, [(at(run), items if isinstance(items, (int, str)) else bytes(items) if kind == "bin" else [one(c) for c in items]) for run, items in own[2]])

    return build(one(root), {SERVER: clock - 1} if isinstance(clock, int) else _clock(clock))


# -- binary


def binary_encode(model: Model, sid: int | None = None) -> bytes:
    sid = local_session(model) if sid is None else sid
    table = Clock(model.clock, sid)

    def at(i) -> bytes:
        return vu57(i[0]) if sid == SERVER else relative_id(*table.relative(i))

    def head(kind: str, n: int) -> bytes:
        major = KINDS.index(kind) << 5
        return bytes([major | n]) if n < 31 else bytes([major | 31]) + vu57(n)

    def one(own: Node | None) -> bytes:
        if own is None:
            return MISSING
        kind, i, content = own
        first = at(i)  # sessions join the table in the order of their ids
        if kind == "con":
            if content and content[0] == "ref":
                return first + b"\x01" + at(content[1])
            return first + b"\0" + (_constant(content[1]) if content else b"\xf7")
        if kind == "val":
            return first + head(kind, 0) + one(content)
        if kind == "obj":
            return first + head(kind, len(content)) + b"".join(_text(k) + one(c) for k, c in content)
        if kind == "vec":
            return first + head(kind, len(content)) + b"".join(map(one, content))
        return first + head(kind, len(content)) + b"".join(at(run) + part(kind, items) for run, items in content)

    def part(kind: str, items) -> bytes:
        dead = isinstance(items, int)
        if kind == "str":
            return _cbor_head(0, items) if dead else _text(items)
        if dead:
            return b1vu56(1, items)
        return b1vu56(0, len(items)) + (items if kind == "bin" else b"".join(map(one, items)))

    body = one(tree(model))
    if sid == SERVER:
        return b"\x80" + vu57(max(model.clock.values(), default=0) + 1) + body
    flat = table.flat()
    return len(body).to_bytes(4, "big") + body + vu57(len(flat) // 2) + b"".join(map(vu57, flat))


def binary_decode(data: bytes) -> Model:
    data = bytes(data)
    if data[:1] >= b"\x80":
        r = Reader(data[1:])
        now = read_vu57(r)
        return _whole(lambda own: build(_binary(own, lambda: (read_vu57(own), SERVER)), {SERVER: now - 1}), r.data[r.at :])
    r = Reader(data)
    body = Reader(r.take(r.unpack(">I")))
    flat = [read_vu57(r) for _ in range(2 * read_vu57(r))]
    if r.at != len(data):
        raise CodecError("bytes left over")
    return _whole(lambda own: build(_binary(own, lambda: _absolute(flat, *read_relative_id(own))), _clock(flat)), body.data)


def _binary(r: Reader, at) -> Node | None:
    if r.data[r.at : r.at + 1] == MISSING:
        r.byte()
        return None
    i, b = at(), r.byte()
    if b >> 5 >= len(KINDS):
        raise CodecError("unknown node")
    kind, n = KINDS[b >> 5], b & 31
    if kind == "con":
        return (kind, i, ("ref", at()) if n else ("value", *own) if (own := _undefined_or(r)) else ())
    if kind == "val":
        return (kind, i, _binary(r, at))
    n = read_vu57(r) if n == 31 else n
    if kind == "obj":
        return (kind, i, [(_cbor(r), _binary(r, at)) for _ in range(n)])
    if kind == "vec":
        return (kind, i, [_binary(r, at) for _ in range(n)])
    runs = []
    for _ in range(n):
        run = at()
        if kind == "str":
            runs.append((run, _cbor(r)))
        else:
            dead, size = read_b1vu56(r)
            runs.append((run, size if dead else r.take(size) if kind == "bin" else [_binary(r, at) for _ in range(size)]))
    return (kind, i, runs)


def _json(value) -> bytes:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()


#: Forms of a document: (encode a model, decode to a model).
FORMS = {
    "binary": (binary_encode, binary_decode),
    "compact": (lambda m: _json(compact_encode(m)), lambda b: compact_decode(json.loads(b))),
    "compact_binary": (lambda m: cbor_encode(compact_encode(m)), lambda b: compact_decode(cbor_decode(b))),
    "verbose": (lambda m: _json(verbose_encode(m)), lambda b: verbose_decode(json.loads(b))),
}


# -- over tables


def encode_documents(patches: DataFrame, doc: str, patch: str, form: str) -> DataFrame:
    """Each document's state, after all its patches, as BINARY ``state`` of a form."""
    return encode_forms(patches, doc, patch, [form]).withColumnRenamed(form, "state")


def encode_forms(patches: DataFrame, doc: str, patch: str, forms: list[str]) -> DataFrame:
    """Each document's state in several forms, a BINARY column each, from one fold."""

    def fold(names: tuple, rows: list[tuple]) -> list[tuple]:
        model = history(json.loads(p) for (p,) in rows if p is not None)
        return [tuple(FORMS[form][0](model) for form in forms)]

    return folded(patches.select(doc, patch), [doc], fold, ", ".join(f"{form} binary" for form in forms))


def view_column(state: Column, form: str) -> Column:
    """JSON view of an encoded document; NULL for broken and empty ones."""
    decode = FORMS[form][1]

    def view(raw):
        try:
            own = UNDEFINED if raw is None else decode(bytes(raw)).view()
        except (CodecError, ValueError, KeyError, IndexError, TypeError):
            return None
        return None if own is UNDEFINED else json.dumps(own, separators=(",", ":"), ensure_ascii=False)

    @arrow("string")
    def run(states: pd.Series) -> pd.Series:
        return states.map(view)

    return run(state)


def document_views(states: DataFrame, doc: str, state: str, form: str) -> DataFrame:
    """JSON views of encoded documents, row by row; NULL for broken and empty ones."""
    return states.select(doc, view_column(F.col(state), form).alias("view"))


def node_rows(patches: DataFrame, doc: str, patch: str) -> DataFrame:
    """One row a node (doc, kind, sid, time, body as JSON text): the indexed form as a table.

    A partial edit reads the nodes its operations name by a semi join and writes them back.
    """
    kind = patches.schema[doc].dataType.simpleString()

    def fold(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = snapshot(history(json.loads(p) for p in rows[patch].dropna()))["nodes"]
        return pd.DataFrame([(names[0], k, *i, json.dumps(body, separators=(",", ":"), ensure_ascii=False)) for k, i, body in nodes], columns=[doc, "kind", "sid", "time", "body"])

    return spread(patches.select(doc, patch), doc).groupBy(doc).applyInPandas(fold, f"{doc} {kind}, kind string, sid long, time long, body string")


def touched_nodes(nodes: DataFrame, operations: DataFrame, doc: str) -> DataFrame:
    """Nodes that operation rows (doc, body) write into."""
    obj = F.from_json(F.get_json_object("body", "$.obj"), "array<bigint>")
    named = operations.select(doc, obj[0].alias("sid"), obj[1].alias("time")).filter("sid IS NOT NULL")
    return nodes.join(named, [doc, "sid", "time"], "left_semi")
