"""Editing replicated documents: local edits, merges towards a value, JSON Patch, undo, logs.

Edits of a document depend on one another, so each document is one fold; the table forms
group by document and return the patches that the edits amount to.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.json_utils import base36
from docloom.operators import patch as json_patch
from docloom.operators.crdt import ORIGIN, UNDEFINED, Builder, Model, Sequence, folded, from_units, span, spread, units
from docloom.operators.diff import script

SEQUENCES = ("str", "bin", "arr")


class EditError(ValueError):
    """A path that leads nowhere, or an edit that its node does not take."""


def pair(at: tuple[int, int]) -> list[int]:
    """[session, time] of an id."""
    return [at[1], at[0]]


def spans(ids: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Ids as [session, time, length], neighbours joined."""
    out: list[list[int]] = []
    for time, sid in ids:
        if out and out[-1][0] == sid and out[-1][1] + out[-1][2] == time:
            out[-1][2] += 1
        else:
            out.append([sid, time, 1])
    return out


class Editor:
    """Edits of one session; each takes effect in the model and joins the pending patch."""

    def __init__(self, model: Model, sid: int):
        self.model, self.sid = model, sid
        self.builder = Builder(sid, max(model.clock.values(), default=0) + 1)
        self.done, self.time = 0, self.builder.time
        self.order: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def live(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        """Live elements in order; kept up to date by own edits, which are newer than all there is."""
        if node not in self.order:
            self.order[node] = self.model.seq[node].live(node)
        return self.order[node]

    def apply(self) -> None:
        for op in self.builder.ops[self.done :]:
            self.model.apply(op, (self.time, self.sid))
            self.time += span(op)
        self.done = len(self.builder.ops)

    def flush(self) -> dict | None:
        """The edits since the last flush as a patch, if any."""
        self.apply()
        self.done = 0
        return self.builder.flush() if self.builder.ops else None

    def _op(self, name: str, **fields) -> None:
        self.builder.add(name, **fields)
        self.apply()

    def value(self, value) -> list[int]:
        """Containers become nodes, the rest constants."""
        return self.builder.json(value) if isinstance(value, (list, dict)) else self.builder.add("new_con", value=value)

    # finding

    def find(self, path: Iterable = (), start: tuple[int, int] = ORIGIN) -> tuple[int, int]:
        """Node at a path of keys and positions; registers on the way are passed through."""
        node = self._through(start)
        for step in path:
            kind = self.model.kind[node]
            if kind == "obj":
                child = self.model.slots[node].get(str(step))
            elif kind == "vec":
                child = self.model.slots[node].get(int(step))
            elif kind == "arr":
                live = self.live(node)
                child = self.model.seq[node].items[live[int(step)]] if 0 <= int(step) < len(live) else None
            else:
                child = None
            if child is None or self.model.view(child) is UNDEFINED:
                raise EditError("NOT_FOUND")
            node = self._through(child)
        return node

    def _through(self, node: tuple[int, int]) -> tuple[int, int]:
        while node == ORIGIN or self.model.kind.get(node) == "val":
            child = self.model.slots[node].get("value")
            if child is None:
                raise EditError("NOT_FOUND")
            node = child
        return node

    def typed(self, path: Iterable, *kinds: str) -> tuple[int, int]:
        node = self.find(path)
        if self.model.kind[node] not in kinds:
            raise EditError("NOT_" + "_OR_".join(kinds).upper())
        return node

    def size(self, path: Iterable = ()) -> int:
        node = self.typed(path, *SEQUENCES, "vec")
        return len(self.live(node)) if node in self.model.seq else max(self.model.slots[node], default=-1) + 1

    # edits

    def set_root(self, value) -> None:
        self._op("ins_val", obj=[0, 0], value=self.builder.json(value))

    def obj_set(self, path: Iterable, values: dict) -> None:
        node = self.typed(path, "obj")
        if values:
            self._op("ins_obj", obj=pair(node), value=[[k, self.value(v)] for k, v in values.items()])

    def obj_del(self, path: Iterable, keys: list[str]) -> None:
        node = self.typed(path, "obj")
        if keys:
            self._op("ins_obj", obj=pair(node), value=[[k, self.builder.add("new_con")] for k in keys])

    def vec_set(self, path: Iterable, values: list) -> None:
        """``values``: pairs of a position up to 255 and a value."""
        node = self.typed(path, "vec")
        if any(not 0 <= k <= 255 for k, _ in values):
            raise EditError("OUT_OF_BOUNDS")
        if values:
            self._op("ins_vec", obj=pair(node), value=[[k, self.value(v)] for k, v in values])

    def val_set(self, node: tuple[int, int], value) -> None:
        if self.model.kind.get(node) != "val":
            raise EditError("NOT_VAL")
        self._op("ins_val", obj=pair(node), value=self.value(value))

    def insert(self, path: Iterable, at: int, items, node: tuple[int, int] | None = None) -> None:
        """Text, bytes or values into a sequence at a position of its live elements."""
        node = node or self.typed(path, *SEQUENCES)
        if not items:
            return
        live = self.live(node)
        if not 0 <= at <= len(live):
            raise EditError("OUT_OF_BOUNDS")
        after = pair(live[at - 1] if at else node)
        kind = self.model.kind[node]
        if kind == "arr":
            nodes = [self.builder.json(v) for v in items]
            time = self.builder.time
            self._op("ins_arr", obj=pair(node), after=after, values=nodes)
        else:
            time = self.builder.time
            self._op("ins_" + kind, obj=pair(node), after=after, value=items if kind == "str" else list(items))
        live[at:at] = [(t, self.sid) for t in range(time, self.time)]

    def delete(self, path: Iterable, at: int, n: int, node: tuple[int, int] | None = None) -> None:
        node = node or self.typed(path, *SEQUENCES)
        live = self.live(node)
        if at < 0 or n < 0 or at + n > len(live):
            raise EditError("OUT_OF_BOUNDS")
        if n:
            self._op("del", obj=pair(node), what=spans(live[at : at + n]))
            del live[at : at + n]

    def update(self, path: Iterable, at: int, value, node: tuple[int, int] | None = None) -> None:
        """Replace an element of an array, which keeps its place."""
        node = node or self.typed(path, "arr")
        live = self.live(node)
        if not 0 <= at < len(live):
            raise EditError("OUT_OF_BOUNDS")
        self._op("upd_arr", obj=pair(node), ref=pair(live[at]), value=self.builder.json(value))

    def register_set(self, path: Iterable, value) -> None:
        """Write a register of several values, an array: the values seen go, unseen ones stay beside."""
        node = self.typed(path, "arr")
        self.delete((), 0, self.size(path), node)
        self.insert((), 0, [value], node)

    def count(self, path: Iterable, by: int) -> None:
        """Add to a counter, an object of one number a session."""
        node, key = self.typed(path, "obj"), base36(self.sid)
        child = self.model.slots[node].get(key)
        before = 0 if child is None else self.model.view(child)
        self.obj_set(path, {key: before + by if _counts(before) else by})

    def counted(self, path: Iterable = ()) -> int:
        return sum(v for v in self.model.view(self.typed(path, "obj")).values() if _counts(v))

    def run(self, command: dict) -> None:
        """An edit as data: ``{"do": name, "path": [...], ...}``."""
        name, path = command["do"], command.get("path", [])
        if name == "set":
            self.set_root(command["value"])
        elif name == "obj_set":
            self.obj_set(path, command["value"])
        elif name == "obj_del":
            self.obj_del(path, command["keys"])
        elif name == "vec_set":
            self.vec_set(path, command["value"])
        elif name == "ins":
            at = command.get("at")
            self.insert(path, self.size(path) if at is None else at, command["value"])
        elif name == "del":
            self.delete(path, command["at"], command.get("len", 1))
        elif name == "upd":
            self.update(path, command["at"], command["value"])
        elif name == "register":
            self.register_set(path, command["value"])
        elif name == "count":
            self.count(path, command.get("by", 1))
        elif name == "merge":
            self.merge(command["value"])
        elif name == "patch":
            self.json_patch(command["ops"])
        else:
            raise EditError("UNKNOWN_EDIT")

    # merging

    def merge(self, value) -> None:
        """Turn the document into a value with few edits, keeping the nodes that stay."""
        root = self.model.slots[ORIGIN].get("value")
        if root is None or not self._merge(root, value):
            self.set_root(value)

    def _merge(self, node: tuple[int, int], value) -> bool:
        """Whether the node now shows the value; if not, it is its holder's to replace."""
        kind = self.model.kind[node]
        if kind == "con":
            own = self.model.view(node)
            return own is not UNDEFINED and json_patch.same(own, value)
        if kind == "val":
            child = self.model.slots[node].get("value")
            if child is None or not self._merge(child, value):
                self.val_set(node, value)
            return True
        if kind == "str" and isinstance(value, str):
            self._sequence(node, list(self._live(node)), units(value))
            return True
        if kind == "bin" and isinstance(value, list) and all(type(v) is int and 0 <= v < 256 for v in value):
            self._sequence(node, list(self._live(node)), value)
            return True
        if kind == "obj" and isinstance(value, dict):
            slots = self.model.slots[node]
            gone = [k for k, c in slots.items() if k not in value and self.model.view(c) is not UNDEFINED]
            fresh = {k: v for k, v in value.items() if k not in slots or not self._merge(slots[k], v)}
            writes = [[k, self.builder.add("new_con")] for k in gone] + [[k, self.value(v)] for k, v in fresh.items()]
            if writes:
                self._op("ins_obj", obj=pair(node), value=writes)
            return True
        if kind == "vec" and isinstance(value, list) and max(self.model.slots[node], default=-1) < len(value) <= 256:
            slots = self.model.slots[node]
            writes = [[k, self.value(v)] for k, v in enumerate(value) if k not in slots or not self._merge(slots[k], v)]
            if writes:
                self._op("ins_vec", obj=pair(node), value=writes)
            return True
        if kind == "arr" and isinstance(value, list):
            self._array(node, value)
            return True
        return False

    def _live(self, node: tuple[int, int]):
        own = self.model.seq[node]
        return (own.items[i] for i in self.live(node))

    def _sequence(self, node: tuple[int, int], old: list[int], new: list[int]) -> None:
        text = self.model.kind[node] == "str"
        for _, a, b, c, d in reversed(_runs(old, new)):
            self.delete((), a, b - a, node)
            self.insert((), a, from_units(new[c:d]) if text else new[c:d], node)

    def _array(self, node: tuple[int, int], value: list) -> None:
        own = self.model.seq[node]
        live = list(self.live(node))
        old, new = [_key(self.model.view(own.items[i])) for i in live], [_key(v) for v in value]
        for _, a, b, c, d in reversed(_runs(old, new)):
            both = min(b - a, d - c)
            self.delete((), a + both, b - a - both, node)
            self.insert((), a + both, value[c + both : d], node)
            for k in range(both):
                if not self._merge(own.items[live[a + k]], value[c + k]):
                    self.update((), a + k, value[c + k], node)

    # JSON Patch

    def json_patch(self, ops: list[dict]) -> None:
        """RFC 6902 operations, ``str_ins`` and ``str_del`` as edits; a failed test raises."""
        for op in ops:
            steps = json_patch._steps(op["path"])
            name = op["op"]
            if name == "test":
                if json_patch.same(self.get(steps), op["value"]) == bool(op.get("not")):
                    raise EditError("TEST")
            elif name in ("str_ins", "str_del"):
                node = self.typed(steps, "str")
                size = len(self.live(node))
                at = min(op["pos"], size)
                if name == "str_ins":
                    self.insert((), at, op["str"], node)
                else:
                    n = op["len"] if "len" in op else len(units(op["str"]))
                    self.delete((), at, min(n, size - at), node)
            elif name == "add":
                self._add(steps, op["value"])
            elif name == "remove":
                self._remove(steps)
            elif name == "replace":
                self._replace(steps, op["value"])
            elif name in ("copy", "move"):
                source = json_patch._steps(op["from"])
                value = self.get(source)
                if name == "move":
                    if steps[: len(source)] == source and steps != source:
                        raise EditError("MOVE_INTO_ITSELF")
                    self._remove(source)
                self._add(steps, value)
            else:
                raise EditError("UNKNOWN_OP")

    def get(self, steps: Iterable):
        return self.model.view(self.find(steps))

    def _holder(self, steps: list[str]) -> tuple[tuple[int, int], str, str]:
        node = self.typed(steps[:-1], "obj", "arr", "vec")
        return node, self.model.kind[node], steps[-1]

    @staticmethod
    def _index(step: str, top: int) -> int:
        if not step.isascii() or not step.isdigit() or len(step) > 1 and step[0] == "0" or int(step) > top:
            raise EditError("INVALID_INDEX")
        return int(step)

    def _add(self, steps: list[str], value) -> None:
        if not steps:
            return self.set_root(value)
        node, kind, last = self._holder(steps)
        if kind == "obj":
            return self.obj_set(steps[:-1], {last: value})
        if kind == "vec":
            return self.vec_set(steps[:-1], [[self._index(last, 255), value]])
        size = len(self.live(node))
        return self.insert((), size if last == "-" else self._index(last, size), [value], node)

    def _remove(self, steps: list[str]) -> None:
        if not steps:
            self._op("ins_val", obj=[0, 0], value=self.builder.add("new_con"))
            return
        self.find(steps)
        node, kind, last = self._holder(steps)
        if kind == "arr":
            self.delete((), self._index(last, self.size(steps[:-1]) - 1), 1, node)
        else:
            self._op("ins_" + kind, obj=pair(node), value=[[last if kind == "obj" else int(last), self.builder.add("new_con")]])

    def _replace(self, steps: list[str], value) -> None:
        if steps and self.model.kind[self.typed(steps[:-1], "obj", "arr", "vec")] == "arr":
            self.update(steps[:-1], self._index(steps[-1], self.size(steps[:-1]) - 1), value)
        else:
            if steps:
                self.find(steps)
            self._add(steps, value)


def _counts(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _runs(old: list, new: list) -> list[tuple[int, int, int, int, int]]:
    """Changed stretches as (1, old from, to, new from, to), neighbouring ones joined."""
    out: list[tuple[int, int, int, int, int]] = []
    for kind, i, x, j, y in script(old, new):
        if kind and out and (out[-1][2], out[-1][4]) == (i, j):
            out[-1] = (1, out[-1][1], x, out[-1][3], y)
        elif kind:
            out.append((1, i, x, j, y))
    return out


def _key(value) -> str:
    return json.dumps(None if value is UNDEFINED else value, sort_keys=True)


# -- history


def history(patches: Iterable[dict], upto: tuple[int, int] | None = None, inclusive: bool = True) -> Model:
    """The model after patches in order of their ids, up to an id (time, session) if given."""
    model = Model()
    for p in sorted(patches, key=lambda p: (p["id"][1], p["id"][0])):
        at = (p["id"][1], p["id"][0])
        if upto is None or at < upto or inclusive and at == upto:
            model.apply_patch(p)
    return model


def rebuild(model: Model, node: tuple[int, int] | None, builder: Builder) -> list[int]:
    """A fresh copy of a node and what it holds; an undefined constant for none."""
    kind = model.kind.get(node) if node else None
    if kind is None:
        return builder.add("new_con")
    if kind == "con":
        own = model.con[node]
        return builder.add("new_con") if own is UNDEFINED else builder.add("new_con", timestamp=pair(own)) if isinstance(own, tuple) else builder.add("new_con", value=own)
    at = builder.add("new_" + kind)
    if kind == "val":
        builder.add("ins_val", obj=at, value=rebuild(model, model.slots[node].get("value"), builder))
    elif kind in ("obj", "vec"):
        writes = [[k, rebuild(model, c, builder)] for k, c in model.slots[node].items()]
        if writes:
            builder.add("ins_" + kind, obj=at, value=writes)
    else:
        _restore(model, node, model.seq[node].live(node), at, at, builder)
    return at


def _restore(model: Model, node: tuple[int, int], ids: list, into: list[int], after: list[int], builder: Builder) -> None:
    """Insert copies of some elements of a sequence."""
    kind, own = model.kind[node], model.seq[node]
    if not ids:
        return
    if kind == "arr":
        builder.add("ins_arr", obj=into, after=after, values=[rebuild(model, own.items[i], builder) for i in ids])
    else:
        items = [own.items[i] for i in ids]
        value = from_units(items) if kind == "str" else items
        builder.add("ins_" + kind, obj=into, after=after, value=value)


def undo(patches: list[dict], target: dict, sid: int) -> dict:
    """A patch that takes back ``target``, made at the end of the history.

    Inserts are deleted, writes get copies of what the history before ``target`` held,
    deletions are inserted again after the element that preceded them.
    """
    if not target["ops"]:
        raise EditError("EMPTY_PATCH")
    own, time = target["id"]
    before = history(patches, (time, own), False)
    end = history(patches)
    builder = Builder(sid, max(end.clock.values(), default=0) + 1)
    ids = []
    for op in target["ops"]:
        ids.append(time)
        time += span(op)
    for op, at in reversed(list(zip(target["ops"], ids, strict=True))):
        name = op["op"]
        if name in ("ins_str", "ins_bin", "ins_arr"):
            builder.add("del", obj=op["obj"], what=[[own, at, span(op)]])
            continue
        if "obj" not in op:
            continue
        obj = (op["obj"][1], op["obj"][0])
        if name == "ins_val":
            builder.add("ins_val", obj=op["obj"], value=rebuild(before, before.slots.get(obj, {}).get("value"), builder))
        elif name in ("ins_obj", "ins_vec"):
            slots = before.slots.get(obj, {})
            builder.add(name, obj=op["obj"], value=[[k, rebuild(before, slots.get(k), builder)] for k, _ in op["value"]])
        elif name == "upd_arr" and obj in before.seq:
            old = before.seq[obj].items.get((op["ref"][1], op["ref"][0]))
            if old is not None:
                builder.add("upd_arr", obj=op["obj"], ref=op["ref"], value=rebuild(before, old, builder))
        elif name == "del" and obj in before.seq:
            seq: Sequence = before.seq[obj]
            gone = {(t + k, s) for s, t, n in op["what"] for k in range(n)}
            order = seq.order(obj)
            first = next((k for k, i in enumerate(order) if i in gone), None)
            if first is not None:
                after = pair(order[first - 1]) if first else op["obj"]
                _restore(before, obj, [i for i in order if i in gone and i not in seq.dead], op["obj"], after, builder)
    return builder.flush()


# -- snapshots


def snapshot(model: Model) -> dict:
    """The whole state as JSON: clocks, and nodes by id, with the places of deleted elements."""

    def state(node: tuple[int, int], kind: str):
        if kind == "con":
            own = model.con[node]
            return {} if own is UNDEFINED else {"ref": pair(own)} if isinstance(own, tuple) else {"value": own}
        if kind in ("root", "val", "obj", "vec"):
            return [[k, pair(c)] for k, c in model.slots[node].items()]
        own, runs = model.seq[node], []
        parent = {c: p for p, children in own.children.items() for c in children}
        for i in sorted(own.items, key=lambda i: (i[1], i[0])):
            dead = i in own.dead
            item = None if dead else pair(own.items[i]) if kind == "arr" else own.items[i]
            before = (i[0] - 1, i[1])
            if runs and parent[i] == before and runs[-1]["end"] == before and (runs[-1]["items"] is None) == dead:
                runs[-1]["n"] += 1
                if not dead:
                    runs[-1]["items"].append(item)
            else:
                runs.append({"id": pair(i), "after": pair(parent[i]), "n": 1, "items": None if dead else [item]})
            runs[-1]["end"] = i
        return [[r["id"], r["after"], r["n"] if r["items"] is None else r["items"]] for r in runs]

    nodes = [["root", [0, 0], state(ORIGIN, "root")]] + [[k, pair(n), state(n, k)] for n, k in model.kind.items()]
    # deletions of elements not seen yet stay known
    early = [[pair(n), spans(sorted(q.dead - q.items.keys(), key=lambda i: (i[1], i[0])))] for n, q in model.seq.items() if not q.dead <= q.items.keys()]
    return {"clock": sorted(map(list, model.clock.items())), "nodes": nodes, "early": early}


def restore(state: dict) -> Model:
    model = Model()
    model.clock = {sid: time for sid, time in state["clock"]}
    for kind, (sid, time), own in state["nodes"]:
        node = (time, sid)
        if kind != "root":
            model.kind[node] = kind
        if kind == "con":
            model.con[node] = (own["ref"][1], own["ref"][0]) if "ref" in own else own.get("value", UNDEFINED)
        elif kind in ("root", "val", "obj", "vec"):
            model.slots[node] = {k: (c[1], c[0]) for k, c in own}
        else:
            model.seq[node] = seq = Sequence()
            for (s, t), (after_sid, after_time), items in own:
                n = items if isinstance(items, int) else len(items)
                after = (after_time, after_sid)
                for k in range(n):
                    i = (t + k, s)
                    item = None if isinstance(items, int) else (items[k][1], items[k][0]) if kind == "arr" else items[k]
                    seq.items[i] = item if item is not None else ORIGIN if kind == "arr" else 0
                    seq.children.setdefault(after, []).append(i)
                    if isinstance(items, int):
                        seq.dead.add(i)
                    after = i
    for (sid, time), gone in state["early"]:
        model.seq[time, sid].delete(gone)
    return model


# -- over tables


def _dump(value) -> str | None:
    return None if value is UNDEFINED or value is None else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _folded(patches: DataFrame, other: DataFrame, doc: str, fold, result: str) -> DataFrame:
    kind = patches.schema[doc].dataType.simpleString()
    return spread(patches, doc).groupBy(doc).cogroup(spread(other, doc).groupBy(doc)).applyInPandas(fold, f"{doc} {kind}, {result}")


def apply_edits(patches: DataFrame, edits: DataFrame, doc: str, patch: str, order: str, edit: str, sid: int) -> DataFrame:
    """New patch and view of every document that has edits.

    ``edits``: rows (doc, order, edit as JSON text), done in order; one that fails leaves
    the document as it was before it and is counted in ``failed``.
    """

    def fold(names: tuple, rows: list[tuple]) -> list[tuple]:
        own = [r for r in rows if r[0]]
        if not own:
            return []
        editor, failed = Editor(history(json.loads(p) for done, _, p in rows if not done and p is not None), sid), 0
        for _, _, text in sorted(own, key=lambda r: (r[1] is None, r[1] if r[1] is not None else 0)):  # NULLs last
            # edits check before they write, but a list of patch operations may stop halfway
            try:
                editor.run(json.loads(text))
            except (EditError, json_patch.PatchError, KeyError, TypeError, ValueError):
                failed += 1
                editor.apply()
        made = editor.flush()
        return [(_dump(made), _dump(editor.model.view()), failed)]

    before = patches.select(doc, F.lit(False).alias("_edit"), F.lit(None).cast(edits.schema[order].dataType).alias("_order"), F.col(patch).alias("_text"))
    rows = before.unionByName(edits.select(doc, F.lit(True).alias("_edit"), F.col(order).alias("_order"), F.col(edit).alias("_text")))
    return folded(rows, [doc], fold, "patch string, view string, failed long")


def diff_apply(patches: DataFrame, targets: DataFrame, doc: str, patch: str, target: str, sid: int) -> DataFrame:
    """The patch that turns each document into its target (JSON text), and the view then."""

    def fold(names: tuple, history_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = [doc, "patch", "view"]
        if rows.empty or rows[target].isna().all():
            return pd.DataFrame([], columns=columns)
        editor = Editor(history(json.loads(p) for p in history_rows[patch].dropna()), sid)
        for text in rows[target].dropna():
            editor.merge(json.loads(text))
        made = editor.flush()
        return pd.DataFrame([(names[0], _dump(made), _dump(editor.model.view()))], columns=columns)

    return _folded(patches.select(doc, patch), targets.select(doc, target), doc, fold, "patch string, view string")


def undo_patches(patches: DataFrame, targets: DataFrame, doc: str, patch: str, sid: int) -> DataFrame:
    """For each target patch (the same columns), the patch that takes it back and the view then."""

    def fold(names: tuple, history_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        own = [json.loads(p) for p in history_rows[patch].dropna()]
        found = []
        for text in rows[patch].dropna():
            made = undo(own, json.loads(text), sid)
            model = history(own)
            model.apply_patch(made)
            found.append((names[0], _dump(made), _dump(model.view())))
        return pd.DataFrame(found, columns=[doc, "patch", "view"])

    return _folded(patches.select(doc, patch), targets.select(doc, patch), doc, fold, "patch string, view string")


def advance(patches: DataFrame, doc: str, patch: str, upto: tuple[int, int]) -> DataFrame:
    """History up to an id (time, session) as one snapshot a document; its later patches still apply."""
    kind = patches.schema[doc].dataType.simpleString()

    def fold(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        model = history((json.loads(p) for p in rows[patch].dropna()), upto)
        return pd.DataFrame([(names[0], _dump(snapshot(model)))], columns=[doc, "snapshot"])

    return spread(patches.select(doc, patch), doc).groupBy(doc).applyInPandas(fold, f"{doc} {kind}, snapshot string")


def replay_from(snapshots: DataFrame, patches: DataFrame, doc: str, patch: str) -> DataFrame:
    """Views of documents from their snapshots and the patches after them."""

    def fold(names: tuple, states: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        model = restore(json.loads(states["snapshot"].iloc[0])) if len(states) else Model()
        for p in sorted((json.loads(t) for t in rows[patch].dropna()), key=lambda p: (p["id"][1], p["id"][0])):
            model.apply_patch(p)
        return pd.DataFrame([(names[0], _dump(model.view()))], columns=[doc, "view"])

    return _folded(snapshots.select(doc, "snapshot"), patches.select(doc, patch), doc, fold, "view string")
