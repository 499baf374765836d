"""Replicated documents: operation logs, last-writer-wins folds, sequences and replay.

Registers, maps, tuples and clocks need no replay: the winner of each key is ``max_by`` its
time and session, an aggregation that combines in the tasks and shuffles once on
(document, key). Sequences are folded per sequence, and whole documents per document.

An operation is a JSON object in the readable form, with ids as [session, time]:
``{"op": "ins_str", "obj": [s, t], "after": [s, t], "value": "text"}``.
"""

from __future__ import annotations

import copy
import json
import struct
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORIGIN = (0, 0)
CREATES = {"new_con": "con", "new_val": "val", "new_obj": "obj", "new_vec": "vec", "new_str": "str", "new_bin": "bin", "new_arr": "arr"}


class _Undefined:
    """The marker of a missing value; copies of a model keep the one there is."""

    def __copy__(self) -> _Undefined:
        return self

    def __deepcopy__(self, memo: dict) -> _Undefined:
        return self


UNDEFINED = _Undefined()


def _id(pair) -> tuple[int, int]:
    """(time, session), which orders as ids do, of a [session, time] pair."""
    return (int(pair[1]), int(pair[0]))


def units(text: str) -> list[int]:
    """UTF-16 code units."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return list(struct.unpack(f"<{len(raw) // 2}H", raw))


def from_units(own: Iterable[int]) -> str:
    own = list(own)
    return struct.pack(f"<{len(own)}H", *own).decode("utf-16-le", "surrogatepass")


def span(op: dict) -> int:
    """Ticks that an operation takes."""
    name = op["op"]
    if name == "ins_str":
        return len(op["value"].encode("utf-16-le", "surrogatepass")) // 2
    if name in ("ins_bin", "ins_arr"):
        return len(op["value"] if name == "ins_bin" else op["values"])
    return op.get("len", 1) if name == "nop" else 1


class Sequence:
    """Elements by id; the order is a walk of the "after" tree, newer siblings first."""

    def __init__(self) -> None:
        self.children: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.items: dict[tuple[int, int], object] = {}
        self.dead: set[tuple[int, int]] = set()

    def insert(self, root: tuple[int, int], after: tuple[int, int], at: tuple[int, int], values: list) -> None:
        if after != root and after not in self.items:
            after = root
        items, children, (time, sid) = self.items, self.children, at
        for value in values:
            own = (time, sid)
            time += 1
            if own not in items:  # a repeated insert is no insert
                items[own] = value
                if after in children:
                    children[after].append(own)
                else:
                    children[after] = [own]
            after = own

    def delete(self, spans: Iterable) -> None:
        for sid, time, n in spans:
            self.dead.update((time + k, sid) for k in range(n))

    def order(self, root: tuple[int, int]) -> list[tuple[int, int]]:
        out, stack = [], sorted(self.children.get(root, []))
        find = self.children.get
        while stack:
            own = stack.pop()
            out.append(own)
            while (below := find(own)) and len(below) == 1:  # typed text is one long chain
                (own,) = below
                out.append(own)
            if below:
                stack += sorted(below)
        return out

    def live(self, root: tuple[int, int]) -> list[tuple[int, int]]:
        return [i for i in self.order(root) if i not in self.dead] if self.dead else self.order(root)


class Model:
    """One document's state after some operations."""

    def __init__(self) -> None:
        self.kind: dict[tuple[int, int], str] = {}
        self.con: dict[tuple[int, int], object] = {}
        self.slots: dict[tuple[int, int], dict] = {(0, 0): {}}
        self.seq: dict[tuple[int, int], Sequence] = {}
        self.clock: dict[int, int] = {}

    def apply(self, op: dict, at: tuple[int, int]) -> None:
        """Apply an operation whose id is (time, session) ``at``; late and repeated ones are harmless."""
        name = op["op"]
        self.clock[at[1]] = max(self.clock.get(at[1], 0), at[0] + span(op) - 1)
        if name in CREATES:
            if at not in self.kind:
                self.kind[at] = CREATES[name]
                if name == "new_con":
                    self.con[at] = _id(op["timestamp"]) if "timestamp" in op else op.get("value", UNDEFINED)
                elif name in ("new_str", "new_bin", "new_arr"):
                    self.seq[at] = Sequence()
                else:
                    self.slots[at] = {}
            return
        if name == "nop":
            return
        obj = _id(op["obj"])
        if name == "ins_val":
            self._write(obj, "value", _id(op["value"]), obj == ORIGIN)
        elif name in ("ins_obj", "ins_vec"):
            for key, child in op["value"]:
                self._write(obj, key, _id(child), False)
        elif obj in self.seq:
            own = self.seq[obj]
            if name == "del":
                own.delete(op["what"])
            elif name == "upd_arr":
                after, child = _id(op["ref"]), _id(op["value"])
                if after in own.items and child > own.items[after]:
                    own.items[after] = child
            elif name == "ins_arr":
                values = [c for v in op["values"] if (c := _id(v)) > obj and c in self.kind]
                own.insert(obj, _id(op["after"]), at, values)
            else:
                own.insert(obj, _id(op["after"]), at, units(op["value"]) if name == "ins_str" else list(op["value"]))

    def _write(self, obj: tuple[int, int], key, child: tuple[int, int], root: bool) -> None:
        slots = self.slots.get(obj)
        if slots is None or child not in self.kind or not root and child <= obj:
            return
        if key not in slots or child > slots[key]:
            slots[key] = child

    def apply_patch(self, patch: dict) -> None:
        sid, time = patch["id"]
        for op in patch["ops"]:
            self.apply(op, (time, sid))
            time += span(op)

    def view(self, node: tuple[int, int] = ORIGIN):
        """The document as JSON; an empty one is the undefined marker."""
        if node == ORIGIN:
            root = self.slots[ORIGIN].get("value")
            return UNDEFINED if root is None else self.view(root)
        kind = self.kind[node]
        if kind == "con":
            own = self.con[node]
            return self.view(own) if isinstance(own, tuple) and own in self.kind else None if isinstance(own, tuple) else own
        if kind == "val":
            child = self.slots[node].get("value")
            return UNDEFINED if child is None else self.view(child)
        if kind == "obj":
            return {k: v for k, c in self.slots[node].items() if (v := self.view(c)) is not UNDEFINED}
        if kind == "vec":
            own = self.slots[node]
            cells = [self.view(own[k]) if k in own else None for k in range(max(own, default=-1) + 1)]
            return [None if c is UNDEFINED else c for c in cells]
        live = self.seq[node].live(node)
        if kind == "str":
            return from_units(self.seq[node].items[i] for i in live)
        if kind == "bin":
            return [self.seq[node].items[i] for i in live]
        return [None if (v := self.view(self.seq[node].items[i])) is UNDEFINED else v for i in live]


class Builder:
    """Allocates ids for one session and collects operations."""

    def __init__(self, sid: int, time: int = 1):
        self.sid, self.start, self.time = sid, time, time
        self.ops: list[dict] = []

    def add(self, op: str, **fields) -> list[int]:
        """Append an operation; its id as [session, time]."""
        own = {"op": op, **fields}
        at = [self.sid, self.time]
        self.ops.append(own)
        self.time += span(own)
        return at

    def con_val(self, value) -> list[int]:
        """A constant; the undefined marker makes one without a value."""
        return self.add("new_con", **({} if value is UNDEFINED else {"value": value}))

    def con_ref(self, at: list[int]) -> list[int]:
        """A constant that refers to an id."""
        return self.add("new_con", timestamp=at)

    def val(self) -> list[int]:
        return self.add("new_val")

    def obj(self) -> list[int]:
        return self.add("new_obj")

    def vec(self) -> list[int]:
        return self.add("new_vec")

    def str_node(self) -> list[int]:
        return self.add("new_str")

    def bin(self) -> list[int]:
        return self.add("new_bin")

    def arr(self) -> list[int]:
        return self.add("new_arr")

    def set_root(self, value: list[int]) -> list[int]:
        """Make a node the document's root."""
        return self.set_val([0, 0], value)

    def ins_obj(self, obj: list[int], pairs: list) -> list[int]:
        return self.add("ins_obj", obj=obj, value=_some(pairs))

    def ins_vec(self, obj: list[int], pairs: list) -> list[int]:
        return self.add("ins_vec", obj=obj, value=_some(pairs))

    def set_val(self, obj: list[int], value: list[int]) -> list[int]:
        return self.add("ins_val", obj=obj, value=value)

    def ins_str(self, obj: list[int], after: list[int], text: str) -> list[int]:
        return self.add("ins_str", obj=obj, after=after, value=_some(text))

    def ins_bin(self, obj: list[int], after: list[int], data: bytes | list[int]) -> list[int]:
        return self.add("ins_bin", obj=obj, after=after, value=_some(list(data)))

    def ins_arr(self, obj: list[int], after: list[int], ids: list) -> list[int]:
        return self.add("ins_arr", obj=obj, after=after, values=_some(ids))

    def upd_arr(self, obj: list[int], ref: list[int], value: list[int]) -> list[int]:
        return self.add("upd_arr", obj=obj, ref=ref, value=value)

    def delete(self, obj: list[int], spans: list[list[int]]) -> list[int]:
        """Delete spans [session, time, length] of a sequence."""
        return self.add("del", obj=obj, what=spans)

    def nop(self, span: int) -> list[int]:
        return self.add("nop", len=span)

    def pad(self, time: int) -> None:
        """Reach ``time`` by a nop, if it lies ahead."""
        if time > self.time and self.ops:
            self.nop(time - self.time)
        elif time > self.time:
            self.start = self.time = time

    def json(self, value) -> list[int]:
        """Nodes for a JSON value: text as str, containers as nodes, the rest constant."""
        if isinstance(value, str):
            own = self.add("new_str")
            if value:
                self.add("ins_str", obj=own, after=own, value=value)
            return own
        if isinstance(value, list):
            own = self.add("new_arr")
            if value:
                self.add("ins_arr", obj=own, after=own, values=[self.json(v) for v in value])
            return own
        if isinstance(value, dict):
            own = self.add("new_obj")
            if value:
                self.add("ins_obj", obj=own, value=[[k, self.json(v) if isinstance(v, (str, list, dict)) else self.add("new_con", value=v)] for k, v in value.items()])
            return own
        own = self.add("new_val")
        self.add("ins_val", obj=own, value=self.add("new_con", value=value))
        return own

    def root(self, value) -> Builder:
        self.add("ins_val", obj=[0, 0], value=self.json(value))
        return self

    def flush(self) -> dict:
        patch = {"id": [self.sid, self.start], "ops": self.ops}
        self.ops, self.start = [], self.time
        return patch


def _some(items):
    if not items:
        raise ValueError("EMPTY_OPERATION")
    return items


def patch_id(patch: dict) -> list[int] | None:
    """The id of a patch's first operation; None for an empty patch."""
    return list(patch["id"]) if patch["ops"] else None


def next_time(patch: dict) -> int:
    """The tick behind a patch's last; 0 for an empty patch."""
    return patch["id"][1] + sum(map(span, patch["ops"])) if patch["ops"] else 0


def batch_id(patches: list[dict]) -> list[int] | None:
    """The id of a batch: that of its first patch."""
    return patch_id(patches[0]) if patches else None


def clone_batch(patches: list[dict]) -> list[dict]:
    return copy.deepcopy(patches)


_REFERENCES = ("obj", "after", "ref", "what", "values", "timestamp")


def rewrite_time(patch: dict, change: Callable[[list[int]], list[int]]) -> dict:
    """The patch with every id of it and of its operations changed; spans keep their length."""

    def move(value):
        if isinstance(value, list) and len(value) in (2, 3) and all(isinstance(x, int) for x in value):
            return [*change(value[:2]), *value[2:]]
        return [move(v) for v in value] if isinstance(value, list) else value

    ids = ("ins_val", "ins_obj", "ins_vec", "upd_arr")
    ops = [{k: move(v) if k in _REFERENCES or k == "value" and o["op"] in ids else v for k, v in o.items()} for o in patch["ops"]]
    return {"id": change(list(patch["id"])), "ops": ops}


def rebase(patch: dict, new_time: int, after: int | None = None) -> dict:
    """The patch at another time: own ids from the threshold on move by the difference."""
    sid, time = patch["id"]
    least, delta = time if after is None else after, new_time - time

    def move(at: list[int]) -> list[int]:
        return [sid, at[1] + delta] if at[0] == sid and at[1] >= least else at

    return {**rewrite_time(patch, move), "id": [sid, new_time]}


def compact(patch: dict) -> dict:
    """Neighbouring text inserts of which each continues the one before, as one."""
    sid, time = patch["id"]
    out: list[dict] = []
    for op in patch["ops"]:
        last = out[-1] if out else None
        if last and last["op"] == op["op"] == "ins_str" and last["obj"] == op["obj"] and op["after"] == [sid, time - 1]:
            out[-1] = {**last, "value": last["value"] + op["value"]}
        else:
            out.append(op)
        time += span(op)
    return {"id": patch["id"], "ops": out}


def combine(patches: list[dict]) -> dict:
    """One patch of one session's patches in order, with nops in the gaps."""
    first, *rest = patches
    ops, sid = list(first["ops"]), first["id"][0]
    end = first["id"][1] + sum(map(span, ops))
    for p in rest:
        if p["id"][0] != sid:
            raise ValueError("SID_MISMATCH")
        gap = p["id"][1] - end
        if gap < 0:
            raise ValueError("TIMESTAMP_CONFLICT")
        ops += [{"op": "nop", "len": gap}] if gap else []
        ops += p["ops"]
        end = p["id"][1] + sum(map(span, p["ops"]))
    return {"id": first["id"], "ops": ops}


# -- over DataFrames


def spread(df: DataFrame, *doc: str) -> DataFrame:
    """Rows by document over all shuffle partitions: folds cost time, not bytes, by which small partitions would be joined."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *doc)


def folded(df: DataFrame, doc: list[str], fold: Callable[[tuple, list[tuple]], list[tuple]], result: str) -> DataFrame:
    """Rows ``fold(document, rows)`` of every document; the frame's first columns are the document's, rows are tuples of the others.

    Documents follow one another in sorted partitions, in Arrow batches that hold many of them:
    a frame for each small document would cost more than its fold.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*(df.schema[c] for c in doc), *T.StructType.fromDDL(result).fields])
    names, kinds, n = schema.names, [to_arrow_type(f.dataType) for f in schema.fields], len(doc)

    def batch(out: list[tuple]):
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        key, own, held, out = None, None, [], []
        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                here = tuple("NaN" if v != v else v for v in row[:n])
                if here != own and held:
                    out += [(*key, *r) for r in fold(key, held)]
                    held = []
                    if len(out) >= 256:
                        yield batch(out)
                        out = []
                key, own = row[:n], here
                held.append(row[n:])
        if held:
            out += [(*key, *r) for r in fold(key, held)]
        yield batch(out)

    return spread(df, *doc).sortWithinPartitions(*doc).mapInArrow(run, schema)


def lww(ops: DataFrame, keys: list[str], value: str, time: str = "time", sid: str = "sid") -> DataFrame:
    """Winner of every key: the value of the newest id, with that id."""
    newest = F.struct(F.col(time).alias("time"), F.col(sid).alias("sid"))
    found = ops.groupBy(*keys).agg(F.max_by(F.col(value), newest).alias(value), F.max(newest).alias("_id"))
    return found.select(*keys, value, F.col("_id.time").alias("time"), F.col("_id.sid").alias("sid"))


def lww_map(ops: DataFrame, doc: str, key: str, value: str) -> DataFrame:
    """The live map of each document as JSON text with sorted keys; NULL values are deletions."""
    live = lww(ops, [doc, key], value).filter(F.col(value).isNotNull())
    return live.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))).alias("view"))


def lww_vector(ops: DataFrame, doc: str, index: str, value: str) -> DataFrame:
    """The tuple of each document as an array; gaps are NULL."""
    cells = lww(ops, [doc, index], value).groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(F.col(index).cast("int"), F.col(value)))).alias("cells"))
    top = F.array_max(F.map_keys("cells"))
    return cells.select(doc, F.transform(F.sequence(F.lit(0), top), lambda k: F.try_element_at(F.col("cells"), k)).alias("view"))


def clock_vector(ops: DataFrame, doc: str, time: str = "time", sid: str = "sid", ticks: str = "span") -> DataFrame:
    """Last tick that each session used in each document."""
    return ops.groupBy(doc, sid).agg(F.max(F.col(time) + F.col(ticks) - 1).alias("last"))


def batch_rebase(patches: DataFrame, doc: str, order: list[str], ticks: str, server_time: Column) -> DataFrame:
    """Start times of consecutive patches from a server time, as running sums of spans."""
    before = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return patches.withColumn("start", server_time + F.coalesce(F.sum(ticks).over(before), F.lit(0)))


def gaps(patches: DataFrame, doc: str, sid: str, time: str, ticks: str) -> DataFrame:
    """Nop lengths needed to combine each session's patches; negative where they conflict."""
    own = Window.partitionBy(doc, sid).orderBy(time)
    end = F.lag(F.col(time) + F.col(ticks)).over(own)
    return patches.withColumn("gap", F.coalesce(F.col(time) - end, F.lit(0)))


def compact_log(ops: DataFrame, doc: str, sid: str, time: str, text: str, after_time: str) -> DataFrame:
    """Runs of text inserts that each continue the one before, joined: gaps and islands."""
    own = Window.partitionBy(doc, sid).orderBy(time)
    last = F.lag(F.col(time) + F.char_length(text) - 1).over(own)
    starts = F.when((F.col(after_time) == last) & (F.col(time) == last + 1), 0).otherwise(1)
    runs = ops.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(own))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(time), F.col(text)))), lambda x: x[text]), "")
    return runs.groupBy(doc, sid, "run").agg(F.min(time).alias(time), joined.alias(text), F.count("*").alias("n_ops"))


def rga_text(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each sequence from rows (keys..., time, sid, after_time, after_sid, text, deleted).

    A row inserts ``text`` after an element, or, where ``text`` is NULL, deletes the
    ``deleted`` units from (time, sid) on. One sequence is one group; large documents hold
    many, and hot ones are folded from their compacted log.
    """

    def fold(names: tuple, rows: list[tuple]) -> list[tuple]:
        own = Sequence()
        rows.sort(key=lambda r: r[:2])
        for time, sid, after_time, after_sid, text, _ in rows:
            if text is not None:
                after = (-1, -1) if after_time is None else (int(after_time), int(after_sid))
                own.insert((-1, -1), after, (int(time), int(sid)), units(text))
        own.delete((int(sid), int(time), int(deleted)) for time, sid, _, _, text, deleted in rows if text is None)
        return [(from_units(own.items[i] for i in own.live((-1, -1))),)]

    return folded(ops.select(*keys, "time", "sid", "after_time", "after_sid", "text", "deleted"), keys, fold, "view string")


def replay(patches: DataFrame, doc: str, patch: str, upto: tuple[int, int] | None = None, inclusive: bool = True) -> DataFrame:
    """View of each document from its patches (JSON text, any order), up to an id (time, session) if given."""

    def fold(names: tuple, rows: list[tuple]) -> list[tuple]:
        model = Model()
        for p in sorted((json.loads(t) for (t,) in rows), key=lambda p: (p["id"][1], p["id"][0])):
            at = (p["id"][1], p["id"][0])
            if upto is None or at < upto or inclusive and at == upto:
                model.apply_patch(p)
        view = model.view()
        return [(None if view is UNDEFINED else json.dumps(view, separators=(",", ":"), ensure_ascii=False),)]

    return folded(patches.select(doc, patch), [doc], fold, "view string")


def counter(ops: DataFrame, doc: str, sid: str, value: str) -> DataFrame:
    """Sum over sessions of each session's newest count."""
    return lww(ops, [doc, "sid"] if sid == "sid" else [doc, sid], value).groupBy(doc).agg(F.sum(value).alias("count"))
