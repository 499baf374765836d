"""Nodes of replicated documents: templates, comparison, read-only views, stores and drafts.

A template is a nested tuple that says which nodes to make: ``("con", value)``,
``("str", text)``, ``("bin", bytes)``, ``("val", template)``, ``("vec", [template or None])``,
``("obj", {key: template})``, ``("arr", [template])`` or ``("ext", name, template)``.
These functions work on one document's model, inside the fold of its rows.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

from docloom.functions.json_utils import base36, hash32, hash_bin, hash_str, struct_hash
from docloom.operators.crdt import ORIGIN, UNDEFINED, Builder, Model, from_units
from docloom.operators.edit import EditError, Editor

Node = tuple[int, int]
Template = tuple


# -- templates


def template_of(value) -> Template:
    """The template of a JSON value: text as str, containers as nodes, the rest constant."""
    if isinstance(value, str):
        return ("str", value)
    if isinstance(value, (bytes, bytearray)):
        return ("bin", bytes(value))
    if isinstance(value, list):
        return ("arr", [template_of(v) for v in value])
    if isinstance(value, dict):
        return ("obj", {k: template_of(v) for k, v in value.items()})
    return ("con", value)


def build(template: Template, builder: Builder) -> list[int]:
    """Append the operations that make a template's nodes; the id of its top node."""
    kind, body = template[0], template[-1]
    if kind == "con":
        return builder.con_val(body)
    if kind == "ext":
        return build(body, builder)
    if kind == "str":
        at = builder.str_node()
        if body:
            builder.ins_str(at, at, body)
    elif kind == "bin":
        at = builder.bin()
        if body:
            builder.ins_bin(at, at, body)
    elif kind == "val":
        at = builder.val()
        builder.set_val(at, build(body, builder))
    elif kind == "obj":
        at = builder.obj()
        if body:
            builder.ins_obj(at, [[k, build(t, builder)] for k, t in body.items()])
    elif kind == "vec":
        at = builder.vec()
        cells = [[k, build(t, builder)] for k, t in enumerate(body) if t is not None]
        if cells:
            builder.ins_vec(at, cells)
    elif kind == "arr":
        at = builder.arr()
        if body:
            builder.ins_arr(at, at, [build(t, builder) for t in body])
    else:
        raise ValueError(f"unknown template {kind!r}")
    return at


def to_schema(model: Model, node: Node) -> Template:
    """The template that makes a node's structure and values again."""
    kind = model.kind.get(node)
    if kind is None:
        return ("con", None)
    if kind == "con":
        value = model.con[node]
        return ("con", None if isinstance(value, tuple) else value)
    if kind == "val":
        return ("val", to_schema(model, model.slots[node].get("value")))
    if kind == "obj":
        return ("obj", {k: to_schema(model, c) for k, c in sorted(model.slots[node].items())})
    if kind == "vec":
        return ("vec", [None if c is None else to_schema(model, c) for c in _cells(model, node)])
    if kind == "arr":
        return ("arr", [to_schema(model, c) for c in _items(model, node)])
    own = _items(model, node)
    return ("str", from_units(own)) if kind == "str" else ("bin", bytes(own))


def _cells(model: Model, node: Node) -> list[Node | None]:
    own = model.slots[node]
    return [own.get(k) for k in range(max(own, default=-1) + 1)]


def _items(model: Model, node: Node) -> list:
    return [model.seq[node].items[i] for i in model.seq[node].live(node)]


# -- comparison and hashes


def same_shape(a: Model, x: Node | None, b: Model, y: Node | None, content: bool = True) -> bool:
    """Whether two nodes have the same structure and, with ``content``, the same values."""
    kind = a.kind.get(x)
    if kind is None or b.kind.get(y) != kind:
        return kind is None and b.kind.get(y) is None
    if kind == "con":
        return not content or a.con[x] == b.con[y]
    if kind == "val":
        return same_shape(a, a.slots[x].get("value"), b, b.slots[y].get("value"), content)
    if kind == "obj":
        left, right = a.slots[x], b.slots[y]
        return left.keys() == right.keys() and all(same_shape(a, c, b, right[k], content) for k, c in left.items())
    if kind == "vec":
        left, right = _cells(a, x), _cells(b, y)
        return len(left) == len(right) and all(same_shape(a, c, b, d, content) for c, d in zip(left, right, strict=True))
    if kind != "arr" and not content:
        return True
    left, right = _items(a, x), _items(b, y)
    if kind != "arr" or len(left) != len(right) or not content:
        return left == right if kind != "arr" else len(left) == len(right)
    return all(same_shape(a, c, b, d, content) for c, d in zip(left, right, strict=True))


def same_node(a: Model, x: Node, b: Model, y: Node) -> bool:
    """Whether two nodes have one kind, id and metadata; values of children are not read.

    Of a sequence the metadata are its newest element and its live length.
    """
    kind = a.kind.get(x)
    if x != y or kind is None or b.kind.get(y) != kind:
        return False
    if kind in ("val", "obj", "vec"):
        return a.slots[x] == b.slots[y]
    if kind == "con":
        return True
    newest = [max(m.seq[x].items, default=None) for m in (a, b)]
    return newest[0] == newest[1] and len(_items(a, x)) == len(_items(b, y))


def struct_hash_crdt(model: Model, node: Node | None) -> str:
    """Printable hash of a node's structure and values; a missing node is U."""
    kind = model.kind.get(node)
    if kind is None:
        return "U"
    if kind == "con":
        value = model.con[node]
        return struct_hash(None if value is UNDEFINED or isinstance(value, tuple) else value)
    if kind == "val":
        return struct_hash_crdt(model, model.slots[node].get("value"))
    if kind == "obj":
        return "{" + "".join(f"{base36(hash_str(k))}:{struct_hash_crdt(model, c)}," for k, c in sorted(model.slots[node].items())) + "}"
    if kind == "vec":
        return "[" + "".join(struct_hash_crdt(model, c) + ";" for c in _cells(model, node) if c is not None) + "]"
    own = _items(model, node)
    if kind == "arr":
        return "[" + "".join(struct_hash_crdt(model, c) + ";" for c in own) + "]"
    return base36(hash32(from_units(own)) if kind == "str" else hash_bin(bytes(own)))


def struct_hash_schema(template: Template | None) -> str:
    """The hash of the nodes that a template makes."""
    builder = Builder(1)
    if template is None:
        return "U"
    at = build(template, builder)
    model = Model()
    model.apply_patch(builder.flush())
    return struct_hash_crdt(model, (at[1], at[0]))


# -- reading


@dataclass(frozen=True)
class NodeView:
    """A read-only cursor over a model."""

    model: Model
    node: Node

    @staticmethod
    def root(model: Model) -> NodeView:
        return NodeView(model, model.slots[ORIGIN].get("value", ORIGIN))

    @property
    def kind(self) -> str | None:
        return self.model.kind.get(self.node)

    def view(self):
        return self.model.view(self.node)

    def find(self, path: list) -> NodeView | None:
        """The node at a path of keys and indexes; registers are passed through."""
        node = self.node
        for step in path:
            node = self._through(node)
            kind = self.model.kind.get(node)
            if kind == "obj":
                node = self.model.slots[node].get(str(step))
            elif kind in ("vec", "arr") and str(step).isdecimal():
                own = _cells(self.model, node) if kind == "vec" else _items(self.model, node)
                node = own[int(step)] if int(step) < len(own) else None
            else:
                return None
            if node is None or node not in self.model.kind:
                return None
        return NodeView(self.model, node)

    def select(self, path: list, leaf: bool = False) -> NodeView | None:
        """As ``find``; with ``leaf``, the node that a register at the end holds."""
        found = self.find(path)
        return NodeView(self.model, self._through(found.node)) if found and leaf else found

    def _through(self, node: Node) -> Node:
        while self.model.kind.get(node) == "val":
            node = self.model.slots[node].get("value", ORIGIN)
        return node

    def as_kind(self, kind: str) -> NodeView:
        """Itself, if it is of a kind; else an error."""
        if self.kind != kind:
            raise EditError(f"NOT_{kind.upper()}")
        return self


for _name in ("con", "val", "obj", "vec", "str", "bin", "arr"):
    setattr(NodeView, f"as_{_name}", lambda self, kind=_name: self.as_kind(kind))


def reachable(model: Model) -> set[Node]:
    """Nodes that the root leads to; the others are what overwriting left behind."""
    seen, todo = set(), [model.slots[ORIGIN].get("value")]
    while todo:
        node = todo.pop()
        if node is None or node in seen or node not in model.kind:
            continue
        seen.add(node)
        kind = model.kind[node]
        if kind in ("val", "obj", "vec"):
            todo += model.slots[node].values()
        elif kind == "arr":
            todo += model.seq[node].items.values()
        elif kind == "con" and isinstance(model.con[node], tuple):
            todo.append(model.con[node])
    return seen


def gc_tree(model: Model) -> Model:
    """A copy without the nodes that nothing leads to; the clock stays."""
    keep, own = reachable(model), copy.deepcopy(model)
    for held in (own.kind, own.con, own.seq, own.slots):
        for node in [n for n in held if n not in keep and n != ORIGIN]:
            del held[node]
    return own


# -- stores, logs and drafts


@dataclass
class PatchStore:
    """JSON Patch over one document, below a path."""

    editor: Editor
    path: str = ""

    def update(self, ops: list[dict]) -> None:
        self.editor.json_patch([{**o, "path": self.path + o["path"], **({"from": self.path + o["from"]} if "from" in o else {})} for o in ops])

    def add(self, path: str, value) -> None:
        self.update([{"op": "add", "path": path, "value": value}])

    def replace(self, path: str, value) -> None:
        self.update([{"op": "replace", "path": path, "value": value}])

    def remove(self, path: str) -> None:
        self.update([{"op": "remove", "path": path}])

    def delete(self, path: str) -> bool:
        """Remove what is there; a missing value is no error."""
        if self.get(path) is UNDEFINED:
            return False
        self.remove(path)
        return True

    def get(self, path: str = ""):
        """The value at a path, or the undefined marker."""
        steps = [s.replace("~1", "/").replace("~0", "~") for s in (self.path + path).split("/")[1:]]
        found = NodeView.root(self.editor.model).find(steps)
        return UNDEFINED if found is None else found.view()

    def bind(self, path: str) -> PatchStore:
        """A store of the same document below a longer path."""
        return PatchStore(self.editor, self.path + path)


def find_max(patches: list[dict], sid: int) -> dict | None:
    """The newest patch of a session."""
    return max((p for p in patches if p["id"][0] == sid), key=lambda p: p["id"][1], default=None)


@dataclass
class Log:
    """A starting state and the patches after it."""

    start: Callable[[], Model] = Model
    patches: list[dict] = field(default_factory=list)
    model: Model = field(default_factory=Model)

    @staticmethod
    def from_new_model(model: Model) -> Log:
        """The history of a document that is new; it starts from nothing."""
        return Log(model=model)

    @staticmethod
    def from_model(model: Model) -> Log:
        """The history that begins at a document as it is."""
        frozen = copy.deepcopy(model)
        return Log(lambda: copy.deepcopy(frozen), model=model)

    def apply(self, patch: dict) -> None:
        """Apply a patch to the end and keep it."""
        self.model.apply_patch(patch)
        self.record(patch)

    def record(self, patch: dict) -> None:
        """Keep a patch that the model has already."""
        self.patches.append(patch)

    def find_max(self, sid: int) -> dict | None:
        return find_max(self.patches, sid)

    def clone(self) -> Log:
        return Log(self.start, copy.deepcopy(self.patches), copy.deepcopy(self.model))

    def reset(self, to: Log) -> None:
        """Become a copy of another log."""
        own = to.clone()
        self.start, self.patches, self.model = own.start, own.patches, own.model


@dataclass
class Draft:
    """Local patches (``head``) on a committed base, with undone ones (``tip``) kept apart."""

    base: Model
    head_patches: list[dict] = field(default_factory=list)
    tip: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.head = copy.deepcopy(self.base)
        for patch in self.head_patches:
            self.head.apply_patch(patch)

    def rebase(self, patches: list[dict]) -> None:
        """Remote patches enter the base and the head; local ones stay as they are."""
        for patch in patches:
            self.base.apply_patch(patch)
            self.head.apply_patch(patch)


class UndoManager:
    """What an undo stack must offer."""

    def push(self, undo: Callable[[], None]) -> None:
        raise NotImplementedError

    def undo(self) -> None:
        raise NotImplementedError

    def redo(self) -> None:
        raise NotImplementedError


@dataclass(frozen=True)
class Extension:
    """A node type over a tuple [header, data]: its number, name and the view of its data."""

    number: int
    name: str
    view: Callable[[NodeView], object]


class Extensions:
    """Registered extensions by number."""

    def __init__(self) -> None:
        self.known: dict[int, Extension] = {}

    def register(self, own: Extension) -> None:
        self.known[own.number] = own

    def get(self, number: int) -> Extension | None:
        return self.known.get(number)

    def size(self) -> int:
        return len(self.known)

    def clone(self) -> Extensions:
        own = Extensions()
        own.known = dict(self.known)
        return own

    def view(self, node: NodeView):
        """The extension's view of a tuple whose first cell is a header [number, ...]; else the plain view."""
        head = node.find([0]) if node.kind == "vec" else None
        header = head.view() if head else None
        number = header[0] if isinstance(header, (list, bytes)) and len(header) == 3 else None
        own = self.known.get(number)
        data = node.find([1]) if own else None
        return own.view(data) if data else node.view()
