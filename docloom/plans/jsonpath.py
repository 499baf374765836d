"""JSONPath (RFC 9535): parser, evaluator, and lowering to Columns.

Paths without descendants are lowered to VARIANT expressions, which Catalyst prunes and
runs in the JVM; an object's members are then in key order, as VARIANT keeps them. All
paths can be evaluated over JSON text with document order and normalised paths, in an
Arrow function that emits (ord, path, value) rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import NUMBER_TAGS, Val, canonical, elements, is_tag, literal, members, truthy


class PathError(ValueError):
    """A path that cannot be parsed."""


# -- syntax tree


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Index:
    index: int


@dataclass(frozen=True)
class Slice:
    start: int | None = None
    end: int | None = None
    step: int | None = None


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class Filter:
    test: object


@dataclass(frozen=True)
class Segment:
    selectors: tuple
    descendant: bool = False


@dataclass(frozen=True)
class Path:
    segments: tuple = ()
    absolute: bool = True


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    op: str  # && || !
    parts: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


FUNCTIONS = {"length": 1, "count": 1, "value": 1, "match": 2, "search": 2}
_TOKEN = re.compile(r"\s*(?:(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[\w-]+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<mark>\.\.|&&|\|\||==|!=|<=|>=|[$@.\[\]()*,:?!<>]))")


class Parser:
    """Recursive descent over tokens."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise PathError(f"unexpected {text[at]!r} at {at}")
            # After a dot a number is a name.
            kind = "word" if m.lastgroup == "number" and self.tokens and self.tokens[-1][1] in (".", "..") else m.lastgroup
            self.tokens.append((kind, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self, *wanted: str) -> str:
        own = self.peek()
        if wanted and own not in wanted or not own:
            raise PathError(f"expected {' or '.join(wanted) or 'more'}, found {own or 'the end'}")
        self.at += 1
        return own

    def path(self) -> Path:
        root = self.take("$", "@")
        segments = []
        while self.peek() in (".", "..", "["):
            segments.append(self.segment())
        return Path(tuple(segments), root == "$")

    def segment(self) -> Segment:
        mark = self.peek()
        if mark == "[":
            return Segment(self.bracket())
        self.take()
        if mark == ".." and self.peek() == "[":
            return Segment(self.bracket()[:1], True)  # after ".." the first selector alone counts
        if self.peek() == "*":
            self.take()
            return Segment((Wildcard(),), mark == "..")
        if self.kind() != "word":
            raise PathError(f"expected a name, found {self.peek() or 'the end'}")
        return Segment((Name(self.take()),), mark == "..")

    def bracket(self) -> tuple:
        self.take("[")
        out = [self.selector()]
        while self.peek() == ",":
            self.take()
            out.append(self.selector())
        self.take("]")
        return tuple(out)

    def integer(self) -> int:
        own = self.take()
        if not re.fullmatch(r"-?\d+", own):
            raise PathError(f"expected an integer, found {own}")
        return int(own)

    def selector(self):
        if self.peek() == "*":
            self.take()
            return Wildcard()
        if self.peek() == "?":
            self.take()
            return Filter(self.either())
        if self.kind() == "string":
            return Name(unquote(self.take()))
        start = self.integer() if self.kind() == "number" else None
        if self.peek() != ":":
            if start is None:
                raise PathError(f"expected a selector, found {self.peek() or 'the end'}")
            return Index(start)
        self.take()
        end = self.integer() if self.kind() == "number" else None
        step = None
        if self.peek() == ":":
            self.take()
            step = self.integer()
        return Slice(start, end, step)

    def either(self):
        parts = [self.both()]
        while self.peek() == "||":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Logic("||", tuple(parts))

    def both(self):
        parts = [self.negated()]
        while self.peek() == "&&":
            self.take()
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else Logic("&&", tuple(parts))

    def negated(self):
        if self.peek() == "!":
            self.take()
            return Logic("!", (self.negated(),))
        if self.peek() == "(":
            self.take()
            own = self.either()
            self.take(")")
            return own
        left = self.operand()
        if self.peek() in ("==", "!=", "<", "<=", ">", ">="):
            return Compare(self.take(), left, self.operand())
        return left

    def operand(self):
        if self.peek() in ("$", "@"):
            return self.path()
        if self.kind() == "number":
            own = self.take()
            return Literal(int(own) if re.fullmatch(r"-?\d+", own) else float(own))
        if self.kind() == "string":
            return Literal(unquote(self.take()))
        if self.kind() == "word":
            word = self.take()
            if word in ("true", "false", "null"):
                return Literal({"true": True, "false": False, "null": None}[word])
            if word not in FUNCTIONS:
                raise PathError(f"unknown function {word}")
            self.take("(")
            args = [self.operand()]
            while self.peek() == ",":
                self.take()
                args.append(self.operand())
            self.take(")")
            if len(args) != FUNCTIONS[word]:
                raise PathError(f"{word} takes {FUNCTIONS[word]} arguments")
            return Call(word, tuple(args))
        raise PathError(f"expected an operand, found {self.peek() or 'the end'}")


def unquote(own: str) -> str:
    body = own[1:-1]
    if own[0] == "'":
        body = body.replace("\\'", "'").replace('"', '\\"')
    return json.loads(f'"{body}"')


def parse(text: str) -> Path:
    parser = Parser(text.strip())
    if parser.peek() != "$":
        raise PathError("a path starts with $")
    own = parser.path()
    if parser.at < len(parser.tokens):
        raise PathError(f"unexpected {parser.peek()!r}")
    return own


def to_text(node) -> str:
    """The text of a syntax tree."""
    if isinstance(node, Path):
        return ("$" if node.absolute else "@") + "".join(to_text(s) for s in node.segments)
    if isinstance(node, Segment):
        return (".." if node.descendant else "") + "[" + ",".join(to_text(s) for s in node.selectors) + "]"
    if isinstance(node, Name):
        return "'" + json.dumps(node.name)[1:-1].replace('\\"', '"').replace("'", "\\'") + "'"
    if isinstance(node, Index):
        return str(node.index)
    if isinstance(node, Slice):
        mid = f"{'' if node.start is None else node.start}:{'' if node.end is None else node.end}"
        return mid if node.step is None else f"{mid}:{node.step}"
    if isinstance(node, Wildcard):
        return "*"
    if isinstance(node, Filter):
        return "?" + to_text(node.test)
    if isinstance(node, Literal):
        return json.dumps(node.value)
    if isinstance(node, Compare):
        return f"{to_text(node.left)} {node.op} {to_text(node.right)}"
    if isinstance(node, Call):
        return f"{node.name}({', '.join(map(to_text, node.args))})"
    if node.op == "!":
        return f"!({to_text(node.parts[0])})"
    return "(" + f" {node.op} ".join(to_text(p) for p in node.parts) + ")"


def accessed_properties(node) -> list[str]:
    """Names that the path can read, in order, once each."""
    found: dict[str, None] = {}

    def visit(own) -> None:
        if isinstance(own, Name):
            found[own.name] = None
        for part in getattr(own, "__dict__", {}).values():
            for item in part if isinstance(part, tuple) else (part,):
                visit(item)

    visit(node)
    return list(found)


# -- evaluation over Python values


@dataclass
class Node:
    value: object
    path: tuple = ()


_MISSING = object()


def children(node: Node) -> Iterator[Node]:
    if isinstance(node.value, dict):
        yield from (Node(v, (*node.path, k)) for k, v in node.value.items())
    elif isinstance(node.value, list):
        yield from (Node(v, (*node.path, k)) for k, v in enumerate(node.value))


def select(selector, node: Node, root) -> Iterator[Node]:
    own = node.value
    if isinstance(selector, Name):
        if isinstance(own, dict) and selector.name in own:
            yield Node(own[selector.name], (*node.path, selector.name))
    elif isinstance(selector, Index):
        if isinstance(own, list) and -len(own) <= selector.index < len(own):
            k = selector.index % len(own)
            yield Node(own[k], (*node.path, k))
    elif isinstance(selector, Wildcard):
        yield from children(node)
    elif isinstance(selector, Slice):
        if isinstance(own, list) and selector.step != 0:
            yield from (Node(own[k], (*node.path, k)) for k in range(len(own))[slice(selector.start, selector.end, selector.step)])
    elif isinstance(own, dict) and not node.path:  # at the root a filter tests the object itself
        if holds(selector.test, own, root):
            yield node
    else:
        yield from (c for c in children(node) if holds(selector.test, c.value, root))


def descend(node: Node) -> Iterator[Node]:
    """The node and all below it, each before its children; no generator a level."""
    stack = [node]
    while stack:
        own = stack.pop()
        yield own
        if isinstance(own.value, (dict, list)):
            stack += [*children(own)][::-1]


def _named_below(name: str, node: Node) -> list[Node]:
    """The values of a name in the node and all below it, in the order of ``descend``; a path is made for each found one."""
    found: list[Node] = []

    def visit(value, path: tuple) -> None:
        if isinstance(value, dict):
            if name in value:
                found.append(Node(value[name], (*path, name)))
            for k, v in value.items():
                if isinstance(v, (dict, list)):
                    visit(v, (*path, k))
        else:
            for k, v in enumerate(value):
                if isinstance(v, (dict, list)):
                    visit(v, (*path, k))

    if isinstance(node.value, (dict, list)):
        visit(node.value, node.path)
    return found


def evaluate(path: Path, root, current=_MISSING) -> list[Node]:
    nodes = [Node(root if path.absolute or current is _MISSING else current)]
    for segment in path.segments:
        if segment.descendant and len(segment.selectors) == 1 and isinstance(segment.selectors[0], Name):
            nodes = [f for n in nodes for f in _named_below(segment.selectors[0].name, n)]
            continue
        if segment.descendant:
            nodes = [d for n in nodes for d in descend(n)]
        nodes = [f for n in nodes for s in segment.selectors for f in select(s, n, root)]
    return nodes


def _operand(own, current, root):
    """A value, or _MISSING."""
    if isinstance(own, Literal):
        return own.value
    if isinstance(own, Path):
        found = evaluate(own, root, current)
        return _MISSING if not found else found[0].value if len(found) == 1 else [n.value for n in found]
    return _call(own, current, root)


def _call(own: Call, current, root):
    nodes = [evaluate(a, root, current) if isinstance(a, Path) else [Node(_operand(a, current, root))] for a in own.args]
    if own.name == "count":
        return len(nodes[0])
    single = [n[0].value if len(n) == 1 else _MISSING for n in nodes]
    if own.name == "value":
        return single[0]
    if own.name == "length":
        return len(single[0]) if isinstance(single[0], (str, list, dict)) else _MISSING
    text, pattern = single
    if not isinstance(text, str) or not isinstance(pattern, str):
        return False
    try:
        return bool((re.fullmatch if own.name == "match" else re.search)(pattern, text))
    except re.error:
        return False


def _alike(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b)
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_alike, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_alike(v, b[k]) for k, v in a.items())
    return a == b


def compare(op: str, a, b) -> bool:
    if a is _MISSING or b is _MISSING:
        return op == "==" and a is b
    a, b = (x[0] if isinstance(x, list) and len(x) == 1 else x for x in (a, b))
    if op in ("==", "!="):
        return _alike(a, b) == (op == "==")
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if number(a) and number(b) or type(a) is type(b) and isinstance(a, (str, bool)):
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return op in ("<=", ">=") and _alike(a, b)


def holds(test, current, root) -> bool:
    if isinstance(test, Compare):
        return compare(test.op, _operand(test.left, current, root), _operand(test.right, current, root))
    if isinstance(test, Logic):
        if test.op == "!":
            return not holds(test.parts[0], current, root)
        return (all if test.op == "&&" else any)(holds(p, current, root) for p in test.parts)
    if isinstance(test, Path):
        return bool(evaluate(test, root, current))
    own = _operand(test, current, root)
    if own is _MISSING or own is None:
        return False
    if isinstance(own, (bool, int, float)):
        return bool(own)
    return not isinstance(own, list) or bool(own)


def normalized(path: tuple) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else _bracketed(s) for s in path)


@lru_cache(4096)
def _bracketed(name: str) -> str:
    return "[" + to_text(Name(name)) + "]"


def pointer(path: tuple) -> str:
    return "".join("/" + str(s).replace("~", "~0").replace("/", "~1") for s in path)


def path_nodes(df: DataFrame, doc: str, path: str, keys: list[str]) -> DataFrame:
    """Rows (keys..., ord, path, pointer, value) of the path's nodes in each JSON text; bad text has none."""
    tree, dump = parse(path), json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode

    @F.pandas_udf("array<struct<path:string,pointer:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                found = evaluate(tree, json.loads(text))
            except (TypeError, ValueError):
                return []
            return [{"path": normalized(n.path), "pointer": pointer(n.path), "value": dump(n.value)} for n in found]

        return texts.map(one)

    nodes = df.select(*keys, F.posexplode(run(F.col(doc))).alias("ord", "node"))
    return nodes.select(*keys, "ord", "node.path", "node.pointer", "node.value")


# -- lowering to Columns


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """A Column of a value that is computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _variant_path(segments: tuple) -> tuple[str, tuple]:
    """The longest prefix of plain names and indexes as one VARIANT path, and the rest."""
    out = "$"
    for k, s in enumerate(segments):
        own = s.selectors[0]
        if s.descendant or len(s.selectors) > 1 or not isinstance(own, (Name, Index)) or isinstance(own, Index) and own.index < 0:
            return out, segments[k:]
        quoted = "" if isinstance(own, Index) else own.name.replace("\\", "\\\\").replace("'", "\\'")
        out += f"[{own.index}]" if isinstance(own, Index) else f"['{quoted}']"
    return out, ()


@dataclass
class Lowering:
    root: Column

    def direct(self, path: Path, current: Column) -> Column | None:
        """The value of a path of plain names and indexes in one access, else None."""
        prefix, rest = _variant_path(path.segments)
        return None if rest else F.try_variant_get(self.root if path.absolute else current, prefix, "variant")

    def path(self, path: Path, current: Column) -> Column:
        """The path's nodes as array<variant>."""
        start = self.root if path.absolute else current
        prefix, rest = _variant_path(path.segments)
        at_root = path.absolute and prefix == "$"
        start = start if prefix == "$" else F.try_variant_get(start, prefix, "variant")
        if rest and not any(s.descendant for s in rest[:1]):  # the first step needs no list of nodes
            nodes = self.step(rest[0], at_root)(start)
            if any(isinstance(s, Filter) for s in rest[0].selectors):
                nodes = F.when(start.isNotNull(), nodes).otherwise(F.array().cast("array<variant>"))
            rest = rest[1:]
        else:
            nodes = F.filter(F.array(start), lambda x: x.isNotNull())
        while rest:
            prefix, after = _variant_path(rest)
            if len(after) < len(rest):  # plain names and indexes lead each node to one at most
                nodes = F.filter(F.transform(nodes, self.below(prefix)), lambda x: x.isNotNull())
                rest = after
                continue
            if rest[0].descendant:
                raise PathError("descendants are evaluated by path_nodes")
            nodes, rest = F.flatten(F.transform(nodes, self.step(rest[0], False))), rest[1:]
        return nodes

    def below(self, path: str) -> Callable[[Column], Column]:
        return lambda n: F.try_variant_get(n, path, "variant")

    def step(self, segment: Segment, at_root: bool) -> Callable[[Column], Column]:
        """A node's results of all selectors, in their order."""
        if len(segment.selectors) == 1:
            return lambda n: self.select(segment.selectors[0], n, at_root)
        return lambda n: F.concat(*[self.select(s, n, at_root) for s in segment.selectors])

    def select(self, selector, n: Column, at_root: bool) -> Column:
        none = F.array().cast("array<variant>")
        items = F.coalesce(elements(Val(n, "json")).col, none)
        if isinstance(selector, Name):
            quoted = selector.name.replace("\\", "\\\\").replace("'", "\\'")
            return F.filter(F.array(F.try_variant_get(n, f"$['{quoted}']", "variant")), lambda x: x.isNotNull())
        if isinstance(selector, Index):
            at = F.get(items, F.lit(selector.index)) if selector.index >= 0 else F.try_element_at(items, F.lit(selector.index))
            return F.filter(F.array(at), lambda x: x.isNotNull())
        values = F.coalesce(F.map_values(members(Val(n, "json")).col), none)
        if isinstance(selector, Wildcard):
            return F.coalesce(elements(Val(n, "json")).col, values)
        if isinstance(selector, Slice):
            return let(items, lambda own: self.slice(selector, own))
        if at_root:  # at the root a filter tests an object itself
            itself = F.filter(F.array(n), lambda x: is_tag(x, "OBJECT") & self.test(selector.test, x))
            return F.concat(itself, F.filter(items, lambda x: self.test(selector.test, x)))
        return F.filter(F.concat(items, values), lambda x: self.test(selector.test, x))

    def slice(self, own: Slice, items: Column) -> Column:
        step = 1 if own.step is None else own.step
        if step == 0:
            return F.array().cast("array<variant>")
        if step == 1 and (own.start or 0) >= 0 and own.end is not None and own.end >= 0:
            return F.slice(items, (own.start or 0) + 1, max(own.end - (own.start or 0), 0))
        if step == -1 and own.start is None and own.end is None:
            return F.reverse(items)
        size = F.size(items)

        def bound(value: int | None, default: Column, low: Column, high: Column) -> Column:
            if value is None:
                return default
            return F.least(F.greatest(F.lit(value) if value >= 0 else size + value, low), high)

        zero = F.lit(0)
        if step > 0:
            start, end = bound(own.start, zero, zero, size), bound(own.end, size, zero, size)
            return F.filter(items, lambda _, k: (k >= start) & (k < end) & ((k - start) % step == 0))
        start, end = bound(own.start, size - 1, F.lit(-1), size - 1), bound(own.end, F.lit(-1), F.lit(-1), size - 1)
        return F.reverse(F.filter(items, lambda _, k: (k <= start) & (k > end) & ((start - k) % -step == 0)))

    def operand(self, own, current: Column) -> Val:
        """A value; SQL NULL where it is missing."""
        if isinstance(own, Literal):
            return literal(own.value)
        if isinstance(own, Path):
            if (value := self.direct(own, current)) is not None:
                return Val(value, "json")
            nodes = self.path(own, current)
            return Val(F.when(F.size(nodes) <= 1, F.get(nodes, F.lit(0))).otherwise(nodes.cast("variant")), "json")
        return self.call(own, current)

    def call(self, own: Call, current: Column) -> Val:
        if own.name == "count":
            return Val(F.size(self.path(own.args[0], current)).cast("long"), "num")
        args = [self.operand(a, current) for a in own.args]
        if own.name == "value":
            return args[0]
        if own.name == "length":
            v = args[0]
            if v.kind == "str":
                return Val(F.char_length(v.col).cast("long"), "num")
            size = F.when(is_tag(v.col, "STRING"), F.char_length(F.try_variant_get(v.col, "$", "string"))).when(is_tag(v.col, "ARRAY"), F.size(elements(v).col)).when(is_tag(v.col, "OBJECT"), F.size(members(v).col))
            return Val(size.cast("long"), "num")
        subject, pattern = args
        words = subject.col if subject.kind == "str" else F.when(is_tag(subject.col, "STRING"), F.try_variant_get(subject.col, "$", "string"))
        if not isinstance(own.args[1], Literal):
            raise PathError("a pattern is a literal")
        regex = own.args[1].value if own.name == "search" else f"^(?:{own.args[1].value})$"
        return Val(F.coalesce(words.rlike(regex), F.lit(False)), "bool")

    def test(self, test, current: Column) -> Column:
        if isinstance(test, Logic):
            parts = [self.test(p, current) for p in test.parts]
            return ~parts[0] if test.op == "!" else reduce((lambda a, b: a & b) if test.op == "&&" else (lambda a, b: a | b), parts)
        if isinstance(test, Path):
            value = self.direct(test, current)
            return F.size(self.path(test, current)) > 0 if value is None else value.isNotNull()
        if isinstance(test, Compare):
            return self.compare(test.op, self.operand(test.left, current), self.operand(test.right, current))
        return truthy(self.operand(test, current))

    def compare(self, op: str, a: Val, b: Val) -> Column:
        there = a.col.isNotNull() & b.col.isNotNull()
        if op in ("==", "!="):
            same = canonical(a) == canonical(b)
            if op == "!=":
                return F.coalesce(there & ~same, F.lit(False))
            return F.coalesce((there & same) | (a.col.isNull() & b.col.isNull()), F.lit(False))
        step = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]

        def typed(v: Val, kind: str, sql: str, tags: tuple[str, ...]) -> Column:
            if v.kind == "json":
                return F.when(is_tag(v.col, *tags), F.try_variant_get(v.col, "$", sql))
            return v.col.cast(sql) if v.kind == kind else F.lit(None).cast(sql)

        kinds = (("num", "double", NUMBER_TAGS), ("str", "string", ("STRING",)), ("bool", "boolean", ("BOOLEAN",)))
        known = {v.kind for v in (a, b)} - {"json"}
        found = [step(typed(a, k, s, t), typed(b, k, s, t)) for k, s, t in kinds if known <= {k}]
        rest = there & (canonical(a) == canonical(b)) if op in ("<=", ">=") else F.lit(False)
        return F.coalesce(*found, rest, F.lit(False))


def path_values(doc: Column, path: str) -> Column:
    """The path's values in a VARIANT as array<variant>; paths with descendants are refused."""
    return Lowering(doc).path(parse(path), doc)


def path_value(doc: Column, path: str, kind: str = "string") -> Column:
    """The single value of a path, cast; NULL where there is none or more than one."""
    prefix, rest = _variant_path(parse(path).segments)
    if not rest:
        return F.try_variant_get(doc, prefix, kind)
    return let(path_values(doc, path), lambda found: F.when(F.size(found) == 1, F.try_variant_get(F.get(found, F.lit(0)), "$", kind)))
