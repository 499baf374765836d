"""Rich text over replicated text: anchored points, ranges, and slices that annotate them.

A slice is a tuple node [header, start, end, type, data] in an array beside the text. The
header holds the stacking and the two anchors. Positions of slices come from one fold per
document; what follows from positions (last slices, containment, runs) is DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.crdt import UNDEFINED, Model, folded, from_units
from docloom.operators.edit import EditError, Editor, history, pair

# How slices stack, as the header's bits 2 to 4; bits 0 and 1 are the anchors.
STACKING = {"marker": 0, "many": 1, "one": 2, "erase": 3, "cursor": 4}
NAMES = {n: name for name, n in STACKING.items()}
BEFORE, AFTER = 0, 1


@dataclass(frozen=True)
class Point:
    """A side of an element, (time, session), of the text."""

    id: tuple[int, int]
    anchor: int = BEFORE


@dataclass(frozen=True)
class Range:
    start: Point
    end: Point

    def is_collapsed(self) -> bool:
        return self.start == self.end


class RichText:
    """The text and slices of one document, {"text": str node, "slices": arr node}."""

    def __init__(self, editor: Editor, path: tuple = ()):
        self.editor, self.path = editor, tuple(path)
        self.node = editor.typed((*self.path, "text"), "str")
        self.slices = editor.typed((*self.path, "slices"), "arr")

    def live(self) -> list[tuple[int, int]]:
        return self.editor.live(self.node)

    def text(self) -> str:
        return self.editor.model.view(self.node)

    def ins_at(self, at: int, text: str) -> None:
        self.editor.insert((), at, text, self.node)

    def del_at(self, at: int, n: int) -> None:
        self.editor.delete((), at, n, self.node)

    def point_at(self, at: int, anchor: int = BEFORE) -> Point:
        live = self.live()
        if not 0 <= at < len(live):
            raise EditError("OUT_OF_BOUNDS")
        return Point(live[at], anchor)

    def range_at(self, at: int, n: int) -> Range:
        """From before the first unit to after the last; collapsed where ``n`` is 0."""
        start = self.point_at(at)
        return Range(start, self.point_at(at + n - 1, AFTER) if n else start)

    def range(self, a: Point, b: Point) -> Range:
        """Two points in the order of the text."""
        where = self.positions()
        return Range(b, a) if self.view_pos(a, where) > self.view_pos(b, where) else Range(a, b)

    def positions(self) -> dict[tuple[int, int], tuple[int, bool]]:
        """Live units before each element, and whether it lives."""
        own, out, n = self.editor.model.seq[self.node], {}, 0
        for i in own.order(self.node):
            out[i] = (n, i not in own.dead)
            n += i not in own.dead
        out[(-1, -1)] = (n, False)
        return out

    def view_pos(self, point: Point, where: dict | None = None) -> int:
        """Position among the live units; a deleted element's is where it was, an unknown one's the end."""
        where = where or self.positions()
        if point.id == (0, 0):
            return 0
        n, alive = where.get(point.id, where[(-1, -1)])
        return n + (alive and point.anchor == AFTER)

    def length(self, own: Range) -> int:
        where = self.positions()
        return max(0, self.view_pos(own.end, where) - self.view_pos(own.start, where))

    def range_text(self, own: Range) -> str:
        where, live, seq = self.positions(), self.live(), self.editor.model.seq[self.node]
        return from_units(seq.items[i] for i in live[self.view_pos(own.start, where) : self.view_pos(own.end, where)])

    def contains(self, outer: Range, inner: Range) -> bool:
        where = self.positions()
        return self.view_pos(outer.start, where) <= self.view_pos(inner.start, where) and self.view_pos(inner.end, where) <= self.view_pos(outer.end, where)

    def add(self, own: Range, kind, stacking: str = "many", data=None) -> tuple[int, int]:
        """Annotate a range; the id of the slice's tuple."""
        b = self.editor.builder
        at = b.add("new_vec")
        header = STACKING[stacking] << 2 | own.end.anchor << 1 | own.start.anchor
        cells = [b.add("new_con", value=header), b.add("new_con", timestamp=pair(own.start.id))]
        cells.append(b.add("new_con") if own.end.id == own.start.id else b.add("new_con", timestamp=pair(own.end.id)))
        cells.append(b.add("new_con", value=kind))
        if data is not None:
            cells.append(b.json(data))
        b.add("ins_vec", obj=at, value=[[k, c] for k, c in enumerate(cells)])
        live = self.editor.live(self.slices)
        place = (b.add("ins_arr", obj=pair(self.slices), after=pair(live[-1] if live else self.slices), values=[at])[1], b.sid)
        self.editor.apply()
        live.append(place)
        return (at[1], at[0])

    def remove(self, slice_id: tuple[int, int]) -> None:
        own = self.editor.model.seq[self.slices]
        for k, i in enumerate(self.editor.live(self.slices)):
            if own.items[i] == slice_id:
                self.editor.delete((), k, 1, self.slices)
                return
        raise EditError("NOT_FOUND")

    def __iter__(self) -> Iterator[dict]:
        """Live slices in the array's order, with their ranges."""
        model: Model = self.editor.model
        own = model.seq[self.slices]
        for i in self.editor.live(self.slices):
            at = own.items[i]
            slots = model.slots[at]
            header, first = model.con[slots[0]], model.con[slots[1]]
            last = model.con.get(slots.get(2))
            last = last if isinstance(last, tuple) else first
            data = model.view(slots[4]) if 4 in slots else UNDEFINED
            span = Range(Point(first, header & 1), Point(last, header >> 1 & 1))
            yield {"id": at, "stacking": NAMES[header >> 2 & 7], "type": model.con[slots[3]], "range": span, "data": None if data is UNDEFINED else data}


ROW = "text string, slice_time long, slice_sid long, stacking string, type string, start long, stop long, covered string, data string"


def slice_rows(patches: DataFrame, doc: str, patch: str) -> DataFrame:
    """Slices of each document with their positions and text; a document without any has one row of NULLs."""

    def fold(names: tuple, rows: list[tuple]) -> list[tuple]:
        rich = RichText(Editor(history(json.loads(p) for (p,) in rows if p is not None), 0))
        where, live, items = rich.positions(), rich.live(), rich.editor.model.seq[rich.node].items
        text, out = rich.text(), []
        for s in rich:
            a, b = rich.view_pos(s["range"].start, where), rich.view_pos(s["range"].end, where)
            covered = from_units(items[i] for i in live[a:b])
            out.append((text, *s["id"], s["stacking"], json.dumps(s["type"]), a, max(a, b), covered, None if s["data"] is None else json.dumps(s["data"])))
        return out or [(text,) + (None,) * 8]

    return folded(patches.select(doc, patch), [doc], fold, ROW)


def effective(slices: DataFrame, doc: str) -> DataFrame:
    """Slices that count: of "one" slices with equal type and range the newest, the rest all."""
    own = Window.partitionBy(doc, "type", "start", "stop", "stacking").orderBy(F.desc("slice_time"), F.desc("slice_sid"))
    ranked = slices.filter(F.col("slice_time").isNotNull()).withColumn("_nth", F.row_number().over(own))
    return ranked.filter((F.col("stacking") != "one") | (F.col("_nth") == 1)).drop("_nth")


def runs(slices: DataFrame, doc: str) -> DataFrame:
    """Stretches of text between slice borders with the sorted types that cover each.

    Borders are swept: a running sum of starts and ends per type would need one window a
    type, so each document's borders and slices meet in one array, in its own row.
    """
    own = slices.filter("stop > start AND stacking IN ('many', 'one')")
    found = own.groupBy(doc).agg(F.collect_list(F.struct("type", "start", "stop")).alias("_own"))
    borders = F.array_sort(F.array_distinct(F.flatten(F.transform("_own", lambda s: F.array(s["start"], s["stop"])))))
    pieces = F.transform(F.slice("_borders", 1, F.size("_borders") - 1), lambda b, k: F.struct(b.alias("start"), F.get("_borders", k + 1).alias("stop")))
    rows = found.withColumn("_borders", borders).withColumn("_piece", F.explode(pieces))
    covering = F.filter("_own", lambda s: (s["start"] <= F.col("_piece.start")) & (s["stop"] >= F.col("_piece.stop")))
    types = F.array_sort(F.array_distinct(F.transform(covering, lambda s: s["type"])))
    return rows.select(doc, "_piece.start", "_piece.stop", types.alias("types")).filter(F.size("types") > 0)


def covers(start: Column, stop: Column, inner_start: Column, inner_stop: Column) -> Column:
    """Whether one range holds another, by position."""
    return (start <= inner_start) & (inner_stop <= stop)
