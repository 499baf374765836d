"""Rich text positions and slices; random data is well formed and repeatable."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import random_data as R
from docloom.operators import richtext as T
from docloom.operators.crdt import Builder
from docloom.operators.edit import EditError, Editor, history


def test_points_ranges_and_slices(spark):
    first = Builder(7).root({"text": "hello world", "slices": []}).flush()
    rich = T.RichText(Editor(history([first]), 8))
    bold, whole = rich.range_at(0, 5), rich.range_at(0, 11)
    assert rich.range_text(bold) == "hello" and rich.length(whole) == 11 and rich.contains(whole, bold) and not rich.contains(bold, whole)
    assert rich.range(bold.end, bold.start) == bold and rich.range_at(3, 0).is_collapsed()
    rich.add(bold, -3)
    gone = rich.add(whole, -6, data={"a": 1})
    rich.add(bold, -17, "one", "x")
    rich.add(bold, -17, "one", "y")
    rich.add(rich.range_at(4, 4), -6)
    rich.add(rich.range_at(6, 0), 0, "marker")
    rich.remove(gone)
    with pytest.raises(EditError):
        rich.remove(gone)
    rich.ins_at(2, "__")
    rich.del_at(0, 1)
    assert rich.text() == "e__llo world" and rich.range_text(bold) == "e__llo"
    assert rich.view_pos(T.Point((0, 0))) == 0 and rich.view_pos(T.Point((999, 9))) == 12
    rows = [(1, json.dumps(first)), (1, json.dumps(rich.editor.flush())), (2, json.dumps(first))]
    slices = T.slice_rows(spark.createDataFrame(rows, "doc int, patch string"), "doc", "patch").cache()
    assert slices.filter("doc = 2").select("slice_time").collect() == [(None,)]
    own = T.effective(slices, "doc")
    got = sorted((r.stacking, r.type, r.start, r.stop, r.covered, r.data) for r in own.collect())
    assert got == [("many", "-3", 0, 6, "e__llo", None), ("many", "-6", 5, 9, "o wo", None), ("marker", "0", 7, 7, "", None), ("one", "-17", 0, 6, "e__llo", '"y"')]
    assert [(r.start, r.stop, r.types) for r in T.runs(own, "doc").orderBy("start").collect()] == [(0, 5, ["-17", "-3"]), (5, 6, ["-17", "-3", "-6"]), (6, 9, ["-6"])]


def test_random_strings_and_templates(spark):
    token = ("list", "id-", ("repeat", 2, 5, ("char", 48, 57)), ("pick", "a", "b"), ("char", 0x1F600, 0x1F600, 2), ("repeat", 0, 0, "x"))
    own = R.Draws(F.col("id"), F.lit(3))
    df = spark.range(200).select("id", R.random_string(token, own).alias("s"), *[R.template(t, own.at(n)).alias(n) for n, t in R.EXAMPLES.items()], R.random_json(F.col("id"), 20).alias("grown"))
    rows = df.collect()
    assert all(__import__("re").fullmatch("id-[0-9]{2,5}[ab]😀😀", r.s) for r in rows) and len({r.s for r in rows}) > 100
    for r in rows:
        user, order, tree = (json.loads(r[n]) for n in ("user", "order", "tree"))
        assert 18 <= user.get("age", 18) <= 99 and 1 <= len(order["items"]) <= 5 and len(tree["children"]) <= 2
        for n in (*R.EXAMPLES, "grown"):
            json.loads(r[n])
    assert len({"age" in json.loads(r.user) for r in rows}) == 2
    again = df.repartition(7).orderBy("id").collect()
    assert again == sorted(rows, key=lambda r: r.id)


def test_minimal_standard_generator(spark):
    got = spark.createDataFrame([(0,), (1,), (123456789,)], "s long").select(R.lcg(F.col("s")), R.lcg(F.col("s"), 3)).collect()

    def want(s, n):
        s = s or 1
        for _ in range(n):
            s = s * 48271 % 2147483647
        return (s - 1) / 2147483646

    assert [tuple(r) for r in got] == [(want(s, 1), want(s, 3)) for s in (0, 1, 123456789)]
