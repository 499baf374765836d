"""Expressions, paths, patches, diffs, replicas and types on small cases and random ones."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import json_utils as U
from docloom.functions.values import to_variant
from docloom.operators import crdt, diff, patch, types
from docloom.plans import expression as X
from docloom.plans import jsonpath as J

JSON = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text("ab~/", max_size=3), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text("ab~/", max_size=2), v, max_size=4), max_leaves=12)


# Expressions over one row: {"k": 5, "a": [3, 1, 2], "o": {"x": null, "y": "t"}, "s": "héllo"} under /j.
CASES = [
    (["+", 1, 2], 3.0), (["-", 5, 1, 1], 3.0), (["*", 2, "3"], 6.0), (["/", 5, 0], None), (["%", -5, 3], -2.0), (["round", -0.5], -1.0), (["round", 2.5], 3.0), (["trunc", -1.7], -1.0), (["ln", 0], None), (["sqrt", -1], None), (["**", 2, 10], 1024.0), (["log", 8, 2], 3.0),
    (["==", ["$", "/j/k"], 5], True), (["==", ["$", "/j/a"], [[3, 1, 2]]], True), ([">", "10", 9], False), (["<", 2, 10], True), (["cmp", 1, 2], -1), (["><", 5, 1, 5], False), (["=><=", 5, 1, 5], True),
    (["&&", 0, 1], 0), (["||", "", "x"], "x"), (["!", ""], True), (["?", ["$", "/j/k"], "y", "n"], "y"),
    (["type", ["$", "/j/o"]], "object"), (["type", ["$", "/j/zz"]], "undefined"), (["num", " 12 "], 12.0), (["num", "1d"], 0.0), (["str", ["$", "/j/a"]], "[3,1,2]"), (["str", None], "null"), (["len", ["$", "/j/s"]], 5), (["len", ["$", "/j/o"]], 2), (["nil?", ["$", "/j/o/x"]], True), (["und?", ["$", "/j/zz"]], True),
    (["[]", ["$", "/j/a"], 0], 3), (["[]", ["$", "/arr"], 9], None), (["[]", "abc", 1], "b"), (["cat", "a", 1, ["$", "/s"]], "a1ab"), (["substr", "abcdef", 1, -1], "bcde"), (["substr", "abc", 2, 1], ""), (["matches", "abc", "^a"], True),
    (["ip6?", "::1"], True), (["duration?", "P1DT"], False), (["duration?", "P"], False), (["date?", "2023-02-29"], False), (["time?", "23:59:60Z"], True), (["time?", "22:59:60Z"], False), (["time?", "12:00:00"], False), (["email?", 5], False),
    (["head", ["$", "/arr"], -2], [1, 2]), (["sort", ["$", "/j/a"]], [1, 2, 3]), (["slice", ["$", "/arr"], 2, 1], []), (["zip", ["$", "/arr"], [["a", "b"]]], [[3, "a"], [1, "b"]]), (["push", ["$", "/j/a"], 7], [3, 1, 2, 7]), (["indexOf", ["$", "/j/a"], 9], -1), (["in", ["$", "/arr"], 2], True),
    (["map", ["$", "/j/a"], "x", ["+", ["$", "x"], 1]], [4.0, 2.0, 3.0]), (["reduce", ["$", "/arr"], 0, "a", "x", ["+", ["$", "a"], ["$", "x"]]], 6.0), (["filter", ["$", "/arr"], "x", [">", ["$", "x"], 1]], [3, 2]),
    (["keys", ["$", "/j/o"]], ["x", "y"]), (["fromEntries", ["entries", ["$", "/j/o"]]], {"x": None, "y": "t"}), (["o.set", ["$", "/j/o"], "y", 1], {"x": None, "y": 1}), (["o.del", ["$", "/j/o"], "x"], {"y": "t"}), (["jp.add", ["$", "/j/o"], "/w", ["+", 1, 1]], {"x": None, "y": "t", "w": 2}),
    (["$", "/zz", "other"], "other"), (["$?", "/j/o/x"], True), (["$?", "/j/o/z"], False), (["|", 4294967296, 1], 1), (["~", 5], -6), (["&", 3000000000, -1], -1294967296), ([[1, 2]], [1, 2]), ([], []),
]


def test_expressions(spark):
    df = spark.createDataFrame([("ab", '{"k":5,"a":[3,1,2],"o":{"x":null,"y":"t"},"s":"héllo"}', [3, 1, 2])], "s string, j string, arr array<long>")
    found = []
    for expression, _ in CASES:
        value = X.compile_value(expression, X.row_context(df, ("j",)))
        found.append(value.col.cast("string") if value.kind == "undef" else F.to_json(to_variant(value)))
    row = df.select(*[c.alias(f"c{k}") for k, c in enumerate(found)]).first()
    for (expression, want), got in zip(CASES, row, strict=True):
        assert (None if got is None else json.loads(got)) == want, expression


def test_expression_errors(spark):
    df = spark.range(1)
    for bad in (["nope", 1], ["+", 1], ["abs", 1, 2], [5, 1], ["o.set", ["$", ""], "__proto__", 1]):
        with pytest.raises(X.ExpressionError):
            X.compile_expression(bad, df)
    for broken in (["/", 1, 0], ["$", "/none"], ["throw", "stop"]):
        with pytest.raises(Exception, match="DIVISION|NOT_FOUND|stop"):
            df.select(X.compile_expression(broken, df, strict=True).alias("x")).collect()


DOC = {"store": {"book": [{"t": "a", "p": 8, "x": None}, {"t": "b", "p": 12}, {"t": "c", "p": 5}], "n": 3}, "z": [1, [2, 3]]}
PATHS = {
    "$.store.book[*].t": ["a", "b", "c"], "$.store.book[-1].p": [5], "$.store.book[0:2].p": [8, 12], "$.store.book[::-1].t": ["c", "b", "a"], "$.store.book[::0]": [], "$..p": [8, 12, 5], "$.store.book[?@.p>6].t": ["a", "b"], "$.store.book[?@.x==null].t": ["a"], "$.store.book[?@.x].t": ["a"],
    "$.store.book[?length(@.t)==1 && (@.p<10 || !@.x)].t": ["a", "b", "c"], "$['z','store'].n": [3], "$.z[1][*]": [2, 3], "$.store.book[?match(@.t,'[ab]')].p": [8, 12], "$.store.book[?search(@.t,'c')].p": [5], "$.store.book[?@.q==@.r].t": ["a", "b", "c"], "$.store.book[?@.q!=1].t": [], "$.store.book[?count(@.*)>2].t": ["a"], "$.z[5]": [], "$": [DOC], "$.store.book[?value(@.p)==12].t": ["b"], "$.store.book[?@.p>=$.store.n].p": [8, 12, 5],
}


def test_paths(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC)), (2, "broken"), (3, None)], "id long, d string")
    for path, want in PATHS.items():
        tree = J.parse(path)
        assert [n.value for n in J.evaluate(tree, DOC)] == want, path
        assert J.parse(J.to_text(tree)) == tree
        rows = J.path_nodes(df, "d", path, ["id"]).orderBy("ord").collect()
        assert [json.loads(r.value) for r in rows] == want
        if ".." not in path:
            got = df.filter("id = 1").select(F.transform(J.path_values(F.parse_json("d"), path), lambda x: F.to_json(x))).first()[0]
            assert [json.loads(x) for x in got] == want, path
    nodes = J.evaluate(J.parse("$.store.book[1].t"), DOC)
    assert (J.normalized(nodes[0].path), J.pointer(nodes[0].path)) == ("$['store']['book'][1]['t']", "/store/book/1/t")
    assert J.accessed_properties(J.parse("$.a[?@.b == $.c]..d")) == ["a", "b", "c", "d"]
    for bad in ("", "a", "$.", "$[", "$[?]", "$.a b", "$[1:2:]", "$[?nope(@)]", "$[?length()]"):
        with pytest.raises(J.PathError):
            J.parse(bad)


@settings(max_examples=300, deadline=None)
@given(JSON, JSON)
def test_patch_diff_rebuilds(a, b):
    ops = patch.diff(a, b)
    assert patch.same(patch.apply_ops(a, ops)[0], b)
    assert patch.from_compact(patch.to_compact(ops)) == ops == patch.from_compact(patch.to_compact(ops, True))
    assert not ops or patch.validate_operations(ops) is None


def test_patch_errors():
    cases = [({"op": "remove", "path": ""}, "INVALID_TARGET"), ({"op": "remove", "path": "/x"}, "NOT_FOUND"), ({"op": "add", "path": "/a/9", "value": 1}, "INVALID_INDEX"), ({"op": "add", "path": "/a/01", "value": 1}, "INVALID_INDEX"), ({"op": "move", "from": "/o", "path": "/o/x"}, "INVALID_TARGET"), ({"op": "flip", "path": "/a"}, "INVALID_TARGET"), ({"op": "str_del", "path": "/s", "pos": 1, "len": 9}, "INVALID_INDEX"), ({"op": "test", "path": "/none", "value": 1, "not": True}, "NOT_FOUND"), ({"op": "less", "path": "/s", "value": 1}, "TEST")]
    for op, code in cases:
        with pytest.raises(patch.PatchError, match=code):
            patch.apply_ops({"a": [1], "o": {}, "s": "xy"}, [op])
    doc, olds = patch.apply_ops({"a": ["xy", "z"]}, [{"op": "split", "path": "/a/0", "pos": 1}, {"op": "merge", "path": "/a/1", "pos": 0}, {"op": "inc", "path": "/n", "inc": 1}][:2])
    assert doc == {"a": ["x", "yz"]} and olds == ["xy", "y"]
    assert patch.transform([{"op": "add", "path": "/a/0", "value": 1}], [{"op": "remove", "path": "/a/2"}]) == [{"op": "remove", "path": "/a/3"}]
    assert patch.transform([{"op": "remove", "path": "/a"}], [{"op": "inc", "path": "/a/b", "inc": 1}]) == []


TEXTS = st.text("abc", max_size=10)


def _operation(rng, n):
    out = []
    while n > 0 and len(out) < 6:
        k, kind = rng.randint(1, n), rng.random()
        out.append(k if kind < 0.4 else -k if kind < 0.7 else "XY")
        n -= k if kind < 0.7 else 0
    return diff.ot_trim(diff.ot_normalize(out))


def test_text_differences_and_operations():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abc \n", k=rng.randint(0, 12))) for _ in range(2))
        if rng.random() < 0.05:
            a, b = a * 90, b * 90
        p = diff.diff(a, b)
        assert (diff.patch_src(p), diff.patch_dst(p)) == (a, b)
        assert (diff.patch_src(diff.invert(p)), diff.patch_dst(diff.invert(p))) == (b, a)
        lines = diff.line_diff(a.split("\n"), b.split("\n"))
        assert [s for k, s, _ in lines if k != "ins"] == list(range(a.count("\n") + 1)) and [d for k, _, d in lines if k != "del"] == list(range(b.count("\n") + 1))
        t = "abcdefgh"
        x, z = _operation(rng, 8), _operation(rng, 8)
        y = _operation(rng, len(diff.ot_apply(t, x)))
        assert diff.ot_apply(t, diff.ot_compose(x, y)) == diff.ot_apply(diff.ot_apply(t, x), y)
        assert diff.ot_apply(diff.ot_apply(t, x), diff.ot_transform(z, x, False)) == diff.ot_apply(diff.ot_apply(t, z), diff.ot_transform(x, z, True))
    assert diff.bin_diff(b"\xff\x00", b"\xff\x01") == [(0, b"\xff"), (-1, b"\x00"), (1, b"\x01")]
    assert diff.str_cnt("aa", "aaaa") == 2 and diff.str_cnt("", "a") == 0


@settings(max_examples=100, deadline=None)
@given(JSON)
def test_builder_makes_the_value(value):
    model = crdt.Model()
    model.apply_patch(crdt.Builder(5).root(value).flush())
    assert patch.same(model.view(), value)


def test_replicas_converge():
    rng = random.Random(4)
    for _ in range(60):
        first = crdt.Builder(1).root({"t": "ab", "l": [1]}).flush()
        base = crdt.Model()
        base.apply_patch(first)
        text = next(i for i, k in base.kind.items() if k == "str")
        patches = [first]
        for sid in (2, 3, 4):
            replica = crdt.Model()
            for p in [first, *rng.sample(patches[1:], rng.randint(0, len(patches) - 1))]:
                replica.apply_patch(p)
            b = crdt.Builder(sid, max(replica.clock.values()) + 1)
            for _ in range(rng.randint(1, 4)):
                live = replica.seq[text].live(text)
                after = rng.choice([text, *live])
                b.add("ins_str", obj=[text[1], text[0]], after=[after[1], after[0]], value=rng.choice(["x", "y😀", "zz"]))
                if live and rng.random() < 0.4:
                    gone = rng.choice(live)
                    b.add("del", obj=[text[1], text[0]], what=[[gone[1], gone[0], 1]])
            patches.append(b.flush())
        views = set()
        for _ in range(6):
            order = [first, *rng.sample(patches[1:], len(patches) - 1)]
            model = crdt.Model()
            for p in sorted(order * 2, key=lambda p: p["id"][1]) if rng.random() < 0.5 else sorted(order, key=lambda p: (p["id"][1], rng.random())):
                model.apply_patch(p)
            views.add(json.dumps(model.view()))
        assert len(views) == 1


def test_patch_tools():
    b = crdt.Builder(1)
    node = b.add("new_str")
    one = b.add("ins_str", obj=node, after=node, value="ab")
    b.add("ins_str", obj=node, after=[1, one[1] + 1], value="c")
    p = b.flush()
    joined = crdt.compact(p)
    assert [o["op"] for o in joined["ops"]] == ["new_str", "ins_str"] and joined["ops"][1]["value"] == "abc"
    moved = crdt.rebase(p, 11)
    assert moved["id"] == [1, 11] and moved["ops"][1]["obj"] == [1, 11]
    late = {"id": [1, 9], "ops": [{"op": "nop", "len": 2}]}
    assert crdt.combine([p, late])["ops"][-2] == {"op": "nop", "len": 4}
    with pytest.raises(ValueError, match="SID"):
        crdt.combine([p, {"id": [2, 9], "ops": []}])


def test_hashes_and_sizes(spark):
    assert U.hash32(None) == (5381 * 33 + U.NULL) & U.MASK and U.hash32({"a": 1, "b": 2}) == U.hash32({"b": 2, "a": 1})
    assert U.size_fast({"a": [1, "x", None]}) == 2 + 3 + 2 + 9 + 5 + 1
    df = spark.createDataFrame([("abc",), ("",), ("é",)], "t string")
    got = df.select(U.hash_column(U.as_string_column(F.col("t"))).alias("a"), U.hash_str_column(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert U.word_wrap("aa bb ccc", 5) == ["aa bb", "ccc"] and U.pretty_one_line({"a": [1, 2]}) == '{ "a": [ 1, 2 ] }'
    assert U.to_html(["p", {"c": "<"}, "a&b", ["br"]]) == '<p c="&lt;">a&amp;b<br /></p>'


SCHEMA = {"kind": "obj", "keys": [{"key": "n", "value": {"kind": "num", "format": "u8"}}, {"key": "l", "value": {"kind": "arr", "head": [{"kind": "str"}], "type": {"kind": "bool"}, "max": 2}, "optional": True}, {"key": "u", "value": {"kind": "or", "types": [{"kind": "con", "value": None}, {"kind": "str", "min": 2}]}, "optional": True}]}


def test_types(spark):
    cases = {'{"n":1}': None, '{"n":256}': "UINT", '{"n":1.5}': "UINT", '{"n":"1"}': "NUM", "{}": "KEY", "[]": "OBJ", '{"n":1,"z":0}': "KEYS", '{"n":1,"l":["a",true]}': None, '{"n":1,"l":["a",1]}': "BOOL", '{"n":1,"l":[]}': "TUP", '{"n":1,"l":["a",true,true,true]}': "ARR_LEN", '{"n":1,"u":null}': None, '{"n":1,"u":"a"}': "OR", '{"n":1,"u":"ab"}': None}
    types.check(SCHEMA)
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.e for r in df.select("t", types.validator(F.parse_json("t"), SCHEMA).alias("e")).collect()}
    assert got == cases
    assert types.from_value({"a": [1, 2], "b": [1, "x"], "c": None})["keys"][1]["value"]["head"][1] == {"kind": "str"}
    assert types.to_json_schema(SCHEMA)["required"] == ["n"] and types.to_jtd(SCHEMA)["properties"]["n"] == {"type": "uint8"}
    assert types.to_typescript(SCHEMA) == "{ n: number; l?: [string, ...boolean[]]; u?: null | string }"
    assert types.spark_type(types.from_value({"a": 1.5})).simpleString() == "struct<a:double>"
    with pytest.raises(types.SchemaError):
        types.check({"kind": "num", "gt": 1, "gte": 1})


def test_log_files(spark, tmp_path):
    from docloom.sources import codecs, logs

    (tmp_path / "a.seq").write_bytes(b"".join(codecs.cbor_encode(v) for v in ({"a": 1}, [b"x"])))
    rows = logs.read_cbor_sequences(spark, str(tmp_path / "a.seq")).orderBy("ord").collect()
    assert [json.loads(r.text) for r in rows] == [{"a": 1}, [codecs.DATA_URI + "eA=="]]
    logs.write_ndjson(spark.createDataFrame([('{"a":1}',), ("bad",)], "t string"), "t", str(tmp_path / "nd"))
    back = logs.read_ndjson(spark, str(tmp_path / "nd"))
    assert back.filter("doc is null").count() == 1 and back.count() == 2


def test_many_edits_keep_unchanged_items():
    old = [f"line {k}" for k in range(3000)]
    new = [f"other {k}" if k % 10 == 5 else v for k, v in enumerate(old)]
    found = diff.line_diff(old, new)
    assert [k for k, _, _ in found].count("eql") == 2700 and [k for k, _, _ in found].count("mix") == 300
    run = [f"new {k}" for k in range(250)]
    found = diff.line_diff(old, [*old[:10], *run, *old[10:2000], "changed", *old[2001:]])
    assert [k for k, _, _ in found].count("eql") == 2999 and [k for k, _, _ in found].count("ins") == 250
    text = "".join(random.Random(3).choices("abcdefgh", k=2000))
    b = "".join("X" if k % 5 == 0 else c for k, c in enumerate(text))
    p = diff.diff(text, b)
    assert (diff.patch_src(p), diff.patch_dst(p)) == (text, b) and sum(len(t) for k, t in p if k == diff.EQL) == 1600


def test_shortest_scripts_by_either_search(monkeypatch):
    rng = random.Random(7)
    size = lambda runs: sum(x2 - x + y2 - y for k, x, x2, y, y2 in runs if k)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 25))) for _ in range(2))
        greedy = size(diff.script(a, b))
        for limits in ((0, 1 << 26, 16), (0, 4, 2)):
            with monkeypatch.context() as m:
                for name, limit in zip(("GREEDY", "CELLS", "FREQUENT"), limits, strict=True):
                    m.setattr(diff, name, limit)
                assert size(diff.script(a, b)) == greedy
                p = diff.diff(a, b)
            assert (diff.patch_src(p), diff.patch_dst(p)) == (a, b)


def test_patch_diff_keeps_unchanged_parts():
    text = "a" * 20 + "0123456789" * 30 + "b" * 20
    new = "Xa" + text[2:-1] + "Y"
    ops = patch.diff({"t": text}, {"t": new})
    assert patch.apply_ops({"t": text}, ops)[0] == {"t": new}
    assert sum(len(o.get("str", "")) + o.get("len", 0) for o in ops) == 4
    old = [{"id": k} for k in range(50)]
    changed = [{"id": -1}, *old[:49], {"id": 99}]
    ops = patch.diff(old, changed)
    assert patch.apply_ops(old, ops)[0] == changed
    assert ops == [{"op": "add", "path": "/0", "value": {"id": -1}}, {"op": "replace", "path": "/50/id", "value": 99}]
    kept = patch.transform(patch.diff({"t": text}, {"t": new}), [{"op": "str_ins", "path": "/t", "pos": 100, "str": "Z"}])
    assert patch.apply_ops({"t": new}, kept)[0] == {"t": new[:100] + "Z" + new[100:]}


def test_diffs_of_a_batch_come_in_pieces(spark, monkeypatch):
    from pyspark.sql import functions as F

    from docloom.operators import diff

    texts = [("a\nb" * 20, "b\nc" * 20), (None, "x"), ("é\U0001f600", "\U0001f600"), ("", ""), ("same", "same"), ("x", None)] * 5
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, a string, b string").coalesce(1)
    for size in (1, 1 << 20):
        monkeypatch.setattr(diff, "PIECE", size)
        own = diff.with_diffs(rows, "a", "b")
        plan = own._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "EvalPython" not in plan
        both = own.select("k", (F.col("p").eqNullSafe(diff.diff_column(F.col("a"), F.col("b"))) & F.col("lines").eqNullSafe(diff.line_diff_column(F.col("a"), F.col("b")))).alias("same"))
        found = both.collect()
        assert sorted(r["k"] for r in found) == list(range(len(texts))) and all(r["same"] for r in found)
