"""Builders, clocks, node templates and views, stores, drafts, schemas, JSON operations and command lines."""

import io
import json

import pytest

from docloom import cli
from docloom.functions import json_utils
from docloom.operators import clocks, crdt, diff, nodes, schemas, types
from docloom.operators.crdt import ORIGIN, UNDEFINED, Builder, Model
from docloom.operators.edit import Editor
from docloom.operators.schemas import S


def test_typed_builder_methods():
    b = Builder(7)
    obj, text, data, arr, vec, val = b.obj(), b.str_node(), b.bin(), b.arr(), b.vec(), b.val()
    one, ref = b.con_val(1), b.con_ref(text)
    b.ins_str(text, text, "abc")
    b.ins_bin(data, data, b"\x01\x02")
    at = b.ins_arr(arr, arr, [one])
    b.upd_arr(arr, at, b.con_val(2))
    b.ins_vec(vec, [[1, one]])
    b.set_val(val, one)
    b.ins_obj(obj, [["t", text], ["b", data], ["a", arr], ["v", vec], ["r", val], ["c", ref]])
    b.delete(text, [[7, text[1] + 8, 1]])
    b.nop(3)
    b.set_root(obj)
    patch = b.flush()
    assert crdt.patch_id(patch) == [7, 1] and crdt.next_time(patch) == b.time
    model = Model()
    model.apply_patch(patch)
    assert model.view() == {"t": "ac", "b": [1, 2], "a": [2], "v": [None, 1], "r": 1, "c": "ac"}
    for call in (lambda: b.ins_str(text, text, ""), lambda: b.ins_obj(obj, []), lambda: b.ins_arr(arr, arr, [])):
        with pytest.raises(ValueError, match="EMPTY"):
            call()
    moved = crdt.rewrite_time(patch, lambda at: [at[0], at[1] + 100])
    again = Model()
    again.apply_patch({**moved, "ops": [{**o, "obj": [0, 0]} if o.get("obj") == [0, 100] else o for o in moved["ops"]]})
    assert again.view() == model.view()
    assert crdt.rebase(patch, 50)["id"] == [7, 50] and crdt.clone_batch([patch]) == [patch] and crdt.batch_id([patch]) == [7, 1]
    padded = Builder(1)
    padded.obj()
    padded.pad(9)
    assert padded.time == 9 and padded.ops[-1] == {"op": "nop", "len": 7}


def test_clocks():
    assert clocks.tick([3, 4], 2) == [3, 6] and clocks.interval([3, 4], 1, 5) == [3, 5, 5]
    assert clocks.compare([9, 1], [1, 2]) == -1 and clocks.compare([2, 2], [1, 2]) == 1 and clocks.equal([1, 2], [1, 2])
    assert clocks.contains([1, 2, 5], [1, 3, 4]) and not clocks.contains([1, 2, 5], [1, 3, 5]) and not clocks.contains([1, 2, 5], [2, 3, 1])
    assert clocks.contains_id([1, 2, 1], [1, 2]) and not clocks.contains_id([1, 2, 1], [1, 3])
    assert [clocks.print_ts(t) for t in ([1, 5], [123456, 7], [22, 3])] == [".5", "..3456.7", "22.3"]
    clock = clocks.ClockVector(5, 3)
    clock.observe([6, 10], 2)
    assert clock.tick(2) == [5, 12] and clock.peers == {6: 11}
    fork = clock.fork(8)
    assert (fork.sid, fork.time, fork.peers) == (8, 14, {5: 13, 6: 11})
    server = clocks.ServerClockVector(4)
    server.observe([2, 4], 3)
    assert server.time == 7 and server.fork().time == 7
    for at, code in (([9, 1], "INVALID_SERVER_SESSION"), ([1, 8], "TIME_TRAVEL")):
        with pytest.raises(clocks.ClockError, match=code):
            server.observe(at)


def made(template):
    b = Builder(4)
    b.set_root(nodes.build(template, b))
    model = Model()
    model.apply_patch(b.flush())
    return model


TEMPLATE = ("obj", {"a": ("str", "text"), "b": ("arr", [("con", 1), ("val", ("con", True))]), "c": ("vec", [("con", None), None, ("bin", b"\x05")]), "e": ("obj", {})})


def test_templates_and_comparison():
    model = made(TEMPLATE)
    root = model.slots[ORIGIN]["value"]
    assert model.view() == {"a": "text", "b": [1, True], "c": [None, None, [5]], "e": {}}
    assert nodes.to_schema(model, root) == TEMPLATE
    twin = made(nodes.to_schema(model, root))
    assert nodes.same_shape(model, root, twin, twin.slots[ORIGIN]["value"]) and nodes.same_node(model, root, twin, root)
    other = made(("obj", {**TEMPLATE[1], "a": ("str", "other")}))
    assert not nodes.same_shape(model, root, other, root) and nodes.same_shape(model, root, other, root, content=False)
    assert not nodes.same_shape(model, root, made(("arr", [])), root)
    assert nodes.struct_hash_schema(TEMPLATE) == nodes.struct_hash_crdt(model, root) and nodes.struct_hash_crdt(model, None) == "U"
    assert nodes.struct_hash_schema(nodes.template_of({"k": [1, "a"]})) == json_utils.struct_hash({"k": [1, "a"]})
    assert json_utils.struct_hash([35, -36, 1.9, True, None]) == "[z;-10;1;T;N;]"


def test_views_stores_logs_and_drafts():
    model = made(TEMPLATE)
    view = nodes.NodeView.root(model)
    assert view.find(["b", 1]).view() is True and view.find(["b", 1]).kind == "val" and view.select(["b", 1], leaf=True).kind == "con"
    assert view.find(["c", "2"]).as_bin().view() == [5] and view.find(["c", 1]) is None and view.find(["a", "x"]) is None
    with pytest.raises(ValueError, match="NOT_STR"):
        view.find(["b"]).as_str()
    store = nodes.PatchStore(Editor(model, 9))
    inner = store.bind("/e")
    inner.add("/n", {"m": 1})
    inner.replace("/n", 2)
    assert store.get("/e/n") == 2 and inner.get("") == {"n": 2} and inner.get("/x") is UNDEFINED
    assert inner.delete("/n") and not inner.delete("/n") and store.get("/e") == {}
    before = len(model.kind)
    clean = nodes.gc_tree(model)
    assert clean.view() == model.view() and len(clean.kind) < before and set(clean.kind) == nodes.reachable(model)
    log = nodes.Log.from_model(made(TEMPLATE))
    edits = [{"id": [s, t], "ops": [{"op": "nop", "len": 1}]} for s, t in ((9, 40), (8, 60), (9, 50))]
    for e in edits:
        log.apply(e)
    assert log.find_max(9) == edits[2] and log.find_max(1) is None
    copy = log.clone()
    copy.patches.clear()
    assert len(log.patches) == 3
    log.reset(copy)
    assert log.patches == [] and log.start().view() == {"a": "text", "b": [1, True], "c": [None, None, [5]], "e": {}}
    base, remote = made(("obj", {})), Editor(made(("obj", {})), 11)
    local = Editor(made(("obj", {})), 12)
    local.obj_set([], {"l": 1})
    remote.obj_set([], {"r": 2})
    draft = nodes.Draft(base, [local.flush()])
    draft.rebase([remote.flush()])
    assert draft.base.view() == {"r": 2} and draft.head.view() == {"l": 1, "r": 2}


def test_extensions():
    known = nodes.Extensions()
    known.register(nodes.Extension(1, "twice", lambda data: data.view() * 2))
    model = made(("obj", {"x": ("ext", "twice", ("vec", [("con", [1, 0, 0]), ("con", 21)])), "y": ("vec", [("con", 3)])}))
    view = nodes.NodeView.root(model)
    assert known.view(view.find(["x"])) == 42 and known.view(view.find(["y"])) == [3] and known.clone().size() == 1
    with pytest.raises(NotImplementedError):
        nodes.UndoManager().undo()


def test_schemas():
    person = S.obj(S.key("id", S.num(format="u8")))
    person = schemas.opt(schemas.prop(person, "name", S.str(max=3)), "tags", S.arr(S.str()))
    assert schemas.get_field(person, "tags")["optional"] and schemas.get_field(schemas.omit(person, "id"), "id") is None
    assert len(schemas.extend(person, S.obj(S.key("x", S.any())))["keys"]) == 4
    assert [s["kind"] for s in schemas.walk(S.function(person, S.maybe(S.num())))] == ["fn", "obj", "num", "str", "arr", "str", "or", "num", "con"]
    assert types.first_error({"id": 1, "name": "abcd"}, person) == ("STR_LEN", ["name"])
    assert types.first_error({"id": 1, "name": "abc", "tags": ["a", 2]}, person) == ("STR", ["tags", 1])
    assert types.first_error({"id": 1}, person) == ("KEY", []) and types.message("KEY") == "Missing key."
    assert types.first_error(3, {"kind": "num", "check": lambda v: v % 2 == 0}) == ("VALIDATION", [])
    assert types.first_error("x", S.enum("y", 1)) == ("ENUM", []) and types.first_error(True, S.enum(1)) == ("ENUM", [])
    for bad, code in ((S.num(gt=1, gte=1), "GT_GTE"), (S.num(gt=3, lt=1), "GT_LT"), (S.str(min=2, max=1), "MIN_MAX"), ({"kind": "arr"}, "EMPTY_ARR"), ({"kind": "arr", "tail": [S.any()]}, "LONE_TAIL"), ({"kind": "or", "types": []}, "TYPES_LENGTH"), ({"kind": "x"}, "unknown")):
        with pytest.raises(types.SchemaError, match=code):
            types.check(bad)
    own = schemas.Module(S.module(S.alias("A", S.obj(S.key("a", S.num()), S.key("b", S.num()))), S.alias("B", S.obj(S.key("b", S.str()), extends=["A"])), S.alias("C", S.ref("B"))))
    assert [(k["key"], k["value"]["kind"]) for k in own.resolve("C")["keys"]] == [("a", "num"), ("b", "str")]
    assert own.alias("A", S.any())["kind"] == "obj" and own.has_alias("C") and set(own.export_types()) == {"A", "B", "C"}
    with pytest.raises(types.SchemaError, match="Alias not found"):
        own.unalias("D")
    meta = schemas.Module(schemas.metaschema())
    for good in (person, S.map(S.ref("x")), S.union(S.nil(), S.tuple(S.num(), body=S.str(), tail=[S.bool()])), S.function(person)):
        types.check(good)
        assert types.first_error(good, meta.resolve("Schema"), meta.known) is None
    assert types.first_error({"kind": "num", "gt": "a"}, meta.resolve("Schema"), meta.known) == ("OR", [])
    typed = schemas.Typed(person, {"id": 1, "name": "abc"})
    assert typed.fault() is None and typed.field("name").value == "abc"
    double = schemas.TypedFunction(S.function(S.num(), S.num(lt=10)), lambda v: 2 * v)
    assert double(4) == 8
    for wrong in ("a", 5):
        with pytest.raises(ValueError, match="Not a number|too large"):
            double(wrong)
    assert schemas.capacity(S.obj(S.key("k", S.bool()))) == 22 and schemas.capacity(S.str()) is None


def test_random_values_are_of_their_types():
    import random

    shapes = [S.num(format="i8"), S.num(gt=3, lt=5), S.num(format="u16", gte=7), S.str(min=2, max=2, ascii=True), S.bin(max=3), S.tuple(S.num(), S.str()), S.arr(S.bool(), min=1, max=2), S.map(S.num()), S.maybe(S.enum("a", "b")), S.obj(S.key("a", S.num(lte=0)), S.key_opt("b", S.nil())), S.any()]
    for shape in shapes:
        for k in range(50):
            value = schemas.draw(random.Random(k), shape)
            assert types.first_error(value, shape) is None, (shape, value)


def test_discriminator_expressions(spark):
    from pyspark.sql import functions as F

    from docloom.functions.values import num
    from docloom.plans.expression import compile_value, row_context

    union = [S.obj(S.key("kind", S.const("a"))), S.obj(S.key("kind", S.const("b"))), S.str(), S.num(), S.bool()]
    expression = schemas.discriminator_expression(union)
    rows = spark.createDataFrame([(json.dumps(v),) for v in ({"kind": "a"}, {"kind": "b"}, "x", 4, True)], "t string").select(F.parse_json("t").alias("v"))

    def at_value(e):
        return [at_value(x) if isinstance(x, list) else x for x in e] if not (isinstance(e, list) and e[:1] == ["$"]) else ["$", "/v" + e[1], *e[2:]]

    got = rows.select(num(compile_value(at_value(expression), row_context(rows))).cast("int")).collect()
    assert [r[0] for r in got] == [0, 1, 2, 3, 4]
    with pytest.raises(types.SchemaError, match="Duplicate"):
        schemas.discriminator_expression([S.any(), S.num(), S.num()])


def test_lines_and_json_operations():
    a, b = "one\ntwo\nthree\n", "one\ntoo\nthree\nfour\n"
    lines = diff.line_agg(diff.diff(a, b))
    assert "".join(diff.patch_src(own) for own in lines) == a and "".join(diff.patch_dst(own) for own in lines) == b
    assert diff.line_agg([(0, "a"), (1, "b\nc\na"), (0, "d\n")]) == [[(1, "ab\n")], [(1, "c\n")], [(0, "ad\n")]]
    assert diff.line_agg([(0, "x"), (-1, "a\n"), (-1, "b"), (0, "a\n")]) == [[(0, "xa\n")], [(-1, "ba\n")]]
    src, dst = a.splitlines(), b.splitlines()
    out = list(src)
    patch = diff.line_diff(src, dst)
    diff.line_apply(patch, lambda k: out.pop(k), lambda k, d: out.insert(k + 1, dst[d]), lambda k, d: out.__setitem__(k, dst[d]))
    assert out == dst
    assert diff.irrev(["a", ["bc"], 2, -1]) == ["a", -2, 2, -1] and diff.irrev_apply(b"abc", [1, -1, b"x"]) == b"axc"
    first, second = [2, ["ab"], "x"], [1, "yy", 1, -1]
    assert diff.irrev_apply("ccabcc", diff.irrev_compose(first, second)) == diff.irrev_apply(diff.irrev_apply("ccabcc", first), second)
    doc = {"a": [1, {"b": 2}], "c": "text"}
    assert diff.json_ot(doc, {"pick": [[0, ["a", "1"]], [1, ["a", "1", "b"]]], "drop": [[0, ["d"]], [1, ["a", "-"]]], "edit": [[["c"], [1, -2, "o"]]]}) == {"a": [1, 2], "c": "tot", "d": {}}
    assert diff.json_ot(doc, {"pick": [[0, ["zz"]]], "data": [[1, 5]], "drop": [[0, ["q"]], [1, []]]}) == 5
    assert diff.json_ot(doc, {}) == doc


def test_json_utilities():
    assert json_utils.json_size_approx({"a": ["x\n", None, True]}) == 22 and json_utils.json_size({"a": ["x\n"]}) == 13
    assert json_utils.deep_equal({"a": [b"x", 1]}, {"a": [b"x", 1.0]}) and not json_utils.deep_equal([b"x"], ["x"]) and not json_utils.deep_equal(1, True)
    assert [n if isinstance(n, str) else n[0] for n in json_utils.walk_markup(["p", None, "a", ["b", {}, "c"]])] == ["p", "a", "b", "c"]
    one, two = (json_utils.Fuzzer(5) for _ in range(2))
    assert [one.random_int(1, 6) for _ in range(9)] == [two.random_int(1, 6) for _ in range(9)] and one.pick([3]) == 3


def test_command_lines(monkeypatch, capsysbinary, spark, tmp_path):
    def run(*arguments, given=b""):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(given)))
        code = cli.main(list(arguments))
        return code, capsysbinary.readouterr().out

    for form in ("cbor", "msgpack"):
        code, packed = run("pack", form, given=b'{"a":[1,"x"]}')
        assert code == 0 and json.loads(run("unpack", form, given=packed)[1]) == {"a": [1, "x"]}
    assert json.loads(run("json-patch", '[{"op":"add","path":"/b","value":2}]', given=b'{"a":1}')[1]) == {"a": 1, "b": 2}
    assert json.loads(run("json-pointer", "/a/0", given=b'{"a":[7]}')[1]) == 7
    assert run("json-pointer", "/x", given=b"{}")[0] == 1 and run("pack", "nope", given=b"{}")[0] == 1 and run("json-patch", '[{"op":"remove","path":"/q"}]', given=b"{}")[0] == 1
    spark.createDataFrame([('{"a":[7]}',)], "value string").write.parquet(str(tmp_path / "in"))
    assert cli.main(["json-pointer", "/a/0", "--table", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert [r.result for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["7"]
