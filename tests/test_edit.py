"""Edits, merges, undo and snapshots of replicated documents."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import edit as E
from docloom.operators.crdt import UNDEFINED, Builder, Model

JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("abcé👍", max_size=8), lambda v: st.lists(v, max_size=5) | st.dictionaries(st.sampled_from("abcd"), v, max_size=4), max_leaves=12)


def made(value, sid=7) -> tuple[Model, dict]:
    patch = Builder(sid).root(value).flush()
    model = Model()
    model.apply_patch(patch)
    return model, patch


@settings(max_examples=300, deadline=None)
@given(JSON, JSON, JSON)
def test_merge_reaches_the_value_and_undo_returns(a, b, c):
    model, first = made(a)
    editor = E.Editor(model, 9)
    editor.merge(b)
    second = editor.flush()
    assert model.view() == b
    log = [first] + ([second] if second else [])
    assert E.history(log).view() == b
    if second:
        log.append(E.undo(log, second, 11))
        assert E.history(log).view() == a
    kept = E.restore(json.loads(json.dumps(E.snapshot(E.history(log)))))
    editor = E.Editor(kept, 12)
    editor.merge(c)
    last = editor.flush()
    assert kept.view() == c == E.history(log + ([last] if last else [])).view()


def test_edits_and_errors():
    model, _ = made({"t": "abc", "l": [1, {"x": 2}], "n": 1})
    e = E.Editor(model, 9)
    for command in (
        {"do": "ins", "path": ["t"], "at": 1, "value": "👍"},
        {"do": "ins", "path": ["t"], "value": "!"},
        {"do": "del", "path": ["t"], "at": 0},
        {"do": "ins", "path": ["l"], "at": 1, "value": [[5], "s"]},
        {"do": "upd", "path": ["l"], "at": 0, "value": {"y": None}},
        {"do": "obj_set", "path": ["l", 3], "value": {"z": [1]}},
        {"do": "obj_del", "path": [], "keys": ["n"]},
    ):
        e.run(command)
    assert model.view() == {"t": "👍bc!", "l": [{"y": None}, [5], "s", {"x": 2, "z": [1]}]}
    assert e.size(["t"]) == 5 and e.size(["l"]) == 4
    for command in ({"do": "ins", "path": ["t"], "at": 99, "value": "x"}, {"do": "del", "path": ["l"], "at": 3, "len": 2}, {"do": "ins", "path": ["n"], "value": "x"}, {"do": "obj_set", "path": ["t"], "value": {"a": 1}}, {"do": "nothing"}):
        with pytest.raises(E.EditError):
            e.run(command)


def test_json_patch_on_documents():
    from docloom.operators import patch as P

    doc = {"a": [1, 2, 3], "t": "hey", "o": {"k": 1}}
    ops = [
        {"op": "add", "path": "/a/1", "value": 9},
        {"op": "add", "path": "/a/-", "value": {"z": 1}},
        {"op": "remove", "path": "/a/0"},
        {"op": "replace", "path": "/o/k", "value": [1]},
        {"op": "copy", "from": "/o", "path": "/c"},
        {"op": "move", "from": "/o/k", "path": "/m"},
        {"op": "str_ins", "path": "/t", "pos": 3, "str": "!!"},
        {"op": "str_del", "path": "/t", "pos": 0, "len": 1},
        {"op": "test", "path": "/t", "value": "ey!!"},
    ]
    model, _ = made(doc)
    E.Editor(model, 9).json_patch(ops)
    assert model.view() == {"a": [9, 2, 3, {"z": 1}], "t": "ey!!", "o": {}, "c": {"k": [1]}, "m": [1]} == P.apply_ops(json.loads(json.dumps(doc)), ops)[0]
    for bad in ({"op": "test", "path": "/t", "value": ""}, {"op": "remove", "path": "/q"}, {"op": "add", "path": "/a/01", "value": 1}, {"op": "move", "from": "/c", "path": "/c/k/0"}):
        with pytest.raises(E.EditError):
            E.Editor(model, 9).json_patch([bad])


def test_undo_of_deletions_keeps_concurrent_edits():
    model, first = made("hello world")
    a, b = E.Editor(E.history([first]), 8), E.Editor(E.history([first]), 9)
    a.delete((), 0, 6)
    b.insert((), 11, "!")
    cut, mark = a.flush(), b.flush()
    log = [first, cut, mark]
    assert E.history(log).view() == "world!"
    assert E.history([*log, E.undo(log, cut, 10)]).view() == "hello world!"
    assert E.history([]).view() is UNDEFINED


def test_registers_and_counters_of_concurrent_sessions():
    _, first = made({"r": ["old"], "c": {}})
    log = [first]
    for sid, value, by in ((8, "a", 2), (9, "b", 5)):
        e = E.Editor(E.history([first]), sid)
        e.run({"do": "register", "path": ["r"], "value": value})
        e.count(["c"], by)
        e.run({"do": "count", "path": ["c"], "by": -1})
        log.append(e.flush())
    e = E.Editor(E.history(log), 10)
    assert sorted(e.get(["r"])) == ["a", "b"] and e.counted(["c"]) == 5
    e.register_set(["r"], "c")
    assert e.get(["r"]) == ["c"]


@pytest.mark.parametrize("container", ["ndjson", "seq.cbor"])
def test_history_containers(container):
    from docloom.sources import logs

    _, first = made({"t": "a\u2028\nb👍", "n": [1, None]})
    e = E.Editor(E.history([first]), 9)
    e.run({"do": "del", "path": ["t"], "at": 0})
    second = e.flush()
    for start, patches in ((None, [second, first]), (E.history([first]), [second])):
        data = logs.encode_history(logs.history_components(patches, {"by": "x"}, start), container)
        got = logs.decode_history(data, container)
        assert got["end"].view() == got["view"] == {"t": "\u2028\nb👍", "n": [1, None]} and got["metadata"] == {"by": "x"}
        assert got["patches"] == sorted(patches, key=lambda p: p["id"][1])
    assert logs.decode_history(logs.encode_history(logs.history_components([]), container), container)["view"] is None


def test_over_tables(spark):
    rows = [(d, json.dumps(Builder(7).root({"t": "ab", "n": d}).flush())) for d in (1, 2, 3)]
    patches = spark.createDataFrame(rows, "doc int, patch string")
    edits = [(1, 2, {"do": "ins", "path": ["t"], "value": "d"}), (1, 1, {"do": "ins", "path": ["t"], "value": "c"}), (2, 1, {"do": "nothing"}), (9, 1, {"do": "set", "value": [1]})]
    edits = spark.createDataFrame([(d, k, json.dumps(e)) for d, k, e in edits], "doc int, k int, edit string")
    got = {r.doc: r for r in E.apply_edits(patches, edits, "doc", "patch", "k", "edit", 9).collect()}
    assert set(got) == {1, 2, 9} and json.loads(got[1].view) == {"t": "abcd", "n": 1}
    assert got[2].failed == 1 and got[2].patch is None and json.loads(got[9].view) == [1]
    fresh = spark.createDataFrame([(d, got[d].patch) for d in (1, 9)], "doc int, patch string")
    both = patches.unionByName(fresh)
    undone = {r.doc: r.view for r in E.undo_patches(both, fresh, "doc", "patch", 11).collect()}
    assert json.loads(undone[1]) == {"t": "ab", "n": 1} and undone[9] is None
    want = spark.createDataFrame([(3, '{"t":"xb","n":[]}'), (1, None)], "doc int, target string")
    assert [(r.doc, json.loads(r.view)) for r in E.diff_apply(patches, want, "doc", "patch", "target", 9).collect()] == [(3, {"t": "xb", "n": []})]
    old = E.advance(both, "doc", "patch", (1, 7))
    views = {r.doc: r.view for r in E.replay_from(old, fresh, "doc", "patch").collect()}
    assert json.loads(views[1]) == {"t": "abcd", "n": 1} and json.loads(views[3]) == {"t": "ab", "n": 3}


def test_merge_of_many_edits_keeps_untouched_items():
    text = "".join("abcdefgh"[k * k % 8] for k in range(1500))
    model, _ = made({"t": text, "l": list(range(600))})
    editor = E.Editor(model, 9)
    new = {"t": "".join("X" if k % 5 == 0 else c for k, c in enumerate(text)), "l": [-1] * 251 + [*range(599), -2]}
    editor.merge(new)
    patch = editor.flush()
    assert model.view() == new
    written = sum(len(op["value"]) for op in patch["ops"] if op["op"] == "ins_str")
    assert written == 300
    assert sum(len(op.get("values") or op["value"]) for op in patch["ops"] if op["op"] == "ins_arr") <= 252
