"""Whole documents in every structural form keep their view and take later edits alike."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import edit as E
from docloom.operators.crdt import Builder, Model
from docloom.sources import documents as D
from docloom.sources.codecs import CodecError
from docloom.sources.patches import operation_rows

JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("abcé👍", max_size=8), lambda v: st.lists(v, max_size=5) | st.dictionaries(st.sampled_from("abcd"), v, max_size=4), max_leaves=10)


def keyed(own):
    """Nodes with the pairs of objects as dicts, whose order the compact forms do not keep."""
    if isinstance(own, tuple) and own and own[0] == "obj":
        return (*own[:2], {k: keyed(c) for k, c in own[2]})
    return type(own)(map(keyed, own)) if isinstance(own, (tuple, list)) else own


@settings(max_examples=150, deadline=None)
@given(JSON, JSON, JSON, JSON, st.sampled_from([1, 7]))
def test_forms_keep_state(a, b, c, late, sid):
    """Two sessions edit at once; a third edit, made on the true state, applies to the decoded one."""
    first = Builder(sid).root(a).flush()
    log = [first]
    for other, value in ((sid, b), (sid if sid == 1 else 9, c)):
        editor = E.Editor(E.history([first] if sid != 1 else log), other)
        editor.merge(value)
        if made := editor.flush():
            log.append(made)
    truth = E.history(log)
    editor = E.Editor(E.history(log), sid if sid == 1 else 5)
    editor.merge(late)
    after = editor.flush()
    for name, (encode, decode) in D.FORMS.items():
        got = decode(encode(truth))
        assert keyed(D.tree(got)) == keyed(D.tree(truth)), name
        assert got.view() == truth.view()
        if after:
            got.apply_patch(after)
        assert got.view() == editor.model.view(), name


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 9), st.booleans()), max_size=25), st.lists(st.tuples(st.integers(1, 3), st.integers(0, 9)), max_size=8))
def test_order_without_parents(steps, late):
    """A sequence rebuilt from its order places concurrent inserts where the true one does."""
    model, time = Model(), 10
    root = {"id": [2, 1], "ops": [{"op": "new_str"}, {"op": "ins_val", "obj": [0, 0], "value": [2, 1]}]}
    model.apply_patch(root)
    ids = [[2, 1]]

    def insert(own, sid, at, into):
        nonlocal time
        ref = ids[at % len(ids)]
        time += 1
        own_patch = {"id": [sid + 2, time], "ops": [{"op": "ins_str", "obj": [2, 1], "after": ref, "value": "abc"[sid - 1]}]}
        for m in own:
            m.apply_patch(own_patch)
        into.append([sid + 2, time])

    for sid, at, dead in steps:
        insert([model], sid, at, ids)
        if dead:
            model.apply_patch({"id": [2, time], "ops": [{"op": "del", "obj": [2, 1], "what": [[*ids[-1], 1]]}]})
    for encode, decode in D.FORMS.values():
        twin, true = decode(encode(model)), E.restore(E.snapshot(model))
        for k, (ahead, at) in enumerate(late):  # late arrivals, of other sessions, next to an element they know
            ref = ids[at % len(ids)]
            patch = {"id": [20 + k, ref[1] + ahead], "ops": [{"op": "ins_str", "obj": [2, 1], "after": ref, "value": "xyz"[ahead - 1] + "!"}]}
            for m in (twin, true):
                m.apply_patch(patch)
        assert twin.view() == true.view()


def test_broken_and_tables(spark):
    model = E.history([Builder(7).root({"a": [1, "x"], "b": "y" * 40}).flush()])
    data = D.binary_encode(model)
    for cut in range(0, len(data)):
        with pytest.raises(CodecError):
            D.binary_decode(data[:cut])
    patches = spark.createDataFrame([(d, json.dumps(Builder(7).root({"t": "ab", "n": [d]}).flush())) for d in (1, 2)], "doc int, patch string")
    for form in D.FORMS:
        states = D.encode_documents(patches, "doc", "patch", form)
        states = states.unionByName(states.limit(1).select(F.lit(9).alias("doc"), F.lit(b"\0\0").alias("state")))
        got = {r.doc: r.view and json.loads(r.view) for r in D.document_views(states, "doc", "state", form).collect()}
        assert got == {1: {"t": "ab", "n": [1]}, 2: {"t": "ab", "n": [2]}, 9: None}
    nodes = D.node_rows(patches, "doc", "patch")
    edits = spark.createDataFrame([(1, '{"id":[9,50],"ops":[{"op":"ins_str","obj":[7,2],"after":[7,2],"value":"z"},{"op":"nop"}]}')], "doc int, patch string")
    assert {r.kind for r in nodes.filter("doc = 1").collect()} == {"root", "obj", "str", "arr", "val", "con"}
    assert D.touched_nodes(nodes, operation_rows(edits, "patch"), "doc").count() == 1
