"""Patch forms, Ion, SSH and RPC: round trips, published vectors, broken bytes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators.crdt import Builder
from docloom.sources import literals as L
from docloom.sources import patches as P
from docloom.sources import wire as W
from docloom.sources.codecs import CODECS, CodecError, Reader, mpint, wrap_binary

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text() | st.binary(max_size=40), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(), v, max_size=4), max_leaves=15)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_ion_round_trip(value):
    assert W.ion_decode(W.ion_encode(value)) == value


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_literal_tables(value):
    value = wrap_binary(value)
    own = L.table(value)
    assert L.decompress(L.compress(value, own), own) == value


def test_literal_layout():
    value = {"b": [10, 3, 7, 3], "a": {"b": True}}
    assert L.table(value) == [3, 4, 3, "a", "b", True]
    assert list(L.compress(value, L.table(value)).items()) == [("3", {"4": 5}), ("4", [2, 0, 1, 0])]
    with pytest.raises(CodecError):
        L.compress([1], [2])


def test_ion_vectors():
    assert W.ion_encode(-3).hex() == "e00100ea3103" and W.ion_encode(0).hex() == "e00100ea20"
    assert W.ion_encode({"a": 1}).hex() == "e00100ea" + "e78183d487b28161" + "d38a2101"
    for bad in (b"", b"\xe0\x01\x00\xea", b"\xe0\x01\x00\xea\xd2\x8a\x20", W.ion_encode(1) + b"\0"):
        with pytest.raises(CodecError):
            W.ion_decode(bad)


def test_ssh_and_rpc():
    assert W.ssh_encode(["zlib", "none"]).hex() == "000000097a6c69622c6e6f6e65"
    assert mpint(0x9A378F9B2E332A7).hex() == "0000000809a378f9b2e332a7" and mpint(0x80).hex() == "000000020080"
    kinds = ["boolean", "uint32", "uint64", "string", "names", "mpint"]
    data = W.ssh_encode(True) + W.ssh_encode(7) + W.ssh_encode(2**40) + W.ssh_encode("é") + W.ssh_encode([]) + mpint(-1234)
    assert W.ssh_decode(kinds, data) == [True, 7, 2**40, "é", [], -1234]
    for bad in (None, 1.5, {"a": 1}, [1]):
        with pytest.raises(CodecError):
            W.ssh_encode(bad)
    none = {"flavor": 0, "body": b""}
    for m in (
        {"type": "call", "xid": 1, "prog": 100003, "vers": 3, "proc": 1, "cred": {"flavor": 1, "body": b"abcde"}, "verf": none, "params": b"xyz"},
        {"type": "accepted", "xid": 2, "verf": none, "stat": 0, "mismatch": None, "results": b"r"},
        {"type": "accepted", "xid": 2, "verf": none, "stat": 2, "mismatch": [1, 3], "results": b""},
        {"type": "denied", "xid": 3, "stat": 0, "mismatch": [2, 2]},
        {"type": "denied", "xid": 4, "stat": 1, "auth_stat": 5},
    ):
        assert W.rpc_decode(W.rpc_encode(m)) == m
    with pytest.raises(CodecError):
        W.rpc_encode({"type": "call", "xid": 1, "prog": 1, "vers": 1, "proc": 1, "cred": {"flavor": 1, "body": bytes(401)}})


@given(st.integers(0, 2**57 - 1), st.integers(0, 2**56 - 1), st.integers(0, 1), st.integers(0, 2**30), st.integers(0, 2**40))
def test_varints(a, b, flag, x, y):
    assert P.read_vu57(Reader(P.vu57(a))) == a and len(P.vu57(a)) <= 8
    assert P.read_b1vu56(Reader(P.b1vu56(flag, b))) == (flag, b)
    assert P.read_relative_id(Reader(P.relative_id(x, y))) == (x, y)


def everything() -> dict:
    b = Builder(77, 10)
    b.root({"t": "héllo 👍", "n": [1, None, True], "o": {}, "x": 1.5})
    text = b.add("new_str")
    b.add("ins_str", obj=text, after=text, value="a👍b" * 9)
    raw = b.add("new_bin")
    b.add("ins_bin", obj=raw, after=raw, value=[0, 255, 7])
    vec = b.add("new_vec")
    b.add("ins_vec", obj=vec, value=[[0, raw], [5, text]])
    b.add("new_con")
    ref = b.add("new_con", timestamp=[3, 4])
    arr = b.add("new_arr")
    b.add("ins_arr", obj=arr, after=arr, values=[ref] * 9)
    b.add("upd_arr", obj=arr, ref=[77, 60], value=[1, 900])
    b.add("del", obj=text, what=[[77, 50, 2], [1, 3, 400]])
    b.add("nop", len=1)
    b.add("nop", len=300)
    return b.flush()


@pytest.mark.parametrize("form", ["patch_binary", "patch_compact", "patch_compact_binary", "patch_verbose"])
def test_patch_forms(form):
    encode, decode = CODECS[form]
    for patch in (everything(), everything() | {"meta": {"by": "someone"}}, {"id": [1, 5], "ops": [{"op": "nop", "len": 1}]}):
        got = decode(encode(patch))
        if form == "patch_verbose":  # undefined is null there
            patch = patch | {"ops": [{"op": "new_con", "value": None} if o == {"op": "new_con"} else o for o in patch["ops"]]}
        assert got == patch
    if form == "patch_binary":
        data = encode(everything())
        for cut in range(0, len(data), 7):
            with pytest.raises(CodecError):
                decode(data[:cut])


def test_binary_layout():
    assert P.binary_encode({"id": [65536, 1], "ops": [{"op": "new_con", "value": "a"}, {"op": "ins_val", "obj": [0, 0], "value": [65536, 1]}]}).hex() == "808004" + "01" + "f7" + "02" + "00" + "6161" + "48" + "8000" + "01"
    assert P.compact_encode({"id": [1, 5], "ops": [{"op": "new_obj"}, {"op": "del", "obj": [1, 5], "what": [[1, 6, 2], [9, 6, 1]]}]}) == [[5], [2], [16, 5, [[6, 2], [9, 6, 1]]]]


def test_operation_rows(spark):
    import json

    df = spark.createDataFrame([(1, json.dumps(everything()))], "doc int, patch string")
    rows = P.operation_rows(df, "patch").collect()
    assert rows[0]["time"] == 10 and rows[0].asDict().keys() == {"doc", "sid", "time", "span", "op", "body"}
    assert all(a["time"] + a["span"] == b["time"] for a, b in zip(rows, rows[1:]))
