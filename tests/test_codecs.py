"""Codecs round-trip, agree with published vectors, and reject broken bytes."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.sources import codecs as C

SCALARS = st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text()
VALUES = st.recursive(SCALARS | st.binary(max_size=300), lambda v: st.lists(v, max_size=5) | st.dictionaries(st.text(), v, max_size=5), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_round_trips(value):
    for name in ("cbor", "cbor_stable", "msgpack", "ubjson", "resp"):
        encode, decode = C.CODECS[name]
        assert decode(encode(value)) == value, name
    plain = {"v": value}
    if "\\u0000" not in json.dumps(C.wrap_binary(plain)):  # BSON keys end at a zero
        assert C.bson_decode(C.bson_encode(plain)) == plain
    assert C.from_ejson(C.ejson([1, 2.5, "x", b"q"], True)) == [1, 2.5, "x", b"q"]


# Published examples of RFC 8949 appendix A and the MessagePack specification.
@pytest.mark.parametrize(("value", "text"), [(0, "00"), (23, "17"), (24, "1818"), (1000000000000, "1b000000e8d4a51000"), (-1, "20"), (-1000, "3903e7"), (False, "f4"), (None, "f6"), ("IETF", "6449455446"), ([1, [2, 3]], "8201820203"), ({"a": 1, "b": [2, 3]}, "a26161016162820203"), (100000.0, "fa47c35000"), (1.1, "fb3ff199999999999a")])
def test_cbor_vectors(value, text):
    assert C.cbor_encode(value).hex() == text and C.cbor_decode(bytes.fromhex(text)) == value


def test_cbor_indefinite_and_broken():
    assert C.cbor_decode(bytes.fromhex("9f01820203ff")) == [1, [2, 3]]
    assert C.cbor_decode(bytes.fromhex("7f657374726561646d696e67ff")) == "streaming"
    for bad in ("", "18", "1c", "6161ff", "ff"):
        with pytest.raises(C.CodecError):
            C.cbor_decode(bytes.fromhex(bad))


def test_msgpack_vectors():
    assert C.msgpack_encode({"compact": True, "schema": 0}).hex() == "82a7636f6d70616374c3a6736368656d6100"
    assert C.msgpack_find(C.msgpack_encode({"a": [1, {"b": "x"}]}), ["a", 1, "b"]) == "x"
    with pytest.raises(C.CodecError):
        C.msgpack_find(C.msgpack_encode([1]), [3])


def test_bencode_resp_and_framing():
    assert C.bencode_encode({"b": [1, "x"], "a": None}) == b"d1:an1:bli1e1:xee"
    assert C.bencode_decode(b"d1:bli-1e1:xee") == {"b": [-1, b"x"]}
    assert C.resp_command("GET", "k") == b"*2\r\n$3\r\nGET\r\n$1\r\nk\r\n"
    stream = C.resp_encode([1, "a"]) + C.resp_encode(b"zz")
    for cut in range(len(stream) + 1):
        first, rest = C.resp_stream(stream[:cut])
        second, left = C.resp_stream(rest + stream[cut:])
        assert first + second == [[1, "a"], b"zz"] and left == b""
    wire = C.record_marking_encode(b"hello", 2) + C.record_marking_encode(b"") + C.record_marking_encode(b"x")
    for cut in range(len(wire) + 1):
        first, rest = C.record_marking_stream(wire[:cut])
        second, left = C.record_marking_stream(rest + wire[cut:])
        assert first + second == [b"hello", b"x"] and left == b""
    frames = C.websocket_encode(b"hi", 1, mask=b"abcd") + C.websocket_encode(b"y" * 70000)
    assert C.websocket_stream(frames) == ([(1, True, b"hi"), (2, True, b"y" * 70000)], b"")


@given(st.integers(-(2**200), 2**200))
def test_mpint(n):
    assert C.from_mpint(C.mpint(n)) == n


def test_schema_codecs():
    xdr = {"type": "struct", "fields": [[{"type": "int"}, "a"], [{"type": "string"}, "s"], [{"type": "vararray", "elements": {"type": "double"}}, "d"], [{"type": "optional", "element": {"type": "hyper"}}, "o"]]}
    value = {"a": -5, "s": "héy", "d": [1.5, 2.0], "o": None}
    assert C.xdr_decode(xdr, C.xdr_encode(xdr, value)) == value
    avro = {"type": "record", "fields": [{"name": "a", "type": "long"}, {"name": "u", "type": ["null", "string"]}, {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "e", "type": {"type": "enum", "symbols": ["X", "Y"]}}]}
    value = {"a": -64, "u": "foo", "m": {"k": 0.5}, "e": "Y"}
    assert C.avro_decode(avro, C.avro_encode(avro, value)) == value and C.avro_valid(avro, value)
    assert C.avro_encode("long", -64) == b"\x7f" and C.avro_encode("string", "foo") == b"\x06foo"


def test_partial_json():
    assert C.partial_json('{"a": [1, 2, {"b": "x') == {"a": [1, 2, {"b": "x"}]}
    assert C.partial_json("[1, 2,") == [1, 2]


def test_columns(spark):
    df = spark.createDataFrame([(1, '{"a":[1,2.5,null,"é"]}'), (2, None)], "id long, t string")
    for name in ("json", "cbor", "msgpack", "ubjson", "resp", "bson"):
        rows = df.select(C.decode_column(C.encode_column(F.col("t"), name), name).alias("t")).collect()
        assert [r.t and json.loads(r.t) for r in rows] == [{"a": [1, 2.5, None, "é"]}, None]
    assert df.select(C.decode_column(F.lit(b"\xff").cast("binary"), "cbor").alias("t")).first().t is None
    url = df.select(C.base64_url(F.lit(b"\xff\xfe?").cast("binary")).alias("u"), C.from_base64_url(F.lit("__4_")).alias("b"), C.from_data_uri(C.data_uri(F.lit(b"q").cast("binary"))).alias("d")).first()
    assert (url.u, bytes(url.b), bytes(url.d)) == ("__4_", b"\xff\xfe?", b"q")


def test_codecs_take_each_value_of_a_batch_once():
    import pandas as pd

    from docloom.sources.codecs import _once_each

    seen = []
    found = _once_each(pd.Series(["a", None, "b", "a", b"a", None]), lambda v: seen.append(v) or len(seen))
    assert list(found) == [1, None, 2, 1, 3, None] and seen == ["a", "b", b"a"]
