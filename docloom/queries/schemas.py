"""Queries over schemas, clocks, JSON operations, line patches and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import json_utils
from docloom.operators import clocks, diff, schemas, types
from docloom.operators.schemas import S
from docloom.functions.values import truthy
from docloom.plans.expression import compile_value, row_context
from docloom.queries.registry import query, table

#: A tree of numbers: each node's value is a small whole number, its children are nodes.
TREE = schemas.Module(S.module(S.alias("Node", S.obj(S.key("v", S.num(format="u8", lt=40)), S.key_opt("kids", S.arr(S.ref("Node"))))), S.alias("Tree", S.ref("Node"))))


@query("""
SELECT event_id,
       CASE WHEN k >= 40 THEN 'LT' END AS code, CASE WHEN k >= 40 THEN 'Value is too large.' END AS message, CASE WHEN k >= 40 THEN '/v' END AS path,
       CASE WHEN k >= 41 THEN 'REF' END AS nested, CASE WHEN k >= 41 THEN '/kids/0' END AS nested_path, CASE WHEN k >= 41 THEN 'REF' END AS inner_code
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
""")
def type_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First errors with message and path, also of a schema that leads back to itself."""
    k = F.get_json_object("props", "$.k").cast("long")
    one = F.concat(F.lit('{"v":'), k.cast("string"), F.lit("}"))
    deep = F.concat(F.lit('{"v":1,"kids":[{"v":'), F.greatest(k - 1, F.lit(0)).cast("string"), F.lit(',"kids":[]}]}'))
    node, tree = TREE.resolve("Tree"), TREE.export_types()
    found = table(spark, sf_dir, "events").select("event_id", types.faults(one, node, tree).alias("a"), types.faults(deep, node, tree).alias("b"), types.validator(F.parse_json(deep), node, tree).alias("c"))
    return found.select("event_id", "a.code", "a.message", "a.path", F.col("b.code").alias("nested"), F.col("b.path").alias("nested_path"), F.col("c").alias("inner_code"))


ORDER = S.obj(S.key("id", S.num(format="u32", gt=0)), S.key("state", S.enum("new", "paid", "sent")), S.key_opt("note", S.str(min=2, max=6)), S.key("size", S.tuple(S.num(gte=1, lte=9), S.bool())))


@query("SELECT o_orderkey, CAST(NULL AS VARCHAR) AS fault, true AS object, true AS state, true AS repeats, CASE WHEN o_orderkey % 2 = 0 THEN 'ENUM' END AS wrong FROM orders")
def type_random_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random values of a type, which the type's validator accepts."""
    key = F.col("o_orderkey")
    made = schemas.random_value(key, ORDER, seed=3)
    rows = table(spark, sf_dir, "orders").select(key, made.alias("made"), schemas.random_value(key, ORDER, seed=3).alias("again"))
    v = F.parse_json("made")
    state = F.get_json_object("made", "$.state")
    other = F.when(key % 2 == 0, F.lit('"lost"')).otherwise(F.lit('"paid"'))
    return rows.select(
        "o_orderkey",
        types.validator(v, ORDER).alias("fault"),
        (F.get_json_object("made", "$.id").cast("long") > 0).alias("object"),
        state.isin("new", "paid", "sent").alias("state"),
        (F.col("made") == F.col("again")).alias("repeats"),
        types.validator(F.parse_json(other), S.enum("new", "paid", "sent")).alias("wrong"),
    )


NAMED = S.obj(S.key("name", S.str()), S.key("key", S.num(format="u16")), S.key_opt("tags", S.arr(S.str())))


@query("""
SELECT n_nationkey, '{"name":"' || n_name || '","key":' || n_nationkey || '}' AS text,
       'a2646e616d65' || printf('%02x', 96 + length(n_name)) || lower(hex(encode(n_name))) || '636b6579' || CASE WHEN n_nationkey < 24 THEN printf('%02x', n_nationkey) ELSE '18' || printf('%02x', n_nationkey) END AS cbor,
       '82a46e616d65' || printf('%02x', 160 + length(n_name)) || lower(hex(encode(n_name))) || 'a36b6579' || printf('%02x', n_nationkey) AS msgpack,
       CAST(NULL AS VARCHAR) AS other
FROM nation
""")
def type_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values encoded by their type: fields in the schema's order, whatever order they come in."""
    text = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))
    own = {codec: schemas.encode_typed(text, NAMED, codec) for codec in ("json", "cbor", "msgpack")}
    return table(spark, sf_dir, "nation").select("n_nationkey", own["json"].alias("text"), F.lower(F.hex(own["cbor"])).alias("cbor"), F.lower(F.hex(own["msgpack"])).alias("msgpack"), schemas.encode_typed(F.lit('{"name":1}'), NAMED).alias("other"))


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey = l_orderkey % 10 AND l_linenumber >= 2 AND l_linenumber + 3 <= 2 + CAST(l_quantity AS BIGINT) AS held,
       CASE WHEN l_linenumber > 3 OR l_linenumber = 3 AND l_suppkey > 5 THEN 1 WHEN l_linenumber = 3 AND l_suppkey = 5 THEN 0 ELSE -1 END AS side,
       CASE WHEN l_suppkey > 8 THEN 'INVALID_SERVER_SESSION' WHEN l_linenumber > 4 THEN 'TIME_TRAVEL' END AS server
FROM lineitem
""")
def clock_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment and order of ids, and what a server's clock refuses, as plan expressions."""
    sid, time, n = F.col("l_suppkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    held = clocks.contains_columns(F.col("l_orderkey") % 10, F.lit(2), n, sid, time, F.lit(3))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", held.alias("held"), clocks.compare_columns(sid, time, F.lit(5), F.lit(3)).alias("side"), clocks.server_check(sid, time, F.lit(4)).alias("server"))


@query("""
SELECT n_nationkey, '{"b":[' || CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || '",' ELSE '' END || '1' || CASE WHEN n_nationkey % 2 = 1 THEN ',"' || n_name || '"' ELSE '' END || '],"c":"x' || n_nationkey || 'z","d":{"e":7}}' AS doc
FROM nation
""")
def ot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value moves into an array, a given one is dropped and a text is edited."""
    doc = F.to_json(F.struct(F.col("n_name").alias("a"), F.array(F.lit(1)).alias("b"), F.lit("xyz").alias("c")))
    at = F.when(F.col("n_nationkey") % 2 == 0, "0").otherwise("-")
    op = F.concat(F.lit('{"pick":[[0,["a"]]],"data":[[1,{"e":7}]],"drop":[[1,["d"]],[0,["b","'), at, F.lit('"]]],"edit":[[["c"],[1,-1,"'), F.col("n_nationkey").cast("string"), F.lit('"]]]}'))
    return table(spark, sf_dir, "nation").select("n_nationkey", diff.json_ot_column(doc, op).alias("doc"))


@query("""
SELECT n_nationkey, 3 AS n_lines, '=one' || chr(10) || '|-~+<' || n_nationkey || '>=' || chr(10) || '|=end' || CASE WHEN n_nationkey % 2 = 1 THEN '+' || n_name ELSE '' END AS shown
FROM nation
""")
def line_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff of two texts, as one patch for each line."""
    key = F.col("n_nationkey").cast("string")
    more = F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")).otherwise("")
    after = F.concat(F.lit("one\n<"), key, F.lit(">\nend"), more)
    found = table(spark, sf_dir, "nation").select("n_nationkey", diff.line_agg_column(F.lit("one\n~\nend"), after).alias("lines"))
    mark = lambda p: F.concat(F.when(p["kind"] == 0, "=").when(p["kind"] == 1, "+").otherwise("-"), p["text"])
    shown = F.array_join(F.transform("lines", lambda own: F.array_join(F.transform(own, mark), "")), "|")
    return found.select("n_nationkey", F.size("lines").alias("n_lines"), shown.alias("shown"))


@query("""
SELECT event_id, CAST(octet_length(encode(props)) AS BIGINT) AS approx, CAST(octet_length(encode(props)) AS BIGINT) AS exact, CAST(2 + 2 + 1 + 9 AS BIGINT) AS fast, CAST(octet_length(encode(props)) AS BIGINT) AS bytes
FROM (SELECT event_id, replace(props, ' ', '') AS props FROM events)
""")
def json_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, approximate and heuristic sizes from one parse."""
    text = F.replace(F.col("props"), F.lit(" "))
    rows = table(spark, sf_dir, "events").select("event_id", json_utils.sizes_column(text).alias("s"), json_utils.utf8_size(text).alias("bytes"))
    return rows.select("event_id", "s.approx", "s.exact", "s.fast", "bytes")


#: Texts at the edges of the formats, and whether they are of the format.
EDGES = [
    ("email?", "a@x.org", True),
    ("email?", "a@x.org\n", False),
    ("hostname?", "h.example.", True),
    ("hostname?", "h\n", False),
    ("ip4?", "10.0.0.255\n", False),
    ("ip6?", "::1", True),
    ("ip6?", "::1\n", False),
    ("uuid?", "123e4567-e89b-12d3-a456-426614174000\n", False),
    ("uri?", "https://u:p@h.example:80/a%20b?x=1#y", True),
    ("uri?", "a:", False),
    ("uri?", "a:%zz", False),
    ("uri?", "mailto:a@x.org", True),
    ("uri?", "http://[::1]:8/", True),
    ("uri?", "http://[::g]/", False),
    ("duration?", "PT1.5S", False),
    ("duration?", "P1Y2M3DT4H5M6S", True),
    ("duration?", "P", False),
    ("duration?", "P2W", True),
    ("date?", "2024-02-01\n", False),
    ("date?", "2023-02-29", False),
    ("time?", "23:59:60Z", True),
    ("time?", "12:00:60Z", False),
    ("time?", "12:00:00.25+01:30", True),
    ("time?", "12:00:00", False),
    ("dateTime?", "2024-02-01T12:00:00Z\n", False),
]


@query("SELECT n_nationkey, [" + ", ".join(str(ok).lower() for _, _, ok in EDGES) + "][n_nationkey + 1] AS ok FROM nation")
def format_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats with last newlines, fractions, empty and escaped parts."""
    rows = table(spark, sf_dir, "nation")
    texts = rows.select("n_nationkey", *[F.lit(t).alias(f"t{k}") for k, (_, t, _) in enumerate(EDGES)])
    found = {f"f{k}": truthy(compile_value([op, ["$", f"/t{k}"]], row_context(texts))) for k, (op, _, _) in enumerate(EDGES)}
    return texts.select("n_nationkey", F.array(*found.values())[F.col("n_nationkey").cast("int")].alias("ok"))
