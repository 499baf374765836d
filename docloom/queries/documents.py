"""Paths, pointers, patches, JSON utilities, diffs, types and codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import json_utils, pointer
from docloom.operators import crdt, diff, patch, types
from docloom.plans import jsonpath
from docloom.queries.registry import query, table
from docloom.sources import codecs


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its lines as one JSON document.

    Lists do not shrink before the shuffle, so the lines go over all partitions as they are: what
    is done with the documents costs time, not bytes, by which Spark would join partitions.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")).alias("line"))
    lines = crdt.spread(lines, "o_orderkey").groupBy("o_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("priority")).alias("cust"), F.col("o_orderstatus").alias("status"), "lines"))
    return orders.select(F.col("o_orderkey").alias("doc_id"), doc.alias("doc"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).withColumn("v", F.parse_json("doc"))


def _total(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(0.0), lambda a, x: a + F.try_variant_get(x, "$", "double"))


@query("""
SELECT o_orderkey AS doc_id, o_orderpriority AS priority, CAST(o_custkey AS BIGINT) AS cust, CAST(NULL AS VARCHAR) AS missing
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def path_singular(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _parsed(spark, sf_dir).select("doc_id", jsonpath.path_value(v, "$.cust.priority").alias("priority"), jsonpath.path_value(v, "$['cust']['id']", "long").alias("cust"), jsonpath.path_value(v, "$.cust.none").alias("missing"))


@query("""
WITH l AS (SELECT l_orderkey, list({'q': l_quantity, 'n': l_linenumber} ORDER BY l_linenumber, l_quantity, l_returnflag) AS x FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1)
SELECT l_orderkey AS doc_id, list_sum(list_transform(x, lambda e: e.q)) AS wild, x[-1].q AS last_qty, list_sum(list_transform(x[1:2], lambda e: e.q)) AS first_two, x[-1].n AS backwards, CAST(len(x) + 1 AS INTEGER) AS united
FROM l
""")
def path_wildcard_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _parsed(spark, sf_dir).select(
        "doc_id",
        _total(jsonpath.path_values(v, "$.lines[*].qty")).alias("wild"),
        jsonpath.path_value(v, "$.lines[-1].qty", "double").alias("last_qty"),
        _total(jsonpath.path_values(v, "$.lines[0:2].qty")).alias("first_two"),
        F.try_variant_get(F.get(jsonpath.path_values(v, "$.lines[::-1].n"), F.lit(0)), "$", "int").alias("backwards"),
        F.size(jsonpath.path_values(v, "$['lines','key'][*,0]")).alias("united"),
    ).withColumn("united", F.col("united") - 1 + 1)


@query("""
SELECT l_orderkey AS doc_id, CAST(count(*) FILTER (l_quantity > 25) AS INTEGER) AS big, CAST(count(*) FILTER (l_quantity > 25 AND NOT l_returnflag = 'R') AS INTEGER) AS mixed, CAST(count(*) FILTER (l_returnflag IN ('A', 'N')) AS INTEGER) AS matched, CAST(count(*) AS INTEGER) AS counted, CAST(0 AS INTEGER) AS missing
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1
""")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {"big": "$.lines[?@.qty > 25]", "mixed": "$.lines[?(@.qty > 25 && !(@.flag == 'R'))]", "matched": "$.lines[?match(@.flag, '[AN]')]", "counted": "$.lines[?count(@.*) == 3 && length(@.flag) == 1 && search(@.flag, '.')]", "missing": "$.lines[?@.none != 1]"}
    return _parsed(spark, sf_dir).select("doc_id", *[F.size(jsonpath.path_values(F.col("v"), p)).alias(n) for n, p in paths.items()])


@query("""
SELECT l_orderkey AS doc_id, '/lines/' || CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS VARCHAR) || '/qty' AS pointer, l_quantity AS qty
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
""")
def path_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = jsonpath.path_nodes(order_docs(spark, sf_dir), "doc", "$..qty", ["doc_id"])
    return nodes.select("doc_id", "pointer", F.col("value").cast("double").alias("qty"))


@query("""
WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_returnflag) AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1)
SELECT l_orderkey AS doc_id, q[1] AS first_qty, CAST(NULL AS DOUBLE) AS append, CAST(len(q) AS VARCHAR) AS append_key, 'a/b~c' AS step, '/a~1b~0c/x' AS formatted, true AS child, true AS valid, '/a~1b~0c' AS up
FROM l
""")
def pointer_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, text = F.col("v"), F.lit("/a~1b~0c/x")
    steps = pointer.parse(text)
    return _parsed(spark, sf_dir).select(
        "doc_id",
        F.try_variant_get(pointer.get(v, "/lines/0/qty"), "$", "double").alias("first_qty"),
        F.try_variant_get(pointer.get(v, "/lines/-"), "$", "double").alias("append"),
        pointer.find(v, "/lines/-")["key"].alias("append_key"),
        F.get(steps, F.lit(0)).alias("step"),
        pointer.format(steps).alias("formatted"),
        pointer.is_child(pointer.parse(F.lit("/a~1b~0c")), steps).alias("child"),
        (pointer.is_valid(text) & pointer.is_valid_path(steps) & pointer.is_valid_index(F.lit("10")) & ~pointer.is_valid_index(F.lit("01"))).alias("valid"),
        pointer.format(pointer.parent(steps)).alias("up"),
    )


@query("""
SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS p_test, true AS p_defined, true AS p_undefined, contains(lower(o_orderpriority), 'high') AS p_contains, starts_with(o_orderpriority, '1') AS p_starts, ends_with(o_orderpriority, 'W') AS p_ends,
       o_orderstatus IN ('O', 'P') AS p_in, o_custkey < 100 AS p_less, o_custkey > 100 AS p_more, regexp_matches(o_orderpriority, '^[12]-') AS p_matches, true AS p_type, true AS p_types, substr(o_orderpriority, 3, 1) = 'H' AS p_string, length(o_orderpriority) >= 6 AS p_len,
       o_orderstatus = 'F' AND o_custkey > 100 AS p_and, o_orderstatus = 'F' OR o_custkey > 100 AS p_or, NOT (o_orderstatus = 'F' OR o_custkey > 100) AS p_not
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def patch_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr, custkey = "/cust/priority", "/cust/id"
    final, high = {"op": "test", "path": "/status", "value": "F"}, {"op": "more", "path": custkey, "value": 100}
    ops = {
        "test": final,
        "defined": {"op": "defined", "path": "/lines/0"},
        "undefined": {"op": "undefined", "path": "/lines/99"},
        "contains": {"op": "contains", "path": pr, "value": "HIGH", "ignore_case": True},
        "starts": {"op": "starts", "path": pr, "value": "1"},
        "ends": {"op": "ends", "path": pr, "value": "W"},
        "in": {"op": "in", "path": "/status", "value": ["O", "P"]},
        "less": {"op": "less", "path": custkey, "value": 100},
        "more": high,
        "matches": {"op": "matches", "path": pr, "value": "^[12]-"},
        "type": {"op": "type", "path": "/lines", "value": "array"},
        "types": {"op": "test_type", "path": custkey, "type": ["string", "integer"]},
        "string": {"op": "test_string", "path": pr, "pos": 2, "str": "H"},
        "len": {"op": "test_string_len", "path": pr, "len": 6},
        "and": {"op": "and", "path": "", "apply": [final, high]},
        "or": {"op": "or", "path": "", "apply": [final, high]},
        "not": {"op": "not", "path": "", "apply": [final, high]},
    }
    return _parsed(spark, sf_dir).select("doc_id", *[patch.predicate(F.col("v"), op).alias(f"p_{n}") for n, op in ops.items()])


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n, list(l_quantity ORDER BY l_linenumber, l_quantity, l_returnflag) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, o_orderstatus AS status, 'a' || o_orderstatus || 'z' AS renamed, CAST(o_custkey + 1 AS DOUBLE) AS cust, CAST(n AS INTEGER) AS n_lines, q[1] AS moved, false AS flag, true AS no_priority,
       CAST(NULL AS VARCHAR) AS error, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'TEST' END AS guard
FROM orders JOIN l ON l_orderkey = o_orderkey
""")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch of mutations over all documents, and one that a test guards."""
    ops = '[{"op":"add","path":"/lines/-","value":{"qty":0}},{"op":"remove","path":"/lines/0/n"},{"op":"copy","from":"/status","path":"/name"},{"op":"str_ins","path":"/name","pos":0,"str":"abc"},{"op":"str_del","path":"/name","pos":1,"len":2},{"op":"str_ins","path":"/name","pos":99,"str":"z"},{"op":"inc","path":"/cust/id","inc":1},{"op":"move","from":"/lines/0","path":"/first"},{"op":"add","path":"/flag","value":true},{"op":"flip","path":"/flag"},{"op":"extend","path":"/cust","props":{"priority":null},"delete_null":true},{"op":"replace","path":"/key","value":null}]'
    guard = '[{"op":"test","path":"/status","value":"F"},{"op":"remove","path":"/lines"}]'
    docs = order_docs(spark, sf_dir).select("doc_id", "doc", patch.apply_patch_text(F.col("doc"), F.lit(ops)).alias("r"), patch.apply_patch_text(F.col("doc"), F.lit(guard))["error"].alias("guard"))
    v = docs.withColumn("v", F.parse_json("r.doc"))
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    return v.select("doc_id", get("$.status", "string").alias("status"), get("$.name", "string").alias("renamed"), get("$.cust.id", "double").alias("cust"), F.size(get("$.lines", "array<variant>")).alias("n_lines"), get("$.first.qty", "double").alias("moved"), get("$.flag", "boolean").alias("flag"), get("$.cust.priority", "string").isNull().alias("no_priority"), F.col("r.error").alias("error"), "guard")


@query("SELECT count(*) AS n, 0 AS wrong, 0 AS broken FROM (SELECT o_orderkey, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nxt FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))) WHERE nxt IS NOT NULL")
def patch_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches between the documents of successive orders rebuild the later one."""
    done = _successive(spark, sf_dir).select("dst", patch.rebuild_text(F.col("doc"), F.col("dst")).alias("r"))
    return done.agg(F.count("*").alias("n"), F.coalesce(F.sum((~json_utils.deep_equal_column(F.col("r.doc"), F.col("dst"))).cast("int")), F.lit(0)).alias("wrong"), F.count("r.error").alias("broken"))


#: Keys of a block of orders, and blocks over the whole range of keys, at most, by which a block of sparse keys is wider.
BLOCK, BLOCKS = 1_000, 100_000


def _successive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, dst): each order's document and the next one's.

    Documents are made and shuffled once, by blocks of keys; a window in each block carries the
    next document, and the first ones of all blocks, which are few, are ordered by one task. The
    pairs then go over all shuffle partitions, since patches cost time and not bytes.
    """
    low, high = table(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    size = max(BLOCK, -(-((high or 0) - (low or 0) + 1) // BLOCKS))
    number = F.expr(f"(doc_id - {low or 0}L) div {size}L")
    docs = order_docs(spark, sf_dir).withColumn("block", number).repartition("block")
    inside = docs.withColumn("dst", F.lead("doc").over(Window.partitionBy("block").orderBy("doc_id")))
    firsts = docs.groupBy("block").agg(F.min_by("doc", "doc_id").alias("first"))
    later = firsts.select("block", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("block")).alias("follow"))
    pairs = inside.join(later, "block", "left").select("doc_id", "doc", F.coalesce("dst", "follow").alias("dst")).filter("dst is not null")
    return crdt.spread(pairs, "doc_id").select("doc", "dst")


@query("""
SELECT event_id, '{"a":[1,' || CAST(json_extract(props, '$.k') AS VARCHAR) || '],"b":"' || event_type || '"}' AS stable, true AS equal, CAST(octet_length(encode('{"a":[1,' || CAST(json_extract(props, '$.k') AS VARCHAR) || '],"b":"' || event_type || '"}')) AS BIGINT) AS size,
       CAST(2 + 3 + 2 + 9 + 9 + 3 + 4 + length(event_type) AS BIGINT) AS fast, CAST(5 AS INTEGER) AS nodes, '"' || event_type || '"' AS quoted
FROM events
""")
def json_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"b":"'), F.col("event_type"), F.lit('", "a":[1, '), F.get_json_object("props", "$.k"), F.lit("]}"))
    rows = events.select("event_id", "event_type", doc.alias("doc"))
    d = F.col("doc")
    return rows.select("event_id", json_utils.stringify_column(d).alias("stable"), json_utils.deep_equal_column(d, json_utils.stringify_column(d)).alias("equal"), json_utils.json_size_column(d).alias("size"), json_utils.size_fast_column(d).alias("fast"), F.size(json_utils.walk_column(d)).alias("nodes"), json_utils.as_string_column(F.col("event_type")).alias("quoted"))


@query("SELECT p_partkey, true AS same_hash FROM part")
def json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native 32-bit fold agrees with the general hash on every name."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", (json_utils.hash_column(json_utils.as_string_column(F.col("p_name"))) == json_utils.hash_str_column(F.col("p_name"))).alias("same_hash"))


@query("""
SELECT a.conv_id, a.turn, true AS src_ok, true AS dst_ok, true AS inverse_ok, CAST(length(a.text) - length(b.text) AS INTEGER) AS shrunk, true AS lines_ok
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between successive turns rebuild both sides."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("dst"))
    both = [crdt.spread(side, "conv_id", "turn") for side in (turns, later)]  # under the join, which would drop the same partitioning above it
    pairs = diff.with_diffs(both[0].join(both[1], ["conv_id", "turn"]), "text", "dst")
    p, text, dst = F.col("p"), F.col("text"), F.col("dst")
    length = lambda kind: F.aggregate(F.filter(p, lambda x: x["kind"] == kind), F.lit(0), lambda a, x: a + F.char_length(x["text"]))
    sides = F.size(F.filter("lines", lambda x: x["kind"] != "ins")) == F.size(F.split(text, "\n", -1))
    return pairs.select("conv_id", "turn", (diff.src_column(p) == text).alias("src_ok"), (diff.dst_column(p) == dst).alias("dst_ok"), (diff.dst_column(diff.invert_column(p)) == text).alias("inverse_ok"), (length(-1) - length(1)).alias("shrunk"), sides.alias("lines_ok"))


@query("SELECT c_custkey, 'ab' || substr(c_name, 3, 4) || substr(c_name, 8) AS edited FROM customer")
def ot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", diff.ot_apply_column(F.col("c_name"), F.lit('["ab", -2, 4, -1]')).alias("edited"))


EVENT = {"kind": "obj", "keys": [{"key": "k", "value": {"kind": "num", "format": "u8", "gte": 10, "lt": 90}}, {"key": "x", "value": {"kind": "str"}, "optional": True}]}


@query("""
SELECT event_id, CASE WHEN k < 10 THEN 'GTE' WHEN k >= 90 THEN 'LT' END AS fault, CASE WHEN k BETWEEN 10 AND 89 THEN 0 ELSE 1 END AS branch, 'KEYS' AS unknown, 'NUM' AS wrong, 'KEY' AS missing
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
""")
def type_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    types.check(EVENT)
    events = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    fixed = lambda text: types.validator(F.parse_json(F.lit(text)), EVENT)
    return events.select("event_id", types.validator(F.col("v"), EVENT).alias("fault"), types.discriminator(F.col("v"), {"kind": "or", "types": [EVENT, {"kind": "any"}]}).alias("branch"), fixed('{"k":20,"y":1}').alias("unknown"), fixed('{"k":"a"}').alias("wrong"), fixed("{}").alias("missing"))


@query("SELECT 'OBJECT<k: BIGINT>' AS kind, count(*) AS n FROM events")
def type_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of a column of documents, merged over all rows."""
    return table(spark, sf_dir, "events").agg(F.schema_of_variant_agg(F.try_parse_json("props")).alias("kind"), F.count("*").alias("n"))


@query("""
SELECT item_id, to_base64(encode(text)) AS b64, rtrim(translate(to_base64(encode(text)), '+/', '-_'), '=') AS url, 'data:application/octet-stream;base64,' || to_base64(encode(text)) AS uri, text AS back
FROM benchmark
""")
def codec_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    plain = F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))
    return table(spark, sf_dir, "benchmark").select("item_id", plain.alias("b64"), codecs.base64_url(raw).alias("url"), codecs.data_uri(raw).alias("uri"), codecs.from_base64_url(codecs.base64_url(raw)).cast("string").alias("back"))


@query("SELECT event_id, true AS cbor, true AS cbor_stable, true AS msgpack, true AS ubjson, true AS bson, true AS resp, CAST(4 + 1 + CASE WHEN k < 24 THEN 0 WHEN k < 256 THEN 1 ELSE 2 END - 1 AS INTEGER) AS cbor_bytes FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = crdt.spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    text = F.col("props")
    names = ("cbor", "cbor_stable", "msgpack", "ubjson", "bson", "resp")
    same = [json_utils.deep_equal_column(codecs.decode_column(codecs.encode_column(text, n), n), text).alias(n) for n in names]
    return events.select("event_id", *same, F.octet_length(codecs.encode_column(text, "cbor")).alias("cbor_bytes"))
