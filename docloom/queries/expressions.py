"""The expression language, by family of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.values import truthy
from docloom.plans.expression import compile_expression, compile_predicate, compile_value, row_context
from docloom.queries.registry import query, table

V = lambda name: ["$", f"/{name}"]


def _select(df: DataFrame, keys: list[str], expressions: dict[str, list], json_columns: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keys, *[compile_expression(e, df, json_columns).alias(n) for n, e in expressions.items()])


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS max_k
FROM events WHERE event_type = 'purchase' AND value > 50 AND CAST(json_extract(props, '$.k') AS DOUBLE) >= 20 GROUP BY event_type
""")
def expr_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases above 50 whose property k is at least 20, counted and summed."""
    events = table(spark, sf_dir, "events")
    keep = compile_predicate(["&&", ["==", V("event_type"), "purchase"], ["&&", [">", V("value"), 50], [">=", ["num", V("props/k")], 20]]], events, ("props",))
    k = compile_expression(["num", V("props/k")], events, ("props",))
    return events.where(keep).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max(k).alias("max_k"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity + l_extendedprice AS a_add, l_extendedprice - l_quantity - l_discount AS a_sub,
       l_extendedprice * (1 - l_discount) AS a_mul, l_extendedprice / l_quantity AS a_div, fmod(l_extendedprice, 7) AS a_mod,
       least(l_quantity, l_linenumber) AS a_min, greatest(l_quantity, 25) AS a_max, round(l_extendedprice) AS a_round,
       ceil(l_extendedprice) AS a_ceil, floor(l_extendedprice) AS a_floor, trunc(-l_extendedprice) AS a_trunc, abs(l_discount - 1) AS a_abs, sqrt(l_quantity) AS a_sqrt
FROM lineitem
""")
def expr_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p, d = V("l_quantity"), V("l_extendedprice"), V("l_discount")
    found = {"add": ["+", q, p], "sub": ["-", p, q, d], "mul": ["*", p, ["-", 1, d]], "div": ["/", p, q], "mod": ["%", p, 7], "min": ["min", q, V("l_linenumber")], "max": ["max", q, 25], "round": ["round", p], "ceil": ["ceil", p], "floor": ["floor", p], "trunc": ["trunc", ["-", 0, p]], "abs": ["abs", ["-", d, 1]], "sqrt": ["sqrt", q]}
    return _select(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {f"a_{k}": e for k, e in found.items()})


@query("""
SELECT l_orderkey, l_linenumber, round(exp(l_discount), 6) AS t_exp, round(ln(l_quantity), 6) AS t_ln, round(ln(l_extendedprice) / ln(2), 6) AS t_log,
       round(log10(l_extendedprice), 6) AS t_log10, round(pow(l_quantity, 2), 6) AS t_pow, CAST(NULL AS DOUBLE) AS t_none
FROM lineitem
""")
def expr_transcendental(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p, d = V("l_quantity"), V("l_extendedprice"), V("l_discount")
    found = {"exp": ["exp", d], "ln": ["ln", q], "log": ["log", p, 2], "log10": ["log10", p], "pow": ["**", q, 2], "none": ["sqrt", ["-", 0, q]]}
    rows = _select(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {f"t_{k}": e for k, e in found.items()})
    return rows.select("l_orderkey", "l_linenumber", *[F.round(f"t_{k}", 6).alias(f"t_{k}") for k in found])


@query("""
SELECT l_orderkey, l_linenumber, l_quantity = 17 AS c_eq, l_returnflag <> 'R' AS c_ne, l_quantity > 25 AS c_gt, l_quantity >= 25 AS c_ge, l_returnflag < l_linestatus AS c_lt,
       l_discount <= 0.05 AS c_le, CASE WHEN l_quantity > 25 THEN 1 WHEN l_quantity < 25 THEN -1 ELSE 0 END AS c_cmp, l_quantity BETWEEN 10 AND 20 AS c_between,
       l_quantity > 10 AND l_quantity < 20 AS c_open, l_quantity >= 10 AND l_quantity < 20 AS c_left, l_quantity > 10 AND l_quantity <= 20 AS c_right, '9' < '10' AS c_text
FROM lineitem
""")
def expr_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V("l_quantity")
    found = {"eq": ["==", q, 17], "ne": ["!=", V("l_returnflag"), "R"], "gt": [">", q, 25], "ge": [">=", q, 25], "lt": ["<", V("l_returnflag"), V("l_linestatus")], "le": ["<=", V("l_discount"), 0.05], "cmp": ["cmp", q, 25], "between": ["=><=", q, 10, 20], "open": ["><", q, 10, 20], "left": ["=><", q, 10, 20], "right": ["><=", q, 10, 20], "text": ["<", "9", 10]}
    return _select(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {f"c_{k}": e for k, e in found.items()})


@query("""
SELECT event_id, value > 50 AND event_type = 'click' AS l_and, value > 90 OR event_type = 'error' AS l_or, NOT (value > 50) AS l_not,
       CASE WHEN value <> 0 THEN event_type ELSE 'zero' END AS l_if, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS l_first, CASE WHEN user_id % 3 = 0 THEN 7 ELSE CAST(user_id % 3 AS DOUBLE) END AS l_last
FROM events
""")
def expr_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    third = ["%", V("user_id"), 3]
    found = {"and": ["&&", [">", V("value"), 50], ["==", V("event_type"), "click"]], "or": ["||", [">", V("value"), 90], ["==", V("event_type"), "error"]], "not": ["!", [">", V("value"), 50]], "if": ["?", V("value"), V("event_type"), "zero"], "first": ["?", third, V("user_id"), 0], "last": ["||", third, 7]}
    return _select(events, ["event_id"], {f"l_{k}": e for k, e in found.items()})


@query("""
SELECT event_id, 'number' AS t_value, 'object' AS t_props, 'number' AS t_k, 'undefined' AS t_none, value <> 0 AS t_bool, CAST(json_extract(props, '$.k') AS DOUBLE) AS t_num,
       CAST(json_extract(props, '$.k') AS VARCHAR) AS t_str, length(event_type) AS t_len, 1 AS t_olen, true AS t_und, false AS t_nil, true AS t_isnum, true AS t_isstr, false AS t_isarr, true AS t_isobj, false AS t_isbool, false AS t_isbin
FROM events
""")
def expr_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = V("props/k"), V("props/none")
    found = {"value": ["type", V("value")], "props": ["type", V("props")], "k": ["type", k], "none": ["type", none], "bool": ["bool", V("value")], "num": ["num", k], "str": ["str", k], "len": ["len", V("event_type")], "olen": ["len", V("props")], "und": ["und?", none], "nil": ["nil?", k], "isnum": ["num?", k], "isstr": ["str?", V("event_type")], "isarr": ["arr?", V("props")], "isobj": ["obj?", V("props")], "isbool": ["bool?", k], "isbin": ["bin?", k]}
    return _select(table(spark, sf_dir, "events"), ["event_id"], {f"t_{n}": e for n, e in found.items()}, ("props",))


@query("""
SELECT p_partkey, p_brand || '/' || CAST(p_size AS VARCHAR) AS s_cat, contains(p_name, 'a') AS s_contains, starts_with(p_type, 'S') AS s_starts, ends_with(p_brand, '1') AS s_ends,
       substr(p_name, 2, greatest(length(p_name) - 2, 0)) AS s_substr, regexp_matches(p_brand, '#[1-3]') AS s_matches, substr(p_name, 1, 1) AS s_member, p_size AS s_get, true AS s_defined, 'none' AS s_default
FROM part
""")
def expr_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = V("p_name")
    found = {"cat": [".", V("p_brand"), "/", V("p_size")], "contains": ["contains", name, "a"], "starts": ["starts", V("p_type"), "S"], "ends": ["ends", V("p_brand"), "1"], "substr": ["substr", name, 1, -1], "matches": ["matches", V("p_brand"), "#[1-3]"], "member": ["[]", name, 0], "get": V("p_size"), "defined": ["$?", "/p_name"], "default": ["$", "/nothing", "none"]}
    return _select(table(spark, sf_dir, "part"), ["p_partkey"], {f"s_{k}": e for k, e in found.items()})


@query("""
SELECT c_custkey, c_custkey % 2 = 0 AS f_email, c_custkey % 3 <> 0 AS f_host, c_custkey % 300 < 256 AS f_ip4, c_custkey % 5 <> 0 AS f_ip6, c_custkey % 2 = 1 AS f_uuid,
       c_custkey % 4 <> 0 AS f_uri, c_custkey % 2 = 0 AS f_duration, c_custkey % 32 BETWEEN 1 AND 29 AS f_date, c_custkey % 100 < 60 AS f_time, c_custkey % 32 BETWEEN 1 AND 29 AND c_custkey % 100 < 60 AS f_datetime
FROM customer
""")
def expr_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of texts made from the key, valid where the SQL says so (2024 is a leap year)."""
    key = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.concat(F.lit("2024-02-"), two(key % 32))
    time = F.concat(F.lit("12:30:"), two(key % 100), F.lit("Z"))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("c"), key.cast("string"), F.when(key % 2 == 0, "@x.org").otherwise("@-x")).alias("email"),
        F.concat(F.lit("h"), F.when(key % 3 != 0, "-1.example").otherwise("_1.example")).alias("host"),
        F.concat(F.lit("10.0.0."), (key % 300).cast("string")).alias("ip4"),
        F.concat(F.lit("2001:db8::"), F.when(key % 5 != 0, F.lower(F.hex(key % 65536))).otherwise("g")).alias("ip6"),
        F.concat(F.lit("123e4567-e89b-12d3-a456-42661417400"), F.when(key % 2 == 1, "0").otherwise("z")).alias("uuid"),
        F.concat(F.when(key % 4 != 0, "https://h/").otherwise("/h/"), key.cast("string")).alias("uri"),
        F.when(key % 2 == 0, "P1DT2H").otherwise("P1DT").alias("duration"),
        date.alias("date"),
        time.alias("time"),
        F.concat(date, F.lit("T"), time).alias("datetime"),
    )
    found = {"email": "email?", "host": "hostname?", "ip4": "ip4?", "ip6": "ip6?", "uuid": "uuid?", "uri": "uri?", "duration": "duration?", "date": "date?", "time": "time?", "datetime": "dateTime?"}
    return _select(rows, ["c_custkey"], {f"f_{k}": [op, V(k)] for k, op in found.items()})


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's key and its lines' quantities, in line order."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    return lines.groupBy("l_orderkey").agg(pairs.alias("pairs")).select("l_orderkey", F.transform("pairs", lambda p: p["l_quantity"]).alias("q"))


@query("""
WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(q) + 2 AS a_concat, q[1] AS a_first, list_sum(q[1:2]) AS a_head, list_sum(q[greatest(len(q) - 1, 1):]) AS a_tail, (list_sort(list_transform(q, lambda x: CAST(x AS VARCHAR))))[1] AS a_sort, q[-1] AS a_last,
       list_contains(q, 17) AS a_in, coalesce(list_position(q, 17), 0) - 1 AS a_index, list_sum(list_append(q[2:3], 0.0)) AS a_slice, least(len(q), 3) AS a_zip,
       len(list_filter(q, lambda x: x > 25)) AS a_filter, list_sum(list_transform(q, lambda x: x * 2 + 1)) AS a_map, list_sum(q) AS a_reduce
FROM o
""")
def expr_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V("q")
    total = lambda a: ["reduce", a, 0, "s", "x", ["+", ["$", "s"], ["$", "x"]]]
    found = {"concat": ["len", ["concat", q, ["push", [[1.5]], 2.5]]], "first": ["[]", q, 0], "head": total(["head", q, 2]), "tail": total(["head", q, -2]), "sort": ["str", ["[]", ["sort", q], 0]], "last": ["[]", ["reverse", q], 0], "in": ["in", q, 17], "index": ["indexOf", q, 17], "slice": total(["slice", q, 1, 3]), "zip": ["len", ["zip", q, [[1.0, 2.0, 3.0]]]], "filter": ["len", ["filter", q, "x", [">", ["$", "x"], 25]]], "map": total(["map", q, "x", ["+", ["*", ["$", "x"], 2], 1]]), "reduce": total(q)}
    return _select(orders_with_lines(spark, sf_dir), ["l_orderkey"], {f"a_{k}": e for k, e in found.items()})


@query("""
SELECT event_id, 'k' AS o_keys, CAST(json_extract(props, '$.k') AS DOUBLE) AS o_values, 'k' AS o_entries, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"z":1}' AS o_set,
       0 AS o_del, CAST(json_extract(props, '$.k') AS DOUBLE) AS o_from, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"t":"' || event_type || '"}' AS o_add
FROM events
""")
def expr_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V("props")
    found = {"keys": ["str", ["[]", ["keys", p], 0]], "values": ["num", ["[]", ["values", p], 0]], "entries": ["str", ["[]", ["[]", ["entries", p], 0], 0]], "set": ["str", ["o.set", p, "z", 1]], "del": ["len", ["o.del", p, "k"]], "from": ["num", ["[]", ["fromEntries", ["entries", p]], "k"]], "add": ["str", ["jp.add", p, "/t", V("event_type")]]}
    return _select(table(spark, sf_dir, "events"), ["event_id"], {f"o_{k}": e for k, e in found.items()}, ("props",))


@query("""
SELECT o_orderkey, CAST(o_orderkey & 255 AS INTEGER) AS b_and, CAST(o_custkey & 4294967295 | 1 AS INTEGER) AS b_or, CAST(xor(o_orderkey, o_custkey) AS INTEGER) AS b_xor, CAST(-o_orderkey - 1 AS INTEGER) AS b_not,
       CAST(-1294967296 AS INTEGER) AS b_wrap, ascii(o_orderstatus) AS b_u8
FROM orders
""")
def expr_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("raw", F.col("o_orderstatus").cast("binary"))
    found = {"and": ["&", V("o_orderkey"), 255], "or": ["|", V("o_custkey"), 1], "xor": ["^", V("o_orderkey"), V("o_custkey")], "not": ["~", V("o_orderkey")], "wrap": ["|", 3000000000, 0], "u8": ["u8", V("raw"), 0]}
    return _select(orders, ["o_orderkey"], {f"b_{k}": e for k, e in found.items()})


@query("SELECT event_type, count(*) AS n FROM events WHERE length(event_type) > 4 OR value < 10 GROUP BY event_type")
def expr_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value used for its truth: an operand, not a boolean, comes out of ||."""
    events = table(spark, sf_dir, "events")
    keep = truthy(compile_value(["||", [">", ["len", V("event_type")], 4], ["<", V("value"), 10]], row_context(events)))
    return events.where(keep).groupBy("event_type").agg(F.count("*").alias("n"))
