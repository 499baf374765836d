"""Replicated documents: events as register writes, conversations as text logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import crdt
from docloom.queries.registry import query, table
from docloom.streaming import replay as streams

_OPS = """WITH ops AS (SELECT user_id, event_type, event_id AS time, event_id % 4 AS sid, value, user_id % 5 AS slot, 1 + event_id % 3 AS span FROM events)
"""


def register_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes: document user, key type, time the event's number, four sessions."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_type", e.alias("time"), (e % 4).alias("sid"), "value", (1 + e % 3).alias("span"))


@query(_OPS + "SELECT user_id, arg_max(value, time) AS value, max(time) AS time, CAST(arg_max(sid, time) AS BIGINT) AS sid FROM ops GROUP BY user_id")
def lww_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crdt.lww(register_ops(spark, sf_dir), ["user_id"], "value")


@query(_OPS + ", w AS (SELECT user_id, event_type, arg_max(value, time) AS value FROM ops GROUP BY 1, 2) SELECT user_id, count(*) AS n_keys, string_agg(event_type, ',' ORDER BY event_type) AS keys, round(sum(value), 4) AS total FROM w GROUP BY user_id")
def lww_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = crdt.lww_map(register_ops(spark, sf_dir), "user_id", "event_type", "value")
    total = F.aggregate(F.map_values("view"), F.lit(0.0), lambda a, x: a + x)
    return view.select("user_id", F.size("view").cast("long").alias("n_keys"), F.array_join(F.array_sort(F.map_keys("view")), ",").alias("keys"), F.round(total, 4).alias("total"))


@query("WITH w AS (SELECT user_id, event_id % 6 AS slot, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2) SELECT user_id, CAST(max(slot) + 1 AS BIGINT) AS size, round(sum(value), 4) AS total FROM w GROUP BY user_id")
def lww_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = register_ops(spark, sf_dir).withColumn("slot", F.col("time") % 6)
    view = crdt.lww_vector(ops, "user_id", "slot", "value")
    return view.select("user_id", F.size("view").cast("long").alias("size"), F.round(F.aggregate("view", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 4).alias("total"))


@query(_OPS + "SELECT user_id, sid, max(time + span - 1) AS last FROM ops GROUP BY user_id, sid")
def clock_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crdt.clock_vector(register_ops(spark, sf_dir), "user_id")


@query(_OPS + "SELECT user_id, time, CAST(1000 + coalesce(sum(span) OVER (PARTITION BY user_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ops")
def batch_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crdt.batch_rebase(register_ops(spark, sf_dir), "user_id", ["time"], "span", F.lit(1000)).select("user_id", "time", "start")


@query(_OPS + "SELECT user_id, sid, time, CAST(coalesce(time - lag(time + span) OVER (PARTITION BY user_id, sid ORDER BY time), 0) AS BIGINT) AS gap FROM ops")
def patch_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crdt.gaps(register_ops(spark, sf_dir), "user_id", "sid", "time", "span").select("user_id", "sid", "time", "gap")


@query("SELECT user_id, sum(n) AS total FROM (SELECT user_id, event_id % 4 AS sid, arg_max(CAST(value AS BIGINT), event_id) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def crdt_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = register_ops(spark, sf_dir).withColumn("n", F.rint("value").cast("long"))
    return crdt.counter(ops, "user_id", "sid", "n").select("user_id", F.col("count").alias("total"))


def text_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as inserts of one session, each after the last unit of the one before."""
    turns = table(spark, sf_dir, "conversations").filter("length(text) > 0")
    own = Window.partitionBy("conv_id").orderBy("turn")
    start = 1 + F.coalesce(F.sum(F.char_length("text")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = turns.withColumn("time", start)
    return rows.select("conv_id", F.col("time"), F.lit(7).cast("long").alias("sid"), F.when(F.col("time") > 1, F.col("time") - 1).alias("after_time"), F.lit(7).cast("long").alias("after_sid"), "text", F.lit(0).cast("long").alias("deleted"))


@query("SELECT conv_id, 7 AS sid, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n_ops FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = crdt.compact_log(text_ops(spark, sf_dir), "conv_id", "sid", "time", "text", "after_time")
    return done.select("conv_id", F.col("sid").cast("int").alias("sid"), "text", "n_ops")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS view FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def rga_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crdt.rga_text(text_ops(spark, sf_dir), ["conv_id"])


@query("SELECT conv_id, substr(string_agg(text, '' ORDER BY turn), 4) || '!' AS view FROM conversations WHERE length(text) > 0 GROUP BY conv_id HAVING sum(length(text)) > 3")
def rga_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three units deleted, and a mark of a later session after the last unit."""
    ops = text_ops(spark, sf_dir)
    sums = ops.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("end")).filter("end > 3")
    kinds = dict(ops.dtypes)

    def row(**values):
        return sums.select("conv_id", *[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in ops.columns[1:]])

    cut = row(time=F.lit(1), sid=F.lit(7), deleted=F.lit(3))
    mark = row(time=F.col("end") + 5, sid=F.lit(9), after_time=F.col("end"), after_sid=F.lit(7), text=F.lit("!"), deleted=F.lit(0))
    kept = ops.join(sums.select("conv_id"), "conv_id", "left_semi")
    return crdt.rga_text(kept.unionByName(cut).unionByName(mark), ["conv_id"])


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id")
def doc_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents from patches: one creates the root, each event sets two keys."""
    e = F.col("event_id")
    time = (10 + e * 10).cast("string")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    events = table(spark, sf_dir, "events")
    write = text('{"id":[2,', time, '],"ops":[{"op":"new_con","value":"', F.col("event_type"), '"},{"op":"ins_obj","obj":[1,1],"value":[["last",[2,', time, ']],["t', F.col("event_type"), '",[2,', time, "]]]}]}")
    root = events.select("user_id").distinct().select("user_id", F.lit('{"id":[1,1],"ops":[{"op":"new_obj"},{"op":"ins_val","obj":[0,0],"value":[1,1]}]}').alias("patch"))
    view = crdt.replay(events.select("user_id", write.alias("patch")).unionByName(root), "user_id", "patch")
    n = events.groupBy("user_id").agg(F.count("*").alias("n"))
    return view.select("user_id", F.get_json_object("view", "$.last").alias("last")).join(n, "user_id")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stream_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map winners from a file stream; replays and reordering change nothing."""
    schema = table(spark, sf_dir, "events").schema
    events = streams.read_files(spark, sf_dir, schema, "events.parquet")
    ops = events.select("user_id", "event_type", F.col("event_id").alias("time"), (F.col("event_id") % 4).alias("sid"), "value")
    return streams.run_once(streams.lww_stream(ops, ["user_id", "event_type"], "value"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = streams.read_files(spark, sf_dir, schema, "events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    found = streams.run_once(streams.tumbling(events, "ts", "1 day", "40 days", ["event_type"]))
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 2)})
