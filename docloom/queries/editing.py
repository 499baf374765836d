"""Patch forms, edits, undo, snapshots, rich text and random data over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import json_utils, random_data
from docloom.operators import crdt, edit, richtext
from docloom.queries.registry import query, table
from docloom.sources import codecs, documents, literals, patches, wire  # noqa: F401  (wire registers its codecs)


def _parts(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _quoted(c: Column) -> Column:
    """JSON text of a string Column."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def _text_patch() -> Column:
    """A patch of session 2 that writes the event's type as text."""
    time = F.col("event_id") * 10 + 10
    return _parts('{"id":[2,', time, '],"ops":[{"op":"new_str"},{"op":"ins_str","obj":[2,', time, '],"after":[2,', time, '],"value":', _quoted(F.col("event_type")), "}]}")


@query("SELECT event_id, true AS patch_binary, true AS patch_compact, true AS patch_compact_binary, true AS patch_verbose, true AS ion, CAST(octet_length(encode(event_type)) AS INTEGER) + CASE WHEN length(event_type) < 8 THEN 0 ELSE 1 END + 5 + CASE WHEN event_id * 10 + 10 < 128 THEN 1 WHEN event_id * 10 + 10 < 16384 THEN 2 WHEN event_id * 10 + 10 < 2097152 THEN 3 WHEN event_id * 10 + 10 < 268435456 THEN 4 ELSE 5 END + 2 * CASE WHEN event_id * 10 + 10 < 64 THEN 1 WHEN event_id * 10 + 10 < 8192 THEN 2 WHEN event_id * 10 + 10 < 1048576 THEN 3 WHEN event_id * 10 + 10 < 134217728 THEN 4 ELSE 5 END AS binary_bytes FROM events")
def patch_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips of every form of a patch and of Ion, and the size of the binary form."""
    e = crdt.spread(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), "event_id")
    text = _text_patch()
    made = {n: codecs.encode_column(text, n) for n in ("patch_binary", "patch_compact", "patch_compact_binary", "patch_verbose")}
    same = [json_utils.deep_equal_column(codecs.decode_column(c, n), text).alias(n) for n, c in made.items()]
    ion = json_utils.deep_equal_column(codecs.decode_column(codecs.encode_column(F.col("props"), "ion"), "ion"), F.col("props")).alias("ion")
    return e.select("event_id", *same, ion, F.octet_length(made["patch_binary"]).alias("binary_bytes"))


@query("SELECT event_id, CAST(2 AS BIGINT) AS sid, event_id * 10 + 10 AS time, CAST(1 AS BIGINT) AS span, 'new_str' AS op FROM events UNION ALL SELECT event_id, 2, event_id * 10 + 11, length(event_type), 'ins_str' FROM events")
def patch_operation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return patches.operation_rows(e.select("event_id", _text_patch().alias("patch")), "patch").drop("body")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id")
def doc_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations typed into documents: every turn appends to a text and to a list."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    root = F.lit('{"id":[1,1],"ops":[{"op":"new_obj"},{"op":"new_str"},{"op":"new_arr"},{"op":"ins_obj","obj":[1,1],"value":[["text",[1,2]],["roles",[1,3]]]},{"op":"ins_val","obj":[0,0],"value":[1,1]}]}')
    start = turns.select("conv_id").distinct().withColumn("patch", root)
    write = _parts('{"do":"ins","path":["text"],"value":', _quoted(F.col("text")), "}")
    note = _parts('{"do":"ins","path":["roles"],"value":[', _quoted(F.col("role")), "]}")
    edits = turns.select("conv_id", "turn", F.explode(F.array(write, note)).alias("edit"))
    done = edit.apply_edits(start, edits, "conv_id", "patch", "turn", "edit", 9)
    roles = F.from_json(F.get_json_object("view", "$.roles"), "array<string>")
    return done.select("conv_id", F.get_json_object("view", "$.text").alias("text"), F.array_join(roles, ",").alias("roles"))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch a user that makes an object, and one an event that writes its key ``last``."""
    e = table(spark, sf_dir, "events")
    time = F.col("event_id") * 10 + 10
    write = _parts('{"id":[2,', time, '],"ops":[{"op":"new_con","value":', _quoted(F.col("event_type")), '},{"op":"ins_obj","obj":[1,1],"value":[["last",[2,', time, "]]]}]}")
    root = F.lit('{"id":[1,1],"ops":[{"op":"new_obj"},{"op":"ins_val","obj":[0,0],"value":[1,1]}]}')
    return e.select("user_id", "event_id", write.alias("patch")).unionByName(e.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("event_id"), root.alias("patch")))


@query("SELECT user_id, max(event_type) FILTER (WHERE nth = 2) AS last FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) GROUP BY user_id")
def doc_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of every user taken back."""
    log = _writes(spark, sf_dir)
    newest = log.groupBy("user_id").agg(F.max_by("patch", "event_id").alias("patch"))
    undone = edit.undo_patches(log, newest, "user_id", "patch", 11)
    return undone.select("user_id", F.get_json_object("view", "$.last").alias("last"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id")
def doc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first writes folded into snapshots, the later ones replayed upon them."""
    log = _writes(spark, sf_dir)
    cut = 2010  # the tick of event 200
    old = edit.advance(log.filter(F.col("event_id") * 10 + 10 <= cut), "user_id", "patch", (cut, 2))
    later = log.filter(F.col("event_id") * 10 + 10 > cut)
    return edit.replay_from(old, later, "user_id", "patch").select("user_id", F.get_json_object("view", "$.last").alias("last"))


@query("SELECT DISTINCT user_id, true AS reached FROM events")
def doc_diff_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event as a document, edited into the last one."""
    e = table(spark, sf_dir, "events").withColumn("doc", _parts('{"type":', _quoted(F.col("event_type")), ',"props":', F.coalesce("props", F.lit("null")), ',"path":["e",', F.col("event_id"), "]}"))
    ends = e.groupBy("user_id").agg(F.min_by("doc", "event_id").alias("first"), F.max_by("doc", "event_id").alias("target"))
    empty = ends.select("user_id", F.lit(None).cast("string").alias("patch"))
    made = edit.diff_apply(empty, ends.select("user_id", F.col("first").alias("target")), "user_id", "patch", "target", 3).select("user_id", "patch")
    done = edit.diff_apply(made, ends.select("user_id", "target"), "user_id", "patch", "target", 9)
    return done.join(ends, "user_id").select("user_id", json_utils.deep_equal_column(F.col("view"), F.col("target")).alias("reached"))


@query("SELECT conv_id, turn, '-3' AS type, CAST(0 AS BIGINT) AS start, CAST(5 AS BIGINT) AS stop, substr(text, 1, 5) AS covered FROM conversations WHERE length(text) >= 5")
def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five units of every turn in bold."""
    turns = table(spark, sf_dir, "conversations").filter("length(text) >= 5")
    slices = (F.char_length("text") + 3).cast("string")
    make = _parts('{"id":[7,1],"ops":[{"op":"new_obj"},{"op":"new_str"},{"op":"ins_str","obj":[7,2],"after":[7,2],"value":', _quoted(F.col("text")), '},{"op":"new_arr"},{"op":"ins_obj","obj":[7,1],"value":[["text",[7,2]],["slices",[7,', slices, ']]]},{"op":"ins_val","obj":[0,0],"value":[7,1]}]}')
    # header 6: "many" over an end after its element
    bold = _parts('{"id":[8,9000000],"ops":[{"op":"new_vec"},{"op":"new_con","value":6},{"op":"new_con","timestamp":[7,3]},{"op":"new_con","timestamp":[7,7]},{"op":"new_con","value":-3},{"op":"ins_vec","obj":[8,9000000],"value":[[0,[8,9000001]],[1,[8,9000002]],[2,[8,9000003]],[3,[8,9000004]]]},{"op":"ins_arr","obj":[7,', slices, '],"after":[7,', slices, '],"values":[[8,9000000]]}]}')
    rows = turns.select(_parts(F.col("conv_id"), ":", F.col("turn")).alias("doc"), F.explode(F.array(make, bold)).alias("patch"))
    own = richtext.effective(richtext.slice_rows(rows, "doc", "patch"), "doc")
    key = F.split("doc", ":")
    kinds = dict(turns.dtypes)
    return own.select(key[0].cast(kinds["conv_id"]).alias("conv_id"), key[1].cast(kinds["turn"]).alias("turn"), "type", "start", "stop", "covered")


@query("WITH s AS (SELECT user_id, event_type AS type, event_id % 50 AS start, event_id % 50 + 10 AS stop FROM events), b AS (SELECT user_id, start AS p FROM s UNION SELECT user_id, stop FROM s), g AS (SELECT user_id, p AS start, lead(p) OVER (PARTITION BY user_id ORDER BY p) AS stop FROM b) SELECT g.user_id, g.start, g.stop, string_agg(DISTINCT s.type, ',' ORDER BY s.type) AS types FROM g JOIN s ON s.user_id = g.user_id AND s.start <= g.start AND s.stop >= g.stop GROUP BY 1, 2, 3")
def rich_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as slices of their user's text, and which types cover each stretch."""
    e = table(spark, sf_dir, "events")
    start = F.col("event_id") % 50
    slices = e.select("user_id", F.col("event_type").alias("type"), start.alias("start"), (start + 10).alias("stop"), F.lit("many").alias("stacking"))
    return richtext.runs(slices, "user_id").withColumn("types", F.array_join("types", ","))


@query("SELECT event_id, (s1 - 1) / 2147483646.0::DOUBLE AS first, (s1 * 48271 % 2147483647 - 1) / 2147483646.0::DOUBLE AS second FROM (SELECT event_id, (CASE WHEN event_id = 0 THEN 1 ELSE event_id END) * 48271 % 2147483647 AS s1 FROM events)")
def random_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", random_data.lcg(e).alias("first"), random_data.lcg(e, 2).alias("second"))


@query("SELECT event_id, true AS ages, true AS amounts, true AS nested, true AS grown FROM events")
def random_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of templates, seeded by the event's number, and whether they keep their ranges."""
    own = random_data.Draws(F.col("event_id"))
    made = crdt.spread(table(spark, sf_dir, "events").select("event_id"), "event_id").select("event_id", *[random_data.template(random_data.EXAMPLES[n], own.at(n)).alias(n) for n in ("user", "order", "tree")], random_data.random_json(F.col("event_id"), 12).alias("grown"))
    age = F.get_json_object("user", "$.age").cast("int")
    items = F.from_json(F.get_json_object("order", "$.items"), "array<struct<quantity:int, price:double>>")
    return made.select(
        "event_id",
        F.coalesce(age.between(18, 99), F.lit(True)).alias("ages"),
        (F.size(items).between(1, 5) & F.forall(items, lambda i: i["quantity"].between(1, 9) & i["price"].between(1, 500))).alias("amounts"),
        F.get_json_object("tree", "$.value").cast("int").between(0, 99).alias("nested"),
        F.try_parse_json("grown").isNotNull().alias("grown"),
    )


@query("SELECT user_id, last AS binary, last AS compact, last AS compact_binary, last AS verbose FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id)")
def document_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded in every structural form and viewed from it."""
    states = documents.encode_forms(_writes(spark, sf_dir), "user_id", "patch", list(documents.FORMS))
    return states.select("user_id", *[F.get_json_object(documents.view_column(F.col(form), form), "$.last").alias(form) for form in documents.FORMS])


@query("SELECT user_id, CAST(1 + 1 + count(*) AS BIGINT) AS nodes FROM (SELECT user_id FROM events) GROUP BY user_id")
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table: a root, an object, and a constant an event."""
    return documents.node_rows(_writes(spark, sf_dir), "user_id", "patch").groupBy("user_id").agg(F.count("*").alias("nodes"))


@query("SELECT event_id, true AS same FROM events")
def literal_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips of event properties through literal tables."""
    props = F.col("props")
    same = json_utils.deep_equal_column(literals.decompress_column(literals.compress_column(props)), props)
    return table(spark, sf_dir, "events").select("event_id", same.alias("same"))
