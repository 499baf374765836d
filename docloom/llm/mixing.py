"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every copy of a shuffled document has a virtual finish time: the words its source has sent
up to and including it, divided by the source's target. Copies are ordered by that time
over all sources and the order is cut where the total budget is reached.

No source is ever ordered in one task. The shuffle key is a hash, so its leading bits split
each source into even buckets; bucket sums are prefixed on a table of about the square root
of the rows, and rows are only ordered inside their bucket. The cut is found the same way
over buckets of virtual time, and reaches the rows as one row of numbers.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its
own, after all others; sources of size 0 have target 0. Documents with equal ids have equal
shuffle keys and are ordered by size. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, SPACE, text_or_empty

#: Bits of the shuffle key, the leading 15 hex digits of an MD5.
KEY_BITS = 60


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text_or_empty(text), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """Target words of each source: shares by weight, none above ``limit`` times its size.

    ``sizes`` has (source, source_size). What a limited source cannot take is shared among
    the others by weight, which is the level that fills the sources in the order of
    limit over weight; the level is found with running sums over the small table.
    """
    everywhere = Window.partitionBy(F.lit(0))
    by_name = everywhere.orderBy(F.col("source").isNull(), "source")
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.row_number().over(by_name) - 1) % len(weights)]
    ranked = sizes.withColumn("weight", weight).withColumn("most", limit * F.col("source_size"))
    fills = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everywhere) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    found = ranked.withColumn("level", level).withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    free = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everywhere)
    return found.withColumn("first", free).select(
        "source", "source_size", F.when(F.col("full") | F.col("first").isNull(), F.col("most")).otherwise(F.col("weight") * F.col("first.level")).alias("target")
    )


def _join_sources(rows: DataFrame, table: DataFrame, small: int = 10_000, key: str = "source", name: str = "source") -> DataFrame:
    """Rows with their source's entry; the table is broadcast only where it is counted small."""
    table = table.withColumnRenamed(name, "__other")
    table = F.broadcast(table) if table.limit(small + 1).count() <= small else table
    return rows.join(table, F.col(key).eqNullSafe(F.col("__other"))).drop("__other")


def _order(sent_round: Column) -> Column:
    """Position of a copy in the queue; total but for wholly equal rows."""
    finish = (F.col("source_size") * sent_round + F.col("sent")).cast("double") / F.col("target")
    return F.struct(
        finish.alias("finish"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("key"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.col("size"),
        sent_round.cast("int").alias("round"),
    )


def _cut(queued: DataFrame, budget: float, limit: int, buckets: int) -> Column | None:
    """Position of the first copy with which the queue exceeds the budget; None if none does."""
    copies = queued.withColumn("at", F.explode(F.array(*[_order(F.lit(r)) for r in range(limit)]))).select("at", "size")
    copies = copies.withColumn("bucket", F.least(F.floor(F.col("at.finish") * buckets), F.lit(4 * buckets)))
    sums = copies.groupBy("bucket").agg(F.sum("size").alias("words"))
    ends = sums.select("bucket", "words", F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy("bucket")).alias("end"))
    over = ends.filter(F.col("end") > budget).orderBy("bucket").first()
    if over is None:
        return None
    running = F.sum("size").over(Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    inside = copies.filter(F.col("bucket") == over["bucket"]).select("at", (running + (over["end"] - over["words"])).alias("end"))
    at = inside.filter(F.col("end") > budget).agg(F.min("at").alias("at")).first()["at"]
    return F.struct(*[F.lit(at[name]).cast(kind).alias(name) for name, kind in zip(at.__fields__, ("double", "boolean", "string", "long", "string", "long", "int"), strict=True)])


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    limit: int = 3,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken."""
    queued, taken = _queue(docs, weights, share, limit, id_col, source_col, text_col)
    copies = sum((F.when(t, 1).otherwise(0) for t in taken), F.lit(0)).cast("long")
    rows = queued.withColumn("copies", copies)
    return rows.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def shuffle_key(doc_id: Column) -> Column:
    """The document's place in its source's shuffled order."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _queue(docs: DataFrame, weights, share, limit, id_col, source_col, text_col) -> tuple[DataFrame, list[Column]]:
    """The queued documents, and for each round whether the mix takes their copy of it."""
    scratch = Scratch(docs.sparkSession, "mix")
    own = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    rows = scratch.save(docs.select(*own, shuffle_key(F.col(id_col)).alias("key")), "rows")
    sizes = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sizes")
    goals = scratch.save(targets(sizes, weights, share, limit), "targets")
    most, total, words = sizes.agg(F.max("n"), F.sum("n"), F.sum("source_size")).first()
    bits = math.ceil(math.log2(max(1, most or 0)) / 2)

    slot = F.shiftright("key", KEY_BITS - bits)
    sums = rows.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("words"))
    starts = sums.select("source", "slot", (F.sum("words").over(Window.partitionBy("source").orderBy("slot")) - F.col("words")).alias("start"))
    ticket = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("slot", slot).withColumn("inside", F.sum("size").over(ticket))
    starts = starts.withColumnsRenamed({"source": "_source", "slot": "_slot"})
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slot") == F.col("_slot")))
    placed = placed.withColumn("sent", F.col("start") + F.col("inside")).drop("_source", "_slot", "slot", "start", "inside")
    queued = scratch.save(_join_sources(placed, goals), "queued")

    cut = _cut(queued.filter("size > 0"), (words or 0) * share, limit, max(1, math.isqrt(limit * (total or 0))))
    some = F.col("size") > 0
    return queued, [some & (_order(F.lit(r)) < cut if cut is not None else F.lit(True)) for r in range(limit)]


def mixture(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    limit: int = 3,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it.

    A source sends its documents in the order of their keys, so what it has sent in a round
    when the queue is cut ends at one document. Those ends are a small table by source, and
    the documents are compared with them where they lie: texts are never moved.
    """
    queued, taken = _queue(docs, weights, share, limit, id_col, source_col, text_col)
    place = F.struct("key", F.col("doc_id").isNotNull().alias("named"), "doc_id", "size")
    ends = queued.groupBy("source").agg(*[F.max(F.when(t, place)).alias(f"__end_{r}") for r, t in enumerate(taken)])
    ends = Scratch(docs.sparkSession, "mix").save(ends, "ends")
    rows = docs.withColumn("__source", F.col(source_col)).withColumn("__key", shuffle_key(F.col(id_col)))
    rows = _join_sources(rows, ends.withColumnRenamed("source", "__name"), key="__source", name="__name")
    own = F.struct(F.col("__key").alias("key"), F.col(id_col).isNotNull().alias("named"), F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"))

    def sent(end: str) -> Column:  # words are counted only for documents at an end
        return F.when(F.col("__key") < F.col(f"{end}.key"), True).when(F.col("__key") == F.col(f"{end}.key"), own <= F.col(end)).otherwise(False)

    copies = sum((F.when(sent(f"__end_{r}"), 1).otherwise(0) for r in range(limit)), F.lit(0))
    has_word = text_or_empty(F.col(text_col)).rlike(f"[^{SPACE}]")
    again = rows.withColumn("__copies", copies).filter((F.col("__copies") > 0) & has_word)
    return again.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)
