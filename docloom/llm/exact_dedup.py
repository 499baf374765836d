"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Memtables (the rows of some neighbouring tasks) flush into sorted runs of digests, so their
number follows the input; every run carries a bitmap filter over hashed digests. Levels of
compaction merge a fixed number of neighbouring sorted runs into one until one is left:
entries that the filters of the *other* runs of the merge rule out pass untouched, the rest
merge in digest order, keeping the best identifier. Digests with several rows are verified
byte for byte; a digest shared by different texts is split by the texts themselves. A hot
digest enters a run as one entry.

Defined cases: a null text counts as empty; empty texts form one group. Ties on length go
to the smallest doc_id (null ids last), then to the earliest row of the ledger, so of
wholly equal rows exactly one stays. Very long texts are hashed whole where they lie. An
empty table gives an empty result. Extra columns are ignored by ``resolve`` and kept by
``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BITMAP_BITS, MemberFilter, Scratch, bit_is_set, filter_bit, filter_bucket, text_or_empty

#: Neighbouring tasks whose rows form one memtable, and runs that one merge takes.
MEMTABLE, FAN_IN = 8, 8


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(text_or_empty(text), " \t\n\x0b\x0c\r", "")


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(normal.cast("binary"), 256))


def flush_runs(ledger: DataFrame, scratch: Scratch) -> DataFrame:
    """Level 0: sorted digest runs with the best row and the number of rows of each digest."""
    best = F.min(F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    runs = ledger.groupBy("run", "digest").agg(best.alias("best"), F.count("*").alias("n"))
    return scratch.save(runs.sortWithinPartitions("run", "digest"), "level_0")


def run_filters(runs: DataFrame, buckets: int) -> DataFrame:
    """One bitmap filter per run and bucket."""
    return runs.groupBy("run", filter_bucket(buckets, "digest").alias("bucket")).agg(F.bitmap_construct_agg(filter_bit("digest")).alias("bits"))


def merge_level(runs: DataFrame, n_runs: int, fan_in: int, scratch: Scratch, name: str) -> DataFrame:
    """The next level: every ``fan_in`` neighbouring runs merged into one sorted run.

    An entry that the filters of the other runs of its merge rule out passes untouched. The
    others are merged in digest order (Spark aggregates such structs by sorting), keeping
    the best row. Filters are as large as their runs.
    """
    buckets = max(1, runs.count() // n_runs * 16 // BITMAP_BITS)
    target = F.floor(F.col("run") / fan_in).cast("int")
    others = F.sequence(target * fan_in, F.least(target * fan_in + fan_in, F.lit(n_runs)) - 1)
    seen = (
        run_filters(runs, buckets)
        .withColumn("of", F.explode(F.filter(others, lambda r: r != F.col("run"))))
        .groupBy(F.col("of").alias("run"), "bucket")
        .agg(F.bitmap_or_agg("bits").alias("bits"))
    )
    probed = runs.withColumn("bucket", filter_bucket(buckets, "digest")).join(seen, ["run", "bucket"], "left")
    probed = probed.select(target.alias("run"), "digest", "best", "n", bit_is_set(F.col("bits"), filter_bit("digest")).alias("shared"))
    probed = scratch.save(probed, f"{name}_probed")
    alone = probed.filter(~F.col("shared")).select("run", "digest", "best", "n")
    merged = probed.filter("shared").groupBy("run", "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    done = scratch.save(alone.unionByName(merged).sortWithinPartitions("run", "digest"), name)
    scratch.drop(f"{name}_probed")
    return done


def compact(runs: DataFrame, scratch: Scratch, fan_in: int) -> DataFrame:
    """Merge the runs level by level until one is left: digest, best row and group size."""
    n_runs, level = (runs.agg(F.max("run")).first()[0] or 0) + 1, 0
    while n_runs > 1:
        level += 1
        runs = merge_level(runs, n_runs, fan_in, scratch, f"level_{level}")
        scratch.drop(f"level_{level - 1}")
        n_runs = -(-n_runs // fan_in)
    return runs.select("digest", "best", "n")


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return texts.withColumn("normal", normalised(F.col("text"))).withColumn("digest", digest(F.col("normal")))


def _index(keyed: DataFrame, memtable: int, fan_in: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, MemberFilter, DataFrame | None]:
    """The ledger of all rows, the groups of several rows with their filter, and digests that texts share by chance."""
    ledger = scratch.save(
        keyed.select(
            "doc_id",
            "digest",
            F.char_length("text").cast("long").alias("n_points"),
            F.monotonically_increasing_id().alias("row"),
            F.floor(F.spark_partition_id() / memtable).cast("int").alias("run"),
        ),
        "ledger",
    )
    index = compact(flush_runs(ledger, scratch), scratch, fan_in)
    groups = index.filter("n > 1").select(
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.row").alias("keep_row"),
        (-F.col("best.neg")).alias("keep_points"),
        F.col("n").alias("group_size"),
    )
    groups = scratch.save(groups, "groups")
    hits = MemberFilter(groups.select("digest"), scratch, "hits")
    return ledger, groups, hits, verify(keyed, groups, hits, scratch)


def resolve(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    memtable: int = MEMTABLE,
    fan_in: int = FAN_IN,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest (binary), row.

    ``digest`` maps the normalised text to a binary key; weaker keys than SHA-256 stay
    exact because colliding texts are told apart by their bytes.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    keyed = _keyed(docs, id_col, text_col, digest)
    ledger, groups, _, collided = _index(keyed, memtable, fan_in, scratch)
    out = ledger.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "digest",
        "row",
    )
    if collided is not None:
        out = out.join(collided, "digest", "left_anti").unionByName(_by_text(keyed, collided, scratch))
    return out


def verify(keyed: DataFrame, groups: DataFrame, hits: MemberFilter, scratch: Scratch, salts: int = 16) -> DataFrame | None:
    """Byte verification of all hits: the digests whose rows differ, or None.

    Texts that the filter rules out are not moved. The others are matched under salted
    digests and compared within each salt first, so a large group of copies is neither read
    nor compared by one task.
    """
    salted = groups.select("digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    may, _ = hits.split(keyed, "digest")
    rows = may.select("digest", "normal", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    ends = rows.join(salted, ["digest", "salt"], "left_semi").groupBy("digest", "salt").agg(F.min("normal").alias("low"), F.max("normal").alias("high"))
    differ = ends.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select("digest")
    differ = scratch.save(differ, "collided")
    return None if differ.isEmpty() else differ


def _by_text(keyed: DataFrame, collided: DataFrame, scratch: Scratch) -> DataFrame:
    """Groups by the normalised text itself, for the rows under colliding digests."""
    rows = keyed.join(collided, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())
    rows = scratch.save(rows, "collided_rows")
    order = F.struct((-F.char_length("text")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = rows.groupBy("normal").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return rows.join(best, "normal").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest", "row"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable: int = MEMTABLE, fan_in: int = FAN_IN) -> DataFrame:
    """The kept rows of ``docs`` with all their columns.

    Rows of unique texts pass without a shuffle; of the others the row with the kept id and
    length stays, once even where such rows repeat.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    _, groups, hits, collided = _index(_keyed(docs, id_col, text_col, sha256), memtable, fan_in, scratch)
    if collided is not None:
        raise ValueError("different texts share a SHA-256 digest; use resolve(), which tells them apart")
    rows = docs.withColumn("__digest", sha256(normalised(F.col(text_col))))
    keys = groups.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("keep_points").alias("__points"))
    may, alone = hits.split(rows, "__digest")
    single = may.join(keys.select("__digest"), "__digest", "left_anti")
    stays = F.col(id_col).eqNullSafe(F.col("__keep")) & (F.char_length(text_or_empty(F.col(text_col))) == F.col("__points"))
    best = may.join(keys, "__digest").filter(stays).dropDuplicates(["__digest"])
    return alone.select(docs.columns).unionByName(single.select(docs.columns)).unionByName(best.select(docs.columns))
