"""Shared helpers: the shared scratch folder, table input and byte-exact word handling."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.tokens import release

#: The white space of the contracts, [\x20\x09-\x0D], as a Java/RE2 character class body.
SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "docloom-shared")


class Scratch:
    """Tables of one operator run under the shared folder.

    Writing a table there cuts the lineage at a committed output, so a lost executor costs
    the tasks it ran and nothing before the table. What is not dropped before is deleted when
    the driver ends, as results may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"
        system, path = self._store(self.root)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _store(self, name: str):
        """Hadoop's file system of a path, so any shared store works, and the path."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None, **options: str) -> DataFrame:
        writer = df.write.options(**options) if options else df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a consumed table."""
        system, path = self._store(self.path(name))
        system.delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows an Arrow batch for the tables saved inside: texts are long, and both sides of
    the exchange hold a batch of each task. The session's setting is restored."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_one_task(rows: DataFrame, make: Callable[[pa.Table], bytes], *order: Column | str) -> bytes:
    """``make`` of all the rows, in that order, in one executor task; for samples of proven size."""
    kinds = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            made = make(pa.Table.from_batches(held).select(kinds))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["made"])
        release()

    one = rows.repartition(1)
    found = (one.sortWithinPartitions(*order) if order else one).mapInArrow(run, "made binary").first()
    return make(pa.table({c: [] for c in kinds})) if found is None else bytes(found["made"])


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; empty for null or blank texts."""
    return F.filter(F.split(text_or_empty(text), f"[{SPACE}]+"), lambda w: w != "")


def in_fold(doc_id: Column, folds: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is zero; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


#: Bits of one bitmap of Spark's bitmap functions, and bitmaps of a filter: 32 MB at most.
BITMAP_BITS, MOST_BITMAPS = 32768, 8192


def filter_bit(*keys: Column | str) -> Column:
    """A key's bit in its bitmap."""
    return F.pmod(F.shiftright(F.xxhash64(*keys), 24), F.lit(BITMAP_BITS))


def filter_bucket(buckets: int, *keys: Column | str) -> Column:
    """The bitmap that a key belongs to."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bit_is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))


class MemberFilter:
    """Tells rows whose key is surely not among some members, without a shuffle of the rows.

    The members' hashes set bits of bitmaps that are broadcast; their size is bounded, so a
    large member set makes the filter let more rows pass and never a wrong one stay back.
    """

    def __init__(self, members: DataFrame, scratch: Scratch, name: str):
        self.buckets = min(MOST_BITMAPS, members.count() * 16 // BITMAP_BITS + 1)
        own = members.groupBy(filter_bucket(self.buckets, *members.columns).alias("__bucket")).agg(F.bitmap_construct_agg(filter_bit(*members.columns)).alias("__bits"))
        self.table = scratch.save(own, name)

    def split(self, rows: DataFrame, *keys: Column | str) -> tuple[DataFrame, DataFrame]:
        """(rows that may be members, rows that are not)."""
        flagged = rows.withColumn("__bucket", filter_bucket(self.buckets, *keys)).join(F.broadcast(self.table), "__bucket", "left")
        may = bit_is_set(F.col("__bits"), filter_bit(*keys))
        return flagged.filter(may).select(rows.columns), flagged.filter(~may).select(rows.columns)
