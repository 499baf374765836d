"""Streams of operations folded as they arrive.

Last-writer-wins state is an aggregation, so duplicates, late and reordered operations
converge without a watermark; windows over event time use one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def lww_stream(ops: DataFrame, keys: list[str], value: str, time: str = "time", sid: str = "sid") -> DataFrame:
    """Running winners of every key, for ``complete`` or ``update`` output."""
    newest = F.struct(F.col(time), F.col(sid))
    return ops.groupBy(*keys).agg(F.max_by(F.col(value), newest).alias(value))


def tumbling(events: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts and sums per window and key, dropping events later than the watermark."""
    own = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return own.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what is there and return the last result table, which lies in the shared folder."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "docloom-shared")
    root = f"{shared.rstrip('/')}/docloom/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result")

    query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/result")
