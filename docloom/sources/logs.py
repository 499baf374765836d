"""Document logs as files: newline-delimited JSON in and out, CBOR sequences in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.crdt import UNDEFINED, Model
from docloom.operators.edit import history, restore, snapshot
from docloom.sources.codecs import cbor_encode, cbor_sequence, wrap_binary
from docloom.sources.patches import compact_decode, compact_encode


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One row a line: the text and its VARIANT; NULL for broken lines."""
    return spark.read.text(path).select(F.col("value").alias("text"), F.try_parse_json("value").alias("doc"))


def write_ndjson(df: DataFrame, text: str, path: str) -> None:
    df.select(F.col(text).alias("value")).write.text(path)


def read_cbor_sequences(spark: SparkSession, path: str) -> DataFrame:
    """One row a value (path, ord, text) of files of CBOR sequences, read by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, k, json.dumps(wrap_binary(v))) for k, v in enumerate(cbor_sequence(raw))], columns=["path", "ord", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, ord long, text string")


def history_components(patches: list[dict], metadata: dict | None = None, start: Model | None = None) -> list:
    """A log's parts: header, view, start as a snapshot, and the patches in their compact form."""
    own = sorted(patches, key=lambda p: (p["id"][1], p["id"][0]))
    model = restore(snapshot(start)) if start else Model()
    for p in own:
        model.apply_patch(p)
    view = model.view()
    return [{"metadata": metadata or {}}, None if view is UNDEFINED else view, snapshot(start) if start else None, *map(compact_encode, own)]


def encode_history(components: list, container: str = "ndjson") -> bytes:
    """Parts as lines of JSON or as a CBOR sequence."""
    if container == "seq.cbor":
        return b"".join(map(cbor_encode, components))
    return b"".join(json.dumps(c, separators=(",", ":"), ensure_ascii=False).encode() + b"\n" for c in components)


def decode_history(data: bytes, container: str = "ndjson") -> dict:
    """Metadata, view, start model, patches, and the model at the end of a log."""
    parts = cbor_sequence(data) if container == "seq.cbor" else [json.loads(line) for line in data.decode().split("\n") if line]
    header, view, start, *rows = parts
    patches = [compact_decode(r) for r in rows]
    model = restore(start) if start else history([])
    for p in patches:
        model.apply_patch(p)
    return {"metadata": header["metadata"], "view": view, "start": start and restore(start), "patches": patches, "end": model}
