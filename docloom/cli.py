"""Command lines over standard input: pack, unpack, json-patch and json-pointer.

``python -m docloom.cli pack FORMAT`` and ``unpack FORMAT`` (cbor or msgpack) turn JSON into
bytes and back; ``json-patch PATCH`` and ``json-pointer POINTER`` take the document from
standard input. With ``--table IN OUT --column NAME`` the same runs over a Parquet table, one
result column ``result``, as a Spark job.
"""

from __future__ import annotations

import argparse
import json
import sys

from docloom.operators import patch
from docloom.sources import codecs

FORMATS = {"cbor": "cbor", "msgpack": "msgpack", "messagepack": "msgpack"}


def _format(name: str) -> str:
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    return FORMATS[name.lower()]


def _pretty(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def pack(text: str, form: str) -> bytes:
    write = {"cbor": codecs.cbor_encode, "msgpack": codecs.msgpack_encode}[_format(form)]
    return write(json.loads(text))


def unpack(data: bytes, form: str) -> str:
    read = {"cbor": codecs.cbor_decode, "msgpack": codecs.msgpack_decode}[_format(form)]
    return _pretty(read(data))


def json_patch(document: str, operations: str) -> str:
    doc = json.loads(document)
    for op in json.loads(operations):
        doc = patch.apply_op(doc, op)[0]
    return _pretty(doc)


def json_pointer(document: str, pointer: str) -> str:
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"not a pointer: {pointer}")
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]
    value = json.loads(document)
    for step in steps:
        if isinstance(value, list) and step.isdecimal() and int(step) < len(value):
            value = value[int(step)]
        elif isinstance(value, dict) and step in value:
            value = value[step]
        else:
            raise LookupError(f"nothing at {pointer}")
    return _pretty(value)


def run_table(command: str, argument: str, source: str, target: str, column: str) -> None:
    """The command over one column of a Parquet table."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from docloom.functions import pointer

    spark = SparkSession.builder.getOrCreate()
    own = F.col(column)
    result = {
        "pack": lambda: codecs.encode_column(own, _format(argument)),
        "unpack": lambda: codecs.decode_column(own, _format(argument)),
        "json-patch": lambda: patch.apply_patch_text(own, F.lit(argument)),
        "json-pointer": lambda: F.to_json(pointer.get(F.try_parse_json(own), argument)),
    }[command]()
    spark.read.parquet(source).withColumn("result", result).write.parquet(target)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docloom.cli")
    parser.add_argument("command", choices=["pack", "unpack", "json-patch", "json-pointer"])
    parser.add_argument("argument", help="format, patch or pointer")
    parser.add_argument("--table", nargs=2, metavar=("IN", "OUT"))
    parser.add_argument("--column", default="value")
    own = parser.parse_args(arguments)
    try:
        if own.table:
            run_table(own.command, own.argument, *own.table, own.column)
        elif own.command == "pack":
            sys.stdout.buffer.write(pack(sys.stdin.read(), own.argument))
        elif own.command == "unpack":
            print(unpack(sys.stdin.buffer.read(), own.argument))
        else:
            print((json_patch if own.command == "json-patch" else json_pointer)(sys.stdin.read(), own.argument))
    except (ValueError, LookupError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
