"""JSON Pointer (RFC 6901) at plan time and as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_STEPS, MOST_CHARS = 256, 1024


def unescape_component(step: str) -> str:
    return step.replace("~1", "/").replace("~0", "~")


def escape_component(step: str) -> str:
    return step.replace("~", "~0").replace("/", "~1")


def parse_pointer(pointer: str) -> list[str]:
    if pointer and not pointer.startswith("/"):
        raise ValueError("POINTER_INVALID")
    return [unescape_component(s) for s in pointer.split("/")[1:]]


def format_pointer(path: list[str]) -> str:
    return "".join("/" + escape_component(s) for s in path)


# The same as Columns.


def unescape(step: Column) -> Column:
    return F.replace(F.replace(step, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def escape(step: Column) -> Column:
    return F.replace(F.replace(step, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def parse(pointer: Column) -> Column:
    """Array of steps; the empty pointer has none."""
    steps = F.transform(F.slice(F.split(pointer, "/", -1), 2, 1_000_000), unescape)
    return F.when(pointer == "", F.array().cast("array<string>")).otherwise(steps)


def parse_relaxed(pointer: Column) -> Column:
    """As ``parse``, for pointers without the leading slash too."""
    return parse(F.when((pointer == "") | F.startswith(pointer, F.lit("/")), pointer).otherwise(F.concat(F.lit("/"), pointer)))


def format(path: Column) -> Column:
    return F.concat_ws("", F.transform(path, lambda s: F.concat(F.lit("/"), escape(s))))


def is_root(path: Column) -> Column:
    return F.size(path) == 0


def is_child(parent: Column, child: Column) -> Column:
    """Whether the parent is a strict prefix of the child."""
    return (F.size(child) > F.size(parent)) & (F.slice(child, F.lit(1), F.size(parent)) == parent)


def is_path_equal(a: Column, b: Column) -> Column:
    return a == b


def parent(path: Column) -> Column:
    """The path without its last step; NULL for the root."""
    return F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.size(path) - 1))


def is_valid_index(step: Column) -> Column:
    return step.rlike(r"^(0|[1-9][0-9]*)$")


def is_integer(step: Column) -> Column:
    return step.rlike(r"^[0-9]+$")


def is_valid(pointer: Column) -> Column:
    return ((pointer == "") | F.startswith(pointer, F.lit("/"))) & (F.char_length(pointer) <= MOST_CHARS)


def is_valid_path(path: Column) -> Column:
    return F.size(path) <= MOST_STEPS


def get(doc: Column, pointer: str) -> Column:
    """The value of a VARIANT at a constant pointer; NULL where there is none, and for "-"."""
    for step in parse_pointer(pointer):
        quoted = step.replace("\\", "\\\\").replace("'", "\\'")
        key = F.try_variant_get(doc, f"$['{quoted}']", "variant")
        plain_index = step == "0" or step.isdigit() and step[0] != "0"
        doc = F.coalesce(F.try_variant_get(doc, f"$[{step}]", "variant"), key) if plain_index and len(step) < 10 else key
    return doc


def find(doc: Column, pointer: str) -> Column:
    """Reference (val, obj, key) at a constant pointer: the value, its container and the last step."""
    steps = parse_pointer(pointer)
    if not steps:
        return F.struct(doc.alias("val"), F.lit(None).cast("variant").alias("obj"), F.lit(None).cast("string").alias("key"))
    holder = get(doc, format_pointer(steps[:-1]))
    size = F.size(F.when(F.schema_of_variant(holder).startswith("ARRAY"), holder.cast("array<variant>")))
    key = F.when(F.lit(steps[-1] == "-") & (size >= 0), size.cast("string")).otherwise(F.lit(steps[-1]))
    return F.struct(get(holder, "/" + escape_component(steps[-1])).alias("val"), holder.alias("obj"), key.alias("key"))
