"""Vectorised words of a batch of texts: white space is [\\x20\\x09-\\x0D], nothing else."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most_bytes`` of the column's text; a longer text is a part of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    at = 0
    total = np.cumsum(size)
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def gathered(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about ``most_bytes`` of the column's text, whatever batches they came in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, column, most_bytes):
            own = part.column(column)
            n = pc.sum(pc.binary_length(own)).as_py() or 0
            if held and size + n > most_bytes:
                yield _joined(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield _joined(held)
    held.clear()
    release()


def release() -> None:
    """Give freed memory back to the system: idle workers stay, and others share the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_CALLS = [0]


def releasing(run: Callable) -> Callable:
    """A function of one group or two that now and then releases memory when it is done."""

    def done() -> None:
        _CALLS[0] += 1
        if _CALLS[0] % 8 == 0:
            release()

    if run.__code__.co_argcount == 1:

        def one(group):
            try:
                return run(group)
            finally:
                done()

        return one

    def two(left, right):
        try:
            return run(left, right)
        finally:
            done()

    return two


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, number of words of each text, the distinct words)."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, ends = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    ends = ends - ends[0]
    real = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    counts = before[ends[1:]] - before[ends[:-1]]
    if not real.all():
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), counts, coded.dictionary
