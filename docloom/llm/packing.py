"""Packing documents into sequences along a space-filling curve.

A document's tokens are hashed to signed buckets and projected to a few dimensions; the
quantised vector's Hilbert index is its place on the curve. Documents are range-partitioned
and sorted by that index, and each partition is packed by concatenating neighbours and
cutting at the sequence length, so only a partition's last tokens could need padding;
these are cut into powers of two, which need none.

Copies share a place on the curve; a hash of the id and the row breaks the tie, in the range
partitioning too, so a large group of copies spreads over partitions, also where ids are
equal or null. Token ids are computed once and written to the shared folder before the
range partitioning samples them.

Defined cases: a null or empty text is the end token alone; null ids and repeated rows are
packed like any row; a very long text is tokenised whole, in a slice of its own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, shuffle_width, small_batches
from docloom.llm.tokens import gathered, slices, word_codes

DIMS, BITS = 4, 12
#: Entries that one generation of a worker's memory holds.
REMEMBERED = 120_000
#: Text that is tokenised at once.
SLICE_BYTES = 4 << 20
#: Fixed value: ASCII marks that the pre-tokenizer splits from letters before them.
MARKS = ".,;:!?*&%$#|"
#: Fixed value: letters with one composed and one lower form each, up to U+017F but for U+0130.
PLAIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+$"

_WORKER: dict = {}


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if printable in Latin-1, else from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class ChunkTokenizer:
    """Token ids of whole texts by their white-space-delimited chunks.

    Valid for tokenizers that drop white space and never join over it, such as word-level
    BPE with word ends. A run of ``PLAIN`` letters with marks after it is two parts, as the
    pre-tokenizer splits it, and such letters go to the model directly; all else goes
    through the whole tokenizer as it stands, since its composed or lower form may end in a
    mark that joins the next ones. Each distinct part of a slice is encoded once, and
    frequent parts are remembered in two generations, so memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            if part.isalpha() and max(part) < "\u0180" and "\u0130" not in part:
                low = part.lower()
                own = [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))]
            else:
                own = self.tokenizer.encode(part, add_special_tokens=False).ids
            found = struct.pack(f"<{len(own)}I", *own)
        self.young[part] = found
        return found

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of the parts, and the number of ids of each."""
        young = self.young
        each = [young.get(p) or self._part(p) for p in parts.to_pylist()]
        return np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        codes, counts, distinct = word_codes(texts)
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        letters = pc.ascii_rtrim(distinct, characters=MARKS)
        split = pc.and_(pc.match_substring_regex(letters, PLAIN), pc.less(pc.binary_length(letters), pc.binary_length(distinct)))
        heads = pc.if_else(split, letters, distinct)
        heads = pc.if_else(pc.string_is_ascii(heads), pc.ascii_lower(heads), heads).dictionary_encode()
        at = np.asarray(pc.binary_length(letters)).astype(np.int64)
        split = np.asarray(split)
        tails = pa.array([w[-n:] for w, n in zip(distinct.filter(pa.array(split)).to_pylist(), (np.asarray(pc.binary_length(distinct)).astype(np.int64) - at)[split].tolist(), strict=True)], pa.string()).dictionary_encode()
        flat, sizes = self._parts(pa.concat_arrays([heads.dictionary, tails.dictionary]))
        first = np.cumsum(sizes) - sizes
        # Every distinct chunk as one or two parts, then every word as its chunk's parts.
        tail = np.full(len(distinct), -1)
        tail[split] = np.asarray(tails.indices) + len(heads.dictionary)
        parts = np.stack([np.asarray(heads.indices).astype(np.int64), tail], axis=1)[codes].ravel()
        real = parts >= 0
        reps = sizes[parts[real]]
        where = np.repeat(first[parts[real]] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        words = np.zeros(len(parts), np.int64)
        words[real] = reps
        ends = np.concatenate([[0], np.cumsum(words)])[2 * np.cumsum(counts)]
        return flat[where], np.diff(np.concatenate([[0], ends]))


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _WORKER:
        _WORKER[path] = ChunkTokenizer(path)
    return _WORKER[path]


def projection(vocabulary: int, dims: int = DIMS, buckets: int = 1 << 14) -> np.ndarray:
    """Each token's contribution: the signed hash of its id, projected to ``dims``."""
    ids = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sign = np.where((mixed >> np.uint64(63)) == 1, 1.0, -1.0)
    plane = np.random.default_rng(7).standard_normal((buckets, dims))
    return (plane[(mixed >> np.uint64(40)) % np.uint64(buckets)] * sign[:, None]).astype(np.float32)


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve index of integer points (n, dims), after Skilling's transform."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[:, n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def curve_place(ids: np.ndarray, counts: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Hilbert index of each document's normalised projected vector."""
    vectors = np.zeros((len(counts), plane.shape[1]))
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        vectors[some] = np.add.reduceat(plane[ids], starts, axis=0) / np.sqrt(counts[some])[:, None]
    top = (1 << BITS) - 1
    cells = np.clip((np.tanh(vectors / 4) + 1) / 2 * top, 0, top).astype(np.int64)
    return hilbert_index(cells, BITS)


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, place on the curve, tie breaker, and the little-endian 32-bit ids with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        if ("plane", path) not in _WORKER:
            _WORKER["plane", path] = projection(own.tokenizer.get_vocab_size())
        for part in gathered(batches, 1, SLICE_BYTES):
            ids, counts = own.ids(part.column(1))
            place = curve_place(ids, counts, _WORKER["plane", path])
            closed = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            offsets = np.concatenate([[0], np.cumsum(4 * (counts + 1))]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(closed)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(place), part.column(2), raw], ["doc_id", "place", "tie", "ids"])

    tie = F.xxhash64(F.col(id_col), F.monotonically_increasing_id())
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, place long, tie long, ids binary")


def cut_tail(n: int) -> list[int]:
    """Lengths of power-of-two sequences that hold n tokens without padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "pack")
    with small_batches(docs.sparkSession):
        rows = scratch.save(tokenised(docs, path, end_id, id_col, text_col), "tokens", compression="zstd")
    ranged = rows.repartitionByRange(shuffle_width(docs.sparkSession), "place", "tie").sortWithinPartitions("place", "tie", "doc_id", F.length("ids"))
    ranged = ranged.select("doc_id", "ids", F.spark_partition_id().alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ranged.mapInArrow(lambda batches: _packed(batches, length), out)


def _packed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Concatenate and cut one partition; the open sequence alone is held back."""
    sequence, filled = None, 0
    held: list[tuple] = []
    done: list[tuple] = []
    for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
        for doc, raw, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            sequence = part << 33 if sequence is None else sequence
            total, at = len(raw) // 4, 0
            while at < total:
                take = min(length - filled, total - at)
                held.append((doc, at, take, raw[4 * at : 4 * (at + take)], total, sequence, filled))
                at, filled = at + take, filled + take
                if filled == length:
                    done += held
                    held, filled, sequence = [], 0, sequence + 1
        if done:
            yield _pieces(done, batch.schema.field(0).type)
            kind, done = batch.schema.field(0).type, []
        else:
            kind = batch.schema.field(0).type
    if held:
        yield _pieces(_recut(held, filled, sequence), kind)


def _recut(held: list[tuple], filled: int, sequence: int) -> list[tuple]:
    """The last open sequence as sequences of powers of two."""
    ends = np.cumsum(cut_tail(filled)).tolist()
    out, k = [], 0
    for doc, start, take, raw, total, _, offset in held:
        at = 0
        while at < take:
            step = min(take - at, ends[k] - (offset + at))
            out.append((doc, start + at, step, raw[4 * at : 4 * (at + step)], total, sequence + k, offset + at - (ends[k - 1] if k else 0)))
            at += step
            k += offset + at == ends[k]
    return out


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def digest_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
