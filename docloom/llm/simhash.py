"""SimHash near-duplicate detection over a byte-position inverted index.

A fingerprint's eight bytes are its positional tokens. Two fingerprints within four bits
share at least four of them, and every four of eight positions contain one of twenty fixed
triples of positions (Turan's construction), so posting lists are kept per triple and its
three bytes. Within a list the shared positional bytes of each pair are tallied, pairs
below the guaranteed four are discarded and the rest verified by Hamming distance.

Lists are compared in blocks in bounded memory and emit a spanning set of the verified
links, not the pairs. Lists longer than a tile are cut into tiles whose pairs are dealt to
different tasks, so no list has to fit one task; an entry of a list of n then is one row for
each of its n / tile tiles. Equal fingerprints are one entry.
Connected components come from alternating large-star and small-star rounds on tables.

Defined cases: null and blank texts have fingerprint zero; documents with equal ids are
one node per row's fingerprint, and null ids are returned but never name a component
unless all its ids are null. Equal texts and repeated rows share a fingerprint; very long
texts are hashed whole, in stretches of bounded memory. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import MemberFilter, Scratch, small_batches

BYTES = 8
#: Rows of a posting list that one comparison holds on each side.
TILE = 65536


def position_triples() -> list[tuple[int, int, int]]:
    """Triples such that any four of the eight positions contain one."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(t: tuple[int, int, int]) -> bool:
        count = [sum(part[i] == g for i in t) for g in range(3)]
        return 3 in count or any(count[g] == 2 and count[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the ASCII-lowered word shingles, repeats included."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z fold, only \x20\x09-\x0D split
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    width = min(shingle, len(tokens))
    n = len(tokens) - width + 1
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for lo in range(0, n, 65536):
        hi = min(n, lo + 65536)
        spans = zip((ends - sizes)[lo:hi].tolist(), ends[lo + width - 1 : hi + width - 1].tolist(), strict=True)
        h = np.array([hashed(joined[a:b], seed) for a, b in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long")


def _links(left: np.ndarray, right: np.ndarray, bits: int, same: bool) -> list[tuple[int, int]]:
    """A spanning set of the links between two blocks of distinct fingerprints."""
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    li, ri = inverse[: len(left)], inverse[len(left) :]
    for k, value in enumerate(left):
        differ = right[k + 1 :] ^ value if same else right ^ value
        if not len(differ):
            continue
        shift = k + 1 if same else 0
        shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        near = np.flatnonzero(shared >= BYTES - bits)
        near = near[np.bitwise_count(differ[near]) <= bits] + shift
        for j in near.tolist():
            a, b = root(li[k]), root(ri[j])
            if a != b:
                parent[a] = b
                out.append((int(value.view(np.int64)), int(right[j].view(np.int64))))
    return out


def links(fps: DataFrame, scratch: Scratch, bits: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints with the connectivity of all pairs within ``bits``."""
    if not 0 <= bits <= 4:
        raise ValueError("the triples guarantee pairs of up to four differing bits")
    triples = position_triples()

    def key(k: int, t: tuple[int, int, int]):
        parts = [F.shiftright("fp", 8 * i).bitwiseAND(F.lit(255)) for i in t]
        return F.lit(k << 24) + F.shiftleft(parts[0], 16) + F.shiftleft(parts[1], 8) + parts[2]

    posted = fps.select("fp", F.explode(F.array(*[key(k, t) for k, t in enumerate(triples)])).alias("key"))
    posted = scratch.save(posted, "postings")
    sizes = posted.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    tiles = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    sized = posted.join(sizes.withColumn("tiles", tiles).drop("size"), "key").withColumn("mine", mine)
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("lo"), F.greatest(o, F.col("mine")).alias("hi")))
    dealt = sized.withColumn("pair", F.explode(pairs)).select("key", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "mine", "fp")
    cells = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(lo: int, hi: int, mine: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        left = fp[mine == lo]
        return _links(left, left, bits, True) if lo == hi else _links(left, fp[mine == hi], bits, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            now = now if held is None else np.concatenate([held, now], axis=1)
            starts = np.flatnonzero(np.r_[True, (now[:3, 1:] != now[:3, :-1]).any(axis=0)]) if now.shape[1] else np.array([], int)
            found = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a > 1:
                    found += compare(now[1, a], now[2, a], now[3, a:b], now[4, a:b].view(np.uint64))
            held = now[:, starts[-1] :] if len(starts) else None
            yield _pairs(found)
        if held is not None and held.shape[1] > 1:
            yield _pairs(compare(held[1, 0], held[2, 0], held[3], held[4].copy().view(np.uint64)))

    return cells.mapInArrow(run, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0].copy()), pa.array(table[:, 1].copy())], ["a", "b"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of distinct edges (a, b < a) has one edge down and none up, or only edges up."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.filter((F.col("down") > 1) | (F.col("down") + F.col("up") > 1)).isEmpty()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 200) -> DataFrame:
    """(node, root) of every node of the edges; alternating large-star and small-star.

    Each half round is two aggregations by node, so a hub is partially aggregated in the
    tasks; tables cut the lineage. Ends when the edges are stars around their smallest node,
    which a round would not change; one aggregation tells, without a join of two rounds.
    """
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges_0")
    for k in range(1, rounds + 1):
        if _are_stars(edges):
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select("a", "b", "m")
        small = small.select("b", "m").filter("b != m").union(small_low.select("a", "m")).toDF("a", "b").distinct()
        after = scratch.save(small, f"edges_{k}")
        scratch.drop(f"edges_{k - 1}")
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest linked doc_id)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    with small_batches(docs.sparkSession):
        rows = scratch.save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = scratch.save(components(links(classes.select("fp"), scratch, bits), scratch), "roots")
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """The row with the smallest id of each component; rows with null ids stay."""
    scratch = Scratch(docs.sparkSession, "simhash")
    found = cluster(docs, id_col, text_col, shingle, bits)
    gone = scratch.save(found.filter("doc_id != component_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    may, stays = MemberFilter(gone, scratch, "gone_filter").split(docs, id_col)
    return stays.unionByName(may.join(gone, id_col, "left_anti").select(docs.columns))


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
