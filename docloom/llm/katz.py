"""Katz backoff language model of any order: training and scoring over partitioned tables.

Every level is Good-Turing discounted; a history's backoff weight is its left-over mass over
the lower level's mass of the words not seen after it, so each history's distribution sums to
one over the vocabulary and the unknown word. Tokens are evaluated by the recursion

    p(w | h) = d(c(h w)) c(h w) / c(h)  if c(h w) > 0, else  alpha(h) p(w | h without its oldest word),

with alpha one for histories that training has not seen, down to the unigrams. Histories do
not reach beyond a text's start, which counts as one word.

Texts are read once, in blocks of some megabytes. What travels is per block and not per
token. A block asks the partitions of the vocabulary for its distinct words and gets their
counts and numbers. Then, level by level, it sends its distinct n-grams of seen histories,
with their training counts, to the partitions of the histories. There counts merge, and the
block gets its n-grams' counts and, where a word was not seen after a history, what that
history's backoff weight takes. A block's tokens are evaluated where the block lies.

Partitions are as many as keep each to about ``GROUP`` n-grams, so rows and groups are of
bounded size at every input. Histories above a fixed share of all tokens (so their number is
bounded by the partitions') are spread over all partitions by word, and their sums are merged
first. All tables lie in the shared folder.

Words are identified by 64-bit hashes, n-grams of a partition and histories of three words and
more too. Defined cases: a
null or blank text is the end token alone; a very long text is a block of its own; null ids are
trained on and returned; repeated rows count each; without training rows every token is the
unknown word, with probability one. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, shuffle_width, small_batches
from docloom.llm.tokens import gathered, releasing, word_codes

BLOCK_BYTES = 4 << 20
#: N-grams of a partition, about.
GROUP = 1 << 20
#: Good-Turing applies to counts up to this.
GT_MOST = 5
END = xxhash.xxh64_intdigest(b" end")  # holds a space, so it is no word's hash input
BOS, UNKNOWN = -2, -1


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as compressed byte planes."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and len(a):
            low, high = int(a.min()), int(a.max())
            a = a.astype(next(t for t in (np.uint8, np.int8, np.uint16, np.int16, np.uint32, np.int32, np.int64, np.uint64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
        head = f"{a.dtype.str},{len(a)};".encode()
        parts.append(head + a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    heads = "|".join(str(len(p)) for p in parts).encode()
    return zstandard.ZstdCompressor(level=1).compress(heads + b"\n" + b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    heads, _, rest = raw.partition(b"\n")
    out, at = [], 0
    for size in map(int, heads.split(b"|")):
        part = rest[at : at + size]
        at += size
        kind, _, body = part.partition(b";")
        name, n = kind.decode().split(",")
        own = np.dtype(name)
        planes = np.frombuffer(body, np.uint8).reshape(own.itemsize, int(n))
        a = np.ascontiguousarray(planes.T).view(own).ravel()
        out.append(a.astype(np.int64) if own.kind in "iu" and own != np.uint64 else a)
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which compress; ``np.cumsum`` restores them."""
    return np.diff(ascending, prepend=0)


def discounts(n_r: list[int], most: int = GT_MOST) -> np.ndarray:
    """Katz's factors d_1.. for counts up to k, from n_1..n_{most+1}.

    k is the largest up to ``most`` whose factors all lie in (0, 1); where there is none,
    half a count is taken from the smallest counts, which keeps left-over mass.
    """
    for k in range(most, 0, -1):
        n = np.array([0, *n_r[: k + 1]], float)
        if (n[1:] <= 0).any():
            continue
        cut = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        star = (r + 1) * n[2:] / n[1:-1]
        if cut < 1:
            d = (star / r - cut) / (1 - cut)
            if ((d > 0) & (d < 1)).all():
                return d
    return 1 - 0.5 / np.arange(1, most + 1)


class Unigrams:
    """Discounted unigram probabilities from corpus totals."""

    def __init__(self, tokens: int, types: int, n_r: list[int]):
        self.tokens, self.types = tokens, types
        self.d = discounts(n_r)
        left = sum((1 - d) * r * n for r, d, n in zip(range(1, len(self.d) + 1), self.d, n_r, strict=False))
        self.scale = 1.0
        if tokens and not left:  # no rare word to take mass from: one more token, for the unknown
            left, self.scale = tokens / (tokens + 1), tokens / (tokens + 1)
        self.unknown = left / tokens if tokens else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        """Probability of words by training count; zero counts share the unknown event's."""
        factor = np.concatenate([[0.0], self.d])[np.where(count <= len(self.d), count, 0)]
        known = np.where(count > len(self.d), 1.0, factor) * count * self.scale / max(1, self.tokens)
        return np.where(count > 0, known, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


_ROW = "kind int, key long, block long, data binary, ids binary, stats array<double>"
_COLUMNS = ["kind", "key", "block", "data", "ids", "stats"]
#: Kinds of rows; answers of level k have the kind ANSWER + k.
TOKENS, ASK, WORDS, TOTALS, HOT, ANSWER = range(6)


def _stable(numbers: np.ndarray, below: int) -> np.ndarray:
    """The order of small numbers; numpy sorts those of 16 bits by radix."""
    return np.argsort(numbers.astype(np.uint16 if below < 1 << 16 else np.int64), kind="stable")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _COLUMNS)


def _ids_out(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _ids_in(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(bytes(data)).read_all().column(0).combine_chunks()


def blocks(docs: DataFrame, width: int, folds: int) -> DataFrame:
    """Token blocks, and each block's distinct words by vocabulary partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for part in gathered(batches, 1, BLOCK_BYTES):
            codes, counts, distinct = word_codes(part.column(1), lower=True)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()] + [END], np.uint64)
            ends = np.cumsum(counts)
            tokens = np.insert(codes, ends, len(distinct))
            home = (hashes % np.uint64(width)).astype(np.int64)
            # A word's number in its block is its rank in its partition, by count, times the
            # number of partitions, plus the partition: frequent words get small numbers.
            order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
            order = order[_stable(home[order], width)]
            cuts = np.searchsorted(home[order], np.arange(width + 1))
            place = np.empty(len(order), np.int64)
            place[order] = (np.arange(len(order)) - cuts[home[order]]) * width + home[order]
            ids = part.column(0)
            held = np.array([i is not None and zlib.crc32(str(i).encode()) % folds == 0 for i in ids.to_pylist()], bool)
            trained = np.bincount(tokens[np.repeat(~held, counts + 1)], minlength=len(hashes))[order]
            rows = [(TOKENS, -1, block, pack(place[tokens], counts + 1, held.astype(np.uint8)), _ids_out(ids), [float((~held).sum())])]
            hashes = hashes[order]
            for p in np.unique(home).tolist():
                a, b = cuts[p], cuts[p + 1]
                rows.append((ASK, p, block, pack(hashes[a:b], trained[a:b]), None, None))
            yield _table(rows)
            block += 1

    narrow = docs.select(F.col("doc_id"), F.col("text"))
    return narrow.mapInArrow(run, _ROW)


def _count_words(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = int(rows["key"].iloc[0])
        asked = [unpack(d) for d in rows["data"]]
        hashes = np.concatenate([a[0].astype(np.uint64) for a in asked])
        distinct, inverse = np.unique(hashes, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([a[1] for a in asked]), len(distinct)).astype(np.int64)
        order = np.argsort(-count, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order)) * width + p
        number[count == 0] = UNKNOWN
        out, at = [], 0
        for block, a in zip(rows["block"], asked, strict=True):
            own = inverse[at : at + len(a[0])]
            at += len(a[0])
            out.append((ANSWER + 1, p, int(block), pack(number[own], count[own]), None, None))
        seen = order[count[order] > 0]
        out.append((WORDS, p, -1, pack(distinct[seen], count[seen]), None, None))
        n_r = [int((count == r).sum()) for r in range(1, GT_MOST + 2)]
        out.append((TOTALS, p, -1, None, None, [float(count.sum()), float((count > 0).sum()), *map(float, n_r)]))
        return pd.DataFrame(out, columns=_COLUMNS)

    return releasing(run)


@dataclass
class Level:
    """What is known of a level when blocks are read: discounts, and merged sums of hot histories
    (history → smallest follower's count, n_1.., lower mass)."""

    d: np.ndarray
    hot: dict[int, list[float]]


def taken(d: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Mass, in counts, that discounting takes from followers seen 1, 2, .. times."""
    return (rare[:, : len(d)] * np.arange(1, len(d) + 1) * (1 - d)).sum(axis=1)


def discounted(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Counts after discounting."""
    return np.where(count <= len(d), np.concatenate([[0.0], d])[np.minimum(count, len(d))], 1.0) * count


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit mix of two numbers, as unsigned."""
    x = (a.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15) + (b.astype(np.uint64) if isinstance(b, np.ndarray) else np.uint64(b))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Block:
    """A block's tokens and, level by level, its distinct n-grams with their training counts.

    Per token: ``gram`` (its n-gram of the last level, -1 where the history is unseen) and
    ``p``. Per n-gram of the last level: ``count`` and ``key``, its number as a history.
    """

    def __init__(self, tokens: pd.DataFrame, answers: pd.DataFrame, uni: Unigrams, width: int, texts: int):
        self.stream, self.sizes, self.held = unpack(tokens["data"].iloc[0])
        n = int(self.stream.max()) + 1
        number, count = np.full(n + 1, UNKNOWN), np.zeros(n + 1, np.int64)
        for p, data in zip(answers["key"], answers["data"], strict=True):
            numbers, counts = unpack(data)
            at = np.arange(len(numbers)) * width + p
            number[at], count[at] = numbers, counts
        self.uni, self.number = uni, number
        self.word = np.where(count[self.stream] > 0, self.stream, n)  # unknown words are one event
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.zeros(len(self.stream), bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.c1 = count[self.stream]
        self.order = 1
        # The last entry is the start of a text, a history of its own.
        self.gram, self.count, self.key = self.word, np.append(count, texts), np.append(number, BOS)
        self.p, self.bottom = uni.p(self.c1), np.ones(len(self.stream))

    def ask(self, partitions: int, hot_count: float, sending: bool = True) -> None:
        """The distinct n-grams of the next level, in the order in which partitions get them.

        What only messages hold is left out where answers are there already.
        """
        self.order += 1
        before = np.concatenate([[-1], self.gram[:-1]])
        before[self.first] = len(self.count) - 1 if self.order == 2 else -1
        seen = before >= 0
        seen[seen] = self.count[before[seen]] > 0
        self.at = np.flatnonzero(seen)
        pairs, inverse = np.unique(before[self.at] * len(self.number) + self.word[self.at], return_inverse=True)
        h, w = np.divmod(pairs, len(self.number))
        key, word, total = self.key[h], self.number[w], self.count[h]
        hot = total > hot_count
        home = np.where(hot, mixed(mixed(key, 1), word), mixed(key, 1)) % np.uint64(partitions)
        # By partition, then by history's key: histories are sorted, and their n-grams follow them.
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        by_key = np.argsort(key[begin])
        runs = np.diff(np.append(begin, len(h)))[by_key]
        turn = np.repeat(begin[by_key] - (np.cumsum(runs) - runs), runs) + np.arange(len(h))
        turn = turn[_stable(home[turn], partitions)]
        place = np.empty(len(turn), np.int64)
        place[turn] = np.arange(len(turn))
        self.slot = place[inverse]  # of every asked token
        self.home, self.history, self.follower, self.hot = home[turn].astype(np.int64), key[turn], word[turn], hot[turn]
        self.total = total[turn]
        if sending:
            # The suffix of an n-gram is the lower n-gram that ends at the same token.
            own = self.gram[self.at]
            self.suffix = np.zeros(len(pairs), np.int64)
            self.suffix[self.slot] = np.where(own >= 0, self.count[own], 0) if self.order > 2 else self.c1[self.at]
            self.new = np.bincount(self.slot[self.held[self.doc[self.at]] == 0], minlength=len(pairs))
        elif self.order == 2:
            self.next_key = (self.history + 2 << 32) + self.follower + 2
        else:
            self.next_key = mixed(self.history, self.follower).view(np.int64)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        if not len(self.home):
            return
        cuts = np.flatnonzero(np.r_[True, self.home[1:] != self.home[:-1]])
        for a, b in zip(cuts, np.append(cuts[1:], len(self.home)), strict=True):
            change = np.flatnonzero(np.r_[True, self.history[a + 1 : b] != self.history[a : b - 1]])
            runs = np.diff(np.append(change, b - a))
            yield int(self.home[a]), pack(steps(self.history[a:b][change]), runs, self.hot[a:b][change].astype(np.uint8), self.follower[a:b], self.new[a:b], self.suffix[a:b])

    def learn(self, answers: pd.DataFrame, level: Level) -> None:
        """Take the partitions' answers and evaluate the tokens at this level."""
        n, d = len(self.home), level.d
        count = np.zeros(n, np.int64)
        starts = np.r_[True, (self.history[1:] != self.history[:-1]) | (self.home[1:] != self.home[:-1])][:n]
        change, which = np.flatnonzero(starts), np.cumsum(starts) - 1
        least, left, lower = np.zeros(len(change), np.int64), np.zeros(len(change)), np.zeros(len(change))
        for home, data in zip(answers["key"], answers["data"], strict=True):
            counts, low, needed, rare, mass = unpack(data)
            a = np.searchsorted(self.home, home)
            first = np.searchsorted(change, a)
            count[a : a + len(counts)] = counts
            least[first : first + len(low)] = low
            at = first + np.cumsum(needed)
            left[at] = taken(d, rare.reshape(-1, GT_MOST))
            lower[at] = mass
        names = self.history[change]
        for k in np.flatnonzero(self.hot[change]).tolist():
            own = level.hot.get(int(names[k]))
            if own:
                least[k], left[k], lower[k] = own[0], taken(d, np.array([own[1:-1]]))[0], own[-1]
        # A history whose followers are all frequent has no left-over mass; one more count is
        # added to its total for the words not seen, and the distribution still sums to one.
        none = least > len(d)
        bottom = self.total + none[which].astype(float)
        rest = np.where(none, 1.0, left)[which]
        slot, at = self.slot, self.at
        below, gained = self.bottom[at], count[slot]
        alpha = rest[slot] / bottom[slot] / np.maximum(1 - lower[which][slot] / below, 1e-300)
        self.p[at] = np.where(gained > 0, discounted(d, gained) / bottom[slot], alpha * self.p[at])
        self.bottom = np.ones(len(self.stream))
        self.bottom[at] = bottom[slot]
        self.gram = np.full(len(self.stream), -1)
        self.gram[at] = slot
        self.count, self.key = count, self.next_key


def _opened(tokens: pd.DataFrame, answers: pd.DataFrame, uni: Unigrams, width: int, texts: int, levels: list[Level], partitions: int, hot_count: float) -> Block:
    block = Block(tokens, answers[answers["kind"] == ANSWER + 1], uni, width, texts)
    for k, level in enumerate(levels, 2):
        block.ask(partitions, hot_count, False)
        block.learn(answers[answers["kind"] == ANSWER + k], level)
    return block


def _asking(*context):
    """Each block's n-grams of the next level, by partition."""
    *_, partitions, hot_count = context

    def run(tokens: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = _opened(tokens, answers, *context)
        block.ask(partitions, hot_count)
        at = int(tokens["block"].iloc[0])
        return pd.DataFrame([(ASK, home, at, data, None, None) for home, data in block.messages()], columns=_COLUMNS)

    return releasing(run)


def _merging(order: int, lower_mass):
    """One partition's counts: answers to its blocks, n_r, and partial sums of hot histories."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = int(rows["key"].iloc[0])
        got = [unpack(d) for d in rows["data"]]
        history = np.concatenate([np.repeat(np.cumsum(g[0]), g[1]) for g in got])
        word, trained, suffix = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
        hot = np.concatenate([np.repeat(g[2], g[1]) for g in got])
        gram = mixed(history, word)
        turn = np.argsort(gram)
        edge = np.r_[True, gram[turn][1:] != gram[turn][:-1]]
        index = np.empty(len(turn), np.int64)
        index[turn] = np.cumsum(edge) - 1
        lead = turn[edge]
        count = np.bincount(index, trained, len(lead)).astype(np.int64)
        mass = np.where(count > 0, lower_mass(suffix[lead]), 0.0)
        names, where = np.unique(history[lead], return_inverse=True)
        rare = np.stack([np.bincount(where[count == r], minlength=len(names)) for r in range(1, GT_MOST + 1)], axis=1)
        sums = np.bincount(where, mass, len(names))
        least = np.append(rare > 0, np.ones((len(names), 1), bool), axis=1).argmax(axis=1) + 1
        out, at = [], 0
        for block, g in zip(rows["block"], got, strict=True):
            own = index[at : at + len(g[3])]
            at += len(g[3])
            runs = g[1]
            mine = where[own[np.cumsum(runs) - runs]]
            needed = np.flatnonzero(np.bincount(np.repeat(np.arange(len(runs)), runs), count[own] == 0, len(runs)) > 0)
            out.append((ANSWER + order, key, int(block), pack(count[own], least[mine], steps(needed), rare[mine[needed]].ravel(), sums[mine[needed]]), None, None))
        out.append((TOTALS, key, -1, None, None, [float((count == r).sum()) for r in range(1, GT_MOST + 2)]))
        for h in np.unique(where[hot[lead] == 1]).tolist():
            out.append((HOT, int(names[h]), -1, None, None, [float(least[h]), *map(float, rare[h]), float(sums[h])]))
        return pd.DataFrame(out, columns=_COLUMNS)

    return releasing(run)


def _finishing(tokens_in_all: int, *context):
    def run(tokens: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = _opened(tokens, answers, *context)
        n = len(block.sizes)
        total = lambda values: np.bincount(block.doc, values, n)
        ids = _ids_in(tokens["ids"].iloc[0]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
        known = total(block.c1 > 0).astype(np.int64)
        return pd.DataFrame({"doc_id": ids, "held_out": block.held == 1, "n_tokens": block.sizes, "n_known": known, "train_tokens": tokens_in_all, "base_score": total(block.uni.base(block.c1)), "score": total(np.log10(block.p))})

    return releasing(run)


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished stages now, not when memory runs short."""
    import gc

    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def score(docs: DataFrame, folds: int = 10, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents outside fold zero and score all of them.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    width = max(1, shuffle_width(spark))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    with small_batches(spark):
        first = scratch.save(blocks(narrow, width, folds), "blocks", "kind")
    if first.isEmpty():
        return spark.createDataFrame([], result)

    columns = [F.col(c) for c in _COLUMNS]
    words = scratch.save(first.filter(F.col("kind") == ASK).select(columns).groupBy("key").applyInPandas(_count_words(width), _ROW), "level_1", "kind")
    scratch.drop(f"blocks/kind={ASK}")
    tokens, types, *n_r = (int(x) for x in _summed(words))
    uni = Unigrams(tokens, types, n_r)
    streams = first.filter(F.col("kind") == TOKENS).select(columns)
    texts = int(_summed(first.filter(F.col("kind") == TOKENS))[0])
    answers = words.filter(F.col("kind") == ANSWER + 1).select(columns)
    partitions, hot_count = max(width, -(-tokens // GROUP)), tokens / (4 * width)
    levels: list[Level] = []

    def by_block(run, schema: str) -> DataFrame:
        return streams.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)

    for k in range(2, order + 1):
        _release(docs)
        asked = by_block(_asking(uni, width, texts, levels, partitions, hot_count), _ROW)
        below = uni.p if k == 2 else functools.partial(discounted, levels[-1].d)
        merged = scratch.save(asked.groupBy("key").applyInPandas(_merging(k, below), _ROW), f"level_{k}", "kind")
        # Of each hot history the smallest count of a follower is a minimum, the rest are sums.
        parts = merged.filter(F.col("kind") == HOT).select(F.col("key").alias("history"), F.posexplode("stats").alias("at", "x"))
        whole = parts.groupBy("history", "at").agg(F.when(F.col("at") == 0, F.min("x")).otherwise(F.sum("x")).alias("x"))
        hot = whole.groupBy("history").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s")).collect()
        levels = [*levels, Level(discounts([int(x) for x in _summed(merged) or [0] * (GT_MOST + 1)]), {r["history"]: [x["x"] for x in r["s"]] for r in hot})]
        answers = answers.unionByName(merged.filter(F.col("kind") == ANSWER + k).select(columns))
    _release(docs)
    return by_block(_finishing(tokens, uni, width, texts, levels, partitions, hot_count), result)


def _summed(rows: DataFrame) -> list[float]:
    """The ``stats`` of the rows of totals, summed by place."""
    own = rows.filter("stats IS NOT NULL").filter(F.col("kind") != HOT).select(F.posexplode("stats").alias("at", "x"))
    return [r["x"] for r in own.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()]
