"""Toxicity scores from a factorization machine over hashed terms.

A document's terms are its ASCII- and Unicode-lowered words without outer punctuation and
their five-letter stems, hashed to buckets; presence counts, frequency does not, so long
texts are not diluted. The machine adds to the linear weights a pairwise interaction of
term vectors, and so learns pairs that are toxic together and not apart.

Training uses a bounded sample of labelled documents of the training folds: those with the
smallest hash of their id, at most ``sample`` rows and ``most_terms`` terms in all. Every
term of the sample is in the model: none is screened out. Its linear value grows smoothly
with its own association with the label; its factors also take part by frequency alone, so
a pair of terms that tell nothing apart is learned, with less weight in texts of many
terms. Scoring reads every whole text. Only the text enters a score.

Defined cases: null and empty texts have no terms and get the bias's score; with no labels
or one class alone every score is the label share; equal texts get equal scores, repeated
rows too; very long texts are scored whole, in a batch of their own; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import MemberFilter, Scratch, in_fold, in_one_task, small_batches, text_or_empty
from docloom.llm.tokens import gathered, word_codes

BITS = 20
#: Bounds of the labelled sample: rows, and terms of all rows together.
SAMPLE, MOST_TERMS, FACTORS = 8000, 12_000_000, 8
DILUTE = 40
STEMS = (4, 5)
#: Fixed value: what is cut from both ends of a word.
EDGE = r"^[^\pL\pN]+|[^\pL\pN]+$"
#: Text that is scored at once, and terms that training turns at once; neither changes a result.
SLICE_BYTES, STRETCH = 1 << 20, 1 << 18


def word_terms(words: pa.Array) -> np.ndarray:
    """Hashed terms of each word, itself and its stems; -1 for words without a letter or digit."""
    bare = pc.replace_substring_regex(pc.utf8_lower(words), EDGE, "")
    out = np.empty((len(words), 1 + len(STEMS)), np.int64)
    for k, (mark, own) in enumerate([(b"w:", bare), *((f"s{n}:".encode(), pc.utf8_slice_codeunits(bare, 0, n)) for n in STEMS)]):
        coded, start = own.dictionary_encode(), zlib.crc32(mark)
        raw = coded.dictionary.cast(pa.binary()).to_pylist()
        hashed = np.fromiter((zlib.crc32(x, start) if x else -1 for x in raw), np.int64, len(raw))
        out[:, k] = np.where(hashed < 0, -1, hashed >> (32 - BITS))[np.asarray(coded.indices)]
    return out


def buckets(word: str) -> tuple[int, ...]:
    """Hashed terms of one word."""
    return tuple(t for t in word_terms(pa.array([word])).ravel().tolist() if t >= 0)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def expand(text: np.ndarray, codes: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every distinct term of the given words, by text."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = _distinct(text * len(distinct) + codes)
    terms = word_terms(distinct)[pairs % len(distinct)]
    pairs = ((pairs // len(distinct))[:, None] << BITS) + terms
    pairs = _distinct(pairs[terms >= 0])
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def term_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every distinct term of every text, by text."""
    codes, counts, distinct = word_codes(texts)
    return expand(np.repeat(np.arange(len(counts)), counts), codes, distinct)


def one_of_copies(lists: list[np.ndarray], labels: list) -> list[int]:
    """Positions of the first of the lists that have equal terms and equal labels.

    Copies would otherwise lend their text's chance words the weight of many documents.
    """
    seen: set[tuple[bytes, object]] = set()
    out = []
    for k, (own, label) in enumerate(zip(lists, labels, strict=True)):
        key = hashlib.blake2b(own.tobytes(), digest_size=16).digest(), label
        if key not in seen:
            seen.add(key)
            out.append(k)
    return out


@dataclass
class Machine:
    """A term's value in the linear part is ``own``; in the pairs, ``pair`` and, diluted by the
    text's number of terms, ``common``."""

    place: np.ndarray  # sorted buckets in use
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    pair: np.ndarray
    common: np.ndarray

    def raw(self, text: np.ndarray, column: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of texts with ``sizes`` terms, from their known terms."""
        n = len(sizes)
        score = self.bias + np.bincount(text, self.linear[column], n)
        value = self.pair[column] + self.common[column] * dilution(sizes)[text]
        for k in range(self.factors.shape[1]):
            v = self.factors[column, k] * value
            score += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return score

    def score(self, texts: pa.Array) -> np.ndarray:
        text, bucket = term_lists(texts)
        sizes = np.bincount(text, minlength=len(texts))
        if len(self.place):
            at = np.minimum(np.searchsorted(self.place, bucket), len(self.place) - 1)
            known = self.place[at] == bucket
            raw = self.raw(text[known], at[known], sizes)
        else:
            raw = np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def dilution(sizes: np.ndarray) -> np.ndarray:
    """Weight of pairs of common terms: near 1 in short texts, falling as pairs grow many."""
    return (DILUTE / (DILUTE + sizes)).astype(np.float32)


def evidence(text: np.ndarray, bucket: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood ratio of each bucket's presence between the classes, and its documents."""
    n, a = len(labels), int(labels.sum())
    b = n - a
    yes, df = np.zeros(1 << BITS), np.zeros(1 << BITS)
    mark = labels.astype(bool)
    for lo in range(0, len(text), STRETCH):
        own = bucket[lo : lo + STRETCH]
        df += np.bincount(own, minlength=1 << BITS)
        yes += np.bincount(own[mark[text[lo : lo + STRETCH]]], minlength=1 << BITS)
    place = np.flatnonzero(df)
    yes, no = yes[place], (df - yes)[place]
    p, q, both = (yes + 0.5) / (a + 1), (no + 0.5) / (b + 1), (yes + no + 1) / (n + 2)
    gain = np.zeros(1 << BITS)
    gain[place] = yes * np.log(p / both) + (a - yes) * np.log((1 - p) / (1 - both)) + no * np.log(q / both) + (b - no) * np.log((1 - q) / (1 - both))
    return np.maximum(gain, 0), df


def train(text: np.ndarray, bucket: np.ndarray, labels: np.ndarray, factors: int = FACTORS, visits: int = 90_000, batch: int = 256, rate: float = 0.1, ridge: float = 2e-4, weight: float = 3.0) -> Machine:
    """Fit on sparse rows by text with Adagrad over minibatches of rows; deterministic.

    Every term of the sample has a linear weight and factors. A term's values grow smoothly
    with its own association; in pairs also with its frequency alone. Toxic rows weigh more.
    """
    n = len(labels)
    share = float(labels.mean()) if n else 0.0
    if not 0 < share < 1:
        base = float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -10, 10))
        none = np.zeros(0, np.float32)
        return Machine(np.zeros(0, np.int64), base, none, np.zeros((0, factors), np.float32), none, none)
    gain, df = evidence(text, bucket, labels)
    place = np.flatnonzero(df)
    column = np.empty(len(bucket), np.int32)
    for lo in range(0, len(bucket), STRETCH):
        column[lo : lo + STRETCH] = np.searchsorted(place, bucket[lo : lo + STRETCH])
    gain, df = gain[place], df[place]
    sure = (gain / (gain + 8)) ** 2
    own, pair, common = (x.astype(np.float32) for x in (np.sqrt(gain) / 4 * sure, np.minimum(1, sure), 0.3 * df / (df + 20)))
    rng = np.random.default_rng(5)
    linear, factor = np.zeros(len(place), np.float32), rng.normal(0, 0.01, (len(place), factors)).astype(np.float32)
    past, past_factor = np.full(len(place), 1e-8, np.float32), np.full((len(place), factors), 1e-8, np.float32)
    bias, past_bias = float(np.log(share / (1 - share))), 1e-8
    starts = np.searchsorted(text, np.arange(n + 1))
    size = np.diff(starts)
    thin = dilution(size)
    for _ in range(int(np.clip(visits // n, 10, 60))):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            sizes = size[rows]
            where = np.repeat(starts[rows], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            local = np.repeat(np.arange(len(rows)), sizes)
            used, c = np.unique(column[where], return_inverse=True)
            w, v, m = linear[used], factor[used], len(rows)
            value = pair[used][c] + common[used][c] * thin[rows][local]
            part = v[c] * value[:, None]
            total = np.stack([np.bincount(local, part[:, k], m) for k in range(factors)], axis=1).astype(np.float32)
            raw = bias + np.bincount(local, (w * own[used])[c], m) + 0.5 * ((total**2).sum(axis=1) - np.bincount(local, (part**2).sum(axis=1), m))
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[rows]) * np.where(labels[rows] == 1, weight, 1.0) / m
            g = error[local].astype(np.float32)
            dw = np.bincount(c, g, len(used)) * own[used] + ridge * w
            dv = np.stack([np.bincount(c, g * value * (total[local, k] - part[:, k]), len(used)) for k in range(factors)], axis=1) + 4 * ridge * v
            past[used] += dw * dw
            past_factor[used] += dv * dv
            linear[used] = w - rate * dw / np.sqrt(past[used])
            factor[used] = v - rate * dv / np.sqrt(past_factor[used])
            d = float(error.sum())
            past_bias += d * d
            bias -= rate * d / past_bias**0.5
    return Machine(place, bias, linear * own, factor, pair, common)


def train_on(rows: pa.Table, most_terms: int = MOST_TERMS) -> Machine:
    """Fit on rows of (_id, label, terms): the first row of each id, up to ``most_terms`` terms in all."""
    lists, labels, seen, total = [], [], set(), 0
    for ident, label, raw in zip(*(rows.column(c) for c in ("_id", "label", "terms")), strict=True):
        if ident.as_py() in seen:
            continue
        own = np.frombuffer(raw.as_buffer(), "<i4")  # a view of the table
        total += len(own)
        if total > most_terms and lists:
            break
        seen.add(ident.as_py())
        lists.append(own)
        labels.append(int(label.as_py() == 1))
    single = one_of_copies(lists, labels)
    lists, labels = [lists[k] for k in single], [labels[k] for k in single]
    text = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    bucket = np.concatenate([np.zeros(0, np.int32), *lists])
    return train(text, bucket, np.array(labels, np.int64))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE, most_terms: int = MOST_TERMS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Train on labelled documents outside fold zero.

    The tasks hash the terms of the sample into a table, one task trains on it, and the
    model alone travels to the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    own = labels.select(F.col(id_col).alias("_id"), F.col("toxic").alias("label")).filter("_id is not null and label is not null")
    own = own.filter(~in_fold(F.col("_id"), folds))
    chosen = own.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, 1, SLICE_BYTES):
            text, bucket = term_lists(part.column(1))
            ends = np.searchsorted(text, np.arange(part.num_rows + 1))
            raw = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(raw, pa.binary())], ["_id", "label", "terms"])

    kind, label = (rows.schema[c].dataType.simpleString() for c in ("_id", "label"))
    with small_batches(spark):
        table = scratch.save(rows.select("_id", "text", "label").mapInArrow(run, f"_id {kind}, label {label}, terms binary"), "sample")
        made = in_one_task(table, lambda rows: pickle.dumps(train_on(rows, most_terms)), F.xxhash64("_id"), "_id", "terms")
    scratch.drop("sample")
    return pickle.loads(made)


def _scored(docs: DataFrame, model: Machine, text_col: str, carry: dict) -> DataFrame:
    """The ``carry`` columns (by name) and the score of every document."""
    narrow = docs.select(F.col(text_col).alias("__text"), *(c.alias(n) for n, c in carry.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, 0, SLICE_BYTES):
            score = pa.array(model.score(part.column(0)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], score], [*part.schema.names[1:], "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    return narrow.mapInArrow(run, f"{fields}, score double")


def score_table(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    with small_batches(docs.sparkSession):
        return scratch.save(_scored(docs, model, text_col, {"doc_id": F.col(id_col)}), "scores")


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns.

    A score depends on the text alone, so tasks keep the digests of toxic texts only, and
    rows leave by digest: those that a bounded filter rules out pass where they lie.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    digest = F.unhex(F.sha2(text_or_empty(F.col(text_col)).cast("binary"), 256))
    model = fit(docs, labels, text_col=text_col)
    with small_batches(docs.sparkSession):
        toxic = _scored(docs, model, text_col, {"__digest": digest}).filter(F.col("score") >= threshold)
        toxic = scratch.save(toxic.select("__digest").distinct(), "toxic")
    may, clean = MemberFilter(toxic, scratch, "filter").split(docs.withColumn("__digest", digest), "__digest")
    clean = clean.unionByName(may.join(toxic, "__digest", "left_anti"))
    return clean.select(docs.columns)
