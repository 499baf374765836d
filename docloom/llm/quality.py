"""Quality rules over labelled line sequences.

A linear-chain CRF marks every line of a text as content or boilerplate from the line's
shape; Viterbi decodes the whole sequence, and the share of words in content lines decides
whether the text stays. Base counts of words, symbols, repeated lines and repeated 8-word
windows are exact over the whole text.

The CRF is trained on a bounded sample of labelled documents (at most ``sample`` rows, those
with the smallest hash of their id, and ``most_lines`` lines). Labels are of documents, so
the lines' labels are latent: see ``train``. Without labels every line is content.

Defined cases: a null or blank text has no words and fails the base rule; lines without a
word are neither content nor boilerplate; equal rows get equal results; of rows that share a
labelled id one trains, the same in every run; very long texts are judged whole, in a batch
of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import crf
from docloom.llm.common import Scratch, in_one_task, small_batches
from docloom.llm.tokens import gathered, word_codes

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SIZE, WIDTH = 1 << 12, 14
#: Bounds of the labelled sample: documents, and lines of all documents together.
SAMPLE, MOST_LINES = 4000, 400_000

# Classes of bytes; a byte of 0x80 and above is a letter or part of one.
_CLASS = np.zeros((7, 256), np.int64)
_CLASS[0, [ord(c) for c in SYMBOLS]] = 1
_CLASS[1, ord("A") : ord("Z") + 1] = 1
_CLASS[2, ord("0") : ord("9") + 1] = 1
_CLASS[3, [ord(c) for c in ".,;:!?"]] = 1
_CLASS[4, [32, *range(9, 14)]] = 1
_CLASS[5, ord("!")] = 1
_CLASS[6, [b for b in range(256) if not 0x80 <= b < 0xC0]] = 1  # first bytes of code points


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Exact base counts of each text, and its lines' features and words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    codes, n_words, _ = word_codes(texts)
    space = _CLASS[4][data].astype(bool)
    starts_word = ~space & np.concatenate([[True], space[:-1]]) if len(data) else np.zeros(0, bool)
    if len(data):
        starts_word[offsets[:-1][offsets[:-1] < len(data)]] = ~space[offsets[:-1][offsets[:-1] < len(data)]]
    lo, hi = offsets[:-1], offsets[1:]
    out = {
        "n_words": n_words,
        "word_chars": _ranges(_CLASS[6][data] * ~space, lo, hi),
        "n_symbols": _ranges(_CLASS[0][data], lo, hi),
        "n_repeat_words": _repeated_words(codes, n_words),
    }
    # Lines: cut at every newline and at the ends of texts.
    breaks = np.flatnonzero(data == 10)
    text_of_break = np.searchsorted(hi, breaks, side="right")
    n_lines = np.bincount(text_of_break, minlength=n) + 1 if n else np.zeros(0, np.int64)
    line_text = np.repeat(np.arange(n), n_lines)
    first = np.cumsum(n_lines) - n_lines
    line_lo, line_hi = np.empty(len(line_text), np.int64), np.empty(len(line_text), np.int64)
    inner = np.ones(len(line_text), bool)
    inner[first] = False
    line_lo[first], line_lo[inner] = lo, breaks + 1
    last = np.ones(len(line_text), bool)
    last[first + n_lines - 1] = False
    line_hi[first + n_lines - 1], line_hi[last] = hi, breaks
    counts = {name: _ranges(_CLASS[k][data], line_lo, line_hi) for k, name in enumerate(("symbol", "upper", "digit", "stop", "space", "shout"))}
    words = _ranges(starts_word, line_lo, line_hi)
    raw = data.tobytes()
    repeats = np.zeros(len(line_text), bool)
    seen: set[bytes] = set()
    current = -1
    for k in np.flatnonzero(words).tolist():
        if line_text[k] != current:
            current, seen = line_text[k], set()
        line = raw[line_lo[k] : line_hi[k]]
        repeats[k] = line in seen
        seen.add(line)
    out["n_dup_lines"] = np.bincount(line_text[repeats], minlength=n) if n else np.zeros(0, np.int64)
    # Distinct words of each line, in the order of words.
    word_line = np.repeat(np.arange(len(words)), words)
    pairs = np.unique(word_line * (codes.max(initial=0) + 1) + codes) // (codes.max(initial=0) + 1) if len(codes) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs, minlength=len(words))
    live = words > 0
    out["line_text"], out["line_words"] = line_text[live], words[live]
    size = np.maximum(1, line_hi - line_lo)[live]
    grade = lambda part, whole, top=8: np.minimum(top, part[live] * top * 2 // np.maximum(1, whole))
    many = words[live]
    columns = [
        np.minimum(many, 1 << 20).astype(np.float64) + 1,
        grade(counts["symbol"], size),
        grade(counts["upper"], size),
        grade(counts["digit"], size),
        grade(counts["stop"], many),
        grade(counts["shout"], many),
        (10 * distinct[live]) // np.maximum(1, many),
        np.minimum(15, (size - counts["space"][live]) // np.maximum(1, many)),
        repeats[live].astype(np.int64),
        np.minimum(3, counts["symbol"][live] * 4 // np.maximum(1, many)),
    ]
    columns[0] = np.log2(columns[0]).astype(np.int64)
    rows = np.zeros((len(many), WIDTH), np.int32)
    for k, values in enumerate(columns):
        rows[:, k] = 1 + 64 * k + np.clip(values.astype(np.int64), 0, 63)
    rows[:, len(columns)] = 1 + 64 * len(columns) + np.minimum(7, columns[6]) * 8 + np.minimum(7, columns[0])
    rows[:, len(columns) + 1] = 1 + 64 * (len(columns) + 1)  # bias
    out["features"] = rows
    return out


def _repeated_words(codes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Words in windows that occur twice or more in their text."""
    n = len(n_words)
    if len(codes) < WINDOW:
        return np.zeros(n, np.int64)
    mixed = np.random.default_rng(3).integers(1, 1 << 63, int(codes.max()) + 1, dtype=np.uint64)[codes]
    text = np.repeat(np.arange(n), n_words)
    size = len(codes) - WINDOW + 1
    window = np.zeros(size, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + size]
        window ^= window >> np.uint64(31)
    inside = np.flatnonzero(text[:size] == text[WINDOW - 1 :])
    order = inside[np.lexsort((window[inside], text[inside]))]
    same = (window[order[1:]] == window[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, order[again], 1)
    np.add.at(edge, order[again] + WINDOW, -1)
    return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=n)


def fit(texts: list[str | None], good: list[int]) -> crf.Crf | None:
    """Train on labelled documents (1 good, 0 poor)."""
    found = measures(pa.array(texts, pa.large_string()))
    lengths = np.bincount(found["line_text"], minlength=len(texts))
    return train(found["features"], found["line_words"], lengths, np.asarray(good, np.int64))


def train(features: np.ndarray, line_words: np.ndarray, lengths: np.ndarray, good: np.ndarray, share: float = 0.5, rounds: int = 2, epochs: int = 60) -> crf.Crf | None:
    """Train on lines whose labels are latent: only their document's label is known.

    Lines start with their document's label. After each round the model labels the lines of
    the sample itself, and its labels replace the old ones in every document whose verdict
    by content share they leave right, so a good document keeps boilerplate lines and a poor
    one content lines.
    """
    if not len(features):
        return None
    text = np.repeat(np.arange(len(lengths)), lengths)
    total = np.maximum(1, np.bincount(text, line_words, len(lengths)))
    labels = good[text]
    # Long sequences train in stretches, so that padding stays bounded.
    parts = [s for n in lengths.tolist() for s in ([64] * (n // 64) + [n % 64])]
    model = None
    for k in range(rounds):
        model = crf.train(features, labels, parts, SIZE, epochs=epochs)
        if k + 1 < rounds:
            own = model.decode(features, lengths).astype(np.int64)
            right = (np.bincount(text, line_words * own, len(lengths)) / total >= share) == (good == 1)
            labels = np.where(right[text], own, good[text])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of at most ``sample`` labelled ids, those of the smallest hash: _id, text and label."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("label")).filter("_id is not null and label is not null")
    chosen = own.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), "_id").select("_id", "text", "label")


def train_rows(rows: pa.Table, most_lines: int = MOST_LINES) -> crf.Crf | None:
    """Train on rows of (_id, label, features, words): the first row of each id, up to ``most_lines`` lines in all."""
    features, words, good, seen, lines = [], [], [], set(), 0
    for ident, label, raw, own in zip(*(rows.column(c).to_pylist() for c in ("_id", "label", "features", "words")), strict=True):
        n = len(own) // 8
        if ident in seen:
            continue
        if lines + n > most_lines and good:
            break
        lines += n
        seen.add(ident)
        features.append(np.frombuffer(raw, "<i4").reshape(-1, WIDTH))
        words.append(np.frombuffer(own, "<i8"))
        good.append(int(label == 1))
    if not good:
        return None
    return train(np.concatenate(features), np.concatenate(words), np.array([len(w) for w in words]), np.array(good, np.int64))


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = MOST_LINES) -> crf.Crf | None:
    """The model of a bounded sample of labelled documents; null without labels.

    Tasks turn the sample's texts into line features, one task trains on them, and the model
    alone travels to the driver.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = labelled_sample(docs, labels, "quality", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, 1, 4 << 20):
            m = measures(part.column(1))
            ends = np.searchsorted(m["line_text"], np.arange(part.num_rows + 1))
            cuts = list(zip(ends[:-1], ends[1:], strict=True))
            features, words = m["features"].astype("<i4"), m["line_words"].astype("<i8")
            raw = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (features, words)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *raw], ["_id", "label", "features", "words"])

    kind, label = (rows.schema[c].dataType.simpleString() for c in ("_id", "label"))
    with small_batches(docs.sparkSession):
        table = scratch.save(rows.mapInArrow(run, f"_id {kind}, label {label}, features binary, words binary"), "sample")
        made = in_one_task(table, lambda rows: pickle.dumps(train_rows(rows, most_lines)), F.xxhash64("_id"), "_id", "features", "words")
    scratch.drop("sample")
    return pickle.loads(made)


def judge(docs: DataFrame, model: crf.Crf | None, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, content_words, content_share, base_failed and kept of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, 1, 4 << 20):
            m = measures(part.column(1))
            lengths = np.bincount(m["line_text"], minlength=part.num_rows)
            good = np.ones(len(m["line_text"]), bool) if model is None else model.decode(m["features"], lengths) == 1
            content = np.bincount(m["line_text"], m["line_words"] * good, part.num_rows).astype(np.int64)
            ratio = content / np.maximum(1, m["n_words"])
            failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            longs = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([part.column(0), *longs, pa.array(failed), pa.array(~failed & (ratio >= share)), pa.array(content), pa.array(ratio)], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words", "content_share"]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long, content_share double"
    return narrow.mapInArrow(run, out)
