"""Linear-chain conditional random field with two labels over hashed features.

An item is a row of a fixed number of feature indices, or of its own number (``Ragged``);
index 0 is the empty feature.
Training maximises the exact conditional likelihood by full-batch Adam with the
forward-backward recursions run over all sequences at once; decoding is Viterbi.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_SLOTS: dict[tuple[str, int], int] = {}


def slot(feature: str, size: int) -> int:
    """Stable index of a named feature, never 0."""
    found = _SLOTS.get((feature, size))
    if found is None:
        if len(_SLOTS) > 500_000:
            _SLOTS.clear()
        found = _SLOTS[feature, size] = 1 + zlib.crc32(feature.encode()) % (size - 1)
    return found


@dataclass
class Ragged:
    """Feature indices of items one after another, and how many each item has, one at least."""

    flat: np.ndarray
    sizes: np.ndarray

    def __len__(self) -> int:
        return len(self.sizes)

    @staticmethod
    def join(parts: list[Ragged]) -> Ragged:
        none = np.zeros(0, np.int32)
        return Ragged(np.concatenate([none, *(p.flat for p in parts)]), np.concatenate([none, *(p.sizes for p in parts)]))


@dataclass
class Crf:
    weights: np.ndarray  # (features, 2)
    moves: np.ndarray  # (2, 2), from and to
    start: np.ndarray  # (2,)

    def scores(self, rows: np.ndarray | Ragged) -> np.ndarray:
        if isinstance(rows, Ragged):
            return np.add.reduceat(self.weights[rows.flat], np.cumsum(rows.sizes) - rows.sizes, axis=0)
        return self.weights[rows].sum(axis=1)

    def decode(self, rows: np.ndarray | Ragged, lengths: Sequence[int], cells: int = 1 << 20) -> np.ndarray:
        """Viterbi labels of all items of consecutive sequences."""
        return self.viterbi(self.scores(rows) if len(rows) else np.zeros((0, 2)), lengths, cells)

    def viterbi(self, scores: np.ndarray, lengths: Sequence[int], cells: int = 1 << 20) -> np.ndarray:
        """Viterbi labels from the items' label scores; long sequences in groups of their own."""
        lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(len(scores), np.int8)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * lengths[order[end]] <= cells:
                end += 1
            self._viterbi(scores, starts[order[at:end]], lengths[order[at:end]], out)
            at = end
        return out

    def _viterbi(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, out: np.ndarray) -> None:
        n, steps = len(starts), int(lengths.max())
        best = scores[starts] + self.start
        back = np.zeros((steps, n, 2), np.int8)
        for t in range(1, steps):
            live = lengths > t
            via = best[:, :, None] + self.moves
            back[t] = via.argmax(axis=1)
            best = np.where(live[:, None], via.max(axis=1) + scores[np.where(live, starts + t, starts)], best)
        label = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            live = lengths > t
            out[(starts + t)[live]] = label[live]
            label = np.where(live, back[t, np.arange(n), label], label) if t else label


def train(rows: np.ndarray | Ragged, labels: np.ndarray, lengths: Sequence[int], size: int, epochs: int = 120, rate: float = 0.1, ridge: float = 1e-4) -> Crf:
    """Fit to labelled sequences; deterministic."""
    lengths = np.asarray(lengths, np.int64)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    lengths = lengths[lengths > 0]
    n, steps, items = len(lengths), int(lengths.max(initial=0)), len(rows)
    model = Crf(np.zeros((size, 2)), np.zeros((2, 2)), np.zeros(2))
    if not n:
        return model
    at = np.minimum(starts[:, None] + np.arange(steps), items - 1)
    live = np.arange(steps) < lengths[:, None]
    gold = np.eye(2)[labels]
    pairs = live[:, 1:]
    gold_moves = np.einsum("nta,ntb,nt->ab", gold[at[:, :-1]], gold[at[:, 1:]], pairs.astype(float))
    params = [model.weights, model.moves, model.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(1, epochs + 1):
        score = model.scores(rows)[at]
        alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        alpha[:, 0] = score[:, 0] + model.start
        for t in range(1, steps):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + model.moves, axis=1) + score[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            step = np.logaddexp.reduce(model.moves + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(live[:, t + 1, None], step, 0.0)
        norm = np.logaddexp.reduce(alpha[:, -1], axis=1)
        marginal = np.exp(alpha + beta - norm[:, None, None])
        both = alpha[:, :-1, :, None] + model.moves + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - norm[:, None, None, None]
        expected = np.where(pairs[:, :, None, None], np.exp(np.minimum(both, 0)), 0).sum(axis=(0, 1))
        residual = np.zeros((items, 2))
        residual[at[live]] = marginal[live] - gold[at[live]]
        flat, sizes = (rows.flat, rows.sizes) if isinstance(rows, Ragged) else (rows.ravel(), rows.shape[1])
        wide = np.repeat(residual, sizes, axis=0)
        grad_w = np.stack([np.bincount(flat, wide[:, k], size) for k in range(2)], axis=1)
        grad_w[0] = 0
        grads = [grad_w / n + ridge * model.weights, (expected - gold_moves) / n, (marginal[:, 0] - gold[starts]).sum(axis=0) / n]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return model
