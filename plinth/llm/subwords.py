"""Character n-gram features of distinct words, for linear text models.

A model that is linear in averaged n-gram vectors needs, per class, one number per n-gram
when it scores.  The features of each distinct word of a block are made once and summed per
word; texts then only add up words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkernel as tk

_MARK = 0x110000  # beyond all code points; stands at both ends of a word


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


class Words:
    """Words of a block of texts: ``which`` gives each word's distinct word."""

    def __init__(self, texts: tk.Texts):
        starts, ends, self.first = texts.spans(tk.SPACE)
        keys, at, self.which = np.unique(texts.hashes(starts, ends), return_index=True, return_inverse=True)
        self.keys = keys
        self.own = tk.owners(self.first)
        self._texts, self._starts, self._ends = texts, starts[at], ends[at]

    def features(self, sizes: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Bucket ids of the distinct words' n-grams, and the word of each.

        ``whole`` adds a feature for the word itself.
        """
        texts, starts, length = self._texts, self._starts, self._ends - self._starts
        begin = np.cumsum(length + 1) - (length + 1)
        flat = np.full(int((length + 1).sum()), 0x20, np.uint8)
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        flat[np.repeat(begin, length) + place] = texts.flat[np.repeat(starts, length) + place]
        points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        stops = np.flatnonzero(points == 0x20)
        n = len(stops)
        points = np.where(points == 0x20, np.uint64(_MARK), points)
        # a mark before each word too: shift word k by k + 1
        own = np.searchsorted(stops, np.arange(len(points)))
        marked = np.full(len(points) + n, np.uint64(_MARK))
        marked[np.arange(len(points)) + own + 1] = points
        ends = stops + np.arange(n) + 2
        begins = np.append(0, ends[:-1]) if n else ends
        word = np.repeat(np.arange(n), ends - begins)
        last = np.repeat(ends, ends - begins)
        value = tk.mix(marked)
        ids, words = [], []
        for size in sizes:
            count = len(value) - size + 1
            if count <= 0:
                continue
            h = np.zeros(count, np.uint64)
            for k in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + value[k : k + count]
            ok = np.arange(count) + size <= last[:count]
            if size == 1:
                ok &= marked != _MARK
            ids.append(tk.mix(h[ok] + np.uint64(size)) % np.uint64(buckets))
            words.append(word[:count][ok])
        if whole:
            ids.append(tk.mix(self.keys) % np.uint64(buckets))
            words.append(np.arange(n))
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ids).astype(np.int64), np.concatenate(words)

    def sums(self, weights: np.ndarray, sizes: tuple[int, ...], whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per word of the texts: summed weights (a column per model) and number of features."""
        ids, words = self.features(sizes, len(weights), whole)
        n = len(self.keys)
        count = np.bincount(words, minlength=n)
        total = np.stack([np.bincount(words, weights=weights[ids, k], minlength=n) for k in range(weights.shape[1])], 1)
        return total[self.which], count[self.which]


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the words' values per text."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, fitted by Newton steps with a small prior."""
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * x + b)
        g = np.array([((p - y) * x).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(step).max()) / 5)
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)
