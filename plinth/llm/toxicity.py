"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Each word is the bag of its character n-grams and itself, hashed to buckets; each bucket has
a vector.  A window of a few words is the average of its vectors and goes through a linear
softmax over (clean, toxic).  Vectors and softmax are trained jointly in numpy on windows.
As a document's label says only that toxic words are somewhere, training starts with all
windows of toxic documents as toxic and goes on with each one's most toxic windows.

A document's score is its most toxic window's margin, calibrated on documents kept out of
the training.  An unseen misspelling shares n-grams, and so vectors, with what was learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .sampling import LONGEST, bounded, cut
from .subwords import Words, lowered, platt, sigmoid


@dataclass
class Settings:
    """``sample`` bounds the labelled documents that are fitted, per label; they are those of
    the lowest hash of their id.  ``window`` is in words.  At ``threshold`` the score tells
    toxic texts best: the calibration puts the cut with the largest F1 there."""

    sample: int = 2000
    crossed: int = 1000
    threshold: float = 0.7
    sizes: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 17
    dims: int = 4
    window: int = 4
    warm: int = 25
    steps: int = 45
    seed: int = 11


class Model:
    """Margin of each bucket (toxic minus clean) and the calibration."""

    def __init__(self, margins: np.ndarray, offset: float, slope: float, shift: float, settings: Settings):
        self.margins, self.offset, self.slope, self.shift, self.settings = margins, offset, slope, shift, settings

    def margin(self, texts: tk.Texts) -> np.ndarray:
        """Largest window margin of each text; texts without words get the lowest seen."""
        words = Words(texts)
        total, count = words.sums(self.margins[:, None], self.settings.sizes, True)
        return _largest(total[:, 0], count, words.first, self.settings.window, self.offset)

    def score(self, texts: tk.Texts) -> np.ndarray:
        m = self.margin(texts)
        empty = np.isneginf(m)
        return np.where(empty, 0.0, sigmoid(self.slope * np.where(empty, 0, m) + self.shift))


def _window_sums(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over windows that start at each word and end with their text or after ``size``."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    own = tk.owners(first)
    at = np.arange(len(values))
    # a text's last windows are shifted back so that each has ``size`` words where it can
    end = np.minimum(at + size, first[1:][own])
    begin = np.maximum(end - size, first[:-1][own])
    return sums[end] - sums[begin], own


def _largest(total: np.ndarray, count: np.ndarray, first: np.ndarray, size: int, offset: float) -> np.ndarray:
    out = np.full(len(first) - 1, -np.inf)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        sums, _ = _window_sums(total, first, size)
        counts, _ = _window_sums(count.astype(float), first, size)
        out[filled] = np.maximum.reduceat(sums / np.maximum(counts, 1) + offset, first[filled])
    return out


def train(texts: list[str], labels: np.ndarray, settings: Settings) -> Model:
    """Joint training on whole texts; every fourth text is kept for the calibration.

    A quarter of a small sample is too little to calibrate on: up to ``crossed`` texts, each
    quarter is judged by a model of the other three, and the model itself learns from all.
    """
    s = settings
    # block by block, so that the work arrays of the text stay small
    known = np.zeros(0, np.uint64)
    tokens, lengths, ids, word = [], [], [], []
    for _, block in tk.blocks(lowered(pa.array(texts, pa.string()))):
        words = Words(block)
        tokens.append(words.keys[words.which])
        lengths.append(np.diff(words.first))
        new = ~tk.member(words.keys, known)[1]
        feature, of = words.features(s.sizes, s.buckets, True)
        keep = new[of]
        ids.append(feature[keep].astype(np.int32))
        word.append(words.keys[of[keep]])
        known = np.union1d(known, words.keys[new])
    which = np.searchsorted(known, np.concatenate(tokens)).astype(np.int32)
    word = np.searchsorted(known, np.concatenate(word)).astype(np.int32)
    n_words = len(known)
    del tokens, known
    used, ids = np.unique(np.concatenate(ids), return_inverse=True)
    ids = ids.astype(np.int32)
    # n-grams in order of their word
    order = np.argsort(word, kind="stable")
    ids, word = ids[order], word[order]
    per_word = np.bincount(word, minlength=n_words).astype(np.float32)
    first = np.append(0, np.cumsum(np.concatenate(lengths)))
    own = tk.owners(first)
    # disjoint windows, counted from each text's start
    chunk = np.unique(own.astype(np.int64) << 32 | (np.arange(len(own)) - first[own]) // s.window, return_inverse=True)
    doc_of, win = (chunk[0] >> 32).astype(np.int64), chunk[1].reshape(-1)
    n_win = len(doc_of)
    size = np.bincount(win, weights=per_word[which], minlength=n_win).astype(np.float32)
    y = labels[doc_of].astype(np.float32)
    # windows to words and words to n-grams as sorted index lists
    by_word = np.argsort(which, kind="stable").astype(np.int32)
    word_edge = np.searchsorted(which[by_word], np.arange(n_words))
    by_id = np.argsort(ids, kind="stable").astype(np.int32)
    id_edge = np.searchsorted(ids[by_id], np.arange(len(used)))
    feat_edge = np.searchsorted(word, np.arange(n_words))
    word_by_id, win_by_word = word[by_id], win[by_word].astype(np.int32)
    del by_id, by_word, order
    win_edge = np.searchsorted(win, np.arange(n_win))
    quarter = np.arange(len(texts)) % 4

    def fitted(held: np.ndarray) -> tuple[np.ndarray, float]:
        """Margins of the used buckets and the offset, from the texts that aren't held."""
        open_ = ~held[doc_of]
        rng = np.random.default_rng(s.seed)
        vectors = (rng.standard_normal((len(used), s.dims)) * 0.1).astype(np.float32)
        soft = (rng.standard_normal((s.dims, 2)) * 0.1).astype(np.float32)
        bias = np.zeros(2, np.float32)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, soft, bias)]
        for step in range(s.steps):
            if not n_win:
                break
            if step == s.warm:
                # from here on a toxic document teaches only its most toxic windows
                margin = (hidden @ (soft[:, 1] - soft[:, 0])) + bias[1] - bias[0]
                top = np.full(len(texts), -np.inf)
                np.maximum.at(top, doc_of, margin)
                open_ &= (y == 0) | (margin >= top[doc_of] - 0.1 * np.abs(top[doc_of])) & (margin > 0)
            word_vec = np.add.reduceat(vectors[ids], feat_edge, axis=0)
            hidden = np.add.reduceat(word_vec[which], win_edge, axis=0) / size[:, None]
            logits = hidden @ soft + bias
            p1 = sigmoid(logits[:, 1] - logits[:, 0]).astype(np.float32)
            share = max(1.0, float((y * open_).sum())), max(1.0, float(((1 - y) * open_).sum()))
            weight = np.where(y > 0, 1 / share[0], 1 / share[1]) * open_ / 2
            d1 = ((p1 - y) * weight).astype(np.float32)
            d = np.stack([-d1, d1], 1)
            grad_soft, grad_bias = hidden.T @ d, d.sum(0)
            grad_hidden = (d @ soft.T) / size[:, None]
            grad_word = np.add.reduceat(grad_hidden[win_by_word], word_edge, axis=0)
            grad_vec = np.add.reduceat(grad_word[word_by_id], id_edge, axis=0)
            for p, g, st, rate in ((vectors, grad_vec, state[0], 0.1), (soft, grad_soft, state[1], 0.1), (bias, grad_bias, state[2], 0.1)):
                st[0] += 0.1 * (g - st[0])
                st[1] += 0.02 * (g * g - st[1])
                p -= rate * (st[0] / (1 - 0.9 ** (step + 1))) / (np.sqrt(st[1] / (1 - 0.98 ** (step + 1))) + 1e-8)
        return vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])

    def judged(found: np.ndarray, offset: float) -> np.ndarray:
        total = np.bincount(word, weights=found[ids], minlength=n_words)
        return _largest(total[which], per_word[which].astype(float), first, s.window, offset)

    doc_margin = np.full(len(texts), -np.inf)
    for k in range(4) if len(texts) <= s.crossed else [3]:
        held = quarter == k
        found, offset = fitted(held)
        doc_margin[held] = judged(found, offset)[held]
    if len(texts) <= s.crossed:
        found, offset = fitted(np.zeros(len(texts), bool))
    margins = np.zeros(s.buckets, np.float32)
    margins[used] = found
    model = Model(margins, offset, 1.0, 0.0, s)
    use = np.isfinite(doc_margin)
    if use.any() and len(set(labels[use])) == 2:
        model.slope, _ = platt(doc_margin[use], labels[use].astype(float))
        model.shift = np.log(s.threshold / (1 - s.threshold)) - model.slope * _best_cut(doc_margin[use], labels[use])
    return model


def _best_cut(margin: np.ndarray, label: np.ndarray) -> float:
    """The cut, midway between two margins, above which toxic texts are told with the largest
    F1; of equal ones the middle."""
    order = np.argsort(margin, kind="stable")
    ordered, toxic = margin[order], label[order] > 0
    above = np.append(np.cumsum(toxic[::-1])[::-1], 0)  # toxic ones from each place on
    places = np.flatnonzero(np.append(True, ordered[1:] > ordered[:-1]))
    f1 = 2 * above[places] / (len(ordered) - places + toxic.sum())
    best = places[np.flatnonzero(f1 >= f1.max() - 1e-12)]
    k = int(best[len(best) // 2])
    return float(ordered[k] if k == 0 else (ordered[k - 1] + ordered[k]) / 2)


def learn(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="label", settings: Settings | None = None) -> Model | None:
    """Fits texts of ``docs`` by the labels (1: toxic, 0: clean) of their ids.

    The sample is drawn from the labels alone; as it is bounded, it travels to the documents.
    An id counts once per label, with the text of the lowest hash where it has several.
    Null labels, ids and texts, and texts over 128 KB, teach nothing.  Without rows of both labels there is nothing
    to learn and the result is None.
    """
    s = settings or Settings()
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    sample = F.broadcast(bounded(marks.withColumn("h", F.xxhash64("id")), s.sample).distinct())
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") <= LONGEST)
    met = texts.join(sample, "id").groupBy("id", "label", "h").agg(F.min(F.struct(F.xxhash64("text").alias("place"), "text")).alias("one"))
    rows = cut([tuple(r) for r in met.select("h", "label", "one.text").collect()], s.sample)
    if len({label for _, label in rows}) < 2:
        return None
    order = np.random.default_rng(s.seed).permutation(len(rows))
    return train([rows[i][0] for i in order], np.array([rows[i][1] for i in order]), s)


def score(docs: DataFrame, model: Model | None, *, doc_id="doc_id", text="text", threshold: float = 0.7) -> DataFrame:
    """Columns doc_id, score (0..1), predicted (1 from ``threshold`` on).

    Null and empty texts, and all texts without a model, score 0.  Repeated ids give a row
    each.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    handle = slim.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = handle.value
        for batch in batches:
            for rows, texts in tk.blocks(lowered(batch.column(1))):
                value = fitted.score(texts) if fitted else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows.start : rows.stop], pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return slim.mapInArrow(apply, f"doc_id {kind}, score double, predicted int")
