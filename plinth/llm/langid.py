"""Language identification by hierarchical discrimination.

A first layer of linear support vector machines, one family against the rest, predicts the
language family.  Within a family, one machine for each pair of its languages separates
them, so closely related languages are told apart by what differs between the two alone.
Features are frequencies of hashed character n-grams over the whole text.  Margins are
calibrated on texts kept out of the training; a score is the product of both layers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import textkernel as tk
from .sampling import labelled_texts
from .subwords import Words, lowered, per_text, platt, sigmoid

#: Families of some language codes.  Any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "gu", "pa", "ne"],
    "celtic": ["ga", "gd", "cy", "br"],
    "baltic": ["lt", "lv"],
    "semitic": ["ar", "he", "mt", "am"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_SCALE = 30.0


@dataclass
class Settings:
    """``sample`` bounds the labelled texts that are fitted, per language; they are the
    distinct texts of the lowest hash."""

    sample: int = 400
    sizes: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 13
    cost: float = 10.0
    steps: int = 150


@dataclass
class Machine:
    """A linear machine over n-gram frequencies with a calibrated margin."""

    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0


@dataclass
class Model:
    """families: languages by family.  first: a machine per family; pairs: by language pair."""

    settings: Settings
    families: dict[str, list[str]] = field(default_factory=dict)
    first: dict[str, Machine] = field(default_factory=dict)
    pairs: dict[tuple[str, str], Machine] = field(default_factory=dict)

    def predict(self, texts: tk.Texts) -> tuple[list[str], np.ndarray]:
        """Language and score of each (lower-cased) text that has a letter."""
        machines = [*self.first.values(), *self.pairs.values()]
        n = len(texts)
        if not self.families:
            return [UNDETERMINED] * n, np.zeros(n)
        value = np.zeros((n, 0))
        if machines:
            words = Words(texts)
            total, count = words.sums(np.stack([m.weights for m in machines], 1), self.settings.sizes, False)
            length = np.maximum(per_text(count.astype(float), words.first), 1)
            mean = per_text(total, words.first) / length[:, None] * _SCALE
            value = np.stack([sigmoid(m.slope * (mean[:, k] + m.offset) + m.shift) for k, m in enumerate(machines)], 1)
        by = {key: value[:, k] for k, key in enumerate([*self.first, *self.pairs])}
        names = list(self.families)
        layer = np.stack([by[f] for f in names], 1) if self.first else np.ones((n, 1))
        layer = layer / np.maximum(layer.sum(1, keepdims=True), 1e-12)
        family = np.argmax(layer, 1)
        out, score = np.empty(n, object), np.zeros(n)
        for k, name in enumerate(names):
            codes = self.families[name]
            wins = np.ones((n, len(codes))) if len(codes) == 1 else np.zeros((n, len(codes)))
            for i, j in combinations(range(len(codes)), 2):
                p = by[codes[i], codes[j]]
                wins[:, i] += p
                wins[:, j] += 1 - p
            wins /= np.maximum(wins.sum(1, keepdims=True), 1e-12)
            mine = family == k
            best = np.argmax(wins, 1)
            out[mine] = np.array(codes, object)[best[mine]]
            score[mine] = layer[mine, k] * wins[mine, best[mine]]
        return out.tolist(), np.clip(score, 0, 1)


def _svm(x: np.ndarray, y: np.ndarray, settings: Settings) -> Machine:
    """Squared-hinge linear SVM, full-batch accelerated descent; every fifth row calibrates."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    a, t = x[~held], y[~held]
    share = np.where(t > 0, 0.5 / max(1, (t > 0).sum()), 0.5 / max(1, (t < 0).sum())) * settings.cost
    single = np.float32
    t, share = t.astype(single), share.astype(single)
    w, b = np.zeros(x.shape[1], single), single(0)
    vw, vb = w, b
    # largest curvature, by power iteration
    u = np.full(x.shape[1], x.shape[1] ** -0.5, single)
    for _ in range(15):
        u = (share * (a @ u)) @ a
        top = max(float(np.linalg.norm(u)), 1e-12)
        u = u / single(top)
    rate = single(1 / (2 * (top + share.sum()) + 1e-3))
    for k in range(settings.steps):
        slack = np.maximum(0, 1 - t * (a @ vw + vb)) * t * share
        nw, nb = vw - rate * (single(1e-3) * vw - 2 * (slack @ a)), vb + rate * 2 * slack.sum()
        m = single(k / (k + 3))
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    machine = Machine(w.astype(np.float32), float(b))
    check = held if held.any() else np.ones(len(y), bool)
    machine.slope, machine.shift = platt(x[check] @ w + b, (y[check] > 0).astype(float))
    return machine


def train(texts: list[str], langs: list[str], settings: Settings | None = None) -> Model:
    s = settings or Settings()
    model = Model(s)
    for code in sorted(set(langs)):
        model.families.setdefault(_FAMILY.get(code, f"only {code}"), []).append(code)
    rows = []
    for _, block in tk.blocks(lowered(pa.array(texts, pa.string()))):
        words = Words(block)
        ids, word = words.features(s.sizes, s.buckets, False)
        order = np.argsort(word, kind="stable")
        edge = np.searchsorted(word[order], np.arange(len(words.keys) + 1))
        for k in range(len(block)):
            mine = words.which[words.first[k] : words.first[k + 1]]
            distinct, n = np.unique(mine, return_counts=True)
            size = np.diff(edge)[distinct]
            at = np.repeat(edge[distinct] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            x = np.bincount(ids[order[at]], weights=np.repeat(n, size), minlength=s.buckets)
            rows.append((x / max(x.sum(), 1) * _SCALE).astype(np.float32))
    x = np.array(rows) if rows else np.zeros((0, s.buckets), np.float32)
    lang = np.array(langs, object)
    family = np.array([_FAMILY.get(code, f"only {code}") for code in langs], object)
    if len(model.families) > 1:
        for name in model.families:
            model.first[name] = _svm(x, np.where(family == name, 1.0, -1.0), s)
    for codes in model.families.values():
        for i, j in combinations(codes, 2):
            mine = (lang == i) | (lang == j)
            model.pairs[i, j] = _svm(x[mine], np.where(lang[mine] == i, 1.0, -1.0), s)
    return model


def learn(labelled: DataFrame, settings: Settings | None = None) -> Model:
    """Fits columns ``text`` and ``lang``; null or letterless ones teach nothing."""
    s = settings or Settings()
    clean = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = labelled_texts(clean.select("text", F.col("lang").cast("string").alias("label")), s.sample)
    # languages take turns, so that every part of the rows has all of them
    order = np.random.default_rng(5).permutation(len(rows))
    model = train([rows[i][0] for i in order], [rows[i][1] for i in order], s)
    del rows
    tk.trim()
    return model


def predict(docs: DataFrame, model: Model, *, doc_id="doc_id", text="text") -> DataFrame:
    """Columns doc_id, lang_pred, score.

    A text that is null or has no letter is ``und`` with score 1; so is, with score 0, every
    text where nothing was learned.  Repeated ids give a row each.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    handle = slim.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = np.array([bool(t and _LETTER.search(t)) for t in batch.column(1).to_pylist()], bool)
            for rows, texts in tk.blocks(lowered(batch.column(1))):
                lang, score = handle.value.predict(texts)
                has = letter[rows.start : rows.stop]
                lang = [name if ok else UNDETERMINED for name, ok in zip(lang, has, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows.start : rows.stop], pa.array(lang, pa.string()), pa.array(np.where(has, score, 1.0))], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(tk.lean(apply), f"doc_id {kind}, lang_pred string, score double")


def annotate(docs: DataFrame, model: Model, *, text="text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score; columns so named are replaced."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                has = np.array([bool(t and _LETTER.search(t)) for t in batch.column(at).to_pylist()], bool)
                langs, scores = [], []
                for _, texts in tk.blocks(lowered(batch.column(at))):
                    lang, score = handle.value.predict(texts)
                    langs += lang
                    scores.append(score)
                langs = [name if ok else UNDETERMINED for name, ok in zip(langs, has, strict=True)]
                columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(np.where(has, np.concatenate(scores), 1.0))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(tk.lean(apply), schema)
