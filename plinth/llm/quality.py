"""Quality rules by distribution divergence.

A document's character-class histogram and common-word histogram are held against language
references, which are the summed histograms of all documents of a language.  The distance
is the Jensen-Shannon distance (base 2, in 0..1).  A document passes when the nearest
reference is near enough; texts under a minimum length have too few counts for a verdict
and pass the divergence rules.

Only two passes over the texts are made, both inside Arrow batches; what reaches the driver
is one histogram and one bounded word list per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk

#: Character classes: a-z, A-Z, digits, space and tab, line breaks, sentence marks,
#: other ASCII, letters and marks beyond ASCII (counted once by their first byte).
CLASS_COUNT = 8
_CLASS = np.full(256, 6, np.uint8)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = 255
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: Kinds of counts, and how many a task holds before it hands them on.
_CLASSES, _WORDS, _TOTAL = range(3)
_HELD = 1 << 20

BASE_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Rules:
    """Parameters of the verdict.

    common_words: size of a language's word list.  max_class, max_word: largest accepted
    distances.  min_words, min_chars: shorter texts pass both divergence rules.
    """

    def __init__(self, common_words=64, max_class=0.27, max_word=0.46, min_words=60, min_chars=300):
        self.common_words = common_words
        self.max_class, self.max_word = max_class, max_word
        self.min_words, self.min_chars = min_words, min_chars


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of ``p`` to ``q``; both hold probabilities."""
    m = (p + q) / 2

    def kl(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def _class_counts(texts: tk.Texts) -> np.ndarray:
    kind = _CLASS[texts.flat]
    return np.stack([texts.count(kind == k) for k in range(CLASS_COUNT)], 1).astype(float)


def references(docs: DataFrame, text: str, lang: str, rules: Rules) -> list[tuple[str, np.ndarray, dict[int, int], int]]:
    """Per language, in order: its name, summed class counts, common words (by hash) with
    counts, words in all.

    Every word of every labelled document counts; equally frequent words rank by hash.  Null
    languages teach nothing.  What reaches the driver is bounded per language.
    """

    def rows_of(held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for (name, kind), parts in held.items():
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, place, np.concatenate([c for _, c in parts]))
            for lo in range(0, len(keys), 1 << 16):
                some = keys[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(np.full(len(some), kind, np.int32)), pa.array(tk.signed(some)), pa.array(n[lo : lo + len(some)])], names=["lang", "kind", "key", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for rows, texts in tk.blocks(batch.column(0)):
                starts, ends, first = texts.spans(tk.SPACE)
                keys = texts.lower().hashes(starts, ends)
                own = tk.owners(first)
                counts = _class_counts(texts)
                for name in sorted(set(langs[rows])):
                    mine = langs[rows] == name
                    held.setdefault((name, _CLASSES), []).append((np.arange(CLASS_COUNT, dtype=np.uint64), counts[mine].sum(0).astype(np.int64)))
                    words, n = np.unique(keys[mine[own]], return_counts=True)
                    if len(words):
                        held.setdefault((name, _WORDS), []).append((words, n))
                        held.setdefault((name, _TOTAL), []).append((np.zeros(1, np.uint64), n.sum(keepdims=True)))
                    size += len(words) + CLASS_COUNT + 1
                if size > _HELD:
                    yield from rows_of(held)
                    held, size = {}, 0
        yield from rows_of(held)

    seen = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("l is not null and t is not null")
    grouped = seen.mapInArrow(learn, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    top = grouped.withColumn("r", rank).where(F.col("r") <= max(rules.common_words, CLASS_COUNT)).toPandas()
    out = []
    for name, part in top.groupby("lang"):
        of = {kind: part[part.kind == kind] for kind in (_CLASSES, _WORDS, _TOTAL)}
        counts = np.zeros(CLASS_COUNT)
        counts[of[_CLASSES].key.to_numpy()] = of[_CLASSES].n.to_numpy()
        words = of[_WORDS][of[_WORDS].r <= rules.common_words]
        out.append((name, counts, dict(zip(words.key.tolist(), words.n.tolist(), strict=True)), int(of[_TOTAL].n.sum())))
    return out


def quality_table(docs: DataFrame, *, doc_id="doc_id", text="text", lang="lang", rules: Rules | None = None) -> DataFrame:
    """Per document: the base counts, the distances to the nearest reference and the verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance (null where the text is too short or no
    reference exists), kept.  A null or empty text has no words and fails the base rules.
    Repeated ids give a row each; other columns of the input are not read.
    """
    rules = rules or Rules()
    refs = references(docs, text, lang, rules)
    class_refs, word_refs = [], []
    for _, counts, words, total in refs:
        if not counts.sum() or not words:
            continue
        class_refs.append(counts / counts.sum())
        hashes = np.array(list(words), np.int64).view(np.uint64)
        order = np.argsort(hashes)
        share = np.array(list(words.values()))[order] / total
        word_refs.append((hashes[order], np.append(share, max(0.0, 1 - share.sum()))))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in tk.blocks(batch.column(1)):
                yield _judge(batch.column(0)[rows.start : rows.stop], texts)

    def _judge(ids: pa.Array, texts: tk.Texts) -> pa.RecordBatch:
        n = len(texts)
        starts, ends, first = texts.spans(tk.SPACE)
        own = tk.owners(first)
        n_words = np.diff(first)
        salt = tk.mix(np.arange(1, n + 1, dtype=np.uint64))
        raw = texts.hashes(starts, ends)
        lead = (texts.flat & 0xC0) != 0x80
        word_chars = texts.count(lead & ~tk.SPACE[texts.flat])
        n_symbols = texts.count(_SYMBOL[texts.flat])
        # lines that hold a word and equal an earlier one
        ls, le, lfirst = texts.lines()
        filled = np.searchsorted(starts, ls) < np.searchsorted(starts, le)
        ls, le, lown = ls[filled], le[filled], tk.owners(lfirst)[filled]
        line_key = np.sort(texts.hashes(ls, le) ^ salt[lown])
        fresh = len(line_key) and np.append(True, line_key[1:] != line_key[:-1])
        dup = np.zeros(n, np.int64)
        if len(line_key) and not fresh.all():
            key = texts.hashes(ls, le) ^ salt[lown]
            _, keep = np.unique(key, return_index=True)
            later = np.ones(len(key), bool)
            later[keep] = False
            dup = np.bincount(lown[later], minlength=n)
        # words inside repeated five-word windows
        win, at = tk.windows(raw, first, 5)
        hot = at[tk.repeated(win ^ salt[own[at]])] if len(at) else at
        covered = np.zeros(len(raw) + 5, bool)
        for k in range(5):
            covered[hot + k] = True
        repeat = np.bincount(own[covered[: len(raw)]], minlength=n) if len(raw) else np.zeros(n, np.int64)
        failed = (n_words < 10) | (100 * repeat > 20 * n_words)
        # distances
        long_enough = (n_words >= rules.min_words) & (word_chars >= rules.min_chars)
        class_d, word_d = np.full(n, np.nan), np.full(n, np.nan)
        if class_refs and long_enough.any():
            counts = _class_counts(texts)[long_enough]
            p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            class_all = np.stack([js_distance(p, q) for q in class_refs], 1)
            lowered = texts.lower().hashes(starts, ends)
            which = np.cumsum(long_enough) - 1
            mine = long_enough[own]
            rows, keys = which[own[mine]], lowered[mine]
            word_all = []
            for hashes, share in word_refs:
                k = len(hashes)
                place, there = tk.member(keys, hashes)
                cell = rows * (k + 1) + np.where(there, place, k)
                q = np.bincount(cell, minlength=int(long_enough.sum()) * (k + 1)).reshape(-1, k + 1).astype(float)
                word_all.append(js_distance(q / np.maximum(q.sum(1, keepdims=True), 1), share))
            word_all = np.stack(word_all, 1)
            best = np.argmin(word_all + class_all, 1)
            pick = np.arange(len(best))
            class_d[long_enough], word_d[long_enough] = class_all[pick, best], word_all[pick, best]
        kept = ~failed & ~((class_d > rules.max_class) | (word_d > rules.max_word))
        nulls = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, dup, repeat)), pa.array(failed), nulls(class_d), nulls(word_d), pa.array(kept)],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"],
        )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(judge, f"doc_id {kind}, {BASE_COLUMNS}, base_failed boolean, class_distance double, word_distance double, kept boolean")
