"""Class-based n-gram scoring (Brown clustering by exchange).

P(text) = product over tokens of P(class | previous class) * P(word | class).

* Word counts are taken over all training texts and kept as a table; they grow with the
  corpus and never reach the driver.
* The most frequent words, and the endings of the others, are the items of the exchange
  clustering: each item moves to the class that raises the likelihood of the item bigrams
  most, until no item moves.
* Every other known word then moves to its best class by its own class-context counts, which
  are taken over all training texts: to the class of the largest gain of that likelihood, to
  first order, as one rare word hardly changes the class bigrams.
* A word beyond the known ones belongs to its ending's class, so every word, also an unseen
  one, has a class.  Class bigrams and emissions are counted anew with all these classes.
* Class transitions are interpolated with class frequencies; word emission is add-one
  smoothed within the class, where unseen words of the class share one more type.

To score, known words travel to the tasks as a list of bounded size.  Every other word of
a document is looked up by a join on the word's hash, in which no key is hot, as no word in
it is more frequent than the last one of the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .storage import discard, materialize

#: Stands for the end of a text, which is a token of its own.
END = np.uint64(0)


@dataclass
class Settings:
    """words, endings: items of the exchange clustering at most.  known: frequent words with
    a class of their own, whose counts travel to the tasks.  tail: characters of an ending.
    fade: weight of class frequencies against class transitions."""

    words: int = 1200
    endings: int = 300
    classes: int = 128
    known: int = 200_000
    tail: int = 3
    sweeps: int = 8
    fade: float = 20.0


def _tokens(texts: tk.Texts, tail_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased words and of their endings, with an end token after each text,
    the index of each text's first token, and whether a token is a word."""
    low = texts.lower()
    starts, ends, first = low.spans(tk.SPACE)
    keys = low.hashes(starts, ends)
    # an ending begins with a character, not within one
    lead = (low.flat & 0xC0) != 0x80
    place, before = np.flatnonzero(lead), np.append(0, np.cumsum(lead))
    begin = place[np.maximum(before[starts], before[ends] - tail_chars)] if len(starts) else starts
    tails = low.hashes(begin, ends) | np.uint64(1)
    at = np.arange(len(keys)) + tk.owners(first)
    total = len(keys) + len(texts)
    out, tail, is_word = np.full(total, END), np.full(total, END), np.zeros(total, bool)
    out[at], tail[at], is_word[at] = keys, tails, True
    return out, tail, first + np.arange(len(first)), is_word


def word_counts(texts: DataFrame, settings: Settings) -> DataFrame:
    """Columns key (word hash; 0: end), tail (hash of the ending), c: over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, block in tk.blocks(batch.column(0)):
                keys, tails, _, _ = _tokens(block, settings.tail)
                u, at, n = np.unique(keys, return_index=True, return_counts=True)
                parts.append((u, tails[at], n))
            if not parts:
                continue
            keys, tails, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
            u, at, back = np.unique(keys, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(u)), pa.array(tk.signed(tails[at])), pa.array(np.bincount(back, weights=n).astype(np.int64))], names=["key", "tail", "c"])

    return texts.mapInArrow(count, "key long, tail long, c long").groupBy("key").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


class Items:
    """Item of each token: a frequent word, an ending, the end, or 'other'."""

    def __init__(self, words: np.ndarray, endings: np.ndarray):
        self.words, self.endings = np.sort(words), np.sort(endings)
        self.size = 2 + len(words) + len(endings)
        self._word, self._ending = tk.Lookup(self.words), tk.Lookup(self.endings)

    def of(self, keys: np.ndarray, tails: np.ndarray, is_word: np.ndarray) -> np.ndarray:
        place, known = self._word.find(keys)
        ending, has = self._ending.find(tails)
        item = np.where(known, 2 + place, np.where(has, 2 + len(self.words) + ending, 1))
        return np.where(is_word, item, 0)


class Classes:
    """Class of each token: of a known word its own, of another word its ending's."""

    def __init__(self, items: Items, cls: np.ndarray, keys: np.ndarray, own: np.ndarray):
        self.items, self.cls, self.keys, self.own = items, cls.astype(np.int32), keys, own.astype(np.int32)
        self.count = int(cls.max()) + 1
        self.known = tk.Lookup(keys)

    def of(self, keys: np.ndarray, tails: np.ndarray, is_word: np.ndarray) -> np.ndarray:
        return self.places(keys, tails, is_word)[0]

    def places(self, keys: np.ndarray, tails: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of tokens, their places among the known words, and whether they have one."""
        place, there = self.known.find(keys)
        there &= is_word
        out = np.zeros(len(keys), np.int64)
        out[there] = self.own[place[there]] if len(self.own) else 0
        rest = np.flatnonzero(is_word & ~there)
        out[rest] = self.cls[self.items.of(keys[rest], tails[rest], np.ones(len(rest), bool))]
        return out, place, there


_HELD = 1 << 20


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cell, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    n = np.bincount(back.reshape(-1), weights=np.concatenate([n for _, n in parts]), minlength=len(cell))
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])


def _task_cells(texts: DataFrame, settings: Settings, of) -> DataFrame:
    """cell, n of the texts of a task, summed as far as it holds them; ``of`` gives the cells
    of one block from its tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, block in tk.blocks(batch.column(0)):
                keys, tails, first, is_word = _tokens(block, settings.tail)
                parts.append(np.unique(of(keys, tails, first, is_word), return_counts=True))
                held += len(parts[-1][0])
                if held > _HELD:
                    yield _summed(parts)
                    parts, held = [], 0
        if parts:
            yield _summed(parts)

    return texts.mapInArrow(count, "cell long, n long")


def _cells(texts: DataFrame, settings: Settings, of) -> DataFrame:
    """cell, n over all texts."""
    return _task_cells(texts, settings, of).groupBy("cell").agg(F.sum("n").alias("n"))


def _before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.append(0, values[:-1])
    out[first[:-1]] = 0
    return out


def item_bigrams(texts: DataFrame, items: Items, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of adjacent items over all texts as (i, j, n), by i; a text begins after an end.
    At most the square of the number of items in rows."""
    handle = texts.sparkSession.sparkContext.broadcast(items)

    def of(keys, tails, first, is_word):
        item = handle.value.of(keys, tails, is_word)
        return _before(item, first) * handle.value.size + item

    found = _cells(texts, settings, of).toArrow()
    cell, n = (found.column(x).to_numpy() for x in ("cell", "n"))
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    return (cell // items.size).astype(np.int32), (cell % items.size).astype(np.int32), n


def class_bigrams(texts: DataFrame, classes: Classes, settings: Settings) -> np.ndarray:
    """Table of adjacent classes over all texts."""
    handle = texts.sparkSession.sparkContext.broadcast(classes)

    def of(keys, tails, first, is_word):
        cls = handle.value.of(keys, tails, is_word)
        return _before(cls, first) * handle.value.count + cls

    k = classes.count
    table = np.zeros(k * k)
    for r in _cells(texts, settings, of).collect():
        table[r["cell"]] = r["n"]
    return table.reshape(k, k)


def assign(texts: DataFrame, classes: Classes, keys: np.ndarray, table: np.ndarray, settings: Settings) -> np.ndarray:
    """Class of each known word in ``keys`` (ascending) by its own contexts: counts of the
    classes before and after it over all texts, weighed by the class bigrams ``table``.  One
    class index per word reaches the driver."""
    k = classes.count
    own = classes.of(keys, np.zeros(len(keys), np.uint64), np.ones(len(keys), bool))
    seen = np.isin(keys, classes.items.words)
    smooth = table + 0.5
    # first-order gain of a word in class b: what follows it, and what it follows
    follows = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
    comes = np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32)
    width = 2 * k
    handle = texts.sparkSession.sparkContext.broadcast((classes, tk.Lookup(keys), seen, follows, comes))

    def of(keys, tails, first, is_word):
        classes, known, seen, _, _ = handle.value
        cls = classes.of(keys, tails, is_word)
        place, there = known.find(keys)
        at = np.flatnonzero(there & is_word & ~seen[place]) if len(seen) else np.zeros(0, np.int64)
        # an end follows the last word of a text, so a word always has a next token
        base = place[at].astype(np.int64) * width
        return np.concatenate([base + _before(cls, first)[at], base + classes.count + cls[at + 1]])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition has the words of some residues; a table of contexts for each
        _, known, _, follows, comes = handle.value
        k, total = len(follows), len(known.ordered)
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            word = cell // width
            part = word % parts
            for p in np.unique(part).tolist():
                mine = part == p
                if p not in held:
                    held[p] = np.zeros((total // parts + 1) * width, np.float32)
                np.add.at(held[p], (word[mine] // parts) * width + cell[mine] % width, n[mine])
        for p, table in held.items():
            table = table.reshape(-1, 2 * k)
            row = np.flatnonzero(table.any(1))
            gain = table[row, :k] @ comes + table[row, k:] @ follows.T
            gain[:, 0] = -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(row * parts + p), pa.array(np.argmax(gain, 1).astype(np.int32))], names=["word", "cls"])

    # words are dealt over partitions, and what a task holds is its words' contexts
    parts = max(32, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = _task_cells(texts, settings, of).repartition(parts, F.pmod(F.floor(F.col("cell") / width), F.lit(parts)))
    best = spread.mapInArrow(pick, "word long, cls int").toPandas()
    own = own.copy()
    own[best["word"].to_numpy()] = best["cls"].to_numpy()
    return own


def exchange(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """:func:`exchange_cells` of a whole item bigram matrix."""
    i, j = np.nonzero(counts)
    return exchange_cells(i, j, counts[i, j], len(counts), classes, sweeps)


def exchange_cells(i: np.ndarray, j: np.ndarray, n: np.ndarray, m: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of each of ``m`` items: exchange clustering on item bigrams (i, j) of count n.

    Item 0 (end) keeps class 0 for itself.  Items start dealt over the classes by frequency;
    each sweep moves every item to its best class by the bigram class likelihood.  A move
    looks at the classes that the item's neighbours have, and changes its neighbours only.
    """
    classes = max(2, min(classes, m))
    n = n.astype(float)
    freq = np.bincount(i, weights=n, minlength=m) + np.bincount(j, weights=n, minlength=m)
    order = [w for w in np.argsort(-freq, kind="stable") if w]
    cls = np.zeros(m, np.int64)
    cls[order] = 1 + np.arange(m - 1) % (classes - 1)

    def lists(by: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.argsort(by, kind="stable")
        return np.searchsorted(by[at], np.arange(m + 1)), other[at], n[at]

    out_edge, out_item, out_n = lists(i, j)
    in_edge, in_item, in_n = lists(j, i)
    alone = np.bincount(i[i == j], weights=n[i == j], minlength=m)
    right = np.bincount(i * classes + cls[j], weights=n, minlength=m * classes).reshape(m, classes)  # item followed by class
    left = np.bincount(j * classes + cls[i], weights=n, minlength=m * classes).reshape(m, classes)  # class followed by item
    table = np.bincount(cls[i] * classes + cls[j], weights=n, minlength=classes * classes).reshape(classes, classes)
    f = lambda x: x * np.log(np.maximum(x, 1))
    value = f(table)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not freq[w]:
                continue
            a = cls[w]
            self_n = alone[w]
            r, lft = right[w].copy(), left[w].copy()
            r[a] -= self_n
            lft[a] -= self_n
            # take the item out of its class
            table[a, :] -= r
            table[:, a] -= lft
            table[a, a] -= self_n
            value[a, :], value[:, a] = f(table[a, :]), f(table[:, a])
            # the class totals with the item's neighbours, wherever it goes
            rows, cols = table.sum(1) + lft, table.sum(0) + r
            # gain of putting it into each class b: its row, its column and its corner change
            some, more = np.flatnonzero(r), np.flatnonzero(lft)
            diag, own = np.diag(table), np.diag(value)
            gain = (f(table[:, some] + r[some]) - value[:, some]).sum(1) + (f(table[more, :] + lft[more, None]) - value[more, :]).sum(0)
            gain += f(diag + r + lft + self_n) - f(diag + r) - f(diag + lft) + own
            out_all, in_all = r.sum() + self_n, lft.sum() + self_n
            gain -= (f(rows + out_all) - f(rows)) + (f(cols + in_all) - f(cols))
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            r[b] += self_n
            lft[b] += self_n
            table[b, :] += r
            table[:, b] += lft
            table[b, b] -= self_n
            value[b, :], value[:, b] = f(table[b, :]), f(table[:, b])
            if b != a:
                cls[w], moved = b, moved + 1
                at = slice(in_edge[w], in_edge[w + 1])
                right[in_item[at], a] -= in_n[at]
                right[in_item[at], b] += in_n[at]
                at = slice(out_edge[w], out_edge[w + 1])
                left[out_item[at], a] -= out_n[at]
                left[out_item[at], b] += out_n[at]
        if not moved:
            break
    return cls


class Model:
    """Classes, transitions and emissions, all of bounded size, with the corpus totals."""

    def __init__(self, classes: Classes, table: np.ndarray, tokens: int, types: int, class_types: np.ndarray, known: np.ndarray, settings: Settings):
        k = len(table)
        size = table.sum(0)
        unigram = (size + 1) / (size.sum() + k)
        before = table.sum(1, keepdims=True)
        self.log_transition = np.log10((table + settings.fade * unigram) / (before + settings.fade))
        # the end has one type and no unseen words; every other class keeps one for those
        unseen = np.where(np.arange(k) == 0, 0, 1)
        self.log_class = np.log10(np.maximum(size + class_types + unseen, 1))
        self.classes, self.known = classes, known
        self.tokens, self.types, self.settings = tokens, types, settings


def frequent_words(words: DataFrame, most: int) -> pd.DataFrame:
    """key and c of the ``most`` frequent words, by count and key, from columns key and c.

    They are found by a cut in the counts' distribution, which needs no global sort; of the
    words at the cut, those whose hash is in the share that there is room for.
    """
    scale = words.groupBy(F.floor(F.log("c") * 50).alias("b")).count().orderBy(F.desc("b")).collect()
    bin_, room = F.floor(F.log("c") * 50), most
    taken = F.lit(False)
    for r in scale:
        if r["count"] > room:
            share = int((1 << 30) * room / r["count"])
            taken = taken | ((bin_ == r["b"]) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share))
            break
        room -= r["count"]
        taken = bin_ >= r["b"]
    found = words.where(taken).select("key", "c").toPandas()
    return found.sort_values(["c", "key"], ascending=[False, True], ignore_index=True).head(most)


def fit(texts: DataFrame, settings: Settings | None = None) -> tuple[Model, DataFrame]:
    """The model and the stored table of all word counts.  ``texts`` has the text alone."""
    s = settings or Settings()
    counts = materialize(word_counts(texts, s), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    words = counts.where("key != 0")
    top = frequent_words(words, s.known)
    as_keys = lambda x: x.to_numpy(np.int64).view(np.uint64)
    item_words = as_keys(top["key"][: s.words])
    last = int(top["c"].iloc[len(item_words) - 1]) if len(item_words) else 0
    tails = words.where(F.col("c") <= last).groupBy("tail").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "tail").limit(s.endings).toPandas()
    items = Items(item_words, as_keys(tails["tail"]))
    del tails, words
    i, j, n = item_bigrams(texts, items, s)
    cls = exchange_cells(i, j, n, items.size, s.classes, s.sweeps)
    k = int(cls.max()) + 1
    table = np.bincount(cls[i] * k + cls[j], weights=n, minlength=k * k).reshape(k, k)
    del i, j, n
    order = np.argsort(as_keys(top["key"]))
    keys, known = as_keys(top["key"])[order], top["c"].to_numpy(np.int64)[order]
    classes = Classes(items, cls, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(keys) > len(item_words):
        classes = Classes(items, cls, keys, assign(texts, classes, keys, table, s))
        table = class_bigrams(texts, classes, s)
    # distinct words of each class, over the whole table
    handle = texts.sparkSession.sparkContext.broadcast(classes)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(handle.value.count, np.int64)
        for batch in batches:
            keys, tails = (batch.column(x).to_numpy().view(np.uint64) for x in ("key", "tail"))
            n += np.bincount(handle.value.of(keys, tails, keys != END), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["cls", "n"])

    class_types = np.zeros(k, np.int64)
    for r in counts.select("key", "tail").mapInArrow(classify, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n")).collect():
        class_types[r["cls"]] = r["n"]
    if not len(classes.keys):
        # every known word is an item
        classes = Classes(items, cls, keys, classes.of(keys, np.zeros(len(keys), np.uint64), np.ones(len(keys), bool)))
    return Model(classes, table, int(total["n"] or 0), int(total["v"] or 0), class_types, known, s), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """Columns doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities; base_score is the add-one unigram model.  A null text
    counts as empty and has the end token alone.  Repeated ids give a row each.
    """
    spark = docs.sparkSession
    end_count = counts.where("key = 0").select("c").first()
    end_n = int(end_count["c"]) if end_count else 0
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    handle = spark.sparkContext.broadcast((model, end_n))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end_n = handle.value
        for batch in batches:
            for rows, block in tk.blocks(batch.column(1)):
                keys, tails, first, is_word = _tokens(block, model.settings.tail)
                n = len(block)
                own = tk.owners(first)
                cls, place, there = model.classes.places(keys, tails, is_word)
                before = _before(cls, first)
                c = np.where(is_word, np.where(there, model.known[place] if len(model.known) else 0, 0), end_n)
                found = there | ~is_word
                part = np.where(found, np.log10(c + 1.0), 0)
                chain = model.log_transition[before, cls] - model.log_class[cls]
                sums = lambda x, own=own, n=n: np.bincount(own, weights=x, minlength=n)
                # words to be looked up in the whole table: distinct per text, with counts
                rare, at = keys[~found], own[~found]
                order = np.lexsort((rare, at))
                rare, at = rare[order], at[order]
                fresh = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (at[1:] != at[:-1]))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(fresh, len(rare)))
                edge = np.searchsorted(at[fresh], np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(tk.signed(rare[fresh])))
                ns = pa.ListArray.from_arrays(pa.array(edge), pa.array(times.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows.start : rows.stop], pa.array(np.diff(first)), pa.array(sums((found & (c > 0)).astype(float)).astype(np.int64)), pa.array(sums(part)), pa.array(sums(chain)), lists, ns],
                    names=["doc_id", "n_tokens", "n_known", "part", "chain", "rare", "times"],
                )

    rows = slim.mapInArrow(local, f"doc_id {kind}, n_tokens long, n_known long, part double, chain double, rare array<long>, times array<int>")
    # a stored row number, as ids may repeat or be null
    stored = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    flat = stored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("k"))
    found = flat.join(counts.select("key", "c"), "key").groupBy("row").agg(F.sum("k").cast("long").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("rest"))
    whole = stored.drop("rare", "times").join(found, "row", "left").withColumns({"more": F.coalesce("more", F.lit(0)), "rest": F.coalesce("rest", F.lit(0.0))})
    bottom = float(np.log10(model.tokens + model.types + 1))
    logs = F.col("part") + F.col("rest")
    out = whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), (logs + F.col("chain")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def free(spark, counts: DataFrame) -> None:
    discard(spark, counts)
