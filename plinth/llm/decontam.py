"""Benchmark decontamination with suffix arrays over training shards.

Every block of training text (a shard) gets a word-level suffix array.  Every suffix of
every test item is binary-searched in it, which gives each training suffix's two neighbours and so
every document's longest verbatim match and, for runs of at least ``window`` words, all
places where they occur.  A shard never leaves the
task that reads it, so the documents are neither shuffled nor collected.

The arrays are sparse: only suffixes that begin with a word pair of the test text (or with
the word of a one-word item) are sorted, because no other suffix can match two words.  They
are ordered by as many words as the longest test item has, beyond which no comparison goes.

The test items travel to the tasks in blocks of at most ``block_bytes`` of text (a longer item
is a block of its own) as numbered words and places in them, so what is broadcast has a fixed
bound whatever the size of the benchmark; further blocks make further passes whose results
are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .storage import materialize, small_side, unused

#: Consecutive item words that make a window; a shorter item is one window.
WINDOW = 13
#: Bytes of test text in a block.  A block travels as about ten times as many bytes.
BLOCK_BYTES = 8 << 20
_NONE = np.int32(-1)


def _suffix_ranks(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rank of the suffix at each word among all that end with their item (``end``: end of
    each word's item); equal suffixes share a rank.  Prefix doubling, linear memory."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].reshape(-1).astype(np.int64) if n else np.zeros(0, np.int64)
    at, step = np.arange(n), 1
    longest = int((end - at).max(initial=0))
    while step < longest:
        after = np.where(at + step < end, rank[np.minimum(at + step, n - 1)] + 1, 0)
        rank = np.unique(rank * np.int64(n + 2) + after, return_inverse=True)[1].reshape(-1).astype(np.int64)
        step *= 2
    return rank


class TestSet:
    """One block of test items, ready for search.

    Suffixes and windows are places in one array of word numbers, so the whole takes some
    fifty bytes a word however long an item is.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        texts = tk.Texts.of([t for _, t in items]).lower()
        starts, ends, first = texts.spans(tk.NON_ALNUM)
        hashes = texts.hashes(starts, ends)
        self.vocabulary = np.unique(hashes)
        words = np.searchsorted(self.vocabulary, hashes).astype(np.int32)
        length = np.diff(first)
        self.depth = int(length.max(initial=1))
        self.words = np.append(words, _NONE)
        own = tk.owners(first)
        at = np.arange(len(words))
        left = first[1:][own] - at
        # distinct suffixes in order
        _, self.suffixes = np.unique(_suffix_ranks(words, first[1:][own]), return_index=True)
        self.lengths = left[self.suffixes]
        # windows: the places that begin one, equal ones once, and the items of each
        begin = (left >= window) | ((length[own] < window) & (at == first[:-1][own]))
        place = np.flatnonzero(begin)
        size = np.minimum(left[place], window)
        key = np.zeros(len(place), np.uint64)
        for k in range(window):
            more = size > k
            key[more] = tk.mix(key[more] + hashes[place[more] + k])
        key = tk.mix(key ^ size.astype(np.uint64))
        _, lead, back = np.unique(key, return_index=True, return_inverse=True)
        self.windows, self.window_size = place[lead], size[lead]
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        named = np.array([number.get(i, -1) for i, _ in items], np.int64)[own[place]] if len(place) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([back.reshape(-1), named], 1)[named >= 0], axis=0) if len(place) else np.zeros((0, 2), np.int64)
        self.item_edge = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.items = pairs[:, 1].astype(np.int32)
        two = np.flatnonzero(left >= 2)
        self.seeds = np.unique(words[two].astype(np.int64) << 32 | words[two + 1] if len(two) else np.zeros(0, np.int64))
        self.single = np.unique(words[np.flatnonzero(length[own] == 1)])

    def shard_words(self, texts: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = texts.spans(tk.NON_ALNUM)
        place, there = tk.member(texts.hashes(starts, ends), self.vocabulary)
        return np.where(there, place, _NONE - 1).astype(np.int32), first


class SuffixArray:
    """Sorted suffixes of one shard; a suffix ends with its document."""

    def __init__(self, words: np.ndarray, first: np.ndarray, tests: TestSet):
        self.depth, self.tests = tests.depth, tests
        # room to read past the end, and -2 for words that no item has
        self.words = np.append(words, np.full(self.depth + 1, _NONE - 1, np.int32))
        self.end = np.repeat(first[1:], np.diff(first))
        n = len(words)
        pair = self.words[:n].astype(np.int64) << 32 | self.words[1 : n + 1].astype(np.int64) & 0xFFFFFFFF
        known = words >= 0
        begin = tk.member(pair, tests.seeds)[1] & known & (np.arange(1, n + 1) < self.end)
        if len(tests.single):
            begin |= tk.member(words, tests.single)[1]
        at = np.flatnonzero(begin)
        # order by one more word at a time, only among suffixes that still tie
        rank = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        for k in range(self.depth):
            if not len(open_):
                break
            key = rank[open_] * (len(tests.vocabulary) + 3) + self._word(at[open_], k) + 2
            order = np.argsort(key, kind="stable")
            key = key[order]
            fresh = np.append(True, key[1:] != key[:-1])
            group = np.cumsum(fresh) - 1
            # a suffix's rank: how many suffixes stand before its group
            begins = np.flatnonzero(fresh)
            base = rank[open_[order]]
            lead = base[begins]
            offset = begins - begins[np.searchsorted(lead, lead)]
            rank[open_[order]] = base + offset[group]
            size = np.diff(np.append(begins, len(key)))
            done = (size == 1)[group] | (self._word(at[open_[order]], k) < 0)
            open_ = np.sort(open_[order[~done]])
        self.suffixes = at[np.argsort(rank, kind="stable")]

    def _word(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k-th word of suffixes; -1 beyond the document, -2 for a word of no item."""
        place = np.minimum(at + k, len(self.words) - 1)
        return np.where(at + k < self.end[at], self.words[place], _NONE).astype(np.int64)

    def _compare(self, at: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of suffix minus pattern (``length`` test words from ``begin``) over the
        pattern's length, and the common prefix."""
        sign, common = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        active, k = np.arange(len(at)), 0
        while len(active := active[length[active] > k]):
            d = self._word(at[active], k) - self.tests.words[begin[active] + k]
            same = d == 0
            sign[active[~same]] = np.sign(d[~same])
            active = active[same]
            k += 1
            common[active] = k
        return sign, common

    def bound(self, begin: np.ndarray, length: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of all patterns at once: first suffix not below (right: above)."""
        lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.suffixes))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            sign, _ = self._compare(self.suffixes[mid], begin[open_], length[open_])
            below = sign <= 0 if right else sign < 0
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo

    def longest(self) -> np.ndarray:
        """Longest verbatim match of each suffix with any test suffix, which are sorted.

        A suffix shares most with one of the two test suffixes that it stands between."""
        begin, length = self.tests.suffixes, self.tests.lengths
        best = np.zeros(len(self.suffixes), np.int64)
        if not len(best) or not len(begin):
            return best
        spot = self.bound(begin, length, False)
        after = np.searchsorted(spot, np.arange(len(best)), side="right")
        for near in (after - 1, after):
            ok = np.flatnonzero((near >= 0) & (near < len(begin)))
            _, common = self._compare(self.suffixes[ok], begin[near[ok]], length[near[ok]])
            best[ok] = np.maximum(best[ok], common)
        return best


def _search(tests: TestSet, texts: tk.Texts) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set], np.ndarray, np.ndarray]:
    """Per document of a shard: words, merged hit intervals, items, longest match and where."""
    words, first = tests.shard_words(texts)
    n = len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set] = [set() for _ in range(n)]
    longest, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    array = SuffixArray(words, first, tests)
    if len(array.suffixes):
        own = tk.owners(first)
        best = array.longest()
        some = np.flatnonzero(best > 1)
        at = array.suffixes[some]
        # of each document the longest match, and the first of several
        order = np.lexsort((at, -best[some], own[at]))
        docs, lead = np.unique(own[at[order]], return_index=True)
        longest[docs], where[docs] = best[some[order[lead]]], at[order[lead]] - first[docs]
        lo = array.bound(tests.windows, tests.window_size, False)
        hi = array.bound(tests.windows, tests.window_size, True)
        hit = np.zeros(len(words) + 1, np.int64)
        for k in np.flatnonzero(hi > lo):
            size = int(tests.window_size[k])
            found = array.suffixes[lo[k] : hi[k]]
            hit[found] += 1
            np.subtract.at(hit, found + size, 1)
            mine = tests.items[tests.item_edge[k] : tests.item_edge[k + 1]].tolist()
            for d in np.unique(own[found]).tolist():
                items[d].update(mine)
        covered = np.cumsum(hit)[: len(words)] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        # documents stand next to each other, so an interval may have to be cut at a border
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while a < b:
                d = int(own[a])
                cut = min(b, int(first[d + 1]))
                spans[d].append((a - int(first[d]), cut - int(first[d])))
                a = cut
    return np.diff(first), spans, items, longest, where


MATCHES = "doc_id {kind}, h long, n_words long, spans array<array<long>>, items array<string>, longest long, longest_at long"


def _pass(slim: DataFrame, tests: TestSet) -> DataFrame:
    kind = slim.schema["doc_id"].dataType.simpleString()
    handle = slim.sparkSession.sparkContext.broadcast(tests)
    out = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in tk.blocks(batch.column(2)):
                n_words, spans, items, longest, where = _search(handle.value, texts.lower())
                cut = slice(rows.start, rows.stop)
                found = [pa.array(n_words), pa.array(spans, out.field(1).type), pa.array([sorted(handle.value.names[i] for i in x) for x in items], out.field(2).type), pa.array(longest), pa.array(where, mask=where < 0)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[cut], batch.column(1)[cut], *found], names=["doc_id", "h", *out.names])

    return slim.mapInArrow(scan, MATCHES.format(kind=kind))


def matches(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: words, hit word intervals, items with windows in it, longest match.

    Columns: doc_id, n_words, spans (array of [start, end) in words, merged), items (sorted
    ids as strings), longest (words of the longest verbatim match with any item, 0 if under
    two), longest_at (first word of it, null if none).  A null or empty text has no words
    and no hits; null or empty items have no windows; an item with a null id hits words but
    is not listed; repeated items count once, repeated documents give a row each.  An empty
    benchmark leaves every document clean.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    volume = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    n_blocks = max(1, -(-volume // block_bytes))
    h = F.lit(0).cast("long") if n_blocks == 1 else F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slim = docs.select(F.col(doc_id).alias("doc_id"), h.alias("h"), F.col(text).alias("t"))
    parts = []
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(n_blocks)) == b)
        rows = sorted({(r["item"], r["t"]) for r in block.distinct().collect()}, key=lambda x: (x[0] or "", x[1]))
        parts.append(_pass(slim, TestSet(rows, window)).withColumn("b", F.lit(b)))
    if n_blocks == 1:
        return parts[0].drop("h", "b")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    # rows of equal id and text have equal results: once per block, then the blocks together
    values = ["n_words", "spans", "items", "longest", "longest_at"]
    once = whole.groupBy("doc_id", "h", "b").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in values])
    key = F.struct("longest", (-F.col("longest_at")).alias("m"))
    merged = once.groupBy("doc_id", "h").agg(
        F.max("c").alias("c"), F.max("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max(key).alias("k"),
    )
    joined = F.expr(
        "aggregate(spans, cast(array() as array<array<bigint>>), (acc, s) -> if(size(acc) > 0 and s[0] <= element_at(acc, -1)[1],"
        " concat(slice(acc, 1, size(acc) - 1), array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], s[1])))), concat(acc, array(s))))"
    )
    rows = merged.select(F.explode(F.sequence(F.lit(1), F.col("c"))), "*")
    return rows.select("doc_id", "n_words", joined.alias("spans"), "items", F.col("k.longest").alias("longest"), (-F.col("k.m")).alias("longest_at"))


def verdicts(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (at least a twentieth hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever their names.

    Rows are judged by id and text, as ids may repeat or be null.
    """
    h, a, b, i = unused(docs, "_h", "_a", "_b", "_i")
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.select(F.struct(F.col(doc_id).alias("i"), digest.alias("h")).alias("k"), F.col(text).alias("t"))
    bad = verdicts(matches(keyed, benchmark, doc_id="k", text="t", **options)).where("contaminated")
    gone = materialize(bad.select(F.col("doc_id.i").alias(a), F.col("doc_id.h").alias(b)).distinct(), "contaminated")
    marked = docs.withColumns({i: F.col(doc_id), h: digest})
    return marked.join(small_side(gone), F.col(i).eqNullSafe(F.col(a)) & (F.col(h) == F.col(b)), "left_anti").drop(i, h)
