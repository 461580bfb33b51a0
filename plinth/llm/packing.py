"""Packing token pieces into sequences by linear grouping and best fit.

Sizes are whole numbers up to the sequence length, so the whole packing problem is its size
histogram: at most ``capacity`` counts, whatever the number of documents.  The driver solves
that problem, the tasks only look their places up:

1. sizes of at least ``large`` are split into groups of equal cardinality and rounded up to
   their group's largest size,
2. configurations (multisets of few sizes that fit a sequence) are chosen by a linear
   programme with column generation and used as often as its optimum says in whole numbers,
3. actual sizes take the rounded slots, which leaves gaps; what rounding down leaves over goes
   through the same steps again, by closer groups each time,
4. the few sizes left and the small ones, largest first, go to the tightest gap that holds
   them; new sequences open for what is left.

The solution is a list of runs: ``count`` consecutive sequences with the same sizes.  A
document finds its place by its rank among the documents of its size; ranks come from
range-partitioned rows and per-partition counts, so no size class meets in one task.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize
from .textkernel import BLOCK_BYTES, Texts, blocks, lean, member, trim

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"
#: Groups of large sizes at most, sizes that a group holds on average at least, and the share of
#: large sizes that may be left to best fit.
GROUPS, _A_GROUP, _LEFT = 384, 3, 0.01
_TINY = 1e-7


# ---------------------------------------------------------------- tokens


#: White space of ASCII.
_SPACES = np.zeros(256, bool)
_SPACES[[*range(0x09, 0x0E), 0x20]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True
#: Texts that are encoded whole: with the mark of a special token, or with white space beyond
#: ASCII, which may join runs.
_WHOLE = re.compile(rb"<\||\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Different parts whose ids a worker remembers, some 50 bytes each, and parts encoded at once.
_REMEMBERED, _AT_ONCE = 1 << 20, 1 << 12


def unit_starts(texts: Texts) -> np.ndarray:
    """Where the tokenizer's own pattern cuts, or some of these places, so that the parts
    between them give one by one the ids of the whole.

    A run of white space begins a part; its last character begins one too and goes with what
    follows if it is a space; a mark behind an ASCII letter or digit begins one.
    """
    flat, n = texts.flat, len(texts.flat)
    space = _SPACES[flat]
    begins, ends = (np.zeros(n, bool) for _ in range(2))
    bounds = texts.offsets
    begins[bounds[:-1][bounds[:-1] < n]] = True
    ends[bounds[1:][bounds[1:] > 0] - 1] = True
    before = np.zeros(n, bool)
    before[1:] = space[:-1]
    after = np.zeros(n, bool)
    after[:-1] = space[1:]
    cut = begins | (space & ~before) | (space & ~after & ~ends)
    cut[1:] |= ~space[1:] & space[:-1] & (flat[:-1] != 0x20)
    cut[1:] |= _MARKS[flat[1:]] & _LETTERS[flat[:-1]]
    return np.flatnonzero(cut)


class _Encoder:
    """Token ids of a tokenizer file.

    Texts are cut where the tokenizer cuts them too, and each different part is encoded once.
    Parts are told apart by 64-bit hashes.  When a worker has met very many it forgets them,
    which changes no id.
    """

    _made: dict[str, _Encoder] = {}

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    @classmethod
    def of(cls, name: str) -> _Encoder:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        # some thousand at a time, as each comes back as an object of many lists
        return [x.ids for lo in range(0, len(texts), _AT_ONCE) for x in self.tokenizer.encode_batch_fast(texts[lo : lo + _AT_ONCE], add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, parts: list[str]) -> None:
        found = self._encoded(parts)
        sizes = np.array([len(x) for x in found], np.int64)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.starts = np.insert(self.starts, place, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, place, sizes)
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), "<u4", int(sizes.sum()))])

    def block(self, texts: Texts) -> list[np.ndarray]:
        """The ids of each text of a block."""
        whole = [k for k in range(len(texts)) if _WHOLE.search(memoryview(texts.flat)[texts.offsets[k] : texts.offsets[k + 1]])]
        if len(self.keys) > _REMEMBERED:
            self._forget()
        starts = unit_starts(texts)
        ends = np.append(starts[1:], len(texts.flat))[: len(starts)]
        hashes = texts.hashes(starts, ends)
        keys, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        place, there = member(keys, self.keys)
        if not there.all():
            new = np.flatnonzero(~there)
            self._learn(keys[new], [texts.part(starts[k], ends[k]).decode() for k in first[new]])
            place, _ = member(keys, self.keys)
        at, size = self.starts[place][unit], self.sizes[place][unit]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(at - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.concatenate([[0], stop])[np.searchsorted(starts, texts.offsets)]
        out = [ids[a:b] for a, b in itertools.pairwise(bounds)]
        for k, found in zip(whole, self._encoded([texts.part(texts.offsets[k], texts.offsets[k + 1]).decode() for k in whole]), strict=True):
            out[k] = np.array(found, "<u4")
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.block(Texts.of([text]))[0]


def pieces(docs: DataFrame, *, doc_id="doc_id", text="text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token pieces of at most ``capacity``; only the first piece of a document is shorter.

    Columns: doc_id, piece, start, length, ids_crc32.  A null text counts as empty and has
    the end token alone.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(tokenizer)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for rows, block in blocks(batch.column(1), BLOCK_BYTES // 4):
                part = batch.slice(rows.start, rows.stop - rows.start)
                take, piece, start, length, crc = [], [], [], [], []
                for row, found in enumerate(encoder.block(block)):
                    ids = np.concatenate([found, end])
                    head = len(ids) % capacity or capacity
                    cuts = [0, *range(head, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        take.append(row), piece.append(k), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                columns = [part.column(0).take(pa.array(take, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return slim.mapInArrow(lean(encode), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the plan


class Run:
    """``count`` sequences that hold the same sizes, each with ``gap`` free."""

    __slots__ = ("count", "gap", "sizes")

    def __init__(self, sizes: tuple[int, ...], count: int, capacity: int):
        self.sizes, self.count, self.gap = sizes, count, capacity - sum(sizes)


def _priced(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """For each size the configuration of most value that holds it, where that is worth more
    than a sequence: one unbounded knapsack over the rounded sizes prices them all."""
    least = int(sizes.min())
    worth = np.full(capacity + 1, -1.0)
    worth[sizes] = np.maximum(values, 0)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(least, capacity + 1):
        gain = worth[least : room + 1] + best[room - least :: -1]
        k = gain.argmax()
        if gain[k] > best[room - 1]:
            best[room], pick[room] = gain[k], least + k
        else:
            best[room] = best[room - 1]
    place = {int(s): k for k, s in enumerate(sizes)}
    found = set()
    for s in sizes[values + best[capacity - sizes] > 1 + _TINY].tolist():
        column, at = [0] * len(sizes), capacity - s
        column[place[s]] += 1
        while at >= least:
            if pick[at]:
                column[place[int(pick[at])]] += 1
                at -= int(pick[at])
            else:
                at -= 1
        found.add(tuple(column))
    return np.array(sorted(found), float).reshape(len(found), len(sizes))


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Few-size configurations and how often each is to be used, as a fractional optimum.

    Column generation for the covering programme; the basis has one column a size.  The pool of
    columns begins with those of a best-fit packing of the rounded sizes; when none of them is
    an improvement any more, the knapsack adds new ones.
    """
    g = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    level = inverse @ demand
    place = {int(s): k for k, s in enumerate(sizes)}
    pool = np.array(sorted({tuple(np.bincount([place[s] for s in r.sizes], minlength=g)) for r in best_fit(dict(zip(map(int, sizes), map(int, demand), strict=True)), [], capacity)}), float)
    for pivots in range(1, 40 * g + 1):
        dual = inverse.sum(axis=0)
        gain = pool @ dual
        k = int(gain.argmax()) if len(gain) else -1
        if k < 0 or gain[k] <= 1 + _TINY:
            made = _priced(dual, sizes, capacity)
            if not len(made):
                break
            pool = np.concatenate([pool[gain > 1 - 0.1], made])
            continue
        step = inverse @ pool[k]
        ratio = np.where(step > 1e-9, np.maximum(level, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = pool[k]
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        if pivots % 100 == 0:
            inverse = np.linalg.inv(basis)
        level = inverse @ demand
    return [(np.rint(basis[:, k]).astype(np.int64), float(max(level[k], 0))) for k in range(g)]


def _groups(left: dict[int, int], groups: int) -> list[list[int]]:
    """The sizes in order, in groups of about equal cardinality; a size is never split."""
    total = sum(left.values())
    cut, seen, out, last = total / groups, 0, [], None
    for s in sorted(left):
        k = min(int(seen // cut), groups - 1)
        seen += left[s]
        if k != last:
            out.append([])
            last = k
        out[-1].append(s)
    return out


def _substitute(pattern: np.ndarray, times: int, queues: list[list[list[int]]], capacity: int) -> list[Run]:
    """Runs of ``times`` sequences with the actual sizes, largest first, of the groups that a
    configuration names."""
    streams = []
    for k in np.flatnonzero(pattern)[::-1]:
        for _ in range(pattern[k]):
            need, taken = times, []
            while need:
                head = queues[k][0]
                n = min(need, head[1])
                taken.append((head[0], n))
                head[1] -= n
                need -= n
                if not head[1]:
                    queues[k].pop(0)
            streams.append(taken)
    runs, place, done = [], [[0, 0] for _ in streams], 0
    while done < times:
        n = min(t[p[0]][1] - p[1] for t, p in zip(streams, place, strict=True))
        runs.append(Run(tuple(t[p[0]][0] for t, p in zip(streams, place, strict=True)), n, capacity))
        done += n
        for t, p in zip(streams, place, strict=True):
            p[1] += n
            if p[1] == t[p[0]][1]:
                p[0], p[1] = p[0] + 1, 0
    return runs


def grouped(large: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[Run], dict[int, int]]:
    """Sequences of configurations over linear groups, and the sizes that are left over.

    Whole parts of the optimum are used at once.  What rounding down leaves is grouped anew, so
    by fewer and closer sizes, and solved again, where the largest fractions count as whole; in
    the end a few sizes are left.
    """
    left = {s: n for s, n in large.items() if n > 0}
    runs: list[Run] = []
    few = _LEFT * sum(left.values())
    while sum(left.values()) > few:
        members = _groups(left, max(8, min(groups, sum(left.values()) // _A_GROUP)))
        tops = np.array([m[-1] for m in members])
        demand = np.array([sum(left[s] for s in m) for m in members])
        queues = [[[s, left[s]] for s in sorted(m, reverse=True)] for m in members]
        found = sorted(configurations(tops, demand, capacity), key=lambda x: (-x[1], tuple(x[0])))
        whole = any(level >= 1 - 1e-7 for _, level in found)
        before, tight = int(demand.sum()), capacity // 64
        for pattern, level in found:
            times = int(np.floor(level + (1e-7 if whole else 0.5)))
            fits = pattern > 0
            if times and fits.any() and (whole or capacity - int((pattern * tops).sum()) <= tight):
                times = min(times, int((demand[fits] // pattern[fits]).min()))
                if times:
                    runs += _substitute(pattern, times, queues, capacity)
                    demand = demand - pattern * times
        left = {s: n for q in queues for s, n in q}
        if int(demand.sum()) == before:
            break
    return runs, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int | None = None, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences that hold every size as often as the histogram says."""
    large = capacity // 8 if large is None else large
    left = {int(s): int(n) for s, n in histogram.items() if n > 0}
    runs = [Run((s,), n, capacity) for s, n in left.items() if s == capacity]
    made, rest = grouped({s: n for s, n in left.items() if large <= s < capacity}, capacity, groups)
    # the sizes left over and the small ones go to the tightest gaps
    runs = best_fit(rest | {s: n for s, n in left.items() if s < large}, runs + made, capacity)
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for r in runs:
        merged[tuple(sorted(r.sizes, reverse=True))] += r.count
    return [Run(sizes, n, capacity) for sizes, n in sorted(merged.items(), reverse=True)]


def best_fit(left: dict[int, int], runs: list[Run], capacity: int) -> list[Run]:
    """``runs`` with the sizes in ``left`` added, largest first, each in the tightest gap that
    holds it; new sequences open for what has none."""
    by_gap: dict[int, list[Run]] = defaultdict(list)
    for r in runs:
        by_gap[r.gap].append(r)
    for s in sorted((s for s in left if left[s]), reverse=True):
        need = left[s]
        gaps = sorted(g for g in by_gap if g >= s and by_gap[g])
        while need:
            while gaps and not by_gap[gaps[0]]:
                gaps.pop(0)
            if gaps:
                run = by_gap[gaps[0]].pop()
            else:
                # as many new sequences as the size fills, or one for the rest
                run = Run((), max(1, need // (capacity // s)), capacity)
            each = max(1, min(run.gap // s, need // run.count))
            n = min(run.count, need // each)
            if n < run.count:
                rest = Run(run.sizes, run.count - n, capacity)
                by_gap[rest.gap].append(rest)
            full = Run((*run.sizes, *[s] * each), n, capacity)
            by_gap[full.gap].append(full)
            if full.gap >= s and full.gap not in gaps:
                gaps = sorted({*gaps, full.gap})
            need -= each * n
    return [r for rs in by_gap.values() for r in rs if r.count]


class Places:
    """Looks up sequence and offset by size and rank; of the size of the plan."""

    def __init__(self, runs: list[Run]):
        rows = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        base = 0
        for r in runs:
            offset = 0
            for s in r.sizes:
                rows[s].append((used[s], base, offset))
                used[s] += r.count
                offset += s
            base += r.count
        self.sequences = base
        self.table = {s: np.array(x, np.int64) for s, x in rows.items()}

    def find(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.table[size]
        k = np.searchsorted(t[:, 0], rank, side="right") - 1
        return t[k, 1] + rank - t[k, 0], t[k, 2]


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, *, doc_id="doc_id", text="text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every token piece with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Repeated rows
    are packed as often as they occur, null ids included; an empty table gives no rows.
    Sequences are gapless from offset 0.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, doc_id=doc_id, text=text, capacity=capacity, tokenizer=tokenizer), "pack-pieces")
    kind = cut.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                mine = np.flatnonzero(size == s)
                rank[mine] = seen.get(s, 0) + np.arange(len(mine))
                seen[s] = seen.get(s, 0) + len(mine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "rank"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = cut.withColumn("salt", F.xxhash64("doc_id", "piece", "ids_crc32")).repartitionByRange(parts, "length", "salt").drop("salt")
    ranked = spread.mapInArrow(number, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long")
    ranked = materialize(ranked.withColumn("part", F.spark_partition_id()), "pack-ranked")
    # sizes are ranges of partitions: at most capacity + partitions rows
    counts = ranked.groupBy("length", "part").agg((F.max("rank") + 1).alias("n")).orderBy("length", "part").collect()
    histogram: dict[int, int] = defaultdict(int)
    before: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counts:
        before[r["part"]][r["length"]] = histogram[r["length"]]
        histogram[r["length"]] += r["n"]
    places = Places(plan(histogram, capacity))
    trim()
    handle = spark.sparkContext.broadcast((dict(before), places))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, places = handle.value
        for batch in batches:
            size, part = batch.column("length").to_numpy(), batch.column("part").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for key in np.unique(size * (1 << 32) + part).tolist():
                s, p = key >> 32, key & 0xFFFFFFFF
                mine = np.flatnonzero((size == s) & (part == p))
                sequence[mine], offset[mine] = places.find(s, rank[mine] + before[p][s])
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    discard(spark, cut)
    return ranked.mapInArrow(lean(seat), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
