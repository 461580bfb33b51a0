"""Compression of vectors to codes: per part of a vector the index of its nearest entry.

Components are scaled to integers and all sums and distances are integers, so codes, codebooks
and errors are the same for any layout of the rows.  Nearest entries are found in a
vantage-point tree over the entries of each part position by branch and bound.  Its radii are
rounded outward to integers, and a branch is visited as long as its bound does not exceed the
best distance (ties included, which go to the lower index); distances themselves are exact.

The rows are stored once as integers and each round reads them in place: a task keeps sums and
counts by entry, which is all that is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import is_small, materialize, spread_join

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers below this take the fast path; squares of differences of 2^12 of them fit 64 bits.
_NARROW = 1 << 24
_MOST_WIDTH = 1 << 12
#: Sums travel as three limbs of so many bits.
_LIMB = 50
_LONG = (1 << 63) - 1
_root = np.frompyfunc(math.isqrt, 1, 1)


def _roots(squares: np.ndarray) -> np.ndarray:
    """Exact floors of the square roots of integers."""
    if squares.dtype == object:
        return _root(squares)
    x = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    x -= x * x > squares
    return x + ((x + 1) * (x + 1) <= squares)


def _squares(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = rows - entry
    return (d * d).sum(axis=1)


class Tree:
    """Vantage-point tree over the entries of one part position.

    A node holds one entry; the others of its branch are halved by their distance from it.
    ``visited`` counts the distances computed.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.visited = 0
        self.top = self._node(list(range(len(entries))))

    def _node(self, members: list[int]):
        if not members:
            return None
        at, rest = members[0], members[1:]
        squares = {k: int(_squares(self.entries[k : k + 1], self.entries[at])[0]) for k in rest}
        rest.sort(key=lambda k: (squares[k], k))
        halves = []
        for half in (rest[: len(rest) // 2], rest[len(rest) // 2 :]):
            if half:
                low, high = math.isqrt(squares[half[0]]), squares[half[-1]]
                root = math.isqrt(high)
                # rounded outward: down for the nearest member, up for the farthest
                halves.append((low, root + (root * root < high), self._node(sorted(half))))
        return at, halves

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index and squared distance of each row's nearest entry."""
        n = len(rows)
        if not len(self.entries) or not n:
            return np.zeros(n, np.int64), np.zeros(n, rows.dtype)
        if rows.dtype != self.entries.dtype:
            rows = rows.astype(object)
        best = _squares(rows, self.entries[0])
        found = np.zeros(n, np.int64)
        self._search(self.top, rows, np.arange(n), best, found)
        return found, best

    def _search(self, node, rows, at, best, found) -> None:
        if node is None or not len(at):
            return
        entry, halves = node
        squares = _squares(rows[at], self.entries[entry])
        self.visited += len(at)
        better = (squares < best[at]) | ((squares == best[at]) & (entry < found[at]))
        best[at[better]], found[at[better]] = squares[better], entry
        if not halves:
            return
        low = _roots(squares)
        high = low + (low * low < squares)
        # rows nearer to a half's ring go there first, which tightens their bound for the other
        inner = low <= halves[0][1]
        for group, order in ((inner, halves), (~inner, halves[::-1])):
            here = np.flatnonzero(group.astype(bool))
            for nearest, farthest, child in order:
                bound = np.maximum(np.maximum(low[here] - farthest, nearest - high[here]), 0)
                open_ = (bound * bound <= best[at[here]]).astype(bool)
                self._search(child, rows, at[here[open_]], best, found)


@dataclass
class Codebooks:
    """Entries by part position: arrays of (entries, width), of plain or unbounded integers."""

    entries: list[np.ndarray]
    width: int
    length: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for x in part.ravel()).encode()).hexdigest()


def _whole(values, dtype=None) -> np.ndarray:
    """Integers as 64-bit ones where squares of their differences surely fit, else unbounded."""
    a = np.asarray(values, object)
    narrow = all(-_NARROW < x < _NARROW for x in a.ravel())
    return a.astype(np.int64) if narrow and a.ndim == 2 and a.shape[1] <= _MOST_WIDTH else a


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite floats; exact, as the scale is a power of two."""
    if not len(values) or np.abs(values).max() < _NARROW / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([math.floor(_exact(float(x))) for x in values], object)


def _exact(x: float):
    top, bottom = x.as_integer_ratio()
    return top * SCALE // bottom


def _batches(column: pa.Array, books: Codebooks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their integers by (row, part, position), plain rows before others.
    The last part is filled up with zeros."""
    n, length, parts, width = len(column), books.length, len(books.entries), books.width
    if not n:
        return
    values = column.values.slice(column.offsets[0].as_py(), n * length)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, length)
    wide = (np.abs(flat) >= _NARROW / SCALE).any(axis=1) if length else np.zeros(n, bool)
    for group in (~wide, wide):
        at = np.flatnonzero(group)
        if len(at):
            made = _integers(flat[at].ravel()).reshape(len(at), length)
            full = np.zeros((len(at), parts * width), made.dtype)
            full[:, :length] = made
            yield at, full.reshape(len(at), parts, width)


def clean(rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, v: the rows whose vector is neither null nor empty and holds neither null
    nor non-finite components."""
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(sound)


def first_entries(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """Those parts of the vectors of the smallest ids (nulls last; of equal ids the smaller
    vector).  Fewer rows give fewer entries."""
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    length = len(first[0]) if first else 0
    width = -(-length // parts)
    whole = [list(map(int, _integers(np.array(v, np.float64)))) + [0] * (parts * width - length) for v in first if len(v) == length]
    return Codebooks([_whole([v[p * width : (p + 1) * width] for v in whole]).reshape(len(whole), width) for p in range(parts)], width, length)


def _limbs(x: int) -> tuple[int, int, int]:
    mask = (1 << _LIMB) - 1
    return x & mask, (x >> _LIMB) & mask, x >> (2 * _LIMB)


def refine(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts nearest to it; one without
    parts stays."""
    width, length = books.width, books.length
    sizes = [len(e) for e in books.entries]

    def task(batches):
        trees = [Tree(e) for e in books.entries]
        sums = [np.zeros((k, width + 1), object) for k in sizes]
        for batch in batches:
            for at, ints in _batches(batch.column(0), books):
                for p, tree in enumerate(trees):
                    found, _ = tree.nearest(ints[:, p])
                    _add(sums[p], found, ints[:, p])
        for p, of_part in enumerate(sums):
            rows_ = [(p, k, j, *_limbs(int(x))) for k in range(sizes[p]) if of_part[k, width] for j, x in enumerate(of_part[k])]
            if rows_:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), [pa.int32()] * 3 + [pa.int64()] * 3)], ["part", "entry", "place", "a", "b", "c"])

    sums = rows.select("v").mapInArrow(task, "part int, entry int, place int, a long, b long, c long").groupBy("part", "entry", "place")
    total = sums.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "abc"])
    # entries x (length + 1) rows, whatever the number of vectors
    found = {(r["part"], r["entry"], r["place"]): int(r["a"]) + (int(r["b"]) << _LIMB) + (int(r["c"]) << (2 * _LIMB)) for r in total.collect()}
    after = []
    for p, old in enumerate(books.entries):
        after.append(_whole([[found[p, k, j] // found[p, k, width] if (p, k, width) in found else int(old[k, j]) for j in range(width)] for k in range(len(old))]).reshape(len(old), width))
    return Codebooks(after, width, length)


def _add(sums: np.ndarray, found: np.ndarray, parts: np.ndarray) -> None:
    """Adds the parts, and a one behind them, to the sums of their entries."""
    order = np.argsort(found, kind="stable")
    keys, starts, counts = np.unique(found[order], return_index=True, return_counts=True)
    sums[keys, :-1] += np.add.reduceat(parts[order], starts, axis=0).astype(object) if parts.shape[1] else 0
    sums[keys, -1] += counts.astype(object)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of each row: its entries' indexes in part order, two hex
    digits each, and the squared distances summed over parts (null where 64 bits are too few)."""
    names = rows.select("vec_id", "label").schema

    def task(batches):
        trees = [Tree(e) for e in books.entries]
        for batch in batches:
            column = batch.column(2)
            codes, errors = [""] * batch.num_rows, [None] * batch.num_rows
            for at, ints in _batches(column, books):
                both = [tree.nearest(ints[:, p]) for p, tree in enumerate(trees)]
                lines = np.stack([f for f, _ in both], axis=1).astype(np.uint8)
                total = sum(d.astype(object) for _, d in both)
                for k, row in enumerate(at):
                    codes[row], errors[row] = lines[k].tobytes().hex(), int(total[k]) if total[k] <= _LONG else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    schema = names.add("code", "string").add("error", "long")
    return rows.select("vec_id", "label", "v").mapInArrow(task, schema)


def compress(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every sound row.

    Rows whose vector is null, empty or holds null or non-finite components go, and so do those
    of another length than the vector of the smallest id.  A length that eight doesn't divide is
    filled up with zeros.  Repeated ids and rows stay.  Errors are of 64 bits; where a label's sum
    doesn't fit, the column is null rather than wrong.  An empty table gives no rows.
    """
    rows = clean(vectors, id=id, vector=vector, label=label)
    books = first_entries(rows)
    stored = materialize(rows.where(F.size("v") == books.length), "vectors")
    for _ in range(rounds):
        books = refine(stored, books)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    coded = materialize(encode(stored, books).withColumn("key", key), "codes")
    total = F.when(F.count_if(F.col("error").isNull()) == 0, F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)"))
    sums = materialize(coded.groupBy("key").agg(total.alias("label_error"), F.count("*").alias("n")), "label-errors")
    whole = coded.join(F.broadcast(sums.drop("n")), "key") if is_small(sums) else spread_join(coded, sums, "key", ["vec_id", "code"], count="n")
    return whole.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
