"""Fuzzy line deduplication by MinHash and distributed union-find.

Lines are compared in a normal form (lower-cased, digits as 0, white space and marks
collapsed).  Equal normal forms are one line class; only distinct classes go on:

1. character shingles of each class give a one-permutation MinHash signature,
2. bands of the signature propose candidates: each member of a band's bucket is first held
   against the bucket's smallest and largest member,
3. the exact Jaccard similarity of the shingle sets verifies each pair,
4. components of the verified links are found by star contraction,
5. buckets that still hold several components are compared whole: every pair of members of
   different components, in blocks of bounded size, until no bucket can give another link.

So the components are those of all pairs that share a bucket and are similar enough.

Of each component the first occurrence in the corpus (smallest doc_id, then line) stays; all
its other lines go.  Lines under ``min_chars`` characters in normal form are too short to tell
what is similar: they are equal only if they are the same byte by byte, white space at either end
apart.  Lines without a letter or digit always stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import components
from .storage import discard, materialize, small_side, spread_join, unused

SHINGLE = 8
BANDS, ROWS = 10, 4
_BINS = BANDS * ROWS
#: Lines and bytes of a slot; buckets over either are compared slot by slot.
_SLOT_LINES, _SLOT_BYTES = 1024, 2 << 20

#: Normal form by byte: 0 ends a word, digits are one, letters are lower-cased.
_FORM = tk.LOWER.copy()
_FORM[:0x80][~((np.arange(0x80) >= 0x61) & (np.arange(0x80) <= 0x7A) | (np.arange(0x80) >= 0x41) & (np.arange(0x80) <= 0x5A) | (np.arange(0x80) >= 0x30) & (np.arange(0x80) <= 0x39))] = 0x20
_FORM[0x30:0x3A] = 0x30


def normal_lines(texts: tk.Texts) -> tuple[tk.Texts, np.ndarray]:
    """All lines in normal form (words joined by one space), and each text's first line."""
    starts, ends, first = texts.lines()
    form = _FORM[texts.flat]
    word = form != 0x20
    # a separator stays only right behind a word of the same line
    edge = np.zeros(len(form), bool)
    edge[1:] = word[:-1] & ~word[1:]
    edge[starts[starts < len(form)]] &= word[starts[starts < len(form)]]
    keep = (word | edge) & (texts.flat != 10)
    counts = np.append(0, np.cumsum(keep))
    # a line's last separator goes
    lo, hi = counts[starts], counts[ends]
    flat = form[keep]
    last = np.where(hi > lo, hi - 1, 0)
    drop = np.zeros(len(flat), bool)
    trailing = (hi > lo) & (flat[np.minimum(last, max(len(flat) - 1, 0))] == 0x20 if len(flat) else False)
    drop[last[trailing]] = True
    kept = np.append(0, np.cumsum(~drop))
    return tk.Texts(flat[~drop], np.append(kept[lo], kept[hi[-1]]) if len(hi) else np.zeros(1, np.int64)), first


#: One byte for each character of one or two UTF-8 bytes: those that normal forms have of ASCII
#: stay, the others share what is left, neighbours in a script apart.
_FREE = np.array([b for b in range(256) if b not in (0x20, 0x30, *range(0x61, 0x7B))], np.uint8)
_NARROW = _FREE[np.arange(0x800) % len(_FREE)]
_NARROW[:0x80] = np.arange(0x80)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def char_counts(lines: tk.Texts) -> np.ndarray:
    """Characters of each line."""
    size = np.diff(lines.offsets)
    more = (lines.flat & 0xC0) == 0x80
    return size - lines.count(more) if more.any() else size


def shingles(lines: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of eight characters (as scrambled numbers) and their lines.

    Lines are longer than a shingle; shorter ones have none.  A shingle is the number of its
    characters' bytes; a character of three or four UTF-8 bytes stands for a scrambled number
    that is turned by its place.
    """
    wide = lines.flat >= 0xE0
    if not wide.any():
        return _narrow_shingles(lines)
    has = lines.count(wide) > 0
    few, many = np.flatnonzero(~has), np.flatnonzero(has)
    keys, own = _narrow_shingles(_take(lines, few))
    more, other = _wide_shingles(_take(lines, many))
    return np.concatenate([keys, more]), np.concatenate([few[own], many[other]])


def _narrow_shingles(lines: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    raw, edge = np.ascontiguousarray(lines.flat), lines.offsets
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        keep = (raw & 0xC0) != 0x80
        edge = np.append(0, np.cumsum(char_counts(lines)))
        raw = raw.copy()
        raw[lead] = _NARROW[(raw[lead].astype(np.int64) & 0x1F) << 6 | raw[lead + 1] & 0x3F]
        raw = raw[keep]
    n = len(raw) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _of_lines(np.ndarray(n, "<u8", raw, strides=(1,)).copy(), edge)


def _wide_shingles(lines: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(lines.flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(points) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = _NARROW[np.minimum(points, 0x7FF)].astype(np.uint64)
    far = points >= 0x800
    value[far] = tk.mix(points[far].astype(np.uint64))
    two = value[:-1] ^ _turned(value[1:], 8)
    four = two[:-2] ^ _turned(two[2:], 16)
    return _of_lines(four[:-4] ^ _turned(four[4:], 32), np.append(0, np.cumsum(char_counts(lines))))


def _of_lines(keys: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that lie within a line, scrambled, and their lines."""
    own = tk.owners(edge)[: len(keys)]
    inside = np.arange(len(keys)) + SHINGLE <= edge[1:][own]
    return tk.mix(keys[inside]), own[inside]


def signatures(keys: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash: smallest value in each bin; an empty bin takes the value of a
    bin drawn for it by a fixed rule, so equal sets agree there too (densification).

    The sort keeps as many leading bits of a value as fit beside its cell, the same number
    for every block of up to two million cells, so signatures of different blocks agree."""
    full = np.uint64(2**64 - 1)
    sig = np.full(n * _BINS, full)
    # one sort of (cell, leading bits of the value) finds each cell's smallest
    bits = np.uint64(40)
    value = keys // np.uint64(_BINS)
    cell = own.astype(np.uint64) * np.uint64(_BINS) + (keys - value * np.uint64(_BINS))
    order = np.sort(cell << bits | tk.mix(value) >> (np.uint64(64) - bits))
    cell = order >> bits
    lead = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    sig[cell[lead].astype(np.int64)] = (order[lead] & ((np.uint64(1) << bits) - np.uint64(1))) << (np.uint64(64) - bits)
    sig = sig.reshape(n, _BINS)
    rng = np.random.default_rng(77)
    rows, bins = np.nonzero(sig == full)
    some = (sig != full).any(1)
    rows, bins = rows[some[rows]], bins[some[rows]]
    while len(rows):
        draw = rng.integers(0, _BINS, _BINS)
        salt = tk.mix(rng.integers(1, 2**62, _BINS).astype(np.uint64))
        from_ = sig[rows, draw[bins]]
        ok = from_ != full
        filled = tk.mix(from_[ok] ^ salt[bins[ok]])
        sig[rows[ok], bins[ok]] = np.where(filled == full, np.uint64(0), filled)
        rows, bins = rows[~ok], bins[~ok]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), np.int32)
    for b in range(BANDS):
        h = np.full(len(sig), np.uint64(b + 1))
        for r in range(ROWS):
            h = tk.mix(h + sig[:, b * ROWS + r])
        out[:, b] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def line_rows(slim: DataFrame, min_chars: int) -> DataFrame:
    """Per document row: keys of its lines (0: never goes); and of those long classes that a
    block of text shows first there, ``fresh`` keys with their bands in a row."""
    kind = slim.schema["row"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in tk.blocks(batch.column(1), tk.BLOCK_BYTES // 4):
                lines, first = normal_lines(texts)
                keys = line_keys(lines, min_chars)
                _, pick = np.unique(keys, return_index=True)
                pick = np.sort(pick[keys[pick] != 0])
                keys = np.where(keys == 0, short_keys(texts, lines, keys == 0), keys)
                grams, own = shingles(_take(lines, pick))
                band = bands(signatures(grams, own, len(pick)))
                edge = np.searchsorted(pick, first).astype(np.int32)
                columns = [
                    batch.column(0)[rows.start : rows.stop],
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tk.signed(keys))),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(tk.signed(keys[pick]))),
                    pa.ListArray.from_arrays(pa.array(edge * np.int32(BANDS)), pa.array(band.reshape(-1))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "keys", "fresh", "bands"])

    return slim.mapInArrow(tk.lean(make), f"row {kind}, keys array<long>, fresh array<long>, bands array<int>")


def short_keys(texts: tk.Texts, lines: tk.Texts, short: np.ndarray) -> np.ndarray:
    """Keys of the short lines with a letter or digit, by their own bytes; 0 for all others.
    They are even, those of long lines odd."""
    out = np.zeros(len(lines), np.uint64)
    starts, ends, _ = texts.lines()
    pick = np.flatnonzero(short & (np.diff(lines.offsets) > 0))
    lo, hi = starts[pick], ends[pick]
    blank = tk.SPACE[texts.flat]
    for at, edge, step in ((lo, hi, 1), (hi, lo, -1)):
        while True:  # as often as the longest margin
            more = np.flatnonzero((at != edge) & blank[np.clip(at - (step < 0), 0, len(blank) - 1)])
            if not len(more):
                break
            at[more] += step
    some = _gather(texts.flat, lo, hi)
    out[pick] = some.hashes(some.offsets[:-1], some.offsets[1:]) & ~np.uint64(1) | np.uint64(2)
    return out


def line_keys(lines: tk.Texts, min_chars: int) -> np.ndarray:
    keys = lines.hashes(lines.offsets[:-1], lines.offsets[1:]) | np.uint64(1)
    return np.where(char_counts(lines) >= min_chars, keys, np.uint64(0))


def _take(lines: tk.Texts, pick: np.ndarray) -> tk.Texts:
    return _gather(lines.flat, lines.offsets[:-1][pick], lines.offsets[1:][pick])


def _gather(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tk.Texts:
    length = ends - starts
    edge = np.append(0, np.cumsum(length))
    at = np.arange(edge[-1]) - np.repeat(edge[:-1], length) + np.repeat(starts, length)
    return tk.Texts(flat[at], edge)


def _line_texts(slim: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """key and normal form of the wanted line classes, one row each.  ``wanted``: row, want
    (keys of lines to be taken from it)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in tk.blocks(batch.column(0)):
                mine = np.unique(batch.column(1)[rows.start : rows.stop].flatten().to_numpy().view(np.uint64))
                lines, _ = normal_lines(texts)
                keys = line_keys(lines, min_chars)
                pick = np.flatnonzero((keys != 0) & tk.member(keys, mine)[1])
                _, one = np.unique(keys[pick], return_index=True)
                pick = np.sort(pick[one])
                some = _take(lines, pick)
                form = pa.Array.from_buffers(pa.large_binary(), len(pick), [None, pa.py_buffer(some.offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(some.flat))])
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(keys[pick])), form.cast(pa.binary())], names=["key", "form"])

    return slim.join(small_side(wanted), "row").select("t", "want").mapInArrow(tk.lean(make), "key long, form binary").dropDuplicates(["key"])


def _propose(banded: DataFrame) -> DataFrame:
    """Pairs (x, y) of each bucket member with the bucket's smallest and largest member."""
    low = banded.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("c")).where("least != most")
    low = materialize(low, "line-buckets")
    pairs = spread_join(banded, low, "band", ["key"], count="c", most=1_000_000).select(F.explode(F.array(F.struct(F.col("least").alias("x"), F.col("key").alias("y")), F.struct(F.col("key").alias("x"), F.col("most").alias("y")))).alias("p"))
    return pairs.select("p.x", "p.y").where("x != y").distinct()


def _verified(pairs: DataFrame, forms: DataFrame, percent: int) -> DataFrame:
    """The pairs whose shingle sets reach the Jaccard similarity, from the lines themselves."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n = part.num_rows
                both = pa.concat_arrays([part.column(2).cast(pa.large_binary()), part.column(3).cast(pa.large_binary())])
                for _, texts in tk.blocks(both, 1 << 62):
                    keys, own = shingles(texts)
                    size = _distinct(keys, own, 2 * n)
                    shared = _distinct(keys, own % n, n)
                    total = size[:n] + size[n:]
                    # shared: the union; what both have is the rest
                    ok = 100 * (total - shared) >= percent * shared
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], names=["x", "y"])

    a, b = forms.select(F.col("key").alias("x"), F.col("form").alias("fx")), forms.select(F.col("key").alias("y"), F.col("form").alias("fy"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", "fx", "fy").mapInArrow(tk.lean(check), "x long, y long")


def _distinct(keys: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Distinct shingles of each of ``n`` (under 2**14) owners.  One sort of owner and the
    leading 50 bits of the scrambled shingle; of a few thousand shingles two share those
    with a chance under one in 10**8."""
    order = np.sort(own.astype(np.uint64) << np.uint64(50) | keys >> np.uint64(14))
    fresh = np.append(True, order[1:] != order[:-1]) if len(order) else np.zeros(0, bool)
    return np.bincount((order[fresh] >> np.uint64(50)).astype(np.int64), minlength=n)


def _sketches(forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per line the number of its distinct shingles and a bitmap of them (2048 bits)."""
    sizes, bits = [np.zeros(0, np.int64)], [np.zeros((0, 32), np.uint64)]
    for _, texts in tk.blocks(forms):
        keys, own = shingles(texts)
        flags = np.zeros((len(texts), 2048), bool)
        flags[own, (keys >> np.uint64(53)).astype(np.int64)] = True
        sizes.append(_distinct(keys, own, len(texts)))
        bits.append(np.packbits(flags, axis=1).view(np.uint64))
    return np.concatenate(sizes), np.concatenate(bits)


def _similar(forms: pa.Array, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the shingle sets of the lines at ``x`` and ``y`` reach the similarity."""
    n = len(x)
    both = pa.concat_arrays([forms.take(pa.array(x)), forms.take(pa.array(y))])
    for _, texts in tk.blocks(both, 1 << 62):
        keys, own = shingles(texts)
        size = _distinct(keys, own, 2 * n)
        union = _distinct(keys, own % n, n)
        return 100 * (size[:n] + size[n:] - union) >= percent * union
    return np.zeros(0, bool)


def _joined(group: np.ndarray, across: np.ndarray, slot: np.ndarray, comp: np.ndarray, forms: pa.Array, percent: int) -> list[tuple[int, int]]:
    """Links between components of lines that are similar and of one group; as many as join
    what all such pairs would.  A group's lines are in a row; where ``across``, only lines
    of different slots are compared.

    A shingle of one line whose bit the other lacks is not shared, so counting bits bounds
    the similarity from above and drops no pair that reaches it."""
    sizes, bits = _sketches(forms)
    links: list[tuple[int, int]] = []
    now = comp.copy()
    held: list[np.ndarray] = []

    def settle() -> None:
        x, y = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        held.clear()
        for lo in range(0, len(x), 256):
            a, b = x[lo : lo + 256], y[lo : lo + 256]
            apart = now[a] != now[b]
            a, b = a[apart], b[apart]
            if not len(a):
                continue
            good = _similar(forms, a, b, percent)
            for i, j in zip(a[good], b[good], strict=True):
                if now[i] != now[j]:
                    links.append((int(comp[i]), int(comp[j])))
                    now[now == now[j]] = now[i]

    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    last = np.repeat(np.append(edge[1:], len(group)), np.diff(np.append(edge, len(group))))
    x = np.arange(len(group))
    step = 1
    while True:
        x = x[x + step < last[x]]
        if not len(x):
            break
        y = x + step
        pick = (now[x] != now[y]) & ~(across[x] & (slot[x] == slot[y]))
        pick &= 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
        a, b = x[pick], y[pick]
        if len(a):
            most = np.minimum(sizes[a] - np.bitwise_count(bits[a] & ~bits[b]).sum(1, dtype=np.int64), sizes[b] - np.bitwise_count(bits[b] & ~bits[a]).sum(1, dtype=np.int64))
            near = 100 * most >= percent * (sizes[a] + sizes[b] - most)
            if near.any():
                held.append(np.stack([a[near], b[near]]))
                if sum(h.shape[1] for h in held) >= 256:
                    settle()
        step += 1
    if held:
        settle()
    return links


def _within(spark: SparkSession, near: DataFrame, reached: DataFrame, forms: DataFrame, percent: int) -> DataFrame | None:
    """Stored links (x, y) between the components of lines that share a bucket and are similar
    enough; None if no bucket is open.  ``near``: key, bands; ``reached``: key, component."""
    own = near.join(small_side(reached, 500_000), "key", "left").select("key", F.coalesce("component", "key").alias("comp"), "bands")
    banded = _bands(own, "comp")
    # of three members or fewer the two ends leave no pair untried
    open_ = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("n > 3 and a != b").select("band")
    open_ = materialize(open_, "line-open")
    if open_.isEmpty():
        discard(spark, open_)
        return None
    held = materialize(banded.join(small_side(open_, 1_000_000), "band", "left_semi"), "line-held")
    sized = held.join(forms, "key")
    slots = sized.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / _SLOT_LINES, F.sum(F.length("form")) / _SLOT_BYTES)).cast("int").alias("slots"))
    slots = materialize(slots, "line-slots")
    dealt = held.join(small_side(slots, 1_000_000), "band").withColumn("slot", F.pmod(F.xxhash64("key", "band"), "slots").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("t")
    blocks = dealt.select("band", "key", "comp", "slot", other).select("key", "comp", "slot", "band", F.least("slot", "t").alias("i"), F.greatest("slot", "t").alias("j"))
    blocks = blocks.join(forms, "key").select("band", "i", "j", "slot", "comp", "form")
    blocks = blocks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(part: pa.RecordBatch) -> pa.RecordBatch:
            band, i, j, slot, comp = (part.column(k).to_numpy() for k in range(5))
            group = np.cumsum(np.append(0, (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            found = _joined(group, i != j, slot, comp, part.column(5).cast(pa.large_binary()), percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["x", "y"])

        # the last group of a batch may go on in the next one
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            band, i, j = (batch.column(k).to_numpy() for k in range(3))
            change = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if rest:
                tail = rest[-1].slice(rest[-1].num_rows - 1)
                if (tail.column(0)[0].as_py(), tail.column(1)[0].as_py(), tail.column(2)[0].as_py()) != (band[0], i[0], j[0]):
                    yield links(pa.concat_batches(rest))
                    rest = []
            if len(change):
                yield links(pa.concat_batches([*rest, batch.slice(0, int(change[-1]))]))
                rest = [batch.slice(int(change[-1]))]
            else:
                rest.append(batch)
        if rest:
            yield links(pa.concat_batches(rest))

    out = materialize(blocks.mapInArrow(tk.lean(compare), "x long, y long"), "line-links")
    discard(spark, open_, held, slots)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()


def _bands(rows: DataFrame, *more: str) -> DataFrame:
    at = F.posexplode("bands").alias("pos", "value")
    return rows.select("key", *more, at).select("key", *more, (F.col("value").cast("long") * BANDS + F.col("pos")).alias("band"))


def line_groups(slim: DataFrame, *, min_chars: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (row, t): the stored lines (row, keys) and the stored map from line classes
    with a fuzzy link to their component (key, component)."""
    spark = slim.sparkSession
    lines = materialize(line_rows(slim, min_chars), "lines")
    at = F.posexplode("fresh").alias("at", "key")
    classes = lines.select("row", "bands", at).select("row", "key", F.slice("bands", F.col("at") * BANDS + 1, F.lit(BANDS)).alias("bands"))
    pairs = materialize(_propose(_bands(classes)), "line-pairs")
    # one occurrence of each class that has a pair gives its text
    tried = materialize(_ends(pairs), "line-tried")
    near = classes.join(small_side(tried, 1_000_000), "key", "left_semi")
    near = materialize(near.groupBy("key").agg(F.min(F.struct("row", "bands")).alias("one")).select("key", "one.row", "one.bands"), "line-near")
    wanted = materialize(near.groupBy("row").agg(F.collect_list("key").alias("want")), "line-wanted")
    forms = materialize(_line_texts(slim, wanted, min_chars), "line-forms")
    links = materialize(_verified(pairs, forms, percent), "line-links")
    discard(spark, pairs, wanted, tried)
    reached = materialize(components(links).withColumnRenamed("node", "key"), "line-components")
    more = _within(spark, near.select("key", "bands"), reached, forms, percent)
    discard(spark, near, forms, links)
    if more is not None and not more.isEmpty():
        first = reached
        every = first.select(F.col("key").alias("x"), F.col("component").alias("y")).unionAll(more)
        reached = materialize(components(every).withColumnRenamed("node", "key"), "line-components")
        discard(spark, first)
    if more is not None:
        discard(spark, more)
    return lines.select("row", "keys"), reached


def removed_lines(docs: DataFrame, *, doc_id="doc_id", text="text", min_chars: int = 24, percent: int = 80) -> DataFrame:
    """Stored rows (row, removed, n): for each line of a row with any that goes whether it
    goes, up to the last one that does, and how many do.

    ``row`` is the struct of :func:`row_key`.
    """
    slim = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("t"))
    lines, reached = line_groups(slim, min_chars=max(min_chars, SHINGLE), percent=percent)
    flat = lines.select("row", F.posexplode("keys").alias("pos", "key")).where("key != 0")
    often = flat.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # classes of several lines or with links, and the component of each
    group = often.join(reached, "key", "full_outer").select("key", F.coalesce("c", F.lit(1)).alias("c"), F.coalesce("component", "key").alias("component"))
    group = materialize(group, "line-classes")
    some = spread_join(flat, group, "key", ["row", "pos"], count="c", most=500_000)
    best = some.groupBy("component").agg(F.min(F.struct("row", "pos")).alias("best"), F.count("*").alias("c"))
    best = materialize(best, "line-best")
    gone = spread_join(some, best, "component", ["row", "pos"], count="c", most=500_000)
    gone = gone.where(~((F.col("row") == F.col("best.row")) & (F.col("pos") == F.col("best.pos"))))
    places = gone.groupBy("row").agg(F.collect_set("pos").alias("places"))
    kind = places.schema["row"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            edge = column.offsets.to_numpy()
            at = column.values.to_numpy()[edge[0] : edge[-1]]
            edge = edge - edge[0]
            last = np.maximum.reduceat(at, edge[:-1]) + 1 if len(at) else np.zeros(0, np.int64)
            bounds = np.append(0, np.cumsum(last))
            flags = np.zeros(bounds[-1], bool)
            flags[np.repeat(bounds[:-1], np.diff(edge)) + at] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flags)), pa.array(np.diff(edge).astype(np.int64))], names=["row", "removed", "n"])

    return materialize(places.mapInArrow(mark, f"row {kind}, removed array<boolean>, n long"), "lines-removed")


def row_key(doc_id: str, text: str):
    """Order of document rows: by id, null ids last, equal ids by the text's hash."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


def dedup_lines(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """``docs`` with cleaned texts, and columns n_lines and n_removed (long).

    Lines are separated by line feeds.  A null text stays null and has no lines; a text
    whose lines all go is empty.  Rows that repeat id and text are cleaned alike.  Columns
    of the input that are named like the added ones are replaced.
    """
    row, key, lost, many = unused(docs, "_row", "_key", "_gone", "_many")
    gone = removed_lines(docs, doc_id=doc_id, text=text, **options)
    side = small_side(gone).select(F.col("row").alias(key), F.col("removed").alias(lost), F.col("n").alias(many))
    joined = docs.withColumn(row, row_key(doc_id, text)).join(side, F.col(row).eqNullSafe(F.col(key)), "left")
    split = F.split(F.col(text), "\n", -1)
    # a look at one place of an array for each line
    kept = F.array_join(F.filter(split, lambda _, i: ~F.coalesce(F.get(F.col(lost), i), F.lit(False))), "\n")
    out = joined.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long"),
        "n_removed": F.coalesce(F.col(many), F.lit(0)).cast("long"),
        text: F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept),
    })
    return out.drop(row, key, lost, many)
