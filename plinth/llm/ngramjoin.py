"""Jaccard self-join of word n-gram sets by vertical partitioning, and its link components.

1. Documents with equal n-gram sets are one class, known by a digest of the set; only
   classes are compared.
2. An exact filter leaves out classes that can link with nothing: of the n-grams whose hash
   is in a fixed part of the hash range, a class may miss no more than a link allows in all
   its n-grams, and n-grams that no other class has are missed.
3. The remaining n-grams get a global order that keeps the n-grams of similar classes side
   by side, and the order is cut into fragments.  Each fragment counts partial overlaps of
   the classes' segments separately.
4. A fragment settles pairs whose overlap it can bound: sure links become a spanning forest,
   impossible pairs are left out.  For the rest, partial overlaps are counted in every
   fragment and summed per pair.
5. Links are joined to components.

No step lists all pairs of a group: a fragment emits at most a forest and the pairs between
different trees that it can't settle.  A fragment with more than ``BLOCK`` segments, or of
more n-grams than ``BLOCK_GRAMS``, is dealt out as pairs of blocks, so no task compares more than
two blocks at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import components
from .storage import discard, is_small, materialize, small_side, spread_join, unused

#: The part of the hash range that the filter looks at, against what a link may miss.
PART = 4 / 3
#: n-gram occurrences a fragment is to hold, and segments and n-grams in a block of a large
#: fragment.
FRAGMENT = 300_000
BLOCK, BLOCK_GRAMS = 4_000, 4_000_000
#: Open pairs up to which all are summed at once, and others that a class is summed with first
#: beyond that.
FEW, _HUBS = 500_000, 4
#: Comparisons with one holder of each n-gram; others of one from which on they are counted
#: together, and n-grams compared at once else.
_TURNS, _MANY, _AT_ONCE = 3, 16, 1 << 21
#: Leading bits of the global order by which n-grams are counted to cut it.
_CUT_BITS = 16
#: Bytes of a fragment after which a worker gives its memory back.
_LARGE_FRAME = 4 << 20


class Sets:
    """Distinct word n-grams of a block of texts: ``keys`` by text, ascending in each."""

    def __init__(self, texts: tk.Texts, size: int):
        low = texts.lower()
        starts, ends, first = low.spans(tk.SPACE)
        words = low.hashes(starts, ends)
        own = tk.owners(first)
        keys, at = tk.windows(words, first, size)
        owner = own[at]
        # a text of fewer words has its whole sequence as one n-gram
        count = np.diff(first)
        for k in range(1, size):
            few = np.flatnonzero(count == k)
            if len(few):
                whole = np.full(len(few), np.uint64(k))
                for j in range(k):
                    whole = tk.mix(whole + words[first[:-1][few] + j])
                keys, owner = np.append(keys, whole), np.append(owner, few)
        self.keys, owner = tk.distinct_by_text(keys, owner)
        self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.own = owner
        self.sizes = np.diff(self.first)

    def digests(self) -> np.ndarray:
        """64-bit digest of each set (0 for an empty one)."""
        sums = np.zeros((2, len(self.keys) + 1), np.uint64)
        np.cumsum(tk.mix(self.keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[0, 1:])
        np.cumsum(tk.mix(self.keys + np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
        a, b = sums[:, self.first[1:]] - sums[:, self.first[:-1]]
        digest = tk.mix(tk.mix(a) + b + self.sizes.astype(np.uint64)) | np.uint64(1)
        return np.where(self.sizes > 0, digest, np.uint64(0))

    def sampled(self, percent: int) -> pa.ListArray:
        """The n-grams of the fixed part of the hash range."""
        inside = self.keys <= np.uint64(min(1.0, PART * (100 - percent) / 100) * (2**64 - 2**12))
        edge = np.append(0, np.cumsum(inside))[self.first].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edge), pa.array(tk.signed(self.keys[inside])))


def _class_rows(slim: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document: doc_id, h, n (set size), dg (digest of the set) and the sampled n-grams."""
    kind = slim.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in tk.blocks(batch.column(2)):
                sets = Sets(texts, size)
                ids = [batch.column(k)[rows.start : rows.stop] for k in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(sets.sizes.astype(np.int64)), pa.array(tk.signed(sets.digests())), sets.sampled(percent)], names=["doc_id", "h", "n", "dg", "part"])

    return slim.select("doc_id", "h", "t").mapInArrow(tk.lean(make), f"doc_id {kind}, h long, n long, dg long, part array<long>")


def _able(n, percent: int):
    """Least overlap that a set of this size needs for any link."""
    return F.floor((F.lit(percent) * n + 99) / 100)


def _kept(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All classes (dg, n, rep, c documents), and of them those that may link."""
    classes = rows.where("n > 0").groupBy("dg").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("c"), F.first(F.size("part")).alias("s"))
    flat = rows.select("dg", F.explode("part").alias("h"))
    shared = flat.groupBy("h").agg(F.min("dg").alias("lo"), F.max("dg").alias("hi")).where("lo != hi").select("h")
    # equal sets have equal samples, so counts over a class are c times those of its set
    counts = flat.join(shared, "h", "left_semi").groupBy("dg").agg(F.count("*").alias("k"))
    least = F.col("s") - (F.col("n") - _able(F.col("n"), percent))
    kept = classes.join(counts, "dg", "left").where(F.coalesce("k", F.lit(0)) >= F.col("c") * least)
    return classes, kept.select("dg", "rep")


def _need(n, m, percent: int):
    """Least overlap of linked sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


class _Trees:
    """Trees of a forest over n items: ``label`` tells the tree of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._of: dict[int, list[int]] = {}

    def join(self, x: int, ys: np.ndarray) -> list[int]:
        """Hangs the trees of ``ys`` to that of x; returns the ones that hung apart."""
        out = []
        ys = ys[self.label[ys] != self.label[x]]
        while len(ys):
            y = int(ys[0])
            a, b = int(self.label[x]), int(self.label[y])
            mine, theirs = self._of.pop(a, [a]), self._of.pop(b, [b])
            if len(mine) < len(theirs):
                a, b, mine, theirs = b, a, theirs, mine
            self.label[theirs] = a
            mine.extend(theirs)
            self._of[a] = mine
            out.append(y)
            ys = ys[self.label[ys] != self.label[x]]
        return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    length = ends - starts
    return np.repeat(starts - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())


class _Holders:
    """The segments that hold each n-gram; ``token`` ascends.

    Lists of n-grams that a good part of the segments hold are bits, so near copies are
    counted 64 n-grams at once; these bits take no more room than the lists.
    """

    def __init__(self, token: np.ndarray, own: np.ndarray, kinds: int, m: int):
        self.own, self.m = own, m
        self.edge = np.searchsorted(token, np.arange(kinds + 1))
        self.often = np.diff(self.edge) * 32 >= max(m, 128)
        many = np.flatnonzero(self.often)
        self.bits = np.zeros((-(-len(many) // 64), m), np.uint64)
        for k in range(len(self.bits)):
            some = many[64 * k : 64 * k + 64]
            block = np.zeros((m, 64), bool)
            block[own[_ranges(self.edge[some], self.edge[some + 1])], np.repeat(np.arange(len(some)), self.edge[some + 1] - self.edge[some])] = True
            self.bits[k] = np.packbits(block, axis=1).view(np.uint64)[:, 0]

    def common(self, x: int, mine: np.ndarray) -> np.ndarray:
        """How many n-grams of x, which are ``mine``, each segment holds."""
        mine = mine[~self.often[mine]]
        some = np.bincount(self.own[_ranges(self.edge[mine], self.edge[mine + 1])], minlength=self.m)
        return some + np.bitwise_count(self.bits & self.bits[:, x : x + 1]).sum(axis=0, dtype=np.int64)


class _Segments:
    """The segments of one fragment (or of two of its blocks), and which of them to compare."""

    def __init__(self, frame: pa.Table, percent: int):
        frame = frame.combine_chunks()
        self.percent, self.m = percent, frame.num_rows
        self.n, r, self.block, self.dg, self.front = (frame.column(c).to_numpy() for c in ("n", "r", "block", "dg", "lead"))
        seg = pa.concat_arrays(frame.column("seg").chunks) if self.m else pa.array([], pa.list_(pa.int64()))
        self.length = np.diff(seg.offsets.to_numpy()).astype(np.int64)
        self.first = np.append(0, np.cumsum(self.length))
        self.rest = r - self.length
        _, self.token = np.unique(seg.flatten().to_numpy(), return_inverse=True)
        self.kinds = int(self.token.max(initial=-1)) + 1
        own = np.repeat(np.arange(self.m), self.length)
        order = np.argsort(self.token, kind="stable")
        token, own, place = self.token[order], own[order], np.arange(len(own))[order] - self.first[own[order]]
        self.all = _Holders(token, own, self.kinds, self.m)
        front = place < self.front[own]
        self.lead_token = token[front]
        self.lead = _Holders(self.lead_token, own[front], self.kinds, self.m)
        self.two = len(np.unique(self.block)) > 1

    def apt(self, x, y) -> np.ndarray:
        """Whether sizes allow a link, and the pair is this task's."""
        n = self.n
        fit = (100 * n[y] >= self.percent * n[x]) & (100 * n[x] >= self.percent * n[y])
        return fit & (self.block[x] != self.block[y]) if self.two else fit

    def near(self, x: int) -> np.ndarray:
        """Whether each segment has an n-gram of both prefixes in common with x."""
        return self.lead.common(x, self.token[self.first[x] : self.first[x] + self.front[x]]) > 0

    def overlap(self, x: int) -> np.ndarray:
        """Common n-grams of x with each segment."""
        return self.all.common(x, self.token[self.first[x] : self.first[x + 1]])

    def overlaps(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Common n-grams of each of these pairs, which ascend by x."""
        out = np.zeros(len(xs), np.int64)
        edges = np.append(np.flatnonzero(np.append(True, xs[1:] != xs[:-1])[: len(xs)]), len(xs))
        often = np.diff(edges) >= _MANY
        for lo, hi in zip(edges[:-1][often], edges[1:][often], strict=True):
            out[lo:hi] = self.overlap(int(xs[lo]))[ys[lo:hi]]
        few = np.flatnonzero(~np.repeat(often, np.diff(edges)))
        xs, ys = xs[few], ys[few]
        at = np.append(0, np.cumsum(self.length[xs] + self.length[ys]))
        lo = 0
        while lo < len(xs):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _AT_ONCE, side="right")) - 1)
            keys = []
            for side in (xs[lo:hi], ys[lo:hi]):
                pair = np.repeat(np.arange(hi - lo), self.length[side])
                keys.append(pair * self.kinds + self.token[_ranges(self.first[side], self.first[side + 1])])
            both = np.sort(np.concatenate(keys))
            out[few[lo:hi]] = np.bincount(both[1:][both[1:] == both[:-1]] // max(1, self.kinds), minlength=hi - lo)
            lo = hi
        return out

    def stars(self, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one holder of each n-gram and its other holders, ascending.  It is the first
        in an order of the segments, another in each turn, so near copies have few such holders."""
        order = np.argsort(tk.mix(np.arange(self.m, dtype=np.uint64) + np.uint64(turn << 40)))
        place = np.argsort(order)
        held = np.flatnonzero(np.diff(self.lead.edge))
        hub = np.zeros(self.kinds, np.int64)
        if len(held):
            hub[held] = order[np.minimum.reduceat(place[self.lead.own], self.lead.edge[held])]
        pairs = np.unique(hub[self.lead_token] * self.m + self.lead.own)
        return pairs // max(1, self.m), pairs % max(1, self.m)

    def apart(self, label: np.ndarray) -> np.ndarray:
        """Segments to look for others at: of each n-gram with holders in several trees, those
        outside its largest tree."""
        key, count = np.unique(self.lead_token * self.m + label[self.lead.own], return_counts=True)
        token = key // max(1, self.m)
        order = np.lexsort((count, token))
        last = np.append(token[1:] != token[:-1], True)[: len(token)]
        largest = np.full(self.kinds, -1)
        largest[token[last]] = key[order][last] % max(1, self.m)
        return np.unique(self.lead.own[label[self.lead.own] != largest[self.lead_token]])


def settle(frame: pa.Table, percent: int) -> pa.Table:
    """Partial overlaps of one fragment (or of two of its blocks).

    ``frame``: block, dg, n (set size), r (n-grams that some other class has), seg (those in
    this fragment), lead (how many of them, at the front, are in the class's prefix).
    Returns sure links as a forest (sure = True) and pairs that need the other fragments.

    Near copies come together by comparing all holders of an n-gram with one of them; after
    that only holders in different trees are compared.
    """
    s = _Segments(frame, percent)
    trees, sure = _Trees(s.m), []
    for turn in range(_TURNS):
        xs, ys = s.stars(turn)
        open_ = (trees.label[xs] != trees.label[ys]) & s.apt(xs, ys)
        xs, ys = xs[open_], ys[open_]
        linked = s.overlaps(xs, ys) >= _need(s.n[xs], s.n[ys], percent)
        for x, y in zip(xs[linked].tolist(), ys[linked].tolist(), strict=True):
            if trees.label[x] != trees.label[y]:
                sure += [(x, k) for k in trees.join(x, np.array([y]))]
    unsure, held = [], 0
    for x in s.apart(trees.label).tolist():
        ys = np.flatnonzero(s.near(x) & (trees.label != trees.label[x]))
        ys = ys[s.apt(x, ys)]
        if not len(ys):
            continue
        overlap = s.overlap(x)[ys]
        need = _need(s.n[x], s.n[ys], percent)
        sure += [(x, y) for y in trees.join(x, ys[overlap >= need])]
        open_ = (trees.label[ys] != trees.label[x]) & (overlap + np.minimum(s.rest[x], s.rest[ys]) >= need)
        if open_.any():
            ys = ys[open_]
            unsure.append(np.stack([np.minimum(x, ys), np.maximum(x, ys)], 1))
            held += len(ys)
            if held > 500_000:
                # what has come together meanwhile needs no more counting
                late = np.concatenate(unsure)
                unsure = [late[trees.label[late[:, 0]] != trees.label[late[:, 1]]]]
                held = 0
    pairs = np.array(sure, np.int64).reshape(-1, 2)
    late = np.concatenate([np.zeros((0, 2), np.int64), *unsure])
    late = late[trees.label[late[:, 0]] != trees.label[late[:, 1]]]
    late = np.stack(np.divmod(np.unique(late[:, 0] * s.m + late[:, 1]), max(1, s.m)), 1)
    x, y = s.dg[np.concatenate([pairs, late])].T
    return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y), "sure": np.arange(len(x)) < len(pairs)})


def _cuts(steps: list[tuple[int, int]], fragment: int) -> pa.Table:
    """The fragment (part) of each step of the global order, from the n-grams of each step."""
    steps = sorted(map(tuple, steps))
    before = np.append(0, np.cumsum([count for _, count in steps]))[:-1]
    return pa.table({"step": pa.array([step for step, _ in steps], pa.int32()), "part": pa.array(before // fragment, pa.int64())})


def class_links(texts: DataFrame, kept: DataFrame, size: int, percent: int, *, fragment: int = FRAGMENT, block: int = BLOCK, block_grams: int = BLOCK_GRAMS, few: int = FEW) -> DataFrame:
    """Links (x, y) between the classes in ``kept`` (column dg) that span their components.

    ``texts`` has a column t with at least one text of each of these classes.
    """
    spark = texts.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in tk.blocks(batch.column(0)):
                s = Sets(part, size)
                grams = pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), pa.array(tk.signed(s.keys)))
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(s.digests())), pa.array(s.sizes.astype(np.int64)), grams], names=["dg", "n", "grams"])

    rows = texts.select("t").mapInArrow(tk.lean(sets), "dg long, n long, grams array<long>").dropDuplicates(["dg"]).join(kept, "dg", "left_semi")
    rows = materialize(rows, "join-sets")
    grams = rows.select("dg", "n", F.explode("grams").alias("h"))
    stats = grams.groupBy("h").agg(F.count("*").alias("df"), F.min("dg").alias("near")).where("df > 1")
    # per class: n-grams that others have too, the rarest first, each with its smallest class
    some = grams.join(stats, "h").groupBy("dg").agg(F.first("n").alias("n"), F.count("*").alias("r"), F.array_sort(F.collect_list(F.struct("df", "h", "near"))).alias("grams"))
    able = _able(F.col("n"), percent)
    some = some.where(F.col("r") >= able).withColumn("lead", (F.col("r") - able + 1).cast("int"))
    # what a class is near to is told by its rarest n-grams; common ones would draw all that
    # have them to one place
    some = some.withColumn("near", F.array_min(F.transform(F.slice("grams", 1, F.col("lead")), lambda g: g["near"])))
    some = materialize(some.withColumn("grams", F.col("grams.h")), "join-able")
    discard(spark, rows)
    flat = some.select("dg", "n", "r", "near", "lead", F.posexplode("grams").alias("pos", "h")).select("dg", "n", "r", "near", "h", "pos", (F.col("pos") < F.col("lead")).alias("lead"))
    # the global order: by the smallest class near an n-gram; fragments are ranges of it that
    # hold about as many n-grams
    order = flat.groupBy("h").agg(F.shiftright(F.min("near"), 64 - _CUT_BITS).cast("int").alias("step"), F.count("*").alias("c"))
    ordered = materialize(order, "join-order")
    parts = spark.createDataFrame(_cuts(ordered.groupBy("step").agg(F.sum("c")).collect(), fragment))
    order = ordered.join(F.broadcast(parts), "step").select("h", "part")
    placed = flat.drop("near").join(order, "h").select("dg", "n", "r", "h", "pos", "lead", "part")
    segs = placed.groupBy("part", "dg").agg(F.first("n").alias("n"), F.first("r").alias("r"), F.sum(F.col("lead").cast("int")).alias("lead"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("seg"))
    segs = materialize(segs.withColumn("seg", F.col("seg.h")), "join-segments")
    discard(spark, some, ordered)
    # a candidate shares an n-gram of both prefixes, so a fragment compares only segments that
    # have some; large fragments are dealt out as pairs of blocks.  Their list is short and
    # travels, as a join by part would leave all blocks of a fragment in one task
    led = segs.where("lead > 0")
    counts = led.groupBy("part").agg(F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum(F.size("seg")) / F.lit(block_grams))).alias("blocks"))
    dealt = led.join(F.broadcast(counts), "part").withColumn("block", F.pmod(F.xxhash64("dg"), F.col("blocks")).cast("int"))
    other = F.explode(F.expr("sequence(0, cast(blocks as int) - 1)"))
    dealt = dealt.withColumn("with", other).withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})

    def settled(frame: pa.Table) -> pa.Table:
        out = settle(frame, percent)
        if frame.nbytes > _LARGE_FRAME:
            tk.trim()
        return out

    found = dealt.select("part", "lo", "hi", "block", "dg", "n", "r", "lead", "seg").groupBy("part", "lo", "hi").applyInArrow(settled, "x long, y long, sure boolean")
    found = materialize(found, "join-found")
    return _whole(found, segs, percent, few)


def _whole(found: DataFrame, segs: DataFrame, percent: int, few: int) -> DataFrame:
    """Sure links and those of the open pairs that span what links reach."""
    sure, pairs = found.where("sure").select("x", "y"), found.where("not sure").select("x", "y").distinct()
    if found.where("not sure").count() <= few:
        return sure.unionAll(_summed(pairs, segs, percent))
    # a fragment's end may cut through large groups of near copies: first each class is summed
    # with few others, which are the same ones all over a group, then what is still apart
    pairs = materialize(pairs, "join-pairs")
    both = pairs.unionAll(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    hubs = both.groupBy("x").agg(F.array(*(F.min_by("y", F.xxhash64("y", F.lit(turn))) for turn in range(_HUBS))).alias("hubs"))
    stars = hubs.select("x", F.explode("hubs").alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    links = materialize(sure.unionAll(_summed(stars, segs, percent)), "join-links")
    reached = small_side(materialize(components(links), "join-reached"))
    side = lambda name: reached.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
    apart = pairs.join(side("x"), "x", "left").join(side("y"), "y", "left").where(F.coalesce("of_x", "x") != F.coalesce("of_y", "y"))
    return links.unionAll(_summed(apart.select("x", "y"), segs, percent))


def _summed(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """The pairs that link by their partial overlaps in all fragments."""
    mine = segs.select(F.col("dg").alias("x"), "part", F.col("n").alias("nx"), F.col("seg").alias("sx"))
    theirs = segs.select(F.col("dg").alias("y"), "part", F.col("n").alias("ny"), F.col("seg").alias("sy"))
    partial = pairs.join(mine, "x").join(theirs, ["y", "part"]).select("x", "y", "nx", "ny", F.size(F.array_intersect("sx", "sy")).alias("k"))
    return partial.groupBy("x", "y", "nx", "ny").agg(F.sum("k").alias("k")).where(F.expr(f"100 * k >= {percent} * (nx + ny - k)")).select("x", "y")


class _Groups:
    """Documents and classes of one join: ``rows`` (doc_id, h: hash of the text, n, dg) of
    every document and ``lookup`` (dg, group) of classes of several documents or with links."""

    def __init__(self, slim: DataFrame, size: int, percent: int):
        rows = materialize(_class_rows(slim, size, percent), "join-classes")
        self.rows = rows.select("doc_id", "h", "n", "dg")
        classes, able = _kept(rows, percent)
        kept = materialize(able, "join-kept")
        wanted = materialize(kept.select(F.col("rep").alias("_rep")).distinct(), "join-wanted")
        texts = slim.join(small_side(wanted), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
        reached = components(class_links(texts, kept.select("dg"), size, percent))
        linked = classes.join(reached.withColumnRenamed("node", "dg"), "dg", "left")
        # only classes of several documents or with links need a name other than the document's
        self.several = linked.where("c > 1 or component is not null").select("dg", "rep", "c", F.coalesce("component", "dg").alias("group"))
        self.lookup = materialize(self.several.select("dg", "group", "c"), "join-lookup")


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t"))


def similar_groups(docs: DataFrame, *, doc_id="doc_id", text="text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of
    ``size``-word shingles over lower-cased (A-Z) words; a component is what links reach and
    is named by its smallest doc_id.  A null or wordless text has an empty set and is its
    own component.  Repeated rows stay; a null doc_id names a component only if all its ids
    are null.  Other columns are not read.
    """
    found = _Groups(_slim(docs, doc_id, text), size, percent)
    names = found.several.groupBy("group").agg(F.min("rep").alias("component_id"))
    lookup = materialize(found.lookup.join(names, "group").select("dg", "component_id", "c"), "join-names")
    plain = lambda rows, name: rows.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))
    if is_small(lookup):
        return plain(found.rows.join(F.broadcast(lookup.drop("c")), "dg", "left"), F.coalesce("component_id", "doc_id"))
    # classes of one document without links take no part in the join
    named = plain(spread_join(found.rows, lookup, "dg", ["doc_id", "h"], count="c"), F.col("component_id"))
    return named.unionAll(plain(found.rows.join(lookup.select("dg"), "dg", "left_anti"), F.col("doc_id")))


def keep_one(docs: DataFrame, *, doc_id="doc_id", text="text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of similar documents, with all its columns.

    Groups are of texts, so rows that share an id, or have none, but not their text are
    judged apart.  The row of the smallest id stays (null ids last, of equal ids the one
    with the smallest hash of its text); rows that repeat id and text stay once.  Documents
    without words are all kept.  Columns of any name are kept as they are.
    """
    found = _Groups(_slim(docs, doc_id, text), size, percent)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    # classes of one document have nothing that could go
    mine = spread_join(found.rows.where("n > 0"), found.lookup, "dg", ["doc_id", "h"], count="c").groupBy("group", "doc_id", "h").agg(F.count("*").alias("c"))
    mine = materialize(mine.withColumn("place", place), "join-members")
    first = mine.groupBy("group").agg(F.min("place").alias("first"))
    judged = materialize(mine.join(first, "group").select("doc_id", "h", "c", F.col("place").eqNullSafe(F.col("first")).alias("stays")), "join-judged")
    i, h, a, b, n = unused(docs, "_i", "_h", "_a", "_b", "_n")
    keyed = docs.withColumns({i: F.col(doc_id), h: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    met = F.col(i).eqNullSafe(F.col(a)) & (F.col(h) == F.col(b))
    side = lambda rows, name: small_side(materialize(rows.select(F.col("doc_id").alias(a), F.col("h").alias(b)), name))
    rest = keyed.join(side(judged.where("not stays"), "join-gone"), met, "left_anti")
    again = judged.where("stays and c > 1")
    if again.isEmpty():
        return rest.drop(i, h)
    # rows that repeat differ in other columns only; one of them stays, by partial aggregation
    again = side(again, "join-again")
    once = rest.join(again, met, "left_semi").groupBy(i, h).agg(F.first(F.struct(*docs.columns)).alias(n)).select(f"{n}.*")
    return rest.join(again, met, "left_anti").drop(i, h).unionByName(once)
