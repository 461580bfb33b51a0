"""Large JSON documents in many tasks.

A document is one object whose members are long arrays of objects.  Whether a byte of it lies in
a string, and how deep, depends on all that came before; but what a block of bytes does to that
state is a small function: it is known for each of the few states that a block can begin in,
without the bytes before it.  So

1. every block tells its function,
2. the functions are composed in order, which gives each block its state (a row a block),
3. every block tells the keys and brackets of the outer object that it holds (a few rows),
4. every block gives the elements that begin in it, reading on where the last one ends later.

Blocks are read by their offsets; neither a task nor the driver holds a document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BLOCKED_ARTIFACT, PlinthError
from ..scratch import hadoop

BLOCK = 32 << 20
#: Keys and brackets of the outer object that a block may hold.
_MOST_OUTER = 10_000
_QUOTE, _SLASH = 0x22, 0x5C
_STEP = np.zeros(256, np.int64)
_STEP[[0x7B, 0x5B]], _STEP[[0x7D, 0x5D]] = 1, -1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True


@dataclass
class State:
    """Before a byte: whether it is in a string, whether it is escaped there, and how deep."""

    quoted: bool = False
    escaped: bool = False
    depth: int = 0


def _quotes(raw: np.ndarray, escaped: bool) -> np.ndarray:
    """Marks the quotes that begin or end a string: those with an even run of backslashes before
    them; ``escaped``: the first byte has an odd one."""
    slash = raw == _SLASH
    place = np.arange(len(raw))
    # the last place before each byte that is no backslash
    other = np.maximum.accumulate(np.where(slash, -1, place)) if len(raw) else place
    before = np.append(-1, other[:-1])
    run = place - 1 - before
    if escaped and len(raw):
        # the first byte is spent, so a run that reaches back to it is one shorter
        run = np.where(before < 0, place - 1, run)
        run[0] = 1
    return (raw == _QUOTE) & (run % 2 == 0)


def _trailing(raw: np.ndarray, escaped: bool) -> bool:
    """Whether the byte behind the block is escaped."""
    other = np.flatnonzero(raw != _SLASH)
    run = len(raw) - 1 - (int(other[-1]) if len(other) else -1)
    if escaped and not len(other):
        run -= 1
    return run % 2 == 1


def effect(raw: np.ndarray) -> list[int]:
    """What a block does: for an escaped first byte or not, the parity of its quotes, the change
    in depth if it begins outside or inside a string, and whether the next byte is escaped."""
    out = []
    for escaped in (False, True):
        quote = _quotes(raw, escaped)
        odd = np.cumsum(quote) % 2 == 1
        step = _STEP[raw]
        out += [int(quote.sum() % 2), int(step[~odd].sum()), int(step[odd].sum()), int(_trailing(raw, escaped))]
    return out


def after(state: State, told: list[int]) -> State:
    parity, outside, inside, trailing = told[4:] if state.escaped else told[:4]
    quoted = state.quoted != bool(parity)
    return State(quoted, bool(trailing) and quoted, state.depth + (inside if state.quoted else outside))


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _scan(raw: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: whether it is outside of strings (quotes are not), and the depth behind it."""
    quote = _quotes(raw, state.escaped)
    inside = (np.cumsum(quote) % 2 == 1) != state.quoted
    out = ~inside & ~quote
    return out, state.depth + np.cumsum(np.where(out, _STEP[raw], 0))


def outer(raw: np.ndarray, state: State, base: int, file) -> list[tuple[int, str, str | None]]:
    """Keys (place, "key", text), opened and closed arrays ("[", "]") and other members' starts of
    the outer object that a block holds."""
    out, depth = _scan(raw, state)
    quote = _quotes(raw, state.escaped)
    before = np.append(state.depth, depth[:-1])
    found: list[tuple[int, str, str | None]] = []
    for mark, kind in (((raw == 0x5B) & out & (before == 1), "["), ((raw == 0x5D) & out & (depth == 1), "]"), ((raw == 0x7B) & out & (before == 0), "{"), ((depth == 0) & (before == 0) & out & ~_BLANK[raw] & (raw != 0xEF) & (raw != 0xBB) & (raw != 0xBF), "?"), ((raw == 0x3A) & out & (depth == 1), ":")):
        found += [(base + int(k), kind, None) for k in np.flatnonzero(mark)]
    opens = quote & (before == 1) & ~((np.cumsum(quote) % 2 == 0) != state.quoted)
    for k in np.flatnonzero(opens):
        found.append((base + int(k), "key", _string(file, base + int(k))))
    if len(found) > _MOST_OUTER:
        raise ValueError("the outer object has too many members")
    return found


def _string(file, at: int) -> str:
    """The string that begins at a quote."""
    want = 256
    while True:
        file.seek(at)
        data = np.frombuffer(file.read(want), np.uint8)
        ends = np.flatnonzero(_quotes(data, False))
        if len(ends) > 1:
            return json.loads(data[: ends[1] + 1].tobytes())
        if len(data) < want:
            raise ValueError("the document is cut off")
        want *= 4


def elements(raw: np.ndarray, state: State, base: int, file, ranges: list[tuple[int, int, str]]) -> Iterator[tuple[str, str]]:
    """(array, text) of the objects that begin in a block and lie right in one of the arrays
    ``ranges`` (place of the bracket, of its end, name)."""
    out, depth = _scan(raw, state)
    before = np.append(state.depth, depth[:-1])
    place = base + np.arange(len(raw))
    for begin, end, name in ranges:
        here = (place > begin) & (place < end)
        # between elements there is nothing but commas and white space
        between = here & (before == 2) & (depth == 2) & ~(out & (_BLANK[raw] | (raw == 0x2C))) | here & (before == 2) & (depth == 3) & (raw != 0x7B)
        if between.any():
            raise ValueError(f"an element of {name} is no object")
        starts = np.flatnonzero(here & out & (raw == 0x7B) & (before == 2))
        ends = np.flatnonzero(here & out & (raw == 0x7D) & (depth == 2)) + 1
        # what ends before the first start began in an earlier block
        ends = ends[ends > starts[0]] if len(starts) else ends[:0]
        for k, start in enumerate(starts):
            if k < len(ends):
                yield name, raw[start : ends[k]].tobytes().decode()
            else:
                yield name, _object(file, base + int(start))


def _object(file, at: int) -> str:
    """The object that begins at a brace, however far it goes."""
    want = 1 << 16
    while True:
        file.seek(at)
        data = np.frombuffer(file.read(want), np.uint8)
        out, depth = _scan(data, State())
        ends = np.flatnonzero(out & (depth == 0))
        if len(ends):
            return data[: ends[0] + 1].tobytes().decode()
        if len(data) < want:
            raise ValueError("the document is cut off")
        want *= 4


def _blocks(spark: SparkSession, path: str, block: int) -> DataFrame:
    """file, at, size of the blocks of all files of a path."""
    target, fs = hadoop(spark, path)
    found = fs.globStatus(target) or []
    files = [s for f in found for s in (fs.listStatus(f.getPath()) if f.isDirectory() else [f]) if not s.getPath().getName().startswith((".", "_"))]
    if not files:
        raise PlinthError(BLOCKED_ARTIFACT, f"no document in {path}")
    rows = spark.createDataFrame([(s.getPath().toString(), s.getLen()) for s in files], "file string, length long")
    cut = rows.select("file", "length", F.explode(F.sequence(F.lit(0), F.greatest("length", F.lit(1)) - 1, F.lit(block).cast("long"))).alias("at"))
    return cut.select("file", "at", F.least(F.lit(block).cast("long"), F.col("length") - F.col("at")).alias("size"))


def read_arrays(spark: SparkSession, path: str, names: list[str], *, block: int = BLOCK) -> DataFrame:
    """name, element: the objects in the named arrays of the documents at a path.

    A document whose root is no object, or where a name is missing, occurs twice or is no array
    of objects, raises.
    """

    def each(batches, columns: int):
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True):
                with _open(row[0]) as file:
                    file.seek(row[1])
                    yield row, np.frombuffer(file.read(row[2]), np.uint8), file

    def effects(batches):
        for row, raw, _ in each(batches, 3):
            yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]]), pa.array([row[2]]), pa.array([effect(raw)], pa.list_(pa.int64()))], ["file", "at", "size", "told"])

    blocks = _blocks(spark, path, block)
    many = max(1, min(blocks.count(), 20_000))
    # a row a block
    told = sorted(tuple(r) for r in blocks.repartition(many).mapInArrow(effects, "file string, at long, size long, told array<long>").collect())
    states, state, last = [], State(), None
    for file, at, size, what in told:
        state = State() if file != last else state
        last = file
        states.append((file, at, size, state.quoted, state.escaped, state.depth))
        state = after(state, what)
    kind = "file string, at long, size long, quoted boolean, escaped boolean, depth long"
    placed = spark.createDataFrame(states, kind).repartition(many)

    def outers(batches):
        for row, raw, file in each(batches, 6):
            found = outer(raw, State(*row[3:]), row[1], file)
            yield pa.RecordBatch.from_arrays([pa.array([row[0]] * len(found), pa.string()), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["file", "place", "kind", "text"])

    members = placed.mapInArrow(outers, "file string, place long, kind string, text string").collect()
    ranges = {f: _ranges([tuple(r)[1:] for r in members if r["file"] == f], names) for f in {s[0] for s in states}}

    def objects(batches):
        held, size = [], 0
        for row, raw, file in each(batches, 6):
            for pair in elements(raw, State(*row[3:]), row[1], file, ranges[row[0]]):
                held.append(pair)
                size += len(pair[1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], ["name", "element"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], ["name", "element"])

    return placed.mapInArrow(objects, "name string, element string")


def _ranges(members: list[tuple[int, str, str | None]], names: list[str]) -> list[tuple[int, int, str]]:
    """Where the named arrays of one document begin and end."""
    ordered = sorted(members)
    kinds = [m[1] for m in ordered]
    if not ordered or kinds[0] != "{" or "?" in kinds or kinds.count("{") != 1:
        raise PlinthError(BLOCKED_ARTIFACT, "the root of a graph document must be an object")
    found: dict[str, tuple[int, int]] = {}
    seen: list[str] = []
    for k, (_, kind, text) in enumerate(ordered):
        # a string before a colon is a key; others are values
        if kind != "key" or k + 1 >= len(ordered) or kinds[k + 1] != ":":
            continue
        seen.append(text)
        if k + 3 < len(ordered) and kinds[k + 2 : k + 4] == ["[", "]"]:
            found[text] = ordered[k + 2][0], ordered[k + 3][0]
    for name in names:
        if name not in found or seen.count(name) != 1:
            raise PlinthError(BLOCKED_ARTIFACT, f"{name} of a graph document must be a list")
    return [(*found[n], n) for n in names]
