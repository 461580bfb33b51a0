"""Source files to declaration chunks.

Comments nest and strings hide them, so which characters are code depends on all that came
before in a file.  That scan runs over whole files in Arrow batches; everything per line
after it could be columns, but the files are already in hand there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What begins a declaration.
MODIFIERS = ["protected", "private", "noncomputable", "unsafe"]
KEYWORDS = ["theorem", "lemma", "def", "abbrev", "structure", "class", "inductive", "instance"]
_NAME = r"[^\W\d][\w']*"
_DECLARATION = re.compile(rf"\s*(?:(?:{'|'.join(MODIFIERS)})\s+)*(?:{'|'.join(KEYWORDS)})\s+({_NAME}(?:\.{_NAME})*)")
_MARK = re.compile(r'--|/-|-/|"|\n')
_IN_STRING = re.compile(r'\\[^\n]|"|\n')

SCHEMA = "id string, source_revision string, source_path string, source_start_line int, source_end_line int, declaration_hint string, text string, content_sha256 string"


def mask_comments(text: str) -> tuple[str, list[bool]]:
    """The text with comments blanked, and for each line whether a comment comes first in it.

    That is a line that begins within a block comment, whatever follows, or whose first mark
    behind white space opens a comment.  Jumps from mark to mark.  Block comments nest; a
    string ends with its line.
    """
    out: list[str] = []
    flags: list[bool] = []
    depth, in_string, in_line = 0, False, False
    first, coded = False, False  # of this line: begins as a comment; has code so far
    at = 0

    def take(piece: str, hidden: bool) -> None:
        nonlocal coded
        coded |= not hidden and bool(piece.strip())
        out.append(" " * len(piece) if hidden else piece)

    while True:
        m = (_IN_STRING if in_string else _MARK).search(text, at)
        hidden = depth > 0 or in_line
        take(text[at : m.start() if m else len(text)], hidden)
        if m is None:
            break
        mark, at = m.group(), m.end()
        if mark == "\n":
            out.append("\n")
            flags.append(first)
            in_line = in_string = False
            first, coded = depth > 0, False
        elif in_line:
            take(mark, True)
        elif depth:
            take(mark, True)
            depth += {"/-": 1, "-/": -1}.get(mark, 0)
        elif mark in ("--", "/-"):
            first |= not coded
            in_line, depth = mark == "--", int(mark == "/-")
            take(mark, True)
        else:
            take(mark, False)
            if mark == '"':
                in_string = not in_string
    flags.append(first)
    return "".join(out), flags


def chunks(path: str, text: str, revision: str) -> list[tuple]:
    """Chunks of a file: each from the comments and blank lines right above a declaration to
    the line before the next chunk.  What stands before the first is not indexed."""
    lines = text.splitlines(keepends=True)
    flat = "\n".join(x.rstrip("\r\n\x0b\x0c\x1c\x1d\x1e\x85  ") for x in lines)
    code, comment = mask_comments(flat)
    found = [(k, m.group(1)) for k, line in enumerate(code.split("\n")) if (m := _DECLARATION.match(line))]
    starts, floor = [], 0
    for k, _ in found:
        start = k
        # never above a former declaration, so that no chunk is empty
        while start > floor and (not lines[start - 1].strip() or comment[start - 1]):
            start -= 1
        starts.append(start)
        floor = k + 1
    out = []
    for (_, name), a, b in zip(found, starts, [*starts[1:], len(lines)][: len(starts)], strict=True):
        body = "".join(lines[a:b])
        out.append((f"src:{path}:{a + 1}:{b}", revision, path, a + 1, b, name, body, hashlib.sha256(body.encode()).hexdigest()))
    return out


def chunk_sources(files: DataFrame, revision: str) -> DataFrame:
    """Chunks of files (columns source_path, text); null texts have none."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [c for p, t in zip(*(x.to_pylist() for x in batch.columns), strict=True) for c in chunks(p, t or "", revision)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("source_path", "text").mapInArrow(scan, SCHEMA)


def line_chunks(files: DataFrame, starts_chunk: str, *, path="source_path", text="text") -> DataFrame:
    """Chunks of files without comments, as columns: a chunk begins at a line that matches
    and takes in the blank lines right above it; it ends before the next or with the file."""
    lines = files.select(path, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("n", F.col("pos") + 1)
    own = Window.partitionBy(path).orderBy("n")
    filled = F.max(F.when(F.trim("line") != "", F.col("n"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.withColumns({"begin": F.coalesce(filled, F.lit(0)) + 1, "last": F.max("n").over(Window.partitionBy(path))})
    heads = marked.where(F.col("line").rlike(starts_chunk))
    end = F.coalesce(F.lead("begin").over(own) - 1, F.col("last"))
    return heads.select(path, F.col("begin").alias("start_line"), end.alias("end_line"), F.col("n").alias("head_line"))
