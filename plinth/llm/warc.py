"""WARC archives: a distributed writer and a salvage reader.

The writer puts one record per page into archives in a shared folder, one archive per task
and about ``archive_bytes`` of payload, each record a gzip member of its own.  Of pages with
equal payloads the one with the smallest id is stored as ``response``; the others become
``revisit`` records that refer to it.

The salvage reader streams an archive record by record.  When a check fails (gzip data,
version line, headers, length, record end, digest), it searches for the next valid gzip
member or version line, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, new_path, spread_join

_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+[ \t]*\r?\n")
#: What a record may begin with, by which damaged bytes are searched.
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]")
_STEP = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


class Headers(dict):
    """Header fields by name, whatever its case; as written they are in the values."""

    def __init__(self, fields: list[tuple[str, str]]):
        super().__init__((name.lower(), value) for name, value in fields)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)

    @classmethod
    def parse(cls, raw: bytes) -> Headers:
        """Fields of ``name: value`` lines; space around a value is free, and a line that
        begins with space goes on with the field before it."""
        fields: list[tuple[str, str]] = []
        for line in raw.decode().replace("\r\n", "\n").split("\n"):
            if line[:1] in (" ", "\t") and fields:
                fields[-1] = fields[-1][0], f"{fields[-1][1]} {line.strip()}"
                continue
            name, colon, value = line.partition(":")
            if not colon or not name or name != name.strip():
                raise ValueError(f"no header field: {line}")
            fields.append((name, value.strip()))
        return cls(fields)


@dataclass
class Record:
    """One record as read back; ``offset`` and ``length`` are its bytes in the archive (of a
    gzip member with several records, the member's)."""

    offset: int
    length: int
    headers: Headers
    block: bytes = field(repr=False)

    @property
    def http(self) -> tuple[Headers, bytes]:
        """HTTP header fields and the payload behind them."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return Headers([(name, value.strip()) for name, colon, value in (x.partition(":") for x in lines) if colon]), payload


@dataclass
class Gap:
    """Quarantined bytes ``[start, end)`` of an archive and the failed check."""

    start: int
    end: int
    reason: str


def encode_record(kind: str, page_id: str | None, url: str | None, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z", compress: bool = True) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP header with the payload's length only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    # the uuid identifies the record; it names the page only through the page headers
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=%~"))
    if page_id is not None:
        lines.append("X-Page-Id: " + quote(page_id, safe=""))
    if refers_to is not None:
        lines += ["X-Refers-To-Page-Id: " + quote(refers_to, safe=""), "WARC-Profile: " + PROFILE]
    lines += [
        "WARC-Payload-Digest: sha1:" + sha1_base32(payload), "WARC-Block-Digest: sha1:" + sha1_base32(block),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Stream:
    """Random access to a forward-read file; keeps what lies after ``trim``."""

    def __init__(self, file):
        self.file, self.buffer, self.base, self.ended = file, bytearray(), 0, False

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(_STEP)
        self.ended |= not got
        self.buffer += got
        return bool(got)

    def get(self, at: int, n: int) -> bytes:
        while self.base + len(self.buffer) < at + n and self.more():
            pass
        return bytes(self.buffer[at - self.base : at - self.base + n])

    def trim(self, at: int) -> None:
        del self.buffer[: at - self.base]
        self.base = at


class _Bad(Exception):
    pass


def _member(stream: _Stream, at: int, limit: int) -> tuple[bytes, int | None, str]:
    """What decompressed of the gzip member at ``at``, its end, and what is wrong with it (the
    end is None then)."""
    opener, out, size, pos = zlib.decompressobj(31), [], 0, at
    while not opener.eof:
        data = stream.get(pos, _STEP)
        if not data:
            return b"".join(out), None, "gzip member is cut off"
        # in small steps, so that what stands before damaged bytes is kept
        for lo in range(0, len(data), 1 << 12):
            some = data[lo : lo + (1 << 12)]
            try:
                out.append(opener.decompress(some, limit - size + 1))
            except zlib.error:
                return b"".join(out), None, "gzip data is invalid"
            size += len(out[-1])
            if size > limit:
                return b"".join(out), None, "record is over the size limit"
            pos += len(some) - len(opener.unused_data)
            if opener.eof:
                break
    return b"".join(out), pos, ""


def _parse(raw: bytes, at: int = 0) -> tuple[Headers, bytes, int]:
    """Headers, block and end of the record that begins at ``at``."""
    version = _VERSION.match(raw, at)
    if not version:
        raise _Bad("no version line")
    ends = [(raw.find(gap, at), len(gap)) for gap in (b"\r\n\r\n", b"\n\n")]
    stop, gap = min((e for e in ends if e[0] >= 0), default=(-1, 0))
    if stop < 0:
        raise _Bad("header does not end")
    try:
        headers = Headers.parse(raw[version.end() : stop])
        length = int(headers["Content-Length"])
    except (ValueError, KeyError) as e:
        raise _Bad("header is malformed") from e
    end = stop + gap + length
    if length < 0 or len(raw) < end + 4:
        raise _Bad("record is cut off")
    if raw[end : end + 4] != b"\r\n\r\n":
        raise _Bad("record does not end at its length")
    block = raw[stop + gap : end]
    kind, _, digest = headers.get("WARC-Block-Digest", "").partition(":")
    if kind.lower() == "sha1" and digest.upper() != sha1_base32(block):
        raise _Bad("block digest differs")
    return headers, block, end + 4


def _inside(raw: bytes, sound: bool) -> tuple[list[tuple[Headers, bytes]], str]:
    """Records of a member's content, and the first failed check.

    In a damaged member (not ``sound``) the last record doesn't count, as no check tells that
    it is whole; nor does what is no record.
    """
    found, at, reason = [], 0, ""
    while at < len(raw):
        try:
            headers, block, end = _parse(raw, at)
        except _Bad as e:
            reason = reason or str(e)
            later = _VERSION.search(raw, at + 1)
            if later is None:
                break
            at = later.start()
            continue
        at = end
        if sound or _VERSION.match(raw, at):
            found.append((headers, block))
    return found, reason


def _at(stream: _Stream, at: int, limit: int) -> tuple[list[Record], int | None, str]:
    """Records that begin at ``at``, the end of what is sound there (None if nothing tells),
    and the failed check."""
    if stream.get(at, 3) == _GZIP:
        raw, end, reason = _member(stream, at, limit)
        found, inner = _inside(raw, end is not None)
        size = 0 if end is None else end - at
        if not found and not inner and not reason:
            inner = "no version line"
        return [Record(at, size, h, b) for h, b in found], end, reason or inner
    want = _STEP
    while True:
        raw = stream.get(at, want)
        if not _VERSION.match(raw):
            return [], None, "no gzip member or version line"
        try:
            headers, block, size = _parse(raw)
            return [Record(at, size, headers, block)], at + size, ""
        except _Bad as e:
            # a longer record or header than what was looked at
            if str(e) not in ("record is cut off", "header does not end") or len(raw) < want or want > limit:
                return [], None, str(e)
            want *= 4


def salvage(file, limit: int = 1 << 30) -> Iterator[Record | Gap]:
    """Reads records from a binary file; damaged bytes come out as gaps, in file order.

    A gzip member may hold several records; of a damaged one the records before the damage
    are recovered, and its bytes are a gap all the same.  ``limit`` bounds what a member, or
    a record outside of one, decompresses to.  An empty file yields nothing.
    """
    stream, at = _Stream(file), 0
    start, reason = None, ""
    while stream.get(at, 1):
        records, end, why = _at(stream, at, limit)
        if end is not None and not why and start is not None:
            yield Gap(start, at, reason)
            start = None
        yield from records
        if end is None or why:
            if start is None:
                start, reason = at, why
            at = end if end is not None else _next(stream, at + 1)
            if at is None:
                break
        else:
            at = end
        stream.trim(at)
    if start is not None:
        yield Gap(start, stream.base + len(stream.buffer), reason)


def _next(stream: _Stream, at: int) -> int | None:
    """The next place that may begin a record: a gzip magic or a version line."""
    while True:
        data = stream.get(at, _STEP)
        if not data:
            return None
        found = _BEGIN.search(data)
        if found:
            return at + found.start()
        if len(data) < _STEP:
            # to the end, so that the gap ends with the file
            at += len(data)
            continue
        at += len(data) - 8
        stream.trim(at)


# ---------------------------------------------------------------- Spark


def _open(path: str, mode: str):
    system, inner = fs.FileSystem.from_uri(path)
    if mode == "r":
        return system.open_input_stream(inner)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def with_roles(pages: DataFrame, *, page_id="page_id", url="url", html="html", least: int = 0) -> DataFrame:
    """Columns page_id, url, payload, refers_to (null for responses).

    Of pages with equal payloads of at least ``least`` bytes, those with the smallest id are
    responses.  Null ids come last; where all ids of a payload are null, all are responses.
    Repeated rows of the smallest id are all responses.  Only ids and digests meet by
    payload, by partial aggregation; payloads move once, by their own id.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    slim = pages.select(F.col(page_id).alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    firsts = slim.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1 and refers_to is not null"), "warc-payloads")
    met = spread_join(slim.select("page_id", "digest"), firsts, "digest", ["page_id"], count="n")
    revisits = met.where("not (page_id <=> refers_to)").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return rows.join(revisits, same, "left").select("page_id", "url", "payload", "refers_to")


def write_archives(roles: DataFrame, folder: str, *, archive_bytes: int = 256 << 20, compress: bool = True) -> DataFrame:
    """Writes the records and returns the stored manifest: path, records.

    A task that is run again writes new archives; only those named in the manifest count.
    """
    slim = roles.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "payload", F.col("refers_to").cast("string"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, size = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out, records, size = _open(path, "w"), 0, 0
                payload, refers = payload.as_py(), refers.as_py()
                out.write(encode_record("response" if refers is None else "revisit", page.as_py(), url.as_py(), payload, refers, compress=compress))
                records, size = records + 1, size + len(payload)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return materialize(slim.mapInArrow(write, "path string, records long"), "warc-manifest")


READ = "path string, offset long, length long, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, gap_reason string"


def read_archives(paths: DataFrame, *, payloads: bool = True, complete: bool = False) -> DataFrame:
    """Records and quarantined gaps of the archives in column ``path``.

    A gap has a null record_type and a gap_reason.  payload_bytes and payload_digest are of
    the full payload, for revisits as their headers tell.  ``payloads=False`` leaves the
    payload column null.  With ``complete``, an archive that does not yield as many records
    as column ``records`` says makes the reading fail.
    """
    spark = paths.sparkSession
    n = max(1, min(paths.count(), 10_000))
    out = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("gap_reason", pa.string())])

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return path, x.start, x.end - x.start, None, None, None, None, None, None, None, x.reason
        h = x.headers
        fields, payload = x.http
        page, refers, kind = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id"), h.get("WARC-Type")
        if kind == "response":
            size, digest = len(payload), sha1_base32(payload)
        else:
            size, digest = int(fields.get("Content-Length", 0)), h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        return path, x.offset, x.length, page and unquote(page), h.get("WARC-Target-URI"), kind, size, digest, refers and unquote(refers), payload if payloads and kind == "response" else None, None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, found = [], 0, 0
                with _open(path, "r") as file:
                    for x in salvage(file):
                        rows.append(row(path, x))
                        found += isinstance(x, Record)
                        size += len(rows[-1][9] or b"") + 100
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)
                            rows, size = [], 0
                if records is not None and found != records:
                    raise ValueError(f"{path} holds {found} of {records} records")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    return paths.select("path", (F.col("records") if complete else F.lit(None)).cast("long").alias("records")).repartition(n).mapInArrow(read, READ)


def round_trip(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back.

    Columns: page_id (of its own type), payload_bytes, payload_digest, record_type,
    refers_to.  A null html has an empty payload; an empty table gives no rows.
    A page that can't be read back makes the whole fail.
    """
    kind = pages.schema[columns.get("page_id", "page_id")].dataType
    manifest = write_archives(with_roles(pages, **columns), new_path(spark, "warc"))
    back = read_archives(manifest, payloads=False, complete=True).where("record_type is not null")
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
