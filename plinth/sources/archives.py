"""A data source for members of zip and tar.gz archives.

``spark.read.format("archive_members").load(path)`` yields archive, path, content, sha256 and
bytes.  Of a zip or a plain tar only the directory is read first, and all its names are checked;
its members are dealt to tasks by ranges of about ``splitBytes``, which read them by their
offsets.  A compressed tar can only be read from its start and is one task.  A member longer than
option ``mostBytes`` fails instead of filling the memory.  Paths are addresses of any file system
that Arrow knows, or local ones; a folder or a pattern stands for its files.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import posixpath
import stat
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_BYTES, SPLIT_BYTES = 1 << 30, 64 << 20
_STORED, _DEFLATED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED
_PIECE, _SMALL = 1 << 20, 1 << 12


class UnsafeMember(ValueError):
    pass


class Names:
    """Names seen so far; refuses ones that could leave the target or hide another member."""

    def __init__(self):
        self._files: set[str] = set()
        self._folders: set[str] = set()

    def check(self, name: str) -> None:
        if not name or "\\" in name or "\0" in name or name.startswith("/") or ".." in name.split("/") or posixpath.normpath(name) != name:
            raise UnsafeMember(name)
        above = name.split("/")
        folders = {"/".join(above[:k]) for k in range(1, len(above))}
        if name in self._files or name in self._folders or folders & self._files:
            raise UnsafeMember(f"{name} occurs twice or as a folder too")
        self._files.add(name)
        self._folders |= folders


def check_member(name: str, seen: set[str]) -> None:
    """:class:`Names` over a set of names."""
    names = Names()
    for other in seen:
        names.check(other)
    names.check(name)
    seen.add(name)


def opened(path: str):
    """A file that can be read at any place, from an address or a local path."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    file = system.open_input_file(inner)
    # the zip reader tries places before the start of very small files
    return file if file.size() > _SMALL else io.BytesIO(file.read())


def listed(path: str) -> list[str]:
    """The files that a path, a folder or a pattern of names in a folder stands for."""
    scheme, inner = (path.split("://", 1)[0] + "://", path) if "://" in path else ("", path.removeprefix("file:"))
    system, inner = fs.FileSystem.from_uri(path) if scheme and not set("*?[") & set(path) else (fs.FileSystem.from_uri(path.rsplit("/", 1)[0])[0] if scheme else fs.LocalFileSystem(), inner)
    if set("*?[") & set(inner):
        folder, pattern = inner.rsplit("/", 1)
        base = fs.FileSystem.from_uri(folder)[1] if scheme else folder
        found = [f.path for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file and fnmatch.fnmatchcase(f.base_name, pattern)]
    else:
        info = system.get_file_info(inner)
        found = [inner] if info.is_file else [f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
    prefix = "file://" if scheme == "file://" else scheme
    return sorted(prefix + f if scheme else f for f in found)


def _read(file, name: str, most: int) -> bytes:
    content = file.read(most + 1)
    if len(content) > most:
        raise UnsafeMember(f"{name} is longer than {most} bytes")
    return content


@dataclass(frozen=True)
class Member:
    """Where a regular file of an archive lies: of a zip at its local header, of a tar at its
    content."""

    name: str
    offset: int
    size: int
    packed: int
    method: int | None
    crc: int | None
    utf8: bool = False


def _zip_name(info: zipfile.ZipInfo, names: Names) -> bool:
    """Checks a directory entry; whether it is a file."""
    kind = stat.S_IFMT(info.external_attr >> 16)
    if kind not in (0, stat.S_IFREG, stat.S_IFDIR) or (kind == stat.S_IFDIR) > info.is_dir() or (kind == stat.S_IFREG and info.is_dir()):
        raise UnsafeMember(info.filename)
    if info.is_dir():
        if ".." in info.filename.split("/") or info.filename.startswith("/") or "\\" in info.filename:
            raise UnsafeMember(info.filename)
        return False
    names.check(info.filename)
    return True


def directory(path: str) -> list[Member] | None:
    """The files of an archive, all names checked; None if it can only be read from its start."""
    names, found = Names(), []
    with opened(path) as file:
        if zipfile.is_zipfile(file):
            file.seek(0)
            with zipfile.ZipFile(file) as z:
                for info in z.infolist():
                    if _zip_name(info, names):
                        if info.flag_bits & 1 or info.compress_type not in (_STORED, _DEFLATED):
                            raise UnsafeMember(f"{info.filename} is encrypted or packed in an unknown way")
                        found.append(Member(info.filename, info.header_offset, info.file_size, info.compress_size, info.compress_type, info.CRC, bool(info.flag_bits & 0x800)))
            return found
        file.seek(0)
        try:
            t = tarfile.open(fileobj=file, mode="r:")
        except tarfile.ReadError:
            return None
        with t:
            for info in t:
                if info.isdir():
                    continue
                if not info.isreg() or info.issparse():
                    raise UnsafeMember(info.name)
                names.check(info.name)
                found.append(Member(info.name, info.offset_data, info.size, info.size, None, None))
        return found


def ranges(found: list[Member], split: int) -> list[list[Member]]:
    """The members in order of their place, in runs of about ``split`` bytes."""
    out: list[list[Member]] = []
    size = split
    for m in sorted(found, key=lambda m: m.offset):
        if size >= split:
            out.append([])
            size = 0
        out[-1].append(m)
        size += m.packed + 512
    return out


def content_at(file, m: Member, most: int) -> bytes:
    """A member's bytes, read at its place; sizes, check sum and name must be the directory's."""
    if m.size > most:
        raise UnsafeMember(f"{m.name} is longer than {most} bytes")
    file.seek(m.offset)
    if m.method is None:
        data = file.read(m.size)
        if len(data) != m.size:
            raise UnsafeMember(f"{m.name} is cut off")
        return data
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise UnsafeMember(f"{m.name} has no header")
    name, more = struct.unpack("<HH", head[26:30])
    if file.read(name).decode("utf-8" if m.utf8 else "cp437", "replace").split("\0")[0] != m.name:
        raise UnsafeMember(f"{m.name} has another name at its place")
    file.seek(m.offset + 30 + name + more)
    opener = zlib.decompressobj(-15) if m.method == _DEFLATED else None
    out, size, left = [], 0, m.packed
    while left > 0:
        data = file.read(min(left, _PIECE))
        if not data:
            break
        left -= len(data)
        try:
            out.append(data if opener is None else opener.decompress(data, m.size - size + 1))
        except zlib.error as e:
            raise UnsafeMember(f"{m.name} can't be unpacked") from e
        size += len(out[-1])
        if size > m.size:
            break
    whole = b"".join(out)
    if len(whole) != m.size or zlib.crc32(whole) != m.crc:
        raise UnsafeMember(f"{m.name} is not what the directory says")
    return whole


def members(path: str, most: int = MOST_BYTES) -> Iterator[tuple[str, bytes]]:
    """Regular files of an archive; links, special files and names whose kind contradicts
    their mark are refused."""
    found = directory(path)
    with opened(path) as file:
        if found is not None:
            for m in sorted(found, key=lambda m: m.offset):
                yield m.name, content_at(file, m, most)
            return
        names = Names()
        with tarfile.open(fileobj=file, mode="r:*") as t:
            for info in t:
                if info.isdir():
                    continue
                if not info.isreg():
                    raise UnsafeMember(info.name)
                names.check(info.name)
                yield info.name, _read(t.extractfile(info), info.name, most)


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int, split: int):
        self.paths, self.most, self.split = listed(path), most, split

    def partitions(self):
        found = [(p, directory(p)) for p in self.paths]
        return [InputPartition((p, part)) for p, held in found for part in ([None] if held is None else ranges(held, self.split))] or [InputPartition((None, []))]

    def read(self, partition):
        path, part = partition.value
        if part is None:
            rows = members(path, self.most)
        elif not part:
            return
        else:
            rows = self._at(path, part)
        for name, content in rows:
            yield path, name, content, hashlib.sha256(content).hexdigest(), len(content)

    def _at(self, path: str, part: list[Member]) -> Iterator[tuple[str, bytes]]:
        with opened(path) as file:
            for m in part:
                yield m.name, content_at(file, m, self.most)


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, path string, content binary, sha256 string, bytes long"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("mostBytes", MOST_BYTES)), int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveMembers)
