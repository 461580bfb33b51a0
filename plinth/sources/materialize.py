"""Archive sources on disk: extracted once, with a receipt and a manifest of members.

The work here is of one archive and small next to what is read from it later, so it runs on
the driver; contents are read again by Spark, against the manifest (``readers.read_listed``).
"""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO

from ..errors import BLOCKED_BINDING, BLOCKED_MISMATCH, PlinthError
from ..operators.fingerprint import tree_digest
from .archives import UnsafeMember, members
from .contract import HEX64, Document, canonical_line, parsed
from .descriptors import ArchiveSource, Source

RECEIPT_V1, MANIFEST_V1 = "plinth.archive-materialization-receipt.v1", "plinth.archive-member-manifest.v1"
_BLOCK = 1 << 20


def _blocked(message: str) -> PlinthError:
    return PlinthError(BLOCKED_BINDING, message)


def _mismatch(message: str) -> PlinthError:
    return PlinthError(BLOCKED_MISMATCH, message)


def fetch(source: ArchiveSource, out: Path, opener: Callable[[str], BinaryIO]) -> None:
    """Copies the archive block by block and checks its hash.  ``opener`` opens its address."""
    sha = hashlib.sha256()
    try:
        with opener(source.archive_url) as stream, out.open("wb") as file:
            while block := stream.read(_BLOCK):
                sha.update(block)
                file.write(block)
    except OSError as e:
        raise _blocked(f"the archive can't be read: {e}") from e
    if sha.hexdigest() != source.archive_sha256:
        raise _mismatch(f"the archive has hash {sha.hexdigest()}")


def source_root(source: Source, folder: Path) -> Path:
    """The folder of sources within what is materialised."""
    base = folder.resolve()
    root = (base / source.source_subdir).resolve()
    if root != base and base not in root.parents:
        raise _blocked("the source root escapes the materialised source")
    if not root.is_dir():
        raise _blocked(f"no folder {source.source_subdir}")
    return root


def member_manifest(source: ArchiveSource, hashes: list[tuple[str, str]], below: str) -> bytes:
    """Canonical list of members; source_path is a member's path below the source root."""
    prefix = "" if below == "." else below + "/"
    rows = [{"path": p, "source_path": p.removeprefix(prefix) if p.startswith(prefix) else None, "sha256": h} for p, h in sorted(hashes)]
    return canonical_line({"schema": MANIFEST_V1, "source": source.authority, "source_root_relative": below, "members": rows})


def manifest_path(receipt: Path) -> Path:
    return receipt.with_name(f"{receipt.stem}.members.json")


def materialize(source: ArchiveSource, dest: Path, receipt: Path, opener: Callable[[str], BinaryIO]) -> dict:
    """Extracts the archive to ``dest`` and publishes manifest and receipt, none over another
    file.  What fails leaves nothing behind."""
    dest, receipt = dest.resolve(), receipt.resolve()
    for path in (receipt, manifest_path(receipt)):
        if path == dest or dest in path.parents or path in dest.parents:
            raise _blocked(f"{path} and {dest} must not lie within each other")
        if path.exists():
            raise _blocked(f"{path} is there already")
    if dest.exists() and (not dest.is_dir() or any(dest.iterdir())):
        raise _blocked(f"{dest} is no empty folder")
    for folder in (dest.parent, receipt.parent):
        folder.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=f".{dest.name}.staging-", dir=dest.parent))
    try:
        fetch(source, stage / "archive", opener)
        made = stage / "made"
        made.mkdir()
        hashes = []
        try:
            for name, data in members(str(stage / "archive")):
                target = made / name
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(data)
                hashes.append((name, hashlib.sha256(data).hexdigest()))
        except UnsafeMember as e:
            raise _blocked(f"unsafe member {e}") from e
        except (OSError, ValueError, RuntimeError, EOFError, KeyError) as e:
            raise _blocked(f"the archive can't be extracted: {e}") from e
        below = source_root(source, made).relative_to(made.resolve()).as_posix()
        listing = member_manifest(source, hashes, below)
        body = {"file_count": len(hashes), "tree_sha256": tree_digest(hashes), "member_manifest_sha256": hashlib.sha256(listing).hexdigest(), "source_root_relative": below}
        told = {"schema": RECEIPT_V1, "source": source.authority, "materialized": body}
        _publish(made, dest, [(manifest_path(receipt), listing), (receipt, canonical_line(told))], stage)
        return told
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def _publish(made: Path, dest: Path, files: list[tuple[Path, bytes]], stage: Path) -> None:
    done: list[Path] = []
    try:
        if dest.exists():
            dest.rmdir()
        os.replace(made, dest)
        for k, (path, data) in enumerate(files):
            staged = stage / f"file{k}"
            staged.write_bytes(data)
            # a link never replaces a file that has come meanwhile
            os.link(staged, path)
            done.append(path)
    except OSError as e:
        shutil.rmtree(dest, ignore_errors=True)
        for path in done:
            path.unlink(missing_ok=True)
        raise _blocked(f"the materialised source can't be published: {e}") from e


def read_evidence(source: ArchiveSource, dest: Path, receipt: Path) -> tuple[dict, Document]:
    """The receipt's evidence and the member manifest, which agree with each other and with
    the descriptor.  Members themselves are not read."""
    try:
        told = parsed(receipt.read_bytes(), "materialisation receipt", _blocked)
        raw = manifest_path(receipt).read_bytes()
    except OSError as e:
        raise _blocked(f"evidence is missing: {e}") from e
    told.among("schema", [RECEIPT_V1])
    body = told.inner("materialized").exactly("file_count", "tree_sha256", "member_manifest_sha256", "source_root_relative")
    body.whole("file_count")
    for name in ("tree_sha256", "member_manifest_sha256"):
        body.text(name, HEX64)
    below = body.text("source_root_relative")
    if told.value.get("source") != source.authority:
        raise _mismatch("the receipt is of another source")
    if source_root(source, dest).relative_to(dest.resolve()).as_posix() != below:
        raise _mismatch("the source root differs")
    if hashlib.sha256(raw).hexdigest() != body.value["member_manifest_sha256"]:
        raise _mismatch("the member manifest differs from its hash")
    listing = parsed(raw, "member manifest", _blocked).exactly("schema", "source", "source_root_relative", "members")
    listing.among("schema", [MANIFEST_V1])
    if listing.value["source"] != source.authority or listing.value["source_root_relative"] != below:
        raise _mismatch("the member manifest is of another source")
    if not isinstance(listing.value["members"], list):
        raise _blocked("members must be a list")
    return body.value, listing


def verify(source: ArchiveSource, dest: Path, receipt: Path) -> dict:
    """The member manifest, after every member on disk was found to be what it says."""
    dest = dest.resolve()
    body, listing = read_evidence(source, dest, receipt)
    hashes: list[tuple[str, str]] = []
    seen: set[str] = set()
    for row in listing.value["members"]:
        one = Document(row, "member", _blocked).exactly("path", "source_path", "sha256")
        path, sha = one.relative("path"), one.text("sha256", HEX64)
        if "\\" in path or Path(path).as_posix() != path or path in seen:
            raise _blocked(f"unsafe or repeated member {path}")
        seen.add(path)
        target = dest / path
        try:
            if not stat.S_ISREG(target.lstat().st_mode):
                raise _mismatch(f"{path} is no regular file")
            found = hashlib.sha256(target.read_bytes()).hexdigest()
        except OSError as e:
            raise _mismatch(f"{path} is missing") from e
        if found != sha:
            raise _mismatch(f"{path} differs from its hash")
        hashes.append((path, sha))
    if hashes != sorted(hashes):
        raise _blocked("members are not in order")
    if len(hashes) != body["file_count"] or tree_digest(hashes) != body["tree_sha256"]:
        raise _mismatch("the members are not the receipt's")
    if member_manifest(source, hashes, body["source_root_relative"]) != manifest_path(receipt).read_bytes():
        raise _mismatch("source paths of members differ")
    return listing.value


def stable_evidence(source: ArchiveSource, dest: Path, receipt: Path) -> dict[str, str]:
    """The hashes that a raw graph's receipt cites, if nothing changes while they are checked."""
    before = receipt.read_bytes() if receipt.exists() else None
    verify(source, dest, receipt)
    body, _ = read_evidence(source, dest, receipt)
    if receipt.read_bytes() != before:
        raise _mismatch("the receipt changed meanwhile")
    return {name: body[name] for name in ("tree_sha256", "member_manifest_sha256")}


def publish_once(path: Path, data: bytes) -> None:
    """Writes a file that must not be there."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, staged = tempfile.mkstemp(prefix=f".{path.name}.", dir=path.parent)
    try:
        with os.fdopen(fd, "wb") as file:
            file.write(data)
        os.link(staged, path)
    except OSError as e:
        raise _blocked(f"{path} can't be published: {e}") from e
    finally:
        Path(staged).unlink(missing_ok=True)
