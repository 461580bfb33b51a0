"""The local cache of accepted corpora: verified releases with their indexes.

A corpus lies under catalog digest, index version, source id and artifact identity, so nothing
in the cache is ever changed: it is verified and used, or rebuilt beside it and put in its
place.  The loop is over the catalog's corpora on the driver; each one's checks run on Spark.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import PlinthError
from . import artifact as art
from .contract import canonical_line, parsed
from .descriptors import Catalog
from .index import VERSION, Index, build
from .releases import RebuildRequired, ReleaseInvalid, verify_and_extract

RECEIPT = "plinth.local-cache-verification.v1"
FIELDS = [
    "schema", "catalog_sha256", "index_version", "source_id", "release_tag", "package_asset", "receipt_asset", "package_sha256", "receipt_sha256", "artifact_identity",
    "fingerprint_sha256", "projection_fingerprint", "source_descriptor_sha256", "runner_config_sha256",
]
_LOCK_SECONDS = 30.0
#: Gives an asset of a release: (repository, tag, asset) to its bytes.
Provider = Callable[[str, str, str], bytes]


@dataclass
class State:
    """A corpus that may be searched."""

    source_id: str
    release_tag: str
    artifact_identity: str
    fingerprint_sha256: str
    folder: Path
    index: Index


def folder_provider(root: Path) -> Provider:
    """Assets that lie in folders named by their tag."""

    def get(repository: str, tag: str, asset: str) -> bytes:
        return (root / tag / asset).read_bytes()

    return get


def command_provider(*command: str) -> Provider:
    """Assets that a command downloads; it is given repository, tag, asset and a folder."""

    def get(repository: str, tag: str, asset: str) -> bytes:
        import subprocess

        with tempfile.TemporaryDirectory() as folder:
            subprocess.run([*command, repository, tag, asset, folder], check=True)
            return (Path(folder) / asset).read_bytes()

    return get


def cache_path(root: Path, catalog: Catalog, corpus: dict) -> Path:
    return root / catalog.digest / VERSION / corpus["source_id"] / corpus["artifact_identity"]


class Cache:
    """Corpora of one catalog.  ``repository`` holds the descriptors that the catalog names."""

    def __init__(self, spark: SparkSession, catalog: Catalog, repository: Path, root: Path, provider: Provider, runner: str = "producer/runner.json"):
        self.spark, self.catalog, self.repository, self.root, self.provider, self.runner = spark, catalog, repository, root, provider, runner

    def _config(self, corpus: dict) -> tuple[bytes, bytes]:
        return (self.repository / corpus["source_descriptor"]).read_bytes(), (self.repository / self.runner).read_bytes()

    def _fixed(self, corpus: dict) -> dict:
        """What the receipt of a corpus must say."""
        same = {k: corpus[k] for k in ("source_id", "release_tag", "package_asset", "receipt_asset", "artifact_identity", "fingerprint_sha256")}
        return {"schema": RECEIPT, "catalog_sha256": self.catalog.digest, "index_version": VERSION, **same}

    def verify(self, folder: Path, corpus: dict) -> State:
        """The corpus in a folder, if receipt, artifact and index are what they should be."""
        receipt = parsed((folder / "verified.json").read_bytes(), "cache receipt", ValueError).exactly(*FIELDS).value
        for name, want in self._fixed(corpus).items():
            if receipt[name] != want:
                raise ValueError(f"the cache differs in {name}")
        descriptor, runner = (hashlib.sha256(x).hexdigest() for x in self._config(corpus))
        if (receipt["source_descriptor_sha256"], receipt["runner_config_sha256"]) != (descriptor, runner):
            raise RebuildRequired("REBUILD_REQUIRED: descriptor or extractor differ from the cached ones")
        loaded = art.load_artifact(self.spark, f"file://{folder.resolve()}/release/artifact")
        if loaded.identity != corpus["artifact_identity"]:
            raise ValueError("the cached artifact has another identity")
        index = Index(self.spark, f"file://{folder.resolve()}/index")
        index.verify()
        if index.meta["fingerprint"] != receipt["projection_fingerprint"]:
            raise ValueError("the cached index has another fingerprint")
        return State(corpus["source_id"], corpus["release_tag"], loaded.identity, corpus["fingerprint_sha256"], folder, index)

    def _build(self, stage: Path, corpus: dict) -> None:
        package, receipt = (self.provider(self.catalog.release_repository, corpus["release_tag"], corpus[k]) for k in ("package_asset", "receipt_asset"))
        verified = verify_and_extract(self.spark, package, receipt, *self._config(corpus), stage / "release")
        for name in ("artifact_identity", "fingerprint_sha256"):
            if verified[name] != corpus[name]:
                raise ReleaseInvalid(f"RELEASE_EVIDENCE_INVALID: the catalog has another {name}")
        loaded = art.load_artifact(self.spark, f"file://{stage.resolve()}/release/artifact")
        relations = {"nodes": loaded.nodes, "edges": loaded.edges, "sources": loaded.sources}
        print_ = build(relations, f"file://{stage.resolve()}/index", meta=loaded.index_meta())
        told = {
            **self._fixed(corpus), "package_sha256": verified["package_sha256"], "receipt_sha256": hashlib.sha256(receipt).hexdigest(), "projection_fingerprint": print_,
            "source_descriptor_sha256": verified["source_descriptor_sha256"], "runner_config_sha256": verified["runner_config_sha256"],
        }
        (stage / "verified.json").write_bytes(canonical_line(told))

    def _usable(self, final: Path, corpus: dict) -> State | None:
        if not final.exists():
            return None
        try:
            return self.verify(final, corpus)
        except (OSError, TypeError, ValueError):  # also drift: a rebuild tells it
            return None

    def ensure(self, corpus: dict) -> State:
        """The corpus from the cache, or built, checked and put there.

        Of two builders one puts its work in place and the other uses that.  An invalid folder
        is moved aside, under a lock, and comes back if its successor fails.
        """
        final = cache_path(self.root, self.catalog, corpus)
        if (state := self._usable(final, corpus)) is not None:
            return state
        final.parent.mkdir(parents=True, exist_ok=True)
        stage = Path(tempfile.mkdtemp(prefix=f".{final.name[:16]}.staging-", dir=final.parent))
        try:
            self._build(stage, corpus)
            self.verify(stage, corpus)
            with _locked(final):
                if (state := self._usable(final, corpus)) is not None:
                    return state
                aside = final.with_name(f".{final.name[:16]}.invalid-{uuid.uuid4().hex}")
                if final.exists():
                    os.rename(final, aside)
                try:
                    os.rename(stage, final)
                    state = self.verify(final, corpus)
                except Exception:
                    shutil.rmtree(final, ignore_errors=True)
                    if aside.exists():
                        os.rename(aside, final)
                    raise
                shutil.rmtree(aside, ignore_errors=True)
                return state
        finally:
            shutil.rmtree(stage, ignore_errors=True)

    def ensure_all(self) -> tuple[list[State], list[tuple[str, str, str]]]:
        """States of the usable corpora, and (source_id, code, message) of the others."""
        states, lost = [], []
        for corpus in self.catalog.corpora:
            try:
                states.append(self.ensure(corpus))
            except RebuildRequired as e:
                lost.append((corpus["source_id"], "REBUILD_REQUIRED", str(e)))
            except ReleaseInvalid as e:
                lost.append((corpus["source_id"], "RELEASE_EVIDENCE_INVALID", str(e)))
            except PlinthError as e:
                lost.append((corpus["source_id"], e.code, str(e)))
            except (OSError, TypeError, ValueError, RuntimeError) as e:
                lost.append((corpus["source_id"], "LOCAL_CACHE_UNAVAILABLE", str(e)))
        return states, lost


@contextlib.contextmanager
def _locked(final: Path) -> Iterator[None]:
    """One repair of a folder at a time, across processes; the lock goes with its holder."""
    import fcntl

    path = final.with_name(f".{final.name[:16]}.lock")
    with path.open("w") as file:
        until = time.monotonic() + _LOCK_SECONDS
        while True:
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > until:
                    raise OSError(f"{path} is locked") from None
                time.sleep(0.05)
        yield
