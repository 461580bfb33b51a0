"""Descriptors of sources, of the extractor that made a graph, and the catalog of accepted corpora."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..errors import BLOCKED_BINDING, BLOCKED_CATALOG, PlinthError
from .contract import HEX40, HEX64, Document, parsed

GIT_V1, GIT_V2, ARCHIVE_V1, RUNNER_V1, CATALOG_V1 = (f"plinth.{x}" for x in ("git-source.v1", "git-source.v2", "archive-source.v1", "runner.v1", "accepted-catalog.v1"))
#: Fields of the documents.
GIT_FIELDS = ["schema", "source_id", "source_repo", "source_commit", "source_subdir", "root_modules", "build_target"]
ARCHIVE_FIELDS = ["schema", "source_id", "archive_url", "archive_sha256", "archive_format", "source_subdir", "root_modules", "build_target", "exclude_source_prefixes"]
RUNNER_FIELDS = ["schema", "extractor_repo", "extractor_commit", "extractor_main_sha256", "elan_version", "elan_sha256"]
CORPUS_FIELDS = ["source_id", "release_tag", "package_asset", "receipt_asset", "source_descriptor", "artifact_identity", "fingerprint_sha256"]

_SOURCE_ID = re.compile(r"[a-z0-9][a-z0-9-]*")
_REPOSITORY = re.compile(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+")
_TARGET = re.compile(r"\S+")


def _binding(message: str) -> PlinthError:
    return PlinthError(BLOCKED_BINDING, message)


def _catalog(message: str) -> PlinthError:
    return PlinthError(BLOCKED_CATALOG, message)


@dataclass(frozen=True)
class Source:
    """What git and archive sources share."""

    schema: str
    source_id: str
    source_subdir: str
    root_modules: list[str]
    build_target: str
    exclude_source_prefixes: list[str] = field(default_factory=list, kw_only=True)


@dataclass(frozen=True)
class GitSource(Source):
    source_repo: str
    source_commit: str

    @property
    def authority(self) -> dict:
        return {"repo": self.source_repo, "commit": self.source_commit, "subdir": self.source_subdir}


@dataclass(frozen=True)
class ArchiveSource(Source):
    archive_url: str
    archive_sha256: str
    archive_format: str

    @property
    def authority(self) -> dict:
        return {"kind": "archive", "url": self.archive_url, "sha256": self.archive_sha256, "format": self.archive_format, "subdir": self.source_subdir}


def excluded(d: Document) -> list[str]:
    """Prefixes with a slash behind them, in order, none twice."""
    out = []
    for value in d.texts("exclude_source_prefixes", some=False):
        parts = [p for p in value.split("/") if p not in ("", ".")]
        if value.startswith("/") or ".." in parts:
            raise d.fail("exclude_source_prefixes must stay inside the source")
        if not parts:
            raise d.fail("exclude_source_prefixes must not leave out everything")
        out.append("/".join(parts) + "/")
    if len(set(out)) != len(out) or out != sorted(out):
        raise d.fail("exclude_source_prefixes must be different and in order")
    return out


def _common(d: Document) -> dict:
    return {
        "schema": d.value["schema"], "source_id": d.text("source_id", _SOURCE_ID), "source_subdir": d.relative("source_subdir", empty=True), "root_modules": d.texts("root_modules"),
        "build_target": d.text("build_target", _TARGET), "exclude_source_prefixes": excluded(d),
    }


def load_source(text: str | bytes) -> GitSource | ArchiveSource:
    """A source descriptor, by its schema."""
    d = parsed(text, "source descriptor", _binding)
    schema = d.among("schema", [GIT_V1, GIT_V2, ARCHIVE_V1])
    if schema == ARCHIVE_V1:
        d.exactly(*ARCHIVE_FIELDS)
        url = d.text("archive_url")
        at = urlsplit(url)
        if at.scheme != "https" or not at.netloc or at.username or at.password or at.fragment:
            raise _binding("archive_url must be an https address without credentials or fragment")
        d.among("archive_format", ["zip"])
        return ArchiveSource(**_common(d), archive_url=url, archive_sha256=d.text("archive_sha256", HEX64), archive_format="zip")
    d.exactly(*GIT_FIELDS, *(["exclude_source_prefixes"] if schema == GIT_V2 else []))
    return GitSource(**_common(d), source_repo=d.text("source_repo", re.compile(r"[^/]+/[^/]+")), source_commit=d.text("source_commit", HEX40))


def load_git_source(text: str | bytes) -> GitSource:
    source = load_source(text)
    if not isinstance(source, GitSource):
        raise _binding("the source is no git source")
    return source


def load_archive_source(text: str | bytes) -> ArchiveSource:
    source = load_source(text)
    if not isinstance(source, ArchiveSource):
        raise _binding("the source is no archive")
    return source


@dataclass(frozen=True)
class Runner:
    schema: str
    extractor_repo: str
    extractor_commit: str
    extractor_main_sha256: str
    elan_version: str
    elan_sha256: str

    @property
    def producer(self) -> dict:
        """The pin that artifacts made by this extractor carry."""
        return {"kind": "lean-dep-viz", "tool_repo": self.extractor_repo, "tool_commit": self.extractor_commit, "tool_hash": self.extractor_main_sha256}


def load_runner(text: str | bytes) -> Runner:
    d = parsed(text, "runner", _binding).exactly(*RUNNER_FIELDS)
    d.among("schema", [RUNNER_V1])
    patterns = {"extractor_commit": HEX40, "extractor_main_sha256": HEX64, "elan_sha256": HEX64}
    return Runner(**{name: d.text(name, patterns.get(name)) for name in RUNNER_FIELDS})


def environment(source: Source, runner: Runner) -> dict[str, str]:
    """Key-values of a source and its extractor for a build's environment; lists as CSV."""
    flat = {**asdict(source), **{k: v for k, v in asdict(runner).items() if k != "schema"}}
    return {k.upper(): ",".join(v) if isinstance(v, list) else v for k, v in flat.items() if k != "schema"}


@dataclass(frozen=True)
class Catalog:
    schema: str
    release_repository: str
    corpora: list[dict[str, str]]

    @property
    def digest(self) -> str:
        from ..operators.fingerprint import catalog_digest

        return catalog_digest(asdict(self))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(c[f] for f in CORPUS_FIELDS) for c in self.corpora], ", ".join(f"{f} string" for f in CORPUS_FIELDS))


def load_catalog(text: str | bytes) -> Catalog:
    """The accepted corpora; no two share an id, a tag, an asset of a release or an artifact."""
    d = parsed(text, "catalog", _catalog).exactly("schema", "release_repository", "corpora")
    schema = d.among("schema", [CATALOG_V1])
    repository = d.text("release_repository", _REPOSITORY)
    rows = d.value["corpora"]
    if not isinstance(rows, list) or not rows:
        raise _catalog("corpora must be a list with a row")
    corpora = []
    for k, row in enumerate(rows):
        one = Document(row, f"corpora[{k}]", _catalog).exactly(*CORPUS_FIELDS)
        patterns = {"artifact_identity": HEX64, "fingerprint_sha256": HEX64}
        values = {name: one.text(name, patterns.get(name)) for name in CORPUS_FIELDS}
        parts = values["source_descriptor"].split("/")
        if parts[:2] != ["producer", "sources"] or len(parts) < 3 or {"", ".", ".."} & set(parts) or not values["source_descriptor"].endswith(".json"):
            raise _catalog(f"corpora[{k}].source_descriptor must name a JSON file under producer/sources/")
        corpora.append(values)
    for names in (["source_id"], ["release_tag"], ["release_tag", "package_asset"], ["artifact_identity"]):
        if len({tuple(c[n] for n in names) for c in corpora}) != len(corpora):
            raise _catalog(f"{' and '.join(names)} occur twice")
    return Catalog(schema, repository, corpora)
