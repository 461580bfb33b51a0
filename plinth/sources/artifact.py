"""Artifacts: the three relations with a manifest, written whole or not at all.

Version 1 holds corpora of git commits, version 2 those of archives; they name the revision of
a row differently (``source_commit``, ``source_revision``).  Members are Parquet tables or, in
release packages, JSON lines; a member's hash is the fingerprint of its rows, so it depends on
neither form nor layout.  Everything is checked when an artifact is written and again when it
is loaded, and the first broken rule raises.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BLOCKED_ARTIFACT, PlinthError
from ..operators import binding
from ..operators.fingerprint import artifact_identity, fingerprint
from ..operators.integrity import artifact_violations, difference, require
from ..operators.normalize import normalize
from ..schemas import EDGE_KEY, EDGES, NODES, SOURCES
from ..scratch import delete, hadoop, read_text, write_text
from .contract import HEX64, Document, canonical_line, parsed
from .linesink import write_lines
from .publish import publish
from .readers import read_raw_graph, read_rows

V1, V2 = "plinth.artifact.v1", "plinth.artifact.v2"
RECEIPTS = {V1: "plinth.raw-graph-receipt.v2", V2: "plinth.raw-graph-receipt.v3"}
BOUNDARY = "internal_only"
LEXICAL = "lexical_only"
REVISION = {V1: "source_commit", V2: "source_revision"}
AUTHORITATIVE = {V1: "created_from_authoritative_commit", V2: "created_from_authoritative_source"}
#: Field names of manifests and receipts, here and in the checks below.
SOURCE_FIELDS = {V1: ["repo", "commit", "subdir"], V2: ["kind", "url", "sha256", "format", "subdir"]}
PRODUCER_FIELDS = ["kind", "tool_repo", "tool_commit", "tool_hash"]
ORDER = {"nodes": ["id"], "edges": EDGE_KEY, "sources": ["source_path", "source_start_line", "id"]}
SCHEMAS = {"nodes": NODES, "edges": EDGES, "sources": SOURCES}
RECEIPT, RAW = "authority-receipt.json", "raw-depgraph.json"


def _blocked(message: str) -> PlinthError:
    return PlinthError(BLOCKED_ARTIFACT, message)


@dataclass
class Artifact:
    """A loaded artifact; ``sources`` is None where the manifest marks them absent."""

    manifest: dict
    nodes: DataFrame
    edges: DataFrame
    sources: DataFrame | None

    @property
    def schema(self) -> str:
        return self.manifest["schema"]

    @property
    def identity(self) -> str:
        return artifact_identity(self.manifest)

    @property
    def revision(self) -> str:
        return revision_of(self.manifest)

    @property
    def authoritative(self) -> bool:
        return self.manifest[AUTHORITATIVE[self.schema]]

    def index_meta(self) -> dict:
        """What a projection of this artifact says of where it comes from."""
        scope = self.manifest["scope"]
        own = {"artifact_identity": self.identity, "root_modules": scope["root_modules"], "dependency_boundary": scope["dependency_boundary"], "producer_kind": self.manifest["producer"]["kind"], AUTHORITATIVE[self.schema]: self.authoritative}
        if self.schema == V1:
            return {**own, "source_kind": "git", "source_commit": self.revision}
        return {**own, "source_kind": "archive", "source_revision": self.revision, "source_authority": self.manifest["source"]}


def revision_of(manifest: dict) -> str:
    return manifest["source"]["commit" if manifest["schema"] == V1 else "sha256"]


def producer_ref(manifest: dict) -> str:
    return f"{manifest['producer']['tool_repo']}@{manifest['producer']['tool_commit']}"


# ---------------------------------------------------------------- the manifest


def check_manifest(value: object) -> dict:
    """The manifest, after every rule that needs no rows."""
    m = Document(value, "manifest", _blocked)
    schema = m.among("schema", [V1, V2])
    m.exactly("schema", "source", "producer", "scope", "members", "counts", AUTHORITATIVE[schema])
    source = m.inner("source").exactly(*SOURCE_FIELDS[schema])
    for name in SOURCE_FIELDS[schema]:
        source.text(name, empty=name == "subdir")
    if schema == V2:
        source.among("kind", ["archive"])
    producer = m.inner("producer").exactly(*PRODUCER_FIELDS)
    for name in PRODUCER_FIELDS:
        producer.text(name)
    scope = m.inner("scope")
    scope.exactly("root_modules", "dependency_boundary", *(["exclude_source_prefixes"] if "exclude_source_prefixes" in scope.value else []))
    scope.texts("root_modules")
    scope.texts("exclude_source_prefixes", some=False)
    scope.among("dependency_boundary", [BOUNDARY])
    members = m.inner("members").exactly("nodes", "edges", "sources", "authority_receipt")
    for name in members.value:
        one = members.inner(name).exactly("sha256")
        if one.value["sha256"] is not None or name in ("nodes", "edges"):
            one.text("sha256", HEX64)
    counts = m.inner("counts").exactly("nodes", "edges")
    for name in ("nodes", "edges"):
        counts.whole(name)
    authoritative = m.flag(AUTHORITATIVE[schema])
    if authoritative and producer.value["kind"] != LEXICAL and members.value["authority_receipt"]["sha256"] is None:
        raise _blocked("an authoritative artifact needs its receipt")
    return m.value


def check_receipt(data: bytes, manifest: dict) -> str:
    """The hash of the raw graph that a receipt vouches for; it must agree with the manifest
    in source, scope and producer."""
    schema = manifest["schema"]
    r = parsed(data, "authority receipt", _blocked)
    r.among("schema", [RECEIPTS[schema]])
    more = ["materialization"] if schema == V2 else []
    r.exactly("schema", "source", "scope", "producer", "observed", "raw_depgraph", *more)
    same = {"source": manifest["source"], "scope": {"root_modules": manifest["scope"]["root_modules"]}, "producer": manifest["producer"]}
    for name, want in same.items():
        if r.value[name] != want:
            raise _blocked(f"receipt and manifest differ in {name}")
    if not r.inner("observed").exactly("lean_toolchain").text("lean_toolchain").strip():
        raise _blocked("the receipt names no toolchain")
    for name in more:
        evidence = r.inner(name).exactly("tree_sha256", "member_manifest_sha256")
        for key in evidence.value:
            evidence.text(key, HEX64)
    return r.inner("raw_depgraph").exactly("sha256").text("sha256", HEX64)


def make_receipt(manifest_like: dict, raw: bytes, toolchain: str, materialization: dict | None = None) -> bytes:
    """The receipt that binds a raw graph to its source, scope and producer."""
    schema = manifest_like["schema"]
    body = {
        "schema": RECEIPTS[schema], "source": manifest_like["source"], "scope": {"root_modules": manifest_like["scope"]["root_modules"]}, "producer": manifest_like["producer"],
        "observed": {"lean_toolchain": toolchain}, "raw_depgraph": {"sha256": hashlib.sha256(raw).hexdigest()},
    }
    return canonical_line(body if materialization is None else {**body, "materialization": materialization})


def member_names(manifest: dict) -> list[str]:
    """Names of a packaged artifact's files."""
    names = ["manifest.json", "nodes.jsonl", "edges.jsonl"]
    names += ["sources.jsonl"] if manifest["members"]["sources"]["sha256"] is not None else []
    names += [RECEIPT, RAW] if manifest["members"]["authority_receipt"]["sha256"] is not None else []
    return sorted(names)


# ---------------------------------------------------------------- rows


def _stored_form(df: DataFrame, name: str, schema: str) -> DataFrame:
    return df if name == "edges" else df.withColumnRenamed("source_revision", REVISION[schema])


def _canonical_form(df: DataFrame, name: str, schema: str) -> DataFrame:
    """The relation's own columns; a table with the other version's revision is refused."""
    if name == "edges":
        return df.select(*EDGES.names)
    other = REVISION[V2 if schema == V1 else V1]
    if other in df.columns or REVISION[schema] not in df.columns:
        raise _blocked(f"{name} of {schema} must have {REVISION[schema]} and not {other}")
    return df.withColumnRenamed(REVISION[schema], "source_revision").select(*SCHEMAS[name].names)


def write_member(df: DataFrame, name: str, schema: str, folder: str) -> list[dict]:
    """Writes a member as canonical JSON lines in its order and returns the list of parts."""
    stored = _stored_form(df.select(*SCHEMAS[name].names), name, schema)
    line = F.to_json(F.struct(*sorted(stored.columns)), {"ignoreNullFields": "false"})
    return write_lines(stored, line, ORDER[name], folder)


def _exists(spark: SparkSession, path: str) -> bool:
    target, system = hadoop(spark, path)
    return system.exists(target)


def _member(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame | None:
    if _exists(spark, f"{folder}/{name}"):
        return _canonical_form(spark.read.parquet(f"{folder}/{name}"), name, schema)
    lines = f"{folder}/{name}.jsonl"
    if not _exists(spark, lines):
        return None
    if name != "edges":
        other = REVISION[V2 if schema == V1 else V1]
        keys = spark.read.text(lines).where("value != ''").select(F.json_object_keys("value").alias("k"))
        if keys.where(F.col("k").isNull() | F.array_contains("k", other)).limit(1).count():
            raise _blocked(f"{name}.jsonl has a line that is no object or names {other}")
    fields = SCHEMAS[name] if name == "edges" else _renamed(SCHEMAS[name], schema)
    return _canonical_form(read_rows(spark, lines, fields), name, schema)


def _renamed(fields, schema: str):
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(REVISION[schema] if f.name == "source_revision" else f.name, f.dataType, f.nullable) for f in fields.fields])


# ---------------------------------------------------------------- write and load


def write_artifact(relations: dict[str, DataFrame | None], target: str, *, source: dict, producer: dict, scope: dict, authoritative: bool = False, receipt: bytes | None = None, raw: bytes | None = None) -> dict:
    """Writes sorted Parquet members to a staging folder, loads that with all checks, and
    publishes it.  Returns the manifest.

    An archive's artifact is authoritative just if it has a receipt and the raw graph.
    """
    spark = relations["nodes"].sparkSession
    schema = V2 if source.get("kind") == "archive" else V1
    if schema == V2 and authoritative != (receipt is not None and raw is not None):
        raise _blocked("an archive's artifact is authoritative just with a receipt and its raw graph")
    staged = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        prints = {}
        for name, keys in ORDER.items():
            if relations.get(name) is None:
                continue
            rows = relations[name].select(*SCHEMAS[name].names)
            _stored_form(rows.sortWithinPartitions(*keys), name, schema).write.parquet(f"{staged}/{name}")
            prints[name] = fingerprint(_canonical_form(spark.read.parquet(f"{staged}/{name}"), name, schema)).first()
        members = {name: {"sha256": prints[name]["fingerprint"] if name in prints else None} for name in ORDER}
        members["authority_receipt"] = {"sha256": None if receipt is None else hashlib.sha256(receipt).hexdigest()}
        manifest = {
            "schema": schema, "source": source, "producer": producer, "scope": {"dependency_boundary": BOUNDARY, **{k: v for k, v in scope.items() if v or k != "exclude_source_prefixes"}},
            "members": members, "counts": {n: prints[n]["rows"] for n in ("nodes", "edges")}, AUTHORITATIVE[schema]: authoritative,
        }
        for name, data in ((RECEIPT, receipt), (RAW, raw)):
            if data is not None:
                write_text(spark, f"{staged}/{name}", data.decode())
        write_text(spark, f"{staged}/manifest.json", canonical_line(manifest).decode())
        load_artifact(spark, staged)
        publish(spark, staged, target)
    finally:
        delete(spark, staged)
    return manifest


def load_artifact(spark: SparkSession, folder: str) -> Artifact:
    """An artifact after every rule was checked."""
    folder = folder.rstrip("/")
    text = read_text(spark, f"{folder}/manifest.json")
    if text is None:
        raise _blocked("no manifest")
    manifest = check_manifest(parsed(text, "manifest", _blocked).value)
    schema, members = manifest["schema"], manifest["members"]
    exact = manifest[AUTHORITATIVE[schema]] and manifest["producer"]["kind"] != LEXICAL
    tables: dict[str, DataFrame | None] = {}
    for name in ORDER:
        tables[name] = _member(spark, folder, name, schema)
        want = members[name]["sha256"]
        if (tables[name] is None) != (want is None):
            raise _blocked(f"{name} is missing" if want else f"{name} is there but the manifest marks it absent")
        if want is None:
            continue
        print_ = fingerprint(tables[name]).first()
        if print_["fingerprint"] != want:
            raise _blocked(f"{name} differs from its hash")
        if name in manifest["counts"] and print_["rows"] != manifest["counts"][name]:
            raise _blocked(f"{name} has {print_['rows']} rows instead of {manifest['counts'][name]}")
    _check_authority(spark, folder, manifest, exact)
    sources = tables["sources"] if tables["sources"] is not None else spark.createDataFrame([], SOURCES)
    nodes, edges, revision = tables["nodes"], tables["edges"], revision_of(manifest)
    archive = schema == V2 and manifest[AUTHORITATIVE[schema]]
    roots = manifest["scope"]["root_modules"]
    require(artifact_violations(nodes, edges, sources, roots=roots, revision=revision, producer=producer_ref(manifest), authoritative_archive=archive))
    if archive:
        _same(binding.bind_by_suffix(nodes, sources), nodes, ["id", "source_path", "source_start_line", "source_end_line"], "places of nodes differ from their binding")
    if exact:
        raw_nodes, raw_edges = read_raw_graph(spark, f"{folder}/{RAW}")
        made_nodes, made_edges = normalize(raw_nodes, raw_edges, roots, producer=producer_ref(manifest), revision=revision)
        if schema == V2:
            made_nodes = binding.bind_by_suffix(made_nodes, sources)
            made_edges = binding.restrict_edges(made_edges, made_nodes)
        _same(made_nodes, nodes, ["id", "full_name", "name", "kind", "module", "source_revision"], "nodes don't derive from the raw graph")
        _same(made_edges, edges, EDGES.names, "edges don't derive from the raw graph")
    return Artifact(manifest, nodes, edges, tables["sources"])


def _check_authority(spark: SparkSession, folder: str, manifest: dict, exact: bool) -> None:
    want = manifest["members"]["authority_receipt"]["sha256"]
    receipt, raw = (read_text(spark, f"{folder}/{name}") for name in (RECEIPT, RAW))
    if (receipt is None) != (want is None):
        raise _blocked("the receipt is missing" if want else "a receipt is there but the manifest marks it absent")
    if exact and raw is None:
        raise _blocked("an authoritative artifact needs its raw graph")
    if receipt is None:
        return
    if hashlib.sha256(receipt.encode()).hexdigest() != want:
        raise _blocked("the receipt differs from its hash")
    if raw is None or hashlib.sha256(raw.encode()).hexdigest() != check_receipt(receipt.encode(), manifest):
        raise _blocked("the raw graph differs from its receipt")


def _same(a: DataFrame, b: DataFrame, columns: list[str], what: str) -> None:
    if not difference(a.select(*columns), b.select(*columns)).isEmpty():
        raise _blocked(what)


def export_lines(loaded: Artifact, target: str) -> dict[str, list[dict]]:
    """Writes the relations of an artifact as folders of JSON lines, ``nodes.jsonl`` and so on,
    and returns their parts by name.  A loader reads such folders as it reads files."""
    names = [n.removesuffix(".jsonl") for n in member_names(loaded.manifest) if n.endswith(".jsonl")]
    return {f"{n}.jsonl": write_member(getattr(loaded, n), n, loaded.schema, f"{target.rstrip('/')}/{n}.jsonl") for n in names}
