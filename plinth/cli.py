"""Commands over artifacts and indexes; each prints one line of JSON.

    python -m plinth.cli search --index FOLDER --query WORDS

Errors go to the other stream as a line with status, code and message, and the command
returns 2.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BLOCKED_BINDING, BLOCKED_CATALOG, BLOCKED_MISMATCH, PlinthError
from .operators import binding, chunking, context, federation, graph, search
from .operators.normalize import normalize
from .operators.resolve import one
from .plans.scenarios import walk
from .schemas import RELATIONS
from .sources import artifact as art
from .sources import checkout, materialize, readers
from .sources.contract import parsed
from .sources.descriptors import ArchiveSource, GitSource, load_catalog, load_source
from .sources.index import Index, build
from .sources.localcache import Cache, Provider, folder_provider


def session() -> SparkSession:
    return SparkSession.builder.appName("plinth").getOrCreate()


def emit(payload: dict, stream=None) -> None:
    (stream or sys.stdout).write(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n")


def address(path: str | Path) -> str:
    return str(path) if "://" in str(path) else f"file://{Path(path).resolve()}"


# ---------------------------------------------------------------- results as told


def told(rows: DataFrame) -> list[dict]:
    """A bounded result as objects, nulls included."""
    return [json.loads(r[0]) for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).collect()]


def named_revision(row: dict, meta: dict) -> dict:
    """A row as told: rows of git corpora name a commit and leave kind and authority out."""
    out = {k: v for k, v in row.items() if k not in ("source_kind", "source_authority", "source_revision")}
    if meta["source_kind"] == "git":
        return {**out, "source_commit": row.get("source_revision")}
    return {**out, "source_kind": "archive", "source_revision": row.get("source_revision"), "source_authority": meta["source_authority"]}


def provenance(meta: dict) -> dict:
    if meta["source_kind"] == "git":
        return {"created_from_authoritative_commit": meta["created_from_authoritative_commit"]}
    return {k: meta[k] for k in ("source_kind", "source_revision", "source_authority", "created_from_authoritative_source")}


def hit_payload(row: dict, meta: dict) -> dict:
    flag = "created_from_authoritative_commit" if meta["source_kind"] == "git" else "created_from_authoritative_source"
    return {**named_revision(row, meta), flag: meta[flag]}


def graph_payload(query: str, edges: list[dict], meta: dict, found: bool = True) -> dict:
    """FOUND or UNKNOWN: a bounded miss is not absence."""
    return {
        "status": "FOUND" if found else "UNKNOWN", "query": query, "edges": edges, "scope_root_modules": meta["root_modules"], "dependency_boundary": meta["dependency_boundary"],
        "complete_within_scope": True, **provenance(meta),
    }


# ---------------------------------------------------------------- commands


def _published(spark: SparkSession, out: str, relations: dict, **about) -> dict:
    manifest = art.write_artifact(relations, address(out), **about)
    loaded = art.Artifact(manifest, **{k: relations[k] for k in ("nodes", "edges", "sources")})
    return {"status": "BUILT", "artifact_identity": loaded.identity, **manifest["counts"], "sources": relations["sources"].count(), "out": out}


def _bound_receipt(receipt: bytes, raw: bytes, about: dict, materialization: dict | None = None) -> None:
    """The receipt vouches for this raw graph, source, scope, producer and materialisation."""
    told_ = parsed(receipt, "raw graph receipt", lambda m: PlinthError(BLOCKED_BINDING, m))
    tool = told_.inner("observed").exactly("lean_toolchain").text("lean_toolchain")
    if art.make_receipt(about, raw, tool, materialization) != receipt and json.loads(art.make_receipt(about, raw, tool, materialization)) != told_.value:
        raise PlinthError(BLOCKED_MISMATCH, "the receipt is of another graph, source, scope or producer")


def build_artifact(spark: SparkSession, a: argparse.Namespace) -> dict:
    """From a git checkout: nodes and edges of the raw graph, or none, and chunks of the files."""
    root = Path(a.source_root)
    about = {
        "source": {"repo": a.source_repo, "commit": a.source_commit, "subdir": a.source_subdir}, "scope": {"root_modules": a.root_module, "exclude_source_prefixes": a.exclude_source_prefix},
        "producer": {"kind": a.producer_kind, "tool_repo": a.producer_tool_repo, "tool_commit": a.producer_tool_commit, "tool_hash": a.producer_tool_hash},
    }
    if a.lexical_only:
        about["producer"]["kind"] = art.LEXICAL
    receipt = raw = None
    if a.authoritative_readback:
        checkout.verify(root, repo=a.source_repo, commit=a.source_commit, subdir=a.source_subdir)
        if not a.lexical_only:
            if a.raw_depgraph_receipt is None:
                raise PlinthError(BLOCKED_BINDING, "an authoritative artifact needs the receipt of its raw graph")
            receipt, raw = Path(a.raw_depgraph_receipt).read_bytes(), Path(a.raw_depgraph).read_bytes()
            _bound_receipt(receipt, raw, {"schema": art.V1, **about})
    listed = checkout.tracked_files(spark, root, excluded=a.exclude_source_prefix) if a.authoritative_readback else None
    files = readers.read_tree(spark, str(root.resolve()), excluded=a.exclude_source_prefix, listed=listed)
    sources = chunking.chunk_sources(files, a.source_commit)
    if a.lexical_only:
        nodes, edges = (spark.createDataFrame([], art.SCHEMAS[x]) for x in ("nodes", "edges"))
    else:
        producer = f"{a.producer_tool_repo}@{a.producer_tool_commit}"
        nodes, edges = normalize(*readers.read_raw_graph(spark, address(a.raw_depgraph)), a.root_module, producer=producer, revision=a.source_commit)
        nodes = binding.bind_unique(nodes, sources)
    return _published(spark, a.out, {"nodes": nodes, "edges": edges, "sources": sources}, **about, authoritative=a.authoritative_readback, receipt=receipt, raw=raw)


def build_archive_artifact(spark: SparkSession, a: argparse.Namespace) -> dict:
    """From a materialised archive: chunks of the listed files, and nodes bound to them."""
    source = load_source(Path(a.source).read_bytes())
    if not isinstance(source, ArchiveSource):
        raise PlinthError(BLOCKED_BINDING, "the source is no archive")
    base = Path(a.materialization_root)
    body, listing = materialize.read_evidence(source, base, Path(a.materialization_receipt))
    if Path(a.member_manifest).resolve() != materialize.manifest_path(Path(a.materialization_receipt)).resolve():
        raise PlinthError(BLOCKED_MISMATCH, "the member manifest is not the receipt's")
    about = {
        "source": source.authority, "scope": {"root_modules": source.root_modules, "exclude_source_prefixes": source.exclude_source_prefixes},
        "producer": {"kind": a.producer_kind, "tool_repo": a.producer_tool_repo, "tool_commit": a.producer_tool_commit, "tool_hash": a.producer_tool_hash},
    }
    receipt, raw = Path(a.raw_depgraph_receipt).read_bytes(), Path(a.raw_depgraph).read_bytes()
    _bound_receipt(receipt, raw, {"schema": art.V2, **about}, {k: body[k] for k in ("tree_sha256", "member_manifest_sha256")})
    members = spark.createDataFrame([(m["source_path"], m["sha256"]) for m in listing.value["members"]], "source_path string, sha256 string")
    root = materialize.source_root(source, base)
    files = readers.read_listed(spark, str(root), members, excluded=source.exclude_source_prefixes)
    sources = chunking.chunk_sources(files, source.archive_sha256)
    producer = f"{a.producer_tool_repo}@{a.producer_tool_commit}"
    nodes, edges = normalize(*readers.read_raw_graph(spark, address(a.raw_depgraph)), source.root_modules, producer=producer, revision=source.archive_sha256)
    nodes = binding.bind_by_suffix(nodes, sources)
    edges = binding.restrict_edges(edges, nodes)
    return _published(spark, a.out, {"nodes": nodes, "edges": edges, "sources": sources}, **about, authoritative=True, receipt=receipt, raw=raw)


def build_source_artifact(spark: SparkSession, a: argparse.Namespace) -> dict:
    """By the descriptor's kind, always authoritative."""
    source = load_source(Path(a.source).read_bytes())
    pins = {k: getattr(a, k) for k in ("producer_kind", "producer_tool_repo", "producer_tool_commit", "producer_tool_hash", "raw_depgraph", "raw_depgraph_receipt", "out")}
    if isinstance(source, GitSource):
        return build_artifact(spark, argparse.Namespace(
            source_root=a.source_root, source_repo=source.source_repo, source_commit=source.source_commit, source_subdir=source.source_subdir, root_module=source.root_modules,
            exclude_source_prefix=source.exclude_source_prefixes, authoritative_readback=True, lexical_only=False, **pins,
        ))
    if a.materialization_receipt is None or a.member_manifest is None:
        raise PlinthError(BLOCKED_BINDING, "an archive needs its materialisation receipt and member manifest")
    return build_archive_artifact(spark, argparse.Namespace(source=a.source, materialization_root=a.source_container, materialization_receipt=a.materialization_receipt, member_manifest=a.member_manifest, **pins))


def verify_artifact(spark: SparkSession, a: argparse.Namespace) -> dict:
    loaded = art.load_artifact(spark, address(a.artifact))
    n = 0 if loaded.sources is None else loaded.sources.count()
    return {"status": "VERIFIED", "artifact_identity": loaded.identity, **loaded.manifest["counts"], "sources": n, "dependency_boundary": loaded.manifest["scope"]["dependency_boundary"]}


def build_index(spark: SparkSession, a: argparse.Namespace) -> dict:
    loaded = art.load_artifact(spark, address(a.artifact))
    sources = loaded.sources if loaded.sources is not None else spark.createDataFrame([], art.SOURCES)
    print_ = build({"nodes": loaded.nodes, "edges": loaded.edges, "sources": sources}, address(a.index), meta=loaded.index_meta())
    return {"status": "BUILT", "fingerprint": print_, "index": a.index}


def search_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    index = Index(spark, address(a.index))
    hits = told(index.search(a.query, a.limit, a.mode))
    sure = a.mode == "evidence" or all(h["match_mode"] == "exact" for h in hits)
    status = "UNKNOWN" if not hits else "FOUND" if sure else "CANDIDATE"
    return {"status": status, "query": a.query, "query_mode": a.mode, "hits": [hit_payload(h, index.meta) for h in hits]}


def multicorpus_search(spark: SparkSession, a: argparse.Namespace, provider: Provider | None = None) -> dict:
    try:
        catalog = load_catalog(Path(a.catalog).read_bytes())
    except OSError as e:
        raise PlinthError(BLOCKED_CATALOG, f"no catalog: {e}") from e
    cache = Cache(spark, catalog, Path(a.catalog).resolve().parent.parent, Path(a.cache_dir), provider or folder_provider(Path(a.releases)))
    states, lost = cache.ensure_all()
    finders = {s.source_id: lambda q, n, m, s=s: s.index.search(q, n, m) for s in states}
    hits, missing, searched = federation.search_states(spark, finders, lost, a.query, limit=a.limit, mode=a.mode)
    meta = {s.source_id: s.index.meta for s in states}
    rows, gone = told(hits), told(missing)
    sure = a.mode == "evidence" or (bool(rows) and all(r["match_mode"] == "exact" for r in rows))
    status = spark.range(1).select(federation.status_of(F.lit(len(rows)), F.lit(searched), F.lit(len(gone)), F.lit(sure))).first()[0]
    return {
        "status": status, "query": a.query, "query_mode": a.mode, "catalog_sha256": catalog.digest, "searched_corpora": searched, "unavailable_corpora": len(gone), "unavailable": gone,
        "hits": [hit_payload(r, meta[r["source_id"]]) for r in rows],
    }


def walk_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    index = Index(spark, address(a.index))
    reverse = a.command == "rdeps"
    rows = walk(index, a.name, a.depth, reverse=reverse)
    return graph_payload(f"{'reverse_dependencies' if reverse else 'dependencies'}:{a.name}", told(rows), index.meta)


def path_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    index = Index(spark, address(a.index))
    graph.check_depth(a.max_depth)
    graph.require_elaborated(index.meta["producer_kind"])
    row = graph.shortest_path(index.adjacency, one(index.nodes, a.source), one(index.nodes, a.target), a.max_depth).first()
    grades = dict(RELATIONS.values())
    edges = [{**e.asDict(), "evidence_grade": grades[e["relation"]], "depth": k} for k, e in enumerate(row["path"], 1)]
    return graph_payload(f"path:{a.source}->{a.target}", edges, index.meta, row["found"])


def context_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    index = Index(spark, address(a.index))
    graph.check_depth(a.depth)
    graph.require_elaborated(index.meta["producer_kind"])
    rows = context.context_envelope(index.nodes, index.adjacency, index.sources, a.name, depth=a.depth, budget=a.token_budget, roots=index.meta["root_modules"], boundary=index.meta["dependency_boundary"])
    payload = told(rows)[0]
    payload["chunks"] = [{**named_revision(c, index.meta), "evidence_grade": "LEXICAL_HIT"} for c in payload["chunks"]]
    return {"status": "FOUND", **payload, **provenance(index.meta)}


# ---------------------------------------------------------------- the parser

_PINS = ["producer-kind", "producer-tool-repo", "producer-tool-commit", "producer-tool-hash"]
#: Commands: their function, required options, optional ones with defaults.
#: Names of commands and of their options.
COMMANDS = {
    "build-artifact": (build_artifact, ["source-root", "source-repo", "source-commit", "source-subdir", *_PINS, "out"], {"raw-depgraph-receipt": None}),
    "build-source-artifact": (build_source_artifact, ["source", "source-root", "source-container", "raw-depgraph", "raw-depgraph-receipt", *_PINS, "out"], {"materialization-receipt": None, "member-manifest": None}),
    "build-archive-artifact": (build_archive_artifact, ["source", "materialization-root", "materialization-receipt", "member-manifest", "raw-depgraph", "raw-depgraph-receipt", *_PINS, "out"], {}),
    "verify-artifact": (verify_artifact, ["artifact"], {}),
    "build-index": (build_index, ["artifact", "index"], {}),
    "multicorpus-search": (multicorpus_search, ["catalog", "cache-dir", "releases", "query"], {"limit": federation.DEFAULT_LIMIT}),
    "search": (search_command, ["index", "query"], {"limit": search.DEFAULT_LIMIT}),
    "deps": (walk_command, ["index", "name"], {"depth": 1}),
    "rdeps": (walk_command, ["index", "name"], {"depth": 1}),
    "path": (path_command, ["index", "source", "target"], {"max-depth": graph.MAX_DEPTH}),
    "context": (context_command, ["index", "name"], {"depth": 1, "token-budget": context.DEFAULT_BUDGET}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plinth")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (run, required, optional) in COMMANDS.items():
        p = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for option in required:
            p.add_argument(f"--{option}", required=True)
        for option, default in optional.items():
            p.add_argument(f"--{option}", default=default, type=int if isinstance(default, int) else str)
        if name in ("search", "multicorpus-search"):
            p.add_argument("--mode", choices=search.MODES, default="discovery")
        if name == "build-artifact":
            p.add_argument("--root-module", action="append", required=True)
            p.add_argument("--exclude-source-prefix", action="append", default=[])
            p.add_argument("--authoritative-readback", action="store_true")
            kind = p.add_mutually_exclusive_group(required=True)
            kind.add_argument("--raw-depgraph")
            kind.add_argument("--lexical-only", action="store_true")
        p.set_defaults(run=run)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        emit(args.run(spark or session(), args))
    except PlinthError as e:
        emit({"status": e.status, "code": e.code, "message": str(e)}, sys.stderr)
        return 2
    except (PySparkException, OSError) as e:
        e = PlinthError("UNAVAILABLE_PROJECTION", str(e).splitlines()[0] if str(e) else type(e).__name__)
        emit({"status": e.status, "code": e.code, "message": str(e)}, sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
