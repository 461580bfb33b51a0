"""Smoke scenarios and replays: fixed questions to an index, with what they must find."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlinthError
from ..operators import context, evidence, graph, search
from ..operators.resolve import one
from ..sources import artifact as art
from ..sources.contract import Document, parsed
from ..sources.descriptors import ArchiveSource, GitSource, Runner, load_source
from ..sources.index import Index, build

SCENARIO, RECEIPT = "plinth.smoke-scenario.v1", "plinth.smoke-receipt.v1"
KINDS = ("search", "deps", "rdeps", "declared_boundary")
_ROW = "id string, kind string, mode string, n long, least long, required array<string>, observed array<string>, guard boolean, error string, message string"


def load_scenario(text: bytes) -> dict:
    """A scenario with the hash of its file."""
    d = parsed(text, "scenario", ValueError)
    d.among("schema", [SCENARIO])
    d.text("scenario_id"), d.whole("version"), d.text("source_repo")
    for name in ("research_refs", "evidence_classes"):
        d.texts(name)
    probes = d.value.get("probes")
    if not isinstance(probes, list) or not probes:
        raise ValueError("probes must be a list with a row")
    seen = set()
    for row in probes:
        p = Document(row, "probe", ValueError)
        if p.text("id") in seen:
            raise ValueError(f"probe {row['id']} occurs twice")
        seen.add(row["id"])
        kind = p.among("kind", KINDS)
        p.flag("regression_guard", False)
        if kind == "search":
            p.text("query")
            if "query_mode" in row:
                p.among("query_mode", search.MODES)
            if "required_declaration_hints" in row:
                p.texts("required_declaration_hints")
        else:
            p.text("declaration" if kind in ("deps", "rdeps") else "basis")
    return {**d.value, "sha256": hashlib.sha256(text).hexdigest()}


def _probe(index: Index, p: dict) -> tuple:
    kind, guard, mode = p["kind"], p.get("regression_guard", False), p.get("query_mode", "discovery")
    observed: list[str] = []
    required, n, least, error, message = p.get("required_ids", []), 0, p.get("min_edges", 0), None, None
    if kind == "search":
        required, least = p.get("required_declaration_hints", []), p.get("min_hits", 0)
        hits = index.search(p["query"], p.get("limit", search.DEFAULT_LIMIT), mode).select("declaration_hint").collect()
        n, observed = len(hits), [r[0] for r in hits if r[0]]
    elif kind in ("deps", "rdeps"):
        try:
            rows = walk(index, p["declaration"], p.get("depth", 1), reverse=kind == "rdeps")
            end = "source_id" if kind == "rdeps" else "target_id"
            # only what must be there is looked for, however many edges there are
            row = rows.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col(end).isin(required), F.col(end))).alias("met")).first()
            n, observed = row["n"], row["met"]
        except PlinthError as e:
            error, message = e.code, str(e)
    return p["id"], kind, mode, n, least, sorted(set(required)), sorted(set(observed)), guard, error, message


def walk(index: Index, name: str, depth: int, *, reverse: bool = False) -> DataFrame:
    """Dependencies of a name in an index whose graph is elaborated."""
    graph.check_depth(depth)
    graph.require_elaborated(index.meta["producer_kind"])
    return graph.ordered(graph.dependencies(index.adjacency, one(index.nodes, name), depth, reverse=reverse))


def probe_table(index: Index, scenario: dict) -> DataFrame:
    """Per probe its counts, state and whether it is a regression."""
    rows = index.spark.createDataFrame([_probe(index, p) for p in scenario["probes"]], _ROW)
    state = evidence.probe_state(F.col("kind"), F.col("n"), F.col("mode"), F.col("error"))
    worse = evidence.regression(F.col("guard"), F.col("n"), F.col("least"), F.col("required"), F.col("observed"), F.col("error"))
    missing = F.array_sort(F.array_except("required", "observed"))
    return rows.withColumns({"state": state, "regression": worse, "missing": missing})


def run_scenario(index: Index, loaded: art.Artifact, scenario: dict, tool_commit: str) -> dict:
    """The receipt of a scenario over a git artifact and the index made of it."""
    if loaded.schema != art.V1:
        raise TypeError("a smoke scenario needs a git artifact")
    if index.meta["artifact_identity"] != loaded.identity:
        raise ValueError("the index is of another artifact")
    if loaded.manifest["source"]["repo"] != scenario["source_repo"]:
        raise ValueError("the scenario is of another repository")
    probes = probe_table(index, scenario)
    rows = [json.loads(r[0]) for r in probes.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    overall = evidence.disposition(index.spark.createDataFrame([(r["state"], r["regression"]) for r in rows], "state string, regression boolean")).first()["disposition"]
    return {
        "schema": RECEIPT, "scenario": {k: scenario[k] for k in ("scenario_id", "version", "sha256", "research_refs", "evidence_classes")}, "tool_commit": tool_commit,
        "artifact": {"identity": loaded.identity, **loaded.manifest["source"], **loaded.manifest["scope"]}, "probes": rows, "observed_states": sorted({r["state"] for r in rows}),
        "overall_disposition": overall, "regression_detected": any(r["regression"] for r in rows), "scientific_authority": "NONE",
    }


# ---------------------------------------------------------------- replays


@dataclass
class Replay:
    """Questions to a corpus and what their answers must hold.

    exact: names to the path that they resolve to.  top: queries to a hint among the best ten.
    deps, rdeps: names to (depth, ids that must be reached).  context: names to the hint of a
    chunk.  few_paths: a query whose best ten lie in no more than ten paths and in fewer than
    the files that hold any of its words.
    """

    exact: dict[str, str] = field(default_factory=dict)
    top: dict[str, str] = field(default_factory=dict)
    deps: dict[str, tuple[int, set[str]]] = field(default_factory=dict)
    rdeps: dict[str, tuple[int, set[str]]] = field(default_factory=dict)
    context: dict[str, str] = field(default_factory=dict)
    few_paths: str | None = None
    corpus_class: str | None = None


def expected_source(loaded: art.Artifact, descriptor: bytes, runner: Runner) -> GitSource | ArchiveSource:
    """The descriptor's source, if the artifact was made from it by the pinned extractor."""
    source = load_source(descriptor)
    scope = loaded.manifest["scope"]
    if isinstance(source, GitSource) != (loaded.schema == art.V1):
        raise TypeError("descriptor and artifact are of different kinds")
    if not loaded.authoritative:
        raise ValueError("a replay needs an authoritative artifact")
    if source.authority != loaded.manifest["source"] or source.root_modules != scope["root_modules"] or source.exclude_source_prefixes != scope.get("exclude_source_prefixes", []):
        raise ValueError("the artifact is of another source or scope")
    if loaded.manifest["producer"] != runner.producer:
        raise ValueError("the artifact was made by another extractor")
    if loaded.schema == art.V2 and loaded.manifest["members"]["authority_receipt"]["sha256"] is None:
        raise ValueError("a replay of an archive needs the receipt")
    return source


def provenance(loaded: art.Artifact, receipt: bytes | None) -> dict:
    """What a replay says of its artifact's source; an archive's receipt adds the evidence."""
    if loaded.schema == art.V1:
        return dict(loaded.manifest["source"])
    art.check_receipt(receipt or b"", loaded.manifest)
    return {"source": dict(loaded.manifest["source"]), "materialization": parsed(receipt, "receipt", ValueError).value["materialization"]}


def prepare(spark: SparkSession, artifact: str, index: str, descriptor: bytes, runner: Runner) -> tuple[art.Artifact, Index]:
    """The checked artifact and an index built of it."""
    loaded = art.load_artifact(spark, artifact)
    expected_source(loaded, descriptor, runner)
    relations = {"nodes": loaded.nodes, "edges": loaded.edges, "sources": loaded.sources}
    build(relations, index, meta=loaded.index_meta())
    return loaded, Index(spark, index)


def top_contains(index: Index, query: str, hint: str) -> bool:
    """Whether one of the best ten hits has the hint."""
    return not index.search(query, 10).where(F.col("declaration_hint") == hint).isEmpty()


def require_chunks(rows: DataFrame) -> DataFrame:
    """Context rows, if they have the columns of chunks."""
    if lost := {"declaration_id", "source_path", "source_start_line", "text", "distance"} - set(rows.columns):
        raise ValueError(f"context rows lack {sorted(lost)}")
    return rows


def run_replay(index: Index, loaded: art.Artifact, replay: Replay, receipt: bytes | None = None) -> dict:
    """PASS with what was seen; the first answer that lacks something raises."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise AssertionError(what)

    seen: dict[str, object] = {}
    for name, path in replay.exact.items():
        hits = index.search(name, 1).select("source_path", "match_mode").collect()
        need([tuple(h) for h in hits] == [(path, "exact")], f"{name} does not resolve to {path}")
    for query, hint in replay.top.items():
        need(top_contains(index, query, hint), f"{hint} is not among the best ten of {query}")
    for kind, asked in (("deps", replay.deps), ("rdeps", replay.rdeps)):
        end = "target_id" if kind == "deps" else "source_id"
        for name, (depth, ids) in asked.items():
            rows = walk(index, name, depth, reverse=kind == "rdeps")
            row = rows.agg(F.count("*").alias("n"), F.bool_and(F.startswith("evidence_grade", F.lit("ELABORATED_"))).alias("elaborated"), F.collect_set(F.when(F.col(end).isin(sorted(ids)), F.col(end))).alias("met")).first()
            need(row["n"] > 0 and row["elaborated"], f"{kind} of {name} are no elaborated edges")
            need(ids <= set(row["met"]), f"{kind} of {name} lack {sorted(ids - set(row['met']))}")
            seen[f"{kind}:{name}"] = row["n"]
    for name, hint in replay.context.items():
        rows = require_chunks(context.context(index.nodes, index.adjacency, index.sources, name))
        told = rows.join(index.sources.select(F.col("id").alias("chunk_id"), "declaration_hint"), "chunk_id") if "declaration_hint" not in rows.columns else rows
        need(not told.where(F.col("declaration_hint") == hint).isEmpty(), f"the context of {name} lacks {hint}")
    if replay.few_paths:
        words = "|".join(search.query_terms(replay.few_paths.lower()))
        few = search.unique_paths(index.search(replay.few_paths, 10)).first()["n_paths"]
        many = index.sources.where(F.lower("text").rlike(words)).agg(F.countDistinct("source_path")).first()[0]
        need(few <= 10 and few < many, f"{few} paths instead of fewer than {many}")
        seen["paths"] = few
    if excluded := loaded.manifest["scope"].get("exclude_source_prefixes"):
        hit = F.lit(False)
        for prefix in excluded:
            hit = hit | F.startswith("source_path", F.lit(prefix))
        need(index.sources.where(hit).isEmpty(), "sources hold excluded paths")
    claim = {} if replay.corpus_class is None else {"corpus_class": replay.corpus_class, "proof_evidence": evidence.eligible(replay.corpus_class, None if replay.corpus_class == evidence.PROOF_CORPUS else [])}
    return {"status": "PASS", "artifact_identity": loaded.identity, "provenance": provenance(loaded, receipt), "seen": seen, **claim}
