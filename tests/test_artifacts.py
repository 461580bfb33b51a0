"""Artifacts, indexes, releases, the local cache and the commands, from files to results."""

import hashlib
import json
import subprocess
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plinth import cli
from plinth import scratch
from plinth.errors import PlinthError
from plinth.operators import evidence, federation
from plinth.operators.generations import InputError, envelope_hits
from plinth.plans import scenarios
from plinth.sources import archives, artifact, checkout, descriptors, localcache, materialize, readers, releases
from plinth.sources.contract import canonical_line, strict_json
from plinth.sources.index import Index, build, check_provenance

COMMIT, TOOL, HASH = "a" * 40, "b" * 40, "c" * 64
PRODUCER = {"kind": "lean-dep-viz", "tool_repo": "o/tool", "tool_commit": TOOL, "tool_hash": HASH}
RUNNER = {"schema": descriptors.RUNNER_V1, "extractor_repo": "o/tool", "extractor_commit": TOOL, "extractor_main_sha256": HASH, "elan_version": "v1", "elan_sha256": HASH}
FILES = {"Z/A.lean": "import X\n\n/-- rank trace of a thing -/\ntheorem one : x := y\n\ntheorem two : one\n", "Z/B.lean": "structure Box where\n  side : Nat\n\nlemma three : école\n"}
GRAPH = {
    "nodes": [{"name": n.rsplit(".", 1)[-1], "module": m, "kind": "thm", "fullName": n} for n, m in [("Z.A.one", "Z.A"), ("Z.A.two", "Z.A"), ("Z.B.Box", "Z.B"), ("Z.B.Box.side", "Z.B"), ("Z.B.three", "Z.B"), ("M.ext", "M")]],
    "edges": [{"source": "Z.A.one", "target": "two", "kind": "value"}, {"source": "Z.A.two", "target": "Z.B.three", "kind": "type"}, {"source": "M.ext", "target": "Z.A.one", "kind": "type"}, {"source": "Z.B.Box", "target": "Z.B.Box.side", "kind": "type"}],
}


def archive_source(data: bytes, **more) -> dict:
    return {
        "schema": descriptors.ARCHIVE_V1, "source_id": "z", "archive_url": "https://host/z.zip", "archive_sha256": hashlib.sha256(data).hexdigest(), "archive_format": "zip", "source_subdir": "src", "root_modules": ["Z"],
        "build_target": "Z", "exclude_source_prefixes": [], **more,
    }


def git_source(**more) -> dict:
    return {"schema": descriptors.GIT_V1, "source_id": "g", "source_repo": "o/n", "source_commit": COMMIT, "source_subdir": "", "root_modules": ["Z"], "build_target": "Z", **more}


class Opener:
    def __init__(self, data):
        self.data = data

    def __call__(self, url):
        import io

        return io.BytesIO(self.data)


def _lines(spark, df, name, schema):
    """The rows of a member as it is written."""
    folder = scratch.new_path(spark, "lines")
    parts = artifact.write_member(df, name, schema, folder)
    return [json.loads(x) for p in parts for x in scratch.read_text(spark, f"{folder}/{p['name']}").splitlines()]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A materialised archive, its artifact, index and release."""
    base = tmp_path_factory.mktemp("made")
    zipped = base / "z.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for name, text in FILES.items():
            z.writestr(f"src/{name}", text)
        z.writestr("README", "not listed")
    data = zipped.read_bytes()
    descriptor = json.dumps(archive_source(data)).encode()
    source = descriptors.load_archive_source(descriptor)
    dest, receipt = base / "tree", base / "receipt.json"
    body = materialize.materialize(source, dest, receipt, Opener(data))["materialized"]
    raw = json.dumps(GRAPH).encode()
    told = artifact.make_receipt({"schema": artifact.V2, "source": source.authority, "scope": {"root_modules": ["Z"]}, "producer": PRODUCER}, raw, "lean4", {k: body[k] for k in ("tree_sha256", "member_manifest_sha256")})
    for name, content in (("source.json", descriptor), ("raw.json", raw), ("raw-receipt.json", told), ("runner.json", json.dumps(RUNNER).encode())):
        (base / name).write_bytes(content)
    pins = [x for k in ("kind", "tool_repo", "tool_commit", "tool_hash") for x in (f"--producer-{k.replace('_', '-')}", PRODUCER[k])]
    argv = ["build-source-artifact", "--source", str(base / "source.json"), "--source-root", str(dest / "src"), "--source-container", str(dest), "--materialization-receipt", str(receipt), "--member-manifest", str(materialize.manifest_path(receipt)), "--raw-depgraph", str(base / "raw.json"), "--raw-depgraph-receipt", str(base / "raw-receipt.json"), *pins, "--out", str(base / "artifact")]
    assert cli.main(argv, spark) == 0
    assert cli.main(["build-index", "--artifact", str(base / "artifact"), "--index", str(base / "index")], spark) == 0
    return base


def run(spark, capsys, *argv):
    code = cli.main(argv, spark)
    out = capsys.readouterr()
    return code, json.loads((out.out or out.err).strip().split("\n")[-1])


def test_commands_over_an_index(spark, made, capsys):
    index = str(made / "index")
    code, told = run(spark, capsys, "verify-artifact", "--artifact", str(made / "artifact"))
    assert (code, told["status"], told["nodes"], told["edges"], told["sources"]) == (0, "VERIFIED", 5, 3, 4)
    code, told = run(spark, capsys, "search", "--index", index, "--query", "two")
    hit = told["hits"][0]
    assert told["status"] == "FOUND" and hit["declaration_id"] == "lean:Z.A.two" and hit["match_mode"] == "exact" and hit["source_path"] == "Z/A.lean" and hit["source_kind"] == "archive" and "source_commit" not in hit
    code, told = run(spark, capsys, "search", "--index", index, "--query", "trace rank")
    assert told["status"] == "CANDIDATE" and told["hits"][0]["declaration_id"] == "lean:Z.A.one" and told["hits"][0]["match_mode"] == "any_terms"
    assert run(spark, capsys, "search", "--index", index, "--query", "trace rank", "--mode", "evidence")[1]["status"] == "FOUND"
    assert run(spark, capsys, "search", "--index", index, "--query", "nothing here")[1]["status"] == "UNKNOWN"
    code, told = run(spark, capsys, "deps", "--index", index, "--name", "three", "--depth", "2")
    assert [(e["source_id"], e["depth"]) for e in told["edges"]] == [("lean:Z.B.three", 1), ("lean:Z.A.two", 2)] and told["source_kind"] == "archive"
    assert len(run(spark, capsys, "rdeps", "--index", index, "--name", "one")[1]["edges"]) == 1
    code, told = run(spark, capsys, "path", "--index", index, "--source", "three", "--target", "Z.A.one")
    assert told["status"] == "FOUND" and [e["depth"] for e in told["edges"]] == [1, 2]
    assert run(spark, capsys, "path", "--index", index, "--source", "one", "--target", "three")[1]["status"] == "UNKNOWN"
    code, told = run(spark, capsys, "context", "--index", index, "--name", "three", "--token-budget", "12")
    assert told["target_id"] == "lean:Z.B.three" and [c["distance"] for c in told["chunks"]] == [0, 1] and told["estimated_tokens"] <= 12
    code, told = run(spark, capsys, "deps", "--index", index, "--name", "gone")
    assert (code, told["status"], told["code"]) == (2, "ERROR", "UNKNOWN")
    code, told = run(spark, capsys, "search", "--index", str(made / "none"), "--query", "x")
    assert (code, told["status"]) == (2, "UNAVAILABLE")


def test_index_equals_a_scan(spark, made):
    from plinth.operators import search

    index = Index(spark, f"file://{made}/index")
    sources = index.sources.drop("doc")
    for query in ("rank trace", "theorem", "ecole", "of_a", "one one", "_"):
        for mode in search.MODES:
            rows = lambda df: [(r["id"], round(r["score"], 9)) for r in df.select("id", "score").collect()]
            assert rows(index.lexical(query, 10, mode)) == rows(search.lexical(sources, query, mode=mode)), query
    index.verify()
    plan = index.term_postings(["trace"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert "In(term" in plan or "EqualTo(term,trace)" in plan


def test_index_drift_and_orphans(spark, made, tmp_path):
    index = Index(spark, f"file://{made}/index")
    relations = {n: getattr(index, n) for n in ("nodes", "edges")} | {"sources": index.sources.drop("doc")}
    meta = {k: v for k, v in index.meta.items() if k not in ("fingerprint", "index_version", "corpus")}
    target = f"file://{tmp_path}/index"
    assert build({k: v.repartition(3) for k, v in relations.items()}, target, meta=meta) == index.meta["fingerprint"]
    again = Index(spark, target)
    again.postings.where("term = 'trace'").withColumn("doc", F.lit(999).cast("long")).drop("bucket").write.mode("append").parquet(f"{target}/postings/bucket=0")
    with pytest.raises(PlinthError, match="orphan"):
        Index(spark, target).verify()
    build(relations, target, meta=meta)
    Index(spark, target).verify()
    Index(spark, target).nodes.limit(1).withColumn("kind", F.lit("z")).write.mode("append").parquet(f"{target}/nodes")
    with pytest.raises(PlinthError, match="fingerprint"):
        Index(spark, target).verify()


@pytest.mark.parametrize("change", [{"source_kind": "svn"}, {"source_commit": "x"}, {"source_revision": "x"}, {"source_authority": {"kind": "archive"}}, {"created_from_authoritative_source": "true"}, {"root_modules": "Z"}, {"producer_kind": None}, {"source_kind": "git"}])
def test_provenance_rules(spark, made, change):
    meta = Index(spark, f"file://{made}/index").meta
    check_provenance(meta)
    with pytest.raises(PlinthError):
        check_provenance({**meta, **change})


# ---------------------------------------------------------------- artifact rules


def copied(made: Path, tmp_path: Path) -> Path:
    import shutil

    out = tmp_path / "artifact"
    shutil.copytree(made / "artifact", out)
    return out


MANIFEST = {
    "schema": lambda m: m.update(schema="x.v1"), "boundary": lambda m: m["scope"].update(dependency_boundary="all"), "extra field": lambda m: m.update(more=1), "no receipt": lambda m: m["members"]["authority_receipt"].update(sha256=None),
    "hash": lambda m: m["members"]["nodes"].update(sha256="0" * 64), "absent sources": lambda m: m["members"]["sources"].update(sha256=None), "counts": lambda m: m["counts"].update(nodes=4), "bool count": lambda m: m["counts"].update(edges=True),
    "source": lambda m: m["source"].update(url="https://other/z.zip"), "producer": lambda m: m["producer"].update(tool_commit="d" * 40), "scope": lambda m: m["scope"].update(root_modules=["Y"]), "git flag": lambda m: m.update(created_from_authoritative_commit=True),
}


@pytest.mark.parametrize("rule", MANIFEST)
def test_manifest_rules(spark, made, tmp_path, rule):
    folder = copied(made, tmp_path)
    manifest = json.loads((folder / "manifest.json").read_text())
    MANIFEST[rule](manifest)
    (folder / "manifest.json").write_text(json.dumps(manifest))
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(PlinthError) as e:
        artifact.load_artifact(spark, f"file://{folder}")
    assert e.value.status == "BLOCKED"


ROWS = {
    "V6": ("nodes", lambda df: df.unionAll(df.limit(1))), "V7": ("nodes", lambda df: df.withColumn("name", F.concat("name", F.lit("x")))), "V8": ("sources", lambda df: df.withColumn("source_revision", F.lit("r9"))),
    "V10": ("sources", lambda df: df.withColumn("source_end_line", F.lit(0))), "V11": ("sources", lambda df: df.withColumn("text", F.concat("text", F.lit(" ")))), "V12": ("nodes", lambda df: df.withColumn("source_end_line", F.lit(None).cast("int"))),
    "V13 place": ("nodes", lambda df: df.withColumn("source_end_line", F.col("source_end_line") + 1)), "V14 kind": ("nodes", lambda df: df.withColumn("kind", F.lit("def"))), "V15": ("edges", lambda df: df.withColumn("evidence_grade", F.lit("LEXICAL_HIT"))),
    "V16": ("edges", lambda df: df.withColumn("target_id", F.lit("lean:Z.gone"))), "V14 edge": ("edges", lambda df: df.limit(1)), "A7": ("sources", lambda df: df.withColumnRenamed("source_revision", "source_commit")),
}


@pytest.mark.parametrize("rule", ROWS)
def test_row_rules(spark, made, tmp_path, rule):
    from plinth.operators.fingerprint import fingerprint

    folder = copied(made, tmp_path)
    name, change = ROWS[rule]
    rows = change(spark.read.parquet(f"file://{made}/artifact/{name}"))
    rows.write.mode("overwrite").parquet(f"file://{folder}/{name}")
    manifest = json.loads((folder / "manifest.json").read_text())
    canonical = rows.withColumnRenamed("source_commit", "source_revision").select(*artifact.SCHEMAS[name].names)
    manifest["members"][name]["sha256"] = fingerprint(canonical).first()["fingerprint"]
    if name in manifest["counts"]:
        manifest["counts"][name] = canonical.count()
    (folder / "manifest.json").write_text(json.dumps(manifest))
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(Exception) as e:
        artifact.load_artifact(spark, f"file://{folder}")
    assert isinstance(e.value, PlinthError) and e.value.status == "BLOCKED", rule


def test_receipt_and_raw_graph_rules(spark, made, tmp_path):
    for name in (artifact.RECEIPT, artifact.RAW):
        folder = copied(made, tmp_path / name)
        (folder / name).write_text((folder / name).read_text() + " ")
        (folder / f".{name}.crc").unlink(missing_ok=True)
        with pytest.raises(PlinthError, match="differs"):
            artifact.load_artifact(spark, f"file://{folder}")
        (folder / name).unlink()
        with pytest.raises(PlinthError):
            artifact.load_artifact(spark, f"file://{folder}")
    manifest = json.loads((made / "artifact/manifest.json").read_text())
    receipt = json.loads((made / "raw-receipt.json").read_text())
    assert artifact.check_receipt(canonical_line(receipt), manifest) == receipt["raw_depgraph"]["sha256"]
    for path, value in [("schema", "x"), ("source", {}), ("scope", {"root_modules": []}), ("producer", {}), ("observed", {"lean_toolchain": " "}), ("materialization", {"tree_sha256": "x"}), ("raw_depgraph", {"sha256": "x"}), ("more", 1)]:
        with pytest.raises(PlinthError):
            artifact.check_receipt(canonical_line({**receipt, path: value}), manifest)


def test_writing_refuses_what_loading_would(spark, made, tmp_path):
    loaded = artifact.load_artifact(spark, f"file://{made}/artifact")
    relations = {n: getattr(loaded, n) for n in ("nodes", "edges", "sources")}
    about = {k: loaded.manifest[k] for k in ("source", "producer", "scope")}
    with pytest.raises(PlinthError, match="just with a receipt"):
        artifact.write_artifact(relations, f"file://{tmp_path}/a", **about, authoritative=True)
    # without authority the places must be of chunks, and sources may be absent
    made_ = artifact.write_artifact({**relations, "sources": None}, f"file://{tmp_path}/b", **about)
    assert made_["members"]["sources"]["sha256"] is None and artifact.load_artifact(spark, f"file://{tmp_path}/b").sources is None
    with pytest.raises(PlinthError, match="immutable"):
        artifact.write_artifact({**relations, "sources": None}, f"file://{tmp_path}/b", **about)
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]
    lines = _lines(spark, loaded.nodes, "nodes", artifact.V2)
    assert [x["id"] for x in lines] == sorted(x["id"] for x in lines) and "source_revision" in lines[0] and list(lines[0]) == sorted(lines[0])


# ---------------------------------------------------------------- git


def test_git_artifact(spark, tmp_path, capsys):
    root = tmp_path / "repo"
    for name, text in {**FILES, "Z/Untracked.lean": "theorem u : x\n", "lean-toolchain": "lean4\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q"), git("add", "Z/A.lean", "Z/B.lean", "lean-toolchain"), git("commit", "-qm", "x"), git("remote", "add", "origin", "git@github.com:o/n.git")
    commit = git("rev-parse", "HEAD")
    checkout.verify(root, repo="https://github.com/o/n", commit=commit, subdir="")
    assert checkout.blob(root, commit, "Z/A.lean").decode() == FILES["Z/A.lean"] and checkout.toolchain(root) == "lean4"
    for change in ({"repo": "o/other"}, {"commit": COMMIT}, {"subdir": "Z"}, {"subdir": "../x"}):
        with pytest.raises(PlinthError):
            checkout.verify(root, **{"repo": "o/n", "commit": commit, "subdir": "", **change})
    runner = descriptors.load_runner(json.dumps(RUNNER))
    descriptor = json.dumps(git_source(source_commit=commit)).encode()
    raw, receipt = tmp_path / "raw.json", tmp_path / "receipt.json"
    (tmp_path / "graph.json").write_text(json.dumps(GRAPH))
    checkout.extract(["cp", str(tmp_path / "graph.json"), str(raw)], descriptor=descriptor, runner=runner, container=root, raw=raw, receipt=receipt)
    with pytest.raises(PlinthError, match="wrote no graph"):
        checkout.extract(["true"], descriptor=descriptor, runner=runner, container=root, raw=tmp_path / "no.json", receipt=tmp_path / "r2.json")
    with pytest.raises(PlinthError, match="has changes"):
        checkout.extract(["sh", "-c", f"cp {tmp_path}/graph.json {raw}; echo x >> Z/A.lean"], descriptor=descriptor, runner=runner, container=root, raw=raw, receipt=tmp_path / "r3.json")
    git("checkout", "-q", "Z/A.lean"), checkout.checkout(root, commit)
    (tmp_path / "source.json").write_bytes(descriptor)
    pins = [x for k in ("kind", "tool_repo", "tool_commit", "tool_hash") for x in (f"--producer-{k.replace('_', '-')}", PRODUCER[k])]
    argv = ["build-source-artifact", "--source", str(tmp_path / "source.json"), "--source-root", str(root), "--source-container", str(root), "--raw-depgraph", str(raw), "--raw-depgraph-receipt", str(receipt), *pins, "--out", str(tmp_path / "art")]
    code, told = run(spark, capsys, *argv)
    assert (code, told["nodes"], told["edges"], told["sources"]) == (0, 5, 3, 4), told
    loaded = artifact.load_artifact(spark, f"file://{tmp_path}/art")
    assert loaded.schema == artifact.V1 and "source_commit" in spark.read.parquet(f"file://{tmp_path}/art/nodes").columns
    assert {r["name"]: r["source_path"] for r in loaded.nodes.collect()} == {"one": "Z/A.lean", "two": "Z/A.lean", "Box": "Z/B.lean", "side": None, "three": "Z/B.lean"}
    # lexical only: no graph, so no traversal
    lexical = ["build-artifact", "--source-root", str(root), "--source-repo", "o/n", "--source-commit", commit, "--source-subdir", "", "--root-module", "Z", *pins, "--lexical-only", "--out", str(tmp_path / "lex")]
    assert run(spark, capsys, *lexical)[1]["sources"] == 5
    assert run(spark, capsys, "build-index", "--artifact", str(tmp_path / "lex"), "--index", str(tmp_path / "lexi"))[0] == 0
    code, told = run(spark, capsys, "deps", "--index", str(tmp_path / "lexi"), "--name", "one")
    assert (code, told["status"], told["code"]) == (2, "UNAVAILABLE", "UNAVAILABLE_EVIDENCE_GRADE")
    hit = run(spark, capsys, "search", "--index", str(tmp_path / "lexi"), "--query", "rank")[1]["hits"][0]
    assert hit["source_commit"] == commit and "source_kind" not in hit and "created_from_authoritative_commit" in hit
    scenario = {"schema": scenarios.SCENARIO, "scenario_id": "s", "version": 0, "research_refs": ["r"], "source_repo": "o/n", "evidence_classes": ["c"], "probes": [
        {"id": "a", "kind": "search", "query": "rank trace", "regression_guard": True, "min_hits": 1, "required_declaration_hints": ["one"]}, {"id": "b", "kind": "deps", "declaration": "three", "required_ids": ["lean:Z.A.two"], "regression_guard": True},
        {"id": "c", "kind": "rdeps", "declaration": "gone"}, {"id": "d", "kind": "declared_boundary", "basis": "x"}]}
    assert run(spark, capsys, "build-index", "--artifact", str(tmp_path / "art"), "--index", str(tmp_path / "idx"))[0] == 0
    index = Index(spark, f"file://{tmp_path}/idx")
    told = scenarios.run_scenario(index, loaded, scenarios.load_scenario(json.dumps(scenario).encode()), TOOL)
    assert told["overall_disposition"] == "FOUND_USEFUL_STRUCTURE" and told["observed_states"] == sorted(["CANDIDATE_SIGNAL", "FOUND_USEFUL_STRUCTURE", "UNKNOWN_WITHIN_CURRENT_CONTRACT", "CORPUS_BOUNDARY"])
    scenario["probes"][2]["regression_guard"] = True
    assert scenarios.run_scenario(index, loaded, scenarios.load_scenario(json.dumps(scenario).encode()), TOOL)["overall_disposition"] == "DEGRADED"
    for spoil in ({"probes": []}, {"version": True}, {"schema": "x"}, {"probes": [scenario["probes"][0]] * 2}, {"probes": [{"id": "a", "kind": "other"}]}):
        with pytest.raises(ValueError):
            scenarios.load_scenario(json.dumps({**scenario, **spoil}).encode())


# ---------------------------------------------------------------- releases and the cache

FLOW = {"repository_head": COMMIT, "workflow_sha": COMMIT, "run_id": "12", "run_attempt": "1", "workflow_ref": "o/n/.ci/accept.yml@main"}
PATHS = {"source_descriptor": "producer/sources/z.json", "runner_config": "producer/runner.json"}


@pytest.fixture(scope="module")
def released(spark, made):
    loaded = artifact.load_artifact(spark, f"file://{made}/artifact")
    index = Index(spark, f"file://{made}/index")
    receipt = (made / "raw-receipt.json").read_bytes()
    replay_ = scenarios.Replay(exact={"Z.A.two": "Z/A.lean"}, top={"rank trace": "one"}, deps={"three": (2, {"lean:Z.A.one"})}, rdeps={"one": (1, {"lean:Z.A.two"})}, context={"three": "three"}, corpus_class="PROOF_CORPUS")
    scenarios.expected_source(loaded, (made / "source.json").read_bytes(), descriptors.load_runner((made / "runner.json").read_bytes()))
    replay = canonical_line(scenarios.run_replay(index, loaded, replay_, receipt))
    config = {"source_descriptor": (PATHS["source_descriptor"], (made / "source.json").read_bytes()), "runner_config": (PATHS["runner_config"], (made / "runner.json").read_bytes())}
    consumer = canonical_line(releases.consumer_receipt(loaded, index.meta, index.meta["fingerprint"], replay, name="z", config=config, workflow=FLOW))
    args = {"replay": replay, "descriptor": config["source_descriptor"][1], "runner": config["runner_config"][1], "consumer": consumer, "paths": PATHS, "workflow_file": ".ci/accept.yml"}
    package, told = releases.build_release(spark, f"file://{made}/artifact", **args)
    return args, package, told, loaded


def test_releases(spark, made, released, tmp_path):
    args, package, told, loaded = released
    assert releases.build_release(spark, f"file://{made}/artifact", **args)[0] == package
    extract = lambda dest, package=package, receipt=told, **more: releases.verify_and_extract(spark, package, canonical_line(receipt), more.get("descriptor", args["descriptor"]), more.get("runner", args["runner"]), dest)
    found = extract(tmp_path / "out")
    assert found["artifact_identity"] == loaded.identity and found["evidence"]["proof_eligibility"] == evidence.UNKNOWN_PROOF
    assert artifact.load_artifact(spark, f"file://{tmp_path}/out/artifact").identity == loaded.identity
    with pytest.raises(releases.ReleaseInvalid, match="not empty"):
        extract(tmp_path / "out")
    with pytest.raises(releases.RebuildRequired):
        extract(tmp_path / "a", descriptor=args["descriptor"] + b" ")
    bad = json.loads(json.dumps(told))
    bad["fingerprint"]["sha256"] = HASH
    with pytest.raises(releases.ReleaseInvalid, match="fingerprint"):
        extract(tmp_path / "b", receipt=bad)
    with pytest.raises(releases.ReleaseInvalid, match="not the receipt's"):
        extract(tmp_path / "c", package=package + b"x")
    assert not (tmp_path / "b").exists() and not (tmp_path / "c").exists()
    for spoil in ({"replay": canonical_line({**json.loads(args["replay"]), "status": "FAIL"})}, {"replay": canonical_line({**json.loads(args["replay"]), "proof_evidence": evidence.CANDIDATE_PROOF})}, {"consumer": args["consumer"].replace(b'"PASS"', b'"FAIL"')}, {"workflow_file": "other.yml"}, {"descriptor": args["descriptor"].replace(b'"src"', b'"other"')}, {"accepted_blob": lambda c, p: b""}):
        with pytest.raises((ValueError, TypeError)):
            releases.build_release(spark, f"file://{made}/artifact", **{**args, **spoil})
    with pytest.raises(ValueError):
        releases.check_outputs([], tmp_path, tmp_path / "a", tmp_path / "a")
    with pytest.raises(ValueError, match="in the artifact"):
        releases.check_outputs([], tmp_path, tmp_path / "x/a", Path("/tmp/r"))


def test_packages_with_other_members(released):
    _, package, told, _ = released
    expected = releases.listed_members(releases.parsed(canonical_line(told), "r", ValueError))
    assert set(releases.read_package(package, expected)) == set(expected)
    for change in (lambda e: e.pop("replay.json"), lambda e: e.update(more=(HASH, 1)), lambda e: e.update({"replay.json": (HASH, 1)})):
        other = dict(expected)
        change(other)
        with pytest.raises(ValueError):
            releases.read_package(package, other)
    with pytest.raises(ValueError):
        releases.read_package(b"no archive", expected)


def test_local_cache(spark, made, released, tmp_path, capsys):
    args, package, told, loaded = released
    repository, shelf, root = tmp_path / "repository", tmp_path / "shelf", tmp_path / "cache"
    corpus = {"source_id": "z", "release_tag": "t1", "package_asset": "z.tar.gz", "receipt_asset": "z.json", "source_descriptor": PATHS["source_descriptor"], "artifact_identity": loaded.identity, "fingerprint_sha256": told["fingerprint"]["sha256"]}
    lost = {**corpus, "source_id": "y", "release_tag": "t2", "artifact_identity": "d" * 64}
    catalog_text = json.dumps({"schema": descriptors.CATALOG_V1, "release_repository": "o/n", "corpora": [corpus, lost]})
    for path, data in ((repository / PATHS["source_descriptor"], args["descriptor"]), (repository / PATHS["runner_config"], args["runner"]), (repository / "producer/catalog.json", catalog_text.encode()), (shelf / "t1/z.tar.gz", package), (shelf / "t1/z.json", canonical_line(told))):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    argv = ["multicorpus-search", "--catalog", str(repository / "producer/catalog.json"), "--cache-dir", str(root), "--releases", str(shelf), "--query", "two"]
    code, out = run(spark, capsys, *argv)
    assert code == 0 and out["status"] == "DEGRADED" and out["searched_corpora"] == 1 and [u["code"] for u in out["unavailable"]] == ["LOCAL_CACHE_UNAVAILABLE"]
    assert out["hits"][0]["candidate_id"] == "z::lean:Z.A.two" and out["hits"][0]["local_rank"] == 1
    catalog = descriptors.load_catalog(catalog_text)
    cache = localcache.Cache(spark, catalog, repository, root, lambda *a: pytest.fail("the cache is whole"))
    final = localcache.cache_path(root, catalog, corpus)
    assert cache.ensure(corpus).folder == final
    # a spoiled cache is rebuilt in place, and one that can't be comes back as it was
    (final / "verified.json").write_text("{}")
    cache.provider = localcache.folder_provider(tmp_path / "empty")
    states, gone = cache.ensure_all()
    assert states == [] and {c for _, c, _ in gone} == {"LOCAL_CACHE_UNAVAILABLE"} and (final / "verified.json").read_text() == "{}"
    cache.provider = localcache.folder_provider(shelf)
    assert cache.ensure(corpus).artifact_identity == loaded.identity
    cache.ensure(corpus).index.verify()
    # another descriptor needs another release
    (repository / PATHS["source_descriptor"]).write_bytes(args["descriptor"] + b"\n")
    assert [c for _, c, _ in cache.ensure_all()[1]] == ["REBUILD_REQUIRED", "LOCAL_CACHE_UNAVAILABLE"]
    assert sorted(p.name for p in final.parent.iterdir() if "staging" in p.name or "invalid" in p.name) == []


def test_federation_of_states(spark, made):
    index = Index(spark, f"file://{made}/index")

    def broken(*_):
        raise PlinthError("BLOCKED_PROJECTION_INTEGRITY", "spoiled")

    def unreadable(*_):
        return spark.read.parquet(f"file://{made}/nowhere")

    find = lambda q, n, m: index.search(q, n, m)
    hits, missing, searched = federation.search_states(spark, {"a": find, "b": broken, "c": unreadable, "d": find}, [("e", "X", "gone")], "theorem", limit=3)
    rows = hits.collect()
    assert searched == 2 and {r["code"] for r in missing.collect()} == {"X", "BLOCKED_PROJECTION_INTEGRITY", "UNAVAILABLE_PROJECTION"}
    assert [(r["local_rank"], r["source_id"]) for r in rows] == [(1, "a"), (1, "d"), (2, "a")]
    none, missing, searched = federation.search_states(spark, {"b": broken}, [], "x")
    assert none.count() == 0 and searched == 0
    with pytest.raises(ValueError):
        federation.search_states(spark, {"a": find}, [], "x", mode="fast")


# ---------------------------------------------------------------- documents


@pytest.mark.parametrize("change", [{"archive_url": "http://h/z"}, {"archive_url": "https://u:p@h/z"}, {"archive_url": "https://h/z#f"}, {"archive_format": "tar"}, {"archive_sha256": "x"}, {"source_subdir": "../x"}, {"source_subdir": "/x"}, {"root_modules": []}, {"root_modules": ["a", "a"]}, {"root_modules": ["a,b"]}, {"build_target": "a b"}, {"source_id": "Z"}, {"more": 1}, {"schema": "x"}, {"exclude_source_prefixes": ["b", "a"]}, {"exclude_source_prefixes": ["a", "a/"]}, {"exclude_source_prefixes": ["."]}, {"exclude_source_prefixes": ["../a"]}])
def test_archive_descriptors(change):
    good = archive_source(b"", exclude_source_prefixes=["a", "b/c/"])
    assert descriptors.load_source(json.dumps(good)).exclude_source_prefixes == ["a/", "b/c/"]
    with pytest.raises(PlinthError):
        descriptors.load_source(json.dumps({**good, **change}))


def test_git_descriptors_and_runner():
    source = descriptors.load_git_source(json.dumps(git_source()))
    assert source.authority == {"repo": "o/n", "commit": COMMIT, "subdir": ""}
    assert descriptors.load_source(json.dumps(git_source(schema=descriptors.GIT_V2, exclude_source_prefixes=["x"]))).exclude_source_prefixes == ["x/"]
    for change in ({"source_repo": "o/n/m"}, {"source_commit": "A" * 40}, {"exclude_source_prefixes": []}, {"root_modules": ["a\nb"]}):
        with pytest.raises(PlinthError):
            descriptors.load_source(json.dumps({**git_source(), **change}))
    with pytest.raises(PlinthError):
        descriptors.load_archive_source(json.dumps(git_source()))
    runner = descriptors.load_runner(json.dumps(RUNNER))
    assert runner.producer == PRODUCER and descriptors.environment(source, runner)["ROOT_MODULES"] == "Z"
    for change in ({"extractor_commit": "x"}, {"elan_sha256": "x"}, {"schema": "x"}, {"more": "x"}, {"elan_version": "a\nb"}):
        with pytest.raises(PlinthError):
            descriptors.load_runner(json.dumps({**RUNNER, **change}))


def test_catalogs(spark):
    row = {"source_id": "z", "release_tag": "t", "package_asset": "p", "receipt_asset": "r", "source_descriptor": "producer/sources/z.json", "artifact_identity": HASH, "fingerprint_sha256": HASH}
    other = {**row, "source_id": "y", "release_tag": "u", "artifact_identity": "d" * 64}
    whole = {"schema": descriptors.CATALOG_V1, "release_repository": "o/n", "corpora": [row, other]}
    catalog = descriptors.load_catalog(json.dumps(whole))
    assert catalog.digest == descriptors.load_catalog(json.dumps({**whole, "corpora": [other, dict(reversed(row.items()))]})).digest and catalog.table(spark).count() == 2
    for change in ({"corpora": []}, {"schema": "x"}, {"release_repository": "o"}, {"more": 1}):
        with pytest.raises(PlinthError):
            descriptors.load_catalog(json.dumps({**whole, **change}))
    for change in ({"source_id": "y"}, {"release_tag": "u"}, {"artifact_identity": "d" * 64}, {"source_descriptor": "producer/sources/../z.json"}, {"source_descriptor": "producer/z.json"}, {"source_descriptor": "producer/sources/z.txt"}, {"fingerprint_sha256": "x"}, {"package_asset": ""}, {"package_asset": "a\nb"}, {"asset": "p"}, {"package_asset": 1}):
        with pytest.raises(PlinthError) as e:
            descriptors.load_catalog(json.dumps({**whole, "corpora": [{**row, **change}, other]}))
        assert e.value.code == "BLOCKED_ACCEPTED_CATALOG"
    with pytest.raises(ValueError):
        strict_json('{"a": 1, "a": 2}')


# ---------------------------------------------------------------- archives and readers


def test_materialised_archives(made, tmp_path):
    data = (made / "z.zip").read_bytes()
    source = descriptors.load_archive_source(json.dumps(archive_source(data)))
    dest, receipt = tmp_path / "tree", tmp_path / "r.json"
    materialize.materialize(source, dest, receipt, Opener(data))
    listing = materialize.verify(source, dest, receipt)
    assert {m["path"]: m["source_path"] for m in listing["members"]} == {"README": None, "src/Z/A.lean": "Z/A.lean", "src/Z/B.lean": "Z/B.lean"}
    assert set(materialize.stable_evidence(source, dest, receipt)) == {"tree_sha256", "member_manifest_sha256"}
    for d, r in ((dest, tmp_path / "r2.json"), (tmp_path / "t2", receipt), (tmp_path / "t3", tmp_path / "t3/r.json")):
        with pytest.raises(PlinthError):
            materialize.materialize(source, d, r, Opener(data))
    with pytest.raises(PlinthError, match="hash"):
        materialize.materialize(source, tmp_path / "t4", tmp_path / "r4.json", Opener(data + b"x"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r.json", "r.members.json", "tree"]
    (dest / "src/Z/A.lean").write_text("changed")
    with pytest.raises(PlinthError, match="differs"):
        materialize.verify(source, dest, receipt)
    (dest / "src/Z/A.lean").unlink()
    with pytest.raises(PlinthError, match="missing"):
        materialize.verify(source, dest, receipt)


@pytest.mark.parametrize("names", [["../x"], ["/x"], ["a\\b"], ["a", "a"], ["a", "a/b"], ["a//b"]])
def test_unsafe_archives(names, tmp_path):
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        for n in names:
            z.writestr(zipfile.ZipInfo(n), "x")
    with pytest.raises(archives.UnsafeMember):
        list(archives.members(str(tmp_path / "u.zip")))


def test_archives_by_address_and_size(spark, tmp_path):
    archives.register(spark)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/", ""), z.writestr("x/y", "12345")
    assert spark.read.format("archive_members").load(f"file://{tmp_path}/*.zip").first()["bytes"] == 5
    with pytest.raises(archives.UnsafeMember, match="longer"):
        list(archives.members(f"file://{tmp_path}/a.zip", 4))
    names = archives.Names()
    for k in range(20_000):
        names.check(f"folder{k % 100}/name{k}")


def test_listed_files_alone_are_read(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/A.lean").write_text("theorem a")
    (tmp_path / "t/B.lean").write_bytes(b"\xff")
    (tmp_path / "t/C.lean").write_text("theorem c")
    (tmp_path / "t/C.lean").chmod(0)
    digest = hashlib.sha256(b"theorem a").hexdigest()
    listed = lambda *rows: spark.createDataFrame(rows, "source_path string, sha256 string")
    rows = readers.read_listed(spark, str(tmp_path / "t"), listed(("A.lean", digest), (None, digest), ("x/README", "none")))
    assert [r["text"] for r in rows.collect()] == ["theorem a"]
    for bad in ((("B.lean", hashlib.sha256(b"\xff").hexdigest()),), (("A.lean", HASH),), (("A.lean", digest), ("A.lean", digest)), (("./A.lean", digest),)):
        with pytest.raises(Exception):
            readers.read_listed(spark, str(tmp_path / "t"), listed(*bad)).collect()
    assert [r["source_path"] for r in readers.read_tree(spark, str(tmp_path / "t"), listed=listed(("A.lean", None), ("Z.lean", None))).collect()] == ["A.lean"]
    with pytest.raises(Exception, match="TOO_LARGE"):
        readers.read_tree(spark, str(tmp_path / "t"), listed=listed(("A.lean", None)), most_bytes=3).collect()
    with pytest.raises(ValueError, match="TOO_LARGE"):
        readers.read_bounded(spark, f"file://{tmp_path}/t/A.lean", 3)
    for text in ("[]", '{"nodes": []}', '{"nodes": [], "edges": {}}'):
        (tmp_path / "g.json").write_text(text)
        with pytest.raises(Exception):
            [x.collect() for x in readers.read_raw_graph(spark, f"file://{tmp_path}/g.json")]
    told = readers.strict_json_rows(spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ('{"a":NaN}',)], "x string"), "x")
    assert [r[0] for r in told.select(F.col("parsed").isNotNull()).collect()] == [True, False, False]


# ---------------------------------------------------------------- evidence


OUTPUTS, ASKED = "output_id int, content binary, exit_code int, expected_sha256 string", "output_id int, declaration string"


def test_axiom_reports_of_primed_names(spark):
    lines = ["'T.next'' depends on axioms: [propext, sorryAx]", "'T.next' does not depend on any axioms", "a.lean:1:2: warning: declaration uses `sorry`"]
    out = ("\n".join(lines) + "\n").encode()
    told = evidence.axiom_reports(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame([("T.next'",), ("T.next",), ("gone",)], "declaration string"))
    assert {r["declaration"]: r["n_lines"] for r in told.collect()} == {"T.next'": 1, "T.next": 1, "gone": 0}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    both = ["T.next'", "T.next"]
    # output, exit code, digest, what is expected, rules that are broken
    cases = [
        (out, 0, sha(out), both, []), (out + out, 0, sha(out + out), both, ["not one well-formed report"] * 2), (out, 0, sha(out), ["T.next"], ["line is no expected report"]), (out, 0, sha(out), [*both, "gone"], ["not one well-formed report"]),
        (out, 1, HASH, both, [evidence.EXECUTION, evidence.MISMATCH]), (out, 0, None, both, [evidence.MISMATCH, evidence.UNPINNED]), (out, 0, sha(out), [], ["line is no expected report"] * 2 + ["nothing is expected"]), (out, 0, sha(out), [*both, "T.next"], ["expected names are malformed"]),
    ]
    texts = {b"'a' depends on axioms: []\n": "not one well-formed report", b"'a' depends on axioms: [x, x]\n": "not one well-formed report", b"'a' does not depend on any axioms": "output is no text of whole lines"}
    cases += [(b, 0, sha(b), ["a"], [rule]) for b, rule in texts.items()]
    cases += [(b, 0, sha(b), ["a"], ["line is no expected report", "not one well-formed report"]) for b in (b"hello\n", b"'b' does not depend on any axioms\n")]
    cases += [(b"\xff\n", 0, sha(b"\xff\n"), ["a"], ["not one well-formed report", "output is no text of whole lines"]), (b"", 0, sha(b""), ["a"], ["line is no expected report", "not one well-formed report", "output is empty or too long", "output is no text of whole lines"])]
    late = ("\n".join(lines[1:]) + "\n").encode()
    cases.append((late, 0, sha(late), ["T.next"], ["warning without a report"]))
    outputs = spark.createDataFrame([(k, bytearray(c[0]), c[1], c[2]) for k, c in enumerate(cases)], OUTPUTS)
    asked = spark.createDataFrame([(k, n) for k, c in enumerate(cases) for n in c[3]], ASKED)
    found = {k: [] for k in range(len(cases))}
    for r in evidence.report_violations(outputs, asked).collect():
        found[r["output_id"]].append(r["rule"])
    for k, c in enumerate(cases):
        assert sorted(found[k]) == sorted(c[4]), (k, c[0])
    with pytest.raises(PlinthError, match="LEAN_EXECUTION_FAILED"):
        evidence.exact_reports(outputs, asked)
    reports = evidence.exact_reports(outputs.where("output_id = 0"), asked.where("output_id = 0"))
    assert {r["declaration"]: list(r["axioms"]) for r in reports.collect()} == {"T.next'": ["propext", "sorryAx"], "T.next": []}
    want = [(0, "T.next'", evidence.NOT_PROOF), (0, "T.next", evidence.CANDIDATE_PROOF)]
    differs = lambda rows: evidence.verdict_differences(reports, spark.createDataFrame(rows, ASKED + ", verdict string")).count()
    assert differs(want) == 0 and differs(want[:1]) == 1 and differs([want[0], (0, "T.next", evidence.NOT_PROOF)]) == 2


def test_bound_evidence(spark):
    transcript = b"'Z.A.one' depends on axioms: [propext]\n"
    body = {"schema": evidence.SIDECAR, "artifact": {"identity": "i1", "source_revision": "r1"}, "corpus_class": "PROOF_CORPUS", "declaration": "Z.A.one", "lean_audit": {"toolchain": "l", "command": "#print axioms Z.A.one", "transcript_sha256": hashlib.sha256(transcript).hexdigest(), "observed_axioms": ["propext"], "allowed_axioms": ["propext"]}}

    def told(change=None, audit=None, transcript=transcript, pin=None):
        data = json.dumps({**body, **(change or {}), "lean_audit": {**body["lean_audit"], **(audit or {})}}).encode()
        return bytearray(data), transcript and bytearray(transcript), pin or hashlib.sha256(data).hexdigest()

    twice = b'{"schema": 1, ' + json.dumps(body).encode()[1:]
    two = {"declaration": "Z.A.two"}
    cases = [
        (told(), evidence.CANDIDATE_PROOF, []), (told(audit={"allowed_axioms": []}), evidence.NOT_PROOF, []), (told({"corpus_class": "STATEMENT_CORPUS"}), evidence.NOT_PROOF, []), ((None, None, None), evidence.UNKNOWN_PROOF, []),
        (told({"artifact": {"identity": HASH, "source_revision": "r1"}}), None, ["evidence is of another artifact"]), (told({"schema": "x"}), None, ["sidecar is malformed"]), (told({"corpus_class": "x"}), None, ["sidecar is malformed"]), (told({"more": 1}), None, ["sidecar is malformed"]),
        (told(audit={"command": "x"}), None, ["audit is of another command"]), (told(audit={"observed_axioms": []}), None, ["transcript is no report of these axioms"]), (told(audit={"transcript_sha256": HASH}), None, ["transcript differs from its digest"]),
        (told(two), None, ["artifact lacks the declaration", "audit is of another command", "transcript is no report of these axioms"]), ((bytearray(twice), bytearray(transcript), hashlib.sha256(twice).hexdigest()), None, ["sidecar is malformed"]),
        ((None, bytearray(transcript), None), None, [evidence.INCOMPLETE]), ((None, None, HASH), None, [evidence.INCOMPLETE]), (told(pin=HASH), None, [evidence.SIDECAR_MISMATCH]), ((*told()[:2], None), None, [evidence.SIDECAR_MISMATCH, evidence.UNPINNED_SIDECAR]),
        (told({"declaration": "Z.A.one" + " " * 70_000}), None, [evidence.TOO_LARGE, "artifact lacks the declaration", "audit is of another command", "transcript is no report of these axioms"]),
    ]
    rows = spark.createDataFrame([(k, *c[0], "i1", "r1") for k, c in enumerate(cases)], "evidence_id int, sidecar binary, transcript binary, expected_sha256 string, identity string, revision string")
    nodes = spark.createDataFrame([("i1", "Z.A.one"), ("i1", "Z.A.one"), ("i2", "Z.A.two")], "identity string, full_name string")
    got = {r["evidence_id"]: (r["eligibility"], list(r["broken"])) for r in evidence.bound_evidence(rows, nodes).collect()}
    for k, (_, verdict, broken) in enumerate(cases):
        assert got[k] == (verdict, sorted(broken)), (k, got[k])


def test_replay_claims():
    assert evidence.replay_evidence({})["proof_eligibility"] == evidence.UNKNOWN_PROOF
    assert evidence.replay_evidence({"corpus_class": "STATEMENT_CORPUS", "proof_evidence": evidence.NOT_PROOF})["proof_eligibility"] == evidence.NOT_PROOF
    for bad in ({"corpus_class": None}, {"proof_evidence": evidence.NOT_PROOF}, {"corpus_class": "x"}, {"corpus_class": "PROOF_CORPUS", "proof_evidence": evidence.CANDIDATE_PROOF}):
        with pytest.raises(ValueError):
            evidence.replay_evidence(bad)


def test_listing_bounds(spark):
    docs = spark.createDataFrame([("b", "x needle"), ("a", "needle"), ("c", "none")], "candidate_id string, body_text string")
    assert envelope_hits(docs, "needle").first()["hits"] == ["a", "b"] and envelope_hits(docs, "zz").first()["hits"] == []
    for term, n in ((" ", 1), ("x" * 65, 1), ("a b c d e", 1), ("a", 11), ("a", 0)):
        with pytest.raises(InputError):
            envelope_hits(docs, term, n)
