"""Operators of the graph and search engine on small fixtures."""

import hashlib
import io
import random
import tarfile
import zipfile

import pytest

from plinth.errors import PlinthError
from plinth.functions import text as tx
from plinth.operators import binding, chunking, fingerprint, graph, integrity, normalize, resolve, search
from plinth.operators.generations import InputError, StateError, Store, check_input
from plinth.plans import queries
from plinth.sources import archives, readers, releases

EDGES = [("A", "B"), ("A", "D"), ("B", "C"), ("D", "C"), ("C", "A")]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(f"lean:G.{a}", f"lean:G.{b}", "value_dependency", "ELABORATED_VALUE_DEPENDENCY", "p") for a, b in EDGES]
    return spark.createDataFrame(rows, "source_id string, target_id string, relation string, evidence_grade string, producer string")


def pairs(df):
    return [(r["source_id"][-1] + r["target_id"][-1], r["depth"]) for r in graph.ordered(df).collect()]


def test_dependencies_in_a_cycle(edges):
    assert [len(pairs(graph.dependencies(edges, "lean:G.A", k))) for k in (0, 1, 2, 3)] == [0, 2, 4, 5]
    assert max(d for _, d in pairs(graph.dependencies(edges, "lean:G.A", 3))) == 3
    assert [p for p, _ in pairs(graph.dependencies(edges, "lean:G.C", 2, reverse=True))] == ["BC", "DC", "AB", "AD"]


def test_paths(edges):
    at = lambda a, b, n=5: graph.shortest_path(edges, f"lean:G.{a}", f"lean:G.{b}", n).first()
    assert [e["target_id"][-1] for e in at("A", "C")["path"]] == ["B", "C"]
    assert not at("B", "D", 1)["found"]
    assert at("A", "A")["found"] and at("A", "A")["hops"] == 0
    with pytest.raises(PlinthError):
        graph.check_depth(6)


def raw(spark, nodes, edges):
    return spark.createDataFrame(nodes, "name string, module string, kind string, fullName string"), spark.createDataFrame(edges, "source string, target string, kind string")


def test_normalize(spark):
    nodes = [("a", "Z.T", "thm", "Z.T.a"), ("b", "Z.T", "thm", "Z.T.b"), ("external", "M.T", "thm", "M.T.external"), ("c", "Zoo", "thm", "Zoo.c")]
    n, e = normalize.normalize(*raw(spark, nodes, [("Z.T.a", "b", "value"), ("Z.T.a", "Z.T.b", "value"), ("M.T.external", "Z.T.b", "type")]), ["Z"], producer="p", revision="r")
    assert sorted(r["id"] for r in n.collect()) == ["lean:Z.T.a", "lean:Z.T.b"]
    assert [(r["source_id"], r["target_id"]) for r in e.collect()] == [("lean:Z.T.b", "lean:Z.T.a")]
    for bad in ([("zz", "b", "value")], [("a", "b", "other")], [("a", "", "value")]):
        with pytest.raises(PlinthError):
            normalize.normalize(*raw(spark, nodes, bad), ["Z"], producer="p", revision="r")


def test_ambiguous_names(spark):
    nodes = spark.createDataFrame([("lean:A.x", "x"), ("lean:B.x", "x"), ("lean:A.y", "y"), ("lean:B.q.y", "z")], "id string, name string")
    assert resolve.one(nodes, "A.x") == "lean:A.x" and resolve.one(nodes, "lean:B.x") == "lean:B.x"
    with pytest.raises(PlinthError, match="ambiguous"):
        resolve.one(nodes, "x")
    assert resolve.one(nodes, "q.Y") == "lean:B.q.y"
    assert resolve.one(nodes, "nothing", soft=True) is None
    assert resolve.one(nodes, "z", search=True, soft=True) == "lean:B.q.y"
    # an underscore stands for any character in the search's rules alone
    assert resolve.one(nodes, "q_Y", search=True) == "lean:B.q.y" and resolve.one(nodes, "q_y", soft=True) is None
    with pytest.raises(PlinthError, match="not found"):
        resolve.one(nodes, "lean:zz")


def sources(spark, rows):
    return spark.createDataFrame([(f"s{k}", "F.lean", 2 * k + 1, 2 * k + 2, h, t) for k, (h, t) in enumerate(rows)], "id string, source_path string, source_start_line int, source_end_line int, declaration_hint string, text string")


def test_search_modes(spark):
    s = sources(spark, [("lemmaR_tight_two", "rank trace tightness and ξ symmetry"), ("other", "rank"), ("truth", "école"), ("predicate", "x y")])
    assert search.lexical(s, "rank trace tightness").first()["declaration_hint"] == "lemmaR_tight_two"
    assert search.lexical(s, "ξ").count() == 1 and search.lexical(s, "ecole").count() == 1
    assert search.lexical(s.withColumn("text", search.F.translate("text", "é", "e\u0301")), "école").count() <= 1
    assert search.lexical(sources(spark, [("x", "e\u0301cole"), ("y", "e cole")]), "ecole").first()["declaration_hint"] == "x"
    assert search.lexical(s, "lemmaR_tight_two").count() == 1 and search.lexical(s, "tight_lemmaR").count() == 0
    assert search.lexical(s, "truth predicate").count() == 2 and search.lexical(s, "truth predicate", mode="evidence").count() == 0
    assert search.lexical(s, "_ rank", mode="evidence").count() == 0 and search.lexical(s, "rank", limit=0).count() == 0
    with pytest.raises(ValueError):
        search.lexical(s, "x", mode="fast")


def test_unknown_term_scores_and_empty_tables(spark):
    s = sources(spark, [("a", "one two"), ("b", None)]).where("id = 'none'")
    assert search.lexical(s, "one").count() == 0
    assert search.search_status(search.lexical(s, "one")).first()["status"] == "UNKNOWN"


LEAN = '/- module /- nested -/ theorem no : x -/\nimport A\n\n/-- doc -/\nprivate theorem one : "-- /- not a comment" := x\n-- theorem no2\nlemma N.two\' : y\n  body\n'


def test_chunks():
    found = chunking.chunks("F.lean", LEAN, "r")
    assert [(c[3], c[4], c[5]) for c in found] == [(3, 5, "one"), (6, 8, "N.two'")]
    assert found[0][7] == hashlib.sha256(found[0][6].encode()).hexdigest()
    assert chunking.chunks("F.lean", "import A\n", "r") == []
    assert chunking.chunks("F.lean", "/- a\ntheorem x -/\n", "r") == []


def test_comments_that_code_follows():
    at = lambda text: [(c[3], c[4], c[5]) for c in chunking.chunks("F.lean", text, "r")]
    assert at("def a\n/- doc\n-/ @[simp]\ntheorem x\n") == [(1, 1, "a"), (2, 4, "x")]
    assert at("def a\n/- one -/ @[simp]\n\ntheorem x\n") == [(1, 1, "a"), (2, 4, "x")]
    assert at("def a\n@[simp] /- one -/\ntheorem x\n") == [(1, 2, "a"), (3, 3, "x")]
    assert at('def a := "\\\\"\n-- \\" c\ntheorem x\n') == [(1, 1, "a"), (2, 3, "x")]
    assert at("/- a \\-/\ntheorem x\n") == [(1, 2, "x")] and at("/- /-/ -/\ntheorem x -/\n") == []
    assert at("\\-- theorem no\ndef y\r\ndef z") == [(2, 2, "y"), (3, 3, "z")]


def test_bind_and_integrity(spark):
    n = spark.createDataFrame([("lean:M.F.a", "M.F.a", "a", "thm", "M.F", None, None, None, "r"), ("lean:M.F.b", "M.F.b", "b", "thm", "M.F", None, None, None, "r")], "id string, full_name string, name string, kind string, module string, source_path string, source_start_line int, source_end_line int, source_revision string")
    body = "theorem a\n"
    s = spark.createDataFrame([("src:M/F.lean:1:2", "r", "M/F.lean", 1, 2, "a", body, hashlib.sha256(body.encode()).hexdigest())], "id string, source_revision string, source_path string, source_start_line int, source_end_line int, declaration_hint string, text string, content_sha256 string")
    bound = binding.bind_unique(n, s)
    assert {r["name"]: r["source_start_line"] for r in bound.collect()} == {"a": 1, "b": None}
    e = spark.createDataFrame([("lean:M.F.a", "lean:M.F.b", "type_dependency", "ELABORATED_TYPE_DEPENDENCY", "p")], "source_id string, target_id string, relation string, evidence_grade string, producer string")
    check = lambda x, y, z: sorted({r["rule"] for r in integrity.artifact_violations(x, y, z, roots=["M"], revision="r", producer="p").collect()})
    assert check(bound, e, s) == []
    assert check(bound, e.union(e), s.withColumn("text", s.id)) == ["V11", "V6"]
    assert check(bound.where("name = 'a'"), e, s) == ["V16"]
    # an artifact round trip
    assert fingerprint.fingerprint(bound).first() == fingerprint.fingerprint(bound.repartition(3)).first()


def test_node_to_chunk(spark):
    r = random.Random(3)
    some = lambda *x: r.choice(x)
    chunks = []
    for k in range(160):
        a = r.randint(-5, 90)
        chunks.append((f"s{k:03}", some("F.lean", "F.lean", "G.lean", "H.lean"), some(a, a, a, None), a + some(0, 0, 1, 2, 7, 40, -3), some("a", "b", f"n{k}", None)))
    chunks += [("t0", "One.lean", 4, 6, "z"), ("t1", "M/N.lean", 1, 2, "a"), chunks[0][:1] + chunks[0][1:]]
    nodes = [(f"d{k}", some("a", "b", f"n{r.randint(0, 159)}", None), "M.N", some("F.lean", "G.lean", "H.lean", "One.lean", "No.lean", None), some(None, *range(-6, 95))) for k in range(400)]
    nodes += [nodes[0], ("many", "a", "M.N", "F.lean", 2**31 - 1)]
    n = spark.createDataFrame(nodes, "id string, name string, module string, source_path string, source_start_line int")
    s = spark.createDataFrame(chunks, "id string, source_path string, source_start_line int, source_end_line int, declaration_hint string")
    want = {}
    for key in {x[0] for x in nodes}:
        met = [(c, x[3] is not None, x[1], x[4]) for x in nodes if x[0] == key for c in chunks if c[1] == (x[3] or "M/N.lean")]
        inside = [c[0] for c, placed, _, at in met if placed and None not in (at, c[2], c[3]) and c[2] <= at <= c[3]]
        tiers = {"inside": inside, "only": [c[0] for c, placed, _, _ in met if placed], "named": [c[0] for c, _, name, _ in met if name is not None and c[4] == name]}
        if met:
            want[key] = next(((ids[0], t) for t, ids in tiers.items() if len(ids) == 1), (None, None))
    out = binding.node_to_chunk(n, s)
    assert {x["id"]: (x["chunk_id"], x["tier"]) for x in out.collect()} == want and out.columns == ["id", "chunk_id", "tier"]
    assert {t for _, t in want.values()} == {"inside", "only", "named", None}


def test_node_to_chunk_meets_few_chunks(spark):
    # a file of many nodes and chunks; a join of all of them would not end in time
    n = spark.range(100_000).selectExpr("concat('d', id) as id", "'x' as name", "'M' as module", "'M.lean' as source_path", "cast(3 * id + 1 as int) as source_start_line")
    s = spark.range(100_000).selectExpr("concat('s', id) as id", "'M.lean' as source_path", "cast(3 * id as int) as source_start_line", "cast(3 * id + 2 as int) as source_end_line", "'x' as declaration_hint")
    out = binding.node_to_chunk(n, s)
    assert out.where("tier = 'inside' and substr(chunk_id, 2) = substr(id, 2)").count() == 100_000


def test_node_to_chunk_is_registered_over_all_nodes():
    import inspect

    # no part of its tables, and SQL over all of them
    assert "where" not in inspect.getsource(queries.QUERIES["node_to_chunk"]) and "LIKE" not in queries.ORACLE_SQL["node_to_chunk"].split("FROM n JOIN f")[1]


def test_generations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/plane")
    docs = lambda g: spark.createDataFrame([(g, "z", "z::d", None, "s1", "F", 1, "D", "a needle lemma")], "generation_id string, source_id string, candidate_id string, declaration_id string, source_row_id string, source_path string, source_line int, exact_identity string, body_text string")
    corpora = lambda g: spark.createDataFrame([(g, "z", "SEARCHABLE", None), (g, "y", "UNAVAILABLE", "gone")], "generation_id string, source_id string, availability string, unavailable_reason string")
    with pytest.raises(StateError):
        store.reference("g0", "x")
    for g in ("g1", "g2"):
        store.begin(g, g, "cat")
        store.write(g, "search_docs", docs(g))
        store.write(g, "corpora", corpora(g))
    with pytest.raises(StateError):
        store.mark_ready("g1", "cat", 3)
    store.mark_ready("g1", "cat", 2)
    with pytest.raises(StateError):
        store.write("g1", "search_docs", docs("g1"))
    with pytest.raises(StateError):
        store.activate("g2", None)
    store.activate("g1", None)
    store.mark_ready("g2", "cat", 2)
    assert not store.try_activate("g2", None) and store.try_activate("g2", "g1")
    row = store.search("needle lemma", mode="evidence").first()
    assert row["generation_id"] == "g2" and row["hits"][0]["match_kind"] == "lexical" and row["unavailable"][0]["source_id"] == "y"
    assert store.search("D").first()["hits"][0]["match_kind"] == "exact"
    assert store.search("nothing").first()["hits"] == []
    store.collect_garbage("g1", "g1")
    assert store.state("g1") is None and store.status()["active"] == "g2"
    with pytest.raises(InputError):
        check_input(" ", 10, "discovery")


def test_rows_before_and_after_ready(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/plane")
    doc = lambda k: spark.createDataFrame([("g", "z", f"z::{k}", "F", None, f"needle {k}")], "generation_id string, source_id string, candidate_id string, source_path string, exact_identity string, body_text string").selectExpr("*", "cast(null as string) as declaration_id", "'s' as source_row_id", "1 as source_line")
    store.begin("g", "g", "cat")
    store.write("g", "search_docs", doc(1))
    store.write("g", "search_docs", doc(1), attempt="again")
    store.write("g", "corpora", spark.createDataFrame([("g", "z", "SEARCHABLE", None)], "generation_id string, source_id string, availability string, unavailable_reason string"))
    with pytest.raises(StateError, match="twice"):
        store.mark_ready("g", "cat", 1)
    store.write("g", "search_docs", doc(2), attempt="again")
    # a writer that passed the state check before READY, and puts its rows in place after it
    state = Store.state
    late = iter(["BUILDING"])

    def ready_meanwhile(self, g):
        told = next(late, None)
        if told is not None:
            Store.state = state
            self.mark_ready("g", "cat", 1)
        return told or state(self, g)

    monkeypatch.setattr(Store, "state", ready_meanwhile)
    with pytest.raises(StateError, match="READY without"):
        store.write("g", "search_docs", doc(3))
    monkeypatch.setattr(Store, "state", state)
    store.activate("g", None)
    assert [h["candidate_id"] for h in store.search("needle").first()["hits"]] == ["z::1", "z::2"]
    assert store.envelope("needle").first()["hits"] == ["z::1", "z::2"] and not store.try_collect("g", "g")


def test_null_identities_come_last(spark):
    from plinth.operators.generations import generation_hits

    docs = spark.createDataFrame([("a", "a::1", None, "needle"), ("b", "b::1", "X", "needle"), ("c", "c::1", "needle", "none")], "source_id string, candidate_id string, exact_identity string, body_text string")
    assert [r["candidate_id"] for r in generation_hits(docs, "needle", 3).collect()] == ["c::1", "b::1", "a::1"]
    assert [r["candidate_id"] for r in generation_hits(docs, "needle", 2).collect()] == ["c::1", "b::1"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.lean", "theorem x")
    (tmp_path / "b.tar.gz").write_bytes(releases.deterministic_tar({"y": b"1", "x": b"2"}))
    assert releases.deterministic_tar({"x": b"2", "y": b"1"}) == releases.deterministic_tar({"y": b"1", "x": b"2"})
    archives.register(spark)
    rows = spark.read.format("archive_members").load(f"{tmp_path}/*").collect()
    assert sorted(r["path"] for r in rows) == ["d/x.lean", "x", "y"]
    for name in ("../x", "/x", "a\\b", "a//b"):
        with pytest.raises(archives.UnsafeMember):
            archives.check_member(name, set())
    raw_tar = io.BytesIO()
    with tarfile.open(fileobj=raw_tar, mode="w") as t:
        info = tarfile.TarInfo("l")
        info.type, info.linkname = tarfile.SYMTYPE, "x"
        t.addfile(info)
    (tmp_path / "c.tar").write_bytes(raw_tar.getvalue())
    with pytest.raises(archives.UnsafeMember):
        list(archives.members(str(tmp_path / "c.tar")))


def test_readers(spark, tmp_path):
    (tmp_path / "t/.lake").mkdir(parents=True)
    (tmp_path / "t/A.lean").write_text("theorem a")
    (tmp_path / "t/.lake/B.lean").write_text("theorem b")
    tree = readers.read_tree(spark, str(tmp_path / "t"))
    assert [r["source_path"] for r in tree.collect()] == ["A.lean"]
    digest = hashlib.sha256(b"theorem a").hexdigest()
    listed = lambda p, h: spark.createDataFrame([(p, h)], "source_path string, sha256 string")
    assert readers.read_listed(spark, str(tmp_path / "t"), listed("A.lean", digest)).count() == 1
    for p, h in (("A.lean", "0"), ("C.lean", digest), ("../A.lean", digest)):
        with pytest.raises(PlinthError):
            readers.read_listed(spark, str(tmp_path / "t"), listed(p, h))
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "{"):
        with pytest.raises(ValueError):
            readers.strict_json(bad)


def test_text_functions():
    assert tx.token_list("Größe_foo's x²") == ["große", "foo", "s", "x²"]
    assert tx.query_terms("Größe a_b") == ["Größe", "a_b"]
    assert tx.phrases("lemmaR_tight _") == [["lemmar", "tight"], []]
    assert tx.token_list("e\u0301cole") == ["ecole"]


def test_streaming_ingest(spark, tmp_path, monkeypatch):
    from plinth.streaming import ingest

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("F.lean", "theorem needle : x\n")], "source_path string, text string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema("source_path string, text string").parquet(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/plane")
    run = lambda: ingest.start(files, store, str(tmp_path / "cp"), source_id="s", revision="r", catalog="c").awaitTermination(120)
    run()
    assert store.search("needle").first()["hits"][0]["source_id"] == "s"
    first = store.active()
    rows = [("G.lean", "theorem pin : x\n"), ("F.lean", "theorem thread : x\n")]
    spark.createDataFrame(rows, "source_path string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    hits = lambda q: [h["source_path"] for h in store.search(q).first()["hits"]]
    assert store.active() > first and hits("pin") == ["G.lean"] and hits("thread") == ["F.lean"] and hits("needle") == []
    # a file twice in a batch: the last row counts
    twice = [("I.lean", "theorem old : x\n"), ("I.lean", "theorem fresh : x\n")]
    spark.createDataFrame(twice, "source_path string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert hits("fresh") == ["I.lean"] and hits("old") == [] and hits("pin") == ["G.lean"]
    # a batch that is run again after it was frozen, but before it was activated
    spark.createDataFrame([("H.lean", "theorem bead : x\n")], "source_path string, text string").createOrReplaceTempView("h")
    batch, options = spark.table("h"), {"source_id": "s", "revision": "r", "catalog": "c"}
    monkeypatch.setattr(Store, "activate", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest.publish_batch(store, batch, 7, **options)
    monkeypatch.undo()
    ingest.publish_batch(store, batch, 7, **options)
    assert hits("bead") == ["H.lean"] and hits("pin") == ["G.lean"]


def test_entry_imports_without_the_corpus_subpackage():
    import subprocess
    import sys

    code = "import sys\nclass F:\n def find_spec(s, n, p=None, t=None):\n  if n.startswith(('plinth.llm', 'corpus_pipeline')): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, F())\nimport __spark_entry__ as e\nq = e.queries(); assert q and not any(k.startswith('op1') for k in q) and 'pipeline' not in q\nassert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
