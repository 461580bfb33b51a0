"""What a stored relation costs must follow its rows: the work of findings F1 to F22."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plinth.operators.fingerprint import content_sum
from plinth.operators.integrity import require
from plinth.sources.index import Index, build

META = {"source_kind": "git", "source_commit": "r1", "created_from_authoritative_commit": False, "root_modules": ["A"], "dependency_boundary": "internal_only", "producer_kind": "star"}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    texts = [(f"d{i:04d}", "r1", f"p{i % 2}", f"p/{i:04d}", 1, 1, f"en w{i % 3}", " ".join(f"w{(i * k) % 37}" for k in range(i % 50))) for i in range(300)]
    rows = spark.createDataFrame(texts, "id string, source_revision string, source_id string, source_path string, source_start_line int, source_end_line int, declaration_hint string, text string")
    path = f"file://{tmp_path_factory.mktemp('growth')}/index"
    build({"sources": rows}, path, meta=META, corpus="source_id")
    return Index(spark, path), rows




def test_index_print_stores_no_posting(spark, indexed, monkeypatch):
    """the print of postings needs no stored digests and no row that moves."""
    from plinth.sources import index as module

    index, _ = indexed
    seen = []
    monkeypatch.setattr(module, "fingerprint", lambda df, real=module.fingerprint: seen.append(set(df.columns)) or real(df))
    assert index.fingerprint() == index.meta["fingerprint"]
    assert not any("positions" in c for c in seen)
    plan = content_sum(index._ranked_postings())._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_orphans_are_told_by_words_of_documents(spark, indexed):
    """documents move as bits, not as a row per posting or bucket."""
    index, _ = indexed
    known = index.sources.where("source_path not like '%7'")
    want = sorted(r[0] for r in index.postings.select("doc").distinct().join(known.select("doc"), "doc", "left_anti").collect())
    assert want and sorted(r[0] for r in index.orphans(known).collect()) == want
    assert "bit_or" in index.orphans(known)._jdf.queryExecution().optimizedPlan().toString()
    require(index.orphans(), "none")


def test_index_print_tells_changed_places(spark, indexed, tmp_path):
    index, rows = indexed
    target = f"file://{tmp_path}/i"
    assert build({"sources": rows.repartition(7)}, target, meta=META, corpus="source_id") == index.meta["fingerprint"]
    other = rows.withColumn("text", F.when(F.col("id") == "d0049", F.reverse("text")).otherwise(F.col("text")))
    assert content_sum(index._ranked_postings()).first() != content_sum(Index(spark, f"{target}", checked=False)._ranked_postings().where("doc != 49")).first()
    assert build({"sources": other}, f"{target}2", meta=META, corpus="source_id") != index.meta["fingerprint"]


def test_texts_are_cut_once_and_blocks_move(spark, indexed, tmp_path):
    """postings are what a scan of the texts gives, in packed blocks."""
    from plinth.operators import search
    from plinth.sources import index as module

    index, rows = indexed
    want = search.postings(rows).groupBy("id", "col", "term").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    got = index.postings.join(index.sources.select("doc", "id"), "doc").select("id", "col", "term", F.col("positions").alias("p"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sizes = {r["corpus"]: (r["documents"], r["tokens"]) for r in index.corpora.collect()}
    n = search.postings(rows).join(rows.select("id", "source_id"), "id").groupBy("source_id").count().collect()
    assert sizes == {r["source_id"]: (150, r["count"]) for r in n}
    plan = module._postings(index.sources.withColumn("corpus", F.col("source_id")), 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and "Aggregate" not in plan and "RebalancePartitions" in plan


def test_vocabulary_adds_up_marked_rows(spark, indexed):
    """a term of both columns counts a document once, though no document is grouped by."""
    index, rows = indexed
    plan = index.term_stats()._jdf.queryExecution().optimizedPlan().toString()
    assert "doc#" not in plan.split("Project")[0]
    from plinth.operators import search

    posts = search.postings(rows).join(rows.select("id", "source_id"), "id")
    want = posts.groupBy("source_id", "term").agg(F.countDistinct("id").alias("df"), F.count("*").alias("cf"))
    assert sorted(map(tuple, index.term_stats().collect())) == sorted(map(tuple, want.collect()))


def test_blocks_of_few_tokens(spark, indexed, tmp_path, monkeypatch):
    """A text longer than a block, and texts without a token, keep their places."""
    import pyarrow as pa

    from plinth.sources import blocks
    from plinth.sources import index as module

    docs = pa.RecordBatch.from_pydict({"corpus": pa.array(["a", None, "b", "b"]), "doc": pa.array([5, 6, 7, 8]), "h": pa.array([["x"], [], ["y", "x"], []], pa.list_(pa.string())), "t": pa.array([["x", "z", "x"], [], ["q"], []], pa.list_(pa.string()))})
    monkeypatch.setattr(module, "_MOST_TOKENS", 1)
    rows = [r for b in blocks.unpacked(module._gather(iter([docs, docs.slice(1, 1)]), 3)) for r in b.to_pylist()]
    told = sorted((r["corpus"], r["term"], r["doc"], r["dl"], r["col"], r["first"], tuple(r["positions"])) for r in rows)
    assert told == [("a", "x", 5, 4, "declaration_hint", True, (0,)), ("a", "x", 5, 4, "text", False, (0, 2)), ("a", "z", 5, 4, "text", True, (1,)), ("b", "q", 7, 3, "text", True, (0,)), ("b", "x", 7, 3, "declaration_hint", True, (1,)), ("b", "y", 7, 3, "declaration_hint", True, (0,))]


def test_listing_is_whole(spark):
    """all matches are listed, more of them than hits, in either order."""
    from plinth.operators.generations import envelope_hits

    names = [f"c{i:03d}" for i in range(250)]
    docs = spark.createDataFrame([(n, "a needle" if i % 2 else None) for i, n in enumerate(names)] + [(None, "needle")], "candidate_id string, body_text string").repartition(6)
    for down in (False, True):
        row = envelope_hits(docs, "needle", 7, descending=down).first()
        want = sorted(names[1::2], reverse=down)
        assert row["listed"].split(",") == want and row["hits"] == want[:7]
    none = envelope_hits(docs, "zz", 7).first()
    assert (none["listed"], none["hits"]) == ("", [])


def test_edges_are_dealt_without_counts(spark, tmp_path):
    """Either order of the edges moves once, packed; nodes aren't counted."""
    from plinth.sources import adjacency, blocks

    rows = [(f"a{i % 90}" if i % 3 else "hub", f"b{i % 70}", "value_dependency", "G", None if i % 11 == 0 else "p") for i in range(1000)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, relation string, evidence_grade string, producer string").repartition(5)
    stored = adjacency.build(edges, f"file://{tmp_path}/a", bucket_rows=50)
    for side in ("out", "in"):
        assert sorted(map(repr, stored._side(side).select(*edges.columns).collect())) == sorted(map(repr, edges.collect()))
    plan = blocks.deal(edges.withColumn("bucket", adjacency.bucket_of(F.col("source_id"), 20)), "source_id", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "Aggregate" not in plan and "Join" not in plan
    names = stored._side("out").where("source_id = 'hub'").select(F.input_file_name()).distinct().count()
    assert names > 1


def test_digests_move_as_bytes_and_are_not_stored(spark):
    """the fingerprint is that of the digests' texts, and nothing is written for it."""
    import hashlib

    from plinth import scratch
    from plinth.operators.fingerprint import fingerprint, row_digests

    df = spark.range(3000).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 3 > 0, "x").alias("b"))
    before = set(scratch._left)
    row = fingerprint(df).first()
    assert set(scratch._left) == before
    groups: dict[int, list[str]] = {}
    for r in row_digests(df).collect():
        groups.setdefault(int(r["digest"][:3], 16), []).append(r["digest"])
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert (row["rows"], row["fingerprint"]) == (3000, sha(",".join(f"{b}:{sha(''.join(sorted(d)))}" for b, d in sorted(groups.items()))))


def test_edges_move_once_to_be_normalized(spark):
    """ends that stand for themselves meet no table; endpoints are read once."""
    from plinth.operators import normalize

    nodes = spark.createDataFrame([("f", "A.B", "thm", "A.B.f"), ("g", "A.B", "thm", "A.B.g"), ("g", "C", "thm", "C.D.g"), ("h", "C", "thm", "C.h"), ("k", "A.B", "thm", "A.B.x.k"), ("k", "A.B", "thm", "A.B.y.k")], "name string, module string, kind string, fullName string")
    edges = spark.createDataFrame([("f", "A.B.g", "type"), ("A.B.f", "A.B.g", "type"), ("A.B.g", "A.B.f", "value"), ("C.h", "A.B.f", "value"), ("A.B.f", "h", "value"), ("k", "A.B.f", "value"), ("zz", "f", "type")], "source string, target string, kind string")
    made, bad = normalize.scoped_edges(nodes, edges, ["A"], "p")
    assert sorted((r["source_id"], r["target_id"], r["relation"]) for r in made.collect()) == [("lean:A.B.f", "lean:A.B.g", "value_dependency"), ("lean:A.B.g", "lean:A.B.f", "type_dependency")]
    assert sorted(r["source"] for r in bad.collect()) == ["k", "zz"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    ends = edges.select(F.explode(F.array("source", "target")).alias("endpoint"))
    told = {r["endpoint"]: (r["full_name"], r["n_candidates"]) for r in normalize.resolve_endpoints(nodes, ends).collect()}
    assert told == {"f": ("A.B.f", 1), "A.B.f": ("A.B.f", 1), "A.B.g": ("A.B.g", 1), "C.h": ("C.h", 1), "h": ("C.h", 1), "k": (None, 2), "zz": (None, 0)}
    assert normalize.resolve_endpoints(nodes, ends)._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_made_relations_are_those_of_their_sql(spark):
    """pairs told apart by their keys give the rows of the relations' own texts."""
    import os

    from plinth.plans import fixtures as fx

    tables = {"nation": "n_nationkey int, n_regionkey int", "supplier": "s_suppkey long, s_nationkey int", "customer": "c_custkey long, c_nationkey int", "orders": "o_orderkey long, o_custkey long", "lineitem": "l_orderkey long, l_partkey long, l_suppkey long"}
    rows = {"nation": [(k, k % 2) for k in range(4)], "supplier": [(2, 1), (3, 2)], "customer": [(1, 2), (12, 3)], "orders": [(1, 12), (2, None)], "lineitem": [(1, 2, 2), (1, 2, 3), (1, 2, 2), (None, 2, 2), (None, 2, None), (2, None, 2)]}
    views = {t: spark.createDataFrame(rows[t], kind) for t, kind in tables.items()}
    for sql in (fx.EDGES, fx.RAW_EDGES):
        got, want = (sorted(map(repr, spark.sql(text, **{t: v for t, v in views.items() if "{" + t + "}" in text}).collect())) for text in (fx._MADE[sql], sql))
        assert got == want and len(got) > 8
    assert "SELECT DISTINCT 'Sales" not in fx._MADE[fx.EDGES]


def test_ranges_are_told_without_python(spark):
    """few bounds are compared in the JVM, and digests are summed as numbers."""
    from plinth.operators import fingertree

    keys = [None, "", "a", "é", "b", "\U0001f600", "￮", "zz"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    few = ["", "b", "é", "￮"]
    many = ["", *sorted([*few[1:], *(f"y{i:03d}" for i in range(80))], key=str.encode)]
    for bounds in (few, many):
        got = {r["k"]: r["n"] for r in df.select("k", fingertree.range_of(F.col("k"), bounds).alias("n")).collect()}
        assert got == {k: 0 if k is None else sum(b.encode() <= k.encode() for b in bounds) - 1 for k in keys}
    plan = fingertree._ranges(df, "k", ["k"], few)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "conv(" not in plan and "decimal" not in plan


def test_one_order_of_edges(spark, tmp_path):
    """a traversal needs one order of the edges; the other is not read by mistake."""
    from plinth.errors import PlinthError
    from plinth.operators import graph
    from plinth.sources import adjacency

    edges = spark.createDataFrame([("a", "b", "r", "G", "p"), ("b", "c", "r", "G", "p"), ("d", "c", "r", "G", "p")], "source_id string, target_id string, relation string, evidence_grade string, producer string")
    stored = adjacency.build(edges, f"file://{tmp_path}/a", sides=("in",))
    assert sorted(p.name for p in tmp_path.joinpath("a").iterdir() if p.is_dir()) == ["in"] and stored.edges.count() == 3
    assert sorted((r["source_id"], r["depth"]) for r in graph.dependencies(stored, "c", 2, reverse=True).collect()) == [("a", 2), ("b", 1), ("d", 1)]
    with pytest.raises(PlinthError, match="source_id"):
        graph.dependencies(stored, "a", 1).collect()


def test_edges_are_not_sorted_to_meet_nodes(spark):
    """ids are hashed, whatever the planner would take."""
    from plinth.operators import binding, integrity

    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "b"), ("a", "b"), (None, "a")], "source_id string, target_id string")
    nodes = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    kept, lost = binding.restrict_edges(edges, nodes), integrity.dangling_violations(edges, nodes)
    assert [tuple(r) for r in kept.collect()] == [("a", "b"), ("a", "b")]
    assert sorted((r["key"] or "", r["detail"]) for r in lost.collect()) == [("", "source_id is no node"), ("x", "target_id is no node"), ("y", "source_id is no node")]
    for df in (kept, lost):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMergeJoin", "Sort ")


def test_repeated_keys_are_told_by_hashes(spark):
    """F16: keys as texts are counted only where their hash occurs more than once."""
    from plinth.operators.integrity import unique_violations

    # nulls are no part of a hash, so these rows share one and are still told apart
    df = spark.createDataFrame([("a", None), (None, "a"), ("b", "c"), ("b", "c"), (None, None), (None, None), ("d", "e")], "k string, l string")
    rows = unique_violations(df, "V6", ["k", "l"])
    assert sorted(r["key"] for r in rows.collect()) == ["", "b|c"]
    assert "left_semi" in rows._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")


def test_term_lists_move_as_blocks(spark, tmp_path):
    """texts are cut once, no row per posting moves, and lists over many parts of the
    documents are whole and apart."""
    from plinth.operators import termindex

    texts = [("s", f"c{i:04d}", f"d{i}" if i % 3 == 0 else None, None if i % 41 == 0 else f"the w{i % 5} w{i % 7} the") for i in range(500)]
    docs = spark.createDataFrame(texts, "source_id string, candidate_id string, exact_identity string, body_text string").repartition(3)
    calls = []
    made = termindex.build(docs, f"file://{tmp_path}/i", span=4, bucket_rows=100, words=lambda c: calls.append(1) or termindex.words(c))
    index = termindex.TermIndex(spark, f"file://{tmp_path}/i", made["buckets"])
    want: dict[tuple, list[str]] = {}
    for _, name, exact, text in texts:
        for term in {*(text or "").split(), f"={name}", *([f"={exact}"] if exact else [])}:
            want.setdefault((term, exact is not None), []).append(name)
    names = {r["doc"]: r["candidate_id"] for r in index.docs.collect()}
    rows = index.blocks.collect()
    got: dict[tuple, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["span"]):
        assert r["docs"] == sorted(r["docs"]) and r["n"] == len(r["docs"]) and {d // 4 for d in r["docs"]} == {r["span"]}
        got.setdefault((r["term"], r["named"]), []).extend(names[d] for d in r["docs"])
    assert got == want and len({(r["term"], r["named"], r["span"]) for r in rows}) == len(rows)
    assert calls == [1] and made["postings"] == sum(map(len, want.values()))
