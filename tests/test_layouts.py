"""Stored layouts: term index of generations, adjacency of the graph, and the commit log."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import generations, graph, termindex
from plinth.operators.commitlog import CommitLog
from plinth.operators.generations import FOLDED_VERSION, StateError, Store
from plinth.sources import adjacency
from plinth.sources.adjacency import Adjacency

DOCS = "source_id string, candidate_id string, declaration_id string, source_row_id string, source_path string, source_line int, exact_identity string, body_text string"


def made_docs(spark, count=400, seed=1):
    r = random.Random(seed)
    words = ["needle", "the", "of", "École", "x_1", "d9", "rare"]
    rows = []
    for k in range(count):
        text = None if k % 41 == 0 else " ".join(r.choice(words[:6]) for _ in range(r.randint(0, 4))) + (" rare" if k % 97 == 0 else "")
        rows.append((f"s{r.randint(0, 3)}", f"c{k}" if k % 50 else "needle", None, str(k), f"f{k}", 1, r.choice([None, f"D{k}", "needle", "d9"]), text))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    docs = made_docs(spark).dropDuplicates(["source_id", "candidate_id"]).cache()
    folder = f"file://{tmp_path_factory.mktemp('terms')}/i"
    # short spans and files, so that lists have many
    made = termindex.build(docs.repartition(5), folder, span=3, bucket_rows=60)
    return docs, termindex.TermIndex(spark, folder, made["buckets"])


@pytest.mark.parametrize("mode", ["discovery", "evidence"])
@pytest.mark.parametrize("asked", ["needle", "the of", "of rare", "École needle the", "D9", "c7", "nothing", "nothing the", "x_1 d9 rare"])
def test_index_gives_what_a_scan_gives(indexed, mode, asked):
    docs, index = indexed
    for limit in (1, 7, 100):
        keys = lambda df: [(r["source_id"], r["candidate_id"], r["is_exact"], r["match_kind"]) for r in df.collect()]
        want = keys(generations.generation_hits(docs, asked, limit, mode))
        assert keys(index.hits(asked, generations.check_input(asked, limit, mode), limit, mode)) == want


def test_index_reads_its_terms_buckets(indexed):
    _, index = indexed
    plan = index.lists(["rare"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,rare)" in plan
    assert index.lists(["rare"]).select("bucket").distinct().count() == 1 and index.blocks.select("bucket").distinct().count() > 5
    # the hot list is dealt over files
    assert index.lists(["the"]).select(F.input_file_name()).distinct().count() > 1


def test_empty_index(spark, tmp_path):
    docs = made_docs(spark).where("false")
    made = termindex.build(docs, f"file://{tmp_path}/i")
    index = termindex.TermIndex(spark, f"file://{tmp_path}/i", made["buckets"])
    assert index.hits("a b", ["a", "b"], 5, "evidence").count() == 0


CORPUS = "generation_id string, source_id string, availability string, unavailable_reason string"


def frozen(spark, store, name, version, text):
    store.begin(name, name, "cat", version)
    doc = spark.createDataFrame([("s", "s::1", None, "r", "F", 1, None, text)], DOCS).withColumn("generation_id", F.lit(name))
    store.write(name, "search_docs", doc)
    store.write(name, "corpora", spark.createDataFrame([(name, "s", "SEARCHABLE", None)], CORPUS))
    store.mark_ready(name, "cat", 1)


def test_versions_keep_their_terms(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/plane")
    frozen(spark, store, "old", generations.SCHEMA_VERSION, "École x_1")
    frozen(spark, store, "new", FOLDED_VERSION, "École x_1")
    asked = lambda q: [(r["generation_id"], r["projection_schema_version"]) for r in store.search_all(["old", "new"], q).collect()]
    assert asked("école") == [("old", "plinth.query.v1"), ("new", "plinth.query.v2")]
    assert asked("ecole") == [("new", "plinth.query.v2")] and asked("x_1") == [("old", "plinth.query.v1"), ("new", "plinth.query.v2")]
    assert asked("1") == [("new", "plinth.query.v2")]
    with pytest.raises(StateError, match="version"):
        store.begin("odd", "odd", "cat", "plinth.query.v9")
        store.hits("odd", "x")


# ---------------------------------------------------------------- adjacency

EDGE = "source_id string, target_id string, relation string, evidence_grade string, producer string"


@pytest.fixture(scope="module")
def stored_edges(spark, tmp_path_factory):
    r = random.Random(4)
    rows = {(f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}", r.choice(["type_dependency", "value_dependency"]), "G", "p") for _ in range(150)}
    rows |= {("hub", f"n{k}", "value_dependency", "G", "p") for k in range(60)} | {(f"n{k}", "hub", "type_dependency", "G", "p") for k in range(0, 60, 7)}
    edges = spark.createDataFrame(sorted(rows), EDGE)
    return edges, adjacency.build(edges, f"file://{tmp_path_factory.mktemp('adj')}/a", bucket_rows=20)


@pytest.mark.parametrize("reverse", [False, True])
def test_walks_over_the_layout(stored_edges, reverse):
    edges, stored = stored_edges
    for start in ("hub", "n3", "none"):
        for depth in (0, 1, 3):
            walks = [sorted(map(tuple, graph.dependencies(e, start, depth, reverse=reverse).collect())) for e in (edges, stored)]
            assert walks[0] == walks[1]
    for goal in ("n9", "hub", "none", "n3"):
        assert graph.shortest_path(edges, "n3", goal).first() == graph.shortest_path(stored, "n3", goal).first()
    assert sorted(map(tuple, stored.edges.collect())) == sorted(map(tuple, edges.collect()))


def test_a_level_reads_its_buckets(spark, stored_edges):
    _, stored = stored_edges
    for reverse, end in ((False, "source_id"), (True, "target_id")):
        step = stored.leaving(spark.createDataFrame([("n3",)], "node string"), reverse=reverse)
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan and f"EqualTo({end},n3)" in plan
    assert stored._side("out").select("bucket").distinct().count() > 8
    hub = stored._side("out").where("source_id = 'hub'")
    assert hub.select(F.input_file_name()).distinct().count() > 1 and hub.select("bucket").distinct().count() == 1


def test_empty_adjacency(spark, tmp_path):
    stored = adjacency.build(spark.createDataFrame([], EDGE), f"file://{tmp_path}/a")
    assert Adjacency(spark, f"file://{tmp_path}/a").edges.count() == 0
    assert graph.dependencies(stored, "x", 3).count() == 0 and not graph.shortest_path(stored, "x", "y").first()["found"]


# ---------------------------------------------------------------- commit log


class Lost(Exception):
    """The writer has died."""


class Dying(CommitLog):
    step = ""

    def _at(self, step):
        if step == self.step:
            raise Lost(step)


STEPS = ["claiming", "torn", "claimed", "placing"]


@pytest.mark.parametrize("step", STEPS)
def test_a_dead_writers_claim_is_taken_over(spark, tmp_path, step):
    root = f"file://{tmp_path}/log"
    dying = Dying(spark, root)
    dying.step = step
    with pytest.raises(Lost):
        dying.create("a/x.json", {"n": 1})
    log = CommitLog(spark, root)
    assert log.read("a/x.json") is None
    if step != "claiming":  # within the lease it may be alive
        assert not log.create("a/x.json", {"n": 2})
    log.lease = 0
    assert log.create("a/x.json", {"n": 3}) and log.read("a/x.json") == {"n": 3}
    assert not log.create("a/x.json", {"n": 4}) and CommitLog(spark, root).read("a/x.json") == {"n": 3}


def test_a_death_while_taking_over(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    for step in ("placing", "moving", "claiming", "torn", "claimed"):
        dying = Dying(spark, root, lease=0)
        dying.step = step
        with pytest.raises(Lost):
            dying.create("x", {})
    assert CommitLog(spark, root, lease=0).create("x", {"n": 1})


def test_a_slow_writer_loses(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    for step in ("torn", "claimed", "placing"):
        other = CommitLog(spark, root, lease=0)

        class Slow(CommitLog):
            def _at(self, at, step=step, other=other):
                if at == step:
                    assert other.create(f"{step}.json", {"by": "other"})

        assert not Slow(spark, root).create(f"{step}.json", {"by": "slow"})
        assert other.read(f"{step}.json") == {"by": "other"}


def test_stages_of_a_generation_recover(spark, tmp_path):
    for step in STEPS:
        root = f"file://{tmp_path}/{step}"
        dying = Store(spark, root, log=Dying(spark, root))
        store = Store(spark, root, log=CommitLog(spark, root, lease=0))
        dying.log.step = step
        with pytest.raises(Lost):
            dying.begin("g", "g", "cat")
        store.begin("g", "g", "cat")
        store.write("g", "corpora", spark.createDataFrame([("g", "s", "SEARCHABLE", None)], CORPUS))
        with pytest.raises(Lost):
            dying.mark_ready("g", "cat", 1)
        assert store.state("g") == "BUILDING"
        store.mark_ready("g", "cat", 1)
        with pytest.raises(Lost):
            dying.activate("g", None)
        assert store.active() is None
        store.activate("g", None)
        assert store.active() == "g" and not store.try_activate("g", None)


# ---------------------------------------------------------------- fingerprint tree


def test_drift_names_its_range(spark, tmp_path):
    from plinth.operators import fingertree

    rows = [(f"k{k:04}", k % 7, None if k % 5 else "x") for k in range(900)] + [(None, 1, "null key"), ("k0003", 3, "twice"), ("k0003", 3, "twice")]
    df = spark.createDataFrame(rows, "id string, n int, t string")
    tree = fingertree.build(df, "id", f"file://{tmp_path}/a", range_rows=40, fan=4)
    assert len(tree.meta["bounds"]) > 15 and tree.levels >= 4
    same = fingertree.build(df.repartition(7), "id", f"file://{tmp_path}/b", bounds=tree.meta["bounds"], fan=4)
    assert tree.root == same.root and tree.drift(same).count() == 0
    for change in (df.where("not id <=> 'k0500'"), df.withColumn("n", F.when(F.col("id") == "k0500", -1).otherwise(F.col("n"))), df.unionAll(df.where("id = 'k0500'"))):
        other = fingertree.build(change, "id", f"file://{tmp_path}/c{change.count()}-{hash(change)}", bounds=tree.meta["bounds"], fan=4)
        found = tree.drift(other).collect()
        assert len(found) == 1 and found[0]["low"] <= "k0500" < found[0]["high"]
        # one path is compared: of each level the children of one node
        assert found[0]["rows"] == tree.within(df, [found[0]["node"]]).count()
        read = other.update(df, spark.createDataFrame([("k0500",)], "id string"))
        assert read == [found[0]["node"]] and other.root == tree.root and fingertree.FingerTree(spark, other.folder).root == tree.root
    nulls = fingertree.build(df.where("id is not null"), "id", f"file://{tmp_path}/d", bounds=tree.meta["bounds"], fan=4)
    assert [r["node"] for r in tree.drift(nulls).collect()] == [0]
    nulls.update(df, spark.createDataFrame([(None,)], "id string"))
    assert nulls.root == tree.root
    with pytest.raises(Exception, match="ranges"):
        tree.drift(fingertree.build(df, "id", f"file://{tmp_path}/e", bounds=["k"]))
    none = fingertree.build(df.where("false"), "id", f"file://{tmp_path}/f")
    assert none.root == "" and none.drift(fingertree.build(df.where("false"), "id", f"file://{tmp_path}/g")).count() == 0


# ---------------------------------------------------------------- ordered sink


def test_lines_in_order(spark, tmp_path):
    from plinth.sources import linesink

    rows = [(k * 7919 % 1000, f"line {k} é") for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(6)
    folder = f"file://{tmp_path}/l"
    parts = linesink.write_lines(df, F.concat_ws("|", "k", "t"), ["k"], folder, parts=5)
    want = [f"{k}|{t}" for k, t in sorted(rows)]
    files = [(tmp_path / "l" / p["name"]).read_bytes() for p in parts]
    assert b"".join(files).decode().splitlines() == want and sum(p["rows"] for p in parts) == 1000 and len(parts) > 2
    import hashlib

    assert all(hashlib.sha256(b).hexdigest() == p["sha256"] and len(b) == p["bytes"] for b, p in zip(files, parts, strict=True))
    read = linesink.read_lines(spark, folder)
    assert sorted(r["value"] for r in read.collect()) == sorted(want) and read.select("part").distinct().count() == len(parts)
    with pytest.raises(Exception, match="already"):
        linesink.write_lines(df, F.col("t"), ["k"], folder)
    assert linesink.changed_parts(spark, folder).count() == 0
    (tmp_path / "l" / parts[1]["name"]).write_bytes(files[1] + b"x\n")
    (tmp_path / "l" / parts[2]["name"]).unlink()
    assert sorted(r["name"] for r in linesink.changed_parts(spark, folder).collect()) == sorted([parts[1]["name"], parts[2]["name"]])
    assert linesink.write_lines(df.where("false"), F.col("t"), ["k"], f"file://{tmp_path}/n") == [] and linesink.read_lines(spark, f"file://{tmp_path}/n").count() == 0


def test_lines_of_a_failed_write_do_not_count(spark, tmp_path):
    from plinth.sources import linesink

    bad = spark.range(100).withColumn("t", F.when(F.col("id") == 90, F.raise_error(F.lit("broken")).cast("string")).otherwise("x"))
    with pytest.raises(Exception, match="broken"):
        linesink.write_lines(bad, F.col("t"), ["id"], f"file://{tmp_path}/l", parts=4)
    assert not list((tmp_path / "l").glob("part-*")) if (tmp_path / "l").exists() else True
    with pytest.raises(Exception, match="no committed"):
        linesink.read_lines(spark, f"file://{tmp_path}/l")
    # an attempt that nobody reported
    (tmp_path / "l").mkdir(exist_ok=True)
    (tmp_path / "l" / "part-000000-lost.txt").write_text("lost\n")
    linesink.write_lines(spark.range(3).withColumn("t", F.lit("x")), F.col("t"), ["id"], f"file://{tmp_path}/l")
    assert [r["value"] for r in linesink.read_lines(spark, f"file://{tmp_path}/l").collect()] == ["x"] * 3
    assert not (tmp_path / "l" / "part-000000-lost.txt").exists()


# ---------------------------------------------------------------- split documents


def graph_text(r):
    odd = ['"', "\\", "\\\\", '\\"', "{", "}", "[", "]", ":", ",", "é", "🙂", "\n", "nodes", " "]
    name = lambda: "".join(r.choice(odd) for _ in range(r.randint(0, 12)))
    nodes = [{"name": name(), "module": name(), "kind": "thm", "fullName": None if r.random() < 0.2 else name(), "more": {"x": [[1, {"y": "}"}]]}} for _ in range(r.randint(0, 9))]
    edges = [{"source": name(), "target": name(), "kind": name()} for _ in range(r.randint(0, 9))]
    members = [("nodes", nodes), ("edges", edges), ("a" + name(), {"nodes": [{"name": "not this"}]}), ("b" + name(), name()), ("c", [1, "x", [2]]), ("d", None)]
    r.shuffle(members)
    return json.dumps(dict(members), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])), nodes, edges


def test_blocks_compose():
    from plinth.sources import splitjson as sj

    r = random.Random(12)
    for _ in range(60):
        text = graph_text(r)[0].encode()
        raw = np.frombuffer(text, np.uint8)
        # byte by byte
        quoted = escaped = False
        depth, want = 0, []
        for c in text.decode("latin-1"):
            want.append((quoted, escaped, depth))
            if escaped:
                escaped = False
            elif quoted and c == "\\":
                escaped = True
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(c, 0)
        for size in (1, 2, 3, 7, 50):
            state = sj.State()
            for at in range(0, len(raw), size):
                assert (state.quoted, state.escaped, state.depth) == want[at], (at, size)
                state = sj.after(state, sj.effect(raw[at : at + size]))


def test_split_graph_documents(spark, tmp_path):
    from plinth.sources import readers

    r = random.Random(13)
    for k, block in enumerate((3, 17, 64, 1 << 20)):
        text, nodes, edges = graph_text(r)
        (tmp_path / f"{k}.json").write_text(text)
        n, e = readers.read_raw_graph(spark, f"file://{tmp_path}/{k}.json", block=block)
        key = lambda rows: sorted(rows, key=str)
        assert key([(x["name"], x["module"], x["kind"], x["fullName"]) for x in n.collect()]) == key([(x["name"], x["module"], x["kind"], x["fullName"]) for x in nodes])
        assert key([tuple(x) for x in e.collect()]) == key([(x["source"], x["target"], x["kind"]) for x in edges])
    # several documents, each in many tasks
    n, _ = readers.read_raw_graph(spark, f"file://{tmp_path}/*.json", block=40)
    assert n.rdd.getNumPartitions() > 5
    for bad in ("[]", "", "null", "{}", '{"nodes": []}', '{"nodes": [], "edges": {}}', '{"nodes": [1], "edges": []}', '{"nodes": [[{"name": "x"}]], "edges": []}', '{"nodes": ["x"], "edges": []}', '{"nodes": [], "edges": [], "nodes": []}', '{"nodes": [], "edges": []} x', '{"nodes": [{"name": 1, "edges": []'):
        (tmp_path / "bad").write_text(bad)
        for block in (2, 1 << 20):
            with pytest.raises(Exception):
                [x.collect() for x in readers.read_raw_graph(spark, f"file://{tmp_path}/bad", block=block)]


# ---------------------------------------------------------------- split archives


def test_archives_in_many_tasks(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    from plinth.sources import archives

    r = random.Random(2)
    files = {f"d{k % 5}/f{k}é.txt": bytes(r.randrange(256) for _ in range(r.choice([0, 5, 3000]))) * r.choice([1, 4]) for k in range(60)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k, (name, data) in enumerate(files.items()):
            z.writestr(name, data, zipfile.ZIP_DEFLATED if k % 3 else zipfile.ZIP_STORED)
        z.writestr("d0/", b"")
    for mode in ("w", "w:gz"):
        with tarfile.open(tmp_path / f"a.{mode.replace(':', '')}.tar", mode) as t:
            for name, data in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    archives.register(spark)
    for name, many in (("a.zip", True), ("a.w.tar", True), ("a.wgz.tar", False)):
        df = spark.read.format("archive_members").option("splitBytes", 20_000).load(f"file://{tmp_path}/{name}")
        assert {x["path"]: bytes(x["content"]) for x in df.collect()} == files
        assert (df.rdd.getNumPartitions() > 3) == many and dict(archives.members(str(tmp_path / name))) == files
    with zipfile.ZipFile(tmp_path / "e.zip", "w"):
        pass
    assert spark.read.format("archive_members").load(f"file://{tmp_path}/e.zip").count() == 0
    raw = (tmp_path / "a.zip").read_bytes()
    place = raw.index(b"d1/f1")
    large = max(archives.directory(str(tmp_path / "a.zip")), key=lambda m: m.packed).offset + 200
    for bad in (raw[:place] + b"d1/x1" + raw[place + 5 :], raw[:large] + bytes([raw[large] ^ 1]) + raw[large + 1 :]):
        (tmp_path / "bad.zip").write_bytes(bad)
        with pytest.raises(archives.UnsafeMember):
            list(archives.members(str(tmp_path / "bad.zip")))
    with pytest.raises(archives.UnsafeMember, match="longer"):
        list(archives.members(str(tmp_path / "a.zip"), 100))
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("ok", b"1")
        z.writestr("../x", b"1")
    with pytest.raises(Exception, match="x"):
        spark.read.format("archive_members").load(f"file://{tmp_path}/u.zip").limit(1).collect()
