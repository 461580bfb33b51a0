"""Vector codes, url rules and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plinth.llm import resampling, urlrules, veccodes
from plinth.llm.textkernel import Texts

# ---------------------------------------------------------------- vector codes


def codes_brute(rows, parts=8, entries=16, rounds=6):
    """(id, code, error) of sound (id, vector) rows, and the codebooks' digest."""
    ints = [(i, [math.floor(veccodes._exact(float(x)) if abs(x) < 1e300 else int(x) * 4096) for x in v]) for i, v in rows]
    width = -(-len(ints[0][1]) // parts)
    cut = [(i, [(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)]) for i, v in ints]
    first = sorted(cut, key=lambda r: r[0])[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min((dist(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for _, v in cut:
                held[best(v[p], book)[1]].append(v[p])
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for e, h in zip(book, held)]
    out = []
    for i, v in cut:
        found = [best(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


@pytest.mark.parametrize(("length", "count", "spread"), [(16, 300, 1.0), (20, 60, 0.001), (8, 5, 1.0), (16, 40, 3e4)])
def test_codes(spark, length, count, spread):
    r = np.random.default_rng(length + count)
    # a small spread gives many ties
    rows = [(int(k), [float(np.float32(x)) for x in r.normal(0, spread, length)], int(k) % 3 if k % 5 else None) for k in r.permutation(count)]
    want, sha = codes_brute([x[:2] for x in rows])
    got = veccodes.compress(vectors(spark, rows, "float").repartition(3)).collect()
    assert sorted((x["vec_id"], x["code"], x["error"]) for x in got) == sorted(want)
    assert {x["codebooks_sha256"] for x in got} == {sha}
    error, label = {i: e for i, _, e in want}, {x[0]: x[2] for x in rows}
    for x in got:
        assert x["label_error"] == sum(e for i, e in error.items() if label[i] == label[x["vec_id"]])


def test_codes_of_odd_rows(spark):
    sound = [float(k) for k in range(8)]
    rows = [(1, sound, 0), (1, sound, 0), (2, None, 0), (3, [], 0), (4, [None] + sound[1:], 1), (5, [float("nan")] + sound[1:], 1), (6, [float("-inf")] + sound[1:], 1), (7, sound[:4], 1), (None, [x + 1 for x in sound], None), (8, [x * 1e30 for x in sound], 9)]
    clash = vectors(spark, rows).selectExpr("*", "'x' as v", "1 as code", "2 as error", "3 as key", "4 as n")
    got = veccodes.compress(clash).collect()
    assert Counter(x["vec_id"] for x in got) == Counter([1, 1, 8, None])
    assert all(x["error"] == 0 for x in got)  # an entry each
    assert veccodes.compress(clash.where("false")).count() == 0
    # an error beyond 64 bits is null, not wrong
    far = [(k, [1.0] * 8, 0) for k in range(16)] + [(20, [1e30] * 8, 0), (21, [5e29] * 8, 1)]
    got = {x["vec_id"]: x for x in veccodes.compress(vectors(spark, far)).collect()}
    assert got[20]["error"] is None and got[21]["label_error"] is None and got[3]["error"] == 0


def test_tree_prunes_and_keeps_ties():
    r = np.random.default_rng(7)
    entries = np.concatenate([r.integers(-40, 40, (8, 3)) + 5000 * c for c in (0, 1)])
    rows = np.concatenate([r.integers(-60, 60, (500, 3)), r.integers(4940, 5060, (500, 3))])
    tree = veccodes.Tree(entries)
    found, best = tree.nearest(rows)
    squares = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
    assert tree.visited < 0.8 * squares.size
    same = veccodes.Tree(np.tile(entries[:1], (16, 1)))
    assert (same.nearest(rows)[0] == 0).all()
    wide = veccodes.Tree(entries.astype(object) * 10**30)
    assert (wide.nearest(rows.astype(object) * 10**30)[0] == found).all()
    n = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 62) - 1])
    assert veccodes._roots(n).tolist() == [math.isqrt(int(x)) for x in n]


# ---------------------------------------------------------------- url rules


def judge_brute(url, rules):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    longest = max(fit, default=(0, None, "allow"))
    return host, path, longest[1], longest[2]


def test_registered_rules_and_odd_urls(spark):
    urls = [None, "", "example.org/en/1", "http://Example.ORG/en/12?x#y", "https://a.b.example.org/es/", "https://notexample.org/es/1", "ftp://org", "ftp://org/", "http://x.com/de/1", "http://x.com/FR/", "http://x.com#/fr/", "http://x.com?u=://y.org/", "://com/fr/://org/", "http://user@x.com:80/fr/", "http://.com/fr/", "http://com./fr/", "http://xÉ.ORG/é\n/", "http:///en/1", "http://example.org//es/", "http://org/" + "a/" * 5000]
    pages = spark.createDataFrame([(k, u, "x", 1, 2, 3, "r") for k, u in enumerate(urls)] + [(0, None, "x", 1, 2, 3, "r"), (None, urls[3], "x", 1, 2, 3, "r")], "page_id long, url string, best string, host_ int, path_ int, length int, rule string")
    out = urlrules.judge(pages, urlrules.rule_table(spark, urlrules.RULES))
    assert Counter(r["page_id"] for r in out.collect()) == Counter([*range(len(urls)), 0, None])
    for r in out.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge_brute(r["url"], urlrules.RULES), r["url"]
    assert set(pages.columns) < set(out.columns) and len(out.columns) == len(pages.columns) + 3
    assert urlrules.judge(pages.where("false"), urlrules.rule_table(spark, urlrules.RULES)).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_random_rules(spark, monkeypatch, small):
    r = random.Random(3)
    if not small:
        monkeypatch.setattr(urlrules, "is_small", lambda *a: False)
    host = lambda: ".".join(r.choice(["a", "b", "com", "org"]) for _ in range(r.randint(1, 3)))
    path = lambda: "".join("/" + r.choice(["x", "y", "xy", ""]) for _ in range(r.randint(0, 3)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(40))}.values())
    faulty = [(None, "/", "block"), ("a", None, "block"), ("a", "/x", "maybe"), ("", "", "block"), ("a", "x", "block"), ("a/", "", "block"), ("a", "/?", "block")]
    urls = [f"http://{host()}{path()}{r.choice(['', '?q', '#f'])}" for _ in range(300)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = urlrules.judge(pages, urlrules.rule_table(spark, rules + faulty + [(h.upper(), p, v) for h, p, v in rules[:5]])).collect()
    # of rules of one length the greater text wins
    assert [(x["rule"], x["verdict"]) for x in sorted(got, key=lambda x: x["page_id"])] == [judge_brute(u, rules)[2:] for u in urls]
    none = urlrules.judge(pages, urlrules.rule_table(spark, rules).where("false"), default="block")
    assert {(x["rule"], x["verdict"]) for x in none.collect()} == {(None, "block")}


def test_equal_rules_block(spark):
    rules = [("a", "/", "allow"), ("A", "/", "block")]
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    assert urlrules.judge(pages, urlrules.rule_table(spark, rules)).first()["verdict"] == "block"


# ---------------------------------------------------------------- resampling


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes([*range(65), *range(97, 123), *range(91, 256)])))


def runs(text):
    w = words_of(text)
    return [zlib.crc32(b" ".join(w[k : k + n])) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def resample_brute(docs, items, percent=5):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(text))
    for text in items:
        t.update(runs(text))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(ns + 10000) / (float(s[b] + 1) * float(nt + 10000))))
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in runs(text))
        out.append((i, len(words_of(text)), len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = Counter((*r, k) for k, r in enumerate(able[: percent * len(able) // 100], 1))
    return drawn, Counter(out)


def test_crc_of_runs():
    r = random.Random(5)
    texts = ["", " ", None] + ["".join(r.choice(["a", "Z", "é", "🙂", "0", " ", " ", "-", "x" * 80, "y" * 63, "z" * 64]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    counts, bucket, owner = resampling.features(Texts.of(texts))
    for k, text in enumerate(texts):
        assert counts[k] == len(words_of(text))
        assert Counter(bucket[owner == k].tolist()) == Counter(runs(text))
    counts, bucket, owner = resampling.features(Texts.of([]))
    assert len(counts) == len(bucket) == len(owner) == 0


@pytest.mark.parametrize("small", [True, False])
def test_resampling(spark, monkeypatch, small):
    r = random.Random(11)
    if not small:
        monkeypatch.setattr(resampling, "is_small", lambda *a: False)
        from plinth.llm import storage

        monkeypatch.setattr(storage, "is_small", lambda *a, **k: False)
        monkeypatch.setattr(storage, "HOT_ROWS", 16)
    vocab = [f"w{k}" for k in range(60)] + ["Größe", "ÀB", "q" * 90]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    hot = prose(30)
    docs = [(k, hot if k % 3 == 0 else prose(r.randint(0, 60))) for k in range(300)] + [(None, None), (None, hot), (None, ""), (7, prose(25)), (8, docs_twice := prose(40)), (8, docs_twice), (900, "x " * 19), (901, "X-" * 20)]
    items = [prose(20), None, "", " ".join(vocab[:9])]
    frame = spark.createDataFrame([(i, t, 1, 2, "k", "n") for i, t in docs], "doc_id long, text string, copies int, rank int, key string, bucket string")
    got = [tuple(x) for x in resampling.resample(frame, spark.createDataFrame([(t,) for t in items], "text string")).collect()]
    drawn, all_ = resample_brute(docs, items)
    assert Counter(x[:5] for x in got) == all_
    assert Counter(x for x in got if x[5] is not None) == drawn and sum(drawn.values()) > 10


def test_resampling_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "text string"))
    assert resampling.resample(docs, items).count() == 0
    one = resampling.resample(spark.createDataFrame([(1, "a b c " * 20)], docs.schema), items, percent=100).first()
    assert one["n_features"] == 177 and one["rank"] == 1


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 7 as score", "id % 2 = 0 as able")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = resampling.ranked(rows, [resampling.F.desc("score"), resampling.F.asc("doc_id")], "able", 10)
        got = sorted((x["rank"], x["doc_id"]) for x in out.where("rank is not null").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((k for k in range(0, 5000, 2)), key=lambda k: (-(k % 7), k))[:250]
    assert got == list(enumerate(want, 1)) and out.count() == 5000


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_importance_resampling", "op13_url_filter"])
def test_registered_queries(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = entry.SMOKE_DIR
    rows = entry.queries()[name](spark, folder)
    with duckdb.connect() as con:
        for table in ("documents", "benchmark", "pages", "embeddings"):
            con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
        told = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in told.description]
        assert names == rows.columns
        assert Counter(tuple(r) for r in rows.collect()) == Counter(told.fetchall())
