"""Which rows the n-gram join keeps, against brute force; hot keys."""

import random
import re
from collections import Counter

import pytest

from plinth.llm import ngramjoin, storage

VOCAB = ["the", "of", "river", "stone", "wander", "Größe", "café", "it", "under", "blue", "seven", "maps", "x1", "and", "light"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, size):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def survivors(rows, size=5, percent=80):
    """Groups of the (id, text) rows, and the rows that may stay of each."""
    sets = [grams(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for k, row in enumerate(rows):
        if sets[k]:
            groups.setdefault(top(k), []).append(row)
    return list(groups.values()), [row for k, row in enumerate(rows) if not sets[k]]


@pytest.mark.parametrize("most", [200_000, 0])
def test_no_group_loses_all_its_rows(spark, monkeypatch, most):
    # ids repeat, and are null, over texts that are alike and that are not
    monkeypatch.setattr(storage, "BROADCAST_ROWS", most)
    for f in (storage.is_small, storage.small_side):
        monkeypatch.setattr(f, "__defaults__", (most, storage.BROADCAST_BYTES))
    monkeypatch.setitem(storage.spread_join.__kwdefaults__, "most", most)
    monkeypatch.setattr(storage, "HOT_ROWS", 2)
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    near = a + " tail"
    rows = [(3, a), (7, a), (7, b), (None, a), (None, c), (7, near), (9, near), (9, near), (None, c), (11, None), (11, ""), (12, " \n")]
    r = random.Random(5)
    for k in range(30):
        w = prose(10 + k % 6, 50).split()
        w[r.randrange(50)] = "odd"
        rows.append((r.choice([None, 7, 20, 21, 22, k]), " ".join(w)))
    d = spark.createDataFrame([(i, t, str(k), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _h string, _i1 long")
    out = ngramjoin.keep_one(d)
    assert out.columns == d.columns
    kept = [(x["doc_id"], x["text"]) for x in out.collect()]
    groups, wordless = survivors(rows)
    least = lambda g: min(((i is None, i or 0) for i, _ in g))
    assert Counter(x for x in kept if not words(x[1])) == Counter(wordless)
    worded = [x for x in kept if words(x[1])]
    assert len(worded) == len(groups)
    for g in groups:
        mine = [x for x in worded if x in g]
        assert len(mine) == 1 and ((mine[0][0] is None, mine[0][0] or 0)) == least(g)


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(storage, "HOT_ROWS", 10)
    rows = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then -1 else id % 50 end as key")
    counts = storage.materialize(rows.groupBy("key").count().selectExpr("key", "key * 2 as twice", "count as c"), "t")
    joined = storage.spread_join(rows, counts, "key", ["id"], count="c", most=0)
    assert "_salt" in joined._jdf.queryExecution().toString()
    assert sorted((x["id"], x["key"], x["twice"]) for x in joined.collect()) == sorted((x["id"], x["key"], 2 * x["key"]) for x in rows.collect())


def test_storage_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "a"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session())


def test_unused_names(spark):
    d = spark.range(1).selectExpr("id as _row", "id as _ROW1")
    assert storage.unused(d, "_row", "_row", "x") == ["_row2", "_row3", "x"]
