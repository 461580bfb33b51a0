"""Line deduplication: characters of several bytes, recall against all pairs, odd tables."""

import random

import numpy as np
import pytest

from plinth.llm import linedup, storage, textkernel

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def gram_sets(lines):
    return [{t[k : k + 8] for k in range(len(t) - 7)} for t in lines]


@pytest.mark.parametrize("letters", ["abcdefghijkl", "абвгдежзийкл", "的一是在不了有和人这中大", "aéбβ的🙂ßñ"])
def test_shingles_are_of_characters(letters):
    r = random.Random(letters)
    lines = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts = textkernel.Texts.of(lines)
    keys, own = linedup.shingles(texts)
    for k, want in enumerate(gram_sets(lines)):
        assert len(set(keys[own == k].tolist())) == len(want)
    assert linedup.char_counts(texts).tolist() == [len(x) for x in lines]
    # a line has the same shingles whatever lines stand beside it
    alone = [set(linedup.shingles(textkernel.Texts.of([x]))[0].tolist()) for x in lines]
    assert alone == [set(keys[own == k].tolist()) for k in range(len(lines))]


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "абвгдежзийклмноп", "的一是在不了有和人这中大为上个国"])
def test_recall_against_all_pairs(spark, letters):
    r = random.Random(len(letters.encode()))
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    lines = []
    for _ in range(60):
        base = [word() for _ in range(r.randint(6, 25))]
        lines.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            w = list(base)
            for _ in range(r.randint(1, 2)):
                w[r.randrange(len(w))] = word()
            lines.append(" ".join(w))
    r.shuffle(lines)
    sets = gram_sets(lines)
    n = len(lines)
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    near = [(i, j) for i in range(n) for j in range(i) if min(len(lines[i]), len(lines[j])) >= 24 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for i, j in near:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    want = {k for k in range(n) if top(k) != k}
    got = {x["doc_id"] for x in linedup.dedup_lines(docs(spark, lines)).collect() if x["n_removed"]}
    # nothing goes that no link takes, and at least 0.9 of what all pairs would take
    assert len(near) > 30 and got <= want and len(got) >= 0.9 * len(want)


def test_null_ids_repeats_and_names(spark):
    line = "a line that is long enough to be compared"
    rows = [(None, line), (2, line), (2, line), (None, line), (1, f"{line}\nshort\n{line}"), (None, None), (3, "")]
    d = spark.createDataFrame([(i, t, "x", 1, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row string, _key int, _gone int")
    out = linedup.dedup_lines(d)
    assert out.columns == [*d.columns, "n_lines", "n_removed"]
    got = {r["_gone"]: (r["text"], r["n_removed"], r["_row"], r["_key"]) for r in out.collect()}
    assert got[4] == (f"{line}\nshort", 1, "x", 1)
    assert linedup.dedup_lines(d.where("false")).count() == 0
    assert [got[k][0] for k in (0, 1, 2, 3, 5, 6)] == ["", "", "", "", None, ""]


@pytest.mark.parametrize("hot", [1 << 19, 3])
def test_a_line_of_a_third_of_all_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(storage, "HOT_ROWS", hot)
    monkeypatch.setitem(storage.spread_join.__kwdefaults__, "most", 0)
    monkeypatch.setattr(linedup, "spread_join", lambda *a, **k: storage.spread_join(*a, **{**k, "most": 0}))
    r = random.Random(1)
    own = lambda: " ".join("".join(r.choice("bcdfghk") for _ in range(6)) for _ in range(8))
    texts = [f"{own()}\nthe same long line stands in many documents" if k % 3 == 0 else own() for k in range(90)]
    got = linedup.dedup_lines(docs(spark, texts)).collect()
    assert sum(x["n_removed"] for x in got) == 29 and all(x["n_removed"] <= 1 for x in got)


def test_a_text_of_several_blocks(spark):
    r = np.random.default_rng(2)
    words = [bytes(x).decode() for x in r.integers(97, 123, (3000, 9), dtype=np.uint8)]
    lines = [" ".join(words[k] for k in r.integers(0, 3000, 9)) for _ in range(40_000)]
    big = "\n".join(lines)
    assert len(big) > 3 << 20
    out = {x["doc_id"]: x for x in linedup.dedup_lines(docs(spark, [lines[7], big, lines[0] + "\nend"], [9, 5, 6])).collect()}
    assert out[9]["text"] == "" and out[6]["text"] == "end" and out[5]["n_lines"] == 40_000 and out[5]["n_removed"] == 40_000 - len(set(lines))


def short_brute(texts):
    """Texts without later short lines that are the same but for white space at the ends."""
    seen, out = set(), []
    for text in texts:
        kept = []
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            if any(c.isalnum() for c in key):
                if key in seen:
                    continue
                seen.add(key)
            kept.append(line)
        out.append(None if text is None else "\n".join(kept))
    return out


def test_short_lines_go_only_if_they_are_the_same(spark):
    r = random.Random(6)
    some = ["Share this", " Share this\t", "share this", "Page 1", "Page 2", "---", "", "  ", "é", "é\r", "12", "one\ttwo", "one  two", "🙂 x"]
    texts = ["\n".join(r.choice(some) for _ in range(r.randint(0, 7))) for _ in range(60)] + [None]
    got = {x["doc_id"]: x["text"] for x in linedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == short_brute(texts)


def test_many_lines_in_one_text(spark):
    import time

    lines = [f"{k % 5} and what belongs to it" for k in range(200_000)]
    took = []
    for n in (1, 100_000, 200_000):
        began = time.time()
        out = linedup.dedup_lines(docs(spark, ["\n".join(lines[:n])])).first()
        took.append(time.time() - began)
        # digits are one in normal form
        assert out["n_removed"] == n - 1 and out["text"] == lines[0]
    assert took[2] - took[0] < 4 * (took[1] - took[0]) + 10
