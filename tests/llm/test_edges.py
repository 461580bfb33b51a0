"""Each operator on null ids, repeated rows, ties, empty tables, long texts and clashing names."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm import decontam, langid, ngramjoin, packing, quality, textkernel, toxicity

VOCAB = ["the", "of", "river", "stone", "wander", "Größe", "café", "it", "under", "blue", "seven", "maps", "x1", "and", "light"]
#: Columns that the operators use as names of their own.
CLASH = "t string, h long, n long, row long, k string, dg long, rank long, label string, score string, lang_pred string, _ki long, _bi long, component_id long, n_words string"
NAMES = [c.split(" ")[0] for c in CLASH.split(", ")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def clashing(spark, rows):
    filler = ["x", 1, 2, 3, "k", 4, 5, "l", "s", "p", 6, 7, 8, "w"]
    return spark.createDataFrame([(i, t, "en", *filler) for i, t in rows], f"doc_id long, text string, lang string, {CLASH}")


def long_text():
    r = np.random.default_rng(4)
    return " ".join(VOCAB[k] for k in r.integers(0, len(VOCAB), 700_000))


ROWS = [(None, prose(1, 40)), (2, prose(2, 30)), (2, prose(2, 30)), (2, prose(3, 30)), (None, prose(1, 40)), (None, None), (5, ""), (5, ""), (6, " \n\t"), (7, "🙂 İ ẞ \x00")]


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [8 << 20, 150])
def test_decontamination(spark, block):
    d = clashing(spark, ROWS)
    items = bench(spark, [(1, prose(1, 25)), (None, prose(2, 20)), (3, prose(9, 20)), (3, prose(9, 20)), (4, None)])
    out = decontam.verdicts(decontam.matches(d, items, block_bytes=block))
    got = Counter((r["doc_id"], r["n_words"], r["contaminated"], r["n_items"]) for r in out.collect())
    assert got == Counter({(None, 40, True, 1): 2, (2, 30, True, 0): 2, (2, 30, False, 0): 1, (None, 0, False, 0): 1, (5, 0, False, 0): 2, (6, 0, False, 0): 1, (7, 3, False, 0): 1})
    left = decontam.decontaminate(d, items, block_bytes=block)
    assert left.columns == d.columns and Counter(r["doc_id"] for r in left.collect()) == Counter([2, None, 5, 5, 6, 7])
    assert decontam.decontaminate(d.where("false"), items).count() == 0 and decontam.decontaminate(d, items.where("false")).count() == len(ROWS)


def test_decontamination_of_long_texts_and_items(spark):
    text = long_text()
    words = text.lower().split()
    item = " ".join(words[1000:6000])
    tests = decontam.TestSet([("1", item), ("2", prose(1, 20))], 13)
    held = sum(x.nbytes for x in vars(tests).values() if isinstance(x, np.ndarray))
    assert held < 100 * len(item.split())
    found = decontam.matches(clashing(spark, [(1, text), (2, item)]), bench(spark, [(1, item), (2, prose(1, 20))])).collect()
    got = {r["doc_id"]: r for r in found}
    assert got[1]["longest"] >= 5000 and got[2]["longest"] == 5000 and got[2]["spans"] == [[0, 5000]]


def test_suffix_ranks():
    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = r.integers(0, 9, 12)
        end = np.repeat(np.cumsum(sizes), sizes)
        words = r.integers(0, 3, sizes.sum()).astype(np.int32)
        rank = decontam._suffix_ranks(words, end)
        suffixes = [tuple(words[k:e]) for k, e in enumerate(end)]
        order = sorted(set(suffixes))
        assert [order.index(s) for s in suffixes] == rank.tolist()


def test_toxicity(spark):
    r = random.Random(5)
    rows, marks = [], []
    for k in range(200):
        bad = k % 4 == 0
        rows.append((k, " ".join([prose(k, r.randint(4, 40)), *(["scum", "moron"] * 2 if bad else [])])))
        marks.append((k, int(bad)))
    # ids that repeat, in both tables, and labels without a document
    rows += [(0, prose(900, 20)), (None, "scum"), (None, None), *[(1, prose(1, 12))] * 30]
    marks += [(0, 1), (0, 0), (1, 0), (5000, 1), (None, 1), (3, None), (4, 7)]
    d = clashing(spark, rows)
    labels = spark.createDataFrame(marks, "doc_id long, label int")
    model = toxicity.learn(d, labels)
    out = toxicity.score(d, model).collect()
    assert len(out) == len(rows) and len({r["score"] for r in out if r["doc_id"] == 1}) <= 2
    again = toxicity.score(clashing(spark, rows).repartition(7), toxicity.learn(clashing(spark, rows).repartition(5), labels.repartition(3))).collect()
    assert sorted((str(x["doc_id"]), x["score"]) for x in out) == sorted((str(x["doc_id"]), x["score"]) for x in again)
    assert toxicity.score(d.where("false"), model).count() == 0
    assert toxicity.learn(d.where("false"), labels) is None and toxicity.learn(d, labels.where("false")) is None
    big = {r["doc_id"]: r for r in toxicity.score(clashing(spark, [(1, long_text()), (2, long_text() + " scum moron scum moron")]), model).collect()}
    assert (big[1]["predicted"], big[2]["predicted"]) == (0, 1)


def test_samples_take_distinct_texts(spark):
    from plinth.llm.sampling import labelled_texts

    rows = [(f"text {k}", "a") for k in range(300)] + [("one page", "a")] * 3000 + [("only", "b")] * 500
    d = spark.createDataFrame(rows, "text string, label string").repartition(6)
    got = labelled_texts(d, 50)
    assert Counter(label for _, label in got) == {"a": 50, "b": 1} and len(set(got)) == 51
    assert got == labelled_texts(d.repartition(3), 50)


def test_language(spark):
    lines = {"en": "the and with which", "de": "und der nicht für", "fr": "les une être dans"}
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(lines[c].split()) for _ in range(12)), c) for k, c in enumerate(list(lines) * 40)]
    rows += [(None, "the and", None), (1, None, "en"), (2, "12 !?", "de"), (2, "12 !?", "de"), (3, "the with which", "en")]
    d = clashing(spark, [(i, t) for i, t, _ in rows]).drop("lang").withColumn("at", langid.F.monotonically_increasing_id())
    told = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(told)
    got = langid.predict(d, model).collect()
    assert len(got) == len(rows) and Counter(r["lang_pred"] for r in got)["und"] == 3
    named = langid.annotate(d, model)
    assert named.columns == [c for c in d.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score"]
    assert sorted((str(x["doc_id"]), x["lang_pred"], x["score"]) for x in named.collect()) == sorted((str(x["doc_id"]), x["lang_pred"], x["score"]) for x in got)
    assert langid.predict(d.where("false"), model).count() == 0
    big = langid.predict(clashing(spark, [(1, (lines["de"] + " ") * 200_000)]), model).first()
    assert big["lang_pred"] == "de"
    # one language, and languages of one family only
    assert langid.predict(d, langid.learn(told.where("lang = 'fr'"))).first()["lang_pred"] == "fr"
    assert langid.predict(told, langid.learn(told.where("lang in ('en', 'de')"))).where("lang_pred = 'fr'").count() == 0


def test_similar_groups(spark):
    d = clashing(spark, ROWS)
    got = Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in ngramjoin.similar_groups(d).collect())
    assert got == Counter({(None, True, None): 2, (2, True, 2): 3, (None, False, None): 1, (5, False, 5): 2, (6, False, 6): 1, (7, True, 7): 1})
    kept = ngramjoin.keep_one(d)
    assert kept.columns == d.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 2, 2, None, 5, 5, 6, 7])
    assert ngramjoin.keep_one(d.where("false")).count() == 0


def test_similar_long_texts(spark):
    text = long_text()
    words = text.split()
    words[5::900] = ["odd"] * len(words[5::900])
    rows = [(3, text), (1, " ".join(words)), (2, text[: len(text) // 2]), (9, "short one")]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.similar_groups(clashing(spark, rows)).collect()}
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split() for _, t in rows[:3])]
    near = lambda a, b: 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])
    assert near(0, 1) and got == {3: 1, 1: 1, 2: 1 if near(0, 2) or near(1, 2) else 2, 9: 9}


def js(p, q):
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt((kl(p) + kl(q)) / 2)


def test_quality_distances(spark):
    # languages whose words are frequent in a fixed order, so that their lists have no ties
    def text(seed, names, n):
        r = np.random.default_rng(seed)
        return " ".join(names[min(len(names) - 1, r.geometric(0.25) - 1)] for _ in range(n))

    one, two = [f"Word{k}," for k in range(12)], [f"слово{k}" for k in range(12)]
    rows = [(k, text(k, one, 200), "xx") for k in range(20)] + [(100 + k, text(k, two, 150), "yy") for k in range(20)]
    rows += [(200, text(1, one, 90) + " " + "$% " * 90, None), (201, prose(3, 100), None), (202, text(5, two, 20), None), (None, text(6, one, 100), None), (None, None, "xx"), (203, "", "yy"), (203, "", "yy")]
    d = spark.createDataFrame([(i, t, c, 1) for i, t, c in rows], "doc_id long, text string, lang string, t int")
    classes = ["a-z", "A-Z", "0-9", " \t", "\n\x0b\x0c\r", ".,;:!?'\"()-"]

    def histogram(t):
        out = np.zeros(8)
        for c in t:
            out[next((k for k, x in enumerate(classes) if re.match(f"[{re.escape(x) if k > 2 else x}]", c)), 6 if c < "\x80" else 7)] += 1
        return out

    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    refs = []
    for lang in ("xx", "yy"):
        texts = [t for _, t, c in rows if c == lang and t is not None]
        h = sum(histogram(t) for t in texts)
        words = Counter(w for t in texts for w in low(t))
        top = [w for w, _ in words.most_common(64)]
        share = [words[w] / words.total() for w in top]
        refs.append((h / h.sum(), top, np.array([*share, max(0, 1 - sum(share))])))
    rules = quality.Rules()
    got = Counter()
    want = Counter()
    for r in quality.quality_table(d).collect():
        got[r["doc_id"], None if r["class_distance"] is None else (round(r["class_distance"], 9), round(r["word_distance"], 9)), r["kept"]] += 1
    for i, t, _ in rows:
        w = (t or "").split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        near, kept = None, not failed
        if len(w) >= rules.min_words and sum(map(len, w)) >= rules.min_chars:
            h, mine = histogram(t), Counter(low(t))
            found = []
            for share, top, words in refs:
                q = np.array([mine[x] for x in top] + [mine.total() - sum(mine[x] for x in top)]) / mine.total()
                found.append((js(h / h.sum(), share), js(q, words)))
            best = min(found, key=sum)
            near, kept = tuple(round(x, 9) for x in best), kept and best[0] <= rules.max_class and best[1] <= rules.max_word
        want[i, near, kept] += 1
    assert got == want and any(k[1] is None for k in want) and len({k[2] for k in want}) == 2


def test_quality_of_odd_rows(spark):
    d = clashing(spark, [*ROWS, (8, long_text())])
    got = quality.quality_table(d).collect()
    assert len(got) == len(ROWS) + 1 and {r["n_words"] for r in got if r["doc_id"] == 8} == {700_000}
    assert quality.quality_table(d.withColumn("lang", quality.F.lit(None).cast("string"))).where("class_distance is not null").count() == 0


def test_packing(spark):
    d = clashing(spark, [*ROWS, (8, long_text()[:2_200_000])])
    rows = packing.pack(d).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter([*(i for i, _ in ROWS), 8])
    seats = Counter()
    for r in rows:
        seats.update((r["sequence_id"], r["offset"] + k) for k in (0, r["length"] - 1) if k or r["length"] == 1)
    assert max(Counter((r["sequence_id"], r["offset"]) for r in rows).values()) == 1
    assert packing.pack(d.where("false")).count() == 0


def test_packing_of_ties_and_hot_sizes(spark):
    # thousands of documents of one size
    d = spark.createDataFrame([(k, "a b c d") for k in range(3000)] + [(k, "a") for k in range(500)], "doc_id long, text string")
    rows = packing.pack(d).collect()
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    total = sum(used.values())
    assert len(rows) == 3500 and max(used.values()) <= 1024 and len(used) <= 1.01 * -(-total // 1024) + 1


@pytest.mark.parametrize("name", ["sf0.001"])
def test_token_ids_are_the_tokenizers(name):
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '/root/testdata/{name}/documents.parquet'").fetchall()]
    r = random.Random(2)
    scripts = ["abc XYZ", "äöüßéñ", "абвгд", "日本語の文章", "العربية", "हिन्दी", "🙂👩‍👩‍👧", "'s 've I'LL", "  \t\n\r\n ", "０１２ Ⅷ ½", "é̈", "​﻿\x00\x85"]
    texts += ["".join(r.choice("".join(scripts) + " " * 9) for _ in range(r.randint(0, 300))) for _ in range(400)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <| endoftext", " " * 500, "a" * 5000]
    encoder = packing._Encoder.of("byte_bpe_50k")
    marks = [*" \n\t\r\x0b'sdtrelvm.,!?<|>aZ09éß中🙂\xa0\x1c-", "  ", "<|endoftext|>", "'ll", ". ", "\u2003"]
    texts += ["".join(r.choice(marks) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    assert len(texts) > 500 and all(encoder.ids(t).tolist() == x.ids for t, x in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True))


KINDS = [
    lambda r: r.randint(1, 1024),
    lambda r: min(1024, 1 + int(r.expovariate(1 / 250))),
    lambda r: r.choice([1024, 512, 341, 100, 17]),
    lambda r: r.randint(300, 700),
    lambda r: r.choice([1024, 1024, 600, r.randint(1, 1024)]),
    lambda r: 5,
]


@pytest.mark.parametrize("kind", range(len(KINDS)))
@pytest.mark.parametrize("n", [1, 40, 20_000])
def test_plans_are_whole_and_near_the_bound(kind, n):
    r = random.Random(100 * kind + n)
    sizes = Counter(KINDS[kind](r) for _ in range(n))
    runs = packing.plan(dict(sizes))
    held = Counter()
    for run in runs:
        assert sum(run.sizes) <= 1024 and run.count > 0
        for s in run.sizes:
            held[s] += run.count
    assert held == sizes
    # sizes over half a sequence can't share one, nor can three of more than a third
    bound = max(-(-sum(s * c for s, c in sizes.items()) // 1024), sum(c for s, c in sizes.items() if s > 512))
    assert sum(run.count for run in runs) <= 1.01 * max(bound, -(-sum(c for s, c in sizes.items() if s > 341) // 2)) + 2


def fewest(sizes, capacity):
    """The least number of sequences, by trying all ways."""
    best = [len(sizes)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[k]}:
            at = rooms.index(room)
            put(k + 1, [*rooms[:at], room - sizes[k], *rooms[at + 1 :]])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best[0]


def test_small_plans_are_optimal():
    r = random.Random(8)
    over = 0
    for k in range(150):
        capacity = r.choice([16, 64, 1024])
        sizes = sorted((r.randint(max(1, capacity // r.choice([3, 6, 12])), capacity) for _ in range(r.randint(0, 9))), reverse=True)
        over += sum(x.count for x in packing.plan(dict(Counter(sizes)), capacity)) - fewest(sizes, capacity)
    # now and then one sequence more
    assert over <= 3


def test_plans_come_from_their_configurations():
    r = random.Random(5)
    sizes = Counter(r.randint(128, 1023) for _ in range(20_000))
    runs, left = packing.grouped(dict(sizes), 1024)
    held = Counter(left)
    for run in runs:
        for s in run.sizes:
            held[s] += run.count
    assert held == sizes and sum(left.values()) <= 0.01 * 20_000
    whole = Counter({r.sizes: r.count for r in packing.plan(dict(sizes))})
    kept = sum(min(whole[tuple(sorted(r.sizes, reverse=True))], r.count) for r in runs)
    assert kept >= 0.9 * sum(whole.values())


def test_textkernel_blocks():
    import pyarrow as pa

    text = long_text()
    parts = list(textkernel.blocks(pa.array([None, "a", text, "", "b"])))
    assert [(s.start, s.stop) for s, _ in parts] == [(0, 2), (2, 3), (3, 5)]
    assert parts[1][1].part(0, 20).decode() == text.encode()[:20].decode()


def test_toxicity_cut():
    margin, label = np.array([-3.0, -1.0, 0.5, 1.0, 2.0]), np.array([0, 0, 1, 0, 1])
    assert toxicity._best_cut(margin, label) == -0.25
    assert toxicity._best_cut(np.array([1.0, 2.0]), np.array([1, 1])) == 1.0
    assert toxicity._best_cut(np.array([0.0, 4.0]), np.array([0, 1])) == 2.0
    # the cut scores the threshold, in a small sample too
    words = [f"w{k}" for k in range(40)]
    r = random.Random(3)
    texts = [" ".join(r.choice(words) for _ in range(20)) + (" vilethug" if k % 5 == 0 else "") for k in range(120)]
    model = toxicity.train(texts, np.array([int(k % 5 == 0) for k in range(120)]), toxicity.Settings())
    score = model.score(textkernel.Texts.of([*texts, words[3] + " vilethugs", words[4] + " " + words[5]]))
    hit = score >= 0.7
    assert (hit[:120] == (np.arange(120) % 5 == 0)).mean() > 0.97 and hit[120] and not hit[121]


@pytest.mark.parametrize(("block", "grams"), [(2_000, 60), (3, 8_000_000)])
def test_ngram_join_in_small_blocks(spark, monkeypatch, block, grams):
    monkeypatch.setitem(ngramjoin.class_links.__kwdefaults__, "block", block)
    monkeypatch.setitem(ngramjoin.class_links.__kwdefaults__, "block_grams", grams)
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        words[r.randrange(60)] = f"x{r.randrange(9)}"
        texts.append(" ".join(words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in ngramjoin.similar_groups(d, size=4, percent=85).collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(57)} for t in texts]
    want = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert [got[k] for k in range(40)] == want


def near_copies(count, size, changed):
    """Segments of near copies, as one fragment that holds all their n-grams: ``size`` n-grams,
    of which each copy lacks up to ``changed``, and has others that two copies have."""
    r = random.Random(5)
    held = [set(range(size)) - set(r.sample(range(size), r.randint(0, changed))) for _ in range(count)]
    for k, one in enumerate(held):
        one |= {size + k // 2, size + count + r.randrange(count)}
    often = Counter(h for one in held for h in one)
    held = [sorted((h for h in one if often[h] > 1), key=lambda h: (often[h], h)) for one in held]
    n = [len(one) for one in held]
    lead = [k - -(-85 * k // 100) + 1 for k in n]
    return held, {"block": pa.array([0] * count, pa.int32()), "dg": pa.array(range(count), pa.int64()), "n": pa.array(n, pa.int64()), "r": pa.array(n, pa.int64()), "lead": pa.array(lead, pa.int64()), "seg": pa.array(held, pa.list_(pa.int64()))}


def linked_to(pairs, count):
    root = list(range(count))
    for _ in range(count):
        before = list(root)
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
        if root == before:
            break
    return root


@pytest.mark.parametrize("blocks", [1, 2])
def test_fragment_of_near_copies(blocks):
    count = 300
    held, frame = near_copies(count, 120, 16)
    block = [k % blocks for k in range(count)]
    got = ngramjoin.settle(pa.table(frame | {"block": pa.array(block, pa.int32())}), 85).to_pylist()
    sets = [set(one) for one in held]
    links = [(x, y) for x in range(count) for y in range(x) if (blocks == 1 or block[x] != block[y]) and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])]
    assert 0 < len(links) < count * (count - 1) // 4 and len(set(linked_to(links, count))) > 1
    assert all(p["sure"] and p["x"] < p["y"] for p in got) and linked_to([(p["x"], p["y"]) for p in got], count) == linked_to(links, count)
    assert ngramjoin.settle(pa.table(frame).slice(0, 0), 85).num_rows == 0


def test_fragment_of_many_near_copies_takes_no_time_of_all_pairs():
    _, frame = near_copies(4_000, 300, 40)
    began = time.process_time()
    assert ngramjoin.settle(pa.table(frame), 85).num_rows
    assert time.process_time() - began < 20


def test_blocks_of_a_fragment_go_to_tasks_of_their_own(spark, monkeypatch):
    plans, store = {}, ngramjoin.materialize
    monkeypatch.setattr(ngramjoin, "materialize", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), store(df, name))[1])
    monkeypatch.setitem(ngramjoin.class_links.__kwdefaults__, "block", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [f"w{k}" for k in range(60)]
        d = spark.createDataFrame([(k, " ".join([*words[:k], "x", *words[k:]])) for k in range(20)], "doc_id long, text string")
        assert {x["component_id"] for x in ngramjoin.similar_groups(d, size=4, percent=85).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(part#\d+L?, lo#\d+, hi#\d+", plans["join-found"])


def test_fragments_hold_as_much_each():
    # most n-grams are near few classes, whose steps are the first
    cuts = ngramjoin._cuts([(-32768 + k, 1000 if k < 10 else 1) for k in range(500)][::-1], 1000).to_pylist()
    assert [c["part"] for c in cuts[:11]] == [*range(10), 10] and max(c["part"] for c in cuts) == 10


def test_groups_cut_by_fragments_are_summed_with_few_first(spark, monkeypatch):
    # near copies of which half the n-grams lie in each of two fragments: no pair is settled in one
    counts, store = {}, ngramjoin.materialize

    def noted(df, name):
        stored = store(df, name)
        counts[name] = stored.count()
        return stored

    monkeypatch.setattr(ngramjoin, "materialize", noted)
    count = 120
    held, _ = near_copies(count, 120, 16)
    segs = spark.createDataFrame([(part, x, len(one), [h for h in one if h % 2 == part]) for x, one in enumerate(held) for part in range(2)], "part long, dg long, n long, seg array<long>")
    found = spark.createDataFrame([(y, x, False) for x in range(count) for y in range(x)], "x long, y long, sure boolean")
    sets = [set(one) for one in held]
    links = [(x, y) for x in range(count) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])]
    for few in (0, 1_000_000):
        got = [tuple(p) for p in ngramjoin._whole(found, segs, 85, few).collect()]
        assert {(y, x) for x, y in links} >= set(got) and linked_to(got, count) == linked_to(links, count)
        assert few or len(got) < len(links) / 2
    assert counts["join-pairs"] == count * (count - 1) // 2 and counts["join-links"] <= count * ngramjoin._HUBS
