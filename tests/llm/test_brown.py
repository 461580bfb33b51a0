"""Class-based scores against brute force, and against the unigram model on held-out texts."""

import re
from collections import Counter

import numpy as np
import pytest

from plinth.llm import brownlm, textkernel

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def key(word):
    t = textkernel.Texts.of([word])
    return int(t.hashes(t.offsets[:-1], t.offsets[1:])[0])


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", 1.0) for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, lang string, score double")


def language(seed, n):
    """Sentences of a language whose words follow each other by kind."""
    r = np.random.default_rng(seed)
    kinds = [[f"{stem}{end}" for stem in ("bal", "kor", "mun", "tiv", "sél", "нор", "gam", "rel", "dos", "pux")] for end in ("o", "ita", "emus", "ю", "an")]
    return [" ".join(kinds[k % 5][min(9, r.geometric(0.3) - 1)] for k in range(r.integers(5, 60))) for _ in range(n)]


@pytest.mark.parametrize("settings", [brownlm.Settings(words=8, endings=4, classes=5, known=6), brownlm.Settings(words=6, endings=3, classes=6, known=20), brownlm.Settings()])
def test_scores_follow_the_definition(spark, settings):
    texts = [None, "", " \n", "One oNe ONE", "日本語 日本語。", *language(1, 60), *language(2, 10)]
    d = docs(spark, texts)
    train = [t for k, t in enumerate(texts) if k % 3]
    model, counts = brownlm.fit(d.where("doc_id % 3 != 0").select("text"), settings)
    tokens = [[*SPACE.findall(low(t)), None] for t in texts]
    c = Counter(w for k, t in enumerate(tokens) if k % 3 for w in t)
    n, v = sum(c.values()), len(c)
    known = {int(k): int(x) for k, x in zip(model.classes.keys, model.classes.own)}
    items = model.classes.items
    words = {int(k): 2 + x for x, k in enumerate(items.words)}
    endings = {int(k): 2 + len(items.words) + x for x, k in enumerate(items.endings)}

    def cls(word):
        if word is None:
            return 0
        mine = key(word)
        if mine in known:
            return known[mine]
        item = words.get(mine) or endings.get(key(word[-settings.tail :]) | 1) or 1
        return int(model.classes.cls[item])

    kinds = [[cls(w) for w in t] for t in tokens]
    size, k = Counter(), model.classes.count
    table = np.zeros((k, k))
    for x, t in enumerate(kinds):
        if x % 3:
            for a, b in zip([0, *t], t):
                table[a, b] += 1
    for w in c:
        size[cls(w)] += 1
    total = table.sum(0)
    unigram = (total + 1) / (total.sum() + k)
    got = {r["doc_id"]: r for r in brownlm.score(d, model, counts).collect()}
    for x, t in enumerate(tokens):
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)
        own = 0.0
        for w, a, b in zip(t, [0, *kinds[x]], kinds[x]):
            own += np.log10((table[a, b] + settings.fade * unigram[b]) / (table[a].sum() + settings.fade))
            own += np.log10((c[w] + 1) / (total[b] + size[b] + (b != 0)))
        assert (got[x]["n_tokens"], got[x]["n_known"], got[x]["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert got[x]["base_score"] == pytest.approx(base, rel=1e-9) and got[x]["score"] == pytest.approx(own, rel=1e-9)
        assert got[x]["perplexity"] == pytest.approx(10 ** (-own / len(t)), rel=1e-6)
    assert len(train) and 0 not in model.classes.own


def test_classes_beat_the_unigram_model_on_held_out_texts(spark):
    train, held = language(3, 300), language(4, 60)
    model, counts = brownlm.fit(docs(spark, train).select("text"), brownlm.Settings(words=20, endings=5, classes=7))
    rows = brownlm.score(docs(spark, held), model, counts).collect()
    n = sum(r["n_tokens"] for r in rows)
    own, base = (10 ** (-sum(r[x] for r in rows) / n) for x in ("score", "base_score"))
    assert own < 0.4 * base
    # words that were not clustered took the class of their kind
    by_end = {}
    for w in {w for t in train for w in t.split()}:
        at = np.searchsorted(model.classes.keys, np.uint64(key(w)))
        by_end.setdefault(w[-1], Counter())[int(model.classes.own[at])] += 1
    assert sum(c.most_common(1)[0][1] for c in by_end.values()) >= 0.8 * sum(c.total() for c in by_end.values())


def test_many_words_of_one_count(spark):
    # more words share a count than may be known; the list is filled all the same
    texts = [" ".join(f"w{k}" for k in range(b * 100, b * 100 + 100)) for b in range(30)]
    top = brownlm.frequent_words(brownlm.word_counts(docs(spark, texts).select("text"), brownlm.Settings()).where("key != 0"), 1000)
    assert 800 <= len(top) <= 1000
    model, _ = brownlm.fit(docs(spark, texts).select("text"), brownlm.Settings(words=50, endings=5, classes=4, known=1000))
    assert len(model.classes.keys) == len(top)


def test_odd_tables(spark):
    texts = ["a b", None, "a b", ""]
    d = docs(spark, texts, [None, None, 1, 1])
    model, counts = brownlm.fit(d.select("text"))
    rows = brownlm.score(d, model, counts).collect()
    assert len(rows) == 4 and all(np.isfinite(r["score"]) for r in rows)
    empty = d.where("false")
    model, counts = brownlm.fit(empty.select("text"))
    assert brownlm.score(empty, model, counts).count() == 0
    one = brownlm.score(docs(spark, ["x y"]), model, counts).first()
    assert (one["n_tokens"], one["n_known"], one["train_tokens"]) == (3, 0, 0) and np.isfinite(one["score"])


def test_a_text_of_several_blocks(spark):
    text = " ".join(language(5, 1)[0] for _ in range(9000))
    text = text * (1 + (3 << 20) // len(text))
    d = docs(spark, [text, "balo"])
    model, counts = brownlm.fit(d.select("text"))
    got = {r["doc_id"]: r for r in brownlm.score(d, model, counts).collect()}
    assert got[0]["n_tokens"] == len(text.split()) + 1 == got[0]["n_known"] + (got[0]["n_tokens"] - got[0]["n_known"])


def test_lookup_finds_what_a_search_finds():
    r = np.random.default_rng(8)
    for n in (0, 1, 2, 700, 50_000):
        keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        asked = np.concatenate([r.integers(0, 2**64, 2000, dtype=np.uint64), keys[:: max(1, n // 500)], np.array([0, 2**64 - 1], np.uint64)])
        place, there = textkernel.Lookup(keys).find(asked)
        want, has = textkernel.member(asked, keys)
        assert (there == has).all() and (place[has] == want[has]).all()
