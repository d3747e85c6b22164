import math
import random
import re
from collections import Counter

import pytest
from pixelloom.llm import lexical_search as L

DOCS, ITEMS = "doc_id long, text string, score string, item string", "item_id string, text string, block string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    texts = [(i, words(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(words(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, w in texts:
            if w:
                m, tf = 50 + (50 * len(w) * n_docs) // n_terms, Counter(w)
                scores.append((sum(weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in own if tf[t]), i))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, k=50):
    d = spark.createDataFrame([(*x, "clash", "clash") for x in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    return sorted((tuple(r) for r in L.search(d, q, k).collect()), key=repr)


def corpus(n, seed=7, vocabulary=60):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    share = [1 / (i + 1) for i in range(vocabulary)]
    docs = [(i, " ".join(rng.choices(names, share, k=rng.randint(0, 30)))) for i in range(n)]
    return docs, [(f"q{j}", " ".join(rng.choices(names, k=rng.randint(1, 8)))) for j in range(9)]


@pytest.mark.parametrize("shard", [8192, 50])
def test_ranks_and_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(L, "SHARD", shard)
    docs, items = corpus(700)
    docs += [(1000 + i, docs[5][1]) for i in range(120)]  # more equal scores than places
    docs += [(k, t) for k, t in docs[:20]] + [(None, docs[5][1]), (None, docs[6][1]), (5000, None), (5001, ""), (5002, "!!")]
    assert got(spark, docs, items) == plain(docs, items)


def test_blocks_of_items_rounds_and_unlimited_terms(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS", 2)
    monkeypatch.setattr(L, "SHARD", 16)
    monkeypatch.setattr(L, "MORE", 2)
    monkeypatch.setattr(L, "SENT_TERMS", 3)
    monkeypatch.setattr(L, "BROADCAST_ROWS", 3)
    docs, items = corpus(400, 8)
    assert got(spark, docs, items, 7) == plain(docs, items, 7)


def test_items_of_all_kinds(spark):
    docs = [(1, "Ab_c d1 É"), (2, "ab AB ab"), (3, "é É x"), (4, "q " * 4000 + "ab"), (5, "zz")]
    items = [("a", "AB"), ("a", "c zz"), ("b", None), ("c", ""), ("d", "no such"), (None, "É"), ("e", "ab ab ab"), ("e", "ab ab ab")]
    assert got(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert got(spark, [], [("a", "x")]) == [] and got(spark, [(1, "x")], []) == [] and got(spark, [(1, None)], [("a", "x")]) == []


def test_a_closed_range_is_not_opened():
    import numpy as np

    n = 4000
    value = np.full(n, 5, np.int64)
    value[1700:1760] = np.arange(100, 160)
    shard = L._Shard([np.arange(n)], [value], np.array([3]), n)
    opened = []
    scores = shard.scores
    shard.scores = lambda own, ranges: opened.extend(ranges.tolist()) or scores(own, ranges)
    place, score = shard.best(np.array([0]), 50, 1)
    assert place.tolist() == list(range(1759, 1709, -1)) and score.tolist() == [3 * v for v in range(159, 109, -1)]
    assert len(opened) <= 2 * L.OPENED and shard.best(np.array([0]), 50, 3 * 159 + 1)[0].size == 0
