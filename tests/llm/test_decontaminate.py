import re

import pytest
from pixelloom.llm import decontaminate as D


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def plain(docs, items):
    grams = {}
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if own := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return out


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (10, LONG), (2, "only Three words"), (3, ""), (4, None), (5, "!!! ..."), (6, "Äpfel öl"), (7, "a b a b a b a b a b a b a"), (None, "ghost item")]
DOCS = [
    (0, "x y " + LONG.upper() + " z"), (1, LONG.replace(" ", "--\n")), (2, None), (3, ""), (4, " ".join(LONG.split()[:9])), (5, "ONLY, three; words! only three words"),
    (6, "Äpfel-öl"), (6, "another text of the same id " + LONG), (7, "a b " * 3000), (8, "ghost item"), (None, LONG), (0, "x y " + LONG.upper() + " z"), (9, "äpfel öl"),
]


def frames(spark, docs=DOCS, items=ITEMS):
    return (
        spark.createDataFrame([(a, b, "c", 5) for a, b in docs], "doc_id long, text string, items string, n_chars long"),
        spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int"),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_plain_python(spark):
    docs, items = frames(spark)
    assert rows(D.contamination(docs, items)) == sorted(plain(DOCS, ITEMS), key=repr)


def test_large_benchmarks_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    docs, items = frames(spark)
    assert rows(D.contamination(docs, items)) == sorted(plain(DOCS, ITEMS), key=repr)


@pytest.mark.parametrize("bits", [(16, 27), (6, 6)])
def test_the_bit_map_lets_all_windows_through(spark, monkeypatch, bits):
    """Whatever its size: with 64 bits nearly all others pass too, and the texts decide."""
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(D, "MAP_BITS", bits)
    docs, items = frames(spark)
    assert rows(D.contamination(docs, items)) == sorted(plain(DOCS, ITEMS), key=repr)
    grams = D.item_windows(items)
    n = bits[0]
    marked = grams.withColumn("map", D._bit_map(grams, n).scalar()).filter(D._is_set(D.F.col("map"), D.F.col("hash"), n, 0) & D._is_set(D.F.col("map"), D.F.col("hash"), n, 32))
    assert marked.count() == grams.count() > 20
    others = spark.range(4000).selectExpr("xxhash64(id) AS hash").withColumn("map", D._bit_map(grams, 16).scalar())
    assert others.filter(D._is_set(D.F.col("map"), D.F.col("hash"), 16, 0)).count() < 40


def test_removal(spark):
    docs, items = frames(spark)
    clean = [(d, t) for (d, t), p in zip(DOCS, plain(DOCS, ITEMS), strict=True) if not p[4]]
    kept = D.remove_documents(docs, items)
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    cut = [(r.doc_id, r.text, r.n_chars) for r in D.remove_spans(docs, items).collect()]
    assert len(cut) == len(DOCS) and (0, "x y z", 5) in cut and (2, None, 5) in cut and (9, "äpfel öl", 5) in cut
    assert not any(p[2] for p in plain([(d, t) for d, t, _ in cut], ITEMS[:1]))


def test_empty_sides(spark):
    docs, items = frames(spark)
    none, no_items = docs.limit(0), items.limit(0)
    assert D.contamination(none, items).count() == 0
    got = D.contamination(docs, no_items).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated for r in got)
    assert D.remove_documents(docs, no_items).count() == len(DOCS)
