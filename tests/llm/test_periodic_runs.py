import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pixelloom.llm import periodic_runs as R
from pixelloom.llm import queries
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, runs string"


def plain_runs(words):
    """By the definition: each maximal stretch of each period that is the stretch's least one."""
    n, found = len(words), set()
    for p in range(1, n // 4 + 1):
        k = 0
        while k < n - p:
            if words[k] != words[k + p]:
                k += 1
                continue
            a = k
            while k < n - p and words[k] == words[k + p]:
                k += 1
            s, length = a, k + p - a
            least = next(q for q in range(1, p + 1) if all(words[i] == words[i + q] for i in range(s, s + length - q)))
            if least == p and length >= max(6, 4 * p):
                found.add((s, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def of(texts):
    return [(t, "clash", i) for i, t in enumerate(texts)]


def found(spark, texts):
    rows = R.find_runs(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)).collect()
    return {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows}


def test_runs_are_those_of_the_definition(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "a\xa0a a\x0ba a a\r\na a a A", "x " * 500, "a b " * 300 + "c " * 7, "a a b a a b a a b a a b a a c"]
    for _ in range(150):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * 9)[: rng.randint(4 * len(unit) - 1, 6 * len(unit))]
        texts.append(" ".join(words))
    got = found(spark, texts)
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        runs = plain_runs(words)
        assert got[i] == (len(words), runs, collapsed(words, runs)), t


def test_hashes_that_collide(monkeypatch):
    rng = random.Random(5)
    docs = [np.array([rng.randint(0, 2) for _ in range(n)], np.int64) for n in (0, 5, 90, 200, 31)]
    docs.append(np.array([1, 2, 3, 4] * 12 + [1, 2, 3, 3] * 12, np.int64))
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes) - sizes
    want = [(s + a, s + a + n, p) for s, d in zip(starts.tolist(), docs, strict=True) for a, n, p in plain_runs(d.tolist())]
    for modulus in (2, 3, 7):
        monkeypatch.setattr(R, "MODULUS", np.uint64(modulus))
        assert sorted(map(tuple, R._runs(np.concatenate(docs), starts, sizes).tolist())) == sorted(want)


def test_long_text_in_small_portions_of_pairs(monkeypatch):
    codes = np.array(list(range(3000)) + [7, 8, 9] * 2000 + list(range(500)) + [5] * 3000, np.int64)
    monkeypatch.setattr(R, "PAIRS", 5000)
    got = R._runs(codes, np.array([0]), np.array([len(codes)])).tolist()
    assert got == [[3000, 9000, 3], [9500, 12500, 1]]


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    rows = R.find_runs(spark.createDataFrame([(None, "a " * 9, "x"), (None, "a " * 9, "x"), (1, None, None)], SCHEMA)).collect()
    assert sorted((repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows) == [("1", 0, [], ""), *[("None", 9, [(0, 9, 1)], "a")] * 2]
    assert R.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_strongest(spark):
    runs = [(0, 9, 2), (5, 18, 4), (3, 18, 4), (3, 9, 2), (1, 8, 2)]
    df = spark.createDataFrame([(runs,), ([],)], f"runs array<{R.RUN}>")
    got = [r.b and tuple(r.b) for r in df.select(R.strongest(F.col("runs")).alias("b")).collect()]
    assert got == [(0, 9, 2), None]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, f"/root/testdata/{sf}").collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        elif n > 1000:
            continue  # the plain version takes the square of the words; those with planted runs are all held
        runs = plain_runs(words)
        planted += bool(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert got[d.doc_id] == (*want, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()), d.doc_id
    assert planted > 5
