import zlib

import numpy as np
from pixelloom.llm import quality as Q


def test_fixed_cases(spark):
    good = [(i, f"The quiet river number {i} runs along the old valley and turns.", 1) for i in range(80)]
    bad = [(100 + i, f"BUY!! BUY!! {i}$$$ now### now### now###", 0) for i in range(30)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in good + bad] + [(500, None, 0.1), (501, "", 0.1), (502, "x" * 200_000, 0.1), (None, "The quiet river", 0.1), (3, good[3][1], 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    used = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, *_ in good + bad)
    assert used <= len(model.labels) <= used + 1  # a repeated row may count twice
    out = Q.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == docs.count()
    got = {(r.doc_id, r.text): r.score for r in out.collect()}
    assert all((got[i, t] >= 0.7) == (q == 1) for i, t, q in good + bad)
    assert got[500, None] == got[501, ""] and all(0 <= s <= 1 for s in got.values())
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(80)) and not {r.doc_id for r in kept.collect()} & set(range(100, 130))


def plain_features(text):
    """The counts by dictionaries and plain integers."""
    raw = f" {text} ".encode()
    cls = [ord("a") if b >= 128 or 97 <= b <= 122 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in raw]
    out = np.zeros(Q.WIDTH)
    for i in range(len(raw) - 2):
        out[((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 21] += 1
    for i in range(len(cls) - 3):
        out[Q.HALF + (((cls[i] << 24 ^ cls[i + 1] << 16 ^ cls[i + 2] << 8 ^ cls[i + 3]) * 2654435761 & 0xFFFFFFFF) >> 21)] += 1
    out[:-1] = np.log1p(out[:-1])
    w = text.split()
    out[-1] = 1.5 * sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(1, len(w) - 1) * np.linalg.norm(out[:-1])
    return out


def test_features_against_plain_python():
    for t in ["", "a", "ab", "The river the river runs 12 miles", "Äpfel und Öl\n\t!!", "x" * 3000, "word word " * 50]:
        assert np.allclose(Q.features(t), plain_features(t), rtol=1e-5, atol=1e-5), t


def test_blocked_products_are_exact():
    """Each row's votes against products and a full sort in double precision; rows with a tie at the rim are told and left out."""
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abcdefghij!0 "), 6)) for _ in range(int(n))) for n in rng.integers(3, 40, 300)]
    x = np.stack([Q.features(t) for t in texts])
    labels = (np.arange(len(x)) % 3 == 0).astype(np.float32)
    model = Q.Model(np.ones(Q.WIDTH, np.float32), Q._basis(x, 16), np.zeros((0, 1)), labels, np.ones(len(x), np.float32), 0.5)
    model.neighbours = model.vectors(x)
    fast, v, compared = model.scores(x), model.vectors(x).astype(np.float64), 0
    for i in range(len(x)):
        c = v @ v[i]
        order = np.argsort(-c, kind="stable")
        if c[order[Q.NEIGHBOURS - 1]] - c[order[Q.NEIGHBOURS]] > 1e-6:
            near = order[: Q.NEIGHBOURS]
            w = np.maximum(c[near], 0) ** 8
            assert abs(fast[i] - (w * labels[near]).sum() / w.sum()) < 1e-4
            compared += 1
    assert compared > 280


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = Q.score(docs.join(labels.select("doc_id", "quality"), "doc_id").filter(Q.is_held_out(docs["doc_id"])), Q.fit(docs, labels))
    rows = scored.select("score", "quality").collect()
    assert len(rows) > 500 and np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) > 0.98
    assert min(r.score for r in rows if r.quality == 1) >= 0.5


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, Q.fit(docs, none)).collect()} == {0.5}
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), none)).count() == 0


def test_an_id_of_many_rows_does_not_fill_the_sample(spark):
    docs = [(i, f"The quiet river number {i} runs along the old valley.", "s") for i in range(300)] + [(1000 + i, f"BUY!! {i}$$$ now### now###", "s") for i in range(300)]
    docs += [(7, docs[7][1], "s")] * 5000 + [(9, f"row {i} of one id", "s") for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in docs[:600]], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = Q.fit(df, labels, sample=200)
    assert (model.labels == 1).sum() == 100 and (model.labels == 0).sum() == 100
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns and {r.score for r in kept.collect()} == {"s"}
