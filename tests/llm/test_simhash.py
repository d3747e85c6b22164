import numpy as np
import pytest
import xxhash
from pixelloom.llm import simhash as S


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_fingerprint_of(t, n):
    w = t.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) > len(hashes) / 2)


def plain_components(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(set(fps))
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fs}


def near(rng, n, centres, flips):
    """Fingerprints round a few centres, some of them far from all others."""
    out = []
    base = [int(x) for x in rng.integers(0, 2**63, centres)]
    for _ in range(n):
        f = base[rng.integers(centres)]
        for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
            f ^= 1 << int(b)
        out.append(f)
    return out


TEXTS = [None, "", " \n", "one", "One", "one two three", "A b\x0bc d E", "é É a b c", "a\xa0b c d e", "word " * 20_000, "the quick brown fox jumps over the lazy dog " * 3]


def test_fingerprints(spark):
    assert [S.fingerprint(t) for t in TEXTS] == [plain_fingerprint(t) for t in TEXTS]
    # Spark's own hash has the same value for a text of one shingle
    assert spark.sql("SELECT xxhash64('a b c d') AS h").first().h & (2**64 - 1) == S.fingerprint("A b c D")


def groups(pairs, nodes):
    """Sorted classes of nodes under the links."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(sorted(x for x in nodes if find(x) == r) for r in {find(x) for x in nodes})


def plain_groups(fps, radius):
    return groups([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= radius], fps)


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 8])
@pytest.mark.parametrize("seed,n,centres,flips", [(0, 40, 3, 6), (1, 300, 2, 5), (2, 400, 60, 9), (3, 9, 1, 8), (4, 64, 1, 4), (5, 65, 1, 4)])
def test_cells_find_all_links(seed, n, centres, flips, radius):
    rng = np.random.default_rng(seed)
    fps = np.array(sorted(set(near(rng, n, centres, flips))), np.uint64).view(np.int64)
    a, b = S._forest(fps, np.array([0]), np.array([len(fps)]), radius)
    want = plain_groups(fps.tolist(), radius)
    assert groups(zip(fps[a].tolist(), fps[b].tolist(), strict=True), fps.tolist()) == want
    assert len(a) == len(fps) - len(want) and (np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64)) <= radius).all()


def test_many_cells_at_once():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 90, 200)
    cells = [np.array(sorted(set(near(rng, int(n), 2, 5))), np.uint64).view(np.int64) for n in sizes]
    sizes = np.array([len(c) for c in cells])
    fps, starts = np.concatenate(cells), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    a, b = S._forest(fps, starts, sizes, 4)
    for c, first in zip(cells, starts, strict=True):
        own = (a >= first) & (a < first + len(c))
        assert groups(zip(fps[a[own]].tolist(), fps[b[own]].tolist(), strict=True), c.tolist()) == plain_groups(c.tolist(), 4)


@pytest.mark.parametrize("radius,blocks,part", [(4, 6, 8), (4, 6, 2048), (8, 10, 2048)])
def test_links_and_components(spark, radius, blocks, part):
    rng = np.random.default_rng(7)
    fps = np.array(sorted(set(near(rng, 400, 12, 9)) | {0, 1, 2**64 - 1}), np.uint64).view(np.int64).tolist()
    edges = S.links(spark.createDataFrame([(f, f) for f in fps], "node long, fp long"), radius, blocks, part)
    found = [(r.node, r.root) for r in S.components(edges).collect()]
    assert groups(found, fps) == plain_groups(fps, radius)


def test_similar_documents(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    texts = [" ".join(rng.choice(vocabulary, 200)) for _ in range(12)]
    docs = list(texts)
    for t in texts[:6]:
        for edits in (1, 2, 30):
            w = t.split()
            for i in rng.choice(len(w), edits, replace=False):
                w[i] = f"new{i}"
            docs.append(" ".join(w))
    docs += [texts[7].upper() + " \n", "", None, "two words", "Two  words", "tiny"]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in docs]
    want = groups([(i, j) for i in range(len(docs)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8], list(range(len(docs))))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, node int")
    got = {r.doc_id: r.component_id for r in S.similar_documents(df).collect()}
    assert got == {d: g[0] for g in want for d in g}
    assert sorted(r.doc_id for r in S.remove_near_duplicates(df).collect()) == [g[0] for g in want]


def test_links_beside_the_forest(spark):
    """Similar texts whose fingerprints are farther apart than those of other texts: each pair within the radius counts."""
    rng = np.random.default_rng(5)
    parts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 12)) for _ in range(12)]
    texts = list(dict.fromkeys(" ".join(parts[i] for i in rng.choice(12, 3)) for _ in range(40)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    fps = [plain_fingerprint_of(t, 2) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 26]
    alike = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.3 * len(sets[i] | sets[j])]
    want = groups(alike, list(range(len(texts))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_documents(df, 0.3, radius=26, blocks=28).collect()}
    assert 1 < len(want) < len(texts) and len(alike) < len(pairs)
    assert got == {d: g[0] for g in want for d in g}


@pytest.mark.parametrize("part", [8, 64, 8192])
def test_prefix_pairs(spark, part):
    """Every pair of different labels of the similarity comes out, and no pair of one label, whatever the parts."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 40)
    sets = [np.unique(np.concatenate((rng.choice(base, 36, replace=False), rng.integers(-(2**62), 2**62, 4)))) for _ in range(150)]
    label = [0 if i < 90 else i // 2 * 2 for i in range(len(sets))]
    rows = [(i, x, len(t), S._folded(S._sketch(t)).tolist(), S._prefix(t, np.zeros(0, np.int64), np.zeros(0, np.int64), 0.7).tolist()) for i, (x, t) in enumerate(zip(label, sets, strict=True))]
    nodes = spark.createDataFrame(rows, "node long, label long, size long, short array<long>, prefix array<long>")
    cells = S.prefix_cells(nodes)
    got = [(r.a, r.b) for r in S.prefix_pairs(cells, nodes, 0.7, part=part).collect()]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if label[i] != label[j] and len({*sets[i]} & {*sets[j]}) >= 0.7 * len({*sets[i]} | {*sets[j]})}
    assert len(alike) > 100 and alike <= {*got} and len(got) == len({*got}) and all(label[a] != label[b] and a < b for a, b in got)
    some = [(r.a, r.b) for r in S.prefix_pairs(cells, nodes, 0.7, True, part).collect()]
    assert 0 < len(some) < len(got) and {*some} <= {*got} and {x for p in alike for x in p} <= {x for p in some for x in p}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for n, m, common in ((0, 0, 0), (1, 1, 1), (300, 280, 250), (5000, 200, 100), (4000, 4000, 0), (4096, 4097, 4000)):
        all_ = rng.integers(-(2**62), 2**62, n + m - common)
        a, b = np.unique(all_[:n]), np.unique(all_[n - common :])
        assert S._difference(S._sketch(a), S._sketch(b)) <= len(np.setxor1d(a, b)) and (S._folded(S._sketch(a)) == S._folded(S._folded(S._sketch(a), min(8, len(S._sketch(a)))))).all()
    assert S._difference(S._sketch(a[:2000]), S._sketch(b[2000:4000])) > 0.222 * 2000 * 1.1  # enough to tell unrelated sets


@pytest.mark.parametrize("n,blocks", [(0, 6), (10**6, 6), (10**9, 6), (5 * 10**9, 7), (10**12, 8)])
def test_number_of_blocks(n, blocks):
    assert S.blocks_for(n) == blocks


def test_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b")
    got = S.components(edges).collect()
    assert len(got) == 299 and {r.root for r in got} == {0}
    pairs = spark.range(0, 40, 2).selectExpr("id AS a", "id + 1 AS b")
    tree = S.joined_components(S.components(pairs), spark.createDataFrame([(1, 7), (6, 13), (30, 35), (100, 30), (100, 101)], "a long, b long"))
    want = groups([(i, i + 1) for i in range(0, 40, 2)] + [(1, 7), (6, 13), (30, 35), (100, 30), (100, 101)], [*range(40), 100, 101])
    assert sorted((r.node, r.root) for r in tree.collect()) == sorted((x, g[0]) for g in want for x in g[1:])


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [*TEXTS, long, long + " tail", long.upper(), "Something else entirely, of no kin", None]
    rows = [(i + 3, t, 1, 2) for i, t in enumerate(texts)] + [(None, long, 1, 2), (4, "", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id int")
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    root = plain_components(fps)
    least = {}
    for (d, *_), f in zip(rows, fps, strict=True):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    want = [(d, f, least[root[f]]) for (d, *_), f in zip(rows, fps, strict=True)]
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = S.remove_near_duplicates(docs)
    assert kept.columns == docs.columns and {3, 6, 8} <= {r.doc_id for r in kept.collect()} and not any(r.doc_id is None for r in kept.collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(none).count() == 0 and S.similar_documents(none).count() == 0


def test_similar_beyond_the_radius(spark, monkeypatch):
    """Passages appended and words changed: pairs of a similarity of 0.8 or more count, however far apart their fingerprints are."""
    monkeypatch.setattr(S.prefix_pairs, "__defaults__", (False, 8))
    rng, weight = np.random.default_rng(2), 1 / np.arange(1, 5001)
    draw = lambda n: [f"w{x}" for x in rng.choice(5000, n, p=weight / weight.sum())]
    hot, texts = draw(60), []
    for i in range(150):
        base = draw(int(rng.integers(60, 300)))
        texts.append(" ".join(base))
        texts.append(" ".join(base + draw(int(len(base) * rng.uniform(0.1, 0.25))) if i % 2 else [f"new{i}" if rng.random() < 0.02 else w for w in base]))
        if i % 5 == 0:
            texts += [" ".join(hot + draw(30)), " ".join(draw(3))]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    fps = [plain_fingerprint_of(t, 2) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [(i, j) for i, j in alike if (fps[i] ^ fps[j]).bit_count() > S.RADIUS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_documents(df).collect()}
    print(f"{len(far)} of {len(alike)} similar pairs are beyond the radius")
    assert len(far) > 20 and got == {d: g[0] for g in groups(alike, list(range(len(texts)))) for d in g}


def test_removal_by_id_and_text(spark):
    """Null and repeated ids: a near copy goes, all other texts of its id stay."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, 120)) for _ in range(8)]
    close = [t.rsplit(" ", 1)[0] + " other" for t in texts]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, close[0]), (2, texts[2]), (3, close[2]), (3, texts[3]), (4, texts[4]), (4, close[4]), (None, texts[5]), (None, close[5]), (None, texts[6])]
    got = [(r.doc_id, r.text) for r in S.remove_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    sure = [(1, texts[0]), (None, texts[1]), (2, texts[2]), (3, texts[3]), (None, texts[6])]
    one_of = [{(4, texts[4]), (4, close[4])}, {(None, texts[5]), (None, close[5])}]
    assert set(sure) <= set(got) and all(len(set(got) & x) == 1 for x in one_of) and len(got) == len(sure) + len(one_of)
