"""Atom counts and outliers, against plain versions."""

import math

import numpy as np
import pytest
from pixelloom.operators import counting, forest, selection


def test_library_is_matched_beyond_its_ends_and_at_ties(spark):
    lib = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 50.0), (4, 20.0), (5, None)], "thickness int, scs double")
    values = spark.createDataFrame([(i, v) for i, v in enumerate([-5.0, 10.0, 14.9, 15.0, 15.1, 20.0, 35.0, 49.0, 50.0, 1e9, None])], "id int, v double")
    got = {r.id: (r["count"], r.thickness) for r in counting.match_library(values, lib).collect()}
    want = {0: (1, 1), 1: (1, 1), 2: (1, 1.49), 3: (1, 1.5), 4: (2, 1.51), 5: (2, 2), 6: (2, 2.5), 7: (3, 2 + 29 / 30), 8: (3, 3), 9: (3, 3), 10: (None, None)}
    assert {k: v and (v[0], v[1] if v[1] is None else round(v[1], 9)) for k, v in got.items()} == {k: (a, b if b is None else round(b, 9)) for k, (a, b) in want.items()}
    one = counting.match_library(values, lib.limit(1)).collect()
    assert all(r["count"] == 1 for r in one if r.v is not None)
    assert counting.match_library(values, lib.limit(0)).filter("count IS NULL").count() == 11


def test_coordination_of_a_cubic_crystal(spark):
    """Inside a face-centred crystal an atom has 12 neighbours at the edge over the root of two."""
    n, a = 5, 3.9
    cell = [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)]
    spots = [((i + p) * a, (j + q) * a, (k + r) * a) for i in range(n) for j in range(n) for k in range(n) for p, q, r in cell]
    atoms = spark.createDataFrame([(1, i, 0, *s) for i, s in enumerate(spots)], "image_id int, peak_id long, k int, x double, y double, z double")
    got = {r.peak_id: r.neighbours for r in counting.coordination(atoms, a / math.sqrt(2) + 1e-6).collect()}
    inner = [i for i, s in enumerate(spots) if all(0.9 * a < c < (n - 1.4) * a for c in s)]
    assert len(inner) > 50 and all(got[i] == 12 for i in inner) and got[0] == 3 and len(got) == len(spots)


def test_atoms_lie_symmetrically(spark):
    columns = spark.createDataFrame([(1, 1, 0.0, 0.0, 3), (1, 2, 5.0, 0.0, 2), (1, 3, 9.0, 0.0, 0), (1, 4, 9.0, 1.0, None)], "image_id int, peak_id long, x double, y double, count int")
    got = sorted((r.peak_id, r.z) for r in counting.stacked(columns, 2.0).collect())
    assert got == [(1, -2.0), (1, 0.0), (1, 2.0), (2, -1.0), (2, 1.0)]


def plain_viterbi(v, means, spread, change):
    logs = counting._step(len(means), change)
    density = lambda x: np.zeros(len(means)) if x is None else -((x - np.array(means)) ** 2) / (2 * spread**2)
    score, back = logs.max(axis=0) + density(v[0]), []
    for x in v[1:]:
        each = score[:, None] + logs
        back.append(each.argmax(axis=0))
        score = each.max(axis=0) + density(x)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("width", [1.0, 7.0, 1e9])
def test_chunked_viterbi_is_that_of_whole_series(spark, width):
    rng = np.random.default_rng(4)
    means, rows, want, n = [0.0, 10.0, 20.0, 30.0, 40.0], [], {}, 0
    for user in range(6):
        state, series = int(rng.integers(5)), []
        for t in np.sort(rng.uniform(0, 100, int(rng.integers(1, 120)))):
            state = int(np.clip(state + rng.choice([-1, 0, 0, 0, 0, 0, 1]), 0, 4))
            v = None if rng.random() < 0.05 and len(series) else float(means[state] + rng.normal(0, 6))
            series.append((user if user else None, n, float(t), v, "x"))
            n += 1
        want |= dict(zip([s[1] for s in series], plain_viterbi([s[3] for s in series], means, 6.0, 0.3), strict=True))
        rows += series
    df = spark.createDataFrame(rows, "user_id long, id long, t double, value double, state string").drop("state")
    got = {r.id: r.state for r in counting.viterbi(df, means, 6.0, 0.3, width, value="value").collect()}
    assert got == want


def test_short_series_are_solved_together(spark, monkeypatch):
    """Calls of Python grow with the batches of rows, not with the series and their chunks."""
    rng = np.random.default_rng(5)
    means, users = [0.0, 10.0, 20.0], 1500
    rows = [(u, 3 * u + k, float(k), float(rng.normal(10, 8))) for u in range(users) for k in range(3)]
    calls, plain = spark.sparkContext.accumulator(0), counting._emission

    def counted(*args):
        calls.add(1)
        return plain(*args)

    monkeypatch.setattr(counting, "_emission", counted)
    df = spark.createDataFrame(rows, "user_id long, id long, t double, value double")
    got = {r.id: r.state for r in counting.viterbi(df, means, 6.0, 0.3, 2.0, value="value").collect()}
    want = {}
    for u in range(users):
        want |= dict(zip(range(3 * u, 3 * u + 3), plain_viterbi([r[3] for r in rows[3 * u : 3 * u + 3]], means, 6.0, 0.3), strict=True))
    assert got == want and 0 < calls.value < 100


def test_a_chunk_of_any_length_is_cut_into_pieces(spark, monkeypatch):
    """Pieces end anywhere in the batches; whole numbers beyond 2**53 and other columns stay as they are."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(counting, "PIECE", 16)
    means, rows, want = [0.0, 10.0, 20.0, 30.0], [], {}
    for user, n in ((2**60 + 1, 300), (None, 17), (2**60 + 2, 16), (3, 1)):
        v = [float(x) for x in np.cumsum(rng.normal(0, 4, n)) + 15]
        ids = range(2**55 + len(rows), 2**55 + len(rows) + n)
        want |= dict(zip(ids, ((user, s) for s in plain_viterbi(v, means, 6.0, 0.3)), strict=True))
        rows += [(user, i, float(k), x, [k]) for k, (i, x) in enumerate(zip(ids, v, strict=True))]
    df = spark.createDataFrame(rows, "user_id long, id long, t double, value double, other array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = counting.viterbi(df, means, 6.0, 0.3, 1e9, value="value").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: (r.user_id, r.state) for r in got} == want and all(r.other == [int(r.t)] for r in got)
    one = counting.viterbi(df, [5.0], 6.0, 0.3, 1e9, value="value")
    assert one.filter("state = 0").count() == len(rows) and counting.viterbi(df.limit(0), means, 6.0, 0.3, 1.0, value="value").count() == 0


def plain_path(x, tree, node=0, depth=0):
    if tree.children[node][0] == node:
        return tree.path[node]
    return plain_path(x, tree, tree.children[node][int(x[tree.feature[node]] >= tree.threshold[node])], depth + 1)


def test_forest_scores_against_plain_recursion(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (800, 2)), [[9.0, 9.0], [-8.0, 7.0]]])
    df = spark.createDataFrame([(i, float(a), float(b), "s") for i, (a, b) in enumerate(x)], "id long, a double, b double, score string")
    trees = forest.forest(df, ["a", "b"])
    assert len(trees) == forest.TREES
    for t in trees[:5]:
        assert np.allclose(t.paths(x), [plain_path(p, t) for p in x])
    got = {r.id: r["anomaly"] for r in forest.with_score(df, trees, ["a", "b"], "anomaly").collect()}
    mean = np.mean([[plain_path(p, t) for t in trees] for p in x[-3:]], axis=1)
    unit = 2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256
    assert np.allclose([got[i] for i in (799, 800, 801)], 2 ** (-mean / unit))
    assert {800, 801} <= set(sorted(got, key=got.get)[-4:]) and forest.forest(df, ["a", "b"])[7].threshold.tolist() == trees[7].threshold.tolist()


def test_high_outliers_go(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(50, 5, 2000), [300.0, 400.0, -5.0, -200.0]])
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)] + [(9999, None)], "id long, v double")
    got = {r.id for r in forest.without_high_outliers(df).collect()}
    assert not got & {2000, 2001, 2002, 2003, 9999} and 1970 <= len(got) <= 2000
    assert forest.without_high_outliers(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, 7.0) for i in range(50)], "id long, v double")
    assert forest.without_high_outliers(same).count() == 50


def test_the_number_of_peaks_is_found(spark):
    rng = np.random.default_rng(11)
    y, x = np.indices((40, 40))
    truth = [(10, 10, 1.0), (10, 28, 0.8), (27, 12, 1.2), (26, 29, 0.9)]
    a = 0.2 + sum(h * np.exp(-((x - px) ** 2 + (y - py) ** 2) / (2 * 2.5**2)) for px, py, h in truth) + rng.normal(0, 0.05, x.shape)
    pixels = spark.createDataFrame([(1, int(j), int(i), float(v)) for j, i, v in zip(y.ravel(), x.ravel(), a.ravel(), strict=True)], "image_id int, y int, x int, v double")
    spots = [*truth, (20, 20, 0.1)]
    rows = [(1, n, float(px + 0.4), float(py - 0.3), h, 2.2, 0.1) for n in (3, 4, 5) for px, py, h in spots[:n]]
    starts = spark.createDataFrame(rows + [(2, 1, 5.0, 5.0, 1.0, 2.0, 0.0)], "image_id int, model int, x double, y double, height double, sigma double, background double")
    got = {r.model: r for r in selection.most_probable(selection.model_evidence(pixels, starts)).collect()}
    assert got.keys() == {3, 4, 5} and got[4].chosen and got[4].posterior > 0.9 and not got[3].chosen and not got[5].chosen
    assert got[5].rss <= got[4].rss < got[3].rss and abs(sum(r.posterior for r in got.values()) - 1) < 1e-9
