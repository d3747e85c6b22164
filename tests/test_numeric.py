"""Operators that SQL can't express, against known truth or a plain version."""

import heapq
import io
import math
import struct
import time
import zlib

import numpy as np
import pytest
from pixelloom.functions import grids, models, optics
from pixelloom.operators import crystal, detector, fitting, flooding, joins, mixture, refinement, sets, windows
from pixelloom.plans import loops
from pixelloom.sources import binary, text
from pyspark.sql import functions as F


def image(spark, a, image_id=1):
    y, x = np.indices(a.shape)
    rows = [(image_id, int(j), int(i), float(v)) for j, i, v in zip(y.ravel(), x.ravel(), a.ravel(), strict=True)]
    return spark.createDataFrame(rows, "image_id int, y int, x int, v double")


def dense(df, value="v"):
    rows = df.collect()
    a = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        a[r.y, r.x] = r[value]
    return a


PARAMS = "image_id int, peak_id long, x double, y double, atom_type int, height double, sigma double, gamma double, ratio double, background double"


@pytest.fixture(scope="module")
def four(spark):
    """Four Gaussians on 100 x 100 pixels with noise .02, and starts off by a normal deviate."""
    rng = np.random.default_rng(42)
    y, x = np.indices((100, 100))
    truth = [(25, 25, 1.0), (25, 75, 1.2), (75, 25, 0.8), (75, 75, 1.1)]
    a = sum(h * np.exp(-((x - px) ** 2 + (y - py) ** 2) / (2 * 2.975**2)) for px, py, h in truth) + rng.normal(0, 0.02, x.shape)
    starts = [(1, i, px + rng.normal(), py + rng.normal(), 0, h * 0.9, 2.5, 2.2, 0.9, 0.0) for i, (px, py, h) in enumerate(truth)]
    return image(spark, a).cache(), spark.createDataFrame(starts, PARAMS), truth


@pytest.fixture(scope="module")
def five(spark):
    """Five peaks of each model on 100 x 100 pixels with noise .01, and starts half a pixel off."""
    out = {}
    for kind in ("gaussian", "lorentzian", "voigt"):
        rng = np.random.default_rng(42)
        px, py, h = rng.uniform(20, 80, 5), rng.uniform(20, 80, 5), rng.uniform(0.5, 1, 5)
        y, x = np.indices((100, 100))
        f = fitting._peaks_model(x.ravel().astype(float), y.ravel().astype(float), kind)
        a = f(np.concatenate([px, py, h, [2, 2 / math.sqrt(2 * math.log(2)), 0.88, 0]])) + rng.normal(0, 0.01, x.size)
        start = [(1, i, float(px[i] + 0.5), float(py[i] - 0.5), 0, float(h[i] * 0.9), 2.2, 1.5, 0.9, 0.0) for i in range(5)]
        out[kind] = image(spark, a.reshape(x.shape)).cache(), spark.createDataFrame(start, PARAMS), list(zip(px, py, h, strict=True))
    return out


def near_truth(rows, truth):
    for r in rows:
        px, py, h = truth[r.peak_id]
        assert math.hypot(r.x - px, r.y - py) < 0.5 and abs(r.height - h) < 0.1 and abs(r.sigma - 2.975) < 0.2
    assert len(rows) == len(truth)


def test_patches_find_four_gaussians(four):
    pixels, params, truth = four
    near_truth(fitting.fit_patches(pixels, params, 50, 8).collect(), truth)


def test_cells_find_four_gaussians(four):
    pixels, params, truth = four
    near_truth(fitting.fit_cells(pixels, params, 15.0).collect(), truth)


@pytest.mark.parametrize("fit", [refinement.fit_blocks, refinement.fit_all])
def test_whole_fits_find_four_gaussians(four, fit, recwarn):
    pixels, params, truth = four
    near_truth(fit(pixels, params, 12.0).collect(), truth)
    assert not [w for w in recwarn if w.category is fitting.NotConverged]


@pytest.mark.parametrize("fit", [refinement.fit_blocks, refinement.fit_all])
@pytest.mark.parametrize("kind", ["gaussian", "lorentzian", "voigt"])
def test_whole_fits_find_five_peaks(spark, five, kind, fit, recwarn):
    pixels, params, truth = five[kind]
    rows = fit(pixels, params, 20.0, kind).collect()
    for r in rows:
        px, py, h = truth[r.peak_id]
        assert math.hypot(r.x - px, r.y - py) < 0.3 and abs(r.height / h - 1) < 0.05
        assert kind == "lorentzian" or abs(r.sigma / 2 - 1) < 0.1
        assert kind != "voigt" or abs(r.ratio - 0.88) < 0.05
    assert len(rows) == 5 and not [w for w in recwarn if w.category is fitting.NotConverged]


def test_adam_moves_towards_truth(four):
    pixels, params, truth = four
    with pytest.warns(fitting.NotConverged):
        before, after = params.collect(), fitting.fit_adam(pixels, params, 12.0, rounds=12, rates={"x": 0.1, "y": 0.1, "height": 0.01, "sigma": 0.05}).collect()
    off = lambda rows: sum(math.hypot(r.x - truth[r.peak_id][0], r.y - truth[r.peak_id][1]) for r in rows)
    assert off(after) < 0.6 * off(before)


def test_blocks_of_crowded_overlapping_peaks(spark):
    """More peaks than a block fits at once, on a slope: the residual left is that of a dense least-squares fit, within the noise."""
    rng = np.random.default_rng(1)
    y, x = np.indices((48, 48))
    spots = [(4.0 + 5 * i + rng.normal(0, 0.2), 4.0 + 5 * j + rng.normal(0, 0.2)) for i in range(9) for j in range(9)]
    a = 0.3 + sum((1 + 0.02 * px) * np.exp(-((x - px) ** 2 + (y - py) ** 2) / (2 * 1.8**2)) for px, py in spots) + rng.normal(0, 0.01, x.shape)
    start = [(1, i, px + rng.normal(0, 0.3), py + rng.normal(0, 0.3), 0, 1.0, 1.6, 1.0, 0.9, 0.2) for i, (px, py) in enumerate(spots)]
    params = spark.createDataFrame(start, PARAMS)
    rows = refinement.fit_blocks(image(spark, a), params, 7.0, tolerance=1e-2).collect()
    assert all(math.hypot(r.x - spots[r.peak_id][0], r.y - spots[r.peak_id][1]) < 0.1 and abs(r.sigma - 1.8) < 0.1 for r in rows) and len(rows) == 81


def test_empty_images_and_far_peaks(spark):
    params = spark.createDataFrame([(1, 0, 500.0, 500.0, 0, 1.0, 2.0, 1.0, 0.9, 0.0), (3, 1, 5.0, 5.0, 0, 1.0, 2.0, 1.0, 0.9, 0.0)], PARAMS)
    flat = image(spark, np.zeros((12, 12)))
    for fit in (refinement.fit_blocks, refinement.fit_all):
        assert sorted((r.peak_id, r.x, r.height) for r in fit(flat, params, 4.0).collect()) == [(0, 500.0, 1.0), (1, 5.0, 1.0)]
        assert fit(flat, params.limit(0), 4.0).count() == 0


def test_linear_heights_and_center_of_mass(spark, four):
    pixels, params, truth = four
    exact = spark.createDataFrame([(1, i, float(px), float(py), 0.0, 2.975, 0.0) for i, (px, py, _) in enumerate(truth)], "image_id int, peak_id long, x double, y double, height double, sigma double, background double")
    for r in fitting.linear_heights(pixels, exact, 12.0).collect():
        assert abs(r.height - truth[r.peak_id][2]) < 0.05
    for r in fitting.refine_com(pixels, params.select("image_id", "peak_id", "x", "y"), 12.0).collect():
        assert math.hypot(r.x - truth[r.peak_id][0], r.y - truth[r.peak_id][1]) < 0.5


@pytest.mark.parametrize("kind", ["gaussian", "lorentzian", "voigt"])
def test_five_peaks(spark, kind):
    rng = np.random.default_rng(42)
    px, py, h = rng.uniform(20, 80, 5), rng.uniform(20, 80, 5), rng.uniform(0.5, 1, 5)
    y, x = np.indices((100, 100))
    gamma = 2 / math.sqrt(2 * math.log(2))
    f = fitting._peaks_model(x.ravel().astype(float), y.ravel().astype(float), kind)
    a = f(np.concatenate([px, py, h, [2, gamma, 0.88, 0]])) + rng.normal(0, 0.01, x.size)
    start = [(1, i, float(px[i] + 0.5), float(py[i] - 0.5), float(h[i] * 0.9), 2.2, 1.5, 0.9, 0.0) for i in range(5)]
    params = spark.createDataFrame(start, "image_id int, peak_id long, x double, y double, height double, sigma double, gamma double, ratio double, background double")
    for r in fitting.fit_patches(image(spark, a.reshape(x.shape)), params, 100, 0, kind).collect():
        i = r.peak_id
        assert math.hypot(r.x - px[i], r.y - py[i]) < 0.3 and abs(r.height / h[i] - 1) < (0.05 if kind != "voigt" else 0.1)
        assert kind == "lorentzian" or abs(r.sigma / 2 - 1) < 0.1


def test_rotated_gaussian(spark):
    y, x = np.indices((50, 50))
    p = {"a": 1.0, "x0": 25.0, "y0": 25.0, "sx": 2.0, "sy": 2.5, "theta": math.pi / 6, "offset": 0.1}
    grid = image(spark, np.zeros((50, 50)))
    made = grid.withColumn("v", models.rotated_gaussian(F.col("x"), F.col("y"), *p.values()))
    noise = np.random.default_rng(42).normal(0, 0.01, (50, 50))
    r = refinement.fit_rotated(image(spark, dense(made) + noise), {"x0": 23.0, "y0": 26.0, "sx": 2.2, "sy": 2.8, "theta": 0.4}).first()
    assert abs(r.x0 - 25) < 0.3 and abs(r.y0 - 25) < 0.3 and abs(r.sx / 2 - 1) < 0.1 and abs(r.sy / 2.5 - 1) < 0.1 and abs(r.theta - p["theta"]) < 0.1 and abs(r.a - 1) < 0.1 and abs(r.offset - 0.1) < 0.02


def test_guess_radius_and_noise(spark, four):
    pixels, params, _ = four
    assert 1 < fitting.guess_radius(pixels, params.select("image_id", "peak_id", "x", "y"), 6) < 10
    flat = image(spark, np.full((40, 40), 9.0))
    a, b = (sorted(map(tuple, fitting.poisson_noise(flat, 3).collect())) for _ in range(2))
    assert a == b and abs(np.mean([r[3] for r in a]) - 9) < 0.5


def test_cramer_rao(spark, four):
    pixels, params, _ = four
    lit = params.withColumns({"background": F.lit(1.0), "height": F.lit(50.0)})
    info = fitting.fisher_information(pixels, lit, 12.0)
    m = np.zeros((3, 3))
    for r in info.filter("peak_id = 0").collect():
        m[r.p, r.q] = r["info"]
    got = fitting.cramer_rao(info).filter("peak_id = 0").first()
    assert np.allclose([got.sx, got.sy, got.sh], np.sqrt(np.diag(np.linalg.inv(m))))


def test_mixture_is_found_and_never_gets_worse(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(10, 1, 600), rng.normal(20, 1.5, 300), rng.normal(35, 2, 100)])
    s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double").cache()
    model, llhs = mixture.initial(s, 3), []
    for _ in range(6):
        model, llh = mixture.step(s, model)
        llhs.append(llh)
    assert all(b >= a - 1e-6 for a, b in zip(llhs, llhs[1:], strict=False))
    model, _ = mixture.fit(s, 3)
    assert np.allclose([c.mean for c in model], [10, 20, 35], atol=0.6) and np.allclose([c.weight for c in model], [0.6, 0.3, 0.1], atol=0.03)
    shares = mixture.responsibilities(s, model).select(F.aggregate("tau", F.lit(0.0), lambda a, x: a + x).alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-9 for r in shares)


def test_mixture_in_two_dimensions(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal((0, 0), (1, 0.5), (500, 2)), rng.normal((8, 3), (0.7, 1), (300, 2))])
    s = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, v double, w double").cache()
    best, _ = mixture.best_size(s, [1, 2], dims=("v", "w"))
    model, _ = mixture.fit(s, 2, dims=("v", "w"))
    assert best == 2 and np.allclose([c.means for c in model], [(0, 0), (8, 3)], atol=0.2) and abs(model[0].weight - 0.625) < 0.02
    assert len(mixture.inserted(model, s, ("v", "w"))) == 1
    assert {r.component for r in mixture.assign(s, model, ("v", "w")).filter("id < 400").collect()} == {0}


def test_spectrum_of_a_lattice(spark):
    y, x = np.indices((48, 64))
    a = np.cos(2 * np.pi * x * 8 / 64) + 0.5 * np.cos(2 * np.pi * y * 6 / 48)
    got = {(round(r.gx * 64), round(r.gy * 48)) for r in crystal.fft_peaks(image(spark, a), 64, 48, 4).collect()}
    assert got == {(8, 0), (-8, 0), (0, 6), (0, -6)}


def test_inverse_transform(spark):
    a = np.random.default_rng(4).random((6, 8))
    assert np.allclose(dense(grids.ifft2(grids.fft2(image(spark, a))), "re"), a)


def test_fourier(spark):
    a = np.random.default_rng(0).random((12, 16))
    f = grids.fft2(image(spark, a))
    want = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(a)))
    assert np.allclose(dense(f, "re"), want.real) and np.allclose(dense(f, "im"), want.imag)
    assert np.allclose(dense(grids.band_pass(image(spark, a), 0, 2)), a)
    smooth = np.cos(2 * np.pi * np.arange(16) * 2 / 16)[None, :] * np.ones((12, 1))
    for r in grids.fourier_zoom(image(spark, smooth), (5.0, 4.0), 4.0, (6, 6)).collect():
        assert abs(r.v - math.cos(2 * math.pi * r.x * 2 / 16)) < 1e-9


def test_quadrature(spark):
    beam = spark.createDataFrame([(0.3, 3e5)], "spread double, energy double")
    got = sorted(r.df for r in optics.quadrature(beam, 5, 1e7, F.col("spread"), F.col("energy")).collect())
    width = 1e7 * 0.3 / 3e5
    assert np.allclose([0.5 * (1 + math.erf(x / width / math.sqrt(2))) for x in got], [0.1, 0.3, 0.5, 0.7, 0.9])


def test_greedy_dedup(spark):
    rng = np.random.default_rng(5)
    pts = [(1 + i % 2, i, *map(float, rng.uniform(0, 30, 2))) for i in range(200)]
    kept = []
    for p in pts:
        if not any(k[0] == p[0] and abs(k[2] - p[2]) < 3 and abs(k[3] - p[3]) < 3 for k in kept):
            kept.append(p)
    got = windows.greedy_dedup(spark.createDataFrame(pts, "image_id int, peak_id long, x double, y double"), 3.0)
    assert sorted(r.peak_id for r in got.collect()) == sorted(k[1] for k in kept)


def test_adaptive_origins_follow_a_drift(spark):
    pts = [(1, 10 * i + j, 10 + 6.3 * i, 10 + 6.2 * j) for i in range(8) for j in range(8)]
    got = windows.adaptive_origins(spark.createDataFrame(pts, "image_id int, peak_id long, x double, y double"), (10.0, 10.0), (6.0, 0.0), (0.0, 6.0), 8).collect()
    at = {(r.a, r.b): (r.x, r.y) for r in got}
    assert all(abs(at[i, j][0] - 10 - 6.3 * i) < 1e-9 and abs(at[i, j][1] - 10 - 6.2 * j) < 1e-9 for i in range(7) for j in range(7))


def plain_walk(points, origin, va, vb, reach):
    """Cells one by one, by growing distance from the origin."""
    half = min(np.hypot(*va), np.hypot(*vb)) / 2
    low, high = points.min(axis=0) - half, points.max(axis=0) + half
    cells = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    perfect = {c: origin + c[0] * va + c[1] * vb for c in cells}
    inside = sorted((c for c in cells if (perfect[c] >= low).all() and (perfect[c] <= high).all()), key=lambda c: (round(float(np.hypot(*(perfect[c] - origin))), 9), c))
    placed = {}
    for i, j in inside:
        told = [placed[n] + (i - n[0]) * va + (j - n[1]) * vb for n in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if n in placed]
        at = np.mean(told, axis=0) if told else perfect[i, j]
        d = np.hypot(*(points - at).T)
        placed[i, j] = points[d.argmin()] if d.min() < half else at
    return placed


@pytest.mark.parametrize("vectors", [((6.0, 1.0), (-1.0, 6.0)), ((6.0, 0.0), (3.0, 5.196152422706632))])
def test_rings_of_origins_are_those_of_a_walk(spark, vectors):
    rng = np.random.default_rng(2)
    va, vb = map(np.array, vectors)
    rows = []
    for image_id in (1, 2):
        spots = [20 + i * va * 1.03 + j * vb * 0.98 + rng.normal(0, 0.5, 2) for i in range(-3, 4) for j in range(-3, 3) if rng.random() < 0.85]
        rows += [(image_id, k, *map(float, s)) for k, s in enumerate(spots)]
    df = spark.createDataFrame(rows, "image_id int, peak_id long, x double, y double")
    got = windows.adaptive_origins(df, (20.0, 20.0), *vectors, 4).collect()
    for image_id in (1, 2):
        want = plain_walk(np.array([r[2:] for r in rows if r[0] == image_id]), np.array([20.0, 20.0]), va, vb, 4)
        mine = {(r.a, r.b): (r.x, r.y) for r in got if r.image_id == image_id}
        assert mine.keys() == want.keys() and all(np.allclose(mine[c], want[c]) for c in want)


def test_random_batches_cover_all(spark):
    got = windows.random_batches(spark.range(1000), 8, 1).groupBy("batch").count().collect()
    assert sum(r["count"] for r in got) == 1000 and len(got) == 8 and min(r["count"] for r in got) > 80


@pytest.mark.parametrize("version", [3, 4])
@pytest.mark.parametrize("dtype", ["float32", "int16", "uint8", "float64"])
def test_dm_round_trip(spark, tmp_path, version, dtype):
    a = (np.random.default_rng(3).random((5, 7)) * 100).astype(dtype)
    (tmp_path / f"a.dm{version}").write_bytes(binary.encode_dm(a, version, 0.25, "nm"))
    got = text.read_any(spark, str(tmp_path / f"a.dm{version}"))
    assert np.allclose(dense(binary.to_pixels(got)), a)
    tags = {r.key: r.text for r in binary.read_dm_tags(spark, str(tmp_path)).collect()}
    head = "ImageList/0/ImageData/Calibrations/Dimension/1/"
    assert tags[head + "Scale"] == "0.25" and tags[head + "Units"] == "nm"


def _mat_element(kind, raw):
    return struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def _mat_matrix(name, body, cls, dims):
    flags = _mat_element(6, struct.pack("<II", cls, 0))
    return _mat_element(14, flags + _mat_element(5, struct.pack(f"<{len(dims)}i", *dims)) + _mat_element(1, name.encode()) + body)


def test_mat_file(spark, tmp_path):
    a = np.arange(6, dtype="<f8").reshape(2, 3)
    field = _mat_matrix("", _mat_element(9, a.tobytes(order="F")), 6, (2, 3))
    names = b"".join(n.ljust(8, b"\0") for n in (b"obs", b"dx"))
    small = _mat_matrix("", _mat_element(9, struct.pack("<d", 0.1)), 6, (1, 1))
    s = _mat_matrix("input", struct.pack("<HHi", 5, 4, 8) + _mat_element(1, names) + field + small, 2, (1, 1))
    title = _mat_matrix("title", _mat_element(4, "STO".encode("utf-16-le")), 4, (1, 3))
    packed = zlib.compress(s)
    raw = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + struct.pack("<II", 15, len(packed)) + packed + title
    (tmp_path / "f.mat").write_bytes(raw)
    got = {r.key: r for r in text.read_any(spark, str(tmp_path / "f.mat")).collect()}
    assert got["input.obs"].shape == [2, 3] and got["input.obs"]["values"] == [0, 1, 2, 3, 4, 5] and got["input.dx"]["values"] == [0.1] and got["title"].text == "STO"


def test_text_npy_and_image_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2\n# note\n3\t4.5\n")
    assert sorted(r.value for r in text.read_any(spark, str(tmp_path / "m.txt")).collect()) == [1, 2, 3, 4.5]
    (tmp_path / "m.csv").write_text("1,2\n3,4\n")
    assert sorted(map(tuple, text.read_any(spark, str(tmp_path / "m.csv")).collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    out = io.BytesIO()
    np.save(out, np.arange(12.0).reshape(3, 4))
    (tmp_path / "m.npy").write_bytes(out.getvalue())
    assert (dense(binary.to_pixels(text.read_any(spark, str(tmp_path / "m.npy")))) == np.arange(12).reshape(3, 4)).all()
    rgb = bytes(range(24))
    rows = b"".join(b"\0" + rgb[12 * r : 12 * r + 12] for r in range(2))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "m.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    got = dense(text.read_any(spark, str(tmp_path / "m.png")))
    assert np.allclose(got, np.frombuffer(rgb, np.uint8).reshape(2, 4, 3).mean(axis=2))
    with pytest.raises(ValueError):
        text.read_any(spark, "x.unknown")
    text.export_params(spark.range(3), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_cif_file(spark, tmp_path):
    from pixelloom.plans.sources import _CIF

    (tmp_path / "s.cif").write_text(_CIF + "\nloop_\n_other\n 1\n")
    cells, atoms = text.read_cif(spark, str(tmp_path / "s.cif"), ["O"])
    assert cells.first().b == 3.905 and atoms.count() == 3


def test_greedy_dedup_decides_all(spark):
    chain = spark.createDataFrame([(1, i, 2.0 * i, 0.0) for i in range(13)], "image_id int, peak_id long, x double, y double")
    assert sorted(r.peak_id for r in windows.greedy_dedup(chain, 3.0).collect()) == list(range(0, 13, 2))
    with pytest.raises(RuntimeError):
        windows.greedy_dedup(chain, 3.0, rounds=2)


def test_guess_radius_of_far_peaks(spark):
    """Boxes grow beyond 20 pixels where peaks are farther apart than twice that."""
    pixels = spark.range(121 * 61).selectExpr("1 AS image_id", "CAST(id DIV 121 AS INT) AS y", "CAST(id % 121 AS INT) AS x", "1.0D AS v")
    peaks = spark.createDataFrame([(1, 1, 30.0, 30.0), (1, 2, 90.0, 30.0)], "image_id int, peak_id long, x double, y double")
    assert fitting.guess_radius(pixels, peaks) == pytest.approx((121 * 61 / 2) ** 0.5 / np.pi)
    assert fitting.guess_radius(pixels.limit(0), peaks) == 0.0


def plain_watershed(a, markers):
    """The forest grown from the markers by a heap of edges, in the order that the operator states."""
    label, heap = dict(markers), []

    def push(p):
        for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
            if 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and q not in label:
                u, v = sorted((p, q))
                heapq.heappush(heap, (max(a[p], a[q]), min(a[p], a[q]), *u, v[1] - u[1], p, q))

    for p in markers:
        push(p)
    while heap:
        *_, p, q = heapq.heappop(heap)
        if q not in label:
            label[q] = label[p]
            push(q)
    return label


@pytest.mark.parametrize("seed", [8, 9])
def test_watershed_against_a_heap(spark, seed):
    rng = np.random.default_rng(seed)
    a = np.round(rng.normal(0, 1, (14, 17)).cumsum(0).cumsum(1) / 4).astype(float)  # with plateaus
    markers = {(2, 3): 5, (9, 12): 2, (12, 2): 9, (3, 14): 7, (3, 15): 7, (13, 16): 7}
    spots = spark.createDataFrame([(1, y, x, m) for (y, x), m in [*markers.items(), ((2, 3), 1)]], "image_id int, y int, x int, label int")
    both = image(spark, a).unionByName(image(spark, np.zeros((3, 3)), 2))  # nothing is marked in the second
    got = {(r.image_id, r.y, r.x): r.label for r in flooding.watershed(both, spots).collect()}
    assert {k[1:]: m for k, m in got.items() if k[0] == 1} == plain_watershed(a, markers) and len({m for k, m in got.items() if k[0] == 1}) == 4
    assert sum(k[0] == 2 and m is None for k, m in got.items()) == 9


def test_watershed_of_a_spiral_valley(spark):
    a, p, d, steps = np.full((31, 31), 1e6), (0, 0), (0, 1), []
    while len(steps) < 250:  # a valley that winds inwards and rises, with a wall between its turns
        steps.append(p)
        a[p] = len(steps)
        ahead, wall = ((p[0] + k * d[0], p[1] + k * d[1]) for k in (1, 2))
        inside = lambda q: 0 <= q[0] < 31 and 0 <= q[1] < 31
        if not inside(ahead) or (inside(wall) and a[wall] < 1e6):
            d = (d[1], -d[0])
        p = (p[0] + d[0], p[1] + d[1])
    spots = spark.createDataFrame([(1, 0, 0, 1), (1, 15, 15, 2)], "image_id int, y int, x int, label int")
    began = time.perf_counter()
    got = {(r.y, r.x): r.label for r in flooding.watershed(image(spark, a), spots).collect()}
    assert all(got[p] == 1 for p in steps if p != (15, 15)) and time.perf_counter() - began < 60


def test_size_estimates_do_not_grow_with_rounds(spark):
    df = spark.range(100).withColumn("v", F.rand(1))
    sizes = []
    for _ in range(6):
        df = loops.cut(df.join(df.withColumnRenamed("v", "u"), "id").select("id", ((F.col("u") + F.col("v")) / 2).alias("v")))
        sizes.append(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert max(sizes) < 10 * sizes[0]


def test_watershed_parts_touching_columns(spark):
    y, x = np.indices((20, 30))
    a = np.exp(-((x - 8) ** 2 + (y - 10) ** 2) / 30) + 0.8 * np.exp(-((x - 20) ** 2 + (y - 9) ** 2) / 30)
    peaks = spark.createDataFrame([(1, 0, 8.2, 9.9), (1, 1, 20.1, 9.2)], "image_id int, peak_id long, x double, y double")
    got = {(r.y, r.x): r.peak_id for r in detector.watershed_cells(image(spark, a), peaks).collect()}
    assert all(got[10, i] == 0 for i in range(12)) and all(got[9, i] == 1 for i in range(17, 30)) and None not in got.values()
    mask = {(r.y, r.x): r["mask"] for r in detector.watershed_mask(image(spark, np.round(a, 2)), 80).collect()}
    assert mask[10, 8] and mask[9, 20] and not mask[0, 0] and 0.15 < np.mean(list(mask.values())) < 0.25


def test_a_long_chain_is_thinned_to_its_half(spark):
    chain = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(120)], "image_id int, peak_id long, x double, y double")
    assert sorted(r.peak_id for r in windows.greedy_dedup(chain, 1.5).collect()) == list(range(0, 120, 2))


def test_nearest_however_far(spark):
    rng = np.random.default_rng(4)
    left = spark.createDataFrame([(i % 3, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1000, (60, 2)))], "image_id int, peak_id long, x double, y double")
    pts = [(i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 30, (8, 2)))]
    right = spark.createDataFrame(pts, "image_id int, peak_id long, x double, y double")
    got = {r.peak_id: r.peak_id_r for r in joins.nearest_any(left, right, ("peak_id",), reach=2.0).collect()}
    want = {r.peak_id: min((math.dist((r.x, r.y), p[2:]), p[1]) for p in pts if p[0] == r.image_id)[1] for r in left.collect() if r.image_id < 2}
    assert got == want


def test_many_regions(spark):
    regions = [(i, i, [(10.0 * (i % 9), 7.0 * (i // 9)), (10.0 * (i % 9) + 14, 7.0 * (i // 9)), (10.0 * (i % 9) + 14, 7.0 * (i // 9) + 9), (10.0 * (i % 9), 7.0 * (i // 9) + 9)]) for i in range(1, 60)]
    df = spark.createDataFrame(regions, "region_id int, ord int, vertices array<struct<x:double,y:double>>")
    spots = [(1, y, x) for y in range(0, 50, 3) for x in range(0, 90, 4)]
    px = spark.createDataFrame([(i, y + 0.5, x + 0.5) for i, y, x in spots], "image_id int, y double, x double")
    got = {(r.y, r.x): r.region_id for r in sets.region_map(px, df).collect()}
    inside = lambda v, x, y: v[0][0] < x < v[1][0] and v[0][1] < y < v[2][1]
    assert got == {(y + 0.5, x + 0.5): max((i for i, _, v in regions if inside(v, x + 0.5, y + 0.5)), default=0) for _, y, x in spots}


def test_poisson_moments(spark):
    for mean in (0.0, 0.3, 7.0, 55.0, 61.0, 900.0):
        v = np.array([r.v for r in fitting.poisson_noise(image(spark, np.full((60, 60), mean)), 5).collect()])
        assert (v >= 0).all() and (v == np.round(v)).all() and abs(v.mean() - mean) < 5 * math.sqrt(mean / v.size) + 1e-9 and abs(v.var() - mean) < 0.15 * mean + 1e-9


def test_benchmark_is_refined(spark, four):
    pixels, params, truth = four
    starts = params.select("image_id", "peak_id", (F.col("x") * 0.1).alias("x"), (F.col("y") * 0.1).alias("y"), "atom_type")
    rows = fitting.refine_benchmark(pixels, starts, 0.28, 0.1).collect()
    a = dense(pixels)
    y, x = np.indices(a.shape)
    d = np.stack([np.hypot(x - r.x, y - r.y) for r in rows])
    for k, r in enumerate(rows):
        own = (d.argmin(axis=0) == k) & (d[k] < 14)
        assert math.hypot(r.x - truth[r.peak_id][0], r.y - truth[r.peak_id][1]) < 0.5 and abs(r.scs / (2 * math.pi * r.sigma**2 * r.height * 0.01) - 1) < 1e-6
        assert abs(r.scs_voronoi - (a[own] - a.min()).sum() * 0.01) < 1e-6
    assert len(rows) == 4


def dm_by_hand(version):
    """Bytes of a file of one 3 x 2 image of 16-bit numbers and a note, after the published layout."""
    long = (lambda n: n.to_bytes(4, "big")) if version == 3 else (lambda n: n.to_bytes(8, "big"))
    size = lambda body: b"" if version == 3 else len(body).to_bytes(8, "big")

    def directory(name, *tags):
        body = b"\x01\x00" + long(len(tags)) + b"".join(tags)
        return b"\x14" + len(name).to_bytes(2, "big") + name + size(body) + body

    def entry(name, info, raw):
        body = b"%%%%" + long(len(info)) + b"".join(long(i) for i in info) + raw
        return b"\x15" + len(name).to_bytes(2, "big") + name + size(body) + body

    image_data = directory(
        b"ImageData", entry(b"Data", [20, 2, 6], bytes([1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 0xFF, 0xFF])), entry(b"DataType", [5], b"\x01\0\0\0"),
        directory(b"Dimensions", entry(b"", [5], b"\x03\0\0\0"), entry(b"", [5], b"\x02\0\0\0")),
    )
    note = entry(b"Note", [20, 4, 2], "ok".encode("utf-16-le"))
    pair = entry(b"Pair", [15, 0, 2, 0, 2, 0, 2], b"\x07\0\xfe\xff")
    body = b"\x01\x00" + long(2) + directory(b"ImageList", directory(b"", image_data)) + directory(b"More", note, pair)
    return version.to_bytes(4, "big") + long(len(body)) + b"\0\0\0\x01" + body + b"\0" * 8


@pytest.mark.parametrize("version", [3, 4])
def test_dm_files_made_by_hand(spark, tmp_path, version):
    path = tmp_path / f"a.dm{version}"
    path.write_bytes(dm_by_hand(version))
    r = text.read_any(spark, str(path)).first()
    assert list(r.shape) == [2, 3] and list(r["values"]) == [1, 2, 3, 4, 5, -1]
    tags = {t.key: t.text for t in binary.read_dm_tags(spark, str(path)).collect()}
    assert tags["More/Note"] == "ok" and tags["More/Pair"] == "[7, -2]" and tags["ImageList/0/ImageData/Dimensions/1"] == "2"


def test_squares_of_small_images_are_dealt_over_tasks(spark, monkeypatch, tmp_path):
    """A pass has few bytes and much work; the squares of many images don't end up in one task."""
    from pixelloom.operators import refinement as R
    from pyspark import TaskContext

    plain, folder = R._fitted, str(tmp_path)

    def noted(*args):
        open(f"{folder}/{TaskContext.get().partitionId()}", "w").close()
        return plain(*args)

    monkeypatch.setattr(R, "_fitted", noted)
    y, x = np.indices((48, 64))
    v = 2 + 10 * np.exp(-((x - 30.2) ** 2 + (y - 20.4) ** 2) / 8)
    pixels = spark.createDataFrame([(i, int(a), int(b), float(c)) for i in range(8) for a, b, c in zip(y.ravel(), x.ravel(), v.ravel(), strict=True)], "image_id int, y int, x int, v double")
    params = spark.createDataFrame([(i, 1, 30.0, 20.0, 8.0, 1.8, 1.3, 0.9, 2.0) for i in range(8)], "image_id int, peak_id long, x double, y double, height double, sigma double, gamma double, ratio double, background double")
    got = R.fit_blocks(pixels, params, 8.0, epochs=6).collect()
    assert len(got) == 8 and all(abs(r.x - 30.2) < 0.01 and abs(r.y - 20.4) < 0.01 for r in got)
    assert len(list(tmp_path.iterdir())) > 1
