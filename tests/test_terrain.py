import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import graph
from aerolith.functions.stencil import box3, dilated_diamond, dilated_square, gaussian_weights, gradient, median3, smooth
from aerolith.operators import hydro, profile, terrain
from aerolith.schema import ConfigurationError, GridSpec

from survey_cases import as_array, as_raster, dem_array

H = W = 40
SPEC = GridSpec(500000.0, 5200100.0, 1.0, 1.0, W, H)


@pytest.fixture(scope="module")
def dem(spark):
    return as_raster(spark, dem_array(H, W)).cache()


def test_gradient_is_numpys(dem):
    a = dem_array(H, W)
    gy, gx = np.gradient(a)
    g = gradient(dem)
    assert np.allclose(as_array(g, "gx", (H, W)), gx) and np.allclose(as_array(g, "gy", (H, W)), gy)


def mirrored(a, n):
    return np.pad(a, n, mode="symmetric")


def test_filters(spark, dem):
    a = dem_array(H, W)
    p = mirrored(a, 1)
    stack = np.stack([p[i : i + H, j : j + W] for i in range(3) for j in range(3)])
    assert np.allclose(as_array(box3(dem, "z", "m"), "m", (H, W)), stack.mean(0))
    assert np.allclose(as_array(median3(dem, "z", "m"), "m", (H, W)), np.median(stack, 0))
    w = np.array(gaussian_weights(1.0))
    p = mirrored(a, 4)
    rows = sum(w[k] * p[:, k : k + W] for k in range(9))
    both = sum(w[k] * rows[k : k + H] for k in range(9))
    assert np.allclose(as_array(smooth(dem, "z", list(w), H, W), "z", (H, W)), both)
    tiny = np.array([[1.0, 2.0], [3.0, 5.0]])
    got = as_array(smooth(as_raster(spark, tiny), "z", list(w), 2, 2), "z", (2, 2))
    p = np.pad(tiny, 4, mode="symmetric")
    rows = sum(w[k] * p[:, k : k + 2] for k in range(9))
    assert np.allclose(got, sum(w[k] * rows[k : k + 2] for k in range(9)))


def test_dilations(spark):
    rng = np.random.default_rng(2)
    m = rng.random((15, 17)) < 0.03
    df = as_raster(spark, m.astype(float)).select("row", "col", (F.col("z") > 0).alias("m"))
    r, c = np.nonzero(m)
    i, j = np.indices(m.shape)
    dr, dc = np.abs(i[..., None] - r), np.abs(j[..., None] - c)
    assert (as_array(dilated_square(df, "m", 2), "m", m.shape, bool) == (np.maximum(dr, dc) <= 2).any(-1)).all()
    assert (as_array(dilated_diamond(df, "m", 3), "m", m.shape, bool) == (dr + dc <= 3).any(-1)).all()


def test_morphology_ranges(dem):
    shade = as_array(terrain.hillshade(dem, SPEC), "shade", (H, W))
    assert shade.min() >= 1 and shade.max() <= 255
    flat = dem.withColumn("z", F.lit(5.0))
    assert as_array(terrain.slope(flat, SPEC), "slope", (H, W)).max() == 0
    assert as_array(terrain.aspect(flat, SPEC), "aspect", (H, W)).max() == 0
    assert as_array(terrain.ruggedness(flat), "tri", (H, W)).max() == 0
    with pytest.raises(ConfigurationError):
        terrain.hillshade(dem, SPEC, altitude=0)
    with pytest.raises(ConfigurationError):
        terrain.slope(dem, SPEC, "radians")


def test_shift_leaves_slope_and_direction(dem):
    up = dem.withColumn("z", F.col("z") + 128.0)
    assert np.allclose(as_array(terrain.slope(dem, SPEC), "slope", (H, W)), as_array(terrain.slope(up, SPEC), "slope", (H, W)))
    assert (as_array(hydro.d8(dem, SPEC), "code", (H, W)) == as_array(hydro.d8(up, SPEC), "code", (H, W))).mean() > 0.999


def test_quarry_volumes(spark):
    y, x = np.mgrid[0:150, 0:150]
    before = 300 + 0.08 * x + 0.05 * y + 3 * np.sin(x / 15)
    pit, pile = np.hypot(x - 50, y - 75), np.hypot(x - 110, y - 110)
    after = before - np.where(pit <= 25, 6 * (1 - pit / 25), 0) + np.where(pile <= 20, 5 * (1 - pile / 20), 0)
    spec = GridSpec(0.0, 150.0, 1.0, 1.0, 150, 150)
    a, b = as_raster(spark, before), as_raster(spark, after)
    r = terrain.cut_fill(a, b, spec).first()
    assert r["cut_volume"] == pytest.approx(3926.72, abs=0.01) and r["fill_volume"] == pytest.approx(2094.21, abs=0.01)
    s = terrain.cut_fill(b, a, spec).first()
    assert s["cut_volume"] == pytest.approx(r["fill_volume"]) and s["net_volume"] == pytest.approx(-r["net_volume"])
    same = terrain.cut_fill(a, a, spec).first()
    assert same["cut_volume"] == same["fill_volume"] == same["net_volume"] == 0
    assert terrain.stockpile(a, spec).first()["cut_volume"] > 0


def test_contours_of_a_cone(spark):
    y, x = np.mgrid[0:31, 0:31]
    cone = 10 - np.hypot(x - 15, y - 15)
    spec = GridSpec(0.0, 31.0, 1.0, 1.0, 31, 31)
    seg = terrain.contour_segments(as_raster(spark, cone), spec, interval=2.0, low=3.0)
    lines = {round(r["level"], 6): r["line"] for r in terrain.contour_lines(seg.where("level in (4, 6)")).collect()}
    assert set(lines) == {4.0, 6.0}
    for level, line in lines.items():
        assert (line[0]["x"], line[0]["y"]) == (line[-1]["x"], line[-1]["y"])  # a ring
        for p in line:
            assert math.hypot(p["x"] - 15.5, p["y"] - 15.5) == pytest.approx(10 - level, abs=0.15)
    assert terrain.contour_segments(as_raster(spark, np.full((3, 3), np.nan)), spec).count() == 0


def test_contours_over_many_tiles(spark, monkeypatch):
    # before, all segments went into the star steps
    monkeypatch.setattr(terrain, "TILE", 16, raising=False)
    linked = []
    for module in (graph, terrain):
        if hasattr(module, "components"):
            monkeypatch.setattr(module, "components", lambda edges, f=module.components: linked.append(edges.count()) or f(edges))
    a = dem_array(70, 50)
    a[20:23, 30:33] = np.nan
    seg = terrain.contour_segments(as_raster(spark, a), GridSpec(0.0, 70.0, 1.0, 1.0, 50, 70), interval=0.5).cache()
    rows, up = seg.collect(), {}

    def top(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for r in rows:
        up[top((r["level"], r["a"]))] = top((r["level"], r["b"]))
    places, count = {}, Counter()
    for r in rows:
        root = top((r["level"], r["a"]))
        places.setdefault(root, set()).update({(r["x1"], r["y1"]), (r["x2"], r["y2"])})
        count[root] += 1
    expected = sorted((root[0], count[root] + 1, sorted(found)) for root, found in places.items())
    got = [(r["level"], [(p["x"], p["y"]) for p in r["line"]]) for r in terrain.contour_lines(seg).collect()]
    assert sorted((level, len(line), sorted(set(line))) for level, line in got) == expected
    pieces = {(r["level"], *sorted([(r["x1"], r["y1"]), (r["x2"], r["y2"])])) for r in rows}
    assert all((level, *sorted(pair)) in pieces for level, line in got for pair in zip(line, line[1:]))
    assert linked and sum(linked) < len(rows) / 4


def brute_d8(a):
    codes = np.zeros(a.shape, int)
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            best = 0.0
            for code, _, dr, dc in hydro.DIRECTIONS:
                if 0 <= r + dr < a.shape[0] and 0 <= c + dc < a.shape[1]:
                    s = (a[r, c] - a[r + dr, c + dc]) / math.hypot(dr, dc)
                    if s > best:
                        best, codes[r, c] = s, code
    return codes


def test_drainage(spark, dem):
    a = dem_array(H, W)
    codes = as_array(hydro.d8(dem, SPEC), "code", (H, W), int)
    assert (codes == brute_d8(a)).all() and set(np.unique(codes)) <= {0, *(d[0] for d in hydro.DIRECTIONS)}
    step = {code: (dr, dc) for code, _, dr, dc in hydro.DIRECTIONS}
    want = np.zeros((H, W), int)
    for r in range(H):
        for c in range(W):
            i, j = r, c
            while True:
                want[i, j] += 1
                if not codes[i, j]:
                    break
                i, j = i + step[codes[i, j]][0], j + step[codes[i, j]][1]
    acc = hydro.accumulation(dem, SPEC).cache()
    got = as_array(acc, "acc", (H, W), int)
    assert (got == want).all()
    assert got[codes == 0].sum() == H * W
    assert as_array(hydro.streams(acc, 5), "stream", (H, W), int).sum() == (want >= 5).sum()
    hazard = as_array(hydro.landslide(dem, SPEC, acc=acc), "hazard", (H, W), int)
    assert hazard.min() >= 0 and hazard.max() <= 100
    angle = as_array(hydro.d_infinity(dem, SPEC), "angle", (H, W))
    assert angle.min() >= 0 and angle.max() < 2 * math.pi


def test_flow_into_voids_is_lost(spark):
    a = dem_array(12, 12)
    a[5, 5] = np.nan
    df, spec = as_raster(spark, a), GridSpec(0.0, 12.0, 1.0, 1.0, 12, 12)
    codes = as_array(hydro.d8(df, spec), "code", (12, 12), int)
    assert codes[5, 5] == 0 and codes[5, 4] == 1 and codes[4, 5] == 4  # the rim drains into the void
    assert hydro.accumulation(df, spec).count() == 143
    hazard = as_array(hydro.landslide(df, spec), "hazard", (12, 12), int)
    assert hazard[5, 5] == 255


def test_transects(spark, dem):
    rows = profile.transects(dem, SPEC, "vertical", [3, 20, 30])
    assert rows.select("transect").distinct().count() == 3
    first = rows.where("transect = 3 and seq = 0").first()
    assert first["z"] == pytest.approx(dem_array(H, W)[H - 1, 3])
    assert profile.transect_lists(rows).where("size(z) = 40").count() == 3
    assert len(profile.positions(dem, "col", 3, margin=5)) == 3
    line = profile.line_transect(dem, SPEC, (500000.5, 5200099.5), (500030.5, 5200099.5), 31).orderBy("seq").collect()
    assert [r["z"] for r in line] == pytest.approx(list(dem_array(H, W)[0, :31]))


def test_histogram_and_chips(spark, dem):
    h = profile.histogram(dem, "z", 10).collect()
    assert sum(r["n"] for r in h) == H * W and max(r["cumulative"] for r in h) == 1.0
    chips = spark.createDataFrame([("a", 500000.0, 5200060.0, 500020.0, 5200080.0), ("b", 0.0, 0.0, 1.0, 1.0)], "id string, x_min double, y_min double, x_max double, y_max double")
    got = profile.zonal(dem, SPEC, chips).collect()
    assert len(got) == 1 and got[0]["cells"] == 400
    assert got[0]["mean_z"] == pytest.approx(dem_array(H, W)[20:40, :20].mean())


def test_accumulation_over_many_tiles(spark, monkeypatch):
    # before, every cell went into the pointer doubling
    monkeypatch.setattr(hydro, "TILE", 16, raising=False)
    linked = []
    monkeypatch.setattr(hydro, "subtree_sizes", lambda links, f=hydro.subtree_sizes: linked.append(links.count()) or f(links))
    h, w = 70, 50
    a = dem_array(h, w)
    a[20:23, 30:33] = np.nan
    dem, spec = as_raster(spark, a), GridSpec(0.0, float(h), 1.0, 1.0, w, h)
    steps = {code: (dr, dc) for code, _, dr, dc in hydro.DIRECTIONS}
    codes = hydro.d8(dem, spec).cache()
    code = {(r["row"], r["col"]): r["code"] for r in codes.collect()}
    expected = {cell: 1 for cell in code if not np.isnan(a[cell])}
    for cell in sorted(expected, key=lambda c: -a[c]):
        dr, dc = steps.get(code[cell], (0, 0))
        to = (cell[0] + dr, cell[1] + dc)
        if to != cell and to in expected:
            expected[to] += expected[cell]
    for given in (None, codes):
        assert {(r["row"], r["col"]): r["acc"] for r in hydro.accumulation(dem, spec, given).collect()} == expected
    assert len(linked) == 2 and max(linked) < len(expected) / 4
