import time

import numpy as np
import pandas as pd
import pytest

from aerolith.functions.graph import components, filled_holes, subtree_sizes
from aerolith.functions.grid import cell_of, grid_of
from aerolith.functions.knn import idw, nearest
from aerolith.operators import imagery, surfaces
from aerolith.schema import ConfigurationError, GridMismatchError, GridSpec
from pyspark.sql import functions as F

from survey_cases import as_array, as_raster


def test_binning_matches_numpy(cloud, cloud_arrays):
    spec = grid_of(cloud, 1.5)
    row, col = cell_of(spec)
    got = cloud.select("pid", row.alias("r"), col.alias("c")).toPandas().set_index("pid").sort_index()
    c = np.clip(((cloud_arrays["x"] - spec.min_x) / 1.5).astype(int), 0, spec.width - 1)
    r = np.clip(((spec.max_y - cloud_arrays["y"]) / 1.5).astype(int), 0, spec.height - 1)
    assert (got["c"].to_numpy() == c).all() and (got["r"].to_numpy() == r).all()


def test_first_ground_point_of_a_cell(cloud, cloud_arrays):
    spec = grid_of(cloud, 3.0)
    best = {}
    for i in np.flatnonzero(cloud_arrays["classification"] == 2):
        c = min(int((cloud_arrays["x"][i] - spec.min_x) / 3), spec.width - 1)
        r = min(int((spec.max_y - cloud_arrays["y"][i]) / 3), spec.height - 1)
        best.setdefault((r, c), i)
    assert {(x["row"], x["col"]): x["pid"] for x in surfaces.ground_nodes(cloud, spec).collect()} == best


@pytest.mark.parametrize("bucket", [0.3, 2.0])
def test_nearest_is_exact(spark, bucket):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.uniform(0, 10, (60, 2)), [[40.0, 40.0]]])
    ask = np.vstack([rng.uniform(-2, 12, (40, 2)), [[39.0, 30.0]]])
    nodes = spark.createDataFrame([(i, float(a), float(b), float(i)) for i, (a, b) in enumerate(pts)], "pid long, x double, y double, v double")
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ask)], "q long, qx double, qy double")
    got = {r["q"]: [(n["d2"], n["value"]) for n in r["near"]] for r in nearest(asked, nodes, ["q"], 4, bucket, F.col("v"), ["pid"]).collect()}
    for i, q in enumerate(ask):
        d = ((pts - q) ** 2).sum(1)
        order = np.lexsort((np.arange(len(pts)), d))[:4]
        assert [v for _, v in got[i]] == [float(k) for k in order]
    assert len(got) == len(ask)


def test_wide_voids(spark):
    """A 500 x 500 void in a raster, and a terrain model over a hole in the ground, against plain numpy."""
    n, a, b = 510, 5, 505
    size = spark.range(n * n).select(F.expr(f"id div {n}").alias("row"), (F.col("id") % n).alias("col"))
    inside = F.col("row").between(a, b - 1) & F.col("col").between(a, b - 1)
    raster = size.withColumn("z", F.when(~inside, (F.col("row") * n + F.col("col")).cast("double")))
    began = time.perf_counter()
    got = as_array(surfaces.nearest_filled(raster), "z", (n, n))
    assert time.perf_counter() - began < 60
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:n, 0:n]
    ring = (y < a) | (y >= b) | (x < a) | (x >= b)
    ys, xs = y[ring], x[ring]
    for r, c in rng.integers(a, b, (300, 2)):
        d = (ys - r) ** 2 + (xs - c) ** 2
        k = np.lexsort((xs, ys, d))[0]
        assert got[r, c] == ys[k] * n + xs[k]
    pts = rng.uniform(0, 300, (12_000, 2))
    pts = np.round(pts[(np.abs(pts - 150) > 100).any(1)], 2)
    nodes = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(pts)), "x": pts[:, 0], "y": pts[:, 1], "v": np.arange(len(pts)) * 1.0}))
    asked = spark.range(150 * 150).select("id", ((F.col("id") % 150) * 2.0).alias("qx"), (F.expr("id div 150") * 2.0).alias("qy"))
    near = {r["id"]: [s["value"] for s in r["near"]] for r in nearest(asked, nodes, ["id"], 8, 1.0, F.col("v"), ["pid"]).collect()}
    assert len(near) == 150 * 150
    for i in rng.integers(0, 150 * 150, 300):
        d = (pts[:, 0] - (i % 150) * 2.0) ** 2 + (pts[:, 1] - (i // 150) * 2.0) ** 2
        assert near[i] == np.lexsort((np.arange(len(pts)), d))[:8].tolist()


def test_idw_weights(spark):
    df = spark.sql("select array(named_struct('d2', 1.0D, 'value', 10.0D), named_struct('d2', 4.0D, 'value', 20.0D)) near")
    assert df.select(idw(F.col("near"))).first()[0] == pytest.approx((10 + 20 / 4) / 1.25)


def test_models(cloud):
    spec = grid_of(cloud, 3.0)
    top = surfaces.surface_model(cloud, spec)
    low = surfaces.terrain_model(cloud, spec, k=4)
    z = as_array(low, "z", (spec.height, spec.width))
    assert np.nanmin(z) > 240 and np.nanmax(z) < 280
    high = as_array(top, "z", (spec.height, spec.width))
    assert not np.isnan(high).any()
    chm = as_array(surfaces.canopy_height(top, low), "z", (spec.height, spec.width))
    assert np.nanmin(chm) >= 0
    with pytest.raises(GridMismatchError):
        surfaces.canopy_height(top, low, grids=(spec, GridSpec(0, 0, 1, 1, 2, 2)))


def test_no_ground_falls_back(cloud):
    spec = grid_of(cloud, 5.0)
    assert surfaces.ground_nodes(cloud.where("classification = 5"), spec).count() > 0


def test_nearest_fill_and_holes(spark):
    a = np.array([[1.0, np.nan, np.nan, 4.0], [np.nan, np.nan, np.nan, np.nan]])
    got = as_array(surfaces.nearest_filled(as_raster(spark, a)), "z", a.shape)
    assert (got == [[1, 1, 4, 4], [1, 1, 4, 4]]).all()
    ring = np.zeros((7, 9), bool)
    ring[1:6, 1:6] = True
    ring[2:5, 2:5] = False
    ring[3, 8] = True
    df = as_raster(spark, ring.astype(float)).select("row", "col", (F.col("z") > 0).alias("m"))
    got = as_array(filled_holes(df, "m"), "m", ring.shape, bool)
    want = ring.copy()
    want[2:5, 2:5] = True
    assert (got == want).all()


def test_footprint_covers_points(cloud):
    spec = grid_of(cloud, 2.0)
    inside = {(r["row"], r["col"]) for r in surfaces.footprint(cloud, spec).collect()}
    assert {(r["row"], r["col"]) for r in surfaces.highest(cloud, spec).collect()} <= inside


def test_subtrees_and_components(spark):
    rng = np.random.default_rng(3)
    up = {i: int(rng.integers(0, i)) for i in range(1, 200)} | {0: None}
    size = dict.fromkeys(up, 0)
    for i in up:
        j = i
        while j is not None:
            size[j] += 1
            j = up[j]
    got = {r["node"]: r["n"] for r in subtree_sizes(spark.createDataFrame(list(up.items()), "node long, to long")).collect()}
    assert got == size
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (3, 2)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert roots[160] == 100 and roots[3] == 1 and len(roots) == 64


def test_imagery(cloud):
    spec = grid_of(cloud, 3.0)
    ortho = imagery.orthomosaic(cloud, spec, alpha=True, contrast=True)
    r = ortho.agg(F.min("r"), F.max("b"), F.min("a"), F.count("*")).first()
    assert r[0] >= 0 and r[1] <= 255 and r[2] == 255 and r[3] == spec.width * spec.height
    for name in imagery.INDICES:
        v = imagery.vegetation_index(ortho, name).agg(F.min("value"), F.max("value")).first()
        assert v[0] is not None and (name in ("TGI", "EXG") or -1 <= v[0] <= v[1] <= 1)
    with pytest.raises(ConfigurationError):
        imagery.vegetation_index(ortho, "NDVI")


def test_stretch_keeps_flat_bands(spark):
    df = spark.createDataFrame([(0, i, 7, i) for i in range(10)], "row long, col long, r int, g int")
    out = imagery.stretched(df, ["r", "g"]).orderBy("col").collect()
    assert {x["r"] for x in out} == {7} and out[-1]["g"] == 255
