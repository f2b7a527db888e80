import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith.functions import quantiles
from aerolith.functions.grid import grid_of
from aerolith.operators import points as pc
from aerolith.schema import ConfigurationError, GridSpec, MissingColumnError, NoOverlapError


def test_profile(spark, cloud, cloud_arrays):
    r = pc.profile(cloud).first()
    z = cloud_arrays["z"]
    assert r["total_points"] == 3000 and r["min_z"] == z.min() and r["max_z"] == z.max()
    assert r["z_p50"] == pytest.approx(np.percentile(z, 50), abs=0.006)
    first = pc.profile(cloud, sample_limit=500).first()
    assert first["z_p95"] == pytest.approx(np.percentile(z[:500], 95), abs=0.006)


def test_counts(cloud, cloud_arrays):
    rows = {r["classification"]: r for r in pc.class_counts(cloud).collect()}
    assert rows[2]["label"] == "Ground" and rows[2]["n"] == (cloud_arrays["classification"] == 2).sum()
    assert sum(r["n"] for r in pc.return_counts(cloud).collect()) == 3000


def test_density_sums_to_points(cloud):
    spec = grid_of(cloud, 2.0)
    rows = pc.density(cloud, spec).collect()
    assert len(rows) == spec.width * spec.height
    assert sum(r["density"] for r in rows) * spec.cell_area == pytest.approx(3000)


def test_missing_column(spark):
    with pytest.raises(MissingColumnError):
        pc.class_counts(spark.range(3).selectExpr("id x"))


def test_strip_offset_and_merge(spark):
    rng = np.random.default_rng(101)
    n = 4000
    def strip(x0, dz):
        x, y = rng.uniform(x0, x0 + 80, n), rng.uniform(0, 50, n)
        z = 250 + 0.04 * x + 0.02 * y + rng.normal(0, 0.03, n) + dz
        return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z))], "pid long, x double, y double, z double")
    a, b = strip(0, 0.0), strip(40, 0.15)
    r = pc.strip_alignment(pc.strip_differences(a, b, 2.0)).first()
    assert r["median_offset"] == pytest.approx(-0.15, abs=0.08) and r["std_offset"] < 0.1
    merged = pc.merge_strips([a, b], [0.0, -0.15])
    assert merged.count() == 2 * n
    with pytest.raises(ConfigurationError):
        pc.merge_strips([a, b], [1.0])
    far = b.withColumn("x", b["x"] + 10_000)
    assert pc.strip_alignment(pc.strip_differences(a, far)).first()["sampled_cells"] == 0
    with pytest.raises(NoOverlapError):
        pc.strip_differences(a, far, raise_if_apart=True)


def test_clean_quantises_shift(spark):
    df = spark.createDataFrame([(i, 0.0, 0.0, 100.0 + i * 0.01) for i in range(100)] + [(100, 0.0, 0.0, 400.0)], "pid long, x double, y double, z double")
    out = pc.clean(df, shift=0.0126)
    assert out.count() == 100
    assert out.agg({"z": "min"}).first()[0] == pytest.approx(100.013)


def test_boxes():
    assert pc.intersection((100, 100, 200, 200), (150, 150, 250, 250)) == (150, 150, 200, 200)
    assert pc.intersection((0, 0, 1, 1), (2, 2, 3, 3)) is None
    assert GridSpec.over(0, 0, 0, 0, 1.0).width == 1


def test_corridor(cloud, cloud_arrays):
    got = pc.corridor(cloud, (500000.0, 5200030.0), (500060.0, 5200030.0), 4.0).count()
    assert got == (np.abs(cloud_arrays["y"] - 5200030) <= 2).sum()


def test_percentiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(0, 50, 3000), np.full(900, 7.25), [1e12, -1e9, 7.25 + 1e-9]])
    df = spark.createDataFrame(pd.DataFrame({"v": v})).unionByName(spark.createDataFrame([(None,)], "v double"))
    shares = [0.0, 0.003, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    for most in (100_000, 50):
        monkeypatch.setattr(quantiles, "MOST", most)
        assert quantiles.percentiles(df, "v", shares) == pytest.approx(np.quantile(v, shares).tolist())
    assert quantiles.percentiles(df.where("v IS NULL"), "v", [0.5]) is None
    assert quantiles.percentiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.1, 0.9]) == [3.0, 3.0]


@pytest.mark.parametrize("most", [100_000, 10])
def test_percentiles_compute_a_value_once_a_row(spark, monkeypatch, most):
    # before, each range's conditions repeated the column's whole expression
    monkeypatch.setattr(quantiles, "MOST", most)
    df = spark.range(20_000).select((F.sqrt("id") * 12345.678).alias("v"))
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    v = np.sqrt(np.arange(20_000)) * 12345.678
    shares = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    assert quantiles.percentiles(df, "v", shares) == pytest.approx(np.quantile(v, shares).tolist())
    assert plans and max(p.count("12345.678") for p in plans) == 1
