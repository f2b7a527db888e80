import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith.functions.stencil import dilated_diamond
from aerolith.operators import control as cp
from aerolith.operators import quality as qc
from aerolith.operators import rectify
from aerolith.schema import ControlPointError, GridSpec

from survey_cases import as_array, as_raster, dem_array


def survey(spark, n=4000, size=100.0, bias=0.0):
    rng = np.random.default_rng(7)
    x, y = rng.uniform(0, size, n), rng.uniform(0, size, n)
    z = 100 + 0.05 * x + 0.02 * y + bias
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(n), "x": x, "y": y, "z": z, "classification": np.full(n, 2, np.int32)}))


def targets(spark):
    spots = [("G1", 20, 20, 0, "GCP"), ("G2", 80, 20, 0, "GCP"), ("G3", 50, 50, 0, "GCP"), ("C1", 20, 80, 0, "CHECK"), ("GCP_OUTLIER", 80, 80, -0.75, "GCP")]
    return spark.createDataFrame([(i, float(x), float(y), 100 + 0.05 * x + 0.02 * y + d, t) for i, x, y, d, t in spots], "point_id string, x double, y double, z double, point_type string")


def test_one_blunder_is_found(spark):
    r = cp.accuracy(cp.cloud_residuals(survey(spark), targets(spark), radius=5.0)).first()
    assert (r["total_points"], r["gcp_points"], r["check_points"]) == (5, 4, 1)
    assert r["outlier_ids"] == ["GCP_OUTLIER"] and not r["passed"]
    assert abs(r["suggested_shift"]) < 0.05


def test_direct_hit_takes_the_point(spark):
    pts = spark.createDataFrame([(1, 5.0, 5.0, 42.0, 2), (2, 5.5, 5.0, 50.0, 2)], "pid long, x double, y double, z double, classification int")
    gcp = spark.createDataFrame([("A", 5.0, 5.0, 42.0, "GCP"), ("far", 900.0, 5.0, 1.0, "GCP")], "point_id string, x double, y double, z double, point_type string")
    rows = cp.cloud_residuals(pts, gcp).collect()
    assert len(rows) == 1 and rows[0]["z_surface"] == 42.0 and rows[0]["status"] == "PASS"


def test_residuals_of_dense_clouds_write_few_rows(spark):
    # before, every point within the radius was written for every control point
    rng = np.random.default_rng(3)
    n, k, radius = 20_000, 6, 4.0
    x, y, pid = np.r_[rng.uniform(0, 10, n), 60.0], np.r_[rng.uniform(0, 10, n), 60.0], np.arange(n + 1)
    z = np.sin(x) + y
    pts = spark.createDataFrame(pd.DataFrame({"pid": pid, "x": x, "y": y, "z": z, "classification": np.full(n + 1, 2, np.int32)})).repartition(4).cache()
    pts.count()
    spots = [(f"p{i}", 3.0 + i % 4, 5.0, float(i)) for i in range(200)] + [("thin", 60.0, 59.0, 1.0), ("corner", -2.0, -2.0, 1.0), ("none", 30.0, 30.0, 1.0), ("twice", 5.0, 6.0, 1.0), ("twice", 5.0, 6.0, 1.0)]
    gcp = spark.createDataFrame([(*s, "GCP") for s in spots], "point_id string, x double, y double, z double, point_type string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = {r["point_id"]: r for r in cp.cloud_residuals(pts, gcp, radius, k).collect()}
    assert written() - before < 1_000_000
    assert set(got) == {s[0] for s in spots} - {"none"} and got["thin"]["neighbours"] == 1
    for name, gx, gy, gz in spots:
        if name in got:
            d2 = (x - gx) ** 2 + (y - gy) ** 2
            m = 2 if name == "twice" else 1  # a control point given twice meets each point twice, as in the SQL
            at = np.repeat(np.argsort(d2, kind="stable")[: (d2 < radius**2).sum()][:k], m)[:k]
            w = 1 / np.maximum(d2[at], 1e-8)
            assert got[name]["delta"] == pytest.approx((z[at] * w).sum() / w.sum() - gz)


def test_raster_control(spark):
    spec = GridSpec(0.0, 100.0, 1.0, 1.0, 100, 100)
    dem = as_raster(spark, np.full((100, 100), 100.0))
    gcp = spark.createDataFrame([("a", 10.5, 10.5, 100.0, "GCP"), ("b", 50.5, 50.5, 100.02, "GCP"), ("c", 90.5, 90.5, 99.98, "CHECK")], "point_id string, x double, y double, z double, point_type string")
    r = cp.accuracy(cp.raster_residuals(dem, spec, gcp)).first()
    assert r["rmse"] < 0.03 and r["passed"]
    with pytest.raises(ControlPointError):
        cp.validate(cp.raster_residuals(dem, spec, gcp.withColumn("x", F.col("x") + 1e6)))


def test_noisy_cloud_is_found_and_healed(spark):
    clean = survey(spark, 5000, 50.0)
    noisy = clean.withColumn("z", F.when(F.col("pid") < 20, F.col("z") + 150).otherwise(F.col("z")))
    report = qc.inspect(noisy, epsg=None)
    codes = {i.code for i in report.issues}
    assert {"LAS_CRS_MISSING", "LAS_MULTIPATH_NOISE"} <= codes and report.status == "CRITICAL" and report.score == 65
    healed = qc.remediate(noisy, report)
    again = qc.inspect(healed, epsg=report.suggested["assign_crs"])
    assert again.score == 100 and again.status == "HEALTHY"
    assert json.loads(report.as_json())["score"] == 65 and "LAS_CRS_MISSING" in report.as_markdown()


def test_biased_cloud(spark):
    report = qc.inspect_cloud(survey(spark, 8000, bias=-0.18), 32632, control=targets(spark).where("point_id <> 'GCP_OUTLIER'"))
    assert [i.code for i in report.issues] == ["GCP_VERTICAL_DATUM_SHIFT"] and report.issues[0].severity == "CRITICAL"
    assert report.suggested["z_shift"] == pytest.approx(0.18, abs=0.02)


def test_defective_raster(spark):
    a = 300 + 0.05 * np.arange(60)[None, :] + 0.03 * np.arange(60)[:, None]
    a[25:35, 25:35] = np.nan
    a[10, 10] += 50
    spec = GridSpec(0.0, 60.0, 1.0, 1.0, 60, 60)
    dem = as_raster(spark, a)
    report = qc.inspect(dem, spec)
    assert {"DEM_VOID_POCKETS", "DEM_ELEVATION_SPIKES"} <= {i.code for i in report.issues}
    healed = qc.remediate(dem, spec=spec)
    got = as_array(healed, "z", a.shape)
    assert not np.isnan(got).any() and got.max() < 320
    assert qc.inspect(healed, spec).score >= 95
    empty = qc.inspect(as_raster(spark, np.full((3, 3), np.nan)), GridSpec(0, 3, 1, 1, 3, 3))
    assert empty.score == 0 and empty.issues[0].code == "DEM_EMPTY"


def test_anomalies(spark):
    a = dem_array(40, 40)
    spec = GridSpec(0.0, 40.0, 1.0, 1.0, 40, 40)
    smooth = qc.anomaly_counts(qc.anomalies(as_raster(spark, a), spec, step=2)).first()
    assert smooth["spikes"] == 0
    a[20, 20] += 400
    found = qc.anomalies(as_raster(spark, a), spec, step=2)
    r = qc.anomaly_counts(found).first()
    assert r["spikes"] in (1, 2) and r["cliffs"] >= 4 and 0 < r["pct"] < 100


def test_rectified_bump(spark):
    a = 300 + 0.05 * np.arange(80)[None, :] + 0.03 * np.arange(80)[:, None]
    truth = a.copy()
    a[36:44, 36:44] += 30
    spec = GridSpec(0.0, 80.0, 1.0, 1.0, 80, 80)
    mask = spark.createDataFrame([(r, c) for r in range(5, 15) for c in range(5, 15)], "row long, col long")
    delta = rectify.surface(as_raster(spark, a), spec, mask, step=4, sigma=2.0)
    d = as_array(delta, "delta_z", (20, 20))
    assert d[9:11, 9:11].max() < -15 and d[0, 0] == 0
    pts = spark.createDataFrame([(1, 40.5, 40.5, 330.0), (2, 2.5, 2.5, 300.0)], "pid long, x double, y double, z double")
    out = {r["pid"]: r for r in rectify.apply_surface(pts, delta, spec.coarser(4)).collect()}
    assert out[1]["corrected"] and out[1]["z"] < 315 and not out[2]["corrected"]
    few = dilated_diamond(as_raster(spark, truth).withColumn("m", F.lit(False)), "m", 2).where("m")
    assert rectify.fit_plane(few) is None
    coeff, centre = rectify.fit_plane(as_raster(spark, truth), 2)
    assert coeff[1] == pytest.approx(0.05, abs=1e-6) and coeff[2] == pytest.approx(0.03, abs=1e-6)


def test_given_masks_and_voids_are_left_as_they_are(spark):
    """A given mask does not grow, and no cell without data belongs to mask, growth or ring."""
    a = 100 + np.add.outer(np.arange(30) * 0.1, np.arange(30) * 0.2)
    a[14:17, 18:21] = np.nan
    a[15, 15] += 9
    spec = GridSpec(0.0, 30.0, 1.0, 1.0, 30, 30)
    mask = spark.createDataFrame([(15, 15), (15, 18)], "row long, col long")
    out = rectify.surface(as_raster(spark, a), spec, mask=mask, step=1).where("delta_z <> 0").collect()
    assert [(r["row"], r["col"]) for r in out] == [(15, 15)] and out[0]["delta_z"] < 0
    a[15, 15] = 2000
    out = rectify.surface(as_raster(spark, a), spec, step=1, threshold=130.0).where("delta_z <> 0").collect()
    moved = {(r["row"], r["col"]) for r in out}
    assert len(moved) > 50 and all(abs(r - 15) + abs(c - 15) <= 8 and not np.isnan(a[r, c]) for r, c in moved)


def test_reports(spark):
    rows = [(f"P{i}", "CHECK" if i % 2 else "GCP", float(i), 1.0, 10.0, 10.0 + d, d, 6, "PASS") for i, d in enumerate((0.20, 0.21, 0.19, 0.20, 1.50))]
    found = spark.createDataFrame(rows, "point_id string, point_type string, x double, y double, z double, z_surface double, delta double, neighbours int, status string")
    report = cp.report(found, "field.las", "CLOUD")
    told = report.as_dict()
    assert (told["total_points"], told["num_gcps"], told["num_checkpoints"], told["passed_tolerance"]) == (5, 3, 2, False)
    assert told["mean_bias_z_m"] == 0.46 and told["recommended_z_shift_m"] == -0.2 and [p["point_id"] for p in told["outliers"]] == ["P4"]
    assert json.loads(report.as_json())["residuals"][0]["point_id"] == "P0"
    assert report.as_markdown().count("\n| P") == 5 and "failed" in report.as_markdown()
    assert "outlier P4" in report.as_text() and "-0.2000" in report.as_text()
    with pytest.raises(ControlPointError):
        cp.report(found.where("z < 0"), "none", "CLOUD")
    audit = qc.Audit("cloud", 75.0, "CRITICAL", [qc.Issue("LAS_CRS_MISSING", "CRITICAL", "no coordinate system", 25, {"assign_crs": 32632})], {"n": 3, "density": 2.5})
    assert "75 of 100" in audit.as_text() and "LAS_CRS_MISSING" in audit.as_text() and "2.50" in audit.as_text()
