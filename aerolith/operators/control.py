"""Control points: residuals against a cloud or a raster, and accuracy statistics."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.grid import cell_of
from aerolith.operators.surfaces import ground_points
from aerolith.plans.storage import settle
from aerolith.schema import ControlPointError, GridSpec

#: Places of control points that are sent to every task whole, each to nine buckets.
PLACES = 50_000


def _status(tolerance: float) -> Column:
    off = F.abs("delta")
    return F.when(off <= tolerance, "PASS").when(off <= 1.5 * tolerance, "WARNING").otherwise("FAIL")


def _nearest_within(cloud: DataFrame, places: DataFrame, radius: float, k: int) -> DataFrame:
    """gx, gy and near: the k nearest points nearer than radius, in order of (d2, pid, z); places without any are absent.

    A place is first asked within a reach that holds about 4 k points at the cloud's mean density, and again within four times
    that only while it lacks k. A task keeps k points a place before the shuffle, so what is written does not grow with the density.
    """
    x0, x1, y0, y1, n = cloud.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    area = (x1 - x0) * (y1 - y0) if n and None not in (x0, y0) else 0.0
    reach, found = min(radius, math.sqrt(4 * k * area / (math.pi * n))) if area > 0 else radius, []
    places = settle(places)
    while True:
        side = reach * (1 + 1e-6)  # rounding never puts a point within reach two buckets away
        bucket = lambda c: F.floor(F.col(c) / side).cast("long")  # noqa: B023, E731
        near = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
        asked = places.withColumn("_i", F.explode(F.transform(near, lambda d: bucket("gx") + d))).withColumn("_j", F.explode(F.transform(near, lambda d: bucket("gy") + d)))
        asked = F.broadcast(asked) if places.count() <= PLACES else asked
        dx, dy = F.col("x") - F.col("gx"), F.col("y") - F.col("gy")
        hits = cloud.select("pid", "x", "y", "z", bucket("x").alias("_i"), bucket("y").alias("_j")).join(asked, ["_i", "_j"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") < reach * reach)
        rank = F.row_number().over(Window.partitionBy("gx", "gy").orderBy("d2", "pid", "z"))
        kept = hits.select("gx", "gy", "d2", "pid", "z", rank.alias("_rank")).where(F.col("_rank") <= k)
        lists = settle(kept.groupBy("gx", "gy").agg(F.sort_array(F.collect_list(F.struct("d2", "pid", "z"))).alias("near")))
        if reach >= radius:
            return reduce(DataFrame.unionByName, [*found, lists])
        found.append(lists.where(F.size("near") >= k))
        places = settle(places.join(found[-1], ["gx", "gy"], "left_anti"))
        if places.isEmpty():
            return reduce(DataFrame.unionByName, found)
        reach = min(radius, 4 * reach)


def cloud_residuals(points: DataFrame, control: DataFrame, radius: float = 2.5, k: int = 6, tolerance: float = 0.05, ground_only: bool = True) -> DataFrame:
    """Height of the k nearest (ground) points within the radius against each control point; others drop out.

    Each place is asked once however many control points lie there; a control point given m times counts each point m times.
    """
    cloud = ground_points(points) if ground_only else points
    asked = control.groupBy("point_id", "point_type", F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz")).agg(F.count("*").cast("int").alias("_m"))
    near = _nearest_within(cloud, asked.select("gx", "gy").where("gx IS NOT NULL AND gy IS NOT NULL").distinct(), radius, k)
    lists = asked.join(near, ["gx", "gy"]).withColumn("near", F.slice(F.flatten(F.transform("near", lambda s: F.array_repeat(s, F.col("_m")))), 1, k))
    first = F.get("near", F.lit(0))
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda a, s: a + f(s))
    height = F.when(first["d2"] < 1e-8, first["z"]).otherwise(total(lambda s: s["z"] / F.greatest(s["d2"], F.lit(1e-8))) / total(lambda s: 1.0 / F.greatest(s["d2"], F.lit(1e-8))))
    out = lists.withColumn("z_surface", height).withColumn("delta", F.col("z_surface") - F.col("gz"))
    return out.select("point_id", "point_type", F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"), "z_surface", "delta", F.size("near").alias("neighbours"), _status(tolerance).alias("status"))


def raster_residuals(raster: DataFrame, spec: GridSpec, control: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Height of the cell under each control point; points outside or over voids drop out."""
    left, bottom, right, top = spec.bounds
    row, col = cell_of(spec)
    inside = control.where((F.col("x") >= left) & (F.col("x") < right) & (F.col("y") > bottom) & (F.col("y") <= top)).withColumn("row", row).withColumn("col", col)
    out = inside.join(raster.select("row", "col", F.col("z").alias("z_surface")).where("z_surface IS NOT NULL"), ["row", "col"])
    out = out.withColumn("delta", F.col("z_surface") - F.col("z"))
    return out.select("point_id", "point_type", "x", "y", "z", "z_surface", "delta", F.lit(1).alias("neighbours"), _status(tolerance).alias("status"))


def judged(residuals: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Residuals with outlier: far from the median by the median absolute deviation, and over the tolerance."""
    residuals = settle(residuals)  # one row a control point, read three times
    base = residuals.agg(F.percentile("delta", F.lit(0.5)).alias("_med"), F.stddev_samp("delta").alias("_std"), F.count("*").alias("_n"))
    one = residuals.crossJoin(F.broadcast(base))
    mad = one.agg(F.percentile(F.abs(F.col("delta") - F.col("_med")), F.lit(0.5)).alias("_mad"))
    one = one.crossJoin(F.broadcast(mad))
    std = F.coalesce("_std", F.lit(0.0))
    sigma = F.when(F.col("_mad") > 1e-4, F.col("_mad") * 1.4826).when(std > 1e-4, std).otherwise(0.05)
    off, d = F.abs(F.col("delta") - F.col("_med")), F.abs("delta")
    far = (off > F.greatest(2.5 * sigma, F.lit(1.5 * tolerance))) | ((d > 3 * tolerance) & (off > 2 * tolerance))
    return one.withColumn("outlier", (F.col("_n") >= 3) & far & (d > tolerance)).drop("_med", "_std", "_n", "_mad")


def accuracy(residuals: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row of accuracy statistics. rmse, bias and shift are null without residuals."""
    d = F.col("delta")
    rmse = F.sqrt(F.avg(d * d))
    out = judged(residuals, tolerance).agg(
        F.count("*").alias("total_points"),
        F.sum(F.when(F.col("point_type") == "GCP", 1).otherwise(0)).alias("gcp_points"),
        F.sum(F.when(F.col("point_type") == "CHECK", 1).otherwise(0)).alias("check_points"),
        rmse.alias("rmse"),
        F.avg(d).alias("bias"),
        F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std"),
        (rmse * 1.96).alias("accuracy_95"),
        F.min(d).alias("min_delta"),
        F.max(d).alias("max_delta"),
        F.sum(F.when(F.col("outlier"), 1).otherwise(0)).alias("outliers"),
        F.coalesce(-F.avg(F.when(~F.col("outlier"), d)), -F.avg(d)).alias("suggested_shift"),
        F.array_sort(F.collect_list(F.when(F.col("outlier"), F.col("point_id")))).alias("outlier_ids"),
    )
    return out.withColumn("passed", (F.col("rmse") <= tolerance) & (F.col("outliers") == 0))


def validate(residuals: DataFrame, tolerance: float = 0.05) -> DataFrame:
    out = accuracy(residuals, tolerance)
    if not out.first()["total_points"]:
        raise ControlPointError("no control point overlaps the data")
    return out


#: Keys of a report's numbers and the statistics that they hold.
REPORTED = {
    "total_points": "total_points",
    "num_gcps": "gcp_points",
    "num_checkpoints": "check_points",
    "rmse_z_m": "rmse",
    "mean_bias_z_m": "bias",
    "std_dev_z_m": "std",
    "accuracy_95_nssda_m": "accuracy_95",
    "min_delta_z_m": "min_delta",
    "max_delta_z_m": "max_delta",
    "passed_tolerance": "passed",
    "recommended_z_shift_m": "suggested_shift",
}


@dataclass
class AccuracyReport:
    """Accuracy of one data set against its control points, as a dictionary, JSON, Markdown or text for a terminal."""

    dataset: str
    kind: str
    tolerance: float
    stats: dict
    points: list[dict]

    def as_dict(self) -> dict:
        short = lambda v: round(v, 4) if isinstance(v, float) else v
        numbers = {k: short(self.stats[c]) for k, c in REPORTED.items()}
        return {"dataset": self.dataset, "kind": self.kind, "target_tolerance_m": self.tolerance} | numbers | {"outliers": [p for p in self.points if p["outlier"]], "residuals": self.points}

    def as_json(self) -> str:
        return json.dumps(self.as_dict(), indent=2, default=str)

    def _measures(self) -> list[tuple[str, float]]:
        return [(name, self.stats[k]) for name, k in (("RMSE", "rmse"), ("bias", "bias"), ("standard deviation", "std"), ("95 % confidence", "accuracy_95"), ("least residual", "min_delta"), ("largest residual", "max_delta"))]

    def _verdict(self) -> str:
        return "passed" if self.stats["passed"] else "failed"

    def as_markdown(self) -> str:
        s = self.stats
        out = [f"# Vertical accuracy: {self.dataset}", "", f"{self.kind}, {s['total_points']} points ({s['gcp_points']} control, {s['check_points']} check), tolerance {self.tolerance:g} m: **{self._verdict()}**", "", "| measure | m | cm |", "|-|-|-|"]
        out += [f"| {name} | {v:.4f} | {v * 100:.2f} |" for name, v in self._measures()]
        if abs(s["bias"]) > self.tolerance:
            out += ["", f"A shift of {s['suggested_shift']:+.4f} m takes the bias away."]
        out += ["", "| point | type | x | y | surveyed | measured | residual cm | status | outlier |", "|-|-|-|-|-|-|-|-|-|"]
        out += [f"| {p['point_id']} | {p['point_type']} | {p['x']:.2f} | {p['y']:.2f} | {p['z']:.3f} | {p['z_surface']:.3f} | {p['delta'] * 100:+.2f} | {p['status']} | {'yes' if p['outlier'] else ''} |" for p in self.points]
        return "\n".join(out) + "\n"

    def as_text(self) -> str:
        s = self.stats
        out = [f"Vertical accuracy of {self.dataset} ({self.kind}): {self._verdict()}", f"{s['total_points']} points, {s['gcp_points']} control and {s['check_points']} check, tolerance {self.tolerance * 100:.1f} cm"]
        out += [f"  {name:<20}{v * 100:+9.2f} cm" for name, v in self._measures()]
        out += [f"  outlier {p['point_id']} ({p['point_type']}): {p['delta'] * 100:+.1f} cm" for p in self.points if p["outlier"]]
        if abs(s["bias"]) > self.tolerance:
            out.append(f"  suggested shift {s['suggested_shift']:+.4f} m")
        out += [f"  {p['point_id']:<12} {p['point_type']:<6} {p['x']:>12.2f} {p['y']:>12.2f} {p['z']:>9.3f} {p['z_surface']:>9.3f} {p['delta'] * 100:+8.2f} {p['status']}" for p in self.points]
        return "\n".join(out) + "\n"


def report(residuals: DataFrame, dataset: str, kind: str, tolerance: float = 0.05) -> AccuracyReport:
    """The report on residuals; it lists every control point of the survey, so these come to the driver."""
    residuals = settle(residuals)
    stats = validate(residuals, tolerance).first().asDict()
    points = [r.asDict() for r in judged(residuals, tolerance).orderBy("point_id").collect()]
    return AccuracyReport(dataset, kind, tolerance, stats, points)
