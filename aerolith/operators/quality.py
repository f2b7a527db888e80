"""Quality control of clouds and rasters: anomalies, audits, repair."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.grid import every
from aerolith.functions.quantiles import percentiles
from aerolith.functions.stencil import dilated_diamond, gradient, median3
from aerolith.operators import control as cp
from aerolith.operators import points as pc
from aerolith.operators.surfaces import nearest_filled
from aerolith.plans.storage import settle
from aerolith.schema import GridSpec

LEVELS = ("HEALTHY", "INFO", "WARNING", "CRITICAL")


def anomalies(raster: DataFrame, spec: GridSpec, spike: float | None = None, pit: float | None = None, slope: float = 45.0, step: int = 4, grow: int = 6) -> DataFrame:
    """row, col of the coarser grid with spike, pit, cliff and anomaly (grown, valid cells only).

    Without a spike (pit) height the 99.7th (0.3th) percentile is one if the extreme lies
    over 15 beyond it, else none is found.
    """
    src = settle(every(raster, step).withColumn("z", F.when((F.col("z") > -500) & (F.col("z") < 9000), F.col("z"))))
    top, bottom = percentiles(src, "z", [0.997, 0.003]) or (0.0, 0.0) if spike is None or pit is None else (0.0, 0.0)
    ends = src.agg(F.max("z").alias("hi"), F.min("z").alias("lo"))
    high = F.lit(spike) if spike is not None else F.when(F.col("hi") - top > 15, F.lit(top)).otherwise(F.col("hi") + 1)
    low = F.lit(pit) if pit is not None else F.when(bottom - F.col("lo") > 15, F.lit(bottom)).otherwise(F.col("lo") - 1)
    limits = ends.select(high.alias("_high"), low.alias("_low"))
    coarse = spec.coarser(step)
    df = gradient(src).withColumn("gx", F.col("gx") / coarse.res_x).withColumn("gy", F.col("gy") / coarse.res_y).crossJoin(F.broadcast(limits))
    yes = lambda c: F.coalesce(c, F.lit(False))
    angle = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))
    df = df.withColumn("spike", yes(F.col("z") > F.col("_high"))).withColumn("pit", yes(F.col("z") < F.col("_low"))).withColumn("cliff", yes(angle > slope))
    df = df.withColumn("_valid", F.col("z").isNotNull()).withColumn("anomaly", F.col("spike") | F.col("pit") | F.col("cliff"))
    df = dilated_diamond(df, "anomaly", grow).withColumn("anomaly", F.col("anomaly") & F.col("_valid"))
    return df.select("row", "col", "spike", "pit", "cliff", "anomaly", F.col("_valid").alias("valid"))


def anomaly_counts(found: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("long"))
    out = found.agg(n("spike").alias("spikes"), n("cliff").alias("cliffs"), n("anomaly").alias("anomalous"), n("valid").alias("valid_cells"))
    return out.withColumn("pct", F.when(F.col("valid_cells") > 0, F.col("anomalous") * 100.0 / F.greatest("valid_cells", F.lit(1))).otherwise(0.0))


@dataclass
class Issue:
    code: str
    severity: str
    message: str
    penalty: float
    suggested: dict = field(default_factory=dict)


@dataclass
class Audit:
    kind: str
    score: float
    status: str
    issues: list[Issue]
    metrics: dict

    @property
    def suggested(self) -> dict:
        """All issues' suggestions, later ones first in precedence."""
        out: dict = {}
        for i in self.issues:
            out |= i.suggested
        return out

    def as_dict(self) -> dict:
        return asdict(self) | {"suggested": self.suggested}

    def as_json(self) -> str:
        return json.dumps(self.as_dict(), indent=2, default=str)

    def as_markdown(self) -> str:
        lines = [f"# Quality report: {self.kind}", "", f"Score {self.score:.0f} of 100, status {self.status}", "", "| code | severity | penalty | message |", "|-|-|-|-|"]
        lines += [f"| {i.code} | {i.severity} | {i.penalty:g} | {i.message} |" for i in self.issues]
        return "\n".join([*lines, "", "| metric | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in self.metrics.items())]) + "\n"

    def as_text(self) -> str:
        out = [f"Quality of the {self.kind}: {self.score:.0f} of 100, {self.status}"]
        out += [f"  {k:<24} {v:,.2f}" if isinstance(v, float) else f"  {k:<24} {v}" for k, v in self.metrics.items()]
        out += [f"  {i.severity:<9}{i.code}: {i.message}; try {i.suggested}" for i in self.issues] or ["  no defects"]
        return "\n".join(out) + "\n"


def audit_rows(spark: SparkSession, audit: Audit) -> DataFrame:
    """An audit as a table: a row for each issue, and one of code SCORE with the status and what is left of 100."""
    rows = [(i.code, i.severity, float(i.penalty)) for i in audit.issues] + [("SCORE", audit.status, float(audit.score))]
    return spark.createDataFrame(rows, "code string, severity string, points double")


def _audit(kind: str, issues: list[Issue], metrics: dict, score: float | None = None) -> Audit:
    score = max(0.0, min(100.0, 100.0 - sum(i.penalty for i in issues))) if score is None else score
    status = max((i.severity for i in issues), key=LEVELS.index, default="HEALTHY")
    return Audit(kind, score, status, issues, metrics)


def cloud_metrics(points: DataFrame) -> DataFrame:
    """One row: what the audit of a cloud reads. A label with a 2 in it counts as ground, as overlap (12) does."""
    p1, p99 = (F.lit(v).cast("double") for v in percentiles(points, "z", [0.01, 0.99]) or (None, None))
    label = pc.class_name(F.col("classification"))
    ground = F.sum(F.when(label.contains("Ground") | F.concat_ws(" ", label, F.col("classification").cast("string")).contains("2"), 1).otherwise(0))
    noisy = (F.col("z") > p99 + 3 * (p99 - p1)) | (F.col("z") < p1 - 3 * (p99 - p1))
    area = F.greatest(F.lit(1.0), (F.max("x") - F.min("x")) * (F.max("y") - F.min("y")))
    n = F.count("*")
    return points.agg(
        n.alias("total_points"),
        (n / area).alias("density"),
        (ground * 100.0 / n).alias("ground_pct"),
        F.max(p1).alias("z_p1"),
        F.max(p99).alias("z_p99"),
        F.sum(F.when(noisy, 1).otherwise(0)).alias("noise_points"),
        F.min("z").alias("min_z"),
        F.max("z").alias("max_z"),
    )


def _control_issues(stats: dict, tolerance: float, cloud: bool) -> list[Issue]:
    out = []
    if not stats["passed"]:
        bias = stats["bias"]
        if abs(bias) > tolerance:
            tips = {"z_shift": stats["suggested_shift"]} | ({"auto_shift_z": True} if cloud else {})
            out.append(Issue("GCP_VERTICAL_DATUM_SHIFT", "CRITICAL" if abs(bias) > 0.15 else "WARNING", f"heights are off by {bias:+.3f}", 25, tips))
        else:
            out.append(Issue("GCP_ACCURACY_EXCEEDS_TOLERANCE", "WARNING", f"rmse {stats['rmse']:.3f} over {tolerance}", 15, {"target_tolerance_m": tolerance}))
    if stats["outliers"]:
        out.append(Issue("GCP_OUTLIER_BLUNDER", "WARNING", f"{stats['outliers']} control points are far off", 10, {"suspect_gcp_ids": stats["outlier_ids"]}))
    return out


def inspect_cloud(points: DataFrame, epsg: int | None, expected: int | None = None, control: DataFrame | None = None, tolerance: float = 0.05) -> Audit:
    """Audit of a point cloud; the rules run on one row of metrics."""
    m = cloud_metrics(points).first().asDict()
    issues = []
    if epsg is None:
        issues.append(Issue("LAS_CRS_MISSING", "CRITICAL", "no coordinate system", 25, {"assign_crs": expected or 32632}))
    if m["noise_points"]:
        iqr, pct = m["z_p99"] - m["z_p1"], m["noise_points"] * 100.0 / m["total_points"]
        bad = pct > 1
        issues.append(
            Issue("LAS_MULTIPATH_NOISE", "CRITICAL" if bad else "WARNING", f"{m['noise_points']} points far above or below the rest", 20 if bad else 10, {"clean_outliers": True, "z_min_cutoff": m["z_p1"] - 1.5 * iqr, "z_max_cutoff": m["z_p99"] + 1.5 * iqr, "sor_k_neighbors": 10, "sor_std_multiplier": 2.0})
        )
    if m["total_points"]:
        if m["ground_pct"] < 0.1:
            issues.append(Issue("LAS_UNCLASSIFIED", "CRITICAL", "no classified ground", 30, {"classify_ground": True, "algorithm": "progressive_tin", "cell_size": 1.0}))
        elif m["ground_pct"] / 100 * m["density"] < 0.5:
            issues.append(Issue("LAS_LOW_GROUND_DENSITY", "WARNING", "few ground points", 15, {"k_neighbors": 14, "max_search_radius_m": 5.0, "smoothing_regularization": 0.5}))
    if control is not None:
        found = cp.cloud_residuals(points, control, tolerance=tolerance)
        stats = cp.accuracy(found, tolerance).first().asDict()
        if stats["total_points"]:
            issues += _control_issues(stats, tolerance, True)
            m |= {f"gcp_{k}": stats[k] for k in ("rmse", "bias", "outliers", "passed")}
    return _audit("cloud", issues, m)


def raster_metrics(raster: DataFrame, sentinel: float | None = -9999.0) -> DataFrame:
    """One row: cells, voids and spikes (differences over 15 a cell, void rims included)."""
    g = gradient(raster, sentinel=sentinel)
    steep = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) > 15
    return g.agg(
        F.count("*").alias("cells"),
        F.count("z").alias("valid_cells"),
        ((F.count("*") - F.count("z")) * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("void_pct"),
        F.sum(F.when(F.col("z").isNotNull() & steep, 1).otherwise(0)).alias("spikes"),
        F.min("z").alias("min_z"),
        F.max("z").alias("max_z"),
        F.avg("z").alias("mean_z"),
    )


def inspect_raster(raster: DataFrame, spec: GridSpec, control: DataFrame | None = None, tolerance: float = 0.05, sentinel: float | None = -9999.0) -> Audit:
    m = raster_metrics(raster, sentinel).first().asDict()
    if not m["valid_cells"]:
        return _audit("raster", [Issue("DEM_EMPTY", "CRITICAL", "no valid cell", 100)], m, 0.0)
    issues = []
    if spec.epsg is None:
        issues.append(Issue("DEM_CRS_MISSING", "CRITICAL", "no coordinate system", 25, {"assign_crs": 32632}))
    if m["void_pct"] > 1.5:
        bad = m["void_pct"] > 15
        issues.append(Issue("DEM_VOID_POCKETS", "CRITICAL" if bad else "WARNING", f"{m['void_pct']:.1f} % of the cells are void", 25 if bad else 10, {"fill_voids": True, "method": "distance_transform", "max_void_radius_px": 20}))
    if m["spikes"]:
        issues.append(Issue("DEM_ELEVATION_SPIKES", "WARNING", f"{m['spikes']} cells differ from their neighbours by over 15", 15, {"despike_filter": True, "median_kernel_size": 3, "spike_threshold_m": 12.0}))
    if control is not None:
        stats = cp.accuracy(cp.raster_residuals(raster, spec, control, tolerance), tolerance).first().asDict()
        if stats["total_points"]:
            issues += _control_issues(stats, tolerance, False)
    return _audit("raster", issues, m)


def heal(raster: DataFrame, fill: bool = True, despike: bool = True, threshold: float = 10.0) -> DataFrame:
    """Voids from the nearest valid cell, then cells over threshold from the 3 x 3 median take the median."""
    out = nearest_filled(raster) if fill else raster
    if despike:
        out = median3(out, "z", "_m").withColumn("z", F.when(F.abs(F.col("z") - F.col("_m")) > threshold, F.col("_m")).otherwise(F.col("z"))).drop("_m")
    return out.select("row", "col", "z")


def assigned(spec: GridSpec, assign_crs: int | None = None) -> GridSpec:
    """The grid of a repaired raster: it gets the coordinate system if it has none."""
    return spec if spec.epsg is not None or assign_crs is None else replace(spec, epsg=assign_crs)


def cloud_crs(epsg: int | None = None, report: Audit | None = None, assign_crs: int | None = None) -> int:
    """The coordinate system to write a repaired cloud with: its own, the one asked for, the report's, or UTM 32N."""
    return epsg or assign_crs or (report.suggested.get("assign_crs") if report else None) or 32632


def inspect(data: DataFrame, spec: GridSpec | None = None, **options) -> Audit:
    """Audit of a cloud, or of a raster when its grid is given."""
    return inspect_raster(data, spec, **options) if spec is not None else inspect_cloud(data, **options)


def remediate(data: DataFrame, report: Audit | None = None, spec: GridSpec | None = None, **options) -> DataFrame:
    """Repair with the report's suggestions; arguments come before them."""
    if spec is not None:
        return heal(data, **options)
    tips = report.suggested if report else {}
    args = {"low": tips.get("z_min_cutoff"), "high": tips.get("z_max_cutoff"), "shift": tips.get("z_shift", 0.0)} | options
    return pc.clean(data, **args)


correct = remediate
