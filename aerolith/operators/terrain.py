"""Morphology, contours and volumes of elevation rasters (z null: no data)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions.graph import components
from aerolith.functions.grid import every
from aerolith.functions.stencil import along, box3, down, gradient, unmasked
from aerolith.plans.storage import settle
from aerolith.schema import ConfigurationError, GridSpec, same_grid

#: What a stencil sees in a cell without data.
SENTINEL = -10000.0
#: Squares along a tile's side, within which contours are chained at first.
TILE = 128


def valid(raster: DataFrame, nodata: float | None = None, z: str = "z", floor: float = -500.0) -> DataFrame:
    """z null where it is nodata, not a number or not above the floor."""
    v = F.nanvl(F.col(z), F.lit(None).cast("double"))
    ok = v > floor
    return raster.withColumn(z, F.when(ok if nodata is None else ok & (v != nodata), v))


def _steepness(raster: DataFrame, spec: GridSpec, z_factor: float = 1.0, sentinel: float | None = SENTINEL) -> DataFrame:
    df = gradient(raster, sentinel=sentinel)
    gx, gy = F.col("gx") * z_factor / spec.res_x, F.col("gy") * z_factor / spec.res_y
    return df.withColumn("gx", gx).withColumn("gy", gy)


def hillshade(raster: DataFrame, spec: GridSpec, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    if not 0 <= azimuth <= 360 or not 0 < altitude <= 90:
        raise ConfigurationError("azimuth must be in [0, 360] and altitude in (0, 90]")
    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    df = _steepness(raster, spec, z_factor)
    slope = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    aspect = F.atan2(-F.col("gx"), F.col("gy"))
    light = F.lit(math.sin(alt)) * F.cos(slope) + F.lit(math.cos(alt)) * F.sin(slope) * F.cos(F.lit(az) - aspect)
    shade = F.floor(F.least(F.greatest(light * 254, F.lit(1.0)), F.lit(255.0))).cast("int")
    return df.select("row", "col", F.when(F.col("z").isNotNull(), shade).otherwise(0).alias("shade"))


def slope(raster: DataFrame, spec: GridSpec, units: str = "degrees") -> DataFrame:
    if units not in ("degrees", "percent"):
        raise ConfigurationError(f"slope in degrees or percent, not {units}")
    df = _steepness(raster, spec)
    angle = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    return df.select("row", "col", F.when(F.col("z").isNotNull(), F.degrees(angle) if units == "degrees" else F.tan(angle) * 100).alias("slope"))


def aspect(raster: DataFrame, spec: GridSpec) -> DataFrame:
    df = _steepness(raster, spec)
    a = F.degrees(F.atan2(-F.col("gx"), F.col("gy")))
    return df.select("row", "col", F.when(F.col("z").isNotNull(), F.when(a < 0, a + 360).otherwise(a) + 0.0).alias("aspect"))


def ruggedness(raster: DataFrame) -> DataFrame:
    """Root of the 3 x 3 mean of squared deviations from the 3 x 3 mean."""
    df = box3(raster.withColumn("_v", unmasked("z", SENTINEL)), "_v", "_m")
    df = df.withColumn("_d", (F.col("_v") - F.col("_m")) * (F.col("_v") - F.col("_m")))
    df = box3(df, "_d", "_t")
    return df.select("row", "col", F.when(F.col("z").isNotNull(), F.sqrt("_t")).alias("tri"))


def levels_of(raster: DataFrame, interval: float, base: float = 0.0, low: float | None = None, high: float | None = None) -> list[float]:
    """Contour levels between the raster's (or the given) ends."""
    if interval <= 0:
        raise ConfigurationError("the contour interval must be positive")
    ends = raster.agg(F.min("z"), F.max("z")).first()
    if ends[0] is None:
        return []
    z0, z1 = ends[0] if low is None else low, ends[1] if high is None else high
    start = math.ceil((z0 - base) / interval) * interval + base
    n = max(0, math.ceil((z1 + 0.1 * interval - start) / interval))
    return [start + i * interval for i in range(n)]


def contour_segments(raster: DataFrame, spec: GridSpec, interval: float = 1.0, base: float = 0.0, low: float | None = None, high: float | None = None, step: int = 1) -> DataFrame:
    """Marching squares: a row for each piece of an iso-line in a square of four cell centres.

    level and x1, y1, x2, y2, with a and b naming the grid edges that the ends lie on. Levels
    are listed per square between its own corners, so rows follow the relief. Saddles are
    decided by the mean of the corners; squares with a null corner give nothing.
    """
    src = every(raster, step)
    levels = levels_of(src, interval, base, low, high)
    if not levels:
        return raster.where("false").select(F.lit(0.0).alias("level"), *[F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit("").alias("a"), F.lit("").alias("b"))
    first, last = levels[0], len(levels) - 1
    df = src.withColumn("_e", F.lead("z").over(along())).withColumn("_t", F.struct("z", "_e")).withColumn("_b", F.lead("_t").over(down()))
    df = df.select("row", "col", F.col("z").alias("nw"), F.col("_e").alias("ne"), F.col("_b.z").alias("sw"), F.col("_b._e").alias("se")).where("nw IS NOT NULL AND ne IS NOT NULL AND sw IS NOT NULL AND se IS NOT NULL")
    lo, hi = F.least("nw", "ne", "sw", "se"), F.greatest("nw", "ne", "sw", "se")
    k0 = F.greatest(F.floor((lo - first) / interval) - 1, F.lit(0)).cast("int")
    k1 = F.least(F.ceil((hi - first) / interval) + 1, F.lit(last)).cast("int")
    df = df.where(k0 <= k1).withColumn("_k", F.explode(F.sequence(k0, k1))).withColumn("level", F.lit(first) + F.col("_k") * interval)
    df = df.withColumn("_case", sum((F.when(F.col(c) >= F.col("level"), 1 << i).otherwise(0) for i, c in enumerate(("nw", "ne", "se", "sw"))), F.lit(0))).where("_case NOT IN (0, 15)")
    df = df.withColumn("_mid", (F.col("nw") + F.col("ne") + F.col("sw") + F.col("se")) / 4 >= F.col("level"))
    cut = lambda a, b: (F.col("level") - F.col(a)) / (F.col(b) - F.col(a))
    r, c = F.col("row"), F.col("col")
    name = lambda kind, r, c: F.concat_ws(" ", F.lit(kind), r, c)
    point = lambda x, y, n: F.struct(x.cast("double").alias("c"), y.cast("double").alias("r"), n.alias("n"))
    sides = {"N": point(c + cut("nw", "ne"), r, name("h", r, c)), "S": point(c + cut("sw", "se"), r + 1, name("h", r + 1, c)), "W": point(c, r + cut("nw", "sw"), name("v", r, c)), "E": point(c + 1, r + cut("ne", "se"), name("v", r, c + 1))}
    pair = lambda a, b: F.struct(sides[a].alias("p"), sides[b].alias("q"))
    # bit 1 nw, 2 ne, 4 se, 8 sw lie at or above the level
    lines = {1: "WN", 14: "WN", 2: "NE", 13: "NE", 4: "ES", 11: "ES", 8: "SW", 7: "SW", 3: "WE", 12: "WE", 6: "NS", 9: "NS"}
    found = F.when(F.col("_case").isin(5, 10), F.when((F.col("_case") == 5) == F.col("_mid"), F.array(pair("N", "E"), pair("S", "W"))).otherwise(F.array(pair("W", "N"), pair("E", "S"))))
    for case, (a, b) in lines.items():
        found = found.when(F.col("_case") == case, F.array(pair(a, b)))
    out = df.select("level", F.explode(found).alias("s"))
    x = lambda p: F.lit(spec.min_x) + (F.col(f"s.{p}.c") + 0.5) * (spec.res_x * step)
    y = lambda p: F.lit(spec.max_y) - (F.col(f"s.{p}.r") + 0.5) * (spec.res_y * step)
    return out.select("level", x("p").alias("x1"), y("p").alias("y1"), x("q").alias("x2"), y("q").alias("y2"), F.col("s.p.n").alias("a"), F.col("s.q.n").alias("b"))


def _labelled(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile's segments with label, a node of the chain that they form within the tile, and whether nothing in the tile goes on at their ends."""
    n = len(pdf)
    named, names = pd.factorize(pd.concat([pdf["a"], pdf["b"]]))
    at, nodes = pd.factorize(np.tile(pd.factorize(pdf["level"])[0], 2).astype(np.int64) * len(names) + named)
    up = list(range(len(nodes)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    label = np.asarray(names)[nodes[[top(i) for i in at[:n].tolist()]] % len(names)]
    single = np.bincount(at)[at] == 1
    return pdf.drop(columns=["ti", "tj"]).assign(label=label, open_a=single[:n], open_b=single[n:])


def _chained(rows: list[tuple]) -> list[list[tuple[float, float]]]:
    """Lines of one connected set of segments (x1, y1, x2, y2, a, b), as vertex lists."""
    ends: dict[str, list[int]] = {}
    where: dict[str, tuple[float, float]] = {}
    for i, (x1, y1, x2, y2, a, b) in enumerate(rows):
        ends.setdefault(a, []).append(i)
        ends.setdefault(b, []).append(i)
        where[a], where[b] = (x1, y1), (x2, y2)
    used, lines = set(), []
    for start in sorted(ends, key=lambda n: (len(ends[n]) != 1, n)):  # open ends first, then rings
        for i in ends[start]:
            if i in used:
                continue
            path, at = [start], start
            while i is not None:
                used.add(i)
                at = rows[i][5] if rows[i][4] == at else rows[i][4]
                path.append(at)
                i = next((j for j in ends[at] if j not in used), None)
            lines.append([where[n] for n in path])
    return lines


def _table(made: list[tuple[float, list]]) -> pa.RecordBatch:
    places = np.array([p for _, line in made for p in line], dtype=np.float64).reshape(-1, 2)
    ends = np.cumsum([0] + [len(line) for _, line in made]).astype(np.int32)
    lines = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(places[:, k].copy()) for k in (0, 1)], ["x", "y"]))
    return pa.RecordBatch.from_arrays([pa.array([level for level, _ in made], pa.float64()), lines], ["level", "line"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains each root's segments, which arrive together; one line's segments are in memory at a time."""
    root, level, held, made, size = None, None, [], [], 0
    for batch in batches:
        for name, here, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and name != root:
                made += [(level, line) for line in _chained(held)]
                size, held = size + len(held), []
                if size > 20_000:
                    yield _table(made)
                    made, size = [], 0
            root, level = name, here
            held.append(tuple(row))
    if held:
        made += [(level, line) for line in _chained(held)]
    if made:
        yield _table(made)


def contour_lines(segments: DataFrame) -> DataFrame:
    """Segments joined end to end: level and line (array of x, y).

    A tile of TILE x TILE squares joins its own; only chains that go on in other tiles are linked by star steps.
    """
    tile = lambda k: F.expr(f"try_cast(element_at(split(a, ' '), {k}) AS long) div {TILE}")
    kinds = "level double, x1 double, y1 double, x2 double, y2 double, a string, b string, label string, open_a boolean, open_b boolean"
    tiled = segments.select(F.col("level").cast("double").alias("level"), "x1", "y1", "x2", "y2", "a", "b", tile(2).alias("ti"), tile(3).alias("tj"))
    seg = settle(tiled.groupBy("ti", "tj").applyInPandas(_labelled, kinds))
    chain = lambda c: F.concat_ws(" ", F.col("level").cast("string"), c)
    ends = seg.select("level", "label", F.explode(F.array(F.when(F.col("open_a"), F.col("a")), F.when(F.col("open_b"), F.col("b")))).alias("node")).where("node IS NOT NULL")
    edges = ends.groupBy("level", "node").agg(F.min("label").alias("u"), F.max("label").alias("v")).where("u <> v").select(chain("u").alias("u"), chain("v").alias("v"))
    roots = components(edges).withColumnRenamed("root", "_root")
    rows = seg.withColumn("node", chain("label")).join(roots, "node", "left").select(F.coalesce("_root", "node").alias("root"), "level", "x1", "y1", "x2", "y2", "a", "b")
    return rows.repartition("root").sortWithinPartitions("root").mapInArrow(_lines, "level double, line array<struct<x:double,y:double>>")


def _volumes(diff: DataFrame, area: float) -> DataFrame:
    d = F.col("d")
    some = lambda c: F.coalesce(c, F.lit(0.0))
    cut, fill = some(F.sum(F.when(d > 0, d))) * area, some(F.sum(F.when(d < 0, -d))) * area
    return diff.agg(
        cut.alias("cut_volume"),
        fill.alias("fill_volume"),
        (cut - fill).alias("net_volume"),
        (cut + fill).alias("total_volume"),
        (F.count("d") * area).alias("area"),
        some(F.avg("d")).alias("mean_height_diff"),
        some(F.max(F.when(d > 0, d))).alias("max_cut"),
        some(F.max(F.when(d < 0, -d))).alias("max_fill"),
        F.count("d").alias("valid_cells"),
    )


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.select("row", "col", F.col("z").alias("_b")).join(after.select("row", "col", F.col("z").alias("_a")), ["row", "col"])
    return both.select("row", "col", (F.col("_b") - F.col("_a")).alias("d"))


def cut_fill(before: DataFrame, after: DataFrame, spec: GridSpec, other: GridSpec | None = None) -> DataFrame:
    """One row of earthwork volumes, before less after; all 0 without common cells."""
    if other is not None:
        same_grid(spec, other)
    return _volumes(difference(before, after), spec.cell_area)


def stockpile(raster: DataFrame, spec: GridSpec, base: float | None = None) -> DataFrame:
    """Volumes above and below a base height, the raster's least if none is given."""
    if base is None:
        low = raster.agg(F.min("z").alias("_base"))
        return _volumes(raster.crossJoin(F.broadcast(low)).select((F.col("z") - F.col("_base")).alias("d")), spec.cell_area)
    return _volumes(raster.select((F.col("z") - base).alias("d")), spec.cell_area)


def summary(raster: DataFrame, spec: GridSpec) -> DataFrame:
    """One row: size, cell size, least, greatest and mean height."""
    r3 = lambda c: F.round(c, 3)
    return raster.agg(F.count("z").alias("valid_cells"), r3(F.min("z")).alias("min_z"), r3(F.max("z")).alias("max_z"), r3(F.avg("z")).alias("mean_z")).select(
        F.lit(spec.width).alias("width"), F.lit(spec.height).alias("height"), F.lit(spec.res_x).alias("res_x"), F.lit(spec.res_y).alias("res_y"), "*"
    )
