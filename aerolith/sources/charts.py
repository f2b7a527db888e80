"""Charts as SVG and rasters as PNG, from the tables that the operators give.

What a chart shows is thinned by Spark to a bounded number of marks before it comes to the driver.
"""

from __future__ import annotations

import struct
import zlib
from html import escape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions.grid import every
from aerolith.operators import points as pc
from aerolith.schema import ConfigurationError, EmptyRasterError, GridSpec, PointCloudError

#: Stops of the vegetation and of the difference colours.
VEGETATION = ("#7F4F24", "#DDA15E", "#E9D8A6", "#94D2BD", "#0A9396", "#005F73", "#1B4332")
DIFFERENCE = ("#2B5C8F", "#F7F7F7", "#C23B22")
#: Heights run from light to dark in one hue.
ELEVATION = ("#e8f1fb", "#2a78d6", "#0b2a52")
SERIES = ("#2a78d6", "#eb6834", "#1baf7a", "#eda100", "#e87ba4", "#008300", "#4a3aa7", "#e34948")
OTHER, ALERT, INK, QUIET, GRID, PAPER = "#9b9a93", "#e34948", "#0b0b0b", "#52514e", "#e4e3dd", "#fcfcfb"
PLACES = 1_000
CELLS = 800

WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM = 640, 340, 64, 20, 44, 46


def ramp(stops: tuple[str, ...], n: int = 256) -> np.ndarray:
    """n colours (n x 3 bytes) evenly between the stops."""
    rgb = np.array([[int(s[i : i + 2], 16) for i in (1, 3, 5)] for s in stops], float)
    at = np.linspace(0, len(stops) - 1, n)
    return np.rint(np.stack([np.interp(at, np.arange(len(stops)), rgb[:, k]) for k in range(3)], axis=1)).astype(np.uint8)


def _save(data: bytes, path: str) -> str:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_output_stream(at) as f:
        f.write(data)
    return path


def _ticks(lo: float, hi: float) -> list[float]:
    """About five round numbers between the ends."""
    raw = (hi - lo) / 5
    size = 10.0 ** np.floor(np.log10(raw))
    step = next(size * k for k in (1, 2, 5, 10) if size * k >= raw * 0.999)
    return [float(v) for v in np.arange(np.ceil(lo / step - 1e-9), np.floor(hi / step + 1e-9) + 1) * step]


def _text(x: float, y: float, words: str, anchor: str = "middle", colour: str = QUIET, size: int = 12, more: str = "") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" fill="{colour}" font-size="{size}" {more}>{escape(words)}</text>'


class Panel:
    """One plot with its axes; marks are added in the units of the data."""

    def __init__(self, title: str, x: tuple[float, float], y: tuple[float, float], x_name: str, y_name: str, x_ticks: bool = True):
        self.x, self.y = (((lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)) for lo, hi in (x, y))
        self.parts = [_text(LEFT, 22, title, "start", INK, 14, 'font-weight="600"'), _text((LEFT + WIDTH - RIGHT) / 2, HEIGHT - 8, x_name)]
        self.parts.append(_text(14, (TOP + HEIGHT - BOTTOM) / 2, y_name, more=f'transform="rotate(-90 14 {(TOP + HEIGHT - BOTTOM) / 2:.1f})"'))
        for v in _ticks(*self.y):
            self.parts.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{self.at_y(v):.1f}" y2="{self.at_y(v):.1f}" stroke="{GRID}"/>' + _text(LEFT - 6, self.at_y(v) + 4, f"{v:g}", "end", size=11))
        if x_ticks:
            self.parts += [_text(self.at_x(v), HEIGHT - BOTTOM + 16, f"{v:g}", size=11) for v in _ticks(*self.x)]

    def at_x(self, v: float) -> float:
        return LEFT + (v - self.x[0]) / (self.x[1] - self.x[0]) * (WIDTH - LEFT - RIGHT)

    def at_y(self, v: float) -> float:
        return HEIGHT - BOTTOM - (v - self.y[0]) / (self.y[1] - self.y[0]) * (HEIGHT - TOP - BOTTOM)

    def line(self, xs, ys, colour: str, name: str, dashed: bool = False) -> None:
        path = " ".join(f"{self.at_x(a):.1f},{self.at_y(b):.1f}" for a, b in zip(xs, ys, strict=True))
        self.parts.append(f'<polyline points="{path}" fill="none" stroke="{colour}" stroke-width="2" stroke-linejoin="round"{" stroke-dasharray=" + chr(34) + "6 4" + chr(34) if dashed else ""}><title>{escape(name)}</title></polyline>')

    def bar(self, x0: float, x1: float, v: float, told: str) -> None:
        a, b, top = self.at_x(x0) + 1, self.at_x(x1) - 1, self.at_y(v)
        self.parts.append(f'<rect x="{a:.1f}" y="{top:.1f}" width="{max(0.5, b - a):.1f}" height="{max(0.0, self.at_y(self.y[0]) - top):.1f}" fill="{SERIES[0]}"><title>{escape(told)}</title></rect>')

    def legend(self, names: list[tuple[str, str]]) -> None:
        step = (WIDTH - LEFT - RIGHT) / max(1, len(names))
        for k, (name, colour) in enumerate(names):
            self.parts.append(f'<rect x="{LEFT + k * step:.1f}" y="30" width="10" height="4" fill="{colour}"/>' + _text(LEFT + k * step + 14, 36, name, "start", size=11))


def _svg(panels: list[Panel], path: str, across: int = 1) -> str:
    down = -(-len(panels) // across)
    body = "".join(f'<g transform="translate({k % across * WIDTH} {k // across * HEIGHT})">{"".join(p.parts)}</g>' for k, p in enumerate(panels))
    w, h = across * WIDTH, down * HEIGHT
    return _save(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}" width="{w}" height="{h}" font-family="sans-serif"><rect width="{w}" height="{h}" fill="{PAPER}"/>{body}</svg>'.encode(), path)


def transect_chart(rows: DataFrame, path: str, title: str = "Elevation transects", threshold: float | None = None, places: int = PLACES) -> str:
    """Lines of transects (transect, seq, distance, z), each by at most about `places` evenly taken points; from the ninth on they are grey."""
    sizes = rows.groupBy("transect").agg(F.max("seq").alias("last"))
    last = sizes.agg(F.max("last")).first()[0]
    if last is None:
        raise EmptyRasterError("no transect to draw")
    found = rows.where(F.col("seq") % max(1, -(-(last + 1) // places)) == 0).select("transect", "seq", "distance", "z").toPandas().sort_values(["transect", "seq"])
    groups = list(found.groupby("transect"))
    heights = [*found["z"], *([threshold] if threshold is not None else [])]
    p = Panel(title, (0.0, float(found["distance"].max())), (float(min(heights)), float(max(heights))), "distance (m)", "height (m)")
    named = []
    for k, (name, g) in enumerate(groups):
        colour = SERIES[k] if k < len(SERIES) else OTHER
        p.line(g["distance"], g["z"], colour, f"transect {name}")
        if k < len(SERIES):
            named.append((f"{name}", colour))
            p.parts.append(_text(p.at_x(g["distance"].iloc[-1]) - 2, p.at_y(g["z"].iloc[-1]) - 6, f"{name}", "end", size=11))
    if len(groups) > len(SERIES):
        named.append((f"{len(groups) - len(SERIES)} others", OTHER))
    if threshold is not None:
        p.line(p.x, (threshold, threshold), ALERT, f"threshold {threshold:g}", dashed=True)
        named.append((f"threshold {threshold:g}", ALERT))
    p.legend(named if len(named) > 1 else [])
    return _svg([p], path)


def histogram_chart(bins: DataFrame, path: str, title: str = "Residuals", unit: str = "m") -> str:
    """Density and cumulative share of a histogram's bins, one panel each."""
    rows = bins.orderBy("bin").collect()
    if not rows:
        raise PointCloudError("nothing to draw")
    ends = (rows[0]["low"], rows[-1]["high"])
    a = Panel(title, ends, (0.0, max(r["density"] for r in rows)), unit, "density")
    b = Panel("Cumulative share", ends, (0.0, 1.0), unit, "share")
    for r in rows:
        a.bar(r["low"], r["high"], r["density"], f"{r['low']:.4g} to {r['high']:.4g}: {r['n']}")
    b.line([r["high"] for r in rows], [r["cumulative"] for r in rows], SERIES[0], "cumulative share")
    return _svg([a, b], path, 2)


def cloud_chart(points: DataFrame, path: str) -> str:
    """Classes, return numbers, heights by percentile and summary numbers of a cloud, in four panels."""
    one = pc.profile(points).first().asDict()
    if not one["total_points"]:
        raise PointCloudError("the cloud has no points")
    classes, returns = pc.class_counts(points).orderBy("classification").collect(), pc.return_counts(points).orderBy("return_number").collect()

    def bars(title: str, what: str, rows: list[tuple[str, int]]) -> Panel:
        p = Panel(title, (0.0, float(len(rows))), (0.0, float(max(n for _, n in rows))), what, "points", False)
        for k, (name, n) in enumerate(rows):
            p.bar(k + 0.1, k + 0.9, n, f"{name}: {n}")
            p.parts.append(_text(p.at_x(k + 0.5), HEIGHT - BOTTOM + 16, name, size=11))
        return p

    shares = [(int(k.removeprefix("z_p")), v) for k, v in one.items() if k.startswith("z_p")]
    heights = Panel("Heights by percentile", (0.0, 100.0), (min(v for _, v in shares), max(v for _, v in shares)), "percentile", "height (m)")
    heights.line([k for k, _ in shares], [v for _, v in shares], SERIES[0], "height")
    facts = Panel.__new__(Panel)
    facts.parts = [_text(LEFT, 22, "Summary", "start", INK, 14, 'font-weight="600"')]
    told = [(k, v) for k, v in one.items() if not k.startswith("z_p")]
    for k, (name, v) in enumerate(told):
        facts.parts += [_text(LEFT, 52 + 22 * k, name.replace("_", " "), "start"), _text(WIDTH - RIGHT, 52 + 22 * k, f"{v:,.2f}" if isinstance(v, float) else f"{v:,}", "end", INK)]
    return _svg([bars("Classes", "class", [(str(r["classification"]), r["n"]) for r in classes]), bars("Returns", "return number", [(str(r["return_number"]), r["n"]) for r in returns]), heights, facts], path, 2)


def png(rgb: np.ndarray) -> bytes:
    """Rows x columns x 3 bytes as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((rgb.shape[0], 1), np.uint8), rgb.reshape(rgb.shape[0], -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def raster_image(raster: DataFrame, spec: GridSpec, path: str, stops: tuple[str, ...] = ELEVATION, ends: tuple[float, float] | None = None, flag: str | None = None, cells: int = CELLS) -> str:
    """A raster's z as a PNG of at most about cells x cells pixels; voids are paper white, cells with the flag column set are red.

    Values are spread between `ends`, by default the extremes of what is drawn.
    """
    if ends is not None and ends[1] <= ends[0]:
        raise ConfigurationError(f"colours from {ends[0]} to {ends[1]}")
    step = max(1, -(-max(spec.width, spec.height) // cells))
    small = spec.coarser(step)
    got = every(raster, step).select("row", "col", "z", *([flag] if flag else [])).toPandas()
    z = np.full((small.height, small.width), np.nan)
    at = got["row"].to_numpy(np.int64), got["col"].to_numpy(np.int64)
    z[at] = got["z"].to_numpy(np.float64)
    there = np.isfinite(z)
    if not there.any():
        raise EmptyRasterError("no valid cell to draw")
    lo, hi = ends or (z[there].min(), z[there].max())
    share = np.clip((np.where(there, z, lo) - lo) / (hi - lo if hi > lo else 1.0), 0, 1)
    rgb = ramp(stops)[np.rint(share * 255).astype(int)]
    rgb[~there] = ramp((PAPER, PAPER), 1)[0]
    if flag:
        red = np.zeros(z.shape, bool)
        red[at] = got[flag].fillna(False).to_numpy(bool)
        rgb[red] = ramp((ALERT, ALERT), 1)[0]
    return _save(png(rgb), path)
