"""GeoTIFF rasters: a reader that gives tasks strips or tiles, and writers of one striped file or of a file a tile.

Baseline TIFF and BigTIFF, uncompressed, LZW or deflate, with or without a predictor, 8 to 64 bit, north-up.
Other compressions raise an error that names them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.plans.storage import settle
from aerolith.schema import FormatError, GridMismatchError, GridSpec, NotSupportedError
from aerolith.sources import tiff_codecs as codecs

#: Fixed values of the TIFF specification: bytes and struct letters of field types.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
FORMATS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


@dataclass(frozen=True)
class Layout:
    spec: GridSpec
    bands: int
    dtype: str
    compression: int
    predictor: int
    blocks: list[tuple[int, int, int, int, int, int]]  # offset, bytes, row, col, rows, cols


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(at)


def read_layout(path: str) -> Layout:
    with _open(path) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
        if magic not in (42, 43):
            raise FormatError(f"{path} is not a TIFF file")
        wide = magic == 43  # BigTIFF: offsets and counts of eight bytes
        long, room = ("Q", 8) if wide else ("I", 4)
        at = struct.unpack_from(order + long, head, room)[0]
        n, size_n = (struct.unpack(order + "Q", f.read_at(8, at))[0], 8) if wide else (struct.unpack(order + "H", f.read_at(2, at))[0], 2)
        entry = 4 + 2 * room
        raw, tags = f.read_at(entry * n, at + size_n), {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + long, raw, entry * i)
            if kind not in TYPES:
                continue
            size, letter = TYPES[kind]
            here = entry * i + 4 + room
            data = raw[here : here + room] if size * count <= room else f.read_at(size * count, struct.unpack_from(order + long, raw, here)[0])
            tags[tag] = data[:count] if kind == 2 else struct.unpack(order + letter * count, data[: size * count])
    width, height = tags[256][0], tags[257][0]
    bands, compression = tags.get(277, (1,))[0], tags.get(259, (1,))[0]
    if compression not in (codecs.NONE, codecs.LZW, codecs.DEFLATE, codecs.OLD_DEFLATE):
        raise NotSupportedError(f"{path} has TIFF compression {compression}; none, LZW and deflate can be read")
    if tags.get(317, (1,))[0] not in (1, 2, 3):
        raise NotSupportedError(f"{path} uses predictor {tags[317][0]}")
    if tags.get(284, (1,))[0] != 1:
        raise NotSupportedError(f"{path} keeps its bands apart")
    dtype = FORMATS.get((tags.get(339, (1,))[0], tags.get(258, (1,))[0]))
    if dtype is None:
        raise NotSupportedError(f"{path} has {tags.get(258)} bits of sample format {tags.get(339)}")
    blocks = []
    if 324 in tags:
        tw, th = tags[322][0], tags[323][0]
        across = -(-width // tw)
        blocks = [(o, b, k // across * th, k % across * tw, th, tw) for k, (o, b) in enumerate(zip(tags[324], tags[325], strict=True))]
    else:
        rows = min(tags.get(278, (height,))[0], height)
        blocks = [(o, b, k * rows, 0, min(rows, height - k * rows), width) for k, (o, b) in enumerate(zip(tags[273], tags[279], strict=True))]
    res, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    keys = tags.get(34735, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), None)
    nodata = float(tags[42113].split(b"\0")[0]) if 42113 in tags else None
    spec = GridSpec(tie[3] - tie[0] * res[0], tie[4] + tie[1] * res[1], res[0], res[1], width, height, epsg, nodata)
    return Layout(spec, bands, order + dtype, compression, tags.get(317, (1,))[0], blocks)


def _names(bands: int) -> list[str]:
    return ["z"] if bands == 1 else [f"b{i + 1}" for i in range(bands)]


def _cells(f, lay: Layout, block: tuple[int, int, int, int, int, int], step: int = 1) -> pd.DataFrame:
    """The cells of one block; nodata as NaN."""
    o, n, r, c, rows, cols = (int(v) for v in block)
    raw = codecs.unpacked(f.read_at(n, o), lay.compression)
    a = codecs.samples(raw, lay.dtype, (rows, cols, lay.bands), lay.predictor if lay.compression != codecs.NONE else 1).astype(np.float64)
    a = a[: max(0, lay.spec.height - r), : max(0, lay.spec.width - c)]
    rr, cc = np.meshgrid(np.arange(r, r + a.shape[0]), np.arange(c, c + a.shape[1]), indexing="ij")
    keep = (rr % step == 0) & (cc % step == 0)
    out = {"row": (rr[keep] // step).astype(np.int64), "col": (cc[keep] // step).astype(np.int64)}
    for i, name in enumerate(_names(lay.bands)):
        v = a[:, :, i][keep]
        out[name] = np.where(v == lay.spec.nodata, np.nan, v) if lay.spec.nodata is not None else v
    return pd.DataFrame(out)


def _typed(blocks: DataFrame, cells, bands: int) -> DataFrame:
    names = _names(bands)
    df = blocks.mapInPandas(cells, "row long, col long, " + ", ".join(f"{n} double" for n in names))
    return df.select("row", "col", *[F.nanvl(F.col(n), F.lit(None).cast("double")).alias(n) for n in names])


def read_geotiff(spark: SparkSession, path: str, step: int = 1) -> tuple[DataFrame, GridSpec]:
    """row, col, z (one band) or b1, b2, ... of all cells, nodata and NaN as null; every step-th cell only, if asked."""
    lay = read_layout(path)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _open(path) as f:
            for pdf in batches:
                for block in pdf.itertuples(index=False):
                    yield _cells(f, lay, block, step)

    blocks = spark.createDataFrame(pd.DataFrame(lay.blocks, columns=["o", "n", "r", "c", "rows", "cols"])).repartition(max(1, min(len(lay.blocks), 2 * spark.sparkContext.defaultParallelism)))
    return _typed(blocks, cells, lay.bands), lay.spec if step == 1 else lay.spec.coarser(step)


def read_tiles(spark: SparkSession, folder: str) -> tuple[DataFrame, GridSpec]:
    """The cells of all GeoTIFFs of a folder that share cell size and bands, on the grid over them all.

    Headers and cells are read in tasks; the driver sees the names of the files and one row of bounds.
    """
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".tif"))
    if not names:
        raise FormatError(f"no GeoTIFF in {folder}")
    files = spark.createDataFrame([(f"{folder}/{n}",) for n in names], "file string").repartition(min(len(names), 2 * spark.sparkContext.defaultParallelism))
    one = read_layout(f"{folder}/{names[0]}")
    dx, dy, bands = one.spec.res_x, one.spec.res_y, one.bands

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lays = [read_layout(p) for p in pdf["file"]]
            yield pd.DataFrame([(*s.bounds, s.res_x == dx and s.res_y == dy and lay.bands == bands) for lay in lays for s in (lay.spec,)], columns=["x0", "y0", "x1", "y1", "same"])

    x, y0, x1, y, same = files.mapInPandas(corners, "x0 double, y0 double, x1 double, y1 double, same boolean").agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.min("same")).first()
    if not same:
        raise GridMismatchError(f"the GeoTIFFs of {folder} differ in cell size or bands")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["file"]:
                lay = read_layout(path)
                down, right = round((y - lay.spec.max_y) / dy), round((lay.spec.min_x - x) / dx)
                with _open(path) as f:
                    for block in lay.blocks:
                        out = _cells(f, lay, block)
                        yield out.assign(row=out["row"] + down, col=out["col"] + right)

    return _typed(files, cells, bands), GridSpec(x, y, dx, dy, round((x1 - x) / dx), round((y - y0) / dy), one.spec.epsg, one.spec.nodata)


def _directory(spec: GridSpec, bands: int, dtype: str, compression: int, nodata: float, strip: int, sizes: list[int], first: int, at: int, big: bool) -> bytes:
    """The tags of strips that lie one after the other from first on, to be written at the place at."""
    fmt, bits = {v: k for k, v in FORMATS.items()}[dtype]
    long, room, word = ("Q", 8, 16) if big else ("I", 4, 4)
    offsets = [first + int(v) for v in np.cumsum([0, *sizes[:-1]])]
    tags = [
        (256, 4, (spec.width,)),
        (257, 4, (spec.height,)),
        (258, 3, (bits,) * bands),
        (259, 3, (compression,)),
        (262, 3, (2 if bands >= 3 else 1,)),
        (273, word, offsets),
        (277, 3, (bands,)),
        (278, 4, (strip,)),
        (279, word, sizes),
        (284, 3, (1,)),
        (339, 3, (fmt,) * bands),
        (33550, 12, (spec.res_x, spec.res_y, 0.0)),
        (33922, 12, (0.0, 0.0, 0.0, spec.min_x, spec.max_y, 0.0)),
    ]
    if spec.epsg:
        tags.append((34735, 3, (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, spec.epsg)))
    tags.append((42113, 2, f"{nodata:g}".encode() + b"\0"))
    count = struct.pack("<Q" if big else "<H", len(tags))
    entries, extra = [], b""
    behind = at + len(count) + len(tags) * (4 + 2 * room) + room
    for number, kind, values in tags:
        data = values if kind == 2 else struct.pack("<" + TYPES[kind][1] * len(values), *values)
        if len(data) > room:
            place = struct.pack("<" + long, behind + len(extra))
            extra += data + b"\0" * (len(data) % 2)
            data = place
        entries.append(struct.pack("<HH" + long, number, kind, len(values)) + data.ljust(room, b"\0"))
    return count + b"".join(entries) + struct.pack("<" + long, 0) + extra


def _head(at: int, big: bool) -> bytes:
    return b"II" + (struct.pack("<HHHQ", 43, 8, 0, at) if big else struct.pack("<HI", 42, at))


def _block(pdf: pd.DataFrame, columns: list[str], shape: tuple[int, int], row: int, col: int, dtype: str, nodata: float) -> np.ndarray:
    """The cells of a frame as rows, columns and bands, nodata where there are none."""
    a = np.full((*shape, len(columns)), nodata, dtype)
    for i, c in enumerate(columns):
        v = pdf[c].to_numpy(np.float64)
        a[(pdf["row"] - row).to_numpy(), (pdf["col"] - col).to_numpy(), i] = np.where(np.isnan(v), nodata, v)
    return a


def _open_output(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_output_stream(at)


def _inside(raster: DataFrame, spec: GridSpec, columns: list[str]) -> DataFrame:
    return raster.select("row", "col", *columns).where(F.col("row").between(0, spec.height - 1) & F.col("col").between(0, spec.width - 1))


def _check(dtype: str, compression: int) -> None:
    if dtype not in FORMATS.values():
        raise NotSupportedError(f"samples of type {dtype}")
    if compression not in (codecs.NONE, codecs.LZW, codecs.DEFLATE):
        raise NotSupportedError(f"TIFF compression {compression}")


def write_geotiff(raster: DataFrame, spec: GridSpec, path: str, columns: list[str] | None = None, dtype: str = "f4", nodata: float = -10000.0, strip: int = 64, compression: int = codecs.DEFLATE) -> str:
    """Write one striped GeoTIFF, a BigTIFF where 4 GB do not hold it.

    Strips are made and compressed in tasks and pass the driver one after the other; for rasters beyond
    one file take write_tiles, whose files never pass it.
    """
    columns = columns or ["z"]
    _check(dtype, compression)
    width, height, bands = spec.width, spec.height, len(columns)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        a = _block(pdf, columns, (min(strip, height - k * strip), width), k * strip, 0, dtype, nodata)
        return pd.DataFrame({"k": [k], "data": [codecs.packed(a.tobytes(), compression)]})

    rows = _inside(raster, spec, columns).withColumn("k", F.expr(f"row div {strip}L"))
    strips = settle(rows.groupBy("k").applyInPandas(pack, "k long, data binary"))
    n = -(-height // strip)
    void = lambda k: codecs.packed(np.full((min(strip, height - k * strip), width, bands), nodata, dtype).tobytes(), compression)
    blank = {min(strip, height - k * strip): void(k) for k in {0, n - 1}}
    known = {r["k"]: r["n"] for r in strips.select("k", F.length("data").alias("n")).toLocalIterator()}  # one number a strip
    sizes = [known.get(k, len(blank[min(strip, height - k * strip)])) for k in range(n)]
    big = sum(sizes) + 24 * n + 4096 > 0xFFFFFFFF
    first = 16 if big else 8
    at = first + sum(sizes) + sum(sizes) % 2
    with _open_output(path) as f:
        f.write(_head(at, big))
        k = 0
        for r in strips.orderBy("k").toLocalIterator():
            while k < r["k"]:
                f.write(blank[min(strip, height - k * strip)])
                k += 1
            f.write(bytes(r["data"]))
            k += 1
        while k < n:
            f.write(blank[min(strip, height - k * strip)])
            k += 1
        f.write(b"\0" * (sum(sizes) % 2))
        f.write(_directory(spec, bands, dtype, compression, nodata, strip, sizes, first, at, big))
    return path


def write_tiles(raster: DataFrame, spec: GridSpec, folder: str, columns: list[str] | None = None, dtype: str = "f4", nodata: float = -10000.0, tile: int = 2048, compression: int = codecs.DEFLATE) -> DataFrame:
    """Write a georeferenced GeoTIFF a tile that has cells, each in its own task; (file, row, col) of each tile's first cell.

    A tile's file has a fixed name, so a task that runs again writes the same file. Tiles without cells have no file.
    """
    columns = columns or ["z"]
    _check(dtype, compression)

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = int(pdf["tr"].iloc[0]) * tile, int(pdf["tc"].iloc[0]) * tile
        rows, cols = min(tile, spec.height - r), min(tile, spec.width - c)
        part = GridSpec(spec.min_x + c * spec.res_x, spec.max_y - r * spec.res_y, spec.res_x, spec.res_y, cols, rows, spec.epsg, nodata)
        data = codecs.packed(_block(pdf, columns, (rows, cols), r, c, dtype, nodata).tobytes(), compression)
        data += b"\0" * (len(data) % 2)
        name = f"{folder}/{r}_{c}.tif"
        with _open_output(name) as f:
            f.write(_head(8 + len(data), False) + data + _directory(part, len(columns), dtype, compression, nodata, rows, [len(data)], 8, 8 + len(data), False))
        return pd.DataFrame({"file": [name], "row": [r], "col": [c]})

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    store.create_dir(at, recursive=True)
    rows = _inside(raster, spec, columns).withColumn("tr", F.expr(f"row div {tile}L")).withColumn("tc", F.expr(f"col div {tile}L"))
    return settle(rows.groupBy("tr", "tc").applyInPandas(save, "file string, row long, col long"))
