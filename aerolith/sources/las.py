"""LAS point clouds: a splittable reader as a Spark data source, a header reader and a writer.

Records have a fixed width, so each task reads a range of them. Only fields of the public LAS
specification (formats 0-3 and 6-8) are read. Compressed clouds (LAZ) need a decoder that
is not here and raise an error that says so.
"""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from aerolith.schema import POINT, FormatError, NotSupportedError

RECORDS = 500_000
#: Records that are encoded or decoded at a time.
STEP = 100_000
#: Fields of a point record by offset, from the LAS specification.
OLD = {"X": ("<i4", 0), "Y": ("<i4", 4), "Z": ("<i4", 8), "intensity": ("<u2", 12), "flags": ("u1", 14), "classification": ("u1", 15), "source": ("<u2", 18)}
NEW = {"X": ("<i4", 0), "Y": ("<i4", 4), "Z": ("<i4", 8), "intensity": ("<u2", 12), "flags": ("u1", 14), "classification": ("u1", 16), "source": ("<u2", 20)}
TIME_AT = {1: 20, 3: 20, 6: 22, 7: 22, 8: 22}
COLOUR_AT = {2: 20, 3: 28, 7: 30, 8: 30}
SIZE = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}


@dataclass(frozen=True)
class Header:
    version: str
    point_format: int
    record_length: int
    offset: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    mins: tuple[float, float, float]
    maxs: tuple[float, float, float]
    epsg: int | None

    @property
    def has_colour(self) -> bool:
        return self.point_format in COLOUR_AT

    @property
    def has_time(self) -> bool:
        return self.point_format in TIME_AT


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(at)


def read_header(path: str) -> Header:
    with _open(path) as f:
        raw = f.read_at(375, 0)
        if raw[:4] != b"LASF" or len(raw) < 227:
            raise FormatError(f"{path} is not a LAS file")
        head_size, offset, n_vlr, fmt, length, old_count = struct.unpack_from("<HIIBHI", raw, 94)
        if fmt & 0xC0:
            raise NotSupportedError(f"{path} is compressed (LAZ); decompress it to LAS first")
        if fmt not in SIZE:
            raise NotSupportedError(f"{path} has point format {fmt}; formats {sorted(SIZE)} can be read")
        scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
        ends = struct.unpack_from("<6d", raw, 179)
        major, minor = raw[24], raw[25]
        count = struct.unpack_from("<Q", raw, 247)[0] if (major, minor) >= (1, 4) and len(raw) >= 255 and not old_count else old_count
        vlrs, epsg, at = f.read_at(offset - head_size, head_size), None, 0
    for _ in range(n_vlr):
        if at + 54 > len(vlrs):
            break
        record, size = struct.unpack_from("<HH", vlrs, at + 18)
        body, at = vlrs[at + 54 : at + 54 + size], at + 54 + size
        if record == 34735:  # GeoTIFF keys
            keys = struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2])
            epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), epsg)
        elif record == 2112:
            found = re.findall(rb'"EPSG"\s*,\s*"?(\d+)', body)
            epsg = int(found[-1]) if found else epsg
    return Header(f"{major}.{minor}", fmt, length, offset, count, scale, shift, (ends[1], ends[3], ends[5]), (ends[0], ends[2], ends[4]), epsg)


def bounds(path: str) -> dict:
    h = read_header(path)
    return {"min": h.mins, "max": h.maxs, "points": h.count, "scale": h.scale, "offset": h.shift, "version": h.version, "point_format": h.point_format, "epsg": h.epsg}


def _dtype(h: Header) -> np.dtype:
    fields = dict(NEW if h.point_format >= 6 else OLD)
    if h.has_time:
        fields["gps_time"] = ("<f8", TIME_AT[h.point_format])
    if h.has_colour:
        fields |= {c: ("<u2", COLOUR_AT[h.point_format] + 2 * i) for i, c in enumerate(("red", "green", "blue"))}
    return np.dtype({"names": list(fields), "formats": [t for t, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": h.record_length})


@dataclass
class Part(InputPartition):
    path: str
    header: Header
    first: int
    count: int
    strip: str

    def __post_init__(self) -> None:
        super().__init__(self.first)


class LasReader(DataSourceReader):
    def __init__(self, paths: list[str], records: int):
        self.paths, self.records = paths, records

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            h = read_header(path)
            out += [Part(path, h, i, min(self.records, h.count - i), path.rpartition("/")[2]) for i in range(0, h.count, self.records)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        h, step = part.header, STEP
        with _open(part.path) as f:
            for i in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - i)
                raw = np.frombuffer(f.read_at(n * h.record_length, h.offset + i * h.record_length), _dtype(h))
                if len(raw) < n:
                    raise FormatError(f"{part.path} ends after {i + len(raw)} of {h.count} points")
                wide = h.point_format >= 6
                nothing = pa.nulls(n, pa.int32())
                cols = [
                    pa.array(np.arange(i, i + n, dtype=np.int64)),
                    pa.array([part.strip] * n, pa.string()),
                    *[pa.array(raw[c] * h.scale[k] + h.shift[k]) for k, c in enumerate("XYZ")],
                    pa.array((raw["classification"] if wide else raw["classification"] & 31).astype(np.int32)),
                    pa.array((raw["flags"] & (15 if wide else 7)).astype(np.int32)),
                    pa.array((raw["flags"] >> 4 if wide else raw["flags"] >> 3 & 7).astype(np.int32)),
                    pa.array(raw["intensity"].astype(np.int32)),
                    *[pa.array(raw[c].astype(np.int32)) if h.has_colour else nothing for c in ("red", "green", "blue")],
                    pa.array(raw["gps_time"]) if h.has_time else pa.nulls(n, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=POINT.names)


class LasSource(DataSource):
    """spark.read.format("las").option("records", n).load(path): path may hold several, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> StructType:
        return POINT

    def reader(self, schema: StructType) -> LasReader:
        return LasReader([p for p in self.options.get("path", "").split(",") if p], int(self.options.get("records", RECORDS)))


def read_las(spark: SparkSession, *paths: str, records: int = RECORDS) -> DataFrame:
    spark.dataSource.register(LasSource)
    return spark.read.format("las").option("records", records).load(",".join(paths))


def _format(point_format: int | None, coloured: bool, timed: bool) -> int:
    fmt = 2 * coloured + timed if point_format is None else point_format
    if fmt not in SIZE:
        raise NotSupportedError(f"point format {fmt}; formats {sorted(SIZE)} can be written")
    return fmt


def _layout(fmt: int, n: int = 0, epsg: int | None = None, scale: float = 0.001, shift: tuple = (0.0,) * 3, mins: tuple = (0.0,) * 3, maxs: tuple = (0.0,) * 3) -> Header:
    return Header("1.4" if fmt >= 6 else "1.2", fmt, SIZE[fmt], 0, n, (scale,) * 3, tuple(shift), tuple(mins), tuple(maxs), epsg)


def _records(h: Header, n: int, classification=None, return_number=None, number_of_returns=None, intensity=None, colour=None, gps_time=None) -> np.ndarray:
    """Point records without their places."""
    rec = np.zeros(n, _dtype(h))
    some = lambda v, default: np.full(n, default) if v is None else np.asarray(v)
    rec["classification"] = some(classification, 0)
    rec["flags"] = some(return_number, 1) | some(number_of_returns, 1) << (4 if h.point_format >= 6 else 3)
    rec["intensity"] = some(intensity, 0)
    if h.has_time:
        rec["gps_time"] = some(gps_time, 0.0)
    if h.has_colour and colour is not None:
        for i, c in enumerate(("red", "green", "blue")):
            rec[c] = colour[i]
    return rec


def _place(rec: np.ndarray, h: Header, *places: np.ndarray) -> np.ndarray:
    for k, v in enumerate(places):
        rec["XYZ"[k]] = np.rint((v - h.shift[k]) / h.scale[k])
    return rec


def _head(h: Header) -> bytes:
    """All that comes before the records."""
    wide, vlr = h.point_format >= 6, b""
    if h.epsg is not None:
        keys = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, h.epsg)
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys
    size = 375 if wide else 227
    head = bytearray(size)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 4 if wide else 2))
    head[8:24] = uuid.UUID(int=0).bytes
    struct.pack_into("<HIIBHI", head, 94, size, size + len(vlr), 1 if vlr else 0, h.point_format, h.record_length, 0 if wide else h.count)
    struct.pack_into("<3d3d", head, 131, *h.scale, *h.shift)
    struct.pack_into("<6d", head, 179, *[v for ends in zip(h.maxs, h.mins, strict=True) for v in ends])
    if wide:
        struct.pack_into("<Q", head, 247, h.count)
    return bytes(head) + vlr


def encode(x: np.ndarray, y: np.ndarray, z: np.ndarray, classification=None, return_number=None, number_of_returns=None, intensity=None, colour=None, epsg: int | None = None, scale: float = 0.001, gps_time=None, point_format: int | None = None) -> bytes:
    """A LAS file of points: version 1.2, or 1.4 for formats from 6 on; by default the least format that holds colours and times."""
    n, none = len(x), (0.0,) * 3
    mins, maxs = ([float(f(v)) for v in (x, y, z)] if n else none for f in (np.min, np.max))
    h = _layout(_format(point_format, colour is not None, gps_time is not None), n, epsg, scale, np.floor(mins).tolist(), mins, maxs)
    return _head(h) + _place(_records(h, n, classification, return_number, number_of_returns, intensity, colour, gps_time), h, x, y, z).tobytes()


def write_las(points: DataFrame, folder: str, epsg: int | None = None, point_format: int | None = None) -> DataFrame:
    """Write each partition as a LAS file in the folder; returns (file, points).

    Without a point format it is the least that holds what is there: one narrow aggregate tells whether any point has a
    time or a colour. A partition's file has a fixed name, so a task that runs again writes the same file. A task holds a
    batch of points at a time, whatever the size of its partition.
    """
    has = set(points.columns)
    wanted = [("gps_time", "gps_time"), ("red", "red")] if point_format is None else []
    there = points.agg(*[F.max(F.col(c).isNotNull()).alias(k) for k, c in wanted if c in has] or [F.lit(None)]).first().asDict() if wanted else {}
    colour = {"red", "green", "blue"} <= has and (bool(there.get("red")) if wanted else point_format in COLOUR_AT)
    timed = "gps_time" in has and (bool(there.get("gps_time")) if wanted else point_format in TIME_AT)

    fmt = _format(point_format, colour, timed)

    def save(batches):
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        draft, n, mins, maxs, done = _layout(fmt), 0, np.full(3, np.inf), np.full(3, -np.inf), []
        # records wait in the task's own scratch files until the least place, from which all are measured, is known
        with tempfile.TemporaryFile() as places, tempfile.TemporaryFile() as records:
            for p in batches:
                if not len(p):
                    continue
                get = lambda c: p[c].fillna(0).to_numpy().astype(np.int64) if c in has else None  # noqa: B023, E731
                at = p[["x", "y", "z"]].to_numpy(np.float64)
                mins, maxs, n = np.minimum(mins, at.min(axis=0)), np.maximum(maxs, at.max(axis=0)), n + len(p)
                places.write(at.tobytes())
                times = p["gps_time"].fillna(0).to_numpy() if timed else None
                records.write(_records(draft, len(p), get("classification"), get("return_number"), get("number_of_returns"), get("intensity"), [get(c) for c in ("red", "green", "blue")] if colour else None, times).tobytes())
            if n:
                h = _layout(fmt, n, epsg, shift=np.floor(mins).tolist(), mins=mins.tolist(), maxs=maxs.tolist())
                store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                name = f"part-{TaskContext.get().partitionId():06d}.las"
                store.create_dir(at, recursive=True)
                places.seek(0)
                records.seek(0)
                with store.open_output_stream(f"{at}/{name}") as f:
                    f.write(_head(h))
                    while raw := records.read(STEP * h.record_length):
                        rec = np.frombuffer(bytearray(raw), _dtype(h))
                        f.write(_place(rec, h, *np.frombuffer(places.read(len(rec) * 24)).reshape(-1, 3).T).tobytes())
                done.append((f"{folder}/{name}", n))
        yield pd.DataFrame(done, columns=["file", "points"])

    return points.mapInPandas(save, "file string, points long")
