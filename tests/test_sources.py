import json
import struct
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith import config
from aerolith.functions.grid import grid_of
from aerolith.operators import terrain
from aerolith.plans import sql
from aerolith.schema import ConfigurationError, ControlPointError, FormatError, GridSpec, NotSupportedError, PointCloudError
from aerolith.sources import crs, geotiff, las, rasters, tiff_codecs, vector, vector_files
from aerolith.streaming import strips

from survey_cases import as_array, as_raster, dem_array


def test_las_round_trip(spark, cloud_arrays, tmp_path):
    a = cloud_arrays
    path = str(tmp_path / "a.las")
    open(path, "wb").write(las.encode(a["x"], a["y"], a["z"], a["classification"], a["return_number"], None, a["intensity"], [a["red"], a["green"], a["blue"]], epsg=32632))
    h = las.read_header(path)
    assert (h.count, h.epsg, h.has_colour, h.has_time) == (3000, 32632, True, False)
    df = las.read_las(spark, path, records=700)
    assert df.rdd.getNumPartitions() == 5
    got = df.orderBy("pid").toPandas()
    for c in ("x", "y", "z"):
        assert np.allclose(got[c], a[c], atol=0.0006)
    for c in ("classification", "return_number", "intensity", "red"):
        assert (got[c].to_numpy() == a[c]).all()
    files = las.write_las(df.repartition(2), str(tmp_path / "out"), 32632).collect()
    assert sum(r["points"] for r in files) == 3000
    assert las.read_las(spark, *[r["file"] for r in files]).count() == 3000
    assert las.bounds(path)["max"][2] == pytest.approx(a["z"].max())


@pytest.mark.parametrize("point_format", [1, 3, 6, 7, 8])
def test_las_formats(spark, cloud_arrays, tmp_path, point_format):
    a = {k: v[:500] for k, v in cloud_arrays.items()}
    time = np.arange(500) / 8
    path = str(tmp_path / "a.las")
    open(path, "wb").write(las.encode(a["x"], a["y"], a["z"], a["classification"], a["return_number"], np.full(500, 3), a["intensity"], [a["red"], a["green"], a["blue"]], 32632, gps_time=time, point_format=point_format))
    h = las.read_header(path)
    assert (h.count, h.point_format, h.epsg, h.version) == (500, point_format, 32632, "1.4" if point_format > 5 else "1.2")
    got = las.read_las(spark, path).orderBy("pid").toPandas()
    assert np.array_equal(got["gps_time"], time) and (got["number_of_returns"] == 3).all() and np.array_equal(got["classification"], a["classification"])
    assert np.array_equal(got["red"], a["red"]) if h.has_colour else got["red"].isna().all()
    files = las.write_las(las.read_las(spark, path), str(tmp_path / "out"), 32632).collect()
    assert las.read_header(files[0]["file"]).point_format == (3 if h.has_colour else 1)
    with pytest.raises(NotSupportedError):
        las.encode(a["x"], a["y"], a["z"], point_format=5)


@pytest.mark.parametrize("point_format", [3, 7])
def test_las_writer_holds_a_batch_at_a_time(cloud_arrays, tmp_path, monkeypatch, point_format):
    # before, a task held all points of its partition
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    a, n = {k: np.tile(v, 200) for k, v in cloud_arrays.items()}, 600_000
    a["x"] = a["x"] - np.arange(n) // 3000  # the least place comes last
    a["gps_time"] = np.arange(n) / 8
    frames = (pd.DataFrame({k: v[i : i + 10_000] for k, v in a.items()}) for i in range(0, n, 10_000))
    points = type("Points", (), {"columns": list(a), "mapInPandas": lambda self, f, schema: f})()
    save = las.write_las(points, str(tmp_path), 32632, point_format)
    tracemalloc.start()
    out = pd.concat(save(frames))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["points"].sum() == n and peak < 40e6
    whole = las.encode(a["x"], a["y"], a["z"], a["classification"], a["return_number"], None, a["intensity"], [a["red"], a["green"], a["blue"]], 32632, gps_time=a["gps_time"], point_format=point_format)
    assert open(out["file"].iloc[0], "rb").read() == whole


def test_las_errors(tmp_path):
    bad = tmp_path / "bad.las"
    bad.write_bytes(b"nothing")
    with pytest.raises(FormatError):
        las.read_header(str(bad))
    raw = bytearray(las.encode(np.zeros(1), np.zeros(1), np.zeros(1)))
    raw[104] |= 0x80
    bad.write_bytes(bytes(raw))
    with pytest.raises(NotSupportedError):
        las.read_header(str(bad))


@pytest.mark.parametrize("dtype", ["f4", "f8"])
def test_geotiff_round_trip(spark, tmp_path, dtype):
    a = dem_array(70, 33)
    a[3, 4] = np.nan
    spec = GridSpec(500000.0, 5200100.0, 0.5, 0.5, 33, 70, 32632)
    path = geotiff.write_geotiff(as_raster(spark, a), spec, str(tmp_path / "a.tif"), dtype=dtype, nodata=-9999.0, strip=16)
    df, got = geotiff.read_geotiff(spark, path)
    assert (got.width, got.height, got.min_x, got.max_y, got.res_x, got.epsg, got.nodata) == (33, 70, 500000.0, 5200100.0, 0.5, 32632, -9999.0)
    b = as_array(df, "z", a.shape)
    assert np.isnan(b[3, 4]) and np.allclose(a, b, atol=1e-4, equal_nan=True)
    part, small = geotiff.read_geotiff(spark, path, step=10)
    assert part.count() == small.width * small.height == 28


def test_colour_geotiff(spark, tmp_path):
    df = spark.createDataFrame([(r, c, r, c, 9) for r in range(5) for c in range(6)], "row long, col long, r int, g int, b int")
    path = geotiff.write_geotiff(df, GridSpec(0.0, 5.0, 1.0, 1.0, 6, 5), str(tmp_path / "c.tif"), ["r", "g", "b"], "u1", 0)
    got, _ = geotiff.read_geotiff(spark, path)
    assert got.where("b3 = 9").count() == 30 and got.agg(F.max("b2")).first()[0] == 5
    bad = tmp_path / "bad.tif"
    bad.write_bytes(b"no tiff here")
    with pytest.raises(FormatError):
        geotiff.read_layout(str(bad))


@pytest.mark.parametrize("compression", [1, 5, 8])
def test_compressed_geotiff(spark, tmp_path, compression):
    a = dem_array(70, 33)
    a[16:32] = np.nan  # a strip without cells
    spec = GridSpec(500000.0, 5200100.0, 0.5, 0.5, 33, 70, 32632)
    raster = as_raster(spark, a).where("row < 16 or row > 31")
    path = geotiff.write_geotiff(raster, spec, str(tmp_path / "a.tif"), dtype="f8", strip=16, compression=compression)
    assert geotiff.read_layout(path).compression == compression
    df, got = geotiff.read_geotiff(spark, path)
    assert (got.width, got.height, got.epsg) == (33, 70, 32632) and np.array_equal(as_array(df, "z", a.shape), a, equal_nan=True)
    done = geotiff.write_tiles(raster, spec, str(tmp_path / "tiles"), dtype="f8", tile=16, compression=compression)
    assert done.count() == 12
    df, got = geotiff.read_tiles(spark, str(tmp_path / "tiles"))
    assert (got.width, got.height, got.min_x, got.max_y) == (33, 70, 500000.0, 5200100.0)
    b = as_array(df, "z", a.shape)
    assert np.array_equal(b, a, equal_nan=True)


def test_lzw():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 5000, 40000):
        for data in (r.integers(0, 256, n).astype("u1").tobytes(), bytes(n), r.integers(0, 3, n).astype("u1").tobytes()):
            assert tiff_codecs.unlzw(tiff_codecs.lzw(data)) == data
    # the example of the specification: 7 7 7 8 8 7 7 6 6 as nine-bit codes
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    whole = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff_codecs.unlzw(whole) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff_codecs.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == whole
    with pytest.raises(FormatError):
        tiff_codecs.unlzw(b"\x80\x7f\xff\xff")


def test_big_and_predicted_geotiff(spark, tmp_path):
    a = np.arange(60, dtype="<u2").reshape(6, 10) * 900
    spec = GridSpec(0.0, 6.0, 1.0, 1.0, 10, 6, 32633)
    ahead = a.copy()
    ahead[:, 1:] -= a[:, :-1]
    data = tiff_codecs.lzw(ahead.tobytes())
    data += b"\0" * (len(data) % 2)
    at = 16 + len(data)
    body = geotiff._directory(spec, 1, "u2", 5, 60000.0, 6, [len(data)], 16, at, True)
    n = int.from_bytes(body[:8], "little")
    # a predictor tag in the place of that of the planes (284)
    k = next(8 + 20 * i for i in range(n) if body[8 + 20 * i : 10 + 20 * i] == (284).to_bytes(2, "little"))
    body = body[:k] + (317).to_bytes(2, "little") + body[k + 2 : k + 12] + (2).to_bytes(8, "little") + body[k + 20 :]
    path = tmp_path / "big.tif"
    path.write_bytes(geotiff._head(at, True) + data + body)
    df, got = geotiff.read_geotiff(spark, str(path))
    assert got.epsg == 32633 and np.array_equal(as_array(df, "z", a.shape), a)
    b = np.random.default_rng(0).normal(size=(4, 5, 2)).astype("<f4")
    planes = b.astype(">f4").view("u1").reshape(4, 10, 4).transpose(0, 2, 1).reshape(4, 20, 2)
    ahead = planes.copy()
    ahead[:, 1:] -= planes[:, :-1]
    assert np.array_equal(tiff_codecs.samples(ahead.tobytes(), "<f4", (4, 5, 2), 3), b)
    with pytest.raises(FormatError):
        tiff_codecs.samples(b"1234", "<f4", (4, 5, 2), 1)


def test_raster_parquet(spark, tmp_path):
    spec = GridSpec(0.0, 40.0, 1.0, 1.0, 40, 40, 32633)
    path = rasters.write_raster(as_raster(spark, dem_array(40, 40)), spec, str(tmp_path / "r"), tile=16)
    df, got = rasters.read_raster(spark, path, (10, 10, 5, 5))
    assert got == spec and df.count() == 25


@pytest.mark.parametrize("text,types", [
    ("id,easting,northing,elevation,type\nA,1,2,3,GCP\nB,4,5,6,check\nbad,x,y,z,GCP\n", ["GCP", "CHECK"]),
    ("# note\nA;1;2;3\nCHK_B;4;5;6\n", ["GCP", "CHECK"]),
    ("id\tx\ty\tz\nA\t1\t2\t3\nCHK_B\t4\t5\t6\n", ["GCP", "CHECK"]),
])
def test_control_text(spark, tmp_path, text, types):
    path = tmp_path / "g.csv"
    path.write_text(text)
    rows = vector.read_control(spark, str(path)).orderBy("x").collect()
    assert [r["point_type"] for r in rows] == types and [r["z"] for r in rows] == [3.0, 6.0]
    assert rows[0]["point_id"] == "A"


def test_control_without_names(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("1 2 3\n4 5 6\n")
    assert vector.read_control(spark, str(path)).count() == 2
    with pytest.raises(NotSupportedError):
        vector.read_control(spark, "a.kml")
    got = vector.read_control(spark, [{"id": "a", "x": 1, "y": 2, "z": 3, "type": "CHECK"}, ("b", 4, 5, 6)]).orderBy("x").collect()
    assert [r["point_type"] for r in got] == ["CHECK", "GCP"]
    assert vector.read_control(spark, vector.read_control(spark, [(1, 2, 3)])).first()["z"] == 3.0


def test_geojson(spark, tmp_path):
    path = tmp_path / "g.geojson"
    feature = lambda c, p: {"type": "Feature", "geometry": {"type": "Point", "coordinates": c}, "properties": p}
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature([1, 2, 3.5], {"ID": "A", "type": "GCP"}), feature([4, 5], {"id": "B", "type": "CHK", "elev": "7"})]}))
    rows = vector.read_control(spark, str(path)).orderBy("x").collect()
    assert [(r["point_id"], r["z"], r["point_type"]) for r in rows] == [("A", 3.5, "GCP"), ("B", 7.0, "CHECK")]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature([1, 2], {"id": "A"})]}))
    with pytest.raises(ControlPointError):
        vector.read_control(spark, str(path))
    box = [[[0, 0], [5, 0], [5, 4], [0, 4], [0, 0]]]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": box}, "properties": {"id": "CHIP_01"}}]}))
    r = vector.read_chips(spark, str(path)).first()
    assert (r["id"], r["x_max"], r["y_max"]) == ("CHIP_01", 5.0, 4.0)
    y, x = np.mgrid[0:9, 0:9]
    seg = terrain.contour_segments(as_raster(spark, (x + y).astype(float)), GridSpec(0.0, 9.0, 1.0, 1.0, 9, 9), 3.0, base=0.5)
    out = str(tmp_path / "lines.geojson")
    vector.write_geojson(vector.line_features(terrain.contour_lines(seg)), out, newline=False)
    assert {f["geometry"]["type"] for f in vector.parsed(out)["features"]} == {"LineString"}


def test_vector_files(spark, tmp_path):
    points = spark.createDataFrame([("A", 1.5, 2.0, 3.25, "GCP"), ("Ü", 4.0, 5.0, 6.0, "CHECK")], "id string, x double, y double, z double, type string")
    for name in ("a.shp", "a.gpkg"):
        rows = vector.read_control(spark, vector.write_control(points, str(tmp_path / name))).orderBy("x").collect()
        assert [tuple(r) for r in rows] == [("A", 1.5, 2.0, 3.25, "GCP"), ("Ü", 4.0, 5.0, 6.0, "CHECK")]
    table = bytearray((tmp_path / "a.dbf").read_bytes())
    table[int.from_bytes(table[8:10], "little")] = ord("*")  # the first record is deleted
    (tmp_path / "a.dbf").write_bytes(bytes(table))
    assert [r["point_id"] for r in vector.read_control(spark, str(tmp_path / "a.shp")).collect()] == ["Ü"]
    ring = [(0.0, 0.0), (0.0, 4.0), (5.0, 4.0), (5.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 5, 4, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    null = struct.pack("<i", 0)
    shp = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 0) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    for k, b in enumerate((null, body)):
        shp += struct.pack(">2i", k + 1, len(b) // 2) + b
    (tmp_path / "c.shp").write_bytes(shp)
    (tmp_path / "c.dbf").write_bytes(vector_files.shapefile_bytes([(0, 0, 0)] * 2, [{"id": "none"}, {"id": "CHIP"}])[2])
    assert [tuple(r) for r in vector.read_chips(spark, str(tmp_path / "c.shp")).collect()] == [("CHIP", 0.0, 0.0, 5.0, 4.0)]
    for name in ("bad.shp", "bad.gpkg"):
        (tmp_path / name).write_bytes(b"nothing like it")
        with pytest.raises(FormatError):
            vector.read_control(spark, str(tmp_path / name))
    empty = vector.write_control(points.where("z > 100"), str(tmp_path / "none.gpkg"))
    assert vector.read_control(spark, empty).count() == 0


def test_crs():
    assert crs.resolve() == 32632 and crs.resolve(4326) == 4326 and crs.resolve("epsg:25832") == 25832 and crs.resolve("3857") == 3857
    assert crs.resolve(prj='PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32633"]]') == 32633
    assert crs.resolve("WGS 84 / UTM zone 33S") == 32733 and crs.resolve("nonsense") == 32632


def test_config(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with config.compute_context(spark, "low_memory") as c:
        assert c.low_memory and c.chunk == 1_000_000
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "40000000"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and not config.get_config().low_memory
    assert config.set_profile("maximum").block == 4096 and config.reset_config().share == 0.75
    with pytest.raises(ConfigurationError):
        config.set_profile("turbo")
    with pytest.raises(ConfigurationError):
        config.set_config(chunk=0)
    config.reset_config()
    assert config.timed(sum, [1, 2])[0] == 3


def test_texts_and_checks(spark, tmp_path):
    assert rasters.size_text(5 * 1024 * 1024) == "5.00 MB"
    assert rasters.extent_text(GridSpec(0.0, 10.0, 1.0, 1.0, 20, 10)).startswith("20.00 x 10.00")
    with pytest.raises(PointCloudError):
        rasters.verify_cloud(spark.createDataFrame([], "x double, y double, z double"))


def test_sql_views(spark, cloud):
    sql.register_cloud(cloud, "field", 3.0)
    assert spark.sql("select max(z) from field_dsm").first()[0] == cloud.agg(F.max("z")).first()[0]
    sql.register_raster(as_raster(spark, dem_array(10, 10)), GridSpec(0.0, 10.0, 1.0, 1.0, 10, 10), "hill")
    assert spark.sql("select count(*) from hill_slope where slope >= 0").first()[0] == 100


def test_live_surface(spark, cloud, tmp_path):
    from aerolith.schema import POINT

    full = cloud.select(*[(F.col(f.name) if f.name in cloud.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POINT])
    spec = grid_of(cloud, 3.0)
    folder = str(tmp_path / "in")
    full.where("pid < 1000").write.parquet(folder)
    q = strips.keep_surface(strips.arriving(spark, folder), spec, "live", str(tmp_path / "ck"))
    q.processAllAvailable()
    full.where("pid >= 1000").write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n), max(z) from live").first() == (3000, cloud.agg(F.max("z")).first()[0])
