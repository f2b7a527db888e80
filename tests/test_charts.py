import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import profile
from aerolith.schema import EmptyRasterError, GridSpec, PointCloudError
from aerolith.sources import charts

from survey_cases import as_raster, dem_array

SVG = "{http://www.w3.org/2000/svg}"


def marks(path, kind):
    return ET.parse(path).getroot().findall(f".//{SVG}{kind}")


def test_ramp():
    colours = charts.ramp(charts.DIFFERENCE)
    assert colours.shape == (256, 3) and tuple(colours[0]) == (0x2B, 0x5C, 0x8F) and tuple(colours[-1]) == (0xC2, 0x3B, 0x22)


def test_transects(spark, tmp_path):
    spec = GridSpec(0.0, 120.0, 1.0, 1.0, 110, 120)
    rows = profile.transects(as_raster(spark, dem_array(120, 110)), spec, indices=[3, 50, 90])
    path = charts.transect_chart(rows, str(tmp_path / "t.svg"), threshold=101.0, places=40)
    lines = marks(path, "polyline")
    assert len(lines) == 4 and all(len(x.get("points").split()) == 40 for x in lines[:3])
    many = profile.transects(as_raster(spark, dem_array(120, 110)), spec, indices=list(range(10)))
    assert sum(x.get("stroke") == charts.OTHER for x in marks(charts.transect_chart(many, str(tmp_path / "m.svg")), "polyline")) == 2
    with pytest.raises(EmptyRasterError):
        charts.transect_chart(rows.where("z > 1e9"), str(tmp_path / "n.svg"))


def test_histogram_and_cloud(spark, cloud, tmp_path):
    bins = profile.histogram(cloud, "z", 12)
    path = charts.histogram_chart(bins, str(tmp_path / "h.svg"), "a < b")
    assert len([x for x in marks(path, "rect") if x.find(f"{SVG}title") is not None]) == bins.count()
    assert any(t.text == "a < b" for t in marks(path, "text"))
    same = spark.createDataFrame([(1.0,), (1.0,)], "z double")
    charts.histogram_chart(profile.histogram(same, "z", 12), str(tmp_path / "s.svg"))
    path = charts.cloud_chart(cloud, str(tmp_path / "c.svg"))
    kinds = cloud.select("classification").distinct().count() + cloud.select("return_number").distinct().count()
    assert len([x for x in marks(path, "rect") if x.find(f"{SVG}title") is not None]) == kinds
    for draw, empty in ((charts.cloud_chart, cloud.where("z > 1e9")), (charts.histogram_chart, bins.where("n < 0"))):
        with pytest.raises(PointCloudError):
            draw(empty, str(tmp_path / "n.svg"))


def test_image(spark, tmp_path):
    a = dem_array(30, 40)
    a[2, 3] = np.nan
    raster = as_raster(spark, a).withColumn("bad", F.expr("row = 5 and col = 6"))
    data = open(charts.raster_image(raster, GridSpec(0.0, 30.0, 1.0, 1.0, 40, 30), str(tmp_path / "a.png"), flag="bad"), "rb").read()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[16:24] == (40).to_bytes(4, "big") + (30).to_bytes(4, "big")
    n = int.from_bytes(data[33:37], "big")
    rgb = np.frombuffer(zlib.decompress(data[41 : 41 + n]), np.uint8).reshape(30, 121)[:, 1:].reshape(30, 40, 3)
    assert tuple(rgb[5, 6]) == (0xE3, 0x49, 0x48) and tuple(rgb[2, 3]) == (0xFC, 0xFC, 0xFB)
    top = np.unravel_index(np.nanargmax(a), a.shape)
    assert tuple(rgb[top]) == (0x0B, 0x2A, 0x52)
    small = open(charts.raster_image(raster, GridSpec(0.0, 30.0, 1.0, 1.0, 40, 30), str(tmp_path / "b.png"), cells=10), "rb").read()
    assert small[16:24] == (10).to_bytes(4, "big") + (8).to_bytes(4, "big")
    with pytest.raises(EmptyRasterError):
        charts.raster_image(raster.where("row < 0"), GridSpec(0.0, 30.0, 1.0, 1.0, 40, 30), str(tmp_path / "c.png"))
