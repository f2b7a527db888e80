"""Rasters as arrays and tables, for the tests of the survey operators."""

import math

import numpy as np
import pandas as pd


def dem_array(h=40, w=40):
    r, c = np.mgrid[0:h, 0:w]
    return 200 + 0.05 * c + 0.08 * r + 5 * np.sin(c / 10) * np.cos(r / 10)


def as_raster(spark, a):
    r, c = np.indices(a.shape)
    df = pd.DataFrame({"row": r.ravel().astype(np.int64), "col": c.ravel().astype(np.int64), "z": a.ravel().astype(float)})
    rows = [(int(x), int(y), None if math.isnan(z) else float(z)) for x, y, z in df.itertuples(index=False)]
    return spark.createDataFrame(rows, "row long, col long, z double")


def as_array(df, value, shape, dtype=float):
    out = np.full(shape, np.nan, dtype) if dtype is float else np.zeros(shape, dtype)
    for r in df.select("row", "col", value).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out
