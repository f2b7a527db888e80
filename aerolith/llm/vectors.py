"""Embedding near-dedup: PCA-ordered tiles, leading dimensions first, residuals bounded by suffix norms.

Vectors are rotated onto the principal axes of all of them, so the leading dimensions hold
most of every dot product. The first axes also cut the unit sphere into cells twice as wide as
two linked vectors can lie apart: links only join a cell with itself and its neighbours, and
only vectors near a neighbour are sent to it. Tiles
of such cells are compared block by block of dimensions; a pair goes on only while
its partial product plus the product of both suffix norms can still reach the threshold, and
survivors are decided by the cosine of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import components, n_partitions, settle
from aerolith.llm.neardup import _forest, _groups

COSINE = 0.98
TILE = 512
BLOCKS = (4, 12, 28)
#: Width of a cell on each of the first three axes, in distances that a link can span.
CELL = 2
#: Slack for rounding in the rotated products; the exact check decides.
EPS = 1e-9


def _moments(batches: Iterator[pd.DataFrame], kind: str) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for pdf in batches:
        for d, g in pdf.groupby("dim"):
            x = _matrix(g["vec"], kind)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            sums[d] = sums.get(d, 0) + x.T @ x
            counts[d] = counts.get(d, 0) + len(x)
    for d, m in sums.items():
        yield pd.DataFrame({"dim": [d], "n": [counts[d]], "m": [m.ravel()]})


def _matrix(rows: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


#: Steps to the 27 cells around one, itself in the middle; step 26 - i is the opposite of step i.
STEPS = np.array([(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])


def _placed(batches: Iterator[pd.DataFrame], kind: str, axes: np.ndarray, reach: float) -> Iterator[pd.DataFrame]:
    """Cell of each vector on the first axes, and the steps to neighbours that a link of it can end in.

    Vectors of other lengths stand in one cell.
    """
    width = CELL * reach
    for pdf in batches:
        cell, near = np.zeros((len(pdf), 3), np.int64), [[] for _ in range(len(pdf))]
        at = np.flatnonzero(pdf["dim"].to_numpy() == len(axes))
        if len(at):
            x = _matrix(pdf["vec"].iloc[at], kind)
            y = np.zeros((len(at), 3))
            y[:, : min(3, len(axes))] = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[:, :3]
            here = np.floor(y / width).astype(np.int64)
            cell[at] = here
            inside = y - here * width
            # distance along each axis to the slab one step down, the own one, one step up
            gap = np.stack([inside, np.zeros_like(inside), width - inside], axis=-1)
            far = sum(gap[:, k, STEPS[:, k] + 1] ** 2 for k in range(3)) <= reach * reach * (1 + 1e-9)
            for i, row in zip(at.tolist(), far, strict=True):
                near[i] = [k for k in np.flatnonzero(row).tolist() if k != 13]
        yield pdf.assign(c0=cell[:, 0], c1=cell[:, 1], c2=cell[:, 2], near=near)


def _unpacked(batches: Iterator[pd.DataFrame], kind: str) -> Iterator[pd.DataFrame]:
    """Vectors as bytes, with a digest of label and values; those that link with nothing go."""
    for pdf in batches:
        vec, node, dim = [], [], []
        for v, label in zip(pdf["vec"], pdf["label"], strict=True):
            x = np.array([np.nan if e is None else e for e in v], kind) if v is not None else np.empty(0)
            ok = bool(len(x) and np.isfinite(x).all() and x.any())
            dim.append(len(x))
            x = x + x.dtype.type(0)  # one zero
            node.append(xxhash.xxh3_128_hexdigest(x.tobytes() + b"|" + str(label).encode()) if ok else None)
            if ok and kind == "<f8":  # so that squares of very large or small components stay finite
                x = x / np.abs(x).max()
            vec.append(x.tobytes() if ok else None)
        yield pdf.assign(vec=vec, node=node, dim=np.array(dim, np.int32))


def _linked(batches: Iterator[pd.DataFrame], kind: str, axes: np.ndarray, cosine: float) -> Iterator[pd.DataFrame]:
    """For each pair of tiles: every vector's number of links there and the least node it hangs together with."""
    out: list[tuple] = []
    for g in _groups(batches, ["run", "a", "b"]):
        g = g.sort_values("node", kind="stable")
        side, node, copies = g["side"].to_numpy(), g["node"].to_numpy(), g["copies"].to_numpy()
        x = _matrix(g["vec"], kind)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        y = unit @ axes if x.shape[1] == len(axes) else unit
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: in both
        if not len(left) or not len(right):
            continue
        a, b = y[left], y[right]
        within = bool((side == 2).any())
        i = j = None
        done, dots = 0, None
        for upto in (*[d for d in BLOCKS if d < y.shape[1]], y.shape[1]):
            rest_a, rest_b = np.linalg.norm(a[:, upto:], axis=1), np.linalg.norm(b[:, upto:], axis=1)
            if i is None:
                dots = a[:, :upto] @ b[:, :upto].T
                open_ = dots + rest_a[:, None] * rest_b[None, :] >= cosine - EPS
                if within:
                    open_ &= left[:, None] < right[None, :]
                i, j = np.nonzero(open_)
                dots = dots[i, j]
            else:
                dots = dots + np.einsum("ij,ij->i", a[i, done:upto], b[j, done:upto])
                still = dots + rest_a[i] * rest_b[j] >= cosine - EPS
                i, j, dots = i[still], j[still], dots[still]
            done = upto
            if not len(i):
                break
        u, v = left[i], right[j]
        exact = np.einsum("ij,ij->i", x[u], x[v]) / (np.linalg.norm(x[u], axis=1) * np.linalg.norm(x[v], axis=1)) >= cosine
        u, v = u[exact], v[exact]
        if not len(u):
            continue
        n = np.bincount(u, copies[v], len(node)) + np.bincount(v, copies[u], len(node))
        root = _forest(len(node), u, v)
        out += [(node[k], int(n[k]), node[root[k]]) for k in np.flatnonzero(n)]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["node", "links", "least"])
            out = []
    yield pd.DataFrame(out, columns=["node", "links", "least"])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """Every row with its number of links and its component.

    Rows link when their labels are equal and not null, they are as long, and their cosine is at least
    the threshold. Returns key, n_links, component_id (least key that links reach, itself
    included) and kept. Null or zero vectors and those with null or non-finite components link with
    nothing, nor do rows with a null label. Equal vectors collapse before the comparison and count as
    often as they stand. Null keys: such a row links, and is its own component if it has no link. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    label_kind = dict(df.dtypes)[label]
    element = "<f4" if dict(df.dtypes)[vector] == "array<float>" else "<f8"
    rows = df.select(df[key].alias("key"), df[label].alias("label"), df[vector].alias("vec"))
    flat = settle(rows.mapInPandas(lambda b: _unpacked(b, element), f"key {kind}, label {label_kind}, vec binary, node string, dim int"))
    linkable = F.col("node").isNotNull() & F.col("label").isNotNull()
    sets = flat.where(linkable).groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("key"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    sets = settle(sets)
    found = settle(sets.select("dim", "vec").mapInPandas(lambda b: _moments(b, element), "dim int, n long, m array<double>"))
    sums = found.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").first()
    axes = np.zeros((0, 0))
    if sums is not None:
        d = sums["dim"]
        at = found.where(F.col("dim") == d).select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        m = np.zeros(d * d)
        for r in at.collect():  # dim * dim numbers
            m[r["i"]] = r["x"]
        w, basis = np.linalg.eigh(m.reshape(d, d))
        axes = basis[:, np.argsort(-w)]
    held = spark.sparkContext.broadcast(axes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    where = ["label", "dim", "c0", "c1", "c2"]
    cells = settle(sets.mapInPandas(lambda b: _placed(b, element, held.value, reach), f"node string, copies long, key {kind}, label {label_kind}, dim int, vec binary, c0 long, c1 long, c2 long, near array<int>"))
    counts = settle(cells.groupBy(*where).agg(F.count("*").alias("m")).withColumn("nt", F.ceil(F.col("m") / tile).cast("int")))
    own = cells.join(counts.select(*where, "nt"), where).withColumn("t", F.pmod(F.xxhash64("node", F.lit(3)), "nt").cast("int"))
    part = ["node", "copies", "vec", "t"]
    others = F.explode(F.sequence(F.lit(0), F.col("nt") - 1))
    inside = own.withColumn("_u", others).select(*part, F.xxhash64(*where).alias("run"), F.least("t", "_u").alias("a"), F.greatest("t", "_u").alias("b"), F.when(F.col("t") == F.col("_u"), 2).when(F.col("t") < F.col("_u"), 0).otherwise(1).alias("side"))
    # a vector goes to a neighbouring cell only if a link of it can end there, and the cell is not empty
    step = F.array(*[F.array(*[F.lit(int(v)) for v in s]) for s in STEPS])
    there = own.drop("nt").withColumn("_s", F.explode("near")).withColumn("_d", F.get(step, F.col("_s")))
    there = there.select(*part, "label", "dim", F.struct(*where[2:]).alias("_here"), "_s", *[(F.col(c) + F.get("_d", F.lit(k))).alias(c) for k, c in enumerate(where[2:])])
    met = there.join(counts.select(*where, "nt"), where)
    forward, here, target = F.col("_s") > 13, F.col("_here"), F.struct(*where[2:])
    met = met.withColumn("_u", others).select(
        *part,
        F.when(forward, F.xxhash64("label", "dim", here, target)).otherwise(F.xxhash64("label", "dim", target, here)).alias("run"),
        F.when(forward, F.col("t")).otherwise(F.col("_u")).alias("a"),
        F.when(forward, F.col("_u")).otherwise(F.col("t")).alias("b"),
        F.when(forward, 0).otherwise(1).alias("side"),
    )
    pairs = inside.unionByName(met).drop("t")
    links = pairs.repartition(n_partitions(spark), "run", "a", "b").sortWithinPartitions("run", "a", "b").mapInPandas(lambda b: _linked(b, element, held.value, cosine), "node string, links long, least string")
    links = settle(links)
    roots = components(links.select(F.col("node").alias("u"), F.col("least").alias("v")))
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = settle(sets.select("node", "key", "copies").join(total, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = classes.groupBy("root").agg(F.min("key").alias("component_id"))
    classes = classes.join(ids, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = flat.select("key", F.when(linkable, F.col("node")).alias("node")).join(classes, "node", "left")
    alone = F.col("component_id").isNull()
    return out.select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("key")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)))
