"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact shingle sets decide.

A document is the set of its five-word shingles (fewer words: one shingle of all of them).
Equal sets collapse first. Each of TREES tries holds a path of DEPTH min-hashes a document. All paths
are sorted, tree after tree, so the documents under a prefix are a run of neighbours in that order,
whose length at every depth follows from where neighbours part. A matched prefix is shortened from the
full path to where a pair at the threshold meets in some tree with the target recall, whatever
else is there, and on from there, tree by tree, as long as no more than RUN documents share it: lone
pairs meet on short prefixes, while large clusters, whose links hang together in any case, keep long ones.
Inside runs, signatures are compared tile by tile; what is close enough makes candidate
groups, and inside a group all pairs are verified exactly, again tile by tile. A tile pair
gives counts and spanning links, so rows stay linear in the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import WordHash, components, fresh, lean, mixed, n_partitions, settle
from aerolith.llm.quality import row_hash

SHINGLE = 5
#: The threshold as a fraction, so that it is compared in whole numbers.
THRESHOLD = (4, 5)
TREES = 16
DEPTH = 6
RECALL = 0.99
#: Prefixes are shortened by at most so many min-hashes beyond the target recall, in runs of so many documents.
BEYOND, RUN = 2, 64
#: Rows of sorted paths that one task holds.
PATHS = 400_000
#: Pairs whose signatures agree less are not verified: four standard errors below the threshold.
SLACK = 4.0
#: Members of a tile that are verified, and whose signatures are compared.
TILE, SIGNED = 1024, 4096
#: Bytes of a tree's path: 16 bits a min-hash.
PATH = 2 * DEPTH


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold still meets in some trie with the target recall."""
    return next((k for k in range(depth, 1, -1) if 1 - (1 - threshold**k) ** trees >= recall), 1)


def shingles(text: bytes | None, hashes: WordHash, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    h = hashes.of(text)
    if not len(h):
        return h
    width = min(n, len(h))
    x = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        x = x * np.uint64(0x100000001B3) + mixed(h[i : len(h) - width + 1 + i])
    return np.unique(mixed(x) + np.uint64(width))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """uint32 [documents, n] min-hashes of nonempty sets."""
    mul, add = _permutations(n)
    out = np.empty((len(sets), n), np.uint32)
    start = 0
    while start < len(sets):  # blocks bound the memory
        end, size = start + 1, len(sets[start])
        while end < len(sets) and size + len(sets[end]) <= 1 << 18:
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : end - 1]], dtype=np.int64)]).astype(np.int64)
        for p in range(n):
            out[start:end, p] = np.minimum.reduceat((x * mul[p] + add[p]) >> np.uint64(32), at)
        start = end
    return out


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHash()
    for pdf in batches:
        sets = [shingles(t, hashes) for t in pdf["_text"]]
        some = [i for i, s in enumerate(sets) if len(s)]
        fp, sigs = [None] * len(sets), [None] * len(sets)
        if some:
            low = minhashes([sets[i] for i in some], TREES * DEPTH).astype(">u2")
            for r, i in enumerate(some):
                fp[i], sigs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), low[r].tobytes()
        yield pdf.drop(columns=["_text"]).assign(fp=fp, n=[len(s) for s in sets], sig=sigs)


def _column_bytes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of binaries of one length as rows of bytes."""
    x = batch.column(name)
    return np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1)


def _nodes(paths: np.ndarray, depth: int) -> np.ndarray:
    """Where among sorted paths (a byte of the tree, then min-hashes) another prefix of this depth begins."""
    cut = 1 + 2 * depth
    return np.flatnonzero(np.concatenate([[True], (paths[1:, :cut] != paths[:-1, :cut]).any(1)]))


def _ends(batches: Iterator[pa.RecordBatch], depths: range) -> Iterator[pa.RecordBatch]:
    """One row for a part of the sorted paths: its ends, and how long the runs at its ends are at each depth."""
    parts = [_column_bytes(b, "path") for b in batches if b.num_rows]
    if parts:
        paths = np.concatenate(parts)
        at = [_nodes(paths, d) for d in depths]
        lead, tail = [int(a[1]) if len(a) > 1 else len(paths) for a in at], [int(len(paths) - a[-1]) for a in at]
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [len(paths)], "first": [paths[0].tobytes()], "last": [paths[-1].tobytes()], "lead": [lead], "tail": [tail]})


def outside(ends: list, depths: range) -> dict[int, tuple[list[int], list[int]]]:
    """How far the first and the last run of each part go on in the parts before and after it, by depth."""
    ends = sorted(ends, key=lambda r: r["part"])
    out = {r["part"]: ([0] * len(depths), [0] * len(depths)) for r in ends}
    for d, depth in enumerate(depths):
        cut = 1 + 2 * depth
        for side, walk, here, there, run in ((0, ends, "first", "last", "tail"), (1, ends[::-1], "last", "first", "lead")):
            for before, now in zip(walk[:-1], walk[1:], strict=True):
                if before[there][:cut] == now[here][:cut]:
                    out[now["part"]][side][d] = before[run][d] + (out[before["part"]][side][d] if before[run][d] == before["n"] else 0)
    return out


def _shared(batches: Iterator[pa.RecordBatch], beyond: dict, depths: range, most: int) -> Iterator[pa.RecordBatch]:
    """fp, node, m: the last of depths, or the shortest prefix that at most `most` documents share; lone paths are left out."""
    parts = [(_column_bytes(b, "path"), _column_bytes(b, "fp")) for b in batches if b.num_rows]
    if not parts:
        return
    paths, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    before, after = beyond[TaskContext.get().partitionId()]
    depth, m = np.zeros(len(paths), np.int32), np.zeros(len(paths), np.int64)
    for k, d in reversed(list(enumerate(depths))):
        at = _nodes(paths, d)
        size = np.diff(np.append(at, len(paths)))
        whole = size.copy()
        whole[0] += before[k]
        whole[-1] += after[k]
        whole = np.repeat(whole, size)
        fits = (whole <= most) | (d == depths[-1])
        depth[fits], m[fits] = d, whole[fits]
    shared = np.flatnonzero(m > 1)
    for i in range(0, len(shared), 50_000):
        at = shared[i : i + 50_000]
        names = [paths[k, : 1 + 2 * d].tobytes() for k, d in zip(at.tolist(), depth[at].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"fp": pa.array([x.tobytes() for x in fp[at]], pa.binary()), "node": pa.array(names, pa.binary()), "m": pa.array(m[at], pa.int64())})


def runs_of(sets: DataFrame, threshold: float, run: int = RUN) -> DataFrame:
    """The forest: run_id, m, fp of every document that shares a run of m with another."""
    longest = prefix_length(threshold)
    depths = range(max(1, longest - BEYOND), longest + 1)
    paths = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", t * PATH + 1, F.lit(PATH)))
    rows = sets.select("fp", F.posexplode(paths).alias("tree", "path"))
    rows = rows.select("fp", F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), "path").alias("path"))
    parts = max(n_partitions(sets.sparkSession), -(-TREES * sets.count() // PATHS))
    tries = settle(rows.repartitionByRange(parts, "path", "fp").sortWithinPartitions("path", "fp"))
    ends = tries.mapInArrow(lambda b: lean(_ends, b, depths), "part long, n long, first binary, last binary, lead array<long>, tail array<long>").collect()  # a row a part
    beyond = outside(ends, depths)
    shared = tries.mapInArrow(lambda b: lean(_shared, b, beyond, depths, run), "fp binary, node binary, m long")
    return shared.select(F.xxhash64("node").alias("run_id"), "m", "fp")


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' component under the links u-v."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by `by`, one group in memory at a time."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.ones(len(pdf), bool)
        new[1:] = np.logical_or.reduce([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in by])
        if held and all(held[-1][c].iloc[-1] == pdf[c].iloc[0] for c in by):
            new[0] = False
        at = [*np.flatnonzero(new), len(pdf)]
        if at[0]:
            held.append(pdf.iloc[: at[0]])
        for a, b in zip(at[:-1], at[1:], strict=True):
            if held:
                yield held[0] if len(held) == 1 else pd.concat(held)
            held = [pdf.iloc[a:b]]
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def _alike(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """For each tile pair of a run: links of a spanning forest over signatures that agree in `least` places."""
    out: list[tuple[str, str]] = []
    for g in _groups(batches, ["run", "a", "b"]):
        sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g), -1)
        fp, tile = g["fp"].to_numpy(), g["tile"].to_numpy()
        cross = g["a"].iloc[0] != g["b"].iloc[0]
        us, vs = [], []
        step = max(1, (1 << 17) // len(sig))
        for i in range(0, len(sig), step):
            same = (sig[i : i + step, None, :] == sig[None, :, :]).sum(-1) >= least
            if cross:
                same &= tile[i : i + step, None] != tile[None, :]
            u, v = np.nonzero(same)
            u += i
            us.append(u[u < v])
            vs.append(v[u < v])
        root = _forest(len(sig), np.concatenate(us), np.concatenate(vs))
        out += [(fp[i], fp[r]) for i, r in enumerate(root) if i != r]
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["u", "v"])
            out = []
    yield pd.DataFrame(out, columns=["u", "v"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks over the shingles that occur twice."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    x = np.concatenate(sets)
    order = np.argsort(x, kind="stable")
    x, who = x[order], who[order]
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    col = np.cumsum(first) - 1
    often = (np.bincount(col) > 1)[col]
    col, who = col[often], who[often]
    out = np.zeros((n, n), np.float32)
    if len(col):
        first = np.ones(len(col), bool)
        first[1:] = col[1:] != col[:-1]
        col = np.cumsum(first) - 1
        step = max(256, (1 << 22) // n)
        ends = np.searchsorted(col, np.arange(0, col[-1] + 1 + step, step))
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if b > a:
                m = np.zeros((n, min(step, col[b - 1] - k * step + 1)), np.float32)
                m[who[a:b], col[a:b] - k * step] = 1
                out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return np.rint(out).astype(np.int64)


def _verified(batches: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """For each tile pair of a group: each document's number of links there and the least it hangs together with."""
    hashes, out = WordHash(), []
    for g in _groups(batches, ["run", "a", "b"]):
        g = g.drop_duplicates("fp").sort_values("fp")
        fp, tile, copies = g["fp"].to_numpy(), g["tile"].to_numpy(), g["copies"].to_numpy()
        sets = [shingles(t, hashes) for t in g["_text"]]
        if len(sets) < 2:
            continue
        sizes, both = np.array([len(s) for s in sets]), overlaps(sets)
        linked = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
        np.fill_diagonal(linked, False)
        if g["a"].iloc[0] != g["b"].iloc[0]:
            linked &= tile[:, None] != tile[None, :]
        u, v = np.nonzero(linked)
        root = _forest(len(fp), u, v)
        n = linked @ copies
        out += [(fp[i], int(n[i]), fp[root[i]]) for i in np.flatnonzero(n)]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["fp", "links", "least"])
            out = []
    yield pd.DataFrame(out, columns=["fp", "links", "least"])


def tiled(members: DataFrame, run: str, size: str, node: str, tile: int = TILE) -> DataFrame:
    """One row for each tile pair that a member of a run has a part in: run, a, b, tile and the member's columns."""
    n = F.ceil(F.col(size) / tile).cast("int")
    own = F.pmod(F.xxhash64(F.col(node), F.lit(5)), n).cast("int")
    rows = members.withColumn("tile", own).withColumn("_u", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("*", F.least("tile", "_u").alias("a"), F.greatest("tile", "_u").alias("b")).drop("_u", size).withColumnRenamed(run, "run")


def by_tile(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    return rows.repartition(n_partitions(rows.sparkSession), "run", "a", "b").sortWithinPartitions("run", "a", "b").mapInPandas(work, schema)


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Every row with its class and its number of links (other rows with Jaccard >= threshold).

    Returns key, _row, class_id (least key of the class), n_links, n_shingles and class (a name that
    only rows of one class share). Null and empty texts have no shingles and are a class of their own.
    Rows with null keys take part; a class of only such rows has a null class_id. Repeated rows link
    with each other. An empty table gives an empty result.
    """
    num, den = threshold
    s = num / den
    least = int(np.floor(TREES * DEPTH * (s - SLACK * np.sqrt(s * (1 - s) / (TREES * DEPTH)))))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), row_hash(docs[key], docs[text]).alias("_row"), docs[text].cast("binary").alias("_text"))
    signed = settle(rows.mapInPandas(lambda b: lean(_signed, b), f"key {kind}, _row long, fp binary, n long, sig binary"))
    sets = settle(
        signed.where("fp IS NOT NULL")
        .groupBy("fp")
        .agg(F.min_by(F.struct("key", "_row"), "_row").alias("rep"), F.min("key").alias("key"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    )
    forest = settle(runs_of(sets, s))
    # runs with the same members count once
    runs = forest.groupBy("run_id").agg(F.max("m").alias("m"), F.bit_xor(F.xxhash64("fp")).alias("who")).groupBy("m", "who").agg(F.min("run_id").alias("run_id"))
    members = forest.join(runs.select("run_id"), "run_id", "left_semi")
    met = tiled(members, "run_id", "m", "fp", SIGNED).join(sets.select("fp", "sig"), "fp")
    edges = by_tile(met.select("run", "a", "b", "tile", "fp", "sig"), lambda b: lean(_alike, b, least), "u binary, v binary")
    groups = components(edges)
    sized = groups.groupBy("root").agg(F.count("*").alias("m"))
    grouped = groups.join(sized, "root").join(sets.select(F.col("fp").alias("node"), "rep", "copies"), "node")
    want = tiled(grouped.withColumnRenamed("node", "fp"), "root", "m", "fp").select("run", "a", "b", "tile", "fp", "copies", F.col("rep._row").alias("_want"), F.col("rep.key").alias("_key"))
    met = want.join(rows, (F.col("_want") == F.col("_row")) & F.col("_key").eqNullSafe(F.col("key")))
    found = settle(by_tile(met.select("run", "a", "b", "tile", "fp", "copies", "_text"), lambda b: lean(_verified, b, num, den), "fp binary, links long, least binary"))
    roots = components(found.select(F.col("fp").alias("u"), F.col("least").alias("v")))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    classes = sets.select("fp", "key", "copies").join(links, "fp", "left").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = settle(classes)
    ids = classes.groupBy("root").agg(F.min("key").alias("class_id"))
    classes = classes.join(ids, "root").select("fp", "class_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("key", "_row", "fp", F.col("n").alias("n_shingles")).join(classes, "fp", "left")
    own = F.col("fp").isNull()
    return out.select("key", "_row", F.when(own, F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_shingles", F.coalesce(F.hex("root"), F.concat(F.lit("row "), F.col("_row").cast("string"))).alias("class"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without all but one row of each class (least key, then least row hash; repeated rows count once)."""
    found = jaccard_classes(docs, key, text)
    best = found.groupBy("class").agg(F.min(F.struct(F.col("key").isNull(), "key", "_row")).alias("b")).select(F.col("b._row").alias("_row"))
    (h,) = fresh(docs, "_row")
    rows = docs.withColumn(h, row_hash(docs[key], docs[text]))
    # one exchange by the row hash serves both
    return rows.join(best.select(F.col("_row").alias(h)), h, "left_semi").dropDuplicates([h, key]).select(*docs.columns)
