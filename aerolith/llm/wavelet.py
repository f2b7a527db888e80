"""Token ids in wavelet matrices: one compressed file a segment that answers access, count and occurrence.

A segment holds whole documents in order, at most SEGMENT ids unless one document alone has
more. Plane p holds bit p (from the top) of each id, after a stable partition by the
planes above it; chunks of a plane are compressed alone and each has the number of ones
before it, so a lookup opens a chunk or two of each plane.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm.common import lean, open_store, put, settle, workspace

MAGIC = b"AWM1"
CHUNK = 1 << 15
SEGMENT = 1 << 22
END = 1
#: Bytes of text that a shard is to hold, and how many shards there are at most (beyond, each has more segments).
SHARD_BYTES = 16 << 20
SHARDS = 1 << 16
#: Parts of words whose ids a Python worker keeps, and as many from before.
WORDS = 400_000
#: Marks that may end a word; a run of them is one unit for the tokenizer.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that are one unit however they are mixed, and whose lower case is one letter: those of Latin-1.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]*$"


def encode_segment(ids: np.ndarray, bits: int, about: dict) -> bytes:
    """The file of a sequence of ids below 2**bits; about is kept in its header."""
    x, planes, body, at = ids, [], [], 0
    pack = zstandard.ZstdCompressor(level=1)
    for p in range(bits - 1, -1, -1):
        ones = (x & x.dtype.type(1 << p)) != 0
        packed = np.packbits(ones)
        chunks, before = [], 0
        for i in range(0, len(packed), CHUNK):
            part = packed[i : i + CHUNK]
            blob = pack.compress(part.tobytes())
            chunks.append((at, len(blob), before))
            before += int(np.bitwise_count(part).sum())
            body.append(blob)
            at += len(blob)
        planes.append({"zeros": int(len(x) - before), "chunks": chunks})
        x = np.concatenate([x.take(np.flatnonzero(~ones)), x.take(np.flatnonzero(ones))])
    head = pack.compress(json.dumps({"n": len(ids), "bits": bits, "planes": planes, "about": about}).encode())
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(body)


class Segment:
    """Reads a segment; fetch(start, length) gives bytes of its file."""

    def __init__(self, fetch):
        magic, n = struct.unpack("<4sI", fetch(0, 8))
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        head = json.loads(zstandard.ZstdDecompressor().decompress(fetch(8, n)))
        self.n, self.bits, self.planes, self.about = head["n"], head["bits"], head["planes"], head["about"]
        self._fetch, self._base, self._held = fetch, 8 + n, {}

    def _chunk(self, p: int, k: int) -> np.ndarray:
        if (p, k) not in self._held:
            if len(self._held) > 256:
                self._held.clear()
            at, size, _ = self.planes[p]["chunks"][k]
            self._held[p, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._fetch(self._base + at, size)), np.uint8)
        return self._held[p, k]

    def _bit(self, p: int, i: int) -> int:
        return int(self._chunk(p, i // (8 * CHUNK))[i // 8 % CHUNK] >> (7 - i % 8)) & 1

    def _ones(self, p: int, i: int) -> int:
        """Ones among the first i bits of plane p."""
        if i >= self.n:
            return self.n - self.planes[p]["zeros"]
        k, byte = divmod(i // 8, CHUNK)
        part = self._chunk(p, k)
        n = self.planes[p]["chunks"][k][2] + int(np.bitwise_count(part[:byte]).sum())
        return n + (int(part[byte]) >> (8 - i % 8)).bit_count() if i % 8 else n

    def _select(self, p: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of plane p."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(p, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            b = self._bit(p, i)
            ones = self._ones(p, i)
            i = self.planes[p]["zeros"] + ones if b else i - ones
            out = out << 1 | b
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        for p in range(self.bits):
            bit = token >> (self.bits - 1 - p) & 1
            oa, ob = self._ones(p, a), self._ones(p, b)
            a, b = (self.planes[p]["zeros"] + oa, self.planes[p]["zeros"] + ob) if bit else (a - oa, b - ob)
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """How often a token stands among the first `end` places (all by default)."""
        if not 0 <= token < 1 << self.bits:
            return 0
        a, b = self._range(token, self.n if end is None else min(end, self.n))
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - self.planes[p]["zeros"] if bit else i)
        return i

    def plane(self, p: int) -> np.ndarray:
        raw = [self._chunk(p, k) for k in range(len(self.planes[p]["chunks"]))]
        return np.unpackbits(np.concatenate(raw) if raw else np.empty(0, np.uint8), count=self.n).astype(bool)

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions are undone from the last plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            ones, z = self.plane(p), self.planes[p]["zeros"]
            out = np.empty_like(x)
            out[np.flatnonzero(~ones)] = x[:z]
            out[np.flatnonzero(ones)] = x[z:] | x.dtype.type(1 << (self.bits - 1 - p))
            x = out
        return x


def open_segment(uri: str, whole: bool = False) -> Segment:
    store, path = open_store(uri)
    f = store.open_input_file(path)
    if whole:
        data = f.read()
        f.close()
        return Segment(lambda a, n: data[a : a + n])
    return Segment(lambda a, n: f.read_at(n, a))


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TextIds:
    """Ids of whole texts, each with an end id, as an Arrow array of bytes.

    A tokenizer that drops white space neither joins words nor looks beyond one. So the texts of a
    batch are split and their distinct words numbered in Arrow; a word of plain letters and then
    marks is two units, which the tokenizer's model takes in its own byte letters and lower
    case, a thousand in one text; other words go through the whole tokenizer. A tokenizer of
    another kind gets whole texts. With `special`, as is the library's default, the name of a
    special token in a text is that token; without, it is ordinary characters.
    """

    def __init__(self, tokenizer_json: str, dtype, whole: bool, end: int, special: bool = False):
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_str(tokenizer_json)
        self._t.encode_special_tokens = not special
        self._dtype, self._whole = np.dtype(dtype), whole
        self._end = np.array([end], dtype).tobytes()
        self._letters = byte_letters()
        # what was held before the last clearing stays, so that frequent units come back without work
        self._held: list[dict[str, bytes]] = [{}, {}]
        self._old: list[dict[str, bytes]] = [{}, {}]
        if not whole:
            spec = json.loads(tokenizer_json)
            vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
            self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self._ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self._model = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self._dtype).tobytes() for i in range(0, len(texts), 64) for e in self._t.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]

    def _units(self, units: list[str]) -> list[bytes]:
        if "" in units:
            at = units.index("")
            rest = self._units(units[:at] + units[at + 1 :])
            return [*rest[:at], b"", *rest[at:]]
        out: list[bytes] = []
        for i in range(0, len(units), 1024):
            some = units[i : i + 1024]
            shown = " ".join(u if u.isascii() else u.encode().decode("latin-1").translate(self._letters) for u in some)
            ids = np.array(self._model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self._dtype)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(some) or not len(ends) or ends[-1] != len(ids):
                out += self._alone(some)  # a word that the vocabulary does not close
                continue
            raw, size = ids.tobytes(), self._dtype.itemsize
            at = (ends * size).tolist()
            out += [raw[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)]
        return out

    def _of(self, parts: pa.Array, learn: Callable[[list[str]], list[bytes]], kind: int) -> list[bytes]:
        """Ids of distinct units (kind 0) or odd words (1), from what is held or anew."""
        keys = parts.to_numpy(zero_copy_only=False).tolist()
        held, old = self._held[kind], self._old[kind]
        found = list(map(held.get, keys))
        lacking = [i for i, x in enumerate(found) if x is None]
        if lacking:
            names = [keys[i] for i in lacking]
            ids = list(map(old.get, names))
            anew = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(anew, learn([names[i] for i in anew]), strict=True):
                ids[i] = x
            for i, x in zip(lacking, ids, strict=True):
                found[i] = x
            if len(held) + len(names) > WORDS:
                self._old[kind], self._held[kind] = held, {}
            self._held[kind].update(zip(names, ids, strict=True))
        return found

    def _entries(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, the length of each entry, the entries of all texts in order, their running length, and its value at the ends of texts."""
        lists = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        word, words = coded.indices.to_numpy(), coded.dictionary
        core = pc.ascii_rtrim(words, MARKS)
        tail = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy()
        plain = pc.match_substring_regex(core, PLAIN).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(core.filter(pa.array(plain))).dictionary_encode()
        # one table of ids for units, ends of words, odd words, and the end id at its very end
        table = self._of(low.dictionary, self._units, 0)
        first = np.zeros(len(words), np.int64)
        first[plain] = low.indices.to_numpy()
        second = np.full(len(words), -1, np.int64)
        marked = np.flatnonzero(plain & (tail > 0))
        ends = pa.array([w[-t:] for w, t in zip(words.take(pa.array(marked)).to_numpy(zero_copy_only=False).tolist(), tail[marked].tolist(), strict=True)], pa.string()).dictionary_encode()
        second[marked] = len(table) + ends.indices.to_numpy()
        table = table + self._of(ends.dictionary, self._units, 0)
        odd = np.flatnonzero(~plain)
        first[odd] = len(table) + np.arange(len(odd))
        table = table + self._of(words.take(pa.array(odd)), self._alone, 1) + [self._end]
        # each word occurrence is one or two entries of the table, each text ends with the last
        size = self._dtype.itemsize
        length = np.fromiter(map(len, table), np.int64, len(table)) // size
        two = (second >= 0)[word]
        entries = np.repeat(first[word], 1 + two)
        place = np.cumsum(1 + two)
        entries[place[two] - 1] = second[word[two]]
        text_ends = np.concatenate([[0], place])[np.cumsum(counts)]
        entries = np.insert(entries, text_ends, len(table) - 1)
        total = np.cumsum(length[entries])
        bounds = np.concatenate([[0], total[text_ends + np.arange(len(counts))]]) if len(counts) else np.zeros(1, np.int64)
        return table, length, entries, total, bounds

    def of(self, texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        if self._whole:
            return pa.array([x + self._end for x in self._alone(texts.to_pylist())], pa.binary())
        table, length, entries, total, bounds = self._entries(texts)
        start, lengths = np.cumsum(length) - length, length[entries]
        ids = np.frombuffer(b"".join(table), self._dtype)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(start[entries] - (total - lengths), lengths)
        out = ids[at]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((bounds * self._dtype.itemsize).astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids of() gives for each text."""
        texts = pc.fill_null(texts, "")
        if self._whole:
            return np.array([len(x) // self._dtype.itemsize + 1 for x in self._alone(texts.to_pylist())], np.int64)
        return np.diff(self._entries(texts)[-1])


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer looks at white-space separated words one by one."""
    steps = lambda part, inner: [x["type"] for x in (spec.get(part) or {}).get(inner, [])]
    split = next((x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), {})
    return (
        spec["model"].get("end_of_word_suffix") is not None
        and steps("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"]
        and steps("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
    )


def _text_ids(tokenizer_json: str, wide: bool, whole: bool, end: int, special: bool) -> TextIds:
    """Kept from task to task of one Python worker."""
    held = sys.modules.setdefault("_aerolith_text_ids", types.ModuleType("_aerolith_text_ids")).__dict__
    name = f"{wide} {whole} {end} {special} {hashlib.md5(tokenizer_json.encode()).hexdigest()}"
    return held[name] if name in held else held.setdefault(name, TextIds(tokenizer_json, np.uint32 if wide else np.uint16, whole, end, special))


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in a column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def token_count(text: Column, tokenizer_json: str, end: int = END, special: bool = False) -> Column:
    """Number of ids of a whole text with its end id; null and empty texts count 1."""
    spec = json.loads(tokenizer_json)
    bits, whole = id_bits(spec, end), not drops_white_space(spec)
    held = SparkSession.active().sparkContext.broadcast(tokenizer_json)

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = _text_ids(held.value, bits > 16, whole, end, special)
        for texts in batches:
            parts = by_bytes(pa.RecordBatch.from_arrays([texts], ["_text"]), "_text")
            yield pa.array(np.concatenate([np.empty(0, np.int64), *(ids.lengths(p.column("_text")) for p in parts)]), pa.int64())

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lean(counted, batches)

    return F.arrow_udf(count, "long")(text.cast("string"))


def id_bits(spec: dict, end: int) -> int:
    """Bits that hold every id of a tokenizer, and the end id."""
    return max(1, max([end, *spec["model"]["vocab"].values(), *(a["id"] for a in spec.get("added_tokens", []))]).bit_length())


def _written(batches: Iterator[pa.RecordBatch], folder: str, tokenizer_json: str, bits: int, whole: bool, end: int, segment: int, special: bool) -> Iterator[pa.RecordBatch]:
    """Tokenises a shard's rows, which come sorted, and writes a file whenever a segment is full."""
    wide, shard, seg = bits > 16, TaskContext.get().partitionId(), 0
    ids, held, keys, size, done = _text_ids(tokenizer_json, wide, whole, end, special), [], [], 0, []

    def flush() -> None:
        nonlocal seg, held, keys, size
        if held:
            name = f"{folder}/shard-{shard:05d}-{seg:06d}.awm"
            put(name, encode_segment(np.concatenate(held), bits, {"keys": keys, "lengths": [len(x) for x in held]}))
            done.append({"shard": shard, "seg": seg, "file": name, "n_tokens": size, "n_docs": len(keys)})
            seg, held, keys, size = seg + 1, [], [], 0

    for batch in batches:
        for part in by_bytes(batch, "_text"):
            for key, raw in zip(part.column("key").to_pylist(), ids.of(part.column("_text")), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint32 if wide else np.uint16)
                if held and size + len(x) > segment:
                    flush()
                held.append(x)
                keys.append(key)
                size += len(x)
    flush()
    schema = pa.schema([("shard", pa.int32()), ("seg", pa.int32()), ("file", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
    yield pa.RecordBatch.from_pylist(done, schema)


def write_ids(docs: DataFrame, tokenizer_json: str, folder: str, key: str = "doc_id", text: str = "text", end: int = END, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES, special: bool = False) -> DataFrame:
    """Write the ids of every whole text in ascending key order; returns the manifest (shard, seg, file, n_tokens, n_docs).

    The key is a whole number; null keys come last, and rows with equal keys are in order of a hash of
    their texts. Shards are ranges of (key, hash) whose bounds Spark samples, so far-off, null and
    repeated keys do not pile up in one; each is tokenised and written by one task. Null and empty texts
    are the end id alone. An empty table writes nothing. special: see TextIds.
    """
    spec = json.loads(tokenizer_json)
    whole, bits = not drops_white_space(spec), id_bits(spec, end)
    rows = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    by = [F.col("key").asc_nulls_last(), F.xxhash64("_text").asc()]
    placed = rows.repartitionByRange(max(1, min(SHARDS, -(-total // shard_bytes))), *by).sortWithinPartitions(*by)
    return settle(placed.mapInArrow(lambda b: lean(_written, b, folder, held.value, bits, whole, end, segment, special), "shard int, seg int, file string, n_tokens long, n_docs long"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for file, first in zip(pdf["file"], pdf["first"], strict=True):
            s = open_segment(file, whole=True)
            ids = s.decode().astype("<u4")
            ends = np.cumsum(s.about["lengths"])
            starts = ends - s.about["lengths"]
            raw = memoryview(ids.tobytes())
            yield pd.DataFrame({"key": pd.array(s.about["keys"], "Int64"), "start": starts + first, "n_tokens": s.about["lengths"], "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]})


def read_ids(manifest: DataFrame) -> DataFrame:
    """Read the files back: key, start (ids before the document), n_tokens, ids_crc32."""
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # at most SHARDS rows
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before("shard")), F.lit(0)).alias("_before"))
    rows = manifest.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(before("shard", "seg")), F.lit(0)))
    rows = rows.join(F.broadcast(shards), "shard").select("file", (F.col("_before") + F.col("_inside")).alias("first"))
    spread_out = rows.repartition(max(1, manifest.count()), "file")
    return spread_out.mapInPandas(lambda b: lean(_read, b), "key long, start long, n_tokens long, ids_crc32 long")


def locate(manifest: DataFrame, token: int) -> DataFrame:
    """How often a token occurs in each segment, and where it occurs first, without decoding the segment."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file in pdf["file"]:
                s = open_segment(file)
                n = s.count(token)
                out.append((file, n, s.occurrence(token, 0) if n else None))
            yield pd.DataFrame({"file": [x[0] for x in out], "n": [x[1] for x in out], "first_at": pd.array([x[2] for x in out], "Int64")})

    return manifest.select("file").mapInPandas(look, "file string, n long, first_at long")


def round_trip(docs: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", special: bool = False) -> DataFrame:
    folder = workspace(docs.sparkSession, "wavelet")
    return read_ids(write_ids(docs, tokenizer_json, folder, key, text, special=special))
