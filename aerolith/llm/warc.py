"""WARC archives: written with revisit records, read by tasks that each own a range of bytes.

Every record is a gzip member of its own. A reading task scans its range for the gzip magic,
tries each place by inflating a little of it, and takes it for a member when a WARC
header comes out; it owns the records that start inside its range and reads them to their
end, beyond the range if need be. So files need no index and split anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import n_partitions, open_store, put, settle, workspace

GZIP = b"\x1f\x8b\x08"
SPLIT = 4 << 20
READ = 1 << 20
#: First step of reading beyond a range, for its last record.
BEYOND = 1 << 16
#: Digests of this share of all rows at least are handed to every task: at most so many.
HOT = 1_000
FILE = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    h = hashlib.md5(f"warc record {key}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _line(value: object) -> str:
    """A header value holds no line breaks."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def member(key: object, url: str | None, payload: bytes | None, length: int, payload_digest: str, refers_to: object) -> bytes:
    """One record as a gzip member; with refers_to a revisit without the payload, whose length its HTTP header keeps."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(_line(key))}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url or 'urn:none')}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Page-ID: {_line(key)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(_line(refers_to))}", f"X-Refers-To-Page-ID: {_line(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def _written(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    held, size, n, done = [], 0, 0, []

    def flush() -> None:
        nonlocal held, size, n
        if held:
            data = b"".join(held)
            # the name comes from the content: a repeated attempt writes the same file
            name = f"{folder}/{hashlib.md5(data).hexdigest()}.warc.gz"
            put(name, data)
            done.append((name, len(data), n))
            held, size, n = [], 0, 0

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            for key, url, html, length, sha, refers in zip(*(part.column(c).to_pylist() for c in ("key", "url", "payload", "length", "sha", "refers_to")), strict=True):
                m = member(key, url, html, length, base64.b32encode(bytes.fromhex(sha)).decode(), refers)
                held.append(m)
                size, n = size + len(m), n + 1
                if size >= file_bytes:
                    flush()
    flush()
    yield _batch(done, [("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, file_bytes: int = FILE) -> DataFrame:
    """Write a record for every row; returns the manifest (file, bytes, records).

    Of equal payloads of at least `least` bytes the one with the greatest key is a response and the others
    revisit it; shorter ones are responses. Null html is an empty payload. A row with a
    null key is a response. Of repeated rows with the greatest key all are responses.
    """
    payload = F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # digests alone are grouped (a copy in each map task), then met by one row each
    last = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1")
    last = settle(last)
    # payloads of the most common digests stay where they are (there are at most HOT such digests); a revisit goes without its payload
    few = rows.count() // HOT
    hot = F.broadcast(last.where(F.col("n") > few).select("sha", F.col("last").alias("_hot")))
    rest = last.where(F.col("n") <= few).select(F.col("sha").alias("_at"), F.col("last").alias("_last"))
    rows = rows.withColumn("length", F.octet_length("payload").cast("long")).join(hot, "sha", "left")
    # rows of a common digest are dealt by their key
    rows = rows.withColumn("_at", F.when(F.col("_hot").isNull(), F.col("sha")).otherwise(F.xxhash64("key", "url").cast("string")))
    rows = rows.withColumn("payload", F.when(F.col("_hot").isNull() | F.col("key").isNull() | (F.col("key") >= F.col("_hot")), F.col("payload")))
    rows = rows.join(rest, "_at", "left").withColumn("_last", F.coalesce("_hot", "_last"))
    rows = rows.withColumn("refers_to", F.when(F.col("key") < F.col("_last"), F.col("_last"))).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    return settle(rows.select("key", "url", "payload", "length", "sha", "refers_to").mapInArrow(lambda b: _written(b, folder, file_bytes), "file string, bytes long, records long"))


def _header(data: bytes) -> tuple[dict, bytes] | None:
    """Header fields and what follows them, None if the end of the header is not there."""
    at = data.find(b"\r\n\r\n")
    if at < 0:
        return None
    fields = {}
    for line in data[:at].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, data[at + 4 :]


class Window:
    """Part of a file in memory: read on in steps, let go from the front, no byte read twice."""

    def __init__(self, fetch, start: int, end: int, step: int = READ, beyond: int = BEYOND):
        self._fetch, self.base, self._end, self._step, self._beyond = fetch, start, end, step, beyond
        self.data, self.over = bytearray(), False

    def more(self) -> bool:
        """Reads on: whole steps inside the range, small ones that double beyond it."""
        at = self.base + len(self.data)
        if at < self._end:
            n = min(self._step, self._end - at)
        else:
            n, self._beyond = self._beyond, min(2 * self._beyond, self._step)
        got = b"" if self.over else self._fetch(at, n)
        self.over = self.over or len(got) < n
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[: to - self.base]
        self.base = to


def parse_member(window: Window, at: int) -> tuple[dict, bytes, int] | None:
    """The record of a member that starts at `at` (fields, block, its end), or None if none does."""
    z, out, pos, n = zlib.decompressobj(31), [], at - window.base, 0
    try:
        while not z.eof:
            if pos >= len(window.data) and not window.more():
                return None
            # a little first: most false magic ends here
            part = bytes(window.data[pos : pos + (1024 if not out else 1 << 16)])
            pos += len(part)
            out.append(z.decompress(part))
            n += len(out[-1])
            begin = b"".join(out)[:7] if n < 1 << 16 else b"WARC/1."
            if not b"WARC/1.".startswith(begin):
                return None
    except zlib.error:
        return None
    whole = b"".join(out)
    head = _header(whole) if whole.startswith(b"WARC/1.") else None
    if head is None:
        return None
    fields, rest = head
    size = int(fields.get("content-length", "-1"))
    if size < 0 or len(rest) < size:
        return None
    return fields, rest[:size], window.base + pos - len(z.unused_data)


def scan(fetch, start: int, end: int, step: int = READ, beyond: int = BEYOND) -> Iterator[tuple[dict, bytes]]:
    """Records whose members start in [start, end); the range is read once, and on from its end to that of its last record."""
    window, at = Window(fetch, start, end, step, beyond), start
    while at < end:
        k = window.data.find(GZIP, at - window.base)
        if k < 0:
            # the magic may lie across the end of what is there
            at = max(at, window.base + len(window.data) - len(GZIP) + 1)
            window.drop(at)
            if at >= end or not window.more():
                return
            continue
        if window.base + k >= end:
            return
        found = parse_member(window, window.base + k)
        at = window.base + k + 1
        if found is not None:
            yield found[0], found[1]
            at = found[2]
        if at - window.base > step:
            window.drop(at)


def _records(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())
    number = (lambda v: None if v in (None, "None") else v) if key_type == pa.string() else (lambda v: None if v in (None, "None") else int(v))
    fields = [("key", key_type), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", key_type), ("payload", pa.binary())]
    for batch in batches:
        for file, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end")), strict=True):
            store, path = open_store(file)
            out, held = [], 0
            with store.open_input_file(path) as f:
                for said, block in scan(lambda a, n, f=f: f.read_at(n, a), start, end):
                    head, _, body = block.partition(b"\r\n\r\n")
                    size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
                    sha, whole = said.get("warc-payload-digest", "").removeprefix("sha1:"), said["warc-type"] == "response"
                    if whole and digest(body) != sha:
                        raise ValueError(f"{file}: payload of {said.get('warc-record-id')} does not match its digest")
                    out.append((number(said.get("x-page-id")), said.get("warc-target-uri"), size, sha, said["warc-type"], number(said.get("x-refers-to-page-id")), body if whole else None))
                    held += len(body)
                    if held >= READ:
                        yield _batch(out, fields)
                        out, held = [], 0
            yield _batch(out, fields)


def read_archives(files: DataFrame, kind: str = "bigint", split: int = SPLIT) -> DataFrame:
    """Read archives (file, bytes) by ranges: key, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)).cast("long"), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))
    return ranges.repartition(n_partitions(files.sparkSession), "file", "start").mapInArrow(lambda b: _records(b, kind), f"key {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    folder = workspace(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, key, url, html).select("file", "bytes"), dict(pages.dtypes)[key])
