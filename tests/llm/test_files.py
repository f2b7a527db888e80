"""Vectors, wavelet matrix files and WARC archives against brute force and round trips."""

import base64
import gzip
import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from aerolith.llm import vectors, warc, wavelet
from aerolith.llm.common import workspace

from llm_cases import frame, odd_rows

public_tokenizers = pytest.importorskip("public_tokenizers")


def brute_links(rows, cosine=0.98):
    ok = [v is not None and lab is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for _, v, lab in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if ok[i] and ok[j] and la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, links[i], least[find(i)]) for i, (k, _, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [512, 5])
def test_links_match_all_pairs(spark, tile):
    rng = np.random.default_rng(8)
    f32 = lambda v: [float(x) for x in np.asarray(v, np.float32)]
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(5):
                rows.append((k, f32(base + rng.normal(size=16) * 0.14), label))
                k += 1
    same = f32(rng.normal(size=16))
    rows += [(k + i, same, 1) for i in range(30)] + [(k + 40, f32(2 * np.array(same)), 1), (k + 41, same, 2), (k + 42, same, None)]
    rows += [(k + 50, None, 0), (k + 51, [0.0] * 16, 0), (k + 52, [1.0, None] * 8, 0), (k + 53, [float("nan")] * 16, 0), (k + 54, [float("inf")] * 16, 0), (k + 55, [], 0), (k + 56, [1.0, 2.0], 0), (k + 57, [1.0, 2.0], 0), (k + 56, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).withColumn("key", F.lit(1))
    got = vectors.near_duplicates(df, tile=tile).collect()
    assert Counter((r["key"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows)
    assert all(r["kept"] == (r["key"] == r["component_id"]) for r in got)
    assert vectors.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_matrix_answers(spark):
    rng = np.random.default_rng(2)
    for n, bits in ((0, 4), (1, 1), (700, 3), (400_000, 9)):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint16)
        raw = wavelet.encode_segment(ids, bits, {"x": 1})
        s = wavelet.Segment(lambda a, k, raw=raw: raw[a : a + k])
        assert s.n == n and s.about == {"x": 1} and (s.decode() == ids).all()
        for i in rng.integers(0, n, 40) if n else []:
            t, end = int(ids[i]), int(rng.integers(0, n + 1))
            assert s.access(int(i)) == t and s.count(t) == (ids == t).sum() and s.count(t, end) == (ids[:end] == t).sum()
            where = np.flatnonzero(ids == t)
            assert s.occurrence(t, 0) == where[0] and s.occurrence(t, len(where) - 1) == where[-1]
        if n:
            with pytest.raises(IndexError):
                s.access(n)
    assert s.count(1 << 12) == 0


def by_key_and_text(row):
    """Ascending keys, null last, then Spark's hash of the text as a signed number."""
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), seed=42)
    return row[0] is None, row[0] or 0, h - (1 << 64) * (h >> 63)


def spec(name="word_bpe_49k.json"):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


ODD_TEXTS = ["", "   ", "a  b", "\n x\n", "İstanbul œuvre ŒUVRE don't it's 'tis 12ab ab12 a,b. ...!? ., x", "Straße ÉCOLE À-propos naïve école nb sp <|endoftext|> <|startoftext|>x", "日本語 テキスト 한국어 😀😀 Ω ΣΑΣ", "a\x1cb\x85c d", "été É", "?", ".a .a. a.. a.,;' ''s 's!", "THE!! THE&&& the### #the |", "ﬁn Ĳ ǅ ß ẞ"]


def test_words_alone_give_the_ids_of_the_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec())
    t.encode_special_tokens = True
    ids = wavelet.TextIds(spec(), np.uint16, not wavelet.drops_white_space(json.loads(spec())), 1)
    assert wavelet.drops_white_space(json.loads(spec()))
    for _ in range(2):  # the second time from what is held
        for text, got in zip(ODD_TEXTS, ids.of(pa.array(ODD_TEXTS)).to_pylist(), strict=True):
            assert list(np.frombuffer(got, np.uint16)) == [*t.encode(text, add_special_tokens=False).ids, 1], text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_files_give_the_ids_back(spark, odd, none, name):
    from tokenizers import Tokenizer

    rows = [*odd_rows(), *((700 + i, t, "a") for i, t in enumerate(ODD_TEXTS))]
    t = Tokenizer.from_str(spec(name))
    t.encode_special_tokens = True
    ids = [(k, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for k, x, _ in sorted(rows, key=by_key_and_text)]
    want, start = Counter(), 0
    for k, x in ids:
        want[k, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
        start += len(x)
    folder = workspace(spark, "test")
    manifest = wavelet.write_ids(frame(spark, rows), spec(name), folder, segment=500, shard_bytes=20_000)
    assert manifest.count() > 5
    got = wavelet.read_ids(manifest).collect()
    assert Counter((r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert wavelet.locate(manifest, 1).agg(F.sum("n")).first()[0] == sum(x.count(1) for _, x in ids)
    assert wavelet.round_trip(none, spec(name)).count() == 0


def test_far_off_null_and_repeated_keys_do_not_share_a_shard(spark):
    rows = [(i, f"word{i} " * 10, "a") for i in range(600)] + [(10**15, "far off", "a")] + [(None, f"none {i} " * 10, "a") for i in range(300)] + [(7, f"again {i} " * 10, "b") for i in range(300)]
    manifest = wavelet.write_ids(frame(spark, rows), spec(), workspace(spark, "test"), shard_bytes=4_000).collect()
    assert len({r["shard"] for r in manifest}) > 15 and max(r["n_docs"] for r in manifest) < 250
    back = wavelet.read_ids(spark.createDataFrame(manifest)).orderBy("start").collect()
    assert [r["key"] for r in back] == [k for k, _, _ in sorted(rows, key=by_key_and_text)]


def test_words_that_the_vocabulary_does_not_close():
    """Without a mark on its last letters a word goes through the whole tokenizer."""
    from tokenizers import Tokenizer

    broken = json.loads(spec())
    broken["model"]["merges"], vocabulary = [], broken["model"]["vocab"]
    broken["model"]["vocab"] = {k: v for k, v in vocabulary.items() if not (k.endswith("</w>") and k.startswith("z"))}
    ids = wavelet.TextIds(json.dumps(broken), np.uint16, False, 1)
    t = Tokenizer.from_str(json.dumps(broken))
    t.encode_special_tokens = True
    for text, got in zip(["fuzz buzz, plain", "zz"], ids.of(pa.array(["fuzz buzz, plain", "zz"])).to_pylist(), strict=True):
        assert list(np.frombuffer(got, np.uint16)) == [*t.encode(text, add_special_tokens=False).ids, 1]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("sha", F.lit("clash")).withColumn("key", F.lit(0))


def page_rows():
    body = "<p>same</p>" * 50
    rows = [(i, f"http://h/{i}", body) for i in range(30)] + [(100 + i, "u", f"<i>{i}</i>" * (i * 37 % 400)) for i in range(50)]
    return rows + [(200, None, None), (201, "x", ""), (202, "y\r\nz", None), (203, "é", "WARC/1.1\r\n\r\n\x1f\u008b\x08é"), (204, "big", "ab" * 400_000), (100, "u", rows[30][2]), (None, "n", body)]


def test_archives_give_the_pages_back(spark, none):
    rows = page_rows()
    folder = workspace(spark, "test")
    files = warc.write_archives(pages(spark, rows).repartition(3), folder, file_bytes=3000)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    top = {}
    for k, _, h in rows:
        if k is not None:
            top[h or ""] = max(k, top.get(h or "", k))
    want = Counter()
    for k, _, h in rows:
        p = (h or "").encode()
        last = top.get(h or "")
        revisit = k is not None and k < last
        want[k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", last if revisit else None] += 1
    for split in (1 << 22, 700):
        got = warc.read_archives(files, split=split).collect()
        assert Counter((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
        assert all(r["payload"] is None if r["record_type"] == "revisit" else len(r["payload"]) == r["payload_bytes"] for r in got)
    assert warc.round_trip(pages(spark, rows).where("page_id < 0")).count() == 0
    short = warc.read_archives(warc.write_archives(pages(spark, rows), workspace(spark, "test"), least=10_000))
    assert short.where("record_type = 'revisit'").count() == 0


def test_every_split_owns_each_record_once():
    members = [warc.member(i, "u", f"body {i} ".encode() * (i * 13 % 90), 0, "D", None) for i in range(40)]
    decoy = gzip.compress(b"not a record")
    data = b"".join(members[:20]) + decoy + b"\x1f\x8b\x08 junk" + b"".join(members[20:])
    fetch = lambda a, n: data[a : a + n]
    for size in (97, 1000, len(data)):
        found = [int(f["x-page-id"]) for a in range(0, len(data), size) for f, _ in warc.scan(fetch, a, min(a + size, len(data)), step=64)]
        assert found == list(range(40))
    assert list(warc.scan(lambda a, n: members[0][:-30][a : a + n], 0, 500)) == []  # cut short


@pytest.mark.parametrize("size", [5_000, 200_000])
def test_reads_little_more_than_the_file(size):
    """Bytes fetched by all ranges of a file of small records, at most twice its length."""
    rng = np.random.default_rng(size)
    data = b"".join(warc.member(i, "u", rng.bytes(int(rng.integers(50, 600))), 0, "D", None) for i in range(2_000))
    fetched, found = 0, 0
    for a in range(0, len(data), size):
        def fetch(at, n):
            nonlocal fetched
            fetched += len(data[at : at + n])
            return data[at : at + n]

        found += sum(1 for _ in warc.scan(fetch, a, min(a + size, len(data)), beyond=1 << 10))
    assert found == 2_000 and fetched <= 2 * len(data)
