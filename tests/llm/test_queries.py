"""Registered queries, called as the driver calls them, against plain Python."""

import functools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from aerolith.llm import packing, pii, queries

from llm_cases import frame, odd_rows
from test_files import by_key_and_text
from test_native import WORD, brute_targets
from test_text import brute_classes

public_tokenizers = pytest.importorskip("public_tokenizers")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose tokens are many and whose words are one or few.
DENSE = [(800, "日本語" * 40_000, "a"), (801, "QmFzZTY0" * 4_000, "a"), (802, "a <|endoftext|> b", "b"), (805, "x<|startoftext|>y<|ENDOFTEXT|>,<|endoftext|>", "b"), (803, "x9" * 300, "b"), (804, "x9" * 300, "b")]
#: Names of many words, in several cases and under several honorifics, and long secrets.
PRIVATE = [
    (820, "Dr Anna Maria Schmidt wrote to Herr Ludwig van Beethoven, Frau von der Leyen and Mr. J. R. Tolkien. The end", "a"),
    (821, "Mr. Smith met Mr. SMITH; Dr Jane Austen is Mrs Jane Austen", "a"),
    (822, "key " + "0123456789abcdef" * 8 + "0 and " + "ABCDEF0123" * 3_000 + " end", "b"),
    (823, "Mr " + "Longname " * 20_000 + "end", "b"),
]


@functools.cache
def ids(text):
    """Ids of a whole text by the library's defaults, with the end id."""
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def tokens(text):
    return len(ids(text))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    frame(spark, [*odd_rows(), *DENSE, *PRIVATE]).select(COLUMNS).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_packing_counts_tokens(spark, folder):
    want = Counter((i, tokens(t)) for i, t, _ in [*odd_rows(), *DENSE, *PRIVATE])
    assert tokens(DENSE[0][1]) > packing.TOKENS
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for rows in (queries.op10_length_packing(spark, folder).collect(), corpus_pipeline.pack_batches(spark, docs, folder).collect()):
        assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == want
        batches = defaultdict(list)
        for r in rows:
            batches[r["bucket"], r["batch"]].append(r)
        for g in batches.values():
            assert sum(r["n_tokens"] + r["padding"] for r in g) <= packing.TOKENS or len(g) == 1
        assert [len(g) for g in batches.values() if any(r["doc_id"] == 800 for r in g)] == [1]


def test_surrogates_of_whole_mentions(spark, folder):
    rows = {r["doc_id"]: r for r in queries.op6_pii_surrogates(spark, folder).collect()}
    name = r"[A-Z][a-z]+ [A-Z][a-z]+"
    assert re.fullmatch(rf"Dr {name} wrote to Herr {name}, Frau {name} and Mr\. {name}\. The end", rows[820]["text"]) and rows[820]["n_entities"] == 4
    assert not re.search("Anna|Maria|Schmidt|Ludwig|van|Beethoven|Leyen|Tolkien", rows[820]["text"])
    a, b, c, d = re.fullmatch(rf"Mr\. (\w+) met Mr\. (\w+); Dr ({name}) is Mrs ({name})", rows[821]["text"]).groups()
    assert a != "Smith" and b == a.upper() and c == d != "Jane Austen" and c.split()[0] in pii.GIVEN["latin", "f"]
    short, long = re.fullmatch("key ([0-9a-f]+) and ([0-9A-F]+) end", rows[822]["text"]).groups()
    assert (len(short), len(long)) == (129, 30_000) and "0123456789abcdef" not in short and "ABCDEF0123" not in long
    assert "Longname" not in rows[823]["text"] and rows[823]["n_entities"] == 1


def test_ids_by_the_defaults(spark, folder):
    rows = [(i, ids(t)) for i, t, _ in sorted([*odd_rows(), *DENSE, *PRIVATE], key=by_key_and_text)]
    want, start = Counter(), 0
    for k, x in rows:
        want[k, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
        start += len(x)
    assert ids("a <|endoftext|> b") == [320, 49407, 321, 1]
    got = queries.op7_wavelet_ids(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def odd_vectors(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in np.float32(base[i % 6] + rng.normal(size=12) * 0.12)], i % 2) for i in range(60)]
    rows += [(3, rows[3][1], 1), (70, None, 0), (71, [0.0] * 12, 0), (72, [1.0, None] * 6, 0), (73, [float("nan")] * 12, 0), (74, [], 0), (75, rows[0][1], None), (76, [float("inf")] * 12, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "é" * 50), (4, "u", "é" * 50), (5, "u", "x" * 300_000), (6, "u\r\nv", "x"), (7, "u", "x" * 300_000)]
    return spark.createDataFrame(rows + [(10 + i, "u", "common page") for i in range(40)], "page_id long, url string, html string")


@pytest.mark.parametrize("data", ["odd", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, folder, tmp_path, name, data):
    views = {t: f"{data}/{t}.parquet" for t in ("documents", "embeddings", "pages")}
    if data == "odd":
        data = str(tmp_path)
        spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{data}/documents.parquet")
        odd_vectors(spark).write.parquet(f"{data}/embeddings.parquet")
        odd_pages(spark).write.parquet(f"{data}/pages.parquet")
        views = {t: f"{data}/{t}.parquet/*.parquet" for t in views}
    con = duckdb.connect()
    for t, files in views.items():
        con.execute(f"create view {t} as select * from read_parquet('{files}')")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    df = queries.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    want = Counter(map(plain, cursor.fetchall()))
    if name == "op2_jaccard_join":  # SQL has no verdict on a row without a key
        columns = columns[:4]
        want = Counter(r[:4] for r in want.elements())
    assert Counter(map(plain, df.select(columns).collect())) == want


def test_joins_shards_and_mixes_by_name(spark, folder):
    rows = [*odd_rows(), *DENSE, *PRIVATE]
    found = queries.op2_jaccard_join(spark, folder).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == brute_classes(rows)
    placed = queries.op3_hilbert_sharding(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in placed) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in queries.op4_source_mixing(spark, folder).collect():
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-6) for s in want)
