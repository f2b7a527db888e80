"""Sharding, mixing, packing and the rule ledger against plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import mixing, packing, rules, sharding
from aerolith.llm.common import word_count, words
from aerolith.llm.quality import row_hash

from llm_cases import frame, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shards(df, n=8):
    keep = [df["doc_id"], F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")]
    return sharding.hilbert_shards(df, ["source", "lang", "n_chars"], n, keep, ["doc_id", "text_crc32"])


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_curve_steps_to_a_neighbour(spark, dims):
    bits = 2 if dims == 4 else 3
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"c{i} int" for i in range(dims)))
    rows = cells.select("*", sharding.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(len(rows)))
    for a, b in itertools.pairwise(rows):
        assert sum(abs(a[i] - b[i]) for i in range(dims)) == 1


def test_shards_are_even_and_gapless(odd, none):
    rows = shards(odd).collect()
    assert len(rows) == len(odd_rows())
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        mine = sorted((r["slot"], r["curve"]) for r in rows if r["shard"] == k)
        assert [s for s, _ in mine] == list(range(len(mine))) and [c for _, c in mine] == sorted(c for _, c in mine)
    crc = Counter((i, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows())
    assert Counter((r["doc_id"], r["text_crc32"]) for r in rows) == crc
    assert shards(none).count() == 0


def test_one_cell_with_all_rows_still_spreads(spark):
    df = frame(spark, [(i, "same text", "a") for i in range(500)])
    sizes = Counter(r["shard"] for r in shards(df).collect())
    assert sorted(sizes.values()) == [62, 62, 62, 62, 63, 63, 63, 63]


def brute_shards(rows, n=8, bits=5):
    """(doc_id, crc, curve, shard, slot) by plain sorting: exact quantiles, the curve's table, an MD5 for ties."""
    def bounds(values):
        values, bins, out = sorted(v for v in values if v is not None), 2**bits - 1, set()
        for v in set(values):
            low, high = sum(x < v for x in values), sum(x <= v for x in values)
            if any(low * bins < i * len(values) <= high * bins for i in range(1, bins)):
                out.add(v)
        return out

    digits, following = sharding.curve_table(3)
    dims = [[r[2].encode() if r[2] is not None else None for r in rows], [b"en"] * len(rows), [None if r[1] is None else len(r[1]) for r in rows]]
    ends = [bounds(d) for d in dims]
    found = []
    for i, (key, text, _) in enumerate(rows):
        at = [0 if d[i] is None else 1 + sum(b < d[i] for b in e) for d, e in zip(dims, ends, strict=True)]
        state = h = 0
        for level in range(bits - 1, -1, -1):
            cell = sum((c >> level & 1) << (2 - k) for k, c in enumerate(at))
            state, h = following[state * 8 + cell], h * 8 + digits[state * 8 + cell]
        tie = int(hashlib.md5(f"shard {'' if key is None else key}".encode()).hexdigest()[:15], 16)
        found.append((h, tie, key is not None, key or 0, zlib.crc32((text or "").encode())))
    out, starts = Counter(), [-(-k * len(rows) // n) for k in range(n + 1)]
    for rank, (h, _, known, key, crc) in enumerate(sorted(found)):
        shard = rank * n // len(rows)
        out[key if known else None, crc, h, shard, rank - starts[shard]] += 1
    return out


def test_shards_match_plain_sorting(odd):
    assert Counter((r["doc_id"], r["text_crc32"], r["curve"], r["shard"], r["slot"]) for r in shards(odd).collect()) == brute_shards(odd_rows())


def test_long_common_prefixes_keep_their_order(spark):
    rows = [(i, "t", f"https://www.site{i % 20}" if i % 21 else "a") for i in range(400)]
    got = Counter((r["doc_id"], r["text_crc32"], r["curve"], r["shard"], r["slot"]) for r in shards(frame(spark, rows)).collect())
    assert got == brute_shards(rows) and len({k[2] for k in got}) == 21


def test_ledger_prunes_and_files(spark, odd, tmp_path):
    df = odd.where("doc_id >= 10")
    book = sharding.shard_ledger(shards(df).join(df.select("doc_id", "source"), "doc_id"), ["source"]).collect()
    assert sum(r["rows"] for r in book) == 60
    sharding.write_shards(odd, ["source", "lang", "n_chars"], 8, ["doc_id", "text"], str(tmp_path / "s"))  # it has null and repeated keys, and columns shard and slot
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, _ in odd_rows())
    assert back.groupBy("shard_").count().count() == 8 and set(odd.columns) < set(back.columns)


def brute_targets(sizes, cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]] if total else []
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            open_.discard(s)


def test_targets_match_repeated_sharing(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        sizes = {f"s{i}": int(rng.integers(0, 1000)) for i in range(9)} | {None: 50, "big": 20_000}
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_mix_fills_every_budget(odd, none):
    rows = mixing.mix(odd, "doc_id", "source", word_count(odd["text"])).collect()
    sizes = defaultdict(int)
    for _, t, s in odd_rows():
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes))
    got = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        got[r["source"]] += r["taken"]
    assert len(rows) == len(odd_rows()) and all(got[s] == int(want[s] + 1e-6) for s in want)
    again = mixing.mix(odd.repartition(7), "doc_id", "source", word_count(odd["text"])).collect()
    assert Counter((r["key"], r["size"], r["taken"]) for r in again) == Counter((r["key"], r["size"], r["taken"]) for r in rows)
    assert mixing.mix(none, "doc_id", "source", word_count(none["text"])).count() == 0


def test_mixed_rows_repeat_whole_documents(odd):
    out = mixing.mixed_rows(odd, row_hash(odd["doc_id"], odd["text"]), "doc_id", "source", word_count(odd["text"]))
    assert out.columns == odd.columns
    texts = {t for _, t, _ in odd_rows()}
    assert {r["text"] for r in out.select("text").collect()} <= texts


def brute_padding(lengths, k):
    found = sorted(set(lengths))
    best = None
    for cut in itertools.combinations(found[:-1], min(k, len(found)) - 1):
        ends = [*cut, found[-1]]
        cost = sum(next(e for e in ends if e >= x) - x for x in lengths)
        best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 4):
        for _ in range(5):
            lengths = rng.integers(1, 40, 25).tolist()
            c = Counter(lengths)
            xs = np.array(sorted(c), float)
            ends = packing.best_bounds(xs, np.array([c[int(x)] for x in xs]), k)
            assert len(ends) <= k and sum(next(e for e in ends if e >= x) - x for x in lengths) == brute_padding(lengths, k)


def test_batches_keep_the_budget(odd, none):
    rows = packing.pack(odd, "doc_id", word_count(odd["text"]) + 1, n_buckets=4, tokens=256).collect()
    assert Counter((r["key"], r["length"]) for r in rows) == Counter((i, len(WORD.findall(t or "")) + 1) for i, t, _ in odd_rows())
    batches = defaultdict(list)
    for r in rows:
        batches[r["bucket"], r["batch"]].append(r)
        assert 0 <= r["padding"] == r["bucket_len"] - r["length"]
    for (b, _), g in batches.items():
        assert len(g) == 1 or len(g) * g[0]["bucket_len"] <= 256
        assert sorted(r["place"] for r in g) == list(range(len(g)))
    for b in {b for b, _ in batches}:
        assert sorted(k for x, k in batches if x == b) == list(range(sum(x == b for x, _ in batches)))
    assert packing.pack(none, "doc_id", word_count(none["text"])).count() == 0


def test_packing_matches_plain_ranking(spark):
    """Bounds by trying all of them, ranks by sorting; one length is far above the others."""
    rng = np.random.default_rng(6)
    rows = [(i, int(v)) for i, v in enumerate([*rng.choice([3, 5, 8, 20, 21, 300], 120), 100_000, 70_000, 70_001])] + [(None, 3), (None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, v long")
    got = packing.pack(df, "doc_id", F.col("v"), n_buckets=4, tokens=1000).collect()
    lengths = [v for _, v in rows]
    distinct = sorted(set(lengths))
    pad = lambda ends: sum(next(e for e in ends if e >= v) - v for v in lengths)
    ends = {e for r in got for e in [r["bucket_len"]]}
    assert len(ends) <= 4 and pad(sorted(ends)) == min(pad([*c, distinct[-1]]) for k in range(4) for c in itertools.combinations(distinct[:-1], k))
    order = {(r["doc_id"], r["v"]): r["h"] % 2**64 for r in df.select("*", F.xxhash64("doc_id", F.lit(10)).alias("h")).collect()}
    want, by_end = Counter(), defaultdict(list)
    for k, v in rows:
        by_end[next(e for e in sorted(ends) if e >= v)].append((order[k, v], k or -1, v, k))
    for n, e in enumerate(sorted(ends)):
        for rank, (_, _, v, k) in enumerate(sorted(by_end[e])):
            fit = max(1, 1000 // e)
            want[k, v, n, e, rank // fit, rank % fit] += 1
    assert Counter((r["key"], r["length"], r["bucket"], r["bucket_len"], r["batch"], r["place"]) for r in got) == want


def brute_measures(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(windows)
    covered = {j for i, x in enumerate(windows) if c[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def test_ledger_matches_python(spark, odd, none):
    extra = [(200, "a b c a b c a b c", "a"), (201, "x\nx\n\n x\ny\nx", "a"), (202, "# $ | <b> 100%\n" * 40, "b"), (203, "\x0b\x0cone\x1ctwo three", "b")]
    df = odd.unionByName(frame(spark, extra))
    rows = rules.ledger(df, "doc_id", "text").collect()
    want = Counter((i, *brute_measures(t)) for i, t, _ in [*odd_rows(), *extra])
    assert Counter((r["key"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        assert bool(r["fail_bits"] & rules.bit("short")) == (r["n_words"] < 50)
        assert bool(r["fail_bits"] & rules.bit("repeats")) == (100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert rules.ledger(none, "doc_id", "text").count() == 0


def test_policies_and_ablations(odd):
    book = rules.ledger(odd, "doc_id", "text").cache()
    loose, strict = (book.where(rules.verdict(p)).count() for p in ("v1", "v2"))
    assert loose >= strict
    found = {r["rule"]: r for r in rules.ablations(book).collect()}
    assert found["short"]["failed"] == book.where("n_words < 50").count()
    assert all(r["failed_alone"] <= r["failed"] for r in found.values()) and len(found) == len(rules.RULES)


def test_words_expression(odd):
    rows = odd.select("text", words(F.col("text")).alias("w"), word_count(F.col("text")).alias("n")).collect()
    assert all(r["w"] == WORD.findall(r["text"] or "") and r["n"] == len(r["w"]) for r in rows)
