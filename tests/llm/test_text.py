"""Classifier, near-duplicate join, surrogates and the pipeline against brute force."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from aerolith.llm import neardup, pii, quality

from llm_cases import frame, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labelled_docs(spark, n=400):
    rng = random.Random(1)
    good = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("are", "on", "ity", "ed")]
    bad = [f"{a}{b}" for a in "qxzvkjwy" for b in ("!!", "##", "zz", "%%")]
    rows, labels = [], []
    for i in range(n):
        junk = i % 4 == 0
        rows.append((i, " ".join(rng.choice(bad if junk else good) for _ in range(rng.randint(30, 90))), "a"))
        if i % 2 == 0:
            labels.append((i, int(not junk)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), {i: i % 4 != 0 for i in range(n)}


def test_classifier_on_rows_it_has_not_seen(spark):
    docs, labels, truth = labelled_docs(spark)
    rows = quality.resample(docs, labels).collect()
    assert len(rows) == 400
    unseen = [r for r in rows if r["key"] % 2]
    assert all(r["kept"] for r in unseen)  # all odd ids are good
    assert np.mean([r["kept"] == truth[r["key"]] for r in rows]) > 0.99
    again = quality.resample(docs.repartition(5), labels).collect()
    assert {r["key"]: (r["kept"], round(r["noisy"], 6)) for r in rows} == {r["key"]: (r["kept"], round(r["noisy"], 6)) for r in again}
    kept = quality.kept_rows(docs, quality.resample(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def plain_buckets(text):
    """Buckets of words and pairs of words, hashed with Python's integers."""
    full = (1 << 64) - 1

    def bucket(x):
        x ^= x >> 32
        x = x * 0x9E3779B97F4A7C15 & full
        return (x ^ x >> 29) >> 48

    h = [xxhash.xxh3_64_intdigest(w.encode()) >> 1 for w in WORD.findall(text or "")]
    return [bucket(x) for x in h] + [bucket((a * 0x100000001B3 + b + 1) & full) for a, b in zip(h, h[1:], strict=False)]


def test_weights_and_top_k_by_brute_force(spark, odd):
    docs, labels, _ = labelled_docs(spark)
    docs = docs.unionByName(odd.select(*docs.columns))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {r["doc_id"]: (r["quality"], r["x"] > 0) for r in labels.withColumn("x", F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED + 100)), F.lit(3))).collect()}
    raw, good = Counter(), Counter()
    for k, t in texts:
        raw.update(plain_buckets(t))
        if held.get(k) == (1, True):
            good.update(plain_buckets(t))
    size = 1 << quality.BITS
    log_p = lambda c, b: math.log((c[b] + quality.SMOOTH) / (c.total() + quality.SMOOTH * size))
    ratio = {b: log_p(good, b) - log_p(raw, b) for b in raw}
    mean = lambda t: sum(ratio[b] for b in plain_buckets(t)) / (len(plain_buckets(t)) + quality.PRIOR)
    out = [(k, mean(t)) for k, t in texts if k in held and not held[k][1] and plain_buckets(t)]
    ok, bad = (np.array([x for k, x in out if held[k][0] == want]) for want in (1, 0))
    cut = quality.best_cut(ok, bad)
    scale = quality.GAP / (np.median(ok) - np.median(bad))
    want = Counter((k, round((mean(t) - cut) * scale, 2)) for k, t in texts)
    for k in (None, 37):
        rows = quality.resample(docs, labels, k=k).collect()
        assert len(rows) == len(texts)
        near = Counter((r["key"], round(r["log_weight"], 2)) for r in rows)
        assert (want - near).total() <= 0.02 * len(texts)  # single precision at the edge of a hundredth
        some = sorted((r["noisy"] for r in rows if r["n_features"]), reverse=True)
        least = some[(k or sum(r["log_weight"] >= 0 for r in rows if r["n_features"])) - 1]
        assert all(r["kept"] == (r["n_features"] > 0 and r["noisy"] >= least - 1e-6) for r in rows)
    noise = np.sort([r["noisy"] - r["log_weight"] for r in rows])
    assert np.abs(np.exp(-np.exp(-noise)) - (np.arange(len(noise)) + 0.5) / len(noise)).max() < 0.08


def test_classifier_edges(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (4, 0), (11, 1), (12, 0), (13, None)], "doc_id long, quality int")
    rows = quality.resample(odd, labels).collect()
    assert len(rows) == len(odd_rows())
    assert not any(r["kept"] for r in rows if r["n_features"] == 0)
    assert quality.resample(none, labels).count() == 0
    nolabels = quality.resample(odd, labels.where("doc_id < 0")).collect()
    assert all(r["kept"] for r in nolabels if r["n_features"])


def test_counts_are_those_of_the_buckets():
    text = "a b a".encode()
    at = quality.ngram_buckets(text, quality.WordHash())
    assert len(at) == 5 and at[0] == at[2] and len(quality.ngram_buckets(b"", quality.WordHash())) == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-(2**40), 2**40, 500).tolist() + [7] * 40
    df = spark.createDataFrame([(x,) for x in v], "v long")
    for k in (1, 2, 250, 540):
        assert quality.kth_largest(df, "v", k) == sorted(v, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 0) is None


def brute_classes(rows, num=4, den=5):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(t or "")
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if n else None)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _, _) in enumerate(rows):
        least[find(i)].append(k)
    ids = {f: min((k for k in v if k is not None), default=None) for f, v in least.items()}
    return Counter((k, ids[find(i)], links[i]) for i, (k, _, _) in enumerate(rows))


def near_copies(seed, groups, size, edits, length=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, k = [], 1000 * seed
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            k += 1
            rows.append((k, " ".join(t), "a"))
    return rows


def test_classes_match_all_pairs(spark, odd, none):
    rows = odd_rows() + near_copies(1, 8, 6, 4) + near_copies(2, 1, 40, 2) + [(5000, "one two three", "a"), (5001, "one two three", "a"), (5002, "one two", "a")]
    got = neardup.jaccard_classes(frame(spark, rows)).collect()
    assert Counter((r["key"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)
    assert neardup.jaccard_classes(none).count() == 0


def test_small_tiles_give_the_same(spark, monkeypatch):
    rows = near_copies(3, 2, 30, 3)
    cut = neardup.tiled
    monkeypatch.setattr(neardup, "tiled", lambda run, at, size, node, tile=8: cut(run, at, size, node, 8))
    got = neardup.jaccard_classes(frame(spark, rows)).collect()
    assert Counter((r["key"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def test_one_of_each_class(spark, odd):
    rows = odd_rows() + near_copies(1, 3, 5, 2)
    df = frame(spark, rows)
    out = neardup.one_of_each(df)
    kept = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    want = {c for _, c, _ in brute_classes(rows)}
    assert out.columns == df.columns and {k for k in kept if k is not None} == want - {None} and max(v for k, v in kept.items() if k is not None) == 1


def test_prefix_meets_the_recall():
    k = neardup.prefix_length(0.7)
    assert 1 - (1 - 0.7**k) ** neardup.TREES >= neardup.RECALL > 1 - (1 - 0.7 ** (k + 1)) ** neardup.TREES


def test_runs_of_the_forest(spark, monkeypatch):
    """Runs against prefixes counted one by one, over several parts."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 6, (30, neardup.TREES * neardup.DEPTH))
    sigs = [np.where(rng.random(base.shape[1]) < 0.1, rng.integers(0, 9, base.shape[1]), base[i % 30 if i % 3 else 0]).astype(">u2").tobytes() for i in range(300)]
    fps = [i.to_bytes(16, "big") for i in range(300)]
    monkeypatch.setattr(neardup, "PATHS", 200)
    got = defaultdict(set)
    for r in neardup.runs_of(spark.createDataFrame(list(zip(fps, sigs, strict=True)), "fp binary, sig binary"), 0.8, 8).collect():
        got[r["run_id"], r["m"]].add(bytes(r["fp"]))
    want, longest = Counter(), neardup.prefix_length(0.8)
    depths = range(longest - neardup.BEYOND, longest + 1)
    for t in range(neardup.TREES):
        path = [s[t * neardup.PATH : (t + 1) * neardup.PATH] for s in sigs]
        counts = {d: Counter(p[: 2 * d] for p in path) for d in depths}
        runs = defaultdict(set)
        for i, p in enumerate(path):
            runs[p[: 2 * next((d for d in depths if counts[d][p[: 2 * d]] <= 8), longest)]].add(fps[i])
        want.update(frozenset(v) for v in runs.values() if len(v) > 1)
    assert Counter(frozenset(v) for v in got.values()) == want and all(len(v) == m for (_, m), v in got.items())
    assert {len(v) > 8 for v in want} == {True, False}


@pytest.mark.parametrize("size", [2, 5, 30])
def test_recall_of_links(spark, monkeypatch, size):
    """Links found of those that brute force finds, near the threshold, by size of the cluster."""
    monkeypatch.setattr(neardup.runs_of, "__defaults__", (4,))
    rows = near_copies(size, 120 // size, size, 5)
    got = neardup.jaccard_classes(frame(spark, rows)).collect()
    want = sum(n for _, _, n in brute_classes(rows).elements())
    assert want and 0.98 * want <= sum(r["n_links"] for r in got) <= want


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    s = neardup.minhashes([np.unique(a), np.unique(b)], 960)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.06
    sets = [np.unique(x) for x in (a[:5], a[3:9], a[20:21], a[:9])]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets]
    assert neardup.overlaps(sets).tolist() == want and neardup.overlaps(sets[:2]).tolist() == [r[:2] for r in want[:2]]


MENTIONS = "Write to Jo.Doe@Mail.example.com, or jo.doe@mail.example.com! Call +1 (212) 555-0187; +1 212 555 0187. Card 4111 1111 1111 1111 or 4111111111111111. IP 10.20.30.40. SSN 078-05-1120. token = \"2c8ba23e1529b2de52654cb5a51fb5655bd4ec6f\" Mrs. Jane Smith and Mr. John Smith met Г. Version 3.0, 1984, 12.5%."


def test_surrogates(spark, odd, none):
    rows = [*odd_rows(), (900, MENTIONS, "a"), (901, MENTIONS.upper(), "a"), (902, "Госпожа Анна Каренина", "a"), (903, "x@y.zz", "b"), (903, "x@y.zz", "b"), (904, "call 078-05-1120 " * 3000, "b")]
    df = frame(spark, rows)
    out = pii.replace_entities(df, "k1").cache()
    assert out.count() == len(rows) and out.columns == [*df.columns, "n_entities"]
    by = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    for i, t, _ in odd_rows():
        if i is not None:
            assert by[i]["text"] == t and by[i]["n_entities"] == 0
    t = by[900]["text"]
    assert by[900]["n_entities"] == 11
    for secret in ("Doe", "555-0187", "555 0187", "4111 1111", "10.20.30.40", "078-05-1120", "2c8ba23e", "Jane", "John Smith"):
        assert secret not in t
    for kept in ("Write to ", "Version 3.0, 1984, 12.5%.", "Mrs. ", "Mr. ", "token = \"", ".com"):
        assert kept in t
    mails = re.findall(r"[\w.]+@[\w.]+\w", t)
    assert mails[0].lower() == mails[1].lower() and mails[0].count(".") == 3
    phones = re.findall(r"\+1[ (\d)-]+\d", t)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", t)
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1] and cards[1][0] == "4"
    assert int(re.search(r"IP (\d+)\.", t)[1]) >= 240 and re.search(r"SSN 9\d\d-\d\d-\d{4}", t)
    assert re.search(r'"[0-9a-f]{40}"', t)
    names = re.search(r"Mrs\. (\w+) (\w+) and Mr\. (\w+) (\w+)", t)
    assert names[1] in pii.GIVEN["latin", "f"] and names[3] in pii.GIVEN["latin", "m"]
    assert re.fullmatch(r"Госпожа (\w+) [а-яА-Я]+", by[902]["text"]) and by[902]["text"].split()[1] in pii.GIVEN["cyrillic", "f"]
    assert "078-05-1120" not in by[904]["text"] and by[904]["n_entities"] == 3000
    upper = by[901]["text"]
    assert re.findall(r"[\w.]+@[\w.]+\w", upper)[0] == mails[0].upper()
    other = {r["doc_id"]: r["text"] for r in pii.replace_entities(df, "k2").collect()}
    assert other[900] != t and pii.replace_entities(none, "k1").count() == 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    plain = pii.surrogates
    # a first draw that gives all entities of a kind one surrogate, and one of them its own name
    same = F.when(F.col("kind") == "card", "1000000000000001").otherwise(F.col("shape"))
    monkeypatch.setattr(pii, "surrogates", lambda e, s, d: plain(e, s, d).withColumn("shape", same) if d == 0 else plain(e, s, d))
    entities = spark.createDataFrame([("card", f"{1000000000000000 + i}") for i in range(40)] + [("ssn", f"{i:09d}") for i in range(300)], "kind string, norm string")
    rows = pii.surrogate_table(entities, "k").collect()
    shapes = [r["shape"] for r in rows]
    assert len(rows) == 340 and len(set(shapes)) == 340 and not {r["norm"] for r in rows} & set(shapes)
    assert all(luhn(r["shape"]) for r in rows if r["kind"] == "card" and r["shape"] != "1000000000000001")


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban(text):
    x = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_small_formats_grow_and_all_stay_distinct(spark):
    """Formats with less room than entities, by brute force: distinct, no original, equal for equal mentions."""
    mails = [f"{c}@x.de" for c in "abcdefghijklmnopqrstuvwxyzéèüö"]
    sixes = [f"fe80::{i:x}" for i in range(20)]
    cards = [f"4{i:012d}" for i in range(30)]
    rows = [(i, f"to {m} and {m.upper()}; at {six}, pay {card}.", "a") for i, (m, six, card) in enumerate(itertools.zip_longest(mails, sixes, cards, fillvalue="none"))]
    seen, originals = defaultdict(dict), set(mails + sixes + cards)
    for r in pii.replace_entities(frame(spark, rows + [(100 + i, t, "b") for i, t, _ in rows]), "k").collect():
        m, up, six, card = re.fullmatch(r"to (\S+) and (\S+); at (\S+), pay (\S+)\.", r["text"]).groups()
        assert up == m.upper()
        for kind, value in (("mail", m), ("six", six), ("card", card)):
            assert seen[kind].setdefault(r["doc_id"] % 100, value) == value and (value == "none" or value not in originals)
    for kind, values in seen.items():
        some = [v for v in values.values() if v != "none"]
        assert len(some) == len(set(some)), kind
    assert all(luhn(v) for v in seen["card"].values() if v != "none")


def test_one_person_has_one_surrogate(spark):
    rows = [
        (1, "Mr John Smith met Dr John Smith. Mr. John Smith's car, MR JOHN SMITH, John Smith; Smith said so, and SMITH. Smithson did not.", "a"),
        (2, "Prof Smith is here, and a smith", "a"),
        (3, "Mrs Ελένη Παππά, Herr Иван Петров, Dr 李明 and μαρια@παράδειγμα.gr, 李@例子.cn", "b"),
        (4, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000 at 2001:0db8:85a3:0000:0000:8a2e:0370:7334. 12:30:45 std::vector \ufdd0 x@y.org", "b"),
        (5, "Mr Ian O'Neill's and Mr Ian O'Neill", "b"),
    ]
    by = {r["doc_id"]: r["text"] for r in pii.replace_entities(frame(spark, rows), "k").collect()}
    a = re.fullmatch(r"Mr (\w+ \w+) met Dr (\w+ \w+)\. Mr\. (\w+ \w+)'s car, MR (\w+ \w+), (\w+ \w+); (\w+) said so, and (\w+)\. Smithson did not\.", by[1]).groups()
    assert len(set(a[:3])) == 1 and a[3] == a[0].upper() and a[4] == a[0] and a[5] == a[0].split()[1] and a[6] == a[5].upper()
    assert a[0].split()[0] in pii.GIVEN["latin", "m"] and re.fullmatch(rf"Prof {a[5]} is here, and a smith", by[2])
    greek, russian, chinese, mail, other = re.fullmatch(r"Mrs (.+), Herr (.+), Dr (.+) and (.+)\.gr, (.+)\.cn", by[3]).groups()
    assert re.fullmatch("[α-ωά-ώΑ-Ωϊ]+ [α-ωΑ-Ω]+", greek) and greek.split()[0] in pii.GIVEN["greek", "f"] and re.fullmatch("[А-Яа-яё]+ [А-Яа-я]+", russian)
    assert re.fullmatch("[\u4e00-\u9fff]{2}", chinese) and re.fullmatch("[α-ω]+@[α-ω]+", mail) and re.fullmatch("[\u4e00-\u9fff]@[\u4e00-\u9fff]{2}", other)
    x, y, six, rest = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20}) at (fd[0-9a-f:]+)\. 12:30:45 std::vector \ufdd0 (\w)@\w\.org", by[4]).groups()
    assert x.replace(" ", "") == y != "DE89370400440532013000" and iban(y) and [len(g) for g in six.split(":")] == [4] * 8
    m = re.fullmatch(r"Mr (\w+ \w+)'s and Mr (\w+ \w+)", by[5])
    assert m and m[1] == m[2]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, truth = labelled_docs(spark, 240)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    copies = docs.where("doc_id in (1, 2, 3)").withColumn("doc_id", F.col("doc_id") + 1000)
    extra = docs.where("doc_id = 5").withColumn("doc_id", F.lit(2000).cast("long")).withColumn("text", F.concat("text", F.lit(" mail me.12@mail3.example.com")))
    docs.select(columns).unionByName(copies.select(columns)).unionByName(extra.select(columns)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    stage, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, stage, str(tmp_path))
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        stage = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(stage)
    first = {r["doc_id"] for r in seen[0].collect()}
    assert not any(not truth[i] for i in first if i < 1000) and {1, 2, 3, 1001, 1002, 1003} & first
    second = {r["doc_id"] for r in seen[1].collect()}
    assert not {1001, 1002, 1003} & second and second <= first and 2000 not in second or 5 not in second
    assert seen[2].count() == seen[1].count() and seen[2].where("text like '%mail3%'").count() == 0
    assert Counter(r["doc_id"] for r in seen[3].collect()) == Counter(r["doc_id"] for r in seen[4].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()
