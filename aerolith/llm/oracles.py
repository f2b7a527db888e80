"""DuckDB's SQL for the registered queries that SQL can express: plain all-pairs, windows and closures."""

from __future__ import annotations

from aerolith.llm import mixing, rules, sharding

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _digest60(key: str, salt: str) -> str:
    return f"CAST('0x' || substr(md5(concat('{salt}', coalesce(CAST({key} AS VARCHAR), ''))), 1, 15) AS BIGINT)"


def _closed(ids: str, key: str) -> str:
    """CTEs reach and part: the least key that the links (a, b) reach from each row r of ids, itself included."""
    return f"""reach(a, b) AS (SELECT r, r FROM {ids} UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
part AS (SELECT reach.a AS r, min({ids}.{key}) AS least FROM reach JOIN {ids} ON reach.b = {ids}.r GROUP BY 1)"""


def jaccard_sql() -> str:
    """op2 by all pairs of rows that share a shingle."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT p.r AS a, q.r AS b, count(*) AS common FROM s p JOIN s q ON p.x = q.x AND p.r <> q.r GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n m ON m.r = a JOIN n k ON k.r = b WHERE 5 * common >= 4 * (m.n + k.n - common)),
{_closed("d", "doc_id")},
c AS (SELECT a AS r, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, least AS class_id, coalesce(k, 0) AS n_links, coalesce(n, 0) AS n_shingles, doc_id = least AS kept
FROM d JOIN part USING (r) LEFT JOIN c USING (r) LEFT JOIN n USING (r)"""


def crc_table() -> list[int]:
    """CRC-32 of each byte, from its polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def shards_sql(dims: list[str], n_shards: int = 8, bits: int = sharding.BITS) -> str:
    """op3: quantiles by window sums, the curve by its table, CRC-32 byte by byte."""
    digits, following = sharding.curve_table(len(dims))
    bins, corners = 2**bits - 1, 1 << len(dims)
    bounds = ",\n".join(
        f"b{k} AS (SELECT v FROM (SELECT v, n, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS m FROM (SELECT {c} AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 1))"
        f" WHERE (upto * {bins}) // m > ((upto - n) * {bins}) // m AND ((upto - n) * {bins}) // m < {bins - 1})"
        for k, c in enumerate(dims)
    )
    coords = ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM b{k} WHERE v < documents.{c}) END AS c{k}" for k, c in enumerate(dims))
    step = "SELECT r, 0 AS s, CAST(0 AS BIGINT) AS h, * EXCLUDE (r) FROM d"
    for level in range(bits - 1, -1, -1):
        at = f"s * {corners} + 1 + " + " + ".join(f"((c{k} >> {level}) & 1) * {1 << (len(dims) - 1 - k)}" for k in range(len(dims)))
        step = f"SELECT * EXCLUDE (s, h, place), following[place] AS s, h * {corners} + digits[place] AS h FROM (SELECT *, {at} AS place FROM ({step})), curve"
        step = f"SELECT * EXCLUDE (digits, following) FROM ({step})"
    return f"""
WITH curve AS (SELECT {digits} AS digits, {following} AS following),
{bounds},
d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS body, {coords} FROM documents),
crc AS (SELECT r, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
  lambda a, b: xor(a >> 8, {[*crc_table()]}[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS text_crc32 FROM d),
placed AS (SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, h AS curve, count(*) OVER () AS n,
  row_number() OVER (ORDER BY h, {_digest60("doc_id", "shard ")}, doc_id NULLS FIRST, text_crc32) - 1 AS rank FROM ({step}) JOIN crc USING (r)),
cut AS (SELECT *, rank * {n_shards} // n AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(rank - (shard * n + {n_shards - 1}) // {n_shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM cut"""


def mix_sql(cap: int = mixing.CAP, seed: str = mixing.SEED) -> str:
    """op4 by one window a source."""
    order = "ORDER BY ratio, source NULLS LAST ROWS BETWEEN"
    return f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, {_digest60("doc_id", seed)} AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, CAST({cap} * source_size AS DOUBLE) AS stop, CAST({cap} * source_size AS DOUBLE) / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(stop) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight, stop), stop) AS target FROM l),
b AS (SELECT d.*, source_size, target, CAST(floor(target + 1e-6) AS BIGINT) AS budget,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT *, greatest(0, least(budget - epochs * source_size - before, size)) AS part FROM e)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(epochs * size + part AS BIGINT) AS taken,
  CAST(epochs + CASE WHEN size > 0 AND 2 * part >= size THEN 1 ELSE 0 END AS INTEGER) AS copies, source FROM p"""


def vectors_sql(cosine: float) -> str:
    """op5 by all pairs of a label."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label,
  CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL),
links AS (SELECT p.r AS a, q.r AS b FROM ok p JOIN ok q ON p.label = q.label AND len(p.x) = len(q.x) AND p.r <> q.r WHERE list_cosine_similarity(p.x, q.x) >= {cosine}),
{_closed("v", "vec_id")},
c AS (SELECT a AS r, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, least AS component_id, vec_id = least AS kept FROM v JOIN part USING (r) LEFT JOIN c USING (r)"""


def archive_sql() -> str:
    """op8: SHA-1 in base32 from its hexadecimal digits, the greatest page of each payload."""
    letters = "list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex || '000', 5 * i // 4 + 1, 3) AS INTEGER) >> (7 - 5 * i % 4)) & 31 AS BIGINT) + 1, 1))"
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, array_to_string({letters}, '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM p JOIN m USING (hex)"""


def ledger_sql(policy: str = "v2") -> str:
    """op9 ; windows are compared by their words."""
    hard, soft = rules.POLICIES[policy]
    mask = sum(rules.bit(n) for n in hard)
    rest = ((1 << len(rules.RULES)) - 1) & ~mask
    base = sum(rules.bit(n) for n in rules.BASE)
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(rules.RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
s AS (SELECT r, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: regexp_full_match(x, '[^\p{{Ll}}]*\p{{Lu}}\p{{Lu}}[^\p{{Ll}}]*'))) AS n_upper_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words
  FROM s LEFT JOIN covered USING (r)),
f AS (SELECT *, CAST({bits} AS INTEGER) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (fail_bits & {base}) <> 0 AS base_failed, (fail_bits & {base}) = 0 AND (fail_bits & {mask}) = 0 AND bit_count(fail_bits & {rest}) <= {soft} AS kept, fail_bits,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_upper_words AS BIGINT) AS n_upper_words, CAST(n_alpha_words AS BIGINT) AS n_alpha_words
FROM f"""
