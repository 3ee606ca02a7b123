"""SQL twins, for DuckDB, of the training-data queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '')"
SHINGLES = "unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' ')))"

#: k is an item's number of words up to five; documents have windows of every such number.
DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
iw AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, {SHINGLES} AS s FROM dw, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
it AS (SELECT DISTINCT item_id, k, {SHINGLES} AS s FROM iw),
n AS (SELECT item_id, k, count(*) AS n_item FROM it GROUP BY 1, 2)
SELECT doc_id, n.item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN it ON ds.s = it.s AND ds.k = it.k JOIN n ON n.item_id = it.item_id AND n.k = it.k
GROUP BY 1, 2, it.k HAVING 5 * count(*) >= 4 * any_value(n_item)"""

#: CRC-32 byte by byte over a table of 256 that is made by the polynomial's rule.
SHARDING = """
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
h AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, source, octet_length(encode(x)) // 2 AS n, list_transform(range(octet_length(encode(x)) // 2), lambda k: CAST(concat('0x', substr(x, CAST(1 + 2 * k AS BIGINT), 2)) AS BIGINT)) AS b FROM h),
c AS (SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS sk,
  CAST(xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda a, y: xor(a >> 8, t[1 + (xor(a, y) & 255)])), 4294967295) AS BIGINT) AS crc FROM b, tab),
m AS (SELECT *, md5(concat('scenery-shards|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', CAST(crc AS VARCHAR), '|', CAST(size AS VARCHAR))) AS h FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY h, doc_id, crc, size) AS k, count(*) OVER (PARTITION BY sk) AS m, count(*) OVER () AS n,
  CAST(concat('0x', substr(md5(concat('scenery-shards|', sk)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS o FROM m),
g AS (SELECT *, row_number() OVER (ORDER BY (k - 1 + o) / m, sk, k) - 1 AS g FROM r)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST((g * 16) // n AS INT) AS shard, g - (((g * 16) // n) * n + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard FROM g"""

#: Base 32 of a digest: 5 hex digits hold 4 characters of 5 bits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST(concat('0x', substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM d"""

RAW_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Words are numbered; a removed one is within 50 of a window's start. A null doc_id counts as the largest.
SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, {RAW_WORDS} AS w FROM documents),
win AS (SELECT r, k, i, array_to_string(w[i:i+49], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT s, min(k) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i, unnest(range(50)) AS j FROM win JOIN m USING (s) WHERE k > first)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

#: Every document in every order and step, one by one.
FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, {RAW_WORDS} AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {{
  'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)}} AS fail FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT concat(a.c, b.c, x.c, d.c, e.c) AS filter_order FROM x a, x b, x, x d, x e WHERE len(list_distinct([a.c, b.c, x.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[CAST(step AS INT)] AS letter, filter_order[1:CAST(step AS INT) - 1] AS earlier FROM o, range(1, 6) r(step)),
g AS (SELECT part, good, toxic, fail, count(*) AS n FROM f GROUP BY ALL),
y AS (SELECT *, fail[letter] AS bad, coalesce(list_bool_or([fail[c] FOR c IN string_split(earlier, '') IF c <> '']), false) AS gone,
  len([c FOR c IN ['A', 'B', 'C', 'D', 'E'] IF fail[c]]) AS fails FROM g, s),
z AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN bad AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM z"""
