"""DuckDB SQL for the queries of this folder that SQL can express, from their definitions."""

DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + rank % 3 AS DOUBLE) AS weight FROM s),
levels AS (
  SELECT max((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(3.0 * b.source_size) FROM w b
      WHERE (b.source_size / b.weight, b.rank) < (a.source_size / a.weight, a.rank)), 0)) OVER (PARTITION BY a.rank)
    / (SELECT sum(b.weight) FROM w b WHERE (b.source_size / b.weight, b.rank) >= (a.source_size / a.weight, a.rank)) AS level
  FROM w a),
g AS (
  SELECT w.*, least(3.0 * source_size, weight * (SELECT max(level) FROM levels)) AS target FROM w),
p AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, CAST(g.target AS DOUBLE) AS target, g.rank,
    CAST(floor(CAST(g.target AS DOUBLE) + 0.5) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS rounds,
    least((start + size / 2.0) / goal, 1.0) AS share FROM p),
taken AS (
  SELECT *, CAST(rounds * size + greatest(0, least(size, goal - rounds * source_size - start)) AS BIGINT) AS taken FROM k)
SELECT doc_id, source, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE rank % 3
  WHEN 0 THEN least(2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0))), 1)
  WHEN 1 THEN least(2 * share / (0.5 + sqrt(0.25 + 2 * share)), 1) ELSE share END, 6) END AS position
FROM taken
"""

WARC = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first, from_hex(sha1(body))::BIT::VARCHAR AS bits FROM t)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{DIGITS}', 1 + CAST(list_sum(list_transform(range(0, 5),
    lambda j: CAST(substr(bits, CAST(1 + 5 * i + j AS INT), 1) AS INT) * (16 >> CAST(j AS INT)))) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d WHERE len(words) >= 13),
h AS (SELECT doc_id, pos, array_to_string(words[pos : pos + 12], ' ') AS span FROM p),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY span) AS first FROM h) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, range(0, 13) AS x(o)),
gone AS (SELECT doc_id, list(pos) AS places FROM g GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(words) AS n, coalesce(len(places), 0) AS removed, CASE WHEN places IS NULL THEN words
    ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)), lambda i: words[i]) END AS kept
  FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM k
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS p, k, count(*) AS a
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (VALUES (1), (2), (3), (4)) AS sizes(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, p, string_split(p, ' ') AS w, k AS size, a FROM f WHERE k > 1),
parts AS MATERIALIZED (
  SELECT lang, p, a, x, array_to_string(w[1 : x], ' ') AS head, array_to_string(w[x + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS x FROM c)),
cuts AS (
  SELECT parts.lang, parts.p, parts.a, x AS k, l.a AS l, r.a AS r, CAST(2000000 AS HUGEINT) * parts.a // (l.a + r.a) AS score
  FROM parts JOIN f l ON l.lang = parts.lang AND l.p = head JOIN f r ON r.lang = parts.lang AND r.p = tail),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, size)) AS i FROM c), (VALUES (2), (3)) AS z(k) WHERE k < size AND i + k - 1 <= size),
dropped AS (SELECT DISTINCT q.lang, q.p FROM inner_phrases q JOIN c ON c.lang = q.lang AND c.p = q.p WHERE 100 * q.a >= 80 * c.a),
kept AS (SELECT lang, p AS phrase, a, l, r, score FROM weakest ANTI JOIN dropped USING (lang, p))
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
  a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

TRIE = r"""
WITH t AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda crc, x: list_reduce([xor(crc, x)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h
  FROM t),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1 : h.h], []), h.own[h.h + 1 :]) AS turns
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS total, d, turns[1 : d] AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d][2], '[^\x20\x09-\x0D]+')) END AS saved
  FROM p GROUP BY path, d),
kids AS (SELECT path[1 : d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path),
up AS (SELECT path[1 : x] AS path, n_children, saved FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM full_nodes)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY path)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums ON sums.path = f.path LEFT JOIN nodes q ON f.d > 0 AND q.path = f.path[1 : f.d - 1]
"""

DECONTAMINATION = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS span, least(len(w), 10) AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (
  SELECT row, i, k, array_to_string(w[i : i + k - 1], ' ') AS span
  FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT k FROM v) WHERE i + k - 1 <= len(w)),
o AS (SELECT row, i, s.k, item FROM s JOIN v ON v.span = s.span),
hit AS (SELECT row, count(DISTINCT i + x) AS n_hit FROM o, range(0, 10) AS y(x) WHERE x < k GROUP BY row),
found AS (SELECT row, list_sort(list(DISTINCT item)) AS items FROM o GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN found USING (row)
"""
