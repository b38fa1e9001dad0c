"""SQL, in DuckDB's dialect, of the queries whose results it can express on whole tables: plain all-pairs and all-strings definitions.

3: all pairs of documents that share a shingle, by exact Jaccard similarity. 4: all pairs of vectors of a label. 6: the
digests, record types and record ids of pages. 7: all 50-byte strings, as hexadecimal digits. The other queries are
held against brute-force versions in tests/llm.
"""

from __future__ import annotations

#: The smallest id that each node reaches over links (a, b), given both ways round; nodes without links are absent.
_REACH = """
reach(id, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * pairs.n >= 4 * (x.n + y.n - pairs.n)),
{_REACH}
SELECT d.doc_id, coalesce(root.root, d.doc_id) AS class_id, coalesce(degree.n, 0) AS n_links
FROM documents d LEFT JOIN root ON root.id = d.doc_id LEFT JOIN degree ON degree.id = d.doc_id"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
{_REACH}
SELECT d.vec_id, coalesce(degree.n, 0) AS n_links, coalesce(root.root, d.vec_id) AS component_id, coalesce(root.root, d.vec_id) = d.vec_id AS kept
FROM embeddings d LEFT JOIN root ON root.id = d.vec_id LEFT JOIN degree ON degree.id = d.vec_id"""

#: Record ids are UUIDs of version 5 in the namespace of URLs, as convert() makes them of page and digest.
ARCHIVES = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
five AS (SELECT *, list_transform(range(0, 8), lambda j: list_reduce(list_transform(string_split(substring(hex, 5 * j + 1, 5), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, x: 16 * a + x)) AS groups FROM h),
digests AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((groups[i // 4 + 1] // (32 ** (3 - i % 4))::BIGINT) % 32 + 1)::BIGINT, 1)), '') AS payload_digest FROM five),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS least, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(page_id || '|' || payload_digest)) AS name FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to,
  '<urn:uuid:' || name[1:8] || '-' || name[9:12] || '-5' || name[14:16] || '-' || substring('89ab', (strpos('0123456789abcdef', name[17]) - 1) % 4 + 1, 1) || name[18:20] || '-' || name[21:32] || '>' AS record_id,
  '2024-01-01T00:00:00Z' AS warc_date
FROM firsts"""

#: Texts are cut into pieces of 1,000 bytes, each with the 49 that follow, as substring() counts from a text's beginning.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, k, substring(h, 2000 * k + 1, 2098) AS s FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 1999) // 2000)) AS k FROM d)),
strings AS (SELECT doc_id, 1000 * k + i AS p, substring(s, 2 * i + 1, 100) AS w FROM (SELECT doc_id, k, s, unnest(range(0, least(1000, length(s) // 2 - 49))) AS i FROM pieces)),
leasts AS (SELECT w, min(doc_id) AS least FROM strings GROUP BY w),
marks AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM strings JOIN leasts USING (w) WHERE doc_id > least),
groups AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marks),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM groups GROUP BY doc_id, g),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
removed AS (SELECT doc_id, sum(e - s) AS n, count(*) AS spans, string_agg(substring(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substring(any_value(h), 2 * max(e) + 1) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed.n, 0)::BIGINT AS n_removed, coalesce(removed.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id)"""
