"""DuckDB SQL for the operators that SQL can express."""

NEAR_DEDUP = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, 1 + greatest(CASE WHEN len(w) > 0 THEN 1 ELSE 0 END, len(w) - 4))) AS i FROM low WHERE w IS NOT NULL)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y
), comp AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN comp ON comp.x = d.doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, 1 + greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)
), place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, 2 + len(w) - n)) AS i FROM dw, (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n)
), hit AS (SELECT doc_id, item_id, i, n FROM place JOIN phrase USING (n, p)
), covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS b FROM p
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM bits
"""

URL_FILTER = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
), link AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2
), share AS (SELECT src, dst, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY src) AS w FROM link
), host AS (
  SELECT host, count(*) AS n, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS good, count(*) FILTER (rule IN ('net/', 'example.com/de/')) AS bad FROM judged WHERE host <> '' GROUP BY 1
), flow AS (
  SELECT 0 AS step, host, 0.15::DOUBLE AS trust, 0.0::DOUBLE AS distrust FROM host WHERE 2 * good > n
  UNION ALL SELECT 0, host, 0.0, 0.15 FROM host WHERE 2 * bad > n
  UNION ALL
  SELECT step + 1, host, sum(trust), sum(distrust) FROM (
    SELECT step, dst AS host, w * trust AS trust, 0.0 AS distrust FROM flow JOIN share ON src = host WHERE trust > 0
    UNION ALL SELECT step, src, 0.0, w * distrust FROM flow JOIN share ON dst = host WHERE distrust > 0)
  WHERE step < 110 GROUP BY 1, 2
), score AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM flow GROUP BY 1)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') OR rule IS NULL AND distrust >= 0.02 AND distrust > trust THEN 'block' ELSE 'allow' END AS verdict
FROM judged LEFT JOIN score USING (host)
"""
