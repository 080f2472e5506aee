"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) t(i)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least USING (k), unnest(range(0, 13)) u(j) WHERE m < doc_id),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM d, unnest(range(0, len(h) // 2 - 49)) t(i)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT doc_id, i FROM win JOIN least USING (k) WHERE m < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone),
island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
run AS (SELECT doc_id, k, min(i) AS s, max(i) + 50 AS e FROM island GROUP BY ALL),
piece AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM run
  UNION ALL SELECT d.doc_id, coalesce(max(e), 0), any_value(len(h) // 2) FROM d LEFT JOIN run USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS r FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n, sum(e - s) AS b FROM run GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(b, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(r)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v AS q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k FROM d, unnest(range(1, len(w) - 3)) t(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, unnest(range(0, 5)) u(j) WHERE n > 1 GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM line WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
f AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed)::DOUBLE AS f FROM b GROUP BY source),
m AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS h, sum(f * f / n) AS sq FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(sq / n - mean * mean - mean * (1 - mean) * (h - 1) / n, 1e-9) - 1, 1.0), 1e6) AS k FROM m),
r AS (SELECT source, (f + mean * k) / (n + k) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > 0.5 AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""

URL_FILTER = """
WITH p AS (SELECT page_id, url, TIMESTAMP '{first} 00:00:00' + INTERVAL 1 DAY * (page_id % 366)::INT AS t,
        nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.$', ''), '') AS host,
        list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
e AS (SELECT CASE WHEN page_id % 3 = 1 AND len(parts) > 0 THEN host || '/' || parts[1]
        WHEN page_id % 3 = 2 AND len(string_split(host, '.')) > 2 AND NOT regexp_full_match(host, '[0-9.]+') THEN substr(host, instr(host, '.') + 1) ELSE host END AS key,
        TIMESTAMP '{first} 00:00:00' + INTERVAL 1 DAY * (7 * page_id % 366)::INT AS listed, 13 * page_id % 5 < 3 AS blocks FROM p WHERE host IS NOT NULL),
o AS (SELECT key, listed, max(blocks::INT) AS o FROM e GROUP BY ALL),
c AS (SELECT *, lag(o, 1, 0) OVER (PARTITION BY key ORDER BY listed) AS b FROM o),
s AS (SELECT key, listed AS since, lead(listed) OVER (PARTITION BY key ORDER BY listed) AS until, o FROM c WHERE o <> b),
k AS (SELECT page_id, t, array_to_string(l[i:], '.') AS key FROM (SELECT *, CASE WHEN regexp_full_match(host, '[0-9]+(\\.[0-9]+){{3}}') THEN [host] ELSE string_split(host, '.') END AS l FROM p), unnest(range(1, greatest(len(l), 2))) u(i)
      UNION SELECT page_id, t, host || '/' || array_to_string(parts[:i], '/') FROM p, unnest(range(1, len(parts) + 1)) u(i)),
h AS (SELECT page_id, count(*) AS n, max({{'n': length(key), 'key': key, 'since': since}}) AS best FROM k JOIN s USING (key) WHERE o = 1 AND t >= since AND (until IS NULL OR t < until) GROUP BY page_id)
SELECT page_id, host, coalesce(n, 0)::BIGINT AS n_active, coalesce(n, 0) > 0 AS blocked, best.key AS matched_key, strftime(best.since, '%Y-%m-%d') AS active_since
FROM p LEFT JOIN h USING (page_id)
"""
