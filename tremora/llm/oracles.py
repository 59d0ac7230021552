"""SQL for DuckDB of those operators that SQL can express, by plainer methods than the operators use."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
covered AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM again)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.x AS qx, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0) q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

H8 = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
OP5 = f"""WITH sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, CAST(len({WORDS}) AS BIGINT) AS size,
  md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place, {H8.format("'mix-1#' || coalesce(CAST(doc_id AS VARCHAR), '')")} AS deal FROM documents),
sources AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY src),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
levels AS (SELECT *, 3 * source_size / CAST(weight AS DOUBLE) AS lim,
  (total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  CAST(sum(weight) OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
targets AS (SELECT *, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT level FROM levels WHERE level <= lim ORDER BY lim, src LIMIT 1)) AS target FROM levels),
quotients AS (SELECT src, target / (2 * k - 1) AS quotient, k, total FROM (SELECT src, target, total, unnest(range(1, CAST(target / 16 AS BIGINT) + 30)) AS k FROM targets)),
won AS (SELECT src, count(*) AS quota FROM (SELECT src FROM quotients QUALIFY row_number() OVER (ORDER BY quotient DESC, src, k) <= round(total / CAST(16 AS DOUBLE))) GROUP BY src),
shards AS (SELECT *, coalesce(quota, 0) AS q FROM targets LEFT JOIN won USING (src)),
plan AS (SELECT *, (source_size + 15) // 16 AS blocks, CASE WHEN source_size > 0 THEN least(3, q * 16 // source_size) ELSE 0 END AS passes FROM shards),
parts AS (SELECT *, CASE WHEN source_size > 0 AND passes < 3 THEN least(blocks, CAST(round((q * 16 - passes * source_size) / CAST(16 AS DOUBLE)) AS BIGINT)) ELSE 0 END AS part,
  CASE WHEN blocks > 0 THEN {H8.format("'mix-1|' || src || '|0'")} % blocks ELSE 0 END AS start FROM plan),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY src ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin FROM sized JOIN parts USING (src)),
spans AS (SELECT *, fin // 16 AS b1, (fin - size) // 16 AS b0 FROM placed),
counts AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN
  ((b1 * part + start) // blocks * 16 + (((b1 + 1) * part + start) // blocks - (b1 * part + start) // blocks) * (fin - b1 * 16)) -
  ((b0 * part + start) // blocks * 16 + (((b0 + 1) * part + start) // blocks - (b0 * part + start) // blocks) * (fin - size - b0 * 16)) ELSE 0 END AS last FROM spans)
SELECT doc_id, size, source_size, target, CAST(passes * size + last AS BIGINT) AS taken FROM counts"""

ORACLES = {"op1_substring_dedup": OP1, "op3_exact_topk": OP3, "op5_mixing": OP5}
