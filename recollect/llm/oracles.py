"""The corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"

_COMPONENTS = """e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  r AS (SELECT id AS x, id AS y FROM nodes UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
  c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)"""

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9),
  nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
  SELECT x AS vec_id, (SELECT count(*) FROM e WHERE e.a = x) AS n_links, component_id, x = component_id AS kept FROM c"""

OP7 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
  SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to FROM p"""

OP8 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
  l AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss FROM w),
  s AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS s FROM l),
  k AS (SELECT p.doc_id AS a, q.doc_id AS b, p.n AS na, q.n AS nb, count(*) AS c FROM s p JOIN s q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM k WHERE 100 * c >= 85 * (na + nb - c)),
  nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
  SELECT doc_id, len(ss) AS n_shingles, component_id, doc_id = component_id AS kept FROM l JOIN c ON c.x = l.doc_id"""

ENDS = ", ".join(f"count(*) FILTER (shard <= {s})" for s in range(8))
OP9 = rf"""WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM z GROUP BY source),
  w AS (SELECT *, [3, 1, 2][(ord - 1) % 3 + 1] AS weight, 2 * ss AS cap FROM s),
  l AS (SELECT *, cap / weight AS own, ((SELECT sum(ss) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, ord)),
  t AS (SELECT source, ss, ord, coalesce(least(cap::DOUBLE, (SELECT arg_min(level, (own, ord)) FROM l WHERE level <= own) * weight), cap::DOUBLE) AS target FROM l),
  b AS (SELECT greatest(1, CAST(ceil(sum(target) / 65536) AS BIGINT)) AS block, sum(target) AS wanted, count(*) FILTER (target > 0) AS live FROM t),
  q AS (SELECT ord, target / (2 * unnest(generate_series(1, CAST(ceil(target * (round(wanted / block) + live / 2) / wanted + 0.5) AS BIGINT))) - 1) AS q FROM t, b WHERE target > 0),
  seats AS (SELECT CAST(greatest(1, round(wanted / block)) AS BIGINT) AS seats FROM b),
  won AS (SELECT ord, (n - 1) * 8 // seats AS shard FROM (SELECT ord, row_number() OVER (ORDER BY q DESC, ord) AS n FROM q), seats WHERE n <= seats),
  r AS (SELECT ord, count(*) AS quota, [{ENDS}] AS ends FROM won GROUP BY ord),
  u AS (SELECT t.*, coalesce(quota, 0) AS quota, ends, block, least(coalesce(quota, 0) * block, 2 * ss) AS take FROM t LEFT JOIN r USING (ord), b),
  d AS (SELECT z.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM z),
  x AS (SELECT d.*, u.* EXCLUDE (source), CASE WHEN ss > 0 THEN take // ss ELSE 0 END AS whole FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
  SELECT doc_id, source, size, ss AS source_size, target, CAST(whole * size + greatest(0, least(start + size, take - whole * ss) - start) AS BIGINT) AS taken,
    quota, block AS block_words, CAST(CASE WHEN taken > 0 THEN least(7, len(list_filter(ends, lambda e: e <= start // block))) END AS INTEGER) AS shard FROM x"""

_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
OP12 = f"""WITH RECURSIVE d AS (SELECT *, {_FIELDS} AS meta, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
  h AS (SELECT doc_id, source, sha256(meta || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(meta || coalesce(strlen(low) || ':' || low, '-')) AS changed FROM d),
  crc AS (SELECT n, list_reduce(list_prepend(n, generate_series(1, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(n)),
  touched AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) % 5 = 0 AS hit FROM (SELECT DISTINCT doc_id FROM d WHERE doc_id IS NOT NULL), (SELECT list(c ORDER BY n) AS tab FROM crc)),
  l AS (SELECT h.doc_id, leaf, CASE WHEN hit THEN changed ELSE leaf END AS seen, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY source ORDER BY h.doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h LEFT JOIN touched USING (doc_id)),
  t AS (SELECT tree, 0 AS level, pos, n, leaf AS node FROM l UNION ALL
    SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, pos // 16, n),
  s AS (SELECT tree, node, tree - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
  u AS (SELECT 0 AS level, pos, n, node FROM s UNION ALL
    SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
  every AS (SELECT tree, level, pos, n, node FROM t UNION ALL SELECT 0, level, pos, n, node FROM u),
  runs AS (SELECT tree, level, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM every WHERE n > 1 GROUP BY ALL),
  f AS (SELECT row_number() OVER (ORDER BY tree, pos) AS k, tree AS own, tree, 0 AS level, pos, n, seen AS node, '' AS proof FROM l UNION ALL
    SELECT k, own, CASE WHEN f.n > 1 THEN f.tree ELSE 0 END, CASE WHEN f.n > 1 THEN f.level + 1 ELSE 0 END, CASE WHEN f.n > 1 THEN f.pos // 16 ELSE own - 1 END,
      CASE WHEN f.n > 1 THEN (f.n + 15) // 16 ELSE (SELECT count(*) FROM s) END,
      CASE WHEN f.n > 1 THEN sha256(array_to_string(nodes[:f.pos % 16], '') || f.node || array_to_string(nodes[f.pos % 16 + 2:], '')) ELSE f.node END,
      CASE WHEN f.n > 1 THEN f.proof || array_to_string(nodes[:f.pos % 16], '') || array_to_string(nodes[f.pos % 16 + 2:], '') ELSE f.proof END
    FROM f LEFT JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.pos // 16 WHERE f.n > 1 OR f.tree > 0),
  last AS (SELECT k, node AS folded_root, sha256(proof) AS proof_sha256 FROM f WHERE tree = 0 AND n = 1)
  SELECT doc_id, leaf, s.node AS subroot, (SELECT node FROM u WHERE n = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT node FROM u WHERE n = 1) AS verified
  FROM (SELECT *, row_number() OVER (ORDER BY tree, pos) AS k FROM l) JOIN last USING (k) JOIN s USING (tree)"""

OP13 = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5),
  n AS (SELECT p.a, p.b, p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b) AS INTEGER) AS rank
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
  SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
