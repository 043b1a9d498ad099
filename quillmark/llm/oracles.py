"""SQL in DuckDB of results that it can state by a plainer way than the operators' own."""

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Links between all pairs that share a shingle, counted on full sets, and the least id reached over them.
NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) END) AS x FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), sized AS (SELECT s.*, n FROM s JOIN n USING (doc_id)),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reached AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
  least_of AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN n USING (doc_id)"""
