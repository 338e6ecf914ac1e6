"""DuckDB SQL that gives the rows of those queries which SQL can express."""

WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
     h AS (SELECT page_id, url, sha256(body) AS digest, CAST(strlen(body) AS BIGINT) AS n FROM p),
     f AS (SELECT digest, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url, true AS digest_matches
FROM h LEFT JOIN f USING (digest)
"""

#: Lines as sets of words; a line goes if an earlier one has 0.8 of Jaccard similarity.
LINES = r"""
WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(text, E'\n'), 1) - 1 AS i, lower(trim(unnest(string_split(text, E'\n')), E' \t\r\x0b\x0c')) AS norm FROM documents),
     t AS (SELECT doc_id, i, norm, list_filter(list_distinct(string_split(norm, ' ')), lambda x: x <> '') AS w FROM l WHERE norm <> ''),
     d AS (SELECT norm, any_value(w) AS w, any_value(len(w)) AS n, min(struct_pack(doc_id, i)) AS pos FROM t GROUP BY norm),
     k AS (SELECT norm, n, pos, unnest(w) AS word FROM d),
     o AS (SELECT a.norm, b.pos, a.n AS na, b.n AS nb, count(*) AS common FROM k a JOIN k b ON a.word = b.word AND b.pos < a.pos AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
     c AS (SELECT DISTINCT norm FROM o WHERE 9 * common >= 4 * (na + nb)),
     gone AS (SELECT t.doc_id, t.i FROM t JOIN d USING (norm) LEFT JOIN c USING (norm) WHERE struct_pack(t.doc_id, t.i) <> d.pos OR c.norm IS NOT NULL),
     g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
     r AS (SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, E'\n'), lambda x, j: NOT list_contains(gone, j - 1)), E'\n') END AS text,
                  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, E'\n')) END AS n_lines, coalesce(len(gone), 0) AS n_removed FROM documents d LEFT JOIN g USING (doc_id))
SELECT doc_id, text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM r
"""

NEAREST = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Shingles of five words (or the whole of fewer), links by the size of intersections, components by repeated minima.
JACCARD = r"""
WITH RECURSIVE
     w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
     n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
     x AS (SELECT doc_id, unnest(s) AS x FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     c(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id WHERE c.root < e.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, min(c.root)) AS component_id FROM n JOIN c USING (doc_id) GROUP BY n.doc_id, n.n
"""

ORACLES: dict[str, str] = {
    "op1_warc_index_first": WARC,
    "op6_line_similarity_join": LINES,
    "op8_vantage_point_trees": NEAREST,
    "op9_prefix_tree_join": JACCARD,
}
