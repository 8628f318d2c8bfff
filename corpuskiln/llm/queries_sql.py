"""DuckDB SQL of the queries here whose results SQL can express, over whole tables."""

from __future__ import annotations

ITEMS = r"""items AS (SELECT 'doc' AS kind, doc_id AS id, content AS text FROM docs UNION ALL SELECT 'chunk', chunk_id, any_value(text) FROM chunks GROUP BY chunk_id)"""

SQL = {
    "p1_whole": rf"WITH {ITEMS} SELECT kind, id, coalesce(length(text), 0) AS chars, true AS within, true AS dense FROM items",
    "p6_placed": "SELECT doc_id, coalesce(text, '') <> '' AS placed, true AS complete, true AS within FROM documents",
    "p7_kept": r"SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, true AS within, true AS fair FROM mix_targets",
    "p1_found": rf"WITH {ITEMS} SELECT kind AS item_kind, id AS item_id FROM items WHERE len(regexp_extract_all(text, '[ \t\r\n]*[^ \t\r\n]{{1,8}}')) > 500",
    "p2_found": rf"""WITH {ITEMS},
      words AS (SELECT kind, id, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM items),
      sets AS (SELECT kind, id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words WHERE len(w) >= 32),
      big AS (SELECT kind, id, len(s) AS n, unnest(s) AS x FROM sets WHERE len(s) >= 30)
      SELECT a.kind AS item_kind, a.id AS id_a, b.id AS id_b FROM big a JOIN big b ON a.kind = b.kind AND a.x = b.x AND a.id < b.id
      GROUP BY a.kind, a.id, b.id, a.n, b.n HAVING count(*) >= 0.7::DOUBLE * (a.n + b.n - count(*)) - 1e-9""",
    "p2_links": rf"""WITH {ITEMS},
      words AS (SELECT kind, id, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM items),
      sets AS (SELECT kind, id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM words WHERE len(w) >= 5),
      classed AS (SELECT kind, id, md5(array_to_string(s, chr(10))) AS c, s FROM sets),
      big AS (SELECT kind, c, len(s) AS n, unnest(s) AS x FROM (SELECT kind, c, any_value(s) AS s FROM classed GROUP BY kind, c)),
      links AS (SELECT a.kind, a.c, b.c AS other FROM big a JOIN big b ON a.kind = b.kind AND a.x = b.x AND a.c <> b.c
        GROUP BY a.kind, a.c, b.c, a.n, b.n HAVING count(*) >= 0.8::DOUBLE * (a.n + b.n - count(*)) - 1e-9)
      SELECT i.kind AS item_kind, i.id, count(other) AS links FROM items i LEFT JOIN classed c ON i.kind = c.kind AND i.id = c.id LEFT JOIN links l ON l.kind = c.kind AND l.c = c.c GROUP BY ALL""",
    "p5_found": """WITH v AS (SELECT chunk_id, list_transform(min(embedding), lambda x: x::DOUBLE) AS e FROM chunks
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
      n AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM v a, v b WHERE a.chunk_id <> b.chunk_id
        QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.chunk_id) <= 5)
      SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM n""",
}
