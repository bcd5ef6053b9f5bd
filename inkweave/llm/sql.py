"""DuckDB statements that give the same rows as some of the queries."""

#: The distinct words of each record of ideas and decisions with at least 24 of them.
_SETS = r"""WITH r AS (SELECT id AS rec, description AS t FROM base_ideas UNION ALL SELECT decision_id, idea.idea FROM decisions),
s AS (SELECT rec, list_distinct(regexp_extract_all(lower(max(t)), '[\p{L}\p{Nd}]+')) AS ws FROM r WHERE rec IS NOT NULL AND t IS NOT NULL GROUP BY rec),
k AS (SELECT rec, ws, len(ws) AS n FROM s WHERE len(ws) >= 24),
w AS (SELECT rec, n, unnest(ws) AS w FROM k),
p AS (SELECT a.rec AS rec_a, b.rec AS rec_b FROM w a JOIN w b ON a.w = b.w AND a.rec < b.rec GROUP BY a.rec, b.rec, a.n, b.n HAVING count(*) * 10 >= 7 * (a.n + b.n - count(*))) """
#: The windows of ten words of a table's texts.
_WINDOWS = r"""(SELECT DISTINCT {key}, array_to_string(ws[i : i + 9], ' ') AS win FROM
(SELECT {key}, ws, unnest(range(1, len(ws) - 8)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+') AS ws FROM {table} WHERE text IS NOT NULL) WHERE len(ws) >= 10))"""

SQL = {
    "p1_found": _SETS + "SELECT rec_a, rec_b FROM p",
    "p1_classes": _SETS
    + """, c AS (SELECT rec, min(rec) OVER (PARTITION BY list_sort(ws)) AS class_id FROM k),
l AS (SELECT class_id, count(DISTINCT other) AS links FROM (
  SELECT a.class_id, b.class_id AS other FROM p JOIN c a ON a.rec = p.rec_a JOIN c b ON b.rec = p.rec_b UNION ALL SELECT b.class_id, a.class_id FROM p JOIN c a ON a.rec = p.rec_a JOIN c b ON b.rec = p.rec_b
) WHERE class_id <> other GROUP BY class_id)
SELECT rec, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (class_id)""",
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM {_WINDOWS.format(key='doc_id', table='documents')} d JOIN {_WINDOWS.format(key='item_id', table='eval_items')} i USING (win)",
    "p8_found": """WITH d AS (SELECT DISTINCT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200),
b AS (SELECT doc_id, n, unnest(range(0, (n + 999) // 1000)) * 1000 AS o, text FROM d),
g AS (SELECT doc_id, o, substr(text, o + 1, 1199) AS part FROM b),
w AS (SELECT doc_id, o + j AS i, md5_number(substr(part, j + 1, 200)) AS h FROM (SELECT doc_id, o, part, unnest(range(0, least(1000, length(part) - 199))) AS j FROM g WHERE length(part) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, i FROM w SEMI JOIN s USING (h))
SELECT doc_id, sum(least(200, coalesce(lead_i - i, 200)))::BIGINT AS shared_chars FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM x) GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """By the query's name; a query that SQL can't express has none and is tested against brute force."""
    return SQL
