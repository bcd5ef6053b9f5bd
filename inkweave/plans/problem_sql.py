"""DuckDB statements that give the same rows as some of the queries on drifting, delivered and nested records."""

from __future__ import annotations

#: JSON values are taken apart to this depth; what is deeper is compared as text.
DEPTH = 9


def _canonical(source: str, depth: int = DEPTH) -> str:
    """CTEs ``n0, n1, ...`` with the nodes of ``source`` (``row, j``) by depth, and ``c0`` with ``row, path, c``: each
    value's text, the same for equal values. Members and elements are sorted, null members left out."""
    parts = [f"n0 AS (SELECT row, '' AS path, '' AS up, '' AS key, j FROM {source})"]
    for d in range(1, depth + 1):
        keys = f"(SELECT row, path, j, json_type(j) = 'OBJECT' AS o, unnest(CASE json_type(j) WHEN 'OBJECT' THEN json_keys(j) WHEN 'ARRAY' THEN list_transform(range(json_array_length(j)::BIGINT), lambda i: i::VARCHAR) END) AS k FROM n{d - 1} WHERE json_type(j) IN ('OBJECT', 'ARRAY'))"
        parts.append(f"n{d} AS (SELECT row, path || '/' || k AS path, path AS up, CASE WHEN o THEN length(k) || ':' || k || '=' ELSE '' END AS key, json_extract(j, CASE WHEN o THEN '$.\"' || k || '\"' ELSE '$[' || k || ']' END) AS j FROM {keys})")
    leaf = "CASE json_type(n.j) WHEN 'VARCHAR' THEN length(json_extract_string(n.j, '$')) || ':' || json_extract_string(n.j, '$') WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN n.j::VARCHAR ELSE (n.j::DOUBLE)::VARCHAR END"
    parts.append(f"c{depth} AS (SELECT row, path, up, key, j::VARCHAR AS c FROM n{depth})")
    for d in range(depth - 1, -1, -1):
        inside = f"(SELECT row, up, string_agg(key || c, ',' ORDER BY key || c) AS c FROM c{d + 1} WHERE key = '' OR c <> 'null' GROUP BY row, up)"
        parts.append(
            f"c{d} AS (SELECT n.row, n.path, n.up, n.key, CASE json_type(n.j) WHEN 'OBJECT' THEN '{{' || coalesce(i.c, '') || '}}' WHEN 'ARRAY' THEN '[' || coalesce(i.c, '') || ']' ELSE {leaf} END AS c"
            f" FROM n{d} n LEFT JOIN {inside} i ON n.row = i.row AND n.path = i.up)"
        )
    return ",\n".join(parts)


#: ``h``: each turn of each delivery with the text of its three values, as last loaded.
_TURNS = rf"""WITH t AS (SELECT snapshot_no, lower(regexp_replace(turn_id, '^\s+|\s+$', '', 'g')) AS turn_id, coalesce(epoch_us(loaded_at), -4611686018427387904) AS loaded, decisions, strategy_outputs, criteria_results FROM turn_snapshots WHERE snapshot_no IS NOT NULL AND turn_id IS NOT NULL),
d AS (SELECT *, row_number() OVER () AS n FROM (SELECT DISTINCT * FROM t WHERE turn_id <> '')),
e AS (SELECT n, unnest(['a', 'b', 'c']) AS part, unnest([decisions, strategy_outputs, criteria_results]) AS text FROM d),
s AS (SELECT n || part AS row, CASE WHEN trim(coalesce(text, '')) = '' THEN 'null'::JSON WHEN json_valid(text) THEN text::JSON ELSE to_json('text ' || trim(text)) END AS j FROM e),
{_canonical('s')},
v AS (SELECT substring(row, 1, length(row) - 1)::BIGINT AS n, string_agg(c, chr(0) ORDER BY row) AS value FROM c0 GROUP BY 1),
h AS (SELECT snapshot_no, turn_id, arg_max(value, (loaded, value)) AS value FROM d JOIN v USING (n) GROUP BY ALL),
r AS (SELECT snapshot_no, row_number() OVER (ORDER BY snapshot_no) AS rank FROM (SELECT DISTINCT snapshot_no FROM h)),
k AS (SELECT h.*, rank FROM h JOIN r USING (snapshot_no)) """

#: Names under which a lone object counts as an array of one.
_LONE = "('segments', 'clips', 'marks', 'options', 'evidence', 'spans', 'filters', 'targets')"


def _elements(roots: str, depth: int = 14) -> str:
    """CTEs ``n0, n1, ...`` with the values below ``roots`` (``tab, rec, path, j``) by depth: whether each is an object
    that is an array element, the nearest such object around it, and the one nearest to what is in it."""
    parts = [f"n0 AS (SELECT tab, rec, path, '' AS around, '' AS near, false AS element, j FROM {roots})"]
    for d in range(1, depth + 1):
        keys = f"(SELECT *, json_type(j) = 'OBJECT' AS o, unnest(CASE json_type(j) WHEN 'OBJECT' THEN json_keys(j) WHEN 'ARRAY' THEN list_transform(range(json_array_length(j)::BIGINT), lambda i: i::VARCHAR) END) AS k FROM n{d - 1} WHERE json_type(j) IN ('OBJECT', 'ARRAY'))"
        child = f"(SELECT tab, rec, path, near, o, k, json_extract(j, CASE WHEN o THEN '$.\"' || k || '\"' ELSE '$[' || k || ']' END) AS j FROM {keys})"
        named = f"(SELECT *, json_type(j) = 'OBJECT' AND (NOT o OR k IN {_LONE}) AS e, path || CASE WHEN o THEN '.' || k || CASE WHEN json_type(j) = 'OBJECT' AND k IN {_LONE} THEN '[0]' ELSE '' END ELSE '[' || k || ']' END AS here FROM {child})"
        parts.append(f"n{d} AS (SELECT tab, rec, here AS path, near AS around, CASE WHEN e THEN here ELSE near END AS near, e AS element, j FROM {named})")
    parts.append("n AS (" + " UNION ALL ".join(f"SELECT tab, rec, path, around FROM n{d} WHERE element" for d in range(1, depth + 1)) + ")")
    return ",\n".join(parts)


_NESTED = rf"""WITH e AS (SELECT trace_id::VARCHAR AS rec, regexp_extract(max(intent_llm), '\{{.*\}}', 0, 's') AS t FROM eval_traces WHERE trace_id IS NOT NULL GROUP BY trace_id),
c AS (SELECT rec, t FROM (SELECT lower(regexp_replace(turn_id, '^\s+|\s+$', '', 'g')) AS rec, criteria_results AS t, loaded_at FROM turn_snapshots WHERE snapshot_no = 9 AND turn_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY rec ORDER BY loaded_at DESC NULLS LAST, t DESC NULLS LAST) = 1),
w AS (SELECT id AS rec, step_outputs AS t FROM workflow_items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, step_outputs DESC NULLS LAST) = 1),
s AS (SELECT rec, t, unnest(json_keys(t)) AS step FROM w WHERE json_valid(t) AND json_type(t) = 'OBJECT'), v AS (SELECT rec, step, json_extract(t, '$."' || step || '".current') AS j FROM s),
r AS (SELECT 'eval_traces' AS tab, rec, 'intent_llm.parameters' AS path, json_extract(t, '$.parameters') AS j FROM e WHERE json_valid(t) UNION ALL SELECT 'turn_snapshots', rec, 'criteria_results', t::JSON FROM c WHERE json_valid(t)
  UNION ALL SELECT 'workflow_items', rec, 'step_outputs.' || step || '.current', CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$')) THEN json_extract_string(j, '$')::JSON ELSE j END FROM v),
{_elements('r')} """

SQL = {
    "p5_found": _NESTED + "SELECT tab AS table_name, rec AS record_id, path AS node_path, around AS parent_path FROM n",
    "p4_found": _TURNS + """
SELECT r.snapshot_no, coalesce(b.turn_id, a.turn_id) AS turn_id, CASE WHEN a.turn_id IS NULL THEN 'added' WHEN b.turn_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT *, rank + 1 AS next FROM k) a FULL JOIN k b ON a.next = b.rank AND a.turn_id = b.turn_id JOIN r ON r.rank = coalesce(b.rank, a.next)
WHERE r.rank > 1 AND a.value IS DISTINCT FROM b.value""",
    "p4_intervals": _TURNS + """, g AS (SELECT turn_id, value, rank, rank - row_number() OVER (PARTITION BY turn_id, value ORDER BY rank) AS island FROM k)
SELECT turn_id, min(rank) AS first, max(rank) AS last FROM g GROUP BY turn_id, value, island""",
}
