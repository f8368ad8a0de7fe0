"""The similarity by matching blocks in SQL, for the queries that are compared with it."""

from __future__ import annotations

_AT = "substr({0}, {1}, {2})"


def ratio(pairs: str) -> str:
    """CTEs that end in ratio(x, y, r) for the pairs (x, y) of the CTE of this name; to be used after WITH RECURSIVE.

    forward: how far letters agree from i and j on; a stretch (alo to ahi, blo to bhi) gives a block and the stretches beside it."""
    # A stretch in which nothing agrees stays: frequent letters may agree at its beginning. A struct of nulls is not null, so that
    # rows that met nothing are filtered.
    best = """SELECT s.pair, x, y, alo, ahi, blo, bhi, min({'k': -least(n, ahi - i, bhi - j), 'i': i, 'j': j}) FILTER (WHERE n IS NOT NULL) AS least
  FROM (SELECT * FROM stretches WHERE alo < ahi AND blo < bhi) s LEFT JOIN forward f ON s.pair = f.pair AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY s.pair, x, y, alo, ahi, blo, bhi"""
    block = f"SELECT * EXCLUDE (least), coalesce(least, {{'k': CAST(0 AS BIGINT), 'i': alo, 'j': blo}}) AS m FROM ({best})"
    before = f"CASE WHEN length(y) < 200 THEN 0 ELSE coalesce(list_max(list_filter(range(1, least(m.i - alo, m.j - blo) + 1), lambda e: {_AT.format('x', 'm.i - e', 'e')} = {_AT.format('y', 'm.j - e', 'e')})), 0) END"
    after = f"CASE WHEN length(y) < 200 THEN 0 ELSE coalesce(list_max(list_filter(range(1, least(ahi - m.i + m.k, bhi - m.j + m.k) + 1), lambda e: {_AT.format('x', 'm.i - m.k', 'e')} = {_AT.format('y', 'm.j - m.k', 'e')})), 0) END"
    return f"""numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x, y) AS pair, x, y FROM (SELECT DISTINCT x, y FROM {pairs})),
letters AS (SELECT pair, j, c, count(*) OVER (PARTITION BY pair, c) AS often, size FROM (SELECT pair, unnest(range(1, length(y) + 1)) AS j, unnest(string_split(y, '')) AS c, length(y) AS size FROM numbered WHERE y <> '')),
agreeing AS (SELECT a.pair, i, j FROM (SELECT pair, unnest(range(1, length(x) + 1)) AS i, unnest(string_split(x, '')) AS c FROM numbered WHERE x <> '') a JOIN letters l ON a.pair = l.pair AND a.c = l.c WHERE size < 200 OR often <= size // 100 + 1),
forward AS MATERIALIZED (SELECT pair, i, j, max(i) OVER (PARTITION BY pair, j - i, island) - i + 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY pair, j - i ORDER BY i) AS island FROM agreeing)),
stretches AS (SELECT pair, x, y, CAST(1 AS BIGINT) AS alo, length(x) + 1 AS ahi, CAST(1 AS BIGINT) AS blo, length(y) + 1 AS bhi, CAST(NULL AS BIGINT) AS got FROM numbered
UNION ALL SELECT pair, x, y, unnest([alo, i + k, i]), unnest([i, ahi, i]), unnest([blo, j + k, j]), unnest([j, bhi, j]), unnest([NULL, NULL, k])
  FROM (SELECT pair, x, y, alo, ahi, blo, bhi, m.i - e1 AS i, m.j - e1 AS j, e1 - m.k + e2 AS k FROM (SELECT *, {before} AS e1, {after} AS e2 FROM ({block}))) WHERE k > 0),
ratio AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1e0 ELSE 2e0 * coalesce(sum(got), 0) / (length(x) + length(y)) END AS r FROM stretches GROUP BY pair, x, y)"""
