"""SQL that judges every URL by every rule, for comparison with the index."""

from __future__ import annotations

from ramify.llm.urlfilter import production_rules


def filter_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(r.rule)}, {quoted(r.action)}, {quoted(r.regex)}, {str(r.folded).lower()})" for r in production_rules())
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH r(rule, action, regex, fold) AS (VALUES {rows}),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages),
b AS (SELECT page_id, s, {fold.format("regexp_extract(s, '^[^/?#]*', 0)")} AS host, regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
p AS (SELECT row_number() OVER () AS row_, page_id, host, path, host || substr(s, length(host) + 1) AS place FROM b),
f AS (SELECT p.row_, r.*, row_number() OVER (PARTITION BY p.row_ ORDER BY r.fold, length(rule) DESC, action, rule) AS k FROM p JOIN r
  ON p.place <> '' AND regexp_matches(CASE WHEN r.fold THEN {fold.format("p.place")} ELSE p.place END, r.regex))
SELECT page_id, host, path, CASE WHEN NOT f.fold THEN f.rule END AS rule, CASE WHEN f.fold THEN f.rule END AS pattern,
  coalesce(f.action, 'allow') AS verdict FROM p LEFT JOIN f ON p.row_ = f.row_ AND f.k = 1
"""
