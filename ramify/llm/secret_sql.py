"""The secret scan as DuckDB SQL, built from the same patterns."""

from __future__ import annotations

import re

from ramify.llm.secrets import ALLOWED, BASE, CANDIDATE, HEX_BITS, OTHER_BITS, WINDOW


def _either_case(pattern: str) -> str:
    """ASCII letters of the words in both cases; SQL's own flag would add letters of other scripts."""
    if not pattern.startswith("(?i)"):
        return pattern
    words, rest = pattern[4:].split(")", 1)
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words) + ")" + rest


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    p = _quoted(_either_case(pattern))
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, {least} AS least, string_split_regex(t, {p}) AS b,
  regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS g FROM d"""


def secret_sql() -> str:
    kinds = [_found(k, i, p, g, n) for i, (k, (p, g, n)) in enumerate(BASE.items())]
    kinds.append(_found("entropy", len(BASE), CANDIDATE, 0, 1))
    allowed = " OR ".join(f"regexp_matches(m, {_quoted(p)})" for p in ALLOWED)
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(kinds)}),
u AS (SELECT doc_id, kind, place, least, unnest(range(1, len(m) + 1)) AS i, b, m, g FROM f WHERE len(m) > 0),
v AS (SELECT doc_id, kind, place, least, i, length(b[i]) AS nb, length(m[i]) AS nm, m[i] AS m, length(g[i]) AS ng FROM u),
p AS (SELECT *, (sum(nb + nm) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS e FROM v),
q AS (SELECT doc_id, kind, place, m, e - nm AS s, e FROM p WHERE ng >= least),
base AS (SELECT * FROM q WHERE kind <> 'entropy'),
cand AS (SELECT *, unnest(range(0, length(m) - {WINDOW} + 1)) AS w0 FROM q
  WHERE kind = 'entropy' AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allowed})),
chars AS (SELECT doc_id, s, m, w0, unnest(string_split(substr(m, (w0 + 1)::BIGINT, {WINDOW}), '')) AS c FROM cand),
counted AS (SELECT doc_id, s, m, w0, c, count(*) / {WINDOW}.0 AS x FROM chars GROUP BY ALL),
bits AS (SELECT doc_id, s, m, w0, -sum(x * log2(x)) AS h FROM counted GROUP BY ALL),
passed AS (SELECT doc_id, s + min(w0) AS s, s + max(w0) + {WINDOW} AS e FROM bits
  WHERE NOT regexp_full_match(substr(m, (w0 + 1)::BIGINT, {WINDOW}), '[0-9]+')
  AND h + 1e-9 >= CASE WHEN regexp_full_match(substr(m, (w0 + 1)::BIGINT, {WINDOW}), '[0-9a-f]+|[0-9A-F]+') THEN {HEX_BITS} ELSE {OTHER_BITS} END
  GROUP BY doc_id, bits.s),
more AS (SELECT * FROM passed x WHERE NOT EXISTS (SELECT 1 FROM base y WHERE y.doc_id = x.doc_id AND y.s <= x.s AND x.e <= y.e)),
a AS (SELECT doc_id, kind, place, s, e FROM base UNION ALL SELECT doc_id, 'entropy', {len(BASE)}, s, e FROM more),
x AS (SELECT doc_id, {counts}, string_agg(CASE WHEN kind <> 'entropy' THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, place) AS base,
  {listed} AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (doc_id)
"""
