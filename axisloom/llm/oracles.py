"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .common import plain_words
from .licenses import LEAST, SHINGLE, TEMPLATES, TIERS
from .urls import RULES

_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH doc AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
item AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
gram AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, n, item_id FROM gram JOIN win USING (n, g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s
  FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def licenses_sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The best window of each template by exact containment, over all windows of its tier; every template has SHINGLE words or more."""
    rows = []
    for name, text in sorted(templates.items()):
        words = [w.decode() for w in plain_words(text.encode())]
        shingles = {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        n = len(words) - SHINGLE + 1
        tier = next((w for w in TIERS if 2 * n <= w), 2 * n)
        rows += [f"('{name}', {tier}, {len(shingles)}, '{s}')" for s in sorted(shingles)]
    return rf"""
WITH template(name, tier, n, g) AS (VALUES {", ".join(rows)}),
doc AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(len(w) - {SHINGLE - 1})) AS i FROM doc WHERE len(w) >= {SHINGLE}),
hit AS (SELECT doc_id, name, tier, n, i, g FROM (SELECT doc_id, i, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS g FROM pos) JOIN template USING (g)),
win AS (SELECT *, unnest([i // (tier // 2), i // (tier // 2) - 1]) * (tier // 2) AS s FROM hit),
share AS (SELECT doc_id, name, s, count(DISTINCT g) / any_value(n) AS c, min(i) AS a, max(i) + {SHINGLE} AS b FROM win WHERE s >= 0 AND i < s + tier GROUP BY doc_id, name, s HAVING c >= {LEAST}),
best AS (SELECT * FROM share QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY c DESC, s) = 1),
found AS (SELECT doc_id, count(*) AS k, string_agg(name, ',' ORDER BY name) AS names, min(c) AS c, string_agg(a || '-' || b, ',' ORDER BY name) AS spans FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, coalesce(c, 0)::DOUBLE AS containment, coalesce(spans, '') AS spans FROM doc LEFT JOIN found USING (doc_id)
"""


def url_rules_sql(rules=RULES) -> str:
    rows = ", ".join(f"('{what}', '{h}', '{p}')" for what, h, p in rules)
    return rf"""
WITH rule(verdict, h, p) AS (VALUES {rows}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
part AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM rest),
fits AS (SELECT k, h || p AS rule, verdict FROM part, rule WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, verdict AS rule_verdict FROM part LEFT JOIN best USING (k)
"""


MEDIA = """
WITH doc AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
size AS (SELECT doc_id, b, octet_length(b) AS n, greatest(64, ((octet_length(b) + 63) // 64) * 64) AS m FROM doc)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(b || repeat(unhex('00'), m - n)) AS payload_sha256 FROM size
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op4_licenses": licenses_sql(), "url_rules": url_rules_sql(), "media_payloads": MEDIA}
