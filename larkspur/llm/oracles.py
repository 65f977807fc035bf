"""DuckDB SQL for the queries, or the parts of them, that it can express; for distinct ids, as in the test tables."""

from __future__ import annotations

from larkspur.llm import kd_clusters, mixing, vector_codes

#: All pairs of texts that share a shingle, and what links of 0.8 and more connect.
NEAR_DUPLICATES = r"""
WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS rep FROM documents GROUP BY ALL),
words AS (SELECT rep, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM texts),
grams AS MATERIALIZED (SELECT DISTINCT rep, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT rep, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
shared AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.rep < b.rep GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes a ON a.rep = x JOIN sizes b ON b.rep = y WHERE c / (a.n + b.n - c) >= 0.8),
ways AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links UNION SELECT rep, rep FROM texts),
reach(node, seen) AS (SELECT rep, rep FROM texts UNION SELECT r.node, w.y FROM reach r JOIN ways w ON w.x = r.seen),
class AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY node)
SELECT d.doc_id, t.rep AS copy_of, c.class_id FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN class c ON c.node = t.rep
"""

#: Every 200-byte string of every text by a 64-bit hash; runs are positions no more than 200 apart.
REPEATS = r"""
WITH raw AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, c, substr(h, 2 * c + 1, 798) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 200)) AS c FROM raw)),
strings AS (SELECT doc_id, c + j AS i, hash(substr(part, 2 * j + 1, 400)) AS name FROM (SELECT doc_id, c, part, unnest(range(0, len(part) // 2 - 199)) AS j FROM pieces)),
hits AS (SELECT doc_id, i FROM strings WHERE name IN (SELECT name FROM strings GROUP BY name HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM hits),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS b, max(i) + 200 AS e FROM numbered GROUP BY doc_id, run),
between_runs AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS free FROM runs),
kept AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * free + 1, 2 * (b - free)), '' ORDER BY b) AS head FROM between_runs JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT r.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM raw r LEFT JOIN kept k ON k.doc_id = r.doc_id
"""

#: The rules alone, written out; what no rule fits has none.
URL_RULES = r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, len(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(verdict, len(h || p)) AS verdict FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, verdict FROM parts LEFT JOIN fits USING (page_id)
"""

#: Each text with its last quarter replaced by the beginning of the next one.
EDITED_TEXTS = r"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following FROM documents)
SELECT doc_id, len(text) AS n_chars, sha256(substr(text, 1, len(text) - len(text) // 4) || substr(following, 1, len(text) // 4)) AS edited_sha256 FROM rows
"""

ORACLE_SQL = {"op2_near_duplicates": NEAR_DUPLICATES, "op3_repeats": REPEATS, "op8_mixing": mixing.ORACLE, "op11_kd_clusters": kd_clusters.oracle(), "op12_vector_codes": vector_codes.oracle(), "url_rules": URL_RULES, "edited_texts": EDITED_TEXTS}
