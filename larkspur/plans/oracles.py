"""DuckDB SQL for the named queries.

The fixed word lists and patterns and the messages' arithmetic are the same text on both sides;
everything that is done with them is written here a second time.
"""

from __future__ import annotations

from larkspur.functions import rules as R
from larkspur.plans.fixture import messages_sql


def bounded(pattern: str) -> str:
    """Every other word bound of a pattern opens a word, the rest close one."""
    first, *rest = pattern.split(r"\b")
    return first + "".join((r"(?:$|[^_\pL\pN])" if k % 2 else r"(?:^|[^_\pL\pN])") + part for k, part in enumerate(rest))


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(words) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def nolinks(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '(?i)@[\pL\pN_]+|https?://[^\s]+', ' ', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normal(x: str) -> str:
    return squeeze(f"lower({nolinks(x)})")


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(bounded(pattern))})"


def kept(tokens: str, stops=R.STOP_WORDS) -> str:
    return f"list_filter({tokens}, lambda t: len(t) > 2 AND NOT list_contains({strings(stops)}, t))"


def words(x: str) -> str:
    return kept(f"regexp_extract_all(lower({nolinks(x)}), '[a-z0-9]+')")


def content(x: str) -> str:
    bare = rf"regexp_replace({normal(x)}, 'www\.[^\s]+|#[\pL\pN_]+', ' ', 'g')"
    return f"list_distinct({kept(f"regexp_extract_all({bare}, '[a-z0-9]+')")})"


def review(x: str) -> str:
    bare = rf"regexp_replace({squeeze(f"lower(coalesce({x}, ''))")}, 'https?://[^\s]+|[@#][\pL\pN_]+', ' ', 'g')"
    return f"list_distinct({kept(f"regexp_extract_all({bare}, '[a-z0-9]+')", R.REVIEW_STOP_WORDS)})"


def filled(items) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / sqrt(len({a}) * CAST(len({b}) AS DOUBLE)) ELSE 0.0 END"


IDS = [i for i, _ in R.INTENTS]
EV = [f"ev{k}" for k in range(len(IDS))]
RISKS = "array_to_string(" + filled(f"CASE WHEN {hit("low", p)} THEN {lit(name)} END" for name, p in R.ANNOTATION_RISKS) + ", '; ')"
TYPE = "CASE WHEN trim(coalesce({0}, '')) = '' THEN 'none' " + " ".join(f"WHEN {hit("lower({0})", p).replace('{', '{{').replace('}', '}}').replace('{{0}}', '{0}')} THEN '{name}'" for name, p in R.RESPONSE_TYPES) + " ELSE 'acknowledgement_or_other' END"

MSG = "WITH RECURSIVE " + messages_sql("duckdb")
TIME = "try_strptime(created_at, '%a %b %d %H:%M:%S +0000 %Y')"
ORDER = f"{TIME} NULLS LAST, role, CAST(message_id AS BIGINT)"
OUT, IN = "(SELECT * FROM msg WHERE inbound <> 'True')", "(SELECT * FROM msg WHERE inbound = 'True')"
LINKS = MSG + f""",
resp AS (SELECT message_id, unnest(regexp_extract_all(coalesce(response_ids, ''), '[0-9]+')) AS other FROM {IN}),
par AS (SELECT message_id, unnest(regexp_extract_all(coalesce(parent_ids, ''), '[0-9]+')) AS other FROM {IN}),
opar AS (SELECT message_id, author_id AS brand, unnest(regexp_extract_all(coalesce(parent_ids, ''), '[0-9]+')) AS other FROM {OUT}),
issue AS (SELECT DISTINCT r.message_id, o.author_id AS brand FROM resp r JOIN {OUT} o ON o.message_id = r.other),
reply AS (SELECT p.message_id, o.author_id AS brand, p.other FROM par p JOIN {OUT} o ON o.message_id = p.other),
flag AS (SELECT message_id, message_id IN (SELECT r.message_id FROM resp r JOIN {OUT} o ON o.message_id = r.other AND o.author_id = 'brand1') AS has_response,
    message_id IN (SELECT other FROM opar WHERE brand = 'brand1') AS is_parent,
    message_id IN (SELECT p.message_id FROM par p JOIN {OUT} o ON o.message_id = p.other AND o.author_id = 'brand1') AS replies_to FROM {IN}),
freq AS (SELECT brand, token, count(*) AS n FROM (SELECT i.brand, unnest(list_filter(regexp_extract_all(lower({nolinks("m.text")}), '[a-z][a-z'']{{2,}}'), lambda t: len(t) > 2 AND NOT list_contains({strings(R.BRAND_STOP_WORDS)}, t))) AS token
    FROM issue i JOIN msg m USING (message_id)) GROUP BY ALL)"""
EDGES = """,
edge AS (SELECT CAST(message_id AS BIGINT) AS a, CAST(message_id AS BIGINT) AS b FROM msg UNION SELECT CAST(message_id AS BIGINT), CAST(unnest(regexp_extract_all(coalesce(parent_ids, ''), '[0-9]+')) AS BIGINT) FROM msg),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
CLS = MSG + f""",
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY {ORDER}) AS pos, count(*) OVER (PARTITION BY conversation_id) AS conversation_length,
    lead(role) OVER (PARTITION BY conversation_id ORDER BY {ORDER}) AS next_role, lead(message_id) OVER (PARTITION BY conversation_id ORDER BY {ORDER}) AS next_id,
    lead(text) OVER (PARTITION BY conversation_id ORDER BY {ORDER}) AS next_text FROM msg),
cls0 AS (SELECT *, {normal("text")} AS normal, {squeeze("lower(coalesce(text, ''))")} AS low, CASE WHEN next_role = 'brand_response' THEN next_id END AS response_id,
    CASE WHEN next_role = 'brand_response' THEN next_text END AS response FROM ordered WHERE role = 'customer_message'),
cls1 AS MATERIALIZED (SELECT *, {", ".join(f"{filled(f"CASE WHEN {hit("normal", p)} THEN {lit(p)} END" for p in ps)} AS ev{k}" for k, (_, ps) in enumerate(R.INTENTS))} FROM cls0),
cls2 AS (SELECT *, {filled(f"CASE WHEN len({e}) > 0 THEN '{i}' END" for i, e in zip(IDS, EV, strict=True))} AS ids, {" + ".join(f"len({e})" for e in EV)} AS evidence_strength,
    greatest({", ".join(f"len({e})" for e in EV)}) AS most, len(regexp_extract_all(normal, '[a-z][a-z0-9'']*')) AS words,
    regexp_full_match(normal, {lit("(?i)" + R.NON_SUPPORT)}) AS non_support FROM cls1),
cls AS MATERIALIZED (SELECT *, CASE WHEN most = 0 THEN NULL {" ".join(f"WHEN len({e}) = most THEN '{i}'" for i, e in zip(IDS, EV, strict=True))} END AS prim,
    CASE WHEN len(ids) = 0 THEN 'unclassified' WHEN len(ids) > 1 THEN 'multi_intent' WHEN words <= 3 OR non_support THEN 'ambiguous' ELSE 'primary_intent' END AS bucket FROM cls2)"""
MATCH = CLS + ",\nmatch AS (" + " UNION ALL ".join(f"SELECT message_id, conversation_id, '{i}' AS intent_id, {e} AS evidence FROM cls WHERE len({e}) > 0" for i, e in zip(IDS, EV, strict=True)) + ")"
PHRASE = {name: hit("normal", p) for name, p in R.DIFFICULTY_PHRASES}
PHRASE["historical_retrieval_context"] += " OR conversation_length >= 4"
TAGGED = ",\ntagged AS (SELECT *, " + filled([
    "CASE WHEN bucket = 'primary_intent' AND len(ids) = 1 THEN 'clear_single_intent' END", "CASE WHEN words <= 8 OR conversation_length <= 2 THEN 'incomplete_context' END",
    *(f"CASE WHEN {test} THEN '{name}' END" for name, test in PHRASE.items()),
]) + f""" AS tags FROM cls), golden AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY len(tags) DESC, md5(concat('{R.GOLDEN_SEED}:', message_id)) DESC, message_id) AS golden_rank FROM tagged)"""
TAGS = CLS + TAGGED
RANKED = CLS + f",\nranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY evidence_strength DESC, words DESC, conversation_length DESC, {TIME} NULLS LAST, message_id) AS bucket_rank FROM cls)"
NOTE = MATCH + f""",
note0 AS (SELECT *, {RISKS} AS risks, CASE WHEN bucket = 'primary_intent' THEN prim WHEN bucket = 'multi_intent' THEN NULL WHEN len(ids) = 1 AND evidence_strength >= 2 THEN ids[1] END AS label FROM cls),
note1 AS (SELECT *, CASE WHEN bucket = 'primary_intent' AND evidence_strength >= 2 THEN 'high' WHEN bucket = 'primary_intent' OR label IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM note0),
note2 AS (SELECT *, list_filter([CASE WHEN bucket = 'ambiguous' THEN 'ambiguous bucket' END, CASE WHEN bucket = 'multi_intent' THEN 'multi-intent bucket' END,
    CASE WHEN bucket = 'unclassified' AND label IS NULL THEN 'unclassified without label' END, CASE WHEN confidence = 'low' THEN 'low confidence' END,
    CASE WHEN words <= 3 THEN 'short message' END, CASE WHEN label IS NOT NULL AND NOT list_contains(ids, label) THEN 'label not among matches' END], lambda x: x IS NOT NULL) AS reasons FROM note1),
note AS MATERIALIZED (SELECT *, array_to_string(reasons, '; ') AS review_reasons, len(reasons) > 0 AS review_required,
    CASE WHEN risks <> '' THEN true WHEN bucket = 'primary_intent' AND confidence = 'high' THEN false END AS escalate FROM note2),
said AS MATERIALIZED (SELECT n.message_id AS target_id, m.intent_id, count(DISTINCT m.pattern) AS score FROM note n JOIN (SELECT conversation_id, intent_id, unnest(evidence) AS pattern FROM match) m USING (conversation_id)
    WHERE n.review_required GROUP BY ALL HAVING count(DISTINCT m.pattern) >= 2),
tied AS MATERIALIZED (SELECT target_id, list(intent_id ORDER BY intent_id) AS tied FROM (SELECT *, max(score) OVER (PARTITION BY target_id) AS best FROM said) WHERE score = best GROUP BY target_id),
resolved AS MATERIALIZED (SELECT n.*, CASE WHEN tied IS NULL THEN NULL WHEN len(tied) > 1 AND list_contains(tied, prim) THEN prim ELSE tied[1] END AS resolved_intent,
    CASE WHEN tied IS NULL THEN 'insufficient_evidence' WHEN len(tied) > 1 THEN 'genuinely_ambiguous' WHEN conversation_length > 1 OR len(ids) = 0 THEN 'resolved_from_context' ELSE 'resolved_from_text' END AS status,
    CASE WHEN tied IS NULL THEN 'low' WHEN len(tied) > 1 THEN 'medium' WHEN conversation_length > 1 THEN 'high' ELSE 'medium' END AS resolved_confidence
    FROM note n LEFT JOIN tied t ON t.target_id = n.message_id WHERE review_required)"""
FIND = CLS + f""",
asked AS (SELECT *, CASE WHEN bucket = 'primary_intent' THEN prim END AS gold_intent FROM cls),
term AS MATERIALIZED (SELECT message_id, conversation_id, token, count(*) AS tf FROM (SELECT message_id, conversation_id, unnest({words("text")}) AS token FROM cls) GROUP BY ALL),
idf AS MATERIALIZED (SELECT token, ln(((SELECT count(*) FROM cls) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM term GROUP BY token),
weight AS MATERIALIZED (SELECT message_id, conversation_id, token, tf * idf AS w FROM term JOIN idf USING (token)),
norm AS MATERIALIZED (SELECT message_id, sqrt(sum(w * w)) AS norm FROM weight GROUP BY message_id),
dots AS (SELECT q.message_id AS query_id, d.message_id AS doc_id, sum(q.w * d.w) AS dot FROM weight q JOIN weight d USING (token)
    WHERE q.conversation_id <> d.conversation_id AND q.message_id <> d.message_id GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(dot / (a.norm * b.norm), 9) AS score FROM dots JOIN norm a ON a.message_id = query_id JOIN norm b ON b.message_id = doc_id),
found AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 5),
rows AS MATERIALIZED (SELECT a.message_id AS query_id, a.text AS query, a.gold_intent, a.bucket, f.doc_id, f.rank, f.score, c.text AS doc_text, c.response, coalesce(list_contains(c.ids, a.gold_intent), false) AS hit
    FROM asked a LEFT JOIN found f ON f.query_id = a.message_id LEFT JOIN cls c ON c.message_id = f.doc_id),
toks AS MATERIALIZED (SELECT *, list_distinct({words("query")}) AS tq, list_distinct({words("doc_text")}) AS tc, list_distinct({words("response")}) AS tr FROM rows),
lap AS (SELECT *, {overlap("tq", "tc")} AS qc, {overlap("tq", "tr")} AS qr, trim(coalesce(response, '')) <> '' AS available FROM toks),
ev0 AS (SELECT *, round(CASE WHEN available THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END + 0.25::DOUBLE * least(qc, 1.0::DOUBLE) + 0.25::DOUBLE * least(qr, 1.0::DOUBLE), 6) AS evidence_score, {TYPE.format("response")} AS response_type FROM lap),
ev AS MATERIALIZED (SELECT *, CASE WHEN evidence_score >= 0.65 THEN 'strong' WHEN evidence_score >= 0.35 THEN 'moderate' ELSE 'weak' END AS strength FROM ev0),
usable AS MATERIALIZED (SELECT * FROM ev WHERE available AND evidence_score >= 0.35 AND response_type IN ('diagnostic_question', 'direct_guidance')),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY evidence_score DESC, rank, doc_id) AS r FROM usable) WHERE r = 1),
ground AS (SELECT a.message_id AS query_id, a.text AS query, a.gold_intent, a.bucket, b.doc_id, b.evidence_score, b.response_type, b.response FROM asked a LEFT JOIN best b ON b.query_id = a.message_id),
decide AS (SELECT *, CASE {" ".join(f"WHEN {hit("lower(query)", p)} THEN '{name}'" for name, p in R.DECISION_RISKS)} WHEN doc_id IS NULL THEN 'insufficient_historical_evidence'
    WHEN gold_intent IS NULL AND bucket IN ('ambiguous', 'multi_intent', 'unclassified') THEN 'ambiguous_request' END AS reason FROM ground),
per AS (SELECT query_id, max(CASE WHEN hit AND rank <= 1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN hit AND rank <= 3 THEN 1 ELSE 0 END) AS h3, max(CASE WHEN hit AND rank <= 5 THEN 1 ELSE 0 END) AS h5,
    min(CASE WHEN hit THEN rank END) AS first_hit, max(CASE WHEN rank IS NOT NULL THEN 1 ELSE 0 END) AS has_rows FROM rows WHERE gold_intent IS NOT NULL GROUP BY query_id),
quality AS (SELECT count(*) AS eligible, round(avg(h1), 6) AS hit_at_1, round(avg(h3), 6) AS hit_at_3, round(avg(h5), 6) AS hit_at_5, round(avg(CASE WHEN has_rows = 1 THEN coalesce(1.0::DOUBLE / first_hit, 0) END), 6) AS mrr FROM per),
means AS (SELECT count(DISTINCT query_id) AS queries, count(*) FILTER (rank IS NULL) AS failures, round(avg(score) FILTER (rank = 1), 6) AS mean_top, round(avg(score), 6) AS mean_all FROM rows)"""
QT = rf"regexp_extract_all({normal('text')}, '[a-z0-9]+')"
SIZES = {"primary_intent": 60, "unclassified": 26, "multi_intent": 24, "ambiguous": 15}
POOL = ", ".join(f"('{b}', {k})" for b, k in SIZES.items())


def canon(x: str, *, hashtags: bool) -> str:
    bare = normal(x) if hashtags else rf"regexp_replace({normal(x)}, 'www\.[^\s]+|#[\pL\pN_]+', ' ', 'g')"
    return squeeze(rf"regexp_replace({bare}, '[^a-z0-9\s]', ' ', 'g')")


def alike(a: str, b: str) -> str:
    """Shared words of two lists, as the near-duplicate rule wants them."""
    both = f"len(list_intersect({a}, {b}))"
    return f"{both} >= 4 AND {both} >= 0.7 * least(len({a}), len({b})) AND len({a}) + len({b}) - {both} >= 6"


def damaged(x: str) -> str:
    marks, bad = f"[{R.MOJIBAKE_MARKERS}]", lit(R.MOJIBAKE_CLUSTERS)
    beside = lit(f"(?i)[a-z0-9]{marks}{{2,}}|{marks}{{2,}}[a-z0-9]")
    return f"(len(regexp_extract_all({x}, 'I[\ufe0e\ufe0f]')) >= 4 OR len(list_filter(regexp_extract_all({x}, '\\S+'), lambda t: len(t) <= 24 AND regexp_matches(t, '{marks}') AND (regexp_matches(t, {bad}) OR regexp_matches(t, {beside})))) > 0)"


def quality(tokens: str, text: str) -> str:
    most = f"coalesce(list_max(map_values(list_histogram({tokens}))), 0)"
    return f"CASE WHEN len({tokens}) = 0 THEN 'empty_or_non_informative' WHEN len({tokens}) >= 8 AND len(list_distinct({tokens})) < 0.2 * len({tokens}) THEN 'low_token_diversity' WHEN len({tokens}) >= 8 AND {most} >= 0.5 * len({tokens}) THEN 'repeated_token_noise' WHEN {damaged(text)} THEN 'mojibake_or_unicode_artifact' END"


# Rows one by one in order, as a person would fill a pool: what is accepted so far decides on the next.
FILTERED = RANKED + f""",
grouped AS MATERIALIZED (SELECT *, CASE WHEN bucket = 'primary_intent' THEN prim ELSE '' END AS intent, {QT} AS qt, {canon("text", hashtags=False)} AS canonical,
    list_distinct({kept(f"regexp_extract_all({canon('text', hashtags=False)}, '[a-z0-9]+')")}) AS ct FROM ranked),
judged AS MATERIALIZED (SELECT *, {quality("qt", "coalesce(text, '')")} AS own, row_number() OVER (PARTITION BY bucket, intent ORDER BY bucket_rank) AS j FROM grouped),
clash AS MATERIALIZED (SELECT b.message_id, list(a.j) AS before FROM judged a JOIN judged b ON a.bucket = b.bucket AND a.intent = b.intent AND a.j < b.j WHERE a.own IS NULL AND b.own IS NULL AND len(b.ct) >= 6 AND {alike("a.ct", "b.ct")} GROUP BY b.message_id),
same AS MATERIALIZED (SELECT b.message_id, list(a.j) AS before FROM judged a JOIN judged b ON a.bucket = b.bucket AND a.intent = b.intent AND a.j < b.j AND a.canonical = b.canonical AND a.own IS NULL GROUP BY b.message_id),
walk(bucket, intent, j, message_id, reason, taken) AS (SELECT DISTINCT bucket, intent, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::BIGINT[] FROM judged
    UNION ALL SELECT bucket, intent, j, message_id, reason, CASE WHEN reason IS NULL THEN list_append(taken, j) ELSE taken END FROM
    (SELECT w.bucket, w.intent, n.j, n.message_id, w.taken, CASE WHEN own IS NOT NULL THEN own WHEN list_has_any(w.taken, coalesce(s.before, []::BIGINT[])) THEN 'exact_duplicate' WHEN list_has_any(w.taken, coalesce(c.before, []::BIGINT[])) THEN 'clearly_redundant_near_duplicate' END AS reason
     FROM walk w JOIN judged n ON n.bucket = w.bucket AND n.intent = w.intent AND n.j = w.j + 1 LEFT JOIN clash c ON c.message_id = n.message_id LEFT JOIN same s ON s.message_id = n.message_id)),
filtered AS MATERIALIZED (SELECT bucket, intent, j, message_id, reason FROM walk WHERE j > 0),
raw AS (SELECT prim AS intent, count(*) AS n, count(*) * {SIZES["primary_intent"]} / sum(count(*)) OVER () AS exact FROM cls WHERE bucket = 'primary_intent' GROUP BY prim),
quota AS MATERIALIZED (SELECT 'primary_intent' AS bucket, intent, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, n, intent DESC) <= {SIZES["primary_intent"]} - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM raw
    UNION ALL SELECT b, '', k FROM (VALUES {POOL}) AS q(b, k) WHERE b <> 'primary_intent'),
pool AS MATERIALIZED (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY bucket, intent ORDER BY j) AS pool_rank FROM filtered WHERE reason IS NULL) f JOIN quota q ON q.bucket = f.bucket AND q.intent = f.intent WHERE pool_rank <= quota)"""
GROUPS = ", ".join(f"({k}, {lit(b)}, {lit(i)}, {q})" for k, (b, i, q) in enumerate([*(("primary_intent", i, q // 3) for i, q in R.INTENT_QUOTAS), ("unclassified", "", 10), ("multi_intent", "", 8), ("ambiguous", "", 8)]))
GOLD = FILTERED + TAGGED + f""",
part AS (SELECT * FROM (VALUES {GROUPS}) AS q(turn, bucket, intent, quota)),
pooled AS MATERIALIZED (SELECT p.message_id, p.bucket, p.intent, t.prim, t.created_at, g.golden_rank, q.turn, q.quota, row_number() OVER (ORDER BY q.turn, g.golden_rank, p.message_id) AS place, {canon("t.text", hashtags=True)} AS canonical,
    list_distinct({kept(f"regexp_extract_all({canon('t.text', hashtags=True)}, '[a-z0-9]+')")}) AS ct
    FROM pool p JOIN part q ON q.bucket = p.bucket AND q.intent = p.intent JOIN tagged t ON t.message_id = p.message_id JOIN golden g ON g.message_id = p.message_id),
opposed AS MATERIALIZED (SELECT b.place, list(a.place) AS before FROM pooled a JOIN pooled b ON a.place < b.place WHERE a.canonical = b.canonical OR (len(a.ct) >= 6 AND len(b.ct) >= 6 AND {alike("a.ct", "b.ct")}) GROUP BY b.place),
pick(place, turn, held, taken) AS (SELECT 0::BIGINT, -1, 0, []::BIGINT[]
    UNION ALL SELECT place, turn, held + took, CASE WHEN took = 1 THEN list_append(taken, place) ELSE taken END FROM
    (SELECT n.place, n.turn, CASE WHEN n.turn = w.turn THEN w.held ELSE 0 END AS held, w.taken, CASE WHEN CASE WHEN n.turn = w.turn THEN w.held ELSE 0 END >= n.quota OR list_has_any(w.taken, coalesce(o.before, []::BIGINT[])) THEN 0 ELSE 1 END AS took
     FROM pick w JOIN pooled n ON n.place = w.place + 1 LEFT JOIN opposed o ON o.place = n.place)),
chosen AS MATERIALIZED (SELECT unnest(taken) AS place FROM pick WHERE place = (SELECT max(place) FROM pick))"""
BRAND_EDGES = LINKS + f""",
own AS (SELECT * FROM {OUT} WHERE author_id = 'brand1'), kept AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT m.* FROM msg m JOIN flag f USING (message_id) WHERE has_response OR is_parent OR replies_to),
tie AS (SELECT message_id AS x, message_id AS y FROM kept UNION SELECT message_id, other FROM opar WHERE brand = 'brand1' UNION SELECT message_id, other FROM resp WHERE other IN (SELECT message_id FROM own) UNION SELECT message_id, other FROM par WHERE other IN (SELECT message_id FROM own)),
ties AS MATERIALIZED (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM tie UNION SELECT CAST(y AS BIGINT), CAST(x AS BIGINT) FROM tie),
reached(node, seen) AS (SELECT x, x FROM ties UNION SELECT r.node, t.y FROM reached r JOIN ties t ON t.x = r.seen),
rooted AS (SELECT node, min(seen) AS conversation FROM reached GROUP BY node),
talks AS MATERIALIZED (SELECT k.*, conversation, row_number() OVER (PARTITION BY conversation ORDER BY {ORDER}) AS pos, count(*) OVER (PARTITION BY conversation) AS conversation_length FROM kept k JOIN rooted r ON r.node = CAST(k.message_id AS BIGINT))"""
FLAGS = """array_to_string([CASE WHEN available THEN 'historical_response_available' ELSE 'no_historical_response' END,
    CASE WHEN qc >= 0.35 THEN 'strong_query_customer_overlap' WHEN qc >= 0.15 THEN 'some_query_customer_overlap' ELSE 'weak_query_customer_overlap' END,
    CASE WHEN qr >= 0.25 THEN 'response_lexically_related' WHEN qr > 0 THEN 'limited_response_overlap' ELSE 'no_response_overlap' END,
    CASE WHEN gold_intent IS NULL THEN 'intent_metric_ineligible' WHEN hit THEN 'curated_intent_agreement' ELSE 'curated_intent_mismatch_or_unavailable' END,
    strength || '_deterministic_evidence'], ',')"""
SHARE = "ln(1 + {0}) / ln(1 + greatest(max({0}) OVER (), 1))"
GENERIC = lit(R.GENERIC_GOLD_RESPONSE)

ORACLE_SQL: dict[str, str] = {
    "scan_filter": MSG + " SELECT message_id, created_at FROM msg WHERE role = 'brand_response' AND author_id = 'brand1' AND message_id <> ''",
    "brand_messages": MSG + " SELECT message_id, conversation_id FROM msg WHERE inbound <> 'True' AND author_id = 'brand2'",
    "unnest_messages": CLS + " SELECT conversation_id, CAST(conversation_length AS INT) AS conversation_length, CAST(pos - 1 AS INT) AS place, message_id, role FROM ordered",
    "audit_counts": MSG + f" SELECT count(*) AS n_rows, count(*) FILTER (inbound = 'True') AS n_inbound, count(*) FILTER (inbound <> 'True') AS n_outbound, count(*) FILTER (inbound NOT IN ('True', 'False')) AS n_invalid, count(*) FILTER ({TIME} IS NULL) AS n_bad_time, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty, CAST(min({TIME}) AS VARCHAR) AS first_at, CAST(max({TIME}) AS VARCHAR) AS last_at FROM msg",
    "outbound_by_author": MSG + f" SELECT author_id, count(*) AS n FROM {OUT} GROUP BY author_id",
    "top_brands": MSG + f" SELECT author_id, count(*) AS n FROM {OUT} GROUP BY author_id ORDER BY n DESC, min(CAST(message_id AS BIGINT)) LIMIT 3",
    "semi_join_top_brands": MSG + f" SELECT message_id, author_id FROM {OUT} WHERE author_id IN (SELECT author_id FROM {OUT} GROUP BY author_id ORDER BY count(*) DESC, min(CAST(message_id AS BIGINT)) LIMIT 3)",
    "answered_issues": LINKS + " SELECT * FROM issue",
    "linked_replies": LINKS + " SELECT * FROM reply",
    "response_links": LINKS + " SELECT message_id, brand, other FROM opar",
    "related_inbound": LINKS + " SELECT message_id FROM flag WHERE has_response OR is_parent OR replies_to",
    "link_flags": LINKS + " SELECT * FROM flag",
    "token_freq": LINKS + " SELECT * FROM freq",
    "topical_tokens": LINKS + " SELECT brand, count(*) AS topics FROM freq WHERE n >= 3 GROUP BY brand",
    "distinct_customers": MSG + f" SELECT count(DISTINCT author_id) AS customers FROM {IN}",
    "connected_components_of_replies": MSG + EDGES + " SELECT * FROM comp",
    "component_sizes": MSG + EDGES + " SELECT size, count(*) AS components FROM (SELECT count(*) AS size FROM comp GROUP BY component) GROUP BY size",
    "conversation_order": CLS + " SELECT conversation_id, CAST(pos AS INT) AS pos, message_id, conversation_length FROM ordered",
    "conversation_stats": MSG + " SELECT count(*) AS n_conversations, round(avg(n), 6) AS mean_length, CAST(median(n) AS DOUBLE) AS median_length, max(n) AS max_length, count(*) FILTER (c > 0 AND b > 0) AS n_usable FROM (SELECT count(*) AS n, count(*) FILTER (role = 'customer_message') AS c, count(*) FILTER (role = 'brand_response') AS b FROM msg GROUP BY conversation_id)",
    "immediate_response": CLS + " SELECT message_id, response_id FROM cls0",
    "brand_score": LINKS + f""",
pair AS (SELECT brand, message_id AS x, other AS y FROM opar UNION SELECT brand, message_id, other FROM reply),
two AS (SELECT brand, x, y FROM pair UNION SELECT brand, y, x FROM pair),
walk(brand, node, seen) AS (SELECT brand, x, x FROM two UNION SELECT w.brand, w.node, t.y FROM walk w JOIN two t ON t.brand = w.brand AND t.x = w.seen),
low AS (SELECT brand, node, min(seen) AS c FROM walk GROUP BY ALL), graph AS (SELECT brand, count(DISTINCT c) AS components, count(*) AS nodes FROM low GROUP BY brand),
base AS (SELECT o.author_id AS brand, count(*) AS outbound, coalesce((SELECT count(*) FROM issue i WHERE i.brand = o.author_id), 0) AS issues, coalesce((SELECT count(*) FROM opar p WHERE p.brand = o.author_id), 0) AS responses,
    coalesce((SELECT count(*) FROM freq f WHERE f.brand = o.author_id AND n >= 3), 0) AS topics FROM {OUT} o GROUP BY o.author_id),
b2 AS (SELECT base.*, least(responses, issues) AS usable, CAST(issues AS DOUBLE) / outbound AS rate, coalesce(components, 0) AS components, coalesce(nodes, 0) AS nodes FROM base LEFT JOIN graph USING (brand))
SELECT brand, outbound, issues, responses, usable, round(rate, 6) AS link_rate, components, nodes, topics,
    round(25 * {SHARE.format("issues")} + 25 * {SHARE.format("usable")} + 20 * least(rate, 1.0) + 15 * {SHARE.format("components")} + 15 * least(topics / 30, 1.0), 2) AS score, issues >= 20 AND usable >= 20 AS eligible FROM b2""",
    "intent_match": MATCH + " SELECT message_id, intent_id, CAST(len(evidence) AS INT) AS n_patterns, array_to_string(evidence, ' ') AS patterns FROM match",
    "intent_primary": CLS + " SELECT message_id, prim AS primary_intent, bucket, CAST(evidence_strength AS INT) AS evidence_strength, CAST(words AS INT) AS words FROM cls",
    "non_support": CLS + " SELECT message_id, normal FROM cls WHERE non_support",
    "short_messages": CLS + " SELECT message_id, CAST(words AS INT) AS words FROM cls WHERE words <= 3",
    "taxonomy_diagnostics": MATCH + " SELECT m.intent_id, count(*) AS n_matched, CAST(sum(len(evidence)) AS BIGINT) AS n_patterns, max(p.n) AS n_primary, round(100 * max(p.n) / (SELECT count(*) FROM cls), 2) AS pct_all, round(100 * max(p.n) / (SELECT count(*) FROM cls WHERE len(ids) > 0), 2) AS pct_matched FROM match m LEFT JOIN (SELECT i.intent_id, count(c.message_id) AS n FROM (SELECT DISTINCT intent_id FROM match) i LEFT JOIN cls c ON c.prim = i.intent_id GROUP BY ALL) p USING (intent_id) GROUP BY m.intent_id",
    "pattern_freq": MATCH + " SELECT intent_id, pattern, count(*) AS n FROM (SELECT intent_id, unnest(evidence) AS pattern FROM match) GROUP BY ALL",
    "examples_per_intent": CLS + f" SELECT prim AS intent_id, CAST(example AS INT) AS example, message_id, substr({squeeze("coalesce(text, '')")}, 1, 320) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY prim ORDER BY CAST(message_id AS BIGINT)) AS example FROM cls WHERE prim IS NOT NULL) WHERE example <= 3",
    "quality_reasons": f"WITH d AS (SELECT doc_id, {QT} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, len(t) >= 8 AND len(list_distinct(t)) < 0.2 * len(t) AS low_diversity, len(t) >= 8 AND coalesce(list_max(map_values(list_histogram(t))), 0) >= 0.5 * len(t) AS repeated FROM d",
    "exact_dup_groups": rf"SELECT md5(c) AS canonical_md5, count(*) AS n FROM (SELECT {squeeze(rf"regexp_replace(regexp_replace({normal('text')}, 'www\.[^\s]+|#[\pL\pN_]+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g')")} AS c FROM documents) GROUP BY c HAVING count(*) > 1",
    "mojibake": f"WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' itâ€™s cafÃ© ' || repeat('I' || chr(65039), 4) ELSE text END AS text FROM documents), q AS (SELECT doc_id, coalesce(text, '') AS text, {QT} AS t FROM m) SELECT doc_id, {damaged('text')} AS bad, {quality('t', 'text')} AS reason FROM q",
    "invisible_characters": "SELECT doc_id, md5(coalesce(text || ' ' || lang, '')) AS shown_md5 FROM (SELECT doc_id, replace(replace(replace(text, chr(160), ' '), chr(8203), ''), chr(65279), '') AS text, lang FROM documents)",
    "canonical_forms": MSG + f", late AS (SELECT message_id, text || ' #Late www.example.com/x' AS text FROM msg) SELECT message_id, {canon('text', hashtags=True)} AS with_hashtags, {canon('text', hashtags=False)} AS without FROM late",
    "utc_times": MSG + f" SELECT message_id, strftime({TIME}, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at_utc FROM msg",
    "component_conversations": BRAND_EDGES + " SELECT conversation, CAST(pos AS INT) AS pos, message_id, conversation_length FROM talks",
    "conversation_list": BRAND_EDGES + " SELECT *, CAST(row_number() OVER (ORDER BY first_id, conversation) AS INT) AS place FROM (SELECT any_value(message_id) FILTER (pos = 1) AS first_id, conversation, count(*) AS message_count, count(*) FILTER (role = 'customer_message') AS customer_message_count, count(*) FILTER (role = 'brand_response') AS brand_response_count, bool_or(role = 'customer_message') AND bool_or(role = 'brand_response') AS usable FROM talks GROUP BY conversation)",
    "component_stats": MSG + EDGES + ", talk AS (SELECT component, role FROM msg JOIN comp ON node = CAST(message_id AS BIGINT)) SELECT count(*) AS n_conversations, round(avg(n), 6) AS mean_length, CAST(median(n) AS DOUBLE) AS median_length, max(n) AS max_length, count(*) FILTER (c > 0 AND b > 0) AS n_usable FROM (SELECT count(*) AS n, count(*) FILTER (role = 'customer_message') AS c, count(*) FILTER (role = 'brand_response') AS b FROM talk GROUP BY component)",
    "pool_select": FILTERED + " SELECT message_id, bucket, intent, CAST(pool_rank AS INT) AS pool_rank FROM pool",
    "quality_rejections": FILTERED + " SELECT bucket, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM filtered GROUP BY ALL",
    "replacement_pairs": FILTERED + """,
turns(bucket, intent, j, waiting, accepted, paired, rejected, replacement_id) AS (SELECT DISTINCT bucket, intent, 0::BIGINT, []::VARCHAR[], 0, 0, NULL::VARCHAR, NULL::VARCHAR FROM filtered
    UNION ALL SELECT t.bucket, t.intent, f.j, CASE WHEN f.reason IS NOT NULL THEN list_append(t.waiting, f.reason || '/' || f.message_id) WHEN len(t.waiting) > 0 AND t.paired < 10 THEN t.waiting[2:] ELSE t.waiting END,
    t.accepted + CASE WHEN f.reason IS NULL THEN 1 ELSE 0 END, t.paired + CASE WHEN f.reason IS NULL AND len(t.waiting) > 0 THEN 1 ELSE 0 END,
    CASE WHEN f.reason IS NULL AND len(t.waiting) > 0 AND t.paired < 10 THEN t.waiting[1] END, f.message_id
    FROM turns t JOIN filtered f ON f.bucket = t.bucket AND f.intent = t.intent AND f.j = t.j + 1 JOIN quota q ON q.bucket = t.bucket AND q.intent = t.intent WHERE t.accepted < q.quota)
SELECT bucket, intent, split_part(rejected, '/', 1) AS reason, split_part(rejected, '/', 2) AS rejected_id, replacement_id FROM turns WHERE rejected IS NOT NULL""",
    "golden_select": GOLD + " SELECT message_id, bucket, intent, CAST(golden_rank AS INT) AS golden_rank FROM chosen JOIN pooled USING (place)",
    "selection_sizes": GOLD + " SELECT q.bucket, q.intent, CAST(q.quota AS BIGINT) AS wanted, count(c.place) AS selected, count(c.place) = q.quota AS met FROM part q LEFT JOIN (SELECT turn, place FROM chosen JOIN pooled USING (place)) c ON c.turn = q.turn GROUP BY q.bucket, q.intent, q.quota",
    "judge_replies": MSG + " SELECT message_id, CAST(turn % 5 + 1 AS INT) AS relevance, turn % 2 = 0 AS acceptable FROM msg",
    "csv_scan": MSG + """ SELECT message_id, author_id, coalesce(parent_ids, '') AS parent_ids, md5(text || chr(10) || 'said "so", twice') AS text_md5 FROM msg""",
    "sorted_jsonl": MSG + """ SELECT '{"message_id":"' || message_id || '","parent_ids":' || coalesce('"' || parent_ids || '"', 'null') || ',"role":"' || role || '"}' AS line FROM msg""",
    "corrupt_records": MSG + """, entry AS (SELECT conversation_id % 7 = 2 AS bad, message_id, turn, '{"message_id": "' || message_id || '", "turn": ' || turn || '}' AS whole FROM msg) SELECT CASE WHEN bad THEN 'bad' ELSE 'row' END AS kind, CASE WHEN bad THEN substr(whole, 1, 15) ELSE message_id || '/' || turn END AS what FROM entry""",
    "digest_is_stable": "SELECT true AS copy_equal, false AS lacking_equal",
    "near_dup_pairs": CLS + f", s AS (SELECT message_id AS id, {content("text")} AS t FROM cls) SELECT a.id AS left_id, b.id AS right_id, CAST(len(list_intersect(a.t, b.t)) AS INT) AS shared FROM s a JOIN s b ON a.id < b.id WHERE len(a.t) >= 6 AND len(b.t) >= 6 AND len(list_intersect(a.t, b.t)) >= 4 AND len(list_intersect(a.t, b.t)) >= 0.7 * least(len(a.t), len(b.t))",
    "near_dup_links": CLS + f""", s AS (SELECT message_id AS id, {content("text")} AS t FROM cls), long AS (SELECT id, list_sort(t) AS t FROM s WHERE len(t) >= 6)
SELECT a.id AS message_id, (SELECT min(c.id) FROM long c WHERE c.t = a.t) AS set_id, count(b.id) AS n_links
FROM long a LEFT JOIN long b ON a.id <> b.id AND len(list_intersect(a.t, b.t)) >= 4 AND len(list_intersect(a.t, b.t)) >= 0.7 * least(len(a.t), len(b.t)) GROUP BY a.id, a.t""",
    "overlap_score": CLS + f", o AS (SELECT message_id, list_distinct({words("text")}) AS a, list_distinct({words("response")}) AS b FROM cls0 WHERE response IS NOT NULL) SELECT message_id, round({overlap("a", "b")}, 9) AS overlap FROM o",
    "bucket_rank": RANKED + " SELECT message_id, bucket, CAST(bucket_rank AS INT) AS bucket_rank FROM ranked",
    "quota_allocation": CLS + ", c AS (SELECT prim AS intent_id, count(*) AS n FROM cls WHERE bucket = 'primary_intent' GROUP BY prim), r AS (SELECT *, n / sum(n) OVER () * 52 AS raw FROM c), f AS (SELECT *, floor(raw) AS q FROM r) SELECT intent_id, n, CAST(q + CASE WHEN row_number() OVER (ORDER BY raw - q DESC, n, intent_id DESC) <= 52 - sum(q) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f",
    "difficulty_tags": TAGS + " SELECT message_id, array_to_string(tags, ',') AS tags FROM tagged",
    "tag_counts": TAGS + " SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY tag",
    "golden_rank": TAGS + " SELECT message_id, bucket, CAST(golden_rank AS INT) AS golden_rank FROM golden",
    "golden_ids": GOLD + f" SELECT printf('GS-%03d', row_number() OVER (ORDER BY bucket, coalesce(prim, ''), {TIME} NULLS FIRST, message_id)) AS golden_id, message_id, CAST(row_number() OVER (ORDER BY bucket, coalesce(prim, ''), {TIME} NULLS FIRST, message_id) AS INT) AS number FROM chosen JOIN pooled USING (place)",
    "human_sample": CLS + f" SELECT message_id FROM cls ORDER BY md5(concat('{R.SAMPLE_SEED}:', message_id)), message_id LIMIT 30",
    "prelim_annotation": NOTE + " SELECT message_id, label, confidence, review_reasons, review_required FROM note",
    "escalation_prelim": NOTE + " SELECT message_id, risks, escalate FROM note",
    "review_queue": NOTE + " SELECT message_id, bucket, review_reasons FROM note WHERE review_required",
    "collect_context": NOTE + " SELECT n.message_id AS target_id, m.message_id, m.role FROM note n JOIN msg m USING (conversation_id) WHERE n.review_required AND n.bucket = 'ambiguous'",
    "resolve_intent": NOTE + " SELECT message_id, resolved_intent, status, resolved_confidence FROM resolved",
    "escalation_context": NOTE + f""", talk AS (SELECT r.message_id, r.status, r.resolved_confidence, {squeeze("lower(any_value(r.text) || ' ' || string_agg(c.text, ' ' ORDER BY c.pos))")} AS low FROM resolved r JOIN cls c USING (conversation_id) GROUP BY r.message_id, r.status, r.resolved_confidence),
risk AS (SELECT *, {RISKS} AS risks FROM talk)
SELECT message_id, risks, CASE WHEN risks <> '' AND status LIKE 'resolved%' THEN true WHEN status NOT LIKE 'resolved%' OR resolved_confidence = 'low' THEN NULL ELSE false END AS escalate FROM risk""",
    "gold_response": CLS + f""", g AS (SELECT message_id, response_id, coalesce(response, '') AS r, len(list_intersect({review("text")}, {review("response")})) AS shared FROM cls0)
SELECT message_id, CAST(shared AS INT) AS shared_tokens, CASE WHEN response_id IS NOT NULL AND NOT (len(r) < 30 OR (regexp_matches(lower(r), {GENERIC}) AND shared < 2) OR (shared = 0 AND NOT contains(r, '?'))) THEN response_id END AS gold_response_id FROM g""",
    "annotated_golden": NOTE + " SELECT n.message_id, CASE WHEN n.review_required THEN r.resolved_intent ELSE n.label END AS gold_intent, CASE WHEN n.review_required THEN r.status ELSE 'inherited' END AS annotation_status FROM note n LEFT JOIN resolved r USING (message_id)",
    "retrieval_corpus": CLS + " SELECT printf('hist_%06d', CAST(message_id AS BIGINT)) AS corpus_id, message_id, response_id, conversation_length, array_to_string(ids, ',') AS intents, prim AS primary_intent FROM cls",
    "tfidf_weights": FIND + " SELECT message_id AS id, count(*) AS n_tokens, round(sqrt(sum(w * w)), 9) AS norm FROM weight GROUP BY message_id",
    "tfidf_topk": FIND + " SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM found",
    "retrieval_failures": FIND + " SELECT query_id FROM rows WHERE rank IS NULL",
    "eligibility": FIND + " SELECT count(*) AS queries, count(gold_intent) AS eligible FROM asked",
    "retrieval_summary": FIND + " SELECT * FROM quality, means",
    "hit_at_k": FIND + " SELECT eligible, hit_at_1, hit_at_3, hit_at_5 FROM quality",
    "mrr": FIND + " SELECT mrr FROM quality",
    "similarity_avgs": FIND + " SELECT mean_top, mean_all FROM means",
    "evidence_score": FIND + f" SELECT query_id, CAST(coalesce(rank, 0) AS INT) AS rank, evidence_score, response_type, strength, {FLAGS} AS flags FROM ev",
    "evidence_hist": FIND + " SELECT strength, response_type, count(*) AS n FROM ev GROUP BY ALL",
    "evidence_summary": FIND + " SELECT count(*) AS candidates, round(avg(evidence_score), 6) AS mean_score, count(*) FILTER (available) AS available FROM ev",
    "coverage_at_k": FIND + " SELECT round(avg(c1), 6) AS coverage_at_1, round(avg(c3), 6) AS coverage_at_3, round(avg(c5), 6) AS coverage_at_5 FROM (SELECT " + ", ".join(f"max(CASE WHEN available AND rank <= {k} THEN 1 ELSE 0 END) AS c{k}" for k in (1, 3, 5)) + " FROM ev WHERE gold_intent IS NOT NULL GROUP BY query_id)",
    "usable_evidence": FIND + " SELECT query_id, CAST(rank AS INT) AS rank FROM usable",
    "anti_join_no_response": FIND + " SELECT message_id FROM asked WHERE message_id NOT IN (SELECT query_id FROM usable)",
    "grounded_response": FIND + " SELECT query_id, doc_id, evidence_score, response_type FROM ground",
    "decision": FIND + " SELECT query_id, doc_id, CASE WHEN reason IS NULL THEN 'auto_handle' ELSE 'escalate' END AS decision, reason AS escalation_reason, CASE WHEN reason IS NULL THEN response END AS generated_response FROM decide",
    "decision_summary": FIND + " SELECT CASE WHEN reason IS NULL THEN 'auto_handle' ELSE 'escalate' END AS decision, coalesce(reason, 'none') AS reason, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM decide GROUP BY ALL",
    "trivial_baseline": FIND + " SELECT md5(response) AS response_md5, n FROM (SELECT response, count(*) AS n, min((query_id, rank)) AS first_at FROM rows WHERE trim(coalesce(response, '')) <> '' GROUP BY response) ORDER BY n DESC, first_at LIMIT 1",
    "simple_baseline": FIND + " SELECT count(*) AS queries, count(*) FILTER (gold_intent IS NOT NULL AND hit) AS agreeing, round(100 * count(*) FILTER (gold_intent IS NOT NULL AND hit) / count(*) FILTER (gold_intent IS NOT NULL), 2) AS percentage FROM rows WHERE rank = 1",
    "baseline_compare": FIND + " SELECT a.message_id AS query_id, f.doc_id AS top_id, g.doc_id AS grounded_id FROM asked a LEFT JOIN found f ON f.query_id = a.message_id AND f.rank = 1 LEFT JOIN ground g ON g.query_id = a.message_id",
    "reference_agreement": FIND + f", r AS (SELECT d.reason IS NOT NULL AS decided, CASE WHEN {RISKS} <> '' THEN true WHEN c.bucket = 'primary_intent' AND evidence_strength >= 2 THEN false END AS reference FROM decide d JOIN cls c ON c.message_id = d.query_id) SELECT count(*) AS total, count(reference) AS comparable, count(*) FILTER (reference = decided) AS agreed, round(100 * count(*) FILTER (reference = decided) / count(reference), 2) AS percentage FROM r",
    "agreement": "SELECT count(*) AS n, round(avg(abs(h - j)), 6) AS mean_absolute_error, round(avg(CAST(h = j AS INT)), 6) AS exact, round(avg(CAST(abs(h - j) <= 1 AS INT)), 6) AS within_one, round(corr(h, j), 6) AS pearson FROM (SELECT CAST(quality AS DOUBLE) AS h, CAST(n_chars > 500 AS DOUBLE) AS j FROM labels JOIN documents USING (doc_id))",
    "proof_checks": FIND + " SELECT true AS consistent, count(*) = count(DISTINCT query_id) AS unique_ids, bool_or(reason IS NULL) AS any_auto FROM decide",
    "except_keys": "(SELECT doc_id, 'unlabelled' AS side FROM documents EXCEPT ALL SELECT doc_id, 'unlabelled' FROM labels) UNION ALL (SELECT doc_id, 'unknown' FROM labels EXCEPT ALL SELECT doc_id, 'unknown' FROM documents)",
    "union_strata": RANKED + f" SELECT message_id, bucket, CAST(bucket_rank AS INT) AS bucket_rank FROM ranked JOIN (VALUES {POOL}) AS q(b, k) ON b = bucket WHERE bucket_rank <= k",
    "jsonl_roundtrip": MSG + " SELECT conversation_id, count(*) AS message_count, CAST(count(*) AS INT) AS n FROM msg GROUP BY conversation_id",
}
ORACLE_SQL["brand_ranking"] = f"SELECT CAST(row_number() OVER (ORDER BY eligible DESC, score DESC, issues DESC, brand) AS INT) AS rank, brand FROM ({ORACLE_SQL['brand_score']})"
ORACLE_SQL["human_sheet"] = FIND + f", sample AS (SELECT * FROM decide ORDER BY md5(concat('{R.SAMPLE_SEED}:', query_id)), query_id LIMIT 30) SELECT query_id, query AS customer_message, coalesce(response, '') AS historical_evidence, CASE WHEN reason IS NULL THEN coalesce(response, '') ELSE '' END AS generated_response, CASE WHEN reason IS NULL THEN 'auto_handle' ELSE 'escalate' END AS decision, count(*) OVER () AS unfilled FROM sample"
ORACLE_SQL["summary_document"] = FIND + " SELECT count(*) AS queries, count(*) FILTER (reason IS NULL) AS auto_handle, count(*) FILTER (reason IS NOT NULL) AS escalate, round(100 * count(*) FILTER (reason IS NULL) / count(*), 2) AS auto_handle_percentage FROM decide"
ORACLE_SQL["result_array"] = FIND + f" SELECT query_id, CASE WHEN reason IS NULL THEN 'auto_handle' ELSE 'escalate' END AS decision, CASE WHEN {RISKS} <> '' THEN true WHEN c.bucket = 'primary_intent' AND evidence_strength >= 2 THEN false END AS reference, reason IS NULL AND d.response IS NOT NULL AS answered FROM decide d JOIN cls c ON c.message_id = d.query_id"
ORACLE_SQL["intent_volumes"] = CLS + f" SELECT CAST(date_trunc('hour', {TIME}) AS VARCHAR) AS begins, prim AS intent_id, count(*) AS n FROM cls WHERE {TIME} IS NOT NULL GROUP BY ALL"
SPOKEN = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
ORACLE_SQL["judge_stub"] = FIND + f", graded AS (SELECT query_id, 1 + least(4, len(list_intersect({SPOKEN.format("coalesce(query, '')")}, {SPOKEN.format("CASE WHEN reason IS NULL THEN coalesce(response, '') ELSE '' END")}))) AS grade FROM decide) SELECT query_id, CAST(grade AS INT) AS relevance, CAST(grade AS INT) AS grounding, CAST(grade AS INT) AS quality, true AS escalation_correct, grade >= 3 AS acceptable FROM graded"
ORACLE_SQL["stale_labels"] = NOTE + """, came AS (SELECT *, CASE WHEN conversation_id % 5 = 0 THEN 'apple_watch' ELSE prim END AS stored FROM note),
told AS (SELECT *, CASE WHEN bucket = 'primary_intent' THEN stored ELSE label END AS given FROM came)
SELECT message_id, given AS label, confidence, array_to_string(list_concat(list_filter(reasons, lambda r: r <> 'label not among matches'),
    list_filter([CASE WHEN NOT list_contains(ids, given) THEN 'label not among matches' END, CASE WHEN bucket = 'primary_intent' AND stored <> prim THEN 'stored label differs from the text''s' END], lambda r: r IS NOT NULL)), '; ') AS review_reasons FROM told"""


def table_lines(title: str, source: str, columns: tuple[str, ...], order: str = "1") -> str:
    """SQL for the lines of a report's table of ``source``, a list; a null cell is empty."""
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"['## {title}', '', '| {' | '.join(columns)} |', '|{'---|' * len(columns)}'] || (SELECT list('| ' || concat_ws(' | ', {cells}) || ' |' ORDER BY {order}) FROM {source}) || ['']"


#: The report's lines, its texts written out.
ORACLE_SQL["final_report"] = ORACLE_SQL["reference_agreement"].replace(" SELECT count(*) AS total,", ", told_shared AS (SELECT count(*) AS total,", 1) + f"""),
told_found AS (SELECT * FROM quality, means), told_decided AS ({ORACLE_SQL["decision_summary"].removeprefix(FIND)}), told_base AS ({ORACLE_SQL["simple_baseline"].removeprefix(FIND)}),
told AS (SELECT ['# Evaluation', ''] || {table_lines("Retrieval", "told_found", ("eligible", "hit_at_1", "hit_at_3", "hit_at_5", "mrr", "queries", "failures", "mean_top", "mean_all"))}
    || {table_lines("Decisions", "told_decided", ("decision", "reason", "n", "percentage"), "decision, reason")} || {table_lines("Baseline: the nearest message''s response as it is", "told_base", ("queries", "agreeing", "percentage"))}
    || {table_lines("Agreement with the rule-based reference", "told_shared", ("total", "comparable", "agreed", "percentage"))}
    || ['## What this does not say', '', 'The reference is made by rules, so agreement with it is no accuracy, and agreement of intents is no quality of responses.', '',
        '## Grades by people and by the judge', '', 'Pending: nobody has filled in the sheet.'] AS lines)
SELECT CAST(place AS INT) AS place, line FROM (SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM told)"""
ORACLE_SQL["missing_columns"] = MSG + " SELECT dropped, dropped <> 'none' AS refused, CASE WHEN dropped = 'none' THEN (SELECT count(*) FROM msg) END AS rows FROM (VALUES " + ", ".join(f"('{c}')" for c in ("message_id", "author_id", "inbound", "created_at", "text", "response_ids", "parent_ids", "none")) + ") AS t(dropped)"
ORACLE_SQL["written_bytes"] = MSG + " SELECT role, CAST(sum(strlen(concat_ws(' ', message_id, text)) + 1) AS BIGINT) AS bytes FROM msg GROUP BY role"
