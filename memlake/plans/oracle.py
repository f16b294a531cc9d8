"""SQL counterparts of the registered queries, for an engine other than Spark.

Each text stands alone over the same tables.  They are written from the
operators' definitions: ordered loops as window frames, lists as row sets.
"""

from __future__ import annotations

# Fixed values, written out so that these texts depend on nothing they check: the object-identifier namespace, the gate
# (pattern, verdict, reason) and the slots (pattern, tier, slot), in the order they are tried.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"
GATE = [
    (r"^(hi|hello|hey|thanks|thank you|good (morning|evening|night)|bye)\b", "drop", "chitchat"),
    (r"^how are you\b", "drop", "chitchat"),
    (r"\b(right now|at the moment)\b", "drop", "temporary state"),
    (r"\bi('m| am) (hungry|tired|sleepy|bored|driving|going to)\b", "drop", "temporary state"),
    (r"^(please )?(write|fix|explain|translate|summari[sz]e|help me)\b", "drop", "task"),
    (r"\bhere is my code\b", "drop", "task"),
    (r"^(that's|that is) (cool|nice|great)\b", "drop", "vague"),
    (r"^i like (that|it|this)[.!?]*$", "drop", "vague"),
    (r"\bmy name is\b", "keep", "biographical"),
    (r"\bi('m| am) [0-9]+( years old)?\b", "keep", "biographical"),
    (r"\bi live in\b", "keep", "biographical"),
    (r"\bi work as\b", "keep", "biographical"),
    (r"\bi('m| am) (a|an) (man|woman|non-binary)\b", "keep", "biographical"),
    (r"\bi have a (dog|cat|bird|pet)\b", "keep", "biographical"),
    (r"\b(always|never) (answer|reply|use|call)\b", "keep", "preference"),
    (r"\bi (prefer|like|love|hate|dislike)\b", "keep", "preference"),
    (r"\bi (code|program) in\b", "keep", "project"),
    (r"\bi('m| am) (building|writing|working on)\b", "keep", "project"),
]
SLOTS = [
    (r"\bmy name is ([\p{L}\p{N}][\p{L}\p{N} '-]*)", "core", "name"),
    (r"\bi(?:'m| am) ([0-9]+)(?: years old)?\b", "core", "age"),
    (r"\bi(?:'m| am) (?:a|an) (man|woman|non-binary)\b", "core", "gender"),
    (r"\bi live in ([\p{L}\p{N}][\p{L}\p{N} '-]*)", "core", "location"),
    (r"\bi work as (?:a |an )?([\p{L}\p{N}][\p{L}\p{N} '-]*)", "core", "profession"),
    (r"\b((?:always|never) (?:answer|reply|use|call)\b[^.!?]*)", "core", "instruction"),
    (r"\bi(?:'m| am) (?:building|writing|working on) ([^.!?]+)", "general", "project"),
    (r"\bi (?:code|program) in ([^.!?]+)", "general", "skill"),
    (r"\bi have a ((?:dog|cat|bird|pet)\b[^.!?]*)", "general", "pet"),
    (r"\bi ((?:prefer|like|love|hate|dislike) [^.!?]+)", "general", "taste"),
]


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('{OID_NAMESPACE}') || encode({name}))"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab') || "
        f"substr({h},18,3) || '-' || substr({h},21,12))"
    )


def _trim(x: str) -> str:
    ws = r"[\s\x{0B}\x{85}\p{Z}]"
    return f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"


def _user_key(x: str) -> str:
    return f"'u' || {x}"


_SENT = r"[^.!?]+[.!?]+(\s|$)"

_TURNS = """turns AS (
  SELECT 'u' || (conv_id // 5) AS user_id, conv_id, turn, role, text AS content,
         'r' || conv_id AS req_id, conv_id AS seq
  FROM conversations)"""

_JOBS = _TURNS + """, jobs AS (
  SELECT req_id, user_id, seq, conv_id, count(*) AS n,
         list({'role': role, 'content': content} ORDER BY turn) AS messages
  FROM turns GROUP BY req_id, user_id, seq, conv_id)"""


def _units(src: str, keys: str) -> str:
    """Trimmed sentence rows (keys, s, pos) of ``content`` in ``src``."""
    return f"""(
  SELECT {keys}, unnest(list_transform(ss, lambda x: {_trim('x')})) AS s,
         unnest(range(len(ss))) AS pos
  FROM (SELECT {keys}, CASE WHEN len(regexp_extract_all(c, '{_SENT}')) = 0 THEN [c]
                            ELSE regexp_extract_all(c, '{_SENT}') END AS ss
        FROM (SELECT {keys}, {_trim('content')} AS c FROM {src}) WHERE c <> ''))"""


_CONTEXT = _JOBS + f""", unit AS {_units('turns', 'req_id, turn')},
run AS (
  SELECT *, sum(strlen(s)) OVER (PARTITION BY req_id ORDER BY turn DESC, pos DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer FROM unit),
line AS (
  SELECT req_id, turn, string_agg(s, ' ' ORDER BY pos) AS l FROM run
  WHERE newer IS NULL OR newer < 500 GROUP BY req_id, turn),
ctx AS (
  SELECT jobs.req_id, coalesce(any_value(c.q), '') AS q FROM jobs LEFT JOIN
    (SELECT req_id, string_agg(l, chr(10) ORDER BY turn) AS q FROM line GROUP BY req_id) c
    ON c.req_id = jobs.req_id GROUP BY jobs.req_id)"""


def _postings(src: str, id_col: str, text_col: str) -> str:
    return f"""(
  SELECT id, idx, (1 + ln(count(*)))::FLOAT AS w FROM (
    SELECT id, ('0x' || substr(md5(t), 1, 8))::UBIGINT::BIGINT AS idx FROM (
      SELECT {id_col} AS id, unnest(string_split_regex(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+')) AS t
      FROM {src}) WHERE t <> '')
  GROUP BY id, idx)"""


_DOCS = f"""docs AS (
  SELECT doc_id, user_id, {_uuid5('text || user_id')} AS memory_id, text AS memory_text FROM (
    SELECT *, 'u' || (doc_id % (SELECT max(conv_id) // 5 + 1 FROM conversations)) AS user_id
    FROM documents))"""

_MEMS = _DOCS + """, mems AS (
  SELECT * FROM docs WHERE doc_id IN (
    SELECT max(doc_id) FROM docs GROUP BY user_id, memory_id))"""

_SEARCH = f"""WITH {_CONTEXT}, {_MEMS},
qpost AS {_postings('ctx', 'req_id', 'q')},
mpost AS {_postings('mems', 'doc_id', 'memory_text')},
dense_pairs AS (
  SELECT j.req_id AS query_id, j.user_id, m.memory_id,
         list_dot_product(eq.embedding::DOUBLE[], em.embedding::DOUBLE[])
         / sqrt(list_dot_product(eq.embedding::DOUBLE[], eq.embedding::DOUBLE[]))
         / sqrt(list_dot_product(em.embedding::DOUBLE[], em.embedding::DOUBLE[])) AS score
  FROM jobs j JOIN embeddings eq ON eq.vec_id = j.conv_id
  JOIN mems m ON m.user_id = j.user_id JOIN embeddings em ON em.vec_id = m.doc_id),
sparse_pairs AS (
  SELECT j.req_id AS query_id, j.user_id, m.memory_id,
         sum(a.w::DOUBLE * b.w::DOUBLE) AS score
  FROM jobs j JOIN qpost a ON a.id = j.req_id
  JOIN mems m ON m.user_id = j.user_id
  JOIN mpost b ON b.id = m.doc_id AND b.idx = a.idx
  GROUP BY j.req_id, j.user_id, m.memory_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY branch, query_id
            ORDER BY round(score, 9) DESC, memory_id) AS rank
  FROM (SELECT 'dense' AS branch, * FROM dense_pairs
        UNION ALL SELECT 'sparse' AS branch, * FROM sparse_pairs)),
lists AS (SELECT * FROM ranked WHERE rank <= 10),
summed AS (
  SELECT query_id, user_id, memory_id, sum(1.0::DOUBLE / (rank - 1 + 2)) AS score
  FROM lists GROUP BY query_id, user_id, memory_id),
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
              ORDER BY round(score, 9) DESC, memory_id) AS rank FROM summed)
  WHERE rank <= 10),
hits AS (SELECT * FROM fused WHERE score >= 0.65)"""

_RANKED = "SELECT query_id, user_id, memory_id, round(score, 6) AS score, rank FROM "

_EVENTS = """ev AS (
  SELECT event_id, 'u' || user_id AS user_id, event_type, value,
         json_extract(props, '$.k')::BIGINT AS k,
         'ru' || user_id || '-' || (event_id // 10) AS req_id,
         event_id // 10 AS seq, event_id % 10 AS pos
  FROM events)"""

_CORE = _EVENTS + f""", core AS (
  SELECT user_id, {_uuid5("'core:' || event_id")} AS memory_id,
         'Signed up for plan ' || k AS memory_text, event_id AS ord, 0 AS ord_pos,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place
  FROM ev WHERE event_type = 'signup'),
ncore AS (SELECT user_id, count(*) AS n_core FROM core GROUP BY user_id)"""

_BASE = _EVENTS + f""", base AS (
  SELECT DISTINCT user_id, {_uuid5("'fact ' || k || user_id")} AS memory_id,
         'fact ' || k AS memory_text
  FROM ev WHERE event_type = 'signup')"""

_RAW = _EVENTS + """, raw AS (
  SELECT req_id, user_id, seq,
         CASE WHEN event_type IN ('signup', 'error') THEN 'core' ELSE 'general' END AS tier,
         event_id,
         CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'click' THEN 'UPDATE' ELSE 'INSERT' END
           AS action_type,
         CASE WHEN event_type <> 'error' AND NOT (event_type = 'view' AND value < 10)
              THEN 'fact ' || k END AS payload,
         CASE WHEN event_type = 'error' AND value < 95
              THEN (floor(value / 2)::BIGINT)::VARCHAR END AS target_memory_id
  FROM ev), valid AS (
  SELECT *, CASE WHEN action_type NOT IN ('INSERT', 'DELETE') THEN 'ignored'
                 WHEN action_type = 'INSERT' AND payload IS NULL THEN 'invalid'
                 WHEN action_type = 'DELETE' AND target_memory_id IS NULL THEN 'invalid'
                 ELSE 'ok' END AS verdict FROM raw)"""

_STATEMENTS = _EVENTS + """, statements AS (
  SELECT *, CASE event_type
    WHEN 'signup' THEN 'I live in City ' || k || '.'
    WHEN 'purchase' THEN 'I am building project ' || k || '!'
    WHEN 'click' THEN 'I prefer option ' || k || '.'
    WHEN 'view' THEN 'Hello there!'
    ELSE 'Fix my code ' || k || '.' END AS content,
    row_number() OVER (PARTITION BY req_id ORDER BY event_id) - 1 AS turn
  FROM ev)"""

_SPOKEN = (
    _TURNS + ", " + _STATEMENTS + f""", said AS (
  SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY turn) - 1 AS turn, role, content
  FROM turns
  UNION ALL SELECT req_id, turn, 'user', content FROM statements),
spoken AS (
  SELECT req_id, turn, pos, s AS sentence, lower(s) AS low
  FROM {_units("said WHERE role = 'user'", 'req_id, turn')})"""
)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(rules: list, value) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(low, {_quote(r[0])}) THEN {value(r)}" for r in rules
    )
    return f"CASE {arms} END"


_GATE = _case(GATE, lambda r: _quote(f"{r[1]}:{r[2]}"))
_SLOT = _case(SLOTS, lambda r: _quote(f"{r[1]}:{r[2]}"))
_VALUE = _case(SLOTS, lambda r: f"trim(regexp_extract(low, {_quote(r[0])}, 1))")

_FACTS = _EVENTS + """, facts AS (
  SELECT *, event_type AS slot, k::VARCHAR AS value_, event_type || ': ' || k AS memory_text
  FROM ev), cut AS (SELECT floor(count(*) / 2) AS half FROM events)"""

ORACLE: dict[str, str] = {}

# -- sources ------------------------------------------------------------------

ORACLE["decode_jobs"] = f"""WITH {_JOBS}, d AS (
  SELECT *, CASE WHEN n = 2 THEN 'not JSON' WHEN messages[1].role = 'system' THEN 'not an object' END
    AS reason FROM jobs)
SELECT CASE WHEN reason IS NULL THEN req_id END AS req_id,
       CASE WHEN reason IS NULL THEN user_id END AS user_id,
       CASE WHEN reason IS NULL THEN n END AS n_messages,
       CASE WHEN reason IS NULL THEN messages[1].content END AS opening,
       CASE WHEN reason IS NULL THEN 0.6::DOUBLE END AS threshold, reason FROM d"""

ORACLE["emit_jobs"] = f"""WITH {_JOBS}, e AS (SELECT *, {_uuid5('req_id')} AS id FROM jobs)
SELECT id AS req_id, user_id, to_json({{'ReqId': id, 'UserId': user_id, 'Messages': messages,
       'Threshold': 0.6::DOUBLE}})::VARCHAR AS value FROM e"""

ORACLE["attach_dense"] = f"""WITH {_DOCS}
SELECT d.doc_id, d.memory_id, coalesce(len(e.embedding), 0) AS dim,
       round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS length
FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""

# -- requests and context -----------------------------------------------------

ORACLE["stamp_requests"] = """SELECT event_id, 'u' || user_id AS user_id,
  CASE WHEN event_type IN ('error', 'view') OR value / 500 = 0 THEN 0.65::DOUBLE
       ELSE round(value / 500, 6) END AS threshold FROM events"""

ORACLE["clean_user_keys"] = """SELECT event_id,
  CASE WHEN event_type = 'error' THEN '' ELSE 'u' || user_id END AS user_id,
  CASE WHEN event_type = 'error' THEN 'empty user key' END AS reason FROM events"""

ORACLE["resolve_query_text"] = f"""WITH {_CONTEXT}
SELECT jobs.req_id, user_id,
  CASE WHEN messages[1].role = 'system' THEN 'error' WHEN n > 3 THEN 'messages'
       WHEN n = 2 AND messages[1].content <> '' THEN 'query' ELSE 'none' END AS status,
  CASE WHEN messages[1].role = 'system' THEN NULL WHEN n > 3 THEN q
       WHEN n = 2 AND messages[1].content <> '' THEN messages[1].content END AS query_text
FROM jobs JOIN ctx ON ctx.req_id = jobs.req_id"""

ORACLE["explode_turns"] = f"""WITH {_TURNS}
SELECT req_id, user_id, row_number() OVER (PARTITION BY req_id ORDER BY turn) - 1 AS turn,
       role, content FROM turns"""

ORACLE["transcript"] = f"""WITH {_TURNS}
SELECT req_id, coalesce(string_agg(
  CASE role WHEN 'user' THEN 'User: ' WHEN 'model' THEN 'Assistant: '
            WHEN 'assistant' THEN 'Assistant: ' WHEN 'system' THEN 'System: ' END
  || content || chr(10), '' ORDER BY turn), '') AS transcript FROM turns GROUP BY req_id"""

ORACLE["context_query"] = f"WITH {_CONTEXT} SELECT req_id, q AS context_query FROM ctx"

ORACLE["fallback_query"] = f"""WITH {_TURNS}, c AS (
  SELECT *, strlen(content) AS size,
         sum(strlen(content) + 1) OVER (PARTITION BY req_id ORDER BY turn DESC) AS total FROM turns),
f AS (
  SELECT *, max(total + size) OVER (PARTITION BY req_id ORDER BY turn DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM c)
SELECT req_id, string_agg(content || chr(10), '' ORDER BY turn DESC) AS fallback_query
FROM f WHERE peak IS NULL OR peak <= 2000 GROUP BY req_id"""

ORACLE["last_user_turn"] = f"""WITH {_TURNS}
SELECT req_id, coalesce(max_by(content, turn) FILTER (WHERE role = 'user'), '') AS last_user_turn,
       count(*) FILTER (WHERE role = 'user') > 0 AS found FROM turns GROUP BY req_id"""

ORACLE["skip_gate"] = f"""WITH {_JOBS}
SELECT req_id, CASE WHEN n = 2 THEN false WHEN n = 3 THEN true
  ELSE lower(messages[1].content) <> 'skip' END AS required FROM jobs"""

# -- encoding -----------------------------------------------------------------

ORACLE["sparse_encode"] = f"""SELECT id AS doc_id, idx, round(w::DOUBLE, 5) AS w
FROM {_postings('documents', 'doc_id', 'text')}"""

ORACLE["sparse_encode_idf"] = f"""WITH p AS {_postings('documents', 'doc_id', 'text')},
f AS (SELECT idx, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM p GROUP BY idx),
x AS (SELECT p.id, (p.w * f.idf)::FLOAT::DOUBLE AS w FROM p JOIN f ON f.idx = p.idx),
n AS (SELECT id, sqrt(sum(w * w)) AS length FROM x GROUP BY id)
SELECT x.id AS doc_id, count(*) AS n_terms, round(sum((w / length)::FLOAT::DOUBLE), 4) AS total
FROM x JOIN n ON n.id = x.id GROUP BY x.id"""

ORACLE["encode_plugin"] = f"""WITH p AS {_postings('documents', 'doc_id', 'text')},
b AS (SELECT id, sum(w::DOUBLE)::FLOAT::DOUBLE AS d, count(*) AS n, sum(w::DOUBLE) AS s
      FROM p GROUP BY id, idx % 64)
SELECT d.doc_id, 64 AS dim, round(coalesce(sum(b.d), 0), 3) AS dense_total,
       coalesce(sum(n), 0)::BIGINT AS n_terms, round(coalesce(sum(b.s), 0), 3) AS sparse_total
FROM documents d LEFT JOIN b ON b.id = d.doc_id GROUP BY d.doc_id"""

ORACLE["isolated_failure"] = f"""WITH p AS {_postings('documents', 'doc_id', 'text')},
b AS (SELECT id, count(*) AS n FROM p GROUP BY id)
SELECT d.doc_id, CASE WHEN bad THEN 'ValueError: address in text' END AS problem,
       CASE WHEN NOT bad THEN 64 END AS dim, CASE WHEN NOT bad THEN coalesce(n, 0) END AS n_terms
FROM (SELECT doc_id, contains(coalesce(text, ''), '@') AS bad FROM documents) d LEFT JOIN b ON b.id = d.doc_id"""

ORACLE["encode_check"] = """SELECT doc_id,
  CASE WHEN e.vec_id IS NULL THEN 'missing' ELSE 'wrong dimension' END AS problem
FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id
WHERE e.vec_id IS NULL OR len(e.embedding) <> 64"""

# -- retrieval ----------------------------------------------------------------

ORACLE["dense_topk"] = f"{_SEARCH} {_RANKED} lists WHERE branch = 'dense'"
ORACLE["sparse_topk"] = f"{_SEARCH} {_RANKED} lists WHERE branch = 'sparse'"
ORACLE["rrf_fuse"] = f"{_SEARCH} {_RANKED} fused"
ORACLE["score_cut"] = f"{_SEARCH} {_RANKED} hits"
ORACLE["hybrid_retrieve"] = f"""{_SEARCH}
SELECT h.query_id, h.user_id, h.rank, h.memory_id, m.memory_text, 'general' AS type,
       round(h.score, 6) AS score
FROM hits h JOIN mems m ON m.user_id = h.user_id AND m.memory_id = h.memory_id"""
ORACLE["retrieve_with_core"] = f"""{_SEARCH}, {_CORE}
SELECT j.req_id AS query_id, j.user_id, 0 AS tier_ord, c.ord, c.ord_pos, c.memory_id,
       c.memory_text, 'core' AS type
FROM jobs j JOIN core c ON c.user_id = j.user_id
UNION ALL
SELECT h.query_id, h.user_id, 1, h.rank, 0, h.memory_id, m.memory_text, 'general'
FROM hits h JOIN mems m ON m.user_id = h.user_id AND m.memory_id = h.memory_id"""
ORACLE["get_all_general"] = f"""WITH {_MEMS}
SELECT user_id, memory_id, memory_text, 'general' AS type FROM mems
WHERE user_id IN (SELECT 'u' || user_id FROM events)"""
ORACLE["get_core"] = f"""WITH {_CORE}
SELECT user_id, memory_id, memory_text, ord, ord_pos, 'core' AS type FROM core
WHERE user_id IN (SELECT 'u' || (conv_id // 5) FROM conversations)"""
ORACLE["get_all_memories"] = f"""WITH {_MEMS}, {_CORE}, asked AS (
  SELECT DISTINCT 'u' || (conv_id // 5) AS user_id FROM conversations)
SELECT user_id, 0 AS tier_ord, ord, ord_pos, memory_id, memory_text, 'core' AS type FROM core
WHERE user_id IN (SELECT user_id FROM asked)
UNION ALL SELECT user_id, 1, NULL, NULL, memory_id, memory_text, 'general' FROM mems
WHERE user_id IN (SELECT user_id FROM asked)"""
ORACLE["get_core_status"] = f"""WITH {_CORE}, asked AS (
  SELECT user_id FROM ev UNION SELECT 'u' || (conv_id // 5) FROM conversations)
SELECT a.user_id, coalesce(n_core, 0) AS n_core,
       CASE WHEN n_core > 0 THEN 'ok' ELSE 'User has no core memories!' END AS status
FROM asked a LEFT JOIN ncore n ON n.user_id = a.user_id"""
_ASKED = f""", asked AS (
  SELECT event_id AS request_id, user_id, {_uuid5("'fact ' || k || user_id")} AS memory_id
  FROM ev WHERE event_type = 'error'
  UNION ALL
  SELECT event_id, user_id, {_uuid5("'fact ' || (k + 1) || user_id")}
  FROM ev WHERE event_type = 'error')"""
ORACLE["ids_exist"] = f"""WITH {_BASE}{_ASKED}
SELECT request_id, user_id, memory_id,
       EXISTS (SELECT 1 FROM base b WHERE b.user_id = a.user_id AND b.memory_id = a.memory_id) AS found
FROM asked a"""

# -- curation -----------------------------------------------------------------

ORACLE["ordinal_map"] = f"""{_SEARCH}, {_CORE}
SELECT j.req_id, j.user_id, c.place::VARCHAR AS ordinal, c.memory_id, 'core' AS tier
FROM jobs j JOIN core c ON c.user_id = j.user_id
UNION ALL
SELECT h.query_id, h.user_id, (coalesce(n_core, 0) + h.rank - 1)::VARCHAR, h.memory_id, 'general'
FROM hits h LEFT JOIN ncore n ON n.user_id = h.user_id"""
ORACLE["build_prompts"] = f"""{_SEARCH}, {_CORE}, talk AS ({ORACLE["transcript"].replace("WITH " + _TURNS, "")}),
citem AS (SELECT user_id, place AS n, to_json({{'text': memory_text, 'type': 'core',
  'id': place::VARCHAR}})::VARCHAR AS item FROM core),
gitem AS (SELECT h.query_id AS req_id, h.rank - 1 AS n, to_json({{'text': m.memory_text,
  'type': 'general', 'id': (coalesce(n_core, 0) + h.rank - 1)::VARCHAR}})::VARCHAR AS item
  FROM hits h JOIN mems m ON m.user_id = h.user_id AND m.memory_id = h.memory_id
  LEFT JOIN ncore n ON n.user_id = h.user_id),
cpart AS (SELECT user_id, n // 1000 AS part, CASE WHEN n // 1000 = 0 THEN '[' ELSE ',' END
  || string_agg(item, ',' ORDER BY n) AS text FROM citem GROUP BY user_id, n // 1000),
gpart AS (SELECT req_id, n // 1000 AS part, CASE WHEN n // 1000 = 0 THEN '[' ELSE ',' END
  || string_agg(item, ',' ORDER BY n) AS text FROM gitem GROUP BY req_id, n // 1000)
SELECT req_id, 0 AS section, 0 AS part, '<EXISTING_CORE_MEMORIES> ' || chr(10) AS text FROM jobs
UNION ALL SELECT j.req_id, 1, part, text FROM jobs j JOIN cpart c ON c.user_id = j.user_id
UNION ALL SELECT j.req_id, 2, 0, CASE WHEN n_core > 0 THEN ']' ELSE 'null' END || chr(10)
  || ' </EXISTING_CORE_MEMORIES> ' || chr(10) || '<EXISTING_OLD_MEMORIES> ' || chr(10)
  FROM jobs j LEFT JOIN ncore c ON c.user_id = j.user_id
UNION ALL SELECT req_id, 3, part, text FROM gpart
UNION ALL SELECT j.req_id, 4, 0,
  CASE WHEN j.req_id IN (SELECT query_id FROM hits) THEN ']' ELSE 'null' END || chr(10)
  || ' </EXISTING_OLD_MEMORIES> ' || chr(10) || '<USER_INPUT> ' || chr(10) || t.transcript
  || chr(10) || ' </USER_INPUT>'
  FROM jobs j JOIN talk t ON t.req_id = j.req_id"""
ORACLE["parse_plans"] = f"""WITH {_RAW}
SELECT req_id, user_id, seq, tier,
       row_number() OVER (PARTITION BY req_id, tier ORDER BY event_id) - 1 AS pos,
       action_type, payload, target_memory_id FROM raw"""
ORACLE["validate_actions"] = f"""WITH {_RAW}
SELECT req_id, seq, tier, event_id, action_type, payload, target_memory_id, verdict FROM valid"""
ORACLE["resolve_targets"] = f"""WITH {_CORE}, {_RAW.replace(_EVENTS + ",", "")}, seen AS (
  SELECT req_id, {_uuid5("'fact ' || k || user_id")} AS memory_id,
         row_number() OVER (PARTITION BY req_id ORDER BY event_id) - 1 AS place FROM ev),
r AS (
  SELECT v.*, coalesce(c.memory_id, s.memory_id) AS target
  FROM valid v LEFT JOIN ncore n ON n.user_id = v.user_id
  LEFT JOIN core c ON c.user_id = v.user_id AND c.place::VARCHAR = v.target_memory_id
  LEFT JOIN seen s ON s.req_id = v.req_id
    AND (s.place + coalesce(n.n_core, 0))::VARCHAR = v.target_memory_id)
SELECT req_id, event_id, action_type,
       CASE WHEN action_type = 'DELETE' AND verdict = 'ok' AND target IS NULL THEN 'not_found'
            ELSE verdict END AS verdict,
       CASE WHEN action_type = 'DELETE' AND verdict = 'ok' THEN target END AS target_memory_id
FROM r"""
ORACLE["gatekeeper"] = f"""WITH {_SPOKEN}, g AS (
  SELECT *, coalesce({_GATE}, 'drop:no rule') AS gate FROM spoken)
SELECT req_id, turn, pos, sentence, gate LIKE 'keep:%' AS keep, split_part(gate, ':', 2) AS why FROM g"""
ORACLE["assign_slots"] = f"""WITH {_SPOKEN}, g AS (
  SELECT *, {_SLOT} AS place, {_VALUE} AS value FROM spoken)
SELECT req_id, turn, pos, split_part(place, ':', 1) AS tier, split_part(place, ':', 2) AS slot, value
FROM g WHERE place IS NOT NULL"""
ORACLE["resolve_conflicts"] = f"""WITH {_FACTS},
old AS (SELECT * FROM facts WHERE event_id < (SELECT half FROM cut)),
new AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY event_id DESC) AS n
    FROM facts WHERE event_id >= (SELECT half FROM cut)) WHERE n = 1)
SELECT new.req_id, new.user_id, new.slot, 'DELETE' AS action_type, NULL::VARCHAR AS payload,
       'e' || old.event_id AS target_memory_id
FROM old JOIN new ON new.user_id = old.user_id AND new.slot = old.slot AND new.value_ <> old.value_
UNION ALL
SELECT req_id, user_id, slot, 'INSERT', memory_text, NULL FROM new
WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.slot = new.slot
                  AND old.value_ = new.value_)"""
_NORM = (
    "regexp_replace(regexp_replace("
    + _trim("lower(memory_text)")
    + r", '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'), '[.!?]+$', '')"
)
ORACLE["suppress_duplicates"] = f"""WITH {_DOCS}, n AS (
  SELECT doc_id, user_id, memory_id, {_NORM} AS norm,
         doc_id IN (SELECT vec_id FROM embeddings) AS known FROM docs)
SELECT min(doc_id) AS doc_id, user_id, arg_min(memory_id, doc_id) AS memory_id FROM n
GROUP BY user_id, norm HAVING NOT bool_or(known)"""
ORACLE["suppress_near_duplicates"] = f"""{_SEARCH}
SELECT req_id AS fact_id, user_id FROM jobs WHERE NOT EXISTS (
  SELECT 1 FROM lists l WHERE l.query_id = jobs.req_id AND l.branch = 'dense' AND l.score >= 0.25)"""
ORACLE["plan_provider"] = f"""WITH {_STATEMENTS}, spoken AS (
  SELECT *, lower(content) AS low FROM statements WHERE event_type IN ('signup', 'purchase', 'click')),
s AS (
  SELECT *, {_SLOT} AS place, {_VALUE} AS v FROM spoken),
f AS (
  SELECT *, split_part(place, ':', 1) AS tier, split_part(place, ':', 2) || ': ' || v AS payload FROM s)
SELECT req_id, user_id, seq, tier, 'INSERT' AS action_type, payload FROM f WHERE tier = 'general'
UNION ALL SELECT req_id, user_id, seq, tier, 'INSERT', payload FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM f
  WHERE tier = 'core') WHERE n = 1"""

# -- state --------------------------------------------------------------------

ORACLE["memory_id"] = f"WITH {_DOCS} SELECT doc_id, user_id, memory_id FROM docs"
ORACLE["upsert_memories"] = f"""WITH {_MEMS}
SELECT user_id, memory_id, doc_id, strlen(memory_text) AS n_bytes FROM mems"""
ORACLE["apply_general"] = f"""WITH {_BASE}, ops AS (
  SELECT user_id, {_uuid5("'fact ' || k || user_id")} AS memory_id, 'fact ' || k AS memory_text,
         event_type <> 'error' AS ins, seq, pos FROM ev WHERE event_type <> 'signup'
  UNION ALL SELECT user_id, memory_id, memory_text, true, -1, 0 FROM base)
SELECT user_id, memory_id, memory_text FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, memory_id
            ORDER BY seq DESC, ins DESC, pos DESC) AS n FROM ops) WHERE n = 1 AND ins"""
ORACLE["apply_core"] = f"""WITH {_EVENTS}, rows_ AS (
  SELECT user_id, {_uuid5("'core ' || k || user_id")} AS memory_id, 'core ' || k AS memory_text,
         -1 AS ord, min(event_id) AS ord_pos
  FROM ev WHERE event_type = 'signup' GROUP BY user_id, k
  UNION ALL
  SELECT user_id, {_uuid5("user_id || ':' || req_id || ':' || pos")}, 'core ' || k, seq, pos
  FROM ev WHERE event_type NOT IN ('signup', 'error'))
SELECT user_id, memory_id, memory_text, ord, ord_pos FROM rows_ r
WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.event_type = 'error' AND e.user_id = r.user_id
  AND {_uuid5("'core ' || e.k || e.user_id")} = r.memory_id AND e.seq > r.ord)"""
ORACLE["delete_memories"] = f"""WITH {_BASE}{_ASKED}
SELECT user_id, memory_id, memory_text FROM base b WHERE NOT EXISTS (
  SELECT 1 FROM asked a WHERE a.user_id = b.user_id AND a.memory_id = b.memory_id)"""
ORACLE["delete_audit"] = f"""WITH {_BASE}{_ASKED}, f AS (
  SELECT a.*, b.memory_id IS NOT NULL AS hit FROM asked a
  LEFT JOIN base b ON b.user_id = a.user_id AND b.memory_id = a.memory_id)
SELECT request_id, count(*) AS requested, count(*) FILTER (WHERE hit) AS deleted,
       count(*) FILTER (WHERE NOT hit) AS missing,
       CASE WHEN bool_or(hit) THEN 'ok' ELSE 'not found' END AS status
FROM f GROUP BY request_id"""

# -- streams ------------------------------------------------------------------

_LOG = f"""WITH {_STATEMENTS}, cutoff AS (SELECT floor(max(seq) / 2) AS half FROM ev),
st AS (SELECT *, seq >= (SELECT half FROM cutoff) AS late,
         count(*) FILTER (WHERE event_type NOT IN ('view', 'error')) OVER (PARTITION BY req_id) = 0
           AS noise FROM statements),
homes AS (
  SELECT user_id, req_id, seq, turn * 4294967296 AS pos, k, late,
         row_number() OVER (PARTITION BY user_id, late ORDER BY event_id DESC) AS n
  FROM st WHERE event_type = 'signup'),
early AS (SELECT * FROM homes WHERE n = 1 AND NOT late),
moved AS (
  SELECT l.*, e.user_id IS NOT NULL AS replaces FROM homes l LEFT JOIN early e ON e.user_id = l.user_id
  WHERE l.n = 1 AND l.late AND (e.user_id IS NULL OR e.k <> l.k)),
said AS (
  SELECT user_id, req_id, late, CASE event_type WHEN 'purchase' THEN 'project: project ' || k
         ELSE 'taste: prefer option ' || k END AS memory_text,
         CASE event_type WHEN 'purchase' THEN 2 ELSE 4 END AS n_terms
  FROM st WHERE event_type IN ('purchase', 'click'))"""

ORACLE["stream_apply"] = f"""{_LOG}
SELECT DISTINCT user_id, {_uuid5('memory_text || user_id')} AS memory_id, memory_text,
       64 AS dim, n_terms FROM said"""
ORACLE["stream_core"] = f"""{_LOG}
SELECT user_id, {_uuid5("user_id || ':' || req_id || ':' || pos")} AS memory_id, 'location: city ' || k AS memory_text,
       seq AS ord, pos AS ord_pos
FROM (SELECT * EXCLUDE (replaces) FROM moved
      UNION ALL SELECT * FROM early WHERE user_id NOT IN (SELECT user_id FROM moved))"""
ORACLE["dedup_replay"] = f"""{_LOG}
SELECT req_id, CASE WHEN any_value(noise) THEN 0 ELSE 1 END AS applied,
       CASE WHEN any_value(late) THEN 0 ELSE 1 END AS replayed FROM st GROUP BY req_id"""
_AUDIT = """SELECT count(DISTINCT req_id) AS jobs, 0 AS dead, {replayed} AS replayed,
  {live} * count(DISTINCT req_id) FILTER (WHERE noise) AS skipped,
  {live} * count(DISTINCT req_id) FILTER (WHERE NOT noise) AS accepted,
  {live} * ((SELECT count(*) FROM said WHERE {side} late) + (SELECT count(*) FROM {homes})) AS inserted,
  {live} * (SELECT count(*) FROM {homes} WHERE {old}) AS deleted,
  0 AS not_found, 0 AS ignored, 0 AS invalid, {v} AS v FROM st WHERE {side} late"""
ORACLE["ingest_audit"] = f"""{_LOG}
{_AUDIT.format(replayed=0, live=1, side='NOT', homes='early', old='false', v=0)}
UNION ALL
{_AUDIT.format(replayed=0, live=1, side='', homes='moved', old='replaces', v=1)}
UNION ALL
{_AUDIT.format(replayed='count(DISTINCT req_id)', live=0, side='NOT', homes='early', old='false', v=2)}"""

ORACLE["delete_stored"] = ORACLE["delete_memories"]
ORACLE["delete_stored_audit"] = ORACLE["delete_audit"]
ORACLE["get_all_by_key"] = ORACLE["get_all_memories"]
ORACLE["get_core_by_key"] = ORACLE["get_core"]

# Integer widths as Spark has them.
_INT = {
    "attach_dense": ["dim"],
    "build_prompts": ["part"],
    "decode_jobs": ["n_messages"],
    "encode_plugin": ["n_terms"],
    "isolated_failure": ["dim", "n_terms"],
    "explode_turns": ["turn"],
    "gatekeeper": ["turn", "pos"],
    "assign_slots": ["turn", "pos"],
    "parse_plans": ["pos"],
    "sparse_encode_idf": ["n_terms"],
    "upsert_memories": ["n_bytes"],
    **{n: ["rank"] for n in "dense_topk sparse_topk rrf_fuse score_cut hybrid_retrieve".split()},
}
_BIGINT = {
    "get_core": ["ord_pos"],
    "get_all_memories": ["ord_pos"],
    "get_all_by_key": ["ord_pos"],
    "get_core_by_key": ["ord_pos"],
    "retrieve_with_core": ["ord_pos"],
    "dedup_replay": ["applied", "replayed"],
    "ingest_audit": ["dead", "not_found", "ignored", "invalid", "v"],
}
for _widths, _type in ((_INT, "INTEGER"), (_BIGINT, "BIGINT")):
    for _name, _columns in _widths.items():
        _casts = ", ".join(f"{c}::{_type} AS {c}" for c in _columns)
        ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]})"
