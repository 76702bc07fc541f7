"""The registered queries as SQL for an independent engine (DuckDB), on the same
tables. Written from the definitions of the operators, not from the Spark plans."""

from __future__ import annotations

from textwarden.plans.inputs import ENTITY_FEED, REQUEST_KINDS, VECTORS
from textwarden.plans.queries import CUSTOM_RULES, QUERIES
from textwarden.rules import (CRITICAL, DEVELOPMENT_ENTITIES, DEVELOPMENT_KEYWORDS,
                              DEVELOPMENT_SUFFIXES, ENTITY_TYPES_ADVANCED, ENTITY_TYPES_APP,
                              ENTITY_TYPES_PRESIDIO, HARMLESS_WORDS, HIGH, LOW, MEDIUM,
                              NOT_A_PERSON, PATH_MARKS, PATTERNS, PROFILES)


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def says(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


_known = ", ".join(f"({-1 - i}, {q(t)})" for i, t in enumerate(VECTORS.values()))
TEXTS = (f"t AS (SELECT doc_id AS id, text FROM documents UNION ALL "
         f"SELECT * FROM (VALUES {_known}) v(id, text))")
CHATS = (f"c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL "
         f"SELECT id, n, 'user', CASE WHEN n = 1 THEN text ELSE 'ok' END "
         f"FROM (VALUES {_known}) v(id, text), (VALUES (0), (1), (2)) w(n))")


def joined(separator: str = "' '") -> str:
    return (f"{CHATS}, t AS (SELECT conv_id AS id, count(*) AS n_messages, "
            f"string_agg(text || {separator}, '' ORDER BY turn) AS text FROM c GROUP BY conv_id)")


def flag(pattern) -> str:
    return "'i'" if pattern.ignore_case else "'c'"


def search(pattern, text: str = "text") -> str:
    return f"regexp_matches({text}, {q(pattern.regex)}, {flag(pattern)})"


SEVERITY = ("CASE WHEN {0} >= 0.95 THEN 'CRITICAL' WHEN {0} >= 0.8 THEN 'HIGH' "
            "WHEN {0} >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END")
_digits = "regexp_replace(hit, '[-\\s]', '', 'g')"
LUHN = (f"(length({_digits}) >= 13 AND list_sum(list_transform(range(length({_digits})), "
        f"lambda i: CASE WHEN i % 2 = 0 THEN substring(reverse({_digits}), i + 1, 1)::INT "
        f"ELSE (substring(reverse({_digits}), i + 1, 1)::INT * 2) // 10 "
        f"+ (substring(reverse({_digits}), i + 1, 1)::INT * 2) % 10 END)) % 10 = 0)")


def window_text(margin: int) -> str:
    return f"substring(text, greatest(st - {margin}, 0) + 1, en + {margin} - greatest(st - {margin}, 0))"


def span_rows(rows) -> str:
    """CTE ``s``: (id, text, ord, type, descr, conf, sev, k, hit, st, en) of all
    matches. ``rows`` are (ord, type, descr, conf, sev, pattern)."""
    parts = " UNION ALL ".join(
        f"SELECT id, text, {o}::INT AS ord, {q(kind)} AS type, {q(descr)} AS descr, "
        f"{conf}::DOUBLE AS conf, {q(sev)} AS sev, "
        f"regexp_extract_all(text, {q(p.regex)}, 0, {flag(p)}) AS ms, "
        f"string_split_regex(text, {q(p.regex)}, {flag(p)}) AS g FROM t WHERE {search(p)}"
        for o, kind, descr, conf, sev, p in rows)
    return f"""m AS ({parts}),
x AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m WHERE len(ms) > 0),
y AS (SELECT id, text, ord, type, descr, conf, sev, k, ms[k] AS hit,
  (list_sum(list_transform(g[1:k], lambda z: length(z)))
   + coalesce(list_sum(list_transform(ms[1:k-1], lambda z: length(z))), 0))::BIGINT AS st FROM x),
s AS (SELECT *, st + length(hit) AS en FROM y)"""


def profile_rows(profile):
    if profile.name == "recognizers":
        sev = {0.9: HIGH, 0.85: HIGH, 0.8: HIGH}
        return [(i, r.description.lower(), f"Presidio detected {r.description}", r.confidence,
                 sev[r.confidence], r.pattern) for i, r in enumerate(profile.rules)]
    return [(i, r.name, r.description, r.confidence, r.severity, r.pattern)
            for i, r in enumerate(profile.rules)]


def findings(name: str, profile=None, with_context: bool = False) -> str:
    """CTEs up to ``f``: findings before overlap resolution, with source order."""
    profile = profile or PROFILES[name]
    cards = [r.name for r in profile.rules if r.validator == "luhn"]
    keep = f"type NOT IN {in_list(cards)} OR {LUHN}" if cards else "true"
    conf = "conf"
    if name == "advanced":
        near = f"lower({window_text(50)})"
        conf = (f"CASE WHEN type = 'aws_secret_key' THEN 0.8::DOUBLE * power(0.5, sum(CASE WHEN "
                f"contains({near}, 'aws') OR contains({near}, 'secret') THEN 0 ELSE 1 END) "
                f"OVER (PARTITION BY id, ord ORDER BY k)) ELSE conf END")
    entity = "lower(hit)" if name == "recognizers" else "hit"
    extra = ""
    if with_context:
        extra = f""" UNION ALL SELECT id, 2, 0, 'potential_data_exfiltration',
  'Potential data exfiltration attempt detected', 0.7, 1, 0, length(text), 'HIGH',
  substring(text, 1, 100), 'context_aware', '' FROM t
  WHERE {says('lower(text)', ('export', 'download'))}
    AND {says('lower(text)', ('database', 'users', 'passwords'))}"""
    return f"""{span_rows(profile_rows(profile))},
f AS (SELECT id, 1 AS source, ord, type, descr, {conf} AS conf, k, st, en, sev,
  {window_text(20)} AS context, {q(profile.detector)} AS detector, {entity} AS entity_text
  FROM s WHERE {keep}{extra})"""


_COLUMNS = "id, type, descr, conf, st, en, sev, context, detector, entity_text"
_SIDE = ", ".join(f"CASE WHEN o.st < d.en AND o.en > d.st AND o.conf <= d.conf THEN d.{c} ELSE o.{c} "
                  f"END AS {c}" for c in _COLUMNS.split(", ")[1:])
RESOLVE = f"""o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY st, source, ord, k, en, type)
  AS rn FROM f),
d AS (SELECT {_COLUMNS}, rn, 1 AS slot FROM o WHERE rn = 1 UNION ALL
  SELECT o.id, {_SIDE}, o.rn,
    CASE WHEN o.st < d.en AND o.en > d.st THEN d.slot ELSE d.slot + 1 END
  FROM d JOIN o ON o.id = d.id AND o.rn = d.rn + 1),
r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id, slot ORDER BY rn DESC) = 1)"""


def resolved(name: str, texts: str = TEXTS, with_context: bool = False) -> str:
    return f"WITH RECURSIVE {texts}, {findings(name, with_context=with_context)}, {RESOLVE}"


def blocking(policy: str) -> str:
    if policy == "high80":
        return "(sev = 'CRITICAL' OR (sev = 'HIGH' AND conf >= 0.8))"
    if policy == "threshold":
        return "(sev = 'CRITICAL' OR conf >= 0.8)"
    return (f"(sev = 'CRITICAL' OR (sev = 'HIGH' AND conf >= 0.95 AND length(trim(lower(entity_text)))"
            f" > 3 AND trim(lower(entity_text)) NOT IN {in_list(HARMLESS_WORDS)}))")


def spans_query(name: str, profile=None) -> str:
    return f"""WITH {TEXTS}, {findings(name, profile)}
SELECT id AS doc_id, ord AS rule_ord, type, conf AS confidence, st AS start_pos, en AS end_pos,
  sev AS severity, context, detector, entity_text FROM f"""


def presence(name: str, text: str = "text") -> str:
    return ("list_filter([" + ", ".join(
        f"CASE WHEN {search(r.pattern, text)} THEN {q(r.name)} END"
        for r in PROFILES[name].rules) + "], lambda z: z IS NOT NULL)")


def any_rule(name: str) -> str:
    return "(" + " OR ".join(search(r.pattern) for r in PROFILES[name].rules) + ")"


def summary(name: str, key: str, texts: str = TEXTS) -> str:
    source = "r" if PROFILES[name].dedupe else "f"
    head = (resolved(name, texts) if PROFILES[name].dedupe
            else f"WITH {texts}, {findings(name)}")
    extra = (", 0::BIGINT AS from_entities, count(type) AS from_rules" if name == "presidio" else "")
    return f"""{head}
SELECT t.id AS {key}, count(type) = 0 AS clean, count(type) AS total_issues,
  count(*) FILTER (sev = 'CRITICAL') AS critical, count(*) FILTER (sev = 'HIGH') AS high,
  count(*) FILTER (sev = 'MEDIUM') AS medium, count(*) FILTER (sev = 'LOW') AS low,
  coalesce(string_agg(DISTINCT type, ',' ORDER BY type), '') AS issue_types,
  max(conf) AS max_confidence,
  coalesce(bool_or({blocking(PROFILES[name].policy)}), false) AS should_block{extra}
FROM t LEFT JOIN {source} AS z ON z.id = t.id GROUP BY t.id"""


# ---- derived inputs -----------------------------------------------------------------------

_message = "json_object('role', role, 'content', text)::VARCHAR"
_body = f"""CASE kind WHEN 0 THEN '{{"messages": [' || m WHEN 1 THEN '{{"messages": [], "draft": ' || m || '}}'
  WHEN 2 THEN '{{"messages": [{{"role": "user"}}, ' || m || ']}}'
  WHEN 3 THEN '{{"messages": [{{"role": "user", "content": null}}, ' || m || ']}}'
  WHEN 4 THEN '{{"messages": [{{"role": "user", "content": [{{"type": "text", "text": ' || to_json(text)::VARCHAR
    || '}}, "tail", {{"type": "image"}}]}}]}}'
  WHEN 5 THEN '{{"messages": [{{"role": "user", "content": 5}}, ' || m || ']}}'
  WHEN 6 THEN '{{"temperature": 2.5, "max_tokens": 0, "top_p": -0.1, "messages": [' || m || ']}}'
  WHEN 7 THEN '{{"model": "m1", "temperature": 0.2, "max_tokens": 50, "top_p": 0.5, "stream": true, "messages": ['
    || m || ', ' || m || ']}}' ELSE '{{"messages": [' || m || ']}}' END"""
# The bodies again, and what DuckDB reads in them: `request` is null where the body is no JSON.
REQUESTS = (f"{CHATS}, rq AS (SELECT request_id, kind, text, body, CASE WHEN json_valid(body) THEN body::JSON END AS request "
            f"FROM (SELECT *, {_body} AS body FROM (SELECT conv_id || ':' || turn AS request_id, "
            f"(((conv_id + turn) % {REQUEST_KINDS}) + {REQUEST_KINDS}) % {REQUEST_KINDS} AS kind, text, {_message} AS m FROM c)))")
_messages = "json_extract(request, '$.messages[*]')"
FLATTENED = f"""array_to_string(list_transform({_messages}, lambda x: CASE coalesce(json_type(x, '$.content'), 'absent')
  WHEN 'absent' THEN ' ' WHEN 'NULL' THEN 'None ' WHEN 'ARRAY' THEN array_to_string(list_transform(
    json_extract(x, '$.content[*]'), lambda y: CASE json_type(y) WHEN 'VARCHAR' THEN (y->>'$') || ' '
      WHEN 'OBJECT' THEN coalesce((y->>'$.text') || ' ', '') ELSE '' END), '')
  ELSE (x->>'$.content') || ' ' END), '')"""
_all_text = f"""len(list_filter({_messages}, lambda x: coalesce(json_type(x, '$.content'), 'VARCHAR') <> 'VARCHAR')) = 0"""
_joined_text = f"array_to_string(list_transform({_messages}, lambda x: coalesce(x->>'$.content', '') || ' '), '')"
_bad_message = f"""len(list_filter({_messages}, lambda x: coalesce(json_type(x, '$.role'), '') <> 'VARCHAR'
  OR coalesce(json_type(x, '$.content'), '') <> 'VARCHAR')) > 0"""
_answer = "json_object('role', 'assistant', 'content', text)::VARCHAR"
_reply = f"""CASE kind WHEN 0 THEN '{{"id": "r' || conv_id || '", "object": "chat.completion", "created": 17, "model": "m1",
    "choices": [{{"index": 1, "message": ' || m || ', "finish_reason": "stop"}}],
    "usage": {{"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}}}}'
  WHEN 1 THEN '{{"choices": [{{"message": ' || m || '}}]}}'
  WHEN 2 THEN '{{"choices": [{{"finish_reason": "length", "draft": ' || m || '}}], "usage": {{"prompt_tokens": 9}}}}'
  WHEN 3 THEN '{{"draft": ' || m || '}}' ELSE '{{"choices": [{{"message": ' || m END"""
RESPONSES = (f"{CHATS}, rs AS (SELECT request_id, CASE WHEN json_valid(body) THEN body::JSON END AS r FROM ("
             f"SELECT *, {_reply} AS body FROM (SELECT conv_id || ':' || turn AS request_id, conv_id, "
             f"(((conv_id + turn) % 5) + 5) % 5 AS kind, {_answer} AS m FROM c WHERE role = 'assistant')))")
ENTITIES = span_rows([(i, kind, "", 0, "", type("P", (), {"regex": regex, "ignore_case": False}))
                      for i, (kind, regex, _) in enumerate(ENTITY_FEED)]) + (
    ",\ne AS (SELECT id, text, type AS entity_type, (50 + st % 10 * 5) / 100.0::DOUBLE AS score, "
    "st, en FROM s)")
_entity = "lower(substring(text, st + 1, en - st))"
_dev = says("lower(text)", DEVELOPMENT_KEYWORDS)
KEPT = f"""en AS (SELECT *, trim({_entity}) AS entity_text, {_dev} AS dev FROM e
  WHERE entity_type IN {in_list(ENTITY_TYPES_PRESIDIO)}),
ef AS (SELECT id, lower(entity_type) AS type, 'Presidio detected ' || entity_type AS descr,
  score AS conf, st, en, {SEVERITY.format('score')} AS sev, {window_text(20)} AS context,
  'presidio' AS detector, entity_text FROM en
  WHERE length(entity_text) > 1 AND (entity_type <> 'PERSON' OR score >= 0.7)
    AND NOT (entity_type = 'PERSON' AND entity_text IN {in_list(NOT_A_PERSON)})
    AND NOT (dev AND (entity_text IN {in_list(DEVELOPMENT_ENTITIES)}
      OR {says('entity_text', DEVELOPMENT_SUFFIXES)} OR {says('entity_text', PATH_MARKS)})))"""


def merged() -> str:
    """Entity and rule findings, resolved. The CTE names of the two scans differ."""
    own = findings("presidio")
    for name in ("m", "x", "y", "s", "f"):
        own = own.replace(f"\n{name} AS (", f"\nown_{name} AS (").replace(
            f"FROM {name} ", f"FROM own_{name} ").replace(f"FROM {name})", f"FROM own_{name})")
    own = own.replace("m AS (SELECT", "own_m AS (SELECT", 1)
    return f"""WITH RECURSIVE {TEXTS}, {ENTITIES}, {KEPT}, {own},
f AS (SELECT id, 0 AS source, 0 AS ord, type, descr, conf, 0 AS k, st, en, sev, context, detector,
  entity_text FROM ef UNION ALL SELECT * FROM own_f),
{RESOLVE}"""


RATES = (f"count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, "
         f"round(count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*), 4) "
         f"AS error_rate_pct, round(avg(value), 4) AS avg_response")


def per_window(minutes: int) -> str:
    unit = "minute" if minutes == 1 else "hour"
    return (f"SELECT date_trunc('{unit}', ts) AS window_start, date_trunc('{unit}', ts) "
            f"+ INTERVAL {minutes} MINUTE AS window_end, {RATES} FROM events GROUP BY 1, 2")


SLIDING = f"""w AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - b * INTERVAL 30 MINUTE
  AS window_start FROM events, (VALUES (0), (1)) v(b))
SELECT window_start, requests, errors, error_rate_pct > 25.0 AS alert
FROM (SELECT window_start, {RATES} FROM w GROUP BY 1)"""

SESSIONS = """a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
    <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
  count(*) AS requests FROM b GROUP BY user_id, sess"""

_INVALID = "'Invalid JSON'"
_BLOCKED = "'Request blocked due to security policy violations'"

ORACLES = {
    "parse_requests": f"""WITH {REQUESTS} SELECT request_id,
        (CASE WHEN request IS NULL THEN 400 ELSE 200 END)::INT AS status,
        CASE WHEN request IS NULL THEN {_INVALID} END AS error FROM rq""",
    "validate_requests": f"""WITH {REQUESTS}, v AS (SELECT request_id, request,
          coalesce(request->>'$.model', 'deepseek-chat') AS model, coalesce(len({_messages}), 0)::BIGINT AS n_messages,
          coalesce((request->>'$.temperature')::DOUBLE, 0.7) AS temperature,
          coalesce((request->>'$.max_tokens')::BIGINT, 1000) AS max_tokens,
          coalesce((request->>'$.top_p')::DOUBLE, 1.0) AS top_p,
          coalesce((request->>'$.stream')::BOOLEAN, false) AS stream, {_bad_message} AS bad FROM rq)
        SELECT * EXCLUDE (request, bad), array_to_string(list_filter([CASE WHEN request IS NULL THEN {_INVALID} END,
          CASE WHEN bad THEN 'message' END, CASE WHEN temperature NOT BETWEEN 0 AND 2 THEN 'temperature' END,
          CASE WHEN max_tokens NOT BETWEEN 1 AND 4000 THEN 'max_tokens' END,
          CASE WHEN top_p NOT BETWEEN 0 AND 1 THEN 'top_p' END], lambda z: z IS NOT NULL), ',') AS reject_reason FROM v""",
    "reject_empty": f"""WITH {REQUESTS} SELECT request_id,
        (CASE WHEN request IS NULL OR len({_messages}) = 0 THEN 400 ELSE 200 END)::INT AS status,
        CASE WHEN request IS NULL THEN {_INVALID} WHEN len({_messages}) = 0 THEN 'No messages provided' END AS error FROM rq""",
    "concat_messages_space": f"""WITH {joined()} SELECT id AS conv_id, n_messages, text FROM t""",
    "concat_messages_newline": f"""WITH {joined('chr(10)')}
        SELECT id AS conv_id, n_messages, text FROM t""",
    "flatten_multimodal": f"""WITH {REQUESTS} SELECT request_id, {FLATTENED} AS text
        FROM rq WHERE request IS NOT NULL""",
    "error_rows": f"""WITH {REQUESTS} SELECT request_id,
        (CASE WHEN request IS NULL THEN 400 WHEN NOT {_all_text} THEN 500 ELSE 200 END)::INT AS status,
        CASE WHEN request IS NULL THEN {_INVALID} WHEN NOT {_all_text} THEN 'Internal error' END AS error,
        CASE WHEN request IS NOT NULL AND {_all_text} THEN length({_joined_text}) END::BIGINT AS n_chars FROM rq""",
    "normalize_responses": f"""WITH {RESPONSES}, n AS (SELECT *, json_extract(r, '$.choices[0]') AS f FROM rs)
        SELECT request_id, 200::INT AS status, NULL::VARCHAR AS error,
          coalesce(r->>'$.id', 'resp-' || request_id) AS id, coalesce(r->>'$.object', 'chat.completion') AS object,
          coalesce((r->>'$.created')::BIGINT, 0) AS created, coalesce(r->>'$.model', 'deepseek-chat') AS model,
          coalesce(len(json_extract(r, '$.choices[*]')), 0)::BIGINT AS n_choices,
          CASE WHEN f IS NOT NULL THEN coalesce((f->>'$.index')::INT, 0) END AS choice_index,
          CASE WHEN f IS NOT NULL THEN coalesce(f->>'$.message.role', 'assistant') END AS role,
          CASE WHEN f IS NOT NULL THEN coalesce(f->>'$.message.content', '') END AS content,
          f->>'$.finish_reason' AS finish_reason,
          coalesce((r->>'$.usage.prompt_tokens')::INT, 0) AS prompt_tokens,
          coalesce((r->>'$.usage.completion_tokens')::INT, 0) AS completion_tokens,
          coalesce((r->>'$.usage.total_tokens')::INT, 0) AS total_tokens FROM n WHERE r IS NOT NULL
        UNION ALL SELECT request_id, 500, 'Internal error', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
          NULL, NULL, NULL, NULL FROM rs WHERE r IS NULL""",
    "sse_lines": f"""WITH {CHATS},
        l AS (SELECT conv_id AS stream_id, turn * 3 + pos AS seq, CASE pos
            WHEN 0 THEN 'data: ' || replace(text, chr(10), ' ')
            WHEN 1 THEN ': keep-alive'
            ELSE CASE WHEN turn = 3 AND conv_id % 2 = 0 THEN 'data: [DONE]' ELSE '' END END AS line
          FROM c, (VALUES (0), (1), (2)) p(pos)),
        n AS (SELECT stream_id, seq, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM l),
        z AS (SELECT *, min(CASE WHEN line = 'data: [DONE]' THEN seq END)
          OVER (PARTITION BY stream_id) AS done FROM n)
        SELECT stream_id, seq::BIGINT AS seq, line FROM z
        WHERE starts_with(line, 'data: ') AND (done IS NULL OR seq <= done)""",
    "enrich_responses": f"""WITH RECURSIVE {REQUESTS}, rs{RESPONSES.partition(", rs")[2]},
        t AS (SELECT request_id AS id, {FLATTENED} AS text FROM rq WHERE request IS NOT NULL),
        {findings("presidio")}, {RESOLVE.replace("r AS (SELECT", "resolved AS (SELECT")},
        n AS (SELECT t.id, count(z.id) AS n, coalesce(string_agg(DISTINCT z.type, ',' ORDER BY z.type), '') AS types
          FROM t LEFT JOIN resolved z ON z.id = t.id GROUP BY t.id)
        SELECT request_id, coalesce(rs.r->>'$.id', 'resp-' || request_id) AS id,
          coalesce(n.n, 0)::BIGINT AS issues_detected, 'low' AS risk_level,
          '3.0.0-presidio' AS gateway_version, n.types AS issue_types,
          '[Security: ' || coalesce(n.n, 0) || ' issues detected, request allowed] ' AS stream_prefix
        FROM rs LEFT JOIN n ON n.id = rs.request_id WHERE rs.r IS NOT NULL""",
    "request_log": f"""{resolved("enhanced", joined())}
        SELECT t.id AS conv_id, any_value(n_messages) AS n_messages,
          length(any_value(text)) AS content_length, count(type) AS issue_count,
          coalesce(string_agg(type || ': ' || sev || ' (confidence: ' || format('{{:.3f}}', conf) || ')',
            '; ' ORDER BY st) FILTER (type IS NOT NULL), '') AS issue_lines,
          substring(any_value(text), 1, 100) AS preview
        FROM t LEFT JOIN r ON r.id = t.id GROUP BY t.id""",
    "audit_records": """SELECT strftime(ts, '%Y-%m-%d') AS date,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, event_id, event_type FROM events""",
    "audit_trail": """SELECT CASE event_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS batch, strftime(ts, '%Y-%m-%d') AS date,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, event_id FROM events""",
    "request_lines": f"""WITH {REQUESTS} SELECT request_id, request->>'$.model' AS model, len({_messages})::BIGINT AS n
        FROM rq WHERE request IS NOT NULL
        UNION ALL SELECT 'set aside', NULL, count(*) FROM rq WHERE request IS NULL""",
    "rule_catalogue": f"WITH {TEXTS}, " + "n AS (" + " UNION ALL ".join(
        f"SELECT {q(k)} AS pattern, count(*) FILTER ({search(p)}) AS n_texts FROM t"
        for k, p in PATTERNS.items()) + "), r(profile, rule_ord, rule, pattern, confidence, severity) "
        "AS (VALUES " + ", ".join(
            f"({q(name)}, {i}::INT, {q(r.name)}, "
            f"{q(next(k for k, p in PATTERNS.items() if p == r.pattern))}, "
            f"{r.confidence}::DOUBLE, {q(r.severity)})"
            for name, prof in PROFILES.items() for i, r in enumerate(prof.rules))
        + ") SELECT r.*, n_texts FROM r JOIN n USING (pattern)",
    "hits_per_rule": f"""WITH {TEXTS}, {findings("enhanced")},
        r(type, severity, description) AS (VALUES {", ".join(
            f"({q(r.name)}, {q(r.severity)}, {q(r.description)})" for r in PROFILES["enhanced"].rules)})
        SELECT r.*, (SELECT count(*) FROM f WHERE f.type = r.type) AS hits FROM r""",
    "custom_rule_scan": spans_query("advanced", PROFILES["advanced"].with_rules(CUSTOM_RULES)),
    "cards_luhn": f"""WITH {TEXTS}, {span_rows([(0, "c", "", 0, "", PATTERNS["card_grouped"])])}
        SELECT id AS doc_id, st AS start_pos, en AS end_pos, hit, {LUHN} AS valid FROM s""",
    "udf_validator": f"""WITH {TEXTS}, {span_rows([(0, "p", "", 0, "", PATTERNS["phone"])])}
        SELECT id AS doc_id, st AS start_pos, en AS end_pos, hit,
          left(right(regexp_replace(hit, '[^0-9]', '', 'g'), 10), 1) NOT IN ('0', '1') AS valid FROM s""",
    "email_shape": f"""WITH {TEXTS}, {span_rows([(0, "e", "", 0, "", type(
        "P", (), {"regex": "[^ \n]*@[^ \n]*", "ignore_case": True}))])}
        SELECT id AS doc_id, st AS start_pos, en AS end_pos, hit,
          len(string_split(hit, '@')) = 2 AND string_split(hit, '@')[1] <> ''
          AND contains(string_split(hit, '@')[2], '.') AS valid FROM s""",
    "least_confidence": f"""WITH {TEXTS}, {findings("presidio")}
        SELECT id AS doc_id, type, conf AS confidence, st AS start_pos FROM f WHERE conf >= 0.8""",
    "finding_context": f"""WITH {TEXTS}, {findings("simple")}
        SELECT id AS doc_id, type, st AS start_pos, context FROM f""",
    "context_decay": f"""WITH {TEXTS}, {findings("advanced")}
        SELECT id AS doc_id, st AS start_pos, conf AS confidence FROM f
        WHERE type = 'aws_secret_key'""",
    "exfiltration": f"""WITH {TEXTS} SELECT id AS doc_id, 'potential_data_exfiltration' AS type,
        0.7::DOUBLE AS confidence, length(text) AS end_pos, 'HIGH' AS severity,
        substring(text, 1, 100) AS context, 'context_aware' AS detector FROM t
        WHERE {says('lower(text)', ('export', 'download'))}
          AND {says('lower(text)', ('database', 'users', 'passwords'))}""",
    "heuristic_scan": f"""WITH {joined()}, h AS (SELECT id, list_filter([
        CASE WHEN contains(text, 'sk-') AND length(text) > 50 THEN 'potential_openai_key' END,
        CASE WHEN contains(text, '@') AND contains(text, '.') THEN 'potential_email' END,
        CASE WHEN contains(lower(text), 'api_key') THEN 'api_key_mention' END,
        CASE WHEN contains(lower(text), 'password') THEN 'password_mention' END],
        lambda z: z IS NOT NULL) AS names FROM t)
        SELECT id AS conv_id, array_to_string(names, ',') AS issues, len(names) > 0 AS blocked FROM h""",
    "entity_postfilter": f"""WITH {TEXTS}, {ENTITIES}, {KEPT}
        SELECT id AS doc_id, type, descr AS description, conf AS confidence, st AS start_pos,
          en AS end_pos, sev AS severity, context, detector, entity_text FROM ef""",
    "dev_context": f"WITH {TEXTS} SELECT id AS doc_id, {_dev} AS dev FROM t",
    "entity_types": f"""WITH {TEXTS}, {ENTITIES} SELECT entity_type, count(*) AS n,
        count(*) FILTER (entity_type IN {in_list(ENTITY_TYPES_APP)}) AS app,
        count(*) FILTER (entity_type IN {in_list(ENTITY_TYPES_ADVANCED)}) AS advanced,
        count(*) FILTER (entity_type IN {in_list(ENTITY_TYPES_PRESIDIO)}) AS presidio
        FROM e GROUP BY 1""",
    "entity_labels": f"""WITH {TEXTS}, {ENTITIES} SELECT id AS doc_id, st AS start_pos,
        en AS end_pos, 'PII detected: ' || entity_type || ' (confidence: '
          || format('{{:.2f}}', score) || ')' AS label
        FROM e WHERE entity_type IN {in_list(ENTITY_TYPES_APP)}""",
    "app_decisions": f"""WITH {TEXTS}, {ENTITIES},
        l AS (SELECT id, list('PII detected: ' || entity_type || ' (confidence: ' || format('{{:.2f}}', score)
          || ')' ORDER BY st, en, entity_type) AS labels
          FROM e WHERE entity_type IN {in_list(ENTITY_TYPES_APP)} GROUP BY id),
        n AS (SELECT id, {presence("minimal")} AS names FROM t),
        i AS (SELECT n.id, list_concat(coalesce(labels, []), ['Secret detected: ' || x FOR x IN names])
          AS issues FROM n LEFT JOIN l ON l.id = n.id)
        SELECT id AS doc_id, (CASE WHEN len(issues) > 0 THEN 400 ELSE 200 END)::INT AS status,
          len(issues) > 0 AS blocked, CASE WHEN len(issues) > 0 THEN {_BLOCKED} END AS error,
          array_to_string(issues, ',') AS issues FROM i""",
    "block_rate": f"""WITH t AS (SELECT lang, text FROM documents),
        n AS (SELECT lang, len({presence("minimal")}) > 0 AS blocked FROM t)
        SELECT lang, count(*) AS requests, count(*) FILTER (blocked) AS blocked,
          round(count(*) FILTER (blocked) * 100.0 / count(*), 4) AS block_rate_pct FROM n GROUP BY lang""",
    "toggle_matrix": f"""WITH {TEXTS}, {ENTITIES},
        n AS (SELECT id, len({presence("minimal")}) AS secrets, (SELECT count(*) FROM e
          WHERE e.id = t.id AND entity_type IN {in_list(ENTITY_TYPES_APP)}) AS pii FROM t),
        o AS (SELECT pii_on, secrets_on, CASE WHEN pii_on THEN pii ELSE 0 END
          + CASE WHEN secrets_on THEN secrets ELSE 0 END AS issues
          FROM n, (VALUES (true), (false)) a(pii_on), (VALUES (true), (false)) b(secrets_on))
        SELECT pii_on, secrets_on, sum(issues)::BIGINT AS issues,
          count(*) FILTER (issues > 0) AS blocked FROM o GROUP BY 1, 2""",
    "merged_findings": f"""{merged()} SELECT id AS doc_id, type, conf AS confidence,
        st AS start_pos, en AS end_pos, sev AS severity, detector FROM r""",
    "detector_breakdown": f"""{merged()} SELECT count(*) FILTER (detector = 'presidio') AS presidio,
        count(*) FILTER (detector = 'custom_regex') AS custom_regex FROM r""",
    "clean_texts": f"""WITH {TEXTS}, {findings("presidio")} SELECT id AS doc_id,
        length(text) AS n_chars FROM t WHERE id NOT IN (SELECT id FROM f)""",
    "flagged_texts": f"""WITH {TEXTS}, {findings("presidio")} SELECT id AS doc_id,
        length(text) AS n_chars FROM t WHERE id IN (SELECT id FROM f)""",
    "confidence_severity": f"""WITH {TEXTS}, {ENTITIES} SELECT score, count(*) AS n,
        {SEVERITY.format('score')} AS severity FROM e GROUP BY score""",
    "ranked_findings": f"""{resolved("presidio")}
        SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY conf DESC, st) AS rnk, type,
          conf AS confidence, st AS start_pos FROM r QUALIFY rnk <= 3""",
    "policy_any": f"""WITH {joined('chr(10)')}
        SELECT id AS conv_id, {any_rule("minimal")} AS blocked FROM t""",
    "policy_flag": f"""WITH {joined('chr(10)')}
        SELECT id AS conv_id, {any_rule("cloud")} AS blocked FROM t""",
    "decisions": f"""WITH {TEXTS}, n AS (SELECT id, {presence("railway")} AS names FROM t)
        SELECT id AS doc_id, (CASE WHEN len(names) > 0 THEN 400 ELSE 200 END)::INT AS status,
          len(names) > 0 AS blocked, CASE WHEN len(names) > 0 THEN {_BLOCKED} END AS error,
          array_to_string(list_transform(names, lambda z: 'Detected: ' || z), ',') AS issues FROM n""",
    "issue_payload": f"""{resolved("presidio")} SELECT id AS doc_id, st AS start_pos, type,
        sev AS severity, descr AS description, round(conf, 3) AS confidence, detector,
        CASE WHEN length(entity_text) > 20 THEN substring(entity_text, 1, 20) || '...'
          ELSE entity_text END AS entity_text,
        CASE WHEN length(context) > 50 THEN substring(context, 1, 50) || '...'
          ELSE context END AS context FROM r""",
    "redact": f"""{resolved("enhanced")},
        p AS (SELECT id, st, en, type, coalesce(lag(en) OVER (PARTITION BY id ORDER BY st), 0) AS prev
          FROM r),
        j AS (SELECT t.id, string_agg(substring(text, prev + 1, st - prev) || '<' || upper(type) || '>',
          '' ORDER BY st) AS head, max(en) AS done FROM p JOIN t ON t.id = p.id GROUP BY t.id)
        SELECT t.id AS doc_id, CASE WHEN head IS NULL THEN text
          ELSE head || substring(text, done + 1) END AS redacted FROM t LEFT JOIN j ON j.id = t.id""",
    "scan_stats": f"""{resolved("presidio")},
        b AS (SELECT id, count(*) AS n, bool_or({blocking("high95")}) AS blocked FROM r GROUP BY id)
        SELECT (SELECT count(*) FROM t) AS total_scans, 0::BIGINT AS presidio_scans,
          (SELECT count(*) FROM t) AS custom_scans, sum(n)::BIGINT AS issues_found,
          count(*) FILTER (blocked) AS blocked_requests FROM b""",
    "severity_breakdown": f"""{resolved("enhanced")}
        SELECT count(*) FILTER (sev = {q(CRITICAL)}) AS critical,
          count(*) FILTER (sev = {q(HIGH)}) AS high, count(*) FILTER (sev = {q(MEDIUM)}) AS medium,
          count(*) FILTER (sev = {q(LOW)}) AS low FROM r""",
    "issue_types": f"""{resolved("enhanced")}
        SELECT string_agg(DISTINCT type, ',' ORDER BY type) AS issue_types,
          count(DISTINCT type) AS n_types FROM r""",
    "token_usage": f"""WITH {joined()}, n AS (SELECT id, len(list_filter(
        string_split_regex(text, '\\s+'), lambda z: z <> '')) AS p FROM t)
        SELECT id AS conv_id, p AS prompt_tokens, 30::BIGINT AS completion_tokens,
          p + 30 AS total_tokens FROM n""",
    "avg_scan_time": f"""WITH d AS (SELECT ts::DATE AS day, sum(value) AS total,
        count(*) AS n FROM events GROUP BY 1)
        SELECT day::VARCHAR AS day, round(total / n, 2) AS avg_ms,
          round(sum(total) OVER w / sum(n) OVER w, 2) AS running_avg_ms FROM d
        WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)""",
    "running_scan_time": """WITH w AS (SELECT event_id, count(value) OVER o AS n,
          sum(value::DECIMAL(18,4)) OVER o AS total FROM events
          WINDOW o AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_id, n, total::DOUBLE / n AS running_mean FROM w""",
    "usage_cost": f"""SELECT user_id, event_type, count(*) AS requests,
        round(sum(value), 4) AS tokens, round(round(sum(value), 4) * 0.002 / 1000, 8) AS cost
        FROM events GROUP BY ROLLUP (user_id, event_type)""",
    "ops_metrics": per_window(1),
    "stream_metrics": per_window(60),
    "stream_alerts": f"WITH {SLIDING}",
    "stream_sessions": f"WITH {SESSIONS}",
    "stream_rate_limit": """SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS requests,
        count(*) > 1 AS over_quota FROM events GROUP BY 1, 2""",
    "stream_late_events": """WITH passed AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events WHERE event_id % 50 <> 0),
        e AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
          event_id % 50 = 0 AND window_end <= mark AS late FROM events, passed)
        SELECT window_end, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late,
          count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors,
          round(errors * 100.0 / requests, 4) AS error_rate_pct, round(avg(value), 4) AS avg_response
        FROM e GROUP BY window_end""",
    "stream_stats": f"""SELECT event_type, count(*) AS requests, round(sum(value), 4) AS total_value
        FROM events GROUP BY 1""",
    "stream_scan": f"""{resolved("enhanced", "t AS (SELECT doc_id AS id, text FROM documents)")}
        SELECT id AS doc_id, type, conf AS confidence, st AS start_pos, en AS end_pos FROM r""",
    "rate_limit": """WITH n AS (SELECT user_id, floor(epoch(ts))::BIGINT AS second, count(*) AS n
        FROM events GROUP BY 1, 2),
        w AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY second
          RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)::BIGINT AS in_window FROM n)
        SELECT user_id, second, n AS requests, in_window, in_window > 1 AS over_quota FROM w""",
}

for _name in ("cloud", "railway", "minimal"):
    ORACLES[f"presence_{_name}"] = f"""WITH {TEXTS}
        SELECT id AS doc_id, array_to_string({presence(_name)}, ',') AS rules FROM t"""
for _name in ("presidio", "enhanced", "simple", "advanced", "recognizers"):
    ORACLES[f"spans_{_name}"] = spans_query(_name)
for _name in ("presidio", "enhanced", "advanced"):
    ORACLES[f"dedupe_{_name}"] = f"""{resolved(_name, with_context=_name == "advanced")}
        SELECT id AS doc_id, type, conf AS confidence, st AS start_pos, en AS end_pos,
          sev AS severity, detector FROM r"""
for _policy, _name in (("high80", "enhanced"), ("threshold", "advanced"), ("high95", "presidio")):
    ORACLES[f"policy_{_policy}"] = f"""{resolved(_name)}
        SELECT t.id AS doc_id, coalesce(bool_or({blocking(_policy)}), false) AS blocked,
          count(type) AS total_issues FROM t LEFT JOIN r ON r.id = t.id GROUP BY t.id"""
ORACLES["summary_presidio"] = summary("presidio", "doc_id")
ORACLES["summary_advanced"] = summary("advanced", "doc_id")
ORACLES["summary_enhanced"] = summary("enhanced", "conv_id", joined())
ORACLES["summary_simple"] = summary("simple", "conv_id", joined())

ORACLES["clean_texts_joined"], ORACLES["flagged_texts_joined"] = ORACLES["clean_texts"], ORACLES["flagged_texts"]
ORACLES["scan_function"], ORACLES["observed_stats"] = ORACLES["spans_enhanced"], ORACLES["scan_stats"]
ORACLES["stream_quota_sliding"] = ORACLES["rate_limit"]
ORACLES["stream_enriched_responses"] = ORACLES["enrich_responses"]

ORACLES = {name: ORACLES[name] for name in QUERIES if name in ORACLES}
