"""The same results in SQL on the driver's tables, written from the rules and not from the Spark code.

Each query is a chain of named subqueries; `_sql` puts the ones it needs in front.
"""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def _part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = (needs, body)


def _sql(final: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for before in PARTS[name][0]:
                visit(before)
            ordered.append(name)

    for name in needs:
        visit(name)
    with_list = ",\n".join(f"{name} AS (\n{PARTS[name][1].strip()}\n)" for name in ordered)
    return f"WITH {with_list}\n{final.strip()}" if ordered else final.strip()


# ---- FX1, FX2: declarations and secrets -------------------------------------------------------------

_part(
    "canaries",
    """
SELECT c_custkey AS k, c_nationkey AS nk, lower(c_mktsegment) AS namespace, 'canary-' || c_custkey AS name,
       lower(c_mktsegment) || '/canary-' || c_custkey AS probe,
       TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at,
       'https://svc-' || c_nationkey || '.example.test/health' AS url,
       CASE c_custkey % 4 WHEN 1 THEN 'GET' WHEN 2 THEN 'POST' WHEN 3 THEN 'HEAD' END AS raw_method,
       CASE WHEN c_custkey % 4 = 2 THEN '{"k":' || c_custkey || '}' END AS body,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS probe_id,
       CASE WHEN c_custkey % 7 > 0 THEN CAST(3 + c_custkey % 40 AS INTEGER) END AS raw_interval,
       CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 5 THEN 700 ELSE 200 END AS raw_status,
       CASE c_custkey % 5 WHEN 1 THEN 'basic' WHEN 2 THEN 'bearer' WHEN 3 THEN 'apiKey' WHEN 4 THEN 'digest' END
         AS auth_type,
       'secret-' || c_nationkey AS secret_name,
       c_custkey % 11 = 0 AS has_mcp, CAST(c_custkey % 3 - 1 AS INTEGER) AS raw_min_tools,
       c_custkey % 13 = 0 AS has_journey,
       CASE (c_custkey // 4) % 4 WHEN 1 THEN 'prometheus' WHEN 2 THEN 'stdout' WHEN 3 THEN 'prometheus,stdout' END
         AS outputs
FROM customer
""",
)
_part(
    "declared",
    """
SELECT *, coalesce(raw_method, 'GET') AS method, coalesce(raw_interval, 30) AS interval_seconds,
       coalesce(raw_status, 200) AS expected_status,
       CASE WHEN has_mcp THEN raw_min_tools END AS min_tool_count
FROM canaries
""",
    "canaries",
)
_part(
    "violated",
    """
SELECT namespace, name, 1 AS rank, 'interval below minimum' AS code FROM declared WHERE interval_seconds < 5
UNION ALL SELECT namespace, name, 2, 'expected_status out of range' FROM declared WHERE expected_status > 599
UNION ALL SELECT namespace, name, 3, 'journey.method unknown' FROM declared WHERE has_journey
UNION ALL SELECT namespace, name, 4, 'mcp.min_tool_count below minimum' FROM declared WHERE min_tool_count < 0
UNION ALL SELECT namespace, name, 5, 'auth.type unknown' FROM declared WHERE auth_type = 'digest'
""",
    "declared",
)
_part(
    "refs",
    """
SELECT d.namespace, d.name, d.probe, d.secret_name, r.ord, r.role, r.key, r.label,
       d.namespace || '__' || d.name || '__' || r.suffix AS credential_id, d.auth_type
FROM declared d
JOIN (VALUES ('basic', 0, 'username', 'username', 'basic username', 'basic-username'),
             ('basic', 1, 'password', 'password', 'basic password', 'basic-password'),
             ('bearer', 0, 'token', 'token', 'bearer token', 'bearer-token'),
             ('apiKey', 0, 'value', 'key', 'apiKey value', 'api-key'))
  AS r(auth_type, ord, role, key, label, suffix) ON r.auth_type = d.auth_type
""",
    "declared",
)
_part(
    "secret_keys",
    """
SELECT DISTINCT lower(c.c_mktsegment) AS namespace, 'secret-' || n.n_nationkey AS secret_name, x.key,
       'v-' || n.n_nationkey || '-' || x.key AS value
FROM customer c
JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey <> 4
JOIN (VALUES ('username', true), ('password', false), ('token', false), ('key', true)) AS x(key, everywhere)
  ON x.everywhere OR n.n_regionkey <> 3
""",
)
_part(
    "ref_errors",
    """
SELECT r.*, CASE
         WHEN s.namespace IS NULL THEN 'resolving ' || r.label || ': secrets "' || r.secret_name || '" not found'
         WHEN k.key IS NULL THEN 'resolving ' || r.label || ': secret ' || r.namespace || '/' || r.secret_name
              || ' is missing key "' || r.key || '"'
       END AS error, k.value
FROM refs r
LEFT JOIN (SELECT DISTINCT namespace, secret_name FROM secret_keys) s USING (namespace, secret_name)
LEFT JOIN secret_keys k ON k.namespace = r.namespace AND k.secret_name = r.secret_name AND k.key = r.key
""",
    "refs",
    "secret_keys",
)
_part(
    "auth_errors",
    """
SELECT namespace, name, 'Invalid auth config: ' || arg_min(error, ord) AS config_error
FROM (SELECT namespace, name, ord, error FROM ref_errors WHERE error IS NOT NULL
      UNION ALL SELECT namespace, name, 0, 'unsupported auth type "digest"' FROM declared WHERE auth_type = 'digest')
GROUP BY namespace, name
""",
    "ref_errors",
    "declared",
)
_part(
    "probes",
    """
SELECT d.*, e.config_error,
       CASE WHEN e.config_error IS NULL THEN d.auth_type END AS good_auth,
       CASE WHEN e.config_error IS NOT NULL THEN 'config_error' WHEN has_mcp THEN 'mcp'
            WHEN has_journey THEN 'journey' ELSE 'single' END AS mode
FROM declared d LEFT JOIN auth_errors e USING (namespace, name)
""",
    "declared",
    "auth_errors",
)

# ---- FX3: events -----------------------------------------------------------------------------------

_part(
    "ev",
    """
SELECT CAST(event_id AS VARCHAR) AS cycle_id, event_id, ts AS last_check_time, user_id,
       'default/user-' || user_id AS name, 'https://app.example.test/u/' || user_id AS url,
       CAST(round(value * 10000) AS BIGINT) AS duration_us,
       event_type = 'signup' AND user_id % 7 = 0 AS broken,
       CASE event_type WHEN 'error' THEN 503 WHEN 'purchase' THEN 201 ELSE 200 END AS got,
       CASE WHEN user_id % 5 = 0 THEN 201 ELSE 200 END AS expected_status,
       user_id % 3 = 0 AS wants_text, contains(props, '"k": 6') AS has_text,
       user_id % 4 <> 2 AS to_metrics, user_id % 4 >= 2 AS to_lines
FROM events
""",
)
_part(
    "er",
    r"""
SELECT name, NOT broken AND got = expected_status AND (has_text OR NOT wants_text) AS healthy,
       CASE WHEN broken THEN 0 ELSE got END AS status_code, last_check_time,
       CASE WHEN broken THEN 'http request failed: connection refused'
            WHEN got <> expected_status THEN 'Expected ' || expected_status || ' but got ' || got
            WHEN wants_text AND NOT has_text THEN 'Response body did not contain "\"k\": 6"'
            WHEN wants_text THEN 'Got expected status ' || got || ' and matched response text'
            ELSE 'Got expected status ' || got END AS message,
       url, expected_status, cycle_id, duration_us, 'single' AS mode, to_metrics, to_lines
FROM ev
""",
    "ev",
)
_part(
    "er_latest",
    """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY last_check_time DESC, cycle_id DESC) AS rn FROM er)
WHERE rn = 1
""",
    "er",
)
_JSON = r"""
SELECT {name} '{{"name":"' || name || '","healthy":' || CASE WHEN healthy THEN 'true' ELSE 'false' END
       || ',"statusCode":' || status_code || ',"lastCheckTime":"'
       || rtrim(rtrim(strftime(last_check_time, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z","message":"'
       || replace(replace(message, '\', '\\'), '"', '\"') || '","url":"' || url || '","expectedStatus":'
       || expected_status || '}}' AS value
FROM {source}
"""
_part(
    "em",
    """
SELECT name, count(*) FILTER (WHERE healthy) AS success, count(*) FILTER (WHERE NOT healthy) AS failure,
       CAST(sum(duration_us) AS BIGINT) AS sum_us, count(*) AS n
FROM er WHERE to_metrics GROUP BY name
""",
    "er",
)
_part(
    "bounds",
    """
SELECT * FROM (VALUES ('0.005', 5000), ('0.01', 10000), ('0.025', 25000), ('0.05', 50000), ('0.1', 100000),
  ('0.25', 250000), ('0.5', 500000), ('1', 1000000), ('2.5', 2500000), ('5', 5000000), ('10', 10000000),
  ('+Inf', 9223372036854775807)) AS b(le, upper)
""",
)
_part(
    "eh",
    """
SELECT e.name, b.le, count(*) FILTER (WHERE e.duration_us <= b.upper) AS value
FROM er e JOIN bounds b ON e.to_metrics GROUP BY e.name, b.le
""",
    "er",
    "bounds",
)
_part(
    "eg",
    "SELECT name, CASE WHEN healthy THEN 1 ELSE 0 END AS value FROM er_latest WHERE to_metrics",
    "er_latest",
)
_part(
    "lines",
    """
SELECT 'canary_checks_total' AS metric, name AS probe,
       'canary_checks_total{probe="' || name || '",result="success"} ' || success AS line
FROM em WHERE success > 0
UNION ALL
SELECT 'canary_checks_total', name, 'canary_checks_total{probe="' || name || '",result="failure"} ' || failure
FROM em WHERE failure > 0
UNION ALL
SELECT 'canary_check_duration_seconds', name,
       'canary_check_duration_seconds_bucket{probe="' || name || '",le="' || le || '"} ' || value FROM eh
UNION ALL
SELECT 'canary_check_duration_seconds', name,
       'canary_check_duration_seconds_sum{probe="' || name || '"} '
       || rtrim(rtrim(sum_us // 1000000 || '.' || lpad(CAST(sum_us % 1000000 AS VARCHAR), 6, '0'), '0'), '.') FROM em
UNION ALL
SELECT 'canary_check_duration_seconds', name,
       'canary_check_duration_seconds_count{probe="' || name || '"} ' || n FROM em
UNION ALL
SELECT 'canary_healthy', name, 'canary_healthy{probe="' || name || '"} ' || value FROM eg
UNION ALL
SELECT h.metric, '', h.line
FROM (VALUES
  ('canary_checks_total', '# HELP canary_checks_total Finished checks of each probe, split into successes and failures.'),
  ('canary_checks_total', '# TYPE canary_checks_total counter'),
  ('canary_check_duration_seconds',
   '# HELP canary_check_duration_seconds Seconds from the first request of a check to its last response.'),
  ('canary_check_duration_seconds', '# TYPE canary_check_duration_seconds histogram'),
  ('canary_healthy', '# HELP canary_healthy 1 if the latest check of the probe succeeded, else 0.'),
  ('canary_healthy', '# TYPE canary_healthy gauge')) AS h(metric, line)
WHERE EXISTS (SELECT 1 FROM em)
""",
    "em",
    "eh",
    "eg",
)
_part(
    "daily",
    """
SELECT name, date_trunc('day', last_check_time) AS window_start,
       CASE WHEN healthy THEN 'Healthy' ELSE 'Unhealthy' END AS phase, status_code AS last_status, message,
       last_check_time
FROM (SELECT *, row_number() OVER (PARTITION BY name, date_trunc('day', last_check_time)
                                   ORDER BY last_check_time DESC, cycle_id DESC) AS rn FROM er)
WHERE rn = 1
""",
    "er",
)

_HISTORY = """
SELECT name, window_start, phase, last_status, message, last_check_time
FROM (SELECT *, lag(phase) OVER w AS p, lag(last_status) OVER w AS s, lag(message) OVER w AS m
      FROM daily WINDOW w AS (PARTITION BY name ORDER BY window_start))
WHERE p IS NULL OR p <> phase OR s <> last_status OR m <> message
"""

# ---- FX4: conversations as journeys ----------------------------------------------------------------

_part(
    "turns",
    """
SELECT conv_id, CAST(conv_id AS VARCHAR) AS cycle_id, 'default/conv-' || conv_id % 10 AS probe,
       CAST(turn AS INTEGER) AS seq, role AS stage, text, 2 + (conv_id % 10) % 4 AS n_steps,
       TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60) AS cycle_started_at,
       TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS started_at,
       TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn + 1) AS finished_at,
       CASE WHEN length(text) % 7 = 0 THEN 500 ELSE 200 END AS status_code
FROM conversations
""",
)
_part("planned", "SELECT * FROM turns WHERE seq < n_steps", "turns")
_part(
    "failed",
    """
SELECT * FROM (
  SELECT *, CASE WHEN status_code = 500 THEN 'Expected 200 but got 500'
                 WHEN seq % 2 = 1 AND NOT contains(text, 'th') THEN 'Response body did not contain "th"' END AS why
  FROM planned)
WHERE why IS NOT NULL
""",
    "planned",
)
_part(
    "journeys",
    """
SELECT c.cycle_id, c.probe, c.cycle_started_at, f.cycle_id IS NULL AS healthy, c.n = c.n_steps AS whole,
       coalesce(f.status_code, 200) AS status_code, c.last_check_time,
       CASE WHEN f.cycle_id IS NULL THEN 'Synthetic journey succeeded (' || c.n_steps || ' steps)'
            ELSE 'Step ' || f.seq + 1 || ' (turn-' || f.seq || ') failed: ' || f.why END AS message,
       CASE WHEN f.cycle_id IS NULL THEN 204 ELSE 200 END AS expected_status,
       date_diff('microsecond', c.started_at, c.last_check_time) AS duration_us
FROM (SELECT cycle_id, any_value(probe) AS probe, any_value(cycle_started_at) AS cycle_started_at, count(*) AS n,
             any_value(n_steps) AS n_steps, min(started_at) AS started_at, max(finished_at) AS last_check_time
      FROM planned GROUP BY cycle_id) c
LEFT JOIN (SELECT * FROM failed QUALIFY row_number() OVER (PARTITION BY cycle_id ORDER BY seq) = 1) f
  ON f.cycle_id = c.cycle_id
""",
    "planned",
    "failed",
)
_JOURNEYS = """
SELECT probe AS name, healthy, status_code, last_check_time, message, 'https://chat.example.test/' AS url,
       expected_status, cycle_id, duration_us, 'journey' AS mode, true AS to_metrics, false AS to_lines
FROM journeys WHERE (whole OR NOT healthy) {extra}
"""
_CYCLES = """
SELECT cycle_id, any_value(probe) AS probe, min(started_at) AS started_at, max(finished_at) AS finished_at,
       date_diff('microsecond', min(started_at), max(finished_at)) AS duration_us, CAST(count(*) AS INTEGER) AS n_responses,
       string_agg(status_code, ',' ORDER BY seq) AS status_codes, string_agg(stage, ',' ORDER BY seq) AS stages,
       CAST(sum(length(text)) AS INTEGER) AS body_chars
FROM planned {where} GROUP BY cycle_id
"""

# ---- FX5: parts as tool-listing checks -------------------------------------------------------------

_part(
    "pt",
    """
SELECT p_partkey, 'part-' || p_partkey AS cycle_id, CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) AS b,
       p_partkey % 11 AS c, p_name, lower(p_type) AS type_name, p_size,
       CASE WHEN p_size % 10 = 0 THEN 0 WHEN p_size % 2 = 0 THEN 3 ELSE 2 END AS n_tools
FROM part
""",
)
_part(
    "required",
    """
SELECT * FROM (VALUES (1, 'economy'), (2, 'zzz'), (2, 'economy'), (2, 'small ring'), (2, 'economy')) AS r(kind, tool)
""",
)
_part(
    "missing",
    """
SELECT p.p_partkey, string_agg(r.tool, ', ' ORDER BY r.tool) AS tools
FROM pt p JOIN required r ON r.kind = p.b % 3
WHERE p.n_tools = 0 OR (r.tool <> p.p_name AND r.tool <> p.type_name)
GROUP BY p.p_partkey
""",
    "pt",
    "required",
)
_part(
    "stages",
    """
SELECT p.cycle_id, 'tools/brand-' || p.b AS name, p.b, p.p_partkey,
       CASE p.c WHEN 0 THEN 'initialize returned HTTP 503'
                WHEN 1 THEN 'initialize request failed: http request failed: connection refused'
                WHEN 2 THEN 'Failed to decode initialize response: invalid JSON document'
                WHEN 3 THEN 'initialize returned JSON-RPC error -32601: no such method'
                WHEN 4 THEN 'initialize response missing result' END AS init_reply,
       CASE WHEN p.c IN (5, 8) THEN 'Initialize response missing protocolVersion'
            WHEN p.c = 6 AND p.b % 2 = 0 THEN 'Initialize response did not advertise tools capability' END AS init_own,
       CASE p.c WHEN 0 THEN 503 WHEN 1 THEN 0 ELSE 200 END AS init_status,
       CASE WHEN p.c = 7 THEN 'notifications/initialized returned HTTP 500' END AS note,
       CASE WHEN p.p_size % 17 = 0 THEN 'Failed to decode tools/list response: invalid JSON document' END AS tools_reply,
       CASE WHEN p.p_size % 17 = 0 THEN 'Failed to decode tools/list response: invalid JSON document'
            WHEN p.n_tools < p.b % 4 THEN 'tools/list returned ' || p.n_tools || ' tools, need at least ' || p.b % 4
            WHEN m.tools IS NOT NULL THEN 'tools/list missing required tools: ' || m.tools END AS tools_own,
       p.n_tools
FROM pt p LEFT JOIN missing m USING (p_partkey)
""",
    "pt",
    "missing",
)
_part(
    "pr",
    """
SELECT name, coalesce(init_reply, init_own, note, tools_own) IS NULL AS healthy,
       CASE WHEN init_reply IS NOT NULL THEN init_status WHEN init_own IS NOT NULL THEN 200
            WHEN note IS NOT NULL THEN 500 ELSE 200 END AS status_code,
       TIMESTAMP '2024-01-01' + to_seconds(p_partkey + 1) AS last_check_time,
       coalesce(init_reply, init_own, note, tools_own, 'MCP tool validation succeeded (' || n_tools || ' tools)')
         AS message,
       'https://tools.example.test/' || b AS url, 200 AS expected_status, cycle_id, CAST(1000000 AS BIGINT) AS duration_us,
       'mcp' AS mode, b % 4 <> 2 AS to_metrics, b % 4 >= 2 AS to_lines
FROM stages
""",
    "stages",
)
_part(
    "cr",
    """
SELECT probe AS name, false AS healthy, 0 AS status_code,
       TIMESTAMP '2024-01-01' + to_minutes(k) + INTERVAL 1 MILLISECOND AS last_check_time, config_error AS message,
       url, expected_status, 'first-' || k AS cycle_id, CAST(1000 AS BIGINT) AS duration_us, 'config_error' AS mode,
       coalesce(contains(outputs, 'prometheus'), true) AS to_metrics,
       coalesce(contains(outputs, 'stdout'), false) AS to_lines
FROM probes WHERE config_error IS NOT NULL
""",
    "probes",
)

# ---- FX6: orders as results, customers as statuses -------------------------------------------------

_part(
    "ol",
    """
SELECT 'canary-' || o_custkey AS name, CASE WHEN o_orderstatus = 'F' THEN 'Healthy' ELSE 'Unhealthy' END AS new_phase,
       o_orderdate AS new_last_check_time,
       CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 503 ELSE 0 END AS new_last_status,
       CASE o_orderstatus WHEN 'F' THEN 'Got expected status 200' WHEN 'O' THEN 'Expected 200 but got 503'
            ELSE 'http request failed: connection refused' END AS new_message
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""",
)
_part(
    "st",
    """
SELECT 'default' AS namespace, 'canary-' || c_custkey AS name, c_custkey, c_nationkey,
       CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN 'Unhealthy' ELSE 'Healthy' END AS phase,
       CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '2024-01-01' END AS last_check_time,
       CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN 503 ELSE 200 END AS last_status,
       CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN 'Expected 200 but got 503'
            ELSE 'Got expected status 200' END AS message
FROM customer
""",
)
_part(
    "sync",
    """
SELECT *, new_phase IS NOT NULL AND (phase IS NULL OR phase <> new_phase OR last_status <> new_last_status
                                     OR message <> new_message) AS changed
FROM st LEFT JOIN ol USING (name)
""",
    "st",
    "ol",
)
_part(
    "merged",
    """
SELECT namespace, name, c_custkey, c_nationkey, CASE WHEN changed THEN new_phase ELSE phase END AS phase,
       CASE WHEN changed THEN new_last_check_time ELSE last_check_time END AS last_check_time,
       CASE WHEN changed THEN new_last_status ELSE last_status END AS last_status,
       CASE WHEN changed THEN new_message ELSE message END AS message
FROM sync
""",
    "sync",
)

_STATUS = "namespace, name, phase, last_check_time, last_status, message"

_CHANGES = """
SELECT namespace, name, new_phase AS phase, new_last_check_time AS last_check_time, new_last_status AS last_status,
       new_message AS message
FROM sync WHERE changed
"""

ORACLES: dict[str, str] = {
    # sources and sinks
    "read_canaries": _sql(
        """
SELECT namespace, name, created_at, url, raw_method AS method, raw_interval AS interval_seconds,
       raw_status AS expected_status, probe_id, auth_type,
       CASE WHEN auth_type = 'apiKey' THEN secret_name END AS api_key_secret,
       CASE WHEN has_mcp THEN raw_min_tools END AS min_tool_count,
       CASE WHEN has_journey THEN url || '/open' END AS first_step_url, outputs
FROM canaries
""",
        "canaries",
    ),
    "read_probes": _sql(
        """
SELECT p.probe AS name, p.url, p.method, p.interval_seconds, p.expected_status, p.good_auth AS auth_type,
       CASE WHEN p.good_auth IS NOT NULL THEN r.credential_id END AS first_credential_id, p.config_error
FROM probes p LEFT JOIN refs r ON r.namespace = p.namespace AND r.name = p.name AND r.ord = 0
""",
        "probes",
        "refs",
    ),
    "read_credentials": _sql(
        """
SELECT e.credential_id, e.value FROM ref_errors e
WHERE NOT EXISTS (SELECT 1 FROM auth_errors a WHERE a.namespace = e.namespace AND a.name = e.name)
""",
        "ref_errors",
        "auth_errors",
    ),
    "read_exchanges": _sql(
        "SELECT cycle_id, probe, seq, stage, started_at, status_code, CAST(length(text) AS INTEGER) AS body_chars FROM turns", "turns"
    ),
    "read_results": _sql(
        "SELECT name, healthy, status_code, last_check_time, message, url, expected_status FROM er WHERE to_lines", "er"
    ),
    "results_from_text": _sql(
        "SELECT name, healthy, status_code, last_check_time, message, url, expected_status FROM er_latest", "er_latest"
    ),
    "write_result_lines": _sql(_JSON.format(name="", source="er WHERE to_lines"), "er"),
    "results_snapshot": _sql(_JSON.format(name="name,", source="er_latest"), "er_latest"),
    "write_exposition": _sql("SELECT line FROM lines", "lines"),
    "write_statuses": _sql(f"SELECT {_STATUS} FROM merged", "merged"),
    "write_status_changes": _sql(_CHANGES, "sync"),
    # declarations
    "spec_defaults": _sql(
        """
SELECT namespace, name, method, interval_seconds, expected_status,
       CASE WHEN has_journey THEN 'GET,post' END AS step_methods,
       CASE WHEN has_journey THEN '200,201' END AS step_statuses,
       CASE WHEN has_mcp THEN '2025-11-25' END AS protocol_version,
       CASE WHEN has_mcp THEN 'probelens' END AS client_name,
       CASE WHEN has_mcp THEN '0.1.0' END AS client_version,
       CASE WHEN has_mcp THEN true END AS require_tools_capability
FROM declared
""",
        "declared",
    ),
    "spec_violations": _sql(
        """
SELECT d.namespace, d.name, coalesce(string_agg(v.code, ';' ORDER BY v.rank), '') AS violations
FROM declared d LEFT JOIN violated v USING (namespace, name) GROUP BY d.namespace, d.name
""",
        "violated",
    ),
    "valid_canaries": _sql(
        """
SELECT namespace, name FROM declared d
WHERE NOT EXISTS (SELECT 1 FROM violated v WHERE v.namespace = d.namespace AND v.name = d.name)
""",
        "violated",
    ),
    "rejected_canaries": _sql(
        "SELECT namespace, name, CAST(count(*) AS INTEGER) AS n_violations FROM violated GROUP BY namespace, name", "violated"
    ),
    "probe_set": _sql(
        """
SELECT probe AS name, url, method, body, interval_seconds, expected_status, probe_id, min_tool_count,
       CASE WHEN has_journey THEN 'open,submit' END AS step_names, outputs
FROM declared
""",
        "declared",
    ),
    "journey_steps": _sql(
        """
SELECT d.probe, s.position, s.name, d.url || '/' || s.name AS url, s.method, s.expected_status
FROM declared d JOIN (VALUES (1, 'open', 'GET', 200), (2, 'submit', 'post', 201))
  AS s(position, name, method, expected_status) ON d.has_journey
""",
        "declared",
    ),
    "probe_mode": _sql("SELECT probe AS name, mode FROM probes", "probes"),
    "output_routing": _sql(
        """
SELECT probe AS name, outputs IS NULL OR contains(outputs, 'prometheus') AS to_metrics,
       outputs IS NOT NULL AND contains(outputs, 'stdout') AS to_lines
FROM declared
""",
        "declared",
    ),
    "request_plan": _sql(
        """
SELECT p.probe, r.seq, coalesce(r.stage, 'request') AS stage, coalesce(r.method, p.method) AS method,
       p.url || r.path AS url,
       CASE p.mode WHEN 'journey' THEN ''
         WHEN 'single' THEN coalesce('X-Probe-Id=' || p.probe_id, '')
         ELSE 'Accept=application/json, text/event-stream;Content-Type=application/json'
              || coalesce(';X-Probe-Id=' || p.probe_id, '') END AS headers,
       CASE p.mode WHEN 'single' THEN coalesce(p.body, '') ELSE r.body END AS body,
       p.good_auth AS auth_type,
       CASE p.good_auth WHEN 'apiKey' THEN 'X-Api-Key' WHEN 'basic' THEN 'Authorization'
                        WHEN 'bearer' THEN 'Authorization' END AS auth_header,
       CASE WHEN p.good_auth IS NOT NULL THEN c.ids END AS credential_ids
FROM probes p
JOIN (VALUES
  ('single', 0, NULL, NULL, '', NULL),
  ('journey', 0, 'open', 'GET', '/open', ''),
  ('journey', 1, 'submit', 'POST', '/submit', ''),
  ('mcp', 0, 'initialize', 'POST', '', '{"jsonrpc":"2.0","id":"probelens-initialize","method":"initialize","params":'
     || '{"protocolVersion":"2025-11-25","capabilities":{},"clientInfo":{"name":"probelens","version":"0.1.0"}}}'),
  ('mcp', 1, 'notifications/initialized', 'POST', '', '{"jsonrpc":"2.0","method":"notifications/initialized"}'),
  ('mcp', 2, 'tools/list', 'POST', '', '{"jsonrpc":"2.0","id":"probelens-tools-list","method":"tools/list"}'))
  AS r(mode, seq, stage, method, path, body) ON r.mode = p.mode
LEFT JOIN (SELECT namespace, name, string_agg(credential_id, ',' ORDER BY ord) AS ids FROM refs
           GROUP BY namespace, name) c ON c.namespace = p.namespace AND c.name = p.name
""",
        "probes",
        "refs",
    ),
    "planned_checks": _sql(
        """
SELECT probe AS name, CAST(n AS BIGINT) AS check_number,
       TIMESTAMP '2024-01-01' + to_seconds((n - 1) * interval_seconds) AS planned_at
FROM declared JOIN range(1, 102) AS t(n) ON (n - 1) * interval_seconds < 300
""",
        "declared",
    ),
    "current_specs": """
SELECT 'canary-' || o_custkey AS name, o_orderdate AS ts, o_orderkey AS seq, 'upsert' AS op,
       'https://shop.example.test/' || o_orderkey AS url
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1 AND o_orderpriority <> '5-LOW'
""".strip(),
    # auth
    "auth_references": _sql("SELECT namespace, name, ord, role, secret_name, key, credential_id FROM refs", "refs"),
    "resolve_auth": _sql(
        """
SELECT p.namespace, p.name, p.good_auth AS type,
       max(r.credential_id) FILTER (WHERE r.role = 'username') AS username_credential_id,
       max(r.credential_id) FILTER (WHERE r.role = 'password') AS password_credential_id,
       max(r.credential_id) FILTER (WHERE r.role = 'token') AS token_credential_id,
       CASE WHEN p.good_auth = 'apiKey' THEN 'x-api-key' END AS header_name,
       max(r.credential_id) FILTER (WHERE r.role = 'value') AS value_credential_id, p.config_error
FROM probes p
LEFT JOIN refs r ON r.namespace = p.namespace AND r.name = p.name AND p.good_auth IS NOT NULL
GROUP BY p.namespace, p.name, p.good_auth, p.config_error
""",
        "probes",
        "refs",
    ),
    "credential_store": _sql(
        """
SELECT credential_id, true AS value_present FROM ref_errors e
WHERE NOT EXISTS (SELECT 1 FROM auth_errors a WHERE a.namespace = e.namespace AND a.name = e.name)
""",
        "ref_errors",
        "auth_errors",
    ),
    "runtime_auth_errors": _sql(
        """
SELECT p.probe AS name, p.good_auth AS auth_type, 'missing credential "' || r.credential_id || '"' AS error
FROM probes p JOIN refs r ON r.namespace = p.namespace AND r.name = p.name AND r.ord = 0
WHERE p.good_auth IS NOT NULL
  AND EXISTS (SELECT 1 FROM violated v WHERE v.namespace = p.namespace AND v.name = p.name)
""",
        "probes",
        "refs",
        "violated",
    ),
    # evaluation
    "assemble_cycles": _sql(_CYCLES.format(where=""), "planned"),
    "cycles_with_probes": _sql(
        """
SELECT cycle_id, name AS probe, duration_us, 'single' AS mode, url,
       CASE WHEN wants_text THEN '"k": 6' END AS contains_text, to_metrics, to_lines
FROM ev
""",
        "ev",
    ),
    "config_error_results": _sql("SELECT * FROM cr", "cr"),
    "request_verdict": """
SELECT page_id, url, contains(html, 'lang="fr"') AS healthy, 200 AS status_code,
       CASE WHEN contains(html, 'lang="fr"') THEN 'Got expected status 200 and matched response text'
            ELSE 'Response body did not contain "lang=\\"fr\\""' END AS message, 200 AS expected_status
FROM pages
""".strip(),
    "single_results": _sql("SELECT * FROM er", "er"),
    "journey_results": _sql(_JOURNEYS.format(extra=""), "journeys"),
    "journey_results_from_exchanges": _sql(_JOURNEYS.format(extra=""), "journeys"),
    "incomplete_cycles": _sql(
        "SELECT cycle_id, probe AS name, 'journey' AS mode FROM journeys WHERE healthy AND NOT whole", "journeys"
    ),
    "unknown_cycles": _sql(
        "SELECT 'first-' || k AS cycle_id, probe FROM probes WHERE config_error IS NULL", "probes"
    ),
    "tick_results": _sql("SELECT * FROM cr", "cr"),
    "lost_responses": _sql(
        """
SELECT r.*, form
FROM (SELECT cycle_id, p_partkey % 7 AS k,
             CASE WHEN coalesce(init_reply, init_own) IS NOT NULL THEN 0 WHEN note IS NOT NULL THEN 1 ELSE 2 END AS decided
      FROM stages) s
JOIN pr r USING (cycle_id), (VALUES ('exchanges'), ('cycles')) AS f(form)
WHERE k <> 3 AND (decided < 1 OR k <> 2) AND (decided < 2 OR k <> 1)
""",
        "stages",
        "pr",
    ),
    "unplanned_exchanges": _sql(
        "SELECT cycle_id, probe, seq, stage, status_code FROM turns WHERE seq >= n_steps", "turns"
    ),
    "jsonrpc_stage": _sql(
        """
SELECT cycle_id, name, CASE WHEN init_reply IS NOT NULL THEN init_status END AS initialize_reply_status_code,
       init_reply AS initialize_reply_message, CASE WHEN tools_reply IS NOT NULL THEN 200 END AS tools_reply_status_code,
       tools_reply AS tools_reply_message
FROM stages
""",
        "stages",
    ),
    "mcp_initialize": _sql(
        """
SELECT cycle_id, name, CASE WHEN coalesce(init_reply, init_own) IS NOT NULL THEN init_status END
         AS initialize_status_code, coalesce(init_reply, init_own) AS initialize_message
FROM stages
""",
        "stages",
    ),
    "mcp_notification": _sql(
        """
SELECT cycle_id, name, CASE WHEN note IS NOT NULL THEN 500 END AS notification_status_code,
       note AS notification_message
FROM stages
""",
        "stages",
    ),
    "mcp_tools": _sql(
        """
SELECT cycle_id, name, CASE WHEN tools_own IS NOT NULL THEN 200 END AS tools_status_code, tools_own AS tools_message
FROM stages
""",
        "stages",
    ),
    "mcp_results": _sql("SELECT * FROM pr", "pr"),
    "mcp_results_from_exchanges": _sql("SELECT * FROM pr", "pr"),
    "check_results": _sql(
        """
SELECT * FROM er
UNION ALL BY NAME SELECT * FROM pr
UNION ALL BY NAME SELECT * FROM cr
""",
        "er",
        "pr",
        "cr",
    ),
    # metrics
    "checks_total": _sql(
        """
SELECT name, CASE WHEN healthy THEN 'success' ELSE 'failure' END AS result, count(*) AS value
FROM er WHERE to_metrics GROUP BY ALL
""",
        "er",
    ),
    "check_duration_histogram": _sql(
        "SELECT h.name, h.le, h.value, m.sum_us, m.n AS count FROM eh h JOIN em m USING (name)", "eh", "em"
    ),
    "healthy_gauge": _sql("SELECT name, value FROM eg", "eg"),
    "metric_exposition": _sql("SELECT metric, probe, line FROM lines", "lines"),
    # latest state and status
    "latest_results": _sql("SELECT * FROM er_latest", "er_latest"),
    "results_of_current_probes": _sql(
        "SELECT * FROM er WHERE expected_status = 200 AND last_check_time >= TIMESTAMP '2024-01-15'", "er"
    ),
    "reload_results": _sql(
        """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY last_check_time DESC, cycle_id DESC) AS rn
  FROM er WHERE expected_status = 200 AND last_check_time >= TIMESTAMP '2024-01-15')
WHERE rn = 1
""",
        "er",
    ),
    "status_candidates": _sql(
        f"SELECT {_STATUS}, new_phase, new_last_check_time, new_last_status, new_message FROM sync "
        "WHERE new_phase IS NOT NULL",
        "sync",
    ),
    "status_changes": _sql(_CHANGES, "sync"),
    "status_merge": _sql(f"SELECT {_STATUS} FROM merged", "merged"),
    "sync_summary": _sql(
        """
SELECT (SELECT count(*) FROM ol) AS results_received, (SELECT count(*) FROM st) AS canaries_checked,
       (SELECT count(*) FROM sync WHERE changed) AS statuses_updated
""",
        "sync",
    ),
    "status_history": _sql(_HISTORY, "daily"),
    "canary_listing": _sql(
        """
SELECT namespace, name, 'https://svc-' || c_nationkey || '.example.test/health' AS url, coalesce(phase, '') AS phase,
       date_diff('second', TIMESTAMP '2024-01-01' + to_minutes(c_custkey), TIMESTAMP '2024-02-01') AS age_seconds
FROM merged
""",
        "merged",
    ),
    # streams
    "stream_check_results": _sql("SELECT * FROM er", "er"),
    "stream_assemble_cycles": _sql(_CYCLES.format(where=""), "planned"),
    "stream_exchange_results": _sql(_JOURNEYS.format(extra=""), "journeys"),
    "stream_latest_results": _sql("SELECT * FROM er_latest", "er_latest"),
    "stream_metrics": _sql(
        """
SELECT m.name, m.success, m.failure, h.value AS within_100ms, m.sum_us, m.n, g.value AS last_healthy
FROM em m JOIN eh h ON h.name = m.name AND h.le = '0.1' JOIN eg g ON g.name = m.name
""",
        "em",
        "eh",
        "eg",
    ),
    "stream_status_history": _sql(_HISTORY, "daily"),
    "stream_result_lines": _sql(_JSON.format(name="", source="er WHERE to_lines"), "er"),
    "stream_probe_reload": _sql("SELECT * FROM er WHERE day(last_check_time) <= 20 OR right(url, 1) IN ('0', '2', '4', '6', '8')", "er"),
}
