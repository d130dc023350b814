"""SQL of `continuous`, written from the rules."""

from __future__ import annotations

from probelens.plans.oracles import _JOURNEYS, ORACLES, PARTS, _sql

_SYNC = """
SELECT namespace, name, coalesce(w.phase, st.phase) AS phase, coalesce(w.last_check_time, st.last_check_time) AS last_check_time,
       CASE WHEN w.phase IS NULL THEN st.last_status ELSE w.last_status END AS last_status,
       CASE WHEN w.phase IS NULL THEN st.message ELSE w.message END AS message, coalesce(w.writes, 0) AS writes
FROM st LEFT JOIN (
  SELECT c_custkey, count(*) AS writes, arg_max(phase, day) AS phase, arg_max(t, day) AS last_check_time,
         arg_max(status, day) AS last_status, arg_max(message, day) AS message
  FROM (
    SELECT p.*, row_number() OVER w AS i, lag(p.phase) OVER w AS before, lag(p.status) OVER w AS before_status,
           lag(p.message) OVER w AS before_message, s.phase AS own, s.last_status AS own_status, s.message AS own_message
    FROM (
      SELECT o_custkey AS c_custkey, date_trunc('day', o_orderdate) AS day, o_orderdate AS t,
             CASE o_orderstatus WHEN 'F' THEN 'Healthy' ELSE 'Unhealthy' END AS phase,
             CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 503 ELSE 0 END AS status,
             CASE o_orderstatus WHEN 'F' THEN 'Got expected status 200' WHEN 'O' THEN 'Expected 200 but got 503'
                  ELSE 'http request failed: connection refused' END AS message
      FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey, date_trunc('day', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    ) p JOIN st s USING (c_custkey)
    WINDOW w AS (PARTITION BY c_custkey ORDER BY day))
  WHERE CASE WHEN i > 1 THEN before <> phase OR before_status <> status OR before_message <> message
             ELSE own IS NULL OR own <> phase OR own_status <> status OR own_message <> message END
  GROUP BY c_custkey
) w USING (c_custkey)
"""

_FEED_KEYS = " WHERE (n.n_nationkey % 4 <> 1 OR n.n_nationkey % 8 = 1) AND (n.n_nationkey % 4 <> 2 OR x.key <> 'key')"
_FEED = _sql(
    """
SELECT probe AS name,
       CASE WHEN k % 14 = 2 THEN 'https://again-' || k || '.example.test/' WHEN k % 5 = 1 THEN 'https://new-' || k || '.example.test/'
            ELSE url END AS url, good_auth AS auth_type, config_error
FROM probes
WHERE (k % 7 <> 2 OR k % 14 = 2) AND NOT EXISTS (SELECT 1 FROM violated v WHERE v.namespace = probes.namespace AND v.name = probes.name)
""",
    "probes",
    "violated",
).replace(PARTS["secret_keys"][1].strip(), PARTS["secret_keys"][1].strip() + _FEED_KEYS)

_LATE = """
, arrivals AS (
  SELECT *, least(floor(3.0 * (epoch(cycle_started_at) + 120 * (seq % 3) - first) / (last - first + 1)), 2) AS step
  FROM turns, (SELECT epoch(min(cycle_started_at)) AS first, epoch(max(cycle_started_at)) AS last FROM turns)),
arrived AS (SELECT * FROM arrivals UNION ALL SELECT * REPLACE (least(step + 1, 2) AS step) FROM arrivals WHERE (conv_id + seq) % 4 = 0),
marks AS (SELECT s.step, (SELECT max(cycle_started_at) FROM arrived WHERE step < s.step) - INTERVAL 130 SECOND AS mark FROM (VALUES (0), (1), (2)) s(step)),
told AS (SELECT *, coalesce(cycle_started_at < mark, false) AS is_late, seq < n_steps AS planned FROM arrived JOIN marks USING (step)),
closed AS (SELECT max(cycle_started_at) - INTERVAL 130 SECOND AS mark FROM told WHERE NOT is_late AND planned)
SELECT probe, count(*) AS arrived, count(*) FILTER (WHERE is_late) AS late, count(*) FILTER (WHERE NOT is_late AND NOT planned) AS unplanned,
       count(*) FILTER (WHERE NOT is_late AND planned AND cycle_started_at < closed.mark) AS emitted,
       count(*) FILTER (WHERE NOT is_late AND planned AND cycle_started_at >= closed.mark) AS pending
FROM told, closed GROUP BY probe
"""

_LAST = """
SELECT * EXCLUDE (step) FROM (
  SELECT *, CASE WHEN d < 10 THEN 0 WHEN d < 20 THEN 1 ELSE 2 END AS step FROM (
    SELECT *, date_diff('day', DATE '2024-01-01', CAST(last_check_time + CASE WHEN CAST(cycle_id AS BIGINT) % 5 = 0 THEN INTERVAL 1800 SECOND
                                                                               ELSE INTERVAL 0 SECOND END AS DATE)) AS d FROM er))
QUALIFY row_number() OVER (PARTITION BY name ORDER BY step DESC, CAST(cycle_id AS BIGINT)) = 1
"""

ORACLES |= {
    "stream_status_sync": _sql(_SYNC, "st"),
    "stream_probe_feed": _FEED,
    "results_from_buckets": _sql(_JOURNEYS.format(extra="") + " UNION ALL BY NAME SELECT * FROM pr", "journeys", "pr"),
    "stream_late_rows": _sql("", "turns").rstrip() + _LATE,
    "stream_last_arrivals": _sql(_LAST.replace("EXCLUDE (step)", "EXCLUDE (step, d)"), "er"),
    "read_with_quarantine": _sql("SELECT namespace, name, created_at, url FROM canaries WHERE k % 8 NOT IN (3, 5)", "canaries"),
    "quarantined_lines": _sql(
        """
SELECT CAST(k AS INTEGER) AS shard, CASE k WHEN 3 THEN 'does not decode' ELSE 'has no metadata.namespace or no metadata.name' END AS cause,
       '{"metadata":' AS line_begins
FROM canaries WHERE k IN (3, 5)
""",
        "canaries",
    ),
    "metric_rollup": ORACLES["stream_metrics"],
    "latest_from_days": ORACLES["latest_results"],
    "observed_sync": ORACLES["sync_summary"],
}
