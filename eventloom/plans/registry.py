"""Where queries and their SQL are registered, and SQL for the canonical inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"registered twice: {name}")
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


#: The SQL twins of sources.samples, to stand after WITH.
EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS session_id, 'p' || CAST(user_id % 5 AS VARCHAR) AS project_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, 'sdk' AS source, event_type AS kind,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, ts AS utc_timestamp,
         CAST(round(value * 100) AS BIGINT) * 10000 AS duration_ns, props AS payload FROM events
)"""
SES = (
    EV
    + """, ses AS (
  SELECT session_id, min(project_id) AS project_id, min(utc_timestamp) AS started_at, max(utc_timestamp) AS stopped_at, count(*) AS source_event_count,
         CASE WHEN arg_max(kind, sequence) = 'error' THEN 'failed' ELSE 'complete' END AS state,
         CASE WHEN arg_max(kind, sequence) = 'error' THEN 1 ELSE 0 END AS exit_code,
         'job' || CAST(CAST(session_id AS BIGINT) % 10 AS VARCHAR) AS command, 'l' || CAST(CAST(session_id AS BIGINT) % 3 AS VARCHAR) AS label
  FROM ev GROUP BY session_id
)"""
)
PAIRS = """pairs AS (
  SELECT CAST(a.user_id AS VARCHAR) AS baseline, CAST(a.user_id + 1 AS VARCHAR) AS candidate
  FROM (SELECT DISTINCT user_id FROM events) a JOIN (SELECT DISTINCT user_id FROM events) b ON b.user_id = a.user_id + 1
)"""
TREE = EV + """, tree AS (
  SELECT c.*, p.event_id AS parent_event_id FROM ev c LEFT JOIN ev p ON p.session_id = c.session_id AND c.sequence > 0 AND p.sequence = (c.sequence - 1) // 2
)"""
TURNS = """turns AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS event_id, CAST(conv_id AS VARCHAR) AS session_id, turn AS sequence, coalesce(role, 'none') AS kind,
         '{"classification":"public","event_id":"' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '","kind":"' || coalesce(role, 'none') || '","monotonic_ns":' || CAST(turn AS VARCHAR)
         || ',"payload":{"text":"' || sha256(coalesce(text, '')) || '"},"payload_version":1,"project_id":"p0","sequence":' || CAST(turn AS VARCHAR) || ',"session_id":"' || CAST(conv_id AS VARCHAR)
         || '","severity":"info","source":"chat","utc_timestamp":"' || strftime(make_timestamp((1700000000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || '000Z"}' AS canonical
  FROM conversations
)"""
SEALED = TURNS + """, sealed AS (
  SELECT session_id, event_id, sequence, repeat('0', 64) AS previous_hash, sha256(sha256(canonical) || '|' || repeat('0', 64)) AS current_hash FROM turns WHERE sequence = 0
  UNION ALL
  SELECT t.session_id, t.event_id, t.sequence, s.current_hash, sha256(sha256(t.canonical) || '|' || s.current_hash)
  FROM sealed s JOIN turns t ON t.session_id = s.session_id AND t.sequence = s.sequence + 1
)"""
CALLS = """calls AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS event_id, CAST(l_orderkey AS VARCHAR) AS session_id, CAST(l_linenumber AS BIGINT) AS sequence,
         CAST(round(l_extendedprice) AS BIGINT) * 1000 AS duration_ns, l_shipdate AS utc_timestamp,
         'SELECT * FROM part  WHERE p_partkey = ' || CAST(l_partkey AS VARCHAR) || ' AND p_brand = ''' || l_returnflag || '''' AS sql,
         'SELECT * FROM part WHERE p_partkey = ? AND p_brand = ' || CASE WHEN l_linenumber % 2 = 0 THEN '?' ELSE '''x''' END AS sql_normalized
  FROM lineitem
)"""
PROV = """edges AS (
  SELECT CAST(n_nationkey AS BIGINT) AS edge_seq, 'r' || n_regionkey AS "from", 'n' || n_nationkey AS "to", 'Contains' AS kind, (CAST(n_nationkey AS BIGINT) % 7) / 4.0 AS weight FROM nation
  UNION ALL SELECT c_custkey + 1000, 'n' || c_nationkey, 'c' || c_custkey, 'Serves', ((c_custkey + 1000) % 7) / 4.0 FROM customer
  UNION ALL SELECT s_suppkey + 1000000000, 'n' || s_nationkey, 's' || s_suppkey, 'Supplies', ((s_suppkey + 1000000000) % 7) / 4.0 FROM supplier
  UNION ALL SELECT o_orderkey + 2000000000, 'c' || o_custkey, 'o' || o_orderkey, 'Places', ((o_orderkey + 2000000000) % 7) / 4.0 FROM orders
), nodes AS (SELECT "from" AS id FROM edges UNION SELECT "to" FROM edges)"""
REG = """subjects AS (SELECT 'c' || c_custkey AS id, c_name AS name, 'n' || c_nationkey AS region FROM customer),
elements AS (SELECT 'e' || p_partkey AS id, p_name AS name, p_brand AS category, CAST(p_size * 10 AS BIGINT) AS retention_days FROM part),
consents AS (
  SELECT 'k' || o_orderkey AS id, 'c' || o_custkey AS subject_id, o_orderpriority AS purpose, epoch_us(o_orderdate) * 1000 AS granted_at_ns,
         CASE WHEN o_orderstatus <> 'P' THEN epoch_us(o_orderdate) * 1000 + 2592000000000000 * (o_orderkey % 10) END AS expires_at_ns,
         CASE WHEN o_orderstatus = 'O' THEN 'withdrawn' ELSE 'granted' END AS status FROM orders
),
rules AS (SELECT 'r' || p_partkey AS id, p_brand AS category, CAST(200 + p_partkey % 200 AS BIGINT) AS max_retention_days FROM part WHERE p_partkey % 3 = 0),
requests AS (SELECT 'q' || o_orderkey AS id, 'c' || o_custkey AS subject_id, CASE WHEN o_orderkey % 50 = 0 THEN 'open' WHEN o_orderkey % 50 = 1 THEN 'in_progress' ELSE 'fulfilled' END AS status FROM orders),
active AS (SELECT * FROM consents WHERE status = 'granted' AND (expires_at_ns IS NULL OR {at} <= expires_at_ns)),
expired AS (SELECT * FROM consents WHERE status <> 'withdrawn' AND expires_at_ns IS NOT NULL AND {at} > expires_at_ns),
allowed AS (SELECT category, min(max_retention_days) AS allowed_days FROM rules GROUP BY category),
violations AS (SELECT e.id AS element_id, e.category, e.retention_days, a.allowed_days FROM elements e JOIN allowed a ON e.category = a.category WHERE e.retention_days > a.allowed_days),
cover AS (SELECT count(*) AS subjects, count(a.id) AS with_active_consent, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(a.id) / count(*) END AS coverage
          FROM subjects s LEFT JOIN (SELECT DISTINCT subject_id AS id FROM active) a ON a.id = s.id)"""
