"""Queries of the event operators: sources, predicates, joins, groups, windows, order."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import compare as cmp
from ..operators import filters as flt
from ..operators import graph
from ..schema import EVENT_COLUMNS, EVENT_DDL, is_terminal, severity_rank
from ..sources import bundles, samples, tables
from ..storage import fresh_path
from .registry import EV, PAIRS, SES, TREE, add

ev, ses, pairs = samples.events, samples.sessions, samples.pairs
BASE = ["event_id", "session_id", "sequence", "kind", "severity"]
BASE_SQL = "SELECT event_id, session_id, sequence, kind, severity FROM ev"




# ---- A: sources and sinks
def _stored(s, rows):
    """rows as an event table in the shared folder: (its path)."""
    path = fresh_path(s, "events")
    missing = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EVENT_DDL.split(", ") if x.split()[0] not in rows.columns]
    rows.select("*", *missing).select(*EVENT_COLUMNS).write.parquet(path)
    return path


add("A1_load_events", lambda s, d: tables.load_events(s, _stored(s, ev(s, d))).select(*BASE, "utc_timestamp", "duration_ns", "payload"), f"WITH {EV} SELECT event_id, session_id, sequence, kind, severity, utc_timestamp, duration_ns, payload FROM ev")
add(
    "A2_normalise_events",
    lambda s, d: tables.normalise_events(ev(s, d).withColumn("severity", F.when(F.col("kind") == "view", "loud").otherwise(F.col("severity"))).withColumn("classification", F.col("kind"))).select("event_id", "severity", "classification"),
    f"WITH {EV} SELECT event_id, severity, 'unclassified' AS classification FROM ev",
)


add(
    "A2_normalise_sessions",
    lambda s, d: tables.normalise_sessions(ses(s, d).withColumn("state", F.when(F.col("source_event_count") % 3 == 0, "paused").otherwise(F.col("state")))).select("session_id", "state"),
    f"WITH {SES} SELECT session_id, CASE WHEN source_event_count % 3 = 0 THEN 'failed' ELSE state END AS state FROM ses",
)


def _wire(s, d):
    e = ev(s, d)
    camel = F.to_json(F.struct(F.struct(F.col("event_id").alias("eventId"), F.col("session_id").alias("sessionId"), "sequence", "kind", F.lit("critical").alias("severity"), F.struct(F.lit("sdk").alias("kind")).alias("source"), F.col("duration_ns").alias("durationNs")).alias("event")))
    snake = F.to_json(F.struct("event_id", "session_id", "sequence", "kind", "severity", "source", "duration_ns"))
    return tables.from_wire(e.select(F.when(F.col("sequence") % 2 == 0, camel).otherwise(snake).alias("value"))).select(*BASE, "source", "duration_ns", "payload_version")


add("A3_from_wire", _wire, f"WITH {EV} SELECT event_id, session_id, sequence, kind, CASE WHEN sequence % 2 = 0 THEN 'fatal' ELSE severity END AS severity, source, duration_ns, CAST(1 AS INTEGER) AS payload_version FROM ev")
add("A4_get_event", lambda s, d: tables.get_event(ev(s, d), "17").select(*BASE), f"WITH {EV} {BASE_SQL} WHERE event_id = '17'")
add("A5_session_events", lambda s, d: tables.session_events(ev(s, d), "7").select(*BASE), f"WITH {EV} {BASE_SQL} WHERE session_id = '7'")
add(
    "A6_get_session",
    lambda s, d: tables.get_session(ses(s, d), ev(s, d)).select("session_id", "state", "event_count", "last_event_id"),
    f"WITH {SES} SELECT s.session_id, s.state, count(*) AS event_count, arg_max(e.event_id, e.sequence) AS last_event_id FROM ses s JOIN ev e ON e.session_id = s.session_id GROUP BY s.session_id, s.state",
)
add("A7_recent_sessions", lambda s, d: tables.recent_sessions(ses(s, d), 10, "p1").select("session_id", "started_at"), f"WITH {SES} SELECT session_id, started_at FROM ses WHERE project_id = 'p1' ORDER BY started_at DESC, session_id LIMIT 10")
def _appended(s, d):
    """A third of the events is stored, then all are appended twice: the rows that came by appending."""
    path = fresh_path(s, "store")
    tables.append_events(tables.load_events(s, _stored(s, ev(s, d).filter("sequence % 3 = 0"))), path)
    every = tables.load_events(s, _stored(s, ev(s, d)))
    for _ in range(2):
        tables.append_events(every, path)
    return tables.load_events(s, path).filter("sequence % 3 != 0").select(*BASE)


def _batch(s, d):
    """Errors arrive as a batch on top of all other events."""
    path = fresh_path(s, "store")
    tables.append_events(tables.load_events(s, _stored(s, ev(s, d).filter("kind != 'error'"))), path)
    return tables.append_batch(tables.load_events(s, _stored(s, ev(s, d).filter("kind = 'error'"))), path)


add(
    "A8_append_events",
    _appended,
    f"WITH {EV} {BASE_SQL} WHERE sequence % 3 <> 0",
)
add(
    "A9_recount",
    _batch,
    f"WITH {EV} SELECT session_id, count(*) AS source_event_count FROM ev WHERE session_id IN (SELECT session_id FROM ev WHERE kind = 'error') GROUP BY session_id",
)


def _log(s, d):
    return ev(s, d).select("session_id", F.when(F.col("sequence") == 0, "recording").when(F.col("kind") == "error", "failed").otherwise("complete").alias("state"), F.col("sequence").alias("updated_at"))


add("A10_update_session_state", lambda s, d: tables.latest_sessions(_log(s, d)), f"WITH {EV} SELECT session_id, CASE WHEN sequence = 0 THEN 'recording' WHEN kind = 'error' THEN 'failed' ELSE 'complete' END AS state, sequence AS updated_at FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC) = 1")


def _lifecycle(s, d):
    n = F.count(F.lit(1)).over(W.partitionBy("session_id"))
    e = ev(s, d).withColumn("__n", n)
    last = (F.col("sequence") == F.col("__n") - 1) & (F.col("__n") % 3 != 0)
    kind = F.when(F.col("sequence") == 0, "session.started").when(last, "session.stopped").otherwise(F.col("kind"))
    load = F.when(F.col("sequence") == 0, F.concat(F.lit('{"command":"c'), F.col("session_id"), F.lit('","label":"l"}'))).when(last, F.concat(F.lit('{"exit_code":'), (F.col("__n") % 2).cast("string"), F.lit("}"))).otherwise(F.col("payload"))
    return e.withColumns({"kind": kind, "payload": load}).drop("__n")


add(
    "A11_derive_sessions",
    lambda s, d: tables.derive_sessions(_lifecycle(s, d)).select("session_id", "command", "label", "source_event_count", "exit_code", "state", "started_at", "stopped_at"),
    f"""WITH {EV}, g AS (SELECT session_id, count(*) AS n, min(utc_timestamp) AS started_at, arg_max(utc_timestamp, sequence) AS last_at FROM ev GROUP BY session_id)
SELECT session_id, CASE WHEN n = 1 AND FALSE THEN NULL ELSE 'c' || session_id END AS command, 'l' AS label, n AS source_event_count,
       CAST(CASE WHEN n > 1 AND n % 3 <> 0 THEN n % 2 END AS INTEGER) AS exit_code,
       CASE WHEN n = 1 OR n % 3 = 0 THEN 'recording' WHEN n % 2 = 0 THEN 'complete' ELSE 'failed' END AS state, started_at, CASE WHEN n > 1 AND n % 3 <> 0 THEN last_at END AS stopped_at FROM g""",
)


def _projects(s, d):
    return ses(s, d).select("project_id").distinct().withColumn("root", F.concat(F.lit("/r/"), F.col("project_id")))


add(
    "A12_ensure_projects",
    lambda s, d: tables.ensure_projects(_projects(s, d).filter("project_id < 'p2'"), _projects(s, d).withColumn("root", F.lit("new"))),
    f"WITH {SES} SELECT DISTINCT project_id, CASE WHEN project_id < 'p2' THEN '/r/' || project_id ELSE 'new' END AS root FROM ses",
)
add(
    "A13_resolve_project",
    lambda s, d: tables.resolve_project(_projects(s, d), ses(s, d), "/r/p3"),
    f"WITH {SES}, last AS (SELECT project_id FROM ses ORDER BY started_at DESC, session_id LIMIT 40) SELECT DISTINCT project_id, '/r/' || project_id AS root FROM last WHERE project_id = 'p3'",
)
add(
    "A17_compatible_versions",
    lambda s, d: ses(s, d).select("session_id", F.concat(F.lit("run-bundle@"), (F.col("session_id").cast("long") % 12).cast("string"), F.when(F.col("session_id").cast("long") % 2 == 0, ".0.0").otherwise("")).alias("version")).withColumn("ok", bundles.compatible(F.col("version"))),
    f"""WITH {SES}, v AS (SELECT session_id, 'run-bundle@' || (CAST(session_id AS BIGINT) % 12) || CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN '.0.0' ELSE '' END AS version FROM ses)
SELECT session_id, version, regexp_matches(version, '^run-bundle@1(\\.|$)') AS ok FROM v""",
)
add(
    "A18_sessions_to_archive",
    lambda s, d: bundles.sessions_to_archive(ses(s, d), 20, ses(s, d).filter("state = 'failed'"), 100).select("session_id"),
    f"WITH {SES}, n AS (SELECT session_id, state, row_number() OVER (ORDER BY started_at DESC, session_id) AS n FROM ses) SELECT session_id FROM n WHERE n > 20 AND n <= 120 AND state <> 'failed'",
)

# ---- B: predicates
where = lambda *p: lambda s, d: ev(s, d).filter(p[0]() if callable(p[0]) else p[0]).select(*BASE)
add("B1_select_source", lambda s, d: flt.select_source({"events": ev(s, d), "sessions": ses(s, d)}, "sessions").select("session_id", "state"), f"WITH {SES} SELECT session_id, state FROM ses")
add("B2_compare", where(lambda: flt.compare("sequence", ">=", 3) & flt.compare("sequence", "<", 30) & flt.compare("kind", "!=", "view")), f"WITH {EV} {BASE_SQL} WHERE sequence >= 3 AND sequence < 30 AND kind <> 'view'")
add("B3_pattern", where(lambda: flt.compare("kind", "~=", "%RR_R")), f"WITH {EV} {BASE_SQL} WHERE kind ILIKE '%RR_R'")
add("B4_null_test", lambda s, d: samples.with_parents(ev(s, d)).filter(flt.compare("parent_event_id", "=", None)).select(*BASE), f"WITH {TREE} SELECT event_id, session_id, sequence, kind, severity FROM tree WHERE parent_event_id IS NULL")
add("B5_boolean", where(lambda: flt.compare("error", "=", True)), f"WITH {EV} {BASE_SQL} WHERE kind LIKE '%error%' OR severity IN ('error', 'fatal')")
add("B6_field_to_field", where(lambda: flt.compare("kind", "=", F.col("severity"))), f"WITH {EV} {BASE_SQL} WHERE kind = severity")
add("B7_logic", where(lambda: ~((flt.compare("kind", "=", "click") | flt.compare("kind", "=", "view")) & flt.compare("sequence", ">", 5))), f"WITH {EV} {BASE_SQL} WHERE NOT ((kind = 'click' OR kind = 'view') AND sequence > 5)")
add("B8_field_aliases", lambda s, d: ev(s, d).filter(flt.compare("duration_ms", ">", 100)).select(flt.field("id").alias("id"), flt.field("timestamp").alias("at"), flt.field("duration_ms").alias("ms")), f"WITH {EV} SELECT event_id AS id, utc_timestamp AS at, duration_ns / 1e6 AS ms FROM ev WHERE duration_ns / 1e6 > 100")
add("B8_label", lambda s, d: ses(s, d).filter(flt.compare("label", "=", "l1")).select("session_id"), f"WITH {SES} SELECT session_id FROM ses WHERE label = 'l1'")
add("B9_dotted_field", lambda s, d: ev(s, d).select("event_id", flt.field("payload.k").cast("long").alias("k")), f"WITH {EV} SELECT event_id, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM ev")
add("B10_show", lambda s, d: flt.show(ev(s, d), find="9", severity="INFO").select(*BASE), f"WITH {EV} {BASE_SQL} WHERE (contains(kind, '9') OR contains(payload, '9')) AND severity = 'info'")
add("B11_find_errors", lambda s, d: flt.find_errors(ev(s, d)).drop("current_hash"), f"WITH {EV} SELECT session_id, sequence, kind, severity, utc_timestamp, payload FROM ev WHERE kind LIKE '%error%'")
add("B12_subscription_filter", lambda s, d: flt.subscription_filter(ev(s, d), "3").select(*BASE), f"WITH {EV} {BASE_SQL} WHERE session_id = '3'")
_FILES = """files AS (SELECT p_partkey AS file_id, ['/proj/src/', '/proj/node_modules/x/', '/proj2/src/', 'C:\\proj\\', '/proj/.git/'][p_partkey % 5 + 1] || 'f' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.rs' END AS path,
  ['create', 'modify', 'remove', 'modify.name', 'any', 'access'][p_partkey % 6 + 1] AS raw_kind FROM part)"""
add("B13_watch_filter", lambda s, d: flt.watch_filter(samples.file_events(s, d), "/proj").select("file_id", "path"), f"WITH {_FILES} SELECT file_id, path FROM files WHERE starts_with(path, '/proj/') AND NOT contains(path, '/node_modules/') AND NOT contains(path, '/.git/')")


def _actions(s, d):
    from ..functions.text import extension, fs_action

    return samples.file_events(s, d).select("file_id", fs_action(F.col("raw_kind")).alias("action"), extension(F.col("path")).alias("ext")).filter("action IS NOT NULL")


add("B14_fs_action", _actions, f"WITH {_FILES} SELECT file_id, CASE raw_kind WHEN 'modify.name' THEN 'rename' WHEN 'any' THEN 'other' ELSE raw_kind END AS action, CASE WHEN ends_with(path, '.rs') THEN 'rs' END AS ext FROM files WHERE raw_kind <> 'access'")


def _statuses(s, d):
    from ..functions.text import exit_severity, http_severity

    status = (F.lit(200) + (F.col("event_id").cast("long") % 4) * 100).cast("int")
    return ev(s, d).select("event_id", http_severity(status).alias("http"), exit_severity(F.col("sequence") % 2).alias("exit"))


add("B15_B16_severities", _statuses, f"WITH {EV} SELECT event_id, CASE CAST(event_id AS BIGINT) % 4 WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS http, CASE WHEN sequence % 2 = 0 THEN 'info' ELSE 'warning' END AS exit FROM ev")
add("B17_rows_as_json", lambda s, d: flt.rows_as_json(ev(s, d).select("event_id", "sequence", "kind")), f"""WITH {EV} SELECT '{{"event_id":"' || event_id || '","sequence":' || sequence || ',"kind":"' || kind || '"}}' AS row FROM ev""")
add("B18_severity_rank", where(lambda: severity_rank() >= 2), f"WITH {EV} {BASE_SQL} WHERE severity IN ('error', 'fatal')")
add("B19_terminal_sessions", lambda s, d: ses(s, d).select("session_id", is_terminal().alias("terminal")), f"WITH {SES} SELECT session_id, state IN ('complete', 'failed') AS terminal FROM ses")

# ---- C: joins over events
add("C4_within_before", lambda s, d: flt.within(ev(s, d), 86_400.0, "before", "signup").select(*BASE), f"WITH {EV}, a AS (SELECT max(utc_timestamp) AS t FROM ev WHERE kind = 'signup') SELECT event_id, session_id, sequence, kind, severity FROM ev, a WHERE utc_timestamp < t AND utc_timestamp >= t - INTERVAL 1 DAY")
add(
    "C4_within_after_per_session",
    lambda s, d: flt.within(ev(s, d), 3 * 86_400.0, "after", "error", per_session=True).select(*BASE),
    f"WITH {EV}, a AS (SELECT session_id, max(utc_timestamp) AS t FROM ev WHERE kind = 'error' GROUP BY session_id) SELECT event_id, ev.session_id, sequence, kind, severity FROM ev JOIN a ON a.session_id = ev.session_id WHERE utc_timestamp > t AND utc_timestamp <= t + INTERVAL 3 DAY",
)
add("C4_within_unbounded", lambda s, d: flt.within(ev(s, d), 1.0, "after", "signup", bounded=False).select(*BASE), f"WITH {EV}, a AS (SELECT max(utc_timestamp) AS t FROM ev WHERE kind = 'signup') SELECT event_id, session_id, sequence, kind, severity FROM ev, a WHERE utc_timestamp > t")

# ---- D: aggregation
add("D1_group_events", lambda s, d: agg.group_events(ev(s, d), ["session_id", "kind"]), f"WITH {EV} SELECT session_id, kind, count(*) AS count, count(*) FILTER (kind = 'error') AS errors, min(utc_timestamp) AS first_at, max(utc_timestamp) AS last_at, arg_min(event_id, (utc_timestamp, event_id)) AS first_event_id FROM ev GROUP BY session_id, kind")
add("D2_event_counts", lambda s, d: agg.event_counts(ev(s, d)), f"WITH {EV} SELECT session_id, count(*) AS source_event_count FROM ev GROUP BY session_id")
add(
    "D11_run_outcomes_by_label",
    lambda s, d: agg.run_outcomes(ses(s, d), ("command", "label")),
    f"""WITH {SES} SELECT command, label, count(*) FILTER (exit_code = 0) AS successes, count(*) FILTER (exit_code <> 0) AS failures,
count(*) FILTER (exit_code = 0) > 0 AND count(*) FILTER (exit_code <> 0) > 0 AS flaky FROM ses GROUP BY command, label""",
)
add("D11_run_outcomes", lambda s, d: agg.run_outcomes(ses(s, d)), f"WITH {SES} SELECT command, count(*) FILTER (exit_code = 0) AS successes, count(*) FILTER (exit_code <> 0) AS failures, count(*) FILTER (exit_code = 0) > 0 AND count(*) FILTER (exit_code <> 0) > 0 AS flaky FROM ses GROUP BY command")
add("D14_slowest_spans", lambda s, d: agg.slowest_spans(ev(s, d)).select("session_id", "event_id", "duration_ms"), f"WITH {EV}, m AS (SELECT *, duration_ns / 1e6 AS duration_ms, max(duration_ns / 1e6) OVER (PARTITION BY session_id) AS top FROM ev) SELECT session_id, event_id, duration_ms FROM m WHERE abs(duration_ms - greatest(top, 0.0)) < 0.001")


def _profile(s, d):
    load = F.to_json(F.struct((F.col("sequence") * 100 + 7).alias("rss"), (F.col("sequence") * 3).alias("virtual"), (F.col("sequence") % 5).alias("page_faults")))
    return agg.resource_profile(ev(s, d).withColumns({"payload": load, "kind": F.when(F.col("kind") == "view", "profiler.sample").otherwise(F.col("kind"))}))


add("D15_resource_profile", _profile, f"WITH {EV} SELECT session_id, count(*) AS samples, min(sequence * 100 + 7) AS rss_min, avg(sequence * 100 + 7) AS rss_avg, max(sequence * 100 + 7) AS rss_max, max(sequence % 5) AS page_faults FROM ev WHERE kind = 'view' GROUP BY session_id")

def _profile_batches(s, d):
    """Samples come in two batches; their parts are merged, merged again with nothing, and reported."""
    load = F.to_json(F.struct(((F.col("sequence") * 7919) % 1009).alias("rss_bytes"), (F.col("sequence") * 3).alias("virtual_bytes"), (F.col("sequence") % 5).alias("page_faults"), F.lit(1000).alias("system_mem_total"), (900 - F.col("sequence") % 50).alias("system_mem_avail")))
    e = ev(s, d).withColumns({"payload": load, "kind": F.when(F.col("kind") == "view", "profiler.sample").otherwise(F.col("kind"))})
    first, second = (agg.profile_parts(e.filter(F.col("event_id").cast("long") % 2 == k)) for k in (0, 1))
    return agg.profile_report(agg.merge_profiles(agg.merge_profiles(first).unionByName(second)))


add(
    "D15_profile_percentiles",
    _profile_batches,
    f"""WITH {EV}, p AS (SELECT session_id, (sequence * 7919) % 1009 AS rss, sequence * 3 AS virtual, sequence % 5 AS faults, 900 - sequence % 50 AS avail FROM ev WHERE kind = 'view')
SELECT session_id, count(*) AS samples, min(rss) AS rss_min, avg(rss) AS rss_avg, max(rss) AS rss_max, quantile_disc(rss, 0.5) AS rss_p50, quantile_disc(rss, 0.95) AS rss_p95,
min(virtual) AS virtual_min, avg(virtual) AS virtual_avg, max(virtual) AS virtual_max, quantile_disc(virtual, 0.5) AS virtual_p50, quantile_disc(virtual, 0.95) AS virtual_p95,
max(faults) AS page_faults, 1000::BIGINT AS mem_total, min(avail) AS mem_avail_min FROM p GROUP BY session_id""",
)

# ---- E: windows
add("E1_assign_sequence", lambda s, d: flt.assign_sequence(ev(s, d).drop("sequence")).select("event_id", "sequence"), f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY session_id ORDER BY utc_timestamp, event_id) - 1 AS sequence FROM ev")
add("E2_cap_events", lambda s, d: flt.cap_events(ev(s, d), 10).select(*BASE), f"WITH {EV} {BASE_SQL} WHERE sequence < 10")
add("E3_first_flagged", lambda s, d: flt.first_flagged(ev(s, d)).select("session_id", "sequence", "event_id"), f"WITH {EV} SELECT session_id, min(sequence) AS sequence, arg_min(event_id, sequence) AS event_id FROM ev WHERE kind = 'error' GROUP BY session_id")
add("E4_tail_events", lambda s, d: flt.tail_events(ev(s, d), 5).select(*BASE), f"WITH {EV} {BASE_SQL} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC) <= 5")
add("E5_first_last_event", lambda s, d: flt.first_last_event(ev(s, d)), f"WITH {EV} SELECT session_id, arg_min(event_id, sequence) AS first_event_id, arg_max(event_id, sequence) AS last_event_id FROM ev GROUP BY session_id")
add("E6_keep_latest", lambda s, d: flt.keep_latest(ses(s, d), 25).select("session_id"), f"WITH {SES} SELECT session_id FROM ses ORDER BY started_at DESC, session_id LIMIT 25")
add("E7_rotation_due", lambda s, d: flt.rotation_due(ses(s, d), 50), f"WITH {SES} SELECT arg_max(source_event_count, (started_at, session_id)) AS newest_count, CAST(sum(source_event_count) AS BIGINT) AS total_count, arg_max(source_event_count, (started_at, session_id)) >= 50 AS due FROM ses")

# ---- F: order and limits
add("F1_order_events", lambda s, d: flt.order_events(ev(s, d), [("kind", False), ("sequence", True)]).select(*BASE), f"WITH {EV} {BASE_SQL} ORDER BY kind, sequence DESC")

# ---- C, F, I: comparison
PREC = """prec AS (
  SELECT f.session_id, f.first_error, max(e.sequence) AS sequence, arg_max(e.kind, e.sequence) AS kind
  FROM (SELECT session_id, min(sequence) AS first_error FROM ev WHERE kind = 'error' GROUP BY session_id) f
  JOIN ev e ON e.session_id = f.session_id AND e.kind <> 'error' AND e.sequence < f.first_error AND e.sequence >= f.first_error - 5 GROUP BY f.session_id, f.first_error
)"""
DELTA = """counts AS (SELECT session_id, kind, count(*) AS n FROM ev GROUP BY session_id, kind),
delta AS (
  SELECT baseline, candidate, kind, CAST(sum(base) AS BIGINT) AS base, CAST(sum(cand) AS BIGINT) AS cand FROM (
    SELECT baseline, candidate, kind, n AS base, 0 AS cand FROM pairs JOIN counts ON session_id = baseline
    UNION ALL SELECT baseline, candidate, kind, 0, n FROM pairs JOIN counts ON session_id = candidate) GROUP BY ALL
),
fresh AS (
  SELECT DISTINCT baseline, candidate, e.kind FROM pairs JOIN ev e ON e.session_id = candidate AND e.kind = 'error'
  WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.session_id = baseline AND b.kind = e.kind)
)"""
CMP = f"""{EV}, {PAIRS}, {PREC}, {DELTA}, div AS (
  SELECT baseline, candidate, 'New event kind appeared: ' || kind AS title, 'moderate' AS severity, 5 AS score, NULL::BIGINT AS sequence FROM delta WHERE base = 0 AND cand > 0
  UNION ALL SELECT baseline, candidate, 'Event kind increased: ' || kind, 'low', 3, NULL FROM delta WHERE base > 0 AND cand > base
  UNION ALL SELECT p.baseline, p.candidate, 'Event immediately preceded first failure: ' || r.kind, 'high', 8 + CASE WHEN strict_had THEN 0 ELSE 3 END, r.sequence
    FROM (SELECT pairs.*, FALSE AS strict_had FROM pairs) p JOIN prec r ON r.session_id = p.candidate
  UNION ALL SELECT baseline, candidate, 'New failure kind: ' || kind, 'high', 7, NULL FROM fresh
)"""
add("C5_preceding_event", lambda s, d: cmp.preceding_event(ev(s, d)), f"WITH {EV}, {PREC} SELECT session_id, first_error, sequence, kind FROM prec")
add("C6_kind_delta", lambda s, d: cmp.kind_delta(ev(s, d), pairs(s, d)), f"WITH {EV}, {PAIRS}, {DELTA} SELECT * FROM delta")


def _kinds_apart(s, d):
    """Errors of several kinds, so that sessions differ in those they have."""
    return ev(s, d).withColumn("kind", F.when(F.col("kind") == "error", F.concat(F.lit("error."), (F.col("event_id").cast("long") % 11).cast("string"))).otherwise(F.col("kind")))


add(
    "C7_G3_new_kinds_of_failure",
    lambda s, d: cmp.new_failure_kinds(_kinds_apart(s, d), pairs(s, d)),
    f"""WITH {EV}, {PAIRS}, k AS (SELECT DISTINCT session_id, 'error.' || (CAST(event_id AS BIGINT) % 11) AS kind FROM ev WHERE kind = 'error')
SELECT p.baseline, p.candidate, c.kind FROM pairs p JOIN k c ON c.session_id = p.candidate WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.session_id = p.baseline AND b.kind = c.kind)""",
)
add("C7_G3_new_failure_kinds", lambda s, d: cmp.new_failure_kinds(ev(s, d), pairs(s, d)), f"WITH {EV}, {PAIRS}, {DELTA} SELECT * FROM fresh")


def divergences(s, d):
    return cmp.compare_sessions(ev(s, d), pairs(s, d))


add("I1_compare_sessions", lambda s, d: divergences(s, d).select("baseline", "candidate", "title", "severity", "score", "sequence"), f"WITH {CMP} SELECT baseline, candidate, title, severity, CAST(score AS INTEGER) AS score, sequence FROM div")
add("I2_computed_severity", lambda s, d: divergences(s, d).select("baseline", "candidate", "title", cmp.computed_severity().alias("computed")), f"WITH {CMP} SELECT baseline, candidate, title, CASE WHEN score >= 15 THEN 'high' WHEN score >= 7 THEN 'moderate' ELSE 'low' END AS computed FROM div")
add("F2_top_divergences", lambda s, d: cmp.top_divergences(divergences(s, d), 2).select("baseline", "candidate", "title", "score", "rank"), f"WITH {CMP} SELECT baseline, candidate, title, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY baseline, candidate ORDER BY score DESC, title) AS INTEGER) AS rank FROM div QUALIFY rank <= 2")
VER = "ver AS (SELECT p.baseline, p.candidate, count(v.title) AS divergences, CASE WHEN count(v.title) = 0 THEN 'clean' WHEN bool_or(starts_with(v.title, 'New failure kind')) THEN 'broken' ELSE 'suspicious' END AS verdict FROM pairs p LEFT JOIN div v ON v.baseline = p.baseline AND v.candidate = p.candidate GROUP BY p.baseline, p.candidate)"
add("I3_verdict", lambda s, d: cmp.verdict(divergences(s, d), pairs(s, d)), f"WITH {CMP}, {VER} SELECT * FROM ver")


def _runs(s, d):
    return ses(s, d).select("command", "session_id", F.row_number().over(W.partitionBy("command").orderBy("started_at", "session_id")).alias("run"))


#: The comparison's SQL over other events and pairs.
_SIDES_CMP = re.sub(r"\bpairs\b", "sidepairs", re.sub(r"\bev\b", "sideev", CMP.removeprefix(f"{EV}, {PAIRS}, ")))
add(
    "I4_investigate",
    lambda s, d: cmp.investigate(ev(s, d), _runs(s, d)).select("command", "title", "severity", "score", "sequence"),
    f"""WITH {SES}, runs AS (SELECT command, session_id, row_number() OVER (PARTITION BY command ORDER BY started_at, session_id) AS run FROM ses),
l AS (SELECT session_id, arg_max(kind, sequence) AS kind FROM ev GROUP BY session_id),
sideev AS (SELECT (CASE WHEN run = 1 THEN 'first:' ELSE 'later:' END) || command AS session_id, kind, run AS sequence FROM runs JOIN l USING (session_id)),
sidepairs AS (SELECT DISTINCT 'first:' || command AS baseline, 'later:' || command AS candidate FROM runs WHERE run > 1),
{_SIDES_CMP} SELECT substr(candidate, 7) AS command, title, severity, CAST(score AS INTEGER) AS score, sequence FROM div""",
)
add(
    "I5_bug_report_rows",
    lambda s, d: cmp.bug_report_rows(ev(s, d), ses(s, d)),
    f"""WITH {SES} SELECT session_id, 'header' AS section, NULL::BIGINT AS sequence, state AS kind, CAST(source_event_count AS VARCHAR) AS detail FROM ses
UNION ALL (SELECT session_id, 'flagged', sequence, kind, payload FROM ev WHERE kind = 'error' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence) = 1)
UNION ALL (SELECT session_id, 'tail', sequence, kind, severity FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC) <= 20)""",
)
add(
    "I6_analysis_report_rows",
    lambda s, d: cmp.analysis_report_rows(divergences(s, d), pairs(s, d))[0],
    f"""WITH {CMP}, {VER}, lead AS (SELECT baseline, candidate, title, score FROM div QUALIFY row_number() OVER (PARTITION BY baseline, candidate ORDER BY score DESC, title) = 1)
SELECT v.baseline, v.candidate, 'Session ' || v.candidate || ' is ' || verdict AS title, verdict, divergences || ' divergences; the strongest is ''' || l.title || ''' with score ' || l.score || '.' AS summary
FROM ver v JOIN lead l ON l.baseline = v.baseline AND l.candidate = v.candidate WHERE verdict <> 'clean'""",
)
add(
    "I6_analysis_evidence",
    lambda s, d: cmp.analysis_report_rows(divergences(s, d), pairs(s, d))[1].select("baseline", "candidate", "rank", "title", "sequence"),
    f"WITH {CMP} SELECT baseline, candidate, CAST(row_number() OVER (PARTITION BY baseline, candidate ORDER BY score DESC, title) AS INTEGER) AS rank, title, sequence FROM div QUALIFY rank <= 5",
)


def _history(s, d):
    return _runs(s, d).join(ses(s, d).select("session_id", "state"), "session_id").select(F.col("command").alias("series"), F.col("run").alias("ord"), F.col("session_id").alias("commit"), F.when(F.col("state") == "failed", "bad").otherwise("good").alias("outcome"))


add(
    "I13_regression_onset",
    lambda s, d: agg.regression_onset(_history(s, d)),
    f"""WITH {SES}, h AS (SELECT command AS series, session_id AS commit, state = 'failed' AS bad, row_number() OVER (PARTITION BY command ORDER BY started_at, session_id) AS ord FROM ses),
g AS (SELECT *, coalesce(max(ord) FILTER (NOT bad) OVER (PARTITION BY series), -1) AS good FROM h)
SELECT series, arg_min(commit, ord) FILTER (bad AND ord > good) AS onset, NOT bool_or(bad AND ord < good) AS monotone FROM g GROUP BY series""",
)
add("I14_list_view", lambda s, d: flt.list_view(ses(s, d)), f"WITH {SES} SELECT session_id, state, started_at, stopped_at, source_event_count FROM ses")

add(
    "I14_show_view",
    lambda s, d: flt.show_view(ev(s, d).withColumn("current_hash", F.sha2("event_id", 256))),
    f"WITH {EV} SELECT session_id, sequence, kind, severity, utc_timestamp, left(sha256(event_id), 16) AS hash_prefix FROM ev",
)

# ---- C, G, J: event graphs
TREE_EDGES = TREE + ", tedges AS (SELECT c.session_id, c.parent_event_id AS \"from\", c.event_id AS \"to\", c.sequence AS to_sequence FROM tree c JOIN tree p ON p.session_id = c.session_id AND p.event_id = c.parent_event_id AND p.sequence <= c.sequence)"
tree = lambda s, d: samples.with_parents(ev(s, d))
add("C1_event_edges", lambda s, d: graph.event_edges(tree(s, d)), f"WITH {TREE_EDGES} SELECT * FROM tedges")


def _spans(s, d):
    return tree(s, d).select(F.col("session_id").alias("trace_id"), F.concat(F.lit("s"), F.col("event_id")).alias("span_id"), F.concat(F.lit("s"), F.col("parent_event_id")).alias("parent_span_id"))


add("C2_span_edges", lambda s, d: graph.span_edges(_spans(s, d)), f"WITH {TREE_EDGES} SELECT session_id AS trace_id, 's' || \"from\" AS \"from\", 's' || \"to\" AS \"to\" FROM tedges")
add("J1_build_graph", lambda s, d: graph.build_graph(tree(s, d))[0].select("id", "session_id", "name", "duration_ms", "sequence"), f"WITH {EV} SELECT event_id AS id, session_id, kind AS name, duration_ns / 1e6 AS duration_ms, sequence FROM ev")




def _pair_graphs(s, d):
    ids = F.concat(F.col("kind"), F.lit("-"), (F.col("sequence") % 40).cast("string")).alias("id")
    rows = ev(s, d).groupBy((F.col("session_id").cast("long") % 2).alias("side"), ids).agg((F.max("duration_ns") / 1e6).alias("duration_ms"))
    return [rows.filter(F.col("side") == k).drop("side") for k in (0, 1)]


_SIDES = "sides AS (SELECT CAST(session_id AS BIGINT) % 2 AS side, kind || '-' || (sequence % 40) AS id, max(duration_ns) / 1e6 AS duration_ms FROM ev GROUP BY ALL)"
add("C3_graph_diff", lambda s, d: graph.graph_diff(*_pair_graphs(s, d)), f"WITH {EV}, {_SIDES} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM sides WHERE side = 0) a FULL JOIN (SELECT * FROM sides WHERE side = 1) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.duration_ms IS DISTINCT FROM b.duration_ms")
add("G1_node_diff", lambda s, d: graph.set_diff(*[x.select("id") for x in _pair_graphs(s, d)]), f"WITH {EV}, {_SIDES}, a AS (SELECT id FROM sides WHERE side = 0), b AS (SELECT id FROM sides WHERE side = 1) (SELECT id, 'added' AS change FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) UNION ALL (SELECT id, 'removed' FROM (SELECT id FROM a EXCEPT SELECT id FROM b))")


def _some_nodes(s, d, side):
    return ev(s, d).filter(F.col("session_id").cast("long") % 2 == side).filter(F.col("event_id").cast("long") % 7 == side).select(F.concat("kind", F.lit("-"), F.col("sequence").cast("string")).alias("id")).distinct()


add(
    "G1_node_diff_of_runs",
    lambda s, d: graph.set_diff(_some_nodes(s, d, 0), _some_nodes(s, d, 1)),
    f"""WITH {EV}, n AS (SELECT DISTINCT CAST(session_id AS BIGINT) % 2 AS side, kind || '-' || sequence AS id FROM ev WHERE CAST(event_id AS BIGINT) % 7 = CAST(session_id AS BIGINT) % 2)
SELECT id, CASE WHEN min(side) = 1 THEN 'added' ELSE 'removed' END AS change FROM n GROUP BY id HAVING count(*) = 1""",
)


def _steps(s, d, side):
    k = F.concat(F.col("kind"), F.lit("-"), (F.col("sequence") % 40).cast("string"))
    w = W.partitionBy("session_id").orderBy("sequence")
    return ev(s, d).filter(F.col("session_id").cast("long") % 2 == side).select(F.lag(k).over(w).alias("from"), k.alias("to")).filter("`from` IS NOT NULL").distinct()


add(
    "G2_edge_diff",
    lambda s, d: graph.set_diff(_steps(s, d, 0), _steps(s, d, 1)),
    f"""WITH {EV}, k AS (SELECT CAST(session_id AS BIGINT) % 2 AS side, lag(kind || '-' || (sequence % 40)) OVER (PARTITION BY session_id ORDER BY sequence) AS f, kind || '-' || (sequence % 40) AS t FROM ev),
a AS (SELECT DISTINCT f, t FROM k WHERE side = 0 AND f IS NOT NULL), b AS (SELECT DISTINCT f, t FROM k WHERE side = 1 AND f IS NOT NULL)
SELECT f AS "from", t AS "to", 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT f, t, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
add(
    "J2_follow_chain",
    lambda s, d: graph.follow_chain(graph.event_edges(tree(s, d)), ev(s, d).filter("sequence = 0").select(F.col("event_id").alias("id"))).select("start", F.col("step").cast("long").alias("step"), "id"),
    f"""WITH RECURSIVE {TREE_EDGES}, child AS (SELECT "from", arg_min("to", (to_sequence, "to")) AS "to" FROM tedges GROUP BY "from"),
walk AS (SELECT event_id AS start, 0::BIGINT AS step, event_id AS id FROM ev WHERE sequence = 0 UNION ALL SELECT w.start, w.step + 1, c."to" FROM walk w JOIN child c ON c."from" = w.id)
SELECT start, step, id FROM walk""",
)
add(
    "K6_throttle",
    lambda s, d: flt.throttle(ev(s, d), "session_id", 3_600_000).select(F.col("key").alias("session_id"), "event_id"),
    f"""WITH RECURSIVE {EV}, o AS (SELECT session_id, event_id, utc_timestamp AS t, row_number() OVER (PARTITION BY session_id ORDER BY utc_timestamp, event_id) AS n FROM ev),
f AS (SELECT session_id, event_id, n, t AS last, TRUE AS keep FROM o WHERE n = 1
      UNION ALL SELECT o.session_id, o.event_id, o.n, CASE WHEN o.t - f.last >= INTERVAL 1 HOUR THEN o.t ELSE f.last END, o.t - f.last >= INTERVAL 1 HOUR FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)
SELECT session_id, event_id FROM f WHERE keep""",
)
add(
    "K6_throttle_paths",
    lambda s, d: flt.throttle_paths(ev(s, d).withColumn("paths", F.array(F.concat(F.lit("s"), F.col("session_id")), F.concat(F.lit("k"), F.col("session_id"), F.col("kind")))), "paths", 3_600_000).select("session_id", "event_id"),
    f"""WITH RECURSIVE {EV}, p AS (SELECT session_id, event_id, utc_timestamp AS t, unnest(['s' || session_id, 'k' || session_id || kind]) AS path FROM ev),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t, event_id) AS n FROM p),
f AS (SELECT session_id, event_id, path, n, t AS last, TRUE AS keep FROM o WHERE n = 1
      UNION ALL SELECT o.session_id, o.event_id, o.path, o.n, CASE WHEN o.t - f.last >= INTERVAL 1 HOUR THEN o.t ELSE f.last END, o.t - f.last >= INTERVAL 1 HOUR FROM f JOIN o ON o.path = f.path AND o.n = f.n + 1)
SELECT DISTINCT session_id, event_id FROM f WHERE keep""",
)
