"""Schemas, value lists and field names of the event model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemas are DDL texts, which Spark's readers take as they are.

EVENT_DDL = (
    "event_id string, session_id string, project_id string, sequence long, source string, kind string, severity string, "
    "utc_timestamp timestamp, monotonic_ns long, duration_ns long, correlation_id string, parent_event_id string, "
    "payload_version int, payload string, classification string, previous_hash string, current_hash string"
)
EVENT_V2_DDL = EVENT_DDL + (
    ", source_clock struct<clock_id:string,timestamp_ms:long>, thread_id string, task_id string, trace_id string, span_id string, "
    "parent_span_id string, span_kind string, correlation_ids array<string>, envelope_version int, schema_version int"
)
SESSION_DDL = (
    "session_id string, project_id string, state string, started_at timestamp, stopped_at timestamp, command string, "
    "args array<string>, labels array<string>, source_event_count long, imported boolean, bundle_origin string"
)
FINDING_DDL = "kind string, span_start long, span_end long, redaction string, preview string"
EVENT_COLUMNS = [x.split()[0] for x in EVENT_DDL.split(", ")]

# Fixed values of the event model.
SEVERITIES = ["info", "warning", "error", "fatal"]
CLASSIFICATIONS = ["public", "internal", "confidential", "restricted", "unclassified"]
SESSION_STATES = ["preparing", "recording", "stopping", "complete", "failed", "interrupted", "imported-read-only"]
TERMINAL_STATES = ["complete", "failed", "imported-read-only"]


def is_error_like(kind: str = "kind", severity: str = "severity") -> Column:
    k = F.col(kind)
    return F.col(severity).isin("error", "fatal") | k.endswith(".errored") | k.endswith("_failed") | k.contains("failure") | k.contains("error")


def severity_rank(severity: str = "severity") -> Column:
    """0 for info up to 3 for fatal, so that severities compare by weight and not as text."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity)) - 1


def is_terminal(state: str = "state") -> Column:
    return F.col(state).isin(*TERMINAL_STATES)
