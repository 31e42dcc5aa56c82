"""Event tables: reading, defaults for unknown values, appending, sessions and projects."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CLASSIFICATIONS, EVENT_COLUMNS, EVENT_DDL, SESSION_STATES, SEVERITIES
from ..storage import stage


def load_events(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(EVENT_DDL).format(form).load(path).select(*EVENT_COLUMNS)


def normalise_events(events: DataFrame) -> DataFrame:
    """Unknown severities become info, unknown classifications unclassified; sources stay."""
    known = lambda c, values, other: F.when(F.col(c).isin(*values), F.col(c)).otherwise(other)
    return events.withColumns({"severity": known("severity", SEVERITIES, "info"), "classification": known("classification", CLASSIFICATIONS, "unclassified")})


def normalise_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("state", F.when(F.col("state").isin(*SESSION_STATES), F.col("state")).otherwise("failed"))


_CAMEL = {
    "event_id": "eventId",
    "session_id": "sessionId",
    "project_id": "projectId",
    "utc_timestamp": "utcTimestamp",
    "monotonic_ns": "monotonicNs",
    "duration_ns": "durationNs",
    "correlation_id": "correlationId",
    "parent_event_id": "parentEventId",
    "payload_version": "payloadVersion",
    "trace_id": "traceId",
    "span_id": "spanId",
    "parent_span_id": "parentSpanId",
}
_WIRE_TYPES = {"sequence": "long", "monotonic_ns": "long", "duration_ns": "long", "payload_version": "int", "utc_timestamp": "timestamp"}


def from_wire(frames: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON frames, whole or in an ``event`` member, with names in either spelling.

    critical counts as fatal and debug as info; a source may be text or {"kind": text}; the trace and
    span columns are kept."""
    names = [c for c in EVENT_COLUMNS if c not in ("previous_hash", "current_hash")] + ["trace_id", "span_id", "parent_span_id"]
    body = F.coalesce(F.get_json_object(column, "$.event"), F.col(column))
    rows = frames.select(body.alias("__j"))

    def field(c: str):
        got = F.get_json_object("__j", f"$.{c}")
        if c in _CAMEL:
            got = F.coalesce(got, F.get_json_object("__j", f"$.{_CAMEL[c]}"))
        if c == "source":
            got = F.coalesce(F.get_json_object("__j", "$.source.kind"), got)
        if c == "severity":
            got = F.when(got == "critical", "fatal").when(got == "debug", "info").otherwise(got)
        return got.cast(_WIRE_TYPES.get(c, "string")).alias(c)

    out = rows.select(*map(field, names))
    return normalise_events(out.withColumns({"payload_version": F.coalesce("payload_version", F.lit(1)), "previous_hash": F.lit(None).cast("string"), "current_hash": F.lit(None).cast("string")}))


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


def session_events(events: DataFrame, session_id: str) -> DataFrame:
    return events.filter(F.col("session_id") == session_id).orderBy("sequence")


def get_session(sessions: DataFrame, events: DataFrame, session_id: str | None = None, nested: bool = False) -> DataFrame:
    """Sessions with event count and head hash (of the last event); `nested` adds one session's events."""
    if nested and session_id is None:
        raise ValueError("nested events are for one session at a time")
    if session_id is not None:
        sessions, events = sessions.filter(F.col("session_id") == session_id), events.filter(F.col("session_id") == session_id)
    agg = [F.count(F.lit(1)).alias("event_count"), F.max_by("current_hash", "sequence").alias("head_hash"), F.max_by("event_id", "sequence").alias("last_event_id")]
    if nested:
        agg.append(F.sort_array(F.collect_list(F.struct("sequence", *[c for c in events.columns if c not in ("sequence", "session_id")]))).alias("events"))
    return sessions.join(events.groupBy("session_id").agg(*agg), "session_id", "left")


def recent_sessions(sessions: DataFrame, k: int = 20, project: str | None = None) -> DataFrame:
    if project is not None:
        sessions = sessions.filter(F.col("project_id") == project)
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(k)


#: Parts of an event store, by the hash of ids (and of its counts, by the hash of sessions).
BUCKETS = 64


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def keyed(events: DataFrame) -> DataFrame:
    """events with event_key and its bucket: the id, or for an event without one a hash of the whole row."""
    row = F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct(*events.columns)), 256))
    return events.withColumn("event_key", F.coalesce("event_id", row)).withColumn("bucket", _bucket(F.col("event_key")))


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log beside the data; empty as long as nothing was written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_keys(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """(event_key, bucket) of what a store has in some of its buckets; no other bucket is read."""
    return _log(spark, path, "event_key string, bucket int, batch string").filter(F.col("bucket").isin(buckets)).select("event_key", "bucket")


def new_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of keyed() events whose key is not stored yet, each key once: what an append adds."""
    return events.dropDuplicates(["event_key"]).join(stored, ["bucket", "event_key"], "left_anti")


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends the events that are new to a store.

    A store has a directory for each bucket of ids and batch, a log of batches and one of the events of each
    session.  Only the buckets that the batch touches are read.  A batch that the log has adds nothing; one
    that broke off before it was logged adds what is missing.  One writer at a time."""
    spark = events.sparkSession
    name = batch or uuid.uuid4().hex
    if batch is not None and not _log(spark, f"{path}/_batches", "batch string").filter(F.col("batch") == batch).isEmpty():
        return
    rows = stage(keyed(events), "append")
    buckets = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # BUCKETS rows at most
    fresh = new_events(rows, stored_keys(spark, path, buckets)).withColumn("batch", F.lit(name))
    fresh.repartition("bucket").write.mode("append").partitionBy("bucket", "batch").parquet(path)
    own = _log(spark, path, "session_id string, bucket int, batch string").filter(F.col("bucket").isin(buckets) & (F.col("batch") == name))
    counts = own.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select("session_id", "n", _bucket(F.col("session_id")).alias("bucket"), F.lit(name).alias("batch"))
    counts.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{path}/_sessions")
    spark.createDataFrame([(name,)], "batch string").write.mode("append").parquet(f"{path}/_batches")


def recount(events: DataFrame, path: str) -> DataFrame:
    """(session_id, source_event_count) in a store of the sessions that a batch touched: the sums of what each batch
    added, from the buckets of those sessions."""
    touched = stage(events.select("session_id", _bucket(F.col("session_id")).alias("bucket")).distinct(), "touched")
    buckets = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())
    counts = _log(events.sparkSession, f"{path}/_sessions", "session_id string, n long, bucket int, batch string").filter(F.col("bucket").isin(buckets))
    return counts.join(touched, ["bucket", "session_id"], "left_semi").groupBy("session_id").agg(F.sum("n").alias("source_event_count"))


def append_batch(events: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    append_events(events, path, batch)
    return recount(events, path)


def latest_sessions(log: DataFrame, updated: str = "updated_at") -> DataFrame:
    """The last row of each session in a log of creations and state changes."""
    w = W.partitionBy("session_id").orderBy(F.desc(updated))
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def derive_sessions(events: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Sessions from their own events: start and stop facts, count, and the final state.

    A session is complete if its stop event says exit code 0, failed if it says another or if
    `findings` (session_id rows) has any for it, and recording while it has no stop event."""
    stop = F.col("kind") == "session.stopped"
    code = F.get_json_object(F.max_by(F.when(stop, F.col("payload")), F.when(stop, F.col("sequence"))), "$.exit_code").cast("int")
    out = events.groupBy("session_id").agg(
        F.min_by("project_id", "sequence").alias("project_id"),
        F.min("utc_timestamp").alias("started_at"),
        F.max(F.when(stop, F.col("utc_timestamp"))).alias("stopped_at"),
        F.get_json_object(F.max(F.when(F.col("kind") == "session.started", F.col("payload"))), "$.command").alias("command"),
        F.get_json_object(F.max(F.when(F.col("kind") == "session.started", F.col("payload"))), "$.label").alias("label"),
        F.count(F.lit(1)).alias("source_event_count"),
        F.max(stop).alias("__stopped"),
        code.alias("exit_code"),
    )
    bad = F.lit(False)
    if findings is not None:
        out = out.join(findings.select("session_id").distinct().withColumn("__found", F.lit(True)), "session_id", "left")
        bad = F.coalesce("__found", F.lit(False))
    state = F.when(~F.col("__stopped"), "recording").when(bad, "failed").when(F.col("exit_code") == 0, "complete").otherwise("failed")
    return out.withColumn("state", state).drop("__stopped", "__found")


def ensure_projects(projects: DataFrame, new: DataFrame) -> DataFrame:
    """projects and those of `new` whose id is absent."""
    return projects.unionByName(new.dropDuplicates(["project_id"]).join(projects.select("project_id"), "project_id", "left_anti").select(*projects.columns))


def resolve_project(projects: DataFrame, sessions: DataFrame, root: str, recent: int | None = 40) -> DataFrame:
    """Projects of a root directory among the `recent` last sessions' (None: among all)."""
    used = sessions if recent is None else sessions.orderBy(F.desc("started_at"), "session_id").limit(recent)
    return projects.filter(F.col("root") == root).join(used.select("project_id").distinct(), "project_id", "left_semi")


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("append").parquet(path)


def redactions_of(findings: DataFrame, session_id: str) -> DataFrame:
    return findings.filter(F.col("session_id") == session_id).select("kind", "preview")


def xml_testcases(spark: SparkSession, path: str) -> DataFrame:
    """Passed, failed, skipped and inconclusive test cases of XML reports."""
    result = "struct<_VALUE:string,_message:string>"
    schema = f"_name string, failure {result}, error {result}, skipped string"
    cases = spark.read.option("rowTag", "testcase").schema(schema).xml(path)
    failed, error, skipped = (F.col(c).isNotNull() for c in ("failure", "error", "skipped"))
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return cases.agg(count(~failed & ~error & ~skipped).alias("passed"), count(failed).alias("failed"), count(~failed & ~error & skipped).alias("skipped"), count(~failed & error).alias("inconclusive"))
