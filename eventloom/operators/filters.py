"""Selection, predicates, ordering and time-anchored filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import is_error_like


# Parts of paths that a file watch leaves out.
IGNORED = ["/.git/", "/target/", "/node_modules/", "/dist/", "/build/", "/.gradle/", "/.idea/", "/__pycache__/", "/.pytest_cache/", "/.mypy_cache/", "/venv/", "/.venv/", "/.eventloom/"]


def field(name: str) -> Column:
    """The column of a friendly name; a dotted name reaches into the payload."""
    special = {
        "id": lambda: F.col("event_id"),
        "timestamp": lambda: F.col("utc_timestamp"),
        "duration_ms": lambda: F.col("duration_ns") / 1e6,
        "error": is_error_like,
        "label": lambda: F.col("labels"),
    }
    if name in special:
        return special[name]()
    if "." in name:
        return F.get_json_object("payload", "$." + name.split(".", 1)[1])
    return F.col(name)


def select_source(sources: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in sources:
        raise ValueError(f"unknown source: {name}; there are {', '.join(sorted(sources))}")
    return sources[name]


def compare(name: str, op: str, value: object) -> Column:
    """A predicate on a field: =, !=, <, <=, >, >=, ~= (case-insensitive LIKE); None tests for null;
    label tests membership."""
    c = field(name)
    if value is None:
        return c.isNotNull() if op == "!=" else c.isNull()
    if name == "label":
        return F.array_contains(c, value) if op != "!=" else ~F.array_contains(c, value)
    if op == "~=":
        return c.ilike(str(value).replace("\\", "\\\\"))
    ops = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    if op not in ops:
        raise ValueError(f"unknown operator: {op}")
    return getattr(c, ops[op])(value)


def within(events: DataFrame, seconds: float, direction: str, anchor_kind: str, bounded: bool = True, per_session: bool = False) -> DataFrame:
    """Events before or after the latest event of a kind, at most `seconds` away.  No anchor, no rows."""
    keys = ["session_id"] if per_session else []
    anchor = events.filter(F.col("kind") == anchor_kind).groupBy(*keys).agg(F.max("utc_timestamp").alias("__at")).filter("__at IS NOT NULL")
    both = events.join(anchor, keys) if keys else events.join(F.broadcast(anchor))  # one row
    gap, t = F.make_dt_interval(secs=F.lit(seconds)), F.col("utc_timestamp")
    near = (t < F.col("__at")) if direction == "before" else (t > F.col("__at"))
    if bounded:
        near = near & ((t >= F.col("__at") - gap) if direction == "before" else (t <= F.col("__at") + gap))
    return both.filter(near).drop("__at")


def show(events: DataFrame, session_id: str | None = None, find: str | None = None, severity: str | None = None) -> DataFrame:
    if session_id is not None:
        events = events.filter(F.col("session_id") == session_id)
    if find is not None:
        events = events.filter(F.col("kind").contains(find) | F.col("payload").contains(find))
    if severity is not None:
        events = events.filter(F.lower("severity") == severity.lower())
    return events


def find_errors(events: DataFrame, session_id: str | None = None) -> DataFrame:
    return show(events, session_id).filter(is_error_like()).select("session_id", "sequence", "kind", "severity", "utc_timestamp", "current_hash", "payload")


def subscription_filter(events: DataFrame, session_id: str | None = None) -> DataFrame:
    return show(events, session_id)


def watch_filter(files: DataFrame, root: str, ignore: list[str] = IGNORED, whole_names: bool = True) -> DataFrame:
    """Rows whose path lies in root and has no ignored part.  `whole_names`: /proj does not take in /proj2."""
    path, base = F.replace(F.col("path"), F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/")
    inside = (path == base) | path.startswith(base + "/") if whole_names else path.startswith(base)
    for part in ignore:
        inside = inside & ~F.col("path").contains(part)
    return files.filter(inside)


def rows_as_json(df: DataFrame) -> DataFrame:
    plain = [F.lit("[blob]").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*plain)).alias("row"))


def order_events(events: DataFrame, by: list[tuple[str, bool]]) -> DataFrame:
    return events.orderBy(*[F.desc(field(n)) if down else F.asc(field(n)) for n, down in by])


def assign_sequence(events: DataFrame) -> DataFrame:
    """Sequence numbers from 0 without gaps, in order of time within each session."""
    n = F.row_number().over(W.partitionBy("session_id").orderBy("utc_timestamp", "event_id")) - 1
    return events.withColumn("sequence", n.cast("long"))


def cap_events(events: DataFrame, most: int) -> DataFrame:
    return events.filter(F.col("sequence") < most)


def first_flagged(events: DataFrame) -> DataFrame:
    """Each session's first error-like event."""
    first = F.min_by(F.struct("event_id", "kind", "severity", "payload"), "sequence")
    return events.filter(is_error_like()).groupBy("session_id").agg(F.min("sequence").alias("sequence"), first.alias("e")).select("session_id", "sequence", "e.*")


def tail_events(events: DataFrame, n: int = 20) -> DataFrame:
    w = W.partitionBy("session_id").orderBy(F.desc("sequence"))
    return events.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def first_last_event(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.min_by("event_id", "sequence").alias("first_event_id"), F.max_by("event_id", "sequence").alias("last_event_id"))


def keep_latest(sessions: DataFrame, n: int) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(n)


def rotation_due(sessions: DataFrame, threshold: int = 80_000) -> DataFrame:
    """One row: the newest session's count, the total, and whether the count reached the threshold."""
    newest = F.max_by("source_event_count", F.struct("started_at", "session_id"))
    return sessions.agg(newest.alias("newest_count"), F.sum("source_event_count").alias("total_count"), (newest >= threshold).alias("due"))


def throttle(events: DataFrame, key: str, gap_ms: int = 50) -> DataFrame:
    """(key, ts, event_id) of events at least a gap after the last one kept of their key.

    Rows of a key are folded in order of time as a stream of sorted rows, however many there are."""
    from collections.abc import Iterator

    import pandas as pd

    rows = events.select(F.col(key).alias("key"), F.unix_micros("utc_timestamp").alias("us"), "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, 0
        for pdf in batches:
            keep = []
            for k, t in zip(pdf["key"], pdf["us"], strict=True):
                new = k != last_key or t - last >= gap_ms * 1000
                if new:
                    last_key, last = k, t
                keep.append(new)
            yield pdf[keep]

    return rows.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInPandas(fold, rows.schema)


def throttle_paths(events: DataFrame, paths: str, gap_ms: int = 50) -> DataFrame:
    """Events of which at least one path comes a gap after the last one kept of that path; each path is
    throttled for itself."""
    each = events.select("event_id", "utc_timestamp", F.explode(F.array_distinct(paths)).alias("__path"))
    kept = throttle(each, "__path", gap_ms).select("event_id").distinct()
    return events.join(kept, "event_id", "left_semi")


def list_view(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "state", "started_at", "stopped_at", "source_event_count")


def show_view(events: DataFrame) -> DataFrame:
    return events.select("session_id", "sequence", "kind", "severity", "utc_timestamp", F.substring("current_hash", 1, 16).alias("hash_prefix"))
