"""Export and import of sessions as bundles: event files in ranges of sessions, and a manifest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chain import verify_chain
from ..storage import stage

VERSION = "run-bundle@1.0.0"


def manifest(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(version, session_id, project_id, event_count, head_hash): a row for each session."""
    own = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"), F.max_by("current_hash", "sequence").alias("head_hash"))
    return sessions.select("session_id", "project_id").join(own, "session_id").select(F.lit(VERSION).alias("version"), "session_id", "project_id", "event_count", "head_hash")


def export_sessions(events: DataFrame, sessions: DataFrame, out: str) -> DataFrame:
    """Writes the sessions whose chain holds, events in order of sessions and the manifest; returns the rejected."""
    checked = stage(verify_chain(events), "checked")
    good = checked.filter("ok").select("session_id")
    kept = events.join(good, "session_id", "left_semi")
    kept.repartitionByRange("session_id", "sequence").sortWithinPartitions("session_id", "sequence").write.mode("overwrite").json(f"{out}/events")
    manifest(events.sparkSession.read.schema(events.schema).json(f"{out}/events"), sessions).write.mode("overwrite").json(f"{out}/manifest")
    return checked.filter("NOT ok").select("session_id", F.col("error").alias("reason"))


def compatible(version: Column) -> Column:
    """Major version 1: the name, @1, and then a dot or nothing."""
    name = VERSION.split("@")[0]
    return (version == f"{name}@1") | version.startswith(f"{name}@1.")


def import_sessions(spark: SparkSession, path: str, event_schema: str) -> tuple[DataFrame, DataFrame]:
    """(accepted events, rejected sessions with the reason): a session is taken whole or not at all."""
    events = stage(spark.read.schema(event_schema).json(f"{path}/events"), "imported")
    listed = spark.read.schema("version string, session_id string, project_id string, event_count long, head_hash string").json(f"{path}/manifest")
    own = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("found"), F.max_by("current_hash", "sequence").alias("head"))
    both = listed.join(own, "session_id", "left").join(verify_chain(events).select("session_id", "ok", "error"), "session_id", "left")
    reason = (
        F.when(~compatible(F.col("version")), "version")
        .when(F.coalesce("found", F.lit(0)) != F.col("event_count"), "event count")
        .when(~F.coalesce("ok", F.lit(False)), F.col("error"))
        .when(~F.col("head").eqNullSafe(F.col("head_hash")), "head hash")
    )
    judged = both.withColumn("reason", reason)
    return events.join(judged.filter("reason IS NULL"), "session_id", "left_semi"), judged.filter("reason IS NOT NULL").select("session_id", "reason")


def sessions_to_archive(sessions: DataFrame, keep: int, archived: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Sessions beyond the newest `keep` (and within the next `most`), without those archived already."""
    newest = [F.desc("started_at"), F.asc("session_id")]
    near = sessions if most is None else sessions.orderBy(*newest).limit(keep + most)
    out = near.join(sessions.orderBy(*newest).limit(keep).select("session_id"), "session_id", "left_anti")
    return out if archived is None else out.join(archived.select("session_id"), "session_id", "left_anti")


def archive_sessions(events: DataFrame, sessions: DataFrame, out: str, keep: int, most: int | None = None) -> DataFrame:
    """Exports the sessions beyond the newest `keep` that `out` does not list yet, and returns the listing of those
    that this run archived: (session_id, batch).

    Each run writes a bundle of its own (`batch=`) and, when it is whole, its part of the listing: a run that
    broke off is done again.  Nothing is deleted; sessions whose chain does not hold are not listed."""
    spark = events.sparkSession
    listing, schema = f"{out}/listing", "session_id string, batch string"
    try:
        archived = spark.read.schema(schema).parquet(listing)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        archived = None
    chosen = stage(sessions_to_archive(sessions, keep, archived, most), "to-archive")
    batch = uuid.uuid4().hex
    rejected = export_sessions(events.join(chosen.select("session_id"), "session_id", "left_semi"), chosen, f"{out}/batch={batch}")
    done = chosen.select("session_id").join(rejected, "session_id", "left_anti").select("session_id", F.lit(batch).alias("batch"))
    done = stage(done, "archived")
    done.write.mode("append").parquet(listing)
    return done
