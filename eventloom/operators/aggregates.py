"""Counts, groups, profiles and database-call analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import is_error_like


def group_events(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(is_error_like()).alias("errors"),
        F.min("utc_timestamp").alias("first_at"),
        F.max("utc_timestamp").alias("last_at"),
        F.min_by("event_id", F.struct("utc_timestamp", "event_id")).alias("first_event_id"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("source_event_count"))


def query_calls(events: DataFrame) -> DataFrame:
    """Database calls with their statement and its template from the payload."""
    own = events.filter(F.col("kind") == "db.query").withColumn("__call", F.from_json("payload", "sql string, sql_normalized string"))
    return own.withColumns({c: F.coalesce(F.col(f"__call.{c}"), F.lit("")) for c in ("sql", "sql_normalized")}).drop("__call")


def n_plus_one(events: DataFrame, threshold: int = 3, times: int = 0, ordered: bool = True) -> DataFrame:
    """Statements that a session repeats: a row for each session and template, most frequent first if `ordered`.

    `times` lists up to that many of the earliest whole-second times of the calls."""
    agg = [F.count(F.lit(1)).alias("count"), F.sum("duration_ns").alias("total_duration_ns"), F.min_by("sql", F.struct("sequence", "sql")).alias("example_sql")]
    if times:
        w = W.partitionBy("session_id", "sql_normalized").orderBy("sequence")
        events = query_calls(events).withColumn("__n", F.row_number().over(w))
        at = F.when(F.col("__n") <= times, F.struct("sequence", F.date_trunc("second", "utc_timestamp").alias("at")))
        agg.append(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["at"]).alias("times"))
    else:
        events = query_calls(events)
    out = events.groupBy("session_id", "sql_normalized").agg(*agg).filter(F.col("count") >= threshold)
    return out.orderBy(F.desc("count"), "session_id", "sql_normalized") if ordered else out


def slow_queries(events: DataFrame, min_ns: int = 100_000_000) -> DataFrame:
    return query_calls(events).filter(F.col("duration_ns") > min_ns).select("session_id", "sequence", "sql", "duration_ns").orderBy(F.desc("duration_ns"), "session_id", "sequence")


def db_report_rows(events: DataFrame, threshold: int = 3, min_ns: int = 100_000_000) -> DataFrame:
    """Repeated and slow statements in one table; times in whole milliseconds."""
    ms = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    repeated = n_plus_one(events, threshold, ordered=False).select("session_id", F.lit("repeated").alias("section"), F.col("sql_normalized").alias("statement"), "count", ms("total_duration_ns").alias("ms"))
    slow = slow_queries(events, min_ns).select("session_id", F.lit("slow").alias("section"), F.col("sql").alias("statement"), F.lit(1).cast("long").alias("count"), ms("duration_ns").alias("ms"))
    return repeated.unionByName(slow)


def slowest_spans(events: DataFrame, slack_ms: float = 0.001) -> DataFrame:
    """Events within `slack_ms` of their session's longest; events without duration never count."""
    d = F.col("duration_ns") / 1e6
    top = F.greatest(F.max(d).over(W.partitionBy("session_id")), F.lit(0.0))
    return events.withColumns({"duration_ms": d, "__top": top}).filter(F.abs(F.col("duration_ms") - F.col("__top")) < slack_ms).drop("__top")


def resource_profile(events: DataFrame, kind: str = "profiler.sample") -> DataFrame:
    sample = F.from_json("payload", "rss long, virtual long, page_faults long")
    rows = events.filter(F.col("kind") == kind).select("session_id", sample.alias("s")).select("session_id", "s.*")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("samples"), F.min("rss").alias("rss_min"), F.avg("rss").alias("rss_avg"), F.max("rss").alias("rss_max"), F.max("page_faults").alias("page_faults"))


#: Fields of a sample: the recorder's names, and those without units.
_SAMPLE = "rss_bytes long, virtual_bytes long, page_faults long, system_mem_total long, system_mem_avail long, rss long, virtual long"
SKETCH_K = 400


def profile_parts(events: DataFrame, kind: str = "profiler.sample") -> DataFrame:
    """What a batch of events says of each session's memory, in columns that merge_profiles() adds up: counts, sums,
    extremes, and quantile sketches (KLL) of resident and virtual bytes."""
    sample = F.from_json("payload", _SAMPLE)
    rows = events.filter(F.col("kind") == kind).select("session_id", sample.alias("s")).select("session_id", "s.*")
    rows = rows.withColumns({"rss": F.coalesce("rss_bytes", "rss"), "virtual": F.coalesce("virtual_bytes", "virtual")})
    ends = [f(c).alias(f"{c}_{name}") for c in ("rss", "virtual") for f, name in ((F.min, "min"), (F.max, "max"), (F.sum, "sum"), (F.count, "count"))]
    sketches = [F.kll_sketch_agg_bigint(c, SKETCH_K).alias(f"{c}_sketch") for c in ("rss", "virtual")]
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("samples"), *ends, *sketches, F.max("page_faults").alias("page_faults"), F.max("system_mem_total").alias("mem_total"), F.min("system_mem_avail").alias("mem_avail_min"))


def merge_profiles(parts: DataFrame) -> DataFrame:
    """One row for each session from the rows of several batches; merging merged rows is as good."""
    how = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
    ends = [how[name](f"{c}_{name}").alias(f"{c}_{name}") for c in ("rss", "virtual") for name in how]
    sketches = [F.kll_merge_agg_bigint(f"{c}_sketch", SKETCH_K).alias(f"{c}_sketch") for c in ("rss", "virtual")]
    return parts.groupBy("session_id").agg(F.sum("samples").alias("samples"), *ends, *sketches, F.max("page_faults").alias("page_faults"), F.max("mem_total").alias("mem_total"), F.min("mem_avail_min").alias("mem_avail_min"))


def profile_report(parts: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Counts, means, extremes and percentiles of each session of merged parts.

    A percentile is the least sample that so many are not above; its rank is off by about 1 in 150 at most (with
    99 % confidence), and by nothing for sessions of up to SKETCH_K samples."""
    out = ["session_id", "samples"]
    for c in ("rss", "virtual"):
        some = F.col(f"{c}_count") > 0
        out += [f"{c}_min", (F.col(f"{c}_sum") / F.col(f"{c}_count")).alias(f"{c}_avg"), f"{c}_max"]
        out += [F.when(some, F.kll_sketch_get_quantile_bigint(f"{c}_sketch", F.lit(q))).alias(f"{c}_p{round(q * 100)}") for q in shares]
    return parts.select(*out, "page_faults", "mem_total", "mem_avail_min")


def failure_groups(signed: DataFrame) -> DataFrame:
    """Rows of one signature key are taken for one bug."""
    return signed.groupBy("signature_key").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("session_id").alias("sessions"), F.min("utc_timestamp").alias("first_at"), F.max("utc_timestamp").alias("last_at"))


def redaction_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("event_id").alias("events"))


def run_outcomes(sessions: DataFrame, by: tuple[str, ...] = ("command",)) -> DataFrame:
    """Good and bad runs of each command (or command and label: a session counts under each of its labels, one
    without any under null); flaky if there are both."""
    rows = sessions.withColumn("label", F.explode_outer(F.array_distinct("labels"))) if "label" in by else sessions
    out = rows.groupBy(*by).agg(F.count_if(F.col("exit_code") == 0).alias("successes"), F.count_if(F.col("exit_code") != 0).alias("failures"))
    return out.withColumn("flaky", (F.col("successes") > 0) & (F.col("failures") > 0))


def test_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(*[F.sum(c).alias(c) for c in ("passed", "failed", "skipped", "inconclusive")])


def regression_onset(runs: DataFrame) -> DataFrame:
    """For each series the first bad point after its last good one, and whether bad stayed bad.

    Inconclusive points count as good."""
    bad = F.col("outcome") == "bad"
    w = W.partitionBy("series").orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = runs.withColumn("__good", F.coalesce(F.max(F.when(~bad, F.col("ord"))).over(w), F.lit(-1)))
    after = bad & (F.col("ord") > F.col("__good"))
    return rows.groupBy("series").agg(F.min_by(F.when(after, F.col("commit")), F.when(after, F.col("ord"))).alias("onset"), (~F.max(bad & (F.col("ord") < F.col("__good")))).alias("monotone"))
