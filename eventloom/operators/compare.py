"""Comparison of baseline and candidate sessions, for any number of pairs in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import is_error_like
from ..storage import stage
from .filters import first_flagged, tail_events


def kind_delta(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(baseline, candidate, kind, base, cand): how often each kind occurs on both sides."""
    counts = events.groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    sides = [
        pairs.join(counts, F.col("session_id") == F.col(side)).select("baseline", "candidate", "kind", *[(F.col("n") if s == side else F.lit(0)).alias(a) for s, a in (("baseline", "base"), ("candidate", "cand"))])
        for side in ("baseline", "candidate")
    ]
    return sides[0].unionByName(sides[1]).groupBy("baseline", "candidate", "kind").agg(F.sum("base").alias("base"), F.sum("cand").alias("cand"))


def new_failure_kinds(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(baseline, candidate, kind): error kinds of the candidate that the baseline does not have."""
    kinds = events.filter(is_error_like()).select("session_id", "kind").distinct()
    cand = pairs.join(kinds, F.col("session_id") == F.col("candidate")).drop("session_id")
    base = pairs.join(kinds, F.col("session_id") == F.col("baseline")).drop("session_id")
    return cand.join(base, ["baseline", "candidate", "kind"], "left_anti")


def preceding_event(events: DataFrame, n: int = 5) -> DataFrame:
    """For each session the last event, not an error, within n steps before its first error."""
    first = first_flagged(events).select("session_id", F.col("sequence").alias("first_error"))
    near = events.filter(~is_error_like()).join(first, "session_id").filter((F.col("sequence") < F.col("first_error")) & (F.col("sequence") >= F.col("first_error") - n))
    return near.groupBy("session_id", "first_error").agg(F.max("sequence").alias("sequence"), F.max_by("kind", "sequence").alias("kind"))


_FACTORS = "array<struct<weight:int,reason:string>>"


def compare_sessions(events: DataFrame, pairs: DataFrame, strict: bool = False) -> DataFrame:
    """(baseline, candidate, title, severity, factors, score, sequence), a row for each divergence.

    A new kind weighs 5, an increased one 3, a new failure kind 7, and what came just before the first
    failure 8 and 3 more; with `strict` the 3 only if the baseline never had that kind."""
    delta = kind_delta(events, pairs)
    factor = lambda w, text: F.struct(F.lit(w).alias("weight"), text.alias("reason"))
    none = F.lit(None).cast("long")
    k = F.col("kind")
    cols = lambda title, severity, factors, seq: ["baseline", "candidate", F.concat(F.lit(title + ": "), k).alias("title"), F.lit(severity).alias("severity"), F.array(*factors).alias("factors"), seq.alias("sequence")]
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    changed = delta.filter("cand > base")
    fresh = changed.filter("base = 0").select(*cols("New event kind appeared", "moderate", [factor(5, text("kind ", k, ": none before, now ", F.col("cand")))], none))
    more = changed.filter("base > 0").select(*cols("Event kind increased", "low", [factor(3, text("kind ", k, ": ", F.col("cand") - F.col("base"), " more than before"))], none))
    before = preceding_event(events)
    prior = pairs.join(before, F.col("session_id") == F.col("candidate"))
    had = delta.filter("base > 0").select("baseline", "candidate", "kind", F.lit(True).alias("had"))
    prior = prior.join(had, ["baseline", "candidate", "kind"], "left")
    main = factor(8, text("stands at ", F.col("sequence"), ", just before the first failure at ", F.col("first_error")))
    extra = factor(3, text("kind ", k, " is not in the baseline"))
    prior = prior.select(*cols("Event immediately preceded first failure", "high", [main, extra], F.col("sequence")), F.coalesce("had", F.lit(False)).alias("had"))
    if strict:
        prior = prior.withColumn("factors", F.when(F.col("had"), F.slice("factors", 1, 1)).otherwise(F.col("factors")))
    prior = prior.drop("had")
    failures = new_failure_kinds(events, pairs).select(*cols("New failure kind", "high", [factor(7, text("only the candidate fails with kind ", k))], none))
    every = fresh.unionByName(more).unionByName(prior).unionByName(failures)
    return every.withColumn("score", divergence_score())


def divergence_score(factors: str = "factors"):
    return F.aggregate(factors, F.lit(0), lambda a, x: a + F.least(x["weight"], F.lit(10)))


def computed_severity(score: str = "score"):
    return F.when(F.col(score) >= 15, "high").when(F.col(score) >= 7, "moderate").otherwise("low")


def top_divergences(divergences: DataFrame, k: int = 10) -> DataFrame:
    """The k heaviest of each pair; equal scores go by title."""
    w = W.partitionBy("baseline", "candidate").orderBy(F.desc("score"), "title")
    return divergences.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def verdict(divergences: DataFrame, pairs: DataFrame) -> DataFrame:
    """clean, suspicious or broken (a new failure kind) for each pair."""
    got = divergences.groupBy("baseline", "candidate").agg(F.count(F.lit(1)).alias("divergences"), F.max(F.col("title").startswith("New failure kind")).alias("broken"))
    out = pairs.join(got, ["baseline", "candidate"], "left")
    v = F.when(F.col("divergences").isNull(), "clean").when(F.col("broken"), "broken").otherwise("suspicious")
    return out.select("baseline", "candidate", F.coalesce("divergences", F.lit(0)).cast("long").alias("divergences"), v.alias("verdict"))


def investigate(events: DataFrame, runs: DataFrame) -> DataFrame:
    """What the last events of a command's later runs have that its first run's last event has not: the
    divergences of comparing them, with the command.

    runs: (command, session_id, run).  The first run's last event is one side, the last events of all other runs, in
    the order of runs, are the other; a command that ran once has no row."""
    last = events.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "session_id"]), "sequence").alias("e")).select("session_id", "e.*")
    rows = runs.select("command", "session_id", "run").join(last, "session_id")
    side = F.when(F.col("run") == F.min("run").over(W.partitionBy("command")), "first").otherwise("later")
    sides = stage(rows.withColumn("session_id", F.concat_ws(":", side, "command")).withColumn("sequence", F.col("run").cast("long")).drop("run"), "investigated")
    name = lambda s: F.concat_ws(":", F.lit(s), "command")
    pairs = sides.filter(F.col("session_id") == name("later")).select("command", name("first").alias("baseline"), name("later").alias("candidate")).distinct()
    found = compare_sessions(sides.drop("command"), pairs.select("baseline", "candidate"))
    return pairs.join(found, ["baseline", "candidate"]).drop("baseline", "candidate")


def bug_report_rows(events: DataFrame, sessions: DataFrame, n: int = 20) -> DataFrame:
    """(session_id, section, sequence, kind, detail): header, first flagged event, last n events."""
    head = sessions.select("session_id", F.lit("header").alias("section"), F.lit(None).cast("long").alias("sequence"), F.col("state").alias("kind"), F.col("source_event_count").cast("string").alias("detail"))
    flagged = first_flagged(events).select("session_id", F.lit("flagged").alias("section"), "sequence", "kind", F.col("payload").alias("detail"))
    tail = tail_events(events, n).select("session_id", F.lit("tail").alias("section"), "sequence", "kind", F.col("severity").alias("detail"))
    return head.unionByName(flagged).unionByName(tail)


def analysis_report_rows(divergences: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, evidence) for pairs that are not clean; evidence has the first five divergences."""
    top = top_divergences(divergences, 5)
    lead = top.filter("rank = 1").select("baseline", "candidate", F.col("title").alias("lead"), F.col("score").alias("lead_score"))
    said = verdict(divergences, pairs).filter("verdict != 'clean'").join(lead, ["baseline", "candidate"])
    sentence = F.concat(F.col("divergences").cast("string"), F.lit(" divergences; the strongest is '"), F.col("lead"), F.lit("' with score "), F.col("lead_score").cast("string"), F.lit("."))
    summary = said.select("baseline", "candidate", F.concat(F.lit("Session "), F.col("candidate"), F.lit(" is "), F.col("verdict")).alias("title"), "verdict", sentence.alias("summary"))
    return summary, top.select("baseline", "candidate", "rank", "title", "sequence", F.get("factors", F.lit(0))["reason"].alias("note"))
