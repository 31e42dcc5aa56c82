"""Consent and retention register: coverage, issues, violations, requests, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import numbered


def consent_active(at: Column) -> Column:
    return (F.col("status") == "granted") & (F.col("expires_at_ns").isNull() | (at <= F.col("expires_at_ns")))


def consent_expired(at: Column) -> Column:
    return (F.col("status") != "withdrawn") & F.col("expires_at_ns").isNotNull() & (at > F.col("expires_at_ns"))


def subjects_with_active_consent(subjects: DataFrame, consents: DataFrame, at: Column) -> DataFrame:
    return subjects.join(consents.filter(consent_active(at)).select(F.col("subject_id").alias("id")), "id", "left_semi")


def max_allowed_retention(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category").agg(F.min("max_retention_days").alias("allowed_days"))


def retention_violations(elements: DataFrame, rules: DataFrame) -> DataFrame:
    return elements.join(max_allowed_retention(rules), "category").filter("retention_days > allowed_days").select(F.col("id").alias("element_id"), "category", "retention_days", "allowed_days")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows of child whose key no parent has."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def consent_coverage(subjects: DataFrame, consents: DataFrame, at: Column) -> DataFrame:
    """One row: subjects, how many have active consent, and their share (0 without subjects)."""
    active = consents.filter(consent_active(at)).select(F.col("subject_id").alias("id")).distinct().withColumn("__a", F.lit(1))
    got = subjects.select("id").distinct().join(active, "id", "left").agg(F.count(F.lit(1)).alias("subjects"), F.count("__a").alias("with_active_consent"))
    return got.withColumn("coverage", F.when(F.col("subjects") == 0, 0.0).otherwise(F.col("with_active_consent") / F.col("subjects")))


def consent_issues(consents: DataFrame, at: Column) -> DataFrame:
    status = F.when(consent_expired(at), "expired").when(F.col("status") == "withdrawn", "withdrawn")
    return consents.select("id", "subject_id", "purpose", status.alias("issue")).filter("issue IS NOT NULL")


def is_open(status: str = "status") -> Column:
    return F.col(status).isin("open", "in_progress")


def privacy_report(subjects: DataFrame, elements: DataFrame, consents: DataFrame, requests: DataFrame, at: Column, policy: str) -> DataFrame:
    """One row of counts."""
    one = consents.agg(F.count(F.lit(1)).alias("consents"), F.count_if(consent_active(at)).alias("active"), F.count_if(consent_expired(at)).alias("expired"), F.count_if(F.col("status") == "withdrawn").alias("withdrawn"))
    for df, c in ((subjects.agg(F.count(F.lit(1)).alias("subjects")), 1), (elements.agg(F.count(F.lit(1)).alias("elements")), 1), (requests.agg(F.count_if(is_open()).alias("open_requests")), 1)):
        one = one.join(F.broadcast(df))  # one row each
    return one.withColumn("policy_version", F.lit(policy))


def inventory(subjects: DataFrame, elements: DataFrame, consents: DataFrame) -> DataFrame:
    parts = [d.select(F.lit(k).alias("record"), F.col("id").cast("string").alias("id")) for d, k in ((subjects, "subject"), (elements, "element"), (consents, "consent"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("record", "id")


def privacy_findings(subjects: DataFrame, elements: DataFrame, consents: DataFrame, rules: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """(severity, message) from five rules."""
    cover = consent_coverage(subjects, consents, at)
    say = lambda df, severity, *parts: df.select(F.lit(severity).alias("severity"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("message"))
    out = say(cover.filter("subjects > 0 AND with_active_consent = 0"), "high", "no data subject has active consent")
    out = out.unionByName(say(cover.filter("with_active_consent < subjects"), "medium", "consent coverage is ", F.format_string("%.1f", F.col("coverage") * 100), "%"))
    s = lambda c: F.col(c).cast("string")
    out = out.unionByName(say(consent_issues(consents, at), "medium", "consent for subject ", s("subject_id"), " (", s("purpose"), ") is ", s("issue")))
    out = out.unionByName(say(retention_violations(elements, rules), "critical", "element ", s("element_id"), " retains ", s("retention_days"), "d beyond allowed ", s("allowed_days"), "d"))
    open_ = requests.agg(F.count_if(is_open()).alias("n")).filter("n > 0")
    return out.unionByName(say(open_, "low", s("n"), " data subject requests outstanding"))


def request_states(log: DataFrame) -> DataFrame:
    """(request_id, status, ignored) after a log of (request_id, ord, status).

    in_progress, fulfilled and denied are reached only from open or in_progress; other steps are ignored."""
    steps = F.transform(F.sort_array(F.collect_list(F.struct("ord", "status"))), lambda x: x["status"])
    start = F.struct(F.lit("open").alias("status"), F.lit(0).cast("long").alias("ignored"))

    def step(a, s):
        ok = a["status"].isin("open", "in_progress") & s.isin("in_progress", "fulfilled", "denied")
        return F.struct(F.when(ok, s).otherwise(a["status"]).alias("status"), (a["ignored"] + F.when(ok, 0).otherwise(1)).cast("long").alias("ignored"))

    return log.groupBy("request_id").agg(F.aggregate(steps, start, step).alias("f")).select("request_id", "f.*")


def elements_for_category(elements: DataFrame, category: str) -> DataFrame:
    return elements.filter(F.col("category") == category)


def active_consents(consents: DataFrame, subject: str, at: Column) -> DataFrame:
    return consents.filter((F.col("subject_id") == subject) & consent_active(at))


def register_events(subjects: DataFrame, elements: DataFrame, consents: DataFrame, session_id: str) -> DataFrame:
    """Register rows as events: ids by kind and number, sequence over all from 1.

    Numbers come from ranks within a kind; the kinds' sizes (three rows) shift the sequence."""
    parts = [(subjects, "privacy.subject"), (elements, "privacy.element"), (consents, "privacy.consent")]
    out, shift = None, F.lit(0)
    sizes = [d.agg(F.count(F.lit(1)).alias(f"__n{i}")) for i, (d, _) in enumerate(parts)]
    for i, (d, kind) in enumerate(parts):
        rows = numbered(d, ["id"], "__i").select(F.lit(kind).alias("kind"), F.to_json(F.struct(*d.columns)).alias("payload"), "__i")
        for j in range(i):
            rows = rows.join(F.broadcast(sizes[j]))  # one row
        shift = sum((F.col(f"__n{j}") for j in range(i)), F.lit(0))
        rows = rows.select(F.concat("kind", F.lit("."), F.when(F.col("__i") < 1000, F.lpad(F.col("__i").cast("string"), 3, "0")).otherwise(F.col("__i").cast("string"))).alias("event_id"), F.lit(session_id).alias("session_id"), "kind", (F.col("__i") + shift).cast("long").alias("sequence"), "payload")
        out = rows if out is None else out.unionByName(rows)
    return out


def report_events(report: DataFrame, violations: DataFrame, session_id: str) -> DataFrame:
    """A report (one row) and its violations as events: the report first, then violations in order of elements."""
    name = lambda kind, i: F.concat(F.lit(kind + "."), F.when(i < 1000, F.lpad(i.cast("string"), 3, "0")).otherwise(i.cast("string")))
    row = lambda kind, d, i: d.select(name(kind, i).alias("event_id"), F.lit(session_id).alias("session_id"), F.lit(kind).alias("kind"), i.alias("__i"), F.to_json(F.struct(*[c for c in d.columns if c != "__i"])).alias("payload"))
    first = row("privacy.report", report, F.lit(1).cast("long")).withColumn("sequence", F.lit(1).cast("long"))
    rest = row("privacy.violation", numbered(violations, ["element_id", "category"], "__i"), F.col("__i")).withColumn("sequence", F.col("__i") + 1)
    return first.unionByName(rest).select("event_id", "session_id", "kind", "sequence", "payload")
