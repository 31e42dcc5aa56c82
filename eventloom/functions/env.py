"""Environment fingerprints: which variables are recorded, how, and drift between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Variables that are recorded, by category.
ALLOWED = {
    "os": ["PATH", "OS", "OSTYPE", "MSYSTEM", "PROCESSOR_ARCHITECTURE", "HOME", "HOMEDRIVE", "USERPROFILE", "TMPDIR", "TMP", "TEMP", "LANG", "LC_ALL", "TZ"],
    "lang": ["JAVA_HOME", "PYTHON_VERSION", "NODE_VERSION", "GO_VERSION", "RUST_VERSION", "CARGO_HOME", "RUSTUP_HOME"],
    "ci": ["CI", "GITHUB_ACTIONS", "GITLAB_CI", "CIRCLECI", "BUILDKITE", "JENKINS_URL", "BUILDKITE_BUILD_ID", "GITHUB_RUN_ID", "GITHUB_RUN_NUMBER"],
}


def category(key: Column, prefix: str) -> Column:
    u = F.upper(key)
    out = F.when(u.isin(*ALLOWED["os"]), "os")
    for name in ("lang", "ci"):
        out = out.when(u.isin(*ALLOWED[name]), name)
    return out.when(key.startswith(prefix), "custom").otherwise("excluded")


def env_fingerprint(env: DataFrame, prefix: str = "LOOM_") -> DataFrame:
    """(session_id, key, category, value_hash, value_preview); values of excluded variables leave no trace."""
    cat, value = category(F.col("key"), prefix), F.col("value")
    hashed = F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat_ws(":", "key", "value"), 256), 1, 32))
    shown = F.when((cat != "excluded") & (F.octet_length(value) <= 32) & value.rlike("^[A-Za-z0-9._-]*$"), value)
    return env.select("session_id", "key", cat.alias("category"), F.when(cat == "excluded", "excluded").otherwise(hashed).alias("value_hash"), shown.alias("value_preview"))


def env_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, change): variables that only one side has, or whose hash differs."""
    x, y = (d.select("key", F.col("value_hash").alias(n)) for d, n in ((a, "__a"), (b, "__b")))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return x.join(y, "key", "full_outer").select("key", change.alias("change")).filter("change IS NOT NULL")
