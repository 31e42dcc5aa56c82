"""Analysis of recorded runs (events, sessions, lineage, redaction) as Spark DataFrame operators."""
