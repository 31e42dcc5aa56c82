"""Failure events from terminal output, and chunks that no manifest names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import failure_signature, signature_key

LAST_LINES = 40


def failure_events(output: DataFrame, runs: DataFrame) -> DataFrame:
    """An event `failure.signature` for each run with another exit code than 0.

    output: (session_id, sequence, text); runs: (session_id, exit_code, wall_ms, command).  The frames
    come from the last LAST_LINES lines, latest first; only the last chunks that can hold them (each
    has a line at least) are gathered for a session."""
    w = W.partitionBy("session_id").orderBy(F.desc("sequence"))
    last = output.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= LAST_LINES)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "text"))), lambda x: x["text"]), "")
    joined = last.groupBy("session_id").agg(text.alias("__text"))
    lines = F.slice(F.reverse(F.filter(F.split("__text", "\n"), lambda x: x != "")), 1, LAST_LINES)
    bad = runs.filter("exit_code != 0").join(joined, "session_id", "left")
    message = F.concat(F.lit("exit "), F.col("exit_code").cast("string"))
    signature = failure_signature(F.lit("command_failed"), message, F.array_join(lines, "\n"), F.col("exit_code"), F.col("command"))
    rows = bad.withColumn("signature", signature)
    return rows.select("session_id", F.lit("failure.signature").alias("kind"), (F.col("wall_ms") * 1_000_000).alias("duration_ns"), "signature", signature_key(F.col("signature")).alias("signature_key"))


def orphan_chunks(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks whose hash no manifest's chunk_hashes has."""
    return chunks.join(manifests.select(F.explode("chunk_hashes").alias("hash")), "hash", "left_anti")
