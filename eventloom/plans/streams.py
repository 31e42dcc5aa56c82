"""Queries of the stream operators: each runs a stream over given tables to its end and reads its sink."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chain import verify_chain
from ..sources import samples
from ..storage import fresh_path
from ..streaming import operators as st
from . import records
from .registry import EV, ORACLE, add


def _files(s: SparkSession, d: str, table: str) -> int:
    """Files of a stream over a table: four for each piece in which Spark reads that table, so that they don't grow."""
    return 4 * samples.table(s, d, table).rdd.getNumPartitions()


def _stream(s: SparkSession, d: str, rows: DataFrame, table: str = "events") -> DataFrame:
    """rows, made from a table, as a stream of two batches: written as files and read half of them at a time."""
    path, n = fresh_path(s, "source"), _files(s, d, table)
    rows.repartition(n).write.parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", n // 2).parquet(path)


def _to_the_end(s: SparkSession, d: str, rows: DataFrame, table: str = "events") -> DataFrame:
    """rows as a stream, in any order, and after them one row of a session of its own long past all others: it moves
    the watermark over every one of them."""
    path, n = fresh_path(s, "source"), _files(s, d, table)
    rows.repartition(n).write.parquet(path)
    last = rows.agg((F.max("utc_timestamp") + F.expr("INTERVAL 800 DAYS")).alias("t"))
    mark = last.select(*[F.col("t").alias(c) if c == "utc_timestamp" else F.lit("end of stream").alias(c) if c in ("session_id", "event_id") else F.lit(None).cast(k).alias(c) for c, k in rows.dtypes])
    mark.write.mode("append").parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", n // 2).parquet(path)


def _run(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows that an append stream wrote."""
    out = fresh_path(spark, "sink")
    df.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "offsets")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _updates(df: DataFrame, spark: SparkSession, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `keep` makes of all updates that a stream wrote."""
    out = fresh_path(spark, "sink")
    write = lambda batch, n: batch.withColumn("__batch", F.lit(n)).write.mode("append").parquet(out)
    df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", fresh_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return keep(spark.read.parquet(out))


def _ingest(s, d):
    out = fresh_path(s, "events")
    st.ingest_stream(_stream(s, d, samples.events(s, d)), out, fresh_path(s, "offsets")).awaitTermination()
    return s.read.parquet(out).groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))


add("K1_ingest_stream", _ingest, f"WITH {EV} SELECT session_id, count(*) AS events FROM ev GROUP BY session_id")
add(
    "K2_running_counts",
    lambda s, d: _updates(st.running_counts(_stream(s, d, samples.events(s, d))), s, lambda x: x.groupBy("session_id").agg(F.max_by("source_event_count", "__batch").alias("source_event_count"))),
    f"WITH {EV} SELECT session_id, count(*) AS source_event_count FROM ev GROUP BY session_id",
)
add("K3_subscribe", lambda s, d: _run(st.subscribe(_stream(s, d, samples.events(s, d)), "5").select("event_id", "sequence"), s), f"WITH {EV} SELECT event_id, sequence FROM ev WHERE session_id = '5'")


add(
    "K3_fan_out",
    lambda s, d: _run(st.fan_out(_stream(s, d, samples.events(s, d)), _subscriptions(s, d)).select("consumer", "event_id"), s).groupBy("consumer").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event")),
    f"""WITH {EV}, subs AS (SELECT DISTINCT 'c' || c_custkey % 7 AS consumer, CAST(c_custkey AS VARCHAR) AS session_id FROM customer WHERE c_custkey % 7 <> 3), got AS (
  SELECT consumer, event_id FROM ev JOIN subs USING (session_id) UNION ALL SELECT 'c3', event_id FROM ev)
SELECT consumer, count(*) AS events, min(event_id) AS first_event FROM got GROUP BY consumer""",
)


def _subscriptions(s, d):
    """Customers' numbers as sessions asked for by seven consumers, of whom one asks for all."""
    n = F.col("c_custkey")
    return samples.table(s, d, "customer").select(F.concat(F.lit("c"), (n % 7).cast("string")).alias("consumer"), F.when((n % 7 != 3) | (n % 2 == 0), F.when(n % 7 != 3, n.cast("string"))).alias("session_id"))


def _seal(s, d):
    return verify_chain(_run(st.seal_stream(_to_the_end(s, d, samples.turns(s, d), "conversations"), delay="400 days"), s)).select("session_id", "ok", "events")


add("K4_seal_stream", _seal, "SELECT CAST(conv_id AS VARCHAR) AS session_id, TRUE AS ok, count(*) AS events FROM conversations GROUP BY conv_id")


def _redact(s, d):
    rows = samples.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("event_id"), F.lit("s").alias("session_id"), F.to_json(F.struct(F.concat(F.lit("mail me@x.org "), F.col("doc_id").cast("string")).alias("m"))).alias("payload"))
    return _run(st.redact_stream(_stream(s, d, rows, "documents")).select("event_id", F.size("findings").cast("long").alias("n")), s)


add("K5_redact_stream", _redact, "SELECT CAST(doc_id AS VARCHAR) AS event_id, 1::BIGINT AS n FROM documents")


def _redact_texts(s, d):
    rows = records._secret_text(s, d).select(F.col("doc_id").cast("string").alias("event_id"), F.lit("s").alias("session_id"), F.to_json(F.struct("t")).alias("payload"))
    return _run(st.redact_stream(_stream(s, d, rows, "documents")).select("event_id", "payload", F.size("findings").cast("long").alias("n")), s)


add(
    "K5_redact_stream_texts",
    _redact_texts,
    f"""WITH {records._SCAN} SELECT CAST(doc_id AS VARCHAR) AS event_id, '{{"t":' || CAST(to_json(array_to_string([p[i] || coalesce(tags[i], '') FOR i IN range(1, len(p) + 1)], '')) AS VARCHAR) || '}}' AS payload, CAST(len(m) AS BIGINT) AS n FROM found""",
)


add(
    "K6_throttle_stream",
    lambda s, d: _run(st.throttle_stream(_to_the_end(s, d, samples.events(s, d)), "session_id", 3_600_000, "400 days"), s).select(F.col("key").alias("session_id"), "event_id"),
    ORACLE["K6_throttle"],
)


def _throttle_paths(s, d):
    rows = samples.events(s, d).select("session_id", "event_id", "utc_timestamp", F.array(F.concat(F.lit("s"), F.col("session_id")), F.concat(F.lit("k"), F.col("session_id"), F.col("kind"))).alias("paths"))
    kept = _run(st.throttle_paths_stream(_to_the_end(s, d, rows), "paths", 3_600_000, "400 days").select("event_id"), s)
    return rows.join(kept, "event_id").select("session_id", "event_id")


add("K6_throttle_paths_stream", _throttle_paths, ORACLE["K6_throttle_paths"])
add(
    "K7_dedupe_stream",
    lambda s, d: _run(st.dedupe_stream(_stream(s, d, samples.events(s, d).union(samples.events(s, d).filter("sequence < 5"))), "400 days").select("event_id"), s),
    "SELECT CAST(event_id AS VARCHAR) AS event_id FROM events",
)


#: Output of a run in five dialects; each chunk ends where it may, within lines, marks and cases.
_CHUNKS = {
    "gotest": ("--- PASS: T", "\n--- FA", "IL: x\n--- SKIP: z"),
    "pytest": ("== 1 passed, 1 fai", "led in 2s ==\n1 passed in 3s\n=", "= 2 skipped, 7 passed in 1s\n"),
    "vitest": ("✓ a\n ✗", " b\n× c\n", "Tests: 1 failed | 4 pa"),
    "junit": ('<testcase name="a"/><test', 'case name="b"><failure/></testcase><testcase name="c"><ski', "pped/></testcase>\n"),
    "auto": ("✓ a\n✓ b\n--- PA", "SS: x\n3 fai", "led in 1s\n"),
}


def _chunks(s, d, dialect):
    """Every turn of a conversation is a chunk of a session's output, in three kinds by turns."""
    kinds = F.array(*map(F.lit, _CHUNKS[dialect]))
    t = samples.table(s, d, "conversations").select("conv_id", "turn").distinct()
    return t.select(F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds("turn").alias("utc_timestamp"), F.format_string("%09d", "turn").alias("event_id"), F.get(kinds, (F.col("turn") % 3).cast("int")).alias("text"), (F.col("turn") < 0).alias("ended"))


def _tests(s, d):
    """All dialects: the counts that the last batch of each session gave."""
    out = []
    for dialect in _CHUNKS:
        rows, path, n = _chunks(s, d, dialect), fresh_path(s, "source"), _files(s, d, "conversations")
        for part in ("event_id < '000000002'", "event_id >= '000000002'"):  # a session's output comes in order
            rows.filter(part).repartition(n, "session_id").write.mode("append").parquet(path)
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", n).parquet(path)
        last = lambda x: x.groupBy("session_id").agg(F.max_by(F.struct("passed", "failed", "skipped", "inconclusive"), "__batch").alias("c")).select("session_id", "c.*")
        out.append(_updates(st.test_counts_stream(stream, dialect), s, last).withColumn("dialect", F.lit(dialect)))
    return reduce(DataFrame.unionByName, out)


def _tests_sql() -> str:
    """The same counts from each conversation's whole text, by regular expressions."""
    number = lambda line, word: f"coalesce(nullif(regexp_extract({line}, '([0-9]+)[^0-9]*{word}', 1), '')::BIGINT, {{}})"
    size = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    summary = "regexp_extract_all(t, '[^\n]* in [^\n]*')[-1]"
    total = "coalesce(regexp_extract(t, '(?m)^ *Tests:[^\n]*'), '')"
    marks = {"passed": size("✓"), "failed": size("[✗×]"), "skipped": "0"}
    go = [size(f"(?m)^ *--- {w}: ") for w in ("PASS", "FAIL", "SKIP")]
    pytest = [number(summary, w).format(0) for w in ("passed", "failed", "skipped")]
    vitest = [number(total, w).format(marks[w]) for w in marks]
    case = [size(r"<testcase name=\"a\"/>"), size("<failure/></testcase>"), size("<skipped/></testcase>")]
    each = {"gotest": go, "pytest": pytest, "vitest": vitest, "junit": case, "auto": [f"greatest({', '.join(x)})" for x in zip(pytest, vitest, go, case, strict=True)]}
    texts = ", ".join(f"t_{k} AS (SELECT conv_id, string_agg({{}}, '' ORDER BY turn) AS t FROM turns GROUP BY conv_id)".format("[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in v) + "][turn % 3 + 1]") for k, v in _CHUNKS.items())
    rows = " UNION ALL ".join(f"SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST({x[0]} AS BIGINT) AS passed, CAST({x[1]} AS BIGINT) AS failed, CAST({x[2]} AS BIGINT) AS skipped, 0::BIGINT AS inconclusive, '{k}' AS dialect FROM t_{k}" for k, x in each.items())
    return f"WITH turns AS (SELECT DISTINCT conv_id, turn FROM conversations), {texts} {rows}"


add("K8_test_counts_stream", _tests, _tests_sql())


def _last_tests(s, d):
    """The last chunk of a conversation has no line end; XML reports come in halves."""
    t = samples.table(s, d, "conversations").select("conv_id", "turn").distinct()
    most = t.groupBy("conv_id").agg(F.max("turn").alias("most"))
    key = [F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds("turn").alias("utc_timestamp"), F.format_string("%09d", "turn").alias("event_id"), (F.col("turn") == F.col("most")).alias("ended")]
    plain = t.join(most, "conv_id").select(*key, F.concat(F.lit("--- PASS: a\n--- "), F.lit("SKIP: b"), F.when(F.col("turn") < F.col("most"), "\n").otherwise("")).alias("text"))
    half = F.when(F.col("turn") % 2 == 0, '<testcase name="a"><failure message="x"/></testcase><testcase name="b"><ski').otherwise('pped/></testcase>\n<testcase name="c"/><testcase name="d"></testcase>')
    xml = t.join(most, "conv_id").select(*key, half.alias("text"))
    out = []
    for name, rows in (("gotest", plain), ("junit", xml)):
        path, n = fresh_path(s, "source"), _files(s, d, "conversations")  # in order of turns, as a session's output comes
        for part in ("event_id < '000000003'", "event_id >= '000000003'"):
            rows.filter(part).repartition(n, "session_id").write.mode("append").parquet(path)
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", n).parquet(path)
        last = lambda x: x.groupBy("session_id").agg(F.max_by(F.struct("passed", "failed", "skipped"), "__batch").alias("c")).select("session_id", "c.*")
        out.append(_updates(st.test_counts_stream(stream, name, "ended"), s, last).withColumn("dialect", F.lit(name)))
    return out[0].unionByName(out[1])


add(
    "K8_test_counts_to_the_end",
    _last_tests,
    """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 2 = 0) AS even, count(*) FILTER (turn % 2 = 1) AS odd FROM t GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS session_id, n AS passed, 0::BIGINT AS failed, n AS skipped, 'gotest' AS dialect FROM c
UNION ALL SELECT CAST(conv_id AS VARCHAR), 2 * odd, even, odd, 'junit' FROM c""",
)
