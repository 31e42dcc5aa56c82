"""The canonical inputs of the operators, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in few pieces over all cores; one that has enough partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user a session: kinds from event types, parents in a binary tree by sequence."""
    e = table(spark, sf_dir, "events")
    n = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    null = F.lit(None).cast("string")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project_id"),
        n.alias("sequence"),
        F.lit("sdk").alias("source"),
        F.col("event_type").alias("kind"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"),
        F.col("ts").cast("timestamp").alias("utc_timestamp"),
        (n * 1000).alias("monotonic_ns"),
        (F.round(F.col("value") * 100).cast("long") * 10000).alias("duration_ns"),
        null.alias("correlation_id"),
        null.alias("parent_event_id"),
        F.lit(1).alias("payload_version"),
        F.col("props").alias("payload"),
        F.lit("internal").alias("classification"),
        null.alias("previous_hash"),
        null.alias("current_hash"),
    )


def with_parents(ev: DataFrame) -> DataFrame:
    """Event number n > 0 has event (n - 1) / 2 of its session as parent."""
    p = ev.select("session_id", F.col("sequence").alias("__p"), F.col("event_id").alias("__parent"))
    up = F.when(F.col("sequence") > 0, F.floor((F.col("sequence") - 1) / 2).cast("long"))
    both = ev.withColumn("__p", up).join(p, ["session_id", "__p"], "left")
    return both.withColumn("parent_event_id", F.col("__parent")).select(*ev.columns)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    last = F.max_by("kind", "sequence")
    return ev.groupBy("session_id").agg(
        F.min("project_id").alias("project_id"),
        F.min("utc_timestamp").alias("started_at"),
        F.max("utc_timestamp").alias("stopped_at"),
        F.count(F.lit(1)).alias("source_event_count"),
        F.when(last == "error", "failed").otherwise("complete").alias("state"),
        F.when(last == "error", 1).otherwise(0).alias("exit_code"),
    ).withColumns({"command": F.concat(F.lit("job"), (F.col("session_id").cast("long") % 10).cast("string")), "labels": F.array(F.concat(F.lit("l"), (F.col("session_id").cast("long") % 3).cast("string")))})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session with the next one."""
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    both = ids.join(ids.select((F.col("user_id") - 1).alias("user_id")), "user_id")
    return both.select(F.col("user_id").cast("string").alias("baseline"), (F.col("user_id") + 1).cast("string").alias("candidate"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions of events, the text's digest as payload."""
    c = table(spark, sf_dir, "conversations")
    null = F.lit(None).cast("string")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.lit("p0").alias("project_id"),
        F.col("turn").alias("sequence"),
        F.lit("chat").alias("source"),
        F.coalesce("role", F.lit("none")).alias("kind"),
        F.lit("info").alias("severity"),
        F.timestamp_seconds(F.col("turn") + 1_700_000_000).alias("utc_timestamp"),
        F.col("turn").alias("monotonic_ns"),
        F.lit(None).cast("long").alias("duration_ns"),
        null.alias("correlation_id"),
        null.alias("parent_event_id"),
        F.lit(1).alias("payload_version"),
        F.concat(F.lit('{"text":"'), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit('"}')).alias("payload"),
        F.lit("public").alias("classification"),
        null.alias("previous_hash"),
        null.alias("current_hash"),
    )


def db_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as database calls: an order is a session, a line a statement."""
    li = table(spark, sf_dir, "lineitem")
    sql = F.concat(F.lit("SELECT * FROM part  WHERE p_partkey = "), F.col("l_partkey").cast("string"), F.lit(" AND p_brand = '"), F.col("l_returnflag"), F.lit("'"))
    flat = F.concat(F.lit("SELECT * FROM part WHERE p_partkey = ? AND p_brand = "), F.when(F.col("l_linenumber") % 2 == 0, "?").otherwise("'x'"))
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"),
        F.col("l_orderkey").cast("string").alias("session_id"),
        F.col("l_linenumber").cast("long").alias("sequence"),
        F.lit("db.query").alias("kind"),
        F.lit("info").alias("severity"),
        (F.round(F.col("l_extendedprice")).cast("long") * 1000).alias("duration_ns"),
        F.col("l_shipdate").cast("timestamp").alias("utc_timestamp"),
        F.to_json(F.struct(sql.alias("sql"), flat.alias("sql_normalized"))).alias("payload"),
    )


def provenance(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of region -> nation -> customer -> order, and nation -> supplier."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        (t("nation"), name("r", "n_regionkey"), name("n", "n_nationkey"), F.col("n_nationkey").cast("long"), "Contains"),
        (t("customer"), name("n", "c_nationkey"), name("c", "c_custkey"), F.col("c_custkey") + 1_000, "Serves"),
        (t("supplier"), name("n", "s_nationkey"), name("s", "s_suppkey"), F.col("s_suppkey") + 1_000_000_000, "Supplies"),
        (t("orders"), name("c", "o_custkey"), name("o", "o_orderkey"), F.col("o_orderkey") + 2_000_000_000, "Places"),
    ]
    edges = None
    for df, a, b, seq, kind in parts:
        e = df.select(seq.cast("long").alias("edge_seq"), a.alias("from"), b.alias("to"), F.lit(kind).alias("kind"), ((seq % 7) / 4.0).alias("weight"))
        edges = e if edges is None else edges.unionByName(e)
    nodes = edges.select(F.col("from").alias("id")).union(edges.select("to")).distinct()
    return nodes, edges


def register(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as subjects, parts as elements, orders as consents and requests, brands' rules."""
    c, p, o = (table(spark, sf_dir, n) for n in ("customer", "part", "orders"))
    day = 86_400_000_000_000
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    status = F.when(F.col("o_orderstatus") == "O", "withdrawn").otherwise("granted")
    return {
        "subjects": c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("region")),
        "elements": p.select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), (F.col("p_size") * 10).cast("long").alias("retention_days")),
        "consents": o.select(
            F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("id"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject_id"),
            F.col("o_orderpriority").alias("purpose"),
            at.alias("granted_at_ns"),
            F.when(F.col("o_orderstatus") != "P", at + F.lit(30 * day) * (F.col("o_orderkey") % 10)).alias("expires_at_ns"),
            status.alias("status"),
        ),
        "rules": p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("category"), (F.lit(200) + F.col("p_partkey") % 200).cast("long").alias("max_retention_days")),
        "requests": o.select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject_id"), F.when(F.col("o_orderkey") % 50 == 0, "open").when(F.col("o_orderkey") % 50 == 1, "in_progress").otherwise("fulfilled").alias("status")),
    }


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as steps of a request."""
    li = table(spark, sf_dir, "lineitem")
    steps = F.element_at(F.array(*map(F.lit, ("in_progress", "fulfilled", "denied", "open"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    return li.select(F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_linenumber").cast("long").alias("ord"), steps.alias("status"))


def test_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as test runs whose output is spelled from their lines, in each of three dialects."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 9).alias("a"), (F.col("o_orderkey") % 4).alias("b"))
    s = lambda c: F.col(c).cast("string")
    text = {
        "pytest": F.concat(F.lit("tests/t.py ...\n=== "), s("a"), F.lit(" passed, "), s("b"), F.lit(" failed, 2 skipped in 0.42s ===\n")),
        "vitest": F.concat(F.repeat(F.lit("  ✓ alpha\n"), F.col("a").cast("int")), F.repeat(F.lit("  × beta\n"), F.col("b").cast("int")), F.when(F.col("b") == 3, F.concat(F.lit("Tests: 1 failed, "), s("a"), F.lit(" passed, 1 skipped (5)\n"))).otherwise("")),
        "gotest": F.concat(F.repeat(F.lit("--- PASS: TestFoo\n"), F.col("a").cast("int")), F.repeat(F.lit('{"Action":"fail","Test":"x"}\n'), F.col("b").cast("int"))),
    }
    return o.select(F.col("o_orderkey").cast("string").alias("session_id"), *[v.alias(k) for k, v in text.items()])


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs with five variables each, values from their columns."""
    c = table(spark, sf_dir, "customer")
    keys = ["path", "NODE_VERSION", "GITHUB_ACTIONS", "LOOM_MODE", "AWS_SECRET"]
    values = [F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.concat("c_name", F.lit(" "), F.col("c_mktsegment")), F.col("c_acctbal").cast("string")]
    return c.select(F.col("c_custkey").alias("session"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in zip(keys, values, strict=True)])).alias("v")).select(F.col("session").cast("string").alias("session_id"), "v.key", "v.value")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as file changes: paths from their numbers, some of them in ignored folders."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    folder = F.element_at(F.array(*map(F.lit, ("/proj/src/", "/proj/node_modules/x/", "/proj2/src/", "C:\\proj\\", "/proj/.git/"))), (k % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("create", "modify", "remove", "modify.name", "any", "access"))), (k % 6 + 1).cast("int"))
    return p.select(k.alias("file_id"), F.concat(folder, F.lit("f"), k.cast("string"), F.when(k % 7 == 0, "").otherwise(".rs")).alias("path"), kind.alias("raw_kind"), F.col("p_size").cast("long").alias("size"))
