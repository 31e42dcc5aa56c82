"""Stream operators: sealed chains over restarts, closing of idle keys, test output however it is cut."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.functions import test_output as output
from eventloom.functions import text
from eventloom.operators import aggregates, chain, filters, graph
from eventloom.sources import bundles, tables
from eventloom.streaming import operators as st
from test_rules import make_events, sealed

PARTS = ["✓ a", "✗ b", "× c ✓", " Tests: 1 failed, 2 passed", "Tests: 3 skipped 4 passed", "\n", "\n", "\n", "== 3 passed, 1 failed in 2s", "1 error in 3", "x in passed", "--- PASS: a", "  --- FAIL: b", "--- SKIP: ", '{"Action":"pass"}', '"Action":"fail"', "<testcase", ' name="a"', "/>", ">", "</testcase>", "<failure ", "<error>", "<skipped/>", "<testcas", "e ", "12 ", "é", "/ >", "\r\n"]


def test_output_counts_alike_under_every_cut(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(1500)] + ["", "\n", "✓ a\n✓ b\nTests: 1 failed, 1 passed\n", "1 passed in 1s\n3 passed, 1 failed in 2s\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    want = {r["i"]: r for r in df.select("i", *[text.test_counts(F.col("t"), d).alias(d) for d in output.DIALECTS]).collect()}
    for i, t in enumerate(texts):
        got, at = output.Output(), 0
        while at < len(t):
            n = rng.randrange(1, 9)
            got.add(t[at : at + n])
            at += n
            got = output.Output.loads(got.dumps())
        for d in output.DIALECTS:
            assert tuple(want[i][d]) == tuple(got.counts(d)), (t, d)
    with pytest.raises(ValueError):
        output.Tally().counts("other")


def test_merging_tallies_is_associative():
    rng = random.Random(9)
    for _ in range(300):
        a, b, c = (output.of_lines([rng.choice(PARTS) for _ in range(4)]) for _ in range(3))
        assert a.then(b).then(c) == a.then(b.then(c))


def run(stream, schema, spark, sink, checkpoint):
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(sink)


def test_sealed_stream_is_the_batch_chain_over_a_restart(spark, tmp_path):
    rows = [(s, i, "test.sample", "info", i, f'{{"sequence":{i}}}') for s in "ab" for i in range(7)]
    events = make_events(spark, rows)
    mark = make_events(spark, [("end", 0, "end", "info", 10_000, None)])
    source, sink, checkpoint = (str(tmp_path / x) for x in ("source", "sink", "checkpoint"))
    schema = st.seal_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path))).schema
    for part in (events.filter("sequence IN (1, 3)"), events.filter("sequence IN (0, 2)"), events.filter("sequence > 3").unionByName(mark)):
        part.repartition(2).write.mode("append").parquet(source)  # each part is a run of its own; events come late
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        got = run(st.seal_stream(stream, delay="1 hour"), schema, spark, sink, checkpoint)
    want = {(r["session_id"], r["sequence"]): r["current_hash"] for r in chain.seal_chain(events).collect()}
    assert {(r["session_id"], r["sequence"]): r["current_hash"] for r in got.collect()} == want
    assert all(r["ok"] for r in chain.verify_chain(got).collect())


class Value:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x

    put = update

    def clear(self):
        self.x = None


class Rows(Value):
    def get(self):
        return iter(self.x or [])

    def appendList(self, rows):
        self.x = (self.x or []) + rows


class Handle:
    """States and timers in memory."""

    def __init__(self):
        self.timers, self.states = set(), {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getListState(self, name, schema):
        return self.states.setdefault(name, Rows())

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def fire(p, handle, ms):
    out = []
    for t in sorted(x for x in handle.timers if x <= ms):
        handle.timers.discard(t)
        out += list(p.handleExpiredTimer(("k",), Clock(ms), None))
    return [r for pdf in out for r in pdf.itertuples(index=False, name=None)]


def test_waiting_rows_come_in_order_and_idle_keys_end():
    handle, p = Handle(), st._Throttle(50_000, 1000)
    p.init(handle)
    feed = lambda *us: list(p.handleInputRows(("k",), iter([pd.DataFrame({"us": us, "id": [str(u) for u in us], "row": None})]), Clock(0)))
    assert feed(90_000, 10_000) == [] and feed(40_000, 65_000) == [] and len(handle.timers) == 1
    assert [r[1] for r in fire(p, handle, 50)] == ["10000"] and handle.timers == {65}
    assert [r[1] for r in fire(p, handle, 90)] == ["65000"] and handle.timers == {1090}
    feed(500_000)
    assert [r[1] for r in fire(p, handle, 500)] == ["500000"] and fire(p, handle, 1400) == []
    assert fire(p, handle, 1500) == [] and not handle.timers and not any(x.exists() for x in handle.states.values())


def test_a_bucket_throttles_each_of_its_keys_in_few_calls():
    handle, p, calls = Handle(), st._Throttle(50_000, 50), []
    p.init(handle)
    rng = random.Random(3)
    rows = [(rng.randrange(5_000_000), str(i), rng.choice(["", "=", "=a", "=b é"])) for i in range(400)]
    update = p.kept.update
    p.kept.update = lambda x: calls.append(x) or update(x)
    for part in (rows[:200], rows[200:]):
        us, ids, keys = zip(*part, strict=True)
        assert list(p.handleInputRows((7,), iter([pd.DataFrame({"us": us, "id": ids, "row": keys})]), Clock(0))) == []
    got = fire(p, handle, 2500) + fire(p, handle, 6000)
    want, last = [], {}
    for at, i, row in sorted(rows):
        if row not in last or at - last[row] >= 50_000:
            last[row] = at
            want.append((row[1:] if row else None, i))
    assert [(k if isinstance(k, str) else None, i) for k, i, _ in got] == want and len(calls) == 2
    assert not handle.timers and not any(x.exists() for x in handle.states.values())


def test_a_bucket_counts_tests_of_each_of_its_sessions():
    handle, p = Handle(), st._Tests("gotest", 1000)
    p.init(handle)
    at = lambda s: pd.Timestamp(s, unit="s")
    rows = [("a", at(2), "2", "SS: x\n", False), ("b", at(1), "1", "--- FAIL: y\n", False), ("a", at(1), "1", "--- PA", False), ("c", at(3), "3", None, True)]
    feed = lambda rows: [tuple(r) for pdf in p.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["session_id", "utc_timestamp", "event_id", "text", "ended"])]), Clock(0)) for r in pdf.itertuples(index=False)]
    assert sorted(feed(rows)) == [("a", 1, 0, 0, 0), ("b", 0, 1, 0, 0), ("c", 0, 0, 0, 0)] and handle.timers == {2000}
    assert fire(p, handle, 2000) == [] and handle.timers == {3000}  # b is gone
    assert sorted(feed([(s, at(4), "4", "--- SKIP: z\n", s == "a") for s in "ab"])) == [("a", 1, 0, 1, 0), ("b", 0, 0, 1, 0)]
    assert fire(p, handle, 5000) == [] and not handle.timers and not any(x.exists() for x in handle.states.values())


def test_throttled_paths_on_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(str(i), dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=rng.randrange(3000)), rng.sample(["a", "b", "c"], rng.randrange(1, 4))) for i in range(150)]
    ddl = "event_id string, utc_timestamp timestamp, paths array<string>"
    events = spark.createDataFrame(rows, ddl)
    last = spark.createDataFrame([("end", dt.datetime(2024, 2, 1), ["z"])], ddl)
    source = str(tmp_path / "source")
    events.repartition(3).write.parquet(source)
    last.write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    got = run(st.throttle_paths_stream(stream, "paths", 50, "1 day"), "event_id string", spark, str(tmp_path / "sink"), str(tmp_path / "checkpoint"))
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in filters.throttle_paths(events, "paths", 50).collect())


@pytest.mark.parametrize("none", [None, []])
def test_an_event_without_paths_moves_the_watermark(spark, tmp_path, none):
    day = dt.datetime(2024, 1, 1)
    rows = [(str(i), day + dt.timedelta(milliseconds=30 * i), ["a", None]) for i in range(4)] + [("bare", day, none), ("end", day + dt.timedelta(days=40), none)]
    ddl = "event_id string, utc_timestamp timestamp, paths array<string>"
    source = str(tmp_path / "source")
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(source)
    got = run(st.throttle_paths_stream(spark.readStream.schema(ddl).parquet(source), "paths", 50, "1 day"), "event_id string", spark, str(tmp_path / "sink"), str(tmp_path / "checkpoint"))
    assert sorted(r["event_id"] for r in got.collect()) == ["0", "2"]


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    n, calls = 10_000, []
    plain = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, tag: calls.append(tag) or plain(df, tag))
    edges = spark.range(n).select(F.col("id").cast("string").alias("from"), (F.col("id") + 1).cast("string").alias("to"), F.col("id").alias("to_sequence"))
    got = graph.follow_chain(edges, spark.createDataFrame([("0",)], "id string"))
    assert got.filter("step != cast(id AS long)").count() == 0 and got.count() == n + 1 and calls.count("chain") < 20
    loop = spark.createDataFrame([("x", "a", 0), ("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("a", "z", 1)], "from string, to string, to_sequence long")
    starts = spark.createDataFrame([("x",), ("b",), ("q",)], "id string")
    chains = {}
    for r in graph.follow_chain(loop, starts).orderBy("start", "step").collect():
        chains.setdefault(r["start"], []).append(r["id"])
    assert chains == {"x": ["x", "a", "b", "c"], "b": ["b", "c", "a"], "q": ["q"]}
    assert graph.follow_chain(loop, starts, 1).count() == 5


def test_paths_keep_only_prefixes_that_can_end(spark, monkeypatch):
    edges = [(f"s{i}", f"s{i + 1}") for i in range(4)] + [("s1", f"dead{i}") for i in range(30)] + [(f"dead{i}", "pit") for i in range(30)] + [("s0", "s2"), ("s3", "s1"), ("s4", "s0")]
    df = spark.createDataFrame(edges, "from string, to string")
    pairs = spark.createDataFrame([("s0", "s4"), ("s0", "s0"), ("pit", "s4")], "source string, target string")
    staged, plain = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda d, tag: staged.append((tag, d)) or plain(d, tag))
    got = sorted(tuple(r["path"]) for r in graph.all_paths(df, pairs, 5).collect())
    assert got == [("s0",), ("s0", "s1", "s2", "s3", "s4"), ("s0", "s2", "s3", "s4")]
    assert not any("dead" in x for tag, d in staged if tag == "paths" for r in d.collect() for x in r["path"])


def test_paths_meet_only_edges_to_their_targets(spark, monkeypatch):
    """A hub with many leaves: joined by nodes alone, every path at the hub would meet every leaf."""
    edges = [("root", "hub"), ("root", "hub")] + [("hub", f"leaf{i}") for i in range(50)]
    df = spark.createDataFrame(edges, "from string, to string")
    pairs = spark.createDataFrame([("root", f"leaf{i}") for i in range(50)], "source string, target string")
    staged, plain = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda d, tag: staged.append((tag, d)) or plain(d, tag))
    got = sorted((r["target"], tuple(r["path"])) for r in graph.all_paths(df, pairs, 4).collect())
    assert got == sorted((f"leaf{i}", ("root", "hub", f"leaf{i}")) for i in range(50) for _ in range(2))
    plans = [d._jdf.queryExecution().optimizedPlan().toString().splitlines() for tag, d in staged if tag == "paths"]
    joins = [x for lines in plans for x in lines if "Join " in x]
    assert len(joins) >= 2 and all("target#" in x for x in joins)


def test_archive_lists_what_it_wrote_once(spark, tmp_path):
    events = sealed(spark).unionByName(chain.seal_chain(make_events(spark, [("t", i, "k", "info", i, "{}") for i in range(3)])))
    broken = events.withColumn("current_hash", F.when((F.col("session_id") == "t") & (F.col("sequence") == 1), "x").otherwise(F.col("current_hash")))
    sessions = events.groupBy("session_id", "project_id").agg(F.min("utc_timestamp").alias("started_at"))
    out = str(tmp_path / "archive")
    assert {r["session_id"] for r in bundles.archive_sessions(broken, sessions, out, 0).collect()} == {"s"}
    assert bundles.archive_sessions(broken, sessions, out, 0).count() == 0
    assert {r["session_id"] for r in bundles.archive_sessions(events, sessions, out, 0).collect()} == {"t"}
    assert spark.read.parquet(f"{out}/listing").count() == 2


def test_appends_read_touched_buckets_and_know_their_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"s{i % 3}", i, "k", "info", i, "{}") for i in range(40)]
    events = make_events(spark, rows)
    unnamed = make_events(spark, [("s0", 90, "k", "info", 1, "{}")]).withColumn("event_id", F.lit(None).cast("string"))
    tables.append_events(events.limit(30).unionByName(unnamed), path, "b1")
    tables.append_events(events, path, "b1")  # a name that is known adds nothing
    assert tables.load_events(spark, path).count() == 31
    got = tables.append_batch(events.unionByName(events).unionByName(unnamed), path, "b2")
    assert {r["session_id"]: r["source_event_count"] for r in got.collect()} == {"s0": 15, "s1": 13, "s2": 13}
    assert tables.load_events(spark, path).count() == 41 and tables.load_events(spark, path).columns == events.columns
    plan = tables.stored_keys(spark, path, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "IN (3,5)" in plan


def test_merged_sketches_are_near_the_exact_percentiles(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("s").alias("session_id"), F.lit("profiler.sample").alias("kind"), F.to_json(F.struct(((F.col("id") * 7919) % n).alias("rss_bytes"))).alias("payload"), (F.col("id") % 4).alias("part"))
    parts = None
    for k in range(4):
        own = aggregates.profile_parts(rows.filter(F.col("part") == k))
        parts = own if parts is None else aggregates.merge_profiles(parts.unionByName(own))
    r = aggregates.profile_report(parts).first()
    assert r["samples"] == n and abs(r["rss_p50"] - n / 2) < n / 100 and abs(r["rss_p95"] - 0.95 * n) < n / 100
    assert (r["rss_min"], r["rss_max"], r["virtual_p50"], r["virtual_min"]) == (0, n - 1, None, None)


def hops(edges, start):
    """{id: hops} by a plain search."""
    found, level, n = {}, {start}, 0
    while level:
        n += 1
        level = {v for u, v in edges if u in level} - set(found)
        found |= dict.fromkeys(level, n)
    return found


@pytest.mark.parametrize("seed", range(2))
def test_reach_is_that_of_a_plain_search(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(graph, "SHALLOW", 1 + seed % 2)
    edges = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(22)}
    edges |= {(f"p{i}", f"p{i + 1}") for i in range(20)} | {("p20", "n1"), ("n2", "p0"), ("n3", "p7")}  # a path, entered at two places
    edges |= {(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)} | {("x", "x")}  # a cycle without a way in, a loop
    df = spark.createDataFrame(sorted(edges), "from string, to string")
    starts = ["n0", "n2", "n3", "p5", "c3", "x", "none"]
    for back in (False, True):
        got = {(r["start"], r["id"]): r["hops"] for r in graph.reach(df, spark.createDataFrame([(s,) for s in starts], "id string"), back=back).collect()}
        plain = {(b, a) for a, b in edges} if back else edges
        assert got == {(s, i): n for s in starts for i, n in hops(plain, s).items()}


def test_reach_along_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, calls = 5000, []
    plain = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, tag: calls.append(tag) or plain(df, tag))
    edges = spark.range(n).select(F.col("id").cast("string").alias("from"), (F.col("id") + 1).cast("string").alias("to"))
    got = graph.descendants(edges, spark.createDataFrame([("0",)], "id string"))
    assert got.count() == n and got.filter("hops != cast(id AS int)").count() == 0 and len(calls) < 45


def test_lineage_is_the_shortest_path_entered_first(spark):
    rng = random.Random(11)
    edges = [(n, f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", float(rng.randrange(9))) for n in range(45)]
    paths = {}
    for s in (f"n{i}" for i in range(14)):
        best = {s: (0, [], [s], 0.0)}
        level = dict(best)
        while level:
            new = {}
            for u, (n, seqs, path, w) in level.items():
                for q, a, b, x in edges:
                    if a == u and b not in best and (b not in new or [*seqs, q] < new[b][1]):
                        new[b] = (n + 1, [*seqs, q], [*path, b], w + x)
            best |= new
            level = new
        paths |= {(s, t): x[1:] for t, x in best.items()}
    df = spark.createDataFrame(edges, "edge_seq long, from string, to string, weight double")
    pairs = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(14) for j in range(14)] + [("n1", "no"), ("n1", "n2")], "source string, target string")
    got = {(r["source"], r["target"]): (r["edge_seqs"], r["path"], r["weight"]) for r in graph.trace_lineage(df, pairs).collect()}
    assert got == paths


def test_files_of_a_stream_follow_its_table(spark, tmp_path, monkeypatch):
    from eventloom.plans import streams

    spark.range(400).repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    rows = spark.read.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(streams, "fresh_path", lambda s, tag: str(tmp_path / "source"))
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, "600b")
    try:
        streams._stream(spark, str(tmp_path), rows)
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
    assert len(list((tmp_path / "source").glob("*.parquet"))) >= 48
    assert spark.read.parquet(str(tmp_path / "source")).distinct().count() == 400
