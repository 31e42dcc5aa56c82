"""Operators on streams: ingest, counts, fan-out, sealing, redaction, throttling, deduplication.

Sealing and throttling are state processors over event time: a key's events wait in a list until the
watermark has passed them and are then taken in order of (time, event id), whatever batches they came
in.  So a stream gives what the batch operator gives for all events that are not later than the
watermark (those are dropped, as by every operator with a watermark).  What waits is what is younger than
the watermark; a key that is idle for long enough loses its state.  State needs the RocksDB store, which
these operators choose for their session.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions import test_output
from ..functions.redact import PATTERNS, redact_payload
from ..operators.chain import GENESIS, canonical_json
from ..sources.tables import append_events

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of keys of which each has one state.
BUCKETS = 1024
#: How rows travel through a state: as JSON, with the precision of Spark's timestamps.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Appends events to a store batch by batch.  A batch has the name of its checkpoint and its number, so
    one that is run again after a failure is known to the store and adds nothing."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    writer = stream.writeStream.foreachBatch(lambda batch, n: append_events(batch, path, f"{name}-{n}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def running_counts(stream: DataFrame) -> DataFrame:
    """Events of each session so far (update mode)."""
    return stream.groupBy("session_id").agg(F.count(F.lit(1)).alias("source_event_count"))


def subscribe(stream: DataFrame, session_id: str | None = None) -> DataFrame:
    return stream if session_id is None else stream.filter(F.col("session_id") == session_id)


def fan_out(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(consumer, event) rows of all subscriptions (consumer, session_id) at once; a null session is all of them.

    The source is read once: each event meets the subscriptions to its session and those to all in one join.
    A consumer gets an event once, however often it has subscribed."""
    everyone = subscriptions.filter("session_id IS NULL").select("consumer").distinct()
    some = subscriptions.filter("session_id IS NOT NULL").select("consumer", "session_id").distinct().join(everyone, "consumer", "left_anti")
    wanted = some.select("consumer", F.lit(False).alias("__all"), F.col("session_id").alias("__key")).unionByName(everyone.select("consumer", F.lit(True).alias("__all"), F.lit("").alias("__key")))
    keys = F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col("session_id").alias("key")), F.struct(F.lit(True).alias("all"), F.lit("").alias("key"))))
    each = stream.withColumn("__k", keys).withColumns({"__all": F.col("__k.all"), "__key": F.col("__k.key")}).drop("__k")
    return each.join(wanted, ["__all", "__key"]).select("consumer", *stream.columns)


def redact_stream(stream: DataFrame, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    return redact_payload(stream, patterns)


def dedupe_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event id once; events later than the watermark are dropped."""
    return stream.withWatermark("utc_timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: StructType | str, mode: str, time: str, event_time: str = "") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, time, eventTimeColumnName=event_time)


class _InOrder(StatefulProcessor):
    """Hands a key's waiting rows (at: microseconds, id, row) to fold() in order, once the watermark has
    passed them, and ends the key's state `idle_ms` of event time after its last row."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")  # each a packed run of rows
        self.latest = handle.getValueState("latest", "at long")

    def fold(self, key, rows: list[tuple[int, str, str | None]]) -> dict[str, object] | None:
        """Columns of what comes out, if anything does."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def _wake(self, ms: int) -> None:
        """One timer of a key at most: the earliest."""
        timers = list(self.handle.listTimers())
        if not timers or ms < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = last = None
        for pdf in rows:
            if not len(pdf):
                continue
            us = pdf["us"].tolist()
            self.waiting.appendList([(_pack(us, pdf["id"].tolist(), pdf["row"].tolist()),)])
            low, high = min(us), max(us)
            first, last = (low, high) if first is None else (min(first, low), max(last, high))
        if first is not None:
            known = self.latest.get()[0] if self.latest.exists() else last
            self.latest.update((max(known, last),))
            self._wake(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((r for run in self.waiting.get() for r in zip(*json.loads(run[0]), strict=True)), key=lambda r: (r[0], r[1] is not None, r[1]))
        ready = [r for r in rows if r[0] <= now * 1000]
        if len(ready) < len(rows):
            self.waiting.put([(_pack(*zip(*rows[len(ready) :], strict=True)),)])
            self._wake(-(-rows[len(ready)][0] // 1000))
        else:
            self.waiting.clear()
            ends = None if self.idle_ms is None else self.latest.get()[0] // 1000 + self.idle_ms
            if ends is not None and ends > now:
                self._wake(ends)
        made = self.fold(key, ready) if ready else None
        if len(ready) == len(rows) and self.idle_ms is not None and ends <= now:
            self.forget()
            self.latest.clear()
        if made is not None:
            yield pd.DataFrame(made)

    def close(self) -> None:
        pass


def _pack(*columns) -> str:
    return json.dumps(columns, ensure_ascii=False)


class _Sealer(_InOrder):
    def __init__(self, most: int | None, idle_ms: int | None):
        super().__init__(idle_ms)
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.head = handle.getValueState("head", "number long, hash string")

    def forget(self) -> None:
        self.head.clear()

    def fold(self, key, rows):
        number, last = self.head.get() if self.head.exists() else (0, GENESIS)
        out = []
        for _, _, row in rows if self.most is None else rows[: max(0, self.most - number)]:
            before, after, event = row.split("\x1e", 2)
            digest = hashlib.sha256(f"{before}{number}{after}".encode()).hexdigest()
            new = hashlib.sha256(f"{digest}|{last}".encode()).hexdigest()
            out.append((event, number, last, new))
            number, last = number + 1, new
        self.head.update((number, last))
        return dict(zip(("row", "sequence", "previous_hash", "current_hash"), zip(*out, strict=True), strict=True)) if out else None


def seal_stream(stream: DataFrame, most: int | None = None, delay: str = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """Events with sequence, previous and current hash, in order of (utc_timestamp, event_id) of each session.

    An event comes out when the watermark (`delay` behind the latest event) has passed it.  After `most` events
    of a session no more come.  A session without events for `idle_ms` of event time is closed: its state goes, and
    a later event would start a new chain."""
    names = [c for c in stream.columns if c not in ("previous_hash", "current_hash", "sequence")]
    kept = stream.select(*names).schema
    # the canonical text holds the number that the state gives: it is cut at that place
    marked = stream.withWatermark("utc_timestamp", delay).withColumn("sequence", F.lit(-9_000_000_001).cast("long")).withColumn("__text", canonical_json())
    row = F.concat_ws("\x1e", F.substring_index("__text", "-9000000001", 1), F.substring_index("__text", "-9000000001", -1), F.to_json(F.struct(*names), _JSON))
    parts = marked.select("session_id", "utc_timestamp", F.unix_micros("utc_timestamp").alias("us"), F.col("event_id").alias("id"), row.alias("row"))
    sealed = _stateful(parts, "session_id", _Sealer(most, idle_ms), "row string, sequence long, previous_hash string, current_hash string", "append", "eventTime")
    back = sealed.withColumn("__e", F.from_json("row", kept, _JSON))
    return back.select("__e.*", "sequence", "previous_hash", "current_hash")


class _Throttle(_InOrder):
    """Throttles the keys of a bucket, each for itself; a row is "=" and its key, "" for a null key."""

    def __init__(self, gap_us: int, idle_ms: int | None):
        super().__init__(idle_ms)
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "pairs string")

    def forget(self) -> None:
        self.kept.clear()

    def fold(self, key, rows):
        last = dict(json.loads(self.kept.get()[0])) if self.kept.exists() else {}
        keys, times, ids = [], [], []
        for at, event, row in rows:
            own = key[0] if row is None else row[1:] if row else None
            if own not in last or at - last[own] >= self.gap_us:
                last[own] = at
                keys.append(own)
                times.append(at)
                ids.append(event)
        # what comes later is not before the last row, so a key that is a gap behind it needs no memory
        self.kept.update((json.dumps([(k, at) for k, at in last.items() if rows[-1][0] - at < self.gap_us]),))
        return {"key": keys, "event_id": ids, "utc_timestamp": pd.to_datetime(times, unit="us", utc=True)} if ids else None


def throttle_stream(stream: DataFrame, key: str, gap_ms: int = 50, delay: str = "0 seconds") -> DataFrame:
    """(key, event_id, utc_timestamp) of events at least a gap after the last one kept of their key; a key's state ends
    when no event within a gap of its last one can come any more."""
    return _throttled(stream.withWatermark("utc_timestamp", delay), key, gap_ms)


def _throttled(timed: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """A state has a bucket of keys: a call of the state costs as much for a thousand keys as for one."""
    own = F.col(key).cast("string")
    row = F.coalesce(F.concat(F.lit("="), own), F.lit(""))
    rows = timed.select(F.pmod(F.xxhash64(own), F.lit(BUCKETS)).alias("bucket"), "utc_timestamp", F.unix_micros("utc_timestamp").alias("us"), F.col("event_id").alias("id"), row.alias("row"))
    return _stateful(rows, "bucket", _Throttle(gap_ms * 1000, gap_ms), "key string, event_id string, utc_timestamp timestamp", "append", "eventTime", "utc_timestamp")


def throttle_paths_stream(stream: DataFrame, paths: str, gap_ms: int = 50, delay: str = "0 seconds") -> DataFrame:
    """(event_id, utc_timestamp) of events of which at least one path comes a gap after the last one kept of that path.

    Two states, one after the other under one watermark: each path is throttled for itself, then an event
    that some path let through is kept once.  An event without paths is never kept, but moves the watermark: it
    is dropped by the outer explode's null place, as a plain explode drops it before the watermark sees it."""
    timed = stream.withWatermark("utc_timestamp", delay)
    each = timed.select("event_id", "utc_timestamp", F.posexplode_outer(F.array_distinct(paths)).alias("__at", "__path")).filter("__at IS NOT NULL")
    passed = _throttled(each.drop("__at"), "__path", gap_ms)
    return passed.select("event_id", "utc_timestamp").dropDuplicatesWithinWatermark(["event_id"])


class _Tests(StatefulProcessor):
    """The outputs of a bucket of sessions so far, and their counts after each batch."""

    def __init__(self, dialect: str, idle_ms: int | None):
        self.dialect, self.idle_ms = dialect, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.outputs = handle.getValueState("outputs", "sessions string")  # [session, output, when it ends]

    def _keep(self, outputs: dict) -> None:
        if outputs:
            self.outputs.update((json.dumps([(s, *x) for s, x in outputs.items()], ensure_ascii=False),))
        else:
            self.outputs.clear()
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if outputs:
                self.handle.registerTimer(min(end for _, end in outputs.values()))

    def _known(self) -> dict:
        return {s: (x, end) for s, x, end in json.loads(self.outputs.get()[0])} if self.outputs.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["utc_timestamp", "event_id"], kind="stable")
        chunks: dict = {}
        for session, at, text, ended in zip(pdf["session_id"], pdf["utc_timestamp"], pdf["text"], pdf["ended"], strict=True):
            own = chunks.setdefault(None if pd.isna(session) else session, ([], []))
            own[0].append("" if pd.isna(text) else text)
            own[1].append((at, ended))
        known, out = self._known(), []
        for session, (texts, marks) in chunks.items():
            output = test_output.Output.loads(known[session][0]) if session in known else test_output.Output()
            output.add("".join(texts))
            if any(ended for _, ended in marks):
                known.pop(session, None)
            else:
                end = None if self.idle_ms is None else max(int(max(at for at, _ in marks).value // 1_000_000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
                known[session] = (output.dumps(), end)
            out.append((session, *output.counts(self.dialect)))
        self._keep(known)
        yield pd.DataFrame(out, columns=["session_id", "passed", "failed", "skipped", "inconclusive"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self._keep({s: x for s, x in self._known().items() if x[1] > now})
        return iter(())

    def close(self) -> None:
        pass


def test_counts_stream(stream: DataFrame, dialect: str = "gotest", ended: str | None = None, idle_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Test counts of each session so far, from chunks (session_id, utc_timestamp, event_id, text); update mode.

    Each batch gives a session's counts over all its output until then, as the batch function has them
    for the text in one piece, however it was cut.  The column `ended` tells a session's last chunk, after
    which its state goes; so it does after `idle_ms` of event time without any (then a watermark `delay` behind
    the latest chunk drops later ones)."""
    last = F.lit(False) if ended is None else F.coalesce(F.col(ended), F.lit(False))
    rows = (stream if idle_ms is None else stream.withWatermark("utc_timestamp", delay)).select(F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).alias("bucket"), "session_id", "utc_timestamp", "event_id", "text", last.alias("ended"))
    schema = "session_id string, passed long, failed long, skipped long, inconclusive long"
    return _stateful(rows, "bucket", _Tests(dialect, idle_ms), schema, "update", "none" if idle_ms is None else "eventTime")
