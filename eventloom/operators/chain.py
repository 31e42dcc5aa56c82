"""Hash chains: canonical text, sealing and verification.

SHA-256 stands for the hash; a link is sha2(digest || '|' || previous), digest being sha2 of the
canonical text.  The first event's previous hash is GENESIS.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import pieces, stage

GENESIS = "0" * 64
#: Characters of a packed block of sorted rows, about, and rows added to it at a time.
BLOCK_TEXT, BLOCK_ROWS = 1 << 16, 1024
_BEFORE = ["classification", "correlation_id", "duration_ns", "event_id", "kind", "monotonic_ns", "parent_event_id"]
_AFTER = ["payload_version", "project_id", "sequence", "session_id", "severity", "source"]


def rfc3339(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))


def canonical_json() -> Column:
    """An event as JSON with keys in order, null optionals left out, the payload's keys sorted too.

    A payload that isn't JSON goes in as text."""
    head = F.to_json(F.struct(*_BEFORE))
    tail = F.to_json(F.struct(*_AFTER, rfc3339(F.col("utc_timestamp")).alias("utc_timestamp")))
    payload = F.coalesce(F.to_json(F.try_parse_json("payload")), F.regexp_extract(F.to_json(F.struct(F.col("payload").alias("p"))), r"^\{\"p\":(.*)\}$", 1), F.lit("null"))
    payload = F.when(F.col("payload").isNull(), "null").otherwise(payload)
    return F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"payload":'), payload, F.lit(","), F.substring(tail, 2, F.length(tail)))


def dump_canonical(events: DataFrame) -> DataFrame:
    """(session_id, sequence, line): canonical text with both hashes, one line for each event."""
    c = canonical_json()
    hashes = F.to_json(F.struct(F.col("previous_hash"), F.col("current_hash")))
    line = F.when(hashes == "{}", c).otherwise(F.concat(F.substring(c, 1, F.length(c) - 1), F.lit(","), F.substring(hashes, 2, F.length(hashes))))
    return events.select("session_id", "sequence", line.alias("line"))


def link(digest: Column, previous: Column) -> Column:
    return F.sha2(F.concat(digest, F.lit("|"), previous), 256)


def seal_chain(events: DataFrame) -> DataFrame:
    """events with previous_hash and current_hash in order of sequence within each session.

    Digests are made in parallel; the fold reads each session's sorted rows as a stream, so a long
    session needs time but no memory."""
    rest = [c for c in events.columns if c not in ("previous_hash", "current_hash")]
    rows = events.select(*rest, F.sha2(canonical_json(), 256).alias("__digest"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, last = None, GENESIS
        for pdf in batches:
            before, after = [], []
            for s, d in zip(pdf["session_id"], pdf["__digest"], strict=True):
                if s != session:
                    session, last = s, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{d}|{last}".encode()).hexdigest()
                after.append(last)
            yield pdf.drop(columns="__digest").assign(previous_hash=before, current_hash=after)

    schema = events.select(*rest, F.lit("").alias("previous_hash"), F.lit("").alias("current_hash")).schema
    return rows.repartition("session_id").sortWithinPartitions("session_id", "sequence").mapInPandas(fold, schema).select(*events.columns, *[c for c in ("previous_hash", "current_hash") if c not in events.columns])


def check_events(events: DataFrame, level: str = "full") -> DataFrame:
    """Every event with its index, first fault (or null), expected and found hash.

    Until the first fault a stored previous hash equals the recomputed one, so every row is checked
    against its neighbour's stored hash: no sequential pass.  level 'hash' recomputes hashes only."""
    w = W.partitionBy("session_id").orderBy("sequence", "event_id")
    expected = F.coalesce(F.lag("current_hash").over(w), F.when(F.row_number().over(w) == 1, GENESIS))
    rows = events.withColumns({"event_index": (F.row_number().over(w) - 1).cast("long"), "__before": expected, "__late": F.date_trunc("second", "utc_timestamp") < F.lag(F.date_trunc("second", "utc_timestamp")).over(w)})
    made = link(F.sha2(canonical_json(), 256), F.col("previous_hash"))
    wrong = F.coalesce(made != F.col("current_hash"), F.lit(True))
    fault = F.when(wrong, "HashMismatch")
    if level == "full":
        fault = (
            F.when(F.col("previous_hash").isNull(), "BadGenesis")
            .when(~F.col("previous_hash").eqNullSafe(F.col("__before")), "BrokenLink")
            .when(F.col("sequence") != F.col("event_index"), "SequenceGap")
            .when(F.col("__late"), "TimeOutOfOrder")
            .when(wrong, "HashMismatch")
        )
    return rows.withColumns({"error": fault, "expected": made}).drop("__before", "__late")


def verify_chain(events: DataFrame, level: str = "full") -> DataFrame:
    """(session_id, ok, events, event_index, error, expected, found): the first fault of each session."""
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("event_index", "error", "expected", F.col("current_hash").alias("found"))))
    got = check_events(events, level).groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), first.alias("f"))
    return got.select("session_id", F.col("f").isNull().alias("ok"), "events", "f.event_index", "f.error", "f.expected", "f.found")


def head_hash(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.max_by("current_hash", "sequence").alias("head_hash"))


def folded_hash(rows: DataFrame, by: str, part: str, order: list[str], separator: str = "") -> DataFrame:
    """(by, rows, hash): a hash over the column `text` of each key's rows in order of part and `order`,
    with the separator between rows of one part.

    All tasks sort, each a range of the order, and pack their rows into compressed blocks of one key and part.
    Only a key's blocks meet in one task, which reads them as a stream; a hot key needs time, and for its
    blocks' order the memory of its compressed text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, held, size = 0, None, [], 0
        for b in batches:
            out, at, texts, where = [], 0, b["text"].to_pylist(), b["range"][0].as_py() if b.num_rows else 0
            for here, run in itertools.groupby(zip(b["by"].to_pylist(), b["part"].to_pylist(), strict=True)):
                end = at + sum(1 for _ in run)
                if held and here != place:
                    out.append((*place, where, number, len(held), _packed(held, separator)))
                    number, held, size = number + 1, [], 0
                place = here
                for lo in range(at, end, BLOCK_ROWS):
                    more = [str(x) for x in texts[lo : min(lo + BLOCK_ROWS, end)]]
                    held, size = held + more, size + sum(map(len, more))
                    if size >= BLOCK_TEXT:
                        out.append((*place, where, number, len(held), _packed(held, separator)))
                        number, held, size = number + 1, [], 0
                at = end
            yield _batch(out, b.schema.field("by").type, b.schema.field("part").type)
        if held:
            yield _batch([(*place, where, number, len(held), _packed(held, separator))], b.schema.field("by").type, b.schema.field("part").type)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, last, state, kind = None, 0, None, None, None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (kind, pa.int64(), pa.string()), strict=True)], ["by", "rows", "hash"])
        for b in batches:
            out, kind = [], b.schema.field("by").type
            for k, p, n, block in zip(*(b[c].to_pylist() for c in ("by", "part", "rows")), b["block"], strict=True):
                if state is None or k != key:
                    if state is not None:
                        out.append((key, count, state.hexdigest()))
                    key, count, last, state = k, 0, None, hashlib.sha256()
                state.update((separator.encode() if count and p == last else b"") + zlib.decompress(block.as_buffer()))
                count, last = count + n, p
            if out:
                yield made(out)
        if state is not None:
            yield made([(key, count, state.hexdigest())])

    own = stage(rows.select(F.col(by).alias("by"), F.col(part).alias("part"), *order, F.col("text").alias("text")), "fold")
    sort = ["by", "part", *order]
    ranges = own.repartitionByRange(pieces(own), *sort).sortWithinPartitions(*sort)
    packed = own.select("by", "part", F.lit(0).alias("range"), *[F.lit(0).cast("long").alias(c) for c in ("number", "rows")], F.lit(b"").alias("block")).schema
    blocks = ranges.select("by", "part", "text", F.spark_partition_id().alias("range")).mapInArrow(pack, packed)
    schema = own.select("by", F.lit(0).cast("long").alias("rows"), F.lit("").alias("hash")).schema
    one = blocks.repartition("by").sortWithinPartitions("by", "part", "range", "number").select("by", "part", "rows", "block")
    return one.mapInArrow(fold, schema).withColumnRenamed("by", by)


def _packed(texts: list[str], separator: str) -> bytes:
    return zlib.compress(separator.join(texts).encode(), 1)


def _batch(rows: list[tuple], by: pa.DataType, part: pa.DataType) -> pa.RecordBatch:
    kinds = (by, part, pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["by", "part", "range", "number", "rows", "block"])


def composite_hash(files: DataFrame, by: str) -> DataFrame:
    """(by, files, hash) over path and hash pairs in order of path, whatever the order of rows."""
    rows = files.select(by, F.lit(0).alias("part"), "path", "hash", F.concat("path", F.lit("|"), "hash", F.lit("|")).alias("text"))
    return folded_hash(rows, by, "part", ["path", "hash"]).select(by, F.col("rows").alias("files"), "hash")


def record_hash(session: Column, kind: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws(":", session, kind, payload), 256)
