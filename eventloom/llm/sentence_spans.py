"""Substring dedup over sliding sentence spans.

A text is cut in sentences: after ``.``, ``!`` or ``?`` before white space, and at line ends; one of
more than LONG words is also cut in clauses.  With `grow`, from each sentence, and back from each, a
span grows until it has SENTENCES sentences and MIN_WORDS words; so do spans of clauses in a long
sentence, from its start, back from its end and from its wide cuts.  Without it, spans are only the runs of
SENTENCES sentences that have MIN_WORDS words.  Spans are hashed to 80 bits (words lower-cased, white
space ignored), hashes meet over all documents, and a sentence or clause goes if any non-first repeated
span covers it.  First is the span of the smallest (document id, text hash, place).

A task gathers spans of many documents, a source, and settles what repeats within it; each span that is
left goes once, packed, to the bucket of its hash, which answers with the numbers of those that are not
the first.  So a span that most texts have is sent once for each source, and no bucket is hot.

Cases: rows of one id and one text are one document and fare alike; null ids come first; null texts
stay null; texts with too few words or sentences and clauses for a span keep all; an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, U, WHITE, hashes, mix, slices, words
from .shared import by_bucket, joinable, lean, lean_group, pack, stage, text_bytes, unpack

SENTENCES, MIN_WORDS, SLICE = 2, 10, 2 << 20
#: Sentences of more than LONG words are also cut in clauses.  With these, of any 51 successive
#: words that two documents share, some span lies within them.
LONG, WINDOW, WIDE = 16, 4, 16
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_P, _Q = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Spans that a task gathers before it sends them, and text whose spans meet in one bucket.
FLUSH, BUCKET_BYTES = 1_000_000, 8 << 20
#: Rows about a source's documents have keys from here on.
DOCS = 1 << 48


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first byte, number of words, hash) of each sentence.  A sentence's bytes reach to
    the next one's first byte, or to its text's end."""
    starts, ends, doc = words(data, off)
    if not len(starts):
        return doc, starts, starts, np.zeros(0, U)
    h = hashes(LOWER[data], starts, ends)
    lines = np.r_[0, np.cumsum(data == 10)]
    new = np.r_[True, (doc[1:] != doc[:-1]) | _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(starts)])
    place = np.arange(len(starts)) - np.repeat(first, count)
    return doc[first], starts[first], count, mix(np.add.reduceat(mix(h + place.astype(U) * _P), first))


def _clauses(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, number of its sentence, first byte, number of words, hash, wide) of each clause: a
    sentence of up to LONG words, or a part of a longer one.

    A longer one is cut before every word that has the least hash of some WINDOW successive words of
    it, the last of equal ones, so a passage is cut alike wherever it stands.  Wide cuts, at which
    spans inside it start, hold so for WIDE successive words; they are some of the others."""
    starts, ends, doc = words(data, off)
    if not len(starts):
        return doc, doc, starts, starts, np.zeros(0, U), np.zeros(0, bool)
    owner, at, count, _ = sentences(data, off)
    h = hashes(LOWER[data], starts, ends)
    first = np.searchsorted(starts, at)
    own = np.repeat(np.arange(len(first)), count)
    new, wide = np.zeros((2, len(starts)), bool)
    new[first] = wide[first] = True
    for chosen, size in ((new, WINDOW), (wide, WIDE)):
        n = len(h) - size + 1
        if n > 0:
            inside = np.flatnonzero((own[:n] == own[size - 1 :]) & (count[own[:n]] > LONG))
            value, last = h[inside], inside.copy()
            for j in range(1, size):
                least = h[inside + j] <= value
                value, last = np.where(least, h[inside + j], value), np.where(least, inside + j, last)
            chosen[last] = True
    cut = np.flatnonzero(new)
    size = np.diff(np.r_[cut, len(starts)])
    place = np.arange(len(starts)) - np.repeat(cut, size)
    return owner[own[cut]], own[cut], starts[cut], size, mix(np.add.reduceat(mix(h + place.astype(U) * _P), cut)), wide[cut]


def _onward(group: np.ndarray, count: np.ndarray, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the shortest run of a group from each element on with k elements and min_words words."""
    n, total, at = len(group), np.r_[0, np.cumsum(count)], np.arange(len(group))
    end = np.maximum(at + k, np.searchsorted(total, total[:-1] + min_words))
    ok = (end <= n) & (group[np.minimum(end, n) - 1] == group)
    return at[ok], end[ok]


def _back(group: np.ndarray, count: np.ndarray, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The same back from each element."""
    total, at = np.r_[0, np.cumsum(count)], np.arange(len(group))
    start = np.minimum(at + 1 - k, np.searchsorted(total, total[1:] - min_words, "right") - 1)
    ok = (start >= 0) & (group[np.maximum(start, 0)] == group)
    return start[ok], at[ok] + 1


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    runs = np.unique(np.concatenate([first * (n + 1) + end for first, end in parts]))
    return runs // (n + 1), runs % (n + 1)


def _hashed(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 more bits of hash of each run of elements."""
    out, more_bits = np.zeros(len(first), U), np.zeros(len(first), U)
    live = np.arange(len(first))
    for j in range(int((end - first).max()) if len(first) else 0):
        live = live[first[live] + j < end[live]]
        own = h[first[live] + j]
        out[live] = mix(out[live] * _P + own)
        more_bits[live] = mix(more_bits[live] * _Q ^ own)
    return out, (more_bits >> U(48)).astype(np.uint16)


def spans(data: np.ndarray, off: np.ndarray, k: int, min_words: int, grow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, number of its first clause within the text, number of clauses, hash, more bits of
    hash) of each span."""
    doc, _, count, h = sentences(data, off)
    if not len(doc):
        return doc, doc, doc, np.zeros(0, U), np.zeros(0, np.uint16)
    if grow:
        first, end = _distinct([_onward(doc, count, k, min_words), _back(doc, count, k, min_words)], len(doc))
    else:
        n, total = max(0, len(doc) - k + 1), np.r_[0, np.cumsum(count)]
        first = np.flatnonzero((doc[:n] == doc[k - 1 :]) & (total[k:] - total[:n] >= min_words)) if n else np.zeros(0, np.int64)
        end = first + k
    c_doc, own, _, c_count, c_h, wide = _clauses(data, off)
    edge = np.searchsorted(own, np.arange(len(doc) + 1))
    parts = [(edge[first], edge[end], *_hashed(h, first, end))]
    long = np.flatnonzero(count[own] > LONG)
    if grow and len(long):
        group, size, m = own[long], c_count[long], len(long)
        at = np.r_[np.flatnonzero(wide[long]), m]
        first, end = _onward(group[at[:-1]], np.add.reduceat(size, at[:-1]), 1, min_words)
        new = np.r_[True, group[1:] != group[:-1]]
        f, e = _onward(group, size, k, min_words)
        g, d = _back(group, size, k, min_words)
        left, right = new[f], np.r_[new[1:], True][d - 1]
        first, end = _distinct([(at[first], at[end]), (f[left], e[left]), (g[right], d[right])], m)
        parts.append((long[first], long[end - 1] + 1, *_hashed(c_h[long], first, end)))
    first, end, got, more_bits = (np.concatenate(x) for x in zip(*parts, strict=True))
    return c_doc[first], first - np.searchsorted(c_doc, c_doc[first]), end - first, got, more_bits


def _settle(h: np.ndarray, g: np.ndarray, id_: np.ndarray, tie: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether each in order is the first of its hash, whether it is another than that first)."""
    order = np.lexsort((place, tie, id_, g, h))
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (h, g):
        same &= x[order][1:] == x[order][:-1]
    first = np.r_[True, ~same][: len(order)]
    head = order[np.flatnonzero(first)][np.cumsum(first) - 1]
    other = (id_[order] != id_[head]) | (tie[order] != tie[head]) | (place[order] != place[head])
    return order, first, other


class _Source:
    """Documents and their spans, gathered until there are FLUSH of these."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.docs: list[tuple[np.ndarray, ...]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, docs: tuple[np.ndarray, ...], found: tuple[np.ndarray, ...]) -> None:
        base = sum(len(x[0]) for x in self.docs)
        self.docs.append(docs)
        self.parts.append((found[0] + base, *found[1:]))
        self.size += len(found[0])

    def rows(self, buckets: int) -> list[tuple[int, int, bytes]]:
        """(bucket, source, block): what the source keeps, and the spans that go to buckets."""
        id_, tie, known = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        doc, place, n, h, g = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((tie, id_))
        again = np.zeros(len(id_), bool)
        again[order[1:]] = (id_[order][1:] == id_[order][:-1]) & (tie[order][1:] == tie[order][:-1])
        use = ~again[doc]  # rows of one id and text are one document
        doc, place, n, h, g = doc[use], place[use], n[use], h[use], g[use]
        order, first, other = _settle(h, g, id_[doc], tie[doc], place)
        sent = order[first]
        out = [(DOCS + self.number, self.number, pack(id_, tie, known, doc.astype(np.uint32), place.astype(np.uint32), n.astype(np.uint32), order[other].astype(np.uint32)))]
        bucket = (((mix(h[sent] ^ _Q) >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
        for b, x in by_bucket(bucket):
            i = sent[x]
            docs, local = np.unique(doc[i], return_inverse=True)
            out.append((b, self.number, pack(h[i], g[i], i.astype(np.uint32), local.astype(np.uint32), place[i].astype(np.uint32), id_[docs], tie[docs])))
        return out


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """(source, docs, block) of one bucket: numbers of spans that are not the first of their hash."""
    source = pdf["source"].to_numpy()
    if int(pdf["bucket"].iloc[0]) >= DOCS:
        return pd.DataFrame({"source": source, "docs": True, "block": pdf["block"]})
    parts = [unpack(x) for x in pdf["block"]]
    h, g, number, place = (np.concatenate([p[j] for p in parts]) for j in (0, 1, 2, 4))
    id_, tie = np.concatenate([p[5][p[3]] for p in parts]), np.concatenate([p[6][p[3]] for p in parts])
    whose = np.repeat(source, [len(p[0]) for p in parts])
    order, _, other = _settle(h, g, id_, tie, place)
    hit = np.sort(order[other])
    out = [(s, pack(number[hit[rows]])) for s, rows in by_bucket(whose[hit])]
    return pd.DataFrame({"source": [s for s, _ in out], "docs": False, "block": [x for _, x in out]})


def _placed(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, tie, places) of the documents of one source that have spans to cut."""
    own = pdf["docs"].to_numpy(bool)
    id_, tie, known, doc, place, n, covered = unpack(pdf["block"][own].iloc[0])
    covered = np.unique(np.concatenate([covered, *(unpack(x)[0] for x in pdf["block"][~own])]))
    ids, ties, places = [], [], []
    for d, rows in by_bucket(doc[covered]):
        ids.append(int(id_[d]) if known[d] else None)
        ties.append(int(tie[d]))
        places.append(pack(place[covered[rows]], n[covered[rows]]))
    return pd.DataFrame({"id": pd.array(ids, "Int64"), "tie": np.array(ties, np.int64), "places": places})


def repeated_spans(docs: DataFrame, doc_id: str, text: str, k: int = SENTENCES, min_words: int = MIN_WORDS, grow: bool = False) -> DataFrame:
    """(id, tie, places): packed first clauses and numbers of clauses of each document's non-first
    repeated spans."""
    buckets = max(4, -(-text_bytes(docs, text) // BUCKET_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("source", pa.int64()), ("block", pa.binary())])
        source = _Source(TaskContext.get().partitionId() << 20)

        def flush() -> pa.RecordBatch:
            rows = source.rows(buckets)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for lo, data, off in slices(b.column("text"), SLICE):
                ids = b.column("id").slice(lo, len(off) - 1)
                docs = (ids.fill_null(np.iinfo(np.int64).min).to_numpy(), b.column("tie").slice(lo, len(off) - 1).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
                source.add(docs, spans(data, off, k, min_words, grow))
                if source.size >= FLUSH:
                    yield flush()
                    source = _Source(source.number + 1)
        if source.size:
            yield flush()

    asked = rows.mapInArrow(lean(ask), "bucket long, source long, block binary")
    answers = asked.groupBy("bucket").applyInPandas(lean_group(_answer), "source long, docs boolean, block binary")
    found = answers.groupBy("source").applyInPandas(lean_group(_placed), "id long, tie long, places binary")
    return found.groupBy("id", "tie").agg(F.first("places").alias("places"))  # repeated rows fare alike


def drop_repeated_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SENTENCES, min_words: int = MIN_WORDS, grow: bool = False) -> DataFrame:
    """docs with the covered sentences cut from the text; n_sentences and n_removed count
    sentences, removed ones where nothing is left of them."""
    found = stage(repeated_spans(docs, doc_id, text, k, min_words, grow), "span-places")
    found = joinable(found.withColumnsRenamed({"id": "__id", "tie": "__tie", "places": "__places"}), "24 + octet_length(__places)")
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    rest = [c for c in kept if c != text]
    both = docs.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__tie")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(text)
            texts, total, gone = [], np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            places = b.column("__places")
            for lo, data, off in slices(column, SLICE):
                doc, sentence, start, _, _, _ = _clauses(data, off)
                n = np.bincount(doc, minlength=len(off) - 1)
                base = np.cumsum(n) - n
                for i in range(len(off) - 1):
                    whole = sentence[base[i] : base[i] + n[i]]
                    total[lo + i] = whole[-1] - whole[0] + 1 if n[i] else 0
                    own = data[off[i] : off[i + 1]]
                    if places[lo + i].is_valid:
                        cut = np.zeros(n[i], bool)
                        at, size = (x.astype(np.int64) for x in unpack(places[lo + i].as_py()))
                        edge = np.bincount(at, minlength=n[i] + 1) - np.bincount(at + size, minlength=n[i] + 1)
                        cut[:] = np.cumsum(edge)[: n[i]] > 0
                        gone[lo + i] = total[lo + i] - len(np.unique(whole[~cut]))
                        edges = np.r_[start[base[i] : base[i] + n[i]] - off[i], len(own)]
                        keep = np.ones(len(own), bool)
                        for s in np.flatnonzero(cut):
                            keep[edges[s] : edges[s + 1]] = False
                        own = own[keep]
                    texts.append(own.tobytes())
            new = pa.array([t if v else None for t, v in zip(texts, column.is_valid().to_pylist(), strict=True)], pa.binary()).cast(pa.string())
            cols = {c: b.column(c) for c in rest} | {text: new, "n_sentences": pa.array(total), "n_removed": pa.array(gone)}
            yield pa.RecordBatch.from_pydict({c: cols[c] for c in [*kept, "n_sentences", "n_removed"]})

    schema = docs.select(*kept).withColumns({"n_sentences": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return both.select(*kept, "__places").mapInArrow(lean(run), schema)
