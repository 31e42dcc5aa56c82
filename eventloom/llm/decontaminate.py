"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Every training text is cut in passages of two strides of words, a stride being the longest item, so
an item lies whole in some passage.  Each passage is a query, its distinct words the terms.  An
item's score is divided by the score of its own text, and all items at ``threshold`` or above are
retrieved: upper bounds by blocks of items discard most passages in one numpy pass, the rest goes
through block-max WAND.  Retrieved pairs are verified: the shares of the item's question and answer
shingles (five words, without punctuation at their edges) found in the passage must both reach
``overlap``.  A part that stands in the passage as a run of letters and digits, whatever touches it, is
found whole; an answer of fewer than SHORT words is also compared word by word; with a whole question
and a score of SURE_SCORE the answer need not be there.  An item's answer is its last sentence, or
its last five words if it has one sentence; the question is what stands before.

Cases: null or empty texts match nothing; items without words are left out; repeated items are
found each by its own id; a leak is reported once for a text and item, with its best passage.
The index is built for SHARD_ITEMS items at a time, so what is broadcast is bounded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, U, hashes, slices, windows, words
from .sentence_spans import _STOP
from .shared import lean, stage

THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
SHORT, SURE_SCORE = 8, 0.9
K1, B = 1.2, 0.75
SHARD_ITEMS, BLOCK_ITEMS, SUPER_BLOCKS = 20_000, 8, 64
LEAKS = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"


def _shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of one word sequence; a shorter one counts as a single shingle."""
    if not len(h):
        return np.zeros(0, U)
    k = min(k, len(h))
    return np.unique(windows(h, np.zeros(len(h), np.int64), k)[0])


#: Bytes of letters and digits (those beyond ASCII all count).
_INNER = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_OUTER = re.compile(rb"[^0-9a-z\x80-\xff]+")


def _bare(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words without the punctuation at their edges; words of nothing else stay as they are."""
    inner = np.flatnonzero(_INNER[data])
    lo, hi = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
    some = hi > lo
    starts, ends = starts.copy(), ends.copy()
    starts[some], ends[some] = inner[lo[some]], inner[hi[some] - 1] + 1
    return hashes(data, starts, ends)


def _letters(data: np.ndarray) -> bytes:
    """A text's letters and digits, with one space for what stands between them."""
    return _OUTER.sub(b" ", data.tobytes()).strip()


class Statistics:
    """What scores take from all items: their number, summed and greatest length, and the number of items
    of each term (hashes in ascending order, of which an index needs those of its own items)."""

    def __init__(self, n: int, words_: int, longest: int, terms: np.ndarray, df: np.ndarray):
        self.n, self.words, self.longest, self.terms, self.df = n, words_, longest, terms, df


class Index:
    """Terms (sorted hashes), postings by term with impacts, block and super-block maxima.

    `of` are the statistics of all items, where these are some of them."""

    def __init__(self, ids: list[int | None], texts: list[str | None], of: Statistics | None = None):
        column = pa.array(texts, pa.string())
        parts, question, answer = [], [], []  # of question and answer: shingles, letters, words of a short one
        for _, data, off in slices(column, 1 << 40):
            data = LOWER[data]
            starts, ends, doc = words(data, off)
            h, bare = hashes(data, starts, ends), _bare(data, starts, ends)
            edge = np.searchsorted(doc, np.arange(len(off)))
            for i in range(len(off) - 1):
                own = slice(edge[i], edge[i + 1])
                w = h[own]
                stop = np.flatnonzero(_STOP[data[ends[own] - 1]][:-1]) if len(w) else []
                cut = int(stop[-1]) + 1 if len(stop) else max(0, len(w) - SHINGLE)
                parts.append(w)
                b, at = bare[own], int(starts[own][cut]) if cut < len(w) else int(off[i + 1])
                question.append((_shingles(b[:cut]), _letters(data[off[i] : at]), np.zeros(0, U)))
                answer.append((_shingles(b[cut:]), _letters(data[at : off[i + 1]]), _shingles(b[cut:], 1) if len(w) - cut < SHORT else np.zeros(0, U)))
        some = [i for i, w in enumerate(parts) if len(w)]
        some.sort(key=lambda i: len(parts[i]))  # neighbours in a block have like lengths and bounds
        self.ids = [ids[i] for i in some]
        self.question, self.answer = [question[i] for i in some], [answer[i] for i in some]
        self.stride = max([32, *(len(parts[i]) for i in some), of.longest if of else 0])
        n = len(some)
        item = np.repeat(np.arange(n), [len(parts[i]) for i in some])
        terms, t = np.unique(np.concatenate([parts[i] for i in some]) if some else np.zeros(0, U), return_inverse=True)
        pair, tf = np.unique(t.astype(np.int64) * max(n, 1) + item, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        length = np.array([len(parts[i]) for i in some], float)
        if of is None:
            of = Statistics(n, int(length.sum()), self.stride, terms, np.bincount(term, minlength=len(terms)))
        df = of.df[np.searchsorted(of.terms, terms)]
        idf = np.log1p((of.n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / (of.words / of.n))) if n else np.zeros(0)
        impact = impact / np.bincount(item, impact, n)[item] if n else impact
        self.terms, self.term_of, self.item, self.impact = terms, term, item, impact
        self.start = np.searchsorted(term, np.arange(len(terms) + 1))
        self.top = np.maximum.reduceat(impact, self.start[:-1]) if n else impact
        block = item // BLOCK_ITEMS
        self.block_max = {}
        key = term * (n // BLOCK_ITEMS + 1) + block
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
        high = np.maximum.reduceat(impact, first) if n else impact
        self.block_max = dict(zip(key[first].tolist(), high.tolist(), strict=True))
        self.n_blocks = n // BLOCK_ITEMS + 1
        self.bounds = np.zeros((len(terms), SUPER_BLOCKS), np.float32)
        np.maximum.at(self.bounds, (term, item * SUPER_BLOCKS // max(n, 1)), impact.astype(np.float32))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms reaches the threshold: block-max WAND."""
        lists = []
        for t in terms:
            lo, hi = int(self.start[t]), int(self.start[t + 1])
            lists.append([int(self.item[lo]), lo, hi, t])
        found, item, impact, top = [], self.item, self.impact, self.top
        threshold -= 1e-9
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, _, t) in enumerate(lists):
                bound += top[t]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == at:
                pivot += 1
            block = at // BLOCK_ITEMS
            near = sum(self.block_max.get(x[3] * self.n_blocks + block, 0.0) for x in lists[: pivot + 1])
            if near >= threshold:
                if lists[0][0] == at:
                    score = float(sum(impact[x[1]] for x in lists[: pivot + 1]))
                    if score >= threshold:
                        found.append((at, score))
                    goal = at + 1
                else:
                    goal = at
            else:  # no item of this block up to the next list's item can reach the threshold
                goal = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0])
            for x in lists[: pivot + 1]:
                if x[0] < goal:
                    x[1] = bisect_left(item, goal, x[1], x[2])
                    x[0] = int(item[x[1]]) if x[1] < x[2] else -1
            lists = [x for x in lists if x[0] >= 0]
        return found

    def leaks(self, data: np.ndarray, off: np.ndarray, threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """{(text number, item number): (score, question overlap, answer overlap)} for a slice."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        starts, ends, doc = words(data, off)
        if not len(starts) or not len(self.terms):
            return out
        data = LOWER[data]
        h = hashes(data, starts, ends)
        term = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[term] == h)
        first = np.searchsorted(doc, np.arange(len(off) - 1))
        chunks = np.maximum(1, -(-np.bincount(doc, minlength=len(off) - 1) // self.stride))
        base = np.cumsum(chunks) - chunks
        chunk = base[doc[known]] + (known - first[doc[known]]) // self.stride
        pair = np.unique(chunk * len(self.terms) + term[known])
        of, t = pair // len(self.terms), pair % len(self.terms)
        edge = np.searchsorted(of, np.arange(int(chunks.sum()) + 1))
        bound = np.zeros((int(chunks.sum()), SUPER_BLOCKS), np.float32)
        if len(t):
            full = np.flatnonzero(edge[1:] > edge[:-1])
            bound[full] = np.add.reduceat(self.bounds[t], edge[full], axis=0)
        owner = np.repeat(np.arange(len(off) - 1), chunks)
        last = np.r_[owner[1:] != owner[:-1], True]
        both = bound + np.where(last[:, None], 0, np.r_[bound[1:], np.zeros((1, SUPER_BLOCKS), np.float32)])
        for c in np.flatnonzero(both.max(axis=1) >= threshold - 1e-4):
            d = int(owner[c])
            terms = np.unique(t[edge[c] : edge[c + 1 if last[c] else c + 2]])
            if self.bounds[terms].sum(axis=0).max() < threshold - 1e-4:  # terms of both strides count once
                continue
            got = self.search(terms.tolist(), threshold)
            if not got:
                continue
            lo = int(first[d]) + (int(c) - int(base[d])) * self.stride
            hi = min(lo + 2 * self.stride, int(first[d + 1]) if d + 1 < len(first) else len(h))
            at, end = int(starts[lo]), int(ends[hi - 1])
            there = _all_shingles(_bare(data[at:end], starts[lo:hi] - at, ends[lo:hi] - at), SHINGLE)
            text = _letters(data[at:end])
            for item, score in got:
                share = [_share(part, there, text) for part in (self.question[item], self.answer[item])]
                key = (d, item)
                if (min(share) >= overlap or len(self.question[item][0]) and share[0] == 1.0 and score >= SURE_SCORE) and (key not in out or score > out[key][0]):
                    out[key] = (score, *share)
        return out


def _share(part: tuple[np.ndarray, bytes, np.ndarray], there: np.ndarray, text: bytes) -> float:
    """How much of a part (shingles, letters, words) is in a passage (shingles of all lengths, letters)."""
    shingles, letters, few = part
    if not len(shingles) or letters and letters in text:
        return 1.0
    return max(float(np.isin(x, there).mean()) for x in (shingles, few) if len(x))


def _all_shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Shingles of k words and, for parts that are shorter, of 1 to k - 1 words."""
    one = np.zeros(len(h), np.int64)
    return np.unique(np.concatenate([windows(h, one, j)[0] for j in range(1, k + 1)]))


def item_statistics(items: DataFrame) -> tuple[int, int, int, DataFrame]:
    """Number, summed and greatest length of items that have words, and (shard, term, df) of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, data, off in slices(b.column("text")):
                starts, ends, doc = words(data, off)
                h = hashes(LOWER[data], starts, ends)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
                shard = b.column("shard").slice(lo, len(off) - 1).to_numpy()
                size = np.bincount(doc, minlength=len(off) - 1)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard[doc[new]]), "term": pa.array(h[new].view(np.int64)), "words": pa.nulls(int(new.sum()), pa.int64())})
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard), "term": pa.nulls(len(size), pa.int64()), "words": pa.array(size, pa.int64())})

    found = stage(items.select("shard", "text").mapInArrow(lean(run), "shard long, term long, words long"), "item-terms")
    n, total, longest = found.filter("words > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
    df = found.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return n, total, longest, stage(found.filter("term IS NOT NULL").select("shard", "term").distinct().join(df, "term"), "item-terms")


def mark_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs with `leaks`, an array of the items found in each text (empty for clean texts)."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*kept)
    numbered = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    if shards > 1:
        numbered = stage(numbered.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards))), "test-items")
        n, total, longest, terms = item_statistics(numbered)
    for s in range(shards):
        own = numbered if shards == 1 else numbered.filter(F.col("shard") == s)
        rows = own.orderBy("id", "text").collect()  # about SHARD_ITEMS rows
        of = None
        if shards > 1:
            got = terms.filter(F.col("shard") == s).select("term", "df").toArrow()  # the terms of these rows
            term = got.column("term").to_numpy().view(U)
            order = np.argsort(term)
            of = Statistics(n, total, longest, term[order], got.column("df").to_numpy()[order])
        index = spark.sparkContext.broadcast(Index([r["id"] for r in rows], [r["text"] for r in rows], of))

        def run(batches: Iterator[pa.RecordBatch], index=index, s=s) -> Iterator[pa.RecordBatch]:
            x = index.value
            for b in batches:
                leaks: list[list[dict]] = [[] for _ in range(b.num_rows)] if s == 0 else [v or [] for v in b.column("leaks").to_pylist()]
                for lo, data, off in slices(b.column(text), 2 << 20):
                    for (d, item), (score, q, a) in sorted(x.leaks(data, off, threshold, overlap).items()):
                        leaks[lo + d].append({"item_id": x.ids[item], "score": score, "question_overlap": q, "answer_overlap": a})
                if s == shards - 1:
                    for found in leaks:
                        found.sort(key=lambda x: (x["item_id"] is not None, x["item_id"] or 0, x["score"]))
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(leaks, kind)], schema=pa.schema([*(b.schema.field(c) for c in kept), pa.field("leaks", kind)]))

        schema = docs.select(*kept).withColumn("leaks", F.lit(None).cast(LEAKS)).schema
        out = out.mapInArrow(lean(run), schema)
    return out
