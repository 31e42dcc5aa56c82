"""Language-model scoring by online logistic context mixing over the bits of a text's words.

Texts are tokens: words with A-Z lower-cased, then one end.  The TOP_WORDS most frequent tokens of the
training texts, and an escape for all others, have the codes of a Huffman tree; a text is the bits of
its tokens' codes.  Four predictors see a bit.  One knows the tree's node alone; the contexts of the
others are the hashed word before (with a class of the word before that one if it is hot, and with both
and a class of a third if both are), the two words before, and the three words before, each with the
bits known of this code.  They count the zeros and ones that training texts have
there: all contexts of the corpus, so what is kept grows with it.  Log odds are mixed with weights from
a set gated by the depth of the bit and by how much the two longest contexts have seen; the weights are
learnt online, in small steps over the training bits, and the mix is refined by an adaptive table from
gate and odds to what was observed.  A bit of a training text is learnt and scored as if its own
occurrence weren't counted, so training and held-out texts have scores of one scale.

An escaped word is spelled: its bytes and a terminator, each as eight bits, are mixed in the same way by
predictors whose contexts are the last 1, 2, 3 and 5 bytes of the word and all of it so far, hashed into
a table of fixed size (they learn from the distinct words, weighted by their counts).  The sum of all
log10 probabilities is the text's score; bits_per_byte divides its bits by what was coded, the words'
bytes and one for each token (runs of white space aren't).

On Spark: distinct words with their counts are dealt by hash over buckets.  Texts are read once more in
sources of about FLUSH_TOKENS tokens; a token goes to the shard of its shortest context, with hashes of
the longer ones, its code and its document's number in the source, and those that a source has often go
once for all of them, so a line that every page has is no hot shard.  A shard sorts its tokens by
context and code, where all that share a context and some bits are neighbours, so counting is exact and
needs no table; it learns its weights, and answers the sources with a sum for each document, packed.
Shards are cut by the corpus's number of tokens, a shard that is still too large in runs of successive
contexts; how many shards form a task's bucket changes nothing.

Cases: null and empty texts are one end; every row is scored, repeated rows alike; a null id counts as
the empty string when held-out rows are chosen; with no training text counts are 0, all tokens are
escaped and spelled with bits of 1/2; an empty table stays empty.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import _TABLE, LOWER, PLACES, U, hashes, mix, slices, words
from .shared import by_bucket, lean, lean_group, merged, pack, release, stage, text_bytes, unpack

#: log2 of the slots of the contexts of 1, 2, 3, 5 bytes, and of all.
SLOT_BITS = (16, 18, 20, 21, 22)
ORDERS = (1, 2, 3, 5)
#: Tokens with codes of their own, tokens of a shard (before they are rounded to a power of two), of a
#: bucket and of a source; a source sends tokens that it has OFTEN times once for all of them.
TOP_WORDS, SHARD_TOKENS, BUCKET_TOKENS, FLUSH_TOKENS, OFTEN = 60_000, 1 << 18, 1 << 20, 1 << 20, 4
#: A token with more occurrences than this is hot: the word before it is told apart in so many classes
#: that each has fewer.
HOT_TOKENS = SHARD_TOKENS // 4
#: Gates of the mixer of codes: depths, and what the contexts of two and of three words have seen.
DEPTHS, CODE_INPUTS, STEP, BIAS = 8, 5, 1 << 14, 0.3
BASES = np.cumsum([0, *(1 << b for b in SLOT_BITS)])
SLOTS = int(BASES[-1])
CHUNK = 1 << 16
GATES, INPUTS, ODDS = 16, len(SLOT_BITS) + 1, 33
WORD_BYTES, TASKS, FLUSH_WORDS = 24 << 20, 256, 3_000_000
#: Buckets of words whose slots one task counts before it sends them.
TASK_BUCKETS = 4
BATCH = 8_000
RATE, EPOCHS, PRIOR = 0.2, 1, 0.05
TERMINATOR = 0x20
#: The hash of the end token; no word has it but by chance.
END = np.array([0x656E645F6F665F74], U)
#: Counts are shared as one byte each: exact below 64, then eight steps for each doubling.
LEVELS = np.r_[np.arange(64.0), 64 * 2.0 ** (np.arange(192) / 8)].astype(np.float32)
#: The predictors whose experience gates the weights: 5 bytes, and all of the word.
GATING = (3, 4)
LOG10_2 = float(np.log10(2.0))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _first_weights() -> np.ndarray:
    """Weights before learning: trust long contexts as far as they have been seen."""
    out = np.zeros((8, GATES, INPUTS))
    for gate in range(GATES):
        whole = (0.0, 0.45, 0.7, 0.9)[gate % 4]
        five = (1 - whole) * (0.0, 0.4, 0.6, 0.7)[gate // 4]
        rest = 1 - whole - five
        out[:, gate] = [0.15 * rest, 0.3 * rest, 0.55 * rest, five, whole, 0.0]
    return out


# ---------------------------------------------------------------- distinct words


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)


def _take(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several runs, one after another."""
    first = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))]


def _distinct(h: np.ndarray, n: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words merged by hash: (hash ascending, summed counts by class, size, bytes)."""
    key, first, at = np.unique(h, return_index=True, return_inverse=True)
    total = np.stack([np.bincount(at, x, len(key)) for x in n]).astype(np.int64)
    size = size.astype(np.int64)
    starts = np.cumsum(size) - size
    return key, total, size[first], _take(data, starts[first], size[first])


def _joined(parts: list[tuple]) -> tuple:
    return _distinct(*(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)))


def _unpacked(blocks: list[bytes]) -> tuple:
    """Words of several blocks; counts are laid class after class in each."""
    return tuple(zip(*((h, n.reshape(-1, len(h)), size.astype(np.int64), data) for h, n, size, data in map(unpack, blocks)), strict=True))


def _word_blocks(buckets: int, classes: int):
    def blocks(parts: list[tuple]) -> pa.RecordBatch:
        h, n, size, data = _joined(parts)
        starts = np.cumsum(size) - size
        out_b, out_d = [], []
        for b, rows in by_bucket(_bucket(h, buckets)):
            out_b.append(b)
            out_d.append(pack(h[rows], n[:, rows].ravel(), size[rows].astype(np.uint32), _take(data, starts[rows], size[rows])))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(out_b, pa.int32()), "block": pa.array(out_d, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            group = b.column("train").to_numpy(zero_copy_only=False)
            for lo, data, off in slices(b.column("text")):
                low = LOWER[data]
                starts, ends, doc = words(low, off)
                h = hashes(low, starts, ends)
                own = group[lo : lo + len(off) - 1]
                key, first, at = np.unique(h, return_index=True, return_inverse=True)
                n = np.stack([np.r_[np.bincount(at, own[doc] == k, len(key)), (own == k).sum()] for k in range(classes)]).astype(np.int64)
                size = (ends - starts)[first]
                parts.append((np.r_[key, END], n, np.r_[size, 0], _take(low, starts[first], size)))
                held += len(key)
                if held > FLUSH_WORDS:
                    parts = [_joined(parts)]
                    held = len(parts[0][0])
                    if held > FLUSH_WORDS // 2:
                        yield blocks(parts)
                        parts, held = [], 0
        if parts:
            yield blocks(parts)

    return run


def _step(n: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 512 steps."""
    return np.minimum(np.ceil(np.log2(np.maximum(n, 1)) * 8), 511).astype(int)


def distinct_words(docs: DataFrame, text: str, train: Column, buckets: int, classes: int) -> DataFrame:
    """(bucket, words, tokens, known, counts, block): for each bucket its words with their training
    counts by class.  `train` is the class of a training text and -1 for others."""
    rows = docs.select(F.col(text).alias("text"), train.alias("train"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n, size, data = _joined(list(zip(*_unpacked(pdf["block"]), strict=True)))
        all_ = n.sum(axis=0)
        top = np.bincount(_step(all_), minlength=512)
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "words": [len(h)], "tokens": [int(n.sum())], "known": [int((all_ > 0).sum())], "counts": [top.tolist()], "block": [pack(h, n.ravel(), size.astype(np.uint32), data)]})

    made = rows.mapInArrow(lean(_word_blocks(buckets, classes)), "bucket int, block binary")
    return stage(made.groupBy("bucket").applyInPandas(lean_group(run), "bucket int, words long, tokens long, known long, counts array<long>, block binary"), "lm-words")


# ---------------------------------------------------------------- predictors


def positions(size: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(word number, byte, context hashes) of the bytes and terminators of words, some words at a time."""
    edge = np.r_[0, np.cumsum(size + 1)]
    at = np.r_[0, np.cumsum(size)]
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + BATCH, "right")) - 1)
        own = size[lo:hi]
        total = int(edge[hi] - edge[lo])
        first = edge[lo:hi] - edge[lo]
        byte = np.full(total, TERMINATOR, np.uint8)
        inside = np.ones(total, bool)
        inside[first + own] = False
        byte[inside] = data[at[lo] : at[hi]]
        word = np.repeat(np.arange(lo, hi), own + 1)
        place = np.arange(total) - np.repeat(first, own + 1)
        sums = np.cumsum(_TABLE[((place % PLACES) << 8) | byte] + place.astype(U) * U(0x9E3779B97F4A7C15))
        before = np.r_[U(0), sums[:-1]]
        prefix = before - np.repeat(before[first], own + 1)
        history, last = [], np.zeros(total, U)
        for j in range(1, max(ORDERS) + 1):
            prev = np.full(total, TERMINATOR, np.uint8)
            prev[j:] = byte[:-j] if j < total else prev[j:]
            prev[place < j] = TERMINATOR
            last = (last << U(8)) | prev.astype(U)
            if j in ORDERS:
                history.append(mix(last * U(0x9E3779B97F4A7C15) + U(j)))
        history.append(mix(prefix + U(99)))
        yield word, byte, history
        lo = hi


def line_of(byte: np.ndarray, context: np.ndarray, j: int, half: int) -> np.ndarray:
    """The first of the sixteen slots that predictor j's table has for a context and half a byte."""
    key = context if half == 0 else context ^ ((byte >> 4).astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
    return ((key * U(0x9E3779B97F4A7C15) >> U(68 - SLOT_BITS[j])) << U(4)).astype(np.int64) + int(BASES[j])


def bit_nodes(byte: np.ndarray, half: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit k of half a byte, and the number of its slot among the half's sixteen."""
    part = (byte >> 4 if half == 0 else byte & 15).astype(np.int64)
    return (part >> (3 - k)) & 1, (1 << k) | (part >> (4 - k))


def training(blocks: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(weight, byte, contexts) of the positions of training words."""
    for _, n, size, data in blocks:
        size = size.astype(np.int64)
        starts = np.cumsum(size) - size
        at = np.flatnonzero(n)
        for word, byte, history in positions(size[at], _take(data, starts[at], size[at])):
            yield n[at[word]], byte, history


def count_slots(blocks: Iterator[tuple]) -> np.ndarray:
    """Weighted zeros and ones of every slot, from words and their counts."""
    table = np.zeros((2, SLOTS), np.float32)
    for weight, byte, contexts in training(blocks):
        weight = weight.astype(np.float32)
        for half in (0, 1):
            lines = [line_of(byte, c, j, half) for j, c in enumerate(contexts)]
            for k in range(4):
                bit, node = bit_nodes(byte, half, k)
                zero, one = np.flatnonzero(bit == 0), np.flatnonzero(bit)
                for line in lines:
                    s = line + node
                    np.add.at(table[0], s[zero], weight[zero])
                    np.add.at(table[1], s[one], weight[one])
    return table


def coded(table: np.ndarray) -> np.ndarray:
    """Both counts of each slot in sixteen bits: ones in the high byte, zeros in the low one."""
    with np.errstate(divide="ignore"):
        far = np.rint(64 + 8 * np.log2(np.maximum(table, 64) / 64))
    codes = np.where(table < 64, table, np.minimum(far, 255)).astype(np.uint16)
    return codes[1] << 8 | codes[0]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Log odds and experience (0 to 3) by code: as they are, and with a zero or a one left out."""
    n1, n0 = (x.ravel() for x in np.meshgrid(LEVELS, LEVELS, indexing="ij"))
    log, less = (lambda n: np.log(n + np.float32(PRIOR))), (lambda n: np.log(np.maximum(n - 1, 0) + np.float32(PRIOR)))
    odds = np.concatenate([log(n1) - log(n0), log(n1) - less(n0), less(n1) - log(n0)]).astype(np.float32)
    seen = np.concatenate([n0 + n1, n0 + n1 - 1, n0 + n1 - 1])
    return odds, ((seen > 0).astype(np.int8) + (seen >= 4) + (seen >= 64)).astype(np.int8)


ODDS_OF, LEVEL_OF = _tables()


def _inputs(table: np.ndarray, node: np.ndarray, lines: dict[int, np.ndarray], left_out: np.ndarray | int, x: np.ndarray) -> dict[int, np.ndarray]:
    """Fills the columns of x for some predictors; returns the levels of those that gate."""
    level = {}
    for j, line in lines.items():
        code = table[line + node] + left_out
        x[:, j] = ODDS_OF[code]
        if j in GATING:
            level[j] = LEVEL_OF[code]
    return level


def _dot(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, weights.astype(np.float32)[gate])


def _squash(x: np.ndarray) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-np.clip(x, -30, 30))), 1e-6, 1 - 1e-6)


def _odds(dot: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(dot * 2) + ODDS // 2, 0, ODDS - 1).astype(np.int64)


def learn(blocks: Iterator[tuple], table: np.ndarray, weights: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights after an online pass over the training words, and outcomes seen by (bit, gate, odds)."""
    w, steps = weights.copy(), 0
    seen = np.zeros((2, 8, GATES, ODDS))
    for weight, byte, contexts in training(blocks):
        steps += 1
        pace = rate / np.sqrt(1 + steps / 100)
        c = np.sqrt(weight)
        x = np.full((len(byte), INPUTS), 0.3, np.float32)
        for half in (0, 1):
            lines = {j: line_of(byte, q, j, half) for j, q in enumerate(contexts)}
            for k in range(4):
                bit, node = bit_nodes(byte, half, k)
                level = _inputs(table, node, lines, (bit + 1) << 16, x)
                gate = level[3] * 4 + level[4]
                own = w[4 * half + k]
                dot = _dot(x, own, gate)
                error = (bit - _squash(dot)) * c
                mass = np.bincount(gate, c, GATES) + 1
                for j in range(INPUTS):
                    own[:, j] += pace * np.bincount(gate, error * x[:, j], GATES) / mass
                seen[:, 4 * half + k] += np.bincount((bit * GATES + gate) * ODDS + _odds(dot), weight, 2 * GATES * ODDS).reshape(2, GATES, ODDS)
    return w, seen


def log_probabilities(size: np.ndarray, data: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each word with its terminator, as the one row of a table."""
    out = np.zeros((1, len(size)))
    for word, byte, history in positions(size.astype(np.int64), data):
        lo, hi = int(word[0]), int(word[-1]) + 1
        x = np.full((len(byte), INPUTS), 0.3, np.float32)
        total = np.ones(len(byte))
        for half in (0, 1):
            lines = {j: line_of(byte, c, j, half) for j, c in enumerate(history)}
            for k in range(4):
                bit, node = bit_nodes(byte, half, k)
                level = _inputs(model.table, node, lines, 0, x)
                gate = level[3] * 4 + level[4]
                dot = _dot(x, model.weights[4 * half + k], gate)
                p = 0.5 * (_squash(dot) + model.refine[4 * half + k, gate, _odds(dot)])
                total *= np.where(bit == 1, p, 1 - p)
        out[0, lo:hi] += np.bincount(word - lo, np.log10(total))
    return out


# ---------------------------------------------------------------- the model


class Model:
    """What spells words: slot counts, mixing weights, the refining table, and passes made to learn them."""

    def __init__(self, shared: Broadcast, weights: np.ndarray, refine: np.ndarray, epochs: int):
        self.shared, self.weights, self.refine, self.epochs = shared, weights, refine, epochs

    @property
    def table(self) -> np.ndarray:
        return self.shared.value


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for x in b.column("block"):
            yield tuple(unpack(x.as_py()))


def fit(types: DataFrame) -> Model:
    """Learns from a table of distinct words (see distinct_words)."""
    spark = types.sparkSession
    dealt = types.select("bucket", "block").repartition(min(TASKS, max(1, -(-types.count() // TASK_BUCKETS)))).sortWithinPartitions("bucket").select("block")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = count_slots(_blocks(batches))
        out_c, out_d = [], []
        for c in range(-(-SLOTS // CHUNK)):
            part = table[:, c * CHUNK : (c + 1) * CHUNK]
            some = np.flatnonzero(part.any(axis=0))
            if len(some):
                out_c.append(c)
                out_d.append(pack(some.astype(np.uint16), part[0, some].astype(np.int64), part[1, some].astype(np.int64)))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(out_c, pa.int32()), "block": pa.array(out_d, pa.binary())})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        at, n0, n1 = merged(pdf["block"])
        both = [np.bincount(at, n, CHUNK).astype(np.float32) for n in (n0, n1)]
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "block": [pack(*both)]})

    codes = np.zeros(SLOTS, np.uint16)
    found = dealt.mapInArrow(lean(slots), "chunk int, block binary").groupBy("chunk").applyInPandas(lean_group(summed), "chunk int, block binary")
    for r in found.toLocalIterator():  # SLOTS / CHUNK rows
        zeros, ones = merged([r["block"]])
        lo, hi = r["chunk"] * CHUNK, min(SLOTS, (r["chunk"] + 1) * CHUNK)
        codes[lo:hi] = coded(np.stack([zeros[: hi - lo], ones[: hi - lo]]))
    shared = spark.sparkContext.broadcast(codes)
    weights = _first_weights()
    refine = np.full((8, GATES, ODDS), 0.5)
    for epoch in range(EPOCHS):

        def step(batches: Iterator[pa.RecordBatch], start=weights, rate=RATE / (1 + epoch)) -> Iterator[pa.RecordBatch]:
            w, seen = learn(_blocks(batches), shared.value, start, rate)
            yield pa.RecordBatch.from_pydict({"w": pa.array([w.ravel().tolist()]), "mass": pa.array([float(seen.sum())]), "seen": pa.array([seen.ravel().tolist()])})

        got = dealt.mapInArrow(lean(step), "w array<double>, mass double, seen array<double>").collect()  # TASKS rows at most
        mass = sum(r["mass"] for r in got)
        if mass:
            weights = sum(np.array(r["w"]).reshape(weights.shape) * (r["mass"] / mass) for r in got)
            seen = sum(np.array(r["seen"]).reshape(2, 8, GATES, ODDS) for r in got)
            centre = _squash((np.arange(ODDS) - ODDS // 2) / 2.0)
            refine = np.clip((seen[1] + 4 * centre) / (seen[0] + seen[1] + 4), 1e-6, 1 - 1e-6)
    return Model(shared, weights, refine, EPOCHS)


# ---------------------------------------------------------------- codes of frequent tokens


class Codes:
    """A Huffman tree over the frequent tokens and the escape, which are numbered in the order of their
    codes: (length, value) of each code, values at the top of 32 bits, and log odds of its bits."""

    def __init__(self, h: np.ndarray, n: np.ndarray, others: int):
        count = np.r_[n, max(1, others)].astype(np.int64)  # the escape comes last
        weight = np.maximum(count, int(count.sum()) >> 21).tolist()
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        kids, total = [], count.tolist()
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a + b, len(weight) + len(kids)))
            kids.append((i, j))
            total.append(total[i] + total[j])
        leaves, self.length, value, odds = [], [], [], []
        open_: list[tuple[int, int, int, tuple]] = [(heap[0][1], 0, 0, ())]
        while open_:
            node, depth, code, path = open_.pop()
            if node < len(weight):
                leaves.append(node)
                self.length.append(depth)
                value.append(code)
                odds.extend(path)
                continue
            zero, one = kids[node - len(weight)]
            more = (*path, math.log((total[one] + 0.5) / (total[zero] + 0.5)))
            open_ += [(one, depth + 1, code | 1 << (31 - depth), more), (zero, depth + 1, code, more)]
        self.length, self.value = np.array(self.length), np.array(value, np.uint32)
        self.odds, self.start = np.array(odds, np.float32), np.cumsum(self.length) - self.length
        number = np.empty(len(leaves), np.int64)
        number[leaves] = np.arange(len(leaves))
        order = np.argsort(h)
        self.names, self.counts, self.numbers, self.escape = h[order], n[order], number[:-1][order], int(number[-1])
        top = np.bincount((self.names >> U(47)).astype(np.int64), minlength=1 << 17)
        self.first, self.most = np.cumsum(top) - top, int(top.max())
        self.classes = (self.counts // HOT_TOKENS + 1).astype(U)
        self.starts = self.classes[self.names == END].max(initial=U(1))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether tokens have codes, and where among the names."""
        if not len(self.names):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at, last = self.first[(h >> U(47)).astype(np.int64)], len(self.names) - 1
        for _ in range(self.most):  # names of equal top bits lie together
            at += (self.names[np.minimum(at, last)] < h) & (at <= last)
        at = np.minimum(at, last)
        return self.names[at] == h, at


def _code_weights() -> np.ndarray:
    """Weights of the mixer of codes before learning; inputs are the node, one, two and three words."""
    out = np.zeros((DEPTHS, GATES, CODE_INPUTS))
    for gate in range(GATES):
        three = (0.0, 0.45, 0.7, 0.9)[gate % 4]
        two = (1 - three) * (0.0, 0.4, 0.6, 0.7)[gate // 4]
        rest = 1 - two - three
        out[:, gate] = [0.5 * rest, 0.5 * rest, two, three, 0.0]
    return out


_LOGS = np.log(np.arange(1 << 16) + np.float32(0.1)).astype(np.float32)


def _log(n: np.ndarray) -> np.ndarray:
    if n.max(initial=0) < len(_LOGS):
        return _LOGS[n]
    out = _LOGS[np.minimum(n, len(_LOGS) - 1)]
    far = np.flatnonzero(n >= len(_LOGS))
    out[far] = np.log(n[far])
    return out


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


def code_bits(k: np.ndarray, two: np.ndarray, three: np.ndarray, t: np.ndarray, n: np.ndarray, codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(token number, bit, gate, inputs) for each depth of the codes of a shard's tokens, which are in
    contexts k, (k, two) and (k, two, three) and occur n times in training texts (0: not in one)."""
    length, value = codes.length[t], codes.value[t]
    n = n.astype(np.int32) if int(n.sum()) < 1 << 31 else n
    context = _dense(k)
    sorted_ = []
    for finer in (None, two, three):
        if finer is not None:
            context = _dense(context << 16 | finer.astype(np.int64))
        perm = np.argsort(context << 16 | t)
        v = value[perm]
        common = np.where(context[perm][1:] == context[perm][:-1], 32 - np.frexp((v[1:] ^ v[:-1]).astype(float))[1], -1)
        some = length[perm] > 0
        sorted_.append([x[some] for x in (perm, np.r_[-1, common].astype(np.int8), v, n[perm], length[perm].astype(np.int8))])
    live = np.arange(len(t))
    for depth in range(int(length.max()) if len(t) else 0):
        live = live[length[live] > depth]
        shift = np.uint32(31 - depth)
        inputs, level = [codes.odds[codes.start[t[live]] + depth]], []
        for j, (perm, common, v, m, left) in enumerate(sorted_):
            odds, at = np.zeros(len(t), np.float32), np.zeros(len(t), np.int8)
            if len(perm):
                start = np.flatnonzero(common < depth)
                size = np.diff(np.r_[start, len(perm)])
                set_ = (v & (np.uint32(1) << shift)) != 0
                ones = m * set_
                mine = m > 0
                one = np.repeat(np.add.reduceat(ones, start), size) - (mine & set_)
                zero = np.repeat(np.add.reduceat(m - ones, start), size) - (mine & ~set_)
                odds[perm] = _log(one) - _log(zero)
                if j:
                    seen = one + zero
                    at[perm] = (seen > 0).astype(np.int8) + (seen >= 4) + (seen >= 64)
                # one alone that no other occurrence joins stays unseen from here on
                keep = (np.repeat(size > 1, size) | (m > 1)) & (left > depth + 1)
                sorted_[j] = [x[keep] for x in (perm, common, v, m, left)]
            inputs.append(odds[live])
            if j:
                level.append(at[live])
        yield live, ((value[live] >> shift) & np.uint32(1)).astype(np.int64), level[0] * np.int64(4) + level[1], inputs


def _mixed(inputs: list[np.ndarray], weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The sum of weighted inputs; the last weight is that of a constant."""
    w = weights.astype(np.float32)
    out = w[:, -1][gate] * np.float32(BIAS)
    for j, x in enumerate(inputs):
        out += w[:, j][gate] * x
    return out


def code_scores(k: np.ndarray, two: np.ndarray, three: np.ndarray, t: np.ndarray, n: np.ndarray, codes: Codes) -> np.ndarray:
    """log10 probability of each token's code, by weights learnt online from the shard's training tokens."""
    steps = list(code_bits(k, two, three, t, n, codes))
    weights = _code_weights()
    seen = np.zeros((2, DEPTHS, GATES, ODDS))
    done = 0
    for depth, (live, bit, gate, x) in enumerate(steps):
        d = min(depth, DEPTHS - 1)
        mass = n[live]
        train = np.flatnonzero(mass)
        bit_, gate_, mass, x = bit[train], gate[train], mass[train], [v[train] for v in x]
        for lo in range(0, len(train), STEP):
            part = slice(lo, lo + STEP)
            b, g, own = bit_[part], gate_[part], [v[part] for v in x]
            done += 1
            c = np.sqrt(mass[part])
            dot = _mixed(own, weights[d], g)
            error = (b - _squash(dot)) * c
            pace = RATE / np.sqrt(1 + done / 100) / (np.bincount(g, c, GATES) + 1)
            for j, v in enumerate(own):
                weights[d, :, j] += pace * np.bincount(g, error * v, GATES)
            weights[d, :, -1] += pace * np.bincount(g, error * BIAS, GATES)
            seen[:, d] += np.bincount((b * GATES + g) * ODDS + _odds(dot), mass[part], 2 * GATES * ODDS).reshape(2, GATES, ODDS)
    centre = _squash((np.arange(ODDS) - ODDS // 2) / 2.0)
    refine = np.clip((seen[1] + 4 * centre) / (seen[0] + seen[1] + 4), 1e-6, 1 - 1e-6)
    out = np.ones(len(t))
    for depth, (live, bit, gate, x) in enumerate(steps):
        d = min(depth, DEPTHS - 1)
        dot = _mixed(x, weights[d], gate)
        p = 0.5 * (_squash(dot) + refine[d, gate, _odds(dot)])
        out[live] *= np.where(bit == 1, p, 1 - p)  # over 1e-6 each, and at most 32 of them
    return np.log10(out)


# ---------------------------------------------------------------- texts


class Source:
    """The tokens of some documents, gathered until there are FLUSH_TOKENS of them."""

    def __init__(self, number: int):
        self.number, self.tokens = number, 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[np.ndarray, ...]] = []

    def add(self, low: np.ndarray, off: np.ndarray, docs: tuple[np.ndarray, ...]) -> None:
        starts, ends, doc = words(low, off)
        size = len(off) - 1
        per = np.bincount(doc, minlength=size) + 1
        close = np.cumsum(per) - 1
        h = np.empty(int(per.sum()), U)
        h[close] = END
        inner = np.ones(len(h), bool)
        inner[close] = False
        h[inner] = hashes(low, starts, ends)
        base = sum(len(x[0]) for x in self.docs)
        self.parts.append((h, np.repeat(np.arange(size) + base, per)))
        self.docs.append((*docs, per, np.bincount(doc, ends - starts, size).astype(np.int64) + per))
        self.tokens += len(h)

    def rows(self, codes: Codes, shard_bits: int, per: int, word_buckets: int) -> list[tuple[int, int, bytes]]:
        """(bucket, source, block): the source's documents, requests to n-gram buckets, and to word buckets."""
        h, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        train, *rest = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        docs = len(train)
        known, at = codes.find(h)
        t = np.full(len(h), codes.escape)
        t[known] = codes.numbers[at[known]]
        classes = np.ones(len(h), U)
        classes[known] = codes.classes[at[known]]
        size = rest[2]
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        before, heat = [], []
        for j in (1, 2, 3):  # what stands before a text is a word of its own
            w, c = np.full(len(h), START, U), np.full(len(h), codes.starts, U)
            w[j:], c[j:] = h[:-j], classes[:-j]
            head = np.flatnonzero(place < j)
            w[head], c[head] = START, codes.starts
            before.append(mix(w + U(j)))
            heat.append(c)
        two, three = (before[1] >> U(48)).astype(np.uint16), (before[2] >> U(48)).astype(np.uint16)
        k, hot = before[0].copy(), np.flatnonzero(heat[0] > 1)
        k[hot] += before[1][hot] % heat[0][hot]
        both = hot[heat[1][hot] > 1]
        k[both] = mix(before[0][both] ^ (before[1][both] * U(0x9E3779B97F4A7C15))) + before[2][both] % np.minimum(heat[0], heat[1])[both]
        k = mix(k)
        own = train[doc]
        finer = two.astype(U) | three.astype(U) << U(16) | t.astype(U) << U(32) | own.astype(U) << U(48)
        every = mix(k ^ mix(finer))
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        count = np.diff(np.r_[first, len(order)])
        often = count >= OFTEN
        single = order[np.repeat(~often, count)]
        shared = order[first[often]]
        sent = np.r_[single, shared]
        local = np.r_[doc[single], docs + np.arange(len(shared))]
        n = np.r_[own[single], count[often] * own[shared]]
        by = np.argsort(k[sent])
        sent, local, n = sent[by], local[by], n[by]
        out = []
        bucket = (k[sent] >> U(64 - shard_bits)).astype(np.int64) // per if shard_bits else np.zeros(len(sent), np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            x = slice(lo, hi)
            i, b = sent[x], int(bucket[lo])
            out.append((b, self.number, pack(k[i] >> U(20), two[i], three[i], t[i].astype(np.uint16), local[x].astype(np.uint32), n[x].astype(np.uint32))))
        lone = np.flatnonzero(~known)
        names, which = np.unique(h[lone], return_inverse=True)
        base = np.bincount(doc[known], np.log10(codes.counts[at[known]] + 1.0), docs)
        found = np.bincount(doc[known], minlength=docs)
        members = order[np.repeat(often, count)]
        out.append((DOCS + self.number, self.number, pack(train, *rest, base, found, count[often].astype(np.uint32), doc[members].astype(np.uint32), doc[lone].astype(np.uint32), which.astype(np.uint32))))
        for b, x in by_bucket(_bucket(names, word_buckets)):
            out.append((-1 - b, self.number, pack(names[x], x.astype(np.uint32))))
        return out


#: What stands for the word before a text; keys of rows about documents start here.
START, DOCS = U(0x73746172745F6F66), 1 << 48


def _ask(codes: Broadcast, shard_bits: int, per: int, word_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("source", pa.int64()), ("block", pa.binary())])
        first = TaskContext.get().partitionId() << 20
        source = Source(first)

        def flush() -> pa.RecordBatch:
            rows = source.rows(codes.value, shard_bits, per, word_buckets)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for lo, data, off in slices(b.column("text")):
                n = len(off) - 1
                ids = b.column("id").slice(lo, n)
                docs = (1 - b.column("held").slice(lo, n).to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
                source.add(LOWER[data], off, docs)
                if source.tokens >= FLUSH_TOKENS:
                    yield flush()
                    source = Source(source.number + 1)
        if source.tokens:
            yield flush()

    return run


def _by_local(source: np.ndarray, local: np.ndarray, value: np.ndarray) -> list[tuple[int, bytes]]:
    """(source, block): sums by number in the source."""
    out = []
    for s, rows in by_bucket(source):
        at, x = local[rows], value[rows]
        if int(at.max()) < 4 * len(at):
            own = np.flatnonzero(np.bincount(at))
            total = np.bincount(at, x)[own]
        else:
            own, at = np.unique(at, return_inverse=True)
            total = np.bincount(at, x)
        out.append((s, pack(own.astype(np.uint32), total.astype(np.float32))))
    return out


def _answer(codes: Broadcast, shard_bits: int):
    """Answers one bucket: (source, kind, block); kinds are documents 0, sums 1 and spelled words 2."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = int(pdf["bucket"].iloc[0])
        source = pdf["source"].to_numpy()
        if key >= DOCS:
            return pd.DataFrame({"source": source, "kind": 0, "block": pdf["block"]})
        parts = [unpack(x) for x in pdf["block"]]
        if key < 0:
            asked = [(s, p) for s, p in zip(source.tolist(), parts, strict=True) if len(p) == 2]
            if not asked:
                return pd.DataFrame({"source": [], "kind": [], "block": []})
            names, n, score = next(p for p in parts if len(p) == 3)
            out = []
            for s, (h, at) in asked:
                i = np.searchsorted(names, h)
                out.append((s, pack(at, score[i], n[i])))
            return pd.DataFrame({"source": [s for s, _ in out], "kind": 2, "block": [x for _, x in out]})
        k, two, three, t, local, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        whose = np.repeat(source, [len(p[0]) for p in parts])
        finer = three.astype(U) << U(32) | t.astype(U) << U(16) | (n > 0)
        coarse = k << U(16) | two
        order = np.argsort(finer)
        order = order[np.argsort(coarse[order], kind="stable")]
        coarse, finer = coarse[order], finer[order]
        same = (coarse[1:] == coarse[:-1]) & (finer[1:] == finer[:-1])
        new = np.r_[True, ~same]
        one = order[new]  # equal tokens in equal contexts are one, whichever sources sent them
        code = np.empty(len(k), np.int64)
        code[order] = np.cumsum(new) - 1
        k, two, three, t, n = k[one], two[one], three[one], t[one].astype(np.int64), np.bincount(code, n).astype(np.int64)
        shard = k >> U(44 - shard_bits) if shard_bits else np.zeros(len(k), U)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        value = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(k)], strict=True):
            for i in range(lo, hi, 2 * SHARD_TOKENS):
                j = min(hi, i + 2 * SHARD_TOKENS)
                value.append(code_scores(k[i:j], two[i:j], three[i:j], t[i:j], n[i:j], codes.value))
        value = np.concatenate(value)[code]
        rows = _by_local(whose, local, value)
        return pd.DataFrame({"source": [s for s, _ in rows], "kind": 1, "block": [x for _, x in rows]})

    return run


def _assembled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of one source, with the sums that came back."""
    kind = pdf["kind"].to_numpy()
    train, id_, there, n, size, base, found, count, members, lone, which = unpack(pdf["block"][kind == 0].iloc[0])
    docs = len(train)
    total = np.zeros(docs + len(count))
    for block in pdf["block"][kind == 1]:
        local, value = unpack(block)
        total[local] += value
    score = total[:docs] + np.bincount(members, np.repeat(total[docs:], count), docs)
    spelled, times = np.zeros(int(which.max()) + 1 if len(which) else 0), np.zeros(int(which.max()) + 1 if len(which) else 0)
    for block in pdf["block"][kind == 2]:
        at, value, seen = unpack(block)
        spelled[at], times[at] = value, seen
    score += np.bincount(lone, spelled[which], docs)
    base = base + np.bincount(lone, np.log10(times[which] + 1.0), docs)
    found = found + np.bincount(lone, times[which] > 0, docs).astype(np.int64)
    ids = pd.array(id_, "Int64")
    ids[there == 0] = pd.NA
    return pd.DataFrame({"id": ids, "held": train == 0, "n": n, "known": found, "base": base, "score": score, "bytes": size})


def _frequent(types: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the most frequent words of training texts, TOP_WORDS at most."""
    rank = types.select(F.posexplode("counts").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()  # 512 rows
    least, held = 512, 0
    for r in rank:
        held += r["n"]
        if held > TOP_WORDS:
            break
        least = r["step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, *_ in _blocks(batches):
            use = (n > 0) & (_step(n) >= least)
            yield pa.RecordBatch.from_pydict({"block": pa.array([pack(h[use], n[use])], pa.binary())})

    got = [r["block"] for r in types.select("block").mapInArrow(lean(run), "block binary").collect()]  # TOP_WORDS words at most
    return tuple(merged(got)) if got else (np.zeros(0, U), np.zeros(0, np.int64))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)."""
    spark = docs.sparkSession
    word_buckets = 1 << max(2, (-(-text_bytes(docs, text) // WORD_BYTES) - 1).bit_length())
    types = distinct_words(docs, text, F.when(held_out(F.col(doc_id)), -1).otherwise(0), word_buckets, 1)
    sums = types.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    tokens, vocabulary = int(sums[0]), int(sums[1])
    h, n = _frequent(types)
    codes = spark.sparkContext.broadcast(Codes(h, n, tokens - int(n.sum())))
    model = fit(types)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, n, size, data in _blocks([b]):
                size = size.astype(np.int64)
                use = np.flatnonzero(~codes.value.find(h)[0])
                start = np.cumsum(size) - size
                out.append(pack(h[use], n[use], log_probabilities(size[use], _take(data, start[use], size[use]), model)[0]))
            yield pa.RecordBatch.from_pydict({"bucket": pc.subtract(-1, b.column("bucket").cast(pa.int64())), "source": pa.array(np.full(b.num_rows, -1)), "block": pa.array(out, pa.binary())})

    request = "bucket long, source long, block binary"
    table = stage(types.select("bucket", "block").repartition(max(1, types.count())).mapInArrow(lean(spelled), request), "lm-spelled")
    model.shared.unpersist()
    release()
    shard_bits = max(0, (tokens // SHARD_TOKENS).bit_length())
    per = max(1, BUCKET_TOKENS // SHARD_TOKENS)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), held_out(F.col(doc_id)).alias("held"), F.col(text).alias("text"))
    asked = rows.mapInArrow(lean(_ask(codes, shard_bits, per, word_buckets)), request)
    answers = asked.unionByName(table).groupBy("bucket").applyInPandas(lean_group(_answer(codes, shard_bits)), "source long, kind int, block binary")
    out = answers.groupBy("source").applyInPandas(lean_group(_assembled), "id long, held boolean, n long, known long, base double, score double, bytes long")
    constant = float(np.log10(tokens + 1.0 * (vocabulary + 1)))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * F.lit(constant)).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(LOG10_2) / F.col("bytes")).alias("bits_per_byte"),
    )
