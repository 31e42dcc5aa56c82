"""Alignment of two tokenizers over a corpus, and counts of the id pairs that end together.

A text, with one space before it, is encoded by tokenizer A (byte-level BPE) and tokenizer B (pieces with
byte fallback).  Byte offsets where tokens of both end cut the tokens into groups; at each such offset the
last A id and the last B id are linked.  A first pass counts every linked pair of the corpus; a second
one aligns each document again and looks its links up.

Counting.  Tasks of the first pass add up the pairs they meet, dealt into shards by B id, as sorted blocks.  A shard's
distinct pairs get a minimal perfect hash (bits in levels: keys alone in their slot stay there, the
others go on), and counts become a dense vector with a place for each pair, added up as a tree of FAN
branches.  A lookup compares the pair stored at its place, so an unknown pair is told from a known one.
Two ids can only be linked if one's bytes end with the other's: the number of such pairs of the two
vocabularies bounds the table whatever the corpus is.  It is broadcast if that bound fits
BROADCAST_BYTES; else links meet the counts in a join.

Texts are cut before runs of white space where neither tokenizer can merge across; a piece met again in a
worker is not encoded again.  Texts with white space beyond ASCII beside other white space stay whole.

Cases: a null or empty text, or one whose tokens of B don't spell it (it has U+2581), has no tokens, zeros
and an empty string of groups, and counts nothing; special tokens in a text are plain text; rows of one
doc_id and null ids are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import WHITE, U, mix, slices
from .shared import BROADCAST_BYTES, lean, lean_group, pack, stage, unpack
from .token_files import BYTE_LETTERS, Encoder

#: Pairs that the vocabularies allow, for each shard of the table.
SHARD_PAIRS = 1 << 16
#: Blocks or vectors that one task adds up.
FAN = 32
#: Pieces that a worker's columns hold before they are emptied, and the longest one found again (bytes).
CACHE, CACHED_BYTES = 500_000, 64
#: Distinct pairs that a task of the first pass holds before it writes a block.
HELD = 1 << 20
GAMMA, LEVELS = 2, 40


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each key's place among len(keys) places."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.first = np.r_[0, np.cumsum(sizes // 64)]
        self.rank = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys ^ (U(level + 1) * U(0x9E3779B97F4A7C15))) % U(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = -(-GAMMA * len(keys) // 64) * 64
            at = cls.slots(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, U), *words]), np.sort(keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Places; keys that were not hashed get any place, or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.slots(keys[open_], level, size)
            word, bit = self.first[level] + (at >> 6), (at & 63).astype(U)
            x = self.words[word]
            here = (x >> bit) & U(1) == 1
            below = np.bitwise_count(x & ((U(1) << bit) - U(1)))
            out[open_[here]] = (self.rank[word] + below)[here]
            open_ = open_[~here]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.rank[-1] + at[found]
        return out


class PairTable:
    """Counts of linked pairs and whether each is its B id's highest, by shard."""

    def __init__(self, shards: int, parts: dict[int, list[np.ndarray]]):
        self.shards = shards
        self.parts = {s: (PerfectHash(*x[:3]), *x[3:]) for s, x in parts.items()}

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        of = shard_of(keys, self.shards)
        for s, (place, known, counts, highest) in self.parts.items():
            k = np.flatnonzero(of == s)
            at = place(keys[k])
            k, at = k[at >= 0], at[at >= 0]
            same = known[at] == keys[k]
            count[k[same]], best[k[same]] = counts[at[same]], highest[at[same]]
        return count, best


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Pairs of one B id share a shard."""
    return (mix(keys & U(0xFFFFFFFF)) % U(shards)).astype(np.int64)


def byte_tokens(path: str) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    plain = {chr(c): b for b, c in ({b: b for b in range(256)} | BYTE_LETTERS).items()}
    vocabulary = Tokenizer.from_file(path).get_vocab()
    return {i: bytes(plain[c] for c in x) if all(c in plain for c in x) else x.encode() for x, i in vocabulary.items()}


def piece_tokens(path: str) -> dict[int, bytes]:
    """Bytes of each id of a piece vocabulary; ids that stand for no text are left out."""
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(p.get_piece_size()):
        if p.is_byte(i):
            out[i] = bytes([int(p.id_to_piece(i)[3:5], 16)])
        elif not (p.is_unknown(i) or p.is_control(i)):
            out[i] = p.id_to_piece(i).replace("▁", " ").encode()
    return out


def most_pairs(a: dict[int, bytes], b: dict[int, bytes]) -> int:
    """Pairs of ids of which one's bytes end with the other's: no others can ever be linked."""

    def by_text(ids: dict[int, bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for x in ids.values():
            out[x] = out.get(x, 0) + 1
        return out

    in_a, in_b = by_text(a), by_text(b)
    longer = sum(n * in_b.get(x[j:], 0) for x, n in in_a.items() for j in range(len(x)))
    return longer + sum(n * in_a.get(x[j:], 0) for x, n in in_b.items() for j in range(1, len(x)))


class Aligner:
    """Groups and links of texts.  What a piece of text gave stands in columns, by its row, and is found
    again there; when they are full they are emptied."""

    def __init__(self, a_path: str, b_path: str):
        self.encoder = Encoder(a_path, False)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a, b = byte_tokens(a_path), piece_tokens(b_path)
        self.a_size, self.b_size = self._sizes(a), self._sizes(b)
        self.b_at = np.cumsum(self.b_size) - self.b_size
        self.b_text = np.frombuffer(b"".join(b.get(i, b"") for i in range(len(self.b_size))), np.uint8)
        digits = [str(i).encode() for i in range(max(len(self.a_size), len(self.b_size)))]
        self.digits, self.digits_size = np.frombuffer(b"".join(digits), np.uint8), np.array([len(x) for x in digits])
        self.digits_at = np.cumsum(self.digits_size) - self.digits_size
        self.space = self.pieces.piece_to_id("▁")
        many = [x for i, x in b.items() if not self.pieces.is_byte(i) and len(x) > 1]
        self.splits = not any(b" " in x.lstrip(b" ") for x in many)
        merged = set(b"".join(many))
        self.cut = WHITE & np.array([c == 0x20 or c not in merged for c in range(256)])
        self._empty()

    @staticmethod
    def _sizes(tokens: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(max(tokens) + 1, np.int64)
        out[list(tokens)] = [len(x) for x in tokens.values()]
        return out

    def _empty(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.facts = np.zeros((0, 4), np.int64)  # A ids, B ids, links, whether B's tokens spell it
        self.keys, self.key_at = np.zeros(0, U), np.zeros(1, np.int64)
        self.texts: list[bytes] = []

    def _pieces(self, segments: list[bytes]) -> list[list[int]]:
        """B ids; B adds a space before what it is given, which is the segment's own or is taken away."""
        out = self.pieces.encode([x[x[:1] == b" " :].decode() for x in segments], num_threads=1)
        return [[self.space] if x == b" " else y if x[:1] == b" " else y[1:] for x, y in zip(segments, out, strict=True)]

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text of the groups, each ended by a semicolon, and the bytes of each group.  last_*: tokens that end one."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b]
        ids[at_a], ids[at_b] = a, b
        mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
        size = self.digits_size[ids] + 1
        end = np.cumsum(size)
        out = np.empty(int(size.sum()), np.uint8)
        own = np.ones(len(out), bool)
        own[end - 1] = False
        out[end - 1] = mark
        out[own] = self.digits[_ranges(self.digits_at[ids], size - 1)]
        return out, np.diff(np.r_[0, end[at_b[last_b]]])

    def _add(self, segments: list[bytes], whole: bool) -> np.ndarray:
        """Rows of new segments."""
        if whole:
            a = [self.encoder._whole(x.decode()) for x in segments]
        else:
            a = self.encoder._new(segments)
        n_a = np.array([len(x) for x in a], np.int64) // self.encoder.kind.itemsize
        a = np.frombuffer(b"".join(a), self.encoder.kind).astype(np.int64)
        b = self._pieces(segments)
        n_b = np.array([len(x) for x in b], np.int64)
        b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        size = np.array([len(x) for x in segments], np.int64)
        of_b = np.repeat(np.arange(len(segments)), n_b)
        good = np.bincount(of_b, self.b_size[b], len(segments)) == size
        same = good.copy()
        b, of_b = b[good[of_b]], of_b[good[of_b]]
        want = np.frombuffer(b"".join([x for x, y in zip(segments, good.tolist(), strict=True) if y]), np.uint8)
        wrong = np.flatnonzero(self.b_text[_ranges(self.b_at[b], self.b_size[b])] != want)
        same[np.repeat(np.arange(len(segments)), np.where(good, size, 0))[wrong]] = False
        a = a[np.repeat(same, n_a)]
        b = b[same[of_b]]
        size, n_a, n_b = size * same, n_a * same, n_b * same
        ends = []
        for ids, sizes in ((a, self.a_size), (b, self.b_size)):
            e = np.zeros(int(size.sum()), bool)
            e[np.cumsum(sizes[ids]) - 1] = True
            ends.append(e)
        both = ends[0] & ends[1]
        last_a, last_b = both[ends[0]], both[ends[1]]
        keys = (a[last_a].astype(U) << U(32)) | b[last_b].astype(U)
        n = np.add.reduceat(np.r_[both, False], np.r_[0, np.cumsum(size)[:-1]]) * (size > 0) if len(size) else size
        first = len(self.facts)
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n, same], 1)])
        self.keys, self.key_at = np.concatenate([self.keys, keys]), np.concatenate([self.key_at, self.key_at[-1] + np.cumsum(n)])
        flat, sizes = self._groups(a, b, last_a, last_b)
        at = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(n)]].tolist()
        flat = flat.tobytes()
        self.texts += [flat[x:y] for x, y in zip(at, at[1:])]
        return np.arange(first, len(self.facts))

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, the row of each segment, first segment of each text) for slices of the texts; a text that
        can't be aligned has no segments."""
        for lo, data, off in slices(column):
            if len(self.facts) > CACHE:
                self._empty()
            odd = self.encoder._odd(column.slice(lo, len(off) - 1), data, off) | (not self.splits)
            white = WHITE[data]
            cut = self.cut[data]
            cut[1:] &= ~white[:-1]
            cut[off[:-1][off[:-1] < off[1:]]] = True
            start = np.flatnonzero(cut)
            doc = np.searchsorted(off, start, "right") - 1
            keep = ~odd[doc] | (start == off[doc])
            start, doc = start[keep], doc[keep]
            edge = np.r_[start, len(data)].astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            of, segments = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            apart = np.zeros(len(segments), bool)  # texts that stay whole
            apart[of[odd[doc]]] = True
            found = list(map(self.rows.get, segments))
            row = np.array([-1 if x is None else x for x in found], np.int64)
            for whole in (False, True):
                new = np.flatnonzero((row < 0) & (apart == whole)).tolist()
                if new:
                    row[new] = self._add([segments[i] for i in new], whole)
                    self.rows.update((segments[i], r) for i, r in zip(new, row[new].tolist()) if len(segments[i]) <= CACHED_BYTES)
            of = row[of]
            bad = self.facts[of, 3] == 0
            if bad.any():
                lost = np.zeros(len(off) - 1, bool)
                lost[doc[bad]] = True
                of, doc = of[~lost[doc]], doc[~lost[doc]]
            yield lo, of, np.searchsorted(doc, np.arange(len(off)))

    def links(self, rows: np.ndarray) -> np.ndarray:
        """Links of rows one after another."""
        return self.keys[_ranges(self.key_at[rows], self.facts[rows, 2])]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many as its size."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    return _aligners.get((a_path, b_path)) or _aligners.setdefault((a_path, b_path), Aligner(a_path, b_path))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(a_path: str, b_path: str, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = shard_of(keys, shards)
        rows = [(s, pack(keys[of == s], counts[of == s])) for s in np.unique(of).tolist()]
        if rows:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _ in rows], pa.int32()), "block": pa.array([x for _, x in rows], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(a_path, b_path)
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for b in batches:
            for _, of, _ in align(b.column("text")):
                met, times = np.unique(of, return_counts=True)
                keys, counts = _summed(np.r_[keys, align.links(met)], np.r_[counts, np.repeat(times, align.facts[met, 2])])
                if len(keys) > HELD:
                    yield from blocks(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from blocks(keys, counts)

    return run


def _tree(rows: DataFrame, merge: Callable[[list[bytes]], bytes], parts: int, tag: str) -> DataFrame:
    """One block for each shard from (shard, part, block) rows, FAN at a time."""

    def run(pdf):
        return pdf.iloc[:1].assign(part=pdf["part"].iloc[0] // FAN, block=[merge(pdf["block"].tolist())])

    while True:
        at = F.floor(F.col("part") / FAN)
        rows = stage(rows.groupBy("shard", at.alias("__at")).applyInPandas(lean_group(run), "shard int, part long, block binary"), tag)
        parts = -(-parts // FAN)
        if parts == 1:
            return rows


def _distinct(blocks: list[bytes]) -> bytes:
    return pack(np.unique(np.concatenate([unpack(x)[0] for x in blocks])))


def _added(blocks: list[bytes]) -> bytes:
    total = unpack(blocks[0])[0].copy()
    for x in blocks[1:]:
        total += unpack(x)[0]
    return pack(total)


def count_pairs(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, block) rows: each shard's perfect hash, and for each of its places the pair, its count and
    whether the count is its B id's highest."""
    spark = docs.sparkSession
    shards = max(1, -(-most_pairs(byte_tokens(a_path), piece_tokens(b_path)) // SHARD_PAIRS))
    texts = docs.select(_with_space(text).alias("text"))
    counted = texts.mapInArrow(lean(_count(a_path, b_path, shards)), "shard int, block binary").withColumn("part", F.spark_partition_id().cast("long"))
    found = stage(counted, "pairs")
    parts = int(found.agg(F.max("part")).first()[0] or 0) + 1
    hashes = _tree(found, _distinct, parts, "distinct-pairs").collect()  # bounded by the vocabularies
    known = {}
    for r in hashes:
        keys = unpack(r["block"])[0]
        place = PerfectHash.of(keys)
        ordered = np.empty_like(keys)
        ordered[place(keys)] = keys
        known[r["shard"]] = pack(place.sizes, place.words, place.rest, ordered)
    shared = spark.sparkContext.broadcast(known)

    def dense(pdf):
        sizes, words, rest, ordered = unpack(shared.value[int(pdf["shard"].iloc[0])])
        place, total = PerfectHash(sizes, words, rest), np.zeros(len(ordered), np.int64)
        for x in pdf["block"]:
            keys, counts = unpack(x)
            total[place(keys)] += counts
        return pdf.iloc[:1].assign(part=pdf["part"].iloc[0] // FAN, block=[pack(total)])

    def closed(pdf):
        s = int(pdf["shard"].iloc[0])
        sizes, words, rest, ordered = unpack(shared.value[s])
        counts = unpack(pdf["block"].iloc[0])[0]
        b = (ordered & U(0xFFFFFFFF)).astype(np.int64)
        highest = np.zeros(int(b.max()) + 1, np.int64)
        np.maximum.at(highest, b, counts)
        return pdf.iloc[:1].assign(block=[pack(sizes, words, rest, ordered, counts, (counts == highest[b]).astype(np.uint8))])[["shard", "block"]]

    at = F.floor(F.col("part") / FAN)
    vectors = stage(found.groupBy("shard", at.alias("__at")).applyInPandas(lean_group(dense), "shard int, part long, block binary"), "count-vectors")
    whole = _tree(vectors, _added, -(-parts // FAN), "count-vectors")
    return stage(whole.groupBy("shard").applyInPandas(lean_group(closed), "shard int, block binary"), "pair-table")


def pair_rows(pairs: DataFrame) -> DataFrame:
    """(a, b, n, best): the counted pairs as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                keys, counts, best = unpack(block)[3:]
                yield pa.RecordBatch.from_pydict({"a": pa.array((keys >> U(32)).astype(np.int64)), "b": pa.array((keys & U(0xFFFFFFFF)).astype(np.int64)), "n": pa.array(counts), "best": pa.array(best.astype(bool))})

    return pairs.mapInArrow(run, "a long, b long, n long, best boolean")


def _with_space(text: str):
    """The text with one space before it; null and empty ones stay empty."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col(text)))


def _look_up(a_path: str, b_path: str, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(a_path, b_path)
        shards, parts = shared.value
        table = PairTable(shards, {s: unpack(x) for s, x in parts.items()})
        for b in batches:
            for lo, of, first in align(b.column("text")):
                n = len(first) - 1
                met, of_met = np.unique(of, return_inverse=True)
                count, best = table(align.links(met))
                edge = np.r_[0, np.cumsum(align.facts[met, 2])]
                facts = [*align.facts[met, :3].T, *[np.diff(np.r_[0, np.cumsum(x)][edge]) for x in (best, count)]]
                sums = [np.diff(np.r_[0, np.cumsum(x[of_met])][first]) for x in facts]
                text = list(map(align.texts.__getitem__, of.tolist()))
                groups = [b"".join(text[first[i] : first[i + 1]])[:-1] for i in range(n)]
                names = ("n_a", "n_b", "n_links", "n_best", "count_sum")
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(lo, n), **{k: pa.array(x) for k, x in zip(names, sums, strict=True)}, "groups": pa.array(groups, pa.binary()).cast(pa.string())})

    return run


def _links_of(a_path: str, b_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents with their links, for vocabularies whose pairs are too many to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(a_path, b_path)
        for b in batches:
            for lo, of, first in align(b.column("text")):
                n, facts, text = len(first) - 1, align.facts[of, :3], list(map(align.texts.__getitem__, of.tolist()))
                sums = np.diff(np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(facts, 0)])[first], axis=0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b.column("doc_id").slice(lo, n),
                        "n_a": pa.array(sums[:, 0]),
                        "n_b": pa.array(sums[:, 1]),
                        "links": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sums[:, 2])], pa.int32()), pa.array(align.links(of).astype(np.int64))),
                        "groups": pa.array([b"".join(text[first[i] : first[i + 1]])[:-1] for i in range(n)], pa.binary()).cast(pa.string()),
                    }
                )

    return run


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row: tokens, groups (as
    `a1,a2|b1;a3|b2,b3`), links, links whose count is their B id's highest, and the sum of the links' counts."""
    pairs = count_pairs(docs, a_path, b_path, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _with_space(text).alias("text"))
    bound = most_pairs(byte_tokens(a_path), piece_tokens(b_path))
    out = ["doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups"]
    if 32 * bound <= broadcast_bytes:  # a pair's key, count, flag and bits
        shared = docs.sparkSession.sparkContext.broadcast((max(1, -(-bound // SHARD_PAIRS)), {r["shard"]: bytes(r["block"]) for r in pairs.collect()}))
        return rows.mapInArrow(lean(_look_up(a_path, b_path, shared)), "doc_id long, n_a long, n_b long, n_links long, n_best long, count_sum long, groups string").select(*out)
    made = rows.mapInArrow(lean(_links_of(a_path, b_path)), "doc_id long, n_a long, n_b long, links array<long>, groups string")
    kept = stage(made.withColumn("row", F.monotonically_increasing_id()), "aligned")
    each = kept.select("row", F.explode("links").alias("link")).groupBy("row", "link").agg(F.count(F.lit(1)).alias("times"))
    known = pair_rows(pairs).select((F.shiftleft("a", 32) + F.col("b")).alias("link"), "n", "best")
    sums = each.join(known, "link").groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.expr("if(best, times, 0)")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return kept.join(sums, "row", "left").fillna(0, ["n_links", "n_best", "count_sum"]).select(*out)
