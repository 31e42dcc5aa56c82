"""Token-id files: documents as ids in Simple-8b words, written and read by Spark.

Format.  A document's ids are cut in blocks of BLOCK ids.  A block is a run of 64-bit words, low
bytes first.  The top four bits of a word select how the other sixty are used: the pairs (count,
width) of SELECTORS, the first value in the lowest bits; selector ESCAPE says that the next word is
one id of more than sixty bits as it stands.  A block's last word may have unused places, which are
zero.  ``blocks`` has the first word of each block (unsigned 32-bit numbers), so that blocks are
decoded together or alone.  The container is Parquet, written through Spark's committer, which any
shared store supports and which survives lost executors: a row for each document with doc_id,
n_tokens, blocks and words, in ascending order of doc_id within a file; directories ``bucket=K``
follow each other in that order.

Cases: an added token of the tokenizer (such as its end-of-text mark) in a text is split like any other
text, or, with `added`, is its one id; a null or empty text has the end id alone; null ids come first; rows of one doc_id follow
the order of a hash of their texts; an empty table makes an empty set of files.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .flat import WHITE, U, slices
from .shared import binary_rows, joinable, lean, text_bytes

BLOCK = 512
#: Text in a range of doc_ids that one task writes.
BUCKET_BYTES = 32 << 20
#: Buckets whose sums of ids are added up in one window.
RUN_BUCKETS = 1024
# Fixed values of the format.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
#: Entries in each of the two generations of a cache; what is in use moves to the younger one.
CACHE = 400_000

# Fixed value: the published pre-token pattern of the byte-level vocabulary.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = (".", ",", "!", "?", ";", ":")
# White space beyond ASCII, as UTF-8.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
# Fixed rule of byte-level vocabularies: bytes that print stand for themselves, the others follow from U+0100 on.
_PRINT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _PRINT)}
#: The code point of each byte's letter; line ends stay what they are.
_LINES = np.array([b if b == 10 else BYTE_LETTERS.get(b, b) for b in range(256)], "<u4")
_ALPHA = np.array([bytes([b]).isalpha() for b in range(256)]).astype(np.int64)
_MARK = np.isin(np.arange(256), [ord(c) for c in MARKS])


class _Cache(dict):
    def __init__(self, make: Callable):
        self.make = make
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def _wide_spaces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes of white space beyond ASCII."""
    at, size = [], []
    first = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    for mark in WIDE_SPACES:
        x = first[first <= len(data) - len(mark)]
        for i, byte in enumerate(mark):
            x = x[data[x + i] == byte]
        at.append(x)
        size.append(np.full(len(x), len(mark)))
    return np.concatenate(at), np.concatenate(size)


def segments(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the segments that make up each text.

    The pre-token pattern cuts before a run of white space, before its last character where something
    else follows, and after it unless it is a space: so words with the space before them, and what is
    left of white space, are encoded alone as they are in the text."""
    white = np.append(WHITE[data], False)
    follows = np.append(white[1:], False)
    before = np.r_[False, white[:-1]]
    end = np.zeros(len(white), bool)
    end[off[1:][off[1:] > off[:-1]] - 1] = True
    last = white & ~follows & ~end
    mark = (white & ~before) | last
    mark[1:] |= (last & (np.append(data, 0) != 0x20))[:-1]
    mark[off[:-1]] = True
    return np.flatnonzero(mark[:-1])


class Encoder:
    """Ids of whole texts, as Tokenizer.encode gives them: a slice's distinct segments are looked up,
    new ones encoded once.  With `added`, added tokens in a text are recognised, as Tokenizer.encode does
    by default; else those that are special are text like any other."""

    def __init__(self, path: str, added: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if added or not t.special]
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pattern = regex.compile(PRETOKEN)
        self.tokens = _Cache(self._encode)
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, token: str) -> bytes:
        """Ids of one pre-token: its bytes, spelled in the vocabulary's letters, go to the BPE model."""
        return self._coded([token.encode().decode("latin-1").translate(BYTE_LETTERS)])[0]

    def _spelled(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens without line ends, put in the vocabulary's letters together."""
        text = np.frombuffer(b"\n".join(words), np.uint8)
        return self._coded(_LINES[text].tobytes().decode("utf-32-le").split("\n")) if words else []

    def _coded(self, words: list[str]) -> list[bytes]:
        """Ids of words in the vocabulary's letters."""
        ids, cuts, step = [], [0], self.kind.itemsize
        for tokens in map(self.model.tokenize, words):
            ids += [t.id for t in tokens]
            cuts.append(len(ids) * step)
        flat = array(self.code, ids).tobytes()
        return [flat[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def _new(self, segments: list[bytes]) -> list[bytes]:
        """Ids of segments that are not known yet.  Those that are one pre-token, or one and a mark after it,
        are told by their bytes, where these are ASCII, and spelled together."""
        out: list = [None] * len(segments)
        if not segments:
            return out
        data = np.frombuffer(b"".join(segments), np.uint8)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        first = np.cumsum(size) - size
        narrow = np.maximum.reduceat(data, first) < 0x80
        bare = size - (data[first] == 0x20)
        count = np.add.reduceat(_ALPHA[data], first)
        alone = narrow & (count == bare) & (bare > 0)
        before = narrow & (count == bare - 1) & (bare > 1) & _MARK[data[first + size - 1]]
        plain, marked = np.flatnonzero(alone).tolist(), np.flatnonzero(before).tolist()
        for i in np.flatnonzero(~alone & ~before).tolist():
            text = segments[i].decode()
            word = text[1:] if text[:1] == " " else text
            if not text.isascii() and max(text) >= "ɐ":  # scripts on which Unicode versions might differ
                out[i] = self._whole(text)
            elif word.isalpha():
                plain.append(i)
            elif word[-1:] in MARKS and word[:-1].isalpha():
                marked.append(i)
            else:
                out[i] = b"".join(map(self.tokens.__getitem__, self.pattern.findall(text)))
        heads = [segments[i][:-1] for i in marked]
        begun = [self.known.get(x) or self.older.get(x) for x in heads]
        words = dict.fromkeys([segments[i] for i in plain])
        fresh = [x for x, ids in zip(heads, begun, strict=True) if ids is None]
        words.update(dict.fromkeys(fresh))
        made = dict(zip(words, self._spelled(list(words)), strict=True))
        for i in plain:
            out[i] = made[segments[i]]
        for i, x, ids in zip(marked, heads, begun, strict=True):
            out[i] = (ids or made[x]) + self.tokens[chr(segments[i][-1])]
        self.known.update((x, made[x]) for x in fresh)
        return out

    def _ids(self, segments: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, segments))
        miss = [i for i, x in enumerate(found) if x is None]
        for i in miss:
            found[i] = self.older.get(segments[i])
        new = [i for i in miss if found[i] is None]
        for i, x in zip(new, self._new([segments[i] for i in new]), strict=True):
            found[i] = x
        self.known.update((segments[i], found[i]) for i in miss)
        return found

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _odd(self, column: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that are encoded whole: with added tokens, or white space beyond ASCII beside other."""
        odd = np.zeros(len(off) - 1, bool)
        for content in self.added:
            odd |= pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)
        at, size = _wide_spaces(data)
        padded = np.r_[False, WHITE[data], False]
        touch = at[padded[at] | padded[at + size + 1]] if len(at) else at
        odd_at = np.r_[touch, np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
        odd[np.searchsorted(off, odd_at, "right") - 1] = True
        return odd

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, numbers of ids) for slices of the column's texts."""
        for lo, data, off in slices(column):
            odd = self._odd(column.slice(lo, len(off) - 1), data, off)
            start = segments(data, off) if len(data) else np.zeros(0, np.int64)
            edge = np.r_[start, len(data)].astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            of = coded.indices.to_numpy()
            doc = np.searchsorted(off, start, "right") - 1
            if odd.any():
                of, doc = of[~odd[doc]], doc[~odd[doc]]
            ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            size = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
            pool = np.frombuffer(b"".join(ids), self.kind)
            begin = (np.cumsum(size) - size)[of]
            size = size[of]
            flat = pool[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            n = np.bincount(doc, size, len(off) - 1).astype(np.int64)
            if odd.any():
                parts, at = [], np.r_[0, np.cumsum(n)]
                done = 0
                for i in np.flatnonzero(odd).tolist():
                    own = np.frombuffer(self._whole(data[off[i] : off[i + 1]].tobytes().decode()), self.kind)
                    parts += [flat[done : at[i]], own]
                    done, n[i] = at[i], len(own)
                flat = np.concatenate([*parts, flat[done:]])
            yield lo, flat, n


def _fit(width: np.ndarray) -> np.ndarray:
    """For each place the selector of most ids that fit in a word from there on; `width` has SELECTORS[0][0]
    zeros after each block."""
    out = np.full(len(width), ESCAPE, np.int8)
    most, span = {1: width}, 1  # greatest width of so many successive places
    while 2 * span <= SELECTORS[0][0]:
        x = most[span]
        most[2 * span] = np.maximum(x, np.append(x[span:], np.zeros(span, x.dtype)))
        span *= 2
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, w = SELECTORS[s]
        span = 1 << (count.bit_length() - 1)
        x, step = most[span], count - span
        np.copyto(out, np.int8(s), where=np.maximum(x, np.append(x[step:], np.zeros(step, x.dtype))) <= w)
    return out


def encode_blocks(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of blocks of the given lengths (all over 0) that follow each other in ids, and the
    number of words of each block."""
    if not len(lengths):
        return np.zeros(0, U), np.zeros(0, np.int64)
    pad = SELECTORS[0][0]
    gap = np.repeat(np.arange(len(lengths)) * pad, lengths)
    values = np.zeros(len(ids) + pad * len(lengths), U)
    values[np.arange(len(ids)) + gap] = ids
    start = np.cumsum(lengths + pad) - lengths - pad
    stop = start + lengths
    choice = _fit(np.frexp(values.astype(np.float64))[1].astype(np.int8))
    counts = np.array([c for c, _ in SELECTORS] + [0, 1])
    at, live, places, owner = start.copy(), np.arange(len(start)), [], []
    while len(live):
        here = at[live]
        places.append(here)
        owner.append(live)
        here = here + counts[choice[here]]
        at[live] = here
        live = live[here < stop[live]]
    places, owner = np.concatenate(places), np.concatenate(owner)
    order = np.argsort(places, kind="stable")
    places, owner = places[order], owner[order]
    which = choice[places]
    size = 1 + (which == ESCAPE)
    to = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), U)
    for s, (count, w) in enumerate(SELECTORS):
        k = np.flatnonzero(which == s)
        if not len(k):
            continue
        word = np.full(len(k), s << 60, U)
        for j in range(count):
            word |= values[places[k] + j] << U(j * w)
        words[to[k]] = word
    k = np.flatnonzero(which == ESCAPE)
    words[to[k]] = U(ESCAPE << 60)
    words[to[k] + 1] = values[places[k]]
    return words, np.bincount(owner, size, len(lengths)).astype(np.int64)


def decode_blocks(words: np.ndarray, n_words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of blocks of n_words words and `lengths` ids each."""
    if not len(words):
        return np.zeros(0, U)
    which = (words >> U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (which == ESCAPE).any():  # a word after an escape is an id: escapes in a row alternate
        for i in np.flatnonzero(which == ESCAPE):
            if not raw[i]:
                raw[i + 1] = True
    counts = np.array([c for c, _ in SELECTORS] + [0, 0])[which]
    counts[raw] = 1
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), U)
    for s, (count, w) in enumerate(SELECTORS):
        k = np.flatnonzero((which == s) & ~raw)
        for j in range(count if len(k) else 0):
            out[to[k] + j] = (words[k] >> U(j * w)) & U((1 << w) - 1)
    out[to[raw]] = words[raw]
    block = np.repeat(np.arange(len(n_words)), n_words)
    full = np.bincount(block, counts, len(n_words)).astype(np.int64)
    first = np.cumsum(full) - full
    within = np.arange(len(out)) - np.repeat(first, full)
    return out[within < np.repeat(lengths, full)]


def _cut(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block lengths of documents of n ids each, and each document's number of blocks."""
    blocks = -(-n // BLOCK)
    lengths = np.full(int(blocks.sum()), BLOCK)
    last = np.cumsum(blocks)[n > 0] - 1
    lengths[last] = (n - (blocks - 1) * BLOCK)[n > 0]
    return lengths, blocks


_encoders: dict[tuple[str, bool], Encoder] = {}


def _tokenised(path: str, end_id: int, added: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get((path, added)) or _encoders.setdefault((path, added), Encoder(path, added))
        for b in batches:
            for lo, flat, n in encode(b.column("__text")):
                at = np.cumsum(n + 1)
                ids = np.full(int(at[-1]), end_id, np.uint32)
                own = np.ones(len(ids), bool)
                own[at - 1] = False
                ids[own] = flat
                lengths, blocks = _cut(n + 1)
                words, sizes = encode_blocks(ids, lengths)
                first = np.cumsum(sizes) - sizes
                block_at = np.r_[0, np.cumsum(blocks)]
                word_at = np.r_[0, np.cumsum(sizes)][block_at]
                rel = (first - np.repeat(word_at[:-1], blocks)).astype("<u4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": b.column("bucket").slice(lo, len(n)),
                        "doc_id": b.column("doc_id").slice(lo, len(n)),
                        "tie": b.column("tie").slice(lo, len(n)),
                        "n_tokens": pa.array(n + 1, pa.int64()),
                        "blocks": binary_rows(rel, block_at),
                        "words": binary_rows(words, word_at),
                    }
                )

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, out: str, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> str:
    """Tokenises every text, appends end_id and writes the files under `out`; returns `out`.

    Rows are dealt by ranges of doc_id (and of the text's hash, so a hot or null id is no hot task)
    before they are tokenised; a range's task sorts, tokenises and writes it."""
    buckets = max(1, -(-text_bytes(docs, text) // BUCKET_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("__text"))
    ordered = rows.repartitionByRange(buckets, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("bucket", F.spark_partition_id())
    made = ordered.mapInArrow(lean(_tokenised(tokenizer, end_id, added)), "bucket int, doc_id long, tie long, n_tokens long, blocks binary, words binary")
    made.write.partitionBy("bucket").option("compression", "zstd").parquet(out)
    return out


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, doc_id, tie, n_tokens, blocks, words) rows of the files."""
    return spark.read.schema("doc_id long, tie long, n_tokens long, blocks binary, words binary, bucket int").parquet(path)


def decode_row(blocks: bytes, words: bytes, n: int) -> np.ndarray:
    w = np.frombuffer(words, "<u8")
    first = np.frombuffer(blocks, "<u4").astype(np.int64)
    return decode_blocks(w, np.diff(np.r_[first, len(w)]), _cut(np.array([n]))[0])


def token_ids(files: DataFrame) -> DataFrame:
    """files decoded: (bucket, doc_id, tie, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [decode_row(*x).astype(np.int64) for x in zip(b.column("blocks").to_pylist(), b.column("words").to_pylist(), b.column("n_tokens").to_pylist(), strict=True)]
            rest = {c: b.column(c) for c in ("bucket", "doc_id", "tie", "n_tokens")}
            yield pa.RecordBatch.from_pydict(rest | {"ids": pa.array(ids, pa.list_(pa.int64()))})

    return files.mapInArrow(lean(run), "bucket int, doc_id long, tie long, n_tokens long, ids array<long>")


def bucket_starts(files: DataFrame) -> DataFrame:
    """(bucket, before): ids in all earlier buckets.  Sums run within runs of RUN_BUCKETS buckets, and
    over the runs: a row for each 32 GB of text."""
    run = F.floor(F.col("bucket") / RUN_BUCKETS)
    total = files.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).withColumn("run", run)
    runs = total.groupBy("run").agg(F.sum("n").alias("all"))
    earlier = F.sum("all").over(W.partitionBy(F.lit(0)).orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    within = F.sum("n").over(W.partitionBy("run").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    both = total.select("bucket", "run", within.alias("within")).join(runs.select("run", earlier.alias("earlier")), "run")
    return both.select(F.col("bucket").alias("__bucket"), (F.coalesce("earlier", F.lit(0)) + F.coalesce("within", F.lit(0))).alias("before"))


def token_digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                n = b.column("n_tokens").to_numpy().astype(np.int64)
                lengths, blocks = _cut(n)
                words = [np.frombuffer(x, "<u8") for x in b.column("words").to_pylist()]
                firsts = [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column("blocks").to_pylist()]
                sizes = np.concatenate([np.diff(np.r_[f, len(w)]) for f, w in zip(firsts, words, strict=True)])
                ids = decode_blocks(np.concatenate(words), sizes, lengths).astype("<u4")
                cuts = np.r_[0, np.cumsum(n)]
                crc = [zlib.crc32(ids[cuts[i] : cuts[i + 1]]) for i in range(len(n))]
                rest = {c: b.column(c) for c in ("bucket", "doc_id", "tie", "n_tokens")}
                yield pa.RecordBatch.from_pydict(rest | {"ids_crc32": pa.array(crc, pa.int64())})

    order = W.partitionBy("bucket").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = files.mapInArrow(lean(run), "bucket int, doc_id long, tie long, n_tokens long, ids_crc32 long")
    placed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    starts = joinable(bucket_starts(files), "12")
    return placed.join(starts, F.col("bucket") == F.col("__bucket")).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
