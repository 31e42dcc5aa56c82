"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that an earlier document also has.

A document is earlier if its id is smaller.  Two strings of LENGTH bytes that are equal have the same
least hashed GRAM-gram, so the runs of successive strings with one such least value (a value's
strings lie within one piece of text of about 67 bytes) can be dealt by it, and equal strings meet.

1. Every document sends its values, deduplicated, to the value's bucket, which answers with those
   that a second document has.  A gram alone meets by chance in a large corpus, so a value goes with two
   checks of 15 bits: of the gram with the SIDE bytes before it, and of the gram with those after it.
   Each string of LENGTH bytes has one of the two whole, so a value counts as shared where either check
   agrees.  Values are cut to 34 bits on the way and document keys to 40, and values in answers to 16,
   which can only add to them.  A bucket also tells how many bytes of pieces it will get.
2. The pieces of the values answered go to their buckets, equal pieces once for each batch of texts.
   A bucket's pieces make a shard: its suffix array is found by Larsson-Sadakane refinement (sorted by
   the first eight bytes, then groups that are still tied by the ranks 8, 16, 32 ... places on), the
   common prefixes of neighbours by Kasai's walk, all pieces at once; runs of neighbours that
   share LENGTH bytes are equal strings, and the least id of a run covers all its later ones.
3. A bucket of more than SHARD_BYTES (a value that very many texts have) is several shards.  Each also
   sends its sorted strings, dealt by a hash; those of one hash meet, and each shard's strings are
   looked up by binary search in what the shards merge to.
4. Covered places return to the task that sent the pieces (its documents are known by number there),
   and from there to the documents.

Cases: a null text is empty; null ids count as greater than all others; rows of one id never cover
each other; matches within one document do not count; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import U, mix, slices
from .shared import by_bucket, joinable, lean, lean_group, merged, pack, shuffles_dropped, stage, text_bytes, unpack

LENGTH, GRAM = 50, 16
SPREAD = LENGTH - GRAM + 1
#: Bytes beside a gram, of which a string that holds the gram has those before it or those after it.
SIDE = SPREAD // 2
BUCKET_BYTES, SHARD_BYTES, SEGMENT_BYTES, SOURCE_BYTES = 4 << 20, 6 << 20, 4 << 20, 12 << 20
#: Successive strings in a piece at most; a longer run (of a periodic text) is cut.
RUN = 64
FLUSH = 2_000_000
#: Bits cut off document keys on the way to the buckets of values; bits of a check, two of which stand
#: for the lower bits of a value.
CUT, CHECK = 24, 15
#: Bytes of a piece of SPREAD / 2 strings, and sources into which a flush's pieces fall at most.
PIECE_BYTES = LENGTH - 1 + (SPREAD + 1) // 2
FLUSH_SOURCES = FLUSH * PIECE_BYTES // SOURCE_BYTES + 1
LAST = np.iinfo(np.int64).max
_ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]


def loads(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as a number; past the end come zeros."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n + 8 - n % 8, U)
    for s in range(8):
        out[s::8] = padded[s : s + len(out)].view(order)[: len(out) // 8]
    return out[:n]


def _over(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The least or greatest (as `of` has it) of each `width` successive numbers."""
    have = 1
    while 2 * have <= width:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[: have - width], x[width - have :]) if have < width else x


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes from each place on, and the mixed value of each gram; none for less than LENGTH bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, U), np.zeros(0, U)
    a = loads(data)
    g = len(data) - GRAM + 1
    # none is 0 (a gram of zeros would be), which stands for no string
    return a, np.maximum(mix(a[:g] * _ODD[0] + a[8 : 8 + g] * _ODD[1] + a[GRAM - 8 : GRAM - 8 + g] * _ODD[2]), U(1 << 2 * CHECK))


def _inside(n: int, off: np.ndarray) -> np.ndarray:
    """Whether the string at each of n places lies in one text."""
    inside = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(off) >= LENGTH)
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - LENGTH + 1, -1)
    return np.cumsum(inside[:-1]) > 0


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, first place, number of strings, text number) of each run."""
    h = grams(data)[1]
    m = _over(h, SPREAD, np.minimum) if len(h) else h
    return _runs(m, _inside(len(m), off), off)


def _runs(m: np.ndarray, inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of texts whose strings have the least values m."""
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, U), at, at, at
    new = np.r_[True, (m[at[1:]] != m[at[:-1]]) | (at[1:] != at[:-1] + 1)]
    border = np.zeros(len(m) + 1, bool)
    border[off[:-1][np.diff(off) >= LENGTH]] = True
    new |= border[at]
    run = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
    first = np.flatnonzero(place % RUN == 0)
    start = at[first]
    return m[start], start, np.diff(np.r_[first, len(at)]), np.searchsorted(off, start, "right") - 1


def checked_values(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value with its two checks, text number, look of its piece), in the order of places, for each gram
    that is the least of some string: 34 bits of its value, then the check of the gram with the SIDE bytes
    before it and that with those after it, each 0 where no string of that value has them."""
    a, h = grams(data)
    if not len(h):
        return h, h.astype(np.int64), h
    m = _over(h, SPREAD, np.minimum)
    inside = _inside(len(m), off)
    _, first, n, doc = _runs(m, inside, off)
    # the greatest least value of the strings that have a side of a gram is the gram's own, or the gram is of
    # no use there; the low byte of a value gives way to that of the string's place
    strings = np.zeros(SPREAD - 1 + len(h), U)
    strings[SPREAD - 1 : SPREAD - 1 + len(m)] = np.where(inside, m & ~U(0xFF) | np.arange(len(m), dtype=U) & U(0xFF), U(0))
    most = _over(strings, SPREAD - SIDE, np.maximum)
    before, after = most[: len(h)], most[SIDE : SIDE + len(h)]
    is_before, is_after = before ^ h <= U(0xFF), after ^ h <= U(0xFF)
    at = np.flatnonzero(is_before | is_after)
    is_before, is_after = is_before[at], is_after[at]
    check = np.zeros((2, len(at)), U)
    for side, has, x in ((0, is_before, (-SIDE, -SIDE + 8, -8)), (1, is_after, (GRAM, GRAM + 8, GRAM + SIDE - 8))):
        p = at[has]
        check[side, has] = (mix(h[p] + a[p + x[0]] * _ODD[0] + a[p + x[1]] * _ODD[1] + a[p + x[2]] * _ODD[2]) >> U(32)) % U((1 << CHECK) - 1) + U(1)
    base = at - np.where(is_after, SIDE, SPREAD - 1)
    string = base + ((np.where(is_after, after[at], before[at]).astype(np.int64) - base) & 0xFF)
    piece = np.maximum(np.searchsorted(first, string, "right") - 1, 0)
    look = a[first[piece]] ^ a[first[piece] + n[piece] + LENGTH - 9] * _ODD[0]
    return h[at] >> U(2 * CHECK) << U(2 * CHECK) | check[0] << U(CHECK) | check[1], doc[piece], look


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    """Least values crowd at zero, so they are mixed once more."""
    return (((mix(value + _ODD[0]) >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)


def _replies(source: np.ndarray, local: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """(source, block) of covered places: a block has numbers of documents in the source, starts and sizes."""
    names, code = np.unique(source[of], return_inverse=True)
    out = []
    for b, rows in by_bucket(code):
        rows = rows[np.lexsort((start[rows], local[of[rows]]))]
        out.append((int(names[b]), pack(local[of[rows]].astype(np.uint32), start[rows].astype(np.uint32), (end - start)[rows].astype(np.uint32))))
    return out


def _frame(rows: list[tuple[int, bytes]], key: str) -> pd.DataFrame:
    return pd.DataFrame({key: np.array([r[0] for r in rows], np.int32), "block": [r[1] for r in rows]})


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    return rows.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.coalesce("id", F.lit(LAST)), "tie"), CUT))


# ---------------------------------------------------------------- 1: values that two documents have


def _several(v: np.ndarray, key: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Whether the value of each row, which are in order, has several keys or a row that is told."""
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    there = (np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)) | np.logical_or.reduceat(told, start)
    return np.repeat(there, np.diff(np.r_[start, len(v)]))


def _shared(x: np.ndarray, key: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Whether a check of each value, which are in order, agrees with another key's or with one told."""
    out = np.zeros(len(x), bool)
    last = U((1 << CHECK) - 1)
    at = np.flatnonzero(_several(x >> U(2 * CHECK), key, told))
    if not len(at):
        return out
    x, key, told = x[at], key[at], told[at]
    out[at] = _several(x >> U(CHECK), key, told) & (x >> U(CHECK) & last > U(0))
    after = x >> U(2 * CHECK) << U(CHECK) | x & last
    order = np.argsort(after)
    after = after[order]
    out[at[order]] |= _several(after, key[order], told[order]) & (after & last > U(0))
    return out


def _told(x: np.ndarray, key: np.ndarray, hit: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Blocks that tell documents of some of their values, dealt by document."""
    v, key = (x[hit] >> U(2 * CHECK)).astype(np.uint16), key[hit]
    order = np.argsort(key, kind="stable")
    v, key = v[order], key[order]
    return [(b, pack(key[rows], v[rows])) for b, rows in by_bucket(_bucket(key.view(U), buckets))]


def _contents_of(v: np.ndarray, look: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many looks each value has; v is in order, `start` has each value's first place there."""
    order = np.lexsort((look, v))
    new = np.r_[True, (look[order][1:] != look[order][:-1]) | (v[1:] != v[:-1])]
    return np.add.reduceat(new.astype(np.int64), start)


def shared_values(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, shared, size): the values of documents of a key that another key's have too, with size null;
    and for each bucket as key the bytes of pieces of such values that it will get, about, with shared null.

    Documents of one flush that share a value hear of it at once, by way of their own bucket, and the
    value with its checks goes to its bucket once: a value that most texts have is no hot bucket.  With it
    goes how many pieces of several documents' value are sent: those that look different, once for each source."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, key, look, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            x, d, seen = (np.concatenate(c) for c in (value, key, look))
            order = np.argsort(x)
            x, d, seen = x[order], d[order], seen[order]
            many = _shared(x, d, np.zeros(len(x), bool))
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            one, count, several = x[start], np.diff(np.r_[start, len(x)]), many[start]
            pieces_ = np.zeros(len(one), np.int64)
            if several.any():
                own = count[several]
                pieces_[several] = np.minimum(own, FLUSH_SOURCES * _contents_of(x[many], seen[many], np.cumsum(own) - own))
            sent = np.minimum(pieces_, 0xFFFF).astype(np.uint16)
            out = [(b, pack(one[rows], d[start][rows], sent[rows])) for b, rows in by_bucket(_bucket(one >> U(2 * CHECK), buckets))]
            out += _told(x, d, many, buckets)
            return pa.RecordBatch.from_pandas(_frame(out, "bucket"), schema=pa.schema([("bucket", pa.int32()), ("block", pa.binary())]))

        for b in batches:
            for lo, data, off in slices(b.column("text")):
                x, doc, seen = checked_values(data, off)
                if not len(x):
                    continue
                order = np.argsort(x, kind="stable")
                keep = order[np.r_[True, (x[order][1:] != x[order][:-1]) | (doc[order][1:] != doc[order][:-1])]]
                value.append(x[keep])
                key.append(b.column("key").slice(lo, len(off) - 1).to_numpy()[doc[keep]])
                look.append(seen[keep])
                held += len(keep)
                if held > FLUSH:
                    yield flush()
                    value, key, look, held = [], [], [], 0
        if held:
            yield flush()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in pdf["block"]]
        to = int(pdf["bucket"].iloc[0])
        out = [(to, x) for x, part in zip(pdf["block"], parts, strict=True) if len(part) == 2]
        asked = [part for part in parts if len(part) == 3]
        if asked:
            x, key, sent = (np.concatenate(c) for c in zip(*asked, strict=True))
            order = np.argsort(x)
            x, key, sent = x[order], key[order], sent[order].astype(np.int64)
            told = sent > 0
            hit = _shared(x, key, told)
            out += _told(x, key, hit & ~told, buckets)
            out.append((buckets, pack(np.array([to]), np.array([int(np.maximum(sent, 1)[hit].sum()) * PIECE_BYTES]))))
        return _frame(out, "to")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        key, v = merged(pdf["block"])
        if pdf["to"].iloc[0] == buckets:
            return pd.DataFrame({"key": key, "shared": None, "size": v})
        order = np.lexsort((v, key))
        key, v = key[order], v[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (v[1:] != v[:-1])]
        key, v = key[new], v[new]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        return pd.DataFrame({"key": key[edge[:-1]], "shared": [v[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)], "size": pd.array([None] * (len(edge) - 1), "Int64")})

    sent = docs.select("key", "text").mapInArrow(lean(send), "bucket int, block binary").groupBy("bucket").applyInPandas(lean_group(answer), "to int, block binary")
    return stage(sent.groupBy("to").applyInPandas(lean_group(gather), "key long, shared binary, size long"), "shared-values")


# ---------------------------------------------------------------- 2: shards


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of a text in the order of the suffixes from there on: Larsson-Sadakane refinement.
    A place's rank is the number of the first of the suffixes that are tied with it so far."""
    n = len(text)
    key = loads(text, ">u8")
    sa = np.argsort(key, kind="stable").astype(np.int32)
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int32)
    start = np.flatnonzero(new)
    rank[sa] = np.repeat(start, np.diff(np.r_[start, n]))
    h = 8
    while True:
        tied = ~new | np.r_[~new[1:], False]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = sa[at]
        further = own + np.int32(h)
        second = np.where(further < n, rank[np.minimum(further, n - 1)], -1).astype(np.int64)
        first = rank[own].astype(np.int64)
        both = first * (n + 1) + second + 1
        order = np.argsort(both, kind="stable")
        sa[at] = own[order]
        both = both[order]
        fresh = np.r_[True, both[1:] != both[:-1]]
        new[at] = fresh
        starts = np.flatnonzero(fresh)
        rank[sa[at]] = np.repeat(at[starts], np.diff(np.r_[starts, len(at)]))
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, first: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Bytes, `most` at most, that each suffix in sa shares with the one before, for the suffixes at
    the first `count` places of each piece.  Kasai's walk: a piece's next suffix shares at least one byte
    less than the one before it; all pieces take each step together."""
    n = len(text)
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    word = loads(text)
    out = np.zeros(n, np.int16)
    got = np.zeros(len(first), np.int64)
    lanes = np.argsort(-count, kind="stable")
    sizes = count[lanes]
    for j in range(int(count.max()) if len(count) else 0):
        lane = lanes[: np.searchsorted(-sizes, -j, "left")]
        i = first[lane] + j
        r = place[i]
        other = sa[np.maximum(r - 1, 0)].astype(np.int64)
        have = np.maximum(got[lane] - 1, 0)
        have[r == 0] = 0
        live = np.flatnonzero(r > 0)
        while len(live):
            a, b = i[live] + have[live], other[live] + have[live]
            ok = (a < n) & (b < n)
            x = np.where(ok, word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)], U(1))
            low = x & (~x + U(1))
            same = np.where(x == 0, 8, (np.log2(np.maximum(low, U(1)).astype(float)).astype(np.int64)) // 8)
            have[live] = np.minimum(have[live] + same, most)
            live = live[(same == 8) & (have[live] < most)]
        got[lane] = have
        out[r] = have
    return out


def piece_hashes(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each of several pieces that lie one after another."""
    at = np.cumsum(size) - size
    w = mix((data.astype(U) + (np.arange(len(data)) - np.repeat(at, size)).astype(U) * U(256)) * _ODD[0])
    return mix(np.add.reduceat(w, at) + size.astype(U)), mix(np.add.reduceat(mix(w ^ _ODD[1]), at))


def _contents(sources: pd.Series, blocks: pd.Series) -> tuple:
    """Pieces of several blocks, equal ones once: numbers of strings, bytes, and occurrences in
    documents, which have a source, a number there and an id."""
    parts = [unpack(x) for x in blocks]
    strings = np.concatenate([p[0] for p in parts]).astype(np.int64)
    data = np.concatenate([p[1] for p in parts])
    a, b = piece_hashes(data, strings + LENGTH - 1)
    piece_base = np.cumsum([0, *(len(p[0]) for p in parts)])
    doc_base = np.cumsum([0, *(len(p[5]) for p in parts)])
    what = np.concatenate([p[2].astype(np.int64) + x for p, x in zip(parts, piece_base, strict=False)])
    of = np.concatenate([p[3].astype(np.int64) + x for p, x in zip(parts, doc_base, strict=False)])
    place = np.concatenate([p[4] for p in parts]).astype(np.int64)
    local, id_ = np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts])
    source = np.repeat(sources.to_numpy(), [len(p[5]) for p in parts])
    order = np.argsort(a)
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    code = np.empty(len(a), np.int64)
    code[order] = np.cumsum(new) - 1
    one = order[new]
    size = strings + LENGTH - 1
    start = np.cumsum(size) - size
    own = size[one]
    first = np.cumsum(own) - own
    data = data[np.repeat(start[one] - first, own) + np.arange(int(own.sum()))]
    return strings[one], data, code[what], of, place, source, local, id_


def _shard(sources: pd.Series, blocks: pd.Series, segments: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
    """Replies of covered places, and (for one shard of several) its strings for the other shards."""
    strings, data, what, of, place, source, local_, id_ = _contents(sources, blocks)
    n = len(strings)
    own = np.full(n, LAST)
    np.minimum.at(own, what, id_[of])
    later = id_[of] > own[what]
    done = [(of[later], place[later], place[later] + strings[what[later]] + LENGTH - 1)]
    # one more byte, which no UTF-8 text has, ends each piece
    size = strings + LENGTH - 1
    from_ = np.cumsum(size) - size
    first = from_ + np.arange(n)
    text = np.full(len(data) + n, 0xFF, np.uint8)
    text[np.repeat(first - from_, size) + np.arange(len(data))] = data
    sa = suffix_array(text)
    shared = common_prefixes(text, sa, first, strings, LENGTH)
    at = np.repeat(first, strings) + np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
    starts = np.zeros(len(text), bool)
    starts[at] = True
    piece = np.zeros(len(text), np.int32)
    piece[at] = np.repeat(np.arange(n, dtype=np.int32), strings)
    # in the order of suffixes, a run of neighbours with LENGTH common bytes is one string
    use = starts[sa]
    group = np.cumsum(~(use & (shared >= LENGTH))) - 1
    where = np.flatnonzero(use)
    g, p = group[where], piece[sa[where]]
    low = np.full(int(group[-1]) + 1, LAST)
    np.minimum.at(low, g, own[p])
    covered = low[g] < own[p]
    spans = np.stack([p[covered], sa[where][covered] - first[p[covered]]], 1) if covered.any() else np.zeros((0, 2), np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))].astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] != spans[:-1, 1] + 1)]) if len(spans) else np.zeros(0, np.int64)
    end = np.r_[cut[1:], len(spans)] - 1 if len(spans) else cut
    runs = (spans[cut, 0], spans[cut, 1], spans[end, 1] + LENGTH) if len(spans) else (cut, cut, cut)
    keep = np.flatnonzero(~later)
    order = keep[np.argsort(what[keep], kind="stable")]
    lo = np.searchsorted(what[order], runs[0], "left")
    hi = np.searchsorted(what[order], runs[0], "right")
    count = hi - lo
    occ = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))] if len(count) else order[:0]
    done.append((of[occ], place[occ] + np.repeat(runs[1], count), place[occ] + np.repeat(runs[2], count)))
    who, s, e = (np.concatenate(x) for x in zip(*done, strict=True))
    replies = _replies(source, local_, who, s, e)
    if segments <= 1:
        return replies, []
    # strings of this shard in order, each with its least id and its occurrences that are not covered yet
    head = where[np.r_[True, g[1:] != g[:-1]]]
    name = np.full((len(head), LENGTH + 1), 1, np.uint8)
    name[:, :LENGTH] = text[sa[head][:, None].astype(np.int64) + np.arange(LENGTH)]
    of_string = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
    low = low[g[np.r_[True, g[1:] != g[:-1]]]]
    open_ = np.flatnonzero(~covered)
    lo = np.searchsorted(what[order], p[open_], "left")
    count = np.searchsorted(what[order], p[open_], "right") - lo
    occ = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    string = np.repeat(of_string[open_], count)
    begin = place[occ] + np.repeat(sa[where][open_] - first[p[open_]], count)
    words = np.ascontiguousarray(name[:, :48]).view("<u8")
    segment = (mix(mix((words * stream_odd()).sum(axis=1, dtype=U)) + _ODD[1]) % U(segments)).astype(np.int64)
    sent = []
    for seg, rows in by_bucket(segment):
        here = np.zeros(len(head), bool)
        here[rows] = True
        sel = np.flatnonzero(here[string])
        names, local = np.unique(of[occ[sel]], return_inverse=True)
        number = np.cumsum(here) - 1
        sent.append((seg, pack(name[rows].ravel(), low[rows], number[string[sel]].astype(np.uint32), local.astype(np.uint32), begin[sel].astype(np.uint32), source[names], local_[names], id_[names])))
    return replies, sent


def stream_odd() -> np.ndarray:
    return np.array([_ODD[0], _ODD[1], _ODD[2], U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)], U)


def _merge(blocks: pd.Series) -> list[tuple[int, bytes]]:
    """Covered places of strings that several shards of one bucket have: the shards' sorted strings are
    merged, each with its least id, and every shard looks its own up by binary search."""
    shards = []
    for x in blocks:
        name, low, string, of, begin, source, local, id_ = unpack(x)
        shards.append((np.ascontiguousarray(name).view(f"S{LENGTH + 1}"), low, string.astype(np.int64), of.astype(np.int64), begin.astype(np.int64), source, local, id_))
    every = np.concatenate([s[0] for s in shards])
    order = np.argsort(every, kind="stable")
    every = every[order]
    start = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    least, every = np.minimum.reduceat(np.concatenate([s[1] for s in shards])[order], start), every[start]
    out = []
    for name, _, string, of, begin, source, local, id_ in shards:
        low = least[np.searchsorted(every, name)]
        covered = id_[of] > low[string]
        out += _replies(source, local, of[covered], begin[covered], begin[covered] + LENGTH)
    return out


def _piece_blocks(buckets: int):
    """Sends the pieces of shared values, and for each source the (id, tie) of its documents with the
    places that an earlier document of the same source covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("source", pa.int64()), ("block", pa.binary())])
        ids, ties, value, hash_a, hash_b, strings, of, place, data_ = ([] for _ in range(9))
        source, total = TaskContext.get().partitionId() << 24, 0

        def flush() -> pa.RecordBatch:
            id_, tie = np.concatenate(ids), np.concatenate(ties)
            v, a, h, n, o, p = (np.concatenate(x) for x in (value, hash_a, hash_b, strings, of, place))
            data = np.concatenate(data_)
            size = n + LENGTH - 1
            start = np.cumsum(size) - size
            order = np.argsort(a)
            new = np.r_[True, (a[order][1:] != a[order][:-1]) | (h[order][1:] != h[order][:-1])]
            group = np.cumsum(new) - 1
            low = np.minimum.reduceat(id_[o[order]], np.flatnonzero(new))[group]
            later = np.zeros(len(a), bool)
            later[order] = id_[o[order]] > low
            rows = [(None, source, pack(id_, tie, o[later].astype(np.uint32), p[later].astype(np.uint32), size[later].astype(np.uint32)))]
            code = np.empty(len(a), np.int64)
            code[order] = group
            one = order[new]
            goes = _bucket(v[one] >> U(2 * CHECK), buckets)
            number = np.empty(len(one), np.int64)
            first_hand = np.flatnonzero(~later)
            occurs = {k: first_hand[x] for k, x in by_bucket(goes[code[first_hand]])}
            for bucket, own in by_bucket(goes):
                pick = one[own]
                s = size[pick]
                first = np.cumsum(s) - s
                content = data[np.repeat(start[pick] - first, s) + np.arange(int(s.sum()))]
                number[own] = np.arange(len(own))
                occ = occurs[bucket]
                names, local = np.unique(o[occ], return_inverse=True)
                rows.append((bucket, source, pack(n[pick].astype(np.uint8), content, number[code[occ]].astype(np.uint32), local.astype(np.uint32), p[occ].astype(np.uint32), names.astype(np.uint32), id_[names])))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

        for b in batches:
            shared = b.column("shared")
            for lo, data, off in slices(b.column("text")):
                v, start, n, doc = pieces(data, off)
                first = np.searchsorted(doc, np.arange(len(off)))
                cut = (v >> U(2 * CHECK)).astype(np.uint16)
                hit = np.zeros(len(v), bool)
                for i in range(len(off) - 1):
                    own = np.frombuffer(shared[lo + i].as_buffer(), np.uint16)
                    x = cut[first[i] : first[i + 1]]
                    if len(x):
                        hit[first[i] : first[i + 1]] = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
                v, start, n, doc = v[hit], start[hit], n[hit], doc[hit]
                if not len(v):
                    continue
                base = sum(map(len, ids))
                ids.append(b.column("id").slice(lo, len(off) - 1).fill_null(LAST).to_numpy(zero_copy_only=False))
                ties.append(b.column("tie").slice(lo, len(off) - 1).to_numpy(zero_copy_only=False))
                s = n + LENGTH - 1
                at = np.cumsum(s) - s
                content = data[np.repeat(start - at, s) + np.arange(int(s.sum()))]
                a, b_ = piece_hashes(content, s)
                for held, x in zip((hash_a, hash_b, value, strings, of, place, data_), (a, b_, v, n, doc + base, start - off[doc], content), strict=True):
                    held.append(x)
                total += len(content)
                if total > SOURCE_BYTES:
                    yield flush()
                    ids, ties, value, hash_a, hash_b, strings, of, place, data_ = ([] for _ in range(9))
                    source, total = source + 1, 0
        if total:
            yield flush()

    return run


def covered_places(docs: DataFrame, buckets: int) -> DataFrame:
    """(id, tie, spans): packed starts and ends of the covered places of each document that has any."""
    told = shared_values(docs, buckets)
    values = joinable(told.filter("shared IS NOT NULL").select(F.col("key").alias("__key"), "shared"), "24 + octet_length(shared)")
    large = told.filter(F.col("size") > SHARD_BYTES).select(F.col("key").cast("int").alias("__b"), F.ceil(F.col("size") / SHARD_BYTES).cast("int").alias("shards"))
    there = docs.join(values, F.col("key") == F.col("__key")).select("id", "tie", "text", "shared")
    sent = there.mapInArrow(lean(_piece_blocks(buckets)), "bucket int, source long, block binary")
    # pieces lie on disk once, in the shuffle to their shards; a source's documents go along as a group of their own
    dealt = sent.join(joinable(large, "24"), F.col("bucket") == F.col("__b"), "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    shard_of = F.when(F.col("bucket").isNull(), F.col("source")).otherwise(F.pmod(F.xxhash64("block"), F.col("shards")))
    dealt = dealt.select("bucket", "shards", shard_of.alias("shard"), "source", "block")

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        if pd.isna(pdf["bucket"].iloc[0]):
            return pd.DataFrame({"source": pdf["source"], "bucket": pd.array([None] * len(pdf), "Int32"), "segment": pd.array([None] * len(pdf), "Int32"), "docs": True, "block": pdf["block"]})
        k = int(pdf["shards"].iloc[0])
        replies, strings = _shard(pdf["source"], pdf["block"], 1 if k == 1 else k * (SHARD_BYTES // SEGMENT_BYTES + 1) * 4)
        rows = [(to, None, None, x) for to, x in replies] + [(None, int(pdf["bucket"].iloc[0]), seg, x) for seg, x in strings]
        return pd.DataFrame({"source": pd.array([r[0] for r in rows], "Int64"), "bucket": pd.array([r[1] for r in rows], "Int32"), "segment": pd.array([r[2] for r in rows], "Int32"), "docs": False, "block": [r[3] for r in rows]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_merge(pdf["block"]), columns=["source", "block"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["docs"].to_numpy(bool)
        id_, tie, of, s, n = unpack(pdf["block"][own].iloc[0])
        if not own.all():
            of, s, n = (np.concatenate(x) for x in zip((of, s, n), merged(pdf["block"][~own]), strict=True))
        order = np.lexsort((s, of))
        of, s = of[order], s[order].astype(np.int64)
        e = s + n[order]
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
        rows = []
        for lo, hi in zip(edge, edge[1:], strict=False):
            start, end = s[lo:hi], np.maximum.accumulate(e[lo:hi])
            new = np.r_[True, start[1:] > end[:-1]]
            rows.append((int(id_[of[lo]]), int(tie[of[lo]]), pack(start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]])))
        return pd.DataFrame(rows, columns=["id", "tie", "spans"])

    found = stage(dealt.groupBy("bucket", "shard").applyInPandas(lean_group(shard), "source long, bucket int, segment int, docs boolean, block binary"), "covered")
    merged_ = found.filter("segment IS NOT NULL").groupBy("bucket", "segment").applyInPandas(lean_group(merge), "source long, block binary")
    replies = found.filter("source IS NOT NULL").select("source", "block", "docs").unionByName(merged_.withColumn("docs", F.lit(False)))
    spans = replies.groupBy("source").applyInPandas(lean_group(gather), "id long, tie long, spans binary")
    return stage(spans.groupBy("id", "tie").agg(F.first("spans").alias("spans")), "covered-places")  # repeated rows are covered alike


def drop_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept has the bytes left."""
    rows = _texts(docs, doc_id, text)
    buckets = max(4, -(-text_bytes(docs, text) // BUCKET_BYTES))
    with shuffles_dropped(docs.sparkSession):
        places = covered_places(rows, buckets)
    spans = joinable(places.withColumnsRenamed({"id": "__id", "tie": "__tie"}), "48 + octet_length(spans)")
    both = rows.join(spans, (F.coalesce("id", F.lit(LAST)) == F.col("__id")) & (rows["tie"] == F.col("__tie")), "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, data, off in slices(b.column("text")):
                n = len(off) - 1
                kept, removed, count = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
                for i in range(n):
                    own = data[off[i] : off[i + 1]]
                    x = b.column("spans")[lo + i]
                    if x.is_valid:
                        s, e = unpack(x.as_py())
                        edge = np.zeros(len(own) + 1, np.int64)
                        edge[s], edge[e] = 1, -1
                        keep = np.cumsum(edge[:-1]) == 0
                        removed[i], count[i] = len(own) - int(keep.sum()), len(s)
                        own = own[keep]
                    kept.append(own.tobytes())
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("id").slice(lo, n), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(removed), "n_spans": pa.array(count), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]), "kept": pa.array(kept, pa.binary())})

    return both.mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
