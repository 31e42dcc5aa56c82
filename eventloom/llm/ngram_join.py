"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct shingles (hashed to 64 bits).  Sets of equal content form a class,
and all that follows works on classes.  Sizes are cut in bands so that sets similar enough lie in
one band or in two neighbouring ones; for such a pair the number of differing shingles has a bound
k.  The shingle domain is cut in n1 parts and each part in n2 sub-parts, and the signatures are the
set's projections on every choice of n2 - k2 sub-parts of a part: as the differences cannot spoil
more than k2 sub-parts in every part, a linked pair has a signature in common.  The numbers are
chosen for each band so that few signatures suffice (_plan).  At least ``spare`` + 1 parts agree, so
a set with at most ``spare`` parts that could be empty needs no signatures of nothing; any other set
has them too.  Shingles that a sample shows to be common take no part in signatures, which can only
bring sets closer: the sample changes cost, never the result.

Classes with a common signature form a group.  Before anything is closed transitively, a group's pairs
are held against each other by parity sketches: a class's sketch has a bit for the parity of its
shingles in each of about twice as many bins as it has shingles, so two sketches differ in no more
bits than the sets differ in shingles, and a linked pair always passes; nearly all other pairs that a
weak signature brought together fail.  Groups over GROUP classes are tied in a row instead, unseen.
The ties' connected components are candidate clusters, and these are verified exactly: a set is
compared with its cluster's others through an inverted index until no two sets of different
components are left uncompared.  Clusters over CLUSTER_SHINGLES are cut in blocks: first each block is
verified with some pivots of the cluster, then only the sets left outside the cluster's largest
component go to all its blocks.

Cases: with fewer words than a shingle the whole sequence is one shingle; a text without words, or a
null one, has an empty set and is linked with nothing; rows of equal text are one class; null ids
have no say in the smallest id of a component; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .flat import LOWER, U, hashes, mix, slices, windows, words
from .shared import binary_rows, by_bucket, joinable, lean, lean_group, pack, stage, text_bytes, unpack

SHINGLE, PERCENT = 5, 80
#: Text whose signatures, or shingles in clusters, meet in one task.
BUCKET_BYTES, CLUSTER_SHINGLES = 8 << 20, 500_000
#: Classes of a group whose pairs are held against each other in one task, and pivots of a cut cluster.
GROUP, PIVOTS = 1024, 8
#: Signatures that a task collects before it writes blocks.
FLUSH = 1_000_000
SAMPLE_EVERY, COMMON_SHARE = 32, 0.004
SLICE = 2 << 20
_ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles in ascending order."""
    starts, ends, doc = words(data, off)
    h = hashes(LOWER[data], starts, ends)
    n = np.bincount(doc, minlength=len(off) - 1)
    got, at = windows(h, doc, k)
    hs, ds = [got], [doc[at]]
    for j in range(1, k):
        few = n[doc] == j
        short, at = windows(h[few], doc[few], j)
        hs.append(mix(short + U(j)))
        ds.append(doc[few][at])
    hs, ds = np.concatenate(hs), np.concatenate(ds)
    order = np.lexsort((hs, ds))
    hs, ds = hs[order], ds[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])] if len(hs) else np.zeros(0, bool)
    hs, ds = hs[new], ds[new]
    return hs, np.searchsorted(ds, np.arange(len(off)))


def _sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each segment of h, where segments may be empty."""
    total = np.zeros(len(first) - 1, U)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        total[full] = np.add.reduceat(h, first[full])
    return total


def class_keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set's content, from two sums of mixed hashes and the size."""
    a, b = _sums(mix(h ^ _ODD[1]), off), _sums(mix(h ^ _ODD[2]), off)
    return mix(mix(a) ^ (b * _ODD[0]) + np.diff(off).astype(U)).view(np.int64)


@cache
def bands(percent: int) -> np.ndarray:
    """Lower ends of the size bands."""
    ends = [1]
    while ends[-1] < 1 << 34:
        ends.append(ends[-1] * 100 // percent + 1)
    return np.array(ends)


def _differences(top: int, percent: int) -> int:
    """The most shingles in which a linked pair may differ, the smaller set having `top` at most."""
    return (top + top * 100 // percent) * (100 - percent) // (100 + percent)


@cache
def _plan(band: int, percent: int) -> tuple[int, int, int, int] | None:
    """(n1, n2, k2, spare) for pairs whose smaller set lies in the band; None if only equal sets link."""
    low, top = int(bands(percent)[band]), int(bands(percent)[band + 1]) - 1
    k = _differences(top, percent)
    if k == 0:
        return None
    best = None
    for k2 in range(min(k, 5) + 1):
        for n2 in range(k2 + 1, k2 + 5):
            ways = math.comb(n2, k2)
            least = -(-(k + 1) // (k2 + 1))
            for spare in (*range(12), *range(12, 60, 4)):
                n1 = least + spare
                features = low * 0.9 * (n2 - k2) / (n2 * n1)
                low_parts = n1 * min(1.0, ways * math.exp(-features))
                tail = 1 - sum(math.exp(-low_parts) * low_parts**i / math.factorial(i) for i in range(spare + 1))
                cost = n1 * ways * (1 + 1e4 * max(0.0, tail - 1e-5))
                if best is None or cost < best[0]:
                    best = (cost, n1, n2, k2, spare)
    return best[1:]


def signatures(h: np.ndarray, off: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of sets, by the plan of each set's own band and of the one below."""
    size = np.diff(off)
    band = np.searchsorted(bands(percent), size, "right") - 1
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rare = common[at] != h
        keep = np.r_[0, np.cumsum(rare)]
        h, off = h[rare], keep[off]
    sigs, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    value = mix(h ^ _ODD[3])
    left = np.diff(off)
    for tag in np.unique(np.concatenate([band[size > 0], band[size > 0] - 1])).tolist():
        plan = _plan(tag, percent) if tag >= 0 else None
        if plan is None:
            continue
        n1, n2, k2, spare = plan
        own = np.flatnonzero((size > 0) & ((band == tag) | (band == tag + 1)))
        slots = n1 * n2
        at = np.repeat(off[own], left[own]) + np.arange(int(left[own].sum())) - np.repeat(np.cumsum(left[own]) - left[own], left[own])
        slot = (((h[at] >> U(32)) * U(slots)) >> U(32)).astype(np.int64) + np.repeat(np.arange(len(own)), left[own]) * slots
        edges = np.searchsorted(slot, np.arange(len(own) * slots + 1))
        total = _sums(value[at], edges).reshape(len(own), n1, n2)
        count = np.diff(edges).reshape(len(own), n1, n2)
        got, empty = [], []
        for c, pick in enumerate(combinations(range(n2), n2 - k2)):
            base = mix(np.arange(n1, dtype=U) + U(tag << 40 | c << 24))
            s = np.broadcast_to(base, (len(own), n1)).copy()
            for j in pick:
                s += total[:, :, j] * _ODD[j]
            got.append(mix(s))
            empty.append(count[:, :, list(pick)].sum(axis=2) == 0)
        got, empty = np.stack(got, 2), np.stack(empty, 2)
        full = empty.any(axis=2).sum(axis=1) > spare
        use = ~empty | full[:, None, None]
        sigs.append(got[use])
        owners.append(np.broadcast_to(own[:, None, None], got.shape)[use])
    return np.concatenate(sigs), np.concatenate(owners)


def _common_shingles(docs: DataFrame, text: str, k: int) -> Broadcast:
    """Sorted hashes of shingles in over COMMON_SHARE of a sample of texts: under len(text) / COMMON_SHARE."""
    sample = docs.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE_EVERY)) == 0).select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, off in slices(b.column("text"), SLICE):
                h, n = np.unique(shingle_sets(data, off, k)[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64()), "docs": pa.array(np.full(len(h), 0), pa.int64())})

    least = max(3, int(sample.count() * COMMON_SHARE))
    got = sample.mapInArrow(lean(run), "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h").toArrow()
    return docs.sparkSession.sparkContext.broadcast(np.sort(got.column("h").to_numpy().view(U)))


def _signature_blocks(docs: DataFrame, text: str, k: int, percent: int, buckets: int, common: Broadcast) -> DataFrame:
    """(bucket, block): packed signatures with the classes that have them."""

    def blocks(sig: list[np.ndarray], key: list[np.ndarray]) -> pa.RecordBatch:
        sig, key = np.concatenate(sig), np.concatenate(key)
        out_b, out_d = [], []
        order = np.argsort(sig)
        sig, key = sig[order], key[order]
        for b, rows in by_bucket((((sig >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)):
            names, at = np.unique(key[rows], return_inverse=True)
            out_b.append(b)
            out_d.append(pack(sig[rows] & ~U((1 << 20) - 1), at.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32).astype(np.uint32), names))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(out_b, pa.int32()), "block": pa.array(out_d, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, key, n, seen = [], [], 0, np.zeros(0, np.int64)
        for batch in batches:
            for _, data, off in slices(batch.column("text"), SLICE):
                h, at = shingle_sets(data, off, k)
                names = class_keys(h, at)
                _, first = np.unique(names, return_index=True)
                first = np.sort(first)
                first = first[~np.isin(names[first], seen) & (np.diff(at)[first] > 0)]
                size = np.diff(at)[first]
                pick = np.repeat(at[first], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                s, o = signatures(h[pick], np.r_[0, np.cumsum(size)], percent, common.value)
                seen = np.concatenate([seen, names[first]])[-200_000:]
                sig.append(s)
                key.append(names[first][o])
                n += len(s)
                if n >= FLUSH:
                    yield blocks(sig, key)
                    sig, key, n = [], [], 0
        if n:
            yield blocks(sig, key)

    return docs.select(F.col(text).alias("text")).mapInArrow(lean(run), "bucket int, block binary")


def sketches(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): each set's parity sketch, of 64 << level bits (see sketch_level)."""
    size = np.diff(off)
    words = np.int64(1) << sketch_level(size)
    edge = np.r_[0, np.cumsum(words)]
    owner = np.repeat(np.arange(len(size)), size)
    place = mix(h ^ _ODD[4]) >> (U(64) - (sketch_level(size) + 6).astype(U))[owner]
    at = edge[owner] * 64 + place.astype(np.int64)
    odd = np.zeros(int(edge[-1]) * 64, np.uint8)
    np.add.at(odd, at, 1)
    return np.packbits(odd & 1, bitorder="little").view("<u8"), edge


def sketch_level(size: np.ndarray) -> np.ndarray:
    """log2 of the words of a sketch: two to four bits for each shingle, 256 bits at least."""
    return np.maximum(2, np.ceil(np.log2(np.maximum(size, 1) / 32)).astype(np.int64))


def _groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distinct groups of classes that share a signature of one bucket; large ones as ties in a row."""
    parts, base, names = [], 0, []
    for block in pdf["block"]:
        sig, at, own = unpack(block)
        parts.append((sig, at.astype(np.int64) + base))
        names.append(own)
        base += len(own)
    key, code = np.unique(np.concatenate(names), return_inverse=True)
    sig = np.concatenate([s for s, _ in parts])
    who = code[np.concatenate([a for _, a in parts])]
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    new = np.r_[True, sig[1:] != sig[:-1]]
    one = new | np.r_[True, who[1:] != who[:-1]]
    sig, who = sig[one], who[one]
    first = np.flatnonzero(new[one])
    count = np.diff(np.r_[first, len(sig)])
    first, count = first[count > 1], count[count > 1]
    name = mix(key.view(U) + _ODD[5])
    total = np.r_[U(0), np.cumsum(name[who], dtype=U)]
    _, pick = np.unique(mix(total[first + count] - total[first]) + count.astype(U), return_index=True)
    first, count = first[pick], count[pick]
    a, b, members = [], [], []
    for lo, n in zip(first.tolist(), count.tolist(), strict=True):
        own = key[who[lo : lo + n]]
        if n > GROUP:
            a.append(own[1:])
            b.append(own[:-1])
        else:
            members.append(own)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    none = [None] * len(members)
    return pd.DataFrame({"members": pd.Series([*members, *[None] * len(a)], dtype=object), "a": pd.array([*none, *a.tolist()], "Int64"), "b": pd.array([*none, *b.tolist()], "Int64")})


class Forest:
    """Union-find over 0 .. n-1, for many pairs at once; the root is the smallest of its tree."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x, y = self.up[x], self.up[y]
            apart = x != y
            x, y = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
            np.minimum.at(self.up, x, y)
            self.flatten()

    def flatten(self) -> None:
        while not np.array_equal(nxt := self.up[self.up], self.up):
            self.up = nxt


def compatible(size: np.ndarray, words: np.ndarray, edge: np.ndarray, percent: int):
    """A function of two arrays of set numbers: whether sizes and sketches allow each pair a link."""
    level = sketch_level(size)
    rows, where = {}, {}
    for low in np.unique(level).tolist():
        own, above = np.flatnonzero(level == low), np.flatnonzero(level == low + 1)
        flat = words[edge[own][:, None] + np.arange(1 << low)]
        twice = words[edge[above][:, None] + np.arange(2 << low)]
        rows[low] = np.concatenate([flat, _halved(twice)])
        where[low] = np.full(len(size), -1)
        where[low][np.r_[own, above]] = np.arange(len(own) + len(above))

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
        most = (size[x] + size[y]) * (100 - percent) // (100 + percent)
        low = np.minimum(level[x], level[y])
        near = np.maximum(level[x], level[y]) <= low + 1  # others cannot be told apart here and pass
        for k in np.unique(low[ok & near]).tolist():
            use = np.flatnonzero(ok & near & (low == k))
            for part in np.array_split(use, -(-len(use) << k >> 20) or 1):
                differ = np.bitwise_count(rows[k][where[k][x[part]]] ^ rows[k][where[k][y[part]]]).sum(axis=1, dtype=np.int64)
                ok[part] = differ <= most[part]
        return ok

    return test


def _halved(sketch: np.ndarray) -> np.ndarray:
    """Sketches of half as many bits: a bin and its neighbour become one."""
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1, bitorder="little").view("<u8") if len(sketch) else sketch[:, ::2]


def _held(percent: int):
    """Ties, as a spanning forest, between the classes of groups whose sketches allow a link."""

    def run(groups: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        if not len(groups):
            return pd.DataFrame({"a": [], "b": []})
        classes = classes.sort_values("c")
        key = classes["c"].to_numpy()
        words = [np.frombuffer(x, "<u8") for x in classes["sketch"]]
        test = compatible(classes["n"].to_numpy(), np.concatenate(words), np.r_[0, np.cumsum([len(w) for w in words])], percent)
        count = np.array([len(x) for x in groups["members"]])
        member = np.searchsorted(key, np.concatenate(groups["members"].tolist()))
        rest = np.repeat(np.cumsum(count), count) - np.arange(len(member)) - 1
        forest = Forest(len(key))
        live = np.arange(len(member))
        for lag in range(1, int(count.max())):
            live = live[rest[live] >= lag]
            x, y = member[live], member[live + lag]
            apart = forest.up[x] != forest.up[y]
            x, y = x[apart], y[apart]
            ok = test(x, y)
            if ok.any():
                forest.join(x[ok], y[ok])
        move = np.flatnonzero(forest.up != np.arange(len(key)))
        return pd.DataFrame({"a": key[move], "b": key[forest.up[move]]})

    return run


def exact_components(h: np.ndarray, off: np.ndarray, percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of a set of its component, comparing sets exactly; `known` are such
    numbers found before.

    Sets outside the largest component are compared with all others; what is in the largest one has
    then met every set outside it."""
    m = len(off) - 1
    size = np.diff(off)
    _, term = np.unique(h, return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(term, kind="stable")
    posting = owner[order]
    start = np.searchsorted(term[order], np.arange(int(term.max()) + 2 if len(term) else 1))
    label = np.arange(m) if known is None else known.copy()
    done = np.zeros(m, bool)
    while True:
        main = int(np.argmax(np.bincount(label, minlength=m)))
        rest = np.flatnonzero(~done & (label != main))
        if not len(rest):
            return label
        x = int(rest[0])
        done[x] = True
        own = term[off[x] : off[x + 1]]
        n = start[own + 1] - start[own]
        where = np.repeat(start[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(posting[where], minlength=m)
        hit = np.flatnonzero(100 * both >= percent * (size + size[x] - both))
        old = np.unique(label[hit])
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]


def _verify(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pdf = pdf.drop_duplicates(["cluster", "c"]).sort_values("cluster", kind="stable")
        name, key, before = pdf["cluster"].to_numpy(), pdf["c"].to_numpy(), pdf["found"].to_numpy()
        sets = [np.frombuffer(x, U) for x in pdf["shingles"]]
        cuts = np.r_[np.flatnonzero(np.r_[True, name[1:] != name[:-1]]), len(name)].tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = sets[lo:hi]
            _, first, code = np.unique(before[lo:hi], return_index=True, return_inverse=True)
            root = exact_components(np.concatenate(own), np.r_[0, np.cumsum([len(s) for s in own])], percent, first[code])
            move = root != first[code]
            a.append(before[lo:hi][move])
            b.append(before[lo:hi][root[move]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def _described(docs: DataFrame, doc_id: str, text: str, k: int, sets: bool) -> DataFrame:
    """(id, tie, c, n, sketch or shingles) of every row; tie is the text's hash."""
    last = "shingles" if sets else "sketch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, data, off in slices(b.column("text"), SLICE):
                h, at = shingle_sets(data, off, k)
                out = {"id": b.column("id").slice(lo, len(off) - 1), "tie": b.column("tie").slice(lo, len(off) - 1), "c": pa.array(class_keys(h, at)), "n": pa.array(np.diff(at), pa.int64())}
                values, edge = (h, at) if sets else sketches(h, at)
                yield pa.RecordBatch.from_pydict(out | {last: binary_rows(values, edge)})

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), f"id long, tie long, c long, n long, {last} binary")


def _ties(docs: DataFrame, classes: DataFrame, text: str, k: int, percent: int, tasks: int) -> DataFrame:
    """(a, b): pairs of class keys whose components hold every linked pair."""
    blocks = _signature_blocks(docs, text, k, percent, tasks, _common_shingles(docs, text, k))
    found = stage(blocks.groupBy("bucket").applyInPandas(lean_group(_groups), "members array<long>, a long, b long"), "groups")
    groups = found.filter("members IS NOT NULL").select("members").distinct()
    groups = stage(groups.select(F.pmod(F.xxhash64(F.col("members")[0]), F.lit(tasks)).cast("int").alias("task"), "members"), "groups")
    need = groups.select("task", F.explode("members").alias("c")).distinct().join(classes.select("c", "n", "sketch"), "c")
    held = groups.groupBy("task").cogroup(need.withColumnRenamed("task", "to").groupBy("to")).applyInPandas(lean_group(_held(percent)), "a long, b long")
    return stage(held.unionByName(found.filter("a IS NOT NULL").select("a", "b")), "ties")


def linked_classes(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """(node, component) over the class keys that have a link to another class."""
    tasks = max(4, -(-text_bytes(docs, text) // BUCKET_BYTES))
    cluster = components(_ties(docs, classes, text, k, percent, tasks)).withColumnsRenamed({"node": "c", "component": "cluster"})
    members = stage(cluster.join(classes.select("c", "n", "rep"), "c"), "members")
    chosen = joinable(members.select(F.col("rep.id").alias("__id"), F.col("rep.tie").alias("__tie")).distinct(), "24")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = rows.join(chosen, F.col("id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tie")), "left_semi")
    sets = stage(_described(texts, "id", "text", k, True).select("c", "shingles"), "sets")
    pivot = [F.min(F.struct(F.xxhash64("c", F.lit(j)), "c"))["c"] for j in range(PIVOTS)]
    total = members.groupBy("cluster").agg(F.sum("n").alias("all"), F.array(*pivot).alias("pivots"))
    parts = F.ceil(F.col("all") / CLUSTER_SHINGLES).cast("int")
    cut = members.join(total, "cluster").select("c", "cluster", parts.alias("parts"), F.pmod(F.xxhash64("c"), parts).cast("int").alias("own"), F.array_contains("pivots", F.col("c")).alias("pivot"))
    cut = stage(cut, "members")

    def verified(rows: DataFrame, everywhere: Column) -> DataFrame:
        goes = F.when(everywhere & (F.col("parts") > 1), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
        dealt = rows.select("c", "found", "cluster", "parts", F.explode(goes).alias("block"))
        small = F.pmod(F.xxhash64("cluster"), F.lit(tasks))
        dealt = dealt.select("c", "found", F.xxhash64("cluster", "block").alias("cluster"), F.when(F.col("parts") == 1, small).otherwise(F.xxhash64("cluster", "block")).alias("task"))
        return sets.join(dealt, "c").groupBy("task").applyInPandas(lean_group(_verify(percent)), "a long, b long")

    links = stage(verified(cut.withColumn("found", F.col("c")), F.col("pivot")), "links")
    linked = components(links)
    large = cut.filter("parts > 1").join(linked, F.col("c") == F.col("node"), "left").select("c", F.coalesce("component", "c").alias("found"), "cluster", "parts", "own")
    large = stage(large, "large-clusters")
    main = large.groupBy("cluster", "found").count().groupBy("cluster").agg(F.max(F.struct("count", "found"))["found"].alias("main"))
    large = stage(large.join(main, "cluster").withColumn("rest", F.col("found") != F.col("main")), "large-clusters")
    if large.filter("rest").isEmpty():
        return linked
    open_ = large.join(large.filter("rest").select("cluster").distinct(), "cluster", "left_semi")
    return components(stage(links.unionByName(verified(open_, F.col("rest"))), "links"))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, tie, c, n_shingles, component_id, first) for each row: c is the key of the set's class, tie
    the text's hash, and first tells the class that has the component's smallest id; null ids come last."""
    described = stage(_described(docs, doc_id, text, k, False), "sets")
    classes = described.groupBy("c").agg(F.min(F.struct("id", "tie")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    found = linked_classes(docs, stage(classes, "classes"), doc_id, text, k, percent)
    least = described.filter("n > 0").groupBy("c").agg(F.min("id").alias("least"))
    of = least.join(found, F.col("c") == F.col("node"), "left").select("c", "least", F.coalesce("component", "c").alias("component"))
    low = of.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "c")).alias("low"))
    named = stage(of.join(low, "component").select("c", F.col("low.least").alias("component_id"), (F.col("c") == F.col("low.c")).alias("first")), "components")
    both = described.join(named, "c", "left")
    return both.select("id", "tie", "c", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "first")
