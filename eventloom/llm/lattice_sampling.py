"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

The lattice of a text has a place before each character and an arc for each piece of the vocabulary
that matches there (a character without a piece has one arc that stands for its byte pieces).  A
segmentation's probability is the product of its pieces' over the sum of all segmentations'.  Top-k
sampling without replacement perturbs every segmentation's log probability with Gumbel noise and takes
the k greatest.  As in A-star search, a hypothesis is a set of segmentations with a common prefix, its
mass is exact (sums over what follows are known from a backward pass), and so is the distribution of
the greatest perturbed value in it: hypotheses are expanded best first.  Expanding one draws its best
segmentation arc by arc, and leaves at each arc the hypothesis of the siblings, whose greatest value
is a Gumbel truncated at their parent's.  A segmentation's inclusion score, 1 - exp(-exp(log p - v)),
is the chance that its perturbed value passes v, the greatest one not taken.

Pieces never span the start of a word (a space after something else) or a line end, so a text's
lattice is a chain of its words' lattices, which are built once for each distinct word of a slice of
texts, and kept where a task meets a word in several slices (Kept); all that is drawn is drawn for all texts of the slice together.  Noise comes from a hash of
seed, row key and place: it does not depend on partitions or on retries.

Piece probabilities: a vocabulary of merge ranks gives piece of rank r the weight 1 / (r + 2.7)
(Zipf); one that has log probabilities is used as it is.  `sharpness` multiplies log probabilities.
Bytes have the least weight.  Spaces are the vocabulary's space marks, and one is put before a text.

Cases: null and empty texts have one segmentation, without pieces, of score 1; a text with fewer
than k segmentations gives those it has; rows of one key and one text are drawn alike; a null key
is a key of its own; any bytes are encoded, and decoding gives back the text exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import U, hashes, mix, slices
from .shared import lean

SAMPLES, SEED, SLICE = 2, 20, 1 << 19
#: Bytes of words whose lattices a task keeps, and hashes of words that it remembers.
KEPT_BYTES, SEEN_WORDS = 250_000, 2_000_000
#: Pieces decoded at a time.
DECODED = 1 << 20
SAMPLE = "sample int, n_tokens int, log_prob double, perturbed double, inclusion double, round_trip boolean, ids array<int>"
_ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)]


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of several runs, one after another."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))


class Vocabulary:
    """Pieces as bytes with log weights, and a tree of their prefixes: its edges (node << 8 | byte) lie in
    an open hash table, at the first free slot from their own on."""

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes[i] = bytes([value])
        score = np.array([sp.get_score(i) for i in usable])
        if (score == np.rint(score)).all():  # merge ranks
            rank = np.empty(len(score))
            rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
            score = -np.log(rank + 2.7)
        score = sharpness * (score - np.log(np.exp(score).sum()))
        self.byte_score = float(score.min())
        node, edge = {b"": 0}, {}
        piece_of: list[tuple[int, float]] = [(-1, 0.0)]
        for i, s in zip(usable, score.tolist(), strict=True):
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            self.bytes[i] = piece
            inner = piece.lstrip(b" ")
            if b" " in inner or b"\n" in piece or not piece:
                continue  # would cross a border between words: never used
            for k in range(1, len(piece) + 1):
                if piece[:k] not in node:
                    node[piece[:k]] = len(piece_of)
                    edge[node[piece[: k - 1]] << 8 | piece[k - 1]] = len(piece_of)
                    piece_of.append((-1, 0.0))
            piece_of[node[piece]] = (i, s)
        self.node_ids = np.array([i for i, _ in piece_of], np.int32)
        self.node_score = np.array([s for _, s in piece_of])
        self.depth = np.array([len(p) for p in node])
        self.shift = U(64 - max(4, (8 * len(edge)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.edge, self.into = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
        keys = np.array(list(edge), np.int64)
        for key, slot, to in zip(keys.tolist(), self._slot(keys).tolist(), edge.values(), strict=True):
            while self.edge[slot] >= 0:
                slot = (slot + 1) % slots
            self.edge[slot], self.into[slot] = key, to
        self.size = np.array([len(b) for b in self.bytes])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    @property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length the nodes, and ids (-1: only the beginning of pieces) and log weights there."""
        at = [np.flatnonzero(self.depth == k) for k in range(1, int(self.depth.max()) + 1)]
        return [(x, self.node_ids[x], self.node_score[x]) for x in at]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(U) * _ODD[0] >> self.shift).astype(np.int64)

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node below each node by its byte, 0 if there is none."""
        key = node.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        there = self.edge[slot]
        out = np.where(there == key, self.into[slot], 0)
        far = np.flatnonzero((there != key) & (there >= 0))
        while len(far):
            slot[far] = (slot[far] + 1) % len(self.edge)
            there = self.edge[slot[far]]
            hit = there == key[far]
            out[far[hit]] = self.into[slot[far[hit]]]
            far = far[~hit & (there >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of pieces, one after another (with the space put before a text)."""
        return self.flat[_gather(self.start[ids], self.size[ids])]


class Lattice:
    """The arcs of distinct words, by the place they leave: their bytes lie one after another in data."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = len(data)
        end = np.repeat(ends, ends - starts)
        letter = (data & 0xC0) != 0x80
        place = live = np.flatnonzero(letter)
        follow = np.r_[place[1:], n] if n else place
        width = np.zeros(n, np.int64)
        width[place] = np.minimum(follow, end[place] if n else follow) - place
        single = np.zeros(n, bool)
        arcs_of = np.zeros(n + 1, np.int64)
        at, size, ids, score, rank, k = [], [], [], [], [], 0
        node = np.zeros(len(live), np.int32)
        while len(live):
            k += 1
            fits = np.flatnonzero(live + k <= end[live])
            live = live[fits]
            node = vocabulary.follow(node[fits], data[live + k - 1])
            hit = np.flatnonzero(node)
            live, node = live[hit], node[hit]
            found = vocabulary.node_ids[node]
            whole = np.flatnonzero(found >= 0)
            here = live[whole]
            at.append(here)
            size.append(np.full(len(here), k))
            ids.append(found[whole])
            score.append(vocabulary.node_score[node[whole]])
            rank.append(arcs_of[here])
            arcs_of[here] += 1
            single[here[width[here] == k]] = True
        lone = place[~single[place]]
        at.append(lone)
        size.append(width[lone])
        ids.append(np.full(len(lone), -1, np.int32))
        score.append(width[lone] * vocabulary.byte_score)
        rank.append(arcs_of[lone])
        arcs_of[lone] += 1
        self.first = np.cumsum(arcs_of) - arcs_of
        at, size, ids, score, rank = (np.concatenate(x) for x in (at, size, ids, score, rank))
        to = self.first[at] + rank
        order = np.empty(len(at), np.int64)
        order[to] = np.arange(len(at))
        self.at, self.size, self.ids, score = at[order], size[order], ids[order], score[order]
        del at, size, ids, rank, to, order  # a lattice has many arcs
        self.end, self.data = end, data
        # backward sums, all places of equal distance from their word's end at once
        total = np.zeros(n + 1)
        far = (end - np.arange(n))[place] if n else place
        most = int(far.max()) if len(far) else 0
        by = np.argsort(far.astype(np.uint16) if most < 1 << 16 else far, kind="stable")
        cuts = np.searchsorted(far[by], np.arange(1, most + 2))
        own = place[by]
        count = arcs_of[own]
        edge = np.r_[0, np.cumsum(count)]
        arcs = _gather(self.first[own], count)
        to = (self.at + self.size)[arcs]
        to[to == end[self.at[arcs]]] = n  # its sum stays 0
        part = score[arcs]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if lo == hi:
                continue
            a, b = int(edge[lo]), int(edge[hi])
            part[a:b] += total[to[a:b]]
            top = np.maximum.reduceat(part[a:b], edge[lo:hi] - a)
            total[own[lo:hi]] = top + np.log(np.add.reduceat(np.exp(part[a:b] - np.repeat(top, count[lo:hi])), edge[lo:hi] - a))
        value = np.empty(len(part))
        value[arcs] = part
        del arcs, to, part, score
        # the likeliest arc of a place comes first: drawing seldom looks further
        log_q = np.minimum(value - total[self.at], 0.0)
        q = np.exp(log_q)
        order = np.argsort(self.at - 0.5 * q)
        self.size, self.ids, self.log_q, self.q = self.size[order], self.ids[order], log_q[order], q[order]
        self.upto = self.q.copy()  # summed place by place: no rounding depends on other words
        start, count, rank = self.first[:-1], np.diff(self.first), 1
        while len(start):
            start, count = start[count > rank], count[count > rank]
            self.upto[start + rank] += self.upto[start + rank - 1]
            rank += 1

    def part(self, starts: np.ndarray, sizes: np.ndarray) -> Lattice:
        """The lattice of some of the words alone."""
        out = object.__new__(Lattice)
        places = _gather(starts, sizes)
        count = self.first[places + 1] - self.first[places]
        arcs = _gather(self.first[places], count)
        out.at = np.repeat(np.arange(len(places)), count)
        out.first = np.r_[0, np.cumsum(count)]
        to = np.cumsum(sizes)
        out.end, out.data = np.repeat(to, sizes), self.data[places]
        out.size, out.ids, out.log_q, out.q, out.upto = (x[arcs] for x in (self.size, self.ids, self.log_q, self.q, self.upto))
        return out

    def and_(self, other: Lattice) -> Lattice:
        """Both lattices, the other's words after this one's."""
        out = object.__new__(Lattice)
        n = len(self.data)
        out.at, out.end = np.r_[self.at, other.at + n], np.r_[self.end, other.end + n]
        out.first = np.r_[self.first[:-1], other.first + len(self.at)]
        for name in ("data", "size", "ids", "log_q", "q", "upto"):
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        return out

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc from each place, by its probability."""
        arc, last = self.first[place], self.first[place + 1] - 1
        live = np.flatnonzero((u >= self.upto[arc]) & (arc < last))
        while len(live):
            arc[live] += 1
            live = live[(u[live] >= self.upto[arc[live]]) & (arc[live] < last[live])]
        return arc

    def tokens(self, arcs: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of arcs, and the number of pieces of each (bytes for characters without a piece)."""
        raw = self.ids[arcs] < 0
        count = np.where(raw, self.size[arcs], 1)
        out = np.repeat(self.ids[arcs], count)
        where = _gather(self.at[arcs[raw]], self.size[arcs[raw]])
        out[np.repeat(raw, count)] = vocabulary.byte_ids[self.data[where]]
        return out, count


class Kept:
    """Lattices of words met in two slices or more, KEPT_BYTES of them at most; others are built anew."""

    def __init__(self, vocabulary: Vocabulary):
        none = np.zeros(0, np.int64)
        self.vocabulary = vocabulary
        self.names, self.start = np.zeros(0, U), none
        self.lattice = Lattice(vocabulary, np.zeros(0, np.uint8), none, none)
        self.seen = np.zeros(0, U)

    def __call__(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """A lattice of distinct words of ascending hashes, and each word's first place in it."""
        at = np.minimum(np.searchsorted(self.names, h), max(len(self.names) - 1, 0))
        known = self.names[at] == h if len(self.names) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        size = sizes[new]
        first = np.cumsum(size) - size
        built = Lattice(self.vocabulary, data[_gather(starts[new], size)], first, first + size)
        place = np.empty(len(h), np.int64)
        place[known] = self.start[at[known]]
        place[new] = first + len(self.lattice.data)
        out = self.lattice.and_(built) if known.any() else built
        if not known.any():
            place[new] = first
        where = np.minimum(np.searchsorted(self.seen, h[new]), max(len(self.seen) - 1, 0))
        met = self.seen[where] == h[new] if len(self.seen) else np.zeros(len(new), bool)
        again = np.flatnonzero(met)
        again = again[: np.searchsorted(np.cumsum(size[again]), KEPT_BYTES - len(self.lattice.data), "right")]
        if len(again):
            begin = len(self.lattice.data) + np.cumsum(size[again]) - size[again]
            self.lattice = self.lattice.and_(built.part(first[again], size[again]))
            names = np.r_[self.names, h[new][again]]
            order = np.argsort(names)
            self.names, self.start = names[order], np.r_[self.start, begin][order]
        before = self.seen if len(self.seen) < SEEN_WORDS else self.seen[:0]
        self.seen = np.sort(np.concatenate([before, h[new][~met]]), kind="stable")
        return out, place


def _uniform(key: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """Numbers strictly between 0 and 1 from hashed keys."""
    h = key
    for i, p in enumerate(parts):
        h = mix(h + np.asarray(p).astype(U) * _ODD[i % 4] + U(i + 1))
    return ((h >> U(11)).astype(float) + 0.5) * 2.0**-53


def _truncated(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at a location, given that they are under `most`."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = location - np.log(np.exp(np.minimum(location - most, 700)) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, out)


class _Paths:
    """One segmentation for each of several texts: arcs, their words and log masses, side by side."""

    def __init__(self, texts: np.ndarray, off: np.ndarray, arcs: np.ndarray, word: np.ndarray, lattice: Lattice, most: np.ndarray, own_from: np.ndarray, key: np.ndarray, sample: int):
        self.texts, self.off, self.arcs, self.word, self.most = texts, off, arcs, word, most
        count = np.diff(off)
        step = lattice.log_q[arcs]
        run = np.cumsum(step)
        self.before = run - step - np.repeat(np.r_[0.0, run][off[:-1]], count)
        self.log_p = np.bincount(np.repeat(np.arange(len(texts)), count), step, len(texts))
        place = np.arange(len(arcs)) - np.repeat(off[:-1], count)
        with np.errstate(divide="ignore"):
            left = np.log1p(-np.minimum(lattice.q[arcs], 1.0))
        # a single arc has no siblings, whatever rounding says
        at = lattice.at[arcs]
        alone = lattice.first[at + 1] - lattice.first[at] == 1
        location = np.where(alone | (place < np.repeat(own_from, count)), -np.inf, self.before + left)
        self.rest = _truncated(location, np.repeat(most, count), _uniform(np.repeat(key[texts], count), 2, place, sample))
        self.left_out: dict[int, list[int]] = {}

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """The greatest sibling hypothesis of each text: its value and its arc's number."""
        top, at = np.full(len(self.texts), -np.inf), np.zeros(len(self.texts), np.int64)
        full = np.flatnonzero(np.diff(self.off))
        if len(full):
            top[full] = np.maximum.reduceat(self.rest, self.off[full])
            where = np.flatnonzero(self.rest == np.repeat(top, np.diff(self.off)))
            owner = np.searchsorted(self.off, where, "right") - 1
            at[owner[::-1]] = where[::-1]
        return top, at


def _walk(lattice: Lattice, place: np.ndarray, end: np.ndarray, key: np.ndarray, word: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Arcs drawn from each place to its word's end: (arcs in order, number for each place)."""
    live = np.flatnonzero(place < end)
    now = place.copy()
    got, whose, step = [], [], 0
    count = np.zeros(len(place), np.int64)
    while len(live):
        arc = lattice.draw(now[live], _uniform(key[live], 1, word[live], step, sample))
        got.append(arc)
        whose.append(live)
        count[live] += 1
        now[live] += lattice.size[arc]
        live = live[now[live] < end[live]]
        step += 1
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for i, (a, w) in enumerate(zip(got, whose, strict=True)):
        out[first[w] + i] = a
    return out, count


def segment_slice(vocabulary: Vocabulary, data: np.ndarray, off: np.ndarray, row_key: np.ndarray, k: int, seed: int, kept: Kept | None = None) -> list[tuple[np.ndarray, dict[str, list]]]:
    """For each of up to k samples: (text numbers, columns of SAMPLE and the bytes that the ids are decoded to)."""
    n = len(off) - 1
    some = np.diff(off) > 0
    shift = np.r_[0, np.cumsum(some)]
    new_off = off + shift
    text = np.full(int(new_off[-1]), 0x20, np.uint8)
    text[np.arange(len(data)) + np.repeat(shift[1:], np.diff(off))] = data
    cut = np.zeros(len(text) + 1, bool)
    cut[new_off] = True
    white = text == 0x20
    cut[1:-1] |= white[1:] & ~white[:-1]
    line = text == 10
    cut[:-1] |= line
    cut[1:] |= line
    starts = np.flatnonzero(cut[:-1])
    ends = np.r_[starts[1:], len(text)] if len(starts) else starts
    owner = np.searchsorted(new_off, starts, "right") - 1
    h = hashes(text, starts, ends)
    name, one, kind = np.unique(h, return_index=True, return_inverse=True)
    size = (ends - starts)[one]
    lattice, first = (kept or Kept(vocabulary))(name, text, starts[one], size)
    place, stop = first[kind], (first + size)[kind]
    key = mix(row_key.astype(U) * _ODD[1] + U(seed))
    base = np.searchsorted(owner, np.arange(n + 1))
    number = np.arange(len(starts)) - base[owner]

    def arranged(texts: np.ndarray, head: list[np.ndarray], head_word: list[np.ndarray], from_word: np.ndarray, from_place: np.ndarray, most: np.ndarray, own_from: np.ndarray, sample: int) -> _Paths:
        """Segmentations with the given heads, drawn on from a word's place to their texts' ends."""
        count = base[texts + 1] - base[texts] - from_word
        words = _gather(base[texts] + from_word, count)
        at = place[words].copy()
        fresh = np.cumsum(count) - count
        inner = count > 0
        moved = fresh[inner]
        at[moved] = np.where(from_place[inner] < 0, at[moved], from_place[inner])
        drawn, per = _walk(lattice, at, stop[words], key[owner[words]], number[words], sample)
        of = np.repeat(np.arange(len(texts)), count)
        tail = np.bincount(of, per, len(texts)).astype(np.int64)
        lead = np.array([len(x) for x in head], np.int64)
        path_off = np.r_[0, np.cumsum(lead + tail)]
        arcs, word = np.zeros(path_off[-1], np.int64), np.zeros(path_off[-1], np.int64)
        to = _gather(path_off[:-1] + lead, tail)
        arcs[to], word[to] = drawn, np.repeat(number[words], per)
        if lead.any():
            to = _gather(path_off[:-1], lead)
            arcs[to], word[to] = np.concatenate(head), np.concatenate(head_word)
        return _Paths(texts, path_off, arcs, word, lattice, most, own_from, key, sample)

    every = np.arange(n)
    none = [np.zeros(0, np.int64)] * n
    root = -np.log(-np.log(_uniform(key, 3)))
    paths = [arranged(every, none, none, np.zeros(n, np.int64), np.full(n, -1), root, np.zeros(n, np.int64), 0)]
    last = np.full(n, -np.inf)
    for sample in range(1, k + 1):
        value, which, where = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, p in enumerate(paths):
            top, at = p.best()
            better = top > value[p.texts]
            t = p.texts[better]
            value[t], which[t], where[t] = top[better], i, at[better]
        last = value
        if sample == k:
            break
        texts = np.flatnonzero(value > -np.inf)
        if not len(texts):
            break
        head, head_word, from_word, from_place, own_from = [], [], [], [], []
        u = _uniform(key[texts], 4, sample)
        v = _uniform(key[texts], 5, sample)
        for x, t in enumerate(texts.tolist()):
            p, j = paths[which[t]], int(where[t])
            row = int(np.searchsorted(p.texts, t))
            out = p.left_out.setdefault(j, [int(p.arcs[j])])
            lo, hi = lattice.first[lattice.at[p.arcs[j]]], lattice.first[lattice.at[p.arcs[j]] + 1]
            q = lattice.q[lo:hi].copy()
            q[[a - lo for a in out]] = 0.0
            arc = int(lo + min(np.searchsorted(np.cumsum(q), u[x] * q.sum(), "right"), hi - lo - 1))
            while arc in out:  # rounding at the upper end
                arc -= 1
            out.append(arc)
            q[arc - lo] = 0.0
            left = float(q.sum()) if len(out) < hi - lo else 0.0
            p.rest[j] = _truncated(np.array([p.before[j] + np.log(left)]), value[t : t + 1], v[x : x + 1])[0] if left > 0 else -np.inf
            s = int(p.off[row])
            head.append(np.r_[p.arcs[s:j], arc])
            head_word.append(p.word[s : j + 1])
            to = int(lattice.at[arc] + lattice.size[arc])
            done = to == lattice.end[lattice.at[arc]]
            from_word.append(int(p.word[j]) + int(done))
            from_place.append(-1 if done else to)
            own_from.append(j - s + 1)
        paths.append(arranged(texts, head, head_word, np.array(from_word), np.array(from_place), value[texts], np.array(own_from), sample))
    result = []
    for i, p in enumerate(paths):
        ids, count = lattice.tokens(p.arcs, vocabulary)
        edge = np.r_[0, np.cumsum(count)][p.off]
        back = vocabulary.decode(ids)
        back_edge = np.r_[0, np.cumsum(vocabulary.size[ids])][edge]
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(np.minimum(p.log_p - last[p.texts], 700)))
        rows = range(len(p.texts))
        made = [back[back_edge[r] : back_edge[r + 1]] for r in rows]
        trip = [np.array_equal(x, text[new_off[t] : new_off[t + 1]]) for x, t in zip(made, p.texts.tolist(), strict=True)]
        result.append((p.texts, {"sample": [i + 1] * len(p.texts), "n_tokens": np.diff(edge), "log_prob": p.log_p, "perturbed": p.most, "inclusion": inclusion, "round_trip": trip, "ids": [ids[edge[r] : edge[r + 1]] for r in rows], "decoded": [x[1:] for x in made]}))
    return result


_vocabularies: dict[tuple[str, float], Vocabulary] = {}
_kept: dict[tuple[str, float], Kept] = {}


def sample_segmentations(docs: DataFrame, model: str, key: Column, text: str = "text", k: int = SAMPLES, seed: int = SEED, sharpness: float = 1.0, keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """The columns `keep` (all but the text by default) and SAMPLE, a row for each text and sample.
    With `digest` the columns ids_crc32 (of 32-bit numbers, low bytes first) and text_sha256 (of the text that
    the ids are decoded to, lowercase hex) stand for ids."""
    names = [x.split()[0] for x in SAMPLE.split(", ")]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in (*names, "ids_crc32", "text_sha256") and (keep is not None or c != text)]
    rows = docs.select(*kept, F.col(text).alias("__text"), F.coalesce(F.xxhash64(key), F.lit(0)).alias("__key"))
    out = SAMPLE.replace("ids array<int>", "ids_crc32 long, text_sha256 string") if digest else SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabularies.get((model, sharpness)) or _vocabularies.setdefault((model, sharpness), Vocabulary(model, sharpness))
        kept_words = _kept.get((model, sharpness)) or _kept.setdefault((model, sharpness), Kept(v))
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), *([pa.int64(), pa.string()] if digest else [pa.list_(pa.int32())])]
        for b in batches:
            for lo, data, off in slices(b.column("__text"), SLICE):
                row_key = b.column("__key").slice(lo, len(off) - 1).to_numpy().view(U)
                for texts, columns in segment_slice(v, data, off, row_key, k, seed, kept_words):
                    take = pa.array(texts + lo)
                    decoded = columns.pop("decoded")
                    if digest:
                        columns["ids"] = [zlib.crc32(x.astype("<u4")) for x in columns["ids"]]
                        columns["text"] = [hashlib.sha256(x).hexdigest() for x in decoded]
                    made = [pa.array(x, t) for x, t in zip(columns.values(), kinds, strict=True)]
                    fields = [*(b.schema.field(c) for c in kept), *(pa.field(x.split()[0], t) for x, t in zip(out.split(", "), kinds, strict=True))]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in kept), *made], schema=pa.schema(fields))

    schema = rows.select(*kept, *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in out.split(", ")]).schema
    return rows.mapInArrow(lean(run), schema)


def decode_ids(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text that the pieces spell."""
    kept = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabularies.get((model, 1.0)) or _vocabularies.setdefault((model, 1.0), Vocabulary(model))
        for b in batches:
            lists = b.column(ids)
            edge, values = lists.offsets.to_numpy().astype(np.int64), lists.values
            lo, texts = 0, []
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + DECODED, "right")) - 1)
                own = values.slice(edge[lo], edge[hi] - edge[lo]).to_numpy()
                back = v.decode(own).tobytes()
                cut = np.r_[0, np.cumsum(v.size[own])][edge[lo : hi + 1] - edge[lo]].tolist()
                valid = lists.slice(lo, hi - lo).is_valid().to_pylist()
                texts += [back[i + 1 : j].decode("utf-8", "replace") if ok else None for i, j, ok in zip(cut, cut[1:], valid, strict=False)]
                lo = hi
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], schema=pa.schema([*(b.schema.field(c) for c in kept), pa.field(out, pa.string())]))

    return rows.mapInArrow(lean(run), rows.select(*kept, F.lit(None).cast("string").alias(out)).schema)
