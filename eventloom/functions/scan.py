"""Where a set of patterns matches in the texts of an Arrow column, by one pass over their flat bytes.

Every pattern has anchors, byte strings of which each match has one.  The first bytes of all anchors are
looked for together: each byte of a batch is turned into a set of bits, one for each group of anchors
that has it at a place, and shifted sets are joined with AND.  What remains is compared with the anchors
in full.  Regular expressions run only around the anchors that are there, so a batch without any costs
a few passes over its bytes and no call for each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of an anchor in the joint comparison, and groups of anchors (bits).
FRONT, GROUPS = 4, 8
SLICE_BYTES = 2 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Anchors:
    """Finds several byte strings in one pass; a folded one in any case of its ASCII letters."""

    def __init__(self, anchors: list[tuple[bytes, bool, int]]):
        """anchors: (bytes, folded, owner)."""
        self.all = sorted(((a.lower() if folded else a), folded, owner) for a, folded, owner in anchors)
        self.groups = [i * GROUPS // max(len(self.all), 1) for i in range(len(self.all))]
        self.longest = max((len(a) for a, _, _ in self.all), default=1)
        tables = np.zeros((FRONT, 256), np.uint8)
        for (a, folded, _), g in zip(self.all, self.groups, strict=True):
            for j in range(FRONT):
                if j >= len(a):
                    tables[j] |= 1 << g
                    continue
                for c in {a[j], *(a[j : j + 1].upper() if folded else b"")}:
                    tables[j, c] |= 1 << g
        self.tables = [t.tobytes() for t in tables]

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place, owner) of every anchor in raw, in order of places."""
        n = len(raw)
        if not n or not self.all:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = raw + bytes(max(FRONT, self.longest))
        met = np.frombuffer(padded.translate(self.tables[0]), np.uint8)[:n].copy()
        for j in range(1, FRONT):
            met &= np.frombuffer(padded.translate(self.tables[j]), np.uint8)[j : n + j]
        near = np.flatnonzero(met != 0)
        sets, data = met[near], np.frombuffer(padded, np.uint8)
        places, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (a, folded, owner), g in zip(self.all, self.groups, strict=True):
            at = near[(sets >> g) & 1 == 1]
            for k, c in enumerate(a):
                x = data[at + k]
                at = at[(x == c) | (x == c - 32) if folded and 97 <= c <= 122 else x == c]
            places.append(at)
            owners.append(np.full(len(at), owner))
        place, owner = np.concatenate(places), np.concatenate(owners)
        order = np.argsort(place, kind="stable")
        return place[order], owner[order]


class Rule:
    """A pattern and how it is tried at an anchor.

    A pattern that has no white space is searched for in the word (what is between spaces and line ends) that
    holds the anchor; one that starts with its anchor is tried at the anchor, in the whole text; one
    without anchors is searched for in every text."""

    def __init__(self, pattern: str, anchors: tuple[str, ...]):
        self.pattern = re.compile(pattern)
        self.anchors = [a for a in anchors if a]
        self.folded = pattern.startswith("(?i)") and "://" not in anchors
        self.words = bool(self.anchors) and not self.folded and " " not in pattern


class Scanner:
    """Matches of all patterns that do not overlap: earlier first, of equal starts the longest."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.anchors = Anchors([(a.encode(), r.folded, i) for i, r in enumerate(rules) for a in r.anchors])
        self.everywhere = [i for i, r in enumerate(rules) if not r.anchors]

    def slices(self, column: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """(first row, bytes, offsets) of runs of texts; a null text is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        data, lo = column.buffers()[2], 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
            yield lo, (data[int(off[lo]) : int(off[hi])].to_pybytes() if data is not None else b""), off[lo : hi + 1] - off[lo]
            lo = hi

    def __call__(self, raw: bytes, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, start, end, rule) in order, places in bytes of raw."""
        place, owner = self.anchors(raw)
        text = np.searchsorted(off, place, "right") - 1
        found: list[tuple[int, int, int, int]] = []
        seen: set[tuple[int, int]] = set()
        whole: dict[int, _Text] = {}
        past: dict[tuple[int, int], int] = {}  # where the last match of a rule in a text ended
        for at, i, t in zip(place.tolist(), owner.tolist(), text.tolist(), strict=True):
            rule, first, end = self.rules[i], int(off[t]), int(off[t + 1])
            if not rule.words:
                if t not in whole:
                    whole[t] = _Text(raw[first:end])
                own = whole[t]
                if at >= past.get((i, t), 0) and (m := rule.pattern.match(own.text, own.character(at - first))):
                    past[i, t] = first + own.byte(m.end())
                    found.append((t, at, past[i, t], i))
                continue
            lo = max(raw.rfind(b" ", first, at) + 1, first)
            lo = max(raw.rfind(b"\n", lo, at) + 1, lo)
            if (i, lo) in seen:
                continue
            seen.add((i, lo))
            hi = raw.find(b" ", at, end)
            hi = end if hi < 0 else hi
            line = raw.find(b"\n", at, hi)
            hi = hi if line < 0 else line
            own = _Text(raw[lo:hi])
            found += [(t, lo + own.byte(m.start()), lo + own.byte(m.end()), i) for m in rule.pattern.finditer(own.text)]
        for i in self.everywhere:
            for t in range(len(off) - 1):
                first = int(off[t])
                own = whole.get(t) or _Text(raw[first : int(off[t + 1])])
                found += [(t, first + own.byte(m.start()), first + own.byte(m.end()), i) for m in self.rules[i].pattern.finditer(own.text)]
        found.sort(key=lambda x: (x[0], x[1], -x[2], x[3]))
        out, last = [], (-1, 0)
        for t, start, end, i in found:
            if (t, start) >= last:
                out.append((t, start, end, i))
                last = (t, end)
        return out


class _Text:
    """A text whose places in characters and in bytes are told from each other, going forward."""

    def __init__(self, raw: bytes):
        self.raw, self.text = raw, raw.decode()
        self.plain = len(self.text) == len(raw)
        self.at = (0, 0)  # characters, bytes

    def character(self, byte: int) -> int:
        if self.plain:
            return byte
        c, b = self.at if byte >= self.at[1] else (0, 0)
        self.at = (c + len(self.raw[b:byte].decode()), byte)
        return self.at[0]

    def byte(self, character: int) -> int:
        if self.plain:
            return character
        c, b = self.at if character >= self.at[0] else (0, 0)
        self.at = (character, b + len(self.text[c:character].encode()))
        return self.at[1]
