"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def lower_words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = lower_words(text)
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(rows, k, percent):
    """{id: (set size, smallest linked id)} for rows of distinct ids."""
    sets = {d: shingles(t, k) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = collections.Counter(five)
    repeated = {j for i, g in enumerate(five) if count[g] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def repeated_bytes(rows, size=50):
    """(id, bytes, removed, spans, sha256) for each row."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(first.get(b[i : i + size], LAST + 1), LAST if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b) + 1)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < (LAST if d is None else d):
                mark[i : i + size] = b"\1" * size
        kept = bytes(c for c, m in zip(b, mark) if not m)
        spans = sum(1 for i in range(len(b)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sentences(text):
    """(piece of text, words) of each sentence; the pieces make up the text from its first word on."""
    found = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    starts = [i for i, (at, _) in enumerate(found) if i == 0 or found[i - 1][1][-1] in ".!?" or "\n" in text[found[i - 1][0] + len(found[i - 1][1]) : at]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(found)]):
        end = found[b][0] if b < len(found) else len(text)
        out.append((text[found[a][0] : end], [w.encode().lower() for _, w in found[a:b]]))
    return out


def without_repeated_sentences(rows, k, least):
    """{(id, text): text} after the sentences that non-first repeated spans cover are cut."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    where = collections.defaultdict(list)
    for n, (_, t) in enumerate(docs):
        s = sentences(t)
        for i in range(len(s) - k + 1):
            words = [tuple(x[1]) for x in s[i : i + k]]
            if sum(map(len, words)) >= least:
                where[tuple(words)].append((n, i))
    gone = collections.defaultdict(set)
    for places in where.values():
        for n, i in sorted(places)[1:]:
            gone[n] |= set(range(i, i + k))
    out = {}
    for n, (d, t) in enumerate(docs):
        s = sentences(t)
        head = t[: len(t) - sum(len(p) for p, _ in s)] if s else t
        out[d, t] = head + "".join(p for i, (p, _) in enumerate(s) if i not in gone[n])
    return out


def unigrams(rows):
    """{id: (held out, tokens, known tokens, training tokens, base score)}."""
    count = collections.Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update([*lower_words(t), None])
    total, kinds = sum(count.values()), len(count)
    out = {}
    for d, t in rows:
        w = [*lower_words(t), None]
        out[d] = (zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w))
    return out


def bm25(items, passage, k1=1.2, b=0.75):
    """Scores of items for a passage's distinct words, each divided by the item's own."""
    texts = [lower_words(t) for t in items]
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = collections.Counter(w for t in texts for w in set(t))

    def score(t, query):
        tf = collections.Counter(t)
        return sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / mean)) for w in query if w in tf)

    query = set(lower_words(" ".join(passage)))
    return [score(t, query) / score(t, set(t)) for t in texts]


def _chi_square(x, k):
    """The chi-square distribution with 5 or 7 degrees of freedom."""
    terms = [math.sqrt(x), x**1.5 / 3, x**2.5 / 15][: (k - 1) // 2]
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 / math.pi) * math.exp(-x / 2) * sum(terms)


def mcd_distances(x, floors, subset=0.75, settled=1e-6):
    """Squared distances of rows of five numbers from their minimum-covariance-determinant estimate."""
    import numpy as np

    n, p = x.shape
    floor = np.square(floors)

    def scatter(cov, share):
        lo, hi = 0.0, 60.0
        for _ in range(80):
            lo, hi = ((lo + hi) / 2, hi) if _chi_square((lo + hi) / 2, p) < share else (lo, (lo + hi) / 2)
        cov = cov * (share / _chi_square(lo, p + 2))
        cov[np.arange(p), np.arange(p)] = np.maximum(cov.diagonal(), floor)
        return cov

    def binned_median(v):
        bins, count = np.unique(np.round(v * 64), return_counts=True)
        return bins[np.searchsorted(count.cumsum(), count.sum() / 2)] / 64

    middle = np.array([binned_median(v) for v in x.T])
    wide = np.square([1.4826 * binned_median(abs(v - m)) for v, m in zip(x.T, middle)])
    fits = [(middle, floor), (middle, np.maximum(wide, floor)), (middle, wide + floor), (x.mean(axis=0), np.maximum(x.var(axis=0), floor))]
    fits = [(m, np.diag(v)) for m, v in fits]
    square = lambda m, cov: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
    ended = []
    for m, cov in fits:
        seen = []
        while True:
            bins = np.floor(np.log2(square(m, cov) + 1e-9) * 32)
            order, count = np.unique(bins, return_counts=True)
            own = x[bins <= order[np.searchsorted(count.cumsum(), subset * n)]]
            m, cov = own.mean(axis=0), scatter(np.cov(own.T, bias=True), min(0.999, len(own) / n))
            size = np.linalg.slogdet(cov)[1]
            if any(abs(size - before) <= settled for before in seen):
                break
            seen.append(size)
        ended.append((size, m, cov))
    return square(*min(ended, key=lambda e: e[0])[1:])


def aligned(rows, a_path, b_path):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row, token by token over whole texts."""
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer

    from eventloom.llm import token_alignment as ta

    t = Tokenizer.from_file(a_path)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_bytes, b_bytes = ta.byte_tokens(a_path), ta.piece_tokens(b_path)
    made, counts = [], Counter()
    for d, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        if b"".join(a_bytes[x] for x in a) != whole or b"".join(b_bytes.get(x, b"?") for x in b) != whole:
            made.append((d, [], [], []))
            continue
        ends = []
        for ids, size in ((a, a_bytes), (b, b_bytes)):
            at, e = 0, {}
            for i, x in enumerate(ids):
                at += len(size[x])
                e[at] = i
            ends.append(e)
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0][x]], b[ends[1][x]]) for x in common]
        counts.update(links)
        groups, i, j = [], 0, 0
        for x in common:
            groups.append(f"{','.join(map(str, a[i : ends[0][x] + 1]))}|{','.join(map(str, b[j : ends[1][x] + 1]))}")
            i, j = ends[0][x] + 1, ends[1][x] + 1
        made.append((d, a, b, links, ";".join(groups)))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(m[0], len(m[1]), len(m[2]), len(m[3]), len(m[3]), sum(counts[x] == top[x[1]] for x in m[3]), sum(counts[x] for x in m[3]), (m[4:] or ("",))[0]) for m in made], counts


def personal(rows):
    """(doc_id, base spans, all spans) as text, in plain Python: base by its patterns as given, contexts over all rows."""
    import math
    import re
    from collections import defaultdict

    import regex

    from eventloom.llm import contextual_pii as pii

    given = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def holds(kind, text):
        d = [int(c) for c in text if c in "0123456789"]
        luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return [True, all(int(x) <= 255 for x in text.split(".")) if kind == 1 else True, 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15][kind]

    def fits(text):
        n, letters, mail = len(re.findall("[0-9]", text)), re.search("[A-Za-z]", text), re.search(r"@|[\[(]at[\])]", text)
        shape = (mail, not mail and not letters and 4 <= n <= 12 and len(re.findall("[.:]", text)) >= 3, not mail and n >= 8, not mail and not letters and 6 <= n <= 15)
        return {k for k, x in enumerate(shape) if x}

    white, entities = "[\\x20\\x09-\\x0D]+", []
    base_of, edges = {}, set()
    for r, (_, text) in enumerate(rows):
        text = text or ""
        base = [(m.start(), k, m.end()) for k, p in enumerate(given) for m in re.finditer(p, text) if holds(k, m.group())]
        base_of[r] = sorted(base)
        found = [(k, given[k]) for k in range(4)] + [(4, pii.PATTERNS[4])]
        for k, p in found:
            before = 0
            for m in regex.finditer(pii.PATTERNS[k], text):
                a, b = m.span()
                piece, before = text[before:a], b
                if k < 4 and (a, k, b) not in base or k == 4 and any(a < e and s < b for s, _, e in base):
                    continue
                w = [x for x in re.split(white, piece[-64:].lower()) if x]
                whole = len(w) - (len(piece) >= 64)
                form = re.sub("[^0-9A-Za-z@]", "", m.group()).lower()
                pats = ([w[-1]] if whole >= 1 else []) + ([" ".join(w[-2:])] if whole >= 2 else [])
                entities.append((r, k, a, b, form))
                edges |= {(x, form, k, frozenset({k} if k < 4 else fits(m.group()))) for x in pats}
    by = defaultdict(list)
    for x, *rest in edges:
        by[x].append(rest)
    by = {x: v for x, v in by.items() if len(v) >= pii.SEEDS}
    plain = defaultdict(set)
    for _, text in rows:
        w = [x for x in re.split(white, (text or "").lower()) if x]
        for i in range(len(w)):
            for x, at in ((w[i], i + 1), (" ".join(w[i : i + 2]), i + 2)):
                if x in by and at < len(w) and not re.search("[0-9@]", w[at]):
                    plain[x].add(w[at])
    seeds = {}
    for v in by.values():
        for form, k, _ in v:
            if k < 4:
                seeds[form] = min(seeds.get(form, 9), k)
    new = {}
    for _ in range(pii.ROUNDS):
        known = {f: (k, 1.0) for f, k in seeds.items()}
        known |= {f: x for f, x in new.items() if f not in seeds}
        sure = defaultdict(dict)
        for x, v in by.items():
            for k in range(4):
                good = bad = 0.0
                for form, own, shape in v:
                    label, worth = (own, 1.0) if own < 4 else known.get(form, (None, 0))
                    if label == k:
                        good += worth
                    else:
                        bad += pii.UNKNOWN if label is None and k in shape else 1
                score = good / (good + bad + len(plain[x])) if good else 0
                if good >= pii.SEEDS and score >= pii.SURE:
                    sure[x][k] = score
        missed = defaultdict(float)
        for x, kinds in sure.items():
            for form, own, shape in by[x]:
                if own == 4:
                    for k in shape & set(kinds):
                        missed[form, k] += math.log(1 - min(kinds[k], 1 - 1e-9))
        new = {}
        for (form, k), s in sorted(missed.items(), key=lambda t: (-t[1], -t[0][1])):
            if 1 - math.exp(s) >= pii.SURE:
                new[form] = (k, round(1 - math.exp(s), 9))  # the last is the best, of equal ones the smaller kind
    out = []
    for r, (d, _) in enumerate(rows):
        extra = [(a, new[form][0], b) for q, k, a, b, form in entities if q == r and k == 4 and form in new]
        text = [",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in x) for x in (base_of[r], sorted(base_of[r] + extra))]
        out.append((d, *[sum(k == x[1] for x in base_of[r]) for k in range(4)], *text))
    return out


def clusters(rows, k=8, rounds=10, dims=64):
    """[(vec_id, cluster, distance)] and the centroids, in Python integers, every distance taken."""
    kept = [(d, [math.floor(x * 1024) for x in v]) for d, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in kept]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (x, _) in zip(kept, at, strict=True) if x == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(d, *x) for (d, _), x in zip(kept, assign(), strict=True)], centroids


def leaks(items, docs, threshold, overlap):
    """{(doc number, item id)}: every passage against every item by BM25, then parts compared word by word."""
    stop = ".!?"
    texts = [(i, t) for i, t in items if t and WORD.search(t)]
    lower = lambda t: t.encode().lower().decode()
    stride = max([32, *(len(lower_words(t)) for _, t in texts)])
    bare = lambda w: re.sub(r"^[\x00-/:-@\[-`{-\x7f]+|[\x00-/:-@\[-`{-\x7f]+$", "", w) or w
    letters = lambda t: re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", lower(t)).strip(" ")
    out = set()
    for n, text in enumerate(docs):
        words_ = [(m.group(), m.start(), m.end()) for m in WORD.finditer(lower(text or ""))]
        for lo in range(0, max(len(words_), 1), stride):
            own = words_[lo : lo + 2 * stride]
            if not own:
                continue
            scores = bm25([t for _, t in texts], [w for w, _, _ in own])
            passage = letters(lower(text)[own[0][1] : own[-1][2]])
            b = [bare(w) for w, _, _ in own]
            for (item, t), score in zip(texts, scores, strict=True):
                if score < threshold:
                    continue
                w = [(m.group(), m.start()) for m in WORD.finditer(lower(t))]
                ends = [i + 1 for i, (x, _) in enumerate(w[:-1]) if x[-1] in stop]
                cut = ends[-1] if ends else max(0, len(w) - 5)
                share = []
                for part, raw in ((w[:cut], lower(t)[: w[cut][1]] if cut < len(w) else lower(t)), (w[cut:], lower(t)[w[cut][1] :] if cut < len(w) else "")):
                    p = [bare(x) for x, _ in part]
                    if not p or letters(raw) and letters(raw) in passage:
                        share.append(1.0)
                        continue
                    grams = lambda x, k: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
                    k = min(5, len(p))
                    s = [len(grams(p, k) & grams(b, k)) / len(grams(p, k))]
                    if part is not w[:cut] and len(share) == 1 and len(p) < 8:
                        s.append(len(set(p) & set(b)) / len(set(p)))
                    share.append(max(s))
                if min(share) >= overlap or cut and share[0] == 1.0 and score >= 0.9:
                    out.add((n, item))
    return out
