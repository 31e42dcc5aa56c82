"""Operators for training data against plain versions, with nulls, empty and long texts, ties and
repeated rows, empty tables and clashing columns."""

import math
import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from eventloom.llm import context_mixing, decontaminate, flat, lattice_sampling, line_dedup, ngram_join, quality, queries, sentence_spans, shared, suffix_dedup, token_files, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"
random.seed(3)
VOCABULARY = ["the", "of", "Ärger", "sun", "moon.", "river", "stone!", "été", "glass", "q", "walk", "über"]
ODD = [None, "", " ", "\n\n", "a", "a b", "a  b \n c", "x" * 5000, "ab " * 900, "日本語 テスト", "#*$ | <>\n#*$ | <>\n\n \n", "\x00nul\x00"]


def made(n=60, words=60):
    out = []
    for i in range(n):
        if i % 4 == 3:
            w = out[i - 3].split(" ")
            for _ in range(i % 3):
                w[random.randrange(len(w))] = "edit%d" % i
            out.append(" ".join(w))
        else:
            out.append(" ".join(random.choice(VOCABULARY) + ("" if random.random() < 0.5 else str(random.randrange(40))) for _ in range(random.randrange(5, words))))
    return out


ROWS = list(enumerate(made() + ODD))
DDL = "doc_id long, text string, lang string, source string, extra string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, None if (d or 0) % 7 == 0 else "en", f"s{(d or 0) % 2}", "x") for d, t in rows], DDL).repartition(3)


def test_words_and_slices_keep_borders():
    column = pa.array([t for _, t in ROWS])
    got = []
    for _, data, off in flat.slices(column, 3000):
        starts, ends, doc = flat.words(flat.LOWER[data], off)
        got += [[flat.LOWER[data][a:b].tobytes() for a, b in zip(starts[doc == i], ends[doc == i])] for i in range(len(off) - 1)]
    assert got == [brute.lower_words(t) for _, t in ROWS]


def test_packed_blocks_come_back():
    arrays = [np.arange(7, dtype=np.int64), np.zeros(0, np.uint32), np.array([1.5, -2.0]), np.array([255], np.uint8)]
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, shared.unpack(shared.pack(*arrays))))


# ---- 1


def test_segmentations_are_distinct_and_come_back(spark):
    rows = lattice_sampling.sample_segmentations(frame(spark), queries.tokenizer_path(queries.PIECES), F.col("doc_id"), k=3)
    back = lattice_sampling.decode_ids(rows.withColumnRenamed("extra", "text"), queries.tokenizer_path(queries.PIECES)).collect()
    texts = dict(ROWS)
    seen = {}
    for r in back:
        assert r["text"] == (texts[r["doc_id"]] or "") and r["round_trip"]
        assert 0 <= r["inclusion"] <= 1 and r["log_prob"] <= 1e-9
        assert tuple(r["ids"]) not in seen.setdefault(r["doc_id"], set())
        seen[r["doc_id"]].add(tuple(r["ids"]))
    assert {d for d, _ in ROWS} == set(seen) and max(map(len, seen.values())) == 3


def test_sampling_follows_the_lattice_and_its_probabilities():
    v = lattice_sampling.Vocabulary(queries.tokenizer_path(queries.PIECES))
    pieces = {}
    for _, ids, score in v.levels:
        pieces |= {v.bytes[i]: (int(i), float(s)) for i, s in zip(ids, score) if i >= 0}
    text = " abc the"

    def segment(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k].encode() in pieces:
                i, s = pieces[rest[:k].encode()]
                for ids, t in segment(rest[k:]):
                    yield (i, *ids), s + t

    every = dict(segment(text))
    total = math.log(sum(math.exp(s) for s in every.values()))
    n = 3000
    ((_, data, off),) = flat.slices(pa.array(["abc the"] * n))
    got = lattice_sampling.segment_slice(v, data, off, np.arange(n).astype(np.uint64), 2, 1)
    first = [tuple(int(x) for x in i) for i in got[0][1]["ids"]]
    second = [tuple(int(x) for x in i) for i in got[1][1]["ids"]]
    p = {i: math.exp(s - total) for i, s in every.items()}
    for i in sorted(p, key=p.get)[-3:]:
        assert abs(first.count(i) / n - p[i]) < 4 * math.sqrt(p[i] / n) + 0.002
        want = sum(q * p[i] / (1 - q) for j, q in p.items() if j != i)
        assert abs(second.count(i) / n - want) < 4 * math.sqrt(want / n) + 0.002
    weigh = [sum(math.exp(c["log_prob"][x]) / c["inclusion"][x] for _, c in got) for x in range(n)]
    assert abs(np.mean(weigh) - 1) < 0.1


# ---- 2


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_ngram_join_is_exact(spark, monkeypatch, k, percent):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(frame(spark), k=k, percent=percent).collect()}
    want = brute.linked(ROWS, k, percent)
    assert got == {d: w for d, w in want.items()}


def test_ngram_join_with_split_clusters_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CLUSTER_SHINGLES", 300)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[: j] + [f"e{i}"] + base[j + 1 :])) for i, j in enumerate(random.choices(range(40), k=40))]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(frame(spark, rows), k=3, percent=80).collect()}
    assert got == brute.linked(rows, 3, 80)
    twice = ngram_join.link_documents(frame(spark, [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, None), (None, None)]), k=3).collect()
    assert sorted((r["id"] or -1, r["component_id"] or -1) for r in twice) == [(-1, -1), (-1, 3), (3, 3), (3, 3), (5, 3), (9, 9)]
    assert ngram_join.link_documents(frame(spark).limit(0)).count() == 0


# ---- 3


def test_sentence_spans(spark):
    a, b, c = "The first one goes here now. ", "Then a second sentence comes after it! ", "A third one ends all of this. "
    rows = [(4, a + b + c), (2, "Own start. " + a + b + "Own end."), (7, "Mid " + a + b + c + c), (7, a), (1, None), (None, a + b), (9, ""), (4, a + b + c), (8, "x" * 3000), *((10 + i, t) for i, t in enumerate(made(12)))]
    df = frame(spark, rows).withColumn("n_removed", F.lit("clash"))
    want = brute.without_repeated_sentences(rows, sentence_spans.SENTENCES, sentence_spans.MIN_WORDS)
    got = sentence_spans.drop_repeated_sentences(df).collect()
    assert len(got) == len(rows)
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((d, t if t is None else want[d, t])) for d, t in rows)
    assert sentence_spans.drop_repeated_sentences(df.limit(0)).count() == 0


def test_spans_grow_over_short_sentences_and_within_long_ones(spark, monkeypatch):
    w = lambda lo, hi: " ".join(f"w{i}" for i in range(lo, hi))
    short, long, two = ". ".join(w(0, 60).split()) + ".", w(100, 155), f"{w(200, 225)}. {w(225, 240)}. {w(240, 276)}"
    rows = [(1, f"a b c. {short} d e"), (2, f"f g {short} h i"), (3, f"j k l m {long} n o p"), (4, f"q r {long} s"), (5, f"t u {two} v"), (6, f"x y z {two} 1 2. 3"), (7, w(300, 400))]
    monkeypatch.setattr(queries, "table", lambda *a: frame(spark, rows))
    got = {r["doc_id"]: r for r in queries.op3_sentence_spans(spark, SF).collect()}
    assert all(got[d]["text"] == t and got[d]["n_removed"] == 0 for d, t in rows if d in (1, 3, 5, 7))
    assert got[2]["text"].split() == "f g w0. h i".split() and got[2]["n_removed"] == 59
    for d, passage, own in ((4, long, "q r s"), (6, two, "x y z 1 2. 3")):
        left = got[d]["text"].split()
        assert set(own.split()) <= set(left) and len(left) - len(own.split()) < len(passage.split()) / 2


def test_every_shared_window_of_51_words_holds_a_repeated_span():
    rng = random.Random(8)
    own = lambda n: [f"o{rng.randrange(10**9)}" + rng.choice(["", "", "", "."]) for _ in range(n)]
    for rate in (0, 0.02, 0.05, 0.1, 0.3, 1):
        for _ in range(40):
            passage = [f"p{rng.randrange(10**9)}" + ("." if rng.random() < rate else "") for _ in range(51)]
            texts = [" ".join(own(rng.randrange(1, 40)) + passage + own(rng.randrange(1, 40))).encode() for _ in range(2)]
            found = [set(sentence_spans.spans(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 2, 10, True)[3].tolist()) for t in texts]
            assert found[0] & found[1]


# ---- 4


def test_decontamination_retrieves_what_bm25_does():
    words = [f"w{i}" for i in range(80)]
    items = [" ".join(random.choices(words, k=random.randrange(6, 30))) + (". " + " ".join(random.choices(words, k=4)) if i % 2 else "") for i in range(60)]
    index = decontaminate.Index(list(range(60)), items)
    for _ in range(40):
        passage = random.choices(words, k=random.randrange(1, 60))
        want = brute.bm25(items, passage)
        h = flat.hashes(*(lambda t: (np.frombuffer(t, np.uint8), *flat.words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[:2]))(" ".join(passage).encode()))
        terms = np.unique(np.searchsorted(index.terms, h)[np.isin(h, index.terms)])
        got = {index.ids[i]: s for i, s in index.search(terms.tolist(), 0.35)}
        assert {i for i, s in enumerate(want) if s >= 0.35} == set(got)
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_leaks_are_found_in_long_texts_and_clean_ones_left(spark):
    item = "What is the tallest stone by the river. It is the glass moon over there"
    clean = " ".join(f"c{i}" for i in range(400))
    rows = [(1, clean), (2, clean + " " + item.upper() + " " + clean), (3, None), (4, ""), (5, item[: len(item) // 2]), (6, item), (6, item)]
    items = spark.createDataFrame([(7, item), (8, "Another thing that is not here at all. No"), (9, None), (7, "unrelated words only now")], "item_id long, text string")
    got = {(r["doc_id"], tuple(x["item_id"] for x in r["leaks"])) for r in decontaminate.mark_leaks(frame(spark, rows).withColumn("leaks", F.lit(1)), items).collect()}
    assert got == {(1, ()), (2, (7,)), (3, ()), (4, ()), (5, ()), (6, (7,))}
    assert all(not r["leaks"] for r in decontaminate.mark_leaks(frame(spark, rows), items.limit(0)).collect())


# ---- 5


def test_cascade_is_exact_and_both_ways_agree(spark, monkeypatch):
    keys = flat.stream(9, 20_000)
    listed, other = keys[:3000], keys[3000:]
    levels = url_filter.build_levels(listed, other)
    assert len(levels) > 1 and url_filter.member(levels, listed).all() and not url_filter.member(levels, other).any()
    assert not url_filter.member(url_filter.build_levels(listed[:0], other), other).any()
    urls = [f"http://h{i % 50}.net/p{i}" for i in range(300)] + [None, "", "no host", "https://A.B.org/es/x?q#f", "http://bad.com", "http://x.bad.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    block = spark.createDataFrame([("h7.net",), ("bad.com",), ("h3.net/p3",), ("not.there",)], "key string")
    run = lambda: {tuple(r) for r in url_filter.filter_urls(pages, "url", queries.URL_RULES, block).select("page_id", "host", "path", "rule", "verdict").collect()}
    broad = run()
    blocked = {i for i, _, _, _, v in broad if v == "block"}
    assert blocked == {i for i in range(300) if i % 50 == 7 or i == 3} | {304, 305}
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 100)
    assert run() == broad


# ---- 6


def test_statistics_are_exact(spark):
    df = frame(spark).withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: tuple(r[s] for s in quality.STATS) for r in quality.with_statistics(df).collect()}
    assert got == {d: brute.quality(t) for d, t in ROWS}


def test_outliers_go_and_the_bulk_stays(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(40, 200)))) for i in range(260)]
    rows += [(1000 + i, " ".join("#$%&*" * 4 + str(j) for j in range(50))) for i in range(8)] + [(2000, None), (2001, "few words"), (2002, "again and again we " * 30)]
    got = {r["doc_id"]: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(260)) and not any(got[1000 + i]["kept"] for i in range(8))
    assert not got[1000]["base_failed"] and all(got[i]["base_failed"] and not got[i]["kept"] for i in (2000, 2001, 2002))
    assert quality.quality_rules(frame(spark).limit(0)).count() == 0


# ---- 7


def test_suffix_dedup_is_exact(spark, monkeypatch):
    p = "The quick brown fox jumps over the lazy dog and runs away. "
    rows = [(5, p * 3 + "x"), (1, p), (None, p + "tail"), (None, p), (5, p + " y"), (5, p * 3 + "x"), (7, ""), (8, None), (9, "ab" * 400), (10, "ab" * 300 + "c"), (2, "é" * 60 + p), (3, "zz" + "é" * 60 + p[:49]), (11, p[:50]), (12, p[:49]), (4, "\0" * 70), (6, "q" + "\0" * 70 + "r")]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    check = lambda rows: sorted((tuple(r)[:5] for r in suffix_dedup.drop_repeated_bytes(frame(spark, rows)).collect()), key=order) == sorted(brute.repeated_bytes(rows), key=order)
    assert check(rows)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 1000)
    letters = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    assert check(rows + [(20 + i, letters(40) + p + p[::-1] + letters(random.randrange(60))) for i in range(150)])
    assert suffix_dedup.drop_repeated_bytes(frame(spark).limit(0)).count() == 0


def test_suffix_array_is_sorted():
    text = np.frombuffer(b"banana\xffananas\xff" + b"ab" * 50 + b"\xff", np.uint8)
    raw = text.tobytes()
    assert suffix_dedup.suffix_array(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


# ---- 8


def test_line_dedup(spark):
    rows = [(i, f"own {i}\nmenu line\n\nfoot" if i % 2 else f"own {i}") for i in range(30)] + [(40, None), (41, ""), (42, "\n")]
    df = frame(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_frequent_lines(df, "source", "text").collect()}
    assert got[1] == ("own 1\n", 4, 2) and got[2] == ("own 2", 1, 0)
    assert got[40] == (None, 0, 0) and got[41] == ("", 1, 0) and got[42] == ("\n", 2, 0)
    assert line_dedup.drop_frequent_lines(df.limit(0), "source", "text").count() == 0


# ---- 9


def test_simple8b_comes_back():
    rng = np.random.default_rng(0)
    for k in range(30):
        n = int(rng.integers(0, 2000))
        v = rng.integers(0, 1 << 62, n).astype(np.uint64) >> rng.integers(0, 62, n).astype(np.uint64)
        if k % 3 == 0:
            v = v | np.uint64(1 << 63) * (rng.random(n) < 0.3).astype(np.uint64)
        lengths, _ = token_files._cut(np.array([n]))
        words, sizes = token_files.encode_blocks(v, lengths)
        assert np.array_equal(token_files.decode_blocks(words, sizes, lengths), v)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    t.encode_special_tokens = True
    rows = ROWS + [(500, "don't  it's x²½ <|endoftext|>"), (501, " \nx  \ny")]
    out = token_files.write_token_files(frame(spark, rows), queries.tokenizer_path(queries.BYTE_BPE), 2, str(tmp_path / "t"))
    got = {r["doc_id"]: r for r in token_files.token_digest(token_files.read_token_files(spark, out)).collect()}
    at = 0
    for d, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), crc), d
        at += len(ids)


# ---- 10


def test_language_model(spark):
    rows = [(d, t) for d, t in ROWS]
    got = {r["doc_id"]: r for r in context_mixing.score_documents(frame(spark, rows)).collect()}
    want = brute.unigrams(rows)
    assert set(got) == set(want)
    for d, w in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert abs(r["base_score"] - w[4]) < 1e-6 * max(1, abs(w[4])) and r["score"] < 0


def test_word_probabilities_add_to_at_most_one():
    table = np.random.default_rng(1).integers(0, 60, context_mixing.SLOTS).astype(np.uint16) * 257
    model = context_mixing.Model(type("B", (), {"value": table})(), context_mixing._first_weights(), np.full((8, context_mixing.GATES, context_mixing.ODDS), 0.5), 1)
    names = [b""] + [bytes([x]) for x in range(256) if x != 0x20]
    size = np.array([len(x) for x in names])
    p = 10 ** context_mixing.log_probabilities(size, np.frombuffer(b"".join(names), np.uint8), model)[0]
    assert 0 < p.sum() <= 1


def test_held_out_texts_score_above_the_base(spark):
    got = queries.op10_context_mixing(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# ---- exchange forms, odd cases and size settings


def test_ngram_join_holds_groups_against_sketches(spark, monkeypatch):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(120):  # short texts that share a passage, and near copies of some of them
        own = [f"o{i}_{j}" for j in range(rng.randrange(8, 30))]
        rows.append((i, " ".join(passage + own)))
        if i % 3 == 0:
            own[rng.randrange(len(own))] = "x"
            rows.append((1000 + i, " ".join(passage + own)))
    clash = frame(spark, rows).withColumn("c", F.lit("clash")).withColumn("task", F.lit("clash"))
    run = lambda: {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(clash, k=3, percent=80).collect()}
    want = brute.linked(rows, 3, 80)
    assert run() == want
    monkeypatch.setattr(ngram_join, "GROUP", 3)  # larger groups are tied in a row
    monkeypatch.setattr(ngram_join, "CLUSTER_SHINGLES", 200)
    assert run() == want


def test_sketches_never_refuse_a_link():
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 5, 60, 64, 65, 130, 250, 1000):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        for _ in range(6):
            s = base.copy()
            s[: rng.integers(0, size // 4 + 1)] = rng.integers(0, 1 << 62, 1).astype(np.uint64)
            sets.append(np.unique(s))
    size = np.array([len(s) for s in sets])
    words, edge = ngram_join.sketches(np.concatenate(sets), np.r_[0, np.cumsum(size)])
    for percent in (60, 80, 90):
        test = ngram_join.compatible(size, words, edge, percent)
        x, y = (v.ravel() for v in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
        both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)])
        linked = 100 * both >= percent * (size[x] + size[y] - both)
        passed = test(x, y)
        assert (passed | ~linked).all() and passed.sum() < 1.5 * linked.sum()


def test_suffix_dedup_of_hot_passages_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH", 50)
    monkeypatch.setattr(suffix_dedup, "SOURCE_BYTES", 400)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 700)
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = "This line stands on every page of the site, as a licence might, and is long enough. "
    rows = [(i % 50, letters(rng.randrange(30)) + line * (1 + i % 2) + letters(60)) for i in range(80)]
    rows += rows[:5] + [(None, line), (None, line + letters(9))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    clash = frame(spark, rows).withColumn("key", F.lit("clash")).withColumn("spans", F.lit("clash")).withColumn("id", F.lit(1))
    got = suffix_dedup.drop_repeated_bytes(clash).collect()
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(brute.repeated_bytes(rows), key=order)


def test_token_files_of_several_buckets_follow_each_other(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(token_files, "RUN_BUCKETS", 3)
    path = queries.tokenizer_path(queries.BYTE_BPE)
    t = Tokenizer.from_file(path)
    rows = ROWS + [(None, "null id"), (None, "another null id"), (7, "a second text of id 7"), (501, "a <|endoftext|> b"), (502, "end<|endoftext|>"), (503, "thin space ,  then  two"), (504, "　\n　x  y"), (505, "\n\n"), (506, " a\t\n b  ")]
    out = token_files.write_token_files(frame(spark, rows).withColumn("bucket", F.lit("clash")), path, 2, str(tmp_path / "t"), added=True)
    files = token_files.read_token_files(spark, out)
    assert files.select("bucket").distinct().count() > 5
    got = token_files.token_digest(files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    at, left = 0, list(rows)
    for r in got:
        match = [x for x in left if x[0] == r["doc_id"] and zlib.crc32(np.array([*t.encode(x[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) == r["ids_crc32"]]
        assert match and r["start"] == at, r
        left.remove(match[0])
        at += r["n_tokens"]
    empty = token_files.write_token_files(frame(spark).limit(0), path, 2, str(tmp_path / "e"))
    assert token_files.token_digest(token_files.read_token_files(spark, empty)).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BYTE_BPE)
    rng = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "\t", " ", "é", "'s", "1", "23", "!", "…", "日", "<|endoftext|>", "\x1c", "　", "²", "the ", "\r", "\x85", " ", " don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(5000)] + [None, ""]
    for added in (True, False):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = not added
        for lo, ids, n in token_files.Encoder(path, added)(pa.array(texts)):
            at = np.r_[0, np.cumsum(n)]
            for i in range(len(n)):
                assert ids[at[i] : at[i + 1]].tolist() == t.encode(texts[lo + i] or "", add_special_tokens=False).ids


def test_top_k_segmentations_follow_sampling_without_replacement():
    v = lattice_sampling.Vocabulary(queries.tokenizer_path(queries.PIECES))
    n, k = 4000, 4
    ((_, data, off),) = flat.slices(pa.array(["thin"] * n))
    got = lattice_sampling.segment_slice(v, data, off, np.arange(n).astype(np.uint64), k, 5)
    drawn = [[tuple(int(x) for x in i) for i in columns["ids"]] for _, columns in got]
    prob = {}
    for (_, columns), ids in zip(got, drawn):
        prob |= {i: math.exp(p) for i, p in zip(ids, columns["log_prob"])}

    def chance(ids, taken):  # that the next one drawn is ids, once those are taken
        return 0 if ids in taken else prob[ids] / (1 - sum(prob[x] for x in taken))

    for sample in range(1, k):
        for ids in sorted(prob, key=prob.get)[-4:]:
            want = np.array([chance(ids, [drawn[j][x] for j in range(sample)]) for x in range(n)])
            assert abs(drawn[sample].count(ids) - want.sum()) < 5 * math.sqrt((want * (1 - want)).sum()) + 1
    weigh = [sum(math.exp(c["log_prob"][x]) / c["inclusion"][x] for _, c in got) for x in range(n)]
    assert abs(np.mean(weigh) - 1) < 0.1


def test_kept_lattices_change_nothing():
    v = lattice_sampling.Vocabulary(queries.tokenizer_path(queries.PIECES))
    kept = lattice_sampling.Kept(v)
    texts = [t or "" for t in made(40)]
    for lo in range(0, 40, 10):
        ((_, data, off),) = flat.slices(pa.array(texts[lo : lo + 10]))
        key = np.arange(lo, lo + 10).astype(np.uint64)
        for (t, a), (u, b) in zip(lattice_sampling.segment_slice(v, data, off, key, 3, 1), lattice_sampling.segment_slice(v, data, off, key, 3, 1, kept)):
            assert np.array_equal(t, u) and all(np.array_equal(x, y) for x, y in zip(a["ids"], b["ids"])) and np.array_equal(a["log_prob"], b["log_prob"])
    assert len(kept.names)


# ---- context mixing across words


def _shard(rng, size=400):
    k = np.sort(rng.integers(0, 20, size).astype(np.uint64))
    two, three = rng.integers(0, 4, size).astype(np.uint16), rng.integers(0, 3, size).astype(np.uint16)
    return k, two, three, rng.integers(0, 9, size) * rng.integers(0, 2, size), rng.integers(0, 3, size)


def _codes():
    return context_mixing.Codes(np.arange(8).astype(np.uint64) * 77 + 5, np.array([50, 30, 9, 9, 4, 2, 1, 1]), 6)


def test_codes_are_prefix_free_and_ordered():
    c = _codes()
    bits = [format(int(v), "032b")[:n] for v, n in zip(c.value, c.length)]
    assert bits == sorted(bits) and abs(sum(2.0**-n for n in c.length) - 1) < 1e-12
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)


def test_inputs_and_scores_of_a_shard_equal_plain_ones():
    rng = np.random.default_rng(8)
    k, two, three, t, n = _shard(rng)
    c = _codes()
    bits = [[int(x) for x in format(int(v), "032b")[:m]] for v, m in zip(c.value, c.length)]
    count = {}
    contexts = [[(1, k[i]), (2, k[i], two[i]), (3, k[i], two[i], three[i])] for i in range(len(t))]
    for i in range(len(t)):
        for ctx in contexts[i]:
            for d, b in enumerate(bits[t[i]]):
                count.setdefault((ctx, tuple(bits[t[i]][:d])), [0, 0])[b] += n[i]
    weights, seen, refine = context_mixing._code_weights(), np.zeros((2, context_mixing.DEPTHS, 16, 33)), None
    inputs = {}
    for live, bit, gate, x in context_mixing.code_bits(k, two, three, t, n, c):
        d = inputs and max(q for _, q in inputs) + 1 or 0
        for i, b, g, row in zip(live, bit, gate, zip(*x)):
            want, level = [], []
            for ctx in contexts[i]:
                z = list(count[ctx, tuple(bits[t[i]][:d])])
                z[b] -= n[i] > 0
                want.append(math.log(z[1] + 0.1) - math.log(z[0] + 0.1))
                level.append(sum(int(sum(z) >= x) for x in (1, 4, 64)))
            assert bits[t[i]][d] == b and g == level[1] * 4 + level[2] and np.allclose(row[1:], want, atol=1e-5)
            inputs[i, d] = (b, g, np.array([*map(float, row), context_mixing.BIAS]))
    got = context_mixing.code_scores(k, two, three, t, n, c)
    done = 0
    for d in range(int(c.length.max())):
        train = [i for i in range(len(t)) if (i, d) in inputs and n[i]]
        if not train:
            continue
        done += 1
        q = min(d, context_mixing.DEPTHS - 1)
        step, mass = np.zeros_like(weights[q]), np.ones(16)
        for i in train:
            b, g, row = inputs[i, d]
            dot = weights[q, g] @ row
            step[g] += (b - 1 / (1 + math.exp(-dot))) * math.sqrt(n[i]) * row
            mass[g] += math.sqrt(n[i])
            seen[b, q, g, int(np.clip(np.rint(np.float32(dot) * 2) + 16, 0, 32))] += n[i]
        weights[q] += context_mixing.RATE / math.sqrt(1 + done / 100) * step / mass[:, None]
    centre = 1 / (1 + np.exp(-(np.arange(33) - 16) / 2))
    refine = np.clip((seen[1] + 4 * centre) / (seen[0] + seen[1] + 4), 1e-6, 1 - 1e-6)
    near = 0
    for i in range(len(t)):
        want = 0.0
        for d in range(int(c.length[t[i]])):
            b, g, row = inputs[i, d]
            q = min(d, context_mixing.DEPTHS - 1)
            dot = weights[q, g] @ row
            p = (1 / (1 + math.exp(-dot)) + refine[q, g, int(np.clip(np.rint(dot * 2) + 16, 0, 32))]) / 2
            want += math.log10(p if b else 1 - p)
        near += abs(got[i] - want) < 1e-4
    assert near > 0.98 * len(t)  # but for odds that round to another step


def test_scores_see_the_order_of_words_and_no_size_setting(spark, monkeypatch):
    rng = random.Random(12)
    phrase = [[rng.choice(VOCABULARY) + str(rng.randrange(30)) for _ in range(12)] for _ in range(12)]
    rows = [(i, " ".join(w for _ in range(4) for w in rng.choice(phrase))) for i in range(150)]
    rows += [(200, " ".join(phrase[0] + phrase[1])), (201, " ".join((phrase[0] + phrase[1])[::-1]))]
    df = frame(spark, rows).withColumn("held", F.lit("clash")).withColumn("score", F.lit("clash"))
    run = lambda: {r["doc_id"]: r for r in context_mixing.score_documents(df).collect()}
    monkeypatch.setattr(context_mixing, "SHARD_TOKENS", 512)
    one = run()
    assert one[200]["n_tokens"] == one[201]["n_tokens"] and one[200]["score"] > one[201]["score"] + 5
    monkeypatch.setattr(context_mixing, "BUCKET_TOKENS", 512)
    two = run()
    assert all(abs(one[d]["score"] - two[d]["score"]) < 1e-4 for d in one)
    monkeypatch.setattr(context_mixing, "FLUSH_TOKENS", 300)
    three = run()
    assert all(abs(one[d]["score"] - three[d]["score"]) < 1e-4 for d in one)


def test_language_model_of_odd_tables(spark):
    assert context_mixing.score_documents(frame(spark).limit(0)).count() == 0
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 7 == 2][:5]
    only = context_mixing.score_documents(frame(spark, [(d, "no training text") for d in held])).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in only)
    rows = [(None, "a null id"), (None, "a null id"), (3, "a text twice"), (3, "a text twice"), (4, None), (5, "")]
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 5)) for r in context_mixing.score_documents(frame(spark, rows)).collect())
    assert len(got) == 6 and got[0] == got[1] and got[4] == got[5]


def test_sentence_spans_settle_within_and_across_sources(spark, monkeypatch):
    monkeypatch.setattr(sentence_spans, "FLUSH", 12)
    monkeypatch.setattr(sentence_spans, "SLICE", 300)
    rng = random.Random(9)
    said = [" ".join(rng.choice(VOCABULARY[:4]) + str(rng.randrange(50)) for _ in range(6)) + ". " for _ in range(14)]
    ids = rng.sample(range(100), 39)
    rows = [(d, "".join(rng.choices(said, k=rng.randrange(1, 7)))) for d in [None, *ids]]
    rows += rows[:4] + [(None, None), (109, "")]
    want = brute.without_repeated_sentences(rows, sentence_spans.SENTENCES, sentence_spans.MIN_WORDS)
    got = sentence_spans.drop_repeated_sentences(frame(spark, rows).withColumn("places", F.lit("clash"))).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((d, t if t is None else want[d, t])) for d, t in rows)


def test_leaks_do_not_depend_on_shards_of_items(spark, monkeypatch):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(6, 25))) + ". " + " ".join(rng.choices(pool, k=4)) for _ in range(45)]
    items = spark.createDataFrame([*enumerate(texts), (45, None), (46, ""), (3, texts[3]), (None, texts[7])], "item_id long, text string")
    rows = [(i, " ".join(rng.choices(pool, k=30)) + " " + rng.choice(texts) + " " + " ".join(rng.choices(pool, k=30))) for i in range(60)] + [(None, texts[1]), (70, None), (71, "")]
    run = lambda: {(r["doc_id"], r["text"]): [(x["item_id"], round(x["score"], 9), x["question_overlap"], x["answer_overlap"]) for x in r["leaks"]] for r in decontaminate.mark_leaks(frame(spark, rows), items).collect()}
    one = run()
    assert sum(map(len, one.values())) >= 61 and [x[0] for x in one[None, texts[1]]][:1] in ([1], [None])
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 10)
    assert run() == one


def test_outlier_rule_equals_a_plain_estimate(spark):
    rng = random.Random(11)
    rows = []
    for i in range(420):
        w = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(15, 60 + 200 * (i % 3)))]
        for _ in range(rng.choice([0, 0, 0, 1, 3, 20])):
            w[rng.randrange(len(w))] = rng.choice(["#", "$%", "a\nb\na\nb", "*" * 9])
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, "few"), (902, "x y z " * 40)]
    got = {r["doc_id"]: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    groups, vectors = {}, {}
    for d, t in rows:
        n, chars, symbols, lines, repeat = brute.quality(t)
        failed = n < 10 or 100 * repeat > 20 * n
        assert got[d]["base_failed"] == failed and (not failed or not got[d]["kept"])
        if not failed:
            vectors[d] = [math.log(n), math.log((chars + 1) / n), math.sqrt(symbols / (chars + 1)), math.log1p(lines), math.sqrt(repeat / n)]
            groups.setdefault((None if d % 7 == 0 else "en", d % 2), []).append(d)
    small = [g for g in groups if len(groups[g]) < quality.MIN_GROUP]
    assert len(small) == 2 and sum(len(groups[g]) for g in small) < quality.MIN_GROUP
    groups[None] = sum((groups.pop(g) for g in small), [])
    for own in groups.values():
        want = brute.mcd_distances(np.array([vectors[d] for d in own]), quality.FLOORS)
        for d, x in zip(own, want):
            assert abs(got[d]["distance"] - x) < 1e-3 * (1 + x) and got[d]["kept"] == (x <= quality.CUTOFF)
    assert 0 < sum(not got[d]["kept"] for d in vectors) < len(vectors) / 4


# ---- the pipeline


def test_pipeline_equals_its_stages_done_plainly(spark):
    import corpus_pipeline as cp

    docs = {r["doc_id"]: r.asDict() for r in queries.table(spark, SF, "documents").collect()}
    judged = {r["doc_id"]: r["kept"] for r in quality.quality_rules(queries.table(spark, SF, "documents"), keep=["doc_id", "lang", "source"]).collect()}
    kept = {d: r["text"] for d, r in docs.items() if judged[d]}
    by_source = {}
    for d in kept:
        by_source.setdefault(docs[d]["source"], []).append(d)
    for members in by_source.values():
        lines = [set((kept[d]).split("\n")) for d in members]
        often = {x for x in set().union(*lines) if x.strip(" \t\x0b\x0c\r") and (n := sum(x in s for s in lines)) >= line_dedup.MIN_PAGES and n > line_dedup.MAX_RATIO * len(members)}
        for d in members:
            kept[d] = "\n".join(x for x in kept[d].split("\n") if x not in often)
    groups = brute.linked(list(kept.items()), 5, 80)
    kept = {d: t for d, t in kept.items() if groups[d][1] == d}
    items = [r["text"] for r in queries.table(spark, SF, "benchmark").collect()]
    want = {d for d, t in kept.items() if not any(i in t for i in items)}
    rows = cp.run(spark, SF)
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == want
    stage = queries.table(spark, SF, "documents")
    for _, f in cp.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == {d: kept[d] for d in want}


def test_near_copies_with_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    base = lambda c: " ".join(f"{c}{i}" for i in range(60))
    a, b, c, d, e, f = map(base, "abcdef")
    rows = [(5, a), (None, a + " end"), (None, b), (None, c), (None, c), (None, c + " end"), (None, None), (None, " "), (None, ""), (1, d), (2, d + " end"), (2, e), (3, f), (3, f + " end"), (3, f), (4, "")]
    df = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    got = sorted((r["doc_id"] or -1, str(r["text"])) for r in cp.one_of_each(spark, df, SF).collect())
    lone = [t for i, t in got if i == -1]
    assert len(lone) == 5 and b in lone and sum(t in (c, c + " end") for t in lone) == 1 and {"None", " ", ""} <= set(lone)
    named = [r for r in got if r[0] != -1]
    assert [r for r in named if r[0] != 3] == [(1, d), (2, e), (4, ""), (5, a)]
    assert [t for i, t in named if i == 3] in ([f, f], [f + " end"])


@pytest.mark.parametrize("rows", [[], ROWS[-14:] + [(None, None), (None, "a b c " * 9), (3, "x"), (3, "x"), (3, "y")]], ids=["empty", "odd"])
def test_pipeline_stages_take_odd_tables(spark, rows):
    import corpus_pipeline as cp

    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("kept", "distance", "leaks", "n_lines", "id", "c", "tie", "__id"):
        docs = docs.withColumn(name, F.lit("clash"))
    texts = {t for _, t in rows}
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == cp.COLUMNS
        assert {r["text"] for r in got.collect()} <= texts
    got = cp.STAGES[-1][1](spark, docs, SF)
    assert (got.count() == 0) == (not rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = queries.QUERIES[name](spark, SF)
    cursor = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    pick = [columns.index(x) for x in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in pick)) for r in cursor.fetchall())
