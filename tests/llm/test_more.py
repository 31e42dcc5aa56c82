"""Clustering, alignment, personal data and leaks against plain versions."""

import hashlib
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from eventloom.llm import context_mixing, contextual_pii, decontaminate, flat, lattice_sampling, pivot_clustering, quality, queries, suffix_dedup, token_alignment, token_files  # noqa: E402

SF = "/root/testdata/sf0.001"
A, B = queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.PIECES)


# ---- 1


def test_segmentation_query_decodes_what_it_encodes(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = queries.op1_lattice_sampling(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    assert all(r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)
    monkeypatch.setattr(lattice_sampling, "DECODED", 500)
    ids = lattice_sampling.sample_segmentations(docs.limit(40), B, F.col("doc_id"), keep=["doc_id", "lang"]).drop("doc_id").withColumn("lang", F.lit("x"))
    ids = ids.unionByName(ids.limit(1).withColumn("ids", F.lit(None)), allowMissingColumns=True)
    back = lattice_sampling.decode_ids(ids, B).collect()
    assert {r["text"] for r in back} <= {*texts.values(), None} and sum(r["text"] is None for r in back) == 1


def test_pieces_are_followed_byte_by_byte_from_their_first():
    import sentencepiece

    v = lattice_sampling.Vocabulary(B)
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces = {i: v.bytes[i] for i in range(sp.get_piece_size()) if (v.node_ids == i).any()}
    assert len(pieces) > 30_000
    prefixes = {p[:k] for p in pieces.values() for k in range(1, len(p) + 1)}
    assert len(prefixes) == len(v.node_ids) - 1 == (v.edge >= 0).sum()
    rng = random.Random(7)
    asked = [*pieces.values(), *(bytes(rng.choices(range(256), k=3)) for _ in range(3000)), *(p + bytes([rng.randrange(256)]) for p in rng.sample([*pieces.values()], 3000))]
    node, there = np.zeros(len(asked), np.int32), np.ones(len(asked), bool)
    for k in range(max(map(len, asked))):
        live = np.flatnonzero([len(x) > k and t for x, t in zip(asked, there, strict=True)])
        node[live] = v.follow(node[live], np.array([asked[i][k] for i in live], np.uint8))
        there[live] = node[live] > 0
    assert there.tolist() == [x in prefixes for x in asked]
    assert v.node_ids[node[: len(pieces)]].tolist() == list(pieces)


# ---- 4


@pytest.mark.parametrize("left, right", [('"', '"'), ("(", ")"), ("x", "y"), ("", ". "), ("«", "»"), ("", ",")])
def test_items_are_found_whatever_touches_them(left, right):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from eventloom.llm.flat import slices

    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    texts = [t or "" for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()]
    index = decontaminate.Index([r["item_id"] for r in items], [r["text"] for r in items])
    column = pa.array([f"{texts[k][:200]} {left}{r['text']}{right} {texts[-k][:300]}" for k, r in enumerate(items)])
    found = {(lo + d, index.ids[i]) for lo, data, off in slices(column) for d, i in index.leaks(data, off, decontaminate.THRESHOLD, decontaminate.OVERLAP)}
    assert all((k, r["item_id"]) in found for k, r in enumerate(items))


def test_leaks_are_those_of_a_plain_search(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    items = [(i, text(rng.randrange(3, 25))) for i in range(30)] + [(90, None), (91, ""), (92, items_ := "Who? Me"), (92, items_)]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(1, 90)), rng.choice(['"', "(", "", "x"]) + (rng.choice(items)[1] or "") + rng.choice(['"', ")", "", "y", "."]), text(rng.randrange(1, 60))]
        docs.append(" ".join(parts) if i % 3 else parts[0])
    docs += [None, "", " "]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, leaks string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], x["item_id"]) for r in decontaminate.mark_leaks(frame, table, threshold=0.5).collect() for x in r["leaks"]}
    want = brute.leaks(items, docs, 0.5, decontaminate.OVERLAP)
    assert (got - want, want - got) == (set(), set()) and len(got) > 20


# ---- 11


def vectors():
    rng = random.Random(1)
    near = lambda c: [c + rng.uniform(-0.2, 0.2) for _ in range(64)]
    rows = [(i, near(i % 5 - 2)) for i in range(150)] + [(1000 + i, [0.0] * 64) for i in range(20)] + [(7, near(9)), (7, near(9)), (None, near(-9)), (None, near(3))]
    return rows + [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [0.0] * 63), (2004, [float("nan")] + [0.0] * 63), (2005, [float("-inf")] + [0.0] * 63)]


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 1), (500, 2)])
def test_clusters_are_those_of_all_distances(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame([(d, v, 1, "p", 2.0) for d, v in rows], "vec_id long, embedding array<float>, cluster int, p string, distance double").repartition(5)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]  # as 32-bit numbers
    assigned, centroids = pivot_clustering.cluster_vectors(df, k, rounds)
    want, middle = brute.clusters(rows, k, rounds)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, assigned.collect()), key=key) == sorted(want, key=key) and centroids.tolist() == middle


def test_cluster_digest_and_empty_tables(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    assigned, centroids = pivot_clustering.cluster_vectors(df)
    rows = pivot_clustering.cluster_digest(assigned, centroids).collect()
    total = sum(r["distance"] for r in rows)
    for r in rows:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(x["distance"] for x in rows if x["cluster"] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()
    none = pivot_clustering.cluster_digest(*pivot_clustering.cluster_vectors(df.limit(0)))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_pivots_leave_centroids_out_and_lose_none():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-4000, 4000, (8, 64))
    x = (centroids[rng.integers(0, 8, 4000)] + rng.integers(-200, 200, (4000, 64))).astype(np.int64)
    x[:8] = centroids  # distance 0
    pivots = x[100:108]
    got, best, asked = pivot_clustering.nearest(x, pivot_clustering.roots(x, pivots), centroids, pivot_clustering.roots(centroids, pivots))
    far = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert np.array_equal(got, far.argmin(1)) and np.array_equal(best, far.min(1)) and asked < 2 * len(x)
    big = np.array([[pivot_clustering.LARGEST] * 64, [-pivot_clustering.LARGEST] * 64])
    assert pivot_clustering.squared(big[:1], big[1]).tolist() == [64 << 56]


# ---- 12

ODD = [(None, None), (-1, ""), (-1, " "), (-2, "a  b \n c\r\n;\r x"), (-3, "\n\nfoo"), (-4, "x \n\n y"), (-5, "a▁b"), (-6, "<|endoftext|> <s> </s>"), (-7, "日本語 テスト  \t x"), (-8, "\x00nul\x00 ;\r\n\r\n  a"), (-9, "word "), (-10, "x" * 5000), (-11, "  "), (-12, "\r a \x1c b"), (-13, "ab  \t\t  cd\v\f e"), (-14, "é   z  "), (-14, "é   z  "), (-15, "a \n\nb   c")]


@pytest.mark.parametrize("limit", [token_alignment.BROADCAST_BYTES, 0])
def test_alignment_is_that_of_whole_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(token_alignment, "FAN", 3)
    monkeypatch.setattr(token_alignment, "HELD", 500)
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD
    want, counts = brute.aligned(texts, A, B)
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, n_links int").repartition(12)
    got = token_alignment.align_documents(df, A, B, broadcast_bytes=limit)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert all(r["groups"] == "" and r["n_a"] == 0 for r in got.filter("doc_id = -5").collect())
    if limit:
        pairs = token_alignment.pair_rows(token_alignment.count_pairs(df, A, B)).collect()
        assert {(r["a"], r["b"]): r["n"] for r in pairs} == dict(counts)
        assert token_alignment.align_documents(df.limit(0), A, B).collect() == []


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        place = token_alignment.PerfectHash.of(keys)
        assert sorted(place(keys).tolist()) == list(range(len(keys)))
    ordered = np.empty_like(keys)
    ordered[place(keys)] = keys
    others = keys + np.uint64(1 << 50)
    at = place(others)
    assert not (ordered[at[at >= 0]] == others[at >= 0]).any()
    forced = token_alignment.PerfectHash(np.zeros(0, np.int64), np.zeros(0, np.uint64), keys)  # all levels used up
    assert np.array_equal(forced(keys), np.arange(len(keys))) and (forced(others) == -1).all()


def test_linked_pairs_end_alike():
    a, b = token_alignment.byte_tokens(A), token_alignment.piece_tokens(B)
    _, counts = brute.aligned([(r, t) for r, t in ODD] + [(1, "Reading alignments, they are: naïve!")], A, B)
    assert all(a[x].endswith(b[y]) or b[y].endswith(a[x]) for x, y in counts)
    assert token_alignment.most_pairs({0: b"ab", 1: b"b"}, {0: b"b", 1: b"xab", 2: b"c"}) == 4


# ---- 13


def told():
    rng = random.Random(1)
    w = ["sun", "moon", "river", "stone", "glass"]
    rows = [(None, None), (-1, ""), (-1, " "), (-2, "a@b.c_d@e.f a@b.c.@d.e 9.9.1.2.3.4.5.6 999.1.1.1 0001.02.3.255"), (-3, "😀 x@y.z 😀😀 +1 (017) 555-7713 4111 1111 1111 1111 é 4111-1111-1111-1112"), (-4, "1 " * 2000 + "1.1.1." * 2000), (-5, "x" * 20000 + "@" + "y" * 20000 + ".c"), (-6, "+1" + " " * 5000 + "+12 +1-2-3-4-5-6-7-8-9 "), (-7, "a.b-" * 5000), (-8, "a1-" * 4000), (-9, "(0" * 4000 + "@@@@ a@@b.c"), (-9, "(0" * 4000 + "@@@@ a@@b.c")]
    for i in range(60):
        t = " ".join(rng.choice(w) for _ in range(12))
        said = [f" write me at u{i}@mail.example.org ", " please write me at " + (f"v{i}(at)mail(dot)example " if i < 12 else f"z{i}@a.b") + " ", f" call desk: +49 30 {1000000 + i * 7919} ", " call desk: " + (f"555-{1000 + i}-22 " if i < 30 else f"+1 222 333 {4000 + i}"), f" host at 10.0.0.{i} ", f" number 12345678{i} "]
        rows.append((1000 + i, t + said[i % 6] + t))
    return rows


def test_personal_data_and_contexts_are_those_of_a_plain_version(spark):
    rows = told() + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, kind string").repartition(4)
    found = contextual_pii.personal_data(df)
    counts = [contextual_pii.span_count(F.col("base"), k) for k in range(4)]
    got = found.select("doc_id", *counts, contextual_pii.spans_text(F.col("base")), contextual_pii.spans_text(F.col("spans"))).collect()
    want = brute.personal(rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    new = {r[0]: r[6] for r in want if r[5] != r[6]}
    assert {1001, 1003, 1007, 1009, 1015, 1021, 1027} == set(new)  # found by what stands before them alone
    assert contextual_pii.personal_data(df.limit(0)).collect() == []


def test_contexts_with_other_followers_find_nothing(spark):
    rows = [(i, f"the of u{i}@x.org and the of {'abcdefghij'[i % 10] * (i + 1)} thing") for i in range(20)] + [(99, "the of me(at)there(dot)org")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["base"] == r["spans"] for r in contextual_pii.personal_data(df).collect())
    told_ = [(i, f"the of u{i}@x.org") for i in range(20)] + [(99, "the of me(at)there(dot)org")]
    last = contextual_pii.personal_data(spark.createDataFrame(told_, "doc_id long, text string")).filter("doc_id = 99").first()
    assert last["base"] == [] and [tuple(x) for x in last["spans"]] == [(7, 0, 26)]


# ---- 7


def test_pieces_lie_on_disk_once_and_their_bytes_are_told_before(spark, monkeypatch):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    lines = [letters(160) for _ in range(40)]
    rows = [(i, letters(30) + rng.choice(lines) + letters(40) + rng.choice(lines[:2])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tags, stage = [], suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, tag: tags.append(tag) or stage(df, tag))
    got = suffix_dedup.drop_repeated_bytes(df).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute.repeated_bytes(rows))
    assert sorted(tags) == ["covered", "covered-places", "shared-values"]  # the pieces themselves are only shuffled
    docs = suffix_dedup._texts(df, "doc_id", "text")
    told = suffix_dedup.shared_values(docs, 4)
    size = {r["key"]: r["size"] for r in told.filter("shared IS NULL").collect()}
    there = docs.join(told.filter("shared IS NOT NULL").withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("id", "tie", "text", "shared")
    real = dict.fromkeys(size, 0)
    for r in there.mapInArrow(suffix_dedup._piece_blocks(4), "bucket int, source long, block binary").filter("bucket IS NOT NULL").collect():
        real[r["bucket"]] += len(suffix_dedup.unpack(r["block"])[1])
    assert all(0.6 * real[b] <= size[b] for b in size) and sum(size.values()) < 20 * sum(real.values())


def test_grams_that_meet_by_chance_send_no_pieces_and_shuffles_go(spark, monkeypatch):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    short, line = "a common run of 30 bytes only.", letters(70)
    rows = [(i, letters(60) + short + letters(60)) for i in range(200)] + [(i, letters(50) + line + letters(50)) for i in range(200, 204)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = suffix_dedup.shared_values(suffix_dedup._texts(df, "doc_id", "text"), 4).filter("shared IS NOT NULL").collect()
    assert 4 <= len(told) < 20  # nearly all 204 by their grams alone
    conf, seen, stage = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, tag: seen.append(spark.conf.get(conf)) or stage(df, tag))
    before = spark.conf.get(conf)
    got = suffix_dedup.drop_repeated_bytes(df).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute.repeated_bytes(rows))
    assert seen == ["true"] * 3 and spark.conf.get(conf) == before


def test_equal_strings_agree_in_a_check():
    rng = random.Random(1)
    for alphabet in ("a", "ab", "abc", "abcdefgh ", " aé", "\0b"):
        letters = lambda n: "".join(rng.choice(alphabet) for _ in range(n))  # noqa: E731, B023
        base = [letters(rng.randrange(30, 160)) for _ in range(4)] + ["ab" * 70, "a" * 120, "abc" * 50]
        texts = ["".join(rng.choice([rng.choice(base), letters(rng.randrange(40))]) for _ in range(rng.randrange(1, 6))) for _ in range(12)]
        ((_, data, off),) = flat.slices(pa.array(texts))
        x, doc, _ = suffix_dedup.checked_values(data, off)
        order = np.argsort(x)
        hit = order[suffix_dedup._shared(x[order], doc[order], np.zeros(len(x), bool))]
        told = set(zip(doc[hit].tolist(), (x[hit] >> np.uint64(2 * suffix_dedup.CHECK)).tolist()))
        least = [int(v) >> 2 * suffix_dedup.CHECK for v, n in zip(*(c.tolist() for c in suffix_dedup.pieces(data, off)[::2])) for _ in range(n)]
        there = {}
        for i, t in enumerate(texts):
            b = t.encode()
            for j in range(len(b) - suffix_dedup.LENGTH + 1):
                there.setdefault(b[j : j + suffix_dedup.LENGTH], set()).add((i, least.pop(0)))
        assert not least
        for owners in there.values():
            assert len({i for i, _ in owners}) == 1 or owners <= told


# ---- 10


def test_codes_are_found_by_the_top_bits_of_their_hashes():
    rng = np.random.default_rng(5)
    near = np.uint64(7 << 50) + np.arange(9, dtype=np.uint64)  # one place of the table
    h = np.unique(np.r_[rng.integers(0, 1 << 64, 3000, np.uint64), near, np.uint64(0), np.uint64((1 << 64) - 1)])
    codes = context_mixing.Codes(h, np.full(len(h), 5), 3)
    assert codes.most >= len(near) and len(codes.first) == 1 << 17
    asked = np.r_[h, rng.integers(0, 1 << 64, 3000, np.uint64), near + np.uint64(20)]
    known, at = codes.find(asked)
    assert known.tolist() == np.isin(asked, h).tolist() and (codes.names[at[known]] == asked[known]).all()


def test_sums_by_number_do_not_depend_on_how_far_numbers_lie():
    source, value = np.array([3, 1, 3, 3, 1]), np.array([0.5, 2.0, 0.25, 1.0, 4.0])
    for local in ([2, 0, 2, 1, 1], [900, 7, 900, 3, 9000]):
        out = {s: [x.tolist() for x in suffix_dedup.unpack(b)] for s, b in context_mixing._by_local(source, np.array(local), value)}
        assert out == {1: [[local[1], local[4]], [2.0, 4.0]], 3: [[local[3], local[0]], [1.0, 0.75]]}


# ---- 6


def test_statistics_of_a_large_batch_need_little_memory():
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"w{(i * 7 + j * j) % 900}" for j in range(400)) for i in range(1500)]
    column = pa.array([*texts, None, ""])
    tracemalloc.start()
    got = quality.column_statistics(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and len(got["n_words"]) == 1502
    plain = [quality.column_statistics(pa.array([t])) for t in [*texts[::300], None, ""]]
    assert all(got[s][[*range(0, 1500, 300), 1500, 1501]].tolist() == [int(x[s][0]) for x in plain] for s in quality.STATS)


# ---- 9


def test_words_before_a_mark_are_spelled_with_those_alone():
    encode = token_files.Encoder(A, True)

    class Counting:
        asked: list[str] = []
        model = encode.model

        def tokenize(self, word):
            self.asked.append(word)
            return self.model.tokenize(word)

    encode.model = Counting()
    parts = [" qzxvam", " qzxvam,", " qzxvam.", "qzxvam!", " čtvrtekův", " čtvrtekův;", " don't", " 12,", "\n", "\n\n", " a\tb", "...", ",", " 日本", "x", " "]
    want = [np.array(encode.tokenizer.encode(x, add_special_tokens=False).ids, encode.kind).tobytes() for x in parts]
    assert encode._ids([x.encode() for x in parts]) == want and encode._ids([x.encode() for x in parts]) == want
    assert encode._ids([b" wobblux;", b" wobblux"]) == [encode._whole(" wobblux;"), encode._whole(" wobblux")]
    assert len(Counting.asked) == len(set(Counting.asked))
