"""URL filters: allow and block rules, and block lists held in a cascade of Bloom filters.

``split_url`` finds host and path; ``rule_for`` picks the longest rule that fits.  A block list of
domains and of host + path keys is put in a Bloom filter cascade over the corpus's complete key
universe: level 1 holds the listed keys, level 2 those other keys that level 1 wrongly accepts,
level 3 the listed keys that level 2 wrongly accepts, and so on until no key errs.  For every key of
the universe the first level that rejects it tells its membership exactly, so pages are judged
where they lie, without a join.  Keys are dealt by hash over shards of bounded size, each with a
cascade of its own, built in parallel.

Cases: a null url, or one without ``://``, has an empty host and path and is allowed unless a rule
says otherwise; repeated urls are judged alike; an empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import U, mix
from .shared import BROADCAST_BYTES, stage

#: Keys of the universe in a shard, and bits for a key on level 1 and on later levels.
SHARD_KEYS = 500_000
BITS, LATER_BITS, HASHES, LATER_HASHES = 12, 4, 6, 2
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOW), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of the (verdict, host, path) rules that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_keys(host: Column, path: Column) -> Column:
    """The keys under which a page may be listed: its host, each parent domain, host + path."""
    parts = F.split(host, "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_append(domains, F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))))


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _bits(h: np.ndarray, level: int, m: int, k: int) -> np.ndarray:
    """Places of k bits for each hash among m, by double hashing with a seed for each level."""
    a = mix(h ^ U(0x9E3779B97F4A7C15 * (2 * level + 1) & (2**64 - 1)))
    b = mix(a) | U(1)
    return (a[:, None] + np.arange(k, dtype=U) * b[:, None]) % U(m)


def _level(h: np.ndarray, level: int) -> bytes:
    bits, k = (BITS, HASHES) if level == 0 else (LATER_BITS, LATER_HASHES)
    m = max(64, bits * len(h))
    field = np.zeros(m, bool)
    field[_bits(h, level, m, k).ravel().astype(np.int64)] = True
    return np.array([m, k], "<u8").tobytes() + np.packbits(field).tobytes()


def _accepts(filter_: bytes, h: np.ndarray, level: int) -> np.ndarray:
    m, k = map(int, np.frombuffer(filter_, "<u8", 2))
    at = _bits(h, level, m, k)
    byte = np.frombuffer(filter_, np.uint8, offset=16)[(at >> U(3)).astype(np.int64)]
    return ((byte >> (U(7) - (at & U(7))).astype(np.uint8)) & 1).all(axis=1)


def build_levels(listed: np.ndarray, others: np.ndarray) -> list[bytes]:
    """The cascade for distinct hashes: alternately the keys to accept and the false positives."""
    levels: list[bytes] = []
    inside, outside = listed, others
    while len(inside):
        levels.append(_level(inside, len(levels)))
        inside, outside = outside[_accepts(levels[-1], outside, len(levels) - 1)], inside
    return levels


def member(levels: list[bytes], h: np.ndarray) -> np.ndarray:
    """Whether each hash is listed: the parity of the first level that rejects it."""
    out, open_ = np.zeros(len(h), bool), np.arange(len(h))
    for i, f in enumerate(levels):
        yes = _accepts(f, h[open_], i)
        out[open_[~yes]] = i % 2 == 1
        open_ = open_[yes]
    out[open_] = len(levels) % 2 == 1
    return out


def build_cascade(universe: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """Both inputs have one column of keys.  Returns (shard, levels) rows and the number of shards.

    Two keys of one hash (64 bits) count as one key."""
    keys = (
        universe.select(_hash(universe[universe.columns[0]]).alias("h"), F.lit(0).alias("listed"))
        .union(listed.select(_hash(listed[listed.columns[0]]).alias("h"), F.lit(1).alias("listed")))
        .groupBy("h")
        .agg(F.max("listed").alias("listed"))
    )
    keys = stage(keys, "url-keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h, yes = pdf["h"].to_numpy(np.int64).view(U), pdf["listed"].to_numpy() == 1
        h, yes = h[o := np.argsort(h)], yes[o]
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "levels": [build_levels(h[yes], h[~yes])]})

    of = keys.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    return stage(of.groupBy("shard").applyInPandas(build, "shard int, levels array<binary>"), "url-cascade"), shards


def listed_pages(pages: DataFrame, keys: str, cascade: DataFrame, shards: int, out: str) -> DataFrame:
    """pages with the boolean `out`: whether any of the strings in the array column `keys` is listed.

    The cascade is broadcast if its measured size is bounded; beyond that, distinct keys meet their
    shard's cascade in one task and the listed ones are joined to the pages."""
    kept = [c for c in pages.columns if c != out]
    size = cascade.agg(F.coalesce(F.sum(F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))), F.lit(0))).first()[0]
    if size < BROADCAST_BYTES:
        table = pages.sparkSession.sparkContext.broadcast({r["shard"]: [bytes(x) for x in r["levels"]] for r in cascade.toLocalIterator()})

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = b.column("__h")
                col = col.cast(pa.large_list(pa.int64()))
                flat = col.flatten().to_numpy(zero_copy_only=False)
                n = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                yes = np.zeros(len(flat), bool)
                shard = np.mod(flat, shards)
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    yes[at] = member(table.value.get(int(s), []), flat[at].view(U))
                hit = np.bincount(np.repeat(np.arange(len(n)), n), yes, len(n)) > 0
                rest = [b.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(hit)], schema=pa.schema([*(b.schema.field(c) for c in kept), pa.field(out, pa.bool_())]))

        schema = pages.select(*kept).withColumn(out, F.lit(True)).schema
        return pages.withColumn("__h", F.transform(keys, _hash)).mapInArrow(judge, schema)

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        h = left["__key"].to_numpy(np.int64)
        levels = [bytes(x) for x in right["levels"].iloc[0]] if len(right) else []
        return pd.DataFrame({"__key": h[member(levels, h.view(U))]})

    asked = pages.select(F.explode(F.transform(keys, _hash)).alias("__key")).distinct().withColumn("shard", F.pmod(F.col("__key"), F.lit(shards)).cast("int"))
    found = asked.groupBy("shard").cogroup(cascade.groupBy("shard")).applyInPandas(probe, "__key long")
    row = F.sha2(F.to_json(F.struct(F.col(keys))), 256)
    marked = pages.withColumn("__row", row)
    hits = marked.select("__row", F.explode(F.transform(keys, _hash)).alias("__key")).distinct().join(found, "__key", "left_semi").select("__row").distinct().withColumn(out, F.lit(True))
    return marked.drop(out).join(hits, "__row", "left").select(*kept, F.coalesce(out, F.lit(False)).alias(out))


def filter_urls(pages: DataFrame, url: str, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """pages with host, path, rule (or null) and verdict: that of the longest rule that fits, else
    block for pages with a listed key and allow for the rest."""
    host, path = split_url(F.col(url))
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    base = base.withColumn("__keys", url_keys(F.col("host"), F.col("path")))
    universe = base.select(F.explode("__keys").alias("key")).distinct()
    cascade, shards = build_cascade(universe, listed.join(universe, listed[listed.columns[0]] == universe["key"], "left_semi"))
    judged = listed_pages(base, "__keys", cascade, shards, "__listed").withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    return judged.select(
        *[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"),
    )
