"""Shared storage, size checks and packed exchange of numpy columns between Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from inspect import signature

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path

#: A table is broadcast only if its measured bytes stay under this; beyond it, it is joined by a shuffle.
BROADCAST_BYTES = 48 << 20


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when it ends, not when the driver next collects its garbage."""
    names = [f"spark.sql.{kind}.shuffleDependency.fileCleanup.enabled" for kind in ("classic", "connect")]
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "true")
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def joinable(df: DataFrame, size: str) -> DataFrame:
    """df, marked for broadcast if the sum of the SQL expression `size` (bytes of a row) is under BROADCAST_BYTES."""
    total = df.agg(F.expr(f"coalesce(sum({size}), 0)").alias("n")).first()["n"]
    return F.broadcast(df) if total < BROADCAST_BYTES else df


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def pack(*arrays: np.ndarray) -> bytes:
    """One compressed block of several one-dimensional arrays; bytes of equal significance lie together."""
    head = [np.array([len(arrays)], "<u4").tobytes()]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(a.dtype.str[1:].encode().ljust(4) + np.array([len(a)], "<u8").tobytes())
        k = a.dtype.itemsize
        body.append(a.tobytes() if k == 1 else np.ascontiguousarray(a.view(np.uint8).reshape(-1, k).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    at, out = 4 + 12 * count, []
    for i in range(count):
        kind = np.dtype(raw[4 + 12 * i : 8 + 12 * i].decode().strip())
        n = int(np.frombuffer(raw, "<u8", 1, 8 + 12 * i)[0])
        part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        if kind.itemsize > 1:
            part = np.ascontiguousarray(part.reshape(kind.itemsize, n).T).reshape(-1).view(kind)
        out.append(part)
        at += n * kind.itemsize
    return out


def merged(blocks: Iterable[bytes]) -> list[np.ndarray]:
    """The arrays of several blocks, each column concatenated."""
    return [np.concatenate(x) for x in zip(*map(unpack, blocks), strict=True)]


def binary_rows(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of runs of values, from each place of `at` to the next."""
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * values.dtype.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, row numbers) for each bucket that occurs; keeps the order of rows."""
    order = np.argsort(bucket, kind="stable")
    of = bucket[order]
    if not len(of):
        return
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for lo, hi in zip(cuts, [*cuts[1:], len(of)], strict=True):
        yield int(of[lo]), order[lo:hi]


def release() -> None:
    """Gives memory that this Python worker no longer uses back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """A mapInArrow function that releases memory after each batch it yields and at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        for b in run(batches):
            yield b
            release()
        release()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """A function of groups that releases memory after each group."""

    def one(pdf):  # Spark looks at the number of parameters
        try:
            return run(pdf)
        finally:
            release()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            release()

    return two if len(signature(run).parameters) == 2 else one
