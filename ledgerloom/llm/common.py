"""Helpers that the operators of this subpackage share.

Texts reach the Python tasks as Arrow columns.  ``text_bytes`` exposes a column as one byte
buffer with offsets, and ``word_spans`` finds and hashes all its words with numpy, block by
block, so that memory stays bounded for very long texts too.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

_own_dir: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is missing a temporary folder takes its place, in local mode only.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return _own_dir[0]


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path of the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Remove the shuffle files of a query when it ends, here of a write whose rows are read from its folder afterwards.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, folders: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage and its shuffle files end there.

    The folder is added to ``folders``, so that the caller can remove it with ``clear_path``.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    if folders is not None:
        folders.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_name(name: str, taken: list[str]) -> str:
    """``name`` behind as many underscores as tell it from the columns in ``taken``, upper and lower case aside."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


#: What operators keep in a worker between tasks, by operator.
caches: dict[str, dict] = {}


def lean_worker(keep: str = "") -> None:
    """Free what other operators have kept in this worker, and give the memory back."""
    for name, kept in caches.items():
        if name != keep:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_key(col: str | Column = "text") -> Column:
    """A 64-bit key of a text; a null text has the key of the empty one."""
    return F.xxhash64(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))


#: Odd constants of the 64-bit mixing function and of the polynomial word hash.
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20260101)).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that belong to words: all but ASCII white space; or ASCII letters, digits and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_powers: list[np.ndarray] = []
BLOCK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        inverse = pow(int(_BASE), -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, np.uint64(inverse))]
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 offsets of its rows; nulls are empty."""
    column = pa.array(column) if not isinstance(column, pa.Array) else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray = NOT_SPACE, block: int = BLOCK, lower: bool = True):
    """Start, end, row and 64-bit hash of each word of the rows that ``text_bytes`` gives.

    ``kind`` tells which bytes belong to words.  A-Z are hashed as a-z if ``lower``.
    """
    out = []
    bounds = offs[(offs > 0) & (offs < len(buf))]
    s = 0
    while s < len(buf):
        e = min(s + block, len(buf))
        if e < len(buf) and kind[buf[e - 1]] and kind[buf[e]]:
            back = np.flatnonzero(~kind[buf[s:e]])
            row = bounds[np.searchsorted(bounds, e, "right") - 1] if len(bounds) and bounds[0] <= e else 0
            cut = max(s + back[-1] + 1 if len(back) else 0, row)
            if cut <= s:  # one word fills the block: it goes on to its end
                ahead = e
                while ahead < len(buf) and kind[buf[ahead]]:
                    step = np.flatnonzero(~kind[buf[ahead : ahead + block]])
                    ahead = ahead + step[0] if len(step) else min(ahead + block, len(buf))
                nxt = np.searchsorted(bounds, s, "right")
                cut = min(ahead, bounds[nxt] if nxt < len(bounds) else len(buf))
            e = int(cut)
        part = buf[s:e]
        m = kind[part]
        first, last = m.copy(), m.copy()
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        inner = bounds[(bounds > s) & (bounds < e)] - s
        first[inner] = m[inner]
        last[inner - 1] = m[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        p, inv = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[LOWER[part] if lower else part] * p[: len(part)], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
        out.append((starts + s, ends + s, hashes))
        s = e
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends, hashes = (np.concatenate([x[i] for x in out]) for i in range(3))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, hashes


def row_blocks(offs: np.ndarray, block: int = BLOCK, most: int = 4096):
    """Runs of at most ``most`` rows (from, to) of about ``block`` bytes; a longer row is a run of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + block, "right")) - 1)
        j = min(j, n, i + most)
        yield i, j
        i = j


def sorted_pairs(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) with their counts, in order; rows below 4096, values cut to 52 bits."""
    bits = np.uint64(52)
    key = np.sort((rows.astype(np.uint64) << bits) | (values >> np.uint64(12)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    key = key[at]
    return (key >> bits).astype(np.int64), key & ((np.uint64(1) << bits) - np.uint64(1)), np.diff(np.append(at, len(first)))
