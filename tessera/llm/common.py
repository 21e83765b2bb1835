"""Shared helpers: table access, checkpointing, and vectorised word hashing.

Text reaches the numpy helpers as Arrow buffers, so no Python string is built
per document or word. Every helper works on chunks of a bounded number of
bytes (one document at least), which keeps a Python worker's memory
independent of the Arrow batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_C = ctypes.CDLL(None)
CHUNK_BYTES = 1 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java form of the word pattern and of the white space around words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts the lineage and survives
    the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Documents are some KB a row: 10,000 of them, Arrow's default, are tens of
    MB on both sides of the pipe. A value that the user has set is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def small_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in parts, so that few texts become Python strings at once."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on through many
    stages, and what its allocators keep counts against the executor."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):   # glibc
        _C.malloc_trim(0)


def tidy(fn):
    """A function of one or two tables that gives its memory back at the end."""
    if fn.__code__.co_argcount == 1:
        def one(table):
            try:
                return fn(table)
            finally:
                give_back()
        return one

    def two(table, other):
        try:
            return fn(table, other)
        finally:
            give_back()
    return two


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; a text of ASCII alone takes the fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name += "_"
    return name


# --------------------------------------------------------------------------
# numpy helpers
# --------------------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of the public splitmix64 generator."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTE_VALUE_LOWER = _BYTE_VALUE.copy()
_BYTE_VALUE_LOWER[65:91] = _BYTE_VALUE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept to the end
    of the task or group."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.ones(1, dtype=np.uint64)
        while len(got) < n:
            got = np.concatenate([got, got * np.uint64(pow(base, len(got), 1 << 64))])
        if len(got) <= 4 * CHUNK_BYTES:
            _powers[base] = got
    return got[:n]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def doc_chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, one row at least."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


class Words:
    """Word spans and 64-bit word hashes of documents ``a..b`` of a batch.

    start/end: byte positions inside the chunk; first[d]..first[d+1]: the words
    of document ``a + d``.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, a: int, b: int, lower: bool = False):
        buf = raw[off[a]:off[b]]
        self.buf = buf
        edge = off[a:b + 1] - off[a]
        n = len(buf)
        ink = ~_SPACES[buf]
        begins, ends = ink.copy(), ink.copy()
        if n:
            begins[1:] &= ~ink[:-1]
            ends[:-1] &= ~ink[1:]
            inner = edge[(edge > 0) & (edge < n)]
            begins[inner] = ink[inner]
            ends[inner - 1] = ink[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, edge, side="left")
        self.lower = lower
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.buf)
            value = (_BYTE_VALUE_LOWER if self.lower else _BYTE_VALUE)[self.buf]
            value *= powers(_BASE, n)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(value, out=total[1:])
            span = total[self.end] - total[self.start]
            span *= powers(_INVERSE, n)[self.start] if n else np.uint64(1)
            self._hash = mix64(span + (self.end - self.start).astype(np.uint64))
        return self._hash


def window_hash(word: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries of ``word``; entry i covers
    i..i+k-1, so the caller leaves out runs that cross a document edge."""
    n = len(word)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    base = _BASE + 2 * seed
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix64(word ^ np.uint64(seed)) * powers(base, n), out=total[1:])
    span = total[k:] - total[:-k]
    span *= powers(pow(base, -1, 1 << 64), n)[: n - k + 1]
    return mix64(span + np.uint64(k))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] entries, then starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
