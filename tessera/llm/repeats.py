"""Asking a distributed corpus which hashes occur more than once.

The operators that look for repeated content share these steps:

* ``distinct_texts``: each distinct text once, dealt to chunks of a few MB by
  its digest. Copies are folded in the scan tasks, so a text that a third of all
  rows hold reaches its chunk once per scan task. All later passes of an operator
  read this one exchange (Spark reuses it).
* ``questions``: a chunk sorts its hashes, keeps at most ``cap`` copies of each,
  and sends one packed row to every hash range; ``beyond`` packs the numbers of
  further copies, where the true count matters.
* ``answers``: a hash range counts its hashes over all chunks and returns one bit
  per asked hash and level, again packed by chunk.
* ``read_answers``: the chunk, which computes its hashes again, lines the bits up
  with them.

No row per hash is ever shuffled, a hot hash has at most ``cap`` entries per
chunk, and a task holds one chunk or one hash range, whose number grows with the
input. Chunks depend on content only, so a lost executor's chunk comes back the
same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

QUESTION = "p int, chunk int, counted binary, asked binary"
ANSWER = "chunk int, p int, bits binary"
BEYOND = np.dtype([("hash", "<u8"), ("more", "<i8")])
TEXT = "d1 long, d2 long, text string, n long"


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a plan; 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def fan_out(df: DataFrame, part_bytes: int) -> int:
    """log2 of a number of parts of ``part_bytes`` each for up to a GB (of the
    estimate, which for Parquet is the compressed size). Parts grow with the
    square root of the input, up to 16 times, so that a packed row from a chunk
    to a hash range keeps some tens of entries at 100 TB too."""
    size = plan_bytes(df)
    part_bytes = int(part_bytes * min(max(size / 1e9, 1.0) ** 0.5, 16.0))
    parts = size // part_bytes + 1 if size else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(3, min(24, (int(parts) - 1).bit_length()))


def digests(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit digests of a text, a null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(77), text)


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest with its text, and at the end the number of
    further copies without it."""
    more: dict[tuple[int, int], int] = {}
    names = ["d1", "d2", "text", "n"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
    for b in batches:
        fresh = []
        for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if key in more:
                more[key] += 1
            else:
                more[key] = 0
                fresh.append(i)
        own = b.take(pa.array(fresh, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array([1] * len(fresh), pa.int64())], names=names)
    rest = [(*k, None, n) for k, n in more.items() if n]
    for i in range(0, len(rest), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest[i:i + 10_000]), types)], names=names)


def distinct_texts(docs: DataFrame, text: Column, chunk_bytes: int = 2 << 20) -> DataFrame:
    """(d1, d2, text, n, chunk): the texts of ``docs``; n adds up to the number
    of rows that have the text, which is in one row of each scan task at least."""
    small_batches(docs.sparkSession)
    log2 = fan_out(docs, chunk_bytes)
    text = F.coalesce(text, F.lit(""))
    d1, d2 = digests(text)
    rows = docs.select(text.alias("text")).select(d1.alias("d1"), d2.alias("d2"), "text").mapInArrow(_first_copies, TEXT)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("d2"), F.lit(1 << log2)).cast("int")).repartition("chunk")


class Chunk:
    """The distinct texts of a chunk in digest order, with their row counts."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        d1, d2 = (table.column(c).to_numpy() for c in ("d1", "d2"))
        missing = table.column("text").is_null().to_numpy()
        order = np.lexsort((missing, d2, d1))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
        head = order[first]
        self.d1, self.d2 = d1[head], d2[head]
        begin = np.flatnonzero(first)
        self.n = np.add.reduceat(table.column("n").to_numpy()[order], begin) if len(order) else np.zeros(0, np.int64)
        text = table.column("text").take(pa.array(head))
        self.text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        self.chunk = int(table.column("chunk")[0].as_py())


def table_of(schema: str, columns: list) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _key(hashes: np.ndarray, log2: int, exact: bool) -> np.ndarray:
    """The part of a hash that is sent: all of it, or 32 bits beyond the range."""
    return hashes if exact else hashes >> np.uint64(32 - log2)


def _range_shift(log2: int, exact: bool) -> np.uint64:
    return np.uint64(64 - log2 if exact else 32)


def keep_first(ordered: np.ndarray, cap: int) -> np.ndarray:
    """At most ``cap`` of each run of equal entries."""
    keep = np.ones(len(ordered), dtype=bool)
    keep[cap:] = ordered[cap:] != ordered[:-cap]
    return ordered[keep]


def _parts(ordered: np.ndarray, log2: int, exact: bool) -> np.ndarray:
    """Cut points of the hash ranges in an ordered array."""
    edge = np.arange(1 << log2, dtype=np.uint64) << _range_shift(log2, exact)
    return np.append(np.searchsorted(ordered, edge), len(ordered))


def questions(chunk: int, counted: np.ndarray, asked: np.ndarray | None, log2: int, exact: bool = False,
              cap: int = 2) -> list[list]:
    """Columns of QUESTION rows. ``asked`` None: every counted hash is asked."""
    kind = np.uint64 if exact else np.uint32
    c = keep_first(np.sort(_key(counted, log2, exact)), cap)
    cut = _parts(c, log2, exact)
    a = np.zeros(0, np.uint64) if asked is None else np.unique(_key(asked, log2, exact))
    cut_a = _parts(a, log2, exact)
    c, a = c.astype(kind), a.astype(kind)
    full = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_a) > 0)).tolist()
    return [full, [chunk] * len(full), [c[cut[p]:cut[p + 1]].tobytes() for p in full],
            [None if asked is None else a[cut_a[p]:cut_a[p + 1]].tobytes() for p in full]]


def beyond(counted: np.ndarray, log2: int, cap: int, exact: bool = False) -> dict[int, bytes]:
    """By hash range, packed: each hash of more than ``cap`` copies, with the
    number of those that ``questions`` leaves out."""
    value, count = np.unique(_key(counted, log2, exact), return_counts=True)
    value, count = value[count > cap], count[count > cap]
    cut = _parts(value, log2, exact)
    packed = np.zeros(len(value), dtype=BEYOND)
    packed["hash"], packed["more"] = value.astype(np.uint64 if exact else np.uint32), count - cap
    return {p: packed[cut[p]:cut[p + 1]].tobytes() for p in np.flatnonzero(np.diff(cut)).tolist()}


def answer(table: pa.Table, exact: bool, levels: tuple[int, ...] = (2,)) -> pa.Table:
    """ANSWER rows of one hash range: per asked hash, whether it was counted at
    least as often as each level. A column ``beyond`` adds to the counts."""
    kind = np.uint64 if exact else np.uint32
    counted = [np.frombuffer(x, kind) for x in table.column("counted").to_pylist()]
    asked = [None if x is None else np.frombuffer(x, kind) for x in table.column("asked").to_pylist()]
    every = np.sort(np.concatenate(counted)) if counted else np.zeros(0, kind)
    value, count = np.unique(every, return_counts=True)
    for x in table.column("beyond").to_pylist() if "beyond" in table.column_names else []:
        if x is not None:
            further = np.frombuffer(x, BEYOND)
            count[np.searchsorted(value, further["hash"].astype(kind))] += further["more"]
    chunks, bits = [], []
    for chunk, c, a in zip(table.column("chunk").to_pylist(), counted, asked):
        a = keep_first(c, 1) if a is None else a
        if not len(a):
            continue
        at = np.minimum(np.searchsorted(value, a), max(len(value) - 1, 0))
        n = np.where(value[at] == a, count[at], 0) if len(value) else np.zeros(len(a), np.int64)
        chunks.append(chunk)
        bits.append(b"".join(np.packbits(n >= level).tobytes() for level in levels))
    return table_of(ANSWER, [chunks, [int(table.column("p")[0].as_py())] * len(chunks), bits])


def read_answers(p: list[int], bits: list[bytes], hashes: np.ndarray, log2: int, exact: bool = False,
                 levels: int = 1) -> np.ndarray:
    """(levels, len(hashes)) flags of the asked hashes of a chunk, in their order."""
    key = _key(hashes, log2, exact)
    value = np.unique(key)
    size = np.diff(_parts(value, log2, exact))
    begin = np.cumsum(size) - size
    flags = np.zeros((levels, len(value)), dtype=bool)
    for q, b in zip(p, bits):
        n = int(size[q])
        step = (n + 7) // 8
        for i in range(levels):
            flags[i, begin[q]:begin[q] + n] = np.unpackbits(np.frombuffer(b, np.uint8)[i * step:(i + 1) * step])[:n]
    return flags[:, np.searchsorted(value, key)]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places the windows of ``length`` that begin at ``starts`` cover."""
    depth = np.zeros(n + 1, dtype=np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + length, n), -1)
    return np.cumsum(depth[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def join_results(docs: DataFrame, results: DataFrame, text: Column, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` with the results of its text."""
    d1, d2 = digests(text)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), d1.alias("d1"), d2.alias("d2"))
    return rows.join(results, ["d1", "d2"]).select("doc_id", *columns)
