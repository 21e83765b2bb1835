"""Exact dedup with a cuckoo-filter index (operator 10).

Spark computes one SHA-256 digest per document (of the text after lower-casing
A-Z, null as empty). Each scan task folds its rows into a cuckoo index, so a
digest leaves a task once however often it occurs; the folded rows are shuffled
by digest and folded again. A filter hit is only a hint: the full digest stored
for the slot is compared before two rows are taken as equal, and a bucket
overflow doubles the table from the stored keys. The groups are then joined
back to (doc_id, digest) rows, which carry no text; AQE can split that
sort-merge join where one digest holds a large share of the rows.

``build_index`` / ``update_index`` / ``probe_index`` keep the same structure as
a table (one row per hash segment) for incremental use, with deletion of live
digests.

Defined cases: a null text equals an empty one; the largest doc_id stays, a null
doc_id is the smallest; of rows that repeat both text and doc_id one stays; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name
from .repeats import plan_bytes

SLOTS = 4          # entries of a bucket
MAX_KICKS = 200    # displacements before the table is doubled
FOLD_BYTES = 256 << 20   # input of a second fold's task; some 100,000 documents of a few KB
NO_ID = -(1 << 63)  # stands for a null id inside the index


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints over stored keys.

    Every slot has a fingerprint and the number of the record it stands for;
    records hold the whole digest, the largest id and the row count.
    """

    def __init__(self, buckets: int = 256):
        self.keys: list[bytes | None] = []
        self.best = array("q")
        self.count = array("q")
        self.free: list[int] = []
        self._allocate(buckets)

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.fingerprint = array("H", bytes(2 * SLOTS * buckets))
        self.record = array("q", bytes(8 * SLOTS * buckets))

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = (key[0] << 8 | key[1]) or 1
        one = int.from_bytes(key[2:8], "big") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _slot(self, key: bytes) -> int:
        """Slot of a live key, -1 if absent. Filter hits are verified."""
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.fingerprint[slot] == mark and self.keys[self.record[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        """Record number of a live key, -1 if absent."""
        slot = self._slot(key)
        return -1 if slot < 0 else self.record[slot]

    def add(self, key: bytes, best: int, count: int) -> None:
        """Insert a digest, or fold (best id, rows) into the live one."""
        at = self.find(key)
        if at >= 0:
            self.count[at] += count
            if best > self.best[at]:
                self.best[at] = best
            return
        if self.free:
            at = self.free.pop()
            self.keys[at], self.best[at], self.count[at] = key, best, count
        else:
            at = len(self.keys)
            self.keys.append(key)
            self.best.append(best)
            self.count.append(count)
        if not self._place(key, at):
            self._resize()

    def remove(self, key: bytes, count: int | None = None) -> bool:
        """Take ``count`` rows off a live digest (None: all), and the digest out
        once none is left; False if it isn't there."""
        slot = self._slot(key)
        if slot < 0:
            return False
        at = self.record[slot]
        if count is not None and self.count[at] > count:
            self.count[at] -= count
            return True
        self.fingerprint[slot] = 0
        self.keys[at] = None
        self.free.append(at)
        return True

    def _place(self, key: bytes, at: int) -> bool:
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.fingerprint[slot]:
                    self.fingerprint[slot], self.record[slot] = mark, at
                    return True
        bucket = one
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            self.fingerprint[slot], mark = mark, self.fingerprint[slot]
            self.record[slot], at = at, self.record[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.fingerprint[slot]:
                    self.fingerprint[slot], self.record[slot] = mark, at
                    return True
        return False

    def _resize(self) -> None:
        """Overflow: double until every stored live key has a place again."""
        buckets = 2 * (self.mask + 1)
        while True:
            self._allocate(buckets)
            if all(self._place(k, i) for i, k in enumerate(self.keys) if k is not None):
                return
            buckets *= 2

    def rows(self) -> tuple[list[bytes], list[int], list[int]]:
        live = [i for i, k in enumerate(self.keys) if k is not None]
        return [self.keys[i] for i in live], [self.best[i] for i in live], [self.count[i] for i in live]


def digest(text: Column) -> Column:
    """32-byte digest of the normalised text."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        for key, best, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            index.add(key, best, n)
    keys, best, count = index.rows()
    for i in range(0, len(keys), 10_000):
        yield pa.record_batch([pa.array(keys[i:i + 10_000], pa.binary()), pa.array(best[i:i + 10_000], pa.int64()),
                               pa.array(count[i:i + 10_000], pa.int64())], ["digest", "best", "n"])


_GROUP = "digest binary, best long, n long"


def digest_groups(rows: DataFrame) -> DataFrame:
    """(digest, best, n) of a (digest, best, n) table, one row per digest: folded
    in each task first, then once more where the digests meet, in as many tasks as
    keep an index within some 100,000 digests."""
    folded = rows.select("digest", "best", "n").mapInArrow(_fold, _GROUP)
    parts = -(-plan_bytes(rows) // FOLD_BYTES)
    if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return folded.repartition(parts, "digest").mapInArrow(_fold, _GROUP)
    return folded.repartition("digest").mapInArrow(_fold, _GROUP)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       digest(F.col(f"`{text_col}`")).alias("digest"))
    groups = digest_groups(rows.select("digest", F.coalesce("doc_id", F.lit(NO_ID)).alias("best"),
                                       F.lit(1).cast("long").alias("n")))
    turn = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy(F.lit(0)))
    groups = groups.select("digest", F.when(F.col("best") != NO_ID, F.col("best")).alias("keep_id"),
                           F.col("n").alias("group_size"))
    return rows.withColumn("turn", turn).join(groups, "digest").select(
        "doc_id", "digest", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    key, best = free_name(docs, "digest"), free_name(docs, "keep_id")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, digest(F.col(f"`{text_col}`")))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    groups = digest_groups(keyed.select(F.col(key).alias("digest"), ident.alias("best"),
                                        F.lit(1).cast("long").alias("n")))
    groups = groups.select(F.col("digest").alias(key), F.col("best").alias(best))
    return keyed.join(groups, key).where(ident == F.col(best)).dropDuplicates([key]).select(*cols)


# --------------------------------------------------------------------------
# the index as a table
# --------------------------------------------------------------------------

INDEX_SCHEMA = "segment int, digests binary, best binary, counts binary"


def _segment(key: str, segments: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(segments)).cast("int")


def _load(pdf: pd.DataFrame) -> CuckooIndex:
    index = CuckooIndex()
    for r in pdf.itertuples():
        if r.digests is None:
            continue
        ids, n = np.frombuffer(r.best, np.int64).tolist(), np.frombuffer(r.counts, np.int64).tolist()
        for i, (a, b) in enumerate(zip(ids, n)):
            index.add(bytes(r.digests[32 * i:32 * i + 32]), a, b)
    return index


def _store(segment: int, index: CuckooIndex) -> pd.DataFrame:
    keys, best, count = index.rows()
    return pd.DataFrame({"segment": [segment], "digests": [b"".join(keys)],
                         "best": [np.array(best, np.int64).tobytes()],
                         "counts": [np.array(count, np.int64).tobytes()]})


def build_index(docs: DataFrame, segments: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index table of all live digests, one row per segment. ``segments`` should
    keep a segment near a million digests."""
    empty = docs.sparkSession.createDataFrame([], INDEX_SCHEMA)
    return update_index(empty, docs, None, segments, id_col, text_col)


def update_index(index: DataFrame, inserts: DataFrame | None, deletes: DataFrame | None, segments: int = 64,
                 id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """Index after deleting the digests of ``deletes`` and inserting those of
    ``inserts`` (both are document tables; either may be None). With ``whole``
    false, ``deletes`` are rows: a digest goes with its last one, and keeps until
    then the largest id that it was given."""
    parts = []
    for sign, docs in ((-1, deletes), (1, inserts)):
        if docs is not None:
            rows = docs.select(digest(F.col(f"`{text_col}`")).alias("digest"),
                               F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("best"),
                               F.lit(1).cast("long").alias("n"))
            parts.append(digest_groups(rows).withColumn("sign", F.lit(sign)))
    if not parts:
        return index
    changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    changes = changes.withColumn("segment", _segment("digest", segments))

    def change(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        table = _load(old)
        for r in new[new.sign < 0].itertuples():
            table.remove(bytes(r.digest), None if whole else int(r.n))
        for r in new[new.sign > 0].itertuples():
            table.add(bytes(r.digest), int(r.best), int(r.n))
        return _store(int(key[0]), table)

    return index.groupBy("segment").cogroup(changes.groupBy("segment")).applyInPandas(change, INDEX_SCHEMA)


def probe_index(index: DataFrame, docs: DataFrame, segments: int = 64, text_col: str = "text") -> DataFrame:
    """(digest, keep_id, group_size) of the digests of ``docs`` that are live."""
    wanted = digest_groups(docs.select(digest(F.col(f"`{text_col}`")).alias("digest"), F.lit(0).cast("long").alias("best"),
                                       F.lit(1).cast("long").alias("n")))
    wanted = wanted.select("digest", _segment("digest", segments).alias("segment"))

    def look(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        table = _load(old)
        keys = [bytes(k) for k in new.digest]
        at = [table.find(k) for k in keys]
        hit = [(k, table.best[i], table.count[i]) for k, i in zip(keys, at) if i >= 0]
        return pd.DataFrame(hit, columns=["digest", "keep_id", "group_size"])

    return index.groupBy("segment").cogroup(wanted.groupBy("segment")).applyInPandas(
        look, "digest binary, keep_id long, group_size long")
