"""Training-order token shards (operator 2).

Documents are encoded (the end id closes each) and dealt to buckets by a hash;
in a bucket they are joined in (doc_id, text digest) order and cut to sequences
of a fixed length, the last one padded. Bucket sizes give every sequence a dense
number, and a keyed Feistel permutation with cycle-walking turns the number into
a global slot: any N, no table, invertible, the same on every run. A shard is a
range of slots, written as one record block of a fixed stride, so slot s lies in
shard ``s // shard_size`` at byte ``(s % shard_size) * stride``: training reads
sequentially and can resume at any slot.

Shards are rows of a Parquet table (data binary), because a cluster's store is
reached through Spark's writers. Neither slots nor sequences pass the driver; one
task adds up one number per bucket.

Defined cases: a null text counts as empty (its end id only); rows that repeat
doc_id and text are each written; an empty table gives no shard; padding is the
id 0 and each sequence's true length is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import repeats as R
from . import sentencepiece_bpe as S
from .common import doc_chunks, give_back, mix64, small_batches, text_buffers, tidy

SEQ_LEN = 2048
SHARD_SIZE = 4096     # sequences of a shard
ROUNDS = 6
CACHE_BYTES = 64 << 20  # of segments that a task keeps: its only large table
PART_BYTES = 4 << 20    # of text encoded at once: a word is looked up once a part
CUT = "part long, shard long, slot long, n int, data binary"
SHARD = "shard long, first_slot long, n_sequences int, stride int, width int, n_tokens long, lengths binary, data binary"


class Feistel:
    """Keyed permutation of 0..n-1: a balanced Feistel network over the next
    even number of bits, walked along its cycle until it is below n."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = mix64(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & self.mask)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ (mix64(left ^ k) & self.mask), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(x.astype(np.uint64))
        while (over := out >= np.uint64(self.n)).any():
            out[over] = step(out[over])
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, lambda x: self._once(x, self.keys)) if len(number) else number.astype(np.int64)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._back) if len(slot) else slot.astype(np.int64)


def token_rows(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, bucket, ids): ids packed as 16 or 32-bit integers, dealt
    to buckets of a few MB."""
    small_batches(docs.sparkSession)
    handle = S._share(docs.sparkSession, model_path)
    kind = np.uint16 if len(handle.value["pieces"]) <= 1 << 16 else np.uint32
    buckets = 1 << R.fan_out(docs, 4 << 20)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = S._worker(handle)[0]
        encoder.limit = CACHE_BYTES
        for b in batches:
            for a, z in doc_chunks(text_buffers(b.column(2))[1], PART_BYTES):
                own = b.slice(a, z - a)
                ids, offsets = encoder.encode(own.column(2))
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(
                    (offsets * kind().itemsize).astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), data], names=["doc_id", "version", "ids"])
        encoder.clear()
        give_back()

    return (rows.mapInArrow(run, "doc_id long, version long, ids binary")
            .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "version"), F.lit(buckets)).cast("int")).repartition("bucket"))


def bucket_offsets(rows: DataFrame, stride: int) -> DataFrame:
    """bucket, first (number of its first sequence), total (of all buckets). One
    row per bucket of several MB of tokens meets in the window."""
    def count(table: pa.Table) -> pa.Table:
        # takes whole rows, so that Spark reuses the exchange of the tokens
        size = int(pc.sum(pc.binary_length(table.column("ids"))).as_py() or 0)
        return R.table_of("bucket int, n long", [[table.column("bucket")[0].as_py()], [-(-size // stride)]])

    size = rows.groupBy("bucket").applyInArrow(tidy(count), "bucket int, n long")
    order = Window.orderBy("bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return size.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(every).alias("total"))


def training_shards(docs: DataFrame, model_path: str | None = None, key: int = 2, seq_len: int = SEQ_LEN,
                    shard_size: int = SHARD_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SHARD rows, one per range of ``shard_size`` slots."""
    rows = token_rows(docs, model_path or S.public_model(), id_col, text_col)
    parts = max(1, (1 << R.fan_out(docs, 4 << 20)) // 4)
    width = 2 if len(S.Pieces.load(model_path or S.public_model()).pieces) <= 1 << 16 else 4
    stride = seq_len * width

    def cut(table: pa.Table, place: pa.Table) -> pa.Table:
        if not table.num_rows:
            return R.table_of(CUT, [[], [], [], [], []])
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("version", "ascending")])
        data = b"".join(table.column("ids").to_pylist())
        n = -(-len(data) // stride)
        number = int(place.column("first")[0].as_py()) + np.arange(n)
        total = int(place.column("total")[0].as_py())
        slot = Feistel(total, key).slot(number)
        # a range of slots per partition, cut at shard edges
        part = (slot // shard_size) * parts // -(-total // shard_size)
        used = [min(seq_len, (len(data) - i * stride) // width) for i in range(n)]
        records = [data[i * stride:(i + 1) * stride].ljust(stride, b"\0") for i in range(n)]
        return R.table_of(CUT, [part, slot // shard_size, slot, used, records])

    def pack(shard: int, used: list[int], records: list[bytes]) -> pa.RecordBatch:
        lengths = np.array(used, dtype=np.int32)
        return R.table_of(SHARD, [[shard], [shard * shard_size], [len(records)], [stride], [width], [int(lengths.sum())], [lengths.tobytes()],
                                  [b"".join(records)]]).to_batches()[0]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in slot order; holds the records of one shard."""
        shard, used, records = None, [], []
        for b in batches:
            for s, n, data in zip(*(b.column(c).to_pylist() for c in ("shard", "n", "data"))):
                if s != shard and records:
                    yield pack(shard, used, records)
                    used, records = [], []
                shard = s
                used.append(n)
                records.append(data)
        if records:
            yield pack(shard, used, records)
        give_back()

    sequences = rows.groupBy("bucket").cogroup(bucket_offsets(rows, stride).groupBy("bucket")).applyInArrow(tidy(cut), CUT)
    # the ranges are known, so no sample of the sequences has to choose them
    ranged = sequences.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("slot")
    return ranged.select("shard", "n", "data").mapInArrow(gather, SHARD)


def write_shards(shards: DataFrame, path: str) -> None:
    """One file per task, shards in slot order inside a file."""
    shards.sortWithinPartitions("shard").write.mode("errorifexists").parquet(path)


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(slot, ids) of a written table from ``start`` on (to resume a run): only
    the shards of the range are read, and only their records are cut out."""
    columns = ("first_slot", "n_sequences", "stride", "width", "lengths", "data")
    rows = spark.read.parquet(path).where(F.col("shard") >= start // shard_size)
    if stop is not None:
        rows = rows.where(F.col("first_slot") < stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, stride, width, used, data in zip(*(b.column(c).to_pylist() for c in columns)):
                kind = np.uint16 if width == 2 else np.uint32
                lengths = np.frombuffer(used, np.int32)
                a, z = max(0, start - first), n if stop is None else min(n, stop - first)
                for c in range(a, z, 256):
                    at = range(c, min(c + 256, z))
                    ids = [np.frombuffer(data, kind, int(lengths[i]), i * stride).astype(np.int32) for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([first + i for i in at], pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                                                     names=["slot", "ids"])

    return rows.select(*columns).mapInArrow(run, "slot long, ids array<int>")
