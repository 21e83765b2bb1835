"""Line dedup from range-partitioned line hashes (operator 5, native).

Every line becomes (128-bit key hash, document, position) — no text. The rows
are range-partitioned by (hash, document) and sorted by (hash, document,
position), so a hash that a third of all lines share spreads over many
partitions. Streaming through the order, the first occurrence of a hash in a
document counts one document; hashes found in enough documents lose all their
lines. What comes back per document is a keep bitmap (trailing zero bytes cut
off), and only the last step applies it to the text.

All steps are DataFrame functions.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; rows that repeat both doc_id and
text count as one document and each gets the same result; a null doc_id is an
id like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, sha256_hex

SPACES = " \t\n\x0b\x0c\r"  # code points 0x20 and 0x09 to 0x0D
BITS = 32768  # lines that one bitmap row covers (fixed by Spark's bitmap functions)


def line_key(line: Column) -> Column:
    """Stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def line_rows(docs: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, doc_id, version, pos) of every line whose key is long enough."""
    lines = _lines(docs, id_col, text_col).select(
        "doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    return lines.select("doc_id", "version", "pos", key.alias("key")).where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(77), F.col("key")).alias("h2"), "doc_id", "version", "pos")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, bitmaps): bitmaps maps a block of 32768 lines to the
    bitmap of its dropped lines, trailing zero bytes cut off; documents that
    lose nothing have no row."""
    ident = ["h1", "h2", "doc_id", "version"]
    # kept in the shared folder: the range bounds, the count and the join read it without the text
    lines = checkpointed(line_rows(docs, min_chars, id_col, text_col))
    rows = lines.repartitionByRange(*ident).sortWithinPartitions(*ident, "pos")
    first = F.row_number().over(Window.partitionBy(*ident).orderBy("pos")) == 1
    common = rows.withColumn("first", first).groupBy("h1", "h2").agg(
        F.sum(F.col("first").cast("long")).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("h1", "h2")
    dropped = lines.join(common, ["h1", "h2"])
    at = F.col("pos").cast("long")
    blocks = (dropped.repartition("doc_id", "version")
              .groupBy("doc_id", "version", F.floor(at / BITS).alias("block"))
              .agg(F.bitmap_construct_agg(F.pmod(at, F.lit(BITS))).alias("bits")))
    trimmed = F.unhex(F.regexp_replace(F.hex("bits"), "(?:00)+$", ""))
    return blocks.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(
        F.struct("block", trimmed.alias("bits")))).alias("bitmaps"))


def _bit(bitmap: Column, pos: Column) -> Column:
    """Whether a line is set in the trimmed bitmap of its block."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.pmod(pos, F.lit(BITS)) / 8).cast("int") + 1, 1)), 16, 10)
    return F.coalesce(F.getbit(byte.cast("long"), F.pmod(pos, F.lit(8)).cast("int")) == 1, F.lit(False))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text per row of ``docs``."""
    base = _lines(docs, id_col, text_col)
    maps = keep_bitmaps(docs, min_docs, min_chars, id_col, text_col).withColumnsRenamed(
        {"doc_id": "m_id", "version": "m_version"})
    joined = base.join(maps, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("version") == F.col("m_version")), "left")
    lines = joined.select("doc_id", "bitmaps", F.split("text", "\n", -1).alias("lines"))

    def keeps(line: Column, i: Column) -> Column:
        return ~_bit(F.col("bitmaps")[F.floor(i / BITS)], i)

    kept = F.when(F.col("bitmaps").isNull(), F.col("lines")).otherwise(F.filter("lines", keeps))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "lines", kept.alias("kept")).select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"))


def line_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u),
c AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.k = c.k GROUP BY doc_id
"""
