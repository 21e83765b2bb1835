"""Mixing sources to target weights with a splitting tree (operator 8, native).

1. Sizes (words) are summed per source; the targets share the total by weight,
   stop at ``max_epochs`` times the size of a source, and the excess is shared
   again by weight (water level from one ordered pass over the sources).
2. The documents of a source are hashed into blocks. Every block is drawn
   ``floor(target / size)`` times; blocks at the front of a hashed permutation
   are drawn once more until the words come nearest to the target. These draws
   are the exact quota of a source.
3. The quotas are split among the output shards by a binary tree: each node
   halves its draws and splits them among the sources by a multivariate
   hypergeometric draw, so every leaf has an exact size and an exact quota per
   source. This planning works on one small integer per (source, shard).
4. The permuted draws of a source are cut into consecutive runs, one per shard
   by its quota — disjoint by construction — and a shard is shuffled locally
   by sorting on a hash (in runs of a bounded size).

Only DataFrame functions touch documents and blocks. The driver sees one row
per source (the size of the mixture's own weight list), never documents.

Defined cases: a null text has no words; a null source is a source of its own,
ordered last; sources without words take nothing; rows that repeat doc_id and
text share a block; an empty table gives an empty result; other columns may have
any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, free_name
from .repeats import fan_out

MAX_BLOCKS = 1 << 16   # blocks of a source: bounds every window below, not the documents
ALL_BLOCKS = 1 << 28   # blocks of all sources together
MAX_EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                       n_words(text).alias("size"),
                       F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(text, F.lit(""))).alias("draw"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, blocks, weight, target. ``weights`` repeats over the
    sources in code point order, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.array(*[F.lit(w) for w in weights])
    rows = totals.withColumn("weight", F.get(weight, (rank - 1) % len(weights)).cast("double"))
    # sources that stop at their limit come first in the order of limit / weight
    ratio = F.col("source_size") * max_epochs / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(every) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.select("*", ratio.alias("ratio"), level.alias("level"))
    # the level is that of the first source whose limit isn't below it
    rows = rows.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every))
    target = F.least(F.col("weight") * F.col("final")["level"], F.col("source_size").cast("double") * max_epochs)
    # four blocks a document, a power of two, within the bounds of a source and of all sources
    most = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(16), F.floor(F.lit(ALL_BLOCKS) / F.count("*").over(every))))
    blocks = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_docs") * 4.0))), most.cast("double")).cast("int")
    return rows.select("source", "source_size", blocks.alias("blocks"), "weight",
                       F.coalesce(target, F.col("source_size").cast("double") * max_epochs).alias("target"))


def block_draws(sizes: DataFrame, targets: DataFrame, seed: int = 8) -> DataFrame:
    """source, block, draws: how often each block is drawn, with its place in
    the permutation of its source."""
    src = targets.withColumnRenamed("source", "t_source")
    rows = sizes.join(src, F.col("source").eqNullSafe(F.col("t_source")))
    blocks = (rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("draw")), F.col("blocks")))
              .groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"),
                                              F.first("target").alias("target")))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), F.col("block")), "block")
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    left = F.col("target") - whole * F.col("source_size")
    total = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a block is drawn once more when that brings the words nearer to the target
    more = total - F.col("words") / 2.0 < left
    return blocks.select("source", "block", "words", F.row_number().over(order).alias("place"),
                         (whole.cast("int") + F.when(more & (F.col("words") > 0), 1).otherwise(0)).alias("draws"))


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = 8) -> np.ndarray:
    """(shards, sources) quotas: each node halves its draws between its two
    children by a multivariate hypergeometric draw over the sources."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        want = int(have.sum()) * (mid - lo) // (hi - lo)
        part = rng.multivariate_hypergeometric(have, want, method="marginals") if want else np.zeros_like(have)
        split(lo, mid, part)
        split(mid, hi, have - part)

    if len(quotas):
        split(0, shards, quotas.astype(np.int64))
    return out


def plan_draws(sizes: DataFrame, targets: DataFrame, shards: int = 16, seed: int = 8) -> DataFrame:
    """source, block, copy, shard, slot: every draw of a block with its shard."""
    draws = block_draws(sizes, targets, seed)
    quota = draws.groupBy("source").agg(F.sum("draws").alias("quota")).orderBy(F.col("source").asc_nulls_last()).collect()
    split = splitting_tree(np.array([r["quota"] for r in quota], dtype=np.int64), shards, seed)
    spark = sizes.sparkSession
    ends = spark.createDataFrame([(r["source"], [int(x) for x in split[:, i].cumsum()]) for i, r in enumerate(quota)],
                                 "t_source string, ends array<long>")
    one = draws.where("draws > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("copy"))
    spread = F.xxhash64(F.lit(seed + 2), F.col("block"), F.col("copy"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(spread, "block", "copy"))
    return (one.withColumn("rank", rank.cast("long"))
            .join(ends, F.col("source").eqNullSafe(F.col("t_source")))
            .select("source", "block", "copy",
                    F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"), spread.alias("slot")))


def mix_decisions(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, shards: int = 16,
                  seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, draw (its hash), size,
    source_size, target, taken, copies, shards (of each copy)."""
    sizes = checkpointed(sized(docs, id_col, text_col, source_col))
    targets = checkpointed(source_targets(sizes, weights, max_epochs))
    plan = plan_draws(sizes, targets, shards, seed).groupBy("source", "block").agg(
        F.array_sort(F.collect_list("shard")).alias("shards")).withColumnsRenamed({"source": "p_source", "block": "p_block"})
    src = targets.withColumnRenamed("source", "t_source")
    rows = sizes.join(src, F.col("source").eqNullSafe(F.col("t_source"))).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), F.col("draw")), F.col("blocks")))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")), "left")
    copies = F.when(F.col("size") > 0, F.greatest(F.size("shards"), F.lit(0))).otherwise(F.lit(0))
    return rows.select("doc_id", "source", "draw", "size", "source_size", "target", copies.alias("copies"), "shards").select(
        "doc_id", "source", "draw", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, shards: int = 16, seed: int = 8,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, one row per copy,
    brought together by shard and shuffled inside it by a hash order."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    draw, drawn, origin, shard, order = (free_name(docs, x) for x in ("draw", "drawn", "origin", "shard", "order"))
    taken = mix_decisions(docs, weights, max_epochs, shards, seed, id_col, text_col, source_col)
    # rows of a source that repeat doc_id and text have equal decisions: one row of them joins to each
    taken = taken.where("copies > 0").select(F.col("draw").alias(drawn), F.col("source").alias(origin),
                                             F.col("shards").alias(shard)).dropDuplicates([drawn, origin])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.withColumn(draw, F.xxhash64(F.col(f"`{id_col}`"), text)).join(
        taken, (F.col(draw) == F.col(drawn)) & F.col(f"`{source_col}`").eqNullSafe(F.col(origin)))
    copies = keyed.select(*cols, draw, F.posexplode(shard).alias(order, shard))
    # a shard is shuffled by sorting on a hash; large shards are cut into runs of that order, one task each
    spread = F.xxhash64(F.lit(seed + 3), F.col(draw), F.col(order))
    runs = -(-max(shards, 1 << fan_out(docs, 64 << 20)) // shards)
    cell = F.col(shard) * runs + F.floor((F.shiftrightunsigned(spread, 32) * runs) / (1 << 32)).cast("int")
    return copies.repartition(shards * runs, cell).sortWithinPartitions(cell, spread).select(*cols)


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix_decisions(docs).select("doc_id", "size", "source_size", "target", "taken")
