"""N-gram Jaccard join by a count-vector R-tree (operator 1).

A text is the set of its 5-word shingles (hashes). Two texts link when
100 * common >= 75 * union. The result is the link graph's components; copies
and linked groups are never expanded to all pairs, and no link between different
components can be missed:

1. The corpus is asked how often each shingle occurs (packed, repeats.py). A text
   that shares less than 75 % of its shingles with any other has no link. For the
   rest, shingles are ordered rarest first; a linked pair must share one of the
   first ``n - ceil(0.75 n) + 1`` shingles of both.
2. Texts that share such a shingle form a block, named after the text of the
   block with the fewest shingles of its own (its leader). Both ends of a link
   are in a common block.
3. In a block, texts are points: shingles are hashed into groups, and the counts
   per group are the coordinates, indexed by an R-tree. The common shingles of two
   texts are at most the sum of the smaller coordinates; for a node, of the query
   and the node's upper corner. Nodes and points below the needed overlap are
   pruned, surviving pairs are verified on the shingle sets.
   First round: the leader is the query, for each text in its best block only.
   Second round: in blocks that still hold more than one component, the texts
   outside the leader's component are the queries, and pairs within a component
   are skipped. A pair that would add no connection is never needed.
4. Large blocks are cut: members of a first-round block are salted, second-round
   blocks are dealt as (outsiders x insiders) cells of a bounded size.

Component links go through contraction joins (components.py).

Defined cases: texts are compared after lower-casing A-Z; with fewer than five
words the whole word sequence is one shingle; a null text, or one without a word,
has an empty set and links with nothing; rows that repeat a text link with each
other; a null doc_id counts as larger than any other; an empty table gives an
empty result. A text is named by a 64-bit digest inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import Words, ascii_lower, checkpointed, doc_chunks, free_name, mix64, ragged, text_buffers, tidy
from .components import connected_components

SHINGLE = 5
PERCENT = 75
LEVELS = (2, 8, 64)   # occurrences at which a shingle counts as more common
SALT = 256            # members of a first-round group
CELL = 512            # texts of one side of a second-round cell
LEAF = 16             # points of a leaf, children of a node
SETS = "d1 long, n int, own int, prefix binary, shared binary"


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (lower-cased words)."""
    out: list[np.ndarray] = []
    for a, b in doc_chunks(off):
        part = Words(raw, off, a, b, lower=True)
        word, n = part.hash, len(part.start)
        h = np.zeros(max(0, n - SHINGLE + 1), dtype=np.uint64)
        for j in range(SHINGLE):
            h = mix64(h + np.uint64(j + 1)) ^ word[j:j + len(h)]
        h = mix64(h)
        for x, y in zip(part.first[:-1].tolist(), part.first[1:].tolist()):
            if y - x >= SHINGLE:
                out.append(np.unique(h[x:y - SHINGLE + 1]))
            elif y > x:
                one = np.array([y - x], dtype=np.uint64)
                for w in word[x:y]:
                    one = mix64(one) ^ w
                out.append(mix64(one))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of ``n`` with any set that it links with."""
    return -(-PERCENT * n // 100)


# --------------------------------------------------------------------------
# the R-tree
# --------------------------------------------------------------------------

class CountTree:
    """R-tree of count vectors, packed bottom-up from points sorted by size and
    then by their largest coordinates. A node keeps the upper corner of its box
    and the range of set sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.var(axis=0), kind="stable")[:3] if len(points) else []
        band = np.floor(np.log2(np.maximum(sizes, 1)) * 4)
        self.order = np.lexsort((*[points[:, c] for c in reversed(spread)], band))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # (upper corners, least size, largest size), leaves first
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > 1 or not self.levels:
            cut = np.arange(0, len(top), LEAF)
            if not len(cut):
                break
            top = np.maximum.reduceat(top, cut, axis=0)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    @staticmethod
    def _may_link(query: np.ndarray, n: int, corners: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(overlap bound, whether a set of a size in low..high may link)."""
        bound = np.minimum(query, corners).sum(axis=1, dtype=np.int64)
        # common >= 75 / 175 of the sum of both sizes, and 75 % of the larger one
        fits = (100 + PERCENT) * bound >= PERCENT * (n + low)
        return bound, fits & (100 * n >= PERCENT * low) & (100 * high >= PERCENT * n)

    def search(self, query: np.ndarray, n: int) -> np.ndarray:
        """Places of the points that may link with the query, best bound first."""
        if not self.levels:
            return np.zeros(0, dtype=np.int64)
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            _, ok = self._may_link(query, n, top[nodes], low[nodes], high[nodes])
            nodes = nodes[ok]
            below = len(self.points) if depth == 0 else len(self.levels[depth - 1][0])
            first = nodes * LEAF
            nodes = ragged(first, np.minimum(first + LEAF, below) - first)
        bound, ok = self._may_link(query, n, self.points[nodes], self.sizes[nodes], self.sizes[nodes])
        return self.order[nodes[ok][np.argsort(-bound[ok], kind="stable")]]


def count_vectors(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """Shingles per hash group, one row per set."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = row * groups + (np.concatenate(sets) & np.uint64(groups - 1)).astype(np.int64) if len(row) else row
    out = np.bincount(cell, minlength=len(sets) * groups).reshape(len(sets), groups)
    return out.astype(np.uint8 if out.size and out.max() < 256 else np.int32)


def group_count(sizes: np.ndarray) -> int:
    """Groups for a block: about half a shingle of the largest set each."""
    return 1 << int(min(max(int(sizes.max() if len(sizes) else 1) - 1, 15).bit_length(), 12))


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(sets: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, queries: np.ndarray,
                points: np.ndarray) -> list[tuple[int, int]]:
    """Links (by place) that join different components: each query against an
    R-tree of the points, survivors verified on their sets. Pairs that are
    connected already are left out."""
    groups = group_count(sizes[points])
    vectors = count_vectors(sets, groups)
    tree = CountTree(vectors[points], sizes[points])
    label, numbered = np.unique(component, return_inverse=True)
    forest = Forest(len(label))
    out = []
    for q in queries.tolist():
        found = points[tree.search(vectors[q], int(sizes[q]))]
        here = forest.root(int(numbered[q]))
        for a in range(0, len(found), 64):
            some = [x for x in found[a:a + 64].tolist() if forest.root(int(numbered[x])) != forest.root(here)]
            if not some:
                continue
            size = np.array([len(sets[x]) for x in some])
            every = np.concatenate([sets[x] for x in some])
            at = np.minimum(np.searchsorted(sets[q], every), max(len(sets[q]) - 1, 0))
            same = np.concatenate([[0], np.cumsum(sets[q][at] == every)]) if len(sets[q]) else np.zeros(len(every) + 1, np.int64)
            stop = np.concatenate([[0], np.cumsum(size)])
            common = same[stop[1:]] - same[stop[:-1]]
            union = sizes[q] + sizes[some] - common
            for x, ok in zip(some, (100 * common >= PERCENT * union).tolist()):
                if ok and forest.join(int(numbered[q]), int(numbered[x])):
                    out.append((q, x))
    return out


# --------------------------------------------------------------------------
# the distributed join
# --------------------------------------------------------------------------

def link_sets(texts: DataFrame, log2: int) -> DataFrame:
    """SETS rows, one per distinct text: n is its set size; for texts that may
    link, the shingles that name its blocks and all shingles it shares, and in
    ``own`` how many it doesn't share."""
    def ask(table: pa.Table) -> pa.Table:
        chunk = R.Chunk(table)
        sets = shingle_sets(*text_buffers(chunk.text))
        return R.table_of(R.QUESTION, R.questions(chunk.chunk, np.concatenate(sets), None, log2))

    def choose(table: pa.Table, replies: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        if not table.num_rows:
            return R.table_of(SETS, cols)
        chunk = R.Chunk(table)
        sets = shingle_sets(*text_buffers(chunk.text))
        level = R.read_answers(replies.column("p").to_pylist(), replies.column("bits").to_pylist(), np.concatenate(sets),
                               log2, levels=len(LEVELS)).sum(axis=0)
        done = 0
        for d1, s in zip(chunk.d1.tolist(), sets):
            own = level[done:done + len(s)]
            done += len(s)
            shared = s[own > 0]
            prefix = body = None
            if len(s) and len(shared) >= needed(len(s)):
                order = np.argsort(own, kind="stable")[: len(s) - needed(len(s)) + 1]
                order = order[own[order] > 0]
                if len(order):
                    prefix, body = s[order].tobytes(), shared.tobytes()
            for c, v in zip(cols, (d1, len(s), len(s) - len(shared), prefix, body)):
                c.append(v)
        return R.table_of(SETS, cols)

    asked = texts.groupBy("chunk").applyInArrow(tidy(ask), R.QUESTION)
    said = asked.groupBy("p").applyInArrow(tidy(lambda t: R.answer(t, False, LEVELS)), R.ANSWER)
    return texts.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(tidy(choose), SETS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d1, own = b.column(0).to_numpy(), b.column(1).to_numpy()
        prefix = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
        size = np.array([len(x) for x in prefix], dtype=np.int64)
        stop = np.concatenate([[0], np.cumsum(size)])
        a = 0
        while a < len(size):
            z = max(a + 1, int(np.searchsorted(stop, stop[a] + 500_000, side="right")) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefix[a:z])), pa.array(np.repeat(own[a:z], size[a:z])),
                                              pa.array(np.repeat(d1[a:z], size[a:z]))], names=["key", "own", "d1"])
            a = z


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, member, keys) from rows sorted by key, own, d1: the first text of
    a key leads it. Streams; keeps the current key and its leader only."""
    last_key = leader = None
    single = False
    for b in batches:
        key, d1 = b.column(0).to_numpy(), b.column(2).to_numpy()
        if not len(key):
            continue
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        first[0] = last_key is None or key[0] != last_key
        begin = np.flatnonzero(first)
        lead = np.empty(len(key), dtype=np.int64)
        carried = begin[0] if len(begin) else len(key)
        if carried:
            lead[:carried] = leader
        lead[carried:] = np.repeat(d1[begin], np.diff(np.append(begin, len(key))))
        # a leader joins its own block once the key has a second text
        members = ~first
        heads = begin[np.diff(np.append(begin, len(key))) > 1]
        a, m = np.concatenate([lead[members], d1[heads]]), np.concatenate([d1[members], d1[heads]])
        if carried and single:
            a, m = np.append(a, leader), np.append(m, leader)
        single = bool(len(begin)) and begin[-1] == len(key) - 1
        last_key, leader = key[-1], lead[-1]
        if len(a):
            order = np.lexsort((m, a))
            a, m = a[order], m[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (m[1:] != m[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(m[at]), pa.array(np.diff(np.append(at, len(a))))],
                                             names=["leader", "member", "keys"])


def blocks(sets: DataFrame) -> DataFrame:
    """(leader, member, keys): the blocks of texts that share a naming shingle."""
    keys = sets.where("prefix is not null").select("d1", "own", "prefix").mapInArrow(_keys, "key long, own int, d1 long")
    keys = keys.repartition("key").sortWithinPartitions("key", "own", "d1")
    pairs = keys.mapInArrow(_pairs, "leader long, member long, keys long")
    return pairs.groupBy("leader", "member").agg(F.sum("keys").alias("keys"))


EDGE = "u long, v long"


def _sets(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    return ([np.frombuffer(x, np.uint64) for x in table.column("shared").to_pylist()],
            table.column("n").to_numpy().astype(np.int64), table.column("member").to_numpy())


def first_round(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the leader of a block and the members that share most of
    their naming shingles with it."""
    best = pairs.where("leader <> member").groupBy("member").agg(
        F.max(F.struct("keys", "leader")).alias("best")).select("member", F.col("best.leader").alias("leader"))
    salts = best.groupBy("leader").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    salted = best.join(salts, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"))
    heads = salts.select("leader", F.col("leader").alias("member"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    body = sets.select(F.col("d1").alias("member"), "n", "shared")
    rows = salted.unionByName(heads).join(body, "member")

    def verify(table: pa.Table) -> pa.Table:
        shared, n, member = _sets(table)
        leader = int(table.column("leader")[0].as_py())
        query = np.flatnonzero(member == leader)[:1]
        links = block_links(shared, n, member, query, np.flatnonzero(member != leader))
        return R.table_of(EDGE, [[int(member[a]) for a, _ in links], [int(member[b]) for _, b in links]])

    return rows.groupBy("leader", "salt").applyInArrow(verify, EDGE)


def second_round(pairs: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components within a block."""
    labels = labels.withColumnRenamed("node", "l_node")
    named = pairs.join(labels, F.col("member") == F.col("l_node"), "left").select(
        "leader", "member", F.coalesce("component", "member").alias("component"))
    head = named.where("leader = member").select(F.col("leader").alias("h_leader"), F.col("component").alias("home"))
    named = named.join(head, F.col("leader") == F.col("h_leader")).select(
        "leader", "member", "component", (F.col("component") != F.col("home")).alias("outside"))
    count = named.groupBy("leader").agg(F.sum(F.col("outside").cast("long")).alias("n_out"), F.count("*").alias("n")).where("n_out > 0")
    count = count.select(F.col("leader").alias("c_leader"),
                         F.ceil(F.col("n_out") / CELL).cast("int").alias("outs"),
                         F.greatest(F.ceil((F.col("n") - F.col("n_out")) / CELL), F.lit(1)).cast("int").alias("ins"))
    rows = named.join(count, F.col("leader") == F.col("c_leader"))
    part = F.pmod(F.xxhash64("member"), F.when(F.col("outside"), F.col("outs")).otherwise(F.col("ins"))).cast("int")
    rows = rows.select("leader", "member", "component", "outside", "outs", "ins", part.alias("part"))

    def cell(kind: str, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    def upto(c: str) -> Column:
        return F.sequence(F.lit(0), F.col(c) - 1)

    # outsiders meet every part of the insiders and every part of the outsiders; insiders meet the outsiders
    outer = F.concat(F.transform(upto("ins"), lambda j: cell("in", F.col("part"), j, F.lit(0))),
                     F.transform(upto("outs"), lambda j: cell("out", F.least(F.col("part"), j), F.greatest(F.col("part"), j),
                                                              F.when(F.col("part") > j, 1).otherwise(0))))
    inner = F.transform(upto("outs"), lambda i: cell("in", i, F.col("part"), F.lit(1)))
    # the whole of a small block is one cell
    small = (F.col("outs") == 1) & (F.col("ins") == 1)
    cells = F.when(small, F.array(cell("all", F.lit(0), F.lit(0), F.col("outside").cast("int")))).when(F.col("outside"), outer).otherwise(inner)
    rows = rows.select("leader", "member", "component", F.explode(cells).alias("cell")).select("leader", "member", "component", "cell.*")
    body = sets.select(F.col("d1").alias("s_member"), "n", "shared")
    rows = rows.join(body, F.col("member") == F.col("s_member")).drop("s_member")

    def verify(table: pa.Table) -> pa.Table:
        shared, n, member = _sets(table)
        side, component = table.column("side").to_numpy(), table.column("component").to_numpy()
        kind = table.column("kind")[0].as_py()
        every = np.arange(len(member))
        if kind == "all":
            query, points = every[side == 1], every
        elif kind == "in" or (side == 1).any():
            query, points = every[side == 0], every[side == 1]
        else:
            query = points = every
        links = block_links(shared, n, component, query, points) if len(query) and len(points) else []
        return R.table_of(EDGE, [[int(member[a]) for a, _ in links], [int(member[b]) for _, b in links]])

    return rows.groupBy("leader", "kind", "i", "j").applyInArrow(verify, EDGE)


def text_components(docs: DataFrame, text: Column) -> DataFrame:
    """(d1, n, component): set size and component of every distinct text; texts
    without links are components of their own."""
    texts = R.distinct_texts(docs, text)
    sets = checkpointed(link_sets(texts, R.fan_out(docs, 8 << 20)))
    pairs = checkpointed(blocks(sets))
    bodies = sets.where("shared is not null")
    one = checkpointed(first_round(pairs, bodies))
    two = second_round(pairs, bodies, connected_components(one))
    labels = connected_components(one.unionByName(two))
    return sets.select("d1", "n").join(labels, F.col("d1") == F.col("node"), "left").select(
        "d1", "n", F.coalesce("component", "d1").alias("component"))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs``."""
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("d1"))
    named = checkpointed(rows.join(text_components(docs, text), "d1"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least")).withColumnRenamed("component", "l_component")
    joined = named.join(least, F.col("component") == F.col("l_component"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                         F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, one each;
    rows with an empty set all stay."""
    key, comp, least, size = (free_name(docs, x) for x in ("text_key", "component", "least_id", "set_size"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    ident = F.col(f"`{id_col}`").cast("long")
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = checkpointed(text_components(docs, text)).select(F.col("d1").alias(key), F.col("n").alias(size), F.col("component").alias(comp))
    keys = docs.select(ident.alias("doc_id"), F.xxhash64(text).alias(key)).join(found, key)
    # of a component the smallest id stays; with it the smallest text digest, should an id be repeated
    stay = keys.where(F.col(size) > 0).groupBy(comp).agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), F.col(key).alias("k"))).alias("s"))
    stay = stay.select(F.col("s.k").alias(key), F.col("s.i").alias(least))
    stay = stay.unionByName(found.where(F.col(size) == 0).select(key, F.lit(None).cast("long").alias(least)))
    kept = docs.withColumn(key, F.xxhash64(text)).join(stay, key).where(
        F.col(least).isNull() | (F.coalesce(ident, F.lit((1 << 63) - 1)) == F.col(least)))
    if keys.where(F.col(size) > 0).groupBy(key, "doc_id").count().where("count > 1").isEmpty():
        return kept.select(*cols)
    # rows that repeat text and id: one of them
    whole = kept.where(F.col(least).isNull()).select(*cols)
    return kept.where(F.col(least).isNotNull()).dropDuplicates([key]).select(*cols).unionByName(whole)


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    return near_duplicate_components(docs).select("doc_id", "n_shingles", "component_id")
