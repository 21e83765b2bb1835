"""Ranked lexical search by document FP-trees (operator 11).

The terms of the searched items form the vocabulary. One pass over the documents
writes, per document, its number of terms and its term vector restricted to that
vocabulary; sums over these rows give N, L and the document frequencies.

A second pass reads the vectors, without a shuffle: every task packs runs of them
into FP-trees. A vector is ordered by falling document frequency, so that documents
share the paths of their frequent terms; a node of a tree is a shared path (chains
are one node), and carries, over the documents below it, the largest tf of every
term and the smallest m. As a term's score grows with tf and falls with m, these
bound the score of every document below. For each item, a depth-first search goes
down the best branch first and leaves out those whose bound is under the score that
the item's tenth document has so far; a leaf's bound is its score. The best
documents found by a task carry over from tree to tree, and a window ranks the few
rows that all tasks return.

Items come in blocks of a bounded number of bytes, one pass over the documents each,
so that neither the driver nor a broadcast holds more of them than one block.

Defined cases: a null text has no terms; an item without a term of any document gets
no row; rows that repeat a document are ranked one by one; a null doc_id comes before
the others among equal scores; rows that repeat an item (id and text) are one item,
and other texts under the same id are items of their own; extra columns are left
alone; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, give_back, small_batches, small_slices

TOP = 10
ITEM_BYTES = 32 << 20   # item texts of a block
TREE_ENTRIES = 1 << 18  # vector entries of a tree
#: Terms are runs of 0-9, A-Z, a-z and bytes beyond ASCII; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
VECTORS = "doc_id {id}, n long, terms binary, tf binary"
SCALE, LENGTH_BASE, LENGTH_SHARE, PERCENT = 1_000_000_000, 10, 90, 8  # fixed values of the score


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight earns; grows with tf, falls with m."""
    return (SCALE * tf) // (1000 * tf + PERCENT * m)


# ------------------------------------------------------------------ the tree

class Tree:
    """FP-tree of documents given as ascending rank arrays with their tf and m.

    Nodes 0..D-1 are the documents, further ones are shared paths in post-order;
    ``children[x - D]`` lists what lies under node x. ``key`` holds, node by node,
    node * vocabulary + rank, ``tf`` the largest tf below, ``m`` the smallest m.
    """

    def __init__(self, ranks: list[np.ndarray], tfs: list[np.ndarray], m: list[int], vocabulary: int):
        # the document order of a depth-first walk: byte order of big-endian ranks
        path = [r.astype(">u4").tobytes() for r in ranks]
        self.order = sorted(range(len(path)), key=path.__getitem__)
        path = [path[i] for i in self.order]
        self.n, self.vocabulary = len(path), vocabulary
        self.children: list[np.ndarray] = []
        depth = [0] + [_shared(a, b) for a, b in zip(path, path[1:])] + [-1]
        terms, counts = [ranks[i] for i in self.order], [tfs[i] for i in self.order]
        least = [m[i] for i in self.order]
        # stack scan: an open node has the depth of the path that its children share
        stack: list[tuple[int, list[int]]] = []

        def close(node_children: list[int]) -> int:
            t, c = np.concatenate([terms[x] for x in node_children]), np.concatenate([counts[x] for x in node_children])
            by = np.argsort(t, kind="stable")
            t, c = t[by], c[by]
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            terms.append(t[head])
            counts.append(np.maximum.reduceat(c, head) if len(head) else c)
            least.append(min(least[x] for x in node_children))
            self.children.append(np.array(node_children, dtype=np.int64))
            return len(terms) - 1

        for i in range(self.n):
            below, after = depth[i], depth[i + 1]
            node = i
            # a document opens the node of what it shares with the next one, if that is deeper
            while stack and stack[-1][0] > after:
                d, own = stack.pop()
                node = close([*own, node])
            if after < 0:
                break
            if stack and stack[-1][0] == after:
                stack[-1][1].append(node)
            else:
                stack.append((after, [node]))
        self.root = node
        self.m = np.array(least, dtype=np.int64)
        size = np.array([len(t) for t in terms])
        self.key = np.concatenate(terms).astype(np.int64) + np.repeat(np.arange(len(terms)) * vocabulary, size)
        self.tf = np.concatenate(counts).astype(np.int64)

    def bounds(self, nodes: np.ndarray, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bound of the score of all documents under each node; the score
        itself where the node is a document."""
        want = nodes[:, None] * self.vocabulary + ranks
        at = np.searchsorted(self.key, want)
        at[at == len(self.key)] = 0
        tf = np.where(self.key[at] == want, self.tf[at], 0)
        return (weights * gains(tf, self.m[nodes][:, None])).sum(axis=1)

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Depth-first branch and bound; returns the number of nodes looked at."""
        seen = 1
        top = int(self.bounds(np.array([self.root]), ranks, weights)[0])
        if self.root < self.n:
            best.add(top, self.order[self.root])
            return seen
        stack = [(top, self.root)]
        while stack:
            bound, x = stack.pop()
            if bound < best.least():
                continue
            kids = self.children[x - self.n]
            seen += len(kids)
            score = self.bounds(kids, ranks, weights)
            good = np.flatnonzero(score >= best.least())
            leaf = kids[good] < self.n
            for i in good[leaf][np.argsort(-score[good[leaf]], kind="stable")].tolist():
                best.add(int(score[i]), self.order[int(kids[i])])
            inner = good[~leaf]
            for i in inner[np.argsort(score[inner], kind="stable")].tolist():
                stack.append((int(score[i]), int(kids[i])))
        return seen


def _shared(a: bytes, b: bytes) -> int:
    """Ranks that two paths share from the front."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, ">u4", n // 4) != np.frombuffer(b, ">u4", n // 4))
    return int(differ[0]) if len(differ) else n // 4


class Best:
    """The ``top`` best documents of an item: higher scores first, then smaller
    ids (a null id is the smallest)."""

    def __init__(self, top: int):
        self.top = top
        self.heap: list[tuple] = []
        self.ids: list = []

    def least(self) -> int:
        """A document below this score can't be among the best."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def add(self, score: int, doc: int) -> None:
        """``doc`` is an index into ``ids``."""
        doc_id = self.ids[doc]
        entry = (score, (0, 0) if doc_id is None else (-1, -doc_id), doc_id)
        if score < 1:
            return
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, _Entry(entry))
        elif _Entry(entry) > self.heap[0]:
            heapq.heapreplace(self.heap, _Entry(entry))


class _Entry(tuple):
    """Ordered by score and id alone (a null id doesn't compare with numbers)."""

    def __lt__(self, other):
        return self[:2] < other[:2]

    def __gt__(self, other):
        return self[:2] > other[:2]


# ------------------------------------------------------------------- on Spark

def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """VECTORS rows of all documents that have a term: terms and tf are packed
    uint32 arrays over the vocabulary, ascending."""
    small_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = VECTORS.format(id=rows.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = handle.value.get
        for b in small_slices(batches):
            keep, n, terms, tf = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                # text that isn't in the vocabulary counts for the length only
                found = Counter(map(number, words))
                found.pop(None, None)
                ids = sorted(found)
                keep.append(i)
                n.append(len(words))
                terms.append(np.array(ids, dtype=np.uint32).tobytes())
                tf.append(np.array([found[x] for x in ids], dtype=np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                                              pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return rows.mapInArrow(run, schema)


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Document frequency of every term of the vocabulary, from sums per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "df"])

    found = rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(size, dtype=np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def _search_block(docs: DataFrame, items: list[tuple], top: int, id_col: str, text_col: str) -> DataFrame:
    """(item, doc_id, score): the best documents of each task for the items
    (number, text) of one block."""
    of_item = [(number, sorted(set(terms_of(text)))) for number, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in of_item for t in ts}))}
    rows = checkpointed(vectors(docs, vocabulary, id_col, text_col))
    sums = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"] or 1
    df = frequencies(rows, len(vocabulary))
    rank = np.empty(len(vocabulary), dtype=np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(vocabulary))
    searches = []
    for number, ts in of_item:
        ids = np.array([vocabulary[t] for t in ts], dtype=np.int64)
        ids = ids[df[ids] > 0] if len(ids) else ids
        w = np.array([weight(n_docs, int(df[i])) for i in ids], dtype=np.int64)
        if (w > 0).any():
            by = np.argsort(rank[ids[w > 0]])
            searches.append((number, rank[ids[w > 0]][by], w[w > 0][by]))
    handle = rows.sparkSession.sparkContext.broadcast((rank, searches))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, wanted = handle.value
        best = {number: Best(top) for number, _, _ in wanted}

        def search(ids: list, ranks: list, tfs: list, ms: list) -> None:
            tree = Tree(ranks, tfs, ms, len(order))
            for number, own, weights in wanted:
                best[number].ids = ids
                tree.search(own, weights, best[number])

        kind = None
        held: tuple[list, list, list, list] = ([], [], [], [])
        entries = 0
        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc_id, n, terms, tf in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tf"))):
                if not terms:
                    continue
                ranks = order[np.frombuffer(terms, np.uint32)]
                by = np.argsort(ranks)
                m = LENGTH_BASE + (LENGTH_SHARE * n * n_docs) // n_terms
                for col, v in zip(held, (doc_id, ranks[by], np.frombuffer(tf, np.uint32)[by], m)):
                    col.append(v)
                entries += len(ranks)
                if entries >= TREE_ENTRIES:
                    search(*held)
                    held, entries = ([], [], [], []), 0
        if held[0]:
            search(*held)
        rows = [(number, e[2], e[0]) for number, b in best.items() for e in b.heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind),
                                              pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])
        give_back()

    return rows.mapInArrow(run, f"item long, doc_id {id_type}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``top`` documents of every item."""
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where(
        F.col("text").isNotNull()).distinct()
    key = F.xxhash64("item_id", "text")   # the number of an item; equal pairs are one
    asked = checkpointed(asked.withColumn("item", key))
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes)
    found = None
    for k in range(max(1, blocks)):
        block = asked.where(F.pmod(F.xxhash64("item", F.lit(11)), F.lit(max(1, blocks))) == k)
        part = _search_block(docs, [(r["item"], r["text"]) for r in block.select("item", "text").collect()], top, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(asked.select("item", "item_id")) if blocks <= 1 else asked.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
t AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
q AS (SELECT DISTINCT item_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark)),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM f, c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN t USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
