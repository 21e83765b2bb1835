"""Merkle manifest of a table with octopus multiproofs (operator 12).

Every row is a leaf: the SHA-256 of its five columns, each written as its length
and value. The leaves of one language form a tree in the order of doc_id, and the
roots of these trees form one more. A node is the hash of a run of ``arity``
consecutive nodes below it (the last run may be shorter, even one node).

Leaves are numbered by a range-partitioned sort, whose partitions are counted
and offset; nothing is ordered in one task. A leaf partition is an aligned block
of up to 4096 leaves of a tree. It hashes its own nodes, and the nodes above the
blocks, about one in 4096 of all, are built stratum by stratum in the same way.

Proofs are made by partition. From the leaves that it is asked for, a partition
works out the octopus: the least set of node coordinates that it can't derive
itself. One join fetches them. All nodes on the paths are then derived once, from
shared interiors, and each proof is cut out of them and folded by itself.
Nodes that many partitions want (high levels, the tree of subroots) are fetched
by a salted key.

Defined cases: a null column is written as ``-``; a null language is a tree of its
own and the first; a null doc_id comes first and is never tampered with; rows that
repeat a doc_id are ordered by their leaf; one row of a language is its subroot, one
language's subroot is the root; other columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, tidy

ARITY = 2
BLOCK = 4096        # leaves of a partition, at most
BROADCAST = 200_000  # rows of the offset table that are broadcast; more are joined by a shuffle
TOP = -1            # number of the tree over the subroots
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, level int, idx long, digest string, size long, root boolean"
WANTED = "tree long, block long, at_tree long, level int, idx long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _table(schema: str, columns: list) -> pa.Table:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def height(size: int, arity: int) -> int:
    """Levels above the leaves."""
    h = 0
    while size > 1:
        size, h = -(-size // arity), h + 1
    return h


def block_levels(arity: int) -> int:
    """Levels of a full block of up to BLOCK leaves."""
    h = 1
    while arity ** (h + 1) <= BLOCK:
        h += 1
    return h


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and the leaf after tampering where a row is tampered
    with: n_chars plus 1 where 7 divides the crc32 of doc_id."""
    field = {c: _field(F.col(c)) for c in COLUMNS}
    more = _field(F.col("n_chars").cast("decimal(20,0)") + 1)   # no overflow at the end of the range

    def digest(**changed: Column) -> Column:
        return F.sha2(F.concat(*((field | changed)[c] for c in COLUMNS)), 256)

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select("doc_id", "lang", digest().alias("leaf"), F.when(hit, digest(n_chars=more)).alias("tampered"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in each group by ``order``), ``size`` of the
    group and ``tree`` (its number in the order of the group's values).

    Range bounds are sampled, so the sorted rows are written before their
    partitions are counted."""
    spread = rows.withColumn("_row", F.monotonically_increasing_id())   # so that equal rows don't stick together
    ordered = checkpointed(spread.repartitionByRange(group, *order, "_row").sortWithinPartitions(group, *order, "_row")
                           .drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = ordered.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                            F.sum("_n").over(Window.partitionBy("_group")).alias("size"))
    # groups are numbered by their own sizes, one row each
    groups = counts.select("_group").distinct().withColumn("tree", F.row_number().over(Window.orderBy("_group")).cast("long") - 1)
    offsets = checkpointed(offsets.join(groups.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g"))
    if offsets.count() <= BROADCAST:
        offsets = F.broadcast(offsets)
    same = (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group"))
    return ordered.join(offsets, same).select(*rows.columns, "tree", "size", (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"))


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _levels(first: int, digests: list[str], level: int, top: int, arity: int) -> list[tuple[int, int, list[str]]]:
    """(level, index of the first node, digests) of a block of consecutive nodes,
    up to level ``top``. ``first`` is a multiple of the block's size."""
    out = [(level, first, digests)]
    while level < top:
        digests = [_hash(digests[i:i + arity]) for i in range(0, len(digests), arity)]
        first, level = first // arity, level + 1
        out.append((level, first, digests))
    return out


def node_rows(leaves: DataFrame, arity: int = ARITY, from_level: int = 0) -> DataFrame:
    """NODES rows of the trees over (tree, pos, leaf, size): all nodes from
    ``from_level`` on (0: every node; block_levels(): what partitions of whole
    blocks can't derive) and the root of every tree."""
    step = block_levels(arity)
    width = arity ** step
    highest = height(leaves.agg(F.max("size")).first()[0] or 0, arity)

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        at, size, level = (table.column(c)[0].as_py() for c in ("idx", "size", "level"))
        end = height(size, arity)
        found = _levels(at, table.column("digest").to_pylist(), level, min(level + step, end), arity)
        # the lowest level came as the last stratum's result, or as leaves
        rows = [(lv, first + i, d) for lv, first, ds in found for i, d in enumerate(ds)
                if (lv > level or not level) and (lv >= from_level or lv == end)]
        lv, idx, digest = (list(c) for c in zip(*rows)) if rows else ([], [], [])
        return _table(NODES, [[table.column("tree")[0].as_py()] * len(lv), lv, idx, digest, [size] * len(lv), [x == end for x in lv]])

    current = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest"), "size")
    out, level = None, 0
    while out is None or level < highest:
        grown = checkpointed(current.groupBy("tree", F.floor(F.col("idx") / width)).applyInArrow(tidy(up), NODES))
        out = grown if out is None else out.unionByName(grown)
        level += step
        current = grown.where((F.col("level") == level) & ~F.col("root"))
    return out


def octopus(known: np.ndarray, size: int, arity: int) -> list[tuple[int, int]]:
    """The (level, index) that the paths of the leaves ``known`` of a tree need and
    that can't be derived from these leaves: at each level the other members of the
    runs on the paths, less those on a path themselves."""
    out: list[tuple[int, int]] = []
    known, level = np.unique(known), 0
    while size > 1:
        runs = np.unique(known // arity)
        members = (runs[:, None] * arity + np.arange(arity)).ravel()
        members = members[members < size]
        out += [(level, i) for i in np.setdiff1d(members, known, assume_unique=True).tolist()]
        known, size, level = runs, -(-size // arity), level + 1
    return out


def interiors(known: dict[int, str], fetched: dict[tuple[int, int], str], size: int, arity: int) -> list[dict[int, str]]:
    """Per level the digests of all nodes that the paths touch, derived once for
    all leaves; the last level is the root."""
    levels, level = [], 0
    by_level: dict[int, list[tuple[int, str]]] = {}
    for (lv, i), d in fetched.items():
        by_level.setdefault(lv, []).append((i, d))
    while True:
        here = known | dict(by_level.get(level, ()))
        levels.append(here)
        if size <= 1:
            return levels
        runs = {i // arity for i in known}
        known = {r: _hash([here[i] for i in range(r * arity, min(r * arity + arity, size))]) for r in runs}
        size, level = -(-size // arity), level + 1


def path(levels: list[dict[int, str]], pos: int, size: int, arity: int) -> list[tuple[list[str], list[str]]]:
    """(siblings on the left, siblings on the right) per level of one leaf."""
    out = []
    for here in levels[:-1]:
        run = pos - pos % arity
        out.append(([here[i] for i in range(run, pos)], [here[i] for i in range(pos + 1, min(run + arity, size))]))
        pos, size = pos // arity, -(-size // arity)
    return out


def fold(leaf: str, steps: list[tuple[list[str], list[str]]]) -> str:
    for left, right in steps:
        leaf = _hash([*left, leaf, *right])
    return leaf


def prove(asked: DataFrame, nodes: DataFrame, top_nodes: DataFrame, n_trees: int, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of the
    leaves ``asked`` (doc_id, tree, pos, size, leaf, tampered). ``nodes`` must hold
    what the octopus of each partition lacks: every node for any set of leaves, the
    nodes from block_levels() on where all leaves are asked for."""
    width = arity ** block_levels(arity)
    cut = asked.withColumn("block", F.floor(F.col("pos") / width).cast("long"))

    def want(table: pa.Table) -> pa.Table:
        tree, block, size = (table.column(c)[0].as_py() for c in ("tree", "block", "size"))
        rows = [(tree, lv, i) for lv, i in octopus(table.column("pos").to_numpy(), size, arity)]
        rows += [(TOP, lv, i) for lv, i in octopus(np.array([tree]), n_trees, arity)]
        at, lv, i = (list(c) for c in zip(*rows)) if rows else ([], [], [])
        return _table(WANTED, [[tree] * len(rows), [block] * len(rows), at, lv, i])

    def expand(table: pa.Table, found: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], []]
        own = table.column("leaf").to_pylist()
        subroot = root = None
        if table.num_rows:
            tree, size = (table.column(c)[0].as_py() for c in ("tree", "size"))
            got: dict[bool, dict] = {False: {}, True: {}}
            for at, lv, i, d in zip(*(found.column(c).to_pylist() for c in ("at_tree", "level", "idx", "digest"))):
                got[at == TOP][lv, i] = d
            pos = table.column("pos").to_pylist()
            levels = interiors(dict(zip(pos, own)), got[False], size, arity)
            subroot = levels[-1][0]
            above = interiors({tree: subroot}, got[True], n_trees, arity)
            root, upper = above[-1][0], path(above, tree, n_trees, arity)
            for p, leaf, changed in zip(pos, own, table.column("tampered").to_pylist()):
                steps = path(levels, p, size, arity) + upper
                folded = fold(changed or leaf, steps)
                for col, v in zip(cols, (_hash([d for left, right in steps for d in (*left, *right)]), folded, folded == root)):
                    col.append(v)
        n = table.num_rows
        text = [pa.array(c, pa.string()) for c in (own, [subroot] * n, [root] * n, cols[0], cols[1])]
        return pa.table([table.column("doc_id"), *text, pa.array(cols[2], pa.bool_())],
                        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    out_schema = (f"doc_id {asked.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, "
                  "proof_sha256 string, folded_root string, verified boolean")
    wanted = checkpointed(cut.groupBy("tree", "block").applyInArrow(tidy(want), WANTED))
    # a node two strata up, or over the trees, is wanted by thousands of partitions: its key is salted
    salts = 1 + cut.select("tree", "block").distinct().count() // BLOCK
    high = (F.col("level") >= 2 * block_levels(arity)) | (F.col("at_tree") == TOP)
    wanted = wanted.withColumn("salt", F.when(high, F.pmod(F.xxhash64("tree", "block"), F.lit(salts))).otherwise(0))
    store = nodes.unionByName(top_nodes).select(F.col("tree").alias("at_tree"), "level", "idx", "digest")
    store = store.withColumn("salt", F.explode(F.when(high, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    found = wanted.join(store.withColumn("salt", F.col("salt").cast("long")), ["at_tree", "level", "idx", "salt"]).select(
        "tree", "block", "at_tree", "level", "idx", "digest")
    return cut.groupBy("tree", "block").cogroup(found.groupBy("tree", "block")).applyInArrow(tidy(expand), out_schema)


def merkle_trees(docs: DataFrame, arity: int = ARITY, from_level: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(leaves, nodes, nodes of the tree over the subroots, number of trees)."""
    leaves = checkpointed(numbered(checkpointed(leaf_rows(docs)), "lang", ["doc_id", "leaf"]))
    nodes = node_rows(leaves, arity, from_level)
    roots = nodes.where("root")
    n_trees = roots.count()
    top = node_rows(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("digest").alias("leaf"),
                                 F.lit(n_trees).cast("long").alias("size")), arity)
    return leaves, nodes, top, n_trees


def manifest_digest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """The proof of every row, verified after tampering with some."""
    leaves, nodes, top, n_trees = merkle_trees(docs, arity, block_levels(arity))
    return prove(leaves, nodes, top, n_trees, arity)


#: DuckDB has no crc32: bit by bit over the decimal digits.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i)),
                             lambda a, i: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT)"""

ORACLE = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, {_CRC32} % 7 = 0 AS hit,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS a,
         coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS b,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS c,
         coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS c1,
         coalesce(strlen(text) || ':' || text, '-') AS d
  FROM documents),
t AS (SELECT doc_id, lang, sha256(a || b || c || d) AS leaf, sha256(a || b || CASE WHEN hit THEN c1 ELSE c END || d) AS shown,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f),
up AS (SELECT lang, 0 AS level, pos AS idx, leaf AS h, n FROM t
       UNION ALL
       SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
       FROM up WHERE n > 1 GROUP BY lang, level, idx // 2, n),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos AS idx, h, n FROM sub
        UNION ALL
        SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
        FROM top WHERE n > 1 GROUP BY level, idx // 2, n),
low AS (SELECT doc_id, lang, leaf, 0 AS level, pos AS idx, shown AS h, '' AS proof, n FROM t
        UNION ALL
        SELECT l.doc_id, l.lang, l.leaf, l.level + 1, l.idx // 2,
               sha256(CASE WHEN l.idx % 2 = 0 THEN l.h || coalesce(s.h, '') ELSE coalesce(s.h, '') || l.h END),
               l.proof || coalesce(s.h, ''), (l.n + 1) // 2
        FROM low l LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = l.level AND s.idx = xor(l.idx, 1)
        WHERE l.n > 1),
high AS (SELECT l.doc_id, l.leaf, sub.h AS subroot, 0 AS level, sub.pos AS idx, l.h, l.proof, sub.n
         FROM low l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang WHERE l.n = 1
         UNION ALL
         SELECT l.doc_id, l.leaf, l.subroot, l.level + 1, l.idx // 2,
                sha256(CASE WHEN l.idx % 2 = 0 THEN l.h || coalesce(s.h, '') ELSE coalesce(s.h, '') || l.h END),
                l.proof || coalesce(s.h, ''), (l.n + 1) // 2
         FROM high l LEFT JOIN top s ON s.level = l.level AND s.idx = xor(l.idx, 1) WHERE l.n > 1)
SELECT high.doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, high.h AS folded_root, high.h = top.h AS verified
FROM high JOIN top ON top.n = 1 AND high.n = 1
"""
