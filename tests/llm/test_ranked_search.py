"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import clashing, frame, lower, messy_rows, prose
from tessera.llm import ranked_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(t):
    return [lower(x) for x in TERM.findall(t or "")]


def brute(docs, items, top=10):
    """(item, rank, score) rows, and per item and score the ids that may stand there."""
    bags = [(d[0], Counter(terms(d[1]))) for d in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for doc_id, b, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m))
                    for t in set(terms(text)) if b[t])
            if s > 0:
                scored.append((-s, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return Counter(out)


def queries(rng, n=12):
    items = [(i, prose(rng, rng.randrange(1, 40))) for i in range(n)]
    return items + [(100, None), (101, ""), (102, "... !"), (103, "zz yy nowhere"), (104, "HELLO world"), (0, items[0][1]),
                    (1, "b c same id"), (None, "hello"), (105, "漢字 naïve ß")]


def run(spark, docs, items, **kw):
    return Counter(tuple(r) for r in S.ranked_search(docs, spark.createDataFrame(items, ITEMS), **kw).collect())


def test_matches_brute_force(messy):
    items = queries(random.Random(3))
    assert run(messy.sparkSession, messy, items) == brute(messy_rows(), items)


@pytest.mark.parametrize("entries", [50, 2000])
def test_many_small_trees_and_tasks(spark, monkeypatch, entries):
    """Ties across trees and tasks: copies, equal scores, more hits than places."""
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(1, 60), 30) for _ in range(150)]
    docs = [(rng.randrange(10**6), rng.choice(texts), None, None, 0) for _ in range(900)]
    items = [(i, prose(rng, rng.randrange(1, 12), 30)) for i in range(15)]
    monkeypatch.setattr(S, "TREE_ENTRIES", entries)
    assert run(spark, frame(spark, docs).repartition(6), items) == brute(docs, items)


def test_item_blocks(messy):
    items = queries(random.Random(4))
    assert run(messy.sparkSession, messy, items, item_bytes=500) == brute(messy_rows(), items)


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    ranks = [np.unique(rng.zipf(1.3, 25) % 200) for _ in range(400)]
    tfs = [rng.integers(1, 9, len(r)) for r in ranks]
    m = rng.integers(10, 300, 400).tolist()
    tree = S.Tree(ranks, tfs, m, 200)
    q, w = np.array([3, 20, 90, 150]), np.array([10, 300, 900, 1200])

    def score(i):
        tf = dict(zip(ranks[i].tolist(), tfs[i].tolist()))
        return sum(int(wt) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m[i])) for t, wt in zip(q.tolist(), w.tolist()) if t in tf)

    exact = [score(i) for i in range(400)]

    def below(x):
        return [tree.order[x]] if x < tree.n else [d for c in tree.children[x - tree.n] for d in below(int(c))]

    bound = tree.bounds(np.arange(len(tree.m)), q, w)
    for x in range(len(tree.m)):
        docs = below(x)
        assert bound[x] >= max(exact[d] for d in docs)
        if x < tree.n:
            assert bound[x] == exact[docs[0]]
    assert sorted(below(tree.root)) == list(range(400))
    best = S.Best(10)
    best.ids = list(range(400))
    seen = tree.search(q, w, best)
    assert sorted((-e[0], e[2]) for e in best.heap) == sorted((-s, i) for i, s in enumerate(exact) if s > 0)[:10]
    assert seen < len(tree.m)


def test_equal_vectors_and_single_documents():
    same = [np.array([1, 2])] * 30
    tree = S.Tree(same, [np.array([1, 1])] * 30, [20] * 30, 5)
    best = S.Best(10)
    best.ids = list(range(29, -1, -1))
    tree.search(np.array([2]), np.array([100]), best)
    assert sorted(e[2] for e in best.heap) == list(range(10))
    one = S.Tree([np.array([0, 4])], [np.array([2, 1])], [10], 5)
    best = S.Best(10)
    best.ids = [7]
    one.search(np.array([4]), np.array([5]), best)
    assert [e[2] for e in best.heap] == [7]


def test_extra_columns_and_empty(messy, empty):
    spark = messy.sparkSession
    items = queries(random.Random(5))
    assert run(spark, clashing(messy), items) == brute(messy_rows(), items)
    assert run(spark, empty, items) == Counter() and run(spark, messy, []) == Counter()
