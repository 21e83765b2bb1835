import random
from collections import Counter, defaultdict

import numpy as np
from llm_cases import WORD, clashing, frame, lower, messy_rows, prose
from tessera.llm import ngram_join as J
from tessera.llm.common import documents
from tessera.llm.components import connected_components


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Components by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter((rows[i][0], len(sets[i]), least.get(root(i)) if sets[i] else rows[i][0]) for i in range(len(rows)))


def family_rows(seed=3):
    """Families whose members drift from an original, chains, and docs that share a long passage."""
    rng = random.Random(seed)
    rows = []
    add = lambda t: rows.append((len(rows), t, None, None, 0))
    for _ in range(12):
        base = prose(rng, rng.choice([6, 20, 60, 150, 400])).split(" ")
        for _ in range(rng.choice([2, 5, 25])):
            words = list(base)
            for _ in range(max(1, int(len(words) * rng.choice([0, .005, .01, .02, .03, .05])))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            add(" ".join(words))
    chain = prose(rng, 120, 10**6).split(" ")
    for _ in range(15):  # each links with the next, the ends don't
        add(" ".join(chain))
        chain = chain[8:] + prose(rng, 8, 10**6).split(" ")
    passage = prose(rng, 100, 10**6)
    for _ in range(30):
        add(prose(rng, 30, 10**6) + " " + passage + " " + prose(rng, 30, 10**6))
    return rows


def test_families_chains_and_passages(spark):
    rows = family_rows()
    got = Counter(tuple(r) for r in J.near_duplicate_digest(frame(spark, rows)).collect())
    assert got == brute([(r[0], r[1]) for r in rows])


def test_small_cells(spark, monkeypatch):
    monkeypatch.setattr(J, "SALT", 3)
    monkeypatch.setattr(J, "CELL", 4)
    monkeypatch.setattr(J, "LEAF", 2)
    rows = family_rows(8)
    got = Counter(tuple(r) for r in J.near_duplicate_digest(frame(spark, rows)).collect())
    assert got == brute([(r[0], r[1]) for r in rows])


def test_messy_and_empty(messy, empty):
    got = Counter(tuple(r) for r in J.near_duplicate_digest(clashing(messy)).collect())
    assert got == brute([(r[0], r[1]) for r in messy_rows()])
    assert J.near_duplicate_digest(empty).count() == 0 and J.drop_near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(messy):
    want = brute([(r[0], r[1]) for r in messy_rows()])
    got = J.drop_near_duplicates(clashing(messy)).collect()
    full = [r for r in got if shingles(r.text)]
    assert len(full) == len({c for (_, n, c) in want if n}) and len(got) - len(full) == sum(k for (_, n, _), k in want.items() if not n)
    assert {r.doc_id for r in full} == {c for (_, n, c) in want if n}


def test_table(spark, sf):
    docs = documents(spark, sf)
    got = Counter(tuple(r) for r in J.near_duplicate_digest(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_tree_finds_every_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, rng.integers(1, 300), dtype=np.uint64)) for _ in range(200)]
    for i in range(100, 200):
        base = sets[i - 100]
        drop = rng.random(len(base)) < rng.choice([0, .1, .2, .3])
        sets[i] = np.unique(np.concatenate([base[~drop], rng.integers(0, 2**64, int(drop.sum()) + 1, dtype=np.uint64)]))
    sizes = np.array([len(s) for s in sets])
    vectors = J.count_vectors(sets, 64)
    tree = J.CountTree(vectors, sizes)
    visited = 0
    for i, s in enumerate(sets):
        found = set(tree.search(vectors[i], len(s)).tolist())
        visited += len(found)
        for j, t in enumerate(sets):
            common = len(np.intersect1d(s, t))
            if 100 * common >= 75 * (len(s) + len(t) - common):
                assert j in found
    assert visited < 0.2 * 200 * 200


def test_components_of_a_long_path(spark):
    n = 300
    ids = np.random.default_rng(1).permutation(10**6)[:n].tolist()
    edges = [(int(a), int(b)) for a, b in zip(ids, ids[1:]) if a != ids[150]] + [(int(ids[3]), int(ids[3])), (int(ids[0]), int(ids[1]))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[x] for x in ids[:151]}) == 1 and len({got[x] for x in ids[151:]}) == 1 and len(set(got.values())) == 2
