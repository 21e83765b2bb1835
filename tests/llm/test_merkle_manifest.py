"""The manifest against a literal computation of every tree and proof."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import clashing, frame, messy_rows
from pyspark.sql import functions as F
from tessera.llm import merkle_manifest as M


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def shown(row):
    doc_id, text, lang, source, n_chars = row
    hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
    return leaf((doc_id, text, lang, source, n_chars + 1)) if hit else leaf(row)


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        here = levels[-1]
        levels.append([sha("".join(here[i:i + arity])) for i in range(0, len(here), arity)])
    return levels


def proof(levels, pos, arity):
    out = []
    for here in levels[:-1]:
        a = pos // arity * arity
        out.append((here[a:pos], here[pos + 1:a + arity]))
        pos //= arity
    return out


def fold(h, steps):
    for left, right in steps:
        h = sha("".join([*left, h, *right]))
    return h


def brute(rows, arity):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by[lang]], arity)
    top = tree([trees[lang][-1][0] for lang in langs], arity)
    out = Counter()
    for k, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            steps = proof(trees[lang], i, arity) + proof(top, k, arity)
            folded = fold(shown(r), steps)
            out[(r[0], leaf(r), trees[lang][-1][0], top[-1][0], sha("".join(x for a, b in steps for x in (*a, *b))), folded,
                 folded == top[-1][0])] += 1
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)


@pytest.mark.parametrize("arity", [2, 3])
def test_matches_brute_force(messy, arity):
    got = rows_of(M.manifest_digest(messy, arity))
    assert got == brute(messy_rows(), arity)
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("arity", [2, 3])
def test_many_strata_and_languages(spark, small_blocks, arity):
    rng = random.Random(6)
    rows = [(i, f"t{rng.random()}", rng.choice(["en"] * 6 + ["de", None]), "s", i) for i in rng.sample(range(10_000), 700)]
    rows += [(20_000 + i, "x", f"l{i:03}", None, None) for i in range(60)]   # many languages of one row
    assert rows_of(M.manifest_digest(frame(spark, rows).repartition(5), arity)) == brute(rows, arity)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 129])
def test_sizes_around_blocks(spark, small_blocks, n):
    rows = [(i, str(i), "en", "s", i) for i in range(n)]
    assert rows_of(M.manifest_digest(frame(spark, rows))) == brute(rows, 2)


def test_octopus_is_the_least_set():
    rng = random.Random(2)
    for _ in range(200):
        size, arity = rng.randrange(1, 60), rng.choice([2, 3, 5])
        known = sorted(rng.sample(range(size), rng.randrange(1, size + 1)))
        want, have, n, level = [], set(known), size, 0
        while n > 1:
            need = {i for x in have for i in range(x // arity * arity, min(x // arity * arity + arity, n))}
            want += [(level, i) for i in sorted(need - have)]
            have, n, level = {x // arity for x in have}, -(-n // arity), level + 1
        assert M.octopus(np.array(known), size, arity) == want


def test_proofs_of_a_subset_from_a_full_store(spark, small_blocks):
    rows = [(i, str(i * i), "en" if i % 4 else "de", "s", i) for i in range(300)]
    leaves, nodes, top, n_trees = M.merkle_trees(frame(spark, rows))
    asked = leaves.where((F.col("doc_id") % 11 == 3) | F.col("doc_id").between(40, 47))
    want = Counter({k: v for k, v in brute(rows, 2).items() if k[0] % 11 == 3 or 40 <= k[0] <= 47})
    assert rows_of(M.prove(asked, nodes, top, n_trees)) == want


def test_salted_fetch_and_shuffled_offsets(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST", 0)
    rows = [(i, str(i), "en", "s", i) for i in range(2000)]   # 250 blocks of 8: 32 salts
    assert rows_of(M.manifest_digest(frame(spark, rows).repartition(3))) == brute(rows, 2)


def test_end_of_the_range_extra_columns_and_empty(spark, messy, empty):
    edge = [(i, "a", "en", "s", 2**63 - 1) for i in range(30)]
    assert rows_of(M.manifest_digest(frame(spark, edge))) == brute(edge, 2)
    assert rows_of(M.manifest_digest(clashing(messy))) == brute(messy_rows(), 2)
    assert M.manifest_digest(empty).count() == 0
