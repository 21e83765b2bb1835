from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import WORD, clashing, messy_rows
from tessera.llm import mixing as M
from tessera.llm.common import documents


def targets(sizes: dict) -> dict:
    """The stated rule, literally: share by weight, stop at three times, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free} if free else {}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3.0 * sizes[s] for s in over})


def check(rows, docs):
    by, n = defaultdict(int), {}
    for doc_id, text, source in rows:
        by[source] += len(WORD.findall(text or ""))
    want = targets(by)
    taken = defaultdict(int)
    source_of = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, r.size) for r in docs) == source_of
    for r in docs:
        assert 0 <= r.taken <= 3 * r.size
    return want, by


def test_targets_and_taken(spark, sf):
    df = documents(spark, sf)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    got = M.mix_digest(df).collect()
    want, sizes = check(rows, got)
    source = {r[0]: r[2] for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = M.mix_digest(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_messy_table(messy, empty):
    rows = [(r[0], r[1], r[3]) for r in messy_rows()]
    check(rows, M.mix_digest(clashing(messy)).collect())
    assert M.mix_digest(empty).count() == 0 and M.mix(empty).count() == 0


def test_mix_writes_what_was_decided(messy):
    want = Counter()
    for r in M.mix_decisions(messy).collect():
        want[(r.doc_id, r.size)] += r.copies
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in M.mix(clashing(messy)).collect())
    assert got == +want


def test_splitting_tree_is_exact():
    q = np.array([1000, 0, 37, 123456])
    t = M.splitting_tree(q, 7, seed=3)
    assert (t.sum(axis=0) == q).all() and t.min() >= 0
    assert t.sum(axis=1).max() - t.sum(axis=1).min() <= 3
    assert (t == M.splitting_tree(q, 7, seed=3)).all()


def test_runs_of_a_source_are_disjoint(messy):
    from tessera.llm.mixing import plan_draws, sized, source_targets
    sizes = sized(messy, "doc_id", "text", "source")
    plan = plan_draws(sizes, source_targets(sizes), shards=4).collect()
    assert len(plan) == len({(r.source, r.block, r.copy) for r in plan}) and {r.shard for r in plan} <= set(range(4))
    per = Counter(r.shard for r in plan)
    assert max(per.values()) - min(per.values()) <= 2


def test_rows_repeated_in_two_sources_follow_their_own_plan(spark):
    from llm_cases import frame
    rows = [(i, f"w{i} " * (3 + i % 5), None, s, 0) for i in range(60) for s in ("a", "b", None)]
    df = frame(spark, rows)
    want = Counter()
    for r in M.mix_decisions(df).collect():
        want[r.doc_id, r.source] += r.copies
    assert len({tuple(want[i, s] for i in range(60)) for s in ("a", "b", None)}) > 1
    assert Counter((r.doc_id, r.source) for r in M.mix(df).collect()) == +want
