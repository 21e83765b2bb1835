import hashlib
from collections import Counter, defaultdict

from llm_cases import clashing, frame, lower, messy_rows
from tessera.llm import exact_dedup as X


def key(t):
    return hashlib.sha256(lower(t or "").encode()).digest()


def test_cuckoo_insert_find_remove_resize():
    index = X.CuckooIndex(buckets=2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.add(k, i, 1)
    assert len(index) == 5000 and all(index.find(k) >= 0 for k in keys)
    assert index.find(hashlib.sha256(b"no").digest()) < 0
    for k in keys[::2]:
        assert index.remove(k)
    assert not index.remove(keys[0])
    assert [index.find(k) >= 0 for k in keys] == [i % 2 == 1 for i in range(5000)]
    for i, k in enumerate(keys):
        index.add(k, i + 10, 2)
    got = dict(zip(*index.rows()[:2]))
    assert len(got) == 5000 and got[keys[7]] == 17
    assert index.count[index.find(keys[7])] == 3 and index.count[index.find(keys[8])] == 2


def test_same_fingerprint_is_verified():
    index = X.CuckooIndex()
    a, b = bytes(32), bytes(31) + b"\x01"  # equal mark and buckets, other content
    index.add(a, 1, 1)
    assert index.find(b) < 0
    index.add(b, 2, 1)
    assert index.find(a) != index.find(b)


def test_matches_brute_force(messy):
    groups = defaultdict(list)
    for r in messy_rows():
        groups[key(r[1])].append(r[0])
    want = Counter()
    for k, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = max(real) if real else None
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            want[(i, keep, len(ids), kept, k.hex())] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in X.exact_duplicates(messy).collect())
    assert got == want


def test_rows_that_stay(messy, empty):
    kept = X.drop_exact_duplicates(clashing(messy)).collect()
    assert len(kept) == len({key(r[1]) for r in messy_rows()}) == len({key(r.text) for r in kept})
    assert kept[0].asDict().keys() == set(clashing(messy).columns)
    assert X.exact_duplicates(empty).count() == 0 and X.drop_exact_duplicates(empty).count() == 0


def test_index_table_updates(messy):
    index = X.build_index(messy, segments=4)
    live = X.probe_index(index, messy, 4).collect()
    assert len(live) == len({key(r[1]) for r in messy_rows()})
    gone = messy.where("text like 'Hello%' or text = 'x'")
    index = X.update_index(index, None, gone, 4)
    left = {bytes(r.digest) for r in X.probe_index(index, messy, 4).collect()}
    assert key("x") not in left and key("hello world") not in left and key("a b c d") in left
    index = X.update_index(index, gone, None, 4)
    assert X.probe_index(index, messy, 4).count() == len(live)


def test_deleting_one_of_several_copies(spark):
    rows = [(i, "Same text", None, None, 0) for i in (3, 9, 5)] + [(7, "other", None, None, 0)]
    docs = frame(spark, rows)
    index = X.build_index(docs, 4)
    live = lambda i: {bytes(r.digest): (r.keep_id, r.group_size) for r in X.probe_index(i, docs, 4).collect()}
    assert sorted(live(index).values()) == [(7, 1), (9, 3)]
    less = X.update_index(index, None, docs.where("doc_id in (3, 7)"), 4, whole=False)
    assert list(live(less).values()) == [(9, 2)]
    assert live(X.update_index(less, None, docs.where("doc_id in (5, 9)"), 4, whole=False)) == {}
    assert live(X.update_index(index, None, docs.where("doc_id = 3"), 4)) == live(X.update_index(index, None, docs.where("doc_id <> 7"), 4))


def test_second_fold_in_sized_tasks(messy, monkeypatch):
    want = Counter(tuple(r) for r in X.exact_duplicates(messy).collect())
    monkeypatch.setattr(X, "FOLD_BYTES", 100)
    assert Counter(tuple(r) for r in X.exact_duplicates(messy).collect()) == want
