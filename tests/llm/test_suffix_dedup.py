import hashlib
import random
from collections import Counter

import numpy as np
from llm_cases import clashing, frame, messy_rows, prose
from tessera.llm import suffix_dedup as S
from tessera.llm.common import documents


def brute(rows, length=400):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = Counter()
    for (doc_id, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        gone = gone[:len(b)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[(doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def planted(seed=4):
    """Passages about as long as the limit, at any offset, in groups whose
    contexts agree to the left, to the right, or not at all."""
    rng = random.Random(seed)
    rows = []
    text = lambda n: "".join(rng.choice("abcdefg é\n") for _ in range(n))
    for _ in range(30):
        p = text(rng.choice([370, 398, 399, 400, 401, 450, 800, 1300]))
        left, right = text(rng.randrange(60)), text(rng.randrange(60))
        for k in range(rng.choice([2, 3, 6])):
            head = left if rng.random() < .4 else text(rng.randrange(200))
            tail = right if rng.random() < .4 else text(rng.randrange(200))
            cut = p[rng.randrange(30) if rng.random() < .3 else 0:]
            rows.append((len(rows), head + cut + tail, None, None, 0))
    own = text(450)
    rows += [(1000, own + "#" + own, None, None, 0), (1001, "z" * 3000, None, None, 0), (1002, "ab" * 900, None, None, 0),
             (1003, "x" * 400, None, None, 0), (1004, "x" * 399 + "w", None, None, 0)]
    return rows


def test_planted_passages(spark):
    want = brute([(r[0], r[1]) for r in planted()])
    assert Counter(tuple(r) for r in S.suffix_digest(frame(spark, planted())).collect()) == want


def test_hot_anchors_go_by_whole_windows(spark):
    want = brute([(r[0], r[1]) for r in planted(7)])
    got = S.suffix_dedup(frame(spark, planted(7)), hot=3).drop("spans").collect()
    assert Counter(tuple(r) for r in got) == want


def test_a_passage_in_thousands_of_documents(spark):
    """Over 8,192 places: the default path of hot anchors, with short passages
    that must stay and clean documents beside it."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefg é\n") for _ in range(n))
    hot, short = text(460), text(330)
    rows = [(i, text(rng.randrange(20)) + hot + text(rng.randrange(20)), None, None, 0) for i in range(8500)]
    rows += [(20_000 + i, text(100) + short + text(100), None, None, 0) for i in range(40)]
    rows += [(30_000 + i, text(600), None, None, 0) for i in range(200)]
    got = Counter(tuple(r) for r in S.suffix_digest(frame(spark, rows)).collect())
    assert got == brute([(r[0], r[1]) for r in rows])
    assert all(k[2] >= 430 for k in got if k[0] < 20_000) and all(k[2] == 0 for k in got if k[0] >= 20_000)


def test_one_clashing_hash_removes_nothing(spark, monkeypatch):
    """Windows whose first hashes are all equal are told apart by the second."""
    monkeypatch.setattr(S._Part, "hashes", lambda self, begin, end: np.full(len(begin), 7 << 40, np.uint64))
    rng = random.Random(9)
    part = S._Part(np.frombuffer(bytes(rng.randrange(97, 123) for _ in range(2000)), np.uint8), np.array([0, 2000]), 400, 100)
    start = np.arange(1000)
    assert len(np.unique(part.hashes(start, start + 400))) == 1 and len(np.unique(part.second_hashes(start, start + 400))) == 1000
    same = S._Part(np.tile(part.buf[:500], 2), np.array([0, 1000]), 400, 100)
    two = same.second_hashes(np.array([0, 500, 1]), np.array([400, 900, 401]))
    assert two[0] == two[1] != two[2]


def test_messy_and_empty(messy, empty):
    rows = S.suffix_dedup(clashing(messy)).collect()
    want = brute([(r[0], r[1]) for r in messy_rows()])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert S.suffix_digest(empty).count() == 0
    assert all(sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in rows)


def test_table(spark, sf):
    docs = documents(spark, sf)
    got = Counter(tuple(r) for r in S.suffix_digest(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_interval_tree():
    words = sorted(["banana", "bandana", "band", "ban", "an", "and", "x"])
    common = [next((i for i in range(9) if a[i:i + 1] != b[i:i + 1] or i >= min(len(a), len(b))), 0) for a, b in zip(words, words[1:])]
    got = {(n, tuple(words[a:b + 1])) for n, a, b in S.interval_tree(common)}
    want = set()
    for n in range(7):
        groups = {}
        for w in words:
            if len(w) >= n:
                groups.setdefault(w[:n], []).append(w)
        for p, ws in groups.items():
            longest = min(len(w) for w in ws)
            if len(ws) > 1 and (n == longest or len({w[n] for w in ws}) > 1 or any(len(w) == n for w in ws)):
                want.add((n, tuple(ws)))
    assert got == want


def test_repeat_groups_hold_all_occurrences(spark):
    rows = [r for r in planted(9) if r[0] not in (1001, 1002)]   # a periodic run has quadratically many repeats
    texts = {t.encode() for _, t, *_ in rows}
    df = frame(spark, rows)
    d1, d2 = S.R.digests(df.text)
    name = {(r.a, r.b): r.text.encode() for r in df.select(d1.alias("a"), d2.alias("b"), "text").collect()}
    for hot in (S.HOT, 4):
        groups = {}
        for r in S.repeat_groups(df, hot=hot).collect():
            groups.setdefault((r.group, r.length), set()).add((name[r.d1, r.d2], r.place))
        assert groups
        covered = {t: np.zeros(len(t), dtype=bool) for t in texts}
        for (_, n), places in groups.items():
            strings = {t[a:a + n] for t, a in places}
            assert n >= 400 and len(strings) == 1 and len(places) > 1
            string = strings.pop()
            assert places == {(t, i) for t in texts for i in range(len(t) - n + 1) if t.startswith(string, i)}
            for t, a in places:
                covered[t][a:a + n] = True
        seen = Counter(t[i:i + 400] for t in texts for i in range(len(t) - 399))
        for t in texts:
            want = np.zeros(len(t), dtype=bool)
            for i in range(len(t) - 399):
                if seen[t[i:i + 400]] > 1:
                    want[i:i + 400] = True
            assert (covered[t] == want).all()


def test_an_anchor_is_hot_by_its_true_count(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = text(399)
    rows = [(0, "".join(text(50) + passage for _ in range(300)), None, None, 0), (1, text(900), None, None, 0)]
    df = frame(spark, rows)
    job = S._Job(df, 400, 100, 200, "text")   # one chunk holds all 300 occurrences
    assert any(r.counted for r in job.contexts(job.first()).collect())
    job = S._Job(df, 400, 100, 301, "text")
    assert not any(r.counted for r in job.contexts(job.first()).collect())
    got = S.suffix_dedup(df, hot=200).drop("spans").collect()
    assert Counter(tuple(r) for r in got) == brute([(r[0], r[1]) for r in rows])


def test_counts_beyond_the_cap_add_up():
    hot, log2 = np.uint64(0x9E3779B97F4A7C15), 3
    rows = [[], [], [], [], []]
    for chunk, n in ((0, 150), (1, 3), (2, 70)):
        hashes = np.append(np.full(n, hot), np.uint64(chunk))
        ask, more = S.R.questions(chunk, hashes, None, log2, cap=S.CAP), S.R.beyond(hashes, log2, S.CAP)
        for col, values in zip(rows, [*ask, [more.get(p) for p in ask[0]]]):
            col.extend(values)
    table = S.R.table_of(S.ANCHORS, rows)
    p = int(hot >> np.uint64(61))
    own = table.filter(S.pc.equal(table.column("p"), p))
    for level, want in ((223, True), (224, False)):
        bits = S.R.answer(own, False, (2, level)).column("bits").to_pylist()
        assert len(bits) == 3 and all(bool(b[1] & 0x80) == want for b in bits)
