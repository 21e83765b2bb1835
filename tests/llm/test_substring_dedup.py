import hashlib
from collections import Counter

import numpy as np
from llm_cases import WORD, clashing, frame, messy_rows, prose
from tessera.llm import repeats as R
from tessera.llm import substring_dedup as S
from tessera.llm.common import documents


def brute(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_matches_brute_force(messy):
    want = brute([(r[0], r[1]) for r in messy_rows()])
    rows = S.substring_dedup(clashing(messy)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want
    assert any(0 < r.n_removed < r.n_words for r in rows)
    text = {}
    for r in messy_rows():
        text.setdefault(r[0], r[1])
    for r in rows:
        if r.doc_id is not None:
            assert hashlib.sha256(S.kept_words(text[r.doc_id], r.spans).encode()).hexdigest() == r.kept_sha256


def test_offsets_of_repeats(spark):
    import random
    rng = random.Random(5)
    rows = []
    for i in range(40):  # passages about as long as the window, at any offset
        p = prose(rng, rng.choice([33, 34, 35, 36, 52, 53, 70]), 10**9)
        for _ in range(2):
            rows.append((len(rows), prose(rng, rng.randrange(40), 10**9) + " " + p + " " + prose(rng, rng.randrange(40), 10**9), None, None, 0))
    own = prose(rng, 40, 10**9)
    rows.append((len(rows), f"{own} x {own}", None, None, 0))  # inside one document
    rows.append((len(rows), "same " * 90, None, None, 0))      # overlapping itself
    got = Counter(tuple(r) for r in S.substring_digest(frame(spark, rows)).collect())
    assert got == brute([(r[0], r[1]) for r in rows])


def test_table(spark, sf, empty):
    docs = documents(spark, sf)
    got = Counter(tuple(r) for r in S.substring_digest(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert S.substring_digest(empty).count() == 0


def test_questions_and_answers():
    rng = np.random.default_rng(3)
    for exact in (False, True):
        chunks = [rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(4)]
        chunks[1][:50] = chunks[0][:50]
        chunks[2][:9] = chunks[2][100]
        sent = [R.table_of(R.QUESTION, R.questions(i, c, None, 3, exact)) for i, c in enumerate(chunks)]
        import pyarrow as pa
        table = pa.concat_tables(sent)
        got = [R.answer(table.filter(pa.compute.equal(table["p"], p)), exact, (2, 3)) for p in range(8)]
        back = pa.concat_tables(got)
        every = Counter(np.concatenate(chunks).tolist())
        for i, c in enumerate(chunks):
            own = back.filter(pa.compute.equal(back["chunk"], i))
            flags = R.read_answers(own["p"].to_pylist(), own["bits"].to_pylist(), c, 3, exact, 2)
            assert flags[0].tolist() == [every[x] > 1 for x in c.tolist()]
