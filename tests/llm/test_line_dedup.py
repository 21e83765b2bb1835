import hashlib
from collections import Counter, defaultdict

from llm_cases import clashing, lower, messy_rows
from tessera.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def brute(rows, min_docs=10, min_chars=1):
    seen = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            seen[lower(line.strip(WS))].add((r[0], r[1] or ""))
    drop = {k for k, d in seen.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if lower(x.strip(WS)) not in drop]
        out[(r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def test_matches_brute_force(messy):
    got = Counter(tuple(r) for r in L.line_digest(messy).collect())
    assert got == brute(messy_rows())
    assert any(k[2] for k in got)


def test_many_lines_cross_bitmap_blocks(spark):
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(33_000)] + ["both"] * 3 + [f"end {i}"]), None, None, 0) for i in range(2)]
    from llm_cases import frame
    got = {r.doc_id: r for r in L.dedup_lines(frame(spark, rows), min_docs=2).collect()}
    assert [got[i].n_dropped for i in range(2)] == [3, 3]
    assert got[0].kept_text.endswith("own 0 32999\nend 0")


def test_extra_columns_and_empty(messy, empty):
    assert L.line_digest(clashing(messy)).count() == len(messy_rows())
    assert L.line_digest(empty).count() == 0
