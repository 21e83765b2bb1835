from collections import Counter, defaultdict

from llm_cases import WORD, clashing, frame, lower, messy_rows
from tessera.llm import quality_rules as Q


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def brute(rows, min_docs, max_share, max_loss):
    docs, found = defaultdict(set), defaultdict(set)
    norm = lambda line: lower(" ".join(WORD.findall(line)))
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if WORD.search(line):   # hosts count the documents that have a line with a word
                docs[r[3]].add(r[:2])
                found[r[3], norm(line)].add(r[:2])
    bad = {k for k, v in found.items() if len(v) >= min_docs
           or max_share is not None and len(v) >= max(2, max_share * len(docs[k[0]]))}
    out = Counter()
    for r in rows:
        b = base(r[1])
        lost = sum(len(WORD.findall(x)) for x in (r[1] or "").split("\n") if WORD.search(x) and (r[3], norm(x)) in bad)
        out[(r[0], *b, lost, not b[5] and lost <= max_loss * b[0] and b[0] - lost >= 50)] += 1
    return out


def test_matches_brute_force(messy):
    rows = messy_rows() + [(5000 + i, "# * " + "up & down | " * i, None, "s1", 0) for i in range(30)]
    df = messy.unionByName(frame(messy.sparkSession, rows[len(messy_rows()):]))
    for args in ((10, None, 0.5), (100, 0.2, 0.5), (2, None, 0.1)):
        got = Counter(tuple(r) for r in Q.quality_rules(df, *args).collect())
        assert got == brute(rows, *args)


def test_boilerplate_of_a_large_host(spark):
    """A banner in 2 % of a host's documents takes effect, and a line in as many
    documents of many small hosts doesn't."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    banner = " ".join(f"menu{j}" for j in range(100))
    rows = [(i, body(i) + ("\n" + banner if i % 50 == 0 else ""), None, "big", 0) for i in range(2000)]
    rows += [(5000 + i, body(5000 + i) + "\n" + banner, None, f"small{i % 30}", 0) for i in range(60)]
    got = {r.doc_id: r for r in Q.quality_digest(frame(spark, rows)).collect()}
    assert all(got[i].kept == (i % 50 != 0) and got[i].boilerplate_words == (0 if i % 50 else 100) for i in range(2000))
    assert all(got[5000 + i].kept for i in range(60))


def test_what_boilerplate_leaves_must_pass_the_length_rule(spark):
    banner = " ".join(f"menu{j}" for j in range(10))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(45 + i % 10)) + "\n" + banner, None, "h", 0) for i in range(40)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in Q.quality_digest(frame(spark, rows)).collect()}
    assert got == {i: (False, i % 10 >= 5) for i in range(40)}


def test_a_line_that_holds_most_rows(spark):
    """Its rows take the broadcast path."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, body(i) + "\nShared  LINE here", None, "h" if i % 3 else None, 0) for i in range(1500)]
    rows += [(9000 + i, body(9000 + i) + "\nrare line", None, "h", 0) for i in range(12)]
    got = {r.doc_id: r.boilerplate_words for r in Q.quality_digest(frame(spark, rows)).collect()}
    assert got == {r[0]: 3 if r[0] < 9000 else 2 for r in rows}


def test_depleted_documents_go_and_clean_ones_stay(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    boiler = " ".join(f"menu{j}" for j in range(100))
    rows = [(i, body(i) + "\n" + boiler, None, "h", 0) for i in range(20)] + [(100 + i, body(100 + i), None, "h", 0) for i in range(20)]
    got = {r.doc_id: r.kept for r in Q.quality_digest(frame(spark, rows)).collect()}
    assert not any(got[i] for i in range(20)) and all(got[100 + i] for i in range(20))


def test_extra_columns_and_empty(messy, empty):
    assert Counter(tuple(r) for r in Q.quality_digest(clashing(messy)).collect()) == brute(messy_rows(), 10, None, 0.5)
    assert Q.quality_digest(empty).count() == 0
