"""Lemmas verified by the corpus, word counts with collocations."""

import math
from collections import Counter

from tessera.operators import lexicon as X


def texts(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "t string")


def lemmas(spark, rows, **kw):
    return {r["word"]: r["lemma"] for r in X.corpus_lemmas(texts(spark, rows), "t", **kw).collect()}


def test_lemmas_must_be_words_of_the_corpus(spark):
    got = lemmas(spark, ["gas bus series women woman woman cats cat cat glass boxes box box", "buses bus churches church church wolves wolf wolf",
                         "cities city city news bosses boss boss men man man", None, ""])
    assert got == {"women": "woman", "cats": "cat", "boxes": "box", "buses": "bus", "churches": "church", "wolves": "wolf",
                   "cities": "city", "bosses": "boss", "men": "man"}


def test_rare_candidates_are_refused(spark):
    rows = ["news " * 100 + "new2 new"]       # one word against a hundred: no lemma by share
    assert lemmas(spark, rows, stop_words=[]) == {}
    assert lemmas(spark, ["cats cat"]) == {} and lemmas(spark, ["cats cat"], min_count=1) == {"cats": "cat"}


def test_lemmatised_words(spark, monkeypatch):
    found = X.corpus_lemmas(texts(spark, ["cats cat cat bus"]), "t")
    words = spark.createDataFrame([("cats", 1), ("bus", 2), (None, 3)], "word string, k int")
    for limit in (10, 0):
        monkeypatch.setattr(X, "BROADCAST", limit)
        assert {(r["word"], r["k"]) for r in X.lemmatised(words, found).collect()} == {("cat", 1), ("bus", 2), (None, 3)}


def brute(rows, least, stop):
    docs = [[w for w in (t or "").split(" ") if w] for t in rows]
    count = Counter(w for d in docs for w in d if w not in stop)
    fold = {w: w[:-1] for w in count if w.endswith("s") and not w.endswith("ss") and w[:-1] in count}
    f = lambda w: fold.get(w, w)
    single = Counter()
    for w, c in count.items():
        single[f(w)] += c
    pairs = Counter((f(a), f(b)) for d in docs for a, b in zip(d, d[1:]) if a not in stop and b not in stop)
    total = sum(single.values())
    part = lambda k, n, p: math.log(max(p, 1e-10)) * k + math.log(max(1 - p, 1e-10)) * (n - k)
    left = Counter(single)
    out = {}
    for (a, b), c in pairs.items():
        x, y = single[a], single[b]
        if total <= x or total <= y:
            continue
        p, p1, p2 = y / total, c / x, (y - c) / (total - x)
        if 2 * (part(c, x, p1) + part(y - c, total - x, p2) - part(c, x, p) - part(y - c, total - x, p)) >= least:
            out[f"{a} {b}"] = c
            left[a] -= c
            left[b] -= c
    return {**{w: c for w, c in left.items() if c > 0}, **out}


def test_collocations_and_plurals(spark):
    import random
    rng = random.Random(4)
    words = ["cat", "cats", "dog", "dogs", "the", "red", "glass", "gas"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    rows += ["new york the new york city"] * 12 + ["york"] * 3 + ["ha ha ha"] * 9 + [None, ""]
    for least in (5.0, 30.0):
        got = {r["word"]: r["cnt"] for r in X.word_cloud(texts(spark, rows), "t", 1000, least).collect()}
        assert got == brute(rows, least, {"the"})
    assert "new york" in got and "cats" not in got and X.word_cloud(texts(spark, []), "t").count() == 0


def test_texts_are_counted_once(spark):
    from tessera.functions.text import STOP_WORDS
    df = texts(spark, ["red car", "red car the cannot red", None, "", "car"])
    got = {(r["a"], r["b"]): r["cnt"] for r in X.neighbours(X._words(df, "t"), list(STOP_WORDS)).collect()}
    assert got == {("red", "car"): 2, ("car", None): 3, ("red", None): 1}      # "can not" are stop words
