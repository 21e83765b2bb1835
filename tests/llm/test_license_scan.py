"""Licence scan: base rule against brute force, the method on planted texts."""

import re
from collections import Counter

import pytest
from llm_cases import clashing, frame, lower, messy_rows
from tessera.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall(lower(text or ""))
    hits = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def scan(spark, texts, **kw):
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in L.licence_scan(frame(spark, rows), **kw).collect()}


BODY = " ".join(f"word{i}" for i in range(60))
MIT = next(t for x, t in L.TEMPLATES if x == "mit" and len(t) > 100)


def test_base_matches_brute_force(messy):
    spark = messy.sparkSession
    extra = [(9000 + i, t, None, "s", 0) for i, t in enumerate([
        "Licensed under CC-BY. cc by", "cc by cc by", "CC by\nGeneral  public, LICENSE! all rights\treserved", "generalpublic license", "cc",
        "all rights all rights reserved reserved", "General Public License " * 500, "ĀLL rights reserved", "accby cc bye"])]
    rows = messy_rows() + extra
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.licence_scan(frame(spark, rows)).collect())
    assert got == Counter((r[0], *base(r[1])) for r in rows)


def test_templates_are_found_whole_changed_and_moved(spark):
    words = L.template_words(MIT)
    inserted = " ".join(words[:20] + ["really", "and", "truly"] + words[20:])
    lacking = " ".join(words[:15] + words[18:])
    texts = [f"{BODY} {t} {BODY}" for _, t in L.TEMPLATES] + [
        f"{BODY} {inserted} {BODY}", f"{lacking} {BODY}", BODY, " ".join(words[:12]), BODY + " permission is hereby granted " + BODY,
        " ".join(w if i % 2 else "x" for i, w in enumerate(words))]
    got = scan(spark, texts)
    for i, (label, t) in enumerate(L.TEMPLATES):
        assert label in got[i].labels.split(","), t
        assert got[i].score == 1.0
    n = len(L.TEMPLATES)
    assert got[n].labels == "mit" and 0.8 <= got[n].score < 1 and got[n + 1].labels == "mit"
    assert all(got[n + k].labels == "" and got[n + k].score == 0 for k in (2, 3, 4, 5))


def test_the_most_alike_of_overlapping_templates_stays(spark):
    got = scan(spark, ["This work is licensed under the GNU General Public License, version 3.", "licensed under CC BY-NC 4.0 " + BODY,
                       "Licensed under the GNU Lesser General Public License. " + BODY + " Released under the MIT License.",
                       "Licensed under the Apache License, Version 2.0. All rights reserved."])
    assert got[0].labels == "gpl,gpl-3.0" and got[1].labels == "cc-by,cc-by-nc"
    assert got[2].labels == "gpl,lgpl,mit" and got[3].labels == "apache-2.0,reserved" and got[3].base_labels == "reserved"


def test_repeated_and_long_texts(spark):
    long = (BODY + " released under the mit license ") * 300
    docs = frame(spark, [(1, long, None, None, 0)] * 3 + [(None, MIT, None, None, 0)] * 2 + [(1, MIT, None, None, 0)])
    spans = L.licence_spans(L.gram_matches(docs)).collect()
    own = [s for s in spans if s.doc_id == 1 and s.n_words == 5]
    assert len(own) == 300 and sorted(s["first"] for s in own) == [60 + 65 * i for i in range(300)]
    got = Counter((r.doc_id, r.labels, r.score) for r in L.licence_scan(docs).collect())
    assert got == Counter({(1, "mit", 1.0): 4, (None, "mit", 1.0): 2})


@pytest.mark.parametrize("k", [2, 4])
def test_own_templates(spark, k):
    got = scan(spark, ["aa bb cc dd ee", "aa bb cc", "x aa bb cc dd ee y", None, ""], templates=[("own", "AA bb-cc dd ee")], k=k)
    assert [got[i].labels for i in range(5)] == ["own", "", "own", "", ""]
    with pytest.raises(ValueError):
        L.template_grams([("short", "one")], k)


def test_extra_columns_and_empty(messy, empty):
    a, b = (Counter(tuple(r) for r in L.licence_scan(d).collect()) for d in (messy, clashing(messy)))
    assert a == b and sum(a.values()) == len(messy_rows())
    assert L.licence_scan(empty).count() == 0
