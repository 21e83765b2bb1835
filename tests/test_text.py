import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text
from tessera.operators.tfidf import fit_tfidf, tfidf_long


@pytest.mark.parametrize("raw,want", [
    ("The cats CANNOT run!", "cat run"),
    ("I'm gonna say: wanna go now", "im gon na say wan na go"),
    ("Boxes, buses, classes & studies of women", "box bus class study woman"),
    ("Café naïve 123 glass", "caf nave glass"),
    (None, ""),
])
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(normalize_text(F.col("t"))).first()[0] == want


def test_tfidf_matches_formula(spark):
    docs = ["red apple red", "green apple", "blue sky blue blue", "apple sky", "x"]
    df = spark.createDataFrame(list(enumerate(docs)), "id bigint, t string")
    p = fit_tfidf(df, "t", max_features=3, doc_key="id")
    toks = [[w for w in d.split() if len(w) >= 2] for d in docs]
    cnt = Counter(w for t in toks for w in t)
    top = sorted(sorted(cnt, key=lambda w: (-cnt[w], w))[:3])
    assert p["vocab"] == top
    dfreq = {w: sum(w in t for t in toks) for w in top}
    idf = {w: math.log((1 + len(docs)) / (1 + dfreq[w])) + 1 for w in top}
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf_long(df, p, "id").collect()}
    for i, t in enumerate(toks):
        v = np.array([t.count(w) * idf[w] for w in top])
        if not v.any():
            continue
        v = v / np.linalg.norm(v)
        for w, x in zip(top, v):
            if x:
                assert got[(i, w)] == pytest.approx(x)


def test_user_text_udf(spark):
    from tessera.functions.text import user_text_udf
    df = spark.createDataFrame([("Hello World",), (None,)], "t string")
    out = [r[0] for r in df.select(user_text_udf(str.upper)(F.col("t"))).collect()]
    assert out == ["HELLO WORLD", ""]
