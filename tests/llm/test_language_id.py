import zlib
from collections import Counter

import numpy as np
from llm_cases import clashing, messy_rows
from tessera.llm import language_id as I
from tessera.llm.common import documents


def test_held_out_accuracy(spark, sf):
    rows = I.identify(documents(spark, sf)).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in test) >= 0.9 * len(test)
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_equal_brute_force():
    rng = np.random.default_rng(1)
    model = I.Model(["a", "b"], np.log([0.3, 0.7]), rng.normal(size=(2, 1 << I.BINS_LOG2)).astype(np.float32) / 100)
    texts = ["Hello wörld", "", None, "x", "12 !", "long " * 70_000 + "ÄÖ", "ab"]
    langs, scores, inside = I.score_texts(model, texts)
    assert inside.tolist() == [lang != "und" for lang in langs]
    for t, lang, score in zip(texts, langs, scores):
        if not t or not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0.0)
            continue
        low = t.lower()
        points = np.array([ord(c) for c in low], dtype=np.uint32)
        total = model.prior.copy()
        for bins in I._bins(points):  # one unbroken piece
            total += model.matrix[:, bins].sum(axis=1, dtype=np.float64)
        assert lang == "ab"[total.argmax()]
        assert abs(score - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_labels_and_sources_do_not_matter(messy):
    from pyspark.sql import functions as F
    model = I.fit(I.train_rows(messy))
    a = I.predict(messy.select("doc_id", "text"), model).collect()
    b = I.predict(messy.select("doc_id", "text", F.lit("de").alias("lang")), model).collect()
    assert [(r.lang_pred, r.score) for r in a] == [(r.lang_pred, r.score) for r in b]


def test_messy_and_empty(messy, empty):
    rows = I.identify(clashing(messy)).collect()
    assert {r.lang_pred for r in rows} <= {"en", "de", "und"}
    letters_of = Counter((r[0], bool(r[1]) and any(c.isalpha() for c in r[1])) for r in messy_rows())
    assert Counter((r.doc_id, r.lang_pred != "und") for r in rows) == letters_of
    assert all((r.score > 0) == (r.lang_pred != "und") for r in rows)
    assert I.identify(empty).count() == 0
    unlabelled = messy.withColumn("lang", messy.lang.substr(1, 0)).where("doc_id is null").selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in I.identify(unlabelled).collect()} == {"und"}


UNLEARNED = ["数据库系统是一种管理数据的软件，它可以帮助用户存储和查询信息。" * 3, "Система управления базами данных помогает хранить и искать информацию. " * 3]


def letters(n):
    import random
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
            " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n // 7))]


def test_texts_in_no_learned_language_are_told(spark, sf):
    docs = documents(spark, sf)
    model = I.fit(I.train_rows(docs))
    # a letter is enough for a prediction; the further column tells that none fits
    langs, scores, inside = I.score_texts(model, UNLEARNED + letters(400) + letters(4000))
    assert set(langs) <= set(model.langs) and scores.all() and not inside.any()
    clean = [t for (t,) in docs.select("text").collect() if t and any(c.isalpha() for c in t)]
    assert I.score_texts(model, clean)[2].all()
    key = 'token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62" 4734663219866878 126.57.31.34 '
    assert I.score_texts(model, [key + clean[0][:60], clean[0][:12]])[2].all()


def test_pipeline_stage_drops_texts_in_no_learned_language(spark, sf):
    import corpus_pipeline as P
    docs = documents(spark, sf)
    clean = {r.doc_id for r in P.language_stage(spark, docs, sf).select("doc_id").collect()}
    assert clean == {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    alien = [(-1 - i, t, None, docs.first().source, len(t)) for i, t in enumerate(UNLEARNED + letters(400))]
    both = docs.unionByName(spark.createDataFrame(alien, docs.select("doc_id", "text", "lang", "source", "n_chars").schema), allowMissingColumns=True)
    assert {r.doc_id for r in P.language_stage(spark, both, sf).select("doc_id").collect()} == clean


def test_every_label_is_learned_whatever_its_share(spark):
    rows = [("aa", f"anna alala nana{i} lana", i) for i in range(3000)] + [("zz", f"zizzu zuzz{i} zuzi", 5000 + i) for i in range(3)]
    rows += [("bb", "bobo ubo bubo", None)] * 300   # equal rows without a key
    model = I.fit(spark.createDataFrame(rows, "lang string, text string, key long"), max_train=50)
    assert model.langs == ["aa", "bb", "zz"]
    assert np.allclose(np.exp(model.prior), np.array([3000, 300, 3]) / 3303)
    assert I.score_texts(model, ["zizzu zuzz zuzi", "bobo ubo bubo", "anna nana alala"])[0] == ["zz", "bb", "aa"]
