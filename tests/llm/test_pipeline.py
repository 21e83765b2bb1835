"""Each stage against brute force on what its predecessor kept."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from llm_cases import WORD, clashing, lower, messy_rows

import corpus_pipeline as P
from test_mixing import targets
from test_ngram_join import brute as components
from test_ngram_join import shingles
from tessera.llm import language_id, sentencepiece_bpe
from tessera.llm.common import documents


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check_stages(spark, docs, sf):
    before, df = rows_of(docs), docs
    names = docs.columns
    out = {}
    for k, (name, stage) in enumerate(P.STAGES):
        after_df = stage(spark, df, sf).cache()
        after = rows_of(after_df)
        out[name] = after
        if k < 4:
            assert after_df.columns == names
        key = lambda r: (r["doc_id"], r["text"], r["source"])
        if k == 0:
            model = language_id.fit(language_id.train_rows(df))
            _, scores, inside = language_id.score_texts(model, [r["text"] for r in before])
            want = Counter(key(r) for r, ok, s in zip(before, inside, scores) if ok and s >= P.MIN_LANGUAGE_SCORE)
            assert Counter(map(key, after)) == want
        elif k == 1:
            best = {}
            for r in before:
                t = lower(r["text"] or "")
                best[t] = max(best.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
            assert Counter((-1 if r["doc_id"] is None else r["doc_id"], lower(r["text"] or "")) for r in after) == Counter((i, t) for t, i in best.items())
        elif k == 2:
            want = components([(r["doc_id"], r["text"]) for r in before])
            full = [r for r in after if shingles(r["text"])]
            assert Counter(r["doc_id"] for r in full) == Counter({c for (_, n, c) in want if n})
            assert len(after) - len(full) == sum(v for (_, n, _), v in want.items() if not n)
        elif k == 3:
            sizes, taken, largest = Counter(), Counter(), Counter()
            copies = Counter(map(key, after))
            for r in before:
                n = len(WORD.findall(r["text"] or ""))
                sizes[r["source"]] += n
                taken[r["source"]] += n * copies[key(r)]
                largest[r["source"]] = max(largest[r["source"]], n)
                assert copies[key(r)] <= 3
            assert set(copies) <= set(map(key, before))
            for s, t in targets(dict(sizes)).items():
                assert abs(taken[s] - t) <= largest[s]
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.public_model())
            want = Counter()
            for r in before:
                ids = library.encode(r["text"] or "") + [2]
                want[(r["doc_id"], r["source"], tuple(ids), len(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
            assert Counter((r["doc_id"], r["source"], tuple(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in after) == want
        before, df = after, after_df
    return out


def test_stages_on_the_table(spark, sf):
    out = check_stages(spark, documents(spark, sf), sf)
    assert len(out["language ID"]) >= 0.9 * documents(spark, sf).count()


def test_stages_on_messy_rows(messy, sf):
    check_stages(messy.sparkSession, clashing(messy), sf)


def test_run(spark, sf):
    got = Counter((r.doc_id, r.ids_sha256) for r in P.run(spark, sf).collect())
    again = Counter((r.doc_id, r.ids_sha256) for r in P.run(spark, sf).collect())
    assert got == again and sum(got.values()) > 0


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, empty, k):
    assert P.STAGES[k][1](spark, empty, "").count() == 0
