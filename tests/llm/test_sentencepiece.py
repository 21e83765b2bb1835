import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from llm_cases import clashing, messy_rows
from tessera.llm import sentencepiece_bpe as S


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.public_model())


@pytest.fixture(scope="module")
def model():
    return S.Pieces.load(S.public_model())


def fuzz(seed):
    rng = random.Random(seed)
    alphabets = ["abcdefghij theandin", "aab ", "  ▁x", "漢字カナ가나다 ", "aé́ß\n\t\r\x00\x7f ", "😀𝔘‍� a", "the <s></s><0x41> ", "00110  "]
    out = []
    for _ in range(150):
        a = rng.choice(alphabets) + rng.choice(alphabets)
        out.append("".join(rng.choice(a) for _ in range(rng.choice([0, 1, 2, 5, 30, 300]))))
    return out + ["", " ", "  ", " a", "a ", "▁", "▁▁ a", " " * 100 + "x" + " " * 37, "of the the the", "a" * 1000, "ab" * 700]


def test_ids_and_texts_equal_the_library(library, model):
    texts = fuzz(1) + [r[1] or "" for r in messy_rows()]
    encoder, decoder = S.Encoder(model, [2]), S.Decoder(model)
    ids, offsets = encoder.encode(texts)
    back = decoder.decode(ids.astype(np.int64), offsets)
    for t, a, b, d in zip(texts, offsets[:-1], offsets[1:], back):
        want = library.encode(t) + [2]
        assert ids[a:b].tolist() == want, t[:80]
        assert d == library.decode(want), t[:80]


def test_decoding_any_ids(library, model):
    rng = random.Random(2)
    rows = [[rng.randrange(32000) if rng.random() < .5 else rng.randrange(1, 259) for _ in range(rng.randrange(30))] for _ in range(300)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = S.Decoder(model).decode(np.array([i for r in rows for i in r], dtype=np.int64), offsets)
    for r, d in zip(rows, got):
        assert d == library.decode(r), r


def test_query(messy, empty, library):
    want = Counter()
    for r in messy_rows():
        ids = library.encode(r[1] or "") + [2]
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in S.roundtrip_digest(clashing(messy)).collect()) == want
    assert S.roundtrip_digest(empty).count() == 0


def test_eviction_and_both_ways_of_cutting(library, model):
    """A cache of a few KB, texts whose spaces are single beside others."""
    rng = random.Random(11)
    words = ["the", "data", "漢字", "x\ny", "qu", "é"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[:6] if rng.random() < .5 else words) for _ in range(40)) for _ in range(60)]
    texts += [f" {t}" for t in texts[:5]] + [f"{t}  end " for t in texts[:5]] + ["the", "▁the", " the", "a▁b c", "z" * 5000, ""]
    encoder = S.Encoder(model, [2])
    encoder.limit = 8 << 10
    evicted, evict = [], encoder._evict
    encoder._evict = lambda: (evicted.append(1), evict())
    for a in range(0, len(texts), 7):
        ids, offsets = encoder.encode(texts[a:a + 7])
        for t, b, e in zip(texts[a:a + 7], offsets[:-1], offsets[1:]):
            assert ids[b:e].tolist() == library.encode(t) + [2], t[:60]
        assert encoder.number.size() <= encoder.limit and len(encoder.hits) == len(encoder.number) == len(encoder.length)
    assert len(evicted) > 2


def test_a_word_is_looked_up_once_a_part(library, model):
    """Arrow columns, sliced and with nulls, beside lists; words between texts that are cut otherwise."""
    texts = ["the data the data the", None, "", "a▁b the", " the  end", "𝔘 x\uffff é", "the data", "data \x00 the"] * 3
    encoder, calls = S.Encoder(model, [2]), []
    known = encoder.number.of
    encoder.number.of = lambda words: (calls.append(list(words)), known(words))[1]
    column = pa.array(["left out", *texts, "this too"]).slice(1, len(texts))
    ids, offsets = encoder.encode(column)
    want = [library.encode(t or "") + [2] for t in texts]
    assert [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:])] == want
    assert len(calls) == 1 and len(set(calls[0])) == len(calls[0]) and calls[0].count("the") == 1
    again, places = encoder.encode(texts)
    assert again.tolist() == ids.tolist() and places.tolist() == offsets.tolist()
    assert encoder.encode([])[0].tolist() == [] and encoder.encode([None])[0].tolist() == [2]
