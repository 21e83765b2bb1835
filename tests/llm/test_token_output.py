from collections import Counter

import numpy as np
import pytest
import sentencepiece
from llm_cases import clashing, messy_rows
from tessera.llm import sentencepiece_bpe as S
from tessera.llm import token_output as O


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = O.Feistel(n, key=5)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert f.number(slots).tolist() == list(range(n))
    if n > 60:
        assert (slots != O.Feistel(n, key=6).slot(np.arange(n))).any()
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.5


def test_feistel_beyond_32_bits():
    f = O.Feistel(10**13 + 7, key=1)
    x = np.random.default_rng(1).integers(0, 10**13 + 7, 1000)
    assert (f.number(f.slot(x)) == x).all() and (f.slot(x) < 10**13 + 7).all()


def test_every_token_once_and_resumable(messy, tmp_path):
    shards = O.training_shards(clashing(messy), seq_len=64, shard_size=16)
    O.write_shards(shards, str(tmp_path / "shards"))
    spark = messy.sparkSession
    table = spark.read.parquet(str(tmp_path / "shards"))
    n = sum(r.n_sequences for r in table.collect())
    assert all(len(r.data) == r.n_sequences * r.stride for r in table.collect())
    assert sorted(r.first_slot for r in table.collect()) == list(range(0, n, 16))
    rows = O.read_slots(spark, str(tmp_path / "shards"), shard_size=16).collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    by_slot = {r.slot: r.ids for r in rows}
    order = O.Feistel(n, 2).slot(np.arange(n)).tolist()
    stream = [i for s in order for i in by_slot[s]]
    got, doc = Counter(), []
    for i in stream:
        doc.append(i)
        if i == 2:
            got[tuple(doc)] += 1
            doc = []
    library = sentencepiece.SentencePieceProcessor(model_file=S.public_model())
    assert not doc and got == Counter(tuple(library.encode(r[1] or "") + [2]) for r in messy_rows())
    later = O.read_slots(spark, str(tmp_path / "shards"), 21, 40, shard_size=16).collect()
    assert {r.slot: r.ids for r in later} == {s: by_slot[s] for s in range(21, 40)}
    again = O.training_shards(messy.repartition(5), seq_len=64, shard_size=16)
    assert {r.shard: bytes(r.data) for r in again.collect()} == {r.shard: bytes(r.data) for r in table.collect()}


def test_empty(empty):
    assert O.training_shards(empty).count() == 0
