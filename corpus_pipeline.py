"""Corpus pipeline over ``documents``: language ID, exact dedup, near-duplicate
removal, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it again as the next one's docs, so
a lost executor never reaches back beyond one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_bpe
from tessera.llm.common import documents, free_name
from tessera.session import ensure_checkpoint_dir

#: Least posterior probability of a language for a document to stay.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, those
    under the likelihood floor of their best language and those of no clear
    language go."""
    lang, score, inside = (free_name(docs, n) for n in ("lang_pred", "lang_score", "in_language"))
    model = language_id.fit(language_id.train_rows(docs))
    rows = language_id.predict(docs, model, pred_col=lang, score_col=score, inside_col=inside)
    return rows.where(F.col(inside) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest doc_id."""
    return ngram_join.drop_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, once per copy."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids of every row, with digests of the ids and of the
    text that they decode to."""
    return sentencepiece_bpe.encode_digest(docs.select("doc_id", "source", "text"), sentencepiece_bpe.public_model(), with_ids=True)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: Language scores and merge rounds are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
