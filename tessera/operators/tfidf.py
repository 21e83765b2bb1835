"""TXT-8..10: TF-IDF with the reference's conventions, and word frequencies
(VIZ-8).

Fit: ``explode`` the normalised and the distinct tokens of a document ->
per-term corpus count and document frequency (one partial-aggregated shuffle of
terms) -> top ``max_features`` by (count desc, term) -> alphabetical index,
``idf = ln((1+n)/(1+df)) + 1``.
Apply: MLlib ``CountVectorizerModel.from_vocabulary`` (raw term counts,
JVM hash map per row) -> ``ElementwiseProduct(idf)`` -> ``Normalizer(2)``;
a sparse vector column, no Python in the row path.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_tokens, token_rows
from .profile import q

MIN_TOKEN_LEN = 2   # the vectoriser's default pattern keeps words of >= 2 characters


def vector_tokens(c):
    """Tokens the vectoriser sees: normalised tokens of >= 2 characters."""
    return F.filter(normalized_tokens(c), lambda t: F.length(t) >= MIN_TOKEN_LEN)


def tok_col(col: str) -> str:
    return f"__tok_{col}"


def tokenize(df: DataFrame, col: str) -> DataFrame:
    """Add the vectoriser's tokens of ``col`` as ``__tok_<col>`` so that fit
    and transform (or a persisted frame) tokenize each text once."""
    return df.withColumn(tok_col(col), vector_tokens(F.col(q(col))))


def _tokens(df: DataFrame, col: str):
    return F.col(tok_col(col)) if tok_col(col) in df.columns else vector_tokens(F.col(q(col)))


def term_stats(df: DataFrame, col: str, doc_key: str | None = None) -> DataFrame:
    """``(term, cnt, df)``: corpus count and document frequency of every term."""
    # a document adds its tokens (counted) and its distinct tokens (for df); terms
    # alone are shuffled, combined in the scan tasks, never (document, term) pairs
    toks = df.select(_tokens(df, col).alias("t")).select("t", F.array_distinct("t").alias("u"))
    n = F.size("t")
    rows = toks.select(n.alias("n"), F.posexplode(F.concat("t", "u")).alias("i", "term"))
    return rows.groupBy("term").agg(F.count_if(F.col("i") < F.col("n")).alias("cnt"),
                                    F.count_if(F.col("i") >= F.col("n")).alias("df"))


def fit_tfidf(df: DataFrame, col: str, max_features: int = 100, doc_key: str | None = None) -> dict:
    """Vocabulary (alphabetical), idf per term, document count."""
    n_docs = df.count()
    top = (term_stats(df, col, doc_key).orderBy(F.desc("cnt"), F.asc("term")).limit(max_features)
           .collect())                      # bounded by max_features
    vocab = sorted((r["term"], r["cnt"], r["df"]) for r in top)
    return {"column": col, "n_docs": n_docs,
            "vocab": [t for t, _, _ in vocab],
            "counts": [c for _, c, _ in vocab],
            "df": [d for _, _, d in vocab],
            "idf": [math.log((1 + n_docs) / (1 + d)) + 1 for _, _, d in vocab]}


def vocab_frame(spark, params: dict) -> DataFrame:
    rows = [(i, t, c, d, idf) for i, (t, c, d, idf) in
            enumerate(zip(params["vocab"], params["counts"], params["df"], params["idf"]))]
    return spark.createDataFrame(rows, "idx int, term string, cnt bigint, df bigint, idf double")


def tfidf_vectors(df: DataFrame, params: dict, out: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append the L2-normalised TF-IDF sparse vector of ``params['column']``."""
    col = params["column"]
    out = out or f"{col}_tfidf"
    toks = tok_col(col)
    base = df if toks in df.columns else tokenize(df, col)
    if not params["vocab"]:
        return base.drop(toks).withColumn(out, F.lit(None))
    cv = CountVectorizerModel.from_vocabulary(params["vocab"], inputCol=toks, outputCol="__tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense(params["idf"]), inputCol="__tf", outputCol="__w")
    nz = Normalizer(p=2.0, inputCol="__w", outputCol=out)
    res = nz.transform(ep.transform(cv.transform(base))).drop(toks, "__tf", "__w")
    return res.select(*(keep or [c for c in res.columns]), out) if keep else res


def tfidf_columns(df: DataFrame, params: dict) -> DataFrame:
    """TXT-9: replace the text column by ``c_tfidf_0 .. c_tfidf_{k-1}``."""
    col = params["column"]
    v = tfidf_vectors(df, params, out="__vec")
    arr = vector_to_array(F.col("__vec"))
    others = [F.col(q(c)) for c in df.columns if c not in (col, tok_col(col))]
    return v.select(*others, *[arr[i].alias(f"{col}_tfidf_{i}") for i in range(len(params["vocab"]))])


def tfidf_long(df: DataFrame, params: dict, doc_key: str) -> DataFrame:
    """``(doc_key, term, weight)`` for the non-zero weights (sparse long form)."""
    spark = df.sparkSession
    c = params["column"]
    keep = [doc_key, c] + ([tok_col(c)] if tok_col(c) in df.columns else [])
    v = tfidf_vectors(df.select(*keep), params, out="__vec")
    exploded = v.select(doc_key, F.posexplode(vector_to_array(F.col("__vec"))).alias("idx", "weight")) \
        .where(F.col("weight") != 0)
    vocab = F.broadcast(vocab_frame(spark, params).select("idx", "term"))   # max_features rows
    return exploded.join(vocab, "idx").select(doc_key, "term", "weight")


def word_frequencies(df: DataFrame, col: str, top: int = 200) -> DataFrame:
    """VIZ-8 (re-aimed): top ``top`` normalised words by count, ties by word."""
    words = token_rows(df.select(F.col(q(col)).alias("__text")), "__text", lemmatize=False, alias="word")
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.desc("cnt"), F.asc("word")).limit(top))
