"""Text queries: TXT-1..10 and VIZ-8 over the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.text import (CONTRACTIONS, NO_STRIP_ENDINGS, NOUN_SUFFIXES, STOP_WORDS, WS_RE2,
                             normalized_tokens, token_rows)
from .operators import lexicon as X
from .operators import tfidf as TF
from .queries import T, register, rounded, sround

# ---------------------------------------------------------------- SQL twins of the text expressions

_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def _clean_sql(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{WS_RE2}', ' ', 'g'), '[^a-z ]', '', 'g')"
    for a, b in CONTRACTIONS:
        s = f"regexp_replace({s}, '\\b({a})({b})\\b', '\\1 \\2', 'g')"
    return s


def _lemma_sql(t: str) -> str:
    arms = []
    for suf, rep in NOUN_SUFFIXES:
        cond = f"suffix({t}, '{suf}') AND length({t}) - {len(suf)} + {len(rep)} >= 3"
        if suf == "s":
            cond += "".join(f" AND NOT suffix({t}, '{e}')" for e in NO_STRIP_ENDINGS)
        arms.append(f"WHEN {cond} THEN left({t}, length({t}) - {len(suf)}) || '{rep}'")
    return f"CASE {' '.join(arms)} ELSE {t} END"


def tokens_sql(x: str, lemmatize: bool = True, min_len: int = 0) -> str:
    toks = f"list_filter(string_split_regex({_clean_sql(x)}, ' +'), lambda w: w <> '')"
    toks = f"list_filter({toks}, lambda w: NOT list_contains({_STOP_SQL}, w))"
    if lemmatize:
        toks = f"list_transform({toks}, lambda w: {_lemma_sql('w')})"
    if min_len:
        toks = f"list_filter({toks}, lambda w: length(w) >= {min_len})"
    return toks


TERMS_SQL = f"""(SELECT doc_id, unnest({tokens_sql('text', True, 2)}) AS term FROM documents)"""
VOCAB_SQL = f"""(SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, term, cnt, df,
   ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM (
   SELECT term, CAST(count(*) AS BIGINT) AS cnt, CAST(count(DISTINCT doc_id) AS BIGINT) AS df
   FROM {TERMS_SQL} GROUP BY term ORDER BY cnt DESC, term ASC LIMIT 100))"""


# ---------------------------------------------------------------- TXT-1..7

@register("text_normalize", sql=f"""
SELECT doc_id, md5(array_to_string(toks, ' ')) AS norm_md5, CAST(len(toks) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents)""")
def text_normalize(spark, sf):
    d = T(spark, sf, "documents")
    toks = normalized_tokens(F.col("text"))
    return d.select("doc_id", F.md5(F.array_join(toks, " ")).alias("norm_md5"),
                    F.size(toks).cast("bigint").alias("n_tokens"))


# ---------------------------------------------------------------- TXT-8

@register("term_stats", sql=f"""
SELECT term, CAST(count(*) AS BIGINT) AS cnt, CAST(count(DISTINCT doc_id) AS BIGINT) AS df
FROM {TERMS_SQL} GROUP BY term""")
def term_stats(spark, sf):
    return TF.term_stats(T(spark, sf, "documents"), "text", "doc_id")


@register("tfidf_top100", sql=f"SELECT idx, term, cnt, df, {sround('idf', 8)} AS idf FROM {VOCAB_SQL}")
def tfidf_top100(spark, sf):
    d = T(spark, sf, "documents")
    p = TF.fit_tfidf(d, "text", 100, "doc_id")
    return rounded(TF.vocab_frame(spark, p), {"idf": 8})


# ---------------------------------------------------------------- TXT-9/10

@register("tfidf_weights", sql=f"""
WITH v AS {VOCAB_SQL},
tf AS (SELECT t.doc_id, t.term, count(*) * any_value(v.idf) AS w
       FROM {TERMS_SQL} t JOIN v ON t.term = v.term GROUP BY t.doc_id, t.term)
SELECT doc_id, term, {sround('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 6)} AS weight FROM tf""")
def tfidf_weights(spark, sf):
    from .session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    # tokenize once: the fit (term statistics) and the vectoriser read the same tokens
    d = TF.tokenize(T(spark, sf, "documents").select("doc_id", "text"), "text").checkpoint()
    p = TF.fit_tfidf(d, "text", 100, "doc_id")
    return rounded(TF.tfidf_long(d, p, "doc_id"), {"weight": 6})


# ---------------------------------------------------------------- VIZ-8

@register("word_freq", sql=f"""
SELECT word, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT unnest({tokens_sql('text', False)}) AS word FROM documents)
GROUP BY word ORDER BY cnt DESC, word ASC LIMIT 200""")
def word_freq(spark, sf):
    return TF.word_frequencies(T(spark, sf, "documents"), "text", 200)


# ---------------------------------------------------------------- corpus statistics: lemmas, collocations

_WORDS_SQL = f"list_filter(string_split_regex({_clean_sql('text')}, ' +'), lambda w: w <> '')"
_COUNTED_SQL = (f"SELECT word, count(*) AS cnt FROM (SELECT unnest({_WORDS_SQL}) AS word FROM documents) "
                f"WHERE NOT list_contains({_STOP_SQL}, word) GROUP BY word")


def _lemmas_sql() -> str:
    tried = " UNION ALL ".join(
        f"SELECT word, cnt AS word_cnt, {i} AS rule, left(word, length(word) - {len(e)}) || '{put}' AS rest FROM v WHERE suffix(word, '{e}')"
        + (" AND NOT suffix(word, 'ss')" if e == "s" else "") for i, (e, put) in enumerate(X.ENDINGS))
    return f"""
WITH v AS ({_COUNTED_SQL}), t AS ({tried})
SELECT t.word, arg_min(v.word, rule) AS lemma FROM t JOIN v ON rest = v.word
WHERE length(rest) >= {X.MIN_LETTERS} AND v.cnt >= {X.MIN_COUNT} AND v.cnt >= {X.MIN_SHARE} * word_cnt GROUP BY t.word"""


@register("corpus_lemmas", sql=_lemmas_sql())
def corpus_lemmas(spark, sf):
    return X.corpus_lemmas(T(spark, sf, "documents"), "text")


def _ll_sql() -> str:
    part = lambda k, n, p: f"(ln(greatest({p}, 1e-10)) * {k} + ln(greatest(1 - {p}, 1e-10)) * ({n} - {k}))"
    p, w, o = "(n2 / total)", "(nn / n1)", "((n2 - nn) / (total - n1))"
    return (f"2 * ({part('nn', 'n1', w)} + {part('(n2 - nn)', '(total - n1)', o)} - {part('nn', 'n1', p)} "
            f"- {part('(n2 - nn)', '(total - n1)', p)})")


@register("word_cloud", sql=f"""
WITH w AS (SELECT {_WORDS_SQL} AS ws FROM documents), v AS ({_COUNTED_SQL}),
f AS (SELECT word AS plural, left(word, length(word) - 1) AS singular FROM v
      WHERE suffix(word, 's') AND NOT suffix(word, 'ss') AND left(word, length(word) - 1) IN (SELECT word FROM v)),
s AS (SELECT coalesce(singular, word) AS word, CAST(sum(cnt) AS DOUBLE) AS cnt FROM v LEFT JOIN f ON word = plural GROUP BY 1),
p AS (SELECT unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM w WHERE len(ws) > 1),
g AS (SELECT coalesce(fa.singular, a) AS a, coalesce(fb.singular, b) AS b, CAST(count(*) AS DOUBLE) AS nn FROM p
      LEFT JOIN f fa ON a = fa.plural LEFT JOIN f fb ON b = fb.plural
      WHERE NOT list_contains({_STOP_SQL}, a) AND NOT list_contains({_STOP_SQL}, b) GROUP BY 1, 2),
c AS (SELECT a, b, nn, x.cnt AS n1, y.cnt AS n2, (SELECT sum(cnt) FROM s) AS total
      FROM g JOIN s x ON a = x.word JOIN s y ON b = y.word),
k AS (SELECT a, b, nn FROM c WHERE total > n1 AND total > n2 AND {_ll_sql()} >= {X.LEAST_SCORE}),
l AS (SELECT word, sum(cnt) AS cnt FROM (SELECT * FROM s UNION ALL SELECT a, -nn FROM k UNION ALL SELECT b, -nn FROM k) GROUP BY word)
SELECT word, CAST(cnt AS BIGINT) AS cnt FROM (SELECT * FROM l WHERE cnt > 0 UNION ALL SELECT a || ' ' || b, nn FROM k)
ORDER BY cnt DESC, word LIMIT 200""")
def word_cloud(spark, sf):
    """VIZ-8 with collocations and folded plurals."""
    return X.word_cloud(T(spark, sf, "documents"), "text", 200)


# conversations and benchmark texts go through the same vectoriser

@register("conversation_terms", sql=f"""
SELECT role, CAST(count(*) AS BIGINT) AS tokens, CAST(count(DISTINCT w) AS BIGINT) AS vocabulary
FROM (SELECT role, unnest({tokens_sql('text', True, 2)}) AS w FROM conversations) GROUP BY role""")
def conversation_terms(spark, sf):
    c = T(spark, sf, "conversations")
    ex = token_rows(c, "text", ["role"], min_len=TF.MIN_TOKEN_LEN, alias="w")
    return ex.groupBy("role").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("w").alias("vocabulary"))
