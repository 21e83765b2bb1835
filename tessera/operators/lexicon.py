"""Word statistics that look at the whole corpus: lemmas verified by its
vocabulary (TXT-6) and word counts with collocations (VIZ-8).

Both work on the counted vocabulary and on counted neighbour pairs; texts are read
once per statistic and never shuffled. Word counts of the cloud are sums of its pairs.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTRACTIONS, STOP_WORDS, clean_text, split_contractions
from ..session import ensure_checkpoint_dir
from .profile import q

#: Noun endings that may be detached, in the order tried.
ENDINGS = [("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ses", "s"), ("men", "man"), ("s", "")]
MIN_LETTERS = 3         # of a lemma
MIN_COUNT = 2           # occurrences of a lemma in the corpus
MIN_SHARE = 0.05        # of the occurrences of the word that it stands for
BROADCAST = 1_000_000   # lemmas that are broadcast; more are joined by a shuffle
LEAST_SCORE = 30.0      # log-likelihood from which a pair is a collocation


def _words(df: DataFrame, col: str) -> DataFrame:
    """One array of words per row, stop words included."""
    text = df.select(clean_text(F.col(q(col))).alias("t"))
    some = reduce(or_, [F.col("t").contains(a + b) for a, b in CONTRACTIONS])      # few texts need the regex
    split = F.when(some, split_contractions(F.col("t"))).otherwise(F.col("t"))
    return text.select(F.array_remove(F.split(split, " "), "").alias("words"))


def _counted(words: DataFrame, stop: list[str]) -> DataFrame:
    """(word, cnt) of the words that aren't stop words."""
    return words.select(F.explode("words").alias("word")).where(~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("cnt"))


def neighbours(words: DataFrame, stop: list[str]) -> DataFrame:
    """(a, b, cnt): how often a word is followed by another; ``b`` is null at the end
    of a text and before a stop word. Every place of a word is in one row of it."""
    after = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    places = words.select(F.inline(F.arrays_zip(F.col("words").alias("a"), after.alias("b")))).where(~F.col("a").isin(stop))
    return places.select("a", F.when(~F.col("b").isin(stop), F.col("b")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("cnt"))


def corpus_lemmas(df: DataFrame, col: str, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE,
                  stop_words: list[str] | None = None) -> DataFrame:
    """(word, lemma): words of the column with a detachable ending whose rest is
    itself a word of the corpus, in ``min_count`` places or more and in at least
    ``min_share`` as many as the word. The first ending that qualifies counts; other
    words (``gas``, ``bus``, ``series``) are their own lemma and have no row."""
    vocabulary = _counted(_words(df, col), list(STOP_WORDS if stop_words is None else stop_words))
    word = F.col("word")
    rests = []
    for i, (ending, put) in enumerate(ENDINGS):
        rest = F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(put))
        rests.append(F.when(word.endswith(ending) & (F.length(rest) >= MIN_LETTERS) & ~(word.endswith("ss") & F.lit(ending == "s")),
                            F.struct(F.lit(i).alias("rule"), rest.alias("rest"))))
    tried = vocabulary.select("word", F.col("cnt").alias("word_cnt"), F.explode(F.array_compact(F.array(*rests))).alias("t")).select(
        "word", "word_cnt", "t.rule", "t.rest")
    known = vocabulary.select(F.col("word").alias("lemma"), "cnt")
    good = tried.join(known, F.col("rest") == F.col("lemma")).where(
        (F.col("cnt") >= min_count) & (F.col("cnt") >= min_share * F.col("word_cnt")))
    return good.groupBy("word").agg(F.min_by("lemma", "rule").alias("lemma"))


def lemmatised(words: DataFrame, lemmas: DataFrame, col: str = "word") -> DataFrame:
    """``words`` with ``col`` replaced by its lemma. ``lemmas`` is read twice: it
    should be a written or checkpointed table."""
    other = lemmas.select(F.col("word").alias("__of"), F.col("lemma").alias("__lemma"))
    if other.count() <= BROADCAST:
        other = F.broadcast(other)
    joined = words.join(other, F.col(q(col)) == F.col("__of"), "left")
    return joined.withColumn(col, F.coalesce("__lemma", F.col(q(col)))).drop("__of", "__lemma")


def _log_likelihood(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Twice the log-likelihood gain of two words depending on each other."""
    def part(k: Column, n: Column, p: Column) -> Column:
        return F.log(F.greatest(p, F.lit(1e-10))) * k + F.log(F.greatest(1 - p, F.lit(1e-10))) * (n - k)

    p = second / total
    with_, without = both / first, (second - both) / (total - first)
    gain = part(both, first, with_) + part(second - both, total - first, without) - part(both, first, p) - part(second - both, total - first, p)
    return F.when((total > first) & (total > second), 2 * gain).otherwise(0.0)


def word_cloud(df: DataFrame, col: str, top: int = 200, least_score: float = LEAST_SCORE, stop_words: list[str] | None = None) -> DataFrame:
    """VIZ-8: (word, cnt), the ``top`` words and collocations by count, ties by
    word. Plurals in -s count for their singular where the corpus has it. Two
    neighbouring words (no stop word among them) are a collocation when the
    log-likelihood of their pair reaches ``least_score``; its places are taken off
    the counts of its words."""
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    ensure_checkpoint_dir(df.sparkSession)
    follows = neighbours(_words(df, col), stop).checkpoint()       # read below for the words and for the pairs
    counted = follows.groupBy(F.col("a").alias("word")).agg(F.sum("cnt").alias("cnt")).checkpoint()
    word = F.col("word")
    singular = F.when(word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1))
    plurals = counted.select(word.alias("plural"), singular.alias("singular")).join(
        counted.select(word.alias("known")), F.col("singular") == F.col("known")).select("plural", "singular")

    def folded(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(plurals, F.col(name) == F.col("plural"), "left").withColumn(name, F.coalesce("singular", name)).drop("plural", "singular")

    single = folded(counted, "word").groupBy("word").agg(F.sum("cnt").alias("cnt"))
    pairs = follows.where(F.col("b").isNotNull())
    pairs = folded(folded(pairs, "a"), "b").groupBy("a", "b").agg(F.sum("cnt").alias("both"))
    total = single.agg(F.sum("cnt").alias("total"))
    first = single.select(word.alias("a"), F.col("cnt").alias("first"))
    second = single.select(word.alias("b"), F.col("cnt").alias("second"))
    scored = pairs.join(first, "a").join(second, "b").join(F.broadcast(total))     # one row
    found = scored.where(_log_likelihood(F.col("both").cast("double"), F.col("first"), F.col("second"), F.col("total")) >= least_score)
    found = found.select("a", "b", "both").checkpoint()
    # words keep the places that no collocation takes; a pair of one word twice takes two
    taken = found.select(F.explode(F.array("a", "b")).alias("word"), (-F.col("both")).alias("cnt"))
    left = single.unionByName(taken).groupBy("word").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    cloud = left.unionByName(found.select(F.concat_ws(" ", "a", "b").alias("word"), F.col("both").alias("cnt")))
    return cloud.orderBy(F.desc("cnt"), F.asc("word")).limit(top)
