"""Quality rules with cross-document line frequency (operator 6, native).

Per document the base counts come from one pass of array functions; only
documents that repeat a 3-word window pay for sorting their windows. Across
documents, every distinct normalised line of a document is hashed, and distinct
documents are counted per (host, line). The line rows are kept once in the shared
folder. Lines above the limit of their host are boilerplate and are removed;
documents that would keep too few of their words without them are rejected.

A line is above the limit when it is found in at least ``min_docs`` documents of
the host, or, where ``max_share`` is given, in at least that share of them (and
in two documents). Copies are documents of their own, so a text that stands
``min_docs`` times in a host is boilerplate as a whole: exact dedup comes first
where one copy should stay. A document is depleted when its boilerplate lines
hold more than ``max_loss`` of its words, or leave fewer words than the base rule
asks for.

A line of a host in as many documents as a thousandth of all line rows is joined
by broadcast (there are a thousand of them at most), the others by a shuffle.

Defined cases: a null text has no words and fails the base rules; a null host is
a host of its own; rows that repeat both doc_id and text are one document and get
the same result each; lines without a word are never counted; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, ascii_lower, checkpointed

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. Windows are
    sorted as (hash, position), so equal ones are neighbours; the positions that
    have an equal neighbour are then sorted, and each covers up to three words."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(o: Column) -> Column:
        twin = F.filter(o, lambda x, j: (F.get(o, j - 1)["h"] == x["h"]) | (F.get(o, j + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(twin, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        spans = F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3)))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    # a one-element array binds the sorted value once for the inner lambdas
    inner = F.transform(F.array(ordered), lambda o: positions(o))
    return F.get(F.transform(inner, lambda p: covered(p)), 0)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, version, host and the per-document counts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"), text.alias("text"))
    two = one.select("doc_id", "host", "text", F.xxhash64("text").alias("version"), words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    three = two.select("doc_id", "host", "version", F.size("words").cast("long").alias("n_words"),
                       F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                       F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                       lines.alias("lines"), windows.alias("windows"))
    return three.select(
        "doc_id", "host", "version", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0).cast("long"))
        .otherwise(_repeat_words(F.col("windows"))).alias("n_repeat_words"))


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, version, host, h1, h2, words): one row per distinct normalised
    line of a document, with the words of all its lines of that form."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"),
                        F.xxhash64(text).alias("version"),
                        F.explode(F.split(text, "\n", -1)).alias("line")).where(F.col("line").rlike(WORD))
    key = F.trim(F.regexp_replace(ascii_lower(F.col("line")), f"{SPACE}+", " "))
    return lines.select("doc_id", "version", "host", key.alias("key")).select(
        "doc_id", "version", "host", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(77), F.col("key")).alias("h2"),
        (F.length("key") - F.length(F.replace("key", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))


def boilerplate(lines: DataFrame, min_docs: int = 10, max_share: float | None = None) -> DataFrame:
    """(host, h1, h2, docs) of the lines above the limit of their host."""
    found = lines.groupBy("host", "h1", "h2", "doc_id", "version").agg(F.lit(1).alias("one")).groupBy("host", "h1", "h2").agg(
        F.count("*").alias("docs"))
    if max_share is None:
        return found.where(F.col("docs") >= min_docs)
    totals = lines.groupBy("host", "doc_id", "version").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("t_host")).agg(
        F.count("*").alias("host_docs"))
    return found.join(totals, F.col("host").eqNullSafe(F.col("t_host"))).where(
        (F.col("docs") >= min_docs) | (F.col("docs") >= F.greatest(max_share * F.col("host_docs"), F.lit(2)))).select(
        "host", "h1", "h2", "docs")


def _in_common(lines: DataFrame, common: DataFrame) -> DataFrame:
    """The line rows that are boilerplate. A line of a host with a thousandth of
    all rows or more would fill one task of the shuffle; common lines have at
    least as many rows as documents, so the count is taken of them alone."""
    least = max(1000, lines.count() // 1000)
    own = common.select(F.col("host").alias("c_host"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "docs")
    frequent = F.broadcast(own.where(F.col("docs") >= least))   # at most a thousand rows
    same = F.col("host").eqNullSafe(F.col("c_host")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    cold = lines.join(frequent, same, "left_anti").join(own.where(F.col("docs") < least), same, "left_semi")
    return lines.join(frequent, same, "left_semi").unionByName(cold)


def quality_rules(docs: DataFrame, min_docs: int = 10, max_share: float | None = None, max_loss: float = 0.5,
                  id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, boilerplate_words and kept."""
    lines = checkpointed(line_counts(docs, id_col, text_col, host_col))
    common = checkpointed(boilerplate(lines, min_docs, max_share))
    # rows that repeat doc_id and text would add up: the share is taken of their common sum
    lost = (_in_common(lines, common)
            .groupBy(F.col("doc_id").alias("l_id"), F.col("version").alias("l_version"), F.col("host").alias("l_host"))
            .agg(F.sum("words").alias("lost")))
    base = base_counts(docs, id_col, text_col, host_col)
    repeats = base.groupBy("doc_id", "version", "host").agg(F.count("*").alias("rows")).where("rows > 1")
    repeats = repeats.withColumnsRenamed({"doc_id": "r_id", "version": "r_version", "host": "r_host"})
    lost = lost.join(repeats, F.col("l_id").eqNullSafe(F.col("r_id")) & (F.col("l_version") == F.col("r_version"))
                     & F.col("l_host").eqNullSafe(F.col("r_host")), "left").select(
        "l_id", "l_version", "l_host", (F.col("lost") / F.coalesce("rows", F.lit(1))).cast("long").alias("lost"))
    out = base.join(lost, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("version") == F.col("l_version"))
                    & F.col("host").eqNullSafe(F.col("l_host")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost_words = F.coalesce("lost", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), lost_words.alias("boilerplate_words"),
                      (~failed & (lost_words <= max_loss * F.col("n_words"))
                       & (F.col("n_words") - lost_words >= MIN_WORDS)).alias("kept"))


def quality_digest(docs: DataFrame) -> DataFrame:
    return quality_rules(docs)


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
grams AS (SELECT doc_id, i, word || chr(1) || lead(word) OVER o || chr(1) || lead(word, 2) OVER o AS gram
          FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams WHERE gram IS NOT NULL)
          WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                 translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
common AS (SELECT host, key FROM lines GROUP BY host, key HAVING count(DISTINCT doc_id) >= 10),
lost AS (SELECT doc_id, sum(n) AS lost FROM lines l JOIN common c ON l.key = c.key AND l.host IS NOT DISTINCT FROM c.host
         GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                CAST(coalesce(lost, 0) AS BIGINT) AS boilerplate_words
         FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND boilerplate_words <= 0.5 * n_words AND n_words - boilerplate_words >= 50 AS kept FROM f
"""
