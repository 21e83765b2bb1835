"""Text normalisation as built-in column expressions (TXT-1..7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import q

# The English stop-word list of the public NLTK corpus (the
# 179-word edition; apostrophe forms can never match a normalised token but
# are kept so that the list reads as published).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those "
    "am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# The characters Python's Unicode `\s` matches (code points).
WHITESPACE_RANGES = [(0x09, 0x0D), (0x20, 0x20), (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0),
                     (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
                     (0x205F, 0x205F), (0x3000, 0x3000)]


def _ws_class(fmt) -> str:
    return "[" + "".join(fmt(a) if a == b else f"{fmt(a)}-{fmt(b)}" for a, b in WHITESPACE_RANGES) + "]"


# the same class for Java regexes (Spark) and RE2 (DuckDB oracles)
WS_JAVA = _ws_class(lambda c: f"\\u{c:04x}")
WS_RE2 = _ws_class(lambda c: f"\\x{{{c:04x}}}")

# The contraction splits of the Penn-Treebank word tokenizer
# that survive the letters-only filter (word -> two tokens).
CONTRACTIONS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"),
                ("lem", "me"), ("wan", "na")]

# Noun suffix detachment rules (plural suffix -> singular ending),
# tried in this order; a rule applies only if the word it leaves has at least 3 letters.
NOUN_SUFFIXES = [("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"),
                 ("zes", "z"), ("ses", "s"), ("men", "man"), ("s", "")]
NO_STRIP_ENDINGS = ["ss", "us", "is"]


# every whitespace code point, for a regex-free one-to-one translation to a blank
WS_CHARS = "".join(chr(cp) for a, b in WHITESPACE_RANGES for cp in range(a, b + 1))


def clean_text(c: Column) -> Column:
    """TXT-1..3: null -> '', lower-case, whitespace of any kind -> one blank
    each (``translate``: a code-point map, no regex), then delete everything
    outside ``[a-z ]`` with one simple character-class pass."""
    x = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    x = F.translate(x, WS_CHARS, " " * len(WS_CHARS))
    return F.regexp_replace(x, "[^a-z ]+", "")


# all contraction splits in one pass: the first word, when followed by its
# second word, gets a blank appended
_SPLIT_RE = "\\b(" + "|".join(f"{a}(?={b}\\b)" for a, b in CONTRACTIONS) + ")"


def split_contractions(c: Column) -> Column:
    return F.regexp_replace(c, _SPLIT_RE, "$1 ")


def tokens(c: Column) -> Column:
    """TXT-4: whitespace tokens of the cleaned text, empty strings removed."""
    return F.filter(F.split(split_contractions(clean_text(c)), " "), lambda t: t != F.lit(""))


def lemma(t: Column) -> Column:
    """TXT-6 (re-aimed): first matching noun-suffix rule leaving >= 3 letters."""
    out = None
    for suf, rep in NOUN_SUFFIXES:
        ok = t.endswith(suf) & (F.length(t) - len(suf) + len(rep) >= 3)
        if suf == "s":
            for e in NO_STRIP_ENDINGS:
                ok = ok & ~t.endswith(e)
        val = F.concat(t.substr(F.lit(1), F.length(t) - len(suf)), F.lit(rep))
        out = F.when(ok, val) if out is None else out.when(ok, val)
    return out.otherwise(t)


def normalized_tokens(c: Column, stop_words: list[str] | None = None, lemmatize: bool = True) -> Column:
    """TXT-1..6: tokens without stop words, lemmatised."""
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    # IN over literals becomes a hash-set lookup (InSet), not a linear scan
    toks = F.filter(tokens(c), lambda t: ~t.isin(stop))
    return F.transform(toks, lemma) if lemmatize else toks


def normalize_text(c: Column, stop_words: list[str] | None = None, lemmatize: bool = True) -> Column:
    """TXT-7: the normalised text, tokens joined by one blank."""
    return F.array_join(normalized_tokens(c, stop_words, lemmatize), " ")


def user_text_udf(fn):
    """UDF-1: run a user's own ``str -> str`` text function as an
    Arrow-batched pandas UDF (the built-in path stays pure expressions)."""
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: fn(v) if v is not None else "")

    return apply


def token_rows(df, col: str, keep: list[str] | tuple = (), lemmatize: bool = True, min_len: int = 0,
               stop_words: list[str] | None = None, alias: str = "term"):
    """The normalised tokens of ``col`` as rows ``(keep..., term)``.

    Same tokens as ``normalized_tokens`` (+ a minimum length), but the split
    is exploded first so the stop-word test (a hash-set ``IN``), the suffix
    rules and the length filter run as ordinary codegen'd column
    expressions rather than per-element lambdas."""
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    raw = F.split(split_contractions(clean_text(F.col(q(col)))), " ")
    t = df.select(*[F.col(q(k)) for k in keep], F.explode(raw).alias("__t"))
    t = t.where((F.col("__t") != "") & ~F.col("__t").isin(stop))
    term = lemma(F.col("__t")) if lemmatize else F.col("__t")
    t = t.select(*[F.col(q(k)) for k in keep], term.alias(alias))
    return t.where(F.length(alias) >= min_len) if min_len else t
