"""Small document tables with the awkward cases every operator must define."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"{rng.choice('abcdeéß')}{rng.randrange(vocabulary):x}{rng.choice(['', '', '.', ','])}" for _ in range(n))


def messy_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 400)) for _ in range(12)]
    texts: list[str | None] = [None, "", " ", "\n", "\n\n a\tb \n", "x", "Hello WORLD", "hello world", "HELLO world", "a b c d", "a b c d"]
    texts += base + [base[0], base[0].upper(), base[1]]
    for k in range(6):  # near copies
        words = base[2].split(" ")
        words[rng.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    passage = prose(rng, 80)
    texts += [prose(rng, 50) + " " + passage + "\n" + prose(rng, 40) for _ in range(5)]
    shared = "Shared Line, everywhere"
    texts += [prose(rng, 30) + f"\n {shared} \t\n" + prose(rng, 30) + "\n" + shared.upper() for _ in range(12)]
    texts += [prose(rng, 20_000), "z" * 5000, "q " * 3000, " " * 700 + "gap", "naïve 漢字 𝔘𝔫𝔦 \u0000 ▁ mark\r\nline\x0bend", "tab\tbed  two  spaces"]
    rows = [(i * 7 % 1000 + i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None]), None if t is None else len(t))
            for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (None, base[0], None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(messy_rows() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same table with extra columns whose names operators like to use."""
    from pyspark.sql import functions as F
    names = ["digest", "keep_id", "draw", "shard", "order", "ids", "decoded", "lang_pred", "score", "version", "kept", "n_words", "class_id"]
    return df.select("*", *[F.lit(-1).alias(n) for n in names])
