"""Language identification by multinomial naive Bayes (operator 9).

Training counts hashed character n-grams (1 to 3 code points of the lower-cased
text) per language over labelled rows; the counts are folded in the scan tasks
and summed by Spark, so the driver gets at most languages x bins numbers. The
log-probability matrix (languages x 65536 floats) is broadcast. Scoring is a
sparse product per batch: the bins of a document are its column indices, the
document offsets its row pointers, and the gathered log-probabilities are summed
per row.

The posterior only compares the learned languages, so it says nothing about a
text in none of them. That is told by a further column, from the mean log-likelihood in the best language
of the n-grams of letters and spaces (numbers and keys are in no language), plus
an allowance for short texts: it must reach a floor learned from the training rows
of the language, each scored by counts without its own. The floor lies three
quarters of the standard deviation of a single n-gram below their 1 % quantile.

Learning is from at most about ``max_train`` labelled rows of each language, chosen
by a hash of the row (documented bound of the sample), so that every label is
learned at any size; the priors are of all labelled rows. Prediction covers every
row and the whole text.

Defined cases: a null text and one without a letter are ``und`` with score 0 and in
no language, and no other text is; if no row can be learned from, every row is
``und``; equal scores go to the first language in code point order; a null doc_id isn't held out; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, small_slices

BINS_LOG2 = 16
ORDERS = (1, 2, 3)
MAX_TRAIN = 20_000
PIECE_CHARS = 1 << 18   # characters handled at once
LETTER = re.compile(r"[^\W\d_]")
ALLOWANCE = 2.0         # standard errors by which a mean over few n-grams may be lower
LOW = 0.01              # quantile of the training rows from which a floor is learned
MARGIN = 0.75           # standard deviations of an n-gram by which it lies below
#: Odd multipliers, one per n-gram order and place (fixed values).
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xB5297A4D], dtype=np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, code points, edges): texts joined to pieces of a bounded
    length. Long texts are cut every PIECE_CHARS places with an overlap; an
    n-gram belongs to the part in which it begins before the overlap."""
    longest = max(ORDERS)
    joined: list[str] = []
    docs: list[int] = []
    held = 0
    for d, text in enumerate(texts):
        if not text:
            continue
        low = text.lower()
        for a in range(0, len(low), PIECE_CHARS):
            part = low[a:a + PIECE_CHARS + longest - 1]
            joined.append(part)
            docs.append(d)
            held += len(part)
            if held >= PIECE_CHARS:
                yield _flat(docs, joined)
                joined, docs, held = [], [], 0
    if joined:
        yield _flat(docs, joined)


def _flat(docs: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.array(docs), points, edge


def _bins(points: np.ndarray) -> list[np.ndarray]:
    """Bin of the n-gram that begins at each place, for every order."""
    out, k = [], 0
    for order in ORDERS:
        n = max(0, len(points) - order + 1)
        h = np.full(n, order, dtype=np.uint32)
        for j in range(order):
            h ^= points[j:j + n] * _MULTIPLIERS[k]
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(15)
            k += 1
        out.append((h >> np.uint32(32 - BINS_LOG2)).astype(np.int32))
    return out


def _spans(edge: np.ndarray, order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the places of each part whose n-gram stays inside it and
    begins before the overlap."""
    begin = np.minimum(edge[:-1], n)
    return begin, np.maximum(begin, np.minimum(np.minimum(edge[1:] - order + 1, edge[:-1] + PIECE_CHARS), n))


def _gather(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[begin:end] per span, in double precision."""
    out = np.zeros(len(begin))
    full = end > begin
    if full.any():
        pairs = np.stack([begin[full], end[full]], axis=1).ravel()
        padded = np.concatenate([values, values[:1]])  # so that an end at the very end is a valid index
        out[full] = np.add.reduceat(padded, pairs, dtype=np.float64)[::2]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bin, count) of one task."""
    table: dict[str, np.ndarray] = {}
    for b in small_slices(batches):
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for x, t in zip(langs, texts) if x == lang]
            sums = table.setdefault(lang, np.zeros(1 << BINS_LOG2, dtype=np.int64))
            for _, points, edge in _pieces(own):
                for order, bins in zip(ORDERS, _bins(points)):
                    inside = np.zeros(len(bins) + 1, dtype=np.int32)
                    begin, end = _spans(edge, order, len(bins))
                    np.add.at(inside, begin, 1)
                    np.add.at(inside, end, -1)
                    sums += np.bincount(bins[np.cumsum(inside[:-1]) > 0], minlength=1 << BINS_LOG2)
    for lang, sums in table.items():
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())],
                              ["lang", "bin", "n"])


class Model:
    """Languages and their log-probabilities per bin, relative to the mean over
    the languages (which no comparison needs). ``mean``, ``floor``, ``spread`` and
    ``unseen`` tell texts of no learned language; without them none is told."""

    def __init__(self, langs: list[str], prior: np.ndarray, matrix: np.ndarray, mean: np.ndarray | None = None,
                 floor: np.ndarray | None = None, spread: np.ndarray | None = None, unseen: np.ndarray | None = None):
        self.langs, self.prior, self.matrix = langs, prior, matrix
        self.mean, self.floor, self.spread, self.unseen = mean, floor, spread, unseen

    def fits(self, best: np.ndarray, likelihood: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Whether texts of these summed log-likelihoods can be of their best
        language: not below its floor, and not as good as unseen n-grams only."""
        each = likelihood / np.maximum(grams, 1)
        room = allowance(self.spread[best], grams)
        least = np.maximum(self.floor[best], self.unseen[best] + np.log(2))
        return (grams == 0) | (each + room >= least)


def allowance(spread: np.ndarray | float, grams: np.ndarray | int) -> np.ndarray:
    """What a mean over few n-grams may lack; those that begin at one place count once."""
    return ALLOWANCE * spread / np.sqrt(np.maximum(grams / len(ORDERS), 1))


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which are letters or spaces."""
    every = [chr(i) for i in range(0x110000)]
    letter = np.fromiter(map(str.isalpha, every), bool)
    return letter, letter | np.fromiter(map(str.isspace, every), bool)


def _worded(points: np.ndarray) -> list[np.ndarray]:
    """Whether the n-gram that begins at each place has letters and spaces only,
    and a letter, for every order."""
    letter, word = (kind[points] for kind in _kinds())
    out = []
    for order in ORDERS:
        n = max(0, len(points) - order + 1)
        out.append(np.logical_and.reduce([word[j:j + n] for j in range(order)])
                   & np.logical_or.reduce([letter[j:j + n] for j in range(order)]))
    return out


def _worded_bins(text: str) -> np.ndarray:
    """The bins of all n-grams of letters and spaces of a text."""
    return np.concatenate([np.zeros(0, np.int32), *(
        bins[a:z][use[a:z]] for _, points, edge in _pieces([text])
        for order, bins, use in zip(ORDERS, _bins(points), _worded(points))
        for a, z in zip(*_spans(edge, order, len(bins))))])


def _likelihoods(model: Model, texts: list[str | None], best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-likelihood in the language ``best`` of the n-grams of letters
    and spaces of each text, and their number."""
    total, grams = np.zeros(len(texts)), np.zeros(len(texts))
    for docs, points, edge in _pieces(texts):
        lang = np.repeat(best[docs], np.diff(edge))
        for order, bins, use in zip(ORDERS, _bins(points), _worded(points)):
            if len(bins):
                begin, end = _spans(edge, order, len(bins))
                logs = np.where(use, model.matrix[lang[:len(bins)], bins] + model.mean[bins], 0)
                np.add.at(total, docs, _gather(logs, begin, end))
                np.add.at(grams, docs, _gather(use, begin, end))
    return total, grams


def _floors(rows: DataFrame, langs: list[str], counts: np.ndarray, spread: np.ndarray, alpha: float) -> np.ndarray:
    """Per language the least mean log-likelihood, allowance included."""
    handle = rows.sparkSession.sparkContext.broadcast((counts, counts.sum(axis=1)))
    index = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, totals = handle.value
        for b in small_slices(batches):
            out: list[tuple[str, float]] = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i, bins = index[lang], _worded_bins(text)
                if not len(bins):
                    continue
                seen, own = np.unique(bins, return_counts=True)
                logs = np.log(every[i][seen] - own + alpha) - np.log(totals[i] - len(bins) + alpha * every.shape[1])
                out.append((lang, float(own @ logs) / len(bins) + float(allowance(spread[i], len(bins)))))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                                  ["lang", "fit"])

    found = (rows.select("lang", "text").mapInArrow(run, "lang string, fit double").groupBy("lang")
             .agg(F.percentile("fit", F.lit(LOW)).alias("low")).collect())
    handle.unpersist()
    floor = np.full(len(langs), -np.inf)
    for r in found:
        i = index[r["lang"]]
        floor[i] = r["low"] - MARGIN * spread[i]
    return floor


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN, alpha: float = 0.5) -> Model:
    """Model of a (lang, text, key) table of labelled rows."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rank = F.pmod(F.xxhash64(F.lit(9), F.col("key"), F.col("text")), F.lit(1 << 30))
    labels = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(rank).alias("least")).collect()}
    if any(r["n"] > max_train for r in labels.values()):
        # the row of the least rank is always in, whatever the ranks of equal rows
        limits = [(lang, max(int(min(1.0, max_train / r["n"]) * (1 << 30)), r["least"] + 1)) for lang, r in labels.items()]
        table = rows.sparkSession.createDataFrame(limits, "lang string, below long")
        rows = rows.join(F.broadcast(table), "lang").where(rank < F.col("below"))
    sums = (rows.select("lang", "text").mapInArrow(_counts, "lang string, bin int, n long")
            .groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(labels)
    matrix = np.zeros((len(langs), 1 << BINS_LOG2))
    docs = np.array([labels[lang]["n"] for lang in langs], dtype=np.float64)
    for i, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        matrix[i, own["bin"].to_numpy()] = own["n"].to_numpy()
    if not langs:
        return Model([], docs, matrix.astype(np.float32))
    sizes = (matrix + alpha).sum(axis=1, keepdims=True)
    logs = np.log(matrix + alpha) - np.log(sizes)
    p = (matrix + alpha) / sizes
    spread = np.sqrt(np.maximum((p * logs**2).sum(axis=1) - (p * logs).sum(axis=1) ** 2, 0.0))
    floor = _floors(rows, langs, matrix, spread, alpha)
    mean = logs.mean(axis=0, keepdims=True)
    logs -= mean
    return Model(langs, np.log(docs / docs.sum()), logs.astype(np.float32), mean[0].astype(np.float32), floor, spread,
                 np.log(alpha / sizes[:, 0]))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted language, its posterior probability, and whether the text
    reaches the floor of that language, per text."""
    known = np.array([bool(t and model.langs and LETTER.search(t)) for t in texts], dtype=bool)
    if not model.langs or not texts:
        return ["und"] * len(texts), np.zeros(len(texts)), known
    total = np.tile(model.prior, (len(texts), 1))
    for docs, points, edge in _pieces(texts):
        for order, bins in zip(ORDERS, _bins(points)):
            begin, end = _spans(edge, order, len(bins))
            if not len(bins):
                continue
            for i in range(len(model.langs)):
                np.add.at(total[:, i], docs, _gather(model.matrix[i][bins], begin, end))
    best = total.argmax(axis=1)
    inside = known & model.fits(best, *_likelihoods(model, texts, best)) if model.floor is not None else known
    posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return ([model.langs[k] if ok else "und" for k, ok in zip(best, known)], np.where(known, posterior, 0.0), inside)


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred",
            score_col: str = "score", inside_col: str = "in_language") -> DataFrame:
    """``docs`` with the three columns added (their names must be free)."""
    small_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches):
            langs, scores, inside = score_texts(handle.value, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(inside)],
                                             names=[*b.schema.names, pred_col, score_col, inside_col])

    out = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType()),
                        T.StructField(inside_col, T.BooleanType())])
    return docs.mapInArrow(run, out)


def train_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out quarter."""
    return docs.where(~held_out(F.col("doc_id"))).select("lang", "text", F.col("doc_id").alias("key"))


def identify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, in_language per row of ``docs``."""
    model = fit(train_rows(docs), max_train)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "in_language")
