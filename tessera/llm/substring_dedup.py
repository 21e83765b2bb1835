"""Substring dedup with fixed-block anchors over words (operator 3).

Every text is cut into non-overlapping reference blocks of ``(window + 1) // 2``
words; any window of ``window`` words holds one whole block. The index of block
hashes is dealt by hash range and probed with the hash of every rolling window
of block length of the corpus; a block that is met a second time is an anchor.
A window can only repeat if the block inside it does, so only the windows around
anchors are extended to full length and compared again, by a 64-bit hash of the
whole window. The union of the repeated windows of a text gives its maximal
repeated runs.

Probes and replies travel as packed arrays (see repeats.py); each distinct text
is handled once, and texts that several rows hold are repeated throughout.

Defined cases: a null text has no words; texts shorter than the window lose
nothing; rows that repeat a text all lose it (if it holds a window); an empty
table gives an empty result; ids may be null or repeated, other columns are left
alone. Two different windows are taken for equal only if their 64-bit hashes
collide (for n compared windows, about n * n / 2**65 of them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import Words, doc_chunks, ragged, text_buffers, tidy, window_hash

WINDOW = 35
RESULT = "d1 long, d2 long, n_words long, n_removed long, spans array<int>, kept_sha256 string"


class _Text:
    """Word hashes and places of the texts of a chunk that can hold a window."""

    def __init__(self, chunk: R.Chunk, window: int):
        raw, off = text_buffers(chunk.text)
        self.raw, self.off = raw, off
        self.parts = [(a, Words(raw, off, a, b)) for a, b in doc_chunks(off)]
        self.window = window
        self.block = (window + 1) // 2

    def windows(self, part: Words, length: int, step: int = 1) -> np.ndarray:
        """Word places at which a run of ``length`` words of a text long enough
        begins; every ``step``-th of a text."""
        size = np.diff(part.first)
        n = np.where(size >= self.window, (size - length) // step + 1, 0)
        begin = ragged(np.zeros(len(n), np.int64), n)
        return np.repeat(part.first[:-1], n) + begin * step

    def block_hashes(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(hashes of all rolling windows, hashes of the blocks, block places per part)."""
        rolling, blocks, places = [], [], []
        for _, part in self.parts:
            h = window_hash(part.hash, self.block)
            rolling.append(h[self.windows(part, self.block)])
            places.append(self.windows(part, self.block, self.block))
            blocks.append(h[places[-1]])
        return _cat(rolling), _cat(blocks), places

    def candidates(self, places: list[np.ndarray], anchors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(hashes, places per part) of the full windows that hold an anchor."""
        hashes, starts, done = [], [], 0
        for (_, part), at in zip(self.parts, places):
            own = at[anchors[done:done + len(at)]]
            done += len(at)
            doc = np.searchsorted(part.first, own, side="right") - 1
            low = np.maximum(own + self.block - self.window, part.first[doc])
            high = np.minimum(own, part.first[doc + 1] - self.window)
            start = np.unique(ragged(low, np.maximum(high - low + 1, 0)))
            starts.append(start)
            hashes.append(window_hash(part.hash, self.window, seed=1)[start] if len(start) else np.zeros(0, np.uint64))
        return _cat(hashes), starts


def _cat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)


def _replies(table: pa.Table, kind: int) -> tuple[list[int], list[bytes]]:
    own = table.filter(pc.equal(table.column("kind"), kind)) if table.num_rows else table
    return own.column("p").to_pylist(), own.column("bits").to_pylist()


def removed_words(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """RESULT rows, one per distinct text: spans are (begin, end) word places of
    the removed runs, one after the other."""
    text = F.col(f"`{text_col}`")
    texts = R.distinct_texts(docs, text)
    log2 = R.fan_out(docs, 8 << 20)

    def ask_blocks(table: pa.Table) -> pa.Table:
        chunk = R.Chunk(table)
        rolling, blocks, _ = _Text(chunk, window).block_hashes()
        return R.table_of(R.QUESTION, R.questions(chunk.chunk, rolling, blocks, log2))

    def anchored(chunk: R.Chunk, replies: pa.Table) -> tuple[_Text, np.ndarray, list[np.ndarray]]:
        own = _Text(chunk, window)
        _, blocks, places = own.block_hashes()
        anchors = R.read_answers(*_replies(replies, 1), blocks, log2)[0]
        return own, *own.candidates(places, anchors)

    def ask_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return R.table_of(R.QUESTION, [[], [], [], []])
        chunk = R.Chunk(table)
        _, hashes, _ = anchored(chunk, replies)
        return R.table_of(R.QUESTION, R.questions(chunk.chunk, hashes, None, log2, exact=True))

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], [], [], []]
        if not table.num_rows:
            return R.table_of(RESULT, rows)
        chunk = R.Chunk(table)
        own, hashes, starts = anchored(chunk, replies)
        again = R.read_answers(*_replies(replies, 2), hashes, log2, exact=True)[0]
        done = 0
        for (first_doc, part), start in zip(own.parts, starts):
            hit = start[again[done:done + len(start)]]
            done += len(start)
            gone = R.covered(hit, window, len(part.start))
            for d in range(len(part.first) - 1):  # a text of several rows repeats throughout
                a, b = part.first[d], part.first[d + 1]
                if chunk.n[first_doc + d] > 1 and b - a >= window:
                    gone[a:b] = True
            kept = np.flatnonzero(~gone)
            size = part.end[kept] - part.start[kept]
            joined = np.append(part.buf, np.uint8(32))[ragged(part.start[kept], size + 1)]
            edge = np.concatenate([[0], np.cumsum(size + 1)])
            joined[edge[1:] - 1] = 32
            joined = joined.tobytes()
            before = np.concatenate([[0], np.cumsum(~gone)])
            for d in range(len(part.first) - 1):
                a, b = part.first[d], part.first[d + 1]
                words = joined[edge[before[a]]:max(edge[before[b]] - 1, edge[before[a]])]
                begin, end = R.runs(gone[a:b])
                for col, value in zip(rows, (int(chunk.d1[first_doc + d]), int(chunk.d2[first_doc + d]), int(b - a),
                                             int(gone[a:b].sum()), np.stack([begin, end], axis=1).ravel().tolist(),
                                             hashlib.sha256(words).hexdigest())):
                    col.append(value)
        return R.table_of(RESULT, rows)

    one = texts.groupBy("chunk").applyInArrow(tidy(ask_blocks), R.QUESTION)
    one = one.groupBy("p").applyInArrow(tidy(lambda t: R.answer(t, False)), R.ANSWER).withColumn("kind", F.lit(1))
    two = texts.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(tidy(ask_windows), R.QUESTION)
    two = two.groupBy("p").applyInArrow(tidy(lambda t: R.answer(t, True)), R.ANSWER).withColumn("kind", F.lit(2))
    return texts.groupBy("chunk").cogroup(one.unionByName(two).groupBy("chunk")).applyInArrow(tidy(remove), RESULT)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept_sha256 per row of ``docs``."""
    return R.join_results(docs, removed_words(docs, window, text_col), F.col(f"`{text_col}`"),
                          ["n_words", "n_removed", "spans", "kept_sha256"], id_col)


def kept_words(text: str | None, spans: list[int]) -> str:
    """The text that the spans leave: kept words joined by one space."""
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for a, b in reversed(list(zip(spans[::2], spans[1::2]))):
        del words[a:b]
    return " ".join(words)


def substring_digest(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, i, string_agg(word, ' ') OVER o AS s, count(*) OVER o AS n
        FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win WHERE n = 35) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM again, range(0, 35) t(o)),
kept AS (SELECT words.doc_id, count(gone.i) AS n_removed,
                sha256(coalesce(string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
