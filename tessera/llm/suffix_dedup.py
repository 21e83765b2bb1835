"""Suffix-array dedup over bytes by a common-prefix interval tree (operator 7).

Any repeated string of ``length`` bytes holds, in each of its occurrences, the
same locally minimal gram: the smallest hash of ``gram`` bytes among all grams of
a window of ``length`` bytes. These anchors thin the suffixes out to about one
in 150 without losing a repeat.

1. Anchor hashes that occur once in the corpus go (packed questions, repeats.py).
2. Around each other anchor, the bytes that a window could take in (left and right
   context) go to the hash range of the anchor; equal contexts of a chunk travel
   once. There the suffixes that begin at an anchor are sorted, neighbouring
   suffixes give the common prefixes, and a stack scan yields the interval tree.
   Each interval stands for all occurrences of a right extension; they are told
   apart by their left extensions, and those that share enough of them for a
   repeat of ``length`` bytes are a repeat group. Its occurrences are all marked,
   neighbours in the array or not.
3. Anchors in so many places that their contexts would not fit a task are asked
   by the hash of each whole window instead, spread over all ranges.
4. Back in its chunk, each text unites the extents around its anchors.

Each distinct text is handled once; texts that several rows hold are repeated
throughout. Matches never cross texts.

Defined cases: a null text is empty; texts under ``length`` bytes lose nothing;
rows that repeat a text all lose it; an empty table gives an empty result; ids may
be null or repeated, other columns are left alone. Contexts are compared byte by
byte; only the windows of step 3 go by hash, two of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import _BASE, _BYTE_VALUE, _INVERSE, doc_chunks, mix64, powers, ragged, text_buffers, tidy

LENGTH = 400
GRAM = 100
HOT = 8192   # counted occurrences from which an anchor is asked by whole windows
CAP = 64     # occurrences sent one by one per chunk; further ones go as a number
ANCHORS = R.QUESTION + ", beyond binary"
CONTEXTS = "p int, chunk int, counted binary, asked binary, meta binary, data binary"
REPLY = "chunk int, p int, bits binary, extents binary, kind int"
RESULT = "d1 long, d2 long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept_sha256 string"
META = np.dtype([("hash", "<u8"), ("left", "<u2"), ("right", "<u2"), ("times", "<u1")])
LAST = np.uint64(2**64 - 1)
#: A second polynomial for whole windows, so that a false match needs two clashes.
_BASE_2 = 0xD6E8FEB86659FD93
_INVERSE_2 = pow(_BASE_2, -1, 1 << 64)
_BYTE_VALUE_2 = mix64(_BYTE_VALUE ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i + w] for every i, from block prefixes and suffixes."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = np.append(x, np.full(-n % w, LAST, dtype=x.dtype)).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1: n])


class _Part:
    """Bytes, prefix sums and anchors of some texts of a chunk."""

    def __init__(self, buf: np.ndarray, edge: np.ndarray, length: int, gram: int):
        self.buf, self.edge, self.length, self.gram = buf, edge, length, gram
        n = len(buf)
        value = _BYTE_VALUE[buf]
        value *= powers(_BASE, n)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(value, out=self.total[1:])
        self.at, self.hash = self._anchors()
        text = np.searchsorted(edge, self.at, side="right") - 1
        self.at_begin, self.at_end = edge[text], edge[text + 1]   # of the text around each anchor

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte string begin..end."""
        span = self.total[end] - self.total[begin]
        span *= powers(_INVERSE, len(self.buf) + 1)[begin]
        return mix64(span + (end - begin).astype(np.uint64))

    def second_hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte string begin..end by the second polynomial."""
        n = len(self.buf)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE_2[self.buf] * powers(_BASE_2, n), out=total[1:])
        return mix64((total[end] - total[begin]) * powers(_INVERSE_2, n + 1)[begin])

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        n, w = len(self.buf), self.length - self.gram + 1
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n < self.length:
            return none
        span = self.total[self.gram:] - self.total[:-self.gram]
        span *= powers(_INVERSE, n)[: len(span)]
        h = np.full(n, LAST, dtype=np.uint64)
        h[: len(span)] = mix64(span + np.uint64(self.gram)) | np.uint64(1)
        texts = list(zip(self.edge[:-1].tolist(), self.edge[1:].tolist()))
        for a, b in texts:    # grams and windows that would cross into the next text
            h[max(a, b - self.gram + 1):b] = LAST
        least = sliding_min(h, w)
        # the largest window minimum over the windows that hold the gram: a minimum of the complement
        low = np.full(n + w - 1, LAST, dtype=np.uint64)
        np.invert(least, out=low[w - 1:w - 1 + len(least)])
        for a, b in texts:
            low[w - 1 + max(a, b - self.length + 1):w - 1 + b] = LAST
        high = ~sliding_min(low, w)
        at = np.flatnonzero((high == h) & (h != LAST))
        # minima crowd at the low end of the hash range; mixed again they fill all ranges evenly
        return at, mix64(h[at])


class _Bytes:
    def __init__(self, table: pa.Table, length: int, gram: int):
        self.chunk = R.Chunk(table)
        raw, off = text_buffers(self.chunk.text)
        self.length, self.gram = length, gram
        self.parts = [(a, _Part(raw[off[a]:off[b]], off[a:b + 1] - off[a], length, gram)) for a, b in doc_chunks(off)]
        self.hash = _cat([p.hash for _, p in self.parts], np.uint64)

    def contexts(self, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """The wanted anchors of all parts: part, place, begin and end of the
        context, and in ``entry`` the number of its distinct (anchor, context)."""
        part, at, begin, end, body, done = [], [], [], [], [], 0
        reach = self.length - self.gram
        for i, (_, p) in enumerate(self.parts):
            use = wanted[done:done + len(p.at)]
            done += len(p.at)
            own = p.at[use]
            a, z = np.maximum(own - reach, p.at_begin[use]), np.minimum(own + self.length, p.at_end[use])
            part.append(np.full(len(own), i))
            at.append(own)
            begin.append(a)
            end.append(z)
            body.append(p.hashes(a, z) ^ mix64((own - a).astype(np.uint64)))
        c = {"part": _cat(part), "at": _cat(at), "begin": _cat(begin), "end": _cat(end)}
        h, body = self.hash[wanted], _cat(body, np.uint64)
        order = np.lexsort((body, h))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (body[order][1:] != body[order][:-1])
        number = np.cumsum(first) - 1
        entry = np.zeros(len(order), dtype=np.int64)
        entry[order] = number
        return c | {"entry": entry, "hash": h, "head": order[first], "times": np.bincount(number, minlength=0)}

    def context_rows(self, c: dict[str, np.ndarray], log2: int) -> dict[int, tuple[bytes, bytes]]:
        """Packed distinct contexts by hash range."""
        head = c["head"]
        meta = np.zeros(len(head), dtype=META)
        meta["hash"], meta["left"] = c["hash"][head], c["at"][head] - c["begin"][head]
        meta["right"], meta["times"] = c["end"][head] - c["at"][head], np.minimum(c["times"], 2)
        size = c["end"][head] - c["begin"][head]
        stop = np.concatenate([[0], np.cumsum(size)])
        data = np.zeros(int(stop[-1]), dtype=np.uint8)
        for i, (_, p) in enumerate(self.parts):
            own = np.flatnonzero(c["part"][head] == i)
            data[ragged(stop[own], size[own])] = p.buf[ragged(c["begin"][head][own], size[own])]
        cut = R._parts(meta["hash"].copy(), log2, True)
        return {p: (meta[cut[p]:cut[p + 1]].tobytes(), data[stop[cut[p]]:stop[cut[p + 1]]].tobytes())
                for p in np.flatnonzero(np.diff(cut)).tolist()}

    def windows(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(hashes, second hashes, places per part) of the windows that hold a hot anchor."""
        hashes, second, starts, done = [], [], [], 0
        for _, p in self.parts:
            use = hot[done:done + len(p.at)]
            done += len(p.at)
            own = p.at[use]
            low = np.maximum(own + self.gram - self.length, p.at_begin[use])
            high = np.minimum(own, p.at_end[use] - self.length)
            start = np.unique(ragged(low, np.maximum(high - low + 1, 0)))
            starts.append(start)
            hashes.append(p.hashes(start, start + self.length))
            second.append(p.second_hashes(start, start + self.length) if len(start) else np.zeros(0, np.uint64))
        return _cat(hashes, np.uint64), _cat(second, np.uint64), starts


def _cat(arrays: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(len(rows), width)


def _common(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Length of the common prefix, row by row."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(size_a, size_b))


def interval_tree(prefix: list[int]) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of a suffix array with
    these common prefixes of neighbours, children before parents."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefix, -1]):
        first = i
        while stack and stack[-1][0] > p:
            top, first = stack.pop()
            out.append((top, first, i))
        if p >= 0 and (not stack or stack[-1][0] < p):
            stack.append((p, first))
    return out


class _Sorted:
    """Distinct (left context reversed, suffix) pairs at one anchor as a suffix
    array: order, common prefixes of neighbours, left contexts in array order."""

    def __init__(self, lefts: list[bytes], rights: list[bytes]):
        n = len(rights)
        self.order = sorted(range(n), key=rights.__getitem__)
        suffix = _matrix([rights[i] for i in self.order], max(map(len, rights)) or 1)
        size = np.array([len(rights[i]) for i in self.order])
        self.prefix = _common(suffix[1:], suffix[:-1], size[1:], size[:-1])
        self.before = _matrix([lefts[i] for i in self.order], max(map(len, lefts)) or 1)
        self.room = np.array([len(lefts[i]) for i in self.order])
        self.by_left = np.zeros(n, dtype=np.int64)
        self.by_left[np.array(sorted(range(n), key=lambda k: lefts[self.order[k]]))] = np.arange(n)

    def intervals(self):
        """(common prefix, places, common left extension of neighbours) of every
        interval; places are all its occurrences in the order of their left contexts."""
        for shared, a, b in interval_tree(self.prefix.tolist()):
            own = np.arange(a, b + 1)
            own = own[np.argsort(self.by_left[own])]
            yield shared, own, _common(self.before[own[1:]], self.before[own[:-1]], self.room[own[1:]], self.room[own[:-1]])


def extents(lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct (left context reversed, suffix) pairs at one anchor: how far
    to the left and right the repeats of ``length`` bytes or more reach."""
    array = _Sorted(lefts, rights)
    left, right = np.zeros(len(rights), dtype=np.int64), np.zeros(len(rights), dtype=np.int64)
    for shared, own, near in array.intervals():
        most = np.maximum(np.append(near, 0), np.insert(near, 0, 0))
        group = most + shared >= length
        left[own[group]] = np.maximum(left[own[group]], most[group])
        right[own[group]] = np.maximum(right[own[group]], shared)
    back = np.empty(len(rights), dtype=np.int64)
    back[array.order] = np.arange(len(rights))
    return left[back], right[back]


def groups_at(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int, list[int]]]:
    """Maximal repeat groups at one anchor: (bytes to the left, bytes to the
    right, all occurrences). Occurrences of an interval that share a left
    extension form a group if neither side can be extended for all of them."""
    array, out = _Sorted(lefts, rights), []
    for shared, own, near in array.intervals():
        for lcs, a, b in interval_tree(near.tolist()):
            at = own[a:b + 1]
            if lcs + shared >= length and array.prefix[at.min():at.max()].min() == shared:
                out.append((lcs, shared, [array.order[i] for i in at.tolist()]))
    return out


class _Range:
    """The contexts of one hash range, anchor by anchor."""

    def __init__(self, metas: list[bytes], datas: list[bytes]):
        meta = [np.frombuffer(m, META) for m in metas]
        self.row = np.repeat(np.arange(len(meta)), [len(m) for m in meta])   # input row of each context
        self.number = np.concatenate([np.arange(len(m)) for m in meta])      # and its number there
        self.every = np.concatenate(meta)
        self.data = b"".join(datas)
        self.rows = len(meta)

    def anchors(self) -> Iterator[dict[tuple[int, bytes], list[int]]]:
        """For each anchor its distinct (left length, context) and who has them."""
        every, data = self.every, self.data
        stop = np.concatenate([[0], np.cumsum(every["left"].astype(np.int64) + every["right"])])
        order = np.argsort(every["hash"], kind="stable")
        h = every["hash"][order]
        cut = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            same: dict[tuple[int, bytes], list[int]] = {}
            for i in order[a:b].tolist():
                same.setdefault((int(every["left"][i]), data[stop[i]:stop[i + 1]]), []).append(i)
            yield same


def _range_extents(metas: list[bytes], datas: list[bytes], length: int) -> list[bytes]:
    """(left, right) extents of the contexts of one hash range, per input row."""
    found = _Range(metas, datas)
    out = np.zeros((len(found.every), 2), dtype=np.uint16)
    for same in found.anchors():
        if len(same) > 1:
            parts = list(same)
            left, right = extents([d[:k][::-1] for k, d in parts], [d[k:] for k, d in parts], length)
            for own, lo, hi in zip(same.values(), left.tolist(), right.tolist()):
                out[own] = (lo, hi)
        for (k, d), own in same.items():  # a whole context found twice
            if len(own) > 1 or found.every["times"][own[0]] > 1:
                out[own] = (k, len(d) - k)
    return [out[found.row == r].tobytes() for r in range(found.rows)]


def _range_groups(metas: list[bytes], datas: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(group, bytes to the left, length, input row, context number) of every
    occurrence of every maximal repeat group of one hash range."""
    found = _Range(metas, datas)
    for same in found.anchors():
        parts, owners = list(same), list(same.values())
        # a context found more than once is two leaves, so that it can form groups with itself
        leaf = [i for i, own in enumerate(owners) for _ in range(1 + (len(own) > 1 or found.every["times"][own[0]] > 1))]
        if len(leaf) < 2:
            continue
        texts = [(d[:k][::-1], d[k:]) for k, d in parts]
        for lo, hi, members in groups_at([texts[i][0] for i in leaf], [texts[i][1] for i in leaf], length):
            members = sorted({leaf[m] for m in members})
            k, d = parts[members[0]]
            string = np.frombuffer(d[k - lo:k + hi], dtype=np.uint8)
            if lo not in _Part(string, np.array([0, len(string)]), length, gram).at:
                continue   # an anchor by bytes outside the string: not all its occurrences meet here
            name = int.from_bytes(hashlib.blake2b(d[k - lo:k + hi], digest_size=8).digest(), "big", signed=True)
            for m in members:
                for i in owners[m]:
                    yield name, lo, lo + hi, int(found.row[i]), int(found.number[i])


def _reply(table: pa.Table, kind: int, column: str) -> tuple[list[int], list[bytes]]:
    if not table.num_rows:
        return [], []
    own = table.filter(pc.and_(pc.equal(table.column("kind"), kind), pc.is_valid(table.column(column))))
    return own.column("p").to_pylist(), own.column(column).to_pylist()


def _again(replies: pa.Table, one: np.ndarray, two: np.ndarray, log2: int) -> np.ndarray:
    """Windows found more than once by both of their hashes."""
    rows = list(zip(*_reply(replies, 2, "bits")))
    flags = []
    for k, hashes in enumerate((one, two)):
        own = [(p - (k << log2), b) for p, b in rows if p >> log2 == k]
        flags.append(R.read_answers([p for p, _ in own], [b for _, b in own], hashes, log2, exact=True)[0])
    return flags[0] & flags[1]


class _Job:
    """The passes that both results share, for one table and its parameters."""

    def __init__(self, docs: DataFrame, length: int, gram: int, hot: int, text_col: str):
        self.length, self.gram, self.hot = length, gram, hot
        self.texts = R.distinct_texts(docs, F.col(f"`{text_col}`"))
        self.log2 = R.fan_out(docs, 4 << 20)

    def first(self) -> DataFrame:
        """Replies of kind 1: which anchors occur again, and which are hot."""
        length, gram, hot, log2 = self.length, self.gram, self.hot, self.log2

        def ask_anchors(table: pa.Table) -> pa.Table:
            own = _Bytes(table, length, gram)
            ask, more = R.questions(own.chunk.chunk, own.hash, None, log2, cap=CAP), R.beyond(own.hash, log2, CAP)
            return R.table_of(ANCHORS, [*ask, [more.get(p) for p in ask[0]]])

        asked = self.texts.groupBy("chunk").applyInArrow(tidy(ask_anchors), ANCHORS)
        return asked.groupBy("p").applyInArrow(tidy(lambda t: R.answer(t, False, (2, hot))), R.ANSWER).select(
            "chunk", "p", "bits", F.lit(None).cast("binary").alias("extents"), F.lit(1).alias("kind"))

    def flagged(self):
        length, gram, log2 = self.length, self.gram, self.log2

        def flag(table: pa.Table, replies: pa.Table) -> tuple[_Bytes, np.ndarray, np.ndarray]:
            own = _Bytes(table, length, gram)
            again, many = R.read_answers(*_reply(replies, 1, "bits"), own.hash, log2, levels=2)
            return own, again & ~many, many

        return flag

    def contexts(self, first: DataFrame) -> DataFrame:
        """CONTEXTS rows: packed contexts, and the windows of hot anchors."""
        flag, log2 = self.flagged(), self.log2

        def send(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows:
                return R.table_of(CONTEXTS, [[]] * 6)
            own, again, many = flag(table, replies)
            packed = own.context_rows(own.contexts(again), log2)
            # each window is asked by two hashes; the second one's ranges follow the first one's
            one, two, _ = own.windows(many)
            counted = {}
            for k, hashes in enumerate((one, two)):
                ask = R.questions(own.chunk.chunk, hashes, None, log2, exact=True)
                counted |= {p + (k << log2): c for p, c in zip(ask[0], ask[2])}
            ranges = sorted(packed.keys() | counted.keys())
            return R.table_of(CONTEXTS, [ranges, [own.chunk.chunk] * len(ranges), [counted.get(p) for p in ranges],
                                         [None] * len(ranges), *([packed.get(p, (None, None))[k] for p in ranges] for k in (0, 1))])

        return self.texts.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(tidy(send), CONTEXTS)


def removed_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                  text_col: str = "text") -> DataFrame:
    """RESULT rows, one per distinct text; spans are (begin, end) byte places of
    the removed runs, one after the other."""
    job = _Job(docs, length, gram, hot, text_col)
    flag, log2 = job.flagged(), job.log2

    def match(table: pa.Table) -> pa.Table:
        p = int(table.column("p")[0].as_py())
        out: dict[int, list] = {c: [None, None] for c in table.column("chunk").to_pylist()}
        asks = table.filter(pc.is_valid(table.column("counted")))
        if asks.num_rows:
            said = R.answer(asks, True)
            for c, bits in zip(said.column("chunk").to_pylist(), said.column("bits").to_pylist()):
                out[c][0] = bits
        found = table.filter(pc.is_valid(table.column("meta")))
        if found.num_rows:
            reach = _range_extents(found.column("meta").to_pylist(), found.column("data").to_pylist(), length)
            for c, x in zip(found.column("chunk").to_pylist(), reach):
                out[c][1] = x
        return R.table_of(REPLY, [list(out), [p] * len(out), [x[0] for x in out.values()], [x[1] for x in out.values()],
                                  [2] * len(out)])

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in range(7)]
        if not table.num_rows:
            return R.table_of(RESULT, rows)
        own, again, many = flag(table, replies)
        c = own.contexts(again)
        said = dict(zip(*_reply(replies, 2, "extents")))
        reach = np.frombuffer(b"".join(said[p] for p in sorted(said)), dtype=np.uint16).reshape(-1, 2).astype(np.int64)[c["entry"]]
        hashes, second, starts = own.windows(many)
        window = _again(replies, hashes, second, log2)
        done = 0
        for i, (first_doc, part) in enumerate(own.parts):
            n = len(part.buf)
            depth = np.zeros(n + 1, dtype=np.int32)
            mine = np.flatnonzero((c["part"] == i) & (reach[:, 1] > 0))
            np.add.at(depth, c["at"][mine] - reach[mine, 0], 1)
            np.add.at(depth, c["at"][mine] + reach[mine, 1], -1)
            hit = starts[i][window[done:done + len(starts[i])]]
            done += len(starts[i])
            gone = (np.cumsum(depth[:n]) > 0) | R.covered(hit, length, n)
            for d in range(len(part.edge) - 1):
                a, b = int(part.edge[d]), int(part.edge[d + 1])
                if own.chunk.n[first_doc + d] > 1 and b - a >= length:  # a text of several rows
                    gone[a:b] = True
                begin, end = R.runs(gone[a:b])
                for col, value in zip(rows, (int(own.chunk.d1[first_doc + d]), int(own.chunk.d2[first_doc + d]), b - a,
                                             int(gone[a:b].sum()), len(begin), np.stack([begin, end], axis=1).ravel().tolist(),
                                             hashlib.sha256(part.buf[a:b][~gone[a:b]].tobytes()).hexdigest())):
                    col.append(value)
        return R.table_of(RESULT, rows)

    first = job.first()
    second = job.contexts(first).groupBy("p").applyInArrow(tidy(match), REPLY)
    return job.texts.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(tidy(remove), RESULT)


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, text_col: str = "text") -> DataFrame:
    """The maximal repeat groups with all their occurrences: group (a hash of the
    repeated string), length, d1 and d2 (digests of the text), place (of its first
    byte). A repeat that reaches beyond the context of an anchor comes as one
    group per anchor; around hot anchors every repeated window is a group. Equal
    texts are one occurrence. A run of one period has as many maximal repeats as
    places, so this listing, unlike the removal, grows with the square of such runs."""
    job = _Job(docs, length, gram, hot, text_col)
    flag, log2 = job.flagged(), job.log2
    found_schema, out_schema = "chunk int, p int, bits binary, extents binary, kind int", "group long, length int, d1 long, d2 long, place int"
    item = np.dtype([("group", "<i8"), ("left", "<i4"), ("length", "<i4"), ("number", "<i4")])

    def match(table: pa.Table) -> pa.Table:
        p = int(table.column("p")[0].as_py())
        cols: list[list] = [[], [], [], [], []]
        asks = table.filter(pc.is_valid(table.column("counted")))
        if asks.num_rows:
            said = R.answer(asks, True)
            for c, bits in zip(said.column("chunk").to_pylist(), said.column("bits").to_pylist()):
                for col, v in zip(cols, (c, p, bits, None, 2)):
                    col.append(v)
        found = table.filter(pc.is_valid(table.column("meta")))
        if found.num_rows:
            rows = list(_range_groups(found.column("meta").to_pylist(), found.column("data").to_pylist(), length, gram))
            chunk = found.column("chunk").to_pylist()
            by_row: dict[int, list] = {}
            for name, left, size, row, number in rows:
                by_row.setdefault(row, []).append((name, left, size, number))
            for row, items in by_row.items():
                for col, v in zip(cols, (chunk[row], p, None, np.array(items, dtype=item).tobytes(), 2)):
                    col.append(v)
        return R.table_of(found_schema, cols)

    def locate(table: pa.Table, replies: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        if not table.num_rows:
            return R.table_of(out_schema, cols)
        own, again, many = flag(table, replies)
        c = own.contexts(again)

        def add(group: int, size: int, part: int, place: int) -> None:
            first_doc, p = own.parts[part]
            d = int(np.searchsorted(p.edge, place, side="right")) - 1
            for col, v in zip(cols, (group, size, int(own.chunk.d1[first_doc + d]), int(own.chunk.d2[first_doc + d]), place - int(p.edge[d]))):
                col.append(v)

        holders: dict[int, list[int]] = {}
        for i, e in enumerate(c["entry"].tolist()):
            holders.setdefault(e, []).append(i)
        # contexts are numbered within a hash range; the ranges follow each other in hash order
        cut = R._parts(np.sort(c["hash"][c["head"]]), log2, True)
        for p, blob in zip(*_reply(replies, 2, "extents")):
            for name, left, size, number in np.frombuffer(blob, item).tolist():
                for i in holders[int(cut[p]) + number]:
                    add(name, size, int(c["part"][i]), int(c["at"][i]) - left)
        hashes, second, starts = own.windows(many)
        window = _again(replies, hashes, second, log2)
        place = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        part = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
        for i in np.flatnonzero(window).tolist():
            add(int(hashes[i].astype(np.int64)), length, int(part[i]), int(place[i]))
        return R.table_of(out_schema, cols)

    first = job.first()
    second = job.contexts(first).groupBy("p").applyInArrow(tidy(match), found_schema)
    located = job.texts.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(tidy(locate), out_schema)
    return located.distinct()


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256 per row of ``docs``."""
    return R.join_results(docs, removed_bytes(docs, length, gram, hot, text_col), F.col(f"`{text_col}`"),
                          ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"], id_col)


def suffix_digest(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
