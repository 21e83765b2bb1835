"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 4).

The driver reads the model file (a path parameter) and broadcasts its pieces.
A text is cut into segments that no piece crosses: a run of word marks and what
follows it. Each segment that a task hasn't met lately is encoded once, all
new segments of a batch together: symbols lie in one flat numpy array; a round
finds the best pair rank per segment, merges its leftmost occurrence (all
non-overlapping ones where no merge can make a better pair) in all segments at
once, compacts the arrays, and lets finished segments go, until no pair remains.
Document ids are gathered from the segments' ids, and decoding gathers piece
bytes in the same ragged way. The segments that a task keeps are bounded by bytes.

Supported models: BPE with dummy prefix, escaped white space, the identity
normaliser and no user-defined pieces (others raise); characters without a piece
become byte pieces, or the unknown id where the model has none.

Defined cases: a null text counts as empty and gets the end id only; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, ragged, small_batches, small_slices

MARK = "▁"            # stands for a space
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
CACHE_BYTES = 16 << 20     # what the segments that a task keeps may take, estimated (Encoder.limit)
NONE = np.int32(1 << 30)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # piece types of the public model format


class Pieces:
    """What encoding needs of a model, as plain arrays."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int]):
        self.pieces, self.types = pieces, types
        self.size = len(pieces)
        self.unk = types.index(UNKNOWN) if UNKNOWN in types else 0
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        for i, (p, t) in enumerate(zip(pieces, types)):
            if t == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        if (self.byte_ids < 0).any():
            self.byte_ids[:] = -1
        symbols = {p: i for i, (p, t) in enumerate(zip(pieces, types)) if t == NORMAL}
        normal = list(symbols.items())
        for p, _ in normal:  # characters that only occur inside pieces
            for c in p:
                symbols.setdefault(c, len(symbols) + self.size)
        self.symbols = symbols
        order = {s: r for r, s in enumerate(sorted({scores[i] for _, i in normal}, reverse=True))}
        rank = {i: order[scores[i]] for _, i in normal}
        pairs: dict[int, tuple[int, int]] = {}
        best_use: dict[int, int] = {}
        for p, i in normal:
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[i], i)
                    for x in (a, b):
                        best_use[x] = min(best_use.get(x, rank[i]), rank[i])
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int32)
        self.pair_id = np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64)
        self._hash_pairs(keys)
        # merging to a symbol is safe to do everywhere at once if no use of it ranks as high
        self.pair_safe = np.array([best_use.get(i, NONE) > r for r, i in zip(self.pair_rank.tolist(), self.pair_id.tolist())],
                                  dtype=bool)
        points = np.array(sorted((ord(c), i) for c, i in symbols.items() if len(c) == 1), dtype=np.int64).reshape(-1, 2)
        self.char_point, self.char_symbol = points[:, 0], points[:, 1]
        self.low_symbol = np.full(1 << 16, -1, dtype=np.int32)      # of the code points below that
        low = points[:, 0] < 1 << 16
        self.low_symbol[points[low, 0]] = points[low, 1]

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """Open addressing over a table of at least four places a pair; a place
        holds a key and its row, an empty one -1."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self.slot_row = np.zeros((1 << bits) + 64, dtype=np.int32)
        row, at = np.arange(len(keys)), self._slot(keys)
        while len(row):   # in each round, one pair takes a free place, the others move on
            free = np.flatnonzero(self.slot_key[at] < 0)
            taken, first = np.unique(at[free], return_index=True)
            self.slot_key[taken], self.slot_row[taken] = keys[row[free[first]]], row[free[first]]
            left = np.ones(len(row), dtype=bool)
            left[free[first]] = False
            row, at = row[left], at[left] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each pair in the table, -1 if it doesn't merge."""
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_row[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        at = at[open_] + 1
        while len(open_):
            found = self.slot_key[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_row[at[hit]]
            more = ~hit & (found >= 0)
            open_, at = open_[more], at[more] + 1
        return out

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.add_dummy_prefix or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix
                or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces)
                or any(MARK in p.piece.lstrip(MARK) for p in model.pieces if p.type == NORMAL)):
            raise ValueError("only BPE models with identity normalisation and dummy prefix are supported")
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces])

    # ---------------------------------------------------------------- encoding

    def _pairs(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the places ``at``: rank of the pair (place, next), and its
        row in the table."""
        rank, row = np.full(len(at), NONE, dtype=np.int32), np.zeros(len(at), dtype=np.int64)
        ok = np.flatnonzero(at < len(sym) - 1)
        a = at[ok]
        ok = ok[(seg[a] == seg[a + 1]) & (sym[a] >= 0) & (sym[a + 1] >= 0)]
        a = at[ok]
        found = self._rows(sym[a].astype(np.int64) << 32 | sym[a + 1])
        ok, found = ok[found >= 0], found[found >= 0]
        rank[ok], row[ok] = self.pair_rank[found], found
        return rank, row

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct segments."""
        point = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        length = np.array([len(s) for s in segments], dtype=np.int64)
        sym = self.low_symbol[np.minimum(point, (1 << 16) - 1)]
        high = np.flatnonzero(point >= 1 << 16)
        if len(high):
            at = np.searchsorted(self.char_point, point[high])
            at[at == len(self.char_point)] = 0
            sym[high] = np.where(self.char_point[at] == point[high], self.char_symbol[at], -1)
        seg = np.repeat(np.arange(len(segments), dtype=np.int32), length)
        place = np.arange(len(point), dtype=np.int32 if len(point) < 1 << 31 else np.int64)
        done_sym, done_seg, done_place = [], [], []
        rank, row = self._pairs(sym, seg, place)
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(sym)))
            over = np.repeat(best == NONE, size)
            if over.any():
                done_sym.append(sym[over])
                done_seg.append(seg[over])
                done_place.append(place[over])
            hit = np.flatnonzero((rank == np.repeat(best, size)) & ~over)
            if not len(hit):
                break
            # of neighbouring hits every second one, and of unsafe pairs the leftmost of a segment
            run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            first = np.concatenate([[True], seg[hit][1:] != seg[hit][:-1]])
            unsafe = np.zeros(len(segments), dtype=bool)
            unsafe[seg[hit[~self.pair_safe[row[hit]]]]] = True
            hit = hit[first | ((nth % 2 == 0) & ~unsafe[seg[hit]])]
            sym[hit] = self.pair_id[row[hit]]
            keep = ~over
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1
            sym, seg, place, rank, row = sym[keep], seg[keep], place[keep], rank[keep], row[keep]
            # only the pairs on both sides of a merged symbol are new
            new = np.concatenate([new, new[new > 0] - 1])
            rank[new], row[new] = self._pairs(sym, seg, new)
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(segments) + 1, np.int64)
        sym, seg, place = np.concatenate(done_sym), np.concatenate(done_seg), np.concatenate(done_place)
        order = np.argsort(place)
        return self._to_ids(sym[order], seg[order], point[place[order]], len(segments))

    def _to_ids(self, sym: np.ndarray, seg: np.ndarray, point: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        plain = (sym >= 0) & (sym < self.size)
        ids, count = np.where(plain, sym, self.unk), np.ones(len(sym), dtype=np.int64)
        if not plain.all() and self.byte_ids[0] >= 0:
            odd = np.flatnonzero(~plain)
            coded = [chr(c).encode() for c in point[odd].tolist()]
            count[odd] = [len(b) for b in coded]
            out = np.repeat(ids, count)
            out[np.repeat(~plain, count)] = self.byte_ids[np.frombuffer(b"".join(coded), dtype=np.uint8)]
            ids = out
        offsets = np.zeros(n + 1, dtype=np.int64)
        np.add.at(offsets, seg + 1, count)
        return ids, np.cumsum(offsets)


class _Numbers(dict):
    """Numbers of the segments met so far; new ones are numbered and listed. A
    word stands for itself after a single mark."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self)
        self.new.append(segment if segment[0] == MARK else MARK + segment)
        self.chars += len(segment)
        return number

    def of(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words without a mark."""
        out = np.fromiter(map(self.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unmet = np.flatnonzero(out < 0)
        out[unmet] = np.arange(len(self), len(self) + len(unmet))
        new = [words[i] for i in unmet.tolist()]
        self.update(zip(new, out[unmet].tolist()))
        self.new += [MARK + w for w in new]
        self.chars += sum(map(len, new))
        return out

    def size(self) -> int:
        """Estimated bytes: the entry and the head of its string, up to two bytes
        a character and up to four for its ids."""
        return 240 * len(self) + 6 * self.chars


def _segments(text: str) -> list[str]:
    return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []


class Encoder:
    """Encodes batches of texts; keeps the segments it has met."""

    def __init__(self, model: Pieces, tail: list[int]):
        self.model, self.tail = model, np.array(tail, dtype=np.int64)
        self.limit = CACHE_BYTES
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.hits: np.ndarray = np.zeros(0, dtype=np.int64)
        self.ids: np.ndarray = np.zeros(0, dtype=np.int32)
        self.begin: np.ndarray = np.zeros(0, dtype=np.int64)
        self.length: np.ndarray = np.zeros(0, dtype=np.int64)

    def _evict(self) -> None:
        """Keep the segments met more than once, the most frequent first, in half
        of the room; most of the others never come again."""
        words = list(self.number)                # in the order of their numbers
        order = np.argsort(-self.hits, kind="stable")
        order = order[self.hits[order] > 1]
        size = 240 + 6 * np.array([len(w) for w in words], dtype=np.int64)[order]
        order = order[np.cumsum(size) <= self.limit // 2]
        ids, length = self.ids[ragged(self.begin[order], self.length[order])], self.length[order]
        self.clear()
        for k, i in enumerate(order.tolist()):
            dict.__setitem__(self.number, words[i], k)
            self.number.chars += len(words[i])
        self.ids, self.length, self.begin = ids, length, np.cumsum(length) - length
        self.hits = np.zeros(len(order), dtype=np.int64)

    def _learn(self, segments: list[str]) -> None:
        ids, offsets = self.model.encode_segments(segments)
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.begin = np.concatenate([self.begin, base + offsets[:-1]])
        self.length = np.concatenate([self.length, np.diff(offsets)])

    def _look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, how many per text) of the segments: the words of a text whose
        spaces are single and inside, looked up once each, else its segments."""
        parts = pc.split_pattern(texts.fill_null("") if texts.null_count else texts, " ")
        edge = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        row = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()     # far faster than to_pylist
        odd = pc.or_(pc.match_substring(coded.dictionary, MARK), pc.equal(coded.dictionary, "")).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.number.of(words)[row], np.diff(edge)
        at = np.full(len(words), -1, dtype=np.int64)
        at[~odd] = self.number.of([words[i] for i in np.flatnonzero(~odd).tolist()])
        at = at[row]
        edge -= edge[0]
        out = [at[a:z] for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]
        for i in np.unique(np.searchsorted(edge, np.flatnonzero(at < 0), side="right") - 1).tolist():
            out[i] = np.array([self.number[x] for x in _segments(texts[i].as_py())], dtype=np.int64)
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) over the texts, each with the closing ids."""
        at, per = self._look_up(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        hits = np.bincount(at, minlength=len(self.number))
        hits[:len(self.hits)] += self.hits
        self.hits = hits
        size = self.length[at]
        edge = np.concatenate([[0], np.cumsum(per)])
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[ragged(self.begin[at], size)]
        text_size = total[edge[1:]] - total[edge[:-1]]
        tail = len(self.tail)
        offsets = np.concatenate([[0], np.cumsum(text_size + tail)])
        out = np.empty(int(offsets[-1]), dtype=np.int32)
        out[ragged(offsets[:-1], text_size)] = ids
        for k in range(tail):
            out[offsets[1:] - tail + k] = self.tail[k]
        if self.number.size() > self.limit:
            self._evict()
        return out, offsets


class Decoder:
    """Texts of id sequences, as the model's own decoder writes them."""

    def __init__(self, model: Pieces):
        surface = []
        for p, t in zip(model.pieces, model.types):
            surface.append(b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN
                           else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode())
        self.surface = surface
        self.data = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.length = np.array([len(s) for s in surface], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.marked = np.array([t == NORMAL and p.startswith(MARK) for p, t in zip(model.pieces, model.types)])
        self.control = np.array([t == CONTROL for t in model.types])
        self.is_byte = np.array([t == BYTE for t in model.types])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        size = self.length[ids]
        begin = self.begin[ids]
        # the dummy prefix: one space less where the first piece that isn't control has one
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            while a < b and self.control[ids[a]]:
                a += 1
            if a < b and self.marked[ids[a]]:
                begin[a] += 1
                size[a] -= 1
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.data[ragged(begin, size)].tobytes()
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            part = raw[total[a]:total[b]]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:  # byte pieces that aren't UTF-8, which encode() never makes
                out.append(self._loose(ids[a:b], [raw[total[i]:total[i + 1]] for i in range(a, b)]))
        return out

    def _loose(self, ids: np.ndarray, parts: list[bytes]) -> str:
        out, run = [], b""
        for i, p in zip(ids.tolist(), parts):
            if self.is_byte[i]:
                run += p
                continue
            out.append(_lossy(run) + p.decode())
            run = b""
        return "".join(out) + _lossy(run)


def _lossy(run: bytes) -> str:
    """Each byte that doesn't begin a whole character becomes U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i:i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def _parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """(rows, their texts) of about a million characters at most, one row at least."""
    for b in small_slices(batches, 200):
        row = 0
        for part in _bounded(b.column(at).to_pylist()):
            yield b.slice(row, len(part)), part
            row += len(part)


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _bounded(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    held, part = 0, []
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= chars:
            yield part
            held, part = 0, []
    if part:
        yield part


def _id_runs(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of a bounded number of ids, one row at least."""
    a = 0
    while a < len(offsets) - 1:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, z
        a = z


_state: dict[int, tuple] = {}


def _worker(handle) -> tuple[Encoder, Decoder]:
    """Tables of this Python worker, made once per broadcast."""
    if handle.value["key"] not in _state:
        _state.clear()
        model = Pieces(handle.value["pieces"], handle.value["scores"], handle.value["types"])
        _state[handle.value["key"]] = (Encoder(model, handle.value["tail"]), Decoder(model))
    _state[handle.value["key"]][0].limit = CACHE_BYTES
    return _state[handle.value["key"]]


def _share(spark: SparkSession, model_path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb
    Pieces.load(model_path)  # raises for a model that isn't supported
    model = pb.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    tail = [i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == "</s>"]
    return spark.sparkContext.broadcast({"key": f"{model_path}:{len(model.pieces)}", "tail": tail, "pieces": [p.piece for p in model.pieces],
                                         "scores": [p.score for p in model.pieces], "types": [p.type for p in model.pieces]})


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids (end id included) of every whole text added."""
    small_batches(docs.sparkSession)
    handle = _share(docs.sparkSession, model_path)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(handle)[0]
        for own, part in _parts(batches, at):
            ids, offsets = encoder.encode(part)
            yield pa.RecordBatch.from_arrays([*own.columns, _lists(ids, offsets)], names=[*own.schema.names, ids_col])
        encoder.clear()
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of every id sequence added."""
    handle = _share(rows.sparkSession, model_path)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _worker(handle)[1]
        for b in small_slices(batches):
            lists = b.column(at)
            lists = lists.fill_null([]) if lists.null_count else lists
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)   # offsets are places in it, for a slice too
            texts: list[str] = []
            for a, z in _id_runs(offsets):
                part = offsets[a:z + 1]
                texts += decoder.decode(flat[part[0]:part[-1]].astype(np.int64), part - part[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def public_model() -> str:
    """Default model file; any other path can be given."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_digest(docs: DataFrame, model_path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` without its text, with n_tokens, the ids (if wanted), and the
    SHA-256 of the decimal ids and of the text that they decode to.

    Encoding, decoding and both digests are one pass of a single Python worker a
    core; no decoded text leaves it."""
    small_batches(docs.sparkSession)
    handle = _share(docs.sparkSession, model_path)
    at = docs.columns.index(text_col)
    keep = [i for i in range(len(docs.columns)) if i != at]
    added = [("n_tokens", T.LongType()), *([("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
             ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker(handle)
        for own, part in _parts(batches, at):
            ids, offsets = encoder.encode(part)
            rows = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            id_digest = [sha256(" ".join(map(str, ids[a:z].tolist())).encode()).hexdigest() for a, z in rows]
            decoded: list[str] = []
            for a, z in _id_runs(offsets):
                span = offsets[a:z + 1]
                decoded += [sha256(t.encode()).hexdigest() for t in decoder.decode(ids[span[0]:span[-1]].astype(np.int64), span - span[0])]
            new = [pa.array(np.diff(offsets), pa.int64()), *([_lists(ids, offsets)] if with_ids else []),
                   pa.array(id_digest, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*(own.column(i) for i in keep), *new],
                                             names=[*(own.schema.names[i] for i in keep), *(n for n, _ in added)])
        encoder.clear()
        give_back()

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in keep), *(T.StructField(n, t) for n, t in added)]))


def roundtrip_digest(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    return encode_digest(docs.select("doc_id", "text"), model_path or public_model())
