"""SentencePiece encoding and decoding by shared-prefix forward passes over a trie of words.

Texts are marked as the library does (a mark in front and for each space) and cut into
marked words, at marks and line feeds, which no piece of the model crosses. The distinct
words of a batch are sorted, so that depth-first order of their trie is reading them one
after the other; the forward state of a prefix that two words share is computed once.

For a unigram model the forward state of a position is the best sum of scores of pieces
up to there, with the piece that reaches it (Viterbi; of equal sums the longer last
piece). For a BPE model it is not a sum of scores but the piece that the encoding of the
prefix ends with: of the pieces that end there, the one that stands next to the state at
its beginning also when the two alone are merged by the model's scores. Neighbours that
hold pairwise make up the encoding of the whole, so backtracking gives the library's
pieces (tested against it on every word of the fixtures). Summed scores would not.

Characters without a piece become the byte pieces of their UTF-8 bytes. Decoding joins
pieces, reads byte pieces as UTF-8 and takes the leading mark off, which gives every
text back that does not itself contain the mark or begin in a way that is not UTF-8.
Models of other kinds, that change texts before (normalise, drop spaces), without byte
pieces, with pieces that cross words or with user-defined pieces are refused.

The words of a block of texts are cut and hashed as one array of bytes. A worker keeps the
encodings of up to WORDS words by 64-bit hash, in arrays (some 30 bytes a word); when they
are full, those stay that were asked for again since the last time.

Defined cases: null text counts as empty (no pieces); a word of any length is read
once through; words of several marks are merged as a whole; round_trip says whether
decoding gives the text back, where a mark in the text counts as the space it becomes;
equal rows are encoded each; other columns are kept by encode_column and ignored by
encode; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, mix64, on_other_work, small_batches

MARK = "▁"
#: Words whose encodings a worker keeps, and pieces whose neighbours it remembers.
WORDS, NEIGHBOURS = 1_200_000, 400_000
#: Characters of texts that are encoded at once: what is worked with meanwhile takes some 40 bytes for each.
BLOCK = 1 << 19
#: Longest word, in characters, that is merged without a heap.
SHORT = 48
#: Longest word, in bytes, that is kept, and bytes of words that are hashed at once.
KEPT_BYTES, HASHED_BYTES = 120, 1 << 19
#: What the library takes off the least score for a character without a piece.
UNKNOWN = 10.0
UNIGRAM, BPE = 1, 2

_U = np.uint64
_BYTE = mix64(np.arange(601, 857, dtype=np.uint64))
_POWERS = np.array([pow(0x2545F4914F6CDD1D, i, 1 << 64) for i in range(KEPT_BYTES)], np.uint64)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; nested ones as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield number, raw[at : at + size]
            at += size


def _kind(raw: bytes) -> int:
    """UNIGRAM or BPE; raises for a model whose texts are changed before they are cut."""
    kind, rules, dummy, extra, escaped = UNIGRAM, b"", 1, 1, 1
    for number, value in _fields(raw):
        if number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            rules, dummy, extra, escaped = spec.get(2, b""), spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"models of kind {kind} are not supported")
    if rules or not dummy or extra or not escaped:
        raise ValueError("the model changes texts before it cuts them, or adds no mark in front")
    return kind


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about BLOCK characters together, one text at least; of no texts one empty block."""
    first = size = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > first and size + n > BLOCK:
            yield first, k
            first, size = k, 0
        size += n
    yield first, len(texts)


def _cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin, of texts that begin at starts: at the first of several marks (here spaces), at line feeds and behind them."""
    space, line = data == 0x20, data == 0x0A
    first = line.copy()
    first[1:] |= line[:-1] | space[1:] & ~space[:-1]
    first[starts] = True
    return np.flatnonzero(first)


def _hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places, of the first KEPT_BYTES bytes and the size."""
    taken, out, a = np.minimum(size, KEPT_BYTES), np.empty(len(at), np.uint64), 0
    ends = np.cumsum(taken)
    with np.errstate(over="ignore"):
        while a < len(at):
            before = ends[a] - taken[a]
            b = max(a + 1, int(np.searchsorted(ends, before + HASHED_BYTES, "right")))
            n = taken[a:b]
            begin = ends[a:b] - n - before
            within = np.arange(ends[b - 1] - before) - np.repeat(begin, n)
            value = _BYTE[data[np.repeat(at[a:b], n) + within]] * _POWERS[within]
            out[a:b] = mix64(np.add.reduceat(value, begin) + size[a:b].astype(np.uint64) * _BYTE[0])
            a = b
    return out


class Pieces:
    """A model of the BPE or the unigram kind: pieces, scores, and the encoding of marked words."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.kind = _kind(raw)
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.score = {self.names[i]: model.get_score(i) for i in plain}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if model.unk_id() in self.byte:
            raise ValueError("the model has no byte pieces")
        if any(dict(_fields(v)).get(3, 1) == 4 for n, v in _fields(raw) if n == 1):
            raise ValueError("the model has user-defined pieces")
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("words are cut at marks and line feeds, which a piece of this model crosses")
        self.values = {i: b for b, i in enumerate(self.byte)}
        # what each piece decodes to
        raw_of = [bytes([self.values[i]]) if i in self.values else name.encode() for i, name in enumerate(self.names)]
        self.bytes_of = np.frombuffer(b"".join(raw_of), np.uint8)
        self.size_of = np.array([len(x) for x in raw_of], np.int64)
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN
        # lengths of the pieces that end in these two or three characters, longest first
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            for k in (2, 3):
                if len(p) >= k:
                    ends.setdefault(p[-k:], {1}).add(len(p))
        for x, n in ends.items():
            if len(x) == 3 and x[1:] in self.ids:
                n.add(2)
        self.sizes = {x: tuple(sorted((k for k in n if len(x) == 3 or k < 3), reverse=True)) for x, n in ends.items()}
        # of the words kept: sorted hashes with their rows; by row whether it was asked for again, and where its pieces end
        self.hashes, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.again, self.bounds, self.kept = np.zeros(0, bool), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.neighbours: dict[str, dict[str, bool]] = {}
        self.known_neighbours = 0

    def merge(self, word: str) -> list[str]:
        """Pieces by merging neighbours, best score first and leftmost of equals; the rule that defines the model."""
        if len(word) <= SHORT:
            return self._merge_short(word, -1) or []
        parts: list[str | None] = list(word)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                both = parts[i] + parts[j]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _merge_short(self, word: str, apart: int) -> list[str] | None:
        """merge of a short word, without a heap; None as soon as pieces are merged across the position apart."""
        score, parts = self.score.get, list(word)
        best = [score(x + y, -math.inf) for x, y in zip(parts, parts[1:])]
        while best:
            top = max(best)
            if top == -math.inf:
                break
            i = best.index(top)
            if i == apart - 1:
                return None
            if i < apart - 1:
                apart -= 1
            parts[i] += parts.pop(i + 1)
            del best[i]
            if i < len(best):
                best[i] = score(parts[i] + parts[i + 1], -math.inf)
            if i:
                best[i - 1] = score(parts[i - 1] + parts[i], -math.inf)
        return parts

    def _beside(self, a: str, b: str) -> bool:
        """Whether the piece b stays apart from a when the two are merged; a is empty, or no piece, where b stands first."""
        if a not in self.ids:
            got = self.merge(b) == [b]
        else:
            got = (self._merge_short(a + b, len(a)) if len(a) + len(b) <= SHORT else self.merge(a + b)) == [a, b]
        if self.known_neighbours >= NEIGHBOURS:  # the inner tables are cleared, as states in use hold on to them
            for of in self.neighbours.values():
                of.clear()
            self.known_neighbours = 0
        self.neighbours.setdefault(a, {})[b] = got
        self.known_neighbours += 1
        return got

    def numbers(self, pieces: list[str]) -> tuple[int, ...]:
        try:
            return tuple([self.ids[p] for p in pieces])
        except KeyError:
            return tuple(chain.from_iterable((self.ids[p],) if p in self.ids else (self.byte[b] for b in p.encode()) for p in pieces))

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct marked words, read depth-first through their trie."""
        return self._unigram(words) if self.kind == UNIGRAM else self._bpe(words)

    def _bpe(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {}
        ids, sizes_of, neighbours, beside, alone = self.ids, self.sizes.get, self.neighbours, self._beside, (1,)
        # by characters read: the piece that ends the encoding up to there, and what is known of its neighbours
        last, known = [""], [neighbours.setdefault("", {})]
        previous = ""
        for word in sorted(words):
            if word.startswith(MARK * 2) or word == MARK:
                out[word] = self.numbers(self.merge(word))
                continue
            shared = 0
            for x, y in zip(word, previous, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], known[shared + 1 :]
            for i in range(shared, len(word)):
                # one piece at most can end the encoding here
                end = i + 1
                for n in (i > 1 and sizes_of(word[i - 2 : end])) or sizes_of(word[i - 1 : end], alone) if i else alone:
                    start = end - n
                    if start >= 0:
                        piece = word[start:end]
                        fits = known[start].get(piece)
                        if fits or fits is None and piece in ids and beside(last[start], piece):
                            break
                else:
                    piece = word[i]
                last.append(piece)
                of = neighbours.get(piece)
                if of is None:
                    of = neighbours[piece] = {}
                known.append(of)
            previous = word
            path, at = [], len(word)
            while at:
                piece = last[at]
                path.append(piece)
                at -= len(piece)
            path.reverse()
            out[word] = self.numbers(path)
        return out

    def _unigram(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {}
        score, sizes_of, unknown, alone = self.score, self.sizes.get, self.unknown, (1,)
        best, last = [0.0], [""]  # by characters read: sum of scores, piece that ends the best path
        previous = ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(word, previous, strict=False):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], last[shared + 1 :]
            for i in range(shared, len(word)):
                top, end = -np.inf, word[i]
                for n in (i > 1 and sizes_of(word[i - 2 : i + 1])) or sizes_of(word[i - 1 : i + 1], alone) if i else alone:
                    start = i + 1 - n
                    if start < 0:
                        continue
                    piece = word[start : i + 1]
                    own = score.get(piece, unknown if n == 1 else None)
                    if own is not None and best[start] + own > top:
                        top, end = best[start] + own, piece
                best.append(top)
                last.append(end)
            previous = word
            path, at = [], len(word)
            while at:
                path.append(last[at])
                at -= len(last[at])
            out[word] = self.numbers(path[::-1])
        return out

    def _made(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces of each of distinct words, whose marks are spaces, and the pieces in a row."""
        marked = [w.decode().replace(" ", MARK) for w in words]
        ids = self.encode_words(marked)
        made = [ids[w] for w in marked]
        return np.fromiter(map(len, made), np.int64, len(made)), np.fromiter(chain.from_iterable(made), np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of words, -1 for those that are not kept."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.row[at], -1)

    def _keep(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Keeps the pieces of words with these sorted hashes, which are not kept yet."""
        n, ids = self._made(words)
        at = np.searchsorted(self.hashes, hashes)
        self.row = np.insert(self.row, at, len(self.again) + np.arange(len(n), dtype=np.int32))
        self.hashes = np.insert(self.hashes, at, hashes)
        self.again = np.append(self.again, np.zeros(len(n), bool))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(n))
        self.kept = np.append(self.kept, ids)

    def _thin_out(self) -> None:
        """Of the words kept those stay that were asked for again, if they are no more than half of WORDS."""
        stay = self.again if np.count_nonzero(self.again) <= WORDS // 2 else np.zeros(len(self.again), bool)
        own, size = stay[self.row], np.diff(self.bounds)
        self.kept, self.bounds = self.kept[np.repeat(stay, size)], np.append(0, np.cumsum(size[stay]))
        self.hashes, self.row = self.hashes[own], (np.cumsum(stay) - 1)[self.row[own]].astype(np.int32)
        self.again = np.zeros(np.count_nonzero(stay), bool)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all texts in a row, their number and whether decoding gives it back, by text."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is circular, and each collection would walk the caches
        try:
            parts = [self._encoded(texts[a:b]) for a, b in _blocks(texts)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        finally:
            if collects:
                gc.enable()

    def _encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        raw, ends = b"".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        starts = np.append(0, ends[:-1])
        data = np.frombuffer(raw, np.uint8)
        at = _cut(data, starts[starts < ends])
        end = np.append(at[1:], len(data))
        hashes, first, word = np.unique(_hashes(data, at, end - at), return_index=True, return_inverse=True)
        short = end[first] - at[first] <= KEPT_BYTES
        row = np.where(short, self._find(hashes), -1)
        self.again[row[row >= 0]] = True
        new = np.flatnonzero(short & (row < 0))
        if len(self.hashes) + len(new) > WORDS and len(self.hashes):
            self._thin_out()
            row = np.where(short, self._find(hashes), -1)
            new = np.flatnonzero(short & (row < 0))
        if len(new):
            self._keep(hashes[new], [raw[a:b] for a, b in zip(at[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            row[new] = self._find(hashes[new])
        row, bounds, kept = row[word], self.bounds, self.kept
        long = np.flatnonzero(row < 0)
        if len(long):  # not known by hash
            words: dict[bytes, int] = {}
            row[long] = [len(self.again) + words.setdefault(raw[a:b], len(words)) for a, b in zip(at[long].tolist(), end[long].tolist(), strict=True)]
            n, ids = self._made(list(words))
            bounds, kept = np.append(bounds, bounds[-1] + np.cumsum(n)), np.append(kept, ids)
        n = bounds[row + 1] - bounds[row]
        before = np.append(0, np.cumsum(n))
        flat = kept[np.repeat(bounds[row] - before[:-1], n) + np.arange(before[-1])]
        n = np.diff(before[np.searchsorted(at, np.append(starts, len(data)))])
        return flat, n, self._gives_back(flat, n, texts)

    def _gives_back(self, flat: np.ndarray, n: np.ndarray, texts: list[str | None]) -> np.ndarray:
        """Whether the pieces of each text decode to its marked form."""
        want = [(MARK + t.replace(" ", MARK)).encode() if t else b"" for t in texts]
        size = self.size_of[flat]
        before, bounds = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(n)))
        got = self.bytes_of[np.repeat((np.cumsum(self.size_of) - self.size_of)[flat] - before[:-1], size) + np.arange(before[-1])].tobytes()
        ends = before[bounds].tolist()
        return np.array([got[a:b] == w for a, b, w in zip(ends[:-1], ends[1:], want, strict=True)], bool)

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        flat, n, _ = self.encode_batch(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] if len(texts) else []

    def _joined(self, ids: tuple[int, ...] | list[int]) -> str:
        """Pieces side by side; runs of byte pieces are read as UTF-8."""
        names, values = self.names, self.values
        if values.keys().isdisjoint(ids):
            return "".join(map(names.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            if i in values:
                run.append(values[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(names[i])
        out.append(run.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self._joined(ids).replace(MARK, " ").removeprefix(" ")


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    on_other_work("pieces", load.cache_clear)
    return Pieces(path)


def _encode(path: str, at: int):
    """Appends ids, n_tokens and round_trip to each batch; column at holds the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            flat, n, same = model.encode_batch(batch.column(at).to_pylist())
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            made = [pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(n, pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "ids", "n_tokens", "round_trip"])

    return run


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids, n_tokens and round_trip of its text column; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens", "round_trip")
    schema = docs.schema
    for name, kind in (("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("round_trip", T.BooleanType())):
        schema = T.StructType([*schema.fields, T.StructField(name, kind)])
    return docs.mapInArrow(giving_back(_encode(path, docs.columns.index("text")), "pieces"), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every row; path is the model's file."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return encode_column(docs, path).drop("text")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(…, ids) with the text that ids stand for, as column text; null ids give null."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop("text")
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
