"""Cross-tokenizer alignment with corpus-wide pair counts by external spill counting.

Both tokenizers cut a text's UTF-8 bytes. Where a token of each ends at the same byte, the
two are linked, and such places cut the tokens into groups. How often a pair of ids is
linked in the whole corpus comes back to every document that has it.

Encoding: texts are cut before every space between two characters that are not white
space, which no token of either vocabulary spans, so what lies between two cuts (a chunk)
is encoded and aligned on its own, and both tokens end at its end. A worker keeps the
alignment of short chunks as arrays, found by the chunk's 64-bit hash; only chunks that
are not there go through the libraries.

Counting: a task turns its links into runs of at most RUN_LINKS records
(pair, document, times), sorted side by side (ids of B, then of A) and radix-partitioned
by the low bits of the B id. A run's part is stored as zstd frames. Parts are cut into
slices of whole runs, so that a frequent id's records are shared between tasks. A slice
counts its pairs by a k-way merge: a heap holds each run's next pair, frames are
unpacked one a run at a time. The slices' counts are added up pair by pair; in side-major
order an id's pairs lie together, and the highest count is marked. With these totals the
slices are read again, frame by frame, and each run's documents get their sums back.

Defined cases: a null or empty text has no tokens; neither has a text whose joined tokens
of either side differ from its bytes behind a space (such as one that holds U+2581); its
links count nowhere. A text of any length is encoded piece by piece, its links may lie in
several runs. A null or repeated doc_id is a row of its own; equal texts count each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, BATCH_ROWS, _powers, materialize, mix64, small_batches

#: Bytes of text that are cut and looked up at once.
PIECE = 2 << 20
#: Chunks (some 100 bytes each) that a worker keeps, and the bytes of the longest it takes.
KEPT, KEPT_BYTES = 900_000, 64
#: Links in a run, records in a frame, parts by B id, and bytes of frames in a slice of a part.
RUN_LINKS, FRAME, PARTS, SLICE_BYTES = 2_000_000, 200_000, 16, 8 << 20

MARK = "▁"
_RADIX = PARTS.bit_length() - 1
#: Documents of a run at most: with a packed pair (44 bits) their numbers make one 63-bit record.
_DOC_BITS = 19
RUN_DOCS = 1 << _DOC_BITS
ENCODED = "part int, key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, run long, seq int, pairs int, frame binary"

_CHUNK_BYTE = mix64(np.arange(301, 557, dtype=np.uint64))


# --- cutting ---------------------------------------------------------------------------


def _white_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends in front of at is white space (control characters count as white)."""
    last, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    return _white(third, second, last)


def _white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the last of these bytes ends a white-space character."""
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & ((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return (c <= 0x20) | (c == 0x7F) | (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | three


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin: at starts and at every space between two characters that are not white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    n = len(data) - 1
    one, two, three = data[at + 1], data[np.minimum(at + 2, n)], data[np.minimum(at + 3, n)]
    none = np.zeros(len(at), np.uint8)
    ahead = (one <= 0x20) | (one == 0x7F) | (one == 0xC2) & _white(none, one, two) | (one >= 0xE1) & (one <= 0xE3) & _white(one, two, three)
    return np.union1d(starts, at[~ahead & ~_white_before(data, at)])


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text of many bytes in parts of about PIECE, cut where chunks are."""
    data, at = np.frombuffer(raw, np.uint8), 0
    while len(raw) - at > PIECE:
        to, near = at + PIECE, 1 << 16
        while to < len(raw):
            found = cuts(data[to - 4 : to + near], np.zeros(0, np.int64))
            found = found[(found >= 4) & (found < near)]
            if len(found) or to + near >= len(raw):
                break
            to += near - 4
        if to >= len(raw) or not len(found):
            break
        yield raw[at : to - 4 + int(found[0])]
        at = to - 4 + int(found[0])
    yield raw[at:]


# --- encoding --------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _load(path_a: str, path_b: str):
    """Both tokenizers, and the bytes of their tokens by id."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    # the printable characters that stand for bytes in a byte-level vocabulary
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    bytes_a = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any(MARK in n.lstrip(MARK) for n in names):
        raise ValueError("texts are cut at spaces, which a piece of this model crosses")
    bytes_b = [bytes([int(n[3:-1], 16)]) if b.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
    return a, bytes_a, b, bytes_b


class Aligner:
    """Alignments of chunks: ids, common ends and groups, kept by hash."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.bytes_a, self.b, self.bytes_b = _load(path_a, path_b)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, and whether the bytes agree
        self.bounds, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.groups = pa.array([], pa.large_binary())

    def align(self, chunks: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
        """Counts, links (part, B id, A id packed in one number) and groups of chunks, each beginning with a space."""
        texts = [c.decode() for c in chunks]
        found_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        found_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        counts, links, groups = np.zeros((len(chunks), 4), np.int64), [], []
        size_a, size_b = self.bytes_a, self.bytes_b
        for k, (raw, x, y) in enumerate(zip(chunks, found_a, found_b, strict=True)):
            parts_a, parts_b = [size_a[i] for i in x], [size_b[i] for i in y]
            if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
                links.append(np.zeros(0, np.int64))
                groups.append(b"")
                continue
            own, said, i, j, ends_a, ends_b = [], [], 0, 0, 0, 0
            from_a = from_b = 0
            while i < len(x):
                # the side that is behind takes its next token; where both end, a group ends
                if ends_a <= ends_b:
                    ends_a += len(parts_a[i])
                    i += 1
                while ends_b < ends_a:
                    ends_b += len(parts_b[j])
                    j += 1
                if ends_a == ends_b:
                    own.append(_packed(x[i - 1], y[j - 1]))
                    said.append(",".join(map(str, x[from_a:i])) + "|" + ",".join(map(str, y[from_b:j])))
                    from_a, from_b = i, j
            counts[k] = len(x), len(y), len(own), 1
            links.append(np.array(own, np.int64))
            groups.append(";".join(said).encode())
        return counts, links, groups

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Keeps the alignments of chunks that are not there yet."""
        counts, links, groups = self.align(chunks)
        first = len(self.counts)
        self.counts = np.concatenate([self.counts, counts])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in links])])
        self.links = np.concatenate([self.links, *links])
        self.groups = pa.concat_arrays([self.groups, pa.array(groups, pa.large_binary())])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.row = np.insert(self.hashes, at, hashes[order]), np.insert(self.row, at, first + order)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of chunks, -1 for those that are not there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.row[at], -1)

    def read(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Counts, bounds of links, links, and groups of the chunks that begin at these places of data."""
        end = np.append(at[1:], len(data))
        size = end - at
        powers, inverses = _powers(len(data))
        with np.errstate(over="ignore"):
            value = _CHUNK_BYTE[data]
            value *= powers[: len(data)]
            hashes = mix64(np.add.reduceat(value, at) * inverses[at] + size.astype(np.uint64) * _BYTE[1])
        row, short = self.find(hashes), size <= KEPT_BYTES
        new = np.flatnonzero((row < 0) & short)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            if len(self.hashes) + len(distinct) > KEPT and len(self.hashes):
                self.clear()
                return self.read(data, at)
            self.learn(distinct, [data[at[k] : end[k]].tobytes() for k in new[first].tolist()])
            row[new] = self.find(hashes[new])
        long = np.flatnonzero(~short)
        counts, bounds, links, groups = self.counts, self.bounds, self.links, self.groups
        if len(long):
            more, own, said = self.align([data[at[k] : end[k]].tobytes() for k in long.tolist()])
            row[long] = len(counts) + np.arange(len(long))
            bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(x) for x in own])])
            counts, links, groups = np.concatenate([counts, more]), np.concatenate([links, *own]), pa.concat_arrays([groups, pa.array(said, pa.large_binary())])
        n = bounds[row + 1] - bounds[row]
        to = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(bounds[row] - to[:-1], n) + np.arange(to[-1])
        return counts[row], to, links[place], groups.take(pa.array(row))


@lru_cache(maxsize=2)
def _worker(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _packed(a: int, b: int) -> int:
    return (b & (PARTS - 1)) << 40 | (b >> _RADIX) << 20 | a


def ids_of(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of A and of B of packed pairs."""
    return pairs & 0xFFFFF, (pairs >> 20 & 0xFFFFF) << _RADIX | pairs >> 40


# --- runs ------------------------------------------------------------------------------


def _frames(pairs: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(part, pairs, frame) of a run's links: sorted records, packed frame by frame; a pair's records may go on in the next frame."""
    record = np.sort(pairs << _DOC_BITS | docs)
    at = np.flatnonzero(np.diff(record, prepend=-1))
    times, record = np.diff(np.append(at, len(record))), record[at]
    pairs, docs = record >> _DOC_BITS, record & RUN_DOCS - 1
    edges = np.searchsorted(pairs, np.arange(PARTS + 1, dtype=np.int64) << 40)
    for part in range(PARTS):
        for a in range(int(edges[part]), int(edges[part + 1]), FRAME):
            b = min(a + FRAME, int(edges[part + 1]))
            own, first = np.unique(pairs[a:b], return_index=True)
            held = np.diff(np.append(first, b - a))
            step = np.diff(docs[a:b], prepend=0)
            step[first] = docs[a:b][first]
            columns = (np.diff(own & (1 << 40) - 1, prepend=0), held, step, times[a:b])
            raw = np.array([len(own), b - a], np.int64).tobytes() + b"".join(c.astype(np.uint32 if k else np.int64).tobytes() for k, c in enumerate(columns))
            yield part, len(own), len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(part: int, frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, records of each, and documents (numbers in the run) and times of the records."""
    raw = pa.decompress(frame[8:], int.from_bytes(frame[:8], "little"), codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2)
    pairs = np.cumsum(np.frombuffer(raw, np.int64, n, 16)) | part << 40
    held, step, times = (np.frombuffer(raw, np.uint32, k, 16 + 8 * n + 4 * at) for k, at in ((n, 0), (m, n), (m, n + m)))
    first = np.concatenate(([0], np.cumsum(held[:-1], dtype=np.int64)))
    total = np.cumsum(step, dtype=np.int64)
    docs = total - np.repeat(total[first] - step[first], held)
    return pairs, held.astype(np.int64), docs, times.astype(np.int64)


def _encode(path_a: str, path_b: str):
    """Rows of documents (part -1), and frames of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker(path_a, path_b)
        base = TaskContext.get().partitionId() << 33
        first, n_docs, n_runs = 0, 0, 0  # of the run: the number of its first document; documents and runs so far
        links: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush(to: int) -> Iterator[pa.RecordBatch]:
            """Ends the run; the next one begins with document number to."""
            nonlocal first, held, n_runs
            if held:
                pairs, docs = (np.concatenate(x) for x in zip(*links, strict=True))
                for seq, (part, n, frame) in enumerate(_frames(pairs, docs - first)):
                    yield _row(part=part, key=base + first, run=base + n_runs, seq=seq, pairs=n, frame=frame)
                n_runs += 1
            links.clear()
            first, held = to, 0

        for batch in batches:
            rows = []
            for parts in _groups(batch.column(1).to_pylist()):
                if len(parts) == 1 and len(parts[0]) > PIECE:
                    row, own = _long(aligner, parts[0])
                    for pairs in own:
                        links.append((pairs, np.full(len(pairs), n_docs)))
                        held += len(pairs)
                        if held >= RUN_LINKS:
                            yield from flush(n_docs)
                    rows.append(row)
                    n_docs += 1
                    continue
                data = np.frombuffer(b"".join(parts), np.uint8)
                size = np.array([len(p) for p in parts])
                starts = (np.cumsum(size) - size)[size > 0]
                at = cuts(data, starts) if len(data) else np.zeros(0, np.int64)
                if len(at):
                    counts, to, found, groups = aligner.read(data, at)
                    bounds = np.append(np.searchsorted(at, starts), len(at))
                    sums = np.add.reduceat(counts, bounds[:-1])
                    whole = np.minimum.reduceat(counts[:, 3], bounds[:-1])
                    said = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), groups), pa.scalar(b";", pa.large_binary())).to_pylist()
                k = 0
                for n in size.tolist():
                    row = (0, 0, 0, "")
                    if n:
                        if whole[k]:
                            a, b = int(to[bounds[k]]), int(to[bounds[k + 1]])
                            links.append((found[a:b], np.full(b - a, n_docs)))
                            held += b - a
                            row = (*sums[k, :3].tolist(), hashlib.sha256(said[k]).hexdigest())
                        k += 1
                    rows.append(row)
                    n_docs += 1
                if held >= RUN_LINKS or n_docs - first >= RUN_DOCS - BATCH_ROWS:
                    yield from flush(n_docs)
            if rows:
                n = len(rows)
                a, b, groups, sha = zip(*rows, strict=True)
                yield _row(
                    n=n, part=pa.array([-1] * n, pa.int32()), key=pa.array(np.arange(base + n_docs - n, base + n_docs)), doc_id=batch.column(0),
                    n_a=pa.array(a, pa.int64()), n_b=pa.array(b, pa.int64()), n_groups=pa.array(groups, pa.int64()), n_links=pa.array(groups, pa.int64()), groups_sha256=pa.array(sha, pa.string()),
                )
        yield from flush(n_docs)

    return run


def _groups(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Consecutive texts behind a space, of about PIECE bytes together; a longer one is alone, null and empty ones have no bytes."""
    group, size = [], 0
    for text in texts:
        raw = b" " + text.encode() if text else b""
        if group and size + len(raw) > PIECE:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield group


def _long(aligner: Aligner, raw: bytes) -> tuple[tuple[int, int, int, str], Iterator[np.ndarray]]:
    """The row of a long text, and its links piece by piece: read once to see whether it is whole, and again for the links."""
    total, sha, whole, first = np.zeros(3, np.int64), hashlib.sha256(), True, True
    for piece in _pieces(raw):
        data = np.frombuffer(piece, np.uint8)
        counts, _, _, groups = aligner.read(data, cuts(data, np.zeros(1, np.int64)))
        whole &= bool(counts[:, 3].all())
        total += counts[:, :3].sum(0)
        for said in groups.to_pylist():
            sha.update(said if first else b";" + said)
            first = False

    def links() -> Iterator[np.ndarray]:
        for piece in _pieces(raw):
            data = np.frombuffer(piece, np.uint8)
            yield aligner.read(data, cuts(data, np.zeros(1, np.int64)))[2]

    return ((*total.tolist(), sha.hexdigest()), links()) if whole else ((0, 0, 0, ""), iter(()))


_TYPES = {"part": pa.int32(), "seq": pa.int32(), "pairs": pa.int32(), "groups_sha256": pa.string(), "frame": pa.binary()}


def _row(n: int = 1, **columns) -> pa.RecordBatch:
    """A batch of n rows with these columns, null in the others."""
    names = [c.split()[0] for c in ENCODED.split(", ")]
    kinds = [_TYPES.get(c, pa.int64()) for c in names]
    given = [columns.get(c) for c in names]
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else x.cast(t) if isinstance(x, pa.Array) else pa.array([x], t) for x, t in zip(given, kinds, strict=True)], names=names)


# --- counting --------------------------------------------------------------------------


def _runs(table: pa.Table) -> tuple[int, dict[int, list[bytes]], dict[int, int]]:
    """The part of a slice, its runs' frames in order, and the keys of the runs' first documents."""
    rows = sorted(zip(table["run"].to_pylist(), table["seq"].to_pylist(), range(len(table)), strict=True))
    part, keys, frames = table["part"][0].as_py(), table["key"].to_pylist(), table["frame"]
    runs: dict[int, list[bytes]] = {}
    for run, _, k in rows:
        runs.setdefault(run, []).append(frames[k].as_py())
    return part, runs, {run: keys[k] for run, _, k in rows}


def _pair_counts(part: int, frames: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, links) of one run in order; a pair that two frames share comes twice."""
    for frame in frames:
        pairs, held, _, times = unpacked(part, frame)
        yield from zip(pairs.tolist(), np.add.reduceat(times, np.cumsum(held) - held).tolist(), strict=True)


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """Counts of a slice's pairs, by a heap over its runs."""
    part, runs, _ = _runs(table)
    pairs, counts, now, total = [], [], None, 0
    for pair, n in heapq.merge(*[_pair_counts(part, f) for f in runs.values()]):
        if pair != now:
            if now is not None:
                pairs.append(now)
                counts.append(total)
            now, total = pair, 0
        total += n
    pairs.append(now)
    counts.append(total)
    return pa.table({"pair": pa.array(pairs, pa.int64()), "n": pa.array(counts, pa.int64())})


def _back(key: tuple, frames: pa.Table, totals: pa.Table) -> pa.Table:
    """(key, n_best, count_sum): what the slice's links add to each document."""
    found = []
    if len(frames):
        part, runs, keys = _runs(frames)
        pair = totals["pair"].to_numpy()
        order = np.argsort(pair)
        pair, n, best = pair[order], totals["n"].to_numpy()[order], totals["best"].to_numpy()[order]
        for run, own in runs.items():
            gathered = []
            for frame in own:
                pairs, held, docs, times = unpacked(part, frame)
                at = np.searchsorted(pair, pairs).repeat(held)
                added = np.zeros((3, int(docs.max()) + 1), np.int64)
                added[2, docs] = 1
                np.add.at(added[0], docs, times * best[at])
                np.add.at(added[1], docs, times * n[at])
                doc = np.flatnonzero(added[2])
                gathered.append((doc + keys[run], *added[:2, doc]))
            doc, a, b = (np.concatenate(x) for x in zip(*gathered, strict=True))
            found.append(pa.table({"key": doc, "n_best": a, "count_sum": b}))
    return pa.concat_tables(found) if found else pa.table({c: pa.array([], pa.int64()) for c in ("key", "n_best", "count_sum")})


class Alignment:
    """documents: doc_id and the columns of its alignment. pairs: a_id, b_id, n, best of the whole corpus."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str):
        small_batches(docs.sparkSession)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        encoded = materialize(rows.mapInArrow(_encode(path_a, path_b), ENCODED), "aligned")
        sizes = encoded.where("part >= 0").groupBy("part").agg(F.sum(F.length("frame")).alias("n")).collect()
        slices = {r["part"]: -(-r["n"] // SLICE_BYTES) for r in sizes}
        of = F.element_at(F.create_map(*[F.lit(x) for p in range(PARTS) for x in (p, int(slices.get(p, 1)))]), F.col("part"))
        frames = encoded.where("part >= 0").select("part", F.pmod(F.xxhash64("run"), of).cast("int").alias("slice"), "key", "run", "seq", "frame")
        counts = frames.groupBy("part", "slice").applyInArrow(_merged, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        totals = materialize(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 20)))), "pairs")
        part = F.shiftright("pair", 40).cast("int")
        dealt = totals.withColumn("part", part).withColumn("slice", F.explode(F.sequence(F.lit(0), of - 1))).withColumn("slice", F.col("slice").cast("int"))
        back = frames.groupBy("part", "slice").cogroup(dealt.groupBy("part", "slice")).applyInArrow(_back, "key long, n_best long, count_sum long")
        sums = back.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        own = encoded.where("part = -1").select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        self.documents = own.join(sums, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
        low = (1 << 20) - 1
        b_id = F.shiftleft(F.shiftright("pair", 20).bitwiseAND(low), _RADIX).bitwiseOR(F.shiftright("pair", 40))
        self.pairs = totals.select(F.col("pair").bitwiseAND(low).cast("int").alias("a_id"), b_id.cast("int").alias("b_id"), "n", "best")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    return Alignment(docs, path_a, path_b).documents
