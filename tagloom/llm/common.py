"""Helpers shared by the operators: table access, lineage cuts and vectorised hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tagloom.functions.storage import discard, materialize, shared_dir  # noqa: F401  the operators take them from here

# Arrow's own allocator keeps what it has freed; workers share an executor's memory
pa.set_memory_pool(pa.system_memory_pool())

#: Rows and bytes in one Arrow batch; a row of more bytes is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Bytes of text hashed at once by a worker.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Documents can be long, so Arrow batches hold few rows, and few bytes where rows are large.

    Both are limits of the session's, read when a result runs; they are lowered, never raised.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    now = spark.conf.get(size).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns what this worker has freed to the system: idle workers share an executor's memory with those at work."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own rules
        pass


#: What this worker keeps between tasks, by operator: ways to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def on_other_work(operator: str, drop: Callable[[], None]) -> None:
    """drop is called when this worker gets a task of another operator."""
    _KEPT[operator] = drop


def make_room(operator: str = "") -> None:
    """Drops what other operators keep in this worker, and gives the memory back."""
    others = [k for k in _KEPT if k != operator]
    for k in others:
        _KEPT.pop(k)()
    if others:
        give_back()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with what other operators keep dropped at its beginning, and freed memory given back at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(operator)
        yield from run(batches)
        give_back()

    return task


# --- vectorised hashing of UTF-8 text -------------------------------------------------

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BYTE[_SPACE] = 0
_BASE = 0x2545F4914F6CDD1D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, out = max(n, CHUNK_BYTES + 1), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _hash_words(data: np.ndarray, starts_at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts in data, and how many each text has."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts_at), np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inside = starts_at[starts_at < n]
    first[inside] = ~space[inside]
    at = np.flatnonzero(first)
    if len(at) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts_at), np.int64)
    powers, inverses = _powers(n)
    value = _BYTE[_LOWER[data] if lower else data]
    value *= powers[:n]
    words = np.add.reduceat(value, at)
    words *= inverses[at]
    bounds = np.searchsorted(at, np.append(starts_at, n))
    return mix64(words), np.diff(bounds)


def hashed_words(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (index of the first text, 64-bit word hashes, words of each text) for runs of consecutive texts.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A
    text longer than CHUNK_BYTES is hashed piece by piece, cut between words.
    """
    data, off = buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        if off[j] - off[i] <= CHUNK_BYTES:
            words, counts = _hash_words(data[off[i] : off[j]], off[i:j] - off[i], lower)
            yield i, words, counts
        else:
            pieces, a, end = [], int(off[i]), int(off[j])
            while a < end:
                b = min(end, a + CHUNK_BYTES)
                if b < end:
                    gaps = np.flatnonzero(_SPACE[data[a:b]])
                    if len(gaps):
                        b = a + int(gaps[-1]) + 1
                    else:
                        later = np.flatnonzero(_SPACE[data[b:end]])
                        b = b + int(later[0]) if len(later) else end
                pieces.append(_hash_words(data[a:b], np.zeros(1, np.int64), lower)[0])
                a = b
            words = np.concatenate(pieces)
            yield i, words, np.array([len(words)])
        i = j


#: Words in a shingle.
SHINGLE = 5
_STEP = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text: runs of 5 words; with 1 to 4 words, the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        total = _U(n)
        for k in range(n):
            total = total + words[k] * _STEP[k]
        return mix64(np.array([total], np.uint64))
    m = n - SHINGLE + 1
    s = words[:m] * _STEP[0]
    for k in range(1, SHINGLE):
        s += words[k : k + m] * _STEP[k]
    s = np.sort(mix64(s))
    keep = np.empty(m, bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of every text."""
    with np.errstate(over="ignore"):
        for first, words, counts in hashed_words(texts):
            a = 0
            for k, c in enumerate(counts.tolist()):
                yield first + k, shingle_set(words[a : a + c])
                a += c
