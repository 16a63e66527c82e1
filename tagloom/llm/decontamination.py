"""Benchmark decontamination: a broadcast set of normalised word windows of the benchmark, looked up at every place of every text.

An item's windows are its runs of 10 words; an item of 1 to 9 words is one window. Their
hashes are broadcast with their words and items. A task hashes all windows of its texts
at once, takes those whose hash is in the set, and compares the words themselves before
it counts a hit. A hit marks all its words; marked runs are the spans.

The set is broadcast in blocks: its rows (a window with one of its items) are dealt by
hash to as many blocks as keep each below BLOCK_ROWS, and the texts are read once for each
block, which adds to the spans and items that the blocks before have found. So what is
broadcast is bounded, however large the benchmark or however common a window is.

Defined cases: a null text has no words and stays null; a text without words is clean;
equal items give equal windows, and all their ids are listed; an item whose id is null
marks words but is neither counted nor listed; a null or repeated doc_id is a row of its
own; texts of any length are read whole; with an empty benchmark (or items without
words) nothing is hit; other columns of the documents are kept by decontaminate, whatever
their names, and ignored by contamination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, mix64, small_batches
from .terms import TERM, terms

#: Words in a window.
WINDOW = 10
#: Rows (window, item) of the set that are broadcast at once; each takes about 100 bytes.
BLOCK_ROWS = 500_000

_STEP = mix64(np.arange(11, 11 + WINDOW, dtype=np.uint64)) | np.uint64(1)
SCANNED = "spans array<int>, items array<string>, n_words long, n_hit long, cleaned string, at array<int>"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words) of the items' windows."""
    for batch in batches:
        items, words = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = TERM.findall((text or "").encode().lower())
            own = {b" ".join(w[i : i + WINDOW]).decode() for i in range(max(1, len(w) - WINDOW + 1))} if w else ()
            words += own
            items += [item] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(words, pa.string())], names=["item", "words"])


def _rolling(hashes: np.ndarray, upto: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of all windows of that length), from one word to upto."""
    total = hashes * _STEP[0]
    for n in range(1, upto + 1):
        if n > 1:
            if len(total) < 2:
                return
            total = total[:-1] + hashes[n - 1 :] * _STEP[n - 1]
        yield n, mix64(total + np.uint64(n))


class WindowSet:
    """Windows by hash, with their words and their items; a bitmap rules most places of a text out."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        by_words: dict[str, list[str]] = {}
        for item, words in rows:
            of = by_words.setdefault(words, [])
            if item is not None:
                of.append(item)
        self.words = [w.encode() for w in by_words]
        self.items = list(by_words.values())
        if by_words:
            found = next(iter(_windows_hashes(self.words)))
            order = np.argsort(found, kind="stable")
            self.hashes, self.order = found[order], order
        else:
            self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lengths = {w.count(b" ") + 1 for w in self.words}
        self.bits = max(16, min(24, int(8 * len(self.words)).bit_length()))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.hashes >> np.uint64(64 - self.bits)] = True

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(place, length, entries of the set with that hash) for windows of words that lie in one text."""
        shift = np.uint64(64 - self.bits)
        for n, h in _rolling(hashes, max(self.lengths, default=0)):
            if n not in self.lengths:
                continue
            at = np.flatnonzero(self.bitmap[h >> shift])
            at = at[at + n <= bounds[np.searchsorted(bounds, at, "right")]]
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            for k in np.flatnonzero(hi > lo).tolist():
                yield int(at[k]), n, self.order[lo[k] : hi[k]].tolist()


def _windows_hashes(windows: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of whole windows, as _rolling has them."""
    out = np.zeros(len(windows), np.uint64)
    with np.errstate(over="ignore"):
        for t in terms(pa.array([w.decode() for w in windows], pa.string())):
            n = np.diff(t.bounds)
            for size in np.unique(n).tolist():
                of = np.flatnonzero(n == size)
                total = np.zeros(len(of), np.uint64)
                for k in range(size):
                    total = total + t.hashes[t.bounds[of] + k] * _STEP[k]
                out[t.first + of] = mix64(total + np.uint64(size))
    yield out


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted spans that neither overlap nor touch, flat."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scan(sent, last: bool):
    """Adds the hits of one block of the set to spans (word numbers) and items; the last block also cuts the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = sent.value
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            spans = [list(zip(s[::2], s[1::2], strict=True)) for s in batch.column(names.index("spans")).to_pylist()]
            items = [set(x) for x in batch.column(names.index("items")).to_pylist()]
            n_words, cleaned, places = [0] * len(spans), texts.to_pylist() if last else [None] * len(spans), [[] for _ in spans]
            for t in terms(texts):
                for at, n, entries in windows.find(t.hashes, t.bounds):
                    raw = b" ".join(TERM.findall(t.data[t.at[at] : t.end[at + n - 1]].tobytes().lower()))
                    k = int(np.searchsorted(t.bounds, at, "right")) - 1
                    for e in entries:
                        if windows.words[e] == raw:
                            spans[t.first + k].append((at - int(t.bounds[k]), at - int(t.bounds[k]) + n))
                            items[t.first + k].update(windows.items[e])
                for k, (a, b) in enumerate(zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True)):
                    n_words[t.first + k] = b - a
                    if last and spans[t.first + k]:
                        own = _merged(spans[t.first + k])
                        cut = [(int(t.at[a + x]), int(t.end[a + y - 1])) for x, y in zip(own[::2], own[1::2], strict=True)]
                        cleaned[t.first + k], places[t.first + k] = _cut(cleaned[t.first + k], cut, int(t.at[a]), t.data)
            flat = [_merged(s) for s in spans]
            n_hit = [sum(s[1::2]) - sum(s[::2]) for s in flat]
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(names.index(n)) for n in ("row", "text")], pa.array(flat, numbers), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(cleaned, pa.string()), pa.array(places, numbers)],
                names=["row", "text", "spans", "items", "n_words", "n_hit", "cleaned", "at"],
            )

    return run


def _cut(text: str, spans: list[tuple[int, int]], first: int, data: np.ndarray) -> tuple[str, list[int]]:
    """The text without byte spans of data, and the spans in characters; first is where the text's first word begins in data."""
    raw = text.encode()
    base = first - TERM.search(raw.lower()).start()
    out, places, at, chars = [], [], 0, 0
    for a, b in spans:
        a, b = a - base, b - base
        before, inside = raw[at:a].decode(), raw[a:b].decode()
        out.append(before)
        places += [chars + len(before), chars + len(before) + len(inside)]
        at, chars = b, places[-1]
    return "".join(out) + raw[at:].decode(), places


def _scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(row, text) with spans in words and in characters, items, n_words and the text without its spans."""
    spark = docs.sparkSession
    small_batches(spark)
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    rows = materialize(own.mapInArrow(_windows, "item string, words string").distinct(), "windows")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    kind = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(SCANNED).fields])
    out = docs.withColumn("spans", F.array().cast("array<int>")).withColumn("items", F.array().cast("array<string>"))
    for k in range(blocks):
        sent = spark.sparkContext.broadcast(WindowSet([(r["item"], r["words"]) for r in rows.where(part == k).collect()]))
        before, out = out, out.mapInArrow(_scan(sent, k == blocks - 1), kind)
        if k < blocks - 1:
            out = materialize(out.select(*docs.columns, "spans", "items"), "scanned")
            if k:
                discard(before)
    discard(rows)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and places (beginning and end of hit runs in characters) of every row."""
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.col("text").cast("string").alias("text"))
    got = _scanned(rows, benchmark)
    at = F.when(F.size("at") > 0, F.transform(F.sequence(F.lit(1), F.size("at"), F.lit(2)), lambda i: F.struct(F.element_at("at", i).alias("start"), F.element_at("at", i + 1).alias("end"))))
    return got.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "items",
        F.coalesce(at, F.array().cast("array<struct<start:int,end:int>>")).alias("places"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans") -> DataFrame:
    """docs without the spans of its texts that the benchmark holds, or without the documents that have any."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    got = _scanned(docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), benchmark)
    if remove == "documents":
        return got.where(F.size("spans") == 0).select("row.*")
    return got.select(*[F.col("cleaned").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])

