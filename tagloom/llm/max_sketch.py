"""Ranked lexical search by max-sketches: upper bounds for all documents, exact scores only while they can matter.

A document's index row holds its number of terms, a sketch, and its distinct terms with
their counts. Under the score of this module (a term's weight times a part that rises
with its count tf and falls with the document's length) the largest impact among the
terms that share a sketch coordinate is that of the largest tf, whatever the corpus
statistics turn out to be. So the sketch keeps the coordinatewise maximum of tf over
hashed terms, one byte each (255: 255 or more), and becomes impacts when N and L are
known.

A search reads the index. One pass sums N, L and the documents of each query term. The
next takes the rows in batches: the impacts of the sketch coordinates that the queries
touch, times the queries' weights at these coordinates, are upper bounds of all scores by
one matrix product. Then, query by query, documents are scored exactly from their terms
by falling bound, until the next bound is below the k-th best score found so far; the
best are carried from batch to batch inside a task, so later batches stop earlier. Tasks
hand on k rows a query at most, and those meet in a ranking.

What is broadcast is a block of queries: BLOCK_TERMS distinct (query, term) and
BLOCK_QUERIES queries in the mean at most; further blocks are searched one after the other over the same index. Terms are
known by 64-bit hashes.

Defined cases: a null text or one without terms has no part in N and is never found; a
query without terms, or without a document of positive score, has no row; rows with
equal query ids are one query (their terms are added up, null is an id of its own); a
null or repeated doc_id is a row of its own, null after the others in ties; texts of any
length are counted whole; an empty table of either kind gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches
from .terms import terms

#: Coordinates of a sketch.
COORDINATES = 2048
#: Distinct (query, term), and queries, of a block; a query takes 16 KB in the matrix of weights.
BLOCK_TERMS, BLOCK_QUERIES = 50_000, 2_000
#: Documents scored exactly at once for a query.
CHUNK = 32

# fixed values: constants of the score
_SCALE, _TF, _LENGTH = 1_000_000_000, 1000, 8
_MEAN, _SHARE = 25, 75

INDEX = "doc_id long, n long, sketch binary, terms binary, tfs binary"


def _sorted_terms(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each occurs."""
    h = np.sort(hashes)
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h)))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in terms(batch.column(1)):
            bounds, n = t.bounds, np.diff(t.bounds)
            held = np.flatnonzero(n).tolist()
            sketches, of, counts = [], [], []
            for k in held:
                h, tf = _sorted_terms(t.hashes[bounds[k] : bounds[k + 1]])
                sketch = np.zeros(COORDINATES, np.uint8)
                at = (h & np.uint64(COORDINATES - 1)).astype(np.int64)
                sketch[at] = 1
                more = np.flatnonzero(tf > 1)
                more = more[np.argsort(tf[more], kind="stable")]  # of equal coordinates the last, so the largest, stays
                sketch[at[more]] = np.minimum(tf[more], 255)
                sketches.append(sketch.tobytes())
                of.append(h.tobytes())
                counts.append(tf.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.array(held, np.int64) + t.first)), pa.array(n[held]), *[pa.array(x, pa.binary()) for x in (sketches, of, counts)]],
                names=["doc_id", "n", "sketch", "terms", "tfs"],
            )


def index(docs: DataFrame) -> DataFrame:
    """The index of docs(doc_id, text), written to the shared folder; rows without terms have no part in it."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_index, INDEX), "sketches", "zstd")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in terms(batch.column(1)):
            for k in range(len(t.bounds) - 1):
                h, c = _sorted_terms(t.hashes[t.bounds[k] : t.bounds[k + 1]])
                ids = batch.column(0).slice(t.first + k, 1).to_pylist() * len(h)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["item_id", "term", "c"])


def _blob(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column end to end, and how many each row has."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    size = np.dtype(kind).itemsize
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), np.diff(off).astype(np.int64) // size


class Queries:
    """A block of queries: distinct terms, and each query's terms with their weights as runs of one array."""

    def __init__(self, ids: list[int | None], query: np.ndarray, term: np.ndarray, times: np.ndarray):
        """query (numbers of ids, ascending), term (hashes) and times are parallel."""
        self.ids = ids
        self.vocabulary = np.unique(term)
        self.of = np.searchsorted(self.vocabulary, term)
        self.query, self.times = query, times
        self.bounds = np.searchsorted(query, np.arange(len(ids) + 1))

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        """Weights under the corpus statistics, and the queries' weights by sketch coordinate."""
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = w[self.of] * self.times
        at = (self.vocabulary & np.uint64(COORDINATES - 1)).astype(np.int64)
        self.coordinates, place = np.unique(at, return_inverse=True)
        self.at_coordinates = np.zeros((len(self.coordinates), len(self.ids)))
        np.add.at(self.at_coordinates, (place[self.of], self.query), self.weight)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are in the vocabulary, and their numbers there."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == hashes)
        return known, at[known]


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms."""
    if len(n) and _SHARE * int(n.max()) * n_docs >= 1 << 63:
        return np.array([_MEAN + _SHARE * int(x) * n_docs // n_terms for x in n], np.int64)
    return _MEAN + _SHARE * n * n_docs // n_terms


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _SCALE * tf // (_TF * tf + _LENGTH * m)


def _statistics(sent):
    """(term number, df) of one task, with -1 for documents and -2 for terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = sent.value
        df, docs, total = np.zeros(len(q.vocabulary), np.int64), 0, 0
        for batch in batches:
            hashes, _ = _blob(batch.column(1), np.uint64)
            df += np.bincount(q.look_up(hashes)[1], minlength=len(df))
            n = batch.column(0).to_numpy()
            docs, total = docs + len(n), total + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, total]))], names=["k", "n"])

    return run


class _Best:
    """The k best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(queries)]
        self.least = np.zeros(queries, np.int64)  # documents below it are out

    def add(self, q: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in zip(self.rows[q], (score, doc, null), strict=True))
        keep = np.lexsort((doc, null, -score))[: self.k]
        keep = keep[score[keep] > 0]
        self.rows[q] = score[keep], doc[keep], null[keep]
        if len(keep) == self.k:
            self.least[q] = self.rows[q][0][-1]


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = sent.value
        best = _Best(len(q.ids), k)
        wide = len(q.vocabulary)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            docs = batch.column(0).fill_null(0).to_numpy()
            m = _lengths(batch.column(1).to_numpy(), q.n_docs, q.n_terms)
            sketch = _blob(batch.column(2), np.uint8)[0].reshape(rows, COORDINATES)[:, q.coordinates]
            impacts = _part(sketch.astype(np.int64), m[:, None])
            impacts[sketch == 255] = _SCALE // _TF
            bounds = impacts.astype(np.float64) @ q.at_coordinates
            bounds *= 1 + 1e-9  # sums beyond 2**53 are rounded
            # counts of the queries' terms, by (document, term)
            hashes, per = _blob(batch.column(3), np.uint64)
            known, number = q.look_up(hashes)
            tfs = _blob(batch.column(4), np.int32)[0][known].astype(np.int64)
            cell = np.arange(rows).repeat(per)[known] * wide + number
            for i in range(len(q.ids)):
                bound = bounds[:, i]
                live = np.flatnonzero((bound >= best.least[i]) & (bound > 0))
                if not len(live):
                    continue
                live = live[np.argsort(-bound[live], kind="stable")]
                of, weight = q.of[q.bounds[i] : q.bounds[i + 1]], q.weight[q.bounds[i] : q.bounds[i + 1]]
                for a in range(0, len(live), CHUNK):
                    d = live[a : a + CHUNK]
                    if bound[d[0]] < best.least[i]:
                        break
                    want = d[:, None] * wide + of
                    at = np.minimum(np.searchsorted(cell, want), len(cell) - 1)
                    tf = np.where(cell[at] == want, tfs[at], 0) if len(cell) else np.zeros(want.shape, np.int64)
                    best.add(i, (_part(tf, m[d][:, None]) * weight).sum(1), docs[d], null[d])
        out = [(i, *best.rows[i]) for i in range(len(q.ids)) if len(best.rows[i][0])]
        for i, score, doc, none in out:
            yield pa.RecordBatch.from_arrays([pa.array([q.ids[i]] * len(score), pa.int64()), pa.array(doc, mask=none), pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def search(indexed: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for each of queries(item_id, text)."""
    spark = indexed.sparkSession
    small_batches(spark)
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = materialize(rows.mapInArrow(_query_terms, "item_id long, term long, c long").groupBy("item_id", "term").agg(F.sum("c").alias("c")), "asked")
    size = asked.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("queries")).first()
    blocks = max(1, -(-size["n"] // BLOCK_TERMS), -(-size["queries"] // BLOCK_QUERIES))
    found = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()
        if own.empty:
            continue
        own["null"], own["item_id"] = own["item_id"].isna(), own["item_id"].fillna(0).astype("int64")
        own = own.sort_values(["null", "item_id"], kind="stable")
        new = own[["null", "item_id"]].ne(own[["null", "item_id"]].shift()).any(axis=1).to_numpy()
        number = np.cumsum(new) - 1
        ids = [None if z else int(x) for x, z in zip(own["item_id"][new], own["null"][new], strict=True)]
        q = Queries(ids, number, own["term"].to_numpy(np.int64).view(np.uint64), own["c"].to_numpy(np.int64))
        sent = spark.sparkContext.broadcast(q)
        got = indexed.select("n", "terms").mapInArrow(_statistics(sent), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        sums = {r["k"]: r["n"] for r in got}
        if not sums.get(-1):
            break
        q.weigh(sums[-1], sums[-2], np.array([sums.get(i, 0) for i in range(len(q.vocabulary))]))
        found.append(indexed.mapInArrow(_search(spark.sparkContext.broadcast(q), k), "item_id long, doc_id long, score long"))
    discard(asked)
    every = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for df in found:
        every = every.unionByName(df)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """search over the index of docs."""
    return search(index(docs), queries, k)
