"""Exact top-k inner-product search with vector-approximation files.

Vectors become integers, floor(1024 x). They are packed into blocks; a block holds its
vectors' cells (one byte a component, even cells between the block's extremes) apart
from the exact values, as columns of a Parquet table in the shared folder. Queries are
packed into blocks too, and every block of cells meets every block of queries.

Scan: cells alone bound each score from both sides. The k best lower bounds of a query
over all blocks give it a threshold. Visit: in each block, vectors whose upper bound
reaches the threshold are read exactly in the order of their bounds, until the k-th
result is at least every bound that is left. The k best of each block are merged.

Blocks of queries are broadcast while all of them are at most BROADCAST_BYTES, and
joined by shuffle on their number beyond; the blocks of vectors never are.

Defined cases: a vector that is null, or holds a null, a value that is not finite or
one beyond long, takes no part; vectors meet only vectors of as many components; rows
with the query's own vec_id are no candidates, other rows with equal vec_id count each;
a query vec_id that repeats is asked once, with its smallest vector; scores are exact,
clamped to the range of long; ties go to the smaller vec_id; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Fixed point: components are floor(SCALE * x).
SCALE = 1024
#: Vectors in a block, and queries in a block.
BLOCK, QUERIES = 4096, 1024
CELLS = 256
#: Bytes of query blocks up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
_EXACT = 2**52


def integers(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < 2.0**62))
    return embedding.isNotNull() & fine


def _pack(size: int):
    """Rows (vec_id, v) to blocks of equal dimension: ids, exact values, and cells with their origin and width."""

    def block(dim: int, ids: list[int], rows: list[list[int]]) -> dict:
        v = np.array(rows, np.int64).reshape(len(ids), dim)
        low = v.min(0)
        width = np.maximum(1, -((low - v.max(0) - 1) // CELLS))
        cells = ((v - low) // width).astype(np.uint8)
        return {"dim": dim, "ids": np.array(ids, np.int64).tobytes(), "exact": v.tobytes(), "cells": cells.tobytes(), "low": low.tobytes(), "width": width.astype(np.int64).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        schema = pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "exact", "cells", "low", "width"))])
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield pa.RecordBatch.from_pylist([block(len(v), ids, rows)], schema)
                    del held[len(v)]
        for dim, (ids, rows) in held.items():
            yield pa.RecordBatch.from_pylist([block(dim, ids, rows)], schema)

    return run


_BLOCKS = "dim int, ids binary, exact binary, cells binary, low binary, width binary"


def _ints(raw: bytes, dim: int | None = None) -> np.ndarray:
    v = np.frombuffer(raw, np.int64)
    return v if dim is None else v.reshape(-1, dim) if dim else v.reshape(0, 0)


def _middles(q: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Middle of each score's bounds, and half their distance: one number a query, as cells are even."""
    dim = row["dim"]
    low, width = _ints(row["low"]).astype(float), _ints(row["width"]).astype(float)
    n = len(row["ids"]) // 8
    cells = np.frombuffer(row["cells"], np.uint8).reshape(n, dim).astype(float)
    qf = q.astype(float)
    middle = (qf * width) @ cells.T + (qf @ (low + (width - 1) / 2))[:, None]
    radius = np.abs(qf) @ ((width - 1) / 2)
    return middle, radius * (1 + 1e-9) + 1e-9 * np.abs(middle).max(1, initial=0)


def _queries(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = _ints(row["q_ids"])
    return ids, np.frombuffer(row["q_exact"], np.int64).reshape(len(ids), row["dim"])


def _bounds(k: int):
    """Scan: the k best lower bounds of every query in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _queries(row)
                middle, radius = _middles(q, row)
                own = _ints(row["ids"])
                middle = np.where(own[None, :] == q_ids[:, None], -np.inf, middle)
                m = min(k, middle.shape[1])
                best = np.full((len(q_ids), k), -np.inf)
                best[:, :m] = np.partition(middle, middle.shape[1] - m, axis=1)[:, middle.shape[1] - m :] - radius[:, None]
                yield pa.RecordBatch.from_pydict({"qb": [row["qb"]], "best": [best.tobytes()]})

    return run


def _threshold(k: int):
    def run(key, pdf):
        best = np.hstack([np.frombuffer(b, float).reshape(-1, k) for b in pdf["best"]])
        least = -np.partition(-best, k - 1, axis=1)[:, k - 1]
        return type(pdf)({"qb": [key[0]], "least": [least.tobytes()]})

    return run


def _exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products as long, clamped."""
    if v.size and float(np.abs(v).max()) * float(np.abs(q).max()) * len(q) >= _EXACT:
        scores = v.astype(object) @ q.astype(object)
        return np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores], np.int64)
    return (v.astype(float) @ q.astype(float)).astype(np.int64)


def visit(ids: np.ndarray, v: np.ndarray, q_id: int, q: np.ndarray, upper: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of a block, reading vectors by falling upper bound until the k-th is certain."""
    order = np.flatnonzero((upper >= least) & (ids != q_id))
    order = order[np.argsort(-upper[order], kind="stable")]
    got_ids, got, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
    while at < len(order):
        if len(got) == k and upper[order[at]] < got[-1]:
            break
        take = order[at : at + step]
        got_ids, got = np.concatenate([got_ids, ids[take]]), np.concatenate([got, _exact(v[take], q)])
        best = np.lexsort((got_ids, -got))[:k]
        got_ids, got = got_ids[best], got[best]
        at, step = at + step, step * 2
    return got_ids, got


def _visits(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _queries(row)
                middle, radius = _middles(q, row)
                own = _ints(row["ids"])
                v = np.frombuffer(row["exact"], np.int64).reshape(len(own), row["dim"])
                least = np.frombuffer(row["least"], float)
                out = [visit(own, v, int(q_ids[i]), q[i], middle[i] + radius[i], least[i], k) for i in range(len(q_ids))]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(q_ids, [len(x) for x, _ in out]), pa.int64()),
                    "vec_id": pa.array(np.concatenate([x for x, _ in out]), pa.int64()),
                    "score": pa.array(np.concatenate([s for _, s in out]), pa.int64()),
                })

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query in vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    small_batches(spark)
    blocks = materialize(rows.mapInArrow(_pack(BLOCK), _BLOCKS), "va")
    queries = asked.coalesce(1) if asked.count() <= QUERIES * 8 else asked
    queries = queries.mapInArrow(_pack(QUERIES), _BLOCKS).select("dim", F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact")).withColumn("qb", F.monotonically_increasing_id())
    queries = materialize(queries, "queries")
    size = queries.agg(F.sum(F.octet_length("q_exact") + F.octet_length("q_ids"))).first()[0] or 0

    numbers = queries.groupBy("dim").agg(F.collect_list("qb").alias("qbs"))
    meets = blocks.join(F.broadcast(numbers), "dim").withColumn("qb", F.explode("qbs")).drop("qbs")

    def asked_by(right: DataFrame) -> DataFrame:
        return F.broadcast(right) if size <= BROADCAST_BYTES else right

    scan = meets.select("dim", "qb", "ids", "cells", "low", "width").join(asked_by(queries.drop("dim")), "qb")
    best = scan.mapInArrow(_bounds(k), "qb long, best binary")
    least = materialize(best.groupBy("qb").applyInPandas(_threshold(k), "qb long, least binary"), "least")
    found = meets.join(asked_by(queries.drop("dim").join(least, "qb")), "qb").mapInArrow(_visits(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
