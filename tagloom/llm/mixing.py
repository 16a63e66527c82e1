"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share
as many words as there are; no target exceeds three times its source's size, and the
excess is shared out again by weight. Blocks of equal length go to sources by the
highest quotients target / (2 * seats + 1), and each source's blocks to its shards by
the same rule with the shards' sizes. A shard is an even part of a source by hash; its
documents stand one after the other by doc_id, and its words are cut into blocks. A quota
takes the whole shard as often as it can, and for the rest the blocks with the smallest
seeded hashes, up to the quota: the last one in part, if the shard's own last block is
short. So quotas are whole blocks, a rerun takes the same words, another seed other
blocks, and no task ever needs more than a shard.

Gathered on the driver: one row per source and one per shard (at most SHARDS and the
number of sources), never documents.

Defined cases: null text has size 0; a source whose texts are all empty has target 0;
a null source is a source; equal rows count each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most this many times its source's size.
MOST_TIMES = 3
#: Words in a block, where there are enough words for MANY_BLOCKS of them; fewer otherwise.
BLOCK, MANY_BLOCKS = 64, 100_000
#: Words in a shard, unless that would make more than SHARDS of them.
SHARD_WORDS, SHARDS = 2_000_000, 50_000
SEED = 20_240


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of sum(sizes) by weight, each at most MOST_TIMES its size, the excess shared again."""
    left, active, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while active:
        unit = left / sum(weights[i] for i in active)
        over = [i for i in active if weights[i] * unit > MOST_TIMES * sizes[i]]
        if not over:
            for i in active:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(MOST_TIMES * sizes[i])
            left -= out[i]
            active.discard(i)
    return out


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 s + 1); ties to the earlier entry.

    Most seats come from one division (a seat below the divisor's rounding is certain),
    the last few from a heap of quotients.
    """
    w = np.asarray(weights, float)
    if seats <= 0 or not len(w) or w.sum() <= 0:
        return [0] * len(w)
    divisor = w.sum() / seats
    got = np.floor(w / divisor + 0.5)
    while got.sum() > seats:
        divisor *= 1 + max(1e-12, (got.sum() - seats) / max(seats, 1))
        got = np.floor(w / divisor + 0.5)
    heap = [(-x / (2 * s + 1), i) for i, (x, s) in enumerate(zip(w.tolist(), got.tolist(), strict=True)) if x > 0]
    heapq.heapify(heap)
    out = got.astype(np.int64).tolist()
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-w[i] / (2 * out[i] + 1), i))
    return out


def _sized(docs: DataFrame, seed: int, keep: list[str]) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), F.xxhash64("text").alias("content"), *(F.col(c).alias(f"_{c}") for c in keep),
    )


def mix(docs: DataFrame, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and the columns named in keep, prefixed by _."""
    spark = docs.sparkSession
    sized = materialize(_sized(docs, seed, []), "sizes")
    rows = sorted(((r.source, r.size) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    names, sizes = [r[0] for r in rows], [r[1] for r in rows]
    total = sum(sizes)
    goal = targets(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(rows))])
    block = max(1, min(BLOCK, total // MANY_BLOCKS))
    seats = sainte_lague(goal, total // block)
    per_shard = max(SHARD_WORDS, -(-total // SHARDS))
    shards = [max(1, -(-s // per_shard)) for s in sizes]

    sources = spark.createDataFrame([(i, n, s, g, k) for i, (n, s, g, k) in enumerate(zip(names, sizes, goal, shards, strict=True))], "src int, name string, source_size long, target double, shards long")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(sources), df.source.eqNullSafe(sources.name)).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), "shards"))

    of: dict[int, list[tuple[int, int]]] = {}
    for r in placed(sized).groupBy("src", "shard").agg(F.sum("size").alias("size")).collect():
        of.setdefault(r.src, []).append((r.shard, r["size"]))
    quotas = []
    for i, own in of.items():
        own.sort()
        for (shard, size), q in zip(own, sainte_lague([float(s) for _, s in own], seats[i]), strict=True):
            quotas.append((i, shard, size, min(q * block, MOST_TIMES * size)))
    quota = spark.createDataFrame(quotas, "src int, shard long, shard_size long, words long")
    rows = placed(_sized(docs, seed, keep) if keep else sized).join(F.broadcast(quota), ["src", "shard"])
    # equal rows of a shard stand in any order: they have the same words
    w = Window.partitionBy("src", "shard").orderBy("doc_id", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("rounds", rounds).withColumn("row", F.row_number().over(Window.partitionBy("src", "shard").orderBy("doc_id", "content")))
    chosen = _chosen(quota.withColumn("rest", F.col("words") - rounds * F.col("shard_size")), block, seed)
    # a document's blocks, and what of them is taken: ranges of its words
    last = F.floor((F.col("before") + F.col("size") - 1) / block)
    parts = rows.where("size > 0").select("src", "shard", "row", "before", "size", F.explode(F.sequence(F.floor(F.col("before") / block), last)).alias("block")).join(chosen, ["src", "shard", "block"])
    begin, end = F.greatest(F.col("block") * block, F.col("before")), F.least(F.col("block") * block + F.col("take"), F.col("before") + F.col("size"))
    parts = parts.select("src", "shard", "row", (begin - F.col("before")).alias("start"), (end - F.col("before")).alias("end")).where("start < end")
    taken = parts.groupBy("src", "shard", "row").agg(F.sum(F.col("end") - F.col("start")).alias("part"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_ranges"))
    out = rows.join(taken, ["src", "shard", "row"], "left").withColumn("taken", F.col("rounds") * F.col("size") + F.coalesce("part", F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", "taken", *(("_ranges",) if keep else ()), *(f"_{c}" for c in keep or ()))


def _chosen(quota: DataFrame, block: int, seed: int) -> DataFrame:
    """(src, shard, block, take): blocks of each shard with the smallest seeded hashes, as many as its rest of words asks for, and the words taken of each."""
    blocks = quota.where("rest > 0").select("src", "shard", "shard_size", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shard_size") - 1) / block))).alias("block"))
    own = F.least(F.lit(block).cast("long"), F.col("shard_size") - F.col("block") * block)
    w = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "src", "shard", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("own").over(w), F.lit(0))
    blocks = blocks.withColumn("own", own).withColumn("take", F.least(F.col("own"), F.col("rest") - upto))
    return blocks.where("take > 0").select("src", "shard", "block", "take")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time a document is taken.

    The last copy of a document that is taken in part has the words of its chosen blocks,
    joined by single spaces. Documents without words are not taken.
    """
    took = mix(docs, seed, docs.columns).where("taken > 0")
    took = took.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    rest = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    words = F.split(F.btrim("_text", F.lit(" \t\n\x0b\f\r")), "[\\x20\\x09-\\x0D]+")
    # a text is split once, not once a range: inside the outer lambda its words are a value
    parts = F.flatten(F.flatten(F.transform(F.array(words), lambda ws: F.transform("_ranges", lambda r: F.slice(ws, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))))))
    text = F.when(rest >= F.col("size"), F.col("_text")).otherwise(F.array_join(parts, " "))
    return took.withColumn("_text", text).select(*(F.col(f"_{c}").alias(c) for c in docs.columns))
