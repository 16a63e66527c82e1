"""L-BFGS whose vectors are tables: nothing as large as the model passes through the driver or one task.

Weights, gradient and history are columns of a table with a row a weight. The driver has
only scalars: the dot products of the history, from which the two-loop recursion gives
the direction as a sum of the table's vectors, and the values of the line search.

An evaluation reads the sequences in blocks of BLOCK_POSITIONS positions. A block asks for
the weights of its own distinct observations, which are joined to it; its counts come
back as partial sums by weight. So a task holds a block and its weights, and the bound of
the driver form (some 15 vectors of the model's size) does not apply.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.storage import discard, materialize
from tagloom.operators.inference import Batch, Weights, counters, sized, sparse
from tagloom.operators.training import _ARMIJO, _FLAT, _GROW, _SHRINK, _SHRINK_FIRST, _WOLFE, Params, slow

#: Positions of a block of sequences; a longer sequence is a block of its own.
BLOCK_POSITIONS = 200_000


def blocked(encoded: DataFrame) -> DataFrame:
    """encoded with column block: sequences in order of their ids, cut where a block has its positions.

    The running sum is taken in ranges of ids, of which only the totals meet.
    """
    ranged = encoded.select("sent_id", F.col("n").alias("_n")).repartitionByRange("sent_id").sortWithinPartitions("sent_id").withColumn("_r", F.spark_partition_id())
    rows = materialize(ranged, "ranges")
    inside = F.sum("_n").over(Window.partitionBy("_r").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, -1))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_r").agg(F.sum("_n").alias("_w")).withColumn("_start", F.coalesce(F.sum("_w").over(before), F.lit(0))).select("_r", "_start")
    place = rows.withColumn("_at", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "_r")
    return encoded.join(place.select("sent_id", F.floor((F.col("_start") + F.col("_at")) / BLOCK_POSITIONS).alias("block")), "sent_id")


class TableObjective:
    """Penalised loss and its gradient over blocks of sequences, for weights that are a table (f, x)."""

    def __init__(self, encoded: DataFrame, layout: DataFrame, n_labels: int, p: Params):
        self.p, self.y = p, n_labels
        self.blocks = materialize(blocked(encoded), "blocks")
        asked = self.blocks.select("block", F.explode("obs").alias("obs_id")).distinct()
        places = layout.select("obs_id", F.coalesce("uoff", F.lit(-1)).alias("uoff"), F.coalesce("boff", F.lit(-1)).alias("boff"))
        #: distinct observations of each block with the places of their weights
        self.asked = materialize(asked.join(places, "obs_id"), "asked")
        own = F.when(F.col("uoff") >= 0, F.sequence("uoff", F.col("uoff") + n_labels - 1)).otherwise(F.array().cast("array<bigint>"))
        pair = F.when(F.col("boff") >= 0, F.sequence("boff", F.col("boff") + n_labels**2 - 1)).otherwise(F.array().cast("array<bigint>"))
        self.cells = self.asked.select("block", F.explode(F.concat(own, pair)).alias("f"))
        self.gold = materialize(self._gold(places), "gold")
        self.errors = (0.0, 0.0)

    def _gold(self, places: DataFrame) -> DataFrame:
        """(f, n): counts of the gold labels, summed where they are read before they are shuffled."""
        rows = self.blocks.select(F.explode(F.arrays_zip("at", "obs")).alias("o"), "y")
        rows = rows.select(F.col("o.obs").alias("obs_id"), F.get("y", F.col("o.at")).alias("g"), F.get("y", F.col("o.at") - 1).alias("p"))
        counts = rows.groupBy("obs_id", "p", "g").agg(F.count("*").alias("n")).join(places, "obs_id")
        own = F.when(F.col("uoff") >= 0, F.col("uoff") + F.col("g"))
        pair = F.when((F.col("boff") >= 0) & F.col("p").isNotNull(), F.col("boff") + F.col("p") * self.y + F.col("g"))
        return counts.select("n", F.explode(F.array(own, pair)).alias("f")).where("f is not null").groupBy("f").agg(F.sum("n").cast("double").alias("n"))

    def __call__(self, x: DataFrame) -> tuple[float, DataFrame]:
        """The value at x(f, x, ...), and x with the gradient in column g."""
        y, p = self.y, self.p
        weights = self.cells.join(x.select("f", "x").where("x <> 0"), "f")

        def run(key: tuple, sequences: pa.Table, own: pa.Table) -> pa.Table:
            return _counts(sequences, own, y)

        own = self.asked.select("block", "obs_id", "uoff", "boff", F.lit(0.0).alias("x")).unionByName(weights.select("block", F.lit(-1).cast("long").alias("obs_id"), F.col("f").alias("uoff"), F.lit(-1).cast("long").alias("boff"), "x"))
        got = self.blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, "f long, v double")
        sums = materialize(got.groupBy("f").agg(F.sum("v").alias("v")), "sums")
        totals = {r["f"]: r["v"] for r in sums.where("f < 0").collect()}
        bad, tokens, bad_sequences, n = (totals.get(-k, 0.0) for k in range(2, 6))
        self.errors = (bad / tokens if tokens else 0.0, bad_sequences / n if n else 0.0)
        expected = F.coalesce("v", F.lit(0.0)) - F.coalesce("n", F.lit(0.0)) + p.l2 * F.col("x")
        out = materialize(x.join(sums.where("f >= 0"), "f", "left").join(self.gold, "f", "left").withColumn("g", expected).drop("v", "n"), "vectors")
        discard(sums)
        size = out.agg(F.sum(F.abs("x")).alias("l1"), F.sum(F.col("x") * F.col("x")).alias("l2")).first()
        return totals.get(-1, 0.0) + p.l1 * (size["l1"] or 0.0) + p.l2 * (size["l2"] or 0.0) / 2, out


def _counts(sequences: pa.Table, own: pa.Table, y: int) -> pa.Table:
    """(f, v): a block's expected counts; -1 to -5 are the loss and the numbers of errors."""
    obs, uoff, boff, x = (own[c].to_numpy() for c in ("obs_id", "uoff", "boff", "x"))
    places = obs >= 0
    known = obs[places]
    order = np.argsort(known)
    known, u, b = known[order], uoff[places][order], boff[places][order]
    # the block's weights end to end: an observation's own, then its pairs'
    wide = np.where(u >= 0, y, 0) + np.where(b >= 0, y * y, 0)
    start = np.cumsum(wide) - wide
    at_u, at_b = np.where(u >= 0, start, -1), np.where(b >= 0, start + np.where(u >= 0, y, 0), -1)
    f = np.zeros(int(wide.sum()), np.int64)
    for off, at, n in ((u, at_u, y), (b, at_b, y * y)):
        f[(at[at >= 0][:, None] + np.arange(n)).ravel()] = (off[at >= 0][:, None] + np.arange(n)).ravel()
    theta, by = np.zeros(len(f)), np.argsort(f)
    theta[by[np.searchsorted(f[by], uoff[~places])]] = x[~places]
    w = Weights([""] * y, at_u, at_b, theta)
    total, loss, errors = counters(w), 0.0, np.zeros(4)
    for batch in sized(iter(sequences.select(["sent_id", "n", "at", "obs", "y"]).combine_chunks().to_batches())):
        offsets, values = batch.column(3).offsets, batch.column(3).flatten().to_numpy()
        local = pa.ListArray.from_arrays(pa.array(offsets.to_numpy() - offsets[0].as_py(), pa.int32()), pa.array(np.searchsorted(known, values)))
        one = Batch(pa.RecordBatch.from_arrays([*batch.columns[:3], local, batch.column(4)], names=batch.schema.names), w)
        errors += one.errors()
        loss += one.add_expected(total)
    at, v = sparse(w, total)
    return pa.table({"f": np.concatenate((f[at], np.arange(-1, -6, -1))), "v": np.concatenate((v, [loss], errors))})


def _pseudo(l1: float) -> Column:
    """The pseudo-gradient from columns x and g."""
    x, low, high = F.col("x"), F.col("g") - l1, F.col("g") + l1
    return F.when(x < 0, low).when(x > 0, high).when(high < 0, high).when(low > 0, low).otherwise(F.lit(0.0)) if l1 else F.col("g")


def _mix(columns: list[str], shares: np.ndarray) -> Column:
    return sum((F.lit(float(c)) * F.col(n) for n, c in zip(columns, shares, strict=True)), F.lit(0.0))


def _direction(dots: np.ndarray, m: int, order: str) -> np.ndarray:
    """Shares of (pg, s1..sm, y1..ym) in the direction, by the two-loop recursion on their dot products."""
    d = np.zeros(2 * m + 1)
    d[0] = -1.0
    s, y = range(1, m + 1), range(m + 1, 2 * m + 1)
    at = range(m) if order == "oldest" else range(m - 1, -1, -1)
    shares = {}
    for i in at:
        shares[i] = dots[s[i]] @ d / dots[y[i], s[i]]
        d[y[i]] -= shares[i]
    if m:
        d *= dots[s[-1], y[-1]] / dots[y[-1], y[-1]]
    for i in reversed(at):
        d[s[i]] += shares[i] - dots[y[i]] @ d / dots[y[i], s[i]]
    return d


def lbfgs_tables(objective: TableObjective, x: DataFrame, p: Params, report: Callable[[int, float, DataFrame], bool]) -> DataFrame:
    """The minimum of objective from x(f, x), by the steps of training.lbfgs on tables; (f, x)."""
    f, now = objective(x)
    m, past = 0, []
    for k in range(p.max_iter):
        names = ["pg", *[f"s{i}" for i in range(m)], *[f"y{i}" for i in range(m)]]
        table = now.withColumn("pg", _pseudo(p.l1))
        products = [(i, j) for i in range(len(names)) for j in range(i + 1)]
        row = table.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in products]).first()
        dots = np.zeros((len(names), len(names)))
        for (i, j), v in zip(products, row, strict=True):
            dots[i, j] = dots[j, i] = v or 0.0
        if dots[0, 0] == 0:
            break
        d = _mix(names, _direction(dots, m, p.history_order))
        table = table.withColumn("d", d)
        if p.l1:
            table = table.withColumn("d", F.when(F.col("d") * F.col("pg") >= 0, 0.0).otherwise(F.col("d")))
        size = table.agg(F.sum(F.col("d") * F.col("d")).alias("d"), F.sum(F.col("g") * F.col("d")).alias("g")).first()
        if not size["d"]:
            break
        step, shrink = (1.0 / np.sqrt(size["d"]), _SHRINK_FIRST) if k == 0 else (1.0, _SHRINK)
        kept = [c for c in now.columns if c not in ("x", "g")]
        for _ in range(p.max_line_search):
            to = F.col("x") + F.lit(float(step)) * F.col("d")
            if p.l1:
                orthant = F.when(F.col("x") != 0, F.signum("x")).otherwise(-F.signum("pg"))
                to = F.when(to * orthant <= 0, 0.0).otherwise(to)
            value, tried = objective(table.select(*kept, F.col("x").alias("x0"), F.col("g").alias("g0"), "d", "pg", to.alias("x")))
            slope = tried.agg(F.sum((F.col("x") - F.col("x0")) * F.col("pg")).alias("moved"), F.sum(F.col("g") * F.col("d")).alias("g")).first()
            if p.l1:
                if value < f + _ARMIJO * slope["moved"]:
                    break
                step *= shrink
            elif value > f + _ARMIJO * step * size["g"]:
                step *= shrink
            elif slope["g"] < _WOLFE * size["g"]:
                step *= _GROW
            else:
                break
            discard(tried)
        else:
            break
        s, y = F.col("x") - F.col("x0"), F.col("g") - F.col("g0")
        turn = tried.agg(F.sum(s * y).alias("sy"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("x"), F.sqrt(F.sum(_pseudo(p.l1) ** 2)).alias("g")).first()
        f = value
        stop = report(k, f, tried.select("f", "x"))
        olds = [(f"s{i}", f"y{i}") for i in range(m)]
        if turn["sy"] > 0:
            olds = [*olds, (s, y)][-p.history :]
        columns = [c for i, (a, b) in enumerate(olds) for c in (_named(a, f"s{i}"), _named(b, f"y{i}"))]
        before, now = now, materialize(tried.select("f", "x", "g", *columns), "vectors")
        m = len(olds)
        discard(before, tried)
        past.append(f)
        flat = turn["g"] / max(1.0, turn["x"]) <= _FLAT
        if stop or flat or slow(past, p):
            break
    return now.select("f", "x")


def _named(column: Column | str, name: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).alias(name)
