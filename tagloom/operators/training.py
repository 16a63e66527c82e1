"""Training: OWL-QN / L-BFGS on distributed gradients, and SGD with a cumulative L1 penalty.

An L-BFGS iteration is one or more passes over the encoded sequences; the vectors of
the optimiser (a few times the number of weights) live on the driver. SGD runs inside
the partitions, whose weights and penalties are averaged after each epoch and handed to
the next; with one partition it is the plain sequential algorithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.inference import Weights, measured

# fixed values: constants of the line search
_ARMIJO, _WOLFE = 1e-4, 0.9
_SHRINK_FIRST, _SHRINK, _GROW = 0.1, 0.5, 2.1
_FLAT = 1e-5


@dataclass
class Params:
    """Options of training with their defaults."""

    algorithm: str = "l-bfgs"
    max_iter: int = 100
    l1: float = 0.5
    l2: float = 1e-4
    objective_window: int = 5
    stop_window: int = 5
    stop_eps: float = 0.02
    history: int = 5
    max_line_search: int = 40
    eta0: float = 0.8
    alpha: float = 0.85
    seed: int = 1
    history_order: str = "newest"
    #: Weights up to which the optimiser's vectors (some 15 of 8 bytes a weight) are on the driver; beyond they are tables.
    driver_weights: int = 50_000_000

    def __post_init__(self):
        self.algorithm = {"sgd": "sgd-l1", "lbfgs": "l-bfgs"}.get(self.algorithm, self.algorithm)
        if self.algorithm not in ("l-bfgs", "sgd-l1"):
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.history_order not in ("newest", "oldest"):
            raise ValueError("history_order is newest or oldest")
        for name in ("l1", "l2"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")
        for name in ("max_iter", "objective_window", "stop_window", "stop_eps", "history", "max_line_search", "eta0", "alpha", "driver_weights"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")


@dataclass
class Log:
    """One row an iteration: iter, obj, active, err."""

    rows: list[tuple[int, float | None, int, float | None]] = field(default_factory=list)


def steady(errors: list[float], p: Params) -> bool:
    """Whether the last stop_window errors lie within stop_eps percent, as metrics.stopping tells from a log."""
    last = errors[-p.stop_window :]
    return len(last) == p.stop_window and (max(last) - min(last)) * 100 < p.stop_eps


def slow(objectives: list[float], p: Params) -> bool:
    """Whether the objective moved by less than stop_eps of itself over objective_window iterations, as metrics.stopping tells from a log."""
    now = objectives[-1]
    return len(objectives) > p.objective_window and (now == 0 or abs(objectives[-p.objective_window] - now) / abs(now) < p.stop_eps)


def empirical(encoded: DataFrame, weights: Weights) -> np.ndarray:
    """Counts of all weights in the gold labels: a grouped count of (observation, label) and (observation, previous, label)."""
    kept = getattr(encoded, "_windows", None)
    if kept is not None:
        return kept.gold(weights)
    size, y = len(weights.theta), len(weights.labels)
    rows = encoded.select(F.explode(F.arrays_zip("at", "obs")).alias("o"), F.col("y").alias("g")).select(F.col("o.at").alias("t"), F.col("o.obs").alias("obs"), "g")
    rows = rows.select("obs", F.get("g", F.col("t")).alias("y"), F.get("g", F.col("t") - 1).alias("p"))
    got = rows.groupBy("obs", "p", "y").count().toPandas()
    obs, p, gold, n = got["obs"].to_numpy(np.int64), got["p"].fillna(-1).to_numpy(np.int64), got["y"].to_numpy(np.int64), got["count"].to_numpy()
    out = np.zeros(size)
    u = weights.uoff[obs] >= 0
    np.add.at(out, weights.uoff[obs[u]] + gold[u], n[u])
    b = (weights.boff[obs] >= 0) & (p >= 0)
    np.add.at(out, weights.boff[obs[b]] + p[b] * y + gold[b], n[b])
    return out


def pseudo_gradient(x: np.ndarray, g: np.ndarray, l1: float) -> np.ndarray:
    """Steepest direction of the objective with its L1 term."""
    low, high = g - l1, g + l1
    return np.where(x < 0, low, np.where(x > 0, high, np.where(high < 0, high, np.where(low > 0, low, 0.0))))


def direction(g: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray], order: str = "newest") -> np.ndarray:
    """Two-loop recursion; the history starts with its newest pair, or with its oldest."""
    d = -g
    at = range(len(steps)) if order == "oldest" else range(len(steps) - 1, -1, -1)
    shares = {}
    for i in at:
        shares[i] = steps[i] @ d / (changes[i] @ steps[i])
        d = d - shares[i] * changes[i]
    if steps:
        d = d * (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for i in reversed(at):
        d = d + steps[i] * (shares[i] - changes[i] @ d / (changes[i] @ steps[i]))
    return d


def lbfgs(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, p: Params, report: Callable[[int, float, np.ndarray], bool]) -> np.ndarray:
    """Minimises objective (value with penalties, gradient without the L1 term); report says whether to stop."""
    f, g = objective(x)
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    past: list[float] = []
    for k in range(p.max_iter):
        pg = pseudo_gradient(x, g, p.l1) if p.l1 else g
        if not np.any(pg):
            break
        d = direction(pg, steps, changes, p.history_order)
        if p.l1:
            d = np.where(d * pg >= 0, 0.0, d)
        if not np.any(d):
            break
        orthant = np.where(x != 0, np.sign(x), -np.sign(pg))
        step, shrink = (1.0 / np.linalg.norm(d), _SHRINK_FIRST) if k == 0 else (1.0, _SHRINK)
        for _ in range(p.max_line_search):
            to = x + step * d
            if p.l1:
                to = np.where(to * orthant <= 0, 0.0, to)
            value, grad = objective(to)
            if p.l1:
                if value < f + _ARMIJO * ((to - x) @ pg):
                    break
                step *= shrink
            elif value > f + _ARMIJO * step * (g @ d):
                step *= shrink
            elif grad @ d < _WOLFE * (g @ d):
                step *= _GROW
            else:
                break
        else:
            break
        s, y = to - x, grad - g
        x, f, g = to, value, grad
        stop = report(k, f, x)
        if s @ y > 0:
            steps, changes = [*steps, s][-p.history :], [*changes, y][-p.history :]
        past.append(f)
        flat = np.linalg.norm(pseudo_gradient(x, g, p.l1) if p.l1 else g) / max(1.0, np.linalg.norm(x)) <= _FLAT
        if stop or flat or slow(past, p):
            break
    return x


class Objective:
    """Penalised negative log-likelihood over all sequences, a Spark job an evaluation; errors are those of the last one, if it decoded."""

    def __init__(self, encoded: DataFrame, weights: Weights, p: Params, decoded: bool = True):
        self.encoded, self.weights, self.p, self.decoded = encoded, weights, p, decoded
        self.seen = empirical(encoded, weights)
        self.errors = (0.0, 0.0)

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        w, p = self.weights, self.p
        expected, loss, self.errors = measured(self.encoded, Weights(w.labels, w.uoff, w.boff, x), decoded=self.decoded)
        return loss + p.l1 * np.abs(x).sum() + p.l2 * (x @ x) / 2, expected - self.seen + p.l2 * x


def objective_of(encoded: DataFrame, weights: Weights, p: Params, decoded: bool = True) -> Objective:
    return Objective(encoded, weights, p, decoded)


# --- stochastic gradient descent ---------------------------------------------------------

INDEXED = "sent_id long, n int, y array<int>, u array<long>, u_k array<int>, u_at array<int>, b array<long>, b_k array<int>, b_at array<int>"


def indexed(encoded: DataFrame, weights: Weights) -> DataFrame:
    """Encoded sequences as SGD steps through them: distinct observations with label weights (u) and with pair weights (b), and for each occurrence its place among them and its position."""
    sent = encoded.sparkSession.sparkContext.broadcast((weights.uoff, weights.boff))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, obs = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for t, o in zip(at, obs, strict=True):
                for k, off in enumerate(sent.value):
                    own = off[o] >= 0
                    held, place = np.unique(o[own], return_inverse=True)
                    for column, x in zip(columns[3 * k : 3 * k + 3], (held, place, t[own]), strict=True):
                        column.append(x)
            kinds = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[c.split()[0] for c in INDEXED.split(", ")])

    return encoded.mapInArrow(run, INDEXED)


@dataclass
class SgdState:
    """Weights, the penalty each has received, and the whole penalty due so far; all three last over epochs."""

    x: np.ndarray
    taken: np.ndarray
    due: float = 0.0


def _chain(u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label) and P(previous, label) by position of one sequence.

    Positions are dealt into blocks of about the square root of their number: products
    of all blocks' matrices grow together, one step a place in the block, and only the
    blocks follow each other.
    """
    n, size = u.shape
    pair = np.zeros((n, size, size))
    first = np.exp(u[0] - u[0].max())
    if n == 1:
        return (first / first.sum())[None], pair
    m = b[1:] + u[1:, None, :]
    m -= m.max((1, 2))[:, None, None]
    np.exp(m, out=m)
    wide = max(1, int(np.sqrt(n - 1)))
    blocks = -(-(n - 1) // wide)
    whole = np.empty((blocks * wide, size, size))
    whole[: n - 1], whole[n - 1 :] = m, np.eye(size)
    whole = whole.reshape(blocks, wide, size, size)
    upto = np.empty_like(whole)  # products from the block's first matrix on
    upto[:, 0] = whole[:, 0]
    for k in range(1, wide):
        now = upto[:, k - 1] @ whole[:, k]
        now /= now.max((1, 2))[:, None, None]
        upto[:, k] = now
    enters, leaves = np.empty((blocks, size)), np.empty((blocks, size))
    enters[0], leaves[-1] = first / first.sum(), 1.0
    for k in range(1, blocks):
        now = enters[k - 1] @ upto[k - 1, -1]
        enters[k] = now / now.sum()
        now = upto[-k, -1] @ leaves[-k]
        leaves[-k - 1] = now / now.max()
    forward = np.empty((n, size))
    forward[0] = enters[0]
    forward[1:] = np.einsum("ki,klij->klj", enters, upto).reshape(-1, size)[: n - 1]
    backward = np.empty((blocks, wide, size))
    backward[:, -1] = leaves
    for k in range(wide - 1, 0, -1):
        now = np.einsum("kij,kj->ki", whole[:, k], backward[:, k])
        backward[:, k - 1] = now / now.max(1)[:, None]
    after = backward.reshape(-1, size)[: n - 1]
    before = np.einsum("ij,j->i", m[0], after[0])
    single = forward
    np.multiply(forward[:-1, :, None], m * after[:, None, :], out=pair[1:])
    pair[1:] /= pair[1:].sum((1, 2))[:, None, None]
    single = np.empty((n, size))
    single[1:] = pair[1:].sum(1)
    single[0] = first * before
    single[0] /= single[0].sum()
    return single, pair


def _log_chain(u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same in log space, for potentials that lie far apart."""
    n, size = u.shape
    forward, backward = u.copy(), np.zeros((n, size))
    for t in range(1, n):
        forward[t] += np.logaddexp.reduce(forward[t - 1][:, None] + b[t], axis=0)
    for t in range(n - 2, -1, -1):
        backward[t] = np.logaddexp.reduce(b[t + 1] + u[t + 1] + backward[t + 1], axis=1)
    z = np.logaddexp.reduce(forward[-1])
    pair = np.zeros((n, size, size))
    pair[1:] = np.exp(forward[:-1, :, None] + b[1:] + (u[1:] + backward[1:])[:, None, :] - z)
    return np.exp(forward + backward - z), pair


#: Spread of a position's potentials up to which products of a block keep every term.
_CHAIN_SPREAD = 30.0


class _Walk:
    """One task's walk through its sequences: rows of weights and penalties by observation."""

    def __init__(self, w: Weights, state: SgdState, p: Params):
        self.p, self.size = p, len(w.labels)
        own, taken = Weights(w.labels, w.uoff, w.boff, state.x), Weights(w.labels, w.uoff, w.boff, state.taken)
        self.x, self.taken = (own.u, own.b[0]), (taken.u, taken.b[0])
        self.row, self.off = own.b[1], (w.uoff, w.boff[w.boff >= 0])
        self.due = state.due

    def potentials(self, rows: np.ndarray, place: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, rows.shape[1]))
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[first]] = np.add.reduceat(rows[place], first, axis=0)
        return out

    def step(self, n: int, gold: np.ndarray, u: tuple, b: tuple, rate: float, share: float) -> None:
        """One sequence: n positions, and of u and b the distinct observations, their place for each occurrence, its position."""
        size = self.size
        held = u[0], self.row[b[0]]
        x = [t[h] for t, h in zip(self.x, held, strict=True)]
        own = self.potentials(x[0], u[1], u[2], n)
        pairs = self.potentials(x[1], b[1], b[2], n).reshape(n, size, size)
        near = np.ptp(own, 1).max() <= _CHAIN_SPREAD and np.ptp(pairs.reshape(n, -1), 1).max() <= _CHAIN_SPREAD
        single, pair = (_chain if near else _log_chain)(own, pairs)
        single[np.arange(n), gold] -= 1
        at = np.arange(1, n)
        pair[at, gold[:-1], gold[1:]] -= 1
        self.due += rate * share
        for k, (values, place, where) in enumerate(((single, u[1], u[2]), (pair.reshape(n, -1), b[1], b[2]))):
            if not len(held[k]):
                continue
            if len(held[k]) == 1:
                moves = values[where].sum(0)[None]
            else:
                moves = np.stack([np.bincount(place, weights=values[:, y][where], minlength=len(held[k])) for y in range(values.shape[1])], axis=1)
            z, taken = x[k] - rate * moves, self.taken[k][held[k]]
            new = np.where(z > 0, np.maximum(0, z - (self.due + taken)), np.where(z < 0, np.minimum(0, z + (self.due - taken)), z))
            self.x[k][held[k]] = new
            self.taken[k][held[k]] = taken + (new - z)


def sgd_epoch(sequences: DataFrame, weights: Weights, p: Params, epoch: int, n: int, state: SgdState) -> SgdState:
    """One pass over indexed sequences: every partition walks its own in seeded order with the rate that their place calls for.

    The L1 penalty is cumulative over all epochs: a weight is clipped by what has built
    up since it was last touched, when a sequence touches it. Weights, received and due
    penalties of the partitions are averaged. Tasks send what they have changed.
    """
    sent = sequences.sparkSession.sparkContext.broadcast((weights, state))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, begun = sent.value
        walk, i = _Walk(w, begun, p), epoch * n
        for batch in batches:
            lists = [(column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy())))) for column in batch.columns[2:]]
            for k, size in enumerate(batch.column(1).to_numpy().tolist()):
                gold, *rest = (values[ends[k] : ends[k + 1]] for values, ends in lists)
                if size:
                    walk.step(size, gold, rest[:3], rest[3:], p.eta0 * p.alpha ** (i / n), p.l1 / n)
                    i += 1
        if i == epoch * n:
            return
        first = _Walk(w, begun, p)
        for k in (0, 1):
            row, y = np.nonzero((walk.x[k] != first.x[k]) | (walk.taken[k] != first.taken[k]))
            for a in range(0, len(row), 100_000):
                r, c = row[a : a + 100_000], y[a : a + 100_000]
                moved = [pa.array(of[k][r, c] - was[k][r, c]) for of, was in ((walk.x, first.x), (walk.taken, first.taken))]
                yield pa.RecordBatch.from_arrays([pa.array(walk.off[k][r] + c), *moved], names=["f", "x", "taken"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([1.0]), pa.array([walk.due - begun.due])], names=["f", "x", "taken"])

    order = sequences.withColumn("_o", F.xxhash64("sent_id", F.lit(p.seed), F.lit(epoch))).sortWithinPartitions("_o").drop("_o")
    got = order.mapInArrow(run, "f long, x double, taken double").groupBy("f").agg(F.sum("x").alias("x"), F.sum("taken").alias("taken")).toPandas()
    sent.unpersist()
    f, dx, taken = got["f"].to_numpy(), got["x"].to_numpy(), got["taken"].to_numpy()
    out, moved = SgdState(state.x.copy(), state.taken.copy(), state.due), f >= 0
    if not moved.all():
        walks = dx[~moved].sum()
        out.x[f[moved]] += dx[moved] / walks
        out.taken[f[moved]] += taken[moved] / walks
        out.due += taken[~moved].sum() / walks
    return out
