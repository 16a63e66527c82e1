"""Sequence inference: potentials, Viterbi, forward-backward, marginals and losses.

Sequences are encoded once (observation ids and label ids as arrays). A task then takes
many sequences at a time, as many as POSITIONS allows: all of them step through their
positions together, the longest first. What is computed lies in order of the position,
then of the sequence, so a step reads and writes one run of rows. Sums are scaled at
every position; a batch whose potentials lie too far apart for that takes them in log
space, so nothing overflows or vanishes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions taken at once by a task (some 600 bytes each with four labels); a longer sequence is alone.
POSITIONS = 60_000
#: Observations (some tens of bytes each) up to which the dictionary is broadcast; beyond, only frequent ones are.
BROADCAST_OBSERVATIONS = 2_000_000

#: Spread of a position's potentials up to which scaled sums keep every term (exp(-2 * 300) is still a double).
SCALED_SPREAD = 300.0

ENCODED = "sent_id long, n int, at array<int>, obs array<long>, y array<int>"


def sized(batches: Iterator[pa.RecordBatch], column: int = 1, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of most (else POSITIONS) positions at most (or of one row), by a column with their numbers of positions."""
    most = POSITIONS if most is None else most
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        n = pc.fill_null(batch.column(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        a = 0
        while a < len(n):
            b = a + max(int(np.searchsorted(np.cumsum(n[a:]), most - size, "right")), 0 if held else 1)
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(n[a:b].sum())
            if b < len(n):
                yield _joined(held)
                held, size = [], 0
            a = b
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a list column, null as empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, pc.list_flatten(column)


class Lookup:
    """Ids of strings, by a table that is built once a worker; each distinct string of a batch is looked up once."""

    def __init__(self, values: list[str], ids: np.ndarray):
        self.values, self.ids = values, ids

    def __getstate__(self):
        return {"values": self.values, "ids": self.ids}

    @cached_property
    def table(self) -> dict[str, int]:
        return dict(zip(self.values, self.ids.tolist(), strict=True))

    def __call__(self, strings: pa.Array) -> np.ndarray:
        """Ids, -1 for strings that are not there."""
        coded = strings.dictionary_encode()
        find = self.table.get
        ids = np.array([find(x, -1) for x in coded.dictionary.to_pylist()] + [-1], np.int64)
        return ids[pc.fill_null(coded.indices, len(ids) - 1).to_numpy(zero_copy_only=False)]


def _encoded(batch: pa.RecordBatch, known: Lookup, labels: Lookup) -> pa.RecordBatch:
    """(sent_id, n, at, obs, y) of a batch of (sent_id, obs, labels)."""
    n, inner = _lists(batch.column(1))
    per, flat = _lists(inner)
    ids = known(flat)
    found = ids >= 0
    place = (np.arange(n.sum()) - (np.cumsum(n) - n).repeat(n)).repeat(per)[found]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(np.arange(len(n)).repeat(n).repeat(per)[found], minlength=len(n))))).astype(np.int32)
    gold_n, gold = _lists(batch.column(2))
    y_cuts = np.concatenate(([0], np.cumsum(gold_n))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(ids[found])), pa.ListArray.from_arrays(y_cuts, pa.array(labels(gold).astype(np.int32)))],
        names=["sent_id", "n", "at", "obs", "y"],
    )


def encode(featured: DataFrame, dictionary: DataFrame, labels: DataFrame) -> DataFrame:
    """(sent_id, n, at, obs, y) of featured(sent_id, cols, labels, obs): known observations with their positions; y is -1 for a label that is not known."""
    names = [r.label for r in labels.where("label is not null").orderBy("label_id").collect()]
    if dictionary.count() > BROADCAST_OBSERVATIONS:
        return _encode_by_join(featured, dictionary, names)
    known = dictionary.orderBy("obs_id").toPandas()
    sent = featured.sparkSession.sparkContext.broadcast((Lookup(known["obs"].tolist(), known["obs_id"].to_numpy(np.int64)), Lookup(names, np.arange(len(names)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _encoded(batch, *sent.value)

    return featured.select("sent_id", "obs", "labels").mapInArrow(run, ENCODED)


#: Observations that a large dictionary broadcasts: the most frequent ones.
FREQUENT_OBSERVATIONS = 200_000


def _encode_by_join(featured: DataFrame, dictionary: DataFrame, names: list[str]) -> DataFrame:
    """The same for dictionaries that are too large to broadcast.

    Two tiers: the most frequent observations (such as a constant one, which every
    position has) get their ids where the sequences are read; distinct other ones of
    each sequence are joined, and their ids go back to the sequence.
    """
    from tagloom.operators.templates import exploded

    spark = featured.sparkSession
    often = exploded(featured).groupBy("obs").count().orderBy(F.desc("count"), "obs").limit(FREQUENT_OBSERVATIONS).select("obs")
    tier = dictionary.join(F.broadcast(often), "obs").select("obs", "obs_id").toPandas()
    missing = F.broadcast(often).join(dictionary, "obs", "left_anti").toPandas()["obs"].tolist()
    first = Lookup([*tier["obs"], *missing], np.concatenate([tier["obs_id"].to_numpy(np.int64), np.full(len(missing), -2)]))
    sent = spark.sparkContext.broadcast((first, Lookup(names, np.arange(len(names)))))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(sent_id, obs): distinct observations of each sequence that are not in the first tier."""
        for batch in batches:
            n, inner = _lists(batch.column(1))
            per, flat = _lists(inner)
            open_ = np.flatnonzero(sent.value[0](flat) == -1)
            of = np.arange(len(n)).repeat(n).repeat(per)[open_]
            coded = flat.take(pa.array(open_)).dictionary_encode()
            pairs = np.unique(of * max(len(coded.dictionary), 1) + coded.indices.to_numpy())
            of, at = np.divmod(pairs, max(len(coded.dictionary), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), coded.dictionary.take(pa.array(at))], names=["sent_id", "obs"])

    rows = featured.select("sent_id", "obs", "labels")
    asked = rows.mapInArrow(rare, "sent_id long, obs string").join(dictionary.select("obs", "obs_id"), "obs")
    ids = asked.groupBy("sent_id").agg(F.collect_list(F.struct("obs", "obs_id")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier, labels = sent.value
        for batch in batches:
            own = pc.list_flatten(batch.column(3))
            more = dict(zip(own.field("obs").to_pylist(), own.field("obs_id").to_pylist(), strict=True))
            yield _encoded(batch.select([0, 1, 2]), _Tiers(tier, more), labels)

    return rows.join(ids, "sent_id", "left").select("sent_id", "obs", "labels", "own").mapInArrow(run, ENCODED)


class _Tiers:
    """Ids of the first tier, else those that the batch brings."""

    def __init__(self, tier: Lookup, more: dict[str, int]):
        self.tier, self.more = tier, more

    def __call__(self, strings: pa.Array) -> np.ndarray:
        coded = strings.dictionary_encode()
        ids = self.tier(coded.dictionary)
        more = self.more.get
        ids = np.array([more(x, -1) if i == -1 else i for x, i in zip(coded.dictionary.to_pylist(), ids.tolist(), strict=True)], np.int64)
        return np.maximum(ids, -1)[coded.indices.to_numpy()] if len(ids) else np.zeros(0, np.int64)


@dataclass
class Weights:
    """Labels, layout of the observations, and their weights."""

    labels: list[str]
    uoff: np.ndarray  # by obs_id, -1 for none
    boff: np.ndarray
    theta: np.ndarray

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("labels", "uoff", "boff", "theta")}

    @cached_property
    def u(self) -> np.ndarray:
        """Weights of each label, by observation; 0 where it has none."""
        return self._rows(self.uoff, len(self.labels))

    @cached_property
    def b(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of each pair of labels, a row for each observation that has them, and the observations' rows (-1 for none)."""
        held = np.flatnonzero(self.boff >= 0)
        row = np.full(len(self.boff), -1)
        row[held] = np.arange(len(held))
        return self._rows(self.boff[held], len(self.labels) ** 2), row

    def _rows(self, off: np.ndarray, wide: int) -> np.ndarray:
        out = np.zeros((len(off), wide))
        held = np.flatnonzero(off >= 0)
        out[held] = self.theta[off[held][:, None] + np.arange(wide)]
        return out


def _segment_sums(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows of values by at, which does not fall."""
    out = np.zeros((size, values.shape[1]))
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] = np.add.reduceat(values, first, axis=0)
    return out


class Batch:
    """Potentials of the sequences of an Arrow batch.

    Lanes are sequences, longest first; empty ones have no lane. Rows of the public
    arrays are positions, sequence by sequence; step holds them in order of the step,
    then of the lane, and steps[t] is where step t begins there.
    """

    def __init__(self, batch: pa.RecordBatch, w: Weights):
        self.n = batch.column(1).to_numpy().astype(np.int64)
        self.y_size = size = len(w.labels)
        self.begin = np.cumsum(self.n) - self.n
        per, at = _lists(batch.column(2))
        at = at.to_numpy().astype(np.int64) + self.begin.repeat(per)
        obs = _lists(batch.column(3))[1].to_numpy()
        if len(at) and (np.diff(at) < 0).any():
            order = np.argsort(at, kind="stable")
            at, obs = at[order], obs[order]
        self.size = int(self.n.sum())
        labelled, gold = _lists(batch.column(4))
        fits = labelled == self.n
        self.gold = np.full(self.size, -1)  # also where there is not a label for each position
        self.fits = fits.repeat(self.n)
        self.gold[self.fits] = pc.fill_null(gold, -1).to_numpy().astype(np.int64)[fits.repeat(labelled)]
        self.w = w
        own = w.uoff[obs] >= 0
        self.u_obs, self.u_rows_at = (obs, at) if own.all() else (obs[own], at[own])
        pair, row = w.b
        own = row[obs] >= 0
        self.b_row, self.b_rows_at = row[obs[own]], at[own]
        self.u = _segment_sums(w.u[self.u_obs], self.u_rows_at, self.size)
        self.b = _segment_sums(pair[self.b_row], self.b_rows_at, self.size).reshape(self.size, size, size)
        self.lanes = np.argsort(-self.n, kind="stable")
        self.lanes = self.lanes[self.n[self.lanes] > 0]
        self.start, self.length = self.begin[self.lanes], self.n[self.lanes]
        live = np.searchsorted(-self.length, -np.arange(int(self.length[0]) if len(self.length) else 0), "left")
        self.steps = np.concatenate(([0], np.cumsum(live))).tolist()
        lane = np.arange(self.size) - np.repeat(self.steps[:-1], live)
        self.step = self.start[lane] + np.repeat(np.arange(len(live)), live)
        self.inner = np.ones(self.size, bool)
        self.inner[self.start] = False
        self.inner = np.flatnonzero(self.inner)

    @property
    def u_index(self) -> np.ndarray:
        """First weight of each occurrence of an observation with label weights."""
        return self.w.uoff[self.u_obs]

    @property
    def b_index(self) -> np.ndarray:
        return self.w.boff[self.w.boff >= 0][self.b_row]

    def viterbi(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best labels by position, score by lane, and each position's own score; ties go to the lower label ids."""
        size, steps = self.y_size, self.steps
        own = np.zeros(self.size)
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0), own
        add = self.b[self.step] + self.u[self.step][:, None, :]
        back = np.zeros((self.size, size), np.int64)
        value = self.u[self.start].copy()
        for t in range(1, len(steps) - 1):
            a, z = steps[t], steps[t + 1]
            score = value[: z - a, :, None] + add[a:z]
            score.argmax(1, out=back[a:z])
            score.max(1, out=value[: z - a])
        state = value.argmax(1)
        found = np.zeros(self.size, np.int64)
        for t in range(len(steps) - 2, -1, -1):
            a, z = steps[t], steps[t + 1]
            found[a:z] = state[: z - a]
            if t:
                state[: z - a] = back[np.arange(a, z), state[: z - a]]
        path = np.zeros(self.size, np.int64)
        path[self.step] = found
        at = self.inner
        own[at] = self.u[at, path[at]] + self.b[at, path[at - 1], path[at]]
        own[self.start] = self.u[self.start, path[self.start]]
        return path, value.max(1), own

    def forward_backward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward values by position, and log Z by lane."""
        steps, step = self.steps, self.step
        u, b = self.u[step], self.b[step]
        forward, backward = u.copy(), np.zeros((self.size, self.y_size))
        for t in range(1, len(steps) - 1):
            a, z, before = steps[t], steps[t + 1], steps[t - 1]
            forward[a:z] += _log_sum(forward[before : before + z - a][:, :, None] + b[a:z], 1)
        for t in range(len(steps) - 3, -1, -1):
            a, n, after = steps[t], steps[t + 2] - steps[t + 1], steps[t + 1]
            backward[a : a + n] = _log_sum(b[after : after + n] + (u[after : after + n] + backward[after : after + n])[:, None, :], 2)
        out = np.empty((2, self.size, self.y_size))
        out[0, step], out[1, step] = forward, backward
        return out[0], out[1], _log_sum(out[0][self.start + self.length - 1], 1)

    @cached_property
    def _scaled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """exp of u and b over their largest value at each position, in order of the steps, and those values' logs by position; None where they lie too far apart."""
        if not self.size:
            return None
        u_top, b_top = self.u.max(1), self.b.max((1, 2))
        if (u_top - self.u.min(1)).max() > SCALED_SPREAD or (b_top - self.b.min((1, 2))).max() > SCALED_SPREAD:
            return None
        u, b = (self.u - u_top[:, None])[self.step], (self.b - b_top[:, None, None])[self.step]
        return np.exp(u, out=u), np.exp(b, out=b), u_top, b_top

    @cached_property
    def _forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward shares in order of the steps (they sum to one), and log Z by lane."""
        u, b, u_top, b_top = self._scaled
        steps = self.steps
        forward, total = np.empty((self.size, self.y_size)), np.empty(self.size)
        for t in range(len(steps) - 1):
            a, z = steps[t], steps[t + 1]
            now = np.einsum("ci,cij->cj", forward[steps[t - 1] : steps[t - 1] + z - a], b[a:z]) if t else u[a:z].copy()
            if t:
                now *= u[a:z]
            now.sum(1, out=total[a:z])
            np.divide(now, total[a:z, None], out=forward[a:z])
        logs = np.empty(self.size)
        logs[self.step] = np.log(total)
        logs += u_top + b_top
        logs[self.start] -= b_top[self.start]
        sums = np.concatenate(([0.0], np.cumsum(logs)))
        return forward, sums[self.start + self.length] - sums[self.start]

    def log_z(self) -> np.ndarray:
        """Log Z by lane."""
        return self._forward[1] if self._scaled else self.forward_backward()[2]

    def marginals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(label) by position, P(previous, label) by position (0 at the first), log Z by lane."""
        inner, steps = self.inner, self.steps
        pair = np.zeros((self.size, self.y_size, self.y_size))
        if self._scaled:
            u, b = self._scaled[:2]
            forward, z = self._forward
            backward = np.ones((self.size, self.y_size))
            weighed = np.empty((self.size, self.y_size))  # u times backward
            for t in range(len(steps) - 2, -1, -1):
                a, end = steps[t], steps[t + 1]
                if t + 2 < len(steps):
                    n = steps[t + 2] - end
                    now = np.einsum("cij,cj->ci", b[end : end + n], weighed[end : end + n])
                    now /= now.max(1)[:, None]
                    backward[a : a + n] = now
                np.multiply(u[a:end], backward[a:end], out=weighed[a:end])
            single = np.empty((self.size, self.y_size))
            single[self.step] = forward * backward
            single /= single.sum(1)[:, None]
            first = steps[1]
            if first < self.size:
                before = np.concatenate([np.arange(steps[t - 1], steps[t - 1] + steps[t + 1] - steps[t]) for t in range(1, len(steps) - 1)])
                both = forward[before][:, :, None] * b[first:]
                both *= weighed[first:, None, :]
                both /= both.sum((1, 2))[:, None, None]
                pair[self.step[first:]] = both
            return single, pair, z
        forward, backward, z = self.forward_backward()
        of = np.empty(self.size)
        of[np.concatenate([np.arange(s, s + n) for s, n in zip(self.start, self.length, strict=True)]) if len(self.start) else np.zeros(0, int)] = z.repeat(self.length)
        single = np.exp(forward + backward - of[:, None])
        pair[inner] = np.exp(forward[inner - 1][:, :, None] + self.b[inner] + (self.u[inner] + backward[inner])[:, None, :] - of[inner][:, None, None])
        return single, pair, z

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """P(label) by position, log Z by lane."""
        single, _, z = self.marginals()
        return single, z

    def gold_scores(self) -> np.ndarray:
        """Score of the gold labels by lane, nan where one is not known."""
        gold, unknown = np.maximum(self.gold, 0), np.concatenate(([0], np.cumsum(self.gold < 0)))
        own = self.u[np.arange(self.size), gold]
        at = self.inner
        own[at] += self.b[at, gold[at - 1], gold[at]]
        sums, end = np.concatenate(([0.0], np.cumsum(own))), self.start + self.length
        return np.where(unknown[end] > unknown[self.start], np.nan, sums[end] - sums[self.start])

    def add_expected(self, total: tuple[np.ndarray, np.ndarray]) -> float:
        """Adds the expected counts of labels by observation, and of pairs by observation that has them, to total; returns the negative log-likelihood."""
        single, pair, z = self.marginals()
        for given, rows, values, at in ((total[0], self.u_obs, single, self.u_rows_at), (total[1], self.b_row, pair.reshape(self.size, -1), self.b_rows_at)):
            for k in range(values.shape[1]):
                given[:, k] += np.bincount(rows, weights=values[:, k][at], minlength=len(given))
        return float((z - self.gold_scores()).sum())

    def expected(self, size: int) -> tuple[np.ndarray, float]:
        """Expected counts of all weights, and the negative log-likelihood."""
        total = counters(self.w)
        loss = self.add_expected(total)
        out = np.zeros(size)
        f, v = sparse(self.w, total)
        out[f] = v
        return out, loss

    def errors(self) -> np.ndarray:
        """Wrong and all labelled positions, wrong and all sequences with them, of the best labels against the gold ones."""
        path = self.viterbi()[0]
        wrong = np.concatenate(([0], np.cumsum((path != self.gold) & self.fits)))
        bad = wrong[self.begin + self.n] - wrong[self.begin]
        return np.array([bad.sum(), self.fits.sum(), np.count_nonzero(bad), len(self.n)], float)


def counters(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Zeros for add_expected."""
    return np.zeros_like(w.u), np.zeros_like(w.b[0])


def sparse(w: Weights, total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights with their counts, those that are zero left out."""
    parts = []
    for counts, off in ((total[0], w.uoff), (total[1], w.boff[w.boff >= 0])):
        row, k = np.nonzero(counts)
        parts.append((off[row] + k, counts[row, k]))
    f, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    return f, v


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _lane_values(b: Batch, values: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows)
    out[b.lanes] = values
    return out


def _reading(encoded: DataFrame) -> tuple[DataFrame, Callable]:
    """The table that holds encoded's sequences, and a function that gives a task its batches and what Batch has of them."""
    kept = getattr(encoded, "_windows", None)
    if kept is not None:
        return kept.rows, kept.reader()

    def read(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[tuple[pa.RecordBatch, Batch]]:
        for batch in sized(batches):
            yield batch, Batch(batch, weights)

    return encoded, read


def potentials(encoded: DataFrame, weights: Weights) -> DataFrame:
    """(sent_id, u, b): summed weights of each label, and of each pair (previous, label) in rows of labels, at each position."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    rows, read = _reading(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in read(batches, sent.value):
            cuts = np.concatenate(([0], np.cumsum(b.n))).astype(np.int32)
            inner = [pa.ListArray.from_arrays(np.arange(b.size + 1, dtype=np.int32) * wide, pa.array(x.ravel())) for x, wide in ((b.u, b.y_size), (b.b, b.y_size**2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(cuts, x) for x in inner]], names=["sent_id", "u", "b"])

    return rows.mapInArrow(run, "sent_id long, u array<array<double>>, b array<array<double>>")


def _sums(b: Batch, values: np.ndarray) -> np.ndarray:
    """Sums of values by position over the positions of each row; 0 where it has none."""
    out, held = np.zeros((len(b.n), values.shape[1])), b.n > 0
    if held.any():
        out[held] = np.add.reduceat(values, b.begin[held], axis=0)
    return out


def summed_potentials(encoded: DataFrame, weights: Weights) -> DataFrame:
    """(sent_id, u, into): summed potentials of each label over all positions, and of the pairs that end in each label over all but the first."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    rows, read = _reading(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in read(batches, sent.value):
            into = b.b.sum(1)
            into[b.start] = 0
            parts = [pa.FixedSizeListArray.from_arrays(pa.array(_sums(b, x).ravel()), b.y_size).cast(pa.list_(pa.float64())) for x in (b.u, into)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names=["sent_id", "u", "into"])

    return rows.mapInArrow(run, "sent_id long, u array<double>, into array<double>")


def tagged(encoded: DataFrame, weights: Weights) -> DataFrame:
    """(sent_id, score, tags): score of the best label sequence, and its labels as one string."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    rows, read = _reading(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in read(batches, sent.value):
            path, score, _ = b.viterbi()
            names = pa.array(sent.value.labels, pa.string()).take(pa.array(path))
            cuts = pa.array(np.concatenate(([0], np.cumsum(b.n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_lane_values(b, score, batch.num_rows)), pc.binary_join(pa.ListArray.from_arrays(cuts, names), "")], names=["sent_id", "score", "tags"])

    return rows.mapInArrow(run, "sent_id long, score double, tags string")


def certainties(encoded: DataFrame, weights: Weights) -> DataFrame:
    """(sent_id, log_z, certainty, middle): log Z, the most likely label's probability on average, and each label's at position n / 2; null where there is no position."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    rows, read = _reading(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in read(batches, sent.value):
            single, z = b.singles()
            held = b.n > 0
            top = np.full(len(b.n), np.nan)
            top[held] = _sums(b, single.max(1)[:, None])[held, 0] / b.n[held]
            cuts = pa.array(np.concatenate(([0], np.cumsum(np.where(held, b.y_size, 0)))).astype(np.int32))
            middle = pa.ListArray.from_arrays(cuts, pa.array(single[(b.begin + b.n // 2)[held]].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_lane_values(b, z, batch.num_rows)), pa.array(top, from_pandas=True), middle], names=["sent_id", "log_z", "certainty", "middle"])

    return rows.mapInArrow(run, "sent_id long, log_z double, certainty double, middle array<double>")


def counted(encoded: DataFrame) -> DataFrame:
    """(obs_id, n): positions that have each observation."""
    kept = getattr(encoded, "_windows", None)
    if kept is not None:
        return kept.counted()
    return encoded.select(F.explode("obs").alias("obs_id")).groupBy("obs_id").agg(F.count("*").alias("n"))


def decode(encoded: DataFrame, weights: Weights) -> DataFrame:
    """(sent_id, score, path): the best label sequence with each position's own score."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    rows, read = _reading(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in read(batches, sent.value):
            path, score, own = b.viterbi()
            names = pa.array(sent.value.labels, pa.string()).take(pa.array(path))
            cuts = np.concatenate(([0], np.cumsum(b.n))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([names, pa.array(own)], names=["label", "score"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_lane_values(b, score, batch.num_rows)), pa.ListArray.from_arrays(cuts, pairs)], names=["sent_id", "score", "path"])

    return rows.mapInArrow(run, "sent_id long, score double, path array<struct<label:string,score:double>>")


def posteriors(encoded: DataFrame, weights: Weights) -> DataFrame:
    """(sent_id, log_z, p): probability of each label at each position."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    rows, read = _reading(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in read(batches, sent.value):
            single, z = b.singles()
            inner = pa.ListArray.from_arrays(np.arange(b.size + 1, dtype=np.int32) * b.y_size, pa.array(single.ravel()))
            cuts = np.concatenate(([0], np.cumsum(b.n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_lane_values(b, z, batch.num_rows)), pa.ListArray.from_arrays(cuts, inner)], names=["sent_id", "log_z", "p"])

    return rows.mapInArrow(run, "sent_id long, log_z double, p array<array<double>>")


def losses(encoded: DataFrame, weights: Weights) -> DataFrame:
    """(sent_id, loss): negative log-likelihood of the gold labels, null where one is null or not known."""
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    rows, read = _reading(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in read(batches, sent.value):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_lane_values(b, b.log_z() - b.gold_scores(), batch.num_rows), from_pandas=True)], names=["sent_id", "loss"])

    return rows.mapInArrow(run, "sent_id long, loss double")


def measured(encoded: DataFrame, weights: Weights, gradient: bool = True, decoded: bool = True) -> tuple[np.ndarray, float, tuple[float, float]]:
    """Expected counts of all weights, the loss, and the token and sentence error of decoding, over all sequences in one pass.

    Tasks send sparse partial sums. Without gradient the counts and the loss stay zero, and the errors where nothing is decoded.
    """
    size = len(weights.theta)
    sent = encoded.sparkSession.sparkContext.broadcast(weights)
    rows, read = _reading(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        total, loss, errors = counters(w), 0.0, np.zeros(4)
        for _, b in read(batches, w):
            if decoded:
                errors += b.errors()
            if gradient:
                loss += b.add_expected(total)
        f, v = sparse(w, total)
        for a in range(0, len(f), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(f[a : a + 100_000]), pa.array(v[a : a + 100_000])], names=["f", "v"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, -6, -1)), pa.array(np.concatenate(([loss], errors)))], names=["f", "v"])

    got = rows.mapInArrow(run, "f long, v double").groupBy("f").agg(F.sum("v").alias("v")).toPandas()
    sent.unpersist()
    f, v = got["f"].to_numpy(), got["v"].to_numpy()
    out = np.zeros(size)
    out[f[f >= 0]] = v[f >= 0]
    loss, bad, tokens, bad_sequences, sequences = np.bincount(-1 - f[f < 0], weights=v[f < 0], minlength=5)
    return out, float(loss), (float(bad / tokens) if tokens else 0.0, float(bad_sequences / sequences) if sequences else 0.0)


def expectation(encoded: DataFrame, weights: Weights) -> tuple[np.ndarray, float]:
    """Expected counts of all weights and the loss, summed over all sequences."""
    return measured(encoded, weights)[:2]
