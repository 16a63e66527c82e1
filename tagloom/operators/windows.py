"""Sequences kept as texts, and what templates read around their positions, by distinct windows.

Where a sequence is a line of characters, (sent_id, text, tags) says all of it in two bytes
a position or so, where its observations' ids are some hundred. So nothing larger is
written: a task that needs observations takes texts, finds the distinct windows of a batch
(the cells that any template reads), and works on those; a position only points to its window.

A cell is a number: its code point, or FIRST_MARK and more for a mark outside the sequence. A
template's cells side by side (21 bits each, so three at most) are the key that stands for
its observation. Strings are made from distinct keys only, by the columns of templates.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.storage import materialize
from tagloom.operators import inference
from tagloom.operators.inference import Batch, Weights, _lists, sized
from tagloom.operators.templates import Macro, Template, _observation, mark

FIRST_MARK, CELL_BITS = 0x110000, 21
MARKS = [mark(sign, d) for sign in "-+" for d in range(1, 6)]
#: Positions of a batch whose windows are counted (some 150 bytes each), and entries that a task gathers before it sends them.
COUNTED, GATHERED = 500_000, 400_000
#: Positions that a task labels at once (some 300 bytes each); a longer sequence is alone.
STEPPED = 300_000
#: Entries up to which a template's ids are a table over its cells, not a search.
TABLE = 1 << 21


def cells_of(template: Template) -> list[Macro]:
    """Distinct cells that a template reads, one macro for each."""
    return list({(m.absolute, m.offset, m.column): m for m in template.items if isinstance(m, Macro)}.values())


def fits(templates: list[Template]) -> bool:
    return all(len(cells_of(t)) * CELL_BITS < 64 and t.columns <= 1 for t in templates)


def texts_of(sequences: DataFrame) -> DataFrame | None:
    """(sent_id, text, tags) of sequences whose cells are the characters of a text and whose labels are single characters; None for others."""
    return None if sequences.isStreaming else getattr(sequences, "_texts", None)


class Texts:
    """Code points of a batch of texts, sequence by sequence, and the windows around them."""

    def __init__(self, texts: pa.Array, cells: list[Macro]):
        joined = b"".join(texts.to_pylist() if pa.types.is_binary(texts.type) else texts.cast(pa.binary()).to_pylist()).decode()
        self.points = np.frombuffer(joined.encode("utf-32-le"), np.int32)
        self.cells = cells

    def split(self, n: np.ndarray) -> Texts:
        self.n, self.begin = n, np.cumsum(n) - n
        self.t = (np.arange(len(self.points)) - self.begin.repeat(n)).astype(np.int32)
        present = np.zeros(FIRST_MARK + len(MARKS), bool)
        present[self.points] = True
        present[FIRST_MARK:] = True
        self.alphabet = np.flatnonzero(present)
        dense = (np.cumsum(present) - 1).astype(np.int32)
        self.dense, self.first_mark, self.wide = dense[self.points], int(dense[FIRST_MARK]), len(self.alphabet)
        return self

    def _cell(self, m: Macro) -> np.ndarray:
        """Place in the alphabet of what a macro reads, by position."""
        n = self.n
        if m.absolute:
            far = abs(m.offset) - n  # how far outside, by sequence
            at = self.begin + (m.offset - 1 if m.offset > 0 else n + m.offset)
            out = self.dense[np.where(far > 0, self.begin, np.minimum(at, len(self.points) - 1))]
            side = 5 if m.offset > 0 else 0
            out = np.where(far > 0, self.first_mark + side + np.minimum(far, 5) - 1, out)
            return (out if m.offset else np.full(len(n), self.first_mark)).repeat(n)
        if m.offset == 0:
            return self.dense
        out = np.empty_like(self.dense)
        k = min(abs(m.offset), len(out))
        if m.offset < 0:
            out[k:] = self.dense[: len(out) - k]
            outside = np.flatnonzero(self.t < k if k == -m.offset else self.t >= 0)
            out[outside] = self.first_mark + np.minimum(-m.offset - self.t[outside], 5) - 1
        else:
            out[: len(out) - k] = self.dense[k:]
            left = (n.repeat(n) - self.t).astype(np.int32)  # positions from here to the end, this one too
            outside = np.flatnonzero(left <= m.offset)
            out[outside] = self.first_mark + 5 + np.minimum(m.offset - left[outside] + 1, 5) - 1
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each position's window, a position of each window (its first), and the windows' cells as numbers (window, cell)."""
        if not len(self.points) or not self.cells:
            of = np.zeros(len(self.points), np.int64)
            return of, np.zeros(min(len(of), 1), np.int64), np.zeros((min(len(of), 1), 0), np.int64)
        key, size, read = np.zeros(len(self.points), np.int64), 1, []
        for m in self.cells:
            cell = self._cell(m)
            read.append(cell)
            if size * self.wide >= 1 << 62:
                key, found = pd.factorize(key)
                size = len(found)
            key = key * self.wide + cell
            size *= self.wide
        of, found = pd.factorize(key)
        first = np.empty(len(found), np.int64)
        first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        return of, first, np.stack([self.alphabet[cell[first]] for cell in read], axis=1)


class Reader:
    """Keys of templates from the cells of windows."""

    def __init__(self, templates: list[Template]):
        own = [cells_of(t) for t in templates]
        distinct = {(m.absolute, m.offset, m.column): m for cells in own for m in cells}
        at = {key: k for k, key in enumerate(distinct)}
        self.cells = list(distinct.values())
        self.columns = [[at[m.absolute, m.offset, m.column] for m in cells] for cells in own]

    def key(self, k: int, cells: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cells), np.int64)
        for c in self.columns[k]:
            out = out << CELL_BITS | cells[:, c]
        return out


def _merged(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Entries (template, key, number, sequence, position), equal templates and keys put together."""
    k, key, n, s, t = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((t, s, key, k))
    k, key, n, s, t = k[order], key[order], n[order], s[order], t[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(k) != 0)))) if len(k) else np.zeros(0, np.int64)
    return k[first], key[first], np.add.reduceat(n, first) if len(first) else n, s[first], t[first]


_NO_ID = np.iinfo(np.int64).max


def entries(texts: DataFrame, templates: list[Template]) -> DataFrame:
    """(k, key, obs, n, first): distinct keys of each template, the number of positions that have them, and first as templates.distinct has it."""
    reader = Reader(templates)

    def sent(parts: list[tuple]) -> pa.RecordBatch:
        k, key, n, s, t = parts[0]
        rows = []
        for c in range(3):
            # the cells of a key from its front; a template with fewer cells has its own at the end
            rows.append(key >> CELL_BITS * (2 - c) & (1 << CELL_BITS) - 1)
        codes, at = np.unique(np.concatenate(rows), return_inverse=True)
        names = pa.array([MARKS[x - FIRST_MARK] if x >= FIRST_MARK else chr(x) for x in codes.tolist()], pa.string())
        cells = [names.take(pa.array(x)) for x in np.split(at, 3)]
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(key), *cells, pa.array(n), pa.array(s, mask=s == _NO_ID), pa.array(t.astype(np.int32))], names=["k", "key", "c0", "c1", "c2", "n", "s", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0
        for batch in sized(batches, 1, COUNTED):
            ids = batch.column(0).fill_null(_NO_ID).to_numpy()
            batch, ids = batch.take(pa.array(order := np.argsort(ids, kind="stable"))), ids[order]  # a window's first position is then the first of all
            texts = Texts(batch.column(2), reader.cells).split(batch.column(1).to_numpy().astype(np.int64))
            of, first, cells = texts.windows()
            n, s, t = np.bincount(of, minlength=len(first)), ids.repeat(texts.n)[first], texts.t[first]
            for k in range(len(templates)):
                group, keys = pd.factorize(reader.key(k, cells))
                begin = np.empty(len(keys), np.int64)
                begin[group[::-1]] = np.arange(len(group) - 1, -1, -1)
                parts.append((np.full(len(keys), k), keys, np.bincount(group, weights=n, minlength=len(keys)).astype(np.int64), s[begin], t[begin]))
                held += len(keys)
            if held > GATHERED:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > GATHERED // 2:
                    yield sent(parts)
                    parts, held = [], 0
        if parts:
            yield sent([_merged(parts)])

    got = texts.select("sent_id", F.char_length("text").alias("n"), "text").mapInArrow(run, "k int, key long, c0 string, c1 string, c2 string, n long, s long, t int")
    place = (F.col("s").cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + F.col("t")).cast("decimal(30,0)")
    got = got.groupBy("k", "key", "c0", "c1", "c2").agg(F.sum("n").alias("n"), F.min(place).alias("p"))
    obs = F.lit(None).cast("string")
    for k, t in enumerate(templates):
        own = cells_of(t)
        names = {(m.absolute, m.offset, m.column): f"c{3 - len(own) + c}" for c, m in enumerate(own)}
        obs = F.when(F.col("k") == k, _observation(t, {x: F.col(x) for x in names.values()}, names)).otherwise(obs)
    return got.select("k", "key", obs.alias("obs"), "n", (F.col("p") * F.lit(10_000).cast("decimal(5,0)") + F.col("k")).cast("decimal(36,0)").alias("first"))


@dataclass
class Coder:
    """What a worker needs to read texts: templates, ids of their keys (sorted by key), labels."""

    templates: list[str]
    keys: list[np.ndarray]
    ids: list[np.ndarray]
    labels: list[str]

    def __getstate__(self):
        return {f: getattr(self, f) for f in ("templates", "keys", "ids", "labels")}

    @cached_property
    def reader(self) -> Reader:
        from tagloom.operators.templates import parse

        return Reader([parse(t) for t in self.templates])

    @cached_property
    def tag_ids(self) -> np.ndarray:
        out = np.full(FIRST_MARK, -1, np.int64)
        for k, x in enumerate(self.labels):
            if len(x) == 1:
                out[ord(x)] = k
        return out

    @cached_property
    def _tables(self) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """Places of the cells in the alphabet of all known keys (its size for others), and each template's ids over those places where that is not too large."""
        mask = (1 << CELL_BITS) - 1
        known = [np.unique(np.concatenate([keys >> CELL_BITS * c & mask for c in range(len(columns))])) for keys, columns in zip(self.keys, self.reader.columns, strict=True) if columns]
        alphabet = np.unique(np.concatenate(known)) if known else np.zeros(0, np.int64)
        place = np.full(1 << CELL_BITS, len(alphabet), np.int64)
        place[alphabet] = np.arange(len(alphabet))
        wide, tables = len(alphabet) + 1, []
        for keys, ids, columns in zip(self.keys, self.ids, self.reader.columns, strict=True):
            if wide ** len(columns) > TABLE:
                tables.append(None)
                continue
            at = np.zeros(len(keys), np.int64)
            for c in range(len(columns) - 1, -1, -1):
                at = at * wide + place[keys >> CELL_BITS * c & mask]
            table = np.full(wide ** len(columns), -1, np.int64)
            table[at] = ids
            tables.append(table)
        return place, tables

    def observations(self, cells: np.ndarray) -> np.ndarray:
        """(window, template): ids of observations, -1 for those that are not known."""
        out = np.empty((len(cells), len(self.keys)), np.int64)
        place, tables = self._tables
        placed, wide = place[cells], int(place[-1]) + 1
        for k, (keys, ids, table) in enumerate(zip(self.keys, self.ids, tables, strict=True)):
            if table is not None:
                at = np.zeros(len(cells), np.int64)
                for c in self.reader.columns[k]:
                    at = at * wide + placed[:, c]
                out[:, k] = table[at]
            elif len(keys):
                asked = self.reader.key(k, cells)
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                out[:, k] = np.where(keys[at] == asked, ids[at], -1)
            else:
                out[:, k] = -1
        return out


class TextBatch(Batch):
    """A batch of (sent_id, n, text, tags): what Batch has, from windows. Where all windows have the same pair potentials, those are kept once."""

    def __init__(self, batch: pa.RecordBatch, coder: Coder, w: Weights):
        self.n = batch.column(1).to_numpy().astype(np.int64)
        self.y_size = size = len(w.labels)
        self.begin = np.cumsum(self.n) - self.n
        self.size = int(self.n.sum())
        self.w, self.ones = w, np.ones(size)
        self.of, _, cells = Texts(batch.column(2), coder.reader.cells).split(self.n).windows()
        self.obs = coder.observations(cells)
        own = np.where(self.obs >= 0, w.uoff[self.obs], -1) >= 0 if len(w.uoff) else np.zeros(self.obs.shape, bool)
        self.window_u = np.zeros((len(self.obs), size))
        for k in range(self.obs.shape[1]):
            self.window_u += np.where(own[:, k, None], w.u[np.where(own[:, k], self.obs[:, k], 0)], 0.0) if own[:, k].any() else 0.0
        self.u_own = own
        pair, row = w.b
        self.b_rows = np.where(self.obs >= 0, row[self.obs], -1) if len(row) else np.full(self.obs.shape, -1)
        kinds, self.kind = np.unique(self.b_rows, axis=0, return_inverse=True) if len(self.b_rows) > 1 and (self.b_rows != self.b_rows[0]).any() else (self.b_rows[:1], np.zeros(len(self.b_rows), np.int64))
        self.kind_rows = kinds
        sums = np.zeros((len(kinds), size * size))
        for k in range(kinds.shape[1]):
            held = kinds[:, k] >= 0
            sums[held] += pair[kinds[held, k]]
        sums = sums.reshape(-1, size, size)
        self.one = sums[0] if len(sums) == 1 else np.zeros((size, size)) if not len(sums) else None
        self.b = np.broadcast_to(self.one, (self.size, size, size)) if self.one is not None else sums[self.kind.ravel()[self.of]]
        tags = b"".join(batch.column(3).cast(pa.binary()).to_pylist()).decode() if batch.num_columns > 3 else ""
        self.gold = coder.tag_ids[np.frombuffer(tags.encode("utf-32-le"), np.int32)] if tags else np.full(self.size, -1)
        self.fits = np.full(self.size, bool(tags))
        self.lanes = np.argsort(-self.n, kind="stable")
        self.lanes = self.lanes[self.n[self.lanes] > 0]
        self.start, self.length = self.begin[self.lanes], self.n[self.lanes]
        live = np.searchsorted(-self.length, -np.arange(int(self.length[0]) if len(self.length) else 0), "left")
        self.steps = np.concatenate(([0], np.cumsum(live))).tolist()
        inner = np.ones(self.size, bool)
        inner[self.start] = False
        self.inner = np.flatnonzero(inner)

    @cached_property
    def u(self) -> np.ndarray:
        return self.window_u[self.of]

    @cached_property
    def step(self) -> np.ndarray:
        live = np.diff(self.steps)
        lane = np.arange(self.size) - np.repeat(self.steps[:-1], live)
        return self.start[lane] + np.repeat(np.arange(len(live)), live)

    def viterbi(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.one is None or not self.size:
            return super().viterbi()
        size, steps = self.y_size, self.steps
        u, back = self.u[self.step], np.zeros((self.size, size), np.int8 if size < 128 else np.int64)
        value = self.u[self.start].copy()
        for t in range(1, len(steps) - 1):
            a, z = steps[t], steps[t + 1]
            now, before = u[a:z], value[: z - a]
            best, came = before[:, :1] + (self.one[0] + now), back[a:z]
            for i in range(1, size):
                score = before[:, i : i + 1] + (self.one[i] + now)
                higher = score > best
                np.copyto(came, i, where=higher)
                np.maximum(best, score, out=best)
            value[: z - a] = best
        state = value.argmax(1)
        found = np.zeros(self.size, np.int64)
        for t in range(len(steps) - 2, -1, -1):
            a, z = steps[t], steps[t + 1]
            found[a:z] = state[: z - a]
            if t:
                state[: z - a] = back[np.arange(a, z), state[: z - a]]
        path = np.zeros(self.size, np.int64)
        path[self.step] = found
        own = self.u[np.arange(self.size), path]
        own[self.inner] += self.one[path[self.inner - 1], path[self.inner]]
        return path, value.max(1), own

    @cached_property
    def _scaled(self):
        if self.one is None or not self.size:
            return super()._scaled
        top = self.window_u.max(1)
        if (top - self.window_u.min(1)).max() > inference.SCALED_SPREAD or np.ptp(self.one) > inference.SCALED_SPREAD:
            return None
        return np.exp(self.window_u - top[:, None])[self.of[self.step]], np.exp(self.one - self.one.max()), top[self.of], self.one.max()

    @cached_property
    def _forward(self) -> tuple[np.ndarray, np.ndarray]:
        if self.one is None:
            return super()._forward
        u, b, u_top, b_top = self._scaled
        steps = self.steps
        forward, total = np.empty((self.size, self.y_size)), np.empty(self.size)
        for t in range(len(steps) - 1):
            a, z = steps[t], steps[t + 1]
            now = u[a:z] * (forward[steps[t - 1] : steps[t - 1] + z - a] @ b) if t else u[a:z]
            np.matmul(now, self.ones, out=total[a:z])
            np.divide(now, total[a:z, None], out=forward[a:z])
        logs = np.empty(self.size)
        logs[self.step] = np.log(total)
        logs += u_top + b_top
        logs[self.start] -= b_top
        sums = np.concatenate(([0.0], np.cumsum(logs)))
        return forward, sums[self.start + self.length] - sums[self.start]

    def _sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """In order of the steps: forward and backward shares, u times backward, and the places before those of later steps."""
        u, b = self._scaled[:2]
        steps = self.steps
        backward, weighed, across = np.ones((self.size, self.y_size)), np.empty((self.size, self.y_size)), b.T.copy()
        for t in range(len(steps) - 2, -1, -1):
            a, end = steps[t], steps[t + 1]
            if t + 2 < len(steps):
                n = steps[t + 2] - end
                now = weighed[end : end + n] @ across
                np.divide(now, (now @ self.ones)[:, None], out=backward[a : a + n])
            np.multiply(u[a:end], backward[a:end], out=weighed[a:end])
        live = np.diff(steps)
        before = np.arange(steps[1], self.size) - np.repeat(live[:-1], live[1:])
        return self._forward[0], backward, weighed, before

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        if self.one is None or not self.size or not self._scaled:
            return super().singles()
        forward, backward, _, _ = self._sides()
        single = np.empty((self.size, self.y_size))
        single[self.step] = forward * backward
        single /= (single @ self.ones)[:, None]
        return single, self._forward[1]

    def marginals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.one is None or not self.size or not self._scaled:
            return super().marginals()
        forward, backward, weighed, before = self._sides()
        single, pair = np.empty((self.size, self.y_size)), np.zeros((self.size, self.y_size, self.y_size))
        single[self.step] = forward * backward
        single /= (single @ self.ones)[:, None]
        first = self.steps[1]
        both = forward[before][:, :, None] * self._scaled[1] * weighed[first:, None, :]
        both /= both.sum((1, 2))[:, None, None]
        pair[self.step[first:]] = both
        return single, pair, self._forward[1]

    def _add(self, total: tuple[np.ndarray, np.ndarray], single: np.ndarray, pairs: np.ndarray) -> None:
        """Adds sums by window (window, label) and by kind of pair potentials (kind, pair) to the observations that have them."""
        window, at = np.nonzero(self.u_own)[0], self.obs[self.u_own]
        for y in range(self.y_size):
            total[0][:, y] += np.bincount(at, weights=single[window, y], minlength=len(total[0]))
        for rows in self.kind_rows.T:
            np.add.at(total[1], rows[rows >= 0], pairs[rows >= 0])

    def add_expected(self, total: tuple[np.ndarray, np.ndarray]) -> float:
        if not self.size:
            return 0.0
        if self.one is None or not self._scaled:
            single, pair, z = self.marginals()
            kind = self.kind.ravel()[self.of]
            pairs = np.stack([np.bincount(kind, weights=x, minlength=len(self.kind_rows)) for x in pair.reshape(self.size, -1).T], axis=1)
        else:
            forward, backward, weighed, before = self._sides()
            z, b, first = self._forward[1], self._scaled[1], self.steps[1]
            single = np.empty((self.size, self.y_size))
            single[self.step] = forward * backward
            single /= (single @ self.ones)[:, None]
            ahead = forward[before]
            ahead /= np.einsum("ci,ci->c", ahead @ b, weighed[first:])[:, None]
            pairs = (b * (ahead.T @ weighed[first:])).reshape(1, -1)
        self._add(total, np.stack([np.bincount(self.of, weights=x, minlength=len(self.obs)) for x in single.T], axis=1), pairs)
        return float((z - self.gold_scores()).sum())

    def gold_scores(self) -> np.ndarray:
        if self.one is None or (self.gold < 0).any():
            return super().gold_scores()
        own = self.u[np.arange(self.size), self.gold]
        own[self.inner] += self.one[self.gold[self.inner - 1], self.gold[self.inner]]
        sums = np.concatenate(([0.0], np.cumsum(own)))
        return sums[self.start + self.length] - sums[self.start]

    def add_gold(self, total: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds the counts of gold labels by observation, and of pairs by observation that has them, to total."""
        y, at = self.y_size, self.inner
        single = np.bincount(self.of * y + self.gold, minlength=len(self.obs) * y).reshape(-1, y)
        kind = self.kind.ravel()[self.of[at]]
        pairs = np.bincount(kind * y * y + self.gold[at - 1] * y + self.gold[at], minlength=len(self.kind_rows) * y * y).reshape(-1, y * y)
        self._add(total, single, pairs)


@dataclass
class Encoded:
    """Sequences as texts (sent_id, n, text, tags), and what tells their observations; kept beside a table of the form inference.ENCODED."""

    rows: DataFrame
    coder: Coder

    @cached_property
    def sent(self):
        return self.rows.sparkSession.sparkContext.broadcast(self.coder)

    def reader(self):
        """A function that gives a task the batches of its rows and what Batch has of them."""
        sent = self.sent

        def read(batches: Iterator[pa.RecordBatch], w: Weights) -> Iterator[tuple[pa.RecordBatch, TextBatch]]:
            for batch in sized(batches, 1, STEPPED):
                yield batch, TextBatch(batch, sent.value, w)

        return read

    def gold(self, weights: Weights) -> np.ndarray:
        """Counts of all weights in the gold labels."""
        weights, read = self.rows.sparkSession.sparkContext.broadcast(weights), self.reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = weights.value
            total = inference.counters(w)
            for _, b in read(batches, w):
                b.add_gold(total)
            f, v = inference.sparse(w, total)
            for a in range(0, len(f), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(f[a : a + 100_000]), pa.array(v[a : a + 100_000])], names=["f", "v"])

        got = self.rows.mapInArrow(run, "f long, v double").groupBy("f").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(len(weights.value.theta))
        out[got["f"].to_numpy(np.int64)] = got["v"].to_numpy()
        return out

    def counted(self) -> DataFrame:
        """(obs_id, n): positions that have each observation."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = sent.value
            total = np.zeros(1 + max((int(x.max()) for x in coder.ids if len(x)), default=-1), np.int64)
            for batch in sized(batches, 1, COUNTED):
                of, _, cells = Texts(batch.column(2), coder.reader.cells).split(batch.column(1).to_numpy().astype(np.int64)).windows()
                ids, n = coder.observations(cells), np.bincount(of, minlength=len(cells))
                total += np.bincount(ids[ids >= 0], weights=np.broadcast_to(n[:, None], ids.shape)[ids >= 0], minlength=len(total)).astype(np.int64)
            found = np.flatnonzero(total)
            for a in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[a : a + 100_000]), pa.array(total[found[a : a + 100_000]])], names=["obs_id", "n"])

        return self.rows.mapInArrow(run, "obs_id long, n long").groupBy("obs_id").agg(F.sum("n").alias("n"))

    def expanded(self) -> DataFrame:
        """(sent_id, n, at, obs, y), made where it is read."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sized(batches):
                n = batch.column(1).to_numpy().astype(np.int64)
                texts = Texts(batch.column(2), sent.value.reader.cells).split(n)
                of, _, cells = texts.windows()
                ids = sent.value.observations(cells)[of]
                known = ids >= 0
                ends = np.concatenate(([0], np.cumsum(known.sum(1))))
                cuts = pa.array(ends[np.concatenate((texts.begin, [len(of)]))].astype(np.int32))
                tags = b"".join(batch.column(3).cast(pa.binary()).to_pylist()).decode()
                y = sent.value.tag_ids[np.frombuffer(tags.encode("utf-32-le"), np.int32)].astype(np.int32)
                y_cuts = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                at = np.broadcast_to(texts.t[:, None], ids.shape)[known]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cuts, pa.array(at)), pa.ListArray.from_arrays(cuts, pa.array(ids[known])), pa.ListArray.from_arrays(y_cuts, pa.array(y))], names=["sent_id", "n", "at", "obs", "y"])

        out = self.rows.mapInArrow(run, inference.ENCODED)
        out._windows = self
        return out


def coder_of(known: DataFrame, templates: list[Template], names: list[str]) -> Coder:
    """From known(k, key, obs_id)."""
    rows = known.select("k", "key", "obs_id").toPandas()
    keys, ids = [], []
    for k in range(len(templates)):
        own = rows[rows["k"] == k]
        order = np.argsort(own["key"].to_numpy(np.int64))
        keys.append(own["key"].to_numpy(np.int64)[order])
        ids.append(own["obs_id"].to_numpy(np.int64)[order])
    return Coder([t.source for t in templates], keys, ids, names)


def stored(texts: DataFrame) -> DataFrame:
    """(sent_id, n, text, tags), those of equal lengths together in each part."""
    rows = texts.select("sent_id", F.char_length("text").alias("n"), "text", "tags").sortWithinPartitions("n", "sent_id")
    return materialize(rows, "encoded", "zstd")
