"""A model in one process: features, labels and segmentation of single texts without a Spark job.

Serves the interactive command line on the driver and the SQL function on the workers.
The dictionary and the weights are held whole, so models are taken up to
LOCAL_OBSERVATIONS observations; larger ones label by their joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from tagloom.operators.inference import Batch, Lookup, Weights, sized
from tagloom.operators.templates import Macro, Template, mark, parse, to_pattern

#: Observations (some hundred bytes each with their weights) of a model that one process holds.
LOCAL_OBSERVATIONS = 5_000_000
_SPACE = re.compile("[ \t-\r]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def _reader(item: str | Macro):
    """A function of (rows, position) that gives a template item's text."""
    if isinstance(item, str):
        return lambda rows, t: item

    def cell(rows: list[list[str]], t: int) -> str:
        if item.absolute:
            at = item.offset - 1 if item.offset > 0 else -1 if item.offset == 0 else len(rows) + item.offset
        else:
            at = t + item.offset
        if at < 0:
            return mark("-", -at)
        return mark("+", at - len(rows) + 1) if at >= len(rows) else rows[at][item.column]

    if item.type == "x":
        read = cell
    else:
        pattern = re.compile(to_pattern(item.pattern or ""))
        if item.type == "t":
            read = lambda rows, t: "true" if pattern.search(cell(rows, t)) else "false"
        else:
            read = lambda rows, t: m[0] if (m := pattern.search(cell(rows, t))) else ""
    return (lambda rows, t: read(rows, t).translate(_UPPER)) if item.lower else read


class LocalModel:
    """Templates, dictionary and weights of a model."""

    def __init__(self, templates: list[str], known: Lookup, weights: Weights):
        self.templates, self.known, self.weights = templates, known, weights

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("templates", "known", "weights")}

    @staticmethod
    def of(model) -> LocalModel:
        """A CrfModel's tables, gathered once."""
        n = model.layout.count()
        if n > LOCAL_OBSERVATIONS:
            raise ValueError(f"the model has {n} observations; one process takes {LOCAL_OBSERVATIONS}")
        rows = model.layout.orderBy("obs_id").select("obs_id", "obs").toPandas()
        return LocalModel([t.source for t in model.templates], Lookup(rows["obs"].tolist(), rows["obs_id"].to_numpy(np.int64)), model.arrays())

    @cached_property
    def _readers(self) -> list[list]:
        parsed: list[Template] = [parse(t) for t in self.templates]
        return [[_reader(i) for i in t.items] for t in parsed]

    def observations(self, rows: list[list[str]]) -> list[list[str]]:
        """Observations of each position, in the order of the templates."""
        return [["".join(read(rows, t) for read in items) for items in self._readers] for t in range(len(rows))]

    def label(self, sequences: list[list[list[str]]]) -> list[list[str]]:
        """Best labels of sequences of rows."""
        names, found = np.array(self.weights.labels, object), []
        for batch in self._batches(sequences):
            b = Batch(batch, self.weights)
            path = names[b.viterbi()[0]]
            found += [path[a : a + n].tolist() for a, n in zip(b.begin.tolist(), b.n.tolist(), strict=True)]
        return found

    def _batches(self, sequences: list[list[list[str]]]) -> Iterator[pa.RecordBatch]:
        """Encoded sequences, a thousand at a time and in batches by positions."""

        def encoded() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(sequences), 1000):
                part = sequences[a : a + 1000]
                n = np.array([len(s) for s in part])
                flat = [o for s in part for o in self.observations(s)]
                ids = self.known(pa.array([x for o in flat for x in o], pa.string()))
                per = np.array([len(o) for o in flat], np.int64)
                ok = ids >= 0
                place = (np.arange(n.sum()) - (np.cumsum(n) - n).repeat(n)).repeat(per)[ok]
                cuts = np.concatenate(([0], np.cumsum(np.bincount(np.arange(len(n)).repeat(n).repeat(per)[ok], minlength=len(n))))).astype(np.int32)
                none = pa.ListArray.from_arrays(np.zeros(len(n) + 1, np.int32), pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(ids[ok])), none], names=["sent_id", "n", "at", "obs", "y"])

        return sized(encoded())

    def segment(self, texts: list[str | None]) -> list[str]:
        """Texts with a space between words, as CrfModel.segment cuts them; null gives an empty text."""
        parts = [[p for p in _SPACE.split(t or "") if p] for t in texts]
        tags = iter(self.label([[[c] for c in p] for own in parts for p in own]))
        return [" ".join("".join(c + " " if y in ("E", "S") else c for c, y in zip(p, next(tags), strict=True)).rstrip(" ") for p in own) for own in parts]
