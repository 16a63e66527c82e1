"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (1 to 3 characters, all lengths
together) that both contain, divided by the root of each one's own number: a
blended-spectrum presence kernel. N-grams are of lower-cased letters, every run of
other characters being one space. Landmarks from the learning rows span the Nystroem
features K(x, L) K(L, L)^(-1/2); a one-versus-rest kernel ridge regression on them
gives a value per language. Texts are scored many at once: presence of the landmarks'
n-grams as a matrix, times the landmarks' own, times the regression's weights.
N-grams that no landmark has count in a text's own number only.

Learnt from a bounded sample of the learning rows: at most about PER_LANGUAGE of each
language (by hash of doc_id), LANDMARKS of them as landmarks. Every text is scored
whole.

Defined cases: null text, or one without a letter, is `und` with score 0; so is every
text if there is nothing to learn from; equal values go to the language first in code
point order; rows with a null language are scored but not learnt from; a null doc_id
counts as not held out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Rows of each language to learn from, about; and landmarks over all languages.
PER_LANGUAGE, LANDMARKS = 400, 64
#: A landmark is a learning text of this many characters, where there are such.
LANDMARK_CHARS = (300, 20_000)
RIDGE = 1e-3
#: Texts, and characters, in one matrix product.
ROWS, CHARS = 128, 1 << 20
#: Parts of the rows by crc32(doc_id as text); those of HELD_OUT are not learnt from.
FOLDS, HELD_OUT = 4, 2


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """True at the code points of letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def _runs(text: str) -> Iterator[np.ndarray]:
    """Code points of the letters, every run of others one space, in pieces that repeat the last two before them."""
    points, tail = _points(text), np.zeros(0, np.uint32)
    for a in range(0, len(points), CHARS):
        p = points[a : a + CHARS]
        p = np.concatenate((tail, np.where(_letters()[p], p, np.uint32(32))))
        p = p[np.concatenate(([True], (p[1:] != 32) | (p[:-1] != 32)))]
        yield p
        tail = p[-2:]


def distinct_grams(text: str) -> int:
    """Number of different n-grams of a text; a space alone is none."""
    found: list[list[np.ndarray]] = [[], [], []]
    for p in _runs(text):
        p = p.astype(np.uint64)
        two = (p[:-1] << np.uint64(21)) | p[1:]
        for of, keys in zip(found, (p[p != 32], two, (two[:-1] << np.uint64(21)) | p[2:]), strict=True):
            of.append(np.unique(keys))
    return sum(len(of[0]) if len(of) == 1 else len(np.unique(np.concatenate(of))) for of in found if of)


@dataclass
class Kernel:
    """N-grams of the landmarks, found through tables: character, then pairs, then pair and character."""

    points: np.ndarray  # sorted code points with a code of their own (from 2; 1: not a letter; 0: another letter)
    pairs: np.ndarray  # code, code -> number of the pair from 1, 0 for none
    triples: np.ndarray  # pair, code -> number of the triple from 1
    grams: np.ndarray  # n-gram, landmark -> 1 if it has it
    sizes: np.ndarray  # n-grams of each landmark

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.points, points)
        at[at == len(self.points)] = 0
        return np.where(self.points[at] == points, at + 2, np.where(_letters()[points], 0, 1))

    def presence(self, texts: list[str]) -> np.ndarray:
        """One row a text: which n-grams of the landmarks it contains."""
        k, n2 = self.pairs.shape[0], int(self.pairs.max(initial=0))
        width = k + n2 + int(self.triples.max(initial=0))
        out = np.zeros((len(texts), width), np.uint8)
        table = self._table()
        for i, text in enumerate(texts):
            row = out[i]
            for points in _runs(text):
                c = table[points]
                row[c] = 1
                p = self.pairs[c[:-1], c[1:]]
                row[k - 1 + p[p > 0]] = 1
                t = self.triples[p[:-1], c[2:]]
                row[k + n2 - 1 + t[t > 0]] = 1
        out[:, :2] = 0
        return out

    def _table(self) -> np.ndarray:
        if getattr(self, "_codes", None) is None:
            self._codes = self.codes(np.arange(0x110000, dtype=np.uint32)).astype(np.int32)
        return self._codes

    def against(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts with every landmark."""
        x = self.presence(texts).astype(np.float32)
        own = np.maximum(np.array([distinct_grams(t) for t in texts]), 1)
        return (x @ self.grams) / np.sqrt(own[:, None] * self.sizes[None, :])


def kernel_of(texts: list[str]) -> Kernel:
    every = np.unique(np.concatenate([_points(t) for t in texts]))
    points = every[_letters()[every]]
    k = len(points) + 2
    self = Kernel(points, np.zeros((k, k), np.int32), np.zeros((1, k), np.int32), np.zeros((0, 0), np.float32), np.zeros(0))
    pairs, triples = set(), set()
    for t in texts:
        c = self.codes(_points(t))
        c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))].tolist() if len(c) else []
        pairs.update(itertools.pairwise(c))
        triples.update(zip(c, c[1:], c[2:], strict=False))
    for n, (a, b) in enumerate(sorted(pairs), 1):
        self.pairs[a, b] = n
    self.triples = np.zeros((len(pairs) + 1, k), np.int32)
    for n, (a, b, c) in enumerate(sorted(triples), 1):
        self.triples[self.pairs[a, b], c] = n
    self.grams = self.presence(texts).T.astype(np.float32)
    self.sizes = np.maximum(self.grams.sum(0), 1)
    return self


@dataclass
class Model:
    kernel: Kernel
    languages: list[str]
    weights: np.ndarray  # landmark (and one constant), language

    def values(self, texts: list[str]) -> np.ndarray:
        k = self.kernel.against(texts)
        return np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights


def fit(landmarks: list[str], texts: list[str], langs: list[str]) -> Model:
    """One-versus-rest ridge regression on Nystroem features; the map K(L, L)^(-1/2) is folded into the weights."""
    kernel = kernel_of(landmarks)
    values, vectors = np.linalg.eigh(kernel.against(landmarks).astype(float))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    names = sorted(set(langs))
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    k = np.vstack([kernel.against(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]).astype(float)
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    gram = phi.T @ phi + RIDGE * len(phi) * np.diag([1.0] * root.shape[1] + [0.0]) + 1e-9 * np.eye(phi.shape[1])
    w = np.linalg.solve(gram, phi.T @ y)
    return Model(kernel, names, np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32))


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = sent.value
        letters = _letters()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and (t.isascii() and any(map(str.isalpha, t)) or letters[_points(t)].any())] if model else []
            for a in range(0, len(known), ROWS):
                own = known[a : a + ROWS]
                values = model.values([texts[i] for i in own])
                best = values.argmax(1)
                for i, b, v in zip(own, best.tolist(), values, strict=True):
                    lang[i] = model.languages[b]
                    score[i] = float(min(1.0, max(0.0, (v[b] + 1) / 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def learn(docs: DataFrame) -> Model | None:
    """Model from a bounded sample of the rows that are not held out and have a language and a text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    span = 1 << 30
    shares = docs.sparkSession.createDataFrame([(k, int(span * min(1.0, PER_LANGUAGE / n))) for k, n in counts.items()], "lang string, share long")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(span))
    sample = rows.join(F.broadcast(shares), "lang").where(drawn < F.col("share")).select("lang", "text", drawn.alias("draw")).collect()
    letters = _letters()
    sample = sorted((r for r in sample if letters[_points(r.text)].any()), key=lambda r: (r.draw, r.lang, r.text))
    if not sample:
        return None
    names = sorted({r.lang for r in sample})
    marks: list[str] = []
    for name in names:
        own = list(dict.fromkeys(r.text for r in sample if r.lang == name))
        fit_ = [t for t in own if LANDMARK_CHARS[0] <= len(t) <= LANDMARK_CHARS[1]]
        marks += (fit_ or own)[: max(1, LANDMARKS // len(names))]
    return fit(marks, [r.text for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sent = spark.sparkContext.broadcast(learn(docs))
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(sent), "doc_id long, held_out boolean, lang_pred string, score double")
