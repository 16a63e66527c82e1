"""Toxicity by a weighted grammar of composed finite-state transducers.

Words are read as classes: insult, threat, target, negation, reported speech, intent,
other; a clause ends at . ; : ! ? , or a line break. Five small transducers each mark
one relation (in the scope of a negation; after a verb of reporting; near a target;
after an intention; which hit it is), and their composition is one machine over the
classes whose output names the pattern that a hit completes, such as a targeted insult
or a negated threat. A second machine reads those patterns and the targets and marks a
target that follows a hit which nothing cancels: the hit is aimed at it, and counts as one
with a target in front. A colon ends a clause but not the reporting in front of it; a
clause that begins with a reporting verb (behind one word at most) and follows a comma,
a ! or a ? reports the clause before it. A clause weighs what its patterns weigh times its words; a text
is scored by its clauses, so an insult that is denied or quoted counts for what such
clauses are worth in the labelled rows, not for the word.

Learnt from a bounded sample of the labelled rows (LEARN_ROWS at most, by hash of
doc_id; near copies, found by their smallest shingle, count once): further insults in
any language, as words or word beginnings that best tell the labels in texts where no
known hit explains them, each next one chosen for the texts that those before leave
open; then the weights of the patterns, by logistic regression.

Defined cases: null or empty text is scored like any text without a hit; a doc_id
with several labels has the larger one; labels without a text, and a null label or
doc_id, are not learnt from; without both labels to learn from, patterns keep fixed
prior weights; equal rows are scored each; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, shingle_sets, small_batches

#: Labelled rows to learn from, at most about.
LEARN_ROWS = 12_000
#: Learnt insults at most (and candidates for them), the toxic texts one must be in, and how many times the odds of the label it must raise.
LEARNT_WORDS, CANDIDATES, LEARNT_TEXTS, LEARNT_ODDS = 40, 300, 8, 6.0
#: Letters of the word beginnings that are looked at.
STEMS = range(3, 9)
FOLDS, HELD_OUT = 5, 0

# fixed values: word classes of the grammar
CLASSES = {
    "insult": "idiot idiots moron morons scum trash loser losers clown clowns pathetic worthless disgusting stupid dumb imbecile fool filth vermin garbage dumpster coward pig pigs rat rats parasite parasites subhuman retard bastard bitch whore slut "
    "dummkopf abschaum idiotin arschloch verlierer widerlich erbärmlich wertlos imbécile ordure connard salaud minable dégoûtant raclure idiota imbécil basura escoria patético asqueroso inútil payaso perdedor",
    "threat": "kill murder hurt stab shoot destroy strangle beat burn hang töten umbringen erschießen tuer frapper brûler matar golpear quemar",
    "target": "you your you're youre yourself he she him her they them their these those people everyone du dich ihr euch dein sie tu toi vous ton votre ils elles ellos ustedes vosotros él ella",
    "negation": "not no never isn't aren't wasn't don't doesn't didn't won't can't cannot nobody neither nor nicht kein keine nie niemals pas jamais aucun nunca jamás ningún",
    "report": "said says say told called calls claimed claims wrote reported reportedly quoted alleged according shouted sagte nannte behauptete dit appelé dijo llamó",
    "intent": "will gonna going shall should must want wants i'll we'll werde werden soll vais va allons voy vamos quiero",
}
SYMBOLS = ("other", *CLASSES, "learnt")
_HITS = ("insult", "threat", "learnt")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.;:!?,\n]")
_ENDS = frozenset(".;:!?,\n")
#: Words for which a negation, a target or an intention reaches on.
NEGATION_REACH, TARGET_REACH, INTENT_REACH = 3, 4, 3


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step[state][symbol] = (next state, output mark or '')."""

    start: int
    step: tuple[dict[str, tuple[int, str]], ...]


def _countdown(trigger: str, reach: int, mark: str) -> Transducer:
    """Marks hits up to reach words after the trigger class."""
    rows = []
    for left in range(reach + 1):
        row = {}
        for s in SYMBOLS:
            hit = s in _HITS
            row[s] = (reach if s == trigger else max(0, left - 1), mark if hit and left else "")
        rows.append(row)
    return Transducer(0, tuple(rows))


def _latch(trigger: str, mark: str) -> Transducer:
    """Marks every later hit of the clause."""
    return Transducer(0, tuple({s: (1 if s == trigger or on else 0, mark if on and s in _HITS else "") for s in SYMBOLS} for on in (0, 1)))


def _hits() -> Transducer:
    return Transducer(0, ({s: (0, s if s in _HITS else "") for s in SYMBOLS},))


def compose(*parts: Transducer) -> Transducer:
    """One machine for all parts read side by side; its output joins theirs, its states are those that can be reached."""
    start = tuple(p.start for p in parts)
    number, todo, rows = {start: 0}, [start], []
    while todo:
        at = todo.pop(0)
        row = {}
        for s in SYMBOLS:
            moved = [p.step[q][s] for p, q in zip(parts, at, strict=True)]
            to = tuple(m[0] for m in moved)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[s] = (number[to], " ".join(m[1] for m in moved if m[1]))
        rows.append(row)
    return Transducer(0, tuple(rows))


def _aim(reach: int) -> Transducer:
    """Over the patterns of the first machine: marks the first target up to reach words after a hit that stands."""
    rows = [{"hit": (reach, ""), "target": (0, "aimed" if left else ""), "other": (max(0, left - 1), "")} for left in range(reach + 1)]
    return Transducer(0, tuple(rows))


AIM = _aim(TARGET_REACH)
GRAMMAR = compose(_hits(), _countdown("negation", NEGATION_REACH, "negated"), _latch("report", "reported"), _countdown("target", TARGET_REACH, "targeted"), _countdown("intent", INTENT_REACH, "intended"))
PATTERNS = tuple(sorted({out for row in GRAMMAR.step for _, out in row.values() if out}))
#: Groups of patterns that share a weight: the hit, whether it is cancelled, whether it has a target or (a threat) an intention.
#: The first one weighs every attack; targeted insults and intended threats weigh their own group besides, so that rarer kinds share what is learnt of all.
FEATURES = ("insult", "insult targeted", "insult negated", "insult reported", "threat", "threat intended", "threat negated", "threat reported", "learnt", "learnt cancelled", "aimed", "clauses", "any")
_PRIOR = np.array([1.5, 0.5, -0.5, -0.5, 0.2, 0.0, -0.3, -0.3, 0.5, 0.1, 1.0, 0.5, 0.5])
#: What a clause's match is chosen by: the weights of its groups together.
_RANK = _PRIOR + np.array([f in ("insult targeted", "threat intended") for f in FEATURES]) * _PRIOR[0]
_PRIOR_BIAS = -3.0
#: Groups of clauses that count as an attack of a known kind.
_LIVE = [f in ("insult", "insult targeted", "threat intended") for f in FEATURES]


def _group(pattern: str) -> int:
    marks = pattern.split()
    hit = marks[0]
    if hit == "learnt":
        return FEATURES.index("learnt cancelled" if "negated" in marks or "reported" in marks else "learnt")
    if "negated" in marks:
        return FEATURES.index(f"{hit} negated")
    if "reported" in marks:
        return FEATURES.index(f"{hit} reported")
    if hit == "threat":
        return FEATURES.index("threat intended" if "intended" in marks and "targeted" in marks else "threat")
    return FEATURES.index("insult targeted" if "targeted" in marks else "insult")


#: Groups as they are where the clause is reported.
_REPORTED = [FEATURES.index("learnt cancelled" if f.startswith("learnt") else f"{f.split()[0]} reported") if f.split()[0] in _HITS else k for k, f in enumerate(FEATURES)]


@dataclass
class Lexicon:
    """Classes of the words that are not `other`, and the learnt word beginnings."""

    stems: frozenset[str] = frozenset()

    def __post_init__(self):
        self.words = {w: SYMBOLS.index(c) for c, ws in CLASSES.items() for w in ws.split()}
        self.hits = frozenset(w for w, c in self.words.items() if SYMBOLS[c] in _HITS)
        self.sizes = sorted({len(x) for x in self.stems})
        self.heads = frozenset(x[: STEMS[0]] for x in self.stems)
        self.next = [[row[s][0] for s in SYMBOLS] for row in GRAMMAR.step]
        self.reports = ["reported" in row["insult"][1].split() for row in GRAMMAR.step]
        self.after_report = GRAMMAR.step[0]["report"][0]
        self.stands = [[row[s][1] != "" and not {"negated", "reported"} & set(row[s][1].split()) for s in SYMBOLS] for row in GRAMMAR.step]
        self.out = [[_group(row[s][1]) if row[s][1] else -1 for s in SYMBOLS] for row in GRAMMAR.step]
        self.out_aimed = [[_group(row[s][1] + " targeted") if row[s][1] else -1 for s in SYMBOLS] for row in GRAMMAR.step]

    def symbol(self, token: str) -> int:
        c = self.words.get(token, 0)
        if c == 0 and token[: STEMS[0]] in self.heads and any(token[:n] in self.stems for n in self.sizes):
            return len(SYMBOLS) - 1
        return c

    def clauses(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(pattern group, its hits) of each clause's heaviest match."""
        return self.read(tokens)[0]

    def read(self, tokens: list[str]) -> tuple[list[tuple[int, int]], int]:
        """(pattern group, its hits) of each clause's heaviest match, and the hits that are aimed at a target behind them."""
        got, state, step, out = [], 0, self.next, self.out
        aim, aimed, target, report = 0, 0, SYMBOLS.index("target"), SYMBOLS.index("report")
        hits, at, mine, upgrade = [], 0, 0, -1  # of the clause: groups of its hits, words, aimed hits; the group that the last standing hit gets with a target
        before = None  # the clause before, where this one may report it: its place in got (None without hits) and its aimed hits

        def close():
            """The clause's heaviest match, and how many hits have it."""
            if not hits:
                return None
            best = max(hits, key=_RANK.__getitem__)
            got.append((best, hits.count(best)))
            return len(got) - 1

        for t in tokens:
            c = self.symbol(t)
            g = out[state][c]
            stands = self.stands[state][c]
            aim, mark = AIM.step[aim]["hit" if stands else "target" if c == target else "other"]
            if mark:
                mine += 1
                hits[standing] = upgrade
            if g >= 0:
                hits.append(g)
            if stands:
                standing, upgrade = len(hits) - 1, self.out_aimed[state][c]
            if c == report and at < 2 and before is not None and not hits:
                place, n = before
                got[place] = (_REPORTED[got[place][0]], got[place][1])
                aimed -= n
                before = None
            if c == 0 and t in _ENDS:
                place = close()
                aimed += mine
                before = (place, mine) if place is not None and t in ",!?" else None
                state, aim = self.after_report if t == ":" and self.reports[state] else 0, 0
                hits, at, mine = [], 0, 0
            else:
                state = step[state][c]
                at += 1
        close()
        return got, aimed + mine

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(len(FEATURES))
        if not text:
            return x
        tokens = _TOKEN.findall(text.lower())
        different = set(tokens)
        if self.hits.isdisjoint(different) and self.heads.isdisjoint({t[: STEMS[0]] for t in different}):
            return x
        found, aimed = self.read(tokens)
        for g, n in found:
            x[g] += n
            if g and _LIVE[g]:
                x[0] += n  # the more special groups add to what any attack weighs
        x[FEATURES.index("aimed")] = aimed
        x = np.log1p(x)
        live = sum(1 for g, _ in found if _LIVE[g])
        x[-2] = math.log1p(live)
        x[-1] = 1.0 if live else 0.0
        return x


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn to the prior weights."""
    prior = np.append(_PRIOR, _PRIOR_BIAS)
    a = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, group of near copies, distinct words and word beginnings) of the sampled texts."""
    for batch in (b.slice(a, 100) for b in batches for a in range(0, b.num_rows, 100)):
        texts = batch.column(2).to_pylist()
        group = np.zeros(len(texts), np.int64)
        for k, s in shingle_sets(batch.column(2)):
            group[k] = s[0].view(np.int64) if len(s) else 0
        words = []
        for t in texts:
            found = {w for w in _TOKEN.findall((t or "").lower()) if w not in _ENDS and len(w) >= STEMS[0]}
            words.append(sorted(found | {w[:n] for w in found for n in STEMS if len(w) > n}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(group), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "copies", "words"])


def _cover(candidates: list[tuple[str, int]], texts: list[set[str]], clean: int) -> list[str]:
    """Candidates, best first, each while it still explains LEARNT_TEXTS open texts and many more of them than of the clean ones."""
    chosen: list[str] = []
    while len(chosen) < LEARNT_WORDS and texts:
        open_, best = len(texts), None
        for word, b in candidates:
            a = sum(word in t for t in texts)
            if a >= LEARNT_TEXTS and a / open_ - b / max(clean, 1) > (best[0] if best else 0) and (a + 0.5) / (open_ - a + 0.5) >= LEARNT_ODDS / 2 * (b + 0.5) / (clean - b + 0.5):
                best = (a / open_ - b / max(clean, 1), word)
        if best is None:
            break
        chosen.append(best[1])
        texts = [t for t in texts if best[1] not in t]
    return chosen


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return run


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights from the sample of labelled rows that are not held out."""
    rated = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    count, span = rated.count(), 1 << 30
    rated = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(span)) < int(span * min(1.0, LEARN_ROWS / max(count, 1))))
    sample = docs.join(F.broadcast(rated), "doc_id").select("doc_id", "toxic", "text").where("text is not null")
    words = sample.mapInArrow(giving_back(_words), "doc_id long, toxic int, copies long, words array<string>")
    one = words.groupBy("copies").agg(F.min_by(F.struct("toxic", "doc_id", "words"), "doc_id").alias("r")).select("r.*").persist()
    lexicon = Lexicon()
    try:
        totals = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
        kept = {r.doc_id for r in one.select("doc_id").collect()}
        if not totals.get(1) or not totals.get(0):
            return Model(lexicon, _PRIOR, _PRIOR_BIAS)
        hits = F.array(*[F.lit(w) for w in sorted(lexicon.hits)])
        open_ = one.where(~F.arrays_overlap("words", hits))
        left = defaultdict(int, {r.toxic: r["count"] for r in open_.groupBy("toxic").count().collect()})
        per = open_.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        a, b, na, nb = F.col("a") + 0.5, F.col("b") + 0.5, left[1] + 1.0, left[0] + 1.0
        odds, whole = (a / (na - a)) / (b / (nb - b)), na + nb
        share = (a + b) / whole
        told = a * F.log(a / (na * share)) + b * F.log(b / (nb * share)) + (na - a) * F.log((na - a) / (na * (1 - share))) + (nb - b) * F.log((nb - b) / (nb * (1 - share)))
        good = per.where((F.col("a") >= LEARNT_TEXTS) & (odds >= LEARNT_ODDS)).withColumn("told", told).orderBy(F.desc("told"), "word").limit(CANDIDATES).collect()
        has = open_.where("toxic = 1").select(F.array_intersect("words", F.array(*[F.lit(r.word) for r in good])).alias("w")).collect() if good else []
        lexicon = Lexicon(frozenset(_cover([(r.word, r.b) for r in good], [set(r.w) for r in has], left[0])))
        rows = sample.mapInArrow(giving_back(_features(lexicon)), "doc_id long, x array<double>").join(sample.select("doc_id", "toxic"), "doc_id").select("doc_id", "x", "toxic").collect()
    finally:
        one.unpersist()
    rows = [r for r in rows if r.doc_id in kept]
    return Model(lexicon, *logistic(np.array([r.x for r in rows]), np.array([float(r.toxic > 0) for r in rows])))


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in batches:
            s = model.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    sent = spark.sparkContext.broadcast(learn(docs, labels))
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(giving_back(_score(sent)), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    sent = spark.sparkContext.broadcast(learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in batches:
            keep = model.score(batch.column(at).to_pylist()) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(giving_back(run), docs.schema)
