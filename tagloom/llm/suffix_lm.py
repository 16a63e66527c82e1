"""Language-model scores from a probabilistic suffix tree over tokens, beside a unigram base.

Tokens are the lower-cased words of a text and then one end; words that no learning
text has are one symbol, unknown. The root of the tree gives a known token its share
of the learning tokens and unknown the share that new words had, that of the
words seen once. One rule makes the nodes, for all contexts of up to DEPTH tokens and all
known tokens after them: a context keeps a token that follows it LEAST_DEEP times
and whose count times log ratio to what the suffix gives it is above half of log N. It gives
those discounted probabilities and hands the rest of its mass to its suffix in the
suffix's own proportions, so each distribution sums to one. Scoring starts at the longest
suffix of the history that is a node.

Two shares decide where this is worked out, never what comes out. Contexts with
LEAST_SHARE of all tokens are broadcast with what they keep of the symbols, words with a quarter of
that. For all other contexts each position is sent once, to the range of hash values of the
shortest context of its history that is not broadcast, so a range holds all of the longer
ones too, and their counts, and no context with LEAST_SHARE is a group of a range. Words travel as
their rank in the table of the most frequent ones, which is broadcast; only others, and the
shortest contexts, as hashes.

Broadcast contexts are hot, so what they keep of words that are no symbols is counted by ranges of
those words: once for each word and key of a context (of a word outside the table, wherever it
stands, so that its count is known). Length by length, these ranges return what such words
take of each broadcast context, which its factor for the rest needs. Then they tell
the ranges of contexts what is kept of which word, and the root's values of words outside
the table. Words whose contexts are all broadcast are sent there under a key of their own.
Ranges of contexts return sums for each text, and the symbols that they have settled, whose
share of the root is taken off again.

All counts cover all learning texts. Words are counted exactly, then pairs of symbols,
then triples and quadruples on frequent contexts, so nothing depends on how the table is cut; what is broadcast is
bounded by 1 / LEAST_SHARE contexts of a length and four times as many symbols, and TABLE words with their counts. The root needs the
count of every token of every text. Those of the table, and of words frequent in held-out texts alone (which
have no part in the tree), are settled where the text is read. Other words are sent hashed and packed: for
each range of hash values one array of distinct hashes and the texts they occur in, with
the number of times. A range's reader sums the learning counts and returns what its
words add up to in each text, so no word sends more than a pair a text. No word list is
gathered.

Defined cases: null or empty text is the end token alone; tokens only in texts held
out are unknown; a null doc_id is not held out; with no learning text every token is
unknown; equal rows count each; other columns are ignored; an empty table gives an
empty result. Words are told apart by a 64-bit hash, contexts outside what is broadcast
by their range and some 40 bits more (a range of a million positions: one in a million meets another).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, giving_back, hashed_words, materialize, mix64, small_batches

_U = np.uint64
FOLDS, HELD_OUT = 7, 2
#: Share of all tokens, and count, from which a context is broadcast; a word is a symbol from a quarter of it.
LEAST_SHARE, LEAST_COUNT = 5e-4, 16
#: Tokens of the longest context, and times that a symbol which a context keeps must follow it.
DEPTH, LEAST_DEEP = 3, 2
#: Taken off each count of a node for the symbols it does not keep.
DISCOUNT = 0.75
#: Words whose counts are broadcast at most (24 bytes each), beside the symbols: all those seen at least so often that no more are.
TABLE = 1_000_000
#: Distinct words whose counts a task holds before it sends them.
HELD_WORDS = 2_000_000
#: Words a task holds before it sends them, and words that one range of hash values should hold.
FLUSH, RANGE_WORDS = 1_200_000, 8_000_000
#: Positions that one range of contexts should hold, and leading bits of a context's hash that it goes by inside the range.
RANGE_CONTEXTS, RANGE_BITS = 1_000_000, 40
#: Ranges at least.
RANGES = 8
#: Hash that stands for the end of a text.
END = _U(1)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, tokens, tokens of each text) for runs of texts; each text's tokens end with END."""
    with np.errstate(over="ignore"):
        for first, words, counts in hashed_words(texts):
            yield first, np.insert(words, np.cumsum(counts), END), counts + 1


def _merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, n = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v, n = v[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    return v[cut], np.add.reduceat(n, cut) if len(v) else n


def _rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])


def _word_counts(ranges: int):
    """Counts of all words of this task, packed by range of hash values, and its number of tokens (range -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = 0, [], 0
        every = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

        def count():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            every[0] = _merged([every[0][0], v], [every[0][1], n])

        def sent(extra=()):
            v, n = every[0]
            cut = np.searchsorted((v >> _U(32)) * _U(ranges) >> _U(32), np.arange(ranges + 1))
            rows = [(r, _packed(np.array([b - a]), _planes(v[a:b]), _planes(n[a:b]))) for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if a < b]
            every[0] = v[:0], n[:0]
            return pa.RecordBatch.from_pydict({"range": [r for r, _ in (*rows, *extra)], "data": [d for _, d in (*rows, *extra)]}, pa.schema([("range", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            for _, t, _ in tokens(batch.column(0)):
                held.append(t)
                size += len(t)
                total += len(t)
                if size > 2_000_000:
                    count()
                    held, size = [], 0
                    if len(every[0][0]) > HELD_WORDS:
                        yield sent()
        if held:
            count()
        yield sent([(-1, _packed(np.array([total])))])

    return run


def _summed_words(kept: np.ndarray, least: int):
    """Of one range: words counted least times, and those kept at any count (kind 1), the number of words seen once but for the end (3); of range -1 the number of tokens (2)."""

    def run(rows: pa.Table) -> pa.Table:
        raws = [_unpacked(x) for x in rows.column("data").to_pylist()]
        if rows.column("range")[0].as_py() < 0:
            return pa.Table.from_batches([_rows(2, np.zeros(1, np.uint64), np.array([sum(int(np.frombuffer(raw, np.int64)[0]) for raw in raws)]))])
        sizes = [int(np.frombuffer(raw, np.int64, 1)[0]) for raw in raws]
        v, n = _merged([_unplaned(raw, np.uint64, k, 8) for raw, k in zip(raws, sizes, strict=True)], [_unplaned(raw, np.int64, k, 8 + 8 * k) for raw, k in zip(raws, sizes, strict=True)])
        once = np.count_nonzero((n == 1) & (v != END))
        own = (n >= least) | np.isin(v, kept)
        return pa.Table.from_batches([_rows(1, v[own], n[own]), _rows(3, np.zeros(1, np.uint64), np.array([once]))])

    return run


class Places:
    """Places in a sorted array of hashes, by a table over their leading bits: few of them share an entry, so most are found by one look."""

    def __init__(self, known: np.ndarray):
        bits = max(1, int(len(known)).bit_length() + 1)
        self.known, self.shift = np.append(known, ~_U(0)), _U(64 - bits)
        self.size, self.begin = len(known), np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, t: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for others."""
        if not self.size:
            return np.full(len(t), -1, np.int64)
        at = self.begin[t >> self.shift].astype(np.int64)
        found = self.known[at]
        left = np.flatnonzero(found < t)
        at[found > t] = -1
        while len(left):  # the next ones of the same entry
            at[left] += 1
            found = self.known[at[left]]
            over, left = left[found > t[left]], left[found < t[left]]
            at[over] = -1
        at[at == self.size] = -1  # the guard at the end
        return at


def _order(key: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order by key, and inside a key by the leading bits of code and first: two plain sorts where 21 bits number the keys."""
    if len(key) >= 1 << 21:
        return np.lexsort(((code.astype(np.uint64) << _U(32)) | first, key))
    order = np.argsort(key)
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)

    def short(x: np.ndarray) -> np.ndarray:
        """22 bits of codes: ranks as they are, of marks made of a hash the leading bits."""
        return np.minimum(np.where(x < _OUTSIDE, x, (x >> np.uint32(10)) & np.uint32((1 << 21) - 1) | np.uint32(1 << 21)), np.uint32((1 << 22) - 1)).astype(np.uint64)

    return np.argsort((rank << _U(43)) | (short(code) << _U(21)) | (short(first) >> _U(1)))


def _numbers(t: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each token in the sorted array known, -1 for others."""
    if not len(known):
        return np.full(len(t), -1, np.int64)
    at = np.searchsorted(known, t)
    at[at == len(known)] = 0
    return np.where(known[at] == t, at, -1)


def _histories(t: np.ndarray, counts: np.ndarray, known: np.ndarray, now: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each token (now, where they are at hand), of the one before and of the one before that; before a text stand END, then nothing."""
    now, end = _numbers(t, known) if now is None else now, int(_numbers(np.array([END]), known)[0])
    one, two = np.concatenate(([end], now[:-1])), np.concatenate(([-1, end], now[:-2])) if len(now) > 1 else np.full(1, -1)
    first = np.cumsum(counts) - counts
    one[first], two[first] = end, -1
    second = first[counts > 1] + 1
    two[second] = end
    return now, one, two


def _third(two: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of the tokens three before, from those two before."""
    three = np.concatenate(([-1], two[:-1]))
    three[np.cumsum(counts) - counts] = -1
    return three


def _count(known: np.ndarray, pairs: np.ndarray | None, triples: np.ndarray | None = None):
    """Counts of given words (kind 1) and their pairs (2), or of the symbols after given pairs (3), or after given triples (4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, places = len(known), Places(known)
        have: dict[int, tuple] = {}
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush():
            for kind, keys in held.items():
                v, n = np.unique(np.concatenate(keys), return_counts=True)
                have[kind] = _merged([have[kind][0], v], [have[kind][1], n]) if kind in have else (v, n)
            held.clear()

        for batch in batches:
            for _, t, counts in tokens(batch.column(0)):
                now, one, two = _histories(t, counts, known, places.of(t))
                ok = (now >= 0) & (one >= 0)
                if pairs is None:
                    held.setdefault(1, []).append(now[now >= 0])
                    held.setdefault(2, []).append((one * m + now)[ok])
                elif triples is not None:
                    three = _third(two, counts)
                    at = np.flatnonzero(ok & (two >= 0) & (three >= 0))
                    pair = _numbers(three[at] * m + two[at], pairs)
                    at, pair = at[pair >= 0], pair[pair >= 0]
                    context = _numbers(pair * m + one[at], triples)
                    held.setdefault(4, []).append((context * m + now[at])[context >= 0])
                else:
                    ok &= two >= 0
                    context = _numbers((two * m + one)[ok], pairs)
                    held.setdefault(3, []).append((context * m + now[ok])[context >= 0])
                size += len(t)
                if size > 2_000_000:
                    flush()
                    size = 0
        if held:
            flush()
        for kind, (v, n) in have.items():
            for a in range(0, len(v), 50_000):
                yield _rows(kind, v[a : a + 50_000], n[a : a + 50_000])

    return run


@dataclass
class Level:
    """Broadcast contexts of one length, by place."""

    lower: np.ndarray  # place of the context without its first token
    times: np.ndarray  # times it occurs in learning texts
    rest: np.ndarray  # log10 factor for the symbols that it does not keep
    kept: np.ndarray  # sorted place * symbols + symbol, of the symbols alone
    logp: np.ndarray


@dataclass
class Tree:
    """Frequent contexts of up to three tokens with the symbols they keep; what they keep of other words is told to the ranges of contexts."""

    known: np.ndarray  # hashes of the symbols, sorted
    unknown: float  # probability of the unknown symbol
    total: int
    count: np.ndarray  # by symbol: times in learning texts
    often2: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted contexts of two, first * symbols + second
    often3: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of three: place in often2 * symbols + symbol
    times: list[np.ndarray] = field(default_factory=list)  # by length and place
    levels: list[Level] = field(default_factory=list)

    def __post_init__(self):
        self.cost, self.least = 0.5 * np.log(max(self.total, 2)), least_of(self.total)
        self.root = np.log10(np.maximum(self.count / max(self.total, 1), 1e-12) * (1 - self.unknown))
        self.often = self.count >= self.least  # by symbol: it is a context of one token
        self.set_table(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def set_table(self, words: np.ndarray, learnt: np.ndarray) -> None:
        """Words whose counts are broadcast, the symbols among them; no result depends on which they are."""
        self.words, self.learnt, self.places = words, learnt, None
        self.by_rank = np.argsort(-learnt, kind="stable").astype(np.uint32)
        self.rank = np.zeros(len(words), np.uint32)
        self.rank[self.by_rank] = np.arange(len(words), dtype=np.uint32)
        self.symbol = np.append(_numbers(words, self.known), -1)  # by word of the table: its number among the symbols; the last is for words outside
        self.word_root = self.root_of(learnt)

    def root_of(self, learnt: np.ndarray) -> np.ndarray:
        """log10 of the root's value for words of these counts."""
        return np.log10(np.maximum(learnt, 1) / max(self.total, 1) * (1 - self.unknown))

    def contexts(self, two: np.ndarray, one: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last two and of the last three tokens among the broadcast contexts, -1 for others."""
        m = len(self.known)
        pair = np.where((two >= 0) & (one >= 0), _numbers(two * m + one, self.often2), -1)
        before = np.concatenate(([-1], pair[:-1]))
        before[np.cumsum(counts) - counts] = -1
        return pair, np.where((before >= 0) & (one >= 0), _numbers(before * m + one, self.often3), -1)

    def histories(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each token its number in the table, its number and the two before it among the symbols, and its contexts of two and three that are broadcast."""
        if self.places is None:  # made where it is used, not sent
            self.places = Places(self.words)
        number = self.places.of(t)
        now, one, two = _histories(t, counts, self.known, self.symbol[number] if len(self.words) else None)
        return number, now, one, two, *self.contexts(two, one, counts)

    def after_often(self, one: np.ndarray) -> np.ndarray:
        return (one >= 0) & self.often[one] if len(self.often) else np.zeros(len(one), bool)

    def read(self, t: np.ndarray, counts: np.ndarray, histories: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 of what nodes say about each token, and whether they settle it (else the root's value is to be added)."""
        _, now, one, _, pair, third = histories or self.histories(t, counts)
        out, settled, m = np.zeros(len(t)), np.zeros(len(t), bool), len(self.known)
        for of, place in zip(self.levels, (np.where(self.after_often(one), one, -1), pair, third), strict=False):
            at = np.flatnonzero(place >= 0)
            if not len(at):
                continue
            place, symbol = place[at], now[at]
            found = np.where(symbol >= 0, _numbers(place * m + symbol, of.kept), -1)
            have = found >= 0
            out[at] += of.rest[place]
            out[at[have]] = of.logp[found[have]]
            settled[at[have]] = True
        return out, settled

    def value(self, length: int, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of symbols after contexts of this length."""
        if not length:
            return self.root[symbol]
        of = self.levels[length - 1]
        found = _numbers(place * len(self.known) + symbol, of.kept)
        out = self.value(length - 1, of.lower[place], symbol) + of.rest[place]
        out[found >= 0] = of.logp[found[found >= 0]]
        return out

    def telling(self, lower: np.ndarray, times: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which symbols after contexts of the next length (place * symbols + symbol, n times) are the node's own, and what they have below it."""
        c, s = key // max(len(self.known), 1), key % max(len(self.known), 1)
        below = 10 ** self.value(len(self.levels), lower[c], s)
        return (times[c] >= self.least) & _own(n, times[c], below, self.cost), below

    def add(self, lower: np.ndarray, times: np.ndarray, key: np.ndarray, n: np.ndarray, others: tuple = (0.0, 0.0)) -> None:
        """The nodes of the next length; others: by place, what its words that are no symbols take, and have below it."""
        key = key.astype(np.int64)
        keep, below = self.telling(lower, times, key, n)
        key, n, below = key[keep], n[keep], below[keep]
        c = key // max(len(self.known), 1)
        p = (n - DISCOUNT) / times[c]
        own, given = np.bincount(c, p, len(times)) + others[0], np.bincount(c, below, len(times)) + others[1]
        self.levels.append(Level(lower, times, _rest(own, given), key, np.log10(p)))

    def factors(self) -> list[np.ndarray]:
        """log10, by length and place, of what a context and its suffixes leave to the root for words that they do not keep."""
        out = [self.levels[0].rest]
        for of in self.levels[1:]:
            out.append(out[-1][of.lower] + of.rest)
        return out

    @property
    def rest1(self) -> np.ndarray:
        return self.levels[0].rest

    @property
    def kept1(self) -> np.ndarray:
        return self.levels[0].kept

    @property
    def logp1(self) -> np.ndarray:
        return self.levels[0].logp


def least_of(total: int) -> float:
    """Times from which a context is broadcast."""
    return max(LEAST_COUNT, LEAST_SHARE * total)


def _own(n: np.ndarray, times: np.ndarray, below: np.ndarray, cost: float) -> np.ndarray:
    """The one rule for all contexts: a symbol is the node's own if it is repeated and diverges from the suffix."""
    return (n >= LEAST_DEEP) & (n * np.log(np.maximum(n, 1e-9) / (np.maximum(times, 1) * below)) > cost)


def _rest(own: np.ndarray, given: np.ndarray) -> np.ndarray:
    """log10 factor for what a node does not keep: its own symbols take own, and have given below it."""
    return np.where(own > 0, np.log10(np.maximum(1 - own, 1e-12) / np.maximum(1e-12, 1 - given)), 0.0)


def build(words: tuple, pairs: tuple, triples: tuple, contexts: np.ndarray, total: int, unknown: float, known: np.ndarray) -> Tree:
    """Tree from counts of words, of pairs (first * symbols + second) and of the symbols after contexts (context * symbols + symbol)."""
    count, contexts = np.zeros(len(known)), contexts.astype(np.int64)
    count[words[0].astype(np.int64)] = words[1]
    tree = Tree(known, unknown, total, count, contexts)
    tree.add(np.zeros(len(known), np.int64), count, *pairs)
    tree.add(contexts % max(len(known), 1), pairs[1][np.searchsorted(pairs[0].astype(np.int64), contexts)], *triples)
    return tree


def _collected(df: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    got = df.where(F.col("kind") == kind).select("key", "n").toArrow()
    key, n = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(key.view(np.uint64))
    return key[order].view(np.uint64), n[order]


def learn(docs: DataFrame) -> tuple[Tree, int]:
    """The tree, and the number of learning tokens."""
    tree, others, _, _ = grow(docs)
    discard(others)
    return tree, tree.total


def grow(docs: DataFrame) -> tuple[Tree, DataFrame, int, int]:
    """The tree, what it keeps of words that are no symbols (see _summed_others), and the numbers of ranges of words and of contexts."""
    schema = "kind byte, key long, n long"
    spark = docs.sparkSession
    texts = docs.where(~held_out()).select(F.coalesce("text", F.lit("")).alias("text"))

    def summed(count) -> DataFrame:
        part = texts.mapInArrow(count, schema).groupBy("kind", "key").agg(F.sum("n").alias("n"))
        return materialize(part.where((F.col("n") >= LEAST_DEEP) | (F.col("kind") == 1)), "contexts", "zstd")

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(RANGES, int(size / 6 / RANGE_WORDS) + 1)
    deep = max(RANGES, int(size / 6 / RANGE_CONTEXTS) + 1)

    def counted(part: DataFrame, kept: np.ndarray, least: int) -> DataFrame:
        return materialize(part.mapInArrow(_word_counts(ranges), "range long, data binary").groupBy("range").applyInArrow(_summed_words(kept, least), schema), "words", "zstd")

    # words frequent in held-out texts need their learning counts broadcast too; they are no part of the tree
    rest = counted(docs.where(held_out()).select(F.coalesce("text", F.lit("")).alias("text")), np.zeros(0, np.uint64), LEAST_COUNT // 4)
    size = rest.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    asked = _collected(rest.where(F.col("n") >= max(LEAST_COUNT, LEAST_SHARE * size) / 4), 1)[0]
    first = counted(texts, asked, 2)
    total = int(first.where("kind = 2").agg(F.sum("n")).first()[0] or 0)
    once = first.where("kind = 3").agg(F.sum("n").alias("once")).first()["once"] or 0
    unknown = min(0.5, (once + 1) / (total + 2))
    least = max(LEAST_COUNT, LEAST_SHARE * total)
    known = _collected(first.where(F.col("n") >= least / 4), 1)[0]
    # the table: all words seen at least so often that they are no more than TABLE
    sizes = first.where("kind = 1").groupBy(F.floor(F.log2("n") * 16).alias("size")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("size")).collect()
    often, enough = 0, None
    for row in sizes:
        often += row["words"]
        if often > TABLE:
            break
        enough = row["n"]
    table = _collected(first.where(F.col("n") >= enough), 1) if enough is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    beside = np.union1d(known, asked)
    missing = [int(k) for k in np.setdiff1d(beside, table[0]).view(np.int64)]
    own = _collected(first.where(F.col("key").isin(missing)), 1) if missing else table
    words_of = np.union1d(beside, table[0])
    times = np.zeros(len(words_of), np.int64)
    for key, n in (table, own):
        times[np.searchsorted(words_of, key)] = n
    pairs = summed(_count(known, None))
    tables = [pairs]
    words = _collected(pairs, 1)
    count = np.zeros(len(known))
    count[words[0].astype(np.int64)] = words[1]
    two = _collected(pairs.where(F.col("n") >= least), 2)
    tree = Tree(known, unknown, total, count, two[0].astype(np.int64))
    tree.set_table(words_of, times)
    m = max(len(known), 1)
    lower, tree.times = [np.zeros(len(known), np.int64), tree.often2 % m], [count, two[1]]
    if len(tree.often2):
        tables.append(summed(_count(known, tree.often2)))
        three = _collected(tables[1].where(F.col("n") >= least), 3)
        tree.often3 = three[0].astype(np.int64)
        if len(tree.often3):
            tree.times.append(three[1])
            lower.append(_numbers(tree.often2[tree.often3 // m] % m * m + tree.often3 % m, tree.often2))
            tables.append(summed(_count(known, tree.often2, tree.often3)))
    shared = spark.sparkContext.broadcast(tree)
    every = docs.select(held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    sent = every.mapInArrow(giving_back(_others(max(RANGES, deep // 4 + 1), deep, shared)), "range long, data binary")
    others = materialize(sent.groupBy("range").applyInArrow(_summed_others(shared), "data binary"), "others", "zstd")
    for length, table in enumerate(tables, 1):
        shared = spark.sparkContext.broadcast(tree)
        key, n = _collected(table.where(F.col("kind") == length + 1).mapInArrow(_telling(lower[length - 1], tree.times[length - 1], shared), schema), length + 1)
        sums = others.mapInArrow(_others_take(shared), "place long, own double, given double").groupBy("place").agg(F.sum("own"), F.sum("given")).toArrow()
        taken = np.zeros((2, len(tree.times[length - 1])))
        taken[:, sums[0].to_numpy()] = sums[1].to_numpy(), sums[2].to_numpy()
        tree.add(lower[length - 1], tree.times[length - 1], key, n, tuple(taken))
        shared.unpersist()
    discard(first, rest, *tables)
    return tree, others, ranges, deep


def _telling(lower: np.ndarray, times: np.ndarray, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.telling(lower, times, batch.column(1).to_numpy(), batch.column(2).to_numpy())[0]))

    return run


def _others(ranges: int, deep: int, sent):
    """Words that are no symbols, with the broadcast contexts before them and the key by which ranges of contexts know them, and how often learning texts have them there; packed by range of the word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = sent.value
        kept, held, size = _key_mask(deep), [], 0

        def flush():
            word, key, places, n = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            held.clear()
            word, key, places, n = _distinct(word, key & kept, places, n)
            to = (((word >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            rows = {"range": to[cut].tolist(), "data": []}
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(to)][: len(cut)], strict=True):
                used, times = np.unique(word[a:b], return_counts=True)
                rows["data"].append(_packed(np.array([len(used), b - a]), *map(_planes, (used, times.astype(np.int32), key[a:b], *places[:, a:b], n[a:b]))))
            return pa.RecordBatch.from_pydict(rows, pa.schema([("range", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            learns = ~np.array(batch.column(0).to_pylist(), bool)
            for first, t, counts in tokens(batch.column(1)):
                histories = tree.histories(t, counts)
                number, now, one, _, pair, third = histories
                _, key, _ = _shortest(tree, t, counts, histories)
                after = tree.after_often(one)
                # of words with fewer counts nothing is kept
                other = np.where(number < 0, True, after & (now < 0) & (tree.learnt[number] >= LEAST_DEEP if len(tree.learnt) else False))
                at = np.flatnonzero(other & (key != 0))
                key = key[at]
                places = (np.array([np.where(after[at], one[at], -1), pair[at], third[at]]) + 1).astype(np.uint16)
                held.append((t[at], key, places, np.repeat(learns[first : first + len(counts)], counts)[at].astype(np.int32)))
                size += len(at)
            if size > FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def _distinct(word: np.ndarray, key: np.ndarray, places: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words and keys, which have their places, with the sums of n."""
    order = np.lexsort((key, word))
    word, key = word[order], key[order]
    cut = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (key[1:] != key[:-1])))) if len(word) else np.zeros(0, np.int64)
    return word[cut], key[cut], places[:, order[cut]], np.add.reduceat(n[order], cut) if len(word) else n


def _summed_others(sent):
    """One row a range: its words with their learning counts, and what _others sends of all texts; without what follows a context once, which no node keeps."""

    def run(rows: pa.Table) -> pa.Table:
        tree, parts = sent.value, []
        for raw in rows.column("data").to_pylist():
            raw = _unpacked(raw)
            w, k = np.frombuffer(raw, np.int64, 2).tolist()
            a, got = 16, []
            for kind, size in ((np.uint64, w), (np.int32, w), (np.uint64, k), *[(np.uint16, k)] * 3, (np.int32, k)):
                got.append(_unplaned(raw, kind, size, a))
                a += got[-1].nbytes
            parts.append((np.repeat(got[0], got[1]), got[2], np.array(got[3:6]), got[6]))
        word, key, places, n = _distinct(*(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)))
        words, word = np.unique(word, return_inverse=True)
        number = _numbers(words, tree.words)
        learnt = np.bincount(word, n, len(words)).astype(np.int64)  # words outside the table are sent wherever they stand
        learnt[number >= 0] = tree.learnt[number[number >= 0]]
        _, of = np.unique(word * 65536 + places[0], return_inverse=True)
        keep = ((np.bincount(of, n) >= LEAST_DEEP)[of] & (places[0] > 0)) | ((number < 0) & (learnt >= LEAST_DEEP))[word]
        word, key, places, n = word[keep], key[keep], places[:, keep], n[keep]
        data = _packed(np.array([len(words), len(word)]), *map(_planes, (words, learnt, (number < 0).astype(np.uint8), word.astype(np.int32), key, *places, n)))
        give_back()
        return pa.table({"data": pa.array([data], pa.binary())})

    return run


def _read_others(tree: Tree, raw: bytes) -> tuple:
    """words, whether they are outside the table, their counts, word of each row, its key, places (-1 is none), times, the root's value."""
    raw = _unpacked(raw)
    w, k = np.frombuffer(raw, np.int64, 2).tolist()
    a, got = 16, []
    for kind, size in ((np.uint64, w), (np.int64, w), (np.uint8, w), (np.int32, k), (np.uint64, k), *[(np.uint16, k)] * 3, (np.int32, k)):
        got.append(_unplaned(raw, kind, size, a))
        a += got[-1].nbytes
    word = got[3].astype(np.int64)
    return got[0], got[2] > 0, got[1], word, got[4], [x.astype(np.int64) - 1 for x in got[5:8]], got[8], tree.root_of(got[1])[word]


def _levels_of_others(tree: Tree, word: np.ndarray, places: list[np.ndarray], n: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, ...]:
    """The longest node that keeps each row's word, numbered over all lengths, or -1, and how often the word follows it; and for the next length, whose factors are not known yet, the places, probabilities and those below of what its nodes keep."""
    value, node, times_of, before = root.copy(), np.full(len(word), -1), np.zeros(len(word), np.int64), 0
    for length, times in enumerate(tree.times):
        at = np.flatnonzero(places[length] >= 0)
        place = places[length][at]
        _, first, of = np.unique(place * (int(word.max(initial=0)) + 1) + word[at], return_index=True, return_inverse=True)
        count, where, owner = np.bincount(of, n[at], len(first)), at[first], place[first]
        below = 10 ** value[where]
        keep = _own(count, times[owner], below, tree.cost)
        p = (count - DISCOUNT) / times[owner]
        if length == len(tree.levels):
            return node, times_of, owner[keep], p[keep], below[keep]
        value[at] = np.where(keep[of], np.log10(np.maximum(p, 1e-12))[of], value[at] + tree.levels[length].rest[place])
        hit = at[keep[of]]
        node[hit], times_of[hit] = places[length][hit] + before, count[of[keep[of]]]
        before += len(times)
    return node, times_of


def _others_take(sent):
    """For the next length of the tree: by place of a context, what words that are no symbols take, and have below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = sent.value
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                _, _, _, word, _, places, n, root = _read_others(tree, raw)
                *_, owner, p, below = _levels_of_others(tree, word, places, n, root)
                some, of = np.unique(owner, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(np.bincount(of, p, len(some)).astype(float)), pa.array(np.bincount(of, below, len(some)).astype(float))], names=["place", "own", "given"])

    return run


#: Head of the rows that tell a range of contexts what broadcast contexts keep of words that are no symbols.
_TOLD = b"told"


def _tell(ranges: int, deep: int, sent):
    """Of words that are no symbols: what broadcast contexts say of them where they keep them, and the root's value of words outside the table, packed by range of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = sent.value
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                words, outside, learnt, word, key, places, n, root = _read_others(tree, raw)
                node, times = _levels_of_others(tree, word, places, n, root)[:2]
                # a root's value is asked for only where the word is repeated
                x = np.flatnonzero((node >= 0) | (outside[word] & (n >= LEAST_DEEP)))
                to = (((key[x] >> _U(32)) * _U(deep)) >> _U(32)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                x, to = x[order], to[order]
                cut = np.flatnonzero(np.diff(to, prepend=-1))
                data = []
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(to)][: len(cut)], strict=True):
                    y = x[a:b]
                    kept = y[node[y] >= 0]
                    kept = kept[np.argsort(key[kept], kind="stable")]
                    some, code = np.unique(word[kept], return_inverse=True)
                    far, number = outside[some], _numbers(words[some], tree.words)
                    names = np.where(far, _OUTSIDE + np.cumsum(far) - 1, tree.rank[number] + 1 if len(tree.rank) else 0).astype(np.uint32)
                    asked = np.unique(word[y][outside[word[y]]])
                    planes = map(_planes, (words[some[far]], np.diff(key[kept], prepend=_U(0)), names[code], node[kept].astype(np.uint16), times[kept].astype(np.int32), words[asked], learnt[asked]))
                    data.append(_packed(np.array([np.count_nonzero(far), len(kept), len(asked)]), *planes))
                yield pa.RecordBatch.from_arrays([pa.array(to[cut] + ranges), pa.array(np.full(len(cut), -1)), pa.array([_TOLD] * len(cut), pa.binary()), pa.array(data, pa.binary())], names=["range", "block", "head", "data"])

    return run


_STEP = _U(0x9E3779B97F4A7C15)


def _shifted(h: np.ndarray, counts: np.ndarray, fill: np.uint64) -> np.ndarray:
    out = np.concatenate(([fill], h[:-1]))
    out[np.cumsum(counts) - counts] = fill
    return out


#: Codes of words outside the table: this bit and 31 bits of their hash.
_OUTSIDE = np.uint32(1 << 31)


def _codes(tree: Tree, t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank in the table plus one, or a mark made of the hash; at are the words' numbers in the table."""
    out = _OUTSIDE | (t >> _U(33)).astype(np.uint32)
    inside = at >= 0
    out[inside] = tree.rank[at[inside]] + np.uint32(1)
    return out


def _key_mask(deep: int) -> np.uint64:
    """Bits of a context's hash that it goes by."""
    return _U((1 << 64) - (1 << max(0, 64 - RANGE_BITS - int(deep).bit_length())))


def _shortest(tree: Tree, t: np.ndarray, counts: np.ndarray, histories: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the length of its shortest context that is not broadcast, the key it is sent by (0: it is not sent), and whether that stands for contexts that all are broadcast."""
    _, now, one, _, pair, third = histories
    with np.errstate(over="ignore"):
        h1 = _shifted(t, counts, END)
        h2 = _shifted(h1, counts, _U(0))
        h3 = _shifted(h2, counts, _U(0))
        c1 = mix64(h1 * _STEP)
        c2 = np.where(h2 != 0, mix64((c1 ^ h2) * _STEP), _U(0))
        c3 = np.where(h3 != 0, mix64((c2 ^ h3) * _STEP), _U(0))
    after = tree.after_often(one)
    start = np.where(~after, 1, np.where(pair < 0, 2, np.where(third < 0, 3, 4)))
    key = np.choose(start - 1, [c1, c2, c3, np.zeros(len(t), np.uint64)])
    alone = (key == 0) & (now < 0) & after
    with np.errstate(over="ignore"):
        key[alone] = mix64((np.where(h3 != 0, c3, np.where(h2 != 0, c2, c1))[alone] ^ t[alone]) * _STEP)
    return start, key, alone


def _keys(tree: Tree, t: np.ndarray, counts: np.ndarray, histories: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Tokens that have a context outside the broadcast tree, the hash of the shortest one, the codes of the tokens, those of the words that the two longer contexts add (0 for none), and 0.

    Where all contexts are broadcast, words that are no symbols are sent too, for what
    those contexts keep of them: by a hash of contexts and word, and with 2 for 0.
    """
    number = histories[0]
    code = _codes(tree, t, number)
    code_of_end = _codes(tree, np.array([END]), _numbers(np.array([END]), tree.words))[0]
    d1 = _shifted(code, counts, code_of_end)
    d2 = _shifted(d1, counts, np.uint32(0))
    d3 = _shifted(d2, counts, np.uint32(0))
    start, key, alone = _shortest(tree, t, counts, histories)
    first, second = np.where(start == 1, d2, np.where(start == 2, d3, 0)).astype(np.uint32), np.where(start == 1, d3, 0).astype(np.uint32)
    at = np.flatnonzero(key != 0)
    return at, key[at], code[at], np.where(alone, 0, first)[at].astype(np.uint32), np.where(alone, 0, second)[at].astype(np.uint32), np.where(alone, 2, 0)[at].astype(np.uint8)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress better."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind)


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    raw = b"".join(a if isinstance(a, bytes) else a.tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int(np.frombuffer(raw, np.int64, 1)[0]), "zstd", asbytes=True)


def _level(context: np.ndarray, symbol: np.ndarray, learns: np.ndarray, value: np.ndarray, open_: np.ndarray, root: np.ndarray, cost: float) -> None:
    """Adds the nodes of one length to value and open_ (whether the root's value is to be added); contexts and symbols are numbered, -1 is none."""
    at = np.flatnonzero(context >= 0)
    if not len(at):
        return
    c, kind = context[at], context[at] * (int(symbol.max()) + 1) + symbol[at]
    _, first, of = np.unique(kind, return_index=True, return_inverse=True)
    n = np.bincount(of, weights=learns[at])
    owner = c[first]
    total = np.bincount(owner, weights=n)
    where = at[first]
    below = 10 ** (value[where] + np.where(open_[where], root[where], 0.0))
    keep = _own(n, total[owner], below, cost)
    p = (n - DISCOUNT) / np.maximum(total[owner], 1)
    rest = _rest(*(np.bincount(owner, weights=np.where(keep, x, 0.0)) for x in (p, below)))
    value[at] = np.where(keep[of], np.log10(np.maximum(p, 1e-12))[of], value[at] + rest[c])
    open_[at] &= ~keep[of]


def _contexts(rows: pd.DataFrame, ranges: int, sent) -> pd.DataFrame:
    """For each block: what contexts of this range change in each text (kind 2), and the words they settle by range of hash values (kind 4)."""
    tree: Tree = sent.value
    parts = []
    told = [_unpacked(raw) for raw in rows.loc[rows["head"] == _TOLD, "data"]]
    rows = rows[rows["head"] != _TOLD]
    if rows.empty:
        return pd.DataFrame({"range": [], "block": [], "kind": [], "v": [], "n": [], "data": []})
    for raw in rows["data"]:
        raw = _unpacked(raw)
        g, k, e, v = np.frombuffer(raw, np.int64, 4).tolist()
        others, had, a, got = np.frombuffer(raw, np.uint64, e, 32), _unplaned(raw, float, v, 32 + 8 * e), 32 + 8 * e + 8 * v, []
        for kind, size in ((np.uint64, g), (np.uint32, g), (np.uint32, g), (np.int32, g), (np.uint8, g), (np.uint32, k), (np.uint32, k), (np.uint16, k)):
            got.append(_unplaned(raw, kind, size, a))
            a += got[-1].nbytes
        # keys ascend, and codes do in each key, so both are sent as steps
        got[0], code = np.cumsum(got[0], dtype=np.uint64), np.cumsum(got[1], dtype=np.uint32)
        inside = code < _OUTSIDE
        word = np.zeros(g, np.uint64)
        word[inside] = tree.words[tree.by_rank[code[inside] - np.uint32(1)]]
        word[~inside] = others[code[~inside] - _OUTSIDE]
        got[1], got[2] = word, had[got[2]]
        parts.append(got)
    key, word, had, n, was_open, d1, d2, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    texts = np.repeat(np.arange(len(parts)), [len(p[7]) for p in parts])
    keys, key = np.unique(key, return_inverse=True)
    words, word = np.unique(word, return_inverse=True)
    number = _numbers(words, tree.words)
    root = tree.root_of(np.zeros(len(words)))
    root[number >= 0] = tree.word_root[number[number >= 0]]
    now, still = had.copy(), was_open & 1
    # of all broadcast contexts, numbered over their lengths: times, and what had already counts of them and their suffixes
    times_of, factor = np.concatenate(tree.times), np.concatenate(tree.factors()) if told else None
    group = key * len(words) + word
    for raw in told:
        f, k, w = np.frombuffer(raw, np.int64, 3).tolist()
        a, got = 24, []
        for kind, size in ((np.uint64, f), (np.uint64, k), (np.uint32, k), (np.uint16, k), (np.int32, k), (np.uint64, w), (np.int64, w)):
            got.append(_unplaned(raw, kind, size, a))
            a += got[-1].nbytes
        far, code, node, asked = got[2] >= _OUTSIDE, got[2], got[3].astype(np.int64), _numbers(got[5], words)
        name = np.zeros(k, np.uint64)
        name[far], name[~far] = got[0][code[far] - _OUTSIDE], tree.words[tree.by_rank[code[~far] - np.uint32(1)]]
        x, y = _numbers(np.cumsum(got[1], dtype=np.uint64), keys), _numbers(name, words)
        x = np.where((x >= 0) & (y >= 0), x * len(words) + y, -1)
        order = np.argsort(x)
        found = _numbers(group, x[order])
        at = np.flatnonzero(found >= 0)
        node, count = node[order[found[at]]], got[4][order[found[at]]]
        now[at], still[at] = had[at] + np.log10((count - DISCOUNT) / times_of[node]) - factor[node], 0
        root[asked[asked >= 0]] = tree.root_of(got[6][asked >= 0])
    log_learnt = np.zeros(len(words))
    log_learnt[number >= 0] = np.log10(np.maximum(tree.learnt[number[number >= 0]], 1))
    symbol, context = np.repeat(word, n), np.repeat(key, n)
    before, was, learns = np.repeat(had, n), np.repeat((was_open & 1) > 0, n), (doc & 1).astype(float)
    value, open_ = np.repeat(now, n), np.repeat(still > 0, n)
    _level(np.where(np.repeat(was_open, n) > 1, -1, context), symbol, learns, value, open_, root[symbol], tree.cost)
    longer = context
    for mark in (d1, d2):  # a longer context is one more word before the shorter one
        _, longer = np.unique((longer.astype(np.uint64) << _U(32)) | mark, return_inverse=True)
        _level(np.where(mark > 0, longer, -1), symbol, learns, value, open_, root[symbol], tree.cost)
    out = {"range": [], "block": [], "kind": [], "v": [], "n": [], "data": []}

    def add(range_, block, kind, data):
        for name, x in zip(out, (range_, block, kind, 0, 0, data), strict=True):
            out[name].append(x)

    change, settled, text = value - before, was & ~open_, (doc >> 1).astype(np.int64)
    of_word = (((words >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)
    cuts = np.searchsorted(texts, np.arange(len(parts) + 1))
    for i, block in enumerate(rows["block"].tolist()):
        x = slice(cuts[i], cuts[i + 1])
        x = np.flatnonzero((change[x] != 0) | settled[x]) + cuts[i]
        if not len(x):
            continue
        ends = settled[x] & (words[symbol[x]] == END)
        sent_known = settled[x] & ~ends & (number[symbol[x]] >= 0)
        root_known = np.where(sent_known, log_learnt[symbol[x]], 0.0)
        some, of = np.unique(text[x], return_inverse=True)
        add(-1 - block, block, 2, _packed(*map(_planes, (np.diff(some, prepend=0).astype(np.int32), np.bincount(of, weights=change[x] - root_known), *(np.bincount(of, weights=w).astype(np.int32) for w in (ends, sent_known))))))
        x = x[settled[x] & ~ends & ~sent_known]
        x = x[np.argsort(symbol[x], kind="stable")]
        to = of_word[symbol[x]]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(x)][: len(cut)], strict=True):
            used, m = np.unique(symbol[x[a:b]], return_counts=True)
            add(int(to[a]), block, 4, _packed(np.array([len(used)]), *map(_planes, (np.diff(words[used], prepend=_U(0)), m.astype(np.int32), text[x[a:b]].astype(np.uint16)))))
    return pd.DataFrame(out).astype({"range": "int64", "block": "int64", "kind": "int32", "v": "int64", "n": "int64"})


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block: the root's logarithms, and number, of the words that contexts have settled in each text (kind 5)."""
    tables = [_unpacked(raw) for raw in pdf.loc[pdf["kind"] == 3, "data"]]
    hashes, learnt = (np.concatenate([np.frombuffer(raw, kind).reshape(2, -1)[i] for raw in tables]) if tables else np.zeros(0, kind) for i, kind in ((0, np.uint64), (1, np.int64)))
    rows = pdf[pdf["kind"] == 4]
    data = []
    for raw in rows["data"]:
        raw = _unpacked(raw)
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        h, m = np.cumsum(_unplaned(raw, np.uint64, k, 8), dtype=np.uint64), _unplaned(raw, np.int32, k, 8 + 8 * k)
        doc = _unplaned(raw, np.uint16, (len(raw) - 8 - 12 * k) // 2, 8 + 12 * k)
        some, of = np.unique(doc, return_inverse=True)
        root = np.log10(learnt[np.searchsorted(hashes, h)])
        data.append(_packed(*map(_planes, (np.diff(some, prepend=0).astype(np.int32), np.bincount(of, weights=np.repeat(root, m)), np.bincount(of).astype(np.int32)))))
    return pd.DataFrame({"block": rows["block"].to_numpy(np.int64), "kind": np.full(len(rows), 5, np.int32), "data": data})


def _send(ranges: int, deep: int, sent):
    """Blocks of texts: what nodes say of them, their sizes, their hashed words packed by range of hash values, and their contexts by range of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = sent.value
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        block, held, ends = part << 32, [], []
        ids, out, sizes, flags, read = [], [], [], [], []
        texts: list[np.ndarray] = []  # words of each text that are sent
        own: list[np.ndarray] = []  # what symbols add to each text: log10 for base and root, known, known and unknown left to the root
        places: list[tuple] = []
        kept = _key_mask(deep)

        def send_contexts(rows, learns):
            columns = [list(x) for x in zip(*places, strict=True)]
            places.clear()

            def column(i):  # one at a time, so that a task holds no second copy of all
                x = np.concatenate(columns[i])
                columns[i] = []
                return x

            size = column(7)
            key, word, code, first = column(0) & kept, column(1), column(2), column(5)
            if not len(key):
                return
            # words with the same code may take turns: what stands side by side is one row, so these are only more rows
            order = _order(key, code, first)
            key, word, code, first = key[order], word[order], code[order], first[order]
            value, open_, second = column(3)[order], column(4)[order], column(6)[order]
            doc = (2 * np.repeat(np.arange(len(size)), size) + np.repeat(learns, size)).astype(np.uint16)[order]
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (word[1:] != word[:-1]))))
            n = np.diff(np.append(cut, len(key))).astype(np.int32)
            to = (((key[cut] >> _U(32)) * _U(deep)) >> _U(32)).astype(np.int64)
            begin = np.flatnonzero(np.diff(to, prepend=-1))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(cut)], strict=True):
                x, y, c = int(cut[a]), int(cut[b]) if b < len(cut) else len(key), cut[a:b]
                own = code[c]
                others, place = np.unique(word[c][own >= _OUTSIDE], return_inverse=True)
                own[own >= _OUTSIDE] = _OUTSIDE + place.astype(np.uint32)
                rows["range"].append(ranges + int(to[a]))
                rows["block"].append(block)
                rows["head"].append(b"")
                had, which = np.unique(value[c], return_inverse=True)
                planes = map(_planes, (had, np.diff(key[c], prepend=_U(0)), np.diff(own, prepend=np.uint32(0)), which.astype(np.uint32), n[a:b], open_[c], first[x:y], second[x:y], doc[x:y]))
                rows["data"].append(_packed(np.array([b - a, y - x, len(others), len(had)]), others, *planes))

        def flush():
            # header: goes through under a range of its own
            learns = ~np.array(out, bool)
            count = np.concatenate(sizes)
            rows = {"range": [-1 - block], "block": [block], "head": [b""], "data": [b""]}
            known = np.array([i is not None for i in ids])
            rows["head"][0] = np.array([i or 0 for i in ids], np.int64).tobytes() + known.tobytes() + np.array(out, bool).tobytes() + count.astype(np.int64).tobytes() + np.concatenate(read).tobytes() + np.concatenate(ends).tobytes() + np.concatenate(own, axis=1).tobytes()
            h, doc = np.concatenate(held), np.repeat(np.arange(len(count), dtype=np.uint32), np.concatenate(texts))
            doc = 2 * doc + np.concatenate(flags)  # odd: settled by a node
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            if len(h):
                cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
                times = np.diff(np.append(cut, len(h)))
                h, doc = h[cut], doc[cut]
                cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                n = np.diff(np.append(cut, len(h)))
                m = np.add.reduceat(learns[doc >> 1] * times, cut)
                to = (((h[cut] >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                narrow = doc.astype(np.uint16)
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cut)], strict=True):
                    x, y = int(cut[a]), int(cut[b]) if b < len(cut) else len(h)
                    rows["range"].append(int(to[a]))
                    rows["block"].append(block)
                    rows["head"].append(np.array([b - a, len(count)], np.int64).tobytes())
                    rows["data"].append(_packed(h[cut[a:b]], n[a:b].astype(np.int32), m[a:b].astype(np.int32), times[x:y].astype(np.int32), narrow[x:y]))
            send_contexts(rows, learns)
            return pa.RecordBatch.from_pydict(rows, pa.schema([("range", pa.int64()), ("block", pa.int64()), ("head", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            ids += batch.column(0).to_pylist()
            out += batch.column(1).to_pylist()
            for _, t, counts in tokens(batch.column(2)):
                histories = tree.histories(t, counts)
                value, settled = tree.read(t, counts, histories)
                last = np.cumsum(counts) - 1
                word = np.ones(len(t), bool)
                word[last] = False
                number = histories[0]
                local, left = word & (number >= 0), word & (number < 0)
                learnt = np.zeros(len(t), np.int64)
                learnt[local] = tree.learnt[number[local]]
                seen, first = learnt > 0, last + 1 - counts
                own.append(np.array([np.add.reduceat(x.astype(float), first) for x in (np.log10(learnt + 1.0), np.where(~settled, np.log10(np.maximum(learnt, 1)), 0.0), seen, seen & ~settled, local & ~seen & ~settled)]))
                held.append(t[left])
                texts.append(np.add.reduceat(left.astype(np.int64), first))
                flags.append(settled[left].astype(np.uint32))
                sizes.append(counts - 1)
                read.append(np.add.reduceat(value, last + 1 - counts))
                ends.append(~settled[last])
                at, key, code, first, second, alone = _keys(tree, t, counts, histories)
                per = np.diff(np.searchsorted(at, np.concatenate(([0], last + 1))))
                places.append((key, t[at], code, value[at], alone | ~settled[at], first, second, per))
            if sum(int(x.sum()) for x in sizes) >= FLUSH or len(ids) > 30_000:
                yield flush()
                block, held = block + 1, []
                ids, out, sizes, flags, read, texts, own = [], [], [], [], [], [], []
                ends.clear()
        if ids:
            yield flush()

    return run


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block: what its words in this range add to each text, as (text, log10 sums for base and root, known, known and unknown left to the root); learning totals of the range once, and the words' own (kind 3)."""
    if int(pdf["range"].iat[0]) < 0:
        return pd.DataFrame({"range": pdf["range"], "block": pdf["block"], "kind": 0, "v": 0, "n": 0, "data": pdf["head"]})
    parts = []
    for head, raw in zip(pdf["head"], pdf["data"], strict=True):
        k, texts = np.frombuffer(head, np.int64).tolist()
        raw = _unpacked(raw)
        n = np.frombuffer(raw, np.int32, k, 8 * k)
        pairs = int(n.sum())
        parts.append((np.frombuffer(raw, np.uint64, k), n, np.frombuffer(raw, np.int32, k, 12 * k), np.frombuffer(raw, np.uint16, pairs, 16 * k + 4 * pairs), texts, np.frombuffer(raw, np.int32, pairs, 16 * k)))
    values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    learnt = np.bincount(at, weights=np.concatenate([p[2] for p in parts]), minlength=len(values)).astype(np.int64)
    base, share, a, data = np.log10(learnt + 1.0), np.log10(np.maximum(learnt, 1)), 0, []
    for h, n, _, doc, texts, times in parts:
        own = np.repeat(at[a : a + len(h)], n)
        a += len(h)
        text, open_ = doc >> 1, (doc & 1) == 0
        known = learnt[own] > 0
        add = np.bincount(text, weights=base[own] * times, minlength=texts)
        root = np.bincount(text, weights=np.where(open_, share[own], 0.0) * times, minlength=texts)
        counts = [np.bincount(text, weights=w * times, minlength=texts).astype(np.int32) for w in (known, known & open_, ~known & open_)]
        some = np.unique(text)
        data.append(some.astype(np.int32).tobytes() + add[some].tobytes() + root[some].tobytes() + b"".join(c[some].tobytes() for c in counts))
    v, n = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    v[0], n[0] = np.count_nonzero(learnt), learnt.sum()
    own = pd.DataFrame({"range": pdf["range"].to_numpy(), "block": pdf["block"].to_numpy(), "kind": 1, "v": v, "n": n, "data": data})
    often = learnt >= LEAST_DEEP
    table = _packed(values[often], learnt[often])
    return pd.concat([own, pd.DataFrame({"range": own["range"][:1], "block": [-1], "kind": [3], "v": [0], "n": [0], "data": [table]})])


def _first(ranges: int, sent):
    return lambda pdf: _contexts(pdf, ranges, sent) if int(pdf["range"].iat[0]) >= ranges else _sums(pdf)


def _join(v: int, n: int, ends: int, unknown: float):
    """Rows of the texts of a block from its header and the sums of all ranges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.loc[pdf["kind"] == 0, "data"].iat[0]
        k = len(head) // 67
        ids, known_id = np.frombuffer(head, np.int64, k), np.frombuffer(head, bool, k, 8 * k)
        out, words = np.frombuffer(head, bool, k, 9 * k), np.frombuffer(head, np.int64, k, 10 * k)
        score, end_open = np.frombuffer(head, float, k, 18 * k).copy(), np.frombuffer(head, bool, k, 26 * k)
        base, known = np.full(k, np.log10(ends + 1.0)), np.full(k, int(ends > 0))
        seen = np.log10((1 - unknown) / max(n, 1))
        score += np.where(end_open, np.log10(max(ends, 1)) + seen if ends else np.log10(unknown), 0.0)
        own = np.frombuffer(head[27 * k :], float).reshape(5, k)
        base += own[0]
        known += own[2].astype(np.int64)
        score += own[1] + own[3] * seen + own[4] * np.log10(unknown)
        for raw in pdf.loc[pdf["kind"] == 1, "data"]:
            m = len(raw) // 32
            doc = np.frombuffer(raw, np.int32, m)
            sums = np.frombuffer(raw[4 * m : 20 * m], float).reshape(2, m)
            counts = np.frombuffer(raw, np.int32, 3 * m, 20 * m).reshape(3, m)
            base[doc] += sums[0]
            known[doc] += counts[0]
            score[doc] += sums[1] + counts[1] * seen + counts[2] * np.log10(unknown)
        for kind, raw in pdf.loc[pdf["kind"].isin([2, 5]), ["kind", "data"]].itertuples(index=False):
            raw = _unpacked(raw)
            m = len(raw) // (20 if kind == 2 else 16)
            doc, change, count = np.cumsum(_unplaned(raw, np.int32, m, 0)), _unplaned(raw, float, m, 4 * m), _unplaned(raw, np.int32, m, 12 * m)
            if kind == 2:  # count: ends that contexts settle; then symbols
                score[doc] += change - count * (np.log10(max(ends, 1)) + seen) - _unplaned(raw, np.int32, m, 16 * m) * seen
            else:
                score[doc] -= change + count * seen
        n_tokens = words + 1
        base -= n_tokens * np.log10(float(n + v + 1))
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64").where(pd.Series(known_id)), "held_out": out, "n_tokens": n_tokens, "n_known": known, "train_tokens": n, "base_score": base, "score": score})

    return run


_SENT = "range long, block long, head binary, data binary"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tree, others, ranges, deep = grow(docs)
    ends = docs.agg(F.sum((~held_out()).cast("long")).alias("learns")).first()["learns"] or 0
    shared = spark.sparkContext.broadcast(tree)
    sent = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_send(ranges, deep, shared), _SENT).union(others.mapInArrow(_tell(ranges, deep, shared), _SENT))
    sums = materialize(sent.groupBy("range").applyInPandas(_first(ranges, shared), "range long, block long, kind int, v long, n long, data binary"), "sums")
    discard(others)
    total = sums.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    learnt = tree.learnt[tree.words != END]
    v, n = (total["v"] or 0) + int(np.count_nonzero(learnt)) + (ends > 0), (total["n"] or 0) + int(learnt.sum()) + ends
    settled = sums.where("kind in (3, 4)").groupBy("range").applyInPandas(_settled, "block long, kind int, data binary")
    return sums.where("kind in (0, 1, 2)").select("block", "kind", "data").union(settled).groupBy("block").applyInPandas(_join(v, n, ends, tree.unknown), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
