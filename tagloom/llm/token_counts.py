"""Token counts by a map-side lookup in two tiers, without shuffling pre-tokens.

Pre-tokens are taken with what follows them up to the next cut; a text is cut before every
space between two characters that are not white space, which no pre-token of the
tokenizer's pattern spans. A first pass counts them in every task and sends each task's
most frequent ones; the overall most frequent are encoded once and broadcast as a table
of lengths. In the second pass a task looks pre-tokens up there, then, once a batch for
each distinct one, in its worker's cache, and encodes only what neither holds. The first
pass decides what is fast, never what is counted.

The vocabulary is a byte-level BPE file of the tokenizers library, which cuts a pre-token
further by its pattern (contractions, letters, digits, other signs, white space); its
added tokens are taken out of the text before, each counting as one token.

The cache keeps two generations of at most CACHE / 2 pre-tokens of at most CACHED_CHARS
characters: what is asked for moves to the younger one, the older one is dropped when
that is full. Longer pre-tokens are encoded each time.

Defined cases: null text counts as empty (0 bytes, 0 tokens); a very long text is
looked up piece by piece; a pre-token of any length is encoded whole; equal rows count
each; a null doc_id stays null; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Tokens above which a document is over the limit.
LIMIT = 512
#: Pre-tokens that a task reports, and that the broadcast table holds at most (about 100 bytes each).
FROM_TASK, TABLE = 8_000, 30_000
#: Distinct pre-tokens a task counts before it drops those seen once.
COUNTED = 400_000
#: Entries of a worker's cache, and the characters of the longest pre-token it takes.
CACHE, CACHED_CHARS = 200_000, 48
#: Characters looked up at once, and pre-tokens encoded at once.
PIECE, ENCODED = 1 << 20, 20_000

# fixed values: the characters that the tokenizer's pattern takes as white space
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_EDGE = re.compile(f"^[{_WHITE}]|[{_WHITE}]$|^$")
_BETWEEN = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")


def pieces(text: str) -> Iterator[str]:
    """Cuts a long text where no pre-token is cut; each piece but the first begins with a space."""
    at = 0
    while len(text) - at > PIECE:
        cut = _BETWEEN.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer and the pattern of its added tokens."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    added = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    return tok, added, re.compile("|".join(map(re.escape, added)))


def lengths(tok, pretokens: list[str]) -> list[int]:
    out: list[int] = []
    for a in range(0, len(pretokens), ENCODED):
        out += map(len, tok.encode_batch_fast(pretokens[a : a + ENCODED], add_special_tokens=False))
    return out


def _frequent(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in pieces(text or ""):
                    seen.update(piece.split(" ")[1:])
                    if len(seen) > COUNTED:
                        seen = Counter({k: n for k, n in seen.items() if n > 1})
                        if len(seen) > COUNTED:
                            seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = [(k, n) for k, n in seen.most_common(FROM_TASK) if not _EDGE.search(k) and len(k) <= CACHED_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["pretoken", "n"])

    return run


class _Lengths:
    """Numbers of tokens of pre-tokens that a space leads: the worker's cache before the tokenizer."""

    def __init__(self, path: str):
        self.tok, self.added, self.split = load(path)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def resolve(self, words: set[str]) -> dict[str, int]:
        """Lengths of words, but for those with white space at an edge."""
        young, old, out, new = self.young, self.old, {}, []
        for w in words:
            n = young.get(w) or old.get(w)
            if n:
                out[w] = n
            elif not _EDGE.search(w):
                new.append(w)
        out.update(zip(new, lengths(self.tok, [" " + w for w in new]), strict=True))
        self.keep(out)
        return out

    def keep(self, found: dict[str, int]) -> None:
        for w, n in found.items():
            if len(w) <= CACHED_CHARS:
                if len(self.young) >= CACHE // 2:
                    self.old, self.young = self.young, {}
                self.young[w] = n


@lru_cache(maxsize=2)
def _worker(path: str) -> _Lengths:
    return _Lengths(path)


def _count(path: str, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, table = _worker(path), sent.value
        find, added, split = table.get, cache.added, cache.split
        for batch in batches:
            texts = batch.column(1).to_pylist()
            totals, missing, read = [0] * len(texts), set(), []
            for k, text in enumerate(texts):
                if not text:
                    continue
                parts = split.split(text) if any(a in text for a in added) else [text]
                totals[k] = len(parts) - 1
                for part in parts:
                    for piece in pieces(part):
                        head, *found = piece.split(" ")
                        known = list(map(find, found))
                        miss = [p for p, n in zip(found, known, strict=True) if n is None] if None in known else ()
                        missing.update(miss)
                        read.append((k, piece, head, miss, sum(filter(None, known) if miss else known)))
            have = cache.resolve(missing)
            odd = missing - have.keys()
            whole: list[tuple[int, str]] = []
            for k, piece, head, miss, n in read:
                if (head and _EDGE.search(head[-1])) or (odd and not odd.isdisjoint(miss)):
                    # white space beside a space: cut by the rule, not at every space
                    first, *found = _BETWEEN.split(piece)
                    whole += [(k, first), *((k, " " + w) for w in found)]
                else:
                    totals[k] += n + sum(map(have.__getitem__, miss))
                    if head:
                        whole.append((k, head))
            for (k, _), n in zip(whole, lengths(cache.tok, [w for _, w in whole]), strict=True):
                totals[k] += n
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > LIMIT for n in totals])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; path is the tokenizer's file."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = docs.select("text").mapInArrow(_frequent(path), "pretoken string, n long")
    top = [r.pretoken for r in counted.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(TABLE).select("pretoken").collect()]
    table = dict(zip(top, lengths(load(path)[0], [" " + w for w in top]), strict=True))
    return docs.mapInArrow(_count(path, spark.sparkContext.broadcast(table)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
