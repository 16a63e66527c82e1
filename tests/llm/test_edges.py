"""Null ids, repeated rows, very long texts and words, for the operators whose other tests have none."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tagloom.llm import common, fingerprints, secret_scan, token_counts, va_search


def test_hashes_of_long_texts_and_words_are_those_of_their_words(monkeypatch):
    rnd = random.Random(1)
    texts = ["a B  c\t\nd", "", "  ", "é" * 300, " ".join("w" * rnd.randint(1, 30) + str(i) for i in range(200)), "x" * 500 + " y " + "Z" * 700, None]
    arr = pa.array(texts, pa.string())
    want = {}
    for first, words, counts in common.hashed_words(arr):
        at = 0
        for k, c in enumerate(counts.tolist()):
            want[first + k] = words[at : at + c].tolist()
            at += c
    monkeypatch.setattr(common, "CHUNK_BYTES", 64)
    got = {}
    for first, words, counts in common.hashed_words(arr):
        at = 0
        for k, c in enumerate(counts.tolist()):
            got[first + k] = words[at : at + c].tolist()
            at += c
    assert got == want and len(want[4]) == 200 and len(want[5]) == 3 and want[6] == []


def test_terms_of_long_texts_and_words(monkeypatch):
    from tagloom.llm import terms

    texts = ["Ab-c é中x, 12", "", "...", "q" * 400 + "-" + "é" * 300, " ".join(f"t{i}" for i in range(300)), None, "end"]
    arr = pa.array(texts, pa.string())

    def every():
        out = {}
        for t in terms.terms(arr):
            for k, (a, b) in enumerate(zip(t.bounds[:-1], t.bounds[1:], strict=True)):
                out[t.first + k] = [(int(h), t.data[x:y].tobytes().lower()) for h, x, y in zip(t.hashes[a:b], t.at[a:b], t.end[a:b], strict=True)]
        return out

    want = every()
    monkeypatch.setattr(terms, "CHUNK_BYTES", 50)
    assert every() == want
    for k, t in enumerate(texts):
        assert [w for _, w in want[k]] == terms.TERM.findall((t or "").encode().lower())
    assert len({h for rows in want.values() for h, _ in rows}) == len({w for rows in want.values() for _, w in rows})


def test_token_counts_of_null_ids_and_long_texts(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    long = " ".join(rnd.choice(["alpha", "beta,", "it's", "<|endoftext|>", "中文", "  x"]) for _ in range(260_000))
    assert len(long) > token_counts.PIECE
    texts = [(None, "a b"), (None, None), (1, long), (1, "a b"), (2, "a b")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = token_counts.token_counts(spark.createDataFrame(texts, "doc_id long, text string"), path).collect()
    want = sorted((i or -1, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want


def test_secrets_of_null_ids(spark):
    rows = [(None, "password = abcdefghijklmnop"), (None, None), (3, "password = abcdefghijklmnop")]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_assign) for r in got) == [(-1, 0), (-1, 1), (3, 1)]


def test_fingerprints_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"), (6, None)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.n_chars}) == 1


@pytest.mark.parametrize("parts", [1, 9])
def test_vectors_in_many_blocks(spark, parts):
    """More vectors than a block holds, and more queries than are searched at once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 6)).round(3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(parts)
    from pyspark.sql import functions as F

    got = va_search.top_k(df, F.col("vec_id") % 7 == 0, 3).collect()
    q = np.floor(1024 * x).astype(np.int64)
    every = q @ q.T
    want = {}
    for i in range(0, 9000, 7):
        score = every[i].copy()
        order = np.lexsort((np.arange(9000), -score))
        want[i] = [(int(j), int(score[j])) for j in order if j != i][:3]
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == want and len(want) > 1024
