"""The language model learns from learning texts only."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagloom.functions import storage
from tagloom.llm import suffix_lm


def is_held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def scores(spark, rows):
    return {r.doc_id: (r.score, r.base_score, r.n_known, r.train_tokens) for r in suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("table", [1_000_000, 40])
def test_held_out_texts_change_no_other_score(spark, monkeypatch, table):
    """Held-out rows are added, dropped and changed, with frequent words of their own and rare ones of the learning texts; all other scores stay."""
    monkeypatch.setattr(suffix_lm, "TABLE", table)
    rnd = random.Random(14)
    vocabulary = [f"w{int(rnd.paretovariate(0.8))}" for _ in range(4000)]
    learnt = [(i, " ".join(rnd.choice(vocabulary) for _ in range(60)) + (" hub raro" if i % 9 == 0 else " hub other")) for i in range(500) if not is_held(i)]
    held = [i for i in range(5000, 6000) if is_held(i)]
    asked = [(held[0], "w1 raro w2 hub raro w7 seldom"), (held[1], " ".join(rnd.choice(vocabulary) for _ in range(50)))]
    want = scores(spark, learnt + asked)
    more = [(held[2], "raro " * 400 + "w3999 raro"), (held[3], "strange " * 300), (held[4], ""), (held[5], None)]
    got = scores(spark, learnt + asked + more)
    assert {k: got[k] for k in want} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    changed = scores(spark, learnt + [asked[0], (held[1], "seldom raro " * 200)])
    assert {k: v for k, v in changed.items() if k != held[1]} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items() if k != held[1]}


def test_null_ids_and_repeated_rows_learn(spark):
    one = next(i for i in range(10) if not is_held(i))
    rows = [(None, "a b c"), (None, "a b c"), (one, "a b"), (one, "a b")]
    got = suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {r.train_tokens for r in got} == {14} and not any(r.held_out for r in got)
    assert len({round(r.score, 9) for r in got if r.doc_id is None}) == 1


def test_no_learning_row(spark):
    held = [i for i in range(100) if is_held(i)][:3]
    got = suffix_lm.score(spark.createDataFrame([(i, "a b a") for i in held], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 for r in got)


def brute(rows):
    """Scores by one dictionary of all contexts of up to three tokens."""
    cut = {i: [*t.split(), None] for i, t in rows}  # None: the end, which also stands before a text
    steps = {i: [([None, *w][max(0, k + 1 - d) : k + 1] if d <= k + 1 else None, x) for k, x in enumerate(w) for d in (1, 2, 3)] for i, w in cut.items()}
    learns = [i for i in cut if not is_held(i)]
    count = Counter(x for i in learns for x in cut[i])
    total = sum(count.values())
    unknown = min(0.5, (sum(n == 1 for x, n in count.items() if x is not None) + 1) / (total + 2))
    after = defaultdict(Counter)
    for i in learns:
        for c, x in steps[i]:
            if c is not None:
                after[tuple(c)][x] += 1
    root = {x: n / total * (1 - unknown) for x, n in count.items()}
    nodes = {}

    def value(context, x):
        below = value(context[1:], x) if context else root.get(x, unknown)
        if context not in nodes:
            return below
        kept, factor = nodes[context]
        return kept[x] if x in kept else factor * below

    for context in sorted(after, key=len):
        n = sum(after[context].values())
        below = {x: value(context[1:], x) for x in after[context]}
        kept = {x: (k - 0.75) / n for x, k in after[context].items() if k >= 2 and k * math.log(k / (n * below[x])) > 0.5 * math.log(total)}
        if kept:
            nodes[context] = kept, (1 - sum(kept.values())) / (1 - sum(below[x] for x in kept))
    return {i: sum(math.log10(value(tuple([None, *w][max(0, k - 2) : k + 1]), x)) for k, x in enumerate(w)) for i, w in cut.items()}


@pytest.mark.parametrize("table,share", [(1_000_000, 5e-4), (40, 5e-4), (1_000_000, 0.02), (40, 0.02), (1_000_000, 0.9)])
def test_one_rule_for_all_contexts(spark, monkeypatch, table, share):
    """What is broadcast changes no score: frequent contexts keep rare words, in and outside the table."""
    monkeypatch.setattr(suffix_lm, "TABLE", table)
    monkeypatch.setattr(suffix_lm, "LEAST_SHARE", share)
    rnd = random.Random(15)
    vocabulary = [f"w{int(rnd.paretovariate(0.8))}" for _ in range(3000)]
    passage = [f"p{i}" for i in range(12)]
    rows = [(i, " ".join([f"first{i % 50}"] + [rnd.choice(vocabulary) for _ in range(50)] + (["w1", "hub", f"raro{i % 10}", *passage[i % 9 :][:5]] if i % 3 == 0 else ["hub", "w2"]))) for i in range(400)]
    rows += [(i, "w1 hub raro3 w2 hub new raro3 p1 p2 p3 w7") for i in range(5000, 5100) if is_held(i)]
    got = {r.doc_id: r.score for r in suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx(brute(rows), abs=1e-6)


def test_a_frequent_context_keeps_a_rare_word(spark):
    """A tenth of what follows hub is raro, which has less than 1 / 8000 of all tokens."""
    learnt = [i for i in range(1000) if not is_held(i)][:400]
    rows = [(i, " ".join(f"f{k}x{j}" for j in range(900)) + (" hub raro" if k % 10 == 0 else f" hub other{k}")) for k, i in enumerate(learnt)]
    held = [i for i in range(5000, 5100) if is_held(i)][:2]
    got = scores(spark, [*rows, (held[0], "hub raro"), (held[1], "raro hub")])
    assert got[held[0]][0] - got[held[1]][0] > 3


def test_places_and_order():
    """Hashes that share leading bits are found too, and rows of a key stand side by side."""
    rnd = np.random.default_rng(16)
    known = np.unique(np.concatenate([rnd.integers(0, 1 << 64, 5000, np.uint64), np.arange(40, dtype=np.uint64), np.arange(7, dtype=np.uint64) + np.uint64((1 << 64) - 7)]))
    asked = np.concatenate([known, known + np.uint64(1), rnd.integers(0, 1 << 64, 5000, np.uint64)])
    for k in (known, known[:1], known[:0]):
        assert suffix_lm.Places(k).of(asked).tolist() == suffix_lm._numbers(asked, k).tolist()
    key, code, first = rnd.integers(0, 50, 3000).astype(np.uint64) << np.uint64(40), rnd.integers(0, 1 << 32, 3000).astype(np.uint32), rnd.integers(0, 1 << 20, 3000).astype(np.uint32)
    code[::2] %= 9
    order = suffix_lm._order(key, code, first)
    assert sorted(order.tolist()) == list(range(3000)) and (np.diff(key[order].astype(np.int64)) >= 0).all()
    small = order[code[order] < 9]
    assert (np.diff((key[small] >> np.uint64(36)).astype(np.int64) + code[small]) >= 0).all()


def test_shuffle_files_go_with_the_write(spark):
    """What a table was made of does not stay on disk until the driver collects its garbage."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: held.getAllFiles().size()
    df = spark.range(10_000).selectExpr("id % 100 as a").groupBy("a").count()
    before = files()
    made = storage.materialize(df)
    assert files() <= before and made.count() == 100
    storage.discard(made)
