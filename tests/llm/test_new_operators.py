"""Tokenizer alignment, max-sketch search and decontamination against brute force, with nulls, ties, repeats and odd texts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tagloom.llm import alignment, decontamination, max_sketch
from tagloom.llm.common import shared_dir

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    None, "", " ", "  ", "a", " a", "a  b", "a b ", "a\tb c\n d", "x  y", "x  y", "one　 two", "a▁b", "▁", "<|endoftext|> <s> <0x41>", "don't we'll 123 4567",
    "café au lait", "中文 字符 mixed", "\x00 \x1f a \x7f b", "\U0001f600 \U0001f600\U0001f601", "ends in space ", "tab\t \tand  spaces   three", "\r\n \r\n", "a  b  c", "ﬁne １", "x" * 3000, "é é",
]


def said(rng, n):
    return " ".join(rng.choice(["the", "a", "of", "Alpha", "beta", "gamma,", "delta.", "x1", "naïve", "Q"]) for _ in range(n))


# --- alignment -------------------------------------------------------------------------


def tokens(text):
    """(id, end) of both sides, or None where the text has no tokens."""
    from tokenizers import Tokenizer

    a = tokens.__dict__.setdefault("a", Tokenizer.from_file(A))
    a.encode_special_tokens = True
    import sentencepiece

    b = tokens.__dict__.setdefault("b", sentencepiece.SentencePieceProcessor(model_file=B))
    byte_of = tokens.__dict__.get("byte_of")
    if byte_of is None:
        keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in keep]
        byte_of = tokens.byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return None
    return list(zip(ids_a, np.cumsum([len(x) for x in raw_a]).tolist(), strict=True)), list(zip(ids_b, np.cumsum([len(x) for x in raw_b]).tolist(), strict=True))


def aligned(texts):
    found, counts = [], Counter()
    for text in texts:
        got = tokens(text)
        if got is None:
            found.append(None)
            continue
        ends = {e for _, e in got[0]} & {e for _, e in got[1]}
        links = [(a, b) for a, e in got[0] for b, f in got[1] if e == f]
        groups, one, two = [], [], []
        for end in sorted(ends):
            from_ = groups[-1][2] if groups else 0
            one, two = [i for i, e in got[0] if from_ < e <= end], [i for i, e in got[1] if from_ < e <= end]
            groups.append((one, two, end))
        counts.update(links)
        found.append((len(got[0]), len(got[1]), groups, links))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    rows = []
    for x in found:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q, _ in x[2])
        rows.append((x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == top[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(text.encode()).hexdigest()))
    return rows, counts, top


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_is_that_of_whole_texts(spark):
    rng = random.Random(1)
    texts = [*ODD, *[said(rng, rng.randint(1, 60)) for _ in range(60)], "".join(rng.choice("ab \té中.'1\n") for _ in range(400)), ODD[16], ODD[16]]
    rows = [(i if i % 9 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n_a int").repartition(5)
    got = alignment.Alignment(docs, A, B)
    want, counts, top = aligned(texts)
    assert sorted((r.doc_id or -1, *(r[c] for c in NAMES)) for r in got.documents.collect()) == sorted((r[0] or -1, *w) for r, w in zip(rows, want, strict=True))
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in got.pairs.collect()} == {p: (n, n == top[p[1]]) for p, n in counts.items()}


def test_alignment_in_many_runs_and_slices(spark, monkeypatch):
    """Runs, frames and slices of a few links each give the same sums; tasks are run here, where the limits are set."""
    rng = random.Random(2)
    texts = [said(rng, rng.randint(0, 40)) for _ in range(80)] + [said(rng, 900)]
    for name, value in (("RUN_LINKS", 50), ("FRAME", 7), ("PIECE", 200)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(alignment.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    table = pa.Table.from_batches(list(alignment._encode(A, B)(iter([batch.slice(0, 50), batch.slice(50)]))))
    docs = table.filter(pa.compute.equal(table["part"], -1))
    runs = table.filter(pa.compute.not_equal(table["part"], -1))
    assert len(set(runs["run"].to_pylist())) > 20
    counts = Counter()
    slices = {}
    for part in range(alignment.PARTS):
        for odd in (0, 1):
            own = runs.filter(pa.array([p == part and r % 2 == odd for p, r in zip(runs["part"].to_pylist(), runs["run"].to_pylist(), strict=True)]))
            if len(own):
                slices[part, odd] = own
                for r in alignment._merged((part, odd), own).to_pylist():
                    counts[r["pair"]] += r["n"]
    want, pairs, top = aligned(texts)
    assert {tuple(int(x) for x in alignment.ids_of(np.int64(p))): n for p, n in counts.items()} == dict(pairs)
    sums = {}
    for (part, odd), own in slices.items():
        held = [p for p in counts if p >> 40 == part]
        best = [counts[p] == top[int(alignment.ids_of(np.int64(p))[1])] for p in held]
        for r in alignment._back((part, odd), own, pa.table({"pair": held, "n": [counts[p] for p in held], "best": best})).to_pylist():
            a, b = sums.get(r["key"], (0, 0))
            sums[r["key"]] = a + r["n_best"], b + r["count_sum"]
    for row, w in zip(sorted(docs.to_pylist(), key=lambda r: r["doc_id"]), want, strict=True):
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums.get(row["key"], (0, 0)), row["groups_sha256"]) == w


def test_alignment_of_a_long_text_and_of_none(spark):
    rng = random.Random(3)
    text = said(rng, 600_000) + " " + "y" * 3000
    assert len(text) > alignment.PIECE
    raw = (" " + text).encode()
    parts = list(alignment._pieces(raw))
    assert len(parts) > 1 and b"".join(parts) == raw
    docs = spark.createDataFrame([(1, text), (2, text + "▁")], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    got = tokens(text)
    assert (rows[1].n_a, rows[1].n_b) == (len(got[0]), len(got[1])) and rows[1].n_links == len({e for _, e in got[0]} & {e for _, e in got[1]})
    assert (rows[2].n_a, rows[2].n_links, rows[2].groups_sha256) == (0, 0, "")
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_worker_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 50)
    own = alignment.Aligner(A, B)
    for k in range(20):
        data = np.frombuffer(" ".join(["", *[f"w{k * 17 + i}" for i in range(40)], "x" * 100]).encode(), np.uint8)
        counts, to, links, groups = own.read(data, alignment.cuts(data, np.zeros(1, np.int64)))
        assert len(counts) == 41 and counts[:, 3].all() and len(groups) == 41 and to[-1] == len(links) == counts[:, 2].sum()
        assert len(own.hashes) <= 80


# --- search ----------------------------------------------------------------------------


def ranked(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, q in queries.items():
        rows = []
        for doc, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("parts", "k"), [(1, 10), (7, 3)])
def test_search_is_exact(spark, parts, k):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(20_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(700)]
    docs += [(1000, None), (1001, ""), (1002, "w1 " * 700), (None, "W1 w2 w3"), (None, "w4 w5"), (7, docs[7][1]), (9, "w9 w9 w9"), (2000, " ".join(words)), (2001, "中é café,x"), (2002, docs[3][1]), (1999, docs[3][1])]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(25)] + [(50, None), (51, ""), (52, "unheard"), (53, "CAFÉ café 中é"), (None, "w1 w4"), (54, "w1 w1 w2"), (54, "w3"), (55, docs[3][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int").repartition(parts)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    got = sorted([tuple(r) for r in max_sketch.ranked(d, q, k).collect()], key=str)
    assert got == ranked(docs, items, k)
    assert max_sketch.ranked(d.limit(0), q, k).count() == 0 and max_sketch.ranked(d, q.limit(0), k).count() == 0


def test_search_in_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, said(rng, rng.randint(1, 30))) for i in range(60)]
    items = [(i, said(rng, 5)) for i in range(12)]
    monkeypatch.setattr(max_sketch, "BLOCK_QUERIES", 4)
    got = max_sketch.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranked(docs, items, 5)


def test_bounds_hold_and_few_documents_are_scored(monkeypatch):
    """The bound of a document is never below its score; most documents are never scored."""
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6)) % 20_000}" for _ in range(40_000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 200))) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(texts)], names=["doc_id", "text"])
    rows = list(max_sketch._index(iter([batch])))
    q = texts[5].split()[:30]
    t = next(iter(max_sketch.terms(pa.array([" ".join(q)]))))
    h, c = max_sketch._sorted_terms(t.hashes)
    block = max_sketch.Queries([0], np.zeros(len(h), np.int64), h, c.astype(np.int64))
    df = np.zeros(len(h), np.int64)
    for r in rows:
        df += np.bincount(block.look_up(max_sketch._blob(r.column(3), np.uint64)[0])[1], minlength=len(h))
    block.weigh(900, sum(len(t.split()) for t in texts), df)
    scored = []
    real = max_sketch._Best.add
    monkeypatch.setattr(max_sketch._Best, "add", lambda self, i, score, doc, null: (scored.append((score, doc)), real(self, i, score, doc, null))[1])
    found = pa.Table.from_batches(list(max_sketch._search(type("S", (), {"value": block})(), 10)(iter(rows))))
    assert found["doc_id"][0].as_py() == 5 and len(found) == 10
    assert sum(len(d) for _, d in scored) < 400
    want = ranked(list(enumerate(texts)), [(0, " ".join(q))], 900)
    assert [r[2:] for r in sorted(want, key=lambda r: r[1])[:10]] == list(zip(found["doc_id"].to_pylist(), found["score"].to_pylist(), strict=True))


# --- decontamination -------------------------------------------------------------------


def contaminated(text, items):
    w = TERM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        b = TERM.findall((t or "").translate(LOWER))
        for i in range(max(1, len(b) - 9) if b else 0):
            window = b[i : i + 10]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def corpus(rng):
    items = [(i, said(rng, rng.randint(10, 25))) for i in range(12)] + [(20, "alpha BETA"), (21, None), (22, "?!"), (None, "x1 x1 x1"), (23, "q"), (3, said(rng, 12)), (24, "naïve 中文 café")]
    docs = [(i, said(rng, rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (None, items[0][1])]
    docs += [(200 + i, f"lead-in: {t.upper() if t else t}; {said(rng, 8)} {items[i // 2][1]}") for i, (_, t) in enumerate(items[:12])]
    docs += [(300, "NAÏVE naïve-中文\tcafé!"), (301, "x1 x1 x1 x1"), (302, "said alphabeta"), (303, items[1][1] + items[2][1])]
    return docs, items


@pytest.mark.parametrize("rows", [500_000, 40])
def test_contamination(spark, monkeypatch, rows):
    monkeypatch.setattr(decontamination, "BLOCK_ROWS", rows)
    rng = random.Random(8)
    docs, items = corpus(rng)
    d = spark.createDataFrame([(i, t, "s", 3) for i, t in docs], "doc_id long, text string, spans string, n_words int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(d, b).collect()
    want = sorted(((i or -1), *contaminated(t, items)) for i, t in docs)
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    text = {i: t for i, t in docs if i is not None}
    for r in got:
        if r.doc_id is not None and r.places:
            assert sum(len(TERM.findall(text[r.doc_id][p.start : p.end].translate(LOWER))) for p in r.places) == r.n_hit
    whole = {r.doc_id: r for r in decontamination.decontaminate(d, b, "documents").collect()}
    assert set(whole) == {i for i, t in docs if not contaminated(t, items)[4]} and all(r.spans == "s" and r.n_words == 3 for r in whole.values())
    cut = decontamination.decontaminate(d, b)
    assert cut.columns == d.columns
    for r in cut.collect():
        if r.doc_id is not None and r.doc_id < 200 and not contaminated(text[r.doc_id], items)[4]:
            assert r.text == text[r.doc_id]
        elif r.doc_id == 301:
            assert r.text == ""
        elif r.doc_id == 300:
            assert r.text == "NAÏVE !" or "中" not in r.text


def test_contamination_of_empty_tables(spark):
    docs, items = corpus(random.Random(9))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.contamination(d.limit(0), b).count() == 0
    got = decontamination.contamination(d, b.limit(0)).collect()
    assert len(got) == len(docs) and not any(r.contaminated for r in got) and {r.items_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert shared_dir(spark)


def test_contamination_of_a_long_text(spark):
    rng = random.Random(10)
    item = "one two three four five six seven eight nine ten eleven twelve"
    text = said(rng, 400_000) + " " + item + " " + said(rng, 10)
    d = spark.createDataFrame([(1, text), (2, "é" * (3 << 20))], "doc_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].items) == (len(TERM.findall(text.translate(LOWER))), 12, ["5"]) and text[rows[1].places[0].start : rows[1].places[0].end] == item
    assert (rows[2].n_words, rows[2].n_hit) == (1, 0)
