"""What workers hold at once, beside the results."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers

from tagloom.llm import alignment, pieces


def test_pieces_encode_a_batch_in_blocks_of_few_characters(monkeypatch):
    import sentencepiece

    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdeéß中", k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 60))) for _ in range(80)]
    texts += [None, "", " ", "x" * 5_000, "a  b\n c", None]
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, sizes = pieces.Pieces(path), []
    encoded = model._encoded
    monkeypatch.setattr(model, "_encoded", lambda x: sizes.append(sum(len(t or "") for t in x) if len(x) > 1 else 0) or encoded(x))
    monkeypatch.setattr(pieces, "BLOCK", 1_000, raising=False)
    flat, n, same = model.encode_batch(texts)
    assert len(sizes) > 10 and max(sizes) <= 1_000
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [library.encode(t) if t else [] for t in texts]
    assert flat.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
    assert same.tolist() == [True] * len(texts)
    flat, n, same = model.encode_batch([])
    assert (len(flat), len(n), len(same)) == (0, 0, 0)


def test_aligner_keeps_more_chunks_than_a_task_meets():
    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    n = 500_000  # 23 MB of text have so many distinct ones
    aligner.hashes, aligner.row = np.arange(n, dtype=np.uint64), np.arange(n)
    aligner.counts, aligner.bounds = np.zeros((n, 4), np.int64), np.zeros(n + 1, np.int64)
    aligner.groups = pa.array([b""] * n, pa.large_binary())
    data = np.frombuffer(b" some words some", np.uint8)
    counts, *_ = aligner.read(data, alignment.cuts(data, np.zeros(1, np.int64)))
    assert counts[:, 3].tolist() == [1, 1, 1] and len(aligner.hashes) == n + 2


def _words_of(monkeypatch):
    """A model whose encodings are made up, and the words that it was asked to encode."""
    model, asked = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")), []
    monkeypatch.setattr(model, "encode_words", lambda words: asked.extend(words) or {w: (5, 6, 7) for w in words})
    return model, asked


def test_pieces_keep_many_words_in_little_memory(monkeypatch):
    import tracemalloc

    model, _ = _words_of(monkeypatch)
    monkeypatch.setattr(model, "encode_words", lambda words: {w: (5, 6, 7) for w in words})
    model.encode_batch(["a few words"])
    tracemalloc.start()
    try:
        for k in range(0, 200_000, 20_000):
            model.encode_batch([" ".join(f"w{i}" for i in range(k, k + 20_000))])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 10_000_000, held


def test_pieces_of_a_word_are_worked_out_once_a_worker(monkeypatch):
    model, asked = _words_of(monkeypatch)
    texts = [" ".join(f"w{i}" for i in range(k, k + 30_000)) for k in range(0, 300_000, 30_000)]
    for text in texts + texts:
        model.encode_batch([text])
    assert len(asked) == len(set(asked)) == 300_000


def test_pieces_make_room_for_new_words(monkeypatch):
    """Words that are asked for again stay when the arrays are full; the pieces are the library's whatever is kept."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(8)
    monkeypatch.setattr(pieces, "WORDS", 300)
    model, asked = pieces.Pieces(path), []
    encode = model.encode_words
    monkeypatch.setattr(model, "encode_words", lambda words: asked.extend(words) or encode(words))
    for k in range(60):
        texts = ["always the same words\n" + " ".join("".join(rnd.choices("abé中▁ \n", k=6)) for _ in range(20)) for _ in range(3)] + [None, "", "ab" * 200 + " " + "ab" * 200, "x" * 120 + " " + "x" * 119]
        flat, n, same = model.encode_batch(texts)
        want = [library.encode(t) if t else [] for t in texts]
        assert flat.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want] and same.all()
        assert len(model.hashes) <= 300 and len(model.again) == len(model.hashes) == len(model.bounds) - 1
    assert len(asked) > 1_000 and asked.count("▁always") == 1
