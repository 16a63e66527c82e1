"""Sequences kept as texts against sequences kept as cells: windows, dictionaries, encoding, potentials, gradients, decoding."""

import numpy as np
import pytest

from tagloom.operators import dictionary as D
from tagloom.operators import inference, windows
from tagloom.operators import templates as Tpl
from tagloom.operators.inference import Weights
from tagloom.operators.training import empirical
from tagloom.plans import queries
from tagloom.plans.crf import CrfEstimator
from tagloom.sources import sequences as S

PAIRS = ["u0:%x[0,0]", "u1:%x[-1,0]/%x[1,0]", "*2:%x[0,0]/%x[1,0]", "b3:%x[0,0]", "b"]


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(3)
    words = ["ab", "c", "dEf1", "h[i", "中国人", "😀x", "é", "9", "[[[q"]
    rows = [(int(i), " 　\t"[i % 3].join(rng.choice(words, n))) for i, n in enumerate(rng.integers(1, 14, 150))]
    return spark.createDataFrame([*rows, (400, "[ [["), (401, "   "), (402, None), (403, "ab" * 700), (405, "[a")], "id long, cut string").repartition(5)


def both(lines):
    """The same sequences as texts and as cells."""
    seqs = S.from_segmented(lines, "id", "cut")
    assert windows.texts_of(seqs) is not None and windows.texts_of(seqs.select("*")) is None
    return seqs, seqs.select("*")


@pytest.mark.parametrize("templates", [queries.TEMPLATES, queries.FAR, queries.PATTERNS, [Tpl.parse("u0:%x[-7,0]/%x[@9,0]/%x[6,0]"), Tpl.parse("u1:%x[@-9,0]/%x[0,0]")]])
def test_windows_of_texts_are_those_of_cells(spark, lines, templates, monkeypatch):
    texts, cells = both(lines)
    for counted, gathered in ((500_000, 400_000), (40, 30)):
        monkeypatch.setattr(windows, "COUNTED", counted)
        monkeypatch.setattr(windows, "GATHERED", gathered)
        got, want = ({(r.k, r.obs): (r.n, r.first) for r in Tpl.distinct(x, templates).groupBy("k", "obs").agg({"n": "sum", "first": "min"}).toDF("k", "obs", "n", "first").collect()} for x in (texts, cells))
        assert got == want and len(got) > 3
    for made in (D.labels, lambda x: D.observations_in(x, templates)):
        assert sorted(map(tuple, made(texts).collect())) == sorted(map(tuple, made(cells).collect()))


@pytest.mark.parametrize("templates", [None, PAIRS])
@pytest.mark.parametrize("wide", [1.0, 400.0])
def test_inference_of_texts_is_that_of_cells(spark, lines, templates, wide, monkeypatch):
    if templates:
        monkeypatch.setattr(windows, "STEPPED", 90)
        monkeypatch.setattr(windows, "TABLE", 50)
    models = [CrfEstimator(templates).prepare(x) for x in both(lines)]
    arrays = [m.arrays() for m, _ in models]
    assert arrays[0].labels == arrays[1].labels and all((getattr(arrays[0], k) == getattr(arrays[1], k)).all() for k in ("uoff", "boff"))
    rows = [{r.sent_id: (r.n, list(r.at), list(r.obs), list(r.y)) for r in e.collect()} for _, e in models]
    assert rows[0] == rows[1] and len(rows[0]) == 152
    assert [{r.obs_id: r.n for r in inference.counted(e).collect()} for _, e in models] in ([x, x] for x in [{r.obs_id: r.n for r in inference.counted(models[1][1]).collect()}])
    assert (empirical(models[0][1], arrays[0]) == empirical(models[1][1], arrays[1])).all()
    theta = wide * np.random.default_rng(1).integers(-8, 9, len(arrays[0].theta)) / 8
    w = Weights(arrays[0].labels, arrays[0].uoff, arrays[0].boff, theta)
    got, want = (inference.measured(e, w) for _, e in models)
    assert np.allclose(got[0], want[0], rtol=1e-9, atol=1e-9) and got[1] == pytest.approx(want[1]) and got[2] == want[2]
    for f in (inference.potentials, inference.decode, inference.tagged, inference.summed_potentials):
        assert sorted(map(tuple, f(models[0][1], w).collect())) == sorted(map(tuple, f(models[1][1], w).collect()))
    for f in (inference.losses, inference.posteriors, inference.certainties):
        for a, b in zip(sorted(map(tuple, f(models[0][1], w).collect())), sorted(map(tuple, f(models[1][1], w).collect())), strict=True):
            for x, y in zip(a, b, strict=True):
                assert np.allclose(np.array(x), np.array(y), rtol=1e-9, atol=1e-9)


def test_sums_of_sequences_are_those_of_their_positions(spark, lines):
    model, encoded = CrfEstimator(PAIRS).prepare(both(lines)[0])
    w = model.arrays()
    w.theta[:] = np.random.default_rng(2).integers(-8, 9, len(w.theta)) / 8
    y = len(w.labels)
    each = {r.sent_id: (np.array(r.u), np.array(r.b).reshape(-1, y, y)) for r in inference.potentials(encoded, w).collect()}
    for r in inference.summed_potentials(encoded, w).collect():
        u, b = each[r.sent_id]
        assert r.u == u.sum(0).tolist() and r.into == b[1:].sum((0, 1)).tolist()
    p = {r.sent_id: np.array(r.p) for r in inference.posteriors(encoded, w).collect()}
    paths = {r.sent_id: "".join(x.label for x in r.path) for r in inference.decode(encoded, w).collect()}
    for r in inference.certainties(encoded, w).collect():
        assert r.certainty == pytest.approx(p[r.sent_id].max(1).mean()) and r.middle == pytest.approx(p[r.sent_id][len(p[r.sent_id]) // 2].tolist())
    assert {r.sent_id: r.tags for r in inference.tagged(encoded, w).collect()} == paths


def test_a_batch_holds_texts_and_not_observations(spark, lines):
    """What is written of a position is a character and a tag; its ids, of which there are eleven, are read from its window."""
    _, encoded = CrfEstimator().prepare(both(lines)[0])
    assert encoded._windows.rows.columns == ["sent_id", "n", "text", "tags"]


def test_more_observations_than_a_broadcast_takes_are_joined(spark, lines, monkeypatch):
    texts, _ = both(lines)
    _, plain = CrfEstimator().prepare(texts)
    want = sorted((r.sent_id, r.n, list(r.at), list(r.obs), list(r.y)) for r in plain.collect())
    monkeypatch.setattr(inference, "BROADCAST_OBSERVATIONS", 0)
    _, joined = CrfEstimator().prepare(texts)
    assert sorted((r.sent_id, r.n, list(r.at), list(r.obs), list(r.y)) for r in joined.collect()) == want
