"""Inference against path enumeration, gradients against differences, training, model files, segmentation."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from tagloom.operators.inference import Batch, Weights
from tagloom.operators.training import Params, direction, lbfgs, pseudo_gradient
from tagloom.plans.crf import CrfEstimator, CrfModel
from tagloom.sources import model_text
from tagloom.sources import sequences as S

Y = 3


def batch_of(sizes, rng, labels=Y, n_obs=6):
    at, obs, y = [], [], []
    for n in sizes:
        pairs = sorted((t, int(o)) for t in range(n) for o in rng.choice(n_obs, 2, replace=False))
        at.append([t for t, _ in pairs])
        obs.append([o for _, o in pairs])
        y.append(rng.integers(0, labels, n).tolist())
    return pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(sizes, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(obs, pa.list_(pa.int64())), pa.array(y, pa.list_(pa.int32()))], names=["sent_id", "n", "at", "obs", "y"])


def weights_of(rng, n_obs=6):
    wide, uoff, boff, at = [Y, Y * Y, Y + Y * Y], [], [], 0
    for o in range(n_obs):
        k = o % 3
        uoff.append(at if k != 1 else -1)
        boff.append(-1 if k == 0 else at if k == 1 else at + Y)
        at += wide[k]
    return Weights(list("ABC"), np.array(uoff), np.array(boff), rng.normal(size=at))


def paths(b, s):
    n, a = int(b.n[s]), int(b.begin[s])
    for p in itertools.product(range(Y), repeat=n):
        yield p, sum(b.u[a + t, p[t]] + (b.b[a + t, p[t - 1], p[t]] if t else 0) for t in range(n))


def test_unknown_labels_have_no_score():
    rng = np.random.default_rng(1)
    rows, weights = batch_of([3, 2, 4], rng), weights_of(rng)
    whole = Batch(rows, weights)
    want = {int(s): x for s, x in zip(whole.lanes, whole.gold_scores(), strict=True)}
    gold = rows.column(4).to_pylist()
    for changed in ([-1, *gold[0][1:]], [], None, [None, *gold[0][1:]]):
        column = pa.array([changed, *gold[1:]], rows.column(4).type)
        b = Batch(pa.RecordBatch.from_arrays([*rows.columns[:4], column], names=rows.schema.names), weights)
        got = {int(s): x for s, x in zip(b.lanes, b.gold_scores(), strict=True)}
        assert np.isnan(got[0]) and got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[2])


def test_inference_matches_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(5):
        b = Batch(batch_of([3, 0, 1, 5, 2], rng), weights_of(rng))
        path, score, own = b.viterbi()
        single, pair, z = b.marginals()
        gold = b.gold_scores()
        for lane, s in enumerate(b.lanes):
            every = list(paths(b, s))
            a, n = int(b.begin[s]), int(b.n[s])
            best = max(every, key=lambda x: x[1])
            assert tuple(path[a : a + n]) == best[0] and score[lane] == pytest.approx(best[1]) and own[a : a + n].sum() == pytest.approx(best[1])
            total = np.logaddexp.reduce([x for _, x in every])
            assert z[lane] == pytest.approx(total)
            assert gold[lane] == pytest.approx(dict(every)[tuple(b.gold[a : a + n])])
            for t in range(n):
                for y in range(Y):
                    assert single[a + t, y] == pytest.approx(sum(np.exp(x - total) for p, x in every if p[t] == y))
                    if t:
                        assert pair[a + t, 1, y] == pytest.approx(sum(np.exp(x - total) for p, x in every if p[t] == y and p[t - 1] == 1))


def test_scaled_sums_agree_with_log_space(monkeypatch):
    from tagloom.operators import inference

    rng = np.random.default_rng(4)
    for wide in (1.0, 40.0, 120.0, 4000.0):
        w = weights_of(rng)
        w.theta *= wide
        raw = batch_of([7, 0, 1, 60, 3], rng)
        got = *Batch(raw, w).marginals(), Batch(raw, w).log_z()
        with monkeypatch.context() as m:
            m.setattr(inference, "SCALED_SPREAD", -1.0)
            want = *Batch(raw, w).marginals(), Batch(raw, w).log_z()
        for a, b in zip(got, want, strict=True):
            assert np.isfinite(a).all() and np.allclose(a, b, rtol=1e-7, atol=1e-7)


def test_viterbi_ties_go_to_lower_ids():
    rng = np.random.default_rng(1)
    w = weights_of(rng)
    w.theta[:] = 0
    path, score, _ = Batch(batch_of([4], rng), w).viterbi()
    assert path.tolist() == [0, 0, 0, 0] and score.tolist() == [0]


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    raw, w = batch_of([4, 2, 1], rng), weights_of(rng)
    size = len(w.theta)

    def loss(theta):
        return Batch(raw, Weights(w.labels, w.uoff, w.boff, theta)).expected(size)

    expected, _ = loss(w.theta)
    for f in range(size):
        e = np.zeros(size)
        e[f] = 1e-5
        slope = (loss(w.theta + e)[1] - loss(w.theta - e)[1]) / 2e-5
        b = Batch(raw, w)
        gold = np.zeros(size)
        np.add.at(gold, b.u_index + b.gold[b.u_rows_at], 1)
        inner = ~np.isin(b.b_rows_at, b.start)
        np.add.at(gold, b.b_index[inner] + b.gold[b.b_rows_at[inner] - 1] * Y + b.gold[b.b_rows_at[inner]], 1)
        assert expected[f] - gold[f] == pytest.approx(slope, abs=1e-6)


def test_optimiser_finds_the_minimum():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(20, 6))
    target = rng.normal(size=20)
    for l1 in (0.0, 0.7):
        for order in ("newest", "oldest"):
            p = Params(l1=l1, l2=0.1, stop_eps=1e-12, history_order=order)

            def objective(x, l1=l1):
                r = a @ x - target
                return r @ r / 2 + l1 * np.abs(x).sum() + 0.05 * x @ x, a.T @ r + 0.1 * x

            x = lbfgs(objective, np.zeros(6), p, lambda *_: False)
            assert np.abs(pseudo_gradient(x, objective(x)[1], l1) if l1 else objective(x)[1]).max() < 1e-2
    assert np.allclose(direction(np.ones(3), [], []), -1)


@pytest.mark.parametrize("bad", [{"l1": -1}, {"max_iter": 0}, {"algorithm": "x"}, {"stop_eps": 0}, {"history_order": "z"}])
def test_bad_options_raise(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_first_iteration_on_three_characters(spark):
    three = spark.createDataFrame([(0, [["中"], ["国"], ["人"]], ["B", "E", "S"])], "sent_id long, cols array<array<string>>, labels array<string>")
    from tagloom.operators.training import objective_of

    est = CrfEstimator()
    model, encoded = est.prepare(three)
    arrays = model.arrays()
    f, g = objective_of(encoded, arrays, est.params)(arrays.theta)
    assert model.size == 99 and f == pytest.approx(3.295836866004329)
    pg = pseudo_gradient(arrays.theta, g, 0.5)
    assert np.count_nonzero(pg) == 32 and np.linalg.norm(pg) == pytest.approx(0.9938079899999069)
    x = -pg / np.linalg.norm(pg)
    assert objective_of(encoded, arrays, est.params)(x)[0] == pytest.approx(3.5209650784992026)
    assert objective_of(encoded, arrays, est.params)(0.1 * x)[0] - 0.05 * 0 == pytest.approx(3.2069515502281183)
    at = np.flatnonzero(x)
    model.weights = spark.createDataFrame(list(zip(at.tolist(), x[at].tolist(), strict=True)), "f long, w double")
    row = model.transform(three).first()
    assert [p.label for p in row.path] == ["B", "E", "S"] and row.score == pytest.approx(5.590169943749473)
    assert [p.score for p in row.path] == pytest.approx([1.677050983124842, 1.9565594803123156, 1.9565594803123156])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["ab", "c", "defg", "hi", "jkl"]
    rows = [(i, " ".join(rng.choice(vocabulary, 6))) for i in range(60)]
    return S.from_segmented(spark.createDataFrame(rows, "id long, cut string"), "id", "cut").cache()


@pytest.mark.parametrize("algorithm", ["l-bfgs", "sgd"])
def test_training_learns_to_segment(spark, corpus, algorithm, tmp_path):
    model = CrfEstimator(params=Params(algorithm=algorithm, max_iter=6, l1=0.1)).fit(corpus)
    assert model.log.orderBy("iter").collect()[-1].token_error < 0.02
    lines = spark.createDataFrame([(1, "abcdefghi jklc"), (2, ""), (3, None), (4, "  ab?c ")], "id long, text string")
    got = {r.id: r.segmented for r in model.segment(lines, "text").collect()}
    assert got[1] == "ab c defg hi jkl c" and got[2] == "" and got[3] == "" and got[4].replace(" ", "") == "ab?c"
    model.save(str(tmp_path / "m"))
    again = CrfModel.load(spark, str(tmp_path / "m"))
    small = model.compact()
    text = model_text.export_model(model)
    read = model_text.import_model(spark, text)
    want = sorted((r.sent_id, round(r.score, 6), tuple(p.label for p in r.path)) for r in model.transform(corpus).collect())
    for other in (again, small, read):
        assert sorted((r.sent_id, round(r.score, 6), tuple(p.label for p in r.path)) for r in other.transform(corpus).collect()) == want
    assert small.size <= model.size and model_text.export_model(read) == text
    from tagloom.operators.inference import _encode_by_join, encode
    from tagloom.operators.templates import features

    seqs, names = features(corpus, model.templates), [r.label for r in model.labels.orderBy("label_id").collect()]
    plain = {r.sent_id: (r.n, sorted(zip(r.at, r.obs, strict=True)), r.y) for r in encode(seqs, model.layout.select("obs_id", "obs"), model.labels).collect()}
    joined = {r.sent_id: (r.n, sorted(zip(r.at, r.obs, strict=True)), r.y) for r in _encode_by_join(seqs, model.layout.select("obs_id", "obs"), names).collect()}
    assert plain == joined


def test_streaming_segmentation(spark, corpus, tmp_path):
    from tagloom.streaming.label import write_segments

    model = CrfEstimator(params=Params(max_iter=4, l1=0.1)).fit(corpus)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abchi\n\nquit\ndefgjkl\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    write_segments(stream, model, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["ab c hi", "defg jkl"]


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["obs_id", "obs"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registered_queries_train_with_the_defaults(spark, monkeypatch):
    from tagloom.plans import queries

    seen = []
    monkeypatch.setattr(queries, "materialize", lambda df, name: df)
    monkeypatch.setattr(queries, "_sequences", lambda spark, sf_dir: None)
    monkeypatch.setattr(queries.CrfEstimator, "fit", lambda self, sequences: seen.append(self.params))
    for algorithm in ("l-bfgs", "sgd-l1"):
        queries._trained(spark, "", algorithm)
    assert seen == [Params(algorithm="l-bfgs"), Params(algorithm="sgd-l1")] and seen[0].max_iter == 100
