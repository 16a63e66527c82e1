"""SGD against the sequential algorithm, chains against log-space sums, two-tier encoding, batches by positions, sequences without labels."""

import numpy as np
import pyarrow as pa
import pytest

from tagloom.operators import inference, training
from tagloom.operators.inference import Batch, Weights
from tagloom.operators.templates import features
from tagloom.operators.training import Params, SgdState, indexed, sgd_epoch
from tagloom.plans.crf import CrfEstimator
from tagloom.sources import sequences as S

TEMPLATES = ["u0:%x[0,0]", "u1:%x[-1,0]", "*2:%x[0,0]/%x[1,0]", "b"]


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["ab", "c", "defg", "hi", "jkl"], n))) for i, n in enumerate([6, 1, 3, 9, 2, 30, 4, 5, 1, 7, 2, 8])]
    lines = spark.createDataFrame(rows, "id long, cut string").coalesce(1)
    model, encoded = CrfEstimator(TEMPLATES).prepare(S.from_segmented(lines, "id", "cut"))
    return model, encoded.coalesce(1).cache()


def sequential(sequences, w, p, epochs, order):
    """One sequence after the other, every weight by itself."""
    x, taken, due, i, n, y = w.theta.copy(), np.zeros(len(w.theta)), 0.0, 0, len(sequences), len(w.labels)
    for epoch in range(epochs):
        for k in order(epoch):
            b = Batch(sequences[k], Weights(w.labels, w.uoff, w.boff, x))
            b.__dict__["_scaled"] = None
            single, pair, _ = b.marginals()
            g, touched = np.zeros(len(x)), set()
            for f, t in zip(b.u_index, b.u_rows_at, strict=True):
                g[f : f + y] += single[t] - (np.arange(y) == b.gold[t])
                touched.update(range(f, f + y))
            for f, t in zip(b.b_index, b.b_rows_at, strict=True):
                if t:
                    g[f : f + y * y] += pair[t].ravel() - (np.arange(y * y) == b.gold[t - 1] * y + b.gold[t])
                touched.update(range(f, f + y * y))
            rate = p.eta0 * p.alpha ** (i / n)
            due += rate * p.l1 / n
            for f in touched:
                x[f] -= rate * g[f]
                z = x[f]
                x[f] = max(0.0, z - (due + taken[f])) if z > 0 else min(0.0, z + (due - taken[f])) if z < 0 else z
                taken[f] += x[f] - z
            i += 1
    return x


@pytest.mark.parametrize("l1", [0.0, 2.0])
def test_one_partition_is_the_sequential_algorithm(spark, prepared, l1):
    from pyspark.sql import functions as F

    model, encoded = prepared
    p = Params(algorithm="sgd", l1=l1)
    w = model.arrays()
    rows = {r["sent_id"]: pa.RecordBatch.from_pylist([r.asDict()], schema=pa.schema([("sent_id", pa.int64()), ("n", pa.int32()), ("at", pa.list_(pa.int32())), ("obs", pa.list_(pa.int64())), ("y", pa.list_(pa.int32()))])) for r in encoded.collect()}

    def order(epoch):
        return [r.sent_id for r in encoded.select("sent_id", F.xxhash64("sent_id", F.lit(p.seed), F.lit(epoch)).alias("o")).orderBy("o").collect()]

    walked, state = indexed(encoded, w).cache(), SgdState(w.theta, np.zeros(len(w.theta)))
    for epoch in range(5):
        state = sgd_epoch(walked, w, p, epoch, len(rows), state)
    want = sequential(rows, w, p, 5, order)
    assert np.abs(state.x - want).max() < 1e-9 and np.array_equal(state.x != 0, want != 0)
    assert (state.due > 0) == (l1 > 0)
    # several partitions, one of them empty: the mean of their walks, the same in every run
    parts = walked.repartition(3, "sent_id").cache()
    one, two = (sgd_epoch(parts, w, p, 0, len(rows), SgdState(w.theta, np.zeros(len(w.theta)))) for _ in range(2))
    assert np.array_equal(one.x, two.x) and one.due <= state.due


def test_blocked_chains_are_log_space_sums():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 17, 100, 1000):
        u, b = rng.normal(size=(n, 4)) * 3, rng.normal(size=(n, 4, 4)) * 3
        for got, want in zip(training._chain(u, b), training._log_chain(u, b), strict=True):
            assert np.allclose(got, want, atol=1e-10)
    # far apart: the walk takes log space and stays finite
    u[3] *= 1000
    assert all(np.isfinite(x).all() for x in training._log_chain(u, b))


def test_batches_by_positions(monkeypatch):
    monkeypatch.setattr(inference, "POSITIONS", 100)
    rng = np.random.default_rng(6)
    sizes = [0, 5, 99, 1, 250, 0, 3, 3, 60, 40, 1, 100, 101, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(14)), pa.array(sizes, pa.int32())], names=["sent_id", "n"])
    out = list(inference.sized(iter([batch.slice(0, 5), batch.slice(5, 0), batch.slice(5)])))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(14))
    assert all(sum(b.column(1).to_pylist()) <= 100 or sum(x > 0 for x in b.column(1).to_pylist()) == 1 for b in out) and len(out) < 9
    # results do not depend on the cut
    many = [int(x) for x in rng.integers(0, 120, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(many, pa.int32())], names=["sent_id", "n"])
    assert [x for b in inference.sized(iter([batch])) for x in b.column(1).to_pylist()] == many


def test_two_tier_encoding(spark, prepared, monkeypatch):
    model, _ = prepared
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(["ab", "c", "zz", "hi", "jkl", "q"], 6))) for i in range(40)] + [(50, "ab"), (51, "zzz")]
    seqs = features(S.from_segmented(spark.createDataFrame(rows, "id long, cut string").repartition(3), "id", "cut"), model.templates)
    dictionary = model.layout.select("obs_id", "obs")
    plain = {r.sent_id: (r.n, list(r.at), list(r.obs), list(r.y)) for r in inference.encode(seqs, dictionary, model.labels).collect()}
    monkeypatch.setattr(inference, "BROADCAST_OBSERVATIONS", 0)
    for tier in (200_000, 3, 0):
        monkeypatch.setattr(inference, "FREQUENT_OBSERVATIONS", tier)
        assert {r.sent_id: (r.n, list(r.at), list(r.obs), list(r.y)) for r in inference.encode(seqs, dictionary, model.labels).collect()} == plain


def test_sequences_without_labels_are_left_out(spark):
    rows = [(i, [["a"], ["b"]], ["B", "E"]) for i in range(20)] + [(30, [["a"], ["b"]], None), (31, [["a"], ["b"]], ["B", None]), (32, [["c"]], []), (33, [["a"]], ["S"])]
    df = spark.createDataFrame(rows, "sent_id long, cols array<array<string>>, labels array<string>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    for algorithm in ("l-bfgs", "sgd"):
        model = CrfEstimator(TEMPLATES, Params(algorithm=algorithm, max_iter=3)).fit(df)
        assert model.left_out == 3 and sorted(r.label for r in model.labels.collect()) == ["B", "E", "S"]
        assert all(r.obj is None or np.isfinite(r.obj) for r in model.log.collect())
    assert {k: spark.conf.get(k) for k in before} == before


def test_long_and_short_sequences_share_a_task(spark, prepared):
    """A 20,000-character line among short ones: batches are cut by positions, results are those of each alone."""
    model, _ = prepared
    lines = [(0, "ab" * 10_000)] + [(i, "abc" * (i % 5 + 1)) for i in range(1, 400)]
    seqs = S.from_segmented(spark.createDataFrame(lines, "id long, cut string").coalesce(1), "id", "cut")
    w = model.arrays()
    w.theta[:] = np.random.default_rng(8).normal(size=len(w.theta))
    encoded = model.encode(seqs)
    got = {r.sent_id: r.score for r in inference.decode(encoded, w).collect()}
    z = {r.sent_id: r.log_z for r in inference.posteriors(encoded, w).collect()}
    assert len(got) == 400 and all(z[k] >= got[k] for k in got) and got[5] == pytest.approx(got[10]) and z[5] == pytest.approx(z[10])


@pytest.mark.parametrize(("l1", "order"), [(0.3, "newest"), (0.0, "oldest")])
def test_vectors_as_tables_are_those_of_the_driver(spark, monkeypatch, l1, order):
    """The same training with the vectors on the driver and as tables, switched by the bound on the driver's memory only."""
    from tagloom.operators import distributed

    monkeypatch.setattr(distributed, "BLOCK_POSITIONS", 70)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["ab", "c", "defg", "hi"], n))) for i, n in enumerate(rng.integers(1, 12, 25).tolist())]
    seqs = S.from_segmented(spark.createDataFrame(rows, "id long, cut string"), "id", "cut").cache()
    params = {"l1": l1, "history_order": order, "max_iter": 5, "history": 3, "stop_eps": 1e-9}
    one = CrfEstimator(TEMPLATES, Params(**params)).fit(seqs)
    two = CrfEstimator(TEMPLATES, Params(**params, driver_weights=1)).fit(seqs)
    assert one.size == two.size > 1
    want, got = ({r.f: r.w for r in m.weights.collect()} for m in (one, two))
    assert all(abs(want.get(f, 0.0) - got.get(f, 0.0)) < 1e-7 for f in {*want, *got}) and (not l1 or set(want) == set(got))
    for a, b in zip(one.log.orderBy("iter").collect(), two.log.orderBy("iter").collect(), strict=True):
        assert (a.iter, a.active) == (b.iter, b.active) and (a.obj, a.token_error, a.sentence_error) == pytest.approx((b.obj, b.token_error, b.sentence_error), abs=1e-7)
    assert len(want) > 10
    with pytest.raises(ValueError):
        CrfEstimator(TEMPLATES, Params(algorithm="sgd", driver_weights=1)).fit(seqs)


def test_blocks_cover_all_sequences_once(spark, monkeypatch):
    from tagloom.operators import distributed

    monkeypatch.setattr(distributed, "BLOCK_POSITIONS", 10)
    rows = [(i * 7 % 101, i % 6) for i in range(101)]
    df = spark.createDataFrame(rows, "sent_id long, n int").repartition(5)
    got = distributed.blocked(df).collect()
    assert sorted((r.sent_id, r.n) for r in got) == sorted(rows)
    at, want = 0, {}
    for i, n in sorted(rows):
        want[i] = at // 10
        at += n
    assert {r.sent_id: r.block for r in got} == want


def test_stopping_rules_of_training_are_those_of_a_log(spark):
    from tagloom.operators import metrics
    from tagloom.operators.training import slow, steady

    rng = np.random.default_rng(11)
    p = Params(stop_eps=0.05, stop_window=3, objective_window=4)
    for _ in range(3):
        errors = np.round(0.3 + 0.0004 * rng.integers(0, 3, 25).cumsum() * rng.integers(0, 2, 25), 6).tolist()
        objectives = (1000 * (1 + 0.05 * rng.random(25)) / np.arange(1, 26) ** 0.2).tolist()
        log = spark.createDataFrame([(k, e, o) for k, (e, o) in enumerate(zip(errors, objectives, strict=True), 1)], "iter int, err double, obj double")
        want = {r.iter: r.stop for r in metrics.stopping(log, p.stop_window, p.objective_window, p.stop_eps).collect()}
        assert want == {k: steady(errors[:k], p) or slow(objectives[:k], p) for k in range(1, 26)} and len(set(want.values())) == 2
