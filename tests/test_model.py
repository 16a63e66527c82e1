"""Models in one process, in SQL, as text by many tasks; the command line; lengths, active weights, decoded ids."""

import io
import json
import time

import numpy as np
import pytest

from tagloom import __main__ as cli
from tagloom.operators import dictionary, metrics
from tagloom.operators import templates as Tpl
from tagloom.operators.local import LocalModel
from tagloom.operators.training import Params
from tagloom.plans.crf import CrfEstimator, CrfModel
from tagloom.sources import model_text
from tagloom.sources import sequences as S


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["ab", "c", "defg", "hi", "jkl"], 6))) for i in range(60)]
    return CrfEstimator(params=Params(max_iter=5, l1=0.1)).fit(S.from_segmented(spark.createDataFrame(rows, "id long, cut string"), "id", "cut"))


TEXTS = ["abcdefghi jklc", "", None, "  ab?c ", "c", "jkl\tab\n\ndefg  hi", "é字ab", "x" * 300, " 　ab\xa0c"]


def test_local_observations_are_those_of_the_columns(spark):
    sources = ["u:%x[@1,0]", "u:%x[@-1,1]", "u:%x[@0,0]", "u:%x[-5,0]", "u:%x[7,0]", "u:%X[0,0]", 'u:%t[0,0,"\\\\d$"]', 'u:%m[0,0,"\\\\l\\\\a*"]', 'u:%M[-1,0,"^A."]', "*:%x[@5,0]", "U%x[0,0]/%x[0,1]", "u:%x[@-4,0]", 'u:%m[1,0,"a?b*\\\\."]', "b"]
    rows = [[["Ab1", "x"], ["cD", "y"], ["ef", "z"]], [["é.", "("]], [["ab.", "1"], ["\n", "\\Q"]]]
    df = spark.createDataFrame(list(enumerate(rows)), "sent_id long, cols array<array<string>>")
    want = {r.sent_id: r.obs for r in Tpl.features(df, [Tpl.parse(s) for s in sources]).collect()}
    local = LocalModel(sources, None, None)
    assert {k: local.observations(r) for k, r in enumerate(rows)} == want


def test_segment_in_sql_is_that_of_the_model(spark, model):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    want = {r.id: r.segmented for r in model.segment(df, "text").collect()}
    model.register("segment")
    df.createOrReplaceTempView("texts")
    got = {r.id: r.s for r in spark.sql("SELECT id, segment(text) AS s FROM texts").collect()}
    assert got.pop(2) is None and want.pop(2) == "" and got == want
    assert spark.sql("SELECT segment(upper(text)) AS s FROM texts WHERE id = 4").first().s == "C"
    local = LocalModel.of(model)
    assert local.segment(TEXTS) == [r.segmented for r in model.segment(df, "text").orderBy("id").collect()]
    begun = time.time()
    for _ in range(50):
        local.segment(["abcdefghijklc"])
    assert (time.time() - begun) / 50 < 0.05  # seconds a line


def test_model_text_by_many_tasks(spark, model, tmp_path):
    model_text.write_model(model, str(tmp_path / "m"))
    parts = sorted(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part"))
    assert b"".join(p.read_bytes() for p in parts) == model_text.export_model(model)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        read = model_text.read_model(spark, str(tmp_path / "m"))
        (tmp_path / "one").write_bytes(model_text.export_model(model))
        single = model_text.read_model(spark, str(tmp_path / "one"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for other in (read, single):
        assert model_text.export_model(other) == model_text.export_model(model) and other.size == model.size
    for bad in (b"#Patterns#1#1\n3:u:a,\n", model_text.export_model(model).replace(b"#Model#", b"#Model#1"), model_text.export_model(model).replace(b":u02", b":u2", 1)):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(Exception, match="headers|records|not a record"):
            model_text.read_model(spark, str(tmp_path / "bad"))


def test_lengths_active_weights_and_ids(spark, model):
    df = spark.createDataFrame([(k, [["a"]] * n) for k, n in enumerate([0, 1, 2, 3, 4, 7, 8, 8])], "sent_id long, cols array<array<string>>")
    got = {r.step: (r.n_seq, r.n_pos, r.longest) for r in metrics.lengths(df).collect()}
    assert got == {0: (1, 0, 0), 1: (1, 1, 1), 2: (2, 5, 3), 3: (2, 11, 7), 4: (2, 16, 8)}
    assert metrics.longest(df) == 8 and metrics.longest(df.limit(0)) == 0
    rows = spark.createDataFrame([(0, 1.5), (1, 0.0), (2, -2.0)], "f long, w double")
    got = metrics.active(rows).first()
    assert (got.n_active, got.l1, got.l2) == (2, 3.5, 6.25)
    ids = spark.createDataFrame([(0,), (0,), (3,), (10**9,)], "obs_id long")
    table = {r.obs_id: r.obs for r in model.layout.collect()}
    assert sorted((r.obs_id, r.obs) for r in dictionary.strings_of(ids, model.layout).where("obs_id < 9").collect()) == [(0, table[0]), (0, table[0]), (3, table[3])]
    assert dictionary.strings_of(ids, model.layout).where("obs is null").count() == 1


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    rng = np.random.default_rng(4)
    lines = [json.dumps({"cut": " ".join(rng.choice(["ab", "c", "defg", "hi"], 5))}) for _ in range(40)]
    at = {k: str(tmp_path / k) for k in ("json", "columns", "model", "plain", "out", "text", "words", "pattern")}
    (tmp_path / "json").write_text("\n".join([*lines, "broken"]))
    assert cli.main(["prepare", at["json"], at["columns"]]) == 0
    (tmp_path / "pattern").write_text("# all\nU0:%x[0,0]\nu1:%x[-1,0]\nu2:%x[1,0]\n\nb\n")
    assert cli.main(["fit", "-p", at["pattern"], "-i", "6", "-1", "0.1", at["columns"], at["model"]]) == 0
    trained = CrfModel.load(spark, at["model"])
    assert [t.source for t in trained.templates] == ["u0:%x[0,0]", "u1:%x[-1,0]", "u2:%x[1,0]", "b"]
    S.write_sequences(S.read_sequences(spark, at["columns"], True), at["plain"], labelled=False)
    assert cli.main(["test", "-m", at["model"], at["plain"], at["out"]]) == 0
    capsys.readouterr()
    assert cli.main(["evaluate", at["columns"], at["out"]]) == 0
    shown = capsys.readouterr().out
    assert "token_error" in shown and "|f1" in shown.replace(" ", "")
    pairs = S.read_sequences(spark, at["columns"], True).select("sent_id", "labels").join(S.read_sequences_of_results(spark, at["out"]), "sent_id")
    assert pairs.count() == 40 and metrics.error_rates(pairs).first().token_error < 0.05
    (tmp_path / "text").write_text("abchi\n\ndefgab\n")
    assert cli.main(["segment", "-m", at["model"], at["text"], at["words"]]) == 0
    assert sorted(r.value for r in spark.read.text(at["words"]).collect()) == ["", "ab c hi", "defg ab"]
    monkeypatch.setattr("sys.stdin", io.StringIO("abchi\n\n  defgab \nquit\nnever\n"))
    capsys.readouterr()
    assert cli.main(["segment", "-m", at["model"]]) == 0
    assert capsys.readouterr().out.splitlines() == ["ab c hi", "defg ab"]
    assert cli.main(["stats", "-m", at["model"]]) == 0
    assert "n_active" in capsys.readouterr().out
    for bad in (["fit", "one"], ["segment", "one"], ["test", "a", "b"], ["other"]):
        with pytest.raises(SystemExit):
            cli.arguments(bad)
