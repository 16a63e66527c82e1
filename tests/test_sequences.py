"""Sources, templates, dictionaries, tags and metrics on small hand-made sequences."""

import pytest

from tagloom.functions.text import bmes, joined_by_tags, split_fields, trim_line
from tagloom.operators import dictionary, metrics, templates
from tagloom.operators.segmentation import with_spans, words
from tagloom.sources import sequences as S


def test_trim_and_split_keep_other_white_space(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("\t a  b\tc \r\n",), ("　x　",), ("",)], "v string")
    rows = df.select(trim_line(F.col("v")).alias("t"), split_fields(trim_line(F.col("v"))).alias("f")).collect()
    assert [(r.t, r.f) for r in rows] == [("a  b\tc", ["a", "b\tc"]), ("　x　", ["　x　"]), ("", [])]


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame([(0, [["中"], ["国"], ["人"]], ["B", "E", "S"])], "sent_id long, cols array<array<string>>, labels array<string>")


def test_default_features(spark, three):
    parsed = [templates.parse(t) for t in templates.DEFAULT_TEMPLATES]
    obs = templates.features(three, parsed).first().obs
    assert obs[0] == ["u00:_x-2", "u01:_x-1", "u02:中", "u03:国", "u04:人", "u05:_x-1/中", "u06:中/国", "u07:_x-2/_x-1", "u08:国/人", "u09:_x-1/国", "b"]
    assert obs[2] == ["u00:中", "u01:国", "u02:人", "u03:_x+1", "u04:_x+2", "u05:国/人", "u06:人/_x+1", "u07:中/国", "u08:_x+1/_x+2", "u09:国/_x+1", "b"]
    ids = dictionary.observations(templates.exploded(templates.features(three, parsed)))
    layout = {r.obs: r for r in dictionary.layout(ids, 3).collect()}
    assert len(layout) == 31 and (layout["b"].obs_id, layout["b"].boff, layout["b"].uoff) == (10, 30, None)
    assert min(r.uoff for o, r in layout.items() if r.obs_id > 10) == 39
    assert {r.label: r.label_id for r in dictionary.labels(three).collect()} == {"B": 0, "E": 1, "S": 2}


def test_ids_from_distinct_windows_are_those_of_all_positions(spark):
    rows = [(9_000_000_000_001, "aab"), (3, "ba"), (-4, "abab"), (7, "b"), (8, "abab")]
    df = spark.createDataFrame([(i, [[c, c.upper()] for c in x], ["S"] * len(x)) for i, x in rows], "sent_id long, cols array<array<string>>, labels array<string>")
    parsed = [templates.parse(t) for t in ("u0:%x[0,0]", "u1:%x[-1,0]/%x[1,1]", "u0:%x[0,0]", "*2:%x[@-1,1]", 'u3:%t[0,1,"A"]', "b")]
    every = dictionary.observations(templates.exploded(templates.features(df, parsed))).collect()
    assert {(r.obs_id, r.obs) for r in every} == {(r.obs_id, r.obs) for r in dictionary.observations_in(df, parsed).collect()}
    counts = {r.k: r["sum(n)"] for r in templates.distinct(df, parsed).groupBy("k").sum("n").collect()}
    assert counts == dict.fromkeys(range(6), 14)
    assert dictionary.observations_in(df.limit(0), parsed).count() == 0


def test_template_macros(spark):
    df = spark.createDataFrame([(0, [["Ab1", "x"], ["cD", "y"], ["ef", "z"]], None)], "sent_id long, cols array<array<string>>, labels array<string>")
    sources = ["u:%x[@1,0]", "u:%x[@-1,1]", "u:%x[@0,0]", "u:%x[-5,0]", "u:%x[7,0]", "u:%X[0,0]", 'u:%t[0,0,"\\\\d$"]', 'u:%m[0,0,"\\\\l\\\\a*"]', 'u:%M[-1,0,"^A."]', "*:%x[@5,0]", "U%x[0,0]/%x[0,1]"]
    obs = templates.features(df, [templates.parse(s) for s in sources]).first().obs
    assert obs[0] == ["u:Ab1", "u:z", "u:_x-1", "u:_x-#", "u:_x+#", "u:ab1", "u:true", "u:b", "u:", "*:_x+2", "uAb1/x"]
    assert obs[1] == ["u:Ab1", "u:z", "u:_x-1", "u:_x-4", "u:_x+#", "u:cd", "u:false", "u:c", "u:ab", "*:_x+2", "ucD/y"]


@pytest.mark.parametrize("bad", ["x:%x[0,0]", "u:%y[0,0]", "u:%x[a,0]", "u:%x[0,0", 'u:%x[0,0,"a"]', "u:%t[0,0]", ""])
def test_bad_templates_raise(bad):
    with pytest.raises(ValueError):
        templates.parse(bad)


@pytest.mark.parametrize(("pattern", "text", "found"), [("a*", "aaa", (0, 0)), ("a*b", "aab", (0, 3)), ("a*$", "baa", (1, 3)), ("a?", "aaa", (0, 1)), ("^b", "ab", None), ("", "x", (0, 0)), ("a+", "aa+", (1, 3)), ("\\D\\.", "1a.", (1, 3)), (".$", "a\n", (1, 2))])
def test_patterns(spark, pattern, text, found):
    m = spark._jvm.java.util.regex.Pattern.compile(templates.to_java_pattern(pattern)).matcher(text)
    assert ((m.start(), m.end()) if m.find() else None) == found


def test_templates_of_a_file():
    assert [t.source for t in templates.parse_file("# all\nU0:%x[0,0] # here\n\n  B\n")] == ["u0:%x[0,0]", "b"]
    with pytest.raises(ValueError):
        templates.parse_file("u0:%x[0,0]\nz")


def test_tags_and_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a",), ("ab",), ("abcd",)], "w string")
    assert [r[0] for r in df.select(bmes(F.col("w"))).collect()] == ["S", "BE", "BMME"]
    tags = spark.createDataFrame([("BBEMS", "abcde"), ("MMESB", "abcde"), ("S", "a"), ("BE", "ab")], "t string, c string").select(F.split("t", "").alias("t"), F.split("c", "").alias("c"))
    rows = with_spans(tags, "t", "s").select(words(F.col("c"), F.col("s")).alias("w"), joined_by_tags(F.col("c"), F.col("t")).alias("j")).collect()
    assert [r.w for r in rows] == [["a", "bc", "d", "e"], ["abc", "d", "e"], ["a"], ["ab"]]
    assert rows[3].j == "ab" and rows[0].j == "abc de"


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n\na B\nb E\n\n\nc S")
    (tmp_path / "b.txt").write_text("d 1 X\r\n\r\n")
    rows = sorted(S.read_sequences(spark, str(tmp_path), True).collect(), key=lambda r: r.sent_id)
    assert [(r.cols, r.labels) for r in rows] == [([["a"], ["b"]], ["B", "E"]), ([["c"]], ["S"]), ([["d", "1"]], ["X"])]
    plain = S.read_sequences(spark, str(tmp_path / "b.txt"), False).first()
    assert plain.cols == [["d", "1", "X"]] and plain.labels is None
    S.write_sequences(S.read_sequences(spark, str(tmp_path / "a.txt"), True), str(tmp_path / "out"))
    again = S.read_sequences(spark, str(tmp_path / "out"), True)
    assert sorted(r.labels for r in again.collect()) == [["B", "E"], ["S"]]


def test_json_lines(spark):
    lines = ["not json", '{"source":"x"}', '{"cut":"ab [c [ d"}', "", '{"cut":5}', '{"cut":"  "}', '{"cut":null}']
    df = spark.createDataFrame(list(enumerate(lines)), "id long, value string")
    rows = S.from_segmented(S.from_json_lines(df), "id", "cut").collect()
    assert [(r.sent_id, [c[0] for c in r.cols], r.labels) for r in rows] == [(2, list("abcd"), ["B", "E", "S", "S"])]


def test_metrics(spark):
    rows = [(list("BES"), list("BES")), (list("SS"), list("BE")), (list("BME"), ["B", "M", None])]
    df = spark.createDataFrame(rows, "labels array<string>, predicted array<string>")
    got = metrics.error_rates(df).first()
    assert (got.n_tok, got.bad_tok, got.n_sent, got.bad_sent) == (8, 3, 3, 2)
    assert metrics.error_rates(df.limit(0)).first().token_error == 0
    w = metrics.word_scores(df).first()
    assert (w.gold_w, w.pred_w, w.hit_w) == (5, 4, 3) and metrics.word_scores(df.limit(0)).first().f1 == 0


def test_stopping(spark):
    log = spark.createDataFrame([(i, 0.5 - 0.1 * min(i, 3), 100.0 - i) for i in range(1, 9)], "iter int, err double, obj double")
    rows = metrics.stopping(log).orderBy("iter").collect()
    assert rows[3].spread is None and rows[4].spread == pytest.approx(20) and rows[7].spread == pytest.approx(0) and rows[7].stop
    assert rows[4].change is None and rows[5].change == pytest.approx(4 / 94)


def test_numbering_does_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as v")
    for n in (1, 7):
        got = dictionary.numbered(df.repartition(n), ["v"], "k").collect()
        assert all(r.k == r.v for r in got)
