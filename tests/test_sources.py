"""Line files read by splits, result files and labelled sinks, storage of intermediate tables."""

import os
import random

import pytest
from pyspark.sql import SparkSession

from tagloom.functions import storage
from tagloom.sources import sequences as S
from tagloom.sources import splits


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of some hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(old, ("300b", "0"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def blocks(text):
    out = [[]]
    for line in text.split("\n"):
        if line.strip(" \t\r"):
            out[-1].append(line.strip(" \t\r"))
        else:
            out.append([])
    return [b for b in out if b]


def write(path, texts):
    for k, text in enumerate(texts):
        (path / f"{k:02d}.txt").write_bytes(text.encode())


def test_splits_give_the_sequences_of_whole_files(spark, tmp_path, small_splits):
    rng = random.Random(1)
    odd = ["", "\n\n", "one line", "a\n\x1e\nb\n\n\n\nc", "x\r\ny\r\n\r\nz\rw", " \t\n a \n\t\n", "\n" * 900, "long " * 200 + "\n\n" + "end"]
    mixed = ["\n".join(rng.choice(["", "", " ", "é", "ab cd", "line of some more characters"]) for _ in range(n)) for n in (5, 80, 400)]
    single = ["\n".join(f"row {i}" for i in range(300))]
    files = [*odd, *mixed, *single, "tail\nleft open", "\nnext file"]
    write(tmp_path, files)
    lines = splits.lines_of_files(spark, str(tmp_path))
    assert lines.select("file", "start").distinct().count() > 25
    got = sorted((r.sent_id, list(r.lines)) for r in splits.sequences_of_lines(lines).collect())
    assert got == list(enumerate(b for f in files for b in blocks(f)))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "big.txt").write_text("".join(f"{i} A\n{i + 1} B\n\n" for i in range(3000)))
    lines = splits.lines_of_files(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    rows = sorted(S.read_sequences(spark, str(tmp_path), True).collect())
    assert [r.sent_id for r in rows] == list(range(3000)) and all(r.cols == [[str(i)], [str(i + 1)]] and r.labels == ["A", "B"] for i, r in enumerate(rows))


def test_text_rows_keep_record_separators(spark):
    texts = ["a\n\x1e\nb\n\n\n\nc", "\n\n", "x\r\n\r\ny \n z", " \n\t\na", "", "one", "\n" * 50_000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    got = {}
    for r in S.sequences_of(df).collect():
        got.setdefault(r.file, []).append(list(r.lines))
    assert got == {k: blocks(t) for k, t in enumerate(texts) if blocks(t)}


def test_more_lines_than_ids_raise(spark, monkeypatch):
    monkeypatch.setattr(S, "LINES", 3)
    df = spark.createDataFrame([(1, "a\nb\nc")], "id long, text string")
    assert [r.sent_id for r in S.lines_of(df, "id", "text").collect()] == [3, 4, 5]
    with pytest.raises(Exception, match="more than 3 lines"):
        S.lines_of(spark.createDataFrame([(1, "a\nb\nc\nd")], "id long, text string"), "id", "text").collect()


def test_labelled_and_result_files(spark, tmp_path, small_splits):
    rows = [(i, 1.5 * i, [("B" if i % 2 else "S", 0.123456789 * i), ("E", -2e-7), (None, 1e10)][: i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "sent_id long, score double, path array<struct<label:string,score:double>>").repartition(3)
    text = {r.sent_id: r.value for r in S.labelled_text(df).collect()}
    for i, score, path in rows:
        assert text[i] == f"score={score:.6g}\n" + "\n".join(f"{y or ''} {w:.6g}" for y, w in path) + "\n"
    S.write_labelled(df.where("sent_id % 4 <> 0 and sent_id % 4 <> 3"), str(tmp_path / "out"))
    found = sorted(S.read_sequences_of_results(spark, str(tmp_path / "out")).collect())
    kept = [p for i, _, p in rows if i % 4 in (1, 2)]
    assert [(r.sent_id, list(r.predicted)) for r in found] == [(k, [y for y, _ in p]) for k, p in enumerate(kept)]


def test_unlabelled_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [["a", "b"], ["c", "d"]], ["X", "Y"]), (2, [["é", "?"]], ["Z"])], "sent_id long, cols array<array<string>>, labels array<string>")
    S.write_sequences(df, str(tmp_path / "plain"), labelled=False)
    rows = sorted(S.read_sequences(spark, str(tmp_path / "plain"), False).collect())
    assert [r.cols for r in rows] == [[["a", "b"], ["c", "d"]], [["é", "?"]]] and all(r.labels is None for r in rows)


def test_storage_without_a_checkpoint_folder(spark, monkeypatch):
    """A session that names no folder gets one that stays the same; nothing is set in the session."""
    before = dict(spark.sparkContext.getConf().getAll())
    real = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: None if key == "spark.checkpoint.dir" else real(self, key, *a))
    monkeypatch.setattr(type(spark.sparkContext.getConf()), "get", lambda self, key, default=None: None)
    monkeypatch.setattr(storage, "_MADE", {})
    path = storage.shared_dir(spark)
    assert path.startswith("file://") and storage.shared_dir(spark) == path
    made = storage.materialize(spark.range(5), "five")
    assert made.count() == 5 and made._written_to.startswith(path)
    storage.discard(made)
    assert not os.path.exists(made._written_to.removeprefix("file://"))
    monkeypatch.undo()
    assert dict(spark.sparkContext.getConf().getAll()) == before and isinstance(spark, SparkSession)
