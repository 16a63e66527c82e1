"""Models as text: templates, labels, observations, and non-zero weights as hexadecimal floats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions.storage import materialize
from tagloom.functions.text import hex_float
from tagloom.operators import dictionary as D
from tagloom.operators import templates as Tpl
from tagloom.plans.crf import CrfModel


def _netstring(text: str) -> bytes:
    raw = text.encode()
    return str(len(raw)).encode() + b":" + raw + b",\n"


def export_model(model: CrfModel) -> bytes:
    """The model in its text format. A model file is for exchange: it is put together on the driver."""
    columns = max((t.columns for t in model.templates), default=0)
    out = [f"#Patterns#{len(model.templates)}#{columns}\n".encode(), *(_netstring(t.source) for t in model.templates)]
    for table, key, name in ((model.labels, "label_id", "label"), (model.layout, "obs_id", "obs")):
        rows = table.orderBy(key).select(name).toPandas()[name].tolist()
        out += [f"#Trie#{len(rows)}\n".encode(), *map(_netstring, rows)]
    weights = model.weights.where(F.col("w") != 0).orderBy("f").collect()
    out.append(f"#Model#{len(weights)}\n".encode())
    out += [f"{r.f}={hex_float(r.w)}\n".encode() for r in weights]
    return b"".join(out)


def import_model(spark: SparkSession, raw: bytes) -> CrfModel:
    """A model from its text format."""
    at = 0

    def head(pattern: bytes) -> list[int]:
        nonlocal at
        m = re.compile(pattern + rb"\n").match(raw, at)
        if m is None:
            raise ValueError(f"no {pattern.decode()} at byte {at}")
        at = m.end()
        return [int(x) for x in m.groups()]

    def strings(n: int) -> list[str]:
        nonlocal at
        got = []
        for _ in range(n):
            to = raw.index(b":", at)
            size = int(raw[at:to])
            got.append(raw[to + 1 : to + 1 + size].decode())
            at = to + 1 + size + 2
        return got

    templates = [Tpl.parse(t) for t in strings(head(rb"#Patterns#(\d+)#(\d+)")[0])]
    labels = strings(head(rb"#Trie#(\d+)")[0])
    observations = strings(head(rb"#Trie#(\d+)")[0])
    head(rb"#Model#(\d+)")
    weights = [(int(f), float.fromhex(w)) for f, w in (line.split("=") for line in raw[at:].decode().splitlines() if line)]
    label_table = spark.createDataFrame(list(enumerate(labels)), "label_id long, label string")
    layout = materialize(D.layout(spark.createDataFrame(list(enumerate(observations)), "obs_id long, obs string"), len(labels)), "layout")
    size = layout.agg(F.sum(D.width(F.col("obs"), len(labels)))).first()[0] or 0
    return CrfModel(templates, label_table, layout, spark.createDataFrame(weights, "f long, w double"), int(size))


# --- the same format as a directory of part files, written and read by many tasks ---------


def write_model(model: CrfModel, path: str) -> None:
    """The model's text under path, in part files whose lines follow each other by name.

    Records are formatted where their rows are; only their order is a shuffle.
    """
    spark = model.labels.sparkSession
    columns = max((t.columns for t in model.templates), default=0)
    live = model.weights.where("w <> 0")
    heads = [(0, f"#Patterns#{len(model.templates)}#{columns}"), (1, f"#Trie#{model.labels.count()}"), (2, f"#Trie#{model.layout.count()}"), (3, f"#Model#{live.count()}")]
    rows = spark.createDataFrame([(s, -1, x) for s, x in heads], "section int, k long, value string")
    templates = spark.createDataFrame([(0, i, t.source) for i, t in enumerate(model.templates)], "section int, k long, value string")
    labels = model.labels.select(F.lit(1).alias("section"), F.col("label_id").alias("k"), F.col("label").alias("value"))
    observations = model.layout.select(F.lit(2).alias("section"), F.col("obs_id").alias("k"), F.col("obs").alias("value"))
    strings = templates.unionByName(labels).unionByName(observations)
    broken = F.when(F.col("value").contains("\n"), F.raise_error(F.lit("a record of a model file has no line feed"))).otherwise(F.col("value"))
    strings = strings.withColumn("value", F.concat(F.octet_length("value").cast("string"), F.lit(":"), broken, F.lit(",")))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, w = batch.column(0), batch.column(1)
            text = [f"{i}={hex_float(x)}" for i, x in zip(f.to_pylist(), w.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([3] * len(f), pa.int32()), f, pa.array(text, pa.string())], names=["section", "k", "value"])

    weights = live.select("f", "w").mapInArrow(formatted, "section int, k long, value string")
    rows.unionByName(strings).unionByName(weights).orderBy("section", "k").select("value").write.text(path)


def read_model(spark: SparkSession, path: str) -> CrfModel:
    """A model from its text, a file or a directory of part files: lines are read in splits and numbered by the splits' sizes."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value")
    lines = materialize(lines.where("value <> ''"), "lines")
    splits = lines.groupBy("file", "start").agg(F.min("n").alias("base"), F.max("n").alias("last"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("first", F.coalesce(F.sum(F.col("last") - F.col("base") + 1).over(before), F.lit(0))).select("file", "start", (F.col("first") - F.col("base")).alias("shift"))
    lines = lines.join(F.broadcast(splits), ["file", "start"]).select((F.col("n") + F.col("shift")).alias("at"), "value")
    heads = [(r["at"], r["value"]) for r in lines.where("value like '#%'").orderBy("at").limit(5).collect()]
    want = (r"#Patterns#\d+#\d+", r"#Trie#\d+", r"#Trie#\d+", r"#Model#\d+")
    if len(heads) != 4 or any(not re.fullmatch(p, x) for p, (_, x) in zip(want, heads, strict=True)):
        raise ValueError(f"not the headers of a model: {[x for _, x in heads]}")
    begins = [at for at, _ in heads]
    sizes = [int(x.split("#")[2]) for _, x in heads]

    def section(k: int) -> DataFrame:
        rows = lines.where(F.col("at") > begins[k])
        return (rows.where(F.col("at") < begins[k + 1]) if k < 3 else rows).select((F.col("at") - begins[k] - 1).alias("k"), "value")

    def strings(k: int) -> DataFrame:
        colon = F.instr("value", ":")
        size, own = F.expr("try_cast(substring(value, 1, instr(value, ':') - 1) as int)"), F.expr("substring(value, instr(value, ':') + 1, length(value) - instr(value, ':') - 1)")
        whole = (colon > 0) & F.col("value").endswith(",") & F.coalesce(F.octet_length(own) == size, F.lit(False))
        return section(k).select("k", F.when(whole, own).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.col("value")))).alias("value"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [x.split("=") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(f) for f, _ in pairs], pa.int64()), pa.array([float.fromhex(w) for _, w in pairs], pa.float64())], names=["f", "w"])

    templates = [Tpl.parse(r["value"]) for r in strings(0).orderBy("k").collect()]
    labels = materialize(strings(1).toDF("label_id", "label"), "labels")
    layout = materialize(D.layout(strings(2).toDF("obs_id", "obs"), sizes[1]), "layout")
    weights = materialize(section(3).select("value").mapInArrow(parsed, "f long, w double"), "weights")
    found = [len(templates), labels.count(), layout.count(), weights.count()]
    if found != sizes:
        raise ValueError(f"a model of {sizes} records has {found}")
    size = layout.agg(F.sum(D.width(F.col("obs"), sizes[1]))).first()[0] or 0
    return CrfModel(templates, labels, layout, weights, int(size))
