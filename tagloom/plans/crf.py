"""Conditional random field over sequences: estimator and model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.storage import discard, materialize
from tagloom.functions.text import characters, joined_by_tags
from tagloom.operators import dictionary as D
from tagloom.operators import inference
from tagloom.operators import templates as Tpl
from tagloom.operators import windows
from tagloom.operators.distributed import TableObjective, lbfgs_tables
from tagloom.operators.local import LocalModel
from tagloom.operators.training import Log, Params, SgdState, indexed, lbfgs, objective_of, sgd_epoch, steady


@dataclass
class CrfModel:
    """Templates, dictionaries and weights. The tables are DataFrames; weights(f, w) are sparse."""

    templates: list[Tpl.Template]
    labels: DataFrame  # label_id, label
    layout: DataFrame  # obs_id, obs, kind, uoff, boff
    weights: DataFrame  # f, w
    size: int
    log: DataFrame | None = None
    left_out: int = 0

    def arrays(self) -> inference.Weights:
        """Dense weights and offsets, for broadcasting to tasks."""
        names = [r.label for r in self.labels.orderBy("label_id").collect()]
        rows = self.layout.orderBy("obs_id").select("uoff", "boff").toPandas()
        theta = np.zeros(self.size)
        w = self.weights.toPandas()
        theta[w["f"].to_numpy(np.int64)] = w["w"].to_numpy()
        return inference.Weights(names, rows["uoff"].fillna(-1).to_numpy(np.int64), rows["boff"].fillna(-1).to_numpy(np.int64), theta)

    def cells(self) -> DataFrame:
        """(f, obs, previous, label): what each weight belongs to; previous is null for a weight of one label."""
        names = F.broadcast(self.labels.agg(F.array_sort(F.collect_list(F.struct("label_id", "label")))["label"].alias("names")))
        rows, y = self.layout.join(names), F.size("names")
        single = F.transform(F.sequence(F.lit(0), y - 1), lambda i: F.struct((F.col("uoff") + i).alias("f"), F.lit(None).cast("string").alias("previous"), F.get("names", i).alias("label")))
        pair = F.transform(F.sequence(F.lit(0), y * y - 1), lambda i: F.struct((F.col("boff") + i).alias("f"), F.get("names", F.floor(i / y).cast("int")).alias("previous"), F.get("names", i % y).alias("label")))
        none = F.slice(single, 1, 0)
        own = F.concat(F.when(F.col("uoff").isNull(), none).otherwise(single), F.when(F.col("boff").isNull(), none).otherwise(pair))
        return rows.select("obs", F.explode(own).alias("c")).select("c.f", "obs", "c.previous", "c.label")

    def by_cell(self, values: np.ndarray, name: str) -> DataFrame:
        """Cells with their entry of a vector of the weights' size."""
        table = self.labels.sparkSession.createDataFrame(pd.DataFrame({"f": np.arange(len(values)), name: values}))
        return self.cells().join(table, "f")

    def encode(self, sequences: DataFrame) -> DataFrame:
        texts = windows.texts_of(sequences) if windows.fits(self.templates) else None
        if texts is not None:
            rows = windows.stored(texts)
            known = windows.entries(rows, self.templates).join(self.layout.select("obs_id", "obs"), "obs").select("k", "key", "obs_id")
            return _encoded(rows, self.templates, materialize(known, "known"), self.layout, self.labels)
        return inference.encode(Tpl.features(sequences, self.templates), self.layout.select("obs_id", "obs"), self.labels)

    def transform(self, sequences: DataFrame) -> DataFrame:
        """sent_id, score, path of sequences(sent_id, cols, labels)."""
        return inference.decode(self.encode(sequences), self.arrays())

    def posteriors(self, sequences: DataFrame) -> DataFrame:
        return inference.posteriors(self.encode(sequences), self.arrays())

    def segment(self, df: DataFrame, text: str, out: str = "segmented") -> DataFrame:
        """df with its text split into words by single spaces; white space in the text stays a boundary.

        The text is cut at white space, the parts are labelled as sequences of their own,
        and put together again. Works on batches and streams: rows are not shuffled.
        """
        rows = self.layout.orderBy("obs_id").select("obs_id", "obs").toPandas()
        sent = df.sparkSession.sparkContext.broadcast((self.arrays(), inference.Lookup(rows["obs"].tolist(), rows["obs_id"].to_numpy(np.int64))))
        templates = [Tpl.parse(t.source) for t in self.templates]
        parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\\s+"), lambda p: p != "")
        rows = df.withColumn("_chars", F.transform(parts, characters))
        shaped = F.transform("_chars", lambda cs: F.transform(cs, lambda c: F.array(c)))
        rows = rows.withColumn("_obs", F.transform(shaped, lambda rows: Tpl.observations_of(rows, templates)))

        @F.pandas_udf("array<array<string>>")
        def label(obs: pd.Series) -> pd.Series:
            weights, known = sent.value
            flat = [p for row in obs for p in row]
            if not flat:
                return pd.Series([[] for _ in obs])
            n = np.array([len(p) for p in flat])
            per = [len(o) for p in flat for o in p]
            at = known(pa.array([x for p in flat for o in p for x in o], pa.string()))
            ok = at >= 0
            place = np.concatenate([np.arange(k) for k in n]).repeat(per)[ok]
            part = np.arange(len(n)).repeat(n).repeat(per)[ok]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=len(n))))).astype(np.int32)
            ids = at[ok]
            none = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(np.zeros(n.sum(), np.int32)))
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(ids)), none], names=["sent_id", "n", "at", "obs", "y"])
            path, _, _ = inference.Batch(batch, weights).viterbi()
            names, begin, got, k = np.array(weights.labels), np.cumsum(n) - n, [], 0
            for row in obs:
                got.append([names[path[begin[k + j] : begin[k + j] + n[k + j]]].tolist() for j in range(len(row))])
                k += len(row)
            return pd.Series(got)

        rows = rows.withColumn("_tags", label("_obs"))
        words = F.zip_with("_chars", "_tags", joined_by_tags)
        return rows.withColumn(out, F.array_join(words, " ")).drop("_chars", "_obs", "_tags")

    def register(self, name: str = "segment") -> None:
        """Registers the model's segmentation as a function of SQL: SELECT segment(text). Null gives null."""
        spark = self.labels.sparkSession
        sent = spark.sparkContext.broadcast(LocalModel.of(self))

        @F.pandas_udf("string")
        def segmented(texts: pd.Series) -> pd.Series:
            return pd.Series(sent.value.segment([t if isinstance(t, str) else None for t in texts]), dtype=object).where(texts.notna(), None)

        spark.udf.register(name, segmented)

    def compact(self) -> CrfModel:
        """Without observations all of whose weights are zero; ids and offsets are given anew."""
        y = self.labels.count()
        live = self.weights.where("w <> 0")
        spans = self.layout.select("obs_id", "obs", F.coalesce("uoff", "boff").alias("lo"), D.width(F.col("obs"), y).alias("n"))
        cells = spans.select("obs_id", "obs", F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)).alias("f"), "lo").join(live, "f")
        kept = D.numbered(cells.select("obs_id", "obs").distinct().withColumnRenamed("obs_id", "old"), ["old"], "obs_id")
        new = materialize(D.layout(kept.select("obs_id", "obs"), y), "layout")
        moved = cells.join(new.select("obs", F.coalesce("uoff", "boff").alias("to")), "obs").select((F.col("f") - F.col("lo") + F.col("to")).alias("f"), "w")
        size = new.agg(F.sum(D.width(F.col("obs"), y))).first()[0] or 0
        return CrfModel(self.templates, self.labels, new, materialize(moved, "weights"), int(size), self.log)

    def save(self, path: str) -> None:
        """Four Parquet tables under path."""
        spark = self.labels.sparkSession
        spark.createDataFrame([(i, t.source) for i, t in enumerate(self.templates)], "pos int, src string").write.mode("overwrite").parquet(f"{path}/templates")
        for name in ("labels", "layout", "weights"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CrfModel:
        templates = [Tpl.parse(r.src) for r in spark.read.parquet(f"{path}/templates").orderBy("pos").collect()]
        labels, layout, weights = (spark.read.parquet(f"{path}/{n}") for n in ("labels", "layout", "weights"))
        size = layout.agg(F.sum(D.width(F.col("obs"), labels.count()))).first()[0] or 0
        return CrfModel(templates, labels, layout, weights, int(size))


class CrfEstimator:
    """Fits a CrfModel to labelled sequences(sent_id, cols, labels)."""

    def __init__(self, templates: list[str] | None = None, params: Params | None = None):
        self.templates = [Tpl.parse(t) for t in templates or Tpl.DEFAULT_TEMPLATES]
        self.params = params or Params()

    def prepare(self, sequences: DataFrame) -> tuple[CrfModel, DataFrame]:
        """A model with zero weights, and the encoded sequences, those of equal lengths together in each part."""
        spark = sequences.sparkSession
        texts = windows.texts_of(sequences) if windows.fits(self.templates) else None
        if texts is not None:
            return self._prepare_texts(windows.stored(texts))
        featured = Tpl.features(sequences, self.templates)
        labels = materialize(D.labels(sequences), "labels")
        layout = materialize(D.layout(D.observations_in(sequences, self.templates), labels.count()), "layout")
        size = layout.agg(F.sum(D.width(F.col("obs"), labels.count()))).first()[0] or 0
        model = CrfModel(self.templates, labels, layout, spark.createDataFrame([], "f long, w double"), int(size))
        return model, materialize(inference.encode(featured, layout.select("obs_id", "obs"), labels).sortWithinPartitions("n", "sent_id"), "encoded")

    def _prepare_texts(self, rows: DataFrame) -> tuple[CrfModel, DataFrame]:
        """The same of sequences that are kept as texts: their observations are read from windows each time."""
        spark = rows.sparkSession
        rows._texts = rows
        labels = materialize(D.labels(rows), "labels")
        found = materialize(windows.entries(rows, self.templates), "entries")
        layout = materialize(D.layout(D.observations_of_entries(found), labels.count()), "layout")
        size = layout.agg(F.sum(D.width(F.col("obs"), labels.count()))).first()[0] or 0
        model = CrfModel(self.templates, labels, layout, spark.createDataFrame([], "f long, w double"), int(size))
        return model, _encoded(rows, self.templates, found.join(layout, "obs").select("k", "key", "obs_id"), layout, labels)

    def fit(self, sequences: DataFrame, start: CrfModel | None = None) -> CrfModel:
        """Trains from zero, or (an extension) from the weights of a model with the same dictionaries.

        Sequences that lack a label at some position are left out; the model's left_out counts them.
        """
        p = self.params
        texts = windows.texts_of(sequences) if windows.fits(self.templates) else None
        whole = F.coalesce((F.size("labels") == F.size("cols")) & ~F.exists("labels", lambda y: y.isNull()), F.lit(False))
        left_out = 0 if texts is not None else sequences.where(~whole).count()  # texts have a tag for each character
        model, encoded = self.prepare(sequences if texts is not None else sequences.where(whole))
        model.left_out = left_out
        if model.size > p.driver_weights:
            return self._fit_tables(model, encoded, start)
        arrays = model.arrays()
        if start is not None:
            arrays.theta = start.arrays().theta
        log, errors = Log(), []

        def report(k: int, f: float | None, x: np.ndarray, got: tuple[float, float]) -> bool:
            errors.append(got[0])
            log.rows.append((k, None if f is None else float(f), int(np.count_nonzero(x)), got[0], got[1]))
            return steady(errors, p)

        if p.algorithm == "l-bfgs":
            objective = objective_of(encoded, arrays, p)  # the last evaluation is of the accepted x, so it has the errors to report
            x = lbfgs(objective, arrays.theta, p, lambda k, f, x: report(k, f, x, objective.errors))
        else:
            walked, n = materialize(indexed(encoded, arrays), "indexed"), encoded.count()
            state = SgdState(arrays.theta, np.zeros(len(arrays.theta)))
            for epoch in range(p.max_iter):
                state = sgd_epoch(walked, arrays, p, epoch, n, state)
                if report(epoch, None, state.x, training_error(encoded, inference.Weights(arrays.labels, arrays.uoff, arrays.boff, state.x))):
                    break
            x = state.x
            discard(walked)
        spark, at = sequences.sparkSession, np.flatnonzero(x)
        model.weights = materialize(spark.createDataFrame(list(zip(at.tolist(), x[at].tolist(), strict=True)), "f long, w double"), "weights")
        model.log = spark.createDataFrame(log.rows, T.StructType.fromDDL("iter int, obj double, active long, token_error double, sentence_error double"))
        return model


    def _fit_tables(self, model: CrfModel, encoded: DataFrame, start: CrfModel | None) -> CrfModel:
        """L-BFGS with the optimiser's vectors as tables, for models too large for the driver."""
        p, spark = self.params, encoded.sparkSession
        if p.algorithm != "l-bfgs":
            raise ValueError(f"{p.algorithm} keeps its weights in one place: a model of {model.size} weights needs l-bfgs")
        objective = TableObjective(encoded, model.layout, model.labels.count(), p)
        x = spark.range(model.size).select(F.col("id").alias("f"))
        begun = x.withColumn("w", F.lit(0.0)) if start is None else x.join(start.weights, "f", "left")
        log, errors = Log(), []

        def report(k: int, f: float, x: DataFrame) -> bool:
            errors.append(objective.errors[0])
            log.rows.append((k, float(f), x.where("x <> 0").count(), *objective.errors))
            return steady(errors, p)

        found = lbfgs_tables(objective, begun.select("f", F.coalesce("w", F.lit(0.0)).alias("x")), p, report)
        model.weights = materialize(found.where("x <> 0").select("f", F.col("x").alias("w")), "weights")
        model.log = spark.createDataFrame(log.rows, T.StructType.fromDDL("iter int, obj double, active long, token_error double, sentence_error double"))
        return model


def _encoded(rows: DataFrame, templates: list[Tpl.Template], known: DataFrame, layout: DataFrame, labels: DataFrame) -> DataFrame:
    """Encoded sequences of texts; of more observations than a broadcast takes, by a join."""
    if known.count() > inference.BROADCAST_OBSERVATIONS:
        chars = F.transform(characters(F.col("text")), lambda c: F.array(c))
        featured = Tpl.features(rows.select("sent_id", chars.alias("cols"), characters(F.col("tags")).alias("labels")), templates)
        return materialize(inference.encode(featured, layout.select("obs_id", "obs"), labels).sortWithinPartitions("n", "sent_id"), "encoded")
    names = [r.label for r in labels.where("label is not null").orderBy("label_id").collect()]
    return windows.Encoded(rows, windows.coder_of(known, templates, names)).expanded()


def training_error(encoded: DataFrame, weights: inference.Weights) -> tuple[float, float]:
    """Token and sentence error of decoding against the gold labels."""
    return inference.measured(encoded, weights, gradient=False)[2]
