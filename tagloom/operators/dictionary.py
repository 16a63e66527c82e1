"""Dictionaries with dense ids in order of first appearance, and the layout of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.storage import materialize
from tagloom.functions.text import TAGS
from tagloom.operators.templates import Template, distinct
from tagloom.operators.windows import texts_of


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with column name counting its rows from 0 in the given order.

    Rows are sorted in ranges and numbered inside each; only the ranges' sizes meet in
    one place.
    """
    shift = 33
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_p", F.shiftright("_n", shift))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_p").agg(F.count("*").alias("_size")).withColumn("_start", F.coalesce(F.sum("_size").over(w), F.lit(0))).select("_p", "_start")
    return rows.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_n").bitwiseAND((1 << shift) - 1)).drop("_n", "_p", "_start")


def first_seen(rows: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """(name, value): distinct values with ids by their first place in the given order."""
    first = rows.groupBy(value).agg(F.min(F.struct(*order)).alias("_first")).select(value, *[F.col(f"_first.{c}").alias(f"_{c}") for c in order])
    return numbered(first, [f"_{c}" for c in order], name).select(name, value)


def observations(exploded: DataFrame) -> DataFrame:
    """(obs_id, obs) over (sent_id, t, k, obs)."""
    return first_seen(exploded, "obs", ["sent_id", "t", "k"], "obs_id")


def observations_in(sequences: DataFrame, templates: list[Template]) -> DataFrame:
    """(obs_id, obs) of sequences(sent_id, cols, labels), by first place (sent_id, position, template)."""
    return observations_of_entries(distinct(sequences, templates))


def observations_of_entries(rows: DataFrame) -> DataFrame:
    """(obs_id, obs) of rows(obs, first)."""
    first = rows.groupBy("obs").agg(F.min("first").alias("_first"))
    return numbered(first, ["_first"], "obs_id").select("obs_id", "obs")


def labels(sequences: DataFrame) -> DataFrame:
    """(label_id, label) over sequences; null labels have no id."""
    texts = texts_of(sequences)
    if texts is not None:
        first = F.array(*[F.struct((F.locate(y, F.col("tags")) - 1).alias("t"), F.lit(y).alias("label")) for y in TAGS])
        rows = texts.select("sent_id", F.explode(F.filter(first, lambda z: z["t"] >= 0)).alias("z")).select("sent_id", "z.t", "z.label")
        return first_seen(rows, "label", ["sent_id", "t"], "label_id")
    rows = sequences.select("sent_id", F.posexplode_outer("labels").alias("t", "label")).where("label is not null")
    return first_seen(rows, "label", ["sent_id", "t"], "label_id")


def width(obs: Column, n_labels: int | Column) -> Column:
    """Weights of an observation: one a label for u, one a pair for b, both for *."""
    y = F.lit(n_labels) if isinstance(n_labels, int) else n_labels
    kind = F.substring(obs, 1, 1)
    return F.when(kind == "u", y).when(kind == "b", y * y).otherwise(y + y * y).cast("long")


def layout(dictionary: DataFrame, n_labels: int, span: int = 65_536) -> DataFrame:
    """(obs_id, obs, kind, uoff, boff): where each observation's weights start; null where it has none of that kind.

    A running sum by obs_id, in spans of ids that only hand on their totals.
    """
    rows = dictionary.withColumn("w", width(F.col("obs"), n_labels)).withColumn("_s", F.floor(F.col("obs_id") / span))
    w = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_s").agg(F.sum("w").alias("_w")).withColumn("_start", F.coalesce(F.sum("_w").over(w), F.lit(0))).select("_s", "_start")
    inside = Window.partitionBy("_s").orderBy("obs_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(starts), "_s").withColumn("off", F.col("_start") + F.coalesce(F.sum("w").over(inside), F.lit(0)))
    kind = F.substring("obs", 1, 1)
    return rows.select(
        "obs_id", "obs", F.when(kind == "u", 1).when(kind == "b", 2).otherwise(3).cast("int").alias("kind"),
        F.when(kind != "b", F.col("off")).alias("uoff"),
        F.when(kind == "b", F.col("off")).when(kind == "*", F.col("off") + n_labels).alias("boff"),
    )


def strings_of(ids: DataFrame, dictionary: DataFrame, id_column: str = "obs_id", value: str = "obs") -> DataFrame:
    """ids with the strings that their ids stand for; an id that is not in the dictionary gets null.

    Distinct ids are joined in ranges of ids, so that a frequent one is looked up once.
    """
    found = ids.select(id_column).distinct().join(dictionary.select(id_column, value), id_column)
    return ids.join(found, id_column, "left")
