"""Sources and sinks of sequences: column files, JSON lines, plain text, tables.

A sequence is one row: sent_id, cols (position, column), labels (by position, null
where there are none). Order comes from keys, never from the order of files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.text import bmes, characters, corpus_words, six_digits, split_fields, tagged, trim_line
from tagloom.sources.splits import lines_of_files, sequences_of_lines

#: Lines of one text that sent_id leaves room for; a text of more raises an error.
LINES = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read in fewer parts than there are; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sequences_of(files: DataFrame) -> DataFrame:
    """(file, seq, lines) from files(file, text), texts that are rows of a table: trimmed lines, a blank one ends a sequence.

    Works inside one text by array functions, without a shuffle. Every blank line is a
    place to cut; what is left of others is filtered.
    """
    blocks = F.split("text", "\n[ \t\r]*+(?=\n)")
    kept = F.filter(F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "\n"), trim_line), lambda x: x != "")), lambda b: F.size(b) > 0)
    return files.select("file", F.posexplode(kept).alias("seq", "lines"))


def parse_rows(sequences: DataFrame, labelled: bool) -> DataFrame:
    """Splits the lines of sequences; the last field is the label where they are labelled."""
    rows = F.transform("lines", split_fields)
    if not labelled:
        return sequences.withColumn("cols", rows).withColumn("labels", F.lit(None).cast("array<string>"))
    ragged = F.exists(rows, lambda r: F.size(r) < 2)
    checked = F.when(ragged, F.raise_error(F.lit("a labelled row needs a feature and a label"))).otherwise(rows)
    return sequences.withColumn("_rows", checked).withColumn("cols", F.transform("_rows", lambda r: F.slice(r, F.lit(1), F.size(r) - 1))).withColumn("labels", F.transform("_rows", lambda r: F.element_at(r, -1))).drop("_rows")


def read_sequences(spark: SparkSession, path: str, labelled: bool) -> DataFrame:
    """Sequences of column files under path; sent_id numbers them from 0 by file name and place. Large files are read by many tasks."""
    return parse_rows(sequences_of_lines(lines_of_files(spark, path)), labelled).select("sent_id", "cols", "labels")


def from_json_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of lines whose value is a JSON object with a text field cut, with that field; others are skipped."""
    cut = F.get_json_object(F.trim(value), "$.cut")
    whole = F.from_json(F.trim(value), "cut string", {"mode": "PERMISSIVE"})
    quoted = F.col(value).rlike('"cut"\\s*:\\s*"')
    return lines.where(whole.isNotNull() & whole["cut"].isNotNull() & quoted).withColumn("cut", cut).where("cut is not null")


def from_segmented(lines: DataFrame, id_column: str, cut: str) -> DataFrame:
    """Sequences of characters with word tags from segmented lines; lines without a word are skipped."""
    # there is a word where a character is neither white space nor an opening bracket
    rows = lines.where(F.col(cut).rlike("(?U)[^\\s\\[]")).select(F.col(id_column).alias("sent_id"), corpus_words(F.col(cut)).alias("words"))
    chars = characters(F.array_join("words", ""))
    out = rows.select("sent_id", F.transform(chars, lambda c: F.array(c)).alias("cols"), tagged(F.col("words")).alias("labels"))
    if isinstance(rows.schema["sent_id"].dataType, T.IntegralType):
        # what operators/windows.py reads instead
        out._texts = rows.select(F.col("sent_id").cast("long").alias("sent_id"), F.array_join("words", "").alias("text"), F.array_join(F.transform("words", bmes), "").alias("tags"))
    return out


def lines_of(texts: DataFrame, id_column: str, text: str) -> DataFrame:
    """(sent_id, line) of the lines of texts that are not blank; sent_id is id * LINES + the line's place."""
    rows = texts.select(F.col(id_column).alias("id"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    at = F.when(F.col("at") >= LINES, F.raise_error(F.lit(f"a text has more than {LINES} lines")).cast("int")).otherwise(F.col("at"))
    return rows.where(trim_line(F.col("line")) != "").select((F.col("id") * LINES + at).alias("sent_id"), "line")


def read_sequences_of_results(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, predicted) of result files: score lines are skipped, the first field of a line is its label."""
    lines = lines_of_files(spark, path).where(~F.col("line").startswith("score="))
    return sequences_of_lines(lines).select("sent_id", F.transform("lines", lambda x: F.element_at(split_fields(x), 1)).alias("predicted"))


def sequence_text(cols: Column, labels: Column | None = None) -> Column:
    """A sequence as lines of a column file, ending in a blank line's place."""
    rows = F.transform(cols, lambda r: F.array_join(r, " "))
    if labels is not None:
        rows = F.zip_with(rows, labels, lambda r, y: F.concat_ws(" ", r, y))
    return F.concat(F.array_join(rows, "\n"), F.lit("\n"))


def write_sequences(sequences: DataFrame, path: str, labelled: bool = True) -> None:
    """Column files, sequences separated by blank lines, in order of sent_id."""
    text = sequence_text(F.col("cols"), F.col("labels") if labelled else None)
    sequences.orderBy("sent_id").select(text.alias("value")).write.text(path)


def labelled_text(labelled: DataFrame) -> DataFrame:
    """(sent_id, value) of labelled(sent_id, score, path): score=<score>, then a label and its own score a line.

    Numbers have six significant digits. Each sequence is formatted where it is, a batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(2)
            flat = pc.list_flatten(path)
            own = pa.array(map(six_digits, flat.field("score").to_pylist()), pa.string())
            lines = pc.binary_join_element_wise(flat.field("label"), own, " ", null_handling="replace", null_replacement="")
            cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(path), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            body = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), lines), "\n")
            head = pa.array([f"score={six_digits(x)}" for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join_element_wise(head, body, "", "\n")], names=["sent_id", "value"])

    return labelled.select("sent_id", "score", "path").mapInArrow(run, "sent_id long, value string")


def write_labelled(labelled: DataFrame, path: str) -> None:
    """Result files: labelled_text of each sequence and a blank line, in order of sent_id."""
    labelled_text(labelled).orderBy("sent_id").select("value").write.text(path)
