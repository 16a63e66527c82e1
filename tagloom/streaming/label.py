"""Segmentation and labelling of streams. Both are stateless: rows go in and out in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.plans.crf import CrfModel

#: Lines that end an interactive stream of text.
ENDS = ("q", "quit", "exit")


def segment_stream(lines: DataFrame, model: CrfModel, text: str = "value") -> DataFrame:
    """A stream of text lines with their segmentation; empty lines and those that end a session are skipped."""
    live = lines.where((F.trim(text) != "") & ~F.col(text).isin(*ENDS))
    return model.segment(live, text)


def label_stream(sequences: DataFrame, model: CrfModel) -> DataFrame:
    """A stream of sequences(sent_id, cols, labels) with score and path."""
    return model.transform(sequences)


def write_segments(lines: DataFrame, model: CrfModel, path: str, checkpoint: str, text: str = "value") -> StreamingQuery:
    """Writes segmented lines as text files until the stream's input is used up."""
    out = segment_stream(lines, model, text).select(F.col("segmented").alias("value"))
    return out.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
