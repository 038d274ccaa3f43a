"""Statistics over a stream of documents: counts that add up, kept as state, and windows of events with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import from_lines


def line_counts(documents: DataFrame) -> DataFrame:
    """Running totals of documents(doc_id, text, lang) by language: documents, lines, characters. For output mode complete or update."""
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return documents.groupBy("lang").agg(F.count("*").alias("docs"), F.coalesce(F.sum(n), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"))


def length_histogram(documents: DataFrame, width: int = 1000) -> DataFrame:
    """Documents by length in steps of ``width`` characters: state of a row a step, from which quantiles can be read."""
    return documents.groupBy(F.floor(F.char_length("text") / width).alias("step")).agg(F.count("*").alias("docs"))


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by tumbling window; events later than ``late`` are dropped."""
    e = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def nodes_of_batch(documents: DataFrame) -> DataFrame:
    """The nodes of a micro-batch, for foreachBatch; the same as for a table."""
    return from_lines(documents)
