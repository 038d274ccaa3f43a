"""Text cells of segmented pages: (doc_id, page_no, unit, index, bbox, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def cells_in_box(cells: DataFrame, unit: str, area: Column, ios: float = 0.8) -> DataFrame:
    """Cells of a unit of which more than ``ios`` lies in ``area``."""
    return cells.filter((F.col("unit") == unit) & (g.ios(F.col("bbox"), area) > ios))


def crop_text(cells: DataFrame, unit: str, area: Column, eps: float = 1.0) -> DataFrame:
    """(doc_id, page_no, text): the cells wholly inside, by index, then text, then place (nulls last), so that the
    order of the rows decides nothing; a space between cells that don't touch within ``eps``."""
    x = F.col("bbox")
    low, high = (lambda b: F.least(b["t"], b["b"])), (lambda b: F.greatest(b["t"], b["b"]))
    inside = (area["l"] <= x["l"]) & (x["r"] <= area["r"]) & (low(area) <= low(x)) & (high(x) <= high(area))
    w = Window.partitionBy("doc_id", "page_no").orderBy(*map(F.asc_nulls_last, ("index", "text", "bbox")))
    last = F.lag("bbox").over(w)
    joined = (F.abs(x["l"] - last["r"]) < eps) & (F.abs(x["b"] - last["b"]) < eps)
    part = F.when(last.isNull() | joined, F.col("text")).otherwise(F.concat(F.lit(" "), F.col("text")))
    c = cells.filter((F.col("unit") == unit) & inside).withColumn("part", part).withColumn("rank", F.row_number().over(w))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "part")))
    return c.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(ordered, lambda s: s["part"]), "").alias("text"))


def text_lines(cells: DataFrame, unit: str, location: bool = True) -> DataFrame:
    """``cells`` of a unit with a line of its corners and text."""
    r = g.rect_from_box(F.col("bbox"))
    corners = [r[f"r_{a}{i}"] for i in range(4) for a in "xy"]
    form = "(%06.2f, %06.2f) " * 4 if location else ""
    return cells.filter(F.col("unit") == unit).withColumn("line", F.format_string(form + "%s", *(corners if location else []), F.col("text")))
