"""Key-value graphs and intervals: cells (doc_id, cell_id, label, text), links (doc_id, label, source_cell_id, target_cell_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def broken_links(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Links of which an end is no cell."""
    have = cells.select("doc_id", "cell_id").distinct()
    s = links.join(have.withColumnRenamed("cell_id", "source_cell_id"), ["doc_id", "source_cell_id"], "left_anti")
    t = links.join(have.withColumnRenamed("cell_id", "target_cell_id"), ["doc_id", "target_cell_id"], "left_anti")
    return s.unionByName(t).distinct()


def roots(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Cells that no to_child link points at."""
    child = links.filter("label = 'to_child'").select("doc_id", F.col("target_cell_id").alias("cell_id")).distinct()
    return cells.join(child, ["doc_id", "cell_id"], "left_anti")


def pairs(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, key, value) along to_value links."""
    c = cells.select("doc_id", "cell_id", "text")
    v = links.filter("label = 'to_value'")
    k = v.join(c.withColumnRenamed("cell_id", "source_cell_id").withColumnRenamed("text", "key"), ["doc_id", "source_cell_id"])
    return k.join(c.withColumnRenamed("cell_id", "target_cell_id").withColumnRenamed("text", "value"), ["doc_id", "target_cell_id"]).select("doc_id", "key", "value")


def tiles(box: Column, size: Column) -> Column:
    """The tiles of a page that a box touches."""
    n = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return F.flatten(F.transform(n(box["l"], box["r"]), lambda x: F.transform(n(box["t"], box["b"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def iou_match(left: DataFrame, right: DataFrame, least: float = 0.01) -> DataFrame:
    """(doc_id, page_no, left_id, right_id, iou): for each box of ``left`` the one of ``right`` that overlaps it most (of
    equal ones the last), over ``least``. Boxes meet by the tiles that both touch, so a page isn't compared all with all.
    A tile has the larger mean side of the page's boxes, but no less than an eighth of the largest, whatever its units:
    a box touches 81 tiles at most."""
    side = F.greatest(g.width(F.col("box")), g.height(F.col("box")))
    both = left.select("doc_id", "page_no", "box").unionByName(right.select("doc_id", "page_no", "box"))
    size = both.groupBy("doc_id", "page_no").agg(F.greatest(F.avg(side), F.max(side) / 8, F.lit(1e-9)).alias("size"))
    spread = lambda d, n, x: d.join(size, ["doc_id", "page_no"]).select("doc_id", "page_no", F.col("id").alias(n), F.col("box").alias(x), F.explode(tiles(F.col("box"), F.col("size"))).alias("tile"))
    a, b = spread(left, "left_id", "x"), spread(right, "right_id", "y")
    j = a.join(b, ["doc_id", "page_no", "tile"]).select("doc_id", "page_no", "left_id", "right_id", g.iou(F.col("x"), F.col("y"), strict=False).alias("iou")).filter(F.col("iou") > least)
    return j.groupBy("doc_id", "page_no", "left_id").agg(F.max(F.struct("iou", "right_id")).alias("m")).select("doc_id", "page_no", "left_id", "m.right_id", "m.iou")


def merge_ranges(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end): ranges that overlap or touch become one. Both windows share one sort, so equal ranges stay as the
    first found them; nulls go last: a range without an end joins the run that its start is in."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def gaps(ranges: DataFrame, wholes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end): what the ranges leave of wholes (key, total), from 0."""
    m = merge_ranges(ranges, key).join(wholes, key)
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"))
    ends = m.select(key, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("s"), F.col("start").alias("e"))
    tail = m.groupBy(key, "total").agg(F.max("end").alias("s")).select(key, "s", F.col("total").alias("e"))
    none = wholes.join(ranges.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("s"), F.col("total").alias("e"))
    return ends.unionByName(tail).unionByName(none).filter("s < e").select(key, F.col("s").alias("start"), F.col("e").alias("end"))


def unique_boxes(boxes: Column, least: float = 0.9) -> Column:
    """Boxes in order, without those that overlap a kept one by ``least`` or more (iou)."""
    first = F.slice(boxes, 1, 1)
    rest = F.slice(boxes, 2, F.size(boxes))
    return F.aggregate(rest, first, lambda kept, x: F.when(F.exists(kept, lambda k: g.iou(x, k, strict=False) >= least), kept).otherwise(F.concat(kept, F.array(x))))


def best_prediction(predictions: Column) -> Column:
    """The one of the highest confidence, the first of equals; without any confidence the first."""
    top = F.array_max(F.transform(predictions, lambda p: p["confidence"]))
    return F.when(top.isNull(), F.get(predictions, F.lit(0))).otherwise(F.get(F.filter(predictions, lambda p: p["confidence"] == top), F.lit(0)))
