"""Key-value graphs of customer attributes, spatial matches, intervals and small array operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph as gr
from .geometry import BOXES, TURNED, boxes, page


def _graph(spark, sf):
    """A graph a nation: a cell a customer and one for its segment; a customer links to its segment's cell, and to the next
    customer as its child if both keys are even; key 11's cell is missing."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    n = F.col("c_nationkey").cast("long").alias("doc_id")
    cells = c.filter("c_custkey <> 11").select(n, (F.col("c_custkey") * 2).alias("cell_id"), F.lit("key").alias("label"), F.col("c_name").alias("text")).unionByName(c.select(n, (F.col("c_custkey") * 2 + 1).alias("cell_id"), F.lit("value").alias("label"), F.col("c_mktsegment").alias("text")))
    links = c.select(n, F.lit("to_value").alias("label"), (F.col("c_custkey") * 2).alias("source_cell_id"), (F.col("c_custkey") * 2 + 1).alias("target_cell_id"))
    child = c.filter("c_custkey % 2 = 0").select(n, F.lit("to_child").alias("label"), (F.col("c_custkey") * 2).alias("source_cell_id"), (F.col("c_custkey") * 2 + 1).alias("target_cell_id"))
    return cells, links.unionByName(child)


def kv_pairs(spark, sf):
    return gr.pairs(*_graph(spark, sf))


def kv_roots(spark, sf):
    return gr.roots(*_graph(spark, sf)).select("doc_id", "cell_id", "text")


def broken_links(spark, sf):
    return gr.broken_links(*_graph(spark, sf))


def kv_iou_match(spark, sf):
    x, y = (g.to_top_left(F.col(c), page()[1]).alias(c) for c in "xy")
    b = boxes(spark, sf).select(F.col("k").alias("doc_id"), F.lit(1).alias("page_no"), "line", x, y)
    left = b.groupBy("doc_id", "page_no", "line").agg(F.min("x").alias("box")).withColumn("id", F.col("line"))
    right = b.groupBy("doc_id", "page_no", "line").agg(F.min("y").alias("box")).withColumn("id", F.col("line"))
    return gr.iou_match(left, right).select("doc_id", "left_id", "right_id", F.round("iou", 9).alias("iou"))


def _ranges(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return t.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 20).cast("int").alias("start"), (F.col("l_linenumber") * 20 + F.col("l_quantity")).cast("int").alias("end"))


def merge_ranges(spark, sf):
    return gr.merge_ranges(_ranges(spark, sf))


def interval_gaps(spark, sf):
    w = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.lit(200).alias("total"))
    return gr.gaps(_ranges(spark, sf), w)


def unique_boxes(spark, sf):
    """Boxes of an order's lines, those of equal first coordinates dropped by their overlap."""
    b = boxes(spark, sf).select("k", "line", g.box(F.col("line") * 10.0, F.lit(0.0), F.col("line") * 10.0 + 10, F.lit(10.0)).alias("x"))
    rows = b.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "x"))), lambda s: s["x"]).alias("xs"))
    return rows.select("k", F.size(gr.unique_boxes(F.col("xs"))).alias("n"))


def best_prediction(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    p = F.struct("l_linenumber", "l_partkey", F.col("l_discount").alias("confidence"))
    rows = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(p)).alias("ps"))
    return rows.select("l_orderkey", gr.best_prediction(F.col("ps"))["l_partkey"].alias("best"))


QUERIES = {f.__name__: f for f in (kv_pairs, kv_roots, broken_links, kv_iou_match, merge_ranges, interval_gaps, unique_boxes, best_prediction)}
_G = "WITH c AS (SELECT c_nationkey::BIGINT doc_id, c_custkey k, c_name n, c_mktsegment s FROM customer) "
_R = "WITH r AS (SELECT l_orderkey doc_id, CAST(l_linenumber*20 AS INT) s, CAST(l_linenumber*20 + l_quantity AS INT) e FROM lineitem), p AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM r), u AS (SELECT *, sum(CASE WHEN s <= m THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM p), z AS (SELECT doc_id, min(s) a, max(e) b FROM u GROUP BY doc_id, g) "
ORACLE = {
    "kv_pairs": _G + "SELECT doc_id, n AS \"key\", s AS \"value\" FROM c WHERE k <> 11",
    "kv_roots": _G + "SELECT doc_id, k*2 cell_id, n AS text FROM c WHERE k <> 11 UNION ALL SELECT doc_id, k*2+1, s FROM c WHERE k % 2 = 1",
    "broken_links": _G + "SELECT doc_id, 'to_value' AS label, k*2 source_cell_id, k*2+1 target_cell_id FROM c WHERE k = 11",
    "kv_iou_match": BOXES + f", t AS (SELECT * FROM {TURNED})" + """, m AS (SELECT k, line, min((l, v0, r, v1)) x FROM t GROUP BY 1, 2), n AS (SELECT k, line, min((l2, w0, r2, w1)) y FROM t GROUP BY 1, 2),
 j AS (SELECT m.k, m.line a, n.line c, greatest(0, least(x[3], y[3]) - greatest(x[1], y[1])) * greatest(0, least(x[4], y[4]) - greatest(x[2], y[2])) i, (x[3]-x[1])*(x[4]-x[2]) a1, (y[3]-y[1])*(y[4]-y[2]) a2 FROM m JOIN n ON m.k = n.k),
 q AS (SELECT k, a, c, i/(a1+a2-i+1e-6) iou FROM j) SELECT k doc_id, a left_id, (list(c ORDER BY iou DESC, c DESC))[1] right_id, round(max(iou), 9) iou FROM q WHERE iou > 0.01::DOUBLE GROUP BY 1, 2""",
    "merge_ranges": _R + "SELECT doc_id, a AS \"start\", b AS \"end\" FROM z",
    "interval_gaps": _R + ", h AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) s, a e FROM z WHERE doc_id IN (SELECT o_orderkey FROM orders) UNION ALL SELECT doc_id, max(b), 200 FROM z WHERE doc_id IN (SELECT o_orderkey FROM orders) GROUP BY 1 UNION ALL SELECT o_orderkey, 0, 200 FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM z)) SELECT doc_id, s::INT AS \"start\", e::INT AS \"end\" FROM h WHERE s < e",
    "unique_boxes": "SELECT l_orderkey k, count(DISTINCT l_linenumber)::INT n FROM lineitem GROUP BY 1",
    "best_prediction": "SELECT l_orderkey, (list(l_partkey ORDER BY l_discount DESC, l_linenumber, l_partkey))[1] AS best FROM lineitem GROUP BY 1",
}
