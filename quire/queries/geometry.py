"""Box queries. Boxes are derived from integer-valued columns of lineitem; pages are 200 x 120."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import cells as pc



def page():
    """Width and height of the pages."""
    return F.lit(200.0), F.lit(120.0)


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Two boxes a line: (k, line, x, y); every third pair counts from the bottom left."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    q, n, p, s = (F.col(c).cast("double") for c in ("l_quantity", "l_linenumber", "l_partkey", "l_suppkey"))
    left, top = n * 10, q
    left2, top2 = (p % 97), (s % 53)
    bottom = F.col("l_partkey") % 3 == 0
    o = F.when(bottom, F.lit(g.BOTTOM)).otherwise(F.lit(g.TOP))
    mk = lambda l, t, r, b: g.box(l, F.when(bottom, b).otherwise(t), r, F.when(bottom, t).otherwise(b), o)
    return t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("line"), mk(left, top, left + q + 5, top + n * 4).alias("x"), mk(left2, top2, left2 + 30, top2 + 25).alias("y"))


#: the same boxes in SQL: x is (l, t, r, b), y is (l2, t2, r2, b2), bl tells the origin; (x0, x1) is the vertical extent
BOXES = """WITH s AS (SELECT l_orderkey k, CAST(l_linenumber AS INT) line, l_linenumber*10.0::DOUBLE l, l_linenumber*10.0::DOUBLE + l_quantity + 5 r,
 l_quantity::DOUBLE v0, l_quantity::DOUBLE + l_linenumber*4 v1, (l_partkey % 97)::DOUBLE l2, (l_partkey % 97)::DOUBLE + 30 r2,
 (l_suppkey % 53)::DOUBLE w0, (l_suppkey % 53)::DOUBLE + 25 w1, l_partkey % 3 = 0 bl FROM lineitem),
b AS (SELECT *, CASE WHEN bl THEN v1 ELSE v0 END t, CASE WHEN bl THEN v0 ELSE v1 END b, CASE WHEN bl THEN w1 ELSE w0 END t2, CASE WHEN bl THEN w0 ELSE w1 END b2,
 greatest(0, least(r, r2) - greatest(l, l2)) * greatest(0, least(v1, w1) - greatest(v0, w0)) inter, (r-l)*(v1-v0) a1, (r2-l2)*(w1-w0) a2 FROM s) """

#: all of them, turned to the top-left origin of the pages
TURNED = "(SELECT * REPLACE (CASE WHEN bl THEN 120 - v1 ELSE v0 END AS v0, CASE WHEN bl THEN 120 - v0 ELSE v1 END AS v1, CASE WHEN bl THEN 120 - w1 ELSE w0 END AS w0, CASE WHEN bl THEN 120 - w0 ELSE w1 END AS w1) FROM b)"

r6 = lambda c: F.round(c, 9)


def bbox_area(spark, sf):
    return boxes(spark, sf).select("k", "line", r6(g.area(F.col("x"))).alias("area"), r6(g.width(F.col("x"))).alias("width"), r6(g.height(F.col("x"))).alias("height"))


def bbox_iou(spark, sf):
    x, y = F.col("x"), F.col("y")
    return boxes(spark, sf).select("k", "line", r6(g.intersection_area(x, y)).alias("inter"), r6(g.iou(x, y)).alias("iou"), r6(g.ios(x, y)).alias("ios"), r6(g.union_area(x, y)).alias("uni"))


def bbox_flip(spark, sf):
    b = boxes(spark, sf).select("k", "line", g.to_top_left(F.col("x"), page()[1]).alias("a"), g.to_bottom_left(F.col("x"), page()[1]).alias("c"))
    return b.select("k", "line", *[r6(F.col(f"a.{n}")).alias(f"top_{n}") for n in "ltrb"], *[r6(F.col(f"c.{n}")).alias(f"bot_{n}") for n in "ltrb"])


def bbox_normalize(spark, sf):
    b = boxes(spark, sf).select("k", "line", g.normalized(F.col("x"), *page()).alias("n"), g.expand_by_scale(F.col("x"), F.lit(0.5), F.lit(0.25)).alias("e"))
    return b.select("k", "line", *[r6(F.col(f"n.{n}")).alias(f"n_{n}") for n in "ltrb"], *[r6(F.col(f"e.{n}")).alias(f"e_{n}") for n in "ltrb"])


def bbox_overlap_predicates(spark, sf):
    x, y = F.col("x"), F.col("y")
    return boxes(spark, sf).select(
        "k", "line", g.overlaps_horizontally(x, y).alias("horizontal"), g.overlaps_vertically(x, y).alias("vertical"), g.overlaps(x, y).alias("both"),
        g.overlaps_vertically_with_iou(x, y, F.lit(0.3)).alias("vertical_iou"), g.is_left_of(x, y).alias("left_of"), g.is_strictly_left_of(x, y).alias("strictly_left"),
        g.is_above(x, y).alias("above"), g.is_strictly_above(x, y).alias("strictly_above"), r6(g.x_overlap(x, y)).alias("x_overlap"), r6(g.y_overlap(x, y)).alias("y_overlap"),
        r6(g.x_union(x, y)).alias("x_union"), r6(g.y_union(x, y)).alias("y_union"),
    )


def bbox_intersection(spark, sf):
    b = boxes(spark, sf).select("k", "line", g.intersection_box(F.col("x"), F.col("y")).alias("i")).filter("i is not null")
    return b.select("k", "line", *[r6(F.col(f"i.{n}")).alias(n) for n in "ltrb"])


def bbox_enclosing(spark, sf):
    """The box around an order's boxes, all turned to the top-left origin first."""
    b = boxes(spark, sf).select("k", g.to_top_left(F.col("x"), page()[1]).alias("x")).groupBy("k").agg(g.enclosing(F.col("x")).alias("e"))
    return b.select("k", *[r6(F.col(f"e.{n}")).alias(n) for n in "ltrb"])


def bbox_quantize(spark, sf):
    return boxes(spark, sf).select("k", "line", g.location_tokens(g.to_top_left(F.col("x"), page()[1]), *page()).alias("tokens"))


def rect_figures(spark, sf):
    x = g.rect_from_box(F.col("x"))
    b = boxes(spark, sf).select("k", "line", x.alias("q"))
    q = F.col("q")
    return b.select("k", "line", r6(g.rect_width(q)).alias("width"), r6(g.rect_height(q)).alias("height"), r6(g.rect_centre(q)["x"]).alias("cx"), r6(g.rect_centre(q)["y"]).alias("cy"), g.rect_angle_360(q).alias("angle"))


# ------------------------------------------------------------------- page cells
def page_cells(spark, sf):
    """A page an order; a word a line item, in reading order by line number."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    n, q = F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")
    return t.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("word").alias("unit"), F.col("l_linenumber").cast("int").alias("index"), g.box(n * 20, F.lit(10.0), n * 20 + F.least(q, F.lit(20.0)), F.lit(20.0)).alias("bbox"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"))


def cells_in_bbox(spark, sf):
    return pc.cells_in_box(page_cells(spark, sf), "word", g.box(F.lit(30.0), F.lit(0.0), F.lit(85.0), F.lit(18.0)), 0.5).select("doc_id", "index", "text")


def crop_text(spark, sf):
    return pc.crop_text(page_cells(spark, sf), "word", g.box(F.lit(0.0), F.lit(0.0), F.lit(105.0), F.lit(30.0)), 1.0)


def textlines(spark, sf):
    return pc.text_lines(page_cells(spark, sf), "word").select("doc_id", "index", "line")


QUERIES = {f.__name__: f for f in (bbox_area, bbox_iou, bbox_flip, bbox_normalize, bbox_overlap_predicates, bbox_intersection, bbox_enclosing, bbox_quantize, rect_figures, cells_in_bbox, crop_text, textlines)}

CELLS = "WITH c AS (SELECT l_orderkey doc_id, CAST(l_linenumber AS INT) AS \"index\", l_linenumber*20.0 l, l_linenumber*20.0 + least(l_quantity, 20.0) r, 10.0 t, 20.0 b, 'w' || CAST(l_partkey AS VARCHAR) AS text FROM lineitem) "

ORACLE = {
    "bbox_area": BOXES + "SELECT k, line, round(a1, 9) area, round(r-l, 9) width, round(v1-v0, 9) height FROM b",
    "bbox_iou": BOXES + "SELECT k, line, round(inter, 9) \"inter\", round(inter/(a1+a2-inter+1e-6), 9) iou, round(CASE WHEN a1 > 0 THEN inter/a1 ELSE 0 END, 9) ios, round(a1+a2-inter, 9) uni FROM b",
    "bbox_flip": BOXES + """SELECT k, line, round(l, 9) top_l, round(CASE WHEN bl THEN 120-t ELSE t END, 9) top_t, round(r, 9) top_r, round(CASE WHEN bl THEN 120-b ELSE b END, 9) top_b,
 round(l, 9) bot_l, round(CASE WHEN bl THEN t ELSE 120-t END, 9) bot_t, round(r, 9) bot_r, round(CASE WHEN bl THEN b ELSE 120-b END, 9) bot_b FROM b""",
    "bbox_normalize": BOXES + """SELECT k, line, round(l*(1.0/200.0::DOUBLE), 9) n_l, round(t*(1.0/120.0::DOUBLE), 9) n_t, round(r*(1.0/200.0::DOUBLE), 9) n_r, round(b*(1.0/120.0::DOUBLE), 9) n_b,
 round(l-(r-l)*0.5, 9) e_l, round(t + CASE WHEN bl THEN 1 ELSE -1 END*(v1-v0)*0.25, 9) e_t, round(r+(r-l)*0.5, 9) e_r, round(b - CASE WHEN bl THEN 1 ELSE -1 END*(v1-v0)*0.25, 9) e_b FROM b""",
    "bbox_overlap_predicates": BOXES + """, p AS (SELECT *, NOT (r <= l2 OR r2 <= l) h, NOT (v1 <= w0 OR w1 <= v0) v FROM b)
 SELECT k, line, h horizontal, v vertical, h AND v "both", CASE WHEN v THEN (least(v1,w1)-greatest(v0,w0))/(greatest(v1,w1)-least(v0,w0)) > 0.3::DOUBLE ELSE false END vertical_iou,
 l < l2 left_of, r + 0.001::DOUBLE < l2 strictly_left, CASE WHEN bl THEN t > t2 ELSE t < t2 END above, CASE WHEN bl THEN b + 0.001::DOUBLE > t2 ELSE b + 0.001::DOUBLE < t2 END strictly_above,
 round(greatest(0, least(r,r2)-greatest(l,l2)), 9) x_overlap, round(greatest(0, least(v1,w1)-greatest(v0,w0)), 9) y_overlap, round(greatest(0, greatest(r,r2)-least(l,l2)), 9) x_union, round(greatest(0, greatest(v1,w1)-least(v0,w0)), 9) y_union FROM p""",
    "bbox_intersection": BOXES + """SELECT k, line, round(greatest(l,l2), 9) l, round(CASE WHEN bl THEN least(v1,w1) ELSE greatest(v0,w0) END, 9) t, round(least(r,r2), 9) r, round(CASE WHEN bl THEN greatest(v0,w0) ELSE least(v1,w1) END, 9) b
 FROM b WHERE least(r,r2) > greatest(l,l2) AND least(v1,w1) > greatest(v0,w0)""",
    "bbox_enclosing": BOXES + "SELECT k, round(min(l), 9) l, round(min(CASE WHEN bl THEN 120-t ELSE t END), 9) t, round(max(r), 9) r, round(max(CASE WHEN bl THEN 120-b ELSE b END), 9) b FROM b GROUP BY k",
    "bbox_quantize": BOXES + """, n AS (SELECT k, line, l/200.0::DOUBLE x0, r/200.0::DOUBLE x1, (CASE WHEN bl THEN 120-t ELSE t END)/120.0::DOUBLE y0, (CASE WHEN bl THEN 120-b ELSE b END)/120.0::DOUBLE y1 FROM b),
 q AS (SELECT k, line, [greatest(0, least(499, CAST(round_even(c*500, 0) AS INT))) FOR c IN [least(x0,x1), least(y0,y1), greatest(x0,x1), greatest(y0,y1)]] v FROM n)
 SELECT k, line, '<loc_' || v[1] || '><loc_' || v[2] || '><loc_' || v[3] || '><loc_' || v[4] || '>' tokens FROM q""",
    "rect_figures": BOXES + "SELECT k, line, round(r-l, 9) width, round(v1-v0, 9) height, round((l+r)/2, 9) cx, round((v0+v1)/2, 9) cy, CAST(0 AS INT) angle FROM b",
    "cells_in_bbox": CELLS + "SELECT doc_id, \"index\", text FROM c WHERE r > l AND greatest(0, least(r,85.0)-greatest(l,30.0))*greatest(0, least(b,18.0)-greatest(t,0.0)) / ((r-l)*(b-t)) > 0.5",
    "crop_text": CELLS + """, k AS (SELECT *, lag(r) OVER (PARTITION BY doc_id ORDER BY "index", text) prev FROM c WHERE l >= 0 AND r <= 105 AND t >= 0 AND b <= 30)
 SELECT doc_id, 1::INT page_no, string_agg(CASE WHEN prev IS NULL OR abs(l-prev) < 1.0 THEN text ELSE ' ' || text END, '' ORDER BY "index", text) AS text FROM k GROUP BY doc_id""",
    "textlines": CELLS + "SELECT doc_id, \"index\", printf('(%06.2f, %06.2f) (%06.2f, %06.2f) (%06.2f, %06.2f) (%06.2f, %06.2f) %s', l::DOUBLE, b::DOUBLE, r::DOUBLE, b::DOUBLE, r::DOUBLE, t::DOUBLE, l::DOUBLE, t::DOUBLE, text) line FROM c",
}
