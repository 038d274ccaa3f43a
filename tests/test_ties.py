"""Rows that compare equal, and nulls, where an operator puts rows in order."""

import itertools

from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import cells, graph


def test_crop_text_of_equal_cells(spark):
    """Two cells of one index and text end at different places; a third one touches the longer."""
    rows = [(2, 40.0, 59.0, "x"), (2, 40.0, 60.0, "x"), (3, 60.0, 80.0, "y"), (3, 60.0, 70.0, None)]
    area = g.box(F.lit(0.0), F.lit(0.0), F.lit(105.0), F.lit(30.0))
    for order in itertools.permutations(rows):
        d = spark.createDataFrame(spark.sparkContext.parallelize(order, 1), "index int, l double, r double, text string")
        d = d.select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), F.lit("word").alias("unit"), "index", g.box(F.col("l"), F.lit(10.0), F.col("r"), F.lit(20.0)).alias("bbox"), "text")
        assert [r["text"] for r in cells.crop_text(d, "word", area).collect()] == ["x xy"]


RANGES = "doc_id int, start int, end int"


def test_equal_ranges_and_nulls_merge(spark):
    d = spark.createDataFrame([(1, 120, 142), (1, 40, 55), (1, 120, 142), (1, 40, 50), (2, 20, None), (2, 20, 30), (2, None, 90), (2, 40, None), (2, None, None)], RANGES)
    assert sorted(map(tuple, graph.merge_ranges(d).collect()), key=str) == sorted([(1, 40, 55), (1, 120, 142), (2, 20, 30), (2, None, 90), (2, 40, None), (2, None, None)], key=str)


def test_gaps_beside_nulls(spark):
    """A range without a start says nothing of what lies before the others."""
    d = spark.createDataFrame([(1, 120, 142), (1, 40, 55), (1, 120, 142), (2, None, 50), (2, 60, 70)], RANGES)
    wholes = spark.createDataFrame([(1, 200), (2, 200), (3, 200)], "doc_id int, total int")
    assert sorted(map(tuple, graph.gaps(d, wholes).collect())) == [(1, 0, 40), (1, 55, 120), (1, 142, 200), (2, 0, 60), (2, 70, 200), (3, 0, 200)]
