"""Building documents: new items, pages, cells and references as rows, placed in bulk.

A new item is a row of (doc_id, seq, label, text) and, if it has them, parent_ref, heading_level, marker, enumerated, ...;
seq is the order in which items are added. Refs count on from the highest of the document's array, positions from the last
child of the parent, so one call stands for any number of single additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GROUP_LABELS
from .tree import BODY

# Labels whose items have an array of their own.
KINDS = {"table": "tables", "document_index": "tables", "picture": "pictures", "chart": "pictures", "key_value_region": "key_value_items", "form": "form_items", "field_region": "field_regions", "field_item": "field_items"}


def kind_of(label: Column) -> Column:
    """The array that an item of a label goes to."""
    out = F.when(label.isin(*GROUP_LABELS), F.lit("groups"))
    for name, kind in KINDS.items():
        out = out.when(label == name, F.lit(kind))
    return out.otherwise(F.lit("texts"))


def add_items(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with the items of ``new`` after the children that their parents have. Titles have level 0, headings level 1
    unless told; list items are a dash unless told; an item without a layer is in the body, one without a parent under it;
    text without orig is its own orig."""
    label = F.col("label")
    for c, t in (("parent_ref", "string"), ("layer", "string"), ("heading_level", "int"), ("marker", "string"), ("enumerated", "boolean"), ("orig", "string")):
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(t))
    n = new.withColumn("kind", kind_of(label)).withColumn("parent_ref", F.coalesce("parent_ref", F.lit(BODY))).withColumn("layer", F.coalesce("layer", F.lit("body")))
    n = n.withColumn("heading_level", F.when(label == "title", F.lit(0)).when(label == "section_header", F.coalesce("heading_level", F.lit(1))))
    item = label == "list_item"
    n = n.withColumn("marker", F.when(item, F.coalesce("marker", F.lit("-")))).withColumn("enumerated", F.when(item, F.coalesce("enumerated", F.lit(False))))
    n = n.withColumn("orig", F.coalesce("orig", "text"))
    number = F.regexp_extract("ref", r"/(\d+)$", 1)
    used = nodes.groupBy("doc_id", "kind").agg(F.max(F.when(number != "", number.cast("int"))).alias("used"))
    last = nodes.groupBy("doc_id", "parent_ref").agg(F.max("child_pos").alias("last"))
    nth = lambda *by: F.row_number().over(Window.partitionBy("doc_id", *by).orderBy("seq"))
    n = n.join(used, ["doc_id", "kind"], "left").join(last, ["doc_id", "parent_ref"], "left")
    n = n.withColumn("ref", F.concat(F.lit("#/"), F.col("kind"), F.lit("/"), (F.coalesce("used", F.lit(-1)) + nth("kind")).cast("string")))
    n = n.withColumn("child_pos", (F.coalesce("last", F.lit(-1)) + nth("parent_ref")).cast("int"))
    return nodes.unionByName(n.drop("seq", "used", "last"), allowMissingColumns=True)


def add_lists(nodes: DataFrame, new: DataFrame, enumerated: bool = False) -> DataFrame:
    """``nodes`` with a list group for every (doc_id, list_ix) of ``new`` (doc_id, list_ix, seq, text), and its items in it."""
    group = new.groupBy("doc_id", "list_ix").agg(F.min("seq").alias("seq")).withColumn("label", F.lit("list")).withColumn("text", F.lit(None).cast("string"))
    before = nodes.filter("kind = 'groups'").groupBy("doc_id").agg(F.max(F.regexp_extract("ref", r"(\d+)$", 1).cast("int")).alias("used"))
    ref = F.concat(F.lit("#/groups/"), (F.coalesce("used", F.lit(-1)) + F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first"))).cast("string"))
    items = new.withColumn("first", F.min("seq").over(Window.partitionBy("doc_id", "list_ix"))).join(before, "doc_id", "left").withColumn("parent_ref", ref)
    items = items.select("doc_id", "seq", "text", "parent_ref", F.lit("list_item").alias("label"), F.lit(enumerated).alias("enumerated"))
    return add_items(add_items(nodes, group.drop("list_ix")), items)


def add_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """``pages`` with those of ``new`` (doc_id, page_no, width, height) in place of pages of the same number."""
    return pages.join(new.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti").unionByName(new.select(*pages.columns))


def add_table_cells(cells: DataFrame, new: DataFrame) -> DataFrame:
    """``cells`` with those of ``new`` (without cell_ix) numbered on after the table's cells, by row and column."""
    last = cells.groupBy("doc_id", "ref").agg(F.max("cell_ix").alias("last"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "ref").orderBy("r0", "c0"))
    n = new.join(last, ["doc_id", "ref"], "left").withColumn("cell_ix", (F.coalesce("last", F.lit(-1)) + nth).cast("int")).drop("last")
    return cells.unionByName(n, allowMissingColumns=True)


def add_refs(refs: DataFrame, new: DataFrame) -> DataFrame:
    """``refs`` (doc_id, owner_ref, role, pos, target_ref) with captions, footnotes, references or comments of ``new``
    (doc_id, seq, owner_ref, role, target_ref) after those that an owner has in that role."""
    by = ["doc_id", "owner_ref", "role"]
    last = refs.groupBy(*by).agg(F.max("pos").alias("last"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("seq"))
    n = new.join(last, by, "left").withColumn("pos", (F.coalesce("last", F.lit(-1)) + nth).cast("int")).drop("last", "seq")
    return refs.unionByName(n.select(*refs.columns))
