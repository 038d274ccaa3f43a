"""Trees of nodes (doc_id, ref, parent_ref, child_pos, ...): paths, traversal, filters, validation, mutation, set operators.

A node's path is the list of child positions from the root; paths in their order are the pre-order of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_LABELS
from ..storage import materialize

BODY = "#/body"


def doc_window():
    """A document in reading order."""
    return Window.partitionBy("doc_id").orderBy("path")


# -------------------------------------------------------------------- traversal
def with_paths(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``nodes`` that the body reaches, with path array<int>, depth int: a join a level, as deep as the data are.

    Each level is a table in the shared folder, since every later step reads it. A tree is as deep as it is:
    the body reaches no ring of parents. Only with ``max_depth`` deeper trees raise an error."""
    slim = nodes.select("doc_id", "ref", "parent_ref", "child_pos")
    level = materialize(slim.filter(F.col("parent_ref") == BODY).select("doc_id", "ref", F.array("child_pos").alias("path")))
    paths, depth = level, 1
    while True:
        up = level.select("doc_id", F.col("ref").alias("parent_ref"), F.col("path").alias("up"))
        level = materialize(slim.join(up, ["doc_id", "parent_ref"]).select("doc_id", "ref", F.concat("up", F.array("child_pos")).alias("path")))
        if level.isEmpty():
            break
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"a tree is deeper than {max_depth} levels")
        paths = paths.unionByName(level)
    return nodes.join(paths, ["doc_id", "ref"]).withColumn("depth", F.size("path"))


def traverse(nodes: DataFrame, labels=None, layers=("body",), pages=None, with_groups: bool = False) -> DataFrame:
    """The nodes to visit, with seq (from 0, over all nodes of the document). A node that is left out hides nothing below it;
    groups ignore the page filter; a page filter takes nodes with any place on the page (column pages array<int>)."""
    t = nodes.withColumn("seq", (F.row_number().over(doc_window()) - 1).cast("long"))
    group = F.col("kind") == "groups"
    keep = F.col("layer").isin(*layers)
    if not with_groups:
        keep &= ~group
    if labels is not None:
        keep &= group | F.col("label").isin(*labels)
    if pages is not None:
        keep &= group | F.arrays_overlap("pages", F.array(*map(F.lit, pages)))
    return t.filter(keep)


def excluded(nodes: DataFrame, labels=DEFAULT_LABELS, layers=("body",), pages=None, start: int = 0, stop: int | None = None) -> DataFrame:
    """``nodes`` with seq and excluded boolean, as a serializer decides: by index over all nodes, and by label, layer and
    first page for items (not groups)."""
    t = nodes.withColumn("seq", (F.row_number().over(doc_window()) - 1).cast("long"))
    out = F.col("seq") < start
    if stop is not None:
        out |= F.col("seq") >= stop
    item = ~F.col("label").isin(*labels) | ~F.col("layer").isin(*layers)
    if pages is not None:
        item |= F.coalesce(~F.col("page_no").isin(*pages), F.lit(False))
    return t.withColumn("excluded", out | ((F.col("kind") != "groups") & item))


def page_breaks(nodes: DataFrame) -> DataFrame:
    """(doc_id, ref, prev_page, next_page): a break before each node whose first page is over all pages before it."""
    before = F.max("page_no").over(doc_window().rowsBetween(Window.unboundedPreceding, -1))
    t = nodes.filter("page_no is not null").withColumn("prev_page", before)
    return t.filter("page_no > prev_page").select("doc_id", "ref", "prev_page", F.col("page_no").alias("next_page"))


def resolve(refs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """``refs`` with target_label and target_text of the node that ``column`` names."""
    n = nodes.select("doc_id", F.col("ref").alias(column), F.col("label").alias("target_label"), F.col("text").alias("target_text"))
    return refs.join(n, ["doc_id", column], "left")


def caption_text(float_refs: DataFrame, nodes: DataFrame, role: str = "caption") -> DataFrame:
    """(doc_id, owner_ref, text): the texts of an item's captions in order, with nothing between."""
    r = resolve(float_refs.filter(F.col("role") == role).withColumnRenamed("target_ref", "ref2"), nodes, "ref2")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("target_text", F.lit("")).alias("t"))))
    return r.groupBy("doc_id", "owner_ref").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "").alias("text"))


def heading_level(label: Column, level: Column) -> Column:
    """0 for titles, the level for section headers, null for others."""
    return F.when(label == "title", F.lit(0)).when(label == "section_header", level)


def is_below(path: Column, top: Column) -> Column:
    """Is ``path`` that of ``top`` or of a node below it?"""
    return F.slice(path, F.lit(1), F.size(top)) == top


def above(path: Column) -> Column:
    """The paths of all ancestors."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda n: F.slice(path, F.lit(1), n)), lambda p: F.size(p) > 0)


def element_tree(nodes: DataFrame) -> DataFrame:
    """(doc_id, tree): a line a node, indented by depth: seq, label and the start of the text."""
    t = nodes.withColumn("seq", (F.row_number().over(doc_window()) - 1).cast("long"))
    line = F.concat(F.repeat(F.lit(" "), F.col("depth")), F.col("seq").cast("string"), F.lit(": "), F.col("label"), F.lit(" with text: "), middle_ellipsis(F.coalesce("text", F.lit("")), 40))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return t.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("tree"))


def middle_ellipsis(text: Column, most: int) -> Column:
    """Texts of over ``most`` characters lose their middle."""
    half = (most - 3) // 2
    return F.when(F.char_length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most - 3 - half)), F.lit("..."), F.right(text, F.lit(half)))).otherwise(text)


# ------------------------------------------------------------------- validation
def duplicate_refs(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "ref").agg(F.count("*").alias("n")).filter("n > 1")


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is neither the body nor a node of the document."""
    parents = nodes.select("doc_id", F.col("ref").alias("parent_ref")).distinct()
    return nodes.filter(F.col("parent_ref") != BODY).join(parents, ["doc_id", "parent_ref"], "left_anti")


def misplaced_list_items(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_ref, run, ref, child_pos): list items outside of list groups; neighbours share a run, which becomes a group."""
    groups = nodes.filter("kind = 'groups' and label in ('list', 'ordered_list')").select("doc_id", F.col("ref").alias("parent_ref"))
    w = Window.partitionBy("doc_id", "parent_ref").orderBy("child_pos")
    t = nodes.join(groups, ["doc_id", "parent_ref"], "left_anti").withColumn("rn", F.row_number().over(w)).filter("label = 'list_item'")
    return t.withColumn("run", F.col("rn") - F.row_number().over(w)).select("doc_id", "parent_ref", "run", "ref", "child_pos")


def wrap_list_items(nodes: DataFrame) -> DataFrame:
    """``nodes`` with every run of misplaced list items under a new list group in its place."""
    m = misplaced_list_items(nodes)
    name = F.concat(F.lit("#/groups/list:"), F.col("parent_ref"), F.lit(":"), F.col("run").cast("string"))
    moved = m.select("doc_id", "ref", name.alias("group_ref"), F.col("child_pos").alias("old"))
    made = m.groupBy("doc_id", "parent_ref", "run").agg(F.min("child_pos").alias("child_pos")).select("doc_id", name.alias("ref"), "parent_ref", "child_pos", F.lit("groups").alias("kind"), F.lit("list").alias("label"), F.lit("body").alias("layer"))
    out = nodes.join(moved, ["doc_id", "ref"], "left").withColumn("parent_ref", F.coalesce("group_ref", "parent_ref")).drop("group_ref", "old")
    return out.unionByName(made, allowMissingColumns=True)


def clamp_boxes(prov: DataFrame, pages: DataFrame) -> DataFrame:
    """``prov`` with boxes inside their pages; ``far`` tells that one stuck out by more than a hundredth of the page."""
    b, w, h = F.col("bbox"), F.col("width"), F.col("height")
    c = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), most)
    made = F.struct(c(b["l"], w).alias("l"), c(b["t"], h).alias("t"), c(b["r"], w).alias("r"), c(b["b"], h).alias("b"), b["coord_origin"].alias("coord_origin"))
    out = lambda x, most: (x < -0.01 * most) | (x > 1.01 * most)
    far = out(b["l"], w) | out(b["r"], w) | out(b["t"], h) | out(b["b"], h)
    p = prov.join(pages, ["doc_id", "page_no"], "left")
    return p.withColumn("far", F.coalesce(far, F.lit(False))).withColumn("bbox", F.when(w.isNull(), b).otherwise(made)).drop("width", "height")


# --------------------------------------------------------------------- mutation
def renumber(nodes: DataFrame, order: str = "child_pos") -> DataFrame:
    """Child positions without gaps."""
    w = Window.partitionBy("doc_id", "parent_ref").orderBy(order)
    return nodes.withColumn("child_pos", (F.row_number().over(w) - 1).cast("int"))


def subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` (with paths) that are, or are below, one of ``roots`` (doc_id, ref): each node looks for its ancestors' paths."""
    tops = nodes.join(roots.select("doc_id", "ref").distinct(), ["doc_id", "ref"], "left_semi").select("doc_id", F.col("path").alias("top"))
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n)))
    hit = nodes.select("doc_id", "ref", up.alias("top")).join(tops, ["doc_id", "top"], "left_semi").select("doc_id", "ref").distinct()
    return nodes.join(hit, ["doc_id", "ref"], "left_semi")


def delete(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` without the subtrees of ``roots``; positions close up."""
    gone = subtrees(nodes, roots).select("doc_id", "ref")
    return renumber(nodes.join(gone, ["doc_id", "ref"], "left_anti"))


def item_range(nodes: DataFrame, ranges: DataFrame, start: bool = True, end: bool = True) -> DataFrame:
    """The children between first_ref and last_ref of ``ranges`` (doc_id, first_ref, last_ref), which share a parent."""
    a = nodes.select("doc_id", F.col("ref").alias("first_ref"), F.col("parent_ref").alias("p1"), F.col("child_pos").alias("low"))
    b = nodes.select("doc_id", F.col("ref").alias("last_ref"), F.col("parent_ref").alias("p2"), F.col("child_pos").alias("high"))
    r = ranges.join(a, ["doc_id", "first_ref"]).join(b, ["doc_id", "last_ref"])
    r = r.withColumn("parent_ref", F.when(F.col("p1") == F.col("p2"), F.col("p1")).otherwise(F.raise_error(F.lit("the ends of a range have different parents"))))
    low, high = F.col("low") + (0 if start else 1), F.col("high") - (0 if end else 1)
    return nodes.join(r.select("doc_id", "parent_ref", low.alias("low"), high.alias("high")), ["doc_id", "parent_ref"]).filter("child_pos between low and high").drop("low", "high")


def delete_range(nodes: DataFrame, ranges: DataFrame, start: bool = True, end: bool = True) -> DataFrame:
    return delete(nodes, item_range(nodes, ranges, start, end))


def extract_range(nodes: DataFrame, ranges: DataFrame, start: bool = True, end: bool = True) -> DataFrame:
    """The subtrees of a range as documents of their own: the range's items hang under the body."""
    tops = item_range(nodes, ranges, start, end).select("doc_id", "ref", F.lit(True).alias("is_top"))
    out = subtrees(nodes, tops).join(tops, ["doc_id", "ref"], "left")
    return renumber(out.withColumn("parent_ref", F.when(F.col("is_top"), F.lit(BODY)).otherwise(F.col("parent_ref"))).drop("is_top"))


def insert(nodes: DataFrame, new: DataFrame, after: bool = True) -> DataFrame:
    """``nodes`` with ``new`` rows, each next to its sibling_ref (columns of nodes but parent_ref and child_pos, plus sibling_ref)."""
    s = nodes.select("doc_id", F.col("ref").alias("sibling_ref"), "parent_ref", F.col("child_pos").cast("double").alias("at"))
    placed = new.join(s, ["doc_id", "sibling_ref"]).withColumn("at", F.col("at") + (0.5 if after else -0.5)).drop("sibling_ref")
    both = nodes.withColumn("at", F.col("child_pos").cast("double")).unionByName(placed, allowMissingColumns=True)
    return renumber(both, "at").drop("at")


def replace(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with each node that sibling_ref names, and what is below it, replaced by the row of ``new``."""
    added = insert(nodes, new, after=False)
    old = new.select("doc_id", F.col("sibling_ref").alias("ref"))
    # the paths of the old tree still tell what lies below
    gone = subtrees(nodes, old).select("doc_id", "ref")
    return renumber(added.join(gone, ["doc_id", "ref"], "left_anti"))


def heading_levels(nodes: DataFrame) -> list[int]:
    """The levels that headings of ``nodes`` have, ascending."""
    level = heading_level(F.col("label"), F.col("heading_level")).alias("h")
    return sorted(r["h"] for r in nodes.select(level).filter("h is not null").distinct().collect())


def hierarchize(nodes: DataFrame) -> DataFrame:
    """(flat) top-level nodes move under the nearest heading before them that is open: a heading closes those of its level and deeper.

    Works on the children of the body; lower nodes stay with their parents."""
    top = nodes.filter(F.col("parent_ref") == BODY)
    w = Window.partitionBy("doc_id").orderBy("child_pos").rowsBetween(Window.unboundedPreceding, -1)
    lvl = heading_level(F.col("label"), F.col("heading_level"))
    top = top.withColumn("h", lvl)
    # the last heading of each level before a node, as (position, ref); open if it is after every last one of a lower level
    levels = heading_levels(top)
    lasts = [F.last(F.when(F.col("h") == k, F.struct("child_pos", "ref")), ignorenulls=True).over(w).alias(f"l{i}") for i, k in enumerate(levels)]
    top = top.select("*", *lasts)
    parent = F.lit(None).cast("string")
    for i, k in enumerate(levels):
        lower = [F.coalesce(F.col(f"l{j}.child_pos"), F.lit(-1)) for j in range(i)]
        is_open = F.col(f"l{i}").isNotNull() & (F.col(f"l{i}.child_pos") > (F.greatest(*lower) if len(lower) > 1 else lower[0] if lower else F.lit(-1)))
        parent = F.when(is_open & (F.col("h").isNull() | (F.col("h") > k)), F.col(f"l{i}.ref")).otherwise(parent)
    moved = top.select("doc_id", "ref", F.coalesce(parent, F.lit(BODY)).alias("new_parent"))
    out = nodes.join(moved, ["doc_id", "ref"], "left").withColumn("at", F.struct(F.coalesce((F.col("parent_ref") == BODY) & (F.col("new_parent") != BODY), F.lit(False)).alias("moved"), "child_pos"))
    return renumber(out.withColumn("parent_ref", F.coalesce("new_parent", "parent_ref")).drop("new_parent"), "at").drop("at")


def flatten(nodes: DataFrame) -> DataFrame:
    """What hangs under headings moves up to the nearest ancestor that is no heading, in reading order (nodes with paths)."""
    ups = nodes.select("doc_id", "ref", F.explode(above(F.col("path"))).alias("up"))
    anc = nodes.select("doc_id", F.col("path").alias("up"), F.col("ref").alias("up_ref"), F.col("label").isin("title", "section_header").alias("is_heading"))
    near = ups.join(anc, ["doc_id", "up"]).filter("not is_heading").groupBy("doc_id", "ref").agg(F.max_by("up_ref", F.size("up")).alias("new_parent"))
    out = nodes.join(near, ["doc_id", "ref"], "left").withColumn("parent_ref", F.coalesce("new_parent", F.lit(BODY))).drop("new_parent")
    return renumber(out, "path")


# ----------------------------------------------------------------- set operators
def filter_pages(nodes: DataFrame, pages, known: DataFrame | None = None) -> DataFrame:
    """Items whose first page is in ``pages``, with pages renumbered from 1; the others' children climb to the nearest
    ancestor that stays. ``known`` (doc_id, page_no): pages must exist or an error is raised."""
    keep = nodes.filter(F.col("page_no").isin(*pages))
    if known is not None:
        have = known.filter(F.col("page_no").isin(*pages)).groupBy("doc_id").agg(F.count("*").alias("n_have"))
        bad = F.when(F.coalesce("n_have", F.lit(0)) < len(set(pages)), F.raise_error(F.lit("a page does not exist")).cast("int"))
        keep = keep.join(have, "doc_id", "left").filter(bad.isNull()).drop("n_have")
    ups = keep.select("doc_id", "ref", F.explode(above(F.col("path"))).alias("up"))
    near = ups.join(keep.select("doc_id", F.col("path").alias("up"), F.col("ref").alias("up_ref")), ["doc_id", "up"]).groupBy("doc_id", "ref").agg(F.max_by("up_ref", F.size("up")).alias("new_parent"))
    out = keep.join(near, ["doc_id", "ref"], "left").withColumn("parent_ref", F.coalesce("new_parent", F.lit(BODY))).drop("new_parent")
    return renumber(out, "path").withColumn("page_no", F.col("page_no") - F.lit(min(pages)) + 1)


def concatenate(nodes: DataFrame, sets: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One document a set of ``sets`` (doc_id, set_id, pos): nodes in order of pos. Pages shift by those of the documents
    before: a document's pages start after the highest page so far; refs get the position as a prefix."""
    span = (pages if pages is not None else nodes.select("doc_id", "page_no")).groupBy("doc_id").agg(F.min("page_no").alias("p0"), F.max("page_no").alias("p1"))
    w = Window.partitionBy("set_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = sets.join(span, "doc_id", "left").withColumn("before", F.coalesce(F.sum(F.col("p1") - F.col("p0") + 1).over(w), F.lit(0)))
    j = nodes.join(s, "doc_id")
    tag = lambda r: F.when(r == BODY, r).otherwise(F.concat(r, F.lit("@"), F.col("pos").cast("string")))
    out = j.withColumn("ref", tag(F.col("ref"))).withColumn("parent_ref", tag(F.col("parent_ref"))).withColumn("page_no", F.col("page_no") - F.col("p0") + 1 + F.col("before"))
    top = F.when(F.col("parent_ref") == BODY, F.struct("pos", "child_pos")).otherwise(F.struct(F.lit(0).alias("pos"), F.col("child_pos")))
    out = out.withColumn("doc_id", F.col("set_id")).withColumn("at", top)
    return renumber(out, "at").drop("at", "set_id", "pos", "p0", "p1", "before")


def concatenated_names(sets: DataFrame) -> DataFrame:
    """(set_id, name): the names of ``sets`` (set_id, pos, name) joined by " + "; neighbours of equal name count once."""
    w = Window.partitionBy("set_id").orderBy("pos")
    s = sets.withColumn("last", F.lag("name").over(w)).filter("last is null or last != name")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return s.groupBy("set_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), " + ").alias("name"))
