"""Traversal, filters, validation, mutation and set operators over trees made of the geography tables and web pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import build
from ..operators import tree as t
from ..sources import tables as src
from ..storage import materialize


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def geo(spark, sf):
    return src.from_geography(_read(spark, sf, "region"), _read(spark, sf, "nation"), _read(spark, sf, "customer"))


def geo_paths(spark, sf):
    return t.with_paths(materialize(geo(spark, sf)))


def web(spark, sf):
    """Nodes of the web pages; a page of print holds ten blocks."""
    return src.from_pages(_read(spark, sf, "pages")).withColumn("page_no", (F.col("child_pos") / 10).cast("int") + 1).withColumn("path", F.array("child_pos"))


_SHAPE = ("doc_id", "ref", "parent_ref", "child_pos", "label", "text")


def preorder_traversal(spark, sf):
    return geo_paths(spark, sf).select("doc_id", "ref", "depth", (F.row_number().over(t.doc_window()) - 1).cast("long").alias("seq"), F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


def label_counts(spark, sf):
    return web(spark, sf).groupBy("label", "layer").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


def layer_filter(spark, sf):
    return t.traverse(web(spark, sf)).select("doc_id", "ref", "seq", "label")


def furniture_traversal(spark, sf):
    return t.traverse(web(spark, sf), labels=("list_item", "page_footer"), layers=("furniture",)).select("doc_id", "ref", "seq", "text")


def excluded_nodes(spark, sf):
    return t.excluded(web(spark, sf), labels=("title", "text"), pages=(1, 2), start=1, stop=14).select("doc_id", "ref", "seq", "excluded")


def slice_by_index(spark, sf):
    return t.excluded(geo_paths(spark, sf), start=2, stop=9).filter("not excluded").select("doc_id", "seq", "ref", "text")


def page_filter(spark, sf):
    n = web(spark, sf).withColumn("pages", F.array("page_no"))
    return t.traverse(n, pages=(2,)).select("doc_id", "ref", "page_no", "label")


def page_breaks(spark, sf):
    return t.page_breaks(web(spark, sf).filter("layer = 'body'"))


def resolve_refs(spark, sf):
    n = geo(spark, sf)
    return t.resolve(n.select("doc_id", "ref", "parent_ref"), n, "parent_ref")


def caption_text(spark, sf):
    """Each title's captions are the first two paragraphs of its page."""
    n = web(spark, sf).filter("layer = 'body' and label = 'text'")
    k = n.withColumn("pos", F.row_number().over(t.doc_window()) - 1).filter("pos < 2")
    refs = k.select("doc_id", F.lit("#/texts/title").alias("owner_ref"), F.lit("caption").alias("role"), "pos", F.col("ref").alias("target_ref"))
    return t.caption_text(refs, n)


def heading_levels(spark, sf):
    return geo(spark, sf).select("doc_id", "ref", t.heading_level(F.col("label"), F.col("heading_level")).alias("level"))


def element_tree(spark, sf):
    return t.element_tree(geo_paths(spark, sf))


def duplicate_refs(spark, sf):
    """Two turns of a conversation with equal texts count as one ref."""
    n = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("#/texts/"), F.col("l_suppkey").cast("string")).alias("ref"))
    return t.duplicate_refs(n)


def orphan_check(spark, sf):
    """The geography without the nations of key 3 and 7: their segments lose their parents."""
    n = geo(spark, sf).filter("ref not in ('#/texts/n3', '#/texts/n7')")
    return t.orphans(n).select("doc_id", "ref", "parent_ref")


def misplaced_lists(spark, sf):
    m = t.misplaced_list_items(web(spark, sf))
    return m.groupBy("doc_id", "run").agg(F.count("*").alias("items"), F.min("child_pos").alias("first"))


def wrapped_lists(spark, sf):
    return t.wrap_list_items(web(spark, sf).drop("path")).groupBy("doc_id", "parent_ref").agg(F.count("*").alias("children"))


def _first_nations(n):
    """The first section of each document."""
    w = Window.partitionBy("doc_id").orderBy("child_pos")
    return n.filter("heading_level = 1").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("doc_id", "ref")


def delete_subtree(spark, sf):
    n = geo_paths(spark, sf)
    return t.delete(n, _first_nations(n)).select(*_SHAPE)


def _middle(n):
    """From the second to the third section of each document."""
    w = Window.partitionBy("doc_id").orderBy("child_pos")
    k = n.filter("heading_level = 1").withColumn("rn", F.row_number().over(w))
    return k.groupBy("doc_id").agg(F.max(F.when(F.col("rn") == 2, F.col("ref"))).alias("first_ref"), F.max(F.when(F.col("rn") == 3, F.col("ref"))).alias("last_ref")).filter("first_ref is not null and last_ref is not null")


def extract_range(spark, sf):
    n = geo_paths(spark, sf)
    return t.extract_range(n, _middle(n)).select(*_SHAPE)


def delete_range(spark, sf):
    n = geo_paths(spark, sf)
    return t.delete_range(n, _middle(n), end=False).select(*_SHAPE)


def insert_after(spark, sf):
    n = geo(spark, sf)
    new = _first_nations(n).select("doc_id", F.col("ref").alias("sibling_ref"), F.concat(F.col("ref"), F.lit("x")).alias("ref"), F.lit("text").alias("label"), F.lit("inserted").alias("text"), F.lit("texts").alias("kind"), F.lit("body").alias("layer"))
    return t.insert(n, new).filter(F.col("parent_ref") == t.BODY).select(*_SHAPE)


def replace_item(spark, sf):
    n = geo_paths(spark, sf)
    new = _first_nations(n).select("doc_id", F.col("ref").alias("sibling_ref"), F.concat(F.col("ref"), F.lit("x")).alias("ref"), F.lit("text").alias("label"), F.lit("replaced").alias("text"))
    return t.replace(n, new).filter("parent_ref = '#/body'").select(*_SHAPE)


def flatten(spark, sf):
    return t.flatten(geo_paths(spark, sf)).select("doc_id", "ref", "parent_ref", "child_pos")


def hierarchize(spark, sf):
    flat = t.flatten(geo_paths(spark, sf)).drop("path", "depth")
    return t.hierarchize(flat).select("doc_id", "ref", "parent_ref")


def filter_pages(spark, sf):
    return t.filter_pages(web(spark, sf), (2, 3)).select("doc_id", "ref", "parent_ref", "child_pos", "page_no")


def concatenate_docs(spark, sf):
    """Pages of equal id modulo 50 become one document."""
    n = web(spark, sf).drop("path").filter("layer = 'body'")
    w = Window.partitionBy("set_id").orderBy("doc_id")
    sets = n.select("doc_id").distinct().withColumn("set_id", F.col("doc_id") % 50).withColumn("pos", F.row_number().over(w) - 1)
    return t.concatenate(n, sets).select("doc_id", "ref", "child_pos", F.col("page_no").cast("long").alias("page_no"))


def concatenated_names(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name"))
    return t.concatenated_names(o)


def build_document(spark, sf):
    """Orders as documents: a title, a heading a line status, a paragraph a line, a table at the end, added in two calls."""
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("seq"), F.lit("title").alias("label"), F.col("o_orderpriority").alias("text"))
    empty = o.limit(0).select("doc_id", F.lit("").alias("ref"), F.lit("").alias("parent_ref"), F.lit(0).alias("child_pos"), "label", "text", F.lit("").alias("kind"))
    li = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("n"), "l_linestatus", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = li.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).join(o.select("doc_id"), "doc_id", "left_semi")
    lines = li.select("doc_id", F.col("n").alias("seq"), F.when(F.col("n") % 3 == 1, "section_header").otherwise("list_item").alias("label"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))
    table = o.select("doc_id", F.lit(1000).alias("seq"), F.lit("table").alias("label"), F.lit(None).cast("string").alias("text"))
    n = build.add_items(build.add_items(empty, o), lines.unionByName(table))
    return n.select("doc_id", "ref", "parent_ref", "child_pos", "kind", "label", "text", "heading_level", "marker")


def build_lists(spark, sf):
    """A list a market segment in the document of each nation, its customers the items."""
    c = _read(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_mktsegment").alias("list_ix"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("text"))
    base = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit("#/texts/0").alias("ref"), F.lit(t.BODY).alias("parent_ref"), F.lit(0).alias("child_pos"), F.lit("title").alias("label"), F.col("n_name").alias("text"), F.lit("texts").alias("kind"))
    return build.add_lists(base, c).select("doc_id", "ref", "parent_ref", "child_pos", "label", "text")


_F = (build_document, build_lists, preorder_traversal, label_counts, layer_filter, furniture_traversal, excluded_nodes, slice_by_index, page_filter, page_breaks, resolve_refs, caption_text, heading_levels, element_tree, duplicate_refs, orphan_check, misplaced_lists, wrapped_lists, delete_subtree, extract_range, delete_range, insert_after, replace_item, flatten, hierarchize, filter_pages, concatenate_docs, concatenated_names)
QUERIES = {f.__name__: f for f in _F}

GEO = """WITH RECURSIVE j AS (SELECT r_regionkey::BIGINT d, n_nationkey nk, n_name, c_mktsegment seg, c_custkey ck, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT r_regionkey::BIGINT doc_id, '#/texts/t' ref, '#/body' parent_ref, 0::INT child_pos, 'title' AS label, r_name AS text, 0::INT lvl FROM region
 UNION ALL SELECT DISTINCT d, '#/texts/n' || nk, '#/body', (nk+1)::INT, 'section_header', n_name, 1::INT FROM j
 UNION ALL SELECT DISTINCT d, '#/texts/n' || nk || seg, '#/texts/n' || nk, ascii(seg)::INT, 'section_header', seg, 2::INT FROM j
 UNION ALL SELECT d, '#/texts/c' || ck, '#/texts/n' || nk || seg, ck::INT, 'list_item', c_name, NULL::INT FROM j),
p AS (SELECT *, [child_pos] path FROM g WHERE parent_ref = '#/body' UNION ALL SELECT g.*, list_append(p.path, g.child_pos) FROM g JOIN p ON g.doc_id = p.doc_id AND g.parent_ref = p.ref),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 seq FROM p),
f AS (SELECT doc_id, min(child_pos) top FROM g WHERE lvl = 1 GROUP BY 1),
k AS (SELECT doc_id, max(child_pos) FILTER (rn = 2) a, max(child_pos) FILTER (rn = 3) z FROM (SELECT doc_id, child_pos, row_number() OVER (PARTITION BY doc_id ORDER BY child_pos) rn FROM g WHERE lvl = 1) GROUP BY 1 HAVING count(*) >= 3) """
WEB = r"""WITH h AS (SELECT page_id doc_id, regexp_extract(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '</?(b|br|a|i|em|strong|span)( [^>]*)?/?>', '', 'g'), '(?s)<body>(.*)', 1) body FROM pages),
x AS (SELECT doc_id, regexp_extract_all(body, '<(h[1-6]|p|li|footer|div)[^>]*>([^<]*)', 1) tags, regexp_extract_all(body, '<(h[1-6]|p|li|footer|div)[^>]*>([^<]*)', 2) texts FROM h),
e AS (SELECT doc_id, unnest(range(0, len(tags))) i, unnest(tags) tag, unnest(texts) raw FROM x),
n AS (SELECT doc_id, i::INT child_pos, '#/texts/' || i ref, trim(regexp_replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS text,
 CASE WHEN tag = 'h1' THEN 'title' WHEN tag LIKE 'h%' THEN 'section_header' WHEN tag = 'li' THEN 'list_item' WHEN tag = 'footer' THEN 'page_footer' ELSE 'text' END AS label,
 CASE WHEN tag IN ('li', 'footer', 'div') THEN 'furniture' ELSE 'body' END layer FROM e),
w AS (SELECT *, (child_pos // 10 + 1)::INT page_no, row_number() OVER (PARTITION BY doc_id ORDER BY child_pos) - 1 seq FROM n WHERE text <> '') """
_RN = "(row_number() OVER (PARTITION BY doc_id, parent_ref ORDER BY {}) - 1)::INT"
_SQL = "doc_id, ref, parent_ref, {} child_pos, label, text"
ORACLE = {
    "build_document": """WITH l AS (SELECT l_orderkey doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) n, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
 m AS (SELECT doc_id, max(n) m FROM l GROUP BY 1), u AS (SELECT o_orderkey doc_id, 0 p, 'texts' kind, 'title' AS label, o_orderpriority AS text, 0 lvl, NULL AS marker FROM orders
 UNION ALL SELECT doc_id, n, 'texts', CASE WHEN n % 3 = 1 THEN 'section_header' ELSE 'list_item' END, 'part ' || l_partkey, CASE WHEN n % 3 = 1 THEN 1 END, CASE WHEN n % 3 <> 1 THEN '-' END FROM l
 UNION ALL SELECT o_orderkey, coalesce(m, 0) + 1, 'tables', 'table', NULL, NULL, NULL FROM orders LEFT JOIN m ON doc_id = o_orderkey)
 SELECT doc_id, '#/' || kind || '/' || CASE WHEN kind = 'tables' THEN 0 ELSE p END ref, '#/body' parent_ref, p::INT child_pos, kind, label, text, lvl::INT heading_level, marker FROM u""",
    "build_lists": """WITH c AS (SELECT c_nationkey::BIGINT doc_id, c_mktsegment s, c_custkey k, c_name, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) f FROM customer), r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY f) - 1 g FROM c)
 SELECT n_nationkey::BIGINT doc_id, '#/texts/0' ref, '#/body' parent_ref, 0::INT child_pos, 'title' AS label, n_name AS text FROM nation
 UNION ALL SELECT DISTINCT doc_id, '#/groups/' || g, '#/body', (CASE WHEN doc_id IN (SELECT n_nationkey FROM nation) THEN 1 ELSE 0 END + g)::INT, 'list', NULL FROM r
 UNION ALL SELECT doc_id, '#/texts/' || (CASE WHEN doc_id IN (SELECT n_nationkey FROM nation) THEN 1 ELSE 0 END + row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1), '#/groups/' || g, (row_number() OVER (PARTITION BY doc_id, g ORDER BY k) - 1)::INT, 'list_item', c_name FROM r""",
    "preorder_traversal": GEO + "SELECT doc_id, ref, len(path)::INT AS depth, seq, array_to_string(path, '.') path FROM s",
    "label_counts": WEB + "SELECT label, layer, count(*) n, sum(length(text))::BIGINT chars FROM w GROUP BY 1, 2",
    "layer_filter": WEB + "SELECT doc_id, ref, seq, label FROM w WHERE layer = 'body'",
    "furniture_traversal": WEB + "SELECT doc_id, ref, seq, text FROM w WHERE layer = 'furniture' AND label IN ('list_item', 'page_footer')",
    "excluded_nodes": WEB + "SELECT doc_id, ref, seq, seq < 1 OR seq >= 14 OR label NOT IN ('title', 'text') OR layer <> 'body' OR page_no NOT IN (1, 2) excluded FROM w",
    "slice_by_index": GEO + "SELECT doc_id, seq, ref, text FROM s WHERE seq BETWEEN 2 AND 8",
    "page_filter": WEB + "SELECT doc_id, ref, page_no, label FROM w WHERE layer = 'body' AND page_no = 2",
    "page_breaks": WEB + ", b AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id ORDER BY child_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prev_page FROM w WHERE layer = 'body') SELECT doc_id, ref, prev_page, page_no next_page FROM b WHERE page_no > prev_page",
    "resolve_refs": GEO + "SELECT g.doc_id, g.parent_ref, g.ref, q.label target_label, q.text target_text FROM g LEFT JOIN g q ON g.doc_id = q.doc_id AND g.parent_ref = q.ref",
    "caption_text": WEB + ", c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY child_pos) - 1 pos FROM w WHERE layer = 'body' AND label = 'text') SELECT doc_id, '#/texts/title' owner_ref, string_agg(text, '' ORDER BY pos) AS text FROM c WHERE pos < 2 GROUP BY 1",
    "heading_levels": GEO + "SELECT doc_id, ref, lvl AS level FROM g",
    "element_tree": GEO + "SELECT doc_id, string_agg(repeat(' ', len(path)) || seq || ': ' || label || ' with text: ' || CASE WHEN length(text) > 40 THEN left(text, 19) || '...' || right(text, 18) ELSE text END, chr(10) ORDER BY seq) tree FROM s GROUP BY 1",
    "duplicate_refs": "SELECT l_orderkey doc_id, '#/texts/' || l_suppkey ref, count(*) n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "orphan_check": GEO + "SELECT doc_id, ref, parent_ref FROM g WHERE parent_ref IN ('#/texts/n3', '#/texts/n7')",
    "misplaced_lists": WEB + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY child_pos) rn FROM w), m AS (SELECT *, (rn - row_number() OVER (PARTITION BY doc_id ORDER BY child_pos))::INT run FROM r WHERE label = 'list_item') SELECT doc_id, run, count(*) \"items\", min(child_pos) \"first\" FROM m GROUP BY 1, 2",
    "wrapped_lists": WEB + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY child_pos) rn FROM w), m AS (SELECT doc_id, ref, (rn - row_number() OVER (PARTITION BY doc_id ORDER BY child_pos))::INT run FROM r WHERE label = 'list_item'), a AS (SELECT doc_id, '#/groups/list:#/body:' || run parent_ref FROM m UNION ALL SELECT doc_id, '#/body' FROM w WHERE label <> 'list_item' UNION ALL SELECT DISTINCT doc_id, '#/body' || left('', run) FROM m) SELECT doc_id, parent_ref, count(*) children FROM (SELECT doc_id, parent_ref FROM a WHERE parent_ref LIKE '#/groups%' UNION ALL SELECT doc_id, '#/body' FROM w WHERE label <> 'list_item' UNION ALL SELECT doc_id, '#/body' FROM (SELECT DISTINCT doc_id, run FROM m)) GROUP BY 1, 2",
    "delete_subtree": GEO + "SELECT " + _SQL.format(_RN.format("child_pos")) + " FROM p JOIN f USING (doc_id) WHERE path[1] <> top",
    "extract_range": GEO + "SELECT doc_id, ref, parent_ref, " + _RN.format("child_pos") + " child_pos, label, text FROM p JOIN k USING (doc_id) WHERE path[1] BETWEEN a AND z",
    "delete_range": GEO + "SELECT " + _SQL.format(_RN.format("child_pos")) + " FROM p LEFT JOIN k USING (doc_id) WHERE NOT coalesce(path[1] >= a AND path[1] < z, false)",
    "insert_after": GEO + ", u AS (SELECT doc_id, ref, parent_ref, child_pos::DOUBLE pos, label, text FROM g WHERE parent_ref = '#/body' UNION ALL SELECT doc_id, ref || 'x', parent_ref, child_pos + 0.5, 'text', 'inserted' FROM g JOIN f USING (doc_id) WHERE child_pos = top AND lvl = 1) SELECT " + _SQL.format(_RN.format("pos")) + " FROM u",
    "replace_item": GEO + ", u AS (SELECT doc_id, CASE WHEN child_pos = top THEN ref || 'x' ELSE ref END ref, parent_ref, child_pos, CASE WHEN child_pos = top THEN 'text' ELSE label END AS label, CASE WHEN child_pos = top THEN 'replaced' ELSE text END AS text FROM g LEFT JOIN f USING (doc_id) WHERE parent_ref = '#/body') SELECT " + _SQL.format(_RN.format("child_pos")) + " FROM u",
    "flatten": GEO + "SELECT doc_id, ref, '#/body' parent_ref, seq::INT child_pos FROM s",
    "hierarchize": GEO + "SELECT doc_id, ref, CASE WHEN lvl = 1 THEN '#/texts/t' ELSE parent_ref END parent_ref FROM g",
    "filter_pages": WEB + "SELECT doc_id, ref, '#/body' parent_ref, (row_number() OVER (PARTITION BY doc_id ORDER BY child_pos) - 1)::INT child_pos, (page_no - 1)::INT page_no FROM w WHERE page_no IN (2, 3)",
    "concatenate_docs": WEB + """, b AS (SELECT * FROM w WHERE layer = 'body'), q AS (SELECT doc_id, doc_id % 50 set_id, min(page_no) p0, max(page_no) p1 FROM b GROUP BY 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY doc_id) - 1 pos, coalesce(sum(p1-p0+1) OVER (PARTITION BY set_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) bef FROM q)
 SELECT set_id doc_id, ref || '@' || pos ref, (row_number() OVER (PARTITION BY set_id ORDER BY pos, child_pos) - 1)::INT child_pos, (page_no - p0 + 1 + bef)::BIGINT page_no FROM b JOIN o USING (doc_id)""",
    "concatenated_names": "WITH l AS (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) p FROM orders) SELECT o_custkey set_id, string_agg(o_orderpriority, ' + ' ORDER BY o_orderkey) AS name FROM l WHERE p IS NULL OR p <> o_orderpriority GROUP BY 1",
}
