"""Documents made of flat tables: lines of plain text, web pages, conversations, and grouped records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns without lookaround or back references, so that other engines can run them too.
HIDDEN = r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
INLINE = r"</?(b|br|a|i|em|strong|span)( [^>]*)?/?>"
BLOCK = r"<(h[1-6]|p|li|footer|div)[^>]*>([^<]*)"


def _node(doc: Column, pos: Column, label: Column, layer: Column, text: Column, level: Column) -> list[Column]:
    return [doc.alias("doc_id"), F.concat(F.lit("#/texts/"), pos.cast("string")).alias("ref"), F.lit("texts").alias("kind"), label.alias("label"), layer.alias("layer"), F.lit("#/body").alias("parent_ref"), pos.cast("int").alias("child_pos"), text.alias("text"), level.cast("int").alias("heading_level")]


def from_lines(documents: DataFrame) -> DataFrame:
    """A text node for each line of documents(doc_id, text); blank lines keep their place but give no node."""
    d = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    text = F.trim(F.col("line"))
    return d.filter(text != "").select(*_node(F.col("doc_id"), F.col("pos"), F.lit("text"), F.lit("body"), text, F.lit(None)))


def unescape(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def from_pages(pages: DataFrame) -> DataFrame:
    """Nodes of pages(page_id, html): headings, paragraphs, list items; navigation, footers and plain blocks are furniture."""
    body = F.regexp_replace(F.regexp_replace("html", HIDDEN, ""), INLINE, "")
    p = pages.select(F.col("page_id").alias("doc_id"), F.regexp_extract(body, r"(?s)<body>(.*)", 1).alias("body"))
    tag, text = F.expr(f"regexp_extract_all(body, r'{BLOCK}', 1)"), F.expr(f"regexp_extract_all(body, r'{BLOCK}', 2)")
    e = p.select("doc_id", F.posexplode(F.arrays_zip(tag.alias("tag"), text.alias("text"))).alias("pos", "b"))
    t, tag = F.trim(F.regexp_replace(unescape(F.col("b.text")), r"\s+", " ")), F.col("b.tag")
    label = F.when(tag == "h1", "title").when(tag.startswith("h"), "section_header").when(tag == "li", "list_item").when(tag == "footer", "page_footer").otherwise("text")
    layer = F.when(tag.isin("li", "footer", "div"), "furniture").otherwise("body")
    level = F.when(tag.startswith("h"), F.substr(tag, F.lit(2)).cast("int") - 1)
    return e.filter(t != "").select(*_node(F.col("doc_id"), F.col("pos"), label, layer, t, level))


def from_conversations(turns: DataFrame) -> DataFrame:
    """A document a conversation, a text node a turn; the role is the voice."""
    t = turns.filter("text is not null").select(*_node(F.col("conv_id"), F.col("turn"), F.lit("text"), F.lit("body"), F.col("text"), F.lit(None)), F.col("role").alias("voice"))
    return t


def from_geography(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """A document a region: its title, a section a nation, a subsection a market segment, a list item a customer.

    The tree is nested: (doc_id, ref, parent_ref, child_pos, ...)."""
    # nation and region are dimension tables of fixed size
    c = customer.join(F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey)), F.col("c_nationkey") == F.col("n_nationkey"))
    title = region.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("#/texts/t").alias("ref"), F.lit("#/body").alias("parent_ref"), F.lit(0).alias("child_pos"), F.lit("title").alias("label"), F.col("r_name").alias("text"), F.lit(0).alias("heading_level"))
    sect = c.groupBy("r_regionkey", "n_nationkey", "n_name").agg(F.count("*")).select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("#/texts/n"), F.col("n_nationkey").cast("string")).alias("ref"), F.lit("#/body").alias("parent_ref"), (F.col("n_nationkey") + 1).cast("int").alias("child_pos"), F.lit("section_header").alias("label"), F.col("n_name").alias("text"), F.lit(1).alias("heading_level"))
    seg_ref = F.concat(F.lit("#/texts/n"), F.col("n_nationkey").cast("string"), F.col("c_mktsegment"))
    sub = c.groupBy("r_regionkey", "n_nationkey", "c_mktsegment").agg(F.count("*")).select(F.col("r_regionkey").cast("long").alias("doc_id"), seg_ref.alias("ref"), F.concat(F.lit("#/texts/n"), F.col("n_nationkey").cast("string")).alias("parent_ref"), F.ascii("c_mktsegment").cast("int").alias("child_pos"), F.lit("section_header").alias("label"), F.col("c_mktsegment").alias("text"), F.lit(2).alias("heading_level"))
    item = c.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("#/texts/c"), F.col("c_custkey").cast("string")).alias("ref"), seg_ref.alias("parent_ref"), F.col("c_custkey").cast("int").alias("child_pos"), F.lit("list_item").alias("label"), F.col("c_name").alias("text"), F.lit(None).cast("int").alias("heading_level"))
    out = title.unionByName(sect).unionByName(sub).unionByName(item)
    return out.withColumn("kind", F.lit("texts")).withColumn("layer", F.lit("body"))


def table_of_orders(lineitem: DataFrame) -> DataFrame:
    """Cells of a table an order: a header row and a row a line of part, quantity and flag; the flag of line 1 spans no more than itself."""
    head = lineitem.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("doc_id"), F.posexplode(F.array(*map(F.lit, ("line", "part", "quantity", "flag")))).alias("c0", "text")).withColumn("r0", F.lit(0))
    row = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("p|"), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"))
    body = lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("r0"), F.posexplode(row).alias("c0", "text"))
    c = head.unionByName(body)
    return c.select("doc_id", F.lit("#/tables/0").alias("ref"), (F.col("r0") * 4 + F.col("c0")).alias("cell_ix"), "r0", (F.col("r0") + 1).alias("r1"), "c0", (F.col("c0") + 1).alias("c1"), "text", (F.col("r0") == 0).alias("column_header"), (F.col("c0") == 0).alias("row_header"))
