"""Serializers: an expression an item and format, then ordered aggregation into a document.

Input: nodes with paths (doc_id, ref, parent_ref, path, kind, label, layer, text; optional heading_level, marker, enumerated,
code_language, formatting, hyperlink, block). ``block`` is text that is rendered already, such as a table. Items under a
list group are one block, a line each, indented by the depth of lists; items under an inline group share a line.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.tree import above, excluded
from ..schema import DEFAULT_LABELS

LISTS = ("list", "ordered_list")
OPTIONAL = {"heading_level": "int", "marker": "string", "enumerated": "boolean", "code_language": "string", "hyperlink": "string", "orig": "string", "block": "string", "location": "string", "page_no": "int", "formatting": "struct<bold: boolean, italic: boolean, underline: boolean, strikethrough: boolean, script: string>"}


@dataclass(frozen=True)
class Options:
    labels: tuple[str, ...] = DEFAULT_LABELS
    layers: tuple[str, ...] = ("body",)
    pages: tuple[int, ...] | None = None
    start: int = 0
    stop: int | None = None
    escape: bool = True
    page_break: str | None = None
    indent: int = 4
    extra: dict = field(default_factory=dict)


def with_floats(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """``nodes`` with caption and footnote, the texts that ``refs`` (doc_id, owner_ref, role, pos, target_ref) give an item, and
    is_float for the items that are a caption or footnote of another: serializers render them with their owner only."""
    r = refs.filter(F.col("role").isin("caption", "footnote") & (F.col("owner_ref") != F.col("target_ref")))
    text = nodes.select("doc_id", F.col("ref").alias("target_ref"), F.coalesce("text", F.lit("")).alias("t"))
    joined = lambda role, glue: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "t")))), lambda x: x["t"]), glue), F.lit(""))
    own = r.join(text, ["doc_id", "target_ref"]).groupBy("doc_id", F.col("owner_ref").alias("ref")).agg(joined("caption", "").alias("caption"), joined("footnote", "\n").alias("footnote"))
    used = r.join(nodes.select("doc_id", F.col("ref").alias("owner_ref")), ["doc_id", "owner_ref"], "left_semi").select("doc_id", F.col("target_ref").alias("ref")).distinct().withColumn("is_float", F.lit(True))
    return nodes.drop("caption", "footnote", "is_float").join(own, ["doc_id", "ref"], "left").join(used, ["doc_id", "ref"], "left")


def floated(part: Column, caption: Column, footnote: Column, glue: str) -> Column:
    """The caption, the item and its footnotes; nothing for what is rendered with its owner."""
    # each part stands once in the expression: styles nest, and a copy would double it
    some = F.filter(F.array(caption, part, footnote), lambda x: x.isNotNull() & (x != ""))
    return F.when(~F.coalesce("is_float", F.lit(False)), F.array_join(some, glue))


def prepare(nodes: DataFrame, o: Options) -> DataFrame:
    """Included items with the block that they belong to (block_ref, block_kind), list_level and list_pos (from 1)."""
    for c, kind in OPTIONAL.items():
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(kind))
    n = excluded(nodes, o.labels, o.layers, o.pages, o.start, o.stop)
    w = Window.partitionBy("doc_id", "parent_ref").orderBy("path")
    n = n.withColumn("list_pos", F.row_number().over(w)).withColumn("first_enumerated", F.first("enumerated").over(w))
    groups = n.filter((F.col("kind") == "groups") & F.col("label").isin(*LISTS, "inline")).select("doc_id", F.col("path").alias("up"), F.col("ref").alias("g_ref"), F.col("label").alias("g_label"))
    ups = n.filter("kind <> 'groups'").select("doc_id", "ref", F.explode(above(F.col("path"))).alias("up")).join(groups, ["doc_id", "up"])
    owner = ups.groupBy("doc_id", "ref").agg(F.min_by("g_ref", F.size("up")).alias("block_ref"), F.min_by("g_label", F.size("up")).alias("block_kind"), F.count_if(F.col("g_label").isin(*LISTS)).alias("list_level"))
    out = n.filter("kind <> 'groups' and not excluded").join(owner, ["doc_id", "ref"], "left")
    return out.withColumn("block_ref", F.coalesce("block_ref", "ref")).withColumn("list_level", F.coalesce("list_level", F.lit(0)))


def assemble(items: DataFrame, part: Column, glue: str, list_open: Column | None = None, list_close: Column | None = None, list_glue: str = "\n", page_break: str | None = None) -> DataFrame:
    """(doc_id, text): items of a block joined by line ends (inline: spaces), blocks by ``glue``; empty parts give nothing."""
    i = items.withColumn("part", part).filter("part is not null and part <> ''")
    first = F.min_by(F.struct("block_kind", "first_enumerated"), "seq").alias("b")
    b = i.groupBy("doc_id", "block_ref").agg(F.min("seq").alias("seq"), F.min("page_no").alias("page_no"), first, F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("p"))
    texts = F.transform("p", lambda x: x["part"])
    whole = F.when(F.col("b.block_kind") == "inline", F.array_join(texts, " ")).otherwise(F.array_join(texts, list_glue))
    if list_open is not None:
        whole = F.when(F.col("b.block_kind").isin(*LISTS), F.concat(list_open, whole, list_close)).otherwise(whole)
    b = b.withColumn("whole", whole)
    if page_break is not None:
        before = F.max("page_no").over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        b = b.withColumn("whole", F.when(F.col("page_no") > before, F.concat(F.lit(page_break + glue), F.col("whole"))).otherwise(F.col("whole")))
    return b.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "whole"))), lambda x: x["whole"]), glue).alias("text"))


def styled(text: Column, marks: dict[str, tuple[str, str]], link=None) -> Column:
    """Formatting from the inside out: bold, italic, underline, strikethrough, script, then the link."""
    f = F.col("formatting")
    for name in ("bold", "italic", "underline", "strikethrough"):
        if name in marks:
            a, b = marks[name]
            text = F.when(F.coalesce(f[name], F.lit(False)), F.concat(F.lit(a), text, F.lit(b))).otherwise(text)
    for name in ("sub", "super"):
        if name in marks:
            a, b = marks[name]
            text = F.when(f["script"] == name, F.concat(F.lit(a), text, F.lit(b))).otherwise(text)
    return F.when(F.col("hyperlink").isNotNull(), link(text, F.col("hyperlink"))).otherwise(text) if link else text


def is_heading() -> Column:
    return F.col("label").isin("title", "section_header")


def _inline() -> Column:
    return F.coalesce(F.col("block_kind") == "inline", F.lit(False))


def _list_line(text: Column, o: Options) -> Column:
    """The marker and text of a list item: a valid marker of its own, the position in an enumerated list, or a dash."""
    m = F.coalesce("marker", F.lit(""))
    valid = m.isin("-", "*", "+") | m.rlike(r"^\d+\.$")
    own = F.when(valid, m).when(m.rlike("[a-zA-Z0-9]"), F.concat(F.lit("- "), m)).when(F.coalesce("first_enumerated", F.lit(False)), F.concat(F.col("list_pos").cast("string"), F.lit("."))).otherwise(F.lit("-"))
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.col("list_level") - 1, F.lit(0)).cast("int") * o.indent), own, F.lit(" "), text)


# ---------------------------------------------------------------------- formats
def markdown(nodes: DataFrame, o: Options = Options(), plain: bool = False) -> DataFrame:
    marks = {} if plain else {"bold": ("**", "**"), "italic": ("*", "*"), "strikethrough": ("~~", "~~")}
    link = None if plain else lambda t, u: F.concat(F.lit("["), t, F.lit("]("), u, F.lit(")"))
    raw = F.coalesce("text", F.lit(""))
    safe = tx.html_escape(tx.escape_underscores(raw), quote=False) if o.escape and not plain else raw
    label = F.col("label")
    boxed = F.when(label == "checkbox_selected", F.concat(F.lit("- [x] "), safe)).when(label == "checkbox_unselected", F.concat(F.lit("- [ ] "), safe)).otherwise(safe)
    t = styled(boxed, marks, link)
    hashes = F.when(label == "title", F.lit(1)).otherwise(F.coalesce("heading_level", F.lit(1)) + 1)
    heading = t if plain else F.concat(F.repeat(F.lit("#"), hashes), F.lit(" "), t)
    code = raw if plain else F.when(_inline() | F.col("hyperlink").isNotNull(), F.concat(F.lit("`"), raw, F.lit("`"))).otherwise(F.concat(F.lit("```\n"), raw, F.lit("\n```")))
    formula = F.when(raw != "", F.when(_inline(), F.concat(F.lit("$"), raw, F.lit("$"))).otherwise(F.concat(F.lit("$$"), raw, F.lit("$$")))).when(F.coalesce("orig", F.lit("")) != "", F.lit("<!-- formula-not-decoded -->")).otherwise(F.lit(""))
    part = F.when(F.col("block").isNotNull(), F.col("block")).when(is_heading(), heading).when(label == "code", styled(code, marks, link)).when(label == "formula", styled(formula, marks, link)).when(label == "list_item", _list_line(t, o)).otherwise(t)
    if not plain:
        part = F.when((label == "picture") & F.col("block").isNull(), F.lit("<!-- image -->")).otherwise(part)
    note = lambda c: tx.html_escape(tx.escape_underscores(F.col(c)), quote=False) if o.escape and not plain else F.col(c)
    if "is_float" in nodes.columns:
        part = floated(part, note("caption"), note("footnote"), "\n\n")
    return assemble(prepare(nodes, o), part, "\n\n", page_break=o.page_break)


def plain_text(nodes: DataFrame, o: Options = Options()) -> DataFrame:
    return markdown(nodes, o, plain=True)


HTML_HEAD = "<!DOCTYPE html>\n<html>\n<head>\n<meta charset=\"UTF-8\"/>\n</head>\n<body>\n<div class='page'>\n"
HTML_END = "\n</div>\n</body>\n</html>"


def html(nodes: DataFrame, o: Options = Options(), head: str = HTML_HEAD, end: str = HTML_END) -> DataFrame:
    tags = {n: (f"<{t}>", f"</{t}>") for n, t in (("bold", "strong"), ("italic", "em"), ("underline", "u"), ("strikethrough", "del"), ("sub", "sub"), ("super", "sup"))}
    raw = F.coalesce("text", F.lit(""))
    t = styled(F.replace(tx.html_escape(raw, quote=False), F.lit("\n"), F.lit("<br>")), tags, lambda x, u: F.concat(F.lit('<a href="'), u, F.lit('">'), x, F.lit("</a>")))
    wrap = lambda tag, x: F.concat(F.lit("<"), tag, F.lit(">"), x, F.lit("</"), tag, F.lit(">"))
    label = F.col("label")
    level = F.when(label == "title", F.lit(1)).otherwise(F.least(F.coalesce("heading_level", F.lit(1)) + 1, F.lit(6)))
    p = F.when(tx.is_rtl(raw), F.concat(F.lit('<p dir="rtl">'), t, F.lit("</p>"))).otherwise(wrap(F.lit("p"), t))
    code = F.when(_inline(), wrap(F.lit("code"), t)).otherwise(F.concat(F.lit("<pre><code>"), tx.html_escape(raw, quote=False), F.lit("</code></pre>")))
    part = F.when(F.col("block").isNotNull(), F.col("block")).when(is_heading(), wrap(F.concat(F.lit("h"), level.cast("string")), t)).when(label == "code", code).when(label == "list_item", wrap(F.lit("li"), t)).when(_inline(), t).otherwise(p)
    if "is_float" in nodes.columns:
        note = lambda c: tx.html_escape(F.col(c), quote=False)
        table = F.concat(F.lit("<table><caption>"), note("caption"), F.lit("</caption>"), F.substr("block", F.lit(8)))
        part = F.when(F.startswith("block", F.lit("<table>")) & F.col("caption").isNotNull(), table).otherwise(part)
        figure = wrap(F.lit("figure"), F.concat(F.coalesce("block", F.lit("")), F.coalesce(wrap(F.lit("figcaption"), note("caption")), F.lit(""))))
        part = F.when(label == "picture", figure).otherwise(part)
        part = floated(part, F.lit(None).cast("string"), wrap(F.lit("p"), note("footnote")), "\n")
    tag = F.when(F.coalesce("b.first_enumerated", F.lit(False)), F.lit("ol")).otherwise(F.lit("ul"))
    out = assemble(prepare(nodes, o), part, "\n", F.concat(F.lit("<"), tag, F.lit(">\n")), F.concat(F.lit("\n</"), tag, F.lit(">")))
    return out.withColumn("text", F.concat(F.lit(head), F.col("text"), F.lit(end)))


def doctags(nodes: DataFrame, o: Options = Options()) -> DataFrame:
    """A tag an item with its location (column location, if any) and content, all in ``<doctag>``."""
    raw = F.trim(styled(F.coalesce("text", F.lit("")), {n: (f"<{t}>", f"</{t}>") for n, t in (("bold", "bold"), ("italic", "italic"), ("underline", "underline"), ("strikethrough", "strikethrough"))}))
    label = F.col("label")
    tag = F.when(label == "section_header", F.concat(F.lit("section_header_level_"), F.coalesce("heading_level", F.lit(1)).cast("string"))).when(label == "table", F.lit("otsl")).otherwise(label)
    body = F.concat(F.coalesce("location", F.lit("")), F.when(label == "code", F.concat(F.lit("<_"), F.coalesce("code_language", F.lit("unknown")), F.lit("_>"))).otherwise(F.lit("")), F.coalesce("block", raw))
    if "is_float" in nodes.columns:
        body = F.concat(body, F.coalesce(F.concat(F.lit("<caption>"), F.trim("caption"), F.lit("</caption>")), F.lit("")))
    part = F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))
    if "is_float" in nodes.columns:
        part = floated(part, F.lit(None).cast("string"), F.concat(F.lit("<footnote>"), F.col("footnote"), F.lit("</footnote>")), "\n")
    kind = F.when(F.coalesce("b.first_enumerated", F.lit(False)), F.lit("ordered_list")).otherwise(F.lit("unordered_list"))
    out = assemble(prepare(nodes, o), part, "\n", F.concat(F.lit("<"), kind, F.lit(">")), F.concat(F.lit("\n</"), kind, F.lit(">")), page_break="<page_break>")
    return out.withColumn("text", F.concat(F.lit("<doctag>"), F.col("text"), F.lit("\n</doctag>")))


def latex(nodes: DataFrame, o: Options = Options(), document_class: str = r"\documentclass[11pt,a4paper]{article}", packages: tuple[str, ...] = ()) -> DataFrame:
    """The title moves to the preamble; section levels outside 1 to 3 raise an error."""
    raw = F.coalesce("text", F.lit(""))
    t = styled(tx.latex_escape(raw), {"bold": (r"\textbf{", "}"), "italic": (r"\textit{", "}"), "underline": (r"\underline{", "}"), "sub": ("$_{", "}$"), "super": ("$^{", "}$")}, lambda x, u: F.concat(F.lit(r"\href{"), u, F.lit("}{"), x, F.lit("}")))
    label, level = F.col("label"), F.coalesce("heading_level", F.lit(1))
    cmd = F.when(level == 1, F.lit("section")).when(level == 2, F.lit("subsection")).when(level == 3, F.lit("subsubsection")).otherwise(F.raise_error(F.lit("section levels go from 1 to 3")))
    heading = F.concat(F.lit("\\"), cmd, F.lit("{"), t, F.lit("}"))
    code = F.when(_inline(), F.concat(F.lit(r"\texttt{"), F.replace(raw, F.lit("#"), F.lit("\\\\#")), F.lit("}"))).otherwise(F.concat(F.lit("\\begin{verbatim}\n"), raw, F.lit("\n\\end{verbatim}")))
    formula = F.when(raw != "", F.when(_inline(), F.concat(F.lit("$"), raw, F.lit("$"))).otherwise(F.concat(F.lit("$$"), raw, F.lit("$$")))).when(F.coalesce("orig", F.lit("")) != "", F.lit("% formula-not-decoded")).otherwise(F.lit(""))
    part = F.when(F.col("block").isNotNull(), F.col("block")).when(label == "title", F.lit(None)).when(label == "section_header", heading).when(label == "code", code).when(label == "formula", formula).when(label == "list_item", F.concat(F.lit(r"\item "), t)).otherwise(t)
    if "is_float" in nodes.columns:
        figure = F.concat(F.lit("\\begin{figure}[h]\n"), F.coalesce(F.concat(F.lit("\\caption{"), tx.latex_escape(F.col("caption")), F.lit("}\n")), F.lit("")), F.lit("\\end{figure}"))
        part = F.when((label == "picture") & F.col("block").isNull(), figure).otherwise(part)
        part = floated(part, F.when(label != "picture", tx.latex_escape(F.col("caption"))), tx.latex_escape(F.col("footnote")), "\n\n")
    items = prepare(nodes, o)
    env = F.when(F.coalesce("b.first_enumerated", F.lit(False)), F.lit("enumerate")).otherwise(F.lit("itemize"))
    body = assemble(items, part, "\n\n", F.concat(F.lit("\\begin{"), env, F.lit("}\n")), F.concat(F.lit("\n\\end{"), env, F.lit("}")))
    title = items.filter("label = 'title'").groupBy("doc_id").agg(F.min_by(F.concat(F.lit(r"\title{"), t, F.lit("}")), "seq").alias("title"))
    d = items.select("doc_id").distinct().join(body, "doc_id", "left").join(title, "doc_id", "left")
    head = [document_class, "", *[p for p in packages], ""]
    text = F.concat(F.lit("\n".join(head)), F.coalesce(F.concat("title", F.lit("\n\n")), F.lit("")), F.lit("\\begin{document}\n\n"), F.when(F.col("title").isNotNull(), F.lit("\\maketitle\n\n")).otherwise(F.lit("")), F.coalesce("text", F.lit("")), F.lit("\n\n\\end{document}"))
    return d.select("doc_id", text.alias("text"))


def azure(nodes: DataFrame, pages: DataFrame, tables: DataFrame | None = None, o: Options = Options()) -> DataFrame:
    """(doc_id, text): JSON with pages, tables, figures and paragraphs; items without a page are left out."""
    items = prepare(nodes, o).filter("page_no is not null")
    role = F.when(F.col("label") == "title", "title").when(F.col("label") == "section_header", "sectionHeading").when(F.col("label") == "page_header", "pageHeader").when(F.col("label") == "page_footer", "pageFooter").when(F.col("label") == "footnote", "footnote").when(F.col("label") == "formula", "formulaBlock")
    region = F.array(F.struct(F.col("page_no").alias("pageNumber")))
    para = items.filter("kind = 'texts'").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(F.coalesce("text", F.lit("")).alias("content"), role.alias("role"), region.alias("boundingRegions")).alias("x")))), lambda s: s["x"]).alias("paragraphs"))
    figs = items.filter("kind = 'pictures'").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(F.concat(F.lit("fig_"), "seq").alias("id"), region.alias("boundingRegions")).alias("x")))), lambda s: s["x"]).alias("figures"))
    pg = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no").alias("pageNumber"), "width", "height"))).alias("pages"))
    d = pg.join(para, "doc_id", "full").join(figs, "doc_id", "full")
    tabs = F.array().cast("array<string>")
    if tables is not None:
        cell = F.struct(F.col("r0").alias("rowIndex"), F.col("c0").alias("columnIndex"), (F.col("r1") - F.col("r0")).alias("rowSpan"), (F.col("c1") - F.col("c0")).alias("colSpan"), F.col("text").alias("content"))
        t = tables.groupBy("doc_id", "ref").agg(F.max("r1").alias("rowCount"), F.max("c1").alias("columnCount"), F.transform(F.array_sort(F.collect_list(F.struct("cell_ix", cell.alias("x")))), lambda s: s["x"]).alias("cells"))
        t = t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref", F.struct("rowCount", "columnCount", "cells").alias("x")))), lambda s: s["x"]).alias("tables"))
        d, tabs = d.join(t, "doc_id", "full"), F.coalesce("tables", F.array())
    return d.select("doc_id", F.to_json(F.struct(F.coalesce("pages", F.array()).alias("pages"), tabs.alias("tables"), F.coalesce("figures", F.array()).alias("figures"), F.coalesce("paragraphs", F.array()).alias("paragraphs"))).alias("text"))


def webvtt(cues: DataFrame, title: Column | None = None) -> DataFrame:
    """(doc_id, text) of cues(doc_id, seq, identifier, start_time, end_time, voice, text): neighbours of equal identifier and
    times are one block; equal voices that touch are said once."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    same = (F.col("identifier").eqNullSafe(F.lag("identifier").over(w))) & (F.col("start_time") == F.lag("start_time").over(w)) & (F.col("end_time") == F.lag("end_time").over(w))
    c = cues.withColumn("block", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    v = F.when(F.col("voice").isNotNull(), F.concat(F.lit("<v "), F.col("voice"), F.lit(">"), F.col("text"), F.lit("</v>"))).otherwise(F.col("text"))
    b = c.withColumn("said", v).groupBy("doc_id", "block").agg(F.first("identifier").alias("identifier"), F.first("start_time").alias("s"), F.first("end_time").alias("e"), F.array_sort(F.collect_list(F.struct("seq", "said"))).alias("p"))
    payload = F.array_join(F.transform("p", lambda x: x["said"]), "")
    block = F.concat(F.coalesce(F.concat("identifier", F.lit("\n")), F.lit("")), tx.format_timestamp(F.col("s")), F.lit(" --> "), tx.format_timestamp(F.col("e")), F.lit("\n"), payload)
    d = b.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", block.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    return d.withColumn("text", F.concat(F.lit("WEBVTT\n\n"), F.col("text"), F.lit("\n")))


def outline(nodes: DataFrame, max_level: int | None = None, summary: int = 60) -> DataFrame:
    """(doc_id, text): a line a heading, indented by level, with its place; longer texts are cut with dots."""
    h = nodes.filter(is_heading()).withColumn("level", F.when(F.col("label") == "title", F.lit(0)).otherwise(F.coalesce("heading_level", F.lit(1))))
    if max_level is not None:
        h = h.filter(F.col("level") <= max_level)
    t = F.when(F.char_length("text") > summary, F.concat(F.substr("text", F.lit(1), F.lit(summary - 3)), F.lit("..."))).otherwise(F.col("text"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), t, F.lit(" [ref="), F.col("ref"), F.lit("]"))
    return h.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def table_of_contents(nodes: DataFrame, max_level: int | None = None) -> DataFrame:
    """(doc_id, level, pos, text): the headings alone."""
    h = nodes.filter(is_heading()).withColumn("level", F.when(F.col("label") == "title", F.lit(0)).otherwise(F.coalesce("heading_level", F.lit(1))))
    h = h.filter(F.col("level") <= max_level) if max_level is not None else h
    return h.select("doc_id", "level", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).alias("pos"), "text")


def draw_list(prov: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, page_no, z, shape, label, l, t, r, b): what a layout view draws, in reading order; arrows join the centres of
    neighbours on a page."""
    p = prov.join(nodes.select("doc_id", "ref", "label", "path"), ["doc_id", "ref"])
    w = Window.partitionBy("doc_id", "page_no").orderBy("path", "prov_ix")
    b = F.col("bbox")
    p = p.withColumn("z", F.row_number().over(w)).withColumn("cx", (b["l"] + b["r"]) / 2).withColumn("cy", (b["t"] + b["b"]) / 2)
    box = p.select("doc_id", "page_no", "z", F.lit("rect").alias("shape"), "label", F.col("bbox.l").alias("l"), F.col("bbox.t").alias("t"), F.col("bbox.r").alias("r"), F.col("bbox.b").alias("b"))
    a = p.withColumn("px", F.lag("cx").over(w)).withColumn("py", F.lag("cy").over(w)).filter("px is not null")
    arrow = a.select("doc_id", "page_no", "z", F.lit("arrow").alias("shape"), F.lit("reading_order").alias("label"), F.col("px").alias("l"), F.col("py").alias("t"), F.col("cx").alias("r"), F.col("cy").alias("b"))
    return box.unionByName(arrow)


def svg(drawn: DataFrame, width: float, height: float) -> DataFrame:
    """(doc_id, page_no, svg) of a draw list."""
    n = lambda c: F.format_string("%.2f", F.col(c))
    rect = F.concat(F.lit('<rect class="'), F.col("label"), F.lit('" x="'), n("l"), F.lit('" y="'), n("t"), F.lit('" width="'), F.format_string("%.2f", F.col("r") - F.col("l")), F.lit('" height="'), F.format_string("%.2f", F.abs(F.col("b") - F.col("t"))), F.lit('"/>'))
    line = F.concat(F.lit('<line x1="'), n("l"), F.lit('" y1="'), n("t"), F.lit('" x2="'), n("r"), F.lit('" y2="'), n("b"), F.lit('"/>'))
    e = drawn.withColumn("e", F.when(F.col("shape") == "rect", rect).otherwise(line))
    g = e.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "shape", "e"))), lambda x: x["e"]), "").alias("x"))
    return g.select("doc_id", "page_no", F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}">'), F.col("x"), F.lit("</svg>")).alias("svg"))


def draw_tables(cells: DataFrame, page_no: int = 1) -> DataFrame:
    """A draw list of table cells with boxes: a rectangle a cell, labelled by what it heads."""
    label = F.when(F.col("column_header"), "column_header").when(F.col("row_header"), "row_header").otherwise("cell")
    b = F.col("bbox")
    return cells.filter("bbox is not null").select("doc_id", F.lit(page_no).alias("page_no"), F.col("cell_ix").alias("z"), F.lit("rect").alias("shape"), label.alias("label"), b["l"].alias("l"), b["t"].alias("t"), b["r"].alias("r"), b["b"].alias("b"))


def draw_key_values(cells: DataFrame, links: DataFrame) -> DataFrame:
    """A draw list of a key-value graph (cells with page_no and bbox): a rectangle a cell, a line a link between centres."""
    b = F.col("bbox")
    box = cells.select("doc_id", "page_no", F.col("cell_id").alias("z"), F.lit("rect").alias("shape"), "label", b["l"].alias("l"), b["t"].alias("t"), b["r"].alias("r"), b["b"].alias("b"))
    mid = cells.select("doc_id", "page_no", "cell_id", ((b["l"] + b["r"]) / 2).alias("x"), ((b["t"] + b["b"]) / 2).alias("y"))
    s = mid.select("doc_id", "page_no", F.col("cell_id").alias("source_cell_id"), F.col("x").alias("l"), F.col("y").alias("t"))
    e = mid.select("doc_id", "page_no", F.col("cell_id").alias("target_cell_id"), F.col("x").alias("r"), F.col("y").alias("b"))
    line = links.select("doc_id", "label", "source_cell_id", "target_cell_id").join(s, ["doc_id", "source_cell_id"]).join(e, ["doc_id", "page_no", "target_cell_id"])
    return box.unionByName(line.select("doc_id", "page_no", F.col("source_cell_id").alias("z"), F.lit("line").alias("shape"), "label", "l", "t", "r", "b"))
