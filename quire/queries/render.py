"""Serializers over web pages, the geography tree and conversations; parsers of what they wrote; text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..operators.tree import with_paths
from ..plans import render as r
from ..sources import markup
from ..sources import tables as src
from ..storage import materialize
from . import tree as tq
from .geometry import BOXES, TURNED, boxes, page


def geo_lists(spark, sf):
    """The geography with a list group around the customers of each segment; every third group is enumerated."""
    n = materialize(tq.geo(spark, sf)).withColumn("enumerated", F.lit(None).cast("boolean"))
    item = F.col("label") == "list_item"
    group = F.concat(F.replace("parent_ref", F.lit("#/texts/n"), F.lit("#/groups/n")))
    g = n.filter(item).select("doc_id", "parent_ref", group.alias("ref")).distinct().withColumn("child_pos", F.lit(0)).withColumn("label", F.lit("list")).withColumn("kind", F.lit("groups")).withColumn("layer", F.lit("body"))
    moved = n.withColumn("enumerated", F.when(item, F.ascii(F.right(group, F.lit(1))) % 3 == 0)).withColumn("parent_ref", F.when(item, group).otherwise(F.col("parent_ref")))
    return with_paths(materialize(moved.unionByName(g, allowMissingColumns=True)))


def render_markdown(spark, sf):
    return r.markdown(tq.web(spark, sf))


def render_markdown_lists(spark, sf):
    return r.markdown(geo_lists(spark, sf))


def _captioned(spark, sf):
    """Web pages whose second paragraph stands for a picture: the first is its caption, the third its footnote."""
    n = tq.web(spark, sf).filter("layer = 'body'")
    w = Window.partitionBy("doc_id", "label").orderBy("path")
    n = n.withColumn("k", F.when(F.col("label") == "text", F.row_number().over(w) - 1)).withColumn("label", F.when(F.col("k") == 1, "picture").otherwise(F.col("label")))
    owner = n.filter("k = 1").select("doc_id", F.col("ref").alias("owner_ref"))
    refs = n.filter("k in (0, 2)").select("doc_id", F.when(F.col("k") == 0, "caption").otherwise("footnote").alias("role"), F.lit(0).alias("pos"), F.col("ref").alias("target_ref"))
    return r.with_floats(n, refs.join(owner, "doc_id"))


def render_captions(spark, sf):
    return r.markdown(_captioned(spark, sf))


def render_html_captions(spark, sf):
    return r.html(_captioned(spark, sf), head="", end="")


def render_text(spark, sf):
    return r.plain_text(tq.web(spark, sf))


def render_html(spark, sf):
    return r.html(tq.web(spark, sf), head="", end="")


def render_html_lists(spark, sf):
    return r.html(geo_lists(spark, sf)).select("doc_id", F.sha1("text").alias("text_sha1"), F.char_length("text").alias("chars"))


def render_doctags(spark, sf):
    return r.doctags(tq.web(spark, sf))


def render_latex(spark, sf):
    return r.latex(tq.web(spark, sf))


def render_azure(spark, sf):
    n = tq.web(spark, sf)
    return r.azure(n, n.select("doc_id", "page_no").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0)))


def cues(spark, sf):
    """A cue a turn, three seconds each; every second pair of turns shares its times."""
    t = src.from_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))
    at = (F.floor(F.col("child_pos") / 2) * 3).cast("double")
    return t.select("doc_id", F.col("child_pos").alias("seq"), F.lit(None).cast("string").alias("identifier"), at.alias("start_time"), (at + 2.5).alias("end_time"), "voice", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))


def render_vtt(spark, sf):
    return r.webvtt(cues(spark, sf))


def render_outline(spark, sf):
    return r.outline(tq.geo_paths(spark, sf), max_level=2)


def table_of_contents(spark, sf):
    return r.table_of_contents(tq.geo_paths(spark, sf), 1)


def parse_doctags(spark, sf):
    return markup.parse_doctags(r.doctags(tq.web(spark, sf))).select("doc_id", "pos", "label", "heading_level", "page_no", "text")


def parse_vtt(spark, sf):
    return markup.parse_vtt(r.webvtt(cues(spark, sf))).select("doc_id", "cue_ix", "start_time", "end_time", "voice", "text")


def cue_order(spark, sf):
    """Cues that start before the one ahead of them: none in order, some by length."""
    c = cues(spark, sf).withColumn("start_time", F.char_length("text").cast("double"))
    return markup.disordered(c).select("doc_id", "seq")


def text_functions(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    s = F.concat("p_name", F.lit("_#1&"), F.col("p_type"))
    return p.select(F.col("p_partkey").alias("k"), tx.latex_escape(s).alias("latex"), tx.html_escape(s).alias("html"), tx.escape_underscores(s).alias("underscores"), tx.humanize(F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("human"), tx.format_timestamp(F.col("p_retailprice")).alias("stamp"))


def timestamps(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("k"), F.round(tx.parse_timestamp(tx.format_timestamp(F.col("p_partkey") * 1.5)), 3).alias("seconds"))


def _placed(spark, sf):
    """Boxes of an order's lines on a page, with a node a line."""
    b = boxes(spark, sf).groupBy(F.col("k").alias("doc_id"), "line").agg(F.min(g.to_top_left(F.col("x"), page()[1])).alias("bbox"))
    ref = F.concat(F.lit("#/texts/"), F.col("line").cast("string"))
    prov = b.select("doc_id", ref.alias("ref"), F.lit(0).alias("prov_ix"), F.lit(1).alias("page_no"), "bbox")
    return prov, b.select("doc_id", ref.alias("ref"), F.lit("text").alias("label"), F.array("line").alias("path"))


def draw_list(spark, sf):
    return r.draw_list(*_placed(spark, sf))


def layout_svg(spark, sf):
    return r.svg(r.draw_list(*_placed(spark, sf)), 200, 120)


_F = (render_captions, render_html_captions, draw_list, layout_svg, render_markdown, render_markdown_lists, render_text, render_html, render_html_lists, render_doctags, render_latex, render_azure, render_vtt, render_outline, table_of_contents, parse_doctags, parse_vtt, cue_order, text_functions, timestamps)
QUERIES = {f.__name__: f for f in _F}

_H = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_WHERE = "FROM w WHERE layer = 'body'"
_LATEX = "list_reduce(list_transform(string_split(text, ''), lambda c: CASE c WHEN chr(92) THEN '\\textbackslash{}' WHEN '{' THEN '\\{' WHEN '}' THEN '\\}' WHEN '#' THEN '\\#' WHEN '$' THEN '\\$' WHEN '%' THEN '\\%' WHEN '&' THEN '\\&' WHEN '_' THEN '\\_' WHEN '~' THEN '\\textasciitilde{}' WHEN '^' THEN '\\textasciicircum{}' ELSE c END), lambda a, b: a || b)"
_GL = tq.GEO + ", li AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_ref ORDER BY path) lp, ascii(right(parent_ref, 1)) % 3 = 0 en FROM s WHERE label = 'list_item'), bl AS (SELECT doc_id, min(path) path, {list} t FROM li GROUP BY doc_id, parent_ref, en UNION ALL SELECT doc_id, path, {head} FROM s WHERE label <> 'list_item') "
_TS = "printf('%02d:%02d:%02d.%03d', CAST({0} // 3600000 AS BIGINT), CAST({0} // 60000 % 60 AS BIGINT), CAST({0} // 1000 % 60 AS BIGINT), CAST({0} % 1000 AS BIGINT))"
_CUES = "WITH c AS (SELECT conv_id doc_id, turn seq, role voice, replace(text, chr(10), ' ') AS text, CAST(turn // 2 AS BIGINT) b FROM conversations WHERE text IS NOT NULL), g AS (SELECT doc_id, b, string_agg('<v ' || voice || '>' || text || '</v>', '' ORDER BY seq) p FROM c GROUP BY 1, 2) "
_FLOATS = ", k AS (SELECT *, CASE WHEN label = 'text' THEN row_number() OVER (PARTITION BY doc_id, label ORDER BY child_pos) - 1 END k FROM w WHERE layer = 'body'), f AS (SELECT *, max(CASE WHEN k = 0 THEN {0} END) OVER (PARTITION BY doc_id) cap, max(CASE WHEN k = 2 THEN {0} END) OVER (PARTITION BY doc_id) note, max(k) OVER (PARTITION BY doc_id) last FROM k) "
_MD = _H.format("regexp_replace(text, $$_$$, $$" + chr(92) * 2 + "_$$, $$g$$)")
ORACLE = {
    "render_captions": tq.WEB + _FLOATS.format(_MD) + f"SELECT doc_id, string_agg(CASE WHEN k = 1 THEN cap || chr(10) || chr(10) || '<!-- image -->' || coalesce(chr(10) || chr(10) || note, '') ELSE CASE WHEN label = 'title' THEN '# ' ELSE '' END || {_MD} END, chr(10) || chr(10) ORDER BY child_pos) AS text FROM f WHERE NOT coalesce(last >= 1 AND k IN (0, 2), false) GROUP BY 1",
    "render_html_captions": tq.WEB + _FLOATS.format(_H.format("text")) + f"SELECT doc_id, string_agg(CASE WHEN k = 1 THEN '<figure><figcaption>' || cap || '</figcaption></figure>' || coalesce(chr(10) || '<p>' || note || '</p>', '') WHEN label = 'title' THEN '<h1>' || {_H.format('text')} || '</h1>' ELSE '<p>' || {_H.format('text')} || '</p>' END, chr(10) ORDER BY child_pos) AS text FROM f WHERE NOT coalesce(last >= 1 AND k IN (0, 2), false) GROUP BY 1",
    "render_markdown": tq.WEB + f"SELECT doc_id, string_agg(CASE WHEN label = 'title' THEN '# ' ELSE '' END || {_MD}, chr(10) || chr(10) ORDER BY child_pos) AS text {_WHERE} GROUP BY 1",
    "render_markdown_lists": _GL.format(list="string_agg(CASE WHEN en THEN lp || '. ' ELSE '- ' END || replace(text, '_', chr(92) || '_'), chr(10) ORDER BY path)", head="repeat('#', (lvl + 1)::BIGINT) || ' ' || replace(text, '_', chr(92) || '_')") + "SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY path) AS text FROM bl GROUP BY 1",
    "render_text": tq.WEB + f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY child_pos) AS text {_WHERE} GROUP BY 1",
    "render_html": tq.WEB + f"SELECT doc_id, string_agg(CASE WHEN label = 'title' THEN '<h1>' ELSE '<p>' END || {_H.format('text')} || CASE WHEN label = 'title' THEN '</h1>' ELSE '</p>' END, chr(10) ORDER BY child_pos) AS text {_WHERE} GROUP BY 1",
    "render_doctags": tq.WEB + ", b AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id ORDER BY child_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pp FROM w WHERE layer = 'body') SELECT doc_id, '<doctag>' || string_agg(CASE WHEN page_no > pp THEN '<page_break>' || chr(10) ELSE '' END || '<' || label || '>' || text || '</' || label || '>', chr(10) ORDER BY child_pos) || chr(10) || '</doctag>' AS text FROM b GROUP BY 1",
    "render_latex": tq.WEB + f", b AS (SELECT *, {_LATEX} t FROM w WHERE layer = 'body') SELECT doc_id, '\\documentclass[11pt,a4paper]{{article}}' || chr(10) || chr(10) || coalesce(min(CASE WHEN label = 'title' THEN '\\title{{' || t || '}}' || chr(10) || chr(10) END), '') || '\\begin{{document}}' || chr(10) || chr(10) || CASE WHEN count(*) FILTER (label = 'title') > 0 THEN '\\maketitle' || chr(10) || chr(10) ELSE '' END || coalesce(string_agg(t, chr(10) || chr(10) ORDER BY child_pos) FILTER (label <> 'title'), '') || chr(10) || chr(10) || '\\end{{document}}' AS text FROM b GROUP BY 1",
    "render_vtt": _CUES + f"SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_TS.format('(b*3000)')} || ' --> ' || {_TS.format('(b*3000+2500)')} || chr(10) || p, chr(10) || chr(10) ORDER BY b) || chr(10) AS text FROM g GROUP BY 1",
    "render_outline": tq.GEO + "SELECT doc_id, string_agg(repeat('  ', lvl::BIGINT) || '- ' || text || ' [ref=' || ref || ']', chr(10) ORDER BY path) AS text FROM s WHERE label <> 'list_item' GROUP BY 1",
    "table_of_contents": tq.GEO + "SELECT doc_id, lvl AS level, (row_number() OVER (PARTITION BY doc_id ORDER BY path))::INT pos, text FROM s WHERE lvl <= 1",
    "parse_doctags": tq.WEB + ", b AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id ORDER BY child_pos) pm, min(page_no) OVER (PARTITION BY doc_id) p0 FROM w WHERE layer = 'body'), d AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id ORDER BY pm))::INT pg FROM b) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY child_pos) - 1 pos, label, CASE WHEN label = 'title' THEN 0::INT END heading_level, pg page_no, text FROM d",
    "parse_vtt": _CUES + "SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY b) - 1 cue_ix, (b*3)::DOUBLE start_time, (b*3+2.5)::DOUBLE end_time, voice, text FROM c",
    "draw_list": BOXES + f", p AS (SELECT k doc_id, line, min((l, v0, r, v1)) x FROM {TURNED} GROUP BY 1, 2)" + """, q AS (SELECT *, (row_number() OVER w)::INT z, (x[1]+x[3])/2 cx, (x[2]+x[4])/2 cy, lag((x[1]+x[3])/2) OVER w px, lag((x[2]+x[4])/2) OVER w py FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line))
 SELECT doc_id, 1::INT page_no, z, 'rect' shape, 'text' AS label, x[1] l, x[2] t, x[3] r, x[4] b FROM q UNION ALL SELECT doc_id, 1::INT, z, 'arrow', 'reading_order', px, py, cx, cy FROM q WHERE px IS NOT NULL""",
    "cue_order": "WITH c AS (SELECT conv_id doc_id, turn seq, length(text) n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) p FROM conversations WHERE text IS NOT NULL) SELECT doc_id, seq::INT seq FROM c WHERE n < p",
    "text_functions": "WITH t AS (SELECT *, p_name || '_#1&' || p_type AS text FROM part) SELECT p_partkey k, " + _LATEX + " latex, replace(text, '&', '&amp;') html, replace(text, '_', chr(92) || '_') underscores, upper(left(p_type, 1)) || lower(substr(p_type, 2)) human, " + _TS.format("CAST(round_even(p_retailprice*1000, 0) AS BIGINT)") + " stamp FROM t",
    "timestamps": "SELECT p_partkey k, round(p_partkey*1.5::DOUBLE, 3) AS \"seconds\" FROM part",
}
