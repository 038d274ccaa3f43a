"""Parsers of tagged markup and subtitles, as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

ITEM = r"(?s)<(title|section_header_level_\d+|text|paragraph|list_item|code|formula|caption|footnote|page_header|page_footer|checkbox_selected|checkbox_unselected|reference|otsl|picture)>(.*?)(?:</\1>|(?=<(?:title|section_header_level_\d+|text|paragraph|list_item|code|formula|caption|footnote|page_header|page_footer|otsl|picture)>)|$)"


def parse_doctags(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, pos, page_no, label, heading_level, code_language, location, text, otsl) of docs(doc_id, text).

    Pages are counted by page breaks; an item whose tag isn't closed ends where the next one starts."""
    body = F.regexp_replace(F.col(column), r"</?doctag>|</?(un)?ordered_list>", "")
    p = docs.select("doc_id", F.posexplode(F.split(body, "<page_break>")).alias("pg", "page"))
    e = p.select("doc_id", "pg", F.posexplode(F.arrays_zip(F.regexp_extract_all("page", F.lit(ITEM), 1).alias("tag"), F.regexp_extract_all("page", F.lit(ITEM), 2).alias("body"))).alias("i", "x"))
    w = Window.partitionBy("doc_id").orderBy("pg", "i")
    tag, inner = F.col("x.tag"), F.col("x.body")
    label = F.when(tag.startswith("section_header"), "section_header").when(tag == "otsl", "table").otherwise(tag)
    level = F.when(tag == "title", F.lit(0)).when(tag.startswith("section_header"), F.regexp_extract(tag, r"(\d+)$", 1).cast("int"))
    lang = F.nullif(F.regexp_extract(inner, r"^(?:<loc_\d+>)*<_([^>]*)_>", 1), F.lit(""))
    plain = F.when(label == "table", F.lit("")).otherwise(F.regexp_replace(tx.strip_tags(inner), r"^<_[^>]*_>", ""))
    return e.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("pg") + 1).cast("int").alias("page_no"), label.alias("label"), level.alias("heading_level"), F.when(label == "code", lang).alias("code_language"), tx.locations(inner).alias("location"), F.when(label == "code", plain).otherwise(F.trim(plain)).alias("text"), F.when(label == "table", F.regexp_replace(inner, r"<loc_\d+>", "")).alias("otsl"))


TIMES = r"(?m)^((?:\d{2,}:)?[0-5]\d:[0-5]\d\.\d{3})[ \t]+-->[ \t]+((?:\d{2,}:)?[0-5]\d:[0-5]\d\.\d{3})[^\n]*$"


def parse_vtt(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, cue_ix, identifier, start_time, end_time, span_ix, voice, text) of docs(doc_id, text): a row a voice span.

    Blocks without times (header, notes, styles, regions) give nothing; settings are dropped; a voice's end tag may lack."""
    norm = F.replace(F.replace(F.col(column), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    b = docs.select("doc_id", F.posexplode(F.split(norm, r"\n\s*\n")).alias("pos", "block")).filter(F.col("block").rlike(TIMES) & ~F.col("block").rlike(r"^(NOTE|STYLE|REGION)\b"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.regexp_extract("block", r"(?s)^\s*([^\n]*)\n[^\n]*-->", 1)
    payload = F.trim(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", ""))
    c = b.select("doc_id", (F.dense_rank().over(w) - 1).cast("long").alias("cue_ix"), F.nullif(before, F.lit("")).alias("identifier"), tx.parse_timestamp(F.regexp_extract("block", TIMES, 1)).alias("start_time"), tx.parse_timestamp(F.regexp_extract("block", TIMES, 2)).alias("end_time"), payload.alias("payload"))
    spans = F.when(F.contains("payload", F.lit("<v")), F.filter(F.split("payload", r"(?=<v[ .])|</v>"), lambda x: x.rlike(r"\S"))).otherwise(F.array("payload"))
    e = c.select("*", F.posexplode(spans).alias("span_ix", "span"))
    voice = F.nullif(F.trim(F.regexp_extract("span", r"^<v(?:\.[^ >]*)?[ ]+([^>]*)>", 1)), F.lit(""))
    return e.select("doc_id", "cue_ix", "identifier", "start_time", "end_time", "span_ix", voice.alias("voice"), F.regexp_replace("span", r"^<v[^>]*>", "").alias("text"))


def disordered(cues: DataFrame) -> DataFrame:
    """Cues that start before the one ahead of them."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    return cues.withColumn("last", F.lag("start_time").over(w)).filter("start_time < last").drop("last")
