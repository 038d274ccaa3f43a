"""Chunkers over the geography tree, web pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk as c
from ..operators import code
from ..sources import tables as src
from . import tree as tq

_joined = lambda col: F.array_join(col, "/").alias(col)


def heading_scope(spark, sf):
    return c.heading_scope(tq.geo_paths(spark, sf)).select("doc_id", "ref", _joined("headings"))


def hierarchical_chunks(spark, sf):
    return c.hierarchical_chunks(tq.geo_paths(spark, sf)).select("doc_id", "chunk_ix", "text", _joined("headings"), _joined("doc_items"))


def contextualize_chunks(spark, sf):
    return c.contextualize(c.hierarchical_chunks(tq.web(spark, sf))).select("doc_id", "chunk_ix", "context")


def hybrid_merge(spark, sf):
    return c.merge_peers(c.hierarchical_chunks(tq.web(spark, sf)), 120).select("doc_id", "chunk_ix", F.sha1("text").alias("text_sha1"), _joined("headings"), F.size("doc_items").alias("n_items"))


def hybrid_chunks(spark, sf):
    """Web pages in chunks of at most 40 words, headings included."""
    k = c.hybrid_chunks(tq.web(spark, sf), 40)
    return k.select("doc_id", "chunk_ix", "text", F.size("doc_items").alias("n_items"))


def line_chunks(spark, sf):
    """Chunks of at most 60 words of whole lines: how many words each holds, and their digest."""
    k = c.line_chunks(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), 60)
    w = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    return k.select("doc_id", "chunk_ix", F.size(w).alias("n_words"), F.sha1(F.array_join(w, " ")).alias("words_sha1"))


def page_chunks(spark, sf):
    return c.page_chunks(tq.web(spark, sf)).select("doc_id", "page_no", "text", F.size("doc_items").alias("n_items"))


def expand_tree(spark, sf):
    n = tq.geo_paths(spark, sf)
    k = c.hierarchical_chunks(n)
    return c.expand_tree(k, n, chars=F.char_length("text"), text_sha1=F.sha1("text"))


def expand_page(spark, sf):
    n = tq.web(spark, sf)
    k = c.hierarchical_chunks(n)
    return c.expand_page(k, n)


def token_counts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", c.count_tokens(F.col("text")).cast("long").alias("n_tokens"))


def conversation_chunks(spark, sf):
    """Turns of a conversation merged up to 200 words, whatever their voices."""
    n = src.from_conversations(spark.read.parquet(f"{sf}/conversations.parquet")).withColumn("path", F.array("child_pos"))
    return c.merge_peers(c.hierarchical_chunks(n), 200).select("doc_id", "chunk_ix", F.sha1("text").alias("text_sha1"), F.size("doc_items").alias("n_items"))


def code_chunks(spark, sf):
    """Functions, classes and what is left of small programs made from the nations."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    name = F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    text = F.format_string("import os\nLIMIT = %d\n\n\ndef visit_%s(x):\n    \"\"\"Visit.\"\"\"\n    return os.path.join(x, str(LIMIT))\n\n\nclass Guide:\n    def __init__(self):\n        self.n = LIMIT\n\n    def go(self):\n        return visit_%s('a')\n", "n_nationkey", name, name)
    return code.code_chunks(n.select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"), F.lit("Python").alias("language")))


QUERIES = {f.__name__: f for f in (heading_scope, hierarchical_chunks, contextualize_chunks, hybrid_merge, hybrid_chunks, line_chunks, page_chunks, expand_tree, expand_page, token_counts, conversation_chunks, code_chunks)}

_HEAD = ", hd AS (SELECT s.*, CASE WHEN s.lvl = 0 THEN '' WHEN s.lvl = 1 THEN tt.text WHEN s.lvl = 2 THEN tt.text || '/' || (SELECT n.text FROM g n WHERE n.doc_id = s.doc_id AND n.ref = s.parent_ref) ELSE tt.text || '/' || nn.text || '/' || sg.text END headings FROM s JOIN g tt ON tt.doc_id = s.doc_id AND tt.lvl = 0 LEFT JOIN g sg ON sg.doc_id = s.doc_id AND sg.ref = s.parent_ref AND sg.lvl = 2 LEFT JOIN g nn ON nn.doc_id = sg.doc_id AND nn.ref = sg.parent_ref) "
_WEBC = ", tl AS (SELECT doc_id, min(seq) ts, first(text) t FROM w WHERE label = 'title' GROUP BY 1), ch AS (SELECT w.doc_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY seq) - 1 chunk_ix, ref, page_no, text, CASE WHEN seq > ts THEN t END h FROM w LEFT JOIN tl USING (doc_id) WHERE layer = 'body' AND label <> 'title') "
#: a greedy fold over chunks(doc, ix, n tokens, hn tokens of headings, h headings) as a recursive query
_FOLD = """, RECURSIVE_FOLD AS (SELECT doc_id, chunk_ix, n, 0::INT win FROM fc WHERE chunk_ix = 0 UNION ALL
 SELECT c.doc_id, c.chunk_ix, CASE WHEN c.same AND f.n + c.n + c.hn <= {limit} THEN f.n + c.n ELSE c.n END, CASE WHEN c.same AND f.n + c.n + c.hn <= {limit} THEN f.win ELSE f.win + 1 END FROM fc c JOIN RECURSIVE_FOLD f ON c.doc_id = f.doc_id AND c.chunk_ix = f.chunk_ix + 1) """
_N = r"len(regexp_extract_all({}, '\S+'))"


def _fold(base: str, limit: int) -> str:
    return base.replace("WITH ", "WITH RECURSIVE ", 1) + f", fc AS (SELECT *, {_N.format('text')} n, CASE WHEN h IS NULL THEN 0 ELSE {_N.format('h')} END hn, h IS NOT DISTINCT FROM lag(h) OVER (PARTITION BY doc_id ORDER BY chunk_ix) same FROM ch)" + _FOLD.format(limit=limit)


_CONV = "WITH ch AS (SELECT conv_id doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 chunk_ix, text, NULL::VARCHAR h FROM conversations WHERE text IS NOT NULL AND text <> '') "
ORACLE = {
    "heading_scope": tq.GEO + _HEAD + "SELECT doc_id, ref, headings FROM hd",
    "hierarchical_chunks": tq.GEO + _HEAD + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 chunk_ix, text, headings, ref doc_items FROM hd WHERE label = 'list_item'",
    "contextualize_chunks": tq.WEB + _WEBC + "SELECT doc_id, chunk_ix, CASE WHEN h IS NULL THEN text ELSE h || chr(10) || text END context FROM ch",
    "hybrid_merge": _fold(tq.WEB + _WEBC, 120) + "SELECT f.doc_id, f.win::BIGINT chunk_ix, sha1(string_agg(c.text, chr(10) ORDER BY f.chunk_ix)) text_sha1, coalesce(first(c.h), '') headings, count(*)::INT n_items FROM RECURSIVE_FOLD f JOIN fc c USING (doc_id, chunk_ix) GROUP BY 1, 2",
    "page_chunks": tq.WEB + "SELECT doc_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY child_pos) AS text, count(*)::INT n_items FROM w WHERE layer = 'body' GROUP BY 1, 2",
    "expand_tree": tq.GEO + ", ki AS (SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 chunk_ix FROM s WHERE label = 'list_item') SELECT k.doc_id, chunk_ix, sum(length(s.text) + 1)::INT chars, sha1(string_agg(s.text || chr(10), '' ORDER BY s.path)) text_sha1 FROM ki k JOIN s ON s.doc_id = k.doc_id AND s.path[1] = k.path[1] GROUP BY 1, 2",
    "expand_page": tq.WEB + _WEBC + "SELECT ch.doc_id, ch.chunk_ix, string_agg(w.text, chr(10) || chr(10) ORDER BY w.child_pos) AS text FROM ch JOIN w ON w.doc_id = ch.doc_id AND w.page_no = ch.page_no AND w.layer = 'body' GROUP BY 1, 2",
    "line_chunks": r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) i FROM documents),
 s AS (SELECT doc_id, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') w FROM l), b AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) - len(w) ls FROM s WHERE len(w) > 0),
 t AS (SELECT doc_id, CAST(ls + j AS BIGINT) p, w[j + 1] word, CAST(ls AS BIGINT) ls, CAST(ls + len(w) AS BIGINT) le FROM (SELECT *, unnest(range(0, len(w))) j FROM b)),
 n AS (SELECT doc_id, count(*) n, list(word ORDER BY p) words FROM t GROUP BY 1),
 nx AS (SELECT t.doc_id, t.p, least(t.p + 60, n.n) e, q.ls, q.le FROM t JOIN n USING (doc_id) LEFT JOIN t q ON q.doc_id = t.doc_id AND q.p = t.p + 60),
 nd AS (SELECT doc_id, p, CASE WHEN ls > p AND le - ls <= 60 THEN ls ELSE e END z FROM nx),
 r AS (SELECT doc_id, 0::BIGINT ix, 0::BIGINT p, z FROM nd WHERE p = 0 UNION ALL SELECT nd.doc_id, r.ix + 1, nd.p, nd.z FROM r JOIN nd ON nd.doc_id = r.doc_id AND nd.p = r.z)
 SELECT doc_id, ix chunk_ix, (z - p)::INT n_words, sha1(array_to_string(words[p + 1 : z], ' ')) words_sha1 FROM r JOIN n USING (doc_id)""",
    "token_counts": "SELECT doc_id, " + _N.format("text") + "::BIGINT n_tokens FROM documents",
    "conversation_chunks": _fold(_CONV, 200) + "SELECT f.doc_id, f.win::BIGINT chunk_ix, sha1(string_agg(c.text, chr(10) ORDER BY f.chunk_ix)) text_sha1, count(*)::INT n_items FROM RECURSIVE_FOLD f JOIN fc c USING (doc_id, chunk_ix) GROUP BY 1, 2",
}
