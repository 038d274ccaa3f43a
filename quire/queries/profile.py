"""Profiles of documents made of text lines and of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as p
from ..sources import tables as src


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stats(spark, sf):
    """Documents by line; a page holds 3000 characters (n_chars says how many there are)."""
    docs = _read(spark, sf, "documents")
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.ceil(F.greatest(F.col("n_chars"), F.lit(1)) / 3000).cast("int"))).alias("page_no"))
    return p.profile_documents(src.from_lines(docs), pages, docs.select("doc_id", F.col("source").alias("name"), F.concat(F.lit("text/"), F.col("lang")).alias("mimetype")))


def profile_documents(spark, sf):
    return _stats(spark, sf).select("doc_id", "name", "mimetype", "num_pages", "num_texts", "num_tables", "total_items", F.round("avg_items_per_page", 6).alias("avg_items_per_page"))


def profile_collection(spark, sf):
    c = p.profile_collection(_stats(spark, sf))
    r = lambda n: F.round(n, 6).alias(n)
    return c.select("num_documents", "total_pages", "min_pages", "max_pages", r("mean_pages"), r("std_pages"), "total_texts", "min_texts", "max_texts", r("mean_texts"), r("std_texts"), "total_items", r("avg_items_per_document"), r("avg_items_per_page"))


def profile_deciles(spark, sf):
    c = p.profile_collection(_stats(spark, sf)).select(F.explode(F.array(F.struct(F.lit("pages").alias("what"), F.col("deciles_pages").alias("d")), F.struct(F.lit("texts").alias("what"), F.col("deciles_texts").alias("d")))).alias("x"))
    return c.select("x.what", F.posexplode("x.d").alias("i", "value")).select("what", (F.col("i") + 1).alias("decile"), F.round("value", 6).alias("value"))


def profile_histogram(spark, sf):
    h = p.histogram(_stats(spark, sf), "num_texts", 10)
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "frequency")


def mimetype_distribution(spark, sf):
    return p.mimetype_distribution(_stats(spark, sf))


QUERIES = {f.__name__: f for f in (profile_documents, profile_collection, profile_deciles, profile_histogram, mimetype_distribution)}

STATS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents), n AS (SELECT doc_id, count(*) num_texts FROM l WHERE trim(line, ' ') <> '' GROUP BY 1),
d AS (SELECT doc_id, source name, 'text/' || lang mimetype, CAST(ceil(greatest(n_chars, 1)/3000.0) AS BIGINT) num_pages, coalesce(num_texts, 0) num_texts FROM documents LEFT JOIN n USING (doc_id)) """
ORACLE = {
    "profile_documents": STATS + "SELECT doc_id, name, mimetype, num_pages, num_texts, 0::BIGINT num_tables, num_texts total_items, round(num_texts/num_pages::DOUBLE, 6) avg_items_per_page FROM d",
    "profile_collection": STATS + """SELECT count(*) num_documents, CAST(sum(num_pages) AS BIGINT) total_pages, min(num_pages) min_pages, max(num_pages) max_pages, round(avg(num_pages), 6) mean_pages, round(stddev_samp(num_pages), 6) std_pages,
 CAST(sum(num_texts) AS BIGINT) total_texts, min(num_texts) min_texts, max(num_texts) max_texts, round(avg(num_texts), 6) mean_texts, round(stddev_samp(num_texts), 6) std_texts,
 CAST(sum(num_texts) AS BIGINT) total_items, round(sum(num_texts)/count(*)::DOUBLE, 6) avg_items_per_document, round(sum(num_texts)/sum(num_pages)::DOUBLE, 6) avg_items_per_page FROM d""",
    "profile_deciles": STATS + """, q AS (SELECT 'pages' what, quantile_cont(num_pages, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) v FROM d UNION ALL SELECT 'texts', quantile_cont(num_texts, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FROM d)
 SELECT what, CAST(i AS INT) decile, round(v[i], 6) AS value FROM q, range(1, 10) t(i)""",
    "profile_histogram": STATS + """, r AS (SELECT CASE WHEN min(num_texts)=max(num_texts) THEN min(num_texts)-0.5::DOUBLE ELSE min(num_texts)::DOUBLE END lo, CASE WHEN min(num_texts)=max(num_texts) THEN max(num_texts)+0.5::DOUBLE ELSE max(num_texts)::DOUBLE END hi FROM d),
 b AS (SELECT CAST(least(floor((num_texts-lo)/(hi-lo)*10), 9) AS INT) bin, count(*) n FROM d, r GROUP BY 1)
 SELECT CAST(i AS INT) bin, round(lo+(hi-lo)/10*i, 6) low, round(lo+(hi-lo)/10*(i+1), 6) high, coalesce(n, 0) frequency FROM r, range(0, 10) t(i) LEFT JOIN b ON b.bin = i""",
    "mimetype_distribution": STATS + "SELECT mimetype, count(*) num FROM d WHERE mimetype IS NOT NULL GROUP BY 1",
}
