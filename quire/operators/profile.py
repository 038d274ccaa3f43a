"""Document and collection statistics: one aggregation a document, one over documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("pages", "tables", "pictures", "texts")
OTHERS = ("key_value_items", "form_items", "section_headers", "list_items", "code_items", "formulas", "pictures_for_ocr")
_KINDS = {"tables": "tables", "pictures": "pictures", "texts": "texts", "key_value_items": "key_value_items", "form_items": "form_items"}
_LABELS = {"section_headers": "section_header", "list_items": "list_item", "code_items": "code", "formulas": "formula"}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def profile_documents(nodes: DataFrame, pages: DataFrame, documents: DataFrame, prov: DataFrame | None = None, coverage: float = 0.05) -> DataFrame:
    """A row a document of ``documents`` (doc_id, name, mimetype): counts by array and label, pictures that need OCR.

    A picture needs OCR if its first place covers at least ``coverage`` of a page that exists and has an area."""
    counts = nodes.groupBy("doc_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"num_{n}") for n, k in _KINDS.items()],
        *[F.count_if((F.col("kind") == "texts") & (F.col("label") == v)).alias(f"num_{n}") for n, v in _LABELS.items()],
    )
    out = documents.select("doc_id", "name", "mimetype").join(pages.groupBy("doc_id").agg(F.count("*").alias("num_pages")), "doc_id", "left").join(counts, "doc_id", "left")
    if prov is not None:
        first = prov.filter("prov_ix = 0").join(nodes.filter("kind = 'pictures'").select("doc_id", "ref"), ["doc_id", "ref"], "left_semi").join(pages, ["doc_id", "page_no"])
        b, whole = F.col("bbox"), F.col("width") * F.col("height")
        big = (whole > 0) & ((b["r"] - b["l"]) * F.abs(b["t"] - b["b"]) / whole >= coverage)
        out = out.join(first.groupBy("doc_id").agg(F.count_if(big).alias("num_pictures_for_ocr")), "doc_id", "left")
    else:
        out = out.withColumn("num_pictures_for_ocr", F.lit(0).cast("long"))
    names = [f"num_{n}" for n in (*COUNTS, *OTHERS)]
    out = out.select("doc_id", "name", "mimetype", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    total = reduce(lambda a, b: a + b, [F.col(f"num_{n}") for n in _KINDS])
    return out.withColumn("total_items", total).withColumn("avg_items_per_page", ratio(F.col("total_items"), F.col("num_pages")))


def histogram_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of ``x`` among equal ones, the last of which is closed; equal data has the range of half a unit around."""
    low, high = F.when(low == high, low - F.lit(0.5)).otherwise(low), F.when(low == high, high + F.lit(0.5)).otherwise(high)
    return F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, frequency) with a row for every bin; none for no values. Counted per distinct value first."""
    v = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    r = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo is not null")
    counted = v.join(F.broadcast(r)).groupBy(histogram_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.sum("n").alias("n"))  # r is one row
    lo, hi = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    dense = r.select(lo.alias("lo"), ((hi - lo) / bins).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("w") * F.col("bin")).alias("low"), (F.col("lo") + F.col("w") * (F.col("bin") + 1)).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("frequency"))


def deciles(column: str) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(F.col(column), F.array(*[F.lit(round(i / 10, 1)) for i in range(1, 10)]))


def profile_collection(stats: DataFrame) -> DataFrame:
    """One row over the rows of ``profile_documents``: totals, extremes, mean, sample deviation and deciles."""
    aggs = [F.count("*").alias("num_documents")]
    for n in COUNTS:
        c = F.col(f"num_{n}")
        z = lambda x: F.coalesce(x, F.lit(0))
        aggs += [z(F.sum(c)).alias(f"total_{n}"), z(F.min(c)).alias(f"min_{n}"), z(F.max(c)).alias(f"max_{n}"), F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{n}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std_{n}"), F.coalesce(deciles(f"num_{n}"), F.array_repeat(F.lit(0.0), 9)).alias(f"deciles_{n}")]
    aggs += [F.coalesce(F.sum(f"num_{n}"), F.lit(0)).alias(f"total_{n}") for n in OTHERS]
    out = stats.agg(*aggs)
    items = reduce(lambda a, b: a + b, [F.col(f"total_{n}") for n in _KINDS])
    out = out.withColumn("total_items", items)
    return out.withColumn("avg_items_per_document", ratio(F.col("total_items"), F.col("num_documents"))).withColumn("avg_items_per_page", ratio(F.col("total_items"), F.col("total_pages")))


def mimetype_distribution(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("mimetype").isNotNull()).groupBy("mimetype").agg(F.count("*").alias("num"))
