"""A training corpus from raw documents: rejected, repeated, near-duplicate and contaminated text goes, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents, whatever other columns those have.

In every stage a null text counts as empty and a null doc_id is an id like any other; ties go to the smaller id; equal rows
share one fate; an empty table gives an empty one; texts are read whole, however long. Each operator's docstring has the
details. A stage's table is deleted once the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, jaccard, linededup, packing, quality
from quire.llm.common import discard, materialize
from quire.llm.queries import table, tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of three lines, and fewer lines of eight words together, that occur earlier go, and documents of which nothing
    else is left."""
    return linededup.dedup(docs, least=linededup.LEAST)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at 0.8 the one of the smallest id stays."""
    return jaccard.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or all of a shorter one, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path(), 1024)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier or the tokenizer; tests hold run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = materialize(stage(spark, docs, sf_dir))
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
