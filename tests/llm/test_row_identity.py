"""Rows that share an id but not a text, columns of clashing names, equal rows, ties."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, linededup, quality, substring

T = " ".join(f"q{i}" for i in range(40))
U = " ".join(f"u{i}" for i in range(40))
CLASH = ("q_key", "q_id", "q_words", "q_n_words", "q_spans", "q_items", "q_gone", "__in_0", "who", "block")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.concat(F.lit(c), F.lit("!")))
    return df


def test_rows_of_one_id_keep_their_own_text(spark):
    df = frame(spark, [(1, T), (5, T), (5, U), (None, None), (7, "")])
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(substring.find(df)).collect()}
    assert got == {(1, 40, 0, sha(T)), (5, 40, 40, sha("")), (5, 40, 0, sha(U)), (None, 0, 0, sha("")), (7, 0, 0, sha(""))}
    lines = frame(spark, [(1, T.replace(" ", "\n")), (5, T.replace(" ", "\n")), (5, U.replace(" ", "\n"))])
    assert sorted((r["doc_id"], r["n_removed"]) for r in linededup.digest(linededup.find(lines)).collect()) == [(1, 0), (5, 0), (5, 40)]


def test_lines_of_rows_that_share_an_id_go_once(spark):
    block = "\n".join(f"line number {i}" for i in range(5))
    df = frame(spark, [(3, "top of one\n" + block), (3, block + "\nend of other")])
    assert sorted(r["n_removed"] for r in linededup.digest(linededup.find(df)).collect()) == [0, 5]
    same = frame(spark, [(3, block), (3, block), (2, "x")])
    assert [r["n_removed"] for r in linededup.digest(linededup.find(same)).collect()] == [0, 0, 0]


def test_shared_ids_have_the_links_of_all_their_rows(spark):
    df = frame(spark, [(1, T), (5, T), (5, U), (9, U), (None, "z"), (None, None)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {1: (36, 1), 5: (36, 1), 9: (36, 1), None: (1, None)}
    kept = jaccard.dedup(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None", "None"]


@pytest.mark.parametrize("name", ["substring", "lines", "jaccard", "decontaminate", "quality"])
def test_columns_of_clashing_names_stay(spark, name):
    df = frame(spark, [(1, T), (2, U), (3, T + " more"), (4, None)])
    bench = spark.createDataFrame([(1, U)], "item_id long, text string").withColumn("q_words", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int").withColumn("text", F.lit("no"))
    run = {
        "substring": lambda: substring.dedup(df), "lines": lambda: linededup.dedup(df), "jaccard": lambda: jaccard.dedup(df),
        "decontaminate": lambda: decontam.drop_contaminated(df, bench), "quality": lambda: quality.keep_good(df, labels, 0.0),
    }
    out = run[name]()
    rows = out.collect()
    assert out.columns == df.columns and rows
    assert all(r[c] == c + "!" for r in rows for c in CLASH)
    if name == "decontaminate":
        assert {r["doc_id"] for r in rows} == {1, 3, 4}
