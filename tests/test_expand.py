"""Chunks of one ancestor share its text: it isn't dealt out once a chunk."""

import hashlib
import time

from pyspark.sql import functions as F

from quire import queries
from quire.operators import chunk


def written(spark):
    """Bytes of shuffles so far; a job a while later makes Spark take stock."""
    time.sleep(0.3)
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    e = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(e.apply(i).totalShuffleWrite() for i in range(e.size()))


def test_a_text_is_shuffled_once(spark, tmp_path):
    name = lambda i: "".join(hashlib.sha512(f"{i} {j}".encode()).hexdigest() for j in range(8))
    n = 300
    spark.createDataFrame([(0, "EUROPE")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(0, "NATION", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, name(i), 0, "MACHINERY") for i in range(n)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    before = written(spark)
    rows = queries.queries()["expand_tree"](spark, str(tmp_path)).collect()
    text = "".join(x + "\n" for x in ["NATION", "MACHINERY", *map(name, range(n))])
    assert {tuple(r) for r in rows} == {(0, i, len(text), hashlib.sha1(text.encode()).hexdigest()) for i in range(n)}
    # the chunkers deal the texts out a few times; a text a chunk would be 300 times as much
    assert written(spark) - before < 20 * len(text)


def test_chunks_below_several_ancestors(spark):
    nodes = spark.createDataFrame([(1, "a", [0], "A"), (1, "a1", [0, 0], "B"), (1, "b", [1], None), (1, "c", [2], "C"), (1, "d", [3], ""), (2, "a", [0], "Z")], "doc_id long, ref string, path array<int>, text string")
    chunks = spark.createDataFrame([(1, 0, ["a1"]), (1, 1, ["c", "a", "a1"]), (1, 2, ["b", "c"]), (1, 3, ["a"]), (1, 4, ["b", "d"]), (2, 0, ["a", "x"])], "doc_id long, chunk_ix long, doc_items array<string>")
    want = {(1, 0, "A\nB\n"), (1, 1, "A\nB\nC\n"), (1, 2, "C\n"), (1, 3, "A\nB\n"), (2, 0, "Z\n")}
    assert {tuple(r) for r in chunk.expand_tree(chunks, nodes).select("doc_id", "chunk_ix", "text").collect()} == want
    assert {tuple(r) for r in chunk.expand_tree(chunks, nodes, n=F.length("text")).collect()} == {(d, k, len(t)) for d, k, t in want}
