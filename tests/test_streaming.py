from quire.streaming import profile

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    batch = spark.read.parquet(f"{SF}/documents.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{SF}/documents.parquet*")
    q = profile.line_counts(stream).writeStream.outputMode("complete").format("memory").queryName("lines_by_lang").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("lines_by_lang").collect()}
    assert got == {tuple(r) for r in profile.line_counts(batch).collect()} and got
