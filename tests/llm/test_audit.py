"""The audit of the graph search: it is never empty, and self matches are no links."""

import numpy as np
from pyspark.sql import functions as F

from quire.llm import embeddings

from .test_vectors_and_chats import brute, rows


def broken(x):
    """A graph without links: its search finds the entry only."""
    return embeddings.Graph(x.astype(np.float32), [np.full((len(x), 16), -1, np.int32)])


def test_few_links_between_shards_are_found():
    r = np.random.default_rng(3)
    x, q = embeddings.unit(r.normal(size=(2000, 24))), embeddings.unit(r.normal(size=(2000, 24)))
    q[[7, 901]] = x[[1500, 12]]
    i, j = embeddings.query(q, broken(x), x, 0.93, 0.98)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(7, 1500), (901, 12)}


def test_self_matches_do_not_count():
    r = np.random.default_rng(4)
    x = embeddings.unit(r.normal(size=(2000, 24)))
    x[1::2] = embeddings.unit(x[::2] + 0.001 * r.normal(size=(1000, 24)))
    order = np.argsort(-embeddings.Graph.levels(np.arange(2000), 8), kind="stable")
    x = x[order]

    class SelfOnly:
        """A search that knows each row as itself only."""

        def search(self, q, beam, batch=256):
            s = q @ x.T.astype(np.float32)
            self_at = s.argmax(1)
            near = np.zeros((len(q), beam), np.int64)
            sim = np.full((len(q), beam), -np.inf, np.float32)
            near[:, 0], sim[:, 0] = self_at, s.max(1)
            return near, sim

    i, j = embeddings.query(x, SelfOnly(), x, 0.93, 0.4, same=True)
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == 4000


def test_recall_on_a_label_of_several_shards(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1600, 24))
    x[1::40] = x[::40] + 0.01 * r.normal(size=(40, 24))  # few links, most of them between shards
    data = [(i, [float(np.float32(a)) for a in v], 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit(1))
    want = brute(data)
    got = {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in rows(embeddings.near_duplicates(df, 0.93, rows_per_shard=400), "vec_id").items()}
    assert sum(w[0] for w in want.values()) >= 80 and got == want
