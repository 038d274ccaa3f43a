"""Labels of several shards, one large group of near copies, and the recall that is measured."""

import numpy as np

from quire.llm import embeddings


def test_bits_hold_the_links():
    r = np.random.default_rng(1)
    m = r.random((50, 37)) < 0.02
    links = embeddings.Links(50, 37)
    links.add(*np.nonzero(m))
    links.add(*np.nonzero(m))
    w = r.integers(1, 9, 37)
    assert (links.weights(0, w) == m @ w).all() and (links.weights(1, np.ones(50, int)) == m.sum(0)).all()
    seen = np.zeros_like(m)
    for rows, cols in links.trees():
        assert len(set(rows)) == len(rows) and len(set(cols)) == len(cols)
        assert m[rows].sum() == m[np.ix_(rows, cols)].sum() == m[:, cols].sum()
        seen[np.ix_(rows, cols)] = True
    assert (seen | ~m).all()


def test_a_label_of_20000_vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(20_000, 16)).astype(np.float32)
    x[:3000] = x[0] + 0.02 * r.normal(size=(3000, 16))  # one large group of near copies
    x[5001:9001:2] = x[5000:9000:2] + 0.05 * r.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df, 0.93, rows_per_shard=5000)
    found, links = embeddings.measured_recall(df, got, queries=400)
    rows = {r["vec_id"]: r for r in got.collect()}
    assert links > 100_000 and found >= 0.98 * links
    assert sum(rows[i]["component_id"] == 0 for i in range(3000)) >= 2990
    u = embeddings.unit(x.astype(float))
    for i in [0, 17, 2999, 5000, 5001, 8999, 12_345]:
        assert rows[i]["n_links"] <= int((u @ u[i] >= 0.93).sum()) - 1
    assert sum(rows[i]["component_id"] <= 5000 + 2 * ((i - 5000) // 2) for i in range(5001, 9001, 2)) >= 1950
