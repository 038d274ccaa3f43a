"""Embedding near-dedup against full comparison, chats against their definition, the pipeline stage by stage."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chat, embeddings
from quire.llm.common import components

from .test_text_operators import brute_jaccard, rows


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(data, threshold=0.93):
    good = {}
    for i, v, label in data:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            x = np.asarray(v, float)
            good[i] = (label, x / np.linalg.norm(x))
    n, up = {i: 0 for i, *_ in data}, {i: i for i, *_ in data}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (n[i], find(i), find(i) == i) for i in up}


def vectors(n, seed=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 8, 16))
    out = []
    for i in range(n):
        v = centres[i % len(centres)] + r.normal(size=16) * (0.02 if i % 3 else 0.5)
        out.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    for i in range(0, 40, 4):
        out.append((n + i, out[i][1], out[i][2]))  # exact copies
    nan = float("nan")
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [nan] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    return [*out, *((5000 + k, v, 0) for k, v in enumerate(bad)), (6000, out[0][1], None)]


def test_embeddings(spark):
    data = vectors(600)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in data])
    for shard in (16_384, 100):  # one shard a label, and several
        got = {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in rows(embeddings.near_duplicates(df, 0.93, rows_per_shard=shard), "vec_id").items()}
        assert set(got) == set(want)
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values()) > 0
        assert sum(got[i][1] != want[i][1] for i in want) <= 0.02 * len(want)
        assert all(got[i] == (0, i, True) for i in [*range(5000, 5006), 6000])


def test_graph_finds_neighbours():
    r = np.random.default_rng(0)
    x = embeddings.unit(r.normal(size=(1500, 24)))
    ids = np.arange(1500)
    levels = embeddings.Graph.levels(ids, 8)
    order = np.lexsort((ids, -levels))
    x = x[order]
    g = embeddings.Graph.build(x.astype(np.float32), levels[order])
    assert len(g.links) > 1
    near, _ = g.search(x[:200].astype(np.float32), 64)
    true = np.argsort(-(x[:200] @ x.T), 1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(near.tolist(), true.tolist(), strict=True)]) > 0.9


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


HARD = [
    "plain", "", None, "### Assistant: x", "\\### User: </turn>", "\\\\### User: ", "</turn>", "a\n</turn>\nb", "\n</turn>\n### User: hi\n</turn>\n", "ends with \\", "###", "### ", "\\", "\\\\</turn>\\", "\n", "日本 🙂",
]
ROLES = ["user", "assistant", "system", "tool", "User", "a: b#\\c\n", "", None, "=x", "Assistant"]


def test_chats(spark):
    r = random.Random(1)
    data = [(c % 5 if c else None, t, r.choice(ROLES), r.choice(HARD)) for c in range(40) for t in (0, 1, 1, None)]
    data += [(9, 0, "user", HARD[k]) for k in range(len(HARD))] + [(10, 1, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.format_chats(df)
    got = rows(chat.digest(made), "conv_id")
    by = {}
    for c, t, role, text in data:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(said), sha(said))
    for x in made.collect():
        assert len(x["formatted"]) == got[x["conv_id"]]["formatted_chars"]


def test_chats_use_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = chat.digest(chat.format_chats(df.filter("conv_id = 2")))
    assert empty.count() == 0


SF = "/root/testdata/sf0.001"


def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    f = dict(corpus_pipeline.STAGES)
    kept = f["quality_classifier"](spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    lines = f["line_dedup"](spark, kept, SF)
    assert lines.columns == docs.columns
    t = {r["doc_id"]: r["text"] for r in lines.collect()}
    one = f["ngram_jaccard_join"](spark, lines, SF)
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in brute_jaccard(t).items() if c == i}
    clean = f["benchmark_decontamination"](spark, one, SF)
    assert clean.columns == docs.columns
    ids = {r["doc_id"] for r in clean.collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.collect()} == ids
