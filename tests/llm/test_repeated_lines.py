"""Line dedup with long lines as runs of their own, against a plain version."""

import corpus_pipeline
from quire.llm import linededup

from .test_text_operators import rows, sha, texts

LINE = "this license line of the notice has more than eight words"
TWO = "a pair of\nlines holds eight words too"


def brute(t, least, k=3):
    lines = {i: x.split("\n") if x else [] for i, x in t.items()}
    size = lambda x: max(len(x.encode().split()), len(x.encode()) // 8)

    def windows(x):
        for w in range(1, min(k, len(x)) + 1):
            for j in range(len(x) - w + 1):
                if w == k or w == len(x) or sum(map(size, x[j : j + w])) >= least:
                    yield j, w, tuple(x[j : j + w])

    first, gone = {}, {}
    for i in sorted(lines):
        for j, _, g in windows(lines[i]):
            first[g] = min(first.get(g, (i, j)), (i, j))
    for i, x in lines.items():
        gone[i] = {m for j, w, g in windows(x) if first[g] != (i, j) for m in range(j, j + w)}
    return {i: (len(x), len(gone[i]), sha("\n".join(y for m, y in enumerate(x) if m not in gone[i]))) for i, x in lines.items()}


def test_long_lines_and_pairs(spark, docs):
    t = texts(docs)
    more = [f"start {i}\n{LINE}\nend {i}" if i % 2 else f"{i}\n{TWO}\n\nlast {i}" for i in range(6)] + [LINE, TWO, f"x\n{LINE}\ny\n{LINE}", "x\nshort\ny", "z\nshort\nw", "漢" * 40 + "\na", "b\n" + "漢" * 40]
    t |= {1000 + i: x for i, x in enumerate(more)}
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(6)
    got = {i: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for i, r in rows(linededup.digest(linededup.find(df, least=8))).items()}
    assert got == brute(t, 8)
    assert got[1003][1] == 1 and got[1002][1] >= 2


def test_the_pipeline_drops_repeated_long_lines(spark):
    df = spark.createDataFrame([(1, f"a\n{LINE}\nb"), (2, f"c\n{LINE}\nd"), (3, LINE)], "doc_id long, text string")
    got = {i: r["text"] for i, r in rows(dict(corpus_pipeline.STAGES)["line_dedup"](spark, df, "")).items()}
    assert got == {1: f"a\n{LINE}\nb", 2: "c\nd"}
