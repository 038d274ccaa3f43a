"""Headings of any level open and close each other."""

from quire.operators import chunk, tree

SCHEMA = "doc_id long, ref string, parent_ref string, child_pos int, kind string, label string, heading_level int, layer string, text string, path array<int>"


def nodes(spark):
    levels = [1, 7, 8, None, 12, None, 8, None, 7, None]
    rows = [(1, f"#/texts/{i}", tree.BODY, i, "texts", "text" if k is None else "section_header", k, "body", f"t{i}", [i]) for i, k in enumerate(levels)]
    return spark.createDataFrame(rows, SCHEMA)


def test_hierarchize(spark):
    got = {r["ref"][8:]: r["parent_ref"][8:] for r in tree.hierarchize(nodes(spark)).collect() if r["parent_ref"] != tree.BODY}
    assert got == {"1": "0", "2": "1", "3": "2", "4": "2", "5": "4", "6": "1", "7": "6", "8": "0", "9": "8"}


def test_heading_scope(spark):
    got = {r["text"]: r["headings"] for r in chunk.hierarchical_chunks(nodes(spark)).collect()}
    assert got == {"t3": ["t0", "t1", "t2"], "t5": ["t0", "t1", "t2", "t4"], "t7": ["t0", "t1", "t6"], "t9": ["t0", "t8"]}


def test_no_headings(spark):
    n = nodes(spark).filter("label = 'text'")
    assert {tuple(r["headings"]) for r in chunk.heading_scope(n).collect()} == {()}
    assert {r["parent_ref"] for r in tree.hierarchize(n).collect()} == {tree.BODY}
