"""Single functions and operators on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as tx
from quire.operators import chunk, code, graph, tables, tree
from quire.plans import render
from quire.sources import documents, markup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def box(l, t, r, b, o=g.TOP):  # noqa: E741
    return g.box(F.lit(float(l)), F.lit(float(t)), F.lit(float(r)), F.lit(float(b)), o)


def test_origins_must_agree(spark):
    a, b = box(0, 0, 10, 10), box(0, 10, 10, 0, g.BOTTOM)
    with pytest.raises(Exception, match="origins"):
        one(spark, g.iou(a, b))
    assert one(spark, g.iou(a, b, strict=False)) is None
    assert one(spark, g.to_top_left(b, F.lit(20.0)))["t"] == 10.0


@pytest.mark.parametrize("corners, angle", [(((0, 0), (2, 0), (2, 1), (0, 1)), 0), (((0, 0), (0, 2), (-1, 2), (-1, 0)), 90), (((2, 0), (0, 0), (0, -1), (2, -1)), 180), (((0, 0), (1, 1), (0, 2), (-1, 1)), 45)])
def test_angles(spark, corners, angle):
    r = g.rect([F.lit(float(x)) for x, _ in corners], [F.lit(float(y)) for _, y in corners], g.BOTTOM)
    assert one(spark, g.rect_angle_360(r)) == angle


def test_half_even_locations(spark):
    assert one(spark, g.location_tokens(box(0.5, 1.5, 2.5, 600), F.lit(500.0), F.lit(500.0))) == "<loc_0><loc_2><loc_2><loc_499>"


def test_text_functions(spark):
    assert one(spark, tx.escape_underscores(F.lit(r"a_b \_c ![x_y](u_v.png) d_e"))) == r"a\_b \_c ![x_y](u_v.png) d\_e"
    assert one(spark, tx.format_timestamp(F.lit(59.9996))) == "00:01:00.000"
    assert one(spark, tx.parse_timestamp(F.lit("01:02.500"))) == 62.5
    assert one(spark, tx.parse_timestamp(F.lit("1:2"))) is None
    assert one(spark, tx.humanize(F.lit("some__name_of"))) == "Some name of"
    assert one(spark, tx.accepts_version(F.lit("1.9.3"), "1.10.0")) and not one(spark, tx.accepts_version(F.lit("1.11.0"), "1.10.0"))
    assert one(spark, tx.locations(F.lit("<loc_5><loc_10><loc_250><loc_500>t"))) == [0.01, 0.02, 0.5, 1.0]
    assert one(spark, tx.is_rtl(F.lit("שלום world"))) and not one(spark, tx.is_rtl(F.lit("hello")))


def test_line_packer_keeps_text_and_limits():
    r = random.Random(4)
    for _ in range(60):
        lines = [" ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 30))) + "\n" for _ in range(r.randint(1, 12))]
        out = chunk.pack_lines("".join(lines), 10)
        assert "".join(out).replace("\n", "").replace(" ", "") == "".join(lines).replace("\n", "").replace(" ", "")
        assert all(len(c.split()) <= 10 for c in out)
    assert chunk.pack_lines("a b\nc d\n", 5, "p q\n") == ["p q\na b\n", "p q\nc d\n"]
    assert chunk.pack_lines("a b c\n", 3, "p q\n", omit_prefix=True) == ["p q\n", "a b c\n"]
    assert chunk.pack_lines("a b\n", 2, "p q r") == ["p q", " r", "a b\n"]


def test_split_text_keeps_words_and_limits():
    r = random.Random(6)
    for _ in range(40):
        text = "".join("v" * r.randint(1, 6) + r.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(r.randint(1, 80)))
        parts = chunk.split_text(text, 7)
        assert all(0 < len(p.split()) <= 7 for p in parts)
        assert " ".join(parts).split() == text.split()
    assert chunk.split_text("", 5) == [] and chunk.split_text("a b", 5) == ["a b"]


def test_oversize_tables_repeat_their_header(spark):
    t = "| a | b |\n|---|---|\n" + "".join(f"| {i} | x |\n" for i in range(6))
    c = spark.createDataFrame([(1, 0, t, ["H"], ["#/tables/0"])], "doc_id long, chunk_ix long, text string, headings array<string>, doc_items array<string>")
    out = chunk.split_oversize(c, 17).orderBy("chunk_ix").collect()
    assert len(out) == 3 and all(r["text"].startswith("| a | b |\n|---|---|\n") for r in out)


def test_code_chunks():
    py = "import a\n\n@d\ndef f(x):\n    return x\n\nclass C:\n    v = 1\n"
    assert [(k, n) for k, n, *_ in code.chunks_of(py, "Python")] == [("preamble", ""), ("function", "f"), ("class", "C")]
    java = 'package p;\nclass A {\n  int x = 0; // }\n  String s = "{";\n  void go(int y) throws E {\n    if (y > 0) { x = y; }\n  }\n}\n'
    assert ("method", "A.go") in [(k, n) for k, n, *_ in code.chunks_of(java, "Java")]
    assert code.chunks_of("def (", "Python")[0][0] == "code_block"
    assert code.chunks_of("", "Python") == []


def test_doctags_without_closing_tags(spark):
    d = spark.createDataFrame([(1, "<doctag><title>A</title>\n<text><loc_1><loc_2><loc_3><loc_4>x <b>y</b><page_break><code><_Python_>a < b</code></doctag>")], "doc_id long, text string")
    got = [(r["label"], r["page_no"], r["text"], r["code_language"]) for r in markup.parse_doctags(d).orderBy("pos").collect()]
    assert got == [("title", 1, "A", None), ("text", 1, "x y", None), ("code", 2, "a < b", "Python")]


def test_vtt(spark):
    text = "WEBVTT\n\nNOTE x\n\nid1\n00:01.000 --> 00:02.000 align:start\n<v Ann>hi</v><v Bob>ho\n\n00:03.000 --> 01:00:04.000\nplain"
    got = [(r["identifier"], r["start_time"], r["voice"], r["text"]) for r in markup.parse_vtt(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("cue_ix", "span_ix").collect()]
    assert got == [("id1", 1.0, "Ann", "hi"), ("id1", 1.0, "Bob", "ho"), (None, 3.0, None, "plain")]


def test_rings_and_depth(spark):
    n = spark.createDataFrame([(1, "a", "#/body", 0), (1, "b", "a", 0), (1, "c", "b", 0), (2, "x", "y", 0), (2, "y", "x", 0)], "doc_id long, ref string, parent_ref string, child_pos int")
    assert {r["ref"]: r["path"] for r in tree.with_paths(n).collect()} == {"a": [0], "b": [0, 0], "c": [0, 0, 0]}
    with pytest.raises(ValueError, match="deeper"):
        tree.with_paths(n, max_depth=2)


def test_span_overlap_last_cell_wins(spark):
    c = spark.createDataFrame([(1, "t", 0, 0, 2, 0, 2, "big"), (1, "t", 1, 1, 2, 1, 2, "late")], "doc_id long, ref string, cell_ix int, r0 int, r1 int, c0 int, c1 int, text string")
    assert {(r["r"], r["c"]): r["text"] for r in tables.grid(c).collect()} == {(0, 0): "big", (0, 1): "big", (1, 0): "big", (1, 1): "late"}
    otsl = tables.rows_of(c).select("doc_id", "ref", tables.to_otsl(F.col("rows")).alias("otsl")).first()["otsl"]
    assert otsl == "<fcel>big<xcel><nl><xcel><fcel>late<nl>" or otsl.startswith("<fcel>big")


def test_best_prediction_and_unique_boxes(spark):
    p = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).cast("double").alias("confidence")) for n, c in (("a", None), ("b", 0.5), ("c", 0.5))])
    assert one(spark, graph.best_prediction(p))["name"] == "b"
    xs = F.array(box(0, 0, 10, 10), box(0, 0, 10, 9.9), box(20, 0, 30, 10))
    assert len(one(spark, graph.unique_boxes(xs))) == 2


DOC = {
    "schema_name": "Document", "version": "1.4.0", "name": "d", "origin": {"mimetype": "application/pdf", "binary_hash": 18446744073709551615, "filename": "d.pdf"},
    "body": {"self_ref": "#/body", "children": [{"$ref": "#/texts/1"}, {"$ref": "#/groups/0"}, {"$ref": "#/tables/0"}], "content_layer": "body", "label": "unspecified"},
    "groups": [{"self_ref": "#/groups/0", "parent": {"$ref": "#/body"}, "children": [{"$ref": "#/texts/0"}], "label": "list", "content_layer": "body"}],
    "texts": [
        {"self_ref": "#/texts/0", "parent": {"$ref": "#/groups/0"}, "children": [], "label": "list_item", "text": "an_item", "orig": "an_item", "marker": "-", "enumerated": False, "content_layer": "body", "prov": [{"page_no": 2, "bbox": {"l": 1, "t": 2, "r": 3, "b": 4, "coord_origin": "TOPLEFT"}, "charspan": [0, 4]}]},
        {"self_ref": "#/texts/1", "parent": {"$ref": "#/body"}, "children": [], "label": "section_header", "level": 1, "text": "Head & tail", "orig": "", "content_layer": "body", "formatting": {"bold": True, "italic": False, "underline": False, "strikethrough": False, "script": "baseline"}},
        {"self_ref": "#/texts/2", "parent": {"$ref": "#/tables/0"}, "children": [], "label": "caption", "text": "Cap", "orig": "Cap", "content_layer": "body"},
    ],
    "tables": [{"self_ref": "#/tables/0", "parent": {"$ref": "#/body"}, "children": [{"$ref": "#/texts/2"}], "label": "table", "content_layer": "body", "captions": [{"$ref": "#/texts/2"}], "data": {"num_rows": 1, "num_cols": 1, "table_cells": [{"start_row_offset_idx": 0, "end_row_offset_idx": 1, "start_col_offset_idx": 0, "end_col_offset_idx": 1, "row_span": 1, "col_span": 1, "text": "x"}]}}],
    "pages": {"2": {"page_no": 2, "size": {"width": 100.0, "height": 50.0}}},
}


def test_document_json_yaml_and_archive(spark, tmp_path):
    import json
    import zipfile

    import yaml

    (tmp_path / "d.json").write_text(json.dumps(DOC, indent=1))
    (tmp_path / "d.yaml").write_text(yaml.safe_dump(DOC))
    for d in (documents.read_json(spark, str(tmp_path / "d.json")), documents.read_yaml(spark, str(tmp_path / "d.yaml"))):
        n = tree.with_paths(documents.nodes(d))
        assert [r["ref"] for r in n.orderBy("path").collect()] == ["#/texts/1", "#/groups/0", "#/texts/0", "#/tables/0", "#/texts/2"]
        assert render.markdown(n).first()["text"] == "## **Head &amp; tail**\n\n- an\\_item"
        assert documents.prov(d).first()["bbox"]["r"] == 3.0 and documents.pages(d).first()["width"] == 100.0
        assert documents.table_cells(d).first()["text"] == "x"
        assert tree.caption_text(documents.float_refs(d), n).first()["text"] == "Cap"
        assert str(documents.documents(d).first()["binary_hash"]) == "18446744073709551615"
    back = json.loads(documents.to_json(d).first()["json"])
    assert back["texts"][1]["text"] == "Head & tail" and back["body"]["children"][0] == {"$ref": "#/texts/1"}
    (tmp_path / "bad.json").write_text(json.dumps(DOC | {"version": "2.0.0"}))
    with pytest.raises(Exception, match="readable"):
        documents.nodes(documents.read_json(spark, str(tmp_path / "bad.json"))).collect()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.txt", "hello")
    assert documents.read_archive(spark, str(tmp_path / "a.zip")).first()["content"] == b"hello"
    with pytest.raises(Exception, match="limit"):
        documents.read_archive(spark, str(tmp_path / "a.zip"), member_bytes=3).collect()
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../x.txt", "hello")
    with pytest.raises(Exception, match="unsafe"):
        documents.read_archive(spark, str(tmp_path / "b.zip")).collect()
