"""Document files (JSON, YAML) to the normalized tables and back, and archives of files.

A file is one object with typed arrays of items that refer to each other by JSON pointers. Reading is an expression over
the file's text: ``from_json`` with a fixed schema, one row an item, one row a child link. What the schema doesn't know
is left out; ``custom`` metadata stay as text.
"""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ARRAYS, BBOX, FORMATTING
from ..functions.text import accepts_version

VERSION = "1.10.0"
_REF = "struct<`$ref`: string>"
_PROV = f"array<struct<page_no: int, bbox: {BBOX}, charspan: array<int>>>"
_CELL = f"struct<row_span: int, col_span: int, start_row_offset_idx: int, end_row_offset_idx: int, start_col_offset_idx: int, end_col_offset_idx: int, text: string, column_header: boolean, row_header: boolean, row_section: boolean, fillable: boolean, bbox: {BBOX}, ref: {_REF}>"
_TRACK = "array<struct<kind: string, start_time: double, end_time: double, identifier: string, voice: string>>"
_GRAPH = "struct<cells: array<struct<label: string, cell_id: int, text: string, orig: string, item_ref: " + _REF + ">>, links: array<struct<label: string, source_cell_id: int, target_cell_id: int>>>"
_ITEM = (
    f"struct<self_ref: string, parent: {_REF}, children: array<{_REF}>, content_layer: string, label: string, name: string, prov: {_PROV}, source: {_TRACK}, text: string, orig: string, level: int, marker: string, enumerated: boolean, "
    f"code_language: string, formatting: {FORMATTING}, hyperlink: string, captions: array<{_REF}>, footnotes: array<{_REF}>, references: array<{_REF}>, comments: array<{_REF}>, data: struct<table_cells: array<{_CELL}>, num_rows: int, num_cols: int, orientation: string>, graph: {_GRAPH}, meta: string>"
)
DOCUMENT = (
    "struct<schema_name: string, version: string, name: string, origin: struct<mimetype: string, binary_hash: decimal(20,0), filename: string, uri: string>, "
    f"body: {_ITEM}, furniture: {_ITEM}, {', '.join(f'{a}: array<{_ITEM}>' for a in ARRAYS)}, pages: map<string, struct<size: struct<width: double, height: double>, page_no: int>>>"
)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, doc): a row a file; the id is a hash of the path."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return parsed(raw.select("path", F.col("value").alias("json")))


def parsed(raw: DataFrame) -> DataFrame:
    """(doc_id, path, doc) of raw(path, json). Texts that aren't documents, and versions that can't be read, raise an error."""
    doc = F.from_json("json", DOCUMENT)
    d = raw.select(F.xxhash64("path").alias("doc_id"), "path", doc.alias("doc"))
    good = F.col("doc.body").isNotNull() & (F.col("doc.version").isNull() | accepts_version(F.col("doc.version"), VERSION))
    return d.withColumn("doc", F.when(good, F.col("doc")).otherwise(F.raise_error(F.concat(F.lit("no readable document: "), "path"))))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_json``; the files become JSON in a narrow Arrow pass."""

    def run(batches):
        import yaml

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(yaml.safe_load(t), default=str) for t in b.column(1).to_pylist()], pa.string())], names=["path", "json"])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parsed(raw.mapInArrow(run, "path string, json string"))


def _ref(c: Column) -> Column:
    return c["$ref"]


def _items(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, item) of all arrays."""
    out = None
    for a in ARRAYS:
        part = docs.select("doc_id", F.lit(a).alias("kind"), F.explode(F.col(f"doc.{a}")).alias("item"))
        out = part if out is None else out.unionByName(part)
    return out


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, name, version, mimetype, filename, binary_hash)."""
    return docs.select("doc_id", "doc.name", "doc.version", F.col("doc.origin.mimetype").alias("mimetype"), F.col("doc.origin.filename").alias("filename"), F.col("doc.origin.binary_hash").alias("binary_hash"))


def nodes(docs: DataFrame) -> DataFrame:
    """A row an item: (doc_id, ref, kind, label, layer, parent_ref, child_pos, text, ...). The position is that among the parent's
    children; items that no parent lists keep the parent that they name and come last."""
    i = _items(docs)
    roots = docs.select("doc_id", F.explode(F.array("doc.body", "doc.furniture")).alias("item")).filter("item is not null")
    owners = roots.unionByName(i.select("doc_id", "item"))
    child = owners.select("doc_id", F.col("item.self_ref").alias("parent_ref"), F.posexplode("item.children").alias("child_pos", "c")).select("doc_id", "parent_ref", "child_pos", F.col("c.$ref").alias("ref"))
    x = F.col("item")
    n = i.select(
        "doc_id", x["self_ref"].alias("ref"), "kind", F.coalesce(x["label"], F.when(F.col("kind") == "groups", F.lit("unspecified"))).alias("label"), F.coalesce(x["content_layer"], F.lit("body")).alias("layer"),
        _ref(x["parent"]).alias("named_parent"), x["text"].alias("text"), x["orig"].alias("orig"), x["level"].alias("heading_level"), x["marker"].alias("marker"), x["enumerated"].alias("enumerated"), x["code_language"].alias("code_language"),
        x["formatting"].alias("formatting"), x["hyperlink"].alias("hyperlink"), x["name"].alias("name"), F.get(x["prov"], F.lit(0))["page_no"].alias("page_no"),
    )
    out = n.join(child, ["doc_id", "ref"], "left")
    return out.withColumn("parent_ref", F.coalesce("parent_ref", "named_parent")).withColumn("child_pos", F.coalesce("child_pos", F.lit(2**31 - 1))).drop("named_parent")


def prov(docs: DataFrame) -> DataFrame:
    p = _items(docs).select("doc_id", F.col("item.self_ref").alias("ref"), F.posexplode("item.prov").alias("prov_ix", "p"))
    return p.select("doc_id", "ref", "prov_ix", "p.page_no", "p.bbox", "p.charspan")


def pages(docs: DataFrame) -> DataFrame:
    p = docs.select("doc_id", F.explode("doc.pages").alias("key", "p"))
    return p.select("doc_id", F.col("key").cast("int").alias("page_no"), F.col("p.size.width").alias("width"), F.col("p.size.height").alias("height"))


def table_cells(docs: DataFrame) -> DataFrame:
    c = docs.select("doc_id", F.explode("doc.tables").alias("t")).select("doc_id", F.col("t.self_ref").alias("ref"), F.posexplode("t.data.table_cells").alias("cell_ix", "c"))
    x = F.col("c")
    return c.select("doc_id", "ref", "cell_ix", x["start_row_offset_idx"].alias("r0"), x["end_row_offset_idx"].alias("r1"), x["start_col_offset_idx"].alias("c0"), x["end_col_offset_idx"].alias("c1"), x["row_span"].alias("row_span"), x["col_span"].alias("col_span"), x["text"].alias("text"), *[F.coalesce(x[f], F.lit(False)).alias(f) for f in ("column_header", "row_header", "row_section", "fillable")], x["bbox"].alias("bbox"), _ref(x["ref"]).alias("rich_ref"))


def graph_cells(docs: DataFrame) -> DataFrame:
    g = _items(docs).select("doc_id", F.col("item.self_ref").alias("ref"), F.explode("item.graph.cells").alias("c"))
    return g.select("doc_id", "ref", "c.cell_id", "c.label", "c.text", "c.orig", _ref(F.col("c.item_ref")).alias("item_ref"))


def graph_links(docs: DataFrame) -> DataFrame:
    g = _items(docs).select("doc_id", F.col("item.self_ref").alias("ref"), F.posexplode("item.graph.links").alias("link_ix", "l"))
    return g.select("doc_id", "ref", "link_ix", "l.label", "l.source_cell_id", "l.target_cell_id")


def float_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, owner_ref, role, pos, target_ref): captions, footnotes, references and comments."""
    i, out = _items(docs), None
    for role, col in (("caption", "captions"), ("footnote", "footnotes"), ("reference", "references"), ("comment", "comments")):
        part = i.select("doc_id", F.col("item.self_ref").alias("owner_ref"), F.lit(role).alias("role"), F.posexplode(f"item.{col}").alias("pos", "r")).select("doc_id", "owner_ref", "role", "pos", F.col("r.$ref").alias("target_ref"))
        out = part if out is None else out.unionByName(part)
    return out


def cues(docs: DataFrame) -> DataFrame:
    """(doc_id, ref, text, start_time, end_time, identifier, voice): a row a track source of a text."""
    c = docs.select("doc_id", F.explode("doc.texts").alias("t")).select("doc_id", F.col("t.self_ref").alias("ref"), F.col("t.text").alias("text"), F.explode("t.source").alias("s")).filter("s.kind = 'track'")
    return c.select("doc_id", "ref", "text", "s.start_time", "s.end_time", "s.identifier", "s.voice")


def to_json(docs: DataFrame) -> DataFrame:
    """(doc_id, json): what ``read_json`` read, without nulls."""
    return docs.select("doc_id", F.to_json("doc").alias("json"))


# ---------------------------------------------------------------------- archives
def read_archive(spark: SparkSession, path: str, member_bytes: int = 128 << 20, total_bytes: int = 512 << 20) -> DataFrame:
    """(path, member, content binary) of zip files. Names that leave the archive, members and totals over the limits
    (as they unpack, whatever the directory says) raise an error."""

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total = 0
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for m in z.infolist():
                        if m.is_dir():
                            continue
                        parts = m.filename.replace("\\", "/").split("/")
                        if m.filename.startswith("/") or ".." in parts or ":" in parts[0]:
                            raise ValueError(f"{p}: unsafe name {m.filename!r}")
                        with z.open(m) as f:
                            body = f.read(member_bytes + 1)
                        total += len(body)
                        if len(body) > member_bytes or total > total_bytes:
                            raise ValueError(f"{p}: {m.filename!r} is over the size limit")
                        yield pa.RecordBatch.from_pydict({"path": [p], "member": [m.filename], "content": [body]}, schema=pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, content binary")
