"""Serialize document files: python -m quire.cli SOURCE --to markdown|text|html|doctags|latex|outline|json [-o FOLDER]."""

from __future__ import annotations

import argparse

from .operators.tree import with_paths
from .plans import render
from .session import session
from .sources import documents

FORMATS = {"markdown": render.markdown, "text": render.plain_text, "html": render.html, "doctags": render.doctags, "latex": render.latex, "outline": render.outline}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("source", help="a file, folder or pattern of JSON or YAML documents, by any path that Spark reads")
    p.add_argument("--to", choices=[*FORMATS, "json"], default="markdown")
    p.add_argument("-o", "--out", help="a folder for the result; printed without one")
    a = p.parse_args(args)
    spark = session("quire-serialize")
    read = documents.read_yaml if a.source.endswith((".yaml", ".yml")) else documents.read_json
    docs = read(spark, a.source)
    out = documents.to_json(docs).withColumnRenamed("json", "text") if a.to == "json" else FORMATS[a.to](with_paths(documents.nodes(docs)))
    if a.out:
        out.write.mode("errorifexists").json(a.out)
    else:
        for r in out.toLocalIterator():
            print(r["text"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
