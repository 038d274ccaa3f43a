r"""Line dedup by winnowing.

A text's lines (split at \n) are hashed. Of each window of ``k`` lines the smallest hash is its fingerprint (of equal
ones the last), so any run of ``k`` lines that occurs twice has the same fingerprint at the same place. Fingerprints
that occur at one place only are done with. The others' windows are compared exactly and joined into maximal runs,
which extends a match both ways; every occurrence of a window but the first (smallest doc_id, then line) is deleted.
A text of fewer than ``k`` lines is one window.

So a line goes exactly if a window of ``k`` lines over it also starts earlier. With ``least``, fewer lines are a window
as well if their sizes come to ``least`` or more, so a long line that occurs earlier goes on its own, and so does a pair;
the size of a line is its number of words, or an eighth of its bytes if that is more, for scripts without spaces. The
fingerprint of such a window is found in the same way, so these are caught without exception, too.

Nulls: a null text has no lines; a null doc_id comes first. Rows that share an id are ordered among themselves by line,
then by a hash of their text; equal rows are treated alike, so neither removes lines of the other. A very long text is
read whole, one at a time. Empty tables give empty results. ``dedup`` leaves all other columns as they are, whatever
their names; ``find`` adds ``q_spans``, in place of a column of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, free_name, sha, utf8
from .repeats import kept_units, mark_repeats, winnow, winnow_windows, with_marks

RUN = 3
#: the least size of a repeated run of fewer lines in the pipeline
LEAST = 8


def lines_of(text: str | None) -> list[bytes]:
    return [] if not text else utf8(text).split(b"\n")


def sizes_of(lines: list[bytes]) -> np.ndarray:
    return np.fromiter((max(len(x.split()), len(x) // 8) for x in lines), np.int64, len(lines))


def find(docs: DataFrame, k: int = RUN, least: int | None = None, name: str = "q_spans") -> DataFrame:
    """``docs`` with ``name`` binary: int32 start and end of the runs of lines to remove, null for none."""
    if least is None:
        marks = mark_repeats(docs, lines_of, k, winnow(k), within_doc=True, short=True)
    else:
        marks = mark_repeats(docs, lines_of, k, winnow_windows, within_doc=True, short=True, sizes=sizes_of, least=least)
    return with_marks(docs, marks, name)


def _cut(texts, spans):
    for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        lines = lines_of(t)
        yield t, lines, kept_units(lines, s)


def dedup(docs: DataFrame, k: int = RUN, drop_emptied: bool = True, least: int | None = None) -> DataFrame:
    """``docs`` with the lines that stay; texts of which nothing but blank lines stays, though lines went, are dropped
    if ``drop_emptied``: they are copies of earlier ones."""

    def run(texts, spans):
        out, gone = [], []
        for t, lines, left in _cut(texts, spans):
            same = len(left) == len(lines)
            out.append(t if same else b"\n".join(left).decode("utf-8", "surrogatepass"))
            gone.append(not same and not any(x.strip() for x in left))
        return [pa.array(out, pa.string()), pa.array(gone, pa.bool_())]

    names, spans, emptied = docs.columns, free_name(docs, "q_spans"), free_name(docs, "q_gone")
    out = annotate(find(docs, k, least, spans), f"text string, {emptied} boolean", run, ["text", spans])
    return (out.filter(~F.col(emptied)) if drop_emptied else out).select(*[F.col(f"`{c}`") for c in names])


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256 of the lines that stay, joined by line ends)."""

    def run(texts, spans):
        rows = [(len(lines), len(lines) - len(left), sha(b"\n".join(left))) for _, lines, left in _cut(texts, spans)]
        n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]

    return annotate(found.select("doc_id", "text", "q_spans"), "n_lines long, n_removed long, kept_sha256 string", run, ["text", "q_spans"]).drop("text", "q_spans")
