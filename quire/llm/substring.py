"""Substring dedup with a count-min prefilter.

A sketch of all windows of ``k`` words (partition sketches, merged) overestimates how often each occurs. Only windows
it takes for repeated are grouped exactly. A word goes if a window over it also starts in a document with a smaller
doc_id; windows are judged on the input. Words are runs of characters other than space and tab to carriage return.

Nulls: a null text has no words; a null doc_id is smaller than all others. Rows that share an id are parts of one
document: they never remove words of each other, and what others say again goes by each row's own text. Equal rows are
treated alike. Texts of fewer than ``k`` words stay whole; very long ones are read whole, one at a time. Empty tables
give empty results. ``dedup`` leaves all other columns as they are, whatever their names; ``find`` adds ``q_spans``, in
place of a column of that name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, free_name, sha, utf8
from .repeats import WindowsOf, kept_units, mark_repeats, with_marks


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).split()  # bytes.split() cuts at exactly these six characters


def find(docs: DataFrame, k: int = 13, name: str = "q_spans") -> DataFrame:
    """``docs`` with ``name`` binary: int32 start and end of the runs of words to remove, null for none."""
    return with_marks(docs, mark_repeats(docs, words_of, k, WindowsOf(k), within_doc=False, short=False), name)


def dedup(docs: DataFrame, k: int = 13) -> DataFrame:
    """``docs`` with the words that stay as text, joined by one space where any word went."""

    def run(texts, spans):
        out = [t if s is None or t is None else b" ".join(kept_units(words_of(t), s)).decode("utf-8", "surrogatepass") for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)]
        return [pa.array(out, pa.string())]

    names, spans = docs.columns, free_name(docs, "q_spans")
    return annotate(find(docs, k, spans), "text string", run, ["text", spans]).select(*[F.col(f"`{c}`") for c in names])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""

    def run(texts, spans):
        n, gone, kept = [], [], []
        for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            words = words_of(t)
            left = kept_units(words, s)
            n.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(sha(b" ".join(left)))
        return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]

    return annotate(found.select("doc_id", "text", "q_spans"), "n_words long, n_removed long, kept_sha256 string", run, ["text", "q_spans"]).drop("text", "q_spans")


