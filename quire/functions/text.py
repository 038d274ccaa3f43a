"""Text expressions: escapes, names, times, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_escape(text: Column, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quote else [])
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_underscores(text: Column) -> Column:
    r"""A backslash before each underscore that has none, but for those in the address of an image."""
    images = F.regexp_extract_all(text, F.lit(IMAGE), 0)
    between = F.transform(F.split(text, IMAGE), lambda t: F.regexp_replace(t, r"(?<!\\)_", r"\\_"))
    mixed = F.flatten(F.transform(F.arrays_zip(between.alias("a"), images.alias("b")), lambda x: F.array(F.coalesce(x["a"], F.lit("")), F.coalesce(x["b"], F.lit("")))))
    return F.when(F.contains(text, F.lit("_")), F.array_join(mixed, "")).otherwise(text)


IMAGE = r"!\[.*?\]\(.*?\)"


# Characters with a meaning in LaTeX text, and what stands for them.
LATEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "#": r"\#", "$": r"\$", "%": r"\%", "&": r"\&", "_": r"\_", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in LATEX.items() for x in p])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def humanize(name: Column, title: bool = False) -> Column:
    """Underscores become spaces; the first letter (``title``: of each word) is large."""
    t = F.replace(F.replace(name, F.lit("__"), F.lit("_")), F.lit("_"), F.lit(" "))
    return F.initcap(t) if title else F.concat(F.upper(F.substr(t, F.lit(1), F.lit(1))), F.lower(F.substr(t, F.lit(2))))


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm; milliseconds that round up carry."""
    ms = F.bround(seconds * 1000, 0).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", (ms / 3600000).cast("long"), (ms / 60000).cast("long") % 60, (ms / 1000).cast("long") % 60, ms % 1000)


def parse_timestamp(text: Column) -> Column:
    """Seconds of [HH:]MM:SS.mmm, null for anything else."""
    rx = r"^(?:(\d{2,}):)?([0-5]\d):([0-5]\d)\.(\d{3})$"
    n = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, rx, i), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(text.rlike(rx), n(1) * 3600 + n(2) * 60 + n(3) + n(4) / 1000)


RTL = r"[\u0590-\u08FF\uFB1D-\uFDFF\uFE70-\uFEFF]"


def is_rtl(text: Column) -> Column:
    """Does the text start with, or consist mostly of, letters of a script that is written from right to left?"""
    return text.rlike("^" + RTL) | (F.regexp_count(text, F.lit(RTL)) * 2 > F.char_length(text))


TAG = r"<(?!_.*?_>)[a-zA-Z/][^>]*>"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def locations(text: Column, size: int = 500) -> Column:
    """The first four location tokens as shares of the page, null without four."""
    found = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"<loc_(\d+)>"), 1), 1, 4), lambda x: x.cast("double") / size)
    return F.when(F.size(found) == 4, found)


def semver(text: Column) -> Column:
    """struct<major, minor, patch> of a version, null for anything else."""
    rx = r"^(\d+)\.(\d+)\.(\d+)(?:[-+].*)?$"
    return F.when(text.rlike(rx), F.struct(*[F.regexp_extract(text, rx, i).cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]))


def accepts_version(found: Column, own: str) -> Column:
    """Is a document's version readable: the same major, and a minor not over ours?"""
    a, b = semver(found), [int(x) for x in own.split(".")]
    return F.coalesce((a["major"] == b[0]) & (a["minor"] <= b[1]), F.lit(False))
