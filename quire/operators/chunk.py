"""Chunkers over nodes with paths. Tokens are words, counted by an expression, unless a tokenizer of functions.tokens is given."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import Starts, count_tokens, with_count, words
from ..storage import materialize
from .tree import doc_window, heading_level, heading_levels


def heading_scope(nodes: DataFrame) -> DataFrame:
    """``nodes`` with headings array<string>: the open headings above each node, outermost first.

    A heading of level k (title 0) closes all of level k and deeper."""
    levels = heading_levels(nodes)
    if not levels:
        return nodes.withColumn("rank", F.row_number().over(doc_window())).withColumn("headings", F.array().cast("array<string>"))
    n = nodes.withColumn("h", heading_level(F.col("label"), F.col("heading_level"))).withColumn("rank", F.row_number().over(doc_window()))
    w = doc_window().rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("*", *[F.last(F.when(F.col("h") == k, F.struct("rank", "text")), ignorenulls=True).over(w).alias(f"l{i}") for i, k in enumerate(levels)])
    at = [F.coalesce(F.col(f"l{i}.rank"), F.lit(0)) for i in range(len(levels))]
    is_open = [F.col(f"l{i}").isNotNull() & (at[i] > (F.greatest(*at[:i]) if i > 1 else at[0] if i else F.lit(0))) for i in range(len(levels))]
    # a heading is not under one of its own level or deeper
    is_open = [c & (F.col("h").isNull() | (F.col("h") > k)) for k, c in zip(levels, is_open, strict=True)]
    found = F.filter(F.array(*[F.when(c, F.col(f"l{i}.text")) for i, c in enumerate(is_open)]), lambda x: x.isNotNull())
    return n.withColumn("headings", found).drop("h", *[f"l{i}" for i in range(len(levels))])


def hierarchical_chunks(nodes: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, chunk_ix, text, headings, doc_items): a chunk an item that is no heading and has text; the items of a list or
    inline group are one chunk, a line each. Headings alone give none."""
    parts = nodes.filter("kind = 'groups' and label in ('list', 'ordered_list', 'inline')").select("doc_id", F.col("ref").alias("parent_ref"), F.col("label").alias("group_label"))
    s = heading_scope(nodes).filter("kind <> 'groups'").filter(F.col("layer") == "body")
    s = s.filter(~F.col("label").isin("title", "section_header")).join(parts, ["doc_id", "parent_ref"], "left")
    s = s.withColumn("body", text if text is not None else F.col("text")).filter("body is not null and body <> ''")
    owner = F.when(F.col("group_label").isNotNull(), F.col("parent_ref")).otherwise(F.col("ref"))
    g = s.groupBy("doc_id", owner.alias("owner")).agg(F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("rank", "body", "ref"))).alias("p"), F.min_by("headings", "rank").alias("headings"), F.min_by("group_label", "rank").alias("gl"))
    glue = F.when(F.col("gl") == "inline", F.lit(" ")).otherwise(F.lit("\n"))
    lines = F.aggregate("p", F.lit(""), lambda acc, x: F.when(acc == "", x["body"]).otherwise(F.concat(acc, glue, x["body"])))
    g = g.select("doc_id", "rank", lines.alias("text"), "headings", F.transform("p", lambda x: x["ref"]).alias("doc_items"))
    return g.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("rank")) - 1).cast("long").alias("chunk_ix"), "text", "headings", "doc_items")


def contextualize(chunks: DataFrame, delim: str = "\n") -> DataFrame:
    """``chunks`` with context: headings, one a line, then the text."""
    return chunks.withColumn("context", F.concat_ws(delim, F.when(F.size("headings") > 0, F.array_join("headings", delim)), F.col("text")))


def merge_peers(chunks: DataFrame, max_tokens: int, delim: str = "\n", starts: Starts = words) -> DataFrame:
    """Neighbouring chunks of equal headings become one while headings and texts together hold at most ``max_tokens``.

    The greedy pass over a document sees token counts only; texts meet again by the number of their window."""
    c = with_count(chunks.withColumn("heading_text", F.array_join("headings", "\n")), "text", starts, "n")
    c = with_count(c, "heading_text", starts, "hn")
    kind = chunks.schema["doc_id"].dataType.simpleString()
    before = F.lag("headings").over(Window.partitionBy("doc_id").orderBy("chunk_ix"))
    sizes = c.select("doc_id", "chunk_ix", "n", "hn", F.coalesce(F.col("headings") == before, F.lit(False)).alias("same"))

    def windows(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk_ix")
        out, window, held = [], -1, 0
        for n, hn, same in zip(*(t.column(x).to_pylist() for x in ("n", "hn", "same")), strict=True):
            fits = same and window >= 0 and held + n + hn <= max_tokens
            window, held = (window, held + n) if fits else (window + 1, n)
            out.append(window)
        return pa.table({"doc_id": t.column("doc_id"), "chunk_ix": t.column("chunk_ix"), "w": pa.array(out, pa.int64())})

    w = sizes.groupBy("doc_id").applyInArrow(windows, f"doc_id {kind}, chunk_ix long, w long")
    e = c.select("doc_id", "chunk_ix", "text", "headings", "doc_items").join(w, ["doc_id", "chunk_ix"])
    m = e.groupBy("doc_id", "w").agg(F.array_sort(F.collect_list(F.struct("chunk_ix", "text", "doc_items"))).alias("p"), F.min_by("headings", "chunk_ix").alias("headings"))
    return m.select("doc_id", F.col("w").alias("chunk_ix"), F.array_join(F.transform("p", lambda x: x["text"]), delim).alias("text"), "headings", F.flatten(F.transform("p", lambda x: x["doc_items"])).alias("doc_items"))


# ------------------------------------------------------------------------- lines
_SPACE = " \t\n\r\f\v"


def line_windows(text: str, limit: int, cost: int = 0, bare: bool = False, starts: Starts = words):
    """(from, to, cut, prefixed): the greedy windows of a text, in characters.

    All tokens are numbered once; a window of ``limit - cost`` tokens ends before the line that doesn't fit, if that line
    fits a window of its own, and within it otherwise (``cut``: at its last white space, if there is one). With ``bare``
    a line that only fits without the ``cost`` of the prefix opens a window of ``limit`` tokens that has none."""
    at, lines = list(starts(text)), [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))]
    first = [bisect_right(at, x - 1) for x in lines]  # each line's first token
    total = len(at)
    if not total:
        return
    size = lambda line, p: (first[line + 1] if line + 1 < len(first) else total) - p
    p, char, plain = 0, 0, False
    while char < len(text):
        line = bisect_right(lines, char) - 1
        own = size(line, p)
        alone = bare and cost > 0 and (plain or limit - cost < own <= limit)
        room = max(1, limit if alone else limit - cost)
        if p + room >= total:
            yield char, len(text), False, not alone
            return
        over = bisect_right(first, p + room) - 1  # the line that holds the first token too many; of empty ones the last
        largest = limit if bare else max(1, limit - cost)
        if lines[over] > char and (first[over] == p + room or size(over, first[over]) <= largest):
            p, to, plain = first[over], lines[over], False
        else:
            to = at[p + room]
            low, k = max(lines[over], char), to
            while k > low and text[k] not in _SPACE and text[k - 1] not in _SPACE:
                k -= 1
            if k > low and text[k] not in _SPACE and text[low:k].strip(_SPACE):
                to = k - 1
            to = max(to, char + 1)  # tokens may share a character
            p, plain = bisect_right(at, to - 1), bare
            yield char, to, True, not alone
            char = to
            continue
        yield char, to, False, not alone
        char = to


def pack_lines(text: str, limit: int, prefix: str = "", omit_prefix: bool = False, starts: Starts = words) -> list[str]:
    """Chunks of at most ``limit`` tokens of whole lines, each after ``prefix``. The part of a line that had to be cut starts
    on a line of its own. A prefix over the limit comes first, in chunks of its own, and is then left out; with
    ``omit_prefix`` it is left out wherever only that lets a line fit, and after a cut."""
    cost = len(starts(prefix)) if prefix else 0
    out: list[str] = []
    if cost > limit:
        out += [prefix[a:b] for a, b, *_ in line_windows(prefix.replace("\n", " "), limit, starts=starts)]
        prefix, cost = "", 0
    for a, b, cut, prefixed in line_windows(text, limit, cost, omit_prefix, starts):
        if a == 0 and not prefixed and prefix:
            out.append(prefix)  # it is said once, at least
        head = prefix if prefixed else ""
        if cut:
            low = text.rfind("\n", a, b) + 1
            out.append(head + text[a:low] + "\n" + text[max(a, low) : b] if low > a else head + "\n" + text[a:b])
        else:
            out.append(head + text[a:b])
    return out


def line_chunks(texts: DataFrame, max_tokens: int, prefix: str = "", omit_prefix: bool = False, starts: Starts = words) -> DataFrame:
    """(doc_id, chunk_ix, text) of texts(doc_id, text): a narrow Arrow pass, one document at a time."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            doc, ix, out = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, c in enumerate(pack_lines(t, max_tokens, prefix, omit_prefix, starts) if t else []):
                    doc.append(d)
                    ix.append(i)
                    out.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(doc, b.schema.field(0).type), pa.array(ix, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "chunk_ix", "text"])

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk_ix long, text string")


# ------------------------------------------------------------------------- pages
def page_chunks(nodes: DataFrame, delim: str = "\n\n") -> DataFrame:
    """(doc_id, page_no, text, doc_items): the texts of each page by first place; a document without pages is one chunk."""
    n = nodes.filter("layer = 'body' and text is not null and text <> ''")
    rows = F.array_sort(F.collect_list(F.struct("path", "text", "ref")))
    g = n.groupBy("doc_id", "page_no").agg(rows.alias("p"))
    return g.select("doc_id", "page_no", F.array_join(F.transform("p", lambda x: x["text"]), delim).alias("text"), F.transform("p", lambda x: x["ref"]).alias("doc_items"))


def expand_tree(chunks: DataFrame, nodes: DataFrame, **made: Column) -> DataFrame:
    """``chunks`` whose text is that of everything below the top-level ancestors of their items, in order, a line end after each.

    The text is made once for all chunks below the same ancestors and meets them at the end. Columns ``made`` of text stand
    in its place and are made as often as it is: a digest a chunk costs no text a chunk."""
    top = nodes.select("doc_id", "ref", F.slice("path", 1, 1).alias("top"))
    item = chunks.select("doc_id", "chunk_ix", F.explode("doc_items").alias("ref")).join(top, ["doc_id", "ref"])
    item = materialize(item.groupBy("doc_id", "chunk_ix").agg(F.array_sort(F.collect_set("top")).alias("tops")))
    texts = nodes.filter("text is not null and text <> ''").select("doc_id", F.slice("path", 1, 1).alias("top"), "path", "text")
    whole = texts.groupBy("doc_id", "top").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("p"))
    whole = whole.select("doc_id", "top", F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("whole"))
    sets = item.select("doc_id", "tops").distinct().select("doc_id", "tops", F.explode("tops").alias("top"))
    g = sets.join(whole, ["doc_id", "top"]).groupBy("doc_id", "tops").agg(F.array_sort(F.collect_list(F.struct("top", "whole"))).alias("p"))
    g = g.select("doc_id", "tops", F.array_join(F.transform("p", lambda x: x["whole"]), "").alias("text"))
    g = g.select("doc_id", "tops", *([c.alias(n) for n, c in made.items()] or ["text"]))
    return item.join(g, ["doc_id", "tops"]).drop("tops")


def expand_page(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chunks`` whose text is that of the pages that their items touch."""
    item = chunks.select("doc_id", "chunk_ix", F.explode("doc_items").alias("ref")).join(nodes.select("doc_id", "ref", "page_no"), ["doc_id", "ref"]).filter("page_no is not null").select("doc_id", "chunk_ix", "page_no").distinct()
    page = page_chunks(nodes).select("doc_id", "page_no", F.col("text").alias("page_text"))
    g = item.join(page, ["doc_id", "page_no"]).groupBy("doc_id", "chunk_ix").agg(F.array_sort(F.collect_list(F.struct("page_no", "page_text"))).alias("p"))
    return g.select("doc_id", "chunk_ix", F.array_join(F.transform("p", lambda x: x["page_text"]), "\n\n").alias("text"))



# ------------------------------------------------------------------------ hybrid
_SEPARATORS = (r"\n\s*\n", r"\n", r"(?<=[.!?;])\s+", r"\s+")
_RULE = re.compile(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def split_text(text: str, limit: int, starts: Starts = words, level: int = 0) -> list[str]:
    """Pieces of at most ``limit`` tokens: cut at blank lines, then line ends, sentences, spaces, and characters at last;
    neighbours are joined again while they fit. (This stands for a splitter library: its cuts differ from that one's.)"""
    if len(starts(text)) <= limit:
        return [text] if text.strip() else []
    if level == len(_SEPARATORS):
        return [text[a:b] for a, b, *_ in line_windows(text, limit, starts=starts)]
    parts, at = [], 0
    for m in re.finditer(_SEPARATORS[level], text):
        parts.append(text[at : m.end()])
        at = m.end()
    out: list[str] = []
    sizes: list[int] = []
    for p in [*parts, text[at:]]:
        for piece in split_text(p, limit, starts, level + 1):
            n = len(starts(piece))
            # the sum is checked first, so a joined text is seldom counted again
            if out and sizes[-1] + n <= limit + 1 and (m := len(starts(out[-1] + piece))) <= limit:
                out[-1] += piece
                sizes[-1] = m
            else:
                out.append(piece)
                sizes.append(n)
    return [p.strip() for p in out if p.strip()] if level == 0 else out


def table_header(text: str) -> tuple[list[str], list[str]]:
    """(header lines, body lines) of a Markdown table, or no header."""
    lines = text.splitlines(True)
    if len(lines) > 2 and lines[0].lstrip().startswith("|") and _RULE.match(lines[1].strip()):
        return lines[:2], lines[2:]
    return [], lines


def split_oversize(chunks: DataFrame, max_tokens: int, repeat_header: bool = True, starts: Starts = words) -> DataFrame:
    """``chunks`` in which those of more than ``max_tokens`` tokens, headings included, are split; tables between rows, with
    their header on every part. Headings that leave no room are dropped from the chunk. A narrow pass."""
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for d, i, text, heads, refs in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                used = sum(len(starts(h)) for h in heads or [])
                if used >= max_tokens:
                    heads, used = [], 0
                room = max_tokens - used
                if len(starts(text)) <= room:
                    parts = [text]
                else:
                    head, body = table_header(text)
                    if head:
                        top = "".join(head)
                        parts = pack_lines("".join(body), room, top, starts=starts) if repeat_header else pack_lines(top + "".join(body), room, starts=starts)
                    else:
                        parts = split_text(text, room, starts)
                rows += [(d, i, k, p, heads, refs) for k, p in enumerate(parts)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "chunk_ix", "part", "text", "headings", "doc_items"])

    out = chunks.select("doc_id", "chunk_ix", "text", "headings", "doc_items").mapInArrow(run, f"doc_id {kind}, chunk_ix long, part long, text string, headings array<string>, doc_items array<string>")
    w = Window.partitionBy("doc_id").orderBy("chunk_ix", "part")
    return out.withColumn("chunk_ix", (F.row_number().over(w) - 1).cast("long")).drop("part")


def hybrid_chunks(nodes: DataFrame, max_tokens: int, merge: bool = True, repeat_header: bool = True, starts: Starts = words) -> DataFrame:
    """Hierarchical chunks, split where they are too long, then neighbours of equal headings merged while they fit."""
    c = split_oversize(hierarchical_chunks(nodes), max_tokens, repeat_header, starts)
    return merge_peers(c, max_tokens, starts=starts) if merge else c
