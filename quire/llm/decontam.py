"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``n`` consecutive words of each benchmark item (an item with fewer words is one
window). For each pattern length a shift table, keyed by blocks of two words, says how far the search may jump
without missing a pattern; where it says 0, the bucket of that suffix names the patterns to compare directly.

A part of the benchmark, of at most ``part_bytes`` of text or one item, is held by a task, as arrays: the numbers of its
words in a row, the distinct blocks with their shifts, and the places where a window ends, in the order of its last
block. That is about 30 bytes a word, besides the dictionary of distinct words. A larger benchmark is taken in parts:
each is a pass of its own, whose result is written to the shared folder before the next, so neither a worker nor the
driver ever holds two.

Nulls: a null text has no words; a null item id counts as the id "". Empty tables give empty results. Repeated
rows are judged one by one; repeated items count once an id. Very long texts are read whole. Other columns of ``docs``
pass through, whatever their names: ``scan`` names its own with a prefix and replaces columns called so, and
``drop_contaminated`` chooses a prefix that no column has.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, discard, free_prefix, lower_ascii, materialize

# every ASCII byte that is no digit or letter separates words; bytes of other characters belong to words
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return lower_ascii(text).translate(_TO_SPACE).split()


class WuManber:
    """All occurrences of the windows of ``m`` words that the items in ``spans`` (their places in ``seq``) have."""

    def __init__(self, m: int, seq: np.ndarray, spans: list[tuple[int, int, int]], n_words: int):
        self.m, self.b, self.seq, self.n = m, min(2, m), seq, n_words
        # the block that ends at each place, and how far the nearest end of a window is from there
        ends = np.concatenate([np.arange(a + m - 1, z) for _, a, z in spans])
        self.item = np.repeat(np.asarray([i for i, *_ in spans]), [z - a - m + 1 for _, a, z in spans])
        own = self.blocks(seq)
        keys, far = [], []
        for d in range(m - self.b + 1):
            keys.append(np.unique(own[ends - d]))
            far.append(np.full(len(keys[-1]), d, np.uint8))
        keys, far = np.concatenate(keys), np.concatenate(far)
        order = np.lexsort((far, keys))
        first = np.append(True, keys[order][1:] != keys[order][:-1])
        self.keys, self.shift = keys[order][first], far[order][first]
        order = np.argsort(own[ends], kind="stable")
        self.ends, self.item = ends[order], self.item[order]
        self.bucket = np.searchsorted(own[self.ends], np.stack([self.keys, self.keys + 1]))

    def blocks(self, ids: np.ndarray) -> np.ndarray:
        """The number of the block that ends at each place; -1 where a word is unknown."""
        if self.b == 1:
            return ids
        out = np.full(len(ids), -1, np.int64)
        out[1:] = np.where((ids[1:] >= 0) & (ids[:-1] >= 0), ids[:-1] * self.n + ids[1:], -1)
        return out

    def find(self, ids: np.ndarray):
        """(start, items) of every window of ``ids`` that is a pattern."""
        m, n = self.m, len(ids)
        if n < m:
            return
        own = self.blocks(ids)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        step = np.where(self.keys[at] == own, self.shift[at], m - self.b + 1)
        if (step[m - 1 :] > 0).all():
            return
        end, jump = m - 1, step.tolist()
        while end < n:
            if jump[end]:
                end += jump[end]
                continue
            low, high = self.bucket[:, at[end]]
            ends = self.ends[low:high]
            same = (self.seq[ends[:, None] + np.arange(1 - m, 1)] == ids[end - m + 1 : end + 1]).all(1)
            if same.any():
                yield end - m + 1, self.item[low:high][same].tolist()
            end += 1


class Matcher:
    """The patterns of some items: a dictionary of their words and a ``WuManber`` for each length."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.word: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        seq, by, at = [], {}, 0
        for i, (_, text) in enumerate(items):
            ids = [self.word.setdefault(w, len(self.word)) for w in words_of(text)]
            if ids:
                by.setdefault(min(n, len(ids)), []).append((i, at, at + len(ids)))
                seq.append(np.asarray(ids, np.int64))
                at += len(ids)
        whole = np.concatenate(seq) if seq else np.empty(0, np.int64)
        self.lengths = [WuManber(m, whole, spans, len(self.word)) for m, spans in sorted(by.items())]

    def find(self, words: list[bytes]):
        """(start, end, item ids) of all occurrences."""
        ids = np.fromiter(map(self.word.get, words, repeat(-1)), np.int64, len(words))
        for w in self.lengths:
            for at, who in w.find(ids):
                yield at, at + w.m, [self.items[i] for i in who]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, part_bytes: int = 8 << 20, id_col: str = "item_id", text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """``docs`` with <prefix>words long, <prefix>spans array<int> (start, end of hit runs of words, merged), <prefix>items array<string>."""
    bench = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    names = [prefix + c for c in ("words", "spans", "items")]
    out = docs
    for k in range(parts):
        mine = bench if parts == 1 else bench.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == k)
        found = Matcher([(r["i"], r["t"]) for r in mine.toLocalIterator()], n)

        def run(texts, spans=None, items=None, found=found):
            n_words, out_spans, out_items = [], [], []
            for row, text in enumerate(texts.to_pylist()):
                words = words_of(text)
                runs = [] if spans is None else [tuple(x) for x in np.reshape(spans[row].as_py(), (-1, 2)).tolist()]
                hit = set() if items is None else set(items[row].as_py())
                for a, b, who in found.find(words):
                    runs.append((a, b))
                    hit.update(who)
                runs.sort()
                merged: list[int] = []
                for a, b in runs:
                    if merged and a <= merged[-1]:
                        merged[-1] = max(merged[-1], b)
                    else:
                        merged += (a, b)
                n_words.append(len(words))
                out_spans.append(merged)
                out_items.append(sorted(hit))
            return [pa.array(n_words, pa.int64()), pa.array(out_spans, pa.list_(pa.int32())), pa.array(out_items, pa.list_(pa.string()))]

        made = annotate(out, f"{names[0]} long, {names[1]} array<int>, {names[2]} array<string>", run, ["text"] if k == 0 else ["text", *names[1:]])
        if k < parts - 1:  # the next part's pass reads a table, not this pass
            made, old = materialize(made), out
            if k:
                discard(old)
        out = made
    return out


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from what ``scan`` found."""
    hit = F.aggregate(F.sequence(F.lit(0), F.size("q_spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.get("q_spans", i + 1) - F.get("q_spans", i))
    n_hit = F.when(F.size("q_spans") > 0, hit).otherwise(F.lit(0).cast("long"))
    return scanned.select(
        "doc_id", F.col("q_words").alias("n_words"), n_hit.alias("n_hit"), F.size("q_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("q_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without those in which a window of a benchmark item occurs; the columns stay as they are."""
    p = free_prefix(docs)
    return scan(docs, benchmark, n, prefix=p).filter(F.size(f"{p}spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
