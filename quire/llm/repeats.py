"""Repeated runs of units (words or lines) over a whole corpus: the passes that substring and line dedup share.

Pass 1 is a count-min sketch of all windows (or of their winnowed fingerprints). Its width is fixed by the size of the
input: ``n_blocks`` ranges of 2**32 counters, in one row, so that it stays thin at every size. A sender sketches its
texts: one counter a cell it saw, saturated at 255. Reducers add the counters of a range, and a cell whose sum is 2 or
more goes back to the texts that saw it once; a sum is never under the true count, so nothing repeated is missed.

Pass 2 reads the texts that have such cells, and groups exactly the windows whose estimate is 2 or more, by 128 bits: two
64-bit hashes that are made of independent hashes of the units. Every occurrence but the first is marked. Pass 3 hands
the marks to the texts. Senders settle what they can among their own rows before they send: of a window that many
documents share, a sender passes on one (the first document's), so a hot one costs a reducer a row for each sender.

A text is told by its id and a hash of id and text, so rows that share an id but not a text never mix, and many rows of
one id are spread. Only texts that a Bloom filter of bounded size names are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U64, Bloom, WordHashes, blocks_for, discard, doc_block, free_name, gram_hashes, lean, materialize, mix, only, slices

NONE = np.empty(0, U64)  # a payload that a kind of rows doesn't have
WHO = np.dtype([("id", "<i8"), ("key", "<i8")])


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, key, text): null ids are NULL_ID; rows of equal id and text have one key."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return docs.select(own.alias("id"), F.xxhash64(own, F.col(text)).alias("key"), F.col(text).alias("text"))


# ------------------------------------------------------------------ block shuffle
def schema_of(names) -> str:
    return "kind int, block int, who binary, counts binary" + "".join(f", {x} binary" for x in names)


def pack(kind: int, block: np.ndarray, who: np.ndarray, people: np.ndarray, **payload: np.ndarray):
    """Entries as one row for each block: who has entries there (``people`` by the ascending places ``who``), how many
    each (int32), and the payload arrays. Gives no batch for no entries."""
    if not len(block):
        return
    order = np.argsort(block if block.max() > 65535 else block.astype(np.uint16), kind="stable")
    block, who, payload = block[order], who[order], {k: p[order] if len(p) else p for k, p in payload.items()}
    ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)).tolist()
    start, rows = 0, {x: [] for x in ("block", "who", "counts", *payload)}
    for end in ends:
        w = who[start:end]
        cut = np.append(0, np.flatnonzero(w[1:] != w[:-1]) + 1)
        rows["block"].append(int(block[start]))
        rows["who"].append(people[w[cut]].tobytes())
        rows["counts"].append(np.diff(np.append(cut, len(w))).astype(np.int32).tobytes())
        for name, p in payload.items():
            rows[name].append(p[start:end].tobytes())
        start = end
    kinds = pa.array(np.full(len(ends), kind, np.int32))
    yield pa.RecordBatch.from_arrays([kinds, pa.array(rows["block"], pa.int32()), *(pa.array(rows[x], pa.binary()) for x in ("who", "counts", *payload))], names=["kind", "block", "who", "counts", *payload])


def unpack(table: pa.Table, who: np.dtype, **payload: type) -> tuple[np.ndarray, ...]:
    """(who, a row for each run of entries; entries a run; payload arrays) of packed rows."""
    buf = lambda name, t: np.concatenate([np.empty(0, t), *(np.frombuffer(x, t) for x in table.column(name).to_pylist())])
    return (buf("who", who), buf("counts", np.int32), *(buf(n, t) for n, t in payload.items()))


def tabled(batches, like: pa.Table) -> pa.Table:
    made = list(batches)
    return pa.Table.from_batches(made, like.schema) if made else like.slice(0, 0)


# ------------------------------------------------------------------------- groups
def cells_of(h: np.ndarray) -> np.ndarray:
    """The counter within a block's range."""
    return h.astype(np.uint32)


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows sorted by the key, where each group starts."""
    order = np.argsort(key)
    s = key[order]
    return order, np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)


def groups_of_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``groups`` by two keys; the second is sorted only if the first doesn't tell all apart."""
    order, starts = groups(a)
    s = b[order]
    inner = np.ones(len(s), bool)
    inner[starts] = False
    if (s[1:] != s[:-1])[inner[1:]].any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    return order, starts


def spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A value for each group, repeated for its rows."""
    return np.repeat(values, np.diff(np.append(starts, n)))


# ------------------------------------------------------------------------- pass 1
def flagged_cells(texts: DataFrame, grams: Callable[[list], tuple[np.ndarray, np.ndarray]], n_blocks: int, sizes: bool = False) -> DataFrame:
    """(id, key, n long, cells binary uint32) of ``keyed`` texts: the cells of each text whose estimate is 2 or more.

    ``grams`` takes texts and gives the 64-bit hashes of all their grams in a row and how many each text has. With
    ``sizes`` every text has a row, with its id and its number of grams as n; else only texts with cells have one."""
    shift = U64(64 - (n_blocks.bit_length() - 1))
    rows = schema_of(["cells", "n"])

    def send(batches):
        held: list[tuple] = []
        n_held = n_people = 0

        def settle():
            """The sketch of the texts held, and the cells whose counter says 2 or more already."""
            nonlocal held, n_held, n_people
            if n_held:
                h, who, people = (np.concatenate(x) for x in zip(*held, strict=True))
                order, starts = groups(h)
                count = np.empty(len(h), np.int32)
                count[order] = spread(np.diff(np.append(starts, len(h))), starts, len(h))
                first = np.zeros(len(h), bool)
                first[order[starts]] = True
                yield from pack(0, (h[first] >> shift).astype(np.uint32), who[first], people, cells=cells_of(h[first]), n=np.minimum(count[first], 255).astype(np.uint8))
                many = count > 1
                yield from pack(1, doc_block(people, n_blocks)[who[many]], who[many], people, cells=cells_of(h[many]), n=NONE)
            held, n_held, n_people = [], 0, 0

        for b in slices(batches):
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            h, counts = grams(b.column(2).to_pylist())
            if sizes:
                own = np.stack([counts.astype(np.uint32), ids.view(np.uint32)[::2], ids.view(np.uint32)[1::2]], 1).ravel()
                three = np.repeat(np.arange(len(keys)), 3)
                yield from pack(2, doc_block(keys, n_blocks)[three], three, keys, cells=own, n=NONE)
            held.append((h, np.repeat(np.arange(n_people, n_people + len(keys), dtype=np.int32), counts), keys))
            n_held, n_people = n_held + len(h), n_people + len(keys)
            if n_held > 500_000:
                yield from settle()
        yield from settle()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py():
            return table
        people, runs, cells, n = unpack(table, np.dtype("<i8"), cells=np.uint32, n=np.uint8)
        order, starts = groups(cells)
        flag = np.zeros(len(cells), bool)
        flag[order] = spread(np.add.reduceat(n[order], starts, dtype=np.int64) > 1, starts, len(cells))
        flag &= n == 1  # a sender whose counter is higher knows
        who = np.repeat(np.arange(len(people)), runs)[flag]
        return tabled(pack(1, doc_block(people, n_blocks)[who], who, people, cells=cells[flag], n=NONE), table)

    def gather(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        marked, runs, cells = unpack(table.filter(pa.array(kinds == 1)), np.dtype("<i8"), cells=np.uint32)
        sized, _, own = unpack(table.filter(pa.array(kinds == 2)), np.dtype("<i8"), cells=np.uint32)
        keys, at = np.unique(np.append(sized, marked), return_inverse=True)
        n, ids = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        own = own.reshape(-1, 3)
        n[at[: len(sized)]] = own[:, 0]
        ids[at[: len(sized)]] = np.ascontiguousarray(own[:, 1:]).view(np.int64).ravel()
        both = np.unique(np.repeat(at[len(sized) :], runs).astype(U64) << U64(32) | cells)
        cut = np.searchsorted(both, np.arange(len(keys) + 1).astype(U64) << U64(32))
        c = both.astype(np.uint32)
        out = {"id": ids, "key": keys, "n": n, "cells": [c[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]}
        return pa.table(out, schema=pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("cells", pa.binary())]))

    merged = texts.mapInArrow(lean(send), rows).groupBy("kind", "block").applyInArrow(lean(merge), rows)
    return merged.groupBy("block").applyInArrow(lean(gather), "id long, key long, n long, cells binary")


# ------------------------------------------------------------------------- pass 2
@dataclass
class Marks:
    """Places of repeated units: ``table`` (id, key, spans binary: int32 start, end, merged), and the filter of its keys."""

    table: DataFrame
    bloom: Bloom | None


def mark_repeats(docs: DataFrame, units: Callable[[str | None], list[bytes]], k: int, prefilter: Callable[..., tuple[np.ndarray, np.ndarray]], within_doc: bool, short: bool, mb: int = 4, sizes: Callable[[list[bytes]], np.ndarray] | None = None, least: int = 0) -> Marks:
    """Marks every unit in a window of ``k`` units that also starts earlier: in a document with a smaller id
    (``within_doc``: or before in the same one). ``short``: a text of fewer units is one window. With ``sizes``, which
    gives the size of each unit, fewer units whose sizes come to ``least`` or more are a window, too.

    ``prefilter`` takes a text's unit hashes (with ``sizes``: and its windows) and gives (cells' hashes, the number of the
    cell that each window needs).
    """
    n_blocks = blocks_for(docs, mb)
    docs = keyed(docs)

    def windows(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return windows_by_size(sizes(found), k, least, short)

    flags = materialize(flagged_cells(docs, _grams(units, prefilter, windows if sizes else None), n_blocks).select("key", "cells"))
    touched = only(docs, Bloom.build(flags.select("key")), column="key").join(flags, "key").select("id", "key", "text", "cells")

    types = {"a": np.uint64, "b": np.uint64, "at": np.uint32}
    shift = U64(64 - (n_blocks.bit_length() - 1))
    rows = schema_of(types)

    def settled(a, b, people, at) -> np.ndarray:
        """True for rows that are not of the first document (or place) of their window, as far as these rows tell.
        Rows of one id are ordered by place, then key."""
        order, starts = groups_of_pairs(a, b)
        n = len(order)

        def least_of(values, late):
            v = np.where(late, np.iinfo(np.int64).max, values)
            return late | (v != spread(np.minimum.reduceat(v, starts), starts, n))

        late = least_of(people["id"][order], np.zeros(n, bool))
        if within_doc:
            late = least_of(at[order].astype(np.int64), late)
            late = least_of(people["key"][order], late)
        later = np.zeros(n, bool)
        later[order] = late
        return later

    def send(batches):
        words = WordHashes()
        held: list[tuple] = []
        people: list[tuple[int, int]] = []
        n_held = 0

        def settle():
            nonlocal held, people, n_held
            if n_held:
                a, b, who, at = (np.concatenate(x) for x in zip(*held, strict=True))
                known = np.array(people, WHO)
                late = settled(a, b, known[who], at)
                go = ~late
                yield from pack(0, (a[go] >> shift).astype(np.uint32), who[go], known, a=a[go], b=b[go], at=at[go])
                yield from pack(1, doc_block(known["key"], n_blocks)[who[late]], who[late], known, a=NONE, b=NONE, at=at[late])
            held, people, n_held = [], [], 0

        for batch in slices(batches):
            for d, key, t, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = units(t)
                h, g = words.both(found)
                start, w = windows(found) if sizes else windows_of_length(len(h), min(k, len(h)) if short else k)
                cells, need = prefilter(h, start, w) if sizes else prefilter(h)
                hit = np.isin(cells_of(cells), np.frombuffer(c, np.uint32))[need] if len(need) else np.empty(0, bool)
                for n in np.unique(w[hit]).tolist():
                    at = start[hit & (w == n)]
                    held.append((gram_hashes(h, n)[at], gram_hashes(g, n, 1)[at], np.full(len(at), len(people), np.int64), (at * (k + 1) + n).astype(np.uint32)))
                    n_held += len(at)
                people.append((d, key))
            if n_held > 500_000:
                yield from settle()
        yield from settle()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py():
            return table
        people, runs, a, b, at = unpack(table, WHO, **types)
        who = np.repeat(np.arange(len(people)), runs)
        late = settled(a, b, people[who], at)
        return tabled(pack(1, doc_block(people["key"], n_blocks)[who[late]], who[late], people, a=NONE, b=NONE, at=at[late]), table)

    def gather(table: pa.Table) -> pa.Table:
        people, runs, at = unpack(table, WHO, at=np.uint32)
        order = np.lexsort((people["id"], people["key"]))
        new = np.append(True, people[order][1:] != people[order][:-1])
        every, who = people[order][new], np.empty(len(order), np.int64)
        who[order] = np.cumsum(new) - 1
        both = np.unique(np.repeat(who, runs).astype(U64) << U64(32) | at)
        d, at, w = (both >> U64(32)).astype(np.int64), *np.divmod((both & U64(0xFFFFFFFF)).astype(np.int64), k + 1)
        # a run starts at a new text or after the end of all windows before
        base = d << 33
        end = np.maximum.accumulate(base + at + w)
        first = np.flatnonzero(np.append(True, (base + at)[1:] > end[:-1]))
        spans = np.stack([at[first], np.maximum.reduceat(at + w, first)], 1).astype(np.int32)
        cut = np.searchsorted(d[first], np.arange(len(every) + 1)).tolist()
        out = {"id": every["id"], "key": every["key"], "spans": [spans[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]}
        return pa.table(out, schema=pa.schema([("id", pa.int64()), ("key", pa.int64()), ("spans", pa.binary())]))

    merged = touched.mapInArrow(lean(send), rows).groupBy("kind", "block").applyInArrow(lean(merge), rows)
    marks = materialize(merged.groupBy("block").applyInArrow(lean(gather), "id long, key long, spans binary"))
    discard(flags)
    return Marks(marks, Bloom.build(marks.select("key")))


# ----------------------------------------------------------------------- windows
def windows_of_length(n: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of all windows of ``w`` of ``n`` units."""
    start = np.arange(max(n - w + 1, 0) if w else 0)
    return start, np.full(len(start), w, np.int64)


def windows_by_size(size: np.ndarray, k: int, least: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the windows: those of ``k`` units and shorter ones of size ``least`` or more; with ``short``
    a text of fewer units is one."""
    n, total = len(size), np.append(0, np.cumsum(size))
    parts = []
    for w in range(1, min(k, n) + 1):
        start, length = windows_of_length(n, w)
        some = (total[w:] - total[:-w] >= least) | (w == k) | (short and w == n)
        parts.append((start[some], length[some]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _grams(units, prefilter, windows=None):
    """``grams`` with word hashes that stay for a task."""
    words = WordHashes()

    def run(texts):
        found = [units(t) for t in texts]
        if isinstance(prefilter, WindowsOf):  # all texts of the batch at once
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            h = words.of([w for u in found for w in u])
            n = np.maximum(sizes - prefilter.k + 1, 0)
            ends = np.cumsum(sizes)
            at = np.repeat(ends - sizes - np.cumsum(n) + n, n) + np.arange(n.sum())
            return gram_hashes(h, prefilter.k)[at], n
        parts = [prefilter(words.of(u), *(windows(u) if windows else ()))[0] for u in found]
        return (np.concatenate(parts) if parts else np.empty(0, U64)), np.fromiter(map(len, parts), np.int64, len(parts))

    return run


class WindowsOf:
    """The prefilter that sketches every window: each window needs its own cell."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, h: np.ndarray):
        g = gram_hashes(h, self.k)
        return g, np.arange(len(g))


def winnow(k: int):
    """The prefilter that winnows: of each window of ``k`` unit hashes the smallest (of equals the last) is a fingerprint."""

    def run(h: np.ndarray):
        n = len(h)
        if not n:
            return h, np.empty(0, np.int64)
        w = min(k, n)
        v = mix(h)
        view = np.lib.stride_tricks.sliding_window_view(v, w)
        at = np.arange(n - w + 1) + (w - 1 - view[:, ::-1].argmin(1))
        chosen, need = np.unique(at, return_inverse=True)
        return v[chosen], need

    return run


def winnow_windows(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``winnow`` for windows of several lengths: a unit that is the fingerprint of several has one cell."""
    v = mix(h)
    at = np.empty(len(start), np.int64)
    for w in np.unique(length).tolist():
        some = length == w
        view = np.lib.stride_tricks.sliding_window_view(v, w)[start[some]]
        at[some] = start[some] + (w - 1 - view[:, ::-1].argmin(1))
    chosen, need = np.unique(at, return_inverse=True)
    return v[chosen], need


# ------------------------------------------------------------------------- pass 3
def with_marks(docs: DataFrame, marks: Marks, name: str = "q_spans") -> DataFrame:
    """``docs`` with ``name`` binary, null where nothing is marked; a column of that name is replaced, all others stay. Only
    texts that the filter names are shuffled."""
    docs = docs.drop(name)
    own, key = free_name(docs, "q_id"), free_name(docs, "q_key")
    d = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    d = d.withColumn(key, F.xxhash64(own, "text"))
    clear = only(d, marks.bloom, False, key).drop(own, key).withColumn(name, F.lit(None).cast("binary"))
    table = marks.table.select(F.col("id").alias(own), F.col("key").alias(key), F.col("spans").alias(name))
    hit = only(d, marks.bloom, True, key).join(table, [own, key], "left").drop(own, key)
    return clear.unionByName(hit)


def kept_units(units: list[bytes], spans: bytes | None) -> list[bytes]:
    if not spans:
        return units
    out, at = [], 0
    for a, b in np.frombuffer(spans, np.int32).reshape(-1, 2).tolist():
        out += units[at:a]
        at = b
    return out + units[at:]
