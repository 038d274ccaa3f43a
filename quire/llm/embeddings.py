"""Embedding near-dedup with hierarchical navigable small-world graphs, one for each shard.

Vectors are compared only within a label (and a dimension). Equal vectors become one representative with a count. A
label's representatives are dealt by hash to shards of about ``rows_per_shard``; each shard gets a graph. Every shard
is queried with every vector of the label: a task takes two shards, searches each one's graph for the other's vectors
(or its own) and widens beams: those of single queries while their last place still reaches the threshold, and all
of them until an audit on a sample of queries, which are compared with every vector of the shard, finds ``recall`` of the true
links. The sample grows until it holds 100 true links, or all queries. Candidates are verified by cosine in double
precision. The graph is searched whatever the size of the shard; a query whose matches would fill a quarter of the shard
is compared in full instead of with so wide a beam. A task holds the links of two shards as bits and sends each vector's
number of links and stars of its components, not its pairs; components are united. ``measured_recall`` compares the
links of a sample of vectors with a full comparison.

Nulls: vectors that are null or empty, zero, or hold null or non-finite components, and those without a label, link
with nothing. Rows that repeat a vec_id count once, the one with the smallest (label, vector); a null id is an id like
any other, the smallest. Empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U64, Forest, components, discard, lean, materialize, mix


class Graph:
    """A small-world graph over the rows of ``x`` (unit vectors, float32), built in growing batches.

    Level l holds the rows whose level is l or more; rows are sorted by level, so a level is a prefix of the rows.
    """

    def __init__(self, x: np.ndarray, links: list[np.ndarray]):
        self.x, self.links = x, links

    @staticmethod
    def levels(ids: np.ndarray, m: int) -> np.ndarray:
        u = (mix(ids.view(U64)) >> U64(11)).astype(np.float64) / 2.0**53
        return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int)

    @classmethod
    def build(cls, x: np.ndarray, levels: np.ndarray, m: int = 8, beam: int = 32, batch: int = 256) -> Graph:
        """``levels`` is in descending order."""
        g = cls(x, [])
        for level in range(int(levels.max(initial=0)), -1, -1):
            n = int((levels >= level).sum())
            width = 2 * m if level == 0 else m
            own = np.full((n, width), -1, np.int32)
            g.links.insert(0, own)
            done = min(n, 1)
            while done < n:
                rows = np.arange(done, min(n, done + min(batch, max(1, done))))
                near, sim = g._beam(x[rows], g._descend(x[rows], 1, done), own, beam, done)
                # besides what the graph holds, the rows of the batch themselves, earlier ones only
                inner = x[rows] @ x[rows].T
                inner[np.triu_indices(len(rows))] = -np.inf
                near = np.hstack([near, np.broadcast_to(rows, inner.shape)])
                sim = np.hstack([sim, inner])
                near = np.where(np.isfinite(sim), near, -1)
                own[rows, :m] = g._choose(near, sim, m)
                done = int(rows[-1]) + 1
                g._back(own, rows, m)
        return g

    def _choose(self, near: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """Of candidates, nearest first, those nearer to the row than to any chosen one; free places take the nearest left."""
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 4 * m]
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        v = self.x[near]
        among = np.matmul(v, v.transpose(0, 2, 1))
        b, c = near.shape
        chosen, count = np.zeros((b, c), bool), np.zeros(b, int)
        for j in range(c):
            ok = (near[:, j] >= 0) & (count < m) & ~((among[:, j] > sim[:, j, None]) & chosen).any(1)
            chosen[:, j] = ok
            count += ok
        rank = np.where(near < 0, 2, np.where(chosen, 0, 1)) * c + np.arange(c)
        first = np.argsort(rank, axis=1)[:, :m]
        out = np.take_along_axis(near, first, 1)
        if out.shape[1] < m:
            out = np.hstack([out, np.full((b, m - out.shape[1]), -1, out.dtype)])
        return out

    def _back(self, own: np.ndarray, rows: np.ndarray, m: int) -> None:
        """Add the links the other way; a row with too many chooses again."""
        src = np.repeat(rows, m)
        dst = own[rows, :m].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        cut = np.append(np.flatnonzero(np.append(True, dst[1:] != dst[:-1])), len(dst))
        full = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at = dst[a]
            free = np.flatnonzero(own[at] < 0)
            new = src[a:b]
            new = new[~np.isin(new, own[at])]
            if len(new) <= len(free):
                own[at, free[: len(new)]] = new
            else:
                full.append((at, np.append(own[at][own[at] >= 0], new)))
        if full:
            width = own.shape[1]
            wide = max(len(c) for _, c in full)
            at = np.asarray([a for a, _ in full])
            near = np.full((len(full), wide), -1, np.int64)
            for i, (_, c) in enumerate(full):
                near[i, : len(c)] = c
            sim = np.einsum("bmd,bd->bm", self.x[near], self.x[at])
            own[at] = self._choose(near, np.where(near >= 0, sim, -np.inf), width)

    def _descend(self, q: np.ndarray, to: int, limit: int) -> np.ndarray:
        """For each query the row of level ``to`` where a greedy walk down from the top ends (row 0 without such levels)."""
        at = np.zeros((len(q), 1), np.int64)
        for links in self.links[:0:-1]:
            if len(links) <= limit:
                at = self._beam(q, at, links, 1, len(links))[0][:, :1]
        return at

    def _beam(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, beam: int, limit: int, step: int = 4):
        """(rows, similarities), the best ``beam`` that the walk from ``entry`` meets among the first ``limit`` rows."""
        b, x = len(q), self.x
        seen = np.zeros((b, limit), bool)
        each = np.arange(b)[:, None]
        near = np.full((b, beam), -1, np.int64)
        sim = np.full((b, beam), -np.inf, np.float32)
        opened = np.ones((b, beam), bool)
        near[:, : entry.shape[1]] = entry
        sim[:, : entry.shape[1]] = np.einsum("bmd,bd->bm", x[entry], q)
        opened[:, : entry.shape[1]] = False
        seen[each, entry] = True
        step = min(step, beam)
        live = np.arange(b)
        while len(live):
            s = np.where(opened[live], -np.inf, sim[live])
            best = np.argpartition(-s, step - 1, 1)[:, :step] if step < beam else np.argsort(-s, 1)
            value = np.take_along_axis(s, best, 1)
            some = np.isfinite(value)
            go = some.any(1)
            live, best, some = live[go], best[go], some[go]
            if not len(live):
                break
            opened[live[:, None], best] = True
            rows = np.where(some, near[live[:, None], best], -1)
            new = np.where(rows[:, :, None] >= 0, links[rows], -1).reshape(len(live), -1).astype(np.int64)
            new[new >= limit] = -1
            # a row met twice in one step counts once
            new = np.sort(new, 1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            old = seen[live[:, None], new]
            new[old] = -1
            seen[live[:, None], np.where(new < 0, 0, new)] |= new >= 0
            s = np.einsum("bmd,bd->bm", x[new], q[live])
            s = np.where(new >= 0, s, -np.inf)
            all_sim, all_near = np.hstack([sim[live], s]), np.hstack([near[live], new])
            all_open = np.hstack([opened[live], new < 0])
            top = np.argpartition(-all_sim, beam - 1, 1)[:, :beam]
            sim[live], near[live], opened[live] = (np.take_along_axis(v, top, 1) for v in (all_sim, all_near, all_open))
        order = np.argsort(-sim, 1)
        return np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)

    def search(self, q: np.ndarray, beam: int, batch: int = 256):
        n = len(self.x)
        near, sim = [], []
        for a in range(0, len(q), batch):
            part = q[a : a + batch]
            r = self._beam(part, self._descend(part, 1, n), self.links[0], beam, n)
            near.append(r[0])
            sim.append(r[1])
        return (np.vstack(near), np.vstack(sim)) if near else (np.empty((0, beam), np.int64), np.empty((0, beam), np.float32))


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow or underflow of squares
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def exact_pairs(a: np.ndarray, b: np.ndarray, threshold: float, rows: int = 128):
    """Index pairs with cosine >= threshold, by full comparison, a block of rows of ``a`` at a time."""
    for at in range(0, len(a), rows):
        i, j = np.nonzero(a[at : at + rows] @ b.T >= threshold)
        if len(i):
            yield i + at, j


class Links:
    """The links between n rows and m columns as two bit matrices (the second transposed), so that a group of near copies
    costs n x m / 4 bytes and not its pairs."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.bits = (np.zeros((n, (m + 7) // 8), np.uint8), np.zeros((m, (n + 7) // 8), np.uint8))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for bits, x, y in ((self.bits[0], i, j), (self.bits[1], j, i)):
            np.bitwise_or.at(bits.reshape(-1), x * bits.shape[1] + (y >> 3), np.uint8(1) << (y & 7).astype(np.uint8))

    def weights(self, side: int, weight: np.ndarray, rows: int = 1024) -> np.ndarray:
        """The sum of the other side's ``weight`` over the links of each row (side 0) or column (side 1)."""
        bits = self.bits[side]
        part = [np.unpackbits(bits[a : a + rows], axis=1, count=len(weight), bitorder="little") @ weight for a in range(0, len(bits), rows)]
        return np.concatenate(part) if part else np.empty(0, np.int64)

    def members(self, side: int, mask: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(mask, count=(self.m, self.n)[side], bitorder="little"))

    def trees(self):
        """(rows, columns) of each component with a link; every row and column is opened once."""
        todo = self.bits[0].any(1)
        for r in range(self.n):
            if not todo[r]:
                continue
            rows, cols = np.asarray([r]), np.empty(0, np.int64)
            seen = np.zeros(self.bits[0].shape[1], np.uint8)
            mine, new_rows = [rows], rows
            todo[r] = False
            while len(new_rows):
                reached = np.bitwise_or.reduce(self.bits[0][new_rows], axis=0) & ~seen
                seen |= reached
                new_cols = self.members(0, reached)
                cols = np.append(cols, new_cols)
                if not len(new_cols):
                    break
                back = self.members(1, np.bitwise_or.reduce(self.bits[1][new_cols], axis=0))
                new_rows = back[todo[back]]
                todo[new_rows] = False
                mine.append(new_rows)
            yield np.concatenate(mine), cols


def link_blocks(queries: np.ndarray, g: Graph, exact: np.ndarray, threshold: float, recall: float, beam: int = 24, audit: int = 48, links: int = 100, same: bool = False):
    """(query, row) index pairs with cosine >= threshold in blocks: the graph is searched with widening beams, audited, and
    what it finds is verified in double precision.

    The audit compares queries in full until it holds ``links`` true links (``same``: queries are the rows themselves, which
    match themselves; that is no link), and beams double until the search finds ``recall`` of them. Two cases end in a full
    comparison, block by block: single queries whose matches fill a quarter of the shard, and an audit that holds all queries
    or that a beam as wide as the shard fails, as with a graph that isn't connected."""
    n, near_enough = len(exact), np.float32(threshold - 1e-4)
    if not n or not len(queries):
        return
    order = np.argsort(mix(np.arange(len(queries), dtype=U64)), kind="stable")
    true, held, at = [], 0, 0
    while held < links and at < len(queries):
        part = order[at : at + max(audit, at)]
        for i, j in exact_pairs(queries[part], exact, threshold):
            i = part[i]
            if same:
                i, j = i[i != j], j[i != j]
            if held < 100 * links:  # of an audit query with very many links some are enough
                true.append(i * n + j)
            held += len(i)
        at += len(part)
    true = np.concatenate([np.empty(0, np.int64), *true])
    q32 = queries.astype(np.float32)
    while True:
        hits = np.zeros(len(true), bool)
        todo, wide = np.arange(len(queries)), min(beam, n)
        while len(todo):
            open_ones = []
            rows = max(8, min(256, (1 << 22) // max(n, 64 * wide)))
            for a in range(0, len(todo), rows):
                some = todo[a : a + rows]
                near, sim = g.search(q32[some], wide, rows)
                open_end = (sim[:, -1] >= near_enough) & (wide < n)  # the last place still reaches the threshold: look further
                open_ones.append(some[open_end])
                i, k = np.nonzero((sim >= near_enough) & ~open_end[:, None])
                i, j = some[i], near[i, k]
                ok = np.einsum("nd,nd->n", queries[i], exact[j]) >= threshold
                i, j = i[ok], j[ok]
                hits |= np.isin(true, i * n + j)
                yield i, j  # true links, whatever the audit says
            todo, wide = np.concatenate(open_ones), min(4 * wide, n)
            if len(todo) and 4 * wide > n:
                break
        hits |= np.isin(true // n, todo)  # those are compared in full
        if len(true) - int(hits.sum()) <= (1 - recall) * len(true):
            for i, j in exact_pairs(queries[todo], exact, threshold):
                yield todo[i], j
            if at >= len(queries) and held < links:  # all were compared for the audit: nothing of that is left out
                yield true // n, true % n
            return
        if beam >= n:
            yield from exact_pairs(queries, exact, threshold)
            return
        beam *= 2


def query(*args, **named) -> tuple[np.ndarray, np.ndarray]:
    """``link_blocks`` as a whole, each pair once."""
    pairs = [np.stack(x, 1) for x in link_blocks(*args, **named)]
    both = np.unique(np.concatenate([np.empty((0, 2), np.int64), *pairs]), axis=0)
    return both[:, 0], both[:, 1]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, rows_per_shard: int = 16_384, recall: float = 0.98) -> DataFrame:
    """(vec_id, n_links long, component_id long, kept boolean): a row for each id."""
    v = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    v = v.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    reps = materialize(v.filter(good).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    reps = reps.withColumn("dim", F.size("v"))
    shards = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(rows_per_shard)).cast("int").alias("shards"))
    dealt = reps.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep", F.lit("shard")), F.col("shards")).cast("int"))
    kind = vectors.schema["label"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        levels = Graph.levels(ids, 8)
        order = np.lexsort((ids, -levels))
        x = unit(np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(ids), -1))[order]
        g = Graph.build(x.astype(np.float32), levels[order])
        raw = dump(ids=ids[order], copies=table.column("copies").to_numpy()[order], x=x, **{f"l{i}": a for i, a in enumerate(g.links)})
        return table.slice(0, 1).select(["label", "dim", "shards", "shard"]).append_column("pack", pa.array([raw], pa.binary()))

    packs = materialize(dealt.groupBy("label", "dim", "shard").applyInArrow(lean(build), f"label {kind}, dim int, shards int, shard int, pack binary"))
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    low = packs.withColumn("other", every).filter("shard <= other").select("label", "dim", F.col("shard").alias("i"), F.col("other").alias("j"), F.col("pack").alias("p"))
    high = packs.withColumn("other", every).filter("other <= shard").select("label", "dim", F.col("other").alias("i"), F.col("shard").alias("j"), F.when(F.col("other") != F.col("shard"), F.col("pack")).alias("q"))

    def search(batches):
        for b in batches:
            for raw_p, raw_q in zip(b.column(0), b.column(1), strict=True):
                p = load(raw_p.as_py())
                q = load(raw_q.as_py()) if raw_q.is_valid else p
                graph = lambda z: Graph(z["x"].astype(np.float32), [z[f"l{i}"] for i in range(sum(k[0] == "l" for k in z))])
                links = Links(len(q["x"]), len(p["x"]))
                for i, j in link_blocks(q["x"], graph(p), p["x"], threshold, recall, same=q is p):
                    if q is p:
                        i, j = i[i != j], j[i != j]
                        links.add(j, i)
                    links.add(i, j)
                if q is not p:
                    for j, i in link_blocks(p["x"], graph(q), q["x"], threshold, recall):
                        links.add(i, j)
                for side, ids, other in ((0, q["ids"], p["copies"]), (1, p["ids"], q["copies"]))[: 1 if q is p else 2]:
                    n = links.weights(side, other)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.nulls(int((n > 0).sum()), pa.int64()), pa.array(n[n > 0].astype(np.int64))], names=["a", "b", "n"])
                a, c = [], []
                for rows, cols in links.trees():
                    ids = np.append(q["ids"][rows], p["ids"][cols])
                    a.append(ids)
                    c.append(np.full(len(ids), ids.min()))
                a, c = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, c))
                yield pa.RecordBatch.from_arrays([pa.array(a[a != c]), pa.array(c[a != c]), pa.nulls(int((a != c).sum()), pa.int64())], names=["a", "b", "n"])

    found = materialize(low.join(high, ["label", "dim", "i", "j"]).select("p", "q").mapInArrow(lean(search), "a long, b long, n long"))
    degree = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    comps = components(found.filter("b is not null").select("a", "b"))
    discard(packs)
    per_rep = reps.join(degree, F.col("rep") == F.col("a"), "left").join(comps, F.col("rep") == F.col("node"), "left")
    per_rep = per_rep.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = v.withColumn("key", F.when(good, F.col("v"))).join(per_rep, (F.col("label") == F.col("l")) & (F.col("key") == F.col("w")), "left")
    back = lambda c: F.when(c != F.lit(NULL_ID), c)
    component = F.coalesce("component", "vec_id")
    return out.select(back(F.col("vec_id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), back(component).alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def measured_recall(vectors: DataFrame, result: DataFrame, threshold: float = 0.93, queries: int = 300) -> tuple[int, int]:
    """(links found, true links) of the ``queries`` vectors first by hash among those that truly have links or were given
    some: the result's n_links against a full comparison. The sample is bounded, so it is broadcast."""
    some = vectors.filter("label is not null and embedding is not null and vec_id is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    sample = some.orderBy(F.xxhash64("vec_id", F.lit("audit")), "vec_id").limit(4 * queries).collect()
    kept: dict = {}
    for r in sample:
        if r["v"] and all(x is not None and np.isfinite(x) for x in r["v"]) and any(r["v"]):
            kept.setdefault((r["label"], len(r["v"])), []).append((r["vec_id"], r["v"]))
    kept = {k: (np.asarray([i for i, _ in x]), unit(np.asarray([v for _, v in x]))) for k, x in kept.items()}

    def run(batches):
        for b in batches:
            by: dict = {}
            for i, label, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if v and (label, len(v)) in kept and all(x is not None and np.isfinite(x) for x in v) and any(v):
                    by.setdefault((label, len(v)), []).append((i, v))
            for key, x in by.items():
                ids, u = kept[key]
                near = u @ unit(np.asarray([v for _, v in x])).T >= threshold
                near &= ids[:, None] != np.asarray([i for i, _ in x])[None]
                n = near.sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["vec_id", "n"])

    true = some.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    chosen = true.orderBy(F.xxhash64("vec_id", F.lit("audit")), "vec_id").limit(queries)
    row = chosen.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("n", "n_links")).alias("found"), F.sum("n").alias("links")).first()
    return row["found"] or 0, row["links"] or 0
