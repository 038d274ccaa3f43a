"""N-gram Jaccard join with prefix trees.

A text's set is its distinct runs of ``k`` words (a text of fewer words is one run). Two texts link when
|x & y| / |x | y| >= percent / 100, compared in whole numbers.

1. A text that links needs that share of its set in other texts. A sketch of all sets finds the texts that have it
   (it can only take too many); the rest of the corpus goes no further.
2. Equal sets become one representative. Over the representatives grams get their global order, rarest first. Two sets
   that link share a gram among the first n - ceil(t n) + 1 of each; representatives that share one meet in a cluster.
3. A cluster's sets are stored in a trie of globally ordered grams. Each set walks the trie once: overlaps of shared
   beginnings are counted once for all sets below, and a subtree is left when what remains can't reach the needed
   overlap, or when all its sets are linked with the walker already. Clusters of more than ``block`` sets are
   compared by pairs of blocks, so a task holds two blocks at most.
4. Links become components.

Grams are 64-bit hashes. Frequent grams (in more than ``total / 2**20`` representatives, so at most about a million)
are known to every task; all others meet in blocks. Nulls: a null text has an empty set and links with nothing; a null
doc_id is an id like any other, smaller than all. Rows that share an id count as one document, with the size of the
largest set and the links of all. Empty tables give empty results; other columns are left out (``dedup`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U64, Bloom, BlockSender, Forest, WordHashes, back_to_null, blocks_for, components, discard, doc_block, free_name, gram_hashes, lean, lower_ascii, materialize, only, sha, slices, unpack
from .repeats import flagged_cells, groups, keyed, spread


def gram_set(words: WordHashes, text: str | None, k: int) -> np.ndarray:
    h = words.of(lower_ascii(text).split())
    return np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else np.empty(0, U64)


def _grams(k: int):
    words = WordHashes()

    def run(texts):
        parts = [gram_set(words, t, k) for t in texts]
        return (np.concatenate(parts) if parts else np.empty(0, U64)), np.fromiter(map(len, parts), np.int64, len(parts))

    return run


def with_kind(batches, kind: int):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([kind] * b.num_rows, pa.int32()), *b.columns], names=["kind", *b.schema.names])


# ---------------------------------------------------------------------- trie
class Node:
    __slots__ = ("seg", "kids", "low", "high", "least", "most", "here", "one")

    def __init__(self, seg: np.ndarray, low: int, high: int, least: int, most: int):
        self.seg, self.low, self.high, self.least, self.most = seg, low, high, least, most
        self.kids: list[Node] = []
        self.here: list[int] = []  # sets that end here
        self.one = high - low == 1  # all sets below are known to be linked


def build_trie(sets: list[np.ndarray]) -> Node:
    """A path-compressed trie of ``sets``, which are in lexicographic order."""
    sizes = [len(s) for s in sets]
    common = []
    for x, y in zip(sets, sets[1:]):
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        common.append(int(differ[0]) if len(differ) else n)

    root = Node(np.empty(0, np.int64), 0, len(sets), min(sizes), max(sizes))
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        low = node.low
        while low < node.high and sizes[low] == depth:
            node.here.append(low)
            low += 1
        while low < node.high:
            high = low + 1
            while high < node.high and common[high - 1] > depth:
                high += 1
            to = sizes[low] if high - low == 1 else min([*common[low : high - 1], *sizes[low:high]])
            kid = Node(sets[low][depth:to], low, high, min(sizes[low:high]), max(sizes[low:high]))
            node.kids.append(kid)
            todo.append((kid, to))
            low = high
    return root


def trie_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of links whose trees are the components of all pairs that link."""
    if len(sets) < 2:
        return []
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -count))] = np.arange(len(every))  # what most sets share comes first, so beginnings are shared
    cut = np.cumsum([0, *map(len, sets)])
    ranked = [np.sort(rank[inverse[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
    sets, ids = [ranked[i] for i in order], [ids[i] for i in order]
    root, forest, out, parts = build_trie(sets), Forest(), [], len(sets)
    mine = np.zeros(len(every), bool)
    for x, s in enumerate(sets):
        if parts == 1:
            break
        mine[s] = True
        n = len(s)
        todo = [(root, 0, 0)]
        while todo:
            node, overlap, depth = todo.pop()
            if node.high <= x + 1 or (node.one and node.low != x and forest.find(node.low) == forest.find(x)):
                continue
            seg = node.seg
            if len(seg):
                overlap += int(mine[seg].sum())
                depth += len(seg)
                left = n - int(np.searchsorted(s, seg[-1], "right"))
            else:
                left = n
            # overlap needed for a set of size m: (100 + percent) * o >= percent * (n + m)
            if (100 + percent) * (overlap + min(left, node.most - depth)) < percent * (n + node.least):
                continue
            for y in node.here:
                if y > x and (100 + percent) * overlap >= percent * (n + len(sets[y])) and forest.union(x, y):
                    out.append((ids[x], ids[y]))
                    parts -= 1
            todo += [(kid, overlap, depth) for kid in node.kids]
            if not node.one and len({forest.find(y) for y in range(node.low, node.high)} if node.high - node.low <= 64 else "many") == 1:
                node.one = True
        mine[s] = False
    return out


# -------------------------------------------------------------------- cluster
def _edges_schema():
    return pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each gram, other documents, their gram's smallest document)."""
    order = np.lexsort((doc, gram))
    g, d = gram[order], doc[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    low = spread(d[starts], starts, len(order))
    far = d != low
    return order[starts], d[far], low[far]


def candidate_edges(reps: DataFrame, percent: int, n_blocks: int, frequent_of: int = 1 << 20) -> DataFrame:
    """(a, b) star edges between representatives that share a gram of their prefixes."""
    shift = U64(64 - (n_blocks.bit_length() - 1))
    block_of = lambda g: (g >> shift).astype(np.uint32)
    total = reps.agg(F.sum("n")).first()[0] or 0
    often = max(256, total // frequent_of)

    def count(batches):
        for b in batches:
            sets = [np.frombuffer(x, U64) for x in b.column(2).to_pylist()]
            if sets:
                g, n = np.unique(np.concatenate(sets), return_counts=True)
                s = BlockSender(["g", "df"], 1 << 62)
                yield from s.add(block_of(g), np.zeros(len(g), np.int64), g, n.astype(np.uint32))
                yield from s.flush()

    def frequent(table: pa.Table) -> pa.Table:
        _, g, n = unpack(table, {"g": np.uint64, "df": np.uint32})
        u, at = np.unique(g, return_inverse=True)
        df = np.bincount(at, n).astype(np.int64)
        return pa.table({"g": u[df > often].view(np.int64), "df": df[df > often]}, schema=pa.schema([("g", pa.int64()), ("df", pa.int64())]))

    rows = reps.mapInArrow(lean(count), BlockSender.schema(["g", "df"])).groupBy("block").applyInArrow(lean(frequent), "g long, df long")
    top = sorted((r["df"], r["g"] & (2**64 - 1)) for r in rows.collect())  # at most total / often, about 2**20
    hot = np.asarray([g for _, g in top], U64)
    by_value = np.argsort(hot)
    hot_sorted = hot[by_value]

    def hot_rank(g: np.ndarray) -> np.ndarray:
        """The place among the frequent grams, -1 for others."""
        if not len(hot):
            return np.full(len(g), -1)
        at = np.minimum(np.searchsorted(hot_sorted, g), len(hot) - 1)
        return np.where(hot_sorted[at] == g, by_value[at], -1)

    # every rep's rare grams go to blocks and come back with their frequency, if it is not 1
    names = ["g", "df"]
    schema = "kind int, " + BlockSender.schema(names)

    def send(batches):
        rare, own = BlockSender(names), BlockSender(names)
        for b in slices(batches):
            for rep, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                g = np.frombuffer(raw, U64)
                r = hot_rank(g)
                low = g[r < 0]
                yield from with_kind(rare.add(block_of(low), np.full(len(low), rep, np.int64), low, np.zeros(len(low), np.uint32)), 0)
                # the size travels as the frequency 0, frequent grams as 2**31 and their place
                r = np.sort(r[r >= 0])
                d = np.full(len(r) + 1, rep, np.int64)
                yield from with_kind(own.add(doc_block(d, n_blocks), d, np.append(U64(n), hot[r]), np.append(0, r + 2**31).astype(np.uint32)), 1)
        for kind, s in enumerate((rare, own)):
            yield from with_kind(s.flush(), kind)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py():
            return table
        d, g, _ = unpack(table, {"g": np.uint64, "df": np.uint32})
        order, starts = groups(g)
        df = spread(np.diff(np.append(starts, len(order))), starts, len(order))
        keep = order[df > 1]
        out = BlockSender(names, 1 << 62)
        made = [*out.add(doc_block(d[keep], n_blocks), d[keep], g[keep], df[df > 1].astype(np.uint32)), *out.flush()] if len(keep) else []
        return pa.Table.from_batches([*with_kind(made, 1)], table.schema) if made else table.slice(0, 0)

    out_schema = "kind int, a long, b long, " + BlockSender.schema(["g"])

    def prefixes(table: pa.Table) -> pa.Table:
        d, g, df = unpack(table, {"g": np.uint64, "df": np.uint32})
        order = np.lexsort((g, df, d))
        d, g, df = d[order], g[order], df[order]
        head = np.flatnonzero(df == 0)  # one for each rep: its size; its shared grams follow, rarest first
        end = np.append(head[1:], len(d))
        n = g[head].astype(np.int64)
        unique = n - (end - head - 1)
        take = np.clip(n - (percent * n + 99) // 100 + 1 - unique, 0, end - head - 1)
        at = np.repeat(head + 1 - np.cumsum(take) + take, take) + np.arange(take.sum())
        d, g = d[at], g[at]
        first, far, low = _stars(d, g)
        s = BlockSender(["g"], 1 << 62)
        packed = [*s.add(block_of(g[first]), d[first], g[first]), *s.flush()] if len(first) else []
        none = lambda b, t: pa.nulls(b, t)
        rows = [pa.RecordBatch.from_arrays([pa.array([0] * b.num_rows, pa.int32()), none(b.num_rows, pa.int64()), none(b.num_rows, pa.int64()), *b.columns], names=wanted.names) for b in packed]
        m = len(far)
        rows.append(pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(far), pa.array(low), pa.array(far.astype(np.int32) & 0x7FFF), *(none(m, pa.binary()) for _ in range(3))], names=wanted.names))
        return pa.Table.from_batches(rows, wanted)

    wanted = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("block", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("g", pa.binary())])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py():
            return table.select(["a", "b"])
        d, g = unpack(table, {"g": np.uint64})
        _, far, low = _stars(d, g)
        return pa.table({"a": far, "b": low}, schema=_edges_schema())

    merged = reps.select("rep", "n", "grams").mapInArrow(lean(send), schema).groupBy("kind", "block").applyInArrow(lean(merge), schema)
    return merged.groupBy("block").applyInArrow(lean(prefixes), out_schema).groupBy("kind", "block").applyInArrow(lean(meet), "a long, b long").distinct()


def cluster_links(reps: DataFrame, clusters: DataFrame, percent: int, n_parts: int, block: int = 4096) -> DataFrame:
    """(a, b): links between the ids of the sets of each cluster(node, component), enough to connect all that link."""
    sized = clusters.groupBy("component").agg(F.count("*").alias("m"))
    c = clusters.join(sized, "component").join(reps, F.col("node") == F.col("rep"))
    nb = F.ceil(F.col("m") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), nb).cast("int")
    # (i, j) of all pairs of blocks that hold this one; small clusters share parts
    pairs = F.transform(F.sequence(F.lit(0), nb - 1), lambda o: F.struct(F.least(o.cast("int"), mine).alias("i"), F.greatest(o.cast("int"), mine).alias("j")))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    c = c.withColumn("ij", F.explode(F.when(nb > 1, pairs).otherwise(whole)))
    part = F.when(nb > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(n_parts)))
    c = c.select(part.alias("part"), F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "component", F.col("id" if "id" in reps.columns else "rep").alias("rep"), "grams")

    def join(table: pa.Table) -> pa.Table:
        comp = table.column("component").to_numpy()
        a, b = [], []
        order = np.argsort(comp, kind="stable")
        cut = np.append(np.flatnonzero(np.append(True, comp[order][1:] != comp[order][:-1])), len(order))
        ids, raw = table.column("rep").to_numpy(), table.column("grams")
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            at = order[s:e]
            for x, y in trie_links(ids[at].tolist(), [np.frombuffer(raw[int(i)].as_py(), U64) for i in at], percent):
                a.append(x)
                b.append(y)
        return pa.table({"a": a, "b": b}, schema=_edges_schema())

    return c.groupBy("part", "i", "j").applyInArrow(lean(join), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, mb: int = 4) -> DataFrame:
    """(doc_id, n_shingles long, component_id long): a row for each id."""
    n_blocks = blocks_for(docs, mb)
    texts = keyed(docs)
    # 1. texts of which enough is shared; equal cells of one text may count as one, for which there is some slack
    sizes = materialize(flagged_cells(texts, _grams(k), n_blocks, sizes=True).select("id", "key", "n", (F.octet_length("cells") / 4).alias("shared")))
    slack = F.lit(2) + F.col("n") * F.col("n") / F.lit(float(1 << 32))
    wanted = sizes.filter((F.col("shared") > 0) & ((F.col("shared") + slack) * 100 >= F.col("n") * percent))

    # 2. their sets; equal ones become one
    def sets(batches):
        words = WordHashes()
        for b in slices(batches):
            g = [gram_set(words, t, k) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in g], pa.int64()), pa.array([sha(x.tobytes())[:32] for x in g]), pa.array([x.tobytes() for x in g], pa.binary())], names=["id", "key", "n", "same", "grams"])

    some = materialize(only(texts, Bloom.build(wanted.select("key")), column="key").mapInArrow(lean(sets), "id long, key long, n long, same string, grams binary").filter("n > 0"))
    first = F.min(F.struct("id", "key")).alias("first")
    heads = some.groupBy("same").agg(first).select("same", F.col("first.id").alias("head"))
    reps = materialize(some.groupBy("same").agg(first, F.first("n").alias("n"), F.first("grams").alias("grams")).select(F.col("first.key").alias("rep"), F.col("first.id").alias("id"), "n", "grams"))
    equal = some.select("id", "same").join(heads, "same").select(F.col("id").alias("a"), F.col("head").alias("b")).filter("a != b")
    # 3. clusters of candidates, and the links within
    clusters = components(candidate_edges(reps.select("rep", "n", "grams"), percent, n_blocks))
    links = cluster_links(reps, clusters, percent, n_blocks)
    # 4. components of all links
    found = components(links.unionByName(equal))
    for t in (some, reps, clusters):
        discard(t)
    out = sizes.groupBy(F.col("id").alias("doc_id")).agg(F.max("n").alias("n")).join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select(back_to_null("doc_id"), F.col("n").alias("n_shingles"), F.when(F.coalesce("component", "doc_id") != F.lit(NULL_ID), F.coalesce("component", "doc_id")).alias("component_id"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id (of a null id, that); all rows of that id
    stay. The columns stay as they are, whatever their names."""
    own = free_name(docs, "q_id")
    gone = materialize(near_duplicates(docs, k, percent).filter("not (component_id <=> doc_id)").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(own)))
    bloom = Bloom.build(gone)
    d = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    return only(d, bloom, False, own).unionByName(only(d, bloom, True, own).join(gone, own, "left_anti")).drop(own)
