"""Shared pieces of the training-data operators.

* ``materialize`` cuts lineage with a Parquet table in the folder of
  ``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor
  costs only the tasks after the table.
* Block shuffles: instead of one row per n-gram, a map task sends one row per
  (block of the hash space, some MB of text) with packed numpy arrays. A block is
  sized from the input, so what one reducer holds is bounded, and a frequent
  n-gram is counted per sender before it is sent.
* ``Bloom`` is a filter of fixed size that decides which texts take part in a
  join; its false positives only add rows that the join then leaves alone.
* ``components`` is the alternating large-star/small-star algorithm.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import inspect
import math
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
NULL_ID = -(2**63)  # stands for a null id while rows are processed


# --------------------------------------------------------------------- storage
def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master that names none."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d is None:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = jdir.get() if jdir.isDefined() else None
    if d is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing lazy reads it."""
    path = getattr(df, "_quire_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, from file sizes, without a pass over the data; where it knows none (it then says
    petabytes), the bytes of the texts are summed up."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 50 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def blocks_for(df: DataFrame, mb: int = 4, least: int = 16) -> int:
    """A power of two of blocks, one for each ``mb`` MB of input, whatever its size: what a block holds doesn't grow."""
    n = max(least, math.ceil(input_bytes(df) / (mb << 20)))
    return 1 << (n - 1).bit_length()


# ---------------------------------------------------------------------- memory
def tidy() -> None:
    """Give freed memory back: workers are used again, and one that keeps what its largest task had starves the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


LARGE = 1 << 20  # smaller groups leave nothing worth the call


def lean(fn):
    """An Arrow function (over batches, or of a group) that tidies up after itself."""
    if inspect.isgeneratorfunction(fn):

        def run(batches):
            try:
                yield from fn(batches)
            finally:
                tidy()

    elif len(inspect.signature(fn).parameters) == 1:

        def run(table: pa.Table) -> pa.Table:
            try:
                return fn(table)
            finally:
                if table.nbytes > LARGE:
                    tidy()

    else:

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            try:
                return fn(key, table)
            finally:
                if table.nbytes > LARGE:
                    tidy()

    return run


# --------------------------------------------------------------------- hashing
class WordHashes(dict):
    """word (bytes) -> its place in two arrays of independent 64-bit hashes; forgets all beyond ``cap`` words between texts."""

    cap = 200_000

    def __init__(self):
        super().__init__()
        self.low, self.high = np.empty(1 << 16, U64), np.empty(1 << 16, U64)

    def __missing__(self, w: bytes) -> int:
        i = len(self)
        if i == len(self.low):
            self.low, self.high = np.resize(self.low, 2 * i), np.resize(self.high, 2 * i)
        h = xxhash.xxh3_128_intdigest(w)
        self.low[i], self.high[i] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        self[w] = i
        return i

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.cap:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def of(self, words: list[bytes]) -> np.ndarray:
        at = self.places(words)
        return self.low[at]

    def both(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = self.places(words)
        return self.low[at], self.high[at]


_MUL = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _MUL[seed]
        acc += h[j : j + n]
    return mix(acc + U64(k))


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case, other letters as they are."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# --------------------------------------------------------------------- columns
def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as int64, null as NULL_ID."""
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_prefix(df: DataFrame, prefix: str = "q_") -> str:
    """``prefix``, with underscores until no column of ``df`` starts so."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def back_to_null(name: str = "doc_id"):
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name)).alias(name)


def slices(batches, n_bytes: int = 6 << 20):
    """Arrow batches in pieces of about ``n_bytes``, so that what a worker holds doesn't follow the batch size."""
    for b in batches:
        if b.num_rows == 0:
            continue
        rows = max(1, int(b.num_rows * n_bytes / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


# ---------------------------------------------------------------- block shuffle
class BlockSender:
    """Collects (block, doc, payload arrays) and gives packed rows, one for each block, when some MB are there.

    Rows: block int, docs binary (int64), counts binary (int32 entries a doc), one binary for each payload.
    """

    def __init__(self, names: list[str], flush_at: int = 750_000):
        self.names, self.flush_at = names, flush_at
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, block: np.ndarray, doc: np.ndarray, *payload: np.ndarray):
        self.parts.append((block.astype(np.uint32, copy=False), doc, *payload))
        self.n += len(block)
        if self.n >= self.flush_at:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        block, doc, *payload = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.argsort(block if block.max() > 65535 else block.astype(np.uint16), kind="stable")
        block, doc, payload = block[order], doc[order], [p[order] for p in payload]
        ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block))
        start, rows = 0, {x: [] for x in ("block", "docs", "counts", *self.names)}
        for end in ends:
            d = doc[start:end]
            cut = np.append(0, np.flatnonzero(d[1:] != d[:-1]) + 1)
            rows["block"].append(int(block[start]))
            rows["docs"].append(d[cut].tobytes())
            rows["counts"].append(np.diff(np.append(cut, len(d))).astype(np.int32).tobytes())
            for name, p in zip(self.names, payload, strict=True):
                rows[name].append(p[start:end].tobytes())
            start = end
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("block", pa.int32()), *((x, pa.binary()) for x in ("docs", "counts", *self.names))]))

    @staticmethod
    def schema(names: list[str]) -> str:
        return "block int, docs binary, counts binary" + "".join(f", {x} binary" for x in names)


def unpack(table: pa.Table, payload: dict[str, type]) -> tuple[np.ndarray, ...]:
    """(doc of each entry, payload arrays) of the packed rows of a block."""
    buf = lambda name, t: [np.frombuffer(x, t) for x in table.column(name).to_pylist()]
    docs, counts = np.concatenate(buf("docs", np.int64)), np.concatenate(buf("counts", np.int32))
    return (np.repeat(docs, counts), *(np.concatenate(buf(n, t)) for n, t in payload.items()))


def doc_block(doc: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of a doc id, spread evenly whatever the ids."""
    return (mix(doc.view(U64) + U64(0x1234567)) >> U64(40)).astype(np.uint32) & np.uint32(n_blocks - 1)


# ----------------------------------------------------------------------- bloom
class Bloom:
    """A Bloom filter over int64 ids: 16 bits an id, ``MOST`` bytes at most; for more ids than that serves, ``build`` gives
    None and ``only`` takes every row, so the join that follows does the work.

    Built on the executors: each partition sends the parts of its filter that are not empty, and
    reducers unite them; the driver gets the finished filter only.
    """

    PART, MOST = 1 << 16, 32 << 20

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _slots(ids: np.ndarray, m: int):
        h = mix(ids.astype(np.int64).view(U64))
        lo, hi = h & U64(0xFFFFFFFF), h >> U64(32) | U64(1)
        return [((lo + U64(i) * hi) & U64(m - 1)).astype(np.int64) for i in range(4)]

    @classmethod
    def build(cls, ids: DataFrame) -> "Bloom | None":
        n, part = ids.count(), cls.PART
        if n > 2 * cls.MOST:  # under 4 bits an id
            return None
        n_bytes = min(cls.MOST, 1 << max(16, (2 * n).bit_length()))
        m = n_bytes * 8

        def partial(batches):
            bits = np.zeros(n_bytes, np.uint8)
            for b in batches:
                for s in Bloom._slots(ids_of(b.column(0)), m):
                    np.bitwise_or.at(bits, s >> 3, np.uint8(1) << (s & 7).astype(np.uint8))
            used = [i for i in range(0, n_bytes, part) if bits[i : i + part].any()]
            yield pa.RecordBatch.from_pydict({"at": used, "bits": [bits[i : i + part].tobytes() for i in used]}, schema=pa.schema([("at", pa.int64()), ("bits", pa.binary())]))

        def unite(table: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
            return pa.table({"at": table.column("at").slice(0, 1).cast(pa.int64()), "bits": [bits.tobytes()]}, schema=pa.schema([("at", pa.int64()), ("bits", pa.binary())]))

        parts = ids.mapInArrow(lean(partial), "at long, bits binary").groupBy("at").applyInArrow(unite, "at long, bits binary")
        bits = np.zeros(n_bytes, np.uint8)
        for r in parts.collect():  # at most n_bytes in all
            bits[r["at"] : r["at"] + part] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits)

    def has(self, ids: np.ndarray) -> np.ndarray:
        ok = np.ones(len(ids), bool)
        for s in self._slots(ids, len(self.bits) * 8):
            ok &= (self.bits[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)
        return ok


def only(docs: DataFrame, bloom: Bloom | None, inside: bool = True, column: str = "doc_id") -> DataFrame:
    """The rows whose ``column`` the filter has (or has not); null is NULL_ID for it. Without a filter: all (none)."""
    if bloom is None:
        return docs if inside else docs.filter(F.lit(False))
    at = docs.columns.index(column)

    def run(batches):
        for b in slices(batches):
            ok = bloom.has(ids_of(b.column(at)))
            if (k := b.filter(pa.array(ok if inside else ~ok))).num_rows:
                yield k

    return docs.mapInArrow(lean(run), docs.schema)


# ------------------------------------------------------------------ components
class Forest:
    """Union-find over int64 ids in one task; the smallest id is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node long, component long), component the smallest node reachable.

    Each partition first reduces its edges to stars, then large-star and small-star steps alternate until
    nothing changes; every round is written to the shared folder. Nodes without edges are not returned.
    """
    star = "a long, b long"

    def local(batches):
        f = Forest()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x != y:
                    f.union(x, y)
        nodes = [x for x in f.up if f.find(x) != x]
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"a": part, "b": [f.find(x) for x in part]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        j = both.join(least, "u")
        if large:
            out = j.filter("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = j.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.filter("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.distinct()

    def sign(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    e = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(lean(local), star).distinct())
    seen = sign(e)
    while seen["n"]:  # every round that changes something lowers labels, so this ends
        # small-star wants each edge from its larger end to its smaller end
        big = step(e, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        nxt = materialize(step(big, False))
        now = sign(nxt)
        discard(e)
        e = nxt
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._quire_path = getattr(e, "_quire_path", None)
    return out


# --------------------------------------------------------------------- mapping
def annotate(docs: DataFrame, fields: str, fn, needs: list[str]) -> DataFrame:
    """``docs`` with the columns of ``fields`` (a DDL string) appended; ``fn`` makes their arrays from a batch of ``needs``.

    A column of ``docs`` that has the name of a new one is replaced by it; all others pass through untouched.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string(fields)
    keep = [f for f in docs.schema.fields if f.name.lower() not in {x.name.lower() for x in new.fields}]
    # a needed column that is about to be replaced travels under another name
    prefix = free_prefix(docs, "__in_")
    src = docs.select(*[F.col(f"`{f.name}`") for f in keep], *[F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in enumerate(needs)])
    n = len(keep)

    def run(batches):
        for b in slices(batches):
            out = fn(*b.columns[n:])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *out], names=[*(f.name for f in keep), *(f.name for f in new.fields)])

    return src.mapInArrow(lean(run), T.StructType([*keep, *new.fields]))
