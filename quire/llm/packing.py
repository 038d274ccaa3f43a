"""Best-fit packing planned on the histogram of lengths.

1. Every document becomes ids plus an end id; longer ones are cut into full pieces, the first of which may be shorter.
   What is kept of a piece is its place, length and checksum, not its ids.
2. The histogram of lengths (at most ``size`` entries, whatever the input) goes to the driver, which fits counts, longest
   first, each into the fullest open sequences that still take it. The plan is a list of segments: ``n`` pieces of one
   length, by rank, go to consecutive sequences at one offset.
3. A piece gets a rank within its length, counted in buckets so that no length's pieces meet in one task, and finds its
   segment by (length, rank). Segments are at most ``size`` squared, however large the input.

The ids are those that the tokenizers library gives for the file as it is: a token that the file adds counts as that
token wherever its characters stand in a text, and the text around it is encoded on its own.

Nulls: a null text is empty, so it is the end id alone; a null doc_id is kept. Empty tables give empty results. Repeated
rows are packed each, told apart only by their places; a salt that is stored with each piece spreads them, so rows of one
id, or of one id and text, don't meet in one task. A very long text is encoded whole, and gives as many pieces as it
needs. Only doc_id and text of the documents are read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, slices

#: Fixed value: the public pattern that splits text before byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids(dict):
    """word -> its ids as bytes (uint32, little endian), for words that follow a space.

    Words meet only at single spaces with no white space beside them, where the splitting pattern always
    cuts, so a text's ids are its words' ids in a row. Any other text is encoded as a whole.
    """

    cap = 250_000

    def __init__(self, path: str):
        import tiktoken

        letters = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = {x["content"]: np.asarray([x["id"]], "<u4").tobytes() for x in told.get("added_tokens", [])}
        if any(x.get(f) for x in told.get("added_tokens", []) for f in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not known here")
        # of those that start at one place the longest counts
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        special = set(self.added)
        ranks = {bytes(letters[c] for c in w): i for w, i in told["model"]["vocab"].items() if w not in special}
        self.encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.encoder.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise ValueError
        out = self.whole(" " + word)
        if len(self) < self.cap and len(word) < 64:
            self[word] = out
        return out

    def of(self, text: str) -> bytes:
        if self.around is None or not self.around.search(text):
            return self.plain(text)
        return b"".join(self.added.get(part) or self.plain(part) for part in self.around.split(text))

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest:
            return self.whole(text) if text else b""
        try:
            if not first or first[-1].isspace():
                raise ValueError
            return self.whole(first) + b"".join(map(self.__getitem__, rest))
        except ValueError:
            return self.whole(text)


_loaded: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long[, ids array<int>]) for every piece of every document."""
    if size < 1:
        raise ValueError("size is at least 1")
    tail = np.asarray([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        ids = encoder(tokenizer_path)
        for b in slices(batches):
            doc, piece, start, length, crc, body = [], [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                buf = ids.of(t or "") + tail
                n, at, k = len(buf) // 4, 0, 0
                to = n % size or size
                while at < n:
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(memoryview(buf)[4 * at : 4 * to]))
                    if with_ids:
                        body.append(np.frombuffer(buf[4 * at : 4 * to], "<i4"))
                    at, to, k = to, to + size, k + 1
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(body, pa.list_(pa.int32()))] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts. Segments (length, first rank, pieces, first sequence, pieces a sequence, offset):
    the piece of rank first + i goes to sequence first + i // a-sequence at offset + (i % a-sequence) * length."""
    room: dict[int, list[list[int]]] = {}  # free places -> runs [first sequence, how many]
    out, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for free in sorted(x for x in room if x >= length):
            fit = free // length
            while left and room.get(free):
                first, n = room[free].pop()
                full = min(n, left // fit)
                if full:
                    out.append((length, rank, full * fit, first, fit, size - free))
                    room.setdefault(free - fit * length, []).append([first, full])
                    left, rank, first, n = left - full * fit, rank + full * fit, first + full, n - full
                if n and left and left < fit:
                    out.append((length, rank, left, first, left, size - free))
                    room.setdefault(free - left * length, []).append([first, 1])
                    rank, left, first, n = rank + left, 0, first + 1, n - 1
                if n:
                    room[free].append([first, n])
            if not room.get(free):
                room.pop(free, None)
            if not left:
                break
        if left:
            fit = size // length
            full = left // fit
            if full:
                out.append((length, rank, full * fit, made, fit, 0))
                room.setdefault(size - fit * length, []).append([made, full])
                left, rank, made = left - full * fit, rank + full * fit, made + full
            if left:
                out.append((length, rank, left, made, left, 0))
                room.setdefault(size - left * length, []).append([made, 1])
                made += 1
    return out


def pack(made: DataFrame, size: int = 1024, rows_per_bucket: int = 50_000) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``made`` is read three times, so give it materialized. A column salt, if it
    has one, spreads its rows, and is left out."""
    hist = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    segments = plan(hist, size)
    buckets = max(16, math.ceil(sum(hist.values()) / rows_per_bucket))
    salt = F.xxhash64("salt") if "salt" in made.columns else F.xxhash64("doc_id", "piece", "ids_crc32")
    m = made.withColumn("bucket", F.pmod(salt, F.lit(buckets)).cast("int")).drop("salt")
    sizes = m.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    offsets = sizes.select("length", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = m.withColumn("within", within).join(offsets, ["length", "bucket"]).withColumn("rank", (F.col("before") + F.col("within")).cast("long"))
    table = np.asarray(segments, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    # one sorted key for (length, rank): ranks are below 2**48
    keys = (table[:, 0] << 48) + table[:, 1]

    kept = [f for f in made.schema.fields if f.name != "salt"]
    names = [f.name for f in kept]
    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            s = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1] if len(length) else np.empty((0, 6), np.int64)
            i = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(s[:, 3] + i // np.maximum(s[:, 4], 1)), pa.array(s[:, 5] + i % np.maximum(s[:, 4], 1) * length)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(lean(place), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of ``docs`` with their sequence and offset. The table of pieces is written once to the shared folder."""
    return pack(materialize(pieces(docs, tokenizer_path, size, end_id).withColumn("salt", F.monotonically_increasing_id())), size)
