"""Tokenizers for the chunkers: a function from a text to the places where its tokens start.

The default counts words. Vocabulary files are read on the executors, once a worker; their path is a parameter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Starts = Callable[[str], Sequence[int]]

# white space as the JVM's expressions see it
_WORD = re.compile(r"\S+", re.ASCII)
#: Fixed value: the public pattern that splits text before byte-level BPE.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(text: Column) -> Column:
    """The number of words, as an expression."""
    return F.regexp_count(text, F.lit(r"\S+"))


def words(text: str) -> list[int]:
    return [m.start() for m in _WORD.finditer(text)]


@lru_cache(4)
def _json(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_file(path: str) -> Starts:
    """The tokenizer that a JSON file of the tokenizers library describes."""
    return lambda text: [a for a, _ in _json(path).encode(text, add_special_tokens=False).offsets]


@lru_cache(4)
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_file(path: str, pattern: str = BYTE_PATTERN) -> Starts:
    """The byte-level tokenizer of a file of ranks; several tokens of one character start at the same place."""

    def starts(text: str) -> Sequence[int]:
        enc = _ranks(path, pattern)
        sizes = [len(enc.decode_single_token_bytes(t)) for t in enc.encode_ordinary(text)]
        at = np.cumsum([0, *sizes[:-1]]) if sizes else np.empty(0, int)
        # the character that holds a byte: one less than the characters begun by then
        begun = np.cumsum((np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80)
        return (begun[at] - 1).tolist() if sizes else []

    return starts


def with_count(df: DataFrame, column: str, starts: Starts = words, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text column: an expression for words, else a narrow Arrow pass."""
    if starts is words:
        return df.withColumn(name, F.coalesce(count_tokens(F.col(column)), F.lit(0)).cast("int"))
    from pyspark.sql import types as T

    out = df.drop(name)
    at = out.columns.index(column)

    def run(batches):
        for b in batches:
            n = pa.array([len(starts(t)) if t else 0 for t in b.column(at).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, n], names=[*b.schema.names, name])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(name, T.IntegerType())]))
