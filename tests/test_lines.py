"""The line chunker: nothing lost, nothing too long, nothing cut that needn't be; tokenizers of vocabulary files."""

import random
import re

import pytest

from quire.functions import tokens
from quire.operators.chunk import line_windows, pack_lines, split_text


def texts(n=300, seed=3):
    r = random.Random(seed)
    for _ in range(n):
        lines = ["".join(r.choice(["a", "bb", "ccc "]) + r.choice([" ", "  ", "\t"]) for _ in range(r.choice([0, 1, 3, 9, 30]))) for _ in range(r.randint(1, 8))]
        yield "\n".join(lines) + r.choice(["", "\n"]), r.randint(1, 12)


def size(t):
    return len(re.findall(r"\S+", t))


def test_windows_are_greedy_and_whole():
    for text, limit in texts():
        w = list(line_windows(text, limit))
        assert "".join(text[a:b] for a, b, *_ in w) == (text if text.split() else "")
        for (a, b, cut, _), nxt in zip(w, [*w[1:], None][: len(w)], strict=True):
            assert size(text[a:b]) <= limit
            if nxt is None:
                continue
            line = text[b:].split("\n")[0]
            if cut:
                # the line was too long for any window, and the window is full
                start = max(text.rfind("\n", 0, b) + 1, a)
                assert size(text[start:].split("\n")[0]) > limit or start == a
                assert size(text[a:b]) == limit
            else:
                assert text[b - 1] == "\n" and (size(text[a:b]) + size(line) > limit)


def test_prefix_comes_on_every_chunk_or_where_it_fits():
    text = "one two\nthree four five\nsix\n" + " ".join("abcdefghij")
    assert pack_lines(text, 5, "P: ") == ["P: one two\n", "P: three four five\nsix\n", "P: \na b c d", "P: \n e f g h", "P:  i j"]
    assert all(size(c) <= 5 for c in pack_lines(text, 5, "P: "))
    assert pack_lines("a b c d e\nf", 5, "P: ", omit_prefix=True) == ["P: ", "a b c d e\n", "P: f"]
    assert pack_lines("x y", 2, "a b c d e") == ["a b", " c d", " e", "x y"]
    assert pack_lines("", 5, "P: ") == [] and pack_lines(" \n", 5) == []


def test_long_words_and_shared_characters():
    every = lambda t: [i for i, _ in enumerate(t) for _ in (0, 1)]  # noqa: E731  two tokens a character
    got = pack_lines("abc", 2, starts=every)
    assert "".join(x.strip() for x in got) == "abc"
    assert "".join(split_text("x" * 50, 7, lambda t: list(range(len(t))))) == "x" * 50


@pytest.mark.parametrize("name,make", [("byte_bpe_50k.json", tokens.vocabulary_file), ("byte_bpe_50k.tiktoken", tokens.rank_file)])
def test_vocabulary_files(spark, name, make):
    path = f"/opt/tokenizers/{name}"
    starts = make(path)
    text = "Naïve tokens, 日本語 text and unbelievable words\nsecond line " * 5
    at = list(starts(text))
    assert at[0] == 0 and at == sorted(at) and max(at) < len(text)
    assert len(at) == len(list(tokens.vocabulary_file("/opt/tokenizers/byte_bpe_50k.json")(text)))
    for limit in (7, 20):
        got = pack_lines(text, limit, starts=starts)
        assert "".join(got).replace("\n", "") == text.replace("\n", "")
    df = tokens.with_count(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "text", starts)
    assert [r["n_tokens"] for r in df.orderBy("id").collect()] == [len(at), 0]
