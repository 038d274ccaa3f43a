"""Each operator against a plain version of its definition, with nulls, empty and long texts, ties, copies and clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, linededup, packing, quality, secrets, sharding, substring
from quire.llm.queries import tokenizer_path

WS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_substring_dedup(docs):
    t, got = texts(docs), rows(substring.digest(substring.find(docs)))
    words = {i: WS.findall(x or "") for i, x in t.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    assert sum(r["n_removed"] for r in got.values()) > 100
    kept = rows(substring.dedup(docs))
    assert kept[1]["text"] is None and set(docs.columns) == set(substring.dedup(docs).columns)


def test_line_dedup(docs):
    t, got = texts(docs), rows(linededup.digest(linededup.find(docs)))
    lines = {i: x.split("\n") if x else [] for i, x in t.items()}
    first = {}
    for i in sorted(lines):
        k = min(3, len(lines[i]))
        for j in range(len(lines[i]) - k + 1 if k else 0):
            first.setdefault(tuple(lines[i][j : j + k]), (i, j))
    for i, x in lines.items():
        k = min(3, len(x))
        gone = {m for j in range(len(x) - k + 1 if k else 0) if first[tuple(x[j : j + k])] != (i, j) for m in range(j, j + k)}
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(x), len(gone), sha("\n".join(y for m, y in enumerate(x) if m not in gone)))
    assert sum(r["n_removed"] for r in got.values()) > 20
    left = rows(linededup.dedup(docs))
    assert 1 in left and left[1]["text"] is None and len(left) < len(t)


def brute_jaccard(t):
    sets = {}
    for i, x in t.items():
        w = WS.findall((x or "").translate(LOW))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(docs):
    got = rows(jaccard.near_duplicates(docs))
    want = brute_jaccard(texts(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert sum(c != i for i, (_, c) in want.items()) > 8
    kept = rows(jaccard.dedup(docs))
    assert set(kept) == {i for i, (_, c) in want.items() if c == i}


def test_jaccard_large_clusters_by_blocks(spark):
    import random

    r = random.Random(9)
    base = [f"v{i}" for i in range(60)]
    data = []
    for i in range(60):
        w = list(base)
        w[r.randrange(60)] = f"x{i}"
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in rows(jaccard.near_duplicates(df)).items()} == brute_jaccard(dict(data))
    words = jaccard.WordHashes()
    sets = [(i, len(s), s.tobytes()) for i, s in ((i, jaccard.gram_set(words, t, 5)) for i, t in data)]
    rep = spark.createDataFrame(sets, "rep long, n long, grams binary")
    links = jaccard.cluster_links(rep, spark.range(60).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component")), 80, 4, block=7)
    forest = jaccard.Forest()
    for x in links.collect():
        forest.union(x["a"], x["b"])
    assert {i: forest.find(i) for i in range(60)} == {i: c for i, (_, c) in brute_jaccard(dict(data)).items()}


def test_decontamination(spark, docs):
    t = texts(docs)
    long_one = max(t.values(), key=lambda x: len(x or ""))
    bench = [(1, " ".join(long_one.split()[100:130])), (2, "A B c"), (3, None), (None, " ".join(long_one.split()[115:126]).upper()), (4, ""), (5, "not there at all, nowhere to be found in any of them")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    for part in (16 << 20, 60):  # in one part, and in several
        got = rows(decontam.digest(decontam.scan(docs, items, part_bytes=part)))
        W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        windows = {}
        for i, x in bench:
            w = W.findall((x or "").translate(LOW))
            m = min(10, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                windows.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
        for i, x in t.items():
            w, hit, who = W.findall((x or "").translate(LOW)), set(), set()
            for m in {len(k) for k in windows}:
                for k in range(len(w) - m + 1):
                    if v := windows.get(tuple(w[k : k + m])):
                        hit |= set(range(k, k + m))
                        who |= v
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit))
    clean = decontam.drop_contaminated(docs, items)
    assert set(clean.columns) == set(docs.columns) and clean.count() == sum(not r["contaminated"] for r in got.values())


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    t = texts(docs)
    got = packing.pack_documents(docs, tokenizer_path(), 256).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(t)
    for i, x in t.items():
        ids, at = [*tok.encode(x or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 256)
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and len(by_doc[i]) == -(-len(ids) // 256)
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_seq) <= 1 + -(-sum(r["length"] for r in got) // 256) * 1.05


@pytest.mark.parametrize("text", ["", " ", "a", "a  b", "\ta b\n c", "it's I'll 've", " x", "x ", "日本 語 été", "a  b", "<|endoftext|> b", "1 22 x_y --"])
def test_ids_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    assert np.frombuffer(packing.encoder(tokenizer_path()).of(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_plan_places_every_piece():
    import random

    r = random.Random(1)
    for _ in range(50):
        counts = {r.randint(1, 64): r.randint(1, 40) for _ in range(r.randint(1, 20))}
        free, seen = {}, {}
        for length, rank, n, first, fit, offset in packing.plan(counts, 64):
            assert rank == seen.get(length, 0)
            seen[length] = rank + n
            for i in range(n):
                free.setdefault(first + i // fit, []).append((offset + i % fit * length, length))
        assert seen == counts
        for s in free.values():
            at = 0
            for o, length in sorted(s):
                assert o == at
                at += length
            assert at <= 64


def test_sharding(docs):
    got = sharding.shard(docs, 24).collect()
    t = texts(docs)
    assert len(got) == len(t)
    slots = {}
    for r in got:
        x = (t[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(x) + 8, zlib.crc32(x), "key")
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_moves_the_necessary_part_only(spark):
    ids = spark.range(20_000)
    for n in (1, 2, 7, 23):
        got = ids.select(sharding.jump_shard(F.col("id"), n).alias("a"), sharding.jump_shard(F.col("id"), n + 1).alias("b"))
        moved = got.filter("a <> b")
        assert moved.filter(f"b <> {n}").count() == 0
        assert abs(moved.count() / 20_000 - 1 / (n + 1)) < 0.02
        assert got.groupBy("a").count().agg(F.min("count")).first()[0] > 20_000 / n * 0.8


def test_secrets(spark):
    key, hexa = "AKIA" + "A1B2C3D4E5F6G7H8", "0123456789abcdef0"
    data = [
        (1, f"x password = 'hunter2hunter2' y {key} z"), (2, None), (3, ""), (4, f"été 🙂 TOKEN:{hexa}"), (5, "password=secret: abcdefghijklmnop"),
        (6, "The quick brown fox jumps over lazy dogs. " * 50), (7, "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"), (8, "AKIASHORT abc123"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("q_spans", F.lit("clash"))
    found = secrets.find(df, secrets.learn(df, sample_of=1))
    got = rows(secrets.digest(found))
    for i, x in data:
        base = []
        for kind, rx, good in (("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 12), ("access", secrets.ACCESS, lambda m: len(m[0]) >= 18), ("hex", secrets.HEX, lambda m: len(m[0]) >= 16)):
            base += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in rx.finditer(x or "") if good(m)]
        line = [b[2] for b in sorted(base)]
        assert got[i]["base_sha256"] == sha(",".join(line))
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("format")] == line
    assert "format" in got[7]["spans"] and "format" not in got[6]["spans"] and got[5]["n_assign"] == 0
    assert "hunter2" not in rows(secrets.redact(found))[1]["redacted"]


def test_automaton_learns_a_format():
    import random

    r = random.Random(3)
    keys = ["K-" + "".join(r.choices("0123456789", k=12)) for _ in range(300)]
    a = secrets.Automaton.infer(keys)
    assert len(a.ends) < 60
    assert a.score("K-123456789012") > a.score("KABCDEFGHIJKLM") + 20


def test_quality(spark):
    import random

    r = random.Random(2)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(i % 7) for i in range(r.randint(20, 60))) for _ in range(200)]
    bad = [" ".join(r.choice(["###", "$$$", "!!!"]) for _ in range(r.randint(20, 60))) for _ in range(200)]
    data = [(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 if i < 200 else 0) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = rows(quality.score(df, model))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == (i < 200) for i in held) > 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 for x in got.values()) and len(model.rules) < 60
    flags = rows(df.select("doc_id", quality.held_out().alias("h")))
    assert [i for i in range(400) if flags[i]["h"]] == held
    empty = labels.limit(0)
    assert quality.keep_good(df, empty).count() == len(data)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring.digest(substring.find(none)).count() == 0
    assert linededup.dedup(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    assert sharding.shard(none).count() == 0
    assert decontam.scan(none, items).count() == 0
    assert secrets.find(none, secrets.learn(none)).count() == 0
    assert quality.score(none, quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_null_and_repeated_ids(spark):
    t = " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (7, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["n_removed"]) for r in substring.digest(substring.find(df)).collect()]
    assert sorted(got, key=str) == sorted([(None, 0), (5, 40), (5, 40), (7, 0)], key=str)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()} == {(None, None), (5, None), (7, 7)}
    assert sharding.shard(df).count() == 4
    assert linededup.digest(linededup.find(df)).count() == 4
