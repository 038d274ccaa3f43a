"""What the base rules don't mark is scored, whatever its letters and its neighbours."""

from quire.llm import secrets

from .test_text_operators import rows

LETTERS = "ghp_" + "aQbWcEdRfTgYhUjIkOlPzXmCnVxBqLwKeJrH"
WITH_HEX = "ghp_" + "Z9xQ" + "0123456789abcdef" + "T7uVwX5yZ3kLmN2p"


def test_letters_only_and_keys_with_a_hex_run(spark):
    prose = "The quick brown fox jumps over lazy dogs and extraordinarily uncomplicated neighbourhoods. "
    data = [(1, f"x {LETTERS} y"), (2, f"x {WITH_HEX} y"), (3, prose * 40), (4, (prose * 40).upper()), (5, "x=0123456789abcdef0123 y")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {i: r["spans"].split(",") for i, r in rows(secrets.digest(secrets.find(df, secrets.learn(df.filter("doc_id > 2"), sample_of=1)))).items()}
    assert got[1] == [f"format:2:{2 + len(LETTERS)}"]
    assert f"format:2:{2 + len(WITH_HEX)}" in got[2]
    assert got[3] == got[4] == [""] and got[5] == ["hex:2:22"]


def test_a_cut_is_no_end():
    n = secrets.MAX_SYMBOLS
    a = secrets.Automaton.tree(["a" * (n + 6)])
    assert sum(a.ends) == 0 and sum(secrets.Automaton.tree(["a" * n]).ends) == 1


def planted(seed=3):
    """Prose with a key of a public format in every second text, and what only looks like one in the others."""
    import base64
    import random
    import uuid

    r = random.Random(seed)
    words = ["report", "quarterly", "understanding", "of", "the", "internationalization", "data", "system-wide", "performance", "was", "improved"]
    say = lambda: " ".join(r.choice(words) for _ in range(12))
    keys = [k for kind, v in secrets.generated(40, seed=99).items() if kind != "access" for k in v]
    decoys = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(60)]
    decoys += [base64.b64encode(say().encode()).decode()[: r.randint(16, 60)] for _ in range(60)]
    decoys += ["".join(r.choice("ACGT") for _ in range(r.randint(16, 50))) for _ in range(40)]
    decoys += ["".join(r.choices("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", k=20)) for _ in range(40)]
    rows = [(i, f"{say()} {x} {say()}", i < len(keys), x) for i, x in enumerate(keys + decoys)]
    return rows, len(keys)


def test_precision_and_recall(spark):
    data, n_keys = planted()
    df = spark.createDataFrame([(i, t) for i, t, *_ in data], "doc_id long, text string")
    got = rows(secrets.digest(secrets.find(df, secrets.learn(df, sample_of=1))))
    hit = {i for i, t, _, x in data if f"format:{t.index(x)}:{t.index(x) + len(x)}" in got[i]["spans"].split(",")}
    wrong = {i for i in got if "format" in got[i]["spans"]} - {i for i, _, key, _ in data if key}
    assert len(hit) >= 0.97 * n_keys and len(wrong) <= 0.02 * len(data)


def test_a_format_keeps_prefix_and_length():
    import random

    r = random.Random(4)
    a = secrets.Automaton.infer(["tok-" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(300)])
    key = "tok-" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20))
    gain = lambda w: a.score(w) - secrets.at_random(w)
    assert gain(key) > gain(key[:-4]) + 5 and gain(key) > gain(key + "abcd") + 5 and gain(key) > gain("kot-" + key[4:]) + 8
    assert 20 <= len(a.ends) <= 60


def test_many_spans_take_linear_time():
    import time

    t = "0123456789abcdef0 ZZZZZZZZZZZZZZZZ " * 20_000
    base = sorted((s, e) for s, _, e, _ in secrets.base_spans(t))
    began = time.time()
    assert secrets.format_spans(t, base, lambda x: 0.0, 12.0) == []
    assert time.time() - began < 5
