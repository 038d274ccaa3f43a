import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty and blank texts, repeated rows, copies, near copies, shared passages, one very long text."""
    import random

    r = random.Random(5)
    base = [[r.choice(WORDS) for _ in range(r.randint(1, 120))] for _ in range(30)]
    passage = [r.choice(WORDS) for _ in range(60)]
    out = [None, "", "  \t ", "one", "one", "\n\n", "a b c", "été naïve 日本  x"]
    for i, b in enumerate(base):
        lines = [" ".join(b[k : k + 7]) for k in range(0, len(b), 7)]
        out.append("\n".join(lines))
        if i % 3 == 0:
            out.append("\n".join(lines))
        if i % 4 == 0 and len(b) > 20:
            c = list(b)
            c[len(c) // 2] = "changed"
            out.append(" ".join(c))
        if i % 5 == 0:
            out.append(" ".join(b[:10] + passage + b[10:]))
    out.append(" ".join(r.choice(WORDS) for _ in range(30_000)))
    out.append("\n".join(["same line"] * 9))
    return out


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    rows = [(i * 3 + 1, t, "en", "src") for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
