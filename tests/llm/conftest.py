import random

import pytest

from riskfabric.llm._common import ship_package

#: Names that the operators use inside; a table may have them, too.
CLASHING = ["digest", "keep_id", "row", "row_id", "h1", "tkey", "pos", "word", "gram", "n", "frag", "lang_pred", "score",
            "part", "block", "leader", "comp", "host", "path", "n_tokens", "ids", "__id", "__row", "c"]


def make(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in CLASHING:
            from pyspark.sql import functions as F
            df = df.withColumn(c, F.lit(f"clash {c}"))
    return df


@pytest.fixture(scope="session")
def shipped(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty and white texts, ties, repeated rows, a row without an id, copies,
    near copies, shared lines and a very long text."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = say(60).split()
    near = []
    for k in range(6):
        w = list(base)
        w[k * 7] = f"changed{k}"
        near.append((20 + k, " ".join(w)))
    line = "This very line stands in several documents."
    return [
        (0, None), (1, ""), (2, " \t\r\n"), (3, None), (4, "one two"), (5, "ONE  two\n"), (6, "one two three four"),
        (7, "Same words here, five of them"), (8, "same\twords here, five of\x0bthem "), (9, "samewords here,five of them"),
        (9, "samewords here,five of them"), (None, "a row without any id, and its words"), (10, "12 34 !? 56"),
        (11, f"first\n{line}\nlast"), (12, f"  {line.upper()}\t\nbody of twelve"), (13, f"{line}\n{line}\n{line}"), (14, f"x\n{line}"),
        (15, say(40_000)), (16, "z" * 3_000 + " tail"), (17, "ünïcödé ЖЗ 漢字 \U0001F600 'll don't <|endoftext|>"), *near,
        (30, " ".join(base[:50] + say(10).split())), (31, say(60)), (32, "\n".join(say(6) for _ in range(5))),
    ]


@pytest.fixture(scope="session")
def edge_docs(shipped, edge_rows):
    return make(shipped, edge_rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(shipped):
    return make(shipped, [])
