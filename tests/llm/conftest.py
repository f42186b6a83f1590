import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [
        (1, "alpha beta gamma " + passage),
        (2, None),
        (3, ""),
        (None, "no id " + passage),
        (4, long),
        (5, long + " tail"),
        (6, long),
        (7, passage + " omega mail me at a.b@c.example.com or +1 (389) 555-5010"),
        (7, passage + " omega mail me at a.b@c.example.com or +1 (389) 555-5010"),
        (8, "one"),
        (9, "one"),
        (10, "same " * 40),
        (11, "same " * 50),
        (12, " wide space and é ß \U0001f600 " + passage),
    ]
    return spark.createDataFrame([(i, t, "x", "s", 1, 2.0, "k") for i, t in rows], "doc_id long, text string, node string, source string, n int, tokens double, keys string")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
