"""Queries with a contract against plain versions, on whole small tables and on awkward rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from holdfast.llm import near_dedup, pii, queries, secrets, substring_dedup, token_store, topk  # noqa: E402

KEY = lambda r: tuple((x is not None, x) for x in r)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=KEY)


def docs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.parametrize("operator, plain, n", [(pii.sanitise, brute.pii, 4), (secrets.scan, brute.secrets, 3)])
def test_base_spans(docs, awkward, empty, operator, plain, n):
    for table in (docs, awkward, empty):
        got = rows(operator(table).select("doc_id", *operator(table).columns[1 : n + 2]))
        assert got == sorted(((i, *plain(t)) for i, t in docs_of(table)), key=KEY)


def test_awkward_spans():
    texts = ["@b.c@d.e x@y", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3", "4111 1111 1111 1111-", "+1 (389) 555-5010 +1+2 345 678 9012", "0" * 5000, "a" * 5000 + "@", "x" * 3000 + "@b." * 1000, "4111-1111-1111-1111 4111  1111"]
    for t in texts:
        spans = pii.base_spans(t)
        assert [sum(s[2] == k for s in spans) for k in range(4)] == brute.pii(t)[:4], t[:50]
    for t in ['password = "abcdef"', "API_KEY:abcde token=ſecret1", "ſecret=abcdefg", "apikey : 'zzzzzz", "f" * 23 + " " + "f" * 24 + "0", "AKIA" + "A" * 15 + " AKIA" + "A" * 16, "passwordpassword=abcdef", "token" + " " * 3000]:
        spans = secrets.base_spans(t)
        assert [sum(s[2] == k for s in spans) for k in range(3)] == brute.secrets(t)[:3], t[:50]


def test_chat(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    assert rows(queries.op4_chat(spark, d)) == sorted(con.execute(queries.ORACLE_SQL["op4_chat"]).fetchall(), key=KEY)


def test_tokens(spark, docs):
    assert rows(queries.op5_token_store(spark, "/root/testdata/sf0.01")) == brute.tokens(docs_of(docs), queries.tokenizer_path())


def test_tokens_word_by_word_is_exact():
    texts = ["Don't  STOP\tme\nnow ok", "é é ΟΔΟΣ ς", "<|endoftext|> x<|startoftext|>y", " ", "", "\x1c a\x85b", "İstanbul ß 1234 a.b,c!!", "Été, d'Or. x!!, y., z,. ÀÉ,\nw.", "a, b. c,", "it's, 'S. 5, 6."]
    by_word, whole = (token_store.Encoder(queries.tokenizer_path(), s) for s in (True, False))
    for t in texts:
        assert by_word(t) == whole(t), t


def test_tokens_round_trip(spark, awkward, empty):
    from holdfast.scratch import new_path

    for table in (awkward, empty):
        path = token_store.write_store(table, new_path(spark, "t"), queries.tokenizer_path(), split_words=True)
        enc = token_store.Encoder(queries.tokenizer_path(), False)
        want = sorted(((i, [*(enc.tokenizer.encode(t or "", add_special_tokens=False).ids), 1]) for i, t in docs_of(table)), key=lambda x: (x[0] is not None, x[0] or 0))
        got = sorted(token_store.reconstruct(spark, path).collect(), key=lambda r: r.start)
        assert sorted(map(str, [(r.doc_id, list(r.ids)) for r in got])) == sorted(map(str, want))
        assert [r.doc_id for r in got] == [i for i, _ in want]
        assert token_store.verify_manifest(spark, path).count() == 0
        assert token_store.read_digests(spark, path).count() == len(want)
        chunks = token_store.read_chunks(spark, path)
        assert chunks.count() == chunks.select("digest").distinct().count()


def test_topk(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op6_topk"]).fetchall(), key=KEY)
    assert rows(queries.op6_topk(spark, d)) == want
    small = topk.top_k(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("id") % 20 == 0, segment=100, chunk=7)
    assert rows(small) == want


def test_topk_awkward(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [-1.0]), (20, [0.5, -0.5, 9.0]), (None, [1.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = rows(topk.top_k(table, F.col("id") % 20 == 0, k=2))
    assert got == [(0, 1, 1, 64 * 64 * 5), (0, 2, 2, 64 * 64 * 5), (20, 1, 0, -2048), (20, 2, 1, -2048)]
    assert topk.top_k(table.where("false"), F.col("id") % 20 == 0).count() == 0


def test_repeats(docs, awkward, empty):
    for table in (docs, awkward, empty):
        got = rows(substring_dedup.remove_repeats(table))
        assert [r[:4] for r in got] == sorted(brute.repeats(docs_of(table)), key=KEY)
        text = substring_dedup.remove_repeats(table, with_text=True)
        assert rows(text.drop("kept_text")) == got


def test_near(docs, awkward, empty):
    got = rows(near_dedup.near_duplicates(docs, 2, 80))
    assert got == sorted(brute.near(docs_of(docs), 2, 80), key=KEY)
    known = {i: t for i, t in docs_of(awkward) if i is not None}
    got = rows(near_dedup.near_duplicates(awkward, 2, 80).where("doc_id is not null").distinct())
    assert got == sorted(brute.near(known.items(), 2, 80), key=KEY)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_large_groups(spark):
    """Nodes over the limits: branching and block pairs lose no link."""
    import random

    rng = random.Random(5)
    made = []
    for g in range(3):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(200)]
        for c in range(150):
            x = list(base)
            for _ in range(rng.randrange(8)):
                x[rng.randrange(200)] = f"new{rng.random()}"
            made.append((len(made), " ".join(x)))
    table = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(near_dedup.near_duplicates(table, 2, 80, small=16)) == sorted(brute.near(made, 2, 80), key=KEY)


def test_near_misses_in_a_group():
    """Candidates that fail are tested in their group and never listed; links between different components come out."""
    import random

    import numpy as np

    rng = random.Random(7)
    base = [rng.randrange(2**63) for _ in range(100)]
    sets = [np.unique(np.array([x for x in base if rng.random() < 0.93] + [rng.randrange(2**63) for _ in range(4)], np.uint64)) for _ in range(120)]
    ids = np.arange(120)
    sig = np.stack([near_dedup.signature(s) for s in sets])
    got = near_dedup.tested(ids, sig, sets, ids.copy(), 0.3, 80)
    linked = [(i, j) for i in range(120) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    assert linked and len(linked) < 120 * 119 / 2

    def names(links):
        name = list(range(120))
        for a, b in links:
            lo, hi = sorted((name[a], name[b]))
            name = [lo if x == hi else x for x in name]
        return name

    assert names(got) == names(linked)
    assert len(got) < 120
