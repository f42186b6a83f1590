"""Joins in place of broadcasts, and the word-by-word tokenizer path on random texts."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from holdfast.llm import near_dedup, queries, substring_dedup, token_store  # noqa: E402

KEY = lambda r: tuple((x is not None, x) for x in r)


def _docs(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{t} tail") for i, t in enumerate(texts)] + [(200, None), (3, texts[3]), (3, texts[9]), (None, texts[5])]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_repeats_by_joins(spark, monkeypatch):
    table, rows = _docs(spark)
    monkeypatch.setattr(substring_dedup, "IDS_IN_MEMORY", 0)
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(table).collect()), key=KEY)
    assert got == sorted(brute.repeats(rows), key=KEY) and sum(r[2] > 0 for r in got) > 10


def test_near_duplicates_by_joins(spark, monkeypatch):
    table, rows = _docs(spark)
    monkeypatch.setattr(near_dedup, "IDS_IN_MEMORY", 0)
    known = [r for r in rows if r[0] is not None and r[0] != 3]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(table.where("doc_id <> 3"), 2, 80, small=4, block=8, bin_shingles=300).collect())
    assert got == sorted(brute.near(known, 2, 80)) and sum(not r[3] for r in got) > 20
    # Rows of an id with two texts give one document, whichever way the tables meet.
    both = []
    for most in (0, 1_000):
        monkeypatch.setattr(near_dedup, "IDS_IN_MEMORY", most)
        both.append(sorted((tuple(r) for r in near_dedup.near_duplicates(table, 2, 80).collect()), key=KEY))
    assert both[0] == both[1]


def test_random_texts_word_by_word():
    rng = random.Random(8)
    alphabets = ["abcXYZ ,.", "éèàÉÇßÿ ,.\n", "аБвΔΣς ,.", "漢字かな ", "🙂👩‍🚀 a", "0123456789 .,-", "<|>endoftx ", "\t\r\n\x1c\x85  ab"]
    by_word, whole = (token_store.Encoder(queries.tokenizer_path(), s) for s in (True, False))
    for _ in range(4_000):
        text = "".join(rng.choices(rng.choice(alphabets) + rng.choice(alphabets), k=rng.randrange(0, 60)))
        assert by_word(text) == whole(text), repr(text)
