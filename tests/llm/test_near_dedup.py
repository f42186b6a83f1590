"""Pairs at the threshold whose minwise values agree in few places."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from brute import near  # noqa: E402

from holdfast.llm import near_dedup  # noqa: E402
from holdfast.llm.common import Cache  # noqa: E402


def test_lone_pair_at_the_threshold(spark):
    words = [f"u4287x{i}" for i in range(10)]
    rows = [(1, " ".join(words[:9])), (2, " ".join(words[1:]))]
    cache = Cache(near_dedup.word_hash)
    a, b = (near_dedup.signature(near_dedup.shingle_set(t.encode(), 1, cache)) for _, t in rows)
    assert (a == b).sum() == 83  # four standard deviations under 0.8 of 128 would ask for 85
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=1).collect()
    assert sorted(tuple(r) for r in got) == sorted(near(rows, n=1)) == [(1, 9, 1, True), (2, 9, 1, False)]


def test_open_groups_in_blocks(spark):
    """Near copies and near misses of a few texts, in nodes that branch, in forests by blocks and in meetings by blocks."""
    import random

    rng = random.Random(11)
    made = []
    for g in range(3):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(120):
            x = list(base)
            for _ in range(rng.choice((1, 2, 3, 6, 9, 12, 15))):
                x[rng.randrange(120)] = f"new{rng.random()}"
            made.append((len(made), " ".join(x)))
    table = spark.createDataFrame(made, "doc_id long, text string")
    want = sorted(near(made))
    assert 3 < len({r[2] for r in want}) < 300
    for options in ({}, {"small": 16, "block": 20, "bin_shingles": 3_000}, {"small": 4, "depth": 1, "block": 8, "bin_shingles": 500}):
        assert sorted(tuple(r) for r in near_dedup.near_duplicates(table, 2, 80, **options).collect()) == want


def test_blocks_meet_once_for_every_pair(spark):
    """Each pair of documents in different components stands in one group, and no pair of the largest component does."""
    from itertools import combinations

    rows = [(1, i, 0 if i < 60 else i, 100) for i in range(90)]
    left = spark.createDataFrame(rows, "gid long, doc_id long, component long, n long")
    groups = {}
    for r in near_dedup._met(left, 1_000).collect():
        groups.setdefault(r.gid, []).append(r)
    seen = []
    for members in groups.values():
        for a, b in combinations(members, 2):
            if a.component != b.component and (not a.cross or a.side != b.side):
                seen.append(tuple(sorted((a.doc_id, b.doc_id))))
    assert len(groups) > 5 and len(seen) == len(set(seen)) == 60 * 30 + 30 * 29 // 2
