"""Operators without a contract: brute force, held-out accuracy, invariants."""

import math
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from holdfast.llm import chat, decontamination, mixing, quality, secrets  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_on_labels(spark):
    big = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    known = labels.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    scored = quality.classify(table, known.where(~F.col("held"))).join(known.where("held"), "doc_id")
    n = {(r.bad, r.keep): r.n for r in scored.groupBy(((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"), "keep").agg(F.count("*").alias("n")).collect()}
    assert n[True, False] >= 0.93 * (n[True, False] + n.get((True, True), 0))
    assert n[False, True] >= 0.99 * (n[False, True] + n.get((False, False), 0))


def test_quality_awkward(spark, awkward, empty):
    got = quality.classify(awkward).collect()
    assert len(got) == awkward.count() and not [r for r in got if r.doc_id in (2, 3)][0].keep
    assert quality.classify(empty).count() == 0


def test_mixing_by_hand(docs):
    rows = mixing.plan_copies(docs, entropy_share=0.99, max_repeat=3.0, block_tokens=2_000).collect()
    size, got, weight, most = Counter(), Counter(), {}, defaultdict(int)
    for r in rows:
        n = len((r.text or "").encode().split())
        assert n == r._mix_tokens
        size[r.source] += n
        got[r.source] += n * r._mix_copies
        weight[r.source] = r._mix_weight
        most[r.source] = max(most[r.source], n)
    total = sum(size.values())
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        p = [(n / total) ** a for n in size.values()]
        w = [x / sum(p) for x in p]
        fits = -sum(x * math.log(x) for x in w) <= 0.99 * math.log(len(w)) and max(x * total / n for x, n in zip(w, size.values(), strict=True)) <= 3
        low, high = (low, a) if fits else (a, high)
    z = sum((n / total) ** high for n in size.values())
    for s, n in size.items():
        assert weight[s] == pytest.approx((n / total) ** high / z, abs=1e-6)
        assert abs(got[s] - weight[s] * total) <= most[s]


def test_mixing_awkward(awkward, empty):
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.mix(empty).count() == 0


def test_decontamination_by_hand(spark, docs, awkward, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: decontamination.split_item(r.text) for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    want = set()
    for r in docs.collect():
        words = decontamination.words_of(r.text)
        held = decontamination.shingles(words)
        for i, parts in items.items():
            sets = [decontamination.shingles(p) for p in parts if p]
            hits = [sum((s in held) if len(s) == 5 else any(tuple(words[k : k + len(s)]) == s for k in range(len(words))) for s in x) for x in sets]
            if sum(hits) >= 0.8 * sum(map(len, sets)) and all(hits):
                want.add((r.doc_id, i))
    assert want and got == want
    assert decontamination.decontaminate(awkward, bench).count() == awkward.count()
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0


def test_block_max_wand_is_exact(docs, spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontamination.Index(bench, 0.3)
    for r in docs.limit(60).collect():
        terms = set(decontamination.words_of(r.text)[:120])
        score = defaultdict(float)
        for t in terms:
            for n, s in index.postings.get(t, ()):
                score[n] += s
        assert index.hopeful(terms) or not index.retrieve(terms)
        assert sorted(index.retrieve(terms)) == sorted(n for n, s in score.items() if s >= index.threshold[n])


def test_event_folding(spark):
    log = [(1, 0, "m0", "message", "user", "hi </turn>"), (1, 1, "m1", "delta", "assistant", "he"), (1, 2, "m1", "delta", None, "llo"), (1, 3, "m1", "regenerate", None, "go"), (1, 4, "m1", "delta", None, "od"), (1, 5, "m0", "edit", None, r"hi \l<turn:x>"), (2, 0, None, None, None, None)]
    table = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(table)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", r"hi \l<turn:x>"), ("assistant", "good")]
    assert got[1].loss_texts == ["good"] and [(t.role, t.text) for t in got[2].turns] == [("", "")]
    assert chat.format_chats(table.where("false")).count() == 0


def test_credential_linking():
    alone, linked = "the pwd: hunter22", "host: db.example.org user=app pwd: hunter22"
    assert secrets.linked_parts(alone, [], 200) == []
    assert sorted(k for _, _, k in secrets.linked_parts(linked, [], 200)) == [3, 4, 5]
    assert secrets.linked_parts("user=app\n\npwd: hunter22", [], 200) == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, d)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
