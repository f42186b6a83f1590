"""run() as a whole against plain versions of its stages, on a small table with nulls, copies, test items and repeated rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from holdfast.llm import decontamination, mixing, quality, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of the smallest scale, with rows that every stage must treat: under new ids and under ids that are there."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    good = [r for r in base if r.text and len(r.text.split()) > 120][:4]
    row = lambda r, **new: tuple((r.asDict() | new)[c] for c in docs.columns)
    near = " ".join(w if i % 60 else f"changed{i}" for i, w in enumerate(good[0].text.split()))
    extra = [row(good[0], doc_id=10_001), row(good[0], doc_id=10_002, text=near), row(good[1], doc_id=10_003, text=f"{good[1].text} {item}"), row(good[2]), row(good[2]), row(good[3], doc_id=None), row(good[3], doc_id=10_004, text=None), row(good[3], doc_id=10_005, text=""), row(good[3], doc_id=10_006, source=None, text="lone words of no source " * 9)]
    d = str(tmp_path_factory.mktemp("run"))
    spark.createDataFrame([tuple(r) for r in base] + extra, docs.schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    return d


def test_run_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    # The classifier is a trained model: its own verdict by text, and null ids go.
    keep = {r.text: r.keep for r in quality.classify(docs, labels).withColumnRenamed("doc_id", "i").join(docs, F.col("i").eqNullSafe(F.col("doc_id"))).select("text", "keep").collect() if r.text is not None}
    rows = [r for r in docs.collect() if r.doc_id is not None and keep.get(r.text, False)]
    assert 10_003 in {r.doc_id for r in rows} and {10_004, 10_005}.isdisjoint({r.doc_id for r in rows})
    # One row of each group of near-duplicates.
    first = {i for i, _, _, kept in brute.near({r.doc_id: r.text for r in rows}.items(), n=5) if kept}
    rows = list({r.doc_id: r for r in rows if r.doc_id in first}.values())
    assert {10_001, 10_002}.isdisjoint({r.doc_id for r in rows})
    # Test items by their shingles, every document with every item.
    clean = []
    for r in rows:
        words = decontamination.words_of(r.text)
        held = decontamination.shingles(words)
        found = False
        for b in bench.collect():
            parts = [decontamination.shingles(p) for p in decontamination.split_item(b.text) if p]
            hits = [sum((s in held) if len(s) == 5 else any(tuple(words[k : k + len(s)]) == s for k in range(len(words))) for s in p) for p in parts]
            found |= bool(parts) and sum(hits) >= 0.8 * sum(map(len, parts)) and all(hits)
        if not found:
            clean.append(r)
    assert 10_003 not in {r.doc_id for r in clean} and clean
    # Copies by the plan of the mixing stage (held to its targets in test_models), then ids of the plain tokenizer.
    table = spark.createDataFrame([tuple(r) for r in clean], docs.schema)
    copies = {r.doc_id: r._mix_copies for r in mixing.plan_copies(table).collect()}
    mixed = [(r.doc_id, r.text) for r in clean for _ in range(copies[r.doc_id])]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == sorted(brute.tokens(mixed, queries.tokenizer_path()))
