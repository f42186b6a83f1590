"""The pipeline's stages on null ids and repeated rows."""

import pytest

import corpus_pipeline
from holdfast.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def mixed_rows(spark):
    """Real documents, and: rejected and contaminated rows under null ids and under the ids of clean rows, and repeated rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.collect()
    verdicts = {r.doc_id: r.keep for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = [r for r in base if verdicts[r.doc_id]][:3]
    bad = [r for r in base if not verdicts[r.doc_id] and r.text][:3]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    held = good[0].text + " " + item
    row = lambda r, **new: tuple((r.asDict() | new)[c] for c in docs.columns)
    extra = [row(bad[0], doc_id=None), row(good[0], doc_id=None), row(good[0], doc_id=None), row(bad[1], doc_id=good[1].doc_id), row(good[2], text=held, doc_id=None), row(good[2], text=held), row(good[2]), row(good[2])]
    return spark.createDataFrame([tuple(r) for r in base] + extra, docs.schema), good, bad, held


def test_rows_are_judged_on_their_own(spark, mixed_rows):
    docs, good, bad, held = mixed_rows
    kept = corpus_pipeline.classified(spark, docs, SF).collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {}
    for r, v in zip(docs.collect(), quality.classify(docs, labels).collect(), strict=True):
        assert r.doc_id == v.doc_id
        verdict.setdefault((r.doc_id, r.text), v.keep)
    want = sorted((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None and verdict[r.doc_id, r.text])
    assert sorted((r.doc_id, r.text or "") for r in kept) == want
    assert (good[1].doc_id, good[1].text) in want and (good[1].doc_id, bad[1].text) not in want

    clean = corpus_pipeline.decontaminated(spark, docs, SF).collect()
    assert all(r.doc_id is not None and r.text != held for r in clean)
    assert sum((r.doc_id, r.text) == (good[2].doc_id, good[2].text) for r in clean) == 3


def test_dedup_keeps_one_row_of_an_id(spark, mixed_rows):
    from brute import near

    docs, good, *_ = mixed_rows
    repeated = docs.where("doc_id is null").unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    repeated = repeated.unionByName(repeated)
    rows = corpus_pipeline.deduplicated(spark, repeated, SF).collect()
    want = sorted(i for i, _, _, first in near([(r.doc_id, r.text) for r in repeated.where("doc_id is not null").distinct().collect()], n=5) if first)
    # Documents without words are in no group and stay.
    empty = sorted(r.doc_id for r in repeated.where("doc_id is not null and trim(coalesce(text, '')) = ''").select("doc_id").distinct().collect())
    assert sorted(r.doc_id for r in rows) == sorted({*want, *empty})
