"""Items whose parts lie far apart, and benchmarks in parts."""

from holdfast.llm import decontamination


def test_question_and_answer_far_apart(spark):
    bench = spark.createDataFrame([(1, "quantal marlin ferric dorsal vellum opaque? Tundra sable ochre lumen cobalt zephyr."), (2, "river stone window candle garden? Basket ladder hammer pillow kettle.")], "item_id long, text string")
    filler = " ".join(f"fill{i}" for i in range(200))
    docs = spark.createDataFrame([(1, f"quantal marlin ferric dorsal vellum opaque {filler} tundra sable ochre lumen cobalt zephyr"), (2, f"quantal marlin ferric dorsal vellum opaque {filler}")], "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.overlap) for r in decontamination.contaminated(docs, bench).collect()]
    assert got == [(1, 1, 1.0)]


def test_parts_do_not_change_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    indexes = lambda most: [x.value for x in decontamination._indexes(bench, 0.6, most)]
    one, many = indexes(500_000), indexes(60)
    assert len(one) == 1 and len(many) > 5
    thresholds = lambda parts: {i: t for x in parts for i, t in zip(x.ids, x.threshold, strict=True)}
    assert thresholds(one) == thresholds(many)
    assert {x.longest for x in one + many} == {one[0].longest}
    found = lambda most: sorted(tuple(r) for r in decontamination.contaminated(docs, bench, max_index_words=most).collect())
    assert found(60) == found(500_000) != []
