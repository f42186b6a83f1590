"""Edge cases of rules, joins, allocation and metrics on literal rows."""

import pytest
from pyspark.sql import functions as F

from holdfast.functions import rules
from holdfast.operators import graph, joins, metrics, splits


def test_nearest_tie_and_tolerance(spark):
    left = spark.createDataFrame([("s", 1, "2020-01-10"), ("t", 2, "2020-01-01"), ("u", 3, "2020-01-01")], "k string, id int, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([("s", "2020-01-15", 1, "b"), ("s", "2020-01-05", 2, "a"), ("t", "2020-06-29", 3, "in"), ("u", "2020-06-30", 4, "out")], "k string, x string, o int, v string").withColumn("x", F.to_date("x"))
    got = {r.id: r.v for r in joins.nearest(left, right, "k", "id", "d", "x", "o", 180, ["v"]).collect()}
    assert got == {1: "a", 2: "in", 3: None}


def test_diagnosis(spark):
    rows = spark.createDataFrame([("9", None, None), ("LMCI", None, None), ("-4", "1", None), ("", None, None)], "diagnosis string, dxmci string, dxad string")
    assert [r.x.label for r in rows.select(rules.diagnosis(rows).alias("x")).collect()] == ["MCI", "MCI", "MCI", "unknown"]


def test_subset_sum_and_targets(spark):
    assert [[2, 4][i] for i in splits.subset_sum([2, 4], 3)] == [2]
    assert sorted([5, 3, 7][i] for i in splits.subset_sum([5, 3, 7], 10)) == [3, 7]
    t = spark.createDataFrame([(10,), (30,)], "n int")
    assert [r.v for r in t.select(splits.targets(F.col("n"))[1].alias("v")).collect()] == [2, 4]


def test_auroc_and_trapezoid(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.1)], "id int, y_true int, y_prob double").withColumn("g", F.lit(1))
    assert metrics.auroc(rows, ["g"]).first().auroc == 0.875
    assert metrics.trapezoid(metrics.roc_points(rows, ["g"], "id"), ["g"]).first().area == 1.0
    assert metrics.auroc(rows.where("y_true = 0"), ["g"]).first().auroc is None


def test_calibration_edges(spark):
    rows = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.3, 1.0)], "y_prob double").withColumn("y_true", F.lit(0))
    assert metrics.calibration(rows, []).count() == 1


def test_components_bridge(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (5, 6, "a"), (6, 7, "a"), (7, 8, "a"), (8, 5, "a")], "src long, dst long, reason string")
    members = graph.components(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 8)], "id long"), "id", edges)
    assert {r.id: r.component for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5}
    assert {r.component: r.reason for r in graph.component_reasons(members, "id", edges).collect()} == {1: "a+b", 4: "singleton", 5: "a"}


def test_split_invariants(spark):
    comps = spark.createDataFrame([(i, 1 + i % 5, "x") for i in range(60)], "c int, size int, s string")
    got = splits.allocate_components(comps, "s", "c", "size", 1)
    sums = {r.split: r.n for r in got.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert sums == {"train": 126, "val": 27, "test": 27} and got.select("c").distinct().count() == 60
    rows = spark.createDataFrame([(1, "a", "train")], "image_id int, subject_id string, split string")
    assert splits.inject_leakage(rows, 0.0, 1).drop("injected").collect() == rows.collect()


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="b, c"):
        rules.require_columns(spark.createDataFrame([(1,)], "a int"), {"a", "b", "c"})
