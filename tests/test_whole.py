"""Queries that must cover whole tables, and metrics against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import joins, metrics
from holdfast.operators.components import connected_components
from holdfast.plans.registry import FLAGSHIP, ORACLE, QUERIES


def test_flagship_covers_every_scan(spark, sf):
    scans = {r.o_orderkey: r for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    got = QUERIES[FLAGSHIP](spark, sf).collect()
    assert sorted(r.image_id for r in got) == sorted(scans)
    of = {}
    for r in scans.values():
        of.setdefault(r.o_custkey, []).append(r)
    for r in got:
        day = scans[r.image_id].o_orderdate.date()
        near = min(((abs((o.o_orderdate.date() - day).days), o.o_orderdate.date(), o.o_orderkey, o.o_orderpriority) for o in of[r.subject_id] if o.o_orderkey != r.image_id), default=None)
        want = (near[1], near[0], near[3]) if near and near[0] <= 180 else (None, None, None)
        assert (r.matched_day, r.gap_days, r.code) == want


def test_hierarchical_auroc_by_hand(spark):
    def drawn(seed, b, k, n):
        return int(hashlib.sha1(f"{seed}:{b}:{k}".encode()).hexdigest()[:12], 16) % n

    rows = [(proto, seed, f"s{(i * 7 + seed) % 5}", int((i * 11 + proto + seed) % 3 == 0), (i * 37 + proto * 5 + seed * 3) % 10 / 10.0) for proto in range(3) for seed in range(4) for i in range(17)]
    rows += [(1, 4, "s0", 0, 0.5), (1, 4, "s1", 0, 0.1)]  # one class alone, and missing from two protocols
    table = spark.createDataFrame(rows, "protocol long, seed long, subject_id string, y_true long, y_prob double")
    got = {(r.protocol, r.b): r.auroc for r in metrics.hierarchical_auroc(table, ["protocol"], 13, resamples=40).collect()}
    seeds, sets, want = sorted({r[1] for r in rows}), {}, {}
    for proto, seed, subject, y, q in rows:
        sets.setdefault((proto, seed), {}).setdefault(subject, []).append((y, q))
    for b in range(40):
        for proto in range(3):
            values = []
            for slot in range(len(seeds)):
                held = sets.get((proto, seeds[drawn(13, b, slot, len(seeds))]))
                if not held:
                    continue
                names = sorted(held)
                took = [x for k in range(len(names)) for x in held[names[drawn(14, f"{b}:{slot}:{proto}", k, len(names))]]]
                pos, neg = [q for y, q in took if y], [q for y, q in took if not y]
                if pos and neg:
                    values.append(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))
            want[proto, b] = sum(values) / len(values) if values else None
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_mean_roc_by_hand(spark):
    rows = [(i, proto, seed, int((i * 11 + proto + seed) % 3 == 0), (i * 37 + proto * 5 + seed * 3) % 10 / 10.0) for proto in range(3) for seed in range(2) for i in range(17)]
    points = metrics.roc_points(spark.createDataFrame(rows, "doc_id long, protocol long, seed long, y_true long, y_prob double"), ["seed", "protocol"], "doc_id")
    got = {(r.protocol, r.g): r.tpr for r in metrics.mean_roc(points, ["protocol"], "seed", steps=21).collect()}
    curves = {}
    for r in points.collect():
        curve = curves.setdefault((r.protocol, r.seed), {})
        curve[round(1 - r.specificity, 12)] = max(r.sensitivity, curve.get(round(1 - r.specificity, 12), 0.0))
    assert sorted(got) == [(proto, g) for proto in range(3) for g in range(21)]
    for (proto, g), tpr in got.items():
        values = [np.interp(g / 20, sorted(c), [c[x] for x in sorted(c)]) for (p, _), c in curves.items() if p == proto]
        assert tpr == pytest.approx(np.mean(values), abs=1e-9)


def test_registered_resamples_are_whole(spark, sf):
    got = QUERIES["hierarchical_bootstrap"](spark, sf).groupBy("protocol").count().collect()
    assert {r.protocol: r["count"] for r in got} == {0: 10_000, 1: 10_000, 2: 10_000}
    assert {r.protocol for r in QUERIES["mean_roc"](spark, sf).select("protocol").distinct().collect()} == {0, 1, 2}


def test_components_against_union_find(spark):
    """Tables that are stars at once, chains, loops, nulls and repeated edges."""
    chosen = random.Random(5)
    tables = [[], [(1, 1)], [(1, 1), (1, 2)], [(1, None), (None, None), (3, 2), (2, 3)], [(1, 3), (2, 3)], [(i, i + 1) for i in range(40)], [(99, i) for i in range(50)]]
    tables.append([(chosen.randrange(60), chosen.randrange(60)) for _ in range(40)])
    for edges in tables:
        least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
        for _ in edges:
            for a, b in (e for e in edges if None not in e and e[0] != e[1]):
                least[a] = least[b] = min(least[a], least[b])
        found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
        assert sorted(map(tuple, found.collect())) == sorted(least.items())


def test_ordinals_of_many_components_against_sql(spark, tmp_path):
    """More than 100,000 components, every eleventh with a copy."""
    n = 100_100
    docs = spark.range(n + n // 11).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, F.col("id")).otherwise((F.col("id") - n) * 11).cast("string").alias("text"), F.lit("web").alias("source"), F.lit("en").alias("lang"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select component, ordinal from ({ORACLE['component_ordinals']})").fetchall()
    got = QUERIES["component_ordinals"](spark, str(tmp_path)).select("component", "ordinal").collect()
    assert len(want) == n and sorted(map(tuple, got)) == sorted(want)


def test_near_hash_counts_keep_records_from_the_driver(spark, sf):
    """No side of a join is broadcast, and every image is read and hashed once."""
    got = QUERIES["near_hash_counts"](spark, sf)
    assert got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Broadcast" not in plan and plan.count("FileScan") == 1 and "isnotnull(words" not in plan
    members = QUERIES["near_hash_classes"](spark, sf)
    assert "Broadcast" not in members._jdf.queryExecution().executedPlan().toString()


def test_near_counts_against_all_pairs(spark):
    chosen = random.Random(6)
    bases = [[chosen.randrange(1 << 32) for _ in range(5)] for _ in range(3)]
    rows = [(i, [w ^ (1 << chosen.randrange(3) if chosen.random() < 0.4 else 0) for w in chosen.choice(bases)]) for i in range(150)] + [(200, None), (201, None)]
    hashes = [w for _, w in rows if w]
    want = {}
    for i, a in enumerate(hashes):
        for b in hashes[:i]:
            distance = sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
            if distance <= 4:
                want[distance] = want.get(distance, 0) + 1
    assert set(want) == {0, 1, 2, 3, 4}
    table = spark.createDataFrame(rows, "id int, w array<bigint>")
    pairs = joins.near_hashes(table, "id", "w")
    for classes in (joins.hash_sizes(table, "id", "w"), joins.hash_classes(table, "id", "w")):
        assert [tuple(r) for r in joins.near_counts(pairs, classes).collect()] == sorted(want.items())
    nameless = spark.createDataFrame([(None, bases[0]), (None, bases[0]), (None, bases[1]), (None, bases[1])], table.schema)
    assert [tuple(r) for r in joins.near_counts(joins.near_hashes(nameless, "id", "w"), joins.hash_sizes(nameless, "id", "w")).collect()] == [(0, 2)]
