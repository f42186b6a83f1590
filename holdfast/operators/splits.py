"""Allocation of records and components to splits, and controlled leakage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.joins import split_overlap
from holdfast.scratch import written


def shuffled(seed: int | Column, name: Column) -> Column:
    """Order key of a seeded shuffle that SQL can repeat."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.sha1(F.concat(seed.cast("string"), F.lit(":"), name.cast("string")))


def targets(n: Column) -> tuple[Column, Column, Column]:
    """Train, validation and test sizes: 70 and 15 percent rounded half to even, and the rest."""
    train, val = F.bround(n * F.lit(0.7)).cast("long"), F.bround(n * F.lit(0.15)).cast("long")
    return train, val, n - train - val


def positions(rows: DataFrame, order: Column, by: list[str] | None = None, name: str = "position") -> DataFrame:
    """Rank (from 1) in a global order, or in one inside each ``by`` group, without a task for all rows: buckets, ranks
    inside them, and the buckets' counts before.

    ``order`` is a text key whose first three characters spread evenly, such as a hash in hex. Defined cases: rows of
    equal keys are ranked by all their columns, equal rows in any order; a null key comes first; null groups are groups.
    """
    by = by or []
    ranged = rows.withColumn("_key", order).withColumn("_bucket", F.coalesce(F.substring("_key", 1, 3), F.lit("")))
    return _ranked(ranged, by, rows.columns, name)


def ordinal_positions(rows: DataFrame, column: str, ranges: int = 256) -> DataFrame:
    """Rank (from 1) of whole numbers in a global order: buckets are ranges between the least and the greatest."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    width = max(1, ((ends.hi or 0) - (ends.lo or 0)) // ranges + 1)
    ranged = rows.withColumn("_key", F.col(column)).withColumn("_bucket", F.floor((F.col(column) - F.lit(ends.lo or 0)) / F.lit(width)))
    return _ranked(ranged, [], rows.columns, "position")


def _ranked(ranged: DataFrame, by: list[str], columns: list[str], name: str) -> DataFrame:
    own = [f"_by{i}" for i in range(len(by))]
    ranged = ranged.withColumns({o: F.col(c) for o, c in zip(own, by, strict=True)})
    counts = ranged.groupBy(*own, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*own).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    before = before.withColumnsRenamed({c: f"{c}_" for c in (*own, "_bucket")})
    inside = F.row_number().over(Window.partitionBy(*own, "_bucket").orderBy("_key", *columns))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*own, "_bucket")]
    joined = ranged.withColumn("_inside", inside).join(before, reduce(lambda x, y: x & y, same))
    return joined.select(*columns, (F.col("_before") + F.col("_inside")).alias(name))


def random_split(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Row-level split: the shuffle's first 70 percent train, next 15 validation (floors), rest test. Rows of equal ids are ranked by their other columns."""
    n = rows.count()
    at = F.col("_position")
    cut = F.when(at <= int(n * 0.7), "train").when(at <= int(n * 0.7) + int(n * 0.15), "val").otherwise("test")
    return positions(rows, F.coalesce(shuffled(seed, F.col(id_col)), F.lit("")), name="_position").withColumn("split", cut).drop("_position")


def group_split(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """The same for whole groups; rows without a group are one group."""
    groups = random_split(rows.select(F.col(key).alias("_group")).distinct(), "_group", seed)
    return rows.join(groups, F.col(key).eqNullSafe(F.col("_group"))).drop("_group")


def subset_sum(sizes: list[int], target: int) -> list[int]:
    """Positions of the subset whose sum is closest to the target; on a tie the one not above it, then the smaller.

    Work follows the distinct sizes: equal ones are taken in bundles of 1, 2, 4, ... as one item each.
    """
    places: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        places.setdefault(int(s), []).append(i)
    items, left = [], {}
    for s, where in places.items():
        count, bundle = len(where), 1
        while count > 0:
            items.append((s, min(bundle, count)))
            count -= bundle
            bundle *= 2
        left[s] = list(where)
    most = target + max(places, default=0)
    mask, reach, steps = (1 << (most + 1)) - 1, 1, []
    for s, n in items:
        steps.append(reach)
        reach |= (reach << (s * n)) & mask
    bits = reach.to_bytes(most // 8 + 1, "little")
    has = lambda x: 0 <= x <= most and bits[x >> 3] >> (x & 7) & 1
    best = next(x for d in range(most + 1) for x in (target - d, target + d) if has(x))
    chosen = []
    for (s, n), before in zip(reversed(items), reversed(steps), strict=True):
        if not before >> best & 1:
            chosen += [left[s].pop() for _ in range(n)]
            best -= s * n
    return sorted(chosen)


def allocate_components(components: DataFrame, stratum: str, component: str, size: str, seed: int, exact: bool = True) -> DataFrame:
    """Whole components to splits inside each stratum: validation, then test, then the rest to train.

    ``exact`` picks by subset sum; otherwise components are taken by falling size while they fit. A stratum's components are
    one task's, as each choice depends on all before; rows of components are never moved.
    """

    def allocate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, "_order"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes = pdf[size].to_numpy()
        n = int(sizes.sum())
        want = {"val": round(n * 0.15), "test": n - round(n * 0.7) - round(n * 0.15)}
        split = np.full(len(pdf), "train", object)
        for name, target in want.items():
            free = np.flatnonzero(split == "train")
            if exact:
                taken = subset_sum(sizes[free].tolist(), target)
            else:
                taken, room = [], target
                for j, s in enumerate(sizes[free].tolist()):
                    if s <= room:
                        taken.append(j)
                        room -= s
            split[free[taken]] = name
        return pd.DataFrame({stratum: pdf[stratum], component: pdf[component], size: pdf[size], "split": split})

    kinds = dict(components.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (stratum, component, size)) + ", split string"
    keyed = components.select(stratum, component, size, shuffled(seed, F.col(component)).alias("_order"))
    return keyed.groupBy(stratum).applyInPandas(allocate, schema)


def _donor_scans(rows: DataFrame, seed: int, id_col: str, subject: str, day: str, label: str, visit_label: str, classes: tuple) -> DataFrame:
    """Usable train scans of subjects with two or more: ``_k``, the scan's place by day in its subject, and ``_at``, its turn in its class.

    Donors stand in hash order; every round takes each donor's next scan, earliest first.
    """
    usable = rows.where((F.col("split") == "train") & F.col(label).isin(*classes) & (F.col(visit_label) == F.col(label)))
    own = Window.partitionBy(subject)
    ranked = usable.withColumn("_k", F.row_number().over(own.orderBy(day, id_col))).withColumn("_m", F.count("*").over(own)).where("_m >= 2")
    ranked = ranked.select(id_col, subject, F.col(label).alias("_class"), "_k")
    placed = positions(ranked, shuffled(seed, F.col(subject)), ["_class", "_k"]).withColumnRenamed("position", "_in_round")
    rounds = placed.groupBy("_class", "_k").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_class").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = rounds.select("_class", "_k", before.alias("_before"))  # as many rows as the longest series of scans
    donors = placed.where("_k = 1").select(subject, F.col("_in_round").alias("_donor"))
    sizes = donors.join(placed.where("_k = 1").select(subject, "_class"), subject).groupBy("_class").agg(F.count("*").alias("_donors"))
    out = placed.join(rounds, ["_class", "_k"]).join(donors, subject).join(sizes, "_class")
    return out.select(id_col, subject, "_class", "_k", (F.col("_before") + F.col("_in_round")).alias("_at"), ((F.col("_k") - 1) * F.col("_donors") + F.col("_donor") - 1).alias("_step"), "_donors")


def _quotas(rows: DataFrame, share: float, donors: dict, label: str, classes: tuple) -> tuple[dict, dict]:
    """(scans of each class in test, scans of each class to inject): a row for each class on the driver."""
    have = {r[0]: r[1] for r in rows.where((F.col("split") == "test") & F.col(label).isin(*classes)).groupBy(label).count().collect()}
    n = sum(have.values())
    wanted, pool = round(share * n), sum(donors.values())
    if pool < wanted and share < 1.0:
        wanted = pool
    first = round(have.get(classes[0], 0) / n * wanted) if n else 0
    return have, {classes[0]: first, classes[1]: wanted - first}


def inject_leakage(rows: DataFrame, share: float, seed: int, id_col: str = "image_id", subject: str = "subject_id", day: str = "acq_date", label: str = "label", visit_label: str | None = None, classes: tuple = ("CN", "AD")) -> DataFrame:
    """Move records of train subjects into test, and take as many test records out, so that about ``share`` of test leaks.

    ``label`` is a subject's class, ``visit_label`` that of the single record (the same column, if not given). Donors are
    train subjects with two usable records or more: of either class, the record's label that of its subject. The number is
    ``share`` of the test records of both classes, half to even, and no more than there are donors, unless the share is
    1. The first class gets its part of the test set, the second the rest. Donors give in rounds, in hash order, their
    earliest record first, for at most ten rounds' worth of the quota in steps; each class loses its quota of test records.
    Result: rows with ``split`` and ``injected``; removed test rows are left out. Test rows of other labels stay.

    Defined cases: a share that rounds to no record changes nothing; null subjects, days or labels are no donors, or come
    first by day; ids are unique; no donors mean that test records go and none comes, as in the definition above.
    """
    visit_label = visit_label or label
    if share <= 0:
        return rows.withColumn("injected", F.lit(False))
    scans = written(_donor_scans(rows.where(F.col(subject).isNotNull()), seed, id_col, subject, day, label, visit_label, classes), "donors")
    donors = {r[0]: r[1] for r in scans.where("_k = 1").groupBy("_class").count().collect()}  # two classes
    _, quotas = _quotas(rows, share, donors, label, classes)
    if not sum(quotas.values()):
        return rows.withColumn("injected", F.lit(False))
    limit = F.lit(0)
    for c in classes:
        limit = F.when(F.col("_class") == c, F.lit(quotas[c])).otherwise(limit)
    moved = scans.where((F.col("_at") <= limit) & (F.col("_step") < 10 * F.greatest(F.lit(1), limit))).select(F.col(id_col).alias("_moved"))
    test = rows.where((F.col("split") == "test") & F.col(label).isin(*classes)).select(id_col, F.col(label).alias("_class"))
    gone = positions(test, shuffled(seed + 1, F.col(id_col)), ["_class"]).where(F.col("position") <= limit).select(F.col(id_col).alias("_gone"))
    out = rows.join(moved, F.col(id_col) == F.col("_moved"), "left").join(gone, F.col(id_col) == F.col("_gone"), "left").where("_gone is null")
    came = F.col("_moved").isNotNull()
    return out.withColumn("split", F.when(came, "test").otherwise(F.col("split"))).withColumn("injected", came).drop("_moved", "_gone")


def injection_audit(before: DataFrame, after: DataFrame, share: float, subject: str = "subject_id", label: str = "label", classes: tuple = ("CN", "AD")) -> DataFrame:
    """One row: target and actual overlap, sizes, donors used, and each class's test records before and after."""
    mine = (F.col("split") == "test") & F.col(label).isin(*classes)
    count = lambda c: F.coalesce(F.count_if(mine & (F.col(label) == c)), F.lit(0))
    was = before.agg(*[count(c).alias(f"before_{c}") for c in classes])
    now = after.agg(
        F.count_if(mine).alias("n_test"), F.count_if("injected").alias("n_overlap"), F.countDistinct(F.when(F.col("injected"), F.col(subject))).alias("n_donors_used"),
        *[count(c).alias(f"after_{c}") for c in classes], F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"),
    )
    actual = F.col("n_overlap") / F.greatest(F.lit(1), F.col("n_test"))
    return now.crossJoin(F.broadcast(was)).select(F.lit(float(share)).alias("target"), actual.alias("actual"), *now.columns, *was.columns)  # one row each


def mixed_components(rows: DataFrame, component: str, label: str, id_col: str) -> DataFrame:
    """Components of more than one label: labels, number of records and their ids, sorted. Missing labels count as none."""
    per = rows.where(F.col(label).isNotNull()).groupBy(component).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select(component)
    return rows.join(per, component, "left_semi").groupBy(component).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count("*").alias("records"), F.array_sort(F.collect_list(id_col)).alias("ids"))


def require_pure(rows: DataFrame, component: str, label: str) -> DataFrame:
    """``rows``, if no component has two labels; else raises with a few of them."""
    few = rows.groupBy(component).agg(F.countDistinct(label).alias("n")).where("n > 1").orderBy(component).limit(5).collect()
    if few:
        raise ValueError(f"components of several labels: {', '.join(str(r[0]) for r in few)}")
    return rows


def relabel_by_majority(rows: DataFrame, component: str, component_label: str, label: str, id_col: str, primary: tuple[str, ...] = ("CN", "AD")) -> DataFrame:
    """Mixed components take the label that most of their records of a primary label have (a tie: the one of the least id); without any the label stays mixed_label."""
    votes = rows.where((F.col(component_label) == "mixed_label") & F.col(label).isin(*primary)).groupBy(component, label).agg(F.count("*").alias("n"), F.min(id_col).alias("first"))
    best = votes.groupBy(F.col(component).alias("_c")).agg(F.min_by(label, F.struct(-F.col("n"), "first")).alias("_label"))
    out = rows.join(best, F.col(component) == F.col("_c"), "left")
    return out.withColumn(component_label, F.coalesce("_label", component_label)).drop("_c", "_label")


def excluded(rows: DataFrame, component_label: str, primary: tuple[str, ...] = ("CN", "AD")) -> DataFrame:
    """Rows for the side file: whose component has no primary label, or none at all."""
    return rows.where(~F.coalesce(F.col(component_label).isin(*primary), F.lit(False)))


def require_no_overlap(rows: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """``rows``, if no key stands in two of train, val and test; else raises and names the counts."""
    found = []
    for key in keys:
        for r in split_overlap(rows.where(F.col(key).isNotNull()), key, split, ["train", "val", "test"]).where("shared > 0").collect():  # three rows at most
            found.append(f"{key} {r.left_split}/{r.right_split}: {r.shared}")
    if found:
        raise ValueError(f"contaminated split: {'; '.join(found)}")
    return rows


def share_drift(rows: DataFrame, split: str, label: str, most: float = 0.10) -> DataFrame:
    """(split, label, n, share, global_share, drifts) for the three splits and every label, zero cells too; null labels are a label."""
    named = rows.select(F.col(split).alias("split"), F.coalesce(F.col(label).cast("string"), F.lit("missing")).alias("label"))
    counts = named.groupBy("split", "label").agg(F.count("*").alias("n"))
    labels = counts.groupBy("label").agg(F.sum("n").alias("all"))
    spark = rows.sparkSession
    grid = labels.crossJoin(F.broadcast(spark.createDataFrame([("train",), ("val",), ("test",)], "split string")))  # labels x 3
    total = F.sum("all").over(Window.partitionBy("split"))
    of = Window.partitionBy("split")
    out = grid.withColumn("global_share", F.col("all") / total).join(counts, ["split", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("share", F.col("n") / F.greatest(F.lit(1), F.sum("n").over(of)))
    return out.select("split", "label", "n", "share", "global_share", (F.abs(F.col("share") - F.col("global_share")) > most).alias("drifts"))


def stratified_limit(rows: DataFrame, label: str, id_col: str, most: int, seed: int, labels: tuple[str, ...]) -> DataFrame:
    """At most ``most`` rows: by label in turn an even part of what is left, in hash order, then a top-up from the others. All rows, if they are no more."""
    have = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] in labels}
    if rows.count() <= most:
        return rows
    left, take = most, {}
    for i, name in enumerate(labels):
        take[name] = min(have.get(name, 0), max(1, left // (len(labels) - i)))
        left -= take[name]
    limit = reduce(lambda c, x: c.when(F.col(label) == x, take[x]), labels, F).otherwise(0)
    ranked = positions(rows, shuffled(seed, F.col(id_col)), [label], "_r")
    first = ranked.where(F.col("_r") <= limit).drop("_r")
    room = most - sum(take.values())
    if room <= 0:
        return first
    rest = positions(ranked.where(F.col("_r") > limit).drop("_r"), shuffled(seed + 1, F.col(id_col)), name="_r").where(F.col("_r") <= room).drop("_r")
    return first.unionByName(rest)


def within_group_split(rows: DataFrame, group: str, id_col: str, seed: int) -> DataFrame:
    """80/20 inside each group of two records or more."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(shuffled(seed, F.col(id_col))))).withColumn("_n", F.count("*").over(w)).where("_n >= 2")
    return ranked.withColumn("fold", F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(0.8))), "fit").otherwise("probe")).drop("_r", "_n")
