"""Links between records, components of the link graph, and their audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.components import connected_components
from holdfast.operators.splits import ordinal_positions


def star_edges(rows: DataFrame, id_col: str, keys: list[str], reason: str) -> DataFrame:
    """Each record of a group links to the group's least record; null keys link nothing."""
    full = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).select(*keys, F.col(id_col).alias("dst"))
    anchors = full.groupBy(*keys).agg(F.min("dst").alias("src"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return full.join(anchors, keys).where("src <> dst").select("src", "dst", F.lit(reason).alias("reason"))


def components(rows: DataFrame, id_col: str, edges: DataFrame) -> DataFrame:
    """(id, component): records without a link are their own component."""
    found = connected_components(edges)
    return rows.select(F.col(id_col).alias("node")).join(found, "node", "left").select(F.col("node").alias(id_col), F.coalesce("component", "node").alias("component"))


def component_reasons(members: DataFrame, id_col: str, edges: DataFrame) -> DataFrame:
    """Component, size and the sorted reasons of its links, joined by '+'; 'singleton' without any."""
    reasons = edges.join(members.select(F.col(id_col).alias("src"), "component"), "src").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reason"))
    return members.groupBy("component").agg(F.count("*").alias("size")).join(reasons, "component", "left").select("component", "size", F.coalesce("reason", F.lit("singleton")).alias("reason"))


def component_labels(members: DataFrame, label: str) -> DataFrame:
    """One label that is not missing: that; none: label_missing; more: mixed_label."""
    known = F.when(F.col(label) != "unknown", F.col(label))
    low, high = F.min(known), F.max(known)
    return members.groupBy("component").agg(F.when(low.isNull(), "label_missing").when(low == high, low).otherwise("mixed_label").alias("component_label"))


def content_ids(members: DataFrame, id_col: str) -> DataFrame:
    """Ids that depend on a component's members alone."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string")), ";")
    return members.groupBy("component").agg(F.concat(F.lit("comp_"), F.substring(F.sha1(ids), 1, 12)).alias("component_id"))


def ordinal_ids(members: DataFrame, prefix: str = "component_") -> DataFrame:
    """(component, ordinal): components numbered from 0 in the order of their names, which are whole numbers; five digits at least, more from 100,000 on."""
    ranked = ordinal_positions(members.select("component").distinct(), "component")
    return ranked.select("component", F.concat(F.lit(prefix), F.format_string("%05d", F.col("position") - 1)).alias("ordinal"))


def key_components(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """(id, component) where a component is nothing but a key, such as the subject; a row without one is its own."""
    named = rows.select(F.col(id_col).alias("id"), F.col(key).alias("key"))
    least = named.where("key is not null").groupBy("key").agg(F.min("id").alias("component"))
    return named.join(least, "key", "left").select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component"))


def near_flags(pairs: DataFrame, rows: DataFrame, id_col: str, subject: str, label: str) -> DataFrame:
    """Near pairs for review: whether both have one subject, or one class; they never block a split. Nulls are alike to nothing."""
    a, b = (rows.select(F.col(id_col).alias(f"id_{x}"), F.col(subject).alias(f"_s{x}"), F.col(label).alias(f"_l{x}")) for x in "ab")
    met = pairs.join(a, "id_a").join(b, "id_b")
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    return met.select(*pairs.columns, same("_sa", "_sb").alias("same_subject"), same("_la", "_lb").alias("same_class"), F.lit("review_only_not_split_blocking").alias("policy"))


def summary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n): nodes, star edges (in all and by reason) and components."""
    totals = members.agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))
    listed = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("nodes", "components")])).alias("x")).select("x.*")
    named = edges.rollup("reason").agg(F.count("*").alias("n")).select(F.coalesce(F.concat(F.lit("edges "), "reason"), F.lit("edges")).alias("name"), "n")
    return listed.unionByName(named)


def size_histogram(members: DataFrame) -> DataFrame:
    """Components by size, sorted by size."""
    return members.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components")).orderBy("size")


def orphans(rows: DataFrame, component: str, split: str) -> DataFrame:
    """Components in more than one split."""
    return rows.groupBy(component).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("rows")).where("splits > 1")
