"""Reports over manifests, splits and results: counts, profiles and roll-ups.

Defined cases, where an operator doesn't say otherwise: nulls and blanks count as missing; repeated rows count as often
as they stand; an empty table gives no rows, or one row of zeros and nulls where there is no grouping; columns that an
operator doesn't name are ignored, whatever they are called; ties go to the least id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.rules import blank_to_null


def group_counts(rows: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    """(value, n), with a bucket for missing values; sorted by number, then value."""
    named = F.coalesce(blank_to_null(F.col(column).cast("string")), F.lit(missing))
    return rows.groupBy(named.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def distinct_known(column: str, sentinels: tuple[str, ...] = ("unknown",)) -> Column:
    """Exact number of distinct values, as an aggregate; blanks and sentinels are none."""
    value = blank_to_null(F.col(column).cast("string"))
    return F.countDistinct(F.when(~value.isin(*sentinels), value))


def missingness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, missing) for each column, in one pass."""
    one = rows.agg(*[F.count_if(blank_to_null(F.col(c).cast("string")).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("x.*")


def first_non_empty(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row a key: every column's first value in order that is not blank."""
    known = lambda c: blank_to_null(F.col(c).cast("string"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(known(c), F.when(known(c).isNotNull(), F.struct(F.col(order), known(c)))).alias(c) for c in columns])


def manifest_counts(rows: DataFrame, subject: str, session: str, label: str, rating: str) -> DataFrame:
    """(kind, value, n): rows, distinct subjects and sessions, and the distributions of label and rating."""
    totals = rows.agg(F.count("*").alias("rows"), distinct_known(subject).alias("subjects"), distinct_known(session).alias("sessions"))
    listed = totals.select(F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in totals.columns])).alias("x")).select("x.*")
    for kind, column in (("label", label), ("rating", rating)):
        listed = listed.unionByName(group_counts(rows, column).select(F.lit(kind).alias("kind"), "value", "n"))
    return listed


def archive_rollup(inventory: DataFrame, disc: str = "disc", archive: str = "archive_path", there: str = "archive_exists", parts: tuple[str, str] = ("hdr_exists", "img_exists")) -> DataFrame:
    """Per disc: sessions, the archives that are missing (sorted), and complete pairs of extracted files. Null flags count as absent."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return inventory.groupBy(disc).agg(F.count("*").alias("sessions"), F.array_sort(F.collect_set(F.when(~yes(there), F.col(archive)))).alias("missing_archives"), F.count_if(yes(parts[0]) & yes(parts[1])).alias("extracted_pairs"))


def subject_profile(scans: DataFrame, scores: DataFrame, subject: str, dx: str, sex: str, age: str, day: str, score: str, score_day: str, id_col: str) -> DataFrame:
    """One row a subject: diagnosis by priority (AD, CN, MCI, others), first known sex, age at the first scan that has one, baseline score (negative ones are missing), scans."""
    rank = F.when(F.col(dx) == "AD", 3).when(F.col(dx) == "CN", 2).when(F.col(dx) == "MCI", 1).otherwise(0)
    years, known_sex = F.col(age).cast("string").try_cast("double"), blank_to_null(F.col(sex))
    at = F.struct(F.col(day), F.col(id_col))
    per = scans.where(F.col(subject).isNotNull()).groupBy(subject).agg(
        F.max_by(F.when(rank > 0, F.col(dx)).otherwise("unknown"), rank).alias("dx"),
        F.min_by(known_sex, F.when(known_sex.isNotNull(), F.col(id_col))).alias("sex"),
        F.min_by(years, F.when(years.isNotNull(), at)).alias("age"),
        F.count("*").alias("scans"),
    )
    points = F.col(score).cast("string").try_cast("int")
    base = scores.where(points.isNotNull() & (points >= 0) & F.col(score_day).isNotNull()).groupBy(subject).agg(F.min_by(points, F.struct(F.col(score_day), points)).alias("score"))
    return per.join(base, subject, "left")


def group_demographics(profile: DataFrame) -> DataFrame:
    """Per diagnosis: subjects, scans, age and score with sample SD (0 where there is one value), share of women in percent."""
    women = F.count_if(F.col("sex") == "F")
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return profile.groupBy("dx").agg(
        F.count("*").alias("subjects"), F.sum("scans").alias("scans"), F.coalesce(F.avg("age"), F.lit(0.0)).alias("age_mean"), sd("age").alias("age_sd"),
        women.alias("women"), (women * 100.0 / F.count("*")).alias("women_pct"), F.avg("score").alias("score_mean"), sd("score").alias("score_sd"),
    )


def class_profile(rows: DataFrame, label: str, subject: str, unparsed: Column, order: dict[str, int] | None = None) -> DataFrame:
    """Per class: images, subjects, unparsed names and their share in percent; in the given order of classes, then by name."""
    odd = F.count_if(unparsed)
    out = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("images"), F.countDistinct(subject).alias("subjects"), odd.alias("odd"), (odd * 100.0 / F.count("*")).alias("odd_pct"))
    rank = F.lit(None).cast("int")
    for name, place in (order or {}).items():
        rank = F.when(F.col("class") == name, place).otherwise(rank)
    return out.orderBy(rank.asc_nulls_last(), "class")


def class_weight(rows: DataFrame, by: list[str], y: str = "y_true") -> DataFrame:
    """Negatives over positives (at least one)."""
    return rows.groupBy(*by).agg((F.count_if(F.col(y) == 0) / F.greatest(F.lit(1), F.count_if(F.col(y) == 1))).alias("weight"))


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of a key; ties go to the one seen first."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "f")).alias("majority"))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample SD over what is a number; SD 0 for fewer than two, mean null for none."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"))


def probe_rollup(rows: DataFrame, by: str = "protocol", value: str = "lift") -> DataFrame:
    """Mean, least and greatest lift."""
    return rows.groupBy(by).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def cost_of_leakage(costs: DataFrame, honest: str, leaky: str, by: list[str], protocol: str = "protocol", value: str = "fn") -> DataFrame:
    """Misses that the leaky protocol hides: the mean over seeds of the honest protocol's misses less those of the leaky one; null where one of them lacks."""
    mean = lambda name: F.avg(F.when(F.col(protocol).cast("string") == name, F.col(value)))
    sums = costs.groupBy(*by).agg(mean(honest).alias("honest"), mean(leaky).alias("leaky"))
    return sums.withColumn("hidden", F.col("honest") - F.col("leaky")).withColumn("ratio", F.when(F.col("leaky") > 0, F.col("honest") / F.col("leaky")))


def gates(rows: DataFrame, split: str, subject: str, label: str, classes: tuple[str, ...] = ("CN", "AD")) -> DataFrame:
    """(gate, passed): there are rows; there are rows of a class; no subject stands in train and test; every split has rows."""
    per = rows.groupBy(subject).agg(*[F.bool_or(F.col(split) == p).alias(p) for p in ("train", "val", "test")], F.bool_or(F.col(label).isin(*classes)).alias("known"), F.count("*").alias("n"))
    found = per.agg((F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("has_rows"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("has_classes"), (F.count_if(F.col(subject).isNotNull() & F.col("train") & F.col("test")) == 0).alias("no_contamination"), (F.coalesce(F.bool_or("train"), F.lit(False)) & F.coalesce(F.bool_or("val"), F.lit(False)) & F.coalesce(F.bool_or("test"), F.lit(False))).alias("all_splits"))
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("gate"), F.col(c).alias("passed")) for c in found.columns])).alias("x")).select("x.*")
