"""Joins of the manifest builder and of the audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.rules import hamming_words


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, left_day: str, right_day: str, order: str, tolerance: int, values: list[str], others: bool = False) -> DataFrame:
    """As-of left join in both directions: of the same key, the row at the least distance in days; ties go to the earlier
    day, then to the lower ``order``; no match beyond ``tolerance`` days. With ``others``, both
    sides are one table with ``order`` as its id, and a row never matches itself.

    The right side is first reduced to a row for each key and day; a window over a key's days, not its rows, gives each
    day the last one before it and the next one. So a key of very many rows costs its rows, never their square.

    Defined cases: a left row with null key or day has no match; right rows with null key or day are none; repeated left
    rows have equal matches; of right rows with equal order one counts; an empty right side gives nulls.
    """
    r = right.where(F.col(key).isNotNull() & F.col(right_day).isNotNull()).select(F.col(key).alias("_key"), F.col(right_day).alias("_day"), F.struct(F.col(order).alias("_order"), F.struct(*values).alias("_values")).alias("_row"))
    a = r.groupBy("_key", "_day").agg(F.min_by("_row", "_row._order").alias("_a"))
    if others:  # the second of a day, for the first itself
        b = r.join(a, ["_key", "_day"]).where("_row._order <> _a._order").groupBy("_key", "_day").agg(F.min_by("_row", "_row._order").alias("_b"))
        a = a.join(b, ["_key", "_day"], "left")
    else:
        a = a.withColumn("_b", F.lit(None).cast(a.schema["_a"].dataType))
    asked = left.select(F.col(key).alias("_key"), F.col(left_day).alias("_day")).where("_key is not null and _day is not null").distinct()
    days = asked.join(a, ["_key", "_day"], "full")
    held = F.when(F.col("_a").isNotNull(), F.struct("_day", "_a"))
    w = Window.partitionBy("_key").orderBy("_day")
    days = days.withColumn("_before", F.last(held, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    days = days.withColumn("_after", F.first(held, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    met = left.join(days.withColumnsRenamed({"_key": "_k", "_day": "_d"}), (F.col(key) == F.col("_k")) & (F.col(left_day) == F.col("_d")), "left")
    here = F.when(F.col("_a._order") == F.col(left_id), F.col("_b")).otherwise(F.col("_a")) if others else F.col("_a")
    gap = lambda day: F.abs(F.datediff(F.col(left_day), day))
    option = lambda day, row: F.when(row.isNotNull(), F.struct(gap(day).alias("gap"), day.alias("day"), row["_values"].alias("v")))
    options = F.array_compact(F.array(option(F.col("_d"), here), option(F.col("_before._day"), F.col("_before._a")), option(F.col("_after._day"), F.col("_after._a"))))
    best = F.aggregate(options, F.lit(None).cast(f"struct<gap:int,day:date,v:{r.schema['_row'].dataType['_values'].dataType.simpleString()}>"), lambda x, y: F.when(x.isNull() | (y["gap"] < x["gap"]) | ((y["gap"] == x["gap"]) & (y["day"] < x["day"])), y).otherwise(x))
    found = met.withColumn("_best", best).withColumn("_best", F.when(F.col("_best.gap") <= tolerance, F.col("_best")))
    return found.select(*left.columns, F.col("_best.day").alias("matched_day"), F.col("_best.gap").alias("gap_days"), *[F.col(f"_best.v.{v}").alias(v) for v in values])


def cascade(left: DataFrame, steps: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """Fallback left joins: the first step with a match gives ``value`` and ``value_source``; steps may have different keys.

    Defined cases: a step's keys should be unique; of repeated ones one row counts, the greatest value (see
    latest_per_key() for another choice), so left rows are never multiplied; null keys match nothing; a null value is no match.
    """
    out = left
    for i, (_, right, keys) in enumerate(steps):
        one = right.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(value).alias(f"_v{i}"))
        out = out.join(one, keys, "left")
    source = reduce(lambda c, i: c.when(F.col(f"_v{i}").isNotNull(), steps[i][0]), range(len(steps)), F)
    return out.select(*left.columns, F.coalesce(*[F.col(f"_v{i}") for i in range(len(steps))]).alias(value), source.otherwise("none").alias(f"{value}_source"))


def cascade_or_nearest(left: DataFrame, steps: list[tuple[str, DataFrame, list[str]]], value: str, matched: str, visits: DataFrame, key: str, left_id: str, left_day: str, right_day: str, order: str, tolerance: int = 180) -> DataFrame:
    """cascade(); where no step has a match but the condition ``matched`` holds, the nearest row by date within the tolerance gives the value."""
    first = cascade(left, steps, value)
    by_date = nearest(left.where(matched), visits, key, left_id, left_day, right_day, order, tolerance, [value]).select(F.col(left_id).alias("_id"), F.col(value).alias("_near")).where("_near is not null").groupBy("_id").agg(F.max("_near").alias("_near"))
    out = first.join(by_date, F.col(left_id) == F.col("_id"), "left")
    use = F.col(value).isNull() & F.col("_near").isNotNull()
    return out.select(*left.columns, F.coalesce(value, "_near").alias(value), F.when(use, "nearest_date").otherwise(F.col(f"{value}_source")).alias(f"{value}_source"))


def either_key(left: DataFrame, right: DataFrame, first: str, second: str, values: list[str]) -> DataFrame:
    """Left join by the first key, else by the second: two equi-joins, never an OR. Null keys match nothing; of repeated right keys one row counts."""
    out = left
    for i, k in enumerate((first, second)):
        one = right.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k{i}")).agg(F.min(F.struct(*values)).alias(f"_r{i}"))
        out = out.join(one, F.col(k) == F.col(f"_k{i}"), "left")
    row = F.coalesce("_r0", "_r1")
    return out.select(*left.columns, *[row[v].alias(v) for v in values])


def required_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that must be there: a left key without a right row raises in the task that meets it; repeated right keys raise too."""
    one = right.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in right.columns if c != key])).alias("_row"))
    met = left.join(one, F.col(key).eqNullSafe(F.col("_key")), "left")
    wrong = F.raise_error(F.concat(F.lit("key without exactly one row: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return met.withColumn("_row", F.when(F.col("_n") == 1, F.col("_row")).otherwise(wrong)).select(*left.columns, "_row.*")


def with_numeric(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Lookup join of a numeric column; rows without a number there are dropped. Of repeated keys the least number counts."""
    known = right.select(key, F.col(column).cast("string").try_cast("double").alias(column)).where(f"{column} is not null").groupBy(key).agg(F.min(column).alias(column))
    return left.join(known, key)


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row in order wins; of equal orders the row that sorts last as a whole. Null keys are one key; a null order comes first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_order"), F.struct(*rest).alias("_row"))).alias("_last")).select(*keys, "_last._row.*")


def split_overlap(rows: DataFrame, key: str, split: str, parts: list[str]) -> DataFrame:
    """Distinct keys shared by each pair of splits, from one aggregate per key."""
    has = rows.groupBy(key).agg(*[F.max((F.col(split) == p).cast("int")).alias(f"_{p}") for p in parts])
    names = [(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :]]
    sums = has.agg(*[F.coalesce(F.sum(F.col(f"_{a}") * F.col(f"_{b}")), F.lit(0)).cast("long").alias(f"{a}__{b}") for a, b in names])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"{a}__{b}").alias("shared")) for a, b in names])).alias("x")).select("x.*")


def contamination(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Share of test keys that are also train keys, in percent."""
    has = rows.groupBy(key).agg(F.bool_or(F.col(split) == "train").alias("tr"), F.bool_or(F.col(split) == "test").alias("te"))
    both, test = F.count_if(F.col("tr") & F.col("te")), F.count_if("te")
    return has.agg(both.alias("overlap"), test.alias("test_keys"), F.when(test > 0, both * 100.0 / test).otherwise(0.0).alias("contamination_pct"))


def missing_cells(found: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """Cells of the full grid of small axes that are not found."""
    grid = reduce(lambda a, b: a.crossJoin(b), axes)
    return grid.join(found.select(*grid.columns).distinct(), grid.columns, "left_anti")


def range_lookup(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, value: str, bin_width: int) -> DataFrame:
    """Range join by bins: an equi-join on the bins that a range touches; of several ranges the least ``value`` wins."""
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / bin_width), F.floor(F.col(high) / bin_width))))
    p = points.select(point).distinct().withColumn("_bin", F.floor(F.col(point) / bin_width))
    hit = p.join(r, "_bin").where(F.col(point).between(F.col(low), F.col(high))).groupBy(point).agg(F.min(value).alias(value))
    return points.join(hit, point, "left")


#: Subjects of a disc, by number: fixed values (disc, first, last). Where two discs hold a number the lower disc counts.
DISCS = ((1, 1, 42), (2, 43, 80), (3, 80, 115), (4, 116, 150), (5, 151, 191), (6, 192, 231), (7, 232, 272), (8, 273, 309), (9, 310, 348), (10, 349, 382), (11, 383, 419), (12, 420, 457))


def disc_of(session: Column, discs: tuple = DISCS, moved: tuple[int, str, int] = (80, "MR2", 3)) -> Column:
    """The archive disc of a session id by its number, with the one exception; an id of another form or without a disc raises."""
    number = F.regexp_extract(session, r"^OAS1_(\d{4})_(MR\d+)$", 1).try_cast("int")
    visit = F.regexp_extract(session, r"^OAS1_(\d{4})_(MR\d+)$", 2)
    out = F.when((number == moved[0]) & (visit == moved[1]), moved[2])
    for disc, low, high in discs:
        out = out.when(number.between(low, high), disc)
    return out.otherwise(F.raise_error(F.concat(F.lit("no disc for session "), F.coalesce(session, F.lit("null")))))


def member_candidates(session: Column, disc: Column, versions: int = 8) -> Column:
    """Accepted names of a session's processed volume in its archive: array of (version, hdr, img)."""
    base = lambda n: F.concat(F.lit("disc"), disc.cast("string"), F.lit("/"), session, F.lit("/PROCESSED/MPRAGE/T88_111/"), session, F.lit("_mpr_n"), n.cast("string"), F.lit("_anon_111_t88_masked_gfc"))
    return F.transform(F.sequence(F.lit(1), F.lit(versions)), lambda n: F.struct(n.alias("version"), F.concat(base(n), F.lit(".hdr")).alias("hdr"), F.concat(base(n), F.lit(".img")).alias("img")))


def hash_classes(rows: DataFrame, id_col: str, words: str) -> DataFrame:
    """(id, representative): records of equal hashes are one class, named by its least id. Null hashes are in none."""
    full = rows.where(F.col(words).isNotNull()).select(F.col(id_col).alias("id"), F.col(words).alias("_h"))
    least = full.groupBy("_h").agg(F.min("id").alias("representative"))
    # Sizes are estimated from the rows' files, which hold no hashes: without the hint all records may be broadcast.
    return full.join(least.hint("merge"), "_h").select("id", "representative")


def hash_sizes(rows: DataFrame, id_col: str, words: str) -> DataFrame:
    """(h, id, size): classes of equal hashes with their least id, one row each. Null hashes are in none.

    Null hashes go by their count: a filter by hash would move below the grouping and make each hash once more.
    """
    return rows.groupBy(F.col(words).alias("h")).agg(F.min(id_col).alias("id"), F.count(words).alias("size")).where("size > 0")


def near_hashes(rows: DataFrame, id_col: str, words: str, limit: int = 4) -> DataFrame:
    """Classes of equal hashes at Hamming distance ``limit`` or less: id_a < id_b (representatives), distance, size_a, size_b.

    Hashes are arrays of words of 32 bits, more of them than ``limit``: by the pigeonhole principle a pair agrees in a
    word, so pairs meet in an equi-join on (place, word), never in all pairs. hash_classes() gives the members.
    """
    banded = hash_sizes(rows, id_col, words).select("id", "h", "size", F.posexplode_outer("h").alias("place", "word"))  # outer: without a filter by hash
    a, b = (banded.select("place", "word", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "h", "size")]) for x in "ab")
    distance = hamming_words(F.col("h_a"), F.col("h_b"))
    # A pair that agrees in several words counts where the first of them meets.
    first = F.array_position(F.zip_with("h_a", "h_b", lambda x, y: x == y), True) - 1
    # Merged, as in hash_classes(): neither side goes through the driver.
    near = a.join(b.hint("merge"), ["place", "word"]).where((F.col("id_a") < F.col("id_b")) & (first == F.col("place")) & (distance <= limit))
    return near.select("id_a", "id_b", distance.cast("int").alias("distance"), "size_a", "size_b")


def near_counts(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Record pairs by distance, uncapped: those between classes, and at distance 0 those inside each; sorted by distance.

    ``classes`` are those of hash_sizes(), a row each, or of hash_classes(), a row for each member.
    """
    between = pairs.select("distance", (F.col("size_a") * F.col("size_b")).alias("n"))
    if "size" in classes.columns:  # grouped by the id as well, so that it is not pruned: near_hashes() reads the same exchange
        sized = classes.groupBy("h", "id").agg(F.sum("size").alias("c"))
    else:
        sized = classes.groupBy("representative").agg(F.count("*").alias("c"))
    inside = sized.where("c > 1").select(F.lit(0).alias("distance"), F.expr("c * (c - 1) div 2").alias("n"))
    return between.unionByName(inside).groupBy("distance").agg(F.sum("n").alias("pairs")).orderBy("distance")


def capped(pairs: DataFrame, cap: int = 5_000) -> DataFrame:
    """The listed part of a report: its ``cap`` first rows by distance and ids. Counters come from the uncapped table."""
    return pairs.orderBy("distance", "id_a", "id_b").limit(cap)


def exists_flag(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    return left.join(right.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def superset(needed: DataFrame, present: DataFrame) -> DataFrame:
    """One row (holds, missing): whether all rows of ``needed`` are in ``present``; null equals null."""
    lacking = needed.select(*present.columns).subtract(present)
    return lacking.agg((F.count("*") == 0).alias("holds"), F.count("*").alias("missing"))


def require_complete(found: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """``found``, if it has every cell of the grid; else raises with a few of the missing ones."""
    few = missing_cells(found, axes).limit(5).collect()
    if few:
        raise ValueError(f"missing cells: {', '.join(str(tuple(r)) for r in few)}")
    return found
