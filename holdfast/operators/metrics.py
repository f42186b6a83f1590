"""Ranking, calibration, resampling and cost statistics of prediction tables.

``by`` are the columns that tell one prediction set from another (seed, protocol, subgroup ...).
Metrics first aggregate to distinct scores, so windows run over scores and not over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auroc(rows: DataFrame, by: list[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Pairwise AUROC by mid-ranks; null with one class alone."""
    scores = rows.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = scores.withColumn("below", below).groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") * 2 + F.col("neg"))).alias("w2"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return wins.select(*by, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), F.when(pairs > 0, F.col("w2") / (pairs * F.lit(2.0))).alias("auroc"))


def roc_points(rows: DataFrame, by: list[str], id_col: str, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """One point per row, positives first inside a tie, after the anchor (no threshold, 0, 1)."""
    w = Window.partitionBy(*by)
    run = w.orderBy(F.desc(p), F.desc(y), id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos, neg = F.sum(y).over(w), F.sum(1 - F.col(y)).over(w)
    points = rows.select(*by, F.col(p).alias("threshold"), F.sum(y).over(run).alias("tp"), F.sum(1 - F.col(y)).over(run).alias("fp"), F.row_number().over(w.orderBy(F.desc(p), F.desc(y), id_col)).alias("pos"), pos.alias("_p"), neg.alias("_n"))
    points = points.where("_p > 0 and _n > 0").select(*by, "pos", "threshold", (F.col("tp") / F.col("_p")).alias("sensitivity"), (1 - F.col("fp") / F.col("_n")).alias("specificity"))
    anchor = points.select(*by).distinct().select(*by, F.lit(0).alias("pos"), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("sensitivity"), F.lit(1.0).alias("specificity"))
    return anchor.unionByName(points)


def trapezoid(points: DataFrame, by: list[str]) -> DataFrame:
    xy = points.select(*by, (1 - F.col("specificity")).alias("x"), F.col("sensitivity").alias("yv")).distinct()
    w = Window.partitionBy(*by).orderBy("x", "yv")
    area = (F.col("x") - F.lag("x").over(w)) * (F.col("yv") + F.lag("yv").over(w)) / 2
    return xy.withColumn("a", area).groupBy(*by).agg(F.sum("a").alias("area"))


def sensitivity_at(points: DataFrame, by: list[str], specificity: float = 0.9) -> DataFrame:
    return points.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("specificity") >= F.lit(specificity), F.col("sensitivity"))), F.lit(0.0)).alias("sensitivity"))


def youden(points: DataFrame, by: list[str]) -> DataFrame:
    """Largest sensitivity + specificity - 1; of several the first point."""
    j = F.round(F.col("sensitivity") + F.col("specificity") - 1, 12)
    return points.withColumn("j", j).groupBy(*by).agg(F.max_by(F.struct("threshold", "sensitivity", "specificity", "j"), F.struct("j", -F.col("pos"))).alias("b")).select(*by, "b.*")


def confusion(rows: DataFrame, by: list[str], y: str = "y_true", p: str = "y_prob", cut: float = 0.5) -> DataFrame:
    said, true = F.col(p) >= cut, F.col(y) == 1
    c = rows.groupBy(*by).agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select(*by, "tp", "fp", "fn", "tn", ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), sens.alias("sensitivity"), spec.alias("specificity"), "brier")


def calibration(rows: DataFrame, by: list[str], y: str = "y_true", p: str = "y_prob", bins: int = 10, both_closed: bool = False) -> DataFrame:
    """Expected calibration error over equal bins with edges i * 0.1; half-open with the last closed, or ``both_closed`` (edge values count twice)."""
    edge = lambda i: F.lit(i / 10.0 if bins != 10 else i * 0.1)
    if both_closed:
        inside = F.array_compact(F.array(*[F.when(F.col(p).between(edge(i), edge(i + 1)), F.lit(i)) for i in range(bins)]))
    else:
        inside = F.array(sum((F.when(F.col(p) >= edge(i), 1).otherwise(0) for i in range(1, bins)), F.lit(0)))
    said = (F.col(p) >= 0.5).cast("int")
    right = (said == F.col(y)).cast("int")
    sure = F.greatest(F.col(p), 1 - F.col(p))
    cells = rows.select(*by, p, right.alias("ok"), sure.alias("sure"), F.explode(inside).alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("ok").alias("acc"), F.avg("sure").alias("conf"))
    total = rows.groupBy(*by).agg(F.count("*").alias("total"))
    joined = cells.join(total, by) if by else cells.crossJoin(F.broadcast(total))  # one row
    return joined.groupBy(*by).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("acc") - F.col("conf"))).alias("ece"))


def draw(seed: int, b: Column, k: Column, n: Column) -> Column:
    """Index 0 .. n-1 of the k-th draw of resample b, from a hash that SQL can repeat."""
    hexed = F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), k.cast("string"))), 1, 12)
    return F.pmod(F.conv(hexed, 16, 10).cast("bigint"), n)


def bootstrap_means(values: DataFrame, by: list[str], order: str, value: str, resamples: int, seed: int, paired: bool = True) -> DataFrame:
    """(by, b, mean) of resampled means. ``paired``: all groups share the drawn positions, as their hash has no group in it;
    otherwise each group draws for itself.

    Positions are joined to the draws, so a resample never sits in one task.
    """
    w = Window.partitionBy(*by)
    placed = values.select(*by, value, (F.row_number().over(w.orderBy(order)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    sizes = placed.select(*by, "n").distinct()
    draws = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    who = F.col("b") if paired else F.concat_ws(":", F.col("b").cast("string"), *[F.col(c).cast("string") for c in by])
    draws = draws.withColumn("i", draw(seed, who, F.col("k"), F.col("n")).cast("int"))
    return draws.drop("n").join(placed.drop("n"), [*by, "i"]).groupBy(*by, "b").agg(F.avg(value).alias("mean"))


def interval(means: DataFrame, by: list[str], value: str = "mean", level: float = 0.95) -> DataFrame:
    """Mean of the resamples and its exact percentile interval."""
    a = (1 - level) / 2
    return means.groupBy(*by).agg(F.avg(value).alias("point"), F.percentile(value, F.lit(a)).alias("low"), F.percentile(value, F.lit(1 - a)).alias("high"))


def subject_wins(rows: DataFrame, by: list[str], inner: str, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """One row per prediction set: ``pos`` and ``neg`` of each inner unit, in its order, and ``wins``, twice the wins of the
    positives of one unit (row) over the negatives of another (column), ties as half a win.

    Any resample of the units has its AUROC from these sums, without a look at rows or scores.
    """
    cells = rows.groupBy(*by, inner, p).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    w = Window.partitionBy(*by).orderBy(inner)
    units = cells.groupBy(*by, inner).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).withColumn("i", F.row_number().over(w) - 1)
    placed = cells.join(units.select(*by, inner, "i"), [*by, inner])
    left = placed.where("pos > 0").select(*by, F.col("i").alias("u"), p, "pos")
    # Each unit's negatives, counted up to every score that some positive has.
    asked = left.select(*by, p).distinct().join(units.select(*by, F.col("i").alias("v")), by).withColumn("neg", F.lit(0).cast("long"))
    counts = asked.unionByName(placed.where("neg > 0").select(*by, p, F.col("i").alias("v"), "neg")).groupBy(*by, "v", p).agg(F.sum("neg").alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by, "v").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = left.join(counts.withColumn("below", below), [*by, p]).groupBy(*by, "u", "v").agg(F.sum(F.col("pos") * (F.col("below") * 2 + F.col("neg"))).alias("x"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda s: s[c])
    sums = units.groupBy(*by).agg(listed("p").alias("pos"), listed("n").alias("neg"))
    grid = units.select(*by, F.col("i").alias("u")).join(units.select(*by, F.col("i").alias("v")), by).join(pairs, [*by, "u", "v"], "left")
    lines = grid.groupBy(*by, "u").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", F.coalesce("x", F.lit(0)).alias("x")))), lambda s: s["x"]).alias("line"))
    wins = lines.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("u", "line"))), lambda s: s["line"]).alias("wins"))
    return sums.join(wins, by)


def hierarchical_auroc(rows: DataFrame, by: list[str], seed: int, resamples: int = 10_000, outer: str = "seed", inner: str = "subject_id", y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """(by, b, auroc) of two-level resamples: outer units are drawn, then subjects inside each of them; the AUROCs of the
    drawn units are averaged, without those of one class alone. All groups share the outer draws; subjects are drawn
    for each group anew. An outer unit that a group lacks counts as one of one class alone.
    """
    sets = subject_wins(rows, [*by, outer], inner, y, p)
    units = sets.select(outer).distinct()
    ordered = units.withColumn("o", F.row_number().over(Window.orderBy(outer)) - 1)  # few outer units
    m = F.broadcast(ordered.agg(F.count("*").alias("m")))
    slots = rows.sparkSession.range(resamples).withColumnRenamed("id", "b").crossJoin(m).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    drawn = slots.withColumn("o", draw(seed, F.col("b"), F.col("slot"), F.col("m"))).join(F.broadcast(ordered), "o").join(F.broadcast(sets), outer)
    n = F.size("pos")
    key = F.concat_ws(":", F.col("b").cast("string"), F.col("slot").cast("string"), *[F.col(c).cast("string") for c in by])
    picked = drawn.select(*by, "b", "pos", "neg", "wins", F.transform(F.sequence(F.lit(0), n - 1), lambda k: draw(seed + 1, key, k, n).cast("int")).alias("i"))
    total = lambda c: F.aggregate("i", F.lit(0).cast("long"), lambda a, i: a + F.get(c, i))
    twice = F.aggregate("i", F.lit(0).cast("long"), lambda a, u: a + F.aggregate("i", F.lit(0).cast("long"), lambda x, v: x + F.get(F.get("wins", u), v)))
    sums = picked.select(*by, "b", twice.alias("w2"), (total("pos") * total("neg")).alias("pairs"))
    return sums.groupBy(*by, "b").agg(F.avg(F.when(F.col("pairs") > 0, F.col("w2") / (F.col("pairs") * 2.0))).alias("auroc"))


def mean_roc(points: DataFrame, by: list[str], set_col: str, steps: int = 200) -> DataFrame:
    """Mean over a group's prediction sets of the ROC interpolated on an even grid: at each x the highest point counts."""
    xy = points.groupBy(*by, set_col, (1 - F.col("specificity")).alias("x")).agg(F.max("sensitivity").alias("yv"))
    w = Window.partitionBy(*by, set_col).orderBy("x")
    spans = xy.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("yv").over(w))
    first = F.ceil(F.round(F.col("x") * (steps - 1), 9)).cast("int")
    last = F.when(F.col("x2").isNull(), F.lit(steps - 1)).otherwise(F.ceil(F.round(F.col("x2") * (steps - 1), 9)).cast("int") - 1)
    cells = spans.where(first <= last).withColumn("g", F.explode(F.sequence(first, last)))
    gx = F.col("g") / F.lit(float(steps - 1))
    value = F.when(F.col("x2").isNull() | (gx <= F.col("x")), F.col("yv")).otherwise(F.col("yv") + (F.col("y2") - F.col("yv")) * (gx - F.col("x")) / (F.col("x2") - F.col("x")))
    return cells.groupBy(*by, "g").agg(F.avg(value).alias("tpr"))


def per_thousand(rates: DataFrame, prevalences: list[float], specificity: float = 0.9) -> DataFrame:
    """Expected counts per thousand at each prevalence."""
    p = F.explode(F.array(*[F.lit(x) for x in prevalences])).alias("prevalence")
    r = rates.select("*", p)
    sick = F.col("prevalence") * 1000
    return r.select(*rates.columns, "prevalence", (sick * F.col("sensitivity")).alias("tp"), (sick * (1 - F.col("sensitivity"))).alias("fn"), ((1000 - sick) * specificity).alias("tn"), ((1000 - sick) * (1 - specificity)).alias("fp"))


def centroid_probe(vectors: DataFrame, group: str, vector: str, fold: str, block: int = 256) -> DataFrame:
    """How well a nearest-centroid probe tells groups: accuracy, chance and lift.

    Centroids are cut into blocks of a fixed number, and each probe vector meets each block once; so no task or
    broadcast holds all groups. The distance is Euclidean, a tie goes to the lesser group.
    """
    parts = vectors.where(F.col(fold) == "fit").select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    centroids = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    n = centroids.count()
    blocks = max(1, -(-n // block))
    held = centroids.withColumn("b", F.pmod(F.xxhash64(group), F.lit(blocks))).groupBy("b").agg(F.collect_list(F.struct(F.col(group).alias("g"), "c")).alias("all"))
    distance = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    probe = vectors.where(F.col(fold) == "probe").select(F.col(group).alias("own"), vector, F.monotonically_increasing_id().alias("row"))
    met = probe.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(held, "b")
    best = F.array_min(F.transform("all", lambda s: F.struct(distance(s["c"]).alias("d"), s["g"].alias("g"))))
    nearest = met.select("row", "own", best.alias("best")).groupBy("row").agg(F.first("own").alias("own"), F.min("best").alias("best"))
    return nearest.agg(F.avg((F.col("best.g") == F.col("own")).cast("int")).alias("accuracy")).withColumn("chance", F.lit(1.0 / n if n else None).cast("double")).withColumn("lift", F.col("accuracy") / F.col("chance"))
