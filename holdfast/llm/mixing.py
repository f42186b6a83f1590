"""Temperature mixing of sources to target weights, in DataFrame functions alone.

With p the sources' token shares, weights are p^a / sum p^a. The exponent a is
the smallest in [0, 1] for which the weights' entropy is at most
``entropy_share`` of its maximum and no source is repeated more than
``max_repeat`` times; both fall as a rises, so a search by sections finds it
(a = 1, no change, where even that misses a target). The sums it needs are
aggregates over the table of sources; the driver sees two numbers a section.

A source's budget is its weight times ``budget`` tokens. It is realised as
whole passes over the source plus a part of one more: documents are hashed to
blocks of about ``block_tokens``, every pass has a permutation of the blocks of
its own, and in the last one blocks are taken until the budget is met. In the
block where it is met, documents are taken in hash order while they fit. So a
source misses its budget by less than one document. A document's copies name the
place of its block in each pass, and mix() puts them in that order, all sources
side by side in proportion. Places are counted by ranges of the permutation's
keys, so no window spans a source's blocks or documents: only a range's blocks,
a source's ranges or one block's documents.

Defined cases: null text has no tokens; a null source is a source of its own;
sources without tokens keep each document once; repeated rows are documents of
their own that share one decision; an empty table gives an empty table; other
columns pass through, also if they have names used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.scratch import written

#: Sections per round and rounds: the exponent is found to 33^-6, about 1e-9.
_SECTIONS, _ROUNDS = 32, 6
#: Blocks of a source, about, whose places one task counts.
RANGE_BLOCKS = 4096


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def exponent(sizes: DataFrame, entropy_share: float, max_repeat: float, budget: float, total: float) -> float:
    """The smallest exponent in [0, 1] that meets both targets, or 1."""
    n = sizes.count()
    if n == 0 or total <= 0:
        return 1.0
    shares = sizes.select((F.col("tokens") / F.lit(total)).alias("p"))
    limit = F.lit(float(entropy_share)) * F.log(F.lit(float(n)))
    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        step = (high - low) / (_SECTIONS + 1)
        a = F.col("a")
        found = (
            shares.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(_SECTIONS))))
            .withColumn("a", F.lit(low) + F.col("i") * F.lit(step))
            .groupBy("i", "a")
            .agg(F.sum(F.pow("p", a)).alias("z"), F.sum(F.pow("p", a) * F.log("p")).alias("zl"), F.max(F.pow("p", a - 1)).alias("most"))
            .where((F.log("z") - a * F.col("zl") / F.col("z") <= limit + 1e-12) & (F.lit(budget / total) * F.col("most") / F.col("z") <= float(max_repeat)))
            .agg(F.min("i").alias("i"))
            .first()
        )
        i = _SECTIONS + 1 if found.i is None else found.i
        if i == 0:
            return low
        low, high = low + (i - 1) * step, min(high, low + i * step)
    return high


def weights(sizes: DataFrame, entropy_share: float, max_repeat: float, budget: float | None = None) -> DataFrame:
    """(source key, tokens, weight, passes): passes is the budget in copies of the source."""
    total = float(sizes.agg(F.sum("tokens").alias("t")).first().t or 0)
    budget = total if budget is None else float(budget)
    full = sizes.where("tokens > 0")
    a = exponent(full, entropy_share, max_repeat, budget, total)
    powered = full.withColumn("pa", F.pow(F.col("tokens") / F.lit(max(total, 1.0)), F.lit(a)))
    z = float(powered.agg(F.sum("pa").alias("z")).first().z or 1.0)
    weight = F.col("pa") / F.lit(z)
    return powered.select("_mix_source", "tokens", weight.alias("weight"), (weight * F.lit(budget) / F.col("tokens")).alias("passes"))


def plan_copies(docs: DataFrame, entropy_share: float = 0.97, max_repeat: float = 4.0, budget: float | None = None, block_tokens: int = 200_000, seed: int = 0) -> DataFrame:
    """``docs`` with ``_mix_tokens``, ``_mix_weight`` and ``_mix_copies``; every row once."""
    key = docs.withColumns(
        {
            "_mix_source": F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")),
            "_mix_tokens": token_count(F.col("text")),
            "_mix_key": F.xxhash64(F.lit(seed), F.col("doc_id")),
        }
    )
    sizes = written(key.groupBy("_mix_source").agg(F.sum("_mix_tokens").alias("tokens")), "mix-sizes")
    shares = written(weights(sizes, entropy_share, max_repeat, budget).withColumnsRenamed({"tokens": "_mix_total", "weight": "_mix_weight", "passes": "_mix_passes"}), "mix-weights")
    blocks_of = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_mix_total") / F.lit(block_tokens)))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), blocks_of)
    blocked = key.join(shares, "_mix_source", "left").withColumn("_mix_block", F.coalesce(block, F.lit(0).cast("long")))
    light = blocked.select("_mix_source", "_mix_block", "_mix_key", "_mix_tokens", "_mix_total", "_mix_passes")
    held = light.where("_mix_passes is not null").groupBy("_mix_source", "_mix_block", "_mix_total", "_mix_passes").agg(F.sum("_mix_tokens").alias("_mix_held"))
    blocks = written(permuted(written(held, "mix-held"), block_tokens, seed), "mix-blocks")
    inside = Window.partitionBy("_mix_source", "_mix_block").orderBy("_mix_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        light.join(blocks.where("_mix_left > 0 and _mix_left < _mix_held"), ["_mix_source", "_mix_block"])
        .withColumn("_mix_run", F.sum("_mix_tokens").over(inside))
        .where("_mix_run <= _mix_left")
        .groupBy("_mix_source", "_mix_block")
        .agg(F.max("_mix_key").alias("_mix_cut"))
    )
    plan = written(blocks.join(cuts, ["_mix_source", "_mix_block"], "left").select("_mix_source", "_mix_block", "_mix_left", "_mix_held", "_mix_cut", "_mix_order"), "mix-plan")
    extra = F.when((F.col("_mix_left") > 0) & (F.col("_mix_left") >= F.col("_mix_held")), 1).when(F.col("_mix_key") <= F.col("_mix_cut"), 1).otherwise(0)
    copies = F.when(F.col("_mix_passes").isNull(), F.lit(1)).otherwise(F.floor("_mix_passes") + extra).cast("long")
    places = F.coalesce(F.slice("_mix_order", F.lit(1), copies.cast("int")), F.array(F.lit(1).cast("long")))
    return blocked.join(plan, ["_mix_source", "_mix_block"], "left").select(
        *docs.columns, "_mix_tokens", F.coalesce("_mix_weight", F.lit(0.0)).alias("_mix_weight"), copies.alias("_mix_copies"), "_mix_block", places.alias("_mix_places"),
        # Where in the whole each copy's place lies, from 0 to 1.
        F.transform(places, lambda at, i: (i + (at - 1) / blocks_of) / F.coalesce("_mix_passes", F.lit(1.0))).alias("_mix_when"), "_mix_key",
    )


def permuted(held: DataFrame, block_tokens: int, seed: int, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """Blocks with ``_mix_order``, their places in every pass, and ``_mix_left``, what the last pass's budget has left when their turn comes."""
    last = F.floor("_mix_passes")
    rows = held.withColumn("_mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("_mix_at", F.xxhash64(F.lit(seed + 2), "_mix_source", "_mix_pass", "_mix_block"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("_mix_total") / F.lit(block_tokens) / F.lit(range_blocks)))
    rows = rows.withColumn("_mix_range", F.floor((F.col("_mix_at") / F.lit(2.0**64) + 0.5) * ranges).cast("long"))
    own = ["_mix_source", "_mix_pass"]
    before = Window.partitionBy(*own).orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*own, "_mix_range").agg(F.count("*").alias("n"), F.sum("_mix_held").alias("t"))
    totals = totals.select(*own, "_mix_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_n"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_mix_t"))
    inside = Window.partitionBy(*own, "_mix_range").orderBy("_mix_at", "_mix_block")
    run = F.coalesce(F.sum("_mix_held").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"_mix_rank": F.row_number().over(inside), "_mix_run": run}).join(totals, [*own, "_mix_range"])
    rest = (F.col("_mix_passes") - last) * F.col("_mix_total")
    return (
        placed.groupBy("_mix_source", "_mix_block")
        .agg(
            F.first("_mix_held").alias("_mix_held"),
            F.max(F.when(F.col("_mix_pass") == last, rest - F.col("_mix_t") - F.col("_mix_run"))).alias("_mix_left"),
            F.sort_array(F.collect_list(F.struct("_mix_pass", (F.col("_mix_n") + F.col("_mix_rank")).alias("place")))).alias("_mix_order"),
        )
        .withColumn("_mix_order", F.transform("_mix_order", lambda x: x["place"]))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed to the target weights: each row as often as its copies say, in the order of the permutations."""
    planned = plan_copies(docs, **options)
    copies = planned.select("*", F.explode("_mix_when").alias("_mix_turn"))
    order = ["_mix_turn", F.xxhash64("_mix_block", "_mix_weight"), "_mix_key"]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
