"""Exact top-k by inner product, with block-at-a-time pruning.

Vectors are quantised to integers. Candidates fall into segments by a hash of
their id. A segment's candidates are put in an order in which like vectors stand
together (by the nearest of a few of them), and cut into blocks, ranges of that
order. A block keeps its
forward index (the matrix of its vectors) and each term's largest and smallest
component. For a query, a block's bound is the sum over terms of the larger of
q * max and q * min, or by the distance from the block's mean where that is less.
Every query visits a segment's blocks in descending order
of bound, scores them through the forward index, and stops once its k-th score
so far exceeds the bound of all that are left. The best k of each segment merge
to the best k of all. A query first meets one segment; its k-th score there is
the least that it asks of the others.

Queries travel in chunks; each chunk meets each segment in a task of its own,
whose data have a fixed size. That is the stated query set against all rows, in
blocks. How much the bounds spare depends on the vectors: where they lie in
clusters most blocks are never scored, where they point in all directions alike
no bound of this kind can spare any.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; of unequal lengths, the shorter counts as padded with
zeros; rows with null id take no part; ties go to the smaller id; repeated ids
are candidates each, but never for a query of the same id; a repeated query
counts once, and different vectors under one query id share its k places; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import small_batches
from holdfast.scratch import written

#: Vectors in a segment, a block and a chunk of queries, at about 64 components; queries that a task scores at once.
SEGMENT, BLOCK, CHUNK, TURN = 16_384, 128, 16_384, 2_048


def quantised(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): v = floor(scale * x) per component, of usable vectors alone."""
    v = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every partial sum fits 53 bits, else in Python integers of 64 bits or more."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 2**62 else (a.astype(object) @ b.astype(object).T)


def _merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k by score, then by smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _together(ids: np.ndarray, c: np.ndarray, block: int) -> np.ndarray:
    """An order of the candidates in which those with the same nearest pivot stand together; pivots are some of them, moved twice to their followers' mean."""
    n = -(-len(ids) // block)
    pivots = c[np.linspace(0, len(ids) - 1, min(n, 256)).astype(np.int64)].astype(np.float64)
    nearest = np.zeros(len(ids), np.int64)
    for turn in range(3):
        nearest = np.concatenate([np.argmax(c[s : s + 4096] @ pivots.T - (pivots * pivots).sum(1) / 2, axis=1) for s in range(0, len(ids), 4096)])
        if turn < 2:
            size = np.bincount(nearest, minlength=len(pivots))
            order = np.argsort(nearest, kind="stable")
            full = np.flatnonzero(size)
            pivots[full] = np.add.reduceat(c[order].astype(np.float64), (np.cumsum(size) - size)[full]) / size[full, None]
    return np.lexsort((ids, nearest))


def _bounds(q: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """What a query can score in a block at most: the summed term maxima, or by mean and radius where that is less."""
    summed = _product(np.maximum(q, 0), np.stack([b.max(0) for b in blocks])) + _product(np.minimum(q, 0), np.stack([b.min(0) for b in blocks]))
    if summed.dtype == object:  # too large for doubles
        return summed
    means = np.stack([b.mean(0) for b in blocks])
    radius = np.array([np.sqrt(((b - m) ** 2).sum(1).max()) for b, m in zip(blocks, means, strict=True)])
    real = q.astype(np.float64)
    around = real @ means.T + np.sqrt((real * real).sum(1))[:, None] * radius
    return np.minimum(summed, np.ceil(around * (1 + 1e-9) + 1).clip(-(2.0**62), 2.0**62).astype(np.int64))


def search_blocks(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, block: int = BLOCK, least: np.ndarray | None = None, tally: list | None = None) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's best k among the candidates, block by block.

    ``least``: scores below it are of no interest to a query. ``tally`` gets the number of pairs scored.
    """
    order = _together(c_ids, c, block)
    c_ids, c = c_ids[order], c[order]
    starts = list(range(0, len(c_ids), block))
    bounds = _bounds(q, [c[s : s + block] for s in starts])
    visit = np.argsort(-bounds, axis=1, kind="stable")
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
    floor = np.full(len(q_ids), -(2**63), object if bounds.dtype == object else np.int64) if least is None else least.copy()
    alive, every = np.ones(len(q_ids), bool), np.arange(len(q_ids))
    for step in range(len(starts)):
        at = visit[:, step]
        # An equal bound must still be visited: an equal score may have a smaller id.
        alive &= (bounds[every, at] >= floor).astype(bool)
        rows = np.flatnonzero(alive)
        if not len(rows):
            break
        for b in np.unique(at[rows]):
            mine = rows[at[rows] == b]
            ids = c_ids[starts[b] : starts[b] + block]
            scores = _product(q[mine], c[starts[b] : starts[b] + block])
            if tally is not None:
                tally.append(scores.size)
            fits = (scores >= floor[mine][:, None]).astype(bool) & (ids[None, :] != q_ids[mine][:, None])
            for n in np.flatnonzero(fits.any(1)):
                j, f = mine[n], fits[n]
                best[j] = _merge(np.concatenate([best[j][0], scores[n][f]]), np.concatenate([best[j][1], ids[f]]), k)
                if len(best[j][0]) == k:
                    floor[j] = max(floor[j], best[j][0][-1])
    return [(int(qid), int(i), int(s)) for qid, (ss, ii) in zip(q_ids, best, strict=True) for s, i in zip(ss, ii, strict=True)]


def top_k(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """Each query's k best: query_id, rank (from 1), vec_id, score. ``is_query`` is a condition on the column ``id``."""
    small_batches(table.sparkSession)
    rows = written(quantised(table, id_col, vector_col, scale).withColumn("is_query", is_query), "topk-rows")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    segments, chunks = max(1, -(-sizes.n // segment)), max(1, -(-sizes.q // chunk))
    name = F.xxhash64(F.lit(3), "id", "v")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(F.pmod(name, F.lit(segments)).cast("int").alias("s"), every(chunks).alias("c"), F.col("id").alias("held_id"), F.col("v").alias("held"))
    queries = rows.where("is_query").dropDuplicates(["id", "v"]).select(F.pmod(name, F.lit(chunks)).cast("int").alias("c"), "id", "v", F.lit(None).cast("long").alias("least"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(int(q["v"].map(len).max()), int(c["held"].map(len).max()))
        ids, vectors, found = c["held_id"].to_numpy(), _matrix(c["held"], width), []
        for s in range(0, len(q), TURN):
            part = q.iloc[s : s + TURN]
            found += search_blocks(part["id"].to_numpy(), _matrix(part["v"], width), ids, vectors, k, least=part["least"].fillna(-(2**63)).astype("int64").to_numpy())
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    def near(asked: DataFrame, held: DataFrame) -> DataFrame:
        return asked.select("s", "c", "id", "v", "least").groupBy("s", "c").cogroup(held.groupBy("s", "c")).applyInPandas(meet, "query_id long, vec_id long, score long")

    own = F.pmod(F.col("c"), F.lit(segments)).cast("int")
    found = near(queries.withColumn("s", own), candidates.where(F.col("s") == own))
    if segments > 1:
        found = written(found, "topk-first")
        # Ids of several query vectors share k places, so the k-th score of an id is no bound for them; its rank is of the id's rows.
        several = rows.where("is_query").groupBy("id").agg(F.countDistinct("v").alias("n")).where("n > 1").select("id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        kth = found.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least")).join(several, "id", "left_anti")
        others = queries.drop("least").join(kth, "id", "left").withColumn("s", every(segments)).where(F.col("s") != own)
        found = found.unionByName(near(others, candidates.where(F.col("s") != own)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
