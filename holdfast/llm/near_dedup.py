"""Near-duplicate documents by the Chosen Path similarity join.

Documents are sets of hashed word shingles. Equal sets form one class at once;
only one member of a class, its smallest id, goes on. Every representative has
``COORDINATES`` minwise values. In each of ``trees`` independent trees a path
starts at the root, and every node on it draws, by its own hash, the coordinate
whose value leads to the child; so documents of one path are alike in all
coordinates that its nodes drew. The first ``FIRST`` steps depend on nothing but
a document's own values and are taken at once. A node of more than ``small``
documents then branches on: two coordinates of its own extend the path of each
of its documents, so that a pair at the least similarity survives a level 1.6
times in expectation. Nodes that are small, are ``dense`` (most documents agree in both
coordinates too, so that branching would only copy them) or are left after
``depth`` levels are compared exhaustively. Nodes with the same documents count once.

Components need no more than a spanning forest, so a node first gives its best
one by minwise values (a large node that of each of its blocks), and its edges
are confirmed on the full sets. A node is done if its documents are of one component by then, or
if none of its candidates is left over. Candidates are all pairs whose sizes allow the
threshold and whose minwise values agree in no fewer places than six standard
deviations below it. In what is open, documents with candidates
in other components meet with their full texts: in one task for a node, or in
pairs of blocks of bounded size, of which the largest component meets only the
documents outside it. Each candidate is tested in one tree alone, and only links
that join components leave a task. So no candidate is lost to the forest, and
neither copies nor near misses are ever listed as pairs.

Defined cases: null text counts as empty; documents without words have an empty
set and link with nothing; documents of fewer words than a shingle have their
word sequence as their one shingle; repeated rows of one id are one document,
whose set is that of its rows' greatest digest; rows with null id are dropped
from linking and come out alone, without a component; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.common import Cache, doc_columns, raw_texts, text_slices
from holdfast.operators.components import connected_components
from holdfast.scratch import drop, release, written

COORDINATES = 128
TREES, FIRST, DEPTH = 24, 4, 3
#: Nodes up to this many documents are compared as they are; larger ones give forests by blocks of this size once they no longer branch.
SMALL, BLOCK = 64, 512
#: Ids that a map-side filter holds at most; beyond that it is a join.
IDS_IN_MEMORY = 500_000
#: Shingles, about, whose sets one task holds when it tests groups; bytes of minwise values that it holds.
BIN_SHINGLES, BIN_BYTES = 1_000_000, 16_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(text: bytes, n: int, cache: Cache) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text's UTF-8 bytes."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(3) + h[i : len(h) - k + 1 + i] + np.uint64(i + 1))
    if k < n:
        out ^= np.uint64(0x5555555555555555)  # a short text's sequence is no shingle of longer ones
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minwise values: the top 32 bits of multiply-shift hashes, in steps that stay in the processor's cache."""
    least = np.full(COORDINATES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    room = np.empty((min(256, len(shingles)), COORDINATES), np.uint64)
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256]
        hashes = np.multiply(part[:, None], _A, out=room[: len(part)])
        hashes += _B
        np.minimum(least, hashes.min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketch(values: np.ndarray) -> bytes:
    """What a document carries of its minwise values: their low 16 bits, by which other values are taken for equal once in 65,536 times."""
    return values.astype(np.uint16).tobytes()


def sketches(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, COORDINATES)


def set_digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _described(n: int):
    def run(batches):
        cache = Cache(word_hash)
        for batch in text_slices(batches):
            sizes, digests, sigs = [], [], []
            for raw in raw_texts(batch):
                s = shingle_set(raw, n, cache)
                cache.trim()
                sizes.append(len(s))
                digests.append(set_digest(s))
                sigs.append(sketch(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    return run


def _drawn(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two different coordinates by each node's hash."""
    draw = mixed(node + np.uint64(77))
    first = draw % np.uint64(COORDINATES)
    return first, (first + np.uint64(1) + (draw >> np.uint64(32)) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)


def _child(node: np.ndarray, coordinate: np.ndarray, sig: np.ndarray) -> np.ndarray:
    value = sig[np.arange(len(sig)), coordinate.astype(np.int64)].astype(np.uint64)
    return mixed(mixed(node * np.uint64(5) + coordinate + np.uint64(1)) + value)


def _paths(trees: int):
    """(node, doc_id) of each document's first steps in every tree."""

    def run(batches):
        for batch in batches:
            sig = sketches(batch["sig"].to_pylist())
            for t in range(trees):
                node = mixed(np.full(len(sig), t + 1, np.uint64))
                for _ in range(FIRST):
                    node = _child(node, _drawn(node)[0], sig)
                yield pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "doc_id": batch["doc_id"]})

    return run


def _branched(batches):
    """(parent, node, doc_id) of the children by two coordinates."""
    for batch in batches:
        node, sig = batch["node"].to_numpy().view(np.uint64), sketches(batch["sig"].to_pylist())
        for c in _drawn(node):
            yield pa.RecordBatch.from_pydict({"parent": batch["node"], "node": pa.array(_child(node, c, sig).view(np.int64)), "doc_id": batch["doc_id"]})


def _fits(n: np.ndarray, m: int, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be as similar as ``percent``."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def forest(ids: np.ndarray, sig: np.ndarray, n: np.ndarray, unsure: float, percent: int) -> tuple[list[tuple[int, int]], bool]:
    """The spanning forest of greatest agreement among the candidates (Prim's method); whether there are candidates beside it."""
    best, near, out, seen = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64), [], 0
    left = np.ones(len(ids), bool)
    for _ in range(len(ids)):
        v = int(np.argmax(np.where(left, best, -2.0)))
        left[v] = False
        if best[v] >= unsure:
            out.append((int(min(ids[v], ids[near[v]])), int(max(ids[v], ids[near[v]]))))
        rest = np.flatnonzero(left)
        rest = rest[_fits(n[rest], n[v], percent)]
        if len(rest):
            alike = (sig[rest] == sig[v]).mean(1)
            seen += int((alike >= unsure).sum())
            better = alike > best[rest]
            best[rest[better]], near[rest[better]] = alike[better], v
    return out, seen > len(out)


def tested(ids: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], component: np.ndarray, unsure: float, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that hold on the full sets and join different components: all candidates are tested (of different sides, where sides are given), save those that earlier links made one component."""
    out, sizes = [], np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    coded = np.split(codes, np.cumsum(sizes)[:-1])
    mine = np.zeros(int(codes.max()) + 1, bool)
    component = component.copy()
    for i in range(len(ids) - 1):
        others = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
        if side is not None:
            others = others[side[others] != side[i]]
        others = others[_fits(sizes[others], sizes[i], percent)]
        others = others[(sig[others] == sig[i]).mean(1) >= unsure]
        if not len(others):
            continue
        mine[coded[i]] = True
        both = np.add.reduceat(mine[np.concatenate([coded[j] for j in others])], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        mine[coded[i]] = False
        for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)]:
            if component[j] != component[i]:
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                component[component == component[j]] = component[i]
    return out


def involved(gid: int, sig: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray | None, opens: list[np.ndarray], unsure: float, percent: int) -> np.ndarray:
    """Which documents of a group have candidates in other components, save those that a group of smaller id holds too."""
    some = np.zeros(len(n), bool)
    # Groups of smaller id that two or more documents share, a column each.
    earlier = np.concatenate(opens)
    owner = np.repeat(np.arange(len(n)), [len(o) for o in opens])
    owner, earlier = owner[earlier < gid], earlier[earlier < gid]
    names, at, times = np.unique(earlier, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = np.zeros((len(n), max(1, int((times > 1).sum()))), bool)
    many = times[at] > 1 if len(at) else np.zeros(0, bool)
    shared[owner[many], column[at[many]]] = True
    for i in range(len(n) - 1):
        others = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
        if side is not None:
            others = others[side[others] != side[i]]
        others = others[_fits(n[others], n[i], percent)]
        others = others[(sig[others] == sig[i]).mean(1) >= unsure]
        mine = np.flatnonzero(shared[i])
        if len(mine) and len(others):
            others = others[~shared[np.ix_(others, mine)].any(1)]
        if len(others):
            some[i] = True
            some[others] = True
    return some


def _cut(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """A bin's rows by group, and where each group lies."""
    pdf = pdf.sort_values(["gid", "doc_id"], kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(pdf["gid"].to_numpy())) + 1).tolist(), len(pdf)]
    return pdf, list(zip(cuts, cuts[1:], strict=False))


def _forests(unsure: float, percent: int):
    """(gid, src, dst, more) of the forests of all groups in a bin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = _cut(pdf)
        gids, ids, sig, n = pdf["gid"].to_numpy(), pdf["doc_id"].to_numpy(), sketches(pdf["sig"]), pdf["n"].to_numpy()
        out = []
        for s, e in parts:
            edges, more = forest(ids[s:e], sig[s:e], n[s:e], unsure, percent)
            out += [(int(gids[s]), x, y, more) for x, y in edges]
        return pd.DataFrame(out, columns=["gid", "src", "dst", "more"]).astype({"gid": "int64", "src": "int64", "dst": "int64", "more": "bool"})

    return run


def _sides(pdf: pd.DataFrame, s: int, e: int) -> np.ndarray | None:
    return pdf["side"].to_numpy()[s:e] if pdf["cross"].iat[s] else None


def _involved_groups(unsure: float, percent: int):
    """(gid, doc_id) of the documents with candidates to test in each group of a bin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = _cut(pdf)
        ids, sig, n, component = pdf["doc_id"].to_numpy(), sketches(pdf["sig"]), pdf["n"].to_numpy(), pdf["component"].to_numpy()
        keep = np.zeros(len(pdf), bool)
        for s, e in parts:
            opens = [np.asarray(o, np.int64) for o in pdf["opens"].iloc[s:e]]
            keep[s:e] = involved(int(pdf["node"].iat[s]), sig[s:e], n[s:e], component[s:e], _sides(pdf, s, e), opens, unsure, percent)
        return pd.DataFrame({"gid": pdf["gid"].to_numpy()[keep], "doc_id": ids[keep], "component": component[keep], "side": pdf["side"].to_numpy()[keep], "cross": pdf["cross"].to_numpy()[keep], "n": n[keep]})

    return run


def _tested_groups(shingle_words: int, unsure: float, percent: int):
    """(src, dst) of the links that the groups in a bin lack."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = _cut(pdf.drop_duplicates(["gid", "doc_id"]))
        cache, out = Cache(word_hash), []
        ids, sig, component = pdf["doc_id"].to_numpy(), sketches(pdf["sig"]), pdf["component"].to_numpy()
        for s, e in parts:
            if (component[s:e] != component[s]).any():
                sets = [shingle_set(t.encode(), shingle_words, cache) for t in pdf["text"].iloc[s:e]]
                cache.trim()
                out += tested(ids[s:e], sig[s:e], sets, component[s:e], unsure, percent, _sides(pdf, s, e))
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return run


def groups(reps: DataFrame, trees: int, small: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(gid, doc_id) of small nodes, each set of documents once; the same of large ones that no longer branch, with their size."""
    light, dense_parts, made = [], [], []
    nodes = reps.select("doc_id", "sig").mapInArrow(_paths(trees), "node long, doc_id long")
    for level in range(depth + 1):
        sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        tagged = written(nodes.join(sizes, "node"), "dedup-nodes")
        made.append(tagged)
        light.append(tagged.where(F.col("size") <= small).select("node", "doc_id", "size"))
        large = tagged.where(F.col("size") > small)
        if large.isEmpty():
            break
        dense = large
        if level < depth:
            children = written(large.select("node", "doc_id").join(reps.select("doc_id", "sig"), "doc_id").mapInArrow(_branched, "parent long, node long, doc_id long"), "dedup-children")
            parents = large.select(F.col("node").alias("parent"), "size").distinct()
            per_child = children.groupBy("parent", "node").agg(F.count("*").alias("n"))
            close = per_child.join(parents, "parent").groupBy("parent").agg(F.sum(F.when(F.col("n") * 2 > F.col("size"), 1).otherwise(0)).alias("kept"))
            stuck = written(close.where("kept >= 2").select("parent"), "dedup-dense")
            made += [children, stuck]
            dense = large.join(stuck.withColumnRenamed("parent", "node"), "node", "left_semi")
            nodes = children.join(stuck, "parent", "left_anti").select("node", "doc_id")
        dense_parts.append(dense.select("node", "doc_id", "size"))
    found = _union(light)
    marks = found.groupBy("node").agg(F.count("*").alias("size"), *(F.bit_xor(F.xxhash64(F.lit(k), "doc_id")).alias(f"mark{k}") for k in (1, 2)))
    once = marks.groupBy("size", "mark1", "mark2").agg(F.min("node").alias("node")).select("node")
    members = written(found.join(once, "node", "left_semi").select(F.col("node").alias("gid"), "doc_id"), "dedup-groups")
    dense = written((_union(dense_parts) if dense_parts else found.where("false")).withColumnRenamed("node", "gid"), "dedup-large")
    drop(*made)
    return members, dense


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def _binned(df: DataFrame, weight: float, most: float):
    """Groups dealt to bins whose weight is about ``most``; a group is never cut."""
    spread = 8 * max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.withColumn("bin", F.pmod(F.xxhash64("gid"), F.lit(max(spread, int(weight / most) + 1))).cast("int")).groupBy("bin")


def links(docs: DataFrame, reps: DataFrame, n: int, percent: int, trees: int = TREES, small: int = SMALL, block: int = BLOCK, depth: int = DEPTH, bin_shingles: int = BIN_SHINGLES) -> DataFrame:
    """Confirmed links (src < dst) among representatives (doc_id, n, digest, alone, sig): enough of them for the components."""
    share = percent / 100
    unsure = share - 6 * (share * (1 - share) / COORDINATES) ** 0.5
    members, dense = groups(reps, trees, small, depth)
    held = reps.select("doc_id", "n", "sig")
    width = 2 * COORDINATES + 64
    in_block = F.xxhash64("gid", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / F.lit(block))))
    compared = members.unionByName(dense.select(in_block.alias("gid"), "doc_id")).join(held, "doc_id")
    first = written(_binned(compared, width * (members.count() + dense.count()), BIN_BYTES).applyInPandas(_forests(unsure, percent), "gid long, src long, dst long, more boolean"), "dedup-first")
    sure = written(confirmed(docs, reps, first.select("src", "dst").distinct(), n, percent), "dedup-sure")
    parts = written(connected_components(sure).withColumnsRenamed({"node": "doc_id"}), "dedup-parts")
    # Open: small nodes of which an edge failed while they have other candidates, and large nodes; of these, what is of several components.
    failed = written(first.where("more").join(sure, ["src", "dst"], "left_anti").select("gid").distinct(), "dedup-failed")
    left = members.join(_sent(failed), "gid", "left_semi").unionByName(dense.select("gid", "doc_id"))
    left = left.join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = written(left.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gid"), "dedup-several")
    # A group may hold a third of all rows: it isn't dealt out by its id where the groups' table can go to the rows.
    left = written(left.join(_sent(several), "gid", "left_semi").join(reps.select("doc_id", "n"), "doc_id"), "dedup-open")
    drop(members, dense, first, parts, failed, several)
    if left.isEmpty():
        drop(left)
        return sure
    met = written(_met(left, bin_shingles), "dedup-met")
    opens = left.groupBy("doc_id").agg(F.sort_array(F.collect_set("gid")).alias("opens"))  # as many as the trees have paths
    asked = met.join(opens, "doc_id").join(reps.select("doc_id", "sig"), "doc_id")
    kinds = "gid long, doc_id long, component long, side int, cross boolean, n long"
    close = written(_binned(asked, (width + 200) * met.count(), BIN_BYTES).applyInPandas(_involved_groups(unsure, percent), kinds), "dedup-close")
    drop(left, met)
    total = close.agg(F.sum("n").alias("n")).first().n or 0
    texts = held_texts(docs, reps, close.select("doc_id"), n)
    meeting = close.select("gid", "doc_id", "component", "side", "cross").join(reps.select("doc_id", "sig"), "doc_id").join(texts, "doc_id")
    rest = written(_binned(meeting, total, bin_shingles).applyInPandas(_tested_groups(n, unsure, percent), "src long, dst long").distinct(), "dedup-rest")
    drop(close)
    return sure.unionByName(rest)


def _sent(table: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast, if it has no more than IDS_IN_MEMORY rows."""
    return F.broadcast(table) if table.count() <= IDS_IN_MEMORY else table


def _met(left: DataFrame, bin_shingles: int) -> DataFrame:
    """Open groups as (gid, node, doc_id, component, n, side, cross): whole where they are small, else by blocks.

    Of a large group, the largest component's blocks meet the blocks of the other documents, and those meet one another.
    """
    by_part = left.groupBy("gid", "component").agg(F.sum("n").alias("k"))
    size = by_part.groupBy("gid").agg(F.sum("k").alias("all"), F.max(F.struct("k", "component")).alias("main"))
    blocks = lambda k: F.greatest(F.lit(1), F.ceil(k / F.lit(bin_shingles / 2)).cast("int"))
    size = size.select("gid", "all", F.col("main.component").alias("main"), blocks(F.col("main.k")).alias("mains"), blocks(F.col("all") - F.col("main.k")).alias("others"))
    size = written(size, "dedup-split")
    rows = left.join(_sent(size), "gid").withColumn("is_main", F.col("component") == F.col("main"))
    whole = F.col("all") <= bin_shingles
    one = rows.where(whole).select("gid", F.col("gid").alias("node"), "doc_id", "component", "n", F.lit(0).alias("side"), F.lit(False).alias("cross"))
    cut = rows.where(~whole).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    columns = ["gid", "node", "doc_id", "component", "n", "side", "cross"]
    # (other block a, main block b): the pairs inside an other block are those of its meeting with main block 0.
    main = cut.where("is_main").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("b", F.col("block")).withColumn("side", F.lit(1))
    other = cut.where(~F.col("is_main")).withColumn("a", F.col("block")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("mains") - 1))).withColumn("side", F.lit(0))
    with_main = main.unionByName(other).withColumn("node", F.col("gid")).withColumn("cross", F.col("b") > 0).withColumn("gid", F.xxhash64("node", F.lit("main"), "a", "b")).select(columns)
    among = cut.where(~F.col("is_main") & (F.col("others") > 1)).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).where("o <> block")
    among = among.withColumn("node", F.col("gid")).withColumn("side", (F.col("block") > F.col("o")).cast("int")).withColumn("cross", F.lit(True))
    among = among.withColumn("gid", F.xxhash64("node", F.lit("other"), F.least("block", "o"), F.greatest("block", "o"))).select(columns)
    return one.unionByName(with_main).unionByName(among)


def held_texts(docs: DataFrame, reps: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) of the representatives in ``ids``; where an id has several rows, a text whose set stands for it, once a task."""
    wanted = written(ids.distinct().join(reps.select("doc_id", "digest", "alone"), "doc_id"), "dedup-ids")

    def standing(batches):
        cache, given = Cache(word_hash), set()
        for batch in text_slices(batches):
            keep = []
            for doc, alone, digest, raw in zip(batch["doc_id"].to_pylist(), batch["alone"].to_pylist(), batch["digest"].to_pylist(), raw_texts(batch), strict=True):
                keep.append(alone or (doc not in given and set_digest(shingle_set(raw, n, cache)) == digest))
                if keep[-1] and not alone:
                    given.add(doc)
            cache.trim()
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep, pa.bool_()))

    joined = docs.join(_sent(wanted), "doc_id").select("doc_id", "text", "digest", "alone")
    return written(joined.mapInArrow(standing, "doc_id long, text string"), "dedup-texts")


def confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full shingle sets."""
    pairs = written(pairs, "dedup-pairs")
    texts = held_texts(docs, reps, pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")), n)

    def check(batches):
        cache = Cache(word_hash)
        for batch in batches:
            last, theirs, keep = None, None, []
            for doc, a, b in zip(batch["dst"].to_pylist(), batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                if doc != last:  # rows come by dst
                    last, theirs = doc, shingle_set(b.encode(), n, cache)
                own = shingle_set(a.encode(), n, cache)
                both = len(np.intersect1d(own, theirs, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(theirs) - both))
                cache.trim()
            yield pa.RecordBatch.from_pydict({"src": batch["src"], "dst": batch["dst"]}).filter(pa.array(keep, pa.bool_()))

    a, b = texts.select(F.col("doc_id").alias("src"), F.col("text").alias("a")), texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(check, "src long, dst long").distinct()


def one_row(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """Rows of ``docs`` with one row per id, null ids left out: of an id's rows the one whose set stands for it in
    near_duplicates(), the greatest digest; of equal ones the one that sorts last."""
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "dedup-repeated")
    docs = docs.where("doc_id is not null")
    few = repeated.limit(IDS_IN_MEMORY + 1).count()
    if not few:
        return docs
    ids = F.broadcast(repeated) if few <= IDS_IN_MEMORY else repeated
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def digests(batches):
        cache = Cache(word_hash)
        for batch in text_slices(batches):
            sets = [shingle_set(raw, shingle_words, cache) for raw in raw_texts(batch)]
            cache.trim()
            found = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "_digest"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_digest", T.BinaryType())])
    judged = docs.join(ids, "doc_id", "left_semi").select(*docs.columns).mapInArrow(digests, schema)
    order = F.struct("_digest", "text", F.to_json(F.struct(*rest)) if rest else F.lit(""))
    best = judged.groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(best)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. ``options`` are those of links()."""
    docs = doc_columns(docs)
    spark = docs.sparkSession
    rows = written(docs.mapInArrow(_described(shingle_words), "doc_id long, n long, digest binary, sig binary"), "dedup-docs")
    by_id = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("digest", "n")).alias("d"), F.min("digest").alias("least"), F.count("*").alias("rows"))
    ids = written(by_id.select("doc_id", "d.digest", "d.n", (F.col("rows") == 1).alias("alone"), (F.col("least") < F.col("d.digest")).alias("several")), "dedup-named")
    usable = rows.where("doc_id is not null and digest is not null")
    # Ids of different texts: only the row that stands for the id counts. They are few, or meet their rows by a join.
    several = ids.where("several").select("doc_id", F.col("digest").alias("standing"))
    number = several.limit(IDS_IN_MEMORY + 1).count()
    if number:
        usable = usable.join(F.broadcast(several) if number <= IDS_IN_MEMORY else several, "doc_id", "left").where("standing is null or standing = digest")
    # A class's smallest id, and the minwise values of its set.
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "dedup-classes")
    alone = ids.where("alone").select("doc_id", "alone")
    reps = written(classes.join(alone, "doc_id", "left").withColumn("alone", F.coalesce("alone", F.lit(False))), "dedup-reps")
    release(spark)
    linked = written(links(docs, reps, shingle_words, percent, **options), "dedup-links")
    components = written(connected_components(linked), "dedup-components").withColumnsRenamed({"node": "rep", "component": "joined"})
    named = classes.select("digest", F.col("doc_id").alias("rep")).join(components, "rep", "left").select("digest", F.coalesce("joined", "rep").alias("component_id"))
    # A component is named by its smallest id: the smallest representative, as each is the smallest of its class.
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    judged = ids.select("doc_id", "digest", "n").join(named, "digest", "left").select("doc_id", "n", own.alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("own_n")).join(judged, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", "own_n").alias("n_shingles"), "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))
