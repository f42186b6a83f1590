"""Benchmark decontamination: a BM25 index of test items, queried by every training document.

The index holds the items' terms, with postings sorted by item and cut into
blocks, each with its largest score. A document of up to
twice the words of the longest item queries the index as one passage, by
block-max WAND; a longer one queries it by all its terms at once, so that an
item is found also where its parts lie far apart. In the walk, cursors pass
over the postings, and an item is scored only if the block
maxima of the cursors at or before it reach the threshold of its block, which
is ``ratio`` times the least score that an item of the block has against
itself. Every item at or over its own threshold is retrieved; there is no
limit on their number. A retrieved item is verified on the document's whole
text: of the five-word shingles of its question and of its answer, the document
must hold ``overlap`` in all, and some of each part.

An item's last sentence or line is its answer, what is before is its question;
an item of one sentence is a question alone.

Defined cases: null texts count as empty; an empty item is never found, and an
item or answer of fewer than five words has its whole word sequence as its one
shingle; repeated rows get equal results; an empty benchmark finds nothing; an
empty table gives an empty table; other columns are ignored.

The index is a broadcast; ``max_index_words`` bounds it, and a larger benchmark
is cut into parts of that size, which pass through the driver and are queried one
at a time. Scores and passages come from the whole benchmark's statistics, counted
by Spark, so the parts do not change the result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Cache, doc_columns, small_batches, text_slices, texts
from holdfast.scratch import drop, written

K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK_ITEMS = 16
#: Words of items in one index, at most.
MAX_INDEX_WORDS = 500_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    text = text.strip()
    ends = [m.end() for m in re.finditer(r"\n+|(?<=[.!?])\s+", text)]
    ends = [e for e in ends if words_of(text[e:])]
    if not ends or not words_of(text[: ends[-1]]):
        return words_of(text), []
    return words_of(text[: ends[-1]]), words_of(text[ends[-1] :])


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


class Statistics:
    """What scores need of the whole benchmark: number of items, longest and mean length, document frequencies of the terms at hand."""

    def __init__(self, items: int, longest: int, mean: float, df: dict[str, int]):
        self.items, self.longest, self.mean, self.df = items, longest, mean, df

    @classmethod
    def of(cls, texts) -> Statistics:
        """Those of a few texts in memory."""
        bags = [words_of(t) for t in texts]
        sizes = [len(b) for b in bags if b]
        return cls(len(bags), max(sizes, default=0), sum(sizes) / max(1, len(sizes)) or 1.0, Counter(w for b in bags for w in set(b)))


class Index:
    """Block-max inverted index of items (id, text); ``whole`` has the statistics of the benchmark that they are a part of."""

    def __init__(self, items: list[tuple[int, str]], ratio: float, whole: Statistics | None = None):
        whole = whole or Statistics.of(t for _, t in items)
        items = sorted((i, t) for i, t in items)
        self.ids = [i for i, _ in items]
        self.parts = [tuple(map(shingles, split_item(t))) for _, t in items]
        bags = [Counter(words_of(t)) for _, t in items]
        sizes = [sum(b.values()) for b in bags]
        self.longest, mean = whole.longest, whole.mean
        df = {t: whole.df[t] for b in bags for t in b}
        idf = {t: math.log(1 + (whole.items - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        own = [0.0] * len(items)
        for n, bag in enumerate(bags):
            for t, tf in bag.items():
                s = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[n] / mean))
                self.postings[t].append((n, s))
                own[n] += s
        self.threshold = [ratio * s if s else math.inf for s in own]
        blocks = range(0, len(items), BLOCK_ITEMS)
        self.least = [min(self.threshold[b : b + BLOCK_ITEMS]) for b in blocks]
        self.numbers = {t: [n for n, _ in p] for t, p in self.postings.items()}
        self.block_max: dict[str, dict[int, float]] = {}
        for t, p in self.postings.items():
            most: dict[int, float] = {}
            for n, s in p:
                most[n // BLOCK_ITEMS] = max(most.get(n // BLOCK_ITEMS, 0.0), s)
            self.block_max[t] = most
        # For each item, its rarest terms, as many as leave the rest under its threshold: a passage without any of them can't reach it.
        self.needed: set[str] = set()
        for n, bag in enumerate(bags):
            rest = own[n]
            for t in sorted(bag, key=lambda t: (df[t], t)):
                if rest < self.threshold[n]:
                    break
                self.needed.add(t)
                rest -= next(s for m, s in self.postings[t] if m == n)

        # More of them, down to a quarter of the weight: what is left of the threshold must come from these.
        self.essential: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.lack = [math.inf] * len(items)
        self.weights: list[dict[str, float]] = []
        for n, bag in enumerate(bags):
            rest, weight = own[n], {t: next(s for m, s in self.postings[t] if m == n) for t in bag}
            for t in sorted(bag, key=lambda t: (df[t], t)):
                if rest <= 0.25 * own[n]:
                    break
                self.essential[t].append((n, weight[t]))
                rest -= weight[t]
            self.weights.append(weight)
            self.lack[n] = self.threshold[n] - rest - 1e-9

    def hopeful(self, terms: set[str]) -> bool:
        """Whether some item could reach its threshold, by its essential terms alone; if not, the walk finds nothing."""
        got: dict[int, float] = {}
        for t in terms & self.essential.keys():
            for n, s in self.essential[t]:
                got[n] = x = got.get(n, 0.0) + s
                if x >= self.lack[n]:
                    return True
        return False

    def whole(self, terms: set[str]) -> list[int]:
        """Numbers of all items whose score reaches their threshold, as retrieve() gives them: for the many terms of a long document."""
        got: dict[int, float] = {}
        for t in terms & self.essential.keys():
            for n, s in self.essential[t]:
                got[n] = got.get(n, 0.0) + s
        likely = [n for n, x in got.items() if x >= self.lack[n]]
        return [n for n in likely if sum(s for t, s in self.weights[n].items() if t in terms) >= self.threshold[n] - 1e-9]

    def retrieve(self, terms: set[str]) -> list[int]:
        """Numbers of all items whose score reaches their threshold, by block-max WAND."""
        cursors = [[self.numbers[t][0], 0, t] for t in terms if t in self.numbers]
        found = []
        while cursors:
            cursors.sort()
            # The pivot is the first item at which the block maxima so far can reach the threshold of its block.
            block = cursors[0][0] // BLOCK_ITEMS
            last = (block + 1) * BLOCK_ITEMS
            total, pivot = 0.0, None
            for n, _, t in cursors:
                if n >= last:
                    break
                total += self.block_max[t][block]
                if total >= self.least[block]:
                    pivot = n
                    break
            to = last if pivot is None else pivot
            if pivot is not None and cursors[0][0] == pivot:
                score = sum(self.postings[t][i][1] for n, i, t in cursors if n == pivot)
                if score >= self.threshold[pivot]:
                    found.append(pivot)
                to = pivot + 1
            moved = []
            for c in cursors:
                if c[0] < to:
                    row = self.numbers[c[2]]
                    i = bisect_left(row, to, c[1])
                    if i == len(row):
                        continue
                    c = [row[i], i, c[2]]
                moved.append(c)
            cursors = moved
        return found

    def overlap(self, number: int, held: set[tuple[str, ...]], by_length: dict[int, set]) -> tuple[float, bool]:
        """Share of the item's shingles that a document holds; whether it holds some of each part."""
        sizes = hits = 0
        each = True
        for part in self.parts[number]:
            here = sum((s in held) if len(s) == SHINGLE else (s in by_length[len(s)]) for s in part)
            sizes += len(part)
            hits += here
            each = each and (here > 0 or not part)
        return hits / max(1, sizes), each


class _Lengths(dict):
    """Word sequences of a document by their length, made when asked for."""

    def __init__(self, words):
        super().__init__()
        self.words = words

    def __missing__(self, n):
        value = self[n] = {tuple(self.words[i : i + n]) for i in range(len(self.words) - n + 1)}
        return value


class Searcher:
    """Finds an index's verified items in documents; one per task."""

    def __init__(self, index: Index, overlap: float):
        self.index, self.least = index, overlap
        self.normal = Cache(lambda w: tuple(words_of(w)))
        self.single = Cache(lambda w: index.needed.isdisjoint(words_of(w)))

    def trim(self) -> None:
        self.normal.trim()
        self.single.trim()

    def find(self, text: str) -> list[tuple[int, float]]:
        """(item id, overlap) of each item verified in a document."""
        index, out = self.index, []
        half, needed = max(1, index.longest), index.needed
        raw = text.split()
        if all(map(self.single.__getitem__, raw)):
            return out
        words = [x for w in raw for x in self.normal[w]]
        held = lengths = None
        terms = set(words)
        if needed.isdisjoint(terms):
            return out
        # A document of one passage is queried by it. A longer one by all its terms at once: whatever one of its passages
        # finds is among that, and also an item whose parts lie more than a passage apart.
        if len(words) <= 2 * half:
            numbers = index.retrieve(terms) if index.hopeful(terms) else ()
        else:
            numbers = index.whole(terms)
        for n in numbers:
            if held is None:
                held, lengths = shingles(words), _Lengths(words)
            share, each = index.overlap(n, held, lengths)
            if each and share >= self.least:
                out.append((index.ids[n], share))
        return out


def _search(sent, overlap: float):
    """``sent``: the broadcast index."""

    def run(batches):
        searcher = Searcher(sent.value, overlap)
        for batch in text_slices(batches):
            ids, items, scores = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), texts(batch), strict=True):
                for item, share in searcher.find(text):
                    ids.append(doc)
                    items.append(item)
                    scores.append(share)
            searcher.trim()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "item_id": pa.array(items, pa.int64()), "overlap": pa.array(scores, pa.float64())})

    return run


def _without(sent, overlap: float):
    """Rows in which nothing is found."""

    def run(batches):
        searcher = Searcher(sent.value, overlap)
        for batch in text_slices(batches):
            clean = [not searcher.find(text) for text in texts(batch)]
            searcher.trim()
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")


def _bags(batches):
    for batch in text_slices(batches):
        words = [words_of(t) for t in texts(batch)]
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(w) for w in words], pa.int64()), "terms": pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))})


def _indexes(benchmark: DataFrame, ratio: float, max_index_words: int):
    """Broadcast indexes of the benchmark's parts, one after the other; the driver holds one part at a time."""
    spark, items = benchmark.sparkSession, _items(benchmark)
    bags = written(items.mapInArrow(_bags, "n long, terms array<string>"), "decon-bags")
    sizes = bags.agg(F.count("*").alias("items"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"), F.count_if(F.col("n") > 0).alias("filled"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    frequencies = written(bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "decon-terms")

    def index(part: list[tuple[int, str]]):
        own = sorted({w for _, t in part for w in words_of(t)})
        # At most max_index_words terms, or those of one longer item.
        wanted = spark.createDataFrame([(w,) for w in own], "term string")
        df = {r.term: r.n for r in frequencies.join(F.broadcast(wanted), "term").collect()}
        return spark.sparkContext.broadcast(Index(part, ratio, Statistics(sizes.items, sizes.longest, sizes.total / max(1, sizes.filled) or 1.0, df)))

    part, words = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(r.text))
        if part and words + n > max_index_words:
            yield index(part)
            part, words = [], 0
        part.append((r.item_id, r.text))
        words += n
    yield index(part)
    drop(bags, frequencies)


def _in_turn(benchmark: DataFrame, ratio: float, max_index_words: int, step):
    """``step(index)`` for each part. With several parts each one's result is written, and its index let go, before the next."""
    words = _items(benchmark).mapInArrow(_bags, "n long, terms array<string>").agg(F.sum("n")).first()[0] or 0
    for sent in _indexes(benchmark, ratio, max_index_words):
        if words <= max_index_words:
            yield step(sent)
        else:
            yield written(step(sent), "decon-part")
            sent.unpersist(blocking=True)


def contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.6, overlap: float = 0.8, max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """(doc_id, item_id, overlap): every document with every test item verified in it."""
    docs, found = doc_columns(docs), None
    for hits in _in_turn(benchmark, ratio, max_index_words, lambda sent: docs.mapInArrow(_search(sent, overlap), "doc_id long, item_id long, overlap double")):
        found = hits if found is None else found.unionByName(hits)
    return found


def clean_rows(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.6, overlap: float = 0.8, max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """Rows of ``docs`` in whose own text no test item is verified."""
    small_batches(docs.sparkSession)
    left = docs
    for rest in _in_turn(benchmark, ratio, max_index_words, lambda sent: left.mapInArrow(_without(sent, overlap), docs.schema)):
        before, left = left, rest
        if hasattr(before, "scratch_path") and before is not docs:
            drop(before)
    return left


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document id: n_items found, their ids, the largest overlap, and ``contaminated``."""
    hits = contaminated(docs, benchmark, **options).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("overlap").alias("max_overlap")).withColumnRenamed("doc_id", "hit_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = ids.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    return joined.select("doc_id", F.coalesce(F.array_size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("max_overlap", F.lit(0.0)).alias("max_overlap"), F.col("item_ids").isNotNull().alias("contaminated"))
