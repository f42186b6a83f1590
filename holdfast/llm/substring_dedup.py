"""Removal of repeated passages by recompression.

Words are symbols, named by a 64-bit hash. In each round every name has a coin,
a bit of its own hash; a symbol with coin 0 before one with coin 1 forms a pair,
which gets one name, a hash of the two. So a name is global: equal word sequences
have equal names in every document, without an exchange. (Equal neighbours have
equal coins and never pair; a window inside such a run is named as a whole.)
Whether a symbol pairs depends on it and one neighbour, so each symbol's span of
influence is known, and a symbol whose span of influence lies in a window is the
same in every copy of that window. The key of a window is its longest such
symbol, the smallest name among equals; equal windows have equal keys.

Round 1 shuffles each document's keys (one for about four words), and finds
those in more than one document. Round 2 shuffles the 96-bit hashes of the
windows that have such keys, and finds for each the smallest document. What a
window's hash says is exact but for collisions of 96 bits; the last step looks up 64 of
them in a document's own list of repeated windows. Documents
with the word sequence of a smaller one, all of whose windows repeat, take no part
in round 2.

Before either shuffle a task keeps one entry for each key of its documents and
tells the others by itself, so a passage of a third of the corpus costs one entry a
task slice, not one a document. Keys fall into buckets of a bounded size.

Defined cases: null text has no words; a document shorter than the window keeps
all; rows with null id keep all, and no other document's words go for theirs;
repeated rows of one id are judged alike and never against each other; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Cache, doc_columns, raw_texts, text_slices
from holdfast.scratch import drop, release, written

ROUNDS, LEAST_ROUND = 5, 2
#: Words of text whose entries share a bucket, about.
BUCKET_WORDS = 2_000_000
#: Ids that a map-side filter holds at most; beyond that it is a join.
IDS_IN_MEMORY = 500_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_name(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Words:
    """Names of the words of several documents in a row."""

    def __init__(self, raws: list[bytes], cache: Cache):
        split = [r.split() for r in raws]  # bytes: ASCII white space alone
        self.words = split
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.names = np.concatenate([np.fromiter(map(cache.__getitem__, s), np.uint64, len(s)) for s in split] or [np.zeros(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(split)), self.sizes)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        cache.trim()

    def windows(self, w: int) -> np.ndarray:
        """Places at which a window of one document starts."""
        if len(self.doc) < w:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - w + 1] == self.doc[w - 1 :])

    def hashes(self, at: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 further bits for the windows at these places."""
        a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for i in range(w):
            x = self.names[at + i]
            a = _mixed(a + x)
            b = (b ^ x) * _M1
            b ^= b >> np.uint64(33)
        return a, (b >> np.uint64(32)).astype(np.uint32)


def window_keys(words: Words, w: int) -> np.ndarray:
    """For every place, the key of the window that starts there (of use at ``words.windows(w)`` alone)."""
    n = len(words.names)
    best = np.full(n, _NONE)
    far = np.int64(1 << 40)
    name, doc = words.names, words.doc
    low = np.arange(n, dtype=np.int64)  # span of influence
    high = low + 1
    start = low.copy()
    end = high.copy()
    for r in range(1, ROUNDS + 1):
        if len(name) < 2:
            break
        coin = (_mixed(name + np.uint64(r)) >> np.uint64(17)) & np.uint64(1)
        together = doc[:-1] == doc[1:]
        pairs = np.zeros(len(name), bool)
        pairs[:-1] = (coin[:-1] == 0) & (coin[1:] == 1) & together
        seconds = np.zeros(len(name), bool)
        seconds[1:] = pairs[:-1]
        right_high = np.full(len(name), far)
        right_high[:-1] = np.where(together, high[1:], far)
        left_low = np.full(len(name), -far)
        left_low[1:] = np.where(together, low[:-1], -far)
        new_low, new_high = low.copy(), np.where(coin == 0, np.maximum(high, right_high), high)
        alone = (coin == 1) & ~seconds
        new_low[alone] = np.minimum(low[alone], left_low[alone])
        at = np.flatnonzero(pairs)
        new_low[at] = np.minimum(low[at], low[at + 1])
        new_high[at] = np.maximum(high[at], high[at + 1])
        new_name, new_end = name.copy(), end.copy()
        new_name[at] = _mixed(_mixed(name[at] * np.uint64(3) + np.uint64(r)) + name[at + 1])
        new_end[at] = end[at + 1]
        if r >= LEAST_ROUND:
            short = at[new_high[at] - new_low[at] <= w]
            span = np.minimum(new_end[short] - start[short], 14).astype(np.uint64)
            key = ((np.uint64(15) - span) << np.uint64(60)) | (new_name[short] >> np.uint64(4))
            for o in range(w - 1):
                p = new_high[short] - w + o
                fits = (p <= new_low[short]) & (p >= 0)
                if not fits.any():
                    break
                np.minimum.at(best, p[fits], key[fits])
        stay = ~seconds
        name, doc, low, high, start, end = new_name[stay], doc[stay], new_low[stay], new_high[stay], start[stay], new_end[stay]
    bare = words.windows(w)
    bare = bare[best[bare] == _NONE]
    best[bare] = words.hashes(bare, w)[0] | (np.uint64(15) << np.uint64(60))
    return best


_BLOBS = "bucket int, told boolean, a binary, b binary, c binary"


def _blobs(a: np.ndarray, b: np.ndarray, c: np.ndarray, buckets: int, told: bool) -> list[tuple]:
    """Entries cut by bucket: a the key, b further bits, c the document id."""
    bucket = (_mixed(a) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[i[0]]), told, a[i].tobytes(), b[i].tobytes(), c[i].tobytes()) for i in np.split(order, cuts) if len(i)]


def _blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("bucket", "told", "a", "b", "c"), kinds, strict=True))})


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows, sorted by the first column, then the next."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    if not len(order):
        return columns
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[new] for c in columns)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Number of the group of equal rows, for sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), np.int64)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.cumsum(new)


def _no_nulls(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(batch["doc_id"].is_valid()) if batch["doc_id"].null_count else batch


def _keys(w: int, buckets: int):
    def run(batches):
        cache = Cache(word_name)
        for batch in text_slices(batches):
            batch = _no_nulls(batch)
            words = Words(raw_texts(batch), cache)
            at = words.windows(w)
            if not len(at):
                continue
            key = window_keys(words, w)[at]
            doc = batch["doc_id"].to_numpy()[words.doc[at]]
            turn = np.ones(len(at), bool)
            turn[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = _distinct(key[turn], doc[turn])
            group = _groups(key)
            many = np.bincount(group)[group] > 1
            first = np.ones(len(group), bool)
            first[1:] = group[1:] != group[:-1]
            # One entry a key; a key of several documents here is known as shared for all of them.
            none = np.zeros(0, np.uint8)
            rows = _blobs(key[first], many[first].astype(np.uint8), doc[first], buckets, False)
            rows += [(x[0], True, x[2], none.tobytes(), x[4]) for x in _blobs(key[many], many[many].astype(np.uint8), doc[many], buckets, True)]
            yield _blob_batch(rows)

    return run


def _by_slot(doc: np.ndarray, key: np.ndarray, slots: int) -> pd.DataFrame:
    """Entries cut by a hash of the document: a row for each slot, not for each document."""
    doc, key = _distinct(doc, key)
    slot = (_mixed(doc.view(np.uint64)) % np.uint64(slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    parts = [i for i in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(i)]
    return pd.DataFrame({"slot": np.array([slot[i[0]] for i in parts], np.int32), "docs": [doc[i].tobytes() for i in parts], "keys": [key[i].tobytes() for i in parts]})


_SLOTS = "slot int, docs binary, keys binary"


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    """A slot's documents with their keys."""
    doc, key = _distinct(_joined(pdf, "docs", np.int64), _joined(pdf, "keys", np.uint64))
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return pd.DataFrame({"doc_id": doc[np.concatenate([[0], cuts])], "keys": [k.tobytes() for k in np.split(key, cuts)]})


def _joined(pdf: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[column]), kind)


def _shared(pdf: pd.DataFrame, slots: int) -> pd.DataFrame:
    """Keys of more than one document in a bucket, by document."""
    told, asked = pdf[pdf["told"]], pdf[~pdf["told"]]
    key, many, doc = _joined(asked, "a", np.uint64), _joined(asked, "b", np.uint8), _joined(asked, "c", np.int64)
    order = np.lexsort((doc, key))
    key, many, doc = key[order], many[order], doc[order]
    group = _groups(key)
    lowest = doc[np.searchsorted(group, group)] if len(group) else doc
    differs = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    np.logical_or.at(differs, group, (doc != lowest) | (many > 0))
    keep = differs[group] & (many == 0) if len(group) else np.zeros(0, bool)
    return _by_slot(np.concatenate([_joined(told, "c", np.int64), doc[keep]]), np.concatenate([_joined(told, "a", np.uint64), key[keep]]), slots)


def _windows(w: int, buckets: int):
    def run(batches):
        cache = Cache(word_name)
        for batch in text_slices(batches):
            words = Words(raw_texts(batch), cache)
            at = words.windows(w)
            if not len(at):
                continue
            key = window_keys(words, w)
            shared = [np.isin(key[s : max(s, e - w + 1)], np.frombuffer(k, np.uint64)) for s, e, k in zip(words.first[:-1], words.first[1:], batch["keys"].to_pylist(), strict=True)]
            places = np.concatenate([np.flatnonzero(m) + s for m, s in zip(shared, words.first[:-1], strict=True)]).astype(np.int64)
            h, g = words.hashes(places, w)
            h, g, doc = _distinct(h, g, batch["doc_id"].to_numpy()[words.doc[places]])
            group = _groups(h, g)
            first = np.ones(len(group), bool)
            first[1:] = group[1:] != group[:-1]
            rows = _blobs(h[first], g[first], doc[first], buckets, False)
            rows += _blobs(h[~first], g[~first], doc[~first], buckets, True)  # a smaller document here has them
            yield _blob_batch(rows)

    return run


def _repeated(pdf: pd.DataFrame, slots: int) -> pd.DataFrame:
    """Window hashes that a smaller document has, by document."""
    told, asked = pdf[pdf["told"]], pdf[~pdf["told"]]
    h, g, doc = _distinct(_joined(asked, "a", np.uint64), _joined(asked, "b", np.uint32), _joined(asked, "c", np.int64))
    group = _groups(h, g)
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    return _by_slot(np.concatenate([_joined(told, "c", np.int64), doc[later]]), np.concatenate([_joined(told, "a", np.uint64), h[later]]), slots)


def _kept_words(w: int):
    def run(batches):
        cache = Cache(word_name)
        for batch in text_slices(batches):
            words = Words(raw_texts(batch), cache)
            counts, gone, digests, kept_texts = [], [], [], []
            for i, keys in enumerate(batch["keys"].to_pylist()):
                s, e = int(words.first[i]), int(words.first[i + 1])
                covered = np.zeros(e - s + 1, np.int64)
                if keys is None:  # a copy
                    covered[0] = e - s >= w
                elif e - s >= w:
                    hit = np.flatnonzero(np.isin(words.hashes(np.arange(s, e - w + 1), w)[0], np.frombuffer(keys, np.uint64)))
                    np.add.at(covered, hit, 1)
                    np.add.at(covered, hit + w, -1)
                stay = np.cumsum(covered)[:-1] == 0
                kept = b" ".join([x for x, k in zip(words.words[i], stay.tolist(), strict=True) if k])
                counts.append(e - s)
                gone.append(int((~stay).sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept_texts, pa.string())})

    return run


def _described(batches):
    for batch in text_slices(batches):
        split = [r.split() for r in raw_texts(batch)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_words": pa.array([len(s) for s in split], pa.int64()), "digest": pa.array([hashlib.sha256(b" ".join(s)).hexdigest() for s in split], pa.string())})


def _having(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents with their key lists: where few have any, the others go before the join."""
    ids = keys.select("doc_id")
    if ids.limit(IDS_IN_MEMORY + 1).count() <= IDS_IN_MEMORY:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(keys, "doc_id")


def repeats(docs: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(described, copies, keys): every row's size and digest; ids whose word sequence a smaller id has; window hashes to remove by document."""
    spark = docs.sparkSession
    described = written(docs.mapInArrow(_described, "doc_id long, n_words long, digest string"), "repeat-docs")
    total = described.agg(F.sum("n_words").alias("n")).first().n or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_WORDS))
    long = described.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = long.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = written(long.join(first, "digest").where("doc_id > first").select("doc_id").distinct(), "repeat-copies")
    # An id with rows of several texts is no mere copy if one of its texts is not.
    mixed = long.groupBy("doc_id").agg(F.countDistinct("digest").alias("n")).where("n > 1").select("doc_id")
    pure = written(copies.join(mixed, "doc_id", "left_anti"), "repeat-pure")
    drop(copies)
    slots = -(-buckets // 2)

    def met(entries: DataFrame, function) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return function(pdf, slots)

        return entries.groupBy("bucket").applyInPandas(run, _SLOTS).groupBy("slot").applyInPandas(_gathered, "doc_id long, keys binary")

    shared = met(docs.mapInArrow(_keys(window, buckets), _BLOBS), _shared)
    candidates = written(shared.join(pure, "doc_id", "left_anti"), "repeat-keys")
    release(spark)
    keys = written(met(_having(docs, candidates).mapInArrow(_windows(window, buckets), _BLOBS), _repeated), "repeat-windows")
    drop(candidates)
    release(spark)
    return described, pure, keys


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and ``kept_text``, words joined by one space)."""
    docs = doc_columns(docs)
    described, copies, keys = repeats(docs, window)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    touched = _having(docs, keys).mapInArrow(_kept_words(window), schema)
    brief = F.col("n_words") < window
    if with_text:
        copied = docs.join(copies, "doc_id", "left_semi").withColumn("keys", F.lit(None).cast("binary"))
        others = docs.join(keys.select("doc_id").unionByName(copies), "doc_id", "left_anti").withColumn("keys", F.lit(b""))
        return touched.unionByName(others.unionByName(copied).mapInArrow(_kept_words(window), schema))
    copied = described.join(copies, "doc_id", "left_semi")
    others = described.join(keys.select("doc_id").unionByName(copies), "doc_id", "left_anti")
    gone = copied.where(~brief).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    same = others.unionByName(copied.where(brief)).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"))
    return touched.select(*columns).unionByName(gone).unionByName(same)
