"""Content-addressed store of token ids.

Layout under one folder, written by Spark's committers alone:

    chunks/    digest, ids   unique chunks: zstd-compressed little-endian ids of
                             ``id_bytes`` bytes, named by the SHA-256 (16 bytes)
                             of the uncompressed ids
    recipes/   doc_id, start, n_tokens, lengths, digests, root
               ``part`` is a range of ascending doc_id, and each part's rows stand
               in that order; ``start`` counts the ids of all documents before
    manifest/  part, n_docs, n_tokens, root: a Merkle root for each recipe file

A rolling hash over the last ``WINDOW`` ids cuts a document's id stream, so equal
passages give equal chunks wherever they stand. A document's root is the Merkle
root of its chunk digests, a part's root that of its documents' roots.

Reading back opens every chunk, checks it against its name, and rebuilds each
document's id count and CRC from its recipe; ``reconstruct`` gives the ids.

Defined cases: null text counts as empty, and an empty document is its end id;
null doc_ids come first; repeated rows are documents of their own, in the order
of their texts' digests; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Cache, doc_columns, text_slices, texts
from holdfast.llm.crc import combined
from holdfast.scratch import drop, new_path, written

#: Ids under the rolling hash; the shortest chunk; a cut falls on 1 of MEAN places beyond it; the longest chunk.
WINDOW, SHORTEST, MEAN, LONGEST = 16, 64, 512, 4096
DIGEST_BYTES = 16
#: Encoded words that a Python worker keeps from task to task, about 200 bytes each.
ENCODED_WORDS = 1_200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs hash upwards; an odd one goes up as it is. Leaf and inner hashes are told apart by their first byte."""
    level = [hashlib.sha256(b"\x00" + x).digest()[:DIGEST_BYTES] for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest()[:DIGEST_BYTES] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()[:DIGEST_BYTES]


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of one id stream."""
    n = len(ids)
    if n <= SHORTEST:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    run = np.cumsum(mixed * _MIX, dtype=np.uint64)
    rolled = run[WINDOW:] - run[:-WINDOW]
    rolled ^= rolled >> np.uint64(32)
    places = np.flatnonzero(rolled * _MIX >> np.uint64(40) < np.uint64((1 << 24) // MEAN)) + WINDOW + 1
    ends, start = [], 0
    for p in places.tolist():
        while p - start > LONGEST:
            start += LONGEST
            ends.append(start)
        if p - start >= SHORTEST and p < n:
            ends.append(p)
            start = p
    while n - start > LONGEST:
        start += LONGEST
        ends.append(start)
    return [*ends, n]


_BEYOND_LATIN = re.compile(r"[^\x00-\u024f]|\u0130")
_STOP = re.compile(r"[,.](?<=[a-zà-öø-ÿ][,.])(?=[ \n]|\Z)")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")


def _plain_latin(text: str) -> bool:
    """Whether no character is beyond the Latin blocks, and none can start a special token."""
    if "<|" in text:
        return False
    try:
        text.encode("latin-1")  # the usual case, and the quickest to see
    except UnicodeEncodeError:
        return not _BEYOND_LATIN.search(text)
    return True


def _byte_letters() -> dict[int, str]:
    """Lower-case Latin-1 letters as the byte-level alphabet spells their UTF-8 bytes: unprintable bytes stand from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    spelt = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class Encoder:
    """Text to id bytes, word by word where the tokenizer splits at white space anyway.

    ``split_words`` may be set for a tokenizer that lowers case, drops white space
    and parts letters from other signs, as its ids of a text are then those of the
    text's words in a row; each distinct word is encoded once. Otherwise whole
    texts are encoded.
    """

    def __init__(self, path: str, split_words: bool, encoded_words: int = ENCODED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_dtype(self.tokenizer.get_vocab_size())
        self.split_words = split_words
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        # Whether the model alone gives what the whole tokenizer gives for a word of letters.
        probe = ["a", "the", "zebra", "größe", "élèveñ", "çüøþÿ", "internationalisation", "xqzjvk"]
        self.direct = split_words and all(self.by_model(w) == self.whole(w) for w in probe)
        self.cache = Cache(self.word, encoded_words)

    def by_model(self, word: str) -> bytes:
        """A word of lower-case Latin letters is normal already and one piece, so the library's model is asked at once."""
        return array("H" if self.dtype == "<u2" else "I", [t.id for t in self.model.tokenize(word.translate(self.letters))]).tobytes()

    def word(self, word: str) -> bytes:
        return self.by_model(word) if self.direct and _LETTERS.fullmatch(word) else self.whole(word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.split_words:
            return self.whole(text)
        self.cache.trim()
        # The same words with fewer spellings: where no character is beyond Latin letters, lower case is the tokenizer's own,
        # and a comma or full stop between a letter and white space is a word of its own to it.
        if _plain_latin(text):
            text = _STOP.sub(r" \g<0>", text.lower())
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


def id_dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


_encoders: dict[tuple[str, bool, int], Encoder] = {}


def _encoder(path: str, split_words: bool, encoded_words: int) -> Encoder:
    key = (path, split_words, encoded_words)
    if key not in _encoders:
        _encoders.clear()  # a worker keeps one
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _staged(path: str, split_words: bool, end_id: int, encoded_words: int):
    """Documents to recipes, each with those chunks that this task has not yet given out."""

    def run(batches):
        encode, squeeze = _encoder(path, split_words, encoded_words), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], encode.dtype).tobytes()
        given: set[bytes] = set()
        for batch in text_slices(batches):
            out: dict[str, list] = {"n_tokens": [], "lengths": [], "digests": [], "new": [], "sha": []}
            for text in texts(batch):
                raw = encode(text) + end
                ids = np.frombuffer(raw, encode.dtype)
                width, start, digests, new, lengths = ids.itemsize, 0, [], [], []
                for e in chunk_ends(ids):
                    piece = raw[start * width : e * width]
                    digest = hashlib.sha256(piece).digest()[:DIGEST_BYTES]
                    digests.append(digest)
                    lengths.append(e - start)
                    if digest not in given:
                        given.add(digest)
                        new.append((digest, squeeze.compress(piece)))
                    start = e
                if len(given) > 200_000:  # forgetting them costs a repeat that the store drops
                    given.clear()
                for name, x in zip(out, (len(ids), lengths, digests, new, b"".join(digests)), strict=True):
                    out[name].append(x)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                    "lengths": pa.array(out["lengths"], pa.list_(pa.int32())),
                    "digests": pa.array(out["sha"], pa.binary()),
                    "new": pa.array([[{"digest": d, "ids": x} for d, x in row] for row in out["new"]], pa.list_(pa.struct([("digest", pa.binary()), ("ids", pa.binary())]))),
                }
            )

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, split_words: bool = False, encoded_words: int = ENCODED_WORDS) -> str:
    """Encode ``docs`` and write the store at ``path``, a folder that all executors reach."""
    spark = docs.sparkSession
    docs = doc_columns(docs)
    stage = written(docs.mapInArrow(_staged(tokenizer, split_words, end_id, encoded_words), "doc_id long, n_tokens long, lengths array<int>, digests binary, new array<struct<digest:binary,ids:binary>>"), "store-stage")
    stage.select(F.explode("new").alias("c")).select("c.digest", "c.ids").groupBy("digest").agg(F.first("ids").alias("ids")).write.option("compression", "uncompressed").parquet(f"{path}/chunks")

    # Ascending order: ranges of doc_id; a running sum inside each range, plus the sums of the ranges before.
    order = ["doc_id", "digests"]
    ranged = written(stage.select("doc_id", "n_tokens", "lengths", "digests").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "store-order")
    drop(stage)
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per range
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")

    def rooted(batches):
        for batch in batches:
            roots = [merkle_root([d[i : i + DIGEST_BYTES] for i in range(0, len(d), DIGEST_BYTES)]) for d in batch["digests"].to_pylist()]
            yield batch.append_column("root", pa.array(roots, pa.binary()))

    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    recipes = (
        ranged.withColumn("run", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(before), "part")  # as many rows as partitions
        .select("part", "doc_id", (F.col("before") + F.col("run")).alias("start"), "n_tokens", "lengths", "digests")
    )
    schema = "part int, doc_id long, start long, n_tokens long, lengths array<int>, digests binary, root binary"
    recipes.mapInArrow(rooted, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop(ranged)
    dtype = id_dtype(_encoder(tokenizer, split_words, encoded_words).tokenizer.get_vocab_size())
    _part_roots(read_recipes(spark, path)).withColumn("id_bytes", F.lit(int(dtype[-1]))).write.parquet(f"{path}/manifest")
    return path


def _part_roots(recipes: DataFrame) -> DataFrame:
    """Per recipe part: counts and the Merkle root. A part's documents are read in order and come as they are written."""

    def roots(key, pdf):
        pdf = pdf.sort_values("start", kind="stable")
        import pandas as pd

        return pd.DataFrame({"part": [key[0]], "n_docs": [len(pdf)], "n_tokens": [int(pdf["n_tokens"].sum())], "root": [merkle_root(pdf["root"].tolist())]})

    return recipes.select("part", "start", "n_tokens", "root").groupBy("part").applyInPandas(roots, "part int, n_docs long, n_tokens long, root binary")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, start long, n_tokens long, lengths array<int>, digests binary, root binary").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, ids binary").parquet(f"{path}/chunks")


def id_bytes(spark: SparkSession, path: str) -> int:
    row = spark.read.schema("id_bytes int").parquet(f"{path}/manifest").first()
    return row.id_bytes if row else 4


def _exploded(recipes: DataFrame) -> DataFrame:
    """(doc key, position, digest) of every chunk of every document."""
    return recipes.select("part", "start", F.posexplode("lengths").alias("i", "n"), "digests").select(
        "part", "start", "i", "n", F.substring(F.col("digests"), F.col("i") * DIGEST_BYTES + 1, F.lit(DIGEST_BYTES)).alias("digest")
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32 (as unsigned 32-bit ids).

    Every chunk is opened, checked and summed where it lies; the sums, not the
    ids, meet the recipes. A chunk that fails its name, or a missing one, raises.
    """
    width = id_bytes(spark, path)

    def opened(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            crcs, sizes = [], []
            for digest, packed in zip(batch["digest"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                raw = expand.decompress(packed)
                if hashlib.sha256(raw).digest()[:DIGEST_BYTES] != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                crcs.append(zlib.crc32(ids.tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_pydict({"digest": batch["digest"], "crc": pa.array(crcs, pa.int64()), "found": pa.array(sizes, pa.int64())})

    sums = read_chunks(spark, path).mapInArrow(opened, "digest binary, crc long, found long")
    recipes = read_recipes(spark, path)
    parts = _exploded(recipes).join(sums, "digest", "left")
    joined = parts.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("i", "n", "found", "crc"))).alias("chunks"))

    def folded(batches):
        for batch in batches:
            counts, crcs = [], []
            for doc, root, digests, chunks in zip(batch["doc_id"].to_pylist(), batch["root"].to_pylist(), batch["digests"].to_pylist(), batch["chunks"].to_pylist(), strict=True):
                if any(c["found"] != c["n"] for c in chunks) or merkle_root([digests[i : i + DIGEST_BYTES] for i in range(0, len(digests), DIGEST_BYTES)]) != root:
                    raise ValueError(f"document {doc} can't be rebuilt")
                crc = chunks[0]["crc"]
                for c in chunks[1:]:
                    crc = combined(crc, c["crc"], 4 * c["n"])
                counts.append(sum(c["n"] for c in chunks))
                crcs.append(crc)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "start": batch["start"], "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return recipes.select("doc_id", "start", "digests", "root").join(joined, "start").mapInArrow(folded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start and its ids as an array."""
    width = id_bytes(spark, path)

    def expanded(batches):
        for batch in batches:
            rows = [np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(c["ids"]) for c in chunks), f"<u{width}").astype(np.int64) for chunks in batch["chunks"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "start": batch["start"], "ids": pa.array(rows, pa.list_(pa.int64()))})

    recipes = read_recipes(spark, path)
    chunks = _exploded(recipes).join(read_chunks(spark, path), "digest").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("chunks"))
    return recipes.select("doc_id", "start").join(chunks, "start").mapInArrow(expanded, "doc_id long, start long, ids array<bigint>")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose recipes do not match the manifest (none, if all is well)."""
    told = spark.read.schema("part int, n_docs long, n_tokens long, root binary").parquet(f"{path}/manifest")
    found = _part_roots(read_recipes(spark, path)).withColumnsRenamed({"n_docs": "docs_found", "n_tokens": "tokens_found", "root": "root_found"})
    return told.join(found, "part", "full").where(~(F.col("n_docs").eqNullSafe(F.col("docs_found")) & F.col("n_tokens").eqNullSafe(F.col("tokens_found")) & F.col("root").eqNullSafe(F.col("root_found"))))


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 1, split_words: bool = False, path: str | None = None, encoded_words: int = ENCODED_WORDS) -> DataFrame:
    """Write the store and give what reading it back gives, one row per document."""
    spark = docs.sparkSession
    return read_digests(spark, write_store(docs, path or new_path(spark, "token-store"), tokenizer, end_id, split_words, encoded_words))
