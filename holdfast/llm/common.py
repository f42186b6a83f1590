"""What the text operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python function handles at once; longer documents form a slice of their own.
SLICE_CHARS = 4_000_000
#: Cached words of a task, about 150 bytes each.
CACHE_WORDS = 200_000


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to slices of bounded text, so that memory does not follow the batch size."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > SLICE_CHARS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < len(sizes):
            yield batch.slice(start)


def map_text(docs: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``function`` to bounded slices of ``docs``."""

    def run(batches):
        for batch in text_slices(batches):
            yield function(batch)

    return docs.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch["text"].to_pylist()]


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    """UTF-8 bytes: their split() is by ASCII white space alone, their lower() is by A-Z alone."""
    return [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


#: Bytes of an Arrow batch, about; what a task holds beside the heap follows them.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, unless they are smaller already."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Cache(dict):
    """Word to value, computed on first sight. Between uses trim() holds it to ``most`` words in two generations, so what is met often stays."""

    def __init__(self, make, most: int = CACHE_WORDS):
        super().__init__()
        self.make = make
        self.most = most
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self):
        if len(self) > self.most // 2:
            self.old = dict(self)
            self.clear()
