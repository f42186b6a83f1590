"""Sources: header CSV with encoding fallback, file inventories, JSON and partitioned results, archive listings."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from holdfast.functions.rules import clean, require_columns

#: Suffixes of images in folders, of volumes, and of images and tables in archives.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png")
VOLUMES = (".dcm", ".nii", ".nii.gz", ".img", ".hdr", ".mgz")
ARCHIVED_IMAGES = (".dcm", ".nii", ".gz", ".img", ".hdr", ".mgz", ".mnc")
TABLES = (".csv", ".xlsx", ".xls", ".txt", ".tsv", ".json", ".xml")


def read_csv(spark: SparkSession, path: str, needed: set[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns strings; a missing required column raises."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return require_columns(df, needed) if needed else df


def read_csv_safely(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8, or Latin-1 where the bytes are not UTF-8; names and values normalised."""
    bad = spark.read.format("binaryFile").load(path).where(F.try_validate_utf8("content").isNull() & (F.length("content") > 0))
    return clean(read_csv(spark, path, encoding="UTF-8" if bad.isEmpty() else "ISO-8859-1"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size of all files below, without their contents. ``root`` may be a glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def list_images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """path, class (the folder that a file lies in), bytes of the files with one of the suffixes, in any case; sorted by path."""
    fits = reduce(lambda a, b: a | b, [F.lower(_name()).endswith(s) for s in suffixes])
    return list_files(spark, root).where(fits).select("path", F.element_at(F.split("path", "/"), -2).alias("class"), "bytes").orderBy("path")


def inventory(spark: SparkSession, root: str, max_hash_mb: float = 512) -> DataFrame:
    """relative_path, suffix, bytes, megabytes, sha256 of all files, sorted by path.

    Files above ``max_hash_mb``, or above the 2 GiB that a row can hold, are marked ``skipped_large_file``; their contents
    are never read, as the limit on the length goes to the file source. A name without a suffix has ``[none]``. Empty
    files, which the file source passes over, come from a listing on the driver that keeps nothing of other files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    limit = min(int(max_hash_mb * 2**20), 2**31 - 1)
    small = files.where(F.col("length") <= limit).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > limit).select("path", "length", F.lit("skipped_large_file").alias("sha256"))
    base, store = _Files(spark).path(root)
    top = store.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    empty, listing = [], store.listFiles(base, True)
    while listing.hasNext():
        entry = listing.next()
        if entry.getLen() == 0:
            empty.append((entry.getPath().toString(), 0, hashlib.sha256(b"").hexdigest()))
    small = small.unionByName(spark.createDataFrame(empty, "path string, length long, sha256 string"))
    suffix = F.lower(F.regexp_extract(_name(), r"^.+(\.[^.]+)$", 1))
    return (
        small.unionByName(large)
        .select(F.element_at(F.split("path", re.escape(top), 2), -1).alias("relative_path"), F.when(suffix == "", "[none]").otherwise(suffix).alias("suffix"), F.col("length").alias("bytes"), F.round(F.col("length") / 2**20, 3).alias("megabytes"), "sha256")
        .orderBy("relative_path")
    )


def find_table(spark: SparkSession, root: str, hints: list[str]) -> str | None:
    """First file, in path order, whose name holds a hint; earlier hints first."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    rank = F
    for i, h in enumerate(hints):
        rank = rank.when(name.contains(h.lower()), i)
    row = list_files(spark, root).withColumn("rank", rank.otherwise(F.lit(None))).where("rank is not null").orderBy("rank", "path").first()
    return row.path if row else None


def _image_size(content: bytes) -> tuple[int | None, int | None]:
    """Width and height from the header of a PNG or JPEG."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        kind, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if kind == 0xFF:  # filling
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + length
    return None, None


def image_sizes(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_EXTENSIONS, head: int = 1 << 16) -> DataFrame:
    """path, bytes, width, height of PNG and JPEG files; sizes are null where the file is neither. Only each file's head goes to Python."""
    fits = reduce(lambda a, b: a | b, [F.lower(_name()).endswith(s) for s in suffixes])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(fits).select("path", F.col("length").alias("bytes"), F.substring("content", 1, head).alias("head"))

    def sizes(batches):
        for batch in batches:
            found = [_image_size(bytes(x)) for x in batch["head"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch["path"], "bytes": batch["bytes"], "width": pa.array([w for w, _ in found], pa.int32()), "height": pa.array([h for _, h in found], pa.int32())})

    return files.mapInArrow(sizes, "path string, bytes long, width int, height int")


def read_workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """Rows of an xlsx sheet as text columns named by its first row; rows whose first cell is blank are left out, absent cells are null.

    A workbook is read in one task: it is a zip of two small XML files.
    """
    content = spark.read.format("binaryFile").load(path).select("content")
    names = _header(content.first().content, sheet)

    def rows(batches):
        for batch in batches:
            for raw in batch["content"].to_pylist():
                cells = [dict(r) for r in list(_cells(raw, sheet))[1:]]
                kept = [r for r in cells if r.get(0)]
                yield pa.RecordBatch.from_pydict({n: pa.array([r.get(i) or None for r in kept], pa.string()) for i, n in enumerate(names)})

    return content.mapInArrow(rows, StructType([StructField(n, StringType()) for n in names]))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cells(raw: bytes, sheet: int):
    """Each row's cells as (column number, text)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_SHEET}row"):
            out = []
            for place, cell in enumerate(row.findall(f"{_SHEET}c")):
                letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                column = reduce(lambda n, c: n * 26 + ord(c) - 64, letters, 0) - 1 if letters else place
                value = cell.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                out.append((column, shared[int(text)] if cell.get("t") == "s" and text else text))
            yield out


def _header(raw: bytes, sheet: int) -> list[str]:
    first = dict(next(iter(_cells(raw, sheet)), []))
    return [first.get(i) or f"column_{i + 1}" for i in range(max(first, default=-1) + 1)]


def partitioned_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """CSV results below folders named seed{S}_overlap{P}; the first path of a (seed, overlap) counts."""
    df = spark.read.option("header", True).schema(schema).option("recursiveFileLookup", True).csv(root).withColumn("_path", F.col("_metadata.file_path"))
    df = df.withColumn("seed", F.regexp_extract("_path", r"seed(\d+)_overlap([0-9.]+)", 1).try_cast("int")).withColumn("overlap", F.round(F.regexp_extract("_path", r"seed(\d+)_overlap([0-9.]+?)(?:/|$)", 2).try_cast("double"), 2)).where("seed is not null")
    first = df.groupBy("seed", "overlap").agg(F.min("_path").alias("_path"))
    return df.join(first, ["seed", "overlap", "_path"], "left_semi").drop("_path")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file; files that do not parse are left out."""
    full = StructType([*StructType.fromDDL(schema).fields, StructField("_bad", StringType())])
    return spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").schema(full).json(path).where("_bad is null").drop("_bad")


def classify_archives(members: DataFrame) -> DataFrame:
    """(archive, member) listings to images / study_files / mixed, by all suffixes of the members; folders count as nothing, and both kinds or neither are mixed."""
    parts = F.slice(F.split(F.lower(F.element_at(F.split("member", "/"), -1)), r"\."), 2, 100)
    suffixes = F.when(F.col("member").endswith("/"), F.array().cast("array<string>")).otherwise(F.transform(parts, lambda x: F.concat(F.lit("."), x)))
    has = lambda kinds: F.bool_or(F.arrays_overlap(suffixes, F.array(*map(F.lit, kinds))))
    per = members.groupBy("archive").agg(has(ARCHIVED_IMAGES).alias("i"), has(TABLES).alias("t"))
    return per.select("archive", F.when(F.col("i") & ~F.col("t"), "images").when(F.col("t") & ~F.col("i"), "study_files").otherwise("mixed").alias("kind"))


def destination(kind: str, archive: str, images_root: str, tables_root: str) -> str:
    """Where an archive's files go: a folder of its name under the images or the study files."""
    stem = re.sub(r"(?<=.)\.[^.]*$", "", archive.rsplit("/", 1)[-1])
    return f"{(tables_root if kind == 'study_files' else images_root).rstrip('/')}/{stem}"


def safe_member(name: str) -> bool:
    """No absolute path and no way up."""
    return not re.match(r"^([/\\]|[A-Za-z]:)", name) and ".." not in re.split(r"[/\\]", name)


class _Files:
    """Files of any store that Spark reads, as streams on the driver; contents pass through it in pieces."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(name)
        return p, p.getFileSystem(self.conf)

    def open(self, name: str):
        p, fs = self.path(name)
        return fs.open(p)

    def exists(self, name: str) -> bool:
        p, fs = self.path(name)
        return fs.exists(p)

    def save(self, stream, name: str) -> None:
        """To a name beside it first, so that a broken copy is never taken for the file."""
        p, fs = self.path(name)
        part, _ = self.path(f"{name}.part")
        out = fs.create(part, True)
        try:
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
        finally:
            out.close()
        fs.delete(p, False)
        fs.rename(part, p)


def _zip_entries(files: _Files, archive: str):
    stream = files.jvm.java.util.zip.ZipInputStream(files.open(archive))
    try:
        while (entry := stream.getNextEntry()) is not None:
            yield entry, stream
    finally:
        stream.close()


def list_zip(spark: SparkSession, archive: str) -> list[str]:
    """Members of a zip, folders with a slash at the end."""
    return [e.getName() for e, _ in _zip_entries(_Files(spark), archive)]


def extract_zip(spark: SparkSession, archive: str, target: str, force: bool = False) -> tuple[int, int, bool]:
    """(extracted, skipped, already complete). Any member that would leave ``target`` is refused before anything is written; files that are there are skipped."""
    files, names = _Files(spark), [n for n in list_zip(spark, archive) if not n.endswith("/")]
    bad = [n for n in names if not safe_member(n)]
    if bad:
        raise ValueError(f"suspicious member {bad[0]!r} in {archive}")
    there = {n for n in names if files.exists(f"{target}/{n}")} if not force else set()
    if not force and len(there) == len(names):
        return 0, 0, True
    done = 0
    for entry, stream in _zip_entries(files, archive):
        if not entry.isDirectory() and entry.getName() not in there:
            files.save(stream, f"{target}/{entry.getName()}")
            done += 1
    return done, len(there), False


def extract_tar(spark: SparkSession, archive: str, wanted: dict[str, str], force: bool = False) -> tuple[set[str], list[str]]:
    """Members of ``wanted`` (name to destination) in one pass: (names found, destinations that none of them gave, sorted). Files that are there are kept."""
    files, found = _Files(spark), set()
    stream = files.jvm.org.apache.commons.compress.archivers.tar.TarArchiveInputStream(files.open(archive))
    try:
        while (entry := stream.getNextEntry()) is not None:
            to = wanted.get(entry.getName())
            if to is not None and not entry.isDirectory():
                found.add(entry.getName())
                if force or not files.exists(to):
                    files.save(stream, to)
    finally:
        stream.close()
    return found, sorted(set(wanted.values()) - {wanted[n] for n in found})
