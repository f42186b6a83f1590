"""Scalar rules as Column expressions: picking, recoding, ids, dates, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The diagnosis code map, and the text forms that a label may have with what they stand for.
DIAGNOSIS_CODES = {"1": "CN", "2": "MCI", "3": "AD", "4": "MCI", "5": "AD", "6": "AD", "7": "CN", "8": "MCI", "9": "MCI"}
DIAGNOSIS_TEXT = {"CN": "CN", "MCI": "MCI", "AD": "AD", "LMCI": "MCI", "EMCI": "MCI", "SMC": "MCI"}
#: How sex is written, and id patterns of paths and sessions.
SEX = {"1": "M", "2": "F", "M": "M", "F": "F", "Male": "M", "Female": "F"}
SUBJECT_ID = r"\b\d{3}_S_\d{4}\b"
IMAGE_ID = r"\bI\d+\b"
SERIES_ID = r"(?<![A-Za-z])S\d{4,}\b"
SLICE_SERIES_ID = r"_S(\d{4,})_"
ACQUISITION = r"/(MPR-?R?|MT1|GradWarp[^/]*|N3m?[^/]*)__"
ACQUIRED = r"\b(\d{4}-\d{2}-\d{2})(?:_\d{2}_\d{2}_\d{2})?\b"
SESSION = r"^(OAS1_\d{4})_MR\d+$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def pick(df: DataFrame, *names: str) -> Column:
    """First present, non-blank column of the candidates that the table has."""
    have = [blank_to_null(F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def recode(c: Column, mapping: dict[str, str]) -> Column:
    out = F
    for k, v in mapping.items():
        out = out.when(c == k, v)
    return out.otherwise(F.lit(None))


def diagnosis(df: DataFrame) -> Column:
    """Ordered label rule: struct(label, source, confidence); coded columns first, then the three flags.

    Codes are taken as they are written, text in any case. Anything else falls through to the next column; a row that
    no column settles is unknown, with empty source. Columns that the table lacks, nulls and blanks are passed over.
    """
    branches = []
    for name in ("diagnosis", "dxcurren", "dxchange", "dx_bl"):
        if name in df.columns:
            v = F.trim(F.col(name).cast("string"))
            branches.append((F.coalesce(recode(v, DIAGNOSIS_CODES), recode(F.upper(v), DIAGNOSIS_TEXT)), name))
    for name, label in (("dxad", "AD"), ("dxmci", "MCI"), ("dxnorm", "CN")):
        if name in df.columns:
            branches.append((F.when(F.trim(F.col(name).cast("string")) == "1", label), name))
    out = None
    for label, source in branches:
        hit = F.struct(label.alias("label"), F.lit(source.upper()).alias("source"), F.lit("clinical_table").alias("confidence"))
        out = F.when(label.isNotNull(), hit) if out is None else out.when(label.isNotNull(), hit)
    missing = F.struct(F.lit("unknown").alias("label"), F.lit("").alias("source"), F.lit("missing").alias("confidence"))
    return missing if out is None else out.otherwise(missing)


def label_from_rating(c: Column) -> Column:
    """Clinical rating to label; null and N/A are missing, a negative one raises."""
    number = F.when(F.upper(c.cast("string")) != "N/A", c.cast("string")).cast("double")
    return F.when(number.isNull(), "label_missing").when(number == 0, "NonDemented").when(number > 0, "Demented").otherwise(F.raise_error(F.lit("negative rating")))


def binary_label(c: Column, negative: set[str], positive: set[str]) -> Column:
    """Several classes to two; others and null are Unknown."""
    return F.when(c.isin(*sorted(negative)), "NonDemented").when(c.isin(*sorted(positive)), "Demented").otherwise("Unknown")


def age_sex(df: DataFrame, acquired: Column) -> Column:
    """struct(age, sex) as text: the table's age, else the year of the scan less that of birth; unknown spellings of sex stay as they are, absent values are empty."""
    raw = F.coalesce(pick(df, "ptgender", "sex"), F.lit(""))
    born = F.substring(pick(df, "ptdobyy"), 1, 4)
    computed = F.when(born.rlike("^[0-9]{4}$"), (F.year(acquired) - born.try_cast("int")).cast("string"))
    return F.struct(F.coalesce(pick(df, "age", "ptage"), computed, F.lit("")).alias("age"), F.coalesce(recode(raw, SEX), raw).alias("sex"))


def quality_flag(motion: Column, malfunction: Column, matched: Column) -> Column:
    """fail, pass, or unknown where no metadata row matched."""
    bad = F.coalesce(motion == "1", F.lit(False)) | F.coalesce(malfunction == "1", F.lit(False))
    return F.when(bad, "fail").when(F.coalesce(matched, F.lit(False)), "pass").otherwise("unknown")


def parse_filename(path: Column, label: Column) -> Column:
    """struct of what a file's name tells: a number in parentheses is a subject of its class; a name without one is a subject of its own."""
    stem = F.replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""), F.lit(" "))
    number = F.regexp_extract(stem, r"\((\d+)\)", 1)
    found = number != ""
    alone = F.concat(label, F.lit("_unique_"), stem, F.lit("_"), stable_token(path))
    return F.struct(
        F.when(found, F.concat(label, F.lit("_patient"), number)).otherwise(alone).alias("subject_id"),
        F.when(found, "high_filename_parentheses").otherwise("low_unparseable_unique").alias("subject_id_confidence"),
        F.when(found, "parsed_parentheses").otherwise("unparseable_unique").alias("subject_parse_status"),
        number.alias("patient_number"),
        F.regexp_extract(stem, r"^(\d+)", 1).alias("slice_number"),
    )


def path_ids(path: Column) -> Column:
    """struct(ptid, image_uid, series_uid, acq_date) found in a path; empty where there is none."""
    return F.struct(F.regexp_extract(path, SUBJECT_ID, 0).alias("ptid"), F.regexp_extract(path, IMAGE_ID, 0).alias("image_uid"), F.regexp_extract(path, SERIES_ID, 0).alias("series_uid"), F.regexp_extract(path, ACQUIRED, 1).alias("acq_date"))


def slice_path_ids(path: Column) -> Column:
    """The same for slices: the series id may stand between underscores, and the path tells the kind of acquisition."""
    series = F.regexp_extract(path, SLICE_SERIES_ID, 1)
    ids = path_ids(path)
    return F.struct(ids["ptid"].alias("ptid"), ids["image_uid"].alias("image_uid"), F.when(series != "", F.concat(F.lit("S"), series)).otherwise("").alias("series_uid"), ids["acq_date"].alias("acq_date"), F.regexp_extract(path, ACQUISITION, 1).alias("acquisition_type"))


def session_subject(session: Column, pattern: str = SESSION) -> Column:
    """The subject that a session id names; any other id, and null, raises."""
    found = F.coalesce(F.regexp_extract(session, pattern, 1), F.lit(""))
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("unsupported session id: "), F.coalesce(session, F.lit("null")))))


def is_reliability(session: Column, listed: Column) -> Column:
    """A second visit, or a session of the reliability list."""
    return F.coalesce(session.endswith("_MR2"), F.lit(False)) | F.coalesce(listed, F.lit(False))


def in_universe(label: str, universe: tuple[str, ...] = ("CN", "AD")):
    """Rows of the primary labels alone, as a transform."""
    return lambda df: df.where(F.col(label).isin(*universe))


def split_part(split: str, name: str):
    """Rows of one of the three splits; rows of any other value belong to none."""
    if name not in ("train", "val", "test"):
        raise ValueError(f"no split {name}")
    return lambda df: df.where(F.col(split) == name)


def slice_indexes(size: Column, offsets: tuple[int, ...] = (-20, -10, 0, 10, 20)) -> Column:
    """Slices around the middle of an axis as array of (offset, index); those outside it are dropped."""
    middle = F.floor(size / 2).cast("int")
    return F.filter(F.array(*[F.struct(F.lit(o).alias("offset"), (middle + o).alias("index")) for o in offsets]), lambda x: (x["index"] >= 0) & (x["index"] < size))


def normalise_intensity(v: Column) -> Column:
    """NaN and infinities to 0, clipped to the 1st and 99th percentile of the positive values, scaled to 0 .. 255; all 0 where there is no spread."""
    real = F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), 0.0).otherwise(x.cast("double")))

    def at(up: Column, p: float) -> Column:
        place = (F.size(up) - 1) * F.lit(p)
        low = F.floor(place).cast("int")
        a, b = F.get(up, low), F.coalesce(F.get(up, low + 1), F.get(up, low))
        return a + (b - a) * (place - low)

    # Each step is bound once, so that it is not made anew for every component.
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    limits = lambda up: F.struct(at(up, 0.01).alias("lo"), at(up, 0.99).alias("hi"))
    scaled = lambda r, lim: F.transform(r, lambda x: F.when(lim["hi"] > lim["lo"], F.least(F.greatest((x - lim["lo"]) / (lim["hi"] - lim["lo"]), F.lit(0.0)), F.lit(1.0)) * 255).otherwise(0.0))
    return once(real, lambda r: once(once(F.array_sort(F.filter(r, lambda x: x > 0)), limits), lambda lim: scaled(r, lim)))


def fixed(c: Column, places: int) -> Column:
    """A number with fixed decimals."""
    return F.format_string(f"%.{places}f", c.cast("double"))


def signed(c: Column, places: int = 3) -> Column:
    return F.format_string(f"%+.{places}f", c.cast("double"))


def with_spread(mean: Column, sd: Column, places: int = 3) -> Column:
    return F.concat(fixed(mean, places), F.lit(" ± "), fixed(sd, places))


def with_interval(point: Column, low: Column, high: Column, places: int = 3) -> Column:
    return F.concat(fixed(point, places), F.lit(" ["), fixed(low, places), F.lit(", "), fixed(high, places), F.lit("]"))


def age_sex_groups(age: Column, sex: Column, median: Column) -> Column:
    """The groups that a row counts in: overall, by age, by sex, by both; without an age in none, without a sex not in the last."""
    band = F.when(age >= median, "old").otherwise("young")
    known = F.nullif(sex, F.lit(""))
    groups = F.array(F.lit("overall"), F.concat(F.lit("age_"), band), F.concat(F.lit("sex_"), F.coalesce(known, F.lit("unknown"))), F.concat(F.lit("sex_"), known, F.lit("_age_"), band))
    return F.when(age.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(groups))


def parse_date(c: Column) -> Column:
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def stable_token(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def entity_number(c: Column) -> Column:
    """Last underscore part of an id of three parts or more, as a number; null where it is not all digits."""
    parts = F.split(c, "_")
    return F.when((F.size(parts) >= 3) & F.element_at(parts, -1).rlike("^[0-9]+$"), F.element_at(parts, -1).try_cast("int"))


def session_id(subject: Column, visit: Column, day: Column) -> Column:
    """subject__visit, else subject__day, else what there is of subject and day, else unknown; blanks count as absent."""
    subject, visit = blank_to_null(subject), blank_to_null(visit)
    return F.coalesce(F.concat(subject, F.lit("__"), visit), F.concat(subject, F.lit("__"), day.cast("string")), subject, day.cast("string"), F.lit("unknown"))


def require_columns(df: DataFrame, needed: set[str]) -> DataFrame:
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def clean(df: DataFrame) -> DataFrame:
    """Landing table to typed use: normalised names, blank strings as nulls."""
    df = normalise_names(df)
    return df.select(*[blank_to_null(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def text_or_blank(c: Column) -> Column:
    return F.coalesce(F.when(~(c == F.lit(float("nan"))), c).cast("string"), F.lit(""))


def difference_hash(vector: Column) -> Column:
    """Bits of neighbour comparisons, first comparison most significant; vectors of at most 64 components."""
    return F.aggregate(F.sequence(F.lit(1), F.size(vector) - 1), F.lit(0).cast("bigint"), lambda acc, i: acc * 2 + F.when(F.element_at(vector, i) > F.element_at(vector, i + 1), 1).otherwise(0))


def grid_hash(pixels: Column, rows: int = 16, columns: int = 16) -> Column:
    """Row-major bits "a pixel is brighter than its right neighbour" of a grid with one more column, as words of 32 bits."""
    place = lambda n: (F.floor(n / columns) * (columns + 1) + n % columns).cast("int")
    brighter = lambda v, n: F.coalesce((F.get(v, place(n)) > F.get(v, place(n) + 1)).cast("bigint"), F.lit(0).cast("bigint"))
    word = lambda v, w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"), lambda a, i: a * 2 + brighter(v, w * 32 + i))
    words = lambda v: F.transform(F.sequence(F.lit(0), F.lit(rows * columns // 32 - 1)), lambda w: word(v, w))
    # Bound once, so that the pixels are not made anew for every bit.
    return F.get(F.transform(F.array(pixels), words), 0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Distance of hashes given as words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
