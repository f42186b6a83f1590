"""Sinks: fixed-header CSV, append, JSON summary, Markdown and LaTeX of small tables, partitioned predictions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a rendered table, at most; a larger one raises.
MAX_RENDERED = 10_000


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table does not have yet; null keys are always new, repeated new keys go in as they stand."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti").select(*df.columns)
    df.write.mode("append").parquet(path)


def _small(df: DataFrame) -> list:
    rows = df.limit(MAX_RENDERED + 1).collect()
    if len(rows) > MAX_RENDERED:
        raise ValueError("too many rows to render")
    return rows


def to_json(df: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in _small(df)], default=str, indent=2)


def to_markdown(df: DataFrame) -> str:
    """A table; bars and line ends inside cells are escaped, nulls are empty."""
    cell = lambda x: "" if x is None else str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(map(cell, df.columns)) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in _small(df))])


def audit_report(title: str, tables: dict[str, DataFrame], gates: DataFrame) -> str:
    """Markdown: every table under its name, then the decision: which gates (gate, passed) fail, or that all pass."""
    failed = [r.gate for r in _small(gates) if not r.passed]
    parts = [f"# {title}", *(f"## {name}\n\n{to_markdown(df)}" for name, df in tables.items())]
    parts.append("## Decision\n\n" + (f"FAIL: {', '.join(sorted(failed))}" if failed else "PASS: all gates hold"))
    return "\n\n".join(parts) + "\n"


_LATEX = str.maketrans({"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\n": " "})


def to_latex(df: DataFrame) -> str:
    """A tabular; all signs with a meaning in LaTeX are escaped, nulls are empty."""
    safe = lambda x: "" if x is None else str(x).translate(_LATEX)
    body = [" & ".join(map(safe, r)) + r" \\" for r in [df.columns, *_small(df)]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", *body, r"\end{tabular}"])


def write_predictions(df: DataFrame, path: str) -> None:
    df.withColumn("y_prob", F.round("y_prob", 6)).write.mode("overwrite").partitionBy("seed", "protocol").parquet(path)
