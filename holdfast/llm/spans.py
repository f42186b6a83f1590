"""Span lists of one text and their digest form, shared by the personal-data and secret operators."""

from __future__ import annotations

import pyarrow as pa

from holdfast.llm.common import sha

Span = tuple[int, int, int]  # start, end, index of the kind


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end``, by start, then by kind as listed, then by end, comma-joined."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def digest_batch(doc_ids: pa.Array, base: list[list[Span]], added: list[list[Span]], kinds: tuple[str, ...], n_base: int, cleaned: list[str]) -> pa.RecordBatch:
    """One row per document: counts by base kind, digest of base spans, all spans, the cleaned text."""
    columns = {"doc_id": doc_ids}
    for k in range(n_base):
        columns[f"n_{kinds[k]}"] = pa.array([sum(s[2] == k for s in spans) for spans in base], pa.int64())
    columns["base_sha256"] = pa.array([sha(ordered(spans, kinds)) for spans in base], pa.string())
    columns["spans"] = pa.array([ordered(b + a, kinds) for b, a in zip(base, added, strict=True)], pa.string())
    columns["clean_text"] = pa.array(cleaned, pa.string())
    return pa.RecordBatch.from_pydict(columns)


def digest_schema(kinds: tuple[str, ...], n_base: int) -> str:
    return "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds[:n_base]) + ", base_sha256 string, spans string, clean_text string"


def replaced(text: str, spans: list[Span], marks: list[str]) -> str:
    """``text`` with each span's characters replaced by its mark; of overlapping spans the first to start gives the mark for all they cover."""
    if not spans:
        return text
    out, at, until = [], 0, -1
    for s, e, k in sorted(spans):
        if s >= until:
            out += [text[at:s], marks[k]]
        until = at = max(until, e)
    return "".join(out) + text[at:]
