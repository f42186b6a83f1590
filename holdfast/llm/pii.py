"""Information-theoretic sanitisation of personal data.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers:
the protected entities. Corpus counts then show which ordinary terms give an
entity away: for a term t among the ``NEAR_WORDS`` words on either side of an
entity e, with document counts n(t, e), n(t), n(e) over N documents,

    confidence = n(t, e) / n(t)             how surely t points to e
    bits       = log2(N n(t, e) / n(t) n(e))  pointwise mutual information

A term over both thresholds, seen with e in ``min_support`` documents or more,
is disclosing. The class of an entity (e-mail addresses, say) counts as an entity
too, with ``class_support`` in place of ``min_support``: a term that always stands
beside some address gives away that there is one. A disclosing term's occurrences become spans of kind ``term``: generalised to
a mark, or removed where the confidence is ``remove_at`` or more.

Defined cases: null text counts as empty and has no spans; a null doc_id stays
null; repeated rows are separate documents in every count; an empty table gives
an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import doc_columns, map_text, text_slices, texts
from holdfast.llm.spans import Span, digest_batch, digest_schema, replaced
from holdfast.scratch import written

KINDS = ("email", "ip", "card", "phone", "term")
N_BASE = 4
#: Disclosing terms held in each task's memory at most; beyond that they reach their documents by a join.
TERMS_IN_MEMORY = 100_000
#: Words on either side of an entity that count as standing near it.
NEAR_WORDS = 8

# No pattern here backtracks over what it has read, so long runs cost time in proportion.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The four base kinds, each leftmost and non-overlapping."""
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text):  # each address has one "@"; the local part is the run before it
        s = at = m.start()
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < at:
            out.append((s, m.end(), 0))
            last = m.end()
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), m.end(), 3))
    return out


def entity(text: str, span: Span) -> int:
    """A 64-bit name of the protected value, the same for all ways to write it."""
    value = text[span[0] : span[1]].lower() if span[2] < 2 else _NOT_DIGIT.sub("", text[span[0] : span[1]])
    return int.from_bytes(hashlib.blake2b(f"{span[2]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


class Context:
    """The words of a text by place, found once for all of its entities."""

    def __init__(self, text: str):
        self.text = text
        places = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in places], [e for _, e in places]

    def terms(self, span: Span) -> set[str]:
        """Terms in the nearest words on both sides; of a word that the entity cuts, the part beside it."""
        s, e, _ = span
        before = bisect_left(self.starts, s)  # words that start before the entity
        after = bisect_right(self.ends, e)  # the first that ends beyond it
        left = [self.text[a : min(b, s)] for a, b in zip(self.starts[max(0, before - NEAR_WORDS) : before], self.ends[max(0, before - NEAR_WORDS) : before], strict=True)]
        right = [self.text[max(a, e) : b] for a, b in zip(self.starts[after : after + NEAR_WORDS], self.ends[after : after + NEAR_WORDS], strict=True)]
        return {t for w in (*left, *right) if "@" not in w for t in _TERM.findall(w.lower())}


def near_terms(text: str, span: Span) -> set[str]:
    return Context(text).terms(span)


def class_entity(kind: int) -> int:
    """The name of a whole class of entities."""
    return int.from_bytes(hashlib.blake2b(f"class:{kind}".encode(), digest_size=8).digest(), "little", signed=True)


def _cooccurrence(batches):
    classes = [class_entity(k) for k in range(N_BASE)]
    for batch in text_slices(batches):
        names, ids = [], []
        for text in texts(batch):
            pairs, spans = set(), base_spans(text)
            context = Context(text) if spans else None
            for span in spans:
                for e in (entity(text, span), classes[span[2]]):
                    pairs |= {("", e)} | {(t, e) for t in context.terms(span)}
            for t, e in pairs:
                names.append(t)
                ids.append(e)
        yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "entity": pa.array(ids, pa.int64())})


def _frequencies(wanted: frozenset[str]):
    def run(batches):
        counts: dict[str, int] = {}
        for batch in text_slices(batches):
            for text in texts(batch):
                for t in wanted.intersection(_TERM.findall(text.lower())):
                    counts[t] = counts.get(t, 0) + 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def _document_terms(batches):
    for batch in text_slices(batches):
        ids, names = [], []
        for key, text in zip(batch["row"].to_pylist(), texts(batch), strict=True):
            found = set(_TERM.findall(text.lower()))
            ids += [key] * len(found)
            names += found
        yield pa.RecordBatch.from_pydict({"row": pa.array(ids, pa.string()), "term": pa.array(names, pa.string())})


def disclosing_terms(docs: DataFrame, min_support: int = 2, min_confidence: float = 0.5, min_bits: float = 6.0, class_support: int = 5, in_memory: int = TERMS_IN_MEMORY) -> DataFrame:
    """Table (term, confidence, bits, support) of terms that give an entity away; for each term its most telling entity."""
    docs = doc_columns(docs)
    seen = written(docs.mapInArrow(_cooccurrence, "term string, entity long").groupBy("term", "entity").agg(F.count("*").alias("n_te")), "pii-near")
    of_entity = seen.where("term = ''").select("entity", F.col("n_te").alias("n_e"))
    enough = F.when(F.col("entity").isin([class_entity(k) for k in range(N_BASE)]), class_support).otherwise(min_support)
    pairs = written(seen.where((F.col("term") != "") & (F.col("n_te") >= enough)).join(of_entity, "entity"), "pii-pairs")
    terms = pairs.select("term").distinct()
    few = terms.limit(in_memory + 1).count() <= in_memory
    if few:
        wanted = frozenset(r.term for r in terms.collect())
        of_term = docs.mapInArrow(_frequencies(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    else:
        of_term = docs.withColumn("row", F.lit("")).mapInArrow(_document_terms, "row string, term string").join(terms, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.count()
    confidence = F.col("n_te") / F.col("n_t")
    bits = F.log2(confidence * F.lit(float(max(total, 1))) / F.col("n_e"))
    return (
        pairs.join(of_term, "term")
        .select("term", confidence.alias("confidence"), bits.alias("bits"), F.col("n_te").alias("support"))
        .where((F.col("confidence") >= min_confidence) & (F.col("bits") >= min_bits))
        .groupBy("term")
        .agg(F.max(F.struct("confidence", "bits", "support")).alias("best"))
        .select("term", "best.*")
    )


def _sanitise(batch: pa.RecordBatch, held: dict[str, float], remove_at: float) -> pa.RecordBatch:
    base, added, cleaned = [], [], []
    own = batch["found"].to_pylist() if "found" in batch.schema.names else None
    for i, text in enumerate(texts(batch)):
        spans = base_spans(text)
        known = held if own is None else {x["term"]: x["confidence"] for x in own[i] or ()}
        terms, removed = [], []
        if known:
            for m in _TERM.finditer(text):
                c = known.get(m[0].lower())
                if c is not None:
                    terms.append((m.start(), m.end(), 4))
                    if c >= remove_at:
                        removed.append((m.start(), m.end(), 5))
        gone = {(s, e) for s, e, _ in removed}
        marked = spans + [(s, e, 5 if (s, e) in gone else 4) for s, e, _ in terms]
        base.append(spans)
        added.append(terms)
        cleaned.append(replaced(text, marked, ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", ""]))
    return digest_batch(batch["doc_id"], base, added, KINDS, N_BASE, cleaned)


def sanitise(docs: DataFrame, min_support: int = 2, min_confidence: float = 0.5, min_bits: float = 6.0, class_support: int = 5, remove_at: float = 0.9, in_memory: int = TERMS_IN_MEMORY) -> DataFrame:
    """One row per document: counts and digest of base spans, all spans, and ``clean_text``.

    Up to ``in_memory`` disclosing terms (at most a few MB) go to every task;
    more reach their documents by a join on the documents' own terms, with the same result.
    """
    docs = doc_columns(docs)
    terms = written(disclosing_terms(docs, min_support, min_confidence, min_bits, class_support, in_memory), "pii-terms")
    schema = digest_schema(KINDS, N_BASE)
    if terms.limit(in_memory + 1).count() <= in_memory:
        held = {r.term: r.confidence for r in terms.collect()}
        return map_text(docs, lambda b: _sanitise(b, held, remove_at), schema)
    keyed = docs.withColumn("row", F.concat_ws(":", F.xxhash64("doc_id", "text"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = (
        keyed.select("row", "text").dropDuplicates(["row"]).mapInArrow(_document_terms, "row string, term string").join(terms.select("term", "confidence"), "term")
        .groupBy("row").agg(F.collect_list(F.struct("term", "confidence")).alias("found"))
    )
    return map_text(keyed.join(found, "row", "left").select("doc_id", "text", "found"), lambda b: _sanitise(b, {}, remove_at), schema)
