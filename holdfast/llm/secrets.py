"""Secret scan with multipart credential linking.

Strong candidates (assignments to secret names, access key ids, long hex) are
reported as they are. Weak candidates are parts of a credential that mean
little alone: an identifier (``user=...`` or an e-mail address), a weak secret
(``pwd: ...``) and an endpoint (a URL, ``host=...`` or an IPv4 address). They are intervals within a scope, a run of
text without a blank line. An interval join within each scope links parts at
most ``reach`` characters apart: a weak secret is reported when an identifier,
an access key id or an endpoint lies in reach; an identifier or endpoint when a
weak or strong secret does. The join walks the sorted intervals with a binary
search, so it never lists the pairs of a scope.

Defined cases: null text counts as empty and has no spans; a null doc_id stays
null; repeated rows give repeated results; an empty table gives an empty
table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.common import doc_columns, map_text, texts
from holdfast.llm.spans import Span, digest_batch, digest_schema, replaced

KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
N_BASE = 3

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", re.A | re.I)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"[0-9a-f]{24,}+")
_PARTS = (
    (3, re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9@._-]{3,}+""", re.A | re.I)),
    (4, re.compile(r"""\b(?:pwd|pass|passphrase|credentials?|auth|private_?key|signature)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9+/_.=!@#$%^&*-]{6,}+""", re.A | re.I)),
    (5, re.compile(r"""\b(?:https?|ftp|ssh|amqps?|redis|mysql|mongodb|postgres(?:ql)?|jdbc:[a-z]{2,20})://[^\s"'<>]++|\b(?:host(?:name)?|server|endpoint)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9.:/_-]{4,}+""", re.A | re.I)),
)
#: The same kinds without a name in front: e-mail addresses by the run around their sign, IPv4 addresses.
_MAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ADDRESS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9]|\.[0-9])")
_SCOPE_END = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[Span]:
    """The three base kinds, each leftmost and non-overlapping."""
    out: list[Span] = []
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return out


class _Intervals:
    """Intervals of one side of the join, sorted by start, with the furthest end up to each."""

    def __init__(self, spans: list[Span]):
        self.starts = [s for s, _, _ in spans]
        self.furthest, most = [], -1
        for _, e, _ in spans:
            most = max(most, e)
            self.furthest.append(most)

    def meets(self, start: int, end: int, reach: int) -> bool:
        """Whether one of them begins by end + reach and ends at start - reach or later."""
        n = bisect_left(self.starts, end + reach + 1)
        return n > 0 and self.furthest[n - 1] >= start - reach


def weak_parts(text: str) -> list[Span]:
    """All weak candidates, whatever stands beside them; those without a name in front where no named one covers them."""
    weak = [(m.start(), m.end(), k) for k, p in _PARTS for m in p.finditer(text)] if "=" in text or ":" in text else []
    bare, last = [], 0
    for m in _MAIL.finditer(text) if "@" in text else ():
        s = at = m.start()
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        last = m.end()
        if s < at:
            bare.append((s, m.end(), 3))
    bare += [(m.start(), m.end(), 5) for m in _ADDRESS.finditer(text)]
    named = _Intervals(sorted(weak))
    return weak + [s for s in bare if not named.meets(s[0] + 1, s[1] - 1, 0)]


def linked_parts(text: str, base: list[Span], reach: int) -> list[Span]:
    """Weak candidates with a complement in reach, in the same scope."""
    weak = weak_parts(text)
    if not any(s[2] in (0, 2, 4) for s in (*base, *weak)):  # no secret: nothing can be linked
        return []
    if not weak:
        return []
    ends = [m.start() for m in _SCOPE_END.finditer(text)]
    scope = lambda span: bisect_left(ends, span[0])
    scopes: dict[int, list[Span]] = {}
    for span in sorted(weak + base):
        scopes.setdefault(scope(span), []).append(span)
    out = []
    for spans in scopes.values():
        names = _Intervals([s for s in spans if s[2] in (1, 3, 5)])
        values = _Intervals([s for s in spans if s[2] in (0, 2, 4)])
        out += [s for s in spans if s[2] >= N_BASE and (names if s[2] == 4 else values).meets(s[0], s[1], reach)]
    return out


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """One row per document: counts and digest of base spans, all spans, and ``clean_text`` with the spans masked."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, added, cleaned = [], [], []
        for text in texts(batch):
            base.append(base_spans(text))
            added.append(linked_parts(text, base[-1], reach))
            cleaned.append(replaced(text, base[-1] + added[-1], ["<SECRET>", "<ACCESS_KEY>", "<HEX>", "<IDENTIFIER>", "<SECRET>", "<ENDPOINT>"]))
        return digest_batch(batch["doc_id"], base, added, KINDS, N_BASE, cleaned)

    return map_text(doc_columns(docs), run, digest_schema(KINDS, N_BASE))
