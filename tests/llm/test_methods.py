"""Each method at work: what it adds, against plain versions."""

import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from pyspark.sql import functions as F  # noqa: E402

from holdfast.llm import chat, decontamination, mixing, pii, quality, secrets, topk  # noqa: E402

SF = "/root/testdata/sf0.01"


def _planted():
    """Documents in which some terms stand with one address, one term beside any telephone number, and others anywhere."""
    rng = random.Random(3)
    plain = ["river", "stone", "window", "garden", "paper", "orange", "yellow", "market"]
    docs = []
    for i in range(120):
        words = rng.choices(plain, k=30)
        if i % 10 == 0:
            words[12:13] = ["kestrel", "anna.k@mail.example.org", "curator"]
        if i % 15 == 3:
            words[5:6] = ["dial", f"+1 (555) 010-{1000 + i}"]
        if i % 40 == 7:
            words.append("curator")
        docs.append((i, " ".join(words)))
    return [*docs, (None, None), (500, ""), (501, docs[0][1]), (501, docs[0][1])]


def _plain_terms(docs, support, of_class, confidence, least_bits):
    near, has, held = defaultdict(set), defaultdict(set), defaultdict(set)
    for row, (_, text) in enumerate(docs):
        text = text or ""
        for t in re.findall(r"[^\W\d_]{3,}", text.lower()):
            held[t].add(row)
        for s, e, k in pii.base_spans(text):
            value = text[s:e].lower() if k < 2 else re.sub(r"[^0-9]", "", text[s:e])
            words = text[:s].split()[-8:] + text[e:].split()[:8]
            for name in ((k, value), k):
                has[name].add(row)
                for w in words:
                    if "@" not in w:
                        for t in re.findall(r"[^\W\d_]{3,}", w.lower()):
                            near[t, name].add(row)
    out = {}
    for (t, name), rows in near.items():
        c = len(rows) / len(held[t])
        bits = math.log2(c * len(docs) / len(has[name]))
        if len(rows) >= (of_class if isinstance(name, int) else support) and c >= confidence and bits >= least_bits:
            out[t] = max(out.get(t, (0, 0, 0)), (c, round(bits, 9), len(rows)))
    return out


def test_disclosing_terms(spark):
    docs = _planted()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = _plain_terms(docs, 2, 5, 0.5, 2.5)
    assert {"kestrel", "curator", "dial"} == set(want) and want["curator"][0] < 1
    for most in (100_000, 0):  # terms in memory, and by joins
        got = {r.term: (r.confidence, round(r.bits, 9), r.support) for r in pii.disclosing_terms(table, min_bits=2.5, in_memory=most).collect()}
        assert got == want
        rows = {r.doc_id: r for r in pii.sanitise(table, min_bits=2.5, remove_at=0.9, in_memory=most).collect()}
        assert "kestrel" not in rows[0].clean_text and "<TERM>" in rows[0].clean_text and "term:" in rows[0].spans and "<EMAIL>" in rows[0].clean_text
        assert "term:" not in rows[1].spans and rows[None].spans == ""
        assert "<TERM>" in rows[7].clean_text  # no address there, but the term gives it away
    assert pii.sanitise(table.where("false")).count() == 0


def test_terms_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = _plain_terms(rows, 2, 5, 0.5, 6.0)
    got = {r.term: (r.confidence, round(r.bits, 9), r.support) for r in pii.disclosing_terms(docs).collect()}
    assert got == want


def _plain_links(text, base, reach):
    """Every pair of parts in a scope, compared."""
    parts = [*secrets.weak_parts(text), *base]
    ends = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda s: sum(e < s[0] for e in ends)
    out = []
    for a in parts:
        if a[2] < 3:
            continue
        partners = (1, 3, 5) if a[2] == 4 else (0, 2, 4)
        if any(b[2] in partners and scope(a) == scope(b) and b[0] <= a[1] + reach and b[1] >= a[0] - reach for b in parts):
            out.append(a)
    return sorted(out)


def test_credential_links_against_all_pairs(spark):
    rng = random.Random(9)
    pieces = ["user=app", "pwd: hunter22", "host: db.example.org", "https://a.example.org/x", "token = abcdef123", "AKIA" + "Z" * 16, "f" * 32, "a@b.example.com", "10.0.0.7", "\n\n", "\n", "plain words here", "x" * 90]
    linked = 0
    for _ in range(400):
        text = " ".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        base = secrets.base_spans(text)
        got = sorted(secrets.linked_parts(text, base, 60))
        assert got == _plain_links(text, base, 60), text
        linked += len(got)
    assert linked > 300
    for text in ("", "user=app", "a@b.example.com 10.0.0.7", "y" * 100_000 + " user=app " + "token=abcdefgh"):
        assert sorted(secrets.linked_parts(text, secrets.base_spans(text), 200)) == _plain_links(text, secrets.base_spans(text), 200)
    table = spark.createDataFrame([(1, None), (None, "user=app pwd: hunter22"), (2, ""), (3, "user=app pwd: hunter22"), (3, "user=app pwd: hunter22")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.spans) for r in secrets.scan(table).collect()) == [(0, "ident:0:8,weak:9:22"), (1, ""), (2, ""), (3, "ident:0:8,weak:9:22"), (3, "ident:0:8,weak:9:22")]


def _plain_fold(events):
    """Messages of one conversation, event by event."""
    order = {}
    for seq, mid, kind, role, text in events:
        order.setdefault(mid, []).append((seq, kind, role, text))
    out = []
    for mid, parts in order.items():
        now = None
        for seq, kind, role, text in sorted(parts, key=lambda p: (p[0], p[1])):
            if now is None or kind == "message":
                now = {"seq": seq, "role": "", "text": ""}
                out.append(now)
            now["role"] = now["role"] or role or ""
            now["text"] = (text or "") if kind in ("message", "edit", "regenerate") else now["text"] + (text or "")
    return [(m["role"], m["text"]) for m in sorted(out, key=lambda m: (m["seq"], m["role"], m["text"]))]


def test_folding_of_random_logs(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(30):
        for seq in range(rng.randrange(1, 40)):
            rows.append((conv, seq, f"m{rng.randrange(6)}", rng.choice(["delta", "delta", "edit", "regenerate", "message", "other"]), rng.choice(["user", "assistant", None]), rng.choice(["a", "</turn>", "<turn:x>", "\\b", "", None, "long " * 50])))
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, seq long, message_id string, kind string, role string, text string, parts string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse_chats(chat.format_chats(table)).collect()}
    want = {c: _plain_fold([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_chat_rows_without_parts(spark):
    """Ties, repeated rows, nulls, a very long text and clashing names."""
    long = "x<\\" * 200_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (2, None, None, None), (2, 3, "assistant", long), (None, 0, "user", "nobody")]
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, seq long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(table)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a"), ("user", "b"), ("assistant", "same"), ("assistant", "same")]
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", long)] and got[2].loss_texts == [long]
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "nobody")]


def test_bounds_spare_blocks():
    """Vectors in clusters: most pairs are never scored, and the result is that of all pairs; also with a k-th score known before."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32)) * 40
    c = np.floor(centres[rng.integers(0, 40, 4_000)] + rng.normal(size=(4_000, 32)) * 4).astype(np.int64)
    ids = rng.permutation(4_000)
    q_ids, q = ids[:100], c[:100]
    scores = q @ c.T
    want = []
    for j in range(100):
        best = sorted((-int(s), int(i)) for s, i in zip(scores[j], ids, strict=True) if i != q_ids[j])[:20]
        want += [(int(q_ids[j]), i, -s) for s, i in best]
    tally = []
    assert topk.search_blocks(q_ids, q, ids, c, 20, 64, tally=tally) == want
    assert sum(tally) < 0.2 * q.shape[0] * len(c)
    least = np.array([want[20 * j + 19][2] for j in range(100)])
    again = []
    assert topk.search_blocks(q_ids, q, ids, c, 20, 64, least=least, tally=again) == want
    assert sum(again) <= sum(tally)


def test_places_of_blocks(spark):
    """Every pass is a permutation of a source's blocks, cut where the budget ends, whatever the ranges."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.plan_copies(docs, entropy_share=0.99, max_repeat=3.0, block_tokens=2_000).collect()
    blocks = defaultdict(set)
    for r in rows:
        blocks[r.source].add(r._mix_block)
    seen = defaultdict(lambda: defaultdict(set))
    for r in rows:
        assert len(r._mix_places) == r._mix_copies
        for n, at in enumerate(r._mix_places):
            seen[r.source, n][r._mix_block].add(at)
    full = Counter()
    for (source, n), of in seen.items():
        assert all(len(at) == 1 for at in of.values())
        places = sorted(min(at) for at in of.values())
        assert places == list(range(1, len(places) + 1))
        full[source] += len(places) == len(blocks[source])
    assert max(full.values()) >= 1
    orders = [[b for b, _ in sorted(seen[s, n].items(), key=lambda x: min(x[1]))] for s, n in list(seen) if len(seen[s, n]) > 5]
    assert len({tuple(o) for o in orders}) == len(orders)
    held = spark.createDataFrame([("a", b, 100_000, 2.5, 100) for b in range(1_000)] + [("b", 0, 5, 1.0, 5)], "_mix_source string, _mix_block long, _mix_total long, _mix_passes double, _mix_held long")
    key = lambda r: (r._mix_source, r._mix_block)
    one, many = (sorted(((*key(r), r._mix_left, list(r._mix_order)) for r in mixing.permuted(held, 100, 0, size).collect())) for size in (1 << 30, 16))
    assert one == many and sorted(x[3][0] for x in one[:1000]) == list(range(1, 1001)) and sum(x[2] > 0 for x in one[:1000]) == 500


def test_mixed_rows(spark, awkward, empty):
    """Copies as planned, in the order of the passes; nulls, empty texts, repeated rows and clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, awkward, awkward.withColumn("source", F.lit(None).cast("string")), awkward.where("text is null or text = ''"), empty):
        planned = mixing.plan_copies(table, max_repeat=3.0).collect()
        want = Counter()
        for r in planned:
            want[r.doc_id, r.text] += r._mix_copies
        got = Counter((r.doc_id, r.text) for r in mixing.mix(table, max_repeat=3.0).collect())
        assert got == +want


def test_scores_do_not_depend_on_files(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = [sorted(tuple(r) for r in quality.classify(d, labels, fit_rows=300).collect()) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(2))]
    assert found[0] == found[1] == found[2]


def test_clean_rows_in_parts(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (sorted(r.doc_id for r in decontamination.clean_rows(docs, bench, max_index_words=n).collect()) for n in (500_000, 100))
    assert one == many and len(one) < docs.count()
