"""Weak-label quality classifier.

Heuristic labellers vote on every document for two questions, ``junk`` and
``toxic``: -1 yes, 1 no, 0 no opinion. Expectation-maximisation over the
counts of vote patterns of all documents (at most 3^labellers of them)
estimates the prior and each labeller's rates of every vote under either
truth, hence a posterior for every pattern. A linear scorer over hashed words
and votes, trained on the posteriors of a bounded sample, then scores every
document as a whole.

Toxic terms are learned from labelled documents (a bounded sample of
``fit_rows``), beside a short list of common insults.

Defined cases: null text counts as empty, and an empty text is junk; a null
doc_id stays null; repeated rows get equal scores; an empty table gives an
empty table; no labels leave the learned list empty; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Cache, doc_columns, text_slices, texts
from holdfast.scratch import written

TASKS = ("junk", "toxic")
#: Width of the hashed weights.
DIM = 1 << 15
#: Rows at most that either fit sees.
FIT_ROWS = 4000
#: Distinct tokens, or words, that a reader numbers before it begins anew; about 250 bytes each.
NUMBERED = 150_000

#: Common English insults, a seed for the toxic labellers.
INSULTS = frozenset("clown disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash vermin worthless".split())

_ODD = re.compile(r"[^\w\s.,;:!?'\"()\[\]…«»¿¡-]")
_ENDS = ".,;:!?'\"()"


def _plain(token: str) -> str:
    return token.strip(_ENDS).lower()


class Numbers(dict):
    """Keys to 0, 1, 2, ... by first sight, with a row of values that is computed once a key."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.clear()

    def __missing__(self, key):
        n = self[key] = len(self)
        self.pending.append(self.make(key))
        return n

    def rows(self) -> np.ndarray:
        """The values, a row a key."""
        if self.pending:
            n = len(self)
            if n > len(self.held):
                more = np.zeros((max(n, 1024), len(self.pending[0])))
                self.held = np.concatenate([self.held, more]) if len(self.held) else more
            self.held[n - len(self.pending) : n] = self.pending
            self.pending = []
        return self.held

    def clear(self):
        super().clear()
        self.pending, self.held = [], np.zeros((0, 0))


class Reader:
    """Texts to labellers' votes and a bag of words; what depends on a token or word alone is computed once."""

    def __init__(self, learned: dict[str, float], slots: bool = True, most: int = NUMBERED):
        self.learned = learned
        self.begun = {x[: STEMS[0]] for x in learned if x.endswith("*")}  # how a word with a learned stem begins
        self.slots = slots
        self.most = most
        self.tokens = Numbers(self._token)  # capitals, odd characters, no letter or digit, number of the word
        self.words = Numbers(self._word)  # weight of evidence, insult, slot of the hashed weights

    def _token(self, token: str) -> tuple:
        core = token.strip(_ENDS)
        upper = len(token) > 1 and token.isupper()
        if core.isalpha():
            return upper, False, False, self.words[core.lower()]
        return upper, bool(_ODD.search(token)), not any(map(str.isalnum, token)), self.words[core.lower()]

    def _word(self, word: str) -> tuple:
        weight = self.learned.get(word, 0.0)
        if word[: STEMS[0]] in self.begun:
            weight = max(weight, *(self.learned.get(x, 0.0) for x in stems(word)), 0.0)
        return weight, word in INSULTS, _slot(word) if self.slots else 0

    def read(self, text: str) -> tuple[np.ndarray, tuple[str, str]]:
        """The slots of the text's distinct words, and the votes on either question."""
        if len(self.tokens) > self.most:  # both at once, as tokens name words by number
            self.tokens.clear()
            self.words.clear()
        tokens = text.split()
        numbers = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        if not len(numbers):
            return np.zeros(0, np.int64), (pattern((-1, -1, 0, -1, 0, 0, 0)), pattern(self.toxic_votes(np.zeros(0), np.zeros(0), 0, 0)))
        traits = self.tokens.rows()[numbers]
        said = traits[:, 3].astype(np.int64)
        bag, times = np.unique(said, return_counts=True)
        weight, insult, slots = self.words.rows()[bag].T
        n_hits = int(times[(weight > 0) | (insult > 0)].sum())
        votes = self.junk_votes(text, numbers, traits[:, :3].sum(0)), self.toxic_votes(weight, insult, n_hits, len(numbers))
        return slots.astype(np.int64), (pattern(votes[0]), pattern(votes[1]))

    def junk_votes(self, text: str, numbers: np.ndarray, traits: np.ndarray) -> tuple[int, ...]:
        """Seven labellers: emptiness, capitals, odd characters, bare symbols, stuttering, repeated triples, repeated lines."""
        n = len(numbers)
        upper, odd, bare = (traits / n).tolist()
        stutter = np.count_nonzero(numbers[1:] == numbers[:-1]) / n
        triples = 1 - self.distinct_triples(numbers) / (n - 2) if n >= 30 else 0.0
        lines = [x for x in text.split("\n") if x.strip()]
        same = 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.0
        return (1, *(1 if x <= good else -1 if x >= bad else 0 for x, good, bad in ((upper, 0.2, 0.5), (odd, 0.08, 0.2), (bare, 0.04, 0.1), (stutter, 0.1, 0.2), (triples, 0.15, 0.3), (same, 0.25, 0.45))))

    def distinct_triples(self, numbers: np.ndarray) -> int:
        a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
        if len(self.tokens) <= 1 << 21:  # three numbers in 63 bits
            return len(np.unique(a << 42 | b << 21 | c))
        return len(np.unique(np.stack([a, b, c]), axis=1).T)

    def toxic_votes(self, weight: np.ndarray, insult: np.ndarray, n: int, of: int) -> tuple[int, ...]:
        """Four labellers: insults by list, the learned terms' weight of evidence, their number, their share of the words."""
        known = 1 if self.learned else 0
        return (
            -1 if insult.any() else 0,
            -1 if weight.sum() >= 6 else 0 if weight.any() else known,
            -1 if np.count_nonzero((weight > 0) | (insult > 0)) > 1 else 1,
            -1 if n > 1 and n >= 0.006 * of else 0 if n > 1 else 1,
        )


STEMS = (4, 5, 6)


def stems(word: str) -> list[str]:
    """A word's beginnings, marked as such."""
    return [f"{word[:k]}*" for k in STEMS if len(word) > k]


def pattern(votes: tuple[int, ...]) -> str:
    return "".join("-0+"[v + 1] for v in votes)


def learn_terms(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, float]:
    """Words and beginnings of words that stand in toxic documents and hardly in others, with their log-odds; from ``fit_rows`` labelled documents of either kind at most."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    joined = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most 2 * fit_rows ids

    def count(wanted: frozenset | None):
        def run(batches):
            plain, of, seen = Cache(_plain), Counter(), 0
            for batch in text_slices(batches):
                for text in texts(batch):
                    found = {x for w in map(plain.__getitem__, text.split()) for x in (w, *stems(w))}
                    of.update(found if wanted is None else found & wanted)
                    seen += 1
                plain.trim()
            yield pa.RecordBatch.from_pydict({"word": pa.array(["", *(w for w in of if w)], pa.string()), "n": pa.array([seen, *(n for w, n in of.items() if w)], pa.int64())})

        return run

    # A term stands in a fiftieth of the sample's toxic documents, so their number is bounded by fifty times a document's
    # words; of the other documents, only those terms are counted.
    toxic = written(joined.where("toxic > 0").mapInArrow(count(None), "word string, n long").groupBy("word").agg(F.sum("n").alias("toxic")), "quality-toxic")
    nt = (toxic.where("word = ''").first() or [0, 0])[1]
    if not nt:
        return {}
    likely = toxic.where((F.col("word") != "") & (F.col("toxic") >= max(3, nt // 50)))
    wanted = frozenset(r.word for r in likely.collect())
    clean = written(joined.where("toxic <= 0").mapInArrow(count(wanted), "word string, n long").groupBy("word").agg(F.sum("n").alias("clean")), "quality-clean")
    nc = (clean.where("word = ''").first() or [0, 0])[1]
    total = likely.join(clean, "word", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
    odds = F.log(((F.col("toxic") + 0.5) / (nt + 1.0)) / ((F.col("clean") + 0.5) / (nc + 1.0)))
    rows = total.withColumn("odds", odds).where("odds >= 3.5")
    return {r.word: r.odds for r in rows.orderBy(F.desc("odds"), "word").collect()}


#: Rates of the votes -1, 0, 1 with which estimation begins, where the truth is yes and no: junk is of many kinds, of
#: which a labeller knows one; the toxic labellers see the same words.
START = {"junk": ((0.3, 0.05, 0.65), (0.001, 0.1, 0.899)), "toxic": ((0.6, 0.1, 0.3), (0.003, 0.1, 0.897))}


def expectation_maximisation(counts: dict[str, int], start: tuple, prior: float = 0.1, rounds: int = 200) -> dict[str, float]:
    """Posterior of "yes" for every vote pattern; labellers are independent given the truth.

    Pseudo-counts of one part in fifty hold the rates near their start where the
    votes say little. A labeller is taken to know a tenth of what is sought at
    least, and to be wrong on two in a thousand of the rest at most.
    """
    if not counts:
        return {}
    names = sorted(counts)
    n = np.array([counts[p] for p in names], float)
    onehot = np.eye(3)[np.array([["-0+".index(c) for c in p] for p in names])]  # pattern, labeller, vote
    begin = np.array(start)
    rates = np.repeat(begin[:, None, :], onehot.shape[1], axis=1)  # truth, labeller, vote
    p, post = prior, np.zeros(len(n))
    for _ in range(rounds):
        yes, no = (np.log(q) + np.einsum("plv,lv->p", onehot, np.log(r)) for q, r in zip((p, 1 - p), rates, strict=True))
        new = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        p = float(np.clip((n * post).sum() / n.sum(), 1e-3, 0.5))
        for i, w in enumerate((n * post, n * (1 - post))):
            seen = np.einsum("p,plv->lv", w, onehot) + (5 + 0.02 * n.sum() * (p, 1 - p)[i]) * begin[i]
            rates[i] = seen / seen.sum(1, keepdims=True)
        rates[0, :, 0] = np.maximum(rates[0, :, 0], 0.1)
        rates[1, :, 0] = np.minimum(rates[1, :, 0], 0.002)
        rates /= rates.sum(2, keepdims=True)
    return dict(zip(names, post.tolist(), strict=True))


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


def _features(task: int, words: np.ndarray, votes: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: slots of the distinct words of a length-normalised bag, and the labellers' votes."""
    slots = np.concatenate([words, np.array(_vote_slots(task, votes), np.int32)])
    values = np.ones(len(slots), np.float32)
    values[: len(words)] = 1 / math.sqrt(max(1, len(words)))
    return slots, values


def _vote_slots(task: int, votes: str) -> list[int]:
    return [_slot(f"\x00{task}:{i}{v}") for i, v in enumerate(votes)]


def train_scorer(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior (soft) labels by full-batch AdaGrad."""
    w, bias, g2, b2 = np.zeros(DIM), 0.0, np.full(DIM, 1e-6), 1e-6
    if not examples:
        return w, bias
    rows = np.repeat(np.arange(len(examples)), [len(e[0]) for e in examples])
    cols = np.concatenate([e[0] for e in examples]).astype(np.int64)
    vals = np.concatenate([e[1] for e in examples])
    y = np.array([e[2] for e in examples])
    for _ in range(epochs):
        z = np.bincount(rows, vals * w[cols], len(y)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        g = np.bincount(cols, vals * err[rows], DIM) + decay * w / len(y)
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        gb = err.sum()
        b2 += gb * gb
        bias -= rate * gb / math.sqrt(b2)
    return w, bias


def _sampled(docs: DataFrame, rows: int, fit_rows: int) -> DataFrame:
    """The ``fit_rows`` first of ``rows`` documents by hash; only a few more than those are sorted."""
    at = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 20))
    share = min(1.0, 1.2 * fit_rows / max(1, rows))
    return docs.where(at < math.ceil(share * (1 << 20))).orderBy(at, "doc_id", "text").limit(fit_rows)


def _fitted(docs: DataFrame, labels: DataFrame | None, fit_rows: int, threshold: float):
    """Fits the models on ``docs``; gives a function that a task calls once, for a function from a batch to its columns."""
    docs = doc_columns(docs)
    learned = learn_terms(docs, labels, fit_rows) if labels is not None else {}

    def vote(batches):
        reader = Reader(learned, slots=False)
        for batch in text_slices(batches):
            found = [reader.read(t)[1] for t in texts(batch)]
            yield pa.RecordBatch.from_pydict({"junk": pa.array([f[0] for f in found], pa.string()), "toxic": pa.array([f[1] for f in found], pa.string())})

    votes = docs.mapInArrow(vote, "junk string, toxic string").groupBy("junk", "toxic").agg(F.count("*").alias("n"))
    found = votes.collect()  # patterns, 3^12 at most
    posterior = []
    for task in TASKS:
        counts = Counter()
        for r in found:
            counts[r[task]] += r.n
        posterior.append(expectation_maximisation(counts, START[task]))

    def sample(batches):
        reader = Reader(learned)
        for batch in text_slices(batches):
            found = [reader.read(t) for t in texts(batch)]
            yield pa.RecordBatch.from_pydict({"bag": pa.array([bag.astype(np.int32).tobytes() for bag, _ in found], pa.binary()), **{k: pa.array([pats[i] for _, pats in found], pa.string()) for i, k in enumerate(TASKS)}})

    # A bounded sample by hash of the id and the text, so that no row's place in the files counts; its size does not follow the corpus.
    drawn = _sampled(docs, sum(r.n for r in found), fit_rows)
    examples: tuple[list, ...] = ([], [])
    for r in drawn.mapInArrow(sample, "bag binary, junk string, toxic string").toLocalIterator():
        bag = np.frombuffer(r.bag, np.int32)
        for task, name in enumerate(TASKS):
            examples[task].append((*_features(task, bag, r[name]), posterior[task].get(r[name], 0.0)))
    # Every vote pattern is an example too, so that rare ones are learned.
    for task in range(len(TASKS)):
        for pat, y in posterior[task].items():
            examples[task].append((*_features(task, np.zeros(0, np.int32), pat), y))
    models = [train_scorer(e) for e in examples]
    packed = [(w.astype(np.float32), b) for w, b in models]

    def scorer():
        weights = [w.astype(np.float64) for w, _ in packed]
        # Bias and votes of a pattern, at most 3^labellers of them.
        given = [Cache(lambda pat, t=t: packed[t][1] + float(weights[t][_vote_slots(t, pat)].sum())) for t in range(len(TASKS))]
        reader = Reader(learned)

        def score(batch):
            columns: dict[str, list] = {"p_junk": [], "p_toxic": [], "posterior_junk": [], "posterior_toxic": []}
            for text in texts(batch):
                bag, pats = reader.read(text)
                scale = 1 / math.sqrt(max(1, len(bag)))
                for task, name in enumerate(TASKS):
                    z = given[task][pats[task]] + scale * float(weights[task][bag].sum())
                    columns[f"p_{name}"].append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
                    columns[f"posterior_{name}"].append(posterior[task].get(pats[task], 0.0))
            return {k: pa.array(v, pa.float64()) for k, v in columns.items()} | {"keep": pa.array([max(x) < threshold for x in zip(columns["p_junk"], columns["p_toxic"], strict=True)], pa.bool_())}

        return score

    return scorer


def classify(docs: DataFrame, labels: DataFrame | None = None, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per document: p_junk, p_toxic, posterior_junk, posterior_toxic and ``keep`` (both scores below the threshold)."""
    docs = doc_columns(docs)
    scorer = _fitted(docs, labels, fit_rows, threshold)

    def run(batches):
        score = scorer()
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | score(batch))

    return docs.mapInArrow(run, "doc_id long, p_junk double, p_toxic double, posterior_junk double, posterior_toxic double, keep boolean")


def kept_rows(docs: DataFrame, labels: DataFrame | None = None, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that classify() keeps, each by its own text."""
    scorer = _fitted(docs, labels, fit_rows, threshold)

    def run(batches):
        score = scorer()
        for batch in text_slices(batches):
            yield batch.filter(score(batch)["keep"])

    return docs.mapInArrow(run, docs.schema)
